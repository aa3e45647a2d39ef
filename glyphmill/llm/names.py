"""Spellings in one series that mean the same person or organisation.

A spelling is parsed into words: titles, articles and case fall away, `Family, Given` is turned,
joined and camel-cased names are split, initials and kinds of organisation are told apart. Words of
a series that are one typing slip apart are found in a metric space: every word is at home in the
cell of its nearest pivot and, by the triangle inequality, is sent to each cell that may hold a
word within the radius; inside a cell words meet in bands of equal distance from the pivot, and a
true edit metric (insert, delete, replace, swap) decides. Names of two words or more are entities;
one whose every word equals a word of a more frequent one or is a slip of it joins that one. Pet
names, initials, lone parts, bare organisations and acronyms join the entity they fit, if they fit
one only.

Defined results: a spelling that fits several entities is linked to none of them; where only the
last vowel of the first name differs, two persons are meant (siblings are named so); null series, null, blank and
repeated spellings add nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.glyphs import glyph_form
from glyphmill.llm.terms import bank_of, bank_rows, distance, entries
from glyphmill.session import checkpointed, spread

RADIUS = 1
#: Pivots are picked, farthest first, from a sample of at most this many words.
PIVOT_SAMPLE = 400
PIVOTS = 12

# Titles, kinds of organisation with their short forms, labels that are no names, and pet names.
TITLES = set("mr mrs ms miss dr doctor prof professor capt captain lt lieutenant sgt sergeant sir madam lady lord col colonel gen general maj major rev جناب آقای آقا خانم سرکار دکتر استاد مهندس سروان سرهنگ حاج سید".split())
KINDS = {
    "association": "assoc", "society": "soc", "department": "dept", "institute": "inst", "brotherhood": "bhd", "company": "co",
    "corporation": "corp", "university": "univ", "committee": "comm", "foundation": "fdn", "ministry": "min", "bureau": "bur",
    "organization": "org", "academy": "acad", "council": "cncl", "guild": "gld", "union": "un", "league": "lg", "office": "off",
    "incorporated": "inc", "limited": "ltd", "hospital": "hosp", "school": "sch", "agency": "agcy", "federation": "fed", "group": "grp",
}
LABELS = set("guard crowd narrator narration voice radio old young woman man boy girl child soldier stranger unknown all both everyone sfx only same as above ask editor tbd todo none na sign note see term new check راوی صدا نگهبان جمعیت پیرزن پیرمرد همه نمی نمیدانم دانم همان".split())
PET_NAMES = {
    "alexander": "alex al sandy xander lex sasha", "william": "will bill billy willy liam", "katherine": "kate katie kathy kat kit kitty",
    "richard": "rick dick rich richie ricky", "margaret": "maggie meg peggy peg greta madge marge", "isabella": "bella izzy isa belle",
    "victoria": "vicky vicki tori vic", "robert": "rob bob bobby robbie bert", "frederick": "fred freddie freddy", "benjamin": "ben benji benny",
    "jonathan": "jon jonny nathan johnny", "edward": "ed eddie ned ted teddy", "penelope": "penny pen nell", "nathaniel": "nat nate nathan",
    "theodora": "thea dora theo", "gabriella": "gabby gabi ella gaby", "elizabeth": "liz beth betty eliza lizzie lisa betsy libby", "josephine": "josie jo joey",
    "theodore": "ted teddy theo", "james": "jim jimmy jamie", "john": "jack johnny", "charles": "charlie chuck", "henry": "harry hank",
    "thomas": "tom tommy", "michael": "mike mick mickey", "samuel": "sam sammy", "samantha": "sam", "daniel": "dan danny", "joseph": "joe joey",
    "anthony": "tony", "andrew": "andy drew", "christopher": "chris kit", "matthew": "matt", "patricia": "pat patty tricia", "rebecca": "becky",
    "dorothy": "dot dolly", "susan": "sue susie", "eleanor": "nell ellie nora", "catherine": "cathy cate kate", "nicholas": "nick nicky", "stephen": "steve",
    "غلامحسین": "غلام", "فاطمه": "فاطی", "محمدرضا": "ممد رضا محمد ممدرضا", "اسماعیل": "اسی اسمال", "خدیجه": "خدی خجی", "سکینه": "سکی سکین",
}
FOLD = str.maketrans({"ي": "ی", "ى": "ی", "ك": "ک", "ة": "ه", "أ": "ا", "إ": "ا", "‌": " ", "،": ",", "’": "'", "_": " "})
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
VOWELS = set("aeiouy") | set("اویه")

PARSED = "series string, spelling string, n bigint, shape string, words array<string>, kind string"


def bare(text: str) -> str:
    """Without accents and in one set of Persian letters."""
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).translate(FOLD))
    return "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf"))


TITLES, LABELS = {bare(x) for x in TITLES}, {bare(x) for x in LABELS}
PET_NAMES = {bare(k): bare(v) for k, v in PET_NAMES.items()}


def _kind(word: str) -> str | None:
    """The kind of organisation that ``word`` writes, perhaps with a slip or cut short."""
    for kind, short in KINDS.items():
        if word in (kind, short) or len(word) > 5 and word[0] == kind[0] and distance(word, kind, 2) <= 2:
            return kind
    return None


def parse(spelling: str) -> tuple[str, list[str], str] | None:
    """Shape, words and kind of a spelling; None for what is no name."""
    text = bare(HUMP.sub(" ", glyph_form(spelling.replace("‌", " ")) or ""))
    if any(c.isdigit() for c in text):
        return None
    acronym = re.fullmatch(r"\s*(?:([A-Z]{2,6})|((?:[A-Za-z]\.\s?){2,6}))\s*", text)
    head, comma, tail = text.casefold().partition(",")
    if comma:
        if "," in tail:
            return None
        head, tail = tail, head
        text = f"{head} {tail}"
    if acronym and not comma:
        return "acronym", [re.sub(r"[^a-z]", "", text.casefold())], ""
    found = re.findall(r"[^\W\d_]+", re.sub(r"'s\b", "", text.casefold()))
    if any(w in LABELS for w in found):
        return None
    while found and (found[0] in TITLES or found[0] == "the"):
        found = found[1:]
    found = [w for w in found if w != "of"]
    if not found or len(found) > 5:
        return None
    kinds = [(i, k) for i, w in enumerate(found) if (k := _kind(w))]
    if kinds and len(found) > 1:
        at, kind = kinds[-1]
        return "org", [w for i, w in enumerate(found) if i != at], kind
    initials = [w for w in found if len(w) == 1]
    parts = [w for w in found if len(w) > 1]
    if initials:
        return ("initial", parts, initials[0]) if len(parts) == 1 and len(initials) == 1 else None
    return ("alone" if len(parts) == 1 else "full"), parts, ""


def slip(a: str, b: str) -> bool:
    """Whether one typing slip turns ``a`` into ``b``."""
    return a != b and distance(a, b, RADIUS) <= RADIUS


def apart(a: str, b: str) -> bool:
    """Whether only the last vowel differs, as in the names of siblings."""
    return len(a) == len(b) and a != b and a[:-1] == b[:-1] and a[-1] in VOWELS and b[-1] in VOWELS


def shortened(word: str) -> list[str]:
    """Pet names: listed ones, and the name cut after its third letter or later."""
    return [*PET_NAMES.get(word, "").split(), *(word[:k] for k in range(3, len(word)))]


def pick_pivots(words: list[str]) -> list[str]:
    """Farthest first."""
    if not words:
        return [""]
    chosen = [words[0]]
    near = [distance(w, chosen[0], 99) for w in words]
    while len(chosen) < min(PIVOTS, len(words)) and max(near) > 0:
        far = words[near.index(max(near))]
        chosen.append(far)
        near = [min(d, distance(w, far, 99)) for d, w in zip(near, words, strict=True)]
    return chosen


def in_cells(df: DataFrame, word: str, pivots: list[str]) -> DataFrame:
    """``df`` of distinct words with ``home`` and ``cells``, the cells that may hold a neighbour."""
    at = df.columns.index(word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, cells = [], []
            for w in batch.column(at).to_pylist():
                far = [distance(w, p, 99) for p in pivots]
                least = min(far)
                home.append({"cell": far.index(least), "d": least})
                cells.append([{"cell": i, "d": d} for i, d in enumerate(far) if d <= least + 2 * RADIUS])
            spot = pa.struct([("cell", pa.int32()), ("d", pa.int32())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, spot), pa.array(cells, pa.list_(spot))], names=[*batch.schema.names, "home", "cells"])

    kinds = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, home struct<cell:int,d:int>, cells array<struct<cell:int,d:int>>")


def slips(observed: DataFrame, known: DataFrame) -> DataFrame:
    """``series``, ``word``, ``near`` one slip apart; ``observed`` and ``known`` hold series and word.

    An exact radius join: pairs meet once, in the home cell of ``near``, in one band.
    """
    distinct = observed.select("word").unionByName(known.select("word")).distinct()
    sample = distinct.orderBy(F.xxhash64("word"), "word").limit(PIVOT_SAMPLE).collect()
    pivots = pick_pivots([r.word for r in sample])
    spots = checkpointed(in_cells(spread(distinct, 1), "word", pivots))
    probe = observed.select("series", "word").distinct().join(spots.select("word", F.explode("cells").alias("c")), "word")
    probe = probe.select("series", "word", F.col("c.cell").alias("cell"), F.explode(F.sequence(F.col("c.d") - RADIUS, F.col("c.d") + RADIUS)).alias("band"))
    there = known.select("series", F.col("word").alias("near")).distinct().join(spots.select(F.col("word").alias("near"), "home"), "near")
    there = there.select("series", "near", F.col("home.cell").alias("cell"), F.col("home.d").alias("band"))
    met = probe.join(there, ["series", "cell", "band"]).where("word <> near").where(F.abs(F.length("word") - F.length("near")) <= RADIUS)
    # one swap is two plain edits, so the built-in distance drops nothing that the true one keeps
    met = met.where(F.levenshtein("word", "near", 2 * RADIUS) >= 0).select("series", "word", "near")
    pairs = spread(met.select("word", "near").distinct(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([slip(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.bool_())
            yield batch.filter(keep)

    return met.join(pairs.mapInArrow(run, "word string, near string"), ["word", "near"])


def parsed(spellings: DataFrame, bank: tuple[tuple[str, str | None], ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = bank_of(bank)
        for batch in batches:
            rows = []
            for series, spelling, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                made = None if terms.is_term(spelling) else parse(spelling)
                if made:
                    rows.append({"series": series, "spelling": spelling, "n": n, "shape": made[0], "words": made[1], "kind": made[2]})
            fields = [("series", pa.string()), ("spelling", pa.string()), ("n", pa.int64()), ("shape", pa.string()), ("words", pa.list_(pa.string())), ("kind", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    return spread(spellings, 1).mapInArrow(run, PARSED)


def _aliases(entities: DataFrame) -> DataFrame:
    """``series``, ``alias``, ``entity``: the shorter ways to write each entity.

    A full name gives `pet|other`, `i.|other` and each part alone; an organisation its bare words
    and its acronym.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"series": [], "alias": [], "entity": []}
            for series, entity, shape, words, kind in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if shape == "org":
                    made = {"o:" + " ".join(words), "c:" + "".join(w[0] for w in [*words, kind])}
                else:
                    made = set()
                    for i in range(len(words)):
                        own, others = words[i], " ".join(words[:i] + words[i + 1 :])
                        made |= {f"{x}|{others}" for x in shortened(own)} | {f"{own[0]}.|{others}", own, *shortened(own)}
                out["series"] += [series] * len(made)
                out["alias"] += sorted(made)
                out["entity"] += [entity] * len(made)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.string()) for k in out]))

    return entities.select("series", "entity", "shape", "words", "kind").mapInArrow(run, "series string, alias string, entity string")


def key(shape: str, words: list[str], kind: str) -> str:
    """The key of an entity: the words of a person in either order, those of an organisation in theirs."""
    return f"o:{' '.join(words)}|{kind}" if shape == "org" else "p:" + " ".join(sorted(words))


def _ways(entities: DataFrame) -> DataFrame:
    """``series``, ``entity``, ``how``, ``alias``: the keys and short forms that an entity may be a way to write.

    Each word stands as typed or as one of ``options``, the words one slip apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"series": [], "entity": [], "how": [], "alias": []}
            for series, entity, shape, words, kind, options in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                ways = set()
                for chosen in product(*([w, *(o or [])] for w, o in zip(words, options, strict=True))):
                    typed = list(chosen)
                    if shape == "full" and apart(typed[0], words[0]):
                        continue
                    ways.add(("slip", key(shape, typed, kind)))
                    if shape == "full":
                        ways.add(("short", "o:" + " ".join(typed)))
                        ways |= {("short", f"{w}|{' '.join(typed[:i] + typed[i + 1 :])}") for i, w in enumerate(typed)}
                for how, alias in sorted(ways):
                    if alias != entity:
                        for name, x in zip(out, (series, entity, how, alias), strict=True):
                            out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.string()) for k in out]))

    return entities.select("series", "entity", "shape", "words", "kind", "options").mapInArrow(run, "series string, entity string, how string, alias string")


def _only(candidates: DataFrame, *keys: str) -> DataFrame:
    """Keys whose candidates are one entity."""
    return candidates.groupBy(*keys).agg(F.min("entity").alias("entity"), F.max("entity").alias("_most")).where("entity = _most").drop("_most")


def _followed(hops: DataFrame) -> DataFrame:
    """``series``, ``short``, ``entity``: hops taken twice."""
    then = hops.select("series", F.col("short").alias("entity"), F.col("entity").alias("last"))
    return hops.join(then, ["series", "entity"], "left").select("series", "short", F.coalesce("last", "entity").alias("entity"))


def same_names(worksheet: DataFrame, bank: DataFrame, series: str = "series_id", speaker: str = "speaker", propose: str = "propose") -> DataFrame:
    """``series_id``, ``name_a``, ``name_b``: each pair of spellings of one entity, once."""
    rows = bank_rows(bank)
    spoken = worksheet.select(F.col(series).alias("series"), F.col(speaker).alias("speaker"), F.col(propose).alias("propose")).where("series is not null")
    one = spoken.where("speaker is not null").groupBy("series", "speaker").agg(F.count("*").alias("n"))
    one = one.select("series", trimmed(F.col("speaker")).alias("spelling"), "n").where("spelling <> ''")
    many = spoken.where("propose is not null").groupBy("series", "propose").agg(F.count("*").alias("n"))
    many = many.select("series", F.explode(entries(F.col("propose"))).alias("spelling"), "n")
    counted = one.unionByName(many).groupBy("series", "spelling").agg(F.sum("n").alias("n"))
    names = checkpointed(parsed(counted, rows))

    said = names.where("shape <> 'acronym'").select("series", F.explode("words").alias("word"), "shape")
    seen = said.where("length(word) > 2").groupBy("series", "word").agg(F.max((F.col("shape") == "full").cast("int")).alias("in_full"))
    whole_words = seen.where("in_full = 1").select("series", "word")
    cut = F.expr("transform(sequence(4, length(word) - 2), k -> substring(word, 1, k))")
    pets = whole_words.where("length(word) >= 6").select("series", F.explode(cut).alias("word"))
    listed = pet_names()
    pets = pets.unionByName(whole_words.select("series", F.explode(F.split(F.element_at(listed, F.col("word")), " ")).alias("word")))
    near = checkpointed(slips(seen.select("series", "word"), seen.select("series", "word").unionByName(pets).distinct()))
    options = near.groupBy("series", "word").agg(F.sort_array(F.collect_list("near")).alias("near"))

    org = F.concat(F.lit("o:"), F.array_join("words", " "), F.lit("|"), F.col("kind"))
    person = F.concat(F.lit("p:"), F.array_join(F.sort_array("words"), " "))
    whole = names.where("shape in ('full', 'org')").withColumn("entity", F.when(F.col("shape") == "org", org).otherwise(person))
    entities = whole.groupBy("series", "entity").agg(F.first("shape").alias("shape"), F.max_by("words", F.struct("n", "words")).alias("words"), F.first("kind").alias("kind"), F.sum("n").alias("n"))
    entities = checkpointed(entities)
    each = entities.select("series", "entity", F.posexplode("words").alias("at", "word")).join(options, ["series", "word"], "left")
    each = each.groupBy("series", "entity").agg(F.expr("transform(array_sort(collect_list(struct(at, near))), x -> x.near)").alias("options"))
    ways = checkpointed(_ways(entities.join(each, ["series", "entity"])))
    alias = checkpointed(_aliases(entities))

    # a slip goes to the most frequent of the names it may be meant for, a short form only to the one that it fits
    sizes = entities.select("series", "entity", "n")
    typed = ways.where("how = 'slip'").select("series", F.col("entity").alias("short"), F.col("alias").alias("entity")).join(sizes, ["series", "entity"])
    typed = typed.join(sizes.select("series", F.col("entity").alias("short"), F.col("n").alias("own")), ["series", "short"]).where("n > own or n = own and entity < short")
    slip_hops = typed.groupBy("series", "short").agg(F.max_by("entity", F.struct("n", "entity")).alias("entity"))
    slip_roots = checkpointed(_followed(slip_hops))
    rooted = alias.join(slip_roots.withColumnsRenamed({"entity": "root", "short": "entity"}), ["series", "entity"], "left")
    rooted = checkpointed(rooted.select("series", "alias", F.coalesce("root", "entity").alias("entity")).distinct())
    brief = ways.where("how = 'short'").select("series", F.col("entity").alias("short"), "alias").join(rooted, ["series", "alias"])
    brief = brief.join(slip_roots.select("series", "short", F.col("entity").alias("own")), ["series", "short"], "left")
    brief = brief.withColumn("short", F.coalesce("own", "short")).where("short <> entity").select("series", "short", "entity")
    short_roots = checkpointed(_followed(_only(brief, "series", "short")))

    def settled(df: DataFrame) -> DataFrame:
        for roots in (slip_roots, short_roots):
            df = df.join(roots.withColumnsRenamed({"entity": "root", "short": "entity"}), ["series", "entity"], "left")
            df = df.withColumn("entity", F.coalesce("root", "entity")).drop("root")
        return df

    final = settled(alias).distinct()
    lone = names.where("shape = 'alone'").select("series", "spelling", F.lit("").alias("before"), F.get("words", F.lit(0)).alias("word"))
    initial = names.where("shape = 'initial'").select("series", "spelling", F.concat(F.col("kind"), F.lit(".|")).alias("before"), F.get("words", F.lit(0)).alias("word"))
    acronym = names.where("shape = 'acronym'").select("series", "spelling", F.lit("c:").alias("before"), F.get("words", F.lit(0)).alias("word"))
    brief = checkpointed(lone.unionByName(initial).unionByName(acronym))
    exact = brief.select("series", "spelling", F.concat("before", "word").alias("alias"), F.lit(0).alias("slips"))
    close = brief.where("before <> 'c:'").join(near, ["series", "word"]).where(~_apart("word", "near")).select("series", "spelling", F.concat("before", "near").alias("alias"), F.lit(1).alias("slips"))
    fits = exact.unionByName(close).join(final, ["series", "alias"]).groupBy("series", "spelling", "slips").agg(F.collect_set("entity").alias("fits"))
    best = fits.groupBy("series", "spelling").agg(F.min_by("fits", "slips").alias("fits")).where("size(fits) = 1")
    members = settled(whole.select("series", "spelling", "entity")).unionByName(best.select("series", "spelling", F.get("fits", F.lit(0)).alias("entity")))
    members = checkpointed(members)
    a, b = (members.select("series", "entity", F.col("spelling").alias(f"name_{x}")) for x in "ab")
    return a.join(b, ["series", "entity"]).where("name_a < name_b").select(F.col("series").alias("series_id"), "name_a", "name_b")


def _apart(a: str, b: str) -> Column:
    """``apart`` as a column."""
    same = F.expr(f"length({a}) = length({b}) and left({a}, length({a}) - 1) = left({b}, length({b}) - 1)")
    vowels = sorted(VOWELS)
    return same & F.right(a, F.lit(1)).isin(vowels) & F.right(b, F.lit(1)).isin(vowels)


def pet_names() -> Column:
    """The listed pet names as a map column."""
    return F.create_map(*(F.lit(x) for pair in PET_NAMES.items() for x in pair))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\A[\\s\\p{Z}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]++|[\\s\\p{Z}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]++\\z", "")
