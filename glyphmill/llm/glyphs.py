"""One form for texts that show the same glyphs, and the records that then agree.

The form keeps what is seen: case, punctuation, accents, digits, joining and spacing. It folds
width, ready-shaped Arabic letters, Kangxi radicals, ligatures, composed and decomposed accents,
look-alike letters of other scripts and space characters of other widths, and drops what shows
nothing. A non-joiner shows only between two letters that would join; Arabic yeh and kaf are read
and shown as the Persian ones; Arabic digits 4, 5 and 6 show as themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.session import checkpointed

#: Salts of the joins of spellings to their records.
SALTS = 8
BREAK = "\u200c"
KEPT = "\ue000"
RIGHT = "\u0622-\u0625\u0627\u0629\u062f-\u0632\u0648\u0671-\u0673\u0675-\u0677\u0688-\u0699\u06c0\u06c3-\u06cb\u06cd\u06cf\u06d2\u06d3\u06d5\u06ee\u06ef"
DUAL = "\u0620\u0626\u0628\u062a-\u062e\u0633-\u0647\u0649\u064a\u066e\u066f\u0678-\u0687\u069a-\u06bf\u06c1\u06c2\u06cc\u06ce\u06d0\u06d1\u06fa-\u06fc\u06ff"
MARK = "\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e4\u06e7\u06e8\u06ea-\u06ed"
SEEN_BREAK = re.compile(f"([{DUAL}][{MARK}]*){BREAK}+(?=[{MARK}]*[{DUAL}{RIGHT}])")
LAST_ALEF_MAKSURA = re.compile(f"\u0649(?![{MARK}]*[{DUAL}{RIGHT}])")
#: Letters of other scripts that show as a Latin one, and kana and Han that show as one another.
LOOK_ALIKE = dict(
    zip(
        "\u0410\u0412\u0415\u041a\u041c\u041d\u041e\u0420\u0421\u0422\u0425\u0423\u0405\u0406\u0408\u050c\u051a\u051c\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0455\u0456\u0458\u04bb\u0501\u051b\u051d" + "\u0391\u0392\u0395\u0396\u0397\u0399\u039a\u039c\u039d\u039f\u03a1\u03a4\u03a5\u03a7\u03bf\u03f2\u03f3" + "\u3078\u3079\u307a\u529b\u53e3\u5de5\u4e8c\u516b\u5915\u535c\u4e00",
        "ABEKMHOPCTXYSIJGQWaeopcyxsijhdqw" + "ABEZHIKMNOPTYXocj" + "\u30d8\u30d9\u30da\u30ab\u30ed\u30a8\u30cb\u30cf\u30bf\u30c8\u30fc",
        strict=True,
    )
)
SHOWN = re.compile(r"[^\W_]")
SHAPES = {"<isolated>": (BREAK, BREAK), "<final>": ("", BREAK), "<initial>": (BREAK, ""), "<medial>": ("", "")}


def _unfolded(ch: str) -> str | None:
    """What ``ch`` shows as in other characters; None if it shows as itself only."""
    code, kind = ord(ch), unicodedata.category(ch)
    if ch in LOOK_ALIKE:
        return LOOK_ALIKE[ch]
    if ch in "\u2066\u2067\u2068\u2069":  # they show nothing, but letters do not join across
        return BREAK
    if ch == BREAK:
        return None
    if kind == "Cf" and not 0x600 <= code <= 0x605 or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x34F, 0x115F, 0x1160, 0x3164):
        return ""
    if kind == "Zs" or ch == "\t":
        return " "
    if ch in "\u2028\u2029\x85":
        return "\n"
    if ch in "\u2010\u2011":
        return "-"
    if 0x660 <= code <= 0x669 and ch not in "\u0664\u0665\u0666":
        return chr(code + 0x90)
    if ch == "\u06c0":
        return "\u0647\u0654" + BREAK
    if ch == "\u06d5":
        return "\u0647" + BREAK
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag not in ("<wide>", "<narrow>", "<compat>", *SHAPES) or not rest:
        return None
    shown = "".join(chr(int(x, 16)) for x in rest.split())
    if tag == "<compat>" and (" " in shown or 0x3131 <= code <= 0x318E or 0x3200 <= code <= 0x33FF or 0x3D0 <= code <= 0x3FF or ch in "\u017f\u2116\xb5"):
        return None
    shown = "".join(LOOK_ALIKE.get(x, x) for x in shown)
    before, after = SHAPES.get(tag, ("", ""))
    return before + shown + after


class _Table(dict):
    def __missing__(self, code: int) -> str:
        shown = _unfolded(chr(code))
        self[code] = chr(code) if shown is None else shown
        return self[code]


_table = _Table()


@lru_cache(1)
def _folded_ones() -> re.Pattern[str]:
    """Characters beyond ASCII that show as others; all beyond the first plane are looked up one by one."""
    codes = [c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and _unfolded(chr(c)) is not None]
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    ranges = "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))
    return re.compile(f"[\t{ranges}\U00010000-\U0010ffff]")



def glyph_form(text: str | None) -> str | None:
    """The one form of ``text``; None when it holds no letter or digit."""
    if text is None:
        return None
    form = text.replace("\r\n", "\n").replace("\r", "\n")
    if not form.isascii() or "\t" in form:
        # composed first, since an accent belongs to the letter as it was typed; again after folding
        form = unicodedata.normalize("NFC", form)
        if _folded_ones().search(form):
            form = unicodedata.normalize("NFC", form.translate(_table))
        if not form.isascii():
            form = SEEN_BREAK.sub(f"\\1{KEPT}", form).replace(BREAK, "")
            form = form.replace("\u064a", "\u06cc").replace("\u0643", "\u06a9")
            form = LAST_ALEF_MAKSURA.sub("\u06cc", form).replace(KEPT, BREAK)
            form = form.replace("\u06cc\u0654", "\u0626")
    form = form.strip()
    return form if SHOWN.search(form) else None


def with_form(df: DataFrame, text: str, form: str = "form") -> DataFrame:
    """``df`` with the form of its column ``text``."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([glyph_form(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, form])

    return df.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in [*df.dtypes, (form, "string")]))


def same_glyphs(regions: DataFrame, cases: DataFrame) -> DataFrame:
    """``field``, ``key_a``, ``key_b`` of records that look the same and are stored differently.

    The form is made once per distinct text. Only forms with several spellings are joined, spelling
    to other spelling first, so that equal texts never meet; then each side to its records, salted,
    since one spelling may be that of a third of all records.
    """
    parts = [regions.select(F.lit(x).alias("field"), F.col("region_key").alias("key"), F.col(x).alias("text")) for x in ("source_text", "target_text")]
    parts.append(cases.select(F.lit("accept").alias("field"), F.col("case_no").alias("key"), F.explode("accept").alias("text")).distinct())
    texts = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("text is not null")
    spelt = with_form(texts.select("field", "text").distinct(), "text").where("form is not null")
    several = spelt.groupBy("field", "form").agg(F.count("*").alias("n")).where("n > 1").select("field", "form")
    spelt = checkpointed(spelt.join(several, ["field", "form"]))
    a, b = (spelt.select("field", "form", F.col("text").alias(f"text_{x}")) for x in "ab")
    other = a.join(b, ["field", "form"]).where("text_a <> text_b").select("field", "text_a", "text_b")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    held = texts.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    left = held.select("field", F.col("key").alias("key_a"), F.col("text").alias("text_a"), "salt").join(other.withColumn("salt", salts), ["field", "text_a", "salt"])
    left = left.select("field", "key_a", "text_b").withColumn("salt", salts)
    pairs = left.join(held.select("field", F.col("key").alias("key_b"), F.col("text").alias("text_b"), "salt"), ["field", "text_b", "salt"])
    pairs = pairs.where("key_a < key_b").select("field", "key_a", "key_b")
    accept = pairs.where("field = 'accept'").distinct()
    return pairs.where("field <> 'accept'").unionByName(accept)
