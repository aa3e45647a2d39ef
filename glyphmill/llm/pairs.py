"""Defective pairs of a prompt and its response.

`copy` is measured on a suffix automaton of the prompt that the response is run through; `refusal`
by an automaton of declining and task phrases, both of which one sentence must hold; the language
by script shares and votes of stop words and letters; `truncated` by a stack of delimiters, the
number of sentences and the way sentences of the whole corpus end: a response without a last mark
is sound only if its last two words end sentences elsewhere. The first defect in the order empty,
copy, refusal, other_language, truncated is kept.

Defined results: a null response is empty; a null prompt, or one without letter or digit, makes no
pair; a prompt without a last mark asks for none; repeated rows are judged one by one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.session import checkpointed, spread

#: A prompt counts as copied from this share of its letters and digits on.
COPIED = 0.9
#: Matches shorter than this many characters are chance, unless the prompt itself is as short.
SHORTEST_MATCH = 4
#: Votes that another language of the Arabic script needs; an interjection has fewer.
LEAST_VOTES = 1.5
#: Salts of the final join: the words at the end of a common remark may be those of a third of all rows.
SALTS = 16

# Phrases by which a model declines, and what it declines, as typed after folding.
DECLINE = """
can't|cannot|can not|could not|couldn't|unable|not able|won't|will not|decline|refuse|not allowed|not permitted
|must not|falls outside|outside what i|against my|sorry|apologi|inappropriate|not comfortable
|نمی توانم|نمیتوانم|نمی توانیم|معذورم|معذوریم|خودداری|مجاز نیست|مجاز نیستم|اجازه ندارم|خارج است|برنمی گردانم|انجام نمی دهم|وجود ندارد|سازگار نیست|متاسف|پوزش|امتناع|قادر نیستم|قادر به|ممکن نیست
|لا استطیع|لا یمکننی|اعتذر|عذرا|غیر قادر|ارفض|لا یسمح
|kann nicht|nicht möglich|leider|ablehnen|darf nicht|nicht in der lage
|yapamam|edemem|çeviremem|üzgünüm|reddet|mümkün değil
|ne peux pas|ne puis|désolé|refuse|impossible de|no puedo|lo siento|rechazo
|できません|致しかねます|いたしかねます|申し訳|お断り|お応えできません|対応できない
|할 수 없|죄송|거절|도와드릴 수|불가능합니다
|无法|抱歉|不能|拒绝|對不起|对不起|無法
"""
TASK = """
translat|this line|another line|render|passage|the text|this text|this request|that request|your request|the content|this content|language model|an assistant|an ai
|ترجمه|این متن|این عبارت|این بخش|این درخواست|درخواست دیگری|این محتوا|این جمله را|دیالوگ|مدل زبانی|یک دستیار|هوش مصنوعی
|ترجم|هذا النص|هذا الطلب|المحتوی|نموذج لغوی
|übersetz|diesen text|diese anfrage|sprachmodell|diesen inhalt
|çevir|bu metni|bu isteği|dil modeli|bu içeriği
|tradui|traduct|ce texte|cette demande|modèle de langue|traducir|este texto|esta solicitud|modelo de lenguaje
|翻訳|この文章|このテキスト|このリクエスト|言語モデル|この内容
|번역|이 텍스트|이 요청|언어 모델|이 내용|이 문장
|翻译|翻譯|这段文字|该请求|这个请求|语言模型|此内容
"""
STOP_WORDS = {
    "fa": "را که از به در با تا این آن است بود شد می نمی ها های برای یک هم ولی اگر من تو ما شما او چه چرا هیچ دیگر پس کن نه کرد",
    "ar": "فی من علی الی ان أن هل ما لا لم لن قد لقد هذا هذه ذلک تلک الذی التی کان کانت حین بعد قبل عند کل ثم أین إلی إن لیس بین عن",
    "ur": "ہے ہیں کا کے میں نے سے کو اور یہ وہ تھا تھی نہیں",
}

FOLD = {"ي": "ی", "ى": "ی", "ك": "ک"}
MARKS = ".!?؟。！？．｡۔"
CUT_OFF = "—–-…‥"
SENTENCE = re.compile(f"(?<!\\.)(?:[{re.escape(MARKS)}](?!\\.))+|\\.{{4,}}")
#: What may stand after the last mark: closing quotes and brackets, white space, characters that do not show.
WRAPPED = "\"'»«”“’‘)）]」』】*_~ \t\n\r\u3000\u00a0\u202f\u2007\u00ad\ufeff" + "".join(map(chr, [*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070)]))
WORDS = re.compile(r"[^\W\d_]+")
#: Letters and an article that Persian does without.
FOREIGN = re.compile(r"[أإؤةىٹڈڑںےہھ]|ال\w\w\w")
SHOWN = re.compile(r"[^\W_]")
NOT_BARE = re.compile(r"[\W_]+")
LETTERS = re.compile(r"[^\W\d_]")
OWN_LETTERS = re.compile("[\u0621-\u064a\u066e-\u06d3\u06d5\u06ee-\u06ef\u06fa-\u06ff]")
CLAUSE = re.compile(f"[{re.escape(MARKS)}\n]+(?=\\s|$)|[。！？]+")
DELIMITERS = re.compile("[\\[({})\\]«»“”「」『』【】（）]")
PAIRS = dict(zip("([{«“「『【（", ")]}»”」』】）", strict=True))


FIGURES = re.compile(r"\d+")
WORD_OR_END = re.compile(f"[{re.escape(MARKS)}]+|(?:[^\\W\\d_]|#)+")


class Suffixes:
    """Suffix automaton of a text; each state knows where its strings first end."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for at, ch in enumerate(text):
            cur = self._state(self.length[last] + 1, {}, at)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            elif self.length[q := self.next[p][ch]] == self.length[p] + 1:
                self.link[cur] = q
            else:
                twin = self._state(self.length[p] + 1, dict(self.next[q]), self.end[q])
                self.link[twin] = self.link[q]
                while p >= 0 and self.next[p].get(ch) == q:
                    self.next[p][ch] = twin
                    p = self.link[p]
                self.link[q] = self.link[cur] = twin
            last = cur

    def _state(self, length: int, following: dict[str, int], end: int) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def matches(self, text: str) -> Iterator[tuple[int, int]]:
        """Start and end in the automaton's text of each longest match that cannot be extended."""
        state = long = 0
        for ch in text:
            if ch not in self.next[state]:
                if long:
                    yield self.end[state] + 1 - long, self.end[state] + 1
                while state and ch not in self.next[state]:
                    state = self.link[state]
                long = self.length[state] if state else 0
            if ch in self.next[state]:
                state, long = self.next[state][ch], long + 1
        if long:
            yield self.end[state] + 1 - long, self.end[state] + 1


def composed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def share_copied(prompt: str, response: str) -> float:
    """``copied`` of the letters and digits alone, of texts in one width and case."""
    if not any(map(str.isalnum, set(prompt) & set(response))):
        return 0.0
    return copied(NOT_BARE.sub("", prompt), NOT_BARE.sub("", response))


def copied(prompt: str, response: str) -> float:
    """Share of the bare prompt that stands in the bare response."""
    if not prompt:
        return 0.0
    if prompt in response:
        return 1.0
    there = set(response)
    if there.isdisjoint(prompt) or sum(map(there.__contains__, prompt)) < COPIED * len(prompt):
        return 0.0  # no match can cover more than the characters that occur at all
    shortest = min(SHORTEST_MATCH, len(prompt))
    covered = bytearray(len(prompt))
    for a, b in Suffixes(prompt).matches(response):
        if b - a >= shortest:
            covered[a:b] = b"\1" * (b - a)
    return sum(covered) / len(prompt)


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for bit, phrases in ((1, DECLINE), (2, TASK)):
        for phrase in phrases.split("|"):
            if phrase.strip():
                found.add_word(phrase.strip(), bit)
    found.make_automaton()
    return found


SPACES = re.compile("[ \\t\\r\u200c]+")
UNSEEN = re.compile("[\u00ad\u0640\u200b\u200d-\u200f\u2060\ufeff\u064b-\u0652]+")


def one_set(text: str) -> str:
    """Arabic yeh and kaf as the Persian ones; a few replacements are faster than a table."""
    for old, new in FOLD.items():
        text = text.replace(old, new)
    return text


def folded(text: str) -> str:
    """In one case, width and set of letters; line ends stay."""
    if text.isascii():
        return text.lower()
    form = one_set(composed(text).casefold()).replace("أ", "ا").replace("إ", "ا").replace("’", "'")
    return SPACES.sub(" ", UNSEEN.sub("", form))


class Judge:
    def __init__(self):
        self.phrases = _automaton()
        self.votes = {w: lang for lang, words in STOP_WORDS.items() for w in words.translate(str.maketrans(FOLD)).split()}
        shared = [w for w in self.votes if sum(w in x.translate(str.maketrans(FOLD)).split() for x in STOP_WORDS.values()) > 1]
        for w in shared:
            del self.votes[w]
        self.foreign = {w for w, lang in self.votes.items() if lang != "fa"}
        self.declines = lru_cache(20_000)(self._declines)

    def _declines(self, text: str) -> bool:
        """Whether some sentence declines a task of translating."""
        whole = folded(text)
        return self._bits(whole) == 3 and any(self._bits(s) == 3 for s in CLAUSE.split(whole))

    def _bits(self, text: str) -> int:
        """1 for a phrase that declines, 2 for one of a task, 3 for both."""
        bits = 0
        for _, bit in self.phrases.iter(text):
            bits |= bit
        return bits

    def persian(self, text: str) -> bool:
        form = composed(text)
        letters = len(LETTERS.findall(form))
        if not letters:
            return True  # figures alone belong to no language
        if len(OWN_LETTERS.findall(form)) * 2 < letters:
            return False
        plain = one_set(form)
        words = WORDS.findall(plain)
        if self.foreign.isdisjoint(words) and not FOREIGN.search(form):
            return True  # nothing speaks for another language
        score = dict.fromkeys(STOP_WORDS, 0.0)
        score["fa"] += 0.5 * len(re.findall("[پچژگ]|‌", form))
        score["ar"] += 0.5 * len(re.findall("[أإؤةى]", form))
        score["ur"] += 1.0 * len(re.findall("[ٹڈڑںےہھ]", form))
        for word in words:
            if lang := self.votes.get(word):
                score[lang] += 1
            elif len(word) > 4 and word.startswith(("ال", "وال", "بال")):
                score["ar"] += 0.5
        other = max(score["ar"], score["ur"])
        return other < LEAST_VOTES or score["fa"] >= other

    def open_end(self, text: str) -> bool:
        """Whether a bracket or quote is still open at the end."""
        stack = []
        for c in DELIMITERS.findall(text):
            if c in PAIRS:
                stack.append(PAIRS[c])
            elif stack and c == stack[-1]:
                stack.pop()
        return bool(stack) or text.count('"') % 2 == 1

    def defect(self, prompt: str, response: str | None, ends: bool) -> str | None:
        """``ends``: whether the corpus says that the response's last words can end a sentence."""
        if not response or not SHOWN.search(response):
            return "empty"
        asked, given = composed(prompt), composed(response)
        if share_copied(asked.casefold(), given.casefold()) >= COPIED:
            return "copy"
        if self.declines(given) and not self.declines(asked):
            return "refusal"
        if not self.persian(given):
            return "other_language"
        return "truncated" if self._cut(asked, given, ends) else None

    def _cut(self, asked: str, given: str, ends: bool) -> bool:
        parts = [SHOWN.search(part) is not None for part in SENTENCE.split(given)]
        wanted = sentences(asked)
        if sum(parts) < wanted:
            return True
        if sum(parts[:-1]) >= wanted:
            return False  # all of the prompt is rendered; what follows was added
        if self.open_end(given) and not self.open_end(asked):
            return True
        a, b = last(asked), last(given)
        if a in CUT_OFF or b in MARKS:
            return False
        if a not in MARKS and b not in CUT_OFF + "،,;؛:":
            return False
        return b in CUT_OFF + "،,;؛:" or not ends


def sentences(text: str) -> int:
    return sum(SHOWN.search(part) is not None for part in SENTENCE.split(text))


def last(text: str) -> str:
    """The last character that shows, outside closing quotes; an ellipsis counts as one."""
    shown = text.rstrip(WRAPPED)
    return "…" if shown.endswith("..") else shown[-1:] or " "


def ending_words(text: str) -> list[str]:
    """Words with figures as #, and ¶ at the start and wherever a sentence ends."""
    form = UNSEEN.sub("", one_set(composed(text).casefold())).replace("\u200c", "")
    form = WORD_OR_END.findall(FIGURES.sub("#", form))
    return ["¶", *("¶" if w[0] in MARKS else w for w in form)]


def _count_endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: words and pairs of neighbouring words, how often, and how often a sentence ends after them."""
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            w = ending_words(text)
            seen.update(zip(w, w[1:], [x == "¶" for x in w[2:]]))
        keys: dict[str, list[int]] = {}
        for (a, b, end), n in seen.items():
            for k in ((b,) if a == "¶" else (b, f"{a} {b}")) if b != "¶" else ():
                total = keys.setdefault(k, [0, 0])
                total[0] += n
                total[1] += n * end
        columns = [pa.array(keys.keys(), pa.string()), *(pa.array([v[i] for v in keys.values()], pa.int64()) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "n", "ends"])


def _last_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tails = [ending_words(t)[-2:] for t in batch.column(2).to_pylist()]
        two = pa.array([" ".join(t) for t in tails], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, two, pa.array([t[-1] for t in tails], pa.string())], names=[*batch.schema.names, "two", "one"])


def broken_pairs(df: DataFrame, key: str, prompt: str, response: str) -> DataFrame:
    """``key`` and ``defect`` of every row whose response is defective."""
    pairs = df.select(F.col(key).alias("key"), F.col(prompt).alias("prompt"), F.col(response).alias("response"))
    pairs = pairs.where(F.col("prompt").rlike(r"[\p{L}\p{N}]"))
    closed = F.col("response").rlike(f"[{re.escape(MARKS)}][^\\p{{L}}\\p{{N}}]*$") | ~F.coalesce(F.col("response"), F.lit("")).rlike(r"[\p{L}\p{N}]")
    closed = F.coalesce(closed, F.lit(True))
    said = spread(pairs.where("response is not null").select("response"), 1)
    known = said.mapInArrow(_count_endings, "k string, n bigint, ends bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    known = checkpointed(known)  # it is joined twice

    kind = dict(pairs.dtypes)["key"]
    unmarked = pairs.where(~closed).mapInArrow(_last_words, f"key {kind}, prompt string, response string, two string, one string")
    wanted = unmarked.select("two", "one").distinct()
    verdict = (
        wanted.join(known.select(F.col("k").alias("two"), F.col("n").alias("n2"), F.col("ends").alias("e2")), "two", "left")
        .join(known.select(F.col("k").alias("one"), F.col("n").alias("n1"), F.col("ends").alias("e1")), "one", "left")
        .select("two", "one", F.when(F.col("n2") >= 3, F.col("e2") * 2 >= F.col("n2")).otherwise(F.coalesce(F.col("e1") * 2 >= F.col("n1"), F.lit(False))).alias("ends"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = unmarked.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    told = salted.join(verdict, ["two", "one", "salt"]).select("key", "prompt", "response", "ends")
    rows = spread(pairs.where(closed).withColumn("ends", F.lit(True)), 1).unionByName(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for batch in batches:
            asked, given, ends = (batch.column(i).to_pylist() for i in (1, 2, 3))
            made = [judge.defect(*x) for x in zip(asked, given, ends, strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[key, "defect"])
            yield out.filter(out.column(1).is_valid())

    return rows.mapInArrow(run, f"{key} {kind}, defect string")
