"""Quality rules by distribution divergence.

The character-class histogram and the common-word histogram of a document are compared
with those of the languages by the Jensen-Shannon distance (base 2, from 0 to 1). The
language references are counted over all documents with a language. A document fails
if even the nearest language is further away than a limit; each comparison is made only
from a minimum length on, as short texts are far from any histogram by chance.

Plain base rules come first: too few words, or too many words in repeated windows.

Defined cases: a null text has no words and fails the base rule; documents of null
language are judged but don't count for a reference; without any reference nothing is
compared; repeated rows get equal answers; an empty table gives an empty table; other
columns are not looked at. A word may hold any byte but blanks, null bytes too. A very long text is counted whole. Ties: words of equal count
are common in order of their bytes; a distance equal to its limit passes.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careweave.llm import common as shared

#: Common words of each language in its reference.
TOP_WORDS = 120
#: Largest distance from the nearest language, and least length for the comparison.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.30, 200
MAX_WORD_DISTANCE, MIN_WORDS = 0.53, 60
MIN_WORD_COUNT, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
_SYMBOLS = "#*$%&|<>"
#: Classes: other, upper case, lower case, digit, symbol, exclamation or question mark,
#: other punctuation, blank, lead byte of a character beyond ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[list(b"#*$%&|<>{}[]\\^~=@_`/+")] = 4
_CLASS[list(b"!?")] = 5
_CLASS[list(b".,;:'\"()-")] = 6
_CLASS[list(b" \t\n\x0b\x0c\r")] = 7
_CLASS[192:] = 8
CLASSES = 9
_PUNCTUATION = bytes(b".,;:!?\"'()")
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def char_classes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    counts = np.bincount(_CLASS[b], minlength=CLASSES)
    counts[0] -= int(((b >= 128) & (b < 192)).sum())  # later bytes of a character
    return counts


def common_form(word: bytes) -> bytes:
    return word.strip(_PUNCTUATION).lower()


def base_counts(data: bytes, words: list[bytes]) -> tuple[int, ...]:
    """_BASE for a text: counts of words, of their characters, of symbols, of lines that
    equal an earlier one, of words in 8-word windows that occur twice or more."""
    letters = b"".join(words)
    chars = len(letters) - int(((b := np.frombuffer(letters, np.uint8)) >= 128).sum() - (b >= 192).sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, sum(data.count(s.encode()) for s in _SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    if len(number) == len(words):
        return 0
    # names of windows of 2, 4 and 8 words, exact at each step
    length = 1
    while length < window:
        pair = ids[:-length] * np.uint64(ids.max() + np.uint64(1)) + ids[length:]
        kinds, ids = np.unique(pair, return_inverse=True)
        ids, length = ids.astype(np.uint64), 2 * length
        if len(kinds) == len(pair):
            return 0
    often = np.bincount(ids.astype(np.int64))[ids.astype(np.int64)] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(often)] += often
    edge[window : window + len(often)] -= often
    return int((np.cumsum(edge)[:-1] > 0).sum())


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` and each row of ``q``."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.maximum(terms.sum(2) / 2, 0))


def _normal(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(-1, keepdims=True), 1)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP_WORDS) -> dict | None:
    """Histograms of the languages, counted over all documents: for each language its
    character classes, its ``top`` words with counts, and the count of its other words."""
    shared.small_batches(docs.sparkSession)
    # a line counts a word, or a class (and no word); class -1 stands for all words
    kind = "lang string, class int, word binary, n long"
    schema = pa.schema([("lang", pa.string()), ("class", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])

    def lines(lang: str, words: list[tuple[bytes, int]], classes: Iterable[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        items = [(None, w, n) for w, n in words] + [(k, None, int(n)) for k, n in classes]
        for i in range(0, len(items), 50_000):
            c, w, n = zip(*items[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(n), "class": c, "word": w, "n": n}, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Counter, np.ndarray]] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = t.as_buffer().to_pybytes()
                words, classes = held.setdefault(lang, (Counter(), np.zeros(CLASSES, np.int64)))
                words.update(data.split())
                classes += char_classes(data)
            if sum(len(words) for words, _ in held.values()) > 200_000:
                yield from flush(held)
        yield from flush(held)

    def flush(held: dict[str, tuple[Counter, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (raw, classes) in held.items():
            c: Counter = Counter()
            for w, n in raw.items():
                c[common_form(w)] += n
            yield from lines(lang, list(c.items()), ((k, n) for k, n in enumerate(classes) if n))
        held.clear()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ``top`` words of a part, the count of all its words, its classes."""
        words: dict[str, list[tuple[int, bytes]]] = {}
        sums: dict[str, Counter] = {}
        for b in batches:
            for lang, k, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums.setdefault(lang, Counter())[-1 if k is None else k] += n
                if w:  # a word of punctuation alone has no common form
                    mine = words.setdefault(lang, [])
                    mine.append((-n, w))
                    if len(mine) > 64 * top:
                        mine[:] = heapq.nsmallest(top, mine)
        for lang, c in sums.items():
            yield from lines(lang, [(w, -n) for n, w in heapq.nsmallest(top, words.get(lang, []))], c.items())

    rows = docs.where(f"{lang_col} IS NOT NULL AND {text_col} IS NOT NULL").select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    words = rows.mapInArrow(count, kind).groupBy("lang", "class", "word").agg(F.sum("n").alias("n"))
    # the vocabulary isn't sorted: each task passes on its top words, and 64 parts of these theirs
    found = words.select("lang", "class", "word", "n").mapInArrow(best, kind)
    part = F.pmod(F.hash("word"), F.lit(64))
    common = found.where("word IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("lang", part).orderBy(F.desc("n"), "word"))).where(F.col("nth") <= top).drop("nth")
    sums = found.where("word IS NULL").groupBy("lang", "class", "word").agg(F.sum("n").alias("n"))
    out: dict = {}
    for r in common.union(sums).collect():  # at most 64 * ``top`` + 10 lines for each language
        x = out.setdefault(r["lang"], {"classes": np.zeros(CLASSES), "words": [], "total": 0})
        if r["word"] is not None:
            x["words"].append((bytes(r["word"]), r["n"]))
        elif r["class"] < 0:
            x["total"] = r["n"]
        else:
            x["classes"][r["class"]] = r["n"]
    for x in out.values():
        x["words"] = sorted(x["words"], key=lambda w: (-w[1], w[0]))[:top]
    return out or None


class _Judge:
    def __init__(self, refs: dict) -> None:
        langs = sorted(refs)
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for lang in langs for w, _ in refs[lang]["words"]))}
        self.classes = _normal(np.stack([refs[lang]["classes"] for lang in langs]))
        words = np.zeros((len(langs), len(self.number) + 1))
        for k, lang in enumerate(langs):
            for w, n in refs[lang]["words"]:
                words[k, self.number[w]] = n
            words[k, -1] = refs[lang]["total"] - words[k].sum()
        self.words = _normal(words)

    def histogram(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(self.number) + 1)
        for w, n in Counter(words).items():
            out[self.number.get(common_form(w), -1)] += n
        return out


def judge(docs: DataFrame, refs: dict | None, id_col: str = "doc_id", text_col: str = "text", max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """(id, base counts, base_failed, kept, char_distance, word_distance) of every row.
    A distance is null where its guard forbids the comparison."""
    shared.small_batches(docs.sparkSession)
    judge_ = docs.sparkSession.sparkContext.broadcast(_Judge(refs) if refs else None)
    names = ["id", *_BASE, "base_failed", "kept", "char_distance", "word_distance"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = judge_.value
        for b in batches:
            base, chars, common = [], [], []
            for t in b.column(1):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                words = data.split()
                base.append(base_counts(data, words))
                if j:
                    chars.append(char_classes(data))
                    common.append(j.histogram(words))
            counts = np.array(base, np.int64).reshape(b.num_rows, len(_BASE))
            far_char = far_word = np.full(b.num_rows, np.nan)
            if j and b.num_rows:
                far_char = np.where(np.sum(chars, 1) >= MIN_CHARS, distance(_normal(np.array(chars, float)), j.classes).min(1), np.nan)
                far_word = np.concatenate([distance(_normal(np.array(common[i : i + 256])), j.words).min(1) for i in range(0, len(common), 256)])
                far_word = np.where(counts[:, 0] >= MIN_WORDS, far_word, np.nan)
            failed = (counts[:, 0] < MIN_WORD_COUNT) | (100 * counts[:, 4] > MAX_REPEATED_PERCENT * counts[:, 0])
            kept = ~failed & ~(far_char > max_char) & ~(far_word > max_word)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, k]) for k in range(len(_BASE))), pa.array(failed), pa.array(kept), pa.array(far_char, from_pandas=True), pa.array(far_word, from_pandas=True)], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kinds = f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{k} long" for k in _BASE) + ", base_failed boolean, kept boolean, char_distance double, word_distance double"
    return rows.mapInArrow(answer, kinds).withColumnRenamed("id", id_col)
