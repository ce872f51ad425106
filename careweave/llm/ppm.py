"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of variable order (up to three bytes of context)
is counted once and then frozen. The code length of a byte is that of PPM with escape
method D: in the longest context of the tree that ends at the byte, a symbol seen c of
n times with d distinct symbols has probability (2c - 1) / 2n, and an escape d / 2n leads
to the context one byte shorter, at last to all bytes alike. A text's language is the
one with the shortest code; each byte costs one look into a table that holds the exact
code lengths of all (context node, byte) pairs, so scoring is vectorised.

Training looks at a bounded sample (``rows_per_lang`` rows of each language, chosen by
a hash, and the whole texts of these); every text is scored whole.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; repeated
rows get equal answers; with no usable training row all is ``und``; an empty table gives
an empty table; other columns are not looked at. A very long text is scored by itself, in
memory of some tens of bytes for each of its bytes. Ties: of languages with equal code
lengths the first by name is told, and the score shows the tie (a half for two).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careweave.llm import common, tokens

ORDER = 3
UNKNOWN = "und"
#: The posterior of a text is that of its mean code length over this many bytes at most:
#: bytes of one text aren't independent evidence.
EVIDENCE_BYTES = 64


def _grams(data: np.ndarray) -> np.ndarray:
    """For each byte the four bytes that end with it, as one integer; 0 before the start."""
    out = data.astype(np.uint32)
    for back in range(1, ORDER + 1):
        out[back:] |= data[:-back].astype(np.uint32) << np.uint32(8 * back)
    return out


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each run of four bytes occurs, for rows (lang, text)."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.let_go()
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            texts = [t.as_buffer().to_pybytes() for t in b.column(1)]
            for lang in dict.fromkeys(langs):
                grams = [_grams(np.frombuffer(t, np.uint8)) for t, x in zip(texts, langs, strict=True) if x == lang and t]
                if grams:
                    gram, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(gram), "gram": gram.astype(np.int64), "n": n}, schema)

    return rows.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen code lengths of all languages over one union of context nodes.

    ``symbol`` maps bytes to classes (bytes never seen share the last one). ``node`` gives
    the context node of three classes; ``bits[node * classes + class]`` the code lengths."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        seen = np.unique(np.concatenate([(g & 255).astype(np.uint8) for g, _ in counts.values()]))
        self.symbol = np.full(256, len(seen), np.int64)
        self.symbol[seen] = np.arange(len(seen))
        self.classes = c = len(seen) + 1
        coded = {}
        for lang, (gram, n) in counts.items():
            s = [self.symbol[(gram >> (8 * k)) & 255] for k in range(ORDER + 1)]
            coded[lang] = (((s[3] * c + s[2]) * c + s[1]) * c + s[0], n)
        # nodes: the empty context, then those of one, two and three bytes seen anywhere
        contexts = [np.zeros(1, np.int64)]
        for order in range(1, ORDER + 1):
            contexts.append(np.unique(np.concatenate([code % c ** (order + 1) // c for code, _ in coded.values()])))
        first = np.cumsum([0, *map(len, contexts)])
        everything = np.arange(c**ORDER)
        self.node = np.zeros(c**ORDER, np.int32)
        for order in range(1, ORDER + 1):
            suffix = everything % c**order
            at = np.searchsorted(contexts[order], suffix).clip(max=len(contexts[order]) - 1)
            hit = contexts[order][at] == suffix
            self.node[hit] = (first[order] + at)[hit]
        self.bits = np.empty((first[-1], c, len(self.langs)), np.float32)
        for k, lang in enumerate(self.langs):
            self._fill(self.bits[:, :, k], contexts, first, *coded[lang])
        self.bits = self.bits.reshape(-1, len(self.langs))

    def _fill(self, out: np.ndarray, contexts: list, first: np.ndarray, code: np.ndarray, n: np.ndarray) -> None:
        c = self.classes
        lower = np.full((1, c), 1 / 256)  # order -1
        for order in range(ORDER + 1):
            pair, index = np.unique(code % c ** (order + 1), return_inverse=True)
            row = np.searchsorted(contexts[order], pair // c) if order else np.zeros(len(pair), np.int64)
            seen = np.zeros((len(contexts[order]), c))
            seen[row, pair % c] = np.bincount(index, weights=n)
            total, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
            up = np.searchsorted(contexts[order - 1], contexts[order] % c ** (order - 1)) if order > 1 else np.zeros(len(contexts[order]), np.int64)
            inherited = lower[up]
            with np.errstate(divide="ignore", invalid="ignore"):
                here = np.where(seen > 0, (2 * seen - 1) / (2 * total), kinds / (2 * total) * inherited)
            lower = np.where(total > 0, here, inherited)  # a context this language lacks codes nothing
            out[first[order] : first[order + 1]] = -np.log2(lower)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text (row) under each language (column)."""
        ends = np.cumsum([len(t) for t in texts])
        out = np.zeros((len(texts), len(self.langs)))
        s = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        c = self.classes
        context = np.zeros(len(s), np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        into = np.arange(len(s)) - np.repeat(starts, np.diff(np.concatenate([[0], ends])).astype(np.int64)) if len(texts) else None
        zero = self.symbol[0]
        for back in range(1, ORDER + 1):
            prior = np.empty_like(s)
            prior[:back], prior[back:] = zero, s[:-back]
            prior[into < back] = zero  # nothing before the start
            context += prior * c ** (back - 1)
        place = self.node[context].astype(np.int64) * c + s
        full = np.flatnonzero(ends > starts)
        if len(full):
            for k in range(len(self.langs)):
                out[full, k] = np.add.reduceat(self.bits[:, k][place], starts[full], dtype=np.float64)
        return out


def train(rows: DataFrame, rows_per_lang: int = 1500, id_col: str = "doc_id") -> Model | None:
    """A model of the languages in rows (id, text, lang); None without a usable row."""
    common.small_batches(rows.sparkSession)
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share: Column = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows_per_lang / n))).otherwise(share)
    chosen = F.pmod(F.xxhash64(F.lit("ppm"), F.col(id_col), "text"), F.lit(1 << 20)) < share * (1 << 20)
    counted = count_grams(rows.where(chosen).select("lang", "text")).toPandas()
    if not len(counted):
        return None
    return Model({lang: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.int64)) for lang, g in counted.groupby("lang")})


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) of every row; the text is scored whole."""
    common.small_batches(docs.sparkSession)
    kinds = f"id {dict(docs.dtypes)[id_col]}, lang_pred string, score double, bits_per_byte double"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.let_go()
        m = shared.value
        names = np.array(m.langs, object)
        for b in batches:
            texts = [t.as_buffer().to_pybytes() for t in b.column(1)]
            for i, j in _portions(texts):
                bits, letters = m.score(texts[i:j]), b.column(2).slice(i, j - i).to_numpy(zero_copy_only=False)
                size = np.array([len(t) for t in texts[i:j]])
                per_byte = bits / np.maximum(size, 1)[:, None]
                gain = (per_byte.min(1, keepdims=True) - per_byte) * np.minimum(size, EVIDENCE_BYTES)[:, None]
                best = per_byte.argmin(1)
                columns = [b.column(0).slice(i, j - i), pa.array(np.where(letters, names[best], UNKNOWN)), pa.array(np.where(letters, 1 / np.exp2(gain).sum(1), 0.0)), pa.array(np.where(size > 0, per_byte.min(1), np.nan), from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(answer, kinds).withColumnRenamed("id", id_col)


def _portions(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about a megabyte (a longer text is alone)."""
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t) > most:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)
