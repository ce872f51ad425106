"""Audit of how sources differ in their words, language by language.

Terms are counted inside Arrow batches by Arrow's own compute functions: letters A to Z are
lower-cased, texts split at everything that isn't part of a term, terms and groups encoded as
numbers, and (document, term) and (group, term) counted by hashing. What leaves a task are
partial counts; Spark sums them by (lang, source, term), so even the most frequent word of
the largest source is one line of each task.

A term is kept in a language if at least ``LEAST_DOCS`` of the language's documents hold
it. Shares are whole numbers, 1 + floor(10**9 * (count + 5) / (N + 5 * V)), and a
difference of two of them adds up exactly. For pairs of sources the kept counts are dealt
into shards by a hash of the term, beside the few numbers of each group; a shard is a small
matrix of shares, whose column differences are summed, and the shards' sums are added.
No pair of sources is formed but inside that matrix, no list of terms is gathered, and
nothing but the number of shards depends on the size.

Defined cases: null text, lang and source are empty strings; a text without a term counts
for its group alone; a language without a kept term has pairs of value 0 and no terms;
repeated rows are documents of their own; ties are broken by the item's bytes; an empty
table gives an empty table; very long texts are counted whole; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careweave.llm import common

#: What parts terms: all of ASCII but letters.
APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, SMOOTHING, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Lines of counts in a shard, and shares in a matrix.
SHARD, CELLS = 100_000, 1 << 21


def _cleaned(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))


def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a batch of (lang, source, text)."""
    words = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), APART)
    document, term = pc.list_parent_indices(words), pc.list_flatten(words)
    there = pc.not_equal(term, "")
    document, term = document.filter(there), pc.dictionary_encode(term.filter(there))
    pairs = pa.table({"document": document, "term": term.indices}).group_by(["document", "term"]).aggregate([([], "count_all")])
    lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
    of = pa.table({"lang": lang.indices.take(pairs["document"]), "source": source.indices.take(pairs["document"]), "term": pairs["term"], "n": pairs["count_all"]})
    sums = of.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ([], "count_all")])
    names = [d.dictionary.take(sums[c].combine_chunks()) for c, d in (("lang", lang), ("source", source), ("term", term))]
    return pa.RecordBatch.from_arrays([*names, sums["n_sum"].combine_chunks().cast(pa.int64()), sums["count_all"].combine_chunks().cast(pa.int64())], names=["lang", "source", "term", "n", "docs"])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of documents (lang, source, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield counted(b)

    partial = docs.mapInArrow(work, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 * kept)), exactly."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.call_function("div", wide((n + SMOOTHING) * F.lit(UNIT).cast("decimal(10,0)")), wide(total + SMOOTHING * kept)) + 1


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) for all groups; see the module."""
    common.small_batches(docs.sparkSession)
    docs = _cleaned(docs, text_col, lang_col, source_col)
    terms = common.written(counts(docs), "terms")
    # terms that enough documents of the language hold, with the language's count
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n")).where(F.col("in_docs") >= LEAST_DOCS).drop("in_docs")
    kept = common.written(kept, "kept-terms")
    held = common.written(terms.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    none = F.lit(0).cast("long")
    groups = common.written(groups.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("total", "v", "lang_total"))), "groups")
    return _terms(held, groups).unionByName(_pairs(held, groups))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


def _terms(held: DataFrame, groups: DataFrame) -> DataFrame:
    """The terms that a source uses most beyond its language's share."""
    rows = held.join(groups, ["lang", "source"])
    more = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), more.alias("value")).where("value > 0")
    return _ranked(rows, "term").where(F.col("rank") <= TOP)


def _pairs(held: DataFrame, groups: DataFrame) -> DataFrame:
    """Each two sources of a language with the sum of their differences over kept terms."""
    n_shards = 1 + held.count() // SHARD
    shard = F.pmod(F.xxhash64("term"), F.lit(n_shards)).cast("int").alias("shard")
    lines = held.select("lang", shard, "source", "term", "n")
    facts = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), "source", "total", "v")
    parts = lines.groupBy("lang", "shard").cogroup(facts.groupBy("lang", "shard")).applyInArrow(differences, "lang string, source string, item string, value long")
    return _ranked(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")


def differences(lines: pa.Table, facts: pa.Table) -> pa.Table:
    """(lang, source, item, value): summed differences of all sources over a shard's terms."""
    names = sorted(zip(facts["source"].to_pylist(), facts["total"].to_pylist(), facts["v"].to_pylist(), strict=True))
    n, place = len(names), {s: k for k, (s, _, _) in enumerate(names)}
    # exact: Python's integers where a product may not fit
    below = np.array([t + SMOOTHING * v for _, t, v in names], object)
    base = np.array([1 + UNIT * SMOOTHING // b if b else 0 for b in below], np.int64)
    value = np.zeros((n, n), np.int64)
    order = np.argsort(lines["term"].dictionary_encode().combine_chunks().indices.to_numpy(), kind="stable")
    term = lines["term"].dictionary_encode().combine_chunks().indices.to_numpy()[order]
    source = np.array([place[s] for s in lines["source"].to_pylist()], np.int64)[order]
    count = np.array(lines["n"].to_pylist(), object)[order]
    row = np.cumsum(np.concatenate([[0], np.diff(term) != 0])) if len(term) else term
    step = max(1, CELLS // max(1, n))
    for first in range(0, int(row.max(initial=-1)) + 1, step):
        a, z = np.searchsorted(row, [first, first + step])
        shares = np.tile(base, (int(row[z - 1]) - first + 1, 1))
        shares[row[a:z] - first, source[a:z]] = [1 + UNIT * (c + SMOOTHING) // below[s] for c, s in zip(count[a:z], source[a:z], strict=True)]
        for k in range(n):
            value[k] += np.abs(shares - shares[:, k : k + 1]).sum(0)
    lang = facts["lang"][0].as_py()
    i, j = np.nonzero(~np.eye(n, dtype=bool))
    called = pa.array([s for s, _, _ in names], pa.string())
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": called.take(pa.array(i)), "item": called.take(pa.array(j)), "value": pa.array(value[i, j])})
