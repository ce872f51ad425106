"""Divergence audit, multi-index search and Orchard's codebooks against brute force."""

import hashlib
import math
import random
import re
import threading
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from careweave.llm import common, divergence, multi_index, orchard, queries

VECTORS = "vec_id long, embedding array<float>, label int, cell int, code string, ids string, vector string"


def table(spark, rows, schema=VECTORS, parts=3):
    return spark.createDataFrame([(*r, 7, "c", "i", "v") for r in rows], schema).repartition(parts)


def vectors(n, width=8, seed=5, first=0):
    r = np.random.default_rng(seed)
    return [(first + i, [float(np.float32(x)) for x in r.normal(size=width)], [None, 1, 1, 2][i % 4]) for i in range(n)]


# divergence


def brute_audit(docs, least=divergence.LEAST_DOCS):
    count, holds = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        count[lang, source].update(terms)
        holds[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in holds[lang].items() if n >= least)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in sources}
        n = sum(total.values())
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 5) // (n + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, lines in (("pair", pairs), ("term", terms)):
                lines.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(lines) if part == "pair" or k < 50]
    return sorted(out)


def audited(spark, docs, **settings):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "text string, lang string, source string, term string, n int")
    return sorted(tuple(r) for r in divergence.audit(df.repartition(3)).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_equals_brute_force(spark, monkeypatch):
    r = random.Random(3)
    vocabulary = [c * k for c in ("a", "B", "été", "Ä", "z_y", "don't", "语") for k in range(1, 12)]
    docs = [(" ".join(r.choice(vocabulary[: 20 + 9 * (i % 5)]) for _ in range(60)), ["en", "en", "fr", None][i % 4], ["s1", "s2", "S2", None, "é"][r.randrange(5)]) for i in range(400)]
    docs += [(None, "xx", "only"), ("", "xx", "other"), ("12 34 \0 ,;", "yy", None), ("w " * 300_000, "en", "long"), ("rare", "zz", "alone")] + [("same text", "en", "s1")] * 40
    want = brute_audit(docs)
    assert {x[2] for x in want} == {"pair", "term"} and ("xx", "only", "pair", "other", 0, 1) in want
    assert audited(spark, docs) == want
    monkeypatch.setattr(divergence, "SHARD", 50)
    monkeypatch.setattr(divergence, "CELLS", 16)
    assert audited(spark, docs) == want


def test_audit_of_nothing_and_of_large_counts(spark):
    assert audited(spark, []) == []
    one = spark.createDataFrame([(10**13, 10**15, 77)], "n long, total long, v long")
    got = one.select(divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (10**13 + 5) // (10**15 + 385)


# Orchard's codebooks


def brute_codes(rows):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    x = np.array([[math.floor(1024 * v) for v in r[1]] for r in rows], object)
    parts = np.split(x, 4, axis=1)
    books = [p[order[:256]].copy() for p in parts]
    apart = lambda p, b: ((p[:, None] - b[None]) ** 2).sum(2)
    for _ in range(4):
        for p, b in zip(parts, books, strict=True):
            at = apart(p, b).argmin(1)
            for e in set(at.tolist()):
                b[e] = p[at == e].sum(0) // int((at == e).sum())
    d = [apart(p, b) for p, b in zip(parts, books, strict=True)]
    code = np.stack([m.argmin(1) for m in d], axis=1)
    error = sum(m.min(1) for m in d)
    by = Counter()
    for r, e in zip(rows, error, strict=True):
        by[r[2]] += e
    told = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted((str(r[0]), bytes(c.tolist()).hex(), e, by[r[2]], told) for r, c, e in zip(rows, code, error, strict=True))


def coded(spark, rows):
    found = orchard.compressed(table(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    return sorted((str(r[0]), *r[1:]) for r in found)


@pytest.mark.parametrize("width, k, scale", [(16, 256, 200), (2, 40, 3), (1, 5, 2), (4, 1, 9), (4, 64, 1 << 26)])
def test_orchard_search_finds_the_first_nearest(width, k, scale):
    r = np.random.default_rng(width)
    entries = r.integers(-scale, scale, (k, width))
    entries[k // 2] = entries[0]
    points = np.concatenate([r.integers(-scale, scale, (1500, width)), entries])
    at, d = orchard.Codebook(entries).nearest(points)
    apart = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (at == apart.argmin(1)).all() and (d == apart.min(1)).all()


def test_codes_equal_brute_force(spark):
    rows = vectors(700) + vectors(40, seed=6, first=600)  # some identifiers occur twice
    rows += [(900, rows[3][1], 9)] * 60 + [(901, None, 1), (902, [1.0] * 7 + [None], 1), (903, [float("nan")] * 8, 1), (904, [1.0, float("-inf")] * 4, 2), (None, [0.5] * 8, None), (905, [0.0] * 8, 1), (906, [-1000.25] * 8, 3)]
    got = coded(spark, rows)
    assert got == brute_codes(rows) and len(got) == 803


def test_codes_of_few_and_of_none(spark):
    assert coded(spark, vectors(3)) == brute_codes(vectors(3))
    assert coded(spark, []) == [] and coded(spark, [(1, None, 2)]) == []


def test_codes_of_vectors_that_cannot_be_cut(spark):
    with pytest.raises(Exception, match="one length"):
        coded(spark, [(1, [1.0, 2.0, 3.0], 1)])


def test_decoded_vectors_are_within_the_error(spark):
    rows = table(spark, vectors(400))
    books = orchard.trained(rows)
    given = {r["vec_id"]: np.floor(np.array(r["embedding"], float) * 1024) for r in rows.collect()}
    for r in orchard.decoded(orchard.encoded(rows, books), books).collect():
        assert ((np.array(r["approximation"]) * 1024 - given[r["vec_id"]]) ** 2).sum() == r["error"]


# multi-index


def brute_nearest(rows, asks=100, n=10):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([r[1] for r in rows])
    best = defaultdict(dict)
    for i, v, _ in rows:
        if i % asks == 0:
            for j, d in zip((r[0] for r in rows), multi_index.distance(x, np.array(v)).tolist(), strict=True):
                if j != i:
                    best[i][j] = min(d, best[i].get(j, math.inf))
    return sorted((i, k + 1, j, d) for i, found in best.items() for k, (d, j) in enumerate(sorted((d, j) for j, d in found.items())[:n]))


def searched(spark, rows, **settings):
    return sorted(tuple(r) for r in multi_index.search(table(spark, rows), F.col("vec_id") % 100 == 0, **settings).collect())


ODD = [(1000, None, 1), (1100, [0.0] * 8, 1), (1200, [float("nan")] * 8, 1), (1300, [1.0] * 7 + [None], 1), (None, [1.0] * 8, 1)]


def test_whole_search_equals_brute_force(spark, monkeypatch):
    rows = vectors(900) + ODD
    rows += [(200, rows[5][1], 1), (201, [1.0] * 8, 1), (200, rows[200][1], 1)]  # an identifier with two vectors
    rows += [(2000 + i, rows[300][1], 1) for i in range(250)] + [(2600, [-x for x in rows[300][1]], 1)] * 30
    want = brute_nearest(rows)
    assert searched(spark, rows, share=1.0) == want
    monkeypatch.setattr(multi_index, "BLOCK", 64)
    monkeypatch.setattr(multi_index, "LANE", 2)
    monkeypatch.setattr(multi_index, "MATRIX", 100)
    assert searched(spark, rows, share=1.0) == want


def test_recall_and_scores(spark):
    r = np.random.default_rng(8)
    middle = r.normal(size=(20, 32)) * 2
    rows = [(i, (middle[i % 20] + r.normal(size=32)).tolist(), 1) for i in range(4000)]
    for given in (rows, vectors(3000, width=64)):
        want, got = brute_nearest(given), searched(spark, given)
        assert Counter(x[0] for x in got) == Counter(x[0] for x in want)
        assert len({(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want}) >= 0.9 * len(want)
        for a in {x[0] for x in got}:
            lines = [x for x in got if x[0] == a]
            assert [x[1] for x in lines] == list(range(1, 11)) and sorted((x[3], x[2]) for x in lines) == [(x[3], x[2]) for x in lines]


def test_search_of_few_and_of_none(spark):
    assert searched(spark, []) == [] and searched(spark, ODD) == [] and searched(spark, [(0, [1.0], 1)]) == []
    few = [(0, [1.0, 2.0], 1), (1, [1.0, 2.5], 1), (2, [0.5, 2.0], 1), (3, [1.0], 1)]
    assert searched(spark, few) == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]


def test_cells_are_walked_by_distance():
    x = np.random.default_rng(2).normal(size=(500, 6))
    index = multi_index.Index(x, 500)
    a, b = multi_index.squared(x[:1, :3], index.first)[0], multi_index.squared(x[:1, 3:], index.second)[0]
    walked = [a[c // index.k] + b[c % index.k] for c in index.walk(x[0])]
    assert len(walked) == index.k**2 and walked == sorted(walked)
    counts = np.array([5, 9000, 0, 8192, 20_000, 1])
    first, blocks = multi_index.layout(counts)
    assert blocks.tolist() == [1, 2, 1, 1, 3, 1]
    used = [set(range(f, f + n)) for f, n in zip(first.tolist(), blocks.tolist(), strict=True)]
    assert not used[1] & used[4] and not (used[1] | used[4]) & (used[0] | used[3] | used[5])


# registered queries, and what they share


def test_registered_queries(spark, tmp_path):
    rows = vectors(500)
    table(spark, rows).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    found = sorted(tuple(r) for r in queries.QUERIES["op13_orchard_codes"](spark, f"file://{tmp_path}").collect())
    assert sorted((str(a), *b) for a, *b in found) == brute_codes(rows)
    got = queries.QUERIES["op12_multi_index"](spark, f"file://{tmp_path}").collect()
    want = brute_nearest(rows)
    assert len(got) == len(want) and len({(r[0], r[2]) for r in got} & {(a, c) for a, _, c, _ in want}) >= 0.9 * len(want)
    docs = [("the cat sat" if i % 2 else "the dog sat", "en", f"s{i % 3}") for i in range(120)]
    spark.createDataFrame(docs, "text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in queries.QUERIES["op11_source_divergence"](spark, f"file://{tmp_path}").collect()) == brute_audit(docs)


def test_hot_keys_are_joined_by_broadcast_and_others_by_shuffle(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.col("id")).otherwise(7).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("total"))
    got = {(r["id"], r["k"], r["total"]) for r in common.with_facts(rows, facts, "k", "n").collect()}
    total = Counter()
    for r in rows.collect():
        total[r["k"]] += r["id"]
    assert got == {(r["id"], r["k"], total[r["k"]]) for r in rows.collect()} and len(got) == 5000


def test_tables_of_two_threads_are_kept_apart(spark):
    failed, step = [], threading.Barrier(2, timeout=60)

    def work(k):
        try:
            began = common.n_tables()
            kept = common.written(spark.range(k), "kept")
            step.wait()
            if k == 5:
                common.clear(spark, began)  # only its own
            step.wait()
            if k == 9:
                assert kept.count() == 9 and common.n_tables() == began + 1
                common.clear(spark, began)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in (5, 9)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not failed
