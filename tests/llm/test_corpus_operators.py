"""The operators on Spark: odd tables, and brute force on small ones."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from careweave.llm import cdc, chosen_path, common, gam, graph, mixing, ogg, packing, ppm, queries, rules, sstable, suffix

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SQL = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, k long, row string, size int, spans string, n int, `order` long, label int, bucket int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "on", "er", "é", "st", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def table(spark, rows):
    extra = (7, "clash", 1, "row", 2, "spans", 3, 4, 5, 6)
    return spark.createDataFrame([(*r, *extra) for r in rows], SQL)


LONG = words(5000, 1)
PASSAGE = words(90, 2)
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (None, words(60, 3), "en", None, 1), (None, words(60, 3), "en", None, 1), (4, words(60, 3), "fr", "b", 1),
    (5, LONG, "en", "a", 1), (5, LONG, "en", "a", 1), (6, LONG[:-3] + "xyz", "fr", "b", 1), (7, "日本語 😀 é", "jp", "c", 1), (8, "1234 5678", None, "c", 1), (9, words(40, 4) + " " + PASSAGE, "en", "a", 1), (10, PASSAGE + "\n" + words(50, 5), "fr", "b", 1),
    (11, "one two three", "en", "a", 1), (12, "one two three", "en", "b", 1), (13, "onth onth " * 150, "en", "a", 1), (14, words(130, 6), "en", "d", 1), (15, words(130, 6).replace("th ", "TH ", 1), "en", "d", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, ROWS).limit(0)


def key(row):
    return (row["doc_id"] is None, row["doc_id"] or 0)


def test_ogg_of_odd_rows(odd, empty):
    out = ogg.decode_ogg(ogg.encode_ogg(odd)).collect()
    assert len(out) == len(ROWS) and not any(r["error"] for r in out)
    want = {(i, hashlib.sha256((b := (t or "").encode()) + b"\xff" * (-len(b) % 576 if b else 576)).hexdigest()) for i, t, *_ in ROWS}
    assert {(r["doc_id"], r["payload_sha256"]) for r in out} == want
    assert ogg.decode_ogg(ogg.encode_ogg(empty)).count() == 0
    broken = ogg.decode_ogg(ogg.encode_ogg(odd).selectExpr("doc_id", "CASE WHEN doc_id = 1 THEN NULL ELSE substring(media, 2) END AS media"))
    assert broken.where("error IS NULL").count() == 0


def test_sstable_of_odd_rows(odd, empty):
    lib = Tokenizer.from_file(WORD)
    out = sstable.encoded(odd, WORD, 2).collect()
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out)
    ids = [(i, [*lib.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in ROWS]
    assert got == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    at, last = 0, None
    for r in sorted(out, key=lambda r: r["start"]):
        here = (r["doc_id"] is not None, r["doc_id"] or 0)
        assert r["start"] == at and (last is None or last <= here)
        at, last = at + r["n_tokens"], here
    assert sstable.encoded(empty, WORD, 2).count() == 0


def test_packing_of_odd_rows(odd, empty):
    lib = Tokenizer.from_file(BYTE)
    out = packing.packed(odd, BYTE, 0, size=64).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        x = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(x) % 64 or 64
        for n, stop in enumerate(range(first, len(x) + 1, 64)):
            part = x[max(0, stop - 64) if n else 0 : stop]
            want[i, n, stop - len(part), len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in out) == want
    rows = defaultdict(list)
    for r in out:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in rows.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64
    assert len(rows) <= 1.1 * sum(r["length"] for r in out) / 64 + 1
    assert packing.packed(empty, BYTE, 0).count() == 0


def test_mixing_of_odd_rows(spark, odd, empty):
    from pyspark.sql import functions as F

    run = lambda df: mixing.mix(df, F.array("source"), common.word_count("text"))
    out, sizes, goal = run(odd)
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, run(odd.repartition(5))[0].collect()), key=repr)
    assert sum(sizes.values()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in ROWS)
    many = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 40)) AS text", "CASE WHEN id % 3 = 0 THEN 'big' ELSE concat('s', id % 7) END AS source")
    out, sizes, goal = run(many)
    taken = {r["pattern"]: r["t"] for r in out.groupBy("pattern").agg(F.sum("taken").alias("t")).collect()}
    for s, want in goal.items():
        assert abs(taken[f'["{s}"]'] - want) <= 0.01 * want
    assert run(empty)[0].count() == 0


def test_mixing_of_overlapping_sources(spark):
    from pyspark.sql import functions as F

    docs = spark.range(600).selectExpr("id AS doc_id", "'a b c d' AS text", "CASE WHEN id < 200 THEN array('x') WHEN id < 400 THEN array('y', 'x') ELSE array('y') END AS s")
    out, sizes, goal = mixing.mix(docs, F.col("s"), common.word_count("text"), weights=(1, 1))
    assert sizes == {"x": 1600, "y": 1600} and abs(out.agg(F.sum("taken")).first()[0] - sum(goal.values())) <= 8


def test_mixing_with_one_giant_document(spark):
    from pyspark.sql import functions as F

    # 30 sources of 500 documents of about 400 words and one of 20,000
    docs = spark.range(30 * 501).selectExpr("id AS doc_id", "'' AS text", "concat('s', id div 501) AS source", "IF(id % 501 = 0, 20000, 200 + pmod(xxhash64(id), 401)) AS n")
    out, sizes, goal = mixing.mix(docs, F.array("source"), F.col("n"))
    taken = {r["pattern"]: r["t"] for r in out.groupBy("pattern").agg(F.sum("taken").alias("t")).collect()}
    for s, want in goal.items():
        assert abs(taken[f'["{s}"]'] - want) <= 0.001 * want
    same = spark.range(3000).selectExpr("id % 30 AS doc_id", "'' AS text", "'a' AS source", "5L AS n").union(docs.where("doc_id < 501"))
    out, sizes, goal = mixing.mix(same, F.array("source"), F.col("n"), weights=(1, 1))
    assert out.count() == 3501 and out.where("pattern = '[\"a\"]'").select("doc_id", "taken").distinct().count() == 30


def test_language_of_odd_rows(spark, odd, empty):
    model = ppm.train(odd)
    out = sorted(ppm.predict(odd, model).collect(), key=key)
    assert len(out) == len(ROWS)
    und = {1, 2, 3, 8}
    for r in out:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in und) and 0 <= r["score"] <= 1
    assert ppm.train(empty) is None and {r["lang_pred"] for r in ppm.predict(odd, None).collect()} == {"und"}
    assert ppm.predict(empty, model).count() == 0


def test_language_of_texts_with_a_long_foreign_header(spark):
    header = "lorem ipsum dolor " * 500  # 9,000 bytes
    docs = table(spark, [(1, header, "xx", "a", 1), (2, header + "zwykq jvuzh " * 900, "yy", "a", 1), (3, "zwykq jvuzh " * 9, None, "a", 1)])
    assert {r["doc_id"]: r["lang_pred"] for r in ppm.predict(docs, ppm.train(docs)).collect()}[3] == "yy"


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(9, 1), (10, 1), (13, 0), (13, 1), (5, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = gam.train(odd, labels)
    out = gam.predict(odd, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert {r["score"] for r in gam.predict(odd, gam.train(odd, labels.limit(0))).collect()} == {0.5}
    assert gam.predict(empty, model).count() == 0 and gam.train(empty, labels) is not None


def test_rules_of_odd_rows(odd, empty):
    refs = rules.references(odd)
    assert set(refs) == {"en", "fr", "jp"}
    out = {r["doc_id"]: r for r in rules.judge(odd, refs).collect()}
    assert out[1]["base_failed"] and out[13]["base_failed"] and not out[13]["kept"] and out[14]["kept"]
    assert out[11]["char_distance"] is None and out[14]["word_distance"] is not None
    counted = Counter(w.lower() for i, t, lang, *_ in ROWS if t and lang == "en" for w in (rules.common_form(x) for x in t.encode().split()) if w)
    assert dict(refs["en"]["words"]) == dict(sorted(counted.items(), key=lambda x: (-x[1], x[0]))[: rules.TOP_WORDS])
    assert rules.references(empty) is None and rules.judge(empty, None).count() == 0
    assert rules.judge(odd, None).where("char_distance IS NOT NULL").count() == 0


def test_chunk_dedup_of_odd_rows(odd, empty):
    out = sorted(cdc.dedup(odd).collect(), key=key)
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: r for r in out}
    assert by[5]["n_removed"] == 0 and by[6]["n_removed"] > 0.9 * by[6]["n_bytes"]
    assert by[4]["n_removed"] == 0 and by[None]["n_removed"] == by[None]["n_bytes"]  # null identifiers are last
    assert by[12]["kept"] == "" and by[11]["kept"] == "one two three"
    assert by[9]["n_removed"] == 0 and by[10]["n_removed"] > 120
    # brute force: chunks in order of identifier and place
    seen, want = set(), Counter()
    for i, t in sorted({(r[0], r[1] or "") for r in ROWS}, key=lambda r: (r[0] is None, r[0] or 0)):
        data = t.encode()
        for a, z in cdc._chunks(data):
            want[i] += data[a:z] in seen
            seen.add(data[a:z])
    assert {r["doc_id"]: r["n_dup_chunks"] for r in out} == {i: want[i] for i, *_ in ROWS}
    assert cdc.dedup(empty).count() == 0


def test_chunk_dedup_of_short_passages(spark):
    rows, planted = [], 200
    for i in range(planted):  # 51 words in two surroundings of 20 words each
        p = words(51, 1000 + i)
        for j in (0, 1):
            rows.append((2 * i + j, words(20, 5000 + 4 * i + 2 * j) + " " + p + " " + words(20, 5001 + 4 * i + 2 * j), "en", "a", 1))
    out = {r["doc_id"]: r for r in cdc.dedup(table(spark, rows)).collect()}
    sizes = [len(words(51, 1000 + i)) for i in range(planted)]
    gone = [out[2 * i + 1]["n_removed"] for i in range(planted)]
    assert not any(out[2 * i]["n_removed"] for i in range(planted))
    assert sum(g >= n for g, n in zip(gone, sizes, strict=True)) >= 0.98 * planted, (sum(gone) / sum(sizes), sum(g == 0 for g in gone))


def sets_of(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_links(rows):
    s = [sets_of(t) for _, t, *_ in rows]
    near = [[i != j and (rows[i][1] or "") == (rows[j][1] or "") or i != j and bool(s[i] and s[j]) and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]) for j in range(len(rows))] for i in range(len(rows))]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near[i][j]:
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [sum(x) for x in near], [find(i) for i in range(len(rows))]


def test_jaccard_join_of_odd_rows(spark, odd, empty):
    links, roots = brute_links(ROWS)
    least = {}
    for i, r in enumerate(ROWS):
        least.setdefault(roots[i], []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    want = Counter((r[0], least[roots[i]], links[i]) for i, r in enumerate(ROWS))
    for large in (chosen_path.LARGE, 1):
        got = chosen_path.join(odd, large=large).collect()
        assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    kept = chosen_path.representatives(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(roots))
    assert chosen_path.join(empty).count() == 0 and chosen_path.representatives(empty).count() == 0


def test_jaccard_join_of_a_large_group(spark):
    base = words(150, 9).split()
    rows = []
    for i in range(400):  # more than a block, most within the threshold of each other
        w, r = list(base), random.Random(i)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 99)}"
        rows.append((i, " ".join(w), "en", "a", 1))
    links, roots = brute_links(rows)
    got = {r["doc_id"]: r for r in chosen_path.join(table(spark, rows)).collect()}
    assert [got[i]["n_links"] for i in range(400)] == links and [got[i]["class_id"] for i in range(400)] == roots


def test_jaccard_recall_in_crowded_nodes(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = []
    for i in range(400):  # pairs of similarity 156 / 194, all of whose nodes are crowded
        base = " ".join(f"{i}w{k}" for k in range(160))
        rows += [(2 * i + j, base + "".join(f" {i}x{j}y{k}" for k in range(19)), "en", "a", 1) for j in (0, 1)]
    docs = table(spark, rows)
    assert chosen_path.join(docs, large=1).where("n_links = 1").count() >= 0.97 * len(rows)
    # copies of a text are one set
    depths, meetings = [], chosen_path._meetings
    monkeypatch.setattr(chosen_path, "_meetings", lambda rows, runs, levels, *more: (depths.append(levels), meetings(rows, runs, levels, *more))[1])
    copies = docs.where("doc_id < 2").withColumn("text", F.explode(F.array_repeat("text", 20))).repartition(8)
    assert chosen_path.join(copies, large=4).where("n_links = 39").count() == 40 and depths == [chosen_path.LEVELS]


@pytest.mark.parametrize("heavy", [False, True])
def test_last_depth_joins_no_strangers_and_loses_no_pair(spark, monkeypatch, heavy):
    from pyspark.sql import functions as F

    if heavy:  # every node is, and its sets are compared where they are read
        for name, value in (("PART", 1), ("HEAVY", 2), ("SHARE", 10_000)):
            monkeypatch.setattr(chosen_path, name, value)
    common_part, rows = words(60, 1), []
    for i in range(60):  # strangers that share a passage; every fifth has a near copy
        text = common_part + " " + " ".join(f"{i}w{k}" for k in range(140))
        rows += [(10 * i, text)] + ([(10 * i + 1, text + " more")] if i % 5 == 0 else [])
    sets = [set(chosen_path.shingles(t.encode()).tolist()) for _, t in rows]
    docs = spark.createDataFrame(rows, "id long, text string").select("id", F.unhex(F.md5("text")).alias("key"), F.col("text").cast("binary").alias("text")).repartition(4)
    of = {bytes(r["key"]): k for k, (i, _) in enumerate(rows) for r in docs.where(F.col("id") == i).collect()}
    edges = {(of[bytes(u)], of[bytes(v)]) for u, v in chosen_path.candidate_edges(docs, 0.995, levels=1, large=1, deepest=1).collect()}
    up = list(range(len(rows)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for a, b in edges:
        assert len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.05
        up[max(find(a), find(b))] = min(find(a), find(b))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                assert find(a) == find(b)


@pytest.mark.parametrize("large", [256, 16])
def test_a_task_tells_fewer_pairs_than_it_has_sets(spark, large):
    from pyspark.sql import functions as F

    # 200 kindred sets, of which 150 are close, meet at 40 nodes; a stranger has the least key
    r = np.random.default_rng(1)
    core, own = r.choice(np.arange(1, 30000), 32, replace=False), np.arange(30001, 60001)
    held = [np.sort(np.concatenate([core[: 28 if i < 150 else 12], r.choice(own, 4 if i < 150 else 20, replace=False)])) for i in range(200)]
    sets = [(bytes(16), np.arange(60001, 60033).astype("<u2").tobytes()), *((hashlib.md5(b"%d" % i).digest(), x.astype("<u2").tobytes()) for i, x in enumerate(held))]
    rows = [(p, key, x) for p in range(40) for key, x in sets]
    meetings = spark.createDataFrame(rows, "path long, key binary, sketch binary").select("*", F.lit(None).cast("binary").alias("center"), F.lit(False).alias("walks")).repartition(8)
    met = chosen_path._met(meetings, large, False).withColumn("task", F.spark_partition_id()).collect()
    tasks = len({x["task"] for x in met})
    pairs = [(bytes(x["u"]), bytes(x["v"])) for x in met if x["v"] is not None]
    assert len(pairs) <= 200 * tasks and len(met) - len(pairs) <= 201 * tasks
    up = {key: key for key, _ in sets}

    def find(k):
        return k if up[k] == k else find(up[k])

    for u, v in pairs:
        up[max(find(u), find(v))] = min(find(u), find(v))
    assert Counter(Counter(find(key) for key, _ in sets).values()) == {200: 1, 1: 1}


@pytest.mark.parametrize("heavy", [False, True])
def test_pairs_of_a_group_follow_its_size(spark, monkeypatch, heavy):
    for name, value in (("PART", 1), ("HEAVY", 8), ("SHARE", 10_000)) if heavy else ():
        monkeypatch.setattr(chosen_path, name, value)
    told, written = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name, *more, **by: (out := written(df, name, *more, **by), told.append(out.count()) if name == "met" else None)[0])
    base, rows = words(150, 9).split(), []
    for i in range(600):
        w = list(base)
        w[i % 150] = f"x{i}"
        rows.append((i, " ".join(w), "en", "a", 1))
    docs = table(spark, rows).repartition(2)
    got = chosen_path.representatives(docs).collect()
    assert [r["doc_id"] for r in got] == [0]
    # every set is told of by each task at most, and not once for each of its 24 nodes
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(told) <= (tasks + 1) * len(rows)


def brute_strip(rows, length):
    seen = Counter()
    texts = [(t or "").encode() for _, t, *_ in rows]
    for t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t) - len(kept), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "hot", "hotter"), [(400, 4096, 4096), (272, 2, 4096), (272, 0, 4096), (272, 0, 3), (272, 0, 0)])
def test_suffix_dedup(spark, odd, length, hot, hotter):
    rows = list(ROWS)
    for i in range(12):  # one passage in many surroundings, cut differently
        rows.append((100 + i, words(30 + i, 50 + i) + " " + words(120, 77)[i * 7 :] + words(20, 90 + i), "en", "a", 1))
    facts, stripped = suffix.strip(table(spark, rows), length=length, hot=hot, hotter=hotter)
    got = facts.join(stripped, "key", "left").selectExpr("doc_id", "n_bytes", "coalesce(n_removed, 0) AS removed", "coalesce(n_spans, 0) AS spans", "coalesce(kept_sha256, whole_sha256) AS sha").collect()
    want = Counter((r[0], *x) for r, x in zip(rows, brute_strip(rows, length), strict=True))
    assert Counter((r["doc_id"], r["removed"], r["spans"], r["sha"]) for r in got) == want


def test_suffix_dedup_of_nothing(empty):
    facts, stripped = suffix.strip(empty)
    assert facts.count() == 0 and stripped.count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    up = list(range(500))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["v"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for e in edges for i in e if e[0] != e[1]} | {k: v for k, v in got.items() if k == v and find(k) == v}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_queries_are_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", k)[0] for k in queries.QUERIES}


def test_words_with_null_bytes(spark):
    text = "\0abc \0 \x003 \x003 " + "plain words here " * 30
    docs = spark.createDataFrame([(1, text, "en"), (2, "", "xx"), (3, text, "en")], "doc_id long, text string, lang string")
    refs = rules.references(docs, top=4)
    assert list(refs) == ["en"] and refs["en"]["words"] == [(b"here", 60), (b"plain", 60), (b"words", 60), (b"\x003", 4)]
    assert refs["en"]["total"] == 2 * 94 and refs["en"]["classes"].sum() == 2 * len(text)
    few = rules.references(docs.repartition(3), top=4)
    assert few["en"]["words"] == refs["en"]["words"] and (few["en"]["classes"] == refs["en"]["classes"]).all()
    got = {r["doc_id"]: r["n_words"] for r in rules.judge(docs, refs).collect()}
    assert got == {1: 94, 2: 0, 3: 94}
