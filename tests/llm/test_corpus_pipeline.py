"""Each stage on odd rows; stages one after another."""

import corpus_pipeline
from test_corpus_operators import ROWS, brute_links, table, words

from careweave.llm import common


def test_stages_keep_columns(spark):
    docs = table(spark, ROWS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert stage(spark, docs.limit(0), "").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.count() >= docs.count() > 0


def test_language_rejects_only_texts_without_letters(spark):
    out = corpus_pipeline.language(spark, table(spark, ROWS), "").collect()
    assert sorted(r["doc_id"] or 0 for r in out) == sorted(i or 0 for i, t, *_ in ROWS if any(c.isalpha() for c in t or ""))


def test_near_copies_keep_one_of_each_class(spark):
    _, roots = brute_links(ROWS)
    out = corpus_pipeline.near_copies(spark, table(spark, ROWS), "").collect()
    assert len(out) == len(set(roots)) and {r["doc_id"] for r in out} >= {5, 9, 10, 13, 14, 4}


def test_near_copies_of_a_group_tell_few_rows(spark, monkeypatch):
    told, written = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name, *more, **by: (out := written(df, name, *more, **by), told.append(out.count()) if name == "met" else None)[0])
    base = words(150, 9).split()
    rows = [(i, " ".join([*base[: i % 150], f"x{i}", *base[i % 150 + 1 :]]), "en", "a", 1) for i in range(300)]
    out = corpus_pipeline.near_copies(spark, table(spark, rows).repartition(2), "").collect()
    assert [r["doc_id"] for r in out] == [0]
    # each of a few tasks tells of a text once, not for each of its 24 nodes
    assert sum(told) <= (int(spark.conf.get("spark.sql.shuffle.partitions")) + 1) * len(rows)


def test_repeats_leave_whole_characters(spark):
    rows = [(i, f"é{i} " + "éèê" * 120 + f" ê{i} end", "fr", "a", 1) for i in (1, 2)]
    out = {r["doc_id"]: r for r in corpus_pipeline.repeats(spark, table(spark, rows), "").collect()}
    assert out[1]["text"] == "é11 end" and out[1]["n_chars"] == 7  # " " and "ê" stand in both


def test_mix_repeats_rows(spark):
    rows = [(i, "a b c", "en", "small" if i < 10 else "x", 1) for i in range(100)]
    out = corpus_pipeline.mixed(spark, table(spark, rows), "").collect()
    assert 60 <= len(out) <= 110


def run_on(spark, folder, docs):
    docs.write.parquet(f"file://{folder}/documents.parquet")
    return corpus_pipeline.run(spark, f"file://{folder}")


def test_run_on_an_empty_table(spark, tmp_path):
    out = run_on(spark, tmp_path, table(spark, ROWS).limit(0))
    assert out.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_run_on_clashing_columns_repeated_rows_and_a_very_long_text(spark, tmp_path):
    from pyspark.sql import functions as F
    from test_corpus_operators import words

    long = " ".join(words(60, 1000 + i) + "." for i in range(3600))
    assert len(long) > 1 << 20
    rows = [(i, words(50 + i, 500 + i), "en", "ab"[i % 2], 1) for i in range(30)] + [(100, long, "en", "a", 1)]
    rows += [rows[3]] * 5 + [(200, None, None, None, None), (201, "", "en", "a", 0)]
    docs = table(spark, rows)
    for c in ("row", "key", "id", "path", "time", "kept", "pattern", "tokens", "piece", "text_", "source_size"):
        docs = docs.withColumn(c, F.lit("theirs"))
    out = run_on(spark, tmp_path, docs).collect()
    pieces = {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
    # repeated rows are one group of copies, texts without a letter have no language
    assert set(pieces) <= {*range(30), 100} and 100 in pieces and not {200, 201} & set(pieces)
    assert len(pieces[100]) > 100 and all(r["length"] <= 2048 for r in out)
    filled = {}
    for r in out:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
