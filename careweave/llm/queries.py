"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careweave.llm import cdc, chosen_path, common, divergence, gam, mixing, multi_index, ogg, orchard, packing, ppm, rules, sstable, suffix


def op1_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(common.crc_bucket("doc_id", 4) == 2, F.lit(False))
    model = gam.train(docs, labels.where(~held_out).select("doc_id", "quality"))
    return gam.predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_cdc_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cdc.dedup(common.documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_chunks", "n_dup_chunks", "n_removed", "n_spans", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(common.documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_class")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    mixed, sizes, goal = mixing.mix(docs, F.array("source"), common.word_count("text"))
    lines = [(json.dumps([s], ensure_ascii=False), sizes[s], goal[s]) for s in sizes]
    by_source = mixing.small(spark.createDataFrame(lines, "pattern string, source_size long, target double"), len(lines))
    return mixed.join(by_source, "pattern").select("doc_id", "size", "source_size", "target", "taken")


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = ppm.train(docs.where(~F.coalesce(common.crc_bucket("doc_id", 5) == 0, F.lit(False))))
    return ppm.predict(docs, model).select("doc_id", F.coalesce(common.crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op6_sstable_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.encoded(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.decode_ogg(ogg.encode_ogg(common.documents(spark, sf_dir)))


def op8_suffix_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, stripped = suffix.strip(common.documents(spark, sf_dir))
    answer = facts.join(stripped.drop("kept"), "key", "left")
    none = F.lit(0).cast("long")
    return answer.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), F.coalesce("kept_text", "text").alias("text"))


def op9_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return rules.judge(docs, rules.references(docs))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.documents(spark, sf_dir))


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op13_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = orchard.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_gam_quality": op1_gam_quality,
    "op2_cdc_substrings": op2_cdc_substrings,
    "op3_chosen_path_join": op3_chosen_path_join,
    "op4_mixing": op4_mixing,
    "op5_ppm_language": op5_ppm_language,
    "op6_sstable_token_ids": op6_sstable_token_ids,
    "op7_ogg_media": op7_ogg_media,
    "op8_suffix_substrings": op8_suffix_substrings,
    "op9_divergence_rules": op9_divergence_rules,
    "op10_packing": op10_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_multi_index": op12_multi_index,
    "op13_orchard_codes": op13_orchard_codes,
}

def _codes_sql(rounds: int = 4) -> str:
    """Rounds of assigning parts (row, part, vector) to entries (part, entry, vector), by brute force."""
    steps = [
        """v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, k, x[k * len(x) // 4 + 1 : (k + 1) * len(x) // 4] AS x FROM v, range(4) AS u(k)),
b0 AS (SELECT k, r - 1 AS e, x FROM p WHERE r <= 256)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, k, min(d) AS d, arg_min(e, d * 256 + e) AS e
  FROM (SELECT r, k, e, CAST(list_sum(list_transform(range(1, len(p.x) + 1), lambda j: (p.x[j] - b.x[j]) * (p.x[j] - b.x[j]))) AS BIGINT) AS d FROM p JOIN b{i} b USING (k)) GROUP BY r, k)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT k, e, j, sum(x[j]) AS s, count(*) AS n FROM a{i} JOIN p USING (r, k), unnest(range(1, len(x) + 1)) AS u(j) GROUP BY k, e, j),
b{i + 1} AS (SELECT k, e, coalesce(n.x, b.x) AS x FROM b{i} b LEFT JOIN (SELECT k, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM m{i} GROUP BY k, e) n USING (k, e))""")
    return f"""
WITH {", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, e)) AS h FROM b{rounds}),
c AS (SELECT r, lower(string_agg(printf('%02x', e), '' ORDER BY k)) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN c USING (r), h"""


#: DuckDB SQL of the operators that SQL can express. The others need a tokenizer, a learned
#: model, a media format or a hash that DuckDB lacks; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_chosen_path_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
e AS (SELECT doc_id, unnest(g) AS x, len(g) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 5 * c >= 4 * (na + nb - c) UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.t = y.t AND x.doc_id <> y.doc_id),
cc AS (SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT l.b, cc.r FROM cc JOIN l ON l.a = cc.v),
k AS (SELECT v, min(r) AS class_id, count(*) AS n_class FROM cc GROUP BY v),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v AS doc_id, class_id, coalesce(n_links, 0) AS n_links, n_class FROM k LEFT JOIN n ON n.a = k.v""",
    "op8_suffix_substrings": r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(lower(hex(array_slice(b, i + 1, i + 400)))) AS h FROM d, unnest(range(0, n - 399)) AS u(i)),
f AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT *, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span
      FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, span),
q AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM s GROUP BY doc_id),
r AS (SELECT d.doc_id, n, b, coalesce(removed, 0) AS removed, coalesce(spans, 0) AS spans, list_concat([0], coalesce(ends, [])) AS from_, list_concat(coalesce(starts, []), [n]) AS to_ FROM d LEFT JOIN q USING (doc_id))
SELECT doc_id, n AS n_bytes, CAST(removed AS BIGINT) AS n_removed, spans AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(to_) + 1), lambda k: hex(array_slice(b, from_[k] + 1, to_[k]))), ''))) AS kept_sha256,
  -- the bytes of characters that a cut splits are left out
  decode(unhex(array_to_string(list_transform(range(1, len(to_) + 1), lambda k: regexp_replace(regexp_replace(hex(array_slice(b, from_[k] + 1, to_[k])),
    '^([89AB][0-9A-F])+', ''), '([C-F][0-9A-F]|[EF][0-9A-F][89AB][0-9A-F]|F[0-9A-F]([89AB][0-9A-F]){2})$', '')), ''))) AS text FROM r""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total FROM g),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.total + 5 * l.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
      FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 50""",
    "op13_orchard_codes": _codes_sql(),
}
