"""A training-corpus pipeline: language, near copies, repeats, mix, sequences.

Each stage takes what the one before kept, with the columns of ``documents``; the last
returns the packed pieces. Columns beside those of ``documents`` are carried along, also
those with names that the operators use themselves; an empty table stays empty in every
stage; null and empty texts have no language and go in the first stage, and a stage that
is given them all the same treats them as its operator says. Whole texts are worked on,
however long. Repeated rows are one group of copies of which one stays, ties of which are
broken by the least identifier and then by content; the mix takes identical rows alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careweave.llm import chosen_path, common, mixing, packing, ppm, suffix

#: A text is rejected if no letter is in it or no language is likelier than all others.
MIN_LANGUAGE_SCORE = 0.5
#: Bytes of a passage that may not start twice. Of random windows of 51 words in the test
#: documents about one in a hundred is shorter; those are not found.
REPEAT_BYTES = 240


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a posterior of at least a half.

    Null and empty texts, and those without a letter, have none and go; equal texts go or
    stay together, however often a row is repeated; whole texts are judged, however long."""
    packed = docs.select(F.struct("*").alias("row"), "text")
    told = ppm.predict(packed, ppm.train(docs), id_col="row")
    return told.where((F.col("lang_pred") != ppm.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with 5-word Jaccard similarity of 0.8 or more.

    The one of the least identifier stays (null comes last, then the content decides);
    repeated rows are one group; null and empty texts are copies of each other; texts of
    fewer than five words are like their copies only; whole texts are compared."""
    return chosen_path.representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start twice; documents of nothing else go.

    Every copy of a passage goes, so rows that are repeated go whole if they are long
    enough; null and empty texts stay as they are; cut characters go with the passage;
    other columns stay, but for ``n_chars`` of a text that was cut."""
    _, stripped = suffix.strip(docs, length=REPEAT_BYTES, whole_characters=True)
    lost = stripped.where("n_removed > 0").select("key", F.col("kept").cast("string").alias("kept"))
    packed = docs.select(F.struct("*").alias("row"), common.text_key("text").alias("key")).join(lost, "key", "left")
    packed = packed.where(F.col("kept").isNull() | (common.word_count("kept") > 0))
    text = F.coalesce("kept", F.col("row.text"))
    changed = F.col("row").withField("text", text).withField("n_chars", F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.char_length("kept").cast("long")))
    return packed.select(changed.alias("row")).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, from no to three times.

    A null source is one of its own; texts without a word have no size and aren't taken;
    identical rows are taken alike; ties are broken by a hash of content and identifier."""
    packed = docs.select(F.struct("*").alias("row"), F.col("source").alias("from"), "text", common.text_key("text").alias("key"), "doc_id")
    packed = packed.withColumn("row_key", F.unhex(F.md5(F.concat(F.col("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))))
    taken, _, _ = mixing.mix(packed, F.array("from"), common.word_count("text"), id_col="row_key")
    # identical rows are taken alike
    times = taken.where("taken > 0").groupBy("row_key").agg(F.max(F.expr("taken div size")).cast("int").alias("times"))
    return packed.join(times, "row_key").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    Null and empty texts are an end token; repeated rows are packed each; texts of more than
    2048 tokens are cut; of an empty table there are no sequences."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("mixing", mixed),
    ("best-fit packing", sequences),
]

#: Neither the language model nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what goes between them is written once."""
    docs, began = common.documents(spark, sf_dir), common.n_tables()
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.clear(spark, began, keep=1)  # what the stage, and the one before it, wrote
    return STAGES[-1][1](spark, docs, sf_dir)
