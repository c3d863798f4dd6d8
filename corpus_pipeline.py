"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it to the shared folder, reads it again as the next stage's ``docs`` and deletes the
one before. All but the last return the columns of ``documents``; columns that only
share a name with something an operator makes keep their values.

In every stage a null or empty text is a text without letters, lines or words:
language ID rejects it, the other stages, run on their own, keep it as it is.
Rows stand for themselves, also where a doc_id is null or repeated; only
near_dedup puts rows together, by their texts. Very long texts are handled
whole. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm import bpe, decontamination, language_id, line_dedup, near_dedup
from matchgrid.sources.store import discard, stored


#: Per cent of shared shingles from which two documents are near copies; op5's own contract says 85.
NEAR = 80
#: Benchmark items of fewer words are in too many clean documents to tell anything.
LEAST_WORDS = 3


def packed(docs: DataFrame) -> DataFrame:
    """(row, text): all columns but the text in one, where no operator's outputs replace them."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), "text")


def unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return found.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text is in a language that the labelled ones teach.

    Rejected are texts without a letter and texts that fit no known language: of
    which the best automaton knows no longer phrases than of random letters.
    """
    found = language_id.identify(packed(docs), language_id.trained(docs))
    return unpacked(found.filter((F.col("lang_pred") != "und") & F.col("fits")), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the lines that many documents share out of every text."""
    found = unpacked(line_dedup.drop_common_lines(packed(docs)), docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group; of repeated rows keep one.

    A row is known by doc_id and text. Where several texts of a group bear the
    doc_id that names it, the one whose digest sorts first stays.
    """
    found = near_dedup.labelled(docs.select("doc_id", "text", F.md5("text").alias("digest")), NEAR).filter("kept")
    rows = found.groupBy("doc_id", "top", "digest").agg(F.count("*").alias("times"))
    alone = F.when(F.col("top").isNull(), F.col("digest"))  # texts without words are in no group
    kept = rows.groupBy(F.col("doc_id").alias("kept_id"), "top", alone.alias("alone")).agg(F.min(F.struct("digest", "times")).alias("first"))
    kept = kept.select("kept_id", F.col("first.digest").alias("digest"), F.col("first.times").alias("times"))
    same = F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & F.md5("text").eqNullSafe(F.col("digest"))
    found = packed(docs).join(kept, same)
    once = unpacked(found.filter("times = 1"), docs)
    return once.unionByName(unpacked(found.filter("times > 1"), docs).dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which no benchmark item is found."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return unpacked(decontamination.contaminated(packed(docs), benchmark, least_words=LEAST_WORDS).filter(F.size("bench_hits") == 0), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digests(docs.select("doc_id", "text"), bpe.vocabulary_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
