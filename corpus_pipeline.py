"""The corpus pipeline: quality rules, near duplicates, personal data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), where docs is what the stage before it kept, and returns a
DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from wattspark.llm import jaccard, packing, pii, quality
from wattspark.llm import textkit as K
from wattspark.llm.tokens import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark, docs, sf_dir):
    """Drops the documents that the quality rules reject."""
    return quality.quality_verdicts(docs).where("kept").select(*COLUMNS)


def keep_distinct(spark, docs, sf_dir):
    """Keeps one document of each group of near duplicates: that with the smallest doc_id.

    Rows whose doc_id is null or repeats are documents of their own and come after all others, in no fixed order: one row of copies that have
    the same id, or none, stays too. Empty texts are near nothing and stay; an empty table stays empty.
    """
    from pyspark.sql import functions as F

    repeats = docs.groupBy("doc_id").count().where("doc_id is null or count > 1").select("doc_id")
    if repeats.isEmpty():
        spare = jaccard.components(docs).where("doc_id != component_id").select("doc_id")
        return docs.join(spare, "doc_id", "left_anti").select(*COLUMNS)
    marked = docs.join(repeats.where("doc_id is not null").withColumn("_again", F.lit(True)), "doc_id", "left")
    own = F.when(F.col("doc_id").isNull() | F.col("_again"), F.struct(F.lit(1).alias("late"), F.monotonically_increasing_id().alias("id"))).otherwise(F.struct(F.lit(0).alias("late"), F.col("doc_id").alias("id")))
    rows = K.saved(marked.select(*COLUMNS, own.alias("_own")), spark, "rows-with-keys")
    # The late rows' keys follow the largest id that is there once.
    top = rows.where("_own.late = 0").agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("m")).first()["m"]
    rows = rows.withColumn("_key", F.when(F.col("_own.late") == 1, F.lit(top) + 1 + F.col("_own.id")).otherwise(F.col("doc_id")))
    spare = jaccard.components(rows.select(F.col("_key").alias("doc_id"), "text")).where("doc_id != component_id").select(F.col("doc_id").alias("_key"))
    return rows.join(spare, "_key", "left_anti").select(*COLUMNS)


def redact(spark, docs, sf_dir):
    """Puts the kind in place of each span of personal data; n_chars follows."""
    from pyspark.sql import functions as F

    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint"))).select(*COLUMNS)


def pack(spark, docs, sf_dir):
    """Packs the documents left into training sequences."""
    return packing.pack_ids(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("near_duplicates", keep_distinct), ("pii", redact), ("packing", pack)]
#: Near duplicates, trees and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = K.saved(stage(spark, docs, sf_dir), spark, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
