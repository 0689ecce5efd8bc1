"""Records from the test tables: documents as businesses of three sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.normalize import normalized, tokens


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, business_name (first six words), business_address (the next six, with numbers), country (lang), source 1 to 3, doc_id, seq."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    # The first twelve words alone are looked at, however long the text.
    start = F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), "^[^a-z0-9]*((?:[a-z0-9]+[^a-z0-9]+){0,11}(?:[a-z0-9]+)?)", 1)
    words = tokens(F.trim(F.regexp_replace(start, "[^a-z0-9]+", " ")))
    part = lambda at: F.array_join(F.slice("w", at, 6), " ")
    df = docs.withColumn("w", words).withColumn("source", (F.col("doc_id") % 3 + 1).cast("int"))
    return df.select(
        F.concat(F.lit("S"), "source", F.lit("-"), "doc_id").alias("entity_id"),
        part(1).alias("business_name"),
        F.concat_ws(" ", F.col("doc_id") % 40 + 10, part(7), F.col("doc_id") % 7 + 560000).alias("business_address"),
        F.col("lang").alias("country"),
        "source",
        "doc_id",
        (F.col("doc_id") + F.when(F.col("source") == 3, F.lit(1 << 40)).otherwise(0)).alias("seq"),
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Normalized (sources, targets)."""
    both = normalized(records(spark, sf_dir))
    return both.where("source = 1").drop("source", "doc_id"), both.where("source > 1").drop("source", "doc_id")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a source and a target of equal text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    key = docs.select(F.md5(F.col("text").cast("binary")).alias("k"), "doc_id", (F.col("doc_id") % 3 + 1).alias("s"))
    one = key.where("s = 1").select("k", F.concat(F.lit("S1-"), "doc_id").alias("s1_id"))
    return one.join(key.where("s > 1"), "k").select("s1_id", F.concat(F.lit("S"), F.col("s"), F.lit("-"), "doc_id").alias("target_id"))
