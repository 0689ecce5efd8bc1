"""From raw documents to packed sequences: toxicity, near copies, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. Stages cope with null ids and texts, empty
tables and further columns; each says what it does with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.mixing import repeat_by_mix
from tessera.llm.ngrams import ngram_join
from tessera.llm.packing import pack_documents
from tessera.llm.pii import redact
from tessera.llm.pii import train as train_field
from tessera.llm.toxicity import keep_clean
from tessera.llm.toxicity import train as train_toxicity

#: SQL can express neither the classifier nor the field; the stages are tested against brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with _key, a hash of the columns: rows of one key are the same in them, and no copy of the texts is written to tell them apart."""
    return docs.withColumn("_tessera_key", F.xxhash64(*[F.col(f"`{c}`") for c in columns]))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel classifier, trained on the table ``labels``, rejects go; null and empty texts stay."""
    return keep_clean(docs, train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 similar five-word sets join, the one of the smallest id stays (null first; of equal ids, one by a hash of the text; of repeated rows, any one); wordless ones all stay."""
    rows = _keyed(docs, "text")
    found = ngram_join(rows, doc_id="_tessera_key").where("linked AND n_shingles > 0").select(F.col("doc_id").alias("_tessera_key"), "component_id").distinct()
    members = rows.select("_tessera_key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("_tessera_id")).join(found, "_tessera_key")
    members = cut(members.groupBy("_tessera_key", "_tessera_id", "component_id").agg(F.count(F.lit(1)).alias("n")))
    first = members.groupBy("component_id").agg(F.min(F.struct("_tessera_id", "_tessera_key")).alias("first")).select(F.col("first._tessera_id").alias("_tessera_id"), F.col("first._tessera_key").alias("_tessera_key"))
    # The list of what goes grows with the input, so it is never broadcast: the stage is the same at every size.
    gone = members.join(first, ["_tessera_id", "_tessera_key"], "left_anti").select("_tessera_id", "_tessera_key")
    again = members.where("n > 1").join(first, ["_tessera_id", "_tessera_key"], "left_semi").select("_tessera_id", "_tessera_key")
    rows = rows.withColumn("_tessera_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).join(gone.hint("shuffle_merge"), ["_tessera_id", "_tessera_key"], "left_anti")
    if again.isEmpty():
        return rows.select(*docs.columns)
    once = rows.join(again, ["_tessera_id", "_tessera_key"], "left_semi").dropDuplicates(["_tessera_id", "_tessera_key"])
    return rows.join(again, ["_tessera_id", "_tessera_key"], "left_anti").unionByName(once).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in brackets, and n_chars follows; null texts stay null."""
    clean = redact(docs, train_field(docs))
    return clean.select(*[_length(docs) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def _length(docs: DataFrame) -> Column:
    return F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the weighted fair queue takes them, twice at most; documents without words, which no budget buys or excludes, stay once.

    The queue is shuffled by a hash of id, text and source, so the same
    documents give the same mix however they are stored. Rows that agree in
    all three are taken together.
    """
    return repeat_by_mix(_keyed(docs, "doc_id", "text", "source"), doc_id="_tessera_key").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("personal data", redact_personal_data), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
