"""From raw documents to packed training sequences: stages whose results are written and read again.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; the last one returns packed pieces. Columns
of `docs` beside those are carried along, whatever their names: stages rename what they add.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.llm.classifier import fit, score
from rulefold.llm.exact_dedup import without_duplicates
from rulefold.llm.frames import fresh, hash_bucket, written
from rulefold.llm.jaccard_join import near_duplicates
from rulefold.llm.mixing import whole_documents
from rulefold.llm.packing import pack_documents
from rulefold.session import table


LEAST_QUALITY = 0.7
TOKENIZER = "byte_bpe_50k.json"
BUCKETS = 1 << 20  # of hashes of row keys, broadcast to leave out rows that stay for sure


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least `LEAST_QUALITY`; it learns from the labelled ones among them outside the held-out fold."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    weights = fit(docs, table(spark, sf_dir, "labels"), remainder != 2)
    (name,) = fresh(docs, "score")
    return score(docs, weights, score_col=name).where(F.col(name) >= LEAST_QUALITY).drop(name)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space, the row with the smallest id; texts stay as they are."""
    return without_duplicates(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links (five-word shingles, Jaccard similarity of 0.8 or more), the row with the smallest id.

    Each row is a document of its own, by a key that a written copy of the rows holds. So near copies among rows with a null id are found
    (a null is the largest id), and of rows that repeat an id only those go whose own text is linked to a row that stays.
    """
    key, bucket, out = fresh(docs, "row_key", "bucket", "dropped")
    keyed = written(spark, docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-near-duplicate-rows")
    found = near_duplicates(keyed, id_col=key).select(F.col(key).alias("member"), F.col("component_id").alias("component"))
    linked = written(spark, found.where("member <> component"), "pipeline-near-duplicate-links")
    members = linked.unionByName(linked.select(F.col("component").alias("member"), "component").distinct())
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"))
    stay = members.join(ids, F.col("member") == F.col("row")).groupBy("component").agg(F.min(F.struct("last", "id", "row")).alias("first"))
    dropped = members.select("member").join(stay.select(F.col("first.row").alias("stays")), F.col("member") == F.col("stays"), "left_anti")
    dropped = written(spark, dropped, "pipeline-near-duplicates")
    # texts are shuffled only where the hash of a key is that of a dropped one
    dropped = dropped.withColumnRenamed("member", out)
    buckets = F.broadcast(dropped.select(hash_bucket(F.col(out), BUCKETS).alias(bucket)).distinct())
    mine = hash_bucket(F.col(key), BUCKETS) == F.col(bucket)
    some = keyed.join(buckets, mine, "left_semi").join(dropped, F.col(key) == F.col(out), "left_anti")
    return keyed.join(buckets, mine, "left_anti").unionByName(some).drop(key)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1, repeating; none is taken over 3 times; taken documents are whole, once per taking."""
    return whole_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens; a document that was taken twice is packed twice."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
