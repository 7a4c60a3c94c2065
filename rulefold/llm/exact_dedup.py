"""Exact duplicates by distributed radix partitioning on successive bytes of the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefold.llm.frames import BLANKS, col, fresh, written

FIRST_DIGIT = 64  # bytes of the first digit; each later one is GROWTH times as wide
GROWTH = 4
BUCKETS = 1 << 20  # of hashes that are broadcast to pass rows by early; whatever passes is joined exactly


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def _bucket(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT) -> DataFrame:
    """One row per row of `df`: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when their UTF-8 bytes are, after each run of white space became one space. Most significant
    digits first: a group of texts with equal leading bytes is dealt out by its next digit until it has one member or
    its texts have ended. A digit's bytes themselves are the key, so equality rests on bytes; the SHA-256 is output, and
    with the id it names a group. Of a group, the row with the smallest id stays.

    Null texts count as empty, empty texts are equal to each other. A null id counts as larger than all others. Of rows
    that repeat an id and a text each is returned and one can stay. An empty table gives no rows; other columns are ignored.

    Each round counts rows per (group, digit) with map-side sums, so a group with a third of all rows is one row per
    task, and joins the counts back with a join that adaptive execution splits. Texts move only once their first digit
    is shared: a broadcast set of at most `BUCKETS` hashes of shared digits passes by the others. Rows that are done
    leave with the round. Rounds grow with the logarithm of the longest repeated text.
    """
    spark = df.sparkSession
    rows = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    tagged = F.struct("id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("sha"))
    least = F.min_by("tag", F.struct(F.col("tag.id").isNull(), "tag"))
    digit = F.substring(normalised(F.col("text")).cast("binary"), 1, first_digit)
    groups = rows.select(digit.alias("digit"), tagged.alias("tag")).groupBy("digit").agg(F.count("*").alias("n"), least.alias("g"))
    groups = written(spark, groups, "exact-dedup")
    done = [groups.where("n = 1").select(F.col("g").alias("tag"), "g", "n")]
    shared = groups.where("n > 1")
    buckets = shared.select(_bucket(F.col("digit")).alias("bucket")).distinct()
    moving = rows.select("id", "text", digit.alias("digit")).join(F.broadcast(buckets), _bucket(F.col("digit")) == F.col("bucket"), "left_semi")
    joined = moving.alias("r").join(shared.alias("c"), "digit").select(F.col("r.id").alias("id"), F.col("r.text").alias("text"), "digit", "c.n", "c.g")
    start, width = 1, first_digit
    while True:
        ended = (F.col("n") == 1) | (F.length("digit") < width)
        if start == 1:
            joined = joined.withColumn("tag", tagged)
        out = written(spark, joined.select("tag", F.when(~ended, F.col("text")).alias("text"), "g", "n", ended.alias("ended")), "exact-dedup")
        done.append(out.where("ended").select("tag", "g", "n"))
        left = out.where("NOT ended")
        if left.isEmpty():
            break
        start, width = start + width, width * GROWTH
        rows = left.select("tag", "text", "g", F.substring(normalised(F.col("text")).cast("binary"), start, width).alias("digit"))
        groups = rows.groupBy("g", "digit").agg(F.count("*").alias("n"), least.alias("least"))
        same = F.col("r.g").eqNullSafe(F.col("c.g")) & (F.col("r.digit") == F.col("c.digit"))
        joined = rows.alias("r").join(groups.alias("c"), same).select(
            "r.tag", "r.text", F.col("r.digit").alias("digit"), F.col("c.n").alias("n"), F.col("c.least").alias("g"))
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    first = F.col("tag").eqNullSafe(F.col("g"))
    # rows with one id and one text cannot be told apart: they leave as copies of which one stays
    lone = result.where(~first | (F.col("n") == 1)).withColumn("kept", F.col("n") == 1)
    copies = result.where(first & (F.col("n") > 1)).groupBy("tag", "g", "n").agg(F.count("*").alias("m"))
    copies = copies.select("tag", "g", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), "m")).alias("i"))
    result = lone.unionByName(copies.select("tag", "g", "n", (F.col("i") == 1).alias("kept")))
    return result.select(F.col("tag.id").alias(id_col), F.col("g.id").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("tag.sha").alias("text_sha256"))


def without_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that `exact_dedup` keeps, all columns as they are; of rows that repeat an id and a text, the first by its JSON.

    Rows whose id shares no hash bucket with a dropped row's stay where they are; only the others are joined.
    """
    spark = df.sparkSession
    found = written(spark, exact_dedup(df, id_col, text_col).select(F.col(id_col).alias("id"), "kept", F.col("text_sha256").alias("sha")), "exact-dedup")
    touched = found.where("NOT kept").select(_bucket(F.col("id")).alias("bucket")).distinct()
    (bucket,) = fresh(df, "bucket")
    touched = F.broadcast(touched.withColumnRenamed("bucket", bucket))
    on_bucket = _bucket(col(id_col)) == F.col(bucket)
    rest = df.join(touched, on_bucket, "left_semi").select(F.struct("*").alias("row"), col(id_col).alias("id"), F.sha2(normalised(col(text_col)).cast("binary"), 256).alias("sha"))
    kept = found.where("kept").select("id", "sha").alias("k")
    rest = rest.alias("r").join(kept, F.col("r.id").eqNullSafe(F.col("k.id")) & (F.col("r.sha") == F.col("k.sha")), "left_semi")
    rest = rest.groupBy("id", "sha").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return df.join(touched, on_bucket, "left_anti").unionByName(rest)
