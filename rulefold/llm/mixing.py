"""Mixing sources to target weights by hash-random keys and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulefold.llm.frames import col, written

ROWS_PER_RANGE = 2_000
ADDED = ["size", "source_size", "target", "epochs", "part"]


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space; null has none."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return (F.length(squeezed) - F.length(F.translate(squeezed, "w", ""))).cast("bigint")


def hash_key(id_: Column, seed: int) -> Column:
    """60 bits of the MD5 of the id and the seed: the same everywhere, and in SQL."""
    text = F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[float] | Mapping, max_epochs: float, budget: float = 1.0) -> DataFrame:
    """`sizes` with a column target: `budget` times all sizes shared by weight, no source above `max_epochs` times its size.

    What a source cannot take is shared again among the others by weight, until none is above. `sizes` has a row per
    source. A list of weights repeats over the sources in order of their code points, null last; a mapping names them.
    With R = cap / weight, sources meet their caps in order of R, so the final share per unit of weight follows from
    running sums in that order: no loop, whatever the number of sources.
    """
    order = Window.orderBy(F.col(source).isNull(), F.col(source).cast("binary"))
    if isinstance(weights, Mapping):
        weight = F.coalesce(*[F.when(F.col(source).eqNullSafe(F.lit(k)), F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
    else:
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    base = sizes.select("*", (F.row_number().over(order) - 1).alias("rank")).withColumn("weight", weight)
    base = base.withColumn("cap", F.col(size) * float(max_epochs)).withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("ratio").asc_nulls_last(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    weighs = F.col("weight") > 0
    base = base.select(
        "*", (F.sum(size).over(everything) * float(budget) - F.coalesce(F.sum(F.when(weighs, F.col("cap"))).over(before), F.lit(0.0))).alias("open_words"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum(F.when(weighs, F.col("weight"))).over(before), F.lit(0.0))).alias("open_weight"))
    # the first source not above its cap fixes the share per unit of weight of all that follow
    share = F.when(weighs, F.col("open_words") / F.col("open_weight"))
    level = F.min(F.when(F.col("ratio") >= share, F.struct("ratio", "rank", share.alias("share")))).over(everything)["share"]
    target = F.when(weighs, F.least(F.col("weight") * level, F.col("cap"))).otherwise(0.0)
    return base.select(*sizes.columns, target.alias("target"))


def mix(df: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: Sequence[float] | Mapping = (5, 2, 1),
        max_epochs: float = 3.0, budget: float = 1.0, seed: int = 17, size: Column | None = None, keep_columns: Sequence[str] | None = None) -> DataFrame:
    """Every row of `df` (`keep_columns`, all by default) with size, source_size, target, epochs (whole times taken) and part (words more).

    A document's key is a hash of its id and the seed. Rows are dealt into (source, range of keys); key ranges are equal
    parts of the hash space, so a source with a third of all rows is many ranges. Sums per range, running sums over the
    ranges of a source and running sums inside a range give each document's place on its source's line of words. A source
    is taken floor(target / size) times whole, then once more up to its exact budget: the document on the cut gives its
    first words. A source's taken words are its target rounded to whole words.

    Null texts and texts without words have size 0 and are taken whole times only. A null source is a source of its own, after all others.
    Equal ids are ordered by their text; equal rows are interchangeable. An empty table gives no rows. The same rows
    and seed give the same result. Columns of `df` that clash with the added ones must not be in `keep_columns`.
    """
    keep_columns = list(df.columns if keep_columns is None else keep_columns)
    clash = set(ADDED) & {c.lower() for c in keep_columns}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}")
    placed = _placed(df, source_col, text_col, id_col, weights, max_epochs, budget, seed, size, keep_columns)
    return placed.select(*[F.col("row")[c].alias(c) for c in keep_columns], *ADDED)


def _order(text_col: str, id_col: str, seed: int) -> list[Column]:
    """A document's place on its source's line: by key, then by a digest of its text."""
    return [hash_key(col(id_col), seed).alias("key"), F.md5(F.coalesce(col(text_col).cast("string"), F.lit(""))).alias("tie")]


def _placed(df, source_col, text_col, id_col, weights, max_epochs, budget, seed, size, keep_columns) -> DataFrame:
    """Columns src, row, key, tie and ADDED."""
    spark = df.sparkSession
    rows = df.select(
        col(source_col).alias("src"), F.struct(*[col(c) for c in keep_columns]).alias("row"),
        (word_count(col(text_col).cast("string")) if size is None else size).alias("size"),
        *_order(text_col, id_col, seed))
    sources = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    # a row per source, written once: the key ranges are fixed by it
    sources = written(spark, sources, "mix-sources")
    sources = sources.withColumn("ranges", F.ceil(F.col("rows") / ROWS_PER_RANGE))
    plan = source_targets(sources, "src", "source_size", weights, max_epochs, budget)
    plan = written(spark, plan, "mix-plan").alias("p")
    range_ = F.floor(F.col("key") / float(2**60) * F.col("ranges")).cast("int")
    ranged = rows.alias("r").join(plan, F.col("r.src").eqNullSafe(F.col("p.src"))).select(
        "r.src", "row", "size", "key", "tie", "source_size", "target", range_.alias("range"))
    sums = ranged.groupBy("src", "range").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("src", "range", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("before"))
    inside = Window.partitionBy("src", "range").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r").join(
        before.alias("b"), F.col("r.src").eqNullSafe(F.col("b.src")) & (F.col("r.range") == F.col("b.range")))
    words = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = words - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("inner"))).cast("bigint")
    return placed.select("r.src", "row", "key", "tie", "size", "source_size", "target", epochs.alias("epochs"), part.alias("part"))


def whole_documents(df: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: Sequence[float] | Mapping = (5, 2, 1),
                    max_epochs: float = 3.0, budget: float = 1.0, seed: int = 17) -> DataFrame:
    """The mix as rows of `df`: each document as often as it is taken whole, the one on the cut once more if over half of it fits.

    As documents lie by key, a source's cut is one place: a table of a row per source says how often all of its documents
    are taken and up to which place once more. Texts stay where they are read. Equal rows at a cut go the same way.
    """
    placed = _placed(df, source_col, text_col, id_col, weights, max_epochs, budget, seed, None, [id_col])
    last = F.max(F.when(2 * F.col("part") > F.col("size"), F.struct("key", "tie"))).alias("last")
    cuts = written(df.sparkSession, placed.groupBy("src").agg(F.max("epochs").alias("epochs"), last), "mix-cuts").alias("c")
    rows = df.select(F.struct("*").alias("row"), col(source_col).alias("src"), F.struct(*_order(text_col, id_col, seed)).alias("place")).alias("r")
    times = F.col("epochs") + F.coalesce(F.col("place") <= F.col("last"), F.lit(False)).cast("bigint")
    taken = rows.join(cuts, F.col("r.src").eqNullSafe(F.col("c.src"))).select("row", times.alias("times")).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select("row.*")
