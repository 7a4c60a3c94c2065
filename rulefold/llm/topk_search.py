"""Exact top-k search by inner product: term-at-a-time accumulation of weighted postings into dense score arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulefold.llm.frames import col, give_back, written


@dataclass(frozen=True)
class Settings:
    scale: int = 1024  # components become floor(scale * x)
    k: int = 10
    block: int = 4096  # vectors in one written block
    group: int = 1 << 17  # vectors that one task searches at a time; each query meets every group once


LARGEST = 2**31 - 1  # of a component, as an integer
BLOCK = "block bigint, n int, ids binary, unnamed binary, asked binary, size binary, term binary, weight binary"
NAMES = ["block", "n", "ids", "unnamed", "asked", "size", "term", "weight"]
KINDS = [pa.int64(), pa.int32(), *[pa.binary()] * 6]


@dataclass
class Vectors:
    """Sparse rows end to end: `size` terms and weights each. A row's key is its block and its place there."""

    key: np.ndarray
    ids: np.ndarray
    unnamed: np.ndarray  # whether the id is null
    asked: np.ndarray
    size: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    @staticmethod
    def read(row: dict) -> Vectors:
        place = np.arange(row["n"], dtype=np.int64)
        return Vectors(row["block"] * np.int64(1 << 20) + place, *(np.frombuffer(row[c], t) for c, t in zip(NAMES[2:], (np.int64, bool, bool, np.int32, np.int32, np.int32), strict=True)))

    @staticmethod
    def joined(parts: list[Vectors]) -> Vectors:
        return Vectors(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("key", "ids", "unnamed", "asked", "size", "term", "weight")))

    def largest(self) -> int:
        """A bound of any component's size."""
        return int(np.abs(self.weight.astype(np.int64)).max(initial=0))


def quantised(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors take part, their lengths, and their components floor(scale * x) end to end."""
    values = vectors.flatten().cast(pa.float64())
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.floor(scale * pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False))
    owner = np.repeat(np.arange(len(length)), length)
    usable = pc.is_valid(vectors).to_numpy(zero_copy_only=False).copy()
    usable[owner[~np.isfinite(x)]] = False
    x = x[usable[owner]]
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} as an integer")
    return usable, length[usable], x.astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors without their zeros; those that take no part are left out."""
    number = TaskContext.get().partitionId() << 22
    for batch in batches:
        usable, length, x = quantised(batch.column("vector"), s.scale)
        ids = batch.column("id").filter(pa.array(usable))
        unnamed, ids = pc.is_null(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()
        asked = pc.fill_null(batch.column("asked"), False).to_numpy(zero_copy_only=False)[usable]
        owner = np.repeat(np.arange(len(length)), length)
        term = np.arange(len(x)) - np.repeat(np.cumsum(length) - length, length)
        there = x != 0
        size, owner = np.bincount(owner[there], minlength=len(length)), owner[there]
        columns = [ids, unnamed, asked, size.astype(np.int32)]
        entries = [term[there].astype(np.int32), x[there].astype(np.int32)]
        ends = np.append(0, np.cumsum(size))
        rows = []
        for a in range(0, len(length), s.block):
            b = min(a + s.block, len(length))
            rows.append((number, b - a, *(c[a:b].tobytes() for c in columns), *(c[ends[a] : ends[b]].tobytes() for c in entries)))
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 8, KINDS, strict=True)], NAMES)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The query rows of each block, keys first."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            v = Vectors.read(row)
            if v.asked.any():
                entry = np.repeat(v.asked, v.size)
                rows.append((v.key[v.asked].tobytes(), v.ids[v.asked].tobytes(), v.size[v.asked].tobytes(), v.term[entry].tobytes(), v.weight[entry].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in list(zip(*rows, strict=True)) or [[]] * 5], ["key", "ids", "size", "term", "weight"])


class Postings:
    """Inverted lists of the vectors of a group, which are numbered by id: of equal scores, the smaller number wins."""

    def __init__(self, vectors: Vectors) -> None:
        order = np.lexsort((vectors.key, vectors.ids, vectors.unnamed))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.ids, self.unnamed = vectors.ids[order], vectors.unnamed[order]
        by_key = np.argsort(vectors.key)
        self.keys, self.number_of_key = vectors.key[by_key], number[by_key]
        self.largest = vectors.largest()
        row = np.repeat(number, vectors.size)
        order = np.lexsort((row, vectors.term))
        terms, first = np.unique(vectors.term[order], return_index=True)
        bounds = [*first.tolist(), len(order)]
        row, weight = row[order], vectors.weight[order].astype(np.int64)
        self.lists = {t: (row[a:b], weight[a:b]) for t, a, b in zip(terms.tolist(), bounds[:-1], bounds[1:], strict=True)}

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Every vector's inner product with a sparse row: each of its terms adds its weighted list into one dense array."""
        most = int(np.abs(weights).max(initial=0)) * self.largest * max(len(terms), 1)
        if most >= 2**63:
            raise OverflowError("an inner product may not fit 64 bits")
        out = np.zeros(len(self.ids), np.int64)
        for term, weight in zip(terms.tolist(), weights.tolist(), strict=True):
            rows, values = self.lists.get(term, (None, None))
            if rows is None:
                continue
            if len(rows) == len(out):  # all vectors have the term, in order
                out += weight * values
            else:
                out[rows] += weight * values  # a list has each vector once
        return out

    def best(self, scores: np.ndarray, own: int, k: int) -> np.ndarray:
        """The numbers of the k highest scores but that of the vector with key `own`, by partition selection."""
        n = k + 1
        if len(scores) <= n:
            found = np.arange(len(scores))
        else:
            least = np.partition(scores, len(scores) - n)[len(scores) - n]
            above = np.flatnonzero(scores > least)
            found = np.concatenate([above, np.flatnonzero(scores == least)[: n - len(above)]])
        at = int(np.searchsorted(self.keys, own))
        if at < len(self.keys) and self.keys[at] == own:
            found = found[found != self.number_of_key[at]]
        return found[np.lexsort((found, -scores[found]))][:k]


def _search(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows that arrive sorted by group, vectors before queries: the best of the group for each query."""
    group, parts, index = None, [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["group"] != group:
                group, parts, index = row["group"], [], None
            if not row["kind"]:
                parts.append(Vectors.read(row))
                continue
            if index is None:
                index = Postings(Vectors.joined(parts)) if parts else None
                parts = []
            if index is None:
                continue
            key, ids, size, term, weight = (np.frombuffer(row[c], t) for c, t in (("key", np.int64), ("ids", np.int64), ("size", np.int32), ("term", np.int32), ("weight", np.int32)))
            ends = np.append(0, np.cumsum(size))
            out = []
            for q in range(len(key)):
                entry = slice(ends[q], ends[q + 1])
                scores = index.scores(term[entry], weight[entry].astype(np.int64))
                best = index.best(scores, int(key[q]), s.k)
                out.append((np.full(len(best), key[q]), np.full(len(best), ids[q]), index.ids[best], index.unnamed[best], scores[best]))
            key, ids, found, unnamed, scores = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(found, pa.int64(), mask=unnamed), pa.array(scores)], ["key", "query_id", "vec_id", "score"])
    give_back()


def top_k(df: DataFrame, query: Column, settings: Settings | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score: for each row that `query` admits, the `k` other rows with the highest inner products.

    Components are floor(`scale` * x) with x as double, scores whole numbers. Ties go to the smaller id, a null id comes after all others. Every
    row but the query's own is a candidate, rows that repeat its id or vector too; a repeated query row is answered again. With fewer
    candidates than `k`, all are returned. Vectors that are null or hold null or non-finite components take no part, an empty one scores 0, and of
    vectors of different lengths the longer one's further components meet zeros. Components beyond 31 bits raise ValueError, inner products that may
    pass 63 bits OverflowError. Ids are bigint. An empty table gives no rows; other columns are ignored.

    Vectors are written once as blocks without zeros, and dealt in blocks to groups of about `group` vectors. Every block of queries goes to
    each group, behind its vectors. A task inverts its group, lets each query's terms add their weighted lists into a dense score
    array, and selects the best by partition; a query's rows from all groups are then merged by rank, limited before they are
    shuffled. A task holds one group and one score array, whatever the number of vectors or queries.
    """
    s = settings or Settings()
    spark = df.sparkSession
    rows = df.select(col(id_col).cast("bigint").alias("id"), col(vector_col).cast("array<double>").alias("vector"), query.cast("boolean").alias("asked"))
    blocks = written(spark, rows.mapInArrow(lambda b: _pack(b, s), BLOCK), "topk-blocks")
    size = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("blocks")).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(size["blocks"], max(-(-size["rows"] // s.group), partitions)))
    part, number = F.shiftright("block", 22), F.col("block").bitwiseAND(F.lit((1 << 22) - 1))
    placed = blocks.withColumn("group", F.pmod(number + F.pmod(F.xxhash64(part), F.lit(groups)), F.lit(groups)).cast("int"))  # a task's blocks go round the groups
    none = F.lit(None).cast("binary")
    stored = placed.select("group", F.lit(0).alias("kind"), *NAMES, none.alias("key"))
    asked = blocks.mapInArrow(_asked, "key binary, ids binary, size binary, term binary, weight binary")
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.select("group", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("n"), "ids", none.alias("unnamed"), none.alias("asked"), "size", "term", "weight", "key")
    dealt = stored.unionByName(asked).repartition(groups, "group").sortWithinPartitions("group", "kind")
    found = dealt.mapInArrow(lambda b: _search(b, s), "key bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
