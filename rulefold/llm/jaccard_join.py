"""Near-duplicates: a Jaccard join of word shingle sets in metric space, exact for every threshold above one half."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefold.llm.frames import col, give_back, hash_bucket, written
from rulefold.llm.graph import components
from rulefold.llm.text_arrays import LOWER, chunks, hash_spans, inside, join_hash, mix, ngrams, stretches, utf8, word_spans

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    words: int = 5  # in a shingle
    percent: int = 80  # two sets link when 100 * intersection >= percent * union; above 50
    sample: int = 5000  # documents that tell which shingles are frequent; changes the order of keys only, never the result
    frequent: int = 3  # documents of the sample that make a shingle frequent
    pivots: int = 8  # of a region that is split
    region: int = 2_000_000  # shingles of a region that one task joins; larger ones are split by pivots
    rounds: int = 4  # of splitting; what is then still larger is joined in blocks
    buckets: int = 1 << 20  # of hashes of ids, broadcast to leave out documents without candidates

    def __post_init__(self) -> None:
        if not 50 < self.percent <= 100:
            raise ValueError(f"percent must be above 50 and at most 100, not {self.percent}")

    @cached_property
    def small(self) -> int:
        """Shingles of the largest set that can link with one so small that the link breaks all its pairs; 1 if there is none."""
        most = max(n for n in range(1, 102) if 2 * (100 - self.percent) * n // 100 >= n - 1)
        return 100 * most // self.percent if most > 1 else 1

    @property
    def radius(self) -> float:
        return 1 - self.percent / 100

    def linked(self, both: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (left + right - both)


# --- sets ---------------------------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text in ASCII lower case; fewer words are one shingle."""
    data = LOWER[data]
    starts, lengths, firsts = word_spans(data, offsets)
    words = hash_spans(data, starts, lengths)
    grams, whole = ngrams(words, k), inside(firsts, k)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif n:
            out.append(mix(ngrams(words[a:b], n) + _U(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    assert len(grams) == len(whole)
    return out


def signature(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sets(batch: pa.RecordBatch, s: Settings) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = utf8(batch.column("text"))
    for i, j in chunks(offsets):
        yield i, shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], s.words)
    give_back()


# --- candidates ---------------------------------------------------------------------------------------------------


def frequent_shingles(rows: DataFrame, s: Settings) -> np.ndarray:
    """Shingles that a bounded sample of documents shares: a hint for the order of keys."""
    total = rows.count()
    share = min(1.0, s.sample / max(total, 1))
    picked = rows.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 32) < int(share * 2**32))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in _sets(batch, s):
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(found).tobytes()], pa.binary())], ["shingles"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_py(), np.uint64) for batch in batches for x in batch.column(0)]
        values, n = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([values[n >= s.frequent].tobytes()], pa.binary())], ["shingles"])

    found = picked.mapInArrow(sets, "shingles binary").repartition(1).mapInArrow(count, "shingles binary").collect()  # a bounded sample
    return np.sort(np.concatenate([np.frombuffer(bytes(r[0]), np.uint64) for r in found] or [np.zeros(0, np.uint64)]))


def keys_of(values: np.ndarray, frequent: np.ndarray, s: Settings) -> np.ndarray:
    """Hashes of the first neighbouring pairs of the set in a common order: by hash, frequent shingles last.

    If x and y link, a shingle of x alone breaks two of x's pairs at most, one of y alone breaks one. With |x| = n that
    is at most 2 (1 - t) n pairs, so one of the first 2 (1 - t) n + 1 pairs of x is also among those of y. Small sets have no more
    pairs than that: below a threshold of about two thirds, they and what can link with them have each shingle as a key too.
    """
    if len(values) < 2:
        return mix(values + _U(7)) if s.small > 1 else values[:0]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        late = frequent[at] == values
        values = np.concatenate([values[~late], values[late]])
    n = 2 * (100 - s.percent) * len(values) // 100 + 1
    first = values[: n + 1]
    pairs = join_hash(first[:-1], first[1:])
    return np.concatenate([pairs, mix(values + _U(7))]) if len(values) <= s.small else pairs


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys with the smallest id of each, and (id, smallest id) for the other ids of each key."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    least = ids[np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))] if len(ids) else ids
    edges = np.unique(np.stack([ids[~first], least[~first]], 1), axis=0)
    edges = edges[edges[:, 0] != edges[:, 1]]
    return keys[first], ids[first], edges[:, 0], edges[:, 1]


def candidate_edges(rows: DataFrame, frequent: np.ndarray, s: Settings) -> DataFrame:
    """Columns a, b: a graph in which documents that share a key are connected; two that link always share one.

    Keys leave the tasks as blocks of numpy arrays, one per bucket, in which a key occurs once with the smallest id that
    has it; its other ids become edges at once. So a key of a third of all documents is one entry per block. Edges leave in blocks
    too, and each is returned once.
    """
    spark = rows.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(frequent)

    def row(bucket: int, kind: int, left: np.ndarray, right: np.ndarray) -> tuple:
        return bucket, kind, left.tobytes(), right.tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for i, found in _sets(batch, s):
                keys = [keys_of(v, shared.value, s) for v in found]
                owner = np.repeat(ids[i : i + len(found)], [len(k) for k in keys])
                keys, owner, a, b = _stars(np.concatenate(keys), owner)
                at = (keys >> _U(20)) % _U(buckets)
                order = np.argsort(at, kind="stable")
                keys, owner, at = keys[order], owner[order], at[order]
                out = [row(int(at[x]), 0, keys[x:y], owner[x:y]) for x, y in stretches(at)]
                if len(a):
                    out.append(row(int(ids[i]) % buckets, 1, a, b))
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], NAMES)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = [], []
        for batch in batches:
            for kind, left, right in zip(*(batch.column(c) for c in ("kind", "left_", "right_")), strict=True):
                if kind.as_py():
                    yield by_node(np.frombuffer(left.as_py(), np.int64), np.frombuffer(right.as_py(), np.int64))
                else:
                    keys.append(np.frombuffer(left.as_py(), np.uint64))
                    ids.append(np.frombuffer(right.as_py(), np.int64))
        if keys:
            yield by_node(*_stars(np.concatenate(keys), np.concatenate(ids))[2:])

    def by_node(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        at = mix(a.view(np.uint64)) % _U(buckets // 4)
        order = np.argsort(at, kind="stable")
        a, b, at = a[order], b[order], at[order]
        out = [(int(at[x]), a[x:y].tobytes(), b[x:y].tobytes()) for x, y in stretches(at)]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "a", "b"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0, 2), np.int64)]
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                held.append(np.stack([np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.int64)], 1))
        found = np.unique(np.concatenate(held), axis=0)
        yield _edges(found[:, 0].copy(), found[:, 1].copy())

    dealt = rows.mapInArrow(blocks, "bucket int, kind int, left_ binary, right_ binary").repartition(buckets // 4, "bucket")
    # a pair of documents shares many keys: its edges meet again by document, and go on once
    return dealt.mapInArrow(meet, "bucket int, a binary, b binary").repartition(buckets // 4, "bucket").mapInArrow(merge, "a bigint, b bigint")


NAMES = ["bucket", "kind", "left_", "right_"]
KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


# --- regions ------------------------------------------------------------------------------------------------------


class Forest:
    """Union-find over numbers."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)


def overlaps(flat: np.ndarray, firsts: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Size of the intersection of each set (end to end in `flat`, none empty) with `pivot`, sorted."""
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    return np.add.reduceat((pivot[at] == flat).astype(np.int64), firsts)


def able_to_link(sets: list[np.ndarray], sizes: np.ndarray, s: Settings) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sets that can link at all, the most central first; for each, which of its shingles another one holds.

    A set's overlap with any other is at most the number of its shingles that another set holds. Central are sets whose shingles are
    held by many on average: the text that near copies were made from comes before them.
    """
    left = np.arange(len(sets))
    while len(left) > 1:
        firsts = np.append(0, np.cumsum(sizes[left])[:-1])
        _, at, holders = np.unique(np.concatenate([sets[k] for k in left]), return_inverse=True, return_counts=True)
        holders = holders[at]
        again = holders > 1
        shared = np.add.reduceat(again.astype(np.int64), firsts)
        able = 100 * shared >= s.percent * sizes[left]
        if 10 * able.sum() > 9 * len(left):
            order = np.flatnonzero(able)
            order = order[np.argsort(-(np.add.reduceat(holders, firsts) / sizes[left])[order], kind="stable")]
            parts = np.split(again, firsts[1:])
            return left[order], [parts[k] for k in order.tolist()]
        left = left[able]
    return left[:0], []


def join_region(sets: list[np.ndarray], s: Settings, forest: Forest | None = None) -> Forest:
    """Connects all sets that link, directly or through others.

    The most central set is the pivot. Sets within the radius of it are its cell and linked to it. A set outside the cell within
    two radii can link to one in the cell: those pairs are tested where the triangle inequality leaves a window. All sets
    outside the cell, such boundary sets among them, are joined likewise, with the next pivot. Sets of one cell
    are connected already, so their pairs are never looked at.

    No pair is counted out whose overlap must be too small: two sets share at most as many shingles of the first pivot as the one with fewer
    of them holds, and beside the pivot's at most as many of those that several sets hold.
    """
    forest = forest or Forest(len(sets))
    sizes = np.array([len(v) for v in sets], np.int64)
    left, again = able_to_link(sets, sizes, s)
    if len(left) < 2:
        return forest
    eps, slack = s.radius, 1e-9

    def against(pivot: int, others: np.ndarray) -> np.ndarray:
        return overlaps(np.concatenate([sets[k] for k in others]), np.append(0, np.cumsum(sizes[others])[:-1]), sets[pivot])

    held, beside = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)  # shingles of the first pivot, and others that several sets hold
    held[left] = against(left[0], left)
    for k, mask in zip(left.tolist(), again, strict=True):
        beside[k] = np.count_nonzero(mask & ~np.isin(sets[k], sets[left[0]], assume_unique=True)) if held[k] < len(mask) else 0

    def possible(k: int, others: np.ndarray) -> np.ndarray:
        most = np.minimum(held[others], held[k]) + np.minimum(beside[others], beside[k])
        return others[(100 + s.percent) * most >= s.percent * (sizes[others] + sizes[k])]

    while len(left) > 1:
        pivot, left = int(left[0]), left[1:]
        near = possible(pivot, left)
        both = against(pivot, near) if len(near) else near
        inside_ = s.linked(both, sizes[near], sizes[pivot])
        if not inside_.any():
            continue
        inner, inner_distance = near[inside_], (1 - both / (sizes[near] + sizes[pivot] - both))[inside_]
        for k in inner.tolist():
            forest.join(pivot, k)
        left = left[~np.isin(left, inner)]
        # beyond two radii in size alone, a set is beyond them
        outer = left[100 * np.minimum(sizes[left], sizes[pivot]) >= (2 * s.percent - 100) * np.maximum(sizes[left], sizes[pivot])]
        if not len(outer):
            continue
        both = against(pivot, outer)
        distance = 1 - both / (sizes[outer] + sizes[pivot] - both)
        for k, d in zip(outer.tolist(), distance.tolist(), strict=True):
            if d > 2 * eps + slack or forest.root(k) == forest.root(pivot):
                continue
            window = possible(k, inner[inner_distance >= d - eps - slack])
            for i in range(0, len(window), 64):
                some = window[i : i + 64]
                if s.linked(against(k, some), sizes[some], sizes[k]).any():
                    forest.join(k, pivot)
                    break
    return forest


def _joined(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Joins regions that arrive sorted; a region may span batches."""
    region, ids, sets = None, [], []

    def close() -> pa.RecordBatch:
        forest = join_region(sets, s)
        roots = [forest.root(k) for k in range(len(ids))]
        other = [k for k, r in enumerate(roots) if k != r]
        return _edges(np.array([ids[k] for k in other], np.int64), np.array([ids[roots[k]] for k in other], np.int64))

    for batch in batches:
        for name, id_, values in zip(*(batch.column(c).to_pylist() for c in ("region", "id", "shingles")), strict=True):
            if name != region and ids:
                yield close()
                ids, sets = [], []
            region = name
            ids.append(id_)
            sets.append(np.frombuffer(values, np.uint64))
    if ids:
        yield close()
    ids, sets = [], []
    give_back()


def split_regions(members: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """One round around a pivot of each region. Returns links (a, b) and the members that links may still connect to others; no row is copied.

    1. A document stays only if enough of its shingles are held by others of the region. 2. Candidates for the pivot are the most central
    documents, one from each of `s.pivots` parts; the one with the largest cell is the pivot, and its cell is linked to it. 3. Documents outside
    the cell stay, and those in it that can link to one outside: by the triangle inequality, and by sizes, as a set can
    link to none that is too large or too small for the shingles it shares.
    """
    spark = members.sparkSession
    name = ["region", "id", "row"]  # an id may come with several sets
    rows = members.select("region", "id", F.xxhash64("shingles").alias("row"), (F.length("shingles") / 8).cast("bigint").alias("size"), "shingles")
    rows = written(spark, rows.dropDuplicates(name), "jaccard-split")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("shingles"))
            lists = pa.ListArray.from_arrays(pa.array(offsets // 8, pa.int32()), pa.array(np.frombuffer(data.tobytes(), np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in name), lists], [*name, "held"])

    held = rows.select(*name, "shingles").mapInArrow(unpack, "region string, id bigint, row bigint, held array<bigint>")
    held = written(spark, held.select(*name, F.explode("held").alias("shingle")), "jaccard-shingles")
    holders = held.groupBy("region", "shingle").agg(F.count("*").alias("holders")).where("holders > 1")
    shared = held.join(holders, ["region", "shingle"]).groupBy(*name).agg(F.count("*").alias("shared"), F.sum("holders").alias("weight"))
    able = rows.drop("shingles").join(shared, name).where(F.col("shared") * 100 >= F.col("size") * s.percent)
    able = written(spark, able, "jaccard-able")

    part = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(s.pivots))
    one = F.struct(F.col("id").alias("pivot"), F.col("row").alias("pivot_row"), F.col("size").alias("pivot_size"))
    central = F.struct(F.col("weight") / F.col("size"), F.bitwise_not("id"), "row")
    chosen = able.groupBy("region").agg(F.array_compact(F.array(*[F.max_by(one, F.when(part == k, central)) for k in range(s.pivots)])).alias("pivots"))
    chosen = written(spark, chosen.select("region", F.inline("pivots")), "jaccard-pivots")
    theirs = held.join(chosen, (held["region"] == chosen["region"]) & (held["id"] == chosen["pivot"]) & (held["row"] == chosen["pivot_row"]))
    theirs = theirs.select(held["region"], "shingle", "pivot", "pivot_row", "pivot_size")
    both = held.join(theirs, ["region", "shingle"]).groupBy(*name, "pivot", "pivot_row", "pivot_size").agg(F.count("*").alias("both"))
    union = F.col("size") + F.col("pivot_size") - F.col("both")
    link = F.col("both") * 100 >= union * s.percent
    met = written(spark, able.join(both, name).withColumn("link", link).withColumn("distance", 1 - F.col("both") / union), "jaccard-met")
    cells = met.groupBy("region", "pivot", "pivot_row").agg(F.count_if("link").alias("cell"))
    best = cells.groupBy("region").agg(F.max_by(F.struct("pivot", "pivot_row"), F.struct("cell", F.bitwise_not("pivot"), "pivot_row")).alias("best")).select("region", "best.*")
    met = met.join(best, ["region", "pivot", "pivot_row"])
    links = met.where("link AND id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))

    assigned = able.join(met.select(*name, "pivot", "link", "distance"), name, "left")
    assigned = assigned.withColumn("link", F.coalesce("link", F.lit(False))).withColumn("distance", F.coalesce("distance", F.lit(1.0)))
    # the largest set with which the shingles that a set shares are enough for a link
    largest = F.floor(F.col("shared") * (100 + s.percent) / s.percent + 1e-6) - F.col("size")
    assigned = written(spark, assigned.withColumn("largest", largest), "jaccard-assigned")
    outside = assigned.where("NOT link").groupBy("region").agg(
        F.min("distance").alias("rim"), F.min("size").alias("out_size"), F.max("largest").alias("out_largest"))
    stay = assigned.join(outside, "region").where(~F.col("link") | (
        (F.col("distance") >= F.col("rim") - s.radius - 1e-9) & (F.col("size") <= F.col("out_largest")) & (F.col("largest") >= F.col("out_size"))))
    return links, rows.join(stay.select(*name), name, "left_semi").select("region", "id", "shingles")


def link_edges(members: DataFrame, s: Settings) -> DataFrame:
    """Columns a, b: edges that connect exactly the documents of `members` (region, id, shingles) that links connect within a region."""
    spark = members.sparkSession
    links, before = [], None
    for round_ in range(s.rounds + 1):
        size = members.groupBy("region").agg(F.sum(F.length("shingles") / 8).alias("size"))
        large = written(spark, size.where(F.col("size") > s.region), "jaccard-large")
        blocks, again, name = members, large, F.col("region")
        if before is not None or round_ == s.rounds:  # what a round has not halved, or is left after the last one, is joined in pairs of blocks
            stuck = large if round_ == s.rounds else large.join(before.withColumnRenamed("size", "was"), "region").where("2 * size > was").select("region", "size")
            stuck = written(spark, stuck, "jaccard-stuck")
            again = large.join(stuck, "region", "left_anti")
            n = F.coalesce(F.ceil(F.col("size") / s.region), F.lit(1)).cast("int")
            mine = F.pmod(F.xxhash64("id", F.lit(9)), F.col("n")).cast("int")
            blocks = members.join(stuck, "region", "left").withColumn("n", n).withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            blocks, name = blocks.where("i <> j OR n = 1"), F.concat_ws("/", "region", F.least("i", "j"), F.greatest("i", "j"))
        small = blocks.join(again, "region", "left_anti").select(name.alias("region"), "id", "shingles")
        dealt = small.repartition("region").sortWithinPartitions("region", "id")
        links.append(dealt.mapInArrow(lambda b: _joined(b, s), "a bigint, b bigint"))
        if round_ == s.rounds or again.isEmpty():
            break
        more, members = split_regions(members.join(again, "region", "left_semi"), s)
        links.append(more)
        members = written(spark, members, "jaccard-regions")
        before = large
    out = links[0]
    for part in links[1:]:
        out = out.unionByName(part)
    return out


def near_duplicates(df: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id, n_shingles (distinct), component_id (smallest id reachable by links, its own included).

    Sets are of `words`-word shingles of the whole text in ASCII lower case; fewer words are one shingle. Null and empty texts have
    none and no links. Rows that repeat an id are one document with the links of all its texts. Rows with a null id are
    returned with a null component. An empty table gives no rows; other columns are ignored. Shingles are 64-bit
    hashes; a set is at most as large as its text.

    1. Equal sets are one: only the smallest id of each goes on. 2. Documents that share a key (see `keys_of`) fall into one region: no link leaves
    a region. 3. Each region is joined around pivots (`join_region`), large ones after splitting (`split_regions`). 4. Links are
    connected. Nothing grows with the square of a group: cells are connected through their pivots.
    """
    s = settings or Settings()
    spark = df.sparkSession
    rows = df.select(col(id_col).cast("bigint").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in _sets(batch, s):
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(i, len(found)), pa.array([len(v) for v in found], pa.int64()),
                    pa.array([signature(v) for v in found], pa.binary())], ["id", "n", "signature"])

    described = written(spark, rows.mapInArrow(describe, "id bigint, n bigint, signature binary"), "jaccard-sets")
    usable = described.where("id IS NOT NULL AND n > 0")
    least = usable.groupBy("signature").agg(F.min("id").alias("least"))
    equal = usable.join(least, "signature").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    known = rows.where("id IS NOT NULL")
    near = written(spark, candidate_edges(known, frequent_shingles(known, s), s), "jaccard-candidates")
    regions = written(spark, components(near.unionByName(equal)), "jaccard-components")
    # members: one document of each distinct set of a region with more than one
    members = least.join(regions, F.col("least") == F.col("node")).select(F.col("least").alias("id"), "signature", F.col("component").cast("string").alias("region"))
    several = members.groupBy("region").agg(F.count("*").alias("sets")).where("sets > 1")
    members = written(spark, members.join(several, "region", "left_semi"), "jaccard-members")
    buckets = F.broadcast(members.select(hash_bucket(F.col("id"), s.buckets).alias("bucket")).distinct())  # at most s.buckets numbers
    texts = known.join(buckets, hash_bucket(F.col("id"), s.buckets) == F.col("bucket"), "left_semi").join(members, "id")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = batch.column("signature").to_pylist()
            for i, found in _sets(batch, s):
                same = [k for k, v in enumerate(found, i) if signature(v) == signatures[k]]
                yield pa.RecordBatch.from_arrays([
                    batch.column("region").take(pa.array(same, pa.int64())), batch.column("id").take(pa.array(same, pa.int64())),
                    pa.array([found[k - i].tobytes() for k in same], pa.binary())], ["region", "id", "shingles"])

    sets = written(spark, texts.select("id", "signature", "region", "text").mapInArrow(load, "region string, id bigint, shingles binary"), "jaccard-members")
    links = written(spark, link_edges(sets, s).unionByName(equal).distinct(), "jaccard-links")
    final = components(links)
    return described.join(final, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
