"""Best-fit packing by exact complements on counts of lengths."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulefold.llm.bytelevel import Pieces, vocabulary
from rulefold.llm.frames import col, written
from rulefold.llm.text_arrays import chunks, utf8

CAPACITY = 1024
REMEMBERED = 200_000  # distinct pre-tokens whose ids a task keeps between batches
ROWS_PER_RANGE = 2_000


class Encoder:
    """Token ids of texts, the same as the tokenizer file's library gives; each distinct pre-token is merged once and remembered, up to a bound."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.vocabulary, self.remembered = vocabulary(path), remembered
        self.hashes, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _remember(self, pieces: Pieces) -> np.ndarray:
        """Places of the distinct pre-tokens of `pieces` among the remembered ones, those that are new merged and added."""
        at = np.minimum(np.searchsorted(self.hashes, pieces.hashes), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != pieces.hashes if len(self.hashes) else np.ones(len(pieces.hashes), bool)
        if not new.any():
            return at
        if len(self.hashes) + int(new.sum()) > self.remembered:
            self.hashes, self.sizes, self.ids = self.hashes[:0], self.sizes[:0], self.ids[:0]
            new = np.ones(len(pieces.hashes), bool)
        sizes, ids = self.vocabulary.merged_ids(pieces.data, pieces.begin[new], pieces.length[new])
        hashes, sizes, ids = np.append(self.hashes, pieces.hashes[new]), np.append(self.sizes, sizes), np.append(self.ids, ids)
        order, first = np.argsort(hashes), np.cumsum(sizes) - sizes
        self.hashes, self.sizes = hashes[order], sizes[order]
        self.ids = ids[np.arange(len(ids)) + np.repeat(first[order] - (np.cumsum(self.sizes) - self.sizes), self.sizes)]
        return np.searchsorted(self.hashes, pieces.hashes)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each text's ids."""
        pieces = Pieces(texts, self.vocabulary.special)
        at = self._remember(pieces)[pieces.inverse]
        item_size, item_first, flat = self.sizes[at], (np.cumsum(self.sizes) - self.sizes)[at], self.ids
        # a special string is one more item behind the pre-tokens of its part
        cut = pieces.after >= 0
        if cut.any():
            behind = np.cumsum(pieces.counts)[cut]
            flat = np.append(flat, self.vocabulary.special_ids)
            item_size = np.insert(item_size, behind, 1)
            item_first = np.insert(item_first, behind, len(self.ids) + pieces.after[cut])
        owner = np.repeat(pieces.owner, pieces.counts + cut)
        total = int(item_size.sum())
        at = np.arange(total) + np.repeat(item_first - (np.cumsum(item_size) - item_size), item_size)
        return flat[at], np.bincount(owner, weights=item_size, minlength=len(texts)).astype(np.int64)


def tokenised_pieces(df: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """One row per piece of each row of `df`: id, piece, start, length, ids_crc32, and ids if asked for.

    A document is its ids and the end id. A longer one than `capacity` is cut into pieces of `capacity` ids; the first
    piece takes what is left over, so a document has one short piece at most, and it comes first. Null and empty texts
    are the end id alone. Rows that repeat an id are documents of their own. Other columns are ignored.
    """
    rows = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_path)
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            texts = pc.fill_null(batch.column("text"), "")
            for i, j in chunks(offsets):
                ids, counts = encode(texts.slice(i, j - i).to_pylist())
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                pieces = -(-counts // capacity)
                owner = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                short = counts - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, short[owner] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[owner], capacity)
                first = (np.cumsum(counts) - counts)[owner] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                columns = [batch.column("id").slice(i, j - i).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    bounds = pa.array(np.append(first, len(ids)).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in one sequence, how many such sequences), from the number of pieces of each length.

    Longest length first. Its gap is looked up among the sums of one, two and three lengths that are still there,
    fewest and longest first; a combination that fills the gap exactly is used as often as the counts allow. A gap
    without an exact complement is a residual: it takes the length that fits best, and what then is left of it is looked up again, until nothing
    fits. The work depends on the lengths that occur, of which there are `capacity` at most, not on the number of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError("lengths must be from 1 to the capacity")
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            lengths = _sequence(left, longest, capacity)
            times = min(int(left[k]) // lengths.count(k) for k in lengths)
            plan.append((lengths, times))
            for k in lengths:
                left[k] -= times
    return plan


def _sequence(left: np.ndarray, longest: int, capacity: int) -> tuple[int, ...]:
    """Lengths of one sequence that starts with `longest`, within the counts `left`."""
    free = left.copy()
    free[longest] -= 1
    lengths, gap = [longest], capacity - longest
    while gap:
        exact = _complement(free, gap, longest)
        if exact:
            return (*lengths, *exact)
        fits = np.flatnonzero(free[1 : gap + 1])
        if not len(fits):
            break
        best = int(fits[-1]) + 1
        lengths.append(best)
        free[best] -= 1
        gap -= best
    return tuple(lengths)


def _complement(free: np.ndarray, gap: int, most: int) -> tuple[int, ...] | None:
    """The first combination of one, two or three lengths, none above `most`, that fills the gap within the counts `free`."""

    def pair(total: int, most: int) -> Iterator[tuple[int, int]]:
        low, high = (total + 1) // 2, min(total - 1, most)
        if low <= high:
            both = (free[low : high + 1] > 0) & (free[total - high : total - low + 1][::-1] > 0)
            for k in np.flatnonzero(both)[::-1]:
                a, b = low + int(k), total - low - int(k)
                if a != b or free[a] > 1:
                    yield a, b

    if gap <= most and free[gap]:
        return (gap,)
    for found in pair(gap, most):
        return found
    for a in np.flatnonzero(free[: min(gap - 2, most) + 1] > 0)[::-1].tolist():
        if 3 * a < gap:
            break
        for b, c in pair(gap - a, a):
            if free[a] >= 1 + (a == b) + (a == c):
                return a, b, c
    return None


def runs(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, first sequence, offset), sorted: the pieces of a length are numbered from 0, and a run of them goes to as many sequences."""
    used: Counter = Counter()
    out, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            out.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (id, piece, start, length, ids_crc32) with sequence_id and offset.

    The driver sees the number of pieces of each length, `capacity` rows at most, and plans on these. Pieces are
    numbered within their length: dealt into (length, hash range), counted, and numbered on from the counts of earlier
    ranges, so a length that a third of all pieces have is many ranges. The plan, a table of runs of numbers whose size depends
    on the capacity alone, goes to the tasks, where each piece finds its run by binary search. Equal pieces are interchangeable.
    An empty table gives no rows.
    """
    sizes = pieces.groupBy("length").count()
    plan = runs(plan_packing({r["length"]: r["count"] for r in sizes.collect()}, capacity))
    plan_keys = (plan[:, 0] << 44) + plan[:, 1]
    dealt = pieces.join(F.broadcast(sizes), "length").withColumn(
        "range", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.ceil(F.col("count") / ROWS_PER_RANGE))).drop("count")
    running = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "range").agg(F.count("*").alias("n")).select(
        "length", "range", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "range").orderBy("id", "piece", "start", "ids_crc32")
    numbered = dealt.withColumn("number", F.row_number().over(inside) - 1).join(before, ["length", "range"])
    numbered = numbered.select(*pieces.columns, (F.col("number") + F.col("before")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            run = np.searchsorted(plan_keys, (length << 44) + number, "right") - 1
            columns = [*batch.columns[:-1], pa.array(plan[run, 2] + number - plan[run, 1]), pa.array(plan[run, 3])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return numbered.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all rows of `df` with their sequence and offset; see `tokenised_pieces` and `pack`. Pieces are written once."""
    pieces = tokenised_pieces(df, tokenizer_path, end_id, capacity, id_col, text_col)
    return pack(written(df.sparkSession, pieces, "pieces"), capacity).withColumnRenamed("id", id_col)
