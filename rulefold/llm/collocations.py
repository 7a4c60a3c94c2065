"""Collocated phrases: n-grams whose parts occur together more than chance, mined through mergeable Misra-Gries summaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulefold.llm.frames import col, give_back, written
from rulefold.llm.text_arrays import LOWER, chunks, hash_spans, join_hash, joined_words, mix, stretches, utf8, word_spans

_U = np.uint64
CUT = np.zeros(256, bool)  # bytes that end a piece
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = CUT.copy()  # bytes between words
GAP[[0x20, 0x09]] = True
SLICE = 20  # log2 of the bits of a slice of a table


@dataclass(frozen=True)
class Settings:
    least: int = 100  # occurrences of a candidate
    longest: int = 5  # words of a candidate; 2 or more
    top: int = 2000  # phrases of a language
    summary: int = 1 << 21  # counters that a hash partition is meant to need; sets how many partitions there are
    bits: int = 26  # log2 of the bits of the table of a round's survivors, which goes to every task; more only save work
    held: int = 1 << 20  # distinct n-grams that a task gathers before it hands them on


# --- summaries ----------------------------------------------------------------------------------------------------


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class Summary:
    """A Misra-Gries summary of weighted keys, merged from summaries of parts of them.

    Whenever there are more than `capacity` counters, the largest that has to go is taken off all of them: that takes `capacity` + 1 times
    as much off the mass, so all that is ever taken off one counter, `lost`, stays below mass / capacity. A part that its task counted in full is
    a summary that lost nothing.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if (over := len(keys) - self.capacity) > 0:
            off = int(np.partition(counts, over - 1)[over - 1])
            self.lost += off
            keys, counts = keys[counts > off], counts[counts > off] - off
        self.keys, self.counts = keys, counts

    def at_least(self, least: int) -> np.ndarray:
        """All keys that may have that many occurrences."""
        return self.keys[self.counts + self.lost >= least]


class Table:
    """A fixed number of bits, told by hash: which keys may have survived."""

    def __init__(self, packed: np.ndarray, bits: int) -> None:
        self.packed, self.bits = packed, bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = mix(keys) >> _U(64 - self.bits)
        return (self.packed[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)


# --- n-grams ------------------------------------------------------------------------------------------------------


class Words:
    """The words of some texts, with 64-bit hashes that differ by language."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, salts: np.ndarray) -> None:
        self.data = LOWER[data]
        self.starts, self.lengths, self.firsts = word_spans(self.data, offsets, GAP)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.firsts))
        self.hashes = join_hash(salts[self.text], hash_spans(self.data, self.starts, self.lengths))
        self.piece = np.cumsum(CUT[self.data])[self.starts] + self.text if len(self.starts) else self.text

    def grams(self, tables: dict[int, Table], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For 1, 2, ... words: first words and keys of the n-grams that may have survived, as far as tables tell.

        An n-gram is followed only if both n-grams of one word less in it were: every occurrence of a frequent one is, as its parts are as frequent.
        """
        at, keys = np.arange(len(self.hashes)), self.hashes
        for n in range(1, longest + 1):
            if n in tables:
                known = tables[n].has(keys)
                at, keys = at[known], keys[known]
            yield n, at, keys
            go = at[1:] == at[:-1] + 1
            if n == 1:
                go &= self.piece[at[1:]] == self.piece[at[:-1]]
            at, keys = at[:-1][go], keys[:-1][go]
            keys = join_hash(keys, self.hashes[at + n])

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        word = (at[:, None] + np.arange(n)).ravel()
        return joined_words(self.data, self.starts[word], self.lengths[word], np.repeat(np.arange(len(at)), n), len(at))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array]]:
    """Words of about 2 MB of texts at a time, and the language of each text."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        names, bounds = utf8(batch.column("lang"))
        salts = hash_spans(names, bounds[:-1], np.diff(bounds))
        for i, j in chunks(offsets):
            yield Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], salts[i:j]), batch.column("lang").slice(i, j - i)
        give_back()


BLOCK = "bucket int, kind int, mass bigint, keys binary, counts binary"
BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _tally(batches: Iterator[pa.RecordBatch], s: Settings, sizes: range, tables: dict[int, Table], buckets: int) -> Iterator[pa.RecordBatch]:
    """N-grams of the given sizes, counted, as blocks by hash partition (kind 1), and the mass of each (kind 0)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def blocks() -> pa.RecordBatch:
        keys, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        bucket = (keys >> _U(16)) % _U(buckets)
        order = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[order], counts[order], bucket[order]
        rows = []
        for a, b in stretches(bucket):
            rows.append((int(bucket[a]), 0, int(counts[a:b].sum()), b"", b""))
            rows.append((int(bucket[a]), 1, 0, keys[a:b].tobytes(), counts[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, BLOCK_TYPES, strict=True)], BLOCK.replace(",", "").split()[::2])

    for words, _ in _texts(batches):
        found = [keys for n, _, keys in words.grams(tables, sizes[-1]) if n in sizes]
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        held.append((keys, counts))
        if sum(len(k) for k, _ in held) >= s.held:
            held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            if 2 * len(held[0][0]) >= s.held:
                yield blocks()
                held = []
    if held:
        yield blocks()


def _survivors(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Places in the table of the n-grams that survive their partition's summary, by slice, and the partition's mass (slice -1).

    Rows arrive sorted by partition, its masses first: so the capacity, mass / `least`, is known before the first block. With it, less than `least` is
    taken off any counter, and no n-gram with that many occurrences is lost.
    """
    bucket, mass, summary, held, waiting = None, 0, None, [], 0

    def merge() -> None:
        nonlocal held, waiting
        if held:
            summary.merge(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held, waiting = [], 0

    def close() -> pa.RecordBatch:
        merge()
        place = np.sort(mix(summary.at_least(s.least)) >> _U(64 - s.bits))
        part = (place >> _U(SLICE)).astype(np.int64)
        place = (place & _U((1 << SLICE) - 1)).astype(np.uint32)
        rows = [(int(part[a]), 0, place[a:b].tobytes()) for a, b in stretches(part)] + [(-1, mass, b"")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["slice", "mass", "places"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                if summary:
                    yield close()
                bucket, mass, summary = row["bucket"], 0, None
            if not row["kind"]:
                mass += row["mass"]
                continue
            summary = summary or Summary(mass // s.least)
            held.append((np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64)))
            waiting += len(held[-1][0])
            if waiting > max(1 << 18, len(summary.keys)):
                merge()
    if summary:
        yield close()
    give_back()


def _slices(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """The bits of each slice; rows arrive sorted by slice."""
    number, bits = None, np.zeros(1 << min(SLICE, s.bits), np.uint8)

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    for batch in batches:
        for part, places in zip(batch.column("slice").to_pylist(), batch.column("places").to_pylist(), strict=True):
            if part != number:
                if number is not None:
                    yield packed()
                    bits[:] = 0
                number = part
            bits[np.frombuffer(places, np.uint32)] = 1
    if number is not None:
        yield packed()


def survivors(rows: DataFrame, sizes: range, tables: dict[int, Table], mass: int, s: Settings) -> tuple[Table, int]:
    """The table of n-grams of the given sizes that may occur `least` times, and the mass of all that was counted; `mass` is a bound of it."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(tables)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-mass // (s.least * s.summary)))
    dealt = rows.mapInArrow(lambda b: _tally(b, s, sizes, shared.value, buckets), BLOCK).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    found = written(spark, dealt.mapInArrow(lambda b: _survivors(b, s), "slice int, mass bigint, places binary"), "collocation-survivors")
    slices = 1 << max(s.bits - SLICE, 0)
    bits = found.where("slice >= 0").repartition(min(parts, slices), "slice").sortWithinPartitions("slice").mapInArrow(lambda b: _slices(b, s), "slice int, bits binary")
    packed = np.zeros(1 << (s.bits - 3), np.uint8)
    for row in bits.collect():  # 2 ** (bits - 3) bytes at most
        at = row["slice"] << (SLICE - 3)
        packed[at : at + len(row["bits"])] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return Table(packed, s.bits), found.agg(F.coalesce(F.sum("mass"), F.lit(0))).first()[0]


COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch], s: Settings, tables: dict[int, Table], buckets: int) -> Iterator[pa.RecordBatch]:
    """Occurrences of the surviving n-grams with their words, and of all words by language (a null phrase), as blocks by hash partition."""
    held: list[tuple[np.ndarray, pa.Table]] = []

    def merged() -> tuple[np.ndarray, pa.Table]:
        keys, rows = np.concatenate([k for k, _ in held]), pa.concat_tables(r for _, r in held)
        one, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        total = np.zeros(len(one), np.int64)
        np.add.at(total, inverse, rows["n"].to_numpy())
        return one, rows.take(pa.array(first)).set_column(3, "n", pa.array(total)).combine_chunks()

    def blocks(keys: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        bucket = (keys >> _U(16)) % _U(buckets)
        order = np.argsort(bucket, kind="stable")
        rows, parts = rows.take(pa.array(order)), stretches(bucket[order])
        return pa.RecordBatch.from_arrays([
            pa.array([int(bucket[order[a]]) for a, _ in parts], pa.int32()), pa.array([_packed(rows.slice(a, b - a)) for a, b in parts], pa.binary())], ["bucket", "rows"])

    waiting = 0
    for words, langs in _texts(batches):
        all_ = pa.table({"lang": langs, "n": np.diff(words.firsts)}).group_by("lang").aggregate([("n", "sum")])
        k = all_.num_rows
        names, bounds = utf8(_flat(all_["lang"]))
        found = pa.table([_flat(all_["lang"]), pa.nulls(k, pa.string()), pa.array(np.zeros(k, np.int32)), _flat(all_["n_sum"])], schema=COUNTED)
        held.append((hash_spans(names, bounds[:-1], np.diff(bounds)), found))
        for n, at, keys in words.grams(tables, s.longest):
            keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
            at = at[first]
            held.append((keys, pa.table([langs.take(pa.array(words.text[at])), words.phrases(at, n), pa.array(np.full(len(at), n, np.int32)), pa.array(counts)], schema=COUNTED)))
            waiting += len(at)
        if waiting >= s.held // 4:
            held, waiting = [merged()], 0
            if len(held[0][0]) >= s.held:
                yield blocks(*held[0])
                held = []
    if held:
        yield blocks(*merged())


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _frequent(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """The phrases of each partition with `least` occurrences, summed by their words; blocks arrive sorted by partition."""
    bucket, held, waiting = None, [], 0

    def summed_rows() -> pa.Table:
        rows = pa.concat_tables(held).group_by(["lang", "phrase", "words"]).aggregate([("n", "sum")])
        return rows.rename_columns(["lang", "phrase", "words", "n"]).cast(COUNTED)

    def close() -> Iterator[pa.RecordBatch]:
        rows = summed_rows()
        yield from rows.filter(pc.or_(pc.greater_equal(rows["n"], s.least), pc.is_null(rows["phrase"]))).to_batches()

    for batch in batches:
        for number, block in zip(batch.column("bucket").to_pylist(), batch.column("rows"), strict=True):
            if number != bucket and held:
                yield from close()
                held, waiting = [], 0
            bucket = number
            held.append(pa.ipc.open_stream(block.as_buffer()).read_all())
            waiting += held[-1].num_rows
            if len(held) > 1 and waiting > max(1 << 18, 2 * held[0].num_rows):
                held = [summed_rows()]
                waiting = held[0].num_rows
    if held:
        yield from close()
    give_back()


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def phrase_counts(df: DataFrame, settings: Settings | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Columns lang, phrase, words, n: exact occurrences of every phrase of 1 to `longest` words with `least` or more, and of all words (a null phrase).

    Rounds: words; pairs of words that survived; longer n-grams of pairs that survived. In each, tasks count what their texts have and hand it on
    by hash partition, whose summary tells which n-grams may occur `least` times. These are then counted by their words.
    """
    s = settings or Settings()
    spark = df.sparkSession
    rows = df.select(F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    tables: dict[int, Table] = {}
    tables[1], mass = survivors(rows, range(1, 2), {}, size // 2, s)
    tables[2], mass = survivors(rows, range(2, 3), dict(tables), mass, s)
    if s.longest > 2:
        longer, _ = survivors(rows, range(3, s.longest + 1), dict(tables), (s.longest - 2) * mass, s)
        tables |= {n: longer for n in range(3, s.longest + 1)}
    shared = spark.sparkContext.broadcast(tables)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-mass // (s.least * s.summary)))
    blocks = rows.mapInArrow(lambda b: _count(b, s, shared.value, buckets), "bucket int, rows binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return blocks.mapInArrow(lambda b: _frequent(b, s), "lang string, phrase string, words int, n bigint")


def collocations(df: DataFrame, settings: Settings | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Columns lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language.

    Texts are taken in ASCII lower case, cut at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`. A candidate is a phrase
    of 2 to `longest` words with a, at least `least`, contiguous occurrences in pieces of a language's texts, overlaps included. Cut after its first k
    words, it has l and r occurrences of the first part and of the rest, and the score floor(1000 a n / (l r)), n all words of the language; the cut
    with the lowest score counts, of equal ones the smallest k. A candidate that lies in a longer one as frequent as itself is dropped. Order: score
    and a falling, then the phrase by its bytes.

    Null and empty texts have no words; a null language is `und`. Every row counts, repeated ones too. An empty table gives no rows, other columns are
    ignored. Counts are exact: summaries and tables of 64-bit hashes only choose what is counted, by its words. Products are decimals of 38 digits.
    Frequent keys are counted in the tasks before any shuffle. Texts are read five times and never shuffled.
    """
    s = settings or Settings()
    counts = written(df.sparkSession, phrase_counts(df, s, text_col, lang_col), "collocation-counts")
    known = counts.where("phrase IS NOT NULL").select("lang", "phrase", "words", F.col("n").alias("a"))
    total = counts.where("phrase IS NULL").select("lang", "n")
    # what contains a candidate contains it with one word more, and is at most as frequent in between
    part = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(part, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(part, F.lit(2), F.col("words") - 1), " "))
    longer = known.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = known.where("words > 1").join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    cuts = left.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(part, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(part, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(total, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    cuts = cuts.withColumn("over", wide["a"] * wide["n"] * 1000).withColumn("under", wide["l"] * wide["r"]).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("best")).select("lang", "phrase", "best.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return best.withColumn("rank", rank).where(F.col("rank") <= s.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
