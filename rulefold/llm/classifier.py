"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulefold.llm.frames import col, give_back
from rulefold.llm.text_arrays import LOWER, SPACE, chunks, hash_spans, inside, mix, ngrams, utf8

_U = np.uint64
WORD, MARK = 1, 2
KIND = np.full(256, WORD, np.uint8)
KIND[[b for b in range(128) if not chr(b).isalnum()]] = MARK
KIND[SPACE] = 0
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True


@dataclass(frozen=True)
class Settings:
    bits: int = 18  # of the hashed feature space
    word_orders: tuple[int, ...] = (1, 2)  # n-grams of words in lower case and of runs of marks
    shape_orders: tuple[int, ...] = (1, 2, 3)  # n-grams of words' cases; a word like the one before it is a case of its own
    scale: float = 20.0  # a feature's value is this times its share of the text's n-grams
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.0005
    l2: float = 0.001
    epochs: int = 4
    shards: int = 4
    max_rows: int = 20_000  # labelled rows to learn from, the first by a hash of the id


def features(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts end to end, and how many each text has; place 0 is the constant."""
    n, kind = len(data), KIND[data]
    begins = kind != 0
    begins[1:] &= kind[1:] != kind[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = kind[edges] != 0
    ends = kind != 0
    ends[:-1] &= kind[1:] != kind[:-1]
    ends[edges - 1] = kind[edges - 1] != 0
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) - starts + 1
    firsts = np.searchsorted(starts, offsets)
    words = hash_spans(LOWER[data], starts, lengths)
    upper, digit = (np.append(0, np.cumsum(table[data])) for table in (UPPER, DIGIT))
    n_upper, n_digit = upper[starts + lengths] - upper[starts], digit[starts + lengths] - digit[starts]
    begins_upper = UPPER[data[starts]]
    case = np.select(
        [n_digit > 0, (n_upper == lengths) & (lengths > 1), begins_upper & (n_upper == 1), n_upper == 0], [1, 2, 3, 4], 5).astype(np.uint64)
    again = np.append(False, words[1:] == words[:-1]) if len(words) else np.zeros(0, bool)
    again[firsts[:-1][firsts[:-1] < len(words)]] = False
    case[again] = 6
    shape = np.where((kind[starts] == MARK) & ~again, words, mix(case + _U(99)))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    found, owners = [], []
    for stream, orders, salt in ((words, s.word_orders, 0), (shape, s.shape_orders, 50)):
        for order in orders:
            keep = inside(firsts, order)
            found.append(mix(ngrams(stream, order)[keep] + _U(salt + order)) >> _U(64 - s.bits))
            owners.append(owner[: len(keep)][keep])
    index, owner = np.concatenate(found).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return index[order], np.bincount(owner, minlength=len(offsets) - 1)


def train(rows: Iterable[np.ndarray], labels: np.ndarray, s: Settings) -> np.ndarray:
    """Weights by FTRL-proximal updates, one text after another; the last weight is the constant's."""
    size = (1 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= s.l1, 0.0, -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    inputs = []
    for row in rows:
        at, count = np.unique(row, return_counts=True)
        inputs.append((np.append(at, size - 1).astype(np.int32), np.append(count * (s.scale / max(len(row), 1)), 1.0).astype(np.float32)))
    for _ in range(s.epochs):
        for (at, x), label in zip(inputs, labels, strict=True):
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size)).astype(np.float32)


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, s: Settings) -> np.ndarray:
    index, count = features(data, offsets, s)
    run = np.append(0, np.cumsum(weights[index], dtype=np.float64))
    ends = np.cumsum(count)
    dot = (run[ends] - run[ends - count]) * s.scale / np.maximum(count, 1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(dot, -30, 30)))


def labelled_sample(df: DataFrame, labels: DataFrame, learn_from: Column, s: Settings, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Columns text, label, key of at most `max_rows` labelled ids: those with the smallest hashes of the ids in `learn_from`."""
    known = labels.where(learn_from & col(id_col).isNotNull() & col(label_col).isNotNull()).groupBy(col(id_col).alias("id"))
    known = known.agg((F.avg(col(label_col)) >= 0.5).cast("int").alias("label")).withColumn("key", F.xxhash64("id"))
    known = known.orderBy("key", "id").limit(s.max_rows)
    rows = df.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(known), "id").select("text", "label", "key")  # max_rows small rows


def fit(df: DataFrame, labels: DataFrame, learn_from: Column, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> np.ndarray:
    """Weights learned from labelled rows of `df` that `learn_from`, a condition on `labels`, admits.

    The sample is bounded by `max_rows`, dealt by hash into `shards`; each is learned from in one task, and the weights are averaged.
    Ids with several labels count by their mean, null labels and ids are ignored. Without any labelled row all weights
    are 0 and all scores 0.5. The same rows give the same weights.
    """
    s = settings or Settings()
    sample = labelled_sample(df, labels, learn_from, s, id_col, text_col, label_col).withColumn("shard", F.pmod("key", F.lit(s.shards)))

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("text", "ascending")])
        labels = group["label"].to_numpy()
        data, offsets = utf8(group["text"].combine_chunks())
        del group

        def rows() -> Iterator[np.ndarray]:
            for i, j in chunks(offsets):
                index, count = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], s)
                yield from np.split(index, np.cumsum(count)[:-1])

        weights = train(rows(), labels, s)
        give_back()
        return pa.table({"n": pa.array([len(labels)], pa.int64()), "weights": pa.array([weights.tobytes()], pa.binary())})

    learned = sample.groupBy("shard").applyInArrow(learn, "n bigint, weights binary").collect()
    total = np.zeros((1 << s.bits) + 1)
    for row in sorted(learned, key=lambda r: bytes(r["weights"])):
        total += np.frombuffer(bytes(row["weights"]), np.float32) * row["n"]
    return (total / max(sum(r["n"] for r in learned), 1)).astype(np.float32)


def score(df: DataFrame, weights: np.ndarray, settings: Settings | None = None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`df` with a column `score_col`, 0 to 1, from the whole text of each row and nothing else.

    Null and empty texts get the score of a text without features, that of the constant. Repeated rows are scored
    alike. An empty table gives no rows. `score_col` must not be a column of `df`. No shuffle; the weights, a fixed
    size, go to every task.
    """
    s = settings or Settings()
    if score_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"{score_col} is a column already")
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("row").field(place) if whole else batch.column("text"))
            found = [scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shared.value, s) for i, j in chunks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(found or [np.zeros(0)]), pa.float64())], ["row", "score"])
            give_back()

    # a text that is a string already goes to the tasks once, inside its row
    place = next(k for k, c in enumerate(df.columns) if c.lower() == text_col.lower())
    whole = isinstance(df.schema[place].dataType, T.StringType)
    rows = df.select(F.struct("*").alias("row"), F.lit(None).cast("string").alias("text") if whole else col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(scored, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return out.select("row.*", F.col("score").alias(score_col))
