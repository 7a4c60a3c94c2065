"""Periodic runs of words: maximal stretches that repeat a root three times or more, found by a dictionary of basic factors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefold.llm.frames import col, give_back
from rulefold.llm.text_arrays import chunks, hash_spans, joined_words, utf8, word_spans


@dataclass(frozen=True)
class Settings:
    least: int = 24  # words of a run
    powers: int = 3  # periods of a run; 3 or more, as the levels rest on it

    def __post_init__(self) -> None:
        if self.powers < 3:
            raise ValueError(f"powers must be 3 or more, not {self.powers}")


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
FOUND = "own {}, n_words bigint, runs " + RUNS + ", collapsed string"


def _names(keys: np.ndarray) -> np.ndarray:
    """Numbers from 0, equal for equal keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _known(at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the factors that occur twice or more: one with a unique part is unique, so the others are in no longer repeat."""
    several = np.bincount(names)[names] > 1 if len(names) else np.zeros(0, bool)
    return at[several], names[several]


def _proposals(at: np.ndarray, names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose factor of `size` words occurs next more than size / 2 and at most `size` words on, and that distance."""
    order = np.lexsort((at, names))
    here, name = at[order], names[order]
    step = np.diff(here)
    hit = np.flatnonzero((name[1:] == name[:-1]) & (step <= size) & (2 * step > size))
    return here[hit], step[hit]


def period_runs(words: np.ndarray, firsts: np.ndarray, s: Settings) -> np.ndarray:
    """Rows (start, length, period) of the runs of several texts, in order of start and period; `words` are numbers, all texts end to end.

    The dictionary names the factors of 1, 2, 4, ... words, each by its two halves. A run of period q, with m the least power of two that is
    q or more, has a factor of m words at each of its places but the last q + m - 1, and the factor's next occurrence is exactly q on: as
    m >= q, a nearer one would be a smaller period. So the places whose successor within m words is q on form stretches, one for
    each run, and a stretch from i to j is the run from i to j + q + m: no longer one has period q. Each run is
    proposed at one level, and once. Sizes, not places, decide how much is done: factors that occur once leave.
    """
    n = int(firsts[-1])
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    end = firsts[1:][owner] if n else np.zeros(0, np.int64)
    at, names = _known(np.arange(n), _names(owner * np.int64(n + 1) + _names(words)))
    found, size = [np.zeros((0, 3), np.int64)], 1
    while len(at):
        place, period = _proposals(at, names, size)
        order = np.lexsort((place, period))
        place, period = place[order], period[order]
        new = np.append(True, (np.diff(place) != 1) | (np.diff(period) != 0)) if len(place) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        if len(first):
            last = np.append(first[1:], len(place)) - 1
            length = place[last] - place[first] + period[first] + size
            long = (length >= s.least) & (length >= s.powers * period[first])
            found.append(np.stack([place[first], length, period[first]], 1)[long])
        # factors of twice as many words: those whose two halves are both known
        after = np.searchsorted(at, at + size)
        both = (after < len(at)) & (at + 2 * size <= end[at])
        both[both] = at[after[both]] == at[both] + size
        pairs = names[both] * (names.max() + 1) + names[after[both]]
        at, names = _known(at[both], _names(pairs))
        size *= 2
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find_runs(df: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id, n_words, runs (start, length, period, by start and then period), collapsed.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0. A run is a stretch of words whose smallest period is q and whose length is
    at least `least` and `powers` * q, and that no neighbouring word extends keeping that period; runs may overlap. `collapsed` has the words that
    no run contains behind its first q words, joined by one space.

    Null and empty texts have no words, no runs and an empty `collapsed`. Ids are carried along, null and repeated ones too; each row is judged
    alone. An empty table gives no rows; other columns are ignored. Words are equal when 64-bit hashes of their bytes are. No shuffle; memory is
    that of a batch's texts, or of the longest text.
    """
    s = settings or Settings()
    rows = df.select(col(id_col).alias("own"), col(text_col).cast("string").alias("body"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("body"))
            for i, j in chunks(offsets):
                part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, lengths, firsts = word_spans(part, bounds)
                runs = period_runs(hash_spans(part, starts, lengths), firsts, s)
                dropped = np.zeros(len(starts) + 1, np.int64)
                np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
                np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
                kept = np.cumsum(dropped)[:-1] == 0
                owner = np.repeat(np.arange(j - i), np.diff(firsts))[kept]
                yield pa.RecordBatch.from_arrays([
                    batch.column("own").slice(i, j - i), pa.array(np.diff(firsts)), _lists(runs, firsts),
                    joined_words(part, starts[kept], lengths[kept], owner, j - i)], ["own", "n_words", "runs", "collapsed"])
            give_back()

    return rows.mapInArrow(find, FOUND.format(rows.schema["own"].dataType.simpleString())).withColumnRenamed("own", id_col)


def _lists(runs: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """The runs of each text, places counted from its first word."""
    bounds = np.searchsorted(runs[:, 0], firsts)
    owner = np.searchsorted(firsts, runs[:, 0], "right") - 1
    values = pa.StructArray.from_arrays([pa.array(runs[:, 0] - firsts[owner]), pa.array(runs[:, 1].copy()), pa.array(runs[:, 2].copy())], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
