"""Token counts by rank-synchronous merging of ragged arrays of pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefold.llm.bytelevel import Pieces, vocabulary
from rulefold.llm.frames import col
from rulefold.llm.text_arrays import chunks, utf8

REMEMBERED = 500_000  # distinct pre-tokens whose counts a task keeps between batches


class Counter:
    """Token counts of texts; remembers the counts of pre-tokens it has merged, up to a bound."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.vocabulary, self.remembered = vocabulary(path), remembered
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        pieces = Pieces(texts, self.vocabulary.special)
        at = np.minimum(np.searchsorted(self.hashes, pieces.hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == pieces.hashes if len(self.hashes) else np.zeros(len(pieces.hashes), bool)
        counts = np.zeros(len(pieces.hashes), np.int64)
        if known.any():
            counts[known] = self.counts[at[known]]
        new = ~known
        counts[new] = self.vocabulary.merge(pieces.data, pieces.begin[new], pieces.length[new])
        if len(self.hashes) + int(new.sum()) > self.remembered:
            self.hashes, self.counts = pieces.hashes, counts
        elif new.any():
            hashes, all_counts = np.append(self.hashes, pieces.hashes[new]), np.append(self.counts, counts[new])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.counts = hashes[order], all_counts[order]
        owner = np.repeat(pieces.owner, pieces.counts)
        out = np.bincount(owner, weights=counts[pieces.inverse], minlength=len(texts)).astype(np.int64)
        return out + np.bincount(pieces.owner, weights=pieces.after >= 0, minlength=len(texts)).astype(np.int64)


def token_counts(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id, n_bytes (UTF-8), n_tokens.

    Counts are those of the tokenizer file's own library without begin or end tokens: special strings of the file count
    one token each. Null and empty texts have none. Repeated rows are each counted; other columns are ignored; an
    empty table gives no rows. No shuffle: each text is counted where it is read, about two million bytes at a time, a
    longer text at once. `vocabulary_path` must exist on every executor.
    """
    rows = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary_path)
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            texts = pc.fill_null(batch.column("text"), "")
            n = [count(texts.slice(i, j - i).to_pylist()) for i, j in chunks(offsets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(offsets)), pa.array(np.concatenate(n or [np.zeros(0, np.int64)]))], ["id", "n_bytes", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"id {kind}, n_bytes bigint, n_tokens bigint").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
