"""Quality rules: counts per document, and texts without the lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefold.llm.frames import col, fresh, written
from rulefold.llm.text_arrays import LOWER, chunks, hash_spans, inside, join_hash, mix, ngrams, utf8, word_spans

WINDOW = 8
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_U = np.uint64


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True for every key that occurs more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """True for every key that an earlier place has too."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def full_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, lengths: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines with words: begin, end without and with the line feed, number of words, number of the text, hash of the normalised line."""
    n = len(offsets) - 1
    # lines of a text start at it and behind every line feed
    breaks = np.flatnonzero(data == 0x0A) + 1
    begin = np.unique(np.concatenate([offsets[:-1], breaks])) if len(data) else np.zeros(0, np.int64)
    begin = begin[begin < len(data)]
    behind = np.append(begin[1:], len(data))
    end = behind - ((behind > begin) & (data[np.maximum(behind - 1, 0)] == 0x0A))
    first = np.searchsorted(starts, begin)
    count = np.diff(np.append(first, len(starts)))
    full = count > 0
    begin, end, behind, first, count = begin[full], end[full], behind[full], first[full], count[full]
    owner = np.repeat(np.arange(n), np.diff(firsts))[first] if len(first) else np.zeros(0, np.int64)
    # normalised: words in lower case with one space between
    if len(first):
        place = np.arange(len(starts)) - np.repeat(first, count)
        low = hash_spans(LOWER[data], starts, lengths)
        lines = mix(np.add.reduceat(mix(low + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), first) + count.astype(np.uint64))
    else:
        lines = np.zeros(0, np.uint64)
    return begin, end, behind, count, owner, lines


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
    """Counts of each text, and its lines as `full_lines` gives them."""
    n = len(offsets) - 1
    starts, lengths, firsts = word_spans(data, offsets)
    per_text = np.diff(firsts)
    owner = np.repeat(np.arange(n), per_text)
    seed = mix(np.arange(n, dtype=np.uint64) + _U(7))

    def total(per_byte: np.ndarray) -> np.ndarray:
        run = np.append(0, np.cumsum(per_byte))
        return run[offsets[1:]] - run[offsets[:-1]]

    continues = (data & 0xC0) == 0x80
    inner = np.append(0, np.cumsum(continues))
    chars = lengths - (inner[starts + lengths] - inner[starts])
    word_chars = np.bincount(owner, weights=chars, minlength=n).astype(np.int64)
    symbols = total(SYMBOLS[data])

    # words in windows that the text has twice
    words = hash_spans(data, starts, lengths)
    whole = inside(firsts, WINDOW)
    at = np.flatnonzero(whole)
    twice = np.zeros(len(words) + WINDOW, np.int64)
    twice[at] = _repeated(join_hash(ngrams(words, WINDOW)[at], seed[owner[at]]))
    run = np.append(0, np.cumsum(twice))
    covered = run[np.arange(len(words)) + 1] - run[np.maximum(np.arange(len(words)) - WINDOW + 1, 0)] > 0
    repeat_words = np.bincount(owner, weights=covered, minlength=n).astype(np.int64)

    found = full_lines(data, offsets, starts, lengths, firsts)
    begin, end, _, _, line_owner, _ = found
    exact = join_hash(hash_spans(data, begin, end - begin), seed[line_owner])
    dup_lines = np.bincount(line_owner, weights=_later(exact), minlength=n).astype(np.int64)
    return [per_text, word_chars, symbols, dup_lines, repeat_words], found


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the distinct normalised lines of each text."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for i, j in chunks(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            *_, owner, lines = full_lines(part, at, *word_spans(part, at))
            seed = mix(np.arange(j - i, dtype=np.uint64) + _U(7))
            one = np.sort(np.unique(join_hash(lines, seed[owner]), return_index=True)[1])
            ends = np.append(0, np.cumsum(np.bincount(owner[one], minlength=j - i))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(lines[one].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("host").slice(i, j - i), lists], ["host", "lines"])


def without_lines(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, behind: np.ndarray) -> pa.Array:
    """The texts without the bytes [begin, behind) of the given lines."""
    edges = np.zeros(len(data) + 1, np.int8)
    edges[begin] += 1
    edges[behind] -= 1
    stays = np.cumsum(edges[:-1], dtype=np.int8) == 0
    ends = np.append(0, np.cumsum(stays))[offsets].astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[stays])))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each text, the words on its boilerplate lines, and the text without those."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for i, j in chunks(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            counts, (begin, _, behind, count, owner, lines) = measure(part, at)
            common = batch.column("common").slice(i, j - i)
            seed = mix(np.arange(j - i, dtype=np.uint64) + _U(7))
            wanted = pc.list_flatten(common).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            wanted = join_hash(wanted, seed[pc.list_parent_indices(common).to_numpy(zero_copy_only=False).astype(np.int64)])
            gone = np.isin(join_hash(lines, seed[owner]), wanted)
            lost = np.bincount(owner[gone], weights=count[gone], minlength=j - i).astype(np.int64)
            text = without_lines(part, at, begin[gone], behind[gone])
            text = pc.if_else(batch.column("text").slice(i, j - i).is_null(), pa.scalar(None, pa.string()), text)
            columns = [batch.column("id").slice(i, j - i)] + [pa.array(c.astype(np.int64)) for c in [*counts, lost]] + [text]
            yield pa.RecordBatch.from_arrays(columns, ["id", *NAMES, "lost", "text"])


def clean_texts(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", min_words: int = 20,
                max_repeat_percent: int = 30, min_line_documents: int = 20, max_line_share: float = 0.01, min_kept_share: float = 0.2,
                min_left_words: int | None = None) -> DataFrame:
    """One row per row of `df`: id, counts, base_failed, n_boilerplate_words, kept, and the text without its boilerplate lines.

    Lines are hashed as lower-case words with one space between. A line that more than `min_line_documents` documents and
    more than `max_line_share` of the documents of a host have is boilerplate there and is removed with its line feed. A document
    is kept unless it failed the base rules or is depleted: boilerplate lines left less than `min_kept_share` of its words or fewer
    than `min_left_words` words, which are `min_words` unless given. Counts are those of the whole text; the texts of
    documents that are not kept are returned as well.

    A null or empty text has no words and fails; null stays null. A null host is one host. Rows that repeat an id count as
    documents of their own and are each returned. An empty table gives no rows.

    A first Python pass over the texts gives line hashes. (host, line) sums are taken per task before they are shuffled, so a line that
    all documents have is one row per task. Only boilerplate lines are listed, per host, fewer than 1 / `max_line_share` times the
    lines of an average document; a second pass over the texts gets the list of each text's host. Texts are shuffled only when
    the lists of all hosts are too large to send around.
    """
    spark = df.sparkSession
    text_name = fresh(df.select(col(id_col)), text_col)[0]
    rows = df.select(col(id_col).alias("id"), col(host_col).cast("string").alias("host"), col(text_col).cast("string").alias("text"))
    lines = rows.select("host", "text").mapInArrow(_lines, "host string, lines array<bigint>")
    # beside its lines each document counts once for its host, as a null line
    lines = lines.select("host", F.explode(F.concat("lines", F.array(F.lit(None).cast("bigint")))).alias("line"))
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("documents"))
    counted = written(spark, counted.where(F.col("line").isNull() | (F.col("documents") > min_line_documents)), "quality-rules-lines")
    hosts = counted.where("line IS NULL").alias("h")
    common = counted.where("line IS NOT NULL").alias("l").join(
        hosts, F.col("l.host").eqNullSafe(F.col("h.host"))).where(F.col("l.documents") > max_line_share * F.col("h.documents"))
    common = written(spark, common.groupBy("l.host").agg(F.collect_list("l.line").alias("common")), "quality-rules-hosts").alias("c")
    listed = rows.alias("d").join(common, F.col("d.host").eqNullSafe(F.col("c.host")), "left").select("d.id", "d.text", "c.common")
    kind = rows.schema["id"].dataType.simpleString()
    cleaned = listed.mapInArrow(_cleaned, f"id {kind}, {', '.join(f'{c} bigint' for c in NAMES)}, lost bigint, text string")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("lost")
    too_few = left < (min_words if min_left_words is None else min_left_words)
    depleted = (F.col("lost") > 0) & (too_few | (left < min_kept_share * F.col("n_words")))
    return cleaned.select(
        F.col("id").alias(id_col), *NAMES, failed.alias("base_failed"),
        F.col("lost").alias("n_boilerplate_words"), (~failed & ~depleted).alias("kept"), F.col("text").alias(text_name))


def quality_rules(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", min_words: int = 20,
                  max_repeat_percent: int = 30, min_line_documents: int = 20, max_line_share: float = 0.01, min_kept_share: float = 0.2,
                  min_left_words: int | None = 0) -> DataFrame:
    """The counts and verdicts of `clean_texts`, without the texts; by default the verdict on depleted documents is on the share alone, as in the SQL."""
    out = clean_texts(df, id_col, host_col, text_col, min_words, max_repeat_percent, min_line_documents, max_line_share, min_kept_share, min_left_words)
    return out.select(*[col(c) for c in out.columns[:-1]])
