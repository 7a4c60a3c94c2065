"""Web archives: records written by Spark, read back, segments reassembled, chunked framing decoded."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.llm.frames import col, written
from rulefold.session import fresh_folder

END = b"\r\n\r\n"
VERSION = b"WARC/1.1"
# The profile of revisits by equal payload, and the content type of responses.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
LEAST_REVISIT = 1000  # bytes; shorter payloads are never replaced by a revisit
SEGMENT = 8192  # bytes of content in one record
CHUNK = 4096  # bytes of payload in one chunk of the transfer framing
RECORDS_PER_FILE = 4000
BUCKETS = 1 << 20  # of hashes of repeated digests that are broadcast; whatever passes is joined exactly


# --- records ------------------------------------------------------------------------------------------------------


def record(fields: Iterable[tuple[str, str]], content: bytes) -> bytes:
    """A record without its closing blank lines."""
    head = [f"{k}: {' '.join(v.split())}".encode() for k, v in (*fields, ("Content-Length", str(len(content))))]
    return b"\r\n".join([VERSION, *head, b"", content])


def http_message(payload: bytes, chunk: int = CHUNK) -> bytes:
    """A response with its payload in chunked transfer framing."""
    parts = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for k in range(0, len(payload), chunk):
        part = payload[k : k + chunk]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    parts.append(b"0\r\n\r\n")
    return b"".join(parts)


def http_payload(message: bytes) -> bytes:
    """The payload of a response; chunked framing is decoded, extensions and trailers are skipped."""
    head, blank, body = message.partition(END)
    if not blank:
        raise ValueError("no end of the HTTP header")
    lines = head.decode("latin-1").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(":") for line in lines)}
    if fields.get("transfer-encoding") != "chunked":
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(part)
        at = end + 4 + size


def _encoded(page: str | None) -> str:
    """An id as part of a record's name: percent-encoded, so it may hold any character."""
    return "" if page is None else quote(page, safe="")


def records_of(page: str | None, url: str, payload: bytes, digest: str, refers_to: str | None, date: str, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response and the continuations its content needs."""
    name = f"<urn:page:{_encoded(page)}:{digest}>"
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    common = [("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", sha)]
    if refers_to is not None:
        head = http_message(b"").partition(END)[0] + END
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Refers-To", f"<urn:page:{_encoded(refers_to)}:{digest}>"),
                      ("WARC-Profile", IDENTICAL), ("Content-Type", HTTP)], head)
        return
    content = http_message(payload, chunk)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", HTTP)]
    if len(content) <= segment:
        yield record(first, content)
        return
    yield record([*first, ("WARC-Segment-Number", "1")], content[:segment])
    for k, at in enumerate(range(segment, len(content), segment), 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Date", date),
                ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k))]
        if at + segment >= len(content):
            more.append(("WARC-Segment-Total-Length", str(len(content))))
        yield record(more, content[at : at + segment])


PIECE = 1 << 20  # bytes of an archive that are inflated at a time
NEXT = END + b"WARC/"  # where reading goes on behind a broken record
WHOLE_BLOCK = ("warcinfo", "resource", "metadata", "conversion")  # types whose content is their payload


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and content of every record of an archive that must be sound."""
    for fields, content, problem in scan(archive):
        if problem:
            raise ValueError(problem)
        yield fields, content


def scan(archive: bytes) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """Fields, content and problem of every record of an archive, gzipped as a whole, by record, or not at all.

    What is no record, or one whose stated length is missing or wrong, gives a row without content that says why; reading goes on at the next
    place that looks like the start of a record, so no sound record behind it is lost. An archive is inflated piece by piece: besides its own
    bytes a task holds one record.
    """
    window = _Window(_pieces(archive))
    while window.has(1):
        place = window.place
        end = window.find(END) if window.starts(b"WARC/") else -1
        if end < 0:
            window.to_next(1)
            yield {}, None, f"no record at byte {place}"
            continue
        lines = window.take(end).decode(errors="replace").split("\r\n")[1:]
        window.take(len(END))
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = fields.get("content-length", "")
        size = int(length) if length.isascii() and length.isdigit() else -1
        if size < 0 or not window.has(size + len(END)) or window.peek(size, len(END)) != END:
            window.to_next(-len(END))
            yield fields, None, f"the record at byte {place} is cut short" if size >= 0 else f"the record at byte {place} states no length"
            continue
        content = window.take(size)
        window.take(len(END))
        yield fields, content, None
    if window.broken:
        yield {}, None, window.broken


class _Window:
    """Bytes of an archive from where reading is; more are taken when they are asked for."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held, self.at, self.passed, self.broken = pieces, bytearray(), 0, 0, None

    @property
    def place(self) -> int:
        return self.passed + self.at

    def _more(self) -> bool:
        try:
            piece = next(self.pieces, None)
        except zlib.error as e:
            self.broken, piece = f"the archive cannot be inflated behind byte {self.passed + len(self.held)}: {e}", None
        if piece is None:
            return False
        if self.at > PIECE:  # a record that closes blank lines short needs the few bytes before it
            drop = self.at - len(END)
            del self.held[:drop]
            self.at, self.passed = self.at - drop, self.passed + drop
        self.held += piece
        return True

    def has(self, size: int) -> bool:
        while len(self.held) - self.at < size:
            if not self._more():
                return False
        return True

    def starts(self, text: bytes) -> bool:
        return self.has(len(text)) and self.held.startswith(text, self.at)

    def find(self, text: bytes, skip: int = 0) -> int:
        """How far ahead the text starts, -1 if it does not come."""
        seen = skip
        while True:
            found = self.held.find(text, self.at + seen)
            if found >= 0:
                return found - self.at
            seen = max(skip, len(self.held) - self.at - len(text) + 1)
            if not self._more():
                return -1

    def peek(self, skip: int, size: int) -> bytes:
        return bytes(self.held[self.at + skip : self.at + skip + size])

    def take(self, size: int) -> bytes:
        self.at += size
        return bytes(self.held[self.at - size : self.at])

    def to_next(self, skip: int) -> None:
        """Go to the next start of a record, or to the end."""
        found = self.find(NEXT, skip)
        self.at = self.at + found + len(END) if found >= 0 else len(self.held)


def _pieces(archive: bytes) -> Iterator[bytes]:
    if archive[:2] != b"\x1f\x8b":
        for at in range(0, len(archive), PIECE):
            yield archive[at : at + PIECE]
        return
    view, at = memoryview(archive), 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            part = view[at : at + PIECE]
            at += len(part)
            piece = member.decompress(part, PIECE)
            while piece:
                yield piece
                piece = b"" if member.eof else member.decompress(member.unconsumed_tail, PIECE)
            at -= len(member.unused_data)
        if not member.eof:
            raise zlib.error("the last member is cut short")


# --- tables -------------------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z",
                   least_revisit: int = LEAST_REVISIT, segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """Writes a record per row, and continuations, as gzipped archives below `folder`.

    Of rows with equal payloads of at least `least_revisit` bytes, that with the largest id is the response and the others
    revisit it; rows that repeat the largest id are responses too. Null payloads are empty, null urls are empty, a null id is smaller than all others.

    Digests are counted with map-side maxima. Payloads stay where they are read, except those whose digest is repeated: a
    broadcast set of at most `BUCKETS` hashes passes by the others. The text writer puts the blank lines that close
    a record between the rows, so Spark commits the files.
    """
    payload = F.coalesce(col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(col(id_col).alias("page"), F.coalesce(col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    long = rows.where(F.length("payload") >= least_revisit)
    repeated = long.groupBy("digest").agg(F.count("*").alias("n"), F.max("page").alias("to")).where("n > 1").select("digest", F.col("to").cast("string").alias("to"))

    def bucket(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")

    buckets = F.broadcast(repeated.select(bucket(F.col("digest")).alias("bucket")).distinct())
    near = bucket(F.col("digest")) == F.col("bucket")
    others = rows.join(buckets, near, "left_anti").withColumn("to", F.lit(None).cast("string"))
    revisits = rows.join(buckets, near, "left_semi").join(repeated, "digest", "left").select("page", "url", "payload", "digest", "to")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, body, digest, to = (batch.column(c)[k].as_py() for c in ("page", "url", "payload", "digest", "to"))
                if to is not None and to == page:
                    to = None
                yield pa.RecordBatch.from_arrays([pa.array(list(records_of(page, url, body, digest, to, date, segment, chunk)), pa.binary())], ["record"])

    texts = others.unionByName(revisits).withColumn("page", F.col("page").cast("string"))
    records = texts.mapInArrow(_in_batches(build), "record binary")
    (records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder))


def _in_batches(build, most: int = 4_000_000):
    """Joins the small batches that `build` yields until they have `most` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in build(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


RECORD = "type string, id string, refers_to string, origin string, number int, total bigint, digest string, content binary"


def _row(fields: dict[str, str], content: bytes | None, problem: str | None) -> dict:
    kind, name = fields.get("warc-type"), fields.get("warc-record-id")
    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
    if problem is None and not (kind and name):
        problem = "the record has no type" if not kind else "the record has no id"
    if problem is None and not all(n is None or (n.isascii() and n.isdigit() and int(n) < 1 << 31) for n in (number, total)):
        problem = "the record's segment is no number"
    if problem is not None:
        number = total = content = None
    return {
        "type": kind, "id": name, "refers_to": fields.get("warc-refers-to"), "origin": fields.get("warc-segment-origin-id", name),
        "number": None if number is None else int(number), "total": None if total is None else int(total),
        "digest": _sha1(fields.get("warc-payload-digest", "")), "content": content, "problem": problem}


def _sha1(stated: str) -> str | None:
    """A SHA-1 in lower-case hex from its base 32 or hex form; None for any other digest, which is then not compared."""
    name, _, text = stated.partition(":")
    if name.lower() != "sha1":
        return None
    try:
        return (base64.b32decode(text.upper()) if len(text) == 32 else bytes.fromhex(text)).hex() or None
    except ValueError:
        return None


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives below `folder`; `origin` is the id of the record that its content starts in.

    Archives may have any name. A broken record, or one without type or id, is a row too: its content is null and `problem` says why.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("type", pa.string()), ("id", pa.string()), ("refers_to", pa.string()), ("origin", pa.string()), ("number", pa.int32()),
                            ("total", pa.int64()), ("digest", pa.string()), ("content", pa.binary()), ("problem", pa.string())])
        for batch in batches:
            for archive in batch.column("content"):
                rows, size = [], 0
                for found in scan(archive.as_py()):
                    rows.append(_row(*found))
                    size += len(found[1] or b"") + 100
                    if size >= 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(folder).select("content")  # whatever their names; Spark passes by `_SUCCESS` and its like
    return files.mapInArrow(read, f"{RECORD}, problem string")


def reassemble(records: DataFrame) -> DataFrame:
    """One row per record that is no continuation: type, id, refers_to, digest, payload, problem.

    Segments are grouped by the record they started in, ordered by number, and must be numbered without gaps up to the one
    that states the total length, which must be theirs. Chunked framing is then decoded, and the payload must have the
    digest of the record, if a SHA-1 is stated. What fails has a null payload and says why in `problem`, as do records that were broken when read.
    Of `warcinfo`, `resource`, `metadata` and `conversion` the content is the payload. Records of one id are copies: a row is returned
    for each first segment. Whole records are not shuffled; a group is one payload's segments.
    """
    if "problem" not in records.columns:
        records = records.withColumn("problem", F.lit(None).cast("string"))
    whole = records.where("number IS NULL").select("type", "id", "refers_to", "digest", F.lit(1).alias("copies"), F.array(F.struct("number", "total", "content")).alias("parts"), "problem")
    head = F.col("number") == 1
    grouped = records.where("number IS NOT NULL").groupBy("origin").agg(
        F.first(F.when(head, F.col("type")), True).alias("type"), F.first(F.when(head, F.col("refers_to")), True).alias("refers_to"),
        F.first(F.when(head, F.col("digest")), True).alias("digest"), F.count(F.when(head, 1)).cast("int").alias("copies"),
        F.sort_array(F.collect_set(F.struct("number", "total", "content"))).alias("parts"))
    grouped = grouped.select("type", F.col("origin").alias("id"), "refers_to", "digest", "copies", "parts", F.lit(None).cast("string").alias("problem"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                payload, problem = (None, row["problem"]) if row["problem"] else _joined(row["type"], row["digest"], row["parts"])
                n = max(row["copies"], 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["type"]] * n, pa.string()), pa.array([row["id"]] * n, pa.string()), pa.array([row["refers_to"]] * n, pa.string()),
                    pa.array([row["digest"]] * n, pa.string()), pa.array([payload] * n, pa.binary()), pa.array([problem] * n, pa.string())],
                    ["type", "id", "refers_to", "digest", "payload", "problem"])

    return whole.unionByName(grouped).mapInArrow(_in_batches(join), "type string, id string, refers_to string, digest string, payload binary, problem string")


def _joined(kind: str | None, digest: str | None, parts: list[dict]) -> tuple[bytes | None, str | None]:
    content = b"".join(p["content"] for p in parts)
    numbers = [p["number"] for p in parts]
    if numbers != [None]:
        if numbers != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
            return None, "segments are missing"
        if parts[-1]["total"] != len(content):
            return None, "the segments have another total length"
    if kind == "revisit":
        return None, None
    try:
        payload = content if kind in WHOLE_BLOCK else http_payload(content)
    except ValueError as e:
        return None, str(e)
    if digest is not None and hashlib.sha1(payload).hexdigest() != digest:
        return None, "the payload has another digest"
    return payload, None


def page_of(name: Column) -> Column:
    """The id of the page in a record's id."""
    return F.url_decode(F.nullif(F.split(name, ":")[2], F.lit("")))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", **options) -> DataFrame:
    """Writes the pages as archives in the shared folder and returns what reading them gives: page (string), type, refers_to (a page), payload_bytes, payload_digest."""
    spark = pages.sparkSession
    folder = fresh_folder(spark, "warc")
    write_archives(pages, folder, id_col, url_col, payload_col, **options)
    read = written(spark, reassemble(read_records(spark, folder)).select("type", "id", "refers_to", "digest", F.length("payload").cast("bigint").alias("n"), F.sha1("payload").alias("sha"), "problem"), "warc-read")
    whole = read.where("type = 'response'").select(page_of(F.col("id")).alias("page"), "type", F.lit(None).cast("string").alias("refers_to"), "n", "sha", "problem")
    origin = read.where("type = 'response'").groupBy(F.col("id").alias("to")).agg(F.min("n").alias("n"), F.min("sha").alias("sha"))
    revisits = read.where("type = 'revisit'").select("id", "type", "refers_to").join(origin, F.col("refers_to") == F.col("to"), "left").select(
        page_of(F.col("id")).alias("page"), "type", page_of(F.col("refers_to")).alias("refers_to"), "n", "sha",
        F.when(F.col("to").isNull(), "the response is missing").alias("problem"))
    return whole.unionByName(revisits).select("page", "type", "refers_to", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "problem")
