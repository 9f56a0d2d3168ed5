"""Operator 3: WARC archives, written by Spark and read back by a salvage reader.

Writing: every record is a gzip member of its own, ended by an empty member, and Spark's text writer puts the members
into the archive files, so archives land on any file system that Spark writes and a lost task leaves nothing behind.
The writer's line separator is a zero byte: the last byte of the empty member, which each row leaves out. Of records
with equal payloads of at least `least` bytes the one with the smallest id is a response and the others are revisits
without payload that name it.

Files are rolled by records and by bytes: payloads of up to SMALL bytes are packed RECORDS_PER_FILE a file, larger ones by
classes of size, so many a file as FILE_BYTES holds, since Spark's binary source takes no file over 2 GB.

Reading: archives come through Spark's binary file source. A member is checked by its own checksum, a record by its
version line, its length, the two line ends after it and its payload digest. What a damaged or cut member gives before
its end is read too; where the member does not decompress or its checksum fails, only records whose payload digest fits
count, and they carry that reason, as nothing proves their headers. After a failed check the reader goes on at the next version line of the same content, or at the
next member of the file, from which a whole record can be read; a record of which only the payload digest fails is
passed over as a whole. The bytes between are reported as a gap with the reason; `inside` is the place of a record or gap
in the content of a member, null in plain archives, and then `bytes` counts bytes of that content.

Defined cases: null payloads are empty; a null id is never the smallest, and its record names no page; rows that repeat
the smallest id of their payload are responses all; empty tables give an archive without records; other columns are not
read. A record, and an archive file, is held in memory as a whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import split_join, stored
from siltstone.sources.scratch import new_path
from siltstone.sources.tables import table

RECORDS_PER_FILE, FILE_BYTES, SMALL = 1000, 1 << 27, 1 << 17
LEVEL = 1
#: Fixed values of the formats.
VERSION, LINE, MEMBER = b"WARC/1.1", b"\r\n", b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of payloads that are broadcast at most when revisits are found (40 bytes each); beyond it they are shuffled.
BROADCAST_ROWS = 200_000
SCHEMA = "archive string, kind string, start long, inside long, bytes long, reason string, page_id long, record_type string, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def member(record: bytes) -> bytes:
    """A gzip member holding the record, and an empty one."""
    out = b""
    for data in (record, b""):
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += packer.compress(data) + packer.flush()
    return out


def record(page_id: int | None, uri: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """The bytes of a WARC record. uri: line ends and control characters are percent-encoded."""
    safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in (uri or ""))
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Target-URI: {safe}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
        payload = b""
    head += ["Content-Type: text/html;charset=utf-8", f"Content-Length: {len(payload)}"]
    return VERSION + LINE + "\r\n".join(head).encode() + LINE + LINE + payload + LINE + LINE


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "uri", "payload", "payload_digest", "payload_bytes", "refers_to")]
        made = [member(record(p.as_py(), u.as_py(), x.as_py() or b"", d.as_py(), n.as_py(), r.as_py()))[:-1] for p, u, x, d, n, r in zip(*columns)]
        yield pa.RecordBatch.from_pydict({"value": pa.array(made, pa.binary())})


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, uri, payload, payload_digest, payload_bytes, refers_to for rows of (page_id, uri, payload).

    Only payloads that occur more than once are looked up; payloads themselves are shuffled only if those are too many
    to broadcast.
    """
    sized = pages.select("page_id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload"))
    sized = sized.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    counted = sized.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = stored(counted.filter("n > 1 AND first IS NOT NULL").select("payload_digest", "first"), "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        found = sized.join(F.broadcast(repeated), "payload_digest", "left")
    else:
        found = split_join(sized, repeated, ["payload_digest"], "left")
    refers = F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first"))
    long_enough = F.col("payload_bytes") >= least
    out = found.withColumn("refers_to", F.when(long_enough, refers))
    return out.select("page_id", "uri", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_digest", "payload_bytes", "refers_to")


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", uri: str = "url", payload: str = "html", least: int = 100, file_bytes: int = FILE_BYTES, small: int = SMALL) -> None:
    """Writes a record for each row of pages into archives under `path`. payload: text (as UTF-8) or binary. No file has
    more than about file_bytes bytes of payload, but for those of one record."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(uri).alias("uri"), F.col(payload).cast("binary").alias("payload"))
    named = with_revisits(rows, least)
    # class 0: up to `small` bytes, class c: up to 2 ** c times as many; revisits have no payload and are all in class 0
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    of_size = F.when(size <= small, 0).otherwise(F.ceil(F.log2(size / small))).cast("int")
    # larger payloads are few: they are stored once, and each of their classes reads that
    large = stored(named.filter(of_size > 0).withColumn("class", of_size), "warc-large")
    parts = {0: named.filter(of_size == 0)} | {r.c: large.filter(F.col("class") == r.c) for r in large.select(F.col("class").alias("c")).distinct().collect()}
    for number, (c, part) in enumerate(sorted(parts.items())):
        packed = part.mapInArrow(_pack, "value binary").select(F.col("value").cast("string"))
        most = max(1, min(RECORDS_PER_FILE, file_bytes // (small << c)))
        packed.write.mode("append" if number else "errorifexists").option("lineSep", "\u0000").option("maxRecordsPerFile", most).text(path)


UNPROVEN = "member does not decompress"


class Damaged(Exception):
    """A failed check; resume: where the record ends, if that is known all the same."""

    def __init__(self, reason: str, resume: int | None = None):
        super().__init__(reason)
        self.resume = resume


class Next:
    """The next place of a pattern at or after a place that only grows; each byte is searched once."""

    def __init__(self, data: bytes, what: bytes):
        self.data, self.what, self.found = data, what, -2

    def __call__(self, at: int) -> int:
        """len(data) if there is none."""
        if -2 < self.found < at or self.found == -2:
            found = self.data.find(self.what, at)
            self.found = found if found >= 0 else len(self.data)
        return self.found


def one_record(data: bytes, at: int, blank: Next) -> tuple[dict, bytes, int]:
    """Headers (lower case, of any length), payload and end of the record that starts at `at`; all checks are made. blank: the
    next empty line."""
    if not VERSION_LINE.match(data, at):
        raise Damaged("no version line")
    end = blank(at)
    if end == len(data):
        raise Damaged("headers do not end")
    lines = data[at:end].split(LINE)
    head = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    try:
        size = int(head["content-length"])
        if size < 0:
            raise ValueError
    except (KeyError, ValueError):
        raise Damaged("no content length") from None
    start = end + 4
    if len(data) < start + size + 4 or data[start + size : start + size + 4] != LINE + LINE:
        raise Damaged("length does not fit")
    payload, named = data[start : start + size], head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and named.startswith("sha256:") and named[7:] != hashlib.sha256(payload).hexdigest():
        raise Damaged("payload digest does not fit", start + size + 4)
    return head, payload, start + size + 4


def one_member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at `at`, its end, and what is wrong with it; then the content is what comes before the
    damage. Read in growing parts, as what follows the member is copied."""
    reader, content, size, began = zlib.decompressobj(31), [], 4096, at
    while not reader.eof:
        if at >= len(data):
            return b"".join(content), at, "member does not end"
        part = data[at : at + size]
        try:
            content.append(reader.decompress(part))
        except zlib.error:
            return b"".join([*content, _before_damage(data, began, at, size)]), at, UNPROVEN
        at, size = at + len(part), min(2 * size, 1 << 20)
    return b"".join(content), at - len(reader.unused_data), None


def _before_damage(data: bytes, began: int, at: int, size: int) -> bytes:
    """What the part [at, at + size) of a member gives before its damage, byte by byte."""
    reader, content = zlib.decompressobj(31), []
    reader.decompress(data[began:at])
    try:
        for i in range(at, min(at + size, len(data))):
            content.append(reader.decompress(data[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(content)


def proven(head: dict, payload: bytes) -> bool:
    """Whether the record names a digest of its payload or block that fits (hexadecimal SHA-256 or base 32 SHA-1)."""
    for name in ("warc-payload-digest", "warc-block-digest"):
        kind, _, told = head.get(name, "").partition(":")
        if kind == "sha256" and told.lower() == hashlib.sha256(payload).hexdigest() or kind == "sha1" and told == base64.b32encode(hashlib.sha1(payload).digest()).decode():
            return True
    return False


Found = tuple[int, int, dict | None, bytes | None, str | None]


def plain_records(data: bytes, at: int = 0, stop: bytes | None = None) -> Iterator[Found]:
    """(start, end, headers, payload, None) for each record of plain content, (start, end, None, None, reason) for each gap,
    in order. stop: the reader returns where a whole record has ended or none begins and this stands."""
    line, blank, bad, reason = Next(data, b"WARC/"), Next(data, LINE + LINE), None, None
    other = Next(data, stop) if stop else None
    while at < len(data):
        if stop and data.startswith(stop, at):
            break
        try:
            head, payload, end = one_record(data, at, blank)
        except Damaged as why:
            if bad is None:
                bad, reason = at, str(why)
            if why.resume is not None:
                yield bad, why.resume, None, None, reason
                at, bad = why.resume, None
            else:
                at = min(line(at + 1), other(at + 1) if other else len(data))
            continue
        if bad is not None:
            yield bad, at, None, None, reason
            bad = None
        yield at, end, head, payload, None
        at = end
    if bad is not None:
        yield bad, at, None, None, reason


def read_records(data: bytes) -> Iterator[tuple[int, int | None, int, dict | None, bytes | None, str | None]]:
    """(start, inside, bytes, headers, payload, None or the doubt about its member) for each record, (start, inside, bytes, None, None, reason) for each
    gap, in order. inside: the place in the content of the member at `start`, None outside of members."""
    at, bad, reason, member_at, line = 0, None, None, Next(data, MEMBER), Next(data, b"WARC/")

    def gap(end: int):
        nonlocal bad
        out = [(bad, None, end - bad, None, None, reason)] if bad is not None and end > bad else []
        bad = None
        return out

    while at < len(data):
        if data.startswith(MEMBER, at):
            content, end, wrong = one_member(data, at)
            found = list(plain_records(content))
            doubt = wrong if wrong == UNPROVEN else None
            if doubt:
                found = [x for x in found if x[2] is not None and proven(x[2], x[3])]
            if wrong is None or any(x[2] is not None for x in found):
                yield from gap(at)
                for start, stop, head, payload, why in found:
                    if why is None or wrong is None or stop < len(content):
                        yield at, start, stop - start, head, payload, why or doubt
                if wrong is None:
                    at = end
                    continue
            if bad is None:
                bad, reason = at, wrong
            at = min(member_at(at + 1), line(at + 1))
            if any(x[2] is not None for x in found):
                yield from gap(at)
            continue
        last = at
        for start, end, head, payload, why in plain_records(data, at, MEMBER):
            if head is None:
                if bad is None:
                    bad, reason = start, why
            else:
                yield from gap(start)
                yield start, None, end - start, head, payload, None
            last = end
        at = last
    yield from gap(len(data))


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _number(told: str | None) -> int | None:
    return int(told) if told and told.isdigit() else None


def _unpack(keep_payload: bool):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                for start, inside, size, head, payload, reason in read_records(content.as_py()):
                    if head is None:
                        rows.append((path.as_py(), "gap", start, inside, size, reason, None, None, None, None, None, None, None))
                        continue
                    told = head.get("warc-payload-length") if head.get("warc-type") == "revisit" else str(len(payload))
                    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
                    uri, kept = head.get("warc-target-uri"), payload if keep_payload and head.get("warc-type") != "revisit" else None
                    rows.append((path.as_py(), "record", start, inside, size, reason, _page(head.get("warc-record-id")), head.get("warc-type"), uri, _number(told), digest, _page(head.get("warc-refers-to")), kept))
                    held += len(kept or b"")
                    if len(rows) >= 1000 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives under `path`: archive, kind (record or gap), start, inside, bytes, reason, page_id,
    record_type, uri, payload_bytes, payload_digest, refers_to, payload (null for revisits, or if not kept)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_unpack(keep_payload), SCHEMA)


def with_payloads(records: DataFrame) -> DataFrame:
    """Records with the payloads of revisits filled in from the records that they name, where those were recovered."""
    rows = records.filter("kind = 'record'")
    named = rows.filter("record_type = 'response' AND page_id IS NOT NULL").select(F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload").alias("__named")).dropDuplicates(["refers_to", "payload_digest"])
    return rows.join(named, ["refers_to", "payload_digest"], "left").withColumn("payload", F.coalesce("payload", "__named")).drop("__named")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written into archives and read back."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    back = read_archives(spark, path, keep_payload=False).filter("kind = 'record'")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc": op3_warc}
ORACLES = {
    "op3_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
}
