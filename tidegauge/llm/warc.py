"""WARC archives: records written by Spark's text writer, and a reader that salvages damaged archives.

The writer gives each page one record. Of pages with equal payloads of at least `least` bytes the one
with the largest id carries the payload, the others are revisits that refer to it.

The reader walks plain archives and archives of gzip members. A record that fails a check (header,
length, end mark, block digest) is left, the next valid record is searched behind it, reading goes on
there, and the bytes between are logged as a gap. A member's content is walked in the same way. Of a
member that is cut off or damaged, what was inflated before the error is walked; the rest is a gap up to
the next member or version line with a valid record. Where a member is one record, the member's check
is the record's.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import pa_type
from tidegauge.session import cut, shared_dir

END, LEAST, DATE = "\r\n\r\n", 1000, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in one file: a reader holds a whole file.
PER_FILE = 1000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
RECORD = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("gap", T.StringType()), T.StructField("type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("page_id", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType())])


def record_id(page_id) -> F.Column:
    """A record's name from its page id."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
                                           for x in ([F.lit("-")] if i > 1 else []) + [F.substring(h, i, n)]], F.lit(">"))


def revisits(pages: DataFrame, page_id: str, html: str, least: int = LEAST) -> DataFrame:
    """(r_digest, r_bytes, response): for each payload of at least `least` bytes on more than one page the
    largest page id. Equal payloads are known by length and SHA-1; only digests are shuffled."""
    payload = F.coalesce(F.col(html), F.lit(""))
    light = pages.select(F.col(page_id).alias("id"), F.octet_length(payload).cast("long").alias("r_bytes"), F.sha1(payload).alias("r_digest"))
    return light.where(F.col("r_bytes") >= least).groupBy("r_digest", "r_bytes").agg(
        F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null").drop("n")


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST,
          date: str = DATE, per_file: int = PER_FILE) -> None:
    """Write one record per row into plain WARC files under `path`. Null html is an empty payload; a null
    url gives no target, line breaks in it are dropped; pages with a null id are responses, and so are
    repeated rows of the id that carries the payload. An empty table writes a folder without records."""
    decided = cut(revisits(pages, page_id, html, least))  # a table, so that a small one is seen to be small
    payload = F.coalesce(F.col(html), F.lit(""))
    page = pages.select(F.col(page_id).alias("id"), F.regexp_replace(F.col(url).cast("string"), r"[\r\n]+", "").alias("url"), payload.alias("payload"))
    page = page.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    joined = page.join(decided, (F.col("digest") == F.col("r_digest")) & (F.col("bytes") == F.col("r_bytes")), "left")
    again = F.coalesce(F.col("id") < F.col("response"), F.lit(False))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit(HTTP), F.col("bytes"), F.lit(END))
    block = F.when(again, head).otherwise(F.concat(head, F.col("payload")))
    made = joined.select("id", "url", "bytes", "digest", "response", again.alias("again"), block.alias("block"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", record_id(F.col("id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("url")),
        line("Page-ID", F.col("id").cast("string")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        F.when(F.col("again"), F.concat(line("WARC-Refers-To", record_id(F.col("response"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block"), F.lit(END), F.col("block"))
    made.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
#: What ends the header lines: the blank line, or the next record's version line where it is lost.
HEADER_END = re.compile(rb"\r\n(?:\r\n|(?=WARC/1\.[01]\r\n))")


class Places:
    """The places in data that begin a member or a version line, in order; the next of either kind is
    remembered, so that a walk over many damaged records looks at each byte once."""

    def __init__(self, data: bytes, members: bool):
        self.data, self.line, self.zipped = data, -1, -1 if members else len(data)

    def after(self, here: int) -> int:
        """The first place at `here` or behind it, or the end."""
        if self.line < here:
            line = VERSION.search(self.data, here)
            self.line = line.start() if line else len(self.data)
        if self.zipped < here:
            zipped = self.data.find(MEMBER, here)
            self.zipped = zipped if zipped >= 0 else len(self.data)
        return min(self.line, self.zipped)


def parsed(data: bytes, at: int) -> tuple[dict, int] | str:
    """The plain record that begins at `at` and its end, or the check that fails."""
    start = VERSION.match(data, at)
    if not start:
        return "no version line"
    found = HEADER_END.search(data, start.end() - 2)
    if not found or found.end() == found.start() + 2:
        return "endless header"
    stop = found.start()
    fields = {}
    for raw in data[start.end():stop].split(b"\r\n"):
        name, colon, value = raw.partition(b":")
        if not colon:
            return "bad header line"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdecimal() or "warc-type" not in fields:
        return "no length or type"
    begin = stop + 4
    end = begin + int(fields["content-length"])
    if end > len(data):
        return "cut off"
    if data[end:end + 4] != b"\r\n\r\n":
        return "no end mark"
    block = data[begin:end]
    if not digest_agrees(fields.get("warc-block-digest"), block):
        return "block digest"
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block[p + 4:] if (p := block.find(b"\r\n\r\n")) >= 0 else b""
    if fields["warc-type"] != "revisit" and not digest_agrees(fields.get("warc-payload-digest"), payload):
        return "payload digest"
    return {"fields": fields, "payload": payload}, end + 4


def digest_agrees(named: str | None, data: bytes) -> bool:
    """Whether a sha1 digest, in hexadecimal or base 32, is that of data; other or no digests pass."""
    kind, _, value = (named or "").partition(":")
    if kind.lower() != "sha1":
        return True
    own = hashlib.sha1(data)
    return value.lower() == own.hexdigest() or value.upper() == base64.b32encode(own.digest()).decode()


def member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member that begins at `at`, its end, and None or what is wrong with it; then
    the content is all that was inflated before the error."""
    opened, parts, size = zlib.decompressobj(31), [], 1 << 20
    while at < len(data):
        before = opened.copy()
        try:
            parts.append(opened.decompress(data[at:at + size]))
        except zlib.error as e:  # that call's output is lost: again in smaller pieces, at last byte by byte out
            opened = before
            if size > 1:
                size >>= 5
                continue
            try:
                given = data[at:at + 1]
                while out := opened.decompress(given, 1):
                    parts.append(out)
                    given = opened.unconsumed_tail
            except zlib.error:
                pass
            return b"".join(parts), at, str(e)
        at = min(at + size, len(data))
        if opened.eof:
            return b"".join(parts), at - len(opened.unused_data), None
    return b"".join(parts), at, "cut off"


def inside(content: bytes, why: str | None) -> Iterator[tuple[int, int, str | None, list[dict]]]:
    """The content of a member walked; where a member is one record, a failed check of the member fails it."""
    for start, stop, bad, records in salvage(content, False):
        sole = bad is None and why is not None and (start, stop) == (0, len(content))
        yield (start, stop, why, []) if sole else (start, stop, bad, records)


def valid(data: bytes, at: int) -> bool:
    """Whether a valid record, a member with one, or an empty member begins at `at`."""
    if data[at:at + 3] != MEMBER:
        return not isinstance(parsed(data, at), str)
    content, _, why = member(data, at)
    return any(bad is None for _, _, bad, _ in inside(content, why)) if content else why is None


def following(data: bytes, here: int, places: Places) -> int:
    """The next place from `here` that begins a member or a version line and is valid, or the end."""
    while (here := places.after(here)) < len(data) and not valid(data, here):
        here += 1
    return here


def salvage(data: bytes, members: bool = True) -> Iterator[tuple[int, int, str | None, list[dict]]]:
    """(start, end, failed check or None, records) over a whole archive, in order. A member gives one such
    row for each record in it, with the member's bounds; a gap inside it has these too, and its own bounds
    in the content are part of the text. Without `members` data is the content of one."""
    at, places = 0, Places(data, members)
    while at < len(data):
        if not members or data[at:at + 3] != MEMBER:
            got = parsed(data, at)
            end = following(data, at + 1, places) if isinstance(got, str) else got[1]
            yield (at, end, got, []) if isinstance(got, str) else (at, end, None, [got[0]])
            at = end
            continue
        content, end, why = member(data, at)
        done, held = 0, []
        for start, stop, bad, records in inside(content, why):
            if bad is not None:
                held.append((at, end, f"{bad}, bytes {start} to {stop} of the member's content", []))
                continue
            yield from held
            yield at, end, None, records
            done, held = stop, []
        if why is None:
            yield from held
        else:  # the rest of the content is part of the gap, which begins behind the last record's bytes
            start = at
            if done:
                again = zlib.decompressobj(31)
                again.decompress(read := data[at:end + 1], done - 1)  # the last byte's call would fail as well
                start = at + len(read) - len(again.unconsumed_tail)
            end = following(data, max(start, at + 1), places)
            yield start, end, f"{why}, from byte {done} of the content of the member at {at}", []
        at = end


def rows_of(archive: str, data: bytes, payloads: bool) -> Iterator[dict]:
    for start, end, why, records in salvage(data):
        base = {"archive": archive, "offset": start, "end": end}
        if why is not None:
            yield base | {"gap": why}
        for r in records:
            f, payload = r["fields"], r["payload"]
            yield base | {"type": f["warc-type"], "record_id": f.get("warc-record-id"), "refers_to": f.get("warc-refers-to"),
                          "uri": f.get("warc-target-uri"), "page_id": f.get("page-id"), "payload_bytes": len(payload),
                          "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload if payloads else None}


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives under `path`: a record has a type, a gap has the failed check
    in `gap` and its bytes from `offset` to `end`; in a gzip member these are the member's, and a gap inside
    names its bytes in the content. A record without digests is taken by its header, length and end mark,
    also from a member of several records whose checksum fails. Records carry payload, its length and SHA-1 in lower-case
    hexadecimal; those of revisits are empty. Without `payloads` the payload column is null. No file, or
    empty files, give an empty result."""
    kind = pa_type(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for row in rows_of(archive.as_py(), data.as_py(), payloads):
                    held.append(row)
                    size += len(row.get("payload") or b"")
                    if len(held) == 1000 or size > 1 << 24:
                        yield pa.RecordBatch.from_struct_array(pa.array(held, type=kind))
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_struct_array(pa.array(held, type=kind))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records without gaps, revisits with the length, digest and page id of the response they refer to (as
    far as it was read): page_id, payload_bytes, payload_digest, record_type, refers_to."""
    whole = records.where("gap is null").select("type", "record_id", "refers_to", "page_id", "payload_bytes", "payload_digest")
    responses = whole.where("type = 'response'").groupBy(F.col("record_id").alias("of")).agg(
        F.first("page_id").alias("of_page"), F.first("payload_bytes").alias("of_bytes"), F.first("payload_digest").alias("of_digest"))
    wanted = cut(whole.where("type = 'revisit'"))
    found = wanted.join(responses, F.col("refers_to") == F.col("of"), "left").select(
        "page_id", F.col("of_bytes").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("of_page").alias("refers_to"))
    return whole.where("type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("string").alias("refers_to")).union(found)


def archived(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The resolved records of pages after they were written as archives and read back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, page_id, url, html)
    return resolved(cut(read(spark, path, payloads=False)))
