"""WARC archives: writing, reading back, and revisits of payloads that are stored once.

Headers only are shuffled by payload digest; the revisits found are a table of their own, and the records are written
in the tasks that scan them where that table is small enough to be broadcast by Spark's own size limit. Archives
are written by Spark's text writer, whose commit protocol leaves one copy of every file when tasks are repeated: a record is
a row, and the two line ends that close a record are the line separator.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landtally.llm.hot import join_counted
from landtally.llm.store import stored

#: Bytes of the records of an archive, about, before compression; of a batch of records read.
ARCHIVE_BYTES, BATCH_BYTES = 1 << 26, 1 << 23
#: Fixed values of the format.
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_ROWS = ("record_type string, record_id string, page_id long, url string, date string, payload_digest string, payload_bytes long, "
         "refers_to_id string, intact boolean, payload binary")
_SCHEMA = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                     ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                     ("refers_to_id", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary())])


def digest(payload: Column) -> Column:
    """Bare base32 of the SHA-1: five hexadecimal digits are four of base 32."""
    code = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(code, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, record_type, payload, payload_digest, payload_bytes): a response per row; a NULL payload is empty."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.lit("response").alias("record_type"),
                        payload.alias("payload")).withColumns({"payload_digest": digest(F.col("payload")),
                                                               "payload_bytes": F.octet_length("payload").cast("long")})


def originals(headers: DataFrame) -> DataFrame:
    """(payload_digest, first, n): per digest the response with the largest page_id, and how many records have the digest.

    Equal ids are ordered by address; a NULL id is less than every other.
    """
    first = F.max(F.when(F.col("record_type") == "response", F.struct("page_id", "url", "payload_bytes"))).alias("first")
    return headers.groupBy("payload_digest").agg(first, F.count(F.lit(1)).alias("n"))


def revisits(headers: DataFrame) -> DataFrame:
    """(page_id, payload_digest, first): the records that are to revisit another one, each id and digest once.

    A record whose page_id is that of its digest's first response is a response itself, repeated rows included. A
    given revisit stays one; where the archives hold no response for it, ``first`` is NULL.
    """
    shared = stored(originals(headers).filter("n > 1 or first is null"), "originals")
    rows = join_counted(headers.select("page_id", "payload_digest", "record_type"), shared, "payload_digest", "n")
    again = (F.col("record_type") == "revisit") | ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return rows.filter(again).select("page_id", "payload_digest", "first").distinct()


def _line(name: str, value: Column) -> Column:
    # An address with line ends must not open a header of its own.
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]", " ")
    return F.concat(F.lit(f"{name}: "), clean, F.lit(END))


def _name(page_id: Column, url: Column, code: Column) -> Column:
    """A record's name, the same whenever the record is written."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), code, F.coalesce(url, F.lit("\n"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(date: str) -> Column:
    """The bytes of a record without its closing line ends."""
    again, first, code = F.col("_again"), F.col("_first"), F.col("payload_digest")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    F.coalesce(F.when(again, first["payload_bytes"]), F.col("payload_bytes")).cast("string"), F.lit(END * 2)).cast("binary")
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    older = F.when(again & first.isNotNull(), F.concat(
        _line("WARC-Refers-To", _name(first["page_id"], first["url"], code)), F.coalesce(_line("WARC-Refers-To-Target-URI", first["url"]), F.lit("")),
        _line("WARC-Refers-To-Date", F.lit(date))))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"), _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _name(F.col("page_id"), F.col("url"), code)), _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", F.col("url")), F.lit("")), F.coalesce(_line("Page-Id", F.col("page_id")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), code)),
        F.when(again, _line("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit("")), F.coalesce(older, F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", F.octet_length(block)), F.lit(END))
    return F.concat(head.cast("binary"), block).cast("string")


def write_archives(rows: DataFrame, path: str, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """``rows`` as of :func:`records` or :func:`read_archives`, written as compressed archives below ``path``, each payload once.

    Of records with equal payloads that with the largest page_id is a response and the others revisit it. Addresses
    and ids that are NULL have no header line. Other columns are ignored; an empty table gives archives without records.
    An archive holds about ``archive_bytes``: a number of records by their mean size.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    headers = stored(rows.select("page_id", "url", "record_type", "payload_digest", "payload_bytes"), "headers")
    mean = headers.agg(F.coalesce(F.avg("payload_bytes"), F.lit(0.0))).first()[0] + 600
    found = stored(revisits(headers), "revisits").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_code"),
                                                         F.col("first").alias("_first"), F.lit(True).alias("_again"))
    body = rows.join(found, (F.col("payload_digest") == F.col("_code")) & F.col("page_id").eqNullSafe(F.col("_page")), "left")
    body = body.withColumn("_again", F.coalesce("_again", F.lit(False)))
    body.select(_record(date).alias("value")).write.option("lineSep", END * 2).option("compression", "gzip").option(
        "maxRecordsPerFile", max(1, int(archive_bytes / mean))).text(path)
    return path


def _parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header lines by lower-case name, block) of each record of an archive, compressed as a whole, by record or not at all."""
    stream = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream)) if data[:2] == b"\x1f\x8b" else stream
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("archive ends inside a record")
        yield fields, block


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = fields.get("warc-type", "")
    http = fields.get("content-type", "").startswith("application/http")
    head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    code = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size, intact = len(payload), True
    if kind == "revisit":
        lines = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
        size, payload = int(lines.get(b"content-length", b"-1")), None
        size = None if size < 0 else size
    else:
        import base64
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        intact, code = code in (None, own), own
    page = fields.get("page-id")
    return (kind, fields.get("warc-record-id"), None if page is None else int(page), fields.get("warc-target-uri"), fields.get("warc-date"), code, size,
            fields.get("warc-refers-to"), intact, payload if with_payload else None)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per response, resource or revisit record of the archives below ``path``.

    ``payload_digest`` and ``payload_bytes`` of responses are of the payload as read, and ``intact`` says whether the
    digest of its header agrees; those of revisits come from their headers. Other records are left out.
    """
    def parse(batches):
        out, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for fields, block in _parsed(content.as_buffer().to_pybytes()):
                    if fields.get("warc-type") not in ("response", "resource", "revisit"):
                        continue
                    out.append(_row(fields, block, with_payload))
                    size += 500 + len(block) * with_payload
                    if size >= BATCH_BYTES:
                        yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
                        out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    # The writer makes no file for an empty table but its mark of success.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema(
        "path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(parse, _ROWS)


def resolved(rows: DataFrame) -> DataFrame:
    """Records read back → (page_id, payload_bytes, payload_digest, record_type, refers_to), one row per record.

    A revisit is joined to the response of its digest, by headers only; without one, its own header counts
    and ``refers_to`` is NULL, as for responses.
    """
    heads = stored(rows.select("page_id", "url", "record_type", "payload_digest", "payload_bytes", "intact"), "heads")
    if not heads.filter(~F.col("intact")).isEmpty():
        raise ValueError("a payload does not agree with its digest")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    again = heads.filter(F.col("record_type") == "revisit")
    firsts = stored(originals(heads).filter("n > 1 or first is null"), "originals")
    joined = join_counted(again.drop("url", "intact"), firsts, "payload_digest", "n")
    joined = joined.withColumn("payload_bytes", F.coalesce(F.col("first.payload_bytes"), F.col("payload_bytes")))
    # A digest with one record that is a revisit has no response, so every revisit is in ``firsts``.
    return heads.filter(F.col("record_type") != "revisit").select(*names, F.lit(None).cast("long").alias("refers_to")).unionByName(
        joined.select(*names, F.col("first.page_id").alias("refers_to")))


def archived(pages: DataFrame, path: str, **columns: str) -> DataFrame:
    """``pages`` written as archives below ``path`` and read back.

    Every row gives one record; NULL payloads are empty, and empty payloads are equal payloads. Repeated rows of the page that is the
    response are responses again. NULL ids and addresses are kept NULL. An empty table gives no record.
    """
    write_archives(records(pages, **columns), path)
    return resolved(read_archives(pages.sparkSession, path, with_payload=False))
