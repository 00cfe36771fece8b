r"""WARC archives with an index that is read first.

*Write.*  Records are built and written by Spark: a record's head and payload
are one text row and the writer ends each row with the two line ends that close
a WARC record, so each part file is an uncompressed archive and a lost
executor's part is written again by Spark's own commit protocol.  Every record
has a record id of its own, a date, a type and a length; the block of a response
is an HTTP response (head and payload), that of a revisit the HTTP head alone,
with the profile of identical payload digests.  Equal
payloads (SHA-1) of at least ``REVISIT_BYTES`` bytes are stored once, in the record
with the largest page id; the others are revisit records without payload.

*Index.*  One pass over the archives writes offset, length, URL, digest, page
id and type of every record.

*Read.*  Selected index rows are sorted by archive and offset; neighbouring
ranges are run together into reads of at most ``READ_BYTES`` bytes, and each payload
is held against its digest.

The archives must be in a store that pyarrow's file systems open (local and
mounted folders, S3, GCS, HDFS).

Defined results: null html is an empty payload; null url is ``-``; line ends in
a url are percent-coded; a null page id stays null and is never referred to
unless no row of the group has an id (then all of them are responses); repeated
rows with the largest id are all responses; an empty table gives archives without
records; long payloads are read alone, whatever their length; other columns of
pages, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import Tables, broadcast_if_small

REVISIT_BYTES = 1000
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10
END = "\r\n\r\n"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_NONE = "-"
INDEX = "path string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def _uuid(*parts: Column) -> Column:
    """A name-based uuid of the joined parts, as a WARC identifier."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-3"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def write_archives(
    pages: DataFrame, path: str, tables: Tables, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None
) -> None:
    """Writes the pages as WARC records below path; date (now where none is given) is that of the records, as ``2024-01-31T00:00:00Z``."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(html_col, F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.replace(F.coalesce(url_col, F.lit(_NONE)), F.lit("\r"), F.lit("%0D")), "\n", "%0A").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).alias("bytes"),
    )
    groups = tables.write(
        rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null").select("digest", "keep")
    )
    again = tables.write(rows.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1 and page_id is not null").select("page_id", F.lit(True).alias("again")))
    single = groups.join(broadcast_if_small(again.select(F.col("page_id").alias("keep"), "again")), "keep", "left")
    joined = rows.join(broadcast_if_small(tables.write(single.select("digest", "keep", F.col("again").isNull().alias("named")))), "digest", "left")
    joined = joined.join(broadcast_if_small(again), "page_id", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    # a page has a record id made of its page id, so that revisits can name it; rows that repeat a page id, or have none, have ids of their own
    name = lambda x: _uuid(F.lit("page"), x.cast("string"))
    own = F.when(F.col("page_id").isNotNull() & F.col("again").isNull(), name(F.col("page_id"))).otherwise(
        _uuid(F.lit("row"), F.coalesce(F.col("page_id").cast("string"), F.lit(_NONE)), F.monotonically_increasing_id().cast("string"))
    )
    http = F.concat(F.lit(HTTP_HEAD), F.col("bytes"), F.lit(END))
    record = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), own),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, f"WARC-Profile: {PROFILE}"),
        F.when(revisit & F.col("named"), F.concat(F.lit("WARC-Refers-To: "), name(F.col("keep")))),
        F.concat(F.lit("Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit(_NONE))),
        F.when(revisit, F.concat(F.lit("Refers-To-Page-ID: "), F.col("keep"))),
        F.concat(F.lit("Payload-Length: "), F.col("bytes")),
        F.concat(F.lit("Content-Length: "), F.length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))),
    )
    joined.select(F.concat(record, F.lit(END), http, F.when(revisit, "").otherwise(F.col("payload"))).alias("value")).write.option("lineSep", END).text(path)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _number(value: str) -> int | None:
    return None if value == _NONE else int(value)


def _head(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not at the start of a record")
    return dict(x.split(": ", 1) for x in lines[1:])


def _records(path: str) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(offset, length, head) of each record of an archive, in order, with bounded reads."""
    end = END.encode()
    with _open(path) as f:
        size, at, base, held = f.size(), 0, 0, b""
        while at < size:
            while (stop := held.find(end, at - base)) < 0:
                if base + len(held) >= size:
                    raise ValueError(f"{path}: the record at {at} has no end")
                held = held[at - base :]
                base = at
                f.seek(base + len(held))
                held += f.read(READ_BYTES)
            head = _head(held[at - base : stop])
            length = base + stop + len(end) - at + int(head["Content-Length"])
            yield at, length, head
            at += length + len(end)
            if at > base + len(held):
                base, held = at, b""


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows = [(path, at, n, h["WARC-Target-URI"], h["WARC-Payload-Digest"].removeprefix("sha1:"), _number(h["Page-ID"]), h["WARC-Type"]) for at, n, h in _records(path)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def build_index(path: str, tables: Tables) -> DataFrame:
    """path, offset, length, url, payload_digest, page_id, record_type of every record below path."""
    spark = tables.spark
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return tables.write(files.repartition(parts, "path").mapInArrow(_index, INDEX))


def _read(with_payload: bool):
    def flush(path: str, wanted: list[tuple[int, int]]) -> Iterator[tuple]:
        with _open(path) as f:
            f.seek(wanted[0][0])
            held = f.read(wanted[-1][0] + wanted[-1][1] - wanted[0][0])
        for at, n in wanted:
            record = held[at - wanted[0][0] : at - wanted[0][0] + n]
            head, _, block = record.partition(END.encode())
            payload = block.partition(END.encode())[2]
            h = _head(head)
            digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["Payload-Length"])
            kind = h["WARC-Type"]
            if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"{path}: the payload at {at} does not match its digest")
            refers = _number(h["Refers-To-Page-ID"]) if "Refers-To-Page-ID" in h else None
            yield _number(h["Page-ID"]), h["WARC-Target-URI"], kind, refers, size, digest, payload.decode() if with_payload and kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())])
        last, wanted = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*flush(last, wanted), strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for path, at, n in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                far = wanted and (at - sum(wanted[-1]) > GAP_BYTES or at + n - wanted[0][0] > READ_BYTES)
                if wanted and (path != last or far):
                    yield out()
                    wanted = []
                last = path
                wanted.append((at, n))
        if wanted:
            yield out()

    return run


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows; payload is null for revisits or if it isn't wanted."""
    parts = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = selected.select("path", "offset", "length").repartition(parts, "path").sortWithinPartitions("path", "offset")
    return rows.mapInArrow(_read(with_payload), READ)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder, indexes them and reads every record back."""
    tables = Tables(pages.sparkSession, "warc")
    path = f"{tables.base}/archives"
    write_archives(pages, path, tables)
    return read_records(build_index(path, tables), with_payload=False)
