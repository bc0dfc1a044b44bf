"""Op 13: WARC archives of pages, read back through an index of byte ranges.

Each record is a gzip member of its own, so an index of (archive, offset,
length) reaches it without the records before it. The index is written while the
archives are, and every read goes through it: the selected records' ranges
are sorted, neighbours are coalesced into one read, and members are cut out of that.
"""

from __future__ import annotations

import hashlib
import time
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitscope.llm.common import drop, map_arrow, save
from splitscope.session import ensure_checkpoint_dir

#: Payloads of at least so many bytes are written once; further pages with the same payload revisit that record.
LEAST_REVISIT = 1000
#: Bytes after which an archive is closed and the next one begun.
ARCHIVE_BYTES = 128 << 20
#: Ranges that lie at most GAP bytes apart are read at once, up to READ_BYTES; a read task takes about TASK_BYTES.
GAP, READ_BYTES, TASK_BYTES = 64 << 10, 8 << 20, 16 << 20
#: Profile of a revisit whose payload equals that of the record it refers to (fixed value of the format).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, archive string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


# --- one record ---------------------------------------------------------------


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, so a revisit can name a record of another archive."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.blake2b(f'{page_id} {digest}'.encode(), digest_size=16).digest(), version=5)}>"


def target(url: str | None) -> str:
    """A header line can't hold control characters, spaces or non-ASCII: they are percent-encoded. A null url: about:blank."""
    return "about:blank" if url is None else quote(url, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", errors="replace")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response (refers_to is null) with its payload, or a revisit with the HTTP header alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target(url)),
        ("WARC-Payload-Digest", "sha1:" + digest),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("ascii") + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """The fields of RECORD from a record's bytes. The payload's digest is computed anew; a revisit holds none and states its own."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("ascii").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a damaged record: {head[:200]!r}")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    n_bytes = int(dict(x.split(": ", 1) for x in http.decode("ascii").split("\r\n")[1:])["Content-Length"])
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    if fields["WARC-Type"] == "revisit":
        payload, digest = None, stated
    else:
        digest = hashlib.sha1(payload).hexdigest()
        if digest != stated or n_bytes != len(payload):
            raise ValueError(f"a payload that isn't the one written: {head[:200]!r}")
    return int(page) if page else None, fields["WARC-Target-URI"], n_bytes, digest, fields["WARC-Type"], int(refers) if refers else None, payload


# --- archives -----------------------------------------------------------------


def _store(uri: str):
    """File system and path of a folder in a shared store (file, hdfs, s3 and the like)."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition(":")
    if sep and not rest.startswith("//"):
        uri = f"{scheme}://{rest}"
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def with_referred(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, refers_to) of the pages.

    Of equal payloads of `least` bytes or more, the page with the largest id
    is referred to by the others. The groups are summed up before they
    are shuffled, and only digests found twice are joined back; that join can be split where one payload fills many pages.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    copies = keyed.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    earlier = (F.col("payload_bytes") >= least) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    return keyed.join(copies, "payload_digest", "left").withColumn("refers_to", F.when(earlier, F.col("last"))).drop("last")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Write a record for each row of pages into gzipped archives under `folder`; returns their index, which is written there too.

    A null html is an empty payload, a null url the target about:blank. A null
    page_id counts as less than any other; equal payloads without any id, and rows that share the largest
    id and the payload, are all responses. Rows repeated in full give as many records, with one record id.
    Extra columns are ignored; an empty table gives an empty index and no archive.

    An archive's name is new in each attempt of a task and its rows of the index
    are handed out once it is closed, so what a lost attempt left is never read.
    """
    date = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    names = [c.split()[0] for c in INDEX.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, types[c.split()[1]]) for n, c in zip(names, INDEX.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(folder)
        out, name, at, rows = None, "", 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                member = zlib.compress(record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["refers_to"], date), 4, 31)
                out.write(member)
                kind = "response" if r["refers_to"] is None else "revisit"
                rows.append((r["page_id"], r["url"], r["payload_digest"], r["payload_bytes"], kind, r["refers_to"], name, at, len(member)))
                at += len(member)
                if at >= archive_bytes:
                    out.close()
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    out, rows = None, []
        if rows:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    spark = pages.sparkSession
    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)
    map_arrow(with_referred(pages, least), run, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(ranges: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) as reads: (archive, start, end, ranges within), each of at most `most` bytes unless one record is longer."""
    name, start, end, held = None, 0, 0, []
    for archive, offset, length in ranges:
        if archive != name or offset - end > gap or (offset + length - start > most and held):
            if held:
                yield name, start, end, held
            name, start, held = archive, offset, []
        held.append((offset, length))
        end = offset + length
    if held:
        yield name, start, end, held


def read_records(selected: DataFrame, folder: str, payloads: bool = True, gap: int = GAP) -> DataFrame:
    """RECORD of each selected row of an index, read from the archives in `folder`.

    The rows are dealt by (archive, offset) ranges, so each task reads one stretch
    of a few archives in order, however many records one archive holds or are selected.
    A revisit has no payload; `with_payloads` fetches it. Url is the record's target. `payloads=False` leaves payloads null.
    """
    places = selected.select("archive", "offset", "length")
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    tasks = 1 + (places.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(folder)
        name, file = None, None
        for archive, start, end, held in coalesced(rows(batches), gap):
            if archive != name:
                name, file = archive, fs.open_input_file(f"{base}/{archive}")
            data = memoryview(file.read_at(end - start, start))
            got = [parsed(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in held]
            if not payloads:
                got = [(*x[:-1], None) for x in got]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names)

    return map_arrow(places.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset"), run, RECORD)


def with_payloads(selected: DataFrame, folder: str) -> DataFrame:
    """RECORD of each selected row, revisits with the payload of the record that they refer to; each of those is read once."""
    spark = selected.sparkSession
    index = read_index(spark, folder).where("record_type = 'response'")
    # the record of a response that some selected row refers to, whether it is selected itself or not
    needed = selected.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    # rows repeated in full wrote a record each: one of them will do
    places = index.join(needed, ["page_id", "payload_digest"]).groupBy("page_id", "payload_digest").agg(F.min(F.struct("archive", "offset", "length")).alias("at")).select("at.*")
    whole = read_records(places, folder).select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload").alias("_payload"))
    own = read_records(selected, folder)
    found = own.join(whole, (own["refers_to"] == whole["_page"]) & (own["payload_digest"] == whole["_digest"]), "left")
    return found.withColumn("payload", F.coalesce("payload", "_payload")).select(*own.columns)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives of all pages into the shared folder, read every record back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Odd rows are taken as `write_archives` states. The archives are read
    once, then dropped; what is returned is a table in the shared folder.
    """
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/warc-{uuid.uuid4().hex}"
    index = write_archives(pages, folder)
    records, _ = save(read_records(index, folder, payloads=False).drop("payload", "url"), "warc-records")
    drop(spark, folder)
    return records


#: DuckDB SQL of archive_round_trip over the table pages.
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1),
r AS (SELECT p.*, CASE WHEN page_id IS NULL OR page_id < last THEN last END AS refers_to FROM p LEFT JOIN last USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""
