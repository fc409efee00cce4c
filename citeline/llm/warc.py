"""WARC, index first: archives of gzip members, an index of offsets, and coalesced byte-range reads of selected records.

Payloads are equal when their SHA-1 and length are. Of equal payloads of at least ``min_bytes`` bytes the record with the largest
identifier is the response and the others are revisits that refer to it; smaller payloads are all responses. A null payload
counts as empty, a null identifier as the smallest. Rows repeated under the referred identifier are all responses.

A task writes its records, one gzip member each, to one archive of the shared folder (renamed when whole, so a task that runs
twice leaves the same file) and an index row a record: file, offset, length, URL, digest. Readers sort the selected index rows
by file and offset, join ranges that lie within ``GAP`` bytes up to ``RANGE`` bytes, and fetch each with one read.
"""
from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.llm import shared
from citeline.session import settle

GAP, RANGE = 64 << 10, 8 << 20
INDEX = "id {kind}, url string, digest string, file string, offset long, length long"
RECORD = "id {kind}, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(id, url, payload, revisit_digest, refers_to) of rows (id, url, payload): the last two are null for a response."""
    signed = pages.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload"))
    last = signed.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("id").alias("refers_to"))
    keys = signed.select("id", "digest", "size").join(last, ["digest", "size"])
    revisits = keys.where(~F.col("id").eqNullSafe(F.col("refers_to"))).select(F.col("id").alias("_id"), F.col("digest").alias("revisit_digest"), F.col("size").alias("_size"), "refers_to").distinct()
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("revisit_digest")) & (F.col("size") == F.col("_size"))
    return signed.join(revisits, same, "left").select("id", "url", "payload", "revisit_digest", "refers_to")


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(at, url: str | None, payload: bytes, refers_to, revisit: bool) -> tuple[bytes, str]:
    """(gzip member, digest) of one record."""
    digest = sha1(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if at is None else at}>", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (b"" if revisit else payload)
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush(), digest


def parse(member: bytes) -> dict:
    raw = zlib.decompress(member, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    return fields | {"payload": block.partition(b"\r\n\r\n")[2]}


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes rows (id, url, payload, refers_to, revisit_digest) and returns the index, itself a written table."""
    kind = pages.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        name, rows, offset = f"part-{TaskContext.get().partitionId():06d}.warc.gz", [], 0
        ids = pa.null()

        def members():
            nonlocal offset, ids
            for batch in batches:
                ids = batch.column("id").type
                for at, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "revisit_digest", "refers_to"))):
                    member, own = record(at, url, payload, refers, digest is not None)
                    rows.append((at, url, own, name, offset, len(member)))
                    offset += len(member)
                    yield member

        shared.write_bytes(folder, name, members())
        for a in range(0, len(rows), 10_000):
            columns = list(zip(*rows[a:a + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids), *(pa.array(c, pa.string()) for c in columns[1:4]), *(pa.array(c, pa.int64()) for c in columns[4:])], names=["id", "url", "digest", "file", "offset", "length"])

    return settle(pages.mapInArrow(run, INDEX.format(kind=kind)), "warc-index")


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index rows; without ``payloads`` these are checked against their digest and left out."""
    kind = index.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "id", "url"))))
            out: list[tuple] = []
            size, at, files = 0, 0, {}
            while at < len(rows):
                file, start, length = rows[at][:3]
                end, last = start + length, at + 1
                while last < len(rows) and rows[last][0] == file and rows[last][1] - end <= GAP and rows[last][1] + rows[last][2] - start <= RANGE:
                    end = rows[last][1] + rows[last][2]
                    last += 1
                if file not in files:
                    for other in files.values():
                        other.close()
                    files = {file: shared.open_input(folder, file)}
                files[file].seek(start)
                got = files[file].read(end - start)
                for _, offset, length, identity, url in rows[at:last]:
                    fields = parse(got[offset - start:offset - start + length])
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and sha1(fields["payload"]) != digest:
                        raise ValueError(f"{file} at {offset}: payload and digest differ")
                    refers = fields["WARC-Refers-To"][len("<urn:page:"):-1] if revisit else None
                    out.append((identity, _unline(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None, fields["payload"] if payloads and not revisit else None, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], refers))
                    size += len(fields["payload"]) if payloads else 0
                at = last
                if size > RANGE:
                    yield _records(out, batch.schema.field("id").type)
                    out, size = [], 0
            for other in files.values():
                other.close()
            if out:
                yield _records(out, batch.schema.field("id").type)

    dealt = index.repartition("file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORD.format(kind=kind))


def _records(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [ids, pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    refers = pa.array(columns[6], pa.string()).cast(ids)
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), refers], names=["id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back through the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    folder = shared.new_folder(spark, "warc")
    index = write(roles(pages, 0), folder)
    return read(index, folder, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS top, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((instr('0123456789abcdef', substr(x, (5 * i // 4 + 1)::INT, 1)) - 1) * 16
        + instr('0123456789abcdef', substr(x, (5 * i // 4 + 2)::INT, 1)) - 1) >> (3 - 5 * i % 4)::INT & 31)::INT + 1, 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top = page_id THEN NULL ELSE top END AS refers_to FROM d
"""
QUERIES = {"op6_warc": (op6_warc, SQL)}
