"""WARC archives compressed with a Zstandard dictionary.

Each archive starts with a skippable frame that holds a dictionary built from the archive's own first records; every
record is a frame of its own, compressed with it, so records can be reached one by one. Of records with equal
payloads, that with the smallest page_id is a response and the others are revisits that refer to it.

The response of each payload is found from digests alone (partial minima before the shuffle; a hot payload is one row for
each task) and stored. A payload with more than one in ``HOT`` of all rows is hot: there are fewer than ``HOT`` of them, so
they are broadcast and their pages are written where they are read; only the other pages join by digest, so no key of
that join has more than one in ``HOT`` of the rows. Tasks write to the cluster's shared folder, each attempt
under its own name; the stored manifest lists the files that counted. A task holds the records that the dictionary is built
from (``SAMPLE_BYTES``) and one record. Null html is an empty payload; a null page_id never is the response while another
page has the payload; rows that repeat the smallest page_id are all responses; a null url is left out; other columns, of
whatever name, are not read; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import file_system, shared_folder, slices, stored

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = (0x184D2A5D).to_bytes(4, "little")
DICTIONARY_BYTES = 64 << 10
#: The dictionary is built from so many bytes of an archive's first records (a bounded sample).
SAMPLE_BYTES = 4 << 20
LEVEL = 3
#: Payloads of more than one in so many rows are not shuffled.
HOT = 1000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part int, path string, n_records long, n_bytes long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"] + [f"X-Refers-To-Page-ID: {refers_to}"] * (refers_to is not None)
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records; too few or too small ones give their last bytes as raw content."""
    if len(records) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(records)[-DICTIONARY_BYTES:]


def with_responses(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html (never null), refers_to and revisit: payloads under ``least`` bytes always are responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.sha1(F.encode("html", "UTF-8"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least, digest).otherwise(F.concat_ws("|", F.lit("small"), "page_id", digest)))
    first = stored(rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")), "digests")
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(first.filter(F.col("n") * HOT > total).drop("n"))
    others = rows.join(hot.select("digest"), "digest", "left_anti").join(first.filter(F.col("n") * HOT <= total).drop("n"), "digest")
    return rows.join(hot, "digest").unionByName(others).withColumn("revisit", ~F.col("page_id").eqNullSafe(F.col("refers_to")))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes one archive for each task and returns the stored manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, path, compress = None, "", None
        sample: list[bytes] = []
        sampled = n = 0

        def start() -> None:
            nonlocal out, path, compress
            path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
            system, where = file_system(path)
            system.create_dir(where.rpartition("/")[0], recursive=True)
            out = system.open_output_stream(where)
            dictionary = build_dictionary(sample)
            out.write(DICTIONARY_FRAME + len(dictionary).to_bytes(4, "little") + dictionary)
            compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress
            for r in sample:
                out.write(compress(r))
            sample.clear()

        for whole in batches:
            for batch in slices(whole, "html"):
                for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    record = record_bytes(page_id, url, html.encode(), refers_to, revisit)
                    n += 1
                    if out is not None:
                        out.write(compress(record))
                        continue
                    sample.append(record)
                    sampled += len(record)
                    if sampled >= SAMPLE_BYTES:
                        start()
        if not n:
            return
        if out is None:
            start()
        size = out.tell()
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([path]), pa.array([n]), pa.array([size])], names=["part", "path", "n_records", "n_bytes"])

    rows = with_responses(pages, least).select("page_id", "url", "html", "refers_to", "revisit")
    return stored(rows.mapInArrow(run, MANIFEST), "manifest")


def frames(path: str, most: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    system, where = file_system(path)
    with system.open_input_stream(where) as f:
        head = f.read(8)
        if head[:4] != DICTIONARY_FRAME:
            raise ValueError(f"no leading dictionary frame: {path}")
        dictionary = zstandard.ZstdCompressionDict(f.read(int.from_bytes(head[4:], "little")))
        decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
        data = b""
        while data or (data := f.read(most)):
            one, parts = decompressor.decompressobj(), []
            while not one.eof:
                if not data and not (data := f.read(most)):
                    raise ValueError(f"archive ends inside a record: {path}")
                parts.append(one.decompress(data))
                data = one.unused_data if one.eof else b""
            yield b"".join(parts)


def parse_record(record: bytes) -> dict[str, object]:
    """Headers and payload of one record; a response's payload must have its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload}


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; an archive is a unit of work."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names=names)

        for units in batches:
            for path in units.column(0).to_pylist():
                rows = []
                for record in frames(path):
                    fields = parse_record(record)
                    rows.append({k: fields[k] for k in names})
                    if len(rows) == 1000:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages and says what the archives hold."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_archives(write_archives(pages, shared_folder(spark, "warc")))


#: DuckDB SQL of the same rows; five hex digits of a digest are four base-32 digits.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS hex FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT)) & 31)::INT, 1)
  ), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f"""
