"""Dictionary-compressed WARC archives.

Each task writes archives of bounded size below the shared folder. An archive's Zstandard dictionary is built
from records spread over that archive, up to :data:`SAMPLE_BYTES`, and stands, itself compressed, in a
skippable frame at the head of the file; each record is a frame of its own, so any of them can be read alone.
A payload that occurs more than once is stored once, by the row with the largest id; the others are
``revisit`` records that refer to it. Payloads are equal if their SHA-256 and length are; the owner of one that
several rows have is found by a pre-aggregated ``max`` on these. A list of such payloads that is short enough is
broadcast to the pages, which then stay where they are; a longer one is joined by a shuffle (which adaptive
execution can split). The SHA-1 of the records' headers decides nothing.

Archives of failed or repeated task attempts have other names and are not in the manifest. The reader streams
the archives that the manifest names, one per row, and checks each payload against its digest.

Edge cases: a null payload is the empty one; null ids are archived like others, and own a payload only if no
other id does; rows that repeat an owner's id and payload are responses too; a null URL becomes a placeholder
and control characters in URLs are escaped; too few or too small records for a trained dictionary give a
dictionary of raw content; an empty table gives no archive and an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import discard, drop_path, materialize, work_dir

#: The frame that holds a dictionary, and the revisit profile.
DICT_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 16 << 20
#: A list of at most so many repeated payloads (some 60 bytes each) is broadcast.
BROADCAST_PAYLOADS = 250_000
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NO_URL = "urn:graphloom:no-url"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit keeps the payload's digest and length but not the payload."""
    body = HTTP_HEAD if revisit else HTTP_HEAD + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:graphloom:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else NO_URL}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:graphloom:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict[str, str | bytes]:
    """Headers by lower-case name, and ``payload``."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    out: dict[str, str | bytes] = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        out[name.lower()] = value
    body = rest[: int(out["content-length"])]
    out["payload"] = body.partition(b"\r\n\r\n")[2]
    return out


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records spread over the archive."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = [r[: 128 << 10] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes]) -> bytes:
    """The whole file: dictionary frame, then a frame for each record."""
    dictionary = build_dictionary(records)
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
    return b"".join([struct.pack("<II", DICT_FRAME, len(packed)), packed, *map(compressor.compress, records)])


def read_archive(raw: bytes) -> Iterator[bytes]:
    """Records of an archive, frame by frame."""
    view = memoryview(raw)
    magic, size = struct.unpack_from("<II", raw)
    if magic != DICT_FRAME:
        raise ValueError("no dictionary frame at the head of the archive")
    packed = bytes(view[8 : 8 + size])
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    at = 8 + size
    while at < len(view):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            chunk = view[at : at + (16 << 10)]
            if not chunk:
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(chunk))
            at += len(chunk) - len(frame.unused_data)
        yield b"".join(parts)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    path: str | None = None,
) -> DataFrame:
    """Archive every row; the manifest ``(archive, n_records, n_bytes)``, already written."""
    path = path or work_dir(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest")
    )
    repeated = rows.groupBy(F.col("digest").alias("owned"), F.octet_length("payload").alias("size")).agg(F.max("id").alias("owner"), F.count("*").alias("n"))
    repeated = materialize(repeated.filter((F.col("n") > 1) & (F.col("size") >= min_revisit_bytes)).select("owned", "size", "owner"), "payloads")
    few = repeated.count() <= BROADCAST_PAYLOADS
    same = (F.col("digest") == F.col("owned")) & (F.octet_length("payload") == F.col("size"))
    roles = rows.join(F.broadcast(repeated) if few else repeated, same, "left").select(
        "id", "url", "payload", "owner", (F.col("owned").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner"))).alias("revisit")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, folder = _open(path)
        target.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        held: list[bytes] = []
        size = seq = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq
            raw = archive_bytes(held)
            file = f"{folder}/{name}-{seq:05d}.warc.zst"
            with target.open_output_stream(file, compression=None) as out:
                out.write(raw)
            row = pa.RecordBatch.from_pydict({"archive": [f"{path}/{name}-{seq:05d}.warc.zst"], "n_records": [len(held)], "n_bytes": [len(raw)]})
            held, size, seq = [], 0, seq + 1
            return row

        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i].as_py() for c in ("id", "url", "payload", "owner", "revisit")}
                held.append(record(one["id"], one["url"], one["payload"], one["owner"], one["revisit"], date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    manifest = materialize(roles.mapInArrow(write, "archive string, n_records long, n_bytes long"), "warc-manifest")
    discard(repeated)
    manifest.archives_in = path
    return manifest


def drop_archives(manifest: DataFrame) -> None:
    """Delete the archives of :func:`write_archives` and their manifest."""
    drop_path(manifest.sparkSession, manifest.archives_in)
    discard(manifest)


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives that ``manifest`` names (column ``archive``)."""

    def number(urn: str | None) -> int | None:
        digits = (urn or "").strip("<>").rpartition(":")[2]
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                source, file = _open(uri)
                with source.open_input_stream(file, compression=None) as f:
                    raw = f.read()
                rows: dict[str, list] = {c: [] for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
                held = 0
                for one in map(parse, read_archive(raw)):
                    kind, body = one["warc-type"], one["payload"]
                    digest = one["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (digest != base32_sha1(body) or len(body) != int(one["x-payload-length"])):
                        raise ValueError(f"a payload in {uri} differs from its digest")
                    values = (number(one["warc-record-id"]), one["warc-target-uri"], int(one["x-payload-length"]), digest, kind,
                              number(one.get("warc-refers-to")), body if with_payload and kind == "response" else None)
                    for column, value in zip(rows.values(), values, strict=True):
                        column.append(value)
                    held += len(body)
                    if held > (8 << 20):
                        yield pa.RecordBatch.from_pydict(rows, schema=READ_ARROW)
                        rows, held = {c: [] for c in rows}, 0
                yield pa.RecordBatch.from_pydict(rows, schema=READ_ARROW)

    n = max(1, manifest.count())
    # dealt out in turn: a task for each archive
    spread = manifest.select("archive").repartition(min(n, 100_000))
    return spread.mapInArrow(read, READ_SCHEMA)


READ_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def archive_table(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives and read the records back."""
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
