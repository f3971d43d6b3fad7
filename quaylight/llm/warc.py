"""WARC archives compressed with Zstandard: one frame per record, dictionary in a leading skippable frame.

An archive is a skippable frame (magic 0x184D2A5D) with the dictionary, then a frame per record. A repeated payload
is written once; later pages hold a revisit record that refers to the first.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.llm.common import save, shared_dir

MAGIC_DICTIONARY = 0x184D2A5D
MAGIC_FRAME = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 64 << 20
#: A dictionary is trained on the first records of its archive, up to so many bytes.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
VERSION = b"WARC/1.1"


class BadArchive(ValueError):
    """A frame, header or length that breaks the format."""


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record. The block of a response is an HTTP answer with the payload; that of a revisit has only its head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    clean = "".join(c for c in url or "" if c.isprintable() and c != " ")
    lines = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>"]
    lines += [f"WARC-Target-URI: {clean}"] if clean else []
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, payload and sizes of a record, checked: version, separators, both lengths, the digest."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not sep or first != VERSION:
        raise BadArchive("no record head of this version")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise BadArchive(f"no header: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    missing = [x for x in ("warc-type", "warc-record-id", "warc-payload-digest", "content-length") if x not in fields]
    if missing:
        raise BadArchive(f"missing headers: {missing}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("the block's length isn't that of its header")
    http, sep, payload = rest[:-4].partition(b"\r\n\r\n")
    sizes = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not sep or len(sizes) != 1 or not sizes[0].isdigit():
        raise BadArchive("no HTTP head with one length")
    kind, size, digest = fields["warc-type"], int(sizes[0]), fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise BadArchive("the payload isn't that of its length and digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise BadArchive(f"no response and no revisit of another record: {kind}")
    number = lambda urn: None if (x := urn.removeprefix("<urn:page:").removesuffix(">")) == "null" else int(x)
    return {"page_id": number(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields["warc-refers-to"]) if kind == "revisit" else None, "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few samples give a raw one of their own bytes."""
    import zstandard

    if len(samples) >= 16 and sum(map(len, samples)) >= 16 * DICTIONARY_BYTES // 4:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:DICTIONARY_BYTES] or b"\r\n\r\n\r\n\r\n"


def archive_chunks(records: Iterable[bytes]) -> Iterator[bytes]:
    """An archive's bytes, part by part."""
    import zstandard

    held, size, records = [], 0, iter(records)
    for r in records:
        held.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    words = dictionary_of([r[:8192] for r in held])
    yield struct.pack("<II", MAGIC_DICTIONARY, len(words)) + words
    press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True, write_checksum=True)
    for r in held:
        yield press.compress(r)
    held.clear()
    for r in records:
        yield press.compress(r)


def read_archive(file) -> Iterator[bytes]:
    """The records of an open archive, a frame at a time: only one record and a read buffer are in memory."""
    import zstandard

    head = file.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != MAGIC_DICTIONARY:
        raise BadArchive("no leading dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    words = file.read(size)
    if len(words) != size:
        raise BadArchive("the dictionary frame is cut short")
    if words[:4] == MAGIC_FRAME:  # the dictionary may itself be compressed
        words = zstandard.ZstdDecompressor().decompress(words)
    open_frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    rest = b""
    while True:
        rest = rest or file.read(1 << 16)
        if not rest:
            return
        frame, out = open_frame.decompressobj(), []
        while not frame.eof:
            if not rest:
                rest = file.read(1 << 16)
                if not rest:
                    raise BadArchive("the last frame is cut short")
            try:
                out.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise BadArchive(str(e)) from e
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def file_system(uri: str):
    """pyarrow's file system and path for a Spark path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def with_roles(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, payload, _digest, _refers (null for responses). Equal payloads meet as digests, before html is moved.

    Of equal payloads of `least` bytes or more, rows of the smallest page_id are responses. Rows that repeat that id and
    payload are responses too; rows without a page_id come last, and are responses if no other has their payload.
    """
    full = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("_digest", F.sha2("payload", 256))
    light = full.where(F.octet_length("payload") >= least).select("page_id", "_digest")
    first = light.groupBy("_digest").agg(F.min("page_id").alias("_refers"), F.count("*").alias("_n")).where("_n > 1 and _refers is not null").drop("_n")
    again = light.distinct().join(first, "_digest").where("page_id is null or page_id > _refers")
    again = again.select(F.col("page_id").alias("_id"), F.col("_digest").alias("_d"), "_refers")
    return full.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d")), "left").drop("_id", "_d")


def write_archives(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Write all pages as archives in a shared folder; a row for each archive: path, n_records, n_bytes.

    A task's files have names of their own attempt, and only those of attempts that ended are listed. An empty table
    gives no archive. Extra columns are left out; a null html is an empty payload, a null url no target header.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        left = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "_digest", "_refers"))))
        row = next(left, None)
        while row is not None:
            n, size = 0, 0

            def some() -> Iterator[bytes]:
                nonlocal row, n, size
                while row is not None and size < ARCHIVE_BYTES:
                    page_id, url, payload, digest, refers = row
                    made = record_bytes(page_id, url, payload, digest, refers, refers is not None)
                    n += 1
                    size += len(made)
                    row = next(left, None)
                    yield made

            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(path) as out:
                for part in archive_chunks(some()):
                    out.write(part)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    return save(with_roles(pages, least).mapInArrow(run, "path string, n_records long, n_bytes long"))


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of listed archives, checked: page_id, payload_bytes, payload_digest, record_type, refers_to, url and, if asked for, payload."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds[n]) for n in names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist()):
                fs, at = file_system(path)
                seen, held = 0, []
                with fs.open_input_stream(at) as file:
                    for raw in read_archive(file):
                        row = parse_record(raw)
                        held.append({k: row[k] for k in names})
                        seen += 1
                        if len(held) == 500:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                if seen != n:
                    raise BadArchive(f"{path}: {seen} records, not {n}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    count = max(1, archives.count())
    return archives.select("path", "n_records").repartition(min(count, 2000)).mapInArrow(run, ddl)


def archive_round_trip(spark: SparkSession, pages: DataFrame, least: int = 100) -> DataFrame:
    return read_archives(write_archives(pages, shared_dir(spark), least))
