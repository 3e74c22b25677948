"""A WARC writer that compresses each record by itself against a dictionary built from the archive's own records."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import attach, cut, new_path

#: Fixed values of the formats: the skippable frame that holds a dictionary, and the revisit profile.
DICT_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DIGEST = re.compile(rb"^WARC-Payload-Digest: sha256:([0-9a-f]{64})\r$", re.M)
_LENGTH = re.compile(rb"^Content-Length: (\d+)\r$", re.M)
_TYPE = re.compile(rb"^WARC-Type: (\w+)\r$", re.M)
_ROW = re.compile(rb"^WARC-X-Row-Id: (\S*)\r$", re.M)
_REFERS_ROW = re.compile(rb"^WARC-X-Refers-To-Row-Id: (\S*)\r$", re.M)
_NS = uuid.UUID("5a1d3f52-5b52-4f52-9d5e-2f6f6c2f0c11")


def open_store(path: str):
    """The file system and inner path of a folder, as every executor can open it (file:, hdfs:, s3:, s3a:, gs:, ...)."""
    from pyarrow import fs

    path = re.sub(r"^s3[an]://", "s3://", path)
    if re.match(r"^file:/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _urn(name: str | None) -> str:
    """A record id that a name fixes, or a new one."""
    return f"<urn:uuid:{uuid.uuid4() if name is None else uuid.uuid5(_NS, name)}>"


def record(row_id, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to, date: str, named: bool = False) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone, which states the full payload's length.

    named: the digest has one response alone, whose record id follows from the digest, so that revisits can refer to it;
    all other records have new ids, however often a row repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(digest if named and refers_to is None else None)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'\s', '%20', url or 'urn:unknown')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if row_id is not None:
        head.append(f"WARC-X-Row-Id: {quote(str(row_id), safe='')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-X-Refers-To-Row-Id: {quote(str(refers_to), safe='')}"]
        head += [f"WARC-Refers-To: {_urn(digest)}"] * named
    block = http if refers_to is not None else http + payload
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int) -> bytes:
    """A dictionary from all given records; where they are too few or too small to train on, their plain end."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, records, k=256, d=8, steps=1, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def write_archive(out, records: list[bytes], dict_size: int, level: int) -> None:
    """The dictionary in a leading skippable frame, then a frame for each record."""
    import zstandard

    raw = build_dictionary(records, dict_size)
    data = zstandard.ZstdCompressionDict(raw)
    out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True)
    for r in records:
        out.write(packer.compress(r))


def read_archive(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The records of one archive, one after another; memory holds one record and one piece of the file."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary frame leads this archive")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    rest = b""
    while True:
        if not rest and not (rest := stream.read(piece)):
            return
        one = unpacker.decompressobj()
        parts = [one.decompress(rest)]
        while not one.eof:
            more = stream.read(piece)
            if not more:
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(more))
        rest = one.unused_data
        yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """What a record's headers say, and its payload (None for a revisit), checked against the stated digest."""
    import hashlib

    head, _, rest = raw.partition(b"\r\n\r\n")
    block = rest[: int(_LENGTH.search(head + b"\r")[1])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = _TYPE.search(head)[1].decode(), _DIGEST.search(head)[1].decode()
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload doesn't have its stated digest")
    row, refers = _ROW.search(head), _REFERS_ROW.search(head + b"\r")
    return {"row_id": row and unquote(row[1].decode()), "payload_bytes": int(_LENGTH.search(http + b"\r")[1]), "payload_digest": digest, "record_type": kind, "refers_to": refers and unquote(refers[1].decode()), "payload": payload if kind == "response" else None}


def _plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """Each page with its digest and, for a revisit, the response it refers to.

    The smallest id of a digest is pre-aggregated on the map side. Where few digests repeat, they are broadcast and pages
    stay where they are; of more, each is dealt over several tasks, so that a digest with a third of all pages is split."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    payload = F.encode(html, "UTF-8")
    rows = pages.select(F.col(id_col).alias("row_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    ids = rows.filter((F.col("n") >= least_bytes) & F.col("row_id").isNotNull()).groupBy("digest", "row_id").agg(F.count("*").alias("same"))
    least = ids.groupBy("digest").agg(F.min(F.struct("row_id", "same")).alias("first"), F.sum("same").alias("copies")).filter("copies > 1").select("digest", F.col("first.row_id").alias("first_id"), (F.col("first.same") == 1).alias("named"))
    joined = attach(rows, cut(least, "warc-first"), "digest", spread="row_id", how="left")
    revisit = F.col("first_id").isNotNull() & F.col("row_id").isNotNull() & (F.col("row_id") != F.col("first_id"))
    named = F.coalesce("named", F.lit(False)) & F.col("row_id").isNotNull()
    return joined.select("row_id", "url", F.when(~F.coalesce(revisit, F.lit(False)), F.col("html")).alias("html"), "digest", "n", F.when(revisit, F.col("first_id")).alias("refers_to"), named.alias("named"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, archive_bytes: int = 8 << 20, dict_size: int = 16 << 10, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row of pages into archives below folder; returns their manifest (path, n_records, n_bytes).

    A null html is an empty payload, a null url `urn:unknown`, and a null id gives a response that nothing refers to.
    Ids are of any type that casts to a string and back. Rows that repeat a response's id and payload are responses too;
    as none of them is the one, revisits then state its row id but no record id. Every record has an id of its own. Of equal payloads of at least least_bytes, that with
    the smallest id is the response. Each archive takes about archive_bytes of records and trains its own dictionary on
    all of them. An attempt writes files of its own, and only those of attempts that Spark commits reach the manifest,
    so that a lost executor or a speculative copy leaves nothing in it twice."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path = f"{root.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(path, compression=None) as out:
                write_archive(out, held, dict_size, level)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])

        store.create_dir(root, recursive=True)
        for batch in batches:
            for k in range(batch.num_rows):
                row, url, html, digest, n, refers, named = (batch.column(c)[k].as_py() for c in range(7))
                payload = html.encode() if html is not None else b""
                raw = record(row, url, payload, n, digest, refers, date, named)
                held.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    planned = _plan_records(pages, id_col, url_col, html_col, least_bytes)
    return cut(planned.mapInArrow(write, "path string, n_records bigint, n_bytes bigint"), "warc-manifest")


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = False, id_type: str = "bigint") -> DataFrame:
    """A row for each record of the manifest's archives; every response's payload is held against its digest.

    Ids are read as strings and cast to id_type."""
    names = ["row_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * with_payload
    schema = "row_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for raw in read_archive(stream):
                        rows.append(parse_record(raw))
                        size += len(raw) if with_payload else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    n = manifest.sparkSession.sparkContext.defaultParallelism
    made = manifest.select("path").repartition(max(n, 1)).mapInArrow(read, schema)
    return made.withColumns({c: F.col(c).cast(id_type) for c in ("row_id", "refers_to")})


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write every row of pages into archives of a new shared folder and read all records back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder, **options), folder, id_type=pages.schema[options.get("id_col", "page_id")].dataType.simpleString())
