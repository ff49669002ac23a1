"""WARC archives whose records are compressed one by one with a common dictionary.

A Zstandard dictionary is built from a sample of the records to be archived. Every archive starts
with a skippable frame (magic ``0x184D2A5D``) that holds the dictionary, so a file can be read without
anything else; each record after it is a frame of its own and can be read from its offset alone.

Pages with equal payloads are stored once: the page with the smallest identifier is a ``response``,
the others are ``revisit`` records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import Any, BinaryIO

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import column, file_system, join_hot, map_pandas, new_folder, one_file_a_task, sized
from tidyloom.session import cut

MAGIC = 0x184D2A5D
LEVEL, DICTIONARY_BYTES = 3, 64 << 10
#: Bounds of the dictionary's sample: records, and bytes of each.
SAMPLE_RECORDS, SAMPLE_BYTES = 600, 16 << 10
#: Compressed bytes after which a task goes on with a new archive.
ARCHIVE_BYTES = 64 << 20
#: Payloads from this length on are stored once.
LEAST_PAYLOAD = 0
#: The tables have no time of capture, and equal runs should write equal archives.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: Any) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _line(value: str | None) -> str:
    """A header value: characters that would end or break the line are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "about:blank")


def page_record(page_id: Any, url: str | None, payload: bytes, first: Any, is_revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if is_revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(first))]
    return _record(fields, http if is_revisit else http + payload)


def build_dictionary(records: list[bytes]) -> bytes:
    """From sample records; too few to train on serve as they are, none at all leave the common headers."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        joined = b"".join(records)[-DICTIONARY_BYTES:]
        return joined if len(joined) >= 8 else page_record(0, "http://", b"<html><body></body></html>", None, False)


class Archive:
    """Writes one file."""

    def __init__(self, stream: BinaryIO, dictionary: bytes):
        self.stream, self.size, self.records = stream, 0, 0
        data = zstandard.ZstdCompressionDict(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)
        self._put(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)
        self.add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo')}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.records = 0

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))
        self.records += 1


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one record in memory at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    data, at = stream.read(READ), 0
    while at < len(data):
        frame, parts = context.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                data, at = stream.read(READ), 0
                if not data:
                    raise ValueError("the archive ends inside a record")
            piece = data[at : at + 8192]
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        if at >= len(data):
            data, at = stream.read(READ), 0
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive all pages; ``(path, records, bytes)`` of each file.

    Tasks write files of their own names and report them when they end, so what a lost or repeated
    task has left behind is on no list and is never read.
    """
    spark = pages.sparkSession
    payload = F.coalesce(column(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(column(id_col).alias("page_id"), column(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    known = cut(rows.where((F.octet_length("payload") >= LEAST_PAYLOAD) & F.col("page_id").isNotNull()).select("page_id", "same"))
    groups = known.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    revisits = join_hot(known, cut(groups.where("n > 1")), "same", "n").where("page_id <> first").distinct()
    rows = rows.join(sized(revisits.select("page_id", "same", "first")), ["page_id", "same"], "left")

    drawn = rows.select("page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload"))
    total = max(1, known.count())
    draw = F.pmod(F.xxhash64("page_id", F.lit(11)), F.lit(1 << 20)) < F.lit((1 << 20) * SAMPLE_RECORDS / total)
    sample = pages.sparkSession.createDataFrame([], drawn.schema) if total == 1 else drawn.where(draw).limit(2 * SAMPLE_RECORDS)
    records = [page_record(r["page_id"], r["url"], bytes(r["payload"]), None, False) for r in sample.collect()]
    dictionary = build_dictionary(sorted(records))
    folder = new_folder(spark, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        task = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4()}"
        done, archive, n = [], None, 0

        def end() -> None:
            archive.stream.close()
            done.append((f"{folder}/{path.rsplit('/', 1)[1]}", archive.records, archive.size))

        for b in batches:
            for page, url, data, first in zip(b["page_id"], b["url"], b["payload"], b["first"], strict=True):
                if archive is None:
                    path = f"{task}-{n:04d}.warc.zst"
                    archive, n = Archive(store.open_output_stream(path), dictionary), n + 1
                page, first = (None if pd.isna(x) else int(x) for x in (page, first))
                archive.add(page_record(page, url, bytes(data), first, first is not None))
                if archive.size >= ARCHIVE_BYTES:
                    end()
                    archive = None
        if archive is not None:
            end()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    written = map_pandas(rows.select("page_id", "url", "payload", "first"), write, "path string, records bigint, bytes bigint")
    return cut(written)


def read_archives(files: DataFrame) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)`` of each page record of ``files(path)``.

    A response's payload is checked against its digest; that of a revisit is null, its length stands
    in the archived headers.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for b in batches:
            for path in b["path"]:
                store, at = file_system(path)
                rows, held = [], 0
                with store.open_input_stream(at) as stream:
                    for fields, block in read_records(stream):
                        kind = fields["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                        sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != size or digest(payload) != sha):
                            raise ValueError(f"a damaged record in {path}: {fields['WARC-Record-ID']}")
                        refers = _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((_page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, sha, kind, refers, payload if kind == "response" else None))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield _frame(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    return map_pandas(one_file_a_task(files.select("path")), read, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages and read them back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    A null page is an empty payload, a null address ``about:blank``. Of pages with equal payloads the one with
    the smallest identifier is the response; rows that repeat that identifier are responses too, and so
    are rows with a null identifier. An empty table gives no archive. Other columns are not read.
    """
    return read_archives(write_archives(pages, id_col, url_col, html_col)).drop("url", "payload")
