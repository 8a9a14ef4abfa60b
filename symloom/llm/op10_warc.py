"""Dictionary-compressed WARC writer: records compressed one by one with a Zstandard dictionary from the records themselves.

Pages are spread evenly over files, in a fixed order within a file. Each file begins with a skippable frame
that holds the file's dictionary, built from all of its records; then comes a record about the file, and one frame for every record, so a record can be
read alone by its offset. Files are written beside their final place and renamed, and their contents depend on the table and its partitions alone, so a
task that is run again after a loss, or twice at once, leaves the same file. The result is the index of all records.

Nulls: a null html is an empty payload, a null url an empty target, a null page_id is indexed as null. Empty and very long payloads are
records like others. Repeated rows are records each. If records are too few or too small to train on, their text itself is the dictionary.
Other columns are not looked at. An empty table gives no file and no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.store import fresh_path, table, written

#: Payload bytes a file, about; bytes of a dictionary; compression level.
FILE_BYTES, DICTIONARY_BYTES, LEVEL = 16_000_000, 65_536, 6
#: The skippable frame in which readers look for a dictionary.
SKIPPABLE = 0x184D2A5D
#: Pages have no date of their own, and one of the run would make files differ.
DATE = "1970-01-01T00:00:00Z"
#: Bytes that a reader decompresses at once.
STEP = 65_536
INDEX = "page_id bigint, url string, warc_file string, frame_offset bigint, frame_length bigint, record_length bigint, payload_sha256 string"


def record(url: str | None, payload: bytes, number: str, date: str = DATE) -> bytes:
    """A resource record of WARC 1.1."""
    digest = hashlib.sha256(payload).hexdigest()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{number} {target} {digest}')}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def info(name: str, date: str = DATE) -> bytes:
    """The record that describes a file; it isn't in the index."""
    body = f"software: symloom\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained on all records; of their own text where that is too little for training."""
    # a sample longer than the dictionary trains no better than its pieces, and pieces keep it whole
    samples = [r[i : i + size] for r in records for i in range(0, len(r), size)]
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-size:].rjust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def encode(records: list[bytes], level: int = LEVEL) -> list[bytes]:
    """The frames of a file: the dictionary's, then one a record. The first record describes the file and isn't trained on."""
    d = dictionary(records[1:])
    body = d.as_bytes()
    press = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True, write_checksum=True)
    return [struct.pack("<II", SKIPPABLE, len(body)) + body, *map(press.compress, records)]


def decode(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offsets and records of a file."""
    magic, size = struct.unpack("<II", data[:8])
    if magic != SKIPPABLE:
        raise ValueError("the file doesn't begin with its dictionary")
    body = data[8 : 8 + size]
    if body[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary may itself be compressed
        body = zstandard.ZstdDecompressor().decompress(body)
    trained = body[:4] == b"\x37\xa4\x30\xec"
    d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    press, at = zstandard.ZstdDecompressor(dict_data=d), 8 + size
    view = memoryview(data)
    while at < len(data):
        one, out, to = press.decompressobj(), [], at
        while not one.eof and to < len(data):
            out.append(one.decompress(view[to : to + STEP]))
            to = min(to + STEP, len(data))
        yield at, b"".join(out)
        at = to - len(one.unused_data)


def payload(rec: bytes) -> tuple[str, bytes] | None:
    """Target and payload of a record; None for one that describes the file."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return None if fields["WARC-Type"] == "warcinfo" else (fields["WARC-Target-URI"], rest[: int(fields["Content-Length"])])


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes all pages below path and gives the index, one row a record."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("html"))
    total = own.agg(F.sum(F.octet_length("html") + 400)).first()[0] or 0
    files = max(1, -(-int(total) // file_bytes))
    # by the number of the row: rows that repeat, however often, are in all files alike
    spread = own.withColumn("file", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files)).cast("int"))

    def one_file(number: int, rows: list[tuple]) -> pa.RecordBatch:
        name = f"part-{number:06d}.warc.zst"
        records = [record(url, html, str(page)) for page, url, html in rows]
        frames = encode([info(name), *records], level)
        fs, at = filesystem(f"{path}/{name}")
        fs.create_dir(os.path.dirname(at), recursive=True)
        hidden = f"{os.path.dirname(at)}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(hidden) as out:
            for x in frames:
                out.write(x)
        fs.move(hidden, at)
        sizes = list(map(len, frames))
        offsets = list(itertools.accumulate(sizes))
        digest = [hashlib.sha256(r[2]).hexdigest() for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([name] * len(rows)), pa.array(offsets[1:-1], pa.int64()), pa.array(sizes[2:], pa.int64()), pa.array(list(map(len, records)), pa.int64()), pa.array(digest)], ["page_id", "url", "warc_file", "frame_offset", "frame_length", "record_length", "payload_sha256"])

    def run(batches):
        number, rows = None, []
        for batch in batches:
            for file, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if file != number and rows:
                    yield one_file(number, rows)
                    rows = []
                number = file
                rows.append(tuple(row))
        if rows:
            yield one_file(number, rows)

    ordered = spread.repartitionById(files, "file").sortWithinPartitions("file", "page_id", "url", F.xxhash64("html"), "html").select("file", "page_id", "url", "html")
    return written(ordered.mapInArrow(run, INDEX), "warc-index")[0]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows (warc_file, frame_offset, url, html) of all files below path."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(name.rsplit("/", 1)[-1], at, *found) for at, rec in decode(content) if (found := payload(rec))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["warc_file", "frame_offset", "url", "html"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")
    return files.mapInArrow(run, "warc_file string, frame_offset bigint, url string, html binary")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_warc(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))


def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the index: which records there are, their lengths and digests."""
    return op10_warc(spark, sf_dir).select("page_id", "url", "record_length", "payload_sha256")


SQL = None
_HEAD = len(record("", b"", "")) - 1  # without the target, the payload and its length
RECORDS_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS target FROM pages)
SELECT page_id, url, ({_HEAD} + strlen(target) + length(strlen(html)::VARCHAR) + strlen(html))::BIGINT AS record_length, sha256(html) AS payload_sha256 FROM p
"""
