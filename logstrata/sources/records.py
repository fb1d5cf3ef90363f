"""Framed log files as DataFrames: segments and write-ahead logs, read and written.

Two frames, little-endian. A segment record is crc, unix seconds, key size and
value size (20 bytes: 4, 8, 4, 4), then key and value; the crc covers all after
it, and an empty value is a delete. A log record is crc, sequence, key size,
value size and a delete mark (21 bytes: 4, 8, 4, 4, 1), then key and value.
A file is decoded by one task; files are bounded by rotation. Keys and values are
opaque bytes: ``binary`` gives them as such, else they must be UTF-8 and a record
that isn't is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.model import Corrupt

_SEGMENT, _LOG = struct.Struct("<IqII"), struct.Struct("<IQIIB")
SEGMENT_SCHEMA = "file_num bigint, offset bigint, size bigint, ts bigint, key string, value string, deleted boolean"
LOG_SCHEMA = "file string, seq bigint, key string, value string, deleted boolean"


def segment_record(ts: int, key: bytes, value: bytes) -> bytes:
    body = struct.pack("<qII", ts, len(key), len(value)) + key + value
    return struct.pack("<I", zlib.crc32(body)) + body


def segment_size(key: bytes, value: bytes) -> int:
    return _SEGMENT.size + len(key) + len(value)


def log_record(seq: int, key: bytes, value: bytes, deleted: bool) -> bytes:
    body = struct.pack("<QIIB", seq, len(key), len(value), deleted) + key + value
    return struct.pack("<I", zlib.crc32(body)) + body


def _frames(raw: bytes, kind: str, mode: str) -> Iterator[tuple[int, tuple, bytes, bytes]]:
    """(offset, header, key, value) up to the end or the first damaged frame; ``fail`` raises there, ``skip`` goes on
    after a frame that is whole and has a wrong checksum."""
    head = _SEGMENT if kind == "segment" else _LOG
    at = 0
    while at < len(raw):
        whole = at + head.size <= len(raw)
        fields = head.unpack_from(raw, at) if whole else ()
        end = at + head.size + fields[2] + fields[3] if whole else 0
        if not whole or end > len(raw) or zlib.crc32(raw[at + 4 : end]) != fields[0]:
            if mode == "fail":
                raise Corrupt(f"damaged record at byte {at}")
            if mode == "skip" and whole and end <= len(raw):
                at = end
                continue
            return
        body = at + head.size
        yield at, fields, raw[body : body + fields[2]], raw[body + fields[2] : end]
        at = end


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, "*.seg").withColumn("number", F.regexp_extract("path", r"/(\d+)\.seg$", 1)).where("number != ''")


def _typed(schema: str, binary: bool) -> str:
    return schema.replace("key string, value string", "key binary, value binary") if binary else schema


def _plain(raw: bytes, binary: bool) -> bytes | str:
    if binary:
        return raw
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        raise Corrupt("a key or value isn't UTF-8; read it as binary") from e


def read_segments(spark: SparkSession, path: str, *, mode: str = "truncate", binary: bool = False) -> DataFrame:
    """Records of ``<number>.seg`` files; other names are ignored. The order of writing is (file_num, offset)."""
    files = _segments(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, raw in zip(batch.number, batch.content, strict=True):
                rows = [(int(number), at, segment_size(k, v), h[1], _plain(k, binary), _plain(v, binary) if v else None, not v) for at, h, k, v in _frames(bytes(raw), "segment", mode)]
                yield pd.DataFrame(rows, columns=["file_num", "offset", "size", "ts", "key", "value", "deleted"])

    return files.select("number", "content").mapInPandas(run, _typed(SEGMENT_SCHEMA, binary))


def read_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The segment records at ``places`` (file_num, offset, size), such as those of an index: ts, key, value (binary) and
    ``ok``, does the checksum hold. One row of places for each file meets the file; only the bytes of a record are cut out."""
    files = _segments(spark, path).select(F.col("number").cast("long").alias("file_num"), "content")
    wanted = places.groupBy("file_num").agg(F.collect_list(F.struct("offset", "size")).alias("at"))  # bounded by a file's records
    cut = F.expr("transform(at, p -> struct(p.offset as offset, p.size as size, substring(content, cast(p.offset as int) + 1, cast(p.size as int)) as record))")
    found = wanted.join(files, "file_num").select("file_num", F.inline(cut))

    def number(start: int, width: int):
        digits = F.concat(*[F.hex(F.expr(f"substring(record, {start + i}, 1)")) for i in reversed(range(width))])
        return F.conv(digits, 16, 10).cast("long")

    n = number(13, 4).cast("int")
    sized = found.withColumn("n", n).withColumn("ok", (F.octet_length("record") == F.col("size")) & (number(1, 4) == F.crc32(F.expr("substring(record, 5)"))))
    value = F.expr("substring(record, 21 + n)")
    return sized.select("file_num", "offset", "size", number(5, 8).alias("ts"), F.expr("substring(record, 21, n)").alias("key"), F.when(F.octet_length(value) > 0, value).alias("value"), "ok")


def read_log(spark: SparkSession, path: str, *, mode: str = "fail", glob: str = "*.wal", binary: bool = False) -> DataFrame:
    """Records of write-ahead log files as an op log."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch.path, batch.content, strict=True):
                rows = [(name, h[1], _plain(k, binary), None if h[4] else _plain(v, binary), bool(h[4])) for _, h, k, v in _frames(bytes(raw), "log", mode)]
                yield pd.DataFrame(rows, columns=["file", "seq", "key", "value", "deleted"])

    return _files(spark, path, glob).mapInPandas(run, _typed(LOG_SCHEMA, binary))


def as_ops(segments: DataFrame) -> DataFrame:
    """Segment records as an op log, numbered by place: file number first, then offset."""
    return segments.select("key", F.struct("file_num", "offset").alias("seq"), "value", "deleted")


def encode_log(ops: DataFrame) -> DataFrame:
    """(seq, record): the log frame of each operation, by SQL functions."""

    def little(value, width: int):
        digits = F.lpad(F.hex(value.cast("long")), width * 2, "0")
        return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])

    key, value = F.col("key").cast("binary"), F.coalesce(F.col("value"), F.lit("")).cast("binary")
    body = F.concat(little(F.col("seq"), 8), little(F.octet_length(key), 4), little(F.octet_length(value), 4), little(F.col("deleted").cast("int"), 1), F.hex(key), F.hex(value))
    raw = F.unhex(body)
    return ops.select("seq", F.concat(F.unhex(little(F.crc32(raw), 4)), raw).alias("record"))
