"""Server logs by byte range, as a Spark data source, with the hash of each segment that was read.

A line belongs to the range in which its first byte lies, so ranges that cut lines count each line once. A range is read
in segments of a bounded size, one task each; a segment reads on to the end of its last line. Files are opened through
pyarrow's file systems (local, HDFS, S3 ...), by the URI of their path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SEGMENT_BYTES = 64 << 20
PIECE = 1 << 20


class Segment(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, inner


def lines_of(read_at, size: int, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of each line whose first byte lies in [begin, end); read_at(offset, n) gives bytes of a file."""
    at = begin
    if begin:  # a line that began before is another range's; look at the byte before for its end
        at = begin - 1
        while at < size:
            piece = read_at(at, PIECE)
            found = piece.find(b"\n")
            if found >= 0:
                at += found + 1
                break
            at += len(piece)
    held, start = b"", at
    while start < end and at < size:
        piece = read_at(at, PIECE)
        at += len(piece)
        rows = (held + piece).split(b"\n")
        held = rows.pop()
        for row in rows:
            if start >= end:
                return
            yield start, row
            start += len(row) + 1
    if held and start < end:
        yield start, held


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.only_hash = options["path"], options.get("hash", "false") == "true"
        system, inner = _opened(self.path)
        self.size = system.get_file_info(inner).size
        self.begin = max(0, int(options.get("begin", 0)))
        self.end = min(self.size, int(options.get("end", self.size)))
        self.segment = max(1, int(options.get("segment", SEGMENT_BYTES)))

    def partitions(self) -> list[InputPartition]:
        return [Segment(b, min(b + self.segment, self.end)) for b in range(self.begin, self.end, self.segment)] or [Segment(0, 0)]

    def read(self, partition: Segment) -> Iterator[tuple]:
        if partition.end <= partition.begin:
            return
        system, inner = _opened(self.path)
        with system.open_input_file(inner) as file:
            if self.only_hash:
                digest = hashlib.sha256()
                for at in range(partition.begin, partition.end, PIECE):
                    digest.update(file.read_at(min(PIECE, partition.end - at), at))
                yield partition.begin, partition.end, digest.hexdigest()
            else:
                for offset, line in lines_of(lambda at, n: file.read_at(n, at), self.size, partition.begin, partition.end):
                    yield offset, line.decode("utf-8", "replace")


class LogSource(DataSource):
    """Options: path, begin, end (bytes, the whole file by default), segment (bytes of a task), hash (true: one row a segment
    with its bytes' SHA-256 in place of lines)."""

    @classmethod
    def name(cls) -> str:
        return "hopweave_log"

    def schema(self) -> str:
        return "begin long, end long, sha256 string" if self.options.get("hash", "false") == "true" else "offset long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _source(spark: SparkSession, path: str, begin: int, end: int | None, segment: int):
    spark.dataSource.register(LogSource)
    reader = spark.read.format("hopweave_log").option("path", path).option("begin", begin).option("segment", segment)
    return reader if end is None else reader.option("end", end)


def log_lines(spark: SparkSession, path: str, begin: int = 0, end: int | None = None, segment: int = SEGMENT_BYTES) -> DataFrame:
    return _source(spark, path, begin, end, segment).load()


def segment_hashes(spark: SparkSession, path: str, begin: int = 0, end: int | None = None, segment: int = SEGMENT_BYTES) -> DataFrame:
    return _source(spark, path, begin, end, segment).option("hash", "true").load()


STATUS = r'POST /v1/chat/completions HTTP/1\.1" (\d{3})'


def archive_audit(spark: SparkSession, path: str, stages: list[tuple[str, int, int]], client: DataFrame, segment: int = SEGMENT_BYTES) -> DataFrame:
    """stages: name and byte range of each; client: stage, code, n as the client counted. (stage, code, server, client, agrees)
    of each stage and status code."""
    counts = None
    for name, begin, end in stages:  # a run has few stages
        codes = log_lines(spark, path, begin, end, segment).select(F.explode(F.regexp_extract_all("value", F.lit(STATUS), F.lit(1))).alias("code"))
        own = codes.groupBy("code").agg(F.count(F.lit(1)).alias("server")).withColumn("stage", F.lit(name))
        counts = own if counts is None else counts.unionByName(own)
    if counts is None:
        return spark.createDataFrame([], "stage string, code string, server long, client long, agrees boolean")
    both = counts.join(client.select("stage", "code", F.col("n").cast("long").alias("client")), ["stage", "code"], "full")
    none = F.lit(0).cast("long")
    return both.select("stage", "code", F.coalesce("server", none).alias("server"), F.coalesce("client", none).alias("client")).withColumn("agrees", F.col("server") == F.col("client"))
