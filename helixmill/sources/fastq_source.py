"""FASTQ files as a Spark data source: spark.read.format("fastq") and spark.readStream.format("fastq").

A plain file is read in splits whose ends are moved to the next record, so each
record is read once, by one task, in one pass; a gzip file is one split.  Files
are reached by pyarrow's file systems (local or mounted paths, hdfs, s3, gs).
Of four lines that follow each other only a record's first one begins with @
and has one that begins with + two lines on, so a task finds its first record
without having seen what stands before its split.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 128 << 20
#: Bytes that are read at a time.
_CHUNK = 4 << 20
SCHEMA = "file string, split bigint, at bigint, header string, seq string, mid string, qual string"
_COLUMNS = ["file", "split", "at", "header", "seq", "mid", "qual"]


@dataclass
class _Split(InputPartition):
    path: str
    name: str
    start: int
    stop: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def _uri(path: str, system: fs.FileSystem, inner: str) -> str:
    """The name that Spark gives a file."""
    from pathlib import Path

    return Path(inner).absolute().as_uri() if isinstance(system, fs.LocalFileSystem) else path


def _listed(path: str) -> list[tuple[str, fs.FileInfo]]:
    """(path, info) of a file, or of the files in a folder."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info)]
    found = [i for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and i.base_name[0] not in "._"]
    return [(f"{path.rstrip('/')}/{i.base_name}", i) for i in sorted(found, key=lambda i: i.base_name)]


def _splits(files: list[tuple[str, fs.FileInfo]], size: int) -> list[_Split]:
    out = []
    for path, info in files:
        name = _uri(path, *_opened(path))
        step = max(1, info.size) if path.endswith(".gz") else size
        out += [_Split(path, name, at, min(at + step, info.size)) for at in range(0, info.size, step)]
    return out


def _lines(stream, at: int) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, lines) of a stream that stands at `at`, whole lines only, piece by piece."""
    rest = b""
    while data := stream.read(_CHUNK):
        lines = (rest + data).split(b"\n")
        rest = lines.pop()
        if lines:
            yield at, lines
            at += sum(map(len, lines)) + len(lines)
    if rest:
        yield at, [rest]


def _begins_record(lines: list[bytes]) -> bool:
    """Whether these are the four lines of a record."""
    return len(lines) == 4 and lines[0].startswith(b"@") and lines[2].startswith(b"+") and len(lines[1].rstrip()) == len(lines[3].rstrip())


def _records(split: _Split) -> Iterator[pa.RecordBatch]:
    """The records whose first byte lies in the split."""
    system, inner = _opened(split.path)
    zipped = split.path.endswith(".gz")
    with system.open_input_stream(inner) if zipped else system.open_input_file(inner) as stream:
        # From the byte before the split on: if a line begins with the split, the one before ends there.
        place, lines, aligned = max(0, split.start - 1), [], split.start == 0
        skip = not aligned
        if skip:
            stream.seek(place)
        for begin, own in chain(_lines(stream, place), [(0, None)]):
            last = own is None
            if not last:
                if skip:
                    begin, own, skip = begin + len(own[0]) + 1, own[1:], False
                place = place if lines else begin
                lines = lines + own
            if not aligned:
                if not last and len(lines) < 7:
                    continue
                first = next((i for i in range(min(4, len(lines))) if _begins_record(lines[i : i + 4])), None)
                if first is None:
                    if len(lines) < 4:  # the end of a record that began before the split
                        return
                    raise ValueError(f"not a FASTQ record: {split.name} {place}")
                place, lines, aligned = place + sum(map(len, lines[:first])) + first, lines[first:], True
            while last and len(lines) % 4 and not lines[-1].strip():
                lines.pop()
            n = len(lines) if last else len(lines) // 4 * 4
            if n:
                yield from _batch(split, place, lines[:n])
            place, lines = place + sum(map(len, lines[:n])) + n, lines[n:]
            if not zipped and place >= split.stop:
                return


def _batch(split: _Split, place: int, lines: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The records of lines that begin at `place`, up to the split's end."""
    if len(lines) % 4:
        raise ValueError(f"not a FASTQ record: {split.name} {place}: the last one is cut off")
    at, places = place, []
    for i in range(0, len(lines), 4):
        if not split.path.endswith(".gz") and at >= split.stop:
            lines = lines[:i]
            break
        places.append(at)
        at += sum(len(x) + 1 for x in lines[i : i + 4])
    if not places:
        return
    if lines[0].endswith(b"\r") or any(x.endswith(b"\r") for x in lines):
        lines = [x.removesuffix(b"\r") for x in lines]
    header, seq, mid, qual = (lines[i::4] for i in range(4))
    for i, (h, s, q) in enumerate(zip(header, seq, qual)):
        if not h.startswith(b"@") or len(s) != len(q):
            raise ValueError(f"not a FASTQ record: {split.name} {places[i]}")
    texts = [pa.array(c, pa.binary()).cast(pa.string()) for c in ([h[1:] for h in header], seq, mid, qual)]
    names = pa.array([split.name] * len(places), pa.string())
    yield pa.RecordBatch.from_arrays([names, pa.array([split.start] * len(places), pa.int64()), pa.array(places, pa.int64()), *texts], names=_COLUMNS)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.size = json.loads(options["paths"]), int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        return _splits([f for p in self.paths for f in _listed(p)], self.size)

    def read(self, partition):
        return _records(partition) if partition else iter(())  # none where there is nothing to read


class _StreamReader(_Reader, DataSourceStreamReader):
    """Files in the order of their time and name; the offset is the last one that was read."""

    def _files(self) -> list[tuple[tuple[int, str], str, fs.FileInfo]]:
        return sorted(((i.mtime_ns or 0, p), p, i) for path in self.paths for p, i in _listed(path))

    def initialOffset(self):
        return {"time": -1, "name": ""}

    def latestOffset(self):
        files = self._files()
        return {"time": files[-1][0][0], "name": files[-1][0][1]} if files else self.initialOffset()

    def partitions(self, start, end):
        low, high = ((o["time"], o["name"]) for o in (start, end))
        return _splits([(p, i) for key, p, i in self._files() if low < key <= high], self.size)

    def read(self, partition):
        return _records(partition) if partition else iter(())  # none where there is nothing to read

    def commit(self, end):
        pass


class FastqSource(DataSource):
    """Options: paths (a JSON list of files and folders), splitBytes.

    Columns: the file, the first byte of the split, the first byte of the
    record (of the unpacked text, if it is gzip), and the record's lines, the
    header without its @.
    """

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def fastq(spark: SparkSession, *paths: str, split_bytes: int = SPLIT_BYTES, stream: bool = False) -> DataFrame:
    """The records of FASTQ files or folders, strictly four lines each; see FastqSource for the columns."""
    spark.dataSource.register(FastqSource)
    reader = spark.readStream if stream else spark.read
    return reader.format("fastq").options(paths=json.dumps(list(paths)), splitBytes=str(split_bytes)).load()


def with_ordinals(reads: DataFrame) -> DataFrame:
    """(file, ordinal, read_id, header, seq, mid, qual) as read_fastq() gives them, from the rows of fastq().

    Splits count their records, and each numbers its own from where the splits before it end.
    """
    counts = reads.groupBy("file", "split").agg(F.count("*").alias("n"))
    starts = counts.selectExpr("file", "split", "sum(n) OVER (PARTITION BY file ORDER BY split) - n AS before", "dense_rank() OVER (ORDER BY file) - 1 AS number")
    rows = reads.withColumn("place", F.row_number().over(Window.partitionBy("file", "split").orderBy("at")) - 1).join(starts, ["file", "split"])
    rows = rows.withColumn("ordinal", F.col("before") + F.col("place"))
    return rows.select("file", "ordinal", F.expr("shiftleft(CAST(number AS BIGINT), 40) + ordinal").alias("read_id"), "header", "seq", "mid", "qual")
