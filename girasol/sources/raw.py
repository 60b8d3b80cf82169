"""Raw files in byte ranges: vectors of one width end to end, and lines that are found by their offset.

Both are Python data sources, so a file of any size is read by as many tasks as it has splits. Files are
reached through pyarrow's file systems: a local path, file:, s3:, gs:, abfs: or hdfs: URI.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from girasol.sources.sinks import stored

#: Suffix and type of a shard; where a shard is there in both, the first is read.
KINDS = {"f32": "<f4", "f16": "<f2"}
SPLIT_BYTES = 64 << 20
#: Vectors and bytes of lines that a batch holds.
BATCH_ROWS, READ_BYTES = 8_192, 4 << 20
#: Ranges that are no further apart are read as one.
GAP_BYTES = 64 << 10


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def files_below(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files by name, hidden ones left out."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(at, info.size)]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(at) :].strip("/").split("/") if "=" not in x)
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not hidden(f.path))


@dataclass
class VectorSplit(InputPartition):
    path: str
    kind: str
    first_row: int
    start: int
    rows: int


class VectorReader(DataSourceReader):
    """Splits of whole rows; a range of rows leaves out the splits, and the bytes, beyond it."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.width = options["path"], int(options["width"])
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.low, self.high = int(options.get("firstRow", 0)), int(options.get("lastRow", (1 << 63) - 1))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("row",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[VectorSplit]:
        by_name: dict[str, tuple[str, int, str]] = {}
        for path, size in files_below(self.path):
            name, _, kind = path.rpartition(".")
            if kind in KINDS and (name not in by_name or list(KINDS).index(kind) < list(KINDS).index(by_name[name][2])):
                by_name[name] = (path, size, kind)
        out, before = [], 0
        for path, size, kind in (by_name[n] for n in sorted(by_name)):
            one = np.dtype(KINDS[kind]).itemsize * self.width
            if size % one:
                raise ValueError(f"{path} has {size} bytes, no whole number of rows of {one}")
            step = max(1, self.split_bytes // one)
            for row in range(0, size // one, step):
                low, high = max(row, self.low - before), min(row + step, size // one, self.high - before + 1)
                if low < high:
                    out.append(VectorSplit(path, kind, before + low, low * one, high - low))
            before += size // one
        return out or [VectorSplit("", "f32", 0, 0, 0)]

    def read(self, split: VectorSplit) -> Iterator[pa.RecordBatch]:
        if not split.rows:
            return
        kind = np.dtype(KINDS[split.kind])
        fs, _ = file_system(self.path)
        with fs.open_input_file(split.path) as f:
            f.seek(split.start)
            for at in range(0, split.rows, BATCH_ROWS):
                n = min(BATCH_ROWS, split.rows - at)
                flat = np.frombuffer(f.read(n * kind.itemsize * self.width), kind).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.width), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + split.first_row + at), lists], names=["row", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    part: str
    name: str
    rows: int


class VectorWriter(DataSourceArrowWriter):
    """A shard a task, in the order of the tasks. Shards get their names when all are there; a task that
    is tried again writes another file, and what no commit names is hidden."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.kind = options["path"], options.get("kind", "f32")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, at = file_system(self.path)
        fs.create_dir(at, recursive=True)
        part, rows = f"{at}/_{uuid.uuid4().hex}", 0
        with fs.open_output_stream(part) as f:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index("embedding"))
                f.write(column.flatten().to_numpy(zero_copy_only=False).astype(KINDS[self.kind]).tobytes())
                rows += batch.num_rows
        return Written(part, f"{at}/shard-{TaskContext.get().partitionId():08d}.{self.kind}", rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = file_system(self.path)
        for m in filter(None, messages):
            fs.move(m.part, m.name) if m.rows else fs.delete_file(m.part)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = file_system(self.path)
        for m in filter(None, messages):
            fs.delete_file(m.part)


class RawVectors(DataSource):
    """Rows (row, embedding) of shards *.f32 and *.f16, numbered in the order of their names. Options: width;
    splitBytes; firstRow and lastRow, both included, or filters on row where filter pushdown is on."""

    @classmethod
    def name(cls) -> str:
        return "raw_vectors"

    def schema(self) -> str:
        return "row long, embedding array<float>"

    def reader(self, schema: T.StructType) -> VectorReader:
        return VectorReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options)


@dataclass
class LineSplit(InputPartition):
    path: str
    number: int
    start: int
    end: int


class LineReader(DataSourceReader):
    """Places of the lines that begin in a split."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split_bytes = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[LineSplit]:
        splits = [(p, s, min(size, s + self.split_bytes)) for p, size in files_below(self.path) for s in range(0, size, self.split_bytes)]
        return [LineSplit(p, i, s, e) for i, (p, s, e) in enumerate(splits)] or [LineSplit("", 0, 0, 0)]

    def read(self, split: LineSplit) -> Iterator[pa.RecordBatch]:
        if split.start == split.end:
            return
        fs, _ = file_system(self.path)
        with fs.open_input_file(split.path) as f:
            size, at, seen = f.size(), max(0, split.start - 1), 0
            f.seek(at)
            # A line begins after a newline, or where the file does; the last one ends where its own newline is.
            begun = [0] if split.start == 0 else []
            while True:
                data = f.read(READ_BYTES)
                ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + at
                done = not data or len(data) + at >= size or (len(ends) and ends[-1] + 1 >= split.end)
                starts = np.r_[np.array(begun, np.int64), ends[ends < size - 1] + 1]
                if len(ends) and not begun:
                    ends = ends[1:]
                stops = ends if len(ends) >= len(starts) else np.r_[ends, size] if done else ends
                n = min(len(starts), len(stops))
                whole, lengths = starts[:n], (stops[:n] - starts[:n])
                mine = (whole >= split.start) & (whole < split.end)
                k = int(mine.sum())
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array([split.path] * k), pa.array(np.full(k, split.number, np.int64)), pa.array(np.arange(k) + seen), pa.array(whole[mine]), pa.array(lengths[mine])], names=["file", "split", "place", "offset", "length"])
                    seen += k
                begun = [int(starts[-1])] if len(starts) > n else []
                if done or (begun and begun[0] >= split.end):
                    return
                at += len(data)


class LinePlaces(DataSource):
    """(file, split, place, offset, length) of the lines of a file or folder, newlines not counted."""

    @classmethod
    def name(cls) -> str:
        return "line_places"

    def schema(self) -> str:
        return "file string, split long, place long, offset long, length long"

    def reader(self, schema: T.StructType) -> LineReader:
        return LineReader(self.options)


def vectors(spark: SparkSession, path: str, width: int, *, first_row: int | None = None, last_row: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(row, embedding) of raw shards, or of a range of rows of them; filters on row reach the reader."""
    spark.dataSource.register(RawVectors)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("raw_vectors").option("width", width).option("splitBytes", split_bytes)
    for key, value in (("firstRow", first_row), ("lastRow", last_row)):
        reader = reader if value is None else reader.option(key, value)
    return reader.load(path)


def row_count(path: str, width: int) -> int:
    """Rows of raw shards, by the files' sizes."""
    return sum(s.rows for s in VectorReader({"path": path, "width": str(width)}).partitions())


def write_vectors(df: DataFrame, order: str, vector: str, path: str, *, kind: str = "f32", shards: int | None = None) -> None:
    """Raw shards of ``df``'s vectors along ``order``; all of one width and none null."""
    df.sparkSession.dataSource.register(RawVectors)
    rows = df.select(F.col(order).alias("row"), F.col(vector).cast("array<float>").alias("embedding"))
    dealt = rows.repartitionByRange(shards, "row") if shards else rows.repartitionByRange("row")
    dealt.sortWithinPartitions("row").write.format("raw_vectors").option("kind", kind).mode("append").save(path)


def line_index(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(row, file, offset, length): all lines of a file, or of a folder's files by name, numbered from 0.

    Kept as a table along row, so a lookup reads the row groups that hold what it wants. A line is
    numbered by the lines of the splits before its own, one number a split, and its place there."""
    spark.dataSource.register(LinePlaces)
    places = stored(spark.read.format("line_places").option("splitBytes", split_bytes).load(path))
    counts = places.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("split", F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = places.join(before, "split").select((F.col("before") + F.col("place")).alias("row"), "file", "offset", "length")
    return stored(rows.repartitionByRange("row").sortWithinPartitions("row"))


def read_ranges(f, ranges: list[tuple[int, int]], gap: int = GAP_BYTES) -> Iterator[bytes]:  # noqa: ANN001
    """The bytes of rising (offset, length) ranges of an open file; near ones come from one read."""
    i = 0
    while i < len(ranges):
        j, end = i + 1, ranges[i][0] + ranges[i][1]
        while j < len(ranges) and ranges[j][0] - end <= gap and ranges[j][0] + ranges[j][1] - ranges[i][0] <= READ_BYTES:
            end = max(end, ranges[j][0] + ranges[j][1])
            j += 1
        f.seek(ranges[i][0])
        data = f.read(end - ranges[i][0])
        for offset, length in ranges[i:j]:
            yield data[offset - ranges[i][0] : offset - ranges[i][0] + length]
        i = j


def lines_at(index: DataFrame, wanted: DataFrame, path: str, *, region_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(row, line) of the rows of ``wanted`` (row): each once, those that the index has not left out.

    Wants of a region of a file are sorted and read by one task; only their bytes, and gaps too small to
    skip, are read."""
    found = index.join(wanted.select("row").where("row IS NOT NULL").distinct(), "row")
    region = F.floor(F.col("offset") / region_bytes)
    dealt = found.withColumn("_region", region).repartition("file", "_region").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(path)
        for batch in batches:
            rows, files = batch.column("row"), batch.column("file").to_pylist()
            ranges = list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
            start = 0
            while start < len(files):
                end = start
                while end < len(files) and files[end] == files[start] and sum(n for _, n in ranges[start:end]) < READ_BYTES and end - start < 1024:
                    end += 1
                with fs.open_input_file(files[start]) as f:
                    lines = [x.decode("utf-8", "replace") for x in read_ranges(f, ranges[start:end])]
                yield pa.RecordBatch.from_arrays([rows.slice(start, end - start), pa.array(lines, pa.string())], names=["row", "line"])
                start = end

    return dealt.select("row", "file", "offset", "length").mapInArrow(run, "row long, line string")
