"""Complete lines of log files with their place, read once and as the files grow.

``spark.read.format("whole_lines")`` and ``spark.readStream.format("whole_lines")`` read all files under a path. A stream's
offset is a map of file to length. A line belongs to the batch, and to the split, in which its line feed lies, so a line
that is not ended yet is left for the batch that brings its end, every line is read once, and a batch that is run again
gives the same rows. A split that begins inside a line looks back for the line's start. A file that has become shorter, or
begins otherwise than before, has been replaced and is read from its start.

Rows are (file, fresh, split, turn, offset, size, value): the split's first byte, the line's number in it from 0, the line's
first byte in the file and its length without the line end. A byte order mark and a carriage return before the line
feed do not belong to a line. ``value`` is null for a line of more than ``most`` bytes, which is never held. Empty lines are
rows, as they count; ``numbered`` adds the line number and ``readable`` sets apart what no text can be read of.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LINE_LIMIT = 8 << 20
SPLIT = 64 << 20
CHUNK = 1 << 20
HEAD = 64
BATCH_BYTES = 4 << 20
SCHEMA = "file string, fresh boolean, split long, turn long, offset long, size long, value binary"
_BOM = b"\xef\xbb\xbf"


@dataclass
class Split:
    file: str
    fresh: bool
    low: int
    high: int


@dataclass
class Splits(InputPartition):
    """What one task reads: a split, or small files together."""

    held: list[Split]


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _files(path: str, only: str) -> dict[str, int]:
    """The length of each file under the path whose whole name ``only`` is found in; names that begin with a dot or an underscore are not data."""
    from pyarrow import fs

    system, place = _opened(path)
    info = system.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    return {prefix + f.path: f.size for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and re.search(only, f.path)}


def _splits(file: str, fresh: bool, low: int, high: int, size: int) -> list[Split]:
    return [Split(file, fresh, at, min(at + size, high)) for at in range(low, high, size)]


def _tasks(splits: list[Split], size: int) -> list[Splits]:
    """Splits put together to about ``size`` bytes a task; opening a file counts as a sixteenth of them."""
    out: list[Splits] = []
    room = 0
    for split in splits:
        cost = split.high - split.low + size // 16
        if not out or cost > room:
            out.append(Splits([]))
            room = size
        out[-1].held.append(split)
        room -= cost
    return out or [Splits([])]


def _line_start(source, low: int) -> int:
    """The first byte of the line that the byte before ``low`` belongs to, or ``low`` if that byte is a line feed."""
    at = low
    while at > 0:
        size = min(CHUNK, at)
        source.seek(at - size)
        found = source.read(size).rfind(b"\n")
        if found >= 0:
            return at - size + found + 1
        at -= size
    return 0


def _lines(split: Split, most: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(first byte, length, text) of the lines whose line feed lies in the split; of a line too long there is no text."""
    system, place = _opened(split.file)
    with system.open_input_file(place) as source:
        start = _line_start(source, split.low)
        if start == 0:
            source.seek(0)
            start = len(_BOM) if source.read(3) == _BOM else 0
        held, length, at = bytearray(), 0, start
        source.seek(at)
        while at < split.high and (chunk := source.read(min(CHUNK, split.high - at))):
            begin = 0
            while (end := chunk.find(b"\n", begin)) >= 0:
                length += end - begin
                text = (bytes(held) + chunk[begin:end]).removesuffix(b"\r") if length <= most + 1 else None
                length = length if text is None else len(text)
                yield start, length, text if length <= most else None
                start, length, begin = at + end + 1, 0, end + 1
                held.clear()
            length += len(chunk) - begin
            if length <= most + 1:
                held += chunk[begin:]
            else:
                held.clear()
            at += len(chunk)


def _read(split: Split, most: int):
    import pyarrow as pa

    schema = pa.schema([("file", pa.string()), ("fresh", pa.bool_()), ("split", pa.int64()), ("turn", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("value", pa.binary())])

    def batch(first: int, rows: list[tuple]):
        n = len(rows)
        offsets, sizes, values = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"file": [split.file] * n, "fresh": [split.fresh] * n, "split": [split.low] * n, "turn": range(first, first + n), "offset": offsets, "size": sizes, "value": values}, schema=schema)

    first, held, size = 0, [], 0
    for row in _lines(split, most):
        held.append(row)
        size += 64 + (row[1] if row[2] is not None else 0)
        if size > BATCH_BYTES:
            yield batch(first, held)
            first, held, size = first + len(held), [], 0
    if held:
        yield batch(first, held)


def _whole(split: Split, text: bool):
    """A file as one row; without its text it is not opened."""
    value = None
    if text:
        system, place = _opened(split.file)
        with system.open_input_file(place) as source:
            value = source.read()
    yield split.file, True, 0, 0, 0, split.high, value


class _Options:
    def __init__(self, options: dict[str, str]):
        self.path, self.only, self.unit = options["path"], options.get("files", ""), options.get("unit", "line")
        self.most = int(options.get("most", LINE_LIMIT))
        self.split = int(options.get("split", SPLIT))

    def read(self, partition: Splits):
        for split in partition.held:
            yield from _read(split, self.most) if self.unit == "line" else _whole(split, self.unit == "file")


class _Reader(_Options, DataSourceReader):
    def partitions(self) -> list[Splits]:
        files = sorted(_files(self.path, self.only).items())
        return _tasks([s for file, size in files for s in (_splits(file, True, 0, size, self.split) if self.unit == "line" else [Split(file, True, 0, size)])], self.split)


class _StreamReader(_Options, DataSourceStreamReader):
    """Offsets: file -> [length, its first bytes in base 64]."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.seen: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        now = {}
        for file, size in _files(self.path, self.only).items():
            known = self.seen.get(file)
            if known is None or known[0] != size:
                system, place = _opened(file)
                with system.open_input_file(place) as source:
                    known = [size, base64.b64encode(source.read(min(HEAD, size))).decode()]
            now[file] = known
        self.seen = now
        return {"files": now}

    def partitions(self, start: dict, end: dict) -> list[Splits]:
        out: list[Split] = []
        for file, (size, head) in sorted(end["files"].items()):
            before, old = start["files"].get(file, [0, ""])
            old = base64.b64decode(old)
            replaced = size < before or not base64.b64decode(head).startswith(old[:size])
            low = 0 if replaced else before
            out += _splits(file, low == 0, low, size, self.split)
        return _tasks(out, self.split)

    def commit(self, end: dict) -> None:
        pass


class WholeLines(DataSource):
    """Options: ``path``, ``files`` (a pattern of their names), ``most`` (bytes of a line), ``split`` (bytes of a task) and, for reading
    once, ``unit``: line, file (a row for each file, with all its text) or name (without). Folders whose names begin with a dot are read."""

    @classmethod
    def name(cls) -> str:
        return "whole_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(WholeLines)
    return spark


def _starts(lines: DataFrame) -> DataFrame:
    """(file, fresh, split, lines, before): how many lines each split has, and how many the file's splits before it have."""
    each = lines.groupBy("file", "fresh", "split").agg(F.count("*").alias("lines"))
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("before", F.coalesce(F.sum("lines").over(order), F.lit(0)))


def numbered(lines: DataFrame, read_before: DataFrame | None = None) -> DataFrame:
    """``lines`` with ``line``, the number from 1 that a line has in its file.

    Lines are counted by split and the counts added up over a file's splits: one row for each 64 MB is shuffled, and the
    lines themselves stay where they are if that table is small. ``read_before``: (file, total) of lines read earlier.
    """
    starts = _starts(lines).select(F.col("file").alias("f_"), F.col("split").alias("s_"), F.col("fresh").alias("r_"), "before")
    if read_before is not None:
        known = read_before.select(F.col("file").alias("f_"), "total")
        starts = starts.join(known, "f_", "left").withColumn("before", F.col("before") + F.when(~F.col("r_"), F.coalesce("total", F.lit(0))).otherwise(0))
    joined = lines.join(starts.select("f_", "s_", "before"), (F.col("file") == F.col("f_")) & (F.col("split") == F.col("s_")))
    return joined.select(*lines.columns, (F.col("before") + F.col("turn") + 1).alias("line"))


def totals(lines: DataFrame, read_before: DataFrame | None = None) -> DataFrame:
    """(file, total): how many lines each file of the batch has after it."""
    here = lines.groupBy("file").agg(F.count("*").alias("total"), F.bool_and("fresh").alias("fresh"))
    if read_before is None:
        return here.select("file", "total")
    known = read_before.select("file", F.col("total").alias("old"))
    return here.join(known, "file", "left").select("file", (F.col("total") + F.when(~F.col("fresh"), F.coalesce("old", F.lit(0))).otherwise(0)).alias("total"))


def readable(lines: DataFrame) -> DataFrame:
    """Lines that are not empty, with ``value`` as text and ``fault``: line_too_long, invalid_utf8_line, or null."""
    text = F.col("value").cast("string")
    fault = F.when(F.col("value").isNull(), "line_too_long").when(~F.is_valid_utf8(text), "invalid_utf8_line")
    return lines.where("size > 0").withColumn("fault", fault).withColumn("value", F.when(F.col("fault").isNull(), text))
