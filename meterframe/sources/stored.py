"""Tables that are worked out once and read again, kept in the shared folder and kept up with their inputs by days."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The tables that usage events are bound to.
INPUTS = ("lineitem", "orders", "part", "supplier", "nation")
#: Those whose new files touch the days of their own rows alone.
FACTS = ("lineitem", "orders")
_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of this machine, which must then be the only one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="meterframe-stored-")
    return _local[context.applicationId]


class Manifests:
    """Numbered JSON files in a folder, of which the highest is what a table is made of. Writing one is one step."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def place(self, name: str):
        """(file system, path) of a name under the table's folder."""
        context = self.spark.sparkContext
        found = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return found.getFileSystem(context._jsc.hadoopConfiguration()), found

    def numbers(self) -> list[int]:
        system, folder = self.place("manifest")
        names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read(self, number: int) -> dict:
        system, file = self.place(f"manifest/{number}.json")
        stream = system.open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def latest(self) -> dict | None:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def switch(self, manifest: dict) -> None:
        """Makes ``manifest`` the latest; a file that is whole gets its name, unless another writer has given it already."""
        system, half = self.place(f"manifest/.{uuid.uuid4().hex}")
        stream = system.create(half)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        _, whole = self.place(f"manifest/{manifest['number']}.json")
        if system.exists(whole) or not system.rename(half, whole):
            system.delete(half, False)
            raise FileExistsError(f"another writer has stored manifest {manifest['number']}")

    def vacuum(self, named: Callable[[dict], set[str]], keep: int = 2) -> list[str]:
        """Removes the folders under ``data`` that none of the last ``keep`` manifests names, and the manifests before these."""
        numbers = self.numbers()
        live = set().union(*[named(self.read(n)) for n in numbers[-keep:]]) if numbers else set()
        system, data = self.place("data")
        gone = [f.getPath() for f in system.listStatus(data) if f.getPath().getName() not in live] if system.exists(data) else []
        for path in gone:
            system.delete(path, True)
        for n in numbers[:-keep]:
            system.delete(self.place(f"manifest/{n}.json")[1], False)
        return [p.getName() for p in gone]


def listed(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> dict[str, dict[str, str]]:
    """table -> file -> its length and time of change, of the files in all folders below a table's."""
    context = spark.sparkContext
    out: dict[str, dict[str, str]] = {}
    for name in tables:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files, found = path.getFileSystem(context._jsc.hadoopConfiguration()).listFiles(path, True), {}
        while files.hasNext():
            f = files.next()
            if f.getPath().getName()[0] not in "._":
                found[f.getPath().toString()] = f"{f.getLen()} {f.getModificationTime()}"
        out[name] = found
    return out


def state(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = INPUTS) -> str:
    """A name for what the input files are now."""
    return hashlib.sha256(json.dumps(listed(spark, sf_dir, tables), sort_keys=True).encode()).hexdigest()[:24]


@cache
def version() -> str:
    """A name for the code that makes stored tables: another release, zone or rule does not read what an older one has made."""
    seen = hashlib.sha256()
    for part in ("functions", "operators", "sources"):
        for file in sorted(resources.files("meterframe").joinpath(part).iterdir(), key=lambda f: f.name):
            if file.name.endswith(".py"):
                seen.update(file.read_bytes())
    return seen.hexdigest()[:12]


#: Of a stored file's row groups, which lie in the order of days.
GROUP_BYTES = 8 << 20
#: Changes that are kept apart before they are put together with the rest.
SEGMENTS = 8


def stored(spark: SparkSession, sf_dir: str, name: str, day: str, make: Callable[[str | None, str | None], DataFrame], touched: Callable[[dict[str, list[str]]], list[str]]) -> DataFrame:
    """The table ``name`` over an input folder, kept up with its inputs by days.

    ``make`` gives its rows, of all days or of those from a first to a last one. The rows of each file lie in the order of
    ``day``, in small row groups, so that a filter on it skips most of these without a shuffle to bring them together. Where inputs have only got new files in ``FACTS``, the days that ``touched``
    finds in these are made anew, beside the rest; any other change makes the whole anew. A manifest names what the table is
    made of, for these inputs, and is written when all of it is there: readers see it before or after, and of two jobs
    at once one takes what the other has made.
    """
    table = _named(spark, sf_dir, name)
    now = listed(spark, sf_dir, INPUTS)
    held = table.latest()
    if held is None or held["inputs"] != now:
        number = held["number"] + 1 if held else 0
        segments = _kept_up(table, held, now, day, make, touched, number)
        schema = spark.read.parquet(*[f"{table.path}/{s['folder']}" for s in segments]).schema.json()
        held = {"number": number, "inputs": now, "segments": segments, "schema": schema}
        try:
            table.switch(held)
        except FileExistsError:
            return stored(spark, sf_dir, name, day, make, touched)
        table.vacuum(lambda m: {s["folder"].split("/")[1] for s in m["segments"]})
    return _joined(table, held, day)


def current(spark: SparkSession, sf_dir: str, name: str, day: str) -> DataFrame | None:
    """The table ``name`` if one is stored for what the inputs are now; none is made for a single question."""
    table = _named(spark, sf_dir, name)
    held = table.latest()
    return _joined(table, held, day) if held is not None and held["inputs"] == listed(spark, sf_dir, INPUTS) else None


def _named(spark: SparkSession, sf_dir: str, name: str) -> Manifests:
    place = hashlib.sha256(f"{sf_dir} {version()}".encode()).hexdigest()[:24]
    return Manifests(spark, f"{folder(spark)}/meterframe-stored/{name}-{place}")


def _joined(table: Manifests, held: dict, day: str) -> DataFrame:
    """The rows of all segments; a later one stands for the days that it names."""
    schema = T.StructType.fromJson(json.loads(held["schema"]))
    out, later = None, []
    for segment in reversed(held["segments"]):
        rows = table.spark.read.schema(schema).parquet(f"{table.path}/{segment['folder']}")
        rows = rows.where(~F.coalesce(F.col(day).cast("string").isin(later), F.lit(False))) if later else rows
        out = rows if out is None else out.unionByName(rows)
        later = later + (segment["days"] or [])
    return out


def _kept_up(table: Manifests, held: dict | None, now: dict, day: str, make: Callable, touched: Callable, number: int) -> list[dict]:
    def write(rows: DataFrame) -> str:
        place = f"data/{number}-{uuid.uuid4().hex[:8]}"
        rows.sortWithinPartitions(day).write.option("parquet.block.size", GROUP_BYTES).parquet(f"{table.path}/{place}")
        return place

    added = _added(held["inputs"], now) if held else None
    if added is None:
        return [{"folder": write(make(None, None)), "days": None}]
    days = sorted(touched(added))
    if not days:
        return held["segments"]
    fresh = make(days[0], days[-1]).where(F.col(day).cast("string").isin(days))
    segments = [*held["segments"], {"folder": write(fresh), "days": days}]
    if len(segments) > SEGMENTS:
        return [{"folder": write(_joined(table, {**held, "segments": segments}, day)), "days": None}]
    return segments


def _added(before: dict, now: dict) -> dict[str, list[str]] | None:
    """New files by table, if nothing else has changed and only tables of facts have new ones."""
    for name, files in before.items():
        if any(now.get(name, {}).get(f) != seen for f, seen in files.items()):
            return None
    added = {name: [f for f in files if f not in before.get(name, {})] for name, files in now.items()}
    added = {name: files for name, files in added.items() if files}
    return added if set(added) <= set(FACTS) else None


def logs(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], rows: DataFrame, file: str, order: list[str]) -> str:
    """A folder with one log of text lines for each value of ``file``, its lines in ``order``, written once for these inputs."""
    place = f"{folder(spark)}/meterframe-stored/{name}-logs-{state(spark, sf_dir, tables)}"
    if not _done(spark, place):
        rows.repartition(file).sortWithinPartitions(file, *order).select(file, "value").write.mode("overwrite").partitionBy(file).text(place)
    return place


def _done(spark: SparkSession, place: str) -> bool:
    context = spark.sparkContext
    mark = context._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    return mark.getFileSystem(context._jsc.hadoopConfiguration()).exists(mark)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder that the cluster shares, or in a new one where none is set."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="meterframe-checkpoint-"))
    return df.checkpoint(eager=True)
