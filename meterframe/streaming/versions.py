"""A stored table of record versions, merged by identity without reading its history.

All versions of an identity lie in one day, its home: the local day of the version that stands. So a day's rollup needs its
own rows alone, and a correction that moves a record takes all its versions along. An index tells each identity's home.
It is cut by the leading bits of a hash of the identity into files of about ``INDEX_ROWS`` identities, which split as they
grow, so that a batch reads the index files and the days of its own identities, however long the history is.

A batch writes new folders and then one manifest, which names the folders of each day, of each day's rollup and of each index
file. A day that only gains identities gets one folder more; one that holds identities of the batch is written anew. A batch
of which every version is stored writes nothing: the index tells them by 64 bits beside those of the identity. A large batch is
merged in slices of its identities, one after another, so that the disk holds the shuffle of one slice at a time. Writing the manifest is the one step that makes the batch count: before it, readers see the table as it was; a batch
that is run again, before or after it, gives the same table. The manifest is as long as the table has
days and index files. Folders that no manifest names, left by a crash or by earlier batches, go by ``vacuum``.

Identities are told apart by 128 bits of two hashes. A batch is read several times; one that is dear to make should be
stored first. One writer at a time, as a stream has; of two at once
one fails at the manifest and changes nothing.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe.operators.merging import arbitrate
from meterframe.sources.stored import Manifests

INDEX_ROWS = 1 << 20
#: Rows whose shuffles lie on disk at once.
SLICE_ROWS = 1 << 25
#: Folders of a day, beside one for each slice, that are kept apart before they are put together.
SEGMENTS = 8
_NONE = "none"
_INDEX = T.StructType([*[T.StructField(c, T.LongType()) for c in ("h_", "g_", "v_")], T.StructField("home_", T.StringType())]).json()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go as it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _parts(folders: str | list[str]) -> list[str]:
    """The folders of a day; manifests of earlier releases have one each."""
    return [folders] if isinstance(folders, str) else folders


class Versions:
    """``order``: the columns that, beside the keys, make a version one of several; ``day``: the local day of a row, as text.

    ``rollup``, if given, makes rows from the standing versions of whole days; they are stored by ``rolled_day``, the same day
    as a column of theirs, in the same step.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], day: Column, rollup: Callable[[DataFrame], DataFrame] | None = None, rolled_day: str = "local_day"):
        self.table = Manifests(spark, path)
        self.spark, self.path, self.keys, self.order, self.rollup = spark, path.rstrip("/"), keys, order, rollup
        self.version = [*order, "source_revision", "lifecycle_rank", "content"]
        self.rolled_day = F.coalesce(F.col(rolled_day).cast("string"), F.lit(_NONE))
        self.day = F.coalesce(day.cast("string"), F.lit(_NONE))
        #: Folders that the last batch has read.
        self.read_folders: list[str] = []

    def manifest(self) -> dict:
        """What the table is made of now."""
        return self.table.latest() or {"number": -1, "days": {}, "rolled": {}, "index": {}, "depth": 0, "versions": 0, "schema": None, "rolled_schema": None}

    # -- reading

    def _folders(self, folders: list[str], schema: str | None) -> DataFrame | None:
        self.read_folders += folders
        return self._files(folders, schema)

    def _files(self, folders: list[str], schema: str | None) -> DataFrame | None:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def read(self, days: list[str] | None = None) -> DataFrame | None:
        """All versions, or those at home in some days; None before the first batch."""
        held = self.manifest()
        found = self._folders([f for d, parts in held["days"].items() if days is None or d in days for f in _parts(parts)], held["schema"])
        return None if found is None else found.drop("stands_", "home_")

    def current(self) -> DataFrame:
        """The version of each identity that stands."""
        return arbitrate(self.read(), self.keys, self.order)

    def rolled(self) -> DataFrame | None:
        held = self.manifest()
        return self._folders(list(held["rolled"].values()), held["rolled_schema"])

    # -- merging

    def _hashed(self, rows: DataFrame) -> DataFrame:
        """Rows with the two hashes of their identity, and one of their version, in which a null is a value like any other."""
        parts, told = ([x for k in columns for x in (F.col(k), F.col(k).isNull())] for columns in (self.keys, self.version))
        return rows.withColumns({"h_": F.xxhash64(*parts), "g_": F.xxhash64(F.lit(1), *parts), "v_": F.xxhash64(*told)})

    def _standing(self, rows: DataFrame) -> DataFrame:
        """Distinct rows with ``stands_`` and ``home_``, the day of their identity's standing version."""
        # all below is by identity, whose rows are brought together once
        placed = rows.repartition("h_", "g_").dropDuplicates(["h_", "g_", *self.keys, *self.version])
        now = arbitrate(placed, ["h_", "g_"], self.order).select("h_", "g_", F.struct(*self.version).alias("now_"))
        met = F.lit(True)
        for c in self.version:
            met &= F.col(c).eqNullSafe(F.col(f"now_.{c}"))
        marked = placed.join(now, ["h_", "g_"]).select(*rows.columns, met.alias("stands_"))
        return marked.withColumn("home_", F.min(F.when(F.col("stands_"), self.day)).over(Window.partitionBy("h_", "g_")))

    def merge(self, batch: DataFrame) -> list[str]:
        """Adds a batch's versions; the days that have been written anew. A batch that comes again leaves the table as it is."""
        held = self.manifest()
        self.read_folders = []
        with shuffles_removed(self.spark):
            return self._merge(self._hashed(batch), held, held["number"] + 1)

    def _homes(self, fresh: DataFrame, index: DataFrame) -> tuple[list[str], bool]:
        """(the days that identities of the batch are at home in, whether one of its versions is not stored), by the hashes alone."""
        ours = fresh.select("h_", "g_", "v_", F.lit(None).cast("string").alias("home_"), F.lit(True).alias("met_"))
        every = ours.unionByName(index.withColumn("met_", F.lit(False))).repartition("h_", "g_")
        versions = every.groupBy("h_", "g_", "v_").agg(F.max("home_").alias("home_"), F.bool_or("met_").alias("met_"))
        ids = versions.groupBy("h_", "g_").agg(F.max("home_").alias("at"), F.bool_or("met_").alias("met"), F.bool_or(F.col("met_") & F.col("home_").isNull()).alias("new"))
        told = ids.where("met").groupBy("at").agg(F.bool_or("new").alias("new")).collect()  # a row a day
        return sorted(r["at"] for r in told if r["at"] is not None), any(r["new"] for r in told)

    def _merge(self, fresh: DataFrame, held: dict, number: int) -> list[str]:
        folder = f"data/{number}-{uuid.uuid4().hex[:8]}"
        bits = [r[0] for r in fresh.select(self._bits(held["depth"])).distinct().collect()]  # no more than there are index files
        touched = self._index_files(bits, held)
        index = self._folders([held["index"][f] for f in touched], _INDEX)
        homes, new = self._homes(fresh, index) if index is not None else ([], bool(bits))
        if not new:
            return []
        before = self._folders([f for d in homes for f in _parts(held["days"][d])], held["schema"])
        every, known = fresh, 0
        if before is not None:
            known = before.count()
            every = fresh.unionByName(self._hashed(before.drop("stands_", "home_")), allowMissingColumns=True)
        slices = max(1, math.ceil((fresh.count() + known) / SLICE_ROWS))
        made: dict[str, list[str]] = {}
        for k in range(slices):
            rows = self._standing(every.where(F.pmod("g_", F.lit(slices)) == k) if slices > 1 else every).drop("h_", "g_", "v_")
            rows.withColumn("day_", F.col("home_")).hint("rebalance", "day_").write.option("compression", "zstd").partitionBy("day_").parquet(f"{self.path}/{folder}/days/{k}")
            for d, f in self._written(f"{folder}/days/{k}", "day_").items():
                made.setdefault(d, []).append(f)
        days, schema = sorted({*homes, *made}), rows.schema.json()
        now = self._files([f for parts in made.values() for f in parts], schema)
        manifest = {**held, "number": number, "schema": schema, "versions": held.get("versions", held.get("identities", 0)) + now.count() - known}
        manifest |= self._indexed(now, index, touched, bits, homes, manifest, folder)
        also = {d: _parts(f) for d, f in held["days"].items() if d not in homes}
        manifest["days"] = also | {d: also.get(d, []) + made.get(d, []) for d in days if d in made}
        if many := [d for d in days if len(manifest["days"].get(d, [])) > SEGMENTS + slices]:
            rows = self._folders([f for d in many for f in manifest["days"][d]], schema)
            rows.withColumn("day_", F.col("home_")).hint("rebalance", "day_").write.option("compression", "zstd").partitionBy("day_").parquet(f"{self.path}/{folder}/days/joined")
            manifest["days"] |= {d: [f] for d, f in self._written(f"{folder}/days/joined", "day_").items()}
        if self.rollup is not None:
            manifest |= self._rolled(manifest, days, held, folder)
        self.table.switch(manifest)
        return days

    def _written(self, folder: str, column: str) -> dict[str, str]:
        """value -> folder of what ``partitionBy`` has written."""
        system, place = self.table.place(folder)
        unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        names = [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []
        return {unescape(n.split("=", 1)[1]): f"{folder}/{n}" for n in names if n.startswith(f"{column}=")}

    # -- the index: "depth/leading bits" -> folder

    def _bits(self, depth: int) -> Column:
        return F.shiftrightunsigned("h_", 64 - depth).cast("long") if depth else F.lit(0).cast("long")

    def _index_files(self, bits: list[int], held: dict) -> list[str]:
        """The index files that may hold the identities; one of fewer bits stands for all that begin with them."""
        names = ((f"{d}/{b >> (held['depth'] - d)}" for d in range(held["depth"], -1, -1)) for b in bits)
        return sorted({name for each in names if (name := next((n for n in each if n in held["index"]), None))})

    def _indexed(self, now: DataFrame, index: DataFrame | None, touched: list[str], bits: list[int], homes: list[str], manifest: dict, folder: str) -> dict:
        """The touched index files, written anew: what they hold of other days, and what there is in the days that have been written."""
        depth = max(manifest["depth"], math.ceil(math.log2(max(1, manifest["versions"] / INDEX_ROWS))))
        theirs = self._bits(manifest["depth"]).isin(bits)
        for d, some in groupby(sorted((int(d), int(b)) for d, b in (f.split("/") for f in touched)), key=lambda x: x[0]):
            theirs |= self._bits(d).isin([b for _, b in some])
        rows = self._hashed(now).where(theirs).select("h_", "g_", "v_", "home_")
        if index is not None:
            rows = rows.unionByName(index.where(~F.col("home_").isin(homes)))
        rows.withColumn("bits_", self._bits(depth)).repartition("bits_").write.partitionBy("bits_").parquet(f"{self.path}/{folder}/index")
        kept = {name: place for name, place in manifest["index"].items() if name not in touched}
        return {"depth": depth, "index": kept | {f"{depth}/{bits}": place for bits, place in self._written(f"{folder}/index", "bits_").items()}}

    def _rolled(self, manifest: dict, days: list[str], held: dict, folder: str) -> dict:
        now = self._folders([f for d in days for f in manifest["days"].get(d, [])], manifest["schema"])
        rolled = self.rollup(now.where("stands_").drop("stands_", "home_")).withColumn("day_", self.rolled_day)
        rolled.write.partitionBy("day_").parquet(f"{self.path}/{folder}/rolled")
        kept = {d: f for d, f in held["rolled"].items() if d not in days}
        return {"rolled": kept | self._written(f"{folder}/rolled", "day_"), "rolled_schema": rolled.drop("day_").schema.json()}

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes what the last ``keep`` manifests do not name; for when no batch runs."""
        return self.table.vacuum(lambda held: {f.split("/")[1] for part in ("days", "rolled", "index") for each in held[part].values() for f in _parts(each)}, keep)
