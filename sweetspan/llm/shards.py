"""Sharding with size-tiered compaction (native).

A store is a folder of immutable Parquet shards and of versions.  A version is a
Parquet table of entries (path, bytes, rows, number of each shard) and a small
pointer to it, which also holds the schema.  ``append`` adds an arrival as small
shards; ``compact`` merges runs of shards of one size tier into files of about
the target size; both write the entries first and then commit the pointer by a
rename that fails if another writer took the number, so readers always see whole
versions.  A merge is a narrow job: each run of files is read by one task and
written as one file, without a shuffle.  Entries are made, merged and numbered as
tables; the driver sees those of at most ``ROUND_SHARDS`` shards in a round of
compaction, and the paths of a version that is read, as every scan does.

Defined results: rows are kept as they are, with nulls, repeats, texts of any
length and all columns, whatever their names.  The schema of a store has the
columns of all arrivals: rows of an arrival without a column have nulls there; an
arrival whose column has another type, or a name that differs in case alone, is
refused.  An empty arrival gives a version without new shards; a store without
rows reads as an empty table, one without a version raises ValueError.  A lost
executor's attempt leaves files that no version names, which ``vacuum`` deletes.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of a finished shard; shards of one tier within a factor FAN of each other; fewest shards worth a merge.
TARGET_BYTES, FAN = 128 << 20, 4
#: Rows in one shard of an arrival at most; merges in one job; shards looked at in a round; entries in a file.
ARRIVAL_ROWS, JOB_RUNS, ROUND_SHARDS, FILE_ENTRIES = 4096, 64, 100_000, 200_000
ENTRIES = "path string, bytes long, rows long, shard long"


def merged_schema(old: StructType | None, new: StructType) -> StructType:
    """The columns of both; ValueError where they clash."""
    fields = {f.name: StructField(f.name, f.dataType, True) for f in (old.fields if old else [])}
    folded = {n.lower(): n for n in fields}
    for f in new.fields:
        if folded.setdefault(f.name.lower(), f.name) != f.name:
            raise ValueError(f"columns {folded[f.name.lower()]} and {f.name} differ in case alone")
        if f.name in fields and fields[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, StructField(f.name, f.dataType, True))
    return StructType(list(fields.values()))


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan: int = FAN):
        self.spark, self.root, self.target, self.fan = spark, root.rstrip("/"), target_bytes, fan
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        """Path under the root of each file in ``folder``."""
        where, fs = self._path(folder), self._fs()
        return [f"{folder}/{x.getPath().getName()}" for x in fs.listStatus(where)] if fs.exists(where) else []

    def version(self) -> int:
        """Number of the newest version; 0: the store is empty."""
        return max((int(x.rpartition("v")[2]) for x in self._names("versions") if "/v" in x), default=0)

    def pointer(self, version: int | None = None) -> dict:
        """version, schema, entries (folder of the table) and shards (their number)."""
        n = self.version() if version is None else version
        if not n:
            return {"version": 0, "schema": None, "entries": None, "shards": 0}
        stream = self._fs().open(self._path(f"versions/v{n:08d}"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def entries(self, version: int | None = None) -> DataFrame:
        """(path, bytes, rows, shard) of a version."""
        found = self.pointer(version)
        if not found["entries"]:
            return self.spark.createDataFrame([], ENTRIES)
        return self.spark.read.schema(ENTRIES).parquet(f"{self.root}/{found['entries']}")

    def _numbered(self, entries: DataFrame, n: int) -> DataFrame:
        """Entries with their place in the order of paths: within ranges first, then over the ranges' counts."""
        ordered = entries.repartitionByRange(max(1, -(-n // FILE_ENTRIES)), "path").sortWithinPartitions("path")
        mask = (1 << 33) - 1  # below these bits an increasing id holds the place in its partition
        placed = ordered.select("path", "bytes", "rows", F.monotonically_increasing_id().alias("i"))
        placed = placed.select("path", "bytes", "rows", F.shiftright("i", 33).alias("p"), F.col("i").bitwiseAND(mask).alias("k"))
        before = F.coalesce(F.sum("c").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        firsts = placed.groupBy(F.col("p").alias("q")).agg(F.count(F.lit(1)).alias("c")).select("q", before.alias("first"))
        return placed.join(firsts, F.col("p") == F.col("q")).select("path", "bytes", "rows", (F.col("first") + F.col("k")).alias("shard"))

    def _commit(self, base: dict, schema: StructType, entries: DataFrame) -> int:
        """Writes the version after ``base``; fails if someone else did."""
        n, fs, folder = base["version"] + 1, self._fs(), f"entries/{uuid.uuid4().hex}"
        self._numbered(entries, base["shards"]).write.parquet(f"{self.root}/{folder}")
        count = self.spark.read.schema(ENTRIES).parquet(f"{self.root}/{folder}").count()
        text = json.dumps({"version": n, "schema": json.loads(schema.json()), "entries": folder, "shards": count})
        temp = self._path(f"versions/.{uuid.uuid4().hex}")
        out = fs.create(temp)
        out.write(bytearray(text.encode()))
        out.close()
        files = self._hadoop.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(fs.makeQualified(temp), fs.makeQualified(self._path(f"versions/v{n:08d}")), none)
        except Exception as error:
            fs.delete(temp, False)
            raise RuntimeError(f"version {n} was committed by another writer") from error
        return n

    def _write(self, df: DataFrame, **options) -> DataFrame:
        """Writes new shards; (path, bytes, rows) of those with rows, from the files themselves."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").options(**options).parquet(f"{self.root}/{folder}")
        read = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")
        path = F.concat(F.lit(f"{folder}/"), F.col("_metadata.file_name")).alias("path")
        return read.groupBy(path, F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))

    def append(self, df: DataFrame, rows_per_shard: int = ARRIVAL_ROWS) -> int:
        """Adds an arrival as small shards and commits a version."""
        base = self.pointer()
        schema = merged_schema(StructType.fromJson(base["schema"]) if base["schema"] else None, df.schema)
        new = self._write(df, maxRecordsPerFile=rows_per_shard)
        return self._commit(base, schema, self.entries(base["version"]).drop("shard").unionByName(new))

    def _tier(self, size: Column) -> Column:
        """Size class: 0 for full shards, then one more for each factor ``fan`` below the target."""
        half = max(1, self.target // 2)
        return F.when(size >= half, 0).otherwise(1 + F.floor(F.log(F.lit(half) / F.greatest(size, F.lit(1))) / math.log(self.fan))).cast("int")

    def runs(self, shards: list) -> list[list]:
        """Runs to merge, of rows (path, bytes, tier): neighbours by size within a tier, up to the target, from tiers with ``fan`` shards or more."""
        tiers: dict[int, list] = {}
        for x in shards:
            tiers.setdefault(x["tier"], []).append(x)
        out = []
        for level, own in sorted(tiers.items()):
            if level == 0 or len(own) < self.fan:
                continue
            run, size = [], 0
            for x in sorted(own, key=lambda x: (x["bytes"], x["path"])):
                if run and size + x["bytes"] > self.target:
                    out.append(run)
                    run, size = [], 0
                run.append(x)
                size += x["bytes"]
            out.append(run)
        return [run for run in out if len(run) > 1]

    def compact(self) -> int:
        """Merges until no tier has a run to merge; one version for each round."""
        while True:
            base = self.pointer()
            entries = self.entries(base["version"]).drop("shard")
            small = entries.withColumn("tier", self._tier(F.col("bytes"))).where("tier > 0")
            tiers = [r["tier"] for r in small.groupBy("tier").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= self.fan).collect()]  # a few tiers
            runs = self.runs(small.where(F.col("tier").isin(tiers)).orderBy("tier", "bytes", "path").limit(ROUND_SHARDS).collect()) if tiers else []
            if not runs:
                return base["version"]
            schema, new = StructType.fromJson(base["schema"]), []
            read = self.spark.read.schema(schema)
            for k in range(0, len(runs), JOB_RUNS):
                one = [read.parquet(*(f"{self.root}/{x['path']}" for x in run)).coalesce(1) for run in runs[k : k + JOB_RUNS]]
                new.append(self._write(reduce(DataFrame.unionAll, one)))
            gone = self.spark.createDataFrame([(x["path"],) for run in runs for x in run], "path string")  # of this round
            self._commit(base, schema, reduce(DataFrame.unionByName, new, entries.join(F.broadcast(gone), "path", "left_anti").select("path", "bytes", "rows")))

    def _paths(self, version: int | None = None) -> list[str]:
        return [r["path"] for r in self.entries(version).select("path").orderBy("path").collect()]

    def vacuum(self) -> None:
        """Deletes shards that the newest version doesn't name, and older versions."""
        now, fs = self.pointer(), self._fs()
        live = set(self._paths(now["version"]))
        for folder in self._names("data"):
            files = self._names(folder)
            if not live.intersection(files):
                fs.delete(self._path(folder), True)
                continue
            for x in files:
                if x.endswith(".parquet") and x not in live:
                    fs.delete(self._path(x), False)
        for x in self._names("entries"):
            if x != now["entries"]:
                fs.delete(self._path(x), True)
        for x in self._names("versions"):
            if x.rpartition("/")[2] < f"v{now['version']:08d}":
                fs.delete(self._path(x), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        found = self.pointer(version)
        if not found["version"]:
            raise ValueError("the store has no version yet")
        schema, paths = StructType.fromJson(found["schema"]), self._paths(found["version"])
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{x}" for x in paths)) if paths else self.spark.createDataFrame([], schema)

    def shard_table(self, version: int | None = None) -> DataFrame:
        """(file, shard, shard_rows, shard_bytes) of a version."""
        return self.entries(version).select(F.substring_index("path", "/", -1).alias("file"), "shard", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
