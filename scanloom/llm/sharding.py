"""Size-tiered compaction of a sharded table with versioned manifests, in DataFrame functions only.

A store is a folder with runs of Parquet files (shards), which never change, and a manifest for each version: a
table of the shards that are live in it (run, name, rows, bytes). Appending writes a run of small shards.
Compaction takes the shards of a tier (sizes within a factor of `fan_in`), packs them in order of size
into bins of `target_bytes`, and writes each bin as one file, without a shuffle. A version is
committed by renaming its finished manifest to its number, which fails if that number exists: readers see a version
whole or not at all, and a writer that comes second adds its run to the version that it finds then, a few times at
most. The store must have atomic exclusive renames of folders (HDFS and local disks do; plain object stores don't).
Old versions stay readable until `vacuum`, which leaves alone whatever is younger than its grace period: a run that
a writer has yet to commit is not lost.

What the driver holds of a store are names of files, as Spark's own listing of any table does: a row for 128 MB once
shards are merged. Packing shards into bins goes by groups of at most about GROUP_SHARDS of a tier.

All columns are kept as they are, of any type and with nulls; repeated rows stay. An empty table gives a version with a
shard of no rows or none.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, table
from .repair import CRC, CRC_TABLE

MANIFEST = "run string, name string, rows bigint, bytes bigint"
#: Rows of an arriving shard at most, bytes of a full one, shards of a tier that are worth a merge, the smallest tier's bytes.
SHARD_ROWS, TARGET_BYTES, FAN_IN, LEAST_BYTES = 4000, 128 << 20, 4, 1 << 20
#: Bins that one job writes.
BINS_A_JOB = 512
#: Shards of a tier that are packed into bins together, about.
GROUP_SHARDS = 50_000
#: Seconds for which files outside of all versions stay, as a writer may yet commit them; turns that a losing writer takes.
GRACE_S, ATTEMPTS = 86_400, 5


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def versions(self) -> list[int]:
        folder = self.path(f"{self.root}/manifest")
        if not self.fs.exists(folder):
            return []
        return sorted(int(n[1:]) for x in self.fs.listStatus(folder) if (n := x.getPath().getName())[:1] == "v" and n[1:].isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{known[-1] if version is None else version:08d}")

    def commit(self, live: DataFrame, base: int) -> int:
        """Publishes live as version base + 1. Raises if another writer has published it."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        made = f"{self.root}/manifest/_{uuid.uuid4().hex}"
        live.coalesce(1).write.parquet(made)
        source, goal = self.path(made), self.path(f"{self.root}/manifest/v{base + 1:08d}")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(source, goal, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return base + 1

    # data

    def _listed(self, run: str, schema) -> DataFrame:
        """Manifest rows of a run, measured from its files."""
        folder = f"{self.root}/runs/{run}"
        sizes = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))
        rows = self.spark.read.schema(schema).parquet(folder).select(F.col("_metadata.file_name").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
        return sizes.join(rows, "name", "left").select(F.lit(run).alias("run"), "name", F.coalesce("rows", F.lit(0)).alias("rows"), "bytes")

    def _files(self, shards: list) -> list[str]:
        return [f"{self.root}/runs/{s['run']}/{s['name']}" for s in shards]

    def append(self, rows: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
        run = f"a-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", shard_rows).parquet(f"{self.root}/runs/{run}")
        return self.add(self._listed(run, rows.schema))

    def add(self, listed: DataFrame) -> int:
        """Commits shards on top of the last version; after another writer's commit, on top of that."""
        for turn in range(ATTEMPTS):
            base = (self.versions() or [0])[-1]
            try:
                return self.commit(self.manifest(base or None).unionByName(listed), base)
            except Py4JJavaError as lost:
                if turn == ATTEMPTS - 1 or "FileAlreadyExists" not in str(lost.java_exception):
                    raise

    def compact(self, schema, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, least_bytes: int = LEAST_BYTES, bins_a_job: int = BINS_A_JOB, group_shards: int = GROUP_SHARDS) -> int | None:
        """One round: merges every tier with at least fan_in shards below half the target. The new version, or None if no tier has.

        After another writer's commit the merged files take the place of their shards in that version, if all of these are still live in it, as they are after arrivals;
        if another compaction has merged some of them, the round is planned anew and the files stay unused until vacuum.
        """
        known = self.versions()
        if not known:
            return None
        live = self.manifest(known[-1])
        tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(least_bytes)) / least_bytes) / F.log(F.lit(float(fan_in))))
        small = live.where(F.col("bytes") < target_bytes / 2).withColumn("tier", tier)
        full = small.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fan_in)
        small = small.join(full, "tier").withColumn("part", F.pmod(F.xxhash64("run", "name"), F.ceil(F.col("n") / group_shards)))
        order = W.partitionBy("tier", "part").orderBy("bytes", "run", "name")
        bins = small.withColumn("bin", F.floor((F.sum("bytes").over(order) - F.col("bytes")) / target_bytes))
        groups = bins.groupBy("tier", "part", "bin").agg(F.collect_list(F.struct("run", "name")).alias("shards")).where(F.size("shards") > 1).orderBy("tier", "part", "bin").collect()
        if not groups:
            return None
        made, gone = [], []
        for at in range(0, len(groups), bins_a_job):
            run, some = f"c-{uuid.uuid4().hex}", groups[at : at + bins_a_job]
            out = None
            for g in some:
                one = self.spark.read.schema(schema).parquet(*self._files(g["shards"])).coalesce(1)
                out = one if out is None else out.unionAll(one)
                gone += [(s["run"], s["name"]) for s in g["shards"]]
            self._write_each(out, f"{self.root}/runs/{run}")
            made.append(self._listed(run, schema))
        merged = self.spark.createDataFrame(gone, "run string, name string")
        base = known[-1]
        for turn in range(ATTEMPTS):
            kept = live.join(merged, ["run", "name"], "left_anti").select("run", "name", "rows", "bytes")
            for x in made:
                kept = kept.unionByName(x)
            try:
                return self.commit(kept, base)
            except Py4JJavaError as lost:
                if turn == ATTEMPTS - 1 or "FileAlreadyExists" not in str(lost.java_exception):
                    raise
            base = self.versions()[-1]
            live = self.manifest(base)
            if merged.join(live, ["run", "name"], "left_anti").limit(1).count():
                return self.compact(schema, target_bytes, fan_in, least_bytes, bins_a_job, group_shards)

    def _write_each(self, bins: DataFrame, path: str) -> None:
        """Writes a union of single partitions with a file for each; since 4.1 Spark would put them into one partition unless told otherwise."""
        conf, name = self.spark.conf, "spark.sql.unionOutputPartitioning"
        before = conf.get(name, "true")
        conf.set(name, "false")
        try:
            bins.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(name, before)

    def read(self, schema, version: int | None = None) -> DataFrame:
        files = self._files(self.manifest(version).where("rows > 0").select("run", "name").collect())
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1, grace_s: float = GRACE_S) -> int:
        """Deletes the versions but the last `keep`, the shards that none of the others holds, and manifests of failed commits, all only if they are older than the grace period. Files deleted."""
        old = time.time() * 1000 - grace_s * 1000
        known = self.versions()
        kept = set(known[-keep:])
        for x in self.fs.listStatus(self.path(f"{self.root}/manifest")):
            name = x.getPath().getName()
            if x.getModificationTime() < old and not (name[:1] == "v" and int(name[1:]) in kept):
                self.fs.delete(x.getPath(), True)
        # what is still readable keeps its shards, young versions too
        live = {(r["run"], r["name"]) for v in self.versions() for r in self.manifest(v).select("run", "name").toLocalIterator()}
        gone = 0
        for run in self.fs.listStatus(self.path(f"{self.root}/runs")):
            for x in self.fs.listStatus(run.getPath()):
                name = x.getPath().getName()
                if name.endswith(".parquet") and x.getModificationTime() < old and (run.getPath().getName(), name) not in live:
                    gone += bool(self.fs.delete(x.getPath(), False))
        return gone


#: Rows of a shard in the query: so few that even small tables make several.
QUERY_SHARD_ROWS = 250


#: The arrivals' shares of the documents, of 32.
ARRIVALS = (1, 1, 2, 4, 8, 16)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """Documents through a store: six arrivals of unequal size, with a compaction after the third and as many as are due at the end; then read back.

    version 0: a row for each document of the last version, with whether its shard is in the manifest with as many rows as its file, and whether a merge wrote it. version 1 to 6: a row for
    each document in the shards that this arrival brought, read from the version that it made, though compactions have merged them since.
    """
    docs = table(spark, sf_dir, "documents")
    store = Store(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    turn = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(32))
    first, came = 0, []
    for i, share in enumerate(ARRIVALS):
        before = store.manifest()
        version = store.append(docs.where(turn.between(first, first + share - 1)), QUERY_SHARD_ROWS)
        came.append((store.manifest(version).join(before, ["run", "name"], "left_anti"), i + 1))
        first += share
        if i == 2:
            store.compact(docs.schema)
    while store.compact(docs.schema) is not None:
        pass
    sha = F.sha2("text", 256).alias("text_sha256")
    rows = store.read(docs.schema).select("doc_id", sha, F.col("_metadata.file_name").alias("name"))
    counted = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    sound = store.manifest().join(counted, "name").select("name", (F.col("rows") == F.col("n")).alias("shard_sound"), F.startswith("run", F.lit("c-")).alias("shard_merged"))
    out = rows.join(sound, "name", "left").select(F.lit(0).alias("version"), "doc_id", "text_sha256", F.coalesce("shard_sound", F.lit(False)).alias("shard_sound"), F.coalesce("shard_merged", F.lit(False)).alias("shard_merged"))
    for shards, i in came:
        files = store._files(shards.where("rows > 0").collect())
        if files:
            held = spark.read.schema(docs.schema).parquet(*files)
            out = out.unionByName(held.select(F.lit(i).alias("version"), "doc_id", sha, F.lit(True).alias("shard_sound"), F.lit(False).alias("shard_merged")))
    return out


#: With a hundred documents or more there are at least FAN_IN arrivals, so that all shards are merged in the end.
OP1_SQL = f"""
with {CRC_TABLE},
t as (select doc_id, sha256(text) as text_sha256, {CRC.format("coalesce(cast(doc_id as varchar), '')")} % 32 as turn from documents, crc)
select 0 as version, doc_id, text_sha256, true as shard_sound, (select count(*) from documents) > 100 as shard_merged from t
union all
select case when turn < 1 then 1 when turn < 2 then 2 when turn < 4 then 3 when turn < 8 then 4 when turn < 16 then 5 else 6 end, doc_id, text_sha256, true, false from t
"""
