"""Versioned storage of a graph: a base, an append-only delta log, and projections for pruned lookups."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import expr as X
from ..operators import incremental, integrity
from ..operators.tables import GraphTables, best_facts, last_nodes

TABLES = {"files": schema.FILES, "nodes": schema.NODES, "edges": schema.EDGES, "diagnostics": schema.DIAGNOSTICS}
KEY = {"files": "file_id", "nodes": "file_part", "edges": "file_part", "diagnostics": "file_part"}


class GraphStore:
    """A folder with versions of the base, a pointer to the current one, and deltas on top of it.

    Readers see base and deltas, the latest partition of each file; a file's deletion is a
    tombstone. Writers make a new folder first and then a pointer of the next number, which no other writer can make
    too: who comes second puts its change on top of the first's. So a reader never sees half a state, and no
    change is lost. All access goes through Spark's readers and Hadoop's file system, so any store it knows will do.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointer(self) -> tuple[int, dict]:
        """Number and state of the current pointer."""
        found = [s.getPath().getName() for s in self._fs().globStatus(self._path("CURRENT-*")) or []]
        if not found:
            return 0, {"base": None, "deltas": []}
        rows = self.spark.read.text(f"{self.root}/{max(found)}").collect()
        return int(max(found)[8:]), json.loads("".join(r[0] for r in rows))

    def _read_pointer(self) -> dict:
        return self._pointer()[1]

    def _write_pointer(self, number: int, state: dict) -> bool:
        """Whether this was the first to write the pointer of that number: a whole file gets its name, if nothing has it."""
        jvm = self.spark._jvm
        new, name = self._path(f"pointer-{uuid.uuid4().hex}"), self._path(f"CURRENT-{number:012d}")
        out = self._fs().create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, name, keep)
        except Py4JJavaError as e:
            self._fs().delete(new, False)
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                raise
            return False
        return True

    def _swing(self, change: Callable[[dict], dict]) -> None:
        """Put a change on the current state, again if another writer was faster."""
        while True:
            number, state = self._pointer()
            if self._write_pointer(number + 1, change(state)):
                return

    def _write(self, tables: GraphTables, name: str, removed: DataFrame | None = None) -> None:
        for table, kind in TABLES.items():
            df = getattr(tables, table)
            if df is None:
                df = self.spark.createDataFrame([], kind)
            df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind.fields]).write.parquet(f"{self.root}/{name}/{table}")
        gone = removed.select("file_id") if removed is not None else self.spark.createDataFrame([], "file_id string")
        gone.write.parquet(f"{self.root}/{name}/removed")

    def _load(self, name: str) -> GraphTables:
        return GraphTables(**{t: self.spark.read.schema(k).parquet(f"{self.root}/{name}/{t}") for t, k in TABLES.items()})

    # Writing

    def replace_all(self, tables: GraphTables) -> None:
        """A new base; deltas before it are no longer read."""
        name = f"base-{uuid.uuid4().hex}"
        self._write(tables, name)
        self._index(tables, name)
        self._swing(lambda _: {"base": name, "deltas": []})

    def replace_partitions(self, tables: GraphTables, removed: DataFrame | None = None) -> None:
        """Append partitions that take the place of those of the same files; removed (file_id) deletes files."""
        name = f"delta-{uuid.uuid4().hex}"
        self._write(tables, name, removed)
        self._swing(lambda state: state | {"deltas": [*state["deltas"], name]})

    def compact(self) -> None:
        """Make the latest state the base; deltas that come meanwhile stay on top of it."""
        old = self._read_pointer()
        name = f"base-{uuid.uuid4().hex}"
        tables = self.load_latest(old)
        self._write(tables, name)
        self._index(tables, name)

        def change(state: dict) -> dict:
            if state["base"] != old["base"]:  # another base took this one's place
                return state
            return {"base": name, "deltas": state["deltas"][len(old["deltas"]) :]}

        self._swing(change)

    def _index(self, tables: GraphTables, name: str) -> None:
        symbols = last_nodes(tables).where("kind = 'symbol'").withColumn("name_shard", X.shard(F.coalesce("name", F.lit(""))))
        symbols.repartition("name_shard").write.partitionBy("name_shard").parquet(f"{self.root}/{name}/symbols")
        incremental.import_stems(tables).repartition("stem_shard").write.partitionBy("stem_shard").parquet(f"{self.root}/{name}/stems")

    # Reading

    def load_latest(self, state: dict | None = None) -> GraphTables:
        """The base with every delta applied in order, of the current state or a given one."""
        state = state or self._read_pointer()
        names = ([state["base"]] if state["base"] else []) + state["deltas"]
        if not names:
            return GraphTables(**{t: self.spark.createDataFrame([], k) for t, k in TABLES.items()})
        if len(names) == 1:
            return self._load(names[0])
        versions = None
        for v, name in enumerate(names):
            touched = self.spark.read.schema(schema.FILES).parquet(f"{self.root}/{name}/files").select("file_id", F.lit(v).alias("version"), F.lit(False).alias("gone"))
            removed = self.spark.read.schema("file_id string").parquet(f"{self.root}/{name}/removed").select("file_id", F.lit(v).alias("version"), F.lit(True).alias("gone"))
            both = touched.unionByName(removed)
            versions = both if versions is None else versions.unionByName(both)
        current = versions.groupBy("file_id").agg(F.max(F.struct("version", ~F.col("gone"))).alias("m")).where("m.col2").select("file_id", F.col("m.version").alias("version"))
        out = {}
        for table in TABLES:
            rows = None
            for v, name in enumerate(names):
                part = getattr(self._load(name), table).withColumn("version", F.lit(v))
                rows = part if rows is None else rows.unionByName(part)
            key = KEY[table]
            out[table] = rows.join(current.withColumnRenamed("file_id", key), [key, "version"], "left_semi").select(*[f"`{f.name}`" for f in TABLES[table].fields])
        return GraphTables(**out)

    def manifest(self) -> DataFrame:
        """file_id, path, fingerprint of the latest state."""
        return self.load_latest().files.select("file_id", "path", "fingerprint")

    def lookup_symbol(self, name: str) -> DataFrame:
        """Best facts of symbols of a name: one shard of the projection, or the latest state if there are deltas."""
        state = self._read_pointer()
        if state["base"] and not state["deltas"]:
            shard = F.conv(F.substring(F.sha2(F.lit(name).cast("binary"), 256), 1, 2), 16, 10).cast("int")
            found = self.spark.read.parquet(f"{self.root}/{state['base']}/symbols").where((F.col("name_shard") == shard) & (F.col("name") == name)).drop("name_shard")
        else:
            found = last_nodes(self.load_latest()).where((F.col("kind") == "symbol") & (F.col("name") == name))
        return best_facts(found)

    def plan_reindex(self, changed: DataFrame) -> DataFrame:
        """What to index again for changed paths; the projection is used only while it is current."""
        state = self._read_pointer()
        if state["base"] and not state["deltas"]:
            stems = self.spark.read.parquet(f"{self.root}/{state['base']}/stems")
        else:
            stems = incremental.import_stems(self.load_latest())
        return incremental.plan_reindex(stems, changed)

    # Checks

    def integrity_check(self) -> DataFrame:
        return integrity.integrity_check(self.load_latest())

    def partition_check(self, expected: DataFrame) -> DataFrame:
        """Expected entries (file_id, path, fingerprint) against what is stored."""
        return integrity.manifest_check(expected, self.load_latest().files)
