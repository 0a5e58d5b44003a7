"""The graph of a codebase as four DataFrames, and the rankings that make them one state."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine only where none is named, as in tests."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="graphloom-shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut a long lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def running(df: DataFrame, name: str, value: Column, *order: str) -> DataFrame:
    """df with the sum of a value over the rows before each in an order: rows are sorted by ranges, and each range starts with what those before sum up to.

    Only the sums by range, a row each, meet in one task.
    """
    placed = cut(df.withColumn("_value", value.cast("long")).orderBy(*order).withColumn("_range", F.spark_partition_id()))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.sum("_value").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(ahead(Window.orderBy("_range"))), F.lit(0)).alias("_start"))
    within = F.coalesce(F.sum("_value").over(ahead(Window.partitionBy("_range").orderBy(*order))), F.lit(0))
    return placed.withColumn("_in", within).join(F.broadcast(starts), "_range").select(*df.columns, (F.col("_start") + F.col("_in")).alias(name))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with the place of each row in an order, from 0."""
    return running(df, name, F.lit(1), *order)


@dataclass(frozen=True)
class GraphTables:
    """files, nodes, edges, diagnostics; nodes and edges carry their partition (file_part) and order in it (ord)."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame | None = None

    def cached(self) -> GraphTables:
        """Nodes and edges kept for many queries."""
        return replace(self, nodes=self.nodes.cache(), edges=self.edges.cache())

    def materialized(self) -> GraphTables:
        """Computed once and checkpointed."""
        return GraphTables(*[None if df is None else cut(df) for df in (self.files, self.nodes, self.edges, self.diagnostics)])

    def only(self, changed: DataFrame) -> GraphTables:
        """The partitions of the file_ids in changed."""
        parts = changed.select(F.col("file_id").alias("file_part")).distinct()
        keep = lambda df, key: df if df is None else df.join(parts.withColumnRenamed("file_part", key), key, "left_semi")
        return GraphTables(keep(self.files, "file_id"), keep(self.nodes, "file_part"), keep(self.edges, "file_part"), keep(self.diagnostics, "file_part"))

    def without(self, changed: DataFrame) -> GraphTables:
        parts = changed.select(F.col("file_id").alias("file_part")).distinct()
        keep = lambda df, key: df if df is None else df.join(parts.withColumnRenamed("file_part", key), key, "left_anti")
        return GraphTables(keep(self.files, "file_id"), keep(self.nodes, "file_part"), keep(self.edges, "file_part"), keep(self.diagnostics, "file_part"))

    def union(self, other: GraphTables) -> GraphTables:
        both = lambda a, b: b if a is None else a if b is None else a.unionByName(b)
        return GraphTables(both(self.files, other.files), both(self.nodes, other.nodes), both(self.edges, other.edges), both(self.diagnostics, other.diagnostics))


def replace_partitions(state: GraphTables, changed: GraphTables) -> GraphTables:
    """Upsert by file: a partition in changed takes the place of the one in state."""
    return state.without(changed.files).union(changed)


def latest(rows: DataFrame, key: str, *version: str) -> DataFrame:
    """The row of the greatest version for each key; partly aggregated before the shuffle."""
    names = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*version)).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in names])


def positioned(tables: GraphTables) -> DataFrame:
    """Nodes with the position of their partition."""
    pos = tables.files.select(F.col("file_id").alias("file_part"), "partition_pos")
    return tables.nodes.join(pos, "file_part", "left")


def last_nodes(tables: GraphTables) -> DataFrame:
    """One node an id: the last in the order of partitions, then of nodes."""
    return latest(positioned(tables), "id", "partition_pos", "ord").drop("partition_pos")


def best_facts(nodes: DataFrame) -> DataFrame:
    """Of symbols alike in file, names and kind, that of the best source and confidence; ties: smallest id."""
    key = ["file_id", "name", "qualified_name", "symbol_kind"]
    order = Window.partitionBy(*key).orderBy(F.desc("_score"), "id")
    scored = nodes.where("kind = 'symbol'").withColumn("_score", X.fact_score("provenance", "confidence"))
    return scored.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_score")


def first_symbols(nodes: DataFrame) -> DataFrame:
    """(file_part, known, local): the first symbol of each name or qualified name in a partition."""
    symbols = nodes.where("kind = 'symbol'").select("file_part", "id", "ord", F.explode(F.array_distinct(F.array_compact(F.array("name", "qualified_name")))).alias("known"))
    return symbols.groupBy("file_part", "known").agg(F.min_by("id", "ord").alias("local"))


def resolve_local(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Point calls and references at local symbols.

    Within a partition, an edge to an external symbol goes to the first symbol whose name or
    qualified name is that symbol's name, and gets a new id; others stay, and so does the external node.
    """
    first = first_symbols(nodes)
    external = nodes.where("kind = 'external-symbol'").groupBy("file_part", F.col("id").alias("to")).agg(F.min_by("name", "ord").alias("known"))
    hit = external.join(first, ["file_part", "known"]).select("file_part", "to", "local")
    moved = F.col("local").isNotNull() & F.col("kind").isin("calls", "references")
    return (
        edges.join(hit, ["file_part", "to"], "left")
        .withColumn("id", F.when(moved, X.edge_id("kind", "from", "local", "span")).otherwise(F.col("id")))
        .withColumn("to", F.when(moved, F.col("local")).otherwise(F.col("to")))
        .select(*edges.columns)
    )


def dedup_external(nodes: DataFrame) -> DataFrame:
    """Packages and external symbols once a partition, the first; other nodes as they are."""
    outside = F.col("kind").isin("package", "external-symbol")
    order = Window.partitionBy("file_part", "id").orderBy("ord")
    return nodes.where(~outside).unionByName(nodes.where(outside).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn"))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """Edges once a partition, the first of each id."""
    order = Window.partitionBy("file_part", "id").orderBy("ord")
    return edges.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def adjacency(edges: DataFrame) -> DataFrame:
    """Out- and in-degrees of every node of an edge, by edge kind."""
    ends = edges.select("kind", F.col("from").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select("kind", F.col("to").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id", "kind").agg(F.sum("o").cast("long").alias("out_degree"), F.sum("i").cast("long").alias("in_degree"))
