"""The fixed queries over a graph: symbols, callers, callees, references, dependencies, traversal, impact."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .tables import GraphTables, best_facts, cut, last_nodes

NODE = ["id", "kind", "language", "name", "qualified_name", "symbol_kind", "file_id", "provenance", "confidence"]


class GraphQuery:
    """Queries answer DataFrames; lists of names may be a list or a DataFrame of one column."""

    def __init__(self, tables: GraphTables):
        self.tables = tables
        self.by_id = last_nodes(tables)
        self.paths = tables.files.select("file_id", "path")

    def _names(self, names: str | Iterable[str] | DataFrame) -> DataFrame:
        if isinstance(names, DataFrame):
            return names.select(F.col(names.columns[0]).alias("wanted")).distinct()
        rows = [(names,)] if isinstance(names, str) else [(n,) for n in names]
        return self.tables.nodes.sparkSession.createDataFrame(rows, "wanted string").distinct()

    def _last(self, ids: DataFrame) -> DataFrame:
        """The last node of each of the ids (id): only their rows are ranked."""
        return last_nodes(replace(self.tables, nodes=self.tables.nodes.join(ids.select("id").distinct(), "id", "left_semi")))

    def _last_where(self, condition: Column) -> DataFrame:
        """Last nodes that meet a condition: ids of nodes that do are ranked, as no other's last node can."""
        return self._last(self.tables.nodes.where(condition).select("id")).where(condition)

    def symbols(self) -> DataFrame:
        return self.by_id.where("kind = 'symbol'").orderBy("id")

    def lookup_symbols(self, name: str | None = None, qualified_name: str | None = None, path: str | None = None, symbol_kind: str | None = None) -> DataFrame:
        """Best fact of each symbol key among symbols that match all that is given, in the order of the keys."""
        wanted = F.col("kind") == "symbol"
        for column, value in (("name", name), ("qualified_name", qualified_name), ("symbol_kind", symbol_kind)):
            if value is not None:
                wanted &= F.col(column) == value
        found = self._last_where(wanted)
        if path is not None:
            found = found.join(self.paths.where(F.col("path") == path).select("file_id"), "file_id", "left_semi")
        return best_facts(found).orderBy(*[F.asc_nulls_first(c) for c in ("file_id", "name", "qualified_name", "symbol_kind")])

    def matching_symbols(self, name: str) -> DataFrame:
        return self._last_where((F.col("kind") == "symbol") & ((F.col("name") == name) | (F.col("qualified_name") == name)))

    def named(self, names, kind: str | None = None) -> DataFrame:
        """Ids of nodes of a kind, or any, with one of the names, as (wanted, id)."""
        wanted = self._names(names)
        known = lambda nodes: nodes.select("id", "kind", F.explode(F.array_distinct(F.array_compact(F.array("name", "qualified_name")))).alias("wanted")).join(wanted, "wanted")
        found = known(self._last(known(self.tables.nodes)))
        return (found if kind is None else found.where(F.col("kind") == kind)).select("wanted", "id").distinct()

    def file_dependencies(self, paths) -> DataFrame:
        """Distinct labels that files import or depend on, as (path, label)."""
        files = self.paths.join(self._names(paths), F.col("path") == F.col("wanted")).select("path", F.col("file_id").alias("file_part"))
        edges = self.tables.edges.where(F.col("kind").isin("imports", "depends-on")).select("file_part", F.col("to").alias("id"))
        met = files.join(edges, "file_part")
        labels = self._last(met).select("id", X.label().alias("label")).where("label is not null")
        return met.join(labels, "id").select("path", "label").distinct()

    def package_dependencies(self) -> DataFrame:
        return self._last_where((F.col("kind") == "package") & F.col("name").isNotNull()).select("name").distinct().orderBy("name")

    def _out(self, kind: str, starts: DataFrame) -> DataFrame:
        """Nodes at the ends of edges of a kind from the starts (id, ...); a row an edge."""
        edges = self.tables.edges.where(F.col("kind") == kind).select(F.col("from").alias("id"), F.col("to").alias("_to"), F.col("id").alias("edge_id"))
        met = starts.join(edges, "id").drop("id")
        ends = self._last(met.select(F.col("_to").alias("id"))).select(*[F.col(c) if c != "id" else F.col("id").alias("_to") for c in NODE])
        return met.join(ends, "_to").withColumnRenamed("_to", "id")

    def _into(self, kind: str, names) -> DataFrame:
        edges = self.tables.edges.where(F.col("kind") == kind).select(F.col("to").alias("id"), F.col("from").alias("_from"), F.col("id").alias("edge_id"))
        found = self.named(names).join(edges, "id").withColumnRenamed("id", "target_id")
        ends = self._last(found.select(F.col("_from").alias("id"))).select(*[F.col(c) if c != "id" else F.col("id").alias("_from") for c in NODE])
        return found.join(ends, "_from").withColumnRenamed("_from", "id")

    def callees(self, names) -> DataFrame:
        """What symbols of the names call: a bag, one row an edge."""
        return self._out("calls", self.named(names, "symbol"))

    def callers(self, names) -> DataFrame:
        """What calls a node of any kind of the names: a bag, one row an edge."""
        return self._into("calls", names)

    def references(self, names) -> DataFrame:
        return self._into("references", names)

    def partition_for_path(self, paths) -> DataFrame:
        """(path, file_id) of files by path."""
        return self.paths.join(self._names(paths), F.col("path") == F.col("wanted"), "left_semi").select("path", "file_id")

    def path_for_file(self, file_ids) -> DataFrame:
        """(file_id, path) of files by id."""
        return self.paths.join(self._names(file_ids), F.col("file_id") == F.col("wanted"), "left_semi").select("file_id", "path")

    def path_for_node(self, ids) -> DataFrame:
        """(id, path) of nodes by id; null for nodes of no file."""
        wanted = self._names(ids).withColumnRenamed("wanted", "id")
        return self._last(wanted).select("id", "file_id").join(self.paths, "file_id", "left").select("id", "path")

    def impact_from_files(self, paths) -> DataFrame:
        """Paths of changed files and of files with an import or dependency into one: one hop. Unknown paths are ignored."""
        changed = self.paths.join(self._names(paths), F.col("path") == F.col("wanted"), "left_semi").select("file_id")
        into = lambda nodes: nodes.join(changed, "file_id", "left_semi").select("id")
        targets = into(self._last(into(self.tables.nodes)))
        edges = self.tables.edges.where(F.col("kind").isin("imports", "depends-on"))
        hit = edges.join(targets, edges["to"] == targets["id"], "left_semi").select(F.col("file_part").alias("file_id"))
        return self.paths.join(hit.unionByName(changed).distinct(), "file_id", "left_semi").select("path").distinct().orderBy("path")

    def traverse_dependencies(self, starts: DataFrame, max_depth: int = 3, checkpoint_every: int = 4) -> DataFrame:
        """Nodes reached from each start (start_id) over dependency edges within max_depth steps, with their least depth.

        Each start's frontier is a join without those seen, so work is bounded by depth. A start is reached
        only by a cycle back to it. Dangling targets are passed through, but are no result.
        """
        edges = self.tables.edges.where("kind = 'depends-on'").select(F.col("from").alias("id"), F.col("to").alias("next")).distinct()
        frontier = starts.select("start_id", F.col("start_id").alias("id")).distinct()
        seen = None
        for depth in range(1, max_depth + 1):
            frontier = frontier.join(edges, "id").select("start_id", F.col("next").alias("id")).distinct()
            if seen is not None:
                frontier = frontier.join(seen.select("start_id", "id"), ["start_id", "id"], "left_anti")
            level = frontier.withColumn("depth", F.lit(depth))
            seen = level if seen is None else seen.unionByName(level)
            if depth % checkpoint_every == 0:
                seen = cut(seen)
                frontier = seen.where(F.col("depth") == depth).select("start_id", "id")
        if seen is None:
            seen = frontier.where("false").withColumn("depth", F.lit(0))
        return seen.join(self._last(seen).select(*NODE), "id").orderBy("start_id", "id")

    def dependency_tree(self, names, max_depth: int = 3) -> DataFrame:
        """traverse_dependencies from every symbol of the names; what several reach repeats."""
        starts = self.named(names, "symbol").select(F.col("id").alias("start_id"))
        return self.traverse_dependencies(starts, max_depth)

    def neighbours(self, ids: DataFrame, kind: str, outgoing: bool = True) -> DataFrame:
        """Edges of a kind that leave (or enter) the ids (id)."""
        end = "from" if outgoing else "to"
        edges = self.tables.edges.where(F.col("kind") == kind)
        return edges.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi")
