"""Checks of stored graphs; each problem is a row of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .tables import GraphTables


def problems(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def symbols_without_file(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'symbol' and file_id is null").select(F.concat(F.lit("symbol "), "id", F.lit(" has no file")).alias("problem"))


def foreign_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes stored in a partition of another file than theirs."""
    return nodes.where("file_id is not null and file_id <> file_part").select(F.concat(F.lit("node "), "id", F.lit(" is stored in "), "file_part").alias("problem"))


def invalid_spans(rows: DataFrame, what: str) -> DataFrame:
    s = F.col("span")
    kinds = F.array_compact(F.array(F.when(s["byte_start"] > s["byte_end"], "byte"), F.when(~X.valid_span("span") & (s["byte_start"] <= s["byte_end"]), "line/column")))
    return rows.where(s.isNotNull() & ~X.valid_span("span")).select(F.explode(kinds).alias("k"), "id").select(F.concat(F.lit(f"{what} "), "id", F.lit(" has an invalid "), "k", F.lit(" span")).alias("problem"))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges without a source, or without a target unless they are dependencies; ends may be in any partition."""
    known = nodes.select("id").distinct()
    gone = lambda end: edges.join(known.withColumnRenamed("id", end), end, "left_anti")
    source = gone("from").select(F.concat(F.lit("edge "), "id", F.lit(" has no source "), "from").alias("problem"))
    target = gone("to").where("kind <> 'depends-on'").select(F.concat(F.lit("edge "), "id", F.lit(" has no target "), "to").alias("problem"))
    return source.unionByName(target)


def integrity_check(tables: GraphTables) -> DataFrame:
    return problems(symbols_without_file(tables.nodes), foreign_nodes(tables.nodes), invalid_spans(tables.nodes, "node"), invalid_spans(tables.edges, "edge"), dangling_edges(tables.nodes, tables.edges))


def check_partitions(tables: GraphTables) -> DataFrame:
    """What can be checked partition by partition."""
    return problems(symbols_without_file(tables.nodes), foreign_nodes(tables.nodes), invalid_spans(tables.nodes, "node"), invalid_spans(tables.edges, "edge"))


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries without a stored partition, or whose path or fingerprint differs from it."""
    stored = files.select("file_id", F.col("path").alias("_path"), F.col("fingerprint").alias("_fingerprint"), F.lit(True).alias("_there"))
    found = F.array_compact(F.array(
        F.when(F.col("_there").isNull(), F.concat(F.lit("missing partition of "), "file_id")),
        F.when(~F.col("path").eqNullSafe(F.col("_path")) & F.col("_there"), F.concat(F.lit("path mismatch of "), "file_id")),
        F.when(~F.col("fingerprint").eqNullSafe(F.col("_fingerprint")) & F.col("_there"), F.concat(F.lit("fingerprint mismatch of "), "file_id")),
    ))
    return manifest.join(stored, "file_id", "left").select(F.explode(found).alias("problem"))
