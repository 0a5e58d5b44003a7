"""What to index again after a change: changed files, and those that import what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .tables import GraphTables


def import_stems(tables: GraphTables) -> DataFrame:
    """Distinct (stem, path, stem_shard) of what each file imports."""
    imports = tables.nodes.where("kind = 'import'").select("file_part", X.module_stem(X.label()).alias("stem")).where("stem is not null")
    files = tables.files.select(F.col("file_id").alias("file_part"), "path")
    return imports.join(files, "file_part").select("stem", "path").distinct().withColumn("stem_shard", X.shard("stem"))


def plan_reindex(stems: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, reason): changed paths, and files that import a changed path's stem; no path twice.

    Only shards of changed stems are read where stems is stored by shard.
    """
    changed = changed.select("path").distinct()
    wanted = changed.select(X.file_stem("path").alias("stem")).where("stem <> ''").distinct().withColumn("stem_shard", X.shard("stem"))
    reverse = stems.join(wanted, ["stem_shard", "stem"], "left_semi").select("path").distinct().join(changed, "path", "left_anti")
    return changed.withColumn("reason", F.lit("changed")).unionByName(reverse.withColumn("reason", F.lit("reverse-dependency")))


def index_summary(tables: GraphTables, skipped: DataFrame | None = None) -> DataFrame:
    """One row: files, nodes, edges, diagnostics, times, and the largest file's nodes and edges."""
    per = lambda df, name: df.groupBy("file_part").agg(F.count("*").alias(name))
    rows = tables.files.select(F.col("file_id").alias("file_part"), "parse_time_micros", "extraction_time_micros")
    parts = [("nodes", tables.nodes), ("edges", tables.edges)] + ([("diagnostics", tables.diagnostics)] if tables.diagnostics is not None else [])
    for name, df in parts:
        rows = rows.join(per(df, name), "file_part", "left")
    sums = [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n, _ in parts] + [F.coalesce(F.max(n), F.lit(0)).cast("long").alias(f"max_{n}_per_file") for n in ("nodes", "edges")]
    out = rows.agg(F.count("*").alias("files"), F.sum("parse_time_micros").alias("parse_time_micros"), F.sum("extraction_time_micros").alias("extraction_time_micros"), *sums)
    return out if skipped is None else out.crossJoin(F.broadcast(skipped.agg(F.count("*").alias("skipped"))))


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"))
