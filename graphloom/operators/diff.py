"""Semantic comparison of two graphs, and what a reviewer should look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import expr as X
from .tables import GraphTables, cut, last_nodes

KEY = ["file", "language", "kind", "scoped_name"]
IMPACT_KINDS = ["calls", "references", "imports", "depends-on"]
TOP = 8


def rename_map(changes: DataFrame) -> DataFrame:
    """(old_path, new_path) of renames alone; copies keep their source."""
    return changes.where("change = 'renamed' and old_path is not null").select("old_path", F.col("path").alias("new_path"))


def exported_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_part, exported) by the names of export nodes."""
    return nodes.where("kind = 'export' and name is not null").select("file_part", F.col("name").alias("exported")).distinct()


def declared_public(snippet: X.Name) -> Column:
    """The first line that isn't blank or an attribute starts with pub or export."""
    rows = F.filter(F.transform(F.split(X.col(snippet), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#[")))
    return F.coalesce(F.regexp_like(F.get(rows, F.lit(0)), F.lit(r"^(pub |pub\(|export )")), F.lit(False))


def side_symbols(tables: GraphTables, sources: DataFrame | None = None, renames: DataFrame | None = None) -> DataFrame:
    """One row a symbol key: what names it, whether it is public, and a fingerprint to compare.

    sources: (file_id, text). renames rewrite the base side's paths. Of symbols with one key the
    last in order stays. The fingerprint holds the span only where there is no text to hash.
    """
    files = tables.files.select(F.col("file_id").alias("file_part"), F.col("path").alias("own_path"), "partition_pos")
    rows = tables.nodes.where("kind = 'symbol'").join(files, "file_part")
    if sources is not None:
        rows = rows.join(sources.select(F.col("file_id").alias("file_part"), "text"), "file_part", "left").withColumn("snippet", X.span_text("text", "span")).drop("text")
    else:
        rows = rows.withColumn("snippet", F.lit(None).cast("string"))
    if renames is not None:
        rows = rows.join(renames, F.col("own_path") == F.col("old_path"), "left").withColumn("file", F.coalesce("new_path", "own_path"))
    else:
        rows = rows.withColumn("file", F.col("own_path"))
    exports = exported_names(tables.nodes, tables.edges).groupBy("file_part").agg(F.collect_set("exported").alias("exports"))
    rows = rows.join(exports, "file_part", "left")
    listed = F.coalesce(F.array_contains("exports", F.col("name")), F.lit(False)) | F.coalesce(F.array_contains("exports", F.col("qualified_name")), F.lit(False))
    kind = F.coalesce("symbol_kind", F.lit("unknown"))
    source_hash = X.fingerprint("snippet")
    keyed = rows.select(
        "file", "language", kind.alias("kind"), X.scoped_name("symbol_kind", "qualified_name", "name").alias("scoped_name"), "partition_pos", "ord",
        F.struct(
            F.coalesce("name", "qualified_name", F.lit("")).alias("name"), "qualified_name", F.col("own_path").alias("path"),
            F.struct(F.when(source_hash.isNull(), F.col("span")).alias("span"), source_hash.alias("hash"), "provenance", "confidence").alias("fingerprint"),
            (listed | declared_public("snippet")).alias("public"),
        ).alias("entry"),
    )
    return keyed.groupBy(*KEY).agg(F.max_by("entry", F.struct("partition_pos", "ord")).alias("entry"))


def compare_symbols(base: DataFrame, head: DataFrame) -> DataFrame:
    """Added, removed and modified symbols of two side_symbols, ordered by file, language, kind, name."""
    b, h = base.alias("b"), head.alias("h")
    on = F.lit(True)
    for k in KEY:
        on = on & F.col(f"b.{k}").eqNullSafe(F.col(f"h.{k}"))
    before, after = F.col("b.entry"), F.col("h.entry")
    change = F.when(before.isNull(), "added").when(after.isNull(), "removed").when(~before["fingerprint"].eqNullSafe(after["fingerprint"]), "modified")
    reason = F.when(F.col("change") == "modified", "symbol body or span changed").otherwise(F.concat(F.lit("symbol "), F.col("change")))
    keys = [F.coalesce(F.col(f"h.{k}"), F.col(f"b.{k}")).alias(k) for k in KEY]
    public = F.coalesce(before["public"], F.lit(False)) | F.coalesce(after["public"], F.lit(False))
    both = b.join(h, on, "full_outer").select(*keys, change.alias("change"), before.alias("before"), after.alias("after"), public.alias("public_api"))
    return (
        both.where("change is not null").withColumn("risk", X.risk_for("change", "public_api")).withColumn("reason", reason)
        .withColumn("symbol", F.coalesce("after.qualified_name", "after.name", "before.qualified_name", "before.name"))
        .withColumn("path", F.coalesce("after.path", "before.path"))
        .orderBy("file", X.ordinal("language", schema.LANGUAGES), "kind", "scoped_name")
    )


def side_dependencies(tables: GraphTables, renames: DataFrame | None = None) -> DataFrame:
    """Distinct (file, dependency, edge_kind) of imports and dependencies with a label."""
    labels = last_nodes(tables).select(F.col("id").alias("to"), X.label().alias("dependency")).where("dependency is not null")
    files = tables.files.select(F.col("file_id").alias("file_part"), F.col("path").alias("file"))
    rows = tables.edges.where("kind in ('imports', 'depends-on')").join(labels, "to").join(files, "file_part")
    if renames is not None:
        rows = rows.join(renames, F.col("file") == F.col("old_path"), "left").withColumn("file", F.coalesce("new_path", "file"))
    return rows.select("file", "dependency", F.col("kind").alias("edge_kind")).distinct()


def compare_dependencies(base: DataFrame, head: DataFrame) -> DataFrame:
    keys = ["file", "dependency", "edge_kind"]
    gone = base.join(head, keys, "left_anti").withColumn("change", F.lit("removed"))
    new = head.join(base, keys, "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(new)


def changed_labels(symbols: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Distinct names by which changed symbols and dependencies are referred to."""
    names = F.array("before.name", "before.qualified_name", "after.name", "after.qualified_name")
    return symbols.select(F.explode(F.array_compact(names)).alias("label")).unionByName(dependencies.select(F.col("dependency").alias("label"))).distinct()


def edge_impacts(tables: GraphTables, labels: DataFrame) -> DataFrame:
    """(path, reason) of edges into nodes of the labels; the path is that of the edge's source node, else of its partition."""
    known = last_nodes(tables)
    paths = tables.files.select("file_id", "path")
    ends = known.select(F.col("id").alias("to"), X.label().alias("label")).join(labels, "label", "left_semi")
    sources = known.select(F.col("id").alias("from"), "file_id").join(paths, "file_id").select("from", F.col("path").alias("source_path"))
    own = paths.select(F.col("file_id").alias("file_part"), F.col("path").alias("own_path"))
    edges = tables.edges.where(F.col("kind").isin(*IMPACT_KINDS)).select("file_part", "kind", "from", "to")
    rows = edges.join(ends, "to").join(sources, "from", "left").join(own, "file_part", "left")
    return rows.select(F.coalesce("source_path", "own_path").alias("path"), F.concat_ws(" ", X.impact_verb("kind"), "label").alias("reason")).distinct()


def impacted_files(base: GraphTables, head: GraphTables, changes: DataFrame, symbols: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(path, reasons): changed files, and files whose edges on either side lead to a changed name."""
    labels = changed_labels(symbols, dependencies)
    rows = changes.select("path", F.concat(F.lit("file "), "change").alias("reason"))
    for side in (base, head):
        rows = rows.unionByName(edge_impacts(side, labels))
    return rows.groupBy("path").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def diagnostics(side: str, run: DataFrame | None, tables: GraphTables) -> DataFrame:
    """Run-level, then partition diagnostics of a side with the path of their file, null if unknown."""
    paths = tables.files.select("file_id", F.col("path").alias("file"))
    rows = tables.diagnostics.select("severity", "message", "file_id").withColumn("section", F.lit(1))
    if run is not None:
        rows = run.select("severity", "message", "file_id").withColumn("section", F.lit(0)).unionByName(rows)
    return rows.join(paths, "file_id", "left").select(F.lit(side).alias("side"), "section", "severity", "message", "file")


def count(rows: DataFrame, *conditions: tuple[str, str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.expr(c)).alias(name) for name, c in conditions])


def stats(changes: DataFrame, symbols: DataFrame, dependencies: DataFrame, impacted: DataFrame, found: DataFrame, base: GraphTables, head: GraphTables) -> DataFrame:
    """One row of counts; copies count as added, changes of type as modified, renamed symbols as modified."""
    parts = [
        count(changes, ("files_added", "change in ('added', 'copied')"), ("files_removed", "change = 'removed'"), ("files_modified", "change in ('modified', 'type-changed')"), ("files_renamed", "change = 'renamed'")),
        count(symbols, ("symbols_added", "change in ('added', 'copied')"), ("symbols_removed", "change = 'removed'"), ("symbols_modified", "change in ('modified', 'renamed', 'type-changed')"), ("public_api_changes", "public_api")),
        count(dependencies, ("dependency_changes", "true")), count(impacted, ("impacted_files", "true")), count(found, ("diagnostics", "true")),
        count(base.files, ("base_indexed_files", "true")), count(head.files, ("head_indexed_files", "true")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


# Triage

#: Sentences of a review.
DEPENDENCY_REASON = "dependency surface changed"
DIAGNOSTIC_REASON = "changed file has parser or indexing diagnostics"
IMPACT_REASON = "impacted by changed graph facts"
NO_TESTS_NOTE = "No test files changed; verify existing coverage exercises this diff."
BROAD_NOTE = "Raw symbol diff is broad; prefer top_changes and review_focus for agent triage."
DIAGNOSTIC_NOTE = "Changed files have parser or indexing diagnostics; inspect diagnostics before trusting impact."


def important_symbols(symbols: DataFrame) -> DataFrame:
    """Public, risky, added or removed symbols, highest score first."""
    kept = symbols.where("public_api or risk <> 'low' or change in ('added', 'removed')")
    return kept.withColumn("score", X.symbol_score("risk", "public_api", "change")).orderBy(F.desc("score"), "symbol")


def _signals(changes: DataFrame, important: DataFrame, dependencies: DataFrame, found: DataFrame) -> DataFrame:
    text = lambda v=None: F.lit(v).cast("string")
    files = changes.select("path", X.file_score("change").alias("score"), X.file_risk("path", "change").alias("risk"), F.lit(1).alias("seq"), F.concat("change", F.lit("-file")).alias("kind"), text().alias("symbol"), X.file_reason("path", "change", "old_path").alias("reason"))
    symbols = important.where("path is not null").select("path", "score", "risk", F.lit(0).alias("seq"), text().alias("kind"), "symbol", X.symbol_reason("public_api", "change").alias("reason"))
    deps = dependencies.select(F.col("file").alias("path"), F.lit(8).alias("score"), F.lit("medium").alias("risk"), F.lit(2).alias("seq"), F.concat("change", F.lit("-dependency")).alias("kind"), text().alias("symbol"), F.lit(DEPENDENCY_REASON).alias("reason"))
    known = files.unionByName(symbols).unionByName(deps)
    broken = found.where("file is not null").select(F.col("file").alias("path")).join(known.select("path").distinct(), "path", "left_semi")
    return known.unionByName(broken.select("path", F.lit(6).alias("score"), F.lit("medium").alias("risk"), F.lit(0).alias("seq"), text().alias("kind"), text().alias("symbol"), F.lit(DIAGNOSTIC_REASON).alias("reason")))


def top_changes(changes: DataFrame, symbols: DataFrame, dependencies: DataFrame, found: DataFrame, n: int = TOP) -> DataFrame:
    """The n paths of the highest summed score: kind, a summary of their symbols, highest risk, reasons."""
    signals = _signals(changes, important_symbols(symbols), dependencies, found)
    grouped = signals.groupBy("path").agg(
        F.sum("score").cast("long").alias("score"),
        X.max_risk("risk").alias("risk"),
        F.coalesce(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("seq", "kind"))), F.lit("changed-file")).alias("kind"),
        X.symbol_summary(F.collect_set("symbol")).alias("symbol"),
        F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("why_it_matters"),
    )
    return grouped.orderBy(F.desc("score"), "path").limit(n)


def review_focus(changes: DataFrame, top: DataFrame, impacted: DataFrame, n: int = TOP) -> DataFrame:
    """The n paths to read first: top changes, changed files, and changed files that are impacted too."""
    rows = top.select("path", (X.risk_score("risk") + 3).alias("score"), F.split("why_it_matters", "; ").alias("reasons"))
    rows = rows.unionByName(changes.select("path", X.file_score("change").alias("score"), F.array(X.file_reason("path", "change", "old_path")).alias("reasons")))
    touched = impacted.select("path").join(changes.select("path").distinct(), "path", "left_semi")
    rows = rows.unionByName(touched.select("path", F.lit(1).alias("score"), F.array(F.lit(IMPACT_REASON)).alias("reasons")))
    grouped = rows.groupBy("path").agg(F.sum("score").cast("long").alias("score"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))), "; ").alias("reason"))
    return grouped.orderBy(F.desc("score"), "path").limit(n)


def relevant_diagnostics(found: DataFrame, changes: DataFrame) -> DataFrame:
    return found.join(changes.select(F.col("path").alias("file")).distinct(), "file", "left_semi")


def triage(changes: DataFrame, symbols: DataFrame, dependencies: DataFrame, found: DataFrame) -> DataFrame:
    """One row: overall risk, counts, whether tests changed, and notes."""
    test = X.is_test_path("path")
    files = changes.agg(F.count("*").alias("files_changed"), F.coalesce(F.bool_or(test), F.lit(False)).alias("tests_changed"), F.coalesce(F.bool_or((F.col("change") == "removed") & ~test), F.lit(False)).alias("_lost"))
    of_symbols = count(symbols, ("public_api_changes", "public_api"), ("_dangerous", "public_api and risk = 'high'"), ("_symbols", "true"), ("important_symbol_changes", "public_api or risk <> 'low' or change in ('added', 'removed')"))
    rest = count(dependencies, ("dependency_changes", "true")).crossJoin(F.broadcast(count(relevant_diagnostics(found, changes), ("diagnostics", "true"))))
    row = files.crossJoin(F.broadcast(of_symbols)).crossJoin(F.broadcast(rest))
    risk = F.when((F.col("_dangerous") > 0) | F.col("_lost"), "high").when(
        (F.col("public_api_changes") > 0) | (F.col("dependency_changes") > 0) | (F.col("diagnostics") > 0) | ~F.col("tests_changed") | (F.col("important_symbol_changes") > 8), "medium"
    ).otherwise("low")
    notes = F.array_compact(F.array(
        F.when(~F.col("tests_changed"), NO_TESTS_NOTE),
        F.when(F.col("_symbols") > F.col("public_api_changes") + 20, BROAD_NOTE),
        F.when(F.col("diagnostics") > 0, DIAGNOSTIC_NOTE),
    ))
    return row.withColumn("risk", risk).withColumn("notes", notes).drop("_lost", "_dangerous", "_symbols")


class GraphDiff:
    """All sections of a comparison of two graphs; changes: (change, path, old_path); *_run: diagnostics of a whole run.

    materialize computes the graphs and the sections that others build on once, for use of several.
    """

    def __init__(self, base: GraphTables, head: GraphTables, changes: DataFrame, base_sources: DataFrame | None = None, head_sources: DataFrame | None = None, materialize: bool = False, base_run: DataFrame | None = None, head_run: DataFrame | None = None):
        held = cut if materialize else (lambda df: df)
        if materialize:
            base, head = base.materialized(), head.materialized()
        self.base, self.head = base, head
        self.changed_files = changes
        renames = rename_map(changes)
        self.changed_symbols = held(compare_symbols(side_symbols(base, base_sources, renames), side_symbols(head, head_sources)))
        self.public_api_changes = self.changed_symbols.where("public_api")
        self.dependency_changes = held(compare_dependencies(side_dependencies(base, renames), side_dependencies(head)))
        self.impacted_files = held(impacted_files(base, head, changes, self.changed_symbols, self.dependency_changes))
        self.diagnostics = diagnostics("base", base_run, base).unionByName(diagnostics("head", head_run, head))

    def stats(self) -> DataFrame:
        return stats(self.changed_files, self.changed_symbols, self.dependency_changes, self.impacted_files, self.diagnostics, self.base, self.head)

    def top_changes(self) -> DataFrame:
        return top_changes(self.changed_files, self.changed_symbols, self.dependency_changes, self.diagnostics)

    def review_focus(self) -> DataFrame:
        return review_focus(self.changed_files, self.top_changes(), self.impacted_files)

    def triage(self) -> DataFrame:
        return triage(self.changed_files, self.changed_symbols, self.dependency_changes, self.diagnostics)


