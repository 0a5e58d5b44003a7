"""Queries of diffs, exports, imports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schema
from ..functions import expr as X
from ..operators.diff import GraphDiff, important_symbols
from ..operators.tables import GraphTables, shared_folder
from ..sources import extract, interchange
from ..streaming import watch
from .projection import GRAPH_SQL, graph, read


#: Names that some files export, one of them qualified.
EXPORTED = ["supplier_3", "mod.AUTOMOBILE_7"]


def sides(spark, d) -> GraphDiff:
    """Base and head: symbols by rule of their number; head's qualities changed for some; files renamed for some, and some export names."""
    g = graph(spark, d)
    key = F.substring_index("id", ":", -1)
    symbol = F.col("kind") == "symbol"
    number = F.when(symbol, key.cast("long"))
    rest = F.coalesce(number, F.lit(-1))
    listed = g.files.where("partition_pos % 4 = 0").select("file_id", "language", F.explode(F.array(*[F.lit(x) for x in EXPORTED])).alias("name"))
    null = F.lit(None).cast("string")
    exports = listed.select(
        F.col("file_id").alias("file_part"), F.lit(9_000_000).cast("long").alias("ord"), F.concat(F.lit("node:exp:"), "file_id", F.lit(":"), "name").alias("id"), F.lit("export").alias("kind"), "language", "name",
        null.alias("qualified_name"), null.alias("symbol_kind"), "file_id", F.lit(None).cast(schema.SPAN).alias("span"), F.lit("structural-scanner").alias("provenance"), F.lit("medium").alias("confidence"),
    )
    base = GraphTables(g.files, g.nodes.where(~symbol | (rest % 10 != 0)).unionByName(exports), g.edges, g.diagnostics)
    nodes = g.nodes.unionByName(exports).where(~symbol | (rest % 10 != 1)).withColumn("confidence", F.when(symbol & (rest % 7 == 0), "exact").otherwise(F.col("confidence")))
    renamed = F.when(F.col("partition_pos") % 11 == 0, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    head = GraphTables(g.files.withColumn("path", renamed), nodes, g.edges.where("not (kind = 'imports' and id like '%Brand#1%')"), g.diagnostics)
    pos = F.col("partition_pos")
    changes = g.files.where("partition_pos % 3 <> 1").select(
        F.when(pos % 11 == 0, "renamed").when(pos % 5 == 0, "added").when(pos % 7 == 0, "removed").otherwise("modified").alias("change"),
        F.when(pos % 11 == 0, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path")).alias("path"),
        F.when(pos % 11 == 0, F.col("path")).alias("old_path"),
    )
    return GraphDiff(base, head, changes)


def diff_symbols(spark, d):
    return sides(spark, d).changed_symbols.select("file", "language", "kind", "scoped_name", "change", "risk", "reason")


def diff_deps(spark, d):
    return sides(spark, d).dependency_changes


def diff_impact(spark, d):
    return sides(spark, d).impacted_files.select("path", F.array_join("reasons", "; ").alias("reasons"))


def diff_stats(spark, d):
    return sides(spark, d).stats()


def diff_diagnostics(spark, d):
    return sides(spark, d).diagnostics.select("side", "severity", "message", "file")


def agent_important(spark, d):
    return important_symbols(sides(spark, d).changed_symbols).select("symbol", "path", "change", F.col("score").cast("long").alias("score"))


def agent_top8(spark, d):
    return sides(spark, d).top_changes()


def agent_focus8(spark, d):
    return sides(spark, d).review_focus()


def agent_risk(spark, d):
    return sides(spark, d).triage().withColumn("notes", F.array_join("notes", " | "))


def public_api(spark, d):
    from ..operators.diff import declared_public
    from .text import code

    return code(spark, d).select("o_orderkey", declared_public(F.concat(F.lit("#[x]\n  \n"), F.col("line"))).alias("public"))


def export_jsonl(spark, d):
    """Counts and a digest of the lines of each kind, as their spans are nested."""
    lines = interchange.export_jsonl(graph(spark, d))
    kind = F.get_json_object("line", "$.type")
    return lines.groupBy(kind.alias("type")).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.get_json_object("line", "$.partition"), F.get_json_object("line", "$.file_id"))).alias("partitions"))


def export_symbols(spark, d):
    line = F.col("line")
    return interchange.export_symbols(graph(spark, d)).select(*[F.get_json_object(line, f"$.{k}").alias(k) for k in ("path", "name", "qualified_name", "kind")])


def export_scip(spark, d):
    doc = F.from_json(F.ltrim(F.col("line"), F.lit(",")), "relative_path string, symbols array<struct<id: string>>")
    return interchange.export_scip(graph(spark, d)).where("line not like '{\"version%' and line <> ']}'").select(doc.alias("x")).where("size(x.symbols) > 0").select("x.relative_path", F.size("x.symbols").cast("long").alias("n"), F.array_join(F.array_sort("x.symbols.id"), ",").alias("ids"))


def export_lsif(spark, d):
    line = F.col("line")
    return interchange.export_lsif(graph(spark, d)).select("id", *[F.get_json_object(line, f"$.{k}").alias(k) for k in ("label", "uri", "symbol")])


def import_roundtrip(spark, d):
    """All columns of what an export of many part files gives when it is read again."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    interchange.write_lines(interchange.export_jsonl(graph(spark, d)), path)
    back = interchange.import_jsonl(interchange.read_jsonl(spark, path))
    null = F.lit(None).cast("string")
    number = lambda c: F.col(c).cast("long")
    files = back.files.select(F.lit("file").alias("record"), F.col("file_id").alias("file_part"), F.lit("").alias("id"), F.col("path").alias("a"), F.col("language").alias("b"), F.col("fingerprint").alias("c"), number("partition_pos").alias("n"), number("parse_time_micros").alias("m"))
    nodes = back.nodes.select(F.lit("node").alias("record"), "file_part", "id", F.concat_ws("|", "kind", "language", "name", "qualified_name", "symbol_kind").alias("a"), F.col("file_id").alias("b"), F.concat_ws("|", "provenance", "confidence").alias("c"), number("span.byte_end").alias("n"), number("span.end.column").alias("m"))
    edges = back.edges.select(F.lit("edge").alias("record"), "file_part", "id", F.col("kind").alias("a"), F.col("from").alias("b"), F.col("to").alias("c"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("m"))
    diagnostics = back.diagnostics.select(F.lit("diagnostic").alias("record"), "file_part", null.alias("id"), F.col("severity").alias("a"), F.col("message").alias("b"), F.col("file_id").alias("c"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("m"))
    return files.unionByName(nodes).unionByName(edges).unionByName(diagnostics)


def scip_import(spark, d):
    occurrences = F.collect_list(F.struct(F.concat(F.lit("pkg/"), F.col("s_name"), F.lit("#m")).alias("symbol"), F.array(F.col("s_suppkey"), F.lit(2).cast("long"), F.lit(9).cast("long")).alias("range"), (F.col("s_suppkey") % 3).alias("roles")))
    documents = read(spark, d, "supplier").groupBy("s_nationkey").agg(occurrences.alias("occurrences")).select(F.struct(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".py")).alias("relativePath"), "occurrences").alias("x"))
    json = documents.agg(F.to_json(F.struct(F.collect_list("x").alias("documents"))).alias("json"))
    g = interchange.import_scip(json, "repo")
    nodes = g.nodes.where("kind = 'symbol'").select("file_part", "id", F.col("name"), F.col("span.start.line").alias("line"), F.col("span.end.column").alias("col_end"), "provenance")
    paths = g.files.select(F.col("file_id").alias("file_part"), "path")
    edges = g.edges.select(F.col("to").alias("id"), F.col("kind").alias("edge"))
    return nodes.join(paths, "file_part").join(edges, "id").select("path", "name", "line", "col_end", "provenance", "edge")


def lsp_import(spark, d):
    point = lambda c: F.struct(F.col("s_suppkey").alias("line"), F.lit(c).cast("long").alias("character"))
    facts = F.collect_list(F.struct(F.col("s_name").alias("symbol"), F.when(F.col("s_suppkey") % 2 == 0, "definition").otherwise("reference").alias("kind"), F.struct(point(1).alias("start"), point(5).alias("end")).alias("range")))
    uri = F.concat(F.when(F.col("s_nationkey") % 2 == 0, "file:///w/").otherwise(""), F.lit("n"), F.col("s_nationkey").cast("string"))
    documents = read(spark, d, "supplier").groupBy("s_nationkey").agg(facts.alias("facts")).select(F.struct(uri.alias("uri"), "facts").alias("x"))
    g = interchange.import_lsp(documents.agg(F.to_json(F.struct(F.collect_list("x").alias("documents"))).alias("json")), "repo", "/w")
    paths = g.files.select(F.col("file_id").alias("file_part"), "path")
    return g.edges.join(paths, "file_part").groupBy("path", "kind").agg(F.count("*").alias("n"))


#: Sources of a function a customer, by language: what a file starts with, a function (name, callee), what it ends with.
TEMPLATES = {
    "typescript": ("", "function {m}() {{\n  return {c}(1);\n}}\n", "", ".ts"),
    "rust": ("", "fn {m}() {{\n    {c}(1);\n}}\n", "", ".rs"),
    "go": ("package p\n\n", "func {m}() {{\n\t{c}(1)\n}}\n", "", ".go"),
    "java": ("package p;\n\nclass K {{\n", "  int {m}() {{\n    return {c}(1);\n  }}\n", "}}\n", ".java"),
    "c": ("#include <lib.h>\n", "int {m}(int a) {{\n  return {c}(1);\n}}\n", "", ".c"),
}


def labelled_edges(g: GraphTables):
    """(path, kind, source, target) of edges, by the labels of their ends."""
    labels = g.nodes.select("id", X.label().alias("label")).distinct()
    ends = lambda name, to: labels.select(F.col("id").alias(name), F.col("label").alias(to))
    paths = g.files.select(F.col("file_id").alias("file_part"), "path")
    return g.edges.join(ends("from", "source"), "from").join(ends("to", "target"), "to").join(paths, "file_part").select("path", "kind", "source", "target")


def as_sources(files):
    """(nation, language, path, text) as sources."""
    number = F.col("nation").cast("string")
    return files.select(F.lit("repo").alias("repo_id"), F.concat(F.lit("f"), number).alias("file_id"), "path", "language", X.fingerprint("text").alias("fingerprint"), "text")


def extract_edges(spark, d):
    """Edges of sources in five languages, a file a nation with a function for each of its customers, which calls one of seven."""
    k = F.col("c_custkey").cast("string")
    callee = F.concat(F.lit("call_"), (F.col("c_custkey") % 7).cast("string"))
    language = F.element_at(F.array(*[F.lit(x) for x in TEMPLATES]), (F.col("c_nationkey") % len(TEMPLATES) + 1).cast("int"))
    rows = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", language.alias("language"), k.alias("k"), callee.alias("callee"))

    def by_language(value):
        out = F
        for name, parts in TEMPLATES.items():
            out = out.when(F.col("language") == name, value(parts))
        return out

    def function(parts):
        a, b, c = parts[1].format(m="\x01", c="\x02").replace("\x02", "\x01").split("\x01")
        return F.concat(F.lit(a), F.lit("m"), F.col("k"), F.lit(b), F.col("callee"), F.lit(c))

    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", by_language(function).alias("text")))), lambda x: x["text"]), "")
    files = rows.groupBy("nation", "language").agg(body.alias("body"))
    text = F.concat(by_language(lambda p: F.lit(p[0].format())), "body", by_language(lambda p: F.lit(p[2].format())))
    path = F.concat(F.lit("src/mod"), F.col("nation").cast("string"), by_language(lambda p: F.lit(p[3])))
    return labelled_edges(extract.index(as_sources(files.select("nation", "language", path.alias("path"), text.alias("text")))))


def extract_json(spark, d):
    """Edges of package manifests, one a nation, that depend on its suppliers."""
    listed = F.map_from_entries(F.sort_array(F.collect_set(F.struct("s_name", F.lit("1")))))
    name = F.concat(F.lit("pkg"), F.col("s_nationkey").cast("string"))
    files = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.first(name).alias("name"), listed.alias("dependencies"))).alias("text"))
    path = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/package.json"))
    return labelled_edges(extract.index(as_sources(files.select(F.col("s_nationkey").alias("nation"), F.lit("json").alias("language"), path.alias("path"), "text"))))


def extract_python(spark, d):
    """Symbols of Python sources written from customers: a class a segment with a method each, in the file of a nation."""
    rows = read(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey")
    classes = rows.groupBy("c_nationkey", "c_mktsegment").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: F.concat(F.lit("    def m"), k.cast("string"), F.lit("(self):\n        return call_"), (k % 7).cast("string"), F.lit("(1)\n"))), "").alias("body"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("class "), F.col("c_mktsegment"), F.lit(":\n"), F.col("body")))), "\n")
    files = classes.groupBy("c_nationkey").agg(F.concat(F.lit("import os\n\n"), text, F.lit("\nvalue = 1\n")).alias("text"))
    nation = F.col("c_nationkey").cast("string")
    src = files.select(F.lit("repo").alias("repo_id"), F.concat(F.lit("f"), nation).alias("file_id"), F.concat(F.lit("src/mod"), nation, F.lit(".py")).alias("path"), F.lit("python").alias("language"), X.fingerprint("text").alias("fingerprint"), "text")
    nodes = extract.index(src).nodes
    return nodes.where("kind = 'symbol'").select("file_id", "qualified_name", "symbol_kind")


def debounce_sessions(spark, d):
    s = watch.debounce(read(spark, d, "events"), "30 minutes", "user_id")
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("w.end").cast("timestamp_ntz").alias("ended"), "n")


def coalesce_paths(spark, d):
    return watch.coalesce_paths(read(spark, d, "events").select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 10).cast("string"), F.lit(".py")).alias("path")))


def g(sql: str, more: str = "") -> str:
    return f"WITH RECURSIVE {GRAPH_SQL}{', ' + more if more else ''}\n{sql}"


_SIDE = """SELECT f.{path} AS file, n.language, coalesce(n.symbol_kind, 'unknown') AS kind, arg_max({{own}}, n.ord) AS own,
  CASE WHEN n.symbol_kind = 'module' THEN '$module' WHEN instr(q, '.') > 1 AND instr(q, '.') < length(q) THEN substr(q, instr(q, '.') + 1) ELSE coalesce(name, q) END AS scoped_name
  FROM (SELECT *, coalesce(qualified_name, name, '') AS q, string_split(id, ':')[-1]::BIGINT AS k FROM g_nodes WHERE kind = 'symbol') n JOIN g_files f ON n.file_part = f.file_id WHERE {{where}} GROUP BY 1, 2, 3, 5"""
_OWN = "{'prov': n.provenance, 'conf': " + "{conf}" + ", 'span': [n.byte_start, n.byte_end, n.line, n.col_end], 'name': n.name, 'q': n.qualified_name, 'path': f.path, 'pub': f.partition_pos % 4 = 0 AND (n.name = 'supplier_3' OR n.qualified_name = 'mod.AUTOMOBILE_7')}"


def _side(conf: str, where: str, path: str) -> str:
    own = _OWN.replace("{conf}", conf).replace("f.path", f"f.{path}")
    return _SIDE.replace("{path}", "head_path").replace("{{own}}", own).replace("{{where}}", where).replace("g_files", "d_files")


_DIFF = f"""
d_files AS (SELECT *, CASE WHEN partition_pos % 11 = 0 THEN 'moved/' || path ELSE path END AS head_path FROM g_files),
changes AS (SELECT CASE WHEN partition_pos % 11 = 0 THEN 'renamed' WHEN partition_pos % 5 = 0 THEN 'added' WHEN partition_pos % 7 = 0 THEN 'removed' ELSE 'modified' END AS change,
  CASE WHEN partition_pos % 11 = 0 THEN 'moved/' || path ELSE path END AS path, CASE WHEN partition_pos % 11 = 0 THEN path END AS old_path FROM g_files WHERE partition_pos % 3 <> 1),
renames AS (SELECT old_path FROM changes WHERE change = 'renamed'),
b AS ({_side("n.confidence", "k % 10 <> 0", "path").replace("f.head_path AS file", "CASE WHEN f.path IN (SELECT old_path FROM renames) THEN f.head_path ELSE f.path END AS file")}),
h AS ({_side("CASE WHEN n.k % 7 = 0 THEN 'exact' ELSE n.confidence END", "k % 10 <> 1", "head_path")}),
symbols AS (SELECT *, CASE WHEN pub AND change = 'removed' THEN 'high' WHEN pub OR change = 'removed' THEN 'medium' ELSE 'low' END AS risk FROM (SELECT coalesce(b.own.pub, false) OR coalesce(h.own.pub, false) AS pub, coalesce(h.file, b.file) AS file, coalesce(h.language, b.language) AS language, coalesce(h.kind, b.kind) AS kind, coalesce(h.scoped_name, b.scoped_name) AS scoped_name, b.own AS before, h.own AS after,
  CASE WHEN b.own IS NULL THEN 'added' WHEN h.own IS NULL THEN 'removed' WHEN (b.own.prov, b.own.conf, b.own.span) IS DISTINCT FROM (h.own.prov, h.own.conf, h.own.span) THEN 'modified' END AS change
  FROM b FULL JOIN h ON b.file = h.file AND b.language = h.language AND b.kind = h.kind AND b.scoped_name = h.scoped_name) WHERE change IS NOT NULL),
head_edges AS (SELECT * FROM g_edges WHERE NOT (kind = 'imports' AND id LIKE '%Brand#1%')),
b_last AS (SELECT * FROM g_last WHERE kind <> 'symbol' OR string_split(id, ':')[-1]::BIGINT % 10 <> 0),
h_last AS (SELECT * FROM g_last WHERE kind <> 'symbol' OR string_split(id, ':')[-1]::BIGINT % 10 <> 1),
bdeps AS (SELECT DISTINCT CASE WHEN f.path IN (SELECT old_path FROM renames) THEN f.head_path ELSE f.path END AS file, coalesce(n.qualified_name, n.name) AS dependency, e.kind AS edge_kind FROM g_edges e JOIN b_last n ON n.id = e.dst JOIN d_files f ON f.file_id = e.file_part WHERE e.kind IN ('imports', 'depends-on')),
hdeps AS (SELECT DISTINCT f.head_path AS file, coalesce(n.qualified_name, n.name) AS dependency, e.kind AS edge_kind FROM head_edges e JOIN h_last n ON n.id = e.dst JOIN d_files f ON f.file_id = e.file_part WHERE e.kind IN ('imports', 'depends-on')),
deps AS (SELECT 'removed' AS change, * FROM (SELECT * FROM bdeps EXCEPT SELECT * FROM hdeps) UNION ALL SELECT 'added', * FROM (SELECT * FROM hdeps EXCEPT SELECT * FROM bdeps)),
labels AS (SELECT DISTINCT label FROM (SELECT unnest([before.name, before.q, after.name, after.q]) AS label FROM symbols UNION ALL SELECT dependency FROM deps) WHERE label IS NOT NULL),
verbs AS (SELECT * FROM (VALUES ('calls', 'calls'), ('references', 'references'), ('imports', 'imports'), ('depends-on', 'depends on')) v(kind, verb)),
impact AS (
  SELECT path, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons FROM (
    SELECT path, 'file ' || change AS reason FROM changes
    UNION ALL SELECT coalesce(sf.path, f.path), verb || ' ' || coalesce(n.qualified_name, n.name) FROM g_edges e JOIN verbs USING (kind) JOIN b_last n ON n.id = e.dst AND coalesce(n.qualified_name, n.name) IN (SELECT label FROM labels) LEFT JOIN b_last s ON s.id = e.src LEFT JOIN d_files sf ON sf.file_id = s.file_id LEFT JOIN d_files f ON f.file_id = e.file_part
    UNION ALL SELECT coalesce(sf.head_path, f.head_path), verb || ' ' || coalesce(n.qualified_name, n.name) FROM head_edges e JOIN verbs USING (kind) JOIN h_last n ON n.id = e.dst AND coalesce(n.qualified_name, n.name) IN (SELECT label FROM labels) LEFT JOIN h_last s ON s.id = e.src LEFT JOIN d_files sf ON sf.file_id = s.file_id LEFT JOIN d_files f ON f.file_id = e.file_part)
  GROUP BY path),
diags AS (SELECT 'base' AS side, severity, message, f.path AS file FROM g_diagnostics d LEFT JOIN d_files f ON d.file_id = f.file_id UNION ALL SELECT 'head', severity, message, f.head_path FROM g_diagnostics d LEFT JOIN d_files f ON d.file_id = f.file_id),
scored AS (SELECT coalesce(after.q, after.name, before.q, before.name) AS symbol, coalesce(after.path, before.path) AS path, change, pub, risk,
  CASE risk WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 1 END + CASE WHEN pub THEN 10 ELSE 0 END + CASE change WHEN 'removed' THEN 8 WHEN 'added' THEN 5 ELSE 3 END AS score FROM symbols WHERE change IN ('added', 'removed') OR pub),
signals AS (
  SELECT path, CASE change WHEN 'removed' THEN 12 WHEN 'added' THEN 8 WHEN 'renamed' THEN 8 ELSE 2 END AS score, CASE change WHEN 'removed' THEN 20 ELSE 10 END AS risk, 1 AS seq, change || '-file' AS kind, NULL AS symbol,
    CASE change WHEN 'renamed' THEN 'file renamed from ' || old_path WHEN 'removed' THEN 'file removed' WHEN 'added' THEN 'new file added' ELSE 'file changed' END AS reason FROM changes
  UNION ALL SELECT path, score, CASE risk WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 1 END, 0, NULL, symbol, CASE WHEN pub THEN 'public API changed' WHEN change = 'removed' THEN 'symbol removed' ELSE 'new symbol added' END FROM scored
  UNION ALL SELECT file, 8, 10, 2, change || '-dependency', NULL, 'dependency surface changed' FROM deps),
signals2 AS (SELECT * FROM signals UNION ALL SELECT file, 6, 10, 0, NULL, NULL, 'changed file has parser or indexing diagnostics' FROM diags WHERE file IN (SELECT path FROM signals)),
top AS (
  SELECT path, sum(score)::BIGINT AS score, CASE max(risk) WHEN 20 THEN 'high' WHEN 10 THEN 'medium' ELSE 'low' END AS risk, coalesce(arg_max(kind, (seq, kind)) FILTER (WHERE kind IS NOT NULL), 'changed-file') AS kind,
    CASE count(DISTINCT symbol) WHEN 0 THEN NULL WHEN 1 THEN min(symbol) ELSE min(symbol) || ' (+' || (count(DISTINCT symbol) - 1) || ' more)' END AS symbol, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS why_it_matters
  FROM signals2 GROUP BY path ORDER BY score DESC, path LIMIT 8),
focus AS (
  SELECT path, (CASE risk WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 1 END) + 3 AS score, unnest(string_split(why_it_matters, '; ')) AS reason, 'top' AS part FROM top
  UNION ALL SELECT path, score, reason, 'file' FROM signals WHERE seq = 1
  UNION ALL SELECT path, 1, 'impacted by changed graph facts', 'impact' FROM impact WHERE path IN (SELECT path FROM changes))
"""
QUERIES = {
    "q_diff_symbols": (diff_symbols, g("SELECT file, language, kind, scoped_name, change, risk, CASE change WHEN 'modified' THEN 'symbol body or span changed' ELSE 'symbol ' || change END AS reason FROM symbols", _DIFF)),
    "q_diff_deps": (diff_deps, g("SELECT * FROM deps", _DIFF)),
    "q_diff_impact": (diff_impact, g("SELECT * FROM impact", _DIFF)),
    "q_diff_stats": (diff_stats, g(
        "SELECT (SELECT count(*) FROM changes WHERE change = 'added') AS files_added, (SELECT count(*) FROM changes WHERE change = 'removed') AS files_removed, (SELECT count(*) FROM changes WHERE change = 'modified') AS files_modified, (SELECT count(*) FROM changes WHERE change = 'renamed') AS files_renamed, "
        "(SELECT count(*) FROM symbols WHERE change = 'added') AS symbols_added, (SELECT count(*) FROM symbols WHERE change = 'removed') AS symbols_removed, (SELECT count(*) FROM symbols WHERE change = 'modified') AS symbols_modified, (SELECT count(*) FROM symbols WHERE pub) AS public_api_changes, "
        "(SELECT count(*) FROM deps) AS dependency_changes, (SELECT count(*) FROM impact) AS impacted_files, (SELECT count(*) FROM diags) AS diagnostics, (SELECT count(*) FROM g_files) AS base_indexed_files, (SELECT count(*) FROM g_files) AS head_indexed_files", _DIFF)),
    "q_diff_diagnostics": (diff_diagnostics, g("SELECT * FROM diags", _DIFF)),
    "q_agent_important": (agent_important, g("SELECT symbol, path, change, score::BIGINT AS score FROM scored", _DIFF)),
    "q_agent_top8": (agent_top8, g("SELECT * FROM top", _DIFF)),
    "q_agent_focus8": (agent_focus8, g("SELECT p.path, p.score::BIGINT AS score, string_agg(DISTINCT f.reason, '; ' ORDER BY f.reason) AS reason FROM (SELECT path, sum(score) AS score FROM (SELECT DISTINCT path, score, part FROM focus) GROUP BY path ORDER BY score DESC, path LIMIT 8) p JOIN focus f USING (path) GROUP BY p.path, p.score", _DIFF)),
    "q_agent_risk": (agent_risk, g(
        "SELECT (SELECT count(*) FROM changes) AS files_changed, false AS tests_changed, (SELECT count(*) FROM symbols WHERE pub) AS public_api_changes, (SELECT count(*) FROM scored) AS important_symbol_changes, (SELECT count(*) FROM deps) AS dependency_changes, (SELECT count(*) FROM diags WHERE file IN (SELECT path FROM changes)) AS diagnostics, "
        "CASE WHEN EXISTS (SELECT 1 FROM changes WHERE change = 'removed') OR EXISTS (SELECT 1 FROM symbols WHERE pub AND risk = 'high') THEN 'high' ELSE 'medium' END AS risk, 'No test files changed; verify existing coverage exercises this diff.' || CASE WHEN (SELECT count(*) FROM symbols) > 20 + (SELECT count(*) FROM symbols WHERE pub) THEN ' | Raw symbol diff is broad; prefer top_changes and review_focus for agent triage.' ELSE '' END "
        "|| CASE WHEN EXISTS (SELECT 1 FROM diags WHERE file IN (SELECT path FROM changes)) THEN ' | Changed files have parser or indexing diagnostics; inspect diagnostics before trusting impact.' ELSE '' END AS notes", _DIFF)),
    "q_public_api": (public_api, "WITH {code} SELECT o_orderkey, t <> '' AND regexp_matches(t, '^(pub |pub\\(|export )') AS public FROM code"),
    "q_export_jsonl": (export_jsonl, g("SELECT 'partition' AS type, count(*) AS n, count(*) AS partitions FROM g_files UNION ALL SELECT 'node', count(*), count(DISTINCT file_part) FROM g_nodes UNION ALL SELECT 'edge', count(*), count(DISTINCT file_part) FROM g_edges UNION ALL SELECT 'diagnostic', count(*), count(DISTINCT file_part) FROM g_diagnostics HAVING count(*) > 0")),
    "q_export_symbols": (export_symbols, g("SELECT coalesce(file_id, '') AS path, name, qualified_name, 'symbol' AS kind FROM g_nodes WHERE symbol_kind IS NOT NULL")),
    "q_export_scip": (export_scip, g("SELECT f.path AS relative_path, count(n.id) AS n, string_agg(n.id, ',' ORDER BY n.id) AS ids FROM g_files f JOIN g_nodes n ON n.file_part = f.file_id AND n.symbol_kind IS NOT NULL GROUP BY f.path")),
    "q_export_lsif": (export_lsif, g("SELECT row_number() OVER (ORDER BY partition_pos, section, ord) AS id, label, uri, symbol FROM (SELECT partition_pos, 0 AS section, 0 AS ord, 'document' AS label, path AS uri, NULL AS symbol FROM g_files UNION ALL SELECT partition_pos, 1, ord, 'resultSet', NULL, qualified_name FROM g_nodes JOIN g_files ON file_part = g_files.file_id WHERE symbol_kind IS NOT NULL)")),
    "q_import_jsonl_roundtrip": (import_roundtrip, g(
        "SELECT 'file' AS record, file_id AS file_part, '' AS id, path AS a, language AS b, fingerprint AS c, partition_pos AS n, parse_time_micros AS m FROM g_files "
        "UNION ALL SELECT 'node', file_part, id, concat_ws('|', kind, language, name, qualified_name, symbol_kind), file_id, provenance || '|' || confidence, byte_end, col_end FROM g_nodes "
        "UNION ALL SELECT 'edge', file_part, id, kind, src, dst, NULL, NULL FROM g_edges UNION ALL SELECT 'diagnostic', file_part, NULL, severity, message, file_id, NULL, NULL FROM g_diagnostics")),
    "q_scip_import": (scip_import, "SELECT 'n' || s_nationkey || '.py' AS path, 'm' AS name, s_suppkey + 1 AS line, 10::BIGINT AS col_end, 'scip' AS provenance, CASE WHEN s_suppkey % 3 = 1 THEN 'defines' ELSE 'references' END AS edge FROM supplier"),
    "q_lsp_import": (lsp_import, "SELECT '/w/n' || s_nationkey AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'defines' ELSE 'references' END AS kind, count(*) AS n FROM supplier GROUP BY 1, 2"),
    "q_extract_python": (extract_python, "SELECT 'f' || c_nationkey AS file_id, 'mod' || c_nationkey || '.' || c_mktsegment || '.m' || c_custkey AS qualified_name, 'method' AS symbol_kind FROM customer UNION ALL SELECT DISTINCT 'f' || c_nationkey, 'mod' || c_nationkey || '.' || c_mktsegment, 'class' FROM customer UNION ALL SELECT DISTINCT 'f' || c_nationkey, 'mod' || c_nationkey, 'module' FROM customer UNION ALL SELECT DISTINCT 'f' || c_nationkey, 'mod' || c_nationkey || '.value', 'variable' FROM customer"),
    "q_extract_edges": (extract_edges, """
        WITH c AS (SELECT c_nationkey % 5 AS l, 'src/mod' || c_nationkey || ['.ts', '.rs', '.go', '.java', '.c'][c_nationkey % 5 + 1] AS path, 'mod' || c_nationkey AS stem, 'm' || c_custkey AS m, 'call_' || c_custkey % 7 AS callee FROM customer),
        q AS (SELECT *, CASE l WHEN 0 THEN stem || '.' || m WHEN 1 THEN stem || '::' || m WHEN 2 THEN 'p.' || m WHEN 3 THEN 'p.K.' || m ELSE m END AS name FROM c)
        SELECT path, 'calls' AS kind, name AS source, callee AS target FROM q UNION ALL SELECT path, 'defines', path, name FROM q
        UNION ALL SELECT DISTINCT path, 'defines', path, CASE WHEN l < 2 THEN stem ELSE 'p' END FROM q WHERE l < 4 UNION ALL SELECT DISTINCT path, 'defines', path, 'p.K' FROM q WHERE l = 3
        UNION ALL SELECT DISTINCT path, 'contains', path, 'lib.h' FROM q WHERE l = 4 UNION ALL SELECT DISTINCT path, 'imports', 'lib.h', 'lib.h' FROM q WHERE l = 4"""),
    "q_extract_json": (extract_json, """
        WITH s AS (SELECT DISTINCT 'n' || s_nationkey || '/package.json' AS path, 'pkg' || s_nationkey AS pkg, s_name FROM supplier)
        SELECT DISTINCT path, 'defines' AS kind, path AS source, 'package.json' AS target FROM s UNION ALL SELECT DISTINCT path, 'defines', path, pkg FROM s
        UNION ALL SELECT path, 'contains', path, s_name FROM s UNION ALL SELECT path, 'imports', s_name, s_name FROM s UNION ALL SELECT path, 'depends-on', 'package.json', s_name FROM s"""),
    "q_debounce_sessions": (debounce_sessions, "SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s"),
    "q_coalesce_paths": (coalesce_paths, "SELECT DISTINCT event_type || '/' || user_id % 10 || '.py' AS path FROM events"),
}


def _finish() -> None:
    from .text import CODE_SQL

    fn, sql = QUERIES["q_public_api"]
    QUERIES["q_public_api"] = (fn, sql.replace("{code}", CODE_SQL))


_finish()
