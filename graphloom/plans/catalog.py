"""Queries over the graph projection of the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import review, text
from .. import schema
from ..functions import expr as X
from ..operators import incremental, integrity
from ..operators.query import GraphQuery
from ..operators.tables import adjacency, best_facts, first_symbols, last_nodes, latest, replace_partitions, resolve_local, shared_folder
from ..sources.store import GraphStore
from .projection import GRAPH_SQL, file_number, graph, read

WANTED = ["supplier_3", "mod.supplier_5", "mod.BUILDING_1", "BUILDING_7", "AUTOMOBILE_7", "MACHINERY_7", "HOUSEHOLD_7", "FURNITURE_7"]
_WANTED = "('" + "', '".join(WANTED) + "')"
FLAT = ["id", "kind", "language", "name", "qualified_name", "symbol_kind", "file_id", "provenance", "confidence"]
Query = Callable[[SparkSession, str], DataFrame]


def stored(spark: SparkSession, d: str) -> GraphStore:
    """A store of the graph, with its projections."""
    store = GraphStore(spark, f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}")
    store.replace_all(graph(spark, d))
    return store


def _q(spark: SparkSession, d: str) -> GraphQuery:
    return GraphQuery(graph(spark, d))


def symbols_all(spark, d):
    return _q(spark, d).symbols().select(*FLAT)


def lookup_symbols(spark, d):
    return _q(spark, d).lookup_symbols(symbol_kind="class").select(*FLAT)


def matching_symbols(spark, d):
    return _q(spark, d).matching_symbols("supplier_3").select(*FLAT)


def callers(spark, d):
    return _q(spark, d).callers(WANTED).select("wanted", "target_id", "id", "name", "file_id")


def callees(spark, d):
    return _q(spark, d).callees(WANTED).select("wanted", "edge_id", "id", "name", "file_id")


def refs(spark, d):
    return _q(spark, d).references(WANTED).select("wanted", "target_id", "id", "name", "file_id")


def file_deps(spark, d):
    q = _q(spark, d)
    return q.file_dependencies(q.tables.files.select("path"))


def packages(spark, d):
    return _q(spark, d).package_dependencies()


def impact(spark, d):
    q = _q(spark, d)
    return q.impact_from_files(q.tables.files.where("partition_pos % 12 = 1").select("path"))


def deps_tree(spark, d):
    q = _q(spark, d)
    starts = q.tables.nodes.where("kind = 'symbol' and name = 'BUILDING_7'").select(F.col("id").alias("start_id"))
    return q.traverse_dependencies(starts, 3).select("start_id", "id", F.col("depth").cast("long").alias("depth"), "name")


def adjacency_degree(spark, d):
    return adjacency(graph(spark, d).edges)


def best_fact(spark, d):
    return best_facts(last_nodes(graph(spark, d))).select(*FLAT)


def node_last_wins(spark, d):
    return last_nodes(graph(spark, d)).select("file_part", "ord", "id", "kind")


def _local(spark, d):
    """Suppliers call by name whatever customer their number names, through an external symbol in their file."""
    g = graph(spark, d)
    s = F.col("s_suppkey")
    part = F.concat(F.lit("file:"), file_number(F.col("s_nationkey"), s).cast("string"))
    known = F.concat(F.lit("BUILDING_"), (s % 40).cast("string"))
    external = read(spark, d, "supplier").select(
        part.alias("file_part"), (s + 5_000_000).alias("ord"), F.concat(F.lit("node:ext:"), known).alias("id"), F.lit("external-symbol").alias("kind"), F.lit("unknown").alias("language"),
        known.alias("name"), F.lit(None).cast("string").alias("qualified_name"), F.lit("unknown").alias("symbol_kind"), F.lit(None).cast("string").alias("file_id"),
        F.lit(None).cast(schema.SPAN).alias("span"), F.lit("structural-scanner").alias("provenance"), F.lit("medium").alias("confidence"),
    )
    source, target = F.concat(F.lit("node:supp:"), s.cast("string")), F.concat(F.lit("node:ext:"), known)
    edges = read(spark, d, "supplier").select(
        part.alias("file_part"), s.alias("ord"), X.edge_id(F.lit("calls"), source, target, F.lit(None).cast(schema.SPAN)).alias("id"), F.lit("calls").alias("kind"), source.alias("from"), target.alias("to"),
        F.lit(None).cast(schema.SPAN).alias("span"), F.lit("structural-scanner").alias("provenance"), F.lit("medium").alias("confidence"),
    )
    return g.nodes.unionByName(external), edges


def local_resolve(spark, d):
    return resolve_local(*_local(spark, d)).select("file_part", "id", "from", "to")


def first_symbol_by_name(spark, d):
    return first_symbols(graph(spark, d).nodes).select("file_part", "known", F.col("local").alias("id"))


def latest_partition(spark, d):
    return latest(read(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


def replace_partition(spark, d):
    g = graph(spark, d)
    changed = g.only(g.files.where("partition_pos % 4 = 0").select("file_id"))
    changed = type(g)(changed.files.withColumn("fingerprint", F.sha2(F.concat("fingerprint", F.lit("!")), 256)), changed.nodes.where("kind = 'symbol'"), changed.edges)
    after = replace_partitions(type(g)(g.files, g.nodes, g.edges), changed)
    n = after.nodes.groupBy(F.col("file_part").alias("file_id")).agg(F.count("*").alias("n_nodes"))
    return after.files.select("file_id", "path", "fingerprint").join(n, "file_id", "left")


def incremental_plan(spark, d):
    g = graph(spark, d)
    changed = g.files.where("partition_pos in (1, 3)").select(F.concat(F.lit("lib/Brand#"), (F.col("partition_pos") + 10).cast("string"), F.lit(".py")).alias("path")).unionByName(g.files.where("partition_pos = 3").select("path"))
    return stored(spark, d).plan_reindex(changed)


def reverse_deps_index(spark, d):
    store = stored(spark, d)
    return spark.read.parquet(f"{store.root}/{store._read_pointer()['base']}/stems").select("stem", "path", F.col("stem_shard").cast("long").alias("stem_shard"))


def symbol_index_shard(spark, d):
    return stored(spark, d).lookup_symbol("supplier_3").select("id", "name", "file_id", X.shard("name").cast("long").alias("name_shard"))


def manifest_check(spark, d):
    g = graph(spark, d)
    pos = F.col("partition_pos")
    manifest = g.files.select("file_id", F.when(pos % 5 == 1, F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"), F.when(pos % 7 == 2, F.lit("")).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return integrity.manifest_check(manifest, g.files.where("partition_pos % 6 <> 0"))


def index_summary(spark, d):
    return incremental.index_summary(graph(spark, d))


def language_counts(spark, d):
    return incremental.language_counts(graph(spark, d).files)


def integrity_symbols(spark, d):
    return integrity.symbols_without_file(graph(spark, d).nodes)


def integrity_edges(spark, d):
    g = graph(spark, d)
    return integrity.dangling_edges(g.nodes.where("id not like '%7'"), g.edges)


def integrity_spans(spark, d):
    return integrity.invalid_spans(graph(spark, d).nodes, "node")


def integrity_foreign(spark, d):
    g = graph(spark, d)
    moved = g.nodes.withColumn("file_part", F.when(F.col("ord") % 13 == 0, "file:0").otherwise(F.col("file_part")))
    return integrity.foreign_nodes(moved)


def neighbours(spark, d):
    q = _q(spark, d)
    return q.neighbours(q.by_id.where("name = 'supplier_3'"), "references").select("id", "from", "to")


def fact_score(spark, d):
    return graph(spark, d).nodes.where("kind = 'symbol'").select("id", X.fact_score("provenance", "confidence").cast("long").alias("score"))


def scoped_name(spark, d):
    nodes = graph(spark, d).nodes
    return nodes.select("file_part", "id", X.scoped_name(F.when(F.col("ord") % 10 == 0, "module").otherwise(F.col("symbol_kind")), "qualified_name", "name").alias("scoped_name"))


def det_id(spark, d):
    orders = read(spark, d, "orders")
    return orders.select("o_orderkey", X.det_id("node", "o_orderstatus", "o_orderpriority", "o_custkey").alias("id"))


_S = lambda cols: ", ".join(cols)
_NAMED = f"names AS (SELECT DISTINCT w AS wanted, id FROM g_last, (SELECT unnest([{', '.join(repr(w) for w in WANTED)}]) AS w) WHERE name = w OR qualified_name = w)"
_SCORE = f"list_position({schema.PROVENANCES}, provenance) * 10 + list_position({schema.CONFIDENCES}, confidence)"
_BEST = f"row_number() OVER (PARTITION BY file_id, name, qualified_name, symbol_kind ORDER BY {_SCORE} DESC, id) = 1"


def g(sql: str, more: str = "") -> str:
    return f"WITH RECURSIVE {GRAPH_SQL}{', ' + more if more else ''}\n{sql}"


STEM = r"nullif(regexp_replace(regexp_replace(regexp_replace(string_split({x}, '/')[-1], '\.js$', ''), '\.ts$', ''), '\.py$', ''), '')"
SHARD = "('0x' || substr(sha256({x}), 1, 2))::BIGINT"
_IMPORTS = f"imports AS (SELECT DISTINCT {STEM.format(x='coalesce(n.qualified_name, n.name)')} AS stem, f.path FROM g_nodes n JOIN g_files f ON n.file_part = f.file_id WHERE n.kind = 'import')"

QUERIES: dict[str, tuple[Query, str]] = {
    "q_symbols_all": (symbols_all, g(f"SELECT {_S(FLAT)} FROM g_last WHERE kind = 'symbol'")),
    "q_lookup_symbols": (lookup_symbols, g(f"SELECT {_S(FLAT)} FROM g_last WHERE kind = 'symbol' AND symbol_kind = 'class' QUALIFY {_BEST}")),
    "q_matching_symbols": (matching_symbols, g(f"SELECT {_S(FLAT)} FROM g_last WHERE kind = 'symbol' AND (name = 'supplier_3' OR qualified_name = 'supplier_3')")),
    "q_callers": (callers, g("SELECT t.wanted, t.id AS target_id, s.id, s.name, s.file_id FROM names t JOIN g_edges e ON e.dst = t.id AND e.kind = 'calls' JOIN g_last s ON s.id = e.src", _NAMED)),
    "q_callees": (callees, g("SELECT t.wanted, e.id AS edge_id, s.id, s.name, s.file_id FROM names t JOIN g_last n ON n.id = t.id AND n.kind = 'symbol' JOIN g_edges e ON e.src = t.id AND e.kind = 'calls' JOIN g_last s ON s.id = e.dst", _NAMED)),
    "q_refs": (refs, g("SELECT t.wanted, t.id AS target_id, s.id, s.name, s.file_id FROM names t JOIN g_edges e ON e.dst = t.id AND e.kind = 'references' JOIN g_last s ON s.id = e.src", _NAMED)),
    "q_file_deps": (file_deps, g("SELECT DISTINCT f.path, coalesce(n.qualified_name, n.name) AS label FROM g_files f JOIN g_edges e ON e.file_part = f.file_id AND e.kind IN ('imports', 'depends-on') JOIN g_last n ON n.id = e.dst")),
    "q_packages": (packages, g("SELECT DISTINCT name FROM g_nodes WHERE kind = 'package'")),
    "q_impact": (impact, g("SELECT path FROM g_files WHERE partition_pos % 12 = 1 UNION SELECT f.path FROM g_edges e JOIN g_last n ON n.id = e.dst JOIN g_files c ON c.file_id = n.file_id AND c.partition_pos % 12 = 1 JOIN g_files f ON f.file_id = e.file_part WHERE e.kind IN ('imports', 'depends-on')")),
    "q_deps_tree": (deps_tree, g("SELECT w.start_id, w.id, min(w.depth)::BIGINT AS depth, any_value(n.name) AS name FROM walk w JOIN g_last n ON n.id = w.id WHERE w.depth > 0 GROUP BY w.start_id, w.id", "walk AS (SELECT id AS start_id, id, 0 AS depth FROM g_last WHERE kind = 'symbol' AND name = 'BUILDING_7' UNION ALL SELECT start_id, e.dst, depth + 1 FROM walk JOIN g_edges e ON e.src = walk.id AND e.kind = 'depends-on' WHERE depth < 3)")),
    "q_adjacency_degree": (adjacency_degree, g("SELECT id, kind, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, kind, 1 AS o, 0 AS i FROM g_edges UNION ALL SELECT dst, kind, 0, 1 FROM g_edges) GROUP BY id, kind")),
    "q_best_fact": (best_fact, g(f"SELECT {_S(FLAT)} FROM g_last WHERE kind = 'symbol' QUALIFY {_BEST}")),
    "q_node_last_wins": (node_last_wins, g("SELECT file_part, ord, id, kind FROM g_last")),
    "q_local_resolve": (local_resolve, g(
        "SELECT e.file_part, CASE WHEN f.id IS NULL THEN 'edge:' || substr(sha256('calls' || chr(0) || e.src || chr(0) || e.dst || chr(0) || chr(0)), 1, 24) ELSE 'edge:' || substr(sha256('calls' || chr(0) || e.src || chr(0) || f.id || chr(0) || chr(0)), 1, 24) END AS id, "
        "e.src AS \"from\", coalesce(f.id, e.dst) AS \"to\" FROM (SELECT 'file:' || (s_nationkey + 25 * (s_suppkey // 500)) AS file_part, 'node:supp:' || s_suppkey AS src, 'node:ext:BUILDING_' || s_suppkey % 40 AS dst, 'BUILDING_' || s_suppkey % 40 AS known FROM supplier) e "
        "LEFT JOIN (SELECT file_part, known, arg_min(id, ord) AS id FROM (SELECT file_part, id, ord, name AS known FROM g_nodes WHERE kind = 'symbol' UNION ALL SELECT file_part, id, ord, qualified_name FROM g_nodes WHERE kind = 'symbol') GROUP BY 1, 2) f USING (file_part, known)")),
    "q_first_symbol_by_name": (first_symbol_by_name, g("SELECT file_part, known, arg_min(id, ord) AS id FROM (SELECT file_part, id, ord, name AS known FROM g_nodes WHERE kind = 'symbol' UNION ALL SELECT file_part, id, ord, qualified_name FROM g_nodes WHERE kind = 'symbol') GROUP BY 1, 2")),
    "q_latest_partition": (latest_partition, "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "q_replace_partition": (replace_partition, g("SELECT f.file_id, f.path, CASE WHEN f.partition_pos % 4 = 0 THEN sha256(f.fingerprint || '!') ELSE f.fingerprint END AS fingerprint, count(n.id) AS n_nodes FROM g_files f LEFT JOIN g_nodes n ON n.file_part = f.file_id AND (f.partition_pos % 4 <> 0 OR n.kind = 'symbol') GROUP BY f.file_id, f.path, f.fingerprint, f.partition_pos")),
    "q_incremental_plan": (incremental_plan, g(
        r"SELECT path, 'changed' AS reason FROM changed UNION ALL SELECT DISTINCT i.path, 'reverse-dependency' FROM imports i JOIN changed c ON i.stem = regexp_replace(string_split(c.path, '/')[-1], '(.)\.[^.]*$', '\1') WHERE i.path NOT IN (SELECT path FROM changed)",
        _IMPORTS + ", changed AS (SELECT 'lib/Brand#' || (partition_pos + 10) || '.py' AS path FROM g_files WHERE partition_pos IN (1, 3) UNION SELECT path FROM g_files WHERE partition_pos = 3)")),
    "q_reverse_deps_index": (reverse_deps_index, g(f"SELECT stem, path, {SHARD.format(x='stem')} AS stem_shard FROM imports", _IMPORTS)),
    "q_symbol_index_shard": (symbol_index_shard, g(f"SELECT id, name, file_id, {SHARD.format(x='name')} AS name_shard FROM g_last WHERE kind = 'symbol' AND name = 'supplier_3' QUALIFY {_BEST}")),
    "q_manifest_check": (manifest_check, g(
        "SELECT unnest(list_filter([CASE WHEN s.file_id IS NULL THEN 'missing partition of ' || m.file_id END, CASE WHEN s.file_id IS NOT NULL AND m.p <> s.path THEN 'path mismatch of ' || m.file_id END, "
        "CASE WHEN s.file_id IS NOT NULL AND m.fp <> s.fingerprint THEN 'fingerprint mismatch of ' || m.file_id END], lambda x: x IS NOT NULL)) AS problem FROM "
        "(SELECT file_id, CASE WHEN partition_pos % 5 = 1 THEN path || 'x' ELSE path END AS p, CASE WHEN partition_pos % 7 = 2 THEN '' ELSE fingerprint END AS fp FROM g_files) m LEFT JOIN (SELECT * FROM g_files WHERE partition_pos % 6 <> 0) s USING (file_id)")),
    "q_index_summary": (index_summary, g(
        "SELECT count(*) AS files, sum(parse_time_micros)::BIGINT AS parse_time_micros, sum(extraction_time_micros)::BIGINT AS extraction_time_micros, coalesce(sum(n), 0)::BIGINT AS nodes, coalesce(sum(e), 0)::BIGINT AS edges, coalesce(sum(d), 0)::BIGINT AS diagnostics, "
        "max(n)::BIGINT AS max_nodes_per_file, max(e)::BIGINT AS max_edges_per_file FROM g_files f LEFT JOIN (SELECT file_part, count(*) AS n FROM g_nodes GROUP BY 1) a ON a.file_part = f.file_id LEFT JOIN (SELECT file_part, count(*) AS e FROM g_edges GROUP BY 1) b ON b.file_part = f.file_id "
        "LEFT JOIN (SELECT file_part, count(*) AS d FROM g_diagnostics GROUP BY 1) c ON c.file_part = f.file_id")),
    "q_language_counts": (language_counts, g("SELECT language, count(*) AS files FROM g_files GROUP BY language")),
    "q_integrity_symbols": (integrity_symbols, g("SELECT 'symbol ' || id || ' has no file' AS problem FROM g_nodes WHERE kind = 'symbol' AND file_id IS NULL")),
    "q_integrity_edges": (integrity_edges, g(
        "SELECT 'edge ' || id || ' has no source ' || src AS problem FROM g_edges WHERE src NOT IN (SELECT id FROM known) UNION ALL SELECT 'edge ' || id || ' has no target ' || dst FROM g_edges WHERE kind <> 'depends-on' AND dst NOT IN (SELECT id FROM known)",
        "known AS (SELECT DISTINCT id FROM g_nodes WHERE id NOT LIKE '%7')")),
    "q_integrity_spans": (integrity_spans, g(
        "SELECT 'node ' || id || ' has an invalid ' || k || ' span' AS problem FROM (SELECT id, CASE WHEN byte_start > byte_end THEN 'byte' ELSE 'line/column' END AS k FROM g_nodes WHERE byte_start IS NOT NULL AND (byte_start > byte_end OR 1 > col_end))")),
    "q_integrity_foreign": (integrity_foreign, g("SELECT 'node ' || id || ' is stored in ' || p AS problem FROM (SELECT id, file_id, CASE WHEN ord % 13 = 0 THEN 'file:0' ELSE file_part END AS p FROM g_nodes) WHERE file_id IS NOT NULL AND file_id <> p")),
    "q_neighbours": (neighbours, g("SELECT e.id, e.src AS \"from\", e.dst AS \"to\" FROM g_edges e WHERE e.kind = 'references' AND e.src IN (SELECT id FROM g_last WHERE name = 'supplier_3')")),
    "q_fact_score": (fact_score, g(f"SELECT id, ({_SCORE})::BIGINT AS score FROM g_nodes WHERE kind = 'symbol'")),
    "q_scoped_name": (scoped_name, g(
        "SELECT file_part, id, CASE WHEN ord % 10 = 0 THEN '$module' WHEN instr(q, '.') > 1 AND instr(q, '.') < length(q) THEN substr(q, instr(q, '.') + 1) ELSE coalesce(name, q) END AS scoped_name FROM (SELECT *, coalesce(qualified_name, name, '') AS q FROM g_nodes)")),
    "q_det_id": (det_id, "SELECT o_orderkey, 'node:' || substr(sha256(o_orderstatus || chr(0) || o_orderpriority || chr(0) || o_custkey || chr(0)), 1, 24) AS id FROM orders"),
}


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in (QUERIES | text.QUERIES | review.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in (QUERIES | text.QUERIES | review.QUERIES).items() if v[1]}
