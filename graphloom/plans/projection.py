"""A graph of code projected from the driver's tables, in DataFrame operations and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.tables import GraphTables


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], number) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


def span(start, length, line) -> F.Column:
    long = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")
    point = lambda column: F.struct(long(line).alias("line"), long(column).alias("column"))
    return F.struct(long(start).alias("byte_start"), (long(start) + long(length)).alias("byte_end"), point(1).alias("start"), point(length + 1 if not isinstance(length, int) else length + 1).alias("end"))


ENDS = [".py", ".ts", ".rs", ".go", ".java"]
LANGS = ["python", "typescript", "rust", "go", "java"]


#: Customers or suppliers of a nation that stand in one file, by their keys; a nation has more files the more there are.
FILE = 500
NATIONS = 25


def file_number(nation: F.Column, key: F.Column) -> F.Column:
    return (nation + NATIONS * F.floor(key / FILE)).cast("long")


def graph(spark: SparkSession, sf_dir: str) -> GraphTables:
    """Files are parts of nations; symbols are customers and suppliers, who call and import by all lines of orders."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    customer, supplier = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    part, orders = read(spark, sf_dir, "part"), read(spark, sf_dir, "orders")
    line = read(spark, sf_dir, "lineitem")
    n = F.col("n_nationkey")
    owners = lambda df, nation_key, key: df.select(F.col(nation_key).alias("nation"), F.floor(F.col(key) / FILE).alias("part"))
    parts = owners(customer, "c_nationkey", "c_custkey").unionByName(owners(supplier, "s_nationkey", "s_suppkey")).unionByName(nation.select(n.alias("nation"), F.lit(0).cast("long").alias("part"))).distinct()
    number, folder = (n + NATIONS * F.col("part")).cast("long"), F.when(F.col("part") > 0, F.concat(F.lit("/part"), F.col("part").cast("string"))).otherwise("")
    files = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(parts, n == F.col("nation")).select(
        F.concat(F.lit("file:"), number.cast("string")).alias("file_id"),
        F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name"), folder, pick(ENDS, n % 5)).alias("path"),
        pick(LANGS, n % 5).alias("language"),
        F.sha2(F.concat(F.lit("text of "), F.col("n_name"), folder), 256).alias("fingerprint"),
        (number * 10).alias("parse_time_micros"), (number * 10 + 5).alias("extraction_time_micros"), number.alias("partition_pos"),
    )

    def file_of(nation_key: str, key: str | None = None) -> F.Column:
        at = file_number(F.col(nation_key), F.col(key)) if key else F.col(nation_key)
        return F.concat(F.lit("file:"), at.cast("string"))

    def symbols(df: DataFrame, key: str, nation_key: str, tag: str, name, kind, base: int) -> DataFrame:
        k = F.col(key)
        return df.select(
            file_of(nation_key, key).alias("file_part"), (k + base).cast("long").alias("ord"), F.concat(F.lit(f"node:{tag}:"), k.cast("string")).alias("id"),
            F.lit("symbol").alias("kind"), pick(LANGS, F.col(nation_key) % 5).alias("language"), name.alias("name"), F.concat(F.lit("mod."), name).alias("qualified_name"),
            kind.alias("symbol_kind"), F.when(k % 89 != 0, file_of(nation_key, key)).alias("file_id"),
            span(k * 20, F.when(k % 97 == 0, -3).otherwise(k % 17), k % 500 + 1).alias("span"),
            pick(schema.PROVENANCES, k % 6).alias("provenance"), pick(schema.CONFIDENCES, k % 4).alias("confidence"),
        )

    c, s = F.col("c_custkey"), F.col("s_suppkey")
    cust = symbols(customer, "c_custkey", "c_nationkey", "cust", F.concat(F.col("c_mktsegment"), F.lit("_"), (c % 40).cast("string")), pick(["function", "method", "class"], c % 3), 0)
    supp = symbols(supplier, "s_suppkey", "s_nationkey", "supp", F.concat(F.lit("supplier_"), (s % 10).cast("string")), F.lit("class"), 1_000_000)
    brands = line.join(supplier, F.col("l_suppkey") == s).join(part, F.col("l_partkey") == F.col("p_partkey")).select("s_nationkey", "p_brand").distinct()
    number = F.substring_index("p_brand", "#", -1).cast("long")

    def outside(tag: str, kind: str, base: int, qualified, file_id) -> DataFrame:
        own = F.concat(F.lit(f"node:{tag}:"), *([F.col("s_nationkey").cast("string"), F.lit(":")] if tag == "imp" else []), F.col("p_brand"))
        return brands.select(
            file_of("s_nationkey").alias("file_part"), (number + base).alias("ord"), own.alias("id"), F.lit(kind).alias("kind"),
            (pick(LANGS, F.col("s_nationkey") % 5) if tag == "imp" else F.lit("unknown")).alias("language"), F.col("p_brand").alias("name"), qualified.alias("qualified_name"),
            F.lit(None).cast("string").alias("symbol_kind"), file_id.alias("file_id"), F.lit(None).cast(schema.SPAN).alias("span"),
            F.lit("structural-scanner").alias("provenance"), F.lit("medium").alias("confidence"),
        )

    none = F.lit(None).cast("string")
    imports = outside("imp", "import", 2_000_000, F.concat(F.lit("lib/"), F.col("p_brand"), F.lit(".py")), file_of("s_nationkey"))
    packages = outside("pkg", "package", 3_000_000, none, none)
    nodes = cust.unionByName(supp).unionByName(imports).unionByName(packages)

    def edges_of(df: DataFrame, kind: str, base: int, number, source, target, part_of) -> DataFrame:
        return df.select(
            part_of.alias("file_part"), (number + base).cast("long").alias("ord"), F.concat(F.lit(f"edge:{kind}:"), source, F.lit(">"), target).alias("id"),
            F.lit(kind).alias("kind"), source.alias("from"), target.alias("to"), F.lit(None).cast(schema.SPAN).alias("span"),
            F.lit("structural-scanner").alias("provenance"), F.lit("medium").alias("confidence"),
        )

    node = lambda tag, key: F.concat(F.lit(f"node:{tag}:"), F.col(key).cast("string"))
    calls = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct().join(customer, F.col("o_custkey") == c)
    halves = customer.withColumn("half", F.floor(c / 2).cast("long"))
    edges = (
        edges_of(calls, "calls", 0, F.col("o_custkey") * 100_000 + F.col("l_suppkey"), node("cust", "o_custkey"), node("supp", "l_suppkey"), file_of("c_nationkey", "c_custkey"))
        .unionByName(edges_of(supplier, "references", 0, s, node("supp", "s_suppkey"), node("cust", "s_suppkey"), file_of("s_nationkey", "s_suppkey")))
        .unionByName(edges_of(halves, "depends-on", 0, c, node("cust", "c_custkey"), node("cust", "half"), file_of("c_nationkey", "c_custkey")))
        .unionByName(edges_of(brands, "imports", 0, number, F.concat(F.lit("node:imp:"), F.col("s_nationkey").cast("string"), F.lit(":"), F.col("p_brand")), F.concat(F.lit("node:pkg:"), F.col("p_brand")), file_of("s_nationkey")))
    )
    diagnostics = supplier.where("s_acctbal < 0").select(
        file_of("s_nationkey", "s_suppkey").alias("file_part"), s.alias("ord"), F.lit("warning").alias("severity"), F.concat(F.lit("parse error near supplier "), s.cast("string")).alias("message"),
        F.when(s % 5 != 0, file_of("s_nationkey", "s_suppkey")).alias("file_id"), F.lit(None).cast(schema.SPAN).alias("span"),
    )
    return GraphTables(files, nodes, edges, diagnostics)


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SYMBOL = """
  SELECT 'file:' || ({nk} + 25 * ({k} // 500)) AS file_part, ({k} + {base})::BIGINT AS ord, 'node:{tag}:' || {k} AS id, 'symbol' AS kind, {langs}[{nk} % 5 + 1] AS language,
    {name} AS name, 'mod.' || {name} AS qualified_name, {kind} AS symbol_kind, CASE WHEN {k} % 89 <> 0 THEN 'file:' || ({nk} + 25 * ({k} // 500)) END AS file_id,
    ({k} * 20)::BIGINT AS byte_start, ({k} * 20 + CASE WHEN {k} % 97 = 0 THEN -3 ELSE {k} % 17 END)::BIGINT AS byte_end, ({k} % 500 + 1)::BIGINT AS line,
    (CASE WHEN {k} % 97 = 0 THEN -3 ELSE {k} % 17 END + 1)::BIGINT AS col_end, {prov}[{k} % 6 + 1] AS provenance, {conf}[{k} % 4 + 1] AS confidence
  FROM {table}"""
_P, _C, _G = _list(schema.PROVENANCES), _list(schema.CONFIDENCES), _list(LANGS)
#: The same graph as common table expressions; spans are flat.
GRAPH_SQL = f"""
g_files AS (
  SELECT 'file:' || number AS file_id, lower(r_name) || '/' || lower(n_name) || folder || {_list(ENDS)}[n_nationkey % 5 + 1] AS path, {_G}[n_nationkey % 5 + 1] AS language,
    sha256('text of ' || n_name || folder) AS fingerprint, (number * 10)::BIGINT AS parse_time_micros, (number * 10 + 5)::BIGINT AS extraction_time_micros, number::BIGINT AS partition_pos
  FROM (SELECT n_name, n_regionkey, n_nationkey, n_nationkey + 25 * part AS number, CASE WHEN part > 0 THEN '/part' || part ELSE '' END AS folder FROM nation JOIN
    (SELECT c_nationkey AS nation, c_custkey // 500 AS part FROM customer UNION SELECT s_nationkey, s_suppkey // 500 FROM supplier UNION SELECT n_nationkey, 0 FROM nation) ON n_nationkey = nation)
  JOIN region ON n_regionkey = r_regionkey),
brands AS (SELECT DISTINCT s_nationkey, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
g_nodes AS ({_SYMBOL.format(nk="c_nationkey", k="c_custkey", base=0, tag="cust", langs=_G, name="(c_mktsegment || '_' || c_custkey % 40)", kind="['function', 'method', 'class'][c_custkey % 3 + 1]", prov=_P, conf=_C, table="customer")}
  UNION ALL {_SYMBOL.format(nk="s_nationkey", k="s_suppkey", base=1000000, tag="supp", langs=_G, name="('supplier_' || s_suppkey % 10)", kind="'class'", prov=_P, conf=_C, table="supplier")}
  UNION ALL SELECT 'file:' || s_nationkey, string_split(p_brand, '#')[-1]::BIGINT + 2000000, 'node:imp:' || s_nationkey || ':' || p_brand, 'import', {_G}[s_nationkey % 5 + 1], p_brand, 'lib/' || p_brand || '.py',
    NULL, 'file:' || s_nationkey, NULL, NULL, NULL, NULL, 'structural-scanner', 'medium' FROM brands
  UNION ALL SELECT 'file:' || s_nationkey, string_split(p_brand, '#')[-1]::BIGINT + 3000000, 'node:pkg:' || p_brand, 'package', 'unknown', p_brand, NULL,
    NULL, NULL, NULL, NULL, NULL, NULL, 'structural-scanner', 'medium' FROM brands),
g_edges AS (
  SELECT 'file:' || (c_nationkey + 25 * (c_custkey // 500)) AS file_part, 'edge:calls:node:cust:' || o_custkey || '>node:supp:' || l_suppkey AS id, 'calls' AS kind, 'node:cust:' || o_custkey AS src, 'node:supp:' || l_suppkey AS dst
  FROM (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'file:' || (s_nationkey + 25 * (s_suppkey // 500)), 'edge:references:node:supp:' || s_suppkey || '>node:cust:' || s_suppkey, 'references', 'node:supp:' || s_suppkey, 'node:cust:' || s_suppkey FROM supplier
  UNION ALL SELECT 'file:' || (c_nationkey + 25 * (c_custkey // 500)), 'edge:depends-on:node:cust:' || c_custkey || '>node:cust:' || (c_custkey // 2), 'depends-on', 'node:cust:' || c_custkey, 'node:cust:' || (c_custkey // 2) FROM customer
  UNION ALL SELECT 'file:' || s_nationkey, 'edge:imports:node:imp:' || s_nationkey || ':' || p_brand || '>node:pkg:' || p_brand, 'imports', 'node:imp:' || s_nationkey || ':' || p_brand, 'node:pkg:' || p_brand FROM brands),
g_diagnostics AS (
  SELECT 'file:' || (s_nationkey + 25 * (s_suppkey // 500)) AS file_part, s_suppkey AS ord, 'warning' AS severity, 'parse error near supplier ' || s_suppkey AS message, CASE WHEN s_suppkey % 5 <> 0 THEN 'file:' || (s_nationkey + 25 * (s_suppkey // 500)) END AS file_id FROM supplier WHERE s_acctbal < 0),
g_last AS (
  SELECT * EXCLUDE (rn) FROM (SELECT n.*, row_number() OVER (PARTITION BY n.id ORDER BY f.partition_pos DESC, n.ord DESC) AS rn FROM g_nodes n JOIN g_files f ON n.file_part = f.file_id) WHERE rn = 1)
"""
