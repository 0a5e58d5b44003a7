"""Exports of a graph as JSON lines and documents, and imports of graphs and of enrichment facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import expr as X
from ..operators.tables import GraphTables, cut, numbered, positioned, running

NODE_FIELDS = [f.name for f in schema.NODES.fields if f.name not in ("file_part", "ord")]
EDGE_FIELDS = [f.name for f in schema.EDGES.fields if f.name not in ("file_part", "ord")]
DIAGNOSTIC_FIELDS = [f.name for f in schema.DIAGNOSTICS.fields if f.name not in ("file_part", "ord")]


def _json(**fields) -> F.Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def _records(tables: GraphTables) -> DataFrame:
    """(partition_pos, section, ord, line) of the lossless export."""
    pos = tables.files.select(F.col("file_id").alias("file_part"), "partition_pos")
    zero = F.lit(0).cast("long")
    metrics = F.struct("parse_time_micros", "extraction_time_micros")
    rows = tables.files.select("partition_pos", F.lit(0).alias("section"), zero.alias("ord"), _json(type=F.lit("partition"), file_id=F.col("file_id"), path=F.col("path"), language=F.col("language"), fingerprint=F.col("fingerprint"), metrics=metrics).alias("line"))
    parts = [("node", 1, tables.nodes, NODE_FIELDS), ("edge", 2, tables.edges, EDGE_FIELDS)]
    if tables.diagnostics is not None:
        parts.append(("diagnostic", 3, tables.diagnostics, DIAGNOSTIC_FIELDS))
    for kind, section, df, fields in parts:
        body = F.struct(*[F.col(f"`{f}`") for f in fields])
        line = _json(type=F.lit(kind), partition=F.col("file_part"), **{kind: body})
        rows = rows.unionByName(df.join(pos, "file_part").select("partition_pos", F.lit(section).alias("section"), "ord", line.alias("line")))
    return rows


def export_jsonl(tables: GraphTables) -> DataFrame:
    """(line), each partition followed by its nodes, edges and diagnostics in order."""
    return _records(tables).orderBy("partition_pos", "section", "ord").select("line")


def export_symbols(tables: GraphTables) -> DataFrame:
    """One flat line a node with a symbol kind: path (its file_id), names, kind 'symbol'."""
    rows = positioned(tables).where("symbol_kind is not null").orderBy("partition_pos", "ord")
    return rows.select(_json(path=F.coalesce("file_id", F.lit("")), name=F.col("name"), qualified_name=F.col("qualified_name"), kind=F.lit("symbol")).alias("line"))


def export_scip(tables: GraphTables) -> DataFrame:
    """Lines that together are one JSON document: version and, by path, the nodes with a symbol kind; a line a path."""
    body = F.struct("ord", F.struct(*[F.col(f"`{f}`") for f in NODE_FIELDS]).alias("node"))
    symbols = tables.nodes.where("symbol_kind is not null").groupBy(F.col("file_part").alias("file_id")).agg(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["node"]).alias("symbols"))
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    empty = F.array().cast(symbols.schema["symbols"].dataType)
    first = tables.files.agg(F.min("partition_pos").alias("first"))
    files = tables.files.join(symbols, "file_id", "left").select("partition_pos", F.to_json(F.struct(path.alias("relative_path"), F.coalesce("symbols", empty).alias("symbols"))).alias("json"))
    comma = F.when(F.col("partition_pos") == F.col("first"), "").otherwise(",")
    lines = files.crossJoin(F.broadcast(first)).select(F.lit(1).alias("section"), "partition_pos", F.concat(comma, "json").alias("line"))
    frame = tables.files.sparkSession.createDataFrame([(0, 0, '{"version":1,"documents":['), (2, 0, "]}")], "section int, partition_pos long, line string")
    return lines.unionByName(frame).orderBy("section", "partition_pos").select("line")


def export_lsif(tables: GraphTables) -> DataFrame:
    """Vertices with running ids from 1: a document, then a resultSet for each of its nodes with a symbol kind.

    Ids are prefix sums over partitions and places inside them, so no single task numbers all.
    """
    nodes = positioned(tables).where("symbol_kind is not null")
    counts = tables.files.select("file_id", "partition_pos").join(nodes.groupBy(F.col("file_part").alias("file_id")).agg(F.count("*").alias("n")), "file_id", "left")
    starts = running(counts, "before", F.coalesce("n", F.lit(0)) + 1, "partition_pos").select("file_id", (F.col("before") + 1).alias("start"))
    documents = tables.files.join(starts, "file_id").select(F.col("start").alias("id"), F.lit("document").alias("label"), F.col("path").alias("uri"), F.lit(None).cast("string").alias("symbol"))
    place = F.row_number().over(Window.partitionBy("file_part").orderBy("ord"))
    results = nodes.join(starts.withColumnRenamed("file_id", "file_part"), "file_part").select((F.col("start") + place).alias("id"), F.lit("resultSet").alias("label"), F.lit(None).cast("string").alias("uri"), F.col("qualified_name").alias("symbol"))
    document = _json(id=F.col("id"), type=F.lit("vertex"), label=F.col("label"), uri=F.col("uri"))
    result = _json(id=F.col("id"), type=F.lit("vertex"), label=F.col("label"), symbol=F.col("symbol"))
    return documents.unionByName(results).orderBy("id").select("id", F.when(F.col("label") == "document", document).otherwise(result).alias("line"))


EXPORTS = {"jsonl": export_jsonl, "symbols": export_symbols, "scip": export_scip, "lsif": lambda t: export_lsif(t).select("line")}


def export(tables: GraphTables, name: str) -> DataFrame:
    if name not in EXPORTS:
        raise ValueError(f"unknown format {name}; one of {', '.join(EXPORTS)}")
    return EXPORTS[name](tables)


# Imports

RECORD = (
    "type string, file_id string, path string, language string, fingerprint string, metrics struct<parse_time_micros: bigint, extraction_time_micros: bigint>, partition string, "
    f"node struct<{', '.join(f'`{f}`: {schema.NODES[f].dataType.simpleString()}' for f in NODE_FIELDS)}>, edge struct<{', '.join(f'`{f}`: {schema.EDGES[f].dataType.simpleString()}' for f in EDGE_FIELDS)}>, "
    f"diagnostic struct<{', '.join(f'`{f}`: {schema.DIAGNOSTICS[f].dataType.simpleString()}' for f in DIAGNOSTIC_FIELDS)}>"
)


def import_jsonl(lines: DataFrame) -> GraphTables:
    """The graph of (pos, line), pos of any type that has an order; each line is parsed once.

    Records go to the first partition of their file id if that stands before them; others are dropped, blank lines
    skipped. Records keep their order, and partitions that of their first lines.
    """
    rows = cut(lines.where(F.trim("line") != "").select("pos", F.from_json("line", RECORD, {"mode": "FAILFAST"}).alias("r")).select("pos", "r.*"))
    parts = rows.where("type = 'partition'")
    first = parts.groupBy("file_id").agg(F.min_by(F.struct("pos", "path", "language", "fingerprint", "metrics"), "pos").alias("p"))
    files = first.select("file_id", "p.path", "p.language", "p.fingerprint", "p.metrics.parse_time_micros", "p.metrics.extraction_time_micros", F.col("p.pos").alias("_pos"))
    files = numbered(files, "partition_pos", "_pos").drop("_pos")
    known = first.select(F.col("file_id").alias("partition"), F.col("p.pos").alias("_start"))

    def of(kind: str, fields: list[str]) -> DataFrame:
        own = rows.where(F.col("type") == kind).join(known, "partition").where("pos > _start")
        place = F.row_number().over(Window.partitionBy("partition").orderBy("pos")) - 1
        return own.select(F.col("partition").alias("file_part"), place.cast("long").alias("ord"), *[F.col(f"{kind}.`{f}`").alias(f) for f in fields])

    return GraphTables(files, of("node", NODE_FIELDS), of("edge", EDGE_FIELDS), of("diagnostic", DIAGNOSTIC_FIELDS))


SCIP = "documents array<struct<relativePath: string, occurrences: array<struct<symbol: string, `range`: array<bigint>, roles: bigint>>>>"
LSP = "documents array<struct<uri: string, facts: array<struct<symbol: string, kind: string, `range`: struct<start: struct<line: bigint, character: bigint>, end: struct<line: bigint, character: bigint>>>>>>"


def _enrichment(facts: DataFrame, documents: DataFrame, repo: str, provenance: str, confidence: str) -> GraphTables:
    """facts: (path, ord, symbol, defines, span); documents: (path, pos). A partition a document: its file and a symbol a fact."""
    files = documents.select(
        X.det_id("file", F.lit(repo), "path", F.lit("unknown")).alias("file_id"), "path", F.lit("unknown").alias("language"), X.fingerprint(F.lit("")).alias("fingerprint"),
        F.lit(0).cast("long").alias("parse_time_micros"), F.lit(0).cast("long").alias("extraction_time_micros"), F.col("pos").cast("long").alias("partition_pos"),
    )
    quality = [F.lit(provenance).alias("provenance"), F.lit(confidence).alias("confidence")]
    none = F.lit(None).cast(schema.SPAN)
    null = F.lit(None).cast("string")
    lang = F.lit("unknown")
    file_node = X.node_id(F.lit(repo), "file_id", F.lit("file"), lang, "path", "path", none)
    own = files.select(
        F.col("file_id").alias("file_part"), F.lit(0).cast("long").alias("ord"), file_node.alias("id"), F.lit("file").alias("kind"), lang.alias("language"), X.file_name("path").alias("name"),
        F.col("path").alias("qualified_name"), null.alias("symbol_kind"), "file_id", none.alias("span"), *quality,
    )
    rows = facts.join(files.select("path", "file_id"), "path")
    symbol_id = X.node_id(F.lit(repo), "file_id", F.lit("symbol"), lang, "symbol", "symbol", "span")
    symbols = rows.select(
        F.col("file_id").alias("file_part"), (F.col("ord") + 1).cast("long").alias("ord"), symbol_id.alias("id"), F.lit("symbol").alias("kind"), lang.alias("language"), X.simple_name("symbol").alias("name"),
        F.col("symbol").alias("qualified_name"), F.lit("unknown").alias("symbol_kind"), "file_id", "span", *quality,
    )
    kind = F.when(F.col("defines"), "defines").otherwise("references")
    source = X.node_id(F.lit(repo), "file_id", F.lit("file"), lang, "path", "path", none)
    edges = rows.withColumn("to", symbol_id).withColumn("from", source).withColumn("kind", kind).select(
        F.col("file_id").alias("file_part"), F.col("ord").cast("long").alias("ord"), X.edge_id("kind", "from", "to", "span").alias("id"), "kind", "from", "to", "span", *quality
    )
    return GraphTables(files, own.unionByName(symbols), edges, documents.sparkSession.createDataFrame([], schema.DIAGNOSTICS))


def import_scip(json: DataFrame, repo: str) -> GraphTables:
    """(json) of documents with occurrences; bit 0 of the roles defines, else refers. Facts of exact confidence."""
    docs = json.select(F.posexplode(F.from_json("json", SCIP)["documents"]).alias("pos", "d")).select("pos", F.col("d.relativePath").alias("path"), "d.occurrences")
    facts = docs.select("path", F.posexplode("occurrences").alias("ord", "o")).select("path", "ord", "o.symbol", (F.coalesce("o.roles", F.lit(0)).bitwiseAND(F.lit(1)) == 1).alias("defines"), X.scip_span("o.range").alias("span"))
    return _enrichment(facts, docs.select("path", "pos"), repo, "scip", "exact")


def import_lsp(json: DataFrame, repo: str, root: str) -> GraphTables:
    """(json) of documents with facts; a file:// URI loses its scheme, another is joined to the root. High confidence."""
    docs = json.select(F.posexplode(F.from_json("json", LSP)["documents"]).alias("pos", "d"))
    uri = F.col("d.uri")
    path = F.when(F.startswith(uri, F.lit("file://")), F.substr(uri, F.lit(8))).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), uri))
    docs = docs.select("pos", path.alias("path"), "d.facts")
    facts = docs.select("path", F.posexplode("facts").alias("ord", "f")).select("path", "ord", "f.symbol", (F.col("f.kind") == "definition").alias("defines"), X.lsp_span("f.range").alias("span"))
    return _enrichment(facts, docs.select("path", "pos"), repo, "lsp", "high")


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a file or of all part files of a folder: by the file's name, where its split starts, and the place there.

    Files are split and read by many tasks; a whole one is never a row.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    return spark.read.text(path).select(at.alias("pos"), F.col("value").alias("line"))


def write_lines(df: DataFrame, path: str) -> None:
    """One text file a sorted partition."""
    df.write.mode("overwrite").text(path)
