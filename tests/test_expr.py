"""Edges of the scalar expressions, ranking rules and null-safe keys."""

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import expr as X
from graphloom.operators import diff, integrity
from graphloom.operators.tables import GraphTables, best_facts, last_nodes, resolve_local


def value(spark, column, **fields):
    names = list(fields) or ["x"]
    row = tuple(fields.values()) if fields else (None,)
    return spark.createDataFrame([row], ", ".join(f"{n} {'binary' if isinstance(v, bytes) else 'string'}" for n, v in zip(names, row, strict=True))).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "stem"), [("./lib", "lib"), ("a/b.ts", "b"), ("x.py.ts.js", "x"), ("y.js.py", "y.js"), (".py", None), ("lib.run", "lib.run"), ("", None)])
def test_module_stem(spark, text, stem):
    assert value(spark, X.module_stem("a"), a=text) == stem


@pytest.mark.parametrize(("line", "module"), [('import x from "m"', "m"), ("from 'a' \"b\"", "b"), ("''", ""), ('"open', None), ("none", None), ("it's \"\"", "")])
def test_quoted_module(spark, line, module):
    assert value(spark, X.quoted_module("a"), a=line) == module


@pytest.mark.parametrize(("path", "language"), [("a.h", "c"), ("a.mm", "objective-c"), ("a.c++", "cpp"), ("SConstruct", "python"), ("run", "unknown"), ("a.webmanifest", "json"), ("x.png", "unknown")])
def test_detection_by_path(spark, path, language):
    assert value(spark, X.detect_language("p", "t"), p=path, t="int x;") == language


@pytest.mark.parametrize(("text", "language"), [("@protocol P", "objective-c"), ("namespace a {", "cpp"), ("int x;", "c")])
def test_headers(spark, text, language):
    assert value(spark, X.detect_language("p", "t"), p="a.h", t=text) == language


@pytest.mark.parametrize(("text", "language"), [("#!/usr/bin/env node\nx", "javascript"), ("#!/usr/bin/python3", "python"), ("#!/usr/bin/env rust-script", "rust"), ("python", "unknown")])
def test_scripts(spark, text, language):
    assert value(spark, X.detect_language("p", "t"), p="run", t=text) == language


def test_candidates_and_binary(spark):
    assert value(spark, X.path_candidate("p"), p="Makefile") and not value(spark, X.path_candidate("p"), p="a.png")
    assert value(spark, X.is_binary("c"), c=b"a\0") and value(spark, X.is_binary("c"), c=b"\xff\xfe") and not value(spark, X.is_binary("c"), c="é".encode())
    assert not value(spark, X.is_binary("c"), c=b"a" * 9000 + b"\0") and not value(spark, X.is_binary("c"), c=b"")


def test_spans(spark):
    at = lambda a, z: F.struct(F.lit(a).cast("long").alias("byte_start"), F.lit(z).cast("long").alias("byte_end"))
    assert value(spark, X.span_text("t", at(1, 3)), t="aéb") == "é"
    assert value(spark, X.span_text("t", at(2, 3)), t="aéb") is None and value(spark, X.span_text("t", at(0, 9)), t="a") is None and value(spark, X.span_text("t", at(1, 0)), t="ab") is None
    longs = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    four = value(spark, X.scip_span(longs(1, 2, 3, 9)))
    assert (four["start"]["line"], four["end"]["line"], four["end"]["column"]) == (2, 2, 4)
    assert value(spark, X.scip_span(longs(1, 2))) is None


def test_names(spark):
    kind = lambda k: F.lit(k).cast("string")
    assert value(spark, X.scoped_name(kind("function"), "q", "n"), q="lib.A.run", n="run") == "A.run"
    assert value(spark, X.scoped_name(kind("module"), "q", "n"), q="lib", n="lib") == "$module"
    assert value(spark, X.scoped_name(kind("function"), "q", "n"), q="a::b", n="b") == "b"
    assert value(spark, X.simple_name("s"), s="pkg/a.ts#run") == "run" and value(spark, X.simple_name("s"), s="x/") == "x/"
    assert value(spark, X.call_identifiers("l"), l="if (a.b(c)) return f") == ["b", "f"] or value(spark, X.call_identifiers("l"), l="x") == ["x"]
    assert value(spark, X.symbol_summary(F.array(F.lit("b"), F.lit("a"), F.lit("c")))) == "a (+2 more)"


def test_risk(spark):
    risks = [("removed", True, "high"), ("modified", True, "medium"), ("removed", False, "medium"), ("added", False, "low")]
    df = spark.createDataFrame(risks, "c string, p boolean, want string").withColumn("got", X.risk_for("c", "p"))
    assert df.where("got <> want").count() == 0


def node(i, name, part="f", kind="symbol", provenance="structural-scanner", confidence="medium", qualified=None, file="f", id=None):
    return (part, i, id or f"n{i}", kind, "python", name, qualified, "function", file, None, provenance, confidence)


def test_best_fact_keeps_the_best_source_and_treats_nulls_as_equal(spark):
    rows = [node(1, "a"), node(2, "a", provenance="scip", confidence="exact"), node(3, "a", provenance="lsp", confidence="exact"), node(4, "b"), node(5, "b"), node(6, None, file=None), node(7, None, file=None)]
    assert {r["id"] for r in best_facts(spark.createDataFrame(rows, schema.NODES)).collect()} == {"n2", "n4", "n6"}


def test_last_node_wins(spark):
    files = spark.createDataFrame([("f", "f", "", "", 0, 0, 0), ("g", "g", "", "", 0, 0, 1)], schema.FILES)
    nodes = spark.createDataFrame([node(9, "old", id="x"), node(1, "new", part="g", id="x")], schema.NODES)
    assert [r["name"] for r in last_nodes(GraphTables(files, nodes, None)).collect()] == ["new"]


def test_resolution_takes_the_first_symbol_of_the_file(spark):
    nodes = [node(0, "go", qualified="lib.go"), node(1, "go", qualified="other.go"), node(2, "go", kind="external-symbol", file=None), node(3, "go", part="g", kind="external-symbol", file=None, id="n2")]
    edges = [("f", 0, "e0", "calls", "n1", "n2", None, "a", "b"), ("g", 0, "e1", "calls", "n9", "n2", None, "a", "b"), ("f", 1, "e2", "imports", "n1", "n2", None, "a", "b")]
    got = {(r["file_part"], r["kind"]): r["to"] for r in resolve_local(spark.createDataFrame(nodes, schema.NODES), spark.createDataFrame(edges, schema.EDGES)).collect()}
    assert got == {("f", "calls"): "n0", ("g", "calls"): "n2", ("f", "imports"): "n2"}


def test_triage(spark):
    changes = spark.createDataFrame([("modified", "src/lib.rs", None)], "change string, path string, old_path string")
    symbols = spark.createDataFrame([("modified", True, "medium", "lib::run", "src/lib.rs")], "change string, public_api boolean, risk string, symbol string, path string")
    none = spark.createDataFrame([], "change string, file string, dependency string, edge_kind string")
    found = spark.createDataFrame([("head", 0, "warning", "m", "src/other.rs")], "side string, section int, severity string, message string, file string")
    row = diff.triage(changes, symbols, none, found).first()
    assert (row["risk"], row["important_symbol_changes"], row["diagnostics"]) == ("medium", 1, 0)
    top = diff.top_changes(changes, symbols, none, found).first()
    assert (top["path"], top["symbol"], top["score"], top["kind"]) == ("src/lib.rs", "lib::run", 25, "modified-file")


def test_span_problems(spark):
    bad = {"byte_start": 5, "byte_end": 2, "start": {"line": 1, "column": 1}, "end": {"line": 1, "column": 1}}
    worse = {"byte_start": 0, "byte_end": 2, "start": {"line": 2, "column": 1}, "end": {"line": 1, "column": 9}}
    rows = [(*node(1, "a")[:9], bad, "x", "y"), (*node(2, "a")[:9], worse, "x", "y"), node(3, "a")]
    got = sorted(r[0] for r in integrity.invalid_spans(spark.createDataFrame(rows, schema.NODES), "node").collect())
    assert got == ["node n1 has an invalid byte span", "node n2 has an invalid line/column span"]
