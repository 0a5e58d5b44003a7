"""Symbols, links and recovery of the extractors on small sources of our own."""

import pytest

from graphloom.functions import expr as X
from graphloom.sources import extract
from graphloom.operators.query import GraphQuery

SOURCES = {
    "coverage.py": "import os\nfrom lib.util import tool as t\n\n\nclass Service:\n    @cached\n    def run(self):\n        return main(1)\n\n\ndef main(x):\n    return x\n\n\nvalue = 3\n",
    "coverage.ts": "import { x } from './x';\n\nexport class Service {\n  run(a: string) {\n    return x(a);\n  }\n}\n\nexport function main() {\n  const s = new Service();\n  s.run('b');\n}\n\nconst local = () => main();\n",
    "coverage.rs": "use std::fmt;\n\npub struct Service { a: u32 }\n\nimpl Service {\n    pub fn run(&self) { println!(\"x\"); }\n}\n\nenum Mode { A, B }\n\ntrait Runner { fn go(&self); }\n\nfn main() {\n    let s = 1;\n    run(s);\n}\n",
    "a.c": "#include <stdio.h>\nstruct Point { int x; };\nint add(int a, int b) { return a + b; }\nint main(void) { printf(\"%d\", add(1, 2)); return 0; }\n",
    "a.cpp": "#include <vector>\nnamespace demo {\nclass Widget {\n public:\n  int size() const { return compute(); }\n};\n}\ndemo::Widget make_widget() {\n  demo::Widget widget;\n  widget.size();\n  return widget;\n}\n",
    "a.go": "package demo\n\nimport (\n\t\"fmt\"\n)\n\ntype Counter struct { n int }\n\nfunc Add(a int, b int) int { return a + b }\n\nfunc (c *Counter) Inc() { c.n = Add(c.n, 1); fmt.Println(c.n) }\n",
    "Widget.java": "package demo;\n\nimport java.util.List;\n\nclass Widget {\n  private int count;\n  Widget(int c) { this.count = c; }\n  int size() { return compute(count); }\n}\n",
    "W.m": "#import <Foundation/Foundation.h>\n@interface Widget : NSObject\n- (void)run;\n@end\n@implementation Widget\n- (void)run {\n  NSLog(@\"x\");\n}\n@end\n",
    "package.json": '{"name": "fixture", "dependencies": {"react": "1", "x": "2"}, "devDependencies": ["y"], "exports": {".": "./a.js"}}',
}
LANGUAGE = {"coverage.py": "python", "coverage.ts": "typescript", "coverage.rs": "rust", "a.c": "c", "a.cpp": "cpp", "a.go": "go", "Widget.java": "java", "W.m": "objective-c", "package.json": "json"}


def symbols(path, text=None):
    rows = extract.Registry().facts(path, SOURCES[path] if text is None else text, LANGUAGE[path])
    return {r["qualified_name"]: r["symbol_kind"] for r in rows if r["fact"] == "symbol"}


def names(path, fact):
    return [r["name"] for r in extract.Registry().facts(path, SOURCES[path], LANGUAGE[path]) if r["fact"] == fact]


def test_python_symbols():
    assert symbols("coverage.py") == {"coverage": "module", "coverage.Service": "class", "coverage.Service.run": "method", "coverage.main": "function", "coverage.value": "variable"}
    assert names("coverage.py", "call") == ["main"]
    assert names("coverage.py", "reference") == ["cached"]
    assert names("coverage.py", "import") == ["os", "t"]


def test_typescript_symbols():
    assert symbols("coverage.ts") == {"coverage": "module", "coverage.Service": "class", "coverage.Service.run": "method", "coverage.main": "function", "coverage.local": "function"}
    assert names("coverage.ts", "export") == ["Service", "main"]


@pytest.mark.parametrize(
    ("path", "wanted"),
    [
        ("coverage.rs", {"coverage::Service", "coverage::Service::run", "coverage::Mode", "coverage::Runner", "coverage::main"}),
        ("a.c", {"Point", "add", "main"}), ("a.cpp", {"demo", "demo::Widget", "demo::Widget::size", "make_widget"}), ("a.go", {"demo", "demo.Counter", "demo.Add", "demo.Inc"}),
        ("Widget.java", {"demo", "demo.Widget", "demo.Widget.size"}), ("W.m", {"Widget", "Widget.run"}),
    ],
)
def test_symbols_of_brace_languages(path, wanted):
    found = symbols(path)
    assert wanted <= set(found)
    assert not any(q.split(":")[-1] == "widget" for q in found)
    assert names(path, "call")
    assert names(path, "import")


def facts(path, text, language):
    rows = extract.Registry().facts(path, text, language)
    return {(r["fact"], r["name"], r["symbol_kind"]) for r in rows}


def test_members_and_references_of_each_language():
    ts = facts("a.tsx", "import React from 'react';\n@Component({ x: 1 })\nexport class Page {\n  private readonly count = 0;\n  title: string;\n  @Input() size?: number;\n  render(a: string) {\n    const x = a < b;\n    return <Header kind={a}><Body /></Header>;\n  }\n}\nconst late = () => import('./late');\nfunction id<T>(v: Array<T>) { return v; }\n", "typescript")
    assert {("symbol", n, "field") for n in ("count", "title", "size")} <= ts and {("reference", n, None) for n in ("Component", "Input", "Header", "Body")} <= ts
    assert ("symbol", "render", "method") in ts and {n for f, n, _ in ts if f == "import"} == {"React", "./late"} and not {n for f, n, _ in ts if f == "reference"} & {"T", "Array"}
    java = facts("W.java", "package demo;\n@interface Mark { }\nclass W {\n  private int count, other = f(1, 2);\n  static final List<String> names = new ArrayList<>();\n  int size(int a) throws java.io.IOException, AnError, BError, CError, DError, EError, FError, GError, HError, IError, JError, KError, LError, MError, NError, OError, PError, QError, RError {\n    int local = 3;\n    return compute(local);\n  }\n}\n", "java")
    assert {n for f, n, k in java if k == "field"} == {"count", "other", "names"} and ("symbol", "Mark", "interface") in java and ("symbol", "size", "method") in java and ("call", "compute", None) in java
    go = facts("a.go", "package demo\n\ntype Counter struct { n int }\nvar limit = 3\nfunc (c *Counter) Inc() { c.n = add(c.n) }\nfunc Add(a int) int { return a }\n", "go")
    assert {("symbol", "Counter", "type-alias"), ("symbol", "Inc", "method"), ("symbol", "Add", "function"), ("symbol", "limit", "variable"), ("call", "add", None)} <= go
    c = facts("a.c", "typedef struct { int x; } Point;\ntypedef int (*compare)(int, int);\nstatic int total = 0;\nint main(void) { int local = 1; if (local == 2) { run(); } return 0; }\n", "c")
    assert {("symbol", "Point", "type-alias"), ("symbol", "compare", "type-alias"), ("symbol", "total", "variable"), ("call", "run", None)} <= c and not any(n == "local" for _, n, _ in c)
    m = facts("W.m", "@interface W : NSObject\n- (void)run;\n@end\n@implementation W\n- (void)run {\n  [self stop];\n  id x = [[Thing alloc] initWith:1];\n}\n@end\n", "objective-c")
    assert {("call", n, None) for n in ("stop", "alloc", "initWith")} <= m


def test_one_error_leaves_the_rest_of_a_python_tree():
    text = SOURCES["coverage.py"].replace("value = 3", "value = = 3\n\ndef two(:\n    return main(2)\n\nlast = 4")
    rows = extract.python_facts("coverage.py", text)
    assert {"coverage.Service.run", "coverage.main", "coverage.last"} <= {r["qualified_name"] for r in rows if r["fact"] == "symbol"}
    found = [(r["message"], r["span"]["start"]["line"]) for r in rows if r["fact"] == "diagnostic"]
    assert found == [("syntax error near value = = 3", 15), ("syntax error near def two(:", 17)]
    assert len([r for r in extract.python_facts("x.py", "def (:\n" * 9) if r["fact"] == "diagnostic"]) == 4


@pytest.mark.parametrize("path", [p for p in SOURCES if p.rsplit(".", 1)[-1] not in ("json", "py")])
def test_lines_of_each_language(spark, path):
    rows = [("r", path, path, LANGUAGE[path], "", SOURCES[path])]
    src = spark.createDataFrame(rows, "repo_id string, file_id string, path string, language string, fingerprint string, text string")
    scanned = extract.index(src, mode="scanner-only")
    large = extract.index(src, most=10)
    wanted = {"coverage.ts": {"Service", "main", "run"}, "coverage.rs": {"run", "main"}, "a.c": {"Point", "add", "main"}, "a.cpp": {"Widget", "size"}, "a.go": {"Counter", "Add"}, "Widget.java": {"Widget", "size"}, "W.m": {"Widget"}}[path]
    for g in (scanned, large):
        assert wanted <= {r["name"] for r in g.nodes.where("kind = 'symbol'").collect()}
        assert {"defines"} <= {r["kind"] for r in g.edges.collect()} and g.edges.where("kind = 'imports'").count() == (0 if path == "W.m" else 1)
    assert scanned.diagnostics.count() == 0 and large.diagnostics.count() == 1
    assert extract.index(src, most=10, mode="tree-only").nodes.count() == 1


def test_json_manifest():
    assert {"package.json", "fixture"} == set(symbols("package.json"))
    assert names("package.json", "dependency") == ["react", "x", "y"]
    assert names("package.json", "reference") == ["./a.js"]


@pytest.mark.parametrize("path", list(SOURCES))
def test_broken_text_still_gives_something(path):
    text = SOURCES[path][: len(SOURCES[path]) * 2 // 3] + "\n{{{ (((\n"
    rows = extract.Registry().facts(path, text, LANGUAGE[path])
    assert rows


def test_large_text_is_scanned():
    rows = extract.Registry().facts("a.py", "def f():\n    g()\n", "python", most=8)
    assert any(r["fact"] == "diagnostic" and "skipped large" in r["message"] for r in rows)
    assert any(r["name"] == "f" for r in rows)


def test_many_lines():
    assert len(extract.Registry().facts("l.py", "def f():\n    return g(1)\n\n" * 400, "python")) >= 400


def index(spark, files):
    rows = [("repo", f"f{i}", p, LANGUAGE.get(p, "python"), "", t) for i, (p, t) in enumerate(files.items())]
    sources = spark.createDataFrame(rows, "repo_id string, file_id string, path string, language string, fingerprint string, text string")
    return extract.index(sources)


def test_graph_of_sources(spark):
    q = GraphQuery(index(spark, SOURCES).cached())
    assert [r["id"] for r in q.callers("main").collect()]
    callers = {r["qualified_name"] for r in q.callers("main").collect()}
    assert {"coverage.Service.run", "coverage"} & callers
    assert [r[0] for r in q.package_dependencies().collect()] == sorted(r[0] for r in q.package_dependencies().collect())
    assert "react" in {r[0] for r in q.package_dependencies().collect()}
    local = q.tables.edges.where("kind = 'calls'").join(q.by_id.where("kind = 'symbol'").selectExpr("id as `to`"), "to").count()
    assert local > 0
    assert q.tables.edges.groupBy("file_part", "id").count().where("count > 1").count() == 0


def test_ids_are_deterministic(spark):
    a, b = (index(spark, {"coverage.py": SOURCES["coverage.py"]}).nodes.select("id") for _ in range(2))
    assert a.exceptAll(b).count() == 0
    assert spark.range(1).select(X.det_id("node", X.F.lit("a"), X.F.lit("b"))).first()[0] != spark.range(1).select(X.det_id("node", X.F.lit("ab"), X.F.lit(""))).first()[0]
