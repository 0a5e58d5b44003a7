"""Versions, deltas, deletions, projections, checks, interchange and watching."""

import json
import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators import integrity
from graphloom.operators.query import GraphQuery
from graphloom.sources import discovery, interchange
from graphloom.sources.git import GitRepository, parse_name_status
from graphloom.sources.store import GraphStore

LIB, APP = "export function run() {\n  return 1;\n}\n", "import { run } from './lib';\n\nexport function main() {\n  run();\n}\n"


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "node_modules").mkdir(parents=True)
    for name, text in {"lib.ts": LIB, "app.ts": APP, "tool.py": "def go():\n    pass\n", "x.min.js": "var a", "node_modules/z.js": "var z", "skip.log": "x", "image.png": "x", "out.py": "a = 1\n", ".gitignore": "out.py\n"}.items():
        (root / name).write_text(text)
    (root / "bin.py").write_bytes(b"a\0b")
    return str(root)


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_index_folder(spark, repo):
    tables, skipped = discovery.index_path(spark, repo)
    assert paths(tables.files) == ["app.ts", "lib.ts", "tool.py"]
    assert {r["path"]: r["reason"] for r in skipped.collect()} == {"bin.py": "binary file", "node_modules/z.js": "vendor or generated path", "x.min.js": "vendor or generated path"}
    assert {r["language"] for r in tables.files.collect()} == {"typescript", "python"}


@pytest.mark.parametrize(("rule", "path", "hit"), [("out.py", "a/out.py", True), ("/out.py", "a/out.py", False), ("*.log", "b/c.log", True), ("doc/", "doc/x", True), ("a/**/z", "a/b/c/z", True), ("# x", "x", False)])
def test_ignore_rules(spark, rule, path, hit):
    kept = spark.createDataFrame([(path,)], "path string").where(discovery.not_ignored("path", [rule])).count()
    assert kept == (0 if hit else 1)


def test_nested_ignore_files(spark, tmp_path):
    root = tmp_path / "top" / "repo"
    (root / "a" / "deep").mkdir(parents=True)
    (root / "gen").mkdir()
    (tmp_path / "top" / ".git").mkdir()
    (tmp_path / "top" / ".gitignore").write_text("/repo/above.py\nlast.py\n")
    (root / ".gitignore").write_text("gen/\n*.log.py\n")
    (root / "a" / ".gitignore").write_text("own.py\n!last.py\n/deep/only.py\n")
    (root / ".ignore").write_text("b?.py\n[xy].py\n")
    for name in ("above.py", "last.py", "own.py", "gen/in.py", "a/own.py", "a/last.py", "a/deep/only.py", "a/deep/own.py", "a/only.py", "q.log.py", "b1.py", "x.py", "z.py", "__init__.py", "a/gen.py"):
        (root / name).write_text("v = 1\n")
    (root / "a" / ".gitignore").write_text((root / "a" / ".gitignore").read_text() + "!/gen/in.py\n")
    assert paths(discovery.discover(spark, str(root))) == ["__init__.py", "a/gen.py", "a/last.py", "a/only.py", "own.py", "z.py"]


def test_unreadable_files_leave_diagnostics(spark, repo):
    os.symlink("/proc/self/mem", os.path.join(repo, "mem.py"))
    tables, _ = discovery.index_path(spark, repo)
    assert [r["message"].split(":")[0] for r in tables.diagnostics.collect()] == ["failed to read mem.py"]


def test_streamed_parts_are_the_whole(spark, repo):
    from graphloom.sources.discovery import stream_path, summarize_path

    found = []
    assert stream_path(spark, repo, lambda g: found.append((paths(g.files), g.nodes.count())), size=2) == 3
    assert [p for p, _ in found] == [["app.ts"], ["lib.ts", "tool.py"]]
    summary = summarize_path(spark, repo).first()
    assert summary["files"] == 3 and summary["nodes"] == sum(n for _, n in found) and summary["extraction_time_micros"] > 0

    def broken(_):
        raise RuntimeError("full")

    with pytest.raises(RuntimeError):
        stream_path(spark, repo, broken)


def test_lookups_by_path(spark, repo):
    tables = discovery.index_path(spark, repo)[0].materialized()
    q = GraphQuery(tables)
    file_id = q.partition_for_path("lib.ts").first()["file_id"]
    assert q.path_for_file([file_id]).first()["path"] == "lib.ts"
    node = q.matching_symbols("run").first()["id"]
    assert q.path_for_node(node).first()["path"] == "lib.ts"


def test_two_writers_lose_nothing(spark, repo, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    tables, _ = discovery.index_path(spark, repo)
    store.replace_all(tables)
    assert not store._write_pointer(1, {"base": None, "deltas": []})
    other, seen = GraphStore(spark, store.root), []
    plain = store._write_pointer

    def late(number, state):
        if not seen:
            seen.append(1)
            other.replace_partitions(tables.only(tables.files.where("path = 'app.ts'")))
        return plain(number, state)

    store._write_pointer = late
    store.replace_partitions(tables.only(tables.files.where("path = 'lib.ts'")))
    assert len(store._read_pointer()["deltas"]) == 2 and paths(store.load_latest().files) == ["app.ts", "lib.ts", "tool.py"]


def test_bursts_end_with_quiet_or_the_longest_wait():
    from graphloom.streaming.watch import until_quiet

    def run(states, quiet, most):
        at, clock = [0], [0.0]
        look = lambda: {"a": states[min(at[0], len(states) - 1)]}

        def sleep(s):
            at[0], clock[0] = at[0] + 1, clock[0] + s

        return until_quiet(look, {"a": [0, 0]}, quiet, most, lambda: clock[0], sleep)["a"], round(clock[0], 2)

    assert run([(0, 0)], 0.2, 9) == ((0, 0), 0.0)
    state, took = run([(1, 1), (2, 2), (3, 3)], 0.2, 9)
    assert state == (3, 3) and 0.3 <= took <= 0.35
    assert run([(i, i) for i in range(1, 1000)], 0.2, 1)[1] in (1.0, 1.05)


def test_store_merges_base_and_deltas(spark, repo, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    tables, _ = discovery.index_path(spark, repo)
    store.replace_all(tables)
    assert store.lookup_symbol("run").count() == 1
    with open(os.path.join(repo, "lib.ts"), "w") as f:
        f.write(LIB + "export function extra() {\n}\n")
    plan = store.plan_reindex(spark.createDataFrame([("lib.ts",)], "path string"))
    assert {(r["path"], r["reason"]) for r in plan.collect()} == {("lib.ts", "changed"), ("app.ts", "reverse-dependency")}
    store.replace_partitions(discovery.index_changed_paths(spark, repo, ["lib.ts"]))
    latest = store.load_latest()
    assert paths(latest.files) == ["app.ts", "lib.ts", "tool.py"]
    assert store.lookup_symbol("extra").count() == 1
    gone = latest.files.where("path = 'tool.py'").select("file_id")
    store.replace_partitions(latest.only(latest.files.where("false")), gone)
    assert paths(store.load_latest().files) == ["app.ts", "lib.ts"]
    before = store.load_latest().nodes.count()
    store.compact()
    assert store._read_pointer()["deltas"] == [] and store.load_latest().nodes.count() == before
    assert store.lookup_symbol("extra").count() == 1
    assert store.partition_check(store.manifest()).count() == 0
    wrong = store.manifest().withColumn("fingerprint", F.lit("x"))
    assert store.partition_check(wrong).count() == 2


def test_empty_store(spark, tmp_path):
    assert GraphStore(spark, str(tmp_path / "none")).load_latest().nodes.count() == 0


def test_integrity(spark, repo):
    tables = discovery.index_path(spark, repo)[0].materialized()
    assert integrity.integrity_check(tables).count() == 0
    broken = tables.nodes.withColumn("file_id", F.when(F.col("kind") != "symbol", F.col("file_id")))
    assert integrity.symbols_without_file(broken).count() > 0
    assert integrity.dangling_edges(tables.nodes.where("kind <> 'symbol'"), tables.edges).count() > 0


@pytest.mark.parametrize("split", [False, True])
def test_jsonl_round_trip(spark, repo, tmp_path, split):
    tables = discovery.index_path(spark, repo)[0].materialized()
    out = str(tmp_path / "lines")
    interchange.write_lines(interchange.export_jsonl(tables).repartitionByRange(7, F.monotonically_increasing_id()).sortWithinPartitions(F.monotonically_increasing_id()) if split else interchange.export_jsonl(tables), out)
    back = interchange.import_jsonl(interchange.read_jsonl(spark, out))
    for name in ("nodes", "edges", "diagnostics"):
        a, b = (getattr(t, name).drop("ord") for t in (tables, back))
        assert a.exceptAll(b.select(*a.columns)).count() == 0 and b.count() == a.count()


@pytest.mark.parametrize("name", list(interchange.EXPORTS))
def test_exports_are_json(spark, repo, name):
    tables = discovery.index_path(spark, repo)[0].materialized()
    lines = [r["line"] for r in interchange.export(tables, name).collect()]
    assert lines and all(json.loads(x) for x in (["".join(lines)] if name == "scip" else lines))


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        interchange.export(None, "csv")


def test_enrichment(spark):
    scip = {"documents": [{"relativePath": "a.ts", "occurrences": [{"symbol": "pkg/a.ts#run", "range": [0, 1, 4], "roles": 1}, {"symbol": "x", "range": [1, 2], "roles": 0}]}]}
    g = interchange.import_scip(spark.createDataFrame([(json.dumps(scip),)], "json string"), "r")
    assert {r["kind"] for r in g.edges.collect()} == {"defines", "references"}
    spans = {r["name"]: r["span"] for r in g.nodes.where("kind = 'symbol'").collect()}
    assert spans["run"]["end"]["column"] == 5 and spans["x"] is None
    lsp = {"documents": [{"uri": "file:///w/a.ts", "facts": [{"symbol": "f", "kind": "definition", "range": {"start": {"line": 0, "character": 0}, "end": {"line": 0, "character": 3}}}]}, {"uri": "b.ts", "facts": []}]}
    g = interchange.import_lsp(spark.createDataFrame([(json.dumps(lsp),)], "json string"), "r", "/w")
    assert paths(g.files) == ["/w/a.ts", "/w/b.ts"] and {r["provenance"] for r in g.nodes.collect()} == {"lsp"}


def test_name_status():
    raw = b"M\0a b.py\0R100\0old\t.ts\0new\n.ts\0A\0z\0C90\0p\0q\0"
    assert parse_name_status(raw) == [("modified", "a b.py", None), ("renamed", "new\n.ts", "old\t.ts"), ("copied", "q", "p"), ("added", "z", None)]
    with pytest.raises(ValueError):
        parse_name_status(b"X\0a\0")


def test_git_diff(spark, tmp_path):
    import subprocess

    from graphloom.operators.diff import GraphDiff

    root = tmp_path / "g"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (root / "lib.ts").write_text(LIB)
    (root / "app.ts").write_text(APP)
    (root / "old.ts").write_text("export function keep() {\n  return 12345;\n}\n")
    run("add", "."), run("commit", "-qm", "a")
    (root / "lib.ts").write_text(LIB.replace("1", "2") + "\nexport function extra() {\n}\n")
    (root / "old.ts").rename(root / "renamed.ts")
    (root / "package.json").write_text('{"name": "p", "dependencies": {"lodash": "1"}}')
    run("add", "-A"), run("commit", "-qm", "b")
    git = GitRepository(str(root))
    sides = []
    for ref in ("HEAD~1", "HEAD"):
        src = discovery.sources(discovery.classify(git.contents(spark, ref), "repo"))
        from graphloom.sources import extract

        sides.append((extract.index(src), src))
    diff = GraphDiff(sides[0][0], sides[1][0], git.changes(spark, "HEAD~1", "HEAD"), sides[0][1], sides[1][1], materialize=True)
    changed = {r["symbol"]: (r["change"], r["public_api"]) for r in diff.changed_symbols.collect()}
    assert changed["lib.run"] == ("modified", True) and changed["lib.extra"] == ("added", True)
    assert not any("keep" in s for s in changed)
    assert {r["dependency"] for r in diff.dependency_changes.collect()} >= {"lodash"}
    assert "app.ts" in paths(diff.impacted_files)
    assert diff.stats().first()["files_renamed"] == 1
    assert diff.triage().first()["risk"] == "medium"
    assert diff.review_focus().count() > 0


def test_watch_keeps_a_store(spark, repo, tmp_path):
    from graphloom.streaming.watch import watch

    store = GraphStore(spark, str(tmp_path / "s"))
    run = lambda: watch(spark, repo, store, str(tmp_path / "c"), once=True).awaitTermination()
    run()
    assert paths(store.load_latest().files) == ["app.ts", "lib.ts", "tool.py"]
    os.remove(os.path.join(repo, "tool.py"))
    with open(os.path.join(repo, "new.py"), "w") as f:
        f.write("def fresh():\n    pass\n")
    run()
    assert paths(store.load_latest().files) == ["app.ts", "lib.ts", "new.py"]
    assert store.lookup_symbol("fresh").count() == 1


def test_traversal(spark):
    from graphloom import schema
    from graphloom.operators.tables import GraphTables

    names = list("abcde")
    node = lambda i, n: ("f", i, n, "symbol", "python", n, None, "function", "f", None, "structural-scanner", "medium")
    edge = lambda i, a, b: ("f", i, f"{a}{b}{i}", "depends-on", a, b, None, "structural-scanner", "medium")
    nodes = spark.createDataFrame([node(i, n) for i, n in enumerate(names)], schema.NODES)
    edges = spark.createDataFrame([edge(i, *e) for i, e in enumerate([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "x"), ("x", "e")])], schema.EDGES)
    files = spark.createDataFrame([("f", "f.py", "python", "", 0, 0, 0)], schema.FILES)
    q = GraphQuery(GraphTables(files, nodes, edges))
    start = spark.createDataFrame([("a",)], "start_id string")
    depth = lambda n: {r["id"]: r["depth"] for r in q.traverse_dependencies(start, n).collect()}
    assert depth(0) == {}
    assert depth(1) == {"b": 1, "c": 1}
    assert depth(3) == {"b": 1, "c": 1, "d": 2, "a": 3}
    assert depth(4) == {"b": 1, "c": 1, "d": 2, "a": 3, "e": 4}
