"""Command line: index, query, export, diff, watch."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr as X


QUERIES = {
    "symbols": "symbols, or those of a name", "deps": "what files import or depend on", "callers": "what calls a name", "callees": "what symbols of a name call", "refs": "what refers to a name",
    "packages": "packages", "deps-tree": "what symbols of a name depend on, step by step", "impact": "files that changes of files reach",
}
#: Columns of text results that are not nodes.
HEADERS = {"packages": ["package"], "deps": ["file", "dependency"], "impact": ["file"]}


def parser() -> argparse.ArgumentParser:
    from .sources.extract import MODES, MOST_BYTES

    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="index a folder into a store")
    index.add_argument("path")
    index.add_argument("--changed", action="append", default=[], help="only these paths and what imports them")
    query = sub.add_parser("query", help="query a store; " + "; ".join(f"{k}: {v}" for k, v in QUERIES.items()))
    query.add_argument("query", choices=list(QUERIES))
    query.add_argument("names", nargs="*")
    query.add_argument("--depth", type=int, default=3)
    export = sub.add_parser("export", help="write a store's graph")
    export.add_argument("--output", help="a folder of part files; without it, lines go to the output")
    diff = sub.add_parser("diff", help="compare two commits")
    diff.add_argument("base")
    diff.add_argument("head")
    diff.add_argument("--repo", default=".")
    diff.add_argument("--agent", action="store_true", help="only what to review")
    watch = sub.add_parser("watch", help="keep a store up to date")
    watch.add_argument("path")
    watch.add_argument("--checkpoint", default=".graph-checkpoint")
    watch.add_argument("--once", action="store_true", help="one batch, then stop")
    watch.add_argument("--debounce-ms", type=int, default=150)
    watch.add_argument("--max-wait-ms", type=int, default=30_000)
    watch.add_argument("--no-initial", action="store_true", help="only what changes from now on")
    for child in (index, diff):
        child.add_argument("--max-parse-bytes", type=int, default=MOST_BYTES, help="larger texts are scanned by line")
        child.add_argument("--mode", choices=MODES, default=MODES[2], help="how facts are found")
        child.add_argument("--workers", type=int, help="tasks at once, where the session is started here")
    for name, child in sub.choices.items():
        child.add_argument("--store", default=".graph")
        if name != "export":
            child.add_argument("--pretty", action="store_true", help="aligned tables")
            child.add_argument("--color", choices=["auto", "always", "never"], default="auto")
        child.add_argument("--format", default="jsonl" if name == "export" else "text", choices=None if name == "export" else ["text", "json"])
    return p


def coloured(args: argparse.Namespace) -> bool:
    """Colours for a terminal, unless NO_COLOR is set or the option says otherwise."""
    return args.color == "always" or args.color == "auto" and sys.stdout.isatty() and "NO_COLOR" not in os.environ


def render(headers: list[str], rows: list[list[str]], colour: bool) -> str:
    """An aligned table: framed, or with a coloured head."""
    if not rows:
        return "No results."
    widths = [max(map(len, column)) for column in zip(headers, *rows, strict=True)]
    line = lambda cells, gap: gap.join(c.ljust(w) for c, w in zip(cells, widths, strict=True))
    if colour:
        return "\n".join(["\x1b[1;36m" + line(headers, "  ") + "\x1b[0m", *(line(r, "  ") for r in rows)])
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    return "\n".join([rule, *(f"| {line(r, ' | ')} |" for r in [headers]), rule, *(f"| {line(r, ' | ')} |" for r in rows), rule])


def show(df: DataFrame, args: argparse.Namespace, query: str = "", headers: list[str] | None = None, text: list[str] | None = None) -> None:
    """Print results: whole records as JSON, or the columns `text` (all, without it) as lines or a table."""
    if args.format == "json":
        rows = [json.loads(x) for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]
        print(json.dumps({"query": query, "results": rows}, indent=2))
        return
    shown = df.select(*(text or df.columns))
    rows = [["" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v) for v in r] for r in shown.collect()]
    print(render(headers or shown.columns, rows, coloured(args))) if args.pretty else [print("\t".join(r)) for r in rows]


#: Fields of a result node, and of a symbol of the name index, in this order.
NODE_RECORD = ["id", "node_kind", "language", "name", "qualified_name", "symbol_kind", "file_id", "path", "location", "span", "provenance", "confidence"]
SYMBOL_RECORD = ["name", "qualified_name", "symbol_kind", "file_id", "path", "location", "span", "provenance", "confidence"]


def display_root(store: str) -> str | None:
    """The folder that paths are shown relative to: the one that holds a store of the usual name."""
    return os.path.realpath(os.path.dirname(os.path.abspath(store))) if os.path.basename(store.rstrip("/")) == ".graph" else None


def located(q, df: DataFrame, record: list[str] = NODE_RECORD, root: str | None = None) -> DataFrame:
    """Records of nodes, with what a line of text shows of them: label, kind, place."""
    full = df if "span" in df.columns else df.join(q._last(df).select("id", "span"), "id")
    full = full.withColumnRenamed("kind", "node_kind").join(q.paths, "file_id", "left")
    full = full.withColumn("location", X.location(F.coalesce("path", F.lit("")), "span"))
    shown = X.relative_path(F.lit(root), F.coalesce("path", F.lit(""))) if root else F.coalesce("path", F.lit(""))
    return full.select(*record, F.coalesce("qualified_name", "name").alias("_label"), F.coalesce("symbol_kind", "node_kind" if "node_kind" in full.columns else F.lit("symbol")).alias("_kind"), X.location(shown, "span").alias("_place"))


def run_query(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, bool]:
    """Results of a query, and whether they are nodes."""
    from .operators.query import GraphQuery
    from .sources.store import GraphStore

    store = GraphStore(spark, args.store)
    q, names, root = GraphQuery(store.load_latest()), args.names, display_root(args.store)
    if args.query == "symbols":
        return (located(q, store.lookup_symbol(names[0]), SYMBOL_RECORD, root) if names else located(q, q.lookup_symbols(), NODE_RECORD, root)), True
    if args.query == "packages":
        return q.package_dependencies(), False
    if args.query == "deps":
        return q.file_dependencies(names).orderBy("path", "label"), False
    if args.query == "impact":
        return q.impact_from_files(names), False
    if args.query == "deps-tree":
        return located(q, q.dependency_tree(names, args.depth), NODE_RECORD, root), True
    return located(q, {"callers": q.callers, "callees": q.callees, "refs": q.references}[args.query](names), NODE_RECORD, root), True


def main(argv: list[str] | None = None) -> int:
    from .operators import incremental
    from .operators.diff import GraphDiff
    from .sources import discovery, extract, interchange
    from .sources.git import GitRepository, short_commit
    from .sources.store import GraphStore
    from .streaming.watch import watch

    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("graphloom")
    if getattr(args, "workers", None) and "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{args.workers}]")
    spark = builder.getOrCreate()
    how = {"most": args.max_parse_bytes, "mode": args.mode} if args.command in ("index", "diff") else {}
    began = time.perf_counter()
    if args.command == "index":
        store = GraphStore(spark, args.store)
        if args.changed:
            plan = store.plan_reindex(spark.createDataFrame([(c,) for c in args.changed], "path string"))
            store.replace_partitions(discovery.index_changed_paths(spark, args.path, [r["path"] for r in plan.collect()], **how))
            show(plan, args, "index")
        else:
            tables, skipped = discovery.index_path(spark, args.path, **how)
            store.replace_all(tables.materialized())
            show(incremental.index_summary(store.load_latest()), args, "summary")
            show(skipped, args, "skipped")
            show(store.integrity_check(), args, "problems")
        took = time.perf_counter() - began
        print(f"took {took:.2f}s" if took >= 1 else f"took {took * 1000:.0f}ms", file=sys.stderr)
    elif args.command == "query":
        found, nodes = run_query(spark, args)
        plain = args.format == "json"
        show(found.drop("_label", "_kind", "_place") if plain else found, args, args.query, ["name", "kind", "location"] if nodes else HEADERS[args.query], ["_label", "_kind", "_place"] if nodes and not plain else None)
    elif args.command == "export":
        lines = interchange.export(GraphStore(spark, args.store).load_latest(), args.format)
        if args.output:
            interchange.write_lines(lines, args.output)
        else:
            for row in lines.toLocalIterator():
                print(row["line"])
    elif args.command == "diff":
        git = GitRepository(args.repo)
        sides = []
        for ref in (args.base, args.head):
            src = discovery.sources(discovery.classify(git.contents(spark, ref), discovery.repo_name(git.top)))
            sides.append((extract.index(src, **how), src))
        d = GraphDiff(sides[0][0], sides[1][0], git.changes(spark, args.base, args.head), sides[0][1], sides[1][1], materialize=True)
        print(f"{short_commit(git.resolve(args.base))}..{short_commit(git.resolve(args.head))}")
        parts = {"triage": d.triage(), "top_changes": d.top_changes(), "review_focus": d.review_focus()}
        if not args.agent:
            parts |= {"stats": d.stats(), "symbols": d.changed_symbols.select("change", "risk", "symbol", "path", "reason"), "dependencies": d.dependency_changes, "impacted": d.impacted_files}
        for name, df in parts.items():
            print(f"# {name}") if args.format != "json" else None
            show(df, args, name)
    elif args.command == "watch":
        watch(spark, args.path, GraphStore(spark, args.store), args.checkpoint, args.once, quiet=args.debounce_ms / 1000, max_wait=args.max_wait_ms / 1000, initial=not args.no_initial).awaitTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
