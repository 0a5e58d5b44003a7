"""Files of a repository as sources: walk, ignore rules, filters, detection, one outcome a file."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import expr as X
from ..operators.tables import GraphTables, cut


@dataclass(frozen=True)
class Rule:
    """A rule of an ignore file as a regular expression on a path that starts with `above`, the way down to the root from a folder above it."""

    pattern: str
    again: bool = False
    folder: bool = False
    above: str = ""


def ignore_rule(line: str, base: str = "", above: str = "") -> Rule | None:
    """A line of an ignore file that lies in the folder base, or above the root."""
    line = line.rstrip("\r\n")
    line = line if line.endswith("\\ ") else line.rstrip()
    if not line or line.startswith("#"):
        return None
    again, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
    folder = line.endswith("/")
    line = line.rstrip("/")
    rooted = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        closing = line.find("]", i + 2) if line[i] == "[" else -1
        if line[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif line[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif closing > 0:
            out, i = out + "[" + line[i + 1 : closing].replace("\\", "\\\\").replace("!", "^", line[i + 1] == "!") + "]", closing + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    start = "^" + (re.escape(base.rstrip("/") + "/") if base else "")
    return Rule(start + ("" if rooted else "(?:.*/)?") + out + "$", again, folder, above)


def not_ignored(path: X.Name, rules: list[Rule | str]) -> Column:
    """Neither the path nor a folder on its way is hidden or ignored: for each of these, the last rule that matches decides."""
    known = [r if isinstance(r, Rule) else ignore_rule(r) for r in rules]
    parts = F.split(X.col(path), "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), (n < F.size(parts)).alias("folder")))

    def ignored(step: Column) -> Column:
        out = F.lit(False)
        for r in filter(None, known):
            hit = F.regexp_like(F.concat(F.lit(r.above), step["path"]) if r.above else step["path"], F.lit(r.pattern))
            out = F.when(hit & step["folder"] if r.folder else hit, F.lit(not r.again)).otherwise(out)
        return out

    hidden = F.regexp_like(X.col(path), F.lit(r"(^|/)\.[^/]"))
    return ~hidden & ~F.exists(steps, ignored)


#: Names of ignore files, the later the stronger.
IGNORE_FILES = [".gitignore", ".ignore"]


def local_path(root: str) -> str | None:
    """root as a path of this machine's file system, if it is one."""
    return None if re.match(r"(?!file:)[a-z0-9+.-]+:", root) else os.path.abspath(re.sub("^file:/*", "/", root))


def ignore_rules(spark: SparkSession, root: str) -> list[Rule]:
    """Rules that hold below root, weakest first: the user's own, the repository's, those of folders above root, and of folders below."""
    found: list[tuple[str, str, str]] = []
    top = local_path(root)
    if top is not None:
        way, folder = [top], top
        while not os.path.exists(os.path.join(folder, ".git")) and os.path.dirname(folder) != folder:
            folder = os.path.dirname(folder)
            way.append(folder)
        if not os.path.exists(os.path.join(folder, ".git")):
            way = [top]
        home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
        for name in (os.path.join(home, "git", "ignore"), os.path.join(way[-1], ".git", "info", "exclude")):
            found.append((name, "", os.path.relpath(top, way[-1]) + "/" if way[-1] != top else ""))
        for folder in reversed(way[1:]):
            found += [(os.path.join(folder, name), "", os.path.relpath(top, folder) + "/") for name in IGNORE_FILES]
        for folder, dirs, names in os.walk(top):
            dirs[:] = sorted(d for d in dirs if not d.startswith("."))
            base = os.path.relpath(folder, top)
            found += [(os.path.join(folder, name), "" if base == "." else base, "") for name in IGNORE_FILES if name in names]
        texts = []
        for name, base, above in found:
            if os.path.isfile(name):
                with open(name, encoding="utf-8", errors="replace") as f:
                    texts.append((f.read(), base, above))
    else:
        texts = [(_read(spark, f"{root.rstrip('/')}/{p}"), os.path.dirname(p), "") for p in _listed(spark, root, hidden=True) if os.path.basename(p) in IGNORE_FILES]
    return [r for text, base, above in texts for line in text.split("\n") if (r := ignore_rule(line, base, above))]


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _read(spark: SparkSession, name: str) -> str:
    fs, path = _fs(spark, name)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _listed(spark: SparkSession, root: str, hidden: bool = False) -> list[str]:
    """Relative paths of the regular files below root, without hidden folders."""
    out = []
    top = local_path(root)
    if top is not None:
        for folder, dirs, names in os.walk(top):
            dirs[:] = [d for d in dirs if not d.startswith(".")]
            base = os.path.relpath(folder, top)
            out += [n if base == "." else f"{base}/{n}" for n in names if os.path.isfile(os.path.join(folder, n))]
    else:
        fs, path = _fs(spark, root)
        files, start = fs.listFiles(path, True), len(fs.makeQualified(path).toString().rstrip("/")) + 1
        while files.hasNext():
            out.append(files.next().getPath().toString()[start:])
    return sorted(p for p in out if hidden or not any(x.startswith(".") for x in p.split("/")))


#: Files that a task reads, about.
FILES = 500


def contents(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, content, error) of relative paths below root; a file that can't be read has an error instead of a content.

    Tasks read the files of a local or mounted root themselves; others go through Spark's reader, which is asked for
    those files alone.
    """
    top = local_path(root)
    if top is None:
        wanted = [f"{root.rstrip('/')}/{r['path']}" for r in paths.select("path").collect()]
        if not wanted:
            return spark.createDataFrame([], "path string, content binary, error string")
        base = _fs(spark, root)[0].makeQualified(_fs(spark, root)[1]).toString().rstrip("/")
        return spark.read.format("binaryFile").load(wanted).select(F.substr("path", F.lit(len(base) + 2)).alias("path"), "content", F.lit(None).cast("string").alias("error"))

    def read(batches):
        for batch in batches:
            names = batch["path"].tolist()
            for i in range(0, len(names), 64):
                content, error = [], []
                for name in names[i : i + 64]:
                    try:
                        with open(os.path.join(top, name), "rb") as f:
                            content.append(f.read())
                        error.append(None)
                    except OSError as e:
                        content.append(None)
                        error.append(f"failed to read {name}: {e.strerror}")
                yield pd.DataFrame({"path": names[i : i + 64], "content": content, "error": error})

    return paths.select("path").mapInPandas(read, "path string, content binary, error string")


def discover(spark: SparkSession, root: str, rules: list[Rule | str] | None = None) -> DataFrame:
    """(path, content, error): regular files below root by relative path, in order. Ignore files hold unless rules are given.

    Only files that are not ignored are read, and only those worth it: of others the content is null.
    """
    names = _listed(spark, root)
    paths = spark.createDataFrame(pd.DataFrame({"path": pd.Series(names, dtype="object")}), "path string").repartition(len(names) // FILES + 1)
    kept = paths.where(not_ignored("path", ignore_rules(spark, root) if rules is None else rules))
    worth = X.path_candidate("path") & ~X.is_vendor_or_generated("path")
    none = F.lit(None)
    return contents(spark, root, kept.where(worth)).unionByName(kept.where(~worth).select("path", none.cast("binary").alias("content"), none.cast("string").alias("error"))).orderBy("path")


def classify(files: DataFrame, repo_id: str) -> DataFrame:
    """One outcome a file: indexed, unsupported, skipped with its reason, or a diagnostic of a file that can't be read (error,
    if there is such a column); paths are judged before contents.

    Adds language, text, fingerprint and ids, which are null unless the file is indexed.
    """
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    language = X.detect_language("path", text)
    status = (
        F.when(X.is_vendor_or_generated("path"), "skipped").when(~X.path_candidate("path"), "unsupported").when(error.isNotNull(), "diagnostic").when(X.is_binary("content"), "skipped")
        .when(F.col("_language") == "unknown", "unsupported").otherwise("indexed")
    )
    reason = F.when(F.col("status") == "skipped", F.when(X.is_vendor_or_generated("path"), "vendor or generated path").otherwise("binary file")).when(F.col("status") == "diagnostic", error)
    ok = F.col("status") == "indexed"
    rows = files.withColumn("_language", language).withColumn("status", status)
    normal = X.normalize_path("path")
    return rows.select(
        F.lit(repo_id).alias("repo_id"), F.when(ok, X.det_id("file", F.lit(repo_id), normal, "_language")).alias("file_id"), normal.alias("path"), "status", reason.alias("reason"),
        F.when(ok, F.col("_language")).alias("language"), F.when(ok, X.fingerprint("content")).alias("fingerprint"), F.when(ok, text).alias("text"),
    )


def sources(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("status = 'indexed'").drop("status", "reason")


def index_path(spark: SparkSession, root: str, repo_id: str | None = None, **how):
    """(graph, skipped) of a folder; skipped files by path with their reasons. Files that can't be read leave diagnostics of the run.

    how: what extract.index takes.
    """
    from . import extract

    outcomes = cut(classify(discover(spark, root), repo_id or repo_name(root)))
    graph = extract.index(sources(outcomes), **how)
    null = F.lit(None).cast("string")
    unread = outcomes.where("status = 'diagnostic'").select(null.alias("file_part"), F.lit(0).cast("long").alias("ord"), F.lit("warning").alias("severity"), F.col("reason").alias("message"), null.alias("file_id"), F.lit(None).cast(schema.SPAN).alias("span"))
    graph = replace(graph, diagnostics=graph.diagnostics.unionByName(unread))
    return graph, outcomes.where("status = 'skipped'").select("path", "reason").orderBy("path")


def summarize_path(spark: SparkSession, root: str, repo_id: str | None = None, **how) -> DataFrame:
    """One row of counts and times over a folder's graph, of which nothing is kept."""
    from ..operators import incremental

    return incremental.index_summary(index_path(spark, root, repo_id, **how)[0])


def stream_path(spark: SparkSession, root: str, sink: Callable[[GraphTables], None], repo_id: str | None = None, size: int = 4 * FILES, **how) -> int:
    """Hand a folder's graph to a sink, `size` files at a time in the order of their paths, and return their number.

    A sink gets materialised tables and may keep, write or drop them; what it raises ends the scan.
    """
    from . import extract

    kept = [r["path"] for r in spark.createDataFrame([(p,) for p in _listed(spark, root)], "path string").where(not_ignored("path", ignore_rules(spark, root))).where(X.path_candidate("path") & ~X.is_vendor_or_generated("path")).orderBy("path").collect()]
    done = 0
    for i in range(0, len(kept), size):
        paths = spark.createDataFrame([(p,) for p in kept[i : i + size]], "path string")
        tables = extract.index(sources(classify(contents(spark, root, paths), repo_id or repo_name(root))), **how).materialized()
        sink(tables)
        done += tables.files.count()
    return done


def repo_name(root: str) -> str:
    import hashlib

    return "repo:" + hashlib.sha256((root.rstrip("/") + "\0").encode()).hexdigest()[:24]


def index_changed_paths(spark: SparkSession, root: str, changed: list[str], repo_id: str | None = None, **how):
    """The graph of those of the paths that exist and are indexed; the rest is left out silently. No other file is read."""
    from . import extract

    paths = spark.createDataFrame([(p,) for p in changed], "path string").select(X.normalize_path("path").alias("path")).distinct()
    paths = paths.where(not_ignored("path", ignore_rules(spark, root))).where(X.path_candidate("path") & ~X.is_vendor_or_generated("path"))
    if local_path(root) is None:
        there = [r["path"] for r in paths.collect() if _fs(spark, root)[0].exists(_fs(spark, f"{root.rstrip('/')}/{r['path']}")[1])]
        paths = spark.createDataFrame([(p,) for p in there], "path string")
    files = contents(spark, root, paths).where("error is null")
    return extract.index(sources(classify(files, repo_id or repo_name(root))), **how)
