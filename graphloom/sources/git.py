"""Changes and sources of two commits from git, which runs on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

#: Objects that a task reads, about.
OBJECTS = 200
#: Status letters of name-status output.
STATUS = {"A": "added", "D": "removed", "M": "modified", "R": "renamed", "C": "copied", "T": "type-changed"}


def parse_name_status(raw: bytes) -> list[tuple[str, str, str | None]]:
    """(change, path, old_path) of NUL-separated name-status output, by path; other letters raise."""
    fields = raw.decode("utf-8", "surrogateescape").split("\0")
    if fields and fields[-1] == "":
        fields.pop()
    out, it = [], iter(fields)
    for status in it:
        change = STATUS.get(status[:1])
        if change is None:
            raise ValueError(f"unsupported status {status!r}")
        try:
            first = next(it)
            old, path = (first, next(it)) if change in ("renamed", "copied") else (None, first)
        except StopIteration:
            raise ValueError(f"status {status!r} lacks a path") from None
        out.append((change, path, old))
    return sorted(out, key=lambda x: (x[1], x[2] is not None, x[2] or ""))


class GitRepository:
    def __init__(self, path: str):
        self.path = path
        self.top = self.run("rev-parse", "--show-toplevel").decode().strip()

    def run(self, *args: str) -> bytes:
        done = subprocess.run(["git", "-C", self.path, *args], capture_output=True, check=False)
        if done.returncode:
            raise RuntimeError(f"git {' '.join(args)}: {done.stderr.decode(errors='replace').strip()}")
        return done.stdout

    def resolve(self, ref: str) -> str:
        return self.run("rev-parse", "--verify", f"{ref}^{{commit}}").decode().strip()

    def changes(self, spark: SparkSession, base: str, head: str) -> DataFrame:
        rows = parse_name_status(self.run("diff", "--name-status", "-z", "-M", self.resolve(base), self.resolve(head)))
        return spark.createDataFrame(rows, "change string, path string, old_path string")

    def contents(self, spark: SparkSession, ref: str) -> DataFrame:
        """(path, content) of a commit's files, without a checkout.

        The driver ships object ids; tasks read the objects, each through one git process, so the repository's
        folder must be one that the executors see. Submodules are left out.
        """
        listed = self.run("ls-tree", "-r", "-z", self.resolve(ref)).decode("utf-8", "surrogateescape").split("\0")
        rows = [(name, meta.split()[2]) for meta, _, name in (x.partition("\t") for x in listed if x) if meta.split()[1] == "blob"]
        top = self.top

        def read(batches):
            for batch in batches:
                ids = batch["object"].tolist()
                done = subprocess.run(["git", "-C", top, "cat-file", "--batch"], input="".join(f"{x}\n" for x in ids).encode(), capture_output=True, check=True).stdout
                at, found = 0, []
                for _ in ids:
                    end = done.index(b"\n", at)
                    size = int(done[at:end].split()[2])
                    found.append(done[end + 1 : end + 1 + size])
                    at = end + 2 + size
                yield batch[["path"]].assign(content=found)

        objects = spark.createDataFrame(rows, "path string, object string")
        return objects.repartition(max(1, min(200, len(rows) // OBJECTS + 1))).mapInPandas(read, "path string, content binary")


def short_commit(commit: str) -> str:
    return commit[:12]
