"""Change events of files as a stream, coalesced after quiet, which keep a stored graph up to date."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

from ..functions import expr as X

EVENTS = "path string, kind string, at timestamp"
#: Seconds: of quiet that end a batch of changes, between two looks, that a batch waits at most.
DEBOUNCE, POLL, MAX_WAIT = 0.15, 0.05, 30.0


def listing(root: str, without: str | None = None) -> dict[str, tuple[int, int]]:
    """(modified, size) by relative path of the files below root, but for hidden ones and those in the folder `without`."""
    out = {}
    root = os.path.realpath(root)
    without = os.path.realpath(without) if without else None
    for folder, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".") and os.path.join(folder, d) != without]
        for name in files:
            if name.startswith("."):
                continue
            full = os.path.join(folder, name)
            try:
                s = os.stat(full)
            except OSError:
                continue
            out[os.path.relpath(full, root)] = (s.st_mtime_ns, s.st_size)
    return out


def changes(before: dict, now: dict) -> list[tuple[str, str]]:
    """(path, kind) of what differs between two listings; unlike the built-in file source, a file that changes again shows again."""
    out = [(p, "changed" if p in before else "created") for p, s in now.items() if before.get(p) != list(s)]
    return sorted(out + [(p, "removed") for p in before if p not in now])


def until_quiet(look: Callable[[], dict], before: dict, quiet: float, most: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The listing once nothing has changed for `quiet` seconds, or `most` seconds after the first change; at once if nothing differs from before."""
    now = look()
    if not changes(before, now):
        return now
    first = last = clock()
    while clock() - last < quiet and clock() - first < most:
        sleep(min(POLL, quiet))
        again = look()
        if again != now:
            now, last = again, clock()
    return now


class FileChanges(DataSource):
    """Source 'file-changes': options root, quiet and max_wait (seconds), without (a folder to leave out), initial
    (false: only changes from now on). A burst of changes is one batch: it ends after a time of quiet, or when it has
    waited long enough. Its offset is the listing, so a restart continues where it ended."""

    @classmethod
    def name(cls) -> str:
        return "file-changes"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema) -> DataSourceReader:
        return _Once(self.options["root"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


class _Once(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def read(self, partition) -> Iterator[tuple]:
        yield from _rows(changes({}, listing(self.root)))


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.look = lambda: listing(options["root"], options.get("without"))
        self.quiet, self.most = float(options.get("quiet", DEBOUNCE)), float(options.get("max_wait", MAX_WAIT))
        self.initial = str(options.get("initial", "true")).lower() == "true"

    def initialOffset(self) -> dict:
        return {"files": json.dumps({} if self.initial else {k: list(v) for k, v in self.look().items()})}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = until_quiet(self.look, json.loads(start["files"]), self.quiet, self.most)
        return iter(_rows(changes(json.loads(start["files"]), now))), {"files": json.dumps({k: list(v) for k, v in now.items()})}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        now = {k: tuple(v) for k, v in json.loads(end["files"]).items()}
        return iter(_rows(changes(json.loads(start["files"]), now)))


def _rows(found: list[tuple[str, str]]) -> list[tuple]:
    import datetime

    at = datetime.datetime.now(datetime.timezone.utc)
    return [(p, k, at) for p, k in found]


def debounce(events: DataFrame, gap: str, key: str, at: str = "ts", watermark: str | None = None) -> DataFrame:
    """Sessions of events a key, closed after a gap of quiet: their distinct paths are what to index again."""
    if watermark:
        events = events.withWatermark(at, watermark)
    return events.groupBy(F.col(key), F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))


def coalesce_paths(events: DataFrame) -> DataFrame:
    return events.select("path").where("path is not null").distinct().orderBy("path")


def candidates(paths: DataFrame) -> DataFrame:
    """Paths worth indexing."""
    return paths.where(X.path_candidate("path") & ~X.is_vendor_or_generated("path"))


def maintain(spark: SparkSession, root: str, store, repo_id: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: plan what a batch touches, extract it again, replace its partitions, delete what is gone."""
    from ..operators import integrity
    from ..sources import discovery

    def batch(events: DataFrame, number: int) -> None:
        kinds = events.groupBy("path").agg(F.max_by("kind", "at").alias("kind"))
        touched = candidates(kinds.where("kind <> 'removed'").select("path"))
        plan = [r["path"] for r in store.plan_reindex(touched).collect()]
        gone = kinds.where("kind = 'removed'").select("path")
        removed = store.load_latest().files.join(gone, "path", "left_semi").select("file_id")
        if plan or removed.limit(1).count():
            changed = discovery.index_changed_paths(spark, root, plan, repo_id).materialized()
            problems = [r["problem"] for r in integrity.foreign_nodes(changed.nodes).unionByName(integrity.symbols_without_file(changed.nodes)).limit(3).collect()]
            if problems:
                raise ValueError("; ".join(problems))
            store.replace_partitions(changed, removed)

    return batch


def watch(spark: SparkSession, root: str, store, checkpoint: str, once: bool = False, repo_id: str | None = None, quiet: float = DEBOUNCE, max_wait: float = MAX_WAIT, initial: bool = True):
    """Start the query that keeps store up to date with root; once: what there is now, then stop.

    initial: index what is there first; else only what changes from now on. The store's own folder is not watched.
    """
    spark.dataSource.register(FileChanges)
    options = {"root": root, "without": store.root, "quiet": str(quiet), "max_wait": str(max_wait), "initial": str(initial)}
    stream = spark.readStream.format("file-changes").options(**options).load()
    writer = stream.writeStream.foreachBatch(maintain(spark, root, store, repo_id)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{int(1000 * POLL)} milliseconds")).start()
