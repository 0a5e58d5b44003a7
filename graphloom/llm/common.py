"""Shared pieces of the training-data operators: checkpoints, connected components, text columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; a local one only where none is set (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawn(rows: DataFrame, key: str, n: int, sample: int) -> DataFrame:
    """About `sample` of n rows, a quarter more at most: those whose key's digest is below their share of all digests.

    No row is sorted or sent anywhere to be left out, and reruns draw the same.
    """
    if n > sample:
        rows = rows.where(F.xxhash64(key) < F.lit(-(1 << 63) + (1 << 64) * sample // n))
    return rows.limit(sample + sample // 4)


#: Edges of components up to which their minima are broadcast.
FEW_EDGES = 500_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected edge list (a, b) with the smallest node it reaches.

    Alternates large-star and small-star steps, as joins against a pre-aggregated minimum, so
    that a hub is never collected in one task. Null ends and loops are ignored; an empty edge
    list gives an empty result. Returns (node, component) for every node of an edge.
    """
    a, b = F.col("a"), F.col("b")
    edges = checkpointed(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = signature(edges)
    for _ in range(max_rounds):
        if not now[0]:
            break
        # the minima have no more rows than there are edge ends; few of them need no shuffle of the edges
        sent = F.broadcast if now[0] <= FEW_EDGES else (lambda df: df)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = (
            both.where("v > u").join(sent(low), "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(sent(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        edges = checkpointed(small)
        before, now = now, signature(edges)
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def utf8_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and n + 1 offsets into it; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("") if not pa.types.is_binary(column.type) else column.fill_null(b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  another C library may lack it
except (OSError, AttributeError):
    _LIBC = None

#: A space beside other white space.
CROWDED = regex.compile(r" \s|\s ")


def cut_at_spaces(text: str | None) -> list[str] | None:
    """Pieces of a text, cut before each space and around each line end; None if white space stands beside a space.

    The byte-level splitting patterns start anew at every space between two characters that are not
    white space, and take a single line end there alone, so pieces can be encoded apart. Texts of printable
    characters, spaces and line ends alone need no search; without two line ends in a row, they are cut at those too.
    """
    if not text:
        return []
    if "\0" in text:
        return None
    plain = "  " not in text and " \n" not in text and "\n " not in text and text.replace("\n", "").isprintable()
    if not plain and CROWDED.search(text):
        return None
    if plain and "\n\n" not in text:
        text = text.replace("\n", "\0\n\0")
    parts = text.replace(" ", "\0 ").split("\0")
    return parts[not parts[0] : len(parts) - (not parts[-1])]


def settle() -> None:
    """Give freed memory back to the system; the allocators of a long-lived worker would keep it."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def settled(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives back what its task freed; it would hold that while it waits for another task."""

    def go(batches):
        yield from run(batches)
        settle()

    return go


#: Who keeps what it learnt in this worker for its next task, and how to let go of it.
_KEEPER: list = [None, None]


def keep(owner: str | None, release: Callable[[], None] | None = None) -> None:
    """Say what a worker keeps between tasks; what another operator kept is released first."""
    if _KEEPER[0] != owner:
        if _KEEPER[1] is not None:
            _KEEPER[1]()
            gc.collect()
            settle()
        _KEEPER[:] = [owner, release]


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20, owner: str | None = None, release: Callable[[], None] | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row slices whose text column holds about `most` bytes; one row is never cut.

    owner and release are for keep(): an operator that keeps nothing makes the worker let go of what others kept.
    """
    keep(owner, release)
    lengths = np.diff(utf8_column(batch.column(column))[1])
    start, total = 0, 0
    for i, size in enumerate(lengths.tolist()):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            settle()
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)
        settle()
