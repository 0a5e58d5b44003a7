"""Repeated passages by enhanced suffix arrays: maximal repeats with all their occurrences, removed but for the first."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, settle, settled, slices, table, unused, utf8_column
from .jaccard import RANDOM, SLICE, SMALL, mix

#: Bytes of an anchor; of every window's anchors that of the least hash routes it.
ANCHOR = 32
#: No byte of UTF-8; ends a text in a shard.
STOP = 0xFF
#: Bytes of text in a shard's suffix array, about.
SHARD = 1 << 20
#: An anchor with more different surroundings (2.7 MB of them at most) is dealt by window instead of by anchor.
CROWD = 16384


def suffix_array(text: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in the order of their first `longest` bytes, and the ranks by 8, 16, ... bytes that gave it."""
    n = len(text)
    wide = np.full(n + 8, STOP, np.uint64)
    wide[:n] = text
    for h, bits in ((1, 8), (2, 16), (4, 32)):
        wide[: len(wide) - h] = wide[: len(wide) - h] << np.uint64(bits) | wide[h:]
    key, h, levels = wide[:n], 8, []
    while True:
        order = np.argsort(key).astype(np.int32)
        ordered = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]), dtype=np.int32)
        del ordered
        levels.append((h, rank))
        if h >= longest or (n and rank[order[-1]] == n - 1):
            return order, levels
        key = rank.astype(np.uint64) << np.uint64(32)
        key[: max(0, n - h)] |= (rank[h:] + 1).astype(np.uint64)
        h *= 2


def common_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, levels: list[tuple[int, np.ndarray]], room: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of suffixes, none longer than its room."""
    n, out = len(text), np.zeros(len(left), np.int64)
    for h, rank in reversed(levels):
        for _ in range(2 if h == levels[-1][0] else 1):
            a, b = left + out, right + out
            same = (a < n) & (b < n)
            same &= rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]
            out += h * same
    for _ in range(7):
        a, b = left + out, right + out
        out += (a < n) & (b < n) & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
    return np.minimum(out, room)


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of `least` bytes or more within and across texts, none across an end.

    For each, its length and all its occurrences, as text numbers and starts in them. A scan of the
    suffix array's common prefixes with a stack yields the tree of prefix intervals; an interval is a
    maximal repeat if its occurrences differ in the byte before, or one has none.
    """
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.frombuffer(bytes([STOP]).join(texts) + bytes([STOP]), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    place = np.arange(len(text), dtype=np.int32) - starts.astype(np.int32)[owner]
    order, levels = suffix_array(text, int(sizes.max()))
    room = sizes.astype(np.int32)[owner] - place
    array = order[room[order] >= least]
    del order
    if len(array) < 2:
        return []
    lcp = common_prefixes(text, array[:-1], array[1:], levels, np.minimum(room[array[:-1]], room[array[1:]]))
    before = np.where(place[array] > 0, text[array - 1].astype(np.int64), -1)
    near = lcp >= least
    edges = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).astype(np.int8)))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        for length, lo, hi in _intervals(lcp[a:b].tolist(), before[a : b + 1].tolist()):
            found = array[a + lo : a + hi + 1]
            out.append((length, owner[found], place[found]))
    return out


def _intervals(lcp: list[int], before: list[int]) -> list[tuple[int, int, int]]:
    """(length, first, last) of the left-diverse prefix intervals of a stretch of suffixes."""
    if len(lcp) == 1:
        return [(lcp[0], 0, 1)] if before[0] != before[1] or before[0] < 0 else []
    out, stack = [], []
    for i, h in enumerate([*lcp, 0]):
        lo, kind = i, before[i]
        while stack and stack[-1][0] > h:
            length, lo, held = stack.pop()
            kind = held if held == kind else -1
            if kind < 0:
                out.append((length, lo, i))
        if not h:
            break
        if stack and stack[-1][0] == h:
            held = stack[-1][2]
            stack[-1] = (h, stack[-1][1], held if held == kind else -1)
        else:
            stack.append((h, lo, kind))
    return out


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans of each owner (spans that touch become one)."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    _, number = np.unique(owner, return_inverse=True)
    reach = np.maximum.accumulate((number.astype(np.int64) << 40) + end) - (number.astype(np.int64) << 40)
    fresh = np.append(True, (number[1:] != number[:-1]) | (start[1:] > reach[:-1]))
    at = np.flatnonzero(fresh)
    return owner[at], start[at], reach[np.append(at[1:], len(owner)) - 1]


def later_spans(docs: np.ndarray, places: np.ndarray, texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, start, end) of the given pieces of documents that repeat what starts earlier among them.

    A piece may be given more than once, as rows that repeat a doc_id do; what starts at the first's place is the first.
    """
    whose, starts, ends = [], [], []
    for length, owner, place in maximal_repeats(texts, least):
        doc, at = docs[owner], places[owner] + place
        first = np.lexsort((at, doc))[0] if len(doc) > 2 else int((doc[1], at[1]) < (doc[0], at[0]))
        keep = (doc != doc[first]) | (at != at[first])
        whose.append(doc[keep])
        starts.append(at[keep])
        ends.append(at[keep] + length)
    if not whose:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return merged(np.concatenate(whose), np.concatenate(starts), np.concatenate(ends))


def anchored(raw: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of `least` bytes with one anchor: its hash, the first window, their number.

    A window's anchor is the first ANCHOR-byte string in it of the least hash, so equal windows
    have the same at the same place. A run ends with the window that its anchor begins.
    """
    n = len(raw)
    span = least - ANCHOR + 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < least:
        return none
    h, length, m = RANDOM[raw], 1, np.uint64(0xD6E8FEB86659FD93)
    while length < ANCHOR:
        h = h[:-length] * m + h[length:]
        m, length = np.multiply(m, m, dtype=np.uint64), 2 * length
    own, width = mix(h), 1
    h = own
    while 2 * width <= span:
        h, width = np.minimum(h[:-width], h[width:]), 2 * width
    if span > width:
        h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
    inside = np.zeros(n + 1, np.int8)
    big = np.diff(offsets) >= least
    np.add.at(inside, offsets[:-1][big], 1)
    np.add.at(inside, offsets[1:][big] - least + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:n], dtype=np.int8))
    if not len(at):
        return none
    value = h[at]
    fresh = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1) | (own[at[:-1]] == value[:-1])))
    return value[fresh], at[fresh], np.diff(np.append(fresh, len(at)))


def earliest(run: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each distinct run's first occurrence by (doc, at), and of those that repeat one of them (not of the same occurrence given twice)."""
    order = np.argsort(run)
    sorted_ = run[order]
    same = sorted_[1:] == sorted_[:-1]
    many = np.append(same, False) | np.append(False, same) if len(run) else np.zeros(0, bool)
    few = order[many]
    few = few[np.lexsort((at[few], doc[few], run[few]))]
    first = np.append(True, run[few[1:]] != run[few[:-1]])[: len(few)]
    head = few[first][np.cumsum(first) - 1]
    return np.sort(np.append(order[~many], few[first])), few[(doc[few] != doc[head]) | (at[few] != at[head])]


def _runs(docs: DataFrame, least: int, again: bool = False) -> DataFrame:
    """(anchor, run, doc, at): at holds a run's first window and their number, run is a hash of the bytes they cover.

    Of equal runs of a slice of documents only the first by (doc, at) goes on, so a passage that a third of all rows hold
    crosses the network once a slice. again: the others, which thus repeat an earlier one whatever other slices hold.
    """

    @settled
    def go(batches):
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                raw, offsets = utf8_column(b.column(1))
                anchor, start, many = anchored(raw, offsets, least)
                view, digest = memoryview(np.ascontiguousarray(raw)), xxhash.xxh3_64_intdigest
                run = np.array([digest(view[a:z]) for a, z in zip(start.tolist(), (start + many + least - 1).tolist(), strict=True)], np.uint64)
                row = np.searchsorted(offsets, start, "right") - 1
                doc = b.column(0).to_numpy(zero_copy_only=False)[row] if b.num_rows else np.zeros(0, np.int64)
                at = (start - offsets[row]) << 32 | many
                use = earliest(run, doc, at)[again]
                yield pa.RecordBatch.from_arrays([pa.array(x[use].astype(np.int64, copy=False)) for x in (anchor.view(np.int64), run.view(np.int64), doc, at)], names=["anchor", "run", "doc", "at"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(go, "anchor long, run long, doc long, at long")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs with an id in ids (doc), by a broadcast if those are few."""
    held = checkpointed(ids.select("doc").distinct())
    few = held.count() <= SMALL
    return docs.join(F.broadcast(held) if few else held, docs.doc_id == held.doc, "left_semi")


def _pieces(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(anchor, doc, place, piece): the bytes that the wanted runs (anchor, doc, at) cover."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "at")).alias("runs"))
    rows = _only(docs, wanted).join(lists, F.col("doc_id") == F.col("doc")).select("doc", "text", "runs")

    @settled
    def go(batches):
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                raw, offsets = utf8_column(b.column(1))
                data, out = raw.tobytes(), ([], [], [], [])
                for i, (doc, runs) in enumerate(zip(b.column(0).to_pylist(), b.column(2), strict=True)):
                    fields = runs.values
                    start = int(offsets[i])
                    for anchor, at in zip(fields.field(0).to_pylist(), fields.field(1).to_pylist(), strict=True):
                        place, many = at >> 32, at & 0xFFFFFFFF
                        for column, v in zip(out, (anchor, doc, place, data[start + place : start + place + many + least - 1]), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "doc", "place", "piece"])

    return rows.mapInArrow(go, "anchor long, doc long, place long, piece binary")


SPANS = "doc long, start long, end long"


def _by_shard(pieces: DataFrame, least: int) -> DataFrame:
    """Spans from suffix arrays over shards of pieces; those of an anchor stand together, so no repeat is cut."""

    @settled
    def go(batches):
        docs, places, texts, size, last = [], [], [], 0, None

        def flush():
            spans = later_spans(np.array(docs, np.int64), np.array(places, np.int64), texts, least)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in spans], names=["doc", "start", "end"])

        for b in batches:
            for anchor, doc, place, piece in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if anchor != last and size >= SHARD:
                    yield flush()
                    docs, places, texts, size = [], [], [], 0
                    settle()
                last = anchor
                docs.append(doc)
                places.append(place)
                texts.append(piece)
                size += len(piece)
        if texts:
            yield flush()
        settle()

    return pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(go, SPANS)


def _by_window(pieces: DataFrame, least: int) -> DataFrame:
    """Spans of crowded anchors: every window by its digest, summed up before the shuffle, all but the first."""

    @settled
    def go(batches):
        for b in batches:
            keys, docs, at = [], [], []
            for doc, place, piece in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                for j in range(len(piece) - least + 1):
                    keys.append(xxhash.xxh3_128_digest(piece[j : j + least]))
                    docs.append(doc)
                    at.append(place + j)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array(at, pa.int64())], names=["window", "doc", "start"])

    windows = checkpointed(pieces.mapInArrow(go, "window binary, doc long, start long"))
    first = windows.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("c")).where("c > 1")
    again = windows.join(first, "window").where(F.struct("doc", "start") != F.col("first"))
    return again.select("doc", "start", (F.col("start") + least).alias("end"))


def repeated_spans(docs: DataFrame, least: int = 100) -> DataFrame:
    """(doc, spans) of documents (doc_id, text) with bytes that a string of `least` bytes covers which starts earlier.

    Earlier: in a document of smaller doc_id, or before in the same one. Spans (start, end) are in
    bytes; they may overlap. Documents without any are left out.

    Windows of `least` bytes are routed by anchors, of which neighbours share most. A run of windows of one anchor
    that another run equals needs only the earliest of them, which slices of documents settle among theirs before the shuffle;
    different runs of an anchor go to suffix arrays.
    """
    runs = _runs(docs, least).repartition("anchor")
    # every column is used on both sides of the join, so that they read one exchange
    used = [F.max(c).alias(c) for c in ("run", "doc", "at")]
    often = runs.groupBy("anchor").agg(F.count("*").alias("c"), *used).where("c > 1 and run is not null and doc is not null and at is not null").select("anchor")
    again = checkpointed(runs.join(often, "anchor"))
    kinds = checkpointed(again.groupBy("anchor", "run").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("c")))
    at, many = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))
    copies = again.join(kinds.where("c > 1").select("anchor", "run", "first"), ["anchor", "run"]).where(F.struct("doc", "at") != F.col("first"))
    spans = copies.select("doc", at.alias("start"), (at + many + (least - 1)).alias("end")).unionByName(
        _runs(docs, least, again=True).select("doc", at.alias("start"), (at + many + (least - 1)).alias("end"))
    )
    crowds = kinds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1")
    various = checkpointed(kinds.join(crowds, "anchor").select("anchor", F.col("first.doc").alias("doc"), F.col("first.at").alias("at"), "k"))
    spans = spans.unionByName(_by_shard(_pieces(docs, various.where(F.col("k") <= CROWD), least), least))
    if various.where(F.col("k") > CROWD).limit(1).count():
        spans = spans.unionByName(_by_window(_pieces(docs, various.where(F.col("k") > CROWD), least), least))
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _cut(data: bytes, spans) -> tuple[bytes, int, int]:
    """What is left without the spans, the bytes removed, and the maximal runs of them."""
    start = spans.field(0).to_numpy(zero_copy_only=False)
    end = np.minimum(spans.field(1).to_numpy(zero_copy_only=False), len(data))
    _, a, z = merged(np.zeros(len(start), np.int64), start, end)
    edges = [0, *np.column_stack([a, z]).ravel().tolist(), len(data)]
    return b"".join([data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)]), int((z - a).sum()), len(a)


def remove_repeats(docs: DataFrame, least: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of docs (doc_id, text).

    Removes each byte covered by a string of `least` bytes that also starts earlier (see
    repeated_spans), judged on the input. kept is what is left, as bytes; null where nothing was
    removed. A null text is empty. Other columns are ignored. doc_id names a document: rows that repeat one must repeat its text,
    and are the same document; rows without one are kept whole and remove nothing elsewhere. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = checkpointed(repeated_spans(rows, least))
    touched = _only(rows, spans).join(spans, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "spans")

    @settled
    def go(batches):
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                raw, offsets = utf8_column(b.column(1))
                data, out = raw.tobytes(), []
                for i, found in enumerate(b.column(2)):
                    text = data[offsets[i] : offsets[i + 1]]
                    kept, removed, n = _cut(text, found.values)
                    out.append((len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept))
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    changed = touched.mapInArrow(go, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    ids = spans.select("doc").distinct()
    small = F.broadcast(ids) if ids.count() <= SMALL else ids
    whole = rows.join(small, rows.doc_id == F.col("doc"), "left_anti")
    nothing: Column = F.lit(0).cast("long")
    same = whole.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"),
    )
    return changed.unionByName(same)


def strip_repeats(docs: DataFrame, least: int = 100) -> DataFrame:
    """docs with the repeats removed from text, all columns kept, whatever their names (see remove_repeats).

    A character of which a byte is removed goes whole. n_chars, if there is one, is counted anew
    in the documents that change. Rows with a null text, and those without a doc_id, stay as they are.
    """
    spans = checkpointed(repeated_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), least))
    where, what = unused(docs, "_where"), unused(docs, "_repeats")
    found = spans.select(F.col("doc").alias(where), F.col("spans").alias(what))
    ids = found.select(where)
    few = ids.count() <= SMALL
    same = F.col("doc_id").cast("long") == F.col(where)
    whole = docs.join(F.broadcast(ids) if few else ids, same, "left_anti")
    # ids first, as spans are longer than a list that is broadcast may be
    touched = docs.join(F.broadcast(ids) if few else ids, same, "left_semi").join(found, same)

    @settled
    def go(batches):
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                raw, offsets = utf8_column(b.column("text"))
                data = raw.tobytes()
                kept = [_cut(data[offsets[i] : offsets[i + 1]], found.values)[0].decode("utf-8", "ignore") for i, found in enumerate(b.column(what))]
                at = b.schema.get_field_index("text")
                yield b.set_column(at, b.schema.field(at), pa.array(kept, b.schema.field(at).type)).drop_columns([what])

    changed = touched.select(*[F.col(f"`{c}`") for c in docs.columns], what).mapInArrow(go, docs.schema)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(changed)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
