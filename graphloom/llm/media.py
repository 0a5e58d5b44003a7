"""ISO media containers: write 8-bit sample tracks, walk boxes, decode sample tables, list keyframes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ensure_checkpoint_dir, slices, table

#: Bytes of a sample, samples of a chunk (each chunk's first sample is a sync sample), samples a second.
SAMPLE, CHUNK, TIMESCALE = 64, 16, 8000
#: Bytes of texts or media handled at once.
HELD = 4 << 20
#: Boxes that hold boxes; stsd and dref hold theirs after a version and a count.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
COUNTED = {b"stsd", b"dref"}


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return struct.pack(">I4s", size, kind) + b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """A file with one track of unsigned 8-bit mono samples that holds the payload as it is.

    The payload must be a positive multiple of SAMPLE bytes. Depends on nothing else, so equal payloads give equal files.
    """
    n = len(payload) // SAMPLE
    if not n or n * SAMPLE != len(payload):
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomqt  ")
    mdat = box(b"mdat", payload)
    start = len(ftyp) + len(mdat) - len(payload)
    chunks, last = -(-n // CHUNK), n % CHUNK
    stsc = [(1, CHUNK, 1)] if not last else [(1, last, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, last, 1)]
    places = start + np.arange(chunks, dtype=np.int64) * (CHUNK * SAMPLE)
    wide = bool(places[-1] >= 1 << 32)
    sync = 1 + np.arange(chunks, dtype=np.int64) * CHUNK
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
        full(b"stss", struct.pack(">I", chunks), sync.astype(">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(stsc)), np.array(stsc, ">u4").tobytes()),
        full(b"stsz", struct.pack(">II", SAMPLE, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
    )
    length = struct.pack(">Q", len(payload))
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
    mdhd = full(b"mdhd", bytes(16), struct.pack(">I", TIMESCALE), length, struct.pack(">HH", 0x55C4, 0), version=1)
    hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0")
    tkhd = full(b"tkhd", bytes(16), struct.pack(">II", 1, 0), length, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7)
    mvhd = full(b"mvhd", bytes(16), struct.pack(">I", TIMESCALE), length, struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
    return b"".join((ftyp, mdat, box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))))


def boxes(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box below, outer before inner: its path of kinds, and where its body starts and ends.

    A size of 1 is followed by 64 bits, a size of 0 reaches to the end. Stops at a box that doesn't fit.
    """
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            return
        here = (*path, kind)
        yield here, body, stop
        if kind in CONTAINERS:
            yield from boxes(data, body, stop, here)
        elif kind in COUNTED:
            yield from boxes(data, body + 8, stop, here)
        start = stop


def probe(media: bytes | None) -> dict | None:
    """Codec, duration, sample count and keyframe byte ranges of the first track with whole tables, from its tables alone.

    The payload is never read. Null, or bytes without such a track, give None: also a table that is cut off, tables that
    disagree on the number of samples or chunks, and samples that lie outside of the bytes. Without an stss box every
    sample is a sync sample.
    """
    if media is None:
        return None
    data = memoryview(media)
    for path, body, stop in boxes(data, 0, len(data)):
        if path[-1] == b"trak":
            try:
                found = _track(data, body, stop)
            except (struct.error, ValueError, IndexError):
                found = None
            if found is not None:
                return found
    return None


def _track(data: memoryview, start: int, end: int) -> dict | None:
    found: dict = {}
    for path, body, stop in boxes(data, start, end, (b"moov", b"trak")):
        if path[-2] == b"stsd":
            found.setdefault("codec", path[-1].decode("latin-1"))
        found.setdefault(path[-1], (body, stop))
    if not {b"mdhd", b"stts", b"stsc", b"stsz"} <= found.keys() or "codec" not in found or not ({b"stco", b"co64"} & found.keys()):
        return None

    def entries(kind: bytes, width: str, wide: int = 1, skip: int = 4) -> np.ndarray:
        at, stop = found[kind]
        n = struct.unpack_from(">I", data, at + skip)[0] * wide
        if at + skip + 4 + n * np.dtype(width).itemsize > stop:
            raise ValueError("a table is cut off")
        return np.frombuffer(data, width, n, at + skip + 4).astype(np.int64)

    at = found[b"mdhd"][0]
    scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
    fixed, n = struct.unpack_from(">II", data, found[b"stsz"][0] + 4)
    places = entries(b"stco", ">u4") if b"stco" in found else entries(b"co64", ">u8")
    runs = entries(b"stsc", ">u4", 3).reshape(-1, 3)
    steps = entries(b"stts", ">u4", 2).reshape(-1, 2)
    many = np.diff(np.append(runs[:, 0], len(places) + 1))
    if (many < 0).any() or int((runs[:, 1] * many).sum()) != n or int(steps[:, 0].sum()) != n:
        return None
    sizes = np.full(n, fixed, np.int64) if fixed else entries(b"stsz", ">u4", skip=8)
    per = np.repeat(runs[:, 1], many)
    chunk = np.repeat(np.arange(len(places)), per)
    ahead = np.cumsum(sizes) - sizes
    firsts = np.cumsum(per) - per
    offsets = places[chunk] + ahead - ahead[firsts[chunk]] if n else ahead
    sync = entries(b"stss", ">u4") - 1 if b"stss" in found else np.arange(n)
    if n and (int((offsets + sizes).max()) > len(data) or int(offsets.min()) < 0) or len(sync) and not 0 <= int(sync.min()) <= int(sync.max()) < n:
        return None
    return {
        "codec": found["codec"], "timescale": scale, "duration": duration, "samples": n, "ticks": int((steps[:, 0] * steps[:, 1]).sum()),
        "offsets": offsets, "sizes": sizes, "key_offsets": offsets[sync], "key_sizes": sizes[sync],
    }


def payload_of(media: bytes, tables: dict) -> bytes:
    """The samples' bytes in order, read where the tables say they are."""
    offsets, sizes = tables["offsets"], tables["sizes"]
    if not len(offsets):
        return b""
    cut = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut, len(offsets)) - 1
    return b"".join(media[offsets[i] : offsets[j] + sizes[j]] for i, j in zip(first.tolist(), last.tolist(), strict=True))


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(1, -(-len(raw) // SAMPLE)) * SAMPLE - len(raw))


STORED = "doc_id long, n_bytes long, media binary"


def store(docs: DataFrame, path: str) -> DataFrame:
    """Write a media column for (doc_id, text) as a table at path, and read it back.

    A null text is stored as an empty one: one sample of zeros. Other columns are ignored; repeated
    rows give repeated rows; an empty table gives an empty result.
    """

    def to_media(batches):
        for whole in batches:
            for batch in slices(whole, "text", HELD):
                raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
                media = pa.array([mux(padded(t)) for t in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in raw], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    rows.mapInArrow(to_media, STORED).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(STORED).parquet(path)


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "codec string, duration_s double, keyframes array<struct<offset: long, length: long>>"
)


def features(stored: DataFrame) -> DataFrame:
    """Digests of a stored media column with what its sample tables say: codec, duration, keyframe byte ranges.

    stored: doc_id, n_bytes, media; other columns are ignored. Media that probe() gives nothing for, nulls and empty ones
    among them, get null in all but doc_id, n_bytes and the length and digest of the media itself (of no bytes for a
    null). Rows are independent, repeated ones repeat; an empty table gives an empty result. About HELD bytes of media
    are held at once, or one row.
    """

    def read(batches):
        for batch in (b for whole in batches for b in slices(whole, "media", HELD)):
            out = []
            for doc, n, media in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                t = probe(media)
                if t is None:
                    out.append((doc, n, None, None, None, len(media or b""), hashlib.sha256(media or b"").hexdigest(), None, None, None, None))
                    continue
                payload = payload_of(media, t)
                keys = list(zip(t["key_offsets"].tolist(), t["key_sizes"].tolist(), strict=True))
                feature = f"{t['codec']}|{t['duration']}/{t['timescale']}|samples={t['samples']}|sync={len(keys)}|first={keys[0][0]}+{keys[0][1]}|last={keys[-1][0]}+{keys[-1][1]}" if keys else f"{t['codec']}|0"
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature,
                            t["codec"], t["duration"] / max(1, t["timescale"]), [{"offset": a, "length": b} for a, b in keys]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 11
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, FEATURES)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents"), scratch(spark, "media")))
