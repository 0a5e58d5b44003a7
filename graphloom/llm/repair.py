"""Token-id shards compressed by Re-Pair grammars, with expansion lengths for random access."""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, utf8_column
from .jaccard import A, B, C, mix
from .media import scratch

MAGIC = b"RPS2"
#: Ids of a shard, about; documents are never cut.
SHARD_IDS = 1 << 20
#: Pairs must occur so often in a shard, without overlaps, to get a rule.
LEAST = 2
#: Symbols between two entries of the index of expanded places.
STEP = 256
#: Stands for a null doc_id, which sorts first.
NULL = -(1 << 63)
#: Distinct pieces of text that a worker remembers; bytes of text handled at once.
REMEMBERED, SLICE = 1_500_000, 4 << 20


def compress(ids: np.ndarray, first: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: rules (a, b) for symbols first, first + 1, ...; their expansion lengths; the reduced sequence.

    Ids must be below first. A round ranks the pairs that occur at least `least` times without overlaps, most
    frequent first, and replaces each occurrence that ranks before both that it overlaps (of a stretch of equal
    ones, every other). Pairs of which fewer than two are left to replace wait. Ends when no pair is left: the
    first in rank is always replaced wherever it was counted.

    Replacing makes no more of a pair of symbols that are there, so a round looks at those places alone whose pair
    was frequent in the last one or has a new symbol. A pair and its place are sorted as one number.
    """
    least = max(least, 2)
    seq = ids.astype(np.uint32)
    active = np.arange(max(0, len(seq) - 1), dtype=np.int32)
    rules, lengths, n_rules = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.uint32), 0
    while len(active):
        a, b = (seq[:-1], seq[1:]) if len(active) == len(seq) - 1 else (seq[active], seq[active + 1])
        place, odd = active, active[:0]
        same = np.flatnonzero(a == b)
        if len(same):
            at, index = active[same], np.arange(len(same))
            fresh = np.append(True, (at[1:] != at[:-1] + 1) | (a[same[1:]] != a[same[:-1]]))
            late = (index - np.maximum.accumulate(np.where(fresh, index, 0))) & 1 == 1
            odd, even = at[late], np.ones(len(active), bool)
            even[same[late]] = False
            even = np.flatnonzero(even)
            place, a, b = place[even], a[even], b[even]
        bits, room = np.uint64((first + n_rules).bit_length()), np.uint64(len(seq).bit_length())
        pairs = a.astype(np.uint64)
        pairs <<= bits
        pairs |= b
        if 2 * bits + room <= 64:
            pairs <<= room
            pairs |= place.astype(np.uint64)
            pairs.sort()
            place = (pairs & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int32)
            pairs >>= room
        else:
            order = np.argsort(pairs, kind="stable")
            pairs, place = pairs[order], place[order]
        starts = np.append(0, np.flatnonzero(pairs[1:] != pairs[:-1]) + 1)
        counts = np.diff(np.append(starts, len(pairs)))
        often = counts >= least
        none = int(often.sum())
        if not none:
            break
        chosen, times = pairs[starts[often]], counts[often]
        order = np.argsort(-times, kind="stable")
        ranks = np.full(len(counts), none, np.int32)
        ranks[np.flatnonzero(often)[order]] = np.arange(none, dtype=np.int32)
        # by place, with one before the first and one after the last; pairs that are not frequent have the last rank
        rank = np.full(len(seq) + 2, none, np.int32)
        rank[place + 1] = np.repeat(ranks, counts)
        rank[odd + 1] = rank[odd]
        own = rank[1:-1]
        take = (own <= rank[:-2]) & (own <= rank[2:]) & (own < none)
        take[odd] = False
        where = np.flatnonzero(take)
        own = own[where]
        used = np.bincount(own, minlength=none) >= 2
        keep = used[own]
        where, own = where[keep], own[keep]
        number = np.cumsum(used, dtype=np.uint32) + np.uint32(first + n_rules - 1)
        seq[where] = number[own]
        new = chosen[order[used]]
        new = np.stack([new >> bits, new & ((np.uint64(1) << bits) - np.uint64(1))], 1).astype(np.uint32)
        size = lambda s: np.where(s < first, 1, np.append(lengths, 0)[np.where(s < first, len(lengths), s.astype(np.int64) - first)])  # noqa: B023, E731
        lengths = np.append(lengths, (size(new[:, 0]) + size(new[:, 1])).astype(np.uint32))
        rules.append(new)
        n_rules += len(new)
        stays, live = np.ones(len(seq), bool), rank[1:-1] < none
        stays[where + 1] = False
        live[where] = live[where - 1] = True
        stays = np.flatnonzero(stays)
        seq, live = seq[stays], live[stays]
        live[-1] = False
        active = np.flatnonzero(live).astype(np.int32)
    return np.concatenate(rules), lengths, seq


def expand(seq: np.ndarray, rules: np.ndarray, first: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids a sequence of symbols stands for: all rules are opened at once, until none is left.

    With the rules' expansion lengths, each symbol is put in its place at once, so depth costs nothing."""
    seq = seq.astype(np.uint32)
    if lengths is not None:
        size = lambda s: np.where(s < first, 1, np.append(lengths, 1)[np.where(s < first, 0, s.astype(np.int64) - first)]).astype(np.int64)
        sizes = size(seq)
        out, at = np.zeros(int(sizes.sum()), np.uint32), np.cumsum(sizes) - sizes
        while len(seq):
            own = seq < first
            out[at[own]] = seq[own]
            body, at = rules[seq[~own].astype(np.int64) - first], at[~own]
            seq, at = np.concatenate([body[:, 0], body[:, 1]]), np.concatenate([at, at + size(body[:, 0])])
        return out
    while True:
        composite = seq >= first
        if not composite.any():
            return seq
        sizes = 1 + composite
        out = np.repeat(seq, sizes)
        place = (np.cumsum(sizes) - sizes)[composite]
        body = rules[seq[composite] - first]
        out[place], out[place + 1] = body[:, 0], body[:, 1]
        seq = out


def write_shard(docs: np.ndarray, counts: np.ndarray, ids: np.ndarray, first: int) -> bytes:
    """A shard: magic; numbers of documents, rules, symbols, ids; first nonterminal; document ids and
    token counts; symbols of the rules, two each, and of the sequence, as planes of their bytes, lowest first; expansion
    lengths; the expanded place of every STEP-th symbol."""
    rules, lengths, seq = compress(ids, first)
    sizes = np.ones(len(seq), np.int64)
    over = seq >= first
    sizes[over] = lengths[seq[over] - first]
    places = np.cumsum(sizes) - sizes
    symbols = np.concatenate([rules.ravel(), seq])
    width = max(1, (int(symbols.max(initial=0)).bit_length() + 7) // 8)
    head = MAGIC + struct.pack("<QQQQIB", len(docs), len(rules), len(seq), len(ids), first, width)
    planes = [np.ascontiguousarray(symbols.astype("<u4").view(np.uint8)[i::4]).tobytes() for i in range(width)]
    return b"".join((head, docs.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), *planes, lengths.astype("<u4").tobytes(), places[::STEP].astype("<u8").tobytes()))


class Shard:
    """Reads a shard; documents decode alone by way of the index of places, or all at once."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        nd, nr, ns, self.n_ids, self.first, width = struct.unpack_from("<QQQQIB", blob, 4)
        at, n = 4 + struct.calcsize("<QQQQIB"), 2 * nr + ns
        parts = []
        for what, many in (("<i8", nd), ("<u4", nd), *[("u1", n)] * width, ("<u4", nr), ("<u8", -(-ns // STEP))):
            parts.append(np.frombuffer(blob, what, many, at))
            at += parts[-1].nbytes
        self.docs, self.counts, *planes, self.lengths, self.places = parts
        symbols = np.zeros((n, 4), np.uint8)
        for i, plane in enumerate(planes):
            symbols[:, i] = plane
        symbols = symbols.reshape(-1).view("<u4")
        self.rules, self.seq = symbols[: 2 * nr].reshape(-1, 2), symbols[2 * nr :]
        self.starts = np.cumsum(self.counts.astype(np.int64)) - self.counts

    def all(self) -> np.ndarray:
        return expand(self.seq, self.rules, self.first, self.lengths)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, expanding only the symbols between two entries of the index."""
        start, end = int(self.starts[i]), int(self.starts[i]) + int(self.counts[i])
        if start == end:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.places, start, "right")) - 1
        b = int(np.searchsorted(self.places, end, "left"))
        ids = expand(self.seq[a * STEP : b * STEP], self.rules, self.first, self.lengths)
        begin = start - int(self.places[a])
        return ids[begin : begin + end - start]


#: Bytes that stand in plain texts: printable ASCII, line ends, and letters of U+00C0 to U+00FF after 0xC3.
PLAIN = np.zeros(256, bool)
PLAIN[[10, 0xC3, *range(32, 127), *range(0x80, 0xC0)]] = True
#: Bytes of a piece that its key holds, as three numbers; longer ones are rare, and looked up by themselves.
KEY = 24
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def plain_texts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have plain bytes alone, and no white space beside white space."""
    before = np.append(np.uint8(0), raw[:-1]) if len(raw) else raw
    space, after = (raw == 32) | (raw == 10), (before == 32) | (before == 10)
    after[offsets[:-1][offsets[:-1] < len(raw)]] = False
    bad = ~PLAIN[raw] | (space & after) | (((raw & 0xC0) == 0x80) & (before != 0xC3))
    out = np.ones(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = False
    return out


class Table:
    """Ids by piece: pieces of KEY bytes at most by their bytes as numbers, in open addressing; others in a dictionary."""

    def __init__(self, size: int = 1 << 16):
        self.slots = np.full(4 * size, -1, np.int32)
        self.keys = np.zeros((3, size), np.uint64)
        self.start, self.many = np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.ids, self.used, self.n = np.zeros(8 * size, np.uint32), 0, 0
        self.long: dict[bytes, int] = {}

    @staticmethod
    def grown(x: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((*x.shape[:-1], size), x.dtype)
        out[..., : x.shape[-1]] = x
        return out

    @staticmethod
    def hash(keys: np.ndarray) -> np.ndarray:
        return mix(mix(mix(keys[0] + A) * B + keys[1]) * C + keys[2])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 for none."""
        room = np.uint64(len(self.slots) - 1)
        slot = (self.hash(keys) & room).astype(np.int64)
        out = self.slots[slot]
        left = np.flatnonzero(out >= 0)
        while len(left):
            e = out[left]
            left = left[(self.keys[0][e] != keys[0][left]) | (self.keys[1][e] != keys[1][left]) | (self.keys[2][e] != keys[2][left])]
            slot[left] = (slot[left] + 1) & int(room)
            out[left] = self.slots[slot[left]]
            left = left[out[left] >= 0]
        return out

    def add(self, keys: np.ndarray | None, found: list[bytes]) -> np.ndarray:
        """New entries with their ids; those with keys, which must be new and differ, can be found by them."""
        many = np.array([len(x) // 4 for x in found], np.int32)
        entry = np.arange(self.n, self.n + len(found))
        total = int(many.sum())
        if self.n + len(found) > len(self.start):
            size = 2 * (self.n + len(found))
            self.keys, self.start, self.many = self.grown(self.keys, size), self.grown(self.start, size), self.grown(self.many, size)
        if self.used + total > len(self.ids):
            self.ids = self.grown(self.ids, 2 * (self.used + total))
        self.ids[self.used : self.used + total] = np.frombuffer(b"".join(found), "<u4")
        self.start[entry], self.many[entry] = self.used + np.cumsum(many) - many, many
        self.n, self.used = self.n + len(found), self.used + total
        if keys is not None:
            self.keys[:, entry] = keys
            self.place(entry)
        return entry

    def place(self, entry: np.ndarray) -> None:
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << int(8 * self.n).bit_length(), -1, np.int32)
            # entries of the dictionary have no keys
            entry = np.setdiff1d(np.arange(self.n), np.fromiter(self.long.values(), np.int64, len(self.long)))
        slot = (self.hash(self.keys[:, entry]) & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            lost = self.slots[slot] != entry
            entry, slot = entry[lost], (slot[lost] + 1) & (len(self.slots) - 1)


class Tokens:
    """Ids of texts from the tokenizers library, which is asked once for each distinct piece of text.

    A library of byte-level pieces splits a text before every space that stands between two characters that are not
    white space, and around a line end that stands alone, so plain texts are cut there; all others, and those with a special
    token, go to it whole, as do all of a library that splits otherwise.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        how = json.loads(self.library.to_str())
        before = how.get("pre_tokenizer") or {}
        self.cuts = how.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.spaced = np.zeros(self.size, bool)
        for token, i in self.library.get_vocab().items():
            self.spaced[i] = token.startswith("\u0120")
        self.table = Table()
        if self.cuts:
            self.line_end = self.library.encode("\n", add_special_tokens=False).ids[0]
            self.points = {c: self.ask([c])[0] for c in ".,"}

    def ask(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def ask_joined(self, pieces: list[str], line_ends: bool) -> list[bytes]:
        """Ids of many pieces in a text. Pieces that start with their one space start at each id that does so;
        pieces without white space are joined by line ends, which have ids of their own."""
        out: list[bytes] = []
        for i in range(0, len(pieces), 4096):
            some = pieces[i : i + 4096]
            text = "\n" + "\n".join(some) if line_ends else "".join(some)
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.line_end if line_ends else self.spaced[ids])
            if len(at) == len(some):
                data, starts, ends = ids.tobytes(), (4 * (at + line_ends)).tolist(), (4 * np.append(at[1:], len(ids))).tolist()
                out += [data[a:b] for a, b in zip(starts, ends, strict=True)]
            else:
                out += self.ask(some)
        return out

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces. Letters and a point or comma after them are apart for the library, so those letters are asked for once."""
        points = self.points
        letters = {p: p[:-1] for p in pieces if p[-1] in points and (p[1:-1] if p[0] == " " else p[:-1]).isalpha()}
        rest = list(dict.fromkeys([letters.get(p, p) for p in pieces]))
        found: dict[str, bytes] = {}
        clean = [p for p in rest if len(p.split()) == 1 and p[-1] > " " and p[1:].isprintable()]
        for line_ends in (False, True):
            some = [p for p in clean if (p[0] == " ") != line_ends]
            found |= zip(some, self.ask_joined(some, line_ends), strict=True)
        other = [p for p in rest if p not in found]
        found |= zip(other, self.ask(other), strict=True)
        return [found[letters[p]] + points[p[-1]] if p in letters else found[p] for p in pieces]

    def entries(self, raw: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's entry of each piece; new pieces are learnt."""
        padded = np.append(raw, np.zeros(KEY, np.uint8))
        eight = np.ndarray((len(raw) + KEY - 7,), "<u8", padded, strides=(1,))
        size = ends - starts
        keys = np.stack([eight[starts + 8 * i] & MASKS[np.clip(size - 8 * i, 0, 8)] for i in range(3)])
        short = size <= KEY
        out = np.full(len(starts), -1, np.int32)
        out[short] = self.table.find(keys[:, short])
        fresh = np.flatnonzero(short & (out < 0))
        if len(fresh):
            order = fresh[np.lexsort(keys[:, fresh])]
            first = np.append(True, (keys[:, order[1:]] != keys[:, order[:-1]]).any(0))
            heads = order[first]
            new = self.table.add(keys[:, heads], self.ids_of([data[a:z].decode() for a, z in zip(starts[heads].tolist(), ends[heads].tolist(), strict=True)]))
            out[order] = new[np.cumsum(first) - 1]
        for i in np.flatnonzero(~short).tolist():
            piece = data[starts[i] : ends[i]]
            if piece not in self.table.long:
                self.table.long[piece] = int(self.table.add(None, self.ask([piece.decode()]))[0])
            out[i] = self.table.long[piece]
        return out

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, each with the end id if there is one; and how many each has."""
        raw, offsets = utf8_column(column)
        raw = np.ascontiguousarray(raw)
        data, n = raw.tobytes(), len(offsets) - 1
        plain = plain_texts(raw, offsets) if self.cuts else np.diff(offsets) == 0
        for s in self.special:
            at = data.find(s)
            while at >= 0:
                plain[np.searchsorted(offsets, at, "right") - 1] = False
                at = data.find(s, at + 1)
        if self.table.n > REMEMBERED:
            self.table = Table()
        counts = np.zeros(n, np.int64)
        ids = np.zeros(0, np.uint32)
        if plain.any() and len(raw):
            cut = (raw == 32) | (raw == 10)
            cut[1:] |= raw[:-1] == 10
            cut[offsets[:-1][np.diff(offsets) > 0]] = True
            starts = np.flatnonzero(cut)
            doc = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, offsets)))
            ends = np.append(starts[1:], len(raw))
            use = plain[doc]
            starts, ends, doc = starts[use], ends[use], doc[use]
            e = self.entries(raw, data, starts, ends)
            many, first = self.table.many[e], self.table.start[e]
            ids = self.table.ids[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            counts = np.bincount(doc, many, n).astype(np.int64)
        rest = np.flatnonzero(~plain)
        whole = self.ask([data[offsets[i] : offsets[i + 1]].decode() for i in rest])
        counts[rest] = [len(x) // 4 for x in whole]
        total = counts + (end is not None)
        begin = np.cumsum(total) - total
        out = np.full(int(total.sum()), end or 0, np.uint32)
        own = counts * plain
        out[np.arange(len(ids)) + np.repeat(begin - (np.cumsum(own) - own), own)] = ids
        for i, x in zip(rest.tolist(), whole, strict=True):
            out[begin[i] : begin[i] + counts[i]] = np.frombuffer(x, "<u4")
        return out, total


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokens(path)


SHARDS = "part int, shard int, first_doc long, n_ids long, blob binary"


def write(docs: DataFrame, out: str, tokenizer: str, end: int = 0) -> DataFrame:
    """Encode (doc_id, text), append the end id to each document, write compressed shards to out.

    Documents are range-partitioned by doc_id and sorted within a part, so parts and shards in their order hold
    documents in ascending order (null first); those with equal ids are ordered by text. A null
    text is empty: its document holds the end id alone. Returns the shard table as read back.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def shards(batches):
        from pyspark import TaskContext

        first, part = max(tokens(tokenizer).size, end + 1), TaskContext.get().partitionId()
        number, held, size = 0, [], 0

        def flush():
            nonlocal number, held, size
            names, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            blob = write_shard(names, counts, ids, first)
            row = [[part], [number], [int(names[0])], [int(counts.sum())], [blob]]
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "shard", "first_doc", "n_ids", "blob"])

        for whole in batches:
            for batch in slices(whole, "text", SLICE, "repair", tokens.cache_clear):
                names = batch.column(0).fill_null(NULL).to_numpy()
                ids, counts = tokens(tokenizer).encode(batch.column(1), end)
                ends = np.cumsum(counts)
                done = 0
                while done < len(names):
                    # the document that fills the shard ends it
                    at = ends[done - 1] if done else 0
                    upto = min(len(names), int(np.searchsorted(ends, at + SHARD_IDS - size)) + 1)
                    held.append((names[done:upto], counts[done:upto], ids[at : ends[upto - 1]]))
                    size += int(ends[upto - 1] - at)
                    done = upto
                    if size >= SHARD_IDS:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(shards, SHARDS).write.mode("overwrite").option("compression", "zstd").parquet(out)
    return spark.read.schema(SHARDS).parquet(out)


def read(stored: DataFrame) -> DataFrame:
    """Per document of a shard table: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts are summed in three steps (in a shard, over a part's shards, over parts), so no
    task sees more than the shards of one part, or one row a part.
    """

    def open_shards(batches):
        for batch in batches:
            for part, shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = Shard(blob)
                ids = s.all().astype("<u4")
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(s.starts.tolist(), s.counts.tolist(), strict=True)]
                n = len(s.docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(s.docs), pa.array(s.starts), pa.array(s.counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    rows = stored.select("part", "shard", "blob").mapInArrow(open_shards, "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    sizes = stored.groupBy("part", "shard").agg(F.sum("n_ids").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", earlier(Window.orderBy("part")).alias("part_start"))
    starts = sizes.withColumn("in_part", earlier(Window.partitionBy("part").orderBy("shard"))).join(parts, "part").select("part", "shard", (F.col("in_part") + F.col("part_start")).alias("shard_start"))
    return rows.join(starts, ["part", "shard"]).select(F.when(F.col("doc_id") != NULL, F.col("doc_id")).alias("doc_id"), (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read(write(table(spark, sf_dir, "documents"), scratch(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json")))
