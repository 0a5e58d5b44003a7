"""Language-model scores by a weighted backoff automaton over words, whose counts stay distributed."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, slices, table
from .jaccard import A, B, C, mix

#: Stand after and before a token sequence; no token holds them.
END, START = b"\n", b" "
#: Bytes of text of a block; tokens of a lane of the traversal.
SLICE, LANE = 8 << 20, 384
#: Words of context at most.
CONTEXT = 2
#: A shorter context's distribution counts as so many observations beside a context of one word, and of two.
WEIGHTS = (4096.0, 2.0)
#: Bits that codes of n-grams have beyond those it takes to number all n-grams: an n-gram meets another's code once in 2**SPARE look-ups.
SPARE = 24
#: Codes counted in one part, about.
PART = 4 << 20


def tokens(text: str | None) -> list[bytes]:
    """Lower-case A-Z, split at bytes 0x20 and 0x09-0x0D."""
    return text.encode("utf-8").lower().split() if text else []


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as separately compressed planes of their bytes, lowest first, as many as it takes."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    n = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    blobs = [squeeze(np.ascontiguousarray(planes[:, i]).tobytes()) for i in range(n)]
    return b"".join([struct.pack("<qB", len(values), n), *(struct.pack("<I", len(b)) + b for b in blobs)])


def unpack(data: bytes) -> np.ndarray:
    size, n = struct.unpack_from("<qB", data)
    planes, at = np.zeros((size, 8), np.uint8), 9
    expand = zstandard.ZstdDecompressor().decompress
    for i in range(n):
        length = struct.unpack_from("<I", data, at)[0]
        planes[:, i] = np.frombuffer(expand(data[at + 4 : at + 4 + length]), np.uint8)
        at += 4 + length
    return planes.reshape(-1).view("<u8")


def ordered(values: np.ndarray, bits: int) -> np.ndarray:
    """The order of unsigned numbers of so many bits: as many of the leading bits as there is room for are sorted
    beside the place, as one number; the few that these leave out of order are swapped."""
    room = len(values).bit_length()
    short = np.uint64(max(0, bits + room - 64))
    mask = np.uint64((1 << room) - 1)
    order = (np.sort((values >> short) << np.uint64(room) | np.arange(len(values), dtype=np.uint64)) & mask).astype(np.int32 if room < 32 else np.int64)
    while short and len(bad := np.flatnonzero((found := values[order])[1:] < found[:-1])):
        bad = bad[np.append(True, np.diff(bad) > 1)]
        order[bad], order[bad + 1] = order[bad + 1], order[bad]
    return order


def tally(codes: np.ndarray, bits: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Distinct codes in order, the sums of their weights, and the place among them of each code."""
    order = ordered(codes, bits)
    sorted_ = codes[order]
    fresh = np.append(True, sorted_[1:] != sorted_[:-1])[: len(codes)]
    at = np.flatnonzero(fresh)
    place = np.empty(len(codes), np.int32)
    place[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return sorted_[at], None if weights is None else np.add.reduceat(weights[order], at) if len(at) else weights[:0], place


class Known(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def digests(words) -> np.ndarray:
    """64-bit digests, which stand for the words."""
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)


@dataclass
class Block:
    """Token sequences, each with an end, as places among their sorted distinct digests: by token, its word."""

    digests: np.ndarray
    word: np.ndarray
    lengths: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], held: np.ndarray) -> Block:
        known = Known({END: 0})
        places, lengths, end = [], [], np.zeros(1, np.int32)
        for text in texts:
            found = tokens(text)
            places += [np.fromiter(map(known.__getitem__, found), np.int32, len(found)), end]
            lengths.append(len(found) + 1)
        names, _, rank = tally(digests(known), 64)
        return cls(names, rank[np.concatenate(places)] if places else rank[:0], np.array(lengths, np.int64), held)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    @property
    def taught(self) -> np.ndarray:
        """1 for each token of a training sequence, 0 for others."""
        return np.repeat(~self.held, self.lengths).astype(np.float64)

    def ngrams(self) -> Ngrams:
        """The distinct n-grams of the block. An n-gram of two or three ends at each token with as many before it, of which a start is one."""
        size = len(self.digests) + 1
        wide = np.uint64(size)
        before = np.append(self.word[:1], self.word[:-1]).astype(np.uint64)
        before[self.starts] = wide - np.uint64(1)
        two, _, of_two = tally(before * wide + self.word.astype(np.uint64), 2 * size.bit_length())
        del before
        inner = np.ones(len(self.word), bool)
        inner[self.starts] = False
        at = np.flatnonzero(inner)
        three, _, of_three = tally(of_two[at - 1].astype(np.uint64) * wide + self.word[at].astype(np.uint64), len(two).bit_length() + size.bit_length())
        last = np.empty(len(three), np.int32)
        last[of_three] = of_two[at]
        return Ngrams(size, two, of_two, three, of_three, at, last)


@dataclass
class Ngrams:
    """two: word before, times size, and word; three: place of the first two words in two, times size, and word; of_two,
    of_three: place by token, of those at `at` for three; last: place in two of the last two words of three."""

    size: int
    two: np.ndarray
    of_two: np.ndarray
    three: np.ndarray
    of_three: np.ndarray
    at: np.ndarray
    last: np.ndarray

    def parts(self, three: bool) -> tuple[np.ndarray, np.ndarray]:
        context, word = np.divmod(self.three if three else self.two, np.uint64(self.size))
        return context.astype(np.int32), word.astype(np.int32)

    def codes(self, names: np.ndarray, bits: int) -> np.ndarray:
        """Codes of all words, then n-grams of two, then of three."""
        every = np.append(names, np.uint64(xxhash.xxh3_64_intdigest(START)))
        context, word = self.parts(False)
        pairs = mix(mix(every + A)[context] * B + every[word])
        context, word = self.parts(True)
        triples = mix(pairs[context] * C + every[word])
        return np.concatenate([mix(names * A + C), pairs, triples]) >> np.uint64(64 - bits)

    def counts(self, block: Block) -> np.ndarray:
        """How often the block's training sequences hold each."""
        taught = block.taught
        return np.concatenate([np.bincount(block.word, taught, self.size - 1), np.bincount(self.of_two, taught, len(self.two)), np.bincount(self.of_three, taught[self.at], len(self.three))]).astype(np.int64)


@dataclass
class Automaton:
    """States are contexts: none (0), each word (1 + its place; that of a start last), and each n-gram of two that training holds.

    Arcs carry a word's log10 probability and the next state, the longest suffix that is a state. A failure arc
    leads to the context without its oldest word, at the price of a weight. State 0 has an arc for each word, the first ones.
    """

    size: int
    keys: np.ndarray
    slots: np.ndarray
    goes: np.ndarray
    gains: np.ndarray
    fail: np.ndarray
    price: np.ndarray

    @classmethod
    def build(cls, grams: Ngrams, counts: np.ndarray, sequences: int, total: int, types: int) -> Automaton:
        """counts: in all of training, in the order of codes(); sequences: of training; total, types: tokens there, and distinct ones.

        A word seen c times of `total` has (c + 1) / (total + types + 1): one type stands for all that is unseen. After a context
        seen t times, a word seen n times there has (n + weight * what the shorter context gives it) / (t + weight).
        """
        size, words = grams.size, grams.size - 1
        one, two, three = np.split(counts, [words, words + len(grams.two)])
        of_one = (one + 1) / (total + types + 1)
        seen = np.append(one, sequences)
        context, word = grams.parts(False)
        of_two = (two + WEIGHTS[0] * of_one[word]) / (seen[context] + WEIGHTS[0])
        pair, third = grams.parts(True)
        of_three = (three + WEIGHTS[1] * of_two[grams.last]) / (two[pair] + WEIGHTS[1])
        state = np.where(two > 0, 1 + size + np.arange(len(two), dtype=np.int32), 1 + word)
        use_two, use_three = two > 0, three > 0
        keys = np.concatenate([np.arange(words), (1 + context[use_two]) * np.int64(size) + word[use_two], (1 + size + pair[use_three]) * np.int64(size) + third[use_three]])
        goes = np.concatenate([1 + np.arange(words, dtype=np.int32), state[use_two], state[grams.last[use_three]]])
        gains = np.log10(np.concatenate([of_one, of_two[use_two], of_three[use_three]]))
        fail = np.concatenate([np.zeros(1 + size, np.int32), 1 + word])
        price = np.log10(np.concatenate([[1.0], WEIGHTS[0] / (seen + WEIGHTS[0]), WEIGHTS[1] / (two + WEIGHTS[1])]))
        slots = np.full(1 << max(4, int(2 * len(keys)).bit_length()), -1, np.int32)
        left = np.arange(words, len(keys), dtype=np.int32)
        slot = cls.slot(keys[words:], len(slots))
        while len(left):
            free = slots[slot] < 0
            slots[slot[free]] = left[free]
            lost = slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(slots) - 1)
        return cls(size, keys, slots, goes, gains, fail, price)

    @staticmethod
    def slot(key: np.ndarray, room: int) -> np.ndarray:
        return (key.astype(np.uint64) * A >> np.uint64(65 - room.bit_length())).astype(np.int64)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each lane goes and the log10 probability it gains: along failure arcs until a state has the word."""
        gained, arc = np.zeros(len(state)), word.copy()
        lanes, now = np.flatnonzero(state), state[state > 0]
        while len(lanes):
            key = now * np.int64(self.size) + word[lanes]
            slot = self.slot(key, len(self.slots))
            got = self.slots[slot]
            miss = np.flatnonzero((got >= 0) & (self.keys[got] != key))
            while len(miss):
                slot[miss] = (slot[miss] + 1) & (len(self.slots) - 1)
                got[miss] = self.slots[slot[miss]]
                miss = miss[(got[miss] >= 0) & (self.keys[got[miss]] != key[miss])]
            hit = got >= 0
            arc[lanes[hit]] = got[hit]
            lanes, now = lanes[~hit], now[~hit]
            gained[lanes] += self.price[now]
            now = self.fail[now]
            lanes, now = lanes[now > 0], now[now > 0]
        return self.goes[arc], gained + self.gains[arc]

    def traverse(self, word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each sequence.

        All sequences are traversed from left to right at once, long ones in lanes. A state depends on CONTEXT
        words, so a lane that starts inside a sequence reads those first.
        """
        if not len(lengths):
            return np.zeros(0)
        starts = np.cumsum(lengths) - lengths
        lanes = -(-lengths // LANE)
        of = np.repeat(np.arange(len(lanes)), lanes)
        begin = starts[of] + (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        length = np.minimum(begin + LANE, (starts + lengths)[of]) - begin
        order = np.argsort(-length, kind="stable")
        of, begin, length = of[order], begin[order], length[order]
        sums, state = np.zeros(len(of)), np.zeros(len(of), np.int32)
        live = np.searchsorted(-length, -np.arange(LANE), "left")
        for t in range(-CONTEXT, int(length[0])):
            n = live[t] if t > 0 else len(of)
            if t == 0:
                state[begin == starts[of]] = self.size
            # what a sequence's first lane reads before its start does not count
            state[:n], gained = self.step(state[:n], word[begin[:n] + t])
            if t >= 0:
                sums[:n] += gained
        return np.bincount(of, sums, len(lengths))


BLOCK = "block long, docs array<long>, held array<boolean>, lengths array<long>, digests binary, places binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def gathered(batches) -> Iterator[pa.RecordBatch]:
    """Batches with a text column as larger ones of about SLICE bytes of text; texts that stand together ask for fewer n-grams."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for b in slices(whole, "text", SLICE):
            more = b.column("text").nbytes
            if held and size + more > SLICE:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(b)
            size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def opened(b: pa.RecordBatch | pa.Table, i: int = 0) -> Block:
    row = b.slice(i, 1)
    digests = np.cumsum(unpack(row.column("digests")[0].as_py()), dtype=np.uint64)
    lists = [np.array(row.column(c)[0].as_py(), kind) for c, kind in (("lengths", np.int64), ("held", bool))]
    return Block(digests, unpack(row.column("places")[0].as_py()).astype(np.int32), *lists)


def parted(codes: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each of `parts` even ranges of all codes begins among these, which are in order; and their number."""
    return np.searchsorted(codes, np.array([-(-(j << bits) // parts) for j in range(parts)], np.uint64)).tolist() + [len(codes)]


def evaluate(docs: DataFrame, held_out: Column, part: int = PART) -> DataFrame:
    """Score every (doc_id, text) with a model of the texts for which held_out is false.

    A null text is empty: its one token is the end. Rows are independent, repeated ones repeat and
    count again in training; a null held_out counts as false. Other columns are ignored; an empty
    table gives an empty result. base_score: log10 probability of the tokens and an end
    under add-one smoothed unigrams, which have one type for all that is unseen. score: the same tokens by
    the automaton of all n-grams of up to three words; after any context, the known words and the one type sum to 1.

    No n-gram is left out and none goes to the driver. A block of documents asks for its distinct n-grams by sorted
    codes, dealt by ranges of the codes to parts; a part sums up what blocks counted and answers each with what the
    others did. A part holds about `part` codes, and a hot n-gram once a block. From the answers a block builds the
    states and arcs that its texts can meet, and traverses them. Codes are as long as a fixed chance of confusion takes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))

    def to_words(batches):
        for b in gathered(batches):
            counts, every = Counter({END: 0}), b.num_rows
            for text, held in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = tokens(text)
                every += len(found)
                if not held:
                    counts.update(found)
                    counts[END] += 1
            n = np.array(list(counts.values()), np.int64)
            ends = np.zeros((2, len(n)), np.int64)
            ends[:, 0] = counts[END], every
            names = digests(counts)
            del counts
            settle()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names.view(np.int64), n, *ends)], names=["word", "c", "s", "every"])

    words = rows.mapInArrow(to_words, "word long, c long, s long, every long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("every").alias("every"))
    total, types, sequences, every = (x or 0 for x in words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum("s"), F.sum("every")).first())
    bits = min(64, (2 * every).bit_length() + SPARE)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-2 * every // part))

    def to_blocks(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in gathered(batches):
            held = b.column(2).to_numpy(zero_copy_only=False)
            block = Block.of(b.column(1).to_pylist(), held)
            row = [[number], [b.column(0).to_pylist()], [held.tolist()], [block.lengths], [pack(np.diff(block.digests, prepend=np.uint64(0)))], [pack(block.word)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            del block
            settle()
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["block", "docs", "held", "lengths", "digests", "places"])
            number += 1

    # both readers of the blocks use every column, so that they read one exchange
    blocks = rows.mapInArrow(to_blocks, BLOCK).repartition(least, "block")

    def to_asked(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = opened(batch, i)
                grams = block.ngrams()
                codes, counts, _ = tally(grams.codes(block.digests, bits), bits, grams.counts(block))
                del grams, block
                cuts = parted(codes, bits, parts)
                name = batch.column(0)[i].as_py()
                for j, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if a < z:
                        out = [pa.array([j], pa.int32()), pa.array([name], pa.int64()), pa.array([pack(np.diff(codes[a:z], prepend=np.uint64(0)))], pa.binary()), pa.array([pack(counts[a:z])], pa.binary())]
                        yield pa.RecordBatch.from_arrays(out, names=["part", "block", "codes", "counts"])
                settle()

    def to_answers(batches):
        def answers(part, names, codes, counts):
            sizes = list(map(len, codes))
            own = np.concatenate(counts)
            _, sums, place = tally(np.concatenate(codes), bits, own)
            others = np.split(sums[place] - own, np.cumsum(sizes)[:-1])
            blobs = [pack(x) for x in others]
            settle()
            for a in range(0, len(names), 64):
                some = slice(a, a + 64)
                yield pa.RecordBatch.from_arrays([pa.array(names[some], pa.int64()), pa.array([part] * len(names[some]), pa.int32()), pa.array(blobs[some], pa.binary())], names=["block", "part", "others"])

        last, names, codes, counts = None, [], [], []
        for b in batches:
            for j, name, x, c in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if j != last and names:
                    yield from answers(last, names, codes, counts)
                    names, codes, counts = [], [], []
                last = j
                names.append(name)
                codes.append(np.cumsum(unpack(x), dtype=np.uint64))
                counts.append(unpack(c).astype(np.int64))
        if names:
            yield from answers(last, names, codes, counts)

    asked = blocks.mapInArrow(to_asked, "part int, block long, codes binary, counts binary")
    answered = asked.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(to_answers, "block long, part int, others binary")

    def to_rows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({})
        block = opened(left.combine_chunks())
        grams = block.ngrams()
        _, own, place = tally(grams.codes(block.digests, bits), bits, grams.counts(block))
        order = np.argsort(right.column("part").to_numpy())
        counts = own + np.concatenate([unpack(right.column("others")[int(i)].as_py()).astype(np.int64) for i in order])
        counts = counts[place]
        del own, place
        automaton = Automaton.build(grams, counts, sequences, total, types)
        seen = counts[: grams.size - 1]
        starts, lengths = block.starts, block.lengths
        of = lambda x: np.add.reduceat(x[block.word], starts)
        out = [left.column("docs").combine_chunks().flatten(), pa.array(block.held), pa.array(lengths), pa.array(of((seen > 0).astype(np.int64))), pa.array(np.full(len(lengths), total, np.int64)), pa.array(of(np.log10((seen + 1.0) / (total + types + 1.0)))), pa.array(automaton.traverse(block.word, lengths))]
        del automaton, grams, block, counts
        settle()
        return pa.Table.from_arrays(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.groupBy("block").cogroup(answered.repartition(least, "block").groupBy("block")).applyInArrow(to_rows, SCORES)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return evaluate(docs, fold == 2)
