"""N-gram Jaccard join by token-combination prefixes, with classes of linked documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, keep, settled, slices, table, utf8_column

#: A token in more candidates' prefixes is frequent.
FREQUENT = 8
#: Size classes of token combinations grow by this factor.
GROWTH = 1.25
#: Shingles and documents of a block in which a family of candidates is compared, about.
BLOCK, MEMBERS = 1 << 19, 1024
#: Bytes of text handled at once.
SLICE = 1 << 20
#: A list of ids of so many rows at most (4 MB, about 16 MB as a table in memory) is broadcast; beyond, the join shuffles.
SMALL = 500_000

FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
RANDOM = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * B
    h = (h ^ (h >> np.uint64(27))) * C
    return h ^ (h >> np.uint64(31))


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text column, A-Z lower-cased, and n + 1 offsets by text."""
    raw, offsets = utf8_column(column)
    raw = FOLD[raw]
    inside = ~SPACE[raw]
    fresh = inside.copy()
    if len(raw):
        first = np.zeros(len(raw), bool)
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        fresh[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(fresh)
    per_text = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), per_text
    place = np.arange(len(raw)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(raw)]])))
    power = np.cumprod(np.full(int(place[starts[0] :].max()) + 1, A))
    value = np.where(inside, RANDOM[raw] * power[np.minimum(place, len(power) - 1)], np.uint64(0))
    length = np.add.reduceat(inside.astype(np.uint64), starts)
    return mix(np.add.reduceat(value, starts) + length * C), per_text


def shingle_sets(column, k: int) -> list[np.ndarray]:
    """Each text's distinct shingles of k words, as sorted hashes; of fewer words, all of them as one."""
    words, offsets = word_hashes(column)
    n = len(words)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        ahead = words[j:] if j else words
        acc[: n - j] = mix(acc[: n - j] * A + ahead)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(acc[a : b - k + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                h = mix(h * C + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@dataclass(frozen=True)
class Bound:
    """Jaccard similarity of at least num / den. Prefixes are extended by `extra` quarters of their length:
    the more shingles documents share by chance, as short ones do, the more it takes to tell."""

    num: int
    den: int
    extra: int = 3

    def least(self, n: int) -> int:
        """Shared tokens that a set of n has at least with any it links to; also that one's size."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def extension(self, n: int) -> int:
        """Tokens that prefixes extended by so many, less one, share."""
        return max(1, self.extra * self.prefix(n) // 4)

    def links(self, shared, a, b):
        return self.den * shared >= self.num * (a + b - shared)

    def need(self, n: int) -> int:
        """Tokens that the extended prefixes of a set of n and of any it links to share at least."""
        return self.extension(self.least(n)) if n else 0

    def classes(self, n: int) -> list[tuple[int, int]]:
        """(class, groups) of size classes in which a set of n meets those it links to: the larger one's class.

        The groups are fewer than the shared tokens that all pairs of the class have at least, by a quarter of those.
        """
        out, low, number = [], 1, 0
        while self.den * n >= self.num * low:
            high = max(low + 1, int(np.ceil(low * GROWTH)))
            if n < high:
                out.append((number, 3 * self.need(self.least(low)) // 4))
            low, number = high, number + 1
        return out


def combinations(sizes: np.ndarray, counts: np.ndarray, tokens: np.ndarray, bound: Bound) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) for the frequent tokens of extended prefixes: of each set its size, how many they are, and they, one set after another.

    In each of a set's size classes its tokens are dealt to groups by hash, and every combination of two tokens of a group is a key.
    Two sets of the class that share more tokens than there are groups share two of one group. Where there are no
    groups, as short sets share too few tokens, each token is a key.
    """
    of, group, width, value = [], [], [], []
    ends = np.cumsum(counts)
    spread = mix(tokens ^ A)
    for i, (n, a, z) in enumerate(zip(sizes.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True)):
        for number, groups in bound.classes(n):
            of.append(np.full(z - a, i))
            group.append((spread[a:z] % np.uint64(max(1, groups))).astype(np.int64) | number << 32)
            width.append(np.full(z - a, groups > 0))
            value.append(tokens[a:z])
    if not of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, group, paired, value = map(np.concatenate, (of, group, width, value))
    salt = mix(group.astype(np.uint64) + C)
    owners, keys = [of[~paired]], [mix((value + salt)[~paired])]
    of, group, value, salt = of[paired], group[paired], value[paired], salt[paired]
    order = np.lexsort((value, group, of))
    of, group, value, salt = of[order], group[order], value[order], salt[order]
    for ahead in range(1, len(of)):
        at = np.flatnonzero((of[ahead:] == of[:-ahead]) & (group[ahead:] == group[:-ahead]))
        if not len(at):
            break
        owners.append(of[at])
        keys.append(mix(mix(value[at] + salt[at]) * B + value[at + ahead]))
    return np.concatenate(owners), np.concatenate(keys).view(np.int64)


def linked(ids: list[int], sets: list[np.ndarray], bound: Bound, second: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (doc, smallest doc) that span the classes of linked sets among these, or of those with a link from the first half to the second.

    A set with a whole prefix of tokens that no other of these sets has links to none. The overlaps of one set with
    all others are counted at once from the lists of sets by token. One set and those it links to are a class, of
    which nothing more needs to be known among its own; only the other sets' overlaps are counted.
    """
    sizes = np.array([len(s) for s in sets])
    if len(sets) < 2:
        return []
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, inverse, df = np.unique(tokens, return_inverse=True, return_counts=True)
    alone = np.bincount(owner, df[inverse] == 1, len(sets))
    live = np.flatnonzero(alone < np.array([bound.prefix(n) for n in sizes.tolist()]))
    if len(live) < 2:
        return []
    place = np.full(len(sets), -1)
    place[live] = np.arange(len(live))
    use = (place[owner] >= 0) & (df[inverse] > 1)
    row, column = place[owner[use]], inverse[use]
    first = np.searchsorted(row, np.arange(len(live) + 1))
    holders = row[np.argsort(column, kind="stable")]
    until = np.cumsum(np.bincount(column, minlength=len(df)))
    names, n = np.array(ids)[live], sizes[live]
    half = np.zeros(len(live), bool) if second is None else second[live]
    label = np.arange(len(live))

    def links(i: int) -> np.ndarray:
        own = column[first[i] : first[i + 1]]
        ends = until[own]
        starts = np.append(0, until)[own]
        many = ends - starts
        at = np.arange(many.sum()) + np.repeat(starts - (np.cumsum(many) - many), many)
        shared = np.bincount(holders[at], minlength=len(live))
        return np.flatnonzero((shared > 0) & bound.links(shared, n[i], n))

    def join(i: int, others: np.ndarray) -> None:
        met = np.unique(label[np.append(others, i)])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]

    tries = np.unique([int(np.argmin(names)), len(live) // 2, len(live) - 1])
    found = [links(i) for i in tries]
    for i, others in zip(tries.tolist(), found, strict=True):
        join(i, others)
    inner = label == label[max(zip(map(len, found), tries.tolist(), strict=True))[1]]
    for i in np.flatnonzero(~inner):
        others = links(i)
        join(i, others if second is None else others[half[others] != half[i]])
    least = np.full(len(live), np.iinfo(np.int64).max)
    np.minimum.at(least, label, names)
    least = least[label]
    return [(int(x), int(y)) for x, y in zip(names, least, strict=True) if x != y]


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc is one of the ids (id); these are broadcast if they are few."""
    few = ids.limit(SMALL + 1).count() <= SMALL
    return rows.join(F.broadcast(ids) if few else ids, rows.doc == ids.id, "left_semi")


def with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows joined on doc = id with a list that is broadcast if it is short."""
    few = ids.limit(SMALL + 1).count() <= SMALL
    return rows.join(F.broadcast(ids) if few else ids, rows.doc == ids.id)


def _prefix_edges(tokens: DataFrame, bound: Bound) -> DataFrame:
    """Edges (doc, smallest doc) of documents that share a prefix token in the order of rarity.

    tokens: (doc, n, tok), all of each candidate's set. Tokens that one candidate alone has come first, the
    others by how many have them; so a set with a whole prefix of its own has no edge, and what
    sets share in their prefixes is as rare as can be.
    """
    # counted before the shuffle, and joined so that a token that very many hold can be split
    held = tokens.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
    sets = tokens.join(held, "tok").groupBy("doc").agg(F.min("n").alias("n"), F.count("*").alias("s"), F.array_sort(F.collect_list(F.struct("c", "tok"))).alias("shared"))
    least = F.floor((F.col("n") * bound.num + (bound.den - 1)) / F.lit(bound.den))
    left = (F.col("s") - least + 1).cast("int")
    prefix = checkpointed(sets.where(left > 0).select("doc", F.explode(F.slice("shared", F.lit(1), left)).alias("x")).select("doc", F.col("x.tok").alias("tok")))
    met = prefix.groupBy("tok").agg(F.count("*").alias("c"), F.min("doc").alias("b")).where("c > 1")
    return prefix.join(met, "tok").select(F.col("doc").alias("a"), "b")


def _signatures(docs: DataFrame, k: int, bound: Bound) -> DataFrame:
    @settled
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                sets = shingle_sets(b.column(1), k)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                heads = [s[: bound.prefix(len(s)) + bound.extension(len(s)) - 1].view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                need = [bound.need(len(s)) for s in sets]
                sizes = np.array([0, *map(len, heads)], np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(need, pa.int32()), flat], names=["doc", "n", "digest", "need", "head"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc long, n long, digest binary, need int, head array<long>")


def _keys(frequent: DataFrame, bound: Bound) -> DataFrame:
    """(doc, key) of the token combinations of (doc, n, toks)."""

    @settled
    def run(batches):
        for b in batches:
            keep(None)
            toks = b.column(2)
            of, keys = combinations(b.column(1).to_numpy(), np.diff(toks.offsets.to_numpy()), toks.flatten().to_numpy().view(np.uint64), bound)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(keys, pa.int64())], names=["doc", "key"])

    return frequent.select("doc", "n", "toks").mapInArrow(run, "doc long, key long")


def _tokens(members: DataFrame, k: int) -> DataFrame:
    """(doc, n, tok): all tokens of (doc, text)."""

    @settled
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                sets = shingle_sets(b.column(1), k)
                sizes = [len(s) for s in sets]
                doc = b.column(0).to_numpy(zero_copy_only=False).repeat(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.repeat(sizes, sizes).astype(np.int64)), pa.array(np.concatenate(sets).view(np.int64))], names=["doc", "n", "tok"])

    return members.select("doc", "text").mapInArrow(run, "doc long, n long, tok long")


def _sets(members: DataFrame, k: int) -> DataFrame:
    """(doc, family, blocks, tokens): the sets of (doc, text, family, blocks) as bytes."""

    @settled
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                sets = [s.tobytes() for s in shingle_sets(b.column(1), k)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(sets, pa.binary())], names=["doc", "family", "blocks", "tokens"])

    return members.mapInArrow(run, "doc long, family long, blocks int, tokens binary")


def _compare(dealt: DataFrame, bound: Bound) -> DataFrame:
    """Edges among the sets of each (family, lo, hi), which stand together in their partition."""

    @settled
    def run(batches):
        key, ids, sets, blocks = None, [], [], []

        def edges():
            _, lo, hi = key or (None, 0, 0)
            found = linked(ids, sets, bound, np.array(blocks) == hi if lo != hi else None)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            for i, now in enumerate(keys):
                if now != key:
                    yield edges()
                    key, ids, sets, blocks = now, [], [], []
                ids.append(b.column(3)[i].as_py())
                sets.append(np.frombuffer(b.column(4)[i].as_py(), np.uint64))
                blocks.append(b.column(5)[i].as_py())
        yield edges()

    return dealt.select("family", "lo", "hi", "doc", "tokens", "block").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Classes of documents whose sets of k-word shingles link: Jaccard similarity of num / den or more.

    docs: doc_id, text; other columns are ignored. Words are runs without white space, A-Z in
    lower case; a text of fewer than k words is one shingle. Returns, for each row, doc_id,
    n_shingles and component_id, the smallest doc_id that links reach. Null, empty or blank texts have no
    shingles and link with nothing; a row without a doc_id is in no component. Repeated rows
    are one document. An empty table gives an empty result.

    Equal sets are one. Tokens are ordered by hash. In linked sets, prefixes extended by e - 1 share e
    tokens, so only documents with that many tokens that others' prefixes hold too go on. Of the e tokens that a linked
    pair of these shares, a quarter is rare, and rare tokens are indexed alone, under FREQUENT documents at most;
    or more are frequent than there are groups of tokens, and frequent ones are indexed by combinations of two of a group,
    so that one is in common. Among documents that an entry joins to another, prefixes in the order of rarity
    connect families; a family is compared in blocks of a bounded number of documents and shingles, and only edges that span
    its classes leave a block.
    """
    bound = Bound(num, den, 3 if k < 4 else 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named_rows = rows.where("doc_id is not null").withColumnRenamed("doc_id", "doc")
    signed = checkpointed(_signatures(rows, k, bound))
    named = signed.where("doc is not null and digest is not null")
    classes = checkpointed(named.groupBy("digest").agg(F.min("doc").alias("rep")))
    reps = among(named, classes.select(F.col("rep").alias("id")))

    heads = reps.select("doc", F.explode("head").alias("tok")).repartition("tok")
    # every column is used on both sides of the join, so that they read one exchange
    shared = heads.groupBy("tok").agg(F.count("*").alias("c"), F.min("doc").alias("b")).where("c > 1 and b is not null").select("tok")
    counts = heads.join(shared, "tok").groupBy("doc").agg(F.count("*").alias("c"))
    needs = reps.groupBy("doc").agg(F.min("need").alias("need"))
    going = checkpointed(counts.join(needs, "doc").where("c >= need").select(F.col("doc").alias("id")))
    tokens = checkpointed(among(reps, going).select("doc", "n", "need", F.explode("head").alias("tok")))
    held = tokens.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
    met = tokens.join(held, "tok")
    few = met.where(F.col("c") <= FREQUENT).groupBy("tok").agg(F.array_sort(F.collect_set(F.struct("doc", "need"))).alias("d"))
    pair = lambda x, y: F.struct(x["doc"].alias("b"), y["doc"].alias("a"), F.greatest(x["need"], y["need"]).alias("need"))
    pairs = F.flatten(F.transform("d", lambda x, i: F.transform(F.slice("d", i + 2, F.size("d")), lambda y: pair(x, y))))
    rare = few.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("c"), F.max("p.need").alias("need")).where("4 * c >= need").select("a", "b")

    frequent = met.where(F.col("c") > FREQUENT).groupBy("doc").agg(F.min("n").alias("n"), F.sort_array(F.collect_set("tok")).alias("toks"))
    keyed = checkpointed(_keys(frequent, bound))
    shares = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("doc").alias("b")).where("c > 1")
    edges = rare.unionByName(keyed.join(shares, "key").select(F.col("doc").alias("a"), "b"))
    met_ids = checkpointed(edges.where("a <> b").select(F.explode(F.array("a", "b")).alias("id")).distinct())
    families = checkpointed(connected_components(_prefix_edges(_tokens(among(named_rows, met_ids), k), bound)).withColumnRenamed("component", "family"))

    sizes = families.join(signed.select(F.col("doc").alias("node"), "n"), "node").groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / MEMBERS)).cast("int").alias("blocks"))
    places = checkpointed(families.join(sizes, "family").select(F.col("node").alias("id"), "family", "blocks"))
    members = _sets(with_ids(named_rows, places).select("doc", "text", "family", "blocks"), k)
    block = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc", "tokens", "block").repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")
    components = connected_components(_compare(dealt, bound))

    back = signed.select("doc", "n", "digest").join(classes, "digest", "left").join(components, F.col("rep") == F.col("node"), "left")
    return back.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc").alias("component_id")).withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=9, den=10)
