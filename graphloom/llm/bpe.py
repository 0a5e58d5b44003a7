"""Byte-level BPE by DuckDB: recursive queries contract pairs, ordered aggregation decodes."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_at_spaces, keep, settled, slices, table

#: Distinct pieces of text that a worker remembers; beyond, it keeps only those of its slice at hand.
REMEMBERED = 1_000_000
#: Bytes of text whose distinct words one recursive query encodes.
SLICE = 16 << 20
#: The same two of a thrifty worker.
THRIFTY_REMEMBERED, THRIFTY_SLICE = 100_000, 512 << 10

#: Words of a query, as it holds the rows of all its steps.
WORDS = 50_000
#: Longer words contract all pairs of the least rank in a step, so that a run of one letter takes few steps.
SHORT = 48
#: start: a row for each byte of each word, with its next row's place and token. key: rank, place and
#: next place of a row's pair, so that a word's least key is its leftmost pair of the least rank, whose
#: whole goes to the place of the right part. Rows of finished words leave the recursion.
ENCODE = """
WITH RECURSIVE state AS (
    SELECT word, pos, tok, next_pos, next_tok, (rank::BIGINT << 40) | (pos::BIGINT << 20) | next_pos AS key, true AS open
    FROM start LEFT JOIN merges m ON m.pair = (tok::BIGINT << 32) | next_tok
  UNION ALL
    SELECT word, pos, tok, next_pos, next_tok, CASE WHEN open THEN (rank::BIGINT << 40) | (pos::BIGINT << 20) | next_pos END, open
    FROM (
      SELECT s.word, s.pos, least IS NOT NULL AS open,
        CASE WHEN s.pos = least & 1048575 THEN (least >> 40)::INTEGER ELSE tok END AS tok,
        CASE WHEN next_pos = (least >> 20) & 1048575 THEN (least & 1048575)::INTEGER ELSE next_pos END AS next_pos,
        CASE WHEN next_pos = (least >> 20) & 1048575 THEN (least >> 40)::INTEGER ELSE next_tok END AS next_tok
      FROM state s JOIN (SELECT word, min(key) AS least FROM state WHERE open GROUP BY word) c ON s.word = c.word
      WHERE least IS NULL OR s.pos <> (least >> 20) & 1048575)
    LEFT JOIN merges m ON m.pair = (tok::BIGINT << 32) | next_tok)
SELECT word, list(tok ORDER BY pos) AS ids FROM state WHERE NOT open GROUP BY word
"""
ENCODE_LONG = """
WITH RECURSIVE state AS (
    SELECT word, pos, tok, 0 AS step, true AS open FROM start
  UNION ALL
    SELECT word, pos, CASE WHEN chosen THEN merged ELSE tok END, step + 1, least IS NOT NULL FROM (
      SELECT *, coalesce(lag(chosen) OVER w, false) AS gone FROM (
        SELECT *, coalesce(rank = least, false) AND (row_number() OVER (PARTITION BY word, island ORDER BY pos)) % 2 = 1 AS chosen FROM (
          SELECT *, count(*) FILTER (WHERE rank IS DISTINCT FROM before) OVER w AS island FROM (
            SELECT *, lag(rank) OVER w AS before FROM (
              SELECT word, pos, tok, step, merged, rank, min(rank) OVER (PARTITION BY word) AS least
              FROM (SELECT word, pos, tok, step, lead(tok) OVER w AS next FROM state WHERE open WINDOW w AS (PARTITION BY word ORDER BY pos)) s
              LEFT JOIN merges m ON m.pair = (s.tok::BIGINT << 32) | s.next)
            WINDOW w AS (PARTITION BY word ORDER BY pos))
          WINDOW w AS (PARTITION BY word ORDER BY pos)))
      WINDOW w AS (PARTITION BY word ORDER BY pos))
    WHERE NOT gone)
SELECT word, list(tok ORDER BY pos) AS ids FROM state WHERE NOT open GROUP BY word
"""


def known_pattern() -> str | None:
    """The splitting pattern that cut_at_spaces() goes with."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return None
    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes and decodes distinct words with one in-memory DuckDB; made once in a worker process.

    The merge table holds every split of a vocabulary entry in two entries, with the whole's rank.
    A word that is itself an entry is that entry. Of any other, each step contracts the pairs of
    the least rank, from the left, without overlap: no pair that a contraction makes can rank
    lower than its parts allow, so this ends where contracting one pair at a time does.
    """

    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = read_ranks(path)
        self.cuts = pattern == known_pattern()
        self.pieces: dict[str, bytes] = {}
        self.back: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False})
        merges = [(self.ranks[w[:i]], self.ranks[w[i:]], r) for w, r in self.ranks.items() if len(w) > 1 for i in range(1, len(w)) if w[:i] in self.ranks and w[i:] in self.ranks]
        a, b, r = zip(*merges, strict=True) if merges else ((), (), ())
        pairs = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "rank": pa.array(r, pa.int32())})
        vocab = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks.keys(), pa.binary())})
        self.db.register("pairs", pairs)
        self.db.execute("CREATE TABLE merges AS SELECT (a::BIGINT << 32) | b AS pair, rank, rank AS merged FROM pairs")
        self.db.register("vocab_rows", vocab)
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab_rows")
        self.bytes_of = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each distinct word; a byte without an entry has no id, and raises."""
        out: list = [[r] if (r := self.ranks.get(w)) is not None else [] for w in words]
        short = [i for i, w in enumerate(words) if 2 <= len(w) <= SHORT and not out[i]]
        long = [i for i, w in enumerate(words) if len(w) > SHORT and not out[i]]
        for query, chosen, step in ((ENCODE, short, WORDS), (ENCODE_LONG, long, WORDS // 16)):
            for first in range(0, len(chosen), step):
                some = chosen[first : first + step]
                lengths = np.array([len(words[i]) for i in some], np.int32)
                tokens = self.bytes_of[np.frombuffer(b"".join([words[i] for i in some]), np.uint8)]
                if tokens.min() < 0:
                    raise ValueError("the vocabulary lacks a byte")
                starts = np.cumsum(lengths) - lengths
                ends = np.zeros(len(tokens), bool)
                ends[starts + lengths - 1] = True
                place = np.arange(len(tokens), dtype=np.int32) - np.repeat(starts, lengths).astype(np.int32)
                start = pa.table({"word": np.repeat(np.array(some, np.int32), lengths), "pos": place, "tok": tokens, "next_pos": pa.array(place + 1, mask=ends), "next_tok": pa.array(np.append(tokens[1:], 0).astype(np.int32), mask=ends)})
                self.db.register("start", start)
                found = self.db.sql(query).to_arrow_table()
                self.db.unregister("start")
                ids = found.column(1).combine_chunks()
                values, ends = ids.values.to_numpy().tolist(), ids.offsets.to_numpy().tolist()
                for i, a, b in zip(found.column(0).to_pylist(), ends, ends[1:], strict=False):
                    out[i] = values[a:b]
        return out

    def decode_words(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids, aggregated in the order of their positions."""
        lengths = np.array([len(x) for x in ids], np.int64)
        tokens = np.array([t for x in ids for t in x], np.int32)
        starts = np.cumsum(lengths) - lengths
        self.db.register("coded", pa.table({"word": np.repeat(np.arange(len(ids), dtype=np.int32), lengths), "pos": np.arange(len(tokens)) - np.repeat(starts, lengths), "tok": tokens}))
        found = self.db.sql("SELECT word, list(bytes ORDER BY pos) FROM coded JOIN vocab USING (tok) GROUP BY word").to_arrow_table()
        self.db.unregister("coded")
        out = [b""] * len(ids)
        parts = found.column(1).combine_chunks()
        values, ends = parts.values.to_pylist(), parts.offsets.to_numpy().tolist()
        for i, a, b in zip(found.column(0).to_pylist(), ends, ends[1:], strict=False):
            out[i] = b"".join(values[a:b])
        return out

    def split(self, text: str | None) -> list[str]:
        """Pieces of a text, none of which cuts a match of the pattern: cut at spaces for the pattern that is known to start
        anew there, and its matches for any other."""
        parts = cut_at_spaces(text) if self.cuts else None
        return self.pattern.findall(text or "") if parts is None else parts

    def learn(self, pieces: set[str], most: int = REMEMBERED) -> None:
        """Encode what is new among the pieces, decode the ids again, and remember both; beyond `most`, what else was remembered goes."""
        if len(self.pieces) > most:
            kept = [p for p in pieces if p in self.pieces]
            self.pieces, self.back = {p: self.pieces[p] for p in kept}, {p: self.back[p] for p in kept}
        new = {p: self.pattern.findall(p) for p in pieces.difference(self.pieces)}
        words = list({w for ws in new.values() for w in ws})
        ids = self.encode_words([w.encode("utf-8") for w in words])
        coded = dict(zip(words, (",".join(map(str, i)).encode() for i in ids), strict=True))
        decoded = dict(zip(words, self.decode_words(ids), strict=True))
        for p, ws in new.items():
            self.pieces[p] = b",".join([coded[w] for w in ws])
            self.back[p] = b"".join([decoded[w] for w in ws])

    def decoded(self, parts: list[str]) -> bytes:
        """What the ids of learnt pieces decode to, as the ordered aggregation gave it."""
        return b"".join(map(self.back.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _defaults() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = True, thrifty: bool = False, packed: bool = False) -> DataFrame:
    """Token ids of each text by the ranks in the file at path, with a digest of what they decode to.

    docs: doc_id, text; other columns are ignored. path is read where the tasks run. Returns doc_id,
    n_tokens, ids (null unless with_ids; packed: as little-endian 32-bit numbers), ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256. A null or empty text has no ids: the digests are of nothing. Rows are
    independent, repeated ones repeat; an empty table gives an empty result. Nothing is shuffled:
    each task encodes the distinct words of its slices by recursive queries.

    A worker keeps the pieces it has met for its next task. thrifty: it takes less text at once, remembers
    fewer pieces and keeps nothing after a task, for use beside operators that need the memory.
    """
    if path is None or pattern is None:
        path, pattern = (a or b for a, b in zip((path, pattern), _defaults(), strict=True))

    def column(ids: list[np.ndarray], n: int) -> pa.Array:
        if not with_ids:
            return pa.nulls(n, pa.binary() if packed else pa.list_(pa.int32()))
        if packed:
            return pa.array([x.astype("<i4").tobytes() for x in ids], pa.binary())
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids or [np.zeros(0, np.int32)])))

    @settled
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", THRIFTY_SLICE if thrifty else SLICE, "bpe", encoder.cache_clear):
                e = encoder(path, pattern)
                split = [e.split(t) for t in batch.column(1).to_pylist()]
                e.learn(set().union(*split), THRIFTY_REMEMBERED if thrifty else REMEMBERED)
                n, ids, sha, back = [], [], [], []
                for parts in split:
                    joined = b",".join(map(e.pieces.__getitem__, parts))
                    n.append(joined.count(b",") + 1 if joined else 0)
                    if with_ids:
                        ids.append(np.fromstring(joined.decode(), np.int32, sep=",") if joined else np.zeros(0, np.int32))
                    sha.append(hashlib.sha256(joined).hexdigest())
                    back.append(hashlib.sha256(e.decoded(parts)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), column(ids, len(n)), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )
        if thrifty:
            e = split = None
            keep(None)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, ids {'binary' if packed else 'array<int>'}, ids_sha256 string, decoded_sha256 string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")
