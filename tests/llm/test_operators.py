"""Training-data operators against brute force, libraries, exact round trips, and odd tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, bpe, common, jaccard, langid, lm, media, mixing, queries, repair, suffix, url_filter

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "  \n\t ", "de", "b"),
    (5, "The quick brown fox jumps over the lazy dog and runs away from it", "en", None), (5, "The quick brown fox jumps over the lazy dog and runs away from it", "en", None),
    (6, "é" * 300 + " x  y z", "fr", "a"), (None, "no id here at all, but a text of words", "en", "c"), (7, "word " * 5000, "en", "c"), (8, "a" * 20000, "en", "c"), (9, "don't <|endoftext|> 12.5%", "xx", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns whose names the operators use inside."""
    rows = [(*r, 0, "x", 1.5) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, doc int, tok string, key double")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return common.table(spark, sf, "documents")


def words(text):
    return WORD.findall((text or "").encode().lower())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def run_odd(docs, labels):
    evidence = langid.document_evidence(docs)
    return {
        "langid": lambda: langid.identify(evidence, langid.fit_text_model(docs), ["doc_id"]),
        "lm": lambda: lm.evaluate(docs, F.col("doc_id") % 3 == 0),
        "suffix": lambda: suffix.remove_repeats(docs),
        "jaccard": lambda: jaccard.near_duplicates(docs, 3, 9, 10),
        "repair": lambda: repair.read(repair.write(docs, media.scratch(docs.sparkSession, "t"), P.path("byte_bpe_50k.json"))),
        "media": lambda: media.features(media.store(docs, media.scratch(docs.sparkSession, "t"))),
        "bpe": lambda: bpe.encode(docs),
        "mixing": lambda: mixing.mix(docs, labels),
    }


NAMES = ["langid", "lm", "suffix", "jaccard", "repair", "media", "bpe", "mixing"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_each_get_a_row(spark, odd, name):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert run_odd(odd, labels)[name]().count() == len(ODD)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, odd, name):
    empty = odd.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert run_odd(empty, labels)[name]().count() == 0


# 1


def test_language_id_accuracy(spark, documents):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    model = langid.fit_text_model(documents.where(~held))
    plain = documents.where(held).select("doc_id", "text", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    found = langid.identify(plain, model, ["doc_id"]).join(documents.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    n, right = found.agg(F.count("*"), F.count_if(F.col("lang") == F.col("truth"))).first()
    assert n and right / n > 0.9


def test_posterior_by_hand(spark, documents):
    model = langid.fit_text_model(documents)
    rows = [(1, "the of and to", "en", "a.x.com"), (2, "der die und", "en", "a.x.com"), (3, "q", "de-AT", "b.x.com"), (4, None, "de", "b.x.com"), (5, "les que", None, None)]
    df = spark.createDataFrame(rows, "i long, text string, declared string, host string")
    got = {r["i"]: r for r in langid.identify(df, model, ["i"]).collect()}
    import pyarrow as pa

    scores, n = model.score(pa.array([r[1] for r in rows]))
    k = len(model.langs)
    likely = [int(s.argmax()) if m else None for s, m in zip(scores, n, strict=True)]
    vote = lambda pick: np.array([sum(1.0 for i, r in enumerate(rows) if likely[i] == c and pick(r)) for c in range(k)])
    suffix_of = lambda r: (r[3] or "").rsplit(".", 1)[-1] if "." in (r[3] or "") else ""
    domain = lambda r: ".".join((r[3] or "").split(".")[-2:])
    declared = lambda r: (r[2] or "").split("-")[0]
    overall = (vote(lambda r: True) + 1) / (vote(lambda r: True).sum() + k)
    for i, r in enumerate(rows):
        of_domain = vote(lambda x: domain(x) == domain(r)) + langid.STRENGTH * overall
        of_domain /= vote(lambda x: domain(x) == domain(r)).sum() + langid.STRENGTH
        prior = (vote(lambda x: (x[3] or "") == (r[3] or "")) + langid.STRENGTH * of_domain) / (vote(lambda x: (x[3] or "") == (r[3] or "")).sum() + langid.STRENGTH)
        total = scores[i] + np.log(prior)
        for of in (declared, suffix_of):
            if of(r):
                values = {of(x) for x in rows} - {""}
                t = sum(vote(lambda x, v=v: of(x) == v) for v in values)
                total = total + np.log((vote(lambda x: of(x) == of(r)) + langid.ALPHA) / (t + langid.ALPHA * len(values)))
        p = np.exp(total - total.max())
        p /= p.sum()
        assert got[i + 1]["posterior"] == pytest.approx(p.max(), rel=1e-6)
        assert got[i + 1]["accepted"] == bool(n[i] > 0 and p.max() >= langid.LEAST)


# 2


def brute_lm(tokens_of, held):
    """Score and base score of each sequence of tokens (None ends it), by counts in dictionaries."""
    one, two, three, after = Counter(), Counter(), Counter(), Counter()
    for i, ws in tokens_of.items():
        if not held[i]:
            seq = ["start", *ws]
            one.update(ws)
            after.update(seq[:-1])
            two.update(zip(seq, ws, strict=False))
            three.update(zip(seq, ws, ws[1:], strict=False))
    n, v = sum(one.values()), len(one)
    k2, k3 = lm.WEIGHTS
    out = {}
    for i, ws in tokens_of.items():
        score = base = 0.0
        for j, w in enumerate(ws):
            p = (one.get(w, 0) + 1) / (n + v + 1)
            base += math.log10(p)
            before = ws[j - 1] if j else "start"
            p = (two[before, w] + k2 * p) / (after[before] + k2)
            if j:
                context = (ws[j - 2] if j > 1 else "start", before)
                p = (three[(*context, w)] + k3 * p) / (two[context] + k3)
            score += math.log10(p)
        out[i] = (score, base)
    return out, one


def test_lm_against_brute_force(spark, sf, documents):
    got = {r["doc_id"]: r for r in lm.op2(spark, sf).collect()}
    toks = {r["doc_id"]: [*words(r["text"]), None] for r in documents.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    want, c = brute_lm(toks, held)
    for i, ws in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in c for w in ws), sum(c.values()))
        assert (r["score"], r["base_score"]) == pytest.approx(want[i], rel=1e-9)
    out = [got[i] for i in toks if held[i]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_over_many_blocks_and_lanes(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(rng.choice((0, 1, 2, 30, 900)))) for _ in range(80)]
    texts[7] += " zzq unseen"
    toks = {i: [*words(t), None] for i, t in enumerate(texts)}
    want, _ = brute_lm(toks, {i: i % 7 == 0 for i in toks})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    for part in (lm.PART, 64):
        got = {r["doc_id"]: (r["score"], r["base_score"]) for r in lm.evaluate(docs, F.col("doc_id") % 7 == 0, part).collect()}
        assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in toks) and len(got) == len(toks)


def test_automaton_sums_to_one():
    texts = ["a b c a b", "a b d", "", "c c c c", "b a"]
    block = lm.Block.of([*texts, "a x c y b"], np.array([False] * len(texts) + [True]))
    grams = block.ngrams()
    counts = grams.counts(block)
    one = counts[: grams.size - 1]
    automaton = lm.Automaton.build(grams, counts, len(texts), int(one.sum()), int((one > 0).sum()))
    known, unseen = np.flatnonzero(one > 0), np.flatnonzero(one == 0)
    assert len(unseen) == 2
    end = block.word[block.starts[1] - 1]
    last = np.concatenate([[-1], np.arange(grams.size), grams.two % grams.size])
    for state in np.flatnonzero(last != end):  # nothing follows an end
        every = np.append(known, unseen[0])
        assert (10.0 ** automaton.step(np.full(len(every), state), every)[1]).sum() == pytest.approx(1)
        same = automaton.step(np.full(2, state), unseen)[1]
        assert same[0] == same[1]


def test_packed_numbers():
    for values in ([], [0], [5, 0, 1 << 63, 300], list(range(70000))):
        assert lm.unpack(lm.pack(np.array(values, np.uint64))).tolist() == values


# 3


def test_maximal_repeats():
    rng = random.Random(3)
    for _ in range(20):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(4)]
        got = {texts[o[0]][p[0] : p[0] + n]: sorted(zip(o.tolist(), p.tolist(), strict=True)) for n, o, p in suffix.maximal_repeats(texts, 3)}
        found = {}
        for i, t in enumerate(texts):
            for a in range(len(t)):
                for b in range(a + 3, len(t) + 1):
                    found.setdefault(t[a:b], []).append((i, a))
        want = {}
        for s, at in found.items():
            left = {texts[i][a - 1] if a else ("start", i) for i, a in at}
            right = {texts[i][a + len(s)] if a + len(s) < len(texts[i]) else ("end", i) for i, a in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want[s] = sorted(at)
        assert got == want


def brute_repeats(rows, least=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        cover = np.zeros(len(t) + 1, int)
        for a in range(len(t) - least + 1):
            w = t[a : a + least]
            if w in seen:
                cover[a] += 1
                cover[a + least] -= 1
            seen.add(w)
        c = np.cumsum(cover)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~c].tobytes()
        out[i] = (len(t), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_against_brute_force(spark, documents, monkeypatch):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in documents.collect()]
    line = b"a line of text that stands in many documents, long enough for more than one hundred bytes to repeat, it is"
    rows += [(10**6 + i, bytes([97 + i]) * i * 9 + line + bytes([110 + i]) * 30) for i in range(12)] + [(2 * 10**6, b"xy" * 400)]
    want = brute_repeats(rows)
    df = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string")
    for crowd in (suffix.CROWD, 2):
        monkeypatch.setattr(suffix, "CROWD", crowd)
        got = {r[0]: tuple(r)[1:] for r in suffix.remove_repeats(df).drop("kept").collect()}
        assert got == want


def test_rows_of_one_document_repeat_nothing(spark, monkeypatch):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line, shared = noise(60), noise(150)
    texts = {i: noise(120) + line + noise(120) for i in range(1, 6)}
    texts[1] += shared
    texts[5] += shared
    want = brute_repeats([(i, t.encode()) for i, t in texts.items()])
    df = spark.createDataFrame([(i, texts[i]) for i in (1, 1, 2, 3, 3, 3, 4, 5, 5)], "doc_id long, text string")
    for crowd in (suffix.CROWD, 2):
        monkeypatch.setattr(suffix, "CROWD", crowd)
        rows = [tuple(r) for r in suffix.remove_repeats(df).drop("kept").collect()]
        assert len(rows) == 9 and all(r[1:] == want[r[0]] for r in rows)


def test_strip_keeps_columns(spark):
    text = "some words é that are long enough to be a repeat of more than a hundred bytes, é as this one is, surely, yes"
    df = spark.createDataFrame([(1, text, 3), (2, "before " + text + " after", 3)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in suffix.strip_repeats(df).collect()}
    assert got[1]["text"] == text and got[2]["text"] == "before  after" and got[2]["n_chars"] == len("before  after")


# 4


def test_neighbours(spark, sf):
    rows = common.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    got = {}
    for r in ann.op4(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        hits += len({v for v, _ in got[q]} & set(ids[best].tolist()))
        assert len(got[q]) == 20 and all(abs(s[ids == v][0] - c) < 1e-9 for v, c in got[q])
    assert hits / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("two_levels", [False, True])
def test_routed_recall_and_odd_vectors(spark, monkeypatch, two_levels):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (150, 8)) for c in rng.normal(0, 2, (8, 8))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5020, [0.0] * 8), (5040, [float("nan")] * 8), (5060, [1.0, None] * 4), (5080, [1.0]), (5081, [3.0]), (5082, [2.0]), (5100, [])]
    rows += [(6000 + i, rows[7][1]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit(1))
    monkeypatch.setattr(ann, "PARTITION", 100)
    monkeypatch.setattr(ann, "BLOCK", 64)
    if two_levels:
        monkeypatch.setattr(ann, "FANOUT", 4)
        usual = df.where(F.size("embedding") == 8).where(ann.usable(F.col("embedding"))).select("vec_id", F.col("embedding").alias("v"))
        tree = ann.fit(usual, 1500, ann.SAMPLE)
        assert tree.below and tree.leaves >= 8
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert not {5000, 5020, 5040, 5060, 5100} & set(got)
    # vectors of another dimension meet each other
    assert [got[5080][i] for i in (1, 2)] == [(5081, 3.0), (5082, 2.0)] and len(got.pop(5080)) == 2
    ids = np.array([i for i, v in rows if v and len(v) == 8 and i not in (5020, 5040, 5060)])
    y = np.array([v for i, v in rows if i in set(ids.tolist())])
    hits = 0
    for q, found in got.items():
        s = y @ y[ids == q][0]
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        hits += len(set(want.tolist()) & {v for v, _ in found.values()})
    assert hits / (20 * len(got)) > 0.9
    assert ann.search(df.where("false"), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]


# 5


def brute_classes(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            shared = len(sets[i] & sets[j])
            if shared and den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 8, 10), (1, 1, 2)])
def test_near_duplicates_against_brute_force(spark, k, num, den, monkeypatch):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, passage = [], " ".join(rng.choice(vocabulary) for _ in range(30))
    for i in range(40):
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) + (" " + passage if i % 3 == 0 else "")))
    base = rows[3][1].split() * 3
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary).upper()
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("need", F.lit(0))
    want = brute_classes(rows, k, num, den)
    for block, frequent in ((jaccard.BLOCK, jaccard.FREQUENT), (1 << 11, 2)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        assert {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(df, k, num, den).collect()} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r[0]: r[1] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {i: find(i) for i in parent if any(i in e and e[0] != e[1] for e in edges)}


# 6


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    for n, first in ((0, 300), (1, 300), (5000, 50257), (3000, 200000)):
        ids = rng.zipf(1.3, n).clip(1, first - 1).astype(np.uint32)
        ids[: n // 4] = 7
        rules, lengths, seq = repair.compress(ids, first, least=3)
        assert (repair.expand(seq, rules, first) == ids).all()
        assert all(len(repair.expand(np.array([first + i]), rules, first)) == lengths[i] for i in range(min(20, len(rules))))
        counts = np.array([0, n // 2, n - n // 2, 0])
        s = repair.Shard(repair.write_shard(np.arange(4), counts, ids, first))
        assert (s.all() == ids).all()
        for i, (a, m) in enumerate(zip(np.cumsum(counts) - counts, counts, strict=True)):
            assert (s.document(i) == ids[a : a + m]).all()
    with pytest.raises(ValueError):
        repair.Shard(b"nope" + bytes(60))


def test_repair_leaves_no_pair_twice():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 50000, 400)
    for first in (50257, 200000):
        ids = np.concatenate([np.concatenate([text, rng.integers(0, 50000, 50)]) for _ in range(300)] + [np.full(1000, 7)]).astype(np.uint32)
        rules, lengths, seq = repair.compress(ids, first)
        seen, last = Counter(), None
        for i, pair in enumerate(zip(seq.tolist(), seq[1:].tolist())):
            if last != (pair, i - 1):
                seen[pair] += 1
                last = (pair, i)
        assert max(seen.values()) == 1 and lengths.max() >= 400 and len(rules) > 0
        s = repair.Shard(repair.write_shard(np.arange(1), np.array([len(ids)]), ids, first))
        assert (s.all() == ids).all() and (s.document(0) == ids).all()


def test_token_output(spark, sf, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: tuple(r)[1:] for r in repair.op6(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    start = 0
    for r in sorted(documents.collect(), key=lambda r: r["doc_id"]):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        assert got[r["doc_id"]] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


TRICKY = ["a  b", " lead", "trail ", "x\n\ny z", "tab\there", "it's we'll", "é b c", "", "a\n b", "num 12 34a", " x", "***a b!!", "a\r\nb c", "<|endoftext|> x", "end\n", "\nstart a", "a.\nB c", "q\0r s", "naïve Straße, über.", "a" * 40 + " " + "b" * 24 + " " + "c" * 25, "x\u00a0y z", "×÷ À", "Ā b", "\u0085 n", "end. "]


def test_pieces_join_to_what_the_libraries_give():
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    import pyarrow as pa

    tokens, many = repair.Tokens(P.path("byte_bpe_50k.json")), []
    for texts in (TRICKY, [None, "", *reversed(TRICKY)], [], [" ".join(TRICKY)], many):
        ids, counts = tokens.encode(pa.array(texts, pa.string()), 7)
        ends = np.cumsum(counts)
        assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == [[*t.encode(x or "", add_special_tokens=False).ids, 7] for x in texts]
        rng = random.Random(8)
        many += ["".join(rng.choice(["a", "B", "é", "ß", "word", " ", " ", " ", "\n", ".", ",", "12", "'s", "x" * 30, "€", "\u00a0", "\t", "tiön"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    e = bpe.Encoder(*bpe._defaults())
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    for x in TRICKY:
        parts = e.split(x)
        e.learn(set(parts))
        ids = b",".join(e.pieces[p] for p in parts)
        assert [int(i) for i in ids.split(b",") if i] == plain.encode_ordinary(x)
        assert e.decoded(parts) == x.encode()


# 8


def test_media_round_trip(spark, sf, documents):
    for r in documents.limit(50).collect():
        payload = media.padded((r["text"] or "").encode())
        tables = media.probe(media.mux(payload))
        assert media.payload_of(media.mux(payload), tables) == payload
        assert tables["codec"] == "raw " and tables["duration"] == tables["ticks"] == len(payload)
        assert tables["key_offsets"][0] == 32 and (tables["key_sizes"] == 64).all()
    got = {r["doc_id"]: r for r in media.op8(spark, sf).collect()}
    for r in documents.collect():
        payload = media.padded((r["text"] or "").encode())
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len((r["text"] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        file, n = media.mux(payload), len(payload) // 64
        assert (g["media_bytes"], g["media_sha256"], g["codec"], g["duration_s"]) == (len(file), hashlib.sha256(file).hexdigest(), "raw ", len(payload) / 8000)
        keys = [(32 + 1024 * i, 64) for i in range(-(-n // 16))]
        assert [tuple(k) for k in g["keyframes"]] == keys
        assert g["feature"] == f"raw |{len(payload)}/8000|samples={n}|sync={len(keys)}|first={keys[0][0]}+64|last={keys[-1][0]}+64"
        assert all(file[a : a + m] == payload[1024 * i : 1024 * i + 64] for i, (a, m) in enumerate(keys))


def test_foreign_boxes():
    assert media.probe(b"") is None and media.probe(b"\0\0\0\x08free") is None and media.probe(None) is None
    file = media.mux(bytes(64 * 40))
    assert media.probe(media.box(b"free", b"xyz") + file) is not None
    assert media.probe(file[:-30]) is None
    with pytest.raises(ValueError):
        media.mux(b"abc")


def track(samples, sync=None, sizes=None, stts=None):
    """A trak of one chunk of samples at the given places' first."""
    sizes = sizes or [8] * samples
    tables = [
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"mp4a", bytes(28))), media.full(b"stts", struct.pack(">III", 1, samples if stts is None else stts, 10)),
        *([media.full(b"stss", struct.pack(f">{len(sync) + 1}I", len(sync), *sync))] if sync is not None else []),
        media.full(b"stsc", struct.pack(">4I", 1, 1, samples, 1)), media.full(b"stsz", struct.pack(f">{samples + 2}I", 0, samples, *sizes)), media.full(b"stco", struct.pack(">2I", 1, 0)),
    ]
    mdhd = media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, samples * 10, 0, 0))
    return media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", media.box(b"stbl", *tables))))


def test_tracks_do_not_mix():
    both = media.box(b"moov", track(40), track(40, sync=[1, 2, 3]))
    assert len(media.probe(both)["key_offsets"]) == 40
    shorter = media.box(b"moov", track(3, sync=[2]), track(40, sync=[40]))
    assert media.probe(shorter)["key_offsets"].tolist() == [8]
    for damaged in (track(4, sync=[5]), track(4, sync=[0]), track(4, sizes=[8, 8, 8, 1 << 30]), track(4, stts=5)):
        assert media.probe(media.box(b"moov", damaged)) is None
        assert media.probe(media.box(b"moov", damaged, track(2)))["samples"] == 2
    assert media.probe(media.box(b"moov", track(4)[:-3])) is None
    cut = track(4)
    assert media.probe(media.box(b"moov", cut.replace(struct.pack(">II", 0, 4), struct.pack(">II", 0, 400)))) is None


def test_features_of_foreign_rows(spark):
    rows = [(1, 0, None), (2, 0, bytearray()), (3, 3, bytearray(b"abc")), (None, 64, bytearray(media.mux(bytes(64))))]
    got = {r["doc_id"]: r for r in media.features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert [got[i]["media_bytes"] for i in (1, 2, 3)] == [0, 0, 3] and all(got[i]["payload_sha256"] is None for i in (1, 2, 3))
    assert got[None]["payload_bytes"] == 64


# 9


def test_bpe_against_tiktoken(spark, sf, documents):
    import tiktoken

    path, pattern = bpe._defaults()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode(documents).collect()}
    for r in documents.collect():
        ids, g = enc.encode_ordinary(r["text"] or ""), got[r["doc_id"]]
        assert g["ids"] == ids and g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_other_patterns_are_not_cut_at_spaces():
    import tiktoken

    path, _ = bpe._defaults()
    for pattern in (r"[^\s]+\s*|\s+", r"\S+(?:\n\S+)?| +|\s"):
        e = bpe.Encoder(path, pattern)
        plain = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=e.ranks, special_tokens={})
        for x in ["Hello.\nWorld and more", *TRICKY]:
            parts = e.split(x)
            e.learn(set(parts))
            assert [int(i) for i in b",".join(e.pieces[p] for p in parts).split(b",") if i] == plain.encode_ordinary(x)


def test_decoded_comes_from_the_ids(monkeypatch):
    e = bpe.Encoder(*bpe._defaults())
    monkeypatch.setattr(e, "decode_words", lambda ids: [b"?" * len(i) for i in ids])
    e.learn({"some", " words"})
    assert set(e.decoded(["some", " words"])) == {ord("?")}


def test_long_words():
    import tiktoken

    e = bpe.Encoder(*bpe._defaults())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    some = [b"a" * 700, b"ab" * 300, b"aaaab" * 80, bytes(range(33, 120)) * 3, "é".encode() * 90]
    assert e.encode_words(some) == [enc._encode_single_piece(w) for w in some]
    assert e.decode_words(e.encode_words(some)) == some


# 10


def test_mix_meets_targets(spark, sf):
    rows = mixing.op10(spark, sf).collect()
    again = mixing.op10(spark, sf).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] <= 3 * r["size"]
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs)
        assert rs[0]["target"] <= 3 * rs[0]["source_size"] + 1e-6
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(sum(r["size"] for r in rows))


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, (1, 2, 3), 3.0).collect()}
    assert got == {"a": 960.0, "b": 30.0, "c": 30.0, None: 0.0}


# 7


def test_intervals_end_where_the_next_entry_starts(spark):
    entries = spark.createDataFrame(
        [("l", "host", "a.com", "block", 1), ("l", "host", "a.com", "remove", 5), ("l", "domain", "com", "block", 8), ("m", "prefix", "a.com/x", "allow", 3), ("m", None, "a.com", "block", 0), ("l", "host", "a.com", "allow", 5)],
        "list string, kind string, value string, action string, d int",
    ).withColumn("listed_at", F.date_add(F.lit("2024-01-01"), F.col("d")).cast("timestamp_ntz"))
    captures = spark.createDataFrame([(1, "http://a.com/x/y", 0), (2, "http://U@A.com:80/x/y?q", 1), (3, "http://a.com/x", 4), (4, "http://a.com/", 5), (5, "http://b.com", 9), (6, None, 9), (7, "nohost", 9), (8, "http://a.com/z", None)], "capture_id long, url string, d int")
    captures = captures.withColumn("fetched_at", F.date_add(F.lit("2024-01-01"), F.col("d")).cast("timestamp_ntz"))
    got = {r["capture_id"]: (r["n_active"], r["blocked"]) for r in url_filter.judge(captures, entries).collect()}
    assert got == {1: (0, False), 2: (1, True), 3: (2, False), 4: (0, False), 5: (1, True), 6: (0, False), 7: (0, False), 8: (0, False)}
    assert url_filter.judge(captures.where("false"), entries).count() == 0
    assert url_filter.judge(captures, entries.where("false")).where("blocked").count() == 0
