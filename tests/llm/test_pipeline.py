"""The pipeline's stages against brute force on a small table, and what each lets through."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from graphloom.llm import bpe

from .test_operators import brute_classes, brute_repeats

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["start"] = docs.collect()
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf)
        docs = docs.cache()
        out[name] = docs.collect()
        out[f"{name}.columns"] = docs.columns
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "suffix_dedup", "mixing", "byte_bpe"]


def test_columns(stages):
    for name in ("language_id", "near_duplicates", "suffix_dedup", "mixing"):
        assert stages[f"{name}.columns"] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_languages_keep_texts(stages):
    kept = {r["doc_id"] for r in stages["language_id"]}
    assert all(r["doc_id"] in kept for r in stages["start"] if any(c.isalpha() for c in r["text"] or "") and len(r["text"]) > 200)


def test_one_of_each_class_stays(stages):
    classes = brute_classes([(r["doc_id"], r["text"]) for r in stages["language_id"]], 5, 8, 10)
    assert sorted(r["doc_id"] for r in stages["near_duplicates"]) == sorted(i for i, (_, c) in classes.items() if c == i)


def test_repeats_are_gone(stages):
    want = brute_repeats([(r["doc_id"], r["text"].encode()) for r in stages["near_duplicates"]])
    for r in stages["suffix_dedup"]:
        kept = hashlib.sha256(r["text"].encode()).hexdigest()
        assert want[r["doc_id"]][3] == kept or len(r["text"].encode()) < want[r["doc_id"]][0] - want[r["doc_id"]][1]


def test_ids_of_what_the_mix_took(stages):
    import tiktoken

    path, pattern = bpe._defaults()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = sorted((r["doc_id"], hashlib.sha256(",".join(map(str, enc.encode_ordinary(r["text"]))).encode()).hexdigest()) for r in stages["mixing"])
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in stages["byte_bpe"]) == want
    assert all(hashlib.sha256(",".join(map(str, np.frombuffer(r["ids"], "<i4"))).encode()).hexdigest() == r["ids_sha256"] for r in stages["byte_bpe"])


def test_run(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, got)) == sorted(map(str, stages["byte_bpe"]))


LONG = "The quick brown fox jumps over the lazy dog and then runs away from it because the dog was not so lazy after all, it seems"
ODD = [
    (1, LONG, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "de", "b", 4), (5, LONG, "en", None, 9), (5, LONG, "en", None, 8), (6, "é" * 300 + " x  y z u v w q r s t " + LONG, "fr", "a", 2),
    (None, "no id here at all, but a text of words", "en", "c", 1), (None, None, "en", "c", 1), (7, "word " * 5000, "en", "c", 1), (8, "a" * 20000, "en", "c", 1), (9, "a text of its own that shares its number", "xx", "b", 1), (9, "another text that shares a number with it", "en", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    names = "doc int, spans int, tok string, key double, _repeats int"
    return spark.createDataFrame([(*r, 0, 1, "x", 1.5, 2) for r in ODD], f"doc_id long, text string, lang string, source string, n_chars long, {names}")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, sf, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, sf)
    rows = got.collect()
    assert stage(spark, odd.where("false"), sf).count() == 0
    if name == "byte_bpe":
        assert len(rows) == len(ODD) and all(4 * r["n_tokens"] == len(r["ids"]) for r in rows)
        return
    assert got.columns == odd.columns
    ids = sorted((r["doc_id"] for r in rows if r["doc_id"] is not None))
    if name == "language_id":
        assert not {2, 3, 4} & set(ids) and {1, 5, 9} <= set(ids) and sum(r["doc_id"] is None for r in rows) == 2
    if name == "near_duplicates":
        assert ids == [1, 2, 3, 4, 6, 7, 8, 9, 9] and sum(r["doc_id"] is None for r in rows) == 2
    if name == "suffix_dedup":
        texts = {(r["doc_id"], r["n_chars"]): r["text"] for r in rows}
        assert len(rows) == len(ODD) and texts[1, 1] == LONG and texts[5, 0] == "" and (2, None) in texts
        assert [t for (i, _), t in texts.items() if i == 6] == ["é x  y z u v w q r s t "]
    if name == "mixing":
        assert set(ids) <= {r[0] for r in ODD} and {1, 6} & set(ids)


class Rows:
    """In place of a DataFrame: keeps the function that tasks would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        self.f = f
        return self


def test_token_ids_bound_a_workers_memory(spark, sf):
    rng, rows = random.Random(7), Rows()
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(12_000)) for _ in range(48)]
    corpus_pipeline.token_ids(spark, rows, sf)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    bpe.encoder(*bpe._defaults())
    tracemalloc.start()
    try:
        got = list(rows.f(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < 200
    got = pa.Table.from_batches(got).to_pylist()
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    assert [r["decoded_sha256"] for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert all(hashlib.sha256(",".join(map(str, np.frombuffer(r["ids"], "<i4"))).encode()).hexdigest() == r["ids_sha256"] for r in got)
