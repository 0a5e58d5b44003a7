"""Language identification by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, settled, slices, table, utf8_column
from .url_filter import host_of

#: Hashed byte trigrams; labelled texts the text model is fitted on, about; languages it knows at most.
SLOTS, SAMPLE, MOST = 1 << 15, 4000, 500
#: Bytes of text handled at once.
SLICE = 2 << 20
#: A text counts as so many independent trigrams at most, as its trigrams depend on each other.
WORTH = 60
#: Pseudo-counts: of the parent's distribution for a domain and a host, of each value for a declared language or suffix.
STRENGTH, ALPHA = 20.0, 0.5
#: Less of the posterior, or a text of no letters, is rejected.
LEAST = 0.5
UNKNOWN = "und"

#: ASCII letters in lower case, other ASCII as a space, everything else as it is.
FOLD = np.array([b if b >= 128 else b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def trigrams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the byte trigrams of a text column, 0/1 for those that count, and n + 1 offsets by text.

    Two spaces in a row carry nothing, so they don't count; nor do trigrams across two texts.
    """
    raw, offsets = utf8_column(column)
    folded = FOLD[raw]
    after = np.append(False, raw[:-1] == 0xC3)
    folded = np.where(after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97), raw + np.uint8(32), folded)
    if len(folded) < 3:
        return np.zeros(len(folded), np.int64), np.zeros(len(folded), np.float32), offsets
    a, b, c = (folded[i : len(folded) - 2 + i].astype(np.uint32) for i in range(3))
    slot = np.zeros(len(folded), np.int64)
    slot[:-2] = ((a << np.uint32(16) | b << np.uint32(8) | c) * np.uint32(2654435761)) >> np.uint32(17)
    counts = np.zeros(len(folded), np.float32)
    counts[:-2] = ~(((a == 32) & (b == 32)) | ((b == 32) & (c == 32)))
    ends = offsets[1:]
    for back in (1, 2):
        at = ends - back
        counts[at[at >= offsets[:-1]]] = 0
    return slot, counts, offsets


@dataclass
class TextModel:
    """Log-probabilities of trigram slots by language, add-half smoothed."""

    langs: list[str]
    table: np.ndarray

    def score(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) log-likelihoods of at most WORTH trigrams' weight, and the numbers of trigrams."""
        slot, weight, offsets = trigrams(texts)
        sums = lambda v: np.diff(np.append(0.0, np.cumsum(v, dtype=np.float64))[offsets])
        n = sums(weight)
        total = np.column_stack([sums(t[slot] * weight) for t in self.table]) if len(self.table) else np.zeros((len(n), 0))
        return total * (np.minimum(n, WORTH) / np.maximum(n, 1))[:, None], n.astype(np.int64)


def fit_text_model(labelled: DataFrame, sample: int = SAMPLE) -> TextModel:
    """Fit on (doc_id, text, lang): about as many texts of each language, `sample` in all, those of the smallest digests.

    Languages are counted over all rows, so a rare one is known too; of more than MOST, the most frequent count.
    Trigrams are counted where the texts are; only sums by language and slot reach the driver. Null texts hold none.
    """
    named = labelled.select("doc_id", "lang", F.col("text").cast("string").alias("text")).where("lang is not null and lang <> ''")
    sizes = {r["lang"]: r["count"] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST).collect()}
    names = sorted(sizes)
    counts = np.full((len(names), SLOTS), 0.5)
    if names:
        each = max(1, sample // len(names))
        bars = [F.lit(x) for name in names for x in (name, min((1 << 63) - 1, -(1 << 63) + (1 << 64) * each // sizes[name]))]
        rows = named.where(F.xxhash64("doc_id") <= F.create_map(*bars)[F.col("lang")]).select("lang", "text")

        @settled
        def run(batches):
            for whole in batches:
                for b in slices(whole, "text", SLICE):
                    slot, weight, offsets = trigrams(b.column(1))
                    own = np.array([names.index(x) for x in b.column(0).to_pylist()], np.int64)
                    sums = np.bincount(np.repeat(own, np.diff(offsets)) * SLOTS + slot, weight)
                    at = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["at", "n"])

        found = rows.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        np.add.at(counts.reshape(-1), found.column("at").to_numpy(), found.column("n").to_numpy())
    return TextModel(names, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def declared_language(value: Column) -> Column:
    """Primary subtag in lower case; empty for none or anything else."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(value)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def identify(evidence: DataFrame, model: TextModel, keys: list[str]) -> DataFrame:
    """Fuse the evidence on each row: text, declared (language), host; any may be null.

    Returns the key columns with lang, posterior, n_trigrams, text_lang (by text alone) and
    accepted. A text without letters, or a posterior below LEAST, is 'und' and not accepted.
    Rows are independent given the counts; repeated rows repeat. An empty table gives an empty
    result. Other columns are ignored.

    What a declared language and an address suffix tell, and each host's prior, are counted over
    all rows by what their texts say: grouped sums with a column a language. A host's distribution
    is smoothed by its domain's, that by the overall one. Only sums are joined back to the rows.
    """
    names, count = model.langs, max(1, len(model.langs))
    kinds = dict(evidence.dtypes)
    held = evidence.sparkSession.sparkContext.broadcast(model)

    @settled
    def run(batches):
        for whole in batches:
            for b in slices(whole, "_text", SLICE):
                scores, n = held.value.score(b.column("_text"))
                likely = pa.array(scores.argmax(1) if scores.shape[1] else np.zeros(len(n), int), pa.int32(), mask=(n == 0) | (scores.shape[1] == 0))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * scores.shape[1]), pa.array(scores.ravel()))
                kept = [b.column(i) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, flat, pa.array(n, pa.int64()), likely], names=[*b.schema.names[:-1], "_scores", "_n", "_likely"])

    host = F.lower(F.coalesce(F.col("host"), F.lit("")))
    labels = F.split(host, r"\.")
    prepared = evidence.select(
        *keys, host.alias("_host"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("_domain"),
        F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise("").alias("_suffix"),
        declared_language(F.col("declared")).alias("_declared"), F.col("text").cast("string").alias("_text"),
    )
    columns = [f"`{k}` {kinds[k]}" for k in keys] + ["_host string", "_domain string", "_suffix string", "_declared string", "_scores array<double>", "_n long", "_likely int"]
    scored = checkpointed(prepared.mapInArrow(run, ", ".join(columns)))

    votes = [F.sum(F.when(F.col("_likely") == i, 1.0).otherwise(0.0)).alias(f"v{i}") for i in range(count)]
    everyone = F.array(*[F.col(f"v{i}") for i in range(count)])
    hosts = scored.groupBy("_domain", "_host", "_suffix", "_declared").agg(*votes)
    again = [F.sum(f"v{i}").alias(f"v{i}") for i in range(count)]
    total = hosts.agg(*again).select(everyone.alias("all"))
    smooth = lambda own, parent: F.transform(own, lambda v, i: (v + F.lit(STRENGTH) * parent[i]) / (F.aggregate(own, F.lit(0.0), lambda a, x: a + x) + F.lit(STRENGTH)))
    overall = total.select(F.transform("all", lambda v: (F.coalesce(v, F.lit(0.0)) + 1.0) / (F.aggregate("all", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) + float(count))).alias("overall"))
    domains = hosts.groupBy("_domain").agg(*again).crossJoin(F.broadcast(overall)).select("_domain", smooth(everyone, F.col("overall")).alias("of_domain"))
    by_host = hosts.groupBy("_domain", "_host").agg(*again).join(domains, "_domain").select("_host", smooth(everyone, F.col("of_domain")).alias("prior"))

    def likelihood(column: str, name: str) -> DataFrame:
        seen = hosts.where(F.col(column) != "").groupBy(column).agg(*again)
        sums = seen.agg(F.count("*").alias("k"), F.array(*[F.sum(f"v{i}") for i in range(count)]).alias("t"))
        return seen.crossJoin(F.broadcast(sums)).select(column, F.transform(everyone, lambda v, i: F.log((v + F.lit(ALPHA)) / (F.col("t")[i] + F.lit(ALPHA) * F.col("k")))).alias(name))

    joined = scored.join(by_host, "_host", "left").join(likelihood("_declared", "of_declared"), "_declared", "left").join(likelihood("_suffix", "of_suffix"), "_suffix", "left")
    zero = F.array(*[F.lit(0.0)] * count)
    fused = F.col("_scores")
    for part in (F.transform("prior", lambda p: F.log(p)), F.col("of_declared"), F.col("of_suffix")):
        fused = F.zip_with(fused, F.coalesce(part, zero), lambda a, b: a + b)
    best = F.array_max(F.transform("_fused", lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
    joined = joined.withColumn("_fused", fused).withColumn("_best", best)
    posterior = 1.0 / F.aggregate("_fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best.v")))
    accepted = (F.col("_n") > 0) & (F.col("_posterior") >= LEAST) & F.lit(bool(names))
    codes = F.array(*[F.lit(x) for x in names or [UNKNOWN]])
    return joined.withColumn("_posterior", F.coalesce(posterior, F.lit(0.0))).select(
        *keys,
        F.when(accepted, F.get(codes, -F.col("_best.i"))).otherwise(UNKNOWN).alias("lang"),
        F.col("_posterior").alias("posterior"), F.col("_n").alias("n_trigrams"),
        F.coalesce(F.get(codes, F.col("_likely")), F.lit(UNKNOWN)).alias("text_lang"), accepted.alias("accepted"),
    )


#: Scripts, styles and comments with what they hold; other tags alone.
MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence on (page_id, url, html): visible text, the html tag's lang attribute, the URL's host."""
    declared = F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    return pages.select("page_id", F.regexp_replace("html", MARKUP, " ").alias("text"), declared.alias("declared"), host_of(F.col("url")).alias("host"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Evidence on (doc_id, text, lang, source): lang is the declared language, source stands for the host."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    both = document_evidence(docs).unionByName(page_evidence(pages), allowMissingColumns=True)
    return identify(both, fit_text_model(docs), ["doc_id", "page_id"])
