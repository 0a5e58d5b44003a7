"""A training corpus from documents: languages, near duplicates, repeats, source mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, jaccard, langid, mixing, suffix
from graphloom.llm.common import table, unused
from graphloom.llm.media import scratch


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the ids; these are broadcast if they are few."""
    gone = unused(docs, "_gone")
    ids = ids.select(F.col("doc_id").alias(gone)).distinct()
    few = ids.count() <= jaccard.SMALL
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col(gone), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found, with all their columns.

    A document is rejected if its text has no letters (null, empty and blank texts among them) or no language gets half of the
    posterior. Rows that repeat a doc_id are one document, which stays if one of them is accepted. Rows without a
    doc_id stay, as they can't be named. An empty table gives an empty one.
    """
    found = langid.identify(langid.document_evidence(docs), langid.fit_text_model(docs), ["doc_id"])
    return _without(docs, found.groupBy("doc_id").agg(F.max("accepted").alias("accepted")).where("not accepted"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near duplicates: five-word shingles, similarity of 0.8 or more.

    Null, empty and blank texts are like nothing and stay, as do rows without a doc_id. Of rows that repeat a doc_id with the
    same text one stays, the least by its other columns; those with other texts are kept. An empty table gives an empty one.
    """
    classes = jaccard.near_duplicates(docs, k=5, num=8, den=10)
    n, distinct = classes.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    kept = _without(docs, classes.where("component_id <> doc_id"))
    if n == distinct:
        return kept
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = kept.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0)])).alias("_rest"))
    named = named.select(*[F.col("doc_id") if c == "doc_id" else F.col("text") if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])
    return named.unionByName(kept.where("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that an earlier one holds; see suffix.strip_repeats for odd rows."""
    return suffix.strip_repeats(docs, 100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; those it doesn't take go, those it takes more than once repeat.

    Texts without words take nothing of the mix; they stay once for each whole epoch of their source. Rows without a doc_id are drawn
    by a digest of their text instead. Rows alike in doc_id, source and size are taken alike. An empty table gives an empty one.
    """
    ident = F.coalesce(F.col("doc_id").cast("long"), -1 - F.abs(F.xxhash64("text") / 2).cast("long"))
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    mixed = mixing.mix(docs.withColumn("doc_id", ident), table(spark, sf_dir, "labels"))
    i, of, n, copies = (unused(docs, name) for name in ("_id", "_source", "_size", "_copies"))
    mixed = mixed.groupBy(F.col("doc_id").alias(i), F.col("source").alias(of), F.col("size").alias(n)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    return (
        docs.join(mixed, (ident == F.col(i)) & (size == F.col(n)) & F.col("source").eqNullSafe(F.col(of)))
        .withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids as little-endian 32-bit numbers, their number and digests, a row a row; a null or empty text has none. An empty table gives an empty one."""
    return bpe.encode(docs, with_ids=True, thrifty=True, packed=True)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("suffix_dedup", repeats), ("mixing", mix), ("byte_bpe", token_ids)]
#: Several stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
