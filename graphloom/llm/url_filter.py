"""URL filter lists over time: dated entries become validity intervals, captures are judged as of their fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Scheme, authority; then user info and port are cut off.
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host; empty for a URL without one."""
    authority = F.regexp_extract(url, AUTHORITY, 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))


def path_of(url: Column) -> Column:
    """Path without query and fragment, without its slashes at the ends."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of dated entries (list, kind, value, action, listed_at).

    Within a list, an entry for a kind and value holds until the next one for them; 'remove' ends
    the one before and opens nothing. Of entries dated alike, the greatest action holds. Entries
    with a null list, kind, value or date are void. Returns valid_from, valid_to (null: still valid).
    """
    keyed = entries.where("list is not null and kind is not null and value is not null and listed_at is not null and action is not null")
    keyed = keyed.groupBy("list", "kind", "value", "listed_at").agg(F.max("action").alias("action"))
    later = Window.partitionBy("list", "kind", "value").orderBy("listed_at")
    return (
        keyed.withColumn("valid_to", F.lead("listed_at").over(later))
        .where("action <> 'remove'")
        .withColumnRenamed("listed_at", "valid_from")
        .select("list", "kind", "value", "action", "valid_from", "valid_to")
    )


def candidate_keys(host: Column, path: Column) -> Column:
    """What an entry may name to match: the host, each of its parent domains, each leading part of the path."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("value")))
    return F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("value"))), domains, prefixes)


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Judge each capture (capture_id, url, fetched_at) by the entries that were active at its fetch.

    One row a capture, repeated rows repeated: host, the number of active entries that match, how many of
    them block and allow, the lists they are of, and whether it is blocked: at least one entry
    blocks and none allows. A null or hostless URL or a null date matches nothing. The fetch is
    matched from valid_from on, up to but without valid_to.

    The as-of join is an equi-join on (kind, value) with a range condition. Captures of one
    (host, path, fetch) are alike, so they are judged once; a hot host's rows are split by AQE.
    """
    seen = captures.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    cases = seen.where("host <> '' and fetched_at is not null").select("host", "path", "fetched_at").distinct()
    keys = cases.withColumn("key", F.explode(candidate_keys(F.col("host"), F.col("path")))).select("host", "path", "fetched_at", "key.kind", "key.value").distinct()
    found = (
        keys.join(intervals(entries), ["kind", "value"])
        .where("valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to)")
        .groupBy("host", "path", "fetched_at")
        .agg(
            F.count("*").alias("n_active"),
            F.count_if(F.col("action") == "block").alias("n_block"),
            F.count_if(F.col("action") == "allow").alias("n_allow"),
            F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        )
    )
    none = F.lit(0).cast("long")
    return (
        seen.join(found, ["host", "path", "fetched_at"], "left")
        .select(
            "capture_id", "url", "host", "fetched_at",
            F.coalesce("n_active", none).alias("n_active"), F.coalesce("n_block", none).alias("n_block"),
            F.coalesce("n_allow", none).alias("n_allow"), F.coalesce("lists", F.lit("")).alias("lists"),
            ((F.coalesce("n_block", none) > 0) & (F.coalesce("n_allow", none) == 0)).alias("blocked"),
        )
    )


def _day(days: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int")).cast("timestamp_ntz")


def example_captures(pages: DataFrame) -> DataFrame:
    """pages with a fetch date: the tables hold none, so it is a rule of page_id."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", _day(F.col("page_id") * 37 % 365).alias("fetched_at"))


def example_entries(pages: DataFrame) -> DataFrame:
    """Dated entries on the hosts, domains and first path parts that occur in pages, by a rule of their digest."""
    names = pages.select(host_of(F.col("url")).alias("host"), F.split(path_of(F.col("url")), "/")[0].alias("part")).where("host <> ''")
    two = F.array_join(F.slice(F.split("host", r"\."), F.greatest(F.size(F.split("host", r"\.")) - 1, F.lit(1)), 2), ".")
    values = (
        names.select(F.lit("host").alias("kind"), F.col("host").alias("value"))
        .unionByName(names.select(F.lit("domain").alias("kind"), two.alias("value")))
        .unionByName(names.select(F.lit("prefix").alias("kind"), F.concat("host", F.lit("/"), "part").alias("value")))
        .distinct()
        .withColumn("n", F.conv(F.substring(F.md5(F.concat("kind", F.lit(":"), "value")), 1, 4), 16, 10).cast("long"))
    )
    entry = lambda name, day, action: F.struct(F.lit(name).alias("list"), _day(day).alias("listed_at"), F.lit(action).alias("action"))
    n = F.col("n")
    dated = (
        F.when((F.col("kind") == "host") & (n % 3 == 0), F.array(entry("ads", n % 150, "block"), entry("ads", n % 150 + 60, "remove"), entry("ads", n % 150 + 200, "block")))
        .when((F.col("kind") == "host") & (n % 3 == 1), F.array(entry("spam", n % 300, "block")))
        .when(F.col("kind") == "domain", F.array(entry("domains", n % 100 + 100, "block"), entry("domains", n % 100 + 180, "remove")))
        .when((F.col("kind") == "prefix") & (n % 4 == 0), F.array(entry("exceptions", n % 330, "allow")))
    )
    return values.withColumn("e", F.explode(dated)).select("kind", "value", "e.list", "e.listed_at", "e.action")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(example_captures(pages), example_entries(pages)).withColumnRenamed("capture_id", "page_id")


OP7_SQL = r"""
WITH cap AS (
  SELECT page_id, url,
    lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS path,
    (DATE '2024-01-01' + (page_id * 37 % 365)::INTEGER)::TIMESTAMP AS fetched_at
  FROM pages),
vals AS (
  SELECT DISTINCT kind, value FROM (
    SELECT 'host' AS kind, host AS value FROM cap WHERE host <> ''
    UNION ALL SELECT 'domain', array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), greatest(len(string_split(host, '.')) - 1, 1) + 1), '.') FROM cap WHERE host <> ''
    UNION ALL SELECT 'prefix', host || '/' || string_split(path, '/')[1] FROM cap WHERE host <> '')),
num AS (SELECT kind, value, ('0x' || substr(md5(kind || ':' || value), 1, 4))::BIGINT AS n FROM vals),
ent AS (
  SELECT kind, value, 'ads' AS list, n % 150 AS d, 'block' AS action FROM num WHERE kind = 'host' AND n % 3 = 0
  UNION ALL SELECT kind, value, 'ads', n % 150 + 60, 'remove' FROM num WHERE kind = 'host' AND n % 3 = 0
  UNION ALL SELECT kind, value, 'ads', n % 150 + 200, 'block' FROM num WHERE kind = 'host' AND n % 3 = 0
  UNION ALL SELECT kind, value, 'spam', n % 300, 'block' FROM num WHERE kind = 'host' AND n % 3 = 1
  UNION ALL SELECT kind, value, 'domains', n % 100 + 100, 'block' FROM num WHERE kind = 'domain'
  UNION ALL SELECT kind, value, 'domains', n % 100 + 180, 'remove' FROM num WHERE kind = 'domain'
  UNION ALL SELECT kind, value, 'exceptions', n % 330, 'allow' FROM num WHERE kind = 'prefix' AND n % 4 = 0),
spans AS (
  SELECT * FROM (
    SELECT kind, value, list, action, (DATE '2024-01-01' + d::INTEGER)::TIMESTAMP AS valid_from,
      lead((DATE '2024-01-01' + d::INTEGER)::TIMESTAMP) OVER (PARTITION BY list, kind, value ORDER BY d) AS valid_to FROM ent)
  WHERE action <> 'remove'),
hits AS (
  SELECT c.page_id, s.* FROM cap c JOIN spans s ON c.host <> '' AND s.kind = 'host' AND s.value = c.host
  UNION ALL SELECT c.page_id, s.* FROM cap c JOIN spans s ON c.host <> '' AND s.kind = 'domain' AND (c.host = s.value OR ends_with(c.host, '.' || s.value))
  UNION ALL SELECT c.page_id, s.* FROM cap c JOIN spans s ON c.host <> '' AND s.kind = 'prefix' AND (c.host || '/' || c.path = s.value OR starts_with(c.host || '/' || c.path, s.value || '/')))
SELECT c.page_id, any_value(c.url) AS url, any_value(c.host) AS host, any_value(c.fetched_at) AS fetched_at,
  count(s.kind)::BIGINT AS n_active, (count(*) FILTER (WHERE s.action = 'block'))::BIGINT AS n_block, (count(*) FILTER (WHERE s.action = 'allow'))::BIGINT AS n_allow,
  coalesce(string_agg(DISTINCT s.list, ',' ORDER BY s.list), '') AS lists,
  count(*) FILTER (WHERE s.action = 'block') > 0 AND count(*) FILTER (WHERE s.action = 'allow') = 0 AS blocked
FROM cap c LEFT JOIN hits s ON c.page_id = s.page_id AND s.valid_from <= c.fetched_at AND (s.valid_to IS NULL OR c.fetched_at < s.valid_to)
GROUP BY c.page_id
"""
