"""URL filters by a temporal list join, with DataFrame operations only.

Dated list entries (list_name, entry, action, listed_on) say what holds for an entry from a day on: "add" lists it,
"remove" ends it.  They become validity intervals [valid_from, valid_to) by the next date of the same list and entry.
Hosts of entries are read in lower case and without a final dot.
An entry is a registered host suffix (``example.org`` also covers its subdomains), a host, or a host with a first path
segment (``host/segment``).

A capture is asked about under every key it has: its host's suffixes of two labels or more, and its host with the first
path segment.  Keys meet, in an equi-join, the intervals of entries that hold at the fetch time, and the
most specific decides, at equal length ``allow`` lists over others, then the list's name.  The large side's exchange stays
right below the join, so adaptive execution splits a hot host; the answers of a capture are combined before they are shuffled.

URLs that are null or have no host match nothing and are kept; so are captures without a fetch time, as no entry can be
shown to hold then.  Several dates of one entry on one day count as one, "add" winning.  Repeated captures stay repeated.
Entries with a null list, entry or date are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoweave.llm.common import table

ALLOW_PREFIX = "allow"


def host_of(url: Column) -> Column:
    """The lower-cased host without user, port and a final dot; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::\d*)?(?:[/?#]|$)", 1))


def segment_of(url: Column) -> Column:
    """The first path segment; empty where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)", 1)


def keys_of(host: Column, segment: Column) -> Column:
    """Every key an entry could be listed under, as an array of strings."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), "."))
    suffixes = F.when(n >= 2, suffixes).otherwise(F.array(host))
    keys = F.when(segment != "", F.concat(suffixes, F.array(F.concat(host, F.lit("/"), segment)))).otherwise(suffixes)
    return F.when(F.coalesce(host, F.lit("")) != "", keys).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, entry, valid_from, valid_to): when each entry was listed; an open end is null."""
    e = entries.where("list_name is not null and entry is not null and listed_on is not null")
    host = F.regexp_replace(F.lower(F.substring_index("entry", "/", 1)), r"\.$", "")
    e = e.withColumn("entry", F.concat(host, F.expr("substr(entry, length(substring_index(entry, '/', 1)) + 1)")))
    e = e.groupBy("list_name", "entry", F.col("listed_on").cast("date").alias("listed_on")).agg(F.min("action").alias("action"))
    order = Window.partitionBy("list_name", "entry").orderBy("listed_on")
    e = e.withColumn("valid_to", F.lead("listed_on").over(order))
    return e.where("action = 'add'").select("list_name", "entry", F.col("listed_on").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, fetched_on, list_name, entry, listed_from, verdict) for each row of (page_id, url, fetched_on)."""
    rows = captures.select("page_id", "url", F.col("fetched_on").cast("date").alias("fetched_on"))
    itself = F.concat(F.lit("\0"), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit("")))  # matches nothing; counts copies
    asked = rows.select("page_id", "url", "fetched_on", F.explode(F.concat(keys_of(host_of(F.col("url")), segment_of(F.col("url"))), F.array(itself))).alias("key"))
    listed = intervals(entries).withColumnRenamed("entry", "key")
    holds = (F.col("valid_from") <= F.col("fetched_on")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    rank = F.struct(F.length("key").alias("specific"), F.col("list_name").startswith(ALLOW_PREFIX).alias("allows"), F.col("list_name"), F.col("key").alias("entry"), F.col("valid_from").alias("listed_from"))
    met = asked.join(listed.withColumnRenamed("key", "listed"), (F.col("key") == F.col("listed")) & holds, "left")
    found = met.groupBy("page_id", "url", "fetched_on").agg(F.max(F.when(F.col("listed").isNotNull(), rank)).alias("best"), F.count_if(F.col("key").startswith("\0")).cast("int").alias("copies"))
    verdict = F.when(F.col("best").isNull() | F.col("best.allows"), "keep").otherwise("drop")
    out = found.select("page_id", "fetched_on", "best.list_name", "best.entry", "best.listed_from", verdict.alias("verdict"), F.explode(F.sequence(F.lit(1), "copies")).alias("_c"))
    return out.drop("_c")


def _day(text: Column, start: str, modulus: int) -> Column:
    """A day after ``start`` picked by the md5 of a text."""
    return F.date_add(F.lit(start).cast("date"), (F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long") % modulus).cast("int"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """The lists of the registered query, picked by hash from the hosts of the pages: blocked hosts that come and go,
    a suffix that was blocked for a time, blocked host sections, and allowed hosts."""
    hosts = pages.select(host_of(F.col("url")).alias("h"), segment_of(F.col("url")).alias("s")).where("h <> ''")
    only = hosts.select("h").distinct()
    pick = lambda c, salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), c)), 1, 6), 16, 10).cast("long")
    row = lambda df, name, entry, action, day: df.select(F.lit(name).alias("list_name"), entry.alias("entry"), F.lit(action).alias("action"), day.alias("listed_on"))
    h = F.col("h")
    spam = only.where(pick(h, "spam") % 3 == 0)
    section = hosts.where("s <> ''").select(F.concat("h", F.lit("/"), "s").alias("h")).distinct().where(pick(h, "section") % 4 == 0)
    allowed = only.where(pick(h, "allow") % 5 == 0)
    suffix = only.select(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1).alias("h")).where("h <> ''").distinct().where(pick(h, "suffix") % 2 == 0)
    parts = [
        row(spam, "spam", h, "add", _day(h, "2023-01-01", 300)),
        row(spam, "spam", h, "remove", _day(F.concat(F.lit("r"), h), "2023-11-01", 200)),
        row(spam.where(pick(h, "again") % 2 == 0), "spam", h, "add", _day(F.concat(F.lit("a"), h), "2024-07-01", 100)),
        row(section, "sections", h, "add", _day(h, "2023-06-01", 400)),
        row(allowed, "allowed", h, "add", _day(F.concat(F.lit("w"), h), "2023-03-01", 500)),
        row(suffix, "networks", h, "add", _day(h, "2023-09-01", 200)),
        row(suffix, "networks", h, "remove", _day(F.concat(F.lit("r"), h), "2024-04-01", 100)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", _day(F.col("page_id").cast("string"), "2023-01-01", 730).alias("fetched_on"))
    return judge(captures, dated_lists(pages))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, DATE '2023-01-01' + CAST(CAST('0x' || md5(CAST(page_id AS VARCHAR))[1:6] AS BIGINT) % 730 AS INTEGER) AS fetched_on,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::\d*)?(?:[/?#]|$)', 1)) AS h,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)', 1) AS s
  FROM pages
), only_h AS (SELECT DISTINCT h FROM p WHERE h <> ''),
spam AS (SELECT h FROM only_h WHERE CAST('0x' || md5('spam' || h)[1:6] AS BIGINT) % 3 = 0),
section AS (SELECT h FROM (SELECT DISTINCT h || '/' || s AS h FROM p WHERE h <> '' AND s <> '') WHERE CAST('0x' || md5('section' || h)[1:6] AS BIGINT) % 4 = 0),
allowed AS (SELECT h FROM only_h WHERE CAST('0x' || md5('allow' || h)[1:6] AS BIGINT) % 5 = 0),
suffix AS (SELECT h FROM (SELECT DISTINCT regexp_extract(h, '([^.]+\.[^.]+)$', 1) AS h FROM only_h) WHERE h <> '' AND CAST('0x' || md5('suffix' || h)[1:6] AS BIGINT) % 2 = 0),
raw AS (
  SELECT 'spam' AS list_name, h AS entry, 'add' AS action, DATE '2023-01-01' + CAST(CAST('0x' || md5(h)[1:6] AS BIGINT) % 300 AS INTEGER) AS listed_on FROM spam
  UNION ALL SELECT 'spam', h, 'remove', DATE '2023-11-01' + CAST(CAST('0x' || md5('r' || h)[1:6] AS BIGINT) % 200 AS INTEGER) FROM spam
  UNION ALL SELECT 'spam', h, 'add', DATE '2024-07-01' + CAST(CAST('0x' || md5('a' || h)[1:6] AS BIGINT) % 100 AS INTEGER) FROM spam WHERE CAST('0x' || md5('again' || h)[1:6] AS BIGINT) % 2 = 0
  UNION ALL SELECT 'sections', h, 'add', DATE '2023-06-01' + CAST(CAST('0x' || md5(h)[1:6] AS BIGINT) % 400 AS INTEGER) FROM section
  UNION ALL SELECT 'allowed', h, 'add', DATE '2023-03-01' + CAST(CAST('0x' || md5('w' || h)[1:6] AS BIGINT) % 500 AS INTEGER) FROM allowed
  UNION ALL SELECT 'networks', h, 'add', DATE '2023-09-01' + CAST(CAST('0x' || md5(h)[1:6] AS BIGINT) % 200 AS INTEGER) FROM suffix
  UNION ALL SELECT 'networks', h, 'remove', DATE '2024-04-01' + CAST(CAST('0x' || md5('r' || h)[1:6] AS BIGINT) % 100 AS INTEGER) FROM suffix
), e AS (SELECT list_name, entry, listed_on, min(action) AS action FROM raw GROUP BY ALL),
i AS (
  SELECT list_name, entry, listed_on AS valid_from, valid_to
  FROM (SELECT *, lead(listed_on) OVER (PARTITION BY list_name, entry ORDER BY listed_on) AS valid_to FROM e) WHERE action = 'add'
), m AS (
  SELECT p.page_id, p.url, p.fetched_on, i.list_name, i.entry, i.valid_from,
    row_number() OVER (PARTITION BY p.page_id, p.url, p.fetched_on ORDER BY length(i.entry) DESC, CAST(starts_with(i.list_name, 'allow') AS INTEGER) DESC, i.list_name DESC, i.entry DESC, i.valid_from DESC) AS n
  FROM p JOIN i ON p.h <> '' AND (i.entry = p.h OR (contains(i.entry, '.') AND ends_with(p.h, '.' || i.entry)) OR (p.s <> '' AND i.entry = p.h || '/' || p.s))
    AND i.valid_from <= p.fetched_on AND (i.valid_to IS NULL OR p.fetched_on < i.valid_to)
)
SELECT p.page_id, p.fetched_on, m.list_name, m.entry, m.valid_from AS listed_from,
  CASE WHEN m.list_name IS NULL OR starts_with(m.list_name, 'allow') THEN 'keep' ELSE 'drop' END AS verdict
FROM p LEFT JOIN m ON m.n = 1 AND p.page_id IS NOT DISTINCT FROM m.page_id AND p.url IS NOT DISTINCT FROM m.url
"""
