"""URL filters with dated lists: an as-of join of captures and list entries.

A list is a log of entries: a pattern is listed or delisted at a time. Successive
entries of one pattern become validity intervals [from, until). A capture is looked up
by everything a pattern may name: its address without fragment, its host with the first
part of the path, its host, and every parent domain of two labels or more. It is
decided by the entries that were active when it was fetched: the most specific pattern
wins, and a block wins over an allowance.

The join is by pattern; one hot domain is split by the engine's skew handling, as the
side of the intervals has few rows per pattern. Captures that share a pattern and a
fetch time are looked up once.

Defined results: a null or unreadable address matches nothing and passes; a capture
without fetch time matches nothing; entries without pattern, time or action do not
count; of entries of the same pattern and time, a listing wins over a delisting; a
repeated capture is decided like the first; no captures give no rows, no entries block
nothing. Hosts are compared in lower case, without a leading `www.`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table

#: Kinds of pattern, by how specific they are; a host counts by its labels, at most 99.
URL, PREFIX = 200, 100


def host(url: Column) -> Column:
    """Host of an address in lower case, without a leading www.; null if there is none."""
    found = F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1), r"^www\.", "")
    return F.when(found != "", found)


def keys(url: Column) -> Column:
    """What a pattern may name of an address: array of (pattern, rank)."""
    name = host(url)
    first = F.regexp_extract(url, r"^[^/]+://[^/?#]+(/[^/?#]*)", 1)
    labels = F.split(name, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)),
        lambda at: F.struct(
            F.concat(F.lit("host:"), F.array_join(F.slice(labels, at, F.size(labels)), ".")).alias("pattern"),
            F.least(F.lit(99), F.size(labels) - at + 1).alias("rank"),
        ),
    )
    own = F.array(
        F.struct(F.concat(F.lit("url:"), F.regexp_replace(url, "#.*$", "")).alias("pattern"), F.lit(URL).alias("rank")),
        F.struct(F.concat(F.lit("prefix:"), name, first).alias("pattern"), F.lit(PREFIX).alias("rank")),
    )
    return F.when(name.isNotNull(), F.concat(own, domains))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, verdict (block or allow), valid_from, valid_until (null: still) of a log of entries.

    Entries: list, pattern, verdict, action (list or delist), at.
    """
    log = (
        entries.filter("pattern IS NOT NULL AND at IS NOT NULL AND action IN ('list', 'delist')")
        .groupBy("list", "pattern", "at")
        .agg(F.max("action").alias("action"), F.min(F.when(F.col("action") == "list", F.coalesce("verdict", F.lit("block")))).alias("verdict"))
    )
    following = Window.partitionBy("list", "pattern").orderBy("at")
    return (
        log.withColumn("valid_until", F.lead("at").over(following))
        .filter("action = 'list'")
        .select("list", "pattern", "verdict", F.col("at").alias("valid_from"), "valid_until")
    )


def decide(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """page_id, url, fetched_at, blocked, n_active (entries active then), list, pattern, valid_from and valid_until of the entry that decides."""
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).alias("fetched_at"))
    looked_up = rows.filter("url IS NOT NULL AND fetched_at IS NOT NULL").select("url", "fetched_at").distinct()
    looked_up = looked_up.withColumn("key", F.explode(keys(F.col("url")))).select("url", "fetched_at", "key.pattern", "key.rank")
    active = looked_up.join(intervals(entries), "pattern").filter(
        "valid_from <= fetched_at AND (valid_until IS NULL OR fetched_at < valid_until)"
    )
    # The order of preference, as one comparable value.
    choice = F.struct("rank", F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocks"), "list", "pattern", "valid_from", "valid_until")
    decided = active.groupBy("url", "fetched_at").agg(F.count("*").alias("n_active"), F.max(choice).alias("by"))
    return rows.join(decided, ["url", "fetched_at"], "left").select(
        "page_id",
        "url",
        "fetched_at",
        F.coalesce(F.col("by.blocks") == 1, F.lit(False)).alias("blocked"),
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.col("by.list").alias("list"),
        F.col("by.pattern").alias("pattern"),
        F.col("by.valid_from").alias("valid_from"),
        F.col("by.valid_until").alias("valid_until"),
    )


def _number(text: Column) -> Column:
    """A number below 2**24 that only depends on the text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("int")


def crawl(pages: DataFrame) -> DataFrame:
    """The pages as captures: as the table has no fetch times, a day of 2024 follows from the page's id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), _number(F.col("page_id").cast("string")) % 366)
    return pages.select("page_id", "url", day.alias("fetched_at"))


def lists_of(pages: DataFrame) -> DataFrame:
    """Dated lists over the addresses that the pages hold: as the tables have none, entries follow from each pattern's text."""
    found = (
        pages.filter("url IS NOT NULL")
        .select(F.explode(keys(F.col("url"))).alias("key"))
        .select("key.pattern", "key.rank")
        .distinct()
        .withColumn("n", _number(F.col("pattern")))
        .withColumn(
            "list",
            F.expr(
                f"CASE WHEN rank = {URL} AND n % 40 = 0 THEN 'addresses' WHEN rank = {PREFIX} AND n % 15 = 0 THEN 'allowed' "
                f"WHEN rank < {PREFIX} AND n % 6 = 0 THEN 'hosts' END"
            ),
        )
        .filter("list IS NOT NULL")
        .withColumn("day", F.expr("date_add(DATE'2024-01-01', CAST(floor(n / 64) % 200 AS INT))"))
        .withColumn("verdict", F.expr("CASE WHEN list = 'allowed' THEN 'allow' ELSE 'block' END"))
    )
    log = F.expr(
        "array_compact(array(struct('list' AS action, day AS at), "
        "CASE WHEN n % 4 <> 0 THEN struct('delist' AS action, date_add(day, 60) AS at) END, "
        "CASE WHEN n % 3 = 0 THEN struct('list' AS action, date_add(day, 120) AS at) END))"
    )
    return found.withColumn("entry", F.explode(log)).select("list", "pattern", "verdict", "entry.action", "entry.at")


def op5_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, judged by the list entries that were active when it was fetched."""
    pages = table(spark, sf_dir, "pages")
    decided = decide(crawl(pages), lists_of(pages))
    return decided.withColumns({c: F.col(c).cast("string") for c in ("fetched_at", "valid_from", "valid_until")})


OP5_SQL = f"""
WITH named AS (
  SELECT page_id, url, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1), '^www\\.', ''), '') AS host,
         CAST(DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 6) AS BIGINT) % 366 AS INT) AS DATE) AS fetched_at
  FROM pages
), labelled AS (
  SELECT DISTINCT url, host, string_split(host, '.') AS labels FROM named WHERE host IS NOT NULL
), keyed AS (
  SELECT url, 'url:' || regexp_replace(url, '#.*$', '') AS pattern, {URL} AS rank FROM labelled
  UNION ALL
  SELECT url, 'prefix:' || host || regexp_extract(url, '^[^/]+://[^/?#]+(/[^/?#]*)', 1), {PREFIX} FROM labelled
  UNION ALL
  SELECT url, 'host:' || array_to_string(list_slice(labels, k, len(labels)), '.'), least(99, len(labels) - k + 1)
  FROM (SELECT url, labels, unnest(generate_series(1, greatest(1, len(labels) - 1))) AS k FROM labelled)
), numbered AS (
  SELECT *, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) AS n FROM (SELECT DISTINCT pattern, rank FROM keyed)
), listed AS (
  SELECT *, CAST(DATE '2024-01-01' + CAST((n // 64) % 200 AS INT) AS DATE) AS day,
         CASE WHEN rank = {URL} AND n % 40 = 0 THEN 'addresses' WHEN rank = {PREFIX} AND n % 15 = 0 THEN 'allowed'
              WHEN rank < {PREFIX} AND n % 6 = 0 THEN 'hosts' END AS list
  FROM numbered
), log AS (
  SELECT list, pattern, 'list' AS action, day AS dated FROM listed WHERE list IS NOT NULL
  UNION ALL SELECT list, pattern, 'delist', CAST(day + 60 AS DATE) FROM listed WHERE list IS NOT NULL AND n % 4 <> 0
  UNION ALL SELECT list, pattern, 'list', CAST(day + 120 AS DATE) FROM listed WHERE list IS NOT NULL AND n % 3 = 0
), spans AS (
  SELECT * FROM (SELECT list, pattern, action, dated AS valid_from, lead(dated) OVER (PARTITION BY list, pattern ORDER BY dated) AS valid_until FROM log)
  WHERE action = 'list'
), active AS (
  SELECT p.page_id, p.url, p.fetched_at, k.rank, CASE WHEN s.list = 'allowed' THEN 0 ELSE 1 END AS blocks, s.list, s.pattern, s.valid_from, s.valid_until
  FROM named p JOIN keyed k ON k.url = p.url JOIN spans s ON s.pattern = k.pattern
   AND s.valid_from <= p.fetched_at AND (s.valid_until IS NULL OR p.fetched_at < s.valid_until)
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY page_id, url) AS n_active,
         row_number() OVER (PARTITION BY page_id, url ORDER BY rank DESC, blocks DESC, list DESC, pattern DESC) AS place
  FROM active
)
SELECT p.page_id, p.url, CAST(p.fetched_at AS VARCHAR) AS fetched_at, coalesce(r.blocks = 1, false) AS blocked,
       coalesce(r.n_active, 0) AS n_active, r.list, r.pattern, CAST(r.valid_from AS VARCHAR) AS valid_from,
       CAST(r.valid_until AS VARCHAR) AS valid_until
FROM named p LEFT JOIN ranked r ON r.page_id = p.page_id AND r.url = p.url AND r.place = 1
"""
