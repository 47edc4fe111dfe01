"""Tables the queries read: the given ones, and views Spark derives from them.

A derived view comes as a Spark builder and as the same SELECT for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

DOTTED = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return DERIVED[name][0](lambda t: load(spark, sf_dir, t))


def _graded_documents(t) -> DataFrame:
    labels = t("labels")
    documents = t("documents")
    return documents.join(labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "text", "n_chars", "quality", "toxic"
    )


def _first(pattern: str):
    return F.nullif(F.regexp_extract("text", pattern, 0), F.lit(""))


def _contacts(t) -> DataFrame:
    h = F.md5("text")
    uuid = F.concat_ws("-", h[0:8], h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))
    groups = [h.substr(4 * i + 1, 4) for i in range(8)]
    return t("documents").select(
        "doc_id",
        "lang",
        _first(fixed.EMAIL).alias("email"),
        _first(DOTTED).alias("ip4"),
        _first(fixed.US_PHONE).alias("phone"),
        _first(fixed.US_ZIPCODE).alias("zipcode"),
        F.when(F.col("doc_id") % 5 == 0, h).otherwise(uuid).alias("uuid"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(groups[0], F.lit("::"), groups[1]))
        .when(F.col("doc_id") % 7 == 1, F.concat(F.lit("::"), h))
        .otherwise(F.concat_ws(":", *groups))
        .alias("ip6"),
        F.split_part(F.col("text"), F.lit(" "), F.lit(1)).alias("first_word"),
        F.upper("lang").alias("country"),
        F.when(F.col("lang") == "en", "usd").when(F.col("lang") == "de", "EUR").when(
            F.col("lang") == "fr", "XXX"
        ).alias("currency"),
    )


_CONTACTS_SQL = rf"""
SELECT doc_id, lang,
  nullif(regexp_extract(text, '{fixed.EMAIL}', 0), '') AS email,
  nullif(regexp_extract(text, '{DOTTED}', 0), '') AS ip4,
  nullif(regexp_extract(text, '{fixed.US_PHONE}', 0), '') AS phone,
  nullif(regexp_extract(text, '{fixed.US_ZIPCODE}', 0), '') AS zipcode,
  CASE WHEN doc_id % 5 = 0 THEN h
       ELSE h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] END AS uuid,
  CASE WHEN doc_id % 7 = 0 THEN h[1:4] || '::' || h[5:8]
       WHEN doc_id % 7 = 1 THEN '::' || h
       ELSE h[1:4] || ':' || h[5:8] || ':' || h[9:12] || ':' || h[13:16] || ':' || h[17:20] || ':' || h[21:24]
            || ':' || h[25:28] || ':' || h[29:32] END AS ip6,
  split_part(text, ' ', 1) AS first_word,
  upper(lang) AS country,
  CASE lang WHEN 'en' THEN 'usd' WHEN 'de' THEN 'EUR' WHEN 'fr' THEN 'XXX' END AS currency
FROM (SELECT *, md5(text) AS h FROM documents)
"""


def _event_points(t) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    note = (
        F.when(user % 8 == 0, "")
        .when(user % 8 == 1, "   ")
        .when(user % 8 == 2, "n/a")
        .when(user % 8 == 3, F.concat(F.lit(" "), kind))
        .when(user % 8 == 5, F.concat(kind, F.lit(" x y")))
        .when(user % 8 != 4, kind)
    )
    return t("events").select(
        "event_id",
        "user_id",
        "ts",
        "event_type",
        "value",
        (F.col("value") - 50).alias("latitude"),
        (F.col("value") * 2 - 100).alias("longitude"),
        F.when(user % 10 != 0, kind == "purchase").alias("is_purchase"),
        F.regexp_extract("props", "[0-9]+", 0).alias("k_text"),
        note.alias("note"),
        F.when(user % 3 == 0, F.date_format("ts", "yyyy-MM-dd"))
        .when(user % 3 == 1, F.date_format("ts", "dd/MM/yyyy"))
        .otherwise(F.date_format("ts", "dd-MM-yyyy"))
        .alias("day_text"),
        F.when(user % 2 == 0, F.col("value").cast("decimal(10,2)").cast("string"))
        .otherwise(F.when(kind == "click", "yes").otherwise("0"))
        .alias("mixed_text"),
    )


_EVENT_POINTS_SQL = """
SELECT event_id, user_id, ts, event_type, value,
  value - 50 AS latitude, value * 2 - 100 AS longitude,
  CASE WHEN user_id % 10 <> 0 THEN event_type = 'purchase' END AS is_purchase,
  regexp_extract(props, '[0-9]+', 0) AS k_text,
  CASE user_id % 8 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN 'n/a' WHEN 3 THEN ' ' || event_type
       WHEN 4 THEN NULL WHEN 5 THEN event_type || ' x y' ELSE event_type END AS note,
  CASE user_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%d/%m/%Y')
       ELSE strftime(ts, '%d-%m-%Y') END AS day_text,
  CASE WHEN user_id % 2 = 0 THEN CAST(CAST(value AS DECIMAL(10, 2)) AS VARCHAR)
       WHEN event_type = 'click' THEN 'yes' ELSE '0' END AS mixed_text
FROM events
"""


def _order_keys(t) -> DataFrame:
    """Line items as references to orders, some shifted out of the key range."""
    return t("lineitem").select(
        "l_linenumber",
        F.when(F.col("l_linenumber") == 7, F.col("l_orderkey") + 10_000_000).otherwise(F.col("l_orderkey")).alias(
            "l_orderkey"
        ),
        "l_quantity",
    )


DERIVED = {
    "graded_documents": (
        _graded_documents,
        "SELECT d.doc_id, d.lang, d.source, d.text, d.n_chars, l.quality, l.toxic "
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "contacts": (_contacts, _CONTACTS_SQL),
    "event_points": (_event_points, _EVENT_POINTS_SQL),
    "order_keys": (
        _order_keys,
        "SELECT l_linenumber, CASE WHEN l_linenumber = 7 THEN l_orderkey + 10000000 ELSE l_orderkey END AS l_orderkey, "
        "l_quantity FROM lineitem",
    ),
    "finished_orders": (
        lambda t: t("orders").filter("o_orderstatus = 'F'"),
        "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    ),
    "row_copies": (
        lambda t: t("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount"),
        "SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount FROM lineitem",
    ),
}


def relation(name: str) -> str:
    """The table as something SQL can select from."""
    return name if name in GIVEN else f"({DERIVED[name][1].strip()}) AS {name}"
