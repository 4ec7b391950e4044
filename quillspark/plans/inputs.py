"""The engine's relations, taken from the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..cluster import scratch, ship  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of books: each turn of a conversation as a quote with its tag; ten conversations are a book."""
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit('"'), "text", F.lit('", said '), F.initcap("role"), F.lit("."))
    open_ = F.concat(F.lit('"'), "text")
    return c.select(
        F.floor(F.col("conv_id") / 10).cast("long").alias("book_id"), (F.col("conv_id") % 10).cast("int").alias("chapter_idx"), F.col("turn").cast("int").alias("para_idx"),
        F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, open_).otherwise(text).alias("text"),
    )


DIALOGUE = """dialogue AS (
  SELECT conv_id // 10 AS book_id, CAST(conv_id % 10 AS INTEGER) AS chapter_idx, CAST(turn AS INTEGER) AS para_idx,
         CASE WHEN (conv_id + turn) % 5 = 0 THEN concat('"', text)
              ELSE concat('"', text, '", said ', upper(left(role, 1)) || lower(substr(role, 2)), '.') END AS text
  FROM conversations)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of books: each user's events in order; the type is the speaker."""
    e = table(spark, sf_dir, "events")
    speaker = F.when(F.col("event_type") == "signup", "narrator").when(F.col("event_type") == "error", "unknown").otherwise(F.col("event_type"))
    return e.select(
        F.col("user_id").alias("book_id"), "event_id", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("seg_idx"),
        speaker.alias("speaker_id"), speaker.alias("speaker"), F.when(F.col("event_id") % 4 == 0, "narration").otherwise("dialogue").alias("kind"),
        ((F.col("event_id") * 37 % 101) / 100.0).alias("confidence"), F.when(F.col("event_id") % 17 == 0, "user").otherwise("llm").alias("source"),
        F.lit(None).cast("string").alias("evidence"), F.floor(F.col("event_id") / 1000).cast("int").alias("chapter"),
    )


SEGMENTS = """segments AS (
  SELECT user_id AS book_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_idx,
         CASE event_type WHEN 'signup' THEN 'narrator' WHEN 'error' THEN 'unknown' ELSE event_type END AS speaker_id,
         CASE WHEN event_id % 4 = 0 THEN 'narration' ELSE 'dialogue' END AS kind,
         (event_id * 37 % 101) / CAST(100.0 AS DOUBLE) AS confidence, CASE WHEN event_id % 17 = 0 THEN 'user' ELSE 'llm' END AS source,
         CAST(event_id // 1000 AS INTEGER) AS chapter
  FROM events)"""


def predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predicted speakers with a confidence, gold speakers (of nine in ten), and styles (of four in five)."""
    e = table(spark, sf_dir, "events")
    predicted = e.select(F.col("event_id").alias("quote_id"), F.col("event_type").alias("speaker"), ((F.col("event_id") * 37 % 101) / 100.0).alias("confidence"))
    actual = F.when(F.col("event_id") % 7 < 4, F.col("event_type")).when(F.col("event_id") % 7 == 4, "GROUP").when(F.col("event_id") % 7 == 5, "view").otherwise("click")
    gold = e.where(F.col("event_id") % 10 != 3).select(F.col("event_id").alias("quote_id"), actual.alias("speaker"))
    style = F.element_at(F.array(*map(F.lit, ("tagged", "pronoun_tagged", "first_person"))), (F.col("event_id") % 3 + 1).cast("int"))
    return predicted, gold, e.where(F.col("event_id") % 5 != 0).select(F.col("event_id").alias("quote_id"), style.alias("style"))


PREDICTIONS = """predicted AS (SELECT event_id AS quote_id, event_type AS speaker, (event_id * 37 % 101) / CAST(100.0 AS DOUBLE) AS confidence FROM events),
gold AS (SELECT event_id AS quote_id, CASE WHEN event_id % 7 < 4 THEN event_type WHEN event_id % 7 = 4 THEN 'GROUP' WHEN event_id % 7 = 5 THEN 'view' ELSE 'click' END AS actual FROM events WHERE event_id % 10 <> 3),
styles AS (SELECT event_id AS quote_id, ['tagged', 'pronoun_tagged', 'first_person'][event_id % 3 + 1] AS style FROM events WHERE event_id % 5 <> 0),
scored AS (SELECT quote_id, speaker, confidence, coalesce(actual, 'unknown') AS actual FROM predicted LEFT JOIN gold USING (quote_id))"""


def nation_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A voice catalogue: every nation, with pitch and brightness from its key; one in nine isn't measured."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    return n.select(
        key.cast("int").alias("pos"), F.concat(F.lit("voice-"), key.cast("string")).alias("id"), (key == 0).alias("narrator_reserved"),
        F.when(key % 9 != 4, 160 + (key * 7 % 25 - 12) / 12 * 45).alias("f0"), (1900 + (key * 11 % 25 - 12) / 12 * 400).alias("centroid"),
    )


VOICES = """voices AS (
  SELECT CAST(n_nationkey AS INTEGER) AS pos, 'voice-' || n_nationkey AS id, n_nationkey = 0 AS narrator_reserved,
         CASE WHEN n_nationkey % 9 <> 4 THEN 160 + (n_nationkey * 7 % 25 - 12) / 12 * 45 END AS f0, 1900 + (n_nationkey * 11 % 25 - 12) / 12 * 400 AS centroid
  FROM nation)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in order in books: titles and parts of made-up names, from the orders."""
    o = table(spark, sf_dir, "orders")
    first = F.element_at(F.array(*map(F.lit, ("Mira", "Tomas", "Jane", "John", "Eleanor", "James"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    last = F.element_at(F.array(*map(F.lit, ("Vane", "Smith", "Miller", "Dursley"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    title = F.element_at(F.array(*map(F.lit, ("Mr. ", "Mrs. ", "", "", "Captain ", ""))), (F.col("o_custkey") % 6 + 1).cast("int"))
    form = F.col("o_orderkey") % 4
    name = F.when(form == 0, F.concat(title, last)).when(form == 1, first).when(form == 2, F.concat(first, F.lit(" "), last)).otherwise(F.concat(title, first, F.lit(" "), last))
    return o.select((F.col("o_custkey") % 500).cast("long").alias("book_id"), F.col("o_orderkey").alias("ord"), name.alias("name"))


NAMES = """parts AS (
  SELECT o_custkey % 500 AS book_id, o_orderkey AS ord, o_orderkey % 4 AS form,
         ['Mira', 'Tomas', 'Jane', 'John', 'Eleanor', 'James'][o_orderkey % 6 + 1] AS first,
         ['Vane', 'Smith', 'Miller', 'Dursley'][o_custkey % 4 + 1] AS last,
         ['Mr. ', 'Mrs. ', '', '', 'Captain ', ''][o_custkey % 6 + 1] AS title
  FROM orders),
names AS (SELECT book_id, ord, CASE form WHEN 0 THEN title || last WHEN 1 THEN first WHEN 2 THEN first || ' ' || last ELSE title || first || ' ' || last END AS name FROM parts)"""
