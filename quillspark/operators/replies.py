"""Replies of a model, kept by the content of what was asked.

A request is a prompt, and its key a digest of model and prompt. What a stored reply
answers isn't sent again, whichever run, book or paragraph it came from; the rest is sent from tasks
in bounded batches, with retries and growing pauses, and stored.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import llm_quotes, prompt, text_hash
from ..storage import exists

REPLIES = "key STRING, reply STRING, attempts INT, error STRING"
#: Times that a request is sent again, and seconds before the first of these; the pause doubles from one to the next.
RETRIES, PAUSE = 2, 1.0
#: Requests that are sent at once; tasks that send at the same time.
BATCH, TASKS = 16, 8

#: Takes prompts, gives a reply for each, or None. It may raise; then all of them have failed.
Send = Callable[[list[str]], list[str | None]]


def requests(marked: DataFrame, allowed: list[str], model: str) -> DataFrame:
    """Marked paragraphs (see `marked_paragraphs`) with the prompt and its key."""
    text = prompt(F.col("marked"), F.array(*map(F.lit, allowed)))
    return marked.withColumn("prompt", text).withColumn("key", text_hash(F.lit(model), F.col("prompt")))


def well_formed(reply: str | None) -> bool:
    """Whether a reply has the shape that `llm_quotes` reads."""
    try:
        found = json.loads(reply or "")["attributions"]
        return isinstance(found, list) and all(isinstance(x.get(k), str) for x in found for k in ("quote_id", "speaker_id"))
    except (ValueError, KeyError, TypeError, AttributeError):
        return False


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The replies kept under a path, one for each key: a good one before a failure."""
    if not exists(path):
        return spark.createDataFrame([], REPLIES)
    rows = spark.read.schema(REPLIES).parquet(path)
    best = F.min(F.struct(F.col("error").isNotNull().alias("bad"), "attempts", "reply", "error")).alias("x")
    return rows.groupBy("key").agg(best).select("key", "x.reply", "x.attempts", "x.error")


def send_batch(prompts: list[str], send: Send, retries: int, pause: float) -> list[tuple[str | None, int, str | None]]:
    """(reply, attempts, error) for each prompt; only what failed is sent again."""
    out: list[tuple[str | None, int, str | None]] = [(None, 0, "not sent")] * len(prompts)
    left = list(range(len(prompts)))
    for attempt in range(retries + 1):
        if attempt:
            time.sleep(pause * 2 ** (attempt - 1))
        try:
            replies, error = send([prompts[i] for i in left]), "malformed"
        except Exception as failure:  # whatever a model's client raises
            replies, error = [None] * len(left), f"{type(failure).__name__}: {failure}"
        for i, reply in zip(left, replies):
            good = well_formed(reply)
            out[i] = (reply if good else None, attempt + 1, None if good else error)
        left = [i for i in left if out[i][2] is not None]
        if not left:
            break
    return out


def ask(wanted: DataFrame, path: str, send: Send, retries: int = RETRIES, pause: float = PAUSE, batch: int = BATCH, tasks: int = TASKS, failed_again: bool = False) -> DataFrame:
    """The requests with reply, attempts and error (null replies where all attempts failed).

    Requests with equal keys are sent once. `failed_again`: also send what failed in earlier runs. New replies are added to
    the table at `path` when all tasks are done; what a lost task has sent is sent again.
    """
    spark = wanted.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                got = send_batch(part["prompt"].tolist(), send, retries, pause)
                yield pd.DataFrame({"key": part["key"].tolist(), "reply": [g[0] for g in got], "attempts": [g[1] for g in got], "error": [g[2] for g in got]})

    known = stored(spark, path)
    known = known.where("error IS NULL") if failed_again else known
    new = wanted.groupBy("key").agg(F.min("prompt").alias("prompt")).join(known, "key", "left_anti")
    new.select("key", "prompt").repartition(tasks).mapInPandas(run, REPLIES).write.mode("append").parquet(path)
    return wanted.join(stored(spark, path), "key", "left")


def speakers_of(answered: DataFrame, fallback: str = "unknown") -> DataFrame:
    """Rows (book_id, id, speaker, confidence, evidence) from answered requests: what the replies say about a request's segments.

    Quotes that a reply doesn't name, and all of a request that failed, have the fallback as speaker, with no confidence. A model
    may not make anybody the narrator.
    """
    each = answered.select("book_id", llm_quotes(F.col("reply")).alias("said"), F.posexplode("ids").alias("i", "id"))
    # the first of a reply's answers for the quote
    own = F.filter("said", lambda q: q["quote_id"] == F.concat(F.lit("Q"), (F.col("i") + 1).cast("string")))
    each = each.select("book_id", "id", F.try_element_at(own, F.lit(1)).alias("got"))
    got = F.col("got")
    speaker = F.when(got["speaker_id"].isin("narrator", "unknown"), "unknown").otherwise(F.coalesce(got["speaker_id"], F.lit(fallback)))
    return each.select("book_id", "id", speaker.alias("speaker"), F.coalesce(got["confidence"], F.lit(0.0)).alias("confidence"), F.when(got.isNotNull(), "llm").otherwise("no reply").alias("evidence"))
