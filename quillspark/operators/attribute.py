"""Who speaks: rules, a pluggable model, and corrections along the sequence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import mark_quotes, py_strip

# fixed values: verbs of saying
SPEECH_VERBS = (
    "said asked replied answered whispered shouted yelled cried muttered murmured exclaimed continued added remarked noted observed commented "
    "declared stated explained argued insisted agreed disagreed promised warned threatened begged pleaded laughed sighed groaned snapped growled"
).split()
_VERB = f"({'|'.join(SPEECH_VERBS)})"
TAG_AFTER = rf'(?U)"([^"]+)",\s+{_VERB}\s+(\S+)'
TAG_BEFORE = rf'(?U)^([A-Z][a-zA-Z\s]+)\s+{_VERB},\s+"([^"]+)"'
RULE_CONFIDENCE = 0.98
ALTERNATION_CONFIDENCE = 0.75
ALTERNATION_EVIDENCE = "alternation: A/?/A pattern suggests same speaker"


def dialogue_tag(text: Column, strip_marks: bool = False) -> Column:
    """(name, evidence) of a tag after or before a quote in the text, null if there is none.

    With `strip_marks` the name loses punctuation at its end.
    """
    after, before = text.rlike(TAG_AFTER), text.rlike(TAG_BEFORE)
    tidy = (lambda c: F.regexp_replace(py_strip(c), r"[^\w]+$", "")) if strip_marks else py_strip
    q, v, n = (F.regexp_extract(text, TAG_AFTER, i) for i in (1, 2, 3))
    n2, v2, q2 = (F.regexp_extract(text, TAG_BEFORE, i) for i in (1, 2, 3))
    return F.when(after, F.struct(tidy(n).alias("name"), F.concat(F.lit('tag: "'), q, F.lit('" '), v, F.lit(" "), n).alias("evidence"))).when(
        before, F.struct(tidy(n2).alias("name"), F.concat(F.lit("tag: "), n2, F.lit(" "), v2, F.lit(' "'), q2, F.lit('"')).alias("evidence"))
    )


def apply_rules(segments: DataFrame, strip_marks: bool = False) -> DataFrame:
    """Rows (book_id, id, speaker, confidence, evidence) for dialogue segments that hold their own tag."""
    tag = dialogue_tag(F.col("text"), strip_marks)
    return segments.where("kind = 'dialogue'").select("book_id", "id", tag.alias("tag")).where("tag IS NOT NULL").select("book_id", "id", F.col("tag.name").alias("speaker"), F.lit(RULE_CONFIDENCE).alias("confidence"), F.col("tag.evidence").alias("evidence"))


def apply_context_rules(segments: DataFrame) -> DataFrame:
    """The same where the tag stands in the narration that follows the quote: `"Hello," | said Mira.`"""
    in_order = W.partitionBy("book_id", "paragraph_id").orderBy("seg_idx")
    following = F.when(F.lead("kind").over(in_order) == "narration", F.lead("text").over(in_order))
    rows = segments.withColumn("_next", following).where("kind = 'dialogue'")
    name = F.regexp_extract("_next", rf"(?U)^{_VERB}\s+((?:(?:Mr|Mrs|Ms|Dr|St)\.\s*)?[A-Z]\w*(?:\s+[A-Z]\w*)*)", 2)
    return rows.where(name != "").select("book_id", "id", name.alias("speaker"), F.lit(RULE_CONFIDENCE).alias("confidence"), F.concat(F.lit("tag: "), F.col("_next")).alias("evidence"))


def set_speakers(segments: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """Segments with the found speakers (book_id, id, speaker, confidence, evidence); rows a user set stay."""
    new = found.select("book_id", "id", F.col("speaker").alias("_speaker"), F.col("confidence").alias("_confidence"), F.col("evidence").alias("_evidence"))
    hit = F.col("_speaker").isNotNull() & (F.col("source") != "user")
    joined = segments.join(new, ["book_id", "id"], "left")
    pick = lambda new_value, old: F.when(hit, new_value).otherwise(F.col(old)).alias(old)
    changed = {"speaker_id": pick(F.col("_speaker"), "speaker_id"), "speaker": pick(F.col("_speaker"), "speaker"), "confidence": pick(F.col("_confidence"), "confidence"), "source": pick(F.lit(source), "source"), "evidence": pick(F.col("_evidence"), "evidence")}
    return joined.select(*(changed.get(c, F.col(c)) for c in segments.columns))


def needs_attribution(segments: DataFrame) -> DataFrame:
    """Rows (book_id, paragraph_id): paragraphs with dialogue whose speaker is unknown and not set by a user."""
    return segments.where("kind = 'dialogue' AND source <> 'user' AND speaker_id = 'unknown'").select("book_id", "paragraph_id").distinct()


def marked_paragraphs(paragraphs: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows (book_id, paragraph_id, marked, ids): paragraph texts with open quotes as [Q1], [Q2], and the segments these stand for."""
    open_ = segments.where("kind = 'dialogue' AND source <> 'user' AND speaker_id = 'unknown'")
    lists = open_.groupBy("book_id", "paragraph_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "id", "text"))).alias("q"))
    joined = paragraphs.select("book_id", F.col("id").alias("paragraph_id"), "text").join(lists, ["book_id", "paragraph_id"])
    return joined.select("book_id", "paragraph_id", mark_quotes(F.col("text"), F.transform("q", lambda x: x["text"])).alias("marked"), F.transform("q", lambda x: x["id"]).alias("ids"))


#: Takes marked texts and allowed speakers, gives for each a list of (quote_id, speaker_id, confidence).
Attributor = Callable[[list[str], list[str]], list[list[tuple[str, str, float]]]]


def run_model(marked: DataFrame, attributor: Attributor, allowed: list[str]) -> DataFrame:
    """Rows (book_id, id, speaker, confidence, evidence) from a model over marked paragraphs; it is called once a batch on the executors.

    Unknown speakers stay unknown: a model may not make them the narrator.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            answers = attributor(rows["marked"].tolist(), allowed)
            out = []
            for book, ids, answer in zip(rows["book_id"], rows["ids"], answers):
                places = {f"Q{i + 1}": s for i, s in enumerate(ids)}
                out += [(book, places[q], s, float(c)) for q, s, c in answer if q in places]
            yield pd.DataFrame(out, columns=["book_id", "id", "speaker", "confidence"])

    kind = marked.schema["book_id"].dataType.simpleString()
    got = marked.select("book_id", "marked", "ids").mapInPandas(run, f"book_id {kind}, id string, speaker string, confidence double")
    speaker = F.when(F.col("speaker").isin("narrator", "unknown"), "unknown").otherwise(F.col("speaker"))
    return got.select("book_id", "id", speaker.alias("speaker"), "confidence", F.lit("llm").alias("evidence"))


def alternation(segments: DataFrame, *keys: str, order: str = "seg_idx", sure: float = ALTERNATION_CONFIDENCE, least: float = 0.0) -> DataFrame:
    """The segments with A/?/A filled in: an unsure dialogue row between two of one speaker becomes theirs.

    Only dialogue rows count as neighbours, within the keys. All rows are judged by
    what they were before. One window over the dialogue rows; narration isn't shuffled twice.
    """
    in_order = W.partitionBy(*keys, F.col("kind") == "dialogue").orderBy(order)
    before, after = F.lag("speaker_id").over(in_order), F.lead("speaker_id").over(in_order)
    trust_before, trust_after = F.lag("confidence").over(in_order), F.lead("confidence").over(in_order)
    fix = (
        (F.col("kind") == "dialogue") & (F.col("source") != "user") & (F.col("confidence") < sure)
        & (before != "") & (before == after) & (before != F.col("speaker_id")) & (trust_before >= least) & (trust_after >= least)
    )
    rows = segments.withColumn("_fix", F.coalesce(fix, F.lit(False))).withColumn("_new", before)
    pick = lambda value, old: F.when(F.col("_fix"), value).otherwise(F.col(old)).alias(old)
    changed = {"speaker_id": pick(F.col("_new"), "speaker_id"), "speaker": pick(F.col("_new"), "speaker"), "confidence": pick(F.lit(sure), "confidence"), "source": pick(F.lit("rule"), "source"), "evidence": pick(F.lit(ALTERNATION_EVIDENCE), "evidence")}
    return rows.select(*(changed.get(c, F.col(c)) for c in segments.columns))


def attribute(paragraphs: DataFrame, segments: DataFrame, attributor: Attributor, allowed: list[str]) -> DataFrame:
    """Rules first, the model for what is left, then the alternation rule in every paragraph that had open quotes."""
    open_ = needs_attribution(segments)
    work = segments.join(open_, ["book_id", "paragraph_id"], "left_semi").select(segments.columns)
    rest = segments.join(open_, ["book_id", "paragraph_id"], "left_anti").select(segments.columns)
    work = set_speakers(work, apply_rules(work), "rule")
    work = set_speakers(work, run_model(marked_paragraphs(paragraphs, work), attributor, [*allowed, "unknown"]), "llm")
    return rest.unionByName(alternation(work, "book_id", "paragraph_id"))


def attribution_stats(segments: DataFrame) -> DataFrame:
    """Rows (book_id, total, unknown, unknown_pct) over dialogue."""
    out = segments.where("kind = 'dialogue'").groupBy("book_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("speaker_id") == "unknown").alias("unknown"))
    return out.withColumn("unknown_pct", F.round(F.col("unknown") * 100 / F.col("total"), 1))


def attribution_export(paragraphs: DataFrame, segments: DataFrame) -> DataFrame:
    """A JSON text per book: its chapters, their paragraphs, the spans of these in order, and how many spans have no known speaker."""
    spans = segments.groupBy("book_id", F.col("paragraph_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seg_idx", "text", "speaker", "kind", "confidence", "source", "evidence"))).alias("spans"))
    paras = paragraphs.join(spans, ["book_id", "id"], "left").groupBy("book_id", "chapter_idx", "title").agg(F.array_sort(F.collect_list(F.struct("para_idx", "id", "text", "spans"))).alias("paragraphs"))
    books = paras.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_idx", "title", "paragraphs"))).alias("chapters"))
    total, unknown = F.count(F.lit(1)), F.count_if(F.col("speaker") == "unknown")
    stats = segments.groupBy("book_id").agg(F.struct(total.alias("total_spans"), unknown.alias("unknown_spans"), F.round(unknown * 100 / total, 1).alias("unknown_pct")).alias("stats"))
    none = F.struct(F.lit(0).cast("long").alias("total_spans"), F.lit(0).cast("long").alias("unknown_spans"), F.lit(0.0).alias("unknown_pct"))
    counted = books.join(stats, "book_id", "left").withColumn("stats", F.coalesce("stats", none))
    return counted.select("book_id", F.to_json(F.struct("book_id", "chapters", "stats")).alias("value"))
