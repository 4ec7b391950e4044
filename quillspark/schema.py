"""Tables of the engine, and additive schema evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = ("dialogue", "narration", "thought")
STATUSES = ("pending", "running", "done", "failed", "skipped")
SOURCES = ("llm", "rule", "user")
STAGE_STATUSES = ("pending", "running", "done", "failed")

PARAGRAPHS = "book_id STRING, chapter_idx INT, para_idx INT, id STRING, text STRING, original_text STRING, is_dialogue BOOLEAN"
CHAPTERS = "book_id STRING, chapter_idx INT, id STRING, title STRING, confidence DOUBLE"
SEGMENTS = (
    "book_id STRING, id STRING, chapter INT, paragraph_id STRING, para_idx INT, seg_idx INT, speaker_id STRING, speaker STRING, kind STRING, "
    "confidence DOUBLE, source STRING, evidence STRING, voice_hash STRING, continues_previous BOOLEAN, text STRING, status STRING, audio_path STRING, retry_count INT"
)
VOICE_REF = "STRUCT<engine: STRING, voice_id: STRING, language: STRING>"
CHARACTERS = (
    "book_id STRING, id STRING, name STRING, display_name STRING, aliases ARRAY<STRING>, "
    "profile STRUCT<gender: STRING, gender_confidence: DOUBLE, age_bracket: STRING, age_confidence: DOUBLE>, "
    f"line_count BIGINT, first_chapter INT, user_locked BOOLEAN, voice {VOICE_REF}, voice_assignments MAP<STRING, STRING>, is_narrator BOOLEAN"
)
VOICES = (
    "id STRING, name STRING, engine STRING, gender STRING, gender_verified BOOLEAN, age_bracket STRING, age_verified BOOLEAN, accent STRING, accent_verified BOOLEAN, "
    "proxy_median_f0_hz DOUBLE, proxy_spectral_centroid_hz DOUBLE, acoustic_proxy_verified BOOLEAN, licence STRING, narrator_reserved BOOLEAN"
)
JOBS = "id STRING, book_id STRING, project_name STRING, mode STRING, current_stage STRING, stage_status STRING, created_at TIMESTAMP, updated_at TIMESTAMP, error STRING"
STAGES = "job_id STRING, stage STRING, status STRING, recorded_at TIMESTAMP, metadata STRING"
BOOK = (
    "id STRING, title STRING, author STRING, language STRING, source_path STRING, source_format STRING, schema_version STRING, metadata MAP<STRING, STRING>, "
    "chapters ARRAY<STRUCT<id: STRING, index: INT, title: STRING, confidence: DOUBLE, "
    "paragraphs: ARRAY<STRUCT<id: STRING, text: STRING, original_text: STRING, is_dialogue: BOOLEAN>>>>"
)
RUNS = (
    "run_id STRING, variant STRING, started_at TIMESTAMP, book STRING, model STRING, overall_accuracy DOUBLE, speech_only_accuracy DOUBLE, total_quotes BIGINT, "
    "style_breakdown MAP<STRING, DOUBLE>, confidence_breakdown MAP<STRING, MAP<STRING, DOUBLE>>"
)

#: What a column that an older table lacks is filled with.
DEFAULTS: dict[str, object] = {
    "speaker_id": "narrator", "speaker": "narrator", "confidence": 1.0, "source": "rule", "status": "pending", "retry_count": 0,
    "continues_previous": False, "language": "en", "author": "", "is_dialogue": False, "line_count": 0, "first_chapter": 0, "user_locked": False, "is_narrator": False,
}


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def ensure_columns(df: DataFrame, ddl: str) -> DataFrame:
    """The table in the given schema: missing columns get their default, others are cast; columns beyond it stay at the end."""
    fields = struct(ddl).fields
    have = set(df.columns)
    own = [(F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in fields]
    names = {f.name for f in fields}
    return df.select(*own, *(F.col(c) for c in df.columns if c not in names))


def mutual_speaker(speaker_id: Column, speaker: Column) -> Column:
    """Of the two speaker columns the one that isn't the narrator wins."""
    one, two = F.coalesce(speaker_id, F.lit("narrator")), F.coalesce(speaker, F.lit("narrator"))
    return F.when(one != "narrator", one).otherwise(two)


def in_unit(c: Column) -> Column:
    return c.isNotNull() & (c >= 0) & (c <= 1)


def invalid_segments(df: DataFrame) -> DataFrame:
    """Segments that break a domain or a bound, for a quarantine."""
    ok = F.col("kind").isin(*KINDS) & F.col("status").isin(*STATUSES) & F.col("source").isin(*SOURCES) & in_unit(F.col("confidence"))
    return df.where(~F.coalesce(ok, F.lit(False)))


def paragraph_id(chapter: Column, para: Column) -> Column:
    """`c00-p000`. Order by the ordinals: the text order holds only while the numbers fit their width."""
    return F.format_string("c%02d-p%03d", chapter.cast("int"), para.cast("int"))


def chapter_id(chapter: Column) -> Column:
    return F.format_string("c%02d", chapter.cast("int"))


def segment_id(paragraph: Column, seg: Column, chunk: Column | None = None) -> Column:
    """`<paragraph>-s00`, and a letter for the pieces of a split sentence."""
    base = F.format_string("%s-s%02d", paragraph, seg.cast("int"))
    if chunk is None:
        return base
    # the character with the number 97 + chunk; `char` starts again at 256
    letter = F.decode(F.unhex(F.lpad(F.hex(F.lit(97) + chunk), 8, "0")), "UTF-32")
    return F.concat(base, F.when(chunk.isNotNull(), letter).otherwise(F.lit("")))
