"""Queries over state, casts, reports and files: what the engine keeps between runs, written and read back where it has a format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import attribute, casting, evaluate, names, segment, store, structure
from ..schema import SEGMENTS as SCHEMA
from ..schema import ensure_columns
from ..sources import books
from ..sources.book_files import write_book_files
from ..sources.book_format import read_raw
from ..streaming import resume
from .inputs import DIALOGUE, NAMES, SEGMENTS, VOICES, dialogue, nation_voices, scratch, segments, table
from .inputs import names as book_names
from .queries import query

# ---- state


@query(
    """WITH o AS (SELECT c_custkey AS id, c_name AS project_name, c_mktsegment AS current_stage, 1000 + c_custkey AS created_at FROM customer WHERE c_custkey % 3 <> 0),
    n AS (SELECT c_custkey AS id, upper(c_name) AS project_name, 'casting' AS current_stage, 5000 + c_custkey AS created_at FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0)
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.project_name, o.project_name) AS project_name, coalesce(n.current_stage, o.current_stage) AS current_stage, CAST(coalesce(o.created_at, n.created_at) AS BIGINT) AS created_at FROM o FULL JOIN n ON o.id = n.id"""
)
def job_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that are new, known or both; the time of creation stays."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = c.where(key % 3 != 0).select(key.alias("id"), F.col("c_name").alias("project_name"), F.col("c_mktsegment").alias("current_stage"), (1000 + key).cast("long").alias("created_at"))
    new = c.where((key % 2 == 0) | (key % 3 == 0)).select(key.alias("id"), F.upper("c_name").alias("project_name"), F.lit("casting").alias("current_stage"), (5000 + key).cast("long").alias("created_at"))
    return store.save_jobs(old, new)


_STATUS = "(['pending', 'running', 'done', 'failed'])[event_id % 4 + 1]"


def _stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments with a status, a path for finished ones, and retries."""
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("pending", "running", "done", "failed"))), (key % 4 + 1).cast("int"))
    return e.select(F.col("user_id").alias("book_id"), key.cast("string").alias("id"), status.alias("status"), F.when(key % 4 == 2, F.concat(F.lit("a/"), key.cast("string"))).alias("audio_path"), (key % 3).cast("int").alias("retry_count"))


@query(
    f"""SELECT user_id AS book_id, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 5 = 1 THEN 'done' ELSE {_STATUS} END AS status,
    CASE WHEN event_id % 5 = 1 THEN 'b/' || event_id WHEN event_id % 4 = 2 THEN 'a/' || event_id END AS audio_path, CAST(event_id % 3 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS retry_count FROM events"""
)
def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures count a retry and keep the path, successes set it, others stay."""
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    done = key % 5 == 1
    updates = e.where(key % 5 <= 1).select(F.col("user_id").alias("book_id"), key.cast("string").alias("id"), F.when(done, "done").otherwise("failed").alias("status"), F.when(done, F.concat(F.lit("b/"), key.cast("string"))).alias("audio_path"), (~done).alias("retry"))
    return store.set_status(_stateful(spark, sf_dir), updates)


@query(f"""SELECT user_id AS book_id, CAST(event_id AS VARCHAR) AS id, {_STATUS} AS status FROM events WHERE event_id % 4 <> 2""")
def resume_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4, with what a crash left half done."""
    return store.unfinished(_stateful(spark, sf_dir), running=True).select("book_id", "id", "status")


def _told(paragraphs: DataFrame) -> DataFrame:
    """Every paragraph as a segment; those whose text ends in a mark are a user's."""
    p = F.format_string("c%02d-p%03d", "chapter_idx", "para_idx")
    user = F.col("text").endswith("(user)")
    return paragraphs.select(
        "book_id", F.concat(p, F.lit("-s00")).alias("id"), F.col("chapter_idx").alias("chapter"), p.alias("paragraph_id"), "para_idx", F.lit(0).alias("seg_idx"),
        F.lit("narration").alias("kind"), F.when(user, "user").otherwise("rule").alias("source"), "text", F.when(F.col("para_idx") % 2 == 0, "done").otherwise("pending").alias("status"),
    )


@query(
    """WITH p AS (SELECT CAST(conv_id // 10 AS VARCHAR) AS book_id, CAST(conv_id % 10 AS INTEGER) AS chapter, CAST(turn AS INTEGER) AS para_idx, text || CASE WHEN (conv_id + turn) % 5 = 0 THEN ' (user)' ELSE '' END AS text, conv_id, turn FROM conversations)
    SELECT book_id, format('c{:02d}-p{:03d}-s00', chapter + k * 100, para_idx) AS id, CAST(chapter + k * 100 AS INTEGER) AS chapter, CASE WHEN k = 1 THEN 'new ' || conv_id WHEN (conv_id + turn) % 5 <> 0 AND conv_id % 3 = 0 THEN 'later ' || turn ELSE text END AS text,
      CASE WHEN k = 0 AND (conv_id + turn) % 5 = 0 THEN 'user' ELSE 'rule' END AS source, CASE WHEN para_idx % 2 = 0 THEN 'done' ELSE 'pending' END AS status
    FROM p, (VALUES (0), (1)) t(k) WHERE k = 0 OR (conv_id % 3 = 0 AND turn = (SELECT min(turn) FROM p AS o WHERE o.conv_id = p.conv_id))"""
)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M, B4: paragraphs that come as a stream in two batches, the second with changed and new ones, and once more after a failure; the table read back."""
    c, folder = table(spark, sf_dir, "conversations"), scratch(spark, "stream")
    key = F.col("conv_id")
    mark = F.when((key + F.col("turn")) % 5 == 0, " (user)").otherwise("")
    first = c.select(F.floor(key / 10).cast("string").alias("book_id"), (key % 10).cast("int").alias("chapter_idx"), F.col("turn").cast("int").alias("para_idx"), F.concat("text", mark).alias("text"))
    first.write.parquet(f"{folder}/in")
    resume.stream_segments(spark, f"{folder}/in", f"{folder}/table", f"{folder}/state", _told).awaitTermination()
    third = c.where(key % 3 == 0).select(F.floor(key / 10).cast("string").alias("book_id"), (key % 10).cast("int").alias("chapter_idx"), F.col("turn").cast("int").alias("para_idx"), F.concat(F.lit("later "), F.col("turn").cast("string")).alias("text"))
    new = c.where(key % 3 == 0).groupBy("conv_id").agg(F.min("turn").cast("int").alias("para_idx")).select(F.floor(key / 10).cast("string").alias("book_id"), (key % 10 + 100).cast("int").alias("chapter_idx"), "para_idx", F.concat(F.lit("new "), key.cast("string")).alias("text"))
    second = third.unionByName(new)
    second.write.mode("append").parquet(f"{folder}/in")
    resume.stream_segments(spark, f"{folder}/in", f"{folder}/table", f"{folder}/state", _told).awaitTermination()
    resume.upsert(f"{folder}/table", _told(second), resume.versions(f"{folder}/table")[-1])
    return resume.table(spark, f"{folder}/table").select("book_id", "id", "chapter", "text", "source", "status")


@query(
    f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS book_id, CAST(event_id AS VARCHAR) AS id, CAST(event_id // 1000 AS INTEGER) AS chapter, {_STATUS} AS status, CASE WHEN user_id % 2 = 0 THEN 0 ELSE CAST(event_id % 3 AS INTEGER) END AS retry_count FROM events),
    m AS (SELECT min(CAST(book_id AS BIGINT)) AS b, max(CAST(id AS BIGINT)) AS i FROM e)
    SELECT 'book' AS scan, e.* FROM e, m WHERE book_id = CAST(b AS VARCHAR) UNION ALL SELECT 'chapter', e.* FROM e, m WHERE book_id = CAST(b AS VARCHAR) AND chapter = 0
    UNION ALL SELECT 'ids', e.* FROM e, m WHERE id IN (CAST(i AS VARCHAR), '0') UNION ALL SELECT 'status', e.* FROM e WHERE status IN ('pending', 'failed')"""
)
def state_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a stored table by book, chapter, ids and status; half of its rows come without retries, which are then counted from 0."""
    e, folder = table(spark, sf_dir, "events"), scratch(spark, "state")
    key, rows = F.col("event_id"), _stateful(spark, sf_dir).select(F.col("book_id").cast("string").alias("book_id"), "id", "status", "retry_count")
    rows = rows.withColumn("chapter", F.floor(F.col("id").cast("long") / 1000).cast("int"))
    even = F.col("book_id").cast("long") % 2 == 0
    resume.upsert(folder, rows.where(even).drop("retry_count"), 0)
    resume.upsert(folder, rows.where(~even), 1)
    least, most = (str(x) for x in e.agg(F.min("user_id"), F.max(key)).first())
    found = {
        "book": resume.scan(spark, folder, least), "chapter": resume.scan(spark, folder, least, chapter=0),
        "ids": resume.scan(spark, folder, ids=[most, "0"]), "status": resume.scan(spark, folder, status=["pending", "failed"]),
    }
    each = [df.select(F.lit(name).alias("scan"), "book_id", "id", "chapter", "status", "retry_count") for name, df in found.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query(
    """SELECT s_suppkey AS job_id, stage, CASE stage WHEN 'ingest' THEN 'done' ELSE 'running' END AS status, CASE stage WHEN 'ingest' THEN s_name END AS name, CASE stage WHEN 'attribute' THEN CAST(s_nationkey AS BIGINT) END AS unknown, true AS timed
    FROM supplier, (VALUES ('ingest'), ('attribute')) t(stage)"""
)
def stage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages added to a history, its metadata as JSON, read back."""
    s, path = table(spark, sf_dir, "supplier"), scratch(spark, "history")
    key = F.col("s_suppkey")
    s.select(store.stage_record(key, "ingest", "done", F.struct(F.col("s_name").alias("name")))).write.mode("append").parquet(path)
    s.select(store.stage_record(key, "attribute", "running", F.struct(F.col("s_nationkey").cast("long").alias("unknown")))).write.mode("append").parquet(path)
    h = spark.read.parquet(path)
    m = F.from_json("metadata", "name string, unknown bigint")
    return h.select("job_id", "stage", "status", m["name"].alias("name"), m["unknown"].alias("unknown"), F.col("recorded_at").isNotNull().alias("timed"))


@query(
    """SELECT o_custkey, o_orderkey, round(avg(o_orderkey % 50) OVER w, 6) AS mean_seconds, round(avg(o_orderkey % 50) OVER w * (count(*) OVER (PARTITION BY o_custkey) - count(*) OVER w), 6) AS eta_seconds
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)"""
)
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as segments that finish in order."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 50).alias("seconds"))
    return store.progress(o, "o_custkey", order="o_orderkey").select("o_custkey", "o_orderkey", F.round("mean_seconds", 6).alias("mean_seconds"), F.round("eta_seconds", 6).alias("eta_seconds"))


@query(
    """SELECT event_id, CAST(event_id * 7 % 9000 // 60 AS VARCHAR) || ':' || lpad(CAST(event_id * 7 % 60 AS VARCHAR), 2, '0') AS eta, CAST(CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id % 8 * 100 // (event_id % 9) END AS INTEGER) AS percent,
    CASE event_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'multi_voice' WHEN 2 THEN 'narrator_only' ELSE 'unsupported' END AS tier, sha256(event_type || chr(0) || 'fake' || chr(0) || 'v' || event_id || chr(0) || '1') AS voice_hash FROM
    (SELECT event_id, event_type FROM events)"""
)
def run_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes, times left, shares done, and what a machine can run."""
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    memory = F.when(key % 4 == 1, 8.0).when(key % 4 == 2, 7.9).when(key % 4 == 3, 3.9)
    return e.select(
        "event_id", text.eta_text(F.floor(key * 7 % 9000)).alias("eta"), text.percent(key % 8, key % 9).alias("percent"), text.hardware_tier(memory).alias("tier"),
        text.voice_hash(F.col("event_type"), F.lit("fake"), F.concat(F.lit("v"), key.cast("string"))).alias("voice_hash"),
    )


# ---- names and casts


@query(
    f"""WITH {SEGMENTS} SELECT book_id, speaker_id AS canonical, list_sort(list_distinct(list(CAST(chapter AS VARCHAR)))) AS aliases, count(*) AS mentions, speaker_id = 'unknown' AS is_unknown FROM segments GROUP BY book_id, speaker_id"""
)
def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G19."""
    return names.registry_summary(segments(spark, sf_dir).select("book_id", F.col("speaker_id").alias("canonical"), F.col("chapter").cast("string").alias("name")))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_names(spark, sf_dir).groupBy("book_id", F.col("name").alias("canonical")).agg(F.array_sort(F.collect_set(F.upper("name"))).alias("aliases"), F.count(F.lit(1)).alias("mentions"))


_REGISTRY = f"""{NAMES}, r AS (SELECT book_id, name AS canonical, count(*) AS mentions FROM names GROUP BY ALL),
    m AS (SELECT a.book_id, a.canonical AS source, 'Jane Smith' AS target FROM r a JOIN r b ON a.book_id = b.book_id WHERE b.canonical = 'Jane Smith' AND a.canonical IN ('Jane', 'Mrs. Smith'))"""


def _merges(registry: DataFrame) -> DataFrame:
    target = registry.where("canonical = 'Jane Smith'").select("book_id", F.col("canonical").alias("target"))
    return registry.where("canonical IN ('Jane', 'Mrs. Smith')").join(target, "book_id").select("book_id", F.col("canonical").alias("source"), "target", F.col("aliases").alias("source_aliases"), F.col("mentions").alias("source_mentions"))


@query(
    f"""WITH {_REGISTRY} SELECT r.book_id, coalesce(target, canonical) AS canonical, list_sort(list_distinct(flatten(list(CASE WHEN target IS NULL THEN [upper(canonical)] ELSE [upper(canonical), canonical] END)))) AS aliases, CAST(sum(mentions) AS BIGINT) AS mentions
    FROM r LEFT JOIN m ON r.book_id = m.book_id AND r.canonical = m.source GROUP BY r.book_id, coalesce(target, canonical)"""
)
def registry_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: two short forms merged into the full name wherever a book has them."""
    r = _registry(spark, sf_dir)
    return names.merge_entries(r, _merges(r))


@query(
    f"""WITH {_REGISTRY} SELECT 'undone' AS state, book_id, canonical, [upper(canonical)] AS aliases, mentions FROM r
    UNION ALL SELECT 'merged', r.book_id, coalesce(target, canonical), list_sort(list_distinct(flatten(list(CASE WHEN target IS NULL THEN [upper(canonical)] ELSE [upper(canonical), canonical] END)))), CAST(sum(mentions) AS BIGINT)
      FROM r LEFT JOIN m ON r.book_id = m.book_id AND r.canonical = m.source GROUP BY r.book_id, coalesce(target, canonical)"""
)
def registry_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: what a merge did, and the same undone."""
    r = _registry(spark, sf_dir)
    m = _merges(r)
    merged = names.merge_entries(r, m)
    columns = ["state", "book_id", "canonical", "aliases", "mentions"]
    return names.undo_merges(merged, m).withColumn("state", F.lit("undone")).select(columns).unionByName(merged.withColumn("state", F.lit("merged")).select(columns))


def _cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the characters of their nation's book."""
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(
        F.col("s_nationkey").cast("string").alias("book_id"), F.concat(F.lit("c"), key.cast("string")).alias("id"), F.col("s_name").alias("name"), F.col("s_name").alias("display_name"),
        F.array(F.concat(F.lit("a"), (key % 5).cast("string")), F.lit('the "old" one')).alias("aliases"), key.cast("long").alias("line_count"), (key % 12).cast("int").alias("first_chapter"),
        (key % 4 == 0).alias("user_locked"), F.when(key % 3 == 0, F.create_map(F.lit("fake"), F.concat(F.lit("v"), key.cast("string")))).alias("voice_assignments"),
    )


@query(
    """SELECT CAST(s_nationkey AS VARCHAR) AS book_id, 'c' || s_suppkey AS id, s_name AS name, ['a' || s_suppkey % 5, 'the "old" one'] AS aliases, CAST(s_suppkey AS BIGINT) AS line_count, CAST(s_suppkey % 12 AS INTEGER) AS first_chapter,
    s_suppkey % 4 = 0 AS user_locked, CASE WHEN s_suppkey % 3 = 0 THEN 'v' || s_suppkey END AS voice, s_nationkey % 3 <> 0 AS approved FROM supplier"""
)
def cast_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casts and their approval written and read back, beside a file that isn't a cast; the casts of every third book change after their approval."""
    path = scratch(spark, "casts")
    cast = _cast(spark, sf_dir)
    books.write_casts(cast, path)
    spark.createDataFrame([("not a cast",), ('{"book_id": 3',)], "value string").write.mode("append").text(path)
    back = books.read_casts(spark, path)
    casting.approve(back).write.json(path + "-approval")
    renamed = F.when((F.col("book_id").cast("int") % 3 == 0) & (F.col("line_count") == F.min("line_count").over(W.partitionBy("book_id"))), "Renamed").otherwise(F.col("display_name"))
    holds = casting.approval_holds(back.withColumn("display_name", renamed), spark.read.schema("book_id string, cast_hash string").json(path + "-approval"))
    return back.join(holds, "book_id").select("book_id", "id", "name", "aliases", "line_count", "first_chapter", "user_locked", F.col("voice_assignments")["fake"].alias("voice"), F.col("valid").alias("approved"))


_PAIRS = """c AS (SELECT CAST(s_nationkey AS VARCHAR) AS book_id, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier),
    p AS (SELECT a.book_id, a.k AS source, b.k AS target, a.k % 4 = 0 AND b.k % 4 <> 0 AS flipped, a.k % 4 = 0 AND b.k % 4 = 0 AS refused FROM c a JOIN c b ON a.book_id = b.book_id AND b.n = a.n + 1 WHERE a.n % 2 = 1)"""


def _character_merges(cast: DataFrame) -> DataFrame:
    """In each book the first with the second, the third with the fourth, and so on."""
    by_number = W.partitionBy("book_id").orderBy("line_count")
    rows = cast.select("book_id", F.col("id").alias("source"), F.lead("id").over(by_number).alias("target"), F.row_number().over(by_number).alias("n"))
    return rows.where("n % 2 = 1 AND target IS NOT NULL").select("book_id", "source", "target")


@query(
    f"""WITH {_PAIRS}, w AS (SELECT CASE WHEN flipped THEN source ELSE target END AS winner, CASE WHEN flipped THEN target ELSE source END AS loser FROM p WHERE NOT refused),
    s AS (SELECT s_nationkey, s_suppkey AS k, s_name AS name, ['a' || s_suppkey % 5, 'the "old" one'] AS aliases FROM supplier)
    SELECT CAST(s.s_nationkey AS VARCHAR) AS book_id, 'c' || s.k AS id, CAST(s.k + coalesce(l.k, 0) AS BIGINT) AS line_count, CASE WHEN l.k IS NULL THEN s.aliases ELSE list_sort(list_distinct(s.aliases || l.aliases || [l.name])) END AS aliases
    FROM s LEFT JOIN w ON s.k = w.winner LEFT JOIN s l ON l.k = w.loser WHERE s.k NOT IN (SELECT loser FROM w)"""
)
def character_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locked characters win, two locked ones stay."""
    cast = _cast(spark, sf_dir)
    return casting.merge_characters(cast, _character_merges(cast))[0].select("book_id", "id", "line_count", "aliases")


@query(
    f"""WITH {_PAIRS} SELECT book_id, 'c' || CASE WHEN flipped THEN source ELSE target END AS winner_id, 'c' || CASE WHEN flipped THEN target ELSE source END AS loser_id, CAST(CASE WHEN flipped THEN target ELSE source END AS BIGINT) AS loser_line_count FROM p WHERE NOT refused"""
)
def merge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of merges, added to a history and read back."""
    path, cast = scratch(spark, "merges"), _cast(spark, sf_dir)
    books.append_merges(casting.merge_characters(cast, _character_merges(cast))[1], path)
    return books.read_merges(spark, path).select("book_id", "winner_id", "loser_id", "loser_line_count")


@query(
    f"""WITH {_PAIRS}, w AS (SELECT CASE WHEN flipped THEN source ELSE target END AS winner, CASE WHEN flipped THEN target ELSE source END AS loser FROM p WHERE NOT refused)
    SELECT 'undone' AS state, CAST(s_nationkey AS VARCHAR) AS book_id, 'c' || s_suppkey AS id, s_name AS name, CAST(s_suppkey AS BIGINT) AS line_count, ['x' || s_suppkey] AS aliases, s_suppkey % 4 = 0 AS user_locked FROM supplier
    UNION ALL SELECT 'merged', CAST(s.s_nationkey AS VARCHAR), 'c' || s.s_suppkey, s.s_name, CAST(s.s_suppkey + coalesce(l.s_suppkey, 0) AS BIGINT), CASE WHEN l.s_suppkey IS NULL THEN ['x' || s.s_suppkey] ELSE list_sort(['x' || s.s_suppkey, 'x' || l.s_suppkey, l.s_name]) END, s.s_suppkey % 4 = 0
      FROM supplier s LEFT JOIN w ON s.s_suppkey = w.winner LEFT JOIN supplier l ON l.s_suppkey = w.loser WHERE s.s_suppkey NOT IN (SELECT loser FROM w)"""
)
def merge_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: merges, and the same undone from their record. Each character has an alias of its own: one that both had would go from the winner."""
    cast = _cast(spark, sf_dir).withColumn("aliases", F.array(F.concat(F.lit("x"), F.col("line_count").cast("string"))))
    after, record = casting.merge_characters(cast, _character_merges(cast))
    columns = ["state", "book_id", "id", "name", "line_count", "aliases", "user_locked"]
    return casting.undo_merge(after, record).withColumn("state", F.lit("undone")).select(columns).unionByName(after.withColumn("state", F.lit("merged")).select(columns))


@query(
    """SELECT 'c' || s_suppkey AS id, s_suppkey % 7 = 3 OR (s_suppkey % 7 = 5 AND s_suppkey % 5 = 2) AS hit FROM supplier"""
)
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By name in other case, by alias, or by nothing it has."""
    cast = _cast(spark, sf_dir).withColumn("key", F.col("line_count"))
    q = F.when(F.col("key") % 7 == 3, F.upper("name")).when(F.col("key") % 7 == 5, F.lit("A2")).otherwise(F.lit("nobody"))
    return cast.select("id", text.matches_name(q, F.col("name"), F.col("id"), F.col("display_name"), aliases=F.col("aliases")).alias("hit"))


@query(f"""WITH {VOICES} SELECT id FROM voices WHERE NOT narrator_reserved AND pos % 2 = 0 AND pos % 3 <> 0 AND pos % 4 <> 0""")
def verified_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5, F16: voices whose gender is verified, that the engine has."""
    pos = F.col("pos")
    v = nation_voices(spark, sf_dir).withColumns({"gender": F.when(pos % 2 == 0, "Female").otherwise("male"), "gender_verified": pos % 3 != 0, "engine": F.lit("fake"), "age_verified": F.lit(False), "age_bracket": F.lit("adult")})
    return casting.valid_voices(casting.verified_voices(v, "female", "unknown"), v.where("pos % 4 <> 0")).select("id")


# ---- reports and exports


@query(
    f"""WITH {DIALOGUE}, n AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_idx ORDER BY para_idx) AS n FROM dialogue),
    s AS (SELECT book_id, chapter_idx, n, replace(left(text, 120), chr(10), ' ') || CASE WHEN length(text) > 120 THEN '…' ELSE '' END AS shown FROM n WHERE n <= 2)
    SELECT book_id, chapter_idx, printf('%02d', chapter_idx + 1) || ' Part ' || chapter_idx || ' (0.85)' || chr(10) || '  ' || string_agg(shown, chr(10) || '  ' ORDER BY n) AS line FROM s GROUP BY book_id, chapter_idx"""
)
def chapter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2, I8."""
    d = dialogue(spark, sf_dir).withColumns({"title": F.concat(F.lit("Part "), F.col("chapter_idx").cast("string")), "confidence": F.lit(0.85)})
    return structure.chapter_report(d)


@query(
    f"""WITH {DIALOGUE} SELECT book_id, chapter_idx, format('c{{:02d}}-p{{:03d}}', chapter_idx, para_idx) AS id, text, CASE WHEN para_idx % 3 = 1 THEN 0 ELSE 2 END AS n_spans, CASE WHEN para_idx % 3 <> 1 THEN left(text, 3) || '|' || substr(text, 4) END AS spans,
      2 * count(*) FILTER (WHERE para_idx % 3 <> 1) OVER w AS total_spans, count(*) FILTER (WHERE para_idx % 3 = 2) OVER w AS unknown_spans, round(coalesce(count(*) FILTER (WHERE para_idx % 3 = 2) OVER w * 100 / nullif(2 * count(*) FILTER (WHERE para_idx % 3 <> 1) OVER w, 0), 0), 1) AS unknown_pct
    FROM dialogue WINDOW w AS (PARTITION BY book_id)"""
)
def attribution_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested export written and read back; paragraphs without segments have no spans."""
    p = dialogue(spark, sf_dir).withColumns({"id": F.format_string("c%02d-p%03d", "chapter_idx", "para_idx"), "title": F.lit("t")})
    some = p.where("para_idx % 3 <> 1")
    parts = F.array(F.struct(F.lit(1).alias("seg_idx"), F.expr("substr(text, 4)").alias("text")), F.struct(F.lit(0).alias("seg_idx"), F.left("text", F.lit(3)).alias("text")))
    spans = some.select("book_id", F.col("id").alias("paragraph_id"), "para_idx", F.inline(parts))
    spans = spans.withColumns({"speaker": F.when((F.col("para_idx") % 3 == 2) & (F.col("seg_idx") == 1), "unknown").otherwise("Mira"), "kind": F.lit("dialogue"), "confidence": F.lit(0.5), "source": F.lit("rule"), "evidence": F.lit(None).cast("string")})
    path = scratch(spark, "attribution")
    attribute.attribution_export(p, spans).select("value").write.text(path)
    shape = "book_id bigint, chapters array<struct<chapter_idx:int,title:string,paragraphs:array<struct<para_idx:int,id:string,text:string,spans:array<struct<seg_idx:int,text:string>>>>>>, stats struct<total_spans:bigint,unknown_spans:bigint,unknown_pct:double>"
    back = spark.read.text(path).select(F.from_json("value", shape).alias("b")).select("b.book_id", "b.stats.*", F.explode("b.chapters").alias("c"))
    counts = ["total_spans", "unknown_spans", "unknown_pct"]
    back = back.select("book_id", *counts, F.col("c.chapter_idx").alias("chapter_idx"), F.inline("c.paragraphs"))
    return back.select("book_id", "chapter_idx", "id", "text", *counts, F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"), F.array_join(F.transform("spans", lambda s: s["text"]), "|").alias("spans"))


@query(
    """WITH r AS (SELECT event_type AS variant, event_id AS run_id, ts AS started_at, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) SELECT variant, run_id FROM r WHERE n <= 5"""
)
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest runs of each variant."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("variant"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"))
    return evaluate.latest_runs(e, 5).select("variant", "run_id")


# ---- structure and files


@query(
    """WITH p AS (SELECT doc_id // 7 AS book_id, doc_id AS page_no, text FROM documents UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN -1 - doc_id // 7 ELSE doc_id // 7 END, doc_id + 0.5, 'page ' || doc_id FROM documents),
    h AS (SELECT *, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 50 AS has FROM p)
    SELECT book_id, count(*) AS n_pages, count(*) FILTER (WHERE has) AS n_text_pages, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_no) FILTER (WHERE has), '') AS text, CASE WHEN count(*) FILTER (WHERE has) = 0 THEN 'scanned' END AS error FROM h GROUP BY book_id"""
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts joined, with pages of a few words among them and in books of their own, which are marked as scans."""
    d, book = table(spark, sf_dir, "documents"), F.floor(F.col("doc_id") / 7)
    whole = d.select(book.alias("book_id"), F.col("doc_id").cast("double").alias("page_no"), "text")
    short = d.select(F.when(F.col("doc_id") % 2 == 0, -1 - book).otherwise(book).alias("book_id"), (F.col("doc_id") + F.lit(0.5)).alias("page_no"), F.concat(F.lit("page "), F.col("doc_id").cast("string")).alias("text"))
    return structure.pdf_text(whole.unionByName(short))


@query(
    """WITH f AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS b FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS book_id, CAST(i - 1 AS INTEGER) AS para_idx, format('c00-p{:03d}', i - 1) AS id, b[i] AS original_text FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM f)"""
)
def txt_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: documents as text files with returns and line feeds; blocks as they stand, cleaning has queries of its own."""
    d = table(spark, sf_dir, "documents")
    content = F.encode(F.replace("text", F.lit(". "), F.lit(".\r\n\r\n")), "UTF-8")
    rows = d.select(F.col("doc_id").cast("string").alias("book_id"), F.lit("t").alias("title"), content.alias("content"))
    return books.txt_paragraphs(books.txt_blocks(rows)).select("book_id", "para_idx", "id", "original_text")


_CLEANED = (
    "regexp_replace(regexp_replace(translate(replace(nfc_normalize(x), chr(173), ''), '‘’‚‛‹›“”„‟«»', '"
    + "''" * 6
    + '"' * 6
    + "'), '[ \\t]{2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
)


@query(
    rf"""WITH l AS (SELECT doc_id, i - 1 AS i, regexp_replace(lines[i], '^\s+|\s+$', '', 'g') AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    c AS (SELECT *, {_CLEANED} AS text, doc_id // 50 AS b, dense_rank() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1 AS chapter, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS in_chapter, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id, i) - 1 AS in_book FROM l WHERE x <> ''),
    p AS (SELECT *, CASE WHEN b % 3 = 0 THEN 0 ELSE chapter END AS chapter_idx, CASE WHEN b % 3 = 0 THEN in_book ELSE in_chapter END AS para_idx FROM c)
    SELECT CASE b % 3 WHEN 0 THEN 'book ' || b ELSE 'Title & ' || b END AS book_title, CAST(chapter_idx AS INTEGER) AS chapter_idx, CASE b % 3 WHEN 0 THEN 'book ' || b ELSE 'Chapter <' || doc_id || '>' END AS title,
      CAST(CASE b % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.9 ELSE 0.95 END AS DOUBLE) AS confidence, CAST(para_idx AS INTEGER) AS para_idx, format('c{{:02d}}-p{{:03d}}', chapter_idx, para_idx) AS id, x AS original_text, text FROM p"""
)
def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2, A3, A4, E9, L-Extractor: fifty documents a book and each a chapter, written by tasks as text, DOCX or EPUB files; the folder read back by the source."""
    d, folder = table(spark, sf_dir, "documents"), scratch(spark, "books")
    key, book = F.col("doc_id"), F.floor(F.col("doc_id") / 50)
    line = F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))).alias("para_idx", "text")
    kind = F.element_at(F.array(*map(F.lit, ("txt", "docx", "epub"))), (book % 3 + 1).cast("int"))
    named = [F.concat(F.lit("book "), book.cast("string")).alias("name"), kind.alias("format"), F.concat(F.lit("Title & "), book.cast("string")).alias("book_title")]
    rows = d.select(*named, (key % 50).cast("int").alias("chapter_idx"), F.concat(F.lit("Chapter <"), key.cast("string"), F.lit(">")).alias("title"), line).where("text <> ''")
    write_book_files(rows, folder).write.format("noop").mode("overwrite").save()
    titles = read_raw(spark, folder).select("book_id", F.col("title").alias("book_title")).distinct()
    return books.read_books(spark, folder).join(titles, "book_id").select("book_title", "chapter_idx", "title", "confidence", "para_idx", "id", "original_text", "text")


# ---- chunks


@query(
    """SELECT doc_id, unnest(out) AS chunk, generate_subscripts(out, 1) - 1 AS i FROM (SELECT doc_id, list_reduce(list_transform(s, lambda x: [x]), lambda a, b: CASE WHEN length(a[len(a)]) + 1 + length(b[1]) <= 250 THEN a[1:len(a) - 1] || [a[len(a)] || ' ' || b[1]] ELSE a || b END) AS out FROM
      (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents) WHERE len(s) > 0)"""
)
def sentence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed greedily; longer ones stay whole here, `chunk_packing` cuts them."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(segment.pack(segment.sentences(F.col("text")), 250)).alias("i", "chunk")).withColumn("i", F.col("i").cast("long"))


@query(
    """SELECT CAST(c_nationkey AS VARCHAR) AS book_id, CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey % 50 AS INTEGER) AS chapter, c_name AS text, 'narrator' AS speaker_id, CASE WHEN c_custkey % 2 = 0 THEN 'done' ELSE 'pending' END AS status, CAST(CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS retry_count,
    'rule' AS source, false AS continues_previous, CAST(1 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS audio_path, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS note FROM customer"""
)
def migrated_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two older tables of segments, one with fewer columns, one with other types and a column of its own, in the present schema."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    own = [F.col("c_nationkey").cast("string").alias("book_id"), key.cast("string").alias("id"), (key % 50).alias("chapter"), F.col("c_name").alias("text")]
    old = ensure_columns(c.where(key % 2 != 0).select(*own), SCHEMA)
    new = ensure_columns(c.where(key % 2 == 0).select(*own, F.lit("done").alias("status"), F.lit(2).cast("long").alias("retry_count"), F.col("c_mktsegment").alias("note")), SCHEMA)
    return old.unionByName(new, allowMissingColumns=True).select("book_id", "id", "chapter", "text", "speaker_id", "status", "retry_count", "source", "continues_previous", "confidence", "audio_path", "note")
