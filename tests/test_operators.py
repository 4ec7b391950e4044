"""Structure, attribution, names, casting, state, audio, evaluation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.operators import attribute, audio, casting, evaluate, names, narrate, replies, store, structure
from quillspark.plans import queries


def paragraphs(spark, *texts, book="b"):
    return spark.createDataFrame([(book, 0, i, t, "", 0.4) for i, t in enumerate(texts)], "book_id string, chapter_idx int, para_idx int, text string, title string, confidence double")


def test_chapters_by_headings(spark):
    got = structure.by_headings(paragraphs(spark, "Preface text", "Chapter 1: The Start", "One.", "Two.", "CHAPTER II", "THE LONG NIGHT", "Three."), "book_id").orderBy("chapter_idx", "para_idx").collect()
    assert [(r.chapter_idx, r.title, r.confidence, r.para_idx, r.text) for r in got] == [
        (0, "", 0.4, 0, "Preface text"), (1, "Chapter 1: The Start", 0.75, 0, "One."), (1, "Chapter 1: The Start", 0.75, 1, "Two."), (2, "THE LONG NIGHT", 0.6, 0, "Three."),
    ]
    only = structure.by_headings(paragraphs(spark, "Chapter 1", "Chapter 2"), "book_id").orderBy("para_idx").collect()
    assert [(r.chapter_idx, r.title, r.confidence, r.text) for r in only] == [(0, "", 0.4, "Chapter 1"), (0, "", 0.4, "Chapter 2")]


def test_detection_prefers_the_override_and_keeps_sure_chapters(spark):
    weak = paragraphs(spark, "a", "Chapter 1", "b")
    sure = paragraphs(spark, "x", "Chapter 9", book="sure").withColumn("confidence", F.lit(0.95))
    override = spark.createDataFrame([("set", 0, "First", "c00-p000"), ("set", 1, "Second", "c00-p002"), ("set", 2, "Odd", "zz")], "book_id string, index int, title string, start_paragraph_id string")
    got = structure.detect_chapters(weak.union(sure).union(paragraphs(spark, "p", "q", "r", book="set")), override).orderBy("book_id", "chapter_idx", "para_idx").collect()
    assert [(r.chapter_idx, r.title, r.text, r.id) for r in got if r.book_id == "b"] == [(0, "", "a", "c00-p000"), (1, "Chapter 1", "b", "c01-p000")]
    assert [(r.chapter_idx, r.text) for r in got if r.book_id == "sure"] == [(0, "x"), (0, "Chapter 9")]
    assert [(r.title, r.text) for r in got if r.book_id == "set"] == [("First", "p"), ("First", "q"), ("Second", "r"), ("Odd", "p"), ("Odd", "q"), ("Odd", "r")]


def test_styled_sections(spark):
    rows = [(0, "Heading 1", "One"), (1, "Normal", "a"), (2, "Heading 2", "Two"), (3, "Heading 1", "Three"), (4, "", "b")]
    df = spark.createDataFrame([("b", *r) for r in rows], "book_id string, order int, style string, text string")
    got = structure.by_styles(df, "book_id").orderBy("chapter_idx", "para_idx").collect()
    assert [(r.chapter_idx, r.title, r.confidence, r.text) for r in got] == [(0, "One", 0.8, "a"), (1, "Two", 0.9, None), (2, "Three", 0.9, "b")]
    own = structure.by_styles(df, "book_id", exact=False).orderBy("chapter_idx").collect()
    assert [r.confidence for r in own] == [0.9, 0.8, 0.9]


def test_pdf_text_and_lines(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 60), ("a", 2, "short"), ("s", 1, "scan")], "book_id string, page_no int, text string")
    got = {r.book_id: r for r in structure.pdf_text(pages).collect()}
    assert (got["a"].text, got["a"].error, got["s"].error) == ("x" * 60, None, "scanned")
    lines = spark.createDataFrame([("b", i, t) for i, t in enumerate(["a", "b", "", "", "c"])], "book_id string, line_no int, text string")
    assert [r.text for r in structure.group_lines(lines, "book_id").orderBy("para_idx").collect()] == ["a b", "c"]


SEG = "book_id string, paragraph_id string, seg_idx int, id string, kind string, speaker_id string, speaker string, confidence double, source string, evidence string, text string"


def segs(spark, *rows):
    return spark.createDataFrame([("b", "p", i, f"s{i}", kind, who, who, conf, source, None, text) for i, (kind, who, conf, source, text) in enumerate(rows)], SEG)


def test_alternation(spark):
    fix = lambda *r: [(x.speaker_id, x.confidence, x.source) for x in attribute.alternation(segs(spark, *r), "book_id", "paragraph_id").orderBy("seg_idx").collect()]
    d = lambda who, conf, source="llm": ("dialogue", who, conf, source, "")
    assert fix(d("harry", 0.9), ("narration", "narrator", 1.0, "rule", ""), d("unknown", 0.5), d("harry", 0.9))[2] == ("harry", 0.75, "rule")
    assert fix(d("harry", 0.9), d("unknown", 0.5, "user"), d("harry", 0.9))[1] == ("unknown", 0.5, "user")
    assert fix(d("harry", 0.9), d("ron", 0.75), d("harry", 0.9))[1] == ("ron", 0.75, "llm")


def test_rules(spark):
    got = attribute.apply_rules(segs(spark, ("dialogue", "unknown", 0.0, "rule", '"Hello", said Harry'), ("dialogue", "unknown", 0.0, "rule", 'Mira Vane asked, "Why?"'), ("dialogue", "unknown", 0.0, "rule", '"Hello,"'), ("narration", "n", 0.0, "rule", '"A", said B')))
    assert {r.id: (r.speaker, r.evidence) for r in got.collect()} == {"s0": ("Harry", 'tag: "Hello" said Harry'), "s1": ("Mira Vane", 'tag: Mira Vane asked "Why?"')}
    near = attribute.apply_context_rules(segs(spark, ("dialogue", "unknown", 0.0, "rule", '"Hello,"'), ("narration", "narrator", 1.0, "rule", "said Mira Vane. She left."), ("dialogue", "unknown", 0.0, "rule", '"x"')))
    assert [(r.id, r.speaker) for r in near.collect()] == [("s0", "Mira Vane")]


def test_attribution_asks_the_model_for_open_quotes_only(spark):
    from quillspark.operators.segment import segment_paragraphs

    p = paragraphs(spark, '"Hi," he said. "There," she said.', "No quotes.", '"Locked," they said.').withColumn("id", schema.paragraph_id(F.col("chapter_idx"), F.col("para_idx")))
    s = segment_paragraphs(p)
    locked = F.col("paragraph_id") == "c00-p002"
    s = s.withColumns({"source": F.when(locked, "user").otherwise(F.col("source")), "speaker_id": F.when(locked, "Tomas").otherwise(F.col("speaker_id"))})

    def model(marked, allowed):
        assert all("[Q1]" in m and "Locked" not in m for m in marked)
        return [[("Q1", "narrator", 0.9), ("Q2", "Mira", 0.9), ("Q7", "x", 1.0)] for _ in marked]

    got = {r.id: r for r in attribute.attribute(p, s, model, ["Mira"]).collect()}
    assert (got["c00-p000-s00"].speaker_id, got["c00-p000-s02"].speaker_id, got["c00-p002-s00"].speaker_id) == ("unknown", "Mira", "Tomas")
    assert len(got) == s.count()


def test_name_resolution(spark):
    cases = {
        "longest": ["Mira", "Mira Vane", "Mira"], "title": ["Mira Vane", "Ms. Vane"], "two": ["James", "Eleanor"], "shared": ["John Smith", "Jane Smith", "Smith"],
        "generic": ["Captain Miller", "the Captain"], "spouses": ["Mr. Dursley", "Mrs. Dursley"], "parts": ["Harry Potter", "Harry", "Potter"], "empty": ["", None],
    }
    df = spark.createDataFrame([(b, i, n) for b, ns in cases.items() for i, n in enumerate(ns)], "book_id string, ord long, name string")
    got = {}
    for r in names.resolve_names(df).orderBy("book_id", "ord").collect():
        got.setdefault(r.book_id, []).append((r.canonical, r.flagged_reason))
    assert [x[0] for x in got["longest"]] == ["Mira Vane"] * 3 and [x[0] for x in got["title"]] == ["Mira Vane"] * 2
    assert got["shared"][2] == ("Smith", "multiple_matching_characters") and got["generic"][1] == ("the Captain", "ambiguous_generic_title")
    assert len({x[0] for x in got["spouses"]}) == 2 and {x[0] for x in got["parts"]} == {"Harry Potter"} and [x[0] for x in got["empty"]] == ["unknown", "unknown"]


def test_names_of_distinct_spellings_resolve_as_all_in_order(spark):
    rng = random.Random(5)
    pool = ["Mira", "mira", " Mira Vane ", "Vane", "Ms. Vane", "Mr. Vane", "Captain", "Captain Vane", "John Smith", "Jane Smith", "Smith", "Dr. John Smith", "", None, "NARRATOR", "unknown", "the old man", "Sir Tomas", "Tomas", "Éloi", "ÉLOI Vane"]
    rows = [(b, i * 3, rng.choice(pool)) for b in range(12) for i in range(60)]
    want = []
    for b in range(12):
        registry, own = names.Registry(), [r for r in rows if r[0] == b]
        got = [registry.resolve(n or "") for _, _, n in own]
        final = lambda x: registry.names[registry.alias[x.lower()]] if x.lower() in registry.alias else x  # noqa: E731, B023
        want += [(b, i, n, r, final(r), why) for (_, i, n), (r, why) in zip(own, got)]
    df = spark.createDataFrame(rows, "book_id int, ord long, name string").repartition(4)
    assert sorted(map(tuple, names.resolve_names(df).collect()), key=lambda r: r[:2]) == want


def test_names_follow_their_seeds(spark):
    df = spark.createDataFrame([(1, 0, "m"), (1, 1, "Mira Vane-Smith"), (1, 2, "Mira"), (2, 0, "m")], "book_id int, ord long, name string")
    seeds = spark.createDataFrame([(1, "Mira", ["M"]), (3, "None", [])], "book_id int, name string, aliases array<string>")
    got = names.resolve_names(df, seeds).orderBy("book_id", "ord").collect()
    assert [(r.resolved, r.canonical) for r in got] == [("Mira", "Mira Vane-Smith"), ("Mira Vane-Smith", "Mira Vane-Smith"), ("Mira Vane-Smith", "Mira Vane-Smith"), ("m", "m")]


def _plain_cast(cast, voices, near):
    free = [v for v in voices if not v["narrator_reserved"]]
    narrator = next((v["id"] for v in voices if v["narrator_reserved"]), voices[0]["id"] if voices else "narrator")
    pooled = len(cast) > len(free)
    extras = free[-2:] if pooled else []
    pool, given, out, turn = [v for v in free if v not in extras], {}, {}, 0
    for x in cast:
        if x["locked"]:
            out[x["id"]] = x["locked"]
            known = [v for v in voices if v["id"] == x["locked"]]
            given.update({x["id"]: v for v in known})
            pool = [v for v in pool if v not in known]

    def distance(a, b):
        return math.inf if None in (a["f0"], b["f0"]) else math.hypot((a["f0"] - b["f0"]) / 45, (a["centroid"] - b["centroid"]) / 400)

    for x in sorted(cast, key=lambda x: (-x["lines"], x["first"])):
        if x["id"] in out:
            continue
        if x["name"].strip().upper() == "I":
            out[x["id"]] = narrator
        elif x["lines"] <= 3 and pooled:
            out[x["id"]] = extras[turn % len(extras)]["id"] if extras else narrator
            turn += 1
        elif not pool:
            out[x["id"]] = extras[0]["id"] if extras else narrator
        else:
            fitting = [v for v in pool if x["gender"] == "unknown" or (v["gender_verified"] and v["gender"] == x["gender"])] or pool
            cost = lambda v: round(sum((1 - d) * n * 10 for o, u in given.items() if (n := near.get(frozenset((x["id"], o)), 0)) and (d := distance(v, u)) < 1), 9)  # noqa: E731, B023
            best = min(fitting, key=cost)
            pool.remove(best)
            given[x["id"]] = best
            out[x["id"]] = best["id"]
    return out


def test_measured_casting_equals_a_plain_one(spark):
    rng = random.Random(8)
    voices = [{"pos": i, "id": f"v{i}", "narrator_reserved": i == 2, "f0": rng.choice([None, *map(float, range(100, 200, 15))]), "centroid": 1500.0 + 100 * rng.randrange(8), "gender": rng.choice(["male", "female"]), "gender_verified": rng.random() < 0.7} for i in range(9)]
    kinds = "pos int, id string, narrator_reserved boolean, f0 double, centroid double, gender string, gender_verified boolean"
    rows, pairs, want = [], [], []
    for b in range(14):
        cast = [{"id": f"c{i}", "name": "i" if rng.random() < 0.1 else f"c{i}", "lines": rng.randrange(1, 12), "first": i, "gender": rng.choice(["male", "female", "unknown"]), "locked": rng.choice(["v1", "v4", "v2", "other"]) if rng.random() < 0.15 else None} for i in range(rng.choice([1, 4, 8, 9, 15]))]
        near = {frozenset((a["id"], c["id"])): rng.randrange(1, 9) for a in cast for c in cast if a["id"] < c["id"] and rng.random() < 0.6}
        rows += [(b, x["id"], x["id"] if x["name"] != "i" else "i", x["lines"], x["first"], x["gender"], "unknown", x["locked"] is not None, x["locked"]) for x in cast]
        pairs += [(b, *sorted(k), n) for k, n in near.items()]
        # characters of one name are told apart by id only where they have no voice of their own to lose
        alone = {x["id"] for x in cast if x["name"] != "i"}
        want += [(b, i, v) for i, v in _plain_cast(cast, voices, {k: n for k, n in near.items() if k <= alone}).items()]
    c = spark.createDataFrame(rows, "book_id int, id string, name string, line_count int, first_seen int, gender string, age_bracket string, user_locked boolean, locked_voice string")
    v = spark.createDataFrame([tuple(x.values()) for x in voices], kinds)
    p = spark.createDataFrame(pairs, "book_id int, a string, b string, n long")
    assert sorted(map(tuple, casting.assign_measured(c, v, p).collect())) == sorted(want)


def test_merge_and_undo(spark):
    r = spark.createDataFrame([("b", "Thomas", ["Thomas"], 3), ("b", "Tomas", ["Tomas", "T"], 2)], "book_id string, canonical string, aliases array<string>, mentions long")
    merged = names.merge_entries(r, spark.createDataFrame([("b", "Thomas", "Tomas")], "book_id string, source string, target string"))
    assert [tuple(x) for x in merged.collect()] == [("b", "Tomas", ["T", "Thomas", "Tomas"], 5)]
    history = spark.createDataFrame([("b", "Thomas", "Tomas", ["Thomas"], 3)], "book_id string, source string, target string, source_aliases array<string>, source_mentions long")
    assert sorted((x.canonical, sorted(x.aliases), x.mentions) for x in names.undo_merges(merged, history).collect()) == [("Thomas", ["Thomas"], 3), ("Tomas", ["T", "Tomas"], 2)]


def test_cast_seeds(spark):
    p = spark.createDataFrame([("b", 0, "Harry saw Ron."), ("b", 1, "Harry and Ron"), ("b", 2, "Harry")], "book_id string, chapter_idx int, text string")
    manual = spark.createDataFrame([("b", "Voldemort", ["Dark Lord", "You-Know-Who"])], "book_id string, name string, aliases array<string>")
    found = names.recognise(p, lambda t: [(n, t.count(n)) for n in ("Harry", "Ron") if n in t])
    assert [(r.name, r.mention_count, r.aliases) for r in names.cast_seeds(found, manual, 2).collect()] == [("Harry", 3, []), ("Ron", 2, []), ("Voldemort", 0, ["Dark Lord", "You-Know-Who"])]


def test_profiles(spark):
    cases = ["She walked. Everyone admired her courage. \"Stop,\" she cried.", "He saw him and his hat", "They and them and their", "nothing", "he she", "She was elderly, a real lady.", "The girl ran, a child", "A young man, a teen"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, x string")
    g, gc = casting.infer_gender(F.col("x"))
    a, ac = casting.infer_age(F.col("x"))
    got = [tuple(r) for r in df.select("i", g, gc, a, ac).orderBy("i").collect()]
    assert [r[1] for r in got[:5]] == ["female", "male", "nonbinary", "unknown", "male"] and got[3][2] == 0.0 and got[4][2] == 0.25 and got[0][2] > 0.7
    assert [r[3] for r in got[5:]] == ["elderly", "child", "young_adult"]


def test_profiles_add_up(spark):
    rows = [("b", "m", 0, "He is young "), ("b", "m", 1, "man of his word"), ("b", "m", 2, "She was young"), ("b", "n", 0, "young"), ("b", "n", 1, "child"), ("c", "m", 0, "lady")]
    df = spark.createDataFrame(rows, "book_id string, id string, place int, text string")
    got = {(r.book_id, r.id): (r.gender, r.gender_confidence, r.age_bracket, r.age_confidence) for r in casting.infer_profiles(df).collect()}
    assert got == {("b", "m"): ("male", 0.6667, "young_adult", 0.5), ("b", "n"): ("unknown", 0.0, "child", 1.0), ("c", "m"): ("unknown", 0.0, "adult", 1.0)}


def cast_rows(spark, *rows):
    return spark.createDataFrame([("b", n.lower(), n, n, [], lines, i, locked, voice) for i, (n, lines, locked, voice) in enumerate(rows)], "book_id string, id string, name string, display_name string, aliases array<string>, line_count long, first_seen int, user_locked boolean, locked_voice string")


def test_voices_in_order(spark):
    voices = spark.createDataFrame([(0, "n", True)] + [(i, f"v{i}", False) for i in range(1, 7)], "pos int, id string, narrator_reserved boolean")
    got = lambda *r: {x.id: x.voice_id for x in casting.assign_in_order(cast_rows(spark, *r), voices).collect()}
    assert got(("Minor", 2, False, None), ("Major", 50, False, None), ("I", 9, False, None), ("Set", 1, True, "v1")) == {"major": "v2", "minor": "v3", "i": "n", "set": "v1"}
    many = got(*[(f"A{i}", 20 - i, False, None) for i in range(4)], *[(f"B{i}", 2, False, None) for i in range(4)])
    assert [many[f"a{i}"] for i in range(4)] == ["v1", "v2", "v3", "v4"] and [many[f"b{i}"] for i in range(4)] == ["v5", "v6", "v5", "v6"]


def test_adjacency_and_merge(spark):
    s = spark.createDataFrame([("b", 0, 0, i, "Alice" if i % 2 else "Bob") for i in range(20)], "book_id string, chapter int, para_idx int, seg_idx int, speaker_id string")
    assert [tuple(r) for r in casting.adjacency(s).collect()] == [("b", "Alice", "Bob", 100)]
    c = cast_rows(spark, ("Mira", 3, False, None), ("Tomas", 2, True, None), ("Lock", 1, True, None)).withColumn("voice_assignments", F.lit(None).cast("map<string,string>"))
    merges = spark.createDataFrame([("b", "tomas", "mira"), ("b", "lock", "tomas"), ("b", "who", "mira")], "book_id string, source string, target string")
    after, record = casting.merge_characters(c, merges.where("source = 'tomas'"))
    assert {(r.id, r.line_count, tuple(r.aliases)) for r in after.collect()} == {("tomas", 5, ("Mira",)), ("lock", 1, ())}
    assert {r.error for r in casting.merge_characters(c, merges.where("source <> 'tomas'"))[1].collect()} == {"both are locked", "both characters must exist"}
    assert {r.id for r in casting.undo_merge(after, record).collect()} == {"mira", "tomas", "lock"}
    approved = casting.approve(c)
    assert len(approved.first().cast_hash) == 64 and casting.approval_holds(c, approved).first().valid
    assert not casting.approval_holds(casting.rename(c, "b", "mira", "M"), approved).first().valid
    assert casting.set_voice(c, "b", "MIRA", "fake", "v9").where("id = 'mira'").first().user_locked


def test_guarded_upsert(spark):
    old = spark.createDataFrame([("b", "s0", "Mira", "user", "I found it.", "done"), ("b", "s1", "x", "llm", "old", "done")], "book_id string, id string, speaker_id string, source string, text string, status string")
    new = spark.createDataFrame([("b", "s0", "narrator", "llm", "Overwritten?"), ("b", "s1", "Tomas", "llm", "new"), ("b", "s2", "y", "rule", "added")], "book_id string, id string, speaker_id string, source string, text string")
    got = {r.id: r for r in store.register_segments(old, new).collect()}
    assert (got["s0"].speaker_id, got["s0"].text) == ("Mira", "I found it.") and (got["s1"].speaker_id, got["s1"].status) == ("Tomas", "done") and got["s2"].status == "pending"
    assert {r.id: r.status for r in store.register_segments(old, new, reset_changed=True).collect()} == {"s0": "done", "s1": "pending", "s2": "pending"}
    full = store.register_segments(old, new)
    done = store.set_status(full, spark.createDataFrame([("b", "s2", "failed", "a.wav", True)], "book_id string, id string, status string, audio_path string, retry boolean")).where("id = 's2'").first()
    assert (done.status, done.audio_path, done.retry_count) == ("failed", "a.wav", 1)
    counts = {r.status: r.n for r in store.status_counts(full).collect()}
    assert counts == {"pending": 1, "running": 0, "done": 2, "failed": 0, "skipped": 0, "total": 3}
    assert store.unfinished(full).count() == 1 and schema.invalid_segments(full.withColumn("kind", F.lit("narration"))).count() == 0


def test_timeline_and_samples(spark):
    rows = [("c00-p000-s00", 0, 0, 0, 100), ("c00-p000-s01a", 0, 1, 0, 100), ("c00-p000-s01b", 0, 1, 1, None), ("c00-p000-s01c", 0, 1, 2, 100), ("c00-p001-s00", 1, 0, 0, 100)]
    df = spark.createDataFrame([("b", 0, i, i[:8], p, s, c, n) for i, p, s, c, n in rows], "book_id string, chapter int, id string, paragraph_id string, para_idx int, seg_idx int, chunk_idx int, samples long")
    got = audio.timeline(df, rate=1000).orderBy("start_sample").collect()
    assert [r.pause_ms for r in got] == [0, 300, 150, 700] and [r.start_sample for r in got] == [0, 400, 650, 1450]
    assert [(r.start_ms, r.end_ms) for r in audio.chapter_marks(audio.timeline(df, rate=1000), 1000).collect()] == [(0, 1550)]
    x = spark.createDataFrame([("one",), ("a b c",), ("w " * 60_000,)], "t string").select(audio.fake_samples(F.col("t"), 1000).alias("n")).collect()
    assert [r.n for r in x] == [200, 300, None]
    s = spark.createDataFrame([([0, 100, -200],), ([0, 0],), ([],)], "s array<smallint>").select(audio.peak_normalised(F.col("s")).alias("y")).collect()
    assert [r.y for r in s] == [[0, 1000, -2000], [0, 0], []]
    assert spark.range(1).select(audio.tone(F.lit(3).cast("long"), 22050).alias("t")).first().t == [int(32767 * math.sin(2 * math.pi * 440 * i / 22050)) for i in range(3)]
    d = spark.range(1).select(*(audio.acoustic_distance(*(F.lit(v).cast("double") for v in x)).alias(f"d{i}") for i, x in enumerate([(110, 1400, 235, 2550), (110, 1400, 115, 1450), (None, 1, 1, 1)]))).first()
    assert d.d0 > 2 and d.d1 < 0.5 and d.d2 == math.inf


def test_chapter_audio(spark):
    rows = [("b", 0, 0, 0, audio.to_wav(np.ones(10))), ("b", 0, 5, 15, audio.to_wav(np.ones(4)))]
    df = spark.createDataFrame(rows, "book_id string, chapter int, pause_samples long, start_sample long, audio binary")
    rate, x = audio.from_wav(bytes(audio.chapter_audio(df).first().wav))
    assert rate == audio.SAMPLE_RATE and x.tolist() == [1] * 10 + [0] * 5 + [1] * 4


P, G = "quote_id string, speaker string, confidence double", "quote_id string, speaker string"


def scored(spark, p, g):
    return evaluate.with_gold(spark.createDataFrame([(f"Q{i}", s, c) for i, (s, c) in enumerate(p)], P), spark.createDataFrame([(f"Q{i}", s) for i, s in enumerate(g)], G))


def test_accuracy_and_confusion(spark):
    s = scored(spark, [("a", 1.0), ("b", 0.5), ("a", 0.2), ("b", 0.96)], ["a", "a", "b", "GROUP"])
    r = evaluate.accuracy(s).first()
    assert (r.overall_accuracy, round(r.speech_only_accuracy, 4)) == (0.25, 0.3333)
    styles = spark.createDataFrame([("Q0", "tagged"), ("Q2", "tagged")], "quote_id string, style string")
    assert {x.style: x.accuracy for x in evaluate.accuracy_by_style(s, styles).collect()} == {"tagged": 0.5, "untagged": 0.0}
    assert [tuple(x) for x in evaluate.confusion(s, 2).collect()] == [("a", "b", 1), ("b", "GROUP", 1)]
    assert [x.total for x in evaluate.calibration_buckets(s).orderBy("lo").collect()] == [1, 1, 0, 1]
    assert [x.total for x in evaluate.calibration_buckets(s, closed=True).orderBy("lo").collect()] == [1, 1, 0, 2]


def test_curve_and_threshold(spark):
    s = scored(spark, [("a", 0.9)] * 6 + [("b", 0.3)] * 4, ["a"] * 10)
    curve = evaluate.calibration_curve(s)
    assert curve.count() == 20 and evaluate.propose_threshold(curve).first().tier == "both"
    assert round(evaluate.propose_threshold(curve).first().threshold, 4) == round(6 / 19, 4)
    assert evaluate.propose_threshold(curve, review=0.1).first().tier == "precision" and evaluate.propose_threshold(curve, precision=1.1).first().tier == "best"


def test_pairs_agreement_alignment(spark):
    pairs = lambda *x: spark.createDataFrame(list(x), "canonical string, alias string")
    r = evaluate.alias_prf(pairs(("alice", "ali"), ("alice", "ms_a"), ("bob", "bobby")), pairs(("alice", "ali"), ("bob", "bobby"), ("bob", "robert"))).first()
    assert {round(x, 4) for x in (r.precision, r.recall, r.f1)} == {0.6667}
    label = lambda x: spark.createDataFrame([(i, v) for i, v in enumerate(x)], "quote_id int, label string")
    k = evaluate.kappa(label("aba"), label("abb")).first()
    assert (round(k.agreement, 4), round(k.kappa, 4)) == (0.6667, 0.4)
    assert tuple(evaluate.kappa(label("aa"), label("aa")).first())[1:] == (1.0, 1.0) and tuple(evaluate.kappa(label(""), label("a")).first())[1:] == (0.0, 0.0)
    q = lambda *x: spark.createDataFrame(list(x), "quote_id string, text string")
    rows, counts = evaluate.alignment(q(("Q1", "a"), ("Q2", "b")), q(("Q2", "c"), ("Q3", "d")))
    assert {r.quote_id: r.outcome for r in rows.collect()} == {"Q1": "missed", "Q2": "matched", "Q3": "invented"} and counts.first().f1 == 0.5
    assert evaluate.alignment(q(("Q2", "b")), q(("Q2", "c")), by_text=True)[1].first().tp == 0


def test_styles_and_bootstrap(spark):
    rows = [("", ", said Alice.", ["a"]), ("He said, ", "", ["a"]), ("", "", ["a", "b"]), ("", "", ["I"]), ("", "", ["a", "b", "c"]), ('Mira said, "', "", [])]
    df = spark.createDataFrame(rows, "b string, a string, s array<string>")
    assert [r.y for r in df.select(evaluate.quote_style(F.col("b"), F.col("a"), F.col("s")).alias("y")).collect()] == ["tagged", "pronoun_tagged", "untagged", "first_person", "three_or_more", "tagged"]
    found = spark.createDataFrame([("Q1", "tagged"), ("Q2", "tagged")], "quote_id string, style string")
    moved = evaluate.style_counts(found, spark.createDataFrame([("Q1", "untagged"), ("Q2", "untagged")], "quote_id string, style string"))
    assert {r.style: r.n for r in moved.collect()} == {"tagged": 0, "untagged": 2}
    v = spark.createDataFrame([(float(i % 4 > 0),) for i in range(400)], "v double")
    r = evaluate.bootstrap(v, "v", rounds=200, seed=3).first()
    assert 0.65 < r.lower < 0.75 < r.upper < 0.85 and tuple(evaluate.bootstrap(v.limit(0), "v", rounds=10).first()) == (0.0, 0.0)


def test_voice_assignment_measured_takes_every_voice(spark, tmp_path):
    spark.range(60).selectExpr("id AS n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(60).selectExpr("120 * id + 40 AS o_custkey", "id AS o_orderkey").where("o_custkey % 11 <> 0").limit(50).write.parquet(f"{tmp_path}/orders.parquet")  # one book
    got = queries.QUERIES["voice_assignment_measured"](spark, str(tmp_path)).collect()
    assert len(got) == 50 == len({r.voice_id for r in got}) and "voice-0" not in {r.voice_id for r in got}


def test_bootstrap_doesnt_depend_on_how_rows_are_dealt_out(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, float(rng.random() < 0.7)) for k in ("a", "b") for _ in range(400 if k == "a" else 9)] + [("c", None)], "k string, v double")
    got = [sorted(map(tuple, evaluate.bootstrap(df.repartition(n), "v", "k", rounds=300, seed=5).collect())) for n in (1, 7)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == ["a", "b"]
    (_, low, high), (_, wide_low, wide_high) = got[0]
    share = df.where("k = 'a'").agg(F.avg("v")).first()[0]
    assert low < share < high and 0.06 < high - low < 0.12 < wide_high - wide_low
    assert got[0] != sorted(map(tuple, evaluate.bootstrap(df, "v", "k", rounds=300, seed=6).collect()))


def test_poisson_draws_have_their_mean_and_variance(spark):
    for mean in (1.0, 8.0, 31.0, 32.0, 5000.0):
        x = spark.range(20_000).select(F.lit(mean).alias("n"), ((F.xxhash64("id") / 2.0**64) + 0.5).alias("a"), ((F.xxhash64("id", F.lit(1)) / 2.0**64) + 0.5).alias("b"))
        m, v = x.select(evaluate._poisson(F.col("n"), F.col("a"), F.col("b")).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
        assert abs(m - mean) < 4 * math.sqrt(mean / 20_000) and abs(v / mean - 1) < 0.06


def test_replies_are_sent_once_and_kept(spark, tmp_path):
    marked = spark.createDataFrame([(b, f"p{i}", f"[Q1] and [Q2] {i % 4}", [f"p{i}-s0", f"p{i}-s1", f"p{i}-s2"]) for b in (1, 2) for i in range(6)], "book_id int, paragraph_id string, marked string, ids array<string>")
    path, log = str(tmp_path / "replies"), tmp_path / "log"
    log.mkdir()
    good = '{"attributions": [{"quote_id": "Q1", "speaker_id": "Mira", "confidence": "high"}, {"quote_id": "Q2", "speaker_id": "narrator", "confidence": 0.2}]}'

    def send(prompts):
        first = [p for p in prompts if not (log / str(hash(p[-1]))).exists()]
        for p in prompts:
            with (log / str(hash(p[-1]))).open("a") as f:
                f.write(p[-1])
        if any(p.endswith("1") for p in first):
            raise ConnectionError("no route")  # all of the batch
        return [None if p.endswith("2") else "[]" if p.endswith("3") and p in first else good for p in prompts]

    wanted = replies.requests(marked, ["Mira"], "m")
    assert wanted.select("key").distinct().count() == 4 and "Mira" in wanted.first().prompt
    got = replies.ask(wanted, path, send, pause=0.0, tasks=1)
    rows = {(r.book_id, r.paragraph_id): r for r in got.collect()}
    assert len(rows) == 12 and {rows[b, f"p{i}"].error for b in (1, 2) for i in (2,)} == {"malformed"} and rows[1, "p2"].attempts == 3 and rows[1, "p2"].reply is None
    assert rows[2, "p0"].attempts == rows[1, "p4"].attempts == 2 and rows[1, "p1"].attempts == 2
    sent = sum(p.stat().st_size for p in log.iterdir())
    assert replies.ask(wanted, path, send, pause=0.0).where("reply IS NULL").count() == 2 and sum(p.stat().st_size for p in log.iterdir()) == sent
    replies.ask(wanted, path, send, pause=0.0, failed_again=True)
    assert sum(p.stat().st_size for p in log.iterdir()) == sent + 3
    found = {(r.book_id, r.id): (r.speaker, r.confidence, r.evidence) for r in replies.speakers_of(got).collect()}
    assert found[1, "p0-s0"] == ("Mira", 0.95, "llm") and found[1, "p0-s1"] == ("unknown", 0.2, "llm") and found[1, "p0-s2"] == found[2, "p2-s0"] == ("unknown", 0.0, "no reply")


def test_pauses_grow(monkeypatch):
    waited = []
    monkeypatch.setattr(replies.time, "sleep", waited.append)
    assert replies.send_batch(["a", "b"], lambda ps: ['{"attributions": []}' if p == "a" else "?" for p in ps], 3, 0.5) == [('{"attributions": []}', 1, None), (None, 4, "malformed")]
    assert waited == [0.5, 1.0, 2.0]
    for bad in (None, "", "x", "[]", "{}", '{"attributions": 1}', '{"attributions": [1]}', '{"attributions": [{"quote_id": "Q1"}]}'):
        assert not replies.well_formed(bad)


def ticks(fail=""):
    """An engine whose samples tell the text; texts with a mark fail."""

    class Ticks:  # in a function, for tasks can't import the tests
        name, rate, max_chars = "ticks", 100, 40

        def synthesise(self, text, voice):
            if fail and fail in text:
                raise OSError("no device")
            return np.arange(1, len(text) + 1) * (-1) ** len(text)

    return Ticks()


def test_narration_is_laid_out_in_parts(spark, tmp_path):
    texts = [("b", 0, 0, "One. Two is longer. Fail now!"), ("b", 0, 1, "A sentence without any end, that is longer than forty characters, by far"), ("b", 1, 0, "Second chapter."), ("c", 0, 0, "Fail.")]
    df = spark.createDataFrame(texts, "book_id string, chapter_idx int, para_idx int, text string")
    folder, seen = str(tmp_path / "n"), []
    first = narrate.narrate(df, folder, ticks("Fail"), lambda done, total: seen.append((done, total)), speakable=False)
    assert {r.status for r in first.where("text LIKE 'Fail%'").collect()} == {"failed"} and seen == [(0, 8), (6, 8)]
    again = narrate.narrate(df, folder, ticks("Fail."), lambda done, total: seen.append((done, total)), speakable=False)
    rows = {r.id: (r.status, r.retry_count) for r in again.where("text LIKE 'Fail%'").collect()}
    assert seen[2:] == [(6, 8), (7, 8)] and sorted(rows.values()) == [("done", 1), ("failed", 2)]
    # only what wasn't done was spoken again
    assert [spark.read.parquet(f"{folder}/spoken/version={v}").count() for v in (0, 2)] == [8, 2]
    placed = narrate.placed(spark, folder, 100)
    for size in (7, 33, 10_000):
        out = str(tmp_path / f"chapters{size}")
        parts = narrate.write_chapters(placed, out, 100, size)
        assert parts.where("part >= 0").agg(F.max("samples")).first()[0] <= size
        for chapter, pieces in ((0, ["One.", 30, "Two is longer.", 30, "Fail now!", 70, "A sentence without any end,", 15, "that is longer than forty characters,", 15, "by far"]), (1, ["Second chapter."])):
            raw = b"".join((tmp_path / f"chapters{size}" / "b" / f"{chapter:05d}" / p.name).read_bytes() for p in sorted((tmp_path / f"chapters{size}" / "b" / f"{chapter:05d}").iterdir()))
            rate, x = audio.from_wav(raw)
            want = [v for p in pieces for v in ([0] * p if isinstance(p, int) else [k * (-1) ** len(p) * 10 for k in range(1, len(p) + 1)])]
            assert rate == 100 and x.tolist() == want, (size, chapter)
    assert not (tmp_path / "chapters7" / "c").exists()


def test_narration_broadcasts_nothing_by_the_size_of_its_files(spark, tmp_path):
    df = spark.createDataFrame([("b", 0, 0, "One. Two is longer."), ("b", 1, 0, "Second chapter.")], "book_id string, chapter_idx int, para_idx int, text string")
    folder = str(tmp_path / "n")
    narrate.narrate(df, folder, ticks(None), speakable=False)
    placed = narrate.placed(spark, folder, 100)
    for rows in (placed, narrate.spoken(spark, folder)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # what asks for no samples reads the layout alone
    assert "Join" not in placed.select("book_id", "chapter", "total").distinct()._jdf.queryExecution().executedPlan().toString()
    assert not (tmp_path / "n" / "segments" / "_batch").exists()


def test_narration_takes_books_a_lot_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(narrate.resume, "STEP_BYTES", 1)
    df = spark.createDataFrame([(f"b{b}", c, 0, "One. Two is longer. Fail now!") for b in range(12) for c in range(2)], "book_id string, chapter_idx int, para_idx int, text string")
    folder, table = str(tmp_path / "n"), str(tmp_path / "n" / "segments")
    lots = []
    dealt = narrate.resume._dealt
    monkeypatch.setattr(narrate.resume, "_dealt", lambda rows, *a: lots.append({r[0] for r in rows.select(narrate.resume.lot_of(F.col("book_id"), 64)).distinct().collect()}) or dealt(rows, *a))
    for fail in ("Fail", "?"):
        got = narrate.narrate(df, folder, ticks(fail), speakable=False)
        # what is shuffled to write a version is of one lot, and a run leaves no version but its last
        assert len(lots) > 8 and all(len(own) <= 1 for own in lots)
        assert len(narrate.resume.versions(table)) == 1 and len({n.parts[-3] for n in (tmp_path / "n" / "segments").rglob("*.parquet")}) == 1
    assert {tuple(r) for r in got.groupBy("status", "retry_count").count().collect()} == {("done", 0, 48), ("done", 1, 24)}
    assert len(narrate.resume.steps(table)) == len(set().union(*lots)) > 1
    parts = {(r.book_id, r.chapter, r.part): r for r in narrate.narrated_chapters(spark, folder, str(tmp_path / "c"), 100, 7).collect()}
    assert not (tmp_path / "n" / "layout").exists()
    whole = {(r.book_id, r.chapter, r.part): r for r in narrate.write_chapters(narrate.placed(spark, folder, 100), str(tmp_path / "w"), 100, 7).collect()}
    assert parts.keys() == whole.keys() and len(parts) == 24 * 14
    for (book, chapter, part), r in parts.items():
        # small parts share a file, and each is found in it
        raw = (tmp_path / "w" / book / f"{chapter:05d}" / "part-000001").read_bytes()
        assert r.path == str(tmp_path / "c" / book / f"{chapter:05d}" / "part-000001") and (tmp_path / "c" / book / f"{chapter:05d}" / "part-000001").read_bytes() == raw
        assert (r.offset, r.samples) == ((0, 0) if part < 0 else (44 + 14 * part, min(7, (len(raw) - 44) // 2 - 7 * part)))


def test_large_parts_have_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(narrate, "FILE_SAMPLES", 21)
    df = spark.createDataFrame([("b", 0, 0, "One. Two is longer.")], "book_id string, chapter_idx int, para_idx int, text string")
    narrate.narrate(df, str(tmp_path / "n"), ticks(None), speakable=False)
    for size, files in ((7, 3), (10, 3), (22, 3), (30, 2), (60, 1)):
        out = tmp_path / f"c{size}"
        rows = narrate.write_chapters(narrate.placed(spark, str(tmp_path / "n"), 100), str(out), 100, size).collect()
        raw = b"".join(p.read_bytes() for p in sorted((out / "b" / "00000").iterdir()))
        assert len({r.path for r in rows}) == files and audio.from_wav(raw)[1].tolist() == [10, 20, 30, 40] + [0] * 30 + [k * 10 for k in range(1, 15)]
        assert all(len(open(r.path, "rb").read()[r.offset :]) >= 2 * r.samples for r in rows) and sum(r.samples for r in rows) == 48


def test_the_stand_in_engine():
    silent, tone = narrate.FakeEngine(), narrate.FakeEngine(tone=True)
    assert len(silent.synthesise("one", "narrator")) == 4410 and not silent.synthesise("a b c", "narrator").any() and tone.synthesise("x", "narrator")[25] == int(32767 * math.sin(2 * math.pi * 440 / 22050 * 25))
    with pytest.raises(ValueError, match="100000 characters"):
        silent.synthesise("a" * 100_001, "narrator")
    assert narrate.wav_header(3, 22050) + b"\0" * 6 == audio.to_wav(np.zeros(3))


def test_peak_normalise_multiplies_floats_as_its_sql(spark, tmp_path):
    # 0.196 as a float lies below 0.196: its thousandfold is 196 among floats, but 195.99999 among doubles
    spark.createDataFrame([(1, [0.196, -0.196, 0.5])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [(r.vec_id, r.samples) for r in queries.QUERIES["peak_normalise"](spark, str(tmp_path)).collect()] == [(1, [1960, -1960, 5000])]


def test_profiles_by_ascii_words(spark):
    rows = [("b", "m", 0, "a teenß came"), ("b", "m", 1, "so young"), ("b", "m", 2, "manä and ämisS"), ("b", "n", 0, "oldß; not a_man")]
    df = spark.createDataFrame(rows, "book_id string, id string, place int, text string")
    got = lambda **how: {r.id: (r.age_bracket, r.age_confidence) for r in casting.infer_profiles(df, **how).collect()}
    assert got() == {"m": ("unknown", 0.0), "n": ("unknown", 0.0)}
    assert got(ascii=True) == {"m": ("young_adult", 0.5), "n": ("elderly", 1.0)}


def test_pronouns_are_counted_once(spark):
    df = spark.createDataFrame([("ſhe and HER, he",), (None,)], "x string")
    g, sure = casting.infer_gender(F.col("x"))
    out = df.select(g.alias("g"), sure.alias("s"))
    assert [tuple(r) for r in out.collect()] == [("female", 0.6667), (None, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2


def test_adjacency_among_some_speakers(spark):
    draw = random.Random(9)
    s = spark.createDataFrame([(draw.randrange(2), i, f"c{draw.randrange(9)}") for i in range(200)], "book_id int, ord int, speaker_id string")
    among = spark.createDataFrame([(b, f"c{i}", i < 2) for b in (0, 1) for i in range(5)], "book_id int, name string, main boolean")
    keep = {f"c{i}" for i in range(5)}
    want = [tuple(r) for r in casting.adjacency(s, 4).collect() if {r.a, r.b} <= keep and {r.a, r.b} & {"c0", "c1"}]
    assert sorted(map(tuple, casting.adjacency(s, 4, among).collect())) == sorted(want)


def test_frames_are_measured_in_lots(spark):
    n = 2 * audio.AT_ONCE + 3
    pcm = (8000 * np.sin(2 * np.pi * np.arange(audio.FRAME) / 25)).astype("<i2").tobytes()
    cut = spark.range(n, numPartitions=1).select("id", F.lit(8000).alias("rate"), F.lit(0).alias("frame"), F.lit(pcm).alias("pcm"))
    got = audio.frame_measures(cut, "id").collect()
    assert sorted(r.id for r in got) == list(range(n)) and {r.f0_hz for r in got} == {320.0}
