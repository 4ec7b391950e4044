"""Cleaning, speech forms, segmentation."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import speech, text
from quillspark.operators import segment
from quillspark.plans import queries


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_cleaning(spark):
    headers = "THE GREAT NOVEL\na\nTHE GREAT NOVEL\nb\n THE GREAT NOVEL \nc\n\n\n\n"
    assert one(spark, text.remove_running_headers, headers, "a\nb\nc\nd", "", None) == ["a\nb\nc\n\n\n\n", "a\nb\nc\nd", "", None]
    assert one(spark, text.clean, "“Hello” ‘world’!\nThis is hyphen-\nated.  Wi­de\n\n\n\nend ") == ["\"Hello\" 'world'!\nThis is hyphenated. Wide\n\nend"]
    assert one(spark, lambda c: text.clean(c, is_pdf=True), "Chapter text.\n7\nMore text.", "été ") == ["Chapter text.\n\nMore text.", "été"]
    twice = one(spark, lambda c: text.clean(text.clean(c)), "Hello  world. “She said.”\n\n\n\n-\nx")
    assert twice == one(spark, text.clean, "Hello  world. “She said.”\n\n\n\n-\nx")
    assert one(spark, text.detect_dialogue, '"Hello," she said.', "— He answered.", "He walked across the room.", f'"{"x" * 501}"') == [True, True, False, False]
    assert one(spark, text.py_strip, "  \n a b  ") == ["a b"]


def test_scalars(spark):
    assert one(spark, text.detect_quote_style, "'a' 'b' \"c\"", "\"a\" 'b'", "it's") == ["single", "double", "double"]
    assert one(spark, text.word_count, " a b  c\n", "", "x") == [3, 0, 1]
    assert one(spark, text.llm_confidence, "HIGH", "medium", "low", "0.3", "?", None) == [0.95, 0.7, 0.4, 0.3, 0.4, 0.4]
    assert one(spark, text.character_slug, "Dr. Who Jr.") == ["dr_who_jr"]
    marked = one(spark, lambda c: text.mark_quotes(c, F.array(F.lit('"a.*"'), F.lit('"b"'), F.lit('"a.*"'), F.lit("gone"))), '"a.*" and "b" and "a.*"', "none")
    assert marked == ["[Q1] and [Q2] and [Q3]", "none"]
    good = '{"attributions":[{"quote_id":"Q1","speaker_id":"Mira","confidence":"high"}]}'
    assert [r and [tuple(x) for x in r] for r in one(spark, text.llm_quotes, good, '{"attributions":[{}]}', "no json", "{}")] == [[("Q1", "Mira", 0.95)], None, None, None]
    assert one(spark, text.llm_spans, '{"spans":[{"text":"a","speaker":"b","kind":"odd"}]}') == [None]


def test_speech(spark):
    cases = {"Wait...": "Wait,", "yes—no": "yes - no", "WAIT": "Wait", "NASA": "NASA", "Hello*World": "HelloWorld", "Test_123": "Test123", "": None, "***": None, "  ": None}
    assert dict(zip(cases, one(spark, speech.normalise_for_synthesis, *cases))) == cases
    assert one(spark, lambda c: speech.normalise_for_synthesis(c, numbers=True, exact=False, years=True), "Mr. Smith met 21 in 1999, 1900 and 2024") == ["Mister Smith met twenty-one in nineteen ninety-nine, nineteen hundred and two thousand twenty-four"]
    spelt = {
        "0": "zero", "000": "zero", "7": "seven", "0019": "nineteen", "80": "eighty", "101": "one hundred and one", "1000": "one thousand", "1999": "one thousand, nine hundred and ninety-nine", "2001": "two thousand and one",
        "1000001": "one million and one", "123456": "one hundred and twenty-three thousand, four hundred and fifty-six", "1000000": "one million", "5000000100": "five billion, one hundred", "1" + "0" * 18: "1" + "0" * 18, "٢٣": "twenty-three",
        "a1 1a _2 2_ 3,4.5-6": "a1 1a _2 2_ three,four.five-six", "x\n12\ty": "x\ntwelve\ty", "": "", "ABCD NASA ÄBCD ABCD1": "Abcd NASA ÄBCD ABCD1",
    }
    assert dict(zip(spelt, one(spark, speech.speak, *spelt))) == spelt
    assert one(spark, lambda c: speech.speak(c, years=True), "1099 1100 1905 1999 2000 2010 2100 01999") == ["one thousand and ninety-nine eleven hundred nineteen five nineteen ninety-nine two thousand two thousand ten two thousand, one hundred one thousand, nine hundred and ninety-nine"]
    assert one(spark, lambda c: speech.normalise_for_synthesis(c, numbers=True), "In 1999") == ["In one thousand, nine hundred and ninety-nine"]


def test_normalise_speech_reads_whole_texts(spark, tmp_path):
    texts = {21: "NASA met Dr.Who in 1999. " * 500 + "The END of it... 12 *miles* on", 7: "short", 1900: "é" * 60 + "x — y", 3: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    small = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()

    def spell(n):
        if n < 100:
            return small[n] if n < 20 else tens[n // 10 - 2] + (f"-{small[n % 10]}" if n % 10 else "")
        if n < 1000:
            return f"{small[n // 100]} hundred" + (f" and {spell(n % 100)}" if n % 100 else "")
        size, name = next((10**k, x) for k, x in ((12, "trillion"), (9, "billion"), (6, "million"), (3, "thousand")) if n >= 10**k)
        rest = n % size
        return f"{spell(n // size)} {name}" + ("" if not rest else f" and {spell(rest)}" if rest < 100 else f", {spell(rest)}")

    def plain(i, x):
        x = f"{x[:60].replace('ß', 'ss').upper()}... Mr.Vane had {i} — in {1100 + i * 7 % 1000}, of {i * i * 1000003} and 0{i % 300 * 1000000}, NASA{x[60:]}"
        x = re.sub("[—–]", " - ", re.sub(r"\.{3,}", ", ", x)).replace("Mr.V", "MisterV").replace("Dr.W", "DoctorW")
        x = re.sub(r"\b\d+\b", lambda m: spell(int(m[0])), x)
        x = re.sub(r"\b[A-Z]{4,}\b", lambda m: m[0] if m[0] in speech.ACRONYMS else m[0].title(), x)
        return " ".join(re.sub("[*_#~]", "", x).split())

    got = {r.doc_id: r.text for r in queries.QUERIES["normalise_speech"](spark, str(tmp_path)).collect()}
    assert got == {i: plain(i, x) for i, x in texts.items()} and got[21].endswith("END of it, twelve miles on")


SPANS = {
    '"Hello," said Harry.': ([("dialogue", '"Hello,"'), ("narration", " said Harry.")], False),
    '"I didn\'t do it," and Ron said, "Me neither."': ([("dialogue", '"I didn\'t do it,"'), ("narration", " and Ron said, "), ("dialogue", '"Me neither."')], False),
    '"First paragraph of a long speech': ([("dialogue", '"First paragraph of a long speech')], True),
    "No quotes here.": ([("narration", "No quotes here.")], False),
    "": ([], False),
}


def test_quote_spans(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(SPANS)], "k int, text string")
    got = segment.quote_spans(df, "k").orderBy("k", "i").collect()
    for k, (x, (spans, inside)) in enumerate(SPANS.items()):
        own = [r for r in got if r.k == k]
        assert [(r.kind, r.text) for r in own] == spans and all(r.ends_inside == inside for r in own)
        assert "".join(r.text for r in own) == x


def test_quotes_with_ids(spark):
    df = spark.createDataFrame([(1, 'He said “Hello,” and "Hi there," Bob replied. "open')], "k int, text string")
    got = segment.quotes(df, "k").orderBy("start_char").collect()
    assert [(r.quote_id, r.text, r.start_char) for r in got] == [("Q1", "Hello,", 8), ("Q2", "Hi there,", 21)]


def test_segments_and_carried_quotes(spark):
    p = [(0, 0, '"You lied," she said, "and you know it."'), (0, 1, "She hesitated. “Can I come"), (0, 2, '"in now?" he said'), (0, 3, "   "), (1, 0, '"New chapter"')]
    df = spark.createDataFrame([("b", c, i, x) for c, i, x in p], "book_id string, chapter_idx int, para_idx int, text string")
    got = segment.segment_paragraphs(df).orderBy("chapter", "para_idx", "seg_idx").collect()
    assert [(r.id, r.kind, r.text, r.speaker_id) for r in got[:3]] == [("c00-p000-s00", "dialogue", '"You lied,"', "unknown"), ("c00-p000-s01", "narration", "she said,", "narrator"), ("c00-p000-s02", "dialogue", '"and you know it."', "unknown")]
    assert [r.id for r in got if r.continues_previous] == ["c00-p002-s00"]


def test_chunks(spark):
    long = "A" * 50 + ". " + "B" * 50 + "."
    assert [len(x) for x in one(spark, lambda c: segment.chunked(c, 60), long)[0]] == [51, 51]
    assert [len(x) for x in one(spark, lambda c: segment.chunked(c, 100), "A" * 300)[0]] == [100, 100, 100]
    assert one(spark, lambda c: segment.chunked(c, 100), "", "One. Two! Three? Four") == [[], ["One. Two! Three? Four"]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ,;()—.", max_size=300), st.integers(5, 60))
def test_cut_long_keeps_the_limit_and_the_letters(x, most):
    x = x.strip()
    parts = segment.cut_long(x, most)
    assert all(len(p) <= most for p in parts)
    assert "".join("".join(parts).split()) == "".join(x.split())


def test_narrator_segments(spark):
    df = spark.createDataFrame([("b", 0, 0, "Short one. " + "word " * 30 + "end. Last.")], "book_id string, chapter_idx int, para_idx int, text string")
    got = segment.narrator_segments(df, 60).orderBy("seg_idx", "chunk_idx").collect()
    assert got[0].id == "c00-p000-s00" and got[-1].id == "c00-p000-s02" and [r.id[-4:] for r in got[1:-1]] == [f"s01{c}" for c in "abcdefgh"[: len(got) - 2]] and len(got) > 4


@pytest.mark.parametrize("path", ["quillspark.plans.queries"])
def test_queries_import_without_a_session(path):
    import subprocess
    import sys

    assert subprocess.run([sys.executable, "-c", f"import {path}, __spark_entry__ as e; assert len(e.queries()) > 50"], timeout=120).returncode == 0


def test_running_headers_against_plain(spark):
    draw = random.Random(4)
    cases = ["\n".join(draw.choice(["a", " a", "b ", "", "  ", "c", "long line", str(draw.randrange(40))]) for _ in range(draw.randrange(40))) for _ in range(60)] + ["", "x\nx\nx", "\n" * 9]

    def plain(text, least):
        lines = text.split("\n")
        n = Counter(x.strip() for x in lines)
        return "\n".join(x for x in lines if not x.strip() or n[x.strip()] < least)

    df = spark.createDataFrame(list(enumerate(cases)), "i int, x string")
    for least in (2, 3, 5):
        got = [r.y for r in df.select("i", text.remove_running_headers(F.col("x"), least).alias("y")).orderBy("i").collect()]
        assert got == [plain(x, least) for x in cases]


def test_letters_of_many_pieces(spark):
    df = spark.createDataFrame([("b", 0, 0, "word " * 400)], "book_id string, chapter_idx int, para_idx int, text string")
    got = [r.id for r in segment.narrator_segments(df, 6).orderBy("chunk_idx").collect()]
    assert got == [f"c00-p000-s00{chr(97 + i)}" for i in range(400)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spoken_forms_are_computed_once(spark):
    df = spark.createDataFrame([("b", 0, 0, "x")], "book_id string, chapter_idx int, para_idx int, text string")
    assert _plan(df.select(speech.normalise_for_synthesis(F.col("text")).alias("y"))).count("Mister") == 1


def test_spoken_segments_are_computed_once(spark):
    df = spark.createDataFrame([("b", 0, 0, "x")], "book_id string, chapter_idx int, para_idx int, text string")
    assert _plan(segment.narrator_segments(df, 60, speak=True)).count("Mister") == 1


def test_spoken_runs_and_blanks(spark):
    cases = {"  a \n b  c ": "a b c", "AB1CD WXYZ": "AB1CD Wxyz", "QRST": "Qrst", "QRST, NASA_X 12": "Qrst, NASAX twelve", "9": "nine", "xMr.A Mr.A": "xMr.A MisterA", "\t": None}
    assert dict(zip(cases, one(spark, lambda c: speech.normalise_for_synthesis(c, numbers=True), *cases))) == cases


def test_normal_form_holds_few_texts_at_once():
    import tracemalloc

    import pyarrow as pa

    x = pa.array(["é" * 20_000, None] * 700)
    tracemalloc.start()
    got = text.nfc.func(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.type == x.type and got.to_pylist()[:2] == ["é" * 20_000, None] and len(got) == 1400
    assert most < 10e6  # all texts at once would be 28 MB and their results as much again
