"""Files and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.config import Settings, read_settings
from quillspark.sources import book_format, books, markup
from quillspark.sources.book_files import write_book_files
from quillspark.sources.book_format import BookReader, read_raw, text_rows
from quillspark.storage import Output
from quillspark.streaming import resume


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style=None: f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/document.xml", f'<w:document {w}><w:body>{p("The Beginning", "H1")}{p("Mira set the lamp down.")}{p("")}{p("The Middle", "H1")}{p("“You lied,” she said.")}</w:body></w:document>')
    return out.getvalue()


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        item = lambda i, n, extra="": f'<item id="{i}" href="{n}" media-type="application/xhtml+xml"{extra}/>'
        z.writestr("OPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title></metadata><manifest>{item("n", "nav.xhtml", " properties=%snav%s" % (chr(34), chr(34)))}{item("b", "two.xhtml")}{item("a", "one.xhtml")}</manifest><spine><itemref idref="n"/><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OPS/nav.xhtml", "<p>skip</p>")
        z.writestr("OPS/one.xhtml", "<html><body><h1>The <i>Beginning</i></h1><p>First &amp; one.</p><p> </p><p>Second.</p></body></html>")
        z.writestr("OPS/two.xhtml", "<html><body><h2>End</h2><div>By morning.</div><div>Mira left.</div></body></html>")
    return out.getvalue()


def test_books_of_three_formats(spark, tmp_path):
    (tmp_path / "plain book.txt").write_bytes(b'Chapter 1: The Start\r\n\r\n\r\n\r\n"You lied," she said.\r\n\r\nbad \xff byte')
    (tmp_path / "b.docx").write_bytes(docx())
    (tmp_path / "c.epub").write_bytes(epub())
    rows = books.read_books(spark, str(tmp_path)).orderBy("confidence", "chapter_idx", "para_idx").collect()
    txt = [r for r in rows if r.confidence == 0.0]
    assert [(r.id, r.text, r.is_dialogue) for r in txt] == [("c00-p000", "Chapter 1: The Start", False), ("c00-p001", '"You lied," she said.', True), ("c00-p002", "bad � byte", False)]
    assert txt[0].title == "plain book"
    assert [(r.chapter_idx, r.title, r.text) for r in rows if r.confidence == 0.9] == [(0, "The Beginning", "Mira set the lamp down."), (1, "The Middle", '"You lied," she said.')]
    assert [(r.chapter_idx, r.title, r.text) for r in rows if r.confidence == 0.95] == [(0, "The Beginning", "First & one."), (0, "The Beginning", "Second."), (1, "End", "By morning."), (1, "End", "Mira left.")]
    exact = books.read_books(spark, str(tmp_path), exact=True).where("confidence = 0.95").orderBy("chapter_idx", "para_idx").collect()
    assert [(r.title, r.id, r.text) for r in exact] == [("End", "c00-p000", "By morning.\nMira left."), ("TheBeginning", "c01-p000", "First & one."), ("TheBeginning", "c01-p002", "Second.")]


def test_files_that_are_no_books(spark, tmp_path):
    (tmp_path / "d.ODT").write_bytes(b"x")
    with pytest.raises(Exception, match=r"no reader for \.odt .*known formats: \.docx, \.epub, \.txt"):
        read_raw(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no file or folder"):
        read_raw(spark, str(tmp_path / "none")).collect()
    assert read_raw(spark, str(tmp_path), pathGlobFilter="*.txt").count() == 0
    for name in ("a.docx", "b.epub"):
        (tmp_path / name).write_bytes(b"no archive")
        with pytest.raises(Exception, match=f"{name} can't be read"):
            read_raw(spark, str(tmp_path / name)).collect()


def test_files_are_grouped_by_size_and_read_as_streams(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"{i:02d}.TXT").write_text(f"x{i}\n\n" * 10_000)
    (tmp_path / "_SUCCESS").write_text("")
    raw = read_raw(spark, str(tmp_path), groupBytes=500_000)
    parts = BookReader({"path": str(tmp_path), "groupbytes": "500000"}).partitions()
    assert len(parts) == raw.rdd.getNumPartitions() == 10 and sum(len(p.paths) for p in parts) == 40
    assert raw.groupBy("title").agg(F.count("*").alias("n"), F.max("place").alias("m")).where("n = 10000 AND m = 9999").count() == 40
    text = "a\r\n\r\nb\n\n\n\nc\n\n\nd\re\n"
    want = [r[6] for r in text_rows(io.BytesIO(text.encode()), "t")]
    assert want == ["a", "b", "c", "d\ne"] == [b.strip() for b in text.replace("\r\n", "\n").replace("\r", "\n").split("\n\n") if b.strip()]
    for size in (1, 2, 3, 5):
        monkeypatch.setattr(book_format, "TEXT_CHARS", size)
        assert [r[6] for r in text_rows(io.BytesIO(text.encode()), "t")] == want


def test_books_written_by_tasks_come_back(spark, tmp_path):
    texts = ["First & <one>.", "tab\there", "\x0bcontrol", "“quoted”"]
    rows = [(f"b{i % 3}", kind, "T & U", c, f"Chapter {c}", p, f"{t} {i}") for i in range(6) for kind in ("txt", "docx", "epub") for c in (0, 2) for p, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "name string, format string, book_title string, chapter_idx int, title string, para_idx int, text string")
    assert write_book_files(df, str(tmp_path / "out")).count() == 9
    assert not list(tmp_path.rglob("*.part"))
    raw = read_raw(spark, str(tmp_path / "out"))
    want = {t.replace("\x0b", "") if kind != "txt" else t.strip() for kind in ("docx", "txt") for *_, t in rows}
    assert {r.text for r in raw.where("style = '' AND format <> 'epub'").collect()} == want
    assert {r.title for r in raw.where("format <> 'txt'").collect()} == {"T & U"}
    books_ = books.read_books(spark, str(tmp_path / "out"))
    assert books_.count() == len(rows) and {r.chapter_idx for r in books_.select("chapter_idx").collect()} == {0, 1}


def test_output_of_a_failed_task_is_deleted(tmp_path):
    with pytest.raises(RuntimeError), Output(str(tmp_path / "x")) as out:
        out.write(b"half")
        raise RuntimeError
    with Output(str(tmp_path / "y")) as out:
        assert out.write(b"a") == 0 and out.write(b"b") == 1
    assert [p.name for p in tmp_path.iterdir()] == ["y"]


def test_pdf_pages(spark):
    pages = spark.createDataFrame([("b", 1, "CHAPTER 1: START\nA line of the first paragraph that is long\nand goes on.\n\nSecond one.\n12"), ("b", 2, "CHAPTER 2\nAnother chapter with enough text to be a page of text.")], "book_id string, page_no int, text string")
    got = books.pdf_paragraphs(pages).orderBy("chapter_idx", "para_idx").collect()
    assert [(r.chapter_idx, r.title, r.confidence, r.text) for r in got] == [
        (0, "CHAPTER 1: START", 0.8, "A line of the first paragraph that is long and goes on."), (0, "CHAPTER 1: START", 0.8, "Second one."), (1, "CHAPTER 2", 0.8, "Another chapter with enough text to be a page of text."),
    ]


def test_nested_books_and_back(spark, tmp_path):
    p = spark.createDataFrame([("b", c, "T", 1.0, i, f"c0{c}-p00{i}", f"x{c}{i}", "o", False) for c in (1, 0) for i in (1, 0)], "book_id string, chapter_idx int, title string, confidence double, para_idx int, id string, text string, original_text string, is_dialogue boolean")
    books.write_books(books.to_books(p), str(tmp_path / "out"))
    books.write_books(books.to_books(p.limit(0)), str(tmp_path / "out"))  # stays as it is
    again = books.book_paragraphs(spark.read.schema(schema.BOOK).json(str(tmp_path / "out")))
    assert sorted(map(tuple, again.select(p.columns).collect())) == sorted(map(tuple, p.collect()))


def test_side_files(spark, tmp_path):
    (tmp_path / "override.json").write_text(json.dumps([{"index": 0, "title": "A", "start_paragraph_id": "c00-p000"}]))
    (tmp_path / "bad.json").write_text('{"index": 0}')
    assert [tuple(r) for r in books.read_override(spark, str(tmp_path / "override.json")).collect()] == [(0, "A", "c00-p000")]
    assert books.read_override(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "voices.json").write_text(json.dumps([{"id": "n", "engine": "fake", "narrator_reserved": True}, {"id": "v", "engine": "fake", "gender": "female"}]))
    assert [(r.pos, r.id, r.gender) for r in books.read_voices(spark, str(tmp_path / "voices.json")).collect()] == [(0, "n", None), (1, "v", "female")]
    assert books.read_voices(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "seed.json").write_text(json.dumps({"characters": [{"name": "Mira", "aliases": ["M"]}, {"name": ""}]}))
    assert [tuple(r) for r in books.read_seeds(spark, str(tmp_path / "seed.json")).collect()] == [("Mira", ["M"])]
    (tmp_path / "gold.json").write_text(json.dumps({"source_hash": "h", "quotes": [{"quote_id": "Q1", "speaker": "a"}]}))
    assert books.read_gold(spark, str(tmp_path / "gold.json")).first().quote_id == "Q1"
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.jsonl").write_text(json.dumps({"run_id": "r1", "style_breakdown": {"tagged": 0.5}}, indent=2))
    (tmp_path / "runs" / "b.jsonl").write_text("broken")
    assert [(r.run_id, r.style_breakdown) for r in books.read_runs(spark, str(tmp_path / "runs"), schema.RUNS).collect()] == [("r1", {"tagged": 0.5})]


def test_html(spark):
    pages = spark.createDataFrame([(1, "<h1>T &amp; x</h1><p>One\n two</p><p><b>Three</b></p>"), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in markup.html_paragraphs(pages, "page_id").collect()] == [(1, "T & x", 0, "One two"), (1, "T & x", 1, "Three")]
    assert [r.text for r in markup.simple_paragraphs(pages, "page_id").collect()] == ["One two", "Three"]


def test_streamed_paragraphs_restart(spark, tmp_path):
    schema_ = "book_id string, chapter_idx int, para_idx int, text string"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("b", 0, 0, '"Hi," he said.')], schema_).write.parquet(source)
    resume.stream_segments(spark, source, target, str(tmp_path / "state")).awaitTermination()
    spark.createDataFrame([("b", 0, 1, "More."), ("b", 0, 0, '"Ho," he said.')], schema_).write.mode("append").parquet(source)
    resume.stream_segments(spark, source, target, str(tmp_path / "state")).awaitTermination()
    got = resume.table(spark, target)
    assert sorted(r.text for r in got.collect()) == ['"Ho,"', "More.", "he said."]
    again = resume.upsert_batches(target)
    again(spark.createDataFrame([("b", 0, 1, "More.")], schema_), 1)  # a batch that runs twice has no other effect
    assert sorted(r.text for r in resume.table(spark, target).collect()) == ['"Hi,"', "More.", "he said."]
    assert resume.to_do(spark.createDataFrame([("b", 0, 1, ""), ("b", 0, 7, "")], schema_), resume.table(spark, target)).select(F.max("para_idx")).first()[0] == 7


def test_a_batch_writes_its_own_buckets_only(spark, tmp_path):
    path = str(tmp_path / "table")
    segment = lambda b, i, text, source="rule": (str(b), f"s{i:02d}", i // 10, text, source)
    kinds = "book_id string, id string, chapter int, text string, source string"
    files = lambda: {p.relative_to(path): p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    first = [segment(b, i, "old", "user" if i == 3 else "rule") for b in range(20) for i in range(30)]
    assert len(resume.upsert(path, spark.createDataFrame(first, kinds), 0, buckets=8)) == 8
    before = files()
    second = [segment(4, i, "new") for i in (2, 3, 99)] + [segment(4, 2, "newer")]
    touched = resume.upsert(path, spark.createDataFrame(second, kinds), 1)
    assert len(touched) == 1
    kept = {name: at for name, at in files().items() if name in before}
    assert kept == before and {name.parts[1] for name in files() if name not in before} == {f"bucket={touched[0]}"}
    got = {(r.book_id, r.id): r for r in resume.table(spark, path).collect()}
    assert len(got) == 601 and {k: got["4", f"s{k:02d}"].text for k in (2, 3, 4, 99)} == {2: "newer", 3: "old", 4: "old", 99: "new"}
    assert got["4", "s99"].status == "pending"
    resume.upsert(path, spark.createDataFrame(second, kinds), 1)  # again, with no other effect
    assert {(r.book_id, r.id): r for r in resume.table(spark, path).collect()} == got
    assert resume.table(spark, path, below=1).count() == 600
    resume.upsert(path, spark.createDataFrame([], kinds), 2)
    resume.upsert(path, spark.createDataFrame([segment(4, 1, "last")], kinds), 3)
    # the versions before the last two are gone, and so is what only they named
    assert resume.versions(path) == [2, 3] and not any(name.parts == ("v=0", f"bucket={touched[0]}") for name in (n.parent for n in files()))
    assert resume.table(spark, path).count() == 601


def test_scans_read_one_bucket_and_old_files(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(str(b), f"s{i:03d}", i // 100, "done" if i % 2 else "failed") for b in range(12) for i in range(300)]
    resume.upsert(path, spark.createDataFrame(rows, "book_id string, id string, chapter int, status string"), 0, buckets=4)
    own = resume.scan(spark, path, "7", chapter=1, status=["failed"])
    assert [(r.book_id, r.id) for r in own.collect()] == [("7", f"s{i:03d}") for i in range(100, 200, 2)]
    assert len({f.split("/")[-2] for f in own.inputFiles()}) == 1
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(book_id,7)" in plan and "EqualTo(chapter,1)" in plan
    assert [r.id for r in resume.scan(spark, path, "7", ids=["s005", "none"]).collect()] == ["s005"]
    # a file from before statuses and retries were stored
    folder = resume.manifest(path)["folders"]
    spark.createDataFrame([("old", "s0", 1)], "book_id string, id string, chapter int").write.mode("append").parquet(f"{path}/{next(iter(folder.values()))}")
    assert [(r.id, r.status, r.retry_count) for r in resume.scan(spark, path, ids=["s0"]).collect()] == [("s0", "pending", 0)]
    assert resume.scan(spark, str(tmp_path / "none"), "7").count() == 0


def test_settings_have_defaults_and_layers(spark, tmp_path):
    assert read_settings() == read_settings(str(tmp_path / "none.toml")) == Settings()
    path = tmp_path / "settings.toml"
    path.write_text('review_threshold = 0.9\nmodel_retries = "many"\n[narrator]\nother = "v7"\n[pauses]\nsentence = 250\n')
    got = read_settings(str(path))
    assert got == Settings(review_threshold=0.9, narrator={"fake": "narrator", "other": "v7"}, pauses={"sentence": 250})
    spark.conf.set("quillspark.review_threshold", "0.5")
    spark.conf.set("quillspark.narrator.fake", "v1")
    try:
        got = read_settings(str(path), spark)
        assert got.review_threshold == 0.5 and got.narrator == {"fake": "v1", "other": "v7"}
    finally:
        spark.conf.unset("quillspark.review_threshold")
        spark.conf.unset("quillspark.narrator.fake")
    path.write_text("not = [toml")
    assert read_settings(str(path)) == Settings()


def test_many_runs_are_lines_of_few_files(spark, tmp_path):
    runs = spark.range(50, numPartitions=2).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("run_id"))
    for _ in range(2):
        books.write_runs(runs, str(tmp_path / "runs"), lines=True)
    assert len(list((tmp_path / "runs").glob("*.json"))) == 4
    assert books.read_runs(spark, str(tmp_path / "runs"), schema.RUNS, lines=True).count() == 100


def test_pages_are_passed_on_in_slices(spark):
    n = 3 * markup.SLICE + 1
    rows = spark.range(n, numPartitions=1).select("id", F.concat(F.lit("<h1>T</h1><p>a"), F.col("id").cast("string"), F.lit("</p><p> </p><p>b</p>")).alias("html"))
    got = markup.html_paragraphs(rows, "id").orderBy("id", "para_idx").collect()
    assert [(r.id, r.title, r.text) for r in got] == [(i, "T", x) for i in range(n) for x in (f"a{i}", "b")]
