"""Reading and writing books, casts, labels and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean, detect_dialogue, remove_page_numbers, remove_running_headers
from ..operators.structure import by_headings, by_styles, heading_confidence, pdf_text
from ..schema import BOOK, VOICES, ensure_columns, paragraph_id
from .book_format import read_raw

def finished(rows: DataFrame) -> DataFrame:
    """Paragraph rows with ids, the text before cleaning, and the mark of dialogue."""
    return rows.withColumn("id", paragraph_id(F.col("chapter_idx"), F.col("para_idx"))).withColumn("is_dialogue", detect_dialogue(F.col("text")))


def _once(c: Column) -> Column:
    """A column that later steps see as a value: Spark can't take a Python function out of an expression over lambdas that is used twice."""
    return F.explode(F.array(c))


def txt_blocks(books: DataFrame) -> DataFrame:
    """Texts (book_id, title, content) as raw rows: blocks between blank lines, counted without those that are blank."""
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    blocks = F.filter(F.transform(F.split(text, "\n\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")), lambda x: x != "")
    return books.select("book_id", "title", F.lit("txt").alias("format"), F.posexplode(blocks).alias("place", "text"))


def txt_paragraphs(raw: DataFrame) -> DataFrame:
    """Paragraphs of text files, cleaned one by one. Ids keep the place of the block, so those that cleaning empties leave gaps."""
    rows = raw.where("format = 'txt'").select("book_id", F.lit(0).alias("chapter_idx"), "title", F.lit(0.0).alias("confidence"), F.col("place").alias("para_idx"), F.col("text").alias("original_text"))
    rows = rows.select("*", _once(remove_running_headers(F.col("original_text"))).alias("stripped"))
    # normal form C makes no text empty, so the filter stays native
    return finished(rows.where(clean(F.col("stripped"), unicode=False) != "").withColumn("text", clean(F.col("stripped"))).drop("stripped"))


def docx_paragraphs(raw: DataFrame, exact: bool = True) -> DataFrame:
    rows = raw.where("format = 'docx'").select("book_id", F.col("place").alias("order"), "style", "text")
    found = by_styles(rows, "book_id", exact=exact).where("text IS NOT NULL").withColumn("original_text", F.regexp_replace("text", r"(?U)^\s+|\s+\z", ""))
    return finished(found.withColumn("text", clean(F.col("original_text"))))


def epub_paragraphs(raw: DataFrame) -> DataFrame:
    """Paragraphs of EPUB files; documents without any aren't counted as chapters. Ids keep the place of the paragraph in its document."""
    rows = raw.where("format = 'epub'").where(clean(F.col("text"), unicode=False) != "")
    chapter = (F.dense_rank().over(W.partitionBy("book_id").orderBy("chapter")) - 1).alias("chapter_idx")
    return finished(rows.select("book_id", chapter, F.col("heading").alias("title"), F.lit(0.95).alias("confidence"), F.col("place").alias("para_idx"), F.col("text").alias("original_text"), clean(F.col("text")).alias("text")))


def pdf_paragraphs(pages: DataFrame) -> DataFrame:
    """Paragraphs from the page texts of PDF books (book_id, page_no, text), which another tool takes from the files. Scanned books have none."""
    text = pdf_text(pages).where("error IS NULL").select("book_id", _once(remove_running_headers(remove_page_numbers(F.col("text")))).alias("text"))
    text = text.select("book_id", clean(F.col("text")).alias("text"))
    lines = text.select("book_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    line = F.trim("line")
    # blank lines and headings both end a paragraph
    marked = lines.select("book_id", "line_no", line.alias("text"), heading_confidence(line, pdf=True).alias("sure"))
    order = W.partitionBy("book_id").orderBy("line_no")
    run = F.sum(F.when((F.col("text") == "") | F.col("sure").isNotNull(), 1).otherwise(0)).over(order)
    marked = marked.withColumn("run", run).where("text <> ''")
    grouped = marked.groupBy("book_id", "run", F.col("sure").isNotNull().alias("heading")).agg(F.min("line_no").alias("para_idx"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"))
    sure = F.when(F.col("heading"), heading_confidence(F.col("text"), pdf=True))
    out = by_headings(grouped.withColumn("_heading", sure), "book_id", heading=F.col("_heading"), pdf=True)
    return finished(out.withColumn("original_text", F.col("text")))


def read_books(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """Paragraphs of all text, DOCX and EPUB files under a path; files of another format are an error that names the known ones."""
    raw = lambda kind: read_raw(spark, path, exact=exact, formats=kind)
    columns = ["book_id", "chapter_idx", "title", "confidence", "para_idx", "id", "text", "original_text", "is_dialogue"]
    return txt_paragraphs(raw("txt")).select(columns).unionByName(docx_paragraphs(raw("docx")).select(columns)).unionByName(epub_paragraphs(raw("epub")).select(columns))


def read_book_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested books: a file each, or with `lines` a line each, as `write_books` writes them."""
    return spark.read.schema(BOOK).json(path, multiLine=not lines)


def book_paragraphs(books: DataFrame) -> DataFrame:
    """Nested books as paragraph rows."""
    c = books.select(F.col("id").alias("book_id"), F.explode("chapters").alias("c"))
    p = c.select("book_id", F.col("c.index").alias("chapter_idx"), F.col("c.title").alias("title"), F.col("c.confidence").alias("confidence"), F.posexplode("c.paragraphs").alias("para_idx", "p"))
    return p.select("book_id", "chapter_idx", "title", "confidence", "para_idx", "p.id", "p.text", "p.original_text", "p.is_dialogue")


def to_books(paragraphs: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Paragraph rows as nested books; `facts` has id, title, author and other columns of a book."""
    p = F.struct("para_idx", F.struct("id", "text", "original_text", "is_dialogue").alias("p"))
    chapters = paragraphs.groupBy("book_id", "chapter_idx", "title", "confidence").agg(F.transform(F.array_sort(F.collect_list(p)), lambda x: x["p"]).alias("paragraphs"))
    c = F.struct(F.format_string("c%02d", "chapter_idx").alias("id"), F.col("chapter_idx").alias("index"), "title", "confidence", "paragraphs")
    books = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_idx", c.alias("c")))).alias("x")).select(F.col("book_id").alias("id"), F.transform("x", lambda x: x["c"]).alias("chapters"))
    if facts is not None:
        books = books.join(facts, "id", "left")
    return ensure_columns(books, BOOK)


def write_books(books: DataFrame, path: str, override: bool = False) -> None:
    """A set of files with a JSON object a line; an existing one stays unless it is overridden."""
    books.write.mode("overwrite" if override else "ignore").json(path)


def read_override(spark: SparkSession, path: str) -> DataFrame:
    """Rows (index, title, start_paragraph_id) of a JSON array; anything else gives no rows."""
    raw = spark.read.text(path, wholetext=True)
    got = F.from_json("value", "array<struct<index:int,title:string,start_paragraph_id:string>>")
    return raw.where(F.trim("value").startswith("[")).select(F.inline(got)).where("start_paragraph_id IS NOT NULL")


def read_voices(spark: SparkSession, path: str) -> DataFrame:
    """The voice catalogue with each entry's place in its file; a missing file is an empty catalogue."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as error:  # the path is checked when the frame is made
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"pos INT, {VOICES}")
    fields = ", ".join(f"{a}: {b}" for a, b in (f.strip().split(" ") for f in VOICES.split(",")))
    return raw.select(F.posexplode(F.from_json("value", f"array<struct<{fields}>>")).alias("pos", "v")).select("pos", "v.*")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, aliases) of a seed file."""
    raw = spark.read.text(path, wholetext=True)
    got = F.from_json("value", "characters array<struct<name:string,aliases:array<string>>>")["characters"]
    return raw.select(F.inline(got)).where("name <> ''").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, source_hash, quote_id, speaker, text, chapter, style) of gold label files."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    got = F.from_json("value", "source_hash string, quotes array<struct<quote_id:string,speaker:string,text:string,chapter:int,style:string>>")
    return raw.select("path", got.alias("g")).select("path", "g.source_hash", F.inline("g.quotes"))


def read_runs(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Run records, one object a file or with `lines` one a line; what isn't such an object is left out."""
    raw = spark.read.text(path, wholetext=not lines)
    got = raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return got.select("r.*").where("run_id IS NOT NULL")


def write_runs(runs: DataFrame, path: str, lines: bool = False) -> None:
    """Add run records, a file each, or with `lines` a line each in as many files as there are tasks, for many runs."""
    out = runs.write.mode("append")
    (out if lines else out.option("maxRecordsPerFile", 1)).json(path)


#: A line of a cast file: the book and its characters.
CAST = (
    "book_id string, characters array<struct<id:string,name:string,display_name:string,aliases:array<string>,line_count:bigint,first_chapter:int,"
    "user_locked:boolean,voice_assignments:map<string,string>>>"
)
MERGES = "book_id string, winner_id string, loser_id string, loser_name string, loser_aliases array<string>, loser_line_count bigint, loser_user_locked boolean"


def write_casts(characters: DataFrame, path: str) -> None:
    """The casts of books as JSON, a book a line, in place of what was there. A book's cast is bounded by its speakers."""
    fields = [c for c in ("id", "name", "display_name", "aliases", "line_count", "first_chapter", "user_locked", "voice_assignments") if c in characters.columns]
    by_id = lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    casts = characters.groupBy(F.col("book_id").cast("string").alias("book_id")).agg(F.array_sort(F.collect_list(F.struct(*fields)), by_id).alias("characters"))
    casts.write.mode("overwrite").json(path)


def read_casts(spark: SparkSession, path: str) -> DataFrame:
    """Characters of all casts under a path; lines that aren't a cast give none."""
    got = spark.read.text(path).select(F.from_json("value", CAST).alias("c"))
    return got.where("c.book_id IS NOT NULL AND c.characters IS NOT NULL").select("c.book_id", F.inline("c.characters"))


def append_merges(record: DataFrame, path: str) -> None:
    """Add the merges that were made to a history."""
    record.where("error IS NULL").drop("error").write.mode("append").json(path)


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """The history of merges; lines that aren't a merge give none."""
    got = spark.read.text(path).select(F.from_json("value", MERGES).alias("m"))
    return got.select("m.*").where("winner_id IS NOT NULL AND loser_id IS NOT NULL")
