"""Lines and paragraphs to chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import preview, py_strip, word_count
from ..schema import chapter_id, paragraph_id

# fixed values: what a heading looks like
CHAPTER_LINE = (
    r"(?i)^\s*(chapter\s+(\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|[a-z\-]+)\b.*"
    r"|prologue\b.*|epilogue\b.*|part\s+\d+\b.*)\s*$"
)
CAPS_LINE = r"^[A-Z][A-Z\s\d\-:']{3,59}$"
PDF_CHAPTER_LINE = r"(?i)^\s*(chapter\s+\d+|chapter\s+[ivxlcdm]+\.?|prologue|epilogue|part\s+\d+)\b"
PDF_CAPS_LINE = r"^[A-Z\s\d\-]{4,60}$"
SURE = 0.85


def split_paragraphs(df: DataFrame, *keys: str, text: str = "text", generic: bool = False) -> DataFrame:
    """Rows (keys, para_idx, text): blocks between blank lines; para_idx counts all blocks, so blank ones leave gaps."""
    parts = F.split(F.col(text), "\n{2,}" if generic else "\n\n")
    return df.select(*keys, F.posexplode(parts).alias("para_idx", "text")).withColumn("text", py_strip(F.col("text"))).where("text <> ''")


def group_lines(lines: DataFrame, *keys: str, order: str = "line_no", text: str = "text") -> DataFrame:
    """Rows (keys, para_idx, text): runs of lines that aren't blank, joined by blanks."""
    blank = py_strip(F.col(text)) == ""
    run = F.sum(F.when(blank, 1).otherwise(0)).over(W.partitionBy(*keys).orderBy(order))
    parts = lines.select(*keys, order, F.col(text), blank.alias("blank"), run.alias("run")).where(~F.col("blank"))
    joined = parts.groupBy(*keys, "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("text"))
    return joined.withColumn("para_idx", F.row_number().over(W.partitionBy(*keys).orderBy("run")) - 1).select(*keys, "para_idx", "text")


def heading_confidence(text: Column, pdf: bool = False) -> Column:
    """The trust in a heading, null if the text is none. Only the first line counts."""
    first = py_strip(F.split(py_strip(text), "\n")[0])
    chapter, caps = (PDF_CHAPTER_LINE, PDF_CAPS_LINE) if pdf else (CHAPTER_LINE, CAPS_LINE)
    return F.when(first.rlike(chapter), 0.80 if pdf else 0.75).when(first.rlike(caps) & (F.length(first) <= 60), 0.60)


def by_headings(rows: DataFrame, *keys: str, order: str = "para_idx", text: str = "text", heading: Column | None = None, pdf: bool = False) -> DataFrame:
    """Rows (keys, chapter_idx, title, confidence, para_idx, text): sections that begin at headings.

    Headings go; sections without text go with their titles; the others are counted
    anew. What precedes the first heading has no title. Without any section
    of text all rows make one chapter. Two windows over a book, no self-join.
    """
    book = W.partitionBy(*keys)
    in_order = book.orderBy(order)
    found = heading_confidence(F.col(text), pdf) if heading is None else heading
    marked = rows.select(*keys, F.col(order).alias("_order"), F.col(text).alias("text"), found.alias("_sure"))
    in_order = book.orderBy("_order")
    first_line = py_strip(F.split(py_strip(F.col("text")), "\n")[0])
    marked = (
        marked.withColumn("_section", F.count("_sure").over(in_order))
        .withColumn("_title", F.last(F.when(F.col("_sure").isNotNull(), first_line), ignorenulls=True).over(in_order))
        .withColumn("_trust", F.last("_sure", ignorenulls=True).over(in_order))
        .withColumn("_body", F.count(F.when(F.col("_sure").isNull(), 1)).over(book))
    )
    body = marked.where("_sure IS NULL OR _body = 0")
    all_headings = F.col("_body") == 0
    default = 0.50 if pdf else 0.40
    numbered = body.withColumn("chapter_idx", F.when(all_headings, 0).otherwise(F.dense_rank().over(book.orderBy("_section")) - 1))
    place = F.row_number().over(W.partitionBy(*keys, "chapter_idx").orderBy("_order")) - 1
    return numbered.select(
        *keys, "chapter_idx", F.when(all_headings, "").otherwise(F.coalesce("_title", F.lit(""))).alias("title"),
        F.when(all_headings, 0.40).otherwise(F.coalesce("_trust", F.lit(default))).alias("confidence"), place.alias("para_idx"), "text",
    )


def by_styles(rows: DataFrame, *keys: str, exact: bool = True) -> DataFrame:
    """Sections of styled paragraphs (keys, order, style, text): headings 1 to 3 begin chapters.

    With `exact` a chapter has the trust of the heading that follows it, as older
    output has it; else that of its own. A first section without text goes, later ones stay.
    """
    rows = rows.where(py_strip(F.col("text")) != "")
    trust = F.when(F.col("style").rlike("(?i)^heading 1"), 0.90).when(F.col("style").rlike("(?i)^heading 2"), 0.80).when(F.col("style").rlike("(?i)^heading 3"), 0.70)
    in_order = W.partitionBy(*keys).orderBy("order")
    marked = rows.withColumn("_sure", trust).withColumn("_section", F.count("_sure").over(in_order))
    heads = marked.groupBy(*keys, "_section").agg(
        F.max(F.when(F.col("_sure").isNotNull(), py_strip(F.col("text")))).alias("title"), F.max("_sure").alias("_own"), F.count(F.when(F.col("_sure").isNull(), 1)).alias("_n")
    )
    sections = W.partitionBy(*keys).orderBy("_section")
    following = F.lead("_own").over(sections)
    own = F.coalesce("_own", F.lit(0.40))
    heads = heads.where("_section > 0 OR _n > 0").withColumn("confidence", F.coalesce(following, own) if exact else own).withColumn("chapter_idx", F.row_number().over(sections) - 1)
    body = marked.where("_sure IS NULL").withColumn("para_idx", F.row_number().over(W.partitionBy(*keys, "_section").orderBy("order")) - 1)
    return heads.join(body.select(*keys, "_section", "para_idx", "text"), [*keys, "_section"], "left").select(*keys, "chapter_idx", F.coalesce("title", F.lit("")).alias("title"), "confidence", "para_idx", "text")


def by_override(paragraphs: DataFrame, override: DataFrame, *keys: str) -> DataFrame:
    """Chapters as a user set them: `override` has keys, index, title, start_paragraph_id; `paragraphs` keys, id, flat_idx, text.

    An unknown start is the beginning; a chapter ends where the next one begins, an
    unknown end being the end of the book. Each book is joined by its key, so the
    range condition is only checked within it.
    """
    places = paragraphs.select(*keys, F.col("id").alias("start_paragraph_id"), F.col("flat_idx").alias("start"))
    sizes = paragraphs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    known = override.join(places, [*keys, "start_paragraph_id"], "left").join(sizes, [*keys], "left")
    in_order = W.partitionBy(*keys).orderBy("index")
    known = known.withColumn("chapter_idx", F.row_number().over(in_order) - 1).withColumn(
        "end", F.when(F.lead("index").over(in_order).isNull(), F.col("n")).otherwise(F.coalesce(F.lead("start").over(in_order), F.col("n")))
    )
    known = known.select(*keys, "chapter_idx", "title", F.coalesce("start", F.lit(0)).alias("start"), "end")
    joined = paragraphs.join(known, [*keys]).where("flat_idx >= start AND flat_idx < end")
    place = F.col("flat_idx") - F.col("start")
    return joined.select(*keys, "chapter_idx", "title", F.lit(1.0).alias("confidence"), place.cast("int").alias("para_idx"), "text")


def detect_chapters(paragraphs: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """Chapters of books (book_id, chapter_idx, title, confidence, para_idx, text).

    A book with an override follows it. One whose chapters are all sure stays as it
    is. One with a single unsure chapter is split by headings.
    """
    book = W.partitionBy("book_id")
    facts = paragraphs.withColumn("_least", F.min("confidence").over(book)).withColumn("_chapters", F.size(F.collect_set("chapter_idx").over(book)))
    weak = (F.col("_chapters") == 1) & (F.col("_least") < SURE)
    columns = ["book_id", "chapter_idx", "title", "confidence", "para_idx", "text"]
    rest = facts
    out = None
    if override is not None:
        flat = facts.withColumn("flat_idx", F.row_number().over(book.orderBy("chapter_idx", "para_idx")) - 1)
        flat = flat.withColumn("id", paragraph_id(F.col("chapter_idx"), F.col("para_idx")))
        out = by_override(flat.select("book_id", "id", "flat_idx", "text"), override, "book_id").select(columns)
        rest = rest.join(override.select("book_id").distinct(), "book_id", "left_anti")
    split = by_headings(rest.where(weak), "book_id").select(columns)
    kept = rest.where(~weak).select(columns)
    both = kept.unionByName(split)
    return (both if out is None else both.unionByName(out)).withColumn("id", paragraph_id(F.col("chapter_idx"), F.col("para_idx"))).withColumn("chapter_id", chapter_id(F.col("chapter_idx")))


def pdf_text(pages: DataFrame, least: int = 50) -> DataFrame:
    """Rows (book_id, n_pages, n_text_pages, text, error) from page texts (book_id, page_no, text): pages with too little text are scans and left out."""
    has = F.length(py_strip(F.coalesce("text", F.lit("")))) >= least
    out = pages.groupBy("book_id").agg(
        F.count("page_no").alias("n_pages"), F.count(F.when(has, 1)).alias("n_text_pages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(has, F.struct("page_no", "text")))), lambda p: p["text"]), "\n\n").alias("text"),
    )
    return out.withColumn("error", F.when(F.col("n_pages") == 0, "empty").when(F.col("n_text_pages") == 0, "scanned"))


def book_stats(paragraphs: DataFrame) -> DataFrame:
    """Rows (book_id, chapter_count, paragraph_count, word_count)."""
    return paragraphs.groupBy("book_id").agg(F.countDistinct("chapter_idx").alias("chapter_count"), F.count(F.lit(1)).alias("paragraph_count"), F.sum(word_count(F.col("text"))).cast("long").alias("word_count"))


def chapter_report(paragraphs: DataFrame, first: int = 2, chars: int = 120) -> DataFrame:
    """A line per chapter with the beginnings of its first paragraphs: book_id, chapter_idx, line."""
    n = F.row_number().over(W.partitionBy("book_id", "chapter_idx").orderBy("para_idx"))
    top = paragraphs.withColumn("_n", n).where(F.col("_n") <= first)
    shown = F.concat(preview(F.col("text"), chars), F.when(F.length("text") > chars, "…").otherwise(""))
    grouped = top.groupBy("book_id", "chapter_idx", "title", "confidence").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", shown.alias("shown")))), lambda x: x["shown"]), "\n  ").alias("body"))
    return grouped.select("book_id", "chapter_idx", F.format_string("%02d %s (%.2f)\n  %s", F.col("chapter_idx") + 1, "title", "confidence", "body").alias("line"))
