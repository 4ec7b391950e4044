"""Cleaning and normalising text: Column to Column, inside whole-stage code wherever Spark has the function."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: characters that count as quotes
SINGLE_QUOTES = "‘’‚‛‹›"
DOUBLE_QUOTES = "“”„‟«»"
# fixed values: words in names
NAME_STOP_WORDS = ["the", "a", "an", "sir", "lady", "lord"]
TITLE_TOKENS = ["mr", "mrs", "ms", "dr", "professor", "captain", "colonel"]

SOFT_HYPHEN = "­"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once. What a lambda refers to is otherwise computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def py_strip(c: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


#: Texts of a batch that are Python strings at once.
SLICE = 64


@F.arrow_udf(StringType())
def nfc(x: pa.Array) -> pa.Array:
    """Unicode normal form C, for which Spark has no function. A batch stays in Arrow's bytes; few of its texts are strings at a time."""
    done = [pa.array([None if s is None else unicodedata.normalize("NFC", s) for s in x.slice(i, SLICE).to_pylist()], x.type) for i in range(0, len(x), SLICE)]
    return pa.concat_arrays(done) if done else x


def normalize_unicode(c: Column) -> Column:
    """NFC. ASCII is already normal, so only other texts go to Python."""
    return F.coalesce(nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def remove_soft_hyphens(c: Column) -> Column:
    return F.translate(c, SOFT_HYPHEN, "")


def normalize_quotes(c: Column) -> Column:
    return F.translate(c, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, "-\n(?U)(\\S)", "$1")


def normalize_whitespace(c: Column) -> Column:
    return py_strip(F.regexp_replace(F.regexp_replace(c, "[ \t]{2,}", " "), "\n{3,}", "\n\n"))


def remove_page_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?Umd)^\s*\d{1,4}\s*$", "")


def remove_running_headers(c: Column, min_repeats: int = 3) -> Column:
    """Without the lines whose trimmed text occurs `min_repeats` times or more; blank lines stay.

    The trimmed lines are sorted with their places: a line is repeated if among its neighbours some
    `min_repeats` in a row are equal and it is one of them. What was found is sorted back to the
    places, so no line is looked up in a list: n log n whatever the text.
    """
    step = min_repeats - 1

    def without(lines: Column) -> Column:
        by_text = F.array_sort(F.transform(lines, lambda x, i: F.struct(py_strip(x).alias("s"), i.alias("i"))))
        return let(let(by_text, marked), lambda m: F.array_join(F.filter(lines, lambda x, i: ~F.get(m, i)["gone"]), "\n"))

    def marked(t: Column) -> Column:
        def gone(x: Column, j: Column) -> Column:
            equal = F.lit(False)
            for d in range(min_repeats):
                equal = equal | F.coalesce(F.get(t, j - d)["s"] == F.get(t, j - d + step)["s"], F.lit(False))
            return equal & (x["s"] != "")

        return F.array_sort(F.transform(t, lambda x, j: F.struct(x["i"].alias("i"), gone(x, j).alias("gone"))))

    return let(F.split(c, "\n"), without)


def clean(c: Column, strip_headers: bool = False, is_pdf: bool = False, unicode: bool = True) -> Column:
    """All cleaning steps in their fixed order: page numbers, headers, NFC, soft hyphens, hyphenation, quotes, white space."""
    if is_pdf:
        c = remove_page_numbers(c)
    if strip_headers:
        c = remove_running_headers(c)
    if unicode:
        c = normalize_unicode(c)
    return normalize_whitespace(normalize_quotes(dehyphenate(remove_soft_hyphens(c))))


def detect_dialogue(c: Column) -> Column:
    """A double-quoted span of at most 500 characters, or any dash of the long kinds."""
    return c.rlike('(?s)"[^"]{1,500}"') | c.rlike("[—–]")


def normalise_double_style(c: Column) -> Column:
    return F.translate(c, "“”„‘’", "\"\"\"''")


def normalise_single_style(c: Column) -> Column:
    return F.translate(c, "‘’", "''")


def detect_quote_style(c: Column) -> Column:
    """`double` or `single`, by which mark opens more often at the start or after white space; ties are double."""
    double = F.regexp_count(c, F.lit(r'(?U)(?:^|\s)["“”„]'))
    single = F.regexp_count(c, F.lit(r"(?U)(?:^|\s)['‘’]"))
    return F.when(single > double, "single").otherwise("double")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def preview(c: Column, n: int = 120) -> Column:
    return F.replace(F.substring(c, 1, n), F.lit("\n"), F.lit(" "))


def character_slug(name: Column) -> Column:
    """Lower case, blanks as underscores, no full stops."""
    return F.translate(F.lower(name), " .", "_")


def speaker_slug(name: Column) -> Column:
    return F.translate(F.lower(name), " ", "_")


def name_tokens(name: Column) -> Column:
    """The distinct tokens that tell names apart: two characters or more and no stop word, or a title."""
    parts = F.split(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " "), " +")
    return F.array_distinct(F.filter(parts, lambda t: ((F.length(t) >= 2) & ~t.isin(NAME_STOP_WORDS)) | t.isin(TITLE_TOKENS)))


def mark_quotes(text: Column, quotes: Column) -> Column:
    """Each quote in turn, at its first place in the text as changed so far, becomes `[Q1]`, `[Q2]` and so on.

    A fold with `locate`, for quotes may hold characters that mean something in a pattern.
    """

    def step(acc: Column, q: Column) -> Column:
        at = F.instr(acc["text"], q)
        n = acc["n"] + 1
        mark = F.concat(F.lit("[Q"), n.cast("string"), F.lit("]"))
        done = F.concat(F.substring(acc["text"], F.lit(1), at - 1), mark, F.substring(acc["text"], at + F.length(q), F.length(acc["text"])))
        return F.struct(F.when((at > 0) & (q != ""), done).otherwise(acc["text"]).alias("text"), n.alias("n"))

    return F.aggregate(quotes, F.struct(text.alias("text"), F.lit(0).alias("n")), step, lambda acc: acc["text"])


def llm_confidence(c: Column) -> Column:
    """Words or numbers to a confidence; anything else is low."""
    return (
        F.when(F.lower(c) == "high", 0.95)
        .when(F.lower(c) == "medium", 0.70)
        .when(F.lower(c) == "low", 0.40)
        .otherwise(F.coalesce(c.try_cast("double"), F.lit(0.40)))
    )


def llm_quotes(reply: Column) -> Column:
    """The attributions of a reply as array of (quote_id, speaker_id, confidence); null if its shape is wrong."""
    got = F.from_json(reply, "attributions ARRAY<STRUCT<quote_id: STRING, speaker_id: STRING, confidence: STRING>>")["attributions"]
    whole = F.forall(got, lambda a: a["quote_id"].isNotNull() & a["speaker_id"].isNotNull())
    out = F.transform(got, lambda a: F.struct(a["quote_id"].alias("quote_id"), a["speaker_id"].alias("speaker_id"), llm_confidence(a["confidence"]).alias("confidence")))
    return F.when(got.isNotNull() & whole, out).cast("array<struct<quote_id:string,speaker_id:string,confidence:double>>")


def llm_spans(reply: Column) -> Column:
    """The older reply form: spans with text, speaker and kind; null if its shape is wrong."""
    got = F.from_json(reply, "spans ARRAY<STRUCT<text: STRING, speaker: STRING, kind: STRING>>")["spans"]
    whole = F.forall(got, lambda s: s["text"].isNotNull() & s["speaker"].isNotNull() & F.coalesce(s["kind"].isin("dialogue", "narration", "thought"), F.lit(False)))
    return F.when(got.isNotNull() & whole, got)


def prompt(marked: Column, allowed: Column) -> Column:
    """The request text for a model that attributes marked quotes."""
    return F.concat(
        F.lit("Who speaks each marked quote? Answer as JSON with the list `attributions` of quote_id, speaker_id, confidence (high, medium, low).\nSpeakers: "),
        F.array_join(allowed, ", "), F.lit("\n\n"), marked,
    )


def text_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def voice_hash(text: Column, engine: Column, voice: Column, version: str = "1") -> Column:
    """What a rendered segment depends on: if it changes, the audio is stale."""
    return text_hash(text, engine, voice, F.lit(version))


def eta_text(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(0).cast("int")


def matches_name(query: Column, *names: Column, aliases: Column) -> Column:
    """Case-insensitive equality with any of the names or aliases."""
    q = F.lower(query)
    hit = F.array_contains(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), F.lower), q)
    for n in names:
        hit = hit | F.coalesce(F.lower(n) == q, F.lit(False))
    return hit


def hardware_tier(memory_gb: Column) -> Column:
    """What a machine with so much graphics memory can run; `unknown` where it wasn't measured."""
    return F.when(memory_gb.isNull(), "unknown").when(memory_gb >= 8, "multi_voice").when(memory_gb >= 4, "narrator_only").otherwise("unsupported")
