"""Quotation linking: which earlier message each quoted passage comes from, and conversations in reply order without quotes.

All of it is DataFrame operations. Originals are found by an as-of lookup over
(conversation, passage hash) instead of a join of all equal passages, so a passage
repeated n times costs n rows, not n squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import Tables, rows_of, sized

#: Quote marks at the start of a line, with blanks between them.
_MARKS = r"^[ \t]*((?:>[ \t]?)*)"
#: A line that introduces a quotation, in the languages of the corpus.
_INTRO = r"(?i)(wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def unquoted(line: Column) -> Column:
    return F.regexp_replace(line, _MARKS, "")


def passages(text: Column) -> Column:
    """Array of (level, text): runs of lines with equal quote level; nested levels are passages of their own.

    Blank lines inside a quotation without a mark belong to what the message itself says.
    Runs are found by where they begin and each is joined once, so the work is linear in the lines.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.struct(quote_level(x).alias("level"), F.when(quote_level(x) > 0, unquoted(x)).otherwise(x).alias("text")))
    level = lambda ls, i: F.element_at(ls, i)["level"]
    # computed once, though lambdas refer to them
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def runs(ls: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: (i == 1) | (level(ls, i) != level(ls, F.greatest(i - 1, F.lit(1)))))

        def joined(st: Column) -> Column:
            end = lambda k: F.coalesce(F.try_element_at(st, k + 2), F.size(ls) + 1)
            return F.transform(st, lambda i, k: F.struct(level(ls, i).alias("level"), F.array_join(F.transform(F.slice(ls, i, end(k) - i), lambda x: x["text"]), "\n").alias("text")))

        return let(begins, joined)

    return let(lines, runs)


def sentences(text: Column) -> Column:
    """Normalised sentences of a passage: lower case, single blanks, only letters and digits between them."""
    parts = F.split(F.lower(text), r"(?<=[.!?])\s+|\n\s*\n")
    plain = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " ")))
    return F.array_distinct(F.filter(plain, lambda s: s != ""))


def own_text(found: Column) -> Column:
    """The passages of level 0, without lines that only introduce a quotation."""
    own = F.transform(F.filter(found, lambda p: p["level"] == 0), lambda p: F.regexp_replace(p["text"], r"\n?[^\n]*" + _INTRO, ""))
    return F.regexp_replace(F.array_join(F.when(F.size(found) > 1, own).otherwise(F.transform(found, lambda p: p["text"])), "\n"), r"^\s+|\s+$", "")


def link(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tables: Tables | None = None) -> DataFrame:
    """Every message without its quotes, with the message it replies to, in reply order.

    Rows: conversation, turn, role, own_text, n_passages (quoted), n_linked (with a known
    original), max_level, parent_turn, branch, position. The original of a quoted sentence
    is the latest earlier message of the conversation that says it itself; the parent
    is the one with most sentences of the outermost quotations (ties: the latest), else
    the previous message. Null turns come first, rows with equal turns in the order
    of role and text, and each is a message. Messages with a null conversation form one.
    Null texts are empty. `position` counts from 0, every branch after what it replies to.
    """
    result = tables or Tables(messages.sparkSession)
    with Tables(messages.sparkSession) as tables:
        order = W.partitionBy("conv").orderBy("turn", "role", "text")
        rows = messages.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
        rows = rows.withColumn("seq", F.row_number().over(order)).withColumn("group", F.xxhash64("conv", F.col("conv").isNull()))
        quoting = F.coalesce(F.col("text").rlike(r"(?m)^[ \t]*>"), F.lit(False))
        # a message without a mark is one passage of level 0; the fold runs over the others only
        whole = F.array(F.struct(F.lit(0).alias("level"), F.coalesce("text", F.lit("")).alias("text")))
        rows = rows.withColumn("quoting", quoting).withColumn("passages", F.when(F.col("quoting"), passages(F.col("text"))).otherwise(whole))
        rows = tables.write(
            rows.select(
                "conv", "turn", "role", "seq", "quoting", own_text(F.col("passages")).alias("own_text"),
                F.when(F.col("quoting"), F.filter("passages", lambda p: p["level"] > 0)).alias("quoted"),
            ),
            "messages",
        )
        quoted = rows.where("quoting").select("conv", "seq", F.posexplode("quoted").alias("place", "passage"))
        quoted = quoted.select("conv", "seq", "place", F.col("passage.level").alias("level"), F.explode(sentences(F.col("passage.text"))).alias("sentence"))
        quoted = tables.write(quoted.select("conv", "seq", "place", "level", F.xxhash64("sentence").alias("hash"), F.length("sentence").alias("size")), "quoted")
        if rows_of(quoted):
            with_quotes = sized(tables.write(quoted.select("conv").distinct(), "quoting"))
            said = rows.join(with_quotes, rows.conv.eqNullSafe(with_quotes.conv), "left_semi").select("conv", "seq", F.explode(sentences(F.col("own_text"))).alias("sentence"))
            said = said.select("conv", "seq", F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("level"), F.xxhash64("sentence").alias("hash"), F.length("sentence").alias("size"))
            before = W.partitionBy("conv", "hash", "size").orderBy("seq").rangeBetween(W.unboundedPreceding, -1)
            links = said.union(quoted).withColumn("origin", F.max(F.when(F.col("place").isNull(), F.col("seq"))).over(before)).where("place IS NOT NULL")
            links = tables.write(links, "links")
        else:
            links = quoted.withColumn("origin", F.lit(None).cast("int"))
        linked = links.groupBy("conv", "seq").agg(F.countDistinct(F.when(F.col("origin").isNotNull(), F.col("place"))).alias("n_linked"), F.min(F.when(F.col("origin").isNotNull(), F.col("level"))).alias("outer"))
        votes = links.where("origin IS NOT NULL").groupBy("conv", "seq", "level", "origin").agg(F.sum("size").alias("votes"))
        parent = votes.groupBy("conv", "seq").agg(F.min_by(F.col("origin"), F.struct("level", -F.col("votes"), -F.col("origin"))).alias("parent"))
        facts = tables.write(linked.join(parent, (linked.conv.eqNullSafe(parent.conv)) & (linked.seq == parent.seq), "left").select(linked.conv.alias("c"), linked.seq.alias("s"), "n_linked", "parent"), "facts")
        joined = rows.join(sized(facts), rows.conv.eqNullSafe(F.col("c")) & (rows.seq == F.col("s")), "left")
        joined = joined.withColumn("parent", F.coalesce("parent", F.when(F.col("seq") > 1, F.col("seq") - 1)))
        # runs of messages that each reply to the one before are consecutive; a branch begins a new run
        first = F.col("parent").isNull() | (F.col("parent") != F.col("seq") - 1)
        by_seq = W.partitionBy("conv").orderBy("seq")
        joined = tables.write(joined.withColumn("run", F.max(F.when(first, F.col("seq"))).over(by_seq.rowsBetween(W.unboundedPreceding, 0))), "runs")
        paths = _branch_keys(tables, joined)
        out = joined.join(sized(paths), joined.conv.eqNullSafe(F.col("bc")) & (joined.run == F.col("branch")), "left")
        out = out.withColumn("key", F.concat(F.coalesce("path", F.lit("")), F.lit("0"), F.lpad(F.col("seq").cast("string"), 12, "0")))
        turns = joined.select(F.col("conv").alias("pc"), F.col("seq").alias("ps"), F.col("turn").alias("parent_turn"))
        out = out.withColumn("position", F.row_number().over(W.partitionBy("conv").orderBy("key")) - 1)
        previous = F.lag("turn").over(by_seq)
        out = out.withColumn("previous", previous)
        far = tables.write(out.where("parent IS NOT NULL AND parent <> seq - 1").select(F.col("conv").alias("fc"), F.col("seq").alias("fs"), F.col("parent").alias("fp")), "far")
        far = tables.write(far.join(turns, far.fc.eqNullSafe(F.col("pc")) & (far.fp == F.col("ps"))).select("fc", "fs", "parent_turn"), "far_turns")
        out = out.join(sized(far), out.conv.eqNullSafe(F.col("fc")) & (out.seq == F.col("fs")), "left")
        out = out.select(
            F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role), "own_text",
            F.when(F.col("quoting"), F.size("quoted")).otherwise(0).alias("n_passages"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
            F.coalesce(F.array_max(F.transform("quoted", lambda p: p["level"])), F.lit(0)).alias("max_level"),
            F.when(F.col("parent") == F.col("seq") - 1, F.col("previous")).otherwise(F.col("parent_turn")).alias("parent_turn"),
            F.col("run").alias("branch"), F.col("position").cast("int").alias("position"),
        )
        return result.write(out, "linked", rows_of(rows))


def _branch_keys(tables: Tables, rows: DataFrame) -> DataFrame:
    """Rows (bc, branch, path): a sort key of every branch, by pointer jumping from branch to branch.

    Within a branch all messages come first, then the branches off it, those off later
    messages before those off earlier ones: the order of a walk through the reply tree.
    """
    starts = tables.write(rows.where("seq = run AND parent IS NOT NULL").select(F.col("conv").alias("bc"), F.col("run").alias("branch"), F.col("parent")), "branches")
    n = rows_of(starts)
    at = rows.select("conv", "seq", F.col("run").alias("up"))
    own = F.concat(F.lit("1"), F.lpad((F.lit(10**11) - F.col("parent")).cast("string"), 12, "0"), F.lpad(F.col("branch").cast("string"), 12, "0"))
    small = sized(starts, n)
    paths = at.join(small, at.conv.eqNullSafe(small.bc) & (at.seq == small.parent)).select("bc", "branch", "up", own.alias("path"))
    paths = tables.write(paths, "paths")
    while n and paths.where("up > 1").count():
        upper = sized(paths.select(F.col("bc").alias("uc"), F.col("branch").alias("ub"), F.col("up").alias("uu"), F.col("path").alias("upper")), n)
        paths = paths.join(upper, paths.bc.eqNullSafe(F.col("uc")) & (paths.up == F.col("ub")), "left").select("bc", "branch", F.coalesce("uu", F.lit(1)).alias("up"), F.concat(F.coalesce("upper", F.lit("")), "path").alias("path"))
        paths = tables.write(paths, "paths")
    return paths.select("bc", "branch", "path")
