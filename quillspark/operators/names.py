"""Names of characters: resolution, merging, seeds, recent mentions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import NAME_STOP_WORDS, TITLE_TOKENS, name_tokens, py_strip

# fixed values: titles that name nobody by themselves
AMBIGUOUS_TITLES = frozenset("captain doctor dr professor inspector major colonel judge priest father officer detective".split()) | {"the old man"}
_TITLES, _STOP = frozenset(TITLE_TOKENS), frozenset(NAME_STOP_WORDS)
RECENT_PARAGRAPHS = 8
#: Before all places in a book.
NEVER = -(1 << 62)


def tokens(name: str) -> frozenset[str]:
    words = "".join(c if c.isascii() and (c.isalnum() or c == " ") else " " for c in name.lower()).split()
    return frozenset(w for w in words if w in _TITLES or (len(w) >= 2 and w not in _STOP))


def compatible(new: frozenset[str], known: frozenset[str]) -> bool:
    """Whether two names may be one person's: they share more than titles, not both have words of their own, and their titles agree."""
    shared = new & known
    if not shared - AMBIGUOUS_TITLES:
        return False
    neutral = shared | AMBIGUOUS_TITLES | _TITLES
    if new - neutral and known - neutral:
        return False
    mine, theirs = new & _TITLES, known & _TITLES
    return not (mine and theirs and mine != theirs)


@dataclass
class Registry:
    """Names of one book in the order in which they come up.

    Aliases lead to a number, the number to the current canonical name, so a longer
    name renames a character in one step; a token index finds candidates without a scan.
    """

    names: list[str] = field(default_factory=list)
    known: list[frozenset[str]] = field(default_factory=list)
    alias: dict[str, int] = field(default_factory=dict)
    by_token: dict[str, set[int]] = field(default_factory=dict)

    def add(self, name: str, aliases: list[str] = ()) -> int:
        n = len(self.names)
        self.names.append(name)
        self.known.append(frozenset())
        self._name(n, name)
        for a in (*aliases, name):
            self.alias[a.lower()] = n
        return n

    def _name(self, n: int, name: str) -> None:
        for t in self.known[n]:
            self.by_token[t].discard(n)
        self.names[n], self.known[n] = name, tokens(name)
        for t in self.known[n]:
            self.by_token.setdefault(t, set()).add(n)

    def resolve(self, name: str) -> tuple[str, str | None]:
        """The canonical name, and why the name couldn't be merged if it was ambiguous."""
        name = name.strip()
        lower = name.lower()
        if not name or lower in ("unknown", "narrator"):
            return (lower or "unknown"), None
        if lower in self.alias:
            return self.names[self.alias[lower]], None
        own = tokens(lower)
        if lower in AMBIGUOUS_TITLES or (own and own <= AMBIGUOUS_TITLES):
            self.add(name)
            return name, "ambiguous_generic_title"
        near = {n for t in own for n in self.by_token.get(t, ())}
        found = [n for n in sorted(near) if compatible(own, self.known[n])]
        if len(found) != 1:
            self.add(name)
            return name, "multiple_matching_characters" if found else None
        n = found[0]
        self.alias[lower] = n
        if len(name) > len(self.names[n]) and lower not in _STOP:
            self._name(n, name)
        return self.names[n], None


def resolve_names(names: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Rows (book_id, ord, name, resolved, canonical, flagged_reason): each name as it is resolved at its place, and its character's name in the end.

    The outcome depends on the order, but a spelling is only decided where it first comes up;
    later on it leads to the name that its character has by then. So only the distinct spellings of a book
    are folded in order, which gives each spelling's character and the versions of that character's name with
    the places they hold from. Every version is longer than the one before, so they are few. All rows then take the
    newest version at their place by a join on the spelling. Seeds (book_id, name, aliases) come first.
    """
    kind = names.schema["book_id"].dataType.simpleString()
    rows = names.select("book_id", F.col("ord").cast("long").alias("ord"), "name", F.lower(py_strip(F.coalesce("name", F.lit("")))).alias("spelling"))
    fixed = F.col("spelling").isin("", "unknown", "narrator")
    spellings = rows.where(~fixed).groupBy("book_id", "spelling").agg(F.min(F.struct("ord", "name")).alias("first")).select("book_id", "spelling", "first.ord", "first.name", F.lit(None).cast("array<string>").alias("aliases"))
    if seeds is not None:
        spellings = spellings.unionByName(seeds.select("book_id", F.lower("name").alias("spelling"), F.lit(None).cast("long").alias("ord"), "name", "aliases"))

    def fold(spelt: pd.DataFrame) -> pd.DataFrame:
        registry, decided = Registry(), []
        versions: dict[int, list[tuple[int, str]]] = {}
        for order, spelling, name, aliases in spelt.sort_values(["ord", "name"], na_position="first", kind="stable")[["ord", "spelling", "name", "aliases"]].itertuples(index=False):
            if pd.isna(order):
                n = registry.add(name, list(aliases) if aliases is not None else [])
                versions[n] = [(NEVER, name)]
                continue
            _, why = registry.resolve(name)
            n = registry.alias.get(name.strip().lower())
            if n is None:  # nothing but what only Python strips
                continue
            known = versions.setdefault(n, [])
            if not known or known[-1][1] != registry.names[n]:
                known.append((int(order), registry.names[n]))
            decided.append((spelling, int(order), n, why))
        final = lambda name: registry.names[registry.alias[name.lower()]] if name.lower() in registry.alias else name
        if not decided:
            return pd.DataFrame()
        return pd.DataFrame(
            {
                "book_id": [spelt["book_id"].iloc[0]] * len(decided), "spelling": [d[0] for d in decided], "first_ord": [d[1] for d in decided], "why": [d[3] for d in decided],
                "versions": pd.Series([[{"since": at, "name": name, "final": final(name)} for at, name in versions[d[2]]] for d in decided], dtype=object),
            }
        )

    folded = spellings.groupBy("book_id").applyInPandas(fold, f"book_id {kind}, spelling string, first_ord long, why string, versions array<struct<since: long, name: string, final: string>>")
    joined = rows.join(folded, ["book_id", "spelling"], "left")
    now = F.element_at(F.filter("versions", lambda v: v["since"] <= F.col("ord")), -1)
    alone = F.when(F.col("spelling") == "", "unknown").otherwise(F.col("spelling"))
    return joined.select(
        "book_id", "ord", "name", F.when(fixed, alone).otherwise(F.coalesce(now["name"], F.lit("unknown"))).alias("resolved"), F.when(fixed, alone).otherwise(F.coalesce(now["final"], F.lit("unknown"))).alias("canonical"),
        F.when(F.col("ord") == F.col("first_ord"), F.col("why")).alias("flagged_reason"),
    )


def alias_candidates(names: DataFrame, least: int = 1) -> DataFrame:
    """Rows (book_id, name, candidate): the set form of resolution, independent of order.

    Names that share a token which isn't a title, where one has no further token of its own. A name
    with one candidate only is an unambiguous alias. Joined on (book, token).
    """
    distinct = names.select("book_id", "name").distinct().withColumn("tokens", name_tokens(F.col("name")))
    titles = F.array(*(F.lit(t) for t in sorted(AMBIGUOUS_TITLES | _TITLES)))
    plain = distinct.withColumn("own", F.array_except("tokens", titles)).where("size(own) > 0")
    each = plain.select("book_id", "name", "tokens", "own", F.explode("own").alias("token"))
    a, b = each.alias("a"), each.alias("b")
    pairs = a.join(b, (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.token") == F.col("b.token"))).where("a.name <> b.name")
    inside = (F.size(F.array_except("a.own", "b.own")) == 0) & (F.size("a.own") < F.size("b.own"))
    known = F.array(*(F.lit(t) for t in sorted(_TITLES)))
    ta, tb = F.array_intersect("a.tokens", known), F.array_intersect("b.tokens", known)
    agree = (F.size(ta) == 0) | (F.size(tb) == 0) | ((F.size(F.array_except(ta, tb)) == 0) & (F.size(F.array_except(tb, ta)) == 0))
    return pairs.where(inside & agree).select(F.col("a.book_id").alias("book_id"), F.col("a.name").alias("name"), F.col("b.name").alias("candidate")).distinct()


def unique_aliases(candidates: DataFrame) -> DataFrame:
    """Names with exactly one candidate: book_id, name, canonical."""
    return candidates.groupBy("book_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("candidate").alias("canonical")).where("n = 1").select("book_id", "name", "canonical")


def merge_entries(registry: DataFrame, merges: DataFrame) -> DataFrame:
    """The registry (book_id, canonical, aliases, mentions) after merges (book_id, source, target): aliases join, mentions add up."""
    moved = registry.join(merges.select("book_id", F.col("source").alias("canonical"), "target"), ["book_id", "canonical"], "left")
    moved = moved.withColumn("aliases", F.when(F.col("target").isNotNull(), F.array_union("aliases", F.array("canonical"))).otherwise(F.col("aliases")))
    return moved.groupBy("book_id", F.coalesce("target", "canonical").alias("canonical")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.sum("mentions").alias("mentions"))


def undo_merges(registry: DataFrame, history: DataFrame) -> DataFrame:
    """The registry before the merges of `history` (book_id, source, target, source_aliases, source_mentions)."""
    taken = history.groupBy("book_id", F.col("target").alias("canonical")).agg(F.array_distinct(F.flatten(F.collect_list(F.array_union("source_aliases", F.array("source"))))).alias("gone"), F.sum("source_mentions").alias("less"))
    targets = registry.join(taken, ["book_id", "canonical"], "left").select(
        "book_id", "canonical", F.when(F.col("gone").isNull(), F.col("aliases")).otherwise(F.array_except("aliases", "gone")).alias("aliases"),
        F.greatest(F.lit(0), F.col("mentions") - F.coalesce("less", F.lit(0))).alias("mentions"),
    )
    back = history.select("book_id", F.col("source").alias("canonical"), F.col("source_aliases").alias("aliases"), F.col("source_mentions").alias("mentions"))
    return targets.unionByName(back)


def recent_characters(mentions: DataFrame, n: int = RECENT_PARAGRAPHS) -> DataFrame:
    """Rows (book_id, para_idx, recent): who was named in this paragraph or the n before it, sorted."""
    frame = W.partitionBy("book_id").orderBy("para_idx").rangeBetween(-n, W.currentRow)
    real = F.when(~F.col("name").isin("narrator", "unknown"), F.col("name"))
    out = mentions.select("book_id", "para_idx", F.array_sort(F.collect_set(real).over(frame)).alias("recent"))
    return out.dropDuplicates(["book_id", "para_idx"])


#: Takes the text of a chapter, gives names with their numbers of mentions.
Recogniser = Callable[[str], list[tuple[str, int]]]


def recognise(chapters: DataFrame, recogniser: Recogniser) -> DataFrame:
    """Rows (book_id, chapter_idx, name, n) by a pluggable recogniser over chapter texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(b, c, name, int(n)) for b, c, text in zip(rows["book_id"], rows["chapter_idx"], rows["text"]) for name, n in recogniser(text or "")]
            yield pd.DataFrame(found, columns=["book_id", "chapter_idx", "name", "n"])

    kind = chapters.schema["book_id"].dataType.simpleString()
    return chapters.select("book_id", "chapter_idx", "text").mapInPandas(run, f"book_id {kind}, chapter_idx int, name string, n long")


def capitalised_names(paragraphs: DataFrame) -> DataFrame:
    """The stand-in recogniser, native: runs of capitalised words that don't begin a sentence."""
    pattern = r"(?<=[\p{Ll},;:] )(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)"
    each = paragraphs.select("book_id", "chapter_idx", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name"))
    return each.groupBy("book_id", "chapter_idx", "name").agg(F.count(F.lit(1)).alias("n"))


def cast_seeds(mentions: DataFrame, manual: DataFrame | None = None, least: int = 3) -> DataFrame:
    """Rows (book_id, name, aliases, mention_count): names mentioned often enough, and all that a user gave, most mentioned first."""
    counts = mentions.groupBy("book_id", "name").agg(F.sum("n").alias("mention_count")).where(F.col("mention_count") >= least)
    if manual is None:
        out = counts.withColumn("aliases", F.array().cast("array<string>"))
    else:
        given = manual.groupBy("book_id", "name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))
        out = counts.join(given, ["book_id", "name"], "full").withColumn("mention_count", F.coalesce("mention_count", F.lit(0))).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return out.select("book_id", "name", "aliases", "mention_count").orderBy("book_id", F.desc("mention_count"), "name")


def registry_summary(resolved: DataFrame) -> DataFrame:
    """Rows (book_id, canonical, aliases, mentions, is_unknown) from resolved names."""
    return resolved.groupBy("book_id", "canonical").agg(F.array_sort(F.collect_set("name")).alias("aliases"), F.count(F.lit(1)).alias("mentions")).withColumn("is_unknown", F.col("canonical") == "unknown")
