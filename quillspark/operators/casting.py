"""Who the characters are and which voices they get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let, matches_name, speaker_slug, text_hash

WINDOW = 20
MINOR_LINES = 3
EXTRAS = 2

# fixed values: words that speak for a gender or an age
GENDER_WORDS = {"male": r"he|him|his", "female": r"she|her|hers", "nonbinary": r"they|them|their|theirs"}
AGE_WORDS = {
    "elderly": r"old(?:\s+(?:man|woman|lady|fellow|chap))?|elder|elderly|aged|ancient|grandmother|grandfather|grandma|grandpa|granny|gran|granddad|geezer|crone",
    "child": r"boy|girl|child|children|kid|kids|toddler|infant|baby|juvenile|pupil",
    "young_adult": r"young\s+(?:man|woman|lady|fellow)|teen|teenager|adolescent|youth|lad|lass",
    "adult": r"man|woman|gentleman|lady|sir|madam|mister|mrs|miss|ms",
}


def _bounded(words: str, left: str = r"\b", right: str = r"\b", ascii: bool = False) -> Column:
    """A pattern for whole words. With `ascii` only ASCII letters, digits and the underline are part of a word, so `teen` stands in `teenß`."""
    if not ascii:
        return F.lit(rf"(?iU){left}({words}){right}")
    edge = {r"\b": (r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])")}
    return F.lit(rf"(?iu){edge.get(left, (left, ''))[0]}({words}){edge.get(right, ('', right))[1]}")


def votes(text: Column, words: str, ascii: bool = False) -> Column:
    return F.regexp_count(text, _bounded(words, ascii=ascii))


def speakers(segments: DataFrame) -> DataFrame:
    """Rows (book_id, speaker_id, line_count, first_chapter) of named speakers."""
    named = segments.where("speaker_id <> '' AND speaker_id NOT IN ('narrator', 'unknown')")
    place = F.struct("chapter", *(c for c in ("para_idx", "seg_idx") if c in segments.columns))
    return named.groupBy("book_id", "speaker_id").agg(F.count(F.lit(1)).alias("line_count"), F.min_by("chapter", place).alias("first_chapter"))


def adjacency(segments: DataFrame, window: int = WINDOW, among: DataFrame | None = None) -> DataFrame:
    """Rows (book_id, a, b, n): how often two speakers come within `window` rows of each other; all rows count as places.

    A look-ahead frame over each book instead of a self-join; at most `window` rows each. `among` (book_id, name, main)
    leaves only pairs of the speakers it names of which one is `main`, before any pair is made.
    """
    order = [c for c in ("chapter", "para_idx", "seg_idx") if c in segments.columns] or ["ord"]
    ahead = W.partitionBy("book_id").orderBy(*order).rowsBetween(1, window)
    real = F.when((F.col("speaker_id") != "") & ~F.col("speaker_id").isin("narrator", "unknown"), F.col("speaker_id"))
    rows = segments.select("book_id", *order, real.alias("s"))
    if among is not None:
        known = rows.join(among.select("book_id", F.col("name").alias("s"), "main"), ["book_id", "s"], "left")
        who = known.select("book_id", *order, F.when(F.col("main").isNotNull(), F.struct("s", "main")).alias("s"))
        ahead_of = who.withColumn("others", F.collect_list("s").over(ahead)).where("s IS NOT NULL").select("book_id", "s", F.explode("others").alias("o"))
        pairs = ahead_of.where("(s.main OR o.main) AND s.s <> o.s").select("book_id", F.col("s.s").alias("s"), F.col("o.s").alias("o"))
        return pairs.groupBy("book_id", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("others", F.collect_list("s").over(ahead)).where("s IS NOT NULL")
    pairs = rows.select("book_id", "s", F.explode("others").alias("o")).where("s <> o")
    return pairs.groupBy("book_id", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def character_snippets(paragraphs: DataFrame, characters: DataFrame) -> DataFrame:
    """Rows (book_id, id, para) of paragraphs that hold a character's name or are one of its names.

    Joined within the book, where characters are few; `instr` is checked on the joined rows.
    """
    order = [c for c in ("chapter_idx", "para_idx") if c in paragraphs.columns]
    p = paragraphs.select("book_id", F.struct(*order).alias("place"), "text")
    c = characters.select("book_id", "id", "name", "display_name", "aliases")
    hit = (F.instr("text", F.col("name")) > 0) | matches_name(F.col("text"), F.col("name"), F.col("id"), F.col("display_name"), aliases=F.col("aliases"))
    return p.join(c, "book_id").where(hit).select("book_id", "id", "place", "text")


def infer_gender(text: Column) -> tuple[Column, Column]:
    """Label and trust by pronouns; of equal counts the first of male, female, nonbinary, with half the trust.

    All pronouns are found in one pass; the first part of the pattern is for speed.
    """
    words = {g: w.split("|") for g, w in GENDER_WORDS.items()}
    first = "".join(sorted({w[0] for own in words.values() for w in own}))
    found = F.regexp_extract_all(text, F.lit(rf"(?iU)(?=[{first}])\b({'|'.join(GENDER_WORDS.values())})\b"), F.lit(1))
    # the long s is an s where case doesn't count
    plain = F.transform(found, lambda w: F.translate(F.lower(w), "ſ", "s"))
    counts = let(plain, lambda p: F.struct(*(_how_many(p, own).alias(g) for g, own in words.items())))
    return _judged(counts, list(words), halve=True)


def infer_age(text: Column) -> tuple[Column, Column]:
    """Label and trust by words for ages; of equal counts the more special."""
    counts = let(text, lambda t: F.struct(*(votes(t, w).alias(a) for a, w in AGE_WORDS.items())))
    return _judged(counts, list(AGE_WORDS), halve=False)


def _how_many(found: Column, own: list[str]) -> Column:
    return F.array_size(F.filter(found, lambda w: w.isin(own)))


def _judged(counts: Column, names: list[str], halve: bool) -> tuple[Column, Column]:
    """`_winner` over a struct of counts that is computed once."""

    def pick(n: Column) -> Column:
        label, trust = _winner({x: n[x] for x in names}, halve)
        return F.struct(label.alias("label"), trust.alias("trust"))

    both = let(counts, pick)
    return both["label"], both["trust"]


def _winner(counts: dict[str, Column], halve: bool) -> tuple[Column, Column]:
    most = F.greatest(*counts.values())
    total = sum(counts.values(), F.lit(0))
    label = None
    for name, n in counts.items():
        label = F.when(n == most, name) if label is None else label.when(n == most, name)
    trust = F.round(most / total, 4)
    if halve:
        ties = sum((F.when(n == most, 1).otherwise(0) for n in counts.values()), F.lit(0))
        trust = F.when(ties > 1, F.round(trust * 0.5, 4)).otherwise(trust)
    return F.when(total == 0, "unknown").otherwise(label), F.when(total == 0, 0.0).otherwise(trust)


def infer_profiles(snippets: DataFrame, ascii: bool = False) -> DataFrame:
    """Rows (book_id, id, gender, gender_confidence, age_bracket, age_confidence) over each character's snippets.

    The outcome is that of the snippets joined by blanks in order, but only counts are shuffled: each snippet
    is counted by itself. What a joint can add is a `young` at its left with its noun at its right. `ascii` as for `_bounded`.
    """
    words = GENDER_WORDS | AGE_WORDS
    text = F.col("text")
    counted = snippets.select("book_id", "id", "place", F.regexp_like(text, _bounded("young", right=r"\s*\z", ascii=ascii)).alias("_ends"), F.regexp_like(text, _bounded("man|woman|lady|fellow", left=r"\A\s*", ascii=ascii)).alias("_begins"), *(votes(text, w, ascii).alias(f"_{k}") for k, w in words.items()))
    joint = F.lag("_ends", 1, False).over(W.partitionBy("book_id", "id").orderBy("place")) & F.col("_begins")
    counted = counted.withColumn("_young_adult", F.col("_young_adult") + joint.cast("int"))
    sums = counted.groupBy("book_id", "id").agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in words))
    gender, sure = _winner({g: F.col(f"_{g}") for g in GENDER_WORDS}, halve=True)
    age, age_sure = _winner({a: F.col(f"_{a}") for a in AGE_WORDS}, halve=False)
    return sums.select("book_id", "id", gender.alias("gender"), sure.alias("gender_confidence"), age.alias("age_bracket"), age_sure.alias("age_confidence"))


def profile_characters(characters: DataFrame, paragraphs: DataFrame, ascii: bool = False) -> DataFrame:
    """Characters with what can be inferred where nothing is known; locked ones stay. `ascii` as for `_bounded`."""
    found = infer_profiles(character_snippets(paragraphs, characters), ascii).alias("f")
    joined = characters.alias("c").join(found, (F.col("c.book_id") == F.col("f.book_id")) & (F.col("c.id") == F.col("f.id")), "left")
    free = F.col("f.id").isNotNull() & ~F.coalesce("c.user_locked", F.lit(False))
    old = F.col("c.profile")
    g = free & (F.coalesce(old["gender"], F.lit("unknown")) == "unknown")
    a = free & (F.coalesce(old["age_bracket"], F.lit("unknown")) == "unknown")
    profile = F.struct(
        F.when(g, F.col("f.gender")).otherwise(old["gender"]).alias("gender"), F.when(g, F.col("f.gender_confidence")).otherwise(old["gender_confidence"]).alias("gender_confidence"),
        F.when(a, F.col("f.age_bracket")).otherwise(old["age_bracket"]).alias("age_bracket"), F.when(a, F.col("f.age_confidence")).otherwise(old["age_confidence"]).alias("age_confidence"),
    )
    return joined.select(*(profile.alias(x) if x == "profile" else F.col(f"c.{x}") for x in characters.columns))


def suggest_characters(segments: DataFrame) -> DataFrame:
    """Characters from the speakers of a book."""
    return speakers(segments).select(
        "book_id", speaker_slug(F.col("speaker_id")).alias("id"), F.col("speaker_id").alias("name"), F.col("speaker_id").alias("display_name"), F.array().cast("array<string>").alias("aliases"),
        F.struct(F.lit("unknown").alias("gender"), F.lit(0.0).alias("gender_confidence"), F.lit("unknown").alias("age_bracket"), F.lit(0.0).alias("age_confidence")).alias("profile"),
        "line_count", "first_chapter", F.lit(False).alias("user_locked"), F.lit(None).cast("map<string,string>").alias("voice_assignments"),
    )


def verified_voices(voices: DataFrame, gender: str | None = None, age: str | None = None) -> DataFrame:
    """Voices for characters; a wanted tag must be verified."""
    out = voices.where(~F.coalesce("narrator_reserved", F.lit(False)))
    if gender and gender != "unknown":
        out = out.where(F.col("gender_verified") & (F.lower("gender") == gender.lower()))
    if age and age != "unknown":
        out = out.where(F.col("age_verified") & (F.lower("age_bracket") == age.lower()))
    return out


def valid_voices(voices: DataFrame, engine_voices: DataFrame) -> DataFrame:
    """The catalogue entries that the engine really has."""
    return voices.join(engine_voices.select("engine", "id"), ["engine", "id"], "left_semi")


def _parts(characters: DataFrame, voices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Characters with their role and rank `k` in it; the voices for main characters, book by book in order; those that others share."""
    books = characters.select("book_id").distinct()
    narrator = voices.agg(F.coalesce(F.min_by(F.when(F.coalesce("narrator_reserved", F.lit(False)), F.col("id")), F.when(F.coalesce("narrator_reserved", F.lit(False)), F.col("pos"))), F.min_by("id", "pos"), F.lit("narrator")).alias("narrator_id"))
    free = voices.where(~F.coalesce("narrator_reserved", F.lit(False))).select(F.col("id").alias("voice"), "pos")
    pool = free.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("pos"))).withColumn("n_voices", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))
    named = characters.where("id NOT IN ('narrator', 'unknown')")
    named = named.withColumn("n_named", F.count(F.lit(1)).over(W.partitionBy("book_id")))
    n_voices = free.agg(F.count(F.lit(1)).alias("n_voices"))
    named = named.crossJoin(F.broadcast(n_voices)).crossJoin(F.broadcast(narrator))  # one row each
    named = named.withColumn("pooled", F.col("n_named") > F.col("n_voices"))
    locked = F.coalesce("user_locked", F.lit(False)) & F.col("locked_voice").isNotNull()
    first_person = (F.upper(F.trim("name")) == "I") | (F.col("id") == "i")
    minor = (F.col("line_count") <= MINOR_LINES) & F.col("pooled")
    role = F.when(locked, "locked").when(first_person, "narrator").when(minor, "minor").otherwise("main")
    by_lines = [F.desc("line_count"), F.asc("first_seen")]
    named = named.withColumn("role", role).withColumn("k", F.row_number().over(W.partitionBy("book_id", "role").orderBy(*by_lines)))
    taken = named.where("role = 'locked'").select("book_id", F.col("locked_voice").alias("voice")).distinct()
    sizes = named.select("book_id", "pooled").distinct()
    extras = F.when(F.col("pooled"), F.least(F.lit(EXTRAS), F.col("n_voices"))).otherwise(0)
    per_book = books.join(sizes, "book_id").join(F.broadcast(pool)).withColumn("extras", extras)  # the catalogue is small
    main = per_book.where(F.col("rank") <= F.col("n_voices") - F.col("extras")).join(taken, ["book_id", "voice"], "left_anti")
    main = main.withColumn("k", F.row_number().over(W.partitionBy("book_id").orderBy("rank"))).select("book_id", "k", "voice", F.lit("main").alias("role"))
    spare = per_book.where(F.col("rank") > F.col("n_voices") - F.col("extras")).withColumn("turn", F.col("rank") - (F.col("n_voices") - F.col("extras")) - 1)
    spare = spare.select("book_id", F.col("turn").alias("turn"), F.col("voice").alias("extra"))
    n_extras = F.least(F.lit(EXTRAS), F.col("n_voices"))
    wanted = named.withColumn("turn", F.when(F.col("role") == "minor", F.pmod(F.col("k") - 1, F.greatest(n_extras, F.lit(1)))).otherwise(0))
    return wanted, main, spare


def assign_in_order(characters: DataFrame, voices: DataFrame) -> DataFrame:
    """Rows (book_id, id, voice_id): without measured voices, the n-th character by lines gets the n-th voice of the catalogue (`pos`).

    If there are more characters than voices the last two are extras that minor
    characters share in turn. 'I' speaks as the narrator, as do those for whom no voice
    is left and no extras are. Locked characters keep theirs, which nobody else gets. Ranks and
    equi-joins on (book, rank).
    """
    wanted, main, spare = _parts(characters, voices)
    out = wanted.join(main, ["book_id", "role", "k"], "left").join(spare, ["book_id", "turn"], "left")
    voice = F.when(F.col("role") == "locked", F.col("locked_voice")).when(F.col("role") == "narrator", F.col("narrator_id")).when(F.col("role") == "minor", F.coalesce("extra", "narrator_id")).otherwise(F.coalesce("voice", F.when(F.col("pooled"), F.col("extra")), "narrator_id"))
    return out.select("book_id", "id", voice.alias("voice_id"))


def weighed(characters: DataFrame, voices: DataFrame) -> DataFrame:
    """Rows (book_id, name, main): whose pairs `assign_measured` weighs. Main characters with a voice of their own, at most as many in a book as voices, and locked ones."""
    wanted, main, _ = _parts(characters, voices)
    scored = wanted.where("role = 'main'").join(main.groupBy("book_id").agg(F.count(F.lit(1)).alias("n")), "book_id").where("k <= n").select("book_id", "name", F.lit(True).alias("main"))
    locked = wanted.where("role = 'locked'").select("book_id", "name", F.lit(False).alias("main"))
    return scored.unionByName(locked).groupBy("book_id", "name").agg(F.max("main").alias("main"))


_MEASURED = "array<struct<pos:int,id:string,f0:double,centroid:double,gender:string,gender_verified:boolean,age_bracket:string,age_verified:boolean>>"


def assign_measured(characters: DataFrame, voices: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (book_id, id, voice_id): with measured voices, each main character in turn gets the one least like those of its neighbours.

    `characters` and `voices` as for `assign_in_order`, besides with `gender`, `age_bracket`, and for voices `f0`,
    `centroid` and whether the tags are verified; `pairs` (book_id, a, b, n) by name. A voice costs, for every
    neighbour that has one nearer than 1, the difference to 1 times ten times how often both come
    near each other; of equal costs (to nine places) the first voice counts. Voices with the wanted tags go
    before others. Locked characters have their voices from the start; all others as without measures.

    A scored character takes a voice for itself, so a book has no more of them than the catalogue has
    voices: what is gathered of a book, their weights for each other and for the locked voices, is bounded by the catalogue
    alone, and a fold inside Spark's own code gives out the voices.
    """
    wanted, main, _ = _parts(characters, voices)
    number = voices.withColumn("u", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("pos")).cast("int"))  # the catalogue is small
    tags = [F.col(c) if c in voices.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("gender", "string"), ("gender_verified", "boolean"), ("age_bracket", "string"), ("age_verified", "boolean"))]
    catalogue = voices.select(F.struct("pos", "id", F.col("f0").cast("double").alias("f0"), F.col("centroid").cast("double").alias("centroid"), *tags).alias("v")).agg(F.array_sort(F.collect_list("v")).cast(_MEASURED).alias("voices"))
    free = main.join(F.broadcast(number.select(F.col("id").alias("voice"), "u")), "voice").groupBy("book_id").agg(F.array_sort(F.collect_list("u")).alias("free"))
    scored = wanted.where("role = 'main'").join(free, "book_id").where(F.col("k") <= F.size("free")).select("book_id", "id", "name", "k", "gender", "age_bracket")
    both = pairs.select("book_id", F.col("a").alias("name"), F.col("b").alias("other"), "n").unionByName(pairs.select("book_id", F.col("b").alias("name"), F.col("a").alias("other"), "n")).where("name <> other")
    mine = scored.select("book_id", "name", "k").join(both, ["book_id", "name"])
    before = mine.join(scored.select("book_id", F.col("name").alias("other"), F.col("k").alias("j")), ["book_id", "other"]).where("j < k").select("book_id", "k", "j", F.lit(None).cast("int").alias("u"), "n")
    locked = wanted.where("role = 'locked'").join(F.broadcast(number.select(F.col("id").alias("locked_voice"), "u")), "locked_voice").select("book_id", F.col("name").alias("other"), "u")
    fixed = mine.join(locked, ["book_id", "other"]).select("book_id", "k", F.lit(None).cast("int").alias("j"), "u", "n")
    near = before.unionByName(fixed).groupBy("book_id", "k", "j", "u").agg(F.sum("n").cast("double").alias("w")).groupBy("book_id", "k").agg(F.array_sort(F.collect_list(F.struct("j", "u", "w"))).alias("near"))
    each = scored.join(near, ["book_id", "k"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<struct<j:int,u:int,w:double>>")))
    books = each.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("k", "id", "gender", "age_bracket", "near"))).alias("cast")).join(free, "book_id").crossJoin(F.broadcast(catalogue))

    def fits(v: Column, x: Column) -> Column:
        ok = F.lit(True)
        for tag, sure in (("gender", "gender_verified"), ("age_bracket", "age_verified")):
            want = F.lower(F.coalesce(x[tag], F.lit("unknown")))
            ok = ok & ((want == "unknown") | (F.coalesce(v[sure], F.lit(False)) & (F.lower(F.coalesce(v[tag], F.lit(""))) == want)))
        return ok

    def step(state: Column, x: Column) -> Column:
        voice = lambda u: F.element_at("voices", u)

        def cost(u: Column, others: Column) -> Column:
            def add(total: Column, e: Column) -> Column:
                a, b = voice(u), voice(e["u"])
                apart = F.sqrt(F.pow((a["f0"] - b["f0"]) / 45.0, F.lit(2)) + F.pow((a["centroid"] - b["centroid"]) / 400.0, F.lit(2)))
                return total + F.coalesce(F.when(apart < 1, (1 - apart) * e["w"] * 10), F.lit(0.0))

            return F.round(F.aggregate(others, F.lit(0.0), add), 9)

        fitting = F.filter(state["left"], lambda u: fits(voice(u), x))
        pool = F.when(F.size(fitting) > 0, fitting).otherwise(state["left"])
        others = F.transform(x["near"], lambda e: F.struct(F.coalesce(e["u"], F.element_at(state["given"], F.coalesce(e["j"], F.lit(1)))).alias("u"), e["w"].alias("w")))
        best = let(others, lambda o: F.array_min(F.transform(pool, lambda u: F.struct(cost(u, o).alias("cost"), u.alias("u"))))["u"])
        return let(best, lambda u: F.struct(F.array_remove(state["left"], u).alias("left"), F.array_append(state["given"], u).alias("given")))

    start = F.struct(F.col("free").alias("left"), F.array().cast("array<int>").alias("given"))
    given = F.aggregate("cast", start, step, lambda state: state["given"])
    chosen = books.select("book_id", "cast", "voices", given.alias("given")).select("book_id", F.explode(F.arrays_zip("cast", "given")).alias("x"), "voices")
    chosen = chosen.select("book_id", F.col("x.cast.id").alias("id"), F.element_at("voices", F.col("x.given"))["id"].alias("scored"))
    return assign_in_order(characters, voices).join(chosen, ["book_id", "id"], "left").select("book_id", "id", F.coalesce("scored", "voice_id").alias("voice_id"))


def set_voice(characters: DataFrame, book_id: object, who: str, engine: str, voice_id: str) -> DataFrame:
    """A user's choice of voice, which locks the character."""
    hit = (F.col("book_id") == book_id) & matches_name(F.lit(who), F.col("name"), F.col("id"), F.col("display_name"), aliases=F.col("aliases"))
    new = F.map_concat(F.map_filter(F.coalesce("voice_assignments", F.create_map().cast("map<string,string>")), lambda k, _: k != engine), F.create_map(F.lit(engine), F.lit(voice_id)))
    return characters.withColumns({"voice_assignments": F.when(hit, new).otherwise(F.col("voice_assignments")), "user_locked": F.when(hit, True).otherwise(F.col("user_locked"))})


def rename(characters: DataFrame, book_id: object, who: str, name: str) -> DataFrame:
    hit = (F.col("book_id") == book_id) & matches_name(F.lit(who), F.col("name"), F.col("id"), F.col("display_name"), aliases=F.col("aliases"))
    return characters.withColumn("display_name", F.when(hit, name).otherwise(F.col("display_name")))


def merge_characters(characters: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The characters after merges (book_id, source, target by id), and the record of each: winner, loser, what the loser had, or an error.

    The target wins, unless the source alone is locked; if both are, nothing happens.
    """
    s, t = characters.alias("s"), characters.alias("t")
    m = merges.alias("m").join(s, (F.col("m.book_id") == F.col("s.book_id")) & (F.col("m.source") == F.col("s.id")), "left").join(t, (F.col("m.book_id") == F.col("t.book_id")) & (F.col("m.target") == F.col("t.id")), "left")
    both = F.coalesce("s.user_locked", F.lit(False)) & F.coalesce("t.user_locked", F.lit(False))
    error = F.when(F.col("s.id").isNull() | F.col("t.id").isNull(), "both characters must exist").when(F.col("s.id") == F.col("t.id"), "a character can't be merged into itself").when(both, "both are locked")
    source_wins = F.coalesce("s.user_locked", F.lit(False)) & ~F.coalesce("t.user_locked", F.lit(False))
    loser = F.when(source_wins, F.struct("t.*")).otherwise(F.struct("s.*"))
    record = m.select(F.col("m.book_id").alias("book_id"), F.when(source_wins, F.col("s.id")).otherwise(F.col("t.id")).alias("winner_id"), loser.alias("loser"), error.alias("error"))
    record = record.select("book_id", "winner_id", F.col("loser.id").alias("loser_id"), F.col("loser.name").alias("loser_name"), F.col("loser.aliases").alias("loser_aliases"), F.col("loser.line_count").alias("loser_line_count"), F.col("loser.user_locked").alias("loser_user_locked"), F.col("loser.voice_assignments").alias("loser_voice_assignments"), "error")
    good = record.where("error IS NULL")
    gains = good.groupBy("book_id", F.col("winner_id").alias("id")).agg(F.sum("loser_line_count").alias("_more"), F.flatten(F.collect_list(F.array_union(F.array("loser_name"), "loser_aliases"))).alias("_names"))
    kept = characters.join(good.select("book_id", F.col("loser_id").alias("id")), ["book_id", "id"], "left_anti").join(gains, ["book_id", "id"], "left")
    kept = kept.withColumn("line_count", F.col("line_count") + F.coalesce("_more", F.lit(0))).withColumn("aliases", F.when(F.col("_names").isNull(), F.col("aliases")).otherwise(F.array_sort(F.array_union("aliases", "_names"))))
    return kept.select(characters.columns), record


def undo_merge(characters: DataFrame, record: DataFrame) -> DataFrame:
    """The characters before the merges of a record."""
    r = record.where("error IS NULL")
    less = r.groupBy("book_id", F.col("winner_id").alias("id")).agg(F.sum("loser_line_count").alias("_less"), F.flatten(F.collect_list(F.array_union(F.array("loser_name"), "loser_aliases"))).alias("_names"))
    back = characters.join(less, ["book_id", "id"], "left").withColumn("line_count", F.greatest(F.lit(0), F.col("line_count") - F.coalesce("_less", F.lit(0)))).withColumn("aliases", F.when(F.col("_names").isNull(), F.col("aliases")).otherwise(F.array_except("aliases", "_names")))
    lost = r.select("book_id", F.col("loser_id").alias("id"), F.col("loser_name").alias("name"), F.col("loser_name").alias("display_name"), F.col("loser_aliases").alias("aliases"), F.col("loser_line_count").alias("line_count"), F.col("loser_user_locked").alias("user_locked"), F.col("loser_voice_assignments").alias("voice_assignments"))
    return back.select(characters.columns).unionByName(lost, allowMissingColumns=True)


def cast_hash(characters: DataFrame) -> DataFrame:
    """Rows (book_id, cast_hash): a digest of everything in a book's cast, for approval."""
    row = F.to_json(F.struct(*sorted(c for c in characters.columns if c != "book_id")), {"ignoreNullFields": "false"})
    return characters.groupBy("book_id").agg(text_hash(F.array_join(F.array_sort(F.collect_list(row)), "\n")).alias("cast_hash"))


def approve(characters: DataFrame) -> DataFrame:
    """Rows (book_id, cast_hash, approved_at) to store beside the cast."""
    return cast_hash(characters).withColumn("approved_at", F.current_timestamp())


def approval_holds(characters: DataFrame, approvals: DataFrame) -> DataFrame:
    """Rows (book_id, valid): whether the cast is still as it was approved."""
    now = cast_hash(characters)
    return now.join(approvals.select("book_id", F.col("cast_hash").alias("_then")), "book_id", "left").select("book_id", F.coalesce(F.col("cast_hash") == F.col("_then"), F.lit(False)).alias("valid"))


