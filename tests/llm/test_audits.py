"""Licence scans, hard negatives and the divergence of sources, against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import divergence, hard_negatives, licenses, util

# ---- licences


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _plain_scan(text, phrases, texts):
    ws = _words(text)
    stands = lambda key, a, b: any(ws[i : i + len(key)] == key for i in range(max(a, 0), min(b, len(ws)) - len(key) + 1))
    base, labels, score = {}, set(), 0.0
    for t in phrases:
        key = _words(t.text)
        found = [i for i in range(len(ws) - len(key) + 1) if ws[i : i + len(key)] == key]
        if found:
            base.setdefault(t.label, []).extend(found)
            score = 1.0
    for t in texts:
        want = _words(t.text)
        for d in range(-len(want) - 10, len(ws) + 10):
            at = lambda i: ws[max(0, d + i - licenses.SHIFT) : max(0, d + i + licenses.SHIFT + 1)]  # noqa: E731, B023
            share = sum(w in at(i) for i, w in enumerate(want)) / len(want)
            if share >= licenses.LEAST_SHARE and all(stands(_words(k), d - licenses.SHIFT, d + len(want) + licenses.SHIFT) for k in t.keys):
                labels.add(t.label)
                score = max(score, share)
    starts = [x for xs in base.values() for x in xs]
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels | set(base))), score


def _licence_texts(seed):
    rng = random.Random(seed)
    pool = [w for t in licenses.TEMPLATES for w in t.text.split()] + ["the", "of", "word", "ünder"] * 5
    out = []
    for _ in range(40):
        body = [rng.choice(pool) for _ in range(rng.randrange(30))]
        copy = rng.choice(licenses.TEMPLATES).text.split()
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(copy))
            copy[k : k + 1] = rng.choice([[], [copy[k], "also"], [rng.choice(pool)]])
            copy = copy or ["x"]
        k = rng.randrange(len(body) + 1)
        out.append(" ".join(body[:k] + copy[: rng.randrange(len(copy) // 2, len(copy) + 1)] + body[k:]))
    return out


def test_licences_equal_a_plain_scan(documents):
    texts = [None, "", "...", "CC BY", "cc-by and the Apache\nLicense", "MIT LICENSE " * 3, "by cc by", "GNU General\x00Public License"] + _licence_texts(1)
    rows = licenses.scan(documents(*texts), licenses.BASE_PHRASES, licenses.TEMPLATES).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts):
        assert tuple(row)[1:8] == pytest.approx(_plain_scan(text, licenses.BASE_PHRASES, licenses.TEMPLATES)), text
    assert sum("," in r.labels for r in rows) > 5 and any(0.75 <= r.score < 1 for r in rows)


def test_any_order_of_rarity_finds_the_same_copies():
    texts = _licence_texts(2)
    index = licenses.Index(licenses.BASE_PHRASES, licenses.TEMPLATES)
    found = []
    for seed in range(3):
        index.rarity = np.random.default_rng(seed).permutation(len(index.words))
        found.append([c.to_pylist() for c in licenses.search(index, pa.array(texts))[:7]])
    assert found[0] == found[1] == found[2]


def test_planted_notices_have_the_labels_of_their_licence(documents):
    filler = "so it goes on and on for a while. " * 300
    cases = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "gpl,gpl-2.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
        "A license to the public, under which general work is released": "",
    }
    rows = licenses.scan(documents(*(filler + c + "\n" + filler for c in cases)), licenses.BASE_PHRASES, licenses.TEMPLATES).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == list(cases.values())


def test_licences_of_no_rows_repeated_rows_and_clashing_columns(shared, documents):
    clash = documents("mit license", (None, "mit license"), (0, "mit license")).withColumn("n_words", F.lit("x")).withColumn("places", F.lit(1))
    assert [(r.doc_id, r.labels) for r in licenses.scan(clash, licenses.BASE_PHRASES, []).orderBy("doc_id").collect()] == [(None, "mit"), (0, "mit"), (0, "mit")]
    assert licenses.scan(documents(), licenses.BASE_PHRASES, licenses.TEMPLATES).collect() == []
    assert [r.labels for r in licenses.scan(documents("mit license"), [], []).collect()] == [""]


# ---- hard negatives


def _plain_mine(rows, anchor):
    good = {(i, label, tuple(v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)}
    whole = [(i, label, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, label, v in sorted(good)]
    out = []
    for i, label, v in whole:
        if not anchor(i):
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))  # noqa: E731, B023
        same = sorted(((-score(w), j) for j, other, w in whole if other == label and j != i))[:5]
        for s, j in same:
            near = sorted((-score(w), k) for k, other, w in whole if other != label and 50 * -s <= 100 * score(w) <= 95 * -s)[:3]
            out += [(i, j, rank, k, -s, -n) for rank, (n, k) in enumerate(near, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def _vectors(seed, n=120, d=4):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in rng.integers(-3, 9, d) / 8], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("block", [512, 3])
def test_hard_negatives_equal_a_plain_search(shared, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = _vectors(1)
    rows += [(None, [1.0] * 4, 1), (500, None, 1), (505, [1.0, None, 0.5, 0.5], 0), (510, [float("nan")] * 4, 0), (515, [float("inf"), 0.0, 0.0, 0.0], 0), (520, [0.5] * 4, None)]
    rows += rows[:5] + [(0, [0.25] * 4, 2), (525, [], 1), (530, [0.5], 1), (535, [0.0] * 4, 0)]
    df = shared.createDataFrame(rows, VECTORS).withColumn("anchor_id", F.lit("x")).withColumn("rank", F.lit(0)).repartition(5)
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _plain_mine(rows, lambda i: i % 5 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_hard_negatives_of_no_rows_one_label_and_no_anchor(shared):
    empty = shared.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, F.col("vec_id") % 5 == 0).collect() == []
    one = shared.createDataFrame([(i, [1.0, 0.5], 1) for i in range(12)], VECTORS)
    assert hard_negatives.mine(one, F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives.mine(shared.createDataFrame(_vectors(2, 20), VECTORS), F.col("vec_id") < 0).collect() == []


def test_scores_are_exact_beyond_doubles():
    v = np.array([[2.0**30, 1.0, -(2.0**29)], [2.0**31, 3.0, 5.0]])
    whole = [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in v] for a in v]
    assert hard_negatives.scores(v, v, 2.0**62).tolist() == whole


# ---- divergence


def _plain_audit(rows, least):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for _, _, ws in mine for w in set(ws))
        kept = sorted((w for w in df if df[w] >= least), key=lambda w: w.encode())
        counts = {s: Counter(w for _, o, ws in mine if o == s for w in ws if df[w] >= least) for s in {d[1] for d in mine}}

        def share(c):
            n = sum(c.values())
            return {w: 1 + 1000000000 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in counts if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if counts[s][w] > 0 and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked if part == "pair" else ranked[:50], 1)]
    return sorted(out)


DOCS = "doc_id long, text string, lang string, source string, value string"


def _texts(seed, n=150):
    rng = random.Random(seed)
    pool = ["a", "The", "straße", "abcdefgh", "abcdefghi", "abcdefghz", "日本語の長い文", "é", "z", "zz", "Ünder", "𐐷x"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = [(" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) + rng.choice([" 12x3", "_", ""]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", "", None, "ß4"])) for _ in range(n)]
    return rows + [(None, "en", "only nulls"), ("", "fr", None), ("rare words here", "fr", "b"), ("x", "la", "alone")] + rows[:10]


@pytest.mark.parametrize("sizes", [(4096, 32, 8 << 20), (7, 2, 50)])
def test_divergence_equals_a_plain_audit(shared, monkeypatch, sizes):
    for name, value in zip(("CHUNK_TERMS", "TILE", "PART_TERMS"), sizes):
        monkeypatch.setattr(divergence, name, value)
    rows = _texts(3)
    df = shared.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], DOCS).repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(df, least=8).collect())
    want = _plain_audit(rows, 8)
    assert got == want and sum(r[2] == "term" for r in want) > 100


def test_divergence_without_rows_and_without_kept_terms(shared):
    assert divergence.audit(shared.createDataFrame([], DOCS)).collect() == []
    few = shared.createDataFrame([(1, "a b", "en", "x", ""), (2, "c", "en", "y", ""), (3, None, None, None, "")], DOCS)
    assert sorted(tuple(r) for r in divergence.audit(few).collect()) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_terms_are_told_apart_beyond_their_first_bytes():
    kept = [b"abcdefgh", b"abcdefgha", b"abcdefghb", b"abc", b"z" * 5000]
    terms = divergence.Terms(pa.array(sorted(kept), pa.binary()), np.arange(5), np.arange(5))
    words = pa.array([b"abc", b"abcd", b"abcdefgh", b"abcdefghb", b"abcdefghc", b"z" * 5000, b"z" * 4999], pa.large_binary())
    assert [sorted(kept)[i] if i >= 0 else None for i in terms.find(words).tolist()] == [b"abc", None, b"abcdefgh", b"abcdefghb", None, b"z" * 5000, None]


def test_shares_are_exact_for_large_counts():
    counts, totals = np.array([0, 10**14, 9 * 10**15 - 5, 7]), np.array([5, 3 * 10**14, 9 * 10**15, 7])
    assert divergence.shares(counts, totals).tolist() == [1 + 10**9 * c // t for c, t in zip(counts.tolist(), totals.tolist())]


def test_intermediate_tables_are_deleted(shared, documents, monkeypatch):
    alive = []
    monkeypatch.setattr(util.Tables, "write", lambda self, df, name, most=None, f=util.Tables.write: alive.append(name) or f(self, df, name, most))
    gone = []
    monkeypatch.setattr(util, "remove", lambda spark, path, f=util.remove: gone.append(path) or f(spark, path))
    divergence.audit(documents("a b", "a c"), least=1).collect()
    assert len(gone) == len(alive) - 2
