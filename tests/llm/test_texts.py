"""Operators on single texts: token counts, byte-level BPE, media columns, toxicity, decontamination."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import byte_bpe, decontaminate, media, token_counts, toxicity
from quillspark.llm.pretokens import full_pattern, is_plain, plain_pattern
from quillspark.llm.words import word_hashes

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = ["a", "'s", "'", "é", " ", "\n", "\t", "  ", "1", "\x1c", "\x85", "ß", "'LL", "'ll", " '", ".", "²", "\xa0", "\x1f", "The", "Ł"]
ODD = ["漢", "😀", "٣", "꟎", "\u2003", "ﬁ", "\u0301", "᠎", "\u0558"]


def texts(pieces, n=40, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 50))) for _ in range(n)]


CASES = [None, "", " ", "\n\n ", "hello world's", "<|endoftext|>", "x <|endoftext|>  y", "a" * 30_000, "word " * 5_000, *texts(PIECES), *texts(PIECES + ODD)]


def test_plain_pattern_is_the_full_one_on_plain_texts():
    for c in range(0x250):
        x = f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}.\n{chr(c)}\n{chr(c)} 's{chr(c)}'ll"
        assert is_plain(x)
        assert plain_pattern().findall(x) == full_pattern(public_tokenizers.PATTERN).findall(x), c
        # the library splits these characters the same way
        assert plain_pattern().findall(x) == [x[a:b] for _, (a, b) in token_counts.tokenizer(JSON).pre_tokenizer.pre_tokenize_str(x)], c


def test_token_counts_equal_the_library(documents):
    library = Tokenizer.from_file(JSON)
    got = {r.doc_id: r for r in token_counts.count_tokens(documents(*CASES), JSON, entries=50).collect()}
    for i, x in enumerate(CASES):
        n = len(library.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 1024)


def test_token_counts_of_an_empty_table(documents):
    assert token_counts.count_tokens(documents(), JSON).count() == 0


def test_all_scripts_go_through_both_tiers():
    library = Tokenizer.from_file(JSON)
    texts_ = ["a — dash, “curly” quotes…", "漢字かな交じり文です。", "Привет, мир! 123", "😀 emoji 👩‍👩‍👧 end", "नमस्ते दुनिया", "x\u2003y\u3000z  \n", *texts(PIECES + ODD, 200, 9)]
    table = token_counts.pack_table(JSON, sorted({p for x in texts_ for p in token_counts.Pretokens(JSON)(x)})[::2])
    count = token_counts.Counts(JSON, token_counts._lengths(JSON, table))
    assert [count(x) for x in texts_] == [len(library.encode(x, add_special_tokens=False).ids) for x in texts_] and count.whole == 0
    assert count("a <|endoftext|> b") == len(library.encode("a <|endoftext|> b", add_special_tokens=False).ids) and count.whole == 1
    assert all("".join(token_counts.Pretokens(JSON)(x)) == x for x in texts_)


def test_token_counts_of_null_keys_repeated_rows_and_clashing_columns(documents):
    df = documents((None, "a b"), (3, "a b"), (3, "a b"), (4, None)).withColumn("n_tokens", F.lit("x"))
    assert sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(df, JSON).collect()), key=str) == [(3, 2), (3, 2), (4, 0), (None, 2)]


def test_frequent_pretokens_are_found_over_many_parts(documents):
    df = documents(*[f"common words {i} x{i}" for i in range(200)]).repartition(7)
    assert {"common", " words"} <= set(token_counts.frequent_pretokens(df, JSON, entries=20))


def test_encoding_equals_tiktoken(documents):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    cases = [*CASES, "ab" * 40_000, "é" * 20_000]
    got = {r.doc_id: r for r in byte_bpe.round_trip(documents(*cases), RANKS).collect()}
    assert byte_bpe.round_trip(documents(), RANKS).collect() == []
    for i, x in enumerate(cases):
        ids = [t for piece in full_pattern(public_tokenizers.PATTERN).findall(x or "") for t in library.encode_ordinary(piece)]
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest() and got[i].lossless


def test_encode_offsets_and_decode_keep_other_columns(documents):
    df = byte_bpe.encode(documents("naïve 漢字 😀!", None, "").withColumn("ids", F.lit("clash")), RANKS, offsets="at")
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "at"]
    rows = byte_bpe.decode(df, RANKS).orderBy("doc_id").collect()
    assert bytes(rows[0].decoded).decode() == rows[0].text and rows[0].at[0] == 0 and len(rows[0].at) == len(rows[0].ids)
    assert [bytes(r.decoded) for r in rows[1:]] == [b"", b""]


def test_split_characters():
    own = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = own.encode("😀")
    assert len(ids) > 1 and own.to_text(own.decode(ids[:1])) == "\ufffd" and own.to_text(own.decode(ids)) == "😀"
    with pytest.raises(UnicodeDecodeError):
        own.to_text(own.decode(ids[:1]), "strict")


def test_media_round_trip(shared, documents):
    cases = [None, "", "a", "b" * 64, "ü" * 40, "x" * 200_000, "a"]
    got = {r.doc_id: r for r in media.store_and_read(shared, documents(*cases, (None, "no id"))).collect()}
    for i, x in enumerate(cases):
        raw = (x or "").encode()
        full = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert r.tail_crc32 == zlib.crc32(full[-64:]) and r.media_bytes == len(full) + 44
        assert r.media_sha256 == hashlib.sha256(media.to_wav(full)).hexdigest()
    assert got[2].feature == got[6].feature and got[None].n_bytes == 5
    assert media.store_and_read(shared, documents()).count() == 0


def test_media_ranges_cover_every_member_once(shared, documents):
    from quillspark.llm.util import new_path

    folder = new_path(shared, "media")
    media.write_members(documents(*[f"text {i} " * (i % 9 * 40) for i in range(300)]).repartition(3), folder)
    whole = media.read_members(shared, folder)
    parts = media.read_members(shared, folder, rangebytes=500, batchbytes=2000)
    assert parts.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
    assert sorted(map(tuple, whole.select("name", "offset").collect())) == sorted(map(tuple, parts.select("name", "offset").collect()))


def test_archives_of_other_attempts_are_not_read(shared, documents):
    from quillspark.llm.util import new_path

    folder = new_path(shared, "media")
    archives = media.write_members(documents("one", "two", "two").repartition(2), folder)
    media.write_members(documents("one", "other"), folder)
    manifest = media.write_manifest(archives, folder)
    assert media.read_members(shared, folder).count() == 5
    assert sorted(r.n_bytes for r in media.features(media.read_members(shared, folder, manifest=manifest)).collect()) == [3, 3, 3]


def test_media_member_is_read_again_after_a_failure(tmp_path):
    import zipfile

    path = tmp_path / f"a{media.SUFFIX}"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("0_1_5.wav", media.to_wav(media.padded(b"hello")))
        member = z.infolist()[0]

    class Broken:
        def seek(self, at):
            raise OSError("gone")

        def close(self):
            pass

    reader = media.MediaReader({"path": str(tmp_path)})
    _, raw = reader.member(str(path), member, Broken())
    assert media.from_wav(raw).startswith(b"hello")
    member.CRC ^= 1
    with pytest.raises(ValueError):
        media.MediaReader({"path": str(tmp_path), "retries": "1"}).member(str(path), member)


BAD = ["fool", "scoundrel", "wretch", "knave"]


def labelled(n=600, seed=5):
    rng = random.Random(seed)
    words = ["river", "stone", "cloud", "walk", "green", "lamp", "door", "seven", "music", "paper"]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(rng.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            lines[rng.randrange(len(lines))] += " you " + rng.choice(BAD)
        rows.append((i, ". ".join(lines) + ".", int(toxic)))
    return rows


def test_toxicity_learns_sentences_from_documents(shared, documents):
    rows = labelled()
    df = documents(*[(i, x) for i, x, _ in rows], (9000, None), (9001, ""), (None, "you fool"))
    labels = shared.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model, spans=True).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    assert (got[9000].score, got[9001].score, got[9000].predicted) == (0.0, 0.0, 0)
    for i, x, y in rows:
        if y and got[i].predicted:
            word = re.search("|".join(BAD), x)
            at = len(x[: word.start()].encode())
            assert any(s.byte <= at + 4 and x.encode()[s.byte : at].count(b".") == 0 for s in got[i].offending)
    kept = toxicity.reject(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}


def test_toxicity_without_labels(shared, documents):
    none = shared.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.judge(documents("a b", None), none).collect()] == [0.0, 0.0]
    one = shared.createDataFrame([(0, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.judge(documents("a b", "c"), one).count() == 2


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(x):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or ""))


def plain_decontamination(docs, items):
    out = {}
    for i, x in docs:
        w, hit, found = words(x), set(), set()
        for k, t in items:
            q = words(t)
            n = min(13, len(q))
            for s in range(len(q) - n + 1) if q else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == q[s : s + n]:
                        hit.update(range(at, at + n))
                        found.add("null" if k is None else str(k))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_equals_plain_search(shared, documents):
    rng = random.Random(8)
    vocabulary = ["a", "b", "Ä", "c3", "dd", "été"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, item(n)) for k, n in enumerate([1, 3, 12, 13, 14, 30, 40, 5, 20])] + [(100, None), (101, " ... "), (None, "zz yy"), (8, item(15))]
    docs = []
    for i in range(60):
        x = " ".join(rng.choice(vocabulary + ["x", "y", "z"]) for _ in range(rng.randint(0, 80)))
        if i % 3 == 0:
            q = rng.choice([t for _, t in items if t])
            x = f"{x} {q.upper()}, {x}"
        docs.append((i, x))
    docs += [(60, None), (61, ""), (62, "zz, YY"), (63, (items[6][1] + " ") * 400)]
    got = decontaminate.decontaminate(documents(*docs), shared.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == plain_decontamination(docs, items)


def test_decontamination_of_empty_tables(shared, documents):
    items = shared.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.decontaminate(documents(), items).count() == 0
    assert [tuple(r) for r in decontaminate.decontaminate(documents("one two"), items.limit(0)).collect()] == [(0, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


def test_search_returns_proximity_matches_beside_exact_ones(shared, documents):
    items = shared.createDataFrame([(1, "fox red"), (2, "ran far"), (3, "far the")], "item_id long, text string")
    docs = documents("the red old fox ran far", "a fox red b red fox", None, "fox", "red")
    blocks, vocabulary = decontaminate.write_windows(items)
    index = decontaminate.write_index(docs.coalesce(1), vocabulary=vocabulary)
    got = {r.doc_id: (r.n_hit, r["items"], {(n["item"], n["at"]) for n in r.near}) for r in decontaminate.search(index, blocks, slack=1).collect()}
    # the places where spans of three words begin that hold both
    assert got == {0: (2, ["2"], {("1", 1), ("2", 4)}), 1: (2, ["1"], {("1", 1), ("1", 4)}), 2: (0, [], set()), 3: (0, [], set()), 4: (0, [], set())}
    exact = decontaminate.search(index, blocks)
    assert exact.columns == ["doc_id", "n_words", "n_hit", "items"] and {r.doc_id: (r.n_hit, r["items"]) for r in exact.collect()} == {k: v[:2] for k, v in got.items()}
    with pytest.raises(ValueError):
        decontaminate.search(index, blocks, slack=decontaminate.GAP)


def test_proximity_and_full_index():
    hashes, counts = decontaminate.terms_of(pa.array(["the red old fox ran far", "fox red", None]))
    index = decontaminate.Segment.build(hashes, counts)
    query = lambda x, **k: [(w, index.document(p).tolist()) for _, w, p in decontaminate.matches(index, (["q"], *(lambda t: (t[1], t[0]))(decontaminate.terms_of(pa.array([x])))), **k)]
    assert query("red fox") == [] and query("red old fox") == [(3, [0])]
    assert query("fox red", slack=1) == [(2, [0, 1])] and query("ran fox the", slack=0) == []


def test_proximity_equals_a_plain_search():
    rng = random.Random(12)
    for _ in range(60):
        texts_ = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(30))) for _ in range(4)]
        window, slack = [rng.choice("abcdefg" if rng.random() < 0.1 else "abcdef") for _ in range(rng.randrange(1, 6))], rng.randrange(4)
        hashes, counts = decontaminate.terms_of(pa.array(texts_))
        index = decontaminate.Segment.build(hashes, counts)
        begin, end = index.find(decontaminate.terms_of(pa.array([" ".join(window)]))[0])
        want = []
        for d, x in enumerate(texts_):
            ws = x.split()
            for i, w in enumerate(ws):
                span = ws[i : i + len(window) + slack]
                if w in window and all(span.count(t) >= window.count(t) for t in window):
                    want.append(int(index.first[d]) + i)
        assert index.near(begin, end, slack).tolist() == want, (texts_, window, slack)


def plain_features(text):
    """For each sentence with words: its features, and where each of them begins."""
    out = []
    for part in re.split(b"[\n!.?]", text.encode()):
        words_ = [w.lower() for w in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", part)]
        out.append([f for w in words_ for f in [(0, w)] + [(i, w[:k]) for i, k in enumerate(toxicity.PREFIXES, 1) if len(w) > k]])
    return [s for s in out if s]


def feature_hash(feature):
    kind, raw = feature
    buffer = np.frombuffer(raw, np.uint8)
    return int(word_hashes(buffer, np.array([0]), np.array([len(raw)]))[0]) ^ kind


def test_toxicity_equals_a_plain_noisy_or(shared, documents):
    rows = labelled(300, 8) + [(1000 + i, x, y) for i, (_, x, y) in enumerate(labelled(40, 9))]
    df = documents(*[(i, x) for i, x, _ in rows], *[(7, "zzz repeated row")] * 5)
    labels = shared.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    learnt = [(x, y) for i, x, y in rows if zlib.crc32(str(i).encode()) % 5]
    n, positive = len(learnt), sum(y for _, y in learnt)
    seen, toxic = Counter(), Counter()
    for x, y in learnt:
        own = {f for s in plain_features(x) for f in s}
        seen.update(own)
        toxic.update(own if y else ())
    evidence = set()
    for f, a in toxic.items():
        b, c = seen[f] - a, positive - a
        d = n - positive - b
        lead = a * d - b * c
        if a >= toxicity.LEAST_TEXTS and lead > 0 and (c + d == 0 or n * lead * lead / (seen[f] * (c + d) * (a + c) * (b + d)) >= toxicity.LEAST_CHI2):
            evidence.add(feature_hash(f))
    assert set(model.words.tolist()) == evidence and len(evidence) > 5
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    got = {r.doc_id: r.score for r in toxicity.score(df.where("doc_id <> 7"), model).collect()}
    for i, x, _ in rows:
        clean = 1.0
        for sentence in plain_features(x):
            own = [weight[h] for h in map(feature_hash, sentence) if h in weight]
            clean *= 1 - 1 / (1 + np.exp(-(sum(own) + model.bias))) if own else 1
        assert i == 7 or abs(got[i] - (1 - clean)) < 1e-9


def test_repeated_keys_leave_the_sample_bounded(shared, documents, monkeypatch):
    df = documents(*[(i % 3, f"text {i} you fool") for i in range(400)])
    labels = shared.createDataFrame([(i, 1, i % 2) for i in range(3)], "doc_id long, quality int, toxic int")
    sizes, write = [], toxicity.Tables.write
    monkeypatch.setattr(toxicity.Tables, "write", lambda self, df, name, most=None: (out := write(self, df, name, most), sizes.append((name, out._rows_written)))[0])
    toxicity.train(df, labels, rows=2)
    assert dict(sizes)["sample"] <= 2
    assert toxicity.judge(documents(), labels).collect() == []


def test_media_of_an_empty_table(shared, documents):
    assert media.store_and_read(shared, documents()).collect() == []
