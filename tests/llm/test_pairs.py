"""Operators on relations between rows: the Jaccard join, WARC, wrappers, URL filters, quotations, and the pipeline."""

import hashlib
import html
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import prefix_join, quotations, url_filters, warc, wrappers
from quillspark.llm.html_tree import parse
from quillspark.llm.prefix_join import PrefixTree, ordered, prefix_length, similar
from quillspark.llm.util import Tables, components, new_path


def shingles(x):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [t for t in w if t]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_join(docs):
    sets = [shingles(x) for _, x in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i), k)) for i, ((k, _), s) in enumerate(zip(docs, sets))), key=repr)


def mutated(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"m{rng.randrange(10**6)}"
    return out


def near_copies(seed=1, groups=12, size=8, words=60):
    rng = random.Random(seed)
    docs = []
    passage = [f"p{i}" for i in range(20)]
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(8, words))] + (passage if g % 2 else [])
        for _ in range(size):
            x = mutated(rng, base, rng.choice([0, 0, 1, 1, 2, 3]))
            if rng.random() < 0.3:
                x += [f"t{rng.randrange(1000)}" for _ in range(rng.randint(1, 15))]
            docs.append(" ".join(x))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_join_equals_all_pairs(documents):
    docs = near_copies()
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE  two"), (1005, "two one"), (None, docs[0][1]), (None, "no id at all here"), (5, docs[5][1]), (1006, "long " * 3000)]
    got = prefix_join.join(documents(*docs).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_join(docs)


def test_join_of_many_near_copies(documents, monkeypatch):
    """A chain of copies, in lists that are led in parts, with few candidates at a time."""
    monkeypatch.setattr(prefix_join, "FEW", 1)
    monkeypatch.setattr(prefix_join, "TREE_SETS", 8)
    rng = random.Random(4)
    now, docs = [f"w{i}" for i in range(80)], []
    for i in range(70):
        docs.append((i, " ".join(now)))
        now = mutated(rng, now, 1)
    docs += [(100 + i, " ".join(mutated(rng, [f"w{j}" for j in range(80)], 4))) for i in range(40)]
    got = prefix_join.join(documents(*docs)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_join(docs)


def test_join_of_an_empty_table(documents):
    assert prefix_join.join(documents()).count() == 0


def test_tree_search_with_whole_sets_is_exact():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate((rng.permutation(base)[: rng.integers(30, 60)], rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64)))) for _ in range(80)]
    tree = PrefixTree()
    for i, s in enumerate(sets):
        tree.insert(s, len(s), i)
    for i, s in enumerate(sets):
        want = {j for j, t in enumerate(sets) if similar(len(np.intersect1d(s, t)), len(s), len(t))}
        assert {j for j, _ in tree.search(s, len(s))} == want


def test_tree_search_with_prefixes_misses_nothing():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    late = np.sort(base[::7])
    sets = [np.unique(np.concatenate((rng.permutation(base)[: rng.integers(150, len(base))], rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64)))) for _ in range(60)]
    short = [(ordered(s, late)[: prefix_length(len(s))] >> np.uint64(32)).astype(np.uint32) for s in sets]
    tree = PrefixTree()
    for i, s in enumerate(sets):
        tree.insert(short[i], len(s), i)
    for i, s in enumerate(sets):
        want = {j for j, t in enumerate(sets) if similar(len(np.intersect1d(s, t)), len(s), len(t))}
        assert want <= {j for j, _ in tree.search(short[i], len(s))}


def test_members_of_a_list_are_compared_at_once(monkeypatch):
    rng, calls, exact = np.random.default_rng(5), [], prefix_join.most_common
    monkeypatch.setattr(prefix_join, "most_common", lambda a, b: calls.append(1) or exact(a, b))
    base = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    sets = [np.unique(rng.integers(0, 1 << 63, int(rng.integers(3, 400)), dtype=np.uint64)) for _ in range(1500)]
    sets += [np.unique(np.concatenate((base[k:], sets[k][:k]))) for k in range(0, 100, 5)]
    held, groups, before = prefix_join.ListMembers(), [k % 7 for k in range(len(sets))], [x[: len(x) // 20] if k % 3 else x[:0] for k, x in enumerate(sets)]
    shorts = [prefix_join.counted(prefix_join.shortened(x)) for x in sets]
    for k, x in enumerate(sets):
        held.add(before[k], len(x), k, groups[k], shorts[k])
    found = 0
    for k in (*range(0, 60), *range(1500, len(sets))):
        x, ahead = sets[k], before[k]
        got = set(held.search(ahead, len(x), groups[k], shorts[k]))
        # all that are similar and share nothing before the list's element, and nothing that shares there or is of the same group
        apart = {j for j, y in enumerate(sets) if groups[j] != groups[k] and not np.isin(before[j], ahead).any()}
        fits = {j for j in apart if prefix_join.similar(min(len(sets[j]) - len(before[j]), len(x) - len(ahead)), len(x), len(sets[j]))}
        assert {j for j in fits if prefix_join.similar(len(np.intersect1d(x, sets[j])), len(x), len(sets[j]))} <= got <= fits
        found += len(got)
    assert found > 50 and len(calls) < 80 * len(sets) // 20
    assert prefix_join.coarse(np.full(1 << 21, 15, np.uint8)).tolist() == [15 << 14] * 128


def test_shortened_sets_never_count_too_little():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate((rng.permutation(a)[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64))))
        x, y = (prefix_join.counted(prefix_join.shortened(s)) for s in (a, b))
        assert len(np.intersect1d(a, b)) <= prefix_join.most_common(x, y) <= min(len(a), len(b))
    dense = np.arange(1000, dtype=np.uint64)  # all in one pattern until there are very many
    assert prefix_join.similar(1, 1, 1) and prefix_join.counted(prefix_join.shortened(dense[:16] << np.uint64(50))).sum() == 16


def test_components_of_paths_and_stars(shared):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300)]
    got = {r.node: r.root for r in components(Tables(shared), shared.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(30)}, 200: 200, 300: 300, 301: 300}


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(shared):
    long = "<p>" + "x" * 300_000 + "</p>"
    rows = [(5, "http://a/1", "y" * 120), (3, "http://b/ü \n2", "y" * 120), (9, None, "y" * 120), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long), (3, "u", "y" * 120), (None, "u", "y" * 120), (None, "u", "z" * 130)]
    pages = shared.createDataFrame(rows, PAGES)
    got = warc.archive(shared, pages.repartition(3)).collect()
    want = []
    for i, _, x in rows:
        raw = (x or "").encode()
        first = min((k for k, _, y in rows if y == x and k is not None), default=None)
        revisit = len(raw) >= 100 and first is not None and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert warc.archive(shared, pages.limit(0)).count() == 0


def test_warc_has_one_result_on_any_size(shared, monkeypatch):
    rows = [(5, "u", "y" * 120), (3, "u", "y" * 120), (None, "u", "y" * 120), (None, "u", "z" * 130), (None, "u", "z" * 130)]
    pages = shared.createDataFrame(rows, PAGES)
    few = sorted(map(tuple, warc.archive(shared, pages).collect()), key=repr)
    monkeypatch.setattr(warc, "sized", lambda df: df)
    assert sorted(map(tuple, warc.archive(shared, pages).collect()), key=repr) == few
    assert sorted((r[0] is None, r[3], r[4]) for r in few if r[4] is not None) == [(False, "revisit", 3), (True, "revisit", 3)]


def test_warc_form_and_random_access(shared):
    pages = shared.createDataFrame([(i, f"http://h/{i}", f"<p>page {i} of a series of pages</p>" * 9) for i in range(400)], PAGES)
    index = warc.write_archives(pages.coalesce(1), new_path(shared, "warc")).orderBy("offset").collect()
    raw = open(index[0].path.removeprefix("file://"), "rb").read()
    assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE and index[0].offset == 8 + int.from_bytes(raw[4:8], "little")
    assert len(raw) < 400 * 250
    fields, payload = warc.parse(warc.read_record(index[7].path, index[7].offset, index[7].size))
    assert fields["warc-type"] == "response" and payload.startswith(b"<p>page ")
    damaged = index[0].path + ".cut"
    open(damaged.removeprefix("file://"), "wb").write(raw[:-5])
    with pytest.raises(Exception):
        list(warc.read_records(damaged))


FRAME = '<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">menu {i}</a></li></ul></nav><div class="intro">Welcome to our site</div><div class="ad">buy {i}</div>{main}<div class="comments"><p>first! {i}</p></div><form><input>send</form><footer>&copy; {i}</footer></body></html>'


def test_main_text_of_articles():
    page = FRAME.replace("{i}", "7").replace("{main}", "<article><h1>Head &amp; shoulders</h1><p><b>One<br>two <p>three  \n four&nbsp;!<ul><li>item<li>next</ul><aside>no</aside></article>")
    assert wrappers.main_text(page) == "Head & shoulders\nOne two\nthree four !\nitem\nnext"
    assert [wrappers.main_text(x) for x in (None, "", "<", "plain &lt;text", "<p>cut &am", "<p>cut <b", "<article>open <p>par")] == ["", "", "<", "plain <text", "cut &am", "cut", "open\npar"]
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    assert wrappers.main_text(deep) == "core"


def test_deep_pages_keep_what_follows():
    deep = "<div><article>first" + "<div>" * 260 + "deep<p>open" + "</div>" * 260 + "<p>second after</p></article>x</div>"
    assert wrappers.main_text(deep) == "first\ndeep\nopen\nsecond after"


def test_classes_are_whole_and_never_judge_the_page_or_its_article():
    for x in ('<body class="no-sidebar {}"><p>text</p></body>', '<article class="post has-comments {}">text</article>', '<main id="{}" role="banner">text</main>', '<html class="{}"><body id={}>text', '<div class="post-comments">text</div>', '<div id="share-price">text</div>'):
        assert wrappers.main_text(x.replace("{}", "modal" if "div" not in x else "")) == "text", x
    for x in ('class="box ad"', 'id="sidebar"', 'class=x role="navigation"', 'id="comments" class="y"'):
        assert wrappers.main_text(f"<body><div {x}>menu</div><p>text</p></body>") == "text", x


def test_wrapper_finds_constant_nodes_of_a_host(shared):
    rows = [(i, f"http://Host.example/{i}", FRAME.replace("{i}", str(i)).replace("{main}", f"<div><h2>About {i}</h2><p>Text {i}</p><p>More {i * i}</p></div>")) for i in range(12)]
    rows += [(100, "http://other.example/", "<div class='intro'>Welcome to our site</div><p>Only page</p>"), (101, None, None), (102, "no host", "<p>x &amp; y</p>")]
    # copies of one article on a host: nothing varies, so nothing is template
    rows += [(200 + i, "http://copies.example/", "<body><h1>Same</h1><p>text</p></body>") for i in range(10)]
    got = {r.page_id: r for r in wrappers.extract(shared.createDataFrame(rows, PAGES).repartition(5)).collect()}
    for i in range(12):
        assert got[i].text == f"About {i}\nText {i}\nMore {i * i}" and got[i].n_chars == len(got[i].text) and got[i].url == f"http://Host.example/{i}"
    assert got[100].text == "Welcome to our site\nOnly page" and got[101].text == "" and got[102].text == "x & y"
    assert all(got[200 + i].text == "Same\ntext" for i in range(10))
    assert wrappers.extract(shared.createDataFrame([], PAGES)).count() == 0


SLOTS = "<body><div class=top><a href=/x>menu {0}</a> <a href=/y>more {0}</a></div><h1>Title {0}</h1><div class=box><p>{1}</p><h2>Part {0}</h2><p>{1} again</p></div><div class=low>short line {0}</div></body>"


def test_content_slot_needs_no_names(shared):
    """Everything varies, and no tag or class tells what is what: the wrapper leaves out what is links beside the slot, and keeps the rest."""
    text = lambda i: " ".join(f"word{i}x{j}" for j in range(60))
    rows = [(i, "http://slots.example/", SLOTS.format(i, text(i))) for i in range(24)]
    want = {i: f"Title {i}\n{text(i)}\nPart {i}\n{text(i)} again\nshort line {i}" for i in range(24)}
    for parts in (1, 7):
        got = wrappers.extract(shared.createDataFrame(rows, PAGES).repartition(parts)).collect()
        assert {r.page_id: r.text for r in got} == want
    assert wrappers.main_text(rows[3][2]) == f"menu 3 more 3\n{want[3]}"


def test_texts_that_come_back_are_template():
    page = lambda i: f"<body><div><p>text {i}</p><ul><li>offer {i % 3}</li></ul></div></body>"
    whole = None
    for i in range(40):
        one = wrappers.bare(wrappers.collapsed([parse(page(i))]))
        whole = wrappers.merged(whole, one) if whole else one
    assert wrappers.main_text(page(7), wrappers.template(whole)) == "text 7"


def induced(pages):
    whole = None
    for page in pages:
        one = wrappers.bare(wrappers.collapsed([parse(page)]))
        whole = wrappers.merged(whole, one) if whole else one
    return wrappers.template(wrappers.possible(whole, len(pages)))


FILL = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(400)]


def test_nothing_beside_the_largest_part_of_an_article_is_lost():
    long = lambda i: "".join(f"<p>{FILL[i]} {j}</p>" for j in range(5))
    cases = [
        "<{0}><h1>T {1}</h1><p class=lead>lead {1}</p><div class=body>" + "{2}</div><p>closing {1}</p></{0}>",
        "<{0}><h1>T {1}</h1><p>intro {1}</p>" + "<section>{2}</section>" * 4 + "</{0}>",
        "<{0}><h1>T {1}</h1><table><tr><td>data {1}</td></tr></table><div>{2}</div></{0}>",
        "<{0}><h1>T {1}</h1><h2>Ingredients</h2>{2}<h2>Method</h2><p>do {1}</p></{0}>",
    ]
    for box in ("article", "main", "div"):
        for case in cases:
            body = [case.format(box, i, long(i)) for i in range(20)]
            pages = [f"<body><div class=x><a href=/>Home</a> <a href=/a>About</a></div><div>same notice</div>{b}<div>same footer</div></body>" for b in body]
            wrapper = induced(pages)
            for page, b in zip(pages, body):
                assert wrappers.main_text(page, wrapper) == "\n".join(t for t in re.sub("<[^>]*>", "\n", b).split("\n") if t.strip()), (box, case)


def test_ids_of_their_own_dont_keep_pages_apart():
    for mark in ("id='post-{0}' class='post-{0} hentry'", "id=a-title-of-page-{1}", "class='p{0}'"):
        page = lambda i: f"<body><div {mark.format(i, 'abcdefghijklmnopqrst'[i])}><div class=side><p>About us</p></div><h1>T {i}</h1><p>{FILL[i]}</p></div></body>"  # noqa: E731, B023
        pages = [page(i) for i in range(20)]
        assert {wrappers.main_text(p, induced(pages)) for p in pages} == {f"T {i}\n{FILL[i]}" for i in range(20)}, mark


def test_random_sites_give_back_their_articles():
    """Sites of constant menus, notices and footers around articles of random blocks, whatever holds these."""
    for seed in range(30):
        rng = random.Random(seed)
        box, close = rng.choice([("<article>", "</article>"), ("<main class=m>", "</main>"), ("<div class='post-{i} entry'>", "</div>"), ("<div id=content><div>", "</div></div>")])
        before = "".join(rng.sample(["<div class=top><a href=/>Home</a><a href=/n>News {i}</a></div>", "<p>Constant claim</p>", "<div><span>Our notice</span></div>", "<ul><li><a href=/{i}>x{i}</a></li><li><a href=/>y</a></li></ul>"], rng.randrange(4)))
        after = "".join(rng.sample(["<div>Constant end</div>", "<p>Imprint</p>", "<div class=low><a href=/p>Page {i}</a></div>"], rng.randrange(3)))
        pages, want = [], []
        for i in range(20):
            blocks = [f"title {seed} {i}"] + [f"{rng.choice(FILL)} {i} {k}" for k in range(rng.randrange(1, 6))]
            tags = ["h1"] + [rng.choice(["p", "p", "p", "blockquote", "h2", "pre"]) for _ in blocks[1:]]
            inner = "".join(f"<{t}>{b}</{t}>" for t, b in zip(tags, blocks))
            pages.append(f"<html><body>{before.replace('{i}', str(i))}{box.replace('{i}', str(i))}{inner}{close}{after.replace('{i}', str(i))}</body></html>")
            want.append("\n".join(blocks))
        wrapper = induced(pages)
        assert [wrappers.main_text(p, wrapper) for p in pages] == want, seed


def test_thousands_of_unlike_siblings_are_matched_at_once(monkeypatch):
    names = ["".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(9000)]
    tree = lambda a, b: wrappers.bare(wrappers.collapsed([parse("".join(f"<p>a</p><h2>b</h2><h3 class={names[i]}>c</h3>" for i in range(a, b)))]))
    began = time.perf_counter()
    both = wrappers.merged(tree(0, 1700), tree(1000, 2700))
    assert time.perf_counter() - began < 6
    assert sum(k[2] == 2 for k in both[3]) == 3400  # all p and h2, for which no h3 of both is left in order
    x, y = tree(0, 40)[3], tree(20, 70)[3]
    whole = wrappers.matching(["", (0,), 1, x, None, 0, 0], ["", (0,), 1, y, None, 0, 0])
    monkeypatch.setattr(wrappers, "TABLE_CELLS", 50)
    pairs = [(p, q) for p, q in wrappers.aligned(x, y) if p and q]
    assert 1 + sum(wrappers.matching(p, q) for p, q in pairs) == whole


def plain_matching(a, b):
    if a[0] != b[0]:
        return 0
    x, y = a[3], b[3]
    best = {(i, j): 0 for i in range(len(x) + 1) for j in range(len(y) + 1)}
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + plain_matching(x[i - 1], y[j - 1]))
    return 1 + best[len(x), len(y)]


def test_matching_equals_plain_simple_tree_matching():
    rng = random.Random(8)
    tree = lambda depth: [rng.choice("ab"), (0,), 1, [tree(depth - 1) for _ in range(rng.randrange(5) if depth else 0)], None, 0]
    for _ in range(300):
        a, b = tree(3), tree(3)
        a[0] = b[0]
        assert wrappers.matching(a, b) == plain_matching(a, b)
        pairs = [(p, q) for p, q in wrappers.aligned(a[3], b[3]) if p and q]
        assert 1 + sum(wrappers.matching(p, q) for p, q in pairs) == wrappers.matching(a, b)


def test_pages_of_many_siblings_align_without_a_table():
    tree = lambda n: wrappers.bare(wrappers.collapsed([parse("<p>a</p><h2>b</h2>" * n)]))
    assert len(wrappers.merged(tree(10_000), tree(9_000))[3]) == 20_000


def test_large_wrappers_keep_their_template(shared):
    page = lambda i: "<body><div>Constant notice</div>" + "".join(f"<p class={'ab'[j % 2]}>text {i} {j}</p>" for j in range(2200))
    rows = [(i, "http://wide.example/", page(i)) for i in range(10)]
    got = wrappers.extract(shared.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert len(got) == 10 and all(r.text == "\n".join(f"text {r.page_id} {j}" for j in range(2200)) for r in got)


def test_copies_of_an_article_are_one_witness(shared):
    copy = "<body><nav>menu {}</nav><article><h1>Copied</h1><h2>Part</h2><p>same</p></article></body>"
    rows = [(i, "http://hot.example/", copy.format(i)) for i in range(12)]
    rows += [(i, "http://hot.example/", f"<body><article><h1>Title {i}</h1><p>text {i}</p></article></body>") for i in range(12, 20)]
    # copies don't make up a host's pages either: 8 of 9 different ones hold the notice
    rows += [(100 + i, "http://many.example/", "<body><p>only text</p></body>") for i in range(30)]
    rows += [(200 + i, "http://many.example/", f"<body><div>notice</div><p>text {i}</p></body>") for i in range(8)]
    # seven different pages are too few
    rows += [(300 + i, "http://small.example/", f"<body><div>notice</div><p>text {i % 7}</p></body>") for i in range(21)]
    got = {r.page_id: r.text for r in wrappers.extract(shared.createDataFrame(rows, PAGES).repartition(5)).collect()}
    assert all(got[i] == "Copied\nPart\nsame" for i in range(12)) and all(got[i] == f"Title {i}\ntext {i}" for i in range(12, 20))
    assert all(got[200 + i] == f"text {i}" for i in range(8)) and got[100] == "only text"
    assert all(got[300 + i] == f"notice\ntext {i % 7}" for i in range(21))


def test_only_nodes_that_are_ruled_out_are_cut():
    tree = lambda i: wrappers.bare(wrappers.collapsed([parse(f"<h1>same</h1><p class=x{chr(97 + i)}>a</p>" + ("<b>late</b>" if i > 9 else ""))]))
    whole = cut = None
    for i in range(20):
        whole = wrappers.merged(whole, tree(i)) if whole else tree(i)
        cut = wrappers.possible(wrappers.merged(cut, tree(i)) if cut else tree(i), 20)
    signs = lambda w: {(n[0], n[2]) for n in wrappers.nodes(w)}
    assert signs(cut) == {("", 20), ("h1", 20), ("b", 10)} == {x for x in signs(whole) if x[1] >= 10}


def test_simple_tree_matching():
    tree = lambda x: wrappers.bare(wrappers.collapsed([parse(x)]))
    a, b = tree("<div><h1>a</h1><p>x</p><span>s</span></div>"), tree("<div><h1>a</h1><ul><li>l</li></ul><p>y</p></div>")
    assert wrappers.matching(a, b) == 4
    both = wrappers.merged(a, b)
    assert [k[0] for k in both[3][0][3]] in (["h1", "ul", "p", "span"], ["h1", "p", "ul", "span"], ["h1", "ul", "p", "span"])


RULES = [url_filters.Rule("block", "com", "/en/"), url_filters.Rule("allow", "example.com", "/en/7"), url_filters.Rule("allow", "net", "/de/"), url_filters.Rule("block", "example.net", "/de/8")]


def judged(shared, rows):
    return {r.page_id: r for r in url_filters.judge(shared.createDataFrame(rows, PAGES), RULES).collect()}


def test_rules_and_parts_of_urls(shared):
    rows = [
        (1, "HTTP://A.Example.COM/en/71?x#y", None), (2, "http://example.com/en/8", ""), (3, "http://notexample.com/en/7", ""), (4, "x://b.example.net/de/81", ""), (5, "x://b.net/de/81", ""),
        (6, None, None), (7, "nothing", ""), (8, "http://q.org?a://b/c", ""), (9, "http://com/en/", ""), (10, "http://xcom/en/", ""), (None, "http://net/de/", None),
    ]
    got = judged(shared, rows)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 3, 4, 5, 9, None)] == [
        ("a.example.com", "/en/71", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("notexample.com", "/en/7", "com/en/", "block"),
        ("b.example.net", "/de/81", "example.net/de/8", "block"), ("b.net", "/de/81", "net/de/", "allow"), ("com", "/en/", "com/en/", "block"), ("net", "/de/", "net/de/", "allow"),
    ]
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (6, 7, 8, 10)] == [("", "", None, "allow"), ("", "", None, "allow"), ("q.org", "", None, "allow"), ("xcom", "/en/", None, "allow")]
    assert url_filters.judge(shared.createDataFrame([], PAGES), RULES).count() == 0


def plain_rank(edges, seeds, damping=0.85, steps=200):
    hosts = {h for e in edges for h in e[:2]} | set(seeds)
    total = sum(seeds.values())
    start = {h: seeds.get(h, 0) / total for h in hosts}
    out = {}
    for a, _, w in edges:
        out[a] = out.get(a, 0) + w
    x = dict(start)
    for _ in range(steps):
        flow = {h: 0.0 for h in hosts}
        for a, b, w in edges:
            flow[b] += x[a] * w / out[a]
        back = 1 - damping * sum(flow.values())
        x = {h: start[h] * back + damping * flow[h] for h in hosts}
    return x


def test_rank_goes_on_until_it_converges(shared):
    edges, seeds = [("a", "b", 1.0), ("b", "a", 1.0)], [("a", 1.0)]
    got = url_filters.rank(Tables(shared), shared.createDataFrame(edges, "src string, dst string, w double"), shared.createDataFrame(seeds, "host string, mass double"), tolerance=1e-4)
    got = {r.host: r.score for r in got.collect()}
    assert abs(got["a"] - 1 / 1.85) + abs(got["b"] - 0.85 / 1.85) < 1e-4  # after 50 steps still 2.7e-4


def test_rank_reaches_every_host_that_seeds_lead_to(shared):
    edges, seeds = [(f"h{i:03d}", f"h{(i + 1) % 12:03d}", 1.0) for i in range(12)], [("h000", 1.0)]
    got = url_filters.rank(Tables(shared), shared.createDataFrame(edges, "src string, dst string, w double"), shared.createDataFrame(seeds, "host string, mass double"), damping=0.2, tolerance=1e-2)
    got = {r.host: r.score for r in got.collect()}  # the tolerance alone is met after four steps
    want = plain_rank(edges, dict(seeds), damping=0.2)
    assert set(got) == set(want) and all(x > 0 and abs(x - want[h]) < 1e-2 for h, x in got.items())


def test_rank_equals_power_iteration(shared):
    rng = random.Random(2)
    edges = [(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}", float(rng.randint(1, 3))) for _ in range(40)]
    edges = [(a, b, w) for (a, b), w in {(a, b): w for a, b, w in edges if a != b}.items()]
    seeds = {"h1": 3.0, "h4": 1.0, "alone": 2.0}
    got = url_filters.rank(Tables(shared), shared.createDataFrame(edges, "src string, dst string, w double"), shared.createDataFrame(list(seeds.items()), "host string, mass double"), tolerance=1e-9)
    want = plain_rank(edges, seeds)
    scores = {r.host: r.score for r in got.collect()}
    assert all(abs(scores.get(h, 0.0) - x) < 1e-6 for h, x in want.items())


def test_distrust_reaches_hosts_that_link_to_blocked_ones(shared):
    link = lambda *to: "".join(f'<a class="x" href="http://{t}/p">l</a>' for t in to)
    rows = [
        (1, "http://bad.com/en/", link("bad2.org")), (2, "http://farm.org/", link("bad.com", "bad.com")), (3, "http://good.net/de/", link("friend.org") + '<a href="/own">o</a><a href=//Pal.org>p</a>'),
        (4, "http://friend.org/", ""), (5, "http://pal.org/", ""), (6, "http://alone.org/", None),
    ]
    got = judged(shared, rows)
    assert {i: got[i].verdict for i in got} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}
    assert got[2].distrust > 0 and got[4].trust > 0 and got[5].trust > 0 and got[6].trust == got[6].distrust == 0


def test_links_are_read_as_browsers_do(shared):
    cases = {
        '<a data-href="http://bad.com/x" href="/own">': [], '<a title="a>b" href="http://one.com/p">': ["one.com"], "<!-- <a href='http://bad.com/'> --><a\nclass=x href='//Two.org'>": ["two.org"],
        "<script>'<a href=http://bad.com/>'</script><a href=http://three.com/x?y>": ["three.com"], '<a title="href=http://bad.com/" href = "https://four.com">': ["four.com"],
        '<A ID="x"HREF="http://five.com/"><abbr href="http://bad.com/">': ["five.com"], "<style><a href=http://bad.com></style><a/href=http://six.com>": ["six.com"], "<a href='mailto:x@bad.com'><a href=''><a href>": [],
        "<a " + "x=1 " * 900 + "href=http://seven.com>": ["seven.com"], "<!-- open <a href=http://bad.com>": [], "<a title='\"' href=\"http://eight.com/'\">": ["eight.com"], None: [],
    }
    df = shared.createDataFrame([(f"http://h{i}.net/", x) for i, x in enumerate(cases)], "url string, html string")
    got = {r.src: r.dst for r in url_filters.host_edges(df).collect()}
    assert got == {f"h{i}.net": to[0] for i, to in enumerate(cases.values()) if to}
    plan = url_filters.host_edges(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_verdicts_equal_a_plain_version_and_tables_go(shared, monkeypatch):
    rng = random.Random(6)
    hosts = [f"h{i}.{'com' if i % 3 else 'net'}" for i in range(14)] + ["lonely.org"]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['en/', 'de/', 'x'])}{i}", "".join(f'<a href="//{rng.choice(hosts[:14])}/">' for _ in range(rng.randrange(4)))) for i in range(60)]
    rules = [url_filters.Rule("block", "com", "/en/"), url_filters.Rule("allow", "net", "/de/")]
    most, write = [], Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, df, name, n=None: (most.append(len(self.paths) + 1), write(self, df, name, n))[1] if name in ("seeds", "outgoing", "shares", "flow") else write(self, df, name, n))
    got = {r.page_id: r for r in url_filters.judge(shared.createDataFrame(rows, PAGES), rules).collect()}
    assert max(most) <= 4
    host = lambda url: url.split("/")[2]
    ruled = {i: "block" if host(u).endswith(".com") and "/en/" in u else "allow" if host(u).endswith(".net") and "/de/" in u else None for i, u, _ in rows}
    links = {}
    for _, u, page in rows:
        for to in re.findall("//([^/]+)/", page):
            if to != host(u):
                links[host(u), to] = links.get((host(u), to), 0.0) + 1
    seeds = {v: {} for v in ("allow", "block")}
    for i, u, _ in rows:
        if ruled[i]:
            seeds[ruled[i]][host(u)] = seeds[ruled[i]].get(host(u), 0.0) + 1
    trust = plain_rank([(a, b, w) for (a, b), w in links.items()], seeds["allow"])
    distrust = plain_rank([(b, a, w) for (a, b), w in links.items()], seeds["block"])
    for i, u, _ in rows:
        t, d = trust.get(host(u), 0.0), distrust.get(host(u), 0.0)
        assert abs(got[i].trust - t) < 1e-5 and abs(got[i].distrust - d) < 1e-5
        assert got[i].verdict == (ruled[i] or ("block" if d > t else "allow")), (u, t, d)


TURNS = "conv_id long, turn long, role string, text string"


def test_quotations(shared):
    rows = [
        (1, 0, "user", "The red fox runs. The blue bird sings.\nAnd more."),
        (1, 1, "assistant", "> the RED fox runs!\nIndeed it does. So fast."),
        (1, 2, "user", "A new idea here."),
        (1, 3, "assistant", "Bob wrote:\n>> The red fox runs.\n> Indeed it does.\n\nI agree with both."),
        (1, 4, "user", "> a new idea here\nWhich idea?"),
        (1, 5, "user", "> said by nobody\nHm."),
        (2, 0, "user", "> The red fox runs.\nOther talk."),
        (3, None, None, None), (None, 0, "user", "x"), (None, 1, "user", "> x\ny"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotations.link(shared.createDataFrame(rows, TURNS)).collect()}
    assert [got[1, t].parent_turn for t in range(6)] == [None, 0, 1, 1, 2, 4]
    assert [got[1, t].own_text for t in (1, 3, 4)] == ["Indeed it does. So fast.", "I agree with both.", "Which idea?"]
    assert [(got[1, t].n_passages, got[1, t].n_linked, got[1, t].max_level) for t in (0, 1, 3, 5)] == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (1, 0, 1)]
    # every message after the one it replies to; a branch after what the branch before it leads to
    assert [got[1, t].position for t in range(6)] == [0, 1, 2, 5, 3, 4]
    assert (got[2, 0].parent_turn, got[2, 0].n_linked) == (None, 0)
    assert (got[3, None].own_text, got[3, None].parent_turn) == ("", None)
    assert (got[None, 1].parent_turn, got[None, 1].own_text) == (0, "y")


def test_quotations_without_quotes_or_rows(shared):
    rows = [(1, i, "user", f"message {i}") for i in range(30)] + [(1, 7, "user", "message 7")]
    got = quotations.link(shared.createDataFrame(rows, TURNS)).orderBy("position").collect()
    assert [r.position for r in got] == list(range(31)) and [r.turn for r in got] == sorted(r[1] for r in rows)
    assert quotations.link(shared.createDataFrame([], TURNS)).count() == 0


def plain_link(rows):
    """Rows (turn, own_text, n_passages, n_linked, max_level, parent_turn, position) of one conversation, in order of turns."""
    marks, intro = re.compile(r"^[ \t]*((?:>[ \t]?)*)"), re.compile(r"\n?[^\n]*(wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$", re.I)
    split = lambda t: list(dict.fromkeys(x for p in re.split(r"(?<=[.!?])\s+|\n\s*\n", t.lower()) if (x := re.sub(r"[^\w]+|_+", " ", p).strip())))
    said, out = [], []
    for seq, (turn, text) in enumerate(rows):
        found = []
        for line in (text or "").split("\n"):
            level = marks.match(line)[1].count(">")
            line = line[marks.match(line).end() :] if level else line
            if found and found[-1][0] == level:
                found[-1][1] += "\n" + line
            else:
                found.append([level, line])
        own = "\n".join(intro.sub("", t) if len(found) > 1 else t for lv, t in found if not lv or len(found) == 1).strip()
        own = own if len(found) > 1 or not found[0][0] else ""
        if len(found) == 1:
            own = found[0][1].strip()  # a message that only quotes keeps its text
        quoted = [p for p in found if p[0]]
        links = [(lv, k, o, len(x)) for k, (lv, t) in enumerate(quoted) for x in split(t) if (o := max((j for j in range(seq) if x in said[j]), default=None)) is not None]
        parent = seq - 1 if seq else None
        if links:
            outer = min(lv for lv, *_ in links)
            votes = {}
            for lv, _, o, n in links:
                if lv == outer:
                    votes[o] = votes.get(o, 0) + n
            parent = max(votes, key=lambda o: (votes[o], o))
        said.append(split(own))
        out.append([turn, own, len(quoted), len({k for _, k, *_ in links}), max([lv for lv, _ in quoted], default=0), parent])
    replies = {}
    for seq, r in enumerate(out):
        replies.setdefault(r[5], []).append(seq)
    order = []

    def walk(seq):
        run = [seq]
        while run[-1] + 1 in replies.get(run[-1], []):
            run.append(run[-1] + 1)
        order.extend(run)
        for s in reversed(run):
            for other in replies.get(s, []):
                if other != s + 1:
                    walk(other)

    walk(0)
    place = {s: i for i, s in enumerate(order)}
    return [(*r[:5], None if r[5] is None else rows[r[5]][0], place[s]) for s, r in enumerate(out)]


def test_quotations_of_random_threads_equal_a_plain_version(shared):
    rng, threads = random.Random(21), {}
    for conv in range(25):
        rows = []
        for turn in range(rng.randrange(1, 12)):
            lines = [f"Word {rng.randrange(6)} is here. And {conv % 3} {rng.randrange(9)} more!" for _ in range(rng.randrange(1, 3))]
            for _ in range(rng.randrange(3) if rows else 0):
                source = rng.choice(rows)[1].split("\n")
                at = rng.randrange(len(source))
                quote = [(">" if x.startswith(">") else "> ") + x for x in source[at : at + 3]]
                lines[rng.randrange(len(lines) + 1) : 0] = (["On Monday Ann wrote:"] if rng.random() < 0.4 else []) + quote
            rows.append((turn * 2, "\n".join(lines)))
        threads[conv] = rows
    df = shared.createDataFrame([(c, t, "user", x) for c, rows in threads.items() for t, x in rows], TURNS).withColumn("position", F.lit("clash")).repartition(5)
    got = {}
    for r in quotations.link(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.own_text, r.n_passages, r.n_linked, r.max_level, r.parent_turn, r.position))
    for conv, rows in threads.items():
        assert got[conv] == plain_link(rows), rows
    assert sum(r[3] for rows in got.values() for r in rows) > 20


def test_long_messages_are_cut_in_linear_time(shared):
    text = "\n".join(("> " * (i % 4)) + f"line {i}." for i in range(20_000))
    began = time.perf_counter()
    rows = quotations.link(shared.createDataFrame([(1, 0, "user", "line 1."), (1, 1, "user", text)], TURNS)).orderBy("turn").collect()
    assert rows[1].n_passages == 15_000 and rows[1].n_linked == 1 and rows[1].own_text.count("\n") == 4_999 and time.perf_counter() - began < 60


def test_quotation_operator_is_native(shared):
    plan = quotations.link(shared.createDataFrame([(1, 0, "u", "> a\nb")], TURNS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_pipeline_over_empty_tables_and_null_rows(shared, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    labels, items = "doc_id long, quality int, toxic int", "item_id long, text string"
    for name, rows, kind in (("labels", [], labels), ("benchmark", [], items), ("documents", [], kinds)):
        shared.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(shared, f"{tmp_path}/none").collect() == []
    rows = [(None, "no id", None, None, None), (None, "no id", None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "x y", "en", None, 3), (3, "x y", "en", None, 3)]
    for name, own, kind in (("labels", [], labels), ("benchmark", [(1, None)], items), ("documents", rows, kinds)):
        shared.createDataFrame(own, kind).write.parquet(f"{tmp_path}/odd/{name}.parquet")
    got = sorted((r.doc_id for r in corpus_pipeline.run(shared, f"{tmp_path}/odd").collect()), key=str)
    assert got == [1, 2, 3, None, None]  # rows with equal ids are one document, those without an id each its own


def test_extra_columns_with_clashing_names(shared):
    rows = [(i, f"http://h.net/{i}", f"<body><p>text {i}</p></body>", "x", 1, "y") for i in range(3)]
    df = shared.createDataFrame(rows, "page_id long, url string, html string, host string, n_chars int, text string")
    assert sorted(r.text for r in wrappers.extract(df).collect()) == ["text 0", "text 1", "text 2"]
    assert sorted(r.host for r in url_filters.judge(df, RULES).collect()) == ["h.net"] * 3
    archive = warc.archive(shared, df.withColumn("payload_digest", F.lit(0)).withColumn("record_type", F.lit(0)))
    assert [r.record_type for r in archive.collect()] == ["response"] * 3


def test_pipeline_keeps_clean_documents(shared, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    benchmark = [(1, text(40)), (2, text(30))]
    docs, toxic = [], []
    for i in range(120):
        x = ". ".join(text(9) for _ in range(8)) + "."
        if i % 4 == 0:
            x += " You utter scoundrel."
            toxic.append(i)
        docs.append((i, x))
    base = docs[1][1]
    docs += [(200, base), (201, base + " and one more"), (202, benchmark[0][1] + " " + text(10)), (203, ""), (204, None), (3, docs[3][1])]
    shared.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    shared.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    source = shared.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(shared, source, str(tmp_path)).columns == source.columns
    got = [r.doc_id for r in corpus_pipeline.run(shared, str(tmp_path)).collect()]
    assert sorted(got) == [i for i in range(120) if i not in toxic] + [203, 204]


def test_blocks_decode_once():
    assert wrappers.main_text("<p>&amp;lt; &#233; &eacute;</p>") == html.unescape("&lt;").replace("<", "&lt;") + " é é"
