"""The operators that learn, search or extract: accuracy, recall, planted pages and awkward rows."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from evidentia.llm import ann, fingerprint, html_extract, quality

AWKWARD = [(90, None), (91, ""), (92, " "), (95, "é" * 3000), (96, "word " * 5000), (98, "x"), (98, "x"), (None, "no id")]


# --- HTML

PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header class="site-header"><a href=/>Home</a><p>Welcome to the best site that there is on the web</p></header>
<nav><ul><li><a href="/a">The first</a></li><li><a href="/b">The second</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to give you the best experience on this site.</p></div><!-- a <p>comment</p> -->
<div id=main><article><h1>A title &amp; more</h1><p>The first   paragraph of the text,
with a <a href="x">link</a> in it.</p><p><b>Broken bold that is never closed, with enough words to be kept.<br><p>Short.</p>
<div>Next to nothing</div><ul><li>An item of a list</li></ul><pre>x &lt; y</pre><div class="ad">Buy now, the best offer of the year for you</div>
<blockquote>A quote of some words from the man who was there.</blockquote></article>
<section id="comments"><h2>Comments</h2><div class=comment><p>I think that this is the best article of the year.</p></div></section></div>
<aside><p>Related: this and that and the other thing for you</p></aside><form><label>Name</label><input value=x><textarea>text of a form</textarea></form>
<footer>&copy; 2024 The company and all of its friends</footer></body></html>"""


def test_article_without_furniture():
    assert html_extract.extract(PAGE) == "\n".join(
        ["A title & more", "The first paragraph of the text, with a link in it.", "Broken bold that is never closed, with enough words to be kept.", "Short.", "Next to nothing", "An item of a list", "x < y", "A quote of some words from the man who was there."]
    )


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain words without any markup at all here", "plain words without any markup at all here"), ("<p>cut off in the <b>mid", "cut off in the mid"), ("<p>a</p><script>x", "a"), ("<p>one &nbsp; two&#33;", "one two!"), ("<nav>only a menu</nav>", ""), ("<p>a<!-- <p>b", "a"), ("<p class='x>y' title=\"a>b\">t</p>", "t")])
def test_odd_pages(page, text):
    assert html_extract.extract(page) == text


PROSE = "It was the first of the days on which the boats came back from the sea with the men of the town."


def test_stop_words_and_neighbours_decide():
    names = "Arrows Baskets Candles Drums Engines Flutes Gardens Hammers Islands Jackets"
    links = "<ul><li><a href=/a>Some place</a></li><li><a href=/b>Other place</a></li></ul>"
    between = f"<div>{PROSE}</div><div>{names}</div><div>Short one</div><div>{PROSE}</div>"
    assert html_extract.extract(f"{links}<div>{names}</div>{links}{between}{links}<div>{names}</div>") == "\n".join([PROSE, names, "Short one", PROSE])
    assert html_extract.first_pass(PROSE, False, 0) is True and html_extract.first_pass(names, False, 0) is None and html_extract.first_pass(PROSE, False, 60) is False
    assert html_extract.extract(f"<div>{names}</div><div>{names}</div>") == f"{names}\n{names}"  # nothing tells: all stays


def test_article_is_evidence_only():
    teaser = "<article><h3>Other news</h3><p>Read on</p></article>"
    assert html_extract.extract(f"<div>{PROSE}</div><p>{PROSE}</p>{teaser}") == f"{PROSE}\n{PROSE}\nOther news\nRead on"
    assert html_extract.extract(f"<div>{PROSE}</div><article><h1>A title</h1><p>{PROSE} {PROSE}</p></article>") == f"A title\n{PROSE} {PROSE}"


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><div class="social-science">prose</div></article>', "prose"),
        ('<div id="search-engine-history">prose prose</div>', "prose prose"),
        (f"<article><h1>T</h1><div class=social-science><h2>Start</h2><p>{PROSE}</p></div><div class=share-this-now><a href=/>Tell a friend</a></div></article>", f"T\nStart\n{PROSE}"),
        (f"<article><p>{PROSE}</p><div class='reader-comments'><p>{PROSE}</p></div><div class='cookie-notice--fixed'><p>{PROSE}</p></div></article>", PROSE),
        (f"<div class='page menu'><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p><div class=ad>{PROSE}</div></div>", f"T\n{PROSE}\n{PROSE}\n{PROSE}"),
        (f"<div class=comments><p>{PROSE}</p></div>", ""),
        (f"<body class='has-sidebar no-ads'><table><tr><td id=nav><a href=/>Home</a></td><td><h1>T</h1><p>{PROSE}</p></td></tr></table></body>", f"T\n{PROSE}"),
        (f"<main><div class=with-sidebar><h1>T</h1><p>{PROSE}</p></div></main>", f"T\n{PROSE}"),
        ("<p>AT&<i>amp;</i>T &amp;amp; x&#<b>65;</b></p>", "AT&amp;T &amp; x&#65;"),
    ],
)
def test_class_words_take_no_prose_away(page, text):
    assert html_extract.extract(page) == text


def slow_extract(found):
    """The two passes over blocks again, each block asking all others."""
    P, L = html_extract.PAGE_BLOCKS, []
    for x in found:
        words = regex.findall(r"[\p{L}\p{N}]+", x.text)
        prose = len(words) >= 8 and sum(w.lower() in html_extract.STOP_WORDS for w in words) / len(words) >= 0.08
        L.append(False if x.out or x.linked > len(x.text) / 2 else True if prose else None)
    believed = {x.named for x in found} - {None}
    if all(x.named is not None for x, y in zip(found, L, strict=True) if y):
        count = lambda n: sum(1 for x, y in zip(found, L, strict=True) if y and x.named == n and not x.twice)
        order = list(dict.fromkeys(x.named for x, y in zip(found, L, strict=True) if y and not x.twice))
        page = max(order, key=count, default=None)
        if page is not None and count(page) >= P:
            believed.discard(page)
    L = [False if x.named is not None and (x.named in believed or x.twice) else y for x, y in zip(found, L, strict=True)]
    L = [False if x.hint is not None and not any(z and w.hint == x.hint for w, z in zip(found, L, strict=True)) and x.linked > 0.2 * len(x.text) else y for x, y in zip(found, L, strict=True)]
    articles = sum(len(x.text) for x, y in zip(found, L, strict=True) if x.region and y is not False)
    outside = sum(len(x.text) for x, y in zip(found, L, strict=True) if not x.region and y)
    out = []
    for i, (x, y) in enumerate(zip(found, L, strict=True)):
        if not x.region and articles and articles >= outside:
            continue
        if y is None:
            mine = [j for j, w in enumerate(found) if w.region == x.region]
            at = mine.index(i)
            told = [(abs(mine.index(j) - at), L[j]) for j in mine if L[j] is True or L[j] is False and not x.region]
            nearest = min((d for d, _ in told), default=None)
            y = True if nearest is None else any(v for d, v in told if d == nearest)
        if y:
            out.append(x.text)
    return "\n".join(out)


def test_second_implementation_agrees_on_random_pages():
    rng = random.Random(11)
    texts = [PROSE, "Few words", "Arrows Baskets Candles Drums Engines Flutes Gardens Hammers Islands", "One of the two"]
    names = ["ad", "social-science", "comments", "menu-items", "share-this", "plain", "has-sidebar", "site-header", "promo box"]

    def part(depth):
        kind = rng.choice(["text", "text", "p", "div", "a", "article", "main", "nav", "class", "class", "h2", "li"])
        inner = lambda: "".join(part(depth + 1) for _ in range(rng.randint(1, 3))) if depth < 4 else rng.choice(texts)
        if kind == "text":
            return rng.choice(texts) + " "
        if kind == "a":
            return f"<a href=/>{rng.choice(texts)}</a>"
        return f"<div class='{rng.choice(names)}'>{inner()}</div>" if kind == "class" else f"<{kind}>{inner()}</{kind}>"

    for _ in range(500):
        page = "".join(part(0) for _ in range(rng.randint(1, 6)))
        assert html_extract.extract(page) == slow_extract(list(html_extract.blocks(page))), page


def test_stray_quotes_and_deep_nesting():
    assert html_extract.extract("<p title=don't>one</p><p title = \"a>b\" id='x>y' \">two</p>") == "one\ntwo"
    for page in ("<div>" * 60_000 + "x" + "</div>" * 60_000, "<b>" * 30_000 + "<div>" * 30_000 + "x" + "</b>" * 30_000, "<p>" * 60_000 + "x"):
        assert html_extract.extract(page) == "x"


def test_planted_pages_at_random():
    """Pages put together of known parts: what stands in the article's parts comes out, nothing else."""
    rng = random.Random(7)
    prose = lambda: " ".join(rng.choice(PROSE.split()) for _ in range(rng.randint(12, 60)))
    outside = ["<nav><a href=/>{}</a></nav>", "<footer>{}</footer>", "<div class='ad box'>{}</div>", "<aside><p>{}</p></aside>", "<script>var x='{}'</script>", "<form><p>{}</p></form>", "<!-- {} -->", "<section id=comments><p>{}</p></section>", "<div class=cookie-banner>{}</div>"]
    inside = ["<p>{}</p>", "<h2>{}</h2>", "<div>{}</div>", "<ul><li>{}</li></ul>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<p>{}"]
    for _ in range(100):
        parts = [prose() if rng.random() < 0.7 else "Few words" for _ in range(rng.randint(2, 9))]
        body = "".join(rng.choice(inside).format(p) + (rng.choice(outside).format(prose()) if rng.random() < 0.3 else "") for p in parts)
        wall = lambda: "".join(rng.choice(outside).format(prose()) for _ in range(rng.randint(0, 4)))
        page = f"<html><body>{wall()}<article>{body}</article>{wall()}</body></html>"
        assert html_extract.extract(page) == "\n".join(parts), page


def test_pages_frame(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (2, None, None, "t"), (3, "v", "<p>" + "word " * 200_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(pages).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == sorted((a, len(html_extract.extract(c))) for a, _, c, _ in rows)
    assert html_extract.extract_pages(pages.where("page_id < 0")).count() == 0


# --- quality


def test_quality_held_out(spark):
    rng = random.Random(1)
    good = "the of and to in that is was for on with as by at from have this are not but had they his her she".split()
    texts, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = [rng.choice(good) for _ in range(rng.randint(20, 120))]
        texts.append((i, " ".join(x.upper() + "!!" if bad else x for x in w)))
        labels.append((i, int(not bad), 0))
    docs, marks = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, marks)
    out = quality.score(docs, model).toPandas().merge(marks.toPandas(), on="doc_id")
    held = out[out["held_out"]]
    assert len(held) > 200 and (held["predicted"] == held["quality"]).mean() > 0.97
    assert out["score"].between(0, 1).all()


def test_dictionaries_see_whole_texts(spark, monkeypatch):
    """Every byte of a labelled text goes to the training of its class, however long the text."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 0][:40]
    texts = [f"{i} " + "words é " * (9_000 if i % 2 else 10) + f"end{i}" for i in ids]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    seen, make = [], quality.make_dictionary
    monkeypatch.setattr(quality, "make_dictionary", lambda pieces: seen.append(b"".join(pieces)) or make(pieces))
    quality.train(docs, labels)
    assert [len(x) for x in seen] == [sum(len(t.encode()) for i, t in zip(ids, texts) if i % 2 == y) for y in (1, 0)]
    assert all(f"end{i}".encode() in seen[1 - i % 2] for i in ids)


def test_quality_awkward(spark):
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in AWKWARD], "doc_id long, text string, quality_score double, c0 int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    out = quality.score(docs, model).collect()
    assert len(out) == len(AWKWARD) and {r["score"] for r in out} == {0.5}
    kept = quality.score(docs, model, keep=True)
    assert kept.columns == [*docs.columns, "quality_score"] and kept.count() == len(AWKWARD)
    assert quality.score(docs.where("doc_id < 0"), model).count() == 0
    few = spark.createDataFrame([(90, 1), (91, 0), (96, 1), (95, 0), (None, 1), (98, 2), (98, None)], "doc_id long, quality int")
    assert quality.score(docs, quality.train(docs, few)).count() == len(AWKWARD)


# --- nearest neighbours


def brute(rows, k, modulus):
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and len(v) != 7 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in fine:
        if q % modulus == 0:
            out[q] = [i for _, i in sorted((-float((x * y).sum()), i) for i, y in fine if i != q)[:k]]
    return out


def test_neighbours_small_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(90)] + [(100 + i, [1.0] * 8) for i in range(30)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (None, [1.0] * 8), (220, [1.0] * 7), (221, [])]
    df = spark.createDataFrame([(a, b, 0.0) for a, b in rows], "vec_id long, embedding array<float>, score double")
    got = {}
    for r in ann.search(df, k=20, query_modulus=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 20, 20)
    assert set(got) == set(want)
    assert got == want
    assert ann.search(df.where("vec_id < 0")).count() == 0


def test_neighbours_recall_with_graph_and_blocks(spark, monkeypatch):
    for name, value in (("LIST_SIZE", 8), ("BEAM", 16), ("DEGREE", 12), ("BLOCK", 64), ("AT_ONCE", 16)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.6 * rng.normal(size=16)).tolist()) for i in range(1500)] + [(5000 + i, (3 * np.ones(16)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, probes=32).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(rows, 20, 20)
    hit = np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])
    assert set(got) == set(want) and hit >= 0.9


def test_beams_find_what_a_scan_finds():
    rng = np.random.default_rng(4)
    centres = np.unique(rng.normal(size=(900, 12)), axis=0)
    router = ann.Router(centres, ann.neighbour_graph(centres))
    x = rng.normal(size=(200, 12))
    want = np.argsort(ann.distances(x, centres), axis=1)[:, :5]
    got, d = router.nearest(x, 5)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(got, want)]) > 0.95 and (np.diff(d, axis=1) >= 0).all()
    assert all(len(set(g)) == len(g) for g in router.nearest(x, 60)[0])
    sizes = np.bincount(ann.distances(rng.normal(size=(5000, 12)), ann.fit_centroids(rng.normal(size=(5000, 12)), 400)).argmin(axis=1))
    assert 300 < len(sizes) <= 440 and sizes.max() < 100


def found_by(df, **kw):
    got = {}
    for r in ann.search(df, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def test_neighbours_among_many_lists(spark, monkeypatch):
    """Unclustered vectors in far more lists than any fixed number of visits."""
    monkeypatch.setattr(ann, "LIST_SIZE", 8)
    rng = np.random.default_rng(8)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(8000, 24)))]
    got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_modulus=80)
    want = brute(rows, 20, 80)
    assert set(got) == set(want) and np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.97


def test_neighbours_of_uneven_lengths(spark, monkeypatch):
    """Vectors whose lengths differ by orders of magnitude, where distances to centroids tell little."""
    monkeypatch.setattr(ann, "LIST_SIZE", 64)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 32)) * np.exp(1.5 * rng.normal(size=(4000, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = brute(rows, 20, 20)
    assert set(got) == set(want) and np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.97


def test_neighbours_beyond_small_clusters(spark, monkeypatch):
    """Clusters of five: the nearest list alone holds too few."""
    monkeypatch.setattr(ann, "LIST_SIZE", 5)
    rng = np.random.default_rng(9)
    centres = 50 * rng.normal(size=(200, 8))
    rows = [(i, (centres[i % 200] + 0.01 * rng.normal(size=8)).tolist()) for i in range(1000)]
    got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), probe_ratio=1.15)
    assert len(got) == 50 and all(len(v) == 20 for v in got.values())


def test_repeated_rows_push_nothing_out(spark):
    """Every row twice, one neighbour 40 times and one id with 40 vectors: the 20 best ids of brute force."""
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    many = [(501, [2.0 + 0.001 * j] * 8) for j in range(40)]
    df = spark.createDataFrame([*rows, *rows, *many, *[(500, [2.0] * 8)] * 40], "vec_id long, embedding array<double>")
    got = found_by(df, query_modulus=20, probe_ratio=50.0)
    every = {}
    for key, v in [*rows, *many, (500, [2.0] * 8)]:
        every.setdefault(key, []).append(np.array(v))
    asked = [q for q in every if q % 20 == 0]
    for q in asked:
        score = {i: max(float((x * y).sum()) for x in every[q] for y in vs) for i, vs in every.items() if i != q}
        assert got[q] == sorted(score, key=lambda i: (-score[i], i))[:20]
    assert set(got) == set(asked)


# --- fingerprints


def test_fingerprints_follow_edits(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(50, 200)))) for i in range(150)] + [(1000, None), (1001, ""), (1002, "ab"), (1003, "é😀" * 2000)]
    docs += [(2000, docs[0][1]), (2001, docs[0][1].replace(docs[0][1][40:44], "x", 1)), (5, "again"), (5, "again"), (None, "no id")]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, halo int")
    got = fingerprint.edit_pairs(df).collect()
    ordered = sorted(((a, b or "") for a, b in docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (key, t) in enumerate(ordered):
        h = len(t) // 2
        edited = t[: len(t) - h] + ordered[(i + 1) % len(ordered)][1][:h]
        want.append((key, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key) == sorted(want, key=key)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[2000] == prints[0]
    like = lambda a, b: 1 - 2 * bin(int(prints[a], 16) ^ int(prints[b], 16)).count("1") / (len(prints[a]) * 4)
    assert like(0, 2001) > 0.7 and like(0, 1) < 0.25
    long = [r for r in got if r["n_chars"] > 200]
    assert 0.4 < np.mean([r["near_edited"] for r in long]) < 0.6 and np.mean([r["near_next"] for r in long]) < 0.1
    classes = {}
    for r in fingerprint.near_classes(spark.createDataFrame([(r["doc_id"], r["fingerprint"]) for r in got], "doc_id long, fingerprint string"), least=0.7).collect():
        classes.setdefault(r["doc_id"], r["class_id"])
    assert classes[0] == classes[2000] == classes[2001] == 0 and classes[1] == 1 and len(classes) == len({d for d, _ in docs})
    assert fingerprint.edit_pairs(df.where("doc_id < 0")).count() == 0
    whole = fingerprint.fingerprinted(df).collect()
    assert Counter((r["doc_id"], r["edited_sha256"], r["fingerprint"], r["near_edited"]) for r in whole) == Counter((r["doc_id"], r["edited_sha256"], r["fingerprint"], r["near_edited"]) for r in got)
    assert {r["class_id"] for r in whole if r["doc_id"] in (0, 2000)} == {0} and {r["class_id"] for r in whole if r["doc_id"] in (1000, 1001)} == {1000}
    assert fingerprint.fingerprinted(df.where("doc_id < 0")).count() == 0


def test_near_classes_find_pairs_at_the_threshold(spark):
    """Fingerprints of which a tenth of the bits differ, against all pairs."""
    rng = np.random.default_rng(12)
    n = fingerprint.WALKS * fingerprint.BITS
    rows = []
    for i in range(300):
        bits = rng.random(n) < 0.5
        other = bits.copy()
        other[rng.choice(n, n // 10, replace=False)] ^= True
        rows += [(2 * i, bits), (2 * i + 1, other)]
    every = np.array([b for _, b in rows], dtype=np.int32)
    apart = every.sum(axis=1)[:, None] + every.sum(axis=1)[None, :] - 2 * every @ every.T
    want = {(i, j) for i, j in zip(*np.nonzero(apart <= 0.1 * n), strict=True) if i < j}
    got = {r["doc_id"]: r["class_id"] for r in fingerprint.near_classes(spark.createDataFrame([(i, fingerprint.hexed(b)) for i, b in rows], "doc_id long, fingerprint string")).collect()}
    assert len(want) == 300 and np.mean([got[i] == got[j] for i, j in want]) >= 0.9
    assert all((min(i, c), max(i, c)) in want for i, c in got.items() if i != c)


def test_bucket_links_span_what_is_linked(monkeypatch):
    """Against all pairs, with a family of near copies, chains and strangers; and the plan of bands at any size."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, (40, 8), dtype=np.uint64)
    rows = [b for b in base]
    for _ in range(300):
        x = np.unpackbits((base[0] if rng.random() < 0.6 else rows[rng.integers(len(rows))]).view(np.uint8))
        x[rng.choice(512, rng.integers(1, 60), replace=False)] ^= 1
        rows.append(np.packbits(x).view(np.uint64))
    rows = np.array(rows)[rng.permutation(len(rows))]
    near = np.bitwise_count(rows[:, None] ^ rows[None]).sum(axis=2) <= 51.2

    def roots(links):
        root = list(range(len(rows)))
        for _ in range(len(rows)):
            for i, j in links:
                root[i] = root[j] = min(root[i], root[j])
        return root

    got = fingerprint.linked(rows, 51.2)
    assert len({j for _, j in got}) == len(got) and roots(got) == roots(list(zip(*np.nonzero(near))))
    monkeypatch.setattr(fingerprint, "CROWD", 50)
    assert roots(fingerprint.linked(rows, 51.2)) == roots(got)
    for n in (1, 1000, 10**6, 10**9, 10**12):
        places = fingerprint.band_places(512, n)
        assert 1 - (1 - 0.9 ** places.shape[1]) ** len(places) >= fingerprint.RECALL and places.max() < 512 and all(len(set(p)) == len(p) for p in places.tolist())


def test_a_crowd_of_strangers_in_one_bucket():
    """40,000 that share a band but are not near each other, with some near pairs among them."""
    rng = np.random.default_rng(8)
    rows = rng.integers(0, 2**64, (40_000, 8), dtype=np.uint64)
    rows[:, 0] &= np.uint64((1 << 52) - 1)
    for i in range(0, 200, 2):
        x = np.unpackbits(rows[i].view(np.uint8))
        x[rng.choice(512, rng.integers(1, 52), replace=False)] ^= 1
        rows[i + 1] = np.packbits(x).view(np.uint64)
    order = rng.permutation(len(rows))
    began = time.process_time()
    got = {tuple(sorted(order[list(p)].tolist())) for p in fingerprint.linked(rows[order], 51.2)}
    assert got == {(i, i + 1) for i in range(0, 200, 2)}
    assert time.process_time() - began < 15  # all pairs took 50


def test_text_ids_keep_their_order(spark):
    texts = {f"doc-{i:03}": f"text number {i} of many, with words {i * 7}" for i in range(40)} | {"": "the first of all", "é": "the last of all"}
    df = spark.createDataFrame([*texts.items(), (None, "no id")], "name string, body string").repartition(5)
    got = {r["name"]: r for r in fingerprint.edit_pairs(df, "name", "body").collect()}
    order = [*sorted(texts, key=lambda k: k.encode(), reverse=True), None]
    body = texts | {None: "no id"}
    for i, key in enumerate(order):
        own, after = body[key], body[order[(i + 1) % len(order)]]
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        assert got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_likeness_follows_edit_distance(spark):
    """Random edits of a text: the more, the less alike, and bands find what brute force over all fingerprints finds."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    docs, edits = [], []
    for i in range(250):
        w = [rng.choice(words) for _ in range(rng.randint(150, 400))]
        k = rng.choice([0, 1, 2, 4, 8, 16, 40])
        v = list(w)
        for _ in range(k):
            v[rng.randrange(len(v))] = rng.choice(words)
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        edits.append(k / len(w))
    out = fingerprint.fingerprinted(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    bits = {r["doc_id"]: np.unpackbits(np.frombuffer(bytes.fromhex(r["fingerprint"]), dtype=np.uint8)) for r in out}
    cls = {r["doc_id"]: r["class_id"] for r in out}
    like = [fingerprint.likeness(bits[2 * i], bits[2 * i + 1]) for i in range(250)]
    assert np.corrcoef(np.argsort(np.argsort(edits)), np.argsort(np.argsort(like)))[0, 1] < -0.85  # equal numbers of edits are ranked at random
    every = np.array([bits[i] for i in range(500)], dtype=np.int32)
    apart = every.sum(axis=1)[:, None] + every.sum(axis=1)[None, :] - 2 * every @ every.T
    pairs = [(i, j) for i, j in zip(*np.nonzero(apart <= 51), strict=True) if i < j]
    close = [(i, j) for i, j in pairs if apart[i, j] > 38]
    assert len(pairs) > 100 and np.mean([cls[i] == cls[j] for i, j in pairs]) >= 0.9
    assert not close or np.mean([cls[i] == cls[j] for i, j in close]) >= 0.85, len(close)


def test_lockstep_equals_single_walks(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc déf") for _ in range(rng.randint(0, 300))) for _ in range(150)] + ["x" * 5000]
    walks = fingerprint.Walks()
    together = [b.tolist() for b, _ in walks.fingerprints(texts)]
    monkeypatch.setattr(fingerprint, "LEAST_LANES", 10_000)
    assert [walks.fingerprints([t])[0][0].tolist() for t in texts] == together


def test_sole_and_single_bucket_documents(spark):
    one = fingerprint.edit_pairs(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1.0
    two = fingerprint.edit_pairs(spark.createDataFrame([(None, "abcd"), (None, "wxyz")], "doc_id long, text string")).collect()
    assert {r["edited_sha256"] for r in two} == {hashlib.sha256(b"abwx").hexdigest(), hashlib.sha256(b"wxab").hexdigest()}
