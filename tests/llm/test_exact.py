"""The operators with an exact rule against brute force and exact round trips."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidentia.llm import bpe, chat, line_dedup, mixing, ngram_join, url_filter
from evidentia.llm import components as components_module
from evidentia.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCS = "doc_id long, text string"
AWKWARD = [(90, None), (91, ""), (92, "   \n\t"), (93, "<|endoftext|>"), (94, "a<|endoftext|>b <|endoftext|>"), (95, "é" * 3000), (96, "word " * 5000), (97, "\u0558\u4e2d😀 it's  I'LL 12³"), (98, "x"), (98, "x"), (None, "no id")]


def texts(seed, n=60):
    """Documents with copies, near copies and shared lines."""
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.randint(3, 60))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [rng.choice(WORDS) + str(rng.randint(0, 3))] * rng.randint(0, 1)
        lines = [" ".join(w[j : j + 12]) for j in range(0, len(w), 12)]
        out.append((i, "\n".join(lines)))
    return out


# --- line dedup


def word_edits(a, b):
    """Whether at most one word edit divides two lists."""
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def units(line):
    """What a line's edits count: its kind and units, or none where only exact repeats go."""
    if len(w := line.split(" ")) >= line_dedup.MIN_WORDS:
        return "words", w
    return ("characters", list(line)) if len(line) >= line_dedup.MIN_CHARS else ("none", None)


def plain_dedup(docs):
    seen, out = [], {}
    for key, text in sorted(docs):
        kept = []
        for line in (text or "").split("\n"):
            kind, u = units(line)
            again = any(line == x or (u and kind == k and word_edits(u, v)) for x, k, v in seen)
            if line.strip(" \t\r\f"):
                seen.append((line, kind, u))
                if again:
                    continue
            kept.append(line)
        out[key] = "\n".join(kept)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    docs = texts(seed)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == plain_dedup(docs)


def test_line_dedup_awkward(spark):
    rows = [(i, t, "q", 7) for i, t in AWKWARD] + [(1, "one two three four five", "a", 0), (2, "one two three four five six\nshort", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, line int")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "gone", "line", "n_lines", "n_dropped"]
    out = got.collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[90]["text"] is None and by[90]["n_lines"] == 0 and by[91]["text"] == "" and by[2]["text"] == "short" and by[96]["n_dropped"] == 0
    assert line_dedup.dedup_lines(docs.where("doc_id < 0")).count() == 0


def test_line_dedup_short_and_unspaced_lines(spark):
    """Exact repeats go at any length; lines of few words and text without blanks have near copies by characters; blank lines stay."""
    rights = "\u5168\u90e8\u306e\u6a29\u5229\u3092\u4fdd\u6709\u3059\u308b" * 2 + "\U0001f600"
    docs = [
        (1, f"All rights reserved.\n\n{rights}\nkeep\n\t\na b c d e f g h i j k l m n o p q r s t"),
        (2, f"All rights reserved.\n\n{rights}\nAll rights reserve.\n  \n{rights}x\n{rights[1:]}\nabcdefghijklmnopqrst"),
        (3, "  \none two three four five\nkeep\nkeep\nkeep!\nAll rights reserved!\nAll rights preserved"),
        (4, "one two three four five six"),
    ]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == plain_dedup(docs)
    assert got[2] == "\nAll rights reserve.\n  \nabcdefghijklmnopqrst" and got[3].endswith("five\nkeep!\nAll rights preserved") and got[4] == ""


def test_line_dedup_characters_at_random(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("ab\u00e9\u4e2d ") for _ in range(rng.randint(16, 26))) for _ in range(12)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(3):
            c = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(c))
                c[at : at + rng.randint(0, 1)] = [rng.choice("abx")] * rng.randint(0, 1)
            lines.append("".join(c))
        docs.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == plain_dedup(docs)


def test_line_dedup_of_one_long_repeating_text(spark):
    """A text of tens of thousands of lines that all go but the first few."""
    text = "\n".join(f"line {i % 7}" for i in range(60_000))
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], DOCS)).first()
    assert got["text"] == "\n".join(f"line {i}" for i in range(7)) and got["n_dropped"] == 59_993


def test_prefix_sums_over_spans(spark):
    """Lines longer than a span of running sums."""
    w = [f"w{i}" for i in range(700)]
    docs = [(1, " ".join(w)), (2, " ".join(w[:600] + ["new"] + w[601:])), (3, " ".join(w[:512] + w[513:])), (4, " ".join(["first", *w])), (5, " ".join(w[::-1]))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert [k for k, t in sorted(got.items()) if t] == [1, 5]


# --- n-gram join


def plain_groups(docs, k, num, den):
    sets = {}
    for key, text in docs:
        w = (text or "").encode().lower().split()
        n = min(k, len(w))
        sets[key] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("seed, k, num, den", [(3, 3, 90, 100), (4, 5, 8, 10), (5, 2, 1, 2)])
def test_ngram_groups(spark, seed, k, num, den):
    docs = texts(seed, 80) + [(1000, None), (1001, ""), (1002, "  "), (1003, "One two"), (1004, "one TWO"), (1005, "one\xa0two")]
    got = ngram_join.near_groups(spark.createDataFrame(docs, DOCS), k, num, den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_groups(docs, k, num, den)


@pytest.mark.parametrize("less", [0, 1, 10**9])
def test_ngram_hot_grams_and_blocks(spark, monkeypatch, less):
    """Grams counted apart because many classes of a task have them; clusters joined block by block, and gram by gram."""
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "FLUSH", 500)
    monkeypatch.setattr(ngram_join, "LESS", less)
    docs = texts(6, 80)
    got = ngram_join.near_groups(spark.createDataFrame(docs, DOCS).coalesce(2), 3, 7, 10).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_groups(docs, 3, 7, 10)


def test_ngram_awkward(spark):
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in AWKWARD], "doc_id long, text string, n long, cls string")
    got = ngram_join.near_groups(docs).collect()
    assert len(got) == len(AWKWARD) and {r["component_id"] for r in got if r["doc_id"] == 98} == {98}
    assert ngram_join.near_groups(docs.where("doc_id < 0")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    star = [(0, i) for i in range(1, 700)] + [(2000 - i, 2000) for i in range(1, 700)] + [(699, 1999)]
    assert {r["root"] for r in components(spark.createDataFrame(star, "a long, b long")).collect()} == {0}


def test_components_spend_rounds_and_tasks_on_what_is_left(spark, monkeypatch):
    """Stars need no round; few edges in many partitions are read by few tasks; a random graph against plain search."""
    rng = random.Random(4)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        reach = [n] if n not in want else []
        while reach:
            x = reach.pop()
            if x not in want:
                want[x] = n
                reach += near[x]
    seen = []
    join_one = components_module.join_one
    monkeypatch.setattr(components_module, "join_one", lambda rows, *more: seen.append(rows.rdd.getNumPartitions()) or join_one(rows, *more))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want and seen and max(seen) <= 2 * spark.sparkContext.defaultParallelism
        seen.clear()
        stars = [(9, 3), (3, 8), (5, 4), (3, 9), (4, 4)]
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
        assert got == {3: 3, 8: 3, 9: 3, 4: 4, 5: 4} and not seen
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- BPE


def test_bpe_against_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(8)
    rows = AWKWARD + [(i, "".join(rng.choice(" '\n\taAé1²sdtlmrev!?\xa0<|endoftext|>😀中՘ß　") for _ in range(rng.randint(0, 60)))) for i in range(1000, 1200)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, ids int")
    got = bpe.encode(docs, path, lexicon_size=50, with_ids=True).collect()
    want = Counter()
    for key, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[key, len(ids), tuple(ids), text, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert bpe.encode(docs.where("doc_id < 0"), path).count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    rng = random.Random(9)
    entries = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))): [rng.randrange(100) for _ in range(rng.randint(1, 3))] for _ in range(300)}
    made = bpe.Lexicon.build(entries)
    (tmp_path / "lexicon").write_bytes(made.to_bytes())
    absent = [w for w in (bytes(rng.choice(b"abcd") for _ in range(4)) for _ in range(200)) if w not in entries]
    for lexicon in (made, bpe.Lexicon.map_bytes(made.to_bytes()), bpe.Lexicon.map_file(str(tmp_path / "lexicon"))):
        assert lexicon.look_up(list(entries)) == list(entries.values())
        assert lexicon.look_up([*absent, b""]) == [None] * (len(absent) + 1)
    tails = {frozenset(w[len(p) :] for w in entries if w.startswith(p)) for e in entries for p in (e[:i] for i in range(len(e) + 1))}
    assert len(made.start) - 1 == len(tails)  # one state for each set of tails


# --- chat


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<|im_start|>user\nhi", "\\", "\\\\<|", "<\\|", "<\\n", "a\nb", "", None, "<", "|im_sep|>", "<|im_sep|>", "é😀" * 50]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole<|", None]), rng.choice(nasty)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(50, None, "user", "x"), (50, 1, "user", "x"), (50, 1, "user", "x"), (None, 0, "assistant", "y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    made = chat.format_chats(df)
    got = {r["conv_id"]: r for r in made.select("conv_id", "formatted", "segments", "loss_spans", chat.read_back(made["formatted"]).alias("turns")).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    for c, r in got.items():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert [s["text"].replace("<\\|", "<|").replace("\\\\", "\\") for s in r["segments"] if s["loss"]] == [t for role, t in want[c] if role == "assistant"]
        raw = r["formatted"].encode()
        assert [raw[p["start"] : p["start"] + p["length"]].decode() for p in r["loss_spans"]] == [s["text"] for s in r["segments"] if s["loss"]]
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == 1 + sum(a[0] != b[0] for a, b in zip(want[c], want[c][1:], strict=False))
    assert chat.digests(chat.format_chats(df.where("conv_id < 0"))).count() == 0


def test_chat_of_very_many_turns(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"é{i}" + "x" * 50) for i in range(30_000)]
    got = chat.digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    loss = "".join(t for _, _, role, t in rows if role == "assistant")
    assert got["n_turns"] == 30_000 and got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got["loss_chars"] == len(loss)


# --- URL filter


def plain_glob(glob, url):
    """Backtracking by sets of places."""
    places = {0}
    for ch in glob:
        if ch in "*^":
            more = set(places)
            for p in places:
                while p < len(url) and (ch == "*" or url[p] != "/"):
                    p += 1
                    more.add(p)
            places = more
        else:
            places = {p + 1 for p in places if p < len(url) and (ch in ("?", url[p]) or ch == "~" and url[p] in ".-_:")}
    return len(url) in places


def test_globs_against_backtracking():
    rng = random.Random(4)
    globs = ["", "*", "^", "a*", "*a", "^.b/*", "?a^b*", "ab", "a**b", "*^/", "^~ab~*", "^~ab"] + ["".join(rng.choice("ab./*^?~") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    urls = ["", "a", "/", "a" * 500] + ["".join(rng.choice("ab./-") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    hit = url_filter.GlobSet(globs).match([u.encode() for u in urls])
    for i, u in enumerate(urls):
        for j, g in enumerate(globs):
            assert hit[i, j] == plain_glob(g.replace("^*", "*").replace("*^", "*"), u), (g, u)


def test_url_rules(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f", "example.net/en/", "allow"), (2, "https://x.net/", "net/", "block"), (3, "https://x.net", None, "allow"), (4, "https://free-bets.org/fr/1", "org/fr/", "allow"), (5, "https://free-bets.org/en/1", None, "block"), (6, "https://x.com/free-bets", None, "allow"), (7, None, None, "allow"), (8, "no url", None, "allow"), (9, "http://a.com/x.net/y", None, "allow"), (10, "http://example.com/de/", "example.com/de/", "block"), (11, "http://notnet/", None, "allow"), (12, "http://u@net:80/", None, "allow"), (13, "x://net/" + "a" * 20000, "net/", "block"), (13, "x://net/", "net/", "block")]
    got = url_filter.judge(spark.createDataFrame([(a, b, "v") for a, b, _, _ in rows], "page_id long, url string, verdict string"))
    assert Counter((r["page_id"], r["rule"], r["verdict"]) for r in got.collect()) == Counter((a, c, d) for a, _, c, d in rows)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_words_of_hosts_and_paths(spark):
    urls = {
        "https://www.specialist-clinic.org.uk/x": "allow", "https://socialistparty.example/": "allow", "https://milford-library.example/a": "allow", "http://antiphishing.example/": "allow", "http://adsl.example.com/": "allow",
        "http://www.cialis.com/": "block", "http://buy-cialis-now.com:80/": "block", "http://cialis": "block", "http://m.free-bets.example.com/en/1": "block", "http://ads.example.com/": "block", "http://x.com/free-bets/": "allow",
        "http://x.com/cgi-bin/adv.pl": "block", "http://x.com/a/adclick?to=y": "allow", "http://x.com/a/adclick/1": "block", "http://x.com/affiliate/": "allow", "http://x.com/affiliate/7": "block", "http://a1.adxserver.com/": "block",
    }
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {list(urls)[r["page_id"]]: r["verdict"] for r in got} == urls


def test_globs_from_a_table(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.com/shop/x"), (2, "http://a.com/x"), (3, "http://casino.com/")], "page_id long, url string")
    table = spark.createDataFrame([("*/shop/*", 1), (None, 2), ("", 3), ("*/shop/*", 4)], "glob string, n int")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, block_globs=table).collect()} == {1: "block", 2: "allow", 3: "allow"}
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, block_globs=[]).collect()} == {1: "allow", 2: "allow", 3: "allow"}
    monkeypatch.setattr(url_filter, "MAX_GLOBS", 0)
    with pytest.raises(ValueError):
        url_filter.judge(pages, block_globs=table)


# --- mixing


def mixing_rows():
    rng = random.Random(2)
    return [(i, " ".join(["w"] * rng.randint(1, 30)) + rng.choice(["", " Password", " licensed"]), rng.choice("abc") if i % 50 else None, rng.choice(["en", "fr"]), 3) for i in range(1500)]


MIXED = "doc_id long, text string, source string, lang string, factor int"


def test_mixing_meets_targets(spark):
    docs = spark.createDataFrame(mixing_rows(), MIXED)
    want = {"source": {"a": 0.5, "b": 0.25, "c": 0.23, None: 0.02}, "lang": {"en": 0.4, "fr": 0.6}, "topic": {"general": 0.3, "software": 0.35, "law": 0.35}}
    local = mixing.mix(docs, want, keep=0.5)
    assert local.columns[:5] == docs.columns
    out = local.toPandas()
    mass = out["mix_tokens"] * out["mix_probability"]
    assert abs(mass.sum() / out["mix_tokens"].sum() - 0.5) < 1e-6
    for d, column in (("source", "source"), ("lang", "lang"), ("topic", "mix_topic")):
        shares = mass.groupby(out[column].astype(object).where(out[column].notna(), None), dropna=False).sum() / mass.sum()
        for k, v in shares.items():
            assert abs(v - want[d][None if k != k else k]) < 1e-6
    assert (out["mix_probability"] <= 1).all() and abs(out["mix_sampled"].mean() - out["mix_probability"].mean()) < 0.05
    cluster = mixing.mix(docs, want, keep=0.5, local_cells=1).toPandas().set_index("doc_id")
    assert np.abs(cluster["mix_probability"] - out.set_index("doc_id")["mix_probability"]).max() < 1e-9


def test_mixing_of_powers_and_others(spark):
    docs = spark.createDataFrame(mixing_rows(), MIXED)
    out = mixing.mix(docs, {"source": 0.0, "lang": {"fr": 0.6, "*": 0.4}, "topic": 1.0}, keep=0.05).toPandas()
    mass = out["mix_tokens"] * out["mix_probability"]
    assert np.allclose(mass.groupby(out["source"].fillna("-")).sum() / mass.sum(), 0.25, atol=1e-6)
    assert np.allclose(mass.groupby(out["mix_topic"]).sum() / mass.sum(), out.groupby("mix_topic")["mix_tokens"].sum() / out["mix_tokens"].sum(), atol=1e-6)


def test_rare_cell_does_not_lower_the_others(spark):
    """A source of one document is kept whole; what cannot be met is told, not passed over."""
    docs = spark.createDataFrame([*mixing_rows(), (9999, "w w w", "rare", "en", 3)], MIXED)
    with pytest.raises(mixing.NotMet):
        mixing.mix(docs, {"source": 0.0}, keep=0.5)
    with pytest.warns(UserWarning, match="miss"):
        out = mixing.mix(docs, {"source": 0.5}, keep=0.6, strict=False).toPandas()
    assert out.set_index("doc_id")["mix_probability"][9999] > 0.9
    assert abs((out["mix_tokens"] * out["mix_probability"]).sum() / out["mix_tokens"].sum() - 0.6) < 0.02


def test_mixing_awkward(spark):
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in AWKWARD], "doc_id long, text string, source string, lang string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(AWKWARD) and len({r["mix_sampled"] for r in out if r["doc_id"] == 98}) == 1
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0
    assert {r["mix_probability"] for r in mixing.mix(docs.where("text = ''")).collect()} == {0.0}
