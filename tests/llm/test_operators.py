"""Each operator against brute force, and on the rows that every operator must stand."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import binpack, bpe, components, decontaminate, fertility, hashing, lines, quality, relative, shingles, simhash, styletree, surrogates

RANKS, PIECES, WORD = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def source(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


# line dedup


@pytest.mark.parametrize("k", [1, 2, 4])
def test_banded_edit_distance(spark, k):
    r = random.Random(k)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice("abé") for _ in range(r.randint(0, 12)))
        b = list(a)
        for _ in range(r.randint(0, k + 2)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = r.choice(["", "a", "b", "é"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.edits(F.col("a"), F.col("b"), k).alias("d"))
    for a, b, d in df.collect():
        assert min(d, k + 1) == min(levenshtein(a, b), k + 1), (a, b)


def compared(line):
    return "".join(" " if c in "\t\r\x0b\x0c" else c for c in line).strip(" ")


def brute_lines(rows, k=2, least=1, near=10):
    docs = sorted({(d if d is not None else 2**63 - 1, t) for d, t in rows})
    first = {}
    for d, t in docs:
        for line in map(compared, t.split("\n")):
            first[line] = min(first.get(line, d), d)
    long = [x for x in first if len(x) >= near]
    gone, links = set(), Counter()
    for i, a in enumerate(long):
        for b in long[:i]:
            if abs(len(a) - len(b)) <= k and levenshtein(a, b) <= k:
                links[a] += 1
                links[b] += 1
                if first[a] != first[b]:
                    gone.add(max(a, b, key=first.get))
    out = {}
    for d, t in docs:
        seen, kept = set(), []
        for line in t.split("\n"):
            s = compared(line)
            if len(s) >= least and (s in gone or s in seen or first[s] < d):
                continue
            seen.add(s)
            kept.append(line)
        out[d, t] = "\n".join(kept), sum(links[compared(x)] for x in t.split("\n"))
    return out


def test_line_dedup_equals_brute_force(spark, make_prose):
    a, b = make_prose(1, 14), make_prose(2, 14)
    near = a[:20] + "q" + a[21:]
    shorter = b[:30] + b[31:]
    rows = [(1, f"{a}\nshort\n{b}"), (2, f"{near}\nshort\nunique line number two"), (3, f"{shorter}\n{a}"), (4, f"{a}\n{a}\n{make_prose(9, 12)}"), (5, "short\nshort\n\n"), (4, f"other text under one id\n{b}")]
    want = brute_lines(rows)
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert any((r.doc_id, t) in want and want[r.doc_id, t] == (r.text, r.n_links) for d, t in rows if d == r.doc_id), r


def test_short_lines_within_two_edits_go(spark):
    r = random.Random(11)
    rows = [(1, "With to to."), (2, "With, to to.")]
    for i in range(3, 400):
        line = [r.choice("abc ") for _ in range(r.randint(8, 42))]
        rows.append((i, "".join(line)))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(line))
            line[at : at + r.randint(0, 1)] = r.choice(["", "a", "b", "ab"])
        rows.append((1000 + i, "".join(line)))
    want = brute_lines(rows, near=10)
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.text, x.n_links) for x in got} == {(d, *v) for (d, _), v in want.items()}
    assert by_id(lines.dedup(spark.createDataFrame(rows[:2], "doc_id long, text string")))[2].text == ""


def test_the_join_is_exact_for_lines_of_a_few_characters(spark):
    r = random.Random(12)
    rows = [(i, "\n".join("".join(r.choice("abcdef") for _ in range(r.randint(1, 9))) for _ in range(3))) for i in range(150)]
    for near in (3, 5):
        want = brute_lines(rows, near=near)
        got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), near_chars=near).collect()
        assert {(x.doc_id, x.text, x.n_links) for x in got} == {(d, *v) for (d, _), v in want.items()}


def test_white_space_at_the_ends_and_kinds_of_it_do_not_count(spark):
    rows = [(1, "one\r\n\ttwo  words\n }\n\n"), (2, "one\n two \twords\r\n}\n\n\r\nnew")]
    got = by_id(lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1].text == rows[0][1] and got[2].text == "\n\r\nnew" and got[2].n_removed == 3 and got[2].n_lines == 4


def test_letter_counts(spark):
    r = random.Random(13)
    pairs = []
    for _ in range(300):
        a = [r.choice(lines.LETTERS + "xé ") for _ in range(r.randint(0, 136))]
        b = list(a)
        for _ in range(2):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 1)] = r.choice(["", "e", "t", "x"])
        pairs.append(("".join(a), "".join(b)))
    df = lines.with_counts(lines.with_counts(spark.createDataFrame(pairs, "a string, b string"), "a", "x"), "b", "y")
    for row in df.select("a", "x", lines.count_distance(F.col("x"), F.col("y")).alias("d")).collect():
        assert row.x == sum(row.a.count(c) % 8 << 3 * i for i, c in enumerate(lines.LETTERS)) and row.d <= 4


def test_count_distance_is_the_sum_over_all_letters(spark):
    r = random.Random(14)
    top = 2**63 - 1
    pairs = [(r.getrandbits(63), r.getrandbits(63)) for _ in range(500)] + [(0, top), (top, 0), (top, top), (4 << 60, 0), (0, 4 << 57)]
    apart = lambda a, b: sum(min((x - y) % 8, (y - x) % 8) for x, y in zip((a >> 3 * n & 7 for n in range(21)), (b >> 3 * n & 7 for n in range(21))))
    for row in spark.createDataFrame(pairs, "a long, b long").select("a", "b", lines.count_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert row.d == apart(row.a, row.b)


def test_only_lines_that_share_a_key_go_on(spark, make_prose):
    alone = [make_prose(5000 + i, 14) for i in range(40)]
    near, far = alone[0][:20] + "q" + alone[0][21:], alone[1][:60] + make_prose(5100, 8)
    far = (far + "x" * len(alone[1]))[: len(alone[1])]  # as long as the other, which it starts like
    rows = [(i, x) for i, x in enumerate([*alone, *alone[20:], near, far])]
    each = spark.createDataFrame(rows, "doc long, line string").withColumn("h", F.xxhash64("line"))
    line = {x.h: x.line for x in each.collect()}
    met = lines.meeting(each, 2)
    assert {line[x.h] for x in met.collect()} == {alone[0], near, alone[1], far}
    # rows are dealt out by key once, and read twice
    assert "ReusedExchange" in met._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_on_odd_rows(odd, none):
    want = brute_lines([(d, t) for d, t in source(odd)])
    got = lines.dedup(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == sorted((d is None, d or 0, want[d if d is not None else 2**63 - 1, t][0]) for d, t in source(odd))
    assert lines.dedup(none).count() == 0
    kept = lines.texts(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() and kept.filter("text is null").count() == odd.filter("text is null").count()


def test_line_dedup_is_native(odd):
    plan = lines.dedup(odd)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("MapInArrow", "MapInPandas", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"))


# byte-level BPE

CODEC = bpe.codec(RANKS, P.PATTERN, 40, 12)
GENERAL = regex.compile(P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab \n't'srevmld.,é1_ 　中")), max_size=200))
def test_chunks_are_stitched(text):
    assert CODEC.pre.split(text) == GENERAL.findall(text)
    ids = CODEC.encode(text).tolist()
    assert ids == CODEC.base.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = CODEC.encode(text).tolist()
    assert ids == CODEC.base.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


def test_long_runs_cross_chunks():
    for text in ("a" * 500, " " * 500, "a" * 100 + " " * 100 + "'" * 100 + "b", "\n" * 45 + "x" + "\n" * 60):
        assert CODEC.encode(text).tolist() == CODEC.base.encode_ordinary(text)


def test_bpe_query(odd, none):
    got = bpe.digests(odd, RANKS, P.PATTERN).collect()
    base = CODEC.base
    want = sorted((d is None, d or 0, len(i := base.encode_ordinary(t)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in source(odd))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.digests(none, RANKS, P.PATTERN).count() == 0
    assert bpe.texts(odd, RANKS, P.PATTERN).exceptAll(odd).count() == 0


# HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if(a<b)"</p>"</script></head><body><nav><ul><li><a href="/a">Home</a></ul></nav>
<div class="ad">Buy {n}!</div><!-- <p>no</p> --><main><h1>Title &amp; {n}</h1><p>First&nbsp;  one <b>bold<br>x<p>Second {n} &lt;tag&gt;<div class="comments"><p>Reader says</p></div></main><form>Search</form><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert styletree.main_text(PAGE.format(n=7), set()) == "Title & 7\nFirst one bold x\nSecond 7 <tag>"
    assert styletree.main_text("", set()) == "" and styletree.main_text("plain  text\n here", set()) == "plain text here"
    assert styletree.main_text("<p>open <script>never closed <p>x", set()) == "open"
    assert styletree.main_text('<p title="a > b">x < y</p><p class=\'ad-box\'>z', set()) == "x < y"
    assert styletree.main_text("<" * 5000 + '<a "' * 2000, set()).startswith("<<")


def test_text_after_a_script_with_a_less_than_sign_stays():
    script = "<script>for(i=0;i<n;i++){f('</p>')}</script>"
    assert styletree.main_text(f"<p>before</p>{script}<p>after</p><SCRIPT>a<b</Script ><p>end</p>", set()) == "before\nafter\nend"
    assert styletree.main_text("<p>a<style>p>q<r{}</style>b</p><script>x<y</scripts><p>still script</script><p>c", set()) == "ab\nc"
    assert styletree.main_text("<p>open <script>i<n <p>x", set()) == "open"


def test_repeated_branches_go_without_names(spark):
    shell = "<html><body><div class='q1'>Same words on all pages</div><div class='q2'><p>Own text number {n}</p></div><div class='q3'>Two of {m}</div></body></html>"
    rows = [(i, f"http://Host.example:80/{i}", shell.format(n=i, m=i % 2)) for i in range(40)]
    rows += [(100, "http://small.example/", shell.format(n=1, m=1)), (101, None, None), (102, "no address", "<p>x</p>"), (100, "http://small.example/", shell.format(n=1, m=1))]
    got = styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert all(text[i] == f"Own text number {i}" for i in range(40))
    assert text[100] == "Same words on all pages\nOwn text number 1\nTwo of 1" and text[101] == "" and text[102] == "x"
    assert styletree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    wide = [(*r, "c", 1, "p", [1]) for r in rows] + [(103, "http://long.example/", "<p>" + "<b>word</b> " * 200_000, "c", 1, "p", [1])]
    named = styletree.extract(spark.createDataFrame(wide, "page_id long, url string, html string, host string, low long, path string, above array<int>")).collect()
    assert {r.page_id: r.text for r in named if r.page_id != 103} == text and [r.n_chars for r in named if r.page_id == 103] == [999_999]


def test_inline_furniture_and_comments_go_and_names_are_a_prior():
    assert styletree.main_text('<p>Text <span class="ad">Buy <span>now</span></span> on <a class="x" href="/id">link</a></p>') == "Text on link"
    assert styletree.main_text('<p>Text <span hidden>gone</p><p>next</p>') == "Text\nnext"
    assert styletree.main_text("<article><p>Story</p><article><p>First!</p></article><section><article>Me too</article></section></article>") == "Story"
    assert styletree.main_text('<article><p>a</p><div class="related-work">b</div><div class="comments-list">c</div><p class="advice">d</p></article>') == "a\nb\nd"


def test_hints_in_an_article_give_way_to_many_pages(spark):
    page = "<article><p>Story {n} is told</p><div class='notice'>Point {n} of note</div><div class='share'>Tell your friends</div></article>"
    rows = [(i, "https://h.example/a", page.format(n=i)) for i in range(30)] + [(99, "https://other.example", page.format(n=99))]
    got = {r.page_id: r.text for r in styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} is told\nPoint {i} of note" for i in range(30)) and got[99] == "Story 99 is told"


def test_tree_equals_brute_force(spark):
    r = random.Random(9)
    rows = []
    for i in range(40):
        items = "".join(f"<li>{r.choice('abc')}" for _ in range(3))
        kind = r.choice(["<ul>%s</ul>", "<ol>%s</ol>", "<p>%s"])
        rows.append((i, f"http://{'ab'[i % 3 == 0]}.example/", f"<body><div class='x{i}'>{kind % items}<p>{r.choice(['same', str(i)])}</p></div><div id=y>{r.randint(0, 2)}<p>t</div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(x.host, x.path): (x.n_pages, x.importance) for x in styletree.tree(df.select(styletree.host(F.col("url")).alias("host"), "html")).collect()}
    want = {}
    for host in {u for _, u, _ in rows}:
        pages = [styletree.seen(h) for _, u, h in rows if u == host]
        nodes = {n.path: n for p in pages for n, *_ in p}
        on = {q: sum(any(n.path == q and k == styletree.PAGE for n, k, *_ in p) for p in pages) for q in nodes}
        for q in nodes:
            texts = Counter((n.path, v, size) for p in pages for n, k, v, size in p if k == styletree.CONTENT and q in n.above)
            if not texts or on[q] < 2:
                continue
            total = sum(size * c for (_, _, size), c in texts.items())
            content = 1 - sum(size * c * np.log(c) / np.log(on[path]) for (path, _, size), c in texts.items() if on[path] > 1) / total
            styles = Counter(v for p in pages for n, k, v, _ in p if k == styletree.LAYOUT and n.path == q)
            shares = [c / sum(styles.values()) for c in styles.values()]
            layout = -sum(x * np.log(x) for x in shares) / np.log(on[q])
            w = styletree.GAMMA ** len(styles)
            want[host[7:-1], q] = on[q], (1 - w) * layout + w * content
    got = {k: v for k, v in got.items() if v[0] > 1}
    assert set(got) == set(want) and len(got) > 12
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_the_tree_finds_the_text_of_pages_without_telling_names(spark, make_prose):
    """Nameless divs alone: menus, adverts and footers come back on the pages of a host, articles don't."""
    r, rows, want = random.Random(21), [], {}
    for h in range(6):
        menu = "".join(f"<li>{make_prose(500 + 10 * h + i, 2)}" for i in range(6))
        adverts = [make_prose(600 + 10 * h + i, 9) for i in range(3)]
        foot = make_prose(700 + h, 8)
        for n in range(30):
            story = [make_prose(10_000 + 100 * (30 * h + n) + i, r.randint(5, 60)) for i in range(r.randint(1, 6))]
            own = "".join(f"<p>{p}</p>" for p in story)
            rows.append((len(rows), f"http://h{h}.example/{n}", f"<html><body><div class=a><ul>{menu}</ul></div><div class=b>{r.choice(adverts)}</div><div class=c><div>{own}</div></div><div class=d>{foot}</div></body></html>"))
            want[rows[-1][0]] = "\n".join(story)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in styletree.extract(df).collect()}
    uncut = {x.page_id: x.text for x in styletree.extract(df, low=0.0, low_inside=0.0).collect()}
    assert sum(got[i] != uncut[i] for i in want) == len(want)  # pages that the tree changes
    kept = sum(len(set(got[i].split("\n")) & set(t.split("\n"))) for i, t in want.items())
    assert kept >= 0.99 * sum(len(set(t.split("\n"))) for t in want.values())  # recall of blocks
    assert kept >= 0.99 * sum(len(set(t.split("\n"))) for t in got.values())  # precision


# quality classifier


def test_quality_learns_and_generalises(spark, make_prose):
    docs = [(i, make_prose(i, 60) if i % 3 else " ".join(w.upper() + "!!" for w in make_prose(i, 60).split()), "s") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(999, 1, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels.filter(~quality.held_out()))
    got = by_id(quality.score(df, model))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i].score >= 0.5) == (i % 3 > 0) for i in held]) > 0.98
    again = by_id(quality.score(df, quality.train(df, labels.filter(~quality.held_out()))))
    assert all(got[i].score == again[i].score for i in range(400))


def test_fit_equals_brute_force():
    """Ratios and the hinge loss by plain definitions: no single weight of a row can be moved to a lower dual objective."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(60)]
    labels = np.array([int(20 <= r.mean()) for r in rows])
    p, q = np.ones(quality.SIZE), np.ones(quality.SIZE)
    for r, y in zip(rows, labels):
        for x in r:
            (p if y else q)[x] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    signs, cost = np.where(labels == 1, 1.0, -1.0), np.ones(60)
    w, bias = quality.fit_hinge(rows, np.arange(60), ratio, signs, cost, rounds=400)
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
        x[i, 40] = 1.0
    primal = lambda v: 0.5 * v @ v + np.maximum(0, 1 - signs * (x @ v)).sum()
    found = np.append(w[:40], bias)
    assert all(primal(found) <= primal(found + rng.normal(0, s, 41)) + 1e-3 for s in (0.01, 0.1, 0.5) for _ in range(200))
    many = np.zeros(quality.SIZE, dtype=bool)
    many[::3] = True
    kept = quality.Rows([quality.packed(many), quality.packed(np.arange(quality.SIZE) < 7)])
    assert kept[0].tolist() == np.flatnonzero(many).tolist() and kept[1].tolist() == list(range(7)) and max(map(len, kept.grams)) <= quality.SIZE // 8


def test_quality_on_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    assert quality.score(odd, model).count() == odd.count() and quality.score(odd, model).filter("score between 0 and 1").count() == odd.count()
    assert quality.score(none, model).count() == 0
    one = quality.train(odd, labels.filter("quality = 1"))
    assert {round(r.score, 9) for r in quality.score(odd, one).collect()} == {round((2 + 2) / (3 + 2), 9)}  # three rows, two ids: the repeat counts
    assert quality.train(none, labels).score(np.zeros(quality.SIZE, bool)) == 0.5


# substring dedup


def brute_spans(rows, window):
    first = {}
    for d, t in rows:
        w = t.encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = t.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def test_substring_dedup_equals_brute_force(spark):
    r = random.Random(3)
    passages = [[r.choice("abcdefgh") for _ in range(40)] for _ in range(4)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randint(0, 4)):
            w += [r.choice("abcdefgh") for _ in range(r.randint(0, 15))]
            p = r.choice(passages)
            at = r.randint(0, 20)
            w += p[at : at + r.randint(5, 40)]
        rows.append((i // 2 if i < 10 else i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for window, anchor in ((10, 3), (6, 6), (8, 1)):
        got = sorted((x.doc_id, x.n_words, x.n_removed, bytes(x.kept)) for x in relative.dedup(df, window, anchor).collect())
        assert got == brute_spans(rows, window)
        texts = {(x.doc_id, x.copy): x.text.split() for x in relative.prepared(df, "doc_id", "text").collect()}
        covered = {k: set() for k in texts}
        for x in relative.factors(df, window, anchor).collect():
            own, source = texts[x.doc, x.copy], texts[x.source, x.source_copy]
            assert x.source < x.doc and x.n_words >= window
            assert own[x.start : x.start + x.n_words] == source[x.source_start : x.source_start + x.n_words] and x.start + x.n_words <= len(own)
            covered[x.doc, x.copy] |= set(range(x.start, x.start + x.n_words))
        assert {(d, len(texts[d, c]), len(v)) for (d, c), v in covered.items()} == {x[:3] for x in brute_spans(rows, window)}


def test_seeds_grow_along_their_diagonal():
    s = [{"start": a, "n": n, "source": d, "source_copy": 0, "source_start": p} for a, n, d, p in ((7, 1, 1, 17), (0, 5, 1, 10), (5, 2, 1, 15), (8, 1, 2, 18), (9, 1, 2, 30))]
    assert relative.extended(s, 10) == [(0, 17, 1, 0, 10), (8, 10, 2, 0, 18), (9, 10, 2, 0, 30)]


def test_words_are_hashed_in_parts():
    r = random.Random(8)
    texts = ["".join(r.choice("ab\u00e9 \n") for _ in range(r.randint(0, 90))) for _ in range(60)] + ["", "x" * 300, " "]
    data, offsets = hashing.text_bytes(pa.array(texts))
    starts, ends, first = hashing.words(data, offsets)
    for step in (1, 7, 64, 10**6):
        a, b, keys, c = hashing.word_table(data, offsets, step)
        assert a.tolist() == starts.tolist() and b.tolist() == ends.tolist() and c.tolist() == first.tolist()
        assert keys.tolist() == hashing.word_hashes(data, starts, ends).tolist()


def test_substring_dedup_on_odd_rows(odd, none):
    rows = [(2**63 - 1 if d is None else d, t) for d, t in source(odd)]
    got = sorted((2**63 - 1 if x.doc_id is None else x.doc_id, x.n_words, x.n_removed, bytes(x.kept)) for x in relative.dedup(odd).collect())
    assert got == brute_spans(rows, 50)
    assert relative.dedup(none).count() == 0


# decontamination


def test_leaks_within_the_budget_are_found(spark, make_prose):
    r = random.Random(5)
    items = [(i, make_prose(100 + i, 30)) for i in range(12)] + [(50, ""), (51, None), (52, "short"), (0, make_prose(100, 30))]
    docs = []
    for i, t in items[:12]:
        part = list(t[:160])
        for _ in range(decontaminate.edit_budget(160, decontaminate.ERRORS, decontaminate.Q)):
            at = r.randrange(len(part))
            part[at : at + r.randint(0, 1)] = r.choice(["", "q", "z"])
        docs.append((i, make_prose(i, 50) + " " + "".join(part) + "\n" + make_prose(i + 40, 20)))
    docs += [(100 + i, make_prose(500 + i, 200)) for i in range(30)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 300):
        found = decontaminate.leaks(df, bench, block_bytes=size).collect()
        assert {(x.doc_id, x.item_id) for x in found} == {(i, i) for i in range(12)}
    assert {x.doc_id for x in decontaminate.clean(df, bench, block_bytes=300).collect()} == set(range(100, 130))


def test_excerpts_of_thirteen_words_are_found(spark, make_prose):
    item = make_prose(900, 60).split()
    docs = [(i, f"{make_prose(i, 40)} {' '.join(item[i : i + 13])} {make_prose(i + 70, 40)}") for i in range(0, 48)] + [(100, make_prose(901, 200))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {x.doc_id for x in decontaminate.leaks(df, bench).collect()} == set(range(48))
    assert {x.doc_id for x in decontaminate.clean(df, bench).collect()} == {100}


def test_short_items_stand_as_whole_words_and_long_texts_are_cut(spark, make_prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 700)
    items = [(1, "Two  words"), (2, "elevenbytes"), (3, make_prose(950, 30)), (4, "x")]
    docs = [(1, "here two words stand"), (2, "two wordsmiths"), (3, "elevenbytes"), (4, "eleven bytes, or elevenbytesx"), (5, make_prose(951, 500) + " two\nWORDS")]
    docs += [(100 + i, f"{make_prose(952, i)} {make_prose(950, 30)} {make_prose(953, 400)}") for i in range(0, 120, 7)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontaminate.leaks(df, bench).collect()}
    assert found == {(1, 1), (3, 2), (5, 1)} | {(d, 3) for d, _ in docs if d >= 100}
    same = np.frombuffer(b"a" * 5000, dtype=np.uint8)
    index = decontaminate.Items([(1, b"a" * 300)], decontaminate.Q, decontaminate.REGION, decontaminate.ERRORS)
    assert index.hits(same) and not index.hits(np.frombuffer(b"ab" * 2500, dtype=np.uint8))


def test_decontamination_equals_brute_force(spark, make_prose):
    """Every region of every item against every text, by the plain table of edits."""
    r = random.Random(15)

    def least_edits(region, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(region, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    items = [(i, make_prose(960 + i, 16)) for i in range(4)]
    docs = []
    for i in range(24):
        part = list(items[i % 4][1][r.randint(0, 20) : r.randint(60, 130)])
        for _ in range(r.randint(0, 9)):
            at = r.randrange(len(part))
            part[at : at + r.randint(0, 1)] = r.choice(["", "q", "zz"])
        docs.append((i, f"{make_prose(970 + i, 4)} {''.join(part)} {make_prose(990 + i, 3)}"))
    index = decontaminate.Items([(i, decontaminate.normal(t)) for i, t in items], decontaminate.Q, decontaminate.REGION, decontaminate.ERRORS)
    want = {(d, item) for d, t in docs for item, _, region, budget in index.regions if least_edits(region.tobytes(), decontaminate.normal(t)) <= budget}
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want and 4 < len(want) < 24


def test_decontamination_on_odd_rows(odd, none, spark):
    bench = spark.createDataFrame([(1, odd.filter("doc_id = 1").first().text[:300])], "item_id long, text string")
    assert {x.doc_id for x in decontaminate.leaks(odd, bench).collect()} == {1, 2}
    assert decontaminate.clean(odd, bench).count() == odd.count() - 3 and decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(odd, bench.filter("false")).count() == 0


def test_alignment_is_the_least_within_the_band():
    r = random.Random(8)
    for _ in range(200):
        a = bytes(r.choice(b"ab") for _ in range(r.randint(1, 12)))
        t = bytes(r.choice(b"ab") for _ in range(r.randint(1, 20)))
        want = min(levenshtein(a, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        got = decontaminate.aligned(np.frombuffer(a, np.uint8), np.frombuffer(t, np.uint8), -len(a), len(t) + 2 * len(a) + 1, 4)
        assert got == (want if want <= 4 else None)


def test_regions_side_by_side_are_aligned_as_one_by_one(monkeypatch):
    r = random.Random(9)
    for side in (1 << 16, 150):
        monkeypatch.setattr(decontaminate, "SIDE", side)
        for _ in range(60):
            t = np.frombuffer(bytes(r.choice(b"abc") for _ in range(r.randint(1, 90))), np.uint8)
            asked = []
            for _ in range(r.randint(0, 12)):
                at, budget = r.randint(-9, len(t)), r.randint(0, 3)
                region = bytearray(t[max(0, at) : max(0, at) + r.randint(1, 40)].tobytes() or b"c")
                for _ in range(r.randint(0, 4)):
                    region[r.randrange(len(region))] = r.choice(b"abc")
                asked.append((np.frombuffer(bytes(region), np.uint8), at - r.randint(0, 9), 6 * budget + 2, budget))
            assert decontaminate.aligned_all(asked, t) == [decontaminate.aligned(a, t, *rest) for a, *rest in asked]
    long = np.frombuffer(bytes(r.choice(b"abc") for _ in range(20_000)), np.uint8)
    other = long.copy()
    other[[5, 9_000, 15_000]] = ord("z")
    assert decontaminate.aligned_all([(other, -8, 26, 4), (other, -8, 26, 2), (long, -8, 26, 4)], long) == [3, None, 0]


# surrogates


def test_surrogates_are_consistent_and_typed(spark):
    rows = [
        (1, "Mail jo.19@mail5.example.com or JO.19@mail5.example.com, call +1 (521) 555-6210 or +1 521 555 6210, card 4111 1111 1111 1111."),
        (2, "Mr. John Smith met Mary Smith and Иван Петров at 10.1.2.3; token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" 123-45-6789"),
        (3, "JO.19@mail5.example.com again, 4111111111111111 too, 4111111111111112 is not valid"),
        (4, None), (5, ""), (None, "(521) 555-6210"), (6, "12.5 2020-01-01 a@b Smith 1234567 nothing here"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(surrogates.replace(df, "k"))
    one, two, three = got[1].text, got[2].text, got[3].text
    mails = regex.findall(r"[\w.]+@[\w.]+\w", one)
    assert len(set(mails)) == 1 and mails[0] in three and "jo.19" not in one.lower()
    phones = regex.findall(r"\+1[ ()\d-]+\d", one)
    assert len({regex.sub(r"\D", "", p) for p in phones}) == 1 and regex.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0])
    card = regex.search(r"\d{4} \d{4} \d{4} \d{4}", one)[0]
    luhn = lambda d: sum(sum(divmod(int(c) * (2 - i % 2), 10)) if (i % 2 == 0) else int(c) for i, c in enumerate(d)) % 10 == 0
    assert card.replace(" ", "") in three and card[0] == "4" and luhn(card.replace(" ", ""))
    numbers = regex.findall(r"(?<!\d)\d{16}(?!\d)", three)
    assert luhn(numbers[0]) and not luhn(numbers[1]) and numbers[0] != numbers[1]
    people = regex.search(r"Mr\. (\w+) (\w+) met (\w+) (\w+) and (\p{IsCyrillic}+) (\p{IsCyrillic}+) at", two)
    assert people and people[2] == people[4] != "Smith"
    assert people[1] in surrogates.NAMES["latin"]["m"] and people[3] in surrogates.NAMES["latin"]["f"] and people[5] in surrogates.NAMES["cyrillic"]["m"]
    assert regex.search(r'token = "[0-9a-f]{40}" \d{3}-\d{2}-\d{4}$', two) and "24be64439e3e" not in two
    assert got[4].text == "" and got[5].text == "" and got[6].text == rows[-1][1] and got[None].text != rows[5][1]
    assert by_id(surrogates.replace(df, "k"))[1].text == one and by_id(surrogates.replace(df, "other"))[1].text != one


def test_colliding_surrogates_are_drawn_again(spark, monkeypatch):
    real = surrogates.surrogate
    clash = lambda value, of, key, attempt: F.when((of == "email") & (attempt == 0), F.lit("same@x.example.com")).otherwise(real(value, of, key, attempt))
    monkeypatch.setattr(surrogates, "surrogate", clash)
    df = spark.createDataFrame([(i, f"to user{i}@a.example.org and user{i % 3}@a.example.org") for i in range(12)], "doc_id long, text string")
    got = by_id(surrogates.replace(df, "k"))
    names = {}
    for i in range(12):
        a, b = regex.findall(r"\w+@[\w.]+\w", got[i].text)
        assert names.setdefault(i, a) == a and names.setdefault(i % 3, b) == b
    assert len(set(names.values())) == 12


def test_digit_permutations_are_one_to_one(spark):
    df = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    assert df.select(surrogates.permuted(F.col("d"), [F.lit("k")]).alias("p")).distinct().count() == 10_000


def test_surrogates_on_odd_rows(odd, none):
    assert surrogates.replace(odd, "k").count() == odd.count() and surrogates.replace(none, "k").count() == 0
    plan = surrogates.replace(odd, "k")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("MapInArrow", "MapInPandas", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"))


# packed ids


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20).flatmap(lambda bits: st.tuples(st.just(bits), st.lists(st.lists(st.integers(0, 2**bits - 1), max_size=60), max_size=12))))
def test_images_give_back_what_was_packed(case):
    bits, docs = case
    image = binpack.Image(binpack.write_image(list(range(len(docs))), [np.array(d, dtype=np.uint32) for d in docs], bits, 16))
    flat = [x for d in docs for x in d]
    assert [image.document(i).tolist() for i in range(len(docs))] == docs
    for start in range(0, len(flat), 7):
        assert image.ids(start, min(len(flat), start + 20)).tolist() == flat[start : start + 20]


MODEL = binpack.model(WORD)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list("ab 's\n.,éÉß12—'Σ中й́")), st.characters(codec="utf-8")), max_size=25))
def test_word_bpe_is_the_library(text):
    assert MODEL.encode(text) == MODEL.library(text)


def test_packing_query(odd, none):
    got = binpack.digests(binpack.write(odd, WORD, 1, file_ids=500)).collect()
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    rows = sorted(((2**63 - 1 if d is None else d, signed(t), t) for d, t in source(odd)))
    start, want = 0, []
    for d, _, t in rows:
        ids = MODEL.library(t) + b"\1\0\0\0"
        want.append((None if d == 2**63 - 1 else d, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert binpack.digests(binpack.write(none, WORD, 1)).count() == 0


def test_images_are_read_and_summed_by_one_worker(odd):
    files = binpack.write(odd, WORD, 1, file_ids=500)
    digests = binpack.digests(files)
    assert digests._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    ids = {(r.shard, r.part, r.doc_id, r.place): (r.n_tokens, zlib.crc32(r.ids)) for r in binpack.read(files).collect()}
    assert sorted(ids.values()) == sorted((r.n_tokens, r.ids_crc32) for r in digests.collect()) and len(ids) == odd.count()


# quality rules


def brute_base(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if regex.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(regex.findall(r"[#*$%&|<>]", text)), dups, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def test_base_rules_equal_brute_force(odd, none, spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice(["a", "b", "é", " ", " ", "\n", "\x0b", "\x85", " ", "#", "|"]) for _ in range(r.randint(0, 300)))) for i in range(60)]
    extra = spark.createDataFrame([(*x, None) for x in rows], "doc_id long, text string, lang string")
    for df in (odd, extra):
        got = fertility.measure(df, RANKS, P.PATTERN, PIECES).collect()
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(((d, *brute_base(t)) for d, t in source(df)), key=key)
        assert not any(r.kept and r.base_failed for r in got)
    assert fertility.measure(none, RANKS, P.PATTERN, PIECES).count() == 0
    kept = fertility.keep(odd, RANKS, P.PATTERN, PIECES)
    assert kept.columns == odd.columns and kept.count() == fertility.measure(odd, RANKS, P.PATTERN, PIECES).filter("kept").count()


def test_verdict_equals_the_libraries(spark):
    """Measures and verdict from the libraries' own encodings."""
    import sentencepiece

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces, base = sentencepiece.SentencePieceProcessor(model_file=PIECES), bpe.codec(RANKS, P.PATTERN).base
    got = by_id(fertility.measure(docs, RANKS, P.PATTERN, PIECES))
    space = {f"<0x{ord(c):02X}>" for c in fertility.SPACES}
    for row in docs.collect():
        text, r = row.text or "", got[row.doc_id]
        words = regex.findall(r"[^\x20\x09-\x0D]+", text)
        ids = base.encode_ordinary(text)
        counts = Counter(ids)
        entropy = -sum(c / len(ids) * np.log2(c / len(ids)) for c in counts.values()) / np.log2(len(ids)) if len(ids) > 1 else 0.0
        per_token = sum(map(len, words)) / len(ids) if ids and words else 0.0
        bytes_ = sum(pieces.is_byte(i) and pieces.id_to_piece(i) not in space for i in pieces.encode(text))
        fallback = bytes_ / len(text.encode()) if ids and words else 0.0
        assert abs(r.chars_per_token - per_token) < 1e-9 and abs(r.fallback_share - fallback) < 1e-9
        assert abs(r.token_entropy - (entropy if words else 0.0)) < 1e-9
        low, high, most, least = fertility.BANDS[row.lang if row.lang in fertility.BANDS else fertility.script(text)]
        assert r.kept == (not r.base_failed and low <= per_token <= high and fallback <= most and entropy >= least)


def test_byte_fallback_is_that_of_the_pieces():
    m = fertility.meter(RANKS, P.PATTERN, PIECES)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ("plain words", "𓀀𓀁 and ☃", "é中文 ok"):
        bytes_ = sum(sp.is_byte(i) for i in sp.encode(text))
        assert m.fertility(text, len(text))[1] == pytest.approx(bytes_ / len(text.encode()))


# SimHash


def brute_components(prints, ids, radius):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if ids[i] == ids[j] or sum(int(a ^ b).bit_count() for a, b in zip(prints[i], prints[j])) <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(ids)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least[root(i)] for i in range(len(ids))]


def test_simhash_equals_brute_force(odd, none, spark, make_prose, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 4)
    monkeypatch.setattr(simhash, "SPLIT", 6)
    r = random.Random(6)
    rows = []
    for i in range(120):
        w = make_prose(i // 8, 80).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice("xyz")
        rows.append((i * 7 % 120, " ".join(w)))
    df = spark.createDataFrame(rows + [(500, ""), (501, None), (502, "One two"), (503, "one TWO")], "doc_id long, text string")
    got = simhash.digests(simhash.near_duplicates(df)).collect()
    data = source(df)
    prints = simhash.fingerprint_batch(pa.array([t for _, t in data]), 4, 1)
    want = dict(zip((d for d, _ in data), brute_components(prints, [d for d, _ in data], 4)))
    assert {x.doc_id: x.component_id for x in got} == want and len(set(want.values())) < len(want)
    assert {x.doc_id: x.fingerprint for x in got} == {d: f"{int(p[0]):016x}" for (d, _), p in zip(data, prints)}
    assert want[501] == 500 and want[503] == 502
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(none).count() == 0


def test_fingerprint_definition():
    import xxhash

    for text in ("", "A b", "The quick brown fox jumps over THE lazy dog " * 3, "é É x"):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(low[i : i + 4]), 42) for i in range(max(1, len(low) - 3))] if low else []
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert int(simhash.fingerprint_batch(pa.array([text]), 4, 1)[0, 0]) == want


@pytest.mark.parametrize(("bits", "groups", "reach"), [(64, 3, 1), (192, 12, 1), (64, 2, 2)])
def test_forest_meets_all_pairs_within_reach(bits, groups, reach):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, (300, bits // 64), dtype=np.uint64)
    y = x.copy()
    for row in y:
        for b in rng.choice(bits, rng.integers(0, 6), replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    prints = np.concatenate([x, y])
    forest = simhash.Forest(bits, groups, reach, 5)
    met = set()
    for rows, shard, home in forest.shards(prints):
        for s in np.unique(shard):
            inside = shard == s
            met |= {(min(a, b), max(a, b)) for a in rows[inside] for b in rows[inside & home]}
    for g in range(groups):
        values = forest.group(prints, g)
        near = np.bitwise_count(values[:, None] ^ values[None]) <= reach
        assert {(i, j) for i, j in zip(*np.nonzero(near)) if i < j} <= met


def test_one_of_each_group_stays(spark, make_prose, odd):
    base = make_prose(77, 300).split()
    near = base.copy()
    near[40] = "changed"
    rows = [(5, " ".join(base), "a"), (9, " ".join(near), "b"), (2, make_prose(78, 300), "c"), (9, " ".join(near), "b"), (None, " ".join(base), "d")]
    got = shingles.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _id string"))
    assert got.columns == ["doc_id", "text", "_id"] and sorted((r.doc_id or -1) for r in got.collect()) == [-1, 2, 5]
    assert shingles.one_of_each(odd).columns == odd.columns


def test_one_of_each_goes_by_the_similarity_of_shingles(spark, make_prose):
    r, rows = random.Random(12), []
    for i in range(60):
        w = [f"{x}{r.randint(0, 999)}" for x in make_prose(2000 + i, 200).split()]
        rows.append((2 * i, " ".join(w)))
        for at in r.sample(range(len(w)), r.randint(2, 22)):
            w[at] = "new"
        rows.append((2 * i + 1, " ".join(w)))
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    near = {b for (a, x), (b, y) in zip(rows[::2], rows[1::2]) if len(grams(x) & grams(y)) >= 0.8 * (len(grams(x)) * len(grams(y))) ** 0.5}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id for x in shingles.one_of_each(df).collect()}
    assert 5 < len(near) < 55 and got == {d for d, _ in rows} - near
    assert {x.id for x in shingles.families(df, exhaustive=True).collect() if x.id == x.family} == got


def test_no_pair_is_left_out_by_fingerprints_or_for_a_want_of_least_hashes(spark, monkeypatch):
    rng = np.random.default_rng(24)
    texts = []
    for r in rng.integers(0, 5000, size=(30000, 28)):
        w = [f"w{i}" for i in r]
        texts += [" ".join(w[:24]), " ".join(w[:20] + w[24:])]  # they share 16 of 20 shingles
    found, sizes = shingles.shingles(pa.array(texts, pa.large_string()), 5)
    lead = np.cumsum(sizes) - sizes
    keys = [np.minimum.reduceat(shingles.lane(found, shingles.LANES + i), lead) for i in range(8)]
    alone = np.flatnonzero(~np.any([k[::2] == k[1::2] for k in keys], axis=0))  # the first eight least hashes all differ
    at = [*alone.tolist(), 0, 1, 2]
    assert len(alone)
    rows = [(2 * i + j, texts[2 * i + j]) for i in at for j in (0, 1)]
    monkeypatch.setattr(shingles, "RADIUS", 5)
    got = {x.doc_id for x in shingles.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2 * i for i in at}


@pytest.mark.parametrize("split", [7, 4096])
def test_one_of_each_compares_all_that_can_be_linked(spark, make_prose, monkeypatch, split):
    """Groups of texts about at the bound, where the nearest rows of other families are often not within it."""
    monkeypatch.setattr(shingles, "SPLIT", split)
    r, rows = random.Random(31), []
    for i in range(4):
        base = [f"{x}{r.randint(0, 999)}" for x in make_prose(4000 + i, 200).split()]
        for j in range(40):
            w = base.copy()
            for at in r.sample(range(len(w)), r.randint(3, 7)):
                w[at] = f"new{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    least = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if least[a] != least[b] and len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5:
                low, high = sorted((least[a], least[b]))
                least = [low if x == high else x for x in least]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert 20 < len(set(least)) < 140
    assert {x.id: x.family for x in shingles.families(df).collect()} == dict(enumerate(least))
    assert {x.doc_id for x in shingles.one_of_each(df).collect()} == set(least)


def test_components(spark):
    links = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (None, 3), (20, 1), (1, 2)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# hashes


def test_words_never_reach_over_texts():
    data, offsets = hashing.text_bytes(pa.array(["ab c", "", "d", " e\x85f\n", "g"]))
    starts, ends, first = hashing.words(data, offsets)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert words == [b"ab", b"c", b"d", "e\x85f".encode(), b"g"] and first.tolist() == [0, 2, 2, 3, 4, 5]


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 1000, 60)
    for width in (1, 2, 3, 7, 43):
        assert hashing.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]


# very long texts


def test_very_long_texts(spark, make_prose):
    """A text of some MB beside short ones, whole or as one line or one word, through all operators on documents."""
    words = make_prose(3000, 20_000).split()
    long = "\n".join([" ".join(words[i : i + 400] + [str(i)]) for i in range(0, 20_000, 400)] * 12)
    rows = [(1, long, "en"), (2, long.replace("\n", " "), "en"), (3, "x" * 600_000, "en"), (4, make_prose(3001, 60), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    bench = spark.createDataFrame([(1, " ".join(words[500:540]))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(df, bench).collect()} == {1, 2}
    assert by_id(bpe.encode(df, RANKS, P.PATTERN))[1].decoded == long.encode()
    assert by_id(fertility.measure(df, RANKS, P.PATTERN, PIECES))[1].n_dup_lines == 11 * 50
    assert simhash.near_duplicates(df).count() == 4 and {r.doc_id for r in shingles.one_of_each(df).collect()} == {1, 3, 4}
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in relative.dedup(df).collect()}
    assert removed[1][1] == 0 and removed[2] == (removed[1][0], removed[1][0]) and removed[3] == (1, 0)
    assert by_id(lines.dedup(df))[1].n_removed == 11 * 50
    assert surrogates.replace(df, "k").count() == 4 and binpack.digests(binpack.write(df, WORD, 1)).count() == 4
    assert quality.score(df, quality.fit([np.array([1, 2]), np.array([3])], np.array([0, 1]))).count() == 4
