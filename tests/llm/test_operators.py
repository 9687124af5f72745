"""The training-text operators: fixtures, brute force, and the hard inputs each must take."""

import os
import random
import re
import unicodedata
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from docloom.llm import boilerplate, leakage, markup, mixing, near_duplicates, personal, repeated_lines, sentences, splitting
from tests.conftest import SMALL

TOKENIZER = os.environ.get("DOCLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
LONG = "Some long text with words and more words. " * 30_000  # 1.26 million characters


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def docs(spark, texts, **more):
    extra = "".join(f", {k} string" for k in more)
    return spark.createDataFrame([(f"d{i}", t, *(v[i] if isinstance(v, list) else v for v in more.values())) for i, t in enumerate(texts)], f"doc_id string, clean_text string{extra}")


# ---- 1: page furniture ---------------------------------------------------------------------------------------------
PAGE = """Skip to main content
Home | Guides | Reference
Acme / Tools / Parser
Read the pending template with make_parser
Tags
Read the pending template with make_parser
Every session owns a schema and an atomic payload, which the worker reads when it is asked for it.
Share this page with your team: Copy link, Email
• Call parser.read() before the batch is shared.
x = make_parser(limit=3)
Notes
The option limits the reducer to twelve columns, and nothing else can change it while it is running.

Last built on 2024-01-02 with tool 3.1
© 2024 The Acme Project. All rights reserved.
Other pages and make_reader"""


def test_furniture():
    assert boilerplate.furniture_lines(PAGE) == [1, 2, 3, 4, 5, 8, 14, 15, 16]
    assert boilerplate.furniture_lines(None) == [] and boilerplate.furniture_lines("") == [] and boilerplate.furniture_lines("\n \n") == []
    assert boilerplate.furniture_lines(LONG) == []


def test_links_of_raw_html_decide(spark):
    text = "Plain words of a heading\nThe first paragraph says what there is to say about this thing, and then it ends.\nPlain words of a heading"
    html = '<html><body><div><a href="/x">Plain words of a heading</a></div>\n<p>The first paragraph says what there is.</p></body></html>'
    assert boilerplate.link_blocks(html) == [boilerplate.line_key("Plain words of a heading")]
    d = docs(spark, [text, text, text, None, ""], raw_file_path=["p", "p", None, None, "q"])
    pages = spark.createDataFrame([("p", html), ("p", html), (None, html), ("q", None)], "raw_file_path string, html string")
    found = boilerplate.boilerplate_lines(d.union(d.limit(1)), pages)
    assert ("d0", 1) in rows(found, "doc_id", "line_no") and found.count() == found.distinct().count()
    assert {r["doc_id"] for r in found.collect()} <= {"d0", "d1", "d2"}


def test_navigation_of_any_length_and_over_lines():
    key = boilerplate.line_key
    legal = "This text of the law is long and it says what the reader may do with the pages of the site when they are read. " * 6
    menu = [f"Entry {k} of the menu which leads to a page" for k in range(12)]
    page = (
        "<body><nav><ul>\n" + "\n".join(f"<li><a href='/{k}'>{x}</a></li>" for k, x in enumerate(menu)) + "\n</ul></nav>\n<article><header>\n<p>The page begins with this.</p>\n</header><p>A paragraph with <a href='x'>one link</a> in it.</p></article>\n"
        + "<ul>\n<li><a href='/r'>A related page</a></li>\n</ul>\n<header>\n<h1>Title of the page</h1>\n</header>\n<footer>\n<p>" + legal + "</p>\n</footer>\n<aside>\n<p>After an element that is never closed.</p></body>"
    )
    marked = set(boilerplate.link_blocks(page))
    assert {key(legal), key("A related page"), *map(key, menu)} <= marked
    assert not marked & {key("The page begins with this."), key("A paragraph with one link in it."), key("Title of the page"), key("After an element that is never closed.")}
    assert boilerplate.furniture_lines(f"A sentence that is of the page and ends here.\n{legal}", list(marked)) == [2]


def test_cues_and_menus_of_any_length():
    menu = " | ".join(f"Part {k} of it" for k in range(30))
    rights = "© 2024 The Acme Project. " + "No part of this site may be copied by those who do not have the right to do so. " * 4
    body = "The worker sets a cookie when the page is opened and reads it when the page is closed, so that the state of it is known. " * 3
    assert boilerplate.furniture_lines(f"{menu}\n{body}\n{rights}") == [1, 3]


def test_main_body_keeps_rows_and_columns(spark):
    d = docs(spark, [PAGE, None, ""], furniture=["a", "b", "c"], key="k", links="l", path="p")
    out = boilerplate.main_body(d, None)
    assert out.columns == d.columns and out.count() == 3
    assert "cookie" not in out.orderBy("doc_id").first()["clean_text"] and "Every session owns" in out.orderBy("doc_id").first()["clean_text"]
    assert boilerplate.boilerplate_lines(d.limit(0), None).count() == 0


def test_rows_of_one_id_are_judged_each_by_its_text(spark):
    own, other = "Home | Guides | Reference\nThis is the body of the first text, which is as long as it must be.", "This is the other text of the same id, and it is all body.\nHome | Guides | Reference"
    d = spark.createDataFrame([("x", own), ("x", other), (None, own), (None, None)], "doc_id string, clean_text string")
    got = sorted(r["clean_text"] or "" for r in boilerplate.main_body(d).collect())
    assert got == sorted(["", own.split("\n")[1], own.split("\n")[1], other.split("\n")[0]])


def learned_pages(n):
    """Pages whose furniture says things that no phrase list knows, with their HTML."""
    body = ["The worker reads the payload when it is asked for it, and then it writes the schema.", "Every session owns a table which the reader opens before the batch is closed."]
    lines = ["Zorble wumpkin frand", "Brindle the quonk of your friends for a while and more", *body, "Snarfle this with everyone you know"]
    html = "<body><nav><a href='/1'>{}</a></nav>\n<nav><a href='/2'>{}</a></nav>\n<p>{}</p>\n<p>{}</p>\n<footer>{}</footer></body>".format(*lines)
    return "\n".join(lines), html


def test_link_density_is_learned_for_pages_without_html(spark):
    text, page = learned_pages(0)
    d = spark.createDataFrame([(f"d{k}", f"{text}\nThe end of page {k} is a sentence of its own.", f"p{k}" if k < 12 else None) for k in range(16)], "doc_id string, clean_text string, raw_file_path string")
    pages = spark.createDataFrame([(f"p{k}", page) for k in range(12)], "raw_file_path string, html string")
    found = set(rows(boilerplate.boilerplate_lines(d, pages), "doc_id", "line_no"))
    assert found == {(f"d{k}", i) for k in range(16) for i in (1, 2, 5)}
    # without HTML nothing tells them from headings and sentences
    assert ("d15", 2) not in set(rows(boilerplate.boilerplate_lines(d, None), "doc_id", "line_no"))


def test_long_pages_are_linear():
    import time

    took = []
    for n in (4000, 16000):
        text = "\n".join(f"Entry {k} of it" for k in range(n))
        began = time.perf_counter()
        boilerplate.furniture_lines(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


# ---- 2: splitting --------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("text", ["word " * 500, "x" * 3000, "A sentence ends. " * 200, "一" * 1500 + "。" + "二" * 900, "a\u0301" * 1200, "Para.\n\nPara two is here.\n" * 90, "👩‍👩‍👧" * 400])
@pytest.mark.parametrize("most, overlap", [(100, 0), (100, 20), (720, 80), (7, 3)])
def test_pieces(text, most, overlap):
    own = splitting.spans(text, most, overlap)
    assert own[0][0] == 0 and own[-1][1] == len(text)
    assert all(0 < b - a <= most for a, b in own)
    assert all(overlap <= b - c <= overlap + max(overlap // 2, 12) and a < c for (a, b), (c, _) in zip(own, own[1:]))
    assert text[: own[0][1]] + "".join(text[e:b] for (_, e), (_, b) in zip(own, own[1:])) == text
    least = 1 if len(text) <= most else 1 + -(-(len(text) - most) // (most - overlap))
    assert len(own) <= least + 3


@pytest.mark.parametrize("text, most", [("a\u0301" * 1200, 100), ("e\u0301te\u0301 vie\u0300ge " * 200, 100), ("👩‍👩‍👧" * 300, 100), ("word and another " * 90, 120)])
def test_pieces_start_at_graphemes_and_words(text, most):
    own = splitting.spans(text, most, 20)
    assert not any(splitting._inside_grapheme(text, a) for a, _ in own[1:])
    if " " in text:
        assert all(text[a - 1] == " " for a, _ in own[1:])


def test_pieces_balance_and_snap():
    text = "One sentence ends here. " * 100
    own = splitting.spans(text, 720, 80)
    assert all(text[:b].endswith(". ") for _, b in own[:-1])
    sizes = [b - a for a, b in own]
    assert max(sizes) - min(sizes) < 200
    with pytest.raises(ValueError):
        splitting.spans("x" * 20, 10, 10)


def test_split_frame(spark):
    d = docs(spark, [None, "", "short", "long words " * 20, "long words " * 20], piece_no=["a", "b", "c", "d", "e"], n_pieces="x")
    out = splitting.split_oversized(d, "clean_text", 50, 10)
    assert {"_piece_no", "_n_pieces", "piece_no", "n_pieces", "piece_text"} <= set(out.columns)
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got["d0"] == got["d1"] == got["d2"] == 1 and got["d3"] == got["d4"] > 4
    assert splitting.split_oversized(d, "clean_text", 50, 10, only_oversized=True, with_text=False).select("doc_id").distinct().count() == 2
    assert splitting.split_oversized(d.limit(0), "clean_text", 50, 10).count() == 0


# ---- 3: near-duplicates --------------------------------------------------------------------------------------------
def jaccard(a, b, n):
    g = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (x.lower().split() for x in (a, b))]
    return len(g[0] & g[1]) / len(g[0] | g[1]) if g[0] and g[1] else 0.0


@pytest.fixture(scope="module")
def family(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(8, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w.insert(rng.randrange(len(w)), "New")
            texts.append((" " if rng.random() < 0.5 else "\n").join(w).upper() if rng.random() < 0.3 else " ".join(w))
    return [*texts, None, "", "one", "one two", texts[0], texts[0]]


@pytest.mark.parametrize("threshold, n", [(0.6, 3), (0.8, 5)])
def test_pairs_equal_brute_force(spark, family, threshold, n):
    d = docs(spark, family, node="x", bucket="y").union(docs(spark, family, node="x", bucket="y").limit(4))
    members, pairs = near_duplicates.near_duplicate_pairs(d.repartition(5), threshold=threshold, words=n)
    got = set(rows(near_duplicates.document_pairs(members, pairs), "a", "b"))
    want = {tuple(sorted((f"d{i}", f"d{j}"))) for i, a in enumerate(family) for j, b in enumerate(family) if i < j and a and b and jaccard(a, b, n) >= threshold}
    assert got == want


def test_groups(spark, family):
    d = docs(spark, family)
    groups = {r["doc_id"]: r["group_id"] for r in near_duplicates.near_duplicate_groups(d, threshold=0.6, words=3).collect()}
    assert len(groups) == len(family)
    assert groups[f"d{len(family) - 6}"] is None  # the null text
    parent = list(range(len(family)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, a in enumerate(family):
        for j, b in enumerate(family[:i]):
            if a and b and jaccard(a, b, 3) >= 0.6:
                parent[find(i)] = find(j)
    named = [i for i, t in enumerate(family) if t and len(t.split()) >= 3]
    for i in named:
        for j in named:
            assert (groups[f"d{i}"] == groups[f"d{j}"]) == (find(i) == find(j))


def variants(n, seed=4):
    """n texts that each differ from one base in a few words."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    out = []
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(150), 4):
            w[at] = f"v{k}x{at}"
        out.append(" ".join(w))
    return out


def test_candidates_of_one_group_are_linear(spark):
    count = {}
    for n in (200, 400):
        own = near_duplicates.Collection(docs(spark, variants(n)), "doc_id", "clean_text", 0.6, 3, 80, 5, 8)
        count[n] = own.links.count()
        assert near_duplicates.near_duplicate_groups(docs(spark, variants(n)), threshold=0.6, words=3).select("group_id").distinct().count() == 1
    assert count[400] < 2.6 * count[200] and count[400] < 80 * 400


def test_pairs_among_many_texts_of_one_template(spark):
    template = [f"t{i}" for i in range(90)]
    texts = [" ".join(template + [f"u{k}x{i}" for i in range(60)]) for k in range(500)]  # alike by 0.42, so they meet in many buckets
    for k in range(50):
        words = texts[k].split()
        texts.append(" ".join(words[:117] + [f"v{k}x{i}" for i in range(33)]))
    assert jaccard(texts[3], texts[4], 3) < 0.45 and 0.6 < jaccard(texts[3], texts[503], 3) < 0.66
    groups = {r["doc_id"]: r["group_id"] for r in near_duplicates.near_duplicate_groups(docs(spark, texts), threshold=0.6, words=3).collect()}
    assert len(set(groups.values())) == 500 and sum(groups[f"d{k}"] == groups[f"d{500 + k}"] for k in range(50)) == 50


def test_all_pairs_of_a_group_are_found(spark):
    texts = variants(60)
    members, pairs = near_duplicates.near_duplicate_pairs(docs(spark, texts), threshold=0.7, words=3)
    want = {tuple(sorted((f"d{i}", f"d{j}"))) for i in range(60) for j in range(i) if jaccard(texts[i], texts[j], 3) >= 0.7}
    assert set(rows(near_duplicates.document_pairs(members, pairs), "a", "b")) == want and len(want) > 100


def test_neighbours_over_batches_and_partitions(spark):
    rng = random.Random(6)
    data = sorted((rng.choice([1, 1, 1, 2, 3, rng.randrange(4, 60)]), bytes([rng.randrange(256)]) * 8, rng.randrange(50)) for _ in range(400))
    data = sorted({(b, bytes([n * 5 % 251]) * 8, n) for b, _, n in data})
    want_star, want_next = set(), set()
    for bucket in {b for b, *_ in data}:
        nodes = [n for b, _, n in data if b == bucket]
        want_star |= {frozenset((nodes[0], n)) for n in nodes[1:]}
        want_next |= {frozenset((x, y)) for i, x in enumerate(nodes[1:], 1) for y in nodes[i + 1 : i + 4]}
    df = spark.createDataFrame(data, "bucket bigint, place binary, node bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for parts in (1, 6):
            base = df.repartitionByRange(parts, "bucket", "place", "node").sortWithinPartitions("bucket", "place", "node")
            got = near_duplicates.joined_seams(base.mapInArrow(near_duplicates._neighbours(3), near_duplicates.EDGES), 3).collect()
            stars, nexts = ({frozenset((r["a"], r["b"])) for r in got if (r["centre"] is None) == own} for own in (True, False))
            assert parts > 1 or stars == want_star and nexts == want_next
            assert want_next <= stars | nexts
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_and_clashing_ids_of_near_duplicates(spark):
    a, b = variants(2)
    other = "nothing of this is in any of the other texts that are here"
    d = spark.createDataFrame([(None, a), ("x", b), ("x", other), ("y", other), (None, None)], "doc_id string, clean_text string")
    groups = near_duplicates.near_duplicate_groups(d, threshold=0.5).collect()
    assert len(groups) == 5
    by = {(r["doc_id"], r["class_id"] is None): set() for r in groups}
    for r in groups:
        by[r["doc_id"], r["class_id"] is None].add(r["group_id"])
    assert by[None, False] < by["x", False] and by["y", False] < by["x", False] and by[None, True] == {None}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in near_duplicates.components(edges).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and got[101] == 100


def test_near_duplicates_of_nothing(spark):
    members, pairs = near_duplicates.near_duplicate_pairs(docs(spark, ["x"]).limit(0))
    assert members.count() == pairs.count() == 0


def test_hot_copies_are_one_class(spark):
    same = "the same words again and again in all of these many documents here"
    d = docs(spark, [same] * 300 + [f"other words number {i} of a text that shares nothing {i * 7} with it {i * 3}" for i in range(300)])
    members, pairs = near_duplicates.near_duplicate_pairs(d)
    assert members.select("node").distinct().count() == 301 and pairs.count() == 0


# ---- 4: sentences --------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def splitter(spark):
    return sentences.Splitter(sentences.learn(spark.read.parquet("/root/testdata/sf0.01/crawl_docs.parquet")))


@pytest.mark.parametrize(
    "text, lang, count",
    [
        ("Dr. Harn and Prof. A. J. Velk tested it. It works... most of the time.", "en", 2), ('The log says "Done. 2 segments left." and then goes quiet. Stop!', "en", 2),
        ("The ratio rose from 0.4 to 1.2 within approx. 7 min. of load. Next one.", "en", 2), ("Siehe Abb. 5 und Kap. 8.0 zum Puffer. Im 2. Schritt prüft er.", "de", 2),
        ("日志写着“完成。剩余86个。”然后停止。先读a.toml；再读表。", "zh", 2), ("他问：“准备好了吗？”数值从0.5升到1.9。", "zh", 2), ("（缓存是本地的。）先读它。", "zh", 2),
        ("画面に「完了。残り9件。」と表示されます。次へ。", "ja", 2), ("संस्करण 7.12 से एक है। “पूरा हुआ। 5 शेष।” लिखा है।", "hi", 2), ("Heading here\n• item one\n• item two\nA sentence. Another one.", "en", 5),
        ("This line is wrapped at a width that is near to\nseventy characters, and it goes on to the next\nline. Here is another.\n\nNew paragraph.", "en", 3), ("", "en", 0), (" \n\t ", None, 0), (None, None, 0),
    ],
)
def test_units(splitter, text, lang, count):
    units = splitter.units(text, lang)
    assert len(units) == count, [text[a:b] for a, b in units]


def test_units_cover_the_text(splitter, spark):
    for r in spark.read.parquet(f"{SMALL}/crawl_docs.parquet").select("clean_text").collect():
        text, at = r["clean_text"], 0
        for a, b in splitter.units(text):
            assert a >= at and not text[at:a].strip() and text[a:b] == text[a:b].strip() and b > a
            at = b
        assert not text[at:].strip()


def test_learned_types(splitter):
    en, de = splitter.model["en"], splitter.model["de"]
    assert {"dr", "e.g", "no", "prof"} <= en["abbreviations"] and "was" not in en["abbreviations"]
    assert "nr" in de["abbreviations"] and "bzw nr" in de["collocations"]


def test_abbreviations_before_words_seen_once(spark):
    name = lambda k: "".join(chr(97 + int(c)) for c in f"{k:04d}").capitalize() + "er"
    texts = [f"The report of Dipl. {name(k)} was read when the others were away. It was not long, and they left it there." for k in range(40)]
    texts += [f"They were there before the others. {name(900 + k)} read it when it was not long." for k in range(40)]
    learned = sentences.learn(docs(spark, texts))["en"]
    assert "dipl" in learned["abbreviations"] and not {"there", "away", "others"} & learned["abbreviations"]
    assert len(sentences.Splitter({"en": learned}).units("The report of Dipl. Sander was read.", "en")) == 1


def test_likelihood_ratio(spark):
    import math

    def log(p, n, k):
        return k * math.log(p) + (n - k) * math.log(1 - p)

    a, b, ab, n = 30, 40, 12, 1000
    want = -2 * (log(b / n, a, ab) + log(b / n, n - a, b - ab) - log(ab / a, a, ab) - log((b - ab) / (n - a), n - a, b - ab))
    got = spark.range(1).select(sentences._likelihood_ratio(*map(F.lit, (a, b, ab, n))).alias("x")).first()["x"]
    assert abs(got - want) < 1e-6 and want > 7.88


def test_sentences_frame(spark, splitter):
    d = docs(spark, [None, "", "One. Two.", LONG, "One. Two."])
    got = sentences.sentence_units(d, splitter.model).groupBy("doc_id").count()
    assert dict(rows(got, "doc_id", "count")) == {"d2": 2, "d3": 30_000, "d4": 2}
    assert sentences.sentence_units(d.limit(0)).count() == 0


def test_entries_past_the_broadcast_ones_count(spark):
    table = spark.read.parquet(f"{SMALL}/crawl_docs.parquet").select("doc_id", "clean_text")
    corpus = spark.read.parquet("/root/testdata/sf0.01/crawl_docs.parquet")
    few = sentences.sentence_units(table, corpus=corpus, max_entries=2)
    assert rows(few, "doc_id", "start_pos", "end_pos") == rows(sentences.sentence_units(table, corpus=corpus), "doc_id", "start_pos", "end_pos")


# ---- 5: markup -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text, found",
    [
        ("<p>Hi</p>", ("html",)), ("a &amp; b", ("html",)), ("see <!-- x -->", ("html",)), ("## Head\ntext", ("markdown",)), ("a [b](http://c) d", ("markdown",)), ("x **bold** y", ("markdown",)), ("use `code` now", ("markdown",)),
        ("```\nx\n```", ("markdown",)), ("_The_ word", ("markdown",)), ("|---|:--:|", ("markdown",)), ("Head {#id}", ("markdown",)), ("[[Page|text]]", ("wiki",)), ("{{cite|x}}", ("wiki",)), ("it is ''so'' now", ("wiki",)),
        ("== Head ==", ("wiki",)), ("\\textbf{x}", ("latex",)), ("in $\\mathbb{R}^5$ now", ("latex",)), ("\\begin{itemize}", ("latex",)), ("\\[ x = 1 \\]", ("latex",)), ("[[A]] and **b**", ("markdown", "wiki")),
        ("Costs $2 and $51; ratio a*b*c below 2 < x < 33 [8].", ()), ("$ run --glob '**/*.x' > C:\\dir\\file", ()), ("Map<key, List<value>> m = new_map();", ()), ("• bullet\n• bullet", ()), ("def f(*args, **kw): yield __x__", ()),
        ("@app.route('/x/{name}')", ()), ("if a < 3 and b > 4: return c[5]", ()), ("snake_case_name and other_name", ()), ("", ()), (None, ()),
    ],
)
def test_residue(text, found):
    assert markup.residue(text) == found


def test_plain_text_keeps_structure():
    got = markup.plain_text("<h2 id='a'>Head</h2>\n<ul><li>One &amp; two</li><li>Three</li></ul>\n<pre><code>x &lt; 1</code></pre>\n<p>A paragraph of text that is long enough to be a surge of the page.</p>")
    assert got.split("\n") == ["Head", "• One & two", "• Three", "x < 1", "A paragraph of text that is long enough to be a surge of the page."]
    got = markup.plain_text("# Head\n\nSome **bold** text with [a link](http://x) and `code` that is quite long, as it goes.\n\n* item\n```py\ncode_line()\n```")
    assert "Head" in got and "Some bold text with a link and code" in got and "• item" in got and "    code_line()" in got and "```" not in got
    got = markup.plain_text("\\section{Head}\n\\begin{itemize}\n\\item one\n\\end{itemize}\nA formula $x^{2}$ stays in this line of text, which is long enough to count.\\label{x}")
    assert got.startswith("Head\n• one\n") and "$x^{2}$" in got and "label" not in got
    assert markup.plain_text("{{code|1=@app.route('/x/{name}')}}\nA sentence of the page that is long enough to be a surge {{of|it}}.") == "@app.route('/x/{name}')\nA sentence of the page that is long enough to be a surge it."
    assert markup.plain_text("nothing to do here") == "nothing to do here" and markup.plain_text(None) is None and markup.plain_text("") == ""


def test_marked_lines_outside_the_span_stay():
    body = "A paragraph of text that is long enough to be a surge of the page, with **bold** words."
    gap = "\n\n\n\n\n"
    assert markup.plain_text(f"# Title{gap}* item{gap}{body}{gap}```\nx = 1\n```{gap}$x^{{2}}${gap}* [link](http://x){gap}debris").split() == f"Title • item {body.replace('**', '')} x = 1 $x^{{2}}$".split()
    assert markup.plain_text(f"== Head =={gap}{body}{gap}\\section{{End}}").split("\n")[0] == "Head"
    assert markup.plain_text(f"<h1>Top</h1>\n<p>{body}</p>{gap}<pre>y &lt; 2</pre>").split("\n")[-1] == "y < 2"
    sizes = [markup._size(x) for x in ["", "", "", "", "拡張は次の行を読み、それから書きます。終わり。", "", "", "", ""]]
    assert markup.text_spans(sizes) == [(4, 5)]


def test_code_and_structure_survive_other_rules():
    """Each text holds several languages, of which one would spoil what another keeps."""
    long = "A sentence that is long enough to be a surge of the page, and it has [[Page|a link]] in it."
    got = markup.plain_text(f"## Heading two\n{long}\n#include <stdio.h>\n**bold** words here").split("\n")
    assert got == ["Heading two", long.replace("[[Page|a link]]", "a link"), "#include <stdio.h>", "bold words here"]
    got = markup.plain_text(f"# one [[A]]\n# two\n\n* three\n; four\n{long}").split("\n")
    assert got[:5] == ["• one A", "• two", "", "• three", "• four"]
    code = "```html\n<p>x &lt; 1 &amp;&amp; y</p>\n\n**kw and [[x]] and \\textbf{y}\n```"
    got = markup.plain_text(f"A &amp; B\n\n{long}\n\n{code}\nuse `&lt;b&gt;` so\n\nThe end of <b>it</b> is a sentence.")
    assert got.split("\n") == ["A & B", "", long.replace("[[Page|a link]]", "a link"), "", "    <p>x &lt; 1 &amp;&amp; y</p>", "", "    **kw and [[x]] and \\textbf{y}", "use &lt;b&gt; so", "", "The end of it is a sentence."]
    got = markup.plain_text(f"<p>{long}</p>\n<pre>f(**kw)\n  a &lt; b</pre>\n<p>One</p>\n\n<p>Two</p>").split("\n")
    assert got[-5:] == ["f(**kw)", "  a < b", "One", "", "Two"]
    got = markup.plain_text("\\begin{verbatim}\n\\textbf{x} [[y]]\n\\end{verbatim}\nIt is \\emph{so} and [[that]] too.")
    assert got.split("\n") == ["    \\textbf{x} [[y]]", "It is so and that too."]


def test_lists_of_links_inside_a_text_go():
    body = "A paragraph of text that is long enough to be a surge of the page, with **bold** words."
    links = "\n".join(f"* [Page {k}](http://x/{k})" for k in range(5))
    got = markup.plain_text(f"{body}\n\n{links}\n\n{body}\n* an item of the text\n* another")
    assert "Page" not in got and got.count("A paragraph") == 2 and got.endswith("• an item of the text\n• another")


def test_text_spans():
    lines = ["", "nav", "", *["x" * 50] * 5, "", "", "", "foot", "", "", *["y" * 70] * 2]
    assert markup.text_spans(list(map(len, lines))) == [(3, 8), (14, 16)]
    assert markup.text_spans([]) == [(0, 0)] and markup.text_spans([1, 1]) == [(0, 2)]


def test_markup_frames(spark):
    d = docs(spark, ["<b>x</b>", None, "", "plain", "<b>x</b>"], section_title=["**t**", None, "", "== h ==", "**t**"], clean_text_markup="clash")
    out = markup.strip_markup(d)
    assert out.columns == [*d.columns, "_clean_text_markup", "section_title_markup"] and out.count() == 5
    both = d.withColumn("doc_id", F.when(F.col("doc_id") == "d4", "d0").otherwise(F.col("doc_id")))
    assert rows(markup.residue_rows(both), "doc_id", "field_name", "markup") == [("d0", "clean_text", "html"), ("d0", "section_title", "markdown"), ("d3", "section_title", "wiki")]
    assert markup.residue_rows(d.limit(0)).count() == 0


# ---- 6: repeated lines ---------------------------------------------------------------------------------------------
def test_repeated_lines_equal_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/crawl_docs.parquet")
    got = set(rows(repeated_lines.repeated_lines(table), "doc_id", "line_no"))
    key = lambda s: re.sub("[0-9]+", "#", re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s).lower().strip()))
    pages = {r["doc_id"]: (r["source_name"], [key(x) for x in r["clean_text"].split("\n")]) for r in table.collect()}
    total, count = {}, {}
    for source, lines in pages.values():
        total[source] = total.get(source, 0) + 1
        for k in set(lines):
            count[source, k] = count.get((source, k), 0) + 1
    want = {(d, i) for d, (s, lines) in pages.items() for i, k in enumerate(lines, 1) if k and count[s, k] >= 3 and count[s, k] >= 0.1 * total[s]}
    assert got == want


def test_repeated_lines_edges(spark):
    texts = ["Foot 1\nown a\n\nfoot ２", "foot 22\nown b", "FOOT  7\nown c", None, "", "own d"]
    d = docs(spark, texts, source_name=["s", "s", "s", "s", None, None], drop="x", key="y")
    twice = d.union(d)
    assert rows(repeated_lines.repeated_lines(twice), "doc_id", "line_no") == [("d0", 1), ("d0", 4), ("d1", 1), ("d2", 1)]
    out = repeated_lines.without_repeated_lines(twice)
    assert out.columns == d.columns and out.count() == 12
    assert {r["doc_id"]: r["clean_text"] for r in out.collect()} == {"d0": "own a\n", "d1": "own b", "d2": "own c", "d3": None, "d4": "", "d5": "own d"}
    assert repeated_lines.repeated_lines(d.limit(0)).count() == 0


def test_lines_of_null_and_clashing_ids(spark):
    data = [(None, "s", "real first line\nshare this page\nbody one"), (None, "s", "share this page\nnull body two"), ("a", "s", "share this page\nbody three"), ("a", "s", "body four\nshare this page"), (None, "s", "share this page\nnull body two")]
    d = spark.createDataFrame(data, "doc_id string, source_name string, clean_text string")
    assert sorted(r["clean_text"] for r in repeated_lines.without_repeated_lines(d).collect()) == ["body four", "body three", "null body two", "null body two", "real first line\nbody one"]
    found = repeated_lines.repeated_lines(d)
    assert {r["pages"] for r in found.collect()} == {3} and found.count() == 4


# ---- 7: leakage ----------------------------------------------------------------------------------------------------
def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefghij  ,.") for _ in range(n))
    items = [(f"i{k}", text(300)) for k in range(6)] + [("i0", text(90)), ("short", "abc"), ("null", None), (None, text(90))]
    bodies = []
    for k in range(120):
        passage = rng.choice(items[:7])[1]
        a = rng.randrange(len(passage) - 80)
        part = passage[a : a + rng.randint(30, 80)]
        part = rng.choice([str, str.upper, lambda s: "".join(f"<b>{c}</b>" if rng.random() < 0.05 else c for c in s), lambda s: s.replace("a", "ａ"), lambda s: s.replace(" ", "\n--")])(part)
        bodies.append(text(rng.randint(0, 200)) + part + text(rng.randint(0, 200)))
    bodies += [None, "", "   "]
    d = spark.createDataFrame([(k, b, "clash") for k, b in enumerate(bodies)], "doc_id bigint, text string, item string")
    it = spark.createDataFrame(items, "item_id string, passage string")
    norm = [leakage.letters(b) for b in bodies]
    want = {(k, i) for k, n in enumerate(norm) for i, p in items if i and p for q in [leakage.letters(p)] if any(q[j : j + 50] in n for j in range(len(q) - 49))}
    assert len(want) > 20
    for parts in (1, 5):  # also with the items in several tasks
        assert set(rows(leakage.leaked_items(d, it.repartition(parts)), "doc_id", "item_id")) == want
    report = dict(rows(leakage.leak_report(leakage.leaked_items(d, it), it), "item_id", "documents"))
    assert report["short"] == 0 and sum(report.values()) == len(want)
    assert leakage.leaked_items(d.limit(0), it).count() == 0 and leakage.leaked_items(d, it.limit(0)).count() == 0


def test_leaks_with_edits(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200))
    edited = []
    for _ in range(60):
        s = list(passage)
        for at in (20, 58, 96, 134, 172):  # no exact run of fifty is left between the edits
            s[at + rng.randrange(-3, 3)] = rng.choice(["", "7", "77"])
        edited.append("".join(s))
    d = spark.createDataFrame(list(enumerate(edited)), "doc_id bigint, text string")
    it = spark.createDataFrame([("i", passage)], "item_id string, passage string")
    assert leakage.leaked_items(d, it).count() == 0
    assert leakage.leaked_items(d, it, max_edits=3, samples=8, bits=6).count() >= 54  # recall of at least 0.9
    other = spark.createDataFrame([(1, "".join(rng.choice("abcdefghij") for _ in range(3000)))], "doc_id bigint, text string")
    assert leakage.leaked_items(other, it, max_edits=3).count() == 0
    assert leakage.within_edits("kitten", "a sitting cat", 2) and not leakage.within_edits("kitten", "dog", 2)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_default_recall_of_edits(spark, edits):
    rng = random.Random(edits)
    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz")
    items, bodies = [], []
    for k in range(200):  # one run of 50 with the edits in its middle, between other letters
        run = [letter() for _ in range(50)]
        items.append((f"i{k}", "".join(run)))
        for at in rng.sample(range(14, 36), edits):
            run[at] = rng.choice(["", letter(), run[at] + letter()])
        bodies.append((k, "".join(letter() for _ in range(rng.randint(0, 40))) + "".join(run) + "".join(letter() for _ in range(40))))
    d, it = spark.createDataFrame(bodies, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, passage string")
    got = set(rows(leakage.leaked_items(d, it, max_edits=edits), "doc_id", "item_id"))
    assert len(got & {(k, f"i{k}") for k in range(200)}) >= 180
    assert leakage.sampling(35, 0) == (1, 24)


@pytest.mark.parametrize("seed", range(4))
def test_within_edits_equals_the_table(seed):
    rng = random.Random(seed)

    def table(window, text, most):
        column = list(range(len(window) + 1))
        for c in ["", *text]:
            if c:
                after = [0]
                for i, w in enumerate(window):
                    after.append(min(column[i] + (w != c), column[i + 1] + 1, after[i] + 1))
                column = after
            if column[-1] <= most:
                return True
        return False

    for _ in range(400):
        window = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        if rng.random() < 0.6:
            own = list(window)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(["", "a", "bc"])
            text = text[:20] + "".join(own) + text[20:]
        most = rng.randint(0, 4)
        assert leakage.within_edits(window, text, most) == table(window, text, most)


def test_phrases_shared_by_many_items(spark):
    shared = "this phrase of the terms of use stands in every one of the items that are held out from the corpus"
    it = spark.createDataFrame([(f"i{k}", f"{shared} and number {k * 7919}") for k in range(400)], "item_id string, passage string")
    d = spark.createDataFrame([(k, f"text {k} says {shared} here") for k in range(50)] + [(99, "nothing")], "doc_id bigint, text string")
    assert leakage.leaked_items(d, it).count() == 50 * 400


# ---- 8: mixing -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 3, 2], [18, 6, 15, 10, 6, 5, 10, 8, 12, 7]])
def test_pfair_keeps_every_prefix_within_a_block(weights):
    total = sum(weights)
    blocks = [w * 40 for w in weights]
    slots = mixing.pfair_slots(weights, blocks)
    assert [k for *_, k in slots] == list(range(total * 40))
    done = [0] * len(weights)
    for s, j, slot in slots:
        assert j == done[s]
        done[s] += 1
        for i, w in enumerate(weights):
            assert abs(done[i] - Fraction(w * (slot + 1), total)) < 1
    assert done == blocks


@pytest.mark.parametrize("weights, longest", [(["0.5", "0.3", "0.2"], 1000), (["0.313", "0.187", "0.25", "0.25"], 5000), (["0.3333333", "0.1234567", "0.5432100"], 100), (["0.0133333", "0.4434567", "0.5432100"], 20)])
def test_slots_of_epochs(spark, weights, longest):
    weights = [Fraction(w) for w in weights]
    whole = sum(weights)
    blocks = [int(3000 * w / whole) for w in weights]
    table = mixing.slot_table(spark, list("abcd"[: len(weights)]), weights, blocks, longest).orderBy("slot").collect()
    assert len(table) == sum(blocks) and len({r["slot"] for r in table}) == len(table)
    done, most = dict.fromkeys("abcd", 0), 1 if mixing.epochs(weights, longest)[1] else 2
    for r in table:
        assert r["block"] == done[r["source"]]
        done[r["source"]] += 1
        if r["slot"] < 2900:
            assert all(abs(done[s] - w / whole * (r["slot"] + 1)) < most for s, w in zip("abcd", weights))
    assert [done[s] for s, _ in zip("abcd", blocks)] == blocks


def test_tokens_of_long_texts_are_those_of_the_whole():
    rng = random.Random(9)
    word = lambda: rng.choice(["alpha", "don't", "x_1", "12345", "—", "你好世界", "。", "...", "we'll", "é", "🙂", "a\u0301b", "\n\n", "  ", "\t", "ภาษาไทย"])
    for _ in range(20):
        text = "".join(word() + rng.choice(["", " ", "\n"]) for _ in range(400))
        assert "".join(mixing.parts(text, 30)) == text
        for longest in (30, 200):
            count = mixing.token_counts(TOKENIZER, longest)([1], ["s"], [text])[2][0]
            assert count == len(mixing._encoding(TOKENIZER).encode_ordinary(text))


def test_mix(spark):
    rng = random.Random(1)
    data = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 60))), rng.choices(["big", "small", "tiny", "other", None], [60, 10, 3, 5, 2])[0]) for i in range(1500)] + [(9001, None, "big"), (9002, "", "big")]
    d = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 5), ("tiny", 0.15, None), ("absent", 0.05, 2), ("other", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(d, targets, TOKENIZER, block_tokens=64)
    rep = {r["source"]: r for r in report.collect()}
    assert abs(rep["big"]["actual_share"] - 0.5 / 0.95) < 0.02 and abs(rep["small"]["actual_share"] - 0.3 / 0.95) < 0.02 and abs(rep["tiny"]["actual_share"] - 0.15 / 0.95) < 0.02
    assert rep["absent"]["actual_share"] is None and "other" not in rep
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("repeat_no").alias("m")).collect()
    assert all(r["n"] == r["m"] for r in uses) and max(r["n"] for r in uses if r["source"] == "big") == 1 and max(r["n"] for r in uses if r["source"] == "small") <= 5
    assert {r["source"] for r in uses} == {"big", "small", "tiny"}
    seen, total = {}, 0
    for r in sorted(mixed.collect(), key=lambda r: (r["slot"], r["start_token"])):
        seen[r["source"]] = seen.get(r["source"], 0) + r["n_tokens"]
        total += r["n_tokens"]
        if total > 2000:
            assert abs(seen["big"] - total * 0.5 / 0.95) < 64 + 2 * 61
    assert mixing.mix(d.limit(0), targets, TOKENIZER)[0].count() == 0


# ---- 9: personal information -----------------------------------------------------------------------------------------
FINDER = personal.Finder({"brenda", "katrin", "tilo", "viktor"}, {"ravberg", "marstad"})


@pytest.mark.parametrize(
    "text, found",
    [
        ("Write to brenda.dunley+x@mail.host.example.", [("email", "brenda.dunley+x@mail.host.example")]), ("a [at] b [dot] example", [("email", "a [at] b [dot] example")]), ("@scope/core@5.2.6 and {user}@{host}", []),
        ("Tel: +1 949-555-0140", [("phone", "+1 949-555-0140")]), ("Call (403) 555-0189 now", [("phone", "(403) 555-0189")]), ("Звоните 8 (555) 505-01-17 при", [("phone", "8 (555) 505-01-17")]), ("Llame al 555 120 752 si", [("phone", "555 120 752")]),
        ("Build 866-87x6770 took 3852.488.5746 ticks", []), ("Order code 879 776 21857312 covers", []), ("ISBN 000-4-9581-3490-7", []), ("Listens on 192.0.2.233:31070 since 2025-04-11", []),
        ("SSN: 989-09-6365", [("id_number", "989-09-6365")]), ("my NINO (QQ 75 14 55 C)", [("id_number", "QQ 75 14 55 C")]), ("still shows 964142204 as SSN", [("id_number", "964142204")]), ("documento: 00013382 A", [("id_number", "00013382 A")]),
        ("I moved to 12B Old Quarrel Lane, Upper Marton ZQ4 9QX last", [("address", "12B Old Quarrel Lane, Upper Marton ZQ4 9QX")]), ("Office: 9 Wemtar Ave., Apt 16\nHalderford, ZZ 00345", [("address", "9 Wemtar Ave., Apt 16\nHalderford, ZZ 00345")]),
        ("Anschrift: Finkmoorweg 110a, 00751 Finkmoor am Orm", [("address", "Finkmoorweg 110a, 00751 Finkmoor am Orm")]), ("Adresse : 70, av. du Vieux-Tavre, 00931 Ormelles-sur-Vir", [("address", "70, av. du Vieux-Tavre, 00931 Ormelles-sur-Vir")]),
        ("Thanks to Brenda K. van Ravberg for the patch", [("name", "Brenda K. van Ravberg")]), ("Signed-off-by: Marstad, Katrin", [("name", "Marstad, Katrin")]), ("cc L. Ravberg and the release crew", [("name", "L. Ravberg")]), ("@author TILO MCPELL", [("name", "TILO MCPELL")]),
        ("Сообщил Милослав Кленицын", [("name", "Милослав Кленицын")]), ("报告人：钟霁川", [("name", "钟霁川")]), ("報告者：榛原 千紘", [("name", "榛原 千紘")]), ("The Larkhampton data centre and the Lark Session", []), ("", []), (None, []),
    ],
)
def test_spans(text, found):
    assert [(k, text[a:b]) for k, a, b in FINDER.spans(text)] == found


@pytest.mark.parametrize(
    "text, found",
    [
        ("Reported by: Anouk Hellström", ["Anouk Hellström"]), ("Signed-off-by: Ngozi O. Adeyemi", ["Ngozi O. Adeyemi"]), ("Author: Veldkamp, Inès", ["Veldkamp, Inès"]), ("Thanks to Anouk Hellström for it", ["Anouk Hellström"]), ("Merci à Inès Veldkamp pour tout", ["Inès Veldkamp"]), ("Thanks to Support Team for it", []), ("As Anouk Hellström wrote last week", ["Anouk Hellström"]),
        ("Ngozi Adeyemi | ngozi.adeyemi@x.example | notes", ["Ngozi Adeyemi"]), ("Mit freundlichen Grüßen\nÉlodie Brandt", ["Élodie Brandt"]), ("It fell. Inès van Veldkamp asked whether it may.", ["Inès van Veldkamp"]), ("Hi Q. Ravley, could you look", ["Q. Ravley"]),
        ("Reported by: Support Team", []), ("Dear All Users, read it", []), ("The Field Guide says that Anouk Hellström", []), ("Release Notes | +1 949-555-0140", []), ("Open the Lark Session. Use Vector Store", []),
    ],
)
def test_names_that_no_list_holds(text, found):
    assert [text[a:b] for k, a, b in personal.Finder(set(), set()).spans(text) if k == "name"] == found


@pytest.mark.parametrize(
    "text, found",
    [
        ("الاسم: سمير الحداد، وشكرا", ["سمير الحداد"]), ("قال السيد سمير الحداد", ["سمير الحداد"]), ("लेखक: अनिता वर्मा।", ["अनिता वर्मा"]), ("श्री अनिल वर्मा", ["अनिल वर्मा"]), ("ชื่อ: สมชาย ใจดี", ["สมชาย ใจดี"]), ("담당자: 김민수, 확인", ["김민수"]),
        ("어제 김민수 님이 보냈다", ["김민수"]), ("السجل يعيد قيمة", []), ("ไฟล์นี้ อธิบายฟิลด์", []), ("सूचकांक खाली है", []), ("이 파일은 한 줄이다", []),
    ],
)
def test_names_in_scripts_without_capitals(text, found):
    assert [text[a:b] for k, a, b in personal.Finder(set(), set()).spans(text) if k == "name"] == found


def test_accents_of_given_names_are_flattened():
    text = "today Zoë Marlow and Jürgen Odell said"
    assert [text[a:b] for _, a, b in personal.Finder({"zoe", "jurgen"}, set()).spans(text)] == ["Zoë Marlow", "Jürgen Odell"]


def test_validators():
    assert personal.luhn("4539578763621486") and not personal.luhn("4539578763621487")
    assert personal.mod97("255081416802538") and not personal.mod97("255081416802539")
    assert personal.mod23("12345678Z") and personal.mod23("X1234567L") and not personal.mod23("12345678A")
    assert personal.iso7064("86095742719") and not personal.iso7064("86095742718")
    assert personal.resident_checksum("11010519491231002X") and not personal.resident_checksum("110105194912310021")


def test_names_past_the_broadcast_ones_count(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = ("doc_id", "kind", "start_pos", "end_pos")
    assert rows(personal.personal_spans(table, max_names=2), *names) == rows(personal.personal_spans(table), *names)
    plain = "we met Brenda Marstad there. "
    d = spark.createDataFrame([(i, plain + f"brenda.marstad@x.example{' a.zorn@x.example' * 9}") for i in range(3)], "doc_id bigint, text string")
    assert personal.personal_spans(d, max_names=1).where("kind = 'name'").count() == 3
    assert [r["text"][:16] for r in personal.redact(d, max_names=1).collect()] == ["we met [NAME] th"] * 3


def test_personal_frames(spark):
    text = "Hi Brenda Marstad, write to brenda.marstad@x.example or call +1 949-555-0140."
    d = spark.createDataFrame([(i, t, 7) for i, t in enumerate([text, text, text, None, "", LONG])], "doc_id bigint, text string, n_replaced int")
    assert personal.learn_names(d) == ({"brenda"}, {"marstad"})
    assert personal.personal_spans(d).count() == 9
    out = personal.redact(d)
    assert out.columns == [*d.columns, "_n_replaced"] and out.count() == 6
    assert out.where("doc_id = 0").first()["text"] == "Hi [NAME], write to [EMAIL] or call [PHONE]."
    assert out.where("doc_id = 5").first()["text"] == LONG
    assert personal.personal_spans(d.limit(0)).count() == 0
