"""Chunking, retrieval, reading, decision, evaluation, training and crawling on handmade cases."""

import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions.text import words
from docloom.operators import chunking, crawl, decision, dense, evaluation, fusion, reading, sparse, training


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 179, 180, 181, 325, 326, 1000])
def test_word_windows(spark, n):
    expected, start, w = [], 0, [f"w{i}" for i in range(n)]
    while start < n:
        expected.append(" ".join(w[start : start + 180]))
        if start + 180 >= n:
            break
        start += 145
    got = spark.createDataFrame([(" ".join(w),)], "x string").select(chunking.word_windows("x").alias("c")).first()["c"]
    assert got == expected


@pytest.mark.parametrize("n", [3, 4, 8, 9, 10, 14, 15, 20, 21])
def test_sentence_windows(spark, n):
    s = [f"This is sentence number {i} of the test text." for i in range(n)]
    expected, start = [], 0
    while n >= 4 and start < n:
        part = s[start : start + 8]
        if len(part) < 4 and expected:
            expected[-1] += " " + " ".join(part)
            break
        expected.append(" ".join(part))
        if start + 8 >= n:
            break
        start += 6
    got = spark.createDataFrame([(" ".join(s),)], "x string").select(chunking.sentence_windows("x").alias("c")).first()["c"]
    assert got == (expected or [" ".join(s)])


def test_many_short_sentences_become_word_windows(spark):
    text = " ".join(["Go on."] * 600)
    got = spark.createDataFrame([(text,)], "x string").select(chunking.sentence_windows("x").alias("c"), words("x").alias("w")).first()
    assert got["c"][0] == " ".join(got["w"][:180])


def chunks_of(spark, texts, title="", url="u"):
    return spark.createDataFrame([(f"c{i}", "d", "S", title, "", url, t, t) for i, t in enumerate(texts)], "chunk_id string, doc_id string, source_name string, title string, section_title string, source_url string, chunk_text string, dense_text string")


def test_bm25_by_hand(spark):
    texts = ["alpha beta beta", "alpha gamma", "", "delta"]
    got = {r["chunk_id"]: (r["rank"], r["bm25"]) for r in sparse.bm25_search(spark.createDataFrame([(1, "beta alpha"), (2, "the of"), (3, "zeta")], "qid int, question string"), chunks_of(spark, [*texts, texts[3]]).unionByName(chunks_of(spark, texts[:1]))).collect()}
    rows = [t.split() for t in [*texts, texts[3]]]
    n, avg = len(rows), sum(map(len, rows)) / len(rows)
    q = "beta alpha beta alpha".split()  # the question and its first identifiers

    def score(d):
        total = 0.0
        for t in q:
            df = sum(t in r for r in rows)
            tf = d.count(t)
            total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg)) if tf else 0
        return round(total, 6)

    assert got == {"c0": (1, pytest.approx(score(rows[0]))), "c1": (2, pytest.approx(score(rows[1])))}


def test_dense_search_equals_brute_force(spark):
    rng = random.Random(3)
    v = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    v[10] = v[20]  # a tie
    df = spark.createDataFrame([(f"c{i:02d}", x) for i, x in enumerate(v)] + [("null", None)], "chunk_id string, embedding array<float>")
    got = dense.dense_search(df.limit(7).selectExpr("chunk_id as qid", "embedding"), df.repartition(5), 5, block=3)
    stored = {r["chunk_id"]: r["embedding"] for r in df.collect() if r["embedding"]}
    for q in list(stored)[:7]:
        best = sorted(((-round(sum(a * b for a, b in zip(stored[q], x)), 6), c) for c, x in stored.items()))[:5]
        assert [(r["chunk_id"]) for r in sorted(got.where(F.col("qid") == q).collect(), key=lambda r: r["rank"])] == [c for _, c in best]


def test_embedder_is_unit_and_deterministic(spark):
    df = dense.embed_texts(spark.createDataFrame([("read the csv",), ("",), (None,)], "t string"), "t", 64)
    a, b = df.collect(), df.collect()
    assert a == b and math.isclose(sum(x * x for x in a[0]["embedding"]), 1, rel_tol=1e-5) and not any(a[1]["embedding"])


def test_fusion_ties_and_sides(spark):
    left = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "qid int, chunk_id string, rank int")
    right = spark.createDataFrame([(1, "a", 1), (1, "c", 2)], "qid int, chunk_id string, rank int")
    rows = {r["chunk_id"]: r["rrf"] for r in fusion.fuse(left, right).collect()}
    assert rows == {"a": 1 / 61, "b": 1 / 61, "c": 2 / 62}
    ranked = sparse.best(fusion.fuse(left, right), 3, "rrf").orderBy("rank").collect()
    assert [r["chunk_id"] for r in ranked] == ["c", "a", "b"]


@pytest.mark.parametrize("seed", range(5))
def test_span_search(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([1, 5, 40, 80])
    s, e = [round(rng.random(), 2) for _ in range(n)], [round(rng.random(), 2) for _ in range(n)]
    top = lambda p: sorted(range(n), key=lambda i: (-p[i], i))[:12]
    best = None
    for a in top(s):
        for b in top(e):
            if 0 <= b - a <= 30 and (best is None or s[a] * e[b] > best[0]):
                best = (s[a] * e[b], a, b)
    got = spark.createDataFrame([(s, e)], "s array<double>, e array<double>").select(reading.span_search("s", "e").alias("x")).first()["x"]
    assert (tuple(got) if got else None) == best


def test_best_sentence(spark):
    df = spark.createDataFrame([(["alpha", "beta"], "Nothing here. Has alpha in it. Also alpha only. Both alpha and beta again."), (["zeta"], "Nothing here."), ([], "")], "q array<string>, c string")
    assert [tuple(r["b"]) for r in df.select(reading.best_sentence("q", "c").alias("b")).collect()] == [(1.0, "Both alpha and beta again."), (0.0, ""), (0.0, "")]


@pytest.mark.parametrize(
    "span, rerank, retrieval, reader, threshold, low",
    [
        ("good answer", -0.1, 0.03, 0.9, 0.01, True), ("good answer", 0.1, 0.019, 0.14, 0.01, True), ("good answer", 0.1, 0.020, 0.14, 0.01, False), ("good answer", 0.1, 0.019, 0.15, 0.01, False),
        ("7", 0.1, 0.03, 0.19, 0.01, True), ("---", 0.1, 0.03, 0.9, 0.01, True), ("", 0.1, 0.03, 0.21, 0.01, False), ("1234", 0.1, 0.03, 0.19, 0.01, True), ("1234", 0.1, 0.03, 0.2, 0.01, False),
    ],
)
def test_low_support(spark, span, rerank, retrieval, reader, threshold, low):
    df = spark.createDataFrame([(span, rerank, retrieval, reader, threshold)], "a string, b double, c double, d double, e double")
    assert df.select(decision.is_low_support("a", "b", "c", "d", "e").alias("x")).first()["x"] is low


def test_decide(spark):
    rows = [("explanatory", "Because.", 0.18, "span", -1.0, 0.0, 0.0, 0.0), ("explanatory", "Because.", 0.17, "span", 1.0, 0.03, 0.5, 0.01), ("extractive", "Because.", 0.9, "span", 1.0, 0.03, 0.5, 0.6), ("extractive", None, None, None, None, None, None, 0.0)]
    df = spark.createDataFrame(rows, "s string, y string, c double, a string, k double, r double, d double, t double")
    got = [tuple(r["x"]) for r in df.select(decision.decide("s", "y", "c", "a", "k", "r", "d", "t").alias("x")).collect()]
    assert got == [("answer", "Because.", 0.18), ("answer", "span", 0.5), ("no_answer", "", 0.0), ("no_answer", "", 0.0)]


def synthesis(spark, question, support, left="", right=""):
    df = spark.createDataFrame([(question, [Row(sentence=s, score=x) for s, x in support], left, right)], "q string, s array<struct<sentence:string,score:double>>, l string, r string")
    return tuple(df.select(decision.synthesize("q", "s", "l", "r").alias("x")).first()["x"])


def test_synthesis_branches(spark):
    two = [("loc is by label.", 0.8), ("iloc is by position.", 0.6)]
    assert synthesis(spark, "difference between loc and iloc?", two, "labels", "places") == ("loc is primarily labels, while iloc is primarily places. Use loc when you want labels, and use iloc when you want places.", 0.8)
    assert synthesis(spark, "difference between loc and iloc?", two)[0].startswith("loc is described as loc is by label while iloc is described as iloc is by position")
    one = [("loc and iloc differ.", 0.5)]
    assert synthesis(spark, "difference between loc and iloc?", one)[1] == 0.5  # the only score counts
    assert synthesis(spark, "difference between at and zzz?", [("See this one first.", 0.4), ("Use at here now.", 0.2)])[0] == "Use at here now. See this one first."
    assert synthesis(spark, "Why is it so?", [("It waits.", 0.2)]) == ("Based on the documentation, it waits.", 0.2)
    assert synthesis(spark, "How does it go", [("It waits.", 3.0)]) == ("According to the retrieved documentation, it waits.", 0.99)
    assert synthesis(spark, "Name it", []) == ("", 0.0)


def test_metrics(spark):
    f1 = lambda p, g: spark.createDataFrame([(p, g)], "p string, g string").select(evaluation.token_f1("p", "g").alias("x")).first()["x"]
    assert f1("same text", "same text") == 1 and f1("", "the") == 1 and f1("", "x") == 0 and f1("x x y", "x y y") == pytest.approx(2 / 3)
    df = spark.createDataFrame([("The cat", ["a cat", "dog"], ["cat", "owl"], [], None)], "p string, a array<string>, r array<string>, e array<string>, n array<string>")
    r = df.select(evaluation.exact_match("p", "a"), evaluation.best_f1("p", "e"), evaluation.term_coverage("p", "r"), evaluation.term_coverage("p", "n"), evaluation.best_f1("p", "n")).first()
    assert tuple(r) == (1.0, 0.0, 0.5, 0.0, 0.0)


def test_retrieval_metrics(spark):
    e = [Row(chunk_id="c1", source_url="u1"), Row(chunk_id="c2", source_url="u2")]
    rows = [(e, ["c2"], []), (e, [], ["u1"]), (e, [], []), ([], [], []), (None, None, None), (e, ["zz"], ["yy"])]
    df = spark.createDataFrame(rows, "e array<struct<chunk_id:string,source_url:string>>, g array<string>, u array<string>")
    got = [tuple(r["m"]) for r in df.select(evaluation.retrieval_metrics("e", "g", "u").alias("m")).collect()]
    assert got == [(0, 1, 0.5), (1, 1, 1), (0, 0, 0), (1, 1, 1), (1, 1, 1), (0, 0, 0)]


def test_error_classes(spark):
    df = spark.createDataFrame([("a", False, 0.0, 0.0, 0.0), ("b", True, 0.0, 0.0, 1.0), ("c", True, 0.0, 1.0, 0.5), ("d", True, 0.0, 1.0, 1.0), ("e", False, 1.0, 0.0, 1.0)], "id string, answerable boolean, no_answer_correct double, hit_at_1 double, f1 double")
    assert [r["error_class"] for r in evaluation.classified(df).orderBy("id").collect()] == ["false_positive", "retrieval_miss", "reader_or_span_issue", "ok", "ok"]
    assert dict(values(evaluation.error_histogram(df.limit(1)), "error_class", "examples"))["ok"] == 0
    assert evaluation.first_of_each_class(df, 1).count() == 4


def test_training_pairs(spark):
    items = spark.createDataFrame([("i1", "q1", ["u1"], True), ("i2", "q2", ["u1"], False), ("i3", "q1", ["u1"], True)], "id string, question string, gold_source_urls array<string>, answerable boolean")
    chunks = chunks_of(spark, [f"text {i}" for i in range(5)], "T", "u1")
    assert training.gold_pairs(items, chunks).count() == 6
    pairs = training.training_pairs(items, chunks).collect()
    assert len({(r["query"], r["source_url"]) for r in pairs}) == len(pairs)
    assert {r["kind"] for r in pairs} == {"gold_eval", "synthetic_title_section"}


def page(words_, *links):
    return f"<html><head><title>T</title></head><body><main><h1>H</h1><p>{' '.join(f'word{i}' for i in range(words_))} is plenty of text for the gate.</p></main>{''.join(f'<a href={x!r}>x</a>' for x in links)}</body></html>"


def test_crawl(spark):
    base = "https://docs.x.example/guide/"
    pages = [("a", page(60, "b", "c#f", "/about", "https://y.example/guide/z")), ("b", page(60, "d", "a")), ("c", page(5, "e")), ("d", page(60, "f")), ("e", page(60)), ("f", page(60))]
    df = spark.createDataFrame([(base + n, h) for n, h in pages], "source_url string, html string")
    sources = spark.createDataFrame([("X Docs", "https://docs.x.example/", "docs.x.example", [base + "a", base + "a#top"], ["/guide/"])], "source_name string, base_url string, allowed_netloc string, seed_pages array<string>, allow_patterns array<string>")
    docs, report = crawl.crawl(df, sources)
    assert {r["source_url"].rpartition("/")[2]: r["crawl_depth"] for r in docs.collect()} == {"a": 0, "b": 1, "d": 2}  # c is too short and gives no links, f is too deep
    assert values(docs, "raw_file_path") == [("x_docs_0000.html",), ("x_docs_0001.html",), ("x_docs_0002.html",)]
    assert values(report, "source_name", "visited", "fetched", "accepted") == [("X Docs", 4, 4, 3)]
    few, report = crawl.crawl(df, sources, EngineConfig(max_pages_per_source=2))
    assert few.count() == 2 and values(report, "visited", "accepted") == [(2, 2)]
    few, report = crawl.crawl(df, sources, EngineConfig(max_urls_visited_per_source=3))
    assert few.count() == 2 and values(report, "visited", "fetched", "accepted") == [(3, 3, 2)]
    assert values(crawl.crawl(df.limit(0), sources)[1], "visited", "fetched", "accepted") == [(1, 0, 0)]
    assert values(crawl.page_links(df, sources).where(F.col("url").endswith("/a")), "link") == [(base + "b",), (base + "c",)]


def crawled_by_hand(links, passes, seeds, most_pages, most_urls, depth):
    """The queue of a crawl, one URL after the other."""
    queue, visited, accepted = [(s, 0) for s in seeds], [], []
    while queue and len(accepted) < most_pages and len(visited) < most_urls:
        url, at = queue.pop(0)
        if url in visited:
            continue
        visited.append(url)
        if url not in links or not passes[url]:
            continue
        accepted.append((url, at))
        if at < depth:
            queue += [(x, at + 1) for x in links[url] if x not in visited]
    return visited, accepted


@pytest.mark.parametrize("seed", range(3))
def test_crawl_equals_a_queue(spark, seed):
    rng = random.Random(seed)
    base = "https://docs.x.example/guide/"
    names = [f"p{i}" for i in range(60)]
    links = {n: [rng.choice(names + ["gone1", "gone2"]) for _ in range(rng.randint(0, 6))] for n in names}
    passes = {n: rng.random() < 0.8 for n in names}
    df = spark.createDataFrame([(base + n, page(60 if passes[n] else 3, *links[n])) for n in names], "source_url string, html string")
    sources = spark.createDataFrame([("X", "https://docs.x.example/", "docs.x.example", [base + "p0", base + "p1"], ["/guide/"])], "source_name string, base_url string, allowed_netloc string, seed_pages array<string>, allow_patterns array<string>")
    for pages_, urls in ((60, 280), (9, 280), (60, 14)):
        visited, accepted = crawled_by_hand(links, passes, ["p0", "p1"], pages_, urls, 2)
        docs, report = crawl.crawl(df, sources, EngineConfig(max_pages_per_source=pages_, max_urls_visited_per_source=urls))
        assert {(r["source_url"].rpartition("/")[2], r["crawl_depth"]) for r in docs.collect()} == set(accepted)
        assert values(report, "visited", "fetched", "accepted") == [(len(visited), sum(v in links for v in visited), len(accepted))]


def test_fetching_pages(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/guide/moved":
                self.send_response(302)
                self.send_header("Location", "/guide/b/")
                return self.end_headers()
            self.send_response(404 if self.path == "/guide/gone" else 200)
            self.send_header("Content-Type", "text/plain" if self.path == "/guide/text" else "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(page(60, "moved", "gone", "text").encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        host = f"127.0.0.1:{server.server_port}"
        sources = spark.createDataFrame([("X", f"http://{host}/", host, [f"http://{host}/guide/a"], ["/guide/"])], "source_name string, base_url string, allowed_netloc string, seed_pages array<string>, allow_patterns array<string>")
        docs, report = crawl.crawl(crawl.fetched_pages(timeout=5, pause=0), sources)
        assert values(docs, "source_url") == [(f"http://{host}/guide/a",), (f"http://{host}/guide/b",)]
        assert values(report, "visited", "fetched", "accepted") == [(4, 2, 2)]
    finally:
        server.shutdown()


def test_fine_tuning_brings_pairs_together(spark):
    # queries name the topic of their passage in one word, and share words that say nothing
    topics = [f"topic{i}" for i in range(40)]
    pairs = spark.createDataFrame([(f"what is said here of {t}", f"it is said here and it is so that {t} counts said here") for t in topics], "query string, positive string")
    weights = training.fine_tune(pairs, 64, epochs=30, batch=40)
    assert len(weights) == 64 and min(weights) > 0

    def hits(w):
        q = dense.embed_texts(pairs.select(F.col("query").alias("qid"), "query"), "query", 64, weights=w)
        p = dense.embed_texts(pairs.select("query", "positive"), "positive", 64, weights=w)
        return dense.dense_search(q.select("qid", "embedding"), p, 1, "query").where("qid = query").count()

    assert hits(weights) >= hits(None)
    with pytest.raises(ValueError):
        training.fine_tune(pairs.limit(0))


def test_spans_of_a_reader_of_probabilities(spark):
    df = spark.createDataFrame([("The loc is by label.", [(0, 3), (4, 7), (8, 10), (11, 13), (14, 19)], [0.1, 0.6, 0.1, 0.1, 0.1], [0.1, 0.2, 0.1, 0.0, 0.6]), ("x", [], [], [])], "c string, o array<struct<first:int,last:int>>, s array<double>, e array<double>")
    got = [tuple(r["x"]) for r in df.select(reading.read_spans("c", "o", "s", "e").alias("x")).collect()]
    assert got == [("loc is by label", pytest.approx(0.36)), ("", 0.0)]


def test_search_of_an_index_equals_search_of_chunks(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    chunks = chunks_of(spark, texts)
    tokens = sparse.chunk_tokens(chunks)
    posts = sparse.postings(tokens)
    index = sparse.TermIndex(posts, sparse.document_frequency(posts), sparse.corpus_stats(tokens))
    asked = spark.createDataFrame([(1, "alpha zeta"), (2, "beta beta eta"), (3, "nothing known")], "qid int, question string")
    want = values(sparse.bm25_search(asked, chunks.union(chunks.limit(30))), "qid", "chunk_id", "rank", "bm25")
    assert values(sparse.bm25_search(asked, None, index=index), "qid", "chunk_id", "rank", "bm25") == want and want
    few = EngineConfig(filter_terms=1, broadcast_rows=1)  # beyond the bounds terms are joined and shuffled
    assert values(sparse.bm25_search(asked, None, config=few, index=index), "qid", "chunk_id", "rank", "bm25") == want
    assert values(sparse.bm25_search(asked, chunks.union(chunks.limit(30)), config=few), "qid", "chunk_id", "rank", "bm25") == want


def test_crawl_counts_and_first_per_url(spark):
    log = spark.createDataFrame([(1, "S", "https://x/a", 200, "text/html", True), (1, "S", "https://x/a", 200, "text/html", True), (2, "S", "https://X/a#z", 404, None, False), (3, "S", "https://x/b", None, None, None)], "fetch_id int, source_name string, source_url string, http_status int, content_type string, accepted boolean")
    assert values(crawl.crawl_counts(log), "source_name", "visited", "fetched", "accepted") == [("S", 2, 1, 1)]
    docs = spark.createDataFrame([("d2", "https://x/a", 1), ("d1", "https://x/a/", 1), ("d0", "https://x/a", None)], "doc_id string, source_url string, crawl_depth int")
    assert values(crawl.first_per_url(docs), "doc_id") == [("d1",)]


def test_term_definitions_prefer_urls(spark):
    chunks = chunks_of(spark, ["Also loc is primarily first. More."], url="u1").unionByName(chunks_of(spark, ["x", "The .loc is primarily label based."], url="u2"))
    wanted = spark.createDataFrame([(1, "loc", ["u2"]), (2, "loc", []), (3, "zz", []), (4, "", []), (5, "loc", None), (6, None, [])], "qid int, term string, urls array<string>")
    assert values(reading.term_definitions(wanted, chunks), "qid", "definition") == [(1, "label based"), (2, "first"), (5, "first")]


def test_term_definitions_of_signed_terms(spark):
    texts = ["So df.loc is  primarily label based. c++ is primarily fast", "a-b is primarily (x) and more; f(x) is\nprimarily a call", "q[0] is primarily x is primarily y. And iloc is primarily z", None, "is primarily nothing", "The big cat is primarily lazy."]
    chunks = chunks_of(spark, texts).union(chunks_of(spark, texts))
    want = {"df.loc": "label based", "c++": "fast", "a-b": "(x) and more; f(x) is primarily a call", "f(x)": "a call", "q[0]": "x is primarily y", "x": "y", "oc": "label based", "iloc": "z", "big cat": "lazy", "lazy": None, "c+": None}
    wanted = spark.createDataFrame([(i, t, []) for i, t in enumerate(want)], "qid int, term string, urls array<string>")
    got = {r["term"]: r["definition"] for r in reading.term_definitions(wanted, chunks).collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert reading.term_definitions(wanted.limit(0), chunks).count() == reading.term_definitions(wanted, chunks.limit(0)).count() == 0


def _reaching(monkeypatch, module):
    """Counts the rows that reach the ranking of `module`."""
    real, counts = module.best, []
    monkeypatch.setattr(module, "best", lambda scored, *a, **k: counts.append(scored.count()) or real(scored, *a, **k))
    return counts


def test_bm25_shuffles_only_the_best(spark, monkeypatch):
    """Words that all questions and chunks share make a pair of each question and chunk; only k a question and task are ranked."""
    rng = random.Random(5)
    words_ = [f"w{i}" for i in range(60)]
    texts = ["shared " + " ".join(rng.choices(words_, k=rng.randint(1, 12))) for _ in range(900)]
    chunks = chunks_of(spark, texts)
    asked = spark.createDataFrame([(i, "shared " + " ".join(rng.sample(words_, 2))) for i in range(50)] + [(50, "shared"), (51, "unknown")], "qid int, question string")
    counts = _reaching(monkeypatch, sparse)
    got = sparse.bm25_search(asked, chunks.union(chunks.limit(40)), k=5)
    rows = [t.split() for t in texts]
    n, avg = len(rows), sum(map(len, rows)) / len(rows)
    df = {w: sum(w in r for r in rows) for w in ["shared", *words_]}
    want = []
    for q, text in [(r["qid"], r["question"]) for r in asked.collect()]:
        asks = text.split() * 2 if len(text.split()) > 1 else text.split()
        score = lambda r: round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * r.count(t) * 2.5 / (r.count(t) + 1.5 * (0.25 + 0.75 * len(r) / avg)) for t in asks if t in r), 6)  # noqa: B023, E731
        best = sorted((-score(r), f"c{i}") for i, r in enumerate(rows) if set(asks) & set(r))[:5]
        want += [(q, c, i + 1) for i, (_, c) in enumerate(best)]
    assert values(got, "qid", "chunk_id", "rank") == sorted(want)
    assert counts[0] <= 52 * 5 * 4  # 4 tasks; pairs with a common term are over 45,000


def test_dense_search_ranks_only_the_best_of_a_task(spark, monkeypatch):
    """Short texts make vectors of few entries, whose products are summed entry by entry; many tie, also with those of no entry."""
    rng = random.Random(6)
    words_ = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words_, k=rng.randint(0, 6))) for _ in range(700)]
    asked = [" ".join(rng.sample(words_, rng.randint(1, 3))) for _ in range(30)] + ["", "zero"]
    p = spark.createDataFrame([(f"c{i:04d}", t) for i, t in enumerate(texts)], "chunk_id string, t string").repartition(3)
    q = dense.embed_texts(spark.createDataFrame(list(enumerate(asked)), "qid int, t string"), "t", 64)
    counts = _reaching(monkeypatch, dense)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # many batches a task
    try:
        made = dense.embed_texts(p.union(p.limit(50)), "t", 64)
        got = values(dense.dense_search(q, made, 4), "qid", "chunk_id", "rank")
        tokens = p.select("chunk_id", F.filter(F.split("t", " "), lambda x: x != "").alias("embedding"))
        fused = values(dense.dense_search(q, tokens, 4, embed=dense.token_vectors(64)), "qid", "chunk_id", "rank")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    stored = {r["chunk_id"]: r["embedding"] for r in dense.embed_texts(p, "t", 64).collect()}
    want = []
    for r in q.collect():
        best = sorted((-round(sum(a * b for a, b in zip(r["embedding"], x)), 6), c) for c, x in stored.items())[:4]
        want += [(r["qid"], c, i + 1) for i, (_, c) in enumerate(best)]
    assert got == sorted(want) and fused == sorted(want)
    assert counts[0] <= 32 * 4 * 6  # 3 + 1 tasks of 18 batches


@pytest.mark.parametrize("ordered", [True, False])
def test_the_best_over_many_groups(ordered):
    """Groups of rows, equal scores, ids that come again (unless ordered), a query of equal scores."""
    import numpy as np
    import pyarrow as pa

    from docloom.operators.topk import TopK

    rng = np.random.default_rng(7)
    for k in (1, 3, 20):
        top, seen = TopK(9, k, ordered), [{} for _ in range(9)]
        for g in range(12):
            numbers = range(g * 150, g * 150 + 150) if ordered else sorted(rng.choice(900, 150, replace=False).tolist())
            ids = [f"c{i:05d}" for i in numbers]
            true = np.round((np.array(numbers)[None, :] * np.arange(1, 9)[:, None] * 7919) % 101 / 50 - 0.5, 2)
            near = true + rng.uniform(-1e-4, 1e-4, true.shape)
            top.begin(pa.array(ids))
            top.add(0, near, 2e-4, -np.inf, lambda r, c: true[r, c])  # noqa: B023
            top.add_equal(8, 0.0)
            top.end()
            for q in range(9):
                seen[q] |= {c: (float(true[q, j]) if q < 8 else 0.0) for j, c in enumerate(ids)}
        got = [(r["q"], r["id"], r["s"]) for b in top.batches(pa.array(range(9)), ["q", "id", "s"], 7) for r in b.to_pylist()]
        assert got == [(q, c, s) for q in range(9) for s, c in ((-a, c) for a, c in sorted((-s, c) for c, s in seen[q].items())[:k])]


def test_titles_of_found_chunks_only_are_shuffled(spark):
    chunks = chunks_of(spark, [f"alpha beta{i}" for i in range(200)], title="Alpha guide")
    asked = spark.createDataFrame([(1, "alpha beta7"), (2, "beta9")], "qid int, question string")
    found = sparse.bm25_search(asked, chunks.union(chunks), k=3)
    got = sparse.with_title_bonus(found, asked, chunks.union(chunks), "bm25", 0.15)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan and "SortMergeJoin [chunk_id" not in plan.split("LeftSemi")[1].split("\n")[0]
    scores = {(r["qid"], r["chunk_id"]): round(r["score"] - r["bm25"], 6) for r in got.collect()}
    assert scores[1, "c7"] == 0.075 and scores[2, "c9"] == 0.0 and len(scores) == 4


def test_only_texts_of_ranked_chunks_are_read(spark, monkeypatch):
    """Of the candidates of both lists only those that are ranked meet their texts, and those by broadcast ids."""
    chunks = chunks_of(spark, [f"alpha beta{i}" for i in range(60)], title="Alpha guide")
    asked = spark.createDataFrame([(1, "alpha beta7")], "qid int, question string")
    lists = [spark.createDataFrame([(1, f"c{i}", n + 1) for n, i in enumerate(own)], "qid int, chunk_id string, rank int") for own in (range(20), range(20, 40))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fusion.hybrid_candidates(fusion.fuse(*lists), asked, chunks.union(chunks))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi, BuildRight" in plan
    assert values(got, "hybrid_rank", "chunk_id") == sorted((2 * n + 1 + k, c) for n in range(10) for k, c in enumerate(sorted((f"c{n}", f"c{20 + n}"))))
    assert all(r["chunk_text"] for r in got.collect())


def test_answers_rank_only_the_best_of_a_task(spark, monkeypatch):
    """A batch of answers whose questions all share a word with all chunks."""
    from docloom.plans.answer import answer_many

    chunks = chunks_of(spark, [f"The queue number {i} holds one shared item of work." for i in range(800)], title="Queue")
    asked = spark.createDataFrame([(str(i), f"What does the shared queue number {i} hold?", 0.0, "auto") for i in range(40)], "qid string, question string, threshold double, style string")
    counts = _reaching(monkeypatch, sparse)
    got = {r["qid"]: r["evidence"][0]["chunk_id"] for r in answer_many(asked, chunks).collect()}
    assert got == {str(i): f"c{i}" for i in range(40)}
    assert counts[0] <= 40 * 20 * 4  # 4 tasks; there are 32,000 pairs
