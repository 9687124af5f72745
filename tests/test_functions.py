"""Text, URL and HTML rules: handmade cases, and pure-Python restatements over whole tables."""

import hashlib
import re
import string

import pytest
from pyspark.sql import functions as F

from docloom.config import STOPWORDS
from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.functions.html import extract_page
from tests.conftest import SMALL


def one(spark, expression, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} {'string' if not isinstance(columns[n], list) else 'array<string>'}" for n in names))
    return df.select(expression.alias("x")).first()["x"]


def py_norm(x):
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", x.replace("\r", "\n"))).strip()


def py_tokens(x):
    return [t for t in re.findall(r"[a-z0-9_/.+-]+", py_norm(x).lower()) if t not in STOPWORDS]


def py_sentences(x):
    done, held = [], ""
    for part in (py_norm(p) for p in re.split(r"(?<=[.!?])\s+|\n+", py_norm(x))):
        if not part:
            continue
        held = f"{held} {part}" if held else part
        if len(held.split()) >= 8 or part[-1] in ".!?":
            done.append(held)
            held = ""
    if held:
        done[-1:] = [f"{done[-1]} {held}"] if done else [held]
    return done


def test_whole_table_against_python(spark):
    docs = spark.read.parquet(f"{SMALL}/crawl_docs.parquet").select("clean_text")
    rows = docs.select("clean_text", T.normalize_ws("clean_text").alias("n"), T.tokenize("clean_text").alias("t"), T.split_sentences("clean_text").alias("s")).collect()
    for r in rows:
        assert r["n"] == py_norm(r["clean_text"])
        assert r["t"] == py_tokens(r["clean_text"])
        assert r["s"] == py_sentences(r["clean_text"])


@pytest.mark.parametrize("text, expected", [("Alpha. Beta? Gamma!", ["Alpha.", "Beta?", "Gamma!"]), ("Heading\nThis is a sentence of its own.", ["Heading This is a sentence of its own."]), ("One sentence ends here. tail", ["One sentence ends here. tail"]), ("", []), ("just words", ["just words"])])
def test_sentences(spark, text, expected):
    assert one(spark, T.split_sentences("x"), x=text) == expected


def test_nulls(spark):
    assert one(spark, T.split_sentences("x"), x=None) is None
    assert one(spark, T.tokenize("x"), x=None) is None


@pytest.mark.parametrize("question, style", [("difference between loc and iloc", "explanatory"), ("Please show the flag", "explanatory"), ("Which port is used", "extractive")])
def test_style(spark, question, style):
    assert one(spark, T.question_style("x"), x=question) == style


def test_expansion_keeps_parts_once(spark):
    assert one(spark, T.expand_query("x"), x="csv") == "csv read_csv to_csv csv"
    assert one(spark, T.expand_query("x"), x="Set the headers now") == "Set the headers now response headers header response Set the headers now"
    assert one(spark, T.expand_query("x"), x="a b a b") == "a b a b a b"


def test_compare_terms(spark):
    r = one(spark, T.compare_terms("x"), x="What is the difference between loc and iloc in pandas?")
    assert (r["left"], r["right"]) == ("loc", "iloc")
    assert one(spark, T.compare_terms("x"), x="Compare loc and iloc") is None
    assert one(spark, T.compare_term("x"), x="merge() when used with keys.") == "merge"


@pytest.mark.parametrize("text, expected", [("The X- prefix.", "x prefix"), ("A an the", ""), ("Éa the é", "éa é"), ("don't", "dont")])
def test_normalize_answer(spark, text, expected):
    assert one(spark, T.normalize_answer("x"), x=text) == expected
    low = re.sub(r"\b(a|an|the)\b", " ", text.lower().strip())
    assert expected == " ".join("".join(c for c in low if c not in string.punctuation).split())


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://Docs.Example/A/", "https://docs.example/A"), ("https://x.example#frag", "https://x.example/"), ("https://x.example:8080/a;p=1?q=2#z", "https://x.example:8080/a?q=2"),
        (" https://x.example/a//  ", "https://x.example/a/"), ("https://x.example", "https://x.example/"), ("https://u@X.example/?Q=A", "https://u@x.example/?Q=A"),
    ],
)
def test_normalize_url(spark, url, expected):
    assert one(spark, U.normalize_url("x"), x=url) == expected


def test_ids(spark):
    url = "https://x.example/a"
    assert one(spark, U.document_id("s", "u"), s="Osprel Kit", u=url) == "osprel_kit_" + hashlib.sha1(url.encode()).hexdigest()[:12]
    assert one(spark, U.chunk_id(F.lit("d"), F.lit(1000)), x="") == "d_chunk_1000"
    assert one(spark, U.chunk_id(F.lit("d"), F.lit(7)), x="") == "d_chunk_007"


def test_valid_url(spark):
    check = lambda u: one(spark, U.is_valid_url("u", "n", "p"), u=u, n="docs.x.example", p=["/guide/", r"/ref/\d+"])
    assert check("https://docs.x.example/guide/a") and check("http://docs.x.example:80/ref/12")
    assert not check("ftp://docs.x.example/guide/a") and not check("https://other.example/guide/a")
    assert not check("https://docs.x.example/guide/a.PNG") and not check("https://docs.x.example/about")


def test_extract_page():
    page = """<html><head><title> A  title </title><style>p{}</style></head><body><header><h1>Lost</h1></header><nav><a href="/n">n</a></nav>
    <div class="content"><h1>Head <b>one</b></h1><p>First line.</p><div class="toc">gone</div><p>Next</p><p>a<br>b</p></div><main>short</main><script>x=1</script></body></html>"""
    title, section, text, links = extract_page(page)
    assert (title, section) == ("A title", "Head one")
    assert text == "Head\none\nFirst line.\na\nb"
    assert links == ["/n"]
    assert extract_page(None) == ("Untitled", "", "", [])
    assert extract_page("<p>only text")[2] == "only text"


def test_resolve_links(spark):
    df = spark.createDataFrame([("https://x.example/a/b", " ../c "), ("https://x.example/a", None), (None, "q")], "b string, l string")
    assert [r[0] for r in df.select(U.resolve_link("b", "l")).collect()] == ["https://x.example/c", "https://x.example/a", "q"]
