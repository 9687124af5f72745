"""The engine end to end on a small table, streaming ingestion, artifacts and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from docloom import __main__ as cli
from docloom.plans.engine import Engine
from docloom.sources import artifacts
from docloom.streaming import ingest
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index")))
    with pytest.raises(FileNotFoundError):
        e.chunks()
    assert not e.status()["ready"]
    docs = spark.read.parquet(f"{SMALL}/crawl_docs.parquet").dropDuplicates(["doc_id"])
    with pytest.raises(RuntimeError):
        e.build(docs.limit(0))
    e.manifest = e.build(docs)
    return e


def test_build(engine):
    assert engine.manifest["document_count"] > 40 and engine.manifest["chunk_count"] > 300
    assert engine.status()["ready"]


def test_ask(engine):
    chunk = engine.chunks().where("token_length > 20 and chunk_text rlike '[a-z]+_[a-z]+'").orderBy("chunk_id").first()
    name = [w for w in chunk["chunk_text"].split() if "_" in w and w.isascii()][0].strip(".,;:")
    a = engine.ask(f"What does {name} return for a queue?", 0.0)
    assert a["answer_type"] in ("answer", "no_answer") and len(a["evidence"]) <= 5 and len(a["support_sentences"]) <= 6
    assert [e["reranker_score"] for e in a["evidence"]] == sorted((e["reranker_score"] for e in a["evidence"]), reverse=True)
    assert any(name in e["context_preview"] for e in a["evidence"])
    for bad in (("ab", 0.1), ("a question", 1.5), ("   \n ", 0.1)):
        with pytest.raises(ValueError):
            engine.ask(*bad)


def test_asking_reads_the_index(engine, spark):
    asked = spark.createDataFrame([(1, "What does the queue return?", 0.0, "auto")], "qid bigint, question string, threshold double, style string")
    from docloom.plans.answer import answer_many

    drop = lambda df: df.drop("qid").first().asDict(recursive=True)
    assert drop(engine.answers(asked)) == drop(answer_many(asked, engine.chunks()))
    # a search by the index never names the text of a chunk
    from docloom.operators.sparse import bm25_search

    plan = bm25_search(asked.select("qid", "question"), None, index=engine.index())._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk_text" not in plan and "regexp_extract_all" not in plan


def test_answers_in_blocks(engine, spark, tmp_path):
    from docloom.config import EngineConfig

    small = Engine(spark, engine.root, EngineConfig(question_block=2))
    asked = spark.createDataFrame([(i, f"What does the queue number {i} return?", 0.0, "auto") for i in range(5)], "qid bigint, question string, threshold double, style string")
    got = small.answer_table(asked, f"{tmp_path}/answers")
    assert sorted(r["qid"] for r in got.collect()) == [0, 1, 2, 3, 4]


def test_server(engine):
    import threading
    import urllib.error
    import urllib.request

    from docloom.plans.server import make_server

    server = make_server(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        get = lambda path, data=None: json.loads(urllib.request.urlopen(urllib.request.Request(url + path, data)).read())
        assert get("/api/health") == {"status": "ok"} and get("/api/status")["ready"]
        assert b"<form" in urllib.request.urlopen(url + "/").read()
        assert get("/api/ask", json.dumps({"question": "What does the queue return?"}).encode())["answer_type"] in ("answer", "no_answer")
        for path, body, status in (("/api/ask", b"{}", 422), ("/api/ask", b'{"question": "ab"}', 422), ("/nothing", None, 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(path, body)
            assert e.value.code == status
    finally:
        server.shutdown()


def test_crawl_build_train(spark, tmp_path):
    from docloom.plans.queries import _site

    e = Engine(spark, f"{tmp_path}/site")
    manifest = e.build_from_pages(*_site(spark, SMALL))
    assert manifest["document_count"] > 10 and {r["source_name"] for r in manifest["crawl_report"]} and e.status()["ready"]
    raw, docs = (spark.read.parquet(f"{e.root}/{n}") for n in ("raw", "documents"))
    assert raw.count() == docs.join(raw.select("raw_file_path"), "raw_file_path").count() == docs.count()
    artifacts.write_documents_json(docs, f"{tmp_path}/docs")
    assert artifacts.read_documents_json(spark, f"{tmp_path}/docs").count() == docs.count()
    before = spark.read.parquet(f"{e.root}/dense").orderBy("chunk_id").collect()
    pairs = spark.createDataFrame([(f"page {i} words", f"page of some words {i}") for i in range(20)], "query string, positive string")
    assert e.train(pairs)["trained_pairs"] == 20 and len(e.weights()) == e.config.embedding_dim
    assert spark.read.parquet(f"{e.root}/dense").orderBy("chunk_id").collect() != before
    assert e.ask("What are some words?", 0.0)["evidence"]


def test_evaluate(engine, spark, tmp_path):
    items = spark.read.parquet(f"{SMALL}/eval_items.parquet").orderBy("id").limit(6)
    examples, summaries = engine.evaluate(items, (0.0, 0.99))
    assert examples.count() == 12 and summaries.count() == 2
    for r in summaries.collect():
        assert all(0 <= r[c] <= 1 for c in r.asDict() if c.startswith(("qa", "retrieval", "no_answer", "overall")))
    text = engine.report(examples, summaries, tmp_path / "r" / "report.md")
    assert "## Errors" in text and (tmp_path / "r" / "report.md").exists()
    assert len(json.loads((tmp_path / "r" / "report.json").read_text())["summaries"]) == 2


def test_pairs_and_eval_json(spark, tmp_path):
    pairs = spark.createDataFrame([("q", "p", "u", "k")], artifacts.PAIR_SCHEMA)
    artifacts.write_pairs(pairs, f"{tmp_path}/pairs")
    assert artifacts.read_pairs(spark, f"{tmp_path}/pairs").collect() == pairs.collect()
    (tmp_path / "e.json").write_text(json.dumps([{"id": "i", "question": "q?", "answers": ["a"], "gold_chunk_ids": [], "gold_source_urls": ["u"], "answerable": True}]))
    row = artifacts.read_eval_set(spark, f"{tmp_path}/e.json").first()
    assert row["id"] == "i" and row["required_terms"] is None
    assert artifacts.jsonable({"p": tmp_path, "t": (1, [2])}) == {"p": str(tmp_path), "t": [1, [2]]}


def test_command_line(engine, capsys, spark):
    cli.main(["status", "--root", engine.root])
    assert json.loads(capsys.readouterr().out)["ready"] is True


def test_streaming_chunks_equal_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/crawl_docs.parquet").limit(20)
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = ingest.document_stream(spark, f"{tmp_path}/in", 1)
    for _ in range(2):  # the second run finds nothing new
        ingest.append_chunks(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    from docloom.operators.chunking import build_chunks, passed_gate

    batch = build_chunks(docs.where(passed_gate("clean_text")))
    assert spark.read.parquet(f"{tmp_path}/out").count() == batch.count()


def test_fetch_counts_on_tables(spark):
    log = spark.read.parquet(f"{SMALL}/crawl_fetches.parquet")
    total = ingest.fetch_counts(log).agg(F.sum("fetches")).first()[0]
    assert total == log.select("fetch_id").distinct().count()
