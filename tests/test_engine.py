import json
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone.cli import main
from lodestone.engine import Engine
from lodestone.operators import ingest as I
from lodestone.server import handler

DOME = "# Dome\n\nOpen the dome shutter from the panel by the stairs.\n\n## Wind\n\nAbove force six the shutter closes within 40 seconds."
TOURS = "# Tours\n\n| Tour | Guests |\n|---|---|\n| Evening | Up to 12 |\n| School | 30 |\n\nEvery evening tour ends with a look at Saturn."


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([("guides/dome.md", "Dome", DOME), ("tours.md", "Tours", TOURS)], "source string, title string, text string")


@pytest.fixture()
def engine(spark, docs, tmp_path):
    e = Engine(spark, str(tmp_path / "index"))
    assert e.ingest(docs, origin="/corpus", tags=["Ops"]).added == ["guides/dome.md", "tours.md"]
    return e


def test_upsert(spark, engine, docs):
    again = engine.ingest(docs, origin="/corpus")
    assert (again.unchanged, again.chunks) == (["guides/dome.md", "tours.md"], 0)
    tags = {r["source"]: r["tags"] for r in engine.stats().collect()}
    assert tags == {"guides/dome.md": ["ops"], "tours.md": ["ops"]}
    edited = spark.createDataFrame([("tours.md", "Tours", TOURS + " Bring a coat."), ("new.md", None, "# New\n\nText.")], "source string, title string, text string")
    r = engine.ingest(edited, origin="/corpus", tags=[], prune=True)
    assert (r.updated, r.added, r.removed) == (["tours.md"], ["new.md"], ["guides/dome.md"])
    stats = {x["source"]: x for x in engine.stats().collect()}
    assert set(stats) == {"tours.md", "new.md"} and stats["tours.md"]["tags"] == []
    assert engine.store.table("vectors").count() == engine.store.table("chunks").count()
    with pytest.raises(ValueError):
        engine.ingest(docs, tags=["a,b"])


def files(path):
    return sorted(str(p) for p in path.rglob("*.parquet"))


def ranked(engine, *questions):
    q = engine.spark.createDataFrame(list(enumerate(questions)), "qid bigint, question string")
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9), r["text"]) for r in engine.search(q, k=10, mode="hybrid").collect())


def test_only_changes_are_written(spark, engine, docs, tmp_path):
    before = files(tmp_path / "index")
    engine.ingest(docs, origin="/corpus")
    assert files(tmp_path / "index") == before and engine.store.manifest()["segments"]["chunks"] == [int(before[0].split("seg=")[1].split("/")[0])]
    engine.ingest(docs, origin="/corpus", tags=["Night"])  # new tags are rows of documents, nothing else
    assert {r["source"]: r["tags"] for r in engine.stats().collect()} == {"guides/dome.md": ["night"], "tours.md": ["night"]} and engine.store.table("chunks").count() == 3
    edited = spark.createDataFrame([("tours.md", "Tours", "# Tours\n\nNo tours in August."), ("new.md", None, "# New\n\nA new shutter.")], "source string, title string, text string")
    engine.ingest(edited, origin="/corpus")
    engine.ingest(docs.filter("source = 'tours.md'"), origin="/corpus")  # changed back
    engine.remove(["new.md"])
    whole = Engine(spark, str(tmp_path / "whole"))
    whole.ingest(docs, origin="/corpus", tags=["Night"])
    asked = ("How is the dome shutter opened?", "evening tour guests", "August")
    want = ranked(whole, *asked)
    assert want and ranked(engine, *asked) == want and engine.store.stats().first() == whole.store.stats().first()
    assert {n: len(s) for n, s in engine.store.manifest()["segments"].items()} == {"documents": 4, "chunks": 3, "vectors": 3, "postings": 3, "gone": 4}
    engine.vacuum()
    assert ranked(engine, *asked) == want and set(map(len, engine.store.manifest()["segments"].values())) == {1, 0} and engine.store.stats().first() == whole.store.stats().first()
    for name in ("chunks", "vectors", "postings", "documents"):
        assert engine.store.table(name).count() == whole.store.table(name).count()


def test_a_commit_that_fails_changes_nothing(spark, engine, docs, monkeypatch):
    want = ranked(engine, "dome shutter")
    monkeypatch.setattr(type(engine.store), "_point", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine.ingest(docs.withColumn("text", F.lit("# Other\n\nwords")), origin="/corpus")
    monkeypatch.undo()
    assert ranked(engine, "dome shutter") == want
    engine.vacuum()
    assert ranked(engine, "dome shutter") == want


def test_conflicts_and_prefix(engine, docs):
    other = engine.ingest(docs.filter("source = 'tours.md'"), origin="/elsewhere")
    assert other.conflicts == {"tours.md": "/corpus"} and not other.added
    # a file ingested on its own belongs to the folder that holds it
    assert not engine.ingest(docs.filter("source = 'tours.md'"), origin="/corpus/tours.md").conflicts
    assert engine.ingest(docs, origin="/elsewhere", prefix="b/").added == ["b/guides/dome.md", "b/tours.md"]


def test_remove_vacuum_reset(spark, engine, tmp_path):
    assert [r["source"] for r in engine.remove(["guides"]).collect()] == ["guides/dome.md"] and engine.remove(["nowhere"]).count() == 0
    assert [r["source"] for r in engine.sources().collect()] == ["tours.md"]
    before, after = engine.vacuum()
    assert after < before
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "index"), "hash:64")
    engine.reset()
    assert engine.store.table("chunks").count() == 0
    Engine(spark, str(tmp_path / "index"), "hash:64")


def test_search_and_answer(spark, engine):
    q = spark.createDataFrame([(1, "How is the dome shutter opened?", None), (2, "How many guests may join the evening tour?", None), (3, "Does it close in a storm?", ["How is the dome shutter opened?"])], "qid int, question string, history array<string>")
    hits = engine.search(q, k=2, rerank="proximity").collect()
    assert {r["qid"]: r["source"] for r in hits if r["rank"] == 1} == {1: "guides/dome.md", 2: "tours.md", 3: "guides/dome.md"}
    assert {r["source"] for r in engine.search(q, sources=["tours*"]).collect()} == {"tours.md"}
    assert engine.search(q, tags=["none"]).count() == 0
    got = {r["qid"]: r["answer"] for r in engine.answer(q).collect()}
    assert got[2].startswith("Tour: Evening; Guests: Up to 12 [") and "40 seconds" in got[3]
    turns = spark.createDataFrame([("c", 1, "How is the dome shutter opened?"), ("c", 2, "Does it close in a storm?")], "conv_id string, turn int, question string")
    said = {r["turn"]: r for r in engine.converse(turns).collect()}
    assert said[2]["question"].endswith("(dome shutter opened)") and "40 seconds" in said[2]["answer"]


def test_another_process_is_seen(spark, engine, docs):
    engine.ask("open shutter")
    Engine(spark, engine.store.path).remove(["guides/dome.md"])
    assert all(s["source"] == "tours.md" for s in engine.ask("open shutter")["sources"])


def test_plugged_backends(spark, engine):
    e = Engine(spark, engine.store.path, answers=lambda q, hits: "Backend says [1]", rewrite=lambda q: "- open shutter\n- shutter panel", condenser=lambda q, h: "How is the dome shutter opened?")
    got = e.ask("Does it?", ["x y z"], multi=True)
    assert got["answer"] == "Backend says [1]" and got["mode"] == "backend" and got["sources"][0]["source"] == "guides/dome.md"

    def broken(*_):
        raise RuntimeError

    got = Engine(spark, engine.store.path, answers=broken, rewrite=broken, condenser=broken).ask("How is the dome shutter opened?", ["old"], multi=True)
    assert got["mode"] == "extractive" and "RuntimeError" in got["warning"]
    got = e.ask("Does it?", ["x y z"], multi=True, llm=False)
    assert got["mode"] == "extractive" and got["question"] == "Does it? (x y z)"
    e = Engine(spark, engine.store.path, condenser=broken, streamed=lambda q, hits: iter(["Up", " you go [1]"]))
    events = list(e.stream("How is the dome shutter opened?", ["Where?"]))
    assert [n for n, _ in events] == ["sources", "delta", "delta", "done"] and events[-1][1]["mode"] == "backend" and "carried" not in str(events) and "RuntimeError" in events[-1][1]["warning"]
    assert [d["mode"] for n, d in e.stream("How is the dome shutter opened?", llm=False) if n == "done"] == ["extractive"]


def test_evaluation(spark, engine):
    q = spark.createDataFrame([(1, "How is the dome shutter opened?", "guides/dome.md", "panel by the stairs"), (2, "What does every evening tour end with?", "tours.md", "saturn")], "qid bigint, question string, source string, contains string")
    rows = {r["mode"]: r for r in engine.evaluate(q).collect()}
    assert set(rows) == {"bm25", "dense", "hybrid", "hybrid+proximity", "hybrid+mmr"} and rows["hybrid"]["recall_5"] == 1.0 and rows["hybrid"]["mrr"] >= 0.75
    assert engine.evaluate_answers(q).first()["found"] == 1.0
    assert all(r["correct"] and r["grounded"] for r in engine.judge(q).collect())


def test_classification(spark):
    new = spark.createDataFrame([("a", "t", "x", "o"), ("b", "t", "x", "o"), ("c", "t", "x", "o/c"), ("d", None, None, "")], "source string, title string, text string, origin string")
    hash_of = {r["source"]: r["h"] for r in new.select("source", I.content_hash().alias("h")).collect()}
    old = spark.createDataFrame([("a", "o", hash_of["a"]), ("b", "p", "x"), ("c", "o", "x"), ("d", "q", hash_of["d"])], "source string, origin string, hash string")
    assert {r["source"]: r["action"] for r in I.classify(new, old).collect()} == {"a": "unchanged", "b": "conflict", "c": "updated", "d": "unchanged"}


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "corpus"
    folder.mkdir()
    (folder / "dome.md").write_text(DOME)
    (folder / "bad.pdf").write_bytes(b"no pdf")
    index = ["--index", str(tmp_path / "i")]
    run = lambda *a: main([*index, *a], spark)
    assert run("ask", "open?") == 2
    assert run("ingest", str(folder), "--tag", "ops") == 0 and run("ingest", str(tmp_path / "nowhere")) == 2
    assert "bad.pdf could not be read" in capsys.readouterr().err
    assert run("ask", "How is the dome shutter opened?", "--json") == 0
    out = capsys.readouterr().out.strip().splitlines()[-1]
    assert json.loads(out)["sources"][0]["source"] == "dome.md"
    assert run("ask", "How is the dome shutter opened?", "--no-llm") == 0
    assert run("stats", "--json") == 0 and run("vacuum") == 0 and run("ask", "x", "-k", "0") == 2
    (tmp_path / "q.json").write_text(json.dumps([{"question": "How is the dome shutter opened?", "source": "dome.md", "contains": "panel by the stairs"}]))
    assert run("eval", "--questions", str(tmp_path / "q.json"), "--modes", "bm25,hybrid", "--judge", "--no-llm", "--json") == 0
    assert run("remove", "dome.md") == 0 and run("remove", "dome.md") == 1


def test_service(engine):
    with ThreadingHTTPServer(("127.0.0.1", 0), handler(engine)) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_address[1]}"

        def post(path, body, raw=None):
            request = urllib.request.Request(base + path, data=raw if raw is not None else json.dumps(body).encode())
            try:
                with urllib.request.urlopen(request) as r:
                    return r.status, r.read().decode()
            except urllib.error.HTTPError as e:
                return e.code, e.read().decode()

        with urllib.request.urlopen(base + "/api/health?x=1") as r:
            assert json.loads(r.read())["chunks"] == 3
        with urllib.request.urlopen(base + "/?x=1") as r:
            page = r.read().decode()
            assert r.headers.get_content_type() == "text/html" and "/api/ask/stream" in page and "innerHTML" not in page
        engine.answers, engine.streamed = (lambda q, hits: "From a model [1]"), lambda q, hits: iter(["From", " a model"])
        assert json.loads(post("/api/ask", {"question": "dome shutter"})[1])["mode"] == "backend" and json.loads(post("/api/ask", {"question": "dome shutter", "llm": False})[1])["mode"] == "extractive"
        assert post("/api/ask/stream", {"question": "dome shutter"})[1].count("event: delta") == 2 and post("/api/ask/stream", {"question": "dome shutter", "llm": False})[1].count("event: delta") == 1
        engine.answers = engine.streamed = None
        status, body = post("/api/ask", {"question": "What does every evening tour end with?", "k": 2})
        assert status == 200 and "look at Saturn" in json.loads(body)["answer"]
        status, body = post("/api/ask/stream", {"question": "What does every evening tour end with?"})
        assert [x.split(": ")[1] for x in body.splitlines() if x.startswith("event")] == ["sources", "delta", "done"]
        assert post("/api/ask", {"question": ""})[0] == 400 and post("/api/ask", None, b"[1]")[0] == 400 and post("/api/ask", None, b"{")[0] == 400
        assert post("/api/ask", {"question": "x" * 70000})[0] == 413 and post("/api/other", {})[0] == 404
        server.shutdown()
