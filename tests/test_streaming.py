from lodestone.engine import Engine
from lodestone.streaming.conversation import standalone_turns
from lodestone.streaming.ingest import follow_folder


def test_follow_folder(spark, tmp_path, caplog):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("# A\n\nFirst text.")
    engine = Engine(spark, str(tmp_path / "index"))
    follow_folder(engine, str(folder), str(tmp_path / "c")).awaitTermination()
    (folder / "b.txt").write_text("Second\n\nMore text.")
    (folder / "broken.pdf").write_bytes(b"no pdf")
    follow_folder(engine, str(folder), str(tmp_path / "c")).awaitTermination()
    assert "broken.pdf could not be read" in caplog.text
    assert [r["source"] for r in engine.sources().collect()] == ["a.md", "b.txt"]


def test_conversation_state(spark, tmp_path):
    for k, rows in enumerate([[("c", 1, "Who cleans the main mirror?"), ("d", 1, "Is it?"), ("d", 2, None)], [("c", 2, "Can they do it in rain?")], [("c", 3, "/reset"), ("c", 4, "Is it?")]]):
        spark.createDataFrame(rows, "conv_id string, turn int, question string").coalesce(1).write.parquet(str(tmp_path / "in" / f"n={k}"))
    turns = spark.readStream.schema("conv_id string, turn int, question string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "n=*"))
    q = standalone_turns(turns).writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["conv_id"], r["turn"]): r["standalone"] for r in spark.table("turns").collect()}
    assert got == {("c", 1): "Who cleans the main mirror?", ("c", 2): "Can they do it in rain? (cleans main mirror)", ("c", 4): "Is it?", ("d", 1): "Is it?"}
