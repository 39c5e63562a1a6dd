import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from lodestone.operators import incremental as N

DOC = "doc_id bigint, source string, title string, text string, origin string, hash string, ingested_at timestamp"
RUN = "run_id bigint, origin string, started_at timestamp, finished_at timestamp, status string"
LED = "run_id bigint, origin string, source string, hash string, processed_at timestamp"


def at(day, hour=0):
    return datetime(2025, 1, day, hour)


def tables(spark, docs, runs, ledger):
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(runs, RUN), spark.createDataFrame(ledger, LED)


def taken(spark, docs, runs, ledger, **options):
    return sorted(r["doc_id"] for r in N.next_run(*tables(spark, docs, runs, ledger), **options).collect())


RUNS = [(1, "o", at(1), at(1, 2), "OK"), (2, "o", at(2), at(2, 1), "failed"), (3, "o", at(3), None, "ok"), (4, "o", at(4), at(4, 1), "Succeeded"), (5, "o", at(5), at(5, 1), None)]


def test_new_changed_and_known(spark):
    docs = [
        (1, "a", None, None, "O/", "AA", at(1)), (2, "b", None, None, " o", "bb", at(1)), (3, "c", None, None, "o", "cc", at(1)),
        (4, "d", None, None, "o", "d1", at(1)), (5, "d", None, None, "o", "d2", at(2)), (6, "e", None, None, "o", "e2", at(1)),
    ]
    ledger = [(1, "o", "a", "aa", at(1)), (2, "o", "b", "bb", at(2)), (4, "O//", "d", "d1", at(4)), (1, "o", "e", "e2", at(1)), (4, "o", "e", "e1", at(4))]
    # a is known; b only by a failed run; c is new; d has changed; e was changed back
    assert taken(spark, docs, RUNS, ledger) == [2, 3, 5, 6]
    # and once a run has taken them, nothing is left
    done = ledger + [(6, "o", s, h, at(6)) for s, h in (("b", "bb"), ("c", "cc"), ("d", "d2"), ("e", "E2"))]
    assert taken(spark, docs, [*RUNS, (6, "o", at(6), at(6, 1), "ok")], done + done) == []
    # a run that failed half-way leaves all of it for the next
    assert taken(spark, docs, [*RUNS, (6, "o", at(6), at(6, 1), "failed")], done) == [2, 3, 5, 6]


def test_newest_delivery(spark):
    docs = [(1, "a", None, None, "o", "x", None), (2, "a", None, None, "o", "y", at(1)), (3, "a", None, None, "o", "z", at(1)), (9, "n", None, None, None, "n1", None), (8, "n", None, None, None, "n2", None)]
    assert taken(spark, docs, [], []) == [3, 9]


def test_hash_is_computed(spark):
    h = hashlib.sha256(b"800:150\nT\n").hexdigest()
    docs = [(1, "a", "T", None, "o", None, at(1)), (2, "b", "T", "x", "o", None, at(1))]
    assert taken(spark, docs, RUNS, [(1, "o", "a", h.upper(), at(1)), (1, "o", "b", h, at(1))]) == [2]


def test_empty_and_null_keys(spark):
    assert taken(spark, [], RUNS, []) == []
    assert taken(spark, [(1, None, None, None, None, "x", None)], RUNS, [(1, None, None, "X", at(1))]) == []
    docs, runs, ledger = tables(spark, [(1, "a", None, None, "o", "x", None)], RUNS, [(1, "o", "a", "y", None), (1, "o", "a", None, None)])
    extra = docs.withColumn("run_id", F.lit(7)).withColumn("status", F.lit("?"))
    assert [r["doc_id"] for r in N.next_run(extra, runs, ledger).collect()] == [1]


def test_reread(spark):
    # runs 3 (never finished) and 4 itself were open when 4, the last successful one, started
    got = {r["origin"]: r["reread_from"] for r in N.reread_from(spark.createDataFrame(RUNS + [(7, "p", at(1), None, "ok")], RUN)).collect()}
    assert got == {"o": at(3)}
    docs = [(1, "a", None, None, "o", "x", at(1)), (2, "b", None, None, "o", "y", at(4))]
    assert taken(spark, docs, RUNS, []) == [1, 2]
    assert taken(spark, docs, RUNS, [], arrival="ingested_at") == [2]


def test_an_older_delivery_that_arrives_late_is_not_the_newest(spark):
    docs = [(1, "a", None, None, "o", "new", at(2)), (2, "a", None, None, "o", "old", at(1)), (3, "b", None, None, "o", "x", at(1)), (4, "c", None, None, "o", "c1", at(1)), (5, "c", None, None, "o", "c2", at(2))]
    arrived = {1: at(2), 2: at(6), 3: None, 4: at(6), 5: at(2)}
    ledger = [(4, "o", "a", "new", at(4)), (4, "o", "c", "c1", at(4))]
    frames = tables(spark, docs, RUNS, ledger)
    dated = frames[0].join(spark.createDataFrame(list(arrived.items()), "doc_id bigint, seen timestamp"), "doc_id")
    # a: the newest is recorded, though an older one came late; b: when it came isn't known; c: touched, and its newest isn't recorded
    assert sorted(r["doc_id"] for r in N.next_run(dated, *frames[1:], arrival="seen").collect()) == [3, 5]
    assert sorted(r["doc_id"] for r in N.next_run(dated, *frames[1:]).collect()) == [3, 5]
