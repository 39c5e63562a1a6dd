"""Processing only new or changed records: which deliveries the next run has to take.

A delivery is a row of ``documents``; its file is origin + source, its version the hash. The ledger
says which versions earlier attempts took in, ``ingest_runs`` which attempts succeeded. The next run
takes the newest delivery of each file whose version isn't the one last recorded by a successful run:
an anti-join of (file, version) pairs, so that an attempt that failed half-way leaves nothing behind
that counts as done, and a run that is repeated finds nothing twice.

What has to be read again reaches back to the oldest attempt that was still open when the last
successful run of its origin started (``reread_from``). Deliveries are skipped unread only where an
*arrival* column is named; ``ingested_at`` can't serve for it, as it may lie long before a row really
arrived.

Rules: origins agree regardless of case, outer blanks and trailing slashes; hashes regardless of
case. A null ``ingested_at`` is oldest; of equal ones the greater doc_id is newest. A null hash is
computed: SHA-256 of ``800:150``, line feed, title, line feed, text, null being empty. A run is
successful if finished_at is set and its status is ok or succeeded, in any case. Null origins and
sources are keys like any other; repeated ledger rows count once; ledger rows of unknown runs don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SETTINGS = "800:150"


def origin_key(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")), "/+$", "")


def version(settings: str = SETTINGS) -> Column:
    """The hash in lower case, or, where it is null, what it should be."""
    text = F.concat(F.lit(f"{settings}\n"), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return F.lower(F.trim(F.coalesce(F.col("hash"), F.sha2(text, 256))))


def successful_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("finished_at").isNotNull() & F.lower(F.trim("status")).isin("ok", "succeeded"))


def reread_from(runs: DataFrame) -> DataFrame:
    """``origin, reread_from``: start of the oldest attempt open when the origin's last successful run started."""
    key = origin_key(F.coalesce("origin", F.lit(""))).alias("origin")
    last = successful_runs(runs).groupBy(key).agg(F.max("started_at").alias("last_start"))
    r = runs.select(key, "started_at", "finished_at")
    # open: not finished, or finished only after the last run had started; the last run itself counts
    open_then = (F.col("started_at") <= F.col("last_start")) & (F.col("finished_at").isNull() | (F.col("finished_at") >= F.col("last_start")))
    return r.join(last, "origin").filter(open_then).groupBy("origin").agg(F.min("started_at").alias("reread_from"))


def newest_deliveries(docs: DataFrame, arrival: str | None = None) -> DataFrame:
    """``origin, source, doc_id, version`` of the newest delivery of each file; with ``arrival`` also when the
    last of its rows arrived, and whether that is unknown of any. One partial aggregate; texts never
    leave the map side."""
    newest = F.struct(F.col("ingested_at").isNotNull().alias("dated"), "ingested_at", "doc_id", version().alias("version"))
    arrived = [F.max(arrival).alias("arrived"), F.max(F.col(arrival).isNull()).alias("undated")] if arrival else []
    files = docs.groupBy(origin_key(F.coalesce("origin", F.lit(""))).alias("origin"), F.col("source")).agg(F.max(newest).alias("d"), *arrived)
    return files.select("origin", "source", "d.doc_id", "d.version", F.col("d.ingested_at").alias("ingested_at"), *(["arrived", "undated"] if arrival else []))


def recorded_versions(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """``origin, source, version`` last recorded for each file by a successful run."""
    done = ledger.join(successful_runs(runs).select("run_id").distinct(), "run_id", "left_semi")
    last = F.struct(F.col("processed_at").isNotNull().alias("dated"), "processed_at", "run_id", F.lower(F.trim("hash")).alias("version"))
    files = done.groupBy(origin_key(F.coalesce("origin", F.lit(""))).alias("origin"), F.col("source")).agg(F.max(last).alias("d"))
    return files.select("origin", "source", F.col("d.version").alias("version"))


def next_run(docs: DataFrame, runs: DataFrame, ledger: DataFrame, arrival: str | None = None) -> DataFrame:
    """``origin, source, doc_id, version``: the deliveries to take.

    ``arrival`` names a column that says when a row really arrived. If it is given, only files count of
    which a delivery arrived at or after ``reread_from`` of their origin, or at a time unknown: of the
    others the last successful run had everything. Which delivery of such a file is the newest is still
    decided over all its rows, so that an older one that arrives late doesn't pass for it.
    """
    files, done = newest_deliveries(docs, arrival), recorded_versions(ledger, runs)
    if arrival is not None:
        marks = reread_from(runs).select(F.col("origin").alias("_origin"), "reread_from")
        files = files.join(marks, F.col("origin") == F.col("_origin"), "left")
        files = files.filter(F.col("reread_from").isNull() | F.col("undated") | (F.col("arrived") >= F.col("reread_from"))).drop("_origin")
    same = files["origin"].eqNullSafe(done["origin"]) & files["source"].eqNullSafe(done["source"]) & files["version"].eqNullSafe(done["version"])
    return files.join(done, same, "left_anti").select("origin", "source", "doc_id", "version")
