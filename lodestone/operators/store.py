"""Tables of an index as segments: a change writes the changed documents only, and a pointer makes it visible.

Every commit adds one segment: Parquet folders ``<table>/seg=<number>`` with the new rows of documents,
chunks, vectors and postings, and with tombstones (``gone``) of the sources whose earlier rows no longer
hold. A row holds if no later segment has a tombstone for its source. Which segments there are stands in
a small manifest; the file ``CURRENT`` names the manifest and is replaced atomically, so a job that dies
half-way leaves the index as it was, and readers, who resolve the pointer per request, see what another
process committed. ``compact`` rewrites what holds as one segment, ``vacuum`` does so and deletes the rest.

Chunks are range-partitioned by source, so that source filters prune files; postings by term and id, so
that the postings of a frequent term spread over partitions and those of a rare one are found by file
statistics. Numbers of records and tokens are kept in the manifest.
"""

from __future__ import annotations

import json
import posixpath
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import indexed_text
from lodestone.operators import dense
from lodestone.operators.index import postings, record_lengths

TABLES = {
    "documents": "source string, title string, origin string, hash string, ingested_at timestamp, tags array<string>",
    "chunks": "id string, source string, title string, heading string, text string, position int, dl int",
    "vectors": "id string, vector array<float>",
    "postings": "id string, dl int, term string, tf bigint",
    "gone": "source string, chunks boolean",
}
#: Tombstones that are broadcast at most; more are joined.
BROADCAST_GONE = 500_000


def _empty() -> dict:
    return {"embedder": None, "segments": {name: [] for name in TABLES}, "records": 0, "tokens": 0, "gone": 0}


def columns(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name].split(", ")]


class Store:
    def __init__(self, spark: SparkSession, path: str, embedder: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        stored = self.manifest()["embedder"]
        if stored and embedder and stored != embedder:
            raise ValueError(f"the index was built with embedder {stored!r}; reset it to switch to {embedder!r}")
        self.embedder = stored or embedder or "hash:1024"
        dense.embedder(self.embedder)

    # files -------------------------------------------------------------------------------------
    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.path}/{name}")
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, body: str) -> None:
        """Write a file aside and rename it over the one of that name."""
        tmp = self._path(f"{self.path}/.{name}-{uuid.uuid4().hex}")
        out = self.fs.create(tmp, True)
        out.write(bytearray(body.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri() if "://" in self.path else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        gateway = self.spark.sparkContext._gateway
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        flags = gateway.new_array(rename, 1)
        flags[0] = rename.OVERWRITE
        context.rename(self.fs.makeQualified(tmp), self.fs.makeQualified(self._path(f"{self.path}/{name}")), flags)

    def version(self) -> str | None:
        return self._read("CURRENT")

    def exists(self) -> bool:
        return self.version() is not None

    def manifest(self) -> dict:
        v = self.version()
        return _empty() | json.loads(self._read(f"{v}.json") or "{}") if v else _empty()

    # reading -----------------------------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        """The rows of a table that hold."""
        return self._holding(name, self.manifest()).select(*columns(name))

    def _segments(self, name: str, m: dict) -> DataFrame:
        if not m["segments"][name]:
            return self.spark.createDataFrame([], f"{TABLES[name]}, seg bigint")
        paths = [f"{self.path}/{name}/seg={s}" for s in m["segments"][name]]
        return self.spark.read.schema(f"{TABLES[name]}, seg bigint").option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _holding(self, name: str, m: dict) -> DataFrame:
        rows = self._segments(name, m)
        if not m["gone"]:
            return rows
        gone = self._segments("gone", m)
        if name != "documents":
            gone = gone.filter("chunks")
        last = gone.groupBy(F.col("source").alias("_source")).agg(F.max("seg").alias("_upto"))
        last = F.broadcast(last) if m["gone"] <= BROADCAST_GONE else last
        source = F.col("source") if "source" in columns(name) else F.regexp_replace("id", "#[0-9]+$", "")
        return rows.join(last, (source == F.col("_source")) & (F.col("seg") < F.col("_upto")), "left_anti")

    def stats(self) -> DataFrame:
        """One row: ``n, avgdl``."""
        m = self.manifest()
        return self.spark.createDataFrame([(m["records"], m["tokens"] / m["records"] if m["records"] else 0.0)], "n bigint, avgdl double")

    # writing -----------------------------------------------------------------------------------
    def append(self, documents: DataFrame | None = None, chunks: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Add a segment: rows of new and changed documents, their chunks (id, source, title, heading, text,
        position; each id once), and tombstones (source, chunks) of what no longer holds in earlier
        segments: the document's row, and with ``chunks`` its chunks too. Gives the number of chunks added."""
        m = self.manifest()
        seg = self._next(m)
        at = lambda name: f"{self.path}/{name}/seg={seg}"
        added: dict[str, list[int]] = {}
        new, dead, marks = (0, 0), (0, 0), 0
        if documents is not None:
            documents.select(*columns("documents")).write.parquet(at("documents"))
            added["documents"] = [seg]
        if gone is not None:
            gone.select(*columns("gone")).write.parquet(at("gone"))
            added["gone"] = [seg]
            void = self.spark.read.schema(TABLES["gone"]).parquet(at("gone"))
            marks = void.count()
            if m["records"]:
                dead = self._sizes(self._holding("chunks", m).join(void.filter("chunks").select("source").distinct(), "source", "left_semi"))
        if chunks is not None:
            new = self._write_chunks(chunks, at)
            added |= {name: [seg] for name in ("chunks", "vectors", "postings")}
        segments = {name: m["segments"][name] + added.get(name, []) for name in TABLES}
        self._point({**m, "embedder": self.embedder, "segments": segments, "records": m["records"] - dead[0] + new[0], "tokens": m["tokens"] - dead[1] + new[1], "gone": m["gone"] + marks})
        return new[0]

    @staticmethod
    def _next(m: dict) -> int:
        """A number above those of all segments, that no attempt before has used."""
        return max([time.time_ns() // 1000, *(s + 1 for some in m["segments"].values() for s in some)])

    def _write_chunks(self, chunks: DataFrame, at: Callable[[str], str]) -> tuple[int, int]:
        """Write chunks with their lengths, vectors and postings; numbers of chunks and of tokens."""
        plain = [c for c in columns("chunks") if c != "dl"]
        bodies = chunks.select(F.struct(*plain).alias("id"), indexed_text().alias("text"))
        sized = record_lengths(bodies).select("id.*", F.col("tokens").alias("dl"))
        sized.repartitionByRange("source", "position").sortWithinPartitions("source", "position").write.parquet(at("chunks"))
        written = self.spark.read.schema(TABLES["chunks"]).parquet(at("chunks"))
        docs = written.select("id", indexed_text().alias("text"))
        dense.embed(docs, "text", self.embedder).write.parquet(at("vectors"))
        posts = postings(docs).select(*columns("postings"))
        posts.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(at("postings"))
        return self._sizes(written)

    @staticmethod
    def _sizes(chunks: DataFrame) -> tuple[int, int]:
        row = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        return row["n"], row["dl"]

    def _point(self, manifest: dict) -> None:
        v = f"m-{uuid.uuid4().hex}"
        self._write(f"{v}.json", json.dumps(manifest))
        self._write("CURRENT", v)

    def compact(self) -> None:
        """Rewrite what holds as one segment; nothing is read into tokens or vectors again."""
        m = self.manifest()
        if all(len(some) < 2 for some in m["segments"].values()) and not m["gone"]:
            return
        seg = self._next(m)
        order = {"chunks": ("source", "position"), "postings": ("term", "id")}
        held = [name for name in TABLES if name != "gone" and m["segments"][name]]
        for name in held:
            rows = self._holding(name, m).select(*columns(name))
            if name in order:
                rows = rows.repartitionByRange(*order[name]).sortWithinPartitions(*order[name])
            rows.write.parquet(f"{self.path}/{name}/seg={seg}")
        self._point({**m, "segments": {name: [seg] if name in held else [] for name in TABLES}, "gone": 0})

    def reset(self) -> None:
        """Back to no documents, chunks or embedder; earlier segments stay until ``vacuum``."""
        if self.fs.exists(self._path(f"{self.path}/CURRENT")):
            self.fs.delete(self._path(f"{self.path}/CURRENT"), False)

    def size(self) -> int:
        p = self._path(self.path)
        return self.fs.getContentSummary(p).getLength() if self.fs.exists(p) else 0

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return [posixpath.basename(s.getPath().toString()) for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def vacuum(self) -> tuple[int, int]:
        """Compact, then delete segments and manifests that nothing points to; bytes before and after."""
        before = self.size()
        self.compact()
        keep = {f"seg={s}" for some in self.manifest()["segments"].values() for s in some} | {f"{self.version()}.json"}
        for folder, pattern in [(f"{self.path}/{name}", r"seg=\d+") for name in TABLES] + [(self.path, r"\.?m-[0-9a-f]+\.json.*")]:
            for name in self._names(folder):
                if re.fullmatch(pattern, name) and name not in keep:
                    self.fs.delete(self._path(f"{folder}/{name}"), True)
        return before, self.size()
