"""Continuous ingest: new files of a folder, merged in micro-batches by the same upsert."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.engine import Engine
from lodestone.session import cut_lineage
from lodestone.sources import loaders

log = logging.getLogger(__name__)


def follow_folder(engine: Engine, folder: str, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """A stream over the files of a folder. A batch that is repeated after a failure finds its documents
    unchanged by their hash, so nothing is taken twice. Files that can't be read are logged and passed over."""
    files = engine.spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema(
        "path string, modificationTime timestamp, length bigint, content binary"
    ).load(folder)
    prefix = len(folder.rstrip("/")) + 1
    plain = F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:(?://[^/]*)?(?=/)", "")

    def merge(batch: DataFrame, _: int) -> None:
        named = batch.filter(F.lower("path").rlike(r"\.(md|markdown|txt|html?|pdf)$")).select(F.substring(plain, F.lit(prefix + 1), F.length(plain)).alias("source"), "content")
        rows = cut_lineage(loaders.finish(named.mapInArrow(loaders._decoded, "source string, kind string, page_title string, text string, error string")))
        for bad in rows.filter(F.col("error").isNotNull()).select("source", "error").toLocalIterator():
            log.warning("%s could not be read: %s", bad["source"], bad["error"])
        docs = rows.filter(F.col("error").isNull() & (F.trim(F.regexp_replace("text", r"\s", "")) != "")).select("source", "title", "text")
        if not docs.isEmpty():
            engine.ingest(docs, origin=folder.rstrip("/"), **options)

    writer = files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
