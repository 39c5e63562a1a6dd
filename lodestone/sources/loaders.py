"""Folders, files and addresses to documents ``source, title, text``; what can't be read is told, not fatal."""

from __future__ import annotations

import io
import posixpath
from collections.abc import Iterable
from urllib.parse import unquote, urlparse
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone import __version__
from lodestone.functions import text as T
from lodestone.session import cut_lineage
from lodestone.sources.html import html_to_markdown

SUFFIXES = (".md", ".markdown", ".txt", ".html", ".htm", ".pdf")
MAX_BYTES = 20 * 1024 * 1024
TIMEOUT = 20.0


def kind_of(name: str, content_type: str = "") -> str:
    if content_type == "application/pdf":
        return "pdf"
    if content_type in ("text/html", "application/xhtml+xml"):
        return "html"
    suffix = posixpath.splitext(name)[1].lower()
    return "pdf" if suffix == ".pdf" else "html" if suffix in (".html", ".htm") else "markdown" if suffix in (".md", ".markdown") else "text"


def pdf_text(data: bytes) -> str:
    """Pages parted by blank lines; raises if there is no reader for PDF."""
    from pypdf import PdfReader  # optional

    pages = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(data)).pages]
    return "\n\n".join(p for p in pages if p)


def decode(data: bytes, kind: str) -> tuple[str, str]:
    """(title of the page or "", text); plain text is not yet given headings."""
    if kind == "pdf":
        return "", pdf_text(data)
    body = data.decode("utf-8", errors="replace")
    return html_to_markdown(body) if kind == "html" else ("", body)


def _decoded(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], []]
        for source, data in zip(b[0].to_pylist(), b[1].to_pylist()):
            kind = kind_of(source)
            try:
                title, text, error = *decode(data or b"", kind), None
            except ImportError:
                title, text, error = "", "", "no reader for PDF is installed"
            except Exception as e:  # one broken file must not end the job
                title, text, error = "", "", f"{type(e).__name__}: {e}"
            for c, v in zip(out, (kind, title, text, error)):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b[0], *(pa.array(c, pa.string()) for c in out)], ["source", "kind", "page_title", "text", "error"])


def finish(rows: DataFrame) -> DataFrame:
    """Headings for plain text, and the title: the page's, else the first ``# `` line, else the file's stem."""
    stem = F.regexp_extract(F.regexp_replace(F.col("source"), r"[?#].*$", ""), r"([^/]*?)(?:\.[^./]*)?/?$", 1)
    rows = rows.withColumn("text", F.when(F.col("kind") == "text", T.heading_promotion("text")).otherwise(F.col("text")))
    own = F.when(F.col("page_title") != "", F.col("page_title"))
    return rows.select("source", F.coalesce(own, T.markdown_title("text", F.when(stem != "", stem).otherwise(F.col("source")))).alias("title"), "text", "error")


def read_files(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of a file or of all supported files under a folder, by relative path.

    A missing path raises; unreadable files are in ``errors`` (source, error); blank documents drop out.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        raise FileNotFoundError(target)
    status = fs.getFileStatus(path)
    full = status.getPath()
    base = full.toString() if status.isDirectory() else full.getParent().toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(target)
    if status.isDirectory():
        files = files.filter(F.lower("path").rlike(r"\.(md|markdown|txt|html?|pdf)$"))
    prefix = len(urlparse(base).path.rstrip("/")) + 1
    plain = F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:(?://[^/]*)?(?=/)", "")
    named = files.select(F.substring(plain, F.lit(prefix + 1), F.length(plain)).alias("source"), "content")
    named = named.withColumn("source", F.try_url_decode(F.replace("source", F.lit("+"), F.lit("%2B"))))
    rows = finish(named.mapInArrow(_decoded, "source string, kind string, page_title string, text string, error string"))
    docs = rows.filter(F.col("error").isNull() & (F.trim(F.regexp_replace("text", r"\s", "")) != "")).select("source", "title", "text")
    return docs, rows.filter(F.col("error").isNotNull()).select("source", "error")


def fetch(url: str, timeout: float = TIMEOUT, most: int = MAX_BYTES) -> tuple[str, str, str]:
    """(kind, page title, text) of an address; more than ``most`` bytes are refused."""
    with urlopen(Request(url, headers={"User-Agent": f"lodestone/{__version__}"}), timeout=timeout) as r:
        data, content_type = r.read(most + 1), r.headers.get_content_type()
    if len(data) > most:
        raise ValueError(f"{url} is larger than {most} bytes")
    kind = kind_of(unquote(urlparse(url).path), content_type)
    return kind, *decode(data, kind)


class UrlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", options.get("path", "")).split("\n") if u]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition):
        try:
            yield partition.value, *fetch(partition.value), None
        except Exception as e:  # one address that fails must not end the job
            yield partition.value, "text", "", "", f"{type(e).__name__}: {e}"


class UrlSource(DataSource):
    """``spark.read.format("lodestone_url").option("urls", "a\\nb")``: one partition per address."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_url"

    def schema(self) -> str:
        return "source string, kind string, page_title string, text string, error string"

    def reader(self, schema) -> UrlReader:
        return UrlReader(dict(self.options))


def read_urls(spark: SparkSession, urls: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of addresses, each fetched once; unlike files, blank ones stay."""
    spark.dataSource.register(UrlSource)
    rows = cut_lineage(finish(spark.read.format("lodestone_url").option("urls", "\n".join(urls)).load()))
    return rows.filter(F.col("error").isNull()).select("source", "title", "text"), rows.filter(F.col("error").isNotNull()).select("source", "error")


QUESTIONS = "question string, source string, contains string, history array<string>"
_TEXT, _LIST = r'^"', r'^\['


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions of a JSON file, checked: question, source and contains must be texts, and history,
    where there is one, a list of texts. The file is read as variants, so that types are seen as written."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    is_list = F.substring(F.to_json("v"), 1, 1) == "["
    if whole.filter(F.col("v").isNull() | ~F.coalesce(is_list, F.lit(False))).limit(1).count():
        raise ValueError("the file is no JSON list of questions")
    rows = cut_lineage(whole.select(F.explode(F.from_json(F.to_json("v"), "array<variant>")).alias("q")))
    field = lambda name: F.to_json(F.try_variant_get("q", f"$.{name}", "variant"))
    texts = [F.coalesce(field(n).rlike(_TEXT), F.lit(False)) for n in ("question", "source", "contains")]
    history = field("history")
    items = F.from_json(history, "array<variant>")
    listed = history.isNull() | (history == "null") | (history.rlike(_LIST) & F.coalesce(F.forall(items, lambda h: F.to_json(h).rlike(_TEXT)), F.lit(True)))
    good = texts[0] & texts[1] & texts[2] & F.coalesce(listed, F.lit(False))
    if rows.isEmpty():
        raise ValueError("no questions")
    if not rows.filter(~good).isEmpty():
        raise ValueError("a question lacks question, source or contains as a text, or its history isn't a list of texts")
    return rows.select(*[F.try_variant_get("q", f"$.{n}", t).alias(n) for n, t in (c.split() for c in QUESTIONS.split(", "))])


def documents(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    return read_urls(spark, [target]) if target.startswith(("http://", "https://")) else read_files(spark, target)
