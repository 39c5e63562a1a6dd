"""Missing or wrong language labels: Bayesian evidence fusion per sentence, document and segment.

The posterior of a sentence's language is the product of

* a text likelihood: scripts (fixed), words and, for words not met in training, their trigrams; the
  rarer a word was in training, the less it may say, and names, versions and paths say nothing;
* the language that the markup declares where the sentence stands, if it does (``lang`` of HTML, babel
  and ``\\selectlanguage`` of LaTeX);
* a host prior, from the labels of the host's documents, smoothed by those of its address suffix, and
  these by those of the whole table. Grouped aggregates over all rows compute it.

The word model is fitted here, on a bounded sample of labelled rows: at most ``per_label`` rows of each
language named (``PER_LABEL`` = 200), chosen by a hash of doc_id. Wrong labels among them are met by
re-estimating each sentence's language twice.

Running text only: headings, lists, tables, code and formulas don't count; in a text without markup a
short line of its own without a final mark counts as heading. Sentences follow ``sentences.segment``.

Edge cases: null and blank texts, and texts without running text, have no segments; a null or unknown
label names no language; a null origin is a host of its own; repeated rows are judged a row each; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.markup import host_of, outside_code, parse_blocks
from lodestone.llm.sentences import segment
from lodestone.session import cut_lineage, spread

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl", "ru", "zh", "ja", "ar", "hi")
PER_LABEL = 200
#: Hosts whose priors (some 150 bytes each) are broadcast; with more, texts are joined by host, and AQE splits hot ones.
BROADCAST_HOSTS = 100_000
_N = len(LANGUAGES)
_AT = {x: k for k, x in enumerate(LANGUAGES)}

# Codes and English names of the languages.
CODES = {
    "en": "eng english", "de": "deu ger german", "fr": "fra fre french", "es": "spa spanish", "pt": "por portuguese", "nl": "nld dut dutch",
    "ru": "rus russian", "zh": "zho chi chinese cmn", "ja": "jpn japanese", "ar": "ara arabic", "hi": "hin hindi",
}
# Frequent function words and the words questions open with, a weak start for languages without labelled rows.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as be at by this have from or had not but what all were when we there can an your which their if will each about how then them these so some would other into has who which where why",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man wer was welche wann wo warum",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux d'un cette d'une ont ses mais comme on tout nous sa fait été aussi leur bien peut ces y deux si puis quel quelle quand où pourquoi comment",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo quién cuál cuándo dónde cómo",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem qual quando onde porquê",
    "nl": "de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog wie welke wanneer waar waarom",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой ты год для от же так вы все или если при",
    "ar": "في من على إلى أن هذا التي هذه عن لا ما كان مع أو قد بعد كل ذلك بين منذ إذا لم",
    "hi": "के में है की से को का और पर यह नहीं एक हैं ने भी कि तो हर यदि तक लिए",
    "zh": "的 是 不 了 在 有 和 这 为 把 会 个",
    "ja": "の に は を た が で て と し れ す る",
}

_TOKENS = re.compile(r"[぀-ヿ㐀-鿿]|[ऀ-ॿ]+|[a-zß-öø-ÿāăąćčďđēęěğīłńňőœřśşšţťūůűźżž]+|[Ѐ-ӿ]+|[؀-ۿ]+|[^\W\d_]+?(?=[\W\d_]|$)")
_MARKED_TOKENS = re.compile("\\0|" + _TOKENS.pattern)
# names, versions and paths say nothing about the language they stand in
_NAMES = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z0-9]++(?:[._/:@\\]++[A-Za-z0-9]++)+|[A-Za-z]*+[0-9][A-Za-z0-9]*+)")
_HTML_LANG = re.compile(r"<(?:html|body)\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", re.I)
_BABEL = re.compile(r"\\usepackage\s*\[([^\]]*)\]\s*\{babel\}")
_SELECT = re.compile(r"\\selectlanguage\s*\{([a-zA-Z]+)\}")
_DECLARES = re.compile(r"\blang\s*=|\{babel\}|\\selectlanguage")
#: Characters that stand for a declaration in the text while it is parsed, one per language.
_SWITCH = 0xF8C0
# Names of languages that babel knows beside the English ones.
BABEL = {
    "ngerman": "de", "germanb": "de", "austrian": "de", "naustrian": "de", "nswissgerman": "de", "francais": "fr", "frenchb": "fr", "acadian": "fr", "canadien": "fr",
    "portuges": "pt", "brazil": "pt", "brazilian": "pt", "british": "en", "american": "en", "usenglish": "en", "ukenglish": "en", "canadian": "en", "australian": "en",
}


def label_language(col: str = "lang") -> Column:
    """Two-letter code of the language a label names, or null."""
    head = F.lower(F.regexp_extract(F.trim(F.coalesce(F.col(col), F.lit(""))), r"^([A-Za-z]+)", 1))
    pairs = [x for code, names in CODES.items() for name in (code, *names.split()) for x in (F.lit(name), F.lit(code))]
    return F.try_element_at(F.create_map(*pairs), head)


_NAME_TO_CODE = {name: code for code, names in CODES.items() for name in (code, *names.split())}


def running_sentences(text: str | None) -> list[str]:
    """The sentences of the running text, in order."""
    return [s for s, _ in declared_sentences(text)]


def declared_sentences(text: str | None) -> list[tuple[str, int]]:
    """The sentences of the running text, and the language declared where each stands (-1: none)."""
    text, now = declarations(text) if text and _DECLARES.search(text) else (text, -1)
    out: list[tuple[str, int]] = []
    blocks = parse_blocks(text)
    marked = any(k == "heading" for k, _ in blocks)
    last = max((k for k, b in enumerate(blocks) if b[0] == "para" and not _is_switch(b[1])), default=-1)
    for k, (kind, content) in enumerate(blocks):
        if kind != "para":
            continue
        if _is_switch(content):
            now = ord(content) - _SWITCH
            continue
        spans = segment(content)
        if not marked and k != last and len(spans) == 1 and len(content) <= 60 and content[-1] not in ".!?。！？।؟…:;»”\")）":
            continue  # a heading of a text without markup: what follows is its text
        out += [(content[s:e], now) for s, e in spans]
    return out


def _is_switch(content: str) -> bool:
    return len(content) == 1 and _SWITCH <= ord(content) < _SWITCH + _N


def _code_of(name: str) -> int:
    name = name.strip().lower()
    return _AT.get(BABEL.get(name) or _NAME_TO_CODE.get(name, ""), -1)


def declarations(text: str) -> tuple[str, int]:
    """The text with marks where a LaTeX command switches the language, and the language that the whole
    declares at first: ``lang`` of a page's html or body tag, or the last option of babel. Comments,
    scripts and code declare nothing; the whole text is looked at."""
    bare = outside_code(text)
    first = -1
    if m := _HTML_LANG.search(bare):
        first = _code_of(m[1])
    elif m := _BABEL.search(bare):
        known = [k for k in map(_code_of, m[1].split(",")) if k >= 0]
        first = known[-1] if known else -1
    if _SELECT.search(bare):
        text = re.sub(f"[{chr(_SWITCH)}-{chr(_SWITCH + _N - 1)}]", " ", text)
        text = _SELECT.sub(lambda m: f"\n\n{chr(_SWITCH + k)}\n\n" if (k := _code_of(m[1])) >= 0 else "\n\n", text)
    return text, first


def _script_scores(w: str) -> np.ndarray | None:
    """Log-likelihood of a word's script, for scripts that tell."""
    c = w[0]
    v = np.full(_N, -6.0)
    if "Ѐ" <= c <= "ӿ":
        v[_AT["ru"]] = 0
    elif "؀" <= c <= "ۿ":
        v[_AT["ar"]] = 0
    elif "ऀ" <= c <= "ॿ":
        v[_AT["hi"]] = 0
    elif "぀" <= c <= "ヿ":
        v[_AT["ja"]] = 0
        v[_AT["zh"]] = -5
    elif "㐀" <= c <= "鿿":
        v[_AT["zh"]] = -0.1
        v[_AT["ja"]] = -0.9
    else:
        return None
    return v


def tokens(sentence: str) -> list[str]:
    return _TOKENS.findall(_NAMES.sub(" ", sentence).lower())


class Model:
    """Log-likelihood of words by language, relative to the best language, cut at FLOOR."""

    FLOOR = -5.0

    def __init__(self, words: dict[str, int], counts: np.ndarray, trigrams: dict[str, int], tri: np.ndarray):
        self.words, self.counts, self.trigrams, self.tri = words, counts, trigrams, tri
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.empty((1024, _N), np.float32)
        self.known = 0

    def vector(self, w: str) -> np.ndarray:
        total = self.counts.sum(0) + 200.0
        script = _script_scores(w)
        if script is not None:
            lexical = 0.0
            at = self.words.get(w)
            if at is not None:
                lexical = np.log((self.counts[at] + 0.05) / total)
                lexical = 0.5 * np.maximum(lexical - lexical.max(), self.FLOOR)
            v = script + lexical
        else:
            padded = f"<{w}>"
            ids = [self.trigrams[g] for g in (padded[i : i + 3] for i in range(len(padded) - 2)) if g in self.trigrams]
            back = np.zeros(_N)
            if ids:
                back = self.tri[ids].mean(0)
                back = back - back.max()
            at = self.words.get(w)
            n = self.counts[at] if at is not None else 0.0
            v = np.log((n + 0.3 * np.exp(back)) / total)
            v[6:] -= 2.0  # Latin letters in the languages of other scripts
            # the less often a word was met, the less it may say
            floor = max(self.FLOOR, -1.2 - 1.2 * np.log1p(self.counts[at].sum() if at is not None else 0.0))
            return np.maximum(v - v.max(), floor).astype(np.float32)
        return np.maximum(v - v.max(), self.FLOOR - 2.0).astype(np.float32)

    def scores(self, sentences: list[str]) -> np.ndarray:
        """One row of log-likelihoods for each sentence."""
        if not sentences:
            return np.zeros((0, _N))
        if len(self.index) > 500_000:
            self.reset()
        # all sentences in one pass, parted by a mark that comes out as a token
        text = "\0".join(x.replace("\0", " ") for x in sentences)
        words = _MARKED_TOKENS.findall(_NAMES.sub(" ", text).lower())
        index = self.index
        for w in set(words):
            if w not in index and w != "\0":
                if self.known == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                self.rows[self.known] = self.vector(w)
                index[w] = self.known
                self.known += 1
        at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
        marks = np.flatnonzero(at < 0)
        counts = np.diff(np.r_[-1, marks, len(at)]) - 1
        at = at[at >= 0]
        out = np.zeros((len(sentences), _N))
        has = counts > 0
        if len(at):
            starts = (np.cumsum(counts) - counts)[has]
            out[has] = np.add.reduceat(self.rows[at], starts, axis=0)
        return out


def fit(sample: list[tuple[str, str | None]]) -> Model:
    """From (text, label) rows; labels may be wrong or missing for some."""
    sents: list[list[str]] = []
    label: list[int] = []
    for text, lang in sample:
        for s in running_sentences(text):
            sents.append(tokens(s))
            label.append(_AT.get(lang, -1))
    words: dict[str, int] = {}
    for lang in LANGUAGES:
        for w in FUNCTION_WORDS[lang].split():
            words.setdefault(w, len(words))
    for t in sents:
        for w in t:
            words.setdefault(w, len(words))
    seed = np.zeros((len(words), _N))
    for lang in LANGUAGES:
        for w in FUNCTION_WORDS[lang].split():
            seed[words[w], _AT[lang]] += 2.0
    flat = np.array([words[w] for t in sents for w in t], np.int64)
    sizes = np.array([len(t) for t in sents], np.int64)
    owner = np.repeat(np.arange(len(sents)), sizes)
    script = np.zeros((len(words), _N))
    for w, k in words.items():
        v = _script_scores(w)
        if v is not None:
            script[k] = v
        else:
            script[k, 6:] = -2.0
    names = np.array(label)
    post = np.full((len(sents), _N), 1.0 / _N)
    prior = np.zeros((len(sents), _N))
    if len(sents):
        post[names >= 0] = 0.4 / _N
        post[np.flatnonzero(names >= 0), names[names >= 0]] += 0.6
        prior[np.flatnonzero(names >= 0), names[names >= 0]] = 1.0
    counts = seed
    for step in range(4):
        counts = seed.copy()
        if len(flat):
            # the script decides first: what is written in Cyrillic teaches Russian only
            weight = post[owner]
            np.add.at(counts, flat, weight)
        ll = np.log((counts + 0.05) / (counts.sum(0) + 200.0))
        ll = np.maximum(ll - ll.max(1, keepdims=True), Model.FLOOR) + script
        score = prior.copy()
        if len(flat):
            np.add.at(score, owner, ll[flat])
        score -= score.max(1, keepdims=True) if len(sents) else 0
        post = np.exp(score)
        post /= post.sum(1, keepdims=True) if len(sents) else 1
    trigrams: dict[str, int] = {}
    rows: list[np.ndarray] = []
    for w, k in words.items():
        if _script_scores(w) is None:
            padded = f"<{w}>"
            for i in range(len(padded) - 2):
                g = trigrams.setdefault(padded[i : i + 3], len(trigrams))
                if g == len(rows):
                    rows.append(np.zeros(_N))
                rows[g] += np.sqrt(counts[k])
    tri = np.array(rows) if rows else np.zeros((1, _N))
    tri = np.log((tri + 0.1) / (tri.sum(0) + 0.1 * len(tri)))
    return Model(words, counts, trigrams, tri)


def sample_rows(docs: DataFrame, per_label: int = PER_LABEL) -> list[tuple[str, str | None]]:
    """At most ``per_label`` rows of each label, by a hash of doc_id; ids first, then their texts."""
    narrow = docs.select("doc_id", label_language().alias("label")).filter(F.col("label").isNotNull())
    w = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = narrow.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_label).select("doc_id", "label").distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull())
    return [(r["text"], r["label"]) for r in rows.dropDuplicates(["doc_id"]).collect()]


def host_priors(docs: DataFrame, strength: float = 20.0) -> DataFrame:
    """``host, prior ARRAY<DOUBLE>``: log prior of each language for every host, smoothed by suffix and table.

    A host none of whose rows has a label takes the prior of its suffix, and a suffix without labels that
    of the table."""
    per = docs.select(host_of().alias("host"), label_language().alias("label")).groupBy("host", "label").agg(F.count("*").alias("n"))
    per = per.withColumn("suffix", F.regexp_extract("host", r"([^./]+)$", 1))
    counts = per.groupBy("suffix", "host").agg(*[F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).cast("double").alias(x) for x in LANGUAGES])
    total = lambda prefix="": sum((F.col(prefix + x) for x in LANGUAGES), F.lit(0.0))
    by_suffix = counts.groupBy("suffix").agg(*[F.sum(x).alias("s_" + x) for x in LANGUAGES])
    table = counts.agg(*[F.sum(x).alias("t_" + x) for x in LANGUAGES])
    joined = counts.join(by_suffix, "suffix").crossJoin(F.broadcast(table))  # one row
    out = []
    for x in LANGUAGES:
        top = (F.col("t_" + x) + 1.0) / (total("t_") + float(_N))
        mid = (F.col("s_" + x) + strength * top) / (total("s_") + strength)
        out.append(F.log((F.col(x) + strength * mid) / (total() + strength)))
    return joined.select("host", F.array(*out).alias("prior"))


SEGMENTS = "doc_id bigint, label string, seg int, lang string, confidence double, first int, n int, total int"


def judge_batch(model: Model, texts: list[str | None], priors: np.ndarray, prior_weight: float = 0.5) -> tuple[np.ndarray, ...]:
    """Segments of all texts as arrays: number of the text, language, confidence, first sentence, sentences, and
    all sentences of the text. ``priors`` has a row of log priors for each text, zeros where there is none."""
    sentences: list[str] = []
    declared: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        found = declared_sentences(t)
        sentences += [s for s, _ in found]
        declared += [d for _, d in found]
        sizes[k] = len(found)
    if not sentences:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    score = model.scores(sentences)
    named = np.array(declared, np.int64)
    at = np.flatnonzero(named >= 0)
    score[at, named[at]] += 2.0
    owner = np.repeat(np.arange(len(texts)), sizes)
    score += (prior_weight * np.maximum(priors - priors.max(1, keepdims=True), -6.0))[owner]
    p = np.exp(score - score.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    sure = p[np.arange(len(p)), best]
    for k in np.flatnonzero(sure < 0.8).tolist():  # doubtful sentences follow their neighbours
        near = [best[j] for j in (k - 1, k + 1) if 0 <= j < len(p) and owner[j] == owner[k] and sure[j] >= 0.8 and p[k, best[j]] > 0.02]
        if near:
            best[k] = max(near, key=lambda x: p[k, x])
            sure[k] = p[k, best[k]]
    cut = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])])
    n = np.diff(np.r_[cut, len(best)])
    doc = owner[cut]
    return doc, best[cut], np.add.reduceat(sure, cut) / n, cut - (np.cumsum(sizes) - sizes)[doc], n, sizes[doc]


def judge(model: Model, texts: list[str], priors: list[list[float] | None]) -> list[list[tuple[int, float, int, int, int]]]:
    """For each text its segments: (language, confidence, first sentence, sentences, all sentences)."""
    out: list[list[tuple[int, float, int, int, int]]] = [[] for _ in texts]
    rows = judge_batch(model, texts, np.array([p or [0.0] * _N for p in priors]))
    for doc, *segment_ in zip(*(c.tolist() for c in rows)):
        out[doc].append(tuple(segment_))
    return out


def prior_rows(col: pa.Array) -> np.ndarray:
    """A list column of log priors as rows; zeros for null."""
    out = np.zeros((len(col), _N))
    known = np.flatnonzero(np.asarray(col.is_valid()))
    if len(known):
        out[known] = np.asarray(col.take(pa.array(known)).flatten()).reshape(-1, _N)
    return out


def language_segments(docs: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """``doc_id, label, seg, lang, confidence, first, n, total``: the stretches of each document in one
    language; ``first`` and ``n`` count sentences, ``total`` all those of the document. ``label`` is the
    language that the document's label names."""
    spark = docs.sparkSession
    model = fit(sample_rows(docs, per_label))
    sent = spark.sparkContext.broadcast((model.words, model.counts, model.trigrams, model.tri))
    priors = cut_lineage(host_priors(docs))
    side = F.broadcast(priors) if priors.count() <= BROADCAST_HOSTS else priors
    rows = spread(docs.select("doc_id", label_language().alias("label"), "text", host_of().alias("host")).filter(F.col("text").isNotNull()))
    rows = rows.join(side, "host", "left").select("doc_id", "label", "text", "prior")
    models: dict[int, Model] = {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        m = models.get(0) or models.setdefault(0, Model(*sent.value))
        names = pa.array(LANGUAGES)
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                doc, lang, conf, first, n, total = judge_batch(m, part[2].to_pylist(), prior_rows(part[3]))
                take = pa.array(doc)
                seg = np.arange(len(doc)) - np.searchsorted(doc, doc)
                columns = [part[0].take(take), part[1].take(take), pa.array(seg, pa.int32()), names.take(pa.array(lang)), pa.array(conf, pa.float64()), *(pa.array(c, pa.int32()) for c in (first, n, total))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "seg", "lang", "confidence", "first", "n", "total"])

    return rows.mapInArrow(run, SEGMENTS)


def document_languages(segments: DataFrame) -> DataFrame:
    """``doc_id, lang, confidence, share``: the language of most sentences of each document."""
    per = segments.groupBy("doc_id", "lang").agg(F.sum("n").alias("n"), (F.sum(F.col("confidence") * F.col("n")) / F.sum("n")).alias("confidence"), F.max("total").alias("total"))
    top = per.groupBy("doc_id").agg(F.max(F.struct("n", "confidence", "lang", "total")).alias("t"))
    return top.select("doc_id", F.col("t.lang").alias("lang"), F.col("t.confidence").alias("confidence"), (F.col("t.n") / F.col("t.total")).alias("share"))


def wrong_labels(segments: DataFrame, in_a_row: int = 3) -> DataFrame:
    """``doc_id, lang``: languages that the label doesn't name, of all sentences or of enough in a row."""
    unnamed = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return segments.filter(unnamed & ((F.col("n") >= in_a_row) | (F.col("n") == F.col("total")))).select("doc_id", "lang").distinct()
