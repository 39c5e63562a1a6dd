"""Sentence boundaries across languages and scripts, by semi-Markov dynamic programming.

Every mark that could end a sentence is a candidate, with a score that says how likely it does; a score
far below zero makes an end dear, but only the division as a whole decides. The best division of a paragraph is the one
whose *spans* score highest in sum; a span is scored as a whole by its length, its opening word, its
closing mark and word, and by whether quotations and brackets are balanced inside it, so that a mark
within a quotation counts only if the sentence does not go on after it.

Rules that hold everywhere: a blank line always ends a sentence, a single line break never does;
offsets count code points, ends are exclusive, outer white space is left out and closing quotes and
brackets are kept. Null, empty and blank texts have no sentences; a text without any mark is one
sentence; long texts are handled whole. Repeated rows of an id give their spans once; columns other
than those named are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import spread

# Abbreviations by what may follow them.
# A title or a word that always goes on.
TITLES = frozenset(
    "dr prof mr mrs ms st sr sra srta dra m mme mlle me hr fr herr frau ing dipl dhr mevr mw drs ir rev gen col capt lt sgt г-н г-жа проф им ул тел"
    .split()
)
# Before a number, or before a word that goes on.
BEFORE_NUMBER = frozenset(
    "no nr nº nro núm num fig figs abb sec sect ch chap kap art par para p pp pág págs pag blz bl s seite tab tabl cf vgl vol bd ed eq gl ex ver vers app approx ca circa ungefähr env aprox afb hfst рис табл стр гл п пп см ст ч"
    .split()
)
# In the midst of a sentence, as a rule.
INNER = frozenset(
    "e.g i.e z.b u.a d.h o.ä s.o s.u z.t v.a i.d.r m.e o.a d.w.z m.b.t t.o.v bijv resp bzw ggf evtl usf usw etc vs viz incl inkl inc excl exkl p.ej p.ex por.ej aprox approx max min mind temp dept est напр т.е т.к т.д т.п т.н др пр и.о тыс млн млрд руб коп cca ca sog zzgl abzgl gem bzgl z B u d h o v t c.à.d c.-à-d p.e bv enz etc ej ex"
    .lower()
    .split()
)
# Often the last word of a sentence as well: what follows decides.
EITHER = frozenset("a.m p.m etc usw usf enz u.s e.u u.k u.n uu.s ee.uu a.c d.c г гг в вв т.д т.п др пр co inc ltd corp jr h uhr min max std sek st".split())
MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember jänner jan feb mär apr jun jul aug sep okt nov dez jahrhundert jh quartal".split()
)
# Names a sentence may open with although they are not capitalised.
LOWER_OPENERS = frozenset("npm pip git curl iphone ipad ios macos ebay iptables systemd kubectl postgres".split())
# Words a sentence often opens with; they tell a lost blank from a dotted name.
OPENERS = frozenset(
    """a an the this that these those it its he she they we you i if when while since after before because although most many some each every all use open call set ask keep see
    what why how where who which there here then never always only look without with within in on at for from by to no yes as so but and or
    der die das den dem ein eine einen man ab am im in wenn sobald bis nach vor während niemals nie warum wie was wer außerdem jede jeder jedes alle viele siehe das manche
    le la les un une des ce cette ces il elle on nous vous si quand pourquoi comment depuis voir ne jamais chaque après avant pendant ensuite en dans pour avec sans m
    el los las una unos unas este esta estos muchos nunca desde cada véase si cuando para con sin después antes
    o os as um uma se quando porque desde muitas nunca cada depois antes para com sem veja
    de het een als nooit elke vanaf sinds zie waarom wat wie hoe daarna veel u men""".split()
)
NEVER_BEFORE = frozenset("call calls via invoke method function class".split())

_PARA = re.compile(r"\n[^\S\n]*(?:\n\s*)+")
_CAND = re.compile(r"[.!?…。！？．｡।॥؟۔]+")
_CLOSE = "\"'”’»«“›‹」』)）]】》〉}"
_OPEN_TO = {"„": "“”\"", "“": "”", "«": "»", "»": "«", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "‹": "›", "《": "》"}
_CLOSED_BY = {c: "".join(o for o in _OPEN_TO if c in _OPEN_TO[o]) for c in "".join(_OPEN_TO.values())}
_MARKS = re.compile("[\"„“”«»「」『』()（）\\[\\]【】‹›《》]")
_WORD_BEFORE = re.compile(r"[^\W_][\w.\-’']*$")
_WIDE_END = frozenset("。！？．｡")
_STRONG = frozenset("!?。！？।॥؟۔｡")
_NEXT_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def _caseless(c: str) -> bool:
    return c.isalpha() and not c.isupper() and not c.islower()


def _quotes(text: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Pairs of quotes and brackets: ``partner`` as {open: close} sorted lists of (open, close, depth)."""
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int, int]] = []
    loose: list[int] = []
    waiting = dict.fromkeys(_OPEN_TO, 0)  # how many marks of each kind are open
    for m in _MARKS.finditer(text, a, b):
        c, i = m[0], m.start()
        if c == '"':
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in '"„'), -1)
            if at >= 0:
                pairs.append((stack[at][1], i, at))
                loose += [x[1] for x in stack[at + 1 :]]
                for o, _ in stack[at:]:
                    if o in waiting:
                        waiting[o] -= 1
                del stack[at:]
            else:
                stack.append((c, i))
            continue
        if any(waiting[o] for o in _CLOSED_BY.get(c, "")):
            k = len(stack) - 1
            while c not in _OPEN_TO.get(stack[k][0], ""):
                k -= 1
            pairs.append((stack[k][1], i, k))
            loose += [x[1] for x in stack[k + 1 :]]
            for o, _ in stack[k:]:
                if o in waiting:
                    waiting[o] -= 1
            del stack[k:]
        else:
            if c in _OPEN_TO:
                stack.append((c, i))
                waiting[c] += 1
            else:
                loose.append(i)
    loose += [x[1] for x in stack]
    return loose, pairs


#: Scores of a mark that stands inside a name or a number, of a full stop between a word and a capital, and of
#: a mark that leaves no doubt.
INSIDE, PLAIN, CLEAR = -9.0, 2.5, 3.0
_LISTED = TITLES | BEFORE_NUMBER | INNER | EITHER


def _closing(text: str, a: int, i: int, e: int, end: int, mark: str, quoted: bool) -> float:
    """Score of a sentence end at ``e``, the end of mark and closers."""
    n = len(text) if end > len(text) else end
    nxt = text[e] if e < n else ""
    strong = mark[-1] in _STRONG
    if not nxt:
        return CLEAR
    space = nxt.isspace()
    j = e
    while j < n and text[j].isspace():
        j += 1
    first = text[j] if j < n else ""
    if not first:
        return CLEAR
    k = j
    while k < n and text[k] in "\"'“„«»‘¿¡([「『（":  # what opens before the first word
        k += 1
    head = text[k] if k < n else ""
    word = ""
    if head.isalpha():
        m = _NEXT_WORD.match(text, k, n)
        word = m[0] if m else head
    lower = head.islower() and word.lower() not in LOWER_OPENERS
    opens = first in "¿¡“„«「『（([\"" or k > j
    if strong:
        if mark[-1] in _WIDE_END:
            return CLEAR if not quoted else 0.5
        if lower:
            if first == "(" or first == "[":
                return -1.0
            return -4.0 if (quoted or not space or head.islower()) else 0.5
        if not space and (head.isdigit() or (not quoted and text[e] in "=&/#.,;:")):
            return -6.0
        if not head.isalpha() and not head.isdigit() and not opens and first in ",;:-–—/":
            return -5.0
        return CLEAR
    # full stops and ellipses
    if first in ",;:–—-/)]" and not (first == "-" and space):
        return -6.0
    left = text[max(a, i - 24, text.rfind(" ", a, i) + 1) : i]
    if not left.isalnum():
        m = _WORD_BEFORE.search(left)
        left = m[0] if m else ""
    if len(mark) > 1 or mark == "…":
        if lower:
            return -5.0
        return 0.8
    if "’" in left or "'" in left:
        left = left.replace("’", "'").rsplit("'", 1)[-1] or left
    if "." in left:  # a blank was lost before the word
        head_, _, last = left.rpartition(".")
        if last[:1].isupper() and last[1:].islower() and head_[-2:].islower() and len(head_.rpartition(".")[2]) > 1:
            left = last
    low = left.lower().strip("’'-")
    if not space and not quoted:
        # a lost blank, or a dot inside a name
        if head.isdigit() or head == "_" or not (head.isalpha() or opens):
            return INSIDE
        if _caseless(head):
            return 2.0 if low else INSIDE
        if opens and not head.isupper():
            return INSIDE if first in "([" else 0.5
        if lower:
            return INSIDE
        if head.islower():  # a lower-case name that opens sentences
            after = text[k + len(word)] if k + len(word) < n else ""
            return 1.5 if after == " " else INSIDE
        after = text[k + len(word)] if k + len(word) < n else ""
        if after and not (after.isspace() or after in ",'’.-"):
            return INSIDE
        if len(word) > 1 and not word[1:].islower() and word.isupper():
            return INSIDE
        if "." in left and low not in EITHER and not left.replace(".", "").isdigit() and left.split(".")[-1] != left.split(".")[-1].lower():
            return INSIDE
        if low in TITLES or low in BEFORE_NUMBER or (low in INNER and low not in EITHER):
            return -4.0
        if left[:1].isupper() and not left.isupper() and not left[-1:].isdigit():
            if word.lower() not in OPENERS:
                return INSIDE
            before = _WORD_BEFORE.search(text, max(a, i - len(left) - 24), max(a, i - len(left) - 1))
            if before and before[0].lower().rpartition(".")[2] in NEVER_BEFORE:
                return INSIDE
            return 1.2
        if len(low) == 1 and low.isalpha() and low not in EITHER:
            return INSIDE
        return 1.5 if word.lower() in OPENERS or len(low) > 1 else -1.0
    if not left:
        return 1.5 if not lower else -2.0
    if quoted:
        return -3.0 if lower else 1.0
    if low in EITHER or (low in ("s", "u") and text[max(a, i - 3) : i].lower() in ("u.s", "e.u")):
        if lower or head.isdigit():
            return -5.0
        if low in ("u.s", "e.u", "u.k", "u.n"):
            return 0.3 if word.lower() in OPENERS else -1.5
        return 1.2
    if low in TITLES:
        return -6.0
    if low in BEFORE_NUMBER:
        if head.isdigit() or lower or first in "([":
            return -6.0
        return 0.6 if low in ("no", "art", "bl", "ex", "par", "para", "s", "ch", "п", "ч", "p") and not head.isdigit() and len(low) > 1 else -2.0
    if low in INNER:
        return -6.0 if (lower or head.isdigit()) else -1.0
    if len(low) == 1 and low.isalpha():
        if lower or head.isdigit():
            return -5.0
        if left.isupper():
            return -2.0  # an initial
        return 0.2
    if "." in low and all(len(x) <= 2 and x.isalpha() for x in low.split(".") if x):
        return -5.0 if lower or head.isdigit() else 0.5
    if lower:
        return -0.7 if head.isalpha() else 0.5
    if left.isdigit() and len(left) <= 2 and word.lower() in MONTHS:
        return -6.0
    return PLAIN


def segment(text: str | None, prune: bool = True) -> list[tuple[int, int]]:
    """Spans of the sentences of a text. ``prune`` leaves out spans that cannot be best; the result is the same."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    a, n = 0, len(text)
    while a < n:
        m = _PARA.search(text, a) if "\n" in text else None
        b, nxt = (m.start(), m.end()) if m else (n, n)
        _paragraph(text, a, b, out, prune)
        a = nxt
    return out


def _paragraph(text: str, a: int, b: int, out: list[tuple[int, int]], prune: bool = True) -> None:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if a >= b:
        return
    marks = [(m.start(), m.end()) for m in _CAND.finditer(text, a, b)]
    if not marks or (len(marks) == 1 and marks[0][1] == b):
        out.append((a, b))
        return
    loose, pairs = _quotes(text, a, b)
    closer_of = {c: o for o, c, _ in pairs}
    ends: list[int] = []
    scores: list[float] = []
    opened: list[int] = []  # where the outermost quotation or bracket that the mark closes with was opened, or -1
    for i, e in marks:
        c = text[i]
        if e == b:
            ends.append(e)
            scores.append(CLEAR)
            opened.append(-1)
            break
        d = text[e]
        if c == ".":
            if (d.islower() and e - i == 1 and _NEXT_WORD.match(text, e)[0] not in LOWER_OPENERS) or d.isdigit() or d == "_":
                continue
        if d.isspace() and e - i == 1 and c in ".!?" and e + 1 < b and text[e + 1].isupper():
            left = text[max(a, text.rfind(" ", a, i) + 1) : i] if c == "." else ""
            if c != "." or (len(left) > 1 and left.isalpha() and left.islower() and left not in _LISTED):
                ends.append(e)
                scores.append(PLAIN if c == "." else CLEAR)
                opened.append(-1)
                continue
        mark_end, o = e, -1
        while e < b:
            c = text[e]
            if c in _CLOSE and e in closer_of and closer_of[e] < i:
                o = closer_of[e]
                e += 1
            elif c.isspace() and e + 1 < b and e + 1 in closer_of and text[e + 1] in "»“”」\"" and closer_of[e + 1] < i and text[e + 1] != '"':
                o = closer_of[e + 1]  # French quotes stand off
                e += 2
            elif c in "’'" and e + 1 < b and not text[e + 1].isalpha():
                e += 1
            else:
                break
        s = CLEAR if o < 0 and text[mark_end - 1] in _WIDE_END else _closing(text, a, i, e, b, text[i:mark_end], o >= 0)
        if ends and ends[-1] == e:
            continue
        ends.append(e)
        scores.append(s)
        opened.append(o)
    if not ends or ends[-1] != b:
        ends.append(b)
        scores.append(0.0)
        opened.append(-1)
    k = len(ends)
    if k == 1:
        out.append((a, b))
        return
    starts = [a]
    for e in ends[:-1]:
        j = e
        while j < b and text[j].isspace():
            j += 1
        starts.append(j)
    # crossing[x]: how many pairs are open at boundary x
    cross = [0] * k
    if pairs:
        for o, c, _ in pairs:
            for x in range(k - 1):
                if o < ends[x] <= c:
                    cross[x] += 1
    base = [scores[j] - 6.0 * cross[j] for j in range(k)]
    if prune and (sure := _plain_division(text, starts, ends, base, opened)) is not None:
        out += sure
        return
    # best[j]: best score of a division that ends at candidate j
    best = [0.0] * k
    back = [0] * k
    peak = [0.0] * (k + 1)  # the best score of any division that ends before, the empty one (0) included
    for j in range(k):
        ej, oj = ends[j], opened[j]
        top, arg = -1e9, 0
        for i in range(j, -1, -1):
            st = starts[i]
            length = ej - st
            if prune and base[j] + peak[i] + 2.0 - (0.002 * (length - 500) if length > 500 else 0.0) < top - 1e-9:
                break  # no longer span can be better: peak falls with i, and length grows
            s = base[j] + (best[i - 1] if i else 0.0)
            if length < 12:
                s -= 1.2 if not _wide(text[st]) or length < 3 else 0.0
            elif length > 500:
                s -= 0.002 * (length - 500)
            if oj >= 0:
                if oj == st:
                    s += 2.0  # wholly quoted or bracketed
                elif j < k - 1:
                    s -= 1.0 if text[starts[j + 1]].isupper() else 3.0
            c = text[st]
            if c.islower():
                s -= 0.4
            if s > top:
                top, arg = s, i
        best[j], back[j] = top, arg
        peak[j + 1] = top if top > peak[j] else peak[j]
    spans, j = [], k - 1
    while j >= 0:
        i = back[j]
        spans.append((starts[i], ends[j]))
        j = i - 1
    for s, e in reversed(spans):
        if s < e:
            out.append((s, e))


def _plain_division(text: str, starts: list[int], ends: list[int], base: list[float], opened: list[int]) -> list[tuple[int, int]] | None:
    """The best division where it can be told at once: no span scores more than its end does, unless it is
    wholly quoted, so the division at all ends above zero is best if each of its spans scores just that.
    None: it may not be, and the programme has to run."""
    out = []
    i, last = 0, len(ends) - 1
    for j in range(last + 1):
        value = base[j]
        if (o := opened[j]) >= 0:
            at = bisect_left(starts, o)
            if at <= j and starts[at] == o:
                return None  # a span from there would be wholly quoted
            if j < last:
                value -= 1.0 if text[starts[j + 1]].isupper() else 3.0
        if value == 0.0 and j < last:
            return None
        if value > 0.0 or j == last:
            st, e = starts[i], ends[j]
            if not 12 <= e - st <= 500 or text[st].islower():
                return None
            out.append((st, e))
            i = j + 1
    return out


def _wide(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "가" <= c <= "힯" or "＀" <= c <= "￯"


# Spark ------------------------------------------------------------------------------------------
#: Lines that are no running text: tables, lists, code fences and formulas.
NOT_PROSE = r"(^|[\n\r])(\||- |```|~~~|\$\$)"


def _spans(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for b in batches:
        flat: list[int] = []
        offsets = [0]
        for text in b[1].to_pylist():
            for s, e in segment(text):
                flat.append(s)
                flat.append(e)
            offsets.append(len(flat))
        spans = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(flat, np.int32)))
        yield pa.RecordBatch.from_arrays([b[0], spans], ["id", "spans"])


def sentences(rows: DataFrame, prose_only: bool = True) -> DataFrame:
    """``id, start_pos, end_pos`` for each sentence of each text (columns ``id`` and ``text``).

    Repeated rows are met by aggregating the compact span lists by id, not the texts: one shuffle
    of about a tenth of the input, combined on the map side, so a hot id cannot fill a task.
    """
    rows = rows.select("id", "text").filter(F.col("text").isNotNull() & (F.col("text") != ""))
    if prose_only:
        rows = rows.filter(~F.col("text").rlike(NOT_PROSE))
    spans = spread(rows).mapInArrow(_spans, "id string, spans array<int>").distinct()
    n = F.size("spans")
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), lambda k: F.struct(F.get("spans", k * 2).alias("s"), F.get("spans", k * 2 + 1).alias("e"))
    )
    return spans.filter(n > 0).select("id", F.explode(pairs).alias("p")).select("id", F.col("p.s").alias("start_pos"), F.col("p.e").alias("end_pos"))
