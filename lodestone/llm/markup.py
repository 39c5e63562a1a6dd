"""Markup residue: HTML, Markdown, wiki text and LaTeX to clean, typed blocks.

``parse_blocks`` turns one text into blocks ``(element, content)`` in reading order, where element
is heading, item, code, formula, table or para. Code, comments, scripts and formulas are lifted out
first, in one left-to-right pass, so that what only looks like markup inside code is never parsed.

``clean_documents`` runs it over a table, after *site template removal*: container subtrees of
HTML pages are hashed, Spark counts on how many pages of a host each hash occurs, and subtrees that
recur on many pages of their host are deleted before the rest is read.

Edge cases: null or blank text gives no blocks; a text without markup gives paragraphs only;
unclosed tags end with their container, unclosed fences with the text; repeated rows give repeated
blocks (``p5_found`` is distinct); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage, spread

Block = tuple[str, str]

_LIFT = re.compile(
    r"""(?isx)
    (?=[<`~\\$])(?:
      <!--.*?(?:-->|\Z)
    | <(?P<drop>script|style|template|noscript|svg)\b[^>]*>.*?(?:</(?P=drop)\s*>|\Z)
    | <pre\b[^>]*>(?P<pre>.*?)(?:</pre\s*>|\Z)
    | <(?P<sh>syntaxhighlight|source)\b[^>/]*>(?P<shc>.*?)</(?P=sh)\s*>
    | <math\b[^>]*>(?P<math>.*?)</math\s*>
    | (?:(?<![^\n])|(?<=\n[ ])|(?<=\n[ ]{2})|(?<=\n[ ]{3}))(?P<fence>`{3,}|~{3,})[^\n`]*(?:\n|\Z)(?P<fc>.*?)(?:(?<=\n)[ ]{0,3}(?P=fence)[`~]*[ \t]*(?=\n|\Z)|\Z)
    | \\begin\{(?P<env>lstlisting|verbatim|minted|alltt)\*?\}(?P<opt>(?:[ \t]*\[[^\]\n]*\])?(?:\{[^}\n]*\})?)(?P<ec>.*?)(?:\\end\{(?P=env)\*?\}|\Z)
    | \\begin\{(?P<fenv>equation|align|gather|multline|displaymath|eqnarray|math)(?P<star>\*?)\}(?P<fenvc>.*?)\\end\{(?P=fenv)(?P=star)\}
    | \\\[(?P<disp>.+?)\\\]
    | \\\((?P<inl>.+?)\\\)
    | \$\$(?P<dd>.+?)\$\$
    | (?<![\\$\w])\$(?![\s\d$])(?P<single>[^$\n]*?[^\s$\\])\$(?![\w$])
    )"""
)
_LIFT_HINT = re.compile(r"<!--|```|~~~|\\[\[(b]|\$|<(?:pre|sc|st|te|no|sv|sy|so|ma)", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^>]*)>")
_ANY_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_MARK = re.compile(r"\x00(\d+)\x00")
_INLINE_MARK = re.compile(r"\x01(\d+)\x01")
_ANY_MARK = re.compile(r"([\x00\x01])(\d+)\1")
_IS_HTML = re.compile(r"(?i)<(?:!doctype|html|body)\b")
# code that is not lifted out: spans within a paragraph, code elements, \\verb, and indented lines after prose
_INLINE_CODE = re.compile(
    r"""(?isx)
      (?<!`)(?P<tick>`+)(?!`)(?:(?!\n[ \t]*\n).)+?(?<!`)(?P=tick)(?!`)
    | <(?P<el>code|tt|kbd|samp|nowiki|textarea)\b[^>]*>(?:(?!<(?P=el)\b).)*?</(?P=el)\s*>
    | \\(?:verb|lstinline)\*?(?P<bar>[^\w\s*{])[^\n]*?(?P=bar)
    | \\(?:texttt|lstinline)\{[^{}]*\}
    | (?<=\S)[ \t]*\n(?:[ \t]*\n)+(?:(?:[ ]{4}|[ ]{0,3}\t)[^\n]*(?:\n(?:[ \t]*\n)*|\Z))+
    """
)
_WIKI_HEAD = re.compile(r"(?m)^(={1,6})[ \t]*([^=\n](?:[^\n]*?[^=\n])?)[ \t]*\1[ \t]*$")
_MD_HEAD = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
# a line of # is a heading of Markdown where it stands alone, else an item of a numbered wiki list
_MD_HEADS = re.compile(r"(?:\A|(?<=\n\n)) {0,3}#{1,6}[ \t][^\n]*(?=\n[ \t]*(?:\n|\Z)|\Z)|(?<=\n)(?:=+|-{2,})[ \t]*(?=\n|\Z)")
_TEX_HEAD = re.compile(r"^[ \t]*\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?[ \t]*(?:\[[^\]]*\])?\{")
_TEX_HEADS = re.compile(r"(?m)^[ \t]*\\(?:(?:sub){0,2}section\b|documentclass)")
_SETEXT = re.compile(r"^ {0,3}(?:=+|-{2,})[ \t]*$")
_ITEM = re.compile(r"^[ \t]*(?:[-*+•]|\d{1,9}[.)])[ \t]+(.*)$")
_WIKI_ITEM = re.compile(r"^[*#]+[ \t]*(.*)$")
_NESTED = re.compile(r"\*{2,}[ \t]+\S")
_TEX_ITEM = re.compile(r"\\item\b[ \t]*(?:\[[^\]]*\])?[ \t]*")
_TEX_SKIP = re.compile(r"^[ \t]*\\(?:documentclass|usepackage|maketitle|label|begin|end|tableofcontents|newpage|noindent|centering|hline|author|date|caption)\b")
_TEX_TABLE = re.compile(r"^[ \t]*\\begin\{(tabular[x*]?|table|longtable|array)\*?\}")
_HTML_LINE = re.compile(r"^[ \t]*<(ul|ol|dl|table|h[1-6]|div|p|nav|footer|header|aside|section|article|blockquote|form|title|head|li)\b", re.I)
_BLOCK_START = re.compile(r"^(?:[ \t]*(?:[-*+•#|>=:;{$<\\\x00]|\d{1,9}[.)][ \t]))")

_CONTAINERS = frozenset("nav header footer aside section div ul ol table form".split())
_SKIP = frozenset("nav footer script style noscript template svg".split())
_BREAKS = frozenset(
    "p div section article main body html head header aside blockquote ul ol dl dd dt table tr td th figure figcaption form hr address details summary fieldset center".split()
)
_SPECIAL = re.compile(r"[\\*_`\[\]<>&'{}~$\x01]|\ufeff")
_CODE_SPAN = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)", re.S)
_ESC = re.compile(r"\\([!-/:-@\[-`{-~])")
_UNESC = re.compile("[\ue021-\ue07e]")
_REF = re.compile(r"(?is)<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>")
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_WIKI_FILE = re.compile(r"(?i)\[\[(?:file|image|category):[^\[\]]*\]\]")
_EXT_LINK = re.compile(r"\[(?:https?:)?//[^\s\]]+[ \t]+([^\]]*)\]")
_MD_LINK = re.compile(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\](?:\((?:[^()\s]|\([^()]*\))*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)|\[[^\]]*\])")
_AUTO_LINK = re.compile(r"<((?:https?|mailto):[^>\s]+)>")
_EMPH = [
    re.compile(r"\*\*\*(?=\S)(.+?)(?<=\S)\*\*\*", re.S),
    re.compile(r"\*\*(?=\S)(.+?)(?<=\S)\*\*", re.S),
    re.compile(r"(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)", re.S),
    re.compile(r"(?<![\w*])\*(?=[^\s*])([^*]+?)(?<=\S)\*(?![\w*])", re.S),
    re.compile(r"(?<![\w_])_(?=[^\s_])([^_]+?)(?<=\S)_(?![\w_])", re.S),
    re.compile(r"~~(?=\S)(.+?)(?<=\S)~~", re.S),
]
_TEX_HREF = re.compile(r"\\href\s*\{[^{}]*\}\s*\{((?:[^{}]|\{[^{}]*\})*)\}")
_TEX_DROP = re.compile(r"\\(?:label|ref|cite|footnote|index|pageref|vspace|hspace)\*?(?:\[[^\]]*\])?\{[^{}]*\}")
_TEX_ARG = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}")
_TEX_CMD = re.compile(r"\\(?:noindent|par|smallskip|medskip|bigskip|newline|linebreak|item|quad|qquad|ldots|dots)\b[ \t]*")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")


def squeeze(s: str) -> str:
    return " ".join(s.split())


def _balanced(s: str, at: int) -> tuple[str, int]:
    """Content of the brace group whose ``{`` stands just before ``at``, and where it ends."""
    depth, i, n = 1, at, len(s)
    while i < n:
        c = s[i]
        if c == "\\":
            i += 2
            continue
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return s[at:i], i + 1
        i += 1
    return s[at:], n


def clean_inline(s: str, kept: list[Block] | None = None, tex: bool = False) -> str:
    """Text without inner markup: links reduced to labels, escapes and entities decoded."""
    if not _SPECIAL.search(s):
        return squeeze(s)
    spans: list[str] = []
    if "`" in s and not tex:

        def keep(m: re.Match) -> str:
            spans.append(m[2])
            return f"\x02{len(spans) - 1}\x02"

        s = _CODE_SPAN.sub(keep, s)
    if "\\" in s:
        if tex:
            s = s.replace("\\\\", " ")
        s = _ESC.sub(lambda m: chr(0xE000 + ord(m[1])), s)
        if "\\" in s:
            s = _TEX_HREF.sub(r"\1", s)
            s = _TEX_DROP.sub("", s)
            for _ in range(3):
                if "{" not in s:
                    break
                s, n = _TEX_ARG.subn(r"\1", s)
                if not n:
                    break
            s = _TEX_CMD.sub(" ", s)
    if "<" in s:
        if "<ref" in s.lower():
            s = _REF.sub("", s)
        s = _AUTO_LINK.sub(r"\1", s)
        s = re.sub(r"(?i)<br\s*/?>", " ", s)
        s = _ANY_TAG.sub("", s)
    if "[" in s:
        if "[[" in s:
            s = _WIKI_LINK.sub(r"\1", _WIKI_FILE.sub("", s))
        s = _MD_LINK.sub(r"\1", s)
        s = _EXT_LINK.sub(r"\1", s)
    if "{{" in s:
        s = _TEMPLATE.sub("", s)
    if "''" in s:
        if tex:
            s = s.replace("``", '"').replace("''", '"')
        else:
            s = re.sub(r"'{2,5}", "", s)
    if "*" in s or "_" in s or "~~" in s:
        for p in _EMPH:
            s = p.sub(r"\1", s)
    if tex and "~" in s:
        s = s.replace("~", " ")
    if "&" in s:
        s = unescape(s)
    if spans:
        s = re.sub(r"\x02(\d+)\x02", lambda m: unescape(spans[int(m[1])]), s)
    if kept and "\x01" in s:
        s = _INLINE_MARK.sub(lambda m: kept[int(m[1])][1], s)
    s = _UNESC.sub(lambda m: chr(ord(m[0]) - 0xE000), s).replace("\ufeff", "")
    return squeeze(s)


class _Parser:
    __slots__ = ("out", "kept", "tex", "wiki", "drop")

    def __init__(self, drop: frozenset[int]):
        self.out: list[Block] = []
        self.kept: list[Block] = []
        self.tex = self.wiki = False
        self.drop = drop

    def _lift(self, m: re.Match) -> str:
        g = m.lastgroup
        d = m.groupdict()
        if d["pre"] is not None:
            body, kind = unescape(_ANY_TAG.sub("", d["pre"])), "code"
        elif d["shc"] is not None:
            body, kind = d["shc"], "code"
        elif d["fc"] is not None:
            body, kind = d["fc"], "code"
        elif d["ec"] is not None:
            body, kind = d["ec"], "code"
            if d["opt"] and d["env"].lower() == "verbatim":
                body = d["opt"] + body
        elif g is None or d["drop"] is not None:
            return " "
        else:
            body = d["math"] or d["fenvc"] or d["disp"] or d["inl"] or d["dd"] or d["single"] or ""
            kind = "formula"
            if "&" in body and ";" in body:
                body = unescape(body)
            body = re.sub(r"\\label\{[^}]*\}", "", body)
        body = squeeze(body)
        self.kept.append((kind, body))
        k = len(self.kept) - 1
        if d["inl"] is not None or d["single"] is not None:
            return f"\x01{k}\x01"
        return f"\n\x00{k}\x00\n"

    def lift(self, text: str) -> str:
        """The text with marks for code and formulas, which go to ``kept``, and without comments and scripts."""
        return _LIFT.sub(self._lift, text) if _LIFT_HINT.search(text) else text

    def emit(self, kind: str, raw: str) -> None:
        if "\x01" in raw:
            for m in _INLINE_MARK.finditer(raw):
                self.out.append(self.kept[int(m[1])])
            if not _INLINE_MARK.sub("", raw).strip():
                return
        c = clean_inline(raw, self.kept, self.tex)
        if c:
            self.out.append((kind, c))

    def marked(self, k: str) -> None:
        b = self.kept[int(k)]
        if b[1]:
            self.out.append(b)

    # HTML -------------------------------------------------------------------------------------
    def html(self, text: str, page: bool) -> None:
        ends = template_spans(text, self.drop, self.kept) if self.drop and page else {}
        pos, buf, kind, skip, skip_depth, bare = 0, [], "para", "", 0, page
        table = 0

        def flush(new: str) -> None:
            nonlocal kind
            if buf:
                s = "".join(buf)
                buf.clear()
                if not s.isspace():
                    if "\x00" in s:
                        at = 0
                        for m in _MARK.finditer(s):
                            if s[at : m.start()].strip():
                                self.emit(kind, s[at : m.start()])
                            self.marked(m[1])
                            at = m.end()
                        if s[at:].strip():
                            self.emit(kind, s[at:])
                    elif bare and kind == "para" and "\n" in s.strip():
                        self.lines(s)
                    else:
                        self.emit(kind, s)
            kind = new

        for m in _TAG.finditer(text):
            a = m.start()
            if a < pos:
                continue
            name = m[2].lower()
            if skip:
                if name == skip:
                    skip_depth += -1 if m[1] else 1
                    if not skip_depth:
                        skip = ""
                pos = m.end()
                continue
            if a > pos:
                buf.append(text[pos:a])
            pos = m.end()
            close = m[1] == "/"
            if ends and not close and a in ends:
                flush("para")
                pos = ends[a]
                continue
            if name in _SKIP:
                flush("para")
                if not close and not m[3].endswith("/"):
                    skip, skip_depth = name, 1
            elif name == "table":
                flush("table" if not close else "para")
                table = max(0, table + (-1 if close else 1))
            elif table and name in ("tr", "td", "th", "tbody", "thead", "caption", "p"):
                buf.append(" | " if name in ("td", "th") and not close else " ")
            elif name == "li":
                flush("para" if close else "item")
                bare = page and close
            elif name == "title" or (len(name) == 2 and name[0] == "h" and name[1] in "123456"):
                flush("para" if close else "heading")
                bare = page and close
            elif name in _BREAKS:
                flush("para")
                bare = page and (close or name in ("body", "html", "head"))
            elif name == "br":
                buf.append(" ")
            else:  # an inner tag
                buf.append(m[0] if name == "ref" else "")
        if pos < len(text) and not skip:
            buf.append(text[pos:])
        flush("para")

    # Markdown, wiki text, LaTeX, plain ----------------------------------------------------------
    def lines(self, text: str) -> None:
        lines = text.split("\n")
        n, i = len(lines), 0
        para: list[str] = []
        item: list[str] | None = None

        def flush() -> None:
            nonlocal item
            if item is not None:
                self.emit("item", "\n".join(item))
                item = None
            if para:
                self.emit("para", "\n".join(para))
                para.clear()

        while i < n:
            line = lines[i]
            i += 1
            if not line or line.isspace():
                flush()
                continue
            if not _BLOCK_START.match(line):
                (item if item is not None else para).append(line)
                continue
            s = line.strip()
            c = s[0]
            if c == "\x00":
                flush()
                at = 0
                for m in _MARK.finditer(s):
                    self.marked(m[1])
                    at = m.end()
                if s[at:].strip():
                    para.append(s[at:])
                continue
            if c == ":" and self.wiki:
                s = s.lstrip(": \t")
                if s:
                    para.append(s)
                continue
            if c == ":" and i < n and not s.strip(": "):
                continue
            if c == "<":
                m = _HTML_LINE.match(line)
                if m:
                    flush()
                    i = self.html_piece(lines, i - 1, m[1].lower())
                    continue
            elif c == "=":
                if _SETEXT.match(line) and para and item is None:
                    raw = "\n".join(para)
                    para.clear()
                    self.emit("heading", raw)
                    continue
                m = _WIKI_HEAD.match(line)
                if m:
                    flush()
                    self.emit("heading", m[2])
                    continue
            elif c == "\\":
                m = _TEX_HEAD.match(line)
                if m:
                    flush()
                    body, end = _balanced(line, m.end())
                    while end >= len(line) and not line.endswith("}") and i < n and lines[i].strip():
                        line += " " + lines[i]
                        i += 1
                        body, end = _balanced(line, m.end())
                    self.emit("heading", body)
                    rest = _TEX_DROP.sub("", line[end:]).strip()
                    if rest:
                        para.append(rest)
                    continue
                m = _TEX_TABLE.match(line)
                if m:
                    flush()
                    env = "\\end{" + m[1]
                    body = []
                    while i < n and env not in lines[i]:
                        body.append(lines[i])
                        i += 1
                    i += 1
                    self.emit("table", " ".join(body))
                    continue
                m = _TEX_ITEM.match(s)
                if m:
                    flush()
                    parts = _TEX_ITEM.split(s)
                    for p in parts[1:-1]:
                        self.emit("item", p)
                    item = [parts[-1]]
                    continue
                if _TEX_SKIP.match(line):
                    flush()
                    continue
            elif c == "#":
                m = _WIKI_ITEM.match(s) if self.wiki else None
                if m:
                    flush()
                    item = [m[1]]
                    continue
                m = None if self.tex else _MD_HEAD.match(line)
                if m:
                    flush()
                    self.emit("heading", m[1] or "")
                    continue
            elif c == "{":
                if s.startswith("{|"):
                    flush()
                    body = []
                    while i < n and not lines[i].lstrip().startswith("|}"):
                        body.append(lines[i])
                        i += 1
                    i += 1
                    self.emit("table", " ".join(body))
                    continue
                if s.startswith("{{"):
                    flush()
                    depth = s.count("{{") - s.count("}}")
                    while depth > 0 and i < n:
                        depth += lines[i].count("{{") - lines[i].count("}}")
                        i += 1
                    rest = s.rpartition("}}")[2].strip()
                    if rest and depth <= 0 and i < n + 1 and "}}" in s:
                        para.append(rest)
                    continue
            elif c == "|":
                flush()
                body = [s]
                while i < n and lines[i].lstrip().startswith("|"):
                    body.append(lines[i])
                    i += 1
                self.emit("table", " ".join(body))
                continue
            elif c == ">":
                if item is None:
                    para.append(s.lstrip("> "))
                else:
                    item.append(s.lstrip("> "))
                continue
            elif c == "-" and _SETEXT.match(line):
                if para and item is None:
                    raw = "\n".join(para)
                    para.clear()
                    self.emit("heading", raw)
                else:
                    flush()
                continue
            if not self.tex:
                m = _WIKI_ITEM.match(s) if c == "*" and (self.wiki or _NESTED.match(s)) else _ITEM.match(line)
                if m:
                    if c.isdigit() and para:
                        para.append(line)  # a wrapped number inside a paragraph
                        continue
                    flush()
                    item = [m[1]]
                    continue
            (item if item is not None else para).append(line)
        flush()

    def html_piece(self, lines: list[str], i: int, tag: str) -> int:
        """Read an HTML element that stands inside another format; gives the line after it."""
        opening, closing = re.compile(rf"<{tag}\b", re.I), re.compile(rf"</{tag}\s*>", re.I)
        depth, j, n = 0, i, len(lines)
        while j < n:
            if j > i and tag in ("p", "li") and not lines[j].strip():
                break
            depth += len(opening.findall(lines[j])) - len(closing.findall(lines[j]))
            j += 1
            if depth <= 0:
                break
        self.html("\n".join(lines[i:j]), False)
        return j


def _plain(text: str) -> str:
    """The text with one kind of line end, no byte order mark, and none of the characters that marks are made of."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("\ufeff"):
        text = text.lstrip("\ufeff")
    if "\x00" in text or "\x01" in text or "\x02" in text:
        text = re.sub("[\x00-\x02]", " ", text)
    return text


def is_page(body: str) -> bool:
    """Whether a lifted text is an HTML page: a doctype, html or body tag stands anywhere in it outside code."""
    return "<" in body and _IS_HTML.search(body) is not None and _IS_HTML.search(_INLINE_CODE.sub(" ", body)) is not None


def outside_code(text: str) -> str:
    """The text without comments, scripts, code and formulas, inline code included."""
    return _INLINE_CODE.sub(" ", _LIFT.sub(" ", text) if _LIFT_HINT.search(text) else text)


def parse_blocks(text: str | None, drop: frozenset[int] = frozenset()) -> list[Block]:
    if not text or text.isspace():
        return []
    p = _Parser(drop)
    text = _plain(text)
    body = p.lift(text)
    if is_page(body):
        p.html(body, True)
        return p.out
    tex = len(_TEX_HEADS.findall(body)) if "\\" in body else 0
    wiki = len(_WIKI_HEAD.findall(body)) if "=" in body else 0
    md = len(_MD_HEADS.findall(body)) if tex or wiki else 0
    p.tex = tex > max(wiki, md) or (not wiki and not md and ("\\item" in body or "\\emph{" in body or "\\textbf{" in body))
    p.wiki = not p.tex and wiki > md
    p.lines(body)
    return p.out


def container_spans(text: str, kept: list[Block]) -> list[tuple[int, int, int]]:
    """(start, end, hash) of each container element of a lifted HTML page, for template counting.

    What was lifted out counts with its kind and content, not with its running number in the page.
    """
    open_at: dict[str, list[int]] = {}
    found = []
    for m in _TAG.finditer(text):
        name = m[2].lower()
        if name not in _CONTAINERS:
            continue
        if not m[1]:
            if not m[3].endswith("/"):
                open_at.setdefault(name, []).append(m.start())
        elif open_at.get(name):
            a = open_at[name].pop()
            s = squeeze(text[a : m.end()])
            if kept:
                s = _ANY_MARK.sub(lambda k: "\x00{} {}\x00".format(*kept[int(k[2])]), s)
            found.append((a, m.end(), xxhash.xxh64_intdigest(s) - 2**63))
    return found


def subtree_hashes(text: str) -> set[int] | None:
    """Hashes of the containers of a page, of the same form as those that are removed; None: not a page."""
    p = _Parser(frozenset())
    body = p.lift(_plain(text))
    return {h for _, _, h in container_spans(body, p.kept)} if is_page(body) else None


def template_spans(text: str, drop: frozenset[int], kept: list[Block]) -> dict[int, int]:
    return {a: e for a, e, h in container_spans(text, kept) if h in drop}


# Spark ------------------------------------------------------------------------------------------
def host_of(origin: str = "origin"):
    """Host of an address; of a path its first two parts. Case and outer blanks don't count."""
    o = F.lower(F.trim(F.coalesce(F.col(origin), F.lit(""))))
    host = F.regexp_extract(o, r"^[a-z][a-z0-9+.-]*://([^/?#]+)", 1)
    return F.when(host != "", host).otherwise(F.regexp_extract(o, r"^(/?[^/]*(?:/[^/]+)?)", 1))


def _subtrees(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for b in batches:
        hosts, pages, hashes = [], [], []
        for host, page, text in zip(b[0].to_pylist(), b[1].to_pylist(), b[2].to_pylist()):
            found = subtree_hashes(text)
            for h in () if found is None else (None, *found):  # None stands for the page itself
                hosts.append(host)
                pages.append(page)
                hashes.append(h)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(hashes, pa.int64())], ["host", "page", "h"])


def site_templates(docs: DataFrame, min_pages: int = 5, min_share: float = 0.05, many_pages: int = 200) -> DataFrame:
    """``host, drop ARRAY<BIGINT>``: hashes of subtrees that recur on many pages of their host.

    A page is an origin with a source, however often it was delivered. A subtree is template if it
    stands on at least ``min_pages`` pages and on ``min_share`` of its host's pages or on ``many_pages``
    of them, however large the host is. What is a page is decided where texts are parsed, by ``is_page``;
    the filter here only passes over texts that cannot be one. Counting is one grouped aggregate over
    distinct (host, page, hash); a host has at most containers per page / min_share templates, or, if it is
    large, pages * containers per page / many_pages.
    """
    maybe = docs.filter(F.col("text").rlike("(?i)<(!doctype|html|body)")).select(
        host_of().alias("host"), F.xxhash64(F.lower(F.trim(F.coalesce("origin", F.lit("")))), F.coalesce("source", F.lit(""))).alias("page"), "text"
    )
    subtrees = maybe.mapInArrow(_subtrees, "host string, page bigint, h bigint").distinct()
    counts = cut_lineage(subtrees.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("h").isNull() | (F.col("n") >= min_pages)))
    per_host = counts.filter(F.col("h").isNull()).select("host", F.col("n").alias("pages"))
    return (
        counts.filter(F.col("h").isNotNull())
        .join(per_host, "host")
        .filter(F.col("n") >= F.least(F.col("pages") * min_share, F.lit(many_pages)))
        .groupBy("host")
        .agg(F.collect_set("h").alias("drop"))
    )


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    none: frozenset[int] = frozenset()
    for b in batches:
        ids, seqs, kinds, contents = [], [], [], []
        drops = b[2].to_pylist() if b.num_columns > 2 else [None] * b.num_rows
        for doc_id, text, drop in zip(b[0].to_pylist(), b[1].to_pylist(), drops):
            for k, (kind, content) in enumerate(parse_blocks(text, frozenset(drop) if drop else none)):
                ids.append(doc_id)
                seqs.append(k)
                kinds.append(kind)
                contents.append(content)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(seqs, pa.int32()), pa.array(kinds, pa.string()), pa.array(contents, pa.string())], ["doc_id", "seq", "element", "content"]
        )


#: Hosts with templates, and template hashes of all hosts, that are broadcast at most: 16 MB of hashes.
BROADCAST_HOSTS, BROADCAST_HASHES = 100_000, 2_000_000


def _with_templates(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of every document, with the template hashes of its host as ``drop`` if any host has some.

    Hashes are broadcast only if the numbers of hosts and of hashes were checked; beyond the bounds
    they are joined by host, and AQE splits the rows of a hot one.
    """
    templates = cut_lineage(site_templates(docs))
    size = templates.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(F.size("drop")), F.lit(0)).alias("hashes")).first()
    hosts = size["hosts"]
    rows = docs.select("doc_id", "text", host_of().alias("host"))
    if not hosts:
        return spread(rows.select("doc_id", "text"))
    side = F.broadcast(templates) if hosts <= BROADCAST_HOSTS and size["hashes"] <= BROADCAST_HASHES else templates
    return spread(rows.join(side, "host", "left").select("doc_id", "text", "drop"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, seq, element, content`` for every block of every document, without its site's templates."""
    return _with_templates(docs).mapInArrow(_blocks, "doc_id bigint, seq int, element string, content string")


def clean_text(docs: DataFrame) -> DataFrame:
    """``doc_id, clean``: one text per document, structure kept as Markdown, without its site's templates.

    The text is made of the blocks of ``clean_documents``; a document without blocks has an empty one.
    """

    def render(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        form = {"heading": "# {}", "item": "- {}", "code": "```\n{}\n```", "formula": "$$\n{}\n$$"}
        for b in batches:
            drops = b[2].to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            texts = ["\n\n".join(form.get(k, "{}").replace("{}", c) for k, c in parse_blocks(t, frozenset(d or ()))) for t, d in zip(b[1].to_pylist(), drops)]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(texts, pa.string())], ["doc_id", "clean"])

    return _with_templates(docs).mapInArrow(render, "doc_id bigint, clean string")
