import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import markup
from lodestone.llm.markup import clean_documents, clean_text, parse_blocks, site_templates

MARKED = ("heading", "item", "code", "formula")


def marked(text):
    return [b for b in parse_blocks(text) if b[0] in MARKED]


def test_markdown():
    text = (
        "\ufeff# Title #\r\n\r\nSome **bold** and `SET_MAX_ROWS`.\r\n\r\nSet\r\n---\r\n\r\n* one [link](../a_(b).log)\r\n** nested\r\n+ _two_\r\n1. three &amp; R&D\r\n\r\n"
        "~~~yaml\r\n# no heading\r\n- no item\r\n== no ==\r\n~~~\r\n\r\n$$\r\nx_{1} = 2\r\n$$\r\n\r\nIt costs $2 or $7 each.\r\n"
    )
    assert marked(text) == [
        ("heading", "Title"), ("heading", "Set"), ("item", "one link"), ("item", "nested"), ("item", "two"), ("item", "three & R&D"),
        ("code", "# no heading - no item == no =="), ("formula", "x_{1} = 2"),
    ]
    assert ("para", "Some bold and SET_MAX_ROWS.") in parse_blocks(text) and ("para", "It costs $2 or $7 each.") in parse_blocks(text)


def test_html():
    text = (
        "<html><head><title>Page &eacute;</title><style>h1 { }</style></head><body>\n<nav><ul><li>menu</li></ul></nav>\n<H1 id='x'>A <b>B</b></H1>\n"
        "<!-- <h2>gone</h2> -->\n<p>Text &lt; 5<br>more.</p>\n<ul>\n<li>one\n<li>two <code>X_Y</code>;</li>\n</ul>\n<pre><code class='sh'># c\n&lt;h2&gt;x&lt;/h2&gt;</code></pre>\n"
        "<p>\\(a &lt; b\\)</p><script>var x = '<h1>no</h1>';</script><footer><li>no</li></footer></body></html>"
    )
    assert marked(text) == [("heading", "Page é"), ("heading", "A B"), ("item", "one"), ("item", "two X_Y;"), ("code", "# c <h2>x</h2>"), ("formula", "a < b")]
    assert ("para", "Text < 5 more.") in parse_blocks(text)


def test_wiki():
    text = (
        "{{Notice|state=draft}}\n\n= ''Top'' =\n\n==No blanks==\n\n* one [[A|two]].\n** deep [https://x.example three]\n# num\n\n"
        "<syntaxhighlight lang=\"sh\">\n# x\n<h2>y</h2>\n</syntaxhighlight>\n\n:<math>\n\\sqrt{w} < p\n</math>\n\nText<ref>gone</ref> '''bold'''.\n\n{|\n|-\n| a || b\n|}"
    )
    assert marked(text) == [("heading", "Top"), ("heading", "No blanks"), ("item", "one two."), ("item", "deep three"), ("item", "num"), ("code", "# x <h2>y</h2>"), ("formula", "\\sqrt{w} < p")]
    assert ("para", "Text bold.") in parse_blocks(text)


def test_latex():
    text = (
        "\\documentclass{article}\n\\begin{document}\n\n\\section{When \\href{https://x.example/a}{the} planner stops}\\label{s:1}\n\n\\subsection*{R\\&D}\n\n\\begin{itemize}\n\\item set \\texttt{A\\_B}\n\\item \\textbf{two}\n\\end{itemize}\n\n"
        "\\begin{lstlisting}\n\\section{no}\n- no\n\\end{lstlisting}\n\n\\[\nx = 1\n\\]\n\n\\begin{equation}\n\\sum_{i} y\n\\end{equation}\n\nCosts \\$9 \\emph{now}.\n\n\\begin{tabular}{ll}\na & b \\\\\n\\end{tabular}\n\\end{document}"
    )
    assert marked(text) == [("heading", "When the planner stops"), ("heading", "R&D"), ("item", "set A_B"), ("item", "two"), ("code", "\\section{no} - no"), ("formula", "x = 1"), ("formula", "\\sum_{i} y")]
    assert ("para", "Costs $9 now.") in parse_blocks(text)


def test_pieces_of_another_format():
    assert marked("# A\n\n<ul>\n<li>x <b>y</b></li>\n</ul>\n\n<pre># z</pre>\n\n== B ==\n\n<h2>C</h2>\n") == [("heading", "A"), ("item", "x y"), ("code", "# z"), ("heading", "B"), ("heading", "C")]


@pytest.mark.parametrize("text", [None, "", " \n\t", "\ufeff"])
def test_nothing(text):
    assert parse_blocks(text) == []


def test_plain_and_broken():
    assert parse_blocks("Just words\n\nand 3 < 5 more") == [("para", "Just words"), ("para", "and 3 < 5 more")]
    assert marked("```\nnever closed\n# x") == [("code", "never closed # x")]
    assert marked("<html><body><ul><li>a<li>b") == [("item", "a"), ("item", "b")]
    assert parse_blocks("z" * 200_000) == [("para", "z" * 200_000)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=list("ab \n#*-=`~$<>/ph1[]()\\{}_|&;'\x00\x01é"), max_size=80))
def test_never_breaks(text):
    for kind, content in parse_blocks(text):
        assert kind in (*MARKED, "para", "table") and content == " ".join(content.split()) != ""


def page(n, extra=""):
    return f"<html><body><div><p>Site notice</p><ul><li>menu entry</li></ul></div><h1>Page {n}</h1><ul><li>own {n}</li></ul>{extra}</body></html>"


def test_site_templates(spark, monkeypatch):
    rows = [(n, f"p{n}.html", "https://a.example/x", page(n)) for n in range(8)]
    rows += [(100 + n, "one.html", "https://b.example/x", page(1)) for n in range(9)]  # one page, delivered often
    rows += [(200, None, None, page(9)), (201, "n", "https://a.example/x", None), (202, "m.md", "https://a.example/x", "# menu entry\n\n- menu entry")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, origin string, text string").selectExpr("*", "1 AS drop", "2 AS host", "3 AS element")
    got = {r["host"]: len(r["drop"]) for r in site_templates(df).collect()}
    assert got == {"a.example": 2}  # the div, and the list in it
    found = {}
    for r in clean_documents(df).collect():
        found.setdefault(r["doc_id"], set()).add((r["element"], r["content"]))
    assert found[3] == {("heading", "Page 3"), ("item", "own 3")}
    assert ("item", "menu entry") in found[100] and ("item", "menu entry") in found[200] and ("item", "menu entry") in found[202]
    assert 201 not in found
    monkeypatch.setattr(markup, "BROADCAST_HASHES", 1)
    by_join = {(r["doc_id"], r["element"], r["content"]) for r in clean_documents(df).collect()}
    assert by_join == {(d, *b) for d, s in found.items() for b in s}
    assert clean_documents(df.limit(0)).count() == 0


def test_templates_of_a_large_host(spark):
    """What recurs on many pages goes, however small its share of the host."""
    rows = [(n, f"p{n}.html", "https://a.example/x", page(n) if n < 12 else f"<html><body><div>own {n}</div></body></html>") for n in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, origin string, text string")
    assert site_templates(df).count() == 0 and [len(r["drop"]) for r in site_templates(df, many_pages=12).collect()] == [2]


def test_clean_text_has_no_templates(spark, monkeypatch):
    rows = [(n, f"p{n}.html", "https://a.example/x", page(n, "<p>Own words.</p>")) for n in range(8)]
    rows += [(100, "p.html", "https://c.example/x", page(1)), (101, "n", "https://a.example/x", None), (102, "e", None, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, origin string, text string")
    for bound in (10, 0):
        monkeypatch.setattr(markup, "BROADCAST_HOSTS", bound)
        got = clean_text(df)
        texts = {r["doc_id"]: r["clean"] for r in got.collect()}
        assert len(texts) == got.count() == 11 and texts[101] == texts[102] == ""
        assert texts[3] == "# Page 3\n\n- own 3\n\nOwn words."
        assert texts[100] == "Site notice\n\n- menu entry\n\n# Page 1\n\n- own 1"
    assert clean_text(df.limit(0)).count() == 0


def test_templates_with_code_and_formulas(spark):
    box = "<div><p>Install</p>{}<pre>pip install x\n</pre><ul><li>cost \\(n\\)</li></ul></div>\r\n<section><pre>y {}</pre></section>"
    rows = [(n, f"p{n}.html", "https://a.example/x", page(n, f"<pre>own {n}</pre>" * (n % 3) + box.format("<!-- built -->", n))) for n in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, origin string, text string")
    assert [len(r["drop"]) for r in site_templates(df).collect()] == [4]  # both divs, and the lists in them; no section: their code differs
    found = {}
    for r in clean_documents(df).collect():
        found.setdefault(r["doc_id"], []).append((r["element"], r["content"]))
    for n in range(8):
        assert sorted(found[n]) == sorted([("heading", f"Page {n}"), ("item", f"own {n}"), ("code", f"y {n}")] + [("code", f"own {n}")] * (n % 3))


LICENCE = "<!-- " + "Licensed to nobody in particular. " * 40 + "-->"
PREFACE = "Words of a preface, without any tag. " * 20 + "\n"


@pytest.mark.parametrize("before", [LICENCE, PREFACE, LICENCE + "\n" + PREFACE, "<script>" + "x = 1; " * 200 + "</script>"])
@pytest.mark.parametrize("start", ["<!DOCTYPE html><html><head>", "<html lang='en'><head>", "<body>"])
def test_page_after_a_long_preface(before, start):
    text = before + start + "<title>T</title><h1>A</h1><ul><li>one</li><li>two</li></ul><p>Words.</p></body></html>"
    assert marked(text) == [("heading", "T"), ("heading", "A"), ("item", "one"), ("item", "two")]
    assert ("para", "Words.") in parse_blocks(text)


@pytest.mark.parametrize("code", ["```html\n<!doctype html><body>\n```", "A span `<body>` here.", "``a ` <html> b``", "Sample:\n\n    <html>\n      <body>\n\n    </html>", "<pre><body></pre>", "Use <code><html></code>."])
def test_tags_in_code_make_no_page(code):
    text = f"= Top =\n\n{code}\n\n* one\n*# two\n"
    found = marked(text)
    assert found[0] == ("heading", "Top") and ("item", "one") in found


def test_templates_of_pages_after_a_preface(spark):
    rows = [(n, f"p{n}.html", "https://a.example/x", LICENCE + page(n)) for n in range(8)]
    rows += [(100 + n, f"m{n}.md", "https://a.example/x", f"# Of {n}\n\n`<body>`\n\n<ul><li>kept</li></ul>\n") for n in range(200)]  # no pages
    df = spark.createDataFrame(rows, "doc_id bigint, source string, origin string, text string")
    assert [len(r["drop"]) for r in site_templates(df).collect()] == [2]
    found = {}
    for r in clean_documents(df).collect():
        found.setdefault(r["doc_id"], []).append((r["element"], r["content"]))
    assert found[3] == [("heading", "Page 3"), ("item", "own 3")] and ("item", "kept") in found[100]
