"""Case texts: written examples, and what holds for any text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

import docketframe as d
from docketframe.functions import cases as C
from docketframe.functions.html import markdown_of
from docketframe.functions.text import text_after, text_before

SEP = "\n\n__\n"
ENG, FR = "Loading paragraph markers __\n", "Chargement des marqueurs de paragraphe __\n"


def run(spark, fn, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.p for r in rows.select("i", fn(F.col("t")).alias("p")).orderBy("i").collect()]


def random_texts(seed, pieces, n=800):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(n)]


PIECES = ["\n", "\n\n", "__", "__\n", " ", "  ", "*", "* ", "* * *", "!", "PDF", "a", "é", "[1] ", "] ", "\t", "\xa0", "**_ _**", "# ", " (CanLII) "]


CLEANED = {
    "": "", "a\nb": "a b", "a __\n b": "a __\nb", "x ! y PDF z": "x z", "x ! y": "x ! y",
    "a   b": "a b", "a * * * b": "a  b", "a * b": "a * b", "a\n\nb": "a b",
}


def test_clean_text(spark):
    assert dict(zip(CLEANED, run(spark, C.clean_text, list(CLEANED)))) == CLEANED


def test_cleaning_loses_layout_only(spark):
    texts = [t for t in random_texts(1, PIECES) if "!" not in t]
    for text, clean in zip(texts, run(spark, C.clean_text, texts)):
        left = lambda t: re.sub(r"[\s*]", "", t)
        assert left(clean) == left(text) and clean == clean.strip()


def test_long_separator_run(spark):
    assert run(spark, C.clean_text, ["a " + "* " * 200_000 + "* b", "* " * 50_000 + "x"]) == ["a  b", "x"]


def test_paragraphs(spark):
    examples = {
        "": [], "one": ["one"], "[1] one\n__\n[2] two": ["one", "two"], "a\n\n__\n\nb": ["a", "b"],
        "[12]  x": ["x"], "ninechars] x": ["ninechars] x"], " \n__\n ": [],
    }
    assert dict(zip(examples, run(spark, C.paragraphs, list(examples)))) == examples


def test_paragraphs_have_text(spark):
    for parts in run(spark, C.paragraphs, random_texts(2, [*PIECES, "\n__\n", "\n\n__\n", "[12] "])):
        assert all(part.strip() for part in parts)


def test_split(spark):
    page = ["a", "b", "c"]
    examples = {
        SEP.join([*page, ENG + "head", "body"]): ("head", "body", "", True),
        SEP.join([*page, ENG + FR + "head **_ _** Facts", "p1", "p2"]): ("head", "p1" + SEP + "p2", "Facts", True),
        SEP.join([*page, "no mark", "body"]): ("", "body", "", False),
        "short" + SEP + "text": ("", "short" + SEP + "text", "", False),
        "": ("", "", "", False),
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(examples)], "i int, markdown string")
    got = {list(examples)[r.i]: (r.header, r.body, r.section_heading, r.header_found) for r in d.split_cases(rows).collect()}
    assert got == examples


def test_split_with_other_separators(spark):
    rows = spark.createDataFrame([(" a.\\Eb.\\Ec.\\ELoading paragraph markers.\\Ebody ",)], "markdown string")
    assert d.split_cases(rows, separator=".\\E").first().body == "body"
    assert tuple(d.split_cases(rows, separator="").first()) == ("", rows.first().markdown.strip(), "", False)


def test_citation(spark):
    texts = ["# R v A, 2024 X 1 (CanLII) y # z (CanLII) ", "# none", "no (CanLII) ", " (CanLII) # b (CanLII) ", "#  x\ny  (CanLII) ", "# a (CanLII)"]
    assert run(spark, C.extract_citation, texts) == ["R v A, 2024 X 1", "", "", "b", "x\ny", ""]


def test_text_cuts(spark):
    texts = ["abcabc", "xyz", "", "bc"]
    assert run(spark, lambda t: text_before(t, "bc"), texts) == ["a", "xyz", "", ""]
    assert run(spark, lambda t: text_after(t, "bc"), texts) == ["abc", "xyz", "", ""]


def test_report_header(spark):
    texts = ["x Most recent unfavourable mention **A**\n\t_b_  c ", "**A**"]
    assert run(spark, C.report_header, texts) == [" A b c ", "A"]


def test_heading_opens_the_first_paragraph(spark):
    text = SEP.join(["a", "b", "c", ENG + "# R v A, 2024 ABCJ 1 (CanLII) x **_ _** Overview", "[1] one\ntwo", "[2] three Back to top x"])
    rows = spark.createDataFrame([(1, text), (2, "only body")], "doc_id int, markdown string")
    one, two = d.parse_cases(rows).orderBy("doc_id").collect()
    assert one.citation == "R v A, 2024 ABCJ 1"
    assert one.paragraphs == ["Overview\n\none two", "three"]
    assert (two.header, two.citation, two.paragraphs) == ("", "", ["only body"])
    numbered = d.paragraph_rows(d.parse_cases(rows), "doc_id").collect()
    assert sorted((r.doc_id, r.para_no) for r in numbered) == [(1, 1), (1, 2), (2, 1)]


@pytest.mark.parametrize(
    "html, markdown",
    [
        ("<h2 class='x'>Title</h2><p>a <b>b</b> <em>c</em></p>", "## Title\n\na **b** _c_"),
        ('<a class="k" href="/x.html#s1">s <i>1</i></a>', "[s _1_](/x.html#s1)"),
        ("<ul><li>a</li><li>b</li></ul>", "* a\n  * b"),
        ("a<br/>b<script>x<y</script><!-- c --><style>p{}</style>", "a  \nb"),
        ("<head><title>t</title></head>x &lt;b&gt; &amp;lt; &#233; &#xE9; &#x1F600; &#0; &#55296; &#; &bogus;", "x <b> &lt; é é 😀 &#0; &#55296; &#; &bogus;"),
        ("one\n two</p>\n\n\n<p>three", "one two\n\nthree"),
    ],
)
def test_html(spark, html, markdown):
    assert run(spark, markdown_of, [html]) == [markdown]


PAGES = [
    ("<table><tr><td>a</td><td>b</td></tr><tr><td>c<td>d</table>", "a| b\nc| d"),
    ("<table><tr><th class='h'>x</th> <th>y</th></tr></table>t", "x| y\n\nt"),
    ("<dl><dt>t<dd>d<dt>u</dt> <dd>e</dd></dl>after", "t\n    d\nu\n    e\n\nafter"),
    ("<ol><li>a</li><li>b</li></ol>c", "1. a\n  2. b\n\nc"),
    ("<ol start='7'><li>a<li>b</ol>", "7. a\n  8. b"),
    ("<ul><li>a<ol><li>b</li><li>c</li></ol></li><li>d</li></ul>", "* a\n    1. b\n    2. c\n  * d"),
    ("<ol><li>a<ul><li>b</ul><li>c</ol>", "1. a\n    * b\n  2. c"),
    ("a</ul></ol><li>b", "a\n  * b"),
    ("a<hr>b<HR />c", "a\n\n* * *\n\nb\n\n* * *\n\nc"),
    ("<blockquote><p>a</p><p>b</p></blockquote>c", "> a\n> \n> b\n\nc"),
    ("x<blockquote>never closed", "x\n\n> never closed"),
    ("<pre>\nif a:\n  b &lt; c\n</pre>d  e", "if a:\n      b < c\n\nd e"),
    ("caf&eacute; &sect; 7 &frac12; &Alpha; &nbsp;x&mdash;y &ldquo;q&rdquo; &copy;", "café § 7 ½ Α  x--y \"q\" (C)"),
    ("a < b and c > d &lt;i&gt; <i>e</i>", "a < b and c > d <i> _e_"),
    ("<a href='/x'>one <a href=\"/y\">two</a> <a name=z>three</a>", "one [two](/y) three"),
    ("<p>before<!-- never closed <b>x</b>", "before"),
    ("a<script>if (x</b>", "a"),
    ("", ""),
]


@pytest.mark.parametrize("html, markdown", PAGES)
def test_page_elements(spark, html, markdown):
    assert run(spark, markdown_of, [html]) == [markdown]


def test_hostile_pages_take_linear_time(spark):
    parts = ["<!--", "<a href='x'>", "<", "<li>", "<blockquote>", "<pre>", "<head", "&", "<td", "<ol><li>", "<script", "&#"]
    for part in parts:
        seconds = []
        for n in (500, 10_000):
            begin = time.perf_counter()
            run(spark, markdown_of, [part * n])
            seconds.append(time.perf_counter() - begin)
        assert seconds[1] < 8 + 4 * seconds[0], part


def test_pages_are_converted_once(spark):
    plan = d.pages_to_markdown(spark.createDataFrame([(1, "x")], "i int, html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("blockquote") == 2 and plan.count("<!--") == 1 and plan.count("strong") == 1
