import pytest
from pyspark.sql import functions as F

from inkwell.functions import markdown, urls
from inkwell.functions.chunker import chunks
from inkwell.functions.html import body_of, links_of, parse, title_of, to_markdown

BASE = "https://docs.example.org/en/5.2/"


def values(spark, rows, expression, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expression(F.col("v"))).collect()]


def test_urls(spark):
    assert values(spark, ["https://h/a?b=1#c", "/rel", "HTTP://h/x;p", "mailto:x", None], urls.normalize_url) == ["https://h/a", "/rel", "http://h/x", "mailto:x", None]
    target = lambda v: urls.is_target_url(v, BASE, [BASE + "releases/"])
    assert values(spark, [BASE + "topics/", BASE + "releases/5.2/", "https://www.google.com", "https://docs.example.org/en/5.20/x"], target) == [True, False, False, True]
    page = lambda ext: lambda v: urls.file_path(v, ext, "/en/5.2/", BASE)
    assert values(spark, [BASE + "topics/db/models/", BASE, BASE + "x.html"], page(".html")) == ["topics/db/models.html", "_root_.html", "x.html"]
    assert values(spark, [BASE + "topics/db/models/", BASE, BASE + "x.html"], page(".md")) == ["topics/db/models.md", "_root_.md", "x.md"]
    assert values(spark, ["a\\_root_.html", "b.html"], lambda v: urls.path_url(v, BASE)) == [BASE + "a/", BASE + "b.html"]
    assert values(spark, ["intro/overview.txt", "topics\\settings.txt"], lambda v: urls.doc_path_url(v, BASE)) == [BASE + "intro/overview/", BASE + "topics/settings/"]
    assert values(spark, ["a/index.md", "a/protocol.md", "index/a.md"], urls.is_listing) == [True, True, False]


def test_source_meta(spark):
    put = lambda v: urls.with_source_meta(v, F.lit('https://h/?a="1"&b'))
    assert values(spark, ["<html><head><title>x", "<p>x"], lambda v: urls.source_meta(put(v))) == ['https://h/?a="1"&b'] * 2
    assert values(spark, ["<p>x"], lambda v: urls.recovered_url(v, F.lit("a.html"), BASE)) == [BASE + "a.html"]


def test_front_matter(spark):
    text = '---\nsource_url: https://h/\ntitle: "A "b" c"\ntarget_version: 4.20\n---\n\n# Body\n'
    get = lambda k: values(spark, [text], lambda v: markdown.front_matter_value(v, k))[0]
    assert (get("title"), get("target_version"), get("category")) == ('A "b" c', "4.20", None)
    assert values(spark, [text, "no front"], markdown.front_matter_body) == ["# Body", "no front"]
    assert values(spark, ["a\n\n\n\nb\n "], markdown.squeeze_newlines) == ["a\n\nb"]
    assert values(spark, ["docs/a.b.md", "x"], markdown.file_stem) == ["a.b", "x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (":doc:`Guide </intro/x.txt>`", "[Guide](https://d/intro/x/)"),
        (":doc:`intro/y`", "[intro/y](https://d/intro/y/)"),
        (":setting:`MY_THING` here", "[MY_THING](https://d/ref/settings/#my-thing) here"),
        (":class:`~a.B` and a\\_b &lt;i&gt;", "`a.B` and a_b <i>"),
        ("plain", "plain"),
    ],
)
def test_roles(spark, text, expected):
    assert values(spark, [text], lambda v: markdown.clean_roles(v, "https://d")) == [expected]


def test_html():
    page = '<html><body><header>h</header><main><h1> Main <b>Title</b></h1><p>Text<p>Next &amp; more<script>var t="</p>";</script><ul><li>a<li><a href="../x/">b</a></ul><pre><code class="language-python">print("Hello")\n</code></pre><img src="../../i.png" alt="I"></main><footer>Footer</footer></body></html>'
    body = body_of(parse(page))
    text = to_markdown(body, BASE + "topics/db/")
    assert title_of(body) == "MainTitle"
    assert "Footer" not in text and "var t" not in text
    assert text.startswith("# Main **Title**\n\nText\n\nNext & more\n\n* a\n* [b](" + BASE + "topics/x/)")
    assert '```python\nprint("Hello")\n```' in text and f"![I]({BASE}i.png)" in text
    assert body_of(parse("<nav>n</nav><article id='c'>A</article>"), ("article#c",)).text() == "A"
    assert body_of(parse("<div role='main'>M</div><main>N</main>")).text() == "M"
    assert body_of(parse("just text")).text() == "just text" and title_of(parse("x")) == "Untitled"
    assert links_of("<a href='a'>1</a><a name='q'>2</a><a href='//h/b#c'>3</a>", "https://x/y/") == ["https://x/y/a", "https://h/b#c"]


@pytest.mark.parametrize(("page", "inside"), [("<span>x" * 1500, "xxx"), ("<blockquote>x" * 700, "> > x"), ("<ul><li>x" * 600, "* x"), ("<font>x" * 3000 + "<p>end", "\n\nend"), ("<table><tr><td>x" * 200, "| x |"), ("<b>x" * 20_000, "**x")])
def test_depth_loses_no_page(page, inside):
    assert inside in to_markdown(body_of(parse(page)), BASE)


def test_chunks():
    assert [(h, c) for h, c in chunks("# Title\n\n## One\n\ntext\n\n### Deep\n\nmore\n\n#### D4\n\nx")] == [
        ({1: "Title", 2: "One"}, "# Title\n\n## One\n\ntext"),
        ({1: "Title", 2: "One", 3: "Deep"}, "### Deep\n\nmore"),
        ({1: "Title", 2: "One", 3: "Deep", 4: "D4"}, "#### D4\n\nx"),
    ]
    assert chunks(None) == chunks("") == chunks("\n \n") == []
    code = "```\n# no header\n" + "x = 1\n" * 600 + "```"
    made = chunks(f"intro\n\n{code}\n\noutro " + "word " * 1000)
    assert all(c.count("```") % 2 == 0 for _, c in made) and any(code in c for _, c in made)
    assert all(len(c) <= 1500 or "```" in c for _, c in made)
    text = "\n".join(f"line {i} of the text" for i in range(2000))
    joined = " ".join(c for _, c in chunks(text))
    assert all(line in joined for line in text.split("\n"))
    long = chunks("w" * 10_000)
    assert sum(len(c) for _, c in long) >= 10_000 and all(len(c) <= 1500 for _, c in long)
