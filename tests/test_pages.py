import io
import re
import zipfile
from html import unescape

from pyspark.sql import functions as F

from millrace.operators import search
from millrace.sources import files, pages

RUN = "some running text that goes on and on without a link in it, " * 4
PAGE = f"""<html><head><title>T</title><script>var a = "<p>no</p>"</script></head><body>
<div id="top-nav"><a href=/>Home</a> <a href=/a>About us</a></div><div><a href=1>One link here</a> <a href=2>Two links</a></div>
<div class=post><h2>Title &amp; more</h2><p>{RUN}<p>Short.<ul><li>first item<li>second <b>item</b></ul>
<table><tr><th>a<th>b|c<tr><td>1<td>2</table><pre>x = 1
  y</pre><p>{RUN}<p>Read <a href=x>this and that and those</a></div>
<div class="share">Share this now with everyone whom you know and love</div><div><h3>Elsewhere</h3><a href=3>Some other page</a><a href=4>And one more page</a></div>
<footer>(c) someone</footer></body>"""


def test_main_content_is_markdown():
    run = RUN.strip()
    assert pages.main_content(PAGE) == f"## Title & more\n\n{run}\n\nShort.\n\n- first item\n- second item\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 |\n\n```\nx = 1\n  y\n```\n\n{run}"


def test_odd_pages():
    assert pages.main_content(None) == pages.main_content("") == pages.main_content("<html><nav>a b c</nav>") == ""
    assert pages.main_content("just a few words") == "just a few words"
    assert pages.main_content("<p>one<div>two</span></div></article>three<td>four") == "one\n\ntwo\n\nthree\n\nfour"
    assert pages.main_content("<ul><li>a<ul><li>b</ul></ul>") == "- a\n  - b"
    assert len(pages.main_content("<div>" * 3000 + RUN * 200)) > 10_000
    assert pages.main_content("<article><p>In.</p></article><p>" + RUN) == "In.\n\n" + RUN.strip()
    assert pages.main_content(f"<article><p>{RUN}</p></article><p>a few words outside of it") == RUN.strip()


def test_pages_keep_their_articles_and_lose_the_rest(spark):
    """All words of the articles stay, in order; of the words around them none does."""
    kept = around = 0
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        html = re.sub(r"(?s)<(script|style|title)>.*?</\\1>|<!--.*?-->", "", r["html"])
        article = re.search(r"(?s)<article>(.*)</article>", html)[1]
        words = lambda t: re.findall(r"[^\W\d_]+", unescape(re.sub(r"<[^>]*>", " ", t)))
        got = re.findall(r"[^\W\d_]+", pages.main_content(r["html"]))
        assert got == words(article)
        kept, around = kept + len(got), around + len(words(html.replace(article, "")))
    assert kept > 5000 and around > 500


def test_references_without_their_semicolon(spark):
    """A title that is cut within &amp; keeps the letters, as the SQL has them; browsers read a sign."""
    page = f"<article><h1>Ver&amp; &lt &#65; &copy=1 &notit; &amp</h1><p>{RUN}</p></article>"
    assert pages.main_content(page).startswith("# Ver& < A ©=1 ¬it; &\n")
    assert pages.main_content(page, unclosed=False).startswith("# Ver& &lt A &copy=1 ¬it; &amp\n")
    assert pages.main_content(None, unclosed=False) == ""
    rows = spark.createDataFrame([("u", page)], "url string, html string")
    at = lambda **how: files.pages_as_documents(rows, **how).first()["content"].split("\n")[0]
    assert at() == "# Ver& < A ©=1 ¬it; &" and at(unclosed=False) == "# Ver& &lt A &copy=1 ¬it; &amp"


def test_epub_follows_the_manifest(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("OPS/b.xhtml", "<p>first</p>")
        z.writestr("OPS/a b.xhtml", "<p>second</p>")
        z.writestr("OPS/unlisted.xhtml", "<p>no</p>")
        z.writestr("META-INF/container.xml", '<container xmlns="u"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        items = "".join(f'<item href="{h}" media-type="{m}"/>' for h, m in (("b.xhtml", "application/xhtml+xml"), ("x.css", "text/css"), ("a%20b.xhtml", "application/xhtml+xml"), ("gone.xhtml", "application/xhtml+xml")))
        z.writestr("OPS/p.opf", f'<package xmlns="v"><manifest>{items}</manifest></package>')
    assert files.epub_text(data.getvalue()) == "first\n\nsecond"


def test_values_of_headers_are_filtered(spark):
    notes = {
        1: "---\nstatus: open\ndue: 2024-05-01\nrank: 3\ndone: true\nmeta: {owner: {name: Ann}, tags: [x, y]}\n---\nbody",
        2: "---\nstatus: [open, late]\ndue: 2024-07-01\nrank: 7.5\n---\nbody",
        3: "---\n: bad : yaml\n---\nbody",
        4: "no header",
        5: None,
    }
    df = spark.createDataFrame(list(notes.items()), "id long, raw string").select("id", files.front_values(F.col("raw")).alias("frontmatter"))
    found = lambda **where: [r["id"] for r in search.payload_filter(df, {f"frontmatter.{k.replace('__', '.')}": v for k, v in where.items()}).orderBy("id").collect()]
    assert found(status="open") == [1, 2] and found(status=["late", "zz"]) == [2] and found(status=[]) == []
    assert found(rank={"gt": 3}) == [2] and found(rank={"gte": 3, "lt": 7}) == [1] and found(rank="3") in ([], [1])
    assert found(due={"lt": "2024-06-01"}) == [1] and found(done=True) == [1]
    assert found(meta__owner__name="Ann") == [1] and found(meta__tags="y") == [1] and found(meta__none={"ne": "q"}) == [1, 2, 3, 4, 5]
