import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tree_builder
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.operators import html, llms, urls
from folio.sources import sitemap


def read(page, part):
    return html.read(pa.array([page]), part)[0][0]


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v"))).first()[0]


@pytest.mark.parametrize(("url", "section"), [("https://x/", "ROOT"), ("https://x", "ROOT"), ("https://x/a/b?q#f", "a"), ("https://x/a%20b/c", "a b"), ("https://x/%zz", "ROOT"), ("https://x/a+b/", "a+b"), ("https://x?a/b", "ROOT")])
def test_section(spark, url, section):
    assert one(spark, url, urls.section) == section


@pytest.mark.parametrize(("url", "title"), [("https://x/my-first_page.html", "My First Page"), ("https://x/", "x"), ("https://x.io:8080", "x.io"), ("https://x/a/b/", "B")])
def test_title_from_url(spark, url, title):
    assert one(spark, url, urls.title_from_url) == title


def test_globs(spark):
    df = spark.createDataFrame([("https://x/docs/a",), ("https://x/blog/a",), ("https://x/docs/b.pdf",)], "url string")
    keep = lambda *a: [r[0] for r in urls.filter_urls(df, *a).collect()]
    assert keep(["**/docs/**"], ["*.pdf"]) == ["https://x/docs/a"]
    assert len(keep()) == 3
    with pytest.warns(UserWarning, match="left out"):
        assert len(keep(["[bad"])) == 3
    assert keep(["https://x/{blog,news}/[!b]"]) == ["https://x/blog/a"]
    assert urls.glob_to_regex("a\\*") == r"(?s)\Aa\*\z"


@pytest.mark.parametrize(
    ("page", "description"),
    [
        ("<p></p>", "No description available"),
        ('<meta name="description" content="  "><p>x</p>', ""),
        ('<meta property="og:description" content=" og ">', "og"),
        ("<p>" + "é" * 101 + "</p>", "é" * 98 + "�..."),
        ("<p>a<b>b<p>c", "ab"),
    ],
)
def test_description(page, description):
    assert read(page, "description") == description


@pytest.mark.parametrize(
    ("page", "content"),
    [
        ("<article><ul><li>a</li><li></li></ul><ol><li></li><li>b</li></ol></article>", "- a\n\n2. b\n\n"),
        ("<blockquote><p>q</p></blockquote>", "> q\n\nq\n\n"),
        ("<div class='x content'><h2>T</h2><p>one<p>two</div><p>out", "## T\n\none\n\ntwo\n\n"),
        ("<ul><li>a<ul><li>b</ul></ul>", "- ab\n- b\n\n- b\n\n"),
    ],
)
def test_content(page, content):
    assert read(page, "content") == content


def test_content_is_cut_in_bytes():
    got = read("".join(f"<p>{'é' * 100}{i}</p>" for i in range(100)), "content")
    assert got.endswith("\n\n... (content truncated)") and len(got.encode()) < 10_050


def test_title():
    assert read("<h1>H</h1>", "title") == "H"
    assert read("<title> a &amp; b </title><h1>H</h1>", "title") == "a & b"


PARTS = ("title", "description", "content")


def by_tree(page):
    doc = tree_builder.parse(page)
    return tree_builder.title_of(doc), tree_builder.description_of(doc), tree_builder.content_of(doc)


def same(pages):
    got = list(zip(*html.read(pa.array(pages, pa.string()), *PARTS), strict=True))
    for page, own in zip(pages, got, strict=True):
        assert own == by_tree(page), page


def test_all_pages_as_by_the_tree_builder(sf_dir):
    same(pq.read_table(f"{sf_dir}/pages.parquet")["html"].to_pylist())


MALFORMED = [
    "", "<", "</", "<p", "<p>a<", "<p>a < b > c", "a<!--b-->c<p>d", "<!-->a<p>b", "<!--->x<p>b", "<!-- <p>a</p> --><p>b", "<!--a--!><p>b", "<!DOCTYPE html><p>a", "<?php ?><p>b", "<!x><p>b", "</><p>a", "</ x><p>a",
    "<a title='>'>x</a><p a=\">\">b", "<p title=\"a'b\">c<p title='a\"b'>d", "<a href=x>y</a><p>z", "<p class=content>q<div id='content'><h2>x", "<div class=' a\tcontent '><p>x</div><p>y", "<div CLASS=Content><p>x", "<DIV ID=content><P>x</P>",
    "<script>if (a<b) '</p>' </script><p>x", "<style>p{}</style><h1>t</h1>", "<SCRIPT>x</Script ><p>y", "<p>a<script>b</script>c", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<ol><li><p>a<li>b</ol>", "<ul><p>x<li>y</ul>", "<blockquote>a<p>b</blockquote>c",
    "<table><tr><td><p>a<td>b<tr><td>c</table><p>d", "<table><tr><td></p>x</table>", "<h1>a<h2>b</h3>c", "<h2>a</h4>b<p>c", "</p><p></p>x", "<p>a</div>b<p>c", "<div><p>a</div>b", "<dl><dt>a<dd>b<dt>c</dl>", "<select><option>a<option>b</select><p>c", "<b><i>x</b>y</i><p>z",
    "<head><title>t</title><p>x", "x<head><title>t</title>", "<body><body><html><p>x", "<p><html><div>x", "<meta name=description content='a &amp; b'><p>c", "<meta content=z name='og:description'><meta property='og:description' content=' q '>", "<meta name='description' content=''><p>&lt;x&gt;",
    "<br/><img src='a'/><p>a<br>b<hr>c", "<foo>x</foo><p>a<foo>b</foo>c", "<averyveryverylongname>x</averyveryverylongname><p>y", "<averyveryverylongname1><p>a</averyveryverylongname2>b", "&amp;&#65;&unknown;<p>&copy;&notit;", "\u00a0<p>\u3000x\u3000</p>", "<p>" + "é" * 6_000, "<p>a</p>" * 3_000, "<i>" * 500 + "<p>x", "<main><article><p>x</article><p>y</main>",
]


@pytest.mark.parametrize("page", MALFORMED)
def test_malformed_pages_as_by_the_tree_builder(page):
    same([page])


def test_pages_of_a_batch_do_not_meet():
    """Unfinished tags, comments and quotes end with their page, wherever it lies in the batch."""
    pages = [p for p in MALFORMED for _ in range(2)] + [m + "<p>z" for m in MALFORMED] + ["<p title='", "<p>a", "<!-- x", "--><p>b", "<script>", "</script><p>c", "<p a='b", "c'>d"]
    alone = [html.read(pa.array([p]), *PARTS) for p in pages]
    together = html.read(pa.array(["x", None, *pages, None, ""])[1:], *PARTS)
    assert [list(x) for x in together] == [[None, *(a[k][0] for a in alone), None, e] for k, e in enumerate(("", html.NO_DESCRIPTION, ""))]


WORDS = ["<p>", "</p>", "<div>", "</div>", "<ul>", "</ul>", "<ol>", "<li>", "</li>", "<h1>", "</h2>", "<blockquote>", "</blockquote>", "<b>", "</b>", "<table>", "<tr>", "<td>", "</table>", "<article>", "</article>", "<body>", "<head>", "</head>", "<html>", "<br>", "<dl>", "<dt>", "<dd>", "<option>", "<custom-x>", "</custom-x>", "<span class='content'>", "</span>", "<!-- c -->", "text", " ", "&amp;", "é", "<meta name='description' content='d'>", "<section id=content>", "<button>", "</button>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=25).map("".join))
def test_any_order_of_tags(page):
    same([page])


@pytest.mark.parametrize(
    ("page", "part", "want"),
    [
        ("<title>a <b>x</b> &lt;</title>", "title", "a <b>x</b> <"),  # as browsers read it: text up to the end tag
        ("<textarea><p>no</textarea><p>yes", "description", "yes"),
        ("<p>a<script>b", "description", "ab"),
        ("<a x=a=' y='>'><p>z", "description", "z"),
        ("<p>a</p title='>'>b<p>c", "content", "a\n\nc\n\n"),
        ("<p>a < b > c<b", "description", "a < b > c"),
        ("<p>x</p", "description", "x"),
        ("<p " + "a='" * 50_000, "description", html.NO_DESCRIPTION),
        ("<p " + "=" * 50_000 + ">x", "description", "x"),
    ],
)
def test_tags_end_as_in_browsers(page, part, want):
    assert read(page, part) == want


def test_report(spark):
    page = lambda t, d: f"<title>{t}</title><meta name='description' content='{d}'>"
    rows = [(3, "https://x/b/longer", page("L", "l")), (1, "https://x/b/s", page("S", "s")), (2, "https://x/a/s", page("A", "a")), (4, "https://x/b/t", page("T", "t"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert llms.report(df).first()["report"] == "# \n\n> \n\n## A\n\n- [A](https://x/a/s): a\n\n## B\n\n- [S](https://x/b/s): s\n\n- [T](https://x/b/t): t\n\n- [L](https://x/b/longer): l\n\n"
    root = df.unionByName(spark.createDataFrame([(9, "https://x/", page("Home", "all")), (10, "https://x", page("H2", "no"))], df.schema))
    got = llms.report(root, max_pages=2, include=["*"]).first()["report"]
    assert got.startswith("# \n\n") and "[T]" not in got
    assert llms.report(root).first()["report"].startswith("# H2\n\n> no\n\n## A")
    assert llms.report(df.limit(0)).first()["report"] == "# \n\n> \n\n"
    for pages in (root, df.limit(0)):
        for full in (False, True):
            rows = llms.page_rows(pages, full)
            assert "".join(r["text"] for r in llms.render_rows(rows).collect()) == llms.render(rows).first()["report"]


def test_sitemaps(spark):
    urlset = "<?xml version='1.0'?><urlset xmlns='u'><url><loc>https://x/a</loc></url><url><loc></loc></url><url><lastmod>d</lastmod><loc>https://x/b?q=1&amp;r</loc></url></urlset>"
    index = "<sitemapindex><sitemap><loc>c1</loc></sitemap><sitemap><loc>gone</loc></sitemap><sitemap><loc>nested</loc></sitemap></sitemapindex>"
    bodies = spark.createDataFrame([("i", index, 200), ("c1", urlset, 500), ("nested", index, 200), ("t", "https://x/1\n\nhttps://x/2\r\n", 200), ("bad", urlset, 404), ("empty", "<urlset></urlset>", 200)], "url string, body string, status int")
    locs = lambda u: [r["loc"] for r in sitemap.expand(bodies, u).orderBy("seq").collect()]
    assert locs("i") == ["https://x/a", "https://x/b?q=1&r"]
    assert locs("t") == ["https://x/1", "https://x/2\r"]
    assert locs("bad") == []
    assert locs("empty") == ["<urlset></urlset>"]
    assert sitemap.expand(bodies, "i").orderBy("seq").collect()[1]["lastmod"] == "d"


def test_command(spark):
    from folio.plans.commands import llms_txt

    bodies = spark.createDataFrame([("m", "https://x/a/1\nhttps://x/a/2\nhttps://x/b/3", 200)], "url string, body string, status int")

    def get(url):
        return (404, "") if url.endswith("2") else (200, f"<title>{url[-1]}</title><p>d")

    report, errors = llms_txt(spark, bodies, "m", get)
    assert report.first()["report"].count("- [") == 2
    assert [(r["url"], r["error"]) for r in errors.collect()] == [("https://x/a/2", "status 404")]


CUT = '<title>A&amp;B &notit; &lt &#65 &amp</title><article><h1>A&amp;&amp</h1><p>&copy; &copy</article>'


def test_references_without_semicolon(spark):
    """As browsers read them, or, as the SQL of the queries does, only those that are closed."""
    assert [x[0] for x in html.read(pa.array([CUT]), "title", "content")] == ["A&B ¬it; < A &", "# A&&\n\n© ©\n\n"]
    assert [x[0] for x in html.read(pa.array([CUT]), "title", "content", closed=True)] == ["A&B &notit; &lt &#65 &amp", "# A&&amp\n\n© &copy\n\n"]


@pytest.mark.parametrize("name", ["page_title", "page_content", "page_rows", "llms_rows", "llms_txt_full"])
def test_cut_titles_as_in_sql(spark, tmp_path, name):
    import duckdb

    from folio.queries import QUERIES, SQL

    pages = [(i, f"https://x/{i % 3}/p{i}", f"<title>t{i} &amp;&amp</title><article><h1>t{i} &amp;&amp</h1><p>w &amp; {'&amp' * (i % 2)}</p></article>") for i in range(1, 9)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    picked = ", ".join(f'"{c}"' for c in df.columns)
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(df.collect()) == text(con.execute(f"SELECT {picked} FROM ({SQL[name]})").fetchall())


def test_a_piece_holds_its_own_bytes():
    pages = pa.array([f"<title>{i}</title>" + "x" * 1000 for i in range(50)])
    assert len(html.Index(pages.slice(10, 3)).bytes) == sum(len(p) for p in pages.slice(10, 3).to_pylist())


def test_few_pages_are_handed_over_at_once(spark):
    """Whatever the number of pages, a worker holds no more than 1,000 of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 10_000)
        llms.page_rows(spark.createDataFrame([(1, "https://x/a", "<p>x")], "page_id long, url string, html string"))
        assert int(spark.conf.get(key)) == 1_000
    finally:
        spark.conf.set(key, before)
