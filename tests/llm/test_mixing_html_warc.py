import base64
import hashlib
import html.parser
import re

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewright.llm.html_text import extract, lines_of, main_text
from tapewright.llm.mixing import Plan, mix, mix_sql
from tapewright.llm.queries import MIX
from tapewright.llm.warc import record_bytes, write, write_and_read

from .conftest import documents


def by_sql(docs, plan, tmp_path):
    # not through pandas: a null would turn the ids into floats
    docs.select("doc_id", "text", "lang", "source").write.mode("overwrite").parquet(f"file://{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    return sorted(con.execute(mix_sql(plan)).fetchall(), key=str)


def test_mixing_equals_sql(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for plan in (MIX, Plan(budget=0.9, epochs=1, seed=23), Plan({"web": 9.0}, {"en": 0.5}, {"src1": 3.0}, 1.7, 3, 5)):
        got = sorted((tuple(r) for r in mix(docs, plan, ["doc_id"]).collect()), key=str)
        assert got and got == by_sql(docs, plan, tmp_path)


def test_mixing_messy_rows(spark, messy, empty, tmp_path):
    rows = [(i, "one two three", None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}") for i in range(60)] + [(99, "", "de", "s9"), (98, None, "de", "s9"), (1, "one two three", "en", "s1")]
    docs = documents(spark, rows)
    for plan in (Plan(budget=0.5, epochs=2), Plan(budget=0.9, epochs=1)):
        assert sorted((tuple(r) for r in mix(docs, plan, ["doc_id"]).collect()), key=str) == by_sql(docs, plan, tmp_path)
    assert mix(empty, MIX, ["doc_id"]).collect() == [] and mix(messy, MIX, ["doc_id"]).count() > 0


def test_mixing_repeated_rows_and_ranges(spark, monkeypatch, tmp_path):
    """A third of the rows are one row, and leaves are cut in several rounds of ranges."""
    from tapewright.llm import mixing

    monkeypatch.setattr(mixing, "RANGE", 1)
    rows = [(7, "the same words again", "en", "s1")] * 200 + [(None, "no id here", "en", "s1")] * 50 + [(i, "word " * (i % 40 + 1), "en", f"s{i % 2}") for i in range(400)]
    docs = documents(spark, rows).repartition(5)
    for plan in (Plan(budget=0.5, epochs=1), Plan(budget=1.3, epochs=2, seed=4), Plan(budget=0.2, epochs=1, seed=9)):
        assert sorted((tuple(r) for r in mix(docs, plan, ["doc_id"]).collect()), key=str) == by_sql(docs, plan, tmp_path)


def test_mixing_by_given_domains_and_tokens(spark):
    rows = [(i, "a b c d", "en", f"s{i % 4}") for i in range(40)]
    out = mix(documents(spark, rows), Plan({"x": 3.0}, budget=0.5, epochs=1), ["doc_id"], lambda s: F.when(s == "s0", "x").otherwise("y"), lambda t: F.lit(10).cast("long")).collect()
    assert {r.tokens for r in out} == {10} and {r.domain for r in out} <= {"x", "y"} and sum(r.domain == "x" for r in out) == 10


ARTICLE = "The first paragraph of the story is long enough to be text &amp; more."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{color:red}}</style><script>var a = "<p>no</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head&shy;line</h1><p>{ARTICLE}</p><p>Second   with
 <b>bold</b> and <a href="x">link</a>.</p><!-- hidden --><form><input>Sign up</form><div class="ad">Buy</div></article>
<aside>Related</aside><div id="comments"><p>A reader says that this was a very good story indeed, and long too.</p></div><footer>Imprint</footer></body></html>"""


def test_article_text():
    assert main_text(PAGE) == "Head­line\n\nThe first paragraph of the story is long enough to be text & more.\n\nSecond with bold and link."
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<script>x</script>") == ""
    assert main_text(f"<body><div class=menu>Home</div><p>{ARTICLE * 3}</p><footer>f") .startswith("The first paragraph")


def test_pages(spark):
    rows = [(1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (2, None, None, "x", "y"), (None, "v", "<p>" + "long words here " * 50_000 + "</p>", "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = sorted((tuple(r) for r in extract(df).collect()), key=str)
    assert got == sorted(((i, u, main_text(h), len(main_text(h))) for i, u, h, _, _ in rows), key=str) and got[-1][3] > 700_000
    assert extract(df.limit(0)).collect() == []


def test_marker_words_are_whole_names():
    for name in ("post category-social", "post has-comments", "menu"):
        assert main_text(f'<article class="{name}"><p>{ARTICLE}</p></article>').startswith("The first paragraph")
    for head in ('<header class="entry-header"><h1>Top</h1></header>', '<h2 class="section-header">Top</h2>', '<h2 class="header">Top</h2>', '<div class="header"><h2>Top</h2></div>'):
        assert main_text(f"<article>{head}<p>{ARTICLE}</p></article>").startswith("Top\n\nThe first")
    assert main_text(f'<div class="layout has-sidebar" data-menu="nav" aria-hidden="false"><p>{ARTICLE * 2}</p></div>').startswith("The first")
    for part in ('<div class="x site_header">no</div>', '<div id="ad">no</div>', "<div hidden>no</div>", '<div class="comments"><article>no</article></div>', "<aside><article>no</article></aside>", '<p class="notice">no'):
        assert "no" not in main_text(f"<p>{ARTICLE * 2}</p>{part}<p>{ARTICLE * 2}</p>").split()


def test_hidden_names_are_whole_names():
    for tag in ("<svg-icon a='b'></svg-icon>", "<select-menu></select-menu>", "<title-bar></title-bar>", "<svg width=1 />", "<math/>", "<svg>", "<svg>no</svg >", "<script>no</script x>", "<object>no</object\n>"):
        assert main_text(f"<article><p>{ARTICLE}</p>{tag}<p>More.</p></article>") == ARTICLE.replace("&amp;", "&") + "\n\nMore."


def test_windows_choose_the_span():
    long, told = ARTICLE * 2, (ARTICLE * 2).replace("&amp;", "&")
    ad, menu = '<div class="ad">Buy</div>', "<nav>Go</nav>"
    for cut in (ad, "<form>Join</form>", menu):
        assert main_text(f"<div><p>{long}</p>{cut}<h2>Short</h2>{cut}<p>{long}</p></div>") == f"{told}\n\nShort\n\n{told}"
    assert main_text(f"<div><h1>Top</h1>{ad}<p>{long}</p>{ad}<p>End.</p></div>{menu}<div>Imprint</div>") == f"Top\n\n{told}\n\nEnd."
    assert main_text(f"<div><p>{long}</p><p>{long}</p></div>{menu}<article>Teaser</article>") == f"{told}\n\n{told}"
    assert main_text(f"<article><h1>Top</h1>{menu}<p>{long}</p>{menu}<p>End.</p></article><p>Imprint</p>") == f"Top\n\n{told}\n\nEnd."


def archived(rows, least=0):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        largest = max((p for p, _, h in rows if (h or "").encode() == raw and p is not None), default=None)
        first = len(raw) < least or page_id == largest
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else largest))
    return sorted(out, key=str)


def test_archive(spark, small, tmp_path):
    rows = [(1, "u", "same"), (5, "v\r\nX: y", "same"), (3, None, "same"), (2, "w", None), (4, "w", ""), (6, "é", "ünï " * 9000), (None, "n", "same"), (None, "n", "alone"), (5, "v", "same")]
    df = spark.createDataFrame([(*r, "k", "p") for r in rows], "page_id long, url string, html string, kind string, payload string")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for least in (0, 3):
        back = write_and_read(df, least)
        assert sorted((tuple(r) for r in back.select(columns).collect()), key=str) == archived(rows, least)
        assert back.filter("not verified").isEmpty()
    pages = spark.read.parquet(f"{small}/pages.parquet")
    assert sorted((tuple(r) for r in write_and_read(pages).select(columns).collect()), key=str) == archived([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert write_and_read(df.limit(0)).collect() == []
    write(df, str(tmp_path / "archive"))
    warc = {r.page_id: bytes(r.warc) for r in record_bytes(spark, str(tmp_path / "archive")).filter("page_id in (1, 6)").collect()}
    head, _, rest = warc[6].partition(b"\r\n\r\n")
    length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))[16:])
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and len(rest) == length + 4 and rest.endswith(("ünï " * 9000).encode() + b"\r\n\r\n")
    assert b"WARC-Type: revisit" in warc[1] and b"same" not in warc[1]


def test_ties_of_repeated_rows_are_counted_exactly(spark):
    """Rows that the order can't tell apart: as many as the budget leaves, whichever way they are spread."""
    rows = [(7, "one two", "en", "s1", i % 3) for i in range(40)] + [(i, "one two", "en", "s2", 0) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mark int")
    table = pa.Table.from_pylist([dict(zip(docs.columns, r, strict=True)) for r in rows])
    con = duckdb.connect()
    con.register("documents", table)
    want = sorted(r[0] for r in con.execute(mix_sql(Plan(budget=0.3, epochs=1, seed=5))).fetchall())
    for parts in (1, 3, 7):
        got = mix(docs.repartition(parts, "mark"), Plan(budget=0.3, epochs=1, seed=5), ["doc_id", "mark"]).collect()
        assert sorted(r.doc_id for r in got) == want
        marks = [r.mark for r in got if r.doc_id == 7]
        assert all(marks.count(m) <= 14 for m in range(3))


def test_a_changed_payload_ends_the_reading(spark):
    from tapewright.llm.warc import verified

    rows = spark.createDataFrame([(1, True), (None, True)], "page_id long, verified boolean")
    assert verified(rows).count() == 2
    with pytest.raises(Exception, match="differs from its digest: page 2"):
        verified(rows.union(spark.createDataFrame([(2, None)], rows.schema))).collect()


class _Plain(html.parser.HTMLParser):
    """Texts of block elements by the standard library's parser; what is marked as frame, hidden or in another's article is skipped."""

    BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "article", "main", "section", "blockquote", "pre", "td", "tr", "ul", "ol", "table", "header", "footer", "nav", "aside", "form", "body", "figure", "figcaption"}
    SKIP = {"script", "style", "nav", "aside", "footer", "form", "head", "noscript", "svg", "button", "select"}
    VOID = {"br", "img", "hr", "meta", "link", "input"}
    FRAME = {"nav", "menu", "sidebar", "footer", "header", "cookie", "cookie-banner", "notice", "ad", "ads", "advert", "share", "comments", "comment", "related", "newsletter", "breadcrumbs", "promo", "social", "subscribe", "pagination", "widget"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.now = [], [], ""

    def cut(self):
        text = " ".join(self.now.split())
        if text:
            self.blocks.append(text)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.cut()
        if tag in self.VOID:
            self.now += " " if tag == "br" else ""
            return
        names = {n.replace("_", "-").lower() for k, v in attrs if k in ("class", "id", "role") and v for n in v.split()}
        self.stack.append((tag, tag in self.SKIP or bool(names & self.FRAME) or tag == "header" and not any(t == "article" for t, _ in self.stack)))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.cut()
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(skip for _, skip in self.stack):
            self.now += data


def plain_blocks(page):
    parser = _Plain()
    parser.feed(page)
    parser.close()
    parser.cut()
    return parser.blocks


def surges(lengths):
    """Lines of an article by windows of three, straight from the definition: from the first stretch that reaches 80 to the last."""
    runs, i = [], 0
    while i < len(lengths):
        if lengths[i] == 0:
            i += 1
            continue
        j = i
        while j < len(lengths) and sum(lengths[j : j + 3]) > 0:
            j += 1
        runs.append((i, j, max(sum(lengths[k : k + 3]) for k in range(i, j))))
        i = j
    kept = [r for r in runs if r[2] >= 80] or runs
    return range(kept[0][0], kept[-1][1]) if kept else range(0)


def test_pages_without_article_follow_the_windows():
    long = "A line of an article that is long enough to make text surge when it is read with the lines around it."
    nav = "<nav><a href=x>menu</a></nav>"
    pages = {
        f"<p>{long}</p><p>short</p><p>{long}</p>": [long, "short", long],
        f"<div>tiny</div>{nav * 4}<p>{long}</p><p>{long} more</p>{nav * 4}<div>end</div>": [long, f"{long} more"],
        f"<p>{long}</p>{nav}<p>between</p>{nav}<p>{long}</p>": [long, "between", long],
        "<p>Hi</p><nav>n</nav><p>There</p>": ["Hi", "There"],
        f"<p>Hi</p>{nav * 5}<p>There</p>": ["Hi", "There"],
        "<nav>only a menu</nav>": [],
    }
    for page, want in pages.items():
        assert main_text(page).split("\n\n") == (want or [""]), page
    # turning the windows off would keep the short ends
    page = list(pages)[1]
    assert [x.text for x in lines_of(page) if x.text] == ["tiny", long, f"{long} more", "end"]


@given(st.lists(st.sampled_from([0, 0, 0, 2, 9, 30, 90]), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_windows_equal_their_definition(lengths):
    nav = "<nav>x</nav>"
    page = "".join(f"<p>{'w' * n}</p>" if n else nav for n in lengths)
    lines = lines_of(page)
    want = [lines[i].text for i in surges([x.weight for x in lines]) if lines[i].text]
    assert main_text(page) == "\n\n".join(want)


def test_given_pages_equal_a_plain_parser(spark, small):
    """Every block that the article element of a page holds, by another parser, and nothing else."""
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    differ = 0
    for r in pages:
        inner = re.search(r"<article\b.*</article>", r.html, re.S | re.I)
        differ += main_text(r.html) != "\n\n".join(plain_blocks(inner[0] if inner else r.html))
    assert differ == 0, differ


def test_deeply_nested_and_very_long_pages():
    deep = "<div>" * 3000 + "inner text that is long enough to be an article of its own, whatever lies around it, by a good measure" + "</div>" * 3000
    assert main_text(deep).startswith("inner text")
    many = "".join(f"<p>paragraph {i} of a page that has very many of them</p>" for i in range(20_000))
    assert main_text(many).count("\n\n") == 19_999
