import html
import re
import time

from storepulse.llm.line_blocks import extract_text, main_text
from storepulse.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def test_query_keeps_the_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    rows = QUERIES["op7_line_blocks"](spark, SF_SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r.page_id].html
        body = page[page.find("<article>"):page.find("</article>")]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|article)[^>]*>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


STORY = "This is a long text of the story. " * 8


def test_distribution_without_an_article():
    links = "".join(f"<div><a href={k}>Link {k}</a></div>" for k in range(6))
    assert main_text(f"<div>Top</div>{links}<div>{STORY}</div><div>Short end.</div>{links}<div>Copyright</div>") == f"{STORY.strip()}\nShort end."
    two = f"<div>{STORY}</div>{links}<div>{STORY}</div><div>b</div>"
    assert main_text(two) == f"{STORY.strip()}\n{STORY.strip()}\nb"
    assert main_text("plain text only") == "plain text only"


def test_beside_the_text():
    page = ("<head><title>T</title><style>p{}</style></head><body class='has-sidebar'><header>Head</header><nav>Menu</nav><div class='cookie-notice'>We use</div>"
            "<script>var t='</p>';</script><article><h1>A &amp; B</h1><p>x&nbsp;&eacute;<br>y<!-- c --></p><aside>side</aside><form>f<input></form>"
            "<p class=ad>buy<p>last <b>one</b></article><div id=comments><p>nice</p></div><footer>f</footer>")
    assert main_text(page) == "A & B\nx é y\nlast one"
    assert main_text("<article><p>cut off &am") == "cut off &am"
    assert main_text("<article><p>a</p><p title=\"x > y\">b<p hidden>c</p></article") == "a\nb"


def test_long_attribute_values():
    data = "x" * 100_000 + " ' > leaked"
    assert main_text(f'<p data-x="{data}">body</p>') == "body"
    assert main_text(f"<p data-json='{{\"a\": \"{data.replace(chr(39), '')}\"}}' title=\"a > b\">body</p>") == "body"
    assert main_text("<p class=it's>don't</p><p title=\"cut>off") == "don't\noff"
    at = time.process_time()
    main_text("<p a=\"> \" " * 100_000)
    main_text("<p a='><p b=\"" * 100_000)
    assert time.process_time() - at < 20


LONG = "A long paragraph of the story. " * 64
CLOSING = "The closing paragraph. " * 13


def test_removed_elements_do_not_part_the_text():
    for beside in ("<div class=ad>Buy this</div>", "<aside>Notice</aside>", "<form>f</form>"):
        assert main_text(f"<div>{LONG}</div>{beside}<div>{CLOSING}</div>{beside}<p>End.</p>") == f"{LONG.strip()}\n{CLOSING.strip()}\nEnd."
    links = "".join(f"<div><a href={k}>Link {k}</a></div>" for k in range(6))
    assert main_text(f"<div>{LONG * 25}</div>{links}<div>{CLOSING}</div>") == f"{(LONG * 25).strip()}\n{CLOSING.strip()}"
    assert main_text(f"<div>{LONG}</div>{links}<div>Between.</div>{links}<div>{CLOSING}</div>{links}<div>Copyright</div>") == f"{LONG.strip()}\nBetween.\n{CLOSING.strip()}"


def test_article_is_evidence_only():
    teasers = "".join(f"<article><h2><a href={k}>Teaser {k}</a></h2><p>Short.</p></article>" for k in range(4))
    links = "".join(f"<li><a href={k}>Link {k}</a></li>" for k in range(6))
    assert main_text(f"<div>{LONG}</div><div>{CLOSING}</div>{teasers}") == f"{LONG.strip()}\n{CLOSING.strip()}"
    assert main_text(f"<div>Top</div><article><h1><a href=t>Title</a></h1><p>{LONG}</p><ul>{links}</ul><p>End.</p><ul>{links}</ul></article><div>{CLOSING}</div>") == f"Title\n{LONG.strip()}\nEnd."
    assert main_text("<article><a href=u><p>All of it a link.</p></a></article>") == "All of it a link."


def test_edges(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "<p>a", 1), (3, "u", "<p>a", 1), (3, "u", "<p>a", 1), (4, "u", "<p>" + "word " * 100_000, 1), (5, "u", "<" * 5000, 1)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in got)[:6] == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, 499_999)] and len(got) == 7
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
