import random
import re
from html import unescape
from time import perf_counter

from sightline.llm import html_extract

SF = "/root/testdata/sf0.001"


def text(html: str) -> str:
    return html_extract.main_text(html, html_extract.learn())


def test_weights_have_their_signs():
    weights = html_extract.learn()
    assert all((weights[k] > 0) == (k in html_extract.WORDS) for k in weights)


def test_held_out_pages():
    rng = random.Random(2024)
    made = [html_extract.page(rng) for _ in range(500)]
    assert sum(text(html) == want for html, want in made) >= 490


def test_given_pages(spark):
    """The article of the given pages, told by its element, is found by scores alone."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_what_is_no_main_text():
    inner = "<h1>A &lt;title&gt;</h1><p>One&nbsp;two\n three<br>four <b>bo</b>ld.</p><ul><li>x<li>y</ul><table><tr><td>a<td>b</table>"
    want = "A <title>\nOne two three four bold.\nx\ny\na\nb"
    noise = [
        "<nav><a href=/>menu here</a></nav>", "<header><h2>Site of many words for all</h2></header>", "<aside>side words and more words</aside>", "<form><p>Your name please, now</p></form>",
        "<script>if (a<b) document.write('<p>no</p>')</script>", "<style>p{}</style>", "<!-- <p>hidden words</p> -->", '<div class="ad-slot">Buy this now, cheap and good</div>', '<div role="alert">Cookies are used</div>',
        '<section id="comments"><article><p>Reader says a lot of words here and there</p></article></section>', "<footer>&copy; words at the end</footer>", '<div style="display: none">hidden words</div>', "<noscript>Turn it on</noscript>",
    ]
    for x in noise:
        assert text(f"<html><body>{x}<article>{inner}</article>{x}</body></html>") == want, x
        if not x.startswith("<header"):  # an article's own header holds its title
            assert text(f"<html><body><article>{inner}{x}<p>Last words.</p></article></body></html>") == want + "\nLast words.", x


def test_broken_pages():
    assert text("") == "" and text("<html><body></body></html>") == "" and text("plain words") == "plain words"
    assert text("<body><nav>menu <a href=x>y<article><p>Right <i>one") == "Right one"
    assert text("a < b &am and &ampx; 3<4") == "a < b &am and &x; 3<4"
    assert text("<article><script>var x = '<p>'; no end") == ""


def test_time_is_linear():
    for unit in ("<b>", "<b><div></div>", "<a></b>", '<p class="', "</div>", "<div>", "<!--", "<", "<li><b>x", "&amp", "x ", "<script>"):
        began = perf_counter()
        text(unit * 60_000)
        assert perf_counter() - began < 8, unit


def test_odd_rows(spark):
    rows = [(1, None, None, 7), (2, "u", "", 7), (2, "u", "<p>" + "word " * 400_000, 7), (None, "u", "<p>x</p>", 7), (2, "u", "", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r["page_id"], r["n_chars"]) for r in html_extract.extract(pages).collect()), key=str)
    assert got == sorted([(1, 0), (2, 0), (2, 5 * 400_000 - 1), (None, 1), (2, 0)], key=str)
    assert html_extract.extract(pages.where("false")).count() == 0
