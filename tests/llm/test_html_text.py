import html
import re

import pytest

from lodestone.llm import html_text
from lodestone.llm.html_text import extract, main_text, op7_html

LONG = "It was a bright cold day, and the clocks were striking; nobody looked up, of course. " * 3


def expected(page):
    """For the tables' own template only: what stands in the article, cut at its block tags."""
    body = page.split("<article>", 1)[1].split("</article>")[0]
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", body)]
    return "\n".join(b for b in blocks if b)


def test_query(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = op7_html(spark, sf_dir).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.text == expected(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("just words", "just words"),
        (f"<body><nav>Home</nav><main><h1>T &amp; U</h1><p>{LONG}<p>End.</main><footer>f</footer>", f"T & U\n{LONG.strip()}\nEnd."),
        (f"<article><header><h1>T</h1></header><p>a<b>b</b>\n c&nbsp;d<br>e</p><aside>x</aside><div class='ad-box'>buy</div><form>q<input></form><section id=comments><p>{LONG}</p></section></article>", "T\nab c d e"),
        (f"<div class=top><a href=1>one</a> <a href=2>two</a></div><div id=x><h2>Head</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div><a href=3>more</a></div>", f"Head\n{LONG.strip()}\nYes.\n{LONG.strip()}"),
        ("<article><p>1 < 2 &lt;b&gt; <!-- no > --> <script>if (a<b) '</p>'</script>3</article>", "1 < 2 <b> 3"),
        (f'<article><p title="a>b">{LONG}</p><p title="open>{LONG}</p></article>', None),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one\ntwo\na\nb\nc"),
        ("<article><p>cut off <b", "cut off"),
        (f"<div role=alert>We use cookies, really.</div><div class='cookie-notice'>{LONG}</div><article><p>Short.</p></article>", "Short."),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text or text is None


def test_ratios_decide(spark, sf_dir, monkeypatch):
    """Other scores choose other nodes, with and without an article; the same ones don't."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    pages += [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    before = [main_text(p) for p in pages]
    score = html_text.path_scores
    monkeypatch.setattr(html_text, "path_scores", lambda blocks: [1 / x for x in score(blocks)])
    assert sum(main_text(p) != t for p, t in zip(pages, before, strict=True)) > 0.9 * len(pages)


def test_pages_without_articles(spark, sf_dir):
    """The tables' template with a plain div for the article: the same texts."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    found = [(main_text(p.replace("<article>", "<div>").replace("</article>", "</div>")), expected(p)) for p in pages]
    assert [a for a, _ in found] == [b for _, b in found]


def test_ratios_alone(spark, sf_dir, monkeypatch):
    """The template without articles and names: the ratios find most texts and lose nothing; constants in their place find none."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    bare = [re.sub(' class="[^"]*"', "", p).replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    texts = [expected(p) for p in pages]
    found = [main_text(p) for p in bare]
    assert sum(a == b for a, b in zip(found, texts, strict=True)) >= 0.85 * len(pages)
    # what is too much is the advert in front; an article that is shorter than the advert isn't found without names
    assert all(a.endswith(b) for a, b in zip(found, texts, strict=True) if len(b) > 100)
    monkeypatch.setattr(html_text, "path_scores", lambda blocks: [1.0 for _ in blocks])
    assert not any(main_text(p) == t for p, t in zip(bare, texts, strict=True))


def test_many_short_blocks_do_not_hide_the_text():
    """A menu of a thousand plain lines around two paragraphs: the paragraphs alone."""
    menu = "<div>" + "".join(f"<p class=m>entry {i}</p>" for i in range(500)) + "</div>"
    assert main_text(f"<body>{menu}<div class=x><h2>Head</h2>{_LONG}<p>Yes.</p>{_LONG}</div>{menu}</body>").split("\n")[:1] == ["Head"]
    assert main_text(f"<body>{menu}<div class=x><h2>Head</h2>{_LONG}<p>Yes.</p>{_LONG}</div>{menu}</body>").count("entry") == 0


def test_lone_paragraph_keeps_its_heading():
    assert main_text(f"<body><div>see also</div><div><h1>A title that is of some length</h1>{_LONG}</div></body>").startswith("A title that is of some length\nA long")


def test_names_are_evidence_only():
    story = f"<p class='share price'>{LONG}</p><section id='menu-planning'><h2>Plan</h2><p>{LONG}</p></section>"
    whole = f"{LONG.strip()}\nPlan\n{LONG.strip()}"
    assert main_text(f"<article>{story}<div class='comment-list'>{LONG}</div></article>") == whole
    assert main_text(f"<body class='cookies-law'><article>{story}</article></body>") == whole
    assert main_text(f"<div>{'<div>' * 600}<nav>a menu</nav><p>{LONG}</p>") == LONG.strip()
    assert extract is not None and main_text(f"<nav>x</nav>{'<b>' * 600}{LONG}<nav>y</nav>") == LONG.strip()


def test_odd_rows(spark):
    rows = [(1, "u", "<p>a b</p>", 1), (1, "u", "<p>a b</p>", 1), (None, None, None, None), (2, "u", "<div>" * 3000 + "deep", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    found = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract(df, "html", ["page_id", "url"]).collect())
    assert found == [(0, "", "", 0), (1, "u", "a b", 3), (1, "u", "a b", 3), (2, "u", "deep", 4)]
    assert extract(df.limit(0), "html", ["page_id"]).count() == 0
    clash = df.withColumnsRenamed({"url": "text", "page_id": "_markup"})
    assert extract(clash, "html", ["_markup", "text", "n_chars"]).columns == ["_markup", "text", "n_chars"] and extract(clash, "html", ["_markup", "text"]).count() == 4


_LONG = "<p>" + "A long paragraph, with commas, and so on. " * 7 + "</p>"


@pytest.mark.parametrize(("inner", "lines"), [
    ("<ul><li>Eggs</li><li>Milk</li></ul>", ["Eggs", "Milk"]), ("<p class=lead>Short line</p>", ["Short line"]), ("<pre>x = 1 y = 2</pre>", ["x = 1 y = 2"]), ("<p class=byline>By Someone</p>", ["By Someone"]),
    ("<table><tr><td>1</td><td>2</td></tr></table>", ["1", "2"]), ("<p><a href=x>A linked sentence.</a></p>", ["A linked sentence."]), ("<ol><li><a href=x>One</a></li></ol>", ["One"]),
])
def test_short_blocks_of_an_article_stay(inner, lines):
    text = html_text.main_text(f"<body><nav><a>menu</a></nav><article>{_LONG}{inner}{_LONG}</article><footer>foot</footer></body>").split("\n")
    assert text[1:-1] == lines and len(text) == len(lines) + 2


@pytest.mark.parametrize("page", [
    "<article>{a}<article class='comment'>{b}</article></article>", "<article>{a}<section><article>{b}</article><article>{b}</article></section></article>", "<article>{a}<div class='ad'>{b}</div></article>",
    "<main><div>{a}</div><article class='reply'>{b}</article></main>", "<main><div>{a}</div><div class='kommentare'>{b}</div></main>", "<article>{a}</article><article class=comment>{b}</article>",
])
def test_comments_go(page):
    text = html_text.main_text("<body>" + page.format(a=_LONG + _LONG, b=_LONG.replace("long", "foreign")) + "</body>")
    assert text.count("long") == 14 and "foreign" not in text


def test_last_short_paragraph_without_an_article():
    assert html_text.main_text(f"<body><div>{_LONG}{_LONG}<p>Closing words, in brief.</p></div></body>").endswith("\nClosing words, in brief.")


def test_names_around_everything_say_nothing():
    assert html_text.main_text(f"<body><div class='modal'><article>{_LONG}{_LONG}</article></div></body>").count("long") == 14
