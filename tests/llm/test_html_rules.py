"""The two-pass block rules decide on all pages; odd markup keeps its text."""

import random
from html.parser import HTMLParser

import pytest

from docloom.llm import html_extract as H

PROSE = "This is the first of the two stories that we have for you, and it is as long as a paragraph has to be."
LIST = " | ".join(f"Keyword{k} Product{k}" for k in range(20))
LINKS = "".join(f"<div><a href=/{k}>Section {k}</a></div>" for k in range(3))


def by_hand(blocks):
    """Every block against every other, straight from the rules."""
    said = []
    for b in blocks:
        words = [w for w in H._WORD.findall(b.text.lower())]
        stops = len([w for w in words if w in H.STOP_WORDS]) / max(1, len(words))
        n = len(b.text)
        if b.linked / n > H.LINKS_MOST:
            said.append(0 if b.main and b.heading else -4)
        elif n >= 70 and (stops >= 0.2 or (n >= 200 and stops >= 0.12)):
            said.append(2)
        else:
            said.append(-1 if n >= 200 and stops < 0.12 else 0)
    size = lambda main: sum(len(b.text) for b, x in zip(blocks, said) if x == 2 and b.main == main and b.against < 2)
    declared = any(b.main and b.against < 2 for b in blocks) and 3 * size(True) >= size(True) + size(False)
    out = []
    for b, x in zip(blocks, said):
        total = x + (0, -3, -9)[b.against] + ((2 if b.main else -4) if declared and b.against < 2 else 0)
        out.append("good" if total >= 2 else "bad" if total <= -2 else "?")
    open_ = [k for k, b in enumerate(blocks) if b.against < 2]
    final = list(out)
    for i, k in enumerate(open_):
        if out[k] != "?":
            continue
        others = [(abs(i - j), out[m]) for j, m in enumerate(open_) if out[m] != "?"]
        if not any(label == "good" for _, label in others):
            final[k] = "good"
            continue
        least = min(d for d, _ in others)
        near = {label for d, label in others if d == least}
        final[k] = near.pop() if len(near) == 1 else "bad" if said[k] < 0 else "good"
    return final


def test_decide_matches_brute_force():
    rng = random.Random(8)
    texts = [PROSE, LIST, "Short.", "Just the one", PROSE + " " + LIST, LIST[:90], PROSE[:71]]
    for _ in range(1500):
        blocks = []
        for _ in range(rng.randint(1, 12)):
            t = rng.choice(texts)
            blocks.append(H.Block(t, rng.choice([0, 0, 0, len(t) // 5, len(t)]), rng.choice([0, 0, 0, 0, 0, 1, 2]), rng.random() < rng.choice([0.1, 0.8]), rng.random() < 0.2))
        want = by_hand(blocks)
        H.decide(blocks)
        assert [b.label for b in blocks] == want


def test_an_article_need_not_be_declared(spark, sf):
    """Renamed to plain divisions, articles lose under one in a hundred blocks."""
    lost = total = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        whole = H.extract(r.html).split("\n\n")
        plain = H.extract(r.html.replace("<article", "<div").replace("</article", "</div")).split("\n\n")
        total += len(whole)
        lost += len(set(whole) ^ set(plain))
    assert lost < 0.01 * total


PAGE = f"<body>{LINKS}<div>{LIST}</div>{LINKS}<div>Title</div><div>{PROSE}</div><div>{PROSE}</div></body>"


def test_stop_words_and_links_decide(monkeypatch):
    want = f"Title\n\n{PROSE}\n\n{PROSE}"
    assert H.extract(PAGE) == want
    with monkeypatch.context() as m:
        m.setattr(H, "STOP_WORDS", frozenset())
        assert H.extract(PAGE) != want
    with monkeypatch.context() as m:
        m.setattr(H, "LINKS_MOST", 2.0)
        assert H.extract(PAGE) != want
    with monkeypatch.context() as m:
        m.setattr(H, "LENGTH_LOW", 10_000)
        assert H.extract(PAGE) != want


def test_a_teaser_card_is_no_article():
    page = f"<article>Card</article><article>Other card</article><div>{PROSE}</div><div>{PROSE}</div>"
    assert H.extract(page).endswith(f"{PROSE}\n\n{PROSE}")


@pytest.mark.parametrize(
    "inside, text",
    [
        ("<p>x <math><mi>a</mi><mo>+</mo><mi>b</mi></math> y</p>", "x a+b y"),
        ("<p>one <canvas>two</canvas> <object>three</object></p>", "one two three"),
        ("<button>Go<p>one<p>two", "Go\n\none\n\ntwo"),
        ("<svg><path d=''><p>one", "one"),
        ("<select><option>a</option></select><p>one", "one"),
        ('<section id="related-work"><p>one</p></section><section id="discussion">two</section><p class="response-time">three', "one\n\ntwo\n\nthree"),
        ('<div class="comments"><p>Nice</p></div><section class="comment-list">Me too</section><div class="discussion">And me</div><p>one', "one"),
        ("<p>one <a title=it's href=/x>two</a> three and four and five", "one two three and four and five"),
        ('<p>one <a title="a>b" href=/x>two</a> three and four and five', "one two three and four and five"),
        ("<p>one<script>var x = '<p>'", "one"),
    ],
)
def test_odd_markup_inside_an_article(inside, text):
    assert H.extract(f"<article><p>{PROSE}</p>{inside}</article>") == f"{PROSE}\n\n{text}"


def test_empty_table_and_long_pages(spark):
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    n = 20_000
    long = "<nav>" + "<a href=/>x</a>" * n + "</nav><article>" + f"<p>{PROSE}</p>" * n + "<button>" * n + "</article>"
    assert H.extract(long) == "\n\n".join([PROSE] * n)


class Plain(HTMLParser):
    """Blocks of the article element, by the standard library's parser."""

    BREAKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "div", "article", "table", "tr", "td", "th", "blockquote", "pre", "section", "figure", "figcaption", "dl", "dt", "dd"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.inside, self.skip = [], "", 0, 0
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join(self.now.split())
        self.blocks += [text] if text else []
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.flush()
        self.inside += tag == "article"
        self.skip += tag in ("script", "style")
        self.now += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.flush()
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside > 0 and not self.skip:
            self.now += data


def test_extraction_against_another_parser(spark, sf):
    """Whole pages: the article's blocks, whatever their words, and nothing else."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in H.main_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    named = [r for r in rows if r.html and "<article" in r.html and "</article>" in r.html]
    assert len(named) > 0.5 * len(rows)
    for r in named:
        want = "\n\n".join(Plain(r.html).blocks)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


@pytest.mark.parametrize(
    "page",
    [
        f'<article><p class="text hidden md:block">{PROSE}</p><p>{PROSE}</p></article>',
        f'<div class="content privacy-policy"><p>{PROSE}</p><p>{PROSE}</p></div>',
        f'<div class="post"><p>{PROSE}</p><div class="recommended-reading-notes"><p>{PROSE}</p></div></div>',
        f'<div class="sidebar"><p>{PROSE}</p><p>{PROSE}</p></div>',
        f"<form id=aspnetForm><nav>{LINKS}</nav><p>{PROSE}</p><p>{PROSE}</p></form>",
    ],
)
def test_names_do_not_take_prose_that_is_all_there_is(page):
    assert H.extract(page) == f"{PROSE}\n\n{PROSE}"


@pytest.mark.parametrize("tag", ["div hidden", "div style='color: red; display:none'", "div aria-hidden=true", "div class='comment-list'", "div class=privacy", "div id='cookie-notice'", "footer", "div class=site-footer"])
def test_what_is_no_article_goes_though_it_is_prose(tag):
    assert H.extract(f"<div><p>{PROSE}</p></div><{tag}><p>{PROSE}</p></{tag.split()[0]}>") == PROSE


def test_weak_names_without_prose_go():
    assert H.extract(f'<div><p>{PROSE}</p></div><div class="related-posts"><p>See more</p></div><div class="search-box">Find</div>') == PROSE
