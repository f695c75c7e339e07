"""Main text of generated pages: names decide together with form only."""

import random
import time

import pytest

from tidemark.llm.html_text import extract

FIRST, LAST = "First paragraph, with text, of the article itself.", "Last paragraph, with more, of the article."
PROSE = "A passage of the article, with commas, that says something."
KEPT = {
    "h2.section-header": PROSE, "h2.chapter-head": PROSE, "p.share-price": PROSE, "p.search-intro": PROSE, "p.sponsored-by": PROSE,
    "p.alert-level": PROSE, "section.legal-background": f"<p>{PROSE}</p>", "div.side-by-side": f"<p>{PROSE}</p>",
    "div.comment-from-the-author": f"<p>{PROSE}</p>", "div.tags-explained": f"<p>{PROSE}</p>", "ul.feedback-summary": f"<li>{PROSE}</li>",
}
CUT = {
    "div.share-buttons": "<p>Tell, your, friends, about, this page, please.</p>", "p.notice": PROSE, "div.ad-slot-1": f"<p>{PROSE}</p>",
    "ul.share-elsewhere": "<li><a href=1>One network</a></li><li><a href=2>Another network</a></li>",
    "div.newsletter-for-you": "<p>Get, the, letter, every, week.</p><form><input name=mail></form>", "div.related_posts": f"<p>{PROSE}</p>",
}


def article(inside):
    return f"<body><nav>Menu</nav><main><article><h1>Title</h1><p>{FIRST}</p>{inside}<p>{LAST}</p></article></main>"


def element(name, inside):
    tag, names = name.split(".")
    return f"<{tag} class='{names}'>{inside}</{tag}>"


@pytest.mark.parametrize("name", KEPT)
def test_a_word_in_a_longer_name_cuts_nothing(name):
    assert extract(article(element(name, KEPT[name]))) == "\n\n".join(["Title", FIRST, PROSE, LAST])


@pytest.mark.parametrize("name", CUT)
def test_names_of_what_is_no_article_and_form_cut(name):
    assert extract(article(element(name, CUT[name]))) == "\n\n".join(["Title", FIRST, LAST])


def test_short_sections_beside_a_long_one_stay():
    sentence = "This is a sentence, of a section, that is to stay."
    parts = [f"<div><h2>Head {i}</h2><p>{' '.join([sentence] * (40 if i == 0 else 1))}</p></div>" for i in range(6)]
    want = [x for i in range(6) for x in (f"Head {i}", " ".join([sentence] * (40 if i == 0 else 1)))]
    assert extract("<div id=wrap>" + "".join(parts) + "</div>") == "\n\n".join(want)


def test_commas_of_all_scripts_give_equal_points():
    for comma in ",，、،":
        page = f"<div><div id=a><p>{('word' + comma + ' ') * 8}end of it</p></div><div id=b><a href=1>Some links and more</a></div></div>"
        assert extract(page).startswith("word") and "links" not in extract(page)


@pytest.mark.parametrize("seed", range(60))
def test_generated_pages(seed):
    """An article with random names of several words, between parts that form or tag tells apart."""
    draw = random.Random(seed)
    words = "river stone window market letter garden morning winter paper harbour bridge valley".split()
    names = "share search legal side alert head header comment tags feedback sponsored social notice related recommended".split()

    def sentence():
        return (" ".join(draw.choices(words, k=draw.randint(6, 14))) + ", " + " ".join(draw.choices(words, k=5)) + ".").capitalize()

    def name():
        return f"{draw.choice(names)}-{draw.choice(words)}"

    want, inside = [], []
    for _ in range(draw.randint(2, 9)):
        text = " ".join(sentence() for _ in range(draw.randint(1, 6)))
        want.append(text)
        inside.append(draw.choice(["<p>{0}</p>", "<p class='{1}'>{0}</p>", "<div class='{1}'><p>{0}</p></div>", "<section id='{1}'><p>{0}</p></section>"]).format(text, name()))
        if draw.random() < 0.3:
            inside.append(draw.choice(["<div class=ad><p>{0}</p></div>", "<script>{0}</script>", "<aside><p>{0}</p></aside>"]).format(sentence()))
    before = draw.choice(["<nav><ul><li><a href=1>Home</a></ul></nav>", "<div class='site-header'><p>{0}</p></div>", "<header><p>{0}</p></header>"])
    after = draw.choice(["<footer><p>{0}</p></footer>", "<div class=comments><p>{0}</p></div>", "<form><p>{0}</p><input></form>", "<div id=sidebar><p>{0}</p></div>"])
    around = draw.choice(["<article>{0}</article>", "<main>{0}</main>", "<div class=content>{0}</div>", "<div id='main'><article class='{1}'>{0}</article></div>"])
    body = around.format("".join(inside), name())
    assert extract(f"<body>{before.format(sentence())}{body}{after.format(sentence())}</body>") == "\n\n".join(want)


@pytest.mark.parametrize("page", ["<b>{n}</i>{n}", "<form></form>{n}", "<i><div><b>{n}</i>{n}", "<div><header>{n}", "<div><p>{n}"])
def test_time_grows_with_the_page(page):
    def seconds(n):
        parts = [p for p in page.split("{n}") if p]
        began = time.process_time()
        extract("".join(p * n for p in parts))
        return time.process_time() - began

    seconds(100)
    assert seconds(16_000) < 12 * seconds(4_000) + 0.2
