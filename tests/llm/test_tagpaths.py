"""Tag-path ratios: the choice of paths recomputed by hand, and pages that names alone would spoil."""

import pytest

from shelfwise.llm import tagpaths

LONG = "A sentence of some length, with a comma, that goes on for a while. Another one follows it here."


def page(body):
    return f"<html><body>{body}</body></html>"


@pytest.mark.parametrize("body, want", [
    # words of a link inside a sentence stay; a block that is only a link goes
    (f'<nav><a href=x>Menu</a></nav><p>{LONG}</p><p>{LONG} See <a href="/r">this report</a> for details.</p><p><a href=y>Read on</a></p>',
     f"{LONG}\n{LONG} See this report for details."),
    # a word of boilerplate inside the name of what holds the article
    (f'<div class="layout has-sidebar"><p>{LONG}</p><div class="sidebar"><p>Popular, now.</p></div></div>', LONG),
    (f'<article class="post category-legal"><h1>Title</h1><p>{LONG}</p></article><footer><p>{LONG}</p></footer>', f"Title\n{LONG}"),
    (f'<main class="share-page"><div class="x-share"><p>Share this, now.</p></div><p>{LONG}</p><p>{LONG}</p></main>', f"{LONG}\n{LONG}"),
    # a header inside the article is not the page's
    (f"<header><p>The site, its name.</p></header><article><header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title\n{LONG}"),
    # long comments stay out, whatever their length
    (f'<p>{LONG}</p><div id="comments-list"><p>{LONG * 6}</p><p>{LONG * 6}</p></div>', LONG),
    (f'<p>{LONG}</p><p hidden>{LONG}</p><form><p>{LONG}</p></form><div role="navigation">{LONG}</div>', LONG),
])
def test_names_only_lower_a_ratio(body, want):
    assert tagpaths.main_text(page(body)) == want


def test_ratios_by_hand():
    """Two paragraphs, a list of links and a footer: every number from its definition."""
    body = f"<div><p>{LONG}</p><p>Short.</p><ul><li><a href=x>One link</a></li></ul></div><footer>Made, by us.</footer>"
    found = tagpaths.Page(page(body))
    n, marks = (len(LONG) + len("Short.")) / 2, (LONG.count(",") + LONG.count(".") + 1) / 2
    prose = (n * (1 + marks)) ** 0.5
    links = tagpaths.LINKED * len("One link") ** 0.5
    foot = tagpaths.LOWERED * (len("Made, by us.") * (1 + 2)) ** 0.5
    div = "/html/body/div"
    fused = {
        f"{div}/p": prose,
        f"{div}/ul/li/a": 0.5 * links + 0.5 * tagpaths.LINKED * links,  # below a block of its own
        "/html/body/footer": 0.5 * foot + 0.5 * tagpaths.LOWERED * foot,
    }
    for share in (0.9, 0.2, links / prose / 3, foot / prose / 3):
        want = {p for p, v in fused.items() if v >= share * prose}
        assert tagpaths.content_paths(found, share) == want
    assert tagpaths.content_paths(found, 0.0) == set(fused)


def test_names_are_in_the_path():
    body = f'<div class="b  a" id=c><p role=note>{LONG} <b>bold</b> <span class="ad">advert</span></p></div>'
    paths = {p for _, p, _, _ in tagpaths.Page(page(body)).nodes}
    assert paths == {"/html/body/div.b a.c/p.note", "/html/body/div.b a.c/p.note/span.ad"}
    assert tagpaths.main_text(page(body)) == f"{LONG} bold"


@pytest.mark.parametrize("source", ["<", "<p", "<p class='x", "</p></div>", "<p>" * 3000 + "deep", "<div><p>a<div>b", "&#xZZ; &amp &",
                                    "<p class=\"a'b>text</p>", "<!-- never ends", "<script>x", "<a href=x>only a link</a>"])
def test_broken_pages(source):
    assert isinstance(tagpaths.main_text(source), str)
