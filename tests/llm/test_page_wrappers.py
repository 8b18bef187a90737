"""Main text under class names that hold words for menus, sidebars, notices and the like: no such name may empty a page.

The truth is marked in the generated pages (data-truth) and read by Python's own parser, which knows nothing of the extractor."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import pytest

pytest.importorskip("strandline.llm")
from strandline.llm import tag_paths

WRAPPERS = ["content-sidebar-wrap", "layout-with-sidebar", "site menu-closed", "wrapper sticky-footer", "post comment-open", "ad-free-page", "nav-offset content", "main-nav-container", "public-notice"]
MORE = ["has-sidebar", "no-ads", "page with-menu", "menu-open", "sidebar-right-layout", "header-wrapper", "cookie-consent-given", "footer-fixed", "modal-open", "related-content", "newsletter-page", "promo", "subscribe-body", "toc-enabled", "banner-top widget", "login-page", "comments-open site", "social-feed", "breadcrumb-nav-page"]
WORDS = "river stone early morning light keeps turning over fields where people walk with quiet steps toward an old market house and talk of weather trade and news".split()


class Truth(HTMLParser):
    """The text of elements with data-truth, one block each."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img"):
            return
        if self.depth or "data-truth" in dict(attrs):
            self.depth += 1
            if self.depth == 1:
                self.blocks.append("")

    def handle_endtag(self, tag):
        self.depth -= self.depth > 0 and tag not in ("br", "img")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def truth(page):
    own = Truth()
    own.feed(page)
    return " ".join(t for b in own.blocks if (t := " ".join(b.split())))


def sentence(r, low=12, high=30):
    words = [r.choice(WORDS) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize().replace(" with ", ", with ") + "."


def page_of(seed):
    """An article under one to three wrappers, with parts around it that are no main text and bear plain names."""
    r = random.Random(seed)
    body = "".join(f"<p data-truth>{' '.join(sentence(r) for _ in range(r.randint(2, 5)))}</p>" for _ in range(r.randint(3, 8)))
    article = f"<{(t := r.choice(['article', 'main', 'div']))}><h1 data-truth>{sentence(r, 4, 7)[:-1]}</h1>{body}"
    if r.random() < 0.5:
        article += f"<div class='{r.choice(['share-buttons', 'social', 'newsletter', 'ad'])}'>{sentence(r, 4, 9)}</div>"
    article += f"</{t}>"
    beside = f"<div class='{r.choice(['sidebar', 'widget', 'related', 'promo'])}'><p>{sentence(r)}</p><p>{sentence(r)}</p></div>" if r.random() < 0.6 else ""
    comments = "<div class=comments>" + "".join(f"<p>{sentence(r)} {sentence(r)}</p>" for _ in range(r.randint(1, 12))) + "</div>" if r.random() < 0.6 else ""
    inner = article + beside + comments if r.random() < 0.7 else beside + article + comments
    for _ in range(r.randint(1, 3)):
        how = r.choice(["class", "id"])
        inner = f"<div {how}='{r.choice(WRAPPERS + MORE)}'>{inner}</div>"
    nav = "<nav>" + "".join(f"<a href='/{i}'>{r.choice(WORDS)}</a> " for i in range(6)) + "</nav>"
    return f"<html><head><title>x</title><style>p {{}}</style></head><body>{nav}{inner}<footer><p>{sentence(r)}</p></footer><script>var a = '<p>no</p>';</script></body></html>"


@pytest.mark.parametrize("name", WRAPPERS + MORE)
@pytest.mark.parametrize("inside", ["<main><p data-truth>{}</p></main>", "<p data-truth>{}</p>", "<article><h1 data-truth>A title</h1><p data-truth>{}</p></article>"])
def test_no_name_empties_a_page(name, inside):
    text = " ".join(sentence(random.Random(i)) for i in range(9))
    for how in ("class", "id"):
        page = f"<html><body><div {how}='{name}'>{inside.format(text)}</div></body></html>"
        assert tag_paths.main_text(page) == truth(page)


def test_generated_pages_under_wrappers():
    pages = [page_of(seed) for seed in range(400)]
    wrong = [seed for seed, page in enumerate(pages) if tag_paths.main_text(page) != truth(page)]
    assert not wrong, (wrong, tag_paths.main_text(pages[wrong[0]]), truth(pages[wrong[0]]), pages[wrong[0]])


@pytest.mark.parametrize("tag", ["nav", "aside", "footer", "dialog", "form", "header"])
def test_parts_by_element_stay_out_beside_an_article(tag):
    r = random.Random(5)
    text = [" ".join(sentence(r) for _ in range(3)) for _ in range(4)]
    beside = f"<body><{tag}><p>{text[0]}</p></{tag}><div><p>{text[1]}</p><p>{text[2]}</p></div></body>"
    assert tag_paths.main_text(beside) == f"{text[1]} {text[2]}"
    alone = tag_paths.main_text(f"<body><{tag}><p>{text[0]}</p><p>{text[3]}</p></{tag}></body>")
    assert alone == (f"{text[0]} {text[3]}" if tag in ("form", "header") else "")
