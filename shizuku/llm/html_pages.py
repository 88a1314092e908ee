"""Labelled pages: fragments of markup that belong to the main text or don't, in many arrangements; html_main learns its weights from them."""

from __future__ import annotations

_WORDS = "the river gauge at the upper bridge was read twice a day through the wet season and its record is kept with the notes of the observers who walked the bank".split()

# Names that pages of common use give to parts outside and inside of their main text, in classes and ids.
OUTSIDE = [
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "widgets",
    "related", "recommended", "recommendations", "share", "sharing", "social", "footer", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "form", "search", "login",
    "pagination", "pager", "toolbar", "skip", "copyright", "disclaimer", "hidden", "header", "masthead", "topbar",
]
COMPOUND = [
    "related-posts", "share-buttons", "cookie-notice", "comment-list", "site-header", "site-footer", "ad-banner", "main-menu", "newsletter-box", "social-links", "search-form", "sidebar-widget", "page-footer",
    "sponsored-links", "recommended-stories", "comments-area", "nav-links", "consent-dialog", "login-form", "promo-box", "ad-container", "menu-items", "alert-bar", "reply-form",
]
INSIDE = ["content", "post", "entry", "story", "article", "main", "text", "post-content", "entry-content", "article-body", "story-body", "main-content", "page-content"]
#: Elements that stand for a part outside, and roles.
ASIDE_TAGS = ["nav", "aside", "footer", "form", "menu", "header", "button", "dialog", "fieldset"]
ASIDE_ROLES = ["navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog"]


def _say(k: int, n: int) -> str:
    """n words that differ with k, so that each labelled text is found once in its page."""
    return " ".join(f"{_WORDS[(k * 7 + i) % len(_WORDS)]}{k}" for i in range(n))


class _Page:
    """A page in the making, with the texts of its main part."""

    def __init__(self, number: int):
        self.next, self.wanted, self.parts = number * 1000, set(), []

    def say(self, n: int, main: bool = False) -> str:
        self.next += 1
        text = _say(self.next, n)
        if main:
            self.wanted.add(text)
        return text

    def add(self, *parts: str) -> None:
        self.parts += parts

    def outside(self, tag: str, attributes: str) -> str:
        links = "".join(f'<li><a href="/{i}">{self.say(1)}</a></li>' for i in range(4))
        return f"<{tag}{attributes}><h3>{self.say(2)}</h3><p>{self.say(12)}</p><ul>{links}</ul><div>{self.say(9)}</div></{tag}>"

    def body(self) -> str:
        m = lambda n: self.say(n, True)
        rows = "".join(f"<tr><td>{m(1)}</td><td>{m(2)}</td></tr>" for _ in range(4))
        links = "".join(f'<li><a href="/{i}">{m(2)}</a></li>' for i in range(3))
        plain = lambda i: f' {("class", "id")[i % 2]}="{_WORDS[(self.next + i) % len(_WORDS)]}-{_WORDS[(self.next + 3 * i) % len(_WORDS)]}"' if i % 3 else ""
        deep = "".join(f"<section{plain(i)}><h3>{m(3)}</h3><div{plain(i + 1)}><p>{m(17)}</p><div>{m(11)}</div><ul><li>{m(6)}</li><li><p>{m(8)}</p></li></ul></div></section>" for i in range(6))
        named = "".join(f'<section id="{x}-{_WORDS[(self.next + i) % len(_WORDS)]}"><p>{m(9)}</p><div>{m(7)}</div></section>' for i, x in enumerate((OUTSIDE + COMPOUND)[self.next % 7 :: 17]))
        return (
            f"{deep}{named}<div><div><ul><li><p>{m(5)}</p></li><li>{m(6)}</li></ul></div></div><h1>{m(7)}</h1><p>{m(18)}</p><p><b>{m(27)}</b><p>{m(36)} <a href='/x'>{m(3)}</a> <em>{m(2)}</em></p><h2>{m(4)}</h2><section><h3>{m(3)}</h3><p>{m(24)}</p></section>"
            f"<ul>{links}</ul><ol><li>{m(9)}</li></ol><table><tr><th>{m(1)}</th></tr>{rows}</table><figure><img src=x><figcaption>{m(6)}</figcaption></figure>"
            f"<blockquote>{m(14)}</blockquote><pre><code>{m(8)}</code></pre><dl><dt>{m(1)}</dt><dd>{m(7)}</dd></dl><div>{m(21)}</div>"
        )


def _build(number: int) -> tuple[str, set[str]]:
    page = _Page(number)
    names = OUTSIDE + COMPOUND
    name = lambda i: names[(number * 5 + i) % len(names)]
    aside = lambda i: ASIDE_TAGS[(number + i) % len(ASIDE_TAGS)]
    page.add(f"<html><head><title>{page.say(5)}</title><script>var a='{page.say(3)}';</script></head><body>" + ('<div id="wrap"><div>' if number % 2 else ""))
    page.add(page.outside(aside(0), ""), page.outside("div", f' class="{name(0)}"'), page.outside("div", f' role="{ASIDE_ROLES[number % len(ASIDE_ROLES)]}"'))
    inner = page.body()
    if aside(1) == "header":
        inner = f"<header><p>{page.say(8, True)}</p></header>" + inner
    else:  # parts of the page's frame that stand within its article
        inner += page.outside(aside(1), "")
    inner += page.outside("div", f' class="{name(5)}"') + page.outside("section", f' id="{name(6)}"') + f"<p>{page.say(16, True)}</p>"
    wrap = number % 4
    if wrap == 0:
        page.add(f"<article>{inner}</article>")
    elif wrap == 1:
        page.add(f"<main>{inner}</main>")
    elif wrap == 2:
        page.add(f'<div class="{INSIDE[number % len(INSIDE)]}">{inner}</div>')
    else:
        page.add(inner)
    page.add(page.outside("section", f' id="{name(1)}"'), page.outside("div", f' class="{name(2)}"'), page.outside(aside(2), f' id="{name(3)}"'), page.outside("div", f' class="{name(4)}"'))
    page.add(f"<footer>&copy; {page.say(9)}</footer>")
    return "".join(page.parts) + ("</div></div>" if number % 2 else "") + ("</body></html>" if number % 5 else ""), page.wanted


LABELLED = [_build(k) for k in range(86)]
