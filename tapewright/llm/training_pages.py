"""Pages with known main text, drawn from layouts of many kinds, from which the extraction model learns.

Elements of the article carry data-y="1", the rest data-y="0"; containers of both carry none. Words are random syllables,
so nothing can be learned from the words themselves.
"""

from __future__ import annotations

import random

_SYLLABLES = ("ka", "lo", "mi", "ren", "tu", "sel", "vo", "da", "ni", "par", "ose", "ul", "é", "ß", "gri", "ta", "en", "the", "of")
_MARKS = (".", ".", ".", ",", "!", "?", "&amp;", "***", " |", "")


class Page:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.random
        out = []
        for _ in range(r.randint(low, high)):
            word = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
            out.append(word + (r.choice(_MARKS) if r.random() < 0.15 else ""))
        return " ".join(out).capitalize()

    def tag(self, name: str, inner: str, y: int | None = None, **attributes: str) -> str:
        attributes = {k.strip("_"): v for k, v in attributes.items() if v}
        if y is not None:
            attributes["data-y"] = str(y)
        return f"<{name}{''.join(f' {k}=\"{v}\"' for k, v in attributes.items())}>{inner}</{name}>"

    def link(self, y: int) -> str:
        return self.tag("a", self.words(1, 3), y, href="/" + self.words(1, 1).lower())

    def menu(self) -> str:
        r = self.random
        items = [self.link(0) for _ in range(r.randint(3, 12))]
        body = self.tag("ul", "".join(self.tag("li", i, 0) for i in items), 0) if r.random() < 0.7 else " | ".join(items)
        return self.tag("nav", body, 0) if r.random() < 0.6 else self.tag("div", body, 0, class_=r.choice(("menu", "nav main-nav", "navbar", "breadcrumbs", "site-links", "topbar")))

    def advert(self) -> str:
        r = self.random
        body = self.words(2, 30)
        body = self.tag("p", body, 0) if r.random() < 0.3 else body
        return self.tag(r.choice(("div", "div", "aside", "section", "p")), body, 0, class_=r.choice(("ad", "ads", "advert", "sponsored", "banner-ad", "promo", "ad-slot box")))

    def notice(self) -> str:
        r = self.random
        return self.tag("div", self.tag("p", self.words(5, 40), 0) + self.tag("button", self.words(1, 2), 0), 0, class_=r.choice(("cookie-notice", "cookie-banner", "consent", "notice", "alert", "gdpr popup", "newsletter")))

    def form(self) -> str:
        fields = "".join(self.tag("label", self.words(1, 3), 0) + "<input type=\"text\">" for _ in range(self.random.randint(1, 4)))
        return self.tag("form", fields + self.tag("button", self.words(1, 2), 0), 0, action="/send")

    def comments(self) -> str:
        r = self.random
        each = "".join(
            self.tag("div", self.tag("span", self.words(1, 2), 0, class_="author") + self.tag("p", self.words(4, 60), 0), 0, class_=r.choice(("comment", "reply", "comment-body")))
            for _ in range(r.randint(1, 6)))
        head = self.tag("h3", self.words(1, 3), 0) if r.random() < 0.6 else ""
        return self.tag(r.choice(("section", "div", "ul", "aside")), head + each + (self.form() if r.random() < 0.4 else ""), 0, **{r.choice(("class_", "id")): r.choice(("comments", "comment-list", "reader-comments", "discussion responses"))})

    def sidebar(self) -> str:
        r = self.random
        body = self.tag("h3", self.words(1, 4), 0) + (self.menu() if r.random() < 0.6 else self.tag("p", self.words(5, 60), 0))
        body += self.advert() if r.random() < 0.3 else ""
        return self.tag("aside", body, 0) if r.random() < 0.5 else self.tag("div", body, 0, class_=r.choice(("sidebar", "widget", "related", "rail", "side-column", "share social", "most-read")))

    def header(self) -> str:
        body = self.tag("div", self.words(1, 4), 0, class_=self.random.choice(("logo", "brand", "site-title", ""))) + (self.menu() if self.random.random() < 0.6 else "")
        return self.tag("header", body, 0) if self.random.random() < 0.6 else self.tag("div", body, 0, class_=self.random.choice(("header", "site-header", "masthead")))

    def footer(self) -> str:
        r = self.random
        body = "&copy; " + self.words(1, 15) if r.random() < 0.6 else self.tag("p", "&copy; " + self.words(3, 30), 0) + (self.menu() if r.random() < 0.5 else "")
        return self.tag("footer", body, 0) if r.random() < 0.7 else self.tag("div", body, 0, id=r.choice(("footer", "page-footer", "bottom", "colophon")))

    def block(self) -> str:
        r = self.random
        kind = r.random()
        if kind < 0.66:
            body = self.words(1, 120) if r.random() < 0.9 else self.words(1, 3)
            if r.random() < 0.15:
                body += " " + self.tag(r.choice(("b", "em", "a", "span", "code")), self.words(1, 6), 1) + " " + self.words(1, 30)
            elif r.random() < 0.08:
                body = self.tag("b", body + "<br>", 1)
            return self.tag("p", body, 1)
        if kind < 0.76:
            return self.tag(r.choice(("h2", "h3")), self.words(1, 9), 1)
        if kind < 0.86:
            return self.tag(r.choice(("ul", "ol")), "".join(self.tag("li", self.words(2, 25), 1) for _ in range(r.randint(2, 6))), 1)
        if kind < 0.91:
            return self.tag("blockquote", self.tag("p", self.words(5, 50), 1), 1)
        if kind < 0.94:
            return self.tag("pre", self.words(5, 40), 1)
        if kind < 0.97:
            cell = lambda: self.tag("td", self.words(1, 5), 1)
            return self.tag("table", "".join(self.tag("tr", cell() + cell(), 1) for _ in range(r.randint(2, 5))), 1)
        return self.tag("div", self.words(5, 60), 1)

    def article(self) -> str:
        r = self.random
        blocks = [self.block() for _ in range(r.randint(1, 14))]
        head = self.tag("h1", self.words(2, 12), 1) if r.random() < 0.85 else ""
        extra = [f() for f, chance in ((self.advert, 0.25), (self.sidebar, 0.12), (self.form, 0.08), (self.notice, 0.08), (self.menu, 0.08)) if r.random() < chance]
        tail = [self.comments()] if r.random() < 0.15 else []
        for e in extra:
            blocks.insert(r.randint(0, len(blocks)), e)
        y = None if extra or tail else 1
        if r.random() < 0.2:
            blocks = [self.tag("div", "".join(blocks), None if extra else 1, class_=r.choice(("", "text", "entry-content", "body-copy")))]
        inner = head + "".join(blocks + tail)
        kind = r.random()
        if kind < 0.5:
            return self.tag("article", inner, y)
        if kind < 0.65:
            return self.tag("main", inner, y)
        return self.tag(r.choice(("div", "section", "div")), inner, y, **{r.choice(("class_", "id")): r.choice(("content", "post", "entry", "main-text", "story", "article-body", "col-8", "wrap", "page"))})

    def html(self) -> str:
        r = self.random
        before = [f() for f, chance in ((self.notice, 0.3), (self.header, 0.6), (self.menu, 0.7), (self.advert, 0.5), (self.form, 0.15), (self.sidebar, 0.25)) if r.random() < chance]
        after = [f() for f, chance in ((self.sidebar, 0.4), (self.comments, 0.35), (self.advert, 0.2), (self.form, 0.15), (self.notice, 0.15), (self.footer, 0.8)) if r.random() < chance]
        body = "".join(before) + self.article() + "".join(after)
        if r.random() < 0.3:
            body = self.tag("div", body, None, class_=r.choice(("wrapper", "container", "page", "")))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{body}</body></html>"


def pages(count: int, seed: int) -> list[str]:
    return [Page(seed * 100_003 + i).html() for i in range(count)]
