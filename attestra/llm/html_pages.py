"""Labelled pages from which the content model is trained: made here, from a seed, of common page parts.

Every element carries its label in ``data-y``; the parser reads it and the features don't.
"""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu la me ni ro su ta ve wi xo zu an er in ou st tr al en ti re on is de la co ma".split()
CONTENT_NAMES = ["article", "content", "post", "entry", "story", "main", "article-body", "post-content", "entry-content", "main-text", "text", "story_body"]
PARTS = {
    "nav": ["nav", "menu", "navbar", "navigation", "top-menu", "breadcrumb", "breadcrumbs", "pagination", "toc"],
    "header": ["header", "masthead", "site-header", "topbar", "branding", "logo"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom", "colophon"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "right-col"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor", "adbox"],
    "notice": ["cookie", "cookie-notice", "consent", "notice", "gdpr", "popup", "modal", "alert", "disclaimer", "overlay"],
    "form": ["newsletter", "subscribe", "signup", "login", "search", "contact-form"],
    "comments": ["comments", "comment-list", "comment", "discussion", "replies", "reviews", "disqus"],
    "share": ["share", "social", "sharing", "follow-us", "tags", "author-box", "byline", "meta"],
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.block, self.block_name = "p", ""  # how the page at hand marks paragraphs

    def words(self, low: int, high: int, end: str = "") -> str:
        r = self.r
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        out[0] = out[0].capitalize()
        return " ".join(w + ("," if r.random() < 0.08 and i < len(out) - 1 else "") for i, w in enumerate(out)) + end

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18, self.r.choice([".", ".", ".", "?", "!"])) for _ in range(self.r.randint(low, high)))

    def element(self, tag: str, label: int, inner: str, name: str = "") -> str:
        named = f' {self.r.choice(["class", "class", "id"])}="{name}"' if name else ""
        return f'<{tag}{named} data-y="{label}">{inner}</{tag}>'

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(low, high)}</a>'

    def links(self, label: int, tag: str = "ul") -> str:
        return self.element(tag, label, "".join(self.element("li", label, self.link()) for _ in range(self.r.randint(2, 9))))

    def paragraph(self, label: int, low: int = 1, high: int = 6) -> str:
        text = self.sentences(low, high)
        if self.r.random() < 0.25:
            text += " " + self.link() + " " + self.sentences(1, 2)
        if self.r.random() < 0.2:
            text = f"<b>{self.words(1, 4)}</b> " + text
        if self.r.random() < 0.1:
            text = text.replace(". ", ".<br>", 1)
        return self.element(self.block if label else "p", label, text, self.block_name if label else "")

    def body(self) -> str:
        """Parts of an article, most of them paragraphs."""
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(self.element(r.choice(["h1", "h1", "h2"]), 1, self.words(2, 12)))
        for _ in range(r.choice([1, 2, 4, 7, 12])):
            kind = r.random()
            if kind < 0.72:
                out.append(self.paragraph(1, *r.choice([(1, 6), (1, 6), (1, 6), (1, 2), (15, 60)])))
            elif kind < 0.79:
                out.append(self.element("p", 1, self.words(1, 4, r.choice(["", "."]))))
            elif kind < 0.85:
                out.append(self.element(r.choice(["h2", "h3"]), 1, self.words(1, 8)))
            elif kind < 0.9:
                out.append(self.element(r.choice(["ul", "ol"]), 1, "".join(self.element("li", 1, self.sentences(1, 2)) for _ in range(r.randint(2, 6)))))
            elif kind < 0.93:
                out.append(self.element("blockquote", 1, self.paragraph(1)))
            elif kind < 0.95:
                out.append(self.element("pre", 1, self.words(4, 20)))
            elif kind < 0.97:
                rows = "".join(self.element("tr", 1, "".join(self.element("td", 1, self.words(1, 4)) for _ in range(3))) for _ in range(r.randint(2, 4)))
                out.append(self.element("table", 1, rows))
            else:
                out.append(self.element("figure", 1, '<img src="x.png">' + self.element("figcaption", 1, self.sentences(1, 1))))
            if r.random() < 0.08:
                out.append(self.part(r.choice(["ad", "form", "share", "notice", "aside"])))
        if r.random() < 0.15:
            at = r.randint(0, len(out))
            out[at:at] = [self.element(r.choice(["div", "section"]), 1, "".join(self.paragraph(1) for _ in range(r.randint(1, 4))))]
        return "".join(out)

    def part(self, kind: str) -> str:
        """A part that is not content."""
        r = self.r
        name = r.choice(PARTS[kind])
        if kind == "nav":
            return self.element(r.choice(["nav", "nav", "div"]), 0, self.links(0), name if r.random() < 0.6 else "") if r.random() < 0.8 else self.element("nav", 0, " ".join(self.link() for _ in range(5)))
        if kind == "header":
            inner = r.choice([self.element("div", 0, self.link(), "logo"), self.element(r.choice(["h1", "h2", "p"]), 0, self.words(1, 4))]) + (self.part("nav") if r.random() < 0.5 else "")
            return self.element("header" if r.random() < 0.7 else "div", 0, inner, name)
        if kind == "footer":
            inner = r.choice([f"&copy; {self.words(1, 5)} &middot; {self.words(1, 8)}", self.paragraph(0, 1, 2), self.links(0), self.element("p", 0, f"&copy; 20{r.randint(10, 29)} {self.words(2, 6)}")])
            return self.element("footer" if r.random() < 0.75 else "div", 0, inner, name if r.random() < 0.6 else "") if r.random() < 0.8 else self.element("footer", 0, inner)
        if kind == "aside":
            inner = r.choice([self.element("h3", 0, self.words(1, 4)) + self.links(0), self.paragraph(0, 1, 3), "".join(self.element("div", 0, self.link(3, 9)) for _ in range(4))])
            tag = r.choice(["aside", "aside", "div", "section"])
            return self.element(tag, 0, inner, "" if tag == "aside" and r.random() < 0.5 else name)
        if kind == "ad":
            return self.element(r.choice(["div", "div", "section", "aside"]), 0, r.choice([self.words(2, 12, "."), self.link(2, 6), self.paragraph(0, 1, 3), self.element("p", 0, self.words(3, 12, "!"))]), name)
        if kind == "notice":
            inner = r.choice([self.sentences(1, 3), self.paragraph(0, 1, 3)]) + (f"<button>{self.words(1, 2)}</button>" if r.random() < 0.6 else "")
            return self.element(r.choice(["div", "section", "dialog"]), 0, inner, name)
        if kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input type='text'><button>{self.words(1, 2)}</button>" + (self.element("p", 0, self.sentences(1, 1)) if r.random() < 0.5 else "")
            form = self.element("form", 0, inner, name if r.random() < 0.5 else "")
            return form if r.random() < 0.6 else self.element("div", 0, form, name)
        if kind == "comments":
            one = lambda: self.element(r.choice(["div", "li", "article"]), 0, (self.element("span", 0, self.words(1, 2), "author") if r.random() < 0.5 else "") + self.paragraph(0, 1, 4), r.choice(["comment", "reply", "comment-body", "review"]))
            inner = (self.element("h3", 0, self.words(1, 3)) if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 6)))
            return self.element(r.choice(["div", "section", "section", "ol"]), 0, inner, r.choice(PARTS["comments"]))
        return self.element(r.choice(["div", "ul", "p"]), 0, " ".join(self.link() for _ in range(r.randint(2, 5))), name)

    def page(self) -> str:
        """A page of one of some layouts: a marked article, a plain body, blocks of ``div``, a table with columns, lines parted by ``br``."""
        r = self.r
        layout = r.random()
        self.block, self.block_name = ("div", r.choice(["", "", "", "text", "para", "block"])) if r.random() < 0.25 else ("p", "")
        body = self.body()
        before = [self.part(k) for k in ("notice", "header", "nav", "ad", "aside") if r.random() < 0.5]
        after = [self.part(k) for k in ("share", "form", "aside", "ad", "comments", "notice", "footer") if r.random() < 0.45]
        if layout < 0.14:  # the body is the article's element
            few = r.random() < 0.5
            return self.document("".join(before[: r.randint(0, 2)] if few else before) + body + "".join(after[: r.randint(0, 1)] if few else after), 1)
        if layout < 0.22:  # text and line breaks in the body itself or in one element
            lines = "<br><br>".join(self.sentences(1, 6) for _ in range(r.randint(2, 9)))
            own = r.random() < 0.5
            main = lines if own else self.element(r.choice(["div", "td", "font", "section"]), 1, lines, r.choice(["", "", "text", "story"]))
            return self.document("".join(before[:2]) + main + "".join(after[:2]), int(own))
        if layout < 0.34:  # columns of a table: the menu, the article, the rest
            side = lambda: self.element("td", 0, r.choice([self.links(0), "<br>".join(self.link() for _ in range(r.randint(3, 9))), " ".join(self.link() for _ in range(5)), self.part("ad")]), r.choice(["", "", "menu", "side"]))
            cells = [side() for _ in range(r.randint(0, 2))] + [self.element("td", 1, body, r.choice(["", "", "content"]))] + [side() for _ in range(r.randint(0, 1))]
            top = self.element("tr", 0, self.element("td", 0, self.words(1, 4))) if r.random() < 0.4 else ""
            return self.document("".join(before[:1]) + self.element("table", 0, top + self.element("tr", 0, "".join(cells))) + "".join(after[:1]), 0)
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        name = "" if tag in ("article", "main") and r.random() < 0.6 or r.random() < 0.2 else r.choice(CONTENT_NAMES)
        main = self.element(tag, 1, body, name)
        if r.random() < 0.4:  # a wrapper around content and some of the rest
            cut = r.randint(0, len(before))
            main = self.element("div", 0, "".join(before[cut:]) + main + "".join(after[:1]), r.choice(["wrapper", "container", "page", "layout", "row", ""]))
            before, after = before[:cut], after[1:]
        return self.document("".join(before) + main + "".join(after), 0)

    def document(self, inner: str, label: int) -> str:
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body data-y="{label}">{inner}</body></html>'


def labelled_pages(n: int, seed: int) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
