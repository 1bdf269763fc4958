"""Made-up web pages with known main text, for training the block labeller."""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Names that sites give to parts of pages; "" is a part without any.
NAMES = {
    "menu": ["nav", "menu", "navbar", "main-nav", "site-nav", "topnav", "navigation", "breadcrumbs", "breadcrumb", "pagination", "toolbar", "tabs"],
    "header": ["header", "site-header", "masthead", "top", "page-header", "branding", "logo", "topbar"],
    "footer": ["footer", "site-footer", "bottom", "page-footer", "copyright", "colophon", "legal"],
    "sidebar": ["sidebar", "side", "aside", "right-column", "rail", "widget", "widgets", "related", "related-posts", "recommended", "trending", "more-stories", "tags", "author-box"],
    "notice": ["cookie", "cookie-notice", "cookies", "consent", "gdpr", "notice", "banner", "alert", "popup", "modal", "overlay", "paywall", "newsletter", "subscribe", "signup", "message"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "adsense", "ad-slot", "banner-ad", "promotion", "teaser"],
    "form": ["form", "search", "searchform", "login", "contact-form", "poll", "survey"],
    "comments": ["comments", "comment", "comment-list", "responses", "discussion", "replies", "reader-comments", "disqus", "thread", "reply"],
    "share": ["share", "social", "social-share", "sharing", "follow", "buttons"],
    "content": ["content", "post", "entry", "entry-content", "article-body", "post-content", "story", "main", "main-content", "text", "body", "article", "post-body", "story-body", "page-content"],
    "wrapper": ["wrapper", "container", "page", "site", "row", "layout", "inner", "outer", "wrap", "col", "grid", ""],
}
#: Phrases of such parts.
PHRASES = {
    "menu": "Home,About,Contact,News,Sports,Login,Sign in,Register,Archive,Next,Previous,Topics,Shop,Help,FAQ".split(","),
    "notice": ["We use cookies to improve your experience.", "Accept all", "This site uses cookies. By continuing you agree.", "Subscribe to our newsletter", "You have read all free articles."],
    "footer": ["All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Powered by", "Contact us"],
    "form": ["Your name", "Email", "Submit", "Search", "Password", "Send", "Leave a reply"],
    "share": ["Share", "Tweet", "Like", "Follow us", "Print", "Email this"],
    "comments": ["Comments", "Reply", "Report", "Log in to comment", "3 comments", "Show more comments", "Like", "Newest first"],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Free shipping", "Learn more"],
    "sidebar": ["Most read", "Related articles", "Popular", "Tags", "Archives", "Recent posts"],
}
#: Headings of reader comments and names of the elements of one; {} is a number.
COMMENT_HEADS = ["Comments", "{} comments", "Comments ({})", "{} Comments", "Reader comments", "Responses", "{} responses", "Discussion", "Discussion ({})", "Join the discussion", "Leave a comment", "What readers say", "Replies", "Conversation", "Your comments"]
COMMENT_PARTS = ["comment", "post", "item", "message", "reply", "entry", "comment-body", "comment-text", "text", "body", "content", "media", "thread-item", "user-comment", ""]
TOOL_PARTS = ["edit", "editsection", "tools", "actions", "permalink", "print", "toc", "jump"]
SYLLABLES = ["ra", "ten", "ion", "the", "er", "an", "sch", "eau", "ció", "que", "ver", "lo", "ent", "mi", "ing", "do", "é", "ung", "st", "ar", "oi", "ble", "po", "ka", "zu"]


#: Stands in every main block of a marked page, as the same words may stand in others, too.
MARK = "\ue000"


class Maker:
    def __init__(self, seed: int, mark: str = ""):
        self.r = random.Random(seed)
        self.mark = mark
        self.truth: list[str] = []

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.08:
            words = [w.upper() + "!!" for w in words]
        elif self.r.random() < 0.08:
            words = [w + self.r.choice(["***", "###", "%%%", " |"]) for w in words]
        text = " ".join(words).capitalize()
        return text + self.r.choice([".", ".", ".", "", "!", "?"])

    def prose(self, low: int = 1, high: int = 5) -> str:
        return " ".join(self.sentence(1, 18) for _ in range(self.r.randint(low, high)))

    def named(self, kind: str, tags: list[str], inner: str, odds: float = 0.8) -> str:
        tag, attr = self.r.choice(tags), ""
        if tag == "div" or self.r.random() < odds * 0.6:
            names = [self.r.choice(NAMES[kind])]
            if self.r.random() < 0.25:
                names.append(self.r.choice([*NAMES[kind], self.word()]))
            attr = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice([" ", "-", "_"]).join(names)}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def phrase(self, kind: str) -> str:
        return self.r.choice(PHRASES[kind]) if kind in PHRASES and self.r.random() < 0.4 else self.sentence(1, 6)

    def links(self, kind: str, low: int = 2, high: int = 8) -> str:
        items = [f'<a href="/{self.word()}">{self.phrase(kind)}</a>' for _ in range(self.r.randint(low, high))]
        shape = self.r.random()
        if shape < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in items) if shape < 0.75 else self.r.choice([" | ", "<br>", " "]).join(items)

    def junk(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            return self.named(kind, ["nav", "nav", "div"], self.links(kind))
        if kind == "header":
            inner = self.r.choice([f"<div>{self.phrase('menu')}</div>", f"<h1>{self.sentence(1, 4)}</h1>", f"<p>{self.sentence(2, 6)}</p>", ""]) + (self.junk("menu") if r.random() < 0.6 else "")
            return self.named(kind, ["header", "header", "div"], inner)
        if kind == "footer":
            inner = self.r.choice([f"&copy; {self.word()} &middot; {self.prose(1, 2)}", f"<p>{self.phrase(kind)}</p><p>{self.prose(1, 2)}</p>", self.links(kind), f"<p>{self.phrase(kind)}</p>"])
            return self.named(kind, ["footer", "footer", "div"], inner)
        if kind == "sidebar":
            inner = "".join(r.choice([f"<h3>{self.phrase(kind)}</h3>{self.links(kind)}", f"<p>{self.prose(1, 3)}</p>", self.prose(1, 2), f"<h4>{self.sentence(1, 4)}</h4><p>{self.prose(1, 2)}</p>"]) for _ in range(r.randint(1, 3)))
            return self.named(kind, ["aside", "aside", "div", "section"][: 3 if r.random() < 0.8 else 4], inner)
        if kind in ("notice", "advert"):
            inner = r.choice([self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f"<p>{self.phrase(kind)}</p><button>{self.phrase(kind)}</button>", f"<a href='#'>{self.sentence(2, 9)}</a>", f"<h3>{self.sentence(1, 5)}</h3><p>{self.prose(1, 3)}</p>"])
            return self.named(kind, ["div", "div", "aside"] if kind == "advert" else ["div"], inner)
        if kind == "form":
            inner = f"<p>{self.prose(1, 2)}</p>" * r.randint(0, 1) + "".join(f"<label>{self.phrase(kind)}</label><input type='text'>" for _ in range(r.randint(1, 3))) + f"<button>{self.phrase(kind)}</button>"
            return self.named(kind, ["form"], inner)
        if kind == "comments":
            return self.thread()
        return self.named(kind, ["div"], self.links(kind, 1, 4))

    def thread(self) -> str:
        """Reader comments. One whose elements have no names has a heading that says what it is."""
        r = self.r
        plain = r.random() < 0.2
        part, style = r.choice(COMMENT_PARTS), r.randrange(7)
        head = r.choice(COMMENT_HEADS).format(r.randint(1, 300))

        def one(depth: int = 0) -> str:
            who, said = self.sentence(1, 2).rstrip(".!?"), self.prose(1, 4)
            shapes = [f"<p>{said}</p>", f"<b>{who}</b><p>{said}</p>", said, f"<b>{who}</b> {said}", f"<div>{who}</div><div>{said}</div>", f"<h4>{who}</h4><p>{said}</p><p>{self.prose(1, 2)}</p>", f"<p><strong>{who}</strong> <time>{r.randint(1, 9)} h</time></p><blockquote>{self.sentence(2, 9)}</blockquote><p>{said}</p>"]
            inner = shapes[style] + (f"<a href='#'>{self.phrase('comments')}</a>" if r.random() < 0.2 else "")
            if depth < 2 and r.random() < 0.15:
                inner += one(depth + 1)
            tag = "li" if outer in ("ol", "ul") else item
            return f"<{tag}>{inner}</{tag}>" if plain or not part else f'<{tag} class="{part}">{inner}</{tag}>'

        outer, item = r.choice(["div", "div", "section", "section", "ol", "ul", "aside"]), r.choice(["div", "div", "article", "p" if style in (2, 3) else "div"])
        level = r.choice(["h2", "h3", "h3", "h4"])
        heading = f"<{level}>{head}</{level}>" if plain or r.random() < 0.65 else ""
        inner = "".join(one() for _ in range(r.choice([1, 1, 2, 3, 5, 8]))) + (self.junk("form") if r.random() < 0.25 else "")
        attr = "" if plain else f' {r.choice(["class", "id"])}="{r.choice(NAMES["comments"])}"'
        if r.random() < 0.5 and outer not in ("ol", "ul"):
            return f"<{outer}{attr}>{heading}{inner}</{outer}>"
        return f"{heading if plain else ''}<{outer}{attr}>{'' if plain or outer in ('ol', 'ul') else heading}{inner}</{outer}>"

    def text(self, low: int = 1, high: int = 6) -> str:
        """A block of main text, noted as such."""
        if self.r.random() < 0.03:
            text = self.r.choice(PHRASES[self.r.choice(list(PHRASES))])
        elif self.r.random() < 0.1:
            text = self.sentence(1, 2)
        else:
            text = self.prose(low, high)
        return self.noted(text)

    def noted(self, text: str) -> str:
        self.truth.append(text)
        if self.r.random() < 0.2:
            words = text.split(" ")
            k = self.r.randrange(len(words))
            words[k] = self.r.choice(["<b>{}</b>", "<i>{}</i>", "<a href='#'>{}</a>", "<em>{}</em>"]).format(words[k])
            text = " ".join(words)
        return self.mark + text

    def part(self) -> str:
        r = self.r.random()
        if r < 0.52:
            return f"<p>{self.text()}</p>"
        if r < 0.59:
            return f"<p>{self.text(1, 1)}</p>"
        if r < 0.67:
            level = self.r.choice(["h2", "h2", "h3", "h4"])
            tool = f'<div class="{self.r.choice(TOOL_PARTS)}"><a href="#">{self.sentence(1, 2)}</a></div>' if self.r.random() < 0.15 else ""
            return f"<{level}>{self.text(1, 1)}</{level}>{tool}<p>{self.text()}</p>"
        if r < 0.74:
            tag = self.r.choice(["ul", "ul", "ol"])
            items = [f"<li>{self.text(1, 1)}" + self.r.choice(["</li>", "</li>", "</li>", ""]) for _ in range(self.r.randint(1, 5))]
            if self.r.random() < 0.15:
                items.append(f"<li>{self.text(1, 1)}<ul><li>{self.text(1, 1)}</li></ul></li>")
            return f"<{tag}>{''.join(items)}</{tag}>"
        if r < 0.78:
            inner = self.text(1, 2) if self.r.random() < 0.5 else f"<p>{self.text(1, 2)}</p>" + (f"<footer>{self.text(1, 1)}</footer>" if self.r.random() < 0.2 else "")
            return f"<blockquote>{inner}</blockquote>"
        if r < 0.84:
            cell = self.r.choice(["td", "td", "th"])
            rows = [f"<tr><{cell}>{self.text(1, 1)}</{cell}><td>{self.text(1, 1)}</td></tr>" for _ in range(self.r.randint(1, 4))]
            head = f"<caption>{self.text(1, 1)}</caption>" if self.r.random() < 0.2 else ""
            if self.r.random() < 0.25:
                head += f"<thead><tr><th>{self.text(1, 1)}</th><th>{self.text(1, 1)}</th></tr></thead>"
            return f"<table>{head}{''.join(rows)}</table>"
        if r < 0.89:
            return "<dl>" + "".join(f"<dt>{self.text(1, 1)}</dt>" + f"<dd>{self.text(1, 2)}</dd>" * 1 for _ in range(self.r.randint(1, 4))) + "</dl>"
        if r < 0.93:
            return self.r.choice(["<pre>{}</pre>", "<pre><code>{}</code></pre>", '<pre class="code">{}</pre>', '<div class="highlight"><pre>{}</pre></div>']).format(self.code())
        if r < 0.955:
            caption = f"<figcaption>{self.text(1, 2)}</figcaption>"
            return self.r.choice([f"<figure><img src=x>{caption}</figure>", f"<figure>{caption}</figure>"])
        if r < 0.975:
            return self.r.choice(["<div>{}</div>", "<section><h3>{}</h3></section>", "<details><summary>{}</summary></details>", "<center>{}</center>", "<address>{}</address>"]).format(self.text())
        if r < 0.985:
            return self.text()  # without an element of its own
        return f"<p><b>{self.text()}<br>"  # left open

    def code(self) -> str:
        lines = [f"{self.word()} {self.r.choice(['=', '(', '->', '{', ':', '+'])} {self.word()}{self.r.choice([';', ')', '', '}'])}" for _ in range(self.r.randint(1, 5))]
        self.truth.append(" ".join(lines))
        return self.mark + "\n  ".join(lines)

    def repeats(self) -> str:
        """One line, or a few short ones, over and over."""
        r, some = self.r, [self.sentence(1, self.r.choice([2, 4, 12])) for _ in range(self.r.choice([1, 1, 1, 2, 5]))]
        return "".join(f"<p>{self.noted(r.choice(some))}</p>" for _ in range(r.choice([3, 8, 20, 60])))

    def bare(self) -> str:
        """A page that is nothing but its text, or hardly more."""
        r = self.r
        shape = r.randrange(7)
        if shape == 0:
            body = self.text()
        elif shape == 1:
            body = self.text(1, 1)
        elif shape == 2:
            body = "".join(self.part() for _ in range(r.randint(1, 8)))
        elif shape == 3:
            body = f"<pre>{self.code()}</pre>" if r.random() < 0.5 else f"<pre>{self.text()}</pre>"
        elif shape == 4:
            body = f"<h1>{self.text(1, 1)}</h1>" + "".join(self.part() for _ in range(r.randint(1, 5)))
        elif shape == 5:
            body = "<hr>".join(self.text() for _ in range(r.randint(2, 5)))
        else:
            body = "".join(f"<div>{self.text()}</div>" for _ in range(r.randint(1, 5)))
        if r.random() < 0.35:
            return body
        head = f"<head><title>{self.sentence(2, 6)}</title></head>" if r.random() < 0.5 else ""
        return f"<html>{head}<body>{body}</body></html>"

    def article(self) -> str:
        r = self.r
        inner = [f"<h1>{self.text(1, 1)}</h1>"] if r.random() < 0.85 else []
        if inner and r.random() < 0.15:
            inner = [f"<header>{inner[0]}</header>"]
        if r.random() < 0.3:
            inner.append(f"<p><b>{self.text(1, 4)}<br>")
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 10, 20])):
            inner.append(self.part() if r.random() < 0.96 else self.repeats())
            if r.random() < 0.1:
                inner.append(self.junk(r.choice(["advert", "share", "sidebar", "form", "notice"])))
        if not self.truth:
            inner.append(f"<p>{self.text()}</p>")
        if r.random() < 0.2:
            inner.append(self.junk(r.choice(["comments", "share", "footer", "sidebar", "form"])))
        body = "".join(inner)
        shape = r.random()
        if shape < 0.5:
            body = f"<article>{body}</article>" if r.random() < 0.6 else f'<article class="{r.choice(NAMES["content"])}">{body}</article>'
        elif shape < 0.65:
            body = f"<main>{body}</main>"
        elif shape < 0.95:
            body = self.named("content", ["div", "div", "section"], body)
        if r.random() < 0.2:
            body = f"<main>{body}</main>"
        return body

    def cells(self, parts: list[str]) -> list[str]:
        """The parts of a page in the cells of a table, in one row or one a row."""
        cells = []
        for part in parts:
            whole = part.startswith("<div") and part.endswith("</div>") and part.count("<div") == 1
            cells.append(f"<td{part[4:-6]}</td>" if whole else f"<td>{part}</td>")
        between = self.r.choice(["", "</tr><tr>"])
        return ["<table><tr>", between.join(cells), "</tr></table>"]

    def page(self) -> str:
        r = self.r
        if r.random() < 0.08:
            return self.bare()
        before = [k for k in ("notice", "header", "menu", "advert", "form", "sidebar") if r.random() < 0.45]
        after = [k for k in ("share", "sidebar", "comments", "advert", "notice", "form", "footer") if r.random() < (0.75 if k == "footer" else 0.4)]
        if r.random() < 0.3:
            r.shuffle(before)
        parts = [self.junk(k) for k in before] + [self.article()] + [self.junk(k) for k in after]
        if r.random() < 0.06:
            parts = self.cells(parts)
        elif r.random() < 0.4:
            cut = len(before) if r.random() < 0.5 else 0
            name = r.choice(NAMES["wrapper"])
            parts = [*parts[:cut], f'<div class="{name}">' if name else "<div>", *parts[cut:], "</div>"]
        space = r.choice(["", "", "\n", "\n  "])
        return f"<!DOCTYPE html><html><head><title>{self.sentence(2, 6)}</title><script>var a='<p>';</script></head><body>{space.join(parts)}</body></html>"


def marked_pages(n: int, seed: int) -> Iterator[str]:
    """Pages with MARK in every main block."""
    for k in range(n):
        yield Maker(seed * 1_000_003 + k, MARK).page()


def made_pages(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """Pages and the texts of their main blocks."""
    for k in range(n):
        maker = Maker(seed * 1_000_003 + k)
        page = maker.page()
        yield page, {" ".join(t.split()) for t in maker.truth}
