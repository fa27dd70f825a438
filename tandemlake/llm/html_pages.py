"""Labelled pages to train the block labeller on, made by rule from a seed.

Layouts, container names, nesting, and what surrounds and interrupts the article vary independently. The words are
invented and of one kind everywhere, so what is learned is structure rather than vocabulary. Article text is wrapped
in marks that the reader of the page turns into labels; they are not part of a page.
"""

from __future__ import annotations

import random

# Container names of public page designs, by what they hold.
NAMES = {
    "nav": ["nav", "navbar", "menu", "main-menu", "navigation", "topnav", "breadcrumbs", "breadcrumb", "site-nav", "pagination", "pager", "toc-menu", "skip-link"],
    "header": ["header", "site-header", "masthead", "page-header", "topbar", "top-bar", "branding", "logo"],
    "footer": ["footer", "site-footer", "page-footer", "colophon", "copyright", "bottom", "legal", "contentinfo"],
    "side": ["sidebar", "side", "aside", "widget", "rail", "right-column", "related", "related-posts", "recommended", "trending", "popular", "read-more", "tags", "tag-list", "author-box", "meta-links", "complementary"],
    "notice": ["notice", "cookie-banner", "cookie-notice", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "disclaimer", "announcement", "warning-bar", "toast"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "adbox", "banner-ad", "sponsor", "sponsored", "promo", "promotion", "adsense", "adsbygoogle", "banner"],
    "form": ["newsletter", "subscribe", "signup", "sign-up", "login", "search", "search-form", "contact-form", "form", "survey", "poll"],
    "share": ["share", "social", "share-bar", "social-links", "follow-us", "toolbar"],
    "comments": ["comments", "comment-list", "comment", "comment-section", "respond", "discussion", "disqus", "replies", "reader-comments", "user-comments", "feedback", "reactions", "thread", "responses"],
    "content": ["content", "article", "post", "entry", "entry-content", "post-body", "article-body", "story", "story-body", "main", "main-content", "text", "body-copy", "page-content", "blog-post"],
}
NEUTRAL = ["container", "wrapper", "row", "col", "inner", "section", "block", "grid", "box", "layout", "page", "left", "wide", "x1", "u-flex"]
OPEN, SHUT = "", ""


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.style = self.r.choice(["plain", "plain", "plain", "upper", "signs"])

    def some(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            w = "".join(self.r.choice(["an", "er", "th", "in", "qu", "ße", "é", "ñ", "ou", "st", "le", "ti", "ch", "ra"]) for _ in range(self.r.randint(1, 4)))
            w += self.r.choice(["", "", "", "", "", ",", "."])
            out.append(w.upper() + "!!" if self.style == "upper" else w + self.r.choice(["***", "$$$", "|", "&amp;"]) if self.style == "signs" else w)
        out[0] = out[0].capitalize() if self.style == "plain" else out[0]
        return " ".join(out) + self.r.choice(["", ".", ".", ".", "!", "?"])

    def attrs(self, kind: str) -> str:
        name = self.r.choice(NAMES[kind])
        name = self.r.choice([name, name, name.replace("-", "_"), name.title().replace("-", ""), f"{self.r.choice(NEUTRAL)} {name}"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def neutral(self) -> str:
        return f' class="{self.r.choice(NEUTRAL)}"' if self.some(0.5) else ""

    def box(self, kind: str, inner: str, *tags: str) -> str:
        """A box told by its tag, by its name, or by both."""
        if tags and self.some(0.5):
            tag = self.r.choice(tags)
            return f"<{tag}{self.attrs(kind) if self.some(0.4) else ''}>{inner}</{tag}>"
        tag = self.r.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        return f"<{tag}{self.attrs(kind)}>{inner}</{tag}>"

    def wrap(self, inner: str) -> str:
        return f"<div{self.neutral()}>{inner}</div>" if self.some(0.4) else inner

    def links(self, low: int, high: int) -> str:
        each = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(self.r.randint(low, high))]
        return self.r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>", lambda: " | ".join(each), lambda: "".join(f"<span>{x}</span> " for x in each)])()

    def said(self, low: int, high: int) -> str:
        return self.r.choice(["<p>{}</p>", "<p>{}</p>", "{}", "<div>{}</div>", "<span>{}</span>"]).format(self.words(low, high))

    def junk(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.box("nav", self.links(2, 8), "nav", "nav", "menu")
        if kind == "header":
            inner = r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<a href='/'>{self.words(1, 3)}</a>", self.said(1, 6)]) + (self.junk("nav") if self.some(0.4) else "")
            return self.box("header", inner, "header")
        if kind == "footer":
            return self.box("footer", r.choice(["&copy; 2024 ", "© ", "", "Copyright "]) + self.words(1, 12) + (self.links(1, 5) if self.some(0.4) else "") + (self.said(2, 30) if self.some(0.5) else ""), "footer")
        if kind == "side":
            return self.box("side", (f"<h{r.randint(2, 4)}>{self.words(1, 4)}</h3>" if self.some(0.6) else "") + (self.links(2, 6) if self.some(0.6) else self.said(3, 40)), "aside")
        if kind == "notice":
            return self.box("notice", self.said(3, 40) + (f"<button>{self.words(1, 2)}</button>" if self.some(0.5) else ""), "dialog")
        if kind == "ad":
            return self.box("ad", self.said(2, 40) + (f'<a href="#">{self.words(1, 5)}</a>' if self.some(0.3) else ""))
        if kind == "form":
            inner = "".join(r.choice([f"<label>{self.words(1, 5)}</label><input name=q>", f"<p>{self.words(2, 25)}</p>", f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>", f"<button>{self.words(1, 3)}</button>", f"<textarea>{self.words(1, 4)}</textarea>"]) for _ in range(r.randint(1, 4)))
            return r.choice([f"<form action='/s'>{inner}</form>", f"<form{self.attrs('form')}>{inner}</form>", self.box("form", f"<form>{inner}</form>"), self.box("form", inner)])
        if kind == "share":
            return self.box("share", self.links(2, 5) if self.some(0.7) else self.said(1, 6))
        each = "".join(r.choice(['<div class="comment">{}</div>', "<li>{}</li>", "<article>{}</article>", "<div>{}</div>", "<blockquote>{}</blockquote>"]).format((f"<b>{self.words(1, 2)}</b> " if self.some(0.6) else "") + self.said(2, 80)) for _ in range(r.randint(1, 5)))
        return self.box("comments", (f"<h3>{self.words(1, 4)}</h3>" if self.some(0.6) else "") + each + (self.junk("form") if self.some(0.4) else ""))

    def mark(self, text: str) -> str:
        return f"{OPEN}{text}{SHUT}"

    def inline(self, text: str) -> str:
        if self.some(0.3):
            tag = self.r.choice(["b", "i", "em", "strong", "a href='/x'", "span", "code"])
            text = f"<{tag}>{text}</{tag.split()[0]}>" if self.some(0.7) or tag[0] == "a" else f"<{tag}>{text}"
        return text

    def part(self) -> str:
        r, long = self.r, self.r.choice([(1, 6), (8, 40), (8, 40), (30, 140)])
        say = lambda low, high: self.mark(self.words(low, high))
        return r.choice(
            [lambda: f"<p>{self.inline(say(*long))}</p>"] * 8
            + [lambda: f"<p>{say(*long)}<br><p>{say(3, 50)}</p>", lambda: f"<h{r.randint(2, 4)}>{say(1, 9)}</h2>", lambda: "<ul>" + "".join(f"<li>{say(1, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>", lambda: f"<blockquote><p>{say(4, 50)}</p></blockquote>", lambda: "<table>" + "".join(f"<tr><td>{say(1, 3)}</td><td>{say(1, 6)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>", lambda: f"<pre>{say(2, 30)}</pre>", lambda: f"<div>{say(*long)}</div>", lambda: f"<figure><img src=x><figcaption>{say(2, 12)}</figcaption></figure>", lambda: f"<section{self.neutral()}><p>{say(*long)}</p></section>"]
        )()

    def article(self) -> str:
        r = self.r
        parts = [f"<h1>{self.inline(self.mark(self.words(2, 12)))}</h1>"] if self.some(0.8) else []
        for _ in range(r.choice([1, 2, 4, 8, 16])):
            parts.append(self.part())
            if self.some(0.1):
                parts.append(self.junk(r.choice(["ad", "ad", "side", "form", "share", "notice"])))
        inner = "".join(parts)
        inner = self.wrap(inner)
        a = f"<article{self.attrs('content') if self.some(0.3) else self.neutral()}>{inner}</article>"
        b = f"<div{self.attrs('content')}>{inner}</div>"
        c = f"<main{self.neutral()}>{inner}</main>"
        d = f"<div{self.neutral()}>{inner}</div>"
        return r.choice([a, a, a, b, b, c, f"<main>{a}</main>", f"<div{self.attrs('content')}>{a}</div>", d])

    def page(self) -> str:
        r = self.r
        before = [k for k, p in (("header", 0.5), ("nav", 0.6), ("notice", 0.3), ("ad", 0.3), ("form", 0.15), ("side", 0.15), ("share", 0.1)) if self.some(p)]
        after = [k for k, p in (("share", 0.2), ("ad", 0.2), ("side", 0.3), ("comments", 0.5), ("form", 0.25), ("notice", 0.2), ("nav", 0.15)) if self.some(p)]
        r.shuffle(before)
        r.shuffle(after)
        middle = "".join([*(self.wrap(self.junk(k)) for k in before), self.article(), *(self.wrap(self.junk(k)) for k in after)])
        return f"<html><body>{self.wrap(middle)}{self.junk('footer') if self.some(0.7) else ''}</body></html>"


def pages(n: int, seed: int = 11) -> list[str]:
    return [Maker(seed * 100_003 + i).page() for i in range(n)]
