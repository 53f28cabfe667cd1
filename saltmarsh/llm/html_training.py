"""Labelled pages to train the extractor from: invented, of many layouts, the same in every run.

``data-y`` marks a subtree as content (1) or not (0). The extractor never uses that attribute as a feature.
"""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo har len mor tin cal der".split()
ROOTS = ["content", "main", "post", "entry", "article", "story", "body-text", "post-body", "entry-content", "article-body", "main-content", "page"]
SIDES = ["sidebar", "side", "widget", "related", "rail", "aside", "popular", "recent", "tags", "archive"]
MENUS = ["menu", "nav", "navbar", "navigation", "breadcrumb", "links", "topnav", "pagination", "toc"]
HEADS = ["header", "masthead", "banner", "top", "branding", "logo", "site-header"]
FEET = ["footer", "bottom", "copyright", "legal", "site-footer", "colophon"]
ADS = ["ad", "ads", "advert", "sponsor", "promo", "banner-ad", "adsense", "sponsored"]
NOTES = ["cookie", "notice", "alert", "consent", "popup", "modal", "newsletter", "subscribe", "gdpr", "message"]
TALK = ["comments", "comment", "discussion", "replies", "respond", "comment-list", "disqus"]
SHARE = ["share", "social", "meta", "byline", "author-box", "toolbar", "print"]


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(3, 18).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def name(self, names: list[str]) -> str:
        kind = self.r.choice(["class", "class", "id"])
        return f' {kind}="{self.r.choice(names)}"'

    def links(self, n: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(n)]
        form = self.r.randrange(3)
        if form == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items) if form == 1 else "".join(f"<div>{x}</div>" for x in items)

    def menu(self) -> str:
        return f"<nav>{self.links(self.r.randint(2, 9))}</nav>" if self.r.random() < 0.5 else f"<div{self.name(MENUS)}>{self.links(self.r.randint(2, 9))}</div>"

    def head(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(2, 6)}</p>", f"<div>{self.words(1, 4)}</div>"]) + (self.menu() if self.r.random() < 0.5 else "")
        return f"<header>{inner}</header>" if self.r.random() < 0.5 else f"<div{self.name(HEADS)}>{inner}</div>"

    def foot(self) -> str:
        inner = self.r.choice([f"&copy; {self.word()}.com &middot; {self.prose(1, 2)}", f"<p>Copyright 2020 {self.words(2, 8)}.</p>", self.links(4), f"<p>{self.prose(1, 2)}</p>{self.links(3)}"])
        return f"<footer>{inner}</footer>" if self.r.random() < 0.6 else f"<div{self.name(FEET)}>{inner}</div>"

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + self.r.choice([self.links(5), f"<p>{self.prose(1, 2)}</p>", f"<ul><li>{self.sentence()}</li><li>{self.sentence()}</li></ul>"])
        return f"<aside>{inner}</aside>" if self.r.random() < 0.5 else f"<div{self.name(SIDES)}>{inner}</div>"

    def advert(self) -> str:
        inner = self.r.choice([self.prose(1, 2), f"<p>{self.prose(1, 2)}</p>", f'<a href="/x">{self.words(2, 6)}</a>'])
        return f"<{(t := self.r.choice(['div', 'div', 'section', 'aside']))}{self.name(ADS)}>{inner}</{t}>"

    def note(self) -> str:
        role = self.r.choice(["", ' role="alert"', ' role="dialog"'])
        return f"<div{self.name(NOTES)}{role}><p>{self.prose(1, 3)}</p>" + self.r.choice(["", "<button>OK</button>", "<a href='#'>More</a>"]) + "</div>"

    def form(self) -> str:
        return f'<form action="/s"><label>{self.words(1, 3)}</label><input name="q"><select><option>{self.word()}</option><option>{self.word()}</option></select><button>{self.word()}</button></form>'

    def talk(self) -> str:
        form = self.r.randrange(3)
        if form == 0:
            inner = "<ol>" + "".join(f'<li class="comment"><p>{self.prose(1, 3)}</p></li>' for _ in range(self.r.randint(1, 4))) + "</ol>"
        elif form == 1:
            inner = "".join(f'<div class="comment"><p>{self.words(1, 2)}</p><p>{self.prose(1, 3)}</p></div>' for _ in range(self.r.randint(1, 4)))
        else:
            inner = "".join(f'<article class="comment"><p>{self.prose(1, 3)}</p></article>' for _ in range(self.r.randint(1, 4)))
        t = self.r.choice(["section", "div"])
        return f'<{t}{self.name(TALK)} data-y="0"><h3>{self.words(1, 2)}</h3>{inner}</{t}>'

    def share(self) -> str:
        return f'<div{self.name(SHARE)} data-y="0">{self.links(3)}</div>'

    def block(self) -> str:
        x = self.r.random()
        if x < 0.48:
            return f"<p>{self.prose()}</p>"
        if x < 0.56:
            return f"<p>{self.words(1, 80)}</p>"
        if x < 0.62:
            return f"<p>{(self.word() + ' ') * self.r.randint(2, 60)}</p>"
        if x < 0.68:
            return f"<p><b>{self.prose(1, 2)}<br><p>{self.r.choice([self.prose(), self.words(3, 60)])}"
        if x < 0.75:
            return f"<h{(k := self.r.randint(2, 4))}>{self.words(1, 6)}</h{k}>"
        if x < 0.80:
            return "<ul>" + "".join(f"<li>{self.r.choice([self.sentence(), self.words(1, 5)])}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if x < 0.84:
            return f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>"
        if x < 0.87:
            return f"<p>{self.sentence()} <a href='/{self.word()}'>{self.words(1, 4)}</a> {self.sentence()}</p>"
        if x < 0.90:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(3)) + "</table>"
        if x < 0.92:
            return f"<figure><img src='a.png'><figcaption>{self.sentence()}</figcaption></figure>"
        if x < 0.94:
            return f"<pre>{self.words(3, 12)}</pre>"
        if x < 0.96:
            return f"<section><h2>{self.words(1, 4)}</h2><p>{self.prose()}</p></section>"
        return f"<p>{self.words(1, 3)}</p>"

    def page(self) -> str:
        r = self.r
        blocks = [self.block() for _ in range(r.randint(1, 14))]
        if r.random() < 0.25:
            blocks = [f"<div>{self.prose()}</div>" if b.startswith("<p>") else b for b in blocks]
        for extra, chance in ((self.advert, 0.3), (self.share, 0.3), (self.side, 0.1), (self.note, 0.1), (self.form, 0.1)):
            if r.random() < chance:
                blocks.insert(r.randint(0, len(blocks)), extra().replace(">", ' data-y="0">', 1) if extra != self.share else extra())
        if r.random() < 0.15:  # a page whose words all have the same signs, or none
            sign = r.choice(["", "###", "!!", " |"])
            blocks = [f"<p>{' '.join(self.word() + sign for _ in range(r.randint(1, 50)))}</p>" for _ in blocks]
        if r.random() < 0.2:  # many short lines, some of them over and over
            lines = [self.words(1, 9) + r.choice(["", ".", "."]) for _ in range(r.randint(1, 6))]
            blocks += [f"<p>{r.choice(lines)}</p>" for _ in range(r.randint(5, 90))]
        if r.random() < 0.1:
            blocks.append(f"<p>{self.words(200, 900)}</p>")
        title = f"<h1>{self.words(2, 9)}</h1>"
        inner = title + "".join(blocks) if r.random() < 0.65 else "".join(blocks)
        if r.random() < 0.3:
            inner += self.talk()
        form = r.choice([0, 0, 0, 0, 3, 3, 4, 4, 5, 5, 5, 5, 8, 8, 9, 9, 10, 10, 11])
        if form <= 2:
            body = f'<article data-y="1">{inner}</article>'
        elif form == 3:
            body = f'<main data-y="1">{inner}</main>' if r.random() < 0.5 else f'<main data-y="1"><section>{inner}</section></main>'
        elif form == 4:
            body = f'<main><article data-y="1"{self.name(ROOTS)}>{inner}</article>{self.side() if r.random() < 0.4 else ""}</main>'
        elif form <= 7:
            body = f'<div{self.name(ROOTS)} data-y="1">{inner}</div>'
        elif form == 8:
            body = f'<div{r.choice(["", f""" class="{self.word()}" """])} data-y="1">{inner}</div>'
        elif form == 9:
            body = f'<table><tr><td{self.name(SIDES + MENUS)}>{self.links(4)}</td><td{self.name(ROOTS)} data-y="1">{inner}</td></tr></table>'
        elif form == 10:  # no element of its own: blocks, menus and footer stand side by side in the body
            front, behind = ("".join(m().replace(">", ' data-y="0">', 1) for m in makers if r.random() < 0.4) for makers in ((self.menu, self.head, self.note), (self.side, self.advert, self.foot)))
            return f'<html><body data-y="1">{front}{inner}{behind}</body></html>'
        else:
            return f'<html data-y="1">{self.prose(1, 8)}' if r.random() < 0.4 else f'<html><body data-y="1">{inner}'
        parts = [body]
        for make, chance, front in ((self.talk, 0.2, False), (self.side, 0.5, None), (self.advert, 0.6, None), (self.note, 0.3, None), (self.form, 0.3, None), (self.menu, 0.7, True), (self.head, 0.6, True), (self.foot, 0.8, False)):
            if r.random() < chance:
                parts.insert(0 if front or (front is None and r.random() < 0.5) else len(parts), make())
        inside = "".join(parts)
        if r.random() < 0.3:
            inside = f"<div{self.name(['wrapper', 'container', 'page', 'site', 'layout'])}>{inside}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 5)}</title><style>p{{}}</style></head><body>{inside}</body></html>"


def labelled_pages(n: int = 1000, seed: int = 11) -> list[str]:
    return [_Maker(seed * 100_003 + i).page() for i in range(n)]
