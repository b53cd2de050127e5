"""Generated pages with known main text, for training the block labeller.

Regions are drawn from lists of usual element and class names and filled with sentences of made-up words,
for boilerplate too, so that words alone do not tell the regions apart; menus and notices also have their usual
phrases. Blocks of main text begin with a mark that is taken off again after parsing.
"""

from __future__ import annotations

import html
import random

import numpy as np

from retailcast.llm.html_blocks import Block, blocks_of

MARK = "\ue000"

# Usual names of regions: elements with class names; "" is the element alone.
MENU = ("nav", "div nav", "div menu", "div navbar", "div main-nav", "div navigation", "div topnav", "div breadcrumbs", "ul menu", "ul nav", "div pagination", "div toc", "div skip-links", "div role=navigation", "div site-menu")
HEADER = ("header", "div header", "header site-header", "div masthead", "div top-bar", "div branding", "div site-header", "div banner", "div page-header", "div role=banner", "div logo")
FOOTER = ("footer", "div footer", "footer site-footer", "div copyright", "div colophon", "div bottom", "div legal", "div page-footer", "div role=contentinfo", "div imprint")
SIDEBAR = ("aside", "div sidebar", "aside sidebar", "div side", "div widget", "div related", "div recommended", "div popular", "div trending", "div more-stories", "div tags", "div rail", "div role=complementary", "section related-posts", "div author-box", "ul tag-list", "div secondary")
NOTICE = ("div cookie", "div cookie-banner", "div consent", "div gdpr", "div notice", "div alert", "div popup", "div modal", "div newsletter", "div subscribe", "div paywall", "div announcement", "div role=alert", "div role=dialog", "dialog", "div message", "div warning", "div cookie-notice", "section notice", "div overlay", "div site-notice")
ADVERT = ("div ad", "div ads", "div advert", "div advertisement", "div sponsored", "div promo", "div ad-slot", "div banner-ad", "aside ad", "section advert", "div adsense", "div sponsor", "div promotion", "p ad", "div ad-container", "div google-ad")
FORM = ("form", "form search", "div search-form", "form contact", "form login", "div signup", "form newsletter", "fieldset", "div role=search", "form comment-form", "div search")
REMARKS = ("section comments", "div comments", "ol comment-list", "ul comments", "div responses", "div replies", "div discussion", "div reader-comments", "div comment-section", "section responses", "div disqus_thread", "aside comments", "div user-comments", "footer comments")
SHARE = ("div share", "div social", "div sharing", "ul share-links", "div share-buttons", "div follow-us", "div social-links")
MAIN = ("article", "main", "main article", "article post", "div content", "div article", "div post", "div entry-content", "div post-body", "div article-body", "div story", "div main", "div body-text", "div text", "div page-content", "section", "section content", "div role=main", "div entry", "article hentry", "div main-content", "div story-body", "article article", "section article", "div prose", "td", "td content", "main content")
WRAP = ("div", "div container", "div wrapper", "div page", "div layout", "div row", "div col", "div grid", "div site", "div inner", "section", "div root", "div app")
LINKS = "Home About Contact News Sport Privacy Terms Login Register Archive Search Help Sitemap Impressum Kontakt Datenschutz Accueil Mentions Inicio Contacto RSS Twitter Facebook Shop Cart Next Previous Tags".split()
PHRASES = (
    "All rights reserved.", "© 2024 Example Ltd.", "We use cookies to improve this site.", "Accept all", "Subscribe to our newsletter", "Sign up now", "Advertisement",
    "Sponsored content", "Buy now and save", "Leave a comment", "Reply", "Posted by guest", "Share this", "Read more", "Related articles", "Most popular", "Log in to comment",
    "Wir verwenden Cookies.", "Tous droits réservés.", "Todos los derechos reservados.", "Your email address", "Search", "Terms of use apply.", "Follow us", "Powered by",
)


def made_up(count: int, draw: random.Random) -> list[str]:
    """Texts of words from random syllables, some words far more frequent than others."""
    syllables = [a + b + c for a in ("", *"bcdfghklmnprstvwz", "th", "sch", "ñ") for b in "aeiouéäöüó" for c in ("", "n", "r", "s", "ng")]
    words = ["".join(draw.choice(syllables) for _ in range(draw.choice((1, 2, 2, 3)))) for _ in range(3000)]
    ranks = [1 / (k + 3) for k in range(len(words))]
    texts = []
    for _ in range(count):
        chosen = draw.choices(words, ranks, k=draw.randint(5, 80))
        texts.append(" ".join(w.capitalize() if not k or draw.random() < 0.1 else w + draw.choice(("", "", "", ",", ".")) for k, w in enumerate(chosen)))
    return texts


class _Maker:
    def __init__(self, draw: random.Random) -> None:
        self.draw, self.texts = draw, made_up(300, draw)

    def sentence(self) -> str:
        words = self.draw.choice(self.texts).split() or ["word"]
        first = self.draw.randrange(len(words))
        words = words[first : first + self.draw.choice((1, 2, 3, 5, 8, 13, 25, 60))]
        if self.draw.random() < 0.1:  # junk: one word again and again, signs, numbers, addresses
            odd = self.draw.choice(("", "***", "###", "www.example.com", "123", "me@example.org", "+1 555 0100"))
            words = [words[0] + odd if self.draw.random() < 0.7 else odd or w for w in words] * self.draw.choice((1, 1, 5))
        return html.escape(" ".join(words))

    def opened(self, region: str, inside: str) -> str:
        tag, *names = region.split(" ")
        if tag == "main" and names == ["article"]:
            return f"<main><article>{inside}</article></main>"
        around = {"td": ("<table><tr>", "</tr></table>")}.get(tag, ("", ""))
        for name in names:
            kind, value = ("role", name[5:]) if name.startswith("role=") else (self.draw.choice(("class", "class", "class", "id")), name)
            if kind == "class" and self.draw.random() < 0.3:
                value = f"{value} {self.draw.choice(('clearfix', 'block', 'module', 'x1', 'css-1a2b', 'mt-4'))}"
            return f'{around[0]}<{tag} {kind}="{value}">{inside}</{tag}>{around[1]}'
        return f"{around[0]}<{tag}>{inside}</{tag}>{around[1]}"

    def links(self) -> str:
        names = [self.draw.choice(LINKS) if self.draw.random() < 0.6 else self.sentence() for _ in range(self.draw.randint(1, 9))]
        links = [f'<a href="/{i}">{n}</a>' for i, n in enumerate(names)]
        if self.draw.random() < 0.6:
            items = "".join(f"<li>{link}</li>" for link in links)
            return f"<ul>{items}</ul>"
        return self.draw.choice((" ", " | ", "<br>")).join(links)

    def boiler_text(self) -> str:
        return self.draw.choice(PHRASES) if self.draw.random() < 0.4 else self.sentence()

    def boiler(self, regions: tuple[str, ...], linked: float = 0.4) -> str:
        region = self.draw.choice(regions)
        parts = []
        for _ in range(self.draw.choice((1, 1, 1, 2, 3))):
            if self.draw.random() < linked:
                parts.append(self.links())
            else:
                tag = self.draw.choice(("p", "p", "div", "span", "h2", "h3", "li", "", "h4", "section"))
                text = self.boiler_text()
                parts.append(f"<{tag}>{text}</{tag}>" if tag else text)
        return self.opened(region, self.draw.choice(("", " ", "\n")).join(parts))

    def form(self) -> str:
        fields = "".join(f"<label>{self.boiler_text()}</label><input name=q>" for _ in range(self.draw.randint(1, 3)))
        return self.opened(self.draw.choice(FORM), f"{self.draw.choice(('', f'<p>{self.boiler_text()}</p>', f'<h3>{self.boiler_text()}</h3>'))}{fields}<button>Go</button>")

    def remarks(self) -> str:
        tag = self.draw.choice(("div", "li", "article", "p", "section", "div"))
        name = self.draw.choice(("comment", "comment", "reply", "comment-body", "", "response", "message"))
        one = lambda: f'<{tag}{f" class={chr(34)}{name}{chr(34)}" if name else ""}>{self.draw.choice(("", "<b>guest</b> ", "<h4>guest</h4>"))}' + (
            self.sentence() if tag == "p" else f"<p>{self.sentence()}</p>"
        ) + f"</{tag}>"
        title = self.draw.choice(("", "<h2>Comments</h2>", f"<h3>{self.boiler_text()}</h3>"))
        form = self.form() if self.draw.random() < 0.2 else ""
        return self.opened(self.draw.choice(REMARKS), title + "".join(one() for _ in range(self.draw.randint(1, 6))) + form)

    def kept(self, tag: str, text: str) -> str:
        return f"<{tag}>{MARK}{text}</{tag}>" if tag else f"{MARK}{text}"

    def main_sentence(self) -> str:
        # An article may say what a footer says, too.
        return self.draw.choice(PHRASES) if self.draw.random() < 0.08 else self.sentence()

    def passage(self) -> str:
        kind = self.draw.random()
        if kind < 0.62:
            return self.kept("p", self.main_sentence())
        if kind < 0.68:
            return f"<p><b>{MARK}{self.main_sentence()}<br><p>{MARK}{self.main_sentence()}</p>"
        if kind < 0.76:
            return self.kept(self.draw.choice(("h2", "h3", "h4")), self.main_sentence())
        if kind < 0.83:
            items = "".join(self.kept("li", self.main_sentence()) for _ in range(self.draw.randint(1, 5)))
            return self.draw.choice((f"<ul>{items}</ul>", f"<ol>{items}</ol>"))
        if kind < 0.88:
            return f"<blockquote>{self.kept(self.draw.choice(('p', '')), self.main_sentence())}</blockquote>"
        if kind < 0.91:
            return self.kept("pre", self.main_sentence())
        if kind < 0.94:
            cells = "".join(f"<tr>{self.kept('td', self.main_sentence())}{self.kept('td', self.main_sentence())}</tr>" for _ in range(self.draw.randint(1, 3)))
            return f"<table>{cells}</table>"
        if kind < 0.97:
            return f"<p>{MARK}{self.main_sentence()} <a href='/x'>{self.main_sentence()}</a> {self.main_sentence()}</p>"
        return f"<figure><img src=a.png><figcaption>{MARK}{self.main_sentence()}</figcaption></figure>"

    def article(self) -> str:
        draw = self.draw
        parts = []
        if draw.random() < 0.8:
            title = self.kept(draw.choice(("h1", "h1", "h1", "h2")), self.sentence())
            parts.append(f"<header>{title}</header>" if draw.random() < 0.15 else title)
        body = [self.passage() for _ in range(draw.choice((1, 2, 3, 5, 8, 13, 21)))]
        if draw.random() < 0.08:
            body = [self.kept("div", self.main_sentence()) for _ in body]
        if draw.random() < 0.12:  # the same passage many times
            body[draw.randrange(len(body))] *= draw.choice((2, 4, 12, 25))
        for region, chance, linked in ((ADVERT, 0.25, 0.2), (SIDEBAR, 0.12, 0.6), (NOTICE, 0.1, 0.1), (SHARE, 0.1, 0.9), (MENU, 0.05, 1.0)):
            if draw.random() < chance:
                body.insert(draw.randrange(len(body) + 1), self.boiler(region, linked))
        if draw.random() < 0.08:
            body.insert(draw.randrange(len(body) + 1), self.form())
        if draw.random() < 0.12:
            body.append(self.remarks())
        if draw.random() < 0.06:
            body.append(self.boiler(("footer", "footer post-footer", "footer entry-meta"), 0.5))
        inside = "".join(parts + body)
        if draw.random() < 0.06:
            return inside  # straight in the page
        region = draw.choice(MAIN[:4]) if draw.random() < 0.4 else draw.choice(MAIN)
        made = self.opened(region, inside)
        return self.opened(draw.choice(WRAP), made) if draw.random() < 0.3 else made

    def page(self) -> str:
        draw = self.draw
        if draw.random() < 0.06:  # nothing but text
            parts = [self.passage() for _ in range(draw.randint(1, 6))]
            return "".join(parts) if draw.random() < 0.6 else self.kept("", self.sentence())
        before = [
            made
            for chance, make in (
                (0.25, lambda: self.boiler(NOTICE, 0.2)), (0.5, lambda: self.boiler(HEADER, 0.4)), (0.75, lambda: self.boiler(MENU, 0.9)),
                (0.15, self.form), (0.45, lambda: self.boiler(ADVERT, 0.2)), (0.15, lambda: self.boiler(SIDEBAR, 0.5)),
            )
            if draw.random() < chance
            for made in [make()]
        ]
        after = [
            made
            for chance, make in (
                (0.15, lambda: self.boiler(SHARE, 0.9)), (0.3, self.remarks), (0.35, lambda: self.boiler(SIDEBAR, 0.5)), (0.2, lambda: self.boiler(ADVERT, 0.2)),
                (0.15, self.form), (0.15, lambda: self.boiler(NOTICE, 0.2)), (0.75, lambda: self.boiler(FOOTER, 0.3)), (0.06, lambda: self.boiler(MENU, 0.9)),
            )
            if draw.random() < chance
            for made in [make()]
        ]
        middle = self.article()
        if draw.random() < 0.03:
            middle = ""  # a page without an article
        body = draw.choice(("", "\n")).join([*before, middle, *after])
        if draw.random() < 0.25:
            body = self.opened(draw.choice(WRAP), body)
        head = f"<head><title>{self.sentence()}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head>"
        return f"<!DOCTYPE html><html lang=en>{head}<body>{body}</body></html>"


def marked(source: str) -> tuple[list[Block], np.ndarray]:
    """Blocks without the marks, and which had one."""
    blocks = [b for b in blocks_of(source) if b.text.replace(MARK, "").strip()]
    labels = np.array([MARK in b.text for b in blocks], dtype=bool)
    for block in blocks:
        block.text = " ".join(block.text.replace(MARK, " ").split())
    return blocks, labels


def layouts(count: int, seed: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    """``count`` generated pages and their labels; the same seed gives the same pages."""
    maker = _Maker(random.Random(seed))
    pages = [marked(maker.page()) for _ in range(count)]
    return [p for p, _ in pages], [labels for _, labels in pages]
