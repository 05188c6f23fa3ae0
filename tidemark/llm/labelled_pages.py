"""Labelled pages to train the page model on: layouts with known main text, filled with invented words.

Each page is a list of (markup, kept) fragments; the kept ones are the article. Layouts vary in how they mark up an article
and in what stands around and inside it, so that the model learns from tags, names and text, not from one site.
"""

from __future__ import annotations

import random

# Opening tags of containers, by what they hold; the closing tag follows from the opening one.
ARTICLE = ("<article>", "<main>", '<div id="content">', '<div class="post">', '<div class="entry-content">', '<section class="article-body">', '<div role="main">', '<div class="story-text">', '<div class="main"><article>', "<div>", '<td class="body">', '<div id="page"><div class="text">')
MENU = ("<nav>", '<div class="menu">', '<ul class="navbar">', '<div id="topnav">', '<nav class="breadcrumbs">', '<div role="navigation">', '<ul class="tabs">', '<div class="share-links">')
HEADER = ("<header>", '<div id="header">', '<div class="masthead">', '<div class="site-banner">', '<header class="site-header">')
FOOTER = ("<footer>", '<div id="footer">', '<div class="copyright">', '<div class="site-info">', '<footer class="page-footer">')
SIDEBAR = ("<aside>", '<div class="sidebar">', '<div id="secondary">', '<div class="widget">', '<aside class="related">', '<div class="popular-posts">')
ADVERT = ('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="sponsored">', '<ins class="adsbygoogle">', '<aside class="promo">', '<div id="banner-ad">')
NOTICE = ('<div class="cookie-notice">', '<div class="notice">', '<div class="alert">', '<div id="consent">', '<div class="gdpr-banner">', '<div role="alert">', '<div class="newsletter">', '<div class="popup">')
FORM = ("<form>", '<form class="search">', '<form id="subscribe">', '<form class="login">')
COMMENTS = ('<section id="comments">', '<ol class="commentlist">', '<div class="comments">', '<div class="reader-comments">', '<section class="discussion">', '<div id="respond">')
SYLLABLES = "ba be da do en er ga hi in ka la le lo ma mi na no or pe ra re sa si ta te ti to un va ve wo zu é ö ñ".split()


def close(opened: str) -> str:
    names = [t.strip("<").split(" ")[0].rstrip(">") for t in opened.split("><")]
    return "".join(f"</{n}>" for n in reversed(names))


class Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(self.rng.randint(low, high)))

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high).capitalize() + self.rng.choice(("." * 8) + "!?")

    def prose(self, sentences: int) -> str:
        out = " ".join(self.sentence(4, 22) for _ in range(self.rng.randint(1, sentences)))
        return self.rng.choice((out, out, out, f"<b>{out}</b>", f"<b>{out}<br>", out.replace(" ", ' <a href="/x">y</a> ', 1), out + " &amp; &quot;x&quot;"))

    def block(self) -> str:
        kind = self.rng.random()
        if kind < 0.66:
            return f"<p>{self.prose(6)}" + ("</p>" if self.rng.random() < 0.8 else "")
        if kind < 0.74:
            return f"<h{(k := self.rng.randint(2, 4))}>{self.words(1, 8)}</h{k}>"
        if kind < 0.8:
            return f"<blockquote>{self.prose(3)}</blockquote>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{self.words(2, 14)}</li>" for _ in range(self.rng.randint(1, 4))) + "</ul>"
        if kind < 0.92:
            return f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>"
        if kind < 0.96:
            return f"<p>{self.words(1, 3).capitalize()}.</p>"
        return f"<div>{self.prose(4)}</div>"

    def links(self) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(self.rng.randint(2, 7))) + "</ul>"

    def around(self, kind: tuple[str, ...]) -> str:
        opened = self.rng.choice(kind)
        if kind is MENU:
            body = self.links()
        elif kind is FOOTER:
            body = self.rng.choice((f"&copy; {self.words(1, 2)} &middot; {self.sentence(3, 9)}", self.links() + f"<p>{self.words(2, 6)}</p>"))
        elif kind is HEADER:
            body = self.rng.choice((f'<a href="/">{self.words(1, 3)}</a>', f"<h1>{self.words(1, 3)}</h1><p>{self.words(2, 6)}</p>", f"<p>{self.words(1, 4)}</p>" + self.links()))
        elif kind is FORM:
            body = f'<label>{self.words(1, 3)}</label><input type="text"><button>{self.words(1, 2)}</button><p>{self.words(2, 9)}</p>'
        elif kind is COMMENTS:
            one = lambda: f'<div class="comment"><p>{self.words(1, 2)}</p><p>{self.prose(3)}</p></div>'
            body = f"<h3>{self.words(1, 2)}</h3>" * (self.rng.random() < 0.5) + "".join(one() if self.rng.random() < 0.7 else f"<p>{self.prose(3)}</p>" for _ in range(self.rng.randint(1, 4)))
        else:
            body = self.rng.choice((self.sentence(3, 14), f"<p>{self.prose(2)}</p>", f"<h3>{self.words(1, 3)}</h3>" + self.links(), f"<p>{self.sentence(3, 9)}</p><p>{self.sentence(3, 9)}</p>"))
        return opened + body + close(opened)

    def page(self) -> list[tuple[str, bool]]:
        some = lambda kinds, p: [(self.around(k), False) for k in kinds if self.rng.random() < p]
        opened = self.rng.choice(ARTICLE)
        head = f"<h1>{self.words(2, 9)}</h1>"
        if self.rng.random() < 0.2:
            head = f"<header>{head}</header>"
        inside: list[tuple[str, bool]] = [(head, True)] if self.rng.random() < 0.9 else []
        for _ in range(self.rng.choice((1, 2, 3, 5, 8, 12, 16))):
            inside.append((self.block(), True))
            inside += some((ADVERT, NOTICE, SIDEBAR, FORM), 0.03)
        inside += some((COMMENTS,), 0.12) + some((MENU,), 0.05)
        before, after = some((NOTICE,), 0.2) + some((HEADER,), 0.5) + some((MENU,), 0.8) + some((ADVERT,), 0.5), some((COMMENTS, SIDEBAR, FORM, ADVERT), 0.3)
        if self.rng.random() < 0.3:
            before += some((SIDEBAR,), 0.7)
        after += some((FOOTER,), 0.85) + some((NOTICE,), 0.1)
        return [*before, (opened, True), *inside, (close(opened), True), *after]


def labelled_pages(n: int, seed: int) -> list[list[tuple[str, bool]]]:
    writer = Writer(random.Random(seed))
    return [writer.page() for _ in range(n)]
