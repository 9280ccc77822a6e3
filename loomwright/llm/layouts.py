"""Labelled pages for training the page model: layouts drawn by a seed, of which every block is known to be main text or not.

A page is put together from parts (menus, headers, adverts, notices, forms, sidebars, an article, comments, footers) in the ways that sites
write them: with the elements made for it, with classes or ids, in tables, or without any hint. Words are drawn from syllables, so that a model
learns structure, lengths and signs rather than words; the few phrases that such parts carry everywhere are plain lists.
"""

from __future__ import annotations

import random

# Begins the text of every main block of a labelled page; no page has it otherwise.
MAIN = "\ue000"

SYLLABLES = "ba ko li me ra so tu vi en der que les ción ung mente the ing and sch eau no pa ti el".split()

# Names that sites give to the parts of their pages.
NAMES = {
    "menu": "nav menu navbar navigation main-menu nav-menu breadcrumb breadcrumbs pagination toc tabs topnav site-nav".split(),
    "header": "header masthead site-header topbar banner branding logo page-header top-bar".split(),
    "footer": "footer site-footer foot bottom copyright page-footer legal colophon".split(),
    "sidebar": "sidebar side-bar aside widget related related-posts recommended popular trending rail right-rail more-stories".split(),
    "notice": "cookie cookie-banner consent gdpr notice alert newsletter subscribe popup modal overlay paywall message disclaimer".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo ad-slot adbox banner-ad promotion".split(),
    "comments": "comments comment comment-list replies disqus discussion respond reader-comments user-comments feedback".split(),
    "share": "share social sharing social-links share-buttons follow share-bar social-icons".split(),
    "main": "article content post entry entry-content post-body article-body story story-body main-content main body-text text prose".split(),
    "wrap": "page wrapper container site layout row col inner page-content outer main-wrapper content-wrapper".split(),
}

PHRASES = {
    "notice": [
        "We use cookies to improve your experience. Accept", "This site uses cookies.", "Subscribe to our newsletter",
        "Wir verwenden Cookies. Zustimmen", "Nous utilisons des cookies.", "Utilizamos cookies propias y de terceros.",
    ],
    "footer": [
        "© 2024 All rights reserved.", "Copyright 2023", "Privacy policy · Terms of use · Contact", "Impressum · Datenschutz",
        "Mentions légales", "Todos los derechos reservados", "© example.org · About us",
    ],
    "comments": ["Leave a reply", "3 comments", "Reply", "Kommentare", "Commentaires", "Comentarios", "Anna says: I agree!", "Log in to comment"],
    "share": ["Share", "Tweet", "Like", "Follow us", "Teilen", "Partager", "Compartir", "Print"],
    "form": ["Search", "E-mail", "Send", "Log in", "Password", "Name", "Suche", "Rechercher", "Buscar"],
    "ad": ["Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad", "Buy now! 50% off", "Click here"],
    "sidebar": ["Related articles", "Most read", "Popular posts", "Read more", "Archive", "Tags"],
}


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.vocabulary = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(200)]

    def words(self, low: int, high: int, end: str = "") -> str:
        out = [self.rng.choice(self.vocabulary) for _ in range(self.rng.randint(low, high))]
        return (" ".join(out).capitalize() if self.rng.random() < 0.7 else " ".join(out)) + end

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18, self.rng.choice(".....!?")) for _ in range(self.rng.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        """Sentences as main text has them: also with signs, numbers and addresses between the words, very long, or a word only."""
        rng, text = self.rng, self.sentences(low, high)
        if rng.random() < 0.25:
            sign = rng.choice(["%%%", "|", "·", "***", "&amp;&amp;", "$$$", "###", "2024", "»", "©", "a@b.org", "http://x.org/y", "–", ":"])
            text = " ".join(w + (f" {sign}" if rng.random() < 0.4 else "") for w in text.split())
        if rng.random() < 0.05:
            text += " " + self.sentences(20, 60)
        return self.words(1, 3, ".") if rng.random() < 0.08 else text

    def unknown(self) -> str:
        """A name that no other element has."""
        return "".join(self.rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))

    def links(self, n: int) -> list[str]:
        return [f'<a href="/{self.rng.choice(self.vocabulary)}">{self.words(1, 3)}</a>' for _ in range(n)]

    def named(self, kind: str, inner: str, tags: str, plain: float = 0.1) -> str:
        """``inner`` in an element of one of ``tags``, usually with a class or an id of this kind."""
        tag, name, r = self.rng.choice(tags.split()), self.rng.choice(NAMES[kind]), self.rng.random()
        attribute = "" if r < plain else f' id="{name}"' if r < 0.4 else f' class="{name}"' if r < 0.8 else f' class="{self.unknown()} {name}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def part(self, kind: str) -> str:
        rng = self.rng
        if kind == "menu":
            items = self.links(rng.randint(2, 9))
            inner = "<ul>" + "".join(f"<li>{a}</li>" for a in items) + "</ul>" if rng.random() < 0.6 else " ".join(items)
            return f"<nav>{inner}</nav>" if rng.random() < 0.5 else self.named(kind, inner, "div ul nav")
        if kind == "header":
            inner = rng.choice([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 6)}</p>", f"<div>{self.words(1, 4)}</div>", " ".join(self.links(4))])
            return f"<header>{inner}</header>" if rng.random() < 0.4 else self.named(kind, inner, "div header")
        if kind == "footer":
            text = rng.choice([rng.choice(PHRASES[kind]), "&copy; site.example &middot; " + self.sentences(1, 3), self.sentences(1, 2)])
            inner = rng.choice([text, f"<p>{text}</p>", f"<p>{text}</p>" + " ".join(self.links(4))])
            return f"<footer>{inner}</footer>" if rng.random() < 0.6 else self.named(kind, inner, "div footer")
        if kind == "sidebar":
            lines = [f"<h3>{rng.choice(PHRASES[kind])}</h3>", f"<p>{self.sentences(1, 2)}</p>", "<ul>" + "".join(f"<li>{a}</li>" for a in self.links(4)) + "</ul>"]
            inner = "".join(rng.sample(lines, rng.randint(1, 3)))
            return f"<aside>{inner}</aside>" if rng.random() < 0.5 else self.named(kind, inner, "div aside section")
        if kind in ("notice", "ad"):
            text = rng.choice([rng.choice(PHRASES[kind]), self.sentences(1, 3)])
            inner = rng.choice([text, f"<p>{text}</p>", f"{text} {self.links(1)[0]}"])
            if kind == "notice" and rng.random() < 0.2:
                how = rng.choice(["noscript", "div hidden", 'div style="display:none"', "dialog"])
                return f"<{how}>{inner}</{how.split()[0]}>"
            return self.named(kind, inner, "div div section p span ins" if kind == "ad" else "div div section dialog", 0)
        if kind == "form":
            a, b = rng.choice(PHRASES[kind]), rng.choice(PHRASES[kind])
            inner = rng.choice([f"{a} <input name=q>", f"<label>{a}</label><input>", f"<p>{self.sentences(1, 2)}</p>", f"<select><option>{a}<option>{b}</select>"])
            return f"<form>{inner}<button>{b}</button></form>"
        if kind == "comments":
            each = [f"<{t}>{self.sentences(1, 4)}</{t}>" for t in [rng.choice(["p", "li", "div", "article"])] for _ in range(rng.randint(1, 5))]
            return self.named(kind, f"<h3>{rng.choice(PHRASES[kind])}</h3>" * (rng.random() < 0.6) + "".join(each), "div section ol ul", 0)
        return self.named("share", " ".join(f'<a href="#">{x}</a>' for x in rng.sample(PHRASES["share"], 3)), "div ul")

    def block(self, tag: str, text: str) -> str:
        return f"<{tag}>{MAIN}{text}</{tag}>"

    def article(self) -> str:
        """The blocks of the main text, with parts that do not belong to it here and there."""
        rng = self.rng
        blocks = [self.block(rng.choice(["h1", "h1", "h2"]), self.words(2, 10))] if rng.random() < 0.85 else []
        if blocks and rng.random() < 0.15:
            blocks = [f"<header>{blocks[0]}</header>"]
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
            r = rng.random()
            text = self.prose(1, 9)
            if r < 0.68:
                bold = rng.random() < 0.3
                blocks.append(f"<p>{MAIN}{'<b>' * bold}{text}{rng.choice(['', '<br>', '</b>' * bold])}" + rng.choice(["</p>", "</p>", ""]))
            elif r < 0.74:
                blocks.append(self.block(rng.choice(["h2", "h3"]), self.words(1, 8)))
            elif r < 0.80:
                blocks.append("<ul>" + "".join(self.block("li", self.prose(1, 2)) for _ in range(rng.randint(1, 5))) + "</ul>")
            elif r < 0.84:
                blocks.append(f"<blockquote>{self.block('p', text)}</blockquote>")
            elif r < 0.87:
                blocks.append("<table><tr>" + "".join(self.block("td", self.words(1, 4)) for _ in range(4)) + "</tr></table>")
            elif r < 0.90:
                blocks.append(f"<figure><img src=x>{self.block('figcaption', self.words(3, 10))}</figure>")
            else:
                blocks.append(self.block("div" if r > 0.97 else "p", text + f' <a href="/x">{self.words(1, 3)}</a> {self.words(2, 9, ".")}'))
        for kind in ("ad", "share", "sidebar", "notice", "form", "menu"):
            if rng.random() < 0.12:
                blocks.insert(rng.randint(0, len(blocks)), self.part(kind))
        if rng.random() < 0.2:
            blocks.append(self.part("comments"))
        return "".join(blocks)

    def html(self) -> str:
        rng, inner = self.rng, self.article()
        how = rng.random()
        if how < 0.4:
            inner = f"<article>{inner}</article>"
        elif how < 0.8:
            inner = self.named("main", inner, "div section article main", 0)
        elif how < 0.9:
            inner = f"<main>{inner}</main>"
        if rng.random() < 0.1:
            inner = f"<table><tr><td>{self.part('menu')}</td><td>{inner}</td></tr></table>"
        before = [self.part(k) for k in ("header", "menu", "notice", "ad", "form", "share", "sidebar") if rng.random() < 0.4]
        after = [self.part(k) for k in ("comments", "share", "sidebar", "ad", "menu", "notice", "form") if rng.random() < 0.3]
        rng.shuffle(before)
        body = "".join(before) + inner + "".join(after)
        for _ in range(rng.choice([0, 0, 1, 2])):
            body = self.named("wrap", body, "div div main section", 0.3)
        body += self.part("footer") if rng.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    """``n`` pages whose main blocks begin with ``MAIN``."""
    rng = random.Random(seed)
    return [_Page(rng).html() for _ in range(n)]
