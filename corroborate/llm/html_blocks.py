"""Leaf blocks of an HTML page with their tag paths, and made-up labelled pages to learn from."""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

ATTRS = r"""(?:"[^"]*"|'[^']*'|[^'">])*"""
#: Comments, declarations, elements whose text is no prose (whole), tags. Scripts and the like run to
#: the end of the page if nothing closes them; of the others then only the opening tag is left out.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(script|style|textarea|title|iframe)(?=[\s/>]){ATTRS}>.*?(?:</\1\s*>|\Z)"
    rf"|<svg(?=[\s/>]){ATTRS}(?<=/)>|<(noscript|template|svg|select|object)(?=[\s/>]){ATTRS}>(?:.*?</\2\s*>)?"
    rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>{ATTRS})>",
    re.I | re.S,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr input button br picture source".split())
VOID = frozenset("area base col embed hr link meta param track".split())
#: A new one of these ends an open one.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int  # code points inside links


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    if "=" in attrs:
        for m in NAMES.finditer(attrs):
            out += ["." + x.lower() for x in PART.findall(m[1] or m[2] or m[3] or "")]
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The page's blocks in order: runs of text between block-level tags, white space folded.

    Character references are decoded; comments, scripts, styles and form choices give no text.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, inside, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, tuple(x for _, names in stack for x in names), min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            linked += len(raw.strip()) if inside else 0

    for m in TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in INLINE:
            if tag == "a":
                inside = 0 if m["end"] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        inside = 0
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            ends = CLOSES.get(tag, ("p",))
            while stack and stack[-1][0] in ends:
                stack.pop()
            stack.append((tag, _names(tag, m["attrs"])))
    say(page[at:])
    flush()
    return out


#: In front of a made-up block's text: it belongs to the article.
MINE = "\ue000"
SYLLABLES = "ba ter on li en the sch ung que ment ción ado ar er in tra vo ni pa el os ie au re st nd ha".split()
MENU = "Home About Contact News Products Services Blog Login Register Sports Politics Shop Help Careers Archive Next Previous Top More".split()
NOTICES = "We use cookies to improve this site.|Accept all cookies|By continuing you agree to our privacy policy.|Please enable JavaScript.|Subscribe to our newsletter|Sign up for updates|Enter your email|Advertisement|Sponsored content|Share this article|Follow us on social media|All rights reserved.|© 2024 Example Inc.|Terms of use|Privacy policy|Related articles|Most read|Read more|Leave a reply|Your comment is awaiting moderation.|Search".split("|")
BOXES = {
    "nav": ["<nav>", '<div class="menu">', '<ul class="navbar">', '<div id="breadcrumb">', '<nav class="pagination">', '<div class="nav-links">', '<div role="navigation">'],
    "head": ["<header>", '<div id="header">', '<div class="site-header">', '<div class="masthead">', '<div class="topbar">', '<header class="site">'],
    "foot": ["<footer>", '<div id="footer">', '<div class="site-footer">', '<div class="copyright">', '<footer class="colophon">'],
    "side": ["<aside>", '<div class="sidebar">', '<div class="widget">', '<div class="related">', '<section class="recommended">', '<div id="secondary">', '<div class="popular-posts">'],
    "ad": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="sponsor">', '<div id="banner-ad">', '<div class="promo">', '<div class="adsbygoogle">'],
    "notice": ['<div class="cookie-notice">', '<div class="alert">', '<div id="consent">', '<div class="notice">', '<div role="alert">', '<div class="gdpr-banner">', '<div class="popup modal">', '<div class="warning message">'],
    "form": ['<form action="/s">', '<form class="newsletter">', '<div class="subscribe"><form>', '<form id="search">', '<form class="login-form">'],
    "talk": ['<div id="comments">', '<section class="comments">', '<ol class="comment-list">', '<div class="comment">', '<div class="respond reply">', '<div class="disqus-thread">', '<section class="responses discussion">'],
    "share": ['<div class="share">', '<div class="social-links">', '<ul class="share-buttons">'],
}
BODIES = ["<article>", "<main>", "<main><article>", '<div class="content">', '<div id="content">', '<div class="post">', '<div class="entry-content">', '<div class="article-body">', '<article class="post"><div class="entry">', '<div id="main"><div class="story">', '<section class="text">', "<div>", '<div role="main">']


def _closing(opened: str) -> str:
    return "".join(f"</{x}>" for x in reversed(re.findall(r"<(\w+)", opened)))


def _prose(r: random.Random, n: int) -> str:
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    for k in range(0, n, r.randint(5, 14)):
        words[k] = words[k].capitalize()
        if k:
            words[k - 1] += r.choice([".", ".", ",", "!", "%%%", "&amp;"])
    return " ".join(words)


def made_up_page(r: random.Random) -> str:
    """A page with an article and a random choice of everything that is not part of one."""

    def junk(kind: str) -> str:
        opened = r.choice(BOXES[kind])
        link = lambda x: f'<a href="/{r.randint(1, 99)}">{x}</a>'
        label = lambda: r.choice([r.choice(MENU), _prose(r, r.randint(1, 3))])
        if kind in ("nav", "share") or (kind in ("foot", "side") and r.random() < 0.4):
            inner = "<ul>" + "".join(f"<li>{link(label())}</li>" for _ in range(r.randint(1, 8))) + "</ul>"
        elif kind == "talk":
            inner = r.choice(["", "<h3>Comments</h3>"]) + "".join(r.choice(["<p>{}</p>", '<div class="comment"><b>{}</b><p>{}</p></div>', "<li>{}</li>"]).format(_prose(r, r.randint(1, 60)), _prose(r, r.randint(3, 60))) for _ in range(r.randint(1, 5)))
        elif kind == "form":
            inner = f"<label>{r.choice(NOTICES)}</label><input name=q><button>{r.choice(MENU)}</button>" + r.choice(["", f"<p>{_prose(r, r.randint(2, 20))}</p>"])
        else:
            body = r.choice([r.choice(NOTICES), _prose(r, r.randint(1, 25)), _prose(r, r.randint(10, 70))])
            inner = r.choice(["{}", "<p>{}</p>", "<h2>{}</h2>", "&copy; x &middot; {}", "<h3>" + r.choice(NOTICES) + "</h3><p>{}</p>"]).format(body)
        return opened + inner + _closing(opened)

    def article() -> str:
        opened = r.choice(BODIES)
        title = MINE + _prose(r, r.randint(1, 10))
        out = [opened, r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>", '<h1 class="title">{}</h1>']).format(title)] if r.random() < 0.9 else [opened]
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20, 40])):
            # Article text may be as short as, or the same as, what stands in boxes elsewhere.
            text = MINE + (_prose(r, r.choice([1, 2, 4, 8, 15, 40, 80])) + r.choice(["", "."]) if r.random() < 0.85 else r.choice(NOTICES + MENU))
            out.append(
                r.choice(
                    ["<p>{}</p>"] * 8
                    + ["<p><b>{}<br>", "<p>{}", "<div>{}</div>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<ul><li>{}</li><li>{}</li></ul>", "<ol><li>{}</li></ol>", "<table><tr><td>{}</td><td>{}</td></tr></table>", '<p>{} <a href="/x">this</a></p>', "<figure><figcaption>{}</figcaption></figure>"]
                ).format(text, text)
            )
            if r.random() < 0.06:
                out.append(junk(r.choice(["ad", "share", "side", "form"])))
        if r.random() < 0.15:
            out.append(junk("talk"))
        return "".join(out) + _closing(opened)

    top = [junk(k) for k in ("head", "nav", "notice", "ad", "form") if r.random() < 0.45]
    tail = [junk(k) for k in ("share", "talk", "side", "form", "ad", "notice", "nav", "foot") if r.random() < 0.4]
    r.shuffle(top)
    wrap = r.choice(["", "", "", '<div id="page">', '<div class="wrapper container">'])
    side = junk("side") if r.random() < 0.2 else ""
    page = '<!DOCTYPE html><html><head><title>x</title></head><body>' + wrap + "".join(top) + side + article() + "".join(tail) + _closing(wrap)
    return page + ("</body></html>" if r.random() < 0.9 else "")
