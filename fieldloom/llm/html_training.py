"""Labelled pages for the extraction model, drawn from a seed: marked-up pages whose blocks are known to be article or not."""

from __future__ import annotations

import random

_WORDS = "ba lo mer ti san ko ver du pli gra nos te quin ra fel ost un del".split()
AREAS = {
    "header": (["header"], ["header", "masthead", "top", "topbar", "banner", "site-header", "branding"]),
    "menu": (["nav"], ["nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "links", "toc"]),
    "footer": (["footer"], ["footer", "colophon", "bottom", "site-footer", "copyright", "legal"]),
    "sidebar": (["aside"], ["sidebar", "side", "widget", "related", "aside", "rail", "recommended", "popular"]),
    "notice": (["div", "section"], ["notice", "cookie", "cookie-banner", "consent", "alert", "warning", "message", "gdpr", "privacy", "paywall"]),
    "advert": (["div", "aside", "section"], ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad"]),
    "form": (["form"], ["search", "login", "signup", "subscribe", "newsletter", "contact-form"]),
    "share": (["div", "ul"], ["share", "social", "sharing", "tags", "meta", "byline", "author-box"]),
    "comments": (["section", "div", "ol", "ul"], ["comments", "comment", "comment-list", "commentlist", "disqus", "respond", "discussion", "responses", "replies"]),
}
_BODY = ["content", "post", "entry", "entry-content", "article", "article-body", "story", "main", "text", "body-text", "post-content", "page"]

Block = tuple[str, bool]


def labelled_page(rng: random.Random) -> tuple[str, list[Block]]:
    """(html, blocks): blocks has the text of each leaf block and whether it belongs to the article, in page order."""
    blocks: list[Block] = []

    def words(low: int, high: int) -> str:
        n = rng.randint(low, high)
        w = ["".join(rng.choices(_WORDS, k=rng.randint(1, 4))) for _ in range(n)]
        w[0] = w[0].capitalize()
        return " ".join(x + ("," if rng.random() < 0.08 else ". " + rng.choice(_WORDS).capitalize() if rng.random() < 0.08 else "") for x in w)

    def leaf(tag: str, text: str, main: bool, close: bool = True) -> str:
        text = " ".join(text.split())
        blocks.append((text, main))
        inner = text
        if main and rng.random() < 0.2:
            inner = f"<b>{text}" if rng.random() < 0.5 else f"<em>{text}</em>"
        return f"<{tag}>{inner}" + f"</{tag}>" * close

    def sentence(low=1, high=60) -> str:
        return words(low, high) + rng.choice([".", ".", ".", "", "!", "?"])

    def link_list(main: bool = False) -> str:
        out = []
        for _ in range(rng.randint(2, 8)):
            text = words(1, 3)
            blocks.append((" ".join(text.split()), main))
            out.append(f'<li><a href="/{rng.random()}">{text}</a></li>')
        return f"<ul>{''.join(out)}</ul>"

    def area(kind: str) -> str:
        tags, names = AREAS[kind]
        tag = rng.choice(tags) if rng.random() < 0.55 else "div"
        semantic = tag not in ("div", "section", "ul", "ol")
        marks = f' {rng.choice(["class", "id"])}="{rng.choice(names)}"' if not semantic or rng.random() < 0.5 else ""
        inner = []
        if kind == "menu":
            inner.append(link_list())
        elif kind == "comments":
            if rng.random() < 0.6:
                inner.append(leaf("h3", words(1, 3), False))
            for _ in range(rng.randint(1, 5)):
                t = rng.choice(["div", "article", "li"])
                c = f' class="{rng.choice(["comment", "reply", "comment-body", "response"])}"' if rng.random() < 0.7 else ""
                inner.append(f"<{t}{c}>" + (leaf("p", words(1, 2), False) if rng.random() < 0.4 else "") + leaf("p", sentence(1, 50), False) + f"</{t}>")
        elif kind == "form":
            inner.append(leaf("p", words(1, 6), False))
            inner.append('<input type="text" name="q">' + leaf("button", words(1, 2), False))
        elif kind == "footer":
            inner.append(leaf("p", f"© {words(2, 12)}", False) if rng.random() < 0.6 else leaf("div", f"© {words(1, 2)} · {sentence(2, 14)}", False))
            if rng.random() < 0.5:
                inner.append(link_list())
        else:
            for _ in range(rng.randint(1, 3)):
                inner.append(leaf(rng.choice(["p", "div", "h3", "p"]), sentence(1, 30), False))
            if rng.random() < 0.3:
                inner.append(link_list())
        return f"<{tag}{marks}>{''.join(inner)}</{tag}>"

    def article() -> str:
        how = rng.random()
        if how < 0.45:
            opening, closing = "<article>", "</article>"
        elif how < 0.6:
            opening, closing = "<main>", "</main>"
        elif how < 0.7:
            opening, closing = f'<main><article class="{rng.choice(_BODY)}">', "</article></main>"
        elif how < 0.92:
            opening, closing = f'<div {rng.choice(["class", "id"])}="{rng.choice(_BODY)}">', "</div>"
        elif how < 0.97:
            opening, closing = "<div>", "</div>"
        else:
            opening, closing = "", ""
        out = [opening]
        if rng.random() < 0.85:
            out.append(leaf("h1", words(2, 12), True))
        if rng.random() < 0.2:
            out.append(area("share"))
        for _ in range(rng.randint(1, 10)):
            kind = rng.random()
            if kind < 0.75:
                out.append(leaf("p", sentence(1, 80) if rng.random() < 0.8 else sentence(1, 3), True, rng.random() < 0.9))
            elif kind < 0.82:
                out.append(leaf("h2", words(1, 8), True))
            elif kind < 0.88:
                out.append("<ul>" + "".join(leaf("li", sentence(1, 20), True) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.92:
                out.append("<blockquote>" + leaf("p", sentence(3, 30), True) + "</blockquote>")
            elif kind < 0.94:
                out.append("<table><tr>" + "".join(leaf("td", words(1, 3), True) for _ in range(4)) + "</tr></table>")
            else:
                out.append(area(rng.choice(["advert", "sidebar", "notice", "form", "share"])))
        if rng.random() < 0.15:
            out.append(area("comments"))
        return "".join(out) + closing

    before = [k for k in ("notice", "header", "menu", "advert", "form", "sidebar") if rng.random() < 0.5]
    after = [k for k in ("share", "comments", "sidebar", "advert", "form", "notice", "menu") if rng.random() < 0.4] + ["footer"] * (rng.random() < 0.85)
    rng.shuffle(before)
    html = ["<!DOCTYPE html><html><head><title>", words(2, 6), "</title><style>p{margin:0}</style><script>if (a < b) x()</script></head><body>"]
    html += [area(k) for k in before]
    if rng.random() < 0.95:
        html.append(article())
    html += [area(k) for k in after]
    return "".join(html) + "</body></html>", [b for b in blocks if b[0]]


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, list[Block]]]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(n)]
