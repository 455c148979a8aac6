"""Main text of web pages: boosted trees over DOM nodes, decoded from the root down."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import id_back, id_text
from riskloom.llm.trees import BoostedTrees

# Fixed values of the markup language: elements without content, with raw text, and those that form blocks.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video xmp noembed noframes".split())
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr caption ul select option button legend head optgroup".split()
)
# A start tag ends open elements of these names, up to the nearest of the limits.
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_CONTROLS = frozenset("select option button optgroup input label textarea".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]+|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop|hidden|data-[\w-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Tokens of class, id, role and label, by what they suggest.
_TOKENS = {
    "main": "article content main post entry story body text prose page hentry blogpost maincontent articlebody read copy",
    "menu": "nav navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc topbar navbar sitemap skip",
    "head": "header masthead banner logo branding topnav hero",
    "foot": "footer foot copyright colophon legal bottom credits",
    "side": "sidebar aside side rail widget related recommended recommendations trending popular more teaser",
    "note": "cookie cookies consent gdpr notice notification alert popup modal overlay toast warning disclaimer privacy message announcement",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp adslot adsense partner outbrain taboola commercial",
    "form": "form search login signup signin subscribe subscription newsletter register input contact feedback",
    "talk": "comment comments reply replies respond disqus thread commentlist reader",
    "share": "share sharing social follow tweet facebook like tags tag author byline meta",
    "either": "discussion responses response reviews review opinion opinions feedback",  # of readers, or a part of the article
}
#: What notices say, with a label or without.
_CUE = re.compile(r"\b(?:uses? cookies|(?:accept|reject|allow|manage|all) (?:all )?cookies|cookie (?:policy|settings|preferences)|your consent|gdpr|(?:our|see|the) privacy policy|ad ?blocker|leave a (?:comment|reply)|log in to (?:comment|reply))\b|^\d+ (?:comments?|repl(?:y|ies)|responses?)\b|^(?:comments|replies|responses)\W*$", re.I)
_KIND_OF = {}
for _kind, (_name, _words) in enumerate(_TOKENS.items()):
    for _w in _words.split():
        _KIND_OF.setdefault(_w, []).append(_kind)
_KINDS = len(_TOKENS)
_TAG_GROUPS = {"nav": 1, "menu": 1, "header": 2, "footer": 3, "aside": 4, "form": 5, "fieldset": 5, "search": 5, "button": 5, "select": 5, "article": 6, "main": 7, "section": 8, "div": 9, "p": 10, "ul": 11, "ol": 11, "dl": 11, "li": 12, "dd": 12, "dt": 12, "table": 13, "tr": 13, "td": 13, "th": 13, "tbody": 13, "blockquote": 14, "pre": 14, "figure": 14, "figcaption": 14, "dialog": 15, "body": 16, "html": 16, "center": 9}
for _h in "123456":
    _TAG_GROUPS[f"h{_h}"] = 17
_GROUPS = 18


class Page:
    """Block elements of a page as parallel lists, in page order, and its text blocks.

    ``parent`` of an element is the nearest block element around it; text and links count for that element too.
    """

    __slots__ = ("parent", "group", "depth", "kinds", "chars", "links", "stops", "cues", "tags", "order", "blocks")

    def __init__(self, html: str):
        self.parent, self.group, self.depth, self.kinds = [-1], [16], [0], [(0,) * _KINDS]
        self.chars, self.links, self.stops, self.cues, self.tags, self.order = [0], [0], [0], [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = [("#root", 0)]
        block, text, link, skip, seen = 0, [], 0, 0, 0
        opened: dict[str, int] = {}  # names on the stack, so that stray end tags needn't search it

        def flush() -> None:
            nonlocal text
            if text:
                line = " ".join(unescape("".join(text)).split())
                text = []
                if line:
                    self.blocks.append((block, line))
                    self.chars[block] += len(line)
                    if _CUE.search(line):
                        self.cues[block] += len(line)
                    self.stops[block] += line.count(". ") + line.count(", ") + line.endswith((".", "!", "?"))

        def close(k: int) -> None:
            nonlocal block, link, skip
            for name, _ in stack[k:]:
                opened[name] -= 1
                if name in _BLOCK:
                    flush()
                elif name == "a":
                    link -= 1
                if name in _CONTROLS:
                    skip -= 1
            del stack[k:]
            block = stack[-1][1]

        at, raw = 0, None
        for m in _TAG.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at and not skip:
                piece = html[at : m.start()]
                text.append(piece)
                if link:
                    self.links[block] += len(piece)
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            self.tags[block] += 1
            if m[1]:
                if name == "br":
                    text.append(" ")
                    continue
                if not opened.get(name):
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                    if name not in _BLOCK and stack[k][0] in _BLOCK:
                        break  # a stray end of an inline element ends no block
                continue
            if name in _RAW:
                raw = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = raw.end() if raw else (at if m[3].rstrip().endswith("/") else len(html))
                continue
            if name in _VOID:
                if name in ("br", "img", "input", "wbr"):
                    text.append("" if name == "wbr" else " ")
                elif name == "hr":
                    flush()
                continue
            if name in _P_ENDS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in _BLOCK:
                        break
            if name in _ENDS:
                names, limits = _ENDS[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in limits:
                        break
                    if stack[k][0] in names:
                        close(k)
                        if name not in ("tr", "tbody", "thead", "tfoot"):
                            break
            if name in _CONTROLS:
                skip += 1
            if name in _BLOCK:
                flush()
                seen += 1
                kinds = [0] * _KINDS
                if m[3] and not m[3].isspace():
                    for a in _ATTRIBUTE.finditer(m[3]):
                        for w in _WORD.findall(a[2] or a[3] or a[4] or ""):
                            for k in _KIND_OF.get(w.lower(), ()):
                                kinds[k] += 1
                        if a[1].lower() == "hidden":
                            kinds[5] += 1
                self.parent.append(block)
                self.group.append(_TAG_GROUPS.get(name, 0))
                self.depth.append(self.depth[block] + 1)
                self.kinds.append(tuple(kinds))
                for values in (self.chars, self.links, self.stops, self.tags, self.cues):
                    values.append(0)
                self.order.append(seen)
                block = len(self.parent) - 1
            elif name == "a":
                link += 1
            stack.append((name, block))
            opened[name] = opened.get(name, 0) + 1
        if at < len(html) and not skip:
            text.append(html[at:])
        close(1)
        flush()


def node_features(page: Page) -> np.ndarray:
    """Per block element: tag, attribute tokens of itself, those around and those inside it, subtree densities, words of notices, depth, siblings, place."""
    n = len(page.parent)
    parent = np.asarray(page.parent)
    own = np.array([page.chars, page.links, page.stops, page.tags], np.float64).T
    sub = np.hstack([own, np.ones((n, 1)), np.asarray(page.cues, np.float64)[:, None]])
    kinds = np.minimum(np.asarray(page.kinds, np.float64), 2)
    below = np.zeros_like(kinds)
    for i in range(n - 1, 0, -1):  # children come after their parents
        sub[parent[i]] += sub[i]
        below[parent[i]] = np.maximum(below[parent[i]], np.maximum(below[i], kinds[i]))
    group = np.asarray(page.group)
    around, group_around = kinds.copy(), np.zeros((n, _GROUPS))
    group_around[np.arange(n), group] = 1
    siblings, place = np.zeros(n), np.zeros(n)
    for i in range(1, n):
        p = parent[i]
        around[i] = np.maximum(around[i], around[p])
        group_around[i] = np.maximum(group_around[i], group_around[p])
        place[i] = siblings[p]
        siblings[p] += 1
    total = max(sub[0, 0], 1.0)
    up = np.maximum(parent, 0)
    chars = sub[:, 0]
    dense = np.stack([
        np.log1p(chars), np.log1p(own[:, 0]), np.minimum(sub[:, 1] / np.maximum(chars, 1), 2), sub[:, 2] / np.maximum(chars, 1) * 100, sub[:, 3] / np.maximum(chars, 1) * 100,
        np.log1p(sub[:, 4]), chars / sub[:, 4], chars / total, chars / np.maximum(chars[up], 1), np.asarray(page.depth, np.float64),
        siblings[up], place, np.asarray(page.order) / n, siblings, sub[:, 5] / np.maximum(chars, 1), np.log1p(_largest_beside(parent, chars)),
    ], axis=1)
    one_hot = np.zeros((n, _GROUPS))
    one_hot[np.arange(n), group] = 1
    return np.hstack([dense, one_hot, kinds, around, below, group_around[:, [1, 2, 3, 4, 5, 6, 7, 15]]])


def _largest_beside(parent: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Per element the most text of any other child of its parent."""
    first, second = np.zeros(len(parent)), np.zeros(len(parent))
    for i in range(1, len(parent)):
        p, c = parent[i], chars[i]
        if c > first[p]:
            first[p], second[p] = c, first[p]
        elif c > second[p]:
            second[p] = c
    up = np.maximum(parent, 0)
    return np.where(chars < first[up], first[up], second[up])


def decode(parent: list[int], margins: np.ndarray) -> np.ndarray:
    """The likeliest labelling in which nothing inside a dropped element is kept; the root is kept.

    For each element: the best log likelihood of its subtree if it is kept (its children choose) and if all is dropped.
    """
    n = len(parent)
    keep, drop = -np.logaddexp(0, -margins), -np.logaddexp(0, margins)
    for i in range(n - 1, 0, -1):
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    kept = np.ones(n, bool)
    for i in range(1, n):
        kept[i] = kept[parent[i]] and keep[i] >= drop[i]
    return kept


# -- Training pages: made from templates under a fixed seed, with the label of every block element known.

_SYLLABLES = "ka lo mi ter san ve ru in da pol es qui bra no far el thi mon ge ur".split()


def _prose(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
    for i in range(len(words)):
        if r.random() < 0.12:
            words[i] += r.choice([".", ".", ",", ";", "?"])
    return " ".join(words).capitalize() + r.choice([".", ".", ""])


def _linked_prose(r: random.Random, low: int, high: int) -> str:
    words = _prose(r, low, high).split(" ")
    for _ in range(r.choice([0, 0, 0, 1, 1, 2, 3])):
        k = r.randrange(len(words))
        words[k] = r.choice(['<a href="/z">{}</a>', "<em>{}</em>", "<b>{}</b>", "<code>{}</code>", "{}&amp;{}"]).format(words[k], "x") if "<" not in words[k] else words[k]
    return " ".join(words)


def _links(r: random.Random) -> str:
    n = r.randint(2, 9)
    items = [f'<a href="/{k}">{_prose(r, 1, 3)}</a>' for k in range(n)]
    return r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items), lambda: "<p>" + " ".join(items) + "</p>"])()


def _named(r: random.Random, tag: str, kind: str, inside: str, must: bool = False) -> str:
    name = r.choice(_TOKENS[kind].split())
    attr = r.choice([f' class="{name}"', f' id="{name}"', f' class="{name}-{r.choice(["box", "wrap", "area", "1", "inner"])}"', f' class="{r.choice(["site", "page", "top", "x"])}-{name}"'])
    return f"<{tag}{attr if must or r.random() < 0.5 else ''}>{inside}</{tag}>"


def _boilerplate(r: random.Random) -> str:
    kind = r.choice(["menu", "menu", "head", "foot", "side", "note", "advert", "form", "talk", "share"])
    prose, links = _prose(r, 1, 40), _links(r)
    short = _prose(r, 1, 9)
    inside = {
        "menu": r.choice([links, links, links, f'<a href="/">{short}</a> &gt; {_prose(r, 1, 4)}', short, f"<p>{prose}</p>"]), "head": r.choice([short, f"<h1>{short}</h1>{links}", f"<div>{short}</div>", f"<p>{prose}</p>"]), "foot": r.choice([f"&copy; {short}", f"<p>&copy; {prose}</p>{links}", prose, links]),
        "side": r.choice([f"<h3>{short}</h3>{links}", f"<p>{prose}</p>", prose, f"<h2>{short}</h2><p>{prose}</p>{links}"]), "note": r.choice([f"<p>{prose}</p><button>{short}</button>", prose, f"{prose} <a href='/c'>{short}</a>"]),
        "advert": r.choice([prose, f"<p>{prose}</p>", f'<a href="/x">{prose}</a>', f"<div>{prose}</div><div>{short}</div>", f"{prose}\n{_prose(r, 2, 20)}"]),
        "form": r.choice([f"<p>{short}</p>", f"<label>{short}</label><input name=q><button>{short}</button>", f"<p>{prose}</p><input><select><option>{short}<option>{short}</select>", f"<h3>{short}</h3><p>{prose}</p><input type=submit>", prose]),
        "talk": f"<h3>{r.choice([short, r.choice(_TALKS)])}</h3>" * (r.random() < 0.7) + "".join(r.choice(["<div class=comment>{}</div>", "<li><p>{}</p></li>", "<p>{}</p>", "<div><b>x</b> <p>{}</p></div>", "<article>{}</article>"]).format(_prose(r, 3, 60)) for _ in range(r.randint(1, 5))),
        "share": r.choice([links, links, short, f"<p>{prose}</p>"]),
    }[kind]
    tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "note": r.choice(["dialog", "div"]), "talk": "section"}.get(kind, "div")
    plain = r.random() < 0.4 or tag in ("div", "section", "dialog")
    if plain and kind in ("form", "menu", "side", "foot") and r.random() < 0.5:
        inside = f"<{tag}>{inside}</{tag}>"
    if kind == "talk" and r.random() < 0.3:  # named like a part of the article, but made of readers' entries
        kind, inside = "either", f"<h3>{r.choice([short, *_TALKS])}</h3>" + "".join(r.choice(["<div class=comment>{}</div>", '<li class="reply"><p>{}</p></li>', '<div class="reader-entry"><b>x</b> <p>{}</p></div>']).format(_prose(r, 3, 60)) for _ in range(r.randint(1, 6)))
    out = _named(r, r.choice(["div", "div", "section", "ul" if "<li>" in inside[:8] else "div"]) if plain and tag != "dialog" else tag, kind, inside, must=plain)
    return out if r.random() < 0.8 else _named(r, "div", kind, out)


_NOTICES = ("We use cookies", "This site uses cookies", "Accept all cookies", "By continuing you accept our privacy policy", "Your consent", "Read our cookie policy and terms of use", "Please turn off your ad blocker")
_TALKS = ("3 comments", "12 replies", "1 response", "Comments", "Replies", "Leave a comment", "Leave a reply")


def _unlabelled(r: random.Random) -> str:
    """A notice or a menu that only its words or links give away."""
    said = f"{r.choice(_NOTICES)} {_prose(r, 1, 18).lower()}"
    links = " ".join(f'<a href="/{k}">{_prose(r, 1, 2)}</a>' for k in range(r.randint(2, 7)))
    return r.choice(["<p>{}</p>", "<div>{}</div>", "<div><p>{}</p></div>"]).format(r.choice([said, said, f"{said} <a href='/c'>{_prose(r, 1, 2)}</a>", links]))


def _passage(r: random.Random) -> str:
    if r.random() < 0.05:
        parts = "".join(f"<p>{_linked_prose(r, 5, 80)}</p>" for _ in range(r.randint(1, 4)))
        return _named(r, r.choice(["section", "section", "div"]), r.choice(["either", "either", "main"]), f"<h2>{_prose(r, 1, 4)}</h2>{parts}", must=True)
    x = r.random()
    if x < 0.66:
        lead = r.choice(["", "", "", "<b>", "<i>", '<a href="/y">x</a> '])
        told = f" {r.choice(_NOTICES).lower()} {_prose(r, 5, 40).lower()}" if r.random() < 0.02 else ""  # articles speak of such things too
        return f"<p>{lead}{_linked_prose(r, 1, r.choice([8, 30, 120]))}{told}" + r.choice(["</p>", "</p>", "</p>", "", "<br>"])
    if x < 0.76:
        tag = r.choice(["h2", "h3", "h4"])
        return f"<{tag}>{_prose(r, 1, 9)}</{tag}>"
    if x < 0.84:
        tag = r.choice(["ul", "ol"])
        return f"<{tag}>" + "".join(f"<li>{_linked_prose(r, 1, 25)}" + r.choice(["</li>", ""]) for _ in range(r.randint(1, 6))) + f"</{tag}>"
    if x < 0.88:
        return f"<blockquote><p>{_prose(r, 5, 50)}</p></blockquote>"
    if x < 0.91:
        return "<table>" + "".join(f"<tr><td>{_prose(r, 1, 4)}<td>{_prose(r, 1, 4)}</tr>" for _ in range(r.randint(1, 4))) + "</table>"
    if x < 0.94:
        return f"<pre>{_prose(r, 3, 20)}</pre>"
    return f"<div>{_prose(r, 1, 80)}</div>"


def _training_page(r: random.Random) -> tuple[Page, np.ndarray]:
    """A page whose wanted text is marked by a letter that occurs nowhere else."""
    mark = "‡"
    passages = [_passage(r) for _ in range(r.randint(1, 12))]
    title = r.choice([f"<h1>{_prose(r, 1, 10)}</h1>", f"<h1>{_prose(r, 1, 10)}</h1>", f"<h2>{_prose(r, 1, 10)}</h2>", ""])
    body = [re.sub(r"<(?:p|h\d|li|td|pre|div)>(?:<[^p/][^>]*>)*", lambda m: m[0] + mark, x) for x in [title, *passages] if x]
    for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
        body.insert(r.randint(1, len(body)), _boilerplate(r))
    tag = r.choice(["article", "article", "main", "div", "div", "section", "body"])
    inner = "".join(body)
    content = inner if tag == "body" else _named(r, tag, "main", inner) if r.random() < 0.7 else f"<{tag}>{inner}</{tag}>"
    if r.random() < 0.4:
        content = r.choice(["<main>{}</main>", '<div id="wrap">{}</div>', '<div class="container"><div class="row">{}</div></div>', "<section>{}</section>"]).format(content)
    if r.random() < 0.12:  # a table for a layout: menu cells beside the article's
        plain = ' '.join(_prose(r, 1, 1).rstrip('.') for _ in range(r.randint(1, 6)))
        cells = [f"<td>{r.choice([_links(r), plain, plain, _boilerplate(r)])}</td>" for _ in range(r.randint(1, 2))]
        cells.insert(r.randint(0, len(cells)), f"<td>{content}</td>")
        content = f"<table{r.choice(['', ' width=100%'])}>{r.choice(['', f'<tr><td colspan=2>{_links(r)}</td></tr>'])}<tr>{''.join(cells)}</tr></table>"
    before, after = ([_boilerplate(r) if r.random() < 0.85 else _unlabelled(r) for _ in range(r.randint(0, 3))] for _ in range(2))
    page = Page(f"<html><head><title>x</title></head><body>{''.join(before)}{content}{''.join(after)}</body></html>")
    wanted = np.zeros(len(page.parent))
    for node, line in page.blocks:
        if mark in line:
            wanted[node] = 1
    for i in range(len(wanted) - 1, 0, -1):
        wanted[page.parent[i]] = max(wanted[page.parent[i]], wanted[i])
    full = np.zeros(len(wanted))
    for node, _ in page.blocks:
        full[node] = 1
    for i in range(len(full) - 1, 0, -1):
        full[page.parent[i]] = max(full[page.parent[i]], full[i])
    for i in range(1, len(wanted)):  # empty elements follow their parent
        if not full[i]:
            wanted[i] = wanted[page.parent[i]]
    return page, wanted


@cache
def trained_model(pages: int = 1800, seed: int = 5) -> BoostedTrees:
    """The node classifier, fitted on the driver to generated pages, always the same: some fifteen seconds, once for a session."""
    r = random.Random(seed)
    made = [_training_page(r) for _ in range(pages)]
    return BoostedTrees().fit(np.vstack([node_features(p) for p, _ in made]), np.concatenate([y for _, y in made]))


def main_text(html: str | None, model: BoostedTrees) -> str:
    return main_texts([html], model)[0]


def main_texts(htmls: list[str | None], model: BoostedTrees) -> list[str]:
    pages = [Page(h or "") for h in htmls]
    features = [node_features(p) for p in pages]
    margins = model.margins(np.vstack(features)) if pages else np.zeros(0)
    out, at = [], 0
    for p in pages:
        n = len(p.parent)
        kept = decode(p.parent, margins[at : at + n])
        at += n
        out.append("\n".join(line for node, line in p.blocks if kept[node]))
    return out


def extract_main_text(pages: DataFrame, *, model: BoostedTrees | None = None) -> DataFrame:
    """``page_id, url, text, n_chars``: the article of each row of ``pages (page_id, url, html, ...)``.

    Each block element's log odds come from boosted trees (``trained_model`` unless one is given) over its features;
    the labelling of the whole tree is then the likeliest without contradiction between elements and those
    inside them (``decode``). Character references are decoded, white space in a block becomes one space, blocks are
    joined by line breaks. Scripts, styles, comments in the markup and controls are never text.

    Null and empty html give an empty text. Broken markup is read as far as it goes; html of any length is read whole, in time that grows with it. Null ids and urls and repeated
    rows are kept; other columns are ignored; an empty table gives an empty result. Nothing is shuffled.
    """
    fitted = model or trained_model()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            htmls = batch["html"].tolist()
            for i in range(0, len(htmls), 256):
                texts += main_texts(htmls[i : i + 256], fitted)
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(id_text("page_id"), F.col("url").cast("string"), "html")
    return id_back(rows.mapInPandas(work, "page_id string, url string, text string, n_chars bigint"), "page_id")
