"""HTML main-text extraction with a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Up to so many words a block may be known by words that menus, adverts, notices and forms often say.
SHORT = 12
_SENTENCE = re.compile(r"[.!?…。][\"'”»)]*$")
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary "
    "noscript table tbody td tfoot th thead title tr ul".split())
_SKIPPED = frozenset("script style template svg iframe textarea audio video".split())
_SECTIONS = frozenset("article aside body footer form header main nav section".split())
#: Elements that hold blocks together: a step between two blocks depends on whether they share the closest one.
_BOXES = _SECTIONS | {"div", "noscript", "td", "th"}
#: What the start of an element ends, and what such an end does not reach across.
_ENDS = {
    **dict.fromkeys(_BLOCK - {"label", "button", "option", "optgroup"}, (frozenset({"p"}), frozenset("button td th caption table".split()))),
    "li": (frozenset({"li", "p"}), frozenset("ul ol menu dir table".split())), "dd": (frozenset({"dd", "dt", "p"}), frozenset({"dl"})),
    "dt": (frozenset({"dd", "dt", "p"}), frozenset({"dl"})), "option": (frozenset({"option"}), frozenset({"select"})),
    "tr": (frozenset("tr td th".split()), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "body": (frozenset({"head", "title"}), frozenset()),
}


@dataclass
class Block:
    """The text of one leaf of block elements, white space joined."""

    text: str
    tags: tuple[str, ...]
    names: frozenset[str]
    near: frozenset[str]  # names of the closest ancestor that has any
    linked: int
    step: int  # how it follows the block before, see ``steps``
    label: int | None = None


def leaf_blocks(html: str) -> list[Block]:
    """The non-empty leaf blocks of a page, in page order; scripts, styles and comments give none."""
    out: list[Block] = []
    tags: list[str] = []
    names: list[frozenset[str]] = []
    labels: list[int | None] = []
    boxes: list[int] = []
    n_boxes = last_box = last_n = 0
    pieces: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked, last_box, last_n
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                label = next((x for x in reversed(labels) if x is not None), None)
                near = next((x for x in reversed(names) if x), frozenset())
                box = boxes[-1] if boxes else 0
                # A box that was open at the block before encloses that block; one that is still open encloses this one.
                step = 0 if box == last_box else 2 if box <= last_n else 1 if not last_box or last_box in boxes else 3
                last_box, last_n = box, n_boxes
                out.append(Block(text, tuple(tags), frozenset().union(*names), near, linked, step, label))
            pieces.clear()
        linked = 0

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        piece = html[at: m.start() if m else n]
        if piece:
            pieces.append(piece)
            linked += len(piece) * (in_link > 0)
        if m is None:
            break
        at = m.end()
        if m.group().startswith("<![CDATA["):
            continue
        tag = (m.group(2) or m.group(5) or "").lower()
        closing = m.group(1) or m.group(4)
        if tag in _SKIPPED:
            if not closing and not (m.group(3) or m.group(6) or "").endswith("/"):
                end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = max(0, in_link - 1) if closing else 1
        elif tag in _BLOCK:
            flush()
            if closing:
                if tag in tags:
                    keep = len(tags) - 1 - tags[::-1].index(tag)
                    del tags[keep:], names[keep:], labels[keep:], boxes[keep:]
                continue
            ends, walls = _ENDS.get(tag, (frozenset(), frozenset()))
            for i in range(len(tags) - 1, -1, -1):
                if tags[i] in ends:
                    del tags[i:], names[i:], labels[i:], boxes[i:]
                    break
                if tags[i] in walls or tags[i] not in ("p", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "title", "head"):
                    break
            if tag == "hr":
                continue
            found, label = set(), None
            for a in _ATTRIBUTE.finditer(m.group(3) or m.group(6) or ""):
                value = a.group(2) or a.group(3) or a.group(4) or ""
                if a.group(1).lower() == "data-label":
                    label = int(value == "1")
                else:
                    found.update(x.lower() for x in _NAME.findall(value))
            in_link = 0
            tags.append(tag)
            names.append(frozenset(found))
            labels.append(label)
            n_boxes += tag in _BOXES
            boxes.append(n_boxes if tag in _BOXES else boxes[-1] if boxes else 0)
    flush()
    return out


def steps(blocks: list[Block]) -> list[int]:
    """How each block but the first follows the one before: in the same box (0), further in (1), further out (2), or in a box beside (3)."""
    return [b.step for b in blocks[1:]]


def features(block: Block) -> list[str]:
    """Ancestor-tag and text features."""
    words = block.text.count(" ") + 1
    out = [f"in:{t}" for t in set(block.tags)] + [f"name:{x}" for x in block.names]
    out += [f"near:{x}" for x in block.near]
    outer = next((t for t in reversed(block.tags) if t in _SECTIONS), "")
    out.append(f"section:{outer}")
    out.append(f"is:{block.tags[-1] if block.tags else ''}")
    out.append(f"words:{min(words.bit_length(), 6)}")
    out.append(f"linked:{min(3, 4 * block.linked // max(1, len(block.text)))}")
    out.append("sentence" if _SENTENCE.search(block.text) else "no-sentence")
    if any(x in block.text for x in "©|»·"):
        out.append("sign")
    if words <= SHORT:
        out += [f"says:{x}" for x in set(_WORD.findall(block.text.lower())) & _SAID]
    return out


# Names that the labelled pages use; the model learns which side each belongs to.
_GOOD_NAMES = "content post entry story text body articlebody main page single hentry prose markdown"
_BAD_NAMES = {
    "nav": "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager toc skip",
    "header": "header masthead topbar branding logo site-header banner",
    "footer": "footer bottom colophon copyright legal site-footer credits",
    "aside": "sidebar aside rail widget related recommended trending popular tags",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion outbrain",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe paywall warning",
    "form": "form search login signup register contact",
    "comments": "comment comments discussion replies reply disqus respond feedback comment-list reviews review ratings opinions guestbook thread users responses",
    "share": "share sharing social follow tools meta byline",
}
# Words that each kind of block often says; the model learns what they tell.
_SAYINGS = {
    "nav": "home blog news about us contact menu archive products services back next previous top skip to content site map",
    "header": "welcome to the official site of menu search",
    "footer": "all rights reserved copyright privacy policy terms of use imprint powered by contact us",
    "aside": "related articles most read popular recent posts recommended for you tags archives you may also like",
    "ad": "advertisement buy now sale discount save offer free shipping click here sponsored shop today only order limited deal",
    "notice": "we use cookies accept consent this site by continuing you agree to our policy subscribe newsletter sign up close",
    "form": "search log in sign up register email password name submit send your message subscribe forgot",
    "comments": "comments replies leave a reply reviews said wrote says likes report post a comment responses thanks for sharing",
    "share": "share tweet like follow us print email this on save posted by tags",
}
_SAID = frozenset(w for s in _SAYINGS.values() for w in s.split() if len(w) > 2 and w not in ("the", "for", "you", "this", "our", "most", "all", "may", "use"))


def labelled_pages(n: int, seed: int) -> list[str]:
    """Pages made by rule from common layouts; data-label tells main text (1) from the rest (0)."""
    rng = random.Random(seed)
    syllables = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(1)) + rng.choice(["", "n", "r", "s"]) for _ in range(60)]

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def prose(low: int = 1, high: int = 60) -> str:
        return ". ".join(words(low, high).capitalize() for _ in range(rng.randint(1, 4))) + rng.choice([".", ".", ".", "!", "?", ""])

    def named(kind: str) -> str:
        name = rng.choice((_BAD_NAMES[kind] if kind else _GOOD_NAMES).split())
        return f' {rng.choice(["class", "id"])}="{rng.choice(["", "site-", "block ", "js_"])}{name}{rng.choice(["", "-inner", " clearfix", "-wrap"])}"'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 4)}</a></li>' for _ in range(k)) + "</ul>"

    def paragraphs(low: int, high: int) -> str:
        return "".join(f"<p>{prose()}{rng.choice(['</p>', ''])}" for _ in range(rng.randint(low, high)))

    def said(kind: str) -> str:
        """A short phrase of the words that such a block often says."""
        known = _SAYINGS[kind].split()
        at = rng.randrange(len(known))
        return " ".join(known[at: at + rng.randint(1, 5)]).capitalize()

    def content(kind: str) -> str:
        if rng.random() < 0.3:
            return rng.choice([said(kind), f"<p>{said(kind)}{rng.choice(['.', '!', ''])}</p>", f"{said(kind)} {prose(1, 12)}", f'<a href="/z">{said(kind)}</a>'])
        return {
            "nav": lambda: links(rng.randint(2, 7)), "header": lambda: rng.choice([f"<h1>{words(1, 4)}</h1>", f"<div>{words(1, 5)}</div><p>{prose(1, 8)}</p>"]),
            "footer": lambda: rng.choice([f"&copy; {words(1, 4)} &middot; {prose(1, 12)}", f"<p>{prose(1, 20)}</p>", links(3)]),
            "aside": lambda: rng.choice([f"<h3>{words(1, 4)}</h3>{links(3)}", paragraphs(1, 2), prose(1, 20)]),
            "ad": lambda: rng.choice([prose(1, 20), f"<p>{prose(1, 20)}</p>", f"<a href='/b'>{words(2, 8)}</a>"]),
            "notice": lambda: rng.choice([prose(2, 20), f"<p>{prose(2, 25)}</p><button>{words(1, 2)}</button>"]),
            "form": lambda: f"<label>{words(1, 3)}</label><p>{prose(1, 10)}</p><button>{words(1, 2)}</button>",
            "comments": lambda: f"<h3>{words(1, 3)}</h3>" + rng.choice([paragraphs(1, 4), "<ol>" + "".join(f"<li><p>{prose()}</p></li>" for _ in range(rng.randint(1, 3))) + "</ol>"]),
            "share": lambda: rng.choice([words(2, 6), links(3)]),
        }[kind]()

    def rest(kind: str) -> str:
        inner = content(kind)
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        tag = "noscript" if kind == "notice" and rng.random() < 0.2 else own if rng.random() < 0.6 else "div"
        name = named(kind) if tag in ("div", "section") or rng.random() < 0.5 else ""
        return f'<{tag}{name} data-label="0">{inner}</{tag}>'

    def article(bare: bool = False) -> str:
        body = f"<h1>{words(2, 10)}</h1>" if rng.random() < 0.8 else ""
        if body and rng.random() < 0.3:
            body = f"<header>{body}{rng.choice(['', '', f'<p>{prose(2, 20)}</p>'])}</header>"
        for _ in range(rng.randint(1, 8)):
            body += rng.choices([
                lambda: paragraphs(1, 3), lambda: f"<h2>{words(1, 8)}</h2>", lambda: "<ul>" + "".join(f"<li>{prose(1, 20)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>",
                lambda: f"<blockquote><p>{prose()}</p></blockquote>", lambda: f"<pre>{words(1, 30)}</pre>", lambda: f"<p><b>{prose()}<br>",
                lambda: f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", lambda: f"<p>{words(1, 10)} <a href='/y'>{words(1, 5)}</a> {prose()}</p>",
                lambda: f"<figure><figcaption>{prose(1, 12)}</figcaption></figure>", lambda: f"<div>{prose()}</div>", lambda: f"<p>{words(1, 5)} <math><mi>{words(1, 1)}</mi></math> {prose()}</p>",
                lambda: f"<p>{rng.choice([' | ', ' · ', ' » ', ' © ']).join(words(1, 3) for _ in range(rng.randint(1, 8)))}{rng.choice(['', ' |', '.'])}</p>"],
                [8, 2, 2, 1, 1, 2, 1, 3, 1, 2, 1, 2])[0]()
            if rng.random() < 0.3:
                for _ in range(rng.choice([1, 1, 1, 2, 3])):
                    body += rest(rng.choice(["ad", "share", "aside", "notice", "form", "nav", "comments"]))
                if rng.random() < 0.8:
                    body += paragraphs(1, 3)
        if rng.random() < 0.35:
            body += rest("comments")
        if bare:
            return body
        style = rng.random()
        name = named("") if rng.random() < 0.5 else ""
        if style < 0.5:
            return f'<article{name} data-label="1">{body}</article>'
        if style < 0.7:
            return f'<main{name} data-label="1">{body}</main>'
        inner = f'<div{named("")} data-label="1">{body}</div>'
        return f"<article>{inner}</article>" if style < 0.8 else inner

    def in_table() -> str:
        """A page laid out by a table whose cells have no names."""
        def cell(kind: str) -> str:
            row = rng.choice([" ", "<br>", " | "]).join(f'<a href="/t">{rng.choice([said("nav"), words(1, 2)])}</a>' for _ in range(rng.randint(2, 8)))
            return f'<td data-label="0">{row if kind == "nav" else content(kind)}</td>'

        body = article(rng.random() < 0.7)
        sides = [cell("nav") if rng.random() < 0.8 else "", f'<td data-label="1">{body}</td>', cell(rng.choice(["ad", "aside", "nav"])) if rng.random() < 0.6 else ""]
        top = f'<tr>{cell(rng.choice(["header", "nav", "ad"]))}</tr>' if rng.random() < 0.7 else ""
        end = f'<tr>{cell("footer")}</tr>' if rng.random() < 0.7 else ""
        return f"<table>{top}<tr>{''.join(sides)}</tr>{end}</table>"

    pages = []
    for _ in range(n):
        layout = rng.random()
        if layout < 0.25:
            pages.append(f'<html><head><title data-label="0">{words(2, 9)}</title></head><body>{in_table()}</body></html>')
            continue
        before = "".join(rest(k) for k in rng.sample(["nav", "header", "ad", "notice", "form", "share"], rng.randint(0, 4)))
        after = "".join(rest(k) for k in rng.sample(["footer", "aside", "comments", "ad", "notice", "nav", "form", "share"], rng.randint(0, 4)))
        if layout < 0.35:
            pages.append(f'<html><head><title data-label="0">{words(2, 9)}</title></head><body data-label="1">{before}{article(True)}{after}</body></html>')
            continue
        pages.append(f'<html><head><title data-label="0">{words(2, 9)}</title></head><body>{before}{article()}{after}</body></html>')
    return pages


@dataclass
class Crf:
    """Two labels: the weight of label 1 by feature, and scores of neighbouring labels by kind of step."""

    weight: dict[str, float]
    step: list[list[list[float]]]

    def scores(self, rows: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum([get(f, 0.0) for f in row]) for row in rows]

    def decode(self, rows: list[list[str]], kinds: list[int]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not rows:
            return []
        s = self.scores(rows)
        a, b, back = 0.0, s[0], []
        for x, kind in zip(s[1:], kinds):
            (t00, t01), (t10, t11) = self.step[kind]
            from0, from1 = a + t00 < b + t10, a + t01 < b + t11
            back.append((int(from0), int(from1)))
            a, b = max(a + t00, b + t10), max(a + t01, b + t11) + x
        y = int(b > a)
        out = [y]
        for link in reversed(back):
            y = link[y]
            out.append(y)
        return out[::-1]


def _add(a: float, b: float) -> float:
    m = max(a, b)
    return m + log(exp(a - m) + exp(b - m))


def train(pages: list[str], epochs: int = 12, rate: float = 0.3, l2: float = 1e-3, seed: int = 3) -> Crf:
    """Maximise the likelihood of the labels of pages with data-label, by AdaGrad over pages;
    the gradients come from forward-backward."""
    data = []
    for page in pages:
        blocks = leaf_blocks(page)
        if blocks:
            data.append(([features(b) for b in blocks], steps(blocks), [b.label or 0 for b in blocks]))
    crf = Crf({}, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(4)])
    past: dict[object, float] = {}
    rng = random.Random(seed)

    def move(key: object, old: float, gradient: float) -> float:
        gradient -= l2 * old
        past[key] = past.get(key, 1e-6) + gradient * gradient
        return old + rate * gradient / past[key] ** 0.5

    for _ in range(epochs):
        rng.shuffle(data)
        for rows, kinds, y in data:
            s, n = crf.scores(rows), len(rows)
            ts = [crf.step[k] for k in kinds]
            fore, back = [(0.0, s[0])], [(0.0, 0.0)]
            for x, t in zip(s[1:], ts):
                a, b = fore[-1]
                fore.append((_add(a + t[0][0], b + t[1][0]), _add(a + t[0][1], b + t[1][1]) + x))
            for x, t in zip(s[:0:-1], reversed(ts)):
                a, b = back[-1]
                back.append((_add(t[0][0] + a, t[0][1] + x + b), _add(t[1][0] + a, t[1][1] + x + b)))
            back.reverse()
            z = _add(*fore[-1])
            gradient: dict[str, float] = {}
            for i in range(n):
                d = y[i] - exp(fore[i][1] + back[i][1] - z)
                if abs(d) > 1e-4:
                    for f in rows[i]:
                        gradient[f] = gradient.get(f, 0.0) + d
            for i in range(1, n):
                t = ts[i - 1]
                for u in (0, 1):
                    for v in (0, 1):
                        d = (y[i - 1] == u and y[i] == v) - exp(fore[i - 1][u] + t[u][v] + s[i] * v + back[i][v] - z)
                        gradient[kinds[i - 1], u, v] = gradient.get((kinds[i - 1], u, v), 0.0) + d
            for f, d in gradient.items():
                if isinstance(f, tuple):
                    k, u, v = f
                    crf.step[k][u][v] = move(f, crf.step[k][u][v], d)
                else:
                    crf.weight[f] = move(f, crf.weight.get(f, 0.0), d)
    return crf


@lru_cache(2)
def default_model(pages: int = 500, seed: int = 5) -> Crf:
    """Trained on ``pages`` labelled pages, whatever the size of the input."""
    return train(labelled_pages(pages, seed))


def main_text(html: str | None, crf: Crf) -> str:
    """The blocks labelled as main text, joined by an empty line."""
    blocks = leaf_blocks(html) if html else []
    labels = crf.decode([features(b) for b in blocks], steps(blocks))
    return "\n\n".join([b.text for b, y in zip(blocks, labels) if y])


def extract(pages: DataFrame, html_col: str = "html", crf: Crf | None = None) -> DataFrame:
    """The input's columns in a struct ``row``, with ``text``: the main text of the whole page.

    The model has a fixed size, whatever the input, and travels with the function.
    Null and empty pages and pages without main text give an empty text; equal
    pages give equal texts, and rows of one id are rows of their own.  Very long
    pages are read whole, in one pass.  An empty table gives an empty result.
    """
    model = crf or default_model()

    @F.pandas_udf("string")
    def run(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, model) for h in htmls], dtype=object)

    return pages.select(F.struct("*").alias("row"), run(F.col(html_col)).alias("text"))


def page_report(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages."""
    return extract(pages.select("page_id", "url", "html")).select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
