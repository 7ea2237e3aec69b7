"""Main-text extraction: a linear-chain CRF over DOM leaf blocks, decoded by Viterbi.

A page is cut into leaf blocks: runs of text that no block-level tag interrupts.
Each block has features of its ancestors (tags, classes, ids, roles) and of its
text (length, share of link text, stops, symbols). A chain over the blocks with
the labels content and other is trained on labelled pages by exact likelihood
gradients, and the best label sequence of a page is found by Viterbi.

The labelled pages are made here from a seeded rule: pages of many layouts whose
blocks are known to be article or furniture (menus, headers, footers, sidebars,
notices, adverts, forms, comments). No page of the table read is used for it.

Text: character references decoded, white space inside a block one space,
trimmed, blocks of content joined in page order by one space; nothing else is
dropped or capped. Scripts, styles, templates, markup comments and the head are
never blocks; text of noscript and svg elements is text like any other. Null and
empty html give the empty text. Rows that repeat a page_id are rows of their own;
other columns are ignored; an empty table gives no rows. Unclosed tags end where
their parent does. Pages of any length and depth are read whole: time and memory
grow with the length of the page, however deep its elements nest, since an
element's features are its parent's and what it adds.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ionflow.llm import common

# Tags by what they do to the text.
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template iframe head title textarea".split())
#: Of these, those whose content is text up to the literal end tag.
RAW_TEXT = {t: re.compile(f"</{t}(?=[\\s/>]|\\Z)", re.I) for t in "script style iframe title textarea template".split()}
#: Start tags that do not end a head whose end tag is left out.
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"(class|id|role|hidden|aria-label|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: A p element ends where one of these begins.
_ENDS_P = BLOCK_TAGS - {"br", "button", "option", "select", "optgroup"}
FEATURES_LOG2 = 14


def _raw_end(page: str, at: int, tag: str) -> int:
    """Where the end tag of a raw element's text begins; the page's end if it has none."""
    m = RAW_TEXT[tag].search(page, at)
    return m.start() if m else len(page)


class Element:
    """An open element: its tag, and of the names of tags and attributes those that no ancestor has."""

    __slots__ = ("tag", "parent", "fresh", "near", "sum")

    def __init__(self, tag: str, words: list[str], parent: Element | None, fresh: list[str]):
        self.tag, self.parent, self.fresh = tag, parent, fresh
        #: names of attributes of the nearest element that has some
        self.near: list[str] = words or (parent.near if parent else [])
        self.sum: float | None = None  # of the weights of all names of it and its ancestors

    def names(self) -> list[str]:
        """All names of it and its ancestors, each once."""
        out, own = [], self
        while own is not None:
            out += own.fresh
            own = own.parent
        return out

    def weight(self, w: list[float]) -> float:
        """Sum of the weights of names(); kept, so that each element is summed once, deepest last."""
        path, own = [], self
        while own is not None and own.sum is None:
            path.append(own)
            own = own.parent
        total = own.sum if own is not None else 0.0
        for e in reversed(path):
            total += sum(w[_HASHES[f"in:{x}"]] for x in e.fresh)
            e.sum = total
        return total


def blocks(page: str) -> list[tuple[str, Element | None, int]]:
    """(text, innermost element, link characters) of each leaf block in page order."""
    out: list[tuple[str, Element | None, int]] = []
    stack: list[Element] = []
    named: list[list[str]] = []  # fresh and other names of each element of the stack
    active: dict[str, int] = {}  # how many open elements have a name
    text: list[str] = []
    links = 0
    skip = None  # a raw tag whose end is looked for

    def flush():
        nonlocal links
        if text:
            joined = _SPACE.sub(" ", "".join(text)).strip()
            if joined:
                out.append((joined, stack[-1] if stack else None, links))
            text.clear()
        links = 0

    def close(k: int) -> None:
        """Ends the elements of the stack from place k on."""
        for names in named[k:]:
            for x in names:
                active[x] -= 1
        del stack[k:], named[k:]

    at = 0
    while at < len(page):
        t = _TOKEN.match(page, at).group()
        at += len(t)
        if skip is not None:
            n = _NAME.match(t)
            tag = n[1].lower() if n else None
            if skip == "head" and (t.strip() if t[0] != "<" else tag and (tag not in HEAD_TAGS if t[1] != "/" else tag in ("body", "html", "br"))):
                skip = None  # the end tag of head is left out: this is the body's
            elif tag is None:
                continue
            elif t[1] == "/":
                if tag == skip:
                    skip = None
                continue
            else:
                if tag in RAW_TEXT and not t.endswith("/>"):
                    at = _raw_end(page, at, tag)
                continue
        if t[0] != "<" or len(t) == 1:
            text.append(html.unescape(t))  # references do not go on across tags
            if active.get("a"):
                links += len(t)
            continue
        n = _NAME.match(t)
        if n is None:  # a comment or declaration
            continue
        tag = n[1].lower()
        if t[1] == "/":
            if tag in BLOCK_TAGS:
                flush()
            if active.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in BLOCK_TAGS or tag in RAW_TAGS:
            if tag in BLOCK_TAGS:
                flush()
            if tag in _ENDS_P and active.get("p"):
                k = len(stack) - 1
                while stack[k].tag not in BLOCK_TAGS:
                    k -= 1
                if stack[k].tag == "p":
                    close(k)
        if tag in RAW_TAGS:
            if not t.endswith("/>"):
                if tag in RAW_TEXT:
                    at = _raw_end(page, at, tag)
                else:
                    skip = tag
            continue
        if tag in VOID_TAGS or t.endswith("/>"):
            continue
        words = []
        for key, *values in _ATTR.findall(t[len(tag) + 1 :]):
            key = key.lower()
            words += ["@hidden"] if key == "hidden" else [f"@{w}" for w in _WORDS.findall("".join(values).lower())]
        own = list(dict.fromkeys([tag, *words]))
        stack.append(Element(tag, words, stack[-1] if stack else None, [x for x in own if not active.get(x)]))
        named.append(own)
        for x in own:
            active[x] = active.get(x, 0) + 1
    flush()
    return out


def _bucket(x: float, cuts: tuple[float, ...]) -> int:
    return sum(x >= c for c in cuts)


def _hash(name: str) -> int:
    """A stable hash of a feature name."""
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ (h >> 15)) & ((1 << FEATURES_LOG2) - 1)


class _Hashes(dict):
    def __missing__(self, name):
        if len(self) > 100_000:
            self.clear()
        self[name] = h = _hash(name)
        return h


_HASHES = _Hashes()


#: Lines with an author's date or how long ago it was, and headings that count what readers have written.
_BYLINE = re.compile(r"\b(?:\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{1,2}:\d\d|\d{1,2}\.? \w+ \d{4}|\w+ \d{1,2}, \d{4})\b|\b\d+ \w+ ago\b")
_COUNTED = re.compile(r"\W*(?:\w+ )?\(?\d+\)?(?: \w+)?\W*|\w+ \(\d+\)")


def page_features(found: list[tuple[str, Element | None, int]]) -> list[tuple[list[int], Element | None]]:
    """Of each block hashes of the features of its text and place, and its element, whose names are features too."""
    out, bylines, counted = [], 0, False
    before = False  # whether the block before has a byline
    for text, element, links in found:
        n = len(text)
        byline = n < 100 and _BYLINE.search(text) is not None
        bylines += byline
        counted |= n < 40 and _COUNTED.fullmatch(text) is not None
        own = {
            "bias", f"len:{_bucket(n, (10, 25, 50, 100, 200, 400))}", f"link:{_bucket(links / n, (0.05, 0.3, 0.7))}",
            f"stops:{_bucket(sum(text.count(c) for c in '.!?'), (1, 2, 4))}", f"end:{text[-1] in '.!?…'}", f"bylines:{min(bylines, 3)}", f"byline:{byline}", f"after:{before}", f"counted:{counted}",
        }
        if "©" in text:
            own.add("copyright")
        e = element
        for k in range(3):
            if e is not None:
                own.add(f"up{k}:{e.tag}")
                e = e.parent
        if element is not None:
            own.update(f"near:{x}" for x in element.near)
        out.append(([_HASHES[x] for x in own], element))
        before = byline
    return out


def features(found: list[tuple[str, Element | None, int]]) -> list[list[int]]:
    """All features of each block of a page."""
    return [own + [_HASHES[f"in:{x}"] for x in e.names()] if e is not None else own for own, e in page_features(found)]


class Chain:
    """Weights of a two-label chain; label 1 is content."""

    def __init__(self, w: np.ndarray, trans: np.ndarray):
        self.w, self.trans = w, trans
        self._t = trans.tolist()
        self._w = w.tolist()

    def label(self, found: list[tuple[str, Element | None, int]]) -> list[int]:
        """Labels of a page's blocks."""
        w = self._w
        return self._best([sum(w[i] for i in own) + (e.weight(w) if e is not None else 0.0) for own, e in page_features(found)])

    def viterbi(self, feats: list[list[int]]) -> list[int]:
        """Labels of blocks with these features."""
        w = self._w
        return self._best([sum(w[i] for i in f) for f in feats])

    def _best(self, emissions: list[float]) -> list[int]:
        t = self._t
        a0 = a1 = 0.0
        back = []
        for k, e in enumerate(emissions):
            if k:
                x0, x1 = a0 + t[0][0], a1 + t[1][0]
                y0, y1 = a0 + t[0][1], a1 + t[1][1]
                back.append((x1 > x0, y1 > y0))
                a0, a1 = max(x0, x1), max(y0, y1) + e
            else:
                a1 = e
        label = int(a1 > a0)
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], steps: int = 100, rate: float = 0.3, l2: float = 3e-4) -> Chain:
    """A chain from (features, labels) of pages, by full gradients of the likelihood."""
    n = 1 << FEATURES_LOG2
    w, trans = np.zeros(n), np.zeros((2, 2))
    gw, gt = np.full(n, 1e-8), np.full((2, 2), 1e-8)
    flat = np.array([i for fs, _ in pages for f in fs for i in f])
    row = np.repeat(np.arange(sum(len(fs) for fs, _ in pages)), [len(f) for fs, _ in pages for f in fs])
    gold = np.array([y for _, ys in pages for y in ys], float)
    lens = [len(fs) for fs, _ in pages]
    seen = np.zeros((2, 2))
    for _, ys in pages:
        for a, b in zip(ys, ys[1:]):
            seen[a, b] += 1
    for _ in range(steps):
        e = np.bincount(row, w[flat], minlength=len(gold))
        p, pair, at = np.empty(len(gold)), np.zeros((2, 2)), 0
        m = np.exp(trans)
        for k in lens:
            psi = np.stack([np.ones(k), np.exp(np.clip(e[at : at + k], -30, 30))], axis=1)
            f, b = np.empty((k, 2)), np.ones((k, 2))
            f[0] = psi[0] / psi[0].sum()
            for t in range(1, k):
                x = (f[t - 1] @ m) * psi[t]
                f[t] = x / x.sum()
            for t in range(k - 2, -1, -1):
                x = m @ (psi[t + 1] * b[t + 1])
                b[t] = x / x.sum()
            q = f * b
            p[at : at + k] = q[:, 1] / q.sum(axis=1)
            if k > 1:
                z = f[:-1, :, None] * m[None] * (psi[1:] * b[1:])[:, None, :]
                pair += (z / z.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            at += k
        g = np.bincount(flat, (gold - p)[row], minlength=n) / len(lens) - l2 * w
        gw += g * g
        w += rate * g / np.sqrt(gw)
        g = (seen - pair) / len(lens) - l2 * trans
        gt += g * g
        trans += rate * g / np.sqrt(gt)
    return Chain(w, trans)


# Names that page furniture and articles go by in class, id and role attributes.
_FURNITURE = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topnav mainmenu pagination pager toc skip",
    "header": "header masthead banner topbar branding logo tagline site",
    "footer": "footer copyright colophon legal imprint bottom",
    "aside": "sidebar aside related widget recommended popular trending more tags archive recent links rail",
    "div": "ad ads advert advertisement sponsor sponsored promo promotion notice cookie consent gdpr alert popup modal overlay newsletter subscribe signup share social follow toolbar login search",
    "section": "comments comment replies discussion disqus respond reactions feedback",
    "form": "form search subscribe contact login comment newsletter",
}
_ARTICLE = "article content main post entry story body text page primary maincontent articlebody".split()


def labelled_pages(n: int = 500, seed: int = 3) -> list[tuple[list[list[int]], list[int]]]:
    """Pages of many layouts with the label of each block; made by rule, not taken from data."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice("aeiou" if k % 2 else "bcdfglmnprstv") for k in range(rng.randrange(2, 10)))

    def text(lo: int, hi: int) -> str:
        out = " ".join(word() for _ in range(rng.randint(lo, hi)))
        return out[:1].upper() + out[1:] + rng.choice([".", ".", ".", "!", "?", ""])

    def attr(names: str | list[str]) -> str:
        names = names.split() if isinstance(names, str) else names
        picked = rng.sample(names, min(len(names), rng.choice([0, 1, 1, 1, 2])))
        if not picked:
            return ""
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice([" ", "-"]).join(picked)}"'

    def date() -> str:
        d, m, y = rng.randint(1, 28), rng.randint(1, 12), rng.randint(2000, 2025)
        return rng.choice([f"{d} {word().title()} {y}", f"{word().title()} {d}, {y}", f"{y}-{m:02}-{d:02}", f"{d}.{m}.{y}", f"{d} {word()} ago", f"{d}/{m}/{y} {d % 24}:{m:02}"])

    def thread() -> str:
        """What readers wrote, under names of no list: a heading that counts it, then authors, dates and texts."""
        outer, item = rng.choice([("ol", "li"), ("ul", "li"), ("div", "div"), ("section", "article"), ("section", "div"), ("dl", "dd")])
        names = [f' class="{word()}{rng.choice(["", f" {word()}", f"-{word()}"])}"' if rng.random() < 0.7 else "" for _ in range(3)]
        n, mark = rng.randint(1, 6), rng.choice(["<time>{}</time>", "<span>{}</span>", "<a href='#'>{}</a>", "{}"])
        by = rng.choice([f"<div>{word().title()} {mark}</div>", f"<p><b>{word().title()}</b> {mark}</p>", f"<header>{word().title()}, {mark}</header>"])
        items = "".join(f"<{item}{names[1]}>{by.format(date())}{rng.choice(['<p{}>{}</p>', '<div{}>{}</div>']).format(names[2], text(3, 60))}</{item}>" for _ in range(n))
        head = rng.choice([f"<h3>{n} {word()}</h3>", f"<h2>{word().title()} ({n})</h2>", f"<h4>{word().title()} {n}</h4>", f"<h3>{text(1, 2)}</h3>"])
        return f"{head}<{outer}{names[0]}>{items}</{outer}>"

    def furniture(kind: str) -> str:
        names = _FURNITURE[kind]
        own = attr(names)
        tag = kind if kind not in ("div", "section") or own else "aside"
        if tag not in ("div", "section") and own and rng.random() < 0.25:
            tag = "div"
        if kind == "nav" or (kind in ("footer", "aside") and rng.random() < 0.4):
            inner = "<ul>" + "".join(f'<li><a href="/{word()}">{text(1, 3)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"
        elif kind == "form":
            inner = f"<label>{text(1, 4)}</label><input><button>{text(1, 2)}</button>"
        elif kind == "section" and rng.random() < 0.35:
            return thread()
        elif kind == "section":
            inner = "".join(f"<div{attr('comment reply')}><p>{text(4, 50)}</p></div>" for _ in range(rng.randint(1, 4)))
            own = own or ' class="comments"'
        elif kind == "footer":
            inner = rng.choice(["&copy; ", "© 2020 ", ""]) + f"{word()}.example &middot; {text(3, 30)}"
        elif kind == "header" and rng.random() < 0.5:
            inner = f"<h1>{text(1, 4)}</h1><p>{text(3, 20)}</p>"
        else:
            inner = rng.choice(["<p>{}</p>", "{}", "<span>{}</span>"]).format(text(2, 40))
        return f"<{tag}{own}>{inner}</{tag}>"

    out = []
    while len(out) < n:
        # furniture is marked by a character that no rule above makes
        before = [furniture(k) for k in rng.sample(["nav", "header", "div", "aside", "form"], rng.randint(0, 3))]
        if rng.random() < 0.08:
            before.append(f"<noscript>{rng.choice(['<p>{}</p>', '{}', '<div>{}</div>']).format(text(3, 20))}</noscript>")
        after = [furniture(k) for k in rng.sample(["footer", "aside", "section", "div", "nav", "form"], rng.randint(0, 4))]
        own = []
        if rng.random() < 0.8:
            own.append(f"<h1>{text(2, 12)}</h1>")
        if rng.random() < 0.25:
            own.append(rng.choice(["<p>{} {}</p>", "<div>{}, {}</div>", "<p>{} <time>{}</time></p>"]).format(text(1, 4), date()))
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.56:
                own.append(f"<p>{rng.choice(['', '<b>', '<em>'])}{text(5, 120)}{rng.choice(['</p>', '</p>', '', '<br>' + text(5, 40) + '</p>'])}")
            elif r < 0.66:
                own.append(f"<h2>{text(1, 8)}</h2>")
            elif r < 0.72:
                own.append("<ul>" + "".join(f"<li>{text(2, 20)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif r < 0.75:  # links are text too where an article lists them
                kind = rng.choice(["ul", "ol"])
                own.append(f"<{kind}>" + "".join(f'<li><a href="/{word()}">{text(1, 8)}</a></li>' for _ in range(rng.randint(2, 6))) + f"</{kind}>")
            elif r < 0.76:
                own.append(rng.choice(["<noscript><p>{}</p></noscript>", "<figure><svg><text>{}</text></svg></figure>"]).format(text(3, 30)))
            elif r < 0.79:
                own.append(f"<blockquote>{text(5, 40)}</blockquote>")
            elif r < 0.82:
                own.append(f"<pre>{text(3, 20)}</pre>")
            elif r < 0.85:
                own.append(f"<table><tr><td>{text(1, 5)}</td><td>{text(1, 5)}</td></tr></table>")
            elif r < 0.88:
                own.append(f'<p>{text(3, 20)} <a href="#">{text(1, 4)}</a> {text(3, 20)}</p>')
            else:
                own.append("\0" + furniture(rng.choice(["div", "div", "aside", "form", "nav", "section"])))
        if rng.random() < 0.15:
            own.append("\0" + thread())
        tag = rng.choice(["article", "article", "main", "div", "section"])
        wrap = attr(_ARTICLE) or (' class="content"' if tag in ("div", "section") else "")

        def count(pieces: list[str]) -> int:
            return len(blocks("<body>" + "".join(pieces)))

        def page(*parts: str) -> list:
            return blocks("<html><body>" + "".join(parts))

        whole = page(*before, f"<{tag}{wrap}>", *(x.lstrip("\0") for x in own), f"</{tag}>", *after)
        labels = [0] * count(before)
        for x in own:
            labels += [0 if x[0] == "\0" else 1] * len(page(f"<{tag}>", x.lstrip("\0"), f"</{tag}>"))
        labels += [0] * count(after)
        if len(labels) == len(whole) and whole:
            out.append((features(whole), labels))
    return out


_MODEL: list[Chain] = []


def default_model() -> Chain:
    if not _MODEL:
        _MODEL.append(train(labelled_pages()))
    return _MODEL[0]


def main_text(page: str | None, model: Chain) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    labels = model.label(found)
    return " ".join(b[0] for b, y in zip(found, labels) if y)


def extract(spark: SparkSession, pages: DataFrame, model: Chain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""
    common.ship(spark)
    model = model or default_model()
    w, trans = model.w.astype(np.float32), model.trans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(w, trans)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(x.as_py(), chain) for x in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
