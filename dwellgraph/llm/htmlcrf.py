"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of blocks: the text between two block-level tags, with the tags and class or id words of its ancestors. Each block has binary
features of its ancestors and of its text; neighbouring labels depend on each other. Weights maximise the likelihood of labelled pages, laid out
by `layouts` from common page designs with words of the given pages' own texts (at most TRAINING_PAGES of them); pages are decoded by Viterbi.

Defined cases: null or empty html gives an empty text; scripts, styles, comments and other content that is never shown are dropped before blocks are
made; unclosed and stray tags are tolerated, an unclosed comment, script or style runs to the end,
while other hidden elements drop what is up to their own end tag, or nothing if they have none or are self-closed; pages of any length are decoded whole; repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import slices, texts_of

# Fixed values of HTML: elements by how they are shown.
RAW = ("script", "style")
HIDDEN = ("noscript", "template", "svg", "iframe", "object", "canvas", "audio", "video")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data dfn em font i img input ins del kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table div article section main aside nav header footer form body".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[a-z][a-z0-9:-]*)[^>]*>",
    re.S | re.I,
)
HAS_HIDDEN = re.compile("<(?:" + "|".join(HIDDEN) + r")(?=[\s/>])", re.I)
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
NAME_WORD = re.compile(r"[a-z]+")
TRAINING_PAGES = 400
EPOCHS, RATE, DECAY = 8, 0.3, 1e-4


@dataclass
class Block:
    text: str
    path: list[tuple[str, tuple[str, ...]]]  # ancestors: tag, words of class, id and role
    linked: int = 0  # characters inside links
    features: list[str] = field(default_factory=list)


def hidden_parts(page: str) -> dict[int, int]:
    """Begin and end of the HIDDEN elements that have an end tag of their own."""
    out: dict[int, int] = {}
    if not HAS_HIDDEN.search(page):
        return out
    begun: dict[str, list[int]] = {name: [] for name in HIDDEN}
    for m in TOKEN.finditer(page):
        opened = begun.get((m["tag"] or m["tag2"] or "").lower())
        if opened is None:
            continue
        if not (m["close"] or m["close2"]):
            if not SELF_CLOSED.search(m["attrs"] or ""):
                opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order, with character references decoded and white space folded."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    held: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(t for t, _ in held)).split())
            if text:
                out.append(Block(text, list(stack), sum(len(t) for t, linked in held if linked)))
            held.clear()

    at = 0
    hidden = hidden_parts(page)
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue  # inside a hidden element
        if m.start() > at:
            held.append((page[at : m.start()], links > 0))
        at = hidden.get(m.start(), m.end())
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag or tag in HIDDEN:
            continue
        closing = bool(m["close"] or m["close2"])
        if tag in INLINE:
            if tag == "br":
                held.append((" ", False))
            elif tag == "a":
                links = max(0, links + (-1 if closing else 1))
            continue
        flush()
        links = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body") and tag in ("p", "div", "li", "span"):
                    break  # a stray end tag doesn't close the page's frame
            continue
        while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSED_BY_SIBLING.get(tag, ()) or (re.fullmatch("h[1-6]", stack[-1][0]) and tag in CONTAINERS)):
            stack.pop()
        if tag not in VOID:
            names = tuple(w for found in NAMED.findall(m["attrs"] or "") for w in NAME_WORD.findall("".join(found).lower()))
            stack.append((tag, names))
    if at < len(page):
        held.append((page[at:], links > 0))
    flush()
    return out


def describe(blocks: list[Block]) -> list[list[str]]:
    """Features of each block: its ancestors, its text, and where it stands."""
    n = len(blocks)
    out = []
    for k, b in enumerate(blocks):
        tags = [t for t, _ in b.path]
        names = {w for _, ws in b.path for w in ws}
        words = b.text.count(" ") + 1
        f = ["bias", f"own:{tags[-1] if tags else '-'}", f"words:{min(6, words.bit_length())}", f"links:{min(3, 4 * b.linked // max(1, len(b.text)))}"]
        f += [f"in:{t}" for t in set(tags)] + [f"name:{w}" for w in names]
        last = b.text[-1]
        f.append("ends:" + ("stop" if last in ".!?…" else "letter" if last.isalnum() else "other"))
        f.append(f"commas:{min(3, b.text.count(','))}")
        if "©" in b.text or "copyright" in b.text.lower():
            f.append("rights")
        if "|" in b.text or "»" in b.text or "·" in b.text:
            f.append("bars")
        f.append("first" if k == 0 else "last" if k == n - 1 else "inside")
        out.append(f)
    return out


class Crf:
    """Two labels (0: apart, 1: main text), binary features, one weight for each feature and label and for each pair of neighbouring labels."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, 2))
        self.moves = np.zeros((2, 2))

    def _scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[r].sum(axis=0) for r in rows])

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], seed: int = 7) -> None:
        """Stochastic gradient on the log likelihood, with a rate of its own for each weight."""
        for f in sorted({f for rows, _ in pages for r in rows for f in r}):
            self.index[f] = len(self.index)
        data = [([[self.index[f] for f in r] for r in rows], np.array(labels)) for rows, labels in pages if rows]
        self.weights = np.zeros((len(self.index), 2))
        seen, seen_moves = np.full_like(self.weights, 1e-3), np.full((2, 2), 1e-3)
        order = random.Random(seed)
        for _ in range(EPOCHS):
            order.shuffle(data)
            for rows, labels in data:
                single, pair = self._marginals(self._scores(rows))
                truth = np.eye(2)[labels]
                gradient = np.zeros_like(self.weights)
                for r, d in zip(rows, truth - single):
                    gradient[r] += d
                gradient -= DECAY * self.weights
                moves = np.zeros((2, 2))
                np.add.at(moves, (labels[:-1], labels[1:]), 1)
                moves -= pair + DECAY * self.moves
                seen += gradient**2
                seen_moves += moves**2
                self.weights += RATE * gradient / np.sqrt(seen)
                self.moves += RATE * moves / np.sqrt(seen_moves)

    def _marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward: label probabilities of each block, and expected counts of neighbouring labels."""
        n = len(scores)
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = scores[0]
        for k in range(1, n):
            ahead[k] = scores[k] + np.logaddexp.reduce(ahead[k - 1][:, None] + self.moves, axis=0)
        for k in range(n - 2, -1, -1):
            back[k] = np.logaddexp.reduce(self.moves + scores[k + 1] + back[k + 1], axis=1)
        total = np.logaddexp.reduce(ahead[-1])
        pair = np.zeros((2, 2))
        if n > 1:
            pair = np.exp(ahead[:-1, :, None] + self.moves + (scores + back)[1:, None, :] - total).sum(axis=0)
        return np.exp(ahead + back - total), pair

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi: the likeliest labels of a page's blocks."""
        get = self.index.get
        scores = [self.weights[[i for f in r if (i := get(f)) is not None]].sum(axis=0).tolist() for r in rows]
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = scores[0]
        came: list[tuple[int, int]] = []
        for s0, s1 in scores[1:]:
            came.append((int(b + m10 > a + m00), int(b + m11 > a + m01)))
            a, b = s0 + max(a + m00, b + m10), s1 + max(a + m01, b + m11)
        labels = [int(b > a)]
        for back in reversed(came):
            labels.append(back[labels[-1]])
        return labels[::-1]


def layouts(words: list[str], n: int = TRAINING_PAGES, seed: int = 3) -> list[tuple[str, list[str]]]:
    """Labelled pages of common designs: the page, and the texts of its main blocks in order."""
    r = random.Random(seed)
    words = words or ["word"]

    def text(low: int, high: int, stop: str = ".") -> str:
        chosen = [r.choice(words) for _ in range(r.randint(low, high))]
        for k in range(4, len(chosen) - 2, r.randint(5, 12)):
            chosen[k] += r.choice((",", ".", ","))
        return " ".join(chosen).capitalize() + stop

    def wrap(tag: str, name: str, inner: str, kind: str = "class") -> str:
        return f'<{tag} {r.choice((kind, "class", "id"))}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def menu() -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{text(1, 3, "")}</a></li>' for k in range(r.randint(3, 9))) + "</ul>"

    def odd() -> str:
        """Main text that looks like none: short, in capitals, with bars, without a full stop."""
        return r.choice((text(1, 2), text(1, 3, ""), text(3, 30).upper(), " | ".join(text(1, 1, "") for _ in range(r.randint(3, 20))), text(3, 40, ""), text(4, 30, "!!"), "· " + text(3, 20, ""), text(3, 8) + " © " + text(1, 9)))

    def paragraphs(low: int, high: int) -> list[str]:
        return [f"<p>{odd() if r.random() < 0.15 else text(*r.choice(((2, 8), (8, 60), (30, 120))))}" + r.choice(("</p>", "</p>", "")) for _ in range(r.randint(low, high))]

    def apart(inside: bool) -> str:
        """One region that is no main text; inside: it stands within the article."""
        some = [
            lambda: wrap("div", r.choice(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad banner", "banner-ad")), r.choice(("", "<p>")) + text(3, 25)),
            lambda: wrap("aside", r.choice(("", "sidebar", "related", "widget")), f"<h3>{text(2, 5, '')}</h3>" + r.choice((menu(), f"<p>{text(5, 40)}</p>"))),
            lambda: wrap("div", r.choice(("sidebar", "related", "related-posts", "widget", "share", "social", "recommended", "newsletter", "tags")), r.choice((menu(), f"<h4>{text(2, 5, '')}</h4><p>{text(5, 30)}</p>"))),
            lambda: f'<form action="/s" class="{r.choice(("search", "newsletter", "login", ""))}"><label>{text(1, 3, "")}</label><input name="q"><p>{text(3, 15)}</p><button>{text(1, 2, "")}</button></form>',
            lambda: wrap("div", r.choice(("notice", "cookie-notice", "cookie-banner", "alert", "consent", "gdpr", "banner", "disclaimer")), f"<p>{text(8, 40)}</p>" + r.choice(("", "<button>Ok</button>"))),
            lambda: wrap(r.choice(("div", "section", "ol")), r.choice(("comments", "comment-list", "discussion", "replies", "reader-comments", "disqus")), f"<h3>{text(1, 3, '')}</h3>" + "".join(wrap("div", r.choice(("comment", "reply", "comment-body")), f"<p>{text(4, 70)}</p>") for _ in range(r.randint(1, 6)))),
        ]
        return r.choice(some)()

    out = []
    for _ in range(n):
        title = text(3, 12, "")
        main = [f"<h1>{title}</h1>", *paragraphs(1, 12)]
        for _ in range(r.randint(0, 3)):
            extra = r.choice((f"<h2>{text(2, 6, '')}</h2>", f"<blockquote><p>{text(8, 40)}</p></blockquote>", "<ul>" + "".join(f"<li>{text(2, 25)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", f"<pre>{text(5, 20)}</pre>", f"<table><tr><td>{text(1, 6, '')}</td><td>{text(1, 6, '')}</td></tr></table>", f"<figure><img src='x'><figcaption>{text(3, 15)}</figcaption></figure>"))
            main.insert(r.randint(1, len(main)), extra)
        wanted = [b.text for part in main for b in blocks_of(part)]
        if r.random() < 0.2:
            main[0] = f"<header>{main[0]}</header>"
        for _ in range(r.choice((0, 0, 1, 2))):
            main.insert(r.randint(1, len(main)), apart(True))
        inner = "".join(main)
        tag, name = r.choice((("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "post-content"), ("div", "entry"), ("section", "story"), ("div", "article-body"), ("div", ""), ("div", "main text")))
        body = wrap(tag, name, inner)
        for _ in range(r.choice((0, 0, 1, 2))):
            body = wrap("div", r.choice(("", "container", "wrapper", "page", "row")), body)
        top = [r.choice((wrap("nav", r.choice(("", "menu", "main-nav")), menu()), wrap("div", r.choice(("menu", "nav", "navbar", "topbar")), menu()), wrap("header", r.choice(("", "header", "site-header")), f"<div>{text(1, 4, '')}</div>" + r.choice(("", menu()))), wrap("div", "header", f"<p>{text(2, 8, '')}</p>"), wrap("ol", "breadcrumb", f"<li><a href='/'>{text(1, 2, '')}</a></li><li>{text(1, 4, '')}</li>"))) for _ in range(r.randint(1, 2))]
        top += [apart(False) for _ in range(r.choice((0, 1, 1)))]
        low = [apart(False) for _ in range(r.choice((0, 1, 2)))]
        foot = r.choice((wrap("footer", r.choice(("", "footer")), r.choice(("&copy; ", "", "<p>")) + text(2, 12, r.choice(("", "."))) + r.choice(("", " &middot; " + text(3, 12)))), wrap("div", r.choice(("footer", "bottom", "copyright")), f"<p>&copy; {text(2, 10)}</p>"), ""))
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{''.join(top)}{body}{''.join(low)}{foot}"
        out.append((page + r.choice(("</body></html>", "")), wanted))
    return out


def labelled(page: str, wanted: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a laid-out page: its main blocks are met in order."""
    blocks = blocks_of(page)
    labels, k = [], 0
    in_head = [any(t == "head" for t, _ in b.path) for b in blocks]
    for b, head in zip(blocks, in_head):
        hit = not head and k < len(wanted) and b.text == wanted[k]
        labels.append(int(hit))
        k += hit
    assert k == len(wanted), "a main block was not met"
    return describe(blocks), labels


def train(pages: DataFrame, html: str = "html", key: str = "page_id", sample: int = 50) -> Crf:
    """A model from TRAINING_PAGES laid-out pages. Their words come from at most `sample` given pages, the first by a hash of their key."""
    share = (F.xxhash64(pages[key]).cast("double") + 2.0**63) / 2.0**64
    few = pages.filter(share * pages.count() < 2 * sample + 20).orderBy(F.xxhash64(pages[key])).limit(sample)
    words = sorted({w for r in few.select(F.substring(html, 1, 20_000).alias("h")).collect() for b in blocks_of(r["h"] or "") for w in b.text.split() if w.isalpha()})
    model = Crf()
    model.fit([labelled(p, w) for p, w in layouts(words)])
    return model


def main_text(page: str, model: Crf) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return " ".join(b.text for b, label in zip(blocks, model.decode(describe(blocks))) if label)


def extract(pages: DataFrame, model: Crf, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, the columns in keep, text) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some hundred weights
    rows = pages.select(pages[key].alias("_key"), pages[html].alias("_html"), *[pages[c].alias(f"_keep{i}") for i, c in enumerate(keep)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = [c for c in rows.columns if c != "_html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html"):
                found = [main_text(t, shared.value) for t in texts_of(part, "_html")]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(found, pa.string())], [*kept, "_text"])

    out = rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", _text string")
    return out.select(F.col("_key").alias(key), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], F.col("_text").alias("text"))
