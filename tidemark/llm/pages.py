"""Main text of HTML pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A block is the text between two borders of block-level elements. Its features are the tags and names of its ancestors and
the look of its text. Two labels, text and rest, form the chain; training maximises the likelihood of labelled pages by
forward-backward sums, and pages are decoded by Viterbi.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import map_rows
from tidemark.llm.labelled_pages import labelled_pages

#: The labelled pages of a model and how long it is trained: both bound the work of fitting.
TRAINING_PAGES, EPOCHS, SEED = 400, 12, 11

# Elements of the HTML standard by how they bound text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
# Elements of the tree without text of a page: one that is not closed ends with its parent.
SILENT = frozenset("svg select noscript template annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre script section select style summary table tbody td template "
    "textarea tfoot th thead title tr ul".split()
)
# What a start tag closes, if it is the nearest open block of these.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
P_ENDS = BLOCK - frozenset("button label legend option optgroup summary caption script style template select textarea title head html body".split())
# Families of names in class, id and role.
FAMILIES = {
    "menu": r"menu|nav|breadcrumb|crumb|tabs|pagination|pager|share|social|toolbar|skip",
    "header": r"header|masthead|banner|topbar|logo|branding",
    "footer": r"footer|foot|copyright|colophon|legal|siteinfo|site-info",
    "sidebar": r"sidebar|aside|secondary|widget|rail|related|recommend|popular|trending|more-?stories|complementary",
    "advert": r"(?:^|[-_])ads?(?:$|[-_\d])|advert|sponsor|promo|adsby|dfp|taboola|outbrain|commercial",
    "notice": r"cookie|consent|gdpr|notice|alert|warning|newsletter|subscri|popup|modal|overlay|paywall|disclaimer|signup",
    "form": r"form|search|login|sign-?in|register|contact",
    "comment": r"comment|discuss|disqus|respond|reply|replies|review|feedback",
    "text": r"content|article|post|entry|story|body|text|main|prose|page",
    "hidden": r"hidden|sr-only|visually|screen-reader",
}
FAMILY = {k: re.compile(v) for k, v in FAMILIES.items()}
# Ends a search for an open element that a start tag closes, and for a paragraph that a block ends.
BARRIERS = frozenset("ul ol dl table tbody div section article".split())
ROW_BARRIERS = BARRIERS | {"tr"}
SCOPES = frozenset("table td th caption button object".split())
#: Comments, declarations and tags. Nothing is read twice: a quote counts after = only, and a tag may end with the page.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
KINDS = frozenset("article main aside nav header footer form section".split())


#: States that a worker remembers.
REMEMBERED = 50_000


class State:
    """What the open elements say of a block in them: all their tags and families, the nearest telling one, the own block.

    Paths that say the same share a state, so that elements nested without end need no more than the first few.
    """

    __slots__ = ("says", "near", "own", "after", "features")

    def __init__(self, says: frozenset[str] = frozenset(), near: str = "", own: str = ""):
        self.says, self.near, self.own = says, near, own
        self.after: dict[str, State] = {}
        tag, *families = near.split(".")
        nearest = {f"near:{near}", f"near-tag:{tag}", *(f"near-fam:{f}" for f in families)} if near else {"near:none"}
        self.features = tuple(sorted(says | nearest | {f"own:{own}"}))

    def within(self, name: str, known: dict[tuple, State]) -> State:
        """The state inside an element of this name."""
        found = self.after.get(name)
        if found is None:
            tag, *families = name.split(".")
            says = self.says | {f"in:{tag}", *(f"fam:{f}" for f in families), *(f"{tag}.{f}" for f in families)}
            key = (says, name if tag in KINDS or families else self.near, tag if tag in BLOCK else self.own)
            found = self.after[name] = known.setdefault(key, self if key == (self.says, self.near, self.own) else State(*key))
        return found


STATES: dict[tuple, State] = {}


@dataclass
class Block:
    path: State
    text: str
    linked: int = 0


@lru_cache(maxsize=8192)
def _named(tag: str, attributes: str) -> str:
    names: list[str] = []
    hidden = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() in ("class", "id", "role"):
            names += value.split()
        elif name.lower() == "hidden" or name.lower() == "style" and "display:none" in "".join(value.split()):
            hidden = True
    families = {k for n in names for k, p in FAMILY.items() if p.search(n)}
    return ".".join([tag, *sorted(families), *["unseen"] * hidden])


def element(tag: str, attributes: str) -> str:
    """The name of an element in paths: its tag, the families of its names, and whether it is hidden, which its text may tell."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return tag
    return _named(tag, attributes) if len(attributes) < 4096 else _named.__wrapped__(tag, attributes)


class Open:
    """The open elements of a page, from the outermost, with the places of each tag's, so that no search goes over all of them."""

    def __init__(self):
        if len(STATES) > REMEMBERED:
            STATES.clear()
        self.states = [STATES.setdefault((frozenset(), "", ""), State())]
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.silent: list[int] = []

    def last(self, tags: Iterable[str]) -> int:
        """The innermost place of one of the tags, -1 if none is open."""
        best, get = -1, self.places.get
        for t in tags:
            if (p := get(t)) and p[-1] > best:
                best = p[-1]
        return best

    def first_after(self, tags: Iterable[str], place: int) -> int:
        """The outermost place of one of the tags beyond a place, -1 if there is none."""
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, place)) < len(p)]
        return min(found, default=-1)

    def push(self, tag: str, name: str) -> None:
        at = len(self.tags)
        self.tags.append(tag)
        self.states.append(self.states[-1].within(name, STATES))
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        if tag in SILENT:
            self.silent.append(at)

    def pop_to(self, depth: int) -> None:
        for tag in reversed(self.tags[depth:]):
            self.places[tag].pop()
        for places in (self.blocks, self.silent):
            while places and places[-1] >= depth:
                places.pop()
        del self.tags[depth:], self.states[depth + 1 :]


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a whole page in order, with character references decoded and white space joined to one space.

    Time and memory follow the page's length, however deep its elements nest.
    """
    found: list[Block] = []
    parts: list[str] = []
    open_, linked = Open(), 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(open_.states[-1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not open_.silent:
            parts.append(text)
            if open_.places.get("a"):
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not open_.silent:
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if m[1]:  # an end tag
            depth = open_.last((tag,))
            if tag in BLOCK:
                end_block()
            if depth >= 0 and (tag in BLOCK or not open_.blocks or open_.blocks[-1] <= depth):
                open_.pop_to(depth)
            continue
        if tag in RAW:
            end_block() if tag in BLOCK else parts.append(" ")
            closing = _closing(tag).search(page, at)
            at = closing.end() if closing else end
            continue
        if m[3].endswith("/") and (tag in SILENT or open_.last(("svg", "math")) >= 0):
            continue
        if tag in SILENT and tag not in BLOCK:
            parts.append(" ")
        if tag in BLOCK:
            end_block()
            paragraph = open_.last(("p",)) if tag in P_ENDS else -1
            if paragraph >= 0 and open_.last(SCOPES) < paragraph:
                open_.pop_to(paragraph)
            if tag in CLOSES:
                barrier = open_.last(BARRIERS if tag == "tr" else ROW_BARRIERS)
                depth = open_.first_after(CLOSES[tag], barrier) if tag == "tr" else open_.last(CLOSES[tag])
                if depth > barrier:
                    open_.pop_to(depth)
        if tag not in VOID:
            open_.push(tag, element(tag, m[3]))
    end_block()
    return found


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*+>?", re.I)


PHRASES = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|subscribe|newsletter|advert|sponsored|privacy policy", re.I)


def features(block: Block) -> tuple[str, ...]:
    words = block.text.count(" ") + 1
    links = block.linked / max(1, len(block.text))
    size = "1" if words < 2 else "3" if words < 4 else "8" if words < 9 else "20" if words < 21 else "60" if words < 61 else "more"
    out = [f"words:{size}", f"links:{'none' if not block.linked else 'some' if links < 0.5 else 'most'}", f"end:{'stop' if block.text[-1] in '.!?…:;\"”»' else 'open'}"]
    if words < 40 and PHRASES.search(block.text):
        out.append("furniture")
    return (*block.path.features, *out)


@dataclass(frozen=True)
class Model:
    """Weights for the label text (the label rest has 0): of features, of the chain's steps and of its start."""

    weights: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]
    start: tuple[float, float]

    def emission(self, block: Block) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(block))

    def decode(self, found: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks, by Viterbi; True is text."""
        if not found:
            return []
        rest, text = self.start[0], self.start[1] + self.emission(found[0])
        back: list[tuple[int, int]] = []
        (rr, rt), (tr, tt) = self.step
        for block in found[1:]:
            e = self.emission(block)
            to_rest = (rest + rr, text + tr)
            to_text = (rest + rt, text + tt)
            back.append((int(to_rest[1] > to_rest[0]), int(to_text[1] > to_text[0])))
            rest, text = max(to_rest), max(to_text) + e
        label = int(text > rest)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return [bool(x) for x in reversed(out)]


def labelled_blocks(page: list[tuple[str, bool]]) -> tuple[list[Block], list[int]]:
    """Blocks of a labelled page with their labels, which marks in the markup carry through parsing."""
    marked = "".join(re.sub(r">([^<]*)(?=<|$)", lambda m, k=kept: ">" + (f"{m[1]}\x01{int(k)}" if m[1].strip() else m[1]), markup) for markup, kept in page)
    found, labels = [], []
    for b in blocks(marked):
        marks = re.findall("\x01([01])", b.text)
        if marks:
            found.append(Block(b.path, " ".join(re.sub("\x01[01]", "", b.text).split()) or "x", b.linked))
            labels.append(int(marks[-1]))
    return found, labels


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, ridge: float = 1e-4) -> Model:
    """Maximum likelihood by AdaGrad over pages: gradients are observed less expected counts, from forward-backward sums."""
    names: dict[str, int] = {}
    data = []
    for found, labels in pages:
        rows = [np.array([names.setdefault(f, len(names)) for f in features(b)]) for b in found]
        if rows:
            data.append((rows, np.array(labels)))
    w, seen = np.zeros(len(names)), np.full(len(names), 1e-6)
    chain, chain_seen = np.zeros(6), np.full(6, 1e-6)  # step rr rt tr tt, start r t
    for _ in range(epochs):
        for rows, y in data:
            n = len(rows)
            score = np.zeros((n, 2))
            score[:, 1] = [w[r].sum() for r in rows]
            step, start = chain[:4].reshape(2, 2), chain[4:]
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = start + score[0]
            for t in range(1, n):
                ahead[t] = np.logaddexp(ahead[t - 1, 0] + step[0], ahead[t - 1, 1] + step[1]) + score[t]
            for t in range(n - 2, -1, -1):
                on = score[t + 1] + behind[t + 1]
                behind[t] = np.logaddexp(step[:, 0] + on[0], step[:, 1] + on[1])
            total = np.logaddexp(*ahead[-1])
            p = np.exp(ahead + behind - total)
            error = (y == 1) - p[:, 1]
            gradient = np.zeros(6)
            if n > 1:
                pair = np.exp(ahead[:-1, :, None] + step[None] + (score[1:] + behind[1:])[:, None, :] - total)
                observed = np.bincount(y[:-1] * 2 + y[1:], minlength=4)
                gradient[:4] = observed - pair.sum(axis=0).ravel()
            gradient[4:] = np.eye(2)[y[0]] - p[0]
            chain_seen += gradient**2
            chain += rate * (gradient / np.sqrt(chain_seen) - ridge * chain)
            g = np.zeros(len(names))
            for r, e in zip(rows, error):
                g[r] += e
            at = np.nonzero(g)[0]
            seen[at] += g[at] ** 2
            w[at] += rate * (g[at] / np.sqrt(seen[at]) - ridge * w[at])
    weights = {f: round(float(w[k]), 5) for f, k in sorted(names.items())}
    c = [round(float(x), 5) for x in chain]
    return Model(weights, ((c[0], c[1]), (c[2], c[3])), (c[4], c[5]))


@lru_cache(maxsize=1)
def trained(n: int = TRAINING_PAGES, seed: int = SEED) -> Model:
    """The model of a fixed set of labelled pages: the same on every run."""
    return train([labelled_blocks(p) for p in labelled_pages(n, seed)])


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, model.decode(found), strict=True) if keep)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per page. A null or empty page, or one without main text, gives the empty text.

    Broken markup is read as browsers do: open elements end with the page, stray end tags are passed over. What is left out
    by rule is markup, scripts, styles and the insides of svg, select, noscript and template, each up to its parent's end;
    of all else, hidden blocks and formulas included, the field decides. Repeated rows are kept. Time follows a page's
    length, however it nests.
    """
    use = model or trained()

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            text = main_text(row["html"], use)
            yield {"page_id": row["page_id"], "url": row["url"], "text": text, "n_chars": len(text)}

    kinds = dict(pages.dtypes)
    return map_rows(pages.select("page_id", "url", F.col("html")), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
