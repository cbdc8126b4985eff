"""Main-text extraction with a recurrent block labeller.

A page is read as the sequence of its leaf blocks: the text between two block-level tags, with the path of open
elements. Each block becomes a vector of hashed path parts (tags, class and id words), hashed words and a few
measures; a bidirectional LSTM in numpy reads the sequence and labels every block with the whole page in view.

There are no labelled pages, so the network is trained from weak ones: a bounded sample of pages is labelled by
what element and class names say, and varied with further kinds of boilerplate and article markup. Each page is learned
once more with its names and telling elements hidden, so that a page without any is judged by text, links and order.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import small

#: Pages of the training sample, and blocks of one of them that are learned from.
SAMPLE, SAMPLE_BLOCKS = 200, 100
#: Characters of a block of the sample that are learned from.
TEXT = 2000
#: Buckets for path parts and for words; measures; units each way; rounds of training.
PATHS, WORDS, MEASURES, UNITS, ROUNDS = 128, 32, 7, 12, 20
#: Pages labelled at a time, and blocks of a page up to which its neighbours are padded to one length.
TOGETHER = 128

# What HTML says of elements.
_RAW = {"script", "style", "noscript", "textarea", "title", "iframe"}
#: Elements whose blocks are no text of a page however deep, and those of which only blocks right inside them are none.
_UNSEEN, _CONTROLS = {"svg", "select", "template"}, {"button"}
_MAY_BE_EMPTY = _RAW | _UNSEEN | _CONTROLS | {"object"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ITEMS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Elements that end a block; all others, known or not, stand in the line of text around them.
_BREAKS = _CLOSES_P | set(_ITEMS) | _RAW | _UNSEEN | _CONTROLS | set(
    "html head body base link meta center caption col colgroup thead tbody tfoot figcaption hgroup legend menu dialog dir search summary optgroup datalist frameset frame noframes input embed audio video canvas marquee".split()
)
# Names that say a part of a page is no article text.
_NOT_TEXT = set(
    "nav menu navbar breadcrumb breadcrumbs footer aside sidebar form login signup search ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent notice gdpr "
    "popup modal overlay newsletter subscribe share social related recommended comment comments reply replies disqus pagination pager copyright widget toolbar dialog masthead".split()
)
_ARTICLE = {"article", "main"}
#: Elements that tell what they hold.
_TELLING = _ARTICLE | {"nav", "header", "footer", "aside", "form", "section", "label", "menu"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_SELF_CLOSED = re.compile(r"""(?:^|[\s"']|(?:^|\s)[^\s=/"'>]+)/\s*\Z""")  # a slash that ends an unquoted value is part of it

#: What ends what: an element, and the elements beyond which no open one is looked for.
_SCOPES = {"p": {"article", "aside", "body", "div", "footer", "header", "main", "nav", "section", "table", "td", "th", "ul", "ol", "li"}, "svg": {"foreignobject"}, "select": set(), "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
_SCOPES |= {tag: _ITEMS[tag] for tag in ("li", "dt", "dd", "option")}
_SCOPED = set(_SCOPES).union(*_SCOPES.values())


def _bucket(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % n


class Path:
    """The open elements around a block: what is needed of them, kept as each is opened, whatever the depth.

    ``mask``: hashed path parts; ``article``, ``other``, ``head``: whether an element is an article, a name says it is none,
    or it is a header; ``hidden``: the mask with no names and with every element of a telling kind as a plain one.
    """

    __slots__ = ("mask", "hidden", "article", "other", "head", "unseen", "control")

    def __init__(self, mask=0, hidden=0, article=False, other=False, head=False, unseen=False, control=False):
        self.mask, self.hidden, self.article, self.other, self.head, self.unseen, self.control = mask, hidden, article, other, head, unseen, control

    def inside(self, tag: str, names: list[str] = ()) -> Path:
        out, words = Path(self.mask, self.hidden, self.article, self.other, self.head, self.unseen, self.control), {tag, *names}
        for p in (tag, *[f".{n}" for n in names]):
            out.mask |= _bit(p)
        out.hidden |= _bit("div" if tag in _TELLING else tag)
        out.article |= tag in _ARTICLE
        out.other |= not words.isdisjoint(_NOT_TEXT)
        out.head |= "header" in words
        out.unseen |= tag in _UNSEEN
        if tag in _BREAKS:
            out.control = tag in _CONTROLS
        return out

    @property
    def silent(self) -> bool:
        """Whether a block here is a control or drawing."""
        return self.unseen or self.control


@lru_cache(maxsize=50_000)
def _bit(part: str) -> int:
    return 1 << _bucket(part, PATHS)


def path_of(parts) -> Path:
    """A path from parts: element names, each followed by its names with a point before them."""
    out, at = Path(), list(parts)
    while at:
        n = next((i for i in range(1, len(at)) if at[i][0] != "."), len(at))
        out, at = out.inside(at[0], [p[1:] for p in at[1:n]]), at[n:]
    return out


Block = tuple[str, Path, float]


class _Tags:
    """Where tags of a page end. A quote that leads nowhere is remembered, so no stretch is searched twice in vain."""

    def __init__(self, page: str):
        self.page, self.dead, self.last = page, set(), page.rfind(">")

    def end(self, at: int) -> int:
        """Place of the bracket that ends a tag whose names begin at ``at``: outside quotes, or else the first; -1 if none."""
        if self.last < at:
            return -1
        seen, place = [], at
        while (m := _STOP.search(self.page, place)) and m.start() not in self.dead:
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            place = self.page.find(m[0], m.end()) + 1
            if not place:
                break
        self.dead.update(seen)
        return self.page.find(">", at)


def leaf_blocks(page: str) -> list[Block]:
    """(text, path, share of linked characters) of the leaf blocks of a page, in order; in time linear in its length."""
    out: list[Block] = []
    stack: list[tuple[str, Path, dict[str, int]]] = []  # element, path, nearest open element of each scope
    opened: dict[str, list[int]] = {}
    text: list[str] = []
    state = {"path": Path(), "linked": 0, "length": 0}

    def flush() -> None:
        joined = " ".join("".join(text).split())
        if joined:
            out.append((joined, state["path"], state["linked"] / max(1, state["length"])))
        text.clear()
        state.update(path=Path(), linked=0, length=0)

    def add(raw: str) -> None:
        if not raw:
            return
        piece = html.unescape(raw) if "&" in raw else raw
        if piece.strip():
            if not state["length"]:
                state["path"] = stack[-1][1] if stack else Path()
            state["length"] += len(piece)
            if opened.get("a"):
                state["linked"] += len(piece)
        text.append(piece)

    def cut(n: int) -> None:
        while len(stack) > n:
            opened[stack.pop()[0]].pop()

    def close(tag: str) -> None:
        """End the nearest open element of a scope, if there is one."""
        n = stack[-1][2].get(tag, -1) if stack else -1
        if n >= 0:
            cut(n)

    def push(tag: str, names: str) -> None:
        parts = [p for g in _NAMES.findall(names) for p in _PART.findall("".join(g).lower())] if "=" in names else []
        around, scopes = (stack[-1][1], stack[-1][2]) if stack else (Path(), {})
        if tag in _SCOPED:
            scopes = {k: n for k, n in scopes.items() if tag not in _SCOPES[k]}
            if tag in _SCOPES:
                scopes[tag] = len(stack)
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, around.inside(tag, parts), scopes))

    at, tags = 0, _Tags(page)
    while (here := page.find("<", at)) >= 0:
        mark, name = page[here + 1 : here + 2], None
        if mark == "!" and (page.startswith("<!--", here) or page.startswith("<![CDATA[", here)):
            add(page[at:here])
            close_mark = "-->" if page.startswith("<!--", here) else "]]>"
            end = page.find(close_mark, here + 4)
            at = end + len(close_mark) if end >= 0 else len(page)
            continue
        ends = mark == "/"
        name = _NAME.match(page, here + 1 + ends)
        end = tags.end(name.end()) if name else page.find(">", here) if mark and mark in "!?/" and tags.last > here else -1
        if end < 0:  # no tag
            add(page[at : here + 1])
            at = here + 1
            continue
        add(page[at:here])
        at = end + 1
        if not name:
            continue
        tag, names = name[0].lower(), page[name.end() : end]
        if tag in _BREAKS:
            flush()
        elif tag == "br":
            text.append(" ")
        if ends:
            if opened.get(tag):
                cut(opened[tag][-1])
        elif "/" in names and (tag in _MAY_BE_EMPTY or opened.get("svg")) and _SELF_CLOSED.search(names):
            continue
        elif tag in _RAW:
            stop = re.compile(rf"</{tag}\b", re.I).search(page, at)
            end = page.find(">", stop.end()) if stop else -1
            at = end + 1 if end >= 0 else len(page)
        elif tag not in _VOID:
            if tag in _CLOSES_P:
                for scope in ("svg", "select", "p"):  # block markup ends what was left open
                    close(scope)
            if tag in ("td", "th"):
                close("td")
                close("th")
            elif tag in _ITEMS:
                close(tag)
            push(tag, names)
    add(page[at:])
    flush()
    return out


def unseen(path: Path) -> bool:
    """Whether a block is a control or drawing, by the elements around it."""
    return path.silent


def weak_labels(blocks: list[Block]) -> np.ndarray:
    """1 for article text and 0 for the rest, as far as names in the path tell."""
    inside = any(p.article for _, p, _ in blocks)
    return np.array([not p.other and not (p.head and not p.article) and not p.silent and (p.article or not inside) and (p.article or linked < 0.5) for _, p, linked in blocks], float)


class Hasher:
    """Block vectors; buckets of words are remembered, up to a bound."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def vectors(self, blocks: list[Block], hidden: bool = False) -> np.ndarray:
        """A row a block; with ``hidden``, as if no element had a name or was of a kind that tells what it holds."""
        x = np.zeros((len(blocks), PATHS + WORDS + MEASURES), np.float32)
        if len(self.words) > 200_000:
            self.__init__()
        masks = b"".join((p.hidden if hidden else p.mask).to_bytes(PATHS // 8, "little") for _, p, _ in blocks)
        if blocks:
            x[:, :PATHS] = np.unpackbits(np.frombuffer(masks, np.uint8).reshape(len(blocks), -1), axis=1, bitorder="little")
        for n, (text, _, linked) in enumerate(blocks):
            words = text.split(" ")
            at = [self.words[w] if w in self.words else self.words.setdefault(w, _bucket(w.lower(), WORDS)) for w in words]
            x[n, PATHS : PATHS + WORDS] = np.bincount(at, minlength=WORDS) / len(words)
            x[n, PATHS + WORDS :] = np.log1p(len(words)) / 5, linked, sum(text.count(c) for c in ".,;!?") / len(words), n / len(blocks), text[-1] in ".!?\"'”»", text[:1].isupper(), 1
        return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logistic output a block."""

    def __init__(self, seed: int = 0):
        rng, d = np.random.default_rng(seed), PATHS + WORDS + MEASURES
        self.w = {}
        for way in "fb":
            self.w[f"x{way}"] = rng.standard_normal((d, 4 * UNITS)) * 0.1
            self.w[f"h{way}"] = rng.standard_normal((UNITS, 4 * UNITS)) * 0.2
            self.w[f"c{way}"] = np.repeat([0.0, 1.0, 0.0, 0.0], UNITS)  # open forget gates
        self.w["o"], self.w["p"] = rng.standard_normal(2 * UNITS) * 0.2, np.zeros(1)

    def _pass(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Hidden states over (pages, blocks, features) in one direction; padded blocks leave the state as it is."""
        n, t, _ = x.shape
        z = x @ self.w[f"x{way}"].astype(x.dtype) + self.w[f"c{way}"].astype(x.dtype)
        wh = self.w[f"h{way}"].astype(x.dtype)
        h, c = np.zeros((n, UNITS), x.dtype), np.zeros((n, UNITS), x.dtype)
        out, tape = np.empty((n, t, UNITS), x.dtype), []
        for s in range(t) if way == "f" else range(t - 1, -1, -1):
            a = z[:, s] + h @ wh
            g = _sigmoid(a[:, : 3 * UNITS])
            i, f, o = g[:, :UNITS], g[:, UNITS : 2 * UNITS], g[:, 2 * UNITS :]
            u, m = np.tanh(a[:, 3 * UNITS :]), mask[:, s : s + 1]
            new = f * c + i * u
            k = np.tanh(new)
            if keep:
                tape.append((s, h, c, i, f, o, u, k))
            c, h = m * new + (1 - m) * c, m * o * k + (1 - m) * h
            out[:, s] = h
        return out, tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._pass(w, x, mask)[0] for w in "fb"], axis=2)
        return h @ self.w["o"].astype(x.dtype) + self.w["p"].astype(x.dtype)

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {w: self._pass(w, x, mask, keep=True) for w in "fb"}
        h = np.concatenate([runs[w][0] for w in "fb"], axis=2)
        e = (_sigmoid(h @ self.w["o"] + self.w["p"]) - y) * mask / max(1, mask.sum())
        out = {"o": np.einsum("nt,ntk->k", e, h), "p": np.array([e.sum()])}
        for at, w in enumerate("fb"):
            back = e[:, :, None] * self.w["o"][at * UNITS : (at + 1) * UNITS]
            wh, dz = self.w[f"h{w}"], np.zeros((*x.shape[:2], 4 * UNITS))
            dh, dc = np.zeros((len(x), UNITS)), np.zeros((len(x), UNITS))
            gh = np.zeros_like(wh)
            for s, h0, c0, i, f, o, u, k in reversed(runs[w][1]):
                m = mask[:, s : s + 1]
                dh = dh + back[:, s]
                dn = m * (dc + dh * o * (1 - k * k))
                a = np.concatenate([dn * u * i * (1 - i), dn * c0 * f * (1 - f), m * dh * k * o * (1 - o), dn * i * (1 - u * u)], axis=1)
                dz[:, s] = a
                gh += h0.T @ a
                dh, dc = a @ wh.T + (1 - m) * dh, dn * f + (1 - m) * dc
            out[f"x{w}"], out[f"h{w}"], out[f"c{w}"] = np.einsum("ntd,ntk->dk", x, dz, optimize=True), gh, dz.sum((0, 1))
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, seed: int = 0) -> None:
        """Adam over batches of pages."""
        rng, step = np.random.default_rng(seed), 0
        one, two = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for _ in range(rounds):
            order = np.argsort([len(x) * rng.uniform(0.8, 1.25) for x, _ in pages])  # little padding, other batches each round
            for lo in rng.permutation(np.arange(0, len(order), 32)).tolist():
                x, mask, y = padded([pages[i] for i in order[lo : lo + 32]])
                step += 1
                for k, g in self.gradient(x.astype(float), mask.astype(float), y.astype(float)).items():
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.999 * two[k] + 0.001 * g * g
                    self.w[k] -= 0.02 * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)


def padded(pages: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(len(x) for x, _ in pages)
    x = np.zeros((len(pages), t, pages[0][0].shape[1]), np.float32)
    mask, y = np.zeros((len(pages), t), np.float32), np.zeros((len(pages), t), np.float32)
    for n, (a, b) in enumerate(pages):
        x[n, : len(a)], mask[n, : len(a)] = a, 1
        if b is not None:
            y[n, : len(a)] = b
    return x, mask, y


# Paths of further boilerplate and of further article markup, for variety in training.
_BOILER = [
    p.split()
    for p in (
        "header h1|header div p|aside p|aside ul li a|div .sidebar p|div .sidebar ul li|div .cookie .notice p|div .notice|div .notice p|div .consent p|form label|form p|form div|div .comments div .comment p|"
        "article div .ad|article aside p|article div .ads p|article section .comments p|section .comments h2|section .comments p|div .comments p|div .comment p|ul .comments li|article div .share|div .related ul li a|div .newsletter p|div .banner|div .advert p|"
        "div .ad p|div .promo p|nav ul li a|nav a|div .menu a|div .menu ul li|footer p|footer div|div .footer p|div .popup p|div .social a|article footer p|div .breadcrumb a|div .pagination a|div .login form label"
    ).split("|")
]
_ARTICLES = [p.split() for p in "article p|article h1|article h2|article h3|article ul li|article ol li|article blockquote p|article pre|article table tr td|article div p|article section p|article header h1|article figure figcaption|article dl dd|main p|main h1|main article p|main div .content p|article div .body p".split("|")]


def varied(blocks: list[Block], rng: np.random.Generator) -> list[Block]:
    """A page with its article markup changed here and there and with other boilerplate put in, short or long."""
    words = [w for t, _, _ in blocks for w in t.split(" ")] or ["text"]
    out: list[Block] = []
    outer = ("main",) if rng.random() < 0.2 else ()
    for text, path, linked in blocks:
        while rng.random() < 0.25:
            made = _BOILER[rng.integers(len(_BOILER))]
            n, at = int(rng.integers(1, 60)), int(rng.integers(len(words)))
            for _ in range(int(rng.integers(1, 4))):
                out.append((" ".join(words[at : at + n]) or "text", path_of(("html", "body", *made)), float(made[-1] == "a")))
        if path.article and rng.random() < 0.4:
            path = path_of(("html", "body", *outer, *_ARTICLES[rng.integers(len(_ARTICLES))]))
        if rng.random() < 0.1:
            text = " ".join(text.split(" ")[: int(rng.integers(1, 6))])
        out.append((text, path, linked))
    return out


def hard(blocks: list[Block], labels: np.ndarray, rng: np.random.Generator) -> list[Block]:
    """A page to be read with its names hidden: boilerplate is short or linked, as nothing else tells it apart there."""
    out = []
    for (text, path, linked), article in zip(blocks, labels, strict=True):
        words = text.split(" ")
        if not article and linked < 0.5 and len(words) > 12:
            text = " ".join(words[: int(rng.integers(2, 13))]).rstrip(".,;!?")
        out.append((text, path, linked))
    return out


def _state(p: Path) -> tuple:
    return tuple(getattr(p, n) for n in Path.__slots__)


def train(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """Fit the labeller on a bounded sample of pages, drawn by hash; an empty table leaves it unfitted."""

    rows = pages.where("html is not null").select(F.col("html").cast("string"))
    count = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("html"), F.lit(1 << 40)) < int(min(1, sample / max(1, count)) * (1 << 40)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 200):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([(t[:TEXT], *_state(p), x) for t, p, x in leaf_blocks(h)[:SAMPLE_BLOCKS]]) for h in b.column(0).to_pylist()], pa.binary())], ["blocks"])

    # Copies of one page are one example, so the sample stays small where one page is a large share of all.
    found = sorted(bytes(r["blocks"]) for r in drawn.distinct().limit(4 * sample).mapInArrow(read, "blocks binary").collect())
    rng, hasher, examples = np.random.default_rng(0), Hasher(), []
    for blocks in ([(t, Path(*p), x) for t, *p, x in pickle.loads(b)] for b in found):
        for page in [blocks, varied(blocks, rng)]:
            if page:
                labels = weak_labels(page)
                examples.append((hasher.vectors(page), labels))
                if 0 < labels.mean() < 1 or page is blocks:
                    examples.append((hasher.vectors(hard(page, labels, rng), hidden=True), labels))
    model = Labeller()
    if examples:
        model.fit(examples)
    return model


def _extractor(shared):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher = shared.value, Hasher()
        for b in small(batches, 500):
            texts = [""] * b.num_rows
            pages = [leaf_blocks(h or "") for h in b.column(2).to_pylist()]
            # Pages of similar length together, so that little is padded.
            order = sorted((n for n in range(len(pages)) if pages[n]), key=lambda n: len(pages[n]))
            lo = 0
            while lo < len(order):
                hi = lo + 1
                while hi < len(order) and hi - lo < TOGETHER and len(pages[order[hi]]) <= 1.3 * len(pages[order[lo]]) + 4:
                    hi += 1
                some = order[lo:hi]
                x, mask, _ = padded([(hasher.vectors(pages[n]), None) for n in some])
                for n, s in zip(some, model.scores(x, mask), strict=True):
                    texts[n] = "\n\n".join(p[0] for p, v in zip(pages[n], s.tolist(), strict=False) if v > 0 and not p[1].silent)
                lo = hi
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return extract


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page row: the article's blocks in order, two newlines between.

    A null or empty html gives an empty text. Repeated rows are read each by itself and give the same; an empty
    table gives no row; very long pages are read as one sequence, in time linear in their length. White space inside a
    block is one space.
    """
    model = train(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extractor(shared), "page_id long, url string, text string, n_chars long")
