"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of tags (and their class and
id words) above it. A block's input is the mean of hashed tag-path vectors, the mean of hashed-word vectors and a few
counts. A bidirectional LSTM in numpy reads a page's blocks in both directions and gives each the probability
that it is main text, so a block is judged by what stands before and after it in the document.

The network is trained here, on ``TRAIN_PAGES`` pages drawn from a grammar of layouts (a fixed seed, a
bounded sample); ``accuracy`` measures it on pages of other seeds.

Defined results: a null or empty html gives an empty text; unclosed and stray tags, unfinished comments and
very long pages are read to their end. What a script, style, textarea, title or iframe holds is no text of the page: it
runs to the closing tag, or where there is none to the end of the page, as in a browser. Nothing else is dropped but
what the labeller rejects.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import runtime, textscan as ts

TRAIN_PAGES, EPOCHS, HIDDEN, SEED = 420, 14, 16, 5
PATH_SLOTS, PATH_DIM, WORD_SLOTS, WORD_DIM, COUNTS = 4096, 24, 2048, 6, 6
INPUT = PATH_DIM + WORD_DIM + COUNTS
#: Blocks of a batch of pages that the network reads together.
BATCH_CELLS = 40_000
#: Of a path of more open tags, the outermost and the innermost so many are read. The text counts whole.
OUTER, INNER = 16, 48

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>|<[!?/][^>]*>|<[A-Za-z][^<>]*>", re.S)
#: Elements whose content is no markup: it is skipped up to the closing tag. All others are tags of a path.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
#: Within these, "/>" closes any element, and a title is an element as others.
FOREIGN = frozenset(("svg", "math"))
#: MathML among them, so that a formula stays within its sentence.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol table dl body html article section div nav aside footer header main form".split())
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
MARKS = np.zeros(256, np.int64)
MARKS[list(b".,;:!?")] = 1


@lru_cache(maxsize=65536)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """What a tag adds to the path: its name, and the words of its class, id and role."""
    out = [tag]
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind in ("hidden", "aria-hidden"):
            if value != "false":
                out.append("@hidden")
            continue
        for w in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", value):
            if w:
                out.append("@" + (w[:-1] if len(w) > 3 and w.endswith("s") else w))
    return tuple(out)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters within links) of a page's leaf blocks, in order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    # Tag, its names, and whether it stands in a link and in a foreign element, itself included.
    stack: list[tuple[str, tuple[str, ...], bool, bool]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    state = {"path": None, "link": 0}
    last = page.rfind(">") + 1  # behind it no tag can end, so none is looked for

    def path() -> tuple[str, ...]:
        near = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
        return tuple(n for tag, names, _, _ in near for n in names if tag not in INLINE or len(names) > 1)

    def drop(k: int) -> None:
        for tag, *_ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    def close(tags: tuple[str, ...], stops: frozenset) -> None:
        if any(opened[t] for t in tags):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in tags:
                    drop(k)
                    return
                if stack[k][0] in stops:
                    return

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((state["path"], text, state["link"]))
            parts.clear()
        state["link"] = 0

    def say(raw: str) -> None:
        text = entities.unescape(raw)
        if not parts:
            if not text.strip():
                return
            state["path"] = path()
        parts.append(text)
        if stack and stack[-1][2]:
            state["link"] += len(text)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at) if at < last or page.find("<!", at) >= 0 else None
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    if tag not in INLINE:
                        flush()
                    drop(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag == "br":
            parts.append(" ") if parts else None
            continue
        if tag not in INLINE:
            flush()
        alone = m[3].rstrip().endswith("/")
        foreign = (alone or tag == "title") and bool(stack and stack[-1][3])
        if tag in RAW and not (foreign and (alone or tag == "title")):
            end = RAW[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID or alone and (foreign or tag not in STOPS):
            continue
        if tag in CLOSES_P:
            close(("p",), STOPS)
        if tag in IMPLIED:
            close(IMPLIED[tag], STOPS)
        in_link, in_foreign = stack[-1][2:] if stack else (False, False)
        stack.append((tag, _names(tag, m[3]), in_link or tag == "a", in_foreign or tag in FOREIGN))
        opened[tag] += 1
    flush()
    return out


# -- inputs -----------------------------------------------------------------------------------------


@lru_cache(maxsize=65536)
def _path_slots(path: tuple[str, ...]) -> np.ndarray:
    """Hashed names of a path: each name, and each with the one above it."""
    said = [*dict.fromkeys(path), *dict.fromkeys(f"{a}>{b}" for a, b in zip(path, path[1:], strict=False))] or ["-"]
    return np.array([crc32(x.encode()) % PATH_SLOTS for x in said], np.int64)


class Inputs:
    """Flat inputs of the blocks of several pages."""

    def __init__(self, pages: list[list[tuple[tuple[str, ...], str, int]]]):
        flat = [b for p in pages for b in p]
        self.size = np.array([len(p) for p in pages], np.int64)
        slots = [_path_slots(b[0]) for b in flat]
        self.path, self.path_begin = _ragged(slots)
        raw = [b[1].encode() for b in flat]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        w = ts.words(np.frombuffer(b"".join(raw), np.uint8), offsets, ts.ALNUM, lower=True)
        # A slot for "no word" at the end of each block keeps every block's slots from being empty.
        slot = np.concatenate([(w.hash % np.uint64(WORD_SLOTS - 1)).astype(np.int64) + 1, np.zeros(len(flat), np.int64)])
        order = np.argsort(np.concatenate([w.doc, np.arange(len(flat))]), kind="stable")
        self.word, self.word_begin = slot[order], w.first[:-1] + np.arange(len(flat))
        chars, count = np.array([len(b[1]) for b in flat], float), np.diff(w.first).astype(float)
        link = np.array([b[2] for b in flat], float)
        total = np.concatenate([[0], np.cumsum(MARKS[w.buf])])
        marks = (total[offsets[1:]] - total[offsets[:-1]]).astype(float)
        self.counts = np.stack([np.log1p(chars) / 5, np.log1p(count) / 4, link / np.maximum(chars, 1), marks / np.maximum(count, 1), (chars > 80) * 1.0, (chars < 25) * 1.0], axis=1) if flat else np.zeros((0, COUNTS))


def _ragged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64) if parts else np.zeros(0, np.int64)


def _means(table: np.ndarray, slots: np.ndarray, begin: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros((0, table.shape[1]))
    n = np.diff(np.append(begin, len(slots)))
    return np.add.reduceat(table[slots], begin, axis=0) / n[:, None]


# -- network ----------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Embeddings, a forward and a backward LSTM, and a logistic output."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {"path": r.normal(0, 0.3, (PATH_SLOTS, PATH_DIM)), "word": r.normal(0, 0.05, (WORD_SLOTS, WORD_DIM)), "out": r.normal(0, 0.2, (2 * HIDDEN + INPUT, 1)), "bias": np.zeros(1)}
        for d in "fb":
            self.p[f"w{d}"] = r.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN))
            self.p[f"u{d}"] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def _padded(self, x: Inputs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate([_means(self.p["path"], x.path, x.path_begin), _means(self.p["word"], x.word, x.word_begin), x.counts], axis=1)
        n, t = len(x.size), int(x.size.max(initial=0))
        inside = np.arange(t)[None, :] < x.size[:, None]
        out = np.zeros((n, t, INPUT))
        out[inside] = flat
        return out, inside, flat

    def _run(self, x: np.ndarray, inside: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        n, t, _ = x.shape
        h, c, out = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((n, t, HIDDEN))
        drive = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            g = drive[:, k] + h @ self.p[f"u{d}"]
            i, f, o, z = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN : 2 * HIDDEN]), _sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
            m = inside[:, k : k + 1]
            before_c, before_h = c, h
            c = np.where(m, f * c + i * z, c)
            tc = np.tanh(c)
            h = np.where(m, o * tc, h)
            out[:, k] = h
            if keep is not None:
                keep.append((k, i, f, o, z, before_c, before_h, tc, m))
        return out

    def probabilities(self, x: Inputs) -> np.ndarray:
        """Of all blocks, page after page."""
        if not len(x.counts):
            return np.zeros(0)
        padded, inside, flat = self._padded(x)
        both = np.concatenate([self._run(padded, inside, "f", None)[inside], self._run(padded, inside, "b", None)[inside], flat], axis=1)
        return _sigmoid(both @ self.p["out"] + self.p["bias"])[:, 0]

    def gradients(self, x: Inputs, y: np.ndarray) -> dict[str, np.ndarray]:
        padded, inside, flat = self._padded(x)
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = {d: self._run(padded, inside, d, kept[d]) for d in "fb"}
        both = np.concatenate([hidden["f"][inside], hidden["b"][inside], flat], axis=1)
        delta = (_sigmoid(both @ self.p["out"] + self.p["bias"])[:, 0] - y)[:, None] / len(y)
        g = {"out": both.T @ delta, "bias": delta.sum(axis=0)}
        back = delta @ self.p["out"].T
        dx = np.zeros_like(padded)
        for k, d in enumerate("fb"):
            dh_all = np.zeros(hidden[d].shape)
            dh_all[inside] = back[:, k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros((len(x.size), HIDDEN)), np.zeros((len(x.size), HIDDEN))
            gw, gu, gc = (np.zeros_like(self.p[f"{a}{d}"]) for a in "wuc")
            for at, i, f, o, z, before_c, before_h, tc, m in reversed(kept[d]):
                dh = dh + dh_all[:, at]
                dhm, dcm = np.where(m, dh, 0), np.where(m, dc, 0)
                dcm = dcm + dhm * o * (1 - tc * tc)
                gate = np.concatenate([dcm * z * i * (1 - i), dcm * before_c * f * (1 - f), dhm * tc * o * (1 - o), dcm * i * (1 - z * z)], axis=1)
                gw += padded[:, at].T @ gate
                gu += before_h.T @ gate
                gc += gate.sum(axis=0)
                dx[:, at] += gate @ self.p[f"w{d}"].T
                dh = np.where(m, gate @ self.p[f"u{d}"].T, dh)
                dc = np.where(m, dcm * f, dc)
            g |= {f"w{d}": gw, f"u{d}": gu, f"c{d}": gc}
        flat_grad = dx[inside] + back[:, 2 * HIDDEN :]
        for name, slots, begin, part in (("path", x.path, x.path_begin, flat_grad[:, :PATH_DIM]), ("word", x.word, x.word_begin, flat_grad[:, PATH_DIM : PATH_DIM + WORD_DIM])):
            n = np.diff(np.append(begin, len(slots)))
            g[name] = np.zeros_like(self.p[name])
            np.add.at(g[name], slots, np.repeat(part / n[:, None], n, axis=0))
        return g

    def fit(self, pages: list, labels: list[list[bool]], epochs: int = EPOCHS, batch: int = 20, rate: float = 0.012, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                g = self.gradients(Inputs([pages[i] for i in some]), np.array([y for i in some for y in labels[i]], float))
                step += 1
                for name, grad in g.items():
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    v[name] = 0.99 * v[name] + 0.01 * grad * grad
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)


# -- a grammar of layouts ---------------------------------------------------------------------------

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo zu é ñ ö ß ou er th in an ion ing".split()
MENU = "home about contact news products services blog login register search help shop cart archive".split()
NOTICE = "we use cookies to improve your experience accept privacy policy subscribe newsletter sign up share tweet copyright all rights reserved advertisement sponsored related posts reply said".split()
BAD = (
    ("nav", ""), ("nav", 'class="menu"'), ("header", 'class="site-header"'), ("footer", ""), ("footer", 'id="footer"'), ("aside", ""), ("aside", 'class="sidebar"'), ("div", 'class="ad"'), ("div", 'class="ads banner"'), ("div", 'class="advert"'), ("div", 'id="advertisement"'), ("div", 'class="sponsored promo"'),
    ("div", 'class="sidebar"'), ("div", 'id="sidebar"'), ("div", 'class="cookie-notice"'), ("div", 'class="cookie-banner consent"'), ("div", 'class="notice"'), ("div", 'role="alert" class="popup modal"'), ("div", 'class="newsletter subscribe"'), ("form", ""), ("form", 'class="search"'), ("form", 'class="login"'),
    ("section", 'class="comments"'), ("div", 'id="comments"'), ("ol", 'class="comment-list"'), ("div", 'class="comment"'), ("section", 'id="disqus_thread" class="responses replies"'), ("div", 'class="related"'), ("section", 'class="related-posts recommended"'), ("div", 'class="share social"'), ("div", 'class="breadcrumbs"'),
    ("ul", 'class="menu navigation"'), ("div", 'class="pagination"'), ("div", 'class="header top"'), ("div", 'id="header"'), ("div", 'class="footer copyright"'), ("div", 'class="widget tags"'), ("div", 'role="navigation"'), ("div", 'role="complementary"'), ("div", 'class="toolbar"'), ("div", 'hidden'),
)
GOOD = (("article", ""), ("article", 'class="post"'), ("main", ""), ("main", 'id="main"'), ("div", 'class="content"'), ("div", 'id="content"'), ("div", 'class="post-body entry-content"'), ("div", 'class="article-body"'), ("section", 'class="story"'), ("div", 'itemprop="articleBody" class="text"'), ("div", 'role="main"'))


def draw(seed: int) -> tuple[str, list[str]]:
    """A page and its main blocks, from the grammar."""
    r = np.random.default_rng(seed)
    pick = lambda x: x[int(r.integers(len(x)))]
    word = lambda: "".join(pick(SYLLABLES) for _ in range(int(r.integers(1, 5))))

    def prose(low: int, high: int) -> str:
        n = int(r.integers(low, high))
        return " ".join(word() + ("." if r.random() < 0.1 else "," if r.random() < 0.08 else "") for _ in range(n)).capitalize() + pick([".", "", "!", "."])

    def junk(tag: str, attributes: str) -> str:
        kind = r.random()
        bad = lambda: " ".join(pick(NOTICE) if r.random() < 0.5 else word() for _ in range(int(r.integers(2, 14))))
        if "comment" in attributes or "replies" in attributes:
            body = "".join(pick([f"<div class='comment'><p>{prose(3, 40)}</p></div>", f"<p>{prose(3, 40)}</p>", f"<li><b>{word()}</b> {prose(2, 30)}</li>"]) for _ in range(int(r.integers(1, 5))))
        elif tag == "form":
            body = f"<label>{word()} {pick(NOTICE)}</label><input name='q'><p>{bad()}</p><button>{word()}</button>" if kind < 0.7 else f"<p>{prose(3, 20)}</p>"
        elif kind < 0.4 or tag in ("nav", "ul"):
            body = "<ul>" * (tag != "ul") + "".join(f"<li><a href='/{k}'>{pick(MENU) if r.random() < 0.4 else word()}</a></li>" for k in range(int(r.integers(2, 9)))) + "</ul>" * (tag != "ul")
        elif kind < 0.7:
            body = prose(3, 30)
        else:
            body = f"<p>{prose(3, 45)}</p>" + (f"<h3>{bad()}</h3>" if r.random() < 0.3 else "")
        if tag == "footer" and r.random() < 0.5:
            body = f"&copy; {word()}.example.com &middot; {prose(3, 16)}"
        return f"<{tag}{' ' + attributes if attributes else ''}>{body}</{tag}>"

    good: list[str] = []

    def main() -> str:
        out = []
        title = prose(3, 12)
        if r.random() < 0.8:
            good.append(title)
            out.append(f"<h1>{title}</h1>" if r.random() < 0.8 else f"<header><h1>{title}</h1></header>")
        for k in range(int(r.integers(1, 12))):
            text, kind = prose(1 if r.random() < 0.15 else 5, 70), r.random()
            good.append(text)
            if kind < 0.62:
                out.append(f"<p>{text}</p>")
            elif kind < 0.72:
                out.append(f"<p>{text}<br>")
            elif kind < 0.8:
                out.append(f"<p><b>{text}<br><p>")
            elif kind < 0.86:
                out.append(f"<h2>{text}</h2>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.94:
                out.append(f"<div>{text}</div>")
            elif kind < 0.97:
                out.append(f"<table><tr><td>{text}</td></tr></table>")
            else:
                out.append(f"<ul><li>{text}</li></ul>")
            if r.random() < 0.06:
                out.append(junk(*pick(BAD)))
        return "".join(out)

    before = [junk(*pick(BAD)) for _ in range(int(r.integers(0, 4)))]
    after = [junk(*pick(BAD)) for _ in range(int(r.integers(0, 4)))]
    tag, attributes = pick(GOOD[:2]) if r.random() < 0.4 else pick(GOOD)
    body = f"<{tag}{' ' + attributes if attributes else ''}>{main()}</{tag}>"
    if r.random() < 0.25:
        body = f"<div class='{pick(['wrapper', 'container', 'row', 'page', 'layout'])}'>{body}{junk(*pick(BAD))}</div>"
    end = "</body></html>" if r.random() < 0.8 else ""
    page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{word()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{''.join(before)}<!-- x -->{body}{''.join(after)}{end}"
    return page, good


def labelled(seeds: range) -> tuple[list, list[list[bool]]]:
    """Pages as blocks, and whether each block is main text."""
    pages, labels = [], []
    for seed in seeds:
        page, good = draw(seed)
        cut = blocks(page)
        left = [" ".join(entities.unescape(g).split()) for g in good]
        truth = []
        for _, text, _ in cut:
            truth.append(bool(left) and text == left[0])
            if truth[-1]:
                left.pop(0)
        pages.append(cut)
        labels.append(truth)
    return pages, labels


_trained: list[Labeller] = []


def labeller() -> Labeller:
    """The trained network; a process trains once."""
    if not _trained:
        found = Labeller()
        found.fit(*labelled(range(TRAIN_PAGES)))
        found.p = {k: v.astype(np.float32) for k, v in found.p.items()}
        _trained.append(found)
    return _trained[0]


def accuracy(found: Labeller, seeds: range) -> float:
    pages, labels = labelled(seeds)
    truth = np.array([y for page in labels for y in page])
    return float(((found.probabilities(Inputs(pages)) >= 0.5) == truth).mean())


def extract_texts(found: Labeller, pages: list[str | None]) -> list[str]:
    """Main texts of pages; pages go through the network in batches of similar length."""
    cut = [blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted(range(len(pages)), key=lambda k: len(cut[k]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop - at + 1) * len(cut[order[stop]]) <= BATCH_CELLS:
            stop += 1
        some = order[at:stop]
        chances = found.probabilities(Inputs([cut[k] for k in some]))
        ends = np.cumsum([len(cut[k]) for k in some])
        for k, end in zip(some, ends, strict=True):
            mine = chances[end - len(cut[k]) : end]
            out[k] = " ".join(b[1] for b, c in zip(cut[k], mine, strict=True) if c >= 0.5)
        at = stop
    return out


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars. The trained network (about 0.5 MB) is broadcast."""
    runtime.prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(labeller())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            texts = extract_texts(found, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return df.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
