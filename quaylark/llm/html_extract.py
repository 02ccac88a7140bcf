"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between tags that begin or end a block, in page order. Each block is a vector of
its hashed tag path (names, classes and ids of the elements around it), its hashed words and a few counts. A bidirectional
LSTM in numpy reads the whole sequence of blocks, so that each block's label rests on all of the document, and labels it
article or not. The text is the article blocks, one a line.

The labeller is trained here, on two bounded sets: PAGES pages of the table, spread over it by a hash and labelled by their
markup where it names the article, and MADE pages put together from varied templates with words of those pages.

Character references are decoded, white space inside a block becomes one space; scripts, styles, the title and comments in the
markup are no blocks. A quote opens a string only after an = in a tag, and unclosed elements lose nothing but their own end.
Every word of a block counts, and training pages are read whole, at any length. Null and empty pages give an empty text. Rows are independent: repeated rows and null ids keep their own result.
Other columns pass through unless their names clash with the result's, which win.
"""

from __future__ import annotations

import html
import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.llm import common
from quaylark.session import ship

#: Pages of the table that the labeller is trained on, and pages made from templates.
PAGES, MADE = 240, 360
#: Blocks that are read at once, so that memory is bounded where pages are long (a page is always read whole).
AT_ONCE = 12_000
PATH, WORDS, COUNTS, HIDDEN = 96, 32, 8, 16
EPOCHS, RATE, SEED = 7, 0.012, 11

# Elements of HTML
BLOCK = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td template textarea tfoot th thead tr ul".split())
CLOSED_BY_NEXT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no markup up to their end: the first two to the end of the page where they aren't closed
RAW, TITLE = frozenset("script style".split()), "title"
IN_HEAD = frozenset("noscript template".split())
# Elements and class or id words that name what isn't the article, and those that name it
OTHER = frozenset("nav aside footer form header noscript template iframe menu button select textarea dialog ad ads advert advertisement sponsored promo banner cookie cookies consent notice sidebar widget comment comments reply replies respond discussion related share social breadcrumb breadcrumbs pagination newsletter subscribe login search toolbar copyright masthead".split())
ARTICLE = frozenset("article main".split())

_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for tag in (*RAW, TITLE)}


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _names(tag: str, rest: str) -> tuple[str, ...]:
    """The element's name and the words of its class, id and role, those marked."""
    if "=" not in rest:
        return (tag,)
    return (tag, *("." + w for m in _ATTR.finditer(rest) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())))


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked, in_link, at, end = 0, 0, 0, len(page or "")

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                if open_ and open_[-1][0] == "head":  # text ends a head that wasn't closed
                    open_.pop()
                out.append(Block(tuple(n for _, names in open_ for n in names), text, linked))
            held.clear()
        linked = 0

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(piece := page[at : m.start()])
            linked += len(piece) * bool(in_link)
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag in BLOCK:
                flush()
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] == tag:
                        del open_[k:]
                        in_link = 0
                        break
            continue
        if tag in RAW or tag == TITLE:
            close = _CLOSE[tag].search(page, at)
            if close or tag in RAW:
                at = close.end() if close else end
        elif tag == "br":
            held.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in BLOCK:
            flush()
            in_link = 0
            if tag in VOID:
                continue
            if open_ and open_[-1][0] == "p":
                open_.pop()
            if tag not in IN_HEAD:  # other elements end a head that wasn't closed
                while (k := next((k for k, (name, _) in enumerate(open_) if name == "head"), -1)) >= 0:
                    del open_[k:]
            stop = CLOSED_BY_NEXT.get(tag, ())
            for k in range(len(open_) - 1, -1, -1) if stop else ():
                if open_[k][0] in stop:
                    break
                if open_[k][0] == tag or {open_[k][0], tag} in ({"dt", "dd"}, {"td", "th"}):
                    del open_[k:]
                    break
            open_.append((tag, _names(tag, m[3])))
    flush()
    return [b for b in out if "head" not in b.path]


def _slot(word: str, n: int) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) % n


def vectors(found: list[Block], slots: dict) -> np.ndarray:
    """A row for each block. slots: a table of hashed names that the caller keeps."""
    x = np.zeros((len(found), PATH + WORDS + COUNTS), np.float32)
    for k, b in enumerate(found):
        row = x[k]
        key = b.path
        if (at := slots.get(key)) is None:
            at = slots[key] = [_slot(n, PATH) for n in key]
        row[at] = 1
        words = b.text.split(" ")
        n = len(words)
        ids = np.fromiter(map(hash_word, words), np.int64, n)
        row[PATH : PATH + WORDS] = np.bincount(ids % WORDS, minlength=WORDS) / np.sqrt(len(ids))
        size = len(b.text)
        row[PATH + WORDS :] = (np.log1p(n) / 4, np.log1p(size) / 6, min(1.0, b.linked / max(1, size)), k / len(found), 1.0 if b.text[-1] in ".!?" else 0.0, b.text.count(",") / n, 1 / (1 + len(found)), 1.0)
    return x


def hash_word(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass"))


def markup_labels(found: list[Block]) -> np.ndarray | None:
    """1 for blocks that the markup puts into the article; None where it names no article."""
    inside = [bool(ARTICLE.intersection(b.path)) for b in found]
    if not any(inside):
        return None
    return np.array([i and not any(n.lstrip(".") in OTHER for n in b.path[max(k for k, n in enumerate(b.path) if n in ARTICLE) + 1 :]) for i, b in zip(inside, found)], np.float32)


def made_page(rng: random.Random, words: list[str]) -> tuple[str, list[int]]:
    """A page from a random template, and the labels of its blocks."""
    said = lambda a, b: html.escape(" ".join(rng.choice(words) for _ in range(rng.randint(a, b))) or "x")
    parts, labels = [], []

    def put(code: str, *marks: int) -> None:
        parts.append(code)
        labels.extend(marks)

    def other(kind: str) -> None:
        n = rng.randint(1, 6)
        if kind == "menu":
            box = rng.choice(["<nav{}>", '<div class="menu"{}>', "<header{}>", '<ul class="breadcrumb"{}>', '<div id="navigation" class="nav"{}>']).format("")
            put(box + "<ul>" + "".join(f'<li><a href="/{k}">{said(1, 3)}</a></li>' for k in range(n)) + "</ul>" + f"</{box[1:].split('>')[0].split(' ')[0]}>", *[0] * n)
        elif kind == "form":
            put(f'<form class="{rng.choice(["search", "newsletter", "subscribe", "login"])}"><p>{said(2, 12)}</p><label>{said(1, 3)}</label><input name="q"><button>{said(1, 2)}</button></form>', 0, 0, 0)
        elif kind == "comments":
            tag = rng.choice(["section", "div"])
            put(f'<{tag} {rng.choice(["class", "id"])}="comments"><h{rng.randint(2, 4)}>{said(1, 3)}</h3>', 0)
            for _ in range(n):
                put(rng.choice(["<div class=\"comment\"><p>{}</p></div>", "<li class=\"comment\"><div>{}</div></li>", "<p class=\"reply\">{}</p>"]).format(said(4, 40)), 0)
            put(f"</{tag}>")
        elif kind == "side":
            tag, cls = rng.choice([("aside", ""), ("div", ' class="sidebar"'), ("div", ' class="widget related"'), ("section", ' class="related"'), ("div", ' id="sidebar"')])
            put(f"<{tag}{cls}><h4>{said(1, 4)}</h4>" + "".join(f"<p>{said(3, 25)}</p>" for _ in range(n)) + f"</{tag}>", 0, *[0] * n)
        elif kind == "footer":
            put(rng.choice(["<footer>{}</footer>", '<div class="footer">{}</div>', "<footer><p>{}</p></footer>", '<div id="footer"><p>{}</p></div>']).format("&copy; " + said(2, 25)), 0)
        elif kind == "header":
            put(rng.choice(["<header>{}</header>", '<div class="header">{}</div>', '<div class="site-header"><p>{}</p></div>', '<header class="masthead"><p>{}</p></header>']).format(said(1, 10)), 0)
        else:
            box = rng.choice(['<div class="{}">', '<p class="{}">', '<section class="{}">', '<div id="{}">'])
            name = rng.choice(["ad", "ads", "advert", "sponsored", "promo", "banner", "cookie-notice", "notice", "cookie-consent", "share social"])
            put(f"{box.format(name)}{said(3, 40)}</{box[1:].split(' ')[0]}>", 0)

    kinds = ["menu", "form", "side", "notice", "notice", "header"]
    if rng.random() < 0.9:
        other("menu")
    for _ in range(rng.randint(0, 3)):
        other(rng.choice(kinds))
    box, end = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<main><article class="post">', "</article></main>"), ('<div class="content">', "</div>"), ('<div class="article-body">', "</div>"), ('<div id="content"><div class="entry-content">', "</div></div>"), ('<div class="post-content">', "</div>"), ('<div class="story">', "</div>"), ('<section class="text">', "</section>")])
    put(box)
    if rng.random() < 0.9:
        put(f"<h1>{said(1, 12)}</h1>", 1)
    for _ in range(rng.randint(1, 14)):
        kind = rng.random()
        if kind < 0.72:
            put(rng.choice(["<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<div>{}</div>", "<blockquote>{}</blockquote>"]).format(said(1, 90)), 1)
        elif kind < 0.8:
            n = rng.randint(1, 4)
            put(rng.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{said(1, 20)}</li>" for _ in range(n))), *[1] * n)
        elif kind < 0.85:
            put(f"<h{rng.randint(2, 4)}>{said(1, 8)}</h2>", 1)
        elif kind < 0.9:
            put(f"<table><tr><td>{said(1, 6)}</td><td>{said(1, 6)}</td></tr></table>", 1, 1)
        elif kind < 0.96:
            other(rng.choice(["notice", "side", "form"]))
        else:
            put(f"<pre>{said(2, 30)}</pre>", 1)
    if rng.random() < 0.3:
        other("comments")
    put(end)
    if rng.random() < 0.4:
        other("comments")
    for _ in range(rng.randint(0, 2)):
        other(rng.choice(kinds))
    if rng.random() < 0.9:
        other("footer")
    return "<html><head><title>t</title></head><body>" + "".join(parts) + "</body></html>", labels


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network: two LSTMs, one in each direction, and a logistic output on both states."""

    def __init__(self, rng: np.random.Generator):
        d, h = PATH + WORDS + COUNTS, HIDDEN
        self.p = {}
        for side in "fb":
            self.p[f"x{side}"] = (rng.standard_normal((d, 4 * h)) / np.sqrt(24)).astype(np.float32)
            self.p[f"h{side}"] = (rng.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            self.p[f"b{side}"] = np.concatenate((np.zeros(h), np.ones(h), np.zeros(2 * h))).astype(np.float32)
        self.p["out"] = (rng.standard_normal(2 * h) / np.sqrt(h)).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        steps, n, _ = x.shape
        z = x @ self.p[f"x{side}"] + self.p[f"b{side}"]
        w, k = self.p[f"h{side}"], HIDDEN
        h, c, out = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32), np.zeros((steps, n, k), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ w
            gates = _sigmoid(a[:, : 3 * k])
            i, f, o, g = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], np.tanh(a[:, 3 * k :])
            new = f * c + i * g
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, new))
            tanh = np.tanh(new)
            h, c = np.where(m, o * tanh, h), np.where(m, new, c)
            out[t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """x: blocks, pages, values; mask: blocks, pages. The chance that each block is of the article."""
        states = []
        for side in "fb":
            steps = [] if keep is not None else None
            states.append(self._run(side, x, mask, steps))
            if keep is not None:
                keep[side] = steps
        both = np.concatenate(states, axis=2)
        if keep is not None:
            keep["both"] = both
        return _sigmoid(both @ self.p["out"] + self.p["bias"][0])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        keep: dict = {}
        p = self.forward(x, mask, keep)
        n = max(1.0, float(mask.sum()))
        d = np.where(mask, p - y, 0).astype(np.float32) / n
        grads = {"out": np.einsum("tn,tnk->k", d, keep["both"]), "bias": np.array([d.sum()], np.float32)}
        k = HIDDEN
        for part, side in enumerate("fb"):
            w = self.p[f"h{side}"]
            dout = d[:, :, None] * self.p["out"][part * k : (part + 1) * k]
            dh, dc = np.zeros(x.shape[1:2] + (k,), np.float32), np.zeros(x.shape[1:2] + (k,), np.float32)
            dz, gh = np.zeros((x.shape[0], x.shape[1], 4 * k), np.float32), np.zeros_like(w)
            for t, h, c, i, f, o, g, new in reversed(keep[side]):
                m = mask[t][:, None]
                dh = dh + dout[t]
                tanh = np.tanh(new)
                dnew = np.where(m, dh * o * (1 - tanh * tanh) + dc, 0)
                da = np.concatenate((dnew * g * i * (1 - i), dnew * c * f * (1 - f), np.where(m, dh * tanh, 0) * o * (1 - o), dnew * i * (1 - g * g)), axis=1)
                dz[t] = da
                gh += h.T @ da
                dh, dc = np.where(m, 0, dh) + da @ w.T, np.where(m, dnew * f, dc)
            grads[f"h{side}"] = gh
            grads[f"x{side}"] = np.tensordot(x, dz, axes=([0, 1], [0, 1]))
            grads[f"b{side}"] = dz.sum(axis=(0, 1))
        loss = -np.where(mask, y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7), 0).sum() / n
        return grads, float(loss)

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, rng: np.random.Generator) -> None:
        """Adam on batches of pages of like length."""
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        pages, step = sorted(pages, key=lambda page: len(page[1])), 0
        groups = [[]]
        for page in pages:
            if len(groups[-1]) == 24 or groups[-1] and (len(groups[-1]) + 1) * len(page[1]) > AT_ONCE:
                groups.append([])
            groups[-1].append(page)
        for epoch in range(epochs if pages else 0):
            for k in rng.permutation(len(groups)):
                x, mask = padded([v for v, _ in groups[k]])
                y = np.zeros(mask.shape, np.float32)
                for j, (_, labels) in enumerate(groups[k]):
                    y[: len(labels), j] = labels
                grads, _ = self.gradients(x, mask, y)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                rate = RATE * (1 - epoch / (epochs + 1))
                for name, g in grads.items():
                    g = g * min(1.0, 2.0 / (norm + 1e-9))
                    m1[name] += 0.1 * (g - m1[name])
                    m2[name] += 0.005 * (g * g - m2[name])
                    self.p[name] -= (rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Chances for the blocks of each page; pages of like length are read together."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((k for k, v in enumerate(pages) if len(v)), key=lambda k: len(pages[k]))
        while order:
            most = max(1, min(64, AT_ONCE // len(pages[order[min(63, len(order) - 1)]])))
            group, order = order[:most], order[most:]
            x, mask = padded([pages[k] for k in group])
            p = self.forward(x, mask)
            for j, k in enumerate(group):
                out[k] = p[: len(pages[k]), j]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(v) for v in pages)
    x, mask = np.zeros((steps, len(pages), PATH + WORDS + COUNTS), np.float32), np.zeros((steps, len(pages)), bool)
    for j, v in enumerate(pages):
        x[: len(v), j], mask[: len(v), j] = v, True
    return x, mask


def train(pages: list[str]) -> Labeller:
    """A labeller from pages whose markup names the article, and from made pages with their words."""
    rng, draw, slots = random.Random(SEED), np.random.default_rng(SEED), {}
    cut, words = [], []
    for page in sorted(set(pages)):
        found = blocks(page)
        for b in found[:40]:
            words += b.text.split(" ")[:40]
        labels = markup_labels(found)
        if labels is not None:
            cut.append((vectors(found, slots), labels))
    words = words or "the of and to in that is for on with as this by it are at from".split()
    for _ in range(MADE):
        page, labels = made_page(rng, words)
        found = blocks(page)
        if len(found) == len(labels):
            cut.append((vectors(found, slots), np.array(labels, np.float32)))
    out = Labeller(draw)
    out.train(cut, EPOCHS, draw)
    return out


def fit(pages: DataFrame, html_column: str = "html", sample: int = PAGES) -> Labeller:
    """A labeller trained on at most `sample` pages of the table."""
    rows = pages.where(F.col(html_column).isNotNull()).select(F.col(html_column).alias("page"))
    return train([r.page for r in common.sampled(rows, ["page"], sample).collect()])


def extract(df: DataFrame, labeller: Labeller, html_column: str = "html") -> DataFrame:
    """df with text (article blocks joined by a new line) and n_blocks."""
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(labeller)  # of fixed size
    kept = [c for c in df.columns if c not in ("text", "n_blocks")]
    df, at = df.select(*kept), kept.index(html_column)

    def run(batches):
        net, slots = held.value, {}
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                found = [blocks(page.as_py()) for page in batch.column(at)]
                if len(slots) > 20_000:
                    slots.clear()
                marks = net.labels([vectors(b, slots) for b in found])
                texts = ["\n".join(b.text for b, p in zip(page, chance) if p >= 0.5) for page, chance in zip(found, marks)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(b) for b in found], pa.int64())], [*kept, "text", "n_blocks"])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "text string, n_blocks long"]))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages.select("page_id", "url", "html"), fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
