"""HTML extraction: a bidirectional LSTM in numpy labels the blocks of a page as main text or not.

A page is read into its leaf blocks, each with its tag path (tags, classes and ids from the root down) and its words.
Both are hashed into vectors; the network reads the whole sequence in both directions, so a block is judged in the
context of its document. It's trained here, on a bounded sample of pages whose blocks are labelled by the names in their
tag paths, and on variations of these pages: other names for the article, and menus, notices, forms and comments added.
Training hides the tag paths of many blocks, and of whole pages, so that words, links, lengths and neighbours decide too.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotary.llm.common import table
from quotary.llm.shingles import slices

#: Pages that the network is fitted on at most; a training step reads whole pages.
MOST_PAGES = 160
#: Share of the training pages in which paths are hidden, and of their blocks.
HIDES, HIDDEN_PATHS = 0.4, 0.5
STEPS, BATCH, RATE, HIDDEN = 260, 16, 0.01, 12
#: Hash buckets of tag paths and of words; other inputs.
PATHS, WORDS, NUMBERS = 256, 24, 6
INPUTS = PATHS + WORDS + NUMBERS
#: Pages that are labelled in lock step, and blocks of all of them together with their filling.
PAGES, CELLS = 128, 16384

#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements without an end, and elements whose content is markup but no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("svg template".split())
#: What the elements close when they begin.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements over which no implied end reaches.
SCOPE = frozenset("article aside body div footer form header main nav ol section table td th ul dl".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>"']*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|[^<]+|<""", re.S)
#: Elements whose content isn't markup either, and what ends them, wherever it stands.
LITERAL = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "iframe", "noscript")}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def _tokens(page: str) -> list[tuple[str, str, str, str]]:
    """(end mark, tag, what follows it, text) of each tag and each piece of text. Of literal elements only their tags are there; one of
    another kind than script and style that has no end has its content read."""
    out, at = [], 0
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        end, tag, rest = m.group(1) or "", (m.group(2) or "").lower(), m.group(3) or ""
        if tag:
            out.append((end, tag, rest, ""))
            if tag in LITERAL and not end and not rest.rstrip().endswith("/"):
                found = LITERAL[tag].search(page, at)
                if found or tag in ("script", "style"):
                    at = found.start() if found else len(page)
        elif not m.group().startswith(("<!", "<?")):
            out.append(("", "", "", m.group()))
    return out


def _ends(tokens: list[tuple[str, str, str, str]]) -> dict[int, int]:
    """Of each element of RAW that has an end the place of the token that ends it, nested ones included."""
    open_: dict[str, list[int]] = {tag: [] for tag in RAW}
    out = {}
    for i, (end, tag, rest, _) in enumerate(tokens):
        if tag in RAW:
            if end and open_[tag]:
                out[open_[tag].pop()] = i
            elif not end and not rest.rstrip().endswith("/"):
                open_[tag].append(i)
    return out


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """(tag path, text, share of it in links) of every leaf block with text, in page order.

    Character references are decoded, white space is one blank, ends are trimmed. Scripts, styles, comments, declarations,
    drawings and templates have no text; a drawing or template without an end is passed over, and what follows it is read. Formulas and
    what objects hold are text. Ends that are missing are implied as browsers do for p, li, dd, dt, td, th, tr, option.
    """
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = in_link = 0
    tokens = _tokens(page or "")
    ends, past = _ends(tokens), -1

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((tuple(name for _, names in stack for name in names), text, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    for at, (end, tag, rest, piece) in enumerate(tokens):
        if at <= past:
            continue
        if not tag:
            piece = html.unescape(piece)
            parts.append(piece)
            linked += len(piece.strip()) * (in_link > 0)
            continue
        if tag in RAW:
            past = ends.get(at, past)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = 0 if end else 1
            continue
        if tag not in BLOCKS:
            continue
        close()
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag == "p" and stack[i][0] in SCOPE:
                    break
            continue
        for i in range(len(stack) - 1, -1, -1):  # implied ends
            if stack[i][0] == "p" or stack[i][0] in CLOSES.get(tag, ()):
                del stack[i:]
            elif stack[i][0] in SCOPE:
                break
        if tag not in VOID:
            names = [x for g in NAMES.findall(rest) for x in re.split(r"[^a-z0-9]+", "".join(g).lower()) if x]
            stack.append((tag, (tag, *("." + x for x in names))))
    close()
    return out


def _hash(x: str, buckets: int) -> int:
    return zlib.crc32(x.encode("utf-8", "replace")) % buckets


def vectors(found: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """One row of INPUTS a block."""
    x = np.zeros((len(found), INPUTS), np.float32)
    cells, memo = [], {}
    for i, (path, text, links) in enumerate(found):
        at = memo.get(path)
        if at is None:
            at = memo[path] = sorted({_hash(p, PATHS) for p in path} | {_hash("last " + p, PATHS) for p in path[-1:]})
        x[i, at] = 1
        words = text.split(" ")
        for w in words:
            x[i, PATHS + _hash(w, WORDS)] += 1 / len(words)
        n = len(text)
        cells.append((np.log1p(n) / 6, np.log1p(len(words)) / 4, links, float(text[-1] in ".!?"), i / len(found), (len(found) - i) / len(found)))
    if cells:
        x[:, PATHS + WORDS :] = cells
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Forward and backward LSTM of HIDDEN cells each; one logistic unit on both and on the block's own inputs."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.15, (INPUTS, 4 * HIDDEN)).astype(np.float32)
            self.w["h" + d] = rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.w["c" + d] = np.zeros(4 * HIDDEN, np.float32)
            self.w["c" + d][HIDDEN : 2 * HIDDEN] = 1
        self.w["o"] = rng.normal(0, 0.2, 2 * HIDDEN + INPUTS).astype(np.float32)
        self.w["q"] = np.zeros(1, np.float32)

    def run(self, x: np.ndarray, live: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states, batch x time x HIDDEN, of one direction; where a page has no block its state stays."""
        z = x @ self.w["x" + d] + self.w["c" + d]
        h = np.zeros((len(x), HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        times = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        for t in times:
            g = z[:, t] + h @ self.w["h" + d]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            u = np.tanh(g[:, 3 * HIDDEN :])
            on = live[:, t, None]
            c2 = np.where(on, f * c + i * u, c)
            tc = np.tanh(c2)
            h2 = np.where(on, o * tc, h)
            if keep is not None:
                keep.append((t, i, f, o, u, c, tc, h, on))
            h, c = h2, c2
            out[:, t] = h
        return out

    def label(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Probability that each block is main text."""
        both = np.concatenate([self.run(x, live, "f"), self.run(x, live, "b"), x], axis=2)
        return _sigmoid(both @ self.w["o"] + self.w["q"][0])

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict:
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.run(x, live, d, kept[d]) for d in "fb"] + [x], axis=2)
        p = _sigmoid(both @ self.w["o"] + self.w["q"][0])
        err = np.where(live, p - y, 0) / max(1, live.sum())
        g = {k: np.zeros_like(w) for k, w in self.w.items()}
        g["o"] = np.einsum("bt,btk->k", err, both)
        g["q"] = np.array([err.sum()], np.float32)
        for n, d in enumerate("fb"):
            back = err[:, :, None] * self.w["o"][n * HIDDEN : (n + 1) * HIDDEN]
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            for t, i, f, o, u, c, tc, h, on in reversed(kept[d]):
                dh = dh + back[:, t]
                do = dh * tc * o * (1 - o)
                cell = dc + dh * o * (1 - tc * tc)
                one = np.concatenate([cell * u * i * (1 - i), cell * c * f * (1 - f), do, cell * i * (1 - u * u)], axis=1) * on
                dz[:, t] = one
                g["h" + d] += h.T @ one
                dh = np.where(on, one @ self.w["h" + d].T, dh)
                dc = np.where(on, cell * f, dc)
            g["c" + d] = dz.sum(axis=(0, 1))
            g["x" + d] = x.reshape(-1, INPUTS).T @ dz.reshape(-1, 4 * HIDDEN)
        return g


#: Names in a tag path that mark what isn't main text, and the article's own.
ASIDE = frozenset(
    "nav menu header footer aside sidebar notice cookie cookies consent banner ad ads advert adverts advertisement promo sponsor sponsored form button select option label fieldset legend textarea "
    "comment comments reply replies discussion related share social breadcrumb breadcrumbs pagination newsletter subscribe login search popup modal widget toolbar copyright head title dialog".split()
)
MAIN = frozenset("article main content post entry story body-text articlebody maincontent".split())


def weak_labels(found: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """1 for blocks inside an element with a name of MAIN and none with a name of ASIDE."""
    names = [{p.lstrip(".") for p in path} for path, _, _ in found]
    return np.array([float(bool(n & MAIN) and not n & ASIDE) for n in names], np.float32)


def varied(found: list, rng: np.random.Generator) -> list:
    """A page's blocks under another layout: the article renamed, and blocks that aren't main text put in around and
    inside it, with words of the page."""
    article = [("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post"), ("section", ".entry"), ("div", ".story"), ("article", ".main")][rng.integers(8)]
    clutter = [
        ("aside", "p"), ("aside", ".sidebar", "ul", "li"), ("div", ".sidebar", "p"), ("header", "p"), ("header", "h1"), ("nav", "ul", "li"), ("div", ".menu", "li"), ("div", ".cookie", ".notice"), ("div", ".notice", "p"), ("div", ".ad"),
        ("div", ".advert", "p"), ("section", ".comments", "p"), ("div", ".comments", "div", ".comment", "p"), ("ol", ".comments", "li"), ("form", "label"), ("form", "p"), ("form", "button"), ("div", ".related", "li"), ("div", ".share"),
        ("footer", "p"), ("div", ".footer"), ("div", ".banner"), ("div", ".newsletter", "p"), ("div", ".promo"), ("aside",), ("div", ".ads"), ("div", ".consent"), ("section", ".related", "h3"), ("div", ".breadcrumb"),
    ]
    out = []
    texts = [t for _, t, _ in found]

    def stray(inside: bool) -> None:
        kind = clutter[rng.integers(len(clutter))]
        base = ("html", "body", *(article if inside else ()))
        for _ in range(int(rng.integers(1, 5))):
            text = texts[rng.integers(len(texts))]
            if rng.random() < 0.5:
                text = " ".join(text.split()[: int(rng.integers(1, 12))])
            out.append((base + kind, text or "x", float(kind[-1] == "li" and rng.random() < 0.7)))

    for i, (path, text, links) in enumerate(found):
        inside = "article" in path
        if rng.random() < (0.04 if inside else 0.2):
            stray(inside and rng.random() < 0.6)
        if inside:
            path = tuple(y for p in path for y in (article if p == "article" else (p,)))
            if rng.random() < 0.06:
                path = (*path[:-1], ["h2", "h3", "blockquote", "li", "pre", "td", "dd", "figcaption"][rng.integers(8)])
        out.append((path, text, links))
    if rng.random() < 0.5:
        stray(False)
    return out


def train(pages: list[str], seed: int = 0) -> Labeller:
    """A labeller fitted to pages and variations of them. Without a block, an untrained one."""
    net, rng = Labeller(seed), np.random.default_rng(seed + 1)
    read = [b for b in (blocks(p) for p in pages) if b]
    if not read:
        return net
    m, s = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        chosen = [varied(read[j], rng) if rng.random() < 0.7 else read[j] for j in rng.integers(0, len(read), BATCH)]
        most = max(len(b) for b in chosen)
        x, y, live = np.zeros((BATCH, most, INPUTS), np.float32), np.zeros((BATCH, most), np.float32), np.zeros((BATCH, most), bool)
        for i, b in enumerate(chosen):
            x[i, : len(b)], y[i, : len(b)], live[i, : len(b)] = vectors(b), weak_labels(b), True
            if rng.random() < HIDES:
                x[i, : len(b), :PATHS][rng.random(len(b)) < HIDDEN_PATHS] = 0
        grads = net.gradients(x, live, y)
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, w in net.w.items():
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            s[k] = 0.99 * s[k] + 0.01 * grads[k] * grads[k]
            w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
    return net


def main_texts(net: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page: its blocks of probability 0.5 or more, joined by one newline."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
    while order:
        take = min(PAGES, len(order))
        while take > 1 and take * len(found[order[take - 1]]) > CELLS:
            take = max(1, take // 2)
        now, order = order[:take], order[take:]
        most = len(found[now[-1]])
        x, live = np.zeros((take, most, INPUTS), np.float32), np.zeros((take, most), bool)
        for r, i in enumerate(now):
            x[r, : len(found[i])], live[r, : len(found[i])] = vectors(found[i]), True
        p = net.label(x, live)
        for r, i in enumerate(now):
            out[i] = "\n".join(text for (_, text, _), q in zip(found[i], p[r], strict=False) if q >= 0.5)
    return out


def fit(pages: DataFrame, *, key: str = "page_id", page: str = "html", most: int = MOST_PAGES) -> Labeller:
    """A labeller fitted on at most `most` pages (a documented bound), chosen by a hash of their keys. Only keys are compared
    to choose; then the chosen pages are read, one for each key. Pages without a key or html aren't read."""
    some = pages.where(F.col(page).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(page).alias("_page"))
    few = some.select("_key").orderBy(F.md5(F.col("_key").cast("string")), "_key").limit(most).distinct()
    got = some.join(F.broadcast(few), "_key").groupBy("_key").agg(F.min("_page").alias("_page")).orderBy("_key").collect()  # `most` rows
    return train([r["_page"] for r in got])


def with_main_text(pages: DataFrame, net: Labeller, *, page: str = "html", out: str = "text") -> DataFrame:
    """pages with their main text: empty for null and empty pages and pages without main text. A column of pages named
    `out` is replaced, all others are kept; an empty table gives an empty result; rows don't depend on each other."""
    from pyspark.sql import types as T

    pages = pages.drop(out)
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())])
    shared = pages.sparkSession.sparkContext.broadcast(net)  # fixed size: some 120 kB

    def extract(batches):
        for whole in batches:
            for batch in slices(whole, 4 << 20, text=page):
                texts = main_texts(shared.value, batch.column(batch.schema.get_field_index(page)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return pages.mapInArrow(extract, schema)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_main_text(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
