"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is a vector: the mean embedding of the hashed elements of its
tag path, the mean embedding of its hashed words, and a few numbers (length, share of linked text, place). An LSTM reads
the sequence forwards and one backwards, so that every block is labelled in the context of the whole page; blocks
labelled as content make up the text.

The network is plain numpy. It is trained on a bounded sample of pages of the table, labelled by what their elements
say (`article`, `nav`, class names and so on), and on page layouts made up from lists of such names, so that it has seen
layouts that the sample lacks. Sample, lists and seeds are fixed, so training is repeatable for a table.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import pieces, tidy
from tidelog.llm.html_blocks import Block, blocks
from tidelog.llm.words import hashes, spans

SAMPLE_PAGES = 300  # pages to learn from, about
SAMPLE_CHARS = 50_000  # longer pages are not learned from
MADE_PAGES = 500
LONGEST = 64  # blocks of a page to learn from
PATHS, WORDS = 1 << 12, 1 << 12  # hashed elements, hashed words
PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 24, 8, 6, 16
EPOCHS, BATCH, RATE = 12, 32, 0.01
BATCH_BLOCKS = 1 << 13

# Names that tell what an element holds.
CONTENT = "article main content post entry story body text prose".split()
NOT_CONTENT = ("nav menu navbar navigation header masthead topbar banner footer bottom copyright sidebar aside rail widget "
               "related recommended trending ad ads advert advertisement sponsor sponsored promo cookie cookies consent "
               "notice alert popup modal newsletter subscribe signup form login search comment comments reply replies "
               "discussion respond share social breadcrumb breadcrumbs pagination pager toolbar hidden legal tags").split()
TAGS_OUT = "head title nav header footer aside form button select option dialog menu noscript label input fieldset".split()
_OUT, _IN = frozenset(NOT_CONTENT), frozenset(CONTENT)


def taught(page: list[Block]) -> np.ndarray | None:
    """Labels by element names, or None where they say nothing: no block is inside a content element."""
    out, inside = np.zeros(len(page)), False
    for i, block in enumerate(page):
        names = [m.rpartition(":")[2] for m in block.path if ":" in m]
        bad = any(m in TAGS_OUT or m == "hidden" for m in block.path) or any(n in _OUT for n in names)
        good = "article" in block.path or "main" in block.path or any(n in _IN for n in names)
        inside |= good
        out[i] = good and not bad
    return out if inside else None


def made_up(seed: int) -> tuple[list[Block], np.ndarray]:
    """A page layout from the lists of names, with words that mean nothing."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
                        for _ in range(rng.randint(low, high)))

    def around(name: str) -> tuple[str, ...]:
        kind = rng.random()
        marker = f"{rng.choice(['class', 'id', 'role'])}:{name}"
        return (rng.choice(["div", "section", "div"]), marker, *([f"class:{words(1, 1)}"] if kind < 0.3 else []))

    shell = ("html", "body", *(("div", f"class:{rng.choice(['wrapper', 'container', 'page', 'site', 'row'])}")
                               if rng.random() < 0.5 else ()))
    page: list[tuple[Block, int]] = []

    def boiler(times: int, inside: tuple[str, ...]) -> None:
        for _ in range(times):
            tag = rng.choice(["nav", "header", "footer", "aside", "form"]) if rng.random() < 0.4 else None
            path = inside + ((tag,) if tag else around(rng.choice(NOT_CONTENT)))
            short = rng.random() < 0.5
            for _ in range(rng.randint(1, 6)):
                leaf = rng.choice([("ul", "li"), ("p",), (), ("h3",), ("div",)])
                text = words(1, 4) if short else words(4, 40)
                page.append((Block(text, path + leaf, len(text) if rng.random() < 0.5 and short else 0), 0))

    if rng.random() < 0.7:
        page.append((Block(words(2, 8), ("html", "head", "title"), 0), 0))
    boiler(rng.randint(0, 3), shell)
    kind = rng.choice(["article", "main", "class", "both"])
    outer = shell + {"article": ("article",), "main": ("main",), "both": ("main", "article"),
                     "class": around(rng.choice(CONTENT))}[kind]
    if rng.random() < 0.7:
        page.append((Block(words(2, 9), outer + ("h1",), 0), 1))
    for _ in range(rng.randint(1, 14)):
        leaf = rng.choice([("p",)] * 6 + [("h2",), ("ul", "li"), ("blockquote", "p"), ("pre",), ("table", "tr", "td"), ()])
        page.append((Block(words(1, 60), outer + leaf, 0), 1))
        if rng.random() < 0.08:
            boiler(1, outer)
    boiler(rng.randint(0, 4), shell)
    return [b for b, _ in page], np.array([label for _, label in page], float)


class Inputs:
    """The blocks of several pages as flat arrays of hashed elements, hashed words and numbers."""

    def __init__(self, pages: list[list[Block]]):
        flat = [b for page in pages for b in page]
        self.sizes = np.array([len(p) for p in pages])
        memo: dict[str, int] = {}
        self.path = np.array([memo.setdefault(m, zlib.crc32(m.encode()) % PATHS) for b in flat for m in ("", *b.path)], np.int32)
        self.path_size = np.array([len(b.path) + 1 for b in flat])
        raw = [b.text.encode() for b in flat]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts, ends = spans(data, offsets)
        self.word = (hashes(data, starts, ends) % np.uint64(WORDS)).astype(np.int32)
        self.word_size = np.diff(np.searchsorted(starts, offsets))
        chars = np.array([len(b.text) for b in flat], float)
        place = np.concatenate([np.arange(n) / max(1, n - 1) for n in self.sizes]) if len(flat) else np.zeros(0)
        self.numbers = np.stack([np.log1p(chars) / 5, np.log1p(self.word_size) / 4,
                                 [min(1.0, b.linked / max(1, len(b.text))) for b in flat], place,
                                 [b.text[-1:] in ".!?" for b in flat], self.path_size / 10], axis=1) if flat else np.zeros((0, NUMBERS))


def _mean(table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean row of each run of ids; zero for an empty run."""
    out = np.zeros((len(sizes), table.shape[1]), table.dtype)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for low in range(0, len(full), 1 << 12):
            a, b = starts[low], starts[low + (1 << 12)] if low + (1 << 12) < len(full) else len(ids)
            out[full[low:low + (1 << 12)]] = np.add.reduceat(table[ids[a:b]], starts[low:low + (1 << 12)] - a, axis=0)
        out[full] /= sizes[full, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, two LSTMs and a logistic layer."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        wide = PATH_DIM + WORD_DIM + NUMBERS
        self.p = {"path": rng.normal(0, 0.3, (PATHS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORDS, WORD_DIM)),
                  "out": rng.normal(0, 0.2, (2 * HIDDEN, 1)), "bias": np.zeros(1)}
        for side in ("f", "b"):
            self.p[f"{side}x"] = rng.normal(0, wide ** -0.5, (wide, 4 * HIDDEN))
            self.p[f"{side}h"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN))
            self.p[f"{side}1"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)

    def vectors(self, x: Inputs) -> np.ndarray:
        return np.concatenate([_mean(self.p["path"], x.path, x.path_size), _mean(self.p["word"], x.word, x.word_size),
                               x.numbers], axis=1)

    def _read(self, side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States [time, page, HIDDEN] of one LSTM over x [time, page, wide]; beyond a page's end they stay as they are."""
        h = c = np.zeros((x.shape[1], HIDDEN))
        given = x @ self.p[f"{side}x"] + self.p[f"{side}1"]
        states, steps = np.empty((*x.shape[:2], HIDDEN)), []
        for t in range(len(x)):
            i, f, g, o = np.split(given[t] + h @ self.p[f"{side}h"], 4, axis=1)
            i, f, g, o, m = _sigmoid(i), _sigmoid(f), np.tanh(g), _sigmoid(o), mask[t][:, None]
            new_c = f * c + i * g
            th = np.tanh(new_c)
            steps.append((i, f, g, o, th, c, h, m))
            c, h = m * new_c + (1 - m) * c, m * o * th + (1 - m) * h
            states[t] = h
        return states, steps

    def _unread(self, side: str, x: np.ndarray, steps: list, d: np.ndarray, grads: dict) -> np.ndarray:
        """Gradients of one LSTM from those of its states; returns those of its input."""
        dh = dc = np.zeros((x.shape[1], HIDDEN))
        dx = np.empty_like(x)
        for t in range(len(x) - 1, -1, -1):
            i, f, g, o, th, c, h, m = steps[t]
            dh = dh + d[t]
            on, oc = dh * m, dc * m + dh * m * o * (1 - th ** 2)
            gates = np.concatenate([oc * g * i * (1 - i), oc * c * f * (1 - f), oc * i * (1 - g ** 2), on * th * o * (1 - o)], 1)
            grads[f"{side}x"] += x[t].T @ gates
            grads[f"{side}h"] += h.T @ gates
            grads[f"{side}1"] += gates.sum(axis=0)
            dx[t] = gates @ self.p[f"{side}x"].T
            dh, dc = dh * (1 - m) + gates @ self.p[f"{side}h"].T, dc * (1 - m) + oc * f
        return dx

    @staticmethod
    def _padded(v: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """[time, page, wide], the mask, and the flat place of each block."""
        page = np.repeat(np.arange(len(sizes)), sizes)
        time = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        x, mask = np.zeros((sizes.max(), len(sizes), v.shape[1])), np.zeros((sizes.max(), len(sizes)))
        x[time, page], mask[time, page] = v, 1
        return x, mask, np.stack([time, page])

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of being content for every block of every page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:  # pages of about one length at a time
            some, total = [], 0
            while order and (not some or (len(some) + 1) * len(pages[order[0]]) <= BATCH_BLOCKS):
                some.append(order.pop(0))
            x = Inputs([pages[i] for i in some])
            padded, mask, at = self._padded(self.vectors(x), x.sizes)
            p = _sigmoid(self._states(padded, mask)[0][at[0], at[1]] @ self.p["out"] + self.p["bias"])[:, 0]
            for i, part in zip(some, np.split(p, np.cumsum(x.sizes)[:-1])):
                out[i] = part
        return out

    def _states(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list, list]:
        forward, f_steps = self._read("f", x, mask)
        backward, b_steps = self._read("b", x[::-1], mask[::-1])
        return np.concatenate([forward, backward[::-1]], axis=2), f_steps, b_steps

    def train(self, pages: list[list[Block]], labels: list[np.ndarray], seed: int = 7) -> Labeller:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(pages))
            for low in range(0, len(order), BATCH):
                some = order[low:low + BATCH]
                x, y = Inputs([pages[i] for i in some]), np.concatenate([labels[i] for i in some])
                padded, mask, at = self._padded(self.vectors(x), x.sizes)
                states, f_steps, b_steps = self._states(padded, mask)
                d = (_sigmoid(states[at[0], at[1]] @ self.p["out"] + self.p["bias"])[:, 0] - y) / len(y)
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                grads["out"] = states[at[0], at[1]].T @ d[:, None]
                grads["bias"] = d.sum(keepdims=True)
                ds = np.zeros_like(states)
                ds[at[0], at[1]] = d[:, None] * self.p["out"][:, 0]
                dx = self._unread("f", padded, f_steps, ds[:, :, :HIDDEN], grads)
                dx += self._unread("b", padded[::-1], b_steps, ds[::-1, :, HIDDEN:], grads)[::-1]
                dv = dx[at[0], at[1]]
                for name, ids, sizes, part in (("path", x.path, x.path_size, dv[:, :PATH_DIM]),
                                               ("word", x.word, x.word_size, dv[:, PATH_DIM:PATH_DIM + WORD_DIM])):
                    np.add.at(grads[name], ids, np.repeat(part / np.maximum(sizes, 1)[:, None], sizes, axis=0))
                step += 1
                for k, g in grads.items():  # Adam
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    self.p[k] -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def learn(pages: DataFrame) -> Labeller:
    """Train on a sample of `pages` of bounded size, and on made-up layouts."""
    usable = pages.where(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS)).select("page_id", "html")
    n, steps = usable.count(), 1 << 20
    sample = usable.where(F.pmod(F.xxhash64("page_id", "html"), F.lit(steps)) < min(steps, -(-steps * SAMPLE_PAGES // max(1, n))))
    pairs = []
    for row in sample.orderBy(F.xxhash64("page_id", "html")).limit(2 * SAMPLE_PAGES).collect():
        page = blocks(row["html"])
        labels = taught(page)
        if labels is not None:
            pairs.append((page[:LONGEST], labels[:LONGEST]))
    pairs += [made_up(seed) for seed in range(MADE_PAGES)]
    pairs = [(p, y) for p, y in pairs if len(p)]
    return Labeller().train([p for p, _ in pairs], [y for _, y in pairs])


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """`pages` with a column `text`: the blocks labelled as content, joined by empty lines; "" if there are none.

    A null html counts as empty. All columns are kept but for an old `text`; nothing is cut off a page.
    """
    held = pages.sparkSession.sparkContext.broadcast(labeller)  # a network of fixed size
    names = [c for c in pages.columns if c != "text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 2 << 20):
            found = [blocks(p or "") for p in batch.column("html").to_pylist()]
            texts = ["\n\n".join(b.text for b, p in zip(page, ps) if p > 0.5)
                     for page, ps in zip(found, held.value.label(found))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"])

    return pages.select(*names).mapInArrow(tidy(read), pages.select(*names).schema.add("text", "string"))


def main_text_report(pages: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url", "html")
    out = extract(pages, learn(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
