"""HTML extraction by a recurrent block labeller: a bidirectional LSTM in numpy reads each page's
leaf blocks (tag-path and hashed-word vectors, a few figures) and labels every block with the whole
page as context.

The pages have no labels, so the model is trained on made-up labelled pages (html_blocks), a fixed
number whatever the input, in one task; its weights (about 200 kB) are broadcast. Extraction is one
pass without a shuffle.
"""

from __future__ import annotations

import pickle
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import batches
from corroborate.llm.html_blocks import MINE, Block, blocks, made_up_page


@dataclass(frozen=True)
class Settings:
    path_rows: int = 1024
    word_rows: int = 1024
    path_dim: int = 16
    word_dim: int = 8
    hidden: int = 16
    pages: int = 1000
    epochs: int = 7
    rate: float = 0.01
    seed: int = 7


FIGURES = 8


class Slots(dict):
    """Token -> row of a hashed table, kept for repeated tokens up to a limit."""

    def __init__(self, rows: int):
        super().__init__()
        self.rows = rows

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % self.rows
        return got


def encode(page: list[Block], path: Slots, word: Slots) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each block: rows of its path's and of its words' vectors, and figures."""
    paths, words, figures = [], [], np.zeros((len(page), FIGURES), dtype=np.float32)
    for k, b in enumerate(page):
        leaf = next((x for x in reversed(b.path) if x[0] != "."), "")
        paths.append(np.array([path[x] for x in b.path] + [path["leaf:" + leaf]], dtype=np.int32))
        own = b.text.lower().split()
        words.append(np.fromiter(map(word.__getitem__, own), dtype=np.int32, count=len(own)))
        n = len(b.text)
        figures[k] = (1, np.log1p(n) / 5, np.log1p(len(own)) / 4, b.linked / n, (k + 1) / len(page), len(own) < 4, b.text[-1] in ".!?", b.text[0].islower())
    return paths, words, figures


def mean_rows(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Mean of the table's rows, for each (non-empty) list of rows."""
    sizes = np.array([len(x) for x in rows])
    return np.add.reduceat(table[np.concatenate(rows)], np.r_[0, np.cumsum(sizes)[:-1]], axis=0) / sizes[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False):
    """LSTM over (time, page, dim); masked steps leave the state as it was."""
    t, n, h = len(x), x.shape[1], len(u)
    state, cell, out, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((t, n, h), np.float32), []
    fed = x @ w + b
    for k in range(t):
        z = fed[k] + state @ u
        gates, g, m = sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :]), mask[k][:, None]
        i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        new = f * cell + i * g
        top = np.tanh(new)
        if keep:
            kept.append((state, cell, i, f, o, g, top, m))
        state, cell = m * (o * top) + (1 - m) * state, m * new + (1 - m) * cell
        out[k] = state
    return out, kept


def backward(d_out: np.ndarray, x: np.ndarray, kept: list, w: np.ndarray, u: np.ndarray):
    """Gradients of the input, w, u and b."""
    h = len(u)
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * h, np.float32), np.zeros_like(x)
    ds, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
    for k in range(len(x) - 1, -1, -1):
        before, cell, i, f, o, g, top, m = kept[k]
        ds = ds + d_out[k]
        d_new = m * (ds * o * (1 - top**2)) + m * dc
        dz = np.concatenate([d_new * g * i * (1 - i), d_new * cell * f * (1 - f), m * ds * top * o * (1 - o), d_new * i * (1 - g**2)], axis=1)
        dw += x[k].T @ dz
        du += before.T @ dz
        db += dz.sum(0)
        dx[k] = dz @ w.T
        ds, dc = (1 - m) * ds + dz @ u.T, d_new * f + (1 - m) * dc
    return dx, dw, du, db


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time, page, dim) forwards and, turned round page by page, backwards; and the mask."""
    t, n, d = max(map(len, pages)), len(pages), pages[0].shape[1]
    x, y, mask = np.zeros((t, n, d), np.float32), np.zeros((t, n, d), np.float32), np.zeros((t, n), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], y[: len(p), k], mask[: len(p), k] = p, p[::-1], 1
    return x, y, mask


def turned(x: np.ndarray, sizes: list[int]) -> np.ndarray:
    out = np.zeros_like(x)
    for k, n in enumerate(sizes):
        out[:n, k] = x[:n, k][::-1]
    return out


def inputs(p: dict, page: tuple) -> np.ndarray:
    return np.concatenate([mean_rows(p["path"], page[0]), mean_rows(p["word"], page[1]), page[2]], axis=1)


def probabilities(p: dict, pages: list[tuple]) -> list[np.ndarray]:
    """For each page (with blocks) the probability of every block to belong to the article."""
    x, y, mask = pad([inputs(p, q) for q in pages])
    sizes = [len(q[2]) for q in pages]
    both = np.concatenate([forward(x, mask, p["wf"], p["uf"], p["bf"])[0], turned(forward(y, mask, p["wb"], p["ub"], p["bb"])[0], sizes)], axis=2)
    score = sigmoid(both @ p["v"] + p["c"])
    return [score[:n, k] for k, n in enumerate(sizes)]


def train(s: Settings) -> dict:
    """Weights learned with Adam from ``s.pages`` made-up pages."""
    r, g = random.Random(s.seed), np.random.default_rng(s.seed)
    path, word, made = Slots(s.path_rows), Slots(s.word_rows), []
    for _ in range(s.pages):
        cut = blocks(made_up_page(r))
        label = np.array([b.text.startswith(MINE) for b in cut], dtype=np.float32)
        for b in cut:
            b.text = b.text.replace(MINE, "").strip() or "x"
        made.append((*encode(cut, path, word), label))
    d, h = s.path_dim + s.word_dim + FIGURES, s.hidden
    new = lambda *shape: (g.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"path": new(s.path_rows, s.path_dim) * 8, "word": new(s.word_rows, s.word_dim) * 4, "v": new(2 * h), "c": np.zeros(1, np.float32)}
    for k in "fb":
        p |= {f"w{k}": new(d, 4 * h), f"u{k}": new(h, 4 * h), f"b{k}": np.repeat(np.float32([0, 1, 0, 0]), h)}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    made.sort(key=lambda q: len(q[2]))
    groups = [made[k : k + 20] for k in range(0, len(made), 20)]
    for _ in range(s.epochs):
        g.shuffle(order := np.arange(len(groups)))
        for at in order:
            pages = groups[at]
            sizes = [len(q[2]) for q in pages]
            x, y, mask = pad([inputs(p, q) for q in pages])
            of, kf = forward(x, mask, p["wf"], p["uf"], p["bf"], True)
            ob, kb = forward(y, mask, p["wb"], p["ub"], p["bb"], True)
            both = np.concatenate([of, turned(ob, sizes)], axis=2)
            want = np.zeros_like(mask)
            for k, q in enumerate(pages):
                want[: sizes[k], k] = q[3]
            err = (sigmoid(both @ p["v"] + p["c"]) - want) * mask / mask.sum()
            d_both = err[:, :, None] * p["v"]
            grad = {"v": (both * err[:, :, None]).sum((0, 1)), "c": err.sum(keepdims=True).reshape(1)}
            dx, grad["wf"], grad["uf"], grad["bf"] = backward(d_both[:, :, :h], x, kf, p["wf"], p["uf"])
            dy, grad["wb"], grad["ub"], grad["bb"] = backward(turned(d_both[:, :, h:], sizes), y, kb, p["wb"], p["ub"])
            dx = dx + turned(dy, sizes)
            grad["path"], grad["word"] = np.zeros_like(p["path"]), np.zeros_like(p["word"])
            for k, q in enumerate(pages):
                for name, rows, own in (("path", q[0], dx[: sizes[k], k, : s.path_dim]), ("word", q[1], dx[: sizes[k], k, s.path_dim : s.path_dim + s.word_dim])):
                    n = np.array([len(z) for z in rows])
                    np.add.at(grad[name], np.concatenate(rows), np.repeat(own / n[:, None], n, axis=0))
            step += 1
            for k, v in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                p[k] -= (s.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def fit(spark: SparkSession, settings: Settings | None = None) -> dict:
    """Train in one task on the cluster; the same settings give the same weights."""
    s = settings or Settings()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in parts:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(s))], pa.binary())], names=["weights"])

    return pickle.loads(spark.range(1, numPartitions=1).mapInArrow(run, "weights binary").first()[0])


def article(page: list[Block], score: np.ndarray) -> str:
    return "\n\n".join(b.text for b, p in zip(page, score, strict=True) if p >= 0.5)


def extract(pages: DataFrame, weights: dict, settings: Settings | None = None, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """One row per input row: the ``keep`` columns, text and n_chars (its code points).

    The text is the article's blocks in page order with two line feeds between; null and empty pages,
    and pages without an article block, give ''. Nothing is cut short: a page of any length is read
    whole. Repeated rows repeat; an empty table gives no rows. Other columns are not read.
    """
    s = settings or Settings()
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, path, word = shared.value, Slots(s.path_rows), Slots(s.word_rows)
        for batch in batches(parts, 2 << 20):
            cut = [blocks(x) if x else [] for x in batch.column(len(keep)).to_pylist()]
            text = [""] * len(cut)
            order = sorted((k for k in range(len(cut)) if cut[k]), key=lambda k: len(cut[k]))
            while order:
                # Pages of like length together, and about 20,000 blocks at once.
                n = max(1, min(len(order), 20_000 // len(cut[order[min(255, len(order) - 1)]]), 256))
                some, order = order[:n], order[n:]
                for k, score in zip(some, probabilities(p, [encode(cut[k], path, word) for k in some]), strict=True):
                    text[k] = article(cut[k], score)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html)).mapInArrow(run, f"{kinds}, text string, n_chars long")
