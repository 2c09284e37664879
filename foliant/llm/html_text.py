"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

Each block is main text or not. Its features are the tags and names of its ancestors,
its own text's length, links, ending and marks, and its place in the page; neighbours' labels are tied by
transition weights. The field is trained on labelled pages by the exact gradient of the conditional likelihood
(forward-backward) and decoded by Viterbi. Whole batches of pages are decoded together.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_texts, read, slices
from .html_blocks import Contexts, blocks, labelled_page, text_features


def place_features(i: int, n: int) -> list[str]:
    out = [f"place:{min(4, 5 * i // n)}"]
    if i == 0:
        out.append("first")
    if i == n - 1:
        out.append("last")
    return out


@dataclass
class Field:
    """Weights: features (name -> row of ``emit``) by label, and transitions [before, after]."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray
    end: np.ndarray
    contexts: Contexts = field(default_factory=Contexts)

    def __post_init__(self):
        self.contexts = Contexts(frozenset(self.index))
        self._margin = dict(zip(self.index, (self.emit[:, 1] - self.emit[:, 0]).tolist(), strict=True))
        self._of_context: dict[frozenset[str], float] = {}

    def margins(self, found: list[tuple[str, frozenset[str], str, int]]) -> list[float]:
        """Label 1's emission less label 0's, of each block of a page."""
        get, n, out = self._margin.get, len(found), []
        if len(self._of_context) > 50_000:
            self._of_context.clear()
        for i, (text, inside, near, linked) in enumerate(found):
            outer = self._of_context.get(inside)
            if outer is None:
                outer = self._of_context[inside] = sum(get(f, 0.0) for f in inside)
            out.append(outer + sum(get(f, 0.0) for f in text_features(text, near, linked)) + sum(get(f, 0.0) for f in place_features(i, n)))
        return out

    def decode(self, margins: list[list[float]]) -> list[np.ndarray]:
        """The best labels of each page (Viterbi), many pages a step; like lengths go together."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(margins)
        order = sorted(range(len(margins)), key=lambda k: len(margins[k]))
        for at in range(0, len(order), 256):
            rows = [k for k in order[at : at + 256] if margins[k]]
            if not rows:
                continue
            size = np.array([len(margins[k]) for k in rows])
            emit = np.zeros((len(rows), size.max()))
            for i, k in enumerate(rows):
                emit[i, : size[i]] = margins[k]
            score = np.zeros((len(rows), 2)) + self.start
            score[:, 1] += emit[:, 0]
            back = np.zeros((len(rows), size.max(), 2), np.int8)
            final = score.copy()
            for t in range(1, size.max()):
                both = score[:, :, None] + self.move[None]
                back[:, t] = both.argmax(1)
                score = both.max(1)
                score[:, 1] += emit[:, t]
                final[size == t + 1] = score[size == t + 1]
            label = (final + self.end).argmax(1)
            path = np.zeros((len(rows), size.max()), np.int8)
            every = np.arange(len(rows))
            for t in range(size.max() - 1, -1, -1):
                path[:, t] = label
                inside = t < size
                label = np.where(inside, back[every, t, label], label)
            for i, k in enumerate(rows):
                out[k] = path[i, : size[i]]
        return out

    def texts(self, pages: list[str | None]) -> list[str]:
        found = [blocks(p, self.contexts) for p in pages]
        labels = self.decode([self.margins(f) for f in found])
        return ["\n\n".join(b[0] for b, y in zip(f, label, strict=True) if y) for f, label in zip(found, labels, strict=True)]


def train(pages: list[tuple[str, list[tuple[str, int]]]], steps: int = 250, ridge: float = 1.0) -> Field:
    """The field of largest penalised conditional likelihood on (html, [(block text, label)]) pages.

    Pages of which the blocks found are not the blocks labelled are left out.
    """
    contexts, data = Contexts(), []
    for page, labels in pages:
        found = blocks(page, contexts)
        if found and [b[0] for b in found] == [t for t, _ in labels]:
            data.append(([[*b[1], *text_features(b[0], b[2], b[3]), *place_features(i, len(found))] for i, b in enumerate(found)], [y for _, y in labels]))
    if not data:
        return Field({}, np.zeros((0, 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(2))
    index = {f: i for i, f in enumerate(sorted({f for fs, _ in data for b in fs for f in b}))}
    n, longest = len(data), max(len(y) for _, y in data)
    size = np.array([len(y) for _, y in data])
    x = np.zeros((n, longest, len(index)), np.float32)
    y = np.zeros((n, longest), np.int64)
    for i, (fs, labels) in enumerate(data):
        for t, b in enumerate(fs):
            x[i, t, [index[f] for f in b]] = 1
        y[i, : len(labels)] = labels
    there = np.arange(longest)[None] < size[:, None]
    flat = x[there]
    every, last = np.arange(n), size - 1
    seen_emit = flat.T @ (y[there] - 0.0)
    seen_move = np.zeros((2, 2))
    np.add.at(seen_move, (y[:, :-1][there[:, 1:]], y[:, 1:][there[:, 1:]]), 1)
    seen_start, seen_end = np.bincount(y[:, 0], minlength=2), np.bincount(y[every, last], minlength=2)

    def grads(w, move, start, end):
        emit = np.zeros((n, longest))
        emit[there] = flat @ w
        e = np.stack([np.zeros_like(emit), emit], 2)
        a = np.zeros((n, longest, 2))
        b = np.zeros((n, longest, 2))
        a[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            a[:, t] = np.logaddexp(a[:, t - 1, 0, None] + move[0], a[:, t - 1, 1, None] + move[1]) + e[:, t]
        b[every, last] = end
        for t in range(longest - 2, -1, -1):
            v = b[:, t + 1] + e[:, t + 1]
            step = np.logaddexp(v[:, 0, None] + move[:, 0], v[:, 1, None] + move[:, 1])
            b[:, t] = np.where((t < last)[:, None], step, b[:, t])
        z = np.logaddexp(*(a[every, last] + end).T)
        p = np.exp(a + b - z[:, None, None])
        pair = np.exp(a[:, :-1, :, None] + move + (b + e)[:, 1:, None, :] - z[:, None, None, None])
        pair *= there[:, 1:, None, None]
        return (
            seen_emit - flat.T @ p[there][:, 1] - ridge * w,
            seen_move - pair.sum((0, 1)) - ridge * move,
            seen_start - p[:, 0].sum(0) - ridge * start,
            seen_end - p[every, last].sum(0) - ridge * end,
        )

    params = [np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)]
    mean, power = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, steps + 1):  # Adam
        for i, g in enumerate(grads(*params)):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            power[i] = 0.99 * power[i] + 0.01 * g * g
            rate = 0.15 * min(1.0, 2 * (1 - k / steps) + 0.02)
            params[i] = params[i] + rate * (mean[i] / (1 - 0.9**k)) / (np.sqrt(power[i] / (1 - 0.99**k)) + 1e-8)
    w, move, start, end = params
    return Field(index, np.stack([np.zeros_like(w), w], 1), move, start, end)


@functools.lru_cache(maxsize=1)
def default_field(pages: int = 400) -> Field:
    """Trained on invented labelled pages; the pages of the corpus are never looked at."""
    return train([labelled_page(seed) for seed in range(pages)])


def _extracted(model: Field):
    key = ("html", len(model.index), float(model.emit.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(key, lambda: model)
        for b in batches:
            pages = b.column(b.num_columns - 1)
            texts = [t for at, n in slices(pages, 1 << 20) for t in own.texts(pages.slice(at, n).to_pylist())]
            columns = [*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], "_text", "_n"])

    return run


def extract_text(df: DataFrame, html_col: str = "html", model: Field | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the html) of ``df`` with text and n_chars (code points).

    ``text``: the blocks labelled main, in page order, with an empty line between; empty for a null
    or empty page and for one without main text. Nothing is cut. Rows may repeat; columns named text and n_chars are
    replaced. Empty in, empty out.
    """
    keep = [c for c in (keep or df.columns) if c not in ("text", "n_chars") and (keep or c != html_col)]
    slim = df.select(*keep, F.col(html_col).alias("_html"))
    schema = slim.select(*keep, F.lit("").alias("_text"), F.lit(0).cast("long").alias("_n")).schema
    out = map_texts(slim, _extracted(model or default_field()), schema)
    return out.withColumnsRenamed({"_text": "text", "_n": "n_chars"})


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
