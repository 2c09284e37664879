"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear SVM on labelled sentence windows.

The kernel (Lodhi et al., 2002) counts common subsequences of three letters, each
weighted down by ``DECAY`` for every letter it spans, so that ``idixot``, ``i.d.i.o.t`` and ``i d i o t``
stay near ``idiot``. A subsequence spans at most ``SPAN`` letters, a run of marks or spaces counting as one; so a window of a
sentence has a bounded number of them, and the kernel of a window with all landmarks, the machine's value included, is a sum over them of
numbers in one table. Windows begin at every letter of a text and hold the subsequences that begin in their first ``WINDOW`` letters: they
overlap, and nothing of a text is left out. The most toxic window decides for the document.

Landmarks are windows of labelled documents, toxic and harmless. Training knows labels of documents only, so it picks in every toxic document the windows
that the machine finds most toxic, learns from them and from the worst windows of
harmless documents, and picks again (multiple-instance SVM).
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_texts, read, slices, text_columns
from .labelled import held_out, labelled_sample

N, SPAN, DECAY, WINDOW = 4, 7, 0.7, 12
BITS = 5  # of a letter's number
GAP, BARRIER = 28, (1 << BITS) - 1
NO_WORD = -9.0
SURE = 14.0  # how many toxic documents times log odds: more than chance gives among all words of a sample
_OTHER = re.compile(r"[\W_]+")
#: Places of the other letters of a subsequence after its first.
PLACES = list(itertools.combinations(range(1, SPAN), N - 1))
WEIGHTS = np.array([DECAY ** (p[-1] + 1) for p in PLACES], np.float32)
CODES = 1 << N * BITS


def number_of(c: str) -> int:
    """A character's number: a to z with and without accents, digits, and the letters of other scripts by a hash; marks and spaces are the gap."""
    c = unicodedata.normalize("NFKD", c.lower())[:1] or " "
    c = {"\u00df": "s", "\u00e6": "a", "\u00f8": "o", "\u0153": "o", "\u0131": "i", "\u0142": "l", "\u0111": "d"}.get(c, c)
    if "a" <= c <= "z":
        return 1 + ord(c) - ord("a")
    if "0" <= c <= "9":
        return 27
    return GAP + 1 + zlib.crc32(c.encode("utf-8", "surrogatepass")) % (BARRIER - GAP - 1) if c.isalnum() else GAP


@functools.lru_cache(maxsize=1)
def _numbers() -> np.ndarray:
    """Numbers of the first 65536 characters."""
    out = np.fromiter((number_of(chr(i)) for i in range(1 << 16)), np.uint8, 1 << 16)
    out[0] = BARRIER
    return out


def streams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters' numbers of all texts, where each text begins, where it ends); runs of marks and spaces are one gap.

    Gaps between letters that stand alone are dropped, so that a word spelt letter by letter is the word. A gap may begin or end a
    subsequence, so that beginnings and ends of words count, and one stands at both ends of a text. As many barriers as a window is long stand after each text, so that no window reaches from one into another.
    """
    texts = [f" {t} ".replace("\0", " ") if t else "" for t in texts]
    joined = ("\0" * WINDOW).join([*texts, ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(code) and code.max() >= 1 << 16:
        high = code >= 1 << 16
        number = _numbers()[np.where(high, 32, code)]
        kinds, back = np.unique(code[high], return_inverse=True)
        number[high] = np.fromiter((number_of(chr(k)) for k in kinds), np.uint8, len(kinds))[back]
    else:
        number = _numbers()[code]
    stay = np.ones(len(number), bool)
    stay[1:] = (number[1:] != GAP) | (number[:-1] != GAP)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + WINDOW) - size - WINDOW
    place = np.flatnonzero(stay)
    s = number[place]
    ends = (s == GAP) | (s == BARRIER)
    alone = np.zeros(len(s), bool)
    alone[1:-1] = ~ends[1:-1] & ends[:-2] & ends[2:]
    apart = np.zeros(len(s), bool)
    apart[1:-1] = (s[1:-1] == GAP) & alone[:-2] & alone[2:]
    stay[place[apart]] = False
    upto = np.concatenate([[0], np.cumsum(stay)])
    return number[stay], upto[begin], upto[begin + size]


def subsequences(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Codes of the subsequences that begin at each of ``starts`` (one column each of PLACES); 0 where one holds a barrier, or a gap between its letters."""
    s = np.concatenate([s, np.full(SPAN, BARRIER, s.dtype)]).astype(np.int32)
    own = s[starts]
    near = [s[starts + i] for i in range(1, SPAN)]
    good = [x != BARRIER for x in [own, *near]]
    out = np.zeros((len(starts), len(PLACES)), np.int32)
    for k, places in enumerate(PLACES):
        code, fine = own, good[0]
        for i in places:
            code, fine = code << BITS | near[i - 1], fine & good[i]
        for i in places[:-1]:
            fine = fine & (near[i - 1] != GAP)
        out[:, k] = np.where(fine, code, 0)
    return out


def window_codes(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes of windows, a row each: the subsequences of ``WINDOW`` letters from ``starts`` on, as far as their texts' ``ends``."""
    at = starts[:, None] + np.arange(WINDOW)
    codes = subsequences(s, np.minimum(at, len(s)).ravel()).reshape(len(starts), WINDOW, len(PLACES))
    codes[at >= ends[:, None]] = 0
    return codes.reshape(len(starts), -1)


_ROW = np.tile(WEIGHTS, WINDOW)
PLAIN = float(np.linalg.norm(_ROW))  # length of a window that holds each subsequence once


def excess(codes: np.ndarray) -> np.ndarray:
    """How much longer than ``PLAIN`` each window's feature vector is, 1 at least: what a window that repeats itself is divided by."""
    order = np.argsort(codes, axis=1, kind="stable")
    c, w = np.take_along_axis(codes, order, 1), np.where(np.take_along_axis(codes, order, 1) > 0, _ROW[order], 0).astype(float)
    first = np.ones(c.shape, bool)
    first[:, 1:] = c[:, 1:] != c[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(first.ravel()))
    row = np.nonzero(first)[0]
    return np.maximum(1.0, np.sqrt(np.bincount(row, sums * sums, minlength=len(codes))) / PLAIN)


class Landmarks:
    """Normalised feature vectors of windows, kept by the codes they hold."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        kinds = np.unique(codes)
        self.kinds = kinds[kinds > 0]
        self.where = np.full(CODES, len(self.kinds), np.int32)
        self.where[self.kinds] = np.arange(len(self.kinds))
        self.phi = np.zeros((len(self.kinds) + 1, self.n), np.float32)
        for m, row in enumerate(codes):
            np.add.at(self.phi[:, m], self.where[row], _ROW)
        self.phi[-1] = 0
        self.phi /= np.maximum(np.linalg.norm(self.phi, axis=0), 1e-9)

    def kernels(self, codes: np.ndarray) -> np.ndarray:
        """Kernel of each window with each landmark, divided by the landmark's length and the window's ``excess``."""
        out = np.zeros((len(codes), self.n), np.float32)
        at = self.where[codes]
        row, k = np.nonzero(at < len(self.kinds))
        for cut in np.array_split(np.arange(len(row)), max(1, len(row) // 4_000)):
            if len(cut):
                r = row[cut]
                first = np.flatnonzero(np.diff(r, prepend=-1))
                out[r[first]] += np.add.reduceat(self.phi[at[r, k[cut]]] * _ROW[k[cut], None], first)
        return out / excess(codes)[:, None].astype(np.float32)

    def table(self, alpha: np.ndarray) -> np.ndarray:
        """For each code, the sum of alpha times the landmarks' feature: a window's value is the weighted sum of its codes' entries."""
        out = np.zeros(CODES, np.float32)
        out[self.kinds] = self.phi[:-1] @ alpha.astype(np.float32)
        return out


@dataclass
class Machine:
    """A table of values of subsequences, the bias, and the document's logistic scale."""

    table: np.ndarray
    bias: float = NO_WORD
    slope: float = 1.0
    offset: float = 0.0

    def windows(self, s: np.ndarray) -> np.ndarray:
        """The value, without the bias and undivided by ``excess``, of the window that begins at each letter."""
        total = np.zeros(len(s) + 1)
        for at in range(0, len(s), 1 << 18):
            n = min(1 << 18, len(s) - at)
            x = np.full(n + SPAN, BARRIER, np.int32)
            part = s[at : at + n + SPAN]
            x[: len(part)] = part
            value = np.zeros(n, np.float32)
            for first in itertools.combinations(range(1, SPAN), N - 2):
                code = x[:n]
                for i in first:
                    code = code << BITS | x[i : i + n]
                code = code << BITS
                for j in range(first[-1] + 1, SPAN):
                    value += self.table[code | x[j : j + n]] * np.float32(DECAY ** (j + 1))
            total[at + 1 : at + n + 1] = value
        np.cumsum(total, out=total)
        out = total[-1] - total[:-1]
        if len(s) >= WINDOW:
            np.subtract(total[WINDOW:], total[:-WINDOW], out=out[: len(s) - WINDOW + 1])
        return out

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """The largest value among each text's windows; the bias where it has none."""
        s, begin, end = streams(texts.to_pylist())
        out = np.full(len(begin), float(self.bias))
        full = np.flatnonzero(end > begin)
        if len(full):
            value = self.windows(s)
            size = end[full] - begin[full]
            own = np.repeat(begin[full] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            value = value[own]  # of windows that begin in a text
            start = np.cumsum(size) - size
            top = np.maximum.reduceat(value, start)
            at = np.flatnonzero(value == np.repeat(top, size))
            at = at[np.searchsorted(at, start)]  # the first of each text
            divided = top / np.where(top > 0, excess(window_codes(s, own[at], end[full])), 1)
            # Dividing only lowers a value: where it did, other windows are divided in order of their values until no other can be larger.
            for i in np.flatnonzero(divided < top):
                divided[i] = self._divided(s, value[start[i] : start[i] + size[i]], int(begin[full[i]]), int(end[full[i]]))
            out[full] = divided + self.bias
        return out

    @staticmethod
    def _divided(s: np.ndarray, value: np.ndarray, begin: int, end: int) -> float:
        best, n, value = -np.inf, 8, value.copy()
        while True:
            at = np.argpartition(-value, n - 1)[:n] if n < len(value) else np.flatnonzero(value > -np.inf)
            best = max(best, float((value[at] / excess(window_codes(s, begin + at, np.full(len(at), end)))).max(initial=-np.inf)))
            value[at] = -np.inf
            if value.max() <= max(best, 0):
                return best
            n = min(2048, n * 8)

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -30, 30)))


def words_of(text: str | None) -> set[str]:
    """The distinct words of a lower-cased text, letters only."""
    return {w for w in (_OTHER.sub("", x) for x in (text or "").lower().split()) if w}


def choose_landmarks(bags: list[set[str]], y: np.ndarray, most: int) -> tuple[list[str], set[str]]:
    """Words that stand for toxic documents, and all words that surely do: the sure ones, then each next one covers the most that are left.

    Evidence comes from words and their runs of four letters: how many toxic and how many
    harmless documents hold them.
    """
    pos, neg = Counter(), Counter()

    def marks(w: str) -> Iterator[str]:
        yield f"^{w}"
        for i in range(len(w) - 3):
            yield w[i : i + 4]

    toxic_docs = []
    for bag, label in zip(bags, y, strict=True):
        if label:
            m = {g for w in bag for g in marks(w)}
            pos.update(m)
            toxic_docs.append((bag, m))
    for g in [g for g, n in pos.items() if n < 2]:
        del pos[g]
    for _, m in toxic_docs:
        m.intersection_update(pos)
    for bag, label in zip(bags, y, strict=True):
        if not label:
            neg.update({g for w in bag for g in marks(w) if g in pos})
    n_pos, n_neg = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    odds = {g: math.log((n + 0.1) / (n_pos + 1)) - math.log((neg[g] + 0.5) / (n_neg + 1)) for g, n in pos.items()}
    # Whole words that stand in several toxic documents and hardly elsewhere come first, each for itself.
    sure = sorted((g for g, n in pos.items() if g.startswith("^") and odds[g] > 3 and n * odds[g] > SURE), key=lambda g: (-pos[g], g))
    out = [g[1:] for g in sure[: most // 2]]
    seen_grams = {g for w in out for g in marks(w)}
    good = {g for g, o in odds.items() if o > 3 and pos[g] * o > SURE} - seen_grams
    left = [(bag, m) for bag, m in toxic_docs if not m & {f"^{w}" for w in out}]
    while left and len(out) < most:
        seen = Counter(g for _, m in left for g in m if g in good)
        if not seen:
            break
        best = max(seen, key=lambda g: (seen[g] * min(odds[g], 6.0), g))
        word = best[1:]
        if not best.startswith("^"):
            holding = Counter(w for bag, _ in left for w in bag if best in w)
            word = max(holding, key=lambda w: (pos[f"^{w}"] - 2 * neg[f"^{w}"], -len(w), w))
        if word in out:
            good.discard(best)
            continue
        out.append(word)
        left = [(bag, m) for bag, m in left if best not in m]
    return out, {g[1:] for g in sure}


def _svm(x: np.ndarray, gram: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3e-4, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weighted squared-hinge SVM in the landmarks' space by Newton's method: (alpha, bias) of values ``x @ alpha + bias``.

    ``x``: kernels with the landmarks; ``gram``: those of the landmarks among themselves, which measures alpha (Nystroem).
    """
    s = np.where(y > 0, 1.0, -1.0)
    weight = weight / weight.sum()
    m = x.shape[1]
    z = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    size = np.zeros((m + 1, m + 1))
    size[:m, :m] = ridge * (gram + 1e-3 * np.eye(m))
    size[m, m] = 1e-9

    def loss(u: np.ndarray) -> tuple[float, np.ndarray]:
        slack = np.maximum(0, 1 - s * (z @ u))
        return float(u @ size @ u + (weight * slack * slack).sum()), slack

    u = np.zeros(m + 1)
    now, slack = loss(u)
    for _ in range(steps):
        live = slack > 0
        a = z[live].astype(float)
        half = size + (a * weight[live, None]).T @ a
        to = np.linalg.solve(half, a.T @ (weight[live] * s[live]))
        rate = 1.0
        while rate > 1e-4:
            new, its = loss(u + rate * (to - u))
            if new <= now:
                break
            rate /= 2
        done = now - new <= 1e-9 * now
        if new <= now:
            u, now, slack = u + rate * (to - u), new, its
        if done:
            break
    return u[:-1], float(u[-1])


def with_gaps(words: list[str]) -> Iterator[str]:
    """Each word with one foreign letter or a gap put inside, at every place: what gapped insults look like to the kernel."""
    for w in words:
        yield from (f"{w[:i]} {w[i:]}" for i in range(2, len(w) - 1))
        foreign = next(c for c in "xqzwjkv" if c not in w) if any(c not in w for c in "xqzwjkv") else "x"
        for i in range(1, len(w)):
            yield w[:i] + foreign + w[i:]


def _logistic(value: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset by Newton's method, a little ridge on the slope."""
    a = np.zeros(2)
    z = np.stack([value, np.ones_like(value)], 1)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    ridge = np.diag([1e-2, 1e-4])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        grad = z.T @ (p - target) + ridge @ a
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(hess, grad)
        a -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
    return float(a[0]), float(a[1])


def without_copies(texts: list[str | None]) -> list[int]:
    """Places of texts of which no earlier one is a near copy, so that a copied text's words are no evidence.

    Two texts count as copies if the rare word of the smallest hash is the same in both, for either of two hashes.
    """
    words = [np.unique(np.fromiter(map(zlib.crc32, (t or "").lower().encode("utf-8", "surrogatepass").split()), np.uint32)) for t in texts]
    kinds, n = np.unique(np.concatenate(words), return_counts=True) if words else (np.zeros(0), np.zeros(0))
    limit = max(3, len(texts) // 20)
    seen: set[tuple[int, int]] = set()
    out = []
    for i, w in enumerate(words):
        rare = w[n[np.searchsorted(kinds, w)] <= limit].astype(np.uint64)
        keys = {(k, int((rare * np.uint64(odd) & np.uint64(0xFFFFFFFF)).min())) for k, odd in ((1, 0x9E3779B1), (2, 0x85EBCA77))} if len(rare) > 5 else set()
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def train(sample: list[tuple[str, int]], words: int = 60, contexts: int = 8, hard: int = 80, most_windows: int = 6000, rounds: int = 6) -> Machine:
    """A machine from (text, toxic) pairs. Without both labels nothing is known to be toxic: it answers the share of toxic ones, 0.25 at most.

    Landmarks: up to ``words`` telling words, cut from their sentences, and the ``hard`` worst windows of harmless documents of each round.
    Windows of the telling words in ``contexts`` toxic documents each and gapped forms of them are toxic; ``most_windows`` of the worst harmless windows are learnt from in a round.
    """
    y = np.array([label for _, label in sample])
    nothing = np.zeros(CODES, np.float32)
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        share = min(0.25, (y.sum() + 0.5) / (len(y) + 1))
        return Machine(nothing, 0.0, 0.0, math.log(share / (1 - share)))
    # Copies are no further evidence for a label, but a harmless copy of a toxic text is evidence.
    alone = sorted(i for label in (0, 1) for own in [np.flatnonzero(y == label)] for i in own[without_copies([sample[i][0] for i in own])])
    y, texts = y[alone], [sample[i][0] for i in alone]
    bags = [words_of(t) for t in texts]
    chosen, sure = choose_landmarks(bags, y, words)
    s, begin, end = streams(texts)

    def found_in(word: str) -> list[tuple[int, int]]:
        """(place, end of the text) of a word in toxic documents."""
        out = []
        for d in np.flatnonzero(y):
            if word in bags[d]:
                spelt = np.array([number_of(c) for c in word], np.uint8)
                for at in np.flatnonzero(s[begin[d] : end[d]] == spelt[0]) + begin[d]:
                    if np.array_equal(s[at : at + len(spelt)], spelt) and (at == begin[d] or s[at - 1] == GAP):
                        out.append((max(int(begin[d]), int(at) - 1), int(end[d])))
                        break
            if len(out) == contexts:
                break
        return out

    places = [p for w in chosen for p in found_in(w)]
    if not places:
        share = min(0.25, (y.sum() + 0.5) / (len(y) + 1))
        return Machine(nothing, 0.0, 0.0, math.log(share / (1 - share)))
    seeds = window_codes(*streams(chosen))
    gs, gb, ge = streams(list(with_gaps(chosen)))
    gapped = window_codes(gs, gb, ge)
    machine = Machine(Landmarks(seeds).table(np.full(len(seeds), 1 / len(seeds))))

    def best(value: np.ndarray, d: int, n: int) -> list[int]:
        """The ``n`` best places of windows of a document that don't overlap."""
        v = value[begin[d] : end[d]].copy()
        out = []
        while len(out) < n and len(v):
            k = int(np.argmax(v))
            if v[k] == -np.inf:
                break
            out.append(int(begin[d]) + k)
            v[max(0, k - WINDOW) : k + WINDOW] = -np.inf
        return out

    pool: dict[tuple[int, int], None] = {}
    for turn in range(rounds):
        value = machine.windows(s)
        tops = [[(k, int(end[d])) for k in best(value, d, 2 if label else 4)] for d, label in enumerate(y)]
        neg = sorted((p for d in np.flatnonzero(y == 0) for p in tops[d]), key=lambda p: (-value[p[0]], p))[:most_windows]
        # A toxic document's window is evidence if no harmless document has one as toxic; its label may speak of something else.
        least = max((value[t[0][0]] for d, t in enumerate(tops) if not y[d] and t), default=0.0)
        pos = places + [p for d in np.flatnonzero(y) for p in tops[d] if turn and value[p[0]] > least]
        codes = window_codes(s, *map(np.array, zip(*pos, *neg, strict=True)))
        pool.update(dict.fromkeys(neg[:hard]))
        marks = Landmarks(np.concatenate([seeds, window_codes(s, *map(np.array, zip(*pool, strict=True)))]) if pool else seeds)
        gram = (marks.phi.T @ marks.phi).astype(float)
        x = np.concatenate([marks.kernels(codes), marks.kernels(gapped)])
        labels = np.concatenate([np.ones(len(pos)), np.zeros(len(neg)), np.ones(len(gapped))])
        weight = np.concatenate([np.full(len(pos), 1 / len(pos)), np.full(len(neg), 1 / max(1, len(neg))), np.full(len(gapped), 0.7 / max(1, len(gapped)))])
        alpha, bias = _svm(x, gram, labels, weight)
        machine = Machine(marks.table(alpha), bias)
    del s, value, codes, x
    value = np.concatenate([machine.of_texts(pa.array(texts[at : at + 100], pa.string())) for at in range(0, len(texts), 100)])
    machine.slope, machine.offset = _logistic(value, y)
    return machine


def _scored(machine: Machine, text_col: str, width: int):
    key = ("toxicity", float(np.abs(machine.table).sum()), machine.bias, machine.offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(key, lambda: machine)
        for b in batches:
            value = [own.of_texts(b.column(text_col).slice(at, n)) for at, n in slices(b.column(text_col), 1 << 19)]
            p = own.probability(np.concatenate(value)) if value else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(p, pa.float64())], [*b.schema.names[:width], "toxicity"])

    return run


def score_toxicity(df: DataFrame, labels: DataFrame, text_col: str = "text", most_toxic: int = 1200, most_harmless: int = 3000, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with toxicity (double, 0 to 1).

    Learns from at most ``most_toxic`` and ``most_harmless`` documents of ``df`` that ``labels``
    (doc_id, toxic) marks. Texts that are null, empty or without letters get the machine's value of no
    word, a low score. Rows may repeat; a column named toxicity is replaced. Empty in, empty out.
    """
    machine = train(labelled_sample(df.withColumnRenamed(text_col, "text"), labels, "toxic", {0: most_harmless, 1: most_toxic}))
    keep = [c for c in (keep or df.columns) if c != "toxicity"]
    slim = text_columns(df, keep, text_col)
    return map_texts(slim, _scored(machine, text_col, len(keep)), slim.select(*keep, F.lit(0.0).alias("toxicity")).schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
