"""Best-two-fit packing of token sequences.

Packing only looks at lengths, so the bins are made from the histogram of lengths
(``capacity`` rows, whatever the corpus) with each kind of bin repeated while the lengths
it needs last. That gives just the bins of the document-by-document algorithm. Pieces are then
numbered within their length and look up their bin by number.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Seen, kept, map_arrow, map_texts, read, slices, stage

END_ID = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A run of Latin letters that lower-case and compose one by one (so not U+0130), and then ASCII marks.
_PLAIN = r"^(?P<head>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17E}]+)(?P<tail>[!-/:-@\[-`{-~]*)$"


class Pieces:
    """Token ids of many strings in flat arrays, besides a table of their numbers.

    String number k has ids[ends[k]:ends[k + 1]]; number 0 is empty.
    """

    def __init__(self):
        self.ids, self.ends = [np.zeros(0, np.uint32)], [np.zeros(2, np.int64)]
        self.seen = Seen(np.int32)
        self.size = 1

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new strings."""
        self.ids.append(ids)
        self.ends.append(np.cumsum(sizes) + self.ends[-1][-1])
        self.size += len(sizes)
        return np.arange(self.size - len(sizes), self.size)

    def gather(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the strings k in a row, where each begins and the last ends)."""
        if len(self.ids) > 1:
            self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        first, n = self.ends[0][k], self.ends[0][k + 1] - self.ends[0][k]
        before = np.concatenate([[0], np.cumsum(n)])
        return self.ids[0][np.repeat(first - before[:-1], n) + np.arange(before[-1])], before


#: Texts that tell a tokenizer of the kind below from others.
_PROBES = ("Hello World again", "one  two\tthree\n four", " It's ÉTÉ, (really) 3.5% ", "a-b c_d\r\ne")


class WordTokens:
    """Ids of whole texts by a tokenizer that never joins across white space.

    The six ASCII white space characters end a token and are dropped by this kind of vocabulary,
    so ids are kept for each run between them. Most runs are Latin letters and then marks; their
    letters, in lower case, are kept apart, and new ones are encoded many in a call: the vocabulary marks
    a word's last token. A tokenizer that isn't of this kind is refused. Any other run is encoded by itself. Runs of over ``WIDE`` bytes are not kept; ``most`` bounds the rest.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        for t in _PROBES:
            apart = [i for run in t.split() for i in self.tokenizer.encode(run.lower() if run.isascii() else run, add_special_tokens=False).ids]
            if not any(w.endswith("</w>") for w in vocabulary) or self.tokenizer.encode(t, add_special_tokens=False).ids != apart:
                raise ValueError("this tokenizer keeps case or joins across white space: its texts can't be encoded run by run")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.runs, self.parts = Pieces(), Pieces()

    def _encoded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(sizes.sum())), sizes

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of runs of letters in lower case."""
        ids, sizes = [], []
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            flat = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.last[flat]) + 1
            if len(cut) != len(part) or cut[-1] != len(flat):
                flat, n = self._encoded(part)
            else:
                n = np.diff(cut, prepend=0)
            ids.append(flat)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def _of_parts(self, x: pa.Array, encode) -> np.ndarray:
        coded = x.dictionary_encode()
        k = self.parts.seen.values(coded.dictionary, lambda new: self.parts.add(*encode(new.to_pylist())))
        return k[coded.indices.to_numpy()]

    def _learn(self, runs: pa.Array) -> np.ndarray:
        split = pc.extract_regex(runs, _PLAIN)
        plain = split.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(runs), np.int64)
        if plain.any():
            split = split.filter(pa.array(plain))
            head = self._of_parts(pc.utf8_lower(split.field("head")), self._words)
            tail = self._of_parts(split.field("tail"), self._encoded)
            ids, before = self.parts.gather(np.stack([head, tail], 1).ravel())
            n = np.diff(before)
            out[plain] = self.runs.add(ids, n[0::2] + n[1::2])
        if not plain.all():
            out[~plain] = self.runs.add(*self._encoded(runs.filter(pa.array(~plain)).to_pylist()))
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text begins and the last ends)."""
        if self.runs.size > self.most or self.parts.size > self.most:
            self.clear()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        k = self.runs.seen.values(coded.dictionary, self._learn)[coded.indices.to_numpy()]
        flat, before = self.runs.gather(k)
        return flat, before[np.concatenate([[0], np.cumsum(size)])]


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept(("tokens", path), lambda: WordTokens(path))
        for b in batches:
            for at, n in slices(b.column(1), 2 << 20):
                row, piece, start, length, crc, held = [], [], [], [], [], []
                flat, cut = tokens(b.column(1).slice(at, n))
                for k, (x, y) in enumerate(itertools.pairwise(cut.tolist())):
                    ids = np.append(flat[x:y], np.uint32(END_ID)).astype("<u4")
                    for p, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s : s + capacity]
                        row.append(at + k)
                        piece.append(p)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            held.append(part.astype(np.int32))
                columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(held, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
            pa.default_memory_pool().release_unused()

    return run


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Lengths with their counts -> (times, lengths in the bin), in the order of packing.

    A bin takes the longest piece left that fits, again and again. Then its smallest piece
    gives way to two pieces left over that together fill the room it leaves more tightly, if such are there.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] += n
    sizes = np.arange(capacity + 1)
    bins = []
    while left.any():
        # floor_of[x]: the longest length with a piece left that is at most x (0: none)
        floor_of = np.maximum.accumulate(np.where(left > 0, sizes, 0))
        use: dict[int, int] = {}
        bin_, gap = [], capacity
        while gap > 0:
            x = int(floor_of[gap])
            while x and left[x] - use.get(x, 0) <= 0:
                x = int(floor_of[x - 1])
            if not x:
                break
            n = min(gap // x, int(left[x]) - use.get(x, 0))
            bin_ += [x] * n
            use[x] = use.get(x, 0) + n
            gap -= n * x
        if gap > 0 and len(bin_) > 1:
            smallest = bin_[-1]
            room = gap + smallest
            spare = left.copy()
            for x, n in use.items():
                spare[x] -= n
            a = sizes[1:room][spare[1:room] > 0]
            if len(a):
                floor_spare = np.maximum.accumulate(np.where(spare > 0, sizes, 0))
                b = floor_spare[np.minimum(room - a, a)]
                twin = (b == a) & (spare[a] < 2)
                b = np.where(twin, floor_spare[a - 1], b)
                total = np.where(b > 0, a + b, 0)
                best = int(np.argmax(total))
                if total[best] > smallest:
                    bin_ = bin_[:-1] + [int(a[best]), int(b[best])]
        need: dict[int, int] = {}
        for x in bin_:
            need[x] = need.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        bins.append((times, sorted(bin_, reverse=True)))
    return bins


def _places(bins: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """Runs of piece numbers: (length, first number, pieces a bin, first sequence, offset), in order."""
    rows, used, sequence = [], {}, 0
    for times, lengths in bins:
        offset, i = 0, 0
        while i < len(lengths):
            x = lengths[i]
            n = lengths.count(x)
            rows.append((x, used.get(x, 0), n, sequence, offset))
            used[x] = used.get(x, 0) + n * times
            offset += n * x
            i += n
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.zeros((5, 0), np.int64))


def _placed(places: tuple[np.ndarray, ...]):
    size, first, each, sequence, offset = places
    key = size * (1 << 44) + first  # lengths are small and numbers below 2^44

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            length, number = (b.column(names.index(c)).to_numpy() for c in ("length", "_number"))
            k = np.searchsorted(key, length * (1 << 44) + number, "right") - 1
            into = number - first[k]
            columns = [c for n, c in zip(names, b.columns, strict=True) if n != "_number"]
            columns += [pa.array(sequence[k] + into // each[k]), pa.array(offset[k] + into % each[k] * length)]
            yield pa.RecordBatch.from_arrays(columns, [n for n in names if n != "_number"] + ["sequence_id", "offset"])

    return run


def pack_sequences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32(, ids), sequence_id, offset.

    A document is its ids and then id 0; a null or empty text is id 0 alone. Only documents
    longer than ``capacity`` are cut, into pieces of it; the last may be shorter. Rows may repeat and ids may be
    null: each row is packed by itself. Other columns are not read. Empty in, empty out.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = stage(map_texts(slim, _pieces(tokenizer or default_tokenizer(), capacity, with_ids), schema))
    # Numbers within a length: places within one stored partition, after all of earlier partitions.
    pieces = pieces.withColumn("_part", F.spark_partition_id())
    counts = pieces.groupBy("length", "_part").count()
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    counts = stage(counts)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    here = Window.partitionBy("_part", "length").orderBy("id", "start", "ids_crc32")
    numbered = pieces.withColumn("_place", F.row_number().over(here) - 1).join(counts.drop("count"), ["length", "_part"])
    numbered = numbered.withColumn("_number", F.col("_before") + F.col("_place"))
    own = [c.strip().split(" ")[0] for c in schema.split(", ")]
    places = _places(best_two_fit(histogram, capacity))
    return map_arrow(numbered.select(*own, "_number"), _placed(places), f"{schema}, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack_sequences(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
