"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

Seeds are runs of min_match words, as Karp-Rabin hashes. The benchmark's seeds are a table; documents send on only seeds that
its Bloom filter lets through, and are joined with it on them. In each pair of document and item the longest match that overlaps
no other is marked again and again, down to min_match words. The share of the item's words that is marked decides, so a
passage whose parts were moved about is found as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key

_NO_WORD = re.compile(r"\W+")
#: ASCII bytes that are not in words, as spaces: the rule of _NO_WORD for ASCII texts.
_ASCII = bytes(b if re.match(r"\w", chr(b)) else 32 for b in range(128)) + bytes(range(128, 256))
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so that their powers have inverses modulo 2^64
_CHUNK = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^(n-1) modulo 2^64, and those of its inverse."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers[base] = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, np.uint64(b))))) for b in (base, pow(base, -1, 1 << 64)))
    return _powers[base][0][:n], _powers[base][1][:n]


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[j] * base^j: any window's hash is a difference of two of them times base^-start."""
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers_of(base, len(values))[0], dtype=np.uint64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.maximum(z ^ (z >> np.uint64(31)), np.uint64(1))  # zero stands between runs


def _words_in(raw: bytes) -> np.ndarray:
    """Hashes of the words of some bytes, split at spaces."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], data != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    sums = _sums(data.astype(np.uint64), _BYTE_BASE)
    with np.errstate(over="ignore"):
        return (sums[end] - sums[start]) * _powers_of(_BYTE_BASE, max(1, len(data)))[1][start] if len(start) else np.empty(0, np.uint64)


def _long_word(word: bytes) -> int:
    with np.errstate(over="ignore"):
        return sum(int(_sums(np.frombuffer(word[i : i + _CHUNK], np.uint8).astype(np.uint64), _BYTE_BASE)[-1]) * pow(_BYTE_BASE, i, 1 << 64) for i in range(0, len(word), _CHUNK)) % (1 << 64)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash per word: lower-cased runs of letters, digits and underscores. Long texts are worked through in chunks."""
    if not text:
        return np.empty(0, np.uint64)
    low = text.lower()
    raw = low.encode().translate(_ASCII) if low.isascii() else _NO_WORD.sub(" ", low).encode("utf-8", "surrogatepass")
    out, at = [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= _CHUNK else raw.find(b" ", at + _CHUNK)
        end = len(raw) if end < 0 else end
        part = raw[at:end]
        if len(part) <= 2 * _CHUNK:
            out.append(_words_in(part))
        else:  # a word longer than a chunk
            out.append(np.array([_long_word(w) if len(w) > _CHUNK else int(_words_in(w)[0]) for w in part.split(b" ") if w], np.uint64))
        at = end
    return _mixed(np.concatenate(out)) if out else np.empty(0, np.uint64)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of all windows of k words."""
    n = len(words) - k + 1
    if n < 1 or k < 1:
        return np.empty(0, np.uint64)
    sums = _sums(words, _WORD_BASE)
    with np.errstate(over="ignore"):
        return (sums[k:] - sums[:-k]) * _powers_of(_WORD_BASE, len(words))[1][:n]


def seeds_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words that tell windows of other lengths apart."""
    with np.errstate(over="ignore"):
        return _mixed(windows(words, k) + np.uint64(k) * np.uint64(_BYTE_BASE))


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int = 5) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word hashes: (place in doc, place in item, length); zeros in doc match nothing.

    The longest match of unmarked words is marked, ties earlier in doc, then in item, until none has min_match words. Its
    length is found by bisection, as windows of a match match too; it never grows, so each length is gone through once and
    repetitive texts cost (different lengths) x log(length) passes over both, not their product.
    """
    found: list[tuple[int, int, int]] = []
    used_doc, used_item = doc == 0, np.zeros(len(item), bool)
    top = min(len(doc), len(item))
    while top >= min_match:
        free = [np.concatenate(([0], np.cumsum(u))) for u in (used_doc, used_item)]

        def common(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            at = [np.flatnonzero(f[k:] == f[:-k]) for f in free]
            hashes = windows(doc, k)[at[0]], windows(item, k)[at[1]]
            return at[0], at[1], *hashes

        low, high = min_match - 1, top  # a match of low words is there (or low is too short)
        while low < high:
            middle = (low + high + 1) // 2
            _, _, a, b = common(middle)
            low, high = (middle, high) if np.isin(b, a).any() else (low, middle - 1)
        if low < min_match:
            break
        at_doc, at_item, a, b = common(low)
        places: dict[int, list[int]] = {}
        for i, h in zip(at_item[::-1].tolist(), b[::-1].tolist()):
            places.setdefault(h, []).append(i)  # latest first: the earliest is at the end
        for d, h in zip(at_doc.tolist(), a.tolist()):
            left = places.get(h)
            if not left or used_doc[d : d + low].any():
                continue
            while left and (used_item[left[-1] : left[-1] + low].any() or not np.array_equal(doc[d : d + low], item[left[-1] : left[-1] + low])):
                left.pop()
            if left:
                i = left.pop()
                used_doc[d : d + low] = used_item[i : i + low] = True
                found.append((d, i, low))
        top = low - 1
    return found


class Bloom:
    """Three bits per seed in a power of two of bits."""

    SHIFTS = (0, 20, 40)
    #: Bits per seed, while most_bits allows them: of the windows of unrelated texts about one in two million passes.
    PER_SEED = 256

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def has(self, seeds: np.ndarray) -> np.ndarray:
        out = np.ones(len(seeds), bool)
        for shift in self.SHIFTS:
            place = (seeds >> np.uint64(shift)) & self.mask
            out &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    @classmethod
    def of(cls, seeds: DataFrame, n: int, most_bits: int) -> "Bloom":
        """Of the column `seed` of a table of n rows; collects at most most_bits / 64 words. Up to 2^24 bits the three places hang on enough of the hash."""
        bits = 1 << min(most_bits.bit_length() - 1, max(12, (cls.PER_SEED * max(1, n) - 1).bit_length()))
        at = F.explode(F.array(*[F.shiftrightunsigned("seed", s).bitwiseAND(F.lit(bits - 1)) for s in cls.SHIFTS]))
        words = seeds.select(at.alias("at")).groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(cast(1 as bigint), cast(at & 63 as int))")).alias("bits"))
        out = np.zeros(bits // 64, np.uint64)
        for r in words.collect():
            out[r["word"]] = r["bits"] & (1 << 64) - 1
        return cls(out)


def _list(values: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit hashes as lists of longs."""
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values).astype(np.uint64).view(np.int64) if values else np.empty(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))


def _array(cell) -> np.ndarray:
    return np.asarray(cell.values).view(np.uint64)


def _items(benchmark: DataFrame, id_col: str, text_col: str, min_match: int) -> DataFrame:
    """item_id, tokens, k (words of a seed) and seeds of every benchmark item that has a word."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            tokens = [word_hashes(t.as_py()) for t in part.column(1)]
            has = [i for i, t in enumerate(tokens) if len(t)]
            k = [min(min_match, len(tokens[i])) for i in has]
            seeds = [np.unique(seeds_of(tokens[i], n)) for i, n in zip(has, k)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(has, pa.int64())), _list([tokens[i] for i in has]), pa.array(k, pa.int32()), _list(seeds)], ["item_id", "tokens", "k", "seeds"])

    picked = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    read_items = picked.mapInArrow(read, "item_id long, tokens array<long>, k int, seeds array<long>")
    return read_items.select(F.monotonically_increasing_id().alias("item"), "*")


def _hits(docs: DataFrame, key: list, id_col: str, text_col: str, bloom: Bloom, lengths: list[int]) -> DataFrame:
    """Documents with a seed that the filter lets through: those seeds, and the words they cover, a zero after each run."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)  # most_bits / 8 bytes at most

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, runs, seeds = [], [], []
            for i, text in enumerate(part.column("text")):
                words = word_hashes(text.as_py())
                covered, here = np.zeros(len(words) + 1, np.int64), []
                for k in lengths:
                    found = seeds_of(words, k)
                    at = np.flatnonzero(shared.value.has(found))
                    if len(at):
                        here.append(np.unique(found[at]))
                        np.add.at(covered, at, 1)
                        np.add.at(covered, at + k, -1)
                if here:
                    inside = np.cumsum(covered)[:-1] > 0
                    edge = np.flatnonzero(inside | np.concatenate(([False], inside[:-1])))
                    rows.append(i)
                    runs.append(np.where(inside[edge], words[edge], np.uint64(0)))
                    seeds.append(np.concatenate(here))
            if rows:
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("doc_id", "k1", "k2")), _list(runs), _list(seeds)], ["doc_id", "k1", "k2", "runs", "seeds"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *key, F.col(f"`{text_col}`").cast("string").alias("text"))
    found = texts.mapInArrow(look, "doc_id long, k1 long, k2 long, runs array<long>, seeds array<long>")
    return found.select(F.monotonically_increasing_id().alias("row"), "*")


_FOUND = "doc_id long, k1 long, k2 long, item_id long, item_words int, matched_words int, tiles int, coverage double"


def _tiled(work: DataFrame, coverage: float) -> DataFrame:
    def tile(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for i, (runs, tokens, k) in enumerate(zip(part.column("runs"), part.column("tokens"), part.column("k").to_pylist())):
                item = _array(tokens)
                got = tiles(_array(runs), item, k)
                matched = sum(n for *_, n in got)
                if matched and matched / len(item) >= coverage:
                    rows.append((i, len(item), matched, len(got), matched / len(item)))
            at = pa.array([r[0] for r in rows], pa.int64())
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("doc_id", "k1", "k2", "item_id")), *(pa.array([r[j + 1] for r in rows], kind) for j, kind in enumerate(kinds))], [c.split()[0] for c in _FOUND.split(", ")])

    return work.mapInArrow(tile, _FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = 5, coverage: float = 0.5, most_bits: int = 1 << 24, keep: bool = False) -> DataFrame:
    """Matches of documents with benchmark items: doc_id, item_id, item_words, matched_words, tiles, coverage (those at or over `coverage`).

    Documents are read once. Neither they nor the benchmark pass through the driver: it sees the benchmark's Bloom filter of at
    most most_bits bits (a fuller filter lets more seeds through to the join, which is exact) and the seed lengths. Null and empty texts
    and items match nothing; an item of fewer than min_match words has to be found whole. Repeated documents or items give repeated rows;
    null ids are passed on; empty tables give no rows. With keep, docs (then a stored table, read again) without any match are
    returned instead, with all their columns.
    """
    key = row_key(id_col, text_col)
    with Scratch(docs.sparkSession, "decontaminate") as s:
        items = s.write(_items(benchmark, item_col, item_text_col, min_match), "items")
        seeds = s.write(items.select("item", F.explode("seeds").alias("seed")), "seeds")
        lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # min_match values at most
        hits = s.write(_hits(docs, key, id_col, text_col, Bloom.of(seeds, seeds.count(), most_bits), lengths), "hits")
        # A passage that many documents share is a hot seed: the join has two plain inputs, so that AQE can split it.
        pairs = s.write(hits.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed").select("row", "item").distinct(), "pairs")
        work = pairs.join(items.select("item", "item_id", "tokens", "k"), "item").join(hits.select("row", "doc_id", "k1", "k2", "runs"), "row")
        found = s.write(_tiled(work, coverage), "found", keep=not keep)
        gone = s.write(found.select("k1", "k2").distinct(), "gone", keep=True) if keep else None
    if not keep:
        return found.drop("k1", "k2")
    return docs.select(*key, F.struct("*").alias("row")).join(gone, ["k1", "k2"], "left_anti").select("row.*")
