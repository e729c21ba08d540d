"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: each slot holds a mask with a bit per language. The slots of an
n-gram, and-ed, name all languages whose filters contain it. Per-language counts of such bits, corrected for the
filters' false positives, decide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_mod

#: Letters, and with them number signs such as fractions, which `has_letter` tells apart.
LETTER = re.compile(r"[^\W\d_]")
NOT_TEXT = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
N = 4
_CHUNK = 1 << 20


def has_letter(text: str) -> bool:
    """Whether a character is of a Unicode letter category."""
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def grams(text: str) -> Iterator[np.ndarray]:
    """The text's n-grams of N bytes as numbers, over lower-cased letters with one space between words, in chunks."""
    raw = b" " + NOT_TEXT.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass") + b" "
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, max(0, len(data) - N + 1), _CHUNK):
        part = data[at : at + _CHUNK + N - 1].astype(np.uint32)
        yield part[:-3] << np.uint32(24) | part[1:-2] << np.uint32(16) | part[2:-1] << np.uint32(8) | part[3:]


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    slots: np.ndarray  # (slots, words) uint64: language bitmasks
    false_positive: np.ndarray  # per language

    @staticmethod
    def places(g: np.ndarray, size: int) -> list[np.ndarray]:
        """Two slots per n-gram; size is a power of two."""
        with np.errstate(over="ignore"):
            h = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            k = h * np.uint64(0xD6E8FEB86659FD93)
        mask = np.uint64(size - 1)
        return [((h >> np.uint64(20)) & mask).astype(np.int64), ((k >> np.uint64(33)) & mask).astype(np.int64)]

    @classmethod
    def build(cls, sets: dict[str, np.ndarray], bits_per_gram: int = 16) -> "Filters":
        languages = tuple(sorted(sets))
        largest = max((len(v) for v in sets.values()), default=1)
        size = 1 << max(10, (largest * bits_per_gram - 1).bit_length())
        slots = np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64)
        for k, name in enumerate(languages):
            for p in cls.places(sets[name].astype(np.uint32), size):
                slots[np.unique(p), k // 64] |= np.uint64(1) << np.uint64(k % 64)
        share = np.array([((slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        return cls(languages, slots, share**2)

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """(n-grams of the text that each language's filter contains, all n-grams)."""
        got, n = np.zeros(len(self.languages)), 0
        for g in grams(text):
            first, second = self.places(g, len(self.slots))
            masks = self.slots[first] & self.slots[second]
            if len(self.languages) <= 12:  # few enough masks to count them all at once
                seen = np.bincount(masks[:, 0].astype(np.int64), minlength=1 << len(self.languages))
                got += [seen[np.arange(len(seen)) >> k & 1 == 1].sum() for k in range(len(self.languages))]
            else:
                for k in range(len(self.languages)):
                    got[k] += ((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum()
            n += len(g)
        return got, n

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share of the corrected counts' total that it has); `und` for null, for texts without letters, or if nothing was learned.

        A text of which no filter knows an n-gram gets the first language with a score of 0.
        """
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        got, n = self.counts(text)
        true = np.clip((got - n * self.false_positive) / np.maximum(1e-9, 1 - self.false_positive), 0, None)
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / true.sum()) if true.sum() else 0.0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 6000, grams_per_language: int = 3000, seed: int = 0) -> Filters:
    """Learns each language's grams_per_language most frequent n-grams from about sample_rows of its documents, drawn by a hash of their ids.

    A language with no more documents than that gives all of them, so every language learned has a filter. None of them is held out (crc32 of the id modulo 4 is 2) or has a null lang. The whole text of a sampled document counts.
    """
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & (crc_mod(F.col(f"`{id_col}`"), 4) != 2)).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    known = known.where("doc_id is not null")
    sizes = known.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("of_lang"))  # a row per language
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found: dict[str, Counter] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text")):
                for g in grams(text.as_py() or ""):
                    found.setdefault(lang, Counter()).update(dict(zip(*(x.tolist() for x in np.unique(g, return_counts=True)))))
            for lang, c in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())], ["lang", "gram", "n"])

    picked = known.join(F.broadcast(sizes), F.col("lang") == F.col("of")).where(place * F.col("of_lang") < sample_rows).select("lang", "text")
    summed = picked.mapInArrow(tally, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= grams_per_language).select("lang", "gram").collect()
    sets: dict[str, list[int]] = {}
    for r in rows:
        sets.setdefault(r["lang"], []).append(r["gram"])
    return Filters.build({k: np.array(sorted(v)) for k, v in sets.items()})


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of docs.

    A null id counts as not held out; repeated rows are treated alike; ties go to the language first by code point; other columns are
    dropped; without labelled rows every answer is `und`. The filters are some hundred kilobytes and travel with the function.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col, **settings))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (crc_mod(F.col(f"`{id_col}`"), 4) == 2).alias("held_out"), predict(F.col(f"`{text_col}`")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
