"""Quality classifier by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (a good one over a poor one). Logistic loss on the differences of their
features fits a score per document; a document is good if its score is above the quantile of the training scores that the share
of poor ones names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

FEATURES = ("log_bytes", "letters", "upper", "digits", "spaces", "symbols", "repeated_marks", "word_length", "word_spread", "distinct_words", "twin_words", "top_word", "no_letter_words", "all_upper_words", "line_length", "repeated_lines", "bars", "common_words")
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_ORDINARY = np.frombuffer(b".,;:'\"-()", np.uint8)
_SPACE = b"\t\n\x0b\x0c\r "
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha() and b not in _SPACE)
_NOT_LOWER = bytes(b for b in range(256) if not 97 <= b < 123 and b not in _SPACE)
_MARKS = re.compile(rb"([!#$%&*|?=~<>@^_+])\1+")


def features(text: str | None) -> np.ndarray:
    """Shares and lengths over the whole text; all zero for null and empty texts."""
    if not text:
        return np.zeros(len(FEATURES))
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, letters = counts[_UPPER].sum(), counts[_UPPER].sum() + counts[_LOWER].sum() + counts[128:].sum()
    digits, spaces = counts[_DIGIT].sum(), counts[9:14].sum() + counts[32]
    symbols = n - letters - digits - spaces - counts[_ORDINARY].sum()
    words = raw.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    tally = Counter(words)
    times = np.sort(np.fromiter(tally.values(), np.int64, len(tally)))[::-1] if words else np.zeros(1)
    with_letters = len(raw.translate(None, _NO_LETTERS).split())
    not_upper = len(raw.translate(None, _NOT_LOWER).split())
    lines = raw.split(b"\n")
    marks = sum(len(m.group()) for m in _MARKS.finditer(raw)) if symbols else 0
    return np.array(
        [
            math.log1p(n),
            letters / n,
            upper / max(1, letters),
            digits / n,
            spaces / n,
            symbols / n,
            marks / n,
            lengths.mean(),
            lengths.std(),
            len(tally) / w**0.8,
            sum(map(bytes.__eq__, words, words[1:])) / w,
            times[0] / w,
            1 - with_letters / w,
            (with_letters - not_upper) / w,
            math.log1p(n / len(lines)),
            1 - len(set(lines)) / len(lines),
            words.count(b"|") / w,
            times[:20].sum() / w,
        ]
    )


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x) - self.threshold, -40, 40)))


def fit_ranker(x: np.ndarray, good: np.ndarray, pairs: int = 40_000, seed: int = 0, ridge: float = 1e-3, steps: int = 30) -> Ranker:
    """Bradley-Terry: P(a over b) = 1 / (1 + exp(score(b) - score(a))), fitted by Newton steps on differences of features.

    The threshold is the quantile of the training scores at the share of poor documents. Without both kinds of label every score is 0.5.
    """
    d = x.shape[1]
    if not good.any() or good.all():
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(np.flatnonzero(good), pairs)] - z[rng.choice(np.flatnonzero(~good), pairs)]
    w = np.zeros(d)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        gradient = diff.T @ p / pairs - ridge * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    scores = z @ w
    cut = np.quantile(scores, 1 - good.mean())
    above, below = scores[scores > cut], scores[scores <= cut]
    return Ranker(mean, scale, w, float((above.min() + below.max()) / 2) if len(above) and len(below) else float(cut))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 6000, seed: int = 0) -> Ranker:
    """Fits on at most sample_rows labelled documents, the first by a hash of their ids, none of them held out (crc32 of the id modulo 3 is 1).

    The bound holds for the labels drawn and, where ids repeat, for the documents that have them.
    """
    known = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & (crc_mod(F.col(f"`{id_col}`"), 3) != 1))
    known = known.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "label").limit(sample_rows)

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(known), "doc_id")  # sample_rows rows at most
    rows = texts.select("doc_id", described("text").alias("x"), "label").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "label", "x").limit(sample_rows).collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    return fit_ranker(x, np.array([r["label"] == 1 for r in rows], bool), seed=seed)


def score_column(ranker: Ranker):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(ranker.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs. Null and empty texts are scored like any other.

    A null id counts as not held out. Repeated rows are scored alike; other columns are dropped; without labels every
    score is 0.5. A map over the documents: nothing is shuffled.
    """
    ranker = train(docs, labels, id_col, text_col, **settings)
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (crc_mod(F.col(f"`{id_col}`"), 3) == 1).alias("held_out"), score_column(ranker)(F.col(f"`{text_col}`")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least 0.5."""
    ranker = train(docs, labels, id_col, text_col, **settings)
    return docs.where(score_column(ranker)(F.col(f"`{text_col}`")) >= 0.5)
