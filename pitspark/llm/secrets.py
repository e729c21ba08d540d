"""Secret scans: fixed patterns, and a character convolutional network over every candidate with its context.

The network is written in numpy. It is trained on labelled findings: those of all documents (what a base pattern matches is
positive, any other candidate negative), and those of a seeded generator (keys, tokens and passwords of many
forms in code and prose; and what looks like them but is not: words, numbers, dates, paths, e-mail addresses), which show it
what the patterns do not cover. One part of them is learned, a second calibrates the scores, and on a third the threshold
keeps a demanded recall. Candidates longer than the network's input are scored window by window.

The documents' findings stay a table. Tasks learn slices of it from common weights, which are then averaged; calibration and
threshold are sums and order statistics of it.
"""

from __future__ import annotations

import base64
import dataclasses
import functools
import hashlib
import math
import random
import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod

#: The base patterns (fixed values): assignments, access keys and runs of hexadecimal digits.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "cnn")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: From so many characters on any run is a candidate; a shorter one needs a letter and a digit.
ANY = 16
SPAN, CONTEXT = 64, 24
#: Windows of a long candidate start so many characters apart, so a key of up to SPAN - STEP lies whole in one of them.
STEP = 16
WIDTH = SPAN + 2 * CONTEXT


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points of the base matches: leftmost, not overlapping within a kind, failing ones dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs of 8 or more key characters with a letter and a digit, of 16 or more with either, without the dots and signs at their ends."""
    for m in CANDIDATE.finditer(text):
        word = m.group().rstrip(".=-")
        if len(word) >= ANY and any(c.isalnum() for c in word) or len(word) >= 8 and not word.isalpha() and any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
            yield m.start(), m.start() + len(word)


def windows_of(start: int, end: int) -> list[tuple[int, int]]:
    """The candidate itself, or windows of SPAN characters over all of a longer one."""
    if end - start <= SPAN:
        return [(start, end)]
    return [(at, at + SPAN) for at in [*range(start, end - SPAN, STEP), end - SPAN]]


def offered(text: str) -> Iterator[tuple[int, int]]:
    """The windows of all candidates, in order."""
    for start, end in candidates(text):
        yield from windows_of(start, end)


def covered(start: int, end: int, base: list[tuple[int, int, int]]) -> bool:
    """Whether the window lies in a base span, but for the signs that may stand before a value."""
    return any(i <= start and end <= j for i, _, j in base)


# Classes of characters: upper, lower and digits each apart; other ASCII one by one; the rest together.
_CLASS = np.full(256, 95, np.int64)
_CLASS[32:127] = np.arange(95)


def encoded(text: str, start: int, end: int) -> np.ndarray:
    """A window between CONTEXT characters on either side; 96 pads. Of more than SPAN characters the first ones are meant: the scan gives the others as windows of their own."""
    end = min(end, start + SPAN)
    word = text[start:end]
    out = np.full(WIDTH, 96, np.int64)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    for at, part in ((CONTEXT - len(before), before), (CONTEXT, word), (CONTEXT + SPAN, after)):
        codes = np.frombuffer(part.encode("latin-1", "replace"), np.uint8)
        out[at : at + len(codes)] = _CLASS[codes]
    return out


def _finding(rng: random.Random) -> tuple[str, int, int, int]:
    """(text, start, end, label) of one labelled finding."""
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    word = lambda: pick("etaoinshrdlu", rng.randint(2, 9))
    b64, alnum = string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits
    prose = lambda: " ".join(word() for _ in range(rng.randint(0, 6)))
    label = int(rng.random() < 0.5)
    if label:
        value = rng.choice(
            [
                lambda: pick("0123456789abcdef", rng.choice([32, 40, 64])),
                lambda: pick(alnum, rng.randint(20, 48)),
                lambda: pick(alnum, rng.randint(9, 18)) + rng.choice(string.digits),
                lambda: pick(b64, rng.choice([24, 32, 43, 60])),
                lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
                lambda: rng.choice(["sk_live_", "ghp_", "xoxb-", "glpat-", "AIza"]) + pick(alnum, rng.randint(24, 40)),
                lambda: ".".join(base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("=") for n in (24, 48, 32)),
            ]
        )()
        lead = rng.choice(["key = ", "auth: ", "Bearer ", 'export TOKEN="', "credential=", "", "private_key: '", "pw ", "my key is ", "login with ", "pass: "] if len(value) >= 20 else ["key = ", "auth: ", "credential=", "pw ", "my key is ", "the password is ", "private_key: '", "pass: "])
    else:
        value = rng.choice(
            [
                lambda: word() + "-" + word() + "-" + word() + "-" + str(rng.randint(1, 2030)),
                lambda: "/".join(word() for _ in range(rng.randint(3, 6))) + "/" + str(rng.randint(1, 99)),
                lambda: ".".join(word() for _ in range(3)) + "/" + pick(string.digits, 4),
                lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}.{rng.randint(0, 59):02d}",
                lambda: word() * 2 + word() + str(rng.randint(1, 99)),
                lambda: "_".join(word() for _ in range(3)) + f"_v{rng.randint(1, 9)}.{rng.randint(0, 20)}",
                lambda: "DE" + pick(string.digits, 20),
                lambda: pick(string.digits, rng.randint(12, 18)) + word()[:2],
                lambda: "file" + pick(string.digits, 3) + "." + word() + "." + rng.choice(["csv", "parquet", "html"]),
                lambda: "/".join(word() for _ in range(rng.randint(3, 9))),
                lambda: rng.choice("-_.").join(word() for _ in range(rng.randint(3, 7))).title()[:SPAN],
                lambda: "".join(pick("bcdfghjklmnprstvwz", rng.randint(1, 2)) + pick("aeiou", 1) + pick("nrst", rng.randint(0, 1)) for _ in range(rng.randint(5, 9))),
                lambda: pick(string.digits, rng.randint(9, 30)),
                lambda: (word() + word() + word())[: rng.randint(8, 30)].upper() + rng.choice(["", str(rng.randint(0, 99))]),
                lambda: "".join(pick("BCDFGHJKLMNPRSTVWZ", rng.randint(1, 2)) + pick("AEIOU", 1) + pick("NRST", rng.randint(0, 1)) for _ in range(rng.randint(5, 9))),
                lambda: rng.choice("=-_.a") * rng.randint(8, 30) + word(),
            ]
        )()
        lead = rng.choice(["see ", "at ", "/", "www.", "", "id: ", "in ", "path=", "version "])
    left, right = f"{prose()} {lead}", f"{rng.choice([' ', '.', chr(34), ', '])}{prose()}"
    if not label and rng.random() < 0.3:  # parts of an e-mail address
        host = f"{rng.choice(['mail', 'mx', 'post', word()])}{rng.choice(['', str(rng.randint(0, 99))])}.{rng.choice(['example', word()])}.{rng.choice(['com', 'org', 'net', 'de'])}"
        name = f"{word()}{rng.choice(['', word()])}{rng.choice(['.', '_', '-', ''])}{rng.choice([word(), str(rng.randint(0, 99))])}{rng.choice(['', str(rng.randint(0, 99))])}"
        if rng.random() < 0.5:
            value, right = name, f"@{host} {prose()}"
        else:
            value, left, right = host, f"{prose()} {name}@", f" {prose()}"
    if rng.random() < 0.15:  # inside a long run: a path or an address
        path = lambda n: "/".join(word() for _ in range(n))
        left, right = f"{left}{path(rng.randint(2, 9))}/", f"/{path(rng.randint(0, 9))}{right}"
    return left + value + right, len(left), len(left) + len(value), label


@dataclass(frozen=True)
class Network:
    """Embedding, one convolution, maximum over places, one hidden layer; `scale` and `shift` calibrate the logit."""

    table: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    K = 5

    def windows(self, x: np.ndarray) -> np.ndarray:
        e = self.table[x]
        return np.concatenate([e[:, k : e.shape[1] - self.K + 1 + k] for k in range(self.K)], axis=2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        got = []
        for at in range(0, len(x), 512):
            conv = np.maximum(self.windows(x[at : at + 512]) @ self.filters + self.bias, 0).max(axis=1)
            got.append(np.maximum(conv @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias)
        return np.concatenate(got) if got else np.zeros(0)

    def of_logits(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.of_logits(self.logits(x))


def _descend(p: list[np.ndarray], x: np.ndarray, y: np.ndarray, batches: Iterator[np.ndarray], rate: float) -> list[np.ndarray]:
    """The weights after one Adam step per batch of rows."""
    p, k = list(p), Network.K
    dim = p[0].shape[1]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step, some in enumerate(batches, 1):
        xb, batch = x[some], len(some)
        windows = Network(*p[:6], p[6][0]).windows(xb)
        conv = windows @ p[1] + p[2]
        best = conv.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(conv, best[:, None, :], 1)[:, 0], 0)
        h = np.maximum(pooled @ p[3] + p[4], 0)
        z = h @ p[5] + p[6][0]
        dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[some]) / batch
        dh = np.outer(dz, p[5]) * (h > 0)
        dpool = (dh @ p[3].T) * (pooled > 0)
        rows = np.arange(batch)[:, None]
        at_best = windows[rows, best]  # (batch, filters, k * dim)
        dwin = dpool[:, :, None] * p[1].T[None]
        places = best[:, :, None] + np.arange(k)
        codes, parts = xb[rows[:, :, None], places].ravel(), dwin.reshape(-1, dim)
        dtable = np.stack([np.bincount(codes, parts[:, j], len(p[0])) for j in range(dim)], axis=1)
        grads = [dtable, np.einsum("bf,bfd->df", dpool, at_best), dpool.sum(0), pooled.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            p[i] = p[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return p


def _train(x: np.ndarray, y: np.ndarray, seed: int, steps: int = 1200, batch: int = 64, rate: float = 4e-3) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    dim, n_filters, n_hidden, k = 8, 24, 16, Network.K
    p = [rng.normal(0, 0.3, (97, dim)), rng.normal(0, 0.2, (k * dim, n_filters)), np.zeros(n_filters), rng.normal(0, 0.3, (n_filters, n_hidden)), np.zeros(n_hidden), rng.normal(0, 0.3, n_hidden), np.zeros(1)]
    return _descend(p, x, y, (rng.integers(0, len(x), batch) for _ in range(steps)), rate)


def _holding(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The windows offered that hold half of a finding or more, or half a window of a long one."""
    return [(a, b) for a, b in offered(text) if 2 * (min(b, end) - max(a, start)) >= min(SPAN, end - start)]


#: A finding as the network sees it: the windows that the scan offers for it, and its label.
Finding = tuple[list[np.ndarray], int]


def generated(findings: int, seed: int) -> list[Finding]:
    """Labelled findings of the generator; one that the scan does not offer has no windows and counts as missed."""
    rng = random.Random(seed)
    made = [_finding(rng) for _ in range(findings)]
    return [([encoded(text, a, b) for a, b in _holding(text, start, end)], label) for text, start, end, label in made]


def findings_in(text: str) -> list[tuple[str, int]]:
    """(window with its context, label) of every candidate of a text: positive if a base pattern covers half of it."""
    base, out = base_spans(text), []
    for a, b in offered(text):
        label = any(2 * (min(b, j) - max(a, i)) >= b - a for i, _, j in base)
        out.append((encoded(text, a, b), int(label)))
    return out


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, label and x (the window as the network sees it) of every finding of all documents; equal findings of a part count once.

    The parts go by crc32 of the id modulo 4: 0 and 1, 2, 3.
    """
    part = F.element_at(F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(2)), crc_mod(F.col(f"`{id_col}`"), 4) + 1)

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(part, label, x.astype(np.uint8).tobytes()) for part, text in zip(pdf["part"], pdf["text"]) for x, label in findings_in(text or "")]
            yield pd.DataFrame(rows, columns=["part", "label", "x"]).drop_duplicates()

    return docs.select(part.alias("part"), F.col(f"`{text_col}`").alias("text")).mapInPandas(find, "part int, label int, x binary").distinct()


def _inputs(x: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.uint8).reshape(-1, WIDTH).astype(np.int64)


def _flat(some: list[Finding]) -> tuple[np.ndarray, np.ndarray]:
    rows = [(x, label) for windows, label in some for x in windows]
    return np.array([x for x, _ in rows]), np.array([y for _, y in rows], float)


#: Findings of documents that a task learns at once, about.
SLICE = 8192
#: Rates of the rounds; in each every finding of the first part is learned once or, of a small table, more often.
RATES = (8e-3, 4e-3, 2e-3, 5e-4)


def order_of(n: int, at_least: int, rng: np.random.Generator) -> np.ndarray:
    """Whole permutations of n rows, one after the other, of at_least rows in all."""
    return np.concatenate([rng.permutation(n) for _ in range(max(1, -(-at_least // n)))])


def fit(found: DataFrame, total: int, start: list[np.ndarray], made: tuple[np.ndarray, np.ndarray], seed: int = 0, rates: tuple[float, ...] = RATES, rows: int = SLICE) -> tuple[list[np.ndarray], int]:
    """Weights learned from all of found (label, x), `total` rows, and the number of findings learned in the last round.

    In a round each slice is learned by a task, from the weights of the round before, half a batch its findings and half those made by the
    generator; the new weights are averaged by the slices' findings. Slices go by a hash of x, so results hang on no partitioning.
    The driver gets 17 kB per slice.
    """
    slices, half, least = -(-total // rows), 32, 384
    spark = found.sparkSession
    given = spark.sparkContext.broadcast((made[0].astype(np.uint8), made[1]))  # half a megabyte
    dealt = found.withColumn("slice", F.pmod(F.xxhash64(F.lit(seed), "x"), F.lit(slices)).cast("int")).select("slice", "label", "x")
    weights, learned = start, 0

    def learner(weights: list[np.ndarray], turn: int, rate: float):
        def learn(pdf):
            pdf = pdf.sort_values(["label", "x"])
            slice_, n = int(pdf["slice"].iat[0]), len(pdf)
            x, y = given.value
            rng = np.random.default_rng([seed, turn, slice_])
            own = order_of(n, least * half, rng)
            more = n + order_of(len(y), len(own), rng)
            batches = (np.concatenate((own[at : at + half], more[at : at + half])) for at in range(0, len(own), half))
            got = _descend(weights, np.concatenate((_inputs(pdf["x"]), x.astype(np.int64))), np.concatenate((pdf["label"].to_numpy(float), y)), batches, rate)
            return pd.DataFrame({"slice": [slice_], "n": [n], "weights": [np.concatenate([a.ravel() for a in got])]})

        return learn

    for turn, rate in enumerate(rates):
        got = sorted(dealt.repartition(slices, "slice").groupBy("slice").applyInPandas(learner(weights, turn, rate), "slice int, n long, weights array<double>").collect())
        learned = sum(r["n"] for r in got)
        mean = sum(r["n"] / learned * np.array(r["weights"]) for r in got)
        ends = np.cumsum([a.size for a in start])
        weights = [part.reshape(a.shape) for part, a in zip(np.split(mean, ends[:-1]), start)]
    given.destroy()
    return weights, learned


def scored(found: DataFrame, net: Network) -> DataFrame:
    """part, label and z (the logit) per finding."""

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"part": pdf["part"], "label": pdf["label"], "z": net.logits(_inputs(pdf["x"]))})

    return found.mapInPandas(score, "part int, label int, z double")


#: Loss, gradient and second derivatives at (scale, shift), for labels that count as so much.
Sums = Callable[[np.ndarray, float, float], np.ndarray]


def _sums(z: np.ndarray, y: np.ndarray) -> Sums:
    def at(w: np.ndarray, low: float, high: float) -> np.ndarray:
        u, t = w[0] * z + w[1], np.where(y > 0, high, low)
        q = 1 / (1 + np.exp(-np.clip(u, -40, 40)))
        return np.array([(np.logaddexp(0, u) - t * u).sum(), ((q - t) * z).sum(), (q - t).sum(), (q * (1 - q) * z * z).sum(), (q * (1 - q) * z).sum(), (q * (1 - q)).sum()])

    return at


def _exact(rows: DataFrame, *columns: Column) -> np.ndarray:
    """Sums of doubles as decimals, which hang on no order."""
    return np.array([float(x or 0) for x in rows.agg(*[F.sum(c.cast("decimal(38,18)")) for c in columns]).first()])


def _table_sums(rows: DataFrame) -> Sums:
    """The same of a table (label, z)."""

    def at(w: np.ndarray, low: float, high: float) -> np.ndarray:
        z, t = F.col("z"), F.when(F.col("label") > 0, high).otherwise(low)
        r = rows.select(z, (float(w[0]) * z + float(w[1])).alias("u"), t.alias("t"))
        u, t = F.col("u"), F.col("t")
        r = r.select(z, u, t, (1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), u))))).alias("q"))
        q = F.col("q")
        return _exact(r, F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u))) - t * u, (q - t) * z, q - t, q * (1 - q) * z * z, q * (1 - q) * z, q * (1 - q))

    return at


def _platt(sums: Sums, poor: float, good: float, unit: float, steps: int = 60) -> dict[str, float]:
    """scale and shift of the logits by Newton steps, halved while the loss grows. Platt's targets are never quite sure, so neither are the scores.

    The ridge is on the scale in units of the logits' spread, and on the shift.
    """
    low, high = 1 / (poor + 2), (good + 1) / (good + 2)
    ridge = 1e-3 * (poor + good) * np.array([unit * unit, 1.0])

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, g0, g1, h0, h01, h1 = sums(w, low, high)
        return loss + 0.5 * (ridge * w) @ w, np.array([g0, g1]) + ridge * w, np.array([[h0, h01], [h01, h1]]) + np.diag(ridge)

    w = np.array([1.0 / unit, 0.0])
    here = at(w)
    for _ in range(steps):
        step, size = np.linalg.solve(here[2], here[1]), 1.0
        if np.abs(step * [unit, 1.0]).max() < 1e-7:
            w = w - step
            break
        there = at(w - step)
        while size > 1e-6 and there[0] > here[0] + 1e-12 * abs(here[0]):
            size /= 2
            there = at(w - size * step)
        w, here = w - size * step, there
    return {"scale": float(w[0]), "shift": float(w[1])}


def _quantile(values: list[tuple[float, float]], budget: float) -> float:
    """Of (value, weight) the first by value with which the weights exceed the budget."""
    taken = 0.0
    for value, weight in sorted(values):
        taken += weight
        if taken > budget:
            break
    return value


def _settled(weights: list[np.ndarray], parts: list[list[Finding]], recall: float, rows: Callable[[Network], DataFrame] | None = None, counts: dict[tuple[int, int], int] | None = None) -> Network:
    """The network calibrated on the second part and with the threshold of the third.

    The threshold is the highest that keeps the demanded recall of positives, of the generator and of the documents alike; a finding
    is found if one of its windows is. What the scan never offers counts as missed. `rows` scores the documents' findings and `counts`
    says how many there are per part and label; where they are more than the generator's, the latter weigh as much in all as they.
    """
    net, counts = Network(*weights[:6], float(weights[6][0])), counts or {}
    table = rows(net) if rows and any(part for part, _ in counts) else None
    x, y = _flat(parts[1])
    z = net.logits(x)
    local, n = _sums(z, y), {label: counts.get((1, label), 0) for label in (0, 1)}
    weight = max(1.0, sum(n.values()) / len(y))
    moments, sums = weight * np.array([z.sum(), (z * z).sum()]), lambda *at: weight * local(*at)
    if sum(n.values()):
        second = table.where("part = 1")
        moments = moments + _exact(second, F.col("z"), F.col("z") * F.col("z"))
        more = _table_sums(second)
        sums = lambda *at: weight * local(*at) + more(*at)
    total = weight * len(y) + sum(n.values())
    unit = max(1e-9, math.sqrt(max(0.0, moments[1] / total - (moments[0] / total) ** 2)))
    net = dataclasses.replace(net, **_platt(sums, weight * (y == 0).sum() + n[0], weight * (y > 0).sum() + n[1], unit))

    own = [net.probability(np.array(windows)).max() if windows else 0.0 for windows, label in parts[2] if label]
    n_docs = counts.get((2, 1), 0)
    weight = max(1.0, n_docs / len(own))
    budget = (1 - recall) * (weight * len(own) + n_docs)
    kept = [(float(p), weight) for p in own]
    if n_docs:  # of the documents' no more than the budget can be below the threshold
        lowest = table.where("part = 2 and label = 1").orderBy(net.scale * F.col("z") + net.shift).limit(int(budget) + 1).collect()
        kept += [(float(p), 1.0) for p in net.of_logits(np.array([r["z"] for r in lowest]))]
    return dataclasses.replace(net, threshold=_quantile(kept, budget))


@functools.lru_cache(maxsize=4)
def _made(seed: int, findings: int) -> tuple[list[list[Finding]], list[np.ndarray]]:
    """The generator's findings in three parts, and the weights learned from the first."""
    parts = [generated(findings // 2, 4 * seed + 1), generated(findings // 4, 4 * seed + 2), generated(findings // 4, 4 * seed + 3)]
    return parts, _train(*_flat(parts[0]), seed)


@functools.lru_cache(maxsize=4)
def trained(seed: int = 0, findings: int = 8000, recall: float = 0.98) -> Network:
    """Learns on one part of the generator's findings, calibrates (Platt) on a second, and sets the threshold on a third."""
    parts, weights = _made(seed, findings)
    return _settled(weights, parts, recall)


def scan(texts: list[str | None], net: Network, batch: int = 4096) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]]:
    """(base spans, all spans with their scores) per text.

    Every candidate is scored. Those found that lie in a base span are left to it, and its score is the best of its candidates'
    (NaN if it holds none); windows found that overlap are one span.
    """
    out, waiting, owners, scores = [], [], [], []

    def decide() -> None:
        if waiting:
            for (k, start, end), p in zip(owners, net.probability(np.array(waiting))):
                base, more = out[k]
                for n, (i, _, j) in enumerate(base):
                    if start < j and i < end:
                        scores[k][n] = max(p, scores[k][n]) if scores[k][n] == scores[k][n] else p
                if p >= net.threshold and not covered(start, end, base):
                    if more and start < more[-1][2]:  # windows come in order
                        more[-1] = (more[-1][0], 3, max(end, more[-1][2]), max(p, more[-1][3]))
                    else:
                        more.append((start, 3, end, p))
            waiting.clear()
            owners.clear()

    for k, text in enumerate(texts):
        out.append((base_spans(text) if text else [], []))
        scores.append([float("nan")] * len(out[-1][0]))
        for start, end in offered(text) if text else ():
            waiting.append(encoded(text, start, end))
            owners.append((k, start, end))
            if len(waiting) >= batch:
                decide()
    decide()
    return [(base, sorted([(*b, p) for b, p in zip(base, mine)] + more)) for (base, more), mine in zip(out, scores)]


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, *_ in spans)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, recall: float = 0.98, findings: int = 8000) -> Network:
    """Learns, calibrates and sets the threshold on all findings of docs, and on the generator's."""
    parts, weights = _made(seed, findings)
    with Scratch(docs.sparkSession, "secrets") as scratch:
        found = scratch.write(labelled(docs, id_col, text_col), "findings")
        counts = {(r["part"], r["label"]): r["count"] for r in found.groupBy("part", "label").count().collect()}
        first = sum(n for (part, _), n in counts.items() if part == 0)
        if first:
            weights, learned = fit(found.where("part = 0"), first, weights, _flat(parts[0]), seed)
            if learned != first:
                raise RuntimeError(f"{learned} of {first} findings learned")
        return _settled(weights, parts, recall, lambda net: scratch.write(scored(found.where("part > 0"), net), "scored"), counts)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, recall: float = 0.98, findings: int = 8000) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (all) and scores (theirs, 0 to 1, in order) per row of docs.

    Null and empty texts have no spans (base_sha256 of the empty string); spans are in code points of the whole text.
    Repeated rows are scanned alike; other columns are dropped. Two maps over all docs: one writes their labelled findings (with
    the scores 0.02 of the input, deleted at the end) for the training, one scans. Without documents the generator's findings alone are learned.
    """
    net = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, seed, recall, findings))  # some ten kilobytes

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores array<double>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for base, every in scan(texts.tolist(), net.value):
                kinds = [k for _, k, _ in base]
                scores = [None if p != p else round(float(p), 6) for *_, p in every]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), scores))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), found(F.col(f"`{text_col}`")).alias("f")).select("doc_id", "f.*")
