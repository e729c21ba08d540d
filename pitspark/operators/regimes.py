"""Market regimes: window features, rules, mixtures, hidden Markov states, change points and their vote."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import full, last, log_return, series

FEATURES = ("trend", "realized_vol", "vol_of_vol", "liquidity_proxy", "dispersion", "correlation_proxy", "drawdown", "momentum_ratio", "tail_stress")
# The canonical regimes 0 to 3.
NAMES = ("low_vol_trend", "high_vol_trend", "high_vol_sideways", "crisis_stress")
FLOOR = 1e-12


def regime_features(bars: DataFrame, window: int = 20, fast: int = 5) -> DataFrame:
    """(symbol, idx, r, features...): three frames over one sort per symbol. A feature is NULL until its window is full."""
    w = series()
    x = bars.select("symbol", "idx", "close", log_return(F.col("close"), w).alias("r"))
    x = x.withColumn("rr", F.col("r") * F.lag("r").over(w))
    roll = lambda c, f, n: full(F.col(c), f(c).over(last(w, n)), w, n)
    x = x.withColumns(
        {
            "trend": roll("r", F.avg, window),
            "realized_vol": roll("r", F.stddev_samp, window),
            "mean_abs": full(F.col("r"), F.avg(F.abs("r")).over(last(w, window)), w, window),
            "mean_rr": roll("rr", F.avg, window),
            "fast": roll("r", F.avg, fast),
            "peak": full(F.col("close"), F.max("close").over(last(w, window)), w, window),
        }
    )
    x = x.withColumn("stress", F.when(F.abs("r") > 3 * F.col("realized_vol"), 1.0).otherwise(0.0))
    rv, trend = F.col("realized_vol"), F.col("trend")
    return x.select(
        "symbol",
        "idx",
        "r",
        "trend",
        "realized_vol",
        roll("realized_vol", F.stddev_samp, window).alias("vol_of_vol"),
        F.col("mean_abs").alias("liquidity_proxy"),
        (rv / F.greatest(F.col("mean_abs"), F.lit(FLOOR))).alias("dispersion"),
        F.when(rv * rv > FLOOR, (F.col("mean_rr") - trend * trend) / F.greatest(rv * rv, F.lit(FLOOR))).alias("correlation_proxy"),
        F.try_divide(F.col("close") - F.col("peak"), F.col("peak")).alias("drawdown"),
        (F.col("fast") / F.greatest(rv, F.lit(FLOOR))).alias("momentum_ratio"),
        full(F.col("stress"), F.sum("stress").over(last(w, window)), w, window).alias("tail_stress"),
    )


def normalize_features(features: DataFrame, names: tuple[str, ...] = FEATURES, by: str = "symbol") -> DataFrame:
    """z-scores with the population deviation of defined values; zeros where it vanishes. Aggregates as windows."""
    w = Window.partitionBy(by)
    out = features
    for c in names:
        sd = F.stddev_pop(c).over(w)
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.when(sd > FLOOR, (F.col(c) - F.avg(c).over(w)) / sd).otherwise(0.0)))
    return out


def rule_regimes(features: DataFrame, by: str = "symbol") -> DataFrame:
    """(symbol, idx, label): 3 crisis, 1 or 2 high volatility with trend up or down, 0 calm. Undefined features satisfy no test."""
    cuts = features.groupBy(by).agg(F.percentile("realized_vol", F.lit(0.8)).alias("p80"), F.percentile("trend", F.lit(0.5)).alias("mid"), F.percentile("drawdown", F.lit(0.2)).alias("p20"))
    j = features.join(cuts, by)
    hot = F.coalesce(F.col("realized_vol") >= F.col("p80"), F.lit(False))
    deep = F.coalesce(F.col("drawdown") <= F.col("p20"), F.lit(False))
    up = F.coalesce(F.col("trend") >= F.col("mid"), F.lit(False))
    crisis = F.coalesce(F.col("tail_stress") >= 2, F.lit(False)) | (hot & deep)
    return j.select(by, "idx", F.when(crisis, 3).when(hot & up, 1).when(hot, 2).otherwise(0).alias("label"))


def map_states(labelled: DataFrame, by: str = "symbol") -> DataFrame:
    """Adds `regime`: the state's rank by mean return, then deviation (0 for a single member)."""
    m = labelled.where("r is not null and label >= 0").groupBy(by, "label").agg(F.avg("r").alias("mean"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sd"))
    ranked = m.withColumn("regime", F.row_number().over(Window.partitionBy(by).orderBy("mean", "sd", "label")) - 1)
    return labelled.join(ranked.select(by, "label", "regime"), [by, "label"], "left").withColumn("regime", F.coalesce("regime", F.lit(-1)))


def _normal(r: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Log densities (n, k)."""
    return -((r[:, None] - centre) ** 2) / (2 * spread) - np.log(2 * np.pi * spread) / 2


def _quantile_states(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starting centres and variances: those of k slices of the sorted values, by distance from the median.

    Slices of |r - median| tell calm from wild stretches, which returns differ in more than in their mean.
    """
    far = np.argsort(np.abs(r - np.median(r)), kind="stable")
    slices = np.array_split(r[far], k)
    floor = max(FLOOR, float(r.var()) * 1e-3)
    return np.array([x.mean() if len(x) else 0.0 for x in slices]), np.array([max(float(x.var()), floor) if len(x) else floor for x in slices])


def _moments(r: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mass, centre, variance) of each state by weights (n, k)."""
    mass = weight.sum(axis=0) + FLOOR
    centre = weight.T @ r / mass
    return mass, centre, np.maximum(weight.T @ (r * r) / mass - centre**2, FLOOR)


def mixture(r: np.ndarray, k: int = 3, rounds: int = 200, tolerance: float = 1e-8) -> np.ndarray:
    """Responsibilities (n, k) of a Gaussian mixture, fitted until the mean log likelihood gains less than the tolerance."""
    k = max(1, min(k, len(r)))
    centre, spread = _quantile_states(r, k)
    share, before = np.full(k, 1 / k), -np.inf
    for _ in range(rounds):
        joint = _normal(r, centre, spread) + np.log(share)
        total = np.logaddexp.reduce(joint, axis=1)
        weight = np.exp(joint - total[:, None])
        if total.mean() - before < tolerance:
            break
        before = total.mean()
        mass, centre, spread = _moments(r, weight)
        share = mass / mass.sum()
    return weight


class Chain:
    """A Gaussian hidden Markov chain in log space."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, stay: float = 0.95):
        k = len(centre)
        self.centre, self.spread = centre, spread
        self.first = np.full(k, -np.log(k))
        self.step = np.log(np.full((k, k), (1 - stay) / max(1, k - 1)) + (stay - (1 - stay) / max(1, k - 1)) * np.eye(k)) if k > 1 else np.zeros((1, 1))

    def messages(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log emissions, forward and backward messages), each (n, k)."""
        emit = _normal(r, self.centre, self.spread)
        ahead, back = np.empty_like(emit), np.zeros_like(emit)
        ahead[0] = self.first + emit[0]
        for t in range(1, len(r)):
            ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, None] + self.step, axis=0) + emit[t]
        for t in range(len(r) - 1, 0, -1):
            back[t - 1] = np.logaddexp.reduce(self.step + (emit[t] + back[t])[None, :], axis=1)
        return emit, ahead, back

    def improve(self, r: np.ndarray) -> float:
        """One round of expectation maximisation; the log likelihood before it."""
        emit, ahead, back = self.messages(r)
        likelihood = float(np.logaddexp.reduce(ahead[-1]))
        state = np.exp(ahead + back - likelihood)
        moves = np.exp(ahead[:-1, :, None] + self.step + (emit[1:] + back[1:])[:, None, :] - likelihood).sum(axis=0) + FLOOR
        _, self.centre, self.spread = _moments(r, state)
        self.first = np.log(state[0] + FLOOR)
        self.step = np.log(moves / moves.sum(axis=1, keepdims=True))
        return likelihood


def hidden_markov(r: np.ndarray, k: int = 3, rounds: int = 50, tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(state that is likeliest by the values so far, posterior by all values) of a Gaussian hidden Markov chain, fitted until the likelihood of a value gains less than the tolerance."""
    chain = Chain(*_quantile_states(r, max(1, min(k, len(r)))))
    before = -np.inf
    for _ in range(rounds):
        now = chain.improve(r) / len(r)
        if now - before < tolerance:
            break
        before = now
    _, ahead, back = chain.messages(r)
    both = ahead + back
    return ahead.argmax(axis=1), np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None])


def best_split(x: np.ndarray) -> tuple[float, int]:
    """(gain, place): the split with at least two values on either side that lowers the sum of squares most; place -1 without one."""
    n = len(x)
    if n < 4:
        return 0.0, -1
    s, q = np.cumsum(x), np.cumsum(x * x)
    i = np.arange(2, n - 1)
    cost = (q[i - 1] - s[i - 1] ** 2 / i) + (q[-1] - q[i - 1] - (s[-1] - s[i - 1]) ** 2 / (n - i))
    gain = q[-1] - s[-1] ** 2 / n - cost
    k = int(gain.argmax())
    return (float(gain[k]), int(i[k])) if gain[k] > 0 else (0.0, -1)


def change_points(r: np.ndarray, most: int = 3, penalty: float = 1.0) -> np.ndarray:
    """Segment numbers by greedy splits while the best gain exceeds the penalty."""
    cuts = [0, len(r)]
    for _ in range(most):
        options = [(*best_split(r[i:j]), i) for i, j in zip(cuts, cuts[1:])]
        gain, at, lo = max(options, key=lambda o: o[0])
        if gain <= penalty or at < 0:
            break
        cuts = sorted([*cuts, lo + at])
    return np.searchsorted(cuts[1:-1], np.arange(len(r)), side="right")


def _per_symbol(returns: DataFrame, label, by: str = "symbol") -> DataFrame:
    """label(defined returns) per series; -1 at undefined ones."""
    picked = returns.select(by, "idx", "r")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        r = pdf["r"].to_numpy(float)
        ok = np.isfinite(r)
        out = np.full(len(r), -1, np.int32)
        if ok.any():
            out[ok] = label(r[ok])
        return pdf.assign(label=out)[[by, "idx", "r", "label"]]

    return picked.groupBy(by).applyInPandas(run, f"{by} string, idx long, r double, label int")


def gmm_regimes(returns: DataFrame, k: int = 3, rounds: int = 200) -> DataFrame:
    return _per_symbol(returns, lambda r: mixture(r, k, rounds).argmax(axis=1))


def hmm_regimes(returns: DataFrame, k: int = 3, rounds: int = 50) -> DataFrame:
    return _per_symbol(returns, lambda r: hidden_markov(r, k, rounds)[0])


def change_point_regimes(returns: DataFrame, most: int = 3, penalty: float = 1.0) -> DataFrame:
    return _per_symbol(returns, lambda r: change_points(r, most, penalty))


def first_split(returns: DataFrame, by: str = "symbol") -> DataFrame:
    """(symbol, place, gain) of the best single split, in windows alone."""
    w = Window.partitionBy(by).orderBy("idx")
    run, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    x = returns.where("r is not null").select(by, "idx", "r")
    x = x.withColumns({"i": F.row_number().over(w), "s": F.sum("r").over(run), "q": F.sum(F.col("r") * F.col("r")).over(run), "n": F.count(F.lit(1)).over(whole), "all_s": F.sum("r").over(whole), "all_q": F.sum(F.col("r") * F.col("r")).over(whole)})
    i, n = F.col("i"), F.col("n")
    x = x.where("i >= 2 and i <= n - 2")
    gain = (F.col("all_q") - F.col("all_s") ** 2 / n) - (F.col("q") - F.col("s") ** 2 / i) - (F.col("all_q") - F.col("q") - (F.col("all_s") - F.col("s")) ** 2 / (n - i))
    return x.select(by, "i", gain.alias("gain")).where("gain > 0").groupBy(by).agg(F.max_by("i", F.struct("gain", (-F.col("i")))).alias("place"), F.max("gain").alias("gain"))


def ensemble(labels: DataFrame, by: str = "symbol") -> DataFrame:
    """labels (symbol, idx, model, regime), one vote each: share per regime, the winner (ties: lower regime), and its share."""
    votes = labels.where("regime >= 0").groupBy(by, "idx", "regime").agg(F.count(F.lit(1)).alias("v"))
    per = votes.groupBy(by, "idx").agg(F.sum("v").alias("models"), F.max(F.struct(F.col("v"), (-F.col("regime")).alias("k"))).alias("best"), *[F.sum(F.when(F.col("regime") == k, F.col("v")).otherwise(0)).alias(f"v{k}") for k in range(4)])
    return per.select(by, "idx", (-F.col("best.k")).cast("int").alias("regime"), (F.col("best.v") / F.col("models")).alias("dominant"), *[(F.col(f"v{k}") / F.col("models")).alias(f"p{k}") for k in range(4)])


def ensemble_regimes(bars: DataFrame) -> DataFrame:
    """The vote of rules, mixture, hidden Markov states and segments, aligned on the bar's index."""
    f = regime_features(bars)
    r = f.select("symbol", "idx", "r")
    rule = rule_regimes(f).join(f.where("trend is not null").select("symbol", "idx"), ["symbol", "idx"]).select("symbol", "idx", F.lit("rule").alias("model"), F.col("label").alias("regime"))
    out = rule
    for name, labelled in (("gmm", gmm_regimes(r, 4)), ("hmm", hmm_regimes(r, 4, 20)), ("segments", change_point_regimes(r))):
        out = out.unionByName(map_states(labelled).select("symbol", "idx", F.lit(name).alias("model"), "regime"))
    return ensemble(out)


