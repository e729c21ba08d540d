"""Reports: JSON and HTML renderers over few, collected rows, and the validation battery as tables."""

from __future__ import annotations

import html
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.series import json_safe
from . import graveyard, metrics, overfit, resample


def validation_table(returns: DataFrame, by: str = "run_id", replicates: int = 300, trials: int = 1, seed: int = 0) -> DataFrame:
    """One row per run: metrics, psr, dsr, bootstrap interval of the Sharpe ratio, concerns and status; runs of under 20 returns have a note alone."""
    m = metrics.all_metrics(returns, [by])
    p = overfit.sharpe_probabilities(returns, [by], trials).select(by, "n", "psr", "dsr")
    ci = resample.bootstrap_sharpe(returns, by, replicates, seed=seed).select(by, F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"))
    j = m.join(p, by).join(ci, by, "left").withColumns({"pbo": F.lit(None).cast("double"), "regime_dependency": F.lit(False)})
    short = F.col("n") < 20
    for c in ("psr", "dsr", "ci_lo", "ci_hi"):
        j = j.withColumn(c, F.when(~short, F.col(c)))
    return graveyard.classify_validation(j).withColumn("note", F.when(short, "fewer than 20 returns: no validation"))


def cheap_pbo(returns: list[float], trials: int = 16, blocks: int = 6, seed: int = 42) -> float | None:
    """PBO of a series among shuffled copies of itself; None under six returns. One short series, in memory."""
    r = np.asarray(returns, float)
    if len(r) < blocks:
        return None
    rng = np.random.default_rng(seed)
    m = np.column_stack([r, *(rng.permutation(r) for _ in range(max(2, min(16, trials)) - 1))])
    parts = np.split(m[: len(r) // blocks * blocks], blocks)
    logits = []
    for mask in range(1 << blocks):
        if mask.bit_count() == blocks // 2:
            score = lambda keep: _sharpes(np.concatenate([p for k, p in enumerate(parts) if (mask >> k & 1) == keep]))
            ins, oos = score(1), score(0)
            rank = 1 + int((oos > oos[int(ins.argmax())]).sum())
            logits.append(np.log((m.shape[1] - rank + 1) / rank))
    return float(np.mean(np.array(logits) < 0))


def _sharpes(m: np.ndarray) -> np.ndarray:
    sd = m.std(axis=0, ddof=1) if len(m) > 1 else np.zeros(m.shape[1])
    return np.where(sd > 1e-15, m.mean(axis=0) / np.where(sd > 1e-15, sd, 1), 0.0)


def report_record(run: dict, returns: list[float], equity: list[tuple[int, float]], counts: dict[str, int], validation: dict) -> dict:
    """What both renderers show."""
    return json_safe({"run": run, "n_returns": len(returns), "metrics": {k: validation.get(k) for k in metrics.metric_columns() if k in validation} if validation else {}, "counts": counts, "equity_curve": [[t, v] for t, v in equity], "validation": validation, "status": validation.get("status", "INSUFFICIENT_EVIDENCE"), "concerns": validation.get("concerns", [])})


def render_json(record: dict) -> str:
    return json.dumps(record, indent=2, sort_keys=True)


def _chart(points: list[list[float]], width: int = 640, height: int = 180) -> str:
    values = [v for _, v in points if v is not None]
    if len(values) < 2:
        return "<p>no equity curve</p>"
    lo, hi = min(values), max(values)
    at = " ".join(f"{i * width / (len(values) - 1):.1f},{height - (v - lo) / ((hi - lo) or 1) * height:.1f}" for i, v in enumerate(values))
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}" role="img" aria-label="equity curve"><polyline fill="none" stroke="#1f4e79" points="{at}"/></svg>'


def _table(rows: list[tuple], head: tuple[str, ...]) -> str:
    cell = lambda v: html.escape(f"{v:.4f}" if isinstance(v, float) else "n/a" if v is None else str(v))
    top = "".join(f"<th>{html.escape(h)}</th>" for h in head)
    return f"<table><tr>{top}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"


def render_html(record: dict, title: str = "Experiment report") -> str:
    """One page without scripts; equal records give equal bytes; all text is escaped."""
    parts = [
        f"<h1>{html.escape(title)}</h1><p>Status: <b>{html.escape(record['status'])}</b></p>",
        _chart(record["equity_curve"]),
        _table(sorted(record["metrics"].items()), ("metric", "value")),
        _table(sorted(record["counts"].items()), ("event", "count")),
        "<ul>" + "".join(f"<li>{html.escape(c)}</li>" for c in record["concerns"]) + "</ul>",
        _table(sorted((k, json.dumps(v) if isinstance(v, (dict, list)) else v) for k, v in record["run"].items()), ("setting", "value")),
    ]
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>{"".join(parts)}</body></html>'


def render_graveyard(entries: list[dict]) -> str:
    rows = [(e.get("id"), e.get("hypothesis"), ", ".join(e.get("categories") or []), e.get("primary_failure"), e.get("status")) for e in entries]
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Graveyard</title></head><body><h1>Graveyard</h1>{_table(rows, ("id", "hypothesis", "categories", "primary failure", "status"))}</body></html>'
