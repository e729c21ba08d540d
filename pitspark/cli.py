"""Command line: data, backtest, run-experiment, validate, stress, regimes, volatility, report, graveyard, reproduce, sizing."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.columns import log_return, series
from .operators import audit, ledger, regimes, reports, signals, sizing, synthetic, volatility
from .plans import backtest as bt
from .sources import series as io

VERSION = "0.1.0"


def session() -> SparkSession:
    builder = SparkSession.builder.appName("pitspark")
    return (builder if SparkSession.getActiveSession() else builder.config("spark.sql.session.timeZone", "UTC")).getOrCreate()


def config_bars(spark: SparkSession, cfg: io.RunConfig):
    d = cfg.data
    if d.process == "pairs" or cfg.strategy == "pairs":
        return synthetic.generate(synthetic.specs(spark, ["PAIR"], "pairs", d.n_bars, d.seed))
    return synthetic.generate(synthetic.specs(spark, d.symbols, d.process, d.n_bars, d.seed))


def config_signals(bars, cfg: io.RunConfig):
    params = dict(cfg.strategy_params)
    if cfg.strategy == "pairs":
        params = {"first": "PAIR_A", "second": "PAIR_B", **params}
        s = signals.pairs(bars, **params)
        return s.join(bars.select("symbol", "ts", "idx"), ["symbol", "ts"]).select("symbol", "idx", "ts", "target_weight")
    return signals.create_strategy(cfg.strategy, **params)(bars)


def run_config(spark: SparkSession, cfg: io.RunConfig) -> dict:
    """Events, metrics and validation of one configuration as plain results."""
    bars = config_bars(spark, cfg).cache()
    runs = bt.runs_frame(spark, [{"run_id": cfg.name, "config": cfg.kernel()}])
    events = bt.backtest(bars, config_signals(bars, cfg), runs).cache()
    r = bt.run_returns(events)
    v = [x.asDict() for x in reports.validation_table(r).collect()]
    validation = io.json_safe(v[0]) if v else {}
    curve = [[x["ts"], x["equity"]] for x in bt.equity_curve(events).orderBy("bar_index").collect()]
    counts = {x["type"]: x["count"] for x in events.groupBy("type").count().collect()}
    ci = {"lo": validation.get("ci_lo"), "hi": validation.get("ci_hi")}
    names = ("sharpe", "sortino", "calmar", "omega", "annualized_return", "volatility", "max_drawdown", "hit_rate", "profit_factor", "total_return")
    pbo = reports.cheap_pbo([x["r"] for x in r.orderBy("idx").collect()])
    return io.json_safe({"metrics": {k: validation.get(k) for k in names}, "validation": {**validation, "pbo": pbo, "bootstrap95": ci, "bootstrap": {"ci95": ci}}, "counts": counts, "equity_curve": curve, "concerns": validation.get("concerns", []), "final_equity": curve[-1][1] if curve else cfg.initial_cash})


def show_all(df) -> None:
    """Prints every row as a line of JSON, a partition at a time."""
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(True), default=str))


def cmd_data(a) -> int:
    spark = session()
    if a.action == "generate-synthetic":
        io.write_series(synthetic.generate(synthetic.specs(spark, a.symbols.split(","), a.process, a.bars, a.seed)), a.path)
        return 0
    bars = io.read_series(spark, a.path)
    issues = audit.audit_bars(bars)
    show_all(issues.orderBy("symbol", "code", "idx") if a.action == "audit" else audit.score_quality(issues).orderBy("symbol"))
    return int(a.strict and not issues.where("severity = 'ERROR'").isEmpty())


def cmd_run(a) -> int:
    cfg = io.load_run_config(a.config)
    book = ledger.Ledger(a.ledger)
    record = book.create(cfg.name, cfg.strategy, {**cfg.to_dict(), "_environment": ledger.environment(seed=cfg.to_dict().get("seed"))})
    results = run_config(session(), cfg)
    book.complete(record["experiment_id"], results)
    io.write_results(Path(a.ledger) / record["experiment_id"] / "results.json", results)
    print(record["experiment_id"], json.dumps(results["metrics"]))
    return 0


def cmd_backtest(a) -> int:
    cfg = io.load_run_config(a.config) if a.config else io.RunConfig(strategy=a.strategy)
    print(json.dumps(run_config(session(), cfg)["metrics"], indent=2))
    return 0


def cmd_validate(a) -> int:
    record = ledger.Ledger(a.ledger).get(a.experiment)
    print(json.dumps((record.get("results") or {}).get("validation", {}), indent=2))
    return 0


def cmd_stress(a) -> int:
    spark, cfg = session(), io.RunConfig.from_dict(ledger.Ledger(a.ledger).get(a.experiment)["run_config"])
    bars = config_bars(spark, cfg).cache()
    base = cfg.kernel()
    runs = bt.runs_frame(spark, bt.cost_sweep(base) + bt.delay_sweep(base) + bt.slippage_sweep(base))
    results = bt.sweep_results(bt.backtest(bars, config_signals(bars, cfg), runs), runs).cache()
    show_all(results.orderBy("dimension", "size"))
    show_all(bt.degradation(results))
    show_all(bt.robustness(results))
    return 0


def _bars(a):
    spark = session()
    return io.read_series(spark, a.path) if a.path else synthetic.generate(synthetic.specs(spark, ["SYN"], a.process, a.bars, a.seed))


def _with_index(bars):
    from .sources.adapters import indexed

    return bars if "idx" in bars.columns else indexed(bars)


def cmd_regimes(a) -> int:
    show_all(regimes.ensemble_regimes(_with_index(_bars(a))).groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("bars"), F.avg("dominant").alias("consensus")))
    return 0


def cmd_volatility(a) -> int:
    bars = _with_index(_bars(a))
    r = bars.select("symbol", "idx", log_return(F.col("close"), series()).alias("r")).where("r is not null")
    show_all(volatility.benchmark_models(r))
    return 0


def cmd_report(a) -> int:
    from .views import Views

    text = Views(a.ledger).report(a.experiment)
    Path(a.out).write_text(text) if a.out else print(text)
    return 0


def cmd_graveyard(a) -> int:
    for e in ledger.graveyard(a.ledger).all()[-20:]:
        print(e["id"], e.get("status"), e.get("hypothesis"))
    return 0


def cmd_reproduce(a) -> int:
    record = ledger.Ledger(a.ledger).get(a.experiment)
    out = ledger.reproduce(record, lambda r: run_config(session(), io.RunConfig.from_dict(r["run_config"])))
    print(json.dumps({k: v for k, v in out.items() if k != "result"}, indent=2))
    return 0 if out.get("result_matches") else 1


def cmd_sizing(a) -> int:
    raw = a.p - (1 - a.p) / a.b
    print(json.dumps({"kelly": max(0.0, min(sizing.BELOW_ONE, raw))}))
    if a.simulate:
        sizing.policy_report(sizing.simulate_growth(session(), a.p, a.b, max(0.0, raw)), 1.0).show(truncate=False)
    return 0


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pitspark")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--strategies", action="store_true")
    p.add_argument("--ledger", default="experiments")
    sub = p.add_subparsers(dest="command")
    d = sub.add_parser("data")
    d.add_argument("action", choices=("generate-synthetic", "audit", "quality"))
    d.add_argument("path")
    d.add_argument("--strict", action="store_true", help="exit 1 on errors in the data")
    d.add_argument("--symbols", default="SYN")
    for x in (d, sub.add_parser("regimes"), sub.add_parser("volatility")):
        x.add_argument("--process", default="random_walk")
        x.add_argument("--bars", type=int, default=504)
        x.add_argument("--seed", type=int, default=7)
        if x is not d:
            x.add_argument("--path")
    b = sub.add_parser("backtest")
    b.add_argument("--config")
    b.add_argument("--strategy", default="sma_crossover")
    sub.add_parser("run-experiment").add_argument("config")
    for name in ("validate", "stress", "report", "reproduce"):
        x = sub.add_parser(name)
        x.add_argument("experiment")
        if name == "report":
            x.add_argument("--out")
    sub.add_parser("graveyard").add_argument("action", nargs="?", default="list", choices=("list",))
    s = sub.add_parser("sizing")
    s.add_argument("--p", type=float, default=0.55)
    s.add_argument("--b", type=float, default=1.0)
    s.add_argument("--simulate", action="store_true")
    return p


COMMANDS = {"data": cmd_data, "backtest": cmd_backtest, "run-experiment": cmd_run, "validate": cmd_validate, "stress": cmd_stress, "regimes": cmd_regimes, "volatility": cmd_volatility, "report": cmd_report, "graveyard": cmd_graveyard, "reproduce": cmd_reproduce, "sizing": cmd_sizing}


def main(argv: list[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    if a.strategies:
        print("\n".join(signals.list_strategies()))
        return 0
    if not a.command:
        build_parser().print_help()
        return 2
    return COMMANDS[a.command](a)


if __name__ == "__main__":
    sys.exit(main())
