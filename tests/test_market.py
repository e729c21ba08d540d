import dataclasses
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.functions.normal import cdf, ppf
from pitspark.operators import costs, cv, fingerprint, graveyard, indicators, ledger, metrics, news, overfit, regimes, reports, resample, signals, sizing, synthetic, volatility
from pitspark.plans import backtest as bt
from pitspark.plans import kernel
from pitspark.sources import series as io

DAY = 86_400_000


def returns_frame(spark, *series):
    return spark.createDataFrame([(f"s{k}", i, float(x)) for k, s in enumerate(series) for i, x in enumerate(s)], "symbol string, idx long, r double")


def close_frame(spark, closes, symbol="S"):
    rows = [(symbol, i, i * DAY, float(c), float(c) * 1.01, float(c) * 0.99, float(c), 1000.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, idx long, ts long, open double, high double, low double, close double, volume double")


def test_metrics_known_answers(spark):
    r = np.random.default_rng(0).normal(0.001, 0.01, 300)
    got = metrics.all_metrics(returns_frame(spark, r), ["symbol"]).first()
    e = np.cumprod(1 + r)
    assert math.isclose(got["sharpe"], r.mean() / r.std(ddof=1) * math.sqrt(252), rel_tol=1e-9)
    assert math.isclose(got["max_drawdown"], (1 - e / np.maximum.accumulate(e)).max(), rel_tol=1e-9)
    assert math.isclose(got["total_return"], e[-1] - 1, rel_tol=1e-9)
    assert math.isclose(got["omega"], r[r > 0].sum() / -r[r < 0].sum(), rel_tol=1e-9)


def test_metrics_edges(spark):
    got = {r["symbol"]: r for r in metrics.all_metrics(returns_frame(spark, [0.01, 0.01], [0.01, -0.02, 0.03], [0.0]), ["symbol"]).collect()}
    assert got["s0"]["sharpe"] == 0 and got["s0"]["sortino"] == math.inf and got["s0"]["profit_factor"] == math.inf
    assert got["s1"]["sortino"] is None  # one negative return
    assert got["s2"]["volatility"] == 0 and got["s2"]["hit_rate"] == 0


def test_normal():
    for p in (0.001, 0.3, 0.5, 0.99):
        assert math.isclose(cdf(ppf(p)), p, rel_tol=1e-12)
    with pytest.raises(ValueError):
        ppf(1.0)


def test_psr_at_own_sharpe_is_half(spark):
    r = np.random.default_rng(1).normal(0.001, 0.01, 400)
    m = overfit.moments(returns_frame(spark, r), ["symbol"]).first()
    assert math.isclose(overfit.psr(m["sr"], m["n"], m["psi"], m["sr"]), 0.5)
    one = overfit.sharpe_probabilities(returns_frame(spark, r), ["symbol"], trials=1).first()
    assert math.isclose(one["psr"], one["dsr"])
    assert overfit.expected_max_sharpe(1) == 0 and overfit.expected_max_sharpe(100) > overfit.expected_max_sharpe(10)


def test_pbo_of_a_dominant_strategy(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(0, 0.01, (240, 5))
    m[:, 2] += 0.01
    long = spark.createDataFrame([(t, c, float(m[t, c])) for t in range(240) for c in range(5)], "t long, config_id int, r double")
    got = overfit.pbo(long, 6).first()
    assert got["n_combinations"] == 20 and got["pbo"] <= 0.2
    with pytest.raises(ValueError):
        overfit.combinations(spark, 5)


def test_splits(spark):
    rows = cv.purged_cv(spark, 20, 4, 2, 1).collect()
    train = sorted(r["idx"] for r in rows if r["fold"] == 1 and r["role"] == "train")
    assert train == [0, 1, 2] + list(range(11, 20))
    assert cv.walk_forward(spark, 100, 50, 10).count() == 5
    assert cv.walk_forward(spark, 10, 50, 10).count() == 0
    assert cv.embargo_mask(spark, 10, 8, 5).where("keep").count() == 8


def test_indicators():
    x = np.arange(1.0, 40)
    assert np.allclose(indicators.rsi_path(x, 14)[14:], 100)
    assert np.isnan(indicators.rsi_path(x[:14], 14)).all()
    assert np.allclose(indicators.rsi_path(np.full(30, 5.0), 14)[14:], 50)
    assert indicators.ema_path(np.array([1.0, 2.0]), 3).tolist() == [1.0, 1.5]
    h, lo = x + 1, x - 1
    assert np.isnan(indicators.atr_path(h, lo, x, 5)[:4]).all() and np.isclose(indicators.atr_path(h, lo, x, 5)[-1], 2.0)


def test_signals_and_registry(spark):
    up = close_frame(spark, np.linspace(100, 200, 80))
    assert {r["target_weight"] for r in signals.create_strategy("sma_crossover", fast=5, slow=20)(up).collect()} == {1.0}
    assert signals.momentum(up).count() == 60
    assert len(signals.list_strategies()) == 9
    with pytest.raises(KeyError):
        signals.create_strategy("nothing")
    a = signals.random_signal(up, 7).orderBy("idx").collect()
    assert a == signals.random_signal(up.repartition(5), 7).orderBy("idx").collect()


def test_costs(spark):
    rows = spark.createDataFrame([("normal", 1e6), ("unheard", 1.0)], "profile string, notional double")
    c = costs.with_costs(rows).first()
    assert math.isclose(c["spread"], 2e-4) and math.isclose(c["impact"], 2e-4 * math.sqrt(0.1)) and math.isclose(c["commission"], 5e-4)
    assert costs.unknown_profiles(rows).count() == 1
    with pytest.raises(KeyError):
        costs.get_profile("unheard")


def play(closes, weights, **cfg):
    series = {"S": [{"ts": i * DAY, "open": c, "high": c, "low": c, "close": c, "volume": 0.0} for i, c in enumerate(closes)]}
    return kernel.run(kernel.Config(**cfg), series, {i: [("S", w, "")] for i, w in weights.items()})


def test_delay_one_fills_two_bars_later():
    fills = [e for e in play([100.0] * 6, {0: 1.0}) if e["type"] == "FILL"]
    assert [e["bar_index"] for e in fills] == [2]


def test_short_financing_and_commission():
    events = play([100.0] * 8, {0: -0.5}, borrow_rate_year=0.252)
    fill = next(e for e in events if e["type"] == "FILL")
    assert fill["side"] == "SELL"
    equity = [e["equity"] for e in events if e["type"] == "PORTFOLIO"]
    assert equity[-1] < equity[3] < 1e6
    literal = play([100.0] * 8, {0: -0.5}, semantics="reference")
    assert [e for e in literal if e["type"] == "PORTFOLIO"][-1]["cash"] < 1e6  # the tested code buys


def test_limits_and_unknown_symbols():
    with pytest.raises(ValueError):
        kernel.Config(execution_delay=0).validate()
    kernel.Config(execution_delay=0, allow_same_bar=True).validate()
    events = play([100.0] * 6, {0: 5.0})
    assert max(e["leverage"] for e in events if e["type"] == "PORTFOLIO") <= 1.0 + 2e-3
    series = {"S": [{"ts": 0, "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 1.0}]}
    assert [e["order_id"] for e in kernel.run(kernel.Config(), series, {0: [("X", 1.0, "")]}) if e["type"] == "REJECT"] == [-1]


def test_partial_fills_leave_a_rest():
    series = {"S": [{"ts": i * DAY, "open": 100.0, "high": 100.0, "low": 100.0, "close": 100.0, "volume": 10_000.0} for i in range(8)]}
    fills = [e for e in kernel.run(kernel.Config(), series, {0: [("S", 0.25, "")]}) if e["type"] == "FILL"]
    assert [round(e["quantity"]) for e in fills] == [1000, 1000, 500] and fills[0]["partial"]


def test_backtest_is_the_kernel_and_ignores_partitioning(spark):
    bars = close_frame(spark, 100 + np.sin(np.arange(60) / 5) * 10)
    sig = signals.momentum(bars, 5)
    runs = bt.runs_frame(spark, [{"run_id": "a"}, {"run_id": "b", "config": {"execution_delay": 2}}])
    one = bt.equity_curve(bt.backtest(bars, sig, runs)).orderBy("run_id", "bar_index").collect()
    assert one == bt.equity_curve(bt.backtest(bars.repartition(6), sig, runs)).orderBy("run_id", "bar_index").collect()
    assert len(one) == 120
    results = bt.sweep_results(bt.backtest(bars, sig, bt.runs_frame(spark, bt.cost_sweep() + bt.delay_sweep())), bt.runs_frame(spark, bt.cost_sweep() + bt.delay_sweep()))
    assert bt.degradation(results).count() == 2 and bt.robustness(results).first()["rating"] in ("ROBUST", "MODERATE", "FRAGILE")


def test_scaled_params():
    assert [p["n"] for p in bt.scaled_params({"n": 5, "x": 1.0, "b": True}, (0.5, 1.5))] == [2, 8]


def test_resampling_is_partition_free(spark):
    r = returns_frame(spark, np.random.default_rng(3).normal(0, 0.01, 120))
    a = resample.replicates(r, "symbol", 40, resample.block(10), seed=5, block_of=7).orderBy("replicate").collect()
    assert a == resample.replicates(r.repartition(5), "symbol", 40, resample.block(10), seed=5, block_of=20).orderBy("replicate").collect()
    null = resample.monte_carlo_null(r, "symbol", 50).first()
    assert null["std"] < 1e-9  # permutations leave the Sharpe ratio as it is


def test_regimes(spark):
    rng = np.random.default_rng(1)
    r = np.concatenate([rng.normal(0.001, 0.005, 250), rng.normal(-0.001, 0.02, 250)])
    assert np.allclose(regimes.mixture(r, 2).sum(axis=1), 1)
    states, post = regimes.hidden_markov(r, 2)
    assert (states[:200] == np.bincount(states[:200]).argmax()).mean() > 0.9 and np.allclose(post.sum(axis=1), 1)
    shift = np.concatenate([np.zeros(50), np.ones(50)])
    assert regimes.best_split(shift)[1] == 50 and set(regimes.change_points(shift)) == {0, 1}
    got = regimes.first_split(returns_frame(spark, shift)).first()
    assert got["place"] == 50
    e = regimes.ensemble_regimes(close_frame(spark, 100 * np.exp(np.cumsum(r)))).collect()
    assert len(e) == 500 - 1 and all(abs(sum(x[f"p{k}"] for k in range(4)) - 1) < 1e-9 for x in e)


def test_garch_finds_its_parameters():
    rng = np.random.default_rng(5)
    r, var = np.empty(3000), 1e-4
    for t in range(3000):
        r[t] = math.sqrt(var) * rng.standard_normal()
        var = 5e-6 + 0.1 * r[t] ** 2 + 0.85 * var
    for model in volatility.FAMILIES:
        p, ll, v = volatility.fit(r, model)
        f = volatility.FAMILIES[model]
        assert ll >= volatility.loglik(r, f.recursion(np.array(f.start((r * r).mean())), r)) and (v > 0).all()
    p, *_ = volatility.fit(r, "GARCH")
    assert abs(p[1] - 0.1) < 0.05 and abs(p[2] - 0.85) < 0.1


def test_sizing(spark):
    k = spark.range(1).select(sizing.kelly_fraction(F.lit(0.55), F.lit(1.0)).alias("k"), sizing.kelly_fraction(F.lit(0.4), F.lit(1.0)).alias("z")).first()
    assert math.isclose(k["k"], 0.1) and k["z"] == 0
    flips = returns_frame(spark, [1.0] * 60 + [-1.0] * 40)
    assert abs(sizing.optimal_f(flips, ["symbol"]).first()["f"] - 0.2) < 0.01
    rng = np.random.default_rng(0)
    panel = spark.createDataFrame([(t, a, float(rng.normal(0, s))) for t in range(300) for a, s in (("x", 0.01), ("y", 0.03))], "t long, asset string, r double")
    w = {r["asset"]: r["weight"] for r in sizing.risk_parity(panel).collect()}
    assert w["x"] > w["y"] and math.isclose(sum(w.values()), 1.5)
    c = {r["asset"]: r["weight"] for r in sizing.cvar_weights(panel, 0.05).collect()}
    assert math.isclose(sum(c.values()), 1.0)
    assert sizing.corrupted_edge(spark, 0.55, 1.0, 0.1, paths=50, periods=50).count() == 5


def test_event_study(spark):
    bars = close_frame(spark, [100, 101, 102, 103, 104, 105, 106])
    events = spark.createDataFrame([("S", i) for i in (0, 1, 5, 6)], "symbol string, idx long")
    got = {r["horizon"]: r for r in news.event_study(bars, events, (1, 3)).collect()}
    assert got[1]["n"] == 2 and math.isclose(got[1]["mean"], (102 / 101 + 103 / 102) / 2 - 1)
    spike = close_frame(spark, [100, 110, 110, 110, 110])
    flags = news.compare_leakage(spike, spark.createDataFrame([("S", 0)], "symbol string, idx long"), (1,)).first()
    assert flags["verdict"] == "LEAKAGE_SUSPICIOUS"


def test_timeline_skips_after_a_failed_field(spark):
    items = spark.createDataFrame([(1, 100, 90, 80, 150, 2.0), (2, 100, 120, 140, 150, 0.0), (3, 100, 120, 110, 105, None)], "id int, event_time long, publication_time long, retrieval_time long, decision_time long, sentiment double")
    got = sorted((r["id"], r["field"]) for r in news.timeline_violations(items, ["id"]).collect())
    assert got == [(1, "publication_time"), (1, "sentiment"), (3, "retrieval_time")]


def test_graveyard_and_status(spark):
    e = spark.createDataFrame([(0.4, 0.1, 300), (0.9, 0.1, 100), (None, None, None)], "dsr double, pbo double, n_obs int")
    got = [(r["categories"], r["status"]) for r in graveyard.postmortems(e).collect()]
    assert got == [(["overfit"], "REJECTED"), (["insufficient_sample"], "INCONCLUSIVE"), ([], "REJECTED")]
    v = spark.createDataFrame([(0.9, 0.9, 0.1, False, 0.1, 0.2), (0.9, 0.2, 0.1, False, 0.1, 0.2), (None, None, None, None, None, None), (0.9, 0.9, 0.1, False, -0.1, 0.2)], "psr double, dsr double, pbo double, regime_dependency boolean, ci_lo double, ci_hi double")
    assert [r["status"] for r in graveyard.classify_validation(v).collect()] == ["SURVIVED_BATTERY", "REJECTED", "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE"]


def test_hidden_markov_recovers_a_simulated_chain():
    rng = np.random.default_rng(5)
    step, state, truth = np.array([[0.97, 0.03], [0.06, 0.94]]), 0, []
    for _ in range(4000):
        state = int(rng.random() < step[state, 1])
        truth.append(state)
    truth = np.array(truth)
    r = np.where(truth == 0, rng.normal(0.0005, 0.006, 4000), rng.normal(-0.001, 0.02, 4000))
    chain = regimes.Chain(*regimes._quantile_states(r, 2))
    likelihoods = [chain.improve(r) for _ in range(60)]
    assert all(b >= a - 1e-6 for a, b in zip(likelihoods, likelihoods[1:]))
    calm, wild = np.argsort(chain.spread)
    assert abs(np.sqrt(chain.spread[calm]) - 0.006) < 5e-4 and abs(np.sqrt(chain.spread[wild]) - 0.02) < 2e-3
    assert abs(np.exp(chain.step[calm, wild]) - 0.03) < 0.015 and abs(np.exp(chain.step[wild, calm]) - 0.06) < 0.03
    states, post = regimes.hidden_markov(r, 2)
    assert ((states == wild) == (truth == 1)).mean() > 0.9 and (post.argmax(axis=1) == np.where(truth == 1, wild, calm)).mean() > 0.93
    both = regimes.mixture(np.concatenate([rng.normal(0, 0.5, 900), rng.normal(8, 1, 300)]), 2)
    assert sorted(np.bincount(both.argmax(axis=1), minlength=2).tolist()) in ([300, 900], [299, 901], [301, 899])
    assert regimes.hidden_markov(np.array([0.1]), 3)[0].tolist() == [0] and regimes.mixture(np.zeros(5), 3).shape == (5, 3)


def test_ledger_round_trip(spark, tmp_path):
    book = ledger.Ledger(tmp_path)
    a = book.create("one", "momentum", {"seed": 1})
    book.create("two", "pairs")
    book.complete(a["experiment_id"], {"x": 1})
    with book.path.open("a") as f:
        f.write("broken\n")
    again = ledger.Ledger(tmp_path)
    assert again.create("three", "pairs")["experiment_id"] == "EXP-0003" and again.count() == 3
    assert again.get("EXP-0001")["status"] == "completed" and len(again.search(strategy_name="pairs")) == 2
    same = ledger.reproduce(again.get("EXP-0001"), lambda r: {"x": 1})
    assert same["result_matches"] and same["environment_matches"] and not same["differences"]
    other = ledger.reproduce({**again.get("EXP-0001"), "run_config": {"_environment": {"python": "2.7", "seed": 3, "packages": {"numpy": "1"}}}}, lambda r: {"x": 2})
    assert not other["result_matches"] and {d["field"] for d in other["differences"]} >= {"python", "seed", "packages.numpy"} and len(other["warnings"]) == len(other["differences"])
    env = ledger.environment(dataset_hash="abc", seed=7)
    assert env["dataset_hash"] == "abc" and env["seed"] == 7 and env["packages"]["pyspark"]
    named = ledger.scaffold(again, "momentum", "four")
    assert again.get(named["experiment_id"])["run_config"]["_environment"]["python"] == env["python"]
    assert ledger.default_ledger(tmp_path) is ledger.default_ledger(tmp_path)
    assert {r["status"]: r["n"] for r in ledger.overview(ledger.read(spark, f"file://{book.path}")).collect()} == {"completed": 1, "created": 3}
    grave = ledger.graveyard(tmp_path)
    assert ledger.record_entry(grave, {"hypothesis": "h"})["id"] == "STRATEGY-00001"


def test_series_files(spark, tmp_path):
    bars = synthetic.generate(synthetic.specs(spark, ["A", "B"], "jump", 30))
    io.write_series(bars, str(tmp_path / "s"))
    back = io.read_series(spark, str(tmp_path / "s" / "*.txt"))
    assert back.count() == 60 and {r["source"] for r in back.select("source").distinct().collect()} == {"synthetic"}
    cfg = io.RunConfig(name="x", strategy="pairs", data=io.DataConfig(n_bars=7))
    for name in ("c.yaml", "c.json"):
        io.dump_run_config(cfg, tmp_path / name)
        assert io.load_run_config(tmp_path / name) == cfg


def test_synthetic_is_deterministic(spark):
    for p in synthetic.PROCESSES:
        c = synthetic.closes(p, 100, 3)
        assert (c == synthetic.closes(p, 100, 3)).all() and (c > 0).all() and c[0] == 100
    b = synthetic.bars_of("S", synthetic.closes("trend", 50, 1))
    assert (b["high"] >= b[["open", "close"]].max(axis=1)).all() and (b["low"] <= b[["open", "close"]].min(axis=1)).all()


def test_html_is_escaped_and_stable():
    record = reports.report_record({"name": "<b>"}, [], [(0, 1.0), (1, 2.0)], {"FILL": 1}, {"sharpe": math.inf, "status": "REJECTED", "concerns": ["a < b"]})
    page = reports.render_html(record)
    assert "<b>" not in page.replace("<b>REJECTED</b>", "") and "a &lt; b" in page and page == reports.render_html(record)
    assert '"sharpe": null' in reports.render_json(record)
    assert reports.cheap_pbo([0.01] * 3) is None and 0 <= reports.cheap_pbo(np.random.default_rng(0).normal(0, 1, 60).tolist()) <= 1


def test_volatility_benchmark_is_registered_with_every_model(spark, monkeypatch):
    from pitspark import catalog

    asked = []
    monkeypatch.setattr(volatility, "benchmark_models", lambda returns, models=volatility.MODELS, **settings: asked.append(models) or returns)
    catalog.QUERIES["vol_benchmark"](spark, "/root/testdata/sf0.001")
    assert asked == [volatility.MODELS] and len(volatility.MODELS) == 7


def test_resampling_queries_are_registered_with_the_reference_draws(spark, monkeypatch):
    from pitspark import catalog

    asked = {}
    for module, name, place in ((sizing, "edge_uncertainty_kelly", 2), (reports, "validation_table", 2), (resample, "shuffle_pvalue", 2), (resample, "monte_carlo_null", 2), (resample, "monte_carlo_paths", 3)):
        monkeypatch.setattr(module, name, lambda *a, name=name, place=place, **k: asked.update({name: a[place]}) or spark.createDataFrame([], "path int, r double, concerns string"))
    monkeypatch.setattr(resample, "bootstrap_sharpe", lambda r, by, n, *a: asked.update({("iid", "block")[len(a)]: n}))
    monkeypatch.setattr(resample, "replicates", lambda r, by, n, *a: asked.update(stationary=n))
    monkeypatch.setattr(resample, "confidence_interval", lambda *a: None)
    monkeypatch.setattr(sizing, "corrupted_edge", lambda *a, paths, periods: asked.update(corrupted_edge=(paths, periods)))
    for q in ("edge_uncertainty", "validation_report", "shuffle_null", "monte_carlo_null", "mc_paths", "bootstrap_iid", "bootstrap_block", "bootstrap_stationary", "corrupted_edge"):
        catalog.QUERIES[q](spark, "/root/testdata/sf0.001")
    assert asked == {"edge_uncertainty_kelly": 300, "validation_table": 300, "shuffle_pvalue": 500, "monte_carlo_null": 500, "monte_carlo_paths": 1000, "iid": 1000, "block": 1000, "stationary": 1000, "corrupted_edge": (500, 500)}


def bar(o, h, l, c, v=1e9):
    return {"open": o, "high": h, "low": l, "close": c, "volume": v}


def test_limit_and_stop_orders_rest_until_their_price():
    rows = [{"ts": 86_400_000 * i, **b} for i, b in enumerate([bar(100, 100, 100, 100), bar(100, 100, 100, 100), bar(100, 101, 99, 100), bar(100, 106, 94, 100), bar(90, 91, 89, 90), bar(120, 121, 119, 120)])]
    cfg = kernel.Config(profile="optimistic", commission_bps=10.0, min_commission=0.0, max_position_weight=5.0, max_leverage=5.0)
    run = lambda weight, **terms: [e for e in kernel.run(cfg, {"A": rows}, {0: [("A", weight, "x", terms)]}) if e["type"] in ("ORDER", "FILL")]
    order, fill = run(0.5, kind="LIMIT", limit=95.0)
    assert (order["kind"], order["limit_price"], order["eligible_from"]) == ("LIMIT", 95.0, 2) and fill["bar_index"] == 4 and fill["price"] <= 95.0
    _, fill = run(0.5, kind="STOP", stop=105.0)
    assert fill["bar_index"] == 3 and fill["price"] == 105.0
    _, fill = run(-0.5, kind="STOP", stop=95.0)
    assert fill["bar_index"] == 3 and fill["price"] == 95.0
    assert len(run(0.5, kind="LIMIT", limit=50.0)) == 1
    ref = dataclasses.replace(cfg, semantics="reference", max_position_weight=0.1)
    events = kernel.run(ref, {"A": rows}, {0: [("A", 0.5, "x")]})
    fill = next(e for e in events if e["type"] == "FILL")
    assert fill["quantity"] < fill["requested"] and abs(fill["commission"] - fill["requested"] * fill["price"] * 1e-3) < 1e-6  # billed as offered
    portfolio = [e for e in events if e["type"] == "PORTFOLIO"][-1]
    assert json.loads(portfolio["positions"])["A"] == fill["quantity"]


def test_visible_honours_zero_and_advances_to_the_end():
    seen = kernel.Visible([{"ts": 5, "close": 1.0, "available_time": 0}, {"ts": 6, "close": 2.0, "available_time": 9}, {"ts": 9, "close": 3.0}])
    assert [seen.advance() for _ in range(3)] == [0, 1, 2] and seen.total == 3
    assert seen.closes(0) == [1.0] and seen.closes(1) == [1.0] and seen.closes(2) == [1.0, 2.0, 3.0]
    with pytest.raises(IndexError):
        seen.advance()


def test_orders_with_terms_in_a_spark_backtest(spark):
    rows = [("A", i, 86_400_000 * i, 100.0, 100.0 + i, 100.0 - i, 100.0, 1e9) for i in range(8)]
    bars = spark.createDataFrame(rows, "symbol string, idx long, ts long, open double, high double, low double, close double, volume double")
    signals_ = spark.createDataFrame([("A", 0, 0.5, "STOP", None, 105.0)], "symbol string, idx long, target_weight double, kind string, limit_price double, stop_price double")
    runs = bt.runs_frame(spark, [{"run_id": f"r{k}", "start": 0} for k in range(3)])
    got = bt.fills(bt.backtest(bars, signals_, runs, lanes=2)).collect()
    assert [(r["run_id"], r["bar_index"], r["price"]) for r in sorted(got)] == [(f"r{k}", 5, 105.0) for k in range(3)]


def test_dataset_digest_counts_rows_and_forgets_their_order(spark):
    rows = [(i % 7, str(i % 5), None if i % 3 else i / 3) for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b string, c double")
    one = fingerprint.dataset_digest(df).first()
    assert one == fingerprint.dataset_digest(df.repartition(7).orderBy("c")).first() and one["n"] == 300
    assert one != fingerprint.dataset_digest(df.union(df.limit(1))).first()
    assert fingerprint.dataset_digest(df.where("false")).first()["n"] == 0


def test_block_bootstrap_of_a_short_series_is_undefined(spark):
    r = returns_frame(spark, np.array([0.01, 0.02, -0.01]))
    assert {x["value"] for x in resample.replicates(r, "symbol", 5, resample.block(10)).collect()} == {None}
