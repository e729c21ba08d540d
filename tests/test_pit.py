import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitspark.operators import audit, fingerprint, pit
from pitspark.plans import kernel

DAY = 86_400_000


def bars_frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, idx long, ts long, open double, high double, low double, close double, volume double, available_time long")


def late_rows(n=30, late=20, until=25):
    return [("S", i, i * DAY, 100.0 + i, 101.0 + i, 99.0 + i, 100.0 + i, 100.0, (until if i == late else i) * DAY) for i in range(n)]


def test_late_bar_stays_hidden(spark):
    got = {r["decision_index"]: r for r in pit.snapshot(bars_frame(spark, late_rows())).collect()}
    assert [got[i]["n_usable"] for i in range(20)] == list(range(1, 21))
    assert got[24]["n_usable"] == 24 and got[24]["last_close"] == 124.0
    assert got[20]["last_close"] == 119.0
    assert got[25]["n_usable"] == 26
    assert pit.audit_stream(bars_frame(spark, late_rows())).count() == 0


def test_visible_agrees_with_brute_force(spark):
    rng = random.Random(4)
    rows = [(s, i, i * DAY, 1.0, 1.0, 1.0, float(i), 1.0, (i + rng.choice([0, 0, 0, 2, 5])) * DAY) for s in "AB" for i in range(40)]
    b = bars_frame(spark, rows)
    got = {(r["symbol"], r["decision_index"]): (r["n_usable"], r["last_idx"]) for r in pit.snapshot(b).collect()}
    for s in "AB":
        mine = [r for r in rows if r[0] == s]
        for d in mine:
            seen = [r[1] for r in mine if r[1] <= d[1] and r[8] <= d[2]]
            assert got.get((s, d[1]), None) == (len(seen), max(seen) if seen else None)


def test_future_does_not_change_the_past(spark):
    rows = late_rows()
    changed = [(*r[:6], r[6] * 7 if r[1] > 15 else r[6], *r[7:]) for r in rows]
    a = pit.snapshot(bars_frame(spark, rows)).where("decision_index <= 15").orderBy("decision_index").collect()
    assert a == pit.snapshot(bars_frame(spark, changed).repartition(7)).where("decision_index <= 15").orderBy("decision_index").collect()


def test_callback_cannot_look_ahead():
    series = {"S": [{"ts": i * DAY, "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 0.0} for i in range(5)]}
    with pytest.raises(kernel.Lookahead):
        kernel.run(kernel.Config(), series, on_bar=lambda views, i: views["S"].closes(i + 1))
    seen = []
    kernel.run(kernel.Config(), series, on_bar=lambda views, i: seen.append(len(views["S"].closes())))
    assert seen == [1, 2, 3, 4, 5]


def test_corrupt_bars(spark):
    rows = [("S", i, i * DAY, 100.0 + i, 101.0 + i, 99.0 + i, 100.0 + i, 10.0, i * DAY) for i in range(50)]
    rows[10] = (*rows[10][:4], 50.0, *rows[10][5:])
    rows[20] = (*rows[20][:6], -1.0, *rows[20][7:])
    codes = {r["code"] for r in audit.audit_bars(bars_frame(spark, rows)).collect()}
    assert {"BAD_HIGH", "HIGH_LT_LOW", "NEGATIVE_PRICE", "BAD_LOW"} <= codes
    assert audit.score_quality(audit.audit_bars(bars_frame(spark, rows))).first()["score"] < 90


def test_stale_and_empty(spark):
    rows = [("S", i, i * DAY, 1.0, 1.0, 1.0, 1.0, 1.0, None) for i in range(7)]
    b = bars_frame(spark, rows)
    assert [r["message"] for r in audit.audit_bars(b).where("code = 'STALE_PRICE'").collect()] == ["6 consecutive unchanged closes"]
    assert audit.audit_bars(b.where("false")).count() == 0
    names = spark.createDataFrame([("S",), ("T",)], "symbol string")
    assert [r["symbol"] for r in audit.empty_series(names, b).collect()] == ["T"]


def test_missing_observations(spark):
    ts = [0, 1, 2, 3, 10, 11, 20]
    b = spark.createDataFrame([("S", t * DAY) for t in ts], "symbol string, ts long")
    assert audit.missing_observations(b).first()["big"] == 2


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0.5, 200), min_size=2, max_size=30), st.floats(-1, 1))
def test_cash_and_value_are_equity(prices, weight):
    series = {"S": [{"ts": i * DAY, "open": p, "high": p, "low": p, "close": p, "volume": 0.0} for i, p in enumerate(prices)]}
    events = kernel.run(kernel.Config(commission_bps=0, min_commission=0), series, {i: [("S", weight, "")] for i in range(len(prices))})
    held = 0.0
    for e in events:
        if e["type"] == "FILL":
            held += e["quantity"] if e["side"] == "BUY" else -e["quantity"]
        if e["type"] == "PORTFOLIO":
            assert np.isclose(e["equity"], e["cash"] + held * series["S"][e["bar_index"]]["close"], rtol=1e-9, atol=1e-6)


def test_fingerprint_changes_with_a_close(spark):
    rows = late_rows(10)
    a = fingerprint.fingerprint_bars(bars_frame(spark, rows)).first()["fingerprint"]
    b = fingerprint.fingerprint_bars(bars_frame(spark, [(*r[:6], r[6] + (r[1] == 3), *r[7:]) for r in rows])).first()["fingerprint"]
    assert len(a) == 64 and a != b
    assert a == fingerprint.fingerprint_bars(bars_frame(spark, rows[::-1]).repartition(3)).first()["fingerprint"]
    plain = [dict(zip(("symbol", "idx", "ts", "open", "high", "low", "close", "volume", "available_time"), r)) for r in rows]
    assert a == fingerprint.bars_digest(plain)


def test_quality_report_and_payloads(spark):
    rows = [("S", i, i * DAY, 1.0, 1.0, 1.0, 1.0 + i, 1.0, (i - (i == 2)) * DAY, 1.0 - (i == 3)) for i in range(6)] + [("T", i, i * DAY, 1.0, 1.0, 1.0, 1.0, 1.0, i * DAY, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "symbol string, idx long, ts long, open double, high double, low double, close double, volume double, available_time long, adjustment_factor double")
    got = {r["symbol"]: r for r in audit.report_quality(df).collect()}
    assert got["S"]["score"] == 30 and got["S"]["lookahead"] == "HIGH" and got["T"]["score"] == 100 and got["T"]["lookahead"] == "LOW" and got["T"]["n_rows"] == 4
    plain = [{"symbol": "S", "ts": 1, "close": 2.0}]
    assert fingerprint.fingerprint_payload(plain) == fingerprint.bars_digest(plain) != fingerprint.fingerprint_payload([{**plain[0], "adjustment_factor": 1.0}])
    assert fingerprint.fingerprint_payload({"b": 1, "a": 2}) == fingerprint.fingerprint_payload({"a": 2, "b": 1})


def test_dataset_digest_ignores_partitioning(spark):
    b = bars_frame(spark, late_rows(200, 20, 25))
    one = fingerprint.dataset_digest(b, ["symbol", "ts"], 16).first()
    assert one == fingerprint.dataset_digest(b.repartition(7), ["symbol", "ts"], 16).first() and one["n"] == 200
    assert one["digest"] != fingerprint.dataset_digest(b.where("idx < 199"), ["symbol", "ts"], 16).first()["digest"]
