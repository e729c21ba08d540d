import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitspark import cli
from pitspark.plans import kernel
from pitspark.streaming import ohlc, portfolio
from pitspark.views import Views

SF = "/root/testdata/sf0.001"


def test_stream_and_batch_bars_agree(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = entry.queries()["stream_ohlc"](spark, SF)
    batch = ohlc.ohlc(events)
    assert stream.exceptAll(batch.select(stream.columns)).count() == 0 and stream.count() == batch.count()


def test_stream_portfolio_is_the_batch_kernel(spark, tmp_path):
    n, day = 40, 86_400_000
    rows = [("r", "S", i * day, 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 1000.0, 0.5 if i % 10 == 0 else None) for i in range(n)]
    schema = "run_id string, symbol string, ts long, open double, high double, low double, close double, volume double, target_weight double"
    for k in range(4):  # four batches
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = portfolio.run_stream(stream).writeStream.format("memory").queryName("pf").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r["equity"] for r in spark.table("pf").where("type = 'PORTFOLIO'").orderBy("seq").collect()]
    series = {"S": [dict(zip(("ts", "open", "high", "low", "close", "volume"), r[2:8])) for r in rows]}
    want = [e["equity"] for e in kernel.run(kernel.Config(), series, {i: [("S", 0.5, "signal")] for i in range(0, n, 10)}) if e["type"] == "PORTFOLIO"]
    assert got == want


def test_every_registered_query_has_a_callable_and_oracles_are_registered():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150 and all(map(callable, q.values()))


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_command_line(spark, tmp_path, capsys):
    cfg = tmp_path / "run.json"
    cfg.write_text(json.dumps({"name": "demo", "strategy": "momentum", "data": {"process": "trend", "n_bars": 60}, "seed": 1}))
    base = ["--ledger", str(tmp_path / "book")]
    assert cli.main([*base, "run-experiment", str(cfg)]) == 0
    assert cli.main([*base, "validate", "EXP-0001"]) == 0
    assert cli.main([*base, "reproduce", "EXP-0001"]) == 0
    assert cli.main([*base, "report", "EXP-0001", "--out", str(tmp_path / "r.html")]) == 0
    assert "<svg" in (tmp_path / "r.html").read_text()
    assert cli.main([*base, "stress", "EXP-0001"]) == 0
    series = str(tmp_path / "series")
    assert cli.main(["data", "generate-synthetic", series, "--bars", "40"]) == 0
    assert cli.main(["data", "audit", series, "--strict"]) == 0
    assert cli.main(["--strategies"]) == 0 and cli.main([]) == 2
    assert cli.main(["sizing"]) == 0
    assert "EXP-0001" in capsys.readouterr().out
    v = Views(tmp_path / "book")
    assert v.overview() == {"n_experiments": 1, "status_breakdown": {"completed": 1}, "strategies": ["momentum"]} and v.health()["status"] == "ok"


def test_ohlc_of_batch_equals_adapter(spark):
    from pitspark.sources import adapters

    a = adapters.bars_daily_events(spark, SF).drop("idx")
    assert a.exceptAll(ohlc.ohlc(spark.read.parquet(f"{SF}/events.parquet")).select(a.columns)).count() == 0
    assert a.agg(F.count(F.lit(1)).alias("n")).first()["n"] == 150
