"""Series JSON, run configurations and result files."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BAR = "struct<ts: bigint, open: double, high: double, low: double, close: double, volume: double, available_time: bigint, interval_seconds: int, source: string, source_version: string>"


def _bars(exploded: DataFrame) -> DataFrame:
    return exploded.select(
        "symbol", "bar.ts", F.coalesce("bar.interval_seconds", "interval_seconds", F.lit(86400)).alias("interval_seconds"), "bar.open", "bar.high", "bar.low", "bar.close",
        F.coalesce("bar.volume", F.lit(0.0)).alias("volume"), "bar.available_time", F.coalesce("bar.source", "source", F.lit("file")).alias("source"), F.coalesce("bar.source_version", F.lit("")).alias("source_version"),
    )


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Files of one object per symbol: {symbol, interval_seconds, bars: [...], source}."""
    docs = spark.read.schema(f"symbol string, interval_seconds int, source string, bars array<{_BAR}>").option("multiLine", True).json(path)
    return _bars(docs.select("symbol", "interval_seconds", "source", F.explode("bars").alias("bar")))


def read_rows(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Files of a bare array of rows; the caller names the symbol."""
    fields = _BAR.removeprefix("struct<").removesuffix(">")
    rows = spark.read.schema(fields).option("multiLine", True).json(path)
    return _bars(rows.select(F.lit(symbol).alias("symbol"), F.lit(None).cast("int").alias("interval_seconds"), F.lit(None).cast("string").alias("source"), F.struct("*").alias("bar")))


def write_series(bars: DataFrame, path: str, source: str = "synthetic") -> None:
    """One JSON object per symbol, each in a file of its own; a series is one row, as the format has it."""
    have = lambda c, d: F.col(c) if c in bars.columns else F.lit(d)
    bar = F.struct("ts", "open", "high", "low", "close", "volume", have("available_time", None).cast("bigint").alias("available_time"))
    docs = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(bar)).alias("bars"), F.first(have("interval_seconds", 86400).cast("int")).alias("interval_seconds"))
    docs.select(F.to_json(F.struct("symbol", "interval_seconds", F.lit(source).alias("source"), "bars")).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


@dataclass
class DataConfig:
    symbols: list[str] = field(default_factory=lambda: ["SYN"])
    process: str = "random_walk"
    n_bars: int = 504
    seed: int = 7
    source: str = "synthetic"


@dataclass
class RunConfig:
    name: str = "untitled"
    strategy: str = "sma_crossover"
    strategy_params: dict = field(default_factory=dict)
    data: DataConfig = field(default_factory=DataConfig)
    initial_cash: float = 1_000_000.0
    execution_delay: int = 1
    execution_mode: str = "next_open"
    profile: str = "normal"
    max_leverage: float = 2.0
    max_position_weight: float = 1.0
    rebalance_tolerance: float = 0.005
    commission_bps: float = 5.0
    participation_cap: float = 0.10
    borrow_rate_year: float = 0.0
    seed: int = 0
    notes: str = ""

    def kernel(self) -> dict:
        """The settings that the backtest kernel takes."""
        names = ("initial_cash", "execution_delay", "execution_mode", "profile", "max_leverage", "max_position_weight", "rebalance_tolerance", "commission_bps", "participation_cap", "borrow_rate_year")
        return {k: getattr(self, k) for k in names}

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, raw: dict) -> "RunConfig":
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        if isinstance(known.get("data"), dict):
            known["data"] = DataConfig(**{k: v for k, v in known["data"].items() if k in DataConfig.__dataclass_fields__})
        return cls(**known)


def load_run_config(path: str | Path) -> RunConfig:
    """YAML by suffix, else JSON; every field has a default."""
    import yaml

    text = Path(path).read_text()
    return RunConfig.from_dict((yaml.safe_load(text) if Path(path).suffix in (".yaml", ".yml") else json.loads(text)) or {})


def dump_run_config(cfg: RunConfig, path: str | Path) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump(cfg.to_dict(), sort_keys=False) if Path(path).suffix in (".yaml", ".yml") else json.dumps(cfg.to_dict(), indent=2))


def write_results(path: str | Path, results: dict) -> None:
    """Pretty JSON; NaN and infinity become null."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(json_safe(results), indent=2))


def json_safe(v):
    if isinstance(v, dict):
        return {k: json_safe(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [json_safe(x) for x in v]
    if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        return None
    return v
