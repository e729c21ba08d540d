"""The backtest kernel as a stateful stream operator: bars with target weights in, portfolio events out, one engine per run."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import kernel
from ..plans.backtest import event_frame
from ..schema import EVENT

def run_stream(bars: DataFrame, config: kernel.Config | None = None) -> DataFrame:
    """bars: a stream of (run_id, symbol, ts, open, high, low, close, volume, target_weight), each ts complete within a batch and batches in order of ts.

    The state (cash, positions, pending orders) is the kernel's own engine, so a stream gives the events of the batch run.
    """
    cfg = config or kernel.Config()

    def play(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        engine, seq = pickle.loads(state.get[0]) if state.exists else (kernel.Engine(cfg), 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "symbol"])
        out = []
        for ts, now in rows.groupby("ts", sort=True):
            quotes = {r.symbol: (r.open, r.high, r.low, r.close, r.volume) for r in now.itertuples()}
            wanted = [(r.symbol, r.target_weight, "signal") for r in now.itertuples() if r.target_weight == r.target_weight and r.target_weight is not None]
            for e in engine.step(int(ts), quotes, lambda i: wanted):
                out.append({**e, "bar_index": engine.i, "run_id": key[0], "seq": seq})
                seq += 1
        state.update((pickle.dumps((engine, seq)),))
        yield event_frame(out)

    return bars.groupBy("run_id").applyInPandasWithState(play, EVENT, "engine binary", "append", GroupStateTimeout.NoTimeout)
