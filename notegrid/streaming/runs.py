"""Anchored runs (WIN-3) over a stream: a run is emitted when the next begins.
Rows of a key must arrive in order of time; late rows join the open run's end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

OUT = "user_id long, i0 long, i1 long, n int"
STATE = "i0 long, i1 long, anchor double, last double, n int"


def anchored_runs_stream(events: DataFrame, step: float, drift: float) -> DataFrame:
    """Closed runs of each user; the state is one open run."""

    def advance(key, frames, state):
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        run = list(state.get) if state.exists else None
        done = []
        for i, v in zip(rows["event_id"].tolist(), rows["value"].tolist()):
            if run and abs(v - run[3]) < step and abs(v - run[2]) < drift:
                run[1], run[3], run[4] = i, v, run[4] + 1
            else:
                if run:
                    done.append((key[0], run[0], run[1], run[4]))
                run = [i, i, v, v, 1]
        state.update(tuple(run))
        yield pd.DataFrame(done, columns=["user_id", "i0", "i1", "n"])

    return events.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
