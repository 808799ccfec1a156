"""Clarification sessions as a stream: each event moves its session's state, kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesselar.operators import sessions

OUTPUT = "session string, seq long, event string, state string, turn_count int, refused string"
STATE = "state string, turn_count int, last_seq long"


def follow(events: DataFrame, key: str, seq: str, kind: str, initial: str = sessions.NONE) -> DataFrame:
    """A row for each event (session, seq, event) with the session's state after it, and why it was refused, if it was.

    events: a stream. Events of a session in one batch are taken by seq; an event at or before the last one taken is a
    repeat, and has no effect. State is a few values for each session.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, turns, last = state.get if state.exists else (initial, 0, -1)
        rows = []
        got = pd.concat(list(batches)).sort_values(seq, kind="stable")
        for n, event in zip(got[seq].tolist(), got[kind].tolist(), strict=True):
            if n <= last:
                continue
            now, why = sessions.next_state(now, event)
            turns += why is None and event in sessions.TURNS
            last = n
            rows.append((str(keys[0]), int(n), event, now, int(turns), why))
        state.update((now, int(turns), int(last)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return events.groupBy(key).applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
