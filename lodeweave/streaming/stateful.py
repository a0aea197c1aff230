"""Stateful streams: session roll-over, the token-capacity cache, the circuit breaker.

Each keeps a bounded state per key; the batch forms in ``operators.sequences`` give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rollover_stream(turns: DataFrame, every: int = 20, keep: int = 5) -> DataFrame:
    """(session_id, turn_no) of each turn at which a session is summarised: stored rows reach a multiple of ``every``, then ``keep`` stay.

    ``turns``: session_id, id. State: rows stored and turns seen.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, seen = state.get if state.exists else (0, 0)
        fired = []
        for frame in frames:
            for _ in range(len(frame)):
                rows, seen = rows + 1, seen + 1
                if rows % every == 0:
                    fired.append(seen)
                    rows = min(rows, keep)
        state.update((rows, seen))
        yield pd.DataFrame({"session_id": [key[0]] * len(fired), "turn_no": fired})

    kind = turns.schema["session_id"].dataType.simpleString()
    return turns.groupBy("session_id").applyInPandasWithState(step, f"session_id {kind}, turn_no bigint", "rows bigint, seen bigint", "append", GroupStateTimeout.NoTimeout)


class Pager:
    """A first-in first-out cache of items up to a token capacity; what leaves it goes to cold storage, a read brings it back."""

    def __init__(self, capacity: int, hot: list[list], cold: dict[str, int]):
        self.capacity, self.hot, self.cold = capacity, hot, cold

    def add(self, item: str, tokens: int) -> list[str]:
        """The items that went cold."""
        if tokens > self.capacity:
            self.cold[item] = tokens
            return [item]
        out = []
        while self.hot and sum(t for _, t in self.hot) + tokens > self.capacity:
            left, n = self.hot.pop(0)
            self.cold[left] = n
            out.append(left)
        self.hot.append([item, tokens])
        return out

    def read(self, item: str) -> tuple[bool, list[str]]:
        if item not in self.cold:
            return False, []
        return True, self.add(item, self.cold.pop(item))


def pager_stream(ops: DataFrame, capacity: int) -> DataFrame:
    """(cache, ord, item, event) for a stream of (cache, ord, op, item, tokens): 'cold' when an item leaves, 'hit' or 'miss' for a read.

    Operations of a micro-batch run in the order of ``ord``. State: the two lists of a cache.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pager = Pager(capacity, *(json.loads(state.get[0]) if state.exists else ([], {})))
        out = []
        for row in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.ord):
            if row.op == "add":
                cold = pager.add(row.item, int(row.tokens))
            else:
                hit, cold = pager.read(row.item)
                out.append((key[0], row.ord, row.item, "hit" if hit else "miss"))
            out += [(key[0], row.ord, x, "cold") for x in cold]
        state.update((json.dumps([pager.hot, pager.cold]),))
        yield pd.DataFrame(out, columns=["cache", "ord", "item", "event"])

    kind = ops.schema["cache"].dataType.simpleString()
    return ops.groupBy("cache").applyInPandasWithState(step, f"cache {kind}, ord bigint, item string, event string", "held string", "append", GroupStateTimeout.NoTimeout)


def breaker_stream(calls: DataFrame, threshold: int = 3, reset_ms: int = 30_000) -> DataFrame:
    """(provider, id, open) for a stream of (provider, id, t, failed): whether the breaker blocks at each call.

    Calls of a micro-batch run in the order of (t, id). State: failures in a row and the time of the last.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails, last = state.get if state.exists else (0, -1)
        out = []
        for row in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: (r.t, r.id)):
            out.append((key[0], row.id, bool(fails >= threshold and row.t - last <= reset_ms)))
            fails, last = (fails + 1, int(row.t)) if row.failed else (0, last)
        state.update((fails, last))
        yield pd.DataFrame(out, columns=["provider", "id", "open"])

    kind = calls.schema["provider"].dataType.simpleString()
    return calls.groupBy("provider").applyInPandasWithState(step, f"provider {kind}, id bigint, open boolean", "fails bigint, last bigint", "append", GroupStateTimeout.NoTimeout)
