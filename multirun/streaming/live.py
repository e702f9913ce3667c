"""Continuous ingest in atomic batches, and the current runs as keyed stream state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from multirun.sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None, compact_every: int | None = None, cap: int | None = None):
    """Commits each micro-batch as one store commit, and compacts what they touched after every ``compact_every`` of them, in turns of ``cap`` bytes.

    The commit's number follows from the batch's, so a batch replayed after a failure is found in the
    manifest and not applied twice.
    """
    base = store.m.seq

    def one(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            store.commit_frame(batch, base + n + 1)
            if compact_every and len(store.m.pieces) >= compact_every:
                store.flush(cap=cap)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_counts(stream: DataFrame) -> DataFrame:
    """Number of live values per key, updated as operations arrive.

    State per key is the newest delete and a count, not the run. Operations of a key must arrive in
    commit order between batches; inside a batch the newest delete is looked up, and values after it count.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat([p[["seq", "idx", "op"]] for p in parts])
        gone = rows[rows["op"] == "D"]
        if len(gone):
            seq = gone["seq"].max()
            idx = gone.loc[gone["seq"] == seq, "idx"].max()
            n, rows = 0, rows[(rows["seq"] > seq) | ((rows["seq"] == seq) & (rows["idx"] > idx))]
        n += len(rows)
        state.update((n,))
        yield pd.DataFrame({"key": [key[0]], "n": [n]})

    kind = stream.schema["key"].dataType.simpleString()
    return stream.groupBy("key").applyInPandasWithState(step, f"key {kind}, n bigint", "n bigint", "update", GroupStateTimeout.NoTimeout)
