"""State machines over streams, with state by key: an approval sends a draft once, and a registry of tasks keeps the newest.

Both need Spark's state store on RocksDB (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CAPACITY = 1000


class _Approval(StatefulProcessor):
    """pending to sent, once. Rows are drafts (kind 'draft': status, email) and approvals (kind 'approval') of one draft; a draft is known before its approvals."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.draft = handle.getValueState("draft", "status string, email string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        batch = batch.assign(later=batch["kind"] != "draft").sort_values(["later", "ts", "approval_id"])
        state = self.draft.get() if self.draft.exists() else None
        out = []
        for r in batch.itertuples(index=False):
            if r.kind == "draft":
                if state is None:
                    state = (r.status, r.email)
                continue
            if state is None:
                said = "not_found"
            elif state[0] != "pending":
                said = "already"
            elif not (state[1] or "").strip():
                said = "no_email"
            else:
                said, state = "sent", ("sent", state[1])
            out.append((r.approval_id, key[0], said))
        if state is not None:
            self.draft.update(state)
        yield pd.DataFrame(out, columns=["approval_id", "draft_id", "outcome"])

    def close(self) -> None:
        pass


def approvals_stream(rows: DataFrame) -> DataFrame:
    """(approval_id, draft_id, outcome) of each approval in ``rows``: draft_id, kind, ts, approval_id, status, email."""
    return rows.groupBy("draft_id").transformWithStateInPandas(_Approval(), "approval_id long, draft_id long, outcome string", "append", "None")


class _Registry(StatefulProcessor):
    """The newest ``capacity`` tasks of a key by the time they first came; an update keeps its task's place."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tasks = handle.getMapState("tasks", "task_id string", "place long, status string")
        self.next = handle.getValueState("next", "place long, oldest long")
        self.order = handle.getMapState("order", "place long", "task_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("seq")
        place, oldest = self.next.get() if self.next.exists() else (0, 0)
        out = []
        for r in batch.itertuples(index=False):
            name = (r.task_id,)
            if self.tasks.containsKey(name):
                self.tasks.updateValue(name, (self.tasks.getValue(name)[0], r.status))
            else:
                self.tasks.updateValue(name, (place, r.status))
                self.order.updateValue((place,), name)
                place += 1
            out.append((r.seq, key[0], r.task_id, r.status, "kept"))
            while place - oldest > self.capacity:
                gone = self.order.getValue((oldest,))
                out.append((r.seq, key[0], gone[0], self.tasks.getValue(gone)[1], "evicted"))
                self.tasks.removeKey(gone)
                self.order.removeKey((oldest,))
                oldest += 1
        self.next.update((place, oldest))
        yield pd.DataFrame(out, columns=["seq", "owner", "task_id", "status", "event"])

    def close(self) -> None:
        pass


def registry_stream(updates: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What a bounded registry does with each update (owner, seq, task_id, status): kept, and which tasks it evicts. A task that comes again after that is a new one."""
    return updates.groupBy("owner").transformWithStateInPandas(_Registry(capacity), "seq long, owner string, task_id string, status string, event string", "append", "None")
