"""Guarded account commands as a stream: the state of an account is its balance, and the commands that wait for their turn."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textloom.operators.events import decide, in_cents, money

OUTPUT = "account_id string, seq long, type string, cents long, accepted boolean, after long"


def guarded_stream(commands: DataFrame) -> DataFrame:
    """(account_id, seq, type, amount, accepted, balance) of a stream of commands.

    Commands of a micro-batch are taken by seq; across micro-batches in the order they arrive. Intake is bounded by the source
    (maxFilesPerTrigger and the like), and a query with Trigger.AvailableNow ends when its input is used up.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (cents,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        ok, after = [], []
        for kind, amount in zip(rows["type"], rows["cents"], strict=True):
            accepted, cents = decide(int(cents), kind, int(amount))
            ok.append(accepted)
            after.append(cents)
        state.update((cents,))
        yield pd.DataFrame({"account_id": key[0], "seq": rows["seq"], "type": rows["type"], "cents": rows["cents"], "accepted": ok, "after": after})

    out = in_cents(commands).groupBy("account_id").applyInPandasWithState(run, OUTPUT, "cents long", "append", GroupStateTimeout.NoTimeout)
    return out.select("account_id", "seq", "type", money("cents").alias("amount"), "accepted", money("after").alias("balance"))


ORDERED = "account_id string, seq long, type string, cents long, status string, after long"


class _InOrder(StatefulProcessor):
    """One account: its balance and the next number wanted; commands that came too early wait in a map by their number.

    While some wait, a timer is set. When it fires, the gap in front of the first of them is given up.
    """

    def __init__(self, patience_ms: int | None) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", "next long, cents long, timer long")
        self.held = handle.getMapState("held", "seq long", "type string, cents long")

    def _state(self) -> tuple[int, int, int]:
        return tuple(self.account.get()) if self.account.exists() else (1, 0, 0)

    def _release(self, key: str, wanted: int, cents: int) -> tuple[list[tuple], int, int]:
        """The commands that are next in turn, decided."""
        out = []
        while self.held.containsKey((wanted,)):
            kind, amount = self.held.getValue((wanted,))
            self.held.removeKey((wanted,))
            accepted, cents = decide(cents, kind, amount)
            out.append((key, wanted, kind, amount, "accepted" if accepted else "rejected", cents))
            wanted += 1
        return out, wanted, cents

    def _finish(self, key: str, out: list[tuple], wanted: int, cents: int, timer: int, now: int) -> Iterator[pd.DataFrame]:
        waiting = any(True for _ in self.held.keys())
        if timer and (not waiting or out):
            if timer > now:
                self.handle.deleteTimer(timer)
            timer = 0
        if waiting and not timer and self.patience_ms is not None:
            timer = now + self.patience_ms
            self.handle.registerTimer(timer)
        self.account.update((wanted, cents, timer))
        if out:
            yield pd.DataFrame(out, columns=["account_id", "seq", "type", "cents", "status", "after"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        wanted, cents, timer = self._state()
        late = []
        for b in rows:
            for seq, kind, amount in zip(b["seq"].tolist(), b["type"].tolist(), b["cents"].tolist(), strict=True):
                if seq < wanted:
                    late.append((key[0], seq, kind, amount, "late", None))
                elif self.held.containsKey((seq,)):
                    late.append((key[0], seq, kind, amount, "repeated", None))
                else:
                    self.held.updateValue((seq,), (kind, amount))
        out, wanted, cents = self._release(key[0], wanted, cents)
        if late:
            yield pd.DataFrame(late, columns=["account_id", "seq", "type", "cents", "status", "after"]).astype({"after": "Int64"})
        yield from self._finish(key[0], out, wanted, cents, timer, 0 if self.patience_ms is None else timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        wanted, cents, timer = self._state()
        if expiredTimerInfo.getExpiryTimeInMs() < timer:  # an older timer
            return
        first = min((k[0] for k in self.held.keys()), default=None)
        if first is None:
            return
        gaps = [(key[0], seq, None, None, "missing", cents) for seq in range(wanted, first)]
        out, wanted, cents = self._release(key[0], first, cents)
        yield from self._finish(key[0], gaps + out, wanted, cents, timer, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def guarded_in_order(commands: DataFrame, patience_seconds: float | None = 60.0) -> DataFrame:
    """(account_id, seq, type, amount, status, balance) of a stream of commands that may come in any order.

    An account's commands are numbered from 1. Each is decided in its turn, so what a stream gives is what the batch gives, however
    the commands were shuffled over micro-batches: ``accepted`` or ``rejected``. A command that is early waits. If the one before it doesn't come within the
    time given after the account last went on, its number is given up as ``missing``; should it come after all it is ``late``, like any
    repeated one of a decided number; one that repeats a waiting number is ``repeated``, and neither changes a balance. ``side_output`` parts the two kinds. Commands without a
    number, or with one below 1, are left out. Timers go by the clock, for which Spark makes batches without data, so a query with Trigger.AvailableNow
    ends only if no patience is given (None): then early commands wait without end. Needs the RocksDB state store (``use_rocksdb``): what waits is on disk.
    """
    rows = in_cents(commands.where("seq >= 1"))
    processor = _InOrder(None if patience_seconds is None else int(patience_seconds * 1000))
    out = rows.groupBy("account_id").transformWithStateInPandas(processor, ORDERED, "append", "none" if patience_seconds is None else "processingTime")
    return out.select("account_id", "seq", "type", money("cents").alias("amount"), "status", money("after").alias("balance"))


def side_output(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decided commands as in the batch, numbers that were given up or came too late), for a micro-batch or a table of them."""
    normal = decided.where("status in ('accepted', 'rejected')")
    return normal.select("account_id", "seq", "type", "amount", (F.col("status") == "accepted").alias("accepted"), "balance"), decided.where("status not in ('accepted', 'rejected')")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
