"""Accounts from an ordered log of deposits and withdrawals.

What was logged is summed. What is asked for is guarded: a withdrawal must be covered by the balance, which depends on all
commands before. A run of commands is a map from the balance before it to the balance after it, made of
pieces on which it adds a fixed amount; maps of consecutive runs are composed. So the log is cut into segments of consecutive
commands, whatever accounts they belong to, and segments are worked on at the same time.

Balances can also be had at a version: from the last snapshot at or before it, and the events after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.scratch import keep

MONEY = "decimal(18,2)"
#: Commands of a segment; segments of a log at most (their ends are broadcast, two rows each); pieces of a segment's map at most, beyond which it is folded in its turn.
SEGMENT_ROWS, MOST_SEGMENTS, MOST_PIECES = 250_000, 100_000, 5_000
DECIDED = "account_id string, seq long, type string, cents long, accepted boolean, after long"
ENDS = "account_id string, segment int, opening long, closing long"


def signed(kind: Column | str = "type", amount: Column | str = "amount") -> Column:
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.when(F.col(kind) == "deposit", amount).otherwise(-amount)


def replay(events: DataFrame) -> DataFrame:
    """(account_id, balance, version) of events (account_id, seq, type, amount); what was logged isn't questioned."""
    return events.groupBy("account_id").agg(F.sum(signed()).cast(MONEY).alias("balance"), F.count("*").alias("version"))


def numbered(events: DataFrame) -> DataFrame:
    """Events with their version: 1 for an account's first by seq."""
    return events.withColumn("version", F.row_number().over(Window.partitionBy("account_id").orderBy("seq")).cast("long"))


def snapshots(events: DataFrame, every: int = 1000) -> DataFrame:
    """(account_id, version, balance) after each ``every`` events of an account: a sum for each stretch, then running sums over those.

    ``events`` (account_id, version, type, amount) are numbered from 1 without gaps.
    """
    if every < 1:
        raise ValueError("every must be at least 1")
    stretch = F.floor((F.col("version") - 1) / every)
    sums = events.groupBy("account_id", stretch.alias("stretch")).agg(F.sum(signed()).alias("change"), F.count("*").alias("n"))
    running = F.sum("change").over(Window.partitionBy("account_id").orderBy("stretch"))
    whole = sums.withColumn("balance", running.cast(MONEY)).where(F.col("n") == every)
    return whole.select("account_id", ((F.col("stretch") + 1) * every).cast("long").alias("version"), "balance")


def extend_snapshots(taken: DataFrame, events: DataFrame, every: int = 1000) -> DataFrame:
    """The snapshots that events after the last ones add: their stretches on top of the last balance."""
    last = taken.groupBy("account_id").agg(F.max("version").alias("last"), F.max_by("balance", "version").alias("base"))
    newer = events.join(last, "account_id", "left").where(F.col("version") > F.coalesce("last", F.lit(0)))
    more = snapshots(newer.select("account_id", "version", "type", "amount"), every)
    return more.join(last, "account_id", "left").select("account_id", "version", (F.col("balance") + F.coalesce("base", F.lit(0).cast(MONEY))).cast(MONEY).alias("balance"))


def at_versions(events: DataFrame, taken: DataFrame, wanted: DataFrame, every: int = 1000) -> DataFrame:
    """(request, account_id, version, balance) for requests (request, account_id, version) of an account at a version.

    The last snapshot at or before a version is that of the last whole stretch, or the account's last one where the log has gone on
    since; so it is found by its number, and the events after it by the numbers of their stretches. No account's events, requests or
    snapshots meet in one task. Where a snapshot is missing the account is replayed from its beginning. Version 0 is an empty account; a
    version that the log hasn't reached, or an unknown account, has no balance.
    """
    ends = events.groupBy("account_id").agg(F.max("version").alias("reached"))
    lasts = taken.groupBy("account_id").agg(F.max("version").alias("last_shot"))
    asked = wanted.select(F.col("request").cast("long"), "account_id", F.col("version").cast("long"))
    asked = asked.join(ends, "account_id", "left").join(lasts, "account_id", "left")
    there = (F.col("version") >= 0) & (F.col("version") <= F.col("reached"))
    asked = asked.withColumn("there", F.coalesce(there, F.lit(False)))
    asked = asked.withColumn("shot", F.least(F.floor(F.col("version") / every) * every, F.coalesce("last_shot", F.lit(0))))
    based = asked.join(taken.select("account_id", F.col("version").alias("shot"), "balance"), ["account_id", "shot"], "left")
    since = F.when(F.col("balance").isNull(), 0).otherwise(F.col("shot"))
    based = based.select("request", "account_id", "version", "there", since.alias("since"), F.coalesce("balance", F.lit(0).cast(MONEY)).alias("base"))
    stretches = F.when(F.col("there") & (F.col("version") > F.col("since")), F.sequence(F.floor(F.col("since") / every), F.floor((F.col("version") - 1) / every)))
    tail = events.select("account_id", F.floor((F.col("version") - 1) / every).alias("stretch"), F.col("version").alias("v"), signed().alias("change"))
    based = based.withColumn("stretch", F.explode_outer(stretches)).join(tail, ["account_id", "stretch"], "left")
    change = F.sum(F.when((F.col("v") > F.col("since")) & (F.col("v") <= F.col("version")), F.col("change")))
    found = based.groupBy("request", "account_id", "version", "there").agg(F.first("base").alias("base"), F.coalesce(change, F.lit(0)).alias("change"))
    return found.select("request", "account_id", "version", F.when(F.col("there"), (F.col("base") + F.col("change")).cast(MONEY)).alias("balance"))


def decide(cents: int, kind: str, amount: int) -> tuple[bool, int]:
    """Whether a command is accepted, and the balance after it."""
    if amount <= 0 or (kind != "deposit" and cents < amount):
        return False, cents
    return True, cents + amount if kind == "deposit" else cents - amount


class BalanceMap:
    """The balance after a run of commands, for each balance from ``low`` to ``high`` before it."""

    def __init__(self, low: int, high: int) -> None:
        self.starts, self.added = np.array([low], dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.high, self.shift = high, 0  # ``shift`` is added everywhere
        self._span()

    def _span(self) -> None:
        ends = np.append(self.starts[1:] - 1, self.high)
        self.least, self.most = int((self.starts + self.added).min()), int((ends + self.added).max())

    def then(self, kind: str, amount: int) -> None:
        if amount <= 0:
            return
        if kind == "deposit":
            self.shift += amount
        elif self.least + self.shift >= amount:  # always covered
            self.shift -= amount
        elif self.most + self.shift >= amount:
            need = amount - self.shift
            ends = np.append(self.starts[1:] - 1, self.high)
            cut = np.flatnonzero((self.starts + self.added < need) & (ends + self.added >= need))
            if len(cut):
                at = need - self.added[cut]
                self.starts, self.added = np.insert(self.starts, cut + 1, at), np.insert(self.added, cut + 1, self.added[cut])
            self.added = np.where(self.starts + self.added >= need, self.added - amount, self.added)
            same = np.append(False, self.added[1:] == self.added[:-1])
            self.starts, self.added = self.starts[~same], self.added[~same]
            self._span()

    def __len__(self) -> int:
        return len(self.starts)

    def __call__(self, balance: int) -> int:
        return balance + self.shift + int(self.added[np.searchsorted(self.starts, balance, side="right") - 1])


def fold(cents: int, kinds: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which commands of a run are accepted, and the balance after each; from a balance before the run."""
    amounts = amounts.astype(np.int64)
    asked = np.where(amounts > 0, np.where(kinds == "deposit", amounts, -amounts), 0)
    after = cents + np.cumsum(asked)
    if not len(after) or after.min() >= 0:  # every withdrawal is covered
        return amounts > 0, after
    ok, out = np.zeros(len(amounts), dtype=bool), np.empty(len(amounts), dtype=np.int64)
    for i, (kind, amount) in enumerate(zip(kinds.tolist(), amounts.tolist(), strict=True)):
        ok[i], cents = decide(cents, kind, amount)
        out[i] = cents
    return ok, out


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["account_id", "seq", "type", "cents"], kind="stable")


def in_cents(commands: DataFrame) -> DataFrame:
    return commands.where("account_id is not null").select(F.col("account_id").cast("string"), F.col("seq").cast("long"), "type", (F.coalesce("amount", F.lit(0)).cast(MONEY) * 100).cast("long").alias("cents"))


def money(cents: str) -> Column:
    return (F.col(cents).cast("decimal(18,0)") / 100).cast(MONEY)


def _openings(ordered: DataFrame) -> DataFrame:
    """(account_id, segment, opening, closing): the balances before and after each segment of the accounts that go over several.

    A segment has at most two of those, its first and its last, so there are few rows however many commands.
    """
    spark = ordered.sparkSession
    ends = ordered.groupBy("segment").agg(F.array_distinct(F.array(F.min("account_id"), F.max("account_id"))).alias("ends"))
    both = ends.select("segment", F.explode("ends").alias("account_id"))
    split = both.groupBy("account_id").agg(F.count("*").alias("n")).where("n > 1").select("account_id")
    parts = ordered.join(F.broadcast(both.join(split, "account_id", "left_semi")), ["account_id", "segment"])
    # Between which bounds a balance can be: all withdrawals before accepted, or none.
    put = F.when((F.col("cents") > 0) & (F.col("type") == "deposit"), F.col("cents")).otherwise(0)
    taken = F.when((F.col("cents") > 0) & (F.col("type") != "deposit"), F.col("cents")).otherwise(0)
    sums = parts.groupBy("account_id", "segment").agg(F.sum(put).alias("put"), F.sum(taken).alias("taken"))
    before = Window.partitionBy("account_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bounds = sums.select("account_id", "segment", F.coalesce(F.sum("put").over(before), F.lit(0)).alias("high"), F.coalesce(F.sum(F.col("put") - F.col("taken")).over(before), F.lit(0)).alias("low"))
    bounds = bounds.withColumn("low", F.greatest("low", F.lit(0)))
    most = MOST_PIECES

    def to_map(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _in_order(rows)
        m = BalanceMap(int(rows["low"].iloc[0]), int(rows["high"].iloc[0]))
        for kind, amount in zip(rows["type"].tolist(), rows["cents"].tolist(), strict=True):
            m.then(kind, amount)
            if len(m) > most:
                return pd.DataFrame([(rows["account_id"].iloc[0], rows["segment"].iloc[0], None, None)], columns=["account_id", "segment", "starts", "after"])
        return pd.DataFrame([(rows["account_id"].iloc[0], rows["segment"].iloc[0], m.starts, m.starts + m.added + m.shift)], columns=["account_id", "segment", "starts", "after"])

    mapped = keep(parts.join(F.broadcast(bounds), ["account_id", "segment"]).groupBy("account_id", "segment").applyInPandas(to_map, "account_id string, segment int, starts array<long>, after array<long>"), "maps")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Balances from segment to segment, as far as they are known: a row a segment, one map at a time."""
        account, balance = object(), None
        for b in batches:
            out = []
            for a, segment, starts, after, folded in zip(b["account_id"], b["segment"], b["starts"], b["after"], b["closing"], strict=True):
                if a != account:
                    account, balance = a, 0
                opening = balance
                if balance is not None and starts is not None:
                    k = int(np.searchsorted(starts, balance, side="right")) - 1
                    balance = int(after[k]) + balance - int(starts[k])
                elif balance is not None:
                    balance = None if pd.isna(folded) else int(folded)
                out.append((a, segment, opening, balance))
            yield pd.DataFrame(out, columns=["account_id", "segment", "opening", "closing"]).astype({"opening": "Int64", "closing": "Int64"})

    known = spark.createDataFrame([], "account_id string, segment int, closing long")
    while True:
        linked = mapped.join(F.broadcast(known), ["account_id", "segment"], "left").repartition("account_id").sortWithinPartitions("account_id", "segment")
        chained = keep(linked.mapInPandas(chain, ENDS), "balances")
        # Segments whose map was too large, each account's first: their opening is known, so they are folded.
        waiting = chained.where("opening is not null and closing is null")
        if waiting.isEmpty():
            return chained

        def closing(rows: pd.DataFrame) -> pd.DataFrame:
            rows = _in_order(rows)
            _, after = fold(int(rows["opening"].iloc[0]), rows["type"].to_numpy(), rows["cents"].to_numpy())
            return pd.DataFrame([(rows["account_id"].iloc[0], rows["segment"].iloc[0], int(after[-1]))], columns=["account_id", "segment", "closing"])

        folded = ordered.join(F.broadcast(waiting.select("account_id", "segment", "opening")), ["account_id", "segment"])
        known = known.unionByName(keep(folded.groupBy("account_id", "segment").applyInPandas(closing, "account_id string, segment int, closing long"), "closings"))


def guarded(commands: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(account_id, seq, type, amount, accepted, balance) of commands in order.

    Amounts must be positive and a withdrawal covered; a rejected command changes nothing. Commands of one account and seq
    are taken by type and amount. Segments are ranges of (account, seq), so an account of any size is spread over tasks.
    """
    rows = in_cents(commands)
    spark = rows.sparkSession
    n = rows.count()
    parts = min(MOST_SEGMENTS, max(spark.sparkContext.defaultParallelism, -(-n // segment_rows)))
    ordered = keep(rows.repartitionByRange(parts, "account_id", "seq").withColumn("segment", F.spark_partition_id()), "commands")
    openings = _openings(ordered).select("account_id", "segment", "opening")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _in_order(rows)
        account = rows["account_id"].to_numpy()
        edges = np.flatnonzero(np.append(True, account[1:] != account[:-1])).tolist()
        kinds, amounts, opening = rows["type"].to_numpy(), rows["cents"].to_numpy(), rows["opening"].to_numpy()
        parts = [fold(int(opening[a]), kinds[a:b], amounts[a:b]) for a, b in zip(edges, [*edges[1:], len(rows)], strict=True)]
        return rows[["account_id", "seq", "type", "cents"]].assign(accepted=np.concatenate([ok for ok, _ in parts]), after=np.concatenate([after for _, after in parts]))

    joined = ordered.join(F.broadcast(openings), ["account_id", "segment"], "left").withColumn("opening", F.coalesce("opening", F.lit(0).cast("long")))
    out = joined.groupBy("segment").applyInPandas(run, DECIDED)
    return out.select("account_id", "seq", "type", money("cents").alias("amount"), "accepted", money("after").alias("balance"))
