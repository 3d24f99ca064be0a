"""Stream jobs that keep state per key with event-time timers (ST-07, ST-09), and the same rules over a table.

A day's or month's events are only counted while it is open and applied once the watermark has passed its end, so the order in which
events arrive does not matter; what comes later still is dropped, as everywhere. State is a few numbers and the open days of a key, whatever
the number of its events. Streams need the RocksDB state store (``STATE_STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from engram import vocab as V
from engram.functions import lifecycle as L

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY_MS = 86_400_000
#: What a reinforcement adds to the strength, how it slows decay, and idle days after which a memory is reported as idle.
BOOST, SLOWER, IDLE_DAYS = 0.1, 0.8, 3


def _day(ts: str = "ts"):
    return F.floor(F.unix_timestamp(ts) / 86_400)


# ---- ST-07: running reinforcement ------------------------------------------------------
def with_start(events: DataFrame, memories: DataFrame) -> DataFrame:
    """Events with what their memory starts from, for the first one that its state sees."""
    start = memories.select("memory_id", F.coalesce("memory_strength", F.lit(0.5)).alias("strength0"), F.coalesce("reinforcement_count", F.lit(0)).cast("long").alias("count0"),
                            F.coalesce("decay_rate", F.lit(0.05)).alias("rate0"))
    return events.select("event_id", "memory_id", "ts").join(start, "memory_id")


def applied(strength: float, count: int, rate: float, last: int | None, day: int, n: int, boost: float) -> tuple[float, int, float]:
    """A day with ``n`` reinforcements after the idle days since ``last``, which cost the decay rate of that time each."""
    idle = 0 if last is None else max(0, day - last - 1)
    return min(1.0, strength * (1 - rate) ** idle + boost * n), count + n, rate * SLOWER**n


class Running(StatefulProcessor):
    """Strength, count and decay rate of one memory, and the counts of days that are still open."""

    def __init__(self, boost: float, idle_days: int):
        self.boost, self.idle_days = boost, idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "strength double, count long, rate double, last int, told int")
        self.open = handle.getMapState("open", "day int", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            if not self.run.exists():
                first = part.iloc[0]
                self.run.update((float(first["strength0"]), int(first["count0"]), float(first["rate0"]), -1, -1))
            for day, n in part.groupby("day").size().items():
                known = self.open.getValue((int(day),))[0] if self.open.containsKey((int(day),)) else 0
                self.open.updateValue((int(day),), (int(known + n),))
                self.handle.registerTimer((int(day) + 1) * DAY_MS)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() // DAY_MS
        strength, count, rate, last, told = self.run.get()
        out = []

        def idle_before(day: int) -> None:
            """Reports the memory as idle after its last day if nothing came until ``day``."""
            nonlocal told
            if last >= 0 and told != last and day > last + self.idle_days:
                told = last
                out.append((key[0], last + self.idle_days, 0, strength * (1 - rate) ** self.idle_days, count, rate))

        for day, n in sorted((k[0], v[0]) for k, v in self.open.iterator()):
            if day < until:
                idle_before(day)
                strength, count, rate = applied(strength, count, rate, None if last < 0 else last, day, n, self.boost)
                last = day
                out.append((key[0], day, n, strength, count, rate))
                self.open.removeKey((day,))
        idle_before(until)
        if last >= 0 and told != last:
            self.handle.registerTimer((last + 1 + self.idle_days) * DAY_MS)
        self.run.update((strength, count, rate, last, told))
        yield pd.DataFrame(out, columns=["memory_id", "day", "n", "strength", "count", "rate"])

    def close(self) -> None:
        pass


def running_state(events: DataFrame, memories: DataFrame, watermark: str = "10 minutes", boost: float = BOOST, idle_days: int = IDLE_DAYS, until_day: int | None = None) -> DataFrame:
    """(memory_id, day, n, memory_strength, reinforcement_count, decay_rate, cognitive_state) for each day of a memory with reinforcements, and one row with ``n`` 0 when
    it has had none for ``idle_days`` (ST-07). A repeated event id counts once.

    Idle days weaken a memory by the decay rate it has by then, and each reinforcement slows that rate, so the order of days matters. Over a table, days that are
    not over by ``until_day`` (days since 1970) are left out and idle memories are reported up to it; by default all days count and only gaps between days are idle.
    """
    if events.isStreaming:
        once = with_start(events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"]), memories).withColumn("day", _day().cast("int"))
        df = once.groupBy("memory_id").transformWithStateInPandas(
            Running(boost, idle_days), "memory_id long, day int, n long, strength double, count long, rate double", "Append", "EventTime")
    else:
        days = (with_start(events.dropDuplicates(["event_id"]), memories).groupBy("memory_id", _day().cast("int").alias("day"))
                .agg(F.count("*").alias("n"), F.first("strength0").alias("strength0"), F.first("count0").alias("count0"), F.first("rate0").alias("rate0")))
        days = days if until_day is None else days.filter(F.col("day") < until_day)
        # days of a memory are few, however many its events; they are folded in order without leaving the JVM
        per = days.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("days"), *[F.first(c).alias(c) for c in ("strength0", "count0", "rate0")])
        row = lambda day, n, strength, count, rate: F.struct(day.cast("int").alias("day"), n.cast("long").alias("n"), strength.cast("double").alias("strength"),
                                                             count.cast("long").alias("count"), rate.cast("double").alias("rate"))
        start = F.array(row(F.lit(-1), F.lit(0), F.col("strength0"), F.col("count0"), F.col("rate0")))

        def step(done, d):
            last = F.element_at(done, -1)
            idle = F.when(last["day"] < 0, 0).otherwise(F.greatest(F.lit(0), d["day"] - last["day"] - 1))
            strength = F.least(F.lit(1.0), last["strength"] * F.pow(1 - last["rate"], idle) + boost * d["n"])
            return F.array_append(done, row(d["day"], d["n"], strength, last["count"] + d["n"], last["rate"] * F.pow(F.lit(SLOWER), d["n"])))

        folded = per.select("memory_id", F.explode(F.slice(F.aggregate("days", start, step), F.lit(2), F.size("days"))).alias("r")).select("memory_id", "r.*")
        ahead = F.lead("day").over(Window.partitionBy("memory_id").orderBy("day"))
        quiet = folded.withColumn("_next", ahead).withColumn("_at", F.col("day") + idle_days)
        over = (F.col("_next") > F.col("_at")) if until_day is None else F.coalesce(F.col("_next"), F.lit(until_day + 1)) > F.col("_at")
        over = over if until_day is None else over & (F.col("_at") < until_day)
        idle = quiet.filter(over).select("memory_id", F.col("_at").cast("int").alias("day"), F.lit(0).cast("long").alias("n"),
                                         (F.col("strength") * F.pow(1 - F.col("rate"), F.lit(idle_days))).alias("strength"), "count", "rate")
        df = folded.unionByName(idle)
    state = L.reinforced_state(F.col("strength"), F.col("count"))
    return df.select("memory_id", "day", "n", F.col("strength").alias("memory_strength"), F.col("count").alias("reinforcement_count"), F.col("rate").alias("decay_rate"), state.alias("cognitive_state"))


# ---- ST-09: the monthly cap -------------------------------------------------------------
class Capped(StatefulProcessor):
    """Uses of one tenant in each open month; the use that passes the cap is reported at once, the month when it is over."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.months = handle.getMapState("months", "month int", "uses long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for part in rows:
            for month, n in part.groupby("month").size().items():
                at = (int(month),)
                before = self.months.getValue(at)[0] if self.months.containsKey(at) else 0
                if before <= self.cap < before + n:
                    out.append((key[0], int(month), self.cap + 1, True, False))
                self.months.updateValue(at, (int(before + n),))
                self.handle.registerTimer(_month_end_ms(int(month)))
        yield pd.DataFrame(out, columns=["tenant_id", "month", "uses", "breached", "closed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        for month, uses in sorted((k[0], v[0]) for k, v in self.months.iterator()):
            if _month_end_ms(month) <= expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], month, uses, uses > self.cap, True))
                self.months.removeKey((month,))
        yield pd.DataFrame(out, columns=["tenant_id", "month", "uses", "breached", "closed"])

    def close(self) -> None:
        pass


def _month_end_ms(month: int) -> int:
    return int(pd.Timestamp(year=month // 12 + (month % 12 + 1) // 12, month=(month + 1) % 12 + 1, day=1, tz="UTC").timestamp() * 1000)


def monthly_cap(usage: DataFrame, cap: int = V.MONTHLY_CAP, watermark: str = "1 day") -> DataFrame:
    """(tenant_id, month, uses, breached, closed) of each month that is over, and one row that is not ``closed`` for the use that passes the cap (ST-09).

    On a stream that row comes with the micro-batch that passes the cap, the closing one when the watermark leaves the month; over a table both come for every month.
    """
    number = (F.year("ts") * 12 + F.month("ts") - 1).cast("int").alias("month")
    if usage.isStreaming:
        rows = usage.withWatermark("ts", watermark).select("tenant_id", "ts", number)
        df = rows.groupBy("tenant_id").transformWithStateInPandas(Capped(cap), "tenant_id long, month int, uses long, breached boolean, closed boolean", "Append", "EventTime")
    else:
        counts = usage.groupBy("tenant_id", number).agg(F.count("*").alias("uses"))
        passed = counts.filter(F.col("uses") > cap).select("tenant_id", "month", F.lit(cap + 1).cast("long").alias("uses"), F.lit(True).alias("breached"), F.lit(False).alias("closed"))
        df = counts.select("tenant_id", "month", "uses", (F.col("uses") > cap).alias("breached"), F.lit(True).alias("closed")).unionByName(passed)
    return df.withColumn("month", F.make_date(F.floor(F.col("month") / 12).cast("int"), F.col("month") % 12 + 1, F.lit(1)))
