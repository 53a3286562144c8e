"""Keyed state with timers, expiry and initial state: claims that fall due, first-seen flags, candidate memory.

Each job emits a row once, when its outcome is known, and keeps only what later rows need. Nothing that was
emitted is rewritten.
"""

from __future__ import annotations

import datetime as dt
import pickle
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.operators import ledger
from tidegauge.session import cut
from tidegauge.streaming.jobs import enable_state, group

DAY = dt.timedelta(days=1)
EPOCH = dt.date(1970, 1, 1)


def end_of(day: dt.date) -> int:
    """The first millisecond after a day."""
    return ((day - EPOCH).days + 1) * 86_400_000


# ---- claims that fall due ------------------------------------------------------------------------------------

SETTLED = "subject string, resolve_on date, outcome string, priced_on date, price double"


class DueDates(StatefulProcessor):
    """Per group of subjects, the dates their open claims fall due, and the closes that may still settle them. One event-time
    timer per group rings when the next date is over, or the next close or expiry after it: the claims of a
    date are settled by the first close on or after it, or expire `grace` days later. A date
    is held once however many claims of a subject have it, so a subject's state is bounded by the calendar."""

    def __init__(self, grace: int = ledger.GRACE_DAYS):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state binary")
        self.alarm = handle.getValueState("alarm", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, closes = self._state()
        for pdf in rows:
            asked, known = pdf[pdf["resolve_on"].notna()], pdf[pdf["d"].notna() & pdf["close"].notna()]
            for s, d in zip(asked["subject"], asked["resolve_on"]):
                due.setdefault(s, set()).add(d)
            for s, d, c in zip(known["subject"], known["d"], known["close"].astype("float64").tolist()):
                closes.setdefault(s, {})[d] = c
        yield from self._settle(due, closes, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        yield from self._settle(*self._state(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _state(self) -> tuple[dict[str, set], dict[str, dict]]:
        return pickle.loads(self.held.get()[0]) if self.held.exists() else ({}, {})

    def _settle(self, due: dict[str, set], closes: dict[str, dict], watermark: int) -> Iterator[pd.DataFrame]:
        over = EPOCH + dt.timedelta(days=watermark // 86_400_000) - DAY  # the last day that is complete
        done, open_, kept, ring = [], {}, {}, None
        for subject in due.keys() | closes.keys():
            own = closes.get(subject, {})
            days, left, at = sorted(own), [], 0
            for on in sorted(due.get(subject, ())):
                while at < len(days) and days[at] < on:
                    at += 1
                first = days[at] if at < len(days) and days[at] <= on + (self.grace + 1) * DAY else None
                if first is not None and first <= over:
                    done.append((subject, on, "resolved", first, own[first]))
                elif on + self.grace * DAY < over:
                    done.append((subject, on, "expired", None, None))
                else:
                    left.append(on)
                    rings = end_of(first or on + (self.grace + 1) * DAY)
                    ring = rings if ring is None else min(ring, rings)
            # a claim still to come falls due on or after the watermark's day
            keep = min([*left, over + DAY])
            if left:
                open_[subject] = set(left)
            if days and days[-1] >= keep:
                kept[subject] = {d: own[d] for d in days if d >= keep}
        if open_ or kept:
            self.held.update((pickle.dumps((open_, kept), pickle.HIGHEST_PROTOCOL),))  # one value: rows of a list cost a call's work each
        else:
            self.held.clear()
        self._ring(ring)
        if done:
            yield pd.DataFrame(done, columns=["subject", "resolve_on", "outcome", "priced_on", "price"]).astype({"price": "float64"})

    def _ring(self, at: int | None) -> None:
        """One timer, at the earliest moment at which an outcome can be known."""
        old = self.alarm.get()[0] if self.alarm.exists() else None
        if at == old:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if at is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(at)
            self.alarm.update((at,))


def settled_dates(claims: DataFrame, bars: DataFrame, delay: str = "2 days", grace: int = ledger.GRACE_DAYS) -> DataFrame:
    """How each (subject, resolve_on) of a stream of claims (subject, date, resolve_on) ends, given a stream of bars
    (ticker, d, close): `resolved` with the first close on or after resolve_on once the watermark has passed that
    close's day, or `expired`. Claims arrive by their date and closes by their day."""
    none = lambda kind: F.lit(None).cast(kind)
    asked = claims.select("subject", F.col("date").cast("timestamp").alias("ts"), "resolve_on", none("date").alias("d"), none("double").alias("close"))
    known = bars.select(F.col("ticker").alias("subject"), F.col("d").cast("timestamp").alias("ts"), none("date").alias("resolve_on"), "d", "close")
    both = asked.unionByName(known).withWatermark("ts", delay).withColumn("g", group("subject"))
    return both.groupBy("g").transformWithStateInPandas(
        DueDates(grace), outputStructType=SETTLED, outputMode="append", timeMode="EventTime")


def graded(claims: DataFrame, settled: DataFrame) -> DataFrame:
    """Every claim (id, subject, claim, date, resolve_on, price_at) with its state, from the settled dates."""
    done = (F.col("outcome") == "resolved") & (F.col("price") > 0) & (F.col("price_at") > 0)
    gain = F.when(done, F.col("price") / F.col("price_at") - 1)
    return claims.join(settled, ["subject", "resolve_on"], "left").select(
        "id", "subject", "claim", "date", "resolve_on",
        F.when(gain.isNotNull(), "resolved").when(F.col("outcome").isNotNull(), "expired").otherwise("open").alias("status"),
        gain.alias("realized_return"), F.when(gain.isNotNull(), F.when(F.col("claim") == "up", gain > 0).otherwise(gain < 0)).alias("correct"))


# ---- first seen ------------------------------------------------------------------------------------------------

FLAGGED = "subject string, item string, d date, is_new boolean"


class SeenKeys(StatefulProcessor):
    """Per subject, the day each key was last seen. A key is new if it was not seen in the `keep` days before; every
    sighting renews it. The state store itself drops a key that no run has touched for that long."""

    def __init__(self, keep: int = 90):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "d date", ttlDurationMs=(self.keep + 1) * 86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["d", "item"], ignore_index=True)
        last = {k[0]: v[0] for k, v in self.seen.iterator()} if self.seen.exists() else {}
        new, touched = [], {}
        for name, d in zip(pdf["key"], pdf["d"]):
            before = touched.get(name, last.get(name))
            new.append(before is None or d - before > self.keep * DAY)
            touched[name] = d if before is None else max(d, before)
        for name, d in touched.items():
            self.seen.updateValue((name,), (d,))
        yield pdf.assign(is_new=new)[["subject", "item", "d", "is_new"]]

    def close(self) -> None:
        pass


def flag_seen(items: DataFrame, keep: int = 90) -> DataFrame:
    """Items (subject, item, key, d), arriving by day, with `is_new`: nothing is dropped."""
    return items.select("subject", "item", "key", "d").groupBy("subject").transformWithStateInPandas(
        SeenKeys(keep), outputStructType=FLAGGED, outputMode="append", timeMode="ProcessingTime")


# ---- candidate memory --------------------------------------------------------------------------------------------

REMEMBERED = "n bigint, id string, fresh boolean"


class Memory(StatefulProcessor):
    """Per group of ids, the status and evidence of each candidate that a reviewer has seen. It starts from a table.
    A candidate is fresh if it is unknown, or was rejected on other evidence; a verdict is remembered."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getMapState("past", "id string", "status string, evidence_hash string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for name, status, evidence in zip(initialState["id"], initialState["status"], initialState["evidence_hash"]):
            self.past.updateValue((name,), (status, evidence))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("n", ignore_index=True)
        known = {k[0]: tuple(v) for k, v in self.past.iterator()} if self.past.exists() else {}
        out, changed = [], set()
        for n, name, status, evidence in zip(pdf["n"], pdf["id"], pdf["status"], pdf["evidence_hash"]):
            if status is not None:
                known[name] = (status, evidence)
                changed.add(name)
                continue
            past = known.get(name)
            out.append((n, name, past is None or (past[0] == "rejected" and past[1] != evidence)))
        for name in changed:
            self.past.updateValue((name,), known[name])
        if out:
            yield pd.DataFrame(out, columns=["n", "id", "fresh"])

    def close(self) -> None:
        pass


def recall_candidates(events: DataFrame, memory: DataFrame, groups: int = 64) -> DataFrame:
    """(n, id, fresh) for the candidates of a stream of events (n, id, status, evidence_hash) in the order of n: rows
    without a status are candidates, rows with one are verdicts on them. The memory (id, status, evidence_hash) is
    read once, when the stream first starts; a restart goes on from the state. Ids are kept in `groups` groups."""
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g")
    start = memory.select(group, "id", "status", "evidence_hash").groupBy("g")
    return events.select(group, "n", "id", "status", "evidence_hash").groupBy("g").transformWithStateInPandas(
        Memory(), outputStructType=REMEMBERED, outputMode="append", timeMode="None", initialState=start)


# ---- running a stream over a table -------------------------------------------------------------------------------

#: Rows of a slice behind one of its files; a task writes or reads a file.
ROWS_PER_FILE = 1_000_000


def replay(table: DataFrame, path: str, by: str, slices: int = 3) -> DataFrame:
    """A stream of the table's rows in `slices` micro-batches in the order of a date column: one folder write after
    another, as a feed that lands by day. The table is worked out once. All slices have the same number of files, some
    of them empty where rows are few, so a micro-batch of that many is a slice."""
    spark, files = table.sparkSession, 1
    table = cut(table)
    low, high = table.agg(F.min(by), F.max(by)).first()
    if low is not None:
        step = max(1, -(-((high - low).days + 1) // slices))
        at = F.floor(F.date_diff(F.col(by), F.lit(low)) / step)
        files += table.groupBy(at.alias("at")).count().agg(F.max("count")).first()[0] // ROWS_PER_FILE
        for i in range(slices):
            part = table.where((F.col(by) >= F.lit(low + i * step * DAY)) & (F.col(by) < F.lit(low + (i + 1) * step * DAY)))
            folder = f"{path}/slice={i}"
            part.repartition(files, *part.columns).write.parquet(folder)
            for _ in range(files - len(spark.read.schema(table.schema).parquet(folder).inputFiles())):
                table.limit(0).write.mode("append").parquet(folder)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/slice=*")


IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_STARTING = threading.Lock()


def collected(stream: DataFrame, path: str, checkpoint: str, idle: bool = True) -> DataFrame:
    """What a stream emits until it has read all there is, as a table. Batches without data, which let timers ring,
    run only if `idle`: a job whose state expires by the clock would ask for them without end."""
    spark = stream.sparkSession
    enable_state(spark)
    with _STARTING:  # the query keeps the setting it starts with; the session's comes back at once
        before = spark.conf.get(IDLE)
        spark.conf.set(IDLE, str(idle).lower())
        try:
            run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
                .outputMode("append").trigger(availableNow=True).start()
        finally:
            spark.conf.set(IDLE, before)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def heartbeat(day: Column) -> Column:
    """A date whose arrival moves a watermark with a delay of two days past the given day."""
    return F.date_add(day, 3)
