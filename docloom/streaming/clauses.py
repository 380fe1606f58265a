"""The states of a job's clauses as a stateful stream.

Events (job, clause, seq, ts, kind, status, reason, text, locator) say that a
clause was saved, was marked with a status, or that working on it failed with an
error. A clause is saved once: what its first event says of text and locator
stays. A mark sets status and reason. After an error the clause is due again in
1, 2 and 4 seconds; the fourth in a row fails it, unless its status has ended. A
mark starts the count anew.

State is kept for each clause, in size independent of the number of its events:
the first event, the last mark, and the last errors, all by seq. Taking in an
event twice, late or in another order comes to the same, so a batch that is run
again changes nothing and gives no rows. Timers run on event time. Null kinds
and unknown ones are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.jobs import TERMINAL
from docloom.streaming import checkpoints

EVENTS = "job string, clause string, seq long, ts timestamp, kind string, status string, reason string, text string, locator string"
CHANGES = "job string, clause string, no long, change string, status string, reason string, attempts int, due timestamp, text string, locator string, created timestamp, updated timestamp"
# inside, times are whole microseconds, which no time zone touches
_MICROS = CHANGES.replace("timestamp", "long")
_STATE = "first_seq long, text string, locator string, created long, mark_seq long, status string, reason string, marked long, errors array<struct<seq:long,at:long,reason:string>>, due long, no long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOST_RETRIES = 3
EMPTY: dict[str, Any] = {"first_seq": None, "text": None, "locator": None, "created": None, "mark_seq": None, "status": None, "reason": None, "marked": None, "errors": [], "due": None, "no": 0}


def with_event(state: dict[str, Any], event: Row) -> dict[str, Any]:
    """The state after an event; the same for the same events in any order."""
    s = dict(state)
    if event["kind"] in ("saved", "marked") and (s["first_seq"] is None or event["seq"] < s["first_seq"]):
        s |= {"first_seq": event["seq"], "text": event["text"], "locator": event["locator"], "created": event["at"]}
    if event["kind"] == "marked" and (s["mark_seq"] is None or event["seq"] > s["mark_seq"]):
        s |= {"mark_seq": event["seq"], "status": event["status"], "reason": event["reason"], "marked": event["at"]}
    if event["kind"] == "error" and event["seq"] not in {e[0] for e in s["errors"]}:
        s["errors"] = sorted([*s["errors"], (event["seq"], event["at"], event["reason"])])[-MOST_RETRIES - 1 :]
    return s


def outcome(s: dict[str, Any]) -> dict[str, Any]:
    """What a state comes to: status, reason, attempts, due, and when it changed."""
    ended = s["status"] in TERMINAL
    errors = [] if ended else [e for e in s["errors"] if s["mark_seq"] is None or e[0] > s["mark_seq"]]
    told = {"status": s["status"] or "queued", "reason": s["reason"], "attempts": len(errors), "due": None, "updated": max((t for t in (s["created"], s["marked"], *(e[1] for e in errors)) if t is not None), default=None)}
    if len(errors) > MOST_RETRIES:
        told |= {"status": "failed", "reason": errors[-1][2]}
    elif errors:
        told["due"] = errors[-1][1] + 1_000_000 * 2 ** (len(errors) - 1)
    return told


def _millis(micros: int) -> int:
    return -(-micros // 1000)


class ClauseProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("clause", _STATE)

    def _load(self) -> dict[str, Any]:
        held = self.state.get()
        return dict(EMPTY) if held is None else dict(zip(EMPTY, held)) | {"errors": [tuple(e) for e in held[8] or []]}

    def _row(self, key: tuple, s: dict[str, Any], change: str) -> Row:
        told = outcome(s)
        return Row(job=key[0], clause=key[1], no=s["no"], change=change, status=told["status"], reason=told["reason"], attempts=told["attempts"], due=told["due"], text=s["text"], locator=s["locator"], created=s["created"], updated=told["updated"])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = self._load()
        s = old
        for event in rows:
            s = with_event(s, event)
        if s == old:
            return
        told = outcome(s)
        new = old["no"] == 0 or told != outcome(old) or any(s[c] != old[c] for c in ("text", "locator", "created"))
        if told["due"] != old["due"]:
            if old["due"] is not None:
                self.handle.deleteTimer(_millis(old["due"]))
            if told["due"] is not None:
                self.handle.registerTimer(_millis(told["due"]))
            s["due"] = told["due"]
        s["no"] = old["no"] + int(new)
        self.state.update(tuple(s[c] for c in EMPTY))
        if new:
            yield self._row(key, s, "state")

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        s = self._load()
        if s["due"] is not None and _millis(s["due"]) == expiredTimerInfo.getExpiryTimeInMs():
            row = self._row(key, s | {"no": s["no"] + 1}, "retry")
            s |= {"due": None, "no": s["no"] + 1}
            self.state.update(tuple(s[c] for c in EMPTY))
            yield row

    def close(self) -> None:
        pass


def changes(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Each change of a clause's state, numbered, and a row when it is due again
    (change is state or retry)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    found = timed.groupBy("job", "clause").transformWithState(ClauseProcessor(), _MICROS, "Append", "EventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("due", "created", "updated")})


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Stateful processors need this state store; what was set comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def run(events: DataFrame, target: str, checkpoint: str, late: str = "0 seconds") -> None:
    """Take in what events there are; a state table of the changes is kept at target, and a log beside it."""
    spark = events.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/log/batch={number}")
        rows = spark.read.schema(CHANGES).parquet(f"{target}/log/batch={number}")
        checkpoints.last_rows(rows.selectExpr("*", f"{number}L as batch"), ["job", "clause"], ["no"]).drop("batch").write.mode("overwrite").parquet(f"{target}/states/batch={number}")
        if number % 10 == 9:
            checkpoints.compact(spark, f"{target}/states", ["job", "clause"], ["no"])

    with _rocksdb(spark):
        changes(events, late).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def states(spark: SparkSession, target: str) -> DataFrame:
    """Each clause's state now."""
    return checkpoints.current(spark, f"{target}/states", ["job", "clause"], ["no"]).drop("change")


def log(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(CHANGES).parquet(*[f"{target}/log/batch={n}" for n in checkpoints._numbers(spark, f"{target}/log", "batch")])
