"""State of conversation threads, as a stream with keyed state and as its batch twin; and review of arriving scripts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.functions.text import clean
from granary.sources.shared import written

MAX_ROUNDS, MAX_RETRIES = 3, 1
#: What happens in a thread; other events change nothing.
EVENTS = ("start", "clarification", "answer", "attempt_failed", "attempt_passed")
STATE = "turn_no int, clarification_round int, attempt int, status string, last_seq long, last_at long"
#: An event that waits for its turn; at in milliseconds.
WAITING = "seq long, event string, text string, at long"
#: Statuses after which only a start goes on.
ENDED = ("failed", "deny", "pass")


def step(state: tuple[int, int, int, str, int], seq: int, event: str, text: str | None, max_rounds: int = MAX_ROUNDS, max_retries: int = MAX_RETRIES) -> tuple[int, int, int, str, int]:
    """One event. A start resets the turn. A clarification waits for an answer, or at the most rounds fails the turn; an
    answer adds a round and resets the attempts, a blank one fails the turn. A failed turn heeds nothing but a start."""
    turn, rounds, attempt, status, _ = state
    if event == "start":
        return turn + 1, 0, 0, "open", seq
    if status in ("failed", "none"):
        return turn, rounds, attempt, status, seq
    if event == "clarification":
        status = "failed" if rounds >= max_rounds else "clarify"
    elif event == "answer":
        if (text or "").strip():
            rounds, attempt, status = rounds + 1, 0, "open"
        else:
            status = "failed"
    elif event == "attempt_failed":
        attempt += 1
        status = "retry" if attempt <= max_retries else "deny"
    elif event == "attempt_passed":
        status = "pass"
    return turn, rounds, attempt, status, seq


def thread_state(events: DataFrame, max_rounds: int = MAX_ROUNDS, max_retries: int = MAX_RETRIES) -> DataFrame:
    """(thread_id, turn_no, clarification_round, attempt, status) of rows (thread_id, seq, event, text), by window sums.

    Rows that repeat a thread and seq are one event, the least of them. Only the last turn counts; of it the events up to the one that fails it: the first blank answer, or clarification after
    the most rounds. Attempts count from the last answer."""
    e = F.col("event")
    events = events.groupBy("thread_id", "seq").agg(F.min(F.struct("event", F.coalesce("text", F.lit("")).alias("text"))).alias("x")).select("thread_id", "seq", "x.event", "x.text").filter(e.isin(*EVENTS))
    starts = events.groupBy("thread_id").agg(F.count_if(e == "start").cast("int").alias("turn_no"), F.max(F.when(e == "start", F.col("seq"))).alias("start_seq"))
    last = events.join(starts, "thread_id").filter("seq > start_seq")
    answer = (e == "answer") & (clean("text") != "")
    up_to = Window.partitionBy("thread_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = last.withColumn("rounds", F.count_if(answer).over(up_to))
    fails = ((e == "answer") & ~answer) | ((e == "clarification") & (F.col("rounds") >= max_rounds))
    rows = rows.withColumn("failing", fails).withColumn("n_fails", F.count_if(fails).over(up_to))
    alive = (F.col("n_fails") == 0) | ((F.col("n_fails") == 1) & F.col("failing"))
    rows = rows.filter(alive)
    by = rows.groupBy("thread_id").agg(
        F.max("rounds").cast("int").alias("rounds"),
        F.bool_or("failing").alias("failed"),
        F.max_by("event", "seq").alias("final"),
        F.max(F.when(answer, F.col("seq"))).alias("answer_seq"),
    )
    tries = rows.join(by.select("thread_id", "answer_seq"), "thread_id").filter((e == "attempt_failed") & (F.col("answer_seq").isNull() | (F.col("seq") > F.col("answer_seq")))).groupBy("thread_id").agg(F.count("*").cast("int").alias("attempt"))
    out = starts.join(by, "thread_id", "left").join(tries, "thread_id", "left")
    attempt = F.coalesce("attempt", F.lit(0))
    status = F.when(F.col("turn_no") == 0, "none").when(F.col("failed"), "failed").when(F.col("final") == "clarification", "clarify").when(F.col("final") == "attempt_passed", "pass").when(F.col("final") == "attempt_failed", F.when(attempt <= max_retries, "retry").otherwise("deny")).otherwise("open")
    return out.select("thread_id", "turn_no", F.coalesce("rounds", F.lit(0)).alias("clarification_round"), attempt.alias("attempt"), status.alias("status"))


class ThreadProcessor(StatefulProcessor):
    """Keeps a thread's state across micro-batches. Events wait in list state until the watermark has passed their time, as
    until then an earlier one may come; a timer at that time applies them in the order of seq."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("thread", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = set()
        for frame in rows:
            for r in frame.itertuples():
                at = int(r.at.timestamp() * 1000)
                self.waiting.appendValue((int(r.seq), r.event, r.text if isinstance(r.text, str) else "", at))
                times.add(at)
        for at in times:
            self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in held if r[3] <= now], [r for r in held if r[3] > now]
        *state, last_at = tuple(self.state.get()) if self.state.exists() else (0, 0, 0, "none", -1, 0)
        if not due:
            if state[3] in ENDED and now >= last_at + self.keep_ms:
                self.state.clear()
            return
        state = tuple(state)
        for seq, event, text, at in sorted(due):
            if seq > state[4]:  # a row that comes again is not counted again
                state, last_at = step(state, seq, event, text), max(last_at, at)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if state[3] in ENDED:
            self.handle.registerTimer(last_at + self.keep_ms)
        self.state.update((*state, last_at))
        yield pd.DataFrame({"thread_id": [key[0]], "turn_no": [state[0]], "clarification_round": [state[1]], "attempt": [state[2]], "status": [state[3]]})

    def close(self) -> None:
        pass


def thread_stream(events: DataFrame, delay: str = "1 hour", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """The same of a stream (thread_id, seq, event, text, at), in update mode: a thread's new state once the watermark, the
    greatest `at` less the delay, has passed events of it.

    Events may come in any order within the delay; the states are then those of the batch twin, whose order is seq: `at`
    must not fall as seq rises. Events behind the watermark are lost, as Spark drops them. The last events of a stream wait
    until later ones, of any thread, move the watermark. A thread whose turn has ended and that was silent for keep_ms is
    forgotten: its state goes, and a start after that is its turn 1."""
    watched = events.withWatermark("at", delay)
    schema = "thread_id long, turn_no int, clarification_round int, attempt int, status string"
    return watched.groupBy("thread_id").transformWithStateInPandas(ThreadProcessor(keep_ms), outputStructType=schema, outputMode="Update", timeMode="EventTime")


def review_stream(scripts: DataFrame, path: str, checkpoint: str, registry: Any = None, near: str = "1 hour") -> Any:
    """Rule issues of arriving scripts (script_id, mode, sql), written under path. A script is reviewed once by its id,
    however often it comes again.

    Repeats within `near` are dropped in the stream, whose state so has a bound; later ones by an anti-join to the ids that
    earlier batches have written, under path.ids. A batch writes folders of its own, so that one that runs again after a
    failure replaces itself."""
    from granary.operators.facts import facts
    from granary.operators.rules import default_registry

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = written(batch.drop("arrived"), "arrived")
        try:
            earlier = spark.read.parquet(f"{path}.ids").filter(F.col("batch") < number).select("script_id")
        except AnalysisException:  # nothing was written yet
            earlier = new.select("script_id").limit(0)
        new = new.join(earlier, "script_id", "left_anti")
        (registry or default_registry()).issues(facts(new)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        new.select("script_id").write.mode("overwrite").parquet(f"{path}.ids/batch={number}")

    once = scripts.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", near).dropDuplicatesWithinWatermark(["script_id"])
    return once.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
