"""Keyed state in streams: questionnaires that expire, and first-come eligibility that takes verdicts back.

Both keep a row of state a key in RocksDB, so state may outgrow memory, and read each event
once: no trigger looks at what came before but for the state of the keys that have news.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from panelweft.functions.exprs import is_blank
from panelweft.operators.survey import verdicts
from panelweft.session import by_value, ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _prepared(spark: SparkSession) -> None:
    ship(spark)
    by_value(__name__)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the only one that keeps such state


class _Questionnaire(StatefulProcessor):
    def __init__(self, key: str, n_questions: int, expire_ms: int) -> None:
        self.key, self.n, self.expire_ms = key, n_questions, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "status string, step int, due long")

    def _row(self, key, status: str, step: int) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "status": [status], "step": pd.array([step], "int32")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, step, due = self.progress.get() if self.progress.exists() else ("ready", 0, None)
        news = pd.concat(list(rows)).sort_values(["at", "said"], kind="stable")
        for said in news["said"]:
            if status == "ready":
                status = "awaiting_reply"
            elif status == "awaiting_reply" and said:
                step += 1
                status = "completed" if step >= self.n else status
        last = int(news["at"].max()) + self.expire_ms
        if due is None or last > due:
            if due is not None:
                self.handle.deleteTimer(due)
            due = last
            self.handle.registerTimer(due)
        self.progress.update((status, step, due))
        yield self._row(key, status, step)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, step, _ = self.progress.get()
        self.progress.clear()
        if status != "completed":
            yield self._row(key, "expired", step)

    def close(self) -> None:
        pass


def questionnaire(events: DataFrame, *, key: str, time: str, n_questions: int, reply: str = "reply", expire_seconds: int = 7 * 86400, late: str = "10 minutes") -> DataFrame:
    """(key, status, step) of the respondents that have news, by survey.advance() in order of arrival; for output mode update.

    Those of one trigger come by time, a blank one first.  A respondent who is silent for
    expire_seconds leaves the state, with status `expired` unless completed, and is enrolled
    anew by a later event.  Events later than `late`, and those without a time, are left out; a
    null key is a respondent.
    """
    if n_questions < 1:
        raise ValueError("a questionnaire has questions")
    _prepared(events.sparkSession)
    held = events.withWatermark(time, late).select(F.col(key), F.col(time), F.unix_millis(F.col(time).cast("timestamp")).alias("at"), (~is_blank(reply)).alias("said")).filter(F.col("at").isNotNull())
    schema = f"`{key}` {events.schema[key].dataType.simpleString()}, status string, step int"
    return held.groupBy(key).transformWithStateInPandas(_Questionnaire(key, n_questions, expire_seconds * 1000), schema, "Update", "EventTime")


#: Groups that phones are dealt to: a call of the processor has many phones, and reads and writes the state of those with news.
PHONE_GROUPS = 4096


class _FirstCome(StatefulProcessor):
    """State, by phone: order, id and the verdict as a duplicate of its first response so far.

    What a call costs is far more than what a phone costs, so a call isn't a phone; rows are
    plain, not frames, and of a trigger only the first of each phone are held.
    """

    def __init__(self, order_type: str, id_type: str) -> None:
        self.schema = f"rank {order_type}, id {id_type}, otherwise string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "phone string", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = lambda a, b: (a[0] is not None, a[0], a[1]) < (b[0] is not None, b[0], b[1])  # noqa: E731  no order: first
        heads: dict[str, tuple] = {}
        for r in rows:
            if r["phone"] is None:  # without a phone nothing is a duplicate, and nothing is remembered
                yield Row(id=r["id"], reason=r["reason"])
                continue
            phone, new = r["phone"], (r["rank"], r["id"], r["otherwise"], r["reason"])
            head = heads.setdefault(phone, new)
            if head is not new:
                if before(new, head):
                    heads[phone], new = new, head
                yield Row(id=new[1], reason=new[2])
        for phone, head in heads.items():
            known = self.first.getValue((phone,))
            if known is not None and not before(head, known):
                yield Row(id=head[1], reason=head[2])
                continue
            yield Row(id=head[1], reason=head[3])
            if known is not None:  # the one that was first is so no more
                yield Row(id=known[1], reason=known[2])
            self.first.updateValue((phone,), head[:3])

    def close(self) -> None:
        pass


def eligibility(responses: DataFrame, *, order: str, id_col: str = "response_id", **rules) -> DataFrame:
    """(id_col, reason) as verdicts change, for output mode update: survey.with_eligibility() of all responses so far.

    A response that is earlier by order than its phone's first one so far takes that one's place,
    and goes out with it.  Responses without a phone have no state; phones never leave it, as a
    first-come rule asks.  Each id and order is unique.
    """
    _prepared(responses.sparkSession)
    judged = verdicts(responses, **rules).select(F.col("_hash").alias("phone"), F.col(order).alias("rank"), F.col(id_col).alias("id"), F.col("_if_first").alias("reason"), F.col("_if_later").alias("otherwise"))
    kinds = {f.name: f.dataType.simpleString() for f in judged.schema.fields}
    keyed = judged.withColumn("_group", F.pmod(F.xxhash64(F.coalesce("phone", F.col("id").cast("string"))), F.lit(PHONE_GROUPS))).groupBy("_group")
    return keyed.transformWithState(_FirstCome(kinds["rank"], kinds["id"]), f"id {kinds['id']}, reason string", "Update", "None").withColumnRenamed("id", id_col)


def store_eligibility(verdict_stream: DataFrame, target: str, checkpoint: str, *, seconds: int | None = None) -> StreamingQuery:
    """Append verdicts as they change under target, a folder a trigger, written anew if the trigger is; seconds None: what is there, then stop."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/trigger={number}")

    w = verdict_stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if seconds is None else w.trigger(processingTime=f"{max(5, seconds)} seconds")).start()


def latest(spark: SparkSession, target: str, keys: Sequence[str] = ("response_id",)) -> DataFrame:
    """The last verdict of each response under target."""
    log = spark.read.parquet(target)
    return log.groupBy(*keys).agg(F.max_by("reason", "trigger").alias("reason"))
