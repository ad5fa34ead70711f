"""Live processing: the batch operators on file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelweft.functions.exprs import is_blank
from panelweft.streaming import stateful


def responses(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Response files as they arrive."""
    return spark.readStream.schema(schema).json(folder)


def live_eligibility(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, *, order: str, seconds: int | None = None, **rules) -> StreamingQuery:
    """Eligibility of all responses so far: each trigger reads what is new and appends the verdicts that it makes or takes back (stateful.latest() reads them).

    seconds None: what is there, then stop.
    """
    return stateful.store_eligibility(stateful.eligibility(responses(spark, folder, schema), order=order, **rules), target, checkpoint, seconds=seconds)


def rolling_articles(stream: DataFrame, *, key: str, published: str, days: int = 14) -> DataFrame:
    """Each article once within the look-back; state older than that is dropped.

    Undated articles are kept once for ever, as the batch intake keeps them; their keys stay in the state.
    """
    dated = stream.filter(F.col(published).isNotNull()).withWatermark(published, f"{days} days").dropDuplicatesWithinWatermark([key])
    return dated.unionByName(stream.filter(F.col(published).isNull()).dropDuplicates([key]))


def suppressed(stream: DataFrame, *, key: str, time: str, seconds: int = 120) -> DataFrame:
    """Messages without repeats of a key within so many seconds."""
    return stream.withWatermark(time, f"{seconds} seconds").dropDuplicatesWithinWatermark([key])


def activity(stream: DataFrame, *, time: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, by, n, total): counts by time window, late events within the watermark included."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"))


def questionnaire(events: DataFrame, *, key: str, time: str, n_questions: int, reply: str = "reply") -> DataFrame:
    """(key, status, step) of each respondent after all events so far: survey.advance(), event by event.

    The first event enrols and sends the first question, whatever it says; of the later ones each
    that isn't blank answers a question.  Of events at one time a blank one is the first.  For batches
    and, in update mode, for streams: the state is one row a respondent and doesn't expire, and late
    events count as if they had come in time.  A null key is a respondent; events without a time come first.
    """
    if n_questions < 1:
        raise ValueError("a questionnaire has questions")
    said = ~is_blank(reply)
    g = events.groupBy(key).agg(F.count_if(said).alias("_n"), F.min(F.struct(F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(1 << 63))).alias("t"), said.alias("said"))).alias("_first"))
    step = F.least(F.col("_n") - F.col("_first.said").cast("int"), F.lit(n_questions)).cast("int")
    return g.select(key, F.when(step == n_questions, "completed").otherwise("awaiting_reply").alias("status"), step.alias("step"))
