"""Survey events: collapse of question rows, eligibility, exports, monitoring, outreach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweft.functions.exprs import _col, is_blank, row_mean, salted_hash, to_bool, to_number
from panelweft.operators.panel import select_or_null, unpivot

#: Fields that a complete response has.
REQUIRED = (
    "consent", "participant_role", "organization_type", "country", "task_completed", "usefulness_score_1to5", "ease_of_use_score_1to5",
    "interpretability_score_1to5", "trust_in_results_score_1to5", "policy_actionability_score_1to5", "would_recommend_1to5",
    "acc_connectivity_reliability", "skl_self_efficacy_digital_tasks", "eco_digital_payments_use", "srv_gov_service_completion_digital",
    "agr_control_over_phone_account", "out_perceived_welfare_change",
)
SCORES, DOMAINS = REQUIRED[5:11], REQUIRED[11:]


def _micros(time):
    return F.unix_micros(F.col(time).cast("timestamp"))


def collapse(events: DataFrame, *, key: str, question: str, value: str, order: Sequence, questions: Sequence[str]) -> DataFrame:
    """Question rows to one row a call: of each question the last answer; unknown questions are ignored."""
    rank = F.struct(*[_col(c).alias(f"o{i}") for i, c in enumerate(order)])
    return events.filter(F.col(question).isin(list(questions))).groupBy(key).pivot(question, list(questions)).agg(F.max_by(value, rank))


def verdicts(rows: DataFrame, *, required: Sequence[str] = REQUIRED, min_duration: int = 120, max_duration: int = 1800, salt: str = "", phone: str = "phone") -> DataFrame:
    """rows with _hash of the phone, and the reason of a phone's first (_if_first) and of a later response (_if_later)."""
    have = set(rows.columns)
    hashed = F.when(~is_blank(phone), salted_hash(phone, salt)) if phone in have else F.lit(None).cast("string")
    if "phone_hash" in have:
        hashed = F.coalesce(hashed, F.when(~is_blank("phone_hash"), F.trim("phone_hash")))
    missing = F.lit(False)
    for f in required:
        missing = missing | (is_blank(f) if f in have else F.lit(True))
    duration = F.coalesce(to_number("interview_duration_sec").cast("int"), F.lit(0)) if "interview_duration_sec" in have else F.lit(0)
    consent = F.coalesce(F.lower(F.trim(F.col("consent").cast("string"))), F.lit("")).isin("yes", "1")
    breakoff = to_bool("breakoff_flag") if "breakoff_flag" in have else F.lit(False)
    denied = F.when(~consent, "consent_not_granted")
    first = (
        denied.when(breakoff, "breakoff_detected").when(missing, "missing_required_fields")
        .when((duration != 0) & ((duration < min_duration) | (duration > max_duration)), "duration_outlier").otherwise("eligible_full_completion")
    )
    return rows.withColumns({"_hash": hashed, "_if_first": first, "_if_later": denied.otherwise("duplicate_response")})


def with_eligibility(rows: DataFrame, *, order: str, **rules) -> DataFrame:
    """rows with completion_status, eligible and reason; strict order: consent, duplicate, breakoff, missing, duration.

    A phone's later responses are duplicates, whether or not the first was eligible; a
    duration of 0 is unknown; rows without a phone are never duplicates.  rules: those of verdicts().
    """
    nth = F.row_number().over(Window.partitionBy("_hash", F.when(F.col("_hash").isNull(), F.col(order))).orderBy(order))
    reason = F.when(F.col("_hash").isNotNull() & (F.col("_nth") > 1), F.col("_if_later")).otherwise(F.col("_if_first"))
    status = F.when(F.col("reason").isin("breakoff_detected", "missing_required_fields"), "partial").when(F.col("reason") == "eligible_full_completion", "complete").otherwise("invalid")
    out = verdicts(rows, **rules).withColumn("_nth", nth).withColumn("reason", reason)
    return out.withColumns({"completion_status": status, "eligible": F.col("reason") == "eligible_full_completion", "phone_hash": F.col("_hash")}).drop("_hash", "_nth", "_if_first", "_if_later")


def payouts(classified: DataFrame, amount: float, currency: str = "INR") -> DataFrame:
    """Eligible responses with what they are owed, for review."""
    return classified.filter("eligible").select("response_id", "phone_hash", F.lit(amount).alias("amount"), F.lit(currency).alias("currency"), F.lit("pending_review").alias("payout_status"))


def primary_export(rows: DataFrame, eligibility: DataFrame, *, scores: Sequence[str] = SCORES, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """Responses with mean score and mean of domains, beside their eligibility."""
    typed = select_or_null(rows, ["response_id", *scores, *domains]).withColumns({c: to_number(c) for c in (*scores, *domains)})
    out = typed.withColumns({"usability_mean": row_mean(scores), "domain_mean": row_mean(domains)})
    return out.join(eligibility.select("response_id", "completion_status", "eligible", "reason"), "response_id", "left")


def long_export(export: DataFrame, *, fields: Sequence[str] = (*SCORES, *DOMAINS)) -> DataFrame:
    """A row for each response and field."""
    return unpivot(export, ["response_id"], fields, "field", "value")


def experience_report(export: DataFrame, classified: DataFrame, scores: Sequence[str] = SCORES[:5]) -> DataFrame:
    """One row: responses, completed share, eligible ones, mean scores, and mean_duration of what classified has as interview_duration_sec (0 if unknown)."""
    timed = "interview_duration_sec" in classified.columns
    duration = [F.coalesce(F.avg(to_number("interview_duration_sec")), F.lit(0.0)).alias("mean_duration")] if timed else []
    a = classified.agg(*duration, F.count("*").alias("n"), F.round(100 * F.avg((F.col("completion_status") == "complete").cast("double")), 2).alias("completion_pct"), F.count_if("eligible").alias("n_eligible"))
    b = export.agg(*[F.avg(s).alias(f"mean_{s}") for s in scores])
    return a.crossJoin(F.broadcast(b))  # one row each


def without_resends(events: DataFrame, *, key: str, time: str, seconds: int = 120) -> DataFrame:
    """Events that don't follow one of the same key within so many seconds."""
    w = Window.partitionBy(key).orderBy(time)
    gap = _micros(time) - F.lag(_micros(time)).over(w)
    return events.withColumn("_g", gap).filter(F.col("_g").isNull() | (F.col("_g") >= seconds * 1_000_000)).drop("_g")


def status_counts(events: DataFrame, column: str) -> DataFrame:
    """(value, n), null too."""
    return events.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def outreach_queue(contacts: DataFrame, template: str, *, phone: str = "phone", name: str = "name", opted: str = "opted_in", base: str = "https://wa.me/") -> DataFrame:
    """Opted-in contacts with a message and its link; template has one %s for the name."""
    digits = F.regexp_replace(F.col(phone).cast("string"), r"\D", "")
    out = contacts.filter(to_bool(opted) & (digits != "")).withColumn("message", F.format_string(template, F.coalesce(name, F.lit(""))))
    return out.withColumn("link", F.concat(F.lit(base), digits, F.lit("?text="), F.url_encode("message")))


def advance(state: DataFrame, replies: DataFrame, *, key: str, n_questions: int) -> DataFrame:
    """Questionnaire state after replies: ready -> awaiting_reply -> ... -> completed.

    state: key, status, step; replies: key, reply (at most one a key).  Keys without state are ready.
    """
    joined = state.join(replies.select(key, "reply"), key, "full_outer")
    status, step = F.coalesce("status", F.lit("ready")), F.coalesce("step", F.lit(0))
    answered = (status == "awaiting_reply") & ~is_blank("reply")
    new_step = F.when(answered, step + 1).otherwise(step)
    new = F.when(status == "completed", "completed").when(answered & (new_step >= n_questions), "completed").when(status == "ready", "awaiting_reply").otherwise(status)
    return joined.select(key, new.alias("status"), new_step.cast("int").alias("step"))


def sessions(events: DataFrame, *, key: str, time: str, gap_seconds: int) -> DataFrame:
    """(key, session, n, started, ended): runs of events without a longer gap."""
    w = Window.partitionBy(key).orderBy(time)
    new = F.coalesce((_micros(time) - F.lag(_micros(time)).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(0))
    return events.withColumn("_n", new).withColumn("session", F.sum("_n").over(w.rangeBetween(Window.unboundedPreceding, 0))).groupBy(key, "session").agg(F.count("*").alias("n"), F.min(time).alias("started"), F.max(time).alias("ended"))


def question_message(step, name, *, intro: str, prompts: Sequence[str], closing: str):
    """The text of a step (from 0): the introduction and the first question, a later question, or after the last the closing; {name} is the respondent's."""
    n, named = len(prompts), lambda t: F.replace(F.lit(t), F.lit("{name}"), F.coalesce(_col(name), F.lit("")))
    out = named(closing)
    for k, prompt in reversed(list(enumerate(prompts))):
        line = F.lit(f"Q{k + 1}/{n}: {prompt}")
        out = F.when(_col(step) == k, F.concat(named(intro), F.lit("\n\n"), line) if k == 0 else line).otherwise(out)
    return out
