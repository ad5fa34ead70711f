"""Streams with state against the batch, event by event, over restarts and shuffled arrivals."""

import json
import random

import pytest

from panelweft.operators import survey
from panelweft.streaming import live, stateful

EVENTS = "k string, t timestamp, reply string"
RESPONSES = "response_id int, phone string, consent string, country string, interview_duration_sec string"


def put(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def states(spark, folder, target, checkpoint, **options):
    """Run what is there, and the last state of each respondent so far."""
    s = stateful.questionnaire(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(folder)), key="k", time="t", n_questions=3, **options)
    q = s.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{target}/trigger={n}")).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    out = {}
    for r in sorted(spark.read.parquet(str(target)).collect(), key=lambda r: r["trigger"]):
        out[r["k"]] = (r["status"], r["step"])
    return out


def test_questionnaire_is_advance_over_restarts(spark, tmp_path):
    rng, folder = random.Random(3), tmp_path / "in"
    folder.mkdir()
    want, files = {}, []
    for n in range(6):
        files.append([{"k": k, "t": f"2024-01-01T00:{n:02}:{i:02}Z", "reply": rng.choice(["yes", " ", None])} for i, k in enumerate(rng.sample("abcdefgh", 5))])
    state = spark.createDataFrame([], "k string, status string, step int")
    for n, rows in enumerate(files):
        put(folder, f"{n}.json", rows)
        state = survey.advance(state, spark.createDataFrame([(r["k"], r["reply"]) for r in rows], "k string, reply string"), key="k", n_questions=3)
        want = {r["k"]: (r["status"], r["step"]) for r in state.collect()}
        state = spark.createDataFrame([(k, *v) for k, v in want.items()], "k string, status string, step int")
        if n in (2, 5):  # stop and start again from the checkpoint
            assert states(spark, folder, tmp_path / "out", tmp_path / "cp") == want


def test_silent_respondents_leave_the_state(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "0.json", [{"k": "a", "t": "2024-01-01T00:00:00Z", "reply": "x"}, {"k": "b", "t": "2024-01-01T00:00:00Z"}, *({"k": "c", "t": f"2024-01-01T00:00:0{i}Z", "reply": "x"} for i in range(4)), {"k": "d", "reply": "no time"}])
    put(folder, "1.json", [{"k": "a", "t": "2024-01-01T00:30:00Z", "reply": "x"}])
    put(folder, "2.json", [{"k": "z", "t": "2024-01-01T01:20:00Z", "reply": "x"}])
    put(folder, "3.json", [{"k": "z", "t": "2024-01-01T01:20:01Z", "reply": "x"}])
    got = states(spark, folder, tmp_path / "out", tmp_path / "cp", expire_seconds=3600, late="0 seconds")
    assert got == {"a": ("awaiting_reply", 1), "b": ("expired", 0), "c": ("completed", 3), "z": ("awaiting_reply", 1)}
    put(folder, "4.json", [{"k": "b", "t": "2024-01-01T01:20:02Z", "reply": "again"}, {"k": "c", "t": "2024-01-01T01:20:02Z", "reply": "again"}])
    got = states(spark, folder, tmp_path / "out", tmp_path / "cp", expire_seconds=3600, late="0 seconds")
    assert got["b"] == ("awaiting_reply", 0) and got["c"] == ("awaiting_reply", 0)  # both enrolled anew
    with pytest.raises(ValueError):
        stateful.questionnaire(spark.createDataFrame([], EVENTS), key="k", time="t", n_questions=0)


def test_eligibility_takes_verdicts_back(spark, tmp_path):
    rng, folder = random.Random(5), tmp_path / "in"
    folder.mkdir()
    rows = [{"response_id": i, "phone": rng.choice(["", None, *"abcdef"]), "consent": rng.choice(["yes", "yes", "1", "no"]), "country": rng.choice(["x", "x", " "]), "interview_duration_sec": rng.choice(["300", "300", "5", None])} for i in range(60)]
    rng.shuffle(rows)
    rules = {"order": "response_id", "required": ("consent", "country")}
    for n in range(6):
        put(folder, f"{n}.json", rows[10 * n : 10 * n + 10])
        if n not in (2, 5):
            continue
        stream = stateful.eligibility(live.responses(spark, str(folder), RESPONSES), **rules)
        q = stateful.store_eligibility(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(300)
        assert q.exception() is None
        got = {r["response_id"]: r["reason"] for r in stateful.latest(spark, str(tmp_path / "out")).collect()}
        want = {r["response_id"]: r["reason"] for r in survey.with_eligibility(spark.read.schema(RESPONSES).json(str(folder)), **rules).collect()}
        assert got == want and len(got) == 10 * n + 10
    read = sum(p["numInputRows"] for p in q.recentProgress)
    assert read == 30  # the second run read the new files alone


def test_a_call_judges_many_phones():
    """A group of phones over two triggers, responses without phone or order among them: nulls come first, as in the batch."""

    class State(dict):
        getValue, updateValue = dict.get, dict.__setitem__  # noqa: N815

    one = stateful._FirstCome("int", "int")
    one.first, got, rng = State(), {}, random.Random(7)
    rows = [{"phone": rng.choice(["a", "b", "c", None]), "rank": rng.choice([None, 1, 2, 3]), "id": i, "reason": "first", "otherwise": "later"} for i in range(40)]
    rng.shuffle(rows)
    for part in (rows[:15], rows[15:]):
        got |= {r["id"]: r["reason"] for r in one.handleInputRows((5,), iter(part), None)}
    heads = {p: min(((r["rank"] is not None, r["rank"] or 0, r["id"]) for r in rows if r["phone"] == p))[2] for p in "abc"}
    assert got == {r["id"]: "first" if r["phone"] is None or heads[r["phone"]] == r["id"] else "later" for r in rows}
    assert set(one.first) == {("a",), ("b",), ("c",)}
