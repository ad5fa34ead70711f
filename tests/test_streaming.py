"""The stream gives what the batch gives."""

import json
import random

from panelweft.operators.survey import with_eligibility
from panelweft.streaming import live, stateful

SCHEMA = "response_id int, phone string, consent string, country string, interview_duration_sec string"


def test_stream_is_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.json").write_text("".join(json.dumps({"response_id": 3 * k + i, "phone": f"p{i}", "consent": "yes", "country": "x"}) + "\n" for i in range(3)))
    q = live.live_eligibility(spark, str(folder), SCHEMA, str(tmp_path / "out"), str(tmp_path / "cp"), order="response_id", required=("consent", "country"))
    q.awaitTermination(120)
    got = {(r["response_id"], r["reason"]) for r in stateful.latest(spark, str(tmp_path / "out")).collect()}
    want = {(r["response_id"], r["reason"]) for r in with_eligibility(spark.read.schema(SCHEMA).json(str(folder)), order="response_id", required=("consent", "country")).collect()}
    assert got == want and len(got) == 9


def test_rolling_articles(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"id": 1, "t": "2024-01-01T00:00:00Z"}\n{"id": 1, "t": "2024-01-02T00:00:00Z"}\n{"id": 2, "t": "2024-01-01T00:00:00Z"}\n{"id": 3}\n{"id": 3}\n')
    s = live.rolling_articles(spark.readStream.schema("id int, t timestamp").json(str(folder)), key="id", published="t")
    q = s.writeStream.format("memory").queryName("articles").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.table("articles").collect()) == [1, 2, 3]


def test_questionnaire_is_advance_event_by_event(spark, tmp_path):
    rng, folder = random.Random(3), tmp_path / "in"
    folder.mkdir()
    events = [{"k": rng.choice("abcdefgh"), "t": f"2024-01-01T00:00:{i:02}Z", "reply": rng.choice(["yes", " ", None])} for i in range(40)]
    rng.shuffle(events)
    for n in range(4):
        (folder / f"{n}.json").write_text("".join(json.dumps(e) + "\n" for e in events[n::4]))
    want = {}
    for e in sorted(events, key=lambda e: e["t"]):  # by the rules of survey.advance()
        status, step = want.get(e["k"], ("ready", 0))
        step += status == "awaiting_reply" and bool((e["reply"] or "").strip())
        want[e["k"]] = ("completed" if step >= 3 else "awaiting_reply", step)
    schema = "k string, t timestamp, reply string"
    batch = live.questionnaire(spark.read.schema(schema).json(str(folder)), key="k", time="t", n_questions=3)
    assert {r["k"]: (r["status"], r["step"]) for r in batch.collect()} == want
    stream = live.questionnaire(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)), key="k", time="t", n_questions=3)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["k"]: (r["status"], r["step"]) for r in spark.table("states").collect()} == want
    assert live.questionnaire(spark.createDataFrame([], schema), key="k", time="t", n_questions=3).count() == 0
