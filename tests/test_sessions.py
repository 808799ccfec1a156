"""The state machine: its table, and batch against stream."""

import pytest
from pyspark.sql import functions as F

from tesselar.operators import sessions
from tesselar.streaming.sessions import follow

CASES = [
    ("none", "start", "open", None), ("open", "start", "open", "illegal_transition"), ("aborted", "start", "open", None), ("open", "agent_question", "waiting_for_user", None),
    ("open", "user_answer", "open", "alternation_violation"), ("waiting_for_user", "agent_question", "waiting_for_user", "alternation_violation"), ("waiting_for_agent", "finalize", "finalized", None),
    ("open", "finalize", "open", "no_clarification_round"), ("waiting_for_user", "finalize", "waiting_for_user", "unanswered_question"), ("finalized", "abort", "finalized", "already_finalized"), ("aborted", "user_answer", "aborted", "already_aborted"),
]


@pytest.mark.parametrize("state,event,after,why", CASES)
def test_transitions(state, event, after, why):
    assert sessions.next_state(state, event) == (after, why)


def events(spark):
    rows = [("s", i, e) for i, e in enumerate(["start", "user_answer", "agent_question", "user_answer", "finalize", "abort"])] + [("t", i, e) for i, e in enumerate(["start", "abort", "start", "finalize"])]
    return spark.createDataFrame(rows, "session string, seq long, kind string")


def test_replay(spark):
    got = {r["session"]: (r["state"], r["turn_count"], [x["reason"] for x in r["refused"]]) for r in sessions.replay(events(spark), "session", "seq", "kind").collect()}
    assert got == {"s": ("finalized", 2, ["alternation_violation", "already_finalized"]), "t": ("open", 0, ["no_clarification_round"])}


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    events(spark).where("seq < 3").write.parquet(source)
    stream = spark.readStream.schema("session string, seq long, kind string").parquet(source)
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = follow(stream, "session", "seq", "kind").writeStream.outputMode("append").format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        events(spark).where("seq >= 2").write.mode("append").parquet(source)  # seq 2 comes twice
        q.processAllAvailable()
        last = spark.table("followed").groupBy("session").agg(F.max_by("state", "seq").alias("state"), F.max_by("turn_count", "seq").alias("n"), F.count("*").alias("rows"))
        assert {r["session"]: (r["state"], r["n"], r["rows"]) for r in last.collect()} == {"s": ("finalized", 2, 6), "t": ("open", 0, 4)}
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", conf)


def test_digest(spark):
    import hashlib
    import json

    rows = [("s", 1, "agent_question", "t1", "q é", None), ("s", 2, "user_answer", "t2", "a", '"m"')]
    df = spark.createDataFrame(rows, "k string, seq long, kind string, timestamp string, content string, meta string")
    want = json.dumps([{"seq": 1, "kind": "agent_question", "timestamp": "t1", "content": "q é"}, {"seq": 2, "kind": "user_answer", "timestamp": "t2", "content": "a", "meta": '"m"'}], separators=(",", ":"), ensure_ascii=False).encode()
    got = sessions.json_digest(df, "k").first()
    assert got["digest"] == hashlib.sha256(want).hexdigest() and got["n_bytes"] == len(want)
