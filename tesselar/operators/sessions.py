"""Clarification sessions: a keyed state machine in batch, the transcript's digest, and merges of a run's index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States, the events that move between them, and why an event is refused.
NONE, OPEN, USER, AGENT, FINAL, ABORTED = "none", "open", "waiting_for_user", "waiting_for_agent", "finalized", "aborted"
TRANSITIONS = {
    (NONE, "start"): OPEN, (ABORTED, "start"): OPEN,
    (OPEN, "agent_question"): USER, (AGENT, "agent_question"): USER, (USER, "user_answer"): AGENT,
    (AGENT, "finalize"): FINAL, (OPEN, "abort"): ABORTED, (USER, "abort"): ABORTED, (AGENT, "abort"): ABORTED,
}
TERMINAL_REASONS = {FINAL: "already_finalized", ABORTED: "already_aborted"}
FINALIZE_REASONS = {OPEN: "no_clarification_round", USER: "unanswered_question"}
TURNS = ["agent_question", "user_answer"]


def next_state(state: str, event: str) -> tuple[str, str | None]:
    """The state after an event, and why the event is refused, if it is."""
    if (state, event) in TRANSITIONS:
        return TRANSITIONS[state, event], None
    if state in TERMINAL_REASONS:
        return state, TERMINAL_REASONS[state]
    if event in TURNS and state != NONE:
        return state, "alternation_violation"
    return state, FINALIZE_REASONS.get(state, "illegal_transition") if event == "finalize" else "illegal_transition"


def _lookup(state: Column, event: Column, what: int) -> Column:
    pairs = [(s, e) for s in (NONE, OPEN, USER, AGENT, FINAL, ABORTED) for e in ("start", *TURNS, "finalize", "abort")]
    table = F.create_map(*[F.lit(x) for s, e in pairs for x in (f"{s}/{e}", next_state(s, e)[what])])
    return F.try_element_at(table, F.concat_ws("/", state, event))


def replay(events: DataFrame, key: str, seq: str, kind: str, initial: str = NONE) -> DataFrame:
    """key, state, turn_count, refused (structs of seq and reason): each session's events in order, refused ones without effect.

    A fold over the session's sorted events, in one aggregation; a session is a unit of work by its nature.
    """
    ordered = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(kind).alias("kind")))).alias("events"))
    start = F.struct(F.lit(initial).alias("state"), F.lit(0).alias("turns"), F.array().cast("array<struct<seq:bigint,reason:string>>").alias("refused"))

    def step(acc: Column, x: Column) -> Column:
        why = _lookup(acc["state"], x["kind"], 1)
        legal = why.isNull()
        turn = F.when(legal & x["kind"].isin(TURNS), 1).otherwise(0)
        more = F.array(F.struct(x["seq"].cast("bigint").alias("seq"), why.alias("reason")))
        return F.struct(_lookup(acc["state"], x["kind"], 0).alias("state"), (acc["turns"] + turn).alias("turns"), F.when(legal, acc["refused"]).otherwise(F.concat(acc["refused"], more)).alias("refused"))

    folded = ordered.select(key, F.aggregate("events", start, step).alias("s"))
    return folded.select(key, F.col("s.state").alias("state"), F.col("s.turns").alias("turn_count"), F.col("s.refused").alias("refused"))


def completeness(turns: DataFrame, key: str, kind: str) -> DataFrame:
    """key, has_question, has_answer, complete."""
    asked, answered = F.bool_or(F.col(kind) == TURNS[0]), F.bool_or(F.col(kind) == TURNS[1])
    return turns.groupBy(key).agg(asked.alias("has_question"), answered.alias("has_answer"), (asked & answered).alias("complete"))


def digest(turns: DataFrame, key: str, seq: str, text: Column) -> DataFrame:
    """key, digest, n_bytes: SHA-256 of the turns' texts in order, joined by |."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), text.alias("text")))), lambda x: x["text"]), "|")
    return turns.groupBy(key).agg(joined.alias("t")).select(key, F.sha2("t", 256).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes"))


def json_digest(turns: DataFrame, key: str) -> DataFrame:
    """key, digest, n_bytes of the compact JSON array of turns (seq, kind, timestamp, content, meta); a null meta is left out."""
    array = F.to_json(F.array_sort(F.collect_list(F.struct("seq", "kind", "timestamp", "content", "meta"))))
    return turns.groupBy(key).agg(array.alias("t")).select(key, F.sha2("t", 256).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes"))


# Which columns of an existing index row outlive a new one, by the tool that writes it.
KEPT = {
    "replace": [],
    "preserve_downstream": ["orchestrator_version", "refined_at", "verified_at", "verified", "stage2_path"],
    "preserve_stage2": ["verified_at", "verified", "stage2_path"],
    "preserve_refined_only": ["artifact_path", "extractor_version", "orchestrator_version", "refined_at"],
}
INDEX_COLUMNS = ["artifact_path", "extractor_version", "orchestrator_version", "refined_at", "verified_at", "verified", "stage2_path"]


def merge_index(existing: DataFrame, new: DataFrame, mode: str, keys: tuple[str, ...] = ("run_id", "finding_id")) -> DataFrame:
    """The index after new rows: a full outer join by key, in which a mode says whose columns stay."""
    old, fresh = existing.select(*keys, F.struct(*INDEX_COLUMNS).alias("o")), new.select(*keys, F.struct(*INDEX_COLUMNS).alias("n"))
    joined = old.join(fresh, list(keys), "full")
    both = F.col("o").isNotNull() & F.col("n").isNotNull()

    def column(c: str) -> Column:
        stays = F.lit(c in KEPT[mode])
        if mode == "preserve_downstream" and c == "artifact_path":  # a refined artifact isn't replaced by an extracted one
            stays = F.col("o.refined_at").isNotNull()
        return F.when(both, F.when(stays, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*keys, *[column(c) for c in INDEX_COLUMNS])


def valid_findings(findings: DataFrame) -> DataFrame:
    """findings with `reason`: null, or what is missing. id, title and relevance_category must be there and not blank."""
    reason = F.lit(None).cast("string")
    for c in ("relevance_category", "title", "id"):
        reason = F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"missing_{c}")).otherwise(reason)
    return findings.withColumn("reason", reason)
