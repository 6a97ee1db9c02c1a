"""Model calls as events: reservations with limited attempts, ends, expiry (M08), and byte-checked reuse of successful calls.

Events are rows (generation, step, call_id, at, event_id, kind, status, response): kind `reserve` opens a call under its own id, `finish` ends one. The order
is (at, event_id). The batch form is windows and a join; the stream form keeps one small state a step of a generation.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Attempts a step may have, and ends that a call may come to. Fixed values.
MOST_ATTEMPTS, ENDS = 3, ("succeeded", "failed", "unknown")
STEP = ["generation", "step"]


def valid_end(status, response):
    """Whether a finish may end a call: a known end, and a response if it succeeded. On Columns."""
    return F.coalesce(status.isin(*ENDS) & ((status != "succeeded") | response.isNotNull()), F.lit(False))


def outcomes(events: DataFrame, attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """event_id, call_id, attempt and outcome of each event.

    A reservation is `reserved` with the next attempt of its step, or `attempts_exhausted` and never a call. The first finish after a
    call's reservation that is a valid end is `finished`; any other is `state_invalid`, and leaves the call as it was. The step of a
    call may have many events, all of them narrow; a call's id stands for one reservation.
    """
    if not 1 <= attempts <= MOST_ATTEMPTS:
        raise ValueError(f"a step has 1 to {MOST_ATTEMPTS} attempts")
    rows = events.select(*STEP, "call_id", "at", "event_id", "kind", "status", "response")
    nth = F.row_number().over(Window.partitionBy(*STEP).orderBy("at", "event_id"))
    opened = rows.filter("kind = 'reserve'").withColumn("attempt", nth)
    calls = opened.filter(F.col("attempt") <= attempts).select(*STEP, "call_id", "attempt", F.struct("at", "event_id").alias("opened"))
    ends = rows.filter("kind = 'finish'").withColumn("now", F.struct("at", "event_id")).join(calls, [*STEP, "call_id"], "left")
    ok = valid_end(F.col("status"), F.col("response")) & F.coalesce(F.col("opened") < F.col("now"), F.lit(False))
    first = F.min(F.when(ok, F.col("now"))).over(Window.partitionBy(*STEP, "call_id"))
    done = ends.select("event_id", "call_id", "attempt", F.when(ok & (F.col("now") == first), "finished").otherwise("state_invalid").alias("outcome"))
    begun = opened.select("event_id", "call_id", F.when(F.col("attempt") <= attempts, F.col("attempt")).alias("attempt"), F.when(F.col("attempt") <= attempts, "reserved").otherwise("attempts_exhausted").alias("outcome"))
    return begun.unionByName(done)


def ledger(events: DataFrame, now: F.Column, lease: str, attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """One row a call: generation, step, call_id, attempt, status and response.

    A call without a valid end is `reserved`, and `unknown` once `lease` has passed since its reservation: whether it happened can't be told.
    """
    said = outcomes(events, attempts)
    calls = events.join(said.filter("outcome = 'reserved'").select("event_id", "attempt"), "event_id").select(*STEP, "call_id", "attempt", F.col("at").alias("reserved_at"))
    ends = events.join(said.filter("outcome = 'finished'").select("event_id"), "event_id", "left_semi").select(*STEP, "call_id", "status", "response")
    j = calls.join(ends, [*STEP, "call_id"], "left")
    late = F.when(F.col("reserved_at") + F.expr(f"INTERVAL {lease}") <= now, "unknown").otherwise("reserved")
    return j.select(*STEP, "call_id", "attempt", F.coalesce("status", late).alias("status"), "response")


def outcome_stream(events: DataFrame, late: str, lease_ms: int, attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """outcomes() of a stream whose steps' events come in order, and an `expired` row for each call that its lease ends.

    The state of a step is its count of attempts and its open calls, three at most. A lease ends once the watermark passes it.
    """
    out = "event_id long, call_id long, attempt int, outcome string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"attempts": 0, "open": {}}
        rows = []
        if state.hasTimedOut:
            end = state.getCurrentWatermarkMs()
            for call in [c for c, (_, at) in held["open"].items() if at + lease_ms <= end]:
                rows.append((None, int(call), held["open"].pop(call)[0], "expired"))
        else:
            for e in pd.concat(list(frames)).sort_values(["at", "event_id"]).itertuples():
                call = None if pd.isna(e.call_id) else str(int(e.call_id))
                if e.kind == "reserve":
                    taken = held["attempts"] < attempts
                    if taken:
                        held["attempts"] += 1
                        held["open"][call] = [held["attempts"], e.at.value // 1_000_000]
                    rows.append((e.event_id, call, held["attempts"] if taken else None, "reserved" if taken else "attempts_exhausted"))
                elif e.kind == "finish":
                    ends = e.status in ENDS and not (e.status == "succeeded" and pd.isna(e.response))
                    attempt = held["open"].pop(call)[0] if ends and call in held["open"] else None
                    rows.append((e.event_id, call, attempt, "finished" if attempt else "state_invalid"))
        state.update((json.dumps(held),))
        if held["open"]:
            state.setTimeoutTimestamp(max(min(at for _, at in held["open"].values()) + lease_ms, state.getCurrentWatermarkMs() + 1))
        if rows:
            frame = pd.DataFrame(rows, columns=["event_id", "call_id", "attempt", "outcome"])
            yield frame.astype({"event_id": "Int64", "attempt": "Int32"}).assign(call_id=pd.to_numeric(frame["call_id"]).astype("Int64"))

    return events.withWatermark("at", late).groupBy(*STEP).applyInPandasWithState(step, out, "held string", "append", "EventTimeTimeout")


def reuse(requests: DataFrame, calls: DataFrame, bodies: DataFrame) -> DataFrame:
    """request_id and outcome: `replay` of a successful call of the same generation and fingerprint, or `call`.

    requests: (request_id, generation, fingerprint, scope, request); calls: successful ones, (call_id, generation, fingerprint, scope, request_sha256,
    response_sha256); bodies: (sha256, body), the store of responses. The newest call counts. A call of another scope, or of a request with other bytes, is an
    `identity_mismatch`; a response that is not in the store is `missing`, one whose bytes don't have its digest is `corrupt`.
    Texts are hashed where they are read: what is joined has one width, however many requests have the same key.
    """
    requests = requests.select("request_id", "generation", "fingerprint", "scope", F.sha2("request", 256).alias("asked"))
    newest = calls.groupBy("generation", "fingerprint").agg(F.max_by(F.struct("call_id", "scope", "request_sha256", "response_sha256"), "call_id").alias("c"))
    kept = bodies.groupBy("sha256").agg(F.bool_and(F.sha2("body", 256) == F.col("sha256")).alias("whole"))
    j = requests.join(newest, ["generation", "fingerprint"], "left").join(kept, F.col("c.response_sha256") == F.col("sha256"), "left")
    same = F.col("c.scope").eqNullSafe(F.col("scope")) & F.col("c.request_sha256").eqNullSafe(F.col("asked"))
    said = F.when(F.col("c").isNull(), "call").when(~same, "identity_mismatch").when(F.col("whole").isNull(), "missing").when(~F.col("whole"), "corrupt").otherwise("replay")
    return j.select("request_id", F.col("c.call_id").alias("call_id"), said.alias("outcome"))
