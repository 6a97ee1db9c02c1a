"""Ledgers, composed reports, guards, fidelity, CSV and the stored index against plain versions."""

import csv
import io
import os
import random
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.operators import composition, diff, ledger, search
from quillspark.queries import contracts
from quillspark.sources import files, guard

DATA = "/root/testdata/sf0.001"
EVENTS = "generation string, step long, call_id long, at timestamp, event_id long, kind string, status string, response string"


def plain_ledger(events, attempts=3):
    used, calls, out = defaultdict(int), {}, {}
    for e in sorted(events, key=lambda e: (e["at"], e["event_id"])):
        step = (e["generation"], e["step"])
        if e["kind"] == "reserve":
            taken = used[step] < attempts
            if taken:
                used[step] += 1
                calls[step, e["call_id"]] = [used[step], False]
            out[e["event_id"]] = ("reserved" if taken else "attempts_exhausted", used[step] if taken else None)
        else:
            call = calls.get((step, e["call_id"]))
            good = call and not call[1] and e["status"] in ("succeeded", "failed", "unknown") and (e["status"] != "succeeded" or e["response"] is not None)
            if good:
                call[1] = True
            out[e["event_id"]] = ("finished" if good else "state_invalid", call[0] if call else None)
    return out


def test_ledger_equals_a_plain_one_as_batch_and_as_stream(spark, tmp_path):
    calls = contracts._calls(spark, DATA).orderBy("at", "event_id")
    want = plain_ledger([r.asDict() for r in calls.collect()])
    got = {r.event_id: (r.outcome, r.attempt) for r in ledger.outcomes(calls).collect()}
    assert got == want and {o for o, _ in want.values()} == {"reserved", "attempts_exhausted", "finished", "state_invalid"}
    rows = calls.collect()
    source = str(tmp_path / "in")
    for i in range(0, len(rows), -(-len(rows) // 3)):
        spark.createDataFrame(rows[i : i + -(-len(rows) // 3)], EVENTS).coalesce(1).write.mode("append").parquet(source)
    late = [("zz", 0, -1, rows[-1]["at"].replace(year=2030), 10**9, "finish", "failed", None)]
    spark.createDataFrame(late, EVENTS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    q = ledger.outcome_stream(stream, "1 hour", 3_600_000).writeStream.format("memory").queryName("calls").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    said = spark.table("calls").collect()
    streamed = {r.event_id: r.outcome for r in said if r.event_id is not None and r.event_id < 10**9}
    assert streamed == {k: v for k, (v, _) in want.items()}
    ended = {r.call_id for r in said if r.outcome == "finished"}
    assert {r.call_id for r in said if r.outcome == "expired"} == {k for k, (v, _) in want.items() if v == "reserved"} - ended
    with pytest.raises(ValueError):
        ledger.outcomes(calls, attempts=4)


def test_reuse_looks_at_bytes(spark):
    sha = lambda s: __import__("hashlib").sha256(s.encode()).hexdigest()
    requests = spark.createDataFrame([(i, "g", f"f{i}", "s", f"ask {i}") for i in range(6)], "request_id long, generation string, fingerprint string, scope string, request string")
    calls = [(10 + i, "g", f"f{i}", "s" if i != 2 else "other", sha(f"ask {i}" if i != 3 else "else"), sha(f"answer {i}")) for i in range(1, 6)]
    calls.append((1, "g", "f1", "s", sha("old"), sha("old")))
    bodies = [(sha("answer 1"), "answer 1"), (sha("answer 2"), "answer 2"), (sha("answer 3"), "answer 3"), (sha("answer 4"), "answer 4 edited")]
    got = ledger.reuse(requests, spark.createDataFrame(calls, "call_id long, generation string, fingerprint string, scope string, request_sha256 string, response_sha256 string"), spark.createDataFrame(bodies, "sha256 string, body string"))
    assert {r.request_id: r.outcome for r in got.collect()} == {0: "call", 1: "replay", 2: "identity_mismatch", 3: "identity_mismatch", 4: "corrupt", 5: "missing"}


def plain_merge(items, facts):
    """The same rules over tuples: (part, place, slot, matter, id, title, text, ids)."""
    best = lambda it: min([facts[i][0] for i in it[7] if i in facts] or [4])
    groups, heads = [], {}
    for it in items:
        if it[2] not in ("overview", "pending"):
            if (it[0], it[3]) not in heads:
                heads[it[0], it[3]] = len(groups)
                groups.append([it[4], (it[5] or "").strip(), [], [], []])
            groups[heads[it[0], it[3]]][{"background": 2, "detail": 3, "status": 4}[it[2]]].append(it)
    done = []
    for g in groups:
        for d in done:
            if (g[0] == d[0]) if g[0] is not None and d[0] is not None else (g[1] == d[1] or {f for it in g[3] for f in it[7]} & {f for it in d[3] for f in it[7]}):
                d[3].extend(g[2] + g[3] + g[4])
                break
        else:
            done.append(g)
    pool = [it for it in items if it[2] == "overview"] + [it for d in done for it in d[2] + d[3] + d[4]]
    shown, seen = [], []
    for r in range(5):
        for it in pool:
            if best(it) == r:
                names = [(facts[f][1] if f in facts and facts[f][1] else f) for f in it[7]]
                if any(n not in seen for n in names):
                    shown.append(it)
                    seen += names
    out = [("overview", None, None, it[6]) for it in shown[:5]]
    order = sorted(range(len(done)), key=lambda n: (min([best(it) for it in done[n][2] + done[n][3] + done[n][4]] or [4]), n))
    for m, n in enumerate(order):
        out += [(slot, m, done[n][0], it[6]) for k, slot in ((2, "background"), (3, "detail"), (4, "status")) for it in done[n][k]]
    return out + [("pending", None, None, it[6]) for it in items if it[2] == "pending"]


item = st.tuples(st.integers(0, 2), st.sampled_from(["overview", "background", "detail", "detail", "status", "pending"]), st.integers(0, 2), st.sampled_from([None, "m1", "m2"]), st.sampled_from(["a", " a ", "b", None]), st.lists(st.sampled_from("fghijk"), max_size=3, unique=True))


@settings(max_examples=300, deadline=None)
@given(st.lists(item, max_size=14), st.dictionaries(st.sampled_from("fghij"), st.tuples(st.integers(0, 4), st.sampled_from([None, "m1", "m3"]))))
def test_matters_merge_as_in_a_plain_version(some, facts):
    heads = {}
    items = []
    for n, (part, slot, matter, name, title, ids) in enumerate(sorted(some, key=lambda s: s[0])):
        name, title = heads.setdefault((part, matter), (name, title))
        items.append((part, n, slot, matter, name, title, f"t{n}", ids))
    rows = [dict(zip(("part", "place", "slot", "matter", "matter_id", "title", "text", "fact_ids"), it)) for it in items]
    got = composition.merge_parts(rows, {k: {"rank": r, "matter_id": m} for k, (r, m) in facts.items()})
    assert [(r["slot"], r["matter"], r["matter_id"], r["text"]) for r in got] == plain_merge(items, facts)


def test_composed_reports_of_the_tables(spark):
    items, facts = contracts._facts(spark, DATA)
    ranks = {(r.report, r.fact_id): (r.rank, r.matter_id) for r in facts.select("report", "fact_id", "matter_id", contracts.composition.rules.fact_priority(F.col("text")).alias("rank")).collect()}
    by = defaultdict(list)
    for r in items.collect():
        by[r.report].append((r.part, r.place, r.slot, r.matter, r.matter_id, r.title, r.text, r.fact_ids))
    got = defaultdict(list)
    for r in sorted(catalog.QUERIES["composed_matters"](spark, DATA).collect(), key=lambda r: r.place):
        got[r.report].append((r.slot, r.matter, r.matter_id, r.text))
    want = {k: plain_merge(sorted(v, key=lambda it: it[:2]), {f: x for (rep, f), x in ranks.items() if rep == k}) for k, v in by.items()}
    assert dict(got) == want


def test_composition_problems(spark):
    facts = spark.createDataFrame([("r", "f1", None, False, "x", ["s1", "s2"]), ("r", "f2", None, True, "x", ["s3"]), ("q", "f1", None, False, "x", ["s1"])], "report string, fact_id string, matter_id string, pending boolean, text string, source_ids array<string>")
    rows = [
        ("r", 0, "overview", None, None, None, "ok", ["f1"], ["s2", "s1"]), ("r", 1, "overview", None, None, None, " ", ["f1"], ["s1", "s2"]), ("r", 2, "overview", None, None, None, "open", ["f2"], ["s3"]), ("r", 3, "detail", 0, "m", "t", "twice", ["f1", "f1"], ["s1", "s2"]),
        ("r", 4, "detail", 1, "m", " ", "untitled", ["f1"], ["s1"]), ("r", 5, "pending", None, None, None, "fine", ["f2"], ["s3"]), ("r", 6, "status", 2, "n", "t", "unknown", ["f9"], []), ("r", 7, "pending", None, None, None, "none", [], []),
    ]
    items = spark.createDataFrame(rows, "report string, place int, slot string, matter int, matter_id string, title string, text string, fact_ids array<string>, source_ids array<string>")
    got = {(r.report, r.place, r.rule) for r in composition.composition_problems(items, facts).collect()}
    assert got == {("r", 1, "text"), ("r", 2, "pending_fact"), ("r", 3, "facts"), ("r", 4, "title"), ("r", 4, "sources"), ("r", 6, "facts"), ("r", 7, "facts"), ("r", None, "matter_twice"), ("r", None, "matter_without_detail"), ("q", None, "nothing_composed")}
    assert {tuple(r) for r in composition.uncovered(facts, items).collect()} == {("q", "f1", False)}


def test_fidelity_is_that_of_difflib(spark):
    rng = random.Random(3)
    pairs = [(None, "a"), ("", ""), (" \n", ""), ("é", "é"), ("ab cd", "abcd")]
    for _ in range(150):
        a = "".join(rng.choices("abcde é\n", k=rng.randint(0, 260)))
        pairs.append((a, "".join(c for c in a if rng.random() > 0.2) + "".join(rng.choices("xyz", k=rng.randint(0, 9)))))
    got = [r.r for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(diff.fidelity("a", "b").alias("r")).collect()]
    want = [None if a is None else 1.0 if diff.same_text(a) == diff.same_text(b) else SequenceMatcher(None, diff.same_text(a), diff.same_text(b)).ratio() for a, b in pairs]
    assert got == want and got[3] == got[4] == 1.0


def test_unstable_files_are_read_once_more(spark, tmp_path):
    root = tmp_path / "work"
    root.mkdir()
    for n in range(6):
        (root / f"f{n}.txt").write_text(f"body {n}")
    names = spark.createDataFrame([(f"f{n}.txt",) for n in range(7)], "path string")
    reads = []

    def scan(keys):
        reads.append(sorted(r.path for r in (names if keys is None else keys).collect()))
        rows = guard.guarded(names if keys is None else names.join(keys, "path", "left_semi"), str(root))
        if keys is not None:
            return rows.filter("path <> 'f2.txt'")
        shaky = F.col("path").isin("f1.txt", "f2.txt", "f3.txt")
        return rows.withColumns({"status": F.when(shaky, "error").otherwise(F.col("status")), "reason": F.when(shaky, "source_changed").otherwise(F.col("reason")), "body": F.when(~shaky, F.col("body"))})

    got = {r.path: r for r in guard.rescanned(scan).collect()}
    assert reads[1] == ["f1.txt", "f2.txt", "f3.txt", "f6.txt"] and len(reads) == 2 and len(got) == 7
    assert got["f1.txt"].status == "success" and bytes(got["f1.txt"].body) == b"body 1" and got["f2.txt"].reason == "source_unstable_disappeared_on_retry" and got["f2.txt"].body is None
    assert got["f6.txt"].reason == "source_guard_unavailable" and bytes(got["f0.txt"].body) == b"body 0"
    calm = []
    guard.rescanned(lambda keys: calm.append(keys) or guard.guarded(names.filter("path < 'f3'"), str(root)))
    assert calm == [None]


def test_a_file_that_changes_while_it_is_read_has_no_body(spark, tmp_path, monkeypatch):
    import builtins

    (tmp_path / "a.txt").write_text("one")
    run = {}
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: run.setdefault("f", f))
    guard.guarded(spark.createDataFrame([("a.txt",)], "path string"), str(tmp_path))
    real = builtins.open

    def growing(name, mode="r", *a, **b):
        out = real(name, mode, *a, **b)
        if str(name).endswith("a.txt") and mode == "rb":
            with real(name, "a") as f:
                f.write(" more")
        return out

    import pyarrow as pa

    monkeypatch.setattr(builtins, "open", growing)
    rows = [r for b in run["f"](iter([pa.RecordBatch.from_pydict({"path": ["a.txt"]})])) for r in b.to_pylist()]
    assert rows[0]["status"] == "error" and rows[0]["reason"] == "source_changed" and rows[0]["body"] is None


def test_taint_is_sticky(spark):
    reads = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "x"), ("b", 1, "z"), ("b", 2, None), ("b", 3, "z"), ("c", 1, None), ("c", 2, None)]
    got = {(r.s, r.n): r.verified for r in guard.tainted(spark.createDataFrame(reads, "s string, n int, g string"), "s", "g", ["n"]).collect()}
    assert [got["a", i] for i in range(1, 5)] == [True, True, False, False] and [got["b", i] for i in range(1, 4)] == [True, False, False] and not got["c", 1] and not got["c", 2]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='a,"\n\r é中|', max_size=60), st.sampled_from(["utf-8", "utf-8-sig", "gb18030"]))
def test_csv_streams_what_a_whole_read_shows(text, encoding):
    raw = text.encode(encoding, "ignore")
    try:
        decoded = raw.decode("utf-8-sig" if raw.startswith(b"\xef\xbb\xbf") else "utf-8")
    except UnicodeDecodeError:
        try:
            decoded = raw.decode("gb18030")
        except UnicodeDecodeError:
            assert files.parse_csv(raw, 1000)[3] == "csv_encoding"
            return
    got = files.parse_csv(raw, 1000)
    if "\r" in decoded.replace("\r\n", ""):
        assert got[3] == "csv_lone_cr"
        return
    try:
        rows = list(csv.reader(io.StringIO(decoded, newline=""), strict=True))
    except csv.Error:
        assert got[3] == "csv_malformed"
        return
    shown = [" | ".join(c.replace("\n", " ") for c in r) for r in rows[:4]]
    assert got[0] == "\n".join(shown) and got[1] == (len(rows) > 4) and got[3] is None and [u[0] for u in got[4]] == ["header", "row", "row", "row"][: len(shown)]


def test_stored_index_prunes_and_follows_its_fragments(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(1, "t", "The quick brown fox"), (2, "t", "quick"), (3, "t", "brOWN bear"), (4, "t", "no")], "report_key long, title string, body string")
    index = search.stored_index(rows, path)
    assert sorted(r.report_key for r in search.search(rows, "brown", index).collect()) == [1, 3]
    plan = search.phrase_candidates(index, "brown")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    stamp = os.path.getmtime(f"{path}/postings/_SUCCESS")
    search.stored_index(rows, path)
    assert os.path.getmtime(f"{path}/postings/_SUCCESS") == stamp
    more = rows.unionByName(spark.createDataFrame([(5, "t", "a brown one")], rows.schema))
    assert sorted(r.report_key for r in search.search(more, "brown", search.stored_index(more, path)).collect()) == [1, 3, 5]


def test_row_keys_carry_the_first_header(spark):
    rows = [
        ("d", 0, "t", False, ["7", "x"], "h0"), ("d", 1, "t", True, ["名称", "订单编号"], "h1"), ("d", 2, "t", False, ["x", "17"], "h2"), ("d", 3, "t", True, ["id", "b"], "h3"), ("d", 4, "t", False, ["x", ""], "h4"), ("d", 5, "u", False, ["x", "y"], "h5"),
        ("d", 6, "k", True, ["a", "b", "c"], "h6"), ("d", 7, "k", False, ["1", "2", "3"], "h7"), ("d", 8, "k", False, ["1"], "h8"),
    ]
    keys = spark.createDataFrame([("k", ["c", "a"])], "label string, keys array<string>")
    got = {r.pos: r.row_key for r in diff.keyed_rows(spark.createDataFrame(rows, "doc string, pos int, label string, is_header boolean, cells array<string>, sha256 string"), keys, "doc", ["pos"]).collect()}
    sha = lambda *p: __import__("hashlib").sha256(__import__("json").dumps(["row-key", p[0], __import__("json").dumps(list(p[1:]), separators=(",", ":"), ensure_ascii=False)], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert got[0] == "h0" and got[2] == sha("t", "17") and got[3] == sha("t", "b") and got[4] == "h4" and got[5] == "h5" and got[7] == sha("k", "3", "1") and got[8] == "h8"


def plain_ranges(rows, most_sources, most_size, most_batches):
    """The same rules over lists: rows (source, kind, path, part, start, end, priority)."""
    queue = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[3])):
        queue[r[0]].append(r)
    lanes = defaultdict(list)
    for s in sorted(queue, key=lambda s: (queue[s][0][2] or "", s)):
        lanes[queue[s][0][1] or ""].append(s)
    order = []
    while any(lanes.values()):
        for k in sorted(lanes):
            if lanes[k]:
                order.append(lanes[k].pop(0))
    urgent = [s for s in order if any(r[6] for r in queue[s])]
    order = urgent + [s for s in order if s not in urgent]
    boxes = [[] for _ in range(min(most_batches, (len(order) + most_sources - 1) // most_sources))] if urgent else []
    fits = lambda box: sum(e - a for _, a, e in box) <= most_size and len({s for s, *_ in box}) <= most_sources
    lost, turn = [], 0
    for s in order:
        _, _, _, _, a, e, _ = queue[s][0]
        tries = [(turn + i) % len(boxes) for i in range(len(boxes))] if urgent else [len(boxes) - 1] if boxes else []
        good = [i for i in tries if len(boxes[i]) < most_sources and fits([*boxes[i], (s, a, e)])]
        if not good and len(boxes) < most_batches:
            boxes.append([])
            good = [len(boxes) - 1]
        if good:
            boxes[good[0]].append((s, a, e))
            turn = (good[0] + 1) % len(boxes)
        else:
            lost.append((s, None, a, e))
    boxes = [b for b in boxes if b]
    for some in (urgent, [s for s in order if s not in urgent]):
        for depth in range(1, 99):
            for s in [s for s in some if depth < len(queue[s])]:
                _, _, _, _, a, e, _ = queue[s][depth]
                own = [b for b in boxes if s in {x[0] for x in b}]
                placed = False
                for b in own + [b for b in boxes if b not in own]:
                    joined = list(b)
                    close = [i for i, x in enumerate(b) if x[0] == s and a <= x[2] + 2]
                    if close:
                        joined[close[-1]] = (s, b[close[-1]][1], e)
                    else:
                        joined.append((s, a, e))
                    if fits(joined):
                        b[:] = joined
                        placed = True
                        break
                if not placed and len(boxes) < most_batches:
                    boxes.append([(s, a, e)])
                elif not placed:
                    lost.append((s, None, a, e))
    return sorted([(s, n, a, e) for n, b in enumerate(boxes) for s, a, e in b] + lost, key=str)


def test_ranges_pack_as_in_a_plain_version(spark):
    from quillspark.operators import batches

    rng = random.Random(9)
    rows = []
    for run in range(120):
        for s in range(rng.randint(1, 7)):
            at, kind, path, urgent = rng.randint(0, 9), rng.choice([".md", ".txt", None]), rng.choice(["a", "b", None]), run % 2 == 0 and rng.random() < 0.4
            for part in range(rng.randint(1, 4)):
                end = at + rng.randint(1, 60)
                rows.append((run, s, kind, path, part, at, end, urgent))
                at = end + rng.choice([0, 1, 2, 3, 40])
    d = spark.createDataFrame(rows, "run long, source long, kind string, path string, part int, start long, end long, priority boolean")
    got = defaultdict(list)
    for r in batches.packed_ranges(d, "run", "source", "kind", "path", 2, 100, 3).collect():
        got[r.run].append((r.source, r.batch, r.start, r.end))
    for run in range(120):
        assert sorted(got[run], key=str) == plain_ranges([r[1:] for r in rows if r[0] == run], 2, 100, 3), run


def test_requests_shrink_to_half_their_bytes(spark):
    import json

    from quillspark.operators import batches

    rng = random.Random(4)
    cost = lambda s, t: len(json.dumps({"source_id": s, "text": t}, ensure_ascii=False, separators=(",", ":")).encode()) + 1
    rows = []
    for i in range(80):
        entries = []
        for _ in range(rng.randint(0, 5)):
            text = "".join(rng.choices('aé中"\n ', k=rng.randint(0, 700)))
            entries.append((rng.choice("pqrs"), text, sorted({rng.randint(1, max(1, len(text))) for _ in range(rng.randint(0, 6))})))
        rows.append((i, rng.randint(0, 300), entries))
    want = set()
    for i, fixed, entries in rows:
        limit, kept, seen = (fixed + sum(cost(s, t) for s, t, _ in entries)) // 2, [], set()
        total = lambda: fixed + sum(cost(s, t[:e]) for s, t, _, e in kept)  # noqa: B023, E731
        for s, t, ends in entries:
            if s not in seen:
                seen.add(s)
                if ends and total() + cost(s, t[: ends[0]]) <= limit:
                    kept.append([s, t, ends, ends[0]])
        for k in kept:
            for end in k[2][1:]:
                was, k[3] = k[3], end
                if end > 512 or total() > limit:
                    k[3] = was
                    break
        want |= {(i, s, e) for s, _, _, e in kept}
    d = spark.createDataFrame(rows, "r int, fixed_bytes long, entries array<struct<source:string,text:string,ends:array<long>>>")
    assert {tuple(x) for x in batches.reduced_requests(d, "r").collect()} == want and len(want) > 40


def test_report_problems(spark):
    from quillspark.operators import validators

    good = dict(day="2024-01-02", schema_version=4, report_kind="file_evidence", scope_id="personal_work", timezone="Asia/Shanghai", root_alias="work", window_start_utc="2024-01-01T16:00:00Z", window_end_utc="2024-01-02T16:00:00Z", generated_at="2024-01-03T00:00:00.5Z", user_notes=None, quality="partial", has_content=True)
    schema = "day string, schema_version int, report_kind string, scope_id string, timezone string, root_alias string, window_start_utc string, window_end_utc string, generated_at string, user_notes string, quality string, has_content boolean"
    edits = {
        "2024-01-02": {}, "2024-01-03": dict(schema_version=9, root_alias="", generated_at="2024-01-03 00:00", user_notes="x" * 70_000, quality="fine"), "2024-01-04": dict(quality="complete"), "2024-01-05": dict(quality="no_changes", has_content=False), "2024-01-06": dict(quality="no_changes", has_content=True),
        "2024-01-07": dict(schema_version=3), "2024-01-08": dict(), "bad day": dict(),
    }
    rows = []
    for day, e in edits.items():
        before, after = ("2024-01-%02dT16:00:00Z" % (int(day[-2:]) - 1), f"{day}T16:00:00Z") if day.startswith("2024") else ("x", "y")
        rows.append(tuple({**good, "day": day, "window_start_utc": before, "window_end_utc": after, **e}[f.split()[0]] for f in schema.split(", ")))
    sources = [(d, f"s{i}", True, i == 2, "success", False) for d in ("2024-01-02", "2024-01-03", "2024-01-04", "2024-01-08") for i in (1, 2)] + [("2024-01-08", "s1", True, False, "success", False), ("2024-01-07", "s9", False, False, "error", False)]
    gaps = [("2024-01-02", None, "OK_1", "m", "parse"), ("2024-01-08", "s7", "OK", "m", "parse"), ("2024-01-03", "s1", "not ok", "m", "parse")]
    facts = [(d, "f1", False, ["s1"]) for d in ("2024-01-02", "2024-01-03", "2024-01-04", "2024-01-08", "bad day")] + [("2024-01-02", "f2", True, ["s2"]), ("2024-01-04", "f2", False, ["s2"]), ("2024-01-08", "f1", True, [])]
    got = defaultdict(set)
    out = validators.report_problems(
        spark.createDataFrame(rows, schema), spark.createDataFrame(sources, "day string, source_id string, usable boolean, unverified boolean, parse_status string, truncated boolean"),
        spark.createDataFrame(gaps, "day string, source_id string, code string, message string, stage string"), spark.createDataFrame(facts, "day string, fact_id string, pending boolean, source_ids array<string>"),
    )
    for r in out.collect():
        got[r.day].add(r.rule)
    assert dict(got) == {
        "2024-01-03": {"kind", "alias", "generated_at", "notes", "quality", "gap"}, "2024-01-04": {"not_complete", "fact"}, "2024-01-06": {"not_without_changes", "content"}, "2024-01-07": {"nothing_usable", "content"},
        "2024-01-08": {"source_twice", "gap", "fact_twice", "fact"}, "bad day": {"window", "fact"},
    }


def test_a_deadline_stops_further_waves(spark):
    from quillspark.plans import admission
    from quillspark.queries import excerpts
    from quillspark.queries.base import files as file_rows

    f, o = file_rows(spark, DATA), excerpts._outcomes(spark, DATA)
    first, stops = admission.waves(f, o, late=lambda: True)
    assert {r.wave for r in first.collect()} == {0} and {r.stop_reason for r in stops.collect()} <= {"complete", "quota_exhausted", "deadline"}
    whole, _ = admission.waves(f, o)
    assert first.exceptAll(whole.select(first.columns)).count() == 0


def test_snippets_are_those_of_a_full_text_engine(spark):
    """SQLite's FTS5 with trigrams; phrases whose hits share letters but no trigram are left out, as it doubles text there."""
    import sqlite3

    c = sqlite3.connect(":memory:")
    try:
        c.execute("CREATE VIRTUAL TABLE t USING fts5(title, body, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no trigram index here")
    rng, seen = random.Random(1), 0
    rows = []
    for i in range(2500):
        title, body = ("".join(rng.choices(["the ", "ab", "a", "b", "c. ", ": ", "x", "\n", " ", "é", "."], k=k)) for k in (rng.randint(0, 12), rng.randint(0, 90)))
        query = rng.choice(["the", "THE", "aba", "the a", "abab", "bab", ". x", "xab"])
        c.execute("DELETE FROM t")
        c.execute("INSERT INTO t VALUES (?, ?)", (title, body))
        found = c.execute("SELECT snippet(t, -1, '[', ']', '…', 40) FROM t WHERE t MATCH ?", (f'"{query}"',)).fetchone()
        places = [[p for p in range(len(x)) if x.lower().startswith(query.lower(), p)] for x in (title, body)]
        if any(len(query) - 2 <= b - a < len(query) for p in places for a, b in zip(p, p[1:])):
            continue
        assert search.match_snippet([title, body], query) == (found[0] if found else None), (title, body, query)
        seen += found is not None
        rows.append((i, title, body))
    assert seen > 900
    d = spark.createDataFrame(rows[:50], "report_key long, title string, body string")
    assert {r.report_key: r.snippet for r in search.snippets(d, "the").collect()} == {i: search.match_snippet([t, b], "the") for i, t, b in rows[:50]}
    assert search.match_snippet(["", "aaaaa"], "aaa") == "[aaaaa]"
