"""Publication that is killed anywhere, bounded discovery, the call ledger, matters and guards."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.sources import bounded
from quillspark.streaming import publication


class Killed(Exception):
    pass


def killed_at(step):
    def check(now):
        if now == step:
            raise Killed(now)

    return check


def days(spark, root):
    return {r.day: r.body for r in publication.stored(spark, f"{root}/days", publication.BODIES).collect()}


def edit(spark, root, day, body):
    spark.createDataFrame([(body, day)], publication.BODIES).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root}/days")


@pytest.mark.parametrize("step", ["staged", "kept", "days", "log", None])
def test_a_killed_publication_ends_like_a_whole_one(spark, tmp_path, step):
    root = str(tmp_path / "reports")
    frame = lambda *rows: spark.createDataFrame(list(rows), "day string, body string")
    publication.publish(frame(("2024-01-01", "a1"), ("2024-01-02", "b1"), ("2024-01-03", "c1")), root, 0)
    edit(spark, root, "2024-01-02", "edited by hand")
    second = frame(("2024-01-01", "a2"), ("2024-01-02", "b2"), ("2024-01-03", "c1"), ("2024-01-04", "d1"), ("2024-01-05", None), ("2024-01-06", ""))
    if step:
        with pytest.raises(Killed):
            publication.publish(second, root, 1, after=killed_at(step))
    said = {r.day: r.outcome for r in publication.publish(second, root, 1).collect()}
    assert said == {"2024-01-01": "publish", "2024-01-02": "conflict", "2024-01-03": "already", "2024-01-04": "publish", "2024-01-05": "not_staged", "2024-01-06": "not_staged"}
    assert days(spark, root) == {"2024-01-01": "a2", "2024-01-02": "edited by hand", "2024-01-03": "c1", "2024-01-04": "d1"}
    assert [(r.day, r.body) for r in spark.read.parquet(f"{root}/conflicts").collect()] == [("2024-01-02", "b2")]
    assert [(r.day, r.body) for r in spark.read.parquet(f"{root}/replaced").collect()] == [("2024-01-01", "a1")]
    assert {r.day: (r.batch, r.intact) for r in publication.committed_days(spark, root).collect()} == {"2024-01-01": (1, True), "2024-01-02": (0, False), "2024-01-03": (1, True), "2024-01-04": (1, True)}
    again = {r.day: r.outcome for r in publication.publish(frame(("2024-01-01", "a3")), root, 2, revise=False).collect()}
    assert again == {"2024-01-01": "committed"} and days(spark, root)["2024-01-01"] == "a2"


def test_an_edit_between_decision_and_writing_is_kept(spark, tmp_path):
    root = str(tmp_path / "reports")
    new = spark.createDataFrame([("2024-01-01", "a1"), ("2024-01-02", "b1")], "day string, body string")

    def meddle(step):
        if step == "staged":
            edit(spark, root, "2024-01-02", "came meanwhile")

    said = {r.day: r.outcome for r in publication.publish(new, root, 0, after=meddle).collect()}
    assert said == {"2024-01-01": "publish", "2024-01-02": "conflict"} and days(spark, root) == {"2024-01-01": "a1", "2024-01-02": "came meanwhile"}
    assert [r.body for r in spark.read.parquet(f"{root}/conflicts").collect()] == ["b1"]


@pytest.mark.parametrize("step", ["staged", "days", None])
def test_a_restarted_stream_publishes_each_day_once(spark, tmp_path, step):
    source, root = str(tmp_path / "in"), str(tmp_path / "reports")
    schema = "day string, body string"
    body = F.col("body")

    def stream(checkpoint, after=lambda s: None):
        q = publication.publish_days(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), body, root, str(tmp_path / checkpoint), after=after)
        q.awaitTermination()

    for n in range(3):
        spark.createDataFrame([(f"2024-02-0{n + 1}", f"body {n}"), (f"2024-02-1{n}", "x")], schema).coalesce(1).write.mode("append").parquet(source)
    if step:
        with pytest.raises(Exception, match="Killed"):
            stream("cp", killed_at(step))
    stream("cp")
    want = {f"2024-02-0{n + 1}": f"body {n}" for n in range(3)} | {f"2024-02-1{n}": "x" for n in range(3)}
    assert days(spark, root) == want
    assert sorted(r.day for r in spark.read.parquet(f"{root}/log").collect()) == sorted(want)
    stream("another checkpoint")  # all rows come again: nothing is published twice
    assert days(spark, root) == want and spark.read.parquet(f"{root}/replaced").count() == 0 and spark.read.parquet(f"{root}/conflicts").count() == 0


@pytest.fixture
def tree(tmp_path):
    rng, root = random.Random(2), tmp_path / "tree"
    for folder in ("", "a", "a/b", "a/b/c", "d", "empty", "z"):
        (root / folder).mkdir(parents=True, exist_ok=True)
        for n in range(rng.randint(0, 7) if folder != "empty" else 0):
            (root / folder / f"{rng.choice('mnz')}{n}{rng.choice(['.txt', '.md', '.bin'])}").write_text("x" * n)
    (root / "a" / "~lock.txt").write_text("")
    os.symlink(root / "d", root / "link")
    return str(root)


def test_pages_are_one_walk(tree):
    whole, said, stack, seen = bounded.walk(tree, [["", 0]], 10**9)
    found = sorted(os.path.relpath(os.path.join(d, f), tree) for d, _, fs in os.walk(tree) for f in fs)
    assert sorted(whole) == found and stack == [] and said == [("link", "link_excluded")]
    for most in (1, 2, 3, 7):
        files, stack, pages, total = [], [["", 0]], 0, 0
        while stack:
            some, _, stack, n = bounded.walk(tree, stack, most)
            files, pages, total = files + some, pages + 1, total + n
            assert n <= most
        assert files == whole and total == seen and pages == -(-seen // most)
    for bad in ([["../up", 0]], [["/etc", 0]], [["a", -1]], [["a", 0]] * 300):
        with pytest.raises(ValueError):
            bounded.walk(tree, bad, 10)


def test_a_deadline_leaves_a_cursor(tree):
    calls = iter(range(10**6))
    files, _, stack, seen = bounded.walk(tree, [["", 0]], 10**9, late=lambda: next(calls) > 5)
    rest, _, end, more = bounded.walk(tree, stack, 10**9)
    whole = bounded.walk(tree, [["", 0]], 10**9)
    assert stack and end == [] and files + rest == whole[0] and seen + more == whole[3] and 0 < seen < whole[3]


def test_bounded_files_as_a_stream_that_restarts(spark, tree, tmp_path):
    bounded.register(spark)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    one = spark.read.format("bounded_files").option("path", tree).option("extensions", ".txt,.md").option("ignore", "~*").load().collect()
    want = {r.path: r.size_bytes for r in one if r.issue is None}
    assert want == {p: s for p, s in want.items() if not p.endswith(".bin")} and all(os.path.getsize(os.path.join(tree, p)) == s for p, s in want.items()) and want

    def run(batches):
        rows = spark.readStream.format("bounded_files").option("path", tree).option("extensions", ".txt,.md").option("ignore", "~*").option("maxEntries", 4).load()
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        if batches:
            while q.lastProgress is None or q.lastProgress["batchId"] < batches:
                q.awaitTermination(0.05)
        else:
            q.processAllAvailable()
        q.stop()

    run(1)
    run(None)
    got = spark.read.parquet(out).collect()
    assert Counter(r.path for r in got if r.issue is None) == Counter(list(want)) and {r.path: r.size_bytes for r in got if r.issue is None} == want
    last = -(-bounded.walk(tree, [["", 0]], 10**9)[3] // 4)
    assert {r.page for r in got if r.issue == "incomplete: more pages follow"} == set(range(1, last)) and last > 3
    short = spark.read.format("bounded_files").option("path", tree).option("deadlineSeconds", "0").option("maxEntries", 2).load().filter("issue LIKE 'incomplete%'").collect()
    assert [r.issue for r in short] == ["incomplete: deadline"]
