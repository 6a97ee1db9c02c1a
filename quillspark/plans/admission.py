"""Planning: nominal order, candidate slots, first-fit admission under a character budget, omitted-detail prefix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.operators import windows
from quillspark.session import settled

#: Quotas by report kind: files, PDF pages, PDF extractions. Fixed values.
QUOTAS = {"daily": (96, 80, 8), "weekly": (192, 100, 12), "monthly": (384, 370, 16)}
OMITTED_CAP, OMITTED_PERCENT, PDF_MAX_PAGES, SEPARATOR = 12_000, 20, 20, 2


def omitted_reservation(budget: int) -> int:
    return min(OMITTED_CAP, budget * OMITTED_PERCENT // 100)


def ranked(files: DataFrame, run: str = "run_id") -> DataFrame:
    """files, without their contents, with priority and its rank in the one order that everything after follows."""
    narrow = files.drop("content").withColumn("priority", rules.priority(F.col("relative_path"), F.col("extension")))
    narrow = narrow.withColumn("_path", rules.normalized_path(F.col("relative_path")))
    out = windows.running(narrow, [run], ["priority", "_path", "relative_path", "file_identity"])
    return out.withColumn("rank", (F.col("_before") + 1).cast("int")).drop("_before", "_total", "_path")


def candidate_slots(plan: DataFrame, files: int, pages: int, run: str = "run_id", left: DataFrame | None = None) -> DataFrame:
    """slot_action of each routed file, in rank order: a slot, or the quota it met.

    A PDF takes its pages first; one that gets none costs no slot. Pages and slots only ever get fewer, so among files that
    need the same number of pages those with a slot come first: at most `files` of each need can have one. Only these are
    folded, a bounded number a run whatever its size; they are the first of their need by a rank that is cut before the
    shuffle. Of the others, a PDF that needs more pages than are left at the end lacks pages, and all else lacks slots.

    left: (run, slots, pages) if runs have used some of theirs; a PDF then takes what pages there are, rather than none.
    """
    some = left is not None
    pdf = F.col("route") == "pdf"
    need = F.when(pdf, F.least("page_count", F.lit(PDF_MAX_PAGES))).otherwise(-1).cast("long")
    routed = plan.select(run, "rank", "file_identity", need.alias("need"))
    first = routed.withColumn("turn", F.row_number().over(Window.partitionBy(run, "need").orderBy("rank"))).filter(F.col("turn") <= files)
    row = F.struct("rank", F.col("file_identity").alias("id"), F.greatest("need", F.lit(0)).alias("need"), (F.col("need") >= 0).alias("pdf"))
    runs = first.groupBy(run).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    runs = runs.join(left.select(run, "slots", "pages"), run) if some else runs.select("*", F.lit(files).alias("slots"), F.lit(pages).alias("pages"))
    start = F.struct(F.col("slots").cast("long").alias("slots"), F.col("pages").cast("long").alias("pages"), F.array().cast("array<string>").alias("out"))

    def step(s, r):
        lacks = s["pages"] <= 0 if some else r["need"] > s["pages"]
        given = ~(r["pdf"] & lacks) & (s["slots"] > 0)
        return F.struct(
            (s["slots"] - given.cast("long")).alias("slots"), (s["pages"] - F.when(given, F.least(r["need"], s["pages"])).otherwise(0)).cast("long").alias("pages"),
            F.when(given, F.concat(s["out"], F.array(r["id"]))).otherwise(s["out"]).alias("out"),
        )

    done = settled(runs.select(run, F.aggregate("rows", start, step).alias("end")))  # one row a run, which is read twice
    given = done.select(run, F.explode("end.out").alias("file_identity"), F.lit("slot").alias("given"))
    lacks = (F.col("need") >= 0) & (F.col("pages") <= 0) if some else F.col("need") > F.col("pages")
    said = F.when(F.col("given").isNotNull(), F.col("given")).when(lacks, "pdf_page_quota_exhausted").otherwise("candidate_quota_exhausted")
    out = routed.join(given, [run, "file_identity"], "left").join(done.select(run, "end.pages"), run)
    return out.select(run, "file_identity", said.alias("slot_action"))


def first_fit(costs: DataFrame, budget: int, extractions: int, run: str = "run_id", left: DataFrame | None = None) -> DataFrame:
    """admit_action of each candidate: admitted if its cost still fits; otherwise skipped and the pass goes on.

    costs: run, rank, file_identity, cost, needs_extraction. The budget is tested before an extraction slot, and a slot
    is spent by admission only. What fits depends on what was taken, so a running sum would be wrong; quotas bound a run's
    candidates to a few hundred, which one fold takes. left: (run, budget, extractions) if runs have used some of theirs.
    """
    row = F.struct("rank", F.col("file_identity").alias("id"), F.col("cost").cast("long").alias("cost"), F.col("needs_extraction").alias("pdf"))
    runs = costs.groupBy(run).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    runs = runs.join(left.select(run, "budget", "extractions"), run) if left is not None else runs.select("*", F.lit(budget).alias("budget"), F.lit(extractions).alias("extractions"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.col("extractions").cast("long").alias("left"), F.array().cast("array<struct<id:string,admit_action:string>>").alias("out"))

    def step(s, r):
        fits = s["used"] + r["cost"] <= F.col("budget")
        blocked = fits & r["pdf"] & (s["left"] <= 0)
        taken = fits & ~blocked
        said = F.when(~fits, "global_context_budget_exceeded").when(blocked, "pdf_text_extraction_quota_exhausted").otherwise("admit")
        return F.struct(
            (s["used"] + F.when(taken, r["cost"]).otherwise(0)).cast("long").alias("used"), (s["left"] - (taken & r["pdf"]).cast("long")).alias("left"),
            F.concat(s["out"], F.array(F.struct(r["id"].alias("id"), said.alias("admit_action")))).alias("out"),
        )

    done = runs.select(run, F.explode(F.aggregate("rows", start, step)["out"]).alias("r"))
    return done.select(run, F.col("r.id").alias("file_identity"), "r.admit_action")


def omitted_prefix(omitted: DataFrame, budget: int, run: str = "run_id") -> DataFrame:
    """Omitted files that get a detail row: the prefix that fits, ended by the first that does not."""
    used = windows.running(omitted, [run], ["rank"], F.col("cost")).withColumn("used", F.col("_before") + F.col("cost"))
    return used.filter(F.col("used") <= omitted_reservation(budget)).drop("_before", "_total")


def decisions(files: DataFrame, kind: str = "daily", budget: int = 60_000, per_file: int = 6_000, max_size: int = 30_000) -> DataFrame:
    """One row a file: rank, route, action, reason and characters taken. No input row is lost.

    Only narrow columns are folded; contents join in when a body is needed. input_chars is the text's length where it was
    read whole or in part, and the discovered size where there is no body to count.
    """
    slots, pages, extractions = QUOTAS[kind]
    plan = ranked(files).withColumn("route", rules.route(F.col("extension"), F.col("size_bytes"), max_size))
    routed = plan.filter(~F.col("route").rlike("^(not_parsed|reject):"))
    slotted = candidate_slots(routed, slots, pages)
    costs = routed.join(slotted.filter("slot_action = 'slot'"), ["run_id", "file_identity"]).select(
        "run_id", "rank", "file_identity", F.least(F.col("n_chars"), F.lit(per_file)).alias("cost"), (F.col("route") == "pdf").alias("needs_extraction")
    )
    admitted = first_fit(costs, budget - omitted_reservation(budget), extractions)
    out = plan.join(slotted, ["run_id", "file_identity"], "left").join(admitted, ["run_id", "file_identity"], "left")
    rejected = F.regexp_extract("route", "^(?:not_parsed|reject):(.*)$", 1)
    reason = F.when(rejected != "", rejected).when(F.col("slot_action") != "slot", F.col("slot_action")).when(F.col("admit_action") != "admit", F.col("admit_action"))
    status = F.when(F.col("route").startswith("reject:"), "error").when(reason.isNotNull(), "not_parsed").otherwise("success")
    said = rules.decision(status, reason, F.col("route"), F.col("size_bytes"), F.col("n_chars"), F.col("truncated"), F.col("extension"), max_size, per_file)
    out = out.withColumn("said", said)
    taken = F.when(F.col("said.action").isin("keep", "compress"), F.least(F.col("n_chars"), F.lit(per_file))).otherwise(0)
    return out.select("run_id", "relative_path", "extension", "priority", "rank", "route", "said.action", "said.reason", taken.cast("long").alias("output_chars"),
        F.when(F.col("said.action").isin("keep", "compress"), F.col("n_chars")).otherwise(F.col("size_bytes")).alias("input_chars"))


def waves(files: DataFrame, outcomes: DataFrame, kind: str = "daily", budget: int = 60_000, per_file: int = 6_000, max_size: int = 30_000, rounds: int = 2, late: Callable[[], bool] = lambda: False) -> tuple[DataFrame, DataFrame]:
    """The first admission and up to two more, with what finished files gave back.

    outcomes: run_id, file_identity, rendered (characters in the report, null if the file failed), inspected (pages that the
    classifier read, null if unknown). A finished file keeps what it rendered plus a separator, an unknown one all it reserved.
    Slots are spent by files that were parsed or classified, pages as inspected if known, extractions by admitted PDFs. Files
    that met a quota stand again, in rank order: PDFs that were classified need no slot now. Returns (run_id, file_identity,
    wave, reserved, retained) of admitted files, and (run_id, stop_reason, waves) of each run: complete, quota_exhausted,
    round_limit, or deadline if `late()` said so before a further wave; what the waves before admitted stands.
    """
    slots, pages, extractions = QUOTAS[kind]
    room = budget - omitted_reservation(budget)
    plan = ranked(files).withColumn("route", rules.route(F.col("extension"), F.col("size_bytes"), max_size)).filter(~F.col("route").rlike("^(not_parsed|reject):"))
    plan = plan.select("run_id", "file_identity", "rank", "route", "page_count", F.least(F.col("n_chars"), F.lit(per_file)).cast("long").alias("cost"), (F.col("route") == "pdf").alias("pdf"))
    plan = settled(plan)
    runs = plan.select("run_id").distinct()
    id_ = ["run_id", "file_identity"]
    state = plan.select(*id_, F.lit(None).cast("int").alias("wave"), F.lit(False).alias("slotted"))
    left, stopped, limit = None, None, "round_limit"
    for wave in range(rounds + 1):
        if wave and late():
            limit = "deadline"
            break
        open_ = plan.join(state.filter("wave IS NULL").select(*id_, "slotted"), id_)
        fresh = candidate_slots(open_.filter("NOT slotted"), slots, pages, left=left).filter("slot_action = 'slot'").select(*id_)
        ready = open_.join(fresh.withColumn("fresh", F.lit(True)), id_, "left").filter("slotted OR fresh")
        fitted = first_fit(ready.select(*id_, "rank", "cost", F.col("pdf").alias("needs_extraction")), room, extractions, left=left)
        new = ready.select(*id_, "pdf").join(fitted, id_).select(*id_, F.when(F.col("admit_action") == "admit", wave).alias("w"), "pdf")
        state = settled(state.join(new, id_, "left").select(*id_, F.coalesce("wave", "w").alias("wave"), (F.col("slotted") | F.coalesce("pdf", F.lit(False))).alias("slotted")))
        held = plan.join(state, id_).join(outcomes.select(*id_, "rendered", "inspected"), id_, "left")
        admitted = F.col("wave").isNotNull()
        need = F.least("page_count", F.lit(PDF_MAX_PAGES))
        retained = F.least(F.coalesce(F.col("rendered") + SEPARATOR, F.col("cost")), F.col("cost"))
        left = held.groupBy("run_id").agg(
            (F.lit(slots) - F.count_if(admitted | F.col("slotted"))).alias("slots"), (F.lit(pages) - F.coalesce(F.sum(F.when(F.col("slotted"), F.least(F.coalesce("inspected", need), need))), F.lit(0))).alias("pages"),
            (F.lit(room) - F.coalesce(F.sum(F.when(admitted, retained)), F.lit(0))).alias("budget"), (F.lit(extractions) - F.count_if(admitted & F.col("pdf"))).alias("extractions"),
            F.bool_and(admitted).alias("complete"), F.coalesce(F.bool_or(F.col("wave") == wave), F.lit(False)).alias("moved"),
        )
        left = settled(left)
        ended = F.when(F.col("complete"), "complete").when(~F.col("moved"), "quota_exhausted")
        now = left.select("run_id", ended.alias("said"), F.lit(wave).alias("at"))
        stopped = now if stopped is None else stopped.join(now.withColumnsRenamed({"said": "s2", "at": "a2"}), "run_id").select("run_id", F.coalesce("said", "s2").alias("said"), F.when(F.col("said").isNotNull(), F.col("at")).otherwise(F.col("a2")).alias("at"))
    books = held.filter(admitted).select(*id_, "wave", F.col("cost").alias("reserved"), retained.alias("retained"))
    return books, runs.join(stopped, "run_id").select("run_id", F.coalesce("said", F.lit(limit)).alias("stop_reason"), F.col("at").alias("waves"))
