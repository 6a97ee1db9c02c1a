"""Composed reports: selection of facts, order-dependent merging of matters, coverage and bounds.

Facts are rows (report, fact_id, matter_id, pending, text, source_ids). Items are rows (report, part, place, slot, matter, matter_id, title, text,
fact_ids): slot is overview, background, detail, status or pending; place orders the items of a part, and matter numbers the matter of a part that an
item belongs to. A report has few parts of at most 64 items each, so it is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.operators.groups import folded

#: Items an overview has at most, facts of a step, ids of an item, conditions of a fact. Fixed values.
OVERVIEW, FACTS, IDS, CONDITIONS = 5, 64, 64, 20
#: Longest text of each field in characters. Fixed values.
BOUNDS = {"topic": 120, "detail": 4000, "background": 2000, "status": 1000, "uncertainty": 2000, "condition": 1000, "title": 120, "item": 6000}
MATTER_SLOTS = ("background", "detail", "status")
MERGED = "slot string, place int, matter int, matter_id string, title string, text string, fact_ids array<string>"


def bounded(text: Column, most: int) -> Column:
    """Whether a text has other than white space and keeps within its length; null is not a text."""
    return F.coalesce((F.length(F.regexp_replace(text, r"(?U)\s", "")) > 0) & (F.length(text) <= most), F.lit(False))


def fact_problems(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """step, fact and the first bound that a fact breaks; facts that keep all don't come.

    facts: (step, fact, topic, detail, background, status, uncertainty, conditions, source_ids, pending); sources: (step, source_id, unverified), those the step
    was given. A fact with an uncertainty is pending. A fact that is not may not rest on an unverified source. A step has 64 facts at most.
    """
    optional = lambda name: F.col(name).isNull() | bounded(F.col(name), BOUNDS[name])
    pending = F.coalesce(F.col("pending"), F.lit(False)) | F.col("uncertainty").isNotNull()
    cited = facts.select("step", "fact", pending.alias("open"), F.explode(F.array_distinct("source_ids")).alias("source_id"))
    cited = cited.join(sources.select("step", "source_id", F.coalesce("unverified", F.lit(False)).alias("unverified")), ["step", "source_id"], "left")
    cited = cited.groupBy("step", "fact").agg(F.bool_or(F.col("unverified").isNull()).alias("unknown"), F.bool_or(F.coalesce("unverified", F.lit(False)) & ~F.col("open")).alias("rests"))
    many = facts.groupBy("step").agg((F.count("*") > FACTS).alias("many"))
    j = facts.join(cited, ["step", "fact"], "left").join(many, "step")
    ids = F.size(F.array_distinct(F.coalesce("source_ids", F.array().cast("array<string>"))))
    conditions = F.coalesce("conditions", F.array().cast("array<string>"))
    problem = rules.first_match(
        [
            (F.col("many"), "too_many_facts"), (~bounded(F.col("topic"), BOUNDS["topic"]), "topic"), (~bounded(F.col("detail"), BOUNDS["detail"]), "detail"), (~optional("background"), "background"), (~optional("status"), "status"),
            (~optional("uncertainty"), "uncertainty"), (F.size(conditions) > CONDITIONS, "too_many_conditions"), (F.exists(conditions, lambda c: ~bounded(c, BOUNDS["condition"])), "condition"), ((ids < 1) | (ids > IDS), "sources"),
            (F.coalesce("unknown", F.lit(False)), "unknown_source"), (F.coalesce("rests", F.lit(False)), "unverified_source"),
        ],
        F.lit(None).cast("string"),
    )
    return j.select("step", "fact", problem.alias("problem")).filter("problem IS NOT NULL")


def merge_parts(items: list[dict], facts: dict[str, dict]) -> list[dict]:
    """Merged items of a report's items in order of parts and places; facts by id have rank (0 best) and matter_id.

    A part's matter joins the first one so far with the same id; if either has none, the first with the same trimmed title or with
    a fact of a detail in common. What it says goes to that one's details. The overview is chosen from all overviews and then all matters,
    best rank first: an item that names no new matter (or fact without one) goes, and five stay.
    """
    worst = 4
    rank = lambda item: min((facts[i]["rank"] for i in item["fact_ids"] if i in facts), default=worst)
    matters: list[dict] = []
    overview, pending, here = [], [], {}
    for item in items:
        if item["slot"] == "overview":
            overview.append(item)
        elif item["slot"] == "pending":
            pending.append(item)
        else:
            here.setdefault((item["part"], item["matter"]), []).append(item)
    for said in here.values():
        slots = {s: [i for i in said if i["slot"] == s] for s in MATTER_SLOTS}
        name, title, about = said[0]["matter_id"], (said[0]["title"] or "").strip(), {f for i in slots["detail"] for f in i["fact_ids"]}

        def same(m: dict) -> bool:
            if m["matter_id"] is not None and name is not None:
                return m["matter_id"] == name
            return m["title"] == title or any(about.intersection(i["fact_ids"]) for i in m["detail"])

        home = next((m for m in matters if same(m)), None)
        if home is None:
            matters.append({"matter_id": name, "title": title, **slots})
        else:
            home["detail"] += slots["background"] + slots["detail"] + slots["status"]
    told = lambda m: [i for s in MATTER_SLOTS for i in m[s]]
    seen: set = set()
    first = []
    for item in sorted(overview + [i for m in matters for i in told(m)], key=rank):
        keys = {(facts.get(f, {}).get("matter_id") or f) for f in item["fact_ids"]}
        if keys - seen:
            first.append(item)
            seen |= keys
    matters.sort(key=lambda m: min(map(rank, told(m)), default=worst))
    out = [{"slot": "overview", "matter": None, "matter_id": None, "title": None, **_said(i)} for i in first[:OVERVIEW]]
    for n, m in enumerate(matters):
        out += [{"slot": s, "matter": n, "matter_id": m["matter_id"], "title": m["title"], **_said(i)} for s in MATTER_SLOTS for i in m[s]]
    out += [{"slot": "pending", "matter": None, "matter_id": None, "title": None, **_said(i)} for i in pending]
    return [{**row, "place": n} for n, row in enumerate(out)]


def _said(item: dict) -> dict:
    return {"text": item["text"], "fact_ids": list(item["fact_ids"])}


def merged(items: DataFrame, facts: DataFrame) -> DataFrame:
    """report, slot, place, matter, matter_id, title, text and fact_ids of each report's merged items.

    Facts rank by the words of their text. Items without a report don't come; a report without facts ranks all items last.
    """
    kind = items.schema["report"].dataType.simpleString()
    ranked = facts.select("report", "fact_id", "matter_id", rules.fact_priority(F.coalesce("text", F.lit(""))).alias("rank"))

    def merge(group: list[tuple]) -> list[tuple]:
        names = ("part", "place", "slot", "matter", "matter_id", "title", "text", "fact_ids")
        by_id = {r[9]: {"matter_id": r[5], "rank": r[10]} for r in group if r[11]}
        rows = [dict(zip(names, r[1:9])) for r in group if not r[11]]
        for r in rows:
            r["fact_ids"] = r["fact_ids"] or []
        return [(group[0][0], *(r[c] for c in ("slot", "place", "matter", "matter_id", "title", "text", "fact_ids"))) for r in merge_parts(rows, by_id)]

    narrow = items.filter("report IS NOT NULL").select("report", "part", "place", "slot", "matter", "matter_id", "title", "text", "fact_ids", F.lit(False).alias("known"))
    both = narrow.unionByName(ranked.filter("report IS NOT NULL").withColumn("known", F.lit(True)), allowMissingColumns=True)
    both = both.select("report", "part", "place", "slot", "matter", "matter_id", "title", "text", "fact_ids", "fact_id", "rank", "known")
    return folded(both, "report", ["part", "place"], merge, f"report {kind}, {MERGED}")


def uncovered(facts: DataFrame, items: DataFrame) -> DataFrame:
    """report, fact_id and pending of facts that a composed report leaves out.

    A pending fact must stand among the pending items; another one in a matter or among the pending items. The overview covers nothing.
    """
    cited = items.select("report", (F.col("slot") == "pending").alias("as_pending"), F.col("slot").isin(*MATTER_SLOTS).alias("in_matter"), F.explode("fact_ids").alias("fact_id"))
    cited = cited.groupBy("report", "fact_id").agg(F.bool_or("as_pending").alias("as_pending"), F.bool_or("in_matter").alias("in_matter"))
    j = facts.select("report", "fact_id", F.coalesce("pending", F.lit(False)).alias("pending")).join(cited, ["report", "fact_id"], "left")
    stands = F.coalesce(F.col("as_pending") | (~F.col("pending") & F.col("in_matter")), F.lit(False))
    return j.filter(~stands).select("report", "fact_id", "pending")


def composition_problems(items: DataFrame, facts: DataFrame) -> DataFrame:
    """report, place and rule of each breach in composed items, which carry their source_ids; a rule of the report as a whole has no place."""
    f = facts.groupBy("report", "fact_id").agg(F.first("source_ids").alias("theirs"), F.bool_or(F.coalesce("pending", F.lit(False))).alias("pending"))
    cited = items.select("report", "place", F.explode(F.array_distinct("fact_ids")).alias("fact_id")).join(f, ["report", "fact_id"], "left")
    cited = cited.groupBy("report", "place").agg(F.bool_or(F.col("theirs").isNull()).alias("unknown"), F.bool_or(F.coalesce("pending", F.lit(False))).alias("open"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("theirs")))).alias("expected"))
    j = items.join(cited, ["report", "place"], "left")
    none = F.array().cast("array<string>")
    breach = [
        (~bounded(F.col("text"), BOUNDS["item"]), "text"),
        ((F.size("fact_ids") < 1) | (F.size("fact_ids") > IDS) | (F.size(F.array_distinct("fact_ids")) < F.size("fact_ids")) | F.coalesce("unknown", F.lit(True)), "facts"),
        (~F.array_sort(F.coalesce("source_ids", none)).eqNullSafe(F.coalesce("expected", none)), "sources"),
        ((F.col("slot") != "pending") & F.coalesce("open", F.lit(False)), "pending_fact"),
        (F.col("slot").isin(*MATTER_SLOTS) & ~bounded(F.col("title"), BOUNDS["title"]), "title"),
    ]
    rows = j.select("report", "place", F.explode(F.array_compact(F.array(*(F.when(c, name) for c, name in breach)))).alias("rule"))
    matters = items.filter(F.col("slot").isin(*MATTER_SLOTS)).groupBy("report", "matter").agg(F.first(F.coalesce("matter_id", F.trim("title"))).alias("name"), F.count_if(F.col("slot") == "detail").alias("details"))
    names = matters.withColumn("n", F.count("*").over(Window.partitionBy("report", "name"))).groupBy("report").agg(F.max("n").alias("same"), F.min("details").alias("details"))
    sizes = items.groupBy("report").agg(F.count_if(F.col("slot") == "overview").alias("overview")).join(names, "report", "full")
    sizes = facts.groupBy("report").agg(F.count_if(~F.coalesce("pending", F.lit(False))).alias("confirmed")).join(sizes, "report", "full")
    whole = [(F.col("overview") > OVERVIEW, "overview_too_long"), (F.col("same") > 1, "matter_twice"), (F.col("details") < 1, "matter_without_detail"), ((F.col("confirmed") > 0) & ((F.coalesce("overview", F.lit(0)) == 0) | F.col("same").isNull()), "nothing_composed")]
    return rows.unionByName(sizes.select("report", F.lit(None).cast("int").alias("place"), F.explode(F.array_compact(F.array(*(F.when(c, name) for c, name in whole)))).alias("rule")))
