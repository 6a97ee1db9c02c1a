"""Predicates and small decisions on evidence: units of text, sheet rows, reports, runs and model calls."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import rules, text

#: Kinds of units that carry no statement of their own. Fixed values.
STRUCTURE = ("heading", "table_header", "unit", "placeholder")
#: Words that qualify a statement. Fixed values.
QUALIFIERS = (
    "不得", "不能", "不代表", "不等于", "不说明", "未经", "未确认", "待确认", "例外", "除外", "无效", "必须", "断言", "为空", "两行", "不可", "不再", "相对", "基准", "并行", "二选一", "都要",
    "assert", "must not", "does not prove", "unconfirmed", "exception",
)
#: Words that make a number a finding. Fixed values.
MARKERS = (
    "#REF!", "#VALUE!", "#DIV/0!", "累计", "超过", "阈值", "合计", "总计", "统计", "生成时间", "成立日期", "成立时间", "社会信用代码", "编制单位", "报告时间", "实测", "共", "数量", "测试", "覆盖", "节点", "档位", "金额档",
    "通过", "失败", "例外", "除外", "不得", "threshold", ">=", "<=", "≥", "≤", "subtotal", "total", "count", "passed", "failed",
)
#: Gap codes that a later run can recover from, beside all that begin with MODEL_. Fixed values.
RECOVERABLE = (
    "PERSONAL_SUMMARY_UNAVAILABLE", "PERSONAL_CALL_LIMIT", "PARSE_UNAVAILABLE", "ARCHIVE_INPUT_PENDING", "MEMORY_RESERVE", "PROCESSING_CACHE_FULL", "PROCESSING_DEADLINE", "RUN_BUDGET_DEFERRED",
)
#: Omission counters that make a selection partial, words of total rows, phases of a run that is under way. Fixed values.
OMISSIONS = ("budget", "read_failed", "comparison_unavailable", "no_usable_text")
TOTALS = ("合计", "小计", "总计", "总额")
ACTIVE_PHASES = ("created", "scanning", "prepared", "generating", "db_committed")


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that finds any of the words."""
    return "|".join(re.sub(r"([#/().*+?|$^\[\]{}\\])", r"\\\1", w) for w in words)


def timeout_ms(extension: Column, by_extension: dict[str, int], otherwise: int) -> Column:
    """Milliseconds that a file of this extension may take."""
    known = F.create_map(*(F.lit(x) for pair in by_extension.items() for x in pair))
    return F.coalesce(F.element_at(known, extension), F.lit(otherwise))


def useful(kind: Column) -> Column:
    """Whether a unit is more than structure."""
    return ~kind.isin(*STRUCTURE)


def unit_priority(kind: Column, body: Column) -> Column:
    """B15 for one unit: 0 totals, 1 numbers in rows or beside a marker, 2 qualifiers, 3 rows and other numbers, 4 the rest."""
    digit = body.rlike("[0-9]")
    return rules.first_match(
        [(kind == "total", 0), ((kind == "table_row") & digit, 1), (digit & body.rlike(any_of(MARKERS)), 1), (body.rlike(any_of(QUALIFIERS)), 2), ((kind == "table_row") | (useful(kind) & digit), 3)], 4
    )


def partial(incomplete: Column, omissions: Column) -> Column:
    """Whether a selection lacks something: its inventory is incomplete, or a counter of omissions is above 0."""
    return incomplete | F.exists(F.array(*(F.lit(k) for k in OMISSIONS)), lambda k: F.coalesce(F.element_at(omissions, k), F.lit(0)) > 0)


def sheet_row_kind(cells: Column, formula: Column, total: Column) -> Column:
    """Padding of formulas, unit line, header, total or row. The first cell is the row's identity."""
    line = F.array_join(cells, " | ")
    zero = F.forall(F.filter(cells, lambda c: c != ""), lambda c: F.coalesce(c.try_cast("double") == 0, F.lit(False)))
    padding = formula & cells[0].isin("", "0") & zero
    return rules.first_match(
        [(padding, "placeholder"), (line.contains("单位") | line.contains("Unit:"), "unit"), (rules.header_row(cells, ("name", "amount", "date")), "table_header"), (line.rlike(any_of(TOTALS)) | total, "total")], "table_row"
    )


def in_scope(path: Column, root: str) -> Column:
    """Whether a path lies at or below an allowed root, in any letter case and with either separator."""
    plain = F.lower(F.translate(path, "\\", "/"))
    top = root.replace("\\", "/").rstrip("/").lower()
    return (plain == top) | plain.startswith(top + "/")


def recovery_reasons(codes: Column, read_failed: Column, items: Column, observed: Column, notes: Column) -> Column:
    """Sorted codes that a later run can recover from."""
    known = F.filter(codes, lambda c: c.startswith("MODEL_") | c.isin(*RECOVERABLE))
    unread = F.when(read_failed > 0, F.array(F.lit("PARSE_UNAVAILABLE"))).otherwise(F.array().cast("array<string>"))
    silent = F.when((items == 0) & ((observed > 0) | (F.coalesce(notes, F.lit("")) != "")), F.array(F.lit("PERSONAL_SUMMARY_UNAVAILABLE"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(F.array_union(known, unread), silent))


def unstable(reason: Column) -> Column:
    """Whether a source changed while it was read."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    return low.contains("unstable") | low.contains("source_changed") | low.isin("source_guard_unavailable", "source_version_changed")


def active(status: Column, phase: Column, finished: Column, error: Column, created: Column, now: Column, seconds: int) -> Column:
    """A run under way that is still within its time."""
    elapsed = F.unix_seconds(now) - F.unix_seconds(created)
    return (status == "running") & finished.isNull() & error.isNull() & phase.isin(*ACTIVE_PHASES) & (elapsed >= 0) & (elapsed < seconds)


def split_evenly(body: str, most: int = 240, parts: int = 3) -> list[str]:
    """A long paragraph in up to three parts, cut after the 。 or ； nearest to even lengths; the first of equally near ones."""
    n = len(body)
    cuts = [m.end() for m in re.finditer("[。；]", body) if m.end() < n]
    count = min(-(-n // most), parts, len(cuts) + 1)
    at, begin = [0], 0
    for part in range(1, count):
        end = len(cuts) - (count - 1 - part)
        i = min(range(begin, end), key=lambda i: (abs(cuts[i] - n * part // count), i))
        at.append(cuts[i])
        begin = i + 1
    return [body[x:y] for x, y in zip(at, [*at[1:], n])]


@F.udf(T.ArrayType(T.StringType()), useArrow=False)
def paragraph_parts(body: str | None) -> list[str] | None:
    """split_evenly() of each text; null stays null. A worker holds 100 texts at once, and not the 10,000 and their parts of an Arrow batch."""
    return None if body is None else split_evenly(body)


def valid_chars(body: Column) -> Column:
    """number of characters that are neither space, control, format, private use nor U+FFFD."""
    return F.length(F.regexp_replace(body, r"[\s\p{Z}\p{Cc}\p{Cf}\p{Co}\x{FFFD}]", ""))


def usage_tokens(usage: Column) -> Column:
    """(incoming, outgoing, total) of a usage JSON under either naming; the total is never below their sum."""
    parsed = F.from_json(usage, "prompt_tokens long, input_tokens long, completion_tokens long, output_tokens long, total_tokens long")
    least = lambda a, b=None: F.when(F.coalesce(parsed[a], parsed[b] if b else parsed[a]) >= 0, F.coalesce(parsed[a], parsed[b] if b else parsed[a]))
    incoming, outgoing, total = least("prompt_tokens", "input_tokens"), least("completion_tokens", "output_tokens"), least("total_tokens")
    both = F.when(incoming.isNotNull() & outgoing.isNotNull(), F.greatest(F.coalesce(total, F.lit(0)), incoming + outgoing)).otherwise(total)
    return F.struct(incoming.alias("incoming"), outgoing.alias("outgoing"), both.alias("total"))


def retry_delay(header: Column, attempt: Column, longest: int = 60) -> Column:
    """seconds to wait: those of the header, or twice as long with each attempt."""
    return F.coalesce(F.trim(header).try_cast("long"), F.least(F.pow(F.lit(2), attempt), F.lit(longest)).cast("long"))


def row_key(label: Column, header: Column, cells: Column) -> Column:
    """Identity of a table row by its first key column: one named id, or ending in a word for number. Null without a value."""
    keys = F.filter(header, lambda h: (F.lower(h) == "id") | h.endswith("编号") | h.endswith("编码") | h.endswith("单号"))
    value = F.get(cells, F.array_position(header, F.get(keys, F.lit(0))).cast("int") - 1)
    return F.when(value != "", text.identity(F.lit("row-key"), label, F.to_json(F.array(value))))


def composite_row_key(label: Column, header: Column, cells: Column, keys: Column) -> Column:
    """V02 with configured keys: identity of a row by its cells below all key columns, in their order. Null if a column or a value is missing."""
    values = F.transform(keys, lambda k: F.get(cells, F.array_position(header, k).cast("int") - 1))
    whole = (F.size(keys) > 0) & ~F.exists(keys, lambda k: F.array_position(header, k) == 0) & ~F.exists(values, lambda v: F.coalesce(v, F.lit("")) == "")
    return F.when(whole, text.identity(F.lit("row-key"), label, F.to_json(values)))


def inferred_keys(header: Column) -> Column:
    """The first header that names an id, as an array of one or none."""
    low = lambda h: F.lower(h)
    return F.slice(F.filter(header, lambda h: (low(h) == "id") | low(h).endswith("编号") | low(h).endswith("编码") | low(h).endswith("单号")), 1, 1)


def scan_quality(failed: Column, sources: Column, usable: Column, gaps: Column) -> Column:
    """What a scan amounts to."""
    return rules.first_match(
        [(failed, "unavailable"), ((sources == 0) & (gaps == 0), "no_changes"), ((sources == 0) | (usable == 0), "unavailable"), (gaps > 0, "partial")], "complete"
    )

