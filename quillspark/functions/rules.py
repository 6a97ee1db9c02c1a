"""Per-row rules of the evidence pipeline as Column expressions: paths, priorities, routes, decisions, tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by parser route. Fixed values.
LIGHT_TEXT = (".txt", ".md", ".csv", ".json", ".log")
OFFICE = (".docx", ".pptx")
LEGACY = (".doc", ".ppt")
OFFICE_OR_PDF = (".docx", ".pptx", ".xlsx", ".xls", ".doc", ".ppt", ".pdf")
TEXT_LIKE = (".md", ".txt")
#: Keyword classes of facts, most urgent first. Fixed values.
FACT_WORDS = (
    ("审批", "权限", "制度", "授权"),
    ("金额", "万元", "亿元", "异常", "差异", "超额", "¥", "￥"),
    ("完成", "阻塞", "延期", "失败", "终止"),
    ("截止", "期限", "到期", "限期"),
)


def first_match(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first case that holds."""
    tail = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(cases), tail)


def normalized_path(path: Column) -> Column:
    """Lower case, one kind of separator, none at the ends."""
    return F.lower(F.trim(F.translate(path, "/", "\\"), F.lit("\\")))


def file_identity(path: Column) -> Column:
    return F.concat(F.lit("bootstrap:"), F.lower(path))


def priority(path: Column, extension: Column) -> Column:
    """Rank class of a file; lower is read first."""
    inside = F.concat(F.lit("\\"), normalized_path(path), F.lit("\\"))
    return first_match(
        [
            (inside.contains("\\.pytest_cache\\") | inside.contains("\\data\\benchmarks\\"), 70),
            (inside.contains("\\logs\\"), 60),
            (extension.isin(*OFFICE_OR_PDF), 20),
            (extension.isin(*TEXT_LIKE), 30),
        ],
        50,
    )


def route(extension: Column, size: Column, max_size: int, legacy: bool = False) -> Column:
    """Parser route, or the reason why a file is not parsed."""
    return first_match(
        [
            (size > max_size, "not_parsed:file_size_policy"),
            (extension.isin(*LIGHT_TEXT), "light_text"),
            (extension == ".xlsx", "rust_xlsx"),
            (extension.isin(*OFFICE), "rust_office"),
            (extension == ".xls", "rust_xls"),
            (extension == ".pdf", "pdf"),
            (extension.isin(*LEGACY), "rust_legacy_office" if legacy else "not_parsed:legacy_extension_disabled"),
        ],
        "reject:profile_route_invariant",
    )


def compression_reason(extension: Column) -> Column:
    return first_match([(extension == ".log", "large_log_tail"), (extension.isin(*OFFICE_OR_PDF), "large_document_summary")], "medium_text_compress")


def decision(status: Column, reason: Column, backend: Column, size: Column, chars: Column, truncated: Column, extension: Column, large: int, per_file: int) -> Column:
    """(action, reason) of one file's evidence: every status ends in exactly one pair."""
    pair = lambda action, why: F.struct(F.lit(action).alias("action"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
    no_text = (backend == "pdf_metadata_v2") & (reason == "pdf_no_text_in_parse_window")
    return first_match(
        [
            (status.isin("error", "timeout"), pair("error", F.coalesce(reason, F.lit("parse_error")))),
            (status == "not_parsed", pair("omit", reason)),
            (F.coalesce(no_text, F.lit(False)), pair("metadata_only", "pdf_no_text_in_parse_window")),
            (F.coalesce(size, F.lit(0)) > large, pair("metadata_only", "file_size_policy")),
            ((chars <= per_file) & ~truncated, pair("keep", "small_file_keep")),
        ],
        pair("compress", compression_reason(extension)),
    )


def fact_priority(text: Column) -> Column:
    return first_match([(reduce(lambda a, b: a | b, (text.contains(w) for w in words)), i) for i, words in enumerate(FACT_WORDS)], len(FACT_WORDS))


def allowed_extension(name: Column, extensions: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(name).endswith(e.lower()) for e in extensions))


def glob_regex(pattern: str) -> str:
    """A file-name glob as an anchored regular expression."""
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(c) or (c if c.isalnum() or c in "_- " else "\\" + c) for c in pattern.lower()) + "$"


def ignored(name: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(name).rlike(glob_regex(p)) for p in patterns))


def excluded_dir(path: Column, names: tuple[str, ...], roots: tuple[str, ...]) -> Column:
    """A named folder at any depth, or below a rooted one."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    inside = F.arrays_overlap(folders, F.array(*(F.lit(n) for n in names))) if names else F.lit(False)
    return reduce(lambda a, b: a | b, (F.concat(path, F.lit("/")).startswith(r.rstrip("/") + "/") for r in roots), inside)


def source_version(mtime_ns: Column, size: Column) -> Column:
    return F.format_string("mtime_ns=%d:size=%d", mtime_ns.cast("long"), size.cast("long"))


def version_parts(version: Column) -> Column:
    """(mtime_ns, size) of a source version, nulls if it is not one."""
    number = lambda i: F.nullif(F.regexp_extract(version, r"^mtime_ns=(\d+):size=(\d+)$", i), F.lit("")).cast("long")
    return F.struct(number(1).alias("mtime_ns"), number(2).alias("size"))


def relative_path(path: Column, root: str) -> Column:
    """Below root with either separator; null if outside of it or climbing out."""
    slashed, base = F.translate(path, "\\", "/"), root.replace("\\", "/").rstrip("/") + "/"
    rest = F.substr(slashed, F.lit(len(base) + 1))
    climbs = F.array_contains(F.split(rest, "/"), "..")
    return F.when(slashed.startswith(base) & ~climbs & (rest != ""), rest)


def usable(status: Column, chars: Column, content_hash: Column) -> Column:
    return (status == "success") & (chars > 0) & content_hash.isNotNull()


def coverage(status: Column, chars: Column, content_hash: Column, reason: Column, extension: Column, cut: Column) -> Column:
    """Coverage of a source: primary status, primary reason and sorted tags."""
    why = F.coalesce(reason, F.lit(""))
    state = first_match(
        [
            (status == "not_parsed", "not_parsed"),
            ((status != "success") | ((chars > 0) & content_hash.isNull()), "parse_failed"),
            (chars > 0, "usable_excerpt"),
        ],
        "empty_excerpt",
    )
    primary = first_match(
        [
            (state == "not_parsed", F.when(why.contains("size"), "file_too_large").otherwise("unknown")),
            (state == "parse_failed", first_match([(status == "timeout", "parse_timeout"), (why.contains("unstable") | why.contains("source_changed"), "source_unstable")], "parser_failed")),
            (state == "usable_excerpt", F.lit(None).cast("string")),
            (cut | (why == "excerpt_character_budget"), "excerpt_character_budget"),
            ((extension == ".pdf") & why.contains("no_text"), "pdf_window_no_text"),
            (why.contains("empty"), "empty_document"),
        ],
        "no_business_content",
    )
    tags = F.array(
        F.when(status != "success", "SOURCE_UNAVAILABLE"), F.when(extension == ".csv", "PARSE_BOUNDED"),
        F.when(cut | (state == "empty_excerpt"), "EXCERPT_BOUNDED"),
    )
    return F.struct(state.alias("status"), primary.alias("primary"), F.array_sort(F.filter(tags, lambda t: t.isNotNull())).alias("tags"))


def header_row(cells: Column, labels: tuple[str, ...]) -> Column:
    """No numeric cell, and two known labels at least."""
    numeric = F.exists(cells, lambda c: c.rlike(r"^\s*[+-]?[0-9][0-9,]*(\.[0-9]+)?%?\s*$"))
    return ~numeric & (F.size(F.filter(cells, lambda c: F.lower(F.trim(c)).isin(*labels))) >= 2)


def vertical_sum(formula: Column, row: Column) -> Column:
    """SUM over one column, only rows above."""
    part = lambda i: F.regexp_extract(F.upper(formula), r"^=?SUM\(\$?([A-Z]+)\$?(\d+):\$?([A-Z]+)\$?(\d+)\)$", i)
    matched = part(1) != ""
    return matched & (part(1) == part(3)) & (F.nullif(part(4), F.lit("")).cast("long") < row)
