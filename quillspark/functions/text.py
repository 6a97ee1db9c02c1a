"""Bounded excerpts, escapes, snippets, hashes and labels as Column expressions. Characters are Unicode scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESERVE, HEAD_PER_MILLE, FRAGMENT, CONTEXT, CUT = 64, 400, 4000, 40, "…[已截断]"


def tail(text: Column, chars: Column | int) -> Column:
    return F.right(text, F.lit(chars) if isinstance(chars, int) else chars)


def marker(prefix: str, omitted: Column) -> Column:
    return F.concat(F.lit(f"…（已省略{prefix}约 "), omitted.cast("string"), F.lit(" 字符）…"))


def head_and_tail(text: Column, limit: int) -> Column:
    """40 % head and 60 % tail around a marker, both cut back to line ends where they have one."""
    if limit < RESERVE:
        return F.left(text, F.lit(limit))
    total, room = F.length(text), max(limit - RESERVE, 1)
    head_room = room * HEAD_PER_MILLE // 1000
    head = F.left(text, F.lit(head_room))
    last = F.length(head) - F.locate("\n", F.reverse(head)) + 1
    head = F.when(head.contains("\n"), F.left(head, last)).otherwise(head)
    end = tail(text, room - head_room)
    first = F.locate("\n", end)
    end = F.when(first > 0, F.substr(end, first + 1)).otherwise(end)
    return F.concat(head, marker("中部", total - F.length(head) - F.length(end)), end)


def log_tail(text: Column, limit: int) -> Column:
    """The last characters that fit beside the marker."""
    if limit < RESERVE:
        return F.left(text, F.lit(limit))
    kept = tail(text, max(limit - RESERVE, 1))
    return F.concat(marker("头部", F.length(text) - F.length(kept)), kept)


def compressed(text: Column, extension: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).when(extension == ".log", log_tail(text, limit)).otherwise(head_and_tail(text, limit))


def bounded(text: Column, limit: int = FRAGMENT) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - len(CUT))), F.lit(CUT)))


def truncated(text: Column, limit: int, note: str = "\n\n[内容已截断]") -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), F.lit(note)))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def like_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def like_snippet(text: Column, query: str) -> Column:
    """The first hit, letter case of A-Z ignored, in brackets with 40 characters on each side; null without a hit."""
    n = len(query)
    at = F.locate(query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), ascii_lower(text))
    left = F.greatest(at - 1 - CONTEXT, F.lit(0))
    return F.when(
        at > 0,
        F.concat(
            F.when(left > 0, "…").otherwise(""), F.substr(text, left + 1, at - 1 - left), F.lit("["), F.substr(text, at, F.lit(n)), F.lit("]"),
            F.substr(text, at + n, F.lit(CONTEXT)), F.when(at + n - 1 + CONTEXT < F.length(text), "…").otherwise(""),
        ),
    )


def markdown_escaped(text: Column) -> Column:
    """Entities, a backslash before marks and before a leading #, line breaks as spaces."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.translate(F.regexp_replace(F.regexp_replace(out, r"([\\`*_|])", r"\\$1"), r"\A#", r"\\#"), "\r\n", "  ")


def cell_escaped(text: Column) -> Column:
    return F.replace(F.translate(text, "\r\n", "  "), F.lit("|"), F.lit("\\|"))


def cells(text: Column) -> Column:
    """Cells of a table row, escaped bars kept inside."""
    inner = F.regexp_replace(F.trim(text), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def markdown_separator(text: Column) -> Column:
    return F.trim(text).rlike(r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?$")


def sentences(text: Column) -> Column:
    """Split after a line break, a full stop mark, or a full stop with a space."""
    return F.filter(F.transform(F.split(text, r"(?<=[\n。！？])|(?<=\. )"), lambda s: F.trim(s)), lambda s: s != "")


def printable_ratio(text: Column) -> Column:
    kept = F.length(F.regexp_replace(text, r"[\p{Cntrl}&&[^\n\r\t]]|\x{FFFD}", ""))
    return F.when(F.length(text) == 0, 0.0).otherwise(kept / F.length(text))


def domain_hash(domain: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(domain), text), 256)


def source_id(path: Column) -> Column:
    return F.concat(F.lit("src_"), F.sha2(path, 256))


def identity(*parts: Column) -> Column:
    """Hash of the JSON array of parts, so that parts can't run together."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def source_label(position: Column) -> Column:
    return F.format_string("S%03d", position)


def column_index(reference: Column) -> Column:
    """0-based column of a cell reference; null without letters."""
    letters = F.upper(F.regexp_extract(reference, "^([A-Za-z]+)", 1))
    value = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 64)
    return F.when(letters != "", value - 1)


def cost_microunits(tokens_in: Column, tokens_out: Column, price_in: int, price_out: int) -> Column:
    """Price per million tokens, rounded up; money is never a float."""
    return F.floor((tokens_in * price_in + tokens_out * price_out + 999_999) / 1_000_000).cast("long")


def usage_total(total: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return F.greatest(F.coalesce(total, F.lit(0)), F.coalesce(tokens_in, F.lit(0)) + F.coalesce(tokens_out, F.lit(0)))


def files_per_second(files: Column, ms: Column) -> Column:
    return F.when(ms <= 0, 0.0).otherwise(F.round(files * 1000 / ms, 3))


def sample_pages(count: Column, most: int) -> Column:
    """Pages to sample: the first two, the last, an even spread, then the first not yet taken."""
    limit = F.least(count, F.lit(most))
    head = F.when(limit >= 2, F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).when(limit == 1, F.array(F.lit(1).cast("long"))).otherwise(F.array().cast("array<long>"))
    ends = F.when((F.size(head) < limit) & ~F.array_contains(head, count), F.concat(head, F.array(count))).otherwise(head)
    left = limit - F.size(ends)
    spread = F.when(left > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(left, F.lit(1))), lambda i: F.lit(1) + F.floor((count - 1) * i / (left + 1)))).otherwise(F.array().cast("array<long>"))
    wide = F.array_distinct(F.concat(ends, spread))
    rest = F.when(count > 0, F.array_except(F.sequence(F.lit(1).cast("long"), F.greatest(count, F.lit(1))), wide)).otherwise(F.array().cast("array<long>"))
    return F.slice(F.concat(wide, rest), 1, limit.cast("int"))
