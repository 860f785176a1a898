"""Sections, issues and verdict of a review answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.arrays import let, running
from corpuslens.functions.text import ascii_lower, split_lines, trim_ws

# Section names, and prefixes of answers that are no review.
SECTIONS = ["SUMMARY", "ISSUES", "SUGGESTIONS", "ERROR", "SKIPPED"]
ERROR_PREFIX = "[ERROR]"
SKIPPED_PREFIX = "[SKIPPED]"

# Lines that say there is nothing to report.
NO_ISSUES = [
    "none",
    "no issues",
    "no major issues",
    "no critical issues",
    "no obvious issues",
    "no significant issues",
]

MARKER = (
    r"\A[ \t\r\n#*_>-]*+\[(" + "|".join(SECTIONS) + r")\][ \t\r\n*_]*+:?[ \t\r\n*_]*+\z"
)
FENCE = "```"


def marker_name(line: Column) -> Column:
    """Section a line opens, or an empty string."""
    return F.regexp_extract(line, MARKER, 1)


def marker_match(line: Column, name: str) -> Column:
    return marker_name(line) == name


def is_fence(line: Column) -> Column:
    return F.startswith(trim_ws(line), F.lit(FENCE))


def fence_state(lines: Column) -> Column:
    """``array<struct<line,fenced>>``; a closing fence line counts as outside."""
    moved = lambda fences, line: fences + is_fence(line).cast("int")
    return running(
        lines,
        F.lit(0),
        moved,
        lambda fences, line: F.struct(
            line.alias("line"), (moved(fences, line) % 2 == 1).alias("fenced")
        ),
        "struct<line:string,fenced:boolean>",
    )


def section_marks(fenced_lines: Column) -> Column:
    """``array<struct<at,name>>`` of the marker lines outside fences."""
    marks = F.transform(
        fenced_lines,
        lambda l, i: F.struct(
            i.alias("at"), F.when(~l["fenced"], marker_name(l["line"])).otherwise("").alias("name")
        ),
    )
    return F.filter(marks, lambda m: m["name"] != "")


def extract_section(lines: Column, marks: Column, name: str) -> Column:
    """Text between the first marker of that name and the next marker of any name."""

    def cut(lines: Column, marks: Column) -> Column:
        first = F.get(F.filter(marks, lambda m: m["name"] == name), F.lit(0))["at"]

        def between(start: Column) -> Column:
            after = F.get(F.filter(marks, lambda m: m["at"] > start), F.lit(0))["at"]
            end = F.coalesce(after, F.size(lines))
            body = F.array_join(F.slice(lines, start + 2, end - start - 1), "\n")
            return F.when(start.isNull(), F.lit("")).otherwise(trim_ws(body))

        return let(first, between)

    return let(lines, lambda ls: let(marks, lambda ms: cut(ls, ms)))


def strip_markdown_prefix(line: Column) -> Column:
    return trim_ws(F.regexp_replace(line, r"\A[ \t\r\n#*_>-]++", ""))


def normalize_issue_line(line: Column) -> Column:
    """Line without list, number and emphasis marks around it."""
    head = F.regexp_replace(line, r"\A[ \t\r\n#*_>-]*+[ \t\r\n.):`0-9]*+", "")
    return F.regexp_replace(head, r"[ \t\r\n.:;*`_]+\z", "")


def is_issue_line(line: Column) -> Column:
    return let(
        normalize_issue_line(line),
        lambda plain: (plain != "") & ~ascii_lower(plain).isin(NO_ISSUES),
    )


def meaningful_issues(section: Column) -> Column:
    return F.exists(split_lines(section), is_issue_line)


def is_error(status: Column, analysis: Column) -> Column:
    return (status == "error") | F.startswith(analysis, F.lit(ERROR_PREFIX))


def is_skipped(status: Column, analysis: Column) -> Column:
    return (status == "skipped") | F.startswith(analysis, F.lit(SKIPPED_PREFIX))


def default_status(status: Column, analysis: Column) -> Column:
    """A missing status is read off the text; an empty one is kept."""
    guess = F.when(F.startswith(analysis, F.lit(ERROR_PREFIX)), "error").otherwise("generated")
    return F.coalesce(status, guess)


def verdict(
    error: Column, skipped: Column, rule_issues: Column, issues: Column, suggestions: Column
) -> Column:
    return (
        F.when(error | (F.size(rule_issues) > 0) | issues, "PROBLEM")
        .when(skipped | (suggestions != ""), "IMPROVE")
        .otherwise("GOOD")
    )
