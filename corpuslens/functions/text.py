"""Text functions shared by the parser, the rules and the report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
WHITESPACE = " \t\r\n"

# Messages of the three rules, in report order.
NEW_WITHOUT_DELETE = "Possible memory leak: 'new' used without 'delete'"
MALLOC_WITHOUT_FREE = "Possible memory leak: 'malloc' used without 'free'"
INFINITE_LOOP = "Potential infinite loop detected"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def trim_ws(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` would also change other letters."""
    return F.translate(text, UPPER, LOWER)


def eq_ignore_ascii_case(left: Column, right: Column) -> Column:
    return ascii_lower(left) == ascii_lower(right)


def split_lines(text: Column) -> Column:
    """Lines between newlines, each without one trailing carriage return."""
    return F.transform(F.split(text, "\n", -1), lambda line: F.regexp_replace(line, r"\r\z", ""))


def universal_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with every line end turned into a newline."""
    return F.sha2(universal_newlines(text), 256)


def rule_checks(text: Column) -> Column:
    """Messages of the rules that fire, as plain substring tests on the raw text."""
    has = lambda word: F.contains(text, F.lit(word))
    return F.array_compact(
        F.array(
            F.when(has("new ") & ~has("delete"), F.lit(NEW_WITHOUT_DELETE)),
            F.when(has("malloc") & ~has("free"), F.lit(MALLOC_WITHOUT_FREE)),
            F.when(has("while(true)") | has("for(;;)"), F.lit(INFINITE_LOOP)),
        )
    )


def utc_stamp(instant: Column) -> Column:
    """ISO text in seconds; the session time zone must be UTC."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")
