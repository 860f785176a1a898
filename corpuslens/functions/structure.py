"""Includes, types and public methods of one C or C++ text.

Everything here works inside the row: the text of a file never goes through a
shuffle to be parsed, and no Python worker sees it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.arrays import let, running
from corpuslens.functions.text import trim_ws

# Literals. Possessive repeats keep the matcher iterative on long literals.
RAW_STRING = r'R"([^ \t\r\n()\\]{0,16})\((?:.*?\)\1"|.*\z)'
STRING = r'"(?:[^"\\]|\\.)*+(?:"|\\?\z)'
CHAR = r"'(?:[^'\\]|\\.)*+(?:'|\\?\z)"

COMMENT_TOKENS = rf"""(?s){RAW_STRING}|{STRING}|{CHAR}|//[^\n]*+|/\*(?:.*?\*/|.*\z)|[^R"'/]++|."""

INCLUDE = r'(?:\A|\n)[ \t\r]*+#[ \t\r]*+include[ \t\r]*+(<[^>\n]*+>|"[^"\n]*+")'

TYPE_HEAD = (
    r"(?:template\s*+<[^;{]*>\s*+)*(?:\[\[[^\]]++\]\]\s*+)*"
    r"(?<![A-Za-z0-9_])(class|struct)\s++([A-Za-z_]\w*+)[^;{]*+\{"
)

# Code up to and including the next brace outside literals, or up to the end.
UP_TO_BRACE = rf"""(?s)(?:{RAW_STRING}|{STRING}|{CHAR}|[^R"'{{}}]++|R)*+([{{}}]|\z)"""

UP_TO_BREAK = r"[^(){};]*+(?:[(){};]|\z)"

ACCESS_LABELS = r"\A(?:[ \t\r\n]*+(public|private|protected)[ \t\r\n]*+:)++"

# Statements that start like this are never methods.
NOT_A_METHOD_START = (
    r"\A(?:using |typedef |friend |enum |class |struct |static_assert|if[ (]|for[ (]|"
    r"while[ (]|switch[ (]|return |catch |else|#)"
)

# Words that look like a call but are not a method name.
CONTROL_WORDS = "if|for|while|switch|catch|return|sizeof|alignof|decltype|requires"

# A name right before the first parenthesis, and not a control word.
METHOD_NAME = (
    rf"\A(?:[^(]*[ \t*&:])?(?!(?:{CONTROL_WORDS})[ \t\r\n]*\()"
    r"[A-Za-z_~][^ \t*&:(]*[ \t\r\n]*\("
)

# What may follow the last closing parenthesis.
METHOD_END = (
    r"(?s)\A[^(]*+\(.*\)[ \t\r\n]*(?:;|\{|= default;|= delete;|= 0;|"
    r"(?:const|noexcept|override|final|requires|->|&)[^)]*)?\z"
)


def strip_comments(text: Column) -> Column:
    """Text without comments; newlines and all literals stay."""
    tokens = F.regexp_extract_all(text, F.lit(COMMENT_TOKENS), F.lit(0))
    kept = F.transform(
        tokens,
        lambda token: F.when(F.startswith(token, F.lit("//")), F.lit(""))
        .when(F.startswith(token, F.lit("/*")), F.regexp_replace(token, r"[^\n]++", ""))
        .otherwise(token),
    )
    has_comment = F.contains(text, F.lit("//")) | F.contains(text, F.lit("/*"))
    return F.when(has_comment, F.array_join(kept, "")).otherwise(text)


def collect_headers(names: Column) -> Column:
    """Distinct names in the order they are first seen."""
    return F.array_distinct(names)


def extract_headers(stripped: Column) -> Column:
    # A text without the word is not searched.
    may_include = F.contains(stripped, F.lit("include"))
    quoted = F.when(~may_include, F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(stripped, F.lit(INCLUDE), F.lit(1))
    )
    return collect_headers(
        F.transform(quoted, lambda name: F.substring(name, F.lit(2), F.length(name) - 2))
    )


def brace_steps(stripped: Column) -> Column:
    """Text cut after every brace outside literals: ``array<struct<len,mark>>``."""
    return F.zip_with(
        F.regexp_extract_all(stripped, F.lit(UP_TO_BRACE), F.lit(0)),
        F.regexp_extract_all(stripped, F.lit(UP_TO_BRACE), F.lit(2)),
        lambda piece, mark: F.struct(F.length(piece).alias("len"), mark.alias("mark")),
    )


def brace_marks(steps: Column) -> Column:
    """``array<struct<pos,mark>>`` of the braces outside literals, 0-based."""
    placed = running(
        steps,
        F.lit(0),
        lambda at, step: at + step["len"],
        lambda at, step: F.struct((at + step["len"] - 1).alias("pos"), step["mark"].alias("mark")),
        "struct<pos:int,mark:string>",
    )
    return F.filter(placed, lambda m: m["mark"] != "")


def brace_pairs(marks: Column) -> Column:
    """``array<struct<open,close,level>>`` from :func:`brace_marks`, by closing position."""

    def step(stack: Column, mark: Column) -> Column:
        return (
            F.when(mark["mark"] == "{", F.concat(F.array(mark["pos"]), stack))
            .when(F.size(stack) > 0, F.slice(stack, F.lit(2), F.size(stack)))
            .otherwise(stack)
        )

    def emit(stack: Column, mark: Column) -> Column:
        return F.when(
            (mark["mark"] == "}") & (F.size(stack) > 0),
            F.struct(
                F.get(stack, F.lit(0)).alias("open"),
                mark["pos"].alias("close"),
                F.size(stack).alias("level"),
            ),
        )

    pairs = running(
        marks,
        F.array().cast("array<int>"),
        step,
        emit,
        "struct<open:int,close:int,level:int>",
    )
    return F.filter(pairs, lambda pair: pair.isNotNull())


def head_steps(stripped: Column) -> Column:
    """Type heads, each with the text since the previous one."""
    steps = F.zip_with(
        F.split(stripped, TYPE_HEAD, -1),
        F.regexp_extract_all(stripped, F.lit(TYPE_HEAD), F.lit(0)),
        lambda gap, head: F.struct(
            (F.length(gap) + F.length(head)).alias("len"),
            head.alias("head"),
            F.endswith(trim_ws(gap), F.lit("enum")).alias("after_enum"),
        ),
    )
    may_have_types = (F.contains(stripped, F.lit("class")) | F.contains(stripped, F.lit("struct"))) & F.contains(
        stripped, F.lit("{")
    )
    return F.when(may_have_types, F.filter(steps, lambda step: step["head"].isNotNull())).otherwise(
        F.array().cast("array<struct<len:int,head:string,after_enum:boolean>>")
    )


def type_heads(steps: Column) -> Column:
    """``array<struct<open,keyword,name,after_enum>>`` in text order."""
    return running(
        steps,
        F.lit(0),
        lambda at, step: at + step["len"],
        lambda at, step: F.struct(
            (at + step["len"] - 1).alias("open"),
            F.regexp_extract(step["head"], TYPE_HEAD, 1).alias("keyword"),
            F.regexp_extract(step["head"], TYPE_HEAD, 2).alias("name"),
            step["after_enum"].alias("after_enum"),
        ),
        "struct<open:int,keyword:string,name:string,after_enum:boolean>",
    )


def exclude_enum(heads: Column) -> Column:
    return F.filter(heads, lambda head: ~head["after_enum"])


def _entry(pos: Column, kind: int, close: Column, keyword: Column, name: Column) -> Column:
    return F.struct(
        pos.alias("open"), F.lit(kind).alias("kind"), close.alias("close"), keyword.alias("keyword"), name.alias("name")
    )


def heads_and_braces(heads: Column, marks: Column, pairs: Column) -> Column:
    """Opening braces (0), the ones that close (1) and heads (2) in one order of position."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    opens = F.filter(marks, lambda m: m["mark"] == "{")
    return F.array_sort(
        F.concat(
            F.transform(opens, lambda m: _entry(m["pos"], 0, number, text, text)),
            F.transform(pairs, lambda p: _entry(p["open"], 1, p["close"], text, text)),
            F.transform(heads, lambda h: _entry(h["open"], 2, number, h["keyword"], h["name"])),
        )
    )


PLACED = "struct<open:int,close:int,keyword:string,name:string,code:boolean>"


def placed_heads(entries: Column) -> Column:
    """Heads of :func:`heads_and_braces` with ``close`` and ``code``: whether their brace is code.

    A head stands right behind its own brace, so one pass over the entries finds both.
    """

    def step(at: Column, entry: Column) -> Column:
        seen = F.struct(entry["open"].alias("open"), entry["close"].alias("close"))
        return F.when(entry["kind"] < 2, seen).otherwise(at)

    def emit(at: Column, entry: Column) -> Column:
        here = at["open"] == entry["open"]
        return F.when(
            entry["kind"] == 2,
            F.struct(
                entry["open"].alias("open"), F.when(here, at["close"]).alias("close"),
                entry["keyword"].alias("keyword"), entry["name"].alias("name"), here.alias("code"),
            ),
        )

    zero = F.struct(F.lit(-1).alias("open"), F.lit(None).cast("int").alias("close"))
    return F.filter(running(entries, zero, step, emit, PLACED), lambda head: head.isNotNull())


def _body(head: Column, close: Column) -> Column:
    return F.struct(
        head["open"].alias("open"),
        close.alias("close"),
        head["keyword"].alias("keyword"),
        head["name"].alias("name"),
    )


def closed_bodies(placed: Column) -> Column:
    """Heads whose brace is code and closes."""
    closed = F.filter(placed, lambda head: head["code"] & head["close"].isNotNull())
    return F.transform(closed, lambda head: _body(head, head["close"]))


def loose_heads(placed: Column) -> Column:
    """Heads inside a literal; their brace scan starts afresh at their own brace."""
    return F.filter(placed, lambda head: ~head["code"])


def steps_from_first(stripped: Column, heads: Column) -> Column:
    """The brace scan that the first of some loose heads starts.

    A loose head whose brace is code in this scan would go on just like it, so all
    of these share it. Most often that is every head of every literal.
    """
    start = F.get(heads, F.lit(0))["open"]
    return brace_steps(F.coalesce(F.substring(stripped, start + 1, F.length(stripped)), F.lit("")))


def shifted(marks: Column, heads: Column) -> Column:
    """Marks of :func:`steps_from_first`, counted from the start of the text."""
    start = F.get(heads, F.lit(0))["open"]
    return F.transform(marks, lambda m: F.struct((m["pos"] + start).alias("pos"), m["mark"].alias("mark")))


def restarted_steps(stripped: Column, heads: Column) -> Column:
    return let(
        stripped,
        lambda text: F.transform(
            heads, lambda head: brace_steps(F.substring(text, head["open"] + 1, F.length(text)))
        ),
    )


def _first_close(steps: Column) -> Column:
    """Closing position for a text that starts with an opening brace."""

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x["mark"] == "{", 1).when(x["mark"] == "}", -1).otherwise(0)
        closes = s["close"].isNull() & (x["mark"] == "}") & (s["depth"] == 1)
        return F.struct(
            (s["at"] + x["len"]).alias("at"),
            depth.alias("depth"),
            F.when(closes, s["at"] + x["len"] - 1).otherwise(s["close"]).alias("close"),
        )

    zero = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("close")
    )
    return F.aggregate(steps, zero, step, lambda s: s["close"])


def bodies_in_literals(heads: Column, steps_per_head: Column) -> Column:
    bodies = F.zip_with(
        heads, steps_per_head, lambda head, steps: _body(head, head["open"] + _first_close(steps))
    )
    return F.filter(bodies, lambda body: body["close"].isNotNull())


STATEMENT = (
    "struct<ord:int,piece:string,before:int,depth:int,parens:int,access:string,statement:string>"
)


def statement_pieces(stripped: Column, bodies: Column) -> Column:
    """Per type body, its text cut after every one of ``(){};``."""

    def cut(text: Column, body: Column) -> Column:
        inside = F.substring(text, body["open"] + 2, body["close"] - body["open"] - 1)
        pieces = F.transform(
            F.regexp_extract_all(inside, F.lit(UP_TO_BREAK), F.lit(0)),
            lambda piece, i: F.struct(
                i.alias("ord"), piece.alias("piece"), F.right(piece, F.lit(1)).alias("end")
            ),
        )
        return F.filter(pieces, lambda p: p["end"].isin("(", ")", "{", "}", ";"))

    return let(stripped, lambda text: F.transform(bodies, lambda body: cut(text, body)))


def statement_trace(pieces: Column, access: Column) -> Column:
    """One entry per ``(){};`` in a type body.

    ``depth`` and ``parens`` count open braces and parentheses, never below 0;
    ``access`` is the level carried forward so far; ``statement`` is set where a
    statement ends.
    """

    def depth(s: Column, x: Column) -> Column:
        return (
            F.when(x["end"] == "{", s["depth"] + 1)
            .when(x["end"] == "}", F.greatest(s["depth"] - 1, F.lit(0)))
            .otherwise(s["depth"])
        )

    def parens(s: Column, x: Column) -> Column:
        return (
            F.when(x["end"] == "(", s["parens"] + 1)
            .when(x["end"] == ")", F.greatest(s["parens"] - 1, F.lit(0)))
            .otherwise(s["parens"])
        )

    def starts(s: Column) -> Column:
        return (s["depth"] == 0) & (s["text"] == "")

    def level(s: Column, x: Column) -> Column:
        label = F.regexp_extract(x["piece"], ACCESS_LABELS, 1)
        return F.when(starts(s) & (label != ""), label).otherwise(s["access"])

    def text(s: Column, x: Column) -> Column:
        return F.when(starts(s), F.regexp_replace(x["piece"], ACCESS_LABELS, "")).otherwise(
            F.concat(s["text"], x["piece"])
        )

    def step(s: Column, x: Column) -> Column:
        goes_on = (s["depth"] == 0) & x["end"].isin("(", ")")
        return F.struct(
            depth(s, x).alias("depth"),
            parens(s, x).alias("parens"),
            level(s, x).alias("access"),
            F.when(goes_on, text(s, x)).otherwise(F.lit("")).alias("text"),
        )

    def emit(s: Column, x: Column) -> Column:
        ends = (s["depth"] == 0) & (
            (x["end"] == ";") | ((x["end"] == "{") & (s["parens"] == 0))
        )
        return F.struct(
            x["ord"].alias("ord"),
            x["piece"].alias("piece"),
            s["depth"].alias("before"),
            depth(s, x).alias("depth"),
            parens(s, x).alias("parens"),
            level(s, x).alias("access"),
            F.when(ends, trim_ws(text(s, x))).alias("statement"),
        )

    zero = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("parens"), access.alias("access"), F.lit("").alias("text")
    )
    return running(pieces, zero, step, emit, STATEMENT)


def public_statements(trace: Column) -> Column:
    ended = F.filter(
        trace,
        lambda s: (s["access"] == "public") & s["statement"].isNotNull() & (s["statement"] != ""),
    )
    return F.transform(ended, lambda s: s["statement"])


def is_filtered_statement(statement: Column) -> Column:
    return F.rlike(statement, F.lit(NOT_A_METHOD_START))


def looks_like_method(statement: Column) -> Column:
    return (
        ~F.contains(statement, F.lit("(*"))
        & ~F.contains(statement, F.lit("(&"))
        & F.rlike(statement, F.lit(METHOD_NAME))
        & F.rlike(statement, F.lit(METHOD_END))
    )


def public_methods(trace: Column) -> Column:
    return F.filter(
        public_statements(trace), lambda s: ~is_filtered_statement(s) & looks_like_method(s)
    )


def default_access(keyword: Column) -> Column:
    return F.when(keyword == "struct", F.lit("public")).otherwise(F.lit("private"))


def statement_traces(bodies: Column, pieces: Column) -> Column:
    return F.zip_with(
        bodies, pieces, lambda body, own: statement_trace(own, default_access(body["keyword"]))
    )


def collect_classes(bodies: Column, traces: Column) -> Column:
    """``array<struct<name,public_methods>>`` in text order, nested types included."""
    return F.zip_with(
        bodies,
        traces,
        lambda body, trace: F.struct(
            body["name"].alias("name"), public_methods(trace).alias("public_methods")
        ),
    )
