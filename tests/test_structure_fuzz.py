"""Random texts through the Spark expressions and through plain Python."""

import random

from pyspark.sql import functions as F

from corpuslens.functions import structure as S
from corpuslens.operators import parse
from tests import brute

PIECES = [
    "class A {", "struct B {", "enum class C {", "myenum class D {", "template <class T> ", "{", "}",
    "};", ";", "(", ")", '"', "'", "\\", "\n", " ", "R\"x(", ')x"', 'R"(', ')"', "//", "/*", "*/",
    "public:", "private :", "protected\n:", "public::x", "void f()", "int g(int a) const;",
    "operator*();", "~A() = default;", "#include <v>", '# include "w.h"', "#include <>", "\r\n",
    "if (x)", "class X;", "= {}", ": a_(1)", "[[nodiscard]] ", "class M N {", "using T = int;",
    "friend ", "return f();", "é", "R", "/", "static int x = f();", ") const b(", "x(*p)(int);",
    "\"class S { int s(); }\"", "'{'", "struct\tQ", " final : Z {", "\\\n", "else f();",
    "auto h() -> int {", "void k() noexcept;", "public slots:",
]


def texts(count, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(count)]


def test_parsing_equals_plain_python(spark):
    rows = texts(20000, 7)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")
    got = parse.with_traces(parse.with_stripped(df.repartition(8))).collect()
    wrong = []
    for row in got:
        stripped = brute.strip_comments(rows[row.i])
        want = (
            stripped,
            [(k, n, o, c) for k, n, o, c in brute.types(stripped)],
        )
        have = (
            row.stripped,
            [(b.keyword, b.name, b.open, b.close) for b in row.bodies],
        )
        if want != have:
            wrong.append((rows[row.i], want, have))
    assert not wrong, (len(wrong), wrong[:3])


# What a statement may begin with that is never a method.
WORD_STARTS = ["using", "typedef", "friend", "enum", "class", "struct", "if", "for", "while", "switch", "return", "catch"]
OTHER_STARTS = ["if(", "for(", "while(", "switch(", "static_assert", "else", "#"]
# Words before a parenthesis that name no method.
CONTROL_WORDS = ["if", "for", "while", "switch", "catch", "return", "sizeof", "alignof", "decltype", "requires"]
# What may follow a method's last parenthesis, whole or as a beginning.
WHOLE_TAILS = ["", ";", "{", "= default;", "= delete;", "= 0;"]
TAIL_STARTS = ["const", "noexcept", "override", "final", "requires", "->", "&"]


def test_statement_predicates(spark):
    """Statements put together out of parts, so that the answer is known from the parts."""
    filtered = [(f"{w} x;", True) for w in WORD_STARTS] + [(f"{w}x", True) for w in OTHER_STARTS]
    filtered += [(f"{w}x;", False) for w in WORD_STARTS] + [(f"my{w}x", False) for w in OTHER_STARTS]
    method = [(f"int {n}(int a){gap}{t}", True) for n in ("f", "_g", "~H", "A::k") for t in WHOLE_TAILS for gap in ("", " ", "\n")]
    method += [(f"T* f(){t} x;", True) for t in TAIL_STARTS] + [(f"{w} (x);", False) for w in CONTROL_WORDS]
    method += [(f"int f() {t}", False) for t in ("= 1;", "x", "= default", ": a_", ",")]
    method += [(s, False) for s in ("int x;", "int f(", "int f)", ")(", "int (*p)(int);", "int (&r)(int);", "int 1f();", "(x);")]
    df = spark.createDataFrame(
        [(s, want, "filtered") for s, want in filtered] + [(s, want, "method") for s, want in method], "s string, want boolean, kind string"
    )
    have = F.when(F.col("kind") == "filtered", S.is_filtered_statement(F.col("s"))).otherwise(S.looks_like_method(F.col("s")))
    assert df.where(~have.eqNullSafe(F.col("want"))).collect() == []


# Lines, and the name that each includes (None: none).
INCLUDES = [
    ("#include <v>", "v"), ('# include "w.h"', "w.h"), ("\t#\tinclude <a/b.hpp> // why", "a/b.hpp"), ("#include<x>", "x"),
    ('   #include "y z"  ', "y z"), ("#include <>", ""), ("/* before */ #include <after>", "after"), ("#include \"it's\"", "it's"),
    ('const char* r = R"x(\n#include <raw>\n)x";', "raw"),
    ('#include "open', None), ("#include name", None), ("int x; #include <no>", None), ("// #include <no>", None),
    ("/* #include <no>\n#include <no2> */", None), ("#define include <no>", None), ("#includes <no>", None),
    ('const char* s = "#include <no>";', None), ("", None), ("#", None), ("int a;", None),
]


def test_files_of_known_includes(spark):
    """Files are written out of lines, so that the names that must be found are known, each once and in order."""
    rng, files = random.Random(12), []
    for number in range(3000):
        lines = [rng.choice(INCLUDES) for _ in range(rng.randint(0, 12))]
        # An unfinished literal reaches into what follows, so it only ever ends a file.
        lines = [x for x in lines if x[0] != '#include "open'] + [x for x in lines if x[0] == '#include "open'][:1]
        text = rng.choice(["\n", "\r\n"]).join(line for line, _ in lines)
        files.append((number, text, list(dict.fromkeys(name for _, name in lines if name is not None))))
    df = spark.createDataFrame([f[:2] for f in files], "i int, text string").repartition(8)
    got = {r.i: r.headers for r in parse.with_headers(parse.with_stripped(df)).select("i", "headers").collect()}
    wrong = [(text, want, got[i]) for i, text, want in files if got[i] != want]
    assert not wrong, (len(wrong), wrong[:2])


# Member text, and the statement that is found for it in a public section (None: none).
MEMBERS = [
    ("void m#();", "void m#();"),
    ("int m#(int a, char b) const;", "int m#(int a, char b) const;"),
    ("virtual ~D#() = default;", "virtual ~D#() = default;"),
    ("auto m#() -> int;", "auto m#() -> int;"),
    ("void m#() noexcept;", "void m#() noexcept;"),
    ("void m#() { if (x) { y(); } }", "void m#() {"),
    ("bool m#() { return f(1); }", "bool m#() {"),
    ("static int n#;", None),
    ("int n# = 3;", None),
    ("using U# = int;", None),
    ("friend void g#();", None),
    ("int (*p#)(int);", None),
    ("void a#(X x = {});", None),
]


def test_files_of_known_types(spark):
    """Files are written out of types and members, so that what must be found is known."""
    rng, files = random.Random(11), []
    for number in range(3000):
        text, want = "", []
        for k in range(rng.randint(0, 4)):
            keyword = rng.choice(["class", "struct"])
            access, methods, body = "public" if keyword == "struct" else "private", [], ""
            for j in range(rng.randint(0, 7)):
                if rng.random() < 0.3:
                    access = rng.choice(["public", "private", "protected"])
                    body += f" {access}:" + rng.choice(["\n", " "])
                member, found = rng.choice(MEMBERS)
                body += "  " + member.replace("#", f"{k}_{j}") + rng.choice(["\n", "\n\n", " "])
                if found and access == "public":
                    methods.append(found.replace("#", f"{k}_{j}"))
            want.append((f"T{k}", methods))
            text += rng.choice(["", "// class No {\n", "/* struct No { void n(); }; */\n", "#include <v>\n", "enum class E { A };\n"])
            text += f"{keyword} T{k} {{\n{body}}};\n"
        files.append((number, text, want))
    df = spark.createDataFrame([f[:2] for f in files], "i int, text string").repartition(8)
    got = {r.i: [(c.name, c.public_methods) for c in r.classes] for r in parse.with_structure(df).select("i", "classes").collect()}
    wrong = [(text, want, got[i]) for i, text, want in files if got[i] != want]
    assert not wrong, (len(wrong), wrong[:2])


def test_long_literals_and_many_braces(spark):
    long_text = 'const char* s = "' + "a\\\"" * 200_000 + '";\nstruct T {\n' + "void f() { if (x) { y(); } }\n" * 20_000 + "};\n"
    many = "".join(f"struct S{i} {{ void m{i}(); }};\n" for i in range(1000))
    df = spark.createDataFrame([(0, long_text), (1, many)], "i int, text string")
    got = {
        r.i: r.classes
        for r in parse.with_structure(df).select("i", "classes").collect()
    }
    assert [c.name for c in got[0]] == ["T"] and len(got[0][0].public_methods) == 20_000
    assert [(c.name, c.public_methods) for c in got[1]] == [(f"S{i}", [f"void m{i}();"]) for i in range(1000)]


def test_many_types_and_many_heads_in_literals(spark):
    """Thousands in one file: bodies are found in one ordered pass, and heads in literals share their scans."""
    types = "".join(f"struct T{i} {{ int a{i}(); }};\n" for i in range(3000))
    heads = 'const char* s = "' + "".join(f"class H{i} {{ public: int a{i}(); }}; " for i in range(3000)) + '";\n'
    # A quote inside a literal's type hides later heads from the shared scan.
    mixed = "".join(f"const char* s{i} = \"struct L{i} {{ '; }} x\"; struct B{i} {{ void b(); }};\n" for i in range(20))
    rows = spark.createDataFrame([(1, types), (2, heads), (3, mixed), (4, "struct A { struct B { int b(); }; ")], "id int, text string")
    got = {r.id: r.classes for r in parse.with_structure(rows).select("id", "classes").collect()}
    assert [c.name for c in got[1]] == [f"T{i}" for i in range(3000)] and got[1][7].public_methods == ["int a7();"]
    assert [c.name for c in got[2]] == [f"H{i}" for i in range(3000)] and got[2][9].public_methods == ["int a9();"]
    assert {f"B{i}" for i in range(20)} <= {c.name for c in got[3]}
    assert [c.name for c in got[4]] == ["B"]
