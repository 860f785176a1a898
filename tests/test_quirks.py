"""One case per rule that is easy to get wrong."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import limits as L
from corpuslens.functions import paths as P
from corpuslens.functions import review_text as R
from corpuslens.functions import text as T
from corpuslens.operators import incremental as C
from corpuslens.operators import parse
from corpuslens.operators.order import sort_paths
from corpuslens.operators.report import graded
from corpuslens.sources import documents as D
from corpuslens.sources.files import read_text


def one(spark, expression, **values):
    """The value of a column expression over one row of text values."""
    names = list(values) or ["x"]
    row = spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{n} string" for n in names))
    return row.select(expression.alias("v")).first().v


def structure(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {
        r.i: (r.headers, [(c.name, c.public_methods) for c in r.classes])
        for r in parse.with_structure(rows).collect()
    }


def test_paths_sort_by_part(spark):
    rows = spark.createDataFrame([("a-b.cpp",), ("a/b.cpp",), ("a/b/c.cpp",)], "path string")
    assert [r.path for r in sort_paths(rows).collect()] == ["a/b/c.cpp", "a/b.cpp", "a-b.cpp"]


@pytest.mark.parametrize(
    ("path", "source"),
    [("a.cpp", True), ("a.HPP", False), (".cpp", False), ("d.h/x", False), ("x.tar.cc", True), ("a.", False)],
)
def test_extension_is_exact(spark, path, source):
    assert one(spark, P.is_source_file(F.col("p")), p=path) is source


@pytest.mark.parametrize(
    ("path", "skipped"),
    [("build/a.c", True), ("x/.git/y/a.c", True), ("builds/a.c", False), ("build", False), ("a.c", False)],
)
def test_skipped_directories(spark, path, skipped):
    assert one(spark, P.in_skipped_directory(F.col("p")), p=path) is skipped


def test_hash_reads_all_line_ends_alike(spark):
    want = hashlib.sha256(b"a\nb\nc\n").hexdigest()
    assert one(spark, T.content_hash(F.col("t")), t="a\r\nb\rc\n") == want


def test_bytes_that_are_no_text_become_a_row_error(spark):
    rows = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"a\xff"),), (None,)], "content binary")
    got = [(r.text, r.parse_error != "") for r in read_text(rows).collect()]
    assert got == [("ok", False), ("a\xff", True), (None, True)]


def test_rules_see_comments_and_parts_of_words(spark):
    assert one(spark, T.rule_checks(F.col("t")), t="// renew it") == [T.NEW_WITHOUT_DELETE]
    assert one(spark, T.rule_checks(F.col("t")), t="new X; f() = delete;") == []
    assert one(spark, T.rule_checks(F.col("t")), t="for(;;) malloc") == [T.MALLOC_WITHOUT_FREE, T.INFINITE_LOOP]


def test_structure_cases(spark):
    got = structure(
        spark,
        "// a \\\nclass A {};",
        "int x = 1'000; // class B {\n'; class C {};",
        'const char* s = "class D { };";',
        "#include <>\n # include \"x y\" \n#include MACRO",
        "template <class T> void f() {\n}\nstruct A f() { }\nclass MACRO Foo { };",
        "class A { class B { struct C {}; }; };",
        "myenum class X { };\nenum\n class Y { };",
        "struct T { void a(X x = {}); void b(); };",
        "struct T { T operator*(); T& operator&(); static int x = f(); T() : a_(1) { } T(int) : b_{2} { } };",
        "class T { public slots: void f(); public: void g(); protected : void h(); };",
        "struct T { char c = '}'; void lost(); };",
    )
    assert got[0] == ([], [("A", [])])
    assert got[1][1] == [("C", [])]
    assert got[2][1] == [("D", [])]
    assert got[3][0] == ["", "x y"]
    assert [n for n, _ in got[4][1]] == ["T", "A", "MACRO"]
    assert [n for n, _ in got[5][1]] == ["A", "B", "C"]
    assert got[6][1] == []
    assert got[7][1] == [("T", ["void b();"])]
    assert got[8][1] == [("T", ["static int x = f();", "T() : a_(1) {"])]
    assert got[9][1] == [("T", ["void g();"])]


def test_reuse_rules(spark):
    rows = spark.createDataFrame(
        [
            ("same", True, "cached", "t", "h", "h", 9, 1, True),
            ("other hash", True, "generated", "t", "x", "h", 1, 9, False),
            ("empty hash counts as stored", True, "generated", "t", "", "h", 1, 9, False),
            ("no hash, old file", True, "generated", "t", None, "h", 5, 5, True),
            ("no hash, new file", True, "generated", "t", None, "h", 6, 5, False),
            ("no hash, no report time", True, "generated", "t", None, "h", 1, None, False),
            ("error", True, "error", "t", "h", "h", 1, 9, False),
            ("skipped", True, "skipped", "t", "h", "h", 1, 9, False),
            ("error text", True, "generated", "[ERROR] t", "h", "h", 1, 9, False),
            ("null text", True, "generated", None, "h", "h", 1, 9, True),
            ("nothing earlier", None, None, None, None, "h", 1, 9, False),
        ],
        "name string, found boolean, status string, analysis string, old string, new string, "
        "mtime int, report int, want boolean",
    )
    reuse = C.can_reuse(*[F.col(c) for c in ("found", "status", "analysis", "old", "new", "mtime", "report")])
    assert [r.name for r in rows.withColumn("got", reuse).collect() if r.got != r.want] == []


def test_last_entry_wins_and_odd_entries_are_dropped(spark):
    document = '{"results":[{"path":"a","ai_status":"x"},3,{"path":7},{"path":"a","ai_status":null,"file_hash":""}]}'
    rows = spark.createDataFrame([(1, document), (2, "{"), (3, '{"results":{}}')], "n int, document string")
    got = D.load_prev_report(rows).collect()
    assert [(r.n, r.path, r.ai_status, r.file_hash) for r in got] == [(1, "a", None, "")]


@pytest.mark.parametrize(
    ("document", "good"),
    [
        ('{"results":[]}', True),
        (' {"results":[], "x":[1,{"y":null}]} \n', True),
        ('{"results":[]} x', False),
        ('{"results":[]},{"results":[]}', False),
        ('{"results":[]', False),
        ('{"results":null}', False),
        ('{"results":[1]}', False),
        ('{"results":[{"path":2}]}', False),
        ('{"results":[{"rule_based_issues":["a",null]}]}', False),
        ('{"results":[{"rule_based_issues":null,"path":null}],"model":null}', True),
        ('{"model":1,"results":[]}', False),
        ('{"results":[{"ai_analysis":"a\nb"}]}', False),
        ("[]", False),
        ("", False),
        (None, False),
    ],
)
def test_report_format(spark, document, good):
    rows = spark.createDataFrame([(document,)], "document string")
    assert (D.check_report(rows).first().report_error == "") is good


def test_status_defaults(spark):
    guess = R.default_status(F.col("s"), F.col("a"))
    assert one(spark, guess, s=None, a="[ERROR] x") == "error"
    assert one(spark, guess, s=None, a="x") == "generated"
    assert one(spark, guess, s="", a="[ERROR] x") == ""


def test_cooldown_text_rounds_half_to_even(spark):
    for seconds, shown in ((34.5, 34), (35.5, 36), (0.2, 1), (0.5, 1), (119.9, 120)):
        assert f"about {shown} seconds" in one(spark, L.cooldown_message(F.lit(seconds)))


def test_retry_markers_are_substrings(spark):
    assert one(spark, L.is_retryable_error(F.col("m")), m="took 5003 ms") is True
    assert one(spark, L.is_retryable_error(F.col("m")), m="Connection RESET by peer") is True
    assert one(spark, L.is_retryable_error(F.col("m")), m="permission denied") is False


def test_backoff_caps_all_but_the_first(spark):
    sleeps = lambda *v: one(spark, L.backoff_schedule(F.lit(v[0]), *[F.lit(float(x)) for x in v[1:]]))
    assert sleeps(3, 2, 2, 15) == [2.0, 4.0]
    assert sleeps(6, 2, 2, 15) == [2.0, 4.0, 8.0, 15.0, 15.0]
    assert sleeps(1, 2, 2, 15) == [] and sleeps(0, 2, 2, 15) == []
    assert sleeps(4, 20, 2, 15) == [20.0, 15.0, 15.0]
    assert sleeps(4, 2, 0.5, 15) == [2.0, 2.0, 2.0]
    assert sleeps(3, 0, 2, 15) == [0.0, 0.0] and sleeps(3, -1, 2, 15) == [0.0, 0.0]


VERDICTS = [
    ("[SUMMARY]\nok\n[ISSUES]\nNone\n[SUGGESTIONS]\n", "GOOD"),
    ("[ISSUES]\nnone\n[SUGGESTIONS]\nNone", "IMPROVE"),
    ("[ISSUES]\n1. **None**\n", "PROBLEM"),
    ("[ISSUES]\n- No Major Issues.\n2) none;\n", "GOOD"),
    ("no sections at all", "GOOD"),
    ("", "GOOD"),
    ("> **[ISSUES]**:\n* leak", "PROBLEM"),
    ("[ISSUES] leak here\nx", "GOOD"),
    ("[issues]\nleak", "GOOD"),
    ("```\n[ISSUES]\nfake\n```\n", "GOOD"),
    ("[ISSUES]\nnone\n```\n[SUGGESTIONS]\nin a fence\n```", "PROBLEM"),
    ("[SUGGESTIONS]\n \r\n[ISSUES]\nnone", "GOOD"),
    ("[ERROR] broken", "PROBLEM"),
    ("[SKIPPED] later", "IMPROVE"),
    ("[SUGGESTIONS]", "GOOD"),
    ("[ISSUES]\nnone\n[ISSUES]\nleak", "GOOD"),
]


def test_verdicts(spark):
    rows = spark.createDataFrame(
        [(i, t) for i, (t, _) in enumerate(VERDICTS)], "i int, ai_analysis string"
    ).select("i", "ai_analysis", F.lit("generated").alias("ai_status"), F.array().cast("array<string>").alias("rule_based_issues"))
    got = {r.i: r.verdict for r in graded(rows).collect()}
    assert [(VERDICTS[i], v) for i, v in got.items() if VERDICTS[i][1] != v] == []
