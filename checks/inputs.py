"""Inputs of the registered queries, derived from the given tables.

The tables hold no source code and no reviews, so both are written out of their
rows by plain string expressions. The same expression text runs in Spark and in
the checking SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from corpuslens.sources.files import spread

# One source text per case; @ stands for the row's own type name.
TEMPLATES = [
    "#include <vector>\n#include \"p.hpp\"\n#include <vector>\nclass @ {\npublic:\n  void run();\nprivate:\n  int x_;\n};\n",
    "// #include <no>\n/* #include <no2>\n*/ #include <yes>\nstruct @ { int a(); };\n",
    "const char* s = \"// not a comment\";\nconst char* r = R\"x(/* class Z { */)x\";\nclass @ {};\n",
    "enum class E { A };\nstruct @ : Base {\n  virtual ~@() = default;\n  static int n;\n};\n",
    "template <class Q>\nvoid f(Q q) {}\nstruct @ { Q g(int a = 0) const; };\n",
    "class @ {\npublic:\n  struct In { void i(); };\n  void o() { if (x) { y(); } }\n  @& operator*();\n};\n",
    "int* p = new int(1);\nvoid* q = malloc(4);\n",
    "int* p = new int(1); delete p;\nwhile(true) {}\n",
    "// a new thing\nstruct @;\n",
    "#include <a>\r\n#include <b>\r\n",
    "struct @ {\n  void a(X x = {});\n  @() : b_(1) {}\n  void c() noexcept;\n private:\n  void d();\n};\n",
    "",
    "class @ {\n  void x();\n",
]


def quoted(text: str, name: str) -> str:
    """A text as a concatenation that reads the same in both engines."""
    parts = []
    for piece in re.split("([\n\r@])", text):
        if piece in ("\n", "\r"):
            parts.append(f"chr({ord(piece)})")
        elif piece == "@":
            parts.append(name)
        elif piece:
            parts.append("'" + piece + "'")
    return " || ".join(parts) or "''"


def code_files_select(table: str, key: str, tag: str, lead: str) -> str:
    name = f"'P' || cast({key} as string)"
    cases = " ".join(f"when {v} then {quoted(t, name)}" for v, t in enumerate(TEMPLATES))
    return f"""
      select project, project || '/' || dir || '/{tag}' || cast(k as string) || ext as path, k, content
      from (
        select k, content,
          case when k % 3 = 0 then 'mono' else 'proj' || cast(cast((k - k % 60) / 60 as bigint) as string) end as project,
          case k % 6 when 0 then 'src' when 1 then 'include/x' when 2 then 'build/gen'
            when 3 then 'venv/lib' when 4 then 'src/.git/h' else 'src-b' end as dir,
          case k % 5 when 0 then '.cpp' when 1 then '.hpp' when 2 then '.h'
            when 3 then '.HPP' else '.txt' end as ext
        from (select {key} as k, {lead} (case {key} % 13 {cases} end) as content from {table}) a
      ) b"""


# A part is a short file, a document is a file under a long comment, and a page
# is a file behind a long raw literal full of quotes and braces.
CODE_FILES = " union all ".join(
    [
        code_files_select("part", "p_partkey", "p", ""),
        code_files_select("documents", "doc_id", "d", "'/* ' || text || ' */' || chr(10) ||"),
        code_files_select(
            "pages", "page_id", "w", "'const char* page = R\"html(' || html || ')html\";' || chr(10) ||"
        ),
    ]
)

FENCE = "chr(96) || chr(96) || chr(96)"

REVIEW_TEXT = f"""case doc_id % 10
  when 0 then '[SUMMARY]' || chr(10) || text || chr(10) || chr(10) || '[ISSUES]' || chr(10) || 'None'
    || chr(10) || chr(10) || '[SUGGESTIONS]' || chr(10)
  when 1 then '**[SUMMARY]**:' || chr(10) || text || chr(10) || '## [ISSUES]' || chr(10) || '- Leak in f'
    || chr(10) || '[SUGGESTIONS]' || chr(10) || 'Use RAII'
  when 2 then '[SUMMARY]' || chr(10) || text || chr(10) || '[ISSUES]' || chr(10) || '1. **None**' || chr(10)
  when 3 then '[ISSUES]' || chr(13) || chr(10) || '- No major issues.' || chr(13) || chr(10)
    || '[SUGGESTIONS]' || chr(13) || chr(10) || 'None'
  when 4 then '[SUMMARY]' || chr(10) || text || chr(10) || {FENCE} || chr(10) || '[ISSUES]' || chr(10)
    || 'fake' || chr(10) || {FENCE} || chr(10) || '[ISSUES]' || chr(10) || 'none'
  when 5 then '[ERROR]' || chr(10) || 'AI analysis unavailable.'
  when 6 then '[SKIPPED]' || chr(10) || 'wait'
  when 7 then '[SUMMARY]' || chr(10) || text || chr(10) || '[ISSUES]' || chr(10) || 'no issues'
  when 8 then '[ERROR]' || chr(10) || 'x'
  else text end"""

REVIEW_RESULTS = f"""
  select source as project, source || '/' || lang || '/' || cast(doc_id as string) || '.cpp' as path,
    doc_id,
    case doc_id % 10 when 5 then 'error' when 6 then 'skipped' when 7 then 'cached'
      when 8 then cast(null as string) else 'generated' end as raw_status,
    {REVIEW_TEXT} as ai_analysis,
    case when doc_id % 17 = 0 then 'rule x' else '' end as rule_text
  from documents"""

# Files of the incremental run: odd ones end in CR LF.
FILE_TEXT = "text || case when doc_id % 2 = 1 then chr(13) else '' end || chr(10)"
FILE_PATH = "source || '/' || lang || '/' || cast(doc_id as string) || '.cpp'"

MANIFEST = f"select source as project, {FILE_PATH} as path, doc_id as pos from documents"

RUN_FILES = f"""
  select source as project, {FILE_PATH} as path, {FILE_TEXT} as text, doc_id as mtime
  from documents where doc_id % 31 <> 0"""


def previous_select(digest: str) -> str:
    """Earlier results; every eighth document has none, the last kind has two."""
    status = "case doc_id % 8 when 3 then 'error' when 4 then 'skipped' when 5 then 'cached' else 'generated' end"
    first = f"""
      select source as project, {FILE_PATH} as path, {status} as ai_status,
        case when doc_id % 8 = 6 then '[ERROR]' || chr(10) || 'old' else 'old ' || cast(doc_id as string) end as ai_analysis,
        case doc_id % 8 when 2 then 'other' when 5 then cast(null as string) else {digest} end as file_hash,
        doc_id * 2 as pos
      from documents where doc_id % 8 <> 0"""
    second = f"""
      select source, {FILE_PATH}, 'generated', 'newer', 'other', doc_id * 2 + 1
      from documents where doc_id % 8 = 7"""
    return first + " union all " + second


NORMAL_TEXT = f"replace(replace({FILE_TEXT}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"

ERROR_LOG = """
  select event_id as id, case event_id % 8 when 0 then 'HTTP 429' when 1 then '500 Internal'
    when 2 then 'RESOURCE_EXHAUSTED' when 3 then 'took 5003 ms' when 4 then 'Connection reset by peer'
    when 5 then 'invalid argument' when 6 then 'permission denied' else 'Model is in High Demand' end as message
  from events"""


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The expression text over the given tables, without registering views."""
    return spark.sql(
        re.sub(r"from (part|documents|pages|events)\b", rf"from parquet.`{sf_dir}/\1.parquet`", sql)
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``project, path, k, text, relative_path, parse_error``."""
    rows = run_sql(
        spark,
        sf_dir,
        "select project, path, k, content as text, substring(path, length(project) + 2) as relative_path, "
        f"'' as parse_error from ({CODE_FILES}) f",
    )
    return spread(rows)


def review_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(
        spark,
        sf_dir,
        "select project, path, doc_id, ai_analysis, raw_status as ai_status, "
        "filter(array(rule_text), x -> x <> '') as rule_based_issues "
        f"from ({REVIEW_RESULTS}) r",
    )
    return spread(rows)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, MANIFEST)


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, RUN_FILES)


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, previous_select(f"sha2({NORMAL_TEXT}, 256)"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(
        spark,
        sf_dir,
        "select event_type as key, event_id as id, unix_micros(cast(ts as timestamp)) as t from events",
    )


# Some keys and times are null, and two rows share each id.
ODD_REQUESTS = """select case when event_id % 5 = 0 then null else event_type end as key, event_id - event_id % 2 as id,
  case when event_id % 97 = 0 then null else ts end as ts from events"""
ODD_RUNS = ODD_REQUESTS.replace("event_type", "user_id")


def odd_log(spark: SparkSession, sf_dir: str, rows: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"select key, id, unix_micros(cast(ts as timestamp)) as t from ({rows}) r")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(
        spark,
        sf_dir,
        "select user_id as key, event_id as id, unix_micros(cast(ts as timestamp)) as t from events",
    )


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, ERROR_LOG)


JSON_TEXT = (
    "'\"' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), "
    "chr(10), chr(92) || 'n') || '\"'"
)

JSON_PATH = f"'\"' || {FILE_PATH} || '\"'"

# One report document per row: whole ones, ones with parts left out, broken ones.
REPORTS = f"""
  select doc_id, case doc_id % 12
    when 0 then '{{"model":"m1","results":[{{"path":' || {JSON_PATH} || ',"ai_status":"generated","ai_analysis":'
      || {JSON_TEXT} || ',"rule_based_issues":["a","b"],"file_hash":"h"}}]}}'
    when 1 then '{{"results":[{{}}]}}'
    when 2 then '{{"model":null,"results":[{{"path":null,"ai_status":null,"ai_analysis":"[ERROR] x","rule_based_issues":null}}]}}'
    when 3 then '{{"x":{{"y":[1,true,null]}},"results":[{{"ai_status":"","extra":1.5e3,"ai_analysis":' || {JSON_TEXT} || '}}]}}'
    when 4 then '{{"model":"m"}}'
    when 5 then '{{"results":[{{"path":' || {JSON_PATH}
    when 6 then '{{"results":[]}} trailing'
    when 7 then '{{"results":[{{"path":1}}]}}'
    when 8 then '{{"results":{{}}}}'
    when 9 then '{{"results":[{{"rule_based_issues":["a",1]}}]}}'
    when 10 then '{{"results":[]}}'
    else '{{"results":[{{"path":' || {JSON_PATH} || '}},7,{{"path":5}},{{"path":' || {JSON_PATH}
      || ',"ai_status":"cached","ai_analysis":' || {JSON_TEXT} || '}}]}}' end as document
  from documents"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, REPORTS)
