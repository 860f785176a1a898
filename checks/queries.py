"""One query per operator, each with the SQL that must give the same rows."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as Q
from checks.clock import CountingClock
from corpuslens.functions import limits as L
from corpuslens.functions import paths as P
from corpuslens.functions import review_text as R
from corpuslens.functions import structure as S
from corpuslens.functions import text as T
from corpuslens.functions.arrays import pinned
from corpuslens.operators import admission as A
from corpuslens.operators import analysis as N
from corpuslens.operators import incremental as C
from corpuslens.operators import parse
from corpuslens.operators import report as G
from corpuslens.operators import review as V
from corpuslens.operators.order import with_positions
from corpuslens.operators.storage import materialised, shared_folder
from corpuslens.plans import batch as B
from corpuslens.schemas import ANALYSIS_DOCUMENT, RUN_STATE
from corpuslens.sources import documents as D
from corpuslens.sources import files as FS
from corpuslens.sources import latest as LT
from corpuslens.sources import sinks as K
from corpuslens.sources.tree import SourceTree
from corpuslens.streaming import incremental as SI
from corpuslens.streaming import gates as SG

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEYS = ["project", "path"]
HOUR_US = 3_600_000_000
DAY_US = 86_400_000_000


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            SQL[key] = sql
        return function

    return register


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def joined(column: str | Column, by: str = " | ") -> Column:
    return F.array_join(column, by)


def big(column: Column) -> Column:
    return column.cast("bigint")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.code_files(spark, sf_dir)


def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.with_stripped(source_files(spark, sf_dir)).select(*KEYS, "stripped")


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.analyze(source_files(spark, sf_dir))


# --- sources -----------------------------------------------------------------

SOURCE_FILTER = """regexp_matches(rel, '[^/]\\.(h|hh|hpp|hxx|c|cc|cpp|cxx)$') and not list_has_any(
  string_split(rel, '/')[1:-2], ['.git', '.idea', '.vscode', 'build', 'cmake-build-debug',
  'cmake-build-release', 'venv', '__pycache__'])"""


def written(files: DataFrame, root: str) -> DataFrame:
    """Writes the files as a source tree, each task its own rows, and hands the rows on without their text."""
    rest = files.drop("text")
    names = rest.columns

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = FS.open_store(root)
        made = set()
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                target = f"{top}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(target) as out:
                    out.write(text.encode())
            yield batch[names]

    return files.mapInPandas(write, rest.schema)


def write_tree(files: DataFrame, root: str) -> None:
    written(files.select("path", "text"), root).write.format("noop").mode("overwrite").save()


@query(f"with {Q.FILES} select path, cast(strlen(content) as bigint) as length, sha256(content) as digest from files where {SOURCE_FILTER}")
def scan_code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "tree")
    write_tree(source_files(spark, sf_dir), root)
    found = FS.scan_code_files(spark, root)
    return found.select(
        F.col("relative_path").alias("path"), "length", F.sha2("content", 256).alias("digest")
    )


@query(f"with {Q.FILES} select path, cast(strlen(content) as bigint) as length, sha256(content) as digest from files where {SOURCE_FILTER}")
def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree through the data source."""
    root = scratch(spark, "tree")
    write_tree(source_files(spark, sf_dir), root)
    spark.dataSource.register(SourceTree)
    found = spark.read.format("source_tree").load(root)
    return found.select(F.col("relative_path").alias("path"), "length", F.sha2("content", 256).alias("digest"))


@query(f"""with {Q.FILES} select path, sha256(content) as digest from files
  where path in (select min(path) from files where {SOURCE_FILTER})""")
def scan_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source file and the first other one, each as a root of its own."""
    root = scratch(spark, "tree")
    # The texts are kept once, in the tree; what is kept beside it are names.
    files = materialised(written(source_files(spark, sf_dir).select("path", "text", "relative_path"), root))
    good = FS.filter_source_rows(files, F.col("relative_path")).agg(F.min("path")).first()[0]
    other = files.filter(~P.is_source_file(F.col("path"))).agg(F.min("path")).first()[0]
    found = FS.scan_single_file(spark, f"{root}/{good}").unionByName(
        FS.scan_single_file(spark, f"{root}/{other}")
    )
    top = FS.open_store(root)[1]
    return found.select(
        F.expr(f"substring(path, {len(top) + 2})").alias("path"), F.sha2("content", 256).alias("digest")
    )


def byte_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as bytes; every eleventh has a byte that is no UTF-8, and some of the others cannot be read."""
    return source_files(spark, sf_dir).drop("parse_error").withColumn(
        "content",
        F.expr("case when k % 11 = 0 then concat(cast(text as binary), x'FF') when k % 17 = 3 then null else cast(text as binary) end"),
    ).drop("text")


BYTE_ERROR_SQL = f"case when k % 11 = 0 then '{FS.NOT_UTF8}' when k % 17 = 3 then '{FS.NOT_READ}' else '' end"


# The bytes of a text, each read as one character.
LATIN_SQL = """array_to_string(list_transform(regexp_extract_all(hex(content), '..'),
  lambda x: chr(cast('0x' || x as integer))), '')"""


@query(f"""with {Q.FILES} select path, case when k % 11 = 0 then sha256({LATIN_SQL} || chr(255))
    when k % 17 = 3 then '' else sha256(content) end as digest, {BYTE_ERROR_SQL} as parse_error from files""")
def read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FS.read_text(byte_files(spark, sf_dir))
    return rows.select("path", F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"), "parse_error")


CLASS_TEXT_SQL = """array_to_string(list_transform(classes,
  lambda c: c.name || '{' || array_to_string(c.public_methods, ',') || '}'), ' | ')"""


def class_text(column: str = "classes") -> Column:
    return joined(
        F.transform(
            column,
            lambda c: F.concat(c["name"], F.lit("{"), F.array_join(c["public_methods"], ","), F.lit("}")),
        )
    )


POSITION_SQL = "row_number() over (partition by project order by string_split(path, '/')) - 1"


@query(Q.upto("analysis", f"""select project, cast(pos as bigint) as pos, path, array_to_string(headers, ' | ') as headers,
  {CLASS_TEXT_SQL} as classes, parse_error from (select *, {POSITION_SQL} as pos from analysis)"""))
def load_analysis_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "documents")
    K.write_snapshot(N.project_snapshot(analysis(spark, sf_dir)), folder)
    return D.load_analysis_doc(spark, folder).select(
        "project", "pos", "path", joined("headers").alias("headers"), class_text().alias("classes"), "parse_error"
    )


def laid_out(pieces: DataFrame) -> DataFrame:
    """Adds ``value``, the text of a piece as it stands in the document laid out over lines.

    A piece is laid out as a document of its own, and cut where the document
    without any files has its list, which is written ``[ ]``.
    """
    lines = lambda document: F.to_json(F.from_json(document, ANALYSIS_DOCUMENT), {"pretty": "true", "ignoreNullFields": "false"})
    start = F.concat(N.document_start(), F.lit(',"files":['))
    rows = pinned(pieces, _none=lines(F.concat(start, F.lit("]}"))), _own=lines(F.concat(start, "records", F.lit("]}"))))
    before, after = F.length("_none") - len("]\n}"), len(" ]\n}")
    # What its text holds beside its files and what stands before them: the document's end, if it is the last one.
    behind = F.length("document") - F.length("records") - F.when(F.col("part") == 0, F.length(start)).otherwise(len(","))
    head = F.when(F.col("part") == 0, F.substring("_none", F.lit(1), before)).otherwise(F.lit(", "))
    body = F.substring("_own", before + 1, F.length("_own") - before - after)
    end = F.when(behind > 0, F.lit(" ]\n}")).otherwise(F.lit(""))
    return rows.withColumn("value", F.concat(head, body, end)).drop("_none", "_own")


@query(Q.upto("analysis", f"""select project, cast(pos as bigint) as pos, path, array_to_string(headers, ' | ') as headers,
  {CLASS_TEXT_SQL} as classes, parse_error from (select *, {POSITION_SQL} as pos from analysis)"""))
def load_analysis_doc_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's document is one file, laid out over many lines."""
    folder = scratch(spark, "documents")
    pieces = N.project_documents(N.project_snapshot(analysis(spark, sf_dir)), whole=False)
    K.write_documents(laid_out(pieces), folder, "project")
    return D.load_analysis_doc(spark, folder, multi_line=True).select(
        "project", "pos", "path", joined("headers").alias("headers"), class_text().alias("classes"), "parse_error"
    )


@query(f"""select doc_id, path, ai_status, ai_analysis, issues from (
  select doc_id, {I.FILE_PATH} as path, 'generated' as ai_status, text as ai_analysis, 'a | b' as issues from documents where doc_id % 12 = 0
  union all select doc_id, {I.FILE_PATH}, 'cached', text, '' from documents where doc_id % 12 = 11)""")
def load_prev_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.load_prev_report(I.reports(spark, sf_dir))
    return rows.select(
        "doc_id", "path", "ai_status", "ai_analysis", joined("rule_based_issues").alias("issues")
    )


@query(f"""select doc_id, cast(0 as bigint) as pos,
    case doc_id % 12 when 0 then 'm1' else 'unknown' end as model,
    case doc_id % 12 when 0 then {I.FILE_PATH} else '<unknown>' end as path,
    case doc_id % 12 when 2 then 'error' when 3 then '' else 'generated' end as ai_status,
    case doc_id % 12 when 1 then '' when 2 then '[ERROR] x' else text end as ai_analysis,
    case doc_id % 12 when 0 then 'a | b' else '' end as issues
  from documents where doc_id % 12 in (0, 1, 2, 3)""")
def parse_report_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.parse_report_strict(I.reports(spark, sf_dir))
    return rows.select(
        "doc_id", "pos", "model", "path", "ai_status", "ai_analysis",
        joined("rule_based_issues").alias("issues"),
    )


@query(f"""select doc_id, case when doc_id % 12 in (0, 1, 2, 3, 10) then ''
  when doc_id % 12 = 4 then '{D.NO_RESULTS.replace("'", "''")}' else '{D.BROKEN_REPORT}' end as report_error from documents""")
def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.check_report(I.reports(spark, sf_dir)).select("doc_id", "report_error")


RUN_STARTS_SQL = """select cast(user_id as varchar) as project, cast(floor(epoch_us(max(ts)) / 1000000) as bigint) as last_started_at
  from events group by 1"""


def run_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.run_log(spark, sf_dir).select(
        F.col("key").cast("string").alias("project"),
        (F.col("t") / 1_000_000).alias("started_at"),
        (F.col("id") % 3).alias("run"),
    )


def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "state")
    starts = run_starts(spark, sf_dir)
    for run in range(3):
        K.save_run_state(starts.filter(F.col("run") == run), folder, f"r{run}")
    return K.load_run_state(spark, folder).select(
        "project", big(F.floor("last_started_at")).alias("last_started_at")
    )


QUERIES["load_run_state"] = stored_runs
SQL["load_run_state"] = RUN_STARTS_SQL


@query("""select cast(user_id as varchar) as project, event_id % 3 as run, cast(floor(epoch_us(ts) / 1000000) as bigint) as started_at,
  cast(floor(epoch_us(max(ts) over (partition by user_id)) / 1000000) as bigint) as last_started_at from events""")
def save_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three runs have stored, run by run, and the last start of each project that is read out of it."""
    folder, starts = scratch(spark, "state"), run_starts(spark, sf_dir)
    for run in range(3):
        K.save_run_state(starts.filter(F.col("run") == run), folder, f"r{run}")
    stored = spark.read.schema(RUN_STATE).parquet(folder).alias("s")
    last = K.load_run_state(spark, folder).alias("l")
    run = big(F.substring("run_id", 2, 9)).alias("run")
    rows = stored.join(last, F.col("s.project").eqNullSafe(F.col("l.project")), "left")
    return rows.select(
        "s.project", run, big(F.floor("started_at")).alias("started_at"), big(F.floor("last_started_at")).alias("last_started_at")
    )


# --- sinks -------------------------------------------------------------------


@query(Q.upto("analysis", """select project,
  to_json({'path': path, 'headers': headers, 'classes': classes, 'parse_error': parse_error})::varchar as line from analysis"""))
def write_analysis_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "analysis")
    K.write_analysis_json(analysis(spark, sf_dir), folder)
    return spark.read.schema("value string, project string").text(folder).select(
        "project", F.col("value").alias("line")
    )


SNAPSHOT_SQL = f"""snapshot as (select project, count(*) as files,
  '{{"root":"' || project || '","files":[' || string_agg(to_json({{'path': path, 'headers': headers, 'classes': classes,
    'parse_error': parse_error}})::varchar, ',' order by pos) || ']}}' as document
  from (select *, {POSITION_SQL} as pos from analysis) group by project)"""


@query(Q.upto("analysis", f""", parts as (select project, pos // {N.FILES_PER_PART} as part, min(pos) as first, count(*) as files,
    string_agg(to_json({{'path': path, 'headers': headers, 'classes': classes, 'parse_error': parse_error}})::varchar,
      ',' order by pos) as records
    from (select *, {POSITION_SQL} as pos from analysis) group by 1, 2)
  select project, part, first, files, sha256(records) as digest, cast(sum(files) over (partition by project) as bigint) as project_files,
    case when part = 0 then '{{"root":"' || project || '","files":[' else ',' end || records
      || case when part = max(part) over (partition by project) then ']}}' else '' end as document
  from parts"""))
def project_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each in as many rows as it has pieces."""
    pieces = N.document_pieces(materialised(N.project_snapshot(analysis(spark, sf_dir))))
    return pieces.select(
        "project", "part", "first", "files", F.sha2("records", 256).alias("digest"), "project_files", "document"
    )


@query(Q.upto("analysis", f", {SNAPSHOT_SQL} select project, files, document from snapshot"))
def project_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.project_documents(N.project_snapshot(analysis(spark, sf_dir)))


@query(Q.decided("""select project, path, array_to_string(issues, ' | ') as issues, ai_status, ai_analysis, file_hash,
  'm' as model, 'run-1' as run_id from results where action <> 'pending'"""))
def write_review_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "reviews")
    settled = C.settled_results(decided(spark, sf_dir), ["project"])
    K.write_review_snapshot(settled, folder, "run-1", "m", F.timestamp_seconds(F.lit(0)))
    return K.read_review_snapshot(spark, folder).select(
        *KEYS, joined("rule_based_issues").alias("issues"), "ai_status", "ai_analysis", "file_hash", "model", "run_id"
    )


@query(Q.decided("""select project, to_json({'path': path, 'rule_based_issues': issues, 'ai_status': ai_status,
  'ai_analysis': ai_analysis, 'file_hash': file_hash})::varchar as result from results where action <> 'pending'"""))
def report_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.report_view(C.settled_results(decided(spark, sf_dir), ["project"]))


# --- filters and predicates --------------------------------------------------


@query(f"""with {Q.FILES} select path, regexp_extract(rel, '[^/](\\.[^./]*)$', 1) as extension from files
  where regexp_matches(rel, '[^/]\\.(h|hh|hpp|hxx|c|cc|cpp|cxx)$')""")
def filter_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(spark, sf_dir).filter(P.is_source_file(F.col("relative_path")))
    return files.select("path", P.extension(F.col("path")).alias("extension"))


@query(f"with {Q.FILES} select path from files where {SOURCE_FILTER.split(' and ', 1)[1]}")
def filter_skip_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files(spark, sf_dir).filter(~P.in_skipped_directory(F.col("relative_path"))).select("path")


def broken_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.analyze(FS.read_text(byte_files(spark, sf_dir)))


BROKEN_SQL = f"""select project, path, case when {BYTE_ERROR_SQL} = '{FS.NOT_READ}' then '' else array_to_string(headers, ' | ') end as headers,
  case when {BYTE_ERROR_SQL} = '{FS.NOT_READ}' then '' else {CLASS_TEXT_SQL} end as classes, {BYTE_ERROR_SQL} as parse_error
  from analysis join (select project, path, k from files) using (project, path)"""


@query(Q.upto("analysis", BROKEN_SQL))
def row_error_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_analysis(spark, sf_dir).select(
        *KEYS, joined("headers").alias("headers"), class_text().alias("classes"), "parse_error"
    )


@query(f"""with {Q.FILES} select project, path, 'parse' as stage,
  'Failed to parse ' || path || ': ' || {BYTE_ERROR_SQL} as message from files where {BYTE_ERROR_SQL} <> ''""")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.diagnostics(broken_analysis(spark, sf_dir))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental run: two projects are in cooldown, the others are not."""
    facts = C.file_facts(I.run_files(spark, sf_dir))
    previous = C.dedupe_last(I.previous(spark, sf_dir), KEYS, "pos").drop("pos")
    manifest = I.manifest(spark, sf_dir)
    half = manifest.count() / 2
    cooldown = F.when(F.col("project").isin("src3", "src4"), F.lit(34.5)).otherwise(F.lit(0.0))
    return C.decide_action(manifest, facts, previous, KEYS, cooldown, F.lit(half))


@query(Q.decided("select project, path, pos, action from results"))
def decide_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select(*KEYS, "pos", "action")


@query(Q.decided("""select project, path, pos, ai_status in ('error', 'skipped') or starts_with(ai_analysis, '[ERROR]')
  as error_like from prev_all"""))
def is_error_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = C.is_error_like(F.col("ai_status"), F.col("ai_analysis"))
    return I.previous(spark, sf_dir).select(*KEYS, "pos", flag.alias("error_like"))


@query(Q.decided("select project, path, coalesce(reuse, false) as reuse from joined"))
def can_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select(*KEYS, (F.col("action") == "cached").alias("reuse"))


@query(f"select id, message, id % 8 not in (5, 6) as retryable from ({I.ERROR_LOG})")
def is_retryable_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.error_log(spark, sf_dir).withColumn("retryable", L.is_retryable_error(F.col("message")))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.review_results(spark, sf_dir)
    return D.json_defaults(rows.withColumn("model", F.lit(None).cast("string")))


@query(Q.reviews("select path, is_error, is_skipped, is_cached from flagged"))
def prefix_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_flags(results(spark, sf_dir)).select("path", "is_error", "is_skipped", "is_cached")


RESULT_SQL = "select path, array_to_string(issues, ' | ') as issues, ai_status, ai_analysis, file_hash from results"


def result_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "path", joined("rule_based_issues").alias("issues"), "ai_status", "ai_analysis", "file_hash"
    )


@query(Q.decided(f"{RESULT_SQL} where action <> 'pending'"))
def result_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_columns(C.settled_results(decided(spark, sf_dir), ["project"]))


@query(Q.decided("""select project, 2 + row_number() over (partition by project order by pos) as line, path, ai_status,
  sha256(ai_analysis) as digest, file_hash from results where action <> 'pending'"""))
def write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report documents as they are written, each line of them parsed alone and numbered by its place."""
    folder, out = scratch(spark, "run"), scratch(spark, "report")
    K.write_review_snapshot(C.settled_results(decided(spark, sf_dir), ["project"]), folder, "r1", "m", F.timestamp_seconds(F.lit(0)))
    K.write_report(spark, folder, "r1", I.manifest(spark, sf_dir), out)
    lines = spark.read.text(out).select(
        "project", "value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at")
    )
    placed = with_positions(materialised(lines), [F.col("file"), F.col("at")], ["project"], "line")
    entry = F.from_json(F.ltrim("value", F.lit(",")), "path string, ai_status string, ai_analysis string, file_hash string")
    rows = placed.select("project", (F.col("line") + 2).alias("line"), "value", entry.alias("e")).where(F.startswith(F.ltrim("value", F.lit(",")), F.lit('{"path"')))
    return rows.select("project", "line", "e.path", "e.ai_status", F.sha2("e.ai_analysis", 256).alias("digest"), "e.file_hash")


# --- joins -------------------------------------------------------------------


@query(Q.decided("select project, path, coalesce(prev_found, false) as prev_found, prev_status, prev_analysis, prev_hash from joined where exists_here"))
def join_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous = C.dedupe_last(I.previous(spark, sf_dir), KEYS, "pos").drop("pos")
    rows = C.join_previous(I.run_files(spark, sf_dir).select(*KEYS), previous, KEYS)
    return rows.withColumn("prev_found", F.coalesce("prev_found", F.lit(False)))


@query(Q.decided("""select project, path, prev_status, left(prev_analysis, 7) as prev_start, prev_hash, 'r' || prev.pos % 5 as prev_run
  from joined join prev using (project, path) where exists_here"""))
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five runs' results in the table of levels, asked for the files that are there."""
    table = LT.LatestResults(spark, scratch(spark, "latest"), fan_out=2)
    earlier = I.previous(spark, sf_dir).withColumn("run_ts", F.timestamp_seconds("pos"))
    for run in range(5):
        table.add(earlier.where(F.col("pos") % 5 == run).withColumn("run_id", F.lit(f"r{run}")), f"r{run}")
    found = materialised(table.join(I.run_files(spark, sf_dir).select(*KEYS)))
    table.close()
    return found.where("prev_found").select(*KEYS, "prev_status", F.col("prev_analysis").alias("prev_start"), "prev_hash", "prev_run")


@query(Q.decided("select project, path, pos from joined where not exists_here"))
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.missing_files(I.manifest(spark, sf_dir), I.run_files(spark, sf_dir), KEYS).select(*KEYS, "pos")


@query(Q.decided("""select project, path, pos, ai_status from results where action <> 'pending'
  union all select project, path, -pos, ai_status from results where action <> 'pending' and pos % 10 = 0"""))
def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the manifest is listed twice."""
    settled = C.settled_results(decided(spark, sf_dir), ["project"])
    manifest = I.manifest(spark, sf_dir)
    again = manifest.filter(F.col("pos") % 10 == 0).withColumn("pos", -F.col("pos"))
    return C.order_results(manifest.unionByName(again), settled, KEYS).select(
        *KEYS, "pos", "ai_status"
    ).orderBy("pos")


def digest_reviewer(whole: bool):
    """A reviewer that answers with the SHA-256 of a project's document, or of whole requests.

    It digests a document once for all requests that share it.
    """

    def factory():
        held: list = [None, None]

        def review(request):
            document = request["context"]
            if held[0] is not document:
                held[:] = document, hashlib.sha256(V.REQUEST_START.encode() if whole else b"")
                for piece in document:
                    held[1].update(piece.encode())
            digest = held[1].copy()
            if whole:
                digest.update(request["request"].removeprefix(V.REQUEST_START).encode())
            return digest.hexdigest()

        return review

    return factory


@query(Q.upto("analysis", f""", {SNAPSHOT_SQL} select path, sha256(document) as context
  from analysis join snapshot using (project)"""))
def attach_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(spark, sf_dir)
    snapshot = materialised(N.project_snapshot(N.analyze(files)))
    rows = files.select(*KEYS, F.lit("").alias("request"), F.array().cast("array<string>").alias("rule_based_issues"))
    seen = V.review_files(rows, digest_reviewer(whole=False), ["path"], concurrency=8, snapshot=snapshot)
    return seen.select("path", F.col("ai_analysis").alias("context"))


@query(Q.upto("files", """, versions as (
    select project, path, sha256(content) as old, case when k % 9 = 0 then 'x' else sha256(content) end as new, k from files)
  select project, path, case when k % 10 = 0 then 'removed' when k % 7 = 0 then 'added' when k % 9 = 0 then 'changed' else 'same' end as change
  from versions"""))
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version without a tenth of the files, with others added or changed."""
    files = source_files(spark, sf_dir)
    rows = parse.with_headers(parse.with_stripped(files)).select(*KEYS, "k", "headers")
    old = rows.filter((F.col("k") % 7 != 0) | (F.col("k") % 10 == 0)).drop("k")
    new = rows.filter(F.col("k") % 10 != 0).withColumn(
        "headers",
        F.when(F.col("k") % 9 == 0, F.array_append("headers", F.lit("extra.hpp"))).otherwise(F.col("headers")),
    )
    return C.snapshot_diff(old, new.drop("k"), KEYS)


# --- aggregations ------------------------------------------------------------


@query(Q.decided("select project, path, ai_status, ai_analysis, file_hash, pos from prev"))
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedupe_last(I.previous(spark, sf_dir), KEYS, "pos")


@query(Q.decided("""select project, count(*) filter (where ai_status = 'generated') as "generated",
  count(*) filter (where ai_status = 'cached') as cached, count(*) filter (where ai_status = 'skipped') as skipped,
  count(*) filter (where ai_status = 'error') as errors from results group by project"""))
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.status_counts(all_results(spark, sf_dir), ["project"])


@query(Q.reviews("""select project, count(*) filter (where verdict = 'PROBLEM') as problems,
  count(*) filter (where verdict = 'IMPROVE') as improve, count(*) filter (where verdict = 'GOOD') as good,
  count(*) as total from graded group by project"""))
def verdict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.report_totals(results(spark, sf_dir))


@query(Q.upto("headers", "select project, path, array_to_string(headers, ' | ') as headers from headers"))
def collect_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.with_headers(stripped(spark, sf_dir))
    return rows.filter(F.size("headers") > 0).select(*KEYS, joined("headers").alias("headers"))


@query(Q.upto("classes", f"select project, path, {CLASS_TEXT_SQL} as classes from classes"))
def collect_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.with_classes(stripped(spark, sf_dir))
    return rows.filter(F.size("classes") > 0).select(*KEYS, class_text().alias("classes"))


@query(Q.reviews("select path, has_issues from graded"))
def any_issue_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graded(results(spark, sf_dir)).select("path", "has_issues")


# --- running scans -----------------------------------------------------------


@query(Q.upto("pairs", "select path, open, close from pairs"))
def brace_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.with_braces(stripped(spark, sf_dir)).select("path", F.explode("pairs").alias("p"))
    return rows.select("path", big(F.col("p.open")).alias("open"), big(F.col("p.close")).alias("close"))


def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.with_traces(stripped(spark, sf_dir))
    bodies = rows.select(*KEYS, F.explode(F.arrays_zip("bodies", "traces")).alias("b"))
    return bodies.select(*KEYS, big(F.col("b.bodies.open")).alias("open"), F.explode("b.traces").alias("s"))


@query(Q.upto("levels", "select path, open, i, access from levels where b0 = 0"))
def carry_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace_rows(spark, sf_dir).filter(F.col("s.before") == 0)
    return rows.select("path", "open", big(F.col("s.ord")).alias("i"), F.col("s.access").alias("access"))


@query(Q.upto("levels", "select path, open, i, cast(b as bigint) as depth, cast(p as bigint) as parens from levels"))
def clamped_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_rows(spark, sf_dir).select(
        "path", "open", big(F.col("s.ord")).alias("i"),
        big(F.col("s.depth")).alias("depth"), big(F.col("s.parens")).alias("parens"),
    )


@query(f"""with l as (select key, id, epoch_us(ts) as t from ({I.ODD_REQUESTS}) r)
  select coalesce(key, 'none') as key, id, case when t is not null then count(t) over (partition by key order by t
    range between {HOUR_US - 1} preceding and current row) else -1 end as in_window from l""")
def rate_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = A.rate_window_count(I.odd_log(spark, sf_dir, I.ODD_REQUESTS), HOUR_US)
    return shown(counted, "none", "in_window")


def shown(rows: DataFrame, key: str | int, value: str) -> DataFrame:
    """Nulls as values of their own, which compare alike everywhere."""
    return rows.select(F.coalesce("key", F.lit(key)).alias("key"), "id", F.coalesce(value, F.lit(-1)).alias(value))


def admit_sql(rows: str) -> str:
    return f"""with l as (select key, id, epoch_us(ts) as t from ({rows}) r),
  r as (select *, row_number() over (partition by key order by t, id) - 1 as rn from l where t is not null),
  s as (select *, rn % 3 as c, rn // 3 as j from r)
  select coalesce(key, 'none') as key, id, {HOUR_US} * j + max(t - {HOUR_US} * j) over (partition by key, c order by j) as admit from s
  union all select coalesce(key, 'none'), id, -1 from l where t is null"""


ADMIT_SQL = admit_sql("select event_type as key, event_id as id, ts from events")


@query(admit_sql(I.ODD_REQUESTS))
def admission_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(A.admission_schedule(I.odd_log(spark, sf_dir, I.ODD_REQUESTS), 3, HOUR_US), "none", "admit")


def gate_sql(rows: str) -> str:
    return f"""with recursive log as (select key, coalesce(key, -1) as k, id, epoch_us(ts) as t from ({rows}) r),
  gate as (select k, min(t) as t from log where t is not null group by k
    union all select g.k, (select min(l.t) from log l where l.k = g.k and l.t >= g.t + {DAY_US})
    from gate g where exists (select 1 from log l where l.k = g.k and l.t >= g.t + {DAY_US}))
  select l.k as key, l.id, g.t is not null and l.id = min(l.id) over (partition by l.k, l.t) as accepted
  from log l left join gate g on l.k = g.k and l.t = g.t"""


@query(gate_sql(I.ODD_RUNS))
def cooldown_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = A.cooldown_gate(I.odd_log(spark, sf_dir, I.ODD_RUNS), DAY_US)
    return gated.select(F.coalesce("key", F.lit(-1)).alias("key"), "id", "accepted")


@query(Q.reviews("select doc_id, n, sha256(line) as line, fenced from fences"))
def fence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).select("doc_id", F.split("ai_analysis", "\n", -1).alias("raw"))
    rows = pinned(rows, raw=F.col("raw"), lines=R.fence_state(F.col("raw")))
    return rows.select("doc_id", F.posexplode("lines").alias("n", "l")).select(
        "doc_id", big(F.col("n")).alias("n"), F.sha2("l.line", 256).alias("line"), F.col("l.fenced").alias("fenced")
    )


@query(f"with {Q.FILES} select path, row_number() over (order by string_split(path, '/')) - 1 as rank from files")
def sort_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = source_files(spark, sf_dir).select("path")
    return with_positions(paths, [P.path_order(F.col("path"))], name="rank").select("path", "rank")


# --- set operations ----------------------------------------------------------


def all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(spark, sf_dir)
    pending = rows.filter(F.col("action") == "pending").withColumn("request", F.col("path"))
    reviewed = V.review_files(pending, V.offline_reviewer, ["project", "path", "rule_based_issues", "file_hash"])
    answered = reviewed.select("project", "path", "rule_based_issues", "ai_status", "ai_analysis", "file_hash")
    return C.merge_results(C.settled_results(rows, ["project"]), answered)


@query(Q.decided(RESULT_SQL))
def merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_columns(all_results(spark, sf_dir))


# --- text functions ----------------------------------------------------------


@query(f"with {Q.FILES} select path, sha256(trim(chr(9) || content || ' ' || chr(13), {Q.WS})) as trimmed from files")
def trim_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\t"), F.col("text"), F.lit(" \r"))
    return source_files(spark, sf_dir).select("path", F.sha2(T.trim_ws(padded), 256).alias("trimmed"))


@query(f"""with {Q.FILES}, l as (select path, unnest(string_split(content, chr(10))) as line,
    unnest(range(len(string_split(content, chr(10))))) as n from files)
  select path, n, sha256(case when ends_with(line, chr(13)) then line[:-2] else line end) as line from l""")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_files(spark, sf_dir).select("path", F.posexplode(T.split_lines(F.col("text"))).alias("n", "line"))
    return rows.select("path", big(F.col("n")).alias("n"), F.sha2("line", 256).alias("line"))


@query("select doc_id, lower(lang) = lower(upper(lang)) as same_lang, lower(translate(text, 'àâäéèêëîïôöûüçÀÂÄÉÈÊËÎÏÔÖÛÜÇ', '')) = text as same_text from documents")
def eq_ignore_ascii_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = F.translate("text", "àâäéèêëîïôöûüçÀÂÄÉÈÊËÎÏÔÖÛÜÇ", "")
    same = T.eq_ignore_ascii_case(F.col("lang"), F.upper("lang"))
    return rows.select("doc_id", same.alias("same_lang"), (T.ascii_lower(plain) == F.col("text")).alias("same_text"))


@query(Q.upto("stripped", "select path, sha256(s) as stripped from stripped"))
def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripped(spark, sf_dir).select("path", F.sha2("stripped", 256).alias("stripped"))


@query(Q.upto("headers", "select path, header, row_number() over (partition by path order by min(n)) - 1 as pos from includes group by path, header"))
def extract_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.with_headers(stripped(spark, sf_dir)).select("path", F.posexplode("headers").alias("pos", "header"))
    return rows.withColumn("pos", big(F.col("pos")))


@query(Q.upto("bodies", "select path, open, close, keyword, name from bodies"))
def extract_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.with_bodies(stripped(spark, sf_dir)).select("path", F.explode("bodies").alias("b"))
    return rows.select(
        "path", big(F.col("b.open")).alias("open"), big(F.col("b.close")).alias("close"), "b.keyword", "b.name"
    )


@query(Q.upto("heads", "select path, open, name, after_enum from heads"))
def exclude_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.with_heads(stripped(spark, sf_dir)).select("path", F.explode("heads").alias("h"))
    return rows.select("path", big(F.col("h.open")).alias("open"), "h.name", "h.after_enum")


@query(Q.upto("statements", "select path, open, i, statement from statements where access = 'public' and statement <> ''"))
def public_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace_rows(spark, sf_dir).filter(
        (F.col("s.access") == "public") & F.col("s.statement").isNotNull() & (F.col("s.statement") != "")
    )
    return rows.select("path", "open", big(F.col("s.ord")).alias("i"), "s.statement")


def ended_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace_rows(spark, sf_dir).filter(F.col("s.statement").isNotNull())
    return rows.select("path", "open", big(F.col("s.ord")).alias("i"), F.col("s.statement").alias("statement"))


@query(Q.upto("methods", "select path, open, i, filtered from checked"))
def is_filtered_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ended_statements(spark, sf_dir).select(
        "path", "open", "i", S.is_filtered_statement(F.col("statement")).alias("filtered")
    )


@query(Q.upto("methods", "select path, open, i, method from checked"))
def looks_like_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ended_statements(spark, sf_dir).select(
        "path", "open", "i", S.looks_like_method(F.col("statement")).alias("method")
    )


@query(Q.upto("methods", "select path, open, statement, row_number() over (partition by path, open order by i) - 1 as pos from methods"))
def public_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.with_traces(stripped(spark, sf_dir))
    bodies = rows.select(*KEYS, F.explode(F.arrays_zip("bodies", "traces")).alias("b"))
    methods = bodies.select(
        "path",
        big(F.col("b.bodies.open")).alias("open"),
        F.posexplode(S.public_methods(F.col("b.traces"))).alias("pos", "statement"),
    )
    return methods.withColumn("pos", big(F.col("pos")))


@query(f"""with {Q.FILES} select path, array_to_string(list_filter([
    case when contains(content, 'new ') and not contains(content, 'delete') then '{T.NEW_WITHOUT_DELETE.replace("'", "''")}' end,
    case when contains(content, 'malloc') and not contains(content, 'free') then '{T.MALLOC_WITHOUT_FREE.replace("'", "''")}' end,
    case when contains(content, 'while(true)') or contains(content, 'for(;;)') then '{T.INFINITE_LOOP}' end],
  lambda x: x is not null), ' | ') as issues from files""")
def rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files(spark, sf_dir).select("path", joined(T.rule_checks(F.col("text"))).alias("issues"))


@query(f"""with {Q.FILES} select path, sha256(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))) as file_hash
  from files""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files(spark, sf_dir).select("path", T.content_hash(F.col("text")).alias("file_hash"))


def review_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir)
    return rows.select("doc_id", F.posexplode(F.split("ai_analysis", "\n", -1)).alias("n", "line")).withColumn(
        "n", big(F.col("n"))
    )


@query(Q.reviews(f"""select doc_id, n, sha256(rtrim(regexp_replace(line, '^[ \\t\\r\\n#*_>-]+', ''), {Q.WS})) as plain
  from review_lines"""))
def strip_markdown_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_lines(spark, sf_dir).select(
        "doc_id", "n", F.sha2(R.strip_markdown_prefix(F.col("line")), 256).alias("plain")
    )


@query(Q.reviews(f"""select doc_id, n, regexp_extract(line, '{Q.MARK}', 1) = 'ISSUES' as issues,
  regexp_extract(line, '{Q.MARK}', 1) = 'SUMMARY' as summary from review_lines"""))
def marker_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return review_lines(spark, sf_dir).select(
        "doc_id", "n", R.marker_match(line, "ISSUES").alias("issues"), R.marker_match(line, "SUMMARY").alias("summary")
    )


@query(Q.reviews("select doc_id, summary, issues, suggestions from sections"))
def extract_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_sections(results(spark, sf_dir)).select("doc_id", "summary", "issues", "suggestions")


@query(Q.reviews("""select doc_id, n, sha256(regexp_replace(regexp_replace(line, '^[ \\t\\r\\n#*_>-]*[ \\t\\r\\n.):`0-9]*', ''),
  '[ \\t\\r\\n.:;*`_]+$', '')) as plain from review_lines"""))
def normalize_issue_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_lines(spark, sf_dir).select(
        "doc_id", "n", F.sha2(R.normalize_issue_line(F.col("line")), 256).alias("plain")
    )


@query(Q.reviews("select doc_id, has_issues from has_issues"))
def meaningful_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.with_sections(results(spark, sf_dir))
    return rows.select("doc_id", R.meaningful_issues(F.col("issues")).alias("has_issues"))


@query(Q.reviews("select doc_id, verdict from graded"))
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graded(results(spark, sf_dir)).select("doc_id", "verdict")


REQUEST_SQL = f"""select f.path, sha256('Review one C or C++ file as part of its project. Answer with the three sections '
    || '[SUMMARY], [ISSUES] and [SUGGESTIONS], each marker on a line of its own.'
    || nl || '## Project' || chr(10) || document || nl || '## Path' || chr(10) || f.path
    || nl || '## Includes' || chr(10) || to_json(headers)::varchar || nl || '## Types' || chr(10) || to_json(classes)::varchar
    || nl || '## Parser' || chr(10) || 'Parser completed without file-level errors.'
    || nl || '## Code' || chr(10) || {I.FENCE} || 'cpp' || chr(10) || content || chr(10) || {I.FENCE}) as request
  from analysis a join snapshot using (project) join files f using (project, path), (select chr(10) || chr(10) as nl)"""


@query(Q.upto("analysis", f", {SNAPSHOT_SQL} {REQUEST_SQL}"))
def build_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(spark, sf_dir)
    shape = materialised(N.analyze(files))
    rows = shape.join(files.select(*KEYS, "text"), KEYS)
    requests = V.build_request(rows).withColumn("rule_based_issues", F.array().cast("array<string>"))
    snapshot = materialised(N.project_snapshot(shape))
    seen = V.review_files(requests, digest_reviewer(whole=True), ["path"], concurrency=8, snapshot=snapshot)
    return seen.select("path", F.col("ai_analysis").alias("request"))


@query("""select event_id as id, '[SKIPPED]' || chr(10) || 'AI analysis was skipped because the cooldown window is still active.'
    || chr(10) || chr(10) || 'Next AI run is available in about ' || greatest(1, cast(round_even(event_id / 2, 0) as bigint))
    || ' seconds.' as message from events""")
def cooldown_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.run_log(spark, sf_dir)
    return rows.select("id", L.cooldown_message(F.col("id") / 2).alias("message"))


@query(Q.reviews("""select path, verdict, rule_text as rules, case when is_error or is_skipped then ai_analysis else '' end as message,
    not is_error and not is_skipped and is_cached as from_cache,
    case when is_error or is_skipped then '' else summary end as summary,
    case when has_issues then issues else '' end as issues,
    case when is_error or is_skipped then '' else suggestions end as suggestions from graded"""))
def file_report_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.file_report_row(results(spark, sf_dir))
    return rows.select(
        "path", "verdict", joined("rule_based_issues").alias("rules"), "message", "from_cache",
        "summary", "issues", "suggestions",
    )


@query("""select event_id as id, cast(case when event_id % 7 = 0 then 0
    when event_id % 5 = 0 then 0 else greatest(0, 120000000 - (1704067200000000 + 86400000000 * 15 - epoch_us(ts))) end as bigint) as micros
  from events""")
def cooldown_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some logs have no earlier run, some no minimum interval."""
    now = 1_704_067_200.0 + 86_400.0 * 15
    last = F.when(F.col("id") % 5 != 0, F.col("t") / 1_000_000)
    interval = F.when(F.col("id") % 7 == 0, F.lit(0.0)).otherwise(F.lit(120.0))
    left = L.cooldown_remaining(F.lit(now), last, interval)
    return I.run_log(spark, sf_dir).select("id", big(F.round(left * 1_000_000)).alias("micros"))


@query("""with p as (select event_id as id, event_id % 5 as attempts, (event_id % 4) * 1.0::double as b0,
    case event_id % 3 when 0 then 0.5 when 1 then 2.0 else 3.0 end::double as mult from events),
  k as (select *, unnest(range(1, greatest(attempts, 1)::bigint)) as retry from p)
  select id, retry, cast(round(1000 * case when retry = 1 then b0 else least(15.0, b0 * pow(greatest(mult, 1.0), retry - 1)) end) as bigint) as millis
  from k""")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.run_log(spark, sf_dir).select(
        "id",
        (F.col("id") % 5).alias("attempts"),
        (F.col("id") % 4).cast("double").alias("b0"),
        F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") % 3 == 1, 2.0).otherwise(3.0).alias("mult"),
    )
    sleeps = L.backoff_schedule(F.col("attempts").cast("int"), F.col("b0"), F.col("mult"), F.lit(15.0))
    return rows.select("id", F.posexplode(sleeps).alias("retry", "sleep")).select(
        "id", big(F.col("retry") + 1).alias("retry"), big(F.round(F.col("sleep") * 1000)).alias("millis")
    )


@query("select event_id as id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp from events")
def utc_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.run_log(spark, sf_dir)
    return rows.select("id", T.utc_stamp(F.timestamp_micros("t")).alias("stamp"))


@query(Q.reviews("select path, 'unknown' as model, ai_status, rule_text as rules from reviews"))
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("path", "model", "ai_status", joined("rule_based_issues").alias("rules"))


# --- streaming ---------------------------------------------------------------

ARRIVAL_SQL = f"""with f as (select source as project, {I.FILE_PATH} as path, doc_id, {I.FILE_TEXT} as text from documents),
  g as (select *, case when doc_id % 4 = 0 then text || 'while(true)' || chr(10) else text end as now_text from f)
  select project, path, case when doc_id % 4 = 0 then 'generated' else 'cached' end as ai_status,
    sha256(replace(replace(now_text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) as file_hash,
    contains(now_text, 'while(true)') or contains(now_text, 'for(;;)') as loops from g"""


@query(ARRIVAL_SQL)
def stream_incremental_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves arrive, the second within the cooldown of the first; it is reviewed
    with the third drop, which holds the first half again. Then all files, a quarter of them changed."""
    files = I.run_sql(
        spark,
        sf_dir,
        f"select source as project, {I.FILE_PATH} as path, {I.FILE_TEXT} as text, '' as parse_error, "
        "cast('2024-01-01' as timestamp) as mtime, doc_id from documents",
    )
    drops, folder, checkpoint = (scratch(spark, n) for n in ("drops", "reviews", "stream"))
    options = B.ReviewOptions(per_minute=0, concurrency=8)
    changed = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("while(true)\n"))).otherwise(F.col("text"))
    arrivals = [
        files.filter(F.col("doc_id") % 2 == 0),
        files.filter(F.col("doc_id") % 2 == 1),
        files.filter(F.col("doc_id") % 2 == 0),
        files.withColumn("text", changed),
    ]
    clock = iter([1000.0, 1060.0, 1200.0, 1400.0])
    for arrival in arrivals:
        arrival.drop("doc_id").write.mode("append").parquet(drops)
        stream = spark.readStream.schema(arrival.drop("doc_id").schema).parquet(drops)
        SI.stream_incremental_review(stream, folder, checkpoint, options, lambda: next(clock)).awaitTermination()
    latest = C.dedupe_last(K.read_review_snapshot(spark, folder), KEYS, "run_ts")
    return latest.select(
        *KEYS, "ai_status", "file_hash",
        F.array_contains("rule_based_issues", T.INFINITE_LOOP).alias("loops"),
    )


def in_spans(spark: SparkSession, log: DataFrame, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream makes of a log that arrives in four spans of time, a file of it at a time."""
    drops, out, checkpoint = (scratch(spark, n) for n in ("drops", "made", "stream"))
    week = F.least(F.floor((F.col("t") - 1_704_067_200_000_000) / (7 * DAY_US)), F.lit(3))
    for n in range(4):
        log.filter(week == n).coalesce(1).write.mode("append").parquet(drops)
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(drops)
        with SG.keyed_state(spark):
            job(stream).writeStream.format("parquet").option("path", out).option(
                "checkpointLocation", checkpoint
            ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(ADMIT_SQL)
def stream_rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = in_spans(spark, I.request_log(spark, sf_dir), lambda s: SG.stream_rate_limiter(s, 3, HOUR_US))
    return made.select("key", "id", "admit")


@query(gate_sql("select user_id as key, event_id as id, ts from events"))
def cooldown_gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = in_spans(spark, I.run_log(spark, sf_dir), lambda s: SG.stream_cooldown_gate(s, DAY_US))
    return made.select("key", "id", "accepted")


@query(Q.reviews("""select project, count(*) filter (where ai_status = 'generated') as "generated",
  count(*) filter (where ai_status = 'cached') as cached, count(*) filter (where ai_status = 'skipped') as skipped,
  count(*) filter (where ai_status = 'error') as errors from reviews group by project"""))
def stream_status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results arrive in three drops."""
    rows = results(spark, sf_dir).select("project", "path", "ai_status", "doc_id")
    drops, folder, checkpoint = (scratch(spark, n) for n in ("drops", "totals", "stream"))
    for n in range(3):
        rows.filter(F.col("doc_id") % 3 == n).write.mode("append").parquet(drops)
        stream = spark.readStream.schema(rows.schema).parquet(drops)
        SI.stream_status_totals(stream, folder, checkpoint).awaitTermination()
    return SI.latest_totals(spark.read.parquet(folder))


# --- reviewer ----------------------------------------------------------------


@query(Q.decided("select path, ai_status, ai_analysis from results where action = 'pending'"))
def review_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = decided(spark, sf_dir).filter(F.col("action") == "pending").withColumn("request", F.col("path"))
    return V.review_files(pending, V.offline_reviewer, ["path"]).select("path", "ai_status", "ai_analysis")


def fault_reviewer() -> V.Reviewer:
    """Fails a number of times per row, as its issues say, and then answers."""
    seen: dict[str, int] = {}

    def review(row: dict) -> str:
        failures, message = row["rule_based_issues"]
        seen[row["path"]] = seen.get(row["path"], 0) + 1
        if seen[row["path"]] <= int(failures):
            raise RuntimeError(message)
        return "[SUMMARY]\nok"

    return review


@query(f"""with e as (select id, message, id % 4 as f, id % 8 not in (5, 6) as again from ({I.ERROR_LOG}))
  select cast(id as varchar) as path, case when f = 0 or (again and f < 3) then 'generated' else 'error' end as ai_status,
    case when f = 0 or (again and f < 3) then '[SUMMARY]' || chr(10) || 'ok'
      else '[ERROR]' || chr(10) || 'AI analysis unavailable.' || chr(10) || chr(10) || 'Reason: ' || message end as ai_analysis,
    cast(case when f = 0 or not again then 1 else least(f + 1, 3) end as bigint) as attempts from e""")
def retry_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.error_log(spark, sf_dir).select(
        F.col("id").cast("string").alias("path"),
        F.lit("").alias("request"),
        F.array((F.col("id") % 4).cast("string"), F.col("message")).alias("rule_based_issues"),
    )
    out = V.review_files(rows, fault_reviewer, ["path"], concurrency=8, clock=CountingClock)
    return out.select("path", "ai_status", "ai_analysis", big(F.col("attempts")).alias("attempts"))


SLOT_SQL = f"""select path, {1_704_067_200_000_000} + ((row_number() over (order by path) - 1) // 15) * 60000000 as send_at,
  cast((row_number() over (order by path) - 1) % 15 % 3 as integer) as send_task from ({I.MANIFEST}) m"""


@query(SLOT_SQL)
def throttle_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each request goes out, and from which of three tasks, under 15 a minute."""
    return V.with_slots(I.manifest(spark, sf_dir).select("path"), 15, 3, 1_704_067_200_000_000)


def no_reviewer() -> V.Reviewer:
    raise RuntimeError("API key is not set")


@query(Q.decided("""select path, 'error' as ai_status, '[ERROR]' || chr(10) || 'AI analysis unavailable.' || chr(10) || chr(10)
  || 'Reason: API key is not set' as ai_analysis, file_hash from results where action = 'pending'"""))
def client_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = decided(spark, sf_dir).filter(F.col("action") == "pending").withColumn("request", F.col("path"))
    answers, started = V.review_or_explain(pending, no_reviewer, ["project"])
    assert not started
    return answers.select("path", "ai_status", "ai_analysis", "file_hash")


# --- whole jobs --------------------------------------------------------------

TOTALS_SQL = Q.upto("files", """, flags as (select project,
    (contains(content, 'new ') and not contains(content, 'delete')) or (contains(content, 'malloc') and not contains(content, 'free'))
      or contains(content, 'while(true)') or contains(content, 'for(;;)') as bad from files)
  select project, count(*) filter (where bad) as problems, count(*) filter (where false) as improve,
    count(*) filter (where not bad) as good, count(*) as total from flags group by project""")


@query(TOTALS_SQL)
def corpus_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: analyse all files, review them offline, grade, count."""
    files = source_files(spark, sf_dir).withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    options = B.ReviewOptions(per_minute=0, concurrency=8)
    stored = B.review_run(files, scratch(spark, "run"), "run-1", 1_704_067_200.0, options)
    return B.report_totals(stored)
