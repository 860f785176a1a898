"""Answers that outlive a killed run, and the table of latest results."""

import os
import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import review as V
from corpuslens.operators.storage import children
from corpuslens.plans import batch as B
from corpuslens.sources import answers as AN
from corpuslens.sources import latest as LT
from corpuslens.sources import sinks as K
from corpuslens.sources import structure_store as ST

FILES = "project string, path string, text string, parse_error string, mtime timestamp"


def source_rows(spark, count, tag=""):
    return spark.createDataFrame([("p" if i % 3 else "q", f"f{i}.c", f"int a{i}{tag};", "", None) for i in range(count)], FILES)


def paid_reviewer(folder, last):
    """Writes down every call; the call numbered ``last`` kills its process before it is made."""

    def factory():
        def review(request):
            with open(f"{folder}/calls", "a+") as calls:
                calls.seek(0)
                if len(calls.readlines()) >= last and not os.path.exists(f"{folder}/mended"):
                    os._exit(1)
                calls.write(f"{request['path']}\n")
            return f"[SUMMARY]\nabout {request['path']}"

        return review

    return factory


@pytest.mark.parametrize("next_run", ["r1", "r2"])
def test_a_killed_run_repeats_no_call(spark, tmp_path, next_run):
    folder, files = str(tmp_path / "reviews"), source_rows(spark, 30)
    options = B.ReviewOptions(factory=paid_reviewer(str(tmp_path), 12), per_minute=0, concurrency=2)
    with pytest.raises(Exception, match="(?s)worker|crash|exited"):
        B.review_run(files, folder, "r1", 1000.0, options)
    assert K.finished_runs(spark, folder) == []
    before = (tmp_path / "calls").read_text().split()
    assert 12 <= len(before) < 30 and AN.load_answers(spark, folder, "offline-rules").count() == len(before)
    (tmp_path / "mended").touch()
    done = B.review_run(files, folder, next_run, 1001.0, B.ReviewOptions(factory=options.factory, per_minute=0, concurrency=3, min_run_interval=0.0))
    calls = (tmp_path / "calls").read_text().split()
    assert sorted(calls) == sorted(f"f{i}.c" for i in range(30))
    assert {(r.path, r.ai_status, r.ai_analysis) for r in done.collect()} == {
        (f"f{i}.c", "generated", f"[SUMMARY]\nabout f{i}.c") for i in range(30)
    }
    assert children(spark, f"{folder}/answers") == []


def test_answers_in_pieces(spark, tmp_path):
    where = AN.AnswerFolder(str(tmp_path), "r", "m", per_piece=2)
    rows = [{"project": "p", "path": f"f{i}", "file_hash": None if i == 0 else "h"} for i in range(5)]
    log = where.open(3)
    for i, row in enumerate(rows[:4]):
        log.keep(row, f"answer {i}")
    log.keep(rows[4], "answer 4")
    again = where.open(3)
    assert [again.known(r) for r in rows] == ["answer 0", "answer 1", "answer 2", "answer 3", None]
    log.flush()
    assert where.open(3).known(rows[4]) == "answer 4" and where.open(2).known(rows[1]) is None
    assert AN.AnswerFolder(str(tmp_path), "r", "other").open(3).known(rows[1]) is None
    # A piece that was never finished has a hidden name.
    (tmp_path / "answers/run_id=r/slot=3/_open-x.parquet").write_bytes(b"half")
    assert AN.load_answers(spark, str(tmp_path), "m").count() == 5


def test_speculation_is_refused():
    rows = SimpleNamespace(sparkSession=SimpleNamespace(conf={"spark.speculation": "true"}))
    with pytest.raises(ValueError, match="peculati"):
        V.review_files(rows, V.offline_reviewer, ["path"], answers=AN.AnswerFolder("/tmp", "r", "m"))


SNAPSHOT = "project string, path string, rule_based_issues array<string>, ai_status string, ai_analysis string, file_hash string, model string, run_id string, run_ts timestamp"


def run_rows(spark, run, rows):
    made = [(p, f, [], status, text, digest, "m", run) for p, f, status, text, digest in rows]
    stamp = F.timestamp_seconds(F.lit(int(run[1:])))
    return spark.createDataFrame(made, SNAPSHOT.replace(", run_ts timestamp", "")).withColumn("run_ts", stamp)


def test_latest_results_by_levels(spark, tmp_path):
    rng, want = random.Random(4), {}
    table = LT.LatestResults(spark, str(tmp_path), fan_out=2)
    for n in range(9):
        rows = {}
        for _ in range(20):
            path = f"f{rng.randint(0, 40)}"
            rows[path] = ("p" if n % 2 else None, path, rng.choice(["generated", "error"]), f"[ERROR]\n{n}" if n % 3 else f"text {n}", f"h{n}")
        table.add(run_rows(spark, f"r{n}", list(rows.values())), f"r{n}")
        table.add(run_rows(spark, f"r{n}", []), f"r{n}")
        want |= {(r[0], r[1]): (r[2], r[3][:7], r[4], f"r{n}") for r in rows.values()}
    table.close()
    table = LT.LatestResults(spark, str(tmp_path), fan_out=2)
    assert len(table.segments) <= 4 and table.added() == {f"r{n}" for n in range(9)}
    assert len(children(spark, f"{tmp_path}/latest/segments")) == len(table.segments)
    files = spark.createDataFrame([(p, f"f{i}") for p in ("p", "x") for i in range(50)], "project string, path string")
    got = {(r.project, r.path): r for r in table.join(files).collect()}
    assert len(got) == 100
    for key, row in got.items():
        found = want.get(key)
        assert row.prev_found == (found is not None)
        assert found is None or (row.prev_status, row.prev_analysis, row.prev_hash, row.prev_run) == found
    table.close()


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_stored_results_are_not_shuffled(spark, tmp_path):
    table = LT.LatestResults(spark, str(tmp_path), fan_out=8)
    for n in range(3):
        table.add(run_rows(spark, f"r{n}", [("p", f"f{i}", "generated", "long text", "h") for i in range(50)]), f"r{n}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        files = spark.range(1000).selectExpr("'p' as project", "concat('f', id) as path")
        plan = plan_of(table.join(files))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The files are dealt once; the segments lie in the same buckets.
    assert len(re.findall(r"Bucketed: true", plan)) == 3 and len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    table.close()


def test_finished_runs_stay_and_texts_come_from_the_runs_that_hold_them(spark, tmp_path):
    folder = str(tmp_path / "reviews")
    options = B.ReviewOptions(per_minute=0, min_run_interval=0.0)

    def status(run, files):
        return {r.path: (r.ai_status, r.ai_analysis) for r in B.review_run(files, folder, run, float(run[1:]), options).collect()}

    first = status("r1000", source_rows(spark, 6))
    assert {s for s, _ in first.values()} == {"generated"}
    for n in range(2, 6):
        later = status(f"r{n}000", source_rows(spark, 6))
        assert later == {p: ("cached", text) for p, (_, text) in first.items()}
    assert status("r1000", source_rows(spark, 2, "changed")) == first
    table = LT.LatestResults(spark, folder)
    decided = table.join(source_rows(spark, 6).select("project", "path")).withColumn("action", F.lit("cached"))
    texts = B.reused_texts(decided, folder)
    assert texts.count() == 6 and {r.prev_run for r in texts.collect()} == {"r5000"}
    plan = plan_of(texts)
    assert "Sort [" not in plan and "r5000" in plan and "r4000" not in plan
    table.close()


def test_stored_structure_does_not_grow_with_batches(spark, tmp_path):
    """Thirty batches: what one project reads stays at a few segments, and is the newest of each file."""
    store, want, read = ST.StructureStore(spark, str(tmp_path), fan_out=3), {}, []
    schema = "project string, path string, headers array<string>, classes array<struct<name:string,public_methods:array<string>>>, parse_error string"
    for n in range(30):
        rows = [(f"p{n % 4}", f"f{n % 3}.c", [f"h{n}"], [], ""), ("all", f"f{n % 5}.c", [f"h{n}"], [], "")]
        store.add(spark.createDataFrame(rows, schema), n)
        store.add(spark.createDataFrame(rows[:0], schema), n)
        want |= {(r[0], r[1]): r[2] for r in rows}
        if n % 10 == 9:
            found = store.of(spark.createDataFrame([("all",), ("p1",), ("new",)], "project string"), n)
            assert {(r.project, r.path): r.headers for r in found.collect()} == {k: v for k, v in want.items() if k[0] in ("all", "p1")}
            read.append(len(found.inputFiles()))
    assert len(store.segments) <= 7 and max(read) <= 3 * 7
    again = ST.StructureStore(spark, str(tmp_path), fan_out=3)
    assert again.segments == store.segments and ST.StructureStore(spark, f"{tmp_path}/none").of(found, 3).count() == 0
