"""Operators on skewed and dense inputs, and whole runs, against plain Python."""

import io
import json
import os
import random
import subprocess
import sys
import time
from collections import Counter, deque
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.clock import CountingClock
from corpuslens.functions.paths import path_order
from corpuslens.functions.text import universal_newlines
from corpuslens.operators import admission as A
from corpuslens.operators import analysis as N
from corpuslens.operators import order as O
from corpuslens.operators import parse
from corpuslens.operators import review as V
from corpuslens.operators.order import with_positions
from corpuslens.operators.storage import materialised
from corpuslens.plans import batch as B
from corpuslens.schemas import CLASSES
from corpuslens.sources import documents as D
from corpuslens.sources import files as FS
from corpuslens.sources import json_pieces as JP
from corpuslens.sources import sinks as K
from corpuslens.sources import tree as ST
from corpuslens.sources.files import read_text
from corpuslens.streaming import gates as SG
from corpuslens.streaming import incremental as SI


def log_rows(seed, count, span, keys=("hot", "hot", "hot", "a", "b")):
    rng = random.Random(seed)
    return [(rng.choice(keys), i, rng.randint(-span, span)) for i in range(count)]


def by_key(rows):
    for key in {r[0] for r in rows}:
        yield key, sorted((t, i) for k, i, t in rows if k == key)


@pytest.mark.parametrize("span", [50, 2000, 200_000])
def test_admission_equals_a_queue(spark, span):
    rows = log_rows(span, 4000, span)
    want = {}
    for _, events in by_key(rows):
        sent = deque(maxlen=7)
        for t, i in events:
            at = max(t, sent[0] + 60) if len(sent) == 7 else t
            sent.append(at)
            want[i] = at
    log = spark.createDataFrame(rows, "key string, id bigint, t bigint")
    got = {r.id: r.admit for r in A.admission_schedule(log, 7, 60).collect()}
    assert got == want


def test_busy_keys_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(O, "GROUP_ROWS", 100)
    test_admission_equals_a_queue(spark, 2000)
    test_window_counts(spark, 100)


def test_null_keys_and_times(spark):
    rows = [("a", 1, 0), (None, 2, 0), (None, 3, 1), ("a", 4, None), (None, 5, 30), ("a", 1, 0)]
    log = spark.createDataFrame(rows, "key string, id bigint, t bigint")
    sent = sorted(((r.key, r.id, r.t, r.admit) for r in A.admission_schedule(log, 1, 60).collect()), key=str)
    assert sent == sorted([("a", 1, 0, 0), ("a", 1, 0, 60), ("a", 4, None, None), (None, 2, 0, 0), (None, 3, 1, 60), (None, 5, 30, 120)], key=str)
    gate = A.cooldown_gate(log, 20).collect()
    assert sorted((r.id, r.accepted) for r in gate) == [(1, True), (1, True), (2, True), (3, False), (4, False), (5, True)]
    empty = log.limit(0)
    assert A.admission_schedule(empty, 1, 60).count() == A.cooldown_gate(empty, 5).count() == A.rate_window_count(empty, 5).count() == 0


def test_ids_that_come_at_several_instants(spark):
    """Each row comes back once, with the verdict of its own instant."""
    rows = [("k", 7, t) for t in (0, 5, 50, 52, 100, 149)]
    log = spark.createDataFrame(rows, "key string, id bigint, t bigint")
    assert sorted((r.t, r.accepted) for r in A.cooldown_gate(log, 50).collect()) == [
        (0, True), (5, False), (50, True), (52, False), (100, True), (149, False)
    ]


def test_dense_keys_go_by_jumps(spark, monkeypatch):
    monkeypatch.setattr(A, "DENSE_SLICE", 40)
    test_cooldown_gate_is_greedy(spark, 5000, 7)
    monkeypatch.setattr(O, "GROUP_ROWS", 500)
    test_cooldown_gate_is_greedy(spark, 40, 7)


def test_many_instants_of_one_key_in_one_slice(spark, monkeypatch):
    """300,000 instants within fewer than 64 intervals, and no task that holds them all."""
    monkeypatch.setattr(O, "GROUP_ROWS", 10_000)
    log = spark.range(300_000).selectExpr("'hot' as key", "id", "id * 7 + id % 5 as t")
    got = {r.t for r in A.cooldown_gate(log, 50_000).where("accepted").collect()}
    times, want, last = [i * 7 + i % 5 for i in range(300_000)], set(), None
    for t in times:
        if last is None or t - last >= 50_000:
            want.add(t)
            last = t
    assert got == want


def replayed(spark, folder, drops, job):
    """Rows that a stream makes of one drop after another, and its state rows after the last one."""
    schema = "key string, id bigint, t bigint"
    for n, rows in enumerate(drops):
        made = spark.createDataFrame(rows, schema).coalesce(1)
        made.write.mode("append").parquet(f"{folder}/drops")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/drops")
        with SG.keyed_state(spark):
            query = job(stream).writeStream.format("parquet").option("path", f"{folder}/out").option(
                "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return {(r.key, r.id): r for r in spark.read.parquet(f"{folder}/out").collect()}, state


def test_limiter_state_ends(spark, tmp_path):
    minute = 60_000_000
    drops = [
        [("hot", i, minute + i) for i in range(200_000)],
        [("hot", 200_000 + i, 10 * minute + i) for i in range(3)] + [(f"k{i}", 300_000 + i, 10 * minute) for i in range(20)],
        [("last", 400_000, 10_000 * minute)],
    ]
    got, state = replayed(spark, str(tmp_path), drops, lambda s: SG.stream_rate_limiter(s, 1000, minute))
    log = spark.createDataFrame([r for d in drops for r in d], "key string, id bigint, t bigint")
    assert {k: r.admit for k, r in got.items()} == {(r.key, r.id): r.admit for r in A.admission_schedule(log, 1000, minute).collect()}
    # The key of the last drop alone is left: its list and its timer.
    assert max(state) >= 20 and state[-1] <= 4


def test_gate_stream_and_late_runs(spark, tmp_path):
    day = 86_400_000_000
    drops = [
        [("a", 1, day), ("a", 2, day + 5), ("b", 3, day)],
        [("a", 4, 2 * day), ("a", 5, 2 * day - 1), ("b", 6, day + day // 2)],
        # Both are behind what was accepted; the delay lets them through.
        [("a", 7, 2 * day - 2), ("b", 8, 2 * day + 3)],
        [("z", 9, 50 * day)],
    ]
    got, state = replayed(spark, str(tmp_path), drops, lambda s: SG.stream_cooldown_gate(s, day, delay="2 days"))
    assert {r.id for r in got.values() if r.accepted} == {1, 3, 4, 8, 9} and len(got) == 9
    assert state[-1] <= 4


def test_long_runs_are_joined(spark, monkeypatch):
    monkeypatch.setattr(A, "RUN_LENGTH", 5)
    test_admission_equals_a_queue(spark, 2000)


@pytest.mark.parametrize("span", [100, 20_000])
def test_window_counts(spark, span):
    rows = log_rows(span, 2000, span)
    want = {}
    for _, events in by_key(rows):
        for t, i in events:
            want[i] = sum(1 for u, _ in events if t - 60 < u <= t)
    log = spark.createDataFrame(rows, "key string, id bigint, t bigint")
    assert {r.id: r.in_window for r in A.rate_window_count(log, 60).collect()} == want


@pytest.mark.parametrize(("span", "interval"), [(40, 7), (5000, 7), (5000, 3), (100_000, 11), (3000, 1)])
def test_cooldown_gate_is_greedy(spark, span, interval):
    rows = log_rows(span + interval, 4000, span)
    want = set()
    for _, events in by_key(rows):
        last = None
        for t, i in events:
            if last is None or t - last >= interval:
                want.add(i)
                last = t
    log = spark.createDataFrame(rows, "key string, id bigint, t bigint")
    got = A.cooldown_gate(log, interval).collect()
    assert len(got) == len(rows) and {r.id for r in got if r.accepted} == want


def test_cooldown_tables_by_levels(spark, monkeypatch):
    monkeypatch.setattr(A, "TABLES_PER_BLOCK", 2)
    monkeypatch.setattr(A, "INTERVALS_PER_SLICE", 3)
    test_cooldown_gate_is_greedy(spark, 5000, 7)
    test_cooldown_gate_is_greedy(spark, 100_000, 11)


def test_bursts_of_one_key(spark, monkeypatch):
    """300,000 requests of one key inside one window, and a null key and time."""
    monkeypatch.setattr(O, "GROUP_ROWS", 10_000)
    burst = spark.range(300_000).selectExpr("'hot' as key", "id", "id div 2 as t")
    odd = spark.createDataFrame([(None, -1, 5), (None, -2, 5), ("hot", -3, None)], "key string, id bigint, t bigint")
    got = A.rate_window_count(burst.unionByName(odd), 1_000_000)
    wrong = F.when(F.col("id") >= 0, ~F.col("in_window").eqNullSafe(2 * F.col("t") + 2)).otherwise(
        ~F.col("in_window").eqNullSafe(F.when(F.col("key").isNull(), 2))
    )
    assert got.count() == 300_003 and got.filter(wrong).count() == 0
    sent = A.admission_schedule(burst, 1000, 1_000_000)
    late = F.col("admit") != F.floor(F.col("id") / 1000) * 1_000_000 + F.floor(F.pmod("id", F.lit(1000)) / 2)
    assert sent.filter(late).count() == 0


def test_positions_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(O, "GROUP_ROWS", 100)
    rng = random.Random(5)
    rows = [("mono" if i % 3 else f"p{i % 7}", f"d{rng.randint(0, 9)}/f{i}.c") for i in range(3000)]
    df = spark.createDataFrame(rows, "project string, path string")
    got = with_positions(df, [path_order(F.col("path"))], ["project"]).collect()
    want = {}
    for project in {r[0] for r in rows}:
        paths = sorted((p for q, p in rows if q == project), key=lambda p: p.split("/"))
        want |= {(project, p): n for n, p in enumerate(paths)}
    assert {(r.project, r.path): r.pos for r in got} == want


def analysis_rows(spark, count):
    return spark.createDataFrame(
        [("p\"q" if i % 4 else "small", f"f{i:05d}.c", [f"h{i}"], [], "") for i in range(count)],
        "project string, path string, headers array<string>, "
        "classes array<struct<name:string,public_methods:array<string>>>, parse_error string",
    )


def test_documents_hold_all_files_in_order(spark, tmp_path):
    snapshot = N.project_snapshot(analysis_rows(spark, 1600), files_per_part=120)
    assert Counter(r.project for r in snapshot.collect()) == {"p\"q": 10, "small": 4}
    for row in N.project_documents(snapshot).collect():
        document = json.loads(row.document)
        paths = [f["path"] for f in document["files"]]
        assert document["root"] == row.project and paths == sorted(paths)
        assert len(paths) == row.files == (400 if row.project == "small" else 1200)
    K.write_snapshot(snapshot, str(tmp_path / "documents"))
    places = D.load_analysis_doc(spark, str(tmp_path / "documents")).collect()
    for project in ("p\"q", "small"):
        own = sorted((r.pos, r.path) for r in places if r.project == project)
        assert [p for p, _ in own] == list(range(len(own))) and [f for _, f in own] == sorted(f for _, f in own)


def context_reader():
    def review(request):
        whole, text = "".join(V.request_parts(request)), str(request["context"])
        start, rest = whole.split(text) if text else (whole, "")
        files = json.loads(text)["files"] if text else []
        own = any(f["path"] == request["path"] for f in files)
        return f"{len(files)} {own} {start == V.REQUEST_START} {rest.startswith(chr(10) * 2 + '## Path')}"

    return review


def test_reviewers_see_whole_projects(spark):
    """1,200 files of one project, 400 of another, one without a document and one without a project."""
    rows = analysis_rows(spark, 1600)
    more = spark.createDataFrame([("none", "x.c"), (None, "y.c")], "project string, path string")
    pending = rows.unionByName(more, allowMissingColumns=True).withColumn("text", F.lit("int a;"))
    pending = V.build_request(pending.withColumn("headers", F.coalesce("headers", F.array().cast("array<string>"))).withColumn(
        "classes", F.coalesce("classes", F.array().cast(CLASSES))
    )).select("project", "path", "request", F.array().cast("array<string>").alias("rule_based_issues"), F.lit(2**60 + 1).alias("big"))
    snapshot = N.project_snapshot(rows, files_per_part=120)
    got = V.review_files(pending, context_reader, ["project", "path", "big"], snapshot=snapshot).collect()
    assert len(got) == 1602 and {r.big for r in got} == {2**60 + 1}
    want = {"p\"q": "1200 True True True", "small": "400 True True True"}
    assert {(r.project, r.ai_analysis) for r in got if r.project in want} == set(want.items())
    assert {r.ai_analysis for r in got if r.project not in want} == {"0 False False False"}


def requests(spark, count):
    return spark.range(count).select(
        F.concat(F.lit("f"), "id").alias("path"),
        F.lit("").alias("request"),
        F.array().cast("array<string>").alias("rule_based_issues"),
    )


@pytest.mark.parametrize(("limit", "tasks"), [(15, 3), (7, 3), (2, 5), (1, 4)])
def test_quota_holds_over_all_tasks(spark, limit, tasks):
    sent = V.review_files(
        requests(spark, 100), V.offline_reviewer, ["path"], per_minute=limit, concurrency=tasks, clock=CountingClock
    ).collect()
    times = sorted(r.last_call for r in sent)
    assert len(times) == 100
    assert max(sum(1 for u in times if t - 60 < u <= t) for t in times) <= limit


def test_every_attempt_takes_a_slot(spark):
    def failing():
        def review(row):
            raise RuntimeError("503")

        return review

    policy = V.RetryPolicy(attempts=2, initial=0.0)
    sent = V.review_files(
        requests(spark, 6), failing, ["path"], retry=policy, per_minute=1, concurrency=1, clock=CountingClock
    ).collect()
    assert all(r.ai_status == "error" and r.attempts == 2 for r in sent)
    assert max(r.last_call for r in sent) == 60.0 * 11


def test_calls_go_out_by_schedule(spark):
    """Twelve calls, four a window of 0.3 s; those that fail come again behind the first wave."""

    def failing():
        def review(row):
            if row["path"] in ("f3", "f7") and time.time() < float(row["rule_based_issues"][0]):
                raise RuntimeError("503 try again later")
            return "ok"

        return review

    start = int((time.time() + 8) * 1e6)
    rows = requests(spark, 12).withColumn("rule_based_issues", F.array(F.lit(str(start / 1e6 + 0.9))))
    policy = V.RetryPolicy(attempts=2, initial=0.1)
    got = {r.path: r for r in V.review_by_schedule(rows, failing, ["path"], 4, start, policy, 2, 300_000).collect()}
    assert len(got) == 12 and {r.ai_status for r in got.values()} == {"generated"}
    sent = sorted(r.send_at - start for r in got.values() if r.attempts == 1)
    assert sent == [0] * 3 + [300_000] * 4 + [600_000] * 3 or len(sent) == 10
    assert sorted(p for p, r in got.items() if r.attempts == 2) == ["f3", "f7"]
    assert all(r.send_at >= start + 900_000 for r in got.values() if r.attempts == 2)


def source_rows(spark, *files):
    return spark.createDataFrame(
        [(p, f, t, "", None) for p, f, t in files],
        "project string, path string, text string, parse_error string, mtime timestamp",
    )


def results_of(df):
    return {(r.project, r.path): (r.ai_status, r.ai_analysis) for r in df.collect()}


def test_runs_reuse_cool_down_and_repeat(spark, tmp_path):
    folder, options = str(tmp_path / "reviews"), B.ReviewOptions(per_minute=0)
    first = source_rows(spark, ("p", "a.c", "new x"), ("p", "b.c", "int b;"), ("q", "c.c", "int c;"))
    one = results_of(B.review_run(first, folder, "r1", 1000.0, options))
    assert {v[0] for v in one.values()} == {"generated"} and "- Possible memory leak" in one["p", "a.c"][1]
    again = results_of(B.review_run(first, folder, "r1", 1000.0, options))
    assert again == one

    second = source_rows(spark, ("p", "a.c", "new x"), ("p", "b.c", "int b2;"), ("q", "c.c", "int c;"), ("r", "d.c", ""))
    two = results_of(B.review_run(second, folder, "r2", 1030.0, options))
    assert two["p", "a.c"] == ("cached", one["p", "a.c"][1])
    assert two["p", "b.c"][0] == "skipped" and "about 90 seconds" in two["p", "b.c"][1]
    assert two["r", "d.c"][0] == "generated"

    manifest = second.select("project", "path").unionByName(
        spark.createDataFrame([("p", "gone.c")], "project string, path string")
    )
    three = results_of(B.review_run(second, folder, "r3", 1200.0, options, manifest))
    assert three["p", "b.c"][0] == "generated" and three["p", "gone.c"] == ("error", "[ERROR]\nFile not found on disk.")
    runs = {(r.run_id, r.project): r.stats.asDict() for r in K.read_runs(spark, folder).collect()}
    assert runs["r3", "p"] == {"generated": 1, "cached": 1, "skipped": 0, "errors": 1}


def test_changed_bytes_are_reviewed_and_unreadable_files_are_errors(spark, tmp_path):
    folder, options = str(tmp_path), B.ReviewOptions(min_run_interval=0.0, per_minute=0)

    def files(content):
        rows = spark.createDataFrame([("p", "a.c", content, 1.0), ("p", "gone.c", None, 1.0)], "project string, path string, content binary, mtime double")
        return read_text(rows).select("project", "path", "text", "parse_error", F.timestamp_seconds("mtime").alias("mtime"))

    def status(content, run, now):
        return {r.path: (r.ai_status, r.rule_based_issues) for r in B.review_run(files(content), folder, run, now, options).collect()}

    assert status(b"\xff", "r1", 1000.0) == {"a.c": ("generated", []), "gone.c": ("error", [])}
    assert status(b"\xff", "r2", 2000.0)["a.c"][0] == "cached"
    changed = status(b"\xfe new X;", "r3", 3000.0)
    assert changed["a.c"][0] == "generated" and len(changed["a.c"][1]) == 1 and changed["gone.c"][0] == "error"


def test_waiting_files_come_again_in_a_stream(spark, tmp_path):
    """The second file comes within the cooldown and is reviewed with the third batch."""
    drops, folder, seen = str(tmp_path / "drops"), str(tmp_path / "out"), []
    schema = "project string, path string, text string, parse_error string, mtime timestamp"
    clock = iter([1000.0, 1060.0, 1200.0])
    for name in ("a.c", "b.c", "a.c"):
        rows = spark.createDataFrame([("p", name, f"#include <{name}>\n", "", None)], schema)
        rows.write.mode("append").parquet(drops)
        stream = spark.readStream.schema(schema).parquet(drops)
        options = B.ReviewOptions(factory=context_reader, per_minute=0)
        SI.stream_incremental_review(stream, folder, str(tmp_path / "state"), options, lambda: next(clock)).awaitTermination()
        last = f"batch-{len(seen):010d}"
        stored = K.read_review_snapshot(spark, folder).filter(F.col("run_id") == last)
        seen.append({r.path: (r.ai_status, r.ai_analysis) for r in stored.collect()})
    assert [{p: status for p, (status, _) in batch.items()} for batch in seen] == [
        {"a.c": "generated"}, {"b.c": "skipped"}, {"a.c": "cached", "b.c": "generated"}
    ]
    assert seen[2]["b.c"][1].startswith("2 True")


def test_steps_leave_no_tables(spark, tmp_path):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p.name for p in shared.glob("stage-*")}
    done = B.review_run(source_rows(spark, ("p", "a.c", "int x;")), str(tmp_path), "one", 1000.0, B.ReviewOptions(per_minute=0))
    assert done.count() == 1 and {p.name for p in shared.glob("stage-*")} == before


def test_no_run_start_without_a_reviewer(spark, tmp_path):
    def none():
        raise RuntimeError("no key")

    folder = str(tmp_path / "reviews")
    files = source_rows(spark, ("p", "a.c", "int a;"))
    got = results_of(B.review_run(files, folder, "r1", 1000.0, B.ReviewOptions(factory=none)))
    assert got["p", "a.c"] == ("error", "[ERROR]\nAI analysis unavailable.\n\nReason: no key")
    assert K.load_run_state(spark, f"{folder}/state").count() == 0


def test_unfinished_runs_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "reviews")
    files = source_rows(spark, ("p", "a.c", "int a;"))
    B.review_run(files, folder, "r1", 1000.0, B.ReviewOptions(per_minute=0))
    rows = spark.read.parquet(f"{folder}/results/run_id=r1")
    rows.write.parquet(f"{folder}/results/run_id=r2")
    assert {r.run_id for r in K.read_review_snapshot(spark, folder).collect()} == {"r1"}
    assert K.read_review_snapshot(spark, str(tmp_path / "none")).count() == 0


def test_tree_walk(spark, tmp_path):
    texts = {
        "a.cpp": "x", "_deps/b.h": "y", ".hidden/c.cc": "z", "empty.c": "", "build/d.c": "no",
        "s/build/e.c": "no", "s/t/f.hxx": "w", "s/g.HPP": "no", "s/.c": "no", "venv.c": "v",
    }
    root = tmp_path / "build"
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    got = {r.relative_path: bytes(r.content).decode() for r in FS.scan_code_files(spark, str(root)).collect()}
    assert got == {k: v for k, v in texts.items() if v != "no"}
    files = B.scan_project(spark, str(root), "p")
    assert {(r.path.rsplit("/", 1)[-1], r.text) for r in files.collect()} >= {("empty.c", ""), ("a.cpp", "x")}
    assert FS.scan_single_file(spark, str(root / "s/g.HPP")).count() == 0
    assert FS.scan_single_file(spark, str(root / "a.cpp")).count() == 1


def test_links_a_file_root_and_folders_that_cannot_be_listed(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    (root / "real").mkdir(parents=True)
    (root / "real/a.cpp").write_text("a")
    (tmp_path / "other").mkdir()
    (tmp_path / "other/far.cpp").write_text("far")
    (tmp_path / "one.h").write_text("one")
    (root / "folder_link").symlink_to(tmp_path / "other")
    (root / "circle").symlink_to(root)
    (root / "file_link.c").symlink_to(tmp_path / "one.h")
    (root / "nowhere.c").symlink_to(tmp_path / "gone.c")
    (root / ("x" * 20)).mkdir()
    entries = FS.list_tree(spark, str(root))
    got = {r.relative_path: bytes(r.content).decode() for r in FS.scan_code_files(spark, str(root), entries).collect()}
    assert got == {"real/a.cpp": "a", "file_link.c": "one"}
    warned = FS.traversal_warnings(entries, "p").collect()
    assert [(r.project, r.stage, r.message) for r in warned] == [
        ("p", "traverse", f"Filesystem metadata failed at {root}/nowhere.c: No such file or directory")
    ]
    assert [(r.path.rsplit("/", 1)[-1], r.text) for r in B.scan_project(spark, str(tmp_path / "one.h"), "p").collect()] == [("one.h", "one")]
    with pytest.raises(FileNotFoundError):
        FS.scan_code_files(spark, str(tmp_path / "not there"))
    # Folders without permission are passed over; other trouble is a warning.
    store = FS.fs.LocalFileSystem()

    def refuse(error):
        def scandir(folder):
            raise error

        monkeypatch.setattr(FS.os, "scandir", scandir)

    refuse(PermissionError(13, "Permission denied"))
    assert list(FS._listed(store, "/d")) == []
    refuse(OSError(5, "Input/output error"))
    assert [e[4] for e in FS._listed(store, "/d")] == ["Unable to continue directory traversal after /d: Input/output error"]


def test_documents_laid_out_over_lines(spark, tmp_path):
    files = [{"path": f"f{i}.c", "headers": ["a"], "classes": [{"name": "T", "public_methods": ["void f();"]}], "parse_error": ""} for i in range(3)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/one.json").write_text(json.dumps({"root": "p", "files": files}, indent=2))
    (tmp_path / "d/two.json").write_text(json.dumps({"root": "q", "files": []}, indent=2))
    rows = D.load_analysis_doc(spark, str(tmp_path / "d"), multi_line=True).collect()
    assert [(r.project, r.pos, r.path, r.classes[0].public_methods) for r in rows] == [("p", i, f"f{i}.c", ["void f();"]) for i in range(3)]


def test_reports_out_and_in(spark, tmp_path):
    folder = str(tmp_path / "reviews")
    files = [("p", f"d/f{i}.c", "while(true)" if i % 2 else "int x;") for i in range(40)] + [("q", "z.c", "int z;")]
    B.review_run(source_rows(spark, *files), folder, "r1", 1000.0, B.ReviewOptions(per_minute=0))
    manifest = spark.createDataFrame([(p, f, 100 - i) for i, (p, f, _) in enumerate(files)], "project string, path string, pos long")
    K.write_report(spark, folder, "r1", manifest, str(tmp_path / "report"))
    whole = {}
    for project in ("p", "q"):
        parts = sorted((tmp_path / f"report/project={project}").glob("part-*"))
        whole[project] = json.loads("".join(p.read_text() for p in parts))
    report = whole["p"]
    assert report["root"] == "p" and report["model"] == "offline-rules" and report["generated_at_utc"] == "1970-01-01T00:16:40Z"
    assert report["stats"] == {"generated": 40, "cached": 0, "skipped": 0, "errors": 0}
    assert [r["path"] for r in report["results"]] == [f"d/f{i}.c" for i in reversed(range(40))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/p.json").write_text(json.dumps(report, indent=2))
    documents = D.load_reports(spark, str(tmp_path / "in"))
    strict = D.parse_report_strict(documents).collect()
    assert [(r.pos, r.path, r.model, r.ai_status) for r in strict][:2] == [(0, "d/f39.c", "offline-rules", "generated"), (1, "d/f38.c", "offline-rules", "generated")]
    assert D.load_prev_report(documents).count() == 40


def test_the_last_of_a_keys_values_counts(spark):
    texts = {
        "twice": '{"model":"a","model":"b","results":[{"path":"x","path":"y","ai_analysis":"t"}]}',
        "results": '{"results":5,"results":[]}', "model": '{"model":1}', "none": '{"model":"m"}',
    }
    rows = spark.createDataFrame(list(texts.items()), "name string, document string")
    errors = {r.name: r.report_error for r in D.check_report(rows).collect()}
    assert errors == {"twice": "", "results": "", "model": D.BROKEN_REPORT, "none": D.NO_RESULTS}
    strict = [(r.name, r.model, r.path) for r in D.parse_report_strict(rows).collect()]
    assert strict == [("twice", "b", "y")] and [r.path for r in D.load_prev_report(rows).collect()] == ["y"]
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_the_package_is_shipped(tmp_path):
    """A session elsewhere, without the repository on its path, runs Python tasks of the library."""
    script = f"""
import sys
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", r"{tmp_path}/c").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, r"{Path(__file__).resolve().parents[1]}")
from corpuslens.ship import ship
from corpuslens.operators.review import offline_reviewer, review_files
ship(spark)
rows = spark.range(3).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("").alias("request"), F.array().cast("array<string>").alias("rule_based_issues"))
print("REVIEWED", review_files(rows, offline_reviewer, ["path"], concurrency=1).where("ai_status = 'generated'").count())
"""
    (tmp_path / "job.py").write_text(script)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "job.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "REVIEWED 3" in done.stdout, done.stderr[-2000:]


def test_trees_as_a_data_source(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in {"a.cpp": "x", ".hidden/c.cc": "z", "empty.c": "", "build/d.c": "no", "s/t/f.hxx": "w", "s/.c": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "many").mkdir()
    for i in range(2100):
        (root / f"many/f{i}.c").write_text(str(i))
    (root / "circle").symlink_to(root)
    (root / "nowhere.c").symlink_to(tmp_path / "gone.c")
    spark.dataSource.register(ST.SourceTree)
    rows = spark.read.format("source_tree").load(str(root))
    # The large folder is three pieces, and each of the other four one.
    assert rows.rdd.getNumPartitions() == 3 + 4
    got = {r.relative_path: (bytes(r.content).decode(), r.length) for r in rows.where("content is not null").collect()}
    plain = {r.relative_path: (bytes(r.content).decode(), r.length) for r in FS.scan_code_files(spark, str(root)).collect()}
    assert got == plain and len(got) == 2104 and got["a.cpp"] == ("x", 1)
    assert [r.warning for r in rows.where("warning <> ''").collect()] == [f"Filesystem metadata failed at {root}/nowhere.c: No such file or directory"]
    assert [(r.relative_path, bytes(r.content)) for r in spark.read.format("source_tree").load(str(root / "a.cpp")).collect()] == [("a.cpp", b"x")]
    assert spark.read.format("source_tree").load(str(root / "s/.c")).count() == 0

    def batch():
        stream = spark.readStream.format("source_tree").option("settle", "0").load(str(root))
        stream.where("content is not null").select("relative_path", F.col("content").cast("string")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return Counter(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = batch()
    assert len(first) == 2104 and set(first.values()) == {1}
    time.sleep(0.1)
    (root / "a.cpp").write_text("changed")
    (root / "s/new.h").write_text("new")
    assert batch() - first == Counter({("a.cpp", "changed"): 1, ("s/new.h", "new"): 1})


def test_saved_starts_come_with_the_last_of_their_project(spark, tmp_path):
    from checks.queries import QUERIES

    instants = [("a", 0, 10), ("a", 1, 30), ("a", 2, 20), ("b", 3, 5), (None, 4, 7), ("c", 5, None)]
    rows = spark.createDataFrame(instants, "user_id string, event_id long, at long")
    rows.select("user_id", "event_id", F.timestamp_seconds("at").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["save_run_state"](spark, str(tmp_path)).collect()
    key = lambda row: tuple(str(value) for value in row)
    assert sorted(map(tuple, found), key=key) == sorted(
        [("a", 0, 10, 30), ("a", 1, 30, 30), ("a", 2, 20, 30), ("b", 0, 5, 5), (None, 1, 7, 7), ("c", 2, None, None)], key=key
    )


def test_pieces_put_together_are_the_whole_document(spark):
    snapshot = materialised(N.project_snapshot(analysis_rows(spark, 1600), files_per_part=120))
    pieces = N.document_pieces(snapshot).orderBy("project", "part").collect()
    assert {(p.project, p.project_files) for p in pieces} == {("p\"q", 1200), ("small", 400)}
    for whole in N.project_documents(snapshot).collect():
        assert "".join(p.document for p in pieces if p.project == whole.project) == whole.document


def test_rows_of_one_piece_are_dealt_over_all_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    many = spark.read.parquet(str(tmp_path / "one"), *[str(tmp_path / "one")] * 20)
    sizes = FS.spread(many).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 16 and max(r["count"] for r in sizes) < 2 * min(r["count"] for r in sizes)


def test_small_folders_share_tasks_and_large_ones_few_listings(spark, tmp_path, monkeypatch):
    for i in range(400):
        (tmp_path / f"tree/p{i}").mkdir(parents=True)
        (tmp_path / f"tree/p{i}/a.c").write_text(str(i))
    (tmp_path / "tree/many").mkdir()
    for i in range(300):
        (tmp_path / f"tree/many/f{i}.c").write_text(str(i))
    monkeypatch.setattr(ST, "PER_PIECE", 2)
    monkeypatch.setattr(ST, "MOST_SLOTS", 10)
    tree = ST._Tree(str(tmp_path / "tree"))
    tasks = tree.pieces()
    pieces = [piece for task in tasks for piece in task.pieces]
    assert len(tasks) <= ST.MOST_TASKS and len(pieces) == 410
    looked = []
    monkeypatch.setattr(FS, "_local_entry", lambda e, look=FS._local_entry: looked.append(e.path) or look(e))
    rows = [row for task in tasks for row in tree.all_rows(task)]
    assert sorted(row[1] for row in rows) == sorted([f"p{i}/a.c" for i in range(400)] + [f"many/f{i}.c" for i in range(300)])
    # Each file is looked at once, however often its folder is listed.
    assert max(Counter(looked).values()) == 1


def test_many_small_projects_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(400).select(
        F.concat(F.lit("p"), F.col("id") % 100).alias("project"), F.col("id").cast("string").alias("path"),
        F.array(F.lit("h")).alias("headers"), F.array().cast(CLASSES).alias("classes"), F.lit("").alias("parse_error"),
    )
    K.write_analysis_json(rows, str(tmp_path / "out"))
    writers = {p.name.split("-")[1] for p in (tmp_path / "out").glob("project=*/part-*")}
    assert len(writers) >= 4
    assert spark.read.text(str(tmp_path / "out")).count() == 400


def test_many_small_documents_are_written_by_many_tasks_without_folders(spark, tmp_path):
    rows = spark.range(800).select(
        F.concat(F.lit("p"), F.col("id") % 400).alias("project"), F.format_string("%04d", "id").alias("path"),
        F.array(F.lit("h")).alias("headers"), F.array().cast(CLASSES).alias("classes"), F.lit("").alias("parse_error"),
    )
    whole = N.project_documents(N.project_snapshot(rows)).select(F.replace("document", F.lit(","), F.lit(",\n")).alias("value"))
    K.write_documents(whole, str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    assert len(files) == 400 and not [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    assert len({p.name.split("-")[1] for p in files}) >= 4
    assert all(len(json.loads(p.read_text())["files"]) == 2 for p in files)
    back = D.load_analysis_doc(spark, str(tmp_path / "out"), multi_line=True).collect()
    assert sorted((r.project, r.pos, r.path) for r in back) == sorted(
        (f"p{i % 400}", i // 400, f"{i:04d}") for i in range(800)
    )


def test_a_local_reviewer_has_only_pending_files_parsed(spark, tmp_path, monkeypatch):
    parsed, folder, options = [], str(tmp_path / "reviews"), B.ReviewOptions(per_minute=0, min_run_interval=0.0)
    monkeypatch.setattr(B, "analyze", lambda files: parsed.append(files.count()) or N.analyze(files))
    first = source_rows(spark, ("p", "a.c", "int a;"), ("p", "b.c", "int b;"), ("q", "c.c", "int c;"))
    B.review_run(first, folder, "r1", 1000.0, options)
    second = source_rows(spark, ("p", "a.c", "int a;"), ("p", "b.c", "new b;"), ("q", "c.c", "int c;"))
    two = results_of(B.review_run(second, folder, "r2", 2000.0, options))
    assert parsed == [3, 1] and {k: v[0] for k, v in two.items()} == {
        ("p", "a.c"): "cached", ("p", "b.c"): "generated", ("q", "c.c"): "cached"
    }
    # A reviewer that gets documents sees the structure of all files.
    B.review_run(second, folder, "r3", 3000.0, B.ReviewOptions(factory=context_reader, per_minute=0))
    assert parsed == [3, 1, 3]


def test_a_batch_of_one_file_is_dealt_over_all_cores(spark, tmp_path, monkeypatch):
    drops, pieces = str(tmp_path / "drops"), []
    run = lambda rows, *rest, **named: pieces.append(len(rows.inputFiles())) or B.review_run(rows, *rest, **named)
    monkeypatch.setattr(SI, "review_run", run)
    rows = source_rows(spark, *[("p", f"{i}.c", f"int x{i};") for i in range(64)]).coalesce(1)
    rows.write.parquet(drops)
    stream = spark.readStream.schema(rows.schema).parquet(drops)
    out = str(tmp_path / "out")
    SI.stream_incremental_review(stream, out, str(tmp_path / "state"), B.ReviewOptions(per_minute=0)).awaitTermination()
    assert pieces[0] >= 8 and K.read_review_snapshot(spark, out).count() == 64


def test_line_ends_and_includes_of_texts_with_and_without_code(spark):
    texts = ["a\r\r\nb\r", "\r\n\r", "", None, "struct only", "class A {", "x\n # include <y>\nstruct B { int f(); };"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = {r.i: r for r in parse.with_structure(rows.withColumn("plain", universal_newlines(F.col("text")))).collect()}
    assert [found[i].plain for i in range(4)] == ["a\n\nb\n", "\n\n", "", None]
    assert [found[i].headers for i in (2, 3, 4, 6)] == [[], None, [], ["y"]]
    assert [[c.name for c in found[i].classes] for i in (2, 4, 5, 6)] == [[], [], [], ["B"]]


def test_texts_of_a_tree_are_kept_once(spark, tmp_path, monkeypatch):
    """Beside the whole tree, the query on one file stores names alone."""
    from checks import queries

    source, root, kept = tmp_path / "in", str(tmp_path / "tree"), []
    for name, columns, rows in (
        ("part", "p_partkey long", [(k,) for k in range(40)]),
        ("documents", "doc_id long, text string", [(k, f"a text {k} " * 50) for k in range(30)]),
        ("pages", "page_id long, html string", [(k, f"<p>{k}</p>") for k in range(20)]),
    ):
        spark.createDataFrame(rows, columns).write.parquet(str(source / f"{name}.parquet"))
    monkeypatch.setattr(queries, "scratch", lambda spark, name: root)
    monkeypatch.setattr(queries, "materialised", lambda rows: kept.append(rows.columns) or materialised(rows))
    found = queries.QUERIES["scan_single_file"](spark, str(source)).collect()
    assert kept == [["path", "relative_path"]]
    files = {r.path: r.text for r in queries.source_files(spark, str(source)).collect()}
    assert len(files) == 90
    on_disk = {str(p.relative_to(root)): p.read_bytes() for p in Path(root).rglob("*") if p.is_file()}
    assert on_disk == {path: text.encode() for path, text in files.items()}
    assert [r.path for r in found] == [min(p for p in files if p.endswith((".cpp", ".hpp", ".h")) and "/build/" not in p and "/venv/" not in p and "/.git/" not in p)]


def old_reader(spark, path):
    """Whole documents by Spark's own reader."""
    rows = spark.read.schema(D.ANALYSIS_DOCUMENT).option("multiLine", True).json(path)
    return rows.select("root", "first", F.posexplode("files").alias("pos", "file")).select(
        "root", (F.coalesce("first", F.lit(0)) + F.col("pos")).alias("pos"), "file.path", F.coalesce("file.headers", F.array().cast("array<string>")),
        F.coalesce("file.classes", F.array().cast(CLASSES)), F.coalesce("file.parse_error", F.lit("")),
    )


ENTRY = '{"path": "a.c", "headers": ["x", null], "classes": [{"name": "T", "public_methods": ["f"]}], "parse_error": null}'
DOCUMENTS = [
    '{"root": "p", "files": [%s, %s, null, {}, {"path": "\\u00e9\\ud83d\\ude00 \\" ]", "more": {"files": [1]}}]}' % (ENTRY, ENTRY),
    '{"files": [%s], "first": 7,\r\n\t"root": null, "other": [1.5e3, true]}' % ENTRY,
    '{"first": null, "root": "q", "files": [%s, {"path": "b", "path": "c", "classes": [null, {}]}]}' % ENTRY, '{"files": [%s]}' % ENTRY, '{"root": "r", "other": 1.50, "files": [{"x": {"y": []}}]}',
    "{}", '{"root": "p", "files": null}', '{"root": "p", "files": []}', "", "  ", "null", "5", '"files"', "[]",
    '{"root": "p", "files": [%s' % ENTRY, '{"root": "p", "files": [%s]' % ENTRY, '{"root": "p", "files": [%s]} x' % ENTRY, '{"root": "p", "files": [%s]}{"files": [%s]}' % (ENTRY, ENTRY),
    '{"root": "p", "files": [%s], "files": [%s, %s]}' % (ENTRY, ENTRY, ENTRY), '{"root": "p", "root": "q", "files": [%s]}' % ENTRY, '{"root": "p", "files": [%s,]}' % ENTRY,
    '{"root": "p", "files": [5, %s, [], "x", %s]}' % (ENTRY, ENTRY), '{"root": "p", "files": 5}', '{"root": "p", "files": {"path": "a"}}', "{'root': 'p', 'files': [{'path': 'a'}]}",
    '[{"root": "p", "files": [%s]}, {"root": "q", "files": [%s]}]' % (ENTRY, ENTRY), '{"root": "a\nb", "files": [%s]}' % ENTRY, '{"root": "\\x", "files": [%s]}' % ENTRY, '{root: "p", "files": [%s]}' % ENTRY,
    '{"root": 5.50, "files": [%s]}' % ENTRY, '{"first": "x", "files": [%s]}' % ENTRY, '{"first": 9223372036854775808, "files": [%s]}' % ENTRY, '{"root": {"a": [1]}, "files": [%s]}' % ENTRY,
    '{"files": [%s, {"path": 5.50}, {"headers": 5}, {"classes": [{"name": 1.0}]}, {"headers": [1, {"a": 2}]}, {"parse_error": true}]}' % ENTRY, '{"other": NaN, "files": [%s]}' % ENTRY,
    '{"Root": "p", "FILES": [%s], "files": [%s]}' % (ENTRY, ENTRY), '\ufeff{"root": "p", "files": [%s]}' % ENTRY, '{"root": "p", "files": [%s], "deep": %s1%s}' % (ENTRY, "[" * 5000, "]" * 5000),
]


def test_documents_in_pieces_are_read_as_whole_ones_are(spark, tmp_path, monkeypatch):
    folder = tmp_path / "a [b] {c}"
    folder.mkdir()
    for i, text in enumerate(DOCUMENTS):
        (folder / f"d{i:02d}.json").write_bytes(text.encode())
    (folder / "utf16.json").write_bytes(DOCUMENTS[0].encode("utf-16"))
    (folder / "bytes.json").write_bytes(b'{"root": "\xff", "files": [{}]}')
    (folder / "_hidden.json").write_text('{"root": "hidden", "files": [{}]}')
    (tmp_path / "copy").mkdir()
    for file in folder.iterdir():
        (tmp_path / "copy" / file.name).write_bytes(file.read_bytes())
    want = sorted(map(str, map(tuple, old_reader(spark, str(tmp_path / "copy")).collect())))
    assert len(want) > 20
    for chunk, files in ((1 << 20, 500), (7, 2)):
        monkeypatch.setattr(JP, "CHUNK", chunk)
        monkeypatch.setattr(JP, "FILES_PER_PIECE", files)
        got = sorted(map(str, map(tuple, D.load_analysis_doc(spark, str(tmp_path / "copy"), multi_line=True).collect())))
        assert got == want
    # By hand as well, with every text told plain or not.
    kinds = []
    for text in DOCUMENTS:
        try:
            head = JP.head_of(io.BytesIO(text.encode()))
            entries = [e for base, piece in JP.pieces_of(io.BytesIO(text.encode()), head) for e in json.loads(piece)["files"]]
            assert entries == (json.loads(text).get("files") or [])
            kinds.append("plain")
        except (ValueError, RecursionError):
            kinds.append("odd")
    assert kinds[:8] == ["plain"] * 8 and set(kinds[8:35]) == {"odd"}


def test_large_documents_are_written_and_read_in_pieces(spark, tmp_path, monkeypatch):
    from checks import queries

    rows = analysis_rows(spark, 1600).unionByName(analysis_rows(spark, 3).withColumn("project", F.concat(F.lit('"files" : [ ]'), "path")))
    snapshot = materialised(N.project_snapshot(rows, files_per_part=120))
    whole = {r.project: r.document for r in N.project_documents(snapshot).collect()}
    laid = spark.createDataFrame(list(whole.items()), "project string, document string").select(
        "project", F.to_json(F.from_json("document", D.ANALYSIS_DOCUMENT), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")
    )
    pieces = queries.laid_out(N.project_documents(snapshot, whole=False))
    assert pieces.count() == 10 + 4 + 3
    K.write_documents(pieces, str(tmp_path / "out"), "project")
    assert not [p for p in (tmp_path / "out").iterdir() if p.is_dir() or p.name.startswith("_")]
    assert sorted(p.read_text() for p in (tmp_path / "out").iterdir() if p.suffix == ".json") == sorted(r.value for r in laid.collect())
    with pytest.raises(FileExistsError):
        K.write_documents(pieces, str(tmp_path / "out"), "project")
    seen = []
    monkeypatch.setattr(D, "in_pieces", lambda files: (lambda found: seen.append((found[0].count(), found[1])) or found)(JP.in_pieces(files)))
    back = D.load_analysis_doc(spark, str(tmp_path / "out"), multi_line=True)
    want = old_reader(spark, str(tmp_path / "out"))
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert seen == [(3 + 1 + 3, [])]
