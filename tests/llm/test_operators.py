"""The training-data operators against brute force, round trips and awkward tables."""

import hashlib
import io
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import TABLES, same_rows
from corpuslens.llm import (
    block_names, centroid_clusters, chat, common, decontaminate, hard_negatives, line_dedup, packing, quality, secrets, simhash, token_counts, tokens, url_filter, warc,
)
from corpuslens.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
GAPS = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, last long, grp string"


def docs_of(spark, texts, lang="en", source="s"):
    """Rows with more columns than are needed, of names that operators use inside."""
    rows = [(i, t, lang, source, 0, "k", "f", 1, "g") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


AWKWARD = [(0, None), (1, ""), (2, "\n\n"), (3, "é" * 30), (4, "word"), (5, "A b\tc\x0bd\r\n e"), (6, "x " * 60000), (None, "no id here at all, no id"), (7, "same row"), (7, "same row"), (8, "one two three four five six seven eight nine ten eleven")]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, db, name):
    assert same_rows(QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df())


@pytest.mark.parametrize(
    "run",
    [line_dedup.dedup_lines, quality.quality, quality.keep_good, secrets.find_secrets, simhash.near_duplicates,
     simhash.keep_one, packing.pack, token_counts.count_tokens],
)
def test_awkward_and_empty_tables(spark, run):
    docs = docs_of(spark, AWKWARD)
    found = run(docs).collect()
    assert found and run(docs.limit(0)).collect() == []
    if run not in (quality.keep_good, simhash.keep_one, packing.pack):
        assert len(found) == len(AWKWARD)


# --- line dedup ----------------------------------------------------------------


def test_line_dedup_on_repeats(spark):
    rng = random.Random(1)
    shared = ["A line that many documents share", "  a LINE that many documents share\t", "Another repeated line of text", "short"]
    texts = [(i, "\n".join(rng.choice([*shared, prose(rng, 6), ""]) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(GAPS))
    seen = {}
    for i, t in texts:
        for k in {key(x) for x in t.split("\n")}:
            seen.setdefault(k, set()).add(i)
    want = {}
    for i, t in texts:
        kept = [x for x in t.split("\n") if not (len(key(x)) >= 20 and len(seen[key(x)]) >= 3 and i < max(seen[key(x)]))]
        want[i] = ("\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept))
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == want


def test_runs_hold_every_key_once(spark):
    runs = line_dedup.LineRuns(spark, fan_out=2)
    batches = [[(1, 1, 5), (2, 2, 5)], [(1, 1, 6), (3, 3, 6)], [(1, 1, 7), (4, 4, 9)], [(1, 1, 2)]]
    for batch in batches:
        runs.add(spark.createDataFrame(batch, "h1 long, h2 int, doc long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert sorted(map(tuple, runs.totals().collect())) == [(1, 1, 4, 7), (2, 2, 1, 5), (3, 3, 1, 6), (4, 4, 1, 9)]
    runs.close()


def test_rows_of_one_id_are_one_document(spark):
    line = "a line that is long enough to be counted"
    kept = lambda rows: sorted((str(r.doc_id), r.n_dropped) for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect())
    assert kept([(1, line), (1, line), (2, line)]) == [("1", 0), ("1", 0), ("2", 0)]
    assert kept([(1, line), (1, line + "\n" + line), (2, line), (3, line)]) == [("1", 1), ("1", 2), ("2", 1), ("3", 0)]
    assert kept([(None, line), (None, line), (2, line)]) == [("2", 0), ("None", 0), ("None", 0)]
    assert kept([(None, line), (1, line), (2, line)]) == [("1", 1), ("2", 0), ("None", 1)]


# --- quality -------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(GAPS)]
    fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {g for g in fives if fives.count(g) > 1}
    covered = {i + k for i, g in enumerate(fives) if g in often for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice(["a ", "b ", "c\n", "d\t", "#", "<é> ", "\n", "e f g h i "]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    got = {r.doc_id: r for r in quality.quality(docs_of(spark, texts)).collect()}
    for i, t in texts:
        n = brute_counts(t)
        assert tuple(got[i][c] for c in quality.COUNTS) == n, t
        assert got[i].base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(3)
    clean = [(i, prose(rng, rng.randint(30, 400)) + ".") for i in range(600)]
    odd = [(1000 + i, " ".join(rng.choice(WORDS) + "$%%" for _ in range(200))) for i in range(60)]
    rows = {r.doc_id: r.kept for r in quality.quality(docs_of(spark, clean + odd)).collect()}
    assert sum(not rows[i] for i, _ in clean) <= 3
    assert not any(rows[i] for i, _ in odd)


def test_quality_judges_languages_with_few_rows(spark):
    rng = random.Random(13)
    clean = [(i, prose(rng, rng.randint(30, 400)) + ".") for i in range(300)]
    rare = [(1000 + i, prose(rng, rng.randint(30, 400)) + ".") for i in range(20)]
    odd = [(2000 + i, " ".join(rng.choice(WORDS) + "$%%" for _ in range(200))) for i in range(4)]
    docs = docs_of(spark, clean).union(docs_of(spark, rare[:10] + odd[:2], lang="xx")).union(docs_of(spark, rare[10:] + odd[2:], lang=None))
    rows = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert not any(rows[i] for i, _ in odd)
    assert sum(not rows[i] for i, _ in clean + rare) <= 3
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {i for i, k in rows.items() if k}
    # A small table as a whole is judged by its own rows.
    few = {r.doc_id: r.kept for r in quality.quality(docs_of(spark, rare + odd[:2])).collect()}
    assert not any(few[i] for i, _ in odd[:2]) and sum(not few[i] for i, _ in rare) <= 1


def test_inverse_and_distance(spark):
    rng = np.random.default_rng(4)
    p = len(quality.DIMS)
    a = rng.normal(size=(p, p))
    m = a @ a.T + np.eye(p)
    x = rng.integers(-5000, 5000, p)
    row = spark.createDataFrame([(m.tolist(), x.tolist())], "m array<array<double>>, v array<long>").select(
        quality._inverted(F.col("m")).alias("i"),
        quality._distance(F.col("v"), F.array(*[F.lit(0.0)] * p), quality._inverted(F.col("m"))).alias("d"),
    ).first()
    assert np.allclose(row.i, np.linalg.inv(m))
    assert np.isclose(row.d, (x / 1024) @ np.linalg.inv(m) @ (x / 1024))


def test_estimate_is_the_covariance_of_the_kept_rows(spark):
    rng = np.random.default_rng(5)
    p = len(quality.DIMS)
    v = rng.integers(-3000, 3000, (200, p))
    rows = spark.createDataFrame([("g", r.tolist()) for r in v], "grp string, v array<long>")
    got = quality._estimate(rows.groupBy("grp").agg(*quality._sums())).first()
    want = np.cov((v / 1024).T, bias=True) + np.diag(np.array(list(quality.FLOORS.values())) ** 2)
    assert np.allclose(got.centre, v.mean(0)) and np.allclose(np.linalg.inv(got.inverse), want)


# --- secrets -------------------------------------------------------------------

KINDS = {
    "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def test_secrets_equal_regular_expressions(spark):
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "AKIA", "=", ":", " ", '"', "'", "abc", "0123456789abcdef",
             "deadbeef" * 3, "ABCDEFGH12345678", "é", "x.y", "\n", "ghp_", "AK", "_", "/", "token=token:", "secret:secret=", "AKIAAKIA"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(6000)]
    got = {r.doc_id: r for r in secrets.find_secrets(docs_of(spark, texts).repartition(8)).collect()}
    for i, t in texts:
        spans = sorted((m.start(), n, m.end(), k) for n, (k, (rule, fits)) in enumerate(KINDS.items()) for m in rule.finditer(t) if fits(m))
        said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(x[3] == k for x in spans) for k in KINDS]
        assert set(said.split(",")) - {""} <= set(got[i].spans.split(","))


# --- archives ------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(6)
    bodies = ["", "<p>é</p>", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n", *[prose(rng, 50) for _ in range(10)]]
    rows = [(i, f"http://a.b/{i}\r\nX: é", rng.choice(bodies)) for i in range(200)] + [(500, None, None), (None, "http://n", "only"), (700, "http://r", "twice"), (700, "http://r", "twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("own")).repartition(3)
    for least in (0, 100):
        folder = f"{tmp_path}/{least}"
        archives, members = warc.archive_pages(pages, folder, least)
        got = warc.read_records(archives, members).collect()
        assert len(got) == len(rows)
        largest = {}
        for i, _, h in rows:
            data = (h or "").encode()
            largest[data] = max((x for x in (largest.get(data), i) if x is not None), default=None)
        by_id = {}
        for r in got:
            by_id.setdefault(r.page_id, []).append(r)
        for i, _, h in rows:
            data, r = (h or "").encode(), by_id[i][0]
            first = largest[data]
            again = len(data) >= least and first is not None and i != first
            assert (r.payload_bytes, r.payload_digest) == (len(data), warc.payload_digest(data))
            assert (r.record_type, r.refers_to) == (("revisit", first) if again else ("response", None))
            assert r.payload is None if again else bytes(r.payload) == data
        # Each member stands alone, and together they are the inflated stream.
        name = archives.first().archive
        one = b"".join(warc.inflated(open(f"{folder}/monolithic/{name}", "rb")))
        two = b"".join(warc.inflated(open(f"{members}/{name}", "rb")))
        assert one == two and one.count(b"WARC-Type:") >= 1
    empty, place = warc.archive_pages(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_records(empty, place).collect() == []


# --- decontamination -----------------------------------------------------------


def brute_align(words, item):
    best, h = 0, [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, j in itertools.product(range(1, len(item) + 1), range(1, len(words) + 1)):
        same = 2 if item[i - 1] == words[j - 1] else -1
        h[i][j] = max(0, h[i - 1][j - 1] + same, h[i - 1][j] - 1, h[i][j - 1] - 1)
        best = max(best, h[i][j])
    return best


def test_alignment_equals_the_plain_table():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert decontaminate.align(a, b) == brute_align(a, b)


def test_leaks_found_whole_and_edited(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, 40)) for i in range(30)] + [(90, "Too Few words"), (91, None), (92, "")]
    texts, want = [], set()
    for i in range(200):
        words = prose(rng, 200).split()
        if i % 4 == 0:
            k = rng.randrange(30)
            part = items[k][1].split()
            for _ in range(i % 3 * 2):  # up to four words are put in the place of others
                part[rng.randrange(len(part))] = "edited"
            words[50:50] = " ".join(part).upper().split() if i % 8 else part
            want.add((i, k))
        texts.append((i, " ".join(words)))
    texts += [(500, "so: too few\tWORDS indeed"), (501, items[3][1]), (501, items[3][1])]
    want |= {(500, 90), (501, 3)}
    tests = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts + [(600, None), (601, "")])
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, tests).collect()}
    assert got == want
    kept = {r.doc_id for r in decontaminate.keep_clean(docs, tests).collect()}
    assert kept == {i for i, _ in texts + [(600, None), (601, "")]} - {i for i, _ in want}
    assert decontaminate.leaks(docs, tests.limit(0)).collect() == []


def test_an_edited_copy_is_found_beside_a_verbatim_one(spark):
    item = [f"t{i}" for i in range(40)]
    edited = ["other" if i in (2, 9, 16, 23, 30, 37) else w for i, w in enumerate(item)]
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = docs_of(spark, [(0, " ".join(item)), (1, "so " + " ".join(edited) + " then"), (2, prose(random.Random(11), 90))])
    got = {r.doc_id: r.score for r in decontaminate.leaks(docs, tests).collect()}
    assert got == {0: 1.0, 1: 0.775}


def test_copies_with_an_edit_every_few_words_are_found(spark):
    item = [f"t{i}" for i in range(40)]
    swapped = lambda n: ["other" if i % n == n - 1 else w for i, w in enumerate(item)]
    fed = [x for i, w in enumerate(item) for x in ([w, "other"] if i % 2 else [w])]
    short = "b0 other b1 other b2 other b3 other b4".split()
    tests = spark.createDataFrame([(1, " ".join(item)), (2, "b0 b1 b2 b3 b4")], "item_id long, text string")
    texts = [" ".join(x) for x in (swapped(5), swapped(4), fed, short, swapped(3), swapped(2))]
    docs = docs_of(spark, list(enumerate(f"so {x} then" for x in texts)))
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, tests).collect()}
    assert {k: round(v, 4) for k, v in got.items()} == {(0, 1): 0.7125, (1, 1): 0.6375, (2, 1): 0.7625, (3, 2): 0.6}


@pytest.mark.parametrize(("least", "kinds"), [(0.6, 6), (0.6, 40), (0.6, 400), (0.3, 40), (0.75, 40)])
def test_leaks_miss_no_alignment(spark, least, kinds):
    """Rare seeds and passages find exactly the pairs that aligning everything finds."""
    rng = random.Random(kinds)
    word = lambda: f"w{rng.randrange(kinds)}"
    items = [[word() for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 30, 40)]
    docs = []
    for _ in range(90):
        words = [word() for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            for w in rng.choice(items):
                words += rng.choice([[w], [w], [w], [w], [], ["other"], [w, word()]])
            words += ["gap"] * rng.choice([0, 3, 60])
        docs.append(words)
    tests = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = docs_of(spark, [(i, " ".join(d)) for i, d in enumerate(docs)])
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(rows, tests, least).collect()}
    want = {(d, i): decontaminate.align(a, b) / (2 * len(b)) for d, a in enumerate(docs) for i, b in enumerate(items)}
    assert got == {k: v for k, v in want.items() if v >= least}
    left = decontaminate.leaks(rows, tests, least, min_words=6).collect()
    assert {(r.doc_id, r.item_id) for r in left} == {k for k in got if k[1] >= 5}


# --- packing -------------------------------------------------------------------


def test_packing_is_whole_and_gapless(spark):
    rng = random.Random(9)
    texts = [(i, prose(rng, rng.choice([3, 100, 500, 900, 3000]))) for i in range(150)] + [(900, None), (901, "é 中文 🙂 <|endoftext|>"), (902, "twice"), (902, "twice")]
    rows = packing.pack(docs_of(spark, texts), shard=40).collect()
    own = tokens.encoder(*tokens.default_paths())
    want = []
    for i, t in texts:
        ids = own.exact.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(w[3] for w in want) // 2048) + 6


def test_breeding_never_loses_a_piece_and_beats_best_fit():
    better = 0
    for seed in range(12):
        rng = random.Random(seed)
        lengths = [x for _ in range(12) for x in (lambda a, b: (a, b, 1000 - a - b))(rng.randint(200, 400), rng.randint(200, 400))]
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        plain = packing.best_fit(lengths, order, 1000)
        bred = packing.evolve(lengths, [], 1000, random.Random(seed))
        assert sorted(i for b in bred for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 1000 for b in bred) and len(bred) <= len(plain)
        better += packing.fitness(lengths, bred, 1000) > packing.fitness(lengths, plain, 1000)
    assert better >= 6


def test_quick_ids_equal_the_exact_ones():
    own, rng = tokens.encoder(*tokens.default_paths()), random.Random(10)
    kinds = [chr(c) for c in range(1, 0x250)] + [" ", "\n", "'s", "a"] * 60 + ["中", "🙂", "<|endoftext|>"]
    for _ in range(2000):
        text = "".join(rng.choice(kinds) for _ in range(30))
        assert own.ids(text).tolist() == own.exact.encode(text, add_special_tokens=False).ids


# --- near-duplicates -----------------------------------------------------------


def brute_print(text):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance=4):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= distance:
            root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(values))]


def test_near_duplicates_equal_brute_force(spark):
    rng, texts = random.Random(11), []
    for i in range(300):
        if i and rng.random() < 0.5:
            words = rng.choice(texts)[1].split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append((i, " ".join(words)))
        else:
            texts.append((i, prose(rng, rng.randint(2, 150))))
    prints = [brute_print(t) for _, t in texts]
    roots = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i, _ in texts}
    assert sorted(r.doc_id for r in simhash.keep_one(docs_of(spark, texts)).collect()) == sorted(set(roots))


@pytest.mark.parametrize("crowd", [2048, 5])
@pytest.mark.parametrize(("count", "distance"), [(100, 4), (10**7, 4), (10**10, 4), (10**7, 3)])
def test_links_join_what_brute_force_joins(spark, monkeypatch, crowd, count, distance):
    """Few and crowded table entries, and the segments that small and large tables get."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    plan = simhash.plan_segments(count, distance)
    monkeypatch.setattr(simhash, "plan_segments", lambda *_: plan)
    rng, values = random.Random(12), set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(15):
            value = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                value ^= 1 << b
            values.add(value)
    values = sorted(simhash._signed(v) for v in values)
    rows = spark.createDataFrame([(v,) for v in values], "fp long").repartition(4)
    found = {r.node: r.root for r in common.components(simhash.links(rows, distance)).collect()}
    roots = brute_components([v & (1 << 64) - 1 for v in values], distance)
    assert [found.get(v, v) for v in values] == [values[r] for r in roots]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 1000 for i in range(1000, 1100)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- token counts --------------------------------------------------------------


def test_edits_keep_the_counts(spark):
    own, rng = token_counts.counter(*tokens.default_paths()), random.Random(13)
    quick = tokens.encoder(*tokens.default_paths()).quick
    parts = ["a", "the", " ", "  ", "\n\n", "'s", "'ll", "23", ".", "!!", "é", "\t", "中文", "🙂", " '", "Word"]
    some = lambda n: "".join(rng.choice(parts) for _ in range(n))
    for _ in range(500):
        text = some(rng.choice([0, 3, 300]))
        tree = own.tree(text)
        for _ in range(5):
            at, cut, put = rng.randint(0, len(text)), rng.choice([0, 1, 40]), some(rng.choice([0, 1, 90]))
            want = text[:at] + put + text[at + cut :]
            text, tree, fresh = tree.edit(text, at, cut, put, own)
            assert text == want and tree.total == len(quick.encode_ordinary(text))
            assert tree.piece_chars.tolist() == [len(m.group()) for m in own.split(text)]
            assert tree.piece_tokens.tolist() == [len(quick.encode_ordinary(m.group())) for m in own.split(text)]
            ends = tree.sizes.cumsum().tolist()
            for heap, values in ((tree.chars, tree.piece_chars), (tree.tokens, tree.piece_tokens)):
                assert all(heap[tree.base + i] == values[e - n : e].sum() for i, (e, n) in enumerate(zip(ends, tree.sizes)))
                assert all(heap[k] == heap[2 * k] + heap[2 * k + 1] for k in range(1, tree.base))


def test_edits_as_a_table(spark):
    texts = [(1, prose(random.Random(14), 2000)), (2, ""), (3, None), (4, "left alone")]
    edits = spark.createDataFrame(
        [(1, 1, 50, 3, "new text"), (1, 0, 0, 5, None), (2, 0, 9, 9, "from nothing"), (9, 0, 0, 0, "no such")], "doc_id long, number int, at int, cut int, put string"
    )
    state = token_counts.count_tokens(docs_of(spark, texts))
    rows = {r.doc_id: r for r in token_counts.apply_edits(token_counts.with_edits(state, edits)).collect()}
    start = texts[0][1][5:]
    assert rows[1].text == start[:50] + "new text" + start[53:]
    quick = tokens.encoder(*tokens.default_paths()).quick
    assert all(r.n_tokens == len(quick.encode_ordinary(r.text)) for r in rows.values())
    assert rows[1].n_encoded < 20 and rows[2].text == "from nothing" and rows[4].n_encoded == 0


# --- chat ----------------------------------------------------------------------


def brute_paths(nodes, branches):
    """nodes: {id: (parent, score)}"""
    children = {p for p, _ in nodes.values() if p in nodes}
    found = {}
    for leaf in nodes:
        if leaf in children:
            continue
        path, at = [], leaf
        while at in nodes:
            path.append(at)
            at = nodes[at][0]
        found.setdefault(path[-1], []).append((-sum(nodes[n][1] for n in path), leaf, path[::-1]))
    return {tuple(p) for paths in found.values() for _, _, p in sorted(paths)[:branches]}


def test_paths_equal_brute_force(spark):
    rng, rows, want = random.Random(15), [], set()
    for conv in range(40):
        nodes = {i: (rng.choice([None, i - 1, rng.randrange(i)]) if i else None, float(rng.randint(0, 5))) for i in range(rng.randint(1, 30))}
        rows += [(conv, i, p, s) for i, (p, s) in nodes.items()]
        want |= {(conv, p) for p in brute_paths(nodes, 2)}
    rows += [(99, 1, 2, 0.0), (99, 2, 1, 0.0)]  # a circle
    paths = chat.chosen_paths(spark.createDataFrame(rows, "conv long, node long, parent long, score double"), 2).collect()
    got = {}
    for r in paths:
        got.setdefault((r.conv, r.leaf), []).append((r.depth, r.node))
    assert {(c, tuple(n for _, n in sorted(p))) for (c, _), p in got.items()} == want


def test_hard_texts_come_back(spark):
    hard = ["\\### Assistant: </turn> ok", "### user: x</turn>\n", "\\", "", None, "a:b#c<d", "🙂é\n" * 50, "x\\" * 20000]
    rows = [(i, k, role, hard[(i + k) % len(hard)]) for i in range(8) for k, role in enumerate(["user", "assistant", "sys:tem"])] + [(None, None, None, None), (3, 1, "assistant", "tie")]
    done = chat.read_back(chat.formatted(chat.reply_chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    assert len(done) == 9
    for r in done:
        told = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == r.conv), key=lambda x: (x[0] is not None, *x))
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in told]
        assert r.learned == "".join(x[2] for x in told if x[1] == "assistant")


# --- urls ----------------------------------------------------------------------


def test_rules_hosts_and_paths(spark):
    urls = ["http://A.net/x", "http://example.net/en/1", "https://www.example.net/en", "http://x.example.com/de/?q", "http://y.org/fr/#f",
            "http://net", "no scheme/net/", None, "", "ftp://h?x=http://net/", "a://b://c/d", "http://HÉ.net/", "http://evilnet/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("low", F.lit(9))
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    none = spark.createDataFrame([], "url string, bad int")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, none).orderBy("page_id").collect()]
    assert got == [
        ("a.net", "/x", "net/", "block"), ("example.net", "/en/1", "example.net/en/", "allow"), ("www.example.net", "/en", "net/", "block"),
        ("x.example.com", "/de/", "example.com/de/", "block"), ("y.org", "/fr/", "org/fr/", "allow"), ("net", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"), ("b:", "//c/d", None, "allow"),
        ("hÉ.net", "/", "net/", "block"), ("evilnet", "/", None, "allow"),
    ]
    assert url_filter.judge_urls(pages.limit(0), rules, none).collect() == []


def test_reputation_shrinks_and_blocks(spark):
    rows = [("http://bad.one.com/", 1)] * 60 + [("http://good.one.com/", 0)] * 60 + [("http://mild.two.com/", int(i < 20)) for i in range(60)] + [("http://once.two.com/", 1)]
    outcomes = spark.createDataFrame(rows, "url string, bad int")
    hosts = spark.createDataFrame([("bad.one.com",), ("good.one.com",), ("mild.two.com",), ("once.two.com",), ("new.two.com",)], "host string")
    labels = outcomes.select(url_filter.host_of(F.col("url")).alias("host"), "bad")
    got = {r.host: (r.mean, r.low) for r in url_filter.reputation(labels, hosts).collect()}
    assert got["bad.one.com"][1] > 0.5 > got["once.two.com"][1]
    assert got["good.one.com"][0] < got["new.two.com"][0] < got["once.two.com"][0] < got["bad.one.com"][0]


def test_beta_bounds_hold_their_share():
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0.3, 80, 60), rng.uniform(0.3, 80, 60)
    low = url_filter.beta_low(a, b)
    for x, p, q in zip(low, a, b):
        # Samples below the bound: 5 % of them, but for chance.
        assert abs((rng.beta(p, q, 40_000) < x).mean() - 0.05) < 0.008
    assert np.allclose(url_filter.beta_low(np.array([1.0, 2.0]), np.array([1.0, 1.0]), 0.25), [0.25, 0.5], atol=1e-9)


def test_domains_by_a_table_of_suffixes(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.gov.uk", "gov.uk", "x.github.io", "github.io", "www.one.com", "com", "", "p.q.r.s")], "host string")
    table = spark.createDataFrame([("gov.uk",), ("GitHub.io",), ("uk",), (None,), ("uk",)], "suffix string")
    got = {r.host: (r.suffix, r.domain) for r in url_filter.with_domains(hosts, table).collect()}
    assert got == {
        "a.b.gov.uk": ("gov.uk", "b.gov.uk"), "gov.uk": ("gov.uk", "gov.uk"), "x.github.io": ("github.io", "x.github.io"),
        "github.io": ("github.io", "github.io"), "www.one.com": ("com", "one.com"), "com": ("com", "com"), "": ("", ""), "p.q.r.s": ("s", "r.s"),
    }
    assert {r.suffix for r in url_filter.with_domains(hosts).where("host like '%uk'").collect()} == {"uk"}


# --- the pipeline --------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    rng = random.Random(16)
    boiler = "This very line stands in many documents of the corpus"
    clean = [(i, prose(rng, 150) + "\n" + boiler) for i in range(100)]
    copies = [(100 + i, clean[i][1].replace("w1 ", "w2 ", 1)) for i in range(20)]
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    leaked = [(200, prose(rng, 100) + " " + benchmark + " " + prose(rng, 100))]
    junk = [(300 + i, "spam spam spam spam spam " * 30) for i in range(5)]
    docs, ids = docs_of(spark, clean + copies + leaked + junk), []
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert ids[0] == {i for i, _ in clean + copies + leaked} and ids[1] == ids[0]
    assert {i for i, _ in clean} <= ids[2] and len(ids[2] & {i for i, _ in copies}) < 10
    assert ids[3] == ids[2] - {200} and ids[4] == ids[3]


# --- repairs -------------------------------------------------------------------


@pytest.mark.parametrize("start", ["token=token:", "AKIAAKIAAKIA", "deadbeefdeadbeef", "secret = password: "])
def test_swallowed_keywords_take_linear_time(start):
    """Keywords inside a rule's last match are no starts, and looking for them reads no byte twice."""
    text = start + "a" * 400_000
    began = time.time()
    found = secrets.scan(text.encode(), secrets.scanner((*secrets.BASE, *secrets.MORE)))
    assert time.time() - began < 60
    want = {(m.start(), m.end(), n) for n, (rule, fits) in enumerate(KINDS.values()) for m in rule.finditer(text) if fits(m)}
    assert {x for x in found if x[2] < len(secrets.BASE)} == want


def test_cut_archives_are_errors():
    body = b"".join(warc.record("response", i, "u", b"x" * 50, 50, "D", None) for i in range(2))
    whole = zlib.compressobj(3, zlib.DEFLATED, 31)
    data = whole.compress(body[: len(body) // 2]) + whole.flush(zlib.Z_FULL_FLUSH)
    rest = whole.compress(body[len(body) // 2 :]) + whole.flush()
    assert len(list(warc.records(warc.inflated(io.BytesIO(data + rest))))) == 2
    assert list(warc.inflated(io.BytesIO(b""))) == []
    for cut in (data, data + rest[:-1], data + rest[:-8], (data + rest) * 2 + data):
        with pytest.raises(ValueError, match="ends early"):
            list(warc.inflated(io.BytesIO(cut)))


def test_null_nodes_and_circles_come_back(spark):
    schema = "conv long, node long, parent long, role string, text string, score double, extra int"
    rows = [(1, 1, None, "user", "q", 0.0, 1), (1, 2, 1, "assistant", "a", 0.0, 1), (1, None, 1, "user", "x", 0.0, 1), (1, None, None, "assistant", "y", 0.0, 1),
            (2, 5, 6, "user", "c", 0.0, 1), (2, 6, 5, "user", "d", 0.0, 1), (2, 7, 6, "user", "e", 0.0, 1), (None, None, None, None, None, None, None)]
    messages = spark.createDataFrame(rows, schema)
    got = chat.read_back(chat.formatted(messages)).collect()
    said = sorted((str(r.conv), str(r.leaf), [(t.role, t.text) for t in r.turns], r.learned) for r in got)
    assert said == [
        ("1", "2", [("user", "q"), ("assistant", "a")], "a"), ("1", "None", [("assistant", "y")], "y"),
        ("1", "None", [("user", "x")], ""), ("None", "None", [("", "")], ""),
    ]
    assert sorted(r.node for r in chat.unreached(messages).collect()) == [5, 6, 7]
    assert chat.formatted(messages.limit(0)).count() == chat.unreached(messages.limit(0)).count() == 0


# --- exact dedup ----------------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [1, 3, 64])
def test_equal_texts_share_an_identity(spark, block_bytes):
    rng = random.Random(block_bytes)
    texts = [(i, "".join(rng.choice(["a", "b", "é", "ab" * 9, "😀"]) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 17])))) for i in range(300)]
    texts += [(None, None), (None, ""), (7, texts[7][1]), (999, "x" * 5000), (998, "x" * 5000), (997, "x" * 4999)]
    docs = docs_of(spark, texts).withColumn("kept", F.lit(5)).withColumn("name", F.lit("n"))
    got = block_names.exact_duplicates(docs, block_bytes=block_bytes, with_text=True).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(texts) and all(r.name == "n" and r.fp == "f" for r in got)
    for r in got:
        ids = groups[r.text or ""]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    by_identity = {}
    for r in got:
        by_identity.setdefault(tuple(r.identity), set()).add(r.text or "")
    assert len(by_identity) == len(groups) and all(len(t) == 1 for t in by_identity.values())
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    left = block_names.keep_one(docs).collect()
    assert len(left) == len(groups) and {r.kept for r in left} == {5}
    assert block_names.exact_duplicates(docs.limit(0)).collect() == [] == block_names.keep_one(docs.limit(0)).collect()


def test_a_hash_that_does_not_tell_blocks_apart_is_not_used(spark, monkeypatch):
    plain = block_names._prints
    poor = lambda block, seed: [F.length(block).cast("long").alias("h1"), F.lit(0).alias("h2")] if seed == 0 else plain(block, seed)
    monkeypatch.setattr(block_names, "_prints", poor)
    rows = block_names.exact_duplicates(docs_of(spark, [(1, "aa"), (2, "bb"), (3, "aa")])).collect()
    assert {(r.doc_id, r.keep_id) for r in rows} == {(1, 3), (2, 2), (3, 3)}


# --- centroid clustering ----------------------------------------------------------


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 0, "t", 1) for r in rows], "vec_id long, embedding array<float>, label int, cluster int, tag string, id int")


def brute_clusters(rows, k, rounds, factor, dims):
    kept = [(i, [int(np.floor(factor * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) < 1e4 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centers)), key=lambda j: (away(v, centers[j]), j))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        for j in range(len(centers)):
            own = [v for (_, v), c in zip(kept, of) if c == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((str(i), nearest(v), away(v, centers[nearest(v)])) for i, v in kept), centers


@pytest.mark.parametrize(("size", "k", "factor"), [(400, 5, 1024), (400, 3, 2), (3, 5, 1024), (60, 1, 8)])
def test_clusters_equal_plain_rounds(spark, size, k, factor, monkeypatch):
    monkeypatch.setattr(centroid_clusters, "VECTORS_PER_BLOCK", 50)
    rng = random.Random(size + k)
    rows = [(i, [rng.choice([-3.0, 0.0, 4.0]) * (i % 3) + rng.gauss(0, 1) for _ in range(6)]) for i in range(size)]
    rows += [(None, [0.5] * 6), (size, None), (size + 1, [1.0] * 5), (size + 2, [1.0] * 5 + [float("nan")]), (size + 3, [1.0] * 5 + [None]), (size + 4, [1e30] * 6)]
    rows += [(0, rows[0][1])] * 3
    got, centers, scanned = centroid_clusters.cluster_vectors(vectors_of(spark, [(i, v, 0) for i, v in rows]), k, 6, factor=factor, dims=6)
    want, want_centers = brute_clusters(rows, k, 6, factor, 6)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want and centers == want_centers
    # Later rounds scan only vectors whose gap has expired.
    assert scanned[0] == len(want) and (k == 1 or size < 50 or factor < 100 or min(scanned) < len(want))
    none = centroid_clusters.cluster_vectors(vectors_of(spark, [(1, None, 0)]))
    assert none[0].collect() == [] and none[1] == []
    total = centroid_clusters.with_inertia(got, centers).select("inertia").first()[0]
    assert total == sum(d for _, _, d in want)


def test_rounds_do_not_shuffle_vectors(spark, monkeypatch):
    plans, write = [], centroid_clusters.Buckets.write
    monkeypatch.setattr(centroid_clusters.Buckets, "write", lambda self, kind, rows: (plans.append((kind, rows._jdf.queryExecution().executedPlan().toString())), write(self, kind, rows))[1])
    centroid_clusters.cluster_vectors(vectors_of(spark, [(i, [float(i % 7), 1.0], 0) for i in range(50)]), 3, 2, dims=2)
    rounds = [p for kind, p in plans if kind == "heaps"]
    assert len(rounds) == 2 and all("Exchange" not in p for p in rounds)


# --- hard negatives ---------------------------------------------------------------


def brute_negatives(rows, every, factor=256):
    kept = sorted({(i, lab, tuple(int(np.floor(factor * float(np.float32(x)))) for x in v)) for i, v, lab in rows
                   if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) and abs(x) < 1e4 for x in v)})
    out = []
    for a in (r for r in kept if r[0] % every == 0):
        others = [(sum(x * y for x, y in zip(a[2], r[2])), r) for r in kept if r != a and len(r[2]) == len(a[2])]
        best = sorted(((-s, r[0]) for s, r in others if r[1] == a[1]))[:5]
        for s, p in best:
            near = sorted((-t, r[0]) for t, r in others if r[1] != a[1] and 80 * -s <= 100 * t <= 100 * -s)[:5]
            out += [(a[0], p, n + 1, i, -s, -t) for n, (t, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("size", "grain"), [(250, 1), (250, 0), (30, 1)])
def test_negatives_equal_a_full_sort(spark, monkeypatch, size, grain):
    monkeypatch.setattr(hard_negatives, "ROWS_PER_BLOCK", 37)
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 2)
    rng = random.Random(size + grain)
    value = (lambda: rng.gauss(0.3, 1)) if grain else (lambda: float(rng.choice([0, 1])))
    rows = [(i, [value() for _ in range(4)], rng.randrange(3)) for i in range(size)]
    rows += [(None, [1.0] * 4, 1), (1000, None, 1), (1001, [1.0] * 4, None), (1002, [None] * 4, 1), (1003, [float("inf")] * 4, 1), (1005, [], 1), (1010, [1.0] * 3, 1), (1011, [1.0] * 3, 2), (1012, [1.0] * 3, 1)]
    rows += [rows[10], rows[10], rows[3]]
    got = hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows, 10)
    assert hard_negatives.mine(vectors_of(spark, rows).limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") < 0).collect() == []


def test_copied_anchors_are_shuffled_not_broadcast(spark):
    """Copies of the anchors grow with the square of the rows, while their table looks small."""
    rows = [(i, [float(i % 7), 1.0], i % 3) for i in range(40)]
    blocks = hard_negatives.in_blocks(vectors_of(spark, rows).select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("tag"), F.lit([1, 2]).cast("array<bigint>").alias("v")), 8)
    met = hard_negatives._paired(blocks, blocks.withColumn("positives", F.lit(None)), 64)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert met.count() == blocks.count() ** 2
    assert [hard_negatives._slots(n, 6) for n in (0, 5, 24, 192, 200, 100_000)] == [1, 5, 24, 24, 25, 12_500]
