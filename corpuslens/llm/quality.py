"""Quality rules: counts of a text, and robust multivariate outliers.

Texts that pass the plain limits are described by transformed statistics, in
whole 1/1024ths so that sums are exact in any order. For every language and
source the minimum-covariance-determinant estimate is found: from medians and
quartiles, concentration steps keep the rows nearest by Mahalanobis distance
and estimate anew. A row far outside the final ellipsoid is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions.arrays import pinned
from corpuslens.llm.common import GAP_CLASS, chi_square, text_of, unused, word_list
from corpuslens.operators.storage import materialised

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
UNIT = 1024
SHARE = 0.75  # of the rows that a concentration step keeps
STEPS = 3
CUTOFF = 0.99999  # chi-square share beyond which a row is rejected
LEAST_ROWS = 60  # a smaller group of language and source is judged with its language, a smaller language with all rows
CELL = 32  # of the 1/1024ths, for the first medians
FINE = 16  # histogram cells in a doubling of the squared distance
GROUPS_SENT = 20_000  # of this many estimates, about 600 bytes each, a copy goes to every task
# Spread below which a statistic is not trusted to be narrower, in doublings.
FLOORS = {"length": 0.5, "word_size": 0.12, "symbols": 0.5, "dup_lines": 1.0, "repeats": 1.0, "capitals": 0.8, "others": 0.6}
DIMS = list(FLOORS)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds the five counts, ``base_failed`` and the vector ``v`` to every row.

    Works inside the row. Windows of five words are told apart by 64-bit hashes,
    and only texts in which one occurs twice are sorted. A null text has no
    words.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in (*COUNTS, "base_failed", "v", "capitals", "others")])
    words, grams, order, at = unused(docs, "_words", "_grams", "_order", "_at")
    text = text_of(F.col("text"))
    worded = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(" \t\x0b\x0c\r"))) > 0)
    without = lambda kinds: F.length(F.regexp_replace(text, kinds, ""))
    rows = docs.withColumns(
        {
            "n_symbols": (F.length(text) - without(r"[#*$%&|<>]+")).cast("bigint"),
            "word_chars": without(GAP_CLASS + "+").cast("bigint"),
            "n_dup_lines": (F.size(worded) - F.size(F.array_distinct(worded))).cast("bigint"),
            "capitals": (F.length(text) - without("[A-Z]+")).cast("bigint"),
            "others": without(r"[\p{L}\x20\x09-\x0D]+").cast("bigint"),
        }
    )
    rows = pinned(rows, **{words: word_list(F.col("text"))})
    w = F.col(words)
    fives = F.when(
        F.size(w) >= 5,
        F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = pinned(rows.withColumn("n_words", F.size(w).cast("bigint")), **{grams: fives}).drop(words)
    g = F.col(grams)
    rows = pinned(
        rows,
        **{
            order: F.when(
                F.size(F.array_distinct(g)) < F.size(g),
                F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            )
        },
    ).drop(grams)
    o = F.col(order)
    same = lambda x, i, d: F.coalesce(F.get(o, i + d)["h"] == x["h"], F.lit(False))
    twice = F.filter(o, lambda x, i: ((i > 0) & same(x, i, -1)) | same(x, i, 1))
    rows = pinned(rows, **{at: F.sort_array(F.transform(twice, lambda x: x["i"]))}).drop(order)
    a = F.col(at)
    covered = F.aggregate(
        F.transform(a, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(a, i + 1) - x, F.lit(5)))),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop(at)
    return rows.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
    ).withColumn("v", vector())


def vector() -> Column:
    """The statistics, each in doublings, as whole numbers of 1/1024."""
    n, chars = F.col("n_words"), F.col("word_chars")
    percent = lambda k, of: F.log2(1 + 100 * k / F.greatest(of, F.lit(1)))
    raw = {
        "length": F.log2(n + 1),
        "word_size": F.log2((chars + 100) / (n + 20)),
        "symbols": percent(F.col("n_symbols"), chars),
        "dup_lines": percent(F.col("n_dup_lines"), n),
        "repeats": percent(F.col("n_repeat_words"), n),
        "capitals": percent(F.col("capitals"), chars),
        "others": percent(F.col("others"), chars),
    }
    return F.array(*[F.round(raw[d] * UNIT).cast("bigint") for d in DIMS])


def _distance(x: Column, centre: Column, inverse: Column) -> Column:
    p = range(len(DIMS))
    off = [(x[i] - centre[i]) / UNIT for i in p]
    terms = [off[i] * off[j] * inverse[i][j] * (1.0 if i == j else 2.0) for i in p for j in p if i <= j]
    return F.greatest(reduce(lambda s, t: s + t, terms), F.lit(0.0))


def _inverted(matrix: Column) -> Column:
    """The inverse of a positive definite matrix by sweeping every pivot."""

    def sweep(m: Column, k: Column) -> Column:
        pivot = F.get(F.get(m, k), k)

        def cell(v: Column, i: Column, j: Column) -> Column:
            row, column = F.get(F.get(m, k), j), F.get(F.get(m, i), k)
            return (
                F.when((i == k) & (j == k), 1.0 / pivot)
                .when(i == k, row / pivot)
                .when(j == k, -column / pivot)
                .otherwise(v - column * row / pivot)
            )

        return F.transform(m, lambda r, i: F.transform(r, lambda v, j: cell(v, i, j)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(DIMS) - 1)), matrix, sweep)


def _sums() -> list[Column]:
    p = range(len(DIMS))
    whole = lambda c: c.cast("decimal(38,0)")
    return [
        F.count("*").alias("n"),
        *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in p],
        *[F.sum(whole(F.col("v")[i] * F.col("v")[j])).alias(f"s{i}_{j}") for i in p for j in p if i <= j],
    ]


def _estimate(sums: DataFrame) -> DataFrame:
    """Centre and inverse covariance out of exact sums, with the floors added."""
    p, n = range(len(DIMS)), F.col("n")
    mean = [F.col(f"s{i}") / n for i in p]
    cov = {
        (i, j): (F.col(f"s{i}_{j}").cast("double") / n - mean[i] * mean[j]) / (UNIT * UNIT)
        + (FLOORS[DIMS[i]] ** 2 if i == j else 0.0)
        for i in p
        for j in p
        if i <= j
    }
    matrix = F.array(*[F.array(*[cov[min(i, j), max(i, j)] for j in p]) for i in p])
    return pinned(
        sums.select("grp", F.array(*mean).alias("centre"), matrix.alias("m")), inverse=_inverted(F.col("m"))
    ).drop("m")


def _joined(rows: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    return rows.join(F.broadcast(groups) if count <= GROUPS_SENT else groups, "grp")


def _first(rows: DataFrame) -> DataFrame:
    """Medians and quartiles of every statistic, to 1/32 of a doubling, from counts of its values."""
    spread = rows.select("grp", F.posexplode("v").alias("d", "y")).withColumn("x", F.floor(F.col("y") / CELL) * CELL)
    values = spread.groupBy("grp", "d", "x").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("grp", "d").orderBy("x")
    ranked = values.withColumn("c", F.sum("k").over(upto)).withColumn("n", F.sum("k").over(Window.partitionBy("grp", "d")))
    at = lambda q: F.min(F.when(F.col("c") >= F.col("n") * q, F.col("x")))
    quartiles = ranked.groupBy("grp", "d").agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / (1.349 * UNIT)).alias("sd"))
    floor = F.element_at(F.array(*[F.lit(f) for f in FLOORS.values()]), F.col("d") + 1)
    weight = 1.0 / (F.col("sd") * F.col("sd") + floor * floor)
    lists = quartiles.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("d", F.col("mid").cast("double").alias("mid"), weight.alias("w")))).alias("q"))
    p = range(len(DIMS))
    return lists.select(
        "grp",
        F.array(*[F.col("q")[i]["mid"] for i in p]).alias("centre"),
        F.array(*[F.array(*[F.col("q")[i]["w"] if i == j else F.lit(0.0) for j in p]) for i in p]).alias("inverse"),
    )


def _nearest(rows: DataFrame, groups: DataFrame, count: int) -> tuple[DataFrame, Column]:
    """Sums by cell of distance, with the cell that completes the nearest share."""
    near = _joined(rows, groups, count).withColumn(
        "cell", F.floor(F.log2(1e-6 + _distance(F.col("v"), F.col("centre"), F.col("inverse"))) * FINE).cast("int")
    )
    cells = near.groupBy("grp", "cell").agg(*_sums())
    # A group has a few hundred cells at most, however many rows.
    earlier = Window.partitionBy("grp").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn(
        "all", F.sum("n").over(Window.partitionBy("grp"))
    )
    return ranked.where(F.col("before") < F.col("all") * SHARE), F.pow(F.lit(2.0), (F.col("cell") + 1) / FINE)


def estimates(rows: DataFrame) -> tuple[DataFrame, int]:
    """``grp``, ``centre``, ``inverse``, ``scale`` of rows ``grp``, ``v``, and their number."""
    groups = materialised(_first(rows))
    count = groups.count()
    names = ["n", *[f"s{i}" for i in range(len(DIMS))]]
    names += [f"s{i}_{j}" for i in range(len(DIMS)) for j in range(len(DIMS)) if i <= j]
    for _ in range(STEPS):
        kept, _edge = _nearest(rows, groups, count)
        groups = materialised(_estimate(kept.groupBy("grp").agg(*[F.sum(c).alias(c) for c in names])))
    kept, edge = _nearest(rows, groups, count)
    # The nearest share of a normal sample ends at this quantile: what it ends at here gives the scale.
    reach = kept.groupBy("grp").agg((F.max(edge) / chi_square(SHARE, len(DIMS))).alias("scale"))
    return materialised(groups.join(reach, "grp").select("grp", "centre", "inverse", F.greatest("scale", F.lit(1.0)).alias("scale"))), count


def assess(counted: DataFrame) -> DataFrame:
    """Estimates for every (lang, source) of stored rows ``lang``, ``source``, ``base_failed``, ``v``.

    Rows that failed the plain limits take no part. A language and source with
    fewer than 60 rows is judged by the estimate of its language, and a language
    with fewer than 60 rows by the estimate of all rows, however few those are.
    Returns ``lang``, ``source``, ``centre``, ``inverse``, ``scale``; nulls are
    values of their own.
    """
    rows = counted.where(~F.col("base_failed")).select("lang", "source", "v")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("?"))
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    grp = (
        F.when(F.col("n") >= LEAST_ROWS, F.concat_ws("\n", F.lit("s"), name("lang"), name("source")))
        .when(F.col("n_lang") >= LEAST_ROWS, F.concat_ws("\n", F.lit("l"), name("lang")))
        .otherwise(F.lit("a"))
    )
    by_lang = by_lang.select(F.col("lang").alias("of"), "n_lang")
    keyed = materialised(
        sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("of")))
        .select("lang", "source", grp.alias("grp"))
    )
    few = keyed.count() <= GROUPS_SENT
    k = (F.broadcast(keyed) if few else keyed).alias("k")
    r = rows.alias("r").join(
        k, F.col("r.lang").eqNullSafe(F.col("k.lang")) & F.col("r.source").eqNullSafe(F.col("k.source"))
    )
    own = r.select("k.grp", "r.v")
    # The estimate of a language rests on all of its rows, not only those of its small sources; the last on all rows.
    levels = keyed.where(~F.col("grp").startswith("s")).select("grp").distinct()
    wider = F.explode(F.array(F.concat_ws("\n", F.lit("l"), name("lang")), F.lit("a")))
    whole = rows.select(wider.alias("grp"), "v").join(F.broadcast(levels) if few else levels, "grp")
    found, _ = estimates(materialised(own.where(F.col("grp").startswith("s")).unionByName(whole)))
    return keyed.join(found, "grp").select("lang", "source", "centre", "inverse", "scale")


def judge(counted: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``kept`` to rows with counts: false beyond the cut-off or if the limits failed."""
    centre, inverse, scale, lang, source = unused(counted, "_centre", "_inverse", "_scale", "_lang", "_source")
    side = found.select(
        F.col("lang").alias(lang), F.col("source").alias(source), F.col("centre").alias(centre),
        F.col("inverse").alias(inverse), F.col("scale").alias(scale),
    )
    few = found.count() <= GROUPS_SENT
    own = [c for c in counted.columns if c.lower() != "kept"]
    rows = counted.select(*own).join(
        F.broadcast(side) if few else side,
        F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source)),
        "left",
    )
    far = _distance(F.col("v"), F.col(centre), F.col(inverse)) > F.col(scale) * chi_square(CUTOFF, len(DIMS))
    return rows.select(*own, (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """Counts and verdict for each row: ``doc_id``, the counts, ``base_failed``, ``kept``.

    Needs ``doc_id``, ``text``, ``lang``, ``source``. The texts are read once;
    what follows works on stored counts. Repeated rows are each judged, alike.
    An empty table gives an empty result.
    """
    counted = materialised(
        with_counts(docs.select("doc_id", "text", "lang", "source")).select(
            "doc_id", "lang", "source", *COUNTS, "base_failed", "v"
        )
    )
    return judge(counted, assess(counted)).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    The counts are worked out once for the estimates and once beside the texts,
    so that no text is shuffled.
    """
    own = docs.columns
    counted = materialised(with_counts(docs.select("text", "lang", "source")).select("lang", "source", "base_failed", "v"))
    found = assess(counted)
    (hidden,) = unused(docs, "_row")
    packed = docs.select(F.struct(*own).alias(hidden), "text", "lang", "source")
    return judge(with_counts(packed), found).where("kept").select(*[F.col(hidden)[c].alias(c) for c in own])
