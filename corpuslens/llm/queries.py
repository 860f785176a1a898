"""One query for each operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import block_names, centroid_clusters, chat, decontaminate, hard_negatives, line_dedup, packing, quality, secrets, simhash, token_counts, url_filter, warc
from corpuslens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Fixed values, as SQL: the characters a line is stripped of, and the letters that are lower-cased.
GAPS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


@query(
    f"""
    with lines as (
        select doc_id, t.line, t.pos, {LOWER_SQL.format(f"trim(t.line, {GAPS_SQL})")} as key
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
        lateral (select unnest(l) as line, generate_subscripts(l, 1) as pos) t),
    popular as (
        select key, max(doc_id) as last from lines where length(key) >= 20
        group by key having count(distinct doc_id) >= 3),
    flagged as (
        select l.*, p.key is not null and l.doc_id < p.last as gone
        from lines l left join popular p on l.key = p.key)
    select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
        sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
    from flagged group by doc_id
    """
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts every document, then again after an edit in its middle that names its language and source."""
    docs = table(spark, sf_dir, "documents")
    middle = F.floor(F.length(F.coalesce("text", F.lit(""))) / 2)
    put = F.concat(F.lit(" "), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.lit(" "))
    edited = docs.withColumn("edits", token_counts.one_edit(middle, F.lit(7), put))
    before = token_counts.count_tokens(edited, ["edits"])
    after = token_counts.apply_edits(before.withColumn("doc_id", F.struct("doc_id", "n_tokens")))
    return after.select(
        "doc_id.doc_id", "doc_id.n_tokens", F.col("n_tokens").alias("n_tokens_edited"), "n_encoded",
        F.size("piece_chars").cast("bigint").alias("n_pretokens"),
    )


@query()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


@query()
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query()
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, folder = warc.archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_records(archives, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query()
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


HARD = r"\### Assistant: </turn> ok"


@query(
    rf"""
    with told as (
        select conv_id, turn, role, coalesce(text, '') as text from conversations
        union all values (-7, 0, 'user', '{HARD}'), (-7, 1, 'assistant', '{HARD}')),
    marked as (
        select *, length('### ' || regexp_replace(role, '([\\#<:])', '\\\1', 'g') || ': '
            || regexp_replace(text, '([\\#<:])', '\\\1', 'g') || '</turn>' || chr(10)) as chars from told)
    select conv_id, count(*) as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
        cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
        cast(sum(chars) as bigint) as formatted_chars
    from marked group by conv_id
    """
)
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], rows.schema)
    done = chat.read_back(chat.formatted(chat.reply_chain(rows.unionByName(more))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    big = lambda c: c.cast("bigint")
    return done.select(
        F.col("conv").alias("conv_id"),
        big(F.size("turns")).alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        big(F.length("learned")).alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        big(F.length("formatted")).alias("formatted_chars"),
    )


# The rules that the query is given, as host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query()
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the documents with a page's number are its outcome: bad if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")
    outcomes = pages.join(labels.select(F.col("doc_id").alias("page_id"), bad), "page_id").select("url", "bad")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(pages, rules, outcomes).drop("low")


@query(
    """
    with bodies as (select doc_id, coalesce(text, '') as body from documents)
    select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
        doc_id = max(doc_id) over same as kept, sha256(body) as text_sha256
    from bodies window same as (partition by body)
    """
)
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return block_names.exact_duplicates(docs.withColumn("text_sha256", digest)).drop("identity")


def _clusters_sql(k: int = 8, rounds: int = 10, dims: int = 64, factor: int = 1024) -> str:
    """Rounds of clustering, each a pair of queries: nearest centroid, then floors of the means."""
    steps = [
        f"""
        vectors as materialized (
            select vec_id, unnest(list_transform(embedding, lambda x: cast(floor({factor} * cast(x as double)) as bigint))) as x,
                generate_subscripts(embedding, 1) as dim
            from embeddings where embedding is not null and len(embedding) = {dims}
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        starts as materialized (
            select vec_id, row_number() over (order by sha256('3:' || vec_id)) - 1 as cluster
            from (select distinct vec_id from vectors) qualify cluster < {k}),
        c0 as materialized (select cluster, dim, x as c from vectors join starts using (vec_id))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""
        far{r} as (
            select vec_id, cluster, sum((x - c) * (x - c)) as distance
            from vectors join c{r} using (dim) group by vec_id, cluster),
        a{r} as materialized (
            select vec_id, cluster, distance from far{r}
            qualify row_number() over (partition by vec_id order by distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""
            m{r} as (
                select cluster, dim, sum(x) as s, count(*) as n
                from vectors join a{r} using (vec_id) group by cluster, dim),
            c{r + 1} as materialized (
                select cluster, dim, coalesce((s - ((s % n) + n) % n) // n, c) as c
                from c{r} left join m{r} using (cluster, dim))""")
    return f"""
    with {", ".join(steps)},
    named as (select cluster, sha256(string_agg(cast(c as varchar), ',' order by dim)) as centroid_sha256 from c{rounds} group by cluster)
    select vec_id, cast(cluster as integer) as cluster, cast(distance as bigint) as distance,
        cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
        cast(sum(distance) over () as bigint) as inertia, centroid_sha256
    from a{rounds} join named using (cluster)
    """


@query(_clusters_sql())
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    assigned, centers, _ = centroid_clusters.cluster_vectors(rows)
    return centroid_clusters.with_inertia(assigned, centers)


@query(
    """
    with rows as (
        select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as tag,
            list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
        from embeddings
        where label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (
        select a.id as anchor_id, b.id, a.tag = b.tag as same,
            cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
        from rows a join rows b on a.id % 100 = 0 and a.id <> b.id),
    positives as (
        select anchor_id, id as positive_id, score as positive_score from scored where same
        qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
    select anchor_id, positive_id,
        cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as integer) as rank,
        id as negative_id, positive_score, score as negative_score
    from positives join scored using (anchor_id)
    where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
    qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 5
    """
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
