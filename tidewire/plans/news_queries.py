"""Queries over articles: scans, filters, sessions, counts, daily features, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import naming, timefn
from tidewire.functions.numeric import rounded, softmax
from tidewire.functions.text import without_script
from tidewire.operators import daily, quality, scoring, sessions
from tidewire.operators.order import with_row_id
from tidewire.operators.sessions import SESSION
from tidewire.plans import standins
from tidewire.plans.registry import register
from tidewire.plans.sqlviews import candidate, r6, with_views
from tidewire.sources import news

CLASSES = ("pos", "neg", "neu")
MEANS = [f"avg_{c}" for c in CLASSES]


def _round_means(df: DataFrame) -> DataFrame:
    return df.withColumns({m: rounded(m) for m in MEANS})


def _means_sql() -> str:
    return ", ".join(r6(m) for m in MEANS)


@register(
    "session_assign",
    with_views("session_articles", body="SELECT article_id, date_utc, trading_session_date_utc FROM session_articles"),
)
def session_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.session_articles(spark, sf_dir).select("article_id", "date_utc", SESSION)


@register(
    "session_assign_events",
    with_views(
        "calendar", "event_articles",
        body=f"""SELECT a.article_id, a.date_utc, a.cand AS candidate_date, c.trading_date AS trading_session_date_utc
FROM (SELECT *, {candidate()} AS cand FROM event_articles) a ASOF LEFT JOIN calendar c ON a.cand <= c.trading_date""",
    ),
)
def session_assign_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = standins.event_articles(spark, sf_dir).select(
        "article_id", "date_utc", timefn.candidate_session("date_utc").alias("candidate_date")
    )
    return sessions.next_trading_date(events, "candidate_date", standins.calendar(spark))


@register(
    "session_local_cutoff",
    with_views(
        "calendar", "articles",
        body="""SELECT a.article_id, c.trading_date AS trading_session_date_utc
FROM (SELECT article_id, timezone('America/New_York', timezone('UTC', date_utc)) AS local_ts FROM articles) a
ASOF LEFT JOIN calendar c
  ON CASE WHEN hour(local_ts) < 16 THEN local_ts::DATE ELSE local_ts::DATE + 1 END <= c.trading_date""",
    ),
)
def session_local_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.articles(spark, sf_dir).select("article_id", "date_utc")
    placed = sessions.assign_sessions(
        rows, "date_utc", standins.calendar(spark), cutoff_hour=16, zone=timefn.NEW_YORK
    )
    return placed.select("article_id", SESSION)


@register(
    "trading_days",
    with_views(
        "calendar", "event_articles",
        body="""SELECT e.day AS event_day, min(c.trading_date) AS trading_session_date_utc
FROM (SELECT DISTINCT date_utc::DATE AS day FROM event_articles) e LEFT JOIN calendar c ON c.trading_date >= e.day
GROUP BY e.day""",
    ),
)
def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.operators.calendar import calendar_for

    events = standins.event_articles(spark, sf_dir)
    days = events.select(F.to_date("date_utc").alias("event_day")).distinct()
    return sessions.next_trading_date(days, "event_day", calendar_for(events))


@register(
    "asof_forward_generic",
    with_views(
        "event_articles",
        body="""SELECT l.article_id, r.article_id AS next_purchase, r.date_utc AS matched_date_utc
FROM event_articles l ASOF LEFT JOIN (SELECT user_id, date_utc, max(article_id) AS article_id FROM event_articles
  WHERE Stock_symbol = 'purchase' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.date_utc <= r.date_utc""",
    ),
)
def asof_forward_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = standins.event_articles(spark, sf_dir)
    bought = events.where("Stock_symbol = 'purchase'")
    bought = bought.select("user_id", "date_utc", F.col("article_id").alias("next_purchase"))
    rows = events.select("article_id", "user_id", "date_utc")
    joined = sessions.asof_join(rows, bought, "date_utc", "user_id", ["next_purchase"], "forward", bucket="day")
    return joined.select("article_id", "next_purchase", "matched_date_utc")


@register(
    "asof_backward_generic",
    with_views(
        "event_articles",
        body="""SELECT l.article_id, r.value AS last_error_value, r.date_utc AS matched_date_utc
FROM event_articles l ASOF LEFT JOIN (SELECT user_id, date_utc, max(value) AS value FROM event_articles
  WHERE Stock_symbol = 'error' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.date_utc >= r.date_utc""",
    ),
)
def asof_backward_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = standins.event_articles(spark, sf_dir)
    errors = events.where("Stock_symbol = 'error'")
    errors = errors.select("user_id", "date_utc", F.col("value").alias("last_error_value"))
    rows = events.select("article_id", "user_id", "date_utc")
    joined = sessions.asof_join(rows, errors, "date_utc", "user_id", ["last_error_value"], bucket="hour")
    return joined.select("article_id", "last_error_value", "matched_date_utc")


# Scans and filters


@register(
    "news_parquet_scan",
    """SELECT event_id, event_type, ts AS date_utc,
timezone('America/New_York', timezone('UTC', ts)) AS date_est FROM events""",
)
def news_parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = news.read_news(spark, f"{sf_dir}/events.parquet", date_col="ts")
    return rows.select("event_id", "event_type", "date_utc", "date_est")


@register(
    "load_sources",
    """SELECT source_name, count(*) AS n, min(ts) AS first_utc, max(ts) AS last_utc FROM (
SELECT 'events' AS source_name, ts FROM events
UNION ALL SELECT 'orders', o_orderdate FROM orders UNION ALL SELECT 'shipments', l_shipdate FROM lineitem)
GROUP BY 1""",
)
def load_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"events": ("events", "ts"), "orders": ("orders", "o_orderdate"), "shipments": ("lineitem", "l_shipdate")}
    merged = None
    for name, (table, date_col) in names.items():
        paths = {name: f"{sf_dir}/{table}.parquet", f"{name}_missing": f"{sf_dir}/{table}_missing.parquet"}
        loaded, _ = news.load_sources(spark, paths, date_col=date_col)
        loaded = loaded.select("source_name", "date_utc")
        merged = loaded if merged is None else merged.unionByName(loaded)
    return merged.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("date_utc").alias("first_utc"), F.max("date_utc").alias("last_utc")
    )


@register(
    "symbol_filter",
    with_views("articles", body="SELECT article_id, Stock_symbol, length(Article_title) AS chars FROM articles "
    "WHERE Stock_symbol = 'src3'"),
)
def symbol_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = news.only_symbol(standins.articles(spark, sf_dir), "src3")
    return rows.select("article_id", "Stock_symbol", F.length("Article_title").cast("long").alias("chars"))


@register(
    "time_range_filter",
    with_views("event_articles", body="""SELECT article_id, date_utc FROM event_articles
WHERE date_utc >= TIMESTAMP '2024-01-08 00:00:00' AND date_utc <= TIMESTAMP '2024-01-19 23:59:59'"""),
)
def time_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.event_articles(spark, sf_dir).select("article_id", "date_utc")
    return news.in_range(rows, "date_utc", "2024-01-08 00:00:00", "2024-01-19 23:59:59")


@register(
    "half_open_range",
    with_views("daily_sentiment", body="""SELECT trading_session_date_utc, daily_article_count FROM daily_sentiment
WHERE trading_session_date_utc >= DATE '1996-12-01' AND trading_session_date_utc < DATE '1997-03-01'"""),
)
def half_open_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily.daily_sentiment(standins.session_scores(spark, sf_dir)).select(SESSION, "daily_article_count")
    return news.in_range(rows, SESSION, "1996-12-01", "1997-03-01", closed="left")


@register(
    "cutoff_filter",
    "SELECT count(*) AS rows, min(ts) AS min_date, max(ts) AS max_date FROM events "
    "WHERE ts <= TIMESTAMP '2024-01-15 23:59:59'",
)
def cutoff_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = news.in_range(standins.event_articles(spark, sf_dir), "date_utc", end="2024-01-15 23:59:59")
    return quality.extent(rows, "date_utc")


@register(
    "script_filter",
    with_views("articles", body="SELECT article_id FROM articles WHERE NOT regexp_matches(Article_title, '[à-ÿÀ-ß]')"),
)
def script_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_script(standins.articles(spark, sf_dir), "Article_title", "[à-ÿÀ-ß]").select("article_id")


@register(
    "cyrillic_filter",
    with_views("articles", body="SELECT Stock_symbol, count(*) AS n FROM articles "
    "WHERE NOT regexp_matches(Article_title, '[а-яА-Я]') GROUP BY 1"),
)
def cyrillic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_script(standins.articles(spark, sf_dir), "Article_title")
    return kept.groupBy("Stock_symbol").agg(F.count(F.lit(1)).alias("n"))


@register(
    "non_midnight",
    """SELECT table_name, count(*) AS n FROM (SELECT 'events' AS table_name, ts FROM events
UNION ALL SELECT 'orders', o_orderdate FROM orders
UNION ALL SELECT 'articles', TIMESTAMP '1995-01-02' + to_hours(CAST((doc_id * 7) % 24 AS BIGINT)) FROM documents)
WHERE ts <> date_trunc('day', ts) GROUP BY 1""",
)
def non_midnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {
        "events": standins.event_articles(spark, sf_dir).select("date_utc"),
        "orders": standins.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("date_utc")),
        "articles": standins.articles(spark, sf_dir).select("date_utc"),
    }
    rows = None
    for name, part in parts.items():
        part = part.withColumn("table_name", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    kept = rows.where(timefn.is_not_midnight("date_utc"))
    return kept.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))


@register(
    "row_ids",
    with_views("event_articles", body="""SELECT row_number() OVER (ORDER BY date_utc, article_id) - 1 AS id, article_id,
date_utc FROM event_articles WHERE Article_title IS NOT NULL"""),
)
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.event_articles(spark, sf_dir).where(F.col("Article_title").isNotNull())
    return with_row_id(rows.select("article_id", "date_utc"), ["date_utc", "article_id"])


@register(
    "format_and_parse",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS stamp, date_trunc('second', ts) AS parsed,
hour(ts)::INTEGER AS hour, ts::DATE AS day, ts::DATE + 1 AS next_day FROM events""",
)
def format_and_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = timefn.format_utc("date_utc")
    return standins.event_articles(spark, sf_dir).select(
        F.col("article_id").alias("event_id"),
        stamp.alias("stamp"),
        timefn.parse_utc(stamp).alias("parsed"),
        F.hour("date_utc").alias("hour"),
        F.to_date("date_utc").alias("day"),
        F.date_add(F.to_date("date_utc"), 1).alias("next_day"),
    )


@register(
    "file_names",
    """SELECT url, string_split(url, '/')[-1] AS name,
TRY_CAST(nullif(regexp_extract(string_split(url, '/')[-1], '_([0-9]+)\\.[^.]*$', 1), '') AS BIGINT) AS number FROM pages""",
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.table(spark, sf_dir, "pages").select(
        "url", naming.file_name("url").alias("name"), naming.chunk_number("url").alias("number")
    )


# Counts and checks


@register(
    "article_counts",
    with_views("articles", body="""SELECT date_utc::DATE AS day, count(*) AS article_count FROM articles
WHERE date_utc::DATE BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1"""),
)
def article_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.article_counts(standins.articles(spark, sf_dir), "date_utc", "1996-01-01", "1999-12-31")


@register(
    "count_axis",
    "SELECT round(max(n) * 1.1::DOUBLE, 6) AS axis_top FROM (SELECT ts::DATE AS d, count(*) AS n FROM events GROUP BY 1)",
)
def count_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = daily.article_counts(standins.event_articles(spark, sf_dir), "date_utc")
    return daily.count_axis_top(counts).select(rounded("axis_top").alias("axis_top"))


@register(
    "eda_summary",
    with_views("articles", body="""SELECT count(DISTINCT d) AS distinct_days, min(d) AS min_date, max(d) AS max_date,
(max(d) - min(d))::INTEGER AS span_days, count(*) AS rows
FROM (SELECT timezone('America/New_York', timezone('UTC', date_utc))::DATE AS d FROM articles)"""),
)
def eda_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = standins.articles(spark, sf_dir).select(timefn.to_zone("date_utc").alias("date_est"))
    return quality.date_summary(local, "date_est")


@register(
    "extent",
    "SELECT min(ts) AS min_date, max(ts) AS max_date, count(*) AS rows FROM events",
)
def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.extent(standins.event_articles(spark, sf_dir), "date_utc")


@register(
    "null_counts",
    """SELECT 'text' AS "column", count(*) FILTER (text IS NULL) AS nulls, count(*) AS rows FROM documents d
LEFT JOIN labels l USING (doc_id) UNION ALL
SELECT 'quality', count(*) FILTER (quality IS NULL), count(*) FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = standins.table(spark, sf_dir, "documents").join(
        standins.table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    return quality.null_counts(joined, ["text", "quality"])


@register("distinct_symbols", "SELECT DISTINCT source AS Stock_symbol FROM documents")
def distinct_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.articles(spark, sf_dir).select("Stock_symbol").distinct()


# Every document belongs to one of the two title sources, by its symbol.
_SOURCES = """a AS (SELECT text AS t, doc_id FROM documents WHERE source < 'src15'),
b AS (SELECT text AS t, doc_id FROM documents WHERE source >= 'src15')"""


def _two_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document, dealt to two sources by its symbol."""
    rows = standins.articles(spark, sf_dir).withColumn("date_est", timefn.to_zone("date_utc"))
    return rows.where("Stock_symbol < 'src15'"), rows.where("Stock_symbol >= 'src15'")


@register(
    "title_overlap",
    f"""WITH {_SOURCES} SELECT count(*) AS same_titles FROM
(SELECT t FROM a WHERE t IS NOT NULL INTERSECT SELECT t FROM b)""",
)
def title_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.title_overlap(*_two_sources(spark, sf_dir))


@register(
    "title_symdiff",
    f"""WITH {_SOURCES} SELECT doc_id AS article_id, 'nasdaq' AS source FROM a WHERE t NOT IN (SELECT t FROM b)
UNION ALL SELECT doc_id, 'external' FROM b WHERE t NOT IN (SELECT t FROM a)""",
)
def title_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_sources(spark, sf_dir)
    diff = quality.title_difference(a, b, ("nasdaq", "external"), keep=["article_id"])
    return diff.select("article_id", "source")


@register(
    "title_symdiff_window",
    with_views("articles", body="""SELECT article_id, date_est, source FROM (
  SELECT *, CASE WHEN Stock_symbol < 'src15' THEN 'nasdaq' ELSE 'external' END AS source,
    count(*) FILTER (Stock_symbol < 'src15') OVER (PARTITION BY Article_title) AS firsts,
    count(*) FILTER (Stock_symbol >= 'src15') OVER (PARTITION BY Article_title) AS seconds
  FROM (SELECT *, timezone('America/New_York', timezone('UTC', date_utc)) AS date_est FROM articles)
  WHERE date_est >= TIMESTAMP '1996-01-01 16:00:05' AND date_est <= TIMESTAMP '1998-07-01 16:00:05')
WHERE least(firsts, seconds) = 0"""),
)
def title_symdiff_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_sources(spark, sf_dir)
    diff = quality.title_difference(
        a, b, ("nasdaq", "external"), start="1996-01-01 16:00:05", end="1998-07-01 16:00:05", keep=["article_id"]
    )
    return diff.select("article_id", "date_est", "source")


@register(
    "compare_copies",
    """SELECT 'value' AS "column", count(*) AS compared, count(*) FILTER (value <> round(value, 1)) AS mismatches,
count(*) FILTER (value IS NULL) AS left_nulls, count(*) FILTER (value IS NULL) AS right_nulls FROM events
UNION ALL SELECT 'stamp', count(*), count(*) FILTER (ts <> date_trunc('second', ts)),
count(*) FILTER (ts IS NULL), count(*) FILTER (ts IS NULL) FROM events""",
)
def compare_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.event_articles(spark, sf_dir)
    a = rows.select("article_id", "value", F.col("date_utc").alias("stamp"))
    b = rows.select(
        "article_id",
        F.round("value", 1).alias("value"),
        timefn.parse_utc(timefn.format_utc("date_utc")).alias("stamp"),
    )
    return quality.compare_copies(a, b, "article_id", ["value", "stamp"])


@register(
    "copy_mismatches",
    """SELECT event_id, value AS left_value, floor(value) AS right_value FROM events WHERE value <> floor(value)
ORDER BY event_id LIMIT 20""",
)
def copy_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.table(spark, sf_dir, "events")
    floored = rows.select("event_id", F.floor("value").cast("double").alias("value"))
    return quality.mismatches(rows, floored, "event_id", "value")


# Daily features


@register("daily_sentiment", with_views("daily_sentiment", body=f"SELECT trading_session_date_utc, {_means_sql()}, "
          "daily_article_count FROM daily_sentiment"))
def daily_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_means(daily.daily_sentiment(standins.session_scores(spark, sf_dir)))


@register(
    "daily_sentiment_calendar",
    with_views("scored_articles", body=f"""SELECT date_utc, {_means_sql()}, daily_article_count FROM (
SELECT date_utc::DATE AS date_utc, avg(sent_pos) AS avg_pos, avg(sent_neg) AS avg_neg, avg(sent_neu) AS avg_neu,
count(*) AS daily_article_count FROM scored_articles GROUP BY 1)"""),
)
def daily_sentiment_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily.by_calendar_day(standins.scored_articles(spark, sf_dir))
    return _round_means(daily.daily_sentiment(days, "date_utc"))


@register(
    "daily_embedding",
    with_views("session_scores", body=f"""SELECT trading_session_date_utc, pos, {r6('avg(v)::FLOAT', 'value')} FROM (
SELECT trading_session_date_utc, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos
FROM session_scores) GROUP BY 1, 2"""),
)
def daily_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = daily.daily_embedding(standins.session_scores(spark, sf_dir))
    long = means.select(SESSION, F.posexplode("daily_embedding").alias("pos", "value"))
    return long.select(SESSION, F.col("pos").cast("long").alias("pos"), rounded(F.col("value").cast("double")).alias("value"))


@register(
    "merge_sessions",
    with_views("session_scores", body=f"""SELECT trading_session_date_utc, {_means_sql()}, daily_article_count FROM (
SELECT trading_session_date_utc, avg(sent_pos) AS avg_pos, avg(sent_neg) AS avg_neg, avg(sent_neu) AS avg_neu,
count(*) AS daily_article_count FROM session_scores GROUP BY 1)"""),
)
def merge_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_means(daily.merge_sessions(_stacked_parts(spark, sf_dir)))


def _stacked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of morning and later articles apart, stacked: sessions occur twice."""
    scores = standins.session_scores(spark, sf_dir)
    early, late = scores.where(F.hour("date_utc") < 12), scores.where(F.hour("date_utc") >= 12)
    return daily.daily_sentiment(early).unionByName(daily.daily_sentiment(late))


@register(
    "duplicate_sessions",
    with_views("session_scores", body="""SELECT trading_session_date_utc, count(*) AS copies FROM (
SELECT DISTINCT trading_session_date_utc, hour(date_utc) < 12 AS half FROM session_scores) GROUP BY 1
HAVING count(*) > 1"""),
)
def duplicate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.duplicate_sessions(_stacked_parts(spark, sf_dir))


@register(
    "prob_sum_violations",
    with_views("logits", body=f"""SELECT date_utc::DATE AS date_utc, {r6('avg(a) + avg(b) + avg(c)', 'probability_sum')}
FROM logits GROUP BY 1 HAVING NOT (avg(a) + avg(b) + avg(c) BETWEEN 0.99 AND 1.01)"""),
)
def prob_sum_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logits in place of probabilities, so that nearly every day is reported."""
    rows = standins.scored_articles(spark, sf_dir)
    raw = [F.get("finbert_embedding", i).cast("double").alias(f"sent_{c}") for i, c in enumerate(CLASSES)]
    means = daily.daily_sentiment(daily.by_calendar_day(rows.select("date_utc", *raw)), "date_utc")
    found = quality.probability_violations(means)
    return found.select("date_utc", rounded("probability_sum").alias("probability_sum"))


@register(
    "count_check",
    with_views("session_scores", body="""SELECT trading_session_date_utc, count(*) AS daily_article_count,
count(*) AS recount FROM session_scores GROUP BY 1"""),
)
def count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = standins.session_scores(spark, sf_dir)
    return quality.count_check(daily.daily_sentiment(scores), scores)


@register(
    "spot_check",
    with_views("session_scores", body=f"""SELECT trading_session_date_utc,
{r6('abs(avg(sent_pos) - sum(sent_pos) / count(*))', 'gap_pos')},
{r6('abs(avg(sent_neg) - sum(sent_neg) / count(*))', 'gap_neg')},
{r6('abs(avg(sent_neu) - sum(sent_neu) / count(*))', 'gap_neu')}, 0::BIGINT AS gap_count
FROM session_scores GROUP BY 1"""),
)
def spot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of the merged parts against a fresh aggregation."""
    stored = daily.merge_sessions(_stacked_parts(spark, sf_dir))
    found = quality.spot_check(stored, standins.session_scores(spark, sf_dir))
    return found.withColumns({f"gap_{c}": rounded(f"gap_{c}") for c in CLASSES})


@register(
    "softmax_scores",
    with_views("scored_articles", body=f"""SELECT article_id, {r6('sent_pos')}, {r6('sent_neg')}, {r6('sent_neu')}
FROM scored_articles"""),
)
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = softmax(F.slice("embedding", 1, 3))
    rows = standins.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), p.alias("p"))
    return rows.select("article_id", *[rounded(F.get("p", i)).alias(f"sent_{c}") for i, c in enumerate(CLASSES)])


@register(
    "score_check",
    with_views("scored_articles", body=f"""SELECT article_id, len(embedding) = 64 AS width_ok,
abs(sent_pos + sent_neg + sent_neu - 1) <= 1e-5 AS sum_ok,
CASE WHEN sent_pos = greatest(sent_pos, sent_neg, sent_neu) THEN 'Positive'
  WHEN sent_neg = greatest(sent_pos, sent_neg, sent_neu) THEN 'Negative' ELSE 'Neutral' END AS leading_class,
{r6('greatest(sent_pos, sent_neg, sent_neu)', 'leading_score')} FROM scored_articles"""),
)
def score_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score_check(standins.scored_articles(spark, sf_dir), "article_id", standins.EMBEDDING_WIDTH)
    return found.withColumn("leading_score", rounded("leading_score"))


# Sixteen token vectors of four elements per text; a token counts if its first element is positive.
def _token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.table(spark, sf_dir, "embeddings")
    cut = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, F.lit(4)))
    tokens = rows.select("vec_id", F.posexplode(cut).alias("pos", "vector"))
    return tokens.withColumn("mask", (F.get("vector", 0) > 0).cast("int"))


@register(
    "masked_mean_pool",
    "SELECT vec_id, "
    + ", ".join(
        r6(f"sum(CASE WHEN embedding[4*p+1] > 0 THEN embedding[4*p+{i + 1}]::DOUBLE ELSE 0 END) / "
           "greatest(sum(CASE WHEN embedding[4*p+1] > 0 THEN 1.0::DOUBLE ELSE 0 END), 1e-9)", f"e{i}")
        for i in range(4)
    )
    + " FROM embeddings, generate_series(0, 15) t(p) GROUP BY vec_id",
)
def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = daily.pool_tokens(_token_vectors(spark, sf_dir), "vec_id", "pos", "vector", "mask")
    return pooled.select("vec_id", *[rounded(F.get("embedding", i)).alias(f"e{i}") for i in range(4)])


@register(
    "cls_pool",
    "SELECT vec_id, " + ", ".join(r6(f"embedding[{i + 1}]", f"e{i}") for i in range(4)) + " FROM embeddings",
)
def cls_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = daily.pool_tokens(_token_vectors(spark, sf_dir), "vec_id", "pos", "vector", "mask", "cls")
    return pooled.select(
        "vec_id", *[rounded(F.get("embedding", i).cast("double")).alias(f"e{i}") for i in range(4)]
    )


def _share(letter: str) -> str:
    return (
        f"(length(Article_title) - length(replace(Article_title, '{letter}', '')))"
        "::DOUBLE / (length(Article_title) + 1)"
    )


@register(
    "score_articles",
    with_views("articles", body=f"""SELECT article_id, {r6('ea / (ea + eb + ec)', 'sent_pos')},
{r6('eb / (ea + eb + ec)', 'sent_neg')}, {r6('ec / (ea + eb + ec)', 'sent_neu')}, e3 FROM (
SELECT article_id, exp(10 * {_share('a')}) AS ea, exp(10 * {_share('e')}) AS eb, exp(10 * {_share('i')}) AS ec,
{r6(f"({_share('o')})::FLOAT", 'e3')} FROM articles)"""),
)
def score_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score_articles(
        standins.articles(spark, sf_dir, heavy=True), standins.letter_scorer, keep=["article_id", "Article_title"]
    )
    probabilities = [rounded(f"sent_{c}").alias(f"sent_{c}") for c in CLASSES]
    last = rounded(F.get("finbert_embedding", 3).cast("double")).alias("e3")
    return scored.select("article_id", *probabilities, last)


@register(
    "head_and_tail",
    with_views("daily_sentiment", body="""SELECT trading_session_date_utc, daily_article_count, 'head' AS part
FROM (FROM daily_sentiment ORDER BY trading_session_date_utc LIMIT 15)
UNION ALL SELECT trading_session_date_utc, daily_article_count, 'tail'
FROM (FROM daily_sentiment ORDER BY trading_session_date_utc DESC LIMIT 15)"""),
)
def head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily.daily_sentiment(standins.session_scores(spark, sf_dir)).select(SESSION, "daily_article_count")
    first = days.orderBy(SESSION).limit(15).withColumn("part", F.lit("head"))
    return first.unionByName(daily.tail(days, 15, SESSION).withColumn("part", F.lit("tail")))
