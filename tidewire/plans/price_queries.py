"""Queries over prices: returns, labels, master table, windows, splits, scaling, backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.numeric import rounded
from tidewire.operators import backtest, daily, master, prices, scaling, sequences, splits
from tidewire.operators.order import with_position
from tidewire.operators.prices import PRICE_FEATURES
from tidewire.operators.sessions import SESSION
from tidewire.plans import standins
from tidewire.plans.registry import register
from tidewire.plans.sqlviews import r6, with_views
from tidewire.session import scratch_path
from tidewire.sources import layout
from tidewire.sources.prices import first_days

SENTIMENT = ["avg_pos", "avg_neg", "avg_neu", "daily_article_count"]
KEYS = ["trading_date", "ticker"]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.prices(spark, sf_dir).withColumnRenamed("date", "trading_date")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.price_timeline(standins.prices(spark, sf_dir))


def master_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price timeline with daily sentiment."""
    sentiment = daily.daily_sentiment(standins.session_scores(spark, sf_dir))
    return master.join_features(timeline(spark, sf_dir), sentiment)


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in columns})


def _lag_sql() -> str:
    return ", ".join(r6(c) for c in PRICE_FEATURES)


@register(
    "price_returns",
    with_views("returns", body=f"SELECT ticker, trading_date, close, {r6('return_lag0')} FROM returns"),
)
def price_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prices.with_returns(bars(spark, sf_dir))
    return _rounded(rows.select("ticker", "trading_date", "close", "return_lag0"), ["return_lag0"])


@register(
    "price_returns_bucketed",
    with_views("returns", body=f"SELECT ticker, trading_date, close, {r6('return_lag0')} FROM returns"),
)
def price_returns_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from bars that lie in buckets by ticker, so the window needs no exchange."""
    table = layout.bucket_prices(bars(spark, sf_dir), scratch_path(spark, "buckets"), buckets=8)
    rows = prices.with_returns(table)
    return _rounded(rows.select("ticker", "trading_date", "close", "return_lag0"), ["return_lag0"])


@register(
    "next_day_label",
    with_views("lagged", body="SELECT ticker, trading_date, target_next_day::TINYINT AS target_next_day FROM lagged"),
)
def next_day_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.with_label(prices.with_returns(bars(spark, sf_dir))).select(
        "ticker", "trading_date", "target_next_day"
    )


@register(
    "return_lags",
    with_views("lagged", body=f"SELECT ticker, trading_date, {_lag_sql()} FROM lagged"),
)
def return_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prices.with_lags(prices.with_returns(bars(spark, sf_dir)))
    return _rounded(rows.select("ticker", "trading_date", *PRICE_FEATURES), PRICE_FEATURES)


@register(
    "price_timeline",
    with_views("master", body=f"SELECT ticker, trading_date, target_next_day::TINYINT AS target_next_day, {_lag_sql()} "
               "FROM master"),
)
def price_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timeline(spark, sf_dir), PRICE_FEATURES)


@register(
    "price_timeline_range",
    """WITH prices AS (SELECT o_orderpriority AS ticker, o_orderdate::DATE AS trading_date,
  max_by(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2),
chosen AS (SELECT * FROM prices WHERE trading_date BETWEEN DATE '1996-10-20' AND DATE '1999-12-31'),
returns AS (SELECT *, close / lag(close) OVER w - 1 AS r FROM chosen WINDOW w AS (PARTITION BY ticker ORDER BY trading_date)),
lagged AS (SELECT *, lag(r, 5) OVER w AS r5, lead(r) OVER w AS nxt FROM returns
  WINDOW w AS (PARTITION BY ticker ORDER BY trading_date))
SELECT ticker, count(*) AS days, sum(CASE WHEN nxt > 0 THEN 1 ELSE 0 END)::BIGINT AS up_days,
min(trading_date) AS first_date, max(trading_date) AS last_date FROM lagged
WHERE r5 IS NOT NULL AND nxt IS NOT NULL GROUP BY 1""",
)
def price_timeline_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prices.price_timeline(standins.prices(spark, sf_dir), "1996-10-20", "1999-12-31")
    return rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("target_next_day").alias("up_days"),
        F.min("trading_date").alias("first_date"),
        F.max("trading_date").alias("last_date"),
    )


@register(
    "updown_label",
    with_views("prices", body="""SELECT ticker, trading_date, open, high, low, close, volume,
up_down::TINYINT AS up_down FROM (SELECT *, CASE WHEN close > lag(close) OVER w THEN 1
WHEN lag(close) OVER w IS NOT NULL THEN 0 END AS up_down FROM prices
WINDOW w AS (PARTITION BY ticker ORDER BY trading_date)) WHERE up_down IS NOT NULL"""),
)
def updown_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.up_down_days(bars(spark, sf_dir))


@register(
    "first_price_days",
    with_views("prices", body="SELECT trading_date AS date, ticker, close FROM prices ORDER BY trading_date, ticker LIMIT 200"),
)
def first_price_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_days(standins.prices(spark, sf_dir), 200).select("date", "ticker", "close")


@register(
    "standardise_date",
    "SELECT strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')::DATE AS trading_date, count(*) AS n "
    "FROM orders GROUP BY 1",
)
def standardise_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = standins.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").cast("string").alias("date"))
    parsed = prices.standardise_date(text, "date")
    return parsed.groupBy("trading_date").agg(F.count(F.lit(1)).alias("n"))


@register(
    "ticker_stack",
    "SELECT ticker, source, count(*) AS n FROM (SELECT o_orderpriority AS ticker, 'orders' AS source FROM orders "
    "UNION ALL SELECT event_type, 'events' FROM events) GROUP BY 1, 2",
)
def ticker_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = standins.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker"))
    events = standins.table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"))
    stacked = orders.withColumn("source", F.lit("orders")).unionByName(events.withColumn("source", F.lit("events")))
    return stacked.groupBy("ticker", "source").agg(F.count(F.lit(1)).alias("n"))


# Master table


@register(
    "master_join",
    with_views("master_sent", body=f"""SELECT trading_date, ticker, target_next_day::TINYINT AS target_next_day,
{r6('return_lag0')}, {r6('avg_pos')}, {r6('avg_neg')}, {r6('avg_neu')}, daily_article_count FROM master_sent"""),
)
def master_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = master_table(spark, sf_dir).select(*KEYS, "target_next_day", "return_lag0", *SENTIMENT)
    return _rounded(rows, ["return_lag0", *SENTIMENT[:3]])


@register(
    "master_hybrid",
    with_views("master_sent", body=f"""SELECT trading_date, target_next_day::TINYINT AS target_next_day, ticker,
{_lag_sql()}, {r6('avg_pos')}, {r6('avg_neg')}, {r6('avg_neu')}, daily_article_count FROM master_sent"""),
)
def master_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical column order and the columns of the hybrid mode."""
    groups = {"price": PRICE_FEATURES, "finbert": SENTIMENT}
    rows = master.reorder(master_table(spark, sf_dir), groups)
    chosen = master.feature_columns("hybrid_finbert", groups, rows.columns)
    rows = rows.select("trading_date", "target_next_day", "ticker", *chosen)
    return _rounded(rows, [*PRICE_FEATURES, *SENTIMENT[:3]])


@register(
    "feature_matrix",
    with_views("master_sent", body="SELECT trading_date, ticker, target_next_day::INTEGER AS label, "
               + ", ".join(r6(c, f"x{i}") for i, c in enumerate([*PRICE_FEATURES, *SENTIMENT])) + " FROM master_sent"),
)
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model input of the sentiment hybrid: keys, integer label, one vector."""
    from pyspark.ml.functions import vector_to_array

    groups = {"price": PRICE_FEATURES, "finbert_sent": SENTIMENT}
    chosen = master.feature_columns("finbert_sent_hybrid", groups, modes=master.NEURAL_MODES)
    rows = master.assemble(master_table(spark, sf_dir), chosen).withColumn("x", vector_to_array("features"))
    return rows.select(*KEYS, "label", *[rounded(F.get("x", i)).alias(f"x{i}") for i in range(len(chosen))])


# Windows


def _sequence_sql(columns: list[str], length: int, source: str) -> str:
    cells = []
    for step in range(length):
        for i, c in enumerate(columns):
            back = length - 1 - step
            cells.append(r6(f"lag({c}, {back}) OVER w" if back else c, f"w{step}_{i}"))
    return (
        f"SELECT trading_date, ticker, target_next_day::TINYINT AS target, {', '.join(cells)} FROM {source} "
        f"WINDOW w AS (PARTITION BY ticker ORDER BY trading_date) "
        f"QUALIFY row_number() OVER w >= {length}"
    )


def _sequence_columns(windows: DataFrame, columns: list[str], length: int) -> DataFrame:
    flat = sequences.flatten_windows(windows)
    cells = [
        rounded(F.get("window", step * len(columns) + i)).alias(f"w{step}_{i}")
        for step in range(length)
        for i in range(len(columns))
    ]
    return flat.select("trading_date", "ticker", "target", *cells)


@register("sequence_windows", with_views("master", body=_sequence_sql(["return_lag0"], 5, "master")))
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = sequences.sequence_windows(timeline(spark, sf_dir), ["return_lag0"], 5)
    return _sequence_columns(windows, ["return_lag0"], 5)


HYBRID_STEP = ["return_lag0", "avg_pos", "avg_neg"]


@register("sequence_windows_hybrid", with_views("master_sent", body=_sequence_sql(HYBRID_STEP, 3, "master_sent")))
def sequence_windows_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"finbert_sent": ["avg_pos", "avg_neg"]}
    chosen = master.feature_columns("finbert_sent_hybrid", groups, modes=master.NEURAL_MODES, sequences=True)
    windows = sequences.sequence_windows(master_table(spark, sf_dir), chosen, 3)
    return _sequence_columns(windows, chosen, 3)


# Splits


@register(
    "row_count_split",
    with_views("cut", body="""SELECT trading_session_date_utc,
CASE WHEN trading_session_date_utc < (SELECT cutoff FROM cut) THEN 'train'
WHEN trading_session_date_utc >= (SELECT cutoff FROM cut) THEN 'test' END AS split FROM session_days"""),
)
def row_count_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = standins.session_articles(spark, sf_dir).select(SESSION).distinct()
    return splits.row_count_split(days, SESSION)


@register("row_positions", with_views("placed", body="SELECT trading_date, ticker, pos AS position FROM placed"))
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(timeline(spark, sf_dir).select(*KEYS), "trading_date", "ticker")


@register(
    "tail_split",
    with_views("placed", body="""SELECT trading_date, ticker,
CASE WHEN pos >= n - ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM placed"""),
)
def tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.tail_split(timeline(spark, sf_dir).select(*KEYS), "trading_date", "ticker")


@register(
    "tail_split_dates",
    with_views("placed", body="""SELECT trading_date, ticker, CASE WHEN trading_date >=
(SELECT trading_date FROM placed WHERE pos = n - ceil(n * 0.3::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM placed"""),
)
def tail_split_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline(spark, sf_dir).select(*KEYS)
    return splits.tail_split(rows, "trading_date", "ticker", align_dates=True)


@register(
    "three_way_split",
    with_views("placed", body="""SELECT trading_date, ticker, CASE WHEN pos < floor(n * 0.6::DOUBLE) THEN 'train'
WHEN pos < floor(n * 0.6::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM placed"""),
)
def three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline(spark, sf_dir).select(*KEYS)
    return splits.three_way_split(rows, "trading_date", "ticker", 0.6, 0.15)


_FOLDS = """SELECT trading_date, ticker, fold::INTEGER AS fold,
CASE WHEN pos >= n - (6 - fold) * (n // 6) THEN 'test' ELSE 'train' END AS role
FROM placed, generate_series(1, 5) f(fold) WHERE pos < n - (5 - fold) * (n // 6)"""


@register("expanding_folds", with_views("placed", body=_FOLDS))
def expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.expanding_folds(timeline(spark, sf_dir).select(*KEYS), "trading_date", "ticker")


@register("last_fold", with_views("placed", body=_FOLDS + " AND fold = 5"))
def last_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.last_fold(timeline(spark, sf_dir).select(*KEYS), "trading_date", "ticker")


# Scaling


def _with_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.three_way_split(timeline(spark, sf_dir), "trading_date", "ticker", 0.6, 0.15)


def _scaled_sql(deviation: str, extra: str) -> str:
    cells = [
        r6(f"({c} - (SELECT avg({c}) FROM train)) / ((SELECT {deviation}({c}) FROM train){extra})", c)
        for c in ("return_lag0", "return_lag5")
    ]
    return f"""SELECT trading_date, ticker, {', '.join(cells)} FROM placed"""


def _train_view(body: str) -> str:
    return with_views("placed", body="") + ",\ntrain AS (SELECT * FROM placed WHERE pos < floor(n * 0.6::DOUBLE))\n" + body


@register("zscore_train", _train_view(_scaled_sql("stddev_samp", " + 1e-7")))
def zscore_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_split(spark, sf_dir)
    columns = ["return_lag0", "return_lag5"]
    scaled = scaling.zscore(rows, rows.where("split = 'train'"), columns)
    return _rounded(scaled.select(*KEYS, *columns), columns)


@register("zscore_population", _train_view(_scaled_sql("stddev_pop", "")))
def zscore_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_split(spark, sf_dir)
    columns = ["return_lag0", "return_lag5"]
    scaled = scaling.standardise(rows, rows.where("split = 'train'"), columns)
    return _rounded(scaled.select(*KEYS, *columns), columns)


@register("population_scaler", _train_view(_scaled_sql("stddev_pop", "")))
def population_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the pipeline stage."""
    from pyspark.ml.functions import vector_to_array

    columns = ["return_lag0", "return_lag5"]
    rows = _with_split(spark, sf_dir)
    vectors = master.assemble(rows, columns, keep=[*KEYS, "split"])
    model = scaling.PopulationScaler().fit(vectors.where("split = 'train'"))
    out = model.transform(vectors).withColumn("x", vector_to_array("scaled"))
    return out.select(*KEYS, *[rounded(F.get("x", i)).alias(c) for i, c in enumerate(columns)])


_WINDOW_VIEWS = """,
windows AS (SELECT trading_date, ticker, [lag(return_lag0, 4) OVER w, lag(return_lag0, 3) OVER w,
    lag(return_lag0, 2) OVER w, lag(return_lag0, 1) OVER w, return_lag0] AS win
  FROM master WINDOW w AS (PARTITION BY ticker ORDER BY trading_date) QUALIFY row_number() OVER w >= 5),
ranked AS (SELECT *, row_number() OVER (ORDER BY trading_date, ticker) - 1 AS pos, count(*) OVER () AS n FROM windows),
cells AS (SELECT unnest(win) AS v FROM ranked WHERE pos < floor(n * 0.6::DOUBLE))
"""


@register(
    "zscore_sequence",
    with_views("master", body="") + _WINDOW_VIEWS + "SELECT trading_date, ticker, " + ", ".join(
        r6(f"(win[{i + 1}] - (SELECT avg(v) FROM cells)) / ((SELECT stddev_samp(v) FROM cells) + 1e-7)", f"w{i}")
        for i in range(5)
    ) + " FROM ranked",
)
def zscore_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = sequences.sequence_windows(timeline(spark, sf_dir), ["return_lag0"], 5)
    windows = splits.three_way_split(windows, "trading_date", "ticker", 0.6, 0.15)
    stats = sequences.window_stats(windows.where("split = 'train'"))
    scaled = sequences.flatten_windows(sequences.scale_windows(windows, stats))
    return scaled.select(*KEYS, *[rounded(F.get("window", i)).alias(f"w{i}") for i in range(5)])


# Baseline and backtest


@register(
    "always_up",
    with_views("placed", body=f"SELECT {r6('avg(target_next_day)', 'baseline_accuracy')} FROM placed "
               "WHERE pos >= n - ceil(n * 0.3::DOUBLE)"),
)
def always_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.operators.metrics import always_up as baseline

    test = splits.tail_split(timeline(spark, sf_dir), "trading_date", "ticker").where("split = 'test'")
    return baseline(test).select(rounded("baseline_accuracy").alias("baseline_accuracy"))


def _test_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail of the timeline with a momentum rule as prediction."""
    rows = backtest.with_future_return(timeline(spark, sf_dir))
    rows = rows.withColumn("prediction", (F.col("return_lag3") > 0).cast("int"))
    return splits.tail_split(rows, "trading_date", "ticker").where("split = 'test'")


def _logs(curves: DataFrame, *keys: str) -> DataFrame:
    """Growth as logarithms: the stand-in prices jump so much that it spans many magnitudes."""
    logs = [rounded(F.log(c)).alias(f"log_{c}") for c in ("strategy", "market")]
    return curves.select(*keys, *logs)


_TEST_VIEWS = """,
future AS (SELECT *, coalesce(lead(return_lag0) OVER w, 0) AS future_return,
  CASE WHEN return_lag3 > 0 THEN 1 ELSE 0 END AS prediction
  FROM placed WINDOW w AS (PARTITION BY ticker ORDER BY trading_date)),
test AS (SELECT *, lead(trading_date) OVER w AS more FROM future
  WHERE pos >= n - ceil(n * 0.3::DOUBLE) WINDOW w AS (PARTITION BY ticker ORDER BY trading_date))
"""


def _growth_sql(market: str, condition: str) -> str:
    curve = "PARTITION BY ticker ORDER BY trading_date"
    return (
        with_views("placed", body="") + _TEST_VIEWS
        + f"SELECT ticker, row_number() OVER ({curve}) AS step, "
        + r6(f"ln(product(1 + prediction * {market}) OVER ({curve}))", "log_strategy") + ", "
        + r6(f"ln(product(1 + {market}) OVER ({curve}))", "log_market")
        + f" FROM test WHERE {condition} UNION ALL "
        + f"SELECT DISTINCT ticker, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE FROM test WHERE {condition}"
    )


@register("backtest_next_day", _growth_sql("future_return", "more IS NOT NULL"))
def backtest_next_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logs(backtest.backtest(_test_slice(spark, sf_dir)), "ticker", "step")


@register("backtest_same_day", _growth_sql("return_lag0", "true"))
def backtest_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logs(backtest.backtest(_test_slice(spark, sf_dir), "same_day"), "ticker", "step")


@register(
    "backtest_pooled",
    with_views("placed", body="") + _TEST_VIEWS + f"""SELECT trading_date,
{r6('sum(s) OVER (ORDER BY trading_date)', 'log_strategy')}, {r6('sum(m) OVER (ORDER BY trading_date)', 'log_market')}
FROM (SELECT trading_date, sum(ln(1 + prediction * future_return)) AS s, sum(ln(1 + future_return)) AS m
  FROM test WHERE more IS NOT NULL GROUP BY 1)""",
)
def backtest_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = backtest.pooled_growth(backtest.strategy_returns(_test_slice(spark, sf_dir)))
    return _logs(curve, "trading_date")


@register(
    "future_return",
    with_views("master", body=f"SELECT ticker, trading_date, {r6('coalesce(lead(return_lag0) OVER w, 0)', 'future_return')} "
               "FROM master WINDOW w AS (PARTITION BY ticker ORDER BY trading_date)"),
)
def future_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = backtest.with_future_return(timeline(spark, sf_dir))
    return rows.select("ticker", "trading_date", rounded("future_return").alias("future_return"))
