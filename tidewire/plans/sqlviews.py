"""DuckDB forms of the stand-in views, put together as WITH clauses."""

from __future__ import annotations

from tidewire.functions.stopwords import ENGLISH, VECTORISER
from tidewire.operators.calendar import exchange_holidays
from tidewire.plans.standins import FIRST_DAY, LAST_DAY

_CLOSED = ", ".join(f"DATE '{d}'" for d in exchange_holidays(FIRST_DAY.year, LAST_DAY.year))
STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
SECOND_STOP = ", ".join(f"'{w}'" for w in VECTORISER)
# White space as Unicode defines it, since RE2 knows only the ASCII part under \s.
_SPACE = r"\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def news_time(key: str) -> str:
    return (
        f"TIMESTAMP '1995-01-02' + to_days(CAST({key} % 2000 AS INTEGER)) "
        f"+ to_hours(CAST(({key} * 7) % 24 AS BIGINT))"
    )


def candidate(ts: str = "date_utc") -> str:
    return f"CASE WHEN hour({ts}) < 20 THEN {ts}::DATE ELSE {ts}::DATE + 1 END"


def normalised(c: str) -> str:
    return (
        f"regexp_replace(regexp_replace(lower({c}), '\\p{{Nd}}+', 'num', 'g'), '[^a-z{_SPACE}]', '', 'g')"
    )


def _in_session(source: str) -> str:
    return f"""SELECT a.* EXCLUDE (cand), c.trading_date AS trading_session_date_utc
  FROM (SELECT *, {candidate()} AS cand FROM {source}) a
  ASOF LEFT JOIN calendar c ON a.cand <= c.trading_date"""


# Each view names the views it needs.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "calendar": (
        (),
        f"""SELECT d::DATE AS trading_date
  FROM generate_series(DATE '{FIRST_DAY}', DATE '{LAST_DAY}', INTERVAL 1 DAY) t(d)
  WHERE isodow(d) < 6 AND d::DATE NOT IN ({_CLOSED})""",
    ),
    "articles": (
        (),
        f"""SELECT doc_id AS article_id, {news_time('doc_id')} AS date_utc, text AS Article_title,
  source AS Stock_symbol FROM documents""",
    ),
    "event_articles": (
        (),
        """SELECT event_id AS article_id, ts AS date_utc, props AS Article_title, event_type AS Stock_symbol,
  user_id, value FROM events""",
    ),
    "session_articles": (("calendar", "articles"), _in_session("articles")),
    "logits": (
        (),
        f"""SELECT vec_id AS article_id, {news_time('vec_id')} AS date_utc, embedding,
  embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings""",
    ),
    "weights": (
        ("logits",),
        """SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb,
  exp(c - greatest(a, b, c)) AS ec FROM logits""",
    ),
    "scored_articles": (
        ("weights",),
        """SELECT article_id, date_utc, embedding, ea / (ea + eb + ec) AS sent_pos, eb / (ea + eb + ec) AS sent_neg,
  ec / (ea + eb + ec) AS sent_neu FROM weights""",
    ),
    "session_scores": (("calendar", "scored_articles"), _in_session("scored_articles")),
    "daily_sentiment": (
        ("session_scores",),
        """SELECT trading_session_date_utc, avg(sent_pos) AS avg_pos, avg(sent_neg) AS avg_neg,
  avg(sent_neu) AS avg_neu, count(*) AS daily_article_count FROM session_scores GROUP BY 1""",
    ),
    "prices": (
        (),
        """SELECT o_orderpriority AS ticker, o_orderdate::DATE AS trading_date,
  min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  max_by(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2""",
    ),
    "returns": (
        ("prices",),
        """SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY trading_date) - 1 AS return_lag0
  FROM prices""",
    ),
    "lagged": (
        ("returns",),
        "SELECT trading_date, ticker, return_lag0, "
        + "CASE WHEN lead(return_lag0) OVER w IS NULL THEN NULL "
        + "WHEN lead(return_lag0) OVER w > 0 THEN 1 ELSE 0 END AS target_next_day, "
        + ", ".join(f"lag(return_lag0, {i}) OVER w AS return_lag{i}" for i in range(1, 6))
        + " FROM returns WINDOW w AS (PARTITION BY ticker ORDER BY trading_date)",
    ),
    "master": (
        ("lagged",),
        """SELECT * FROM lagged WHERE return_lag5 IS NOT NULL AND target_next_day IS NOT NULL
  AND return_lag0 IS NOT NULL""",
    ),
    "placed": (
        ("master",),
        "SELECT *, row_number() OVER (ORDER BY trading_date, ticker) - 1 AS pos, count(*) OVER () AS n FROM master",
    ),
    "master_sent": (
        ("master", "daily_sentiment"),
        """SELECT m.*, coalesce(s.avg_pos, 0) AS avg_pos, coalesce(s.avg_neg, 0) AS avg_neg,
  coalesce(s.avg_neu, 0) AS avg_neu, coalesce(s.daily_article_count, 0) AS daily_article_count
  FROM master m LEFT JOIN daily_sentiment s ON m.trading_date = s.trading_session_date_utc""",
    ),
    "predictions": (
        (),
        """SELECT doc_id, quality AS label, ((doc_id * 37) % 101) / 100.0::DOUBLE AS probability,
  CASE WHEN ((doc_id * 37) % 101) / 100.0::DOUBLE > 0.5 THEN 1 ELSE 0 END AS prediction FROM labels""",
    ),
    "cleaned": (
        ("session_articles",),
        f"""SELECT trading_session_date_utc, article_id, array_to_string(list_filter(
  regexp_extract_all({normalised('Article_title')}, '[a-z]+'),
  lambda w: w NOT IN ({STOP})), ' ') AS clean_text FROM session_articles""",
    ),
    "token_counts": (
        ("cleaned",),
        f"""SELECT trading_session_date_utc, term, count(*) AS tf FROM (
  SELECT trading_session_date_utc, unnest(regexp_extract_all(clean_text, '[a-z][a-z]+')) AS term FROM cleaned)
  WHERE term NOT IN ({SECOND_STOP}) GROUP BY 1, 2""",
    ),
    "session_days": (
        ("session_articles",),
        """SELECT trading_session_date_utc, row_number() OVER (ORDER BY trading_session_date_utc) - 1 AS pos,
  count(*) OVER () AS n FROM (SELECT DISTINCT trading_session_date_utc FROM session_articles)""",
    ),
    "cut": (
        ("session_days",),
        """SELECT trading_session_date_utc AS cutoff FROM session_days WHERE pos = floor(n * 0.7::DOUBLE)""",
    ),
    "vocab": (
        ("token_counts", "cut", "session_days"),
        """SELECT term, cf, df, ln((1.0 + (SELECT count(*) FROM session_days
    WHERE trading_session_date_utc < (SELECT cutoff FROM cut))) / (1.0 + df)) + 1.0 AS idf
  FROM (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM token_counts
    WHERE trading_session_date_utc < (SELECT cutoff FROM cut) GROUP BY term)
  ORDER BY cf DESC, term LIMIT 5000""",
    ),
    "raw_weights": (
        ("token_counts", "vocab"),
        "SELECT trading_session_date_utc, term, tf * idf AS raw FROM token_counts JOIN vocab USING (term)",
    ),
    "tfidf": (
        ("raw_weights",),
        """SELECT trading_session_date_utc, term,
  raw / sqrt(sum(raw * raw) OVER (PARTITION BY trading_session_date_utc)) AS weight FROM raw_weights""",
    ),
}


def with_views(*names: str, body: str) -> str:
    """``body`` preceded by the named views and all they need, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        needs, _ = VIEWS[name]
        for need in needs:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in ordered]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def r6(expression: str, name: str | None = None) -> str:
    """Six digits, no negative zero; for comparing floating-point results."""
    text = f"round(({expression})::DOUBLE, 6) + 0.0::DOUBLE"
    return f"{text} AS {name or expression}"
