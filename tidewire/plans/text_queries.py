"""Queries over text: cleaning, term counts, vocabulary, TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.functions.numeric import rounded
from tidewire.operators import daily, splits, tfidf
from tidewire.operators.sessions import SESSION
from tidewire.plans import standins
from tidewire.plans.registry import register
from tidewire.plans.sqlviews import normalised, r6, with_views
from tidewire.session import materialise


def term_counts(spark: SparkSession, sf_dir: str, stemmed: bool = False, written: bool = True) -> DataFrame:
    """Term counts of all sessions, written once if several later steps read them."""
    counts = tfidf.daily_tokens(standins.session_articles(spark, sf_dir, gathered=True), stemmed=stemmed)
    return materialise(counts, "daily-tokens") if written else counts


def session_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.session_articles(spark, sf_dir).select(SESSION).distinct()


def fitted(
    spark: SparkSession, sf_dir: str, stemmed: bool = False, written: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Counts of all sessions, and the vocabulary of the first 70 % of the sessions."""
    counts, days = term_counts(spark, sf_dir, stemmed, written), session_days(spark, sf_dir)
    cut = splits.cutoff_date(days, SESSION)
    n_train = splits.total_rows(days.where(F.col(SESSION) < cut))
    return counts, tfidf.fit_vocabulary(counts.where(F.col(SESSION) < cut), n_train)


@register(
    "session_text",
    with_views("session_articles", body="""SELECT trading_session_date_utc, 0 AS part,
string_agg(Article_title, ' ' ORDER BY date_utc, article_id) AS daily_text FROM session_articles GROUP BY 1"""),
)
def session_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.session_text(standins.session_articles(spark, sf_dir))


@register(
    "clean_text_nostem",
    with_views("cleaned", body="SELECT article_id, clean_text FROM cleaned"),
)
def clean_text_nostem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.articles(spark, sf_dir, heavy=True)
    return rows.select("article_id", text.clean("Article_title").alias("clean_text"))


@register(
    "normalised_text",
    f"SELECT doc_id, md5({normalised('text')}) AS digest, length({normalised('text')})::INTEGER AS chars FROM documents",
)
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = standins.table(spark, sf_dir, "documents").select("doc_id", text.normalise("text").alias("t"))
    return plain.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("chars"))


@register("clean_text_stemmed")
def clean_text_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.articles(spark, sf_dir, heavy=True)
    return rows.select("article_id", text.clean_and_stem("Article_title").alias("preprocessed_for_tfidf"))


@register("stem_vocabulary")
def stem_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.articles(spark, sf_dir, heavy=True)
    found = rows.select(F.explode(text.words(text.normalise("Article_title"))).alias("word"))
    return text.stem_vocabulary(found)


@register(
    "token_counts",
    with_views("token_counts", body="SELECT trading_session_date_utc, term, tf FROM token_counts"),
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.daily_tokens(standins.session_articles(spark, sf_dir, gathered=True))


@register("token_counts_stemmed")
def token_counts_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.daily_tokens(standins.session_articles(spark, sf_dir, gathered=True), stemmed=True)


@register("vocab_topk", with_views("vocab", body=f"SELECT term, cf, df, {r6('idf')} FROM vocab"))
def vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir, written=False)[1].withColumn("idf", rounded("idf"))


@register("tfidf_weights", with_views("tfidf", body=f"SELECT trading_session_date_utc, term, {r6('weight')} FROM tfidf"))
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = tfidf.weigh(*fitted(spark, sf_dir))
    return weights.withColumn("weight", rounded("weight"))


@register("tfidf_weights_stemmed")
def tfidf_weights_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.weigh(*fitted(spark, sf_dir, stemmed=True))


@register(
    "tfidf_top_words",
    with_views("tfidf", body=f"""SELECT term AS word,
{r6('sum(weight) / (SELECT count(*) FROM session_days)', 'average_tfidf')} FROM tfidf GROUP BY 1
ORDER BY sum(weight) DESC, term LIMIT 20"""),
)
def tfidf_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = tfidf.weigh(*fitted(spark, sf_dir))
    top = tfidf.top_words(weights, splits.total_rows(session_days(spark, sf_dir)))
    return top.withColumn("average_tfidf", rounded("average_tfidf"))


# Frequent function words of the other three languages, which the stop lists leave in.
WIDE_TERMS = ["der", "die", "el", "la", "les", "que", "und"]


@register(
    "tfidf_wide",
    with_views("tfidf", body="SELECT trading_session_date_utc, " + ", ".join(
        r6(f"coalesce(max(CASE WHEN term = '{t}' THEN weight END), 0)", t) for t in WIDE_TERMS)
        + " FROM (SELECT DISTINCT trading_session_date_utc FROM session_articles) "
        "LEFT JOIN tfidf USING (trading_session_date_utc) GROUP BY 1"),
)
def tfidf_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, vocabulary = fitted(spark, sf_dir)
    wide = tfidf.TfidfModel(vocabulary).to_wide(counts, session_days(spark, sf_dir), WIDE_TERMS)
    return wide.withColumns({t: rounded(t) for t in WIDE_TERMS})


@register(
    "vocabulary_stop_check",
    with_views("vocab", body="""SELECT count(*) FILTER (term = 'the') AS hits,
count(*) FILTER (term = 'the') = 0 AS removed FROM vocab"""),
)
def vocabulary_stop_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.vocabulary_contains(fitted(spark, sf_dir, written=False)[1])


@register("tfidf_vectors")
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse vectors from a fitted model; size and number of non-zero entries per session."""
    from pyspark.ml.functions import vector_to_array

    counts, days = term_counts(spark, sf_dir), session_days(spark, sf_dir)
    train = splits.row_count_split(days, SESSION).where("split = 'train'")
    model = tfidf.TfidfVectorizer().fit(counts.join(F.broadcast(train.select(SESSION)), SESSION, "left_semi"), train)
    cells = model.to_vectors(counts, days).withColumn("x", vector_to_array("tfidf"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    return cells.select(
        SESSION, F.size("x").alias("width"), F.size(F.filter("x", lambda v: v > 0)).alias("terms"), rounded(norm).alias("norm")
    )
