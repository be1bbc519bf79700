"""TF-IDF on long ``(session, term, weight)`` rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.stopwords import ENGLISH, VECTORISER
from tidewire.functions.text import normalise, sql_list, stem_vocabulary, tokens, words
from tidewire.operators.sessions import SESSION
from tidewire.session import GATHERED_BYTES, materialise, spread


def daily_tokens(
    articles: DataFrame,
    session: str = SESSION,
    text: str = "Article_title",
    stop: Sequence[str] = ENGLISH,
    stemmed: bool = False,
    cleaned: bool = False,
    second_stop: Sequence[str] = VECTORISER,
) -> DataFrame:
    """Term counts per session as ``(session, term, tf)``.

    Texts are cleaned first unless they are ``cleaned`` already; terms have two
    letters or more and are not in the ``second_stop`` list, which is applied last.

    Tokenising each article and adding up equals tokenising the joined session
    text, so that text is never built.  Counts are combined inside each task before
    the shuffle.  With ``stemmed`` the words are counted first and stemmed once per
    session and word, not once per occurrence.
    """
    found = tokens(text, ()) if cleaned else words(normalise(text), stop)
    every_word = articles.select(session, F.explode(found).alias("term"))
    if not stemmed:
        kept = _final_terms(every_word, second_stop if cleaned or second_stop != stop else ())
        return kept.groupBy(session, "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = materialise(every_word.groupBy(session, "term").agg(F.count(F.lit(1)).alias("tf")), "word-counts")
    stems = materialise(stem_vocabulary(counted, "term"), "stems")
    # parts of a bounded size, and no sort: a task holds the words of its part and the counts it adds up
    counted = spread(counted, "term", most=GATHERED_BYTES)
    stems = counted.join(stems.hint("shuffle_hash"), "term").select(session, F.col("stem").alias("term"), "tf")
    return _final_terms(stems, second_stop).groupBy(session, "term").agg(F.sum("tf").alias("tf"))


def _final_terms(df: DataFrame, stop: Sequence[str]) -> DataFrame:
    kept = df.where(F.length("term") >= 2)
    return kept.where(f"term NOT IN ({sql_list(stop)})") if stop else kept


def fit_vocabulary(train_tokens: DataFrame, n_docs: Column | int, max_features: int = 5000) -> DataFrame:
    """The ``max_features`` most frequent terms with ``(term, cf, df, idf)``.

    Frequency ties go to the alphabetically smaller term.  ``idf`` is the smooth
    form ln((1 + n) / (1 + df)) + 1, ``n_docs`` the number of training sessions.
    """
    counted = train_tokens.groupBy("term").agg(
        F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")
    )
    top = counted.orderBy(F.desc("cf"), "term").limit(max_features)
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return top.withColumn("idf", F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0)


def weigh(all_tokens: DataFrame, vocabulary: DataFrame, session: str = SESSION) -> DataFrame:
    """Weights with rows of length 1: ``(session, term, weight)``.

    The size of the vocabulary is known from its limit or its table, so Spark broadcasts
    a small one and shuffles a large one.  After the join a session has at most that
    many rows, which bounds the norm window.
    """
    raw = all_tokens.join(vocabulary.select("term", "idf"), "term")
    raw = raw.select(session, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(session)))
    return raw.select(session, "term", (F.col("raw") / norm).alias("weight"))


@dataclass
class TfidfModel:
    """A fitted vocabulary; transforms token counts of any session."""

    vocabulary: DataFrame
    session: str = SESSION

    def terms(self) -> list[str]:
        """Vocabulary in alphabetical order (bounded by ``max_features``)."""
        return [r[0] for r in self.vocabulary.select("term").orderBy("term").collect()]

    def transform(self, all_tokens: DataFrame) -> DataFrame:
        return weigh(all_tokens, self.vocabulary, self.session)

    def to_vectors(self, all_tokens: DataFrame, sessions: DataFrame) -> DataFrame:
        """One sparse vector per row of ``sessions``; sessions without terms get the zero vector.

        The column says how long its vectors are, so no later step has to compute one to find out.
        """
        ordered = Window.orderBy("term")
        index = self.vocabulary.select("term", (F.row_number().over(ordered) - 1).alias("index"))
        size = self.vocabulary.count()

        @F.udf(VectorUDT())
        def sparse(cells):
            cells = sorted((c["index"], c["weight"]) for c in cells or [])
            return Vectors.sparse(size, [i for i, _ in cells], [w for _, w in cells])

        placed = self.transform(all_tokens).join(index, "term")
        cells = placed.groupBy(self.session).agg(F.collect_list(F.struct("index", "weight")).alias("cells"))
        rows = sessions.select(self.session).distinct().join(cells, self.session, "left")
        return rows.select(self.session, sparse("cells").alias("tfidf", metadata={"ml_attr": {"num_attrs": size}}))

    def to_wide(self, all_tokens: DataFrame, sessions: DataFrame, terms: Sequence[str] | None = None) -> DataFrame:
        """One column per term, the session first; absent terms are 0."""
        terms = list(terms) if terms is not None else self.terms()
        pivot = self.transform(all_tokens).groupBy(self.session).pivot("term", terms).agg(F.first("weight"))
        rows = sessions.select(self.session).distinct().join(pivot, self.session, "left")
        return rows.select(self.session, *[F.coalesce(F.col(f"`{t}`"), F.lit(0.0)).alias(t) for t in terms])


@dataclass
class TfidfVectorizer:
    """Fits the vocabulary on training sessions only."""

    max_features: int = 5000
    session: str = SESSION

    def fit(self, train_tokens: DataFrame, train_sessions: DataFrame) -> TfidfModel:
        n_docs = train_sessions.select(self.session).distinct().count()
        vocabulary = fit_vocabulary(train_tokens, n_docs, self.max_features)
        return TfidfModel(materialise(vocabulary, "vocabulary"), self.session)


def top_words(weights: DataFrame, n_sessions: Column, k: int | None = 20) -> DataFrame:
    """Mean weight per word over all sessions, zeros counted; the ``k`` highest."""
    mean = weights.groupBy("term").agg((F.sum("weight") / n_sessions).alias("average_tfidf"))
    mean = mean.withColumnRenamed("term", "word")
    return mean if k is None else mean.orderBy(F.desc("average_tfidf"), "word").limit(k)


def vocabulary_contains(vocabulary: DataFrame, word: str = "the") -> DataFrame:
    """Sanity check: a removed stop word must not be in the vocabulary."""
    hits = F.count_if(F.col("term") == word)
    return vocabulary.agg(hits.alias("hits"), (hits == 0).alias("removed"))
