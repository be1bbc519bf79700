"""Daily features, text, TF-IDF, prices, windows, splits, scaling."""

import math
import random
from collections import Counter
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidewire.functions import numeric, porter, text
from tidewire.functions.stopwords import ENGLISH, FURTHER, VECTORISER
from tidewire.operators import daily, master, prices, quality, reduction, scaling, scoring, sequences, splits, tfidf
from tidewire.operators.calendar import trading_calendar
from tidewire.operators.sessions import SESSION, assign_sessions

SCORED = "date_utc timestamp_ntz, sent_pos double, sent_neg double, sent_neu double"


def sentiment_rows(spark):
    pos, neg = [0.1, 0.3, 0.5, 0.2, 0.4, 0.6], [0.2, 0.1, 0.2, 0.3, 0.1, 0.2]
    neu, days = [0.7, 0.6, 0.3, 0.5, 0.5, 0.2], [1, 1, 1, 1, 1, 2]
    return spark.createDataFrame(
        [(datetime(2024, 1, d), p, n, u) for d, p, n, u in zip(days, pos, neg, neu)], SCORED
    )


def test_daily_sentiment_by_calendar_day(spark):
    rows = daily.daily_sentiment(daily.by_calendar_day(sentiment_rows(spark)), "date_utc").orderBy("date_utc").collect()
    assert [r["date_utc"] for r in rows] == [date(2024, 1, 1), date(2024, 1, 2)]
    assert [tuple(round(v, 6) for v in r[1:]) for r in rows] == [(0.3, 0.18, 0.52, 5), (0.6, 0.2, 0.2, 1)]
    assert all(abs(r[1] + r[2] + r[3] - 1) < 1e-5 for r in rows)


def test_daily_sentiment_by_session(spark):
    calendar = trading_calendar(spark, date(2023, 12, 27), date(2024, 1, 12))
    rows = daily.daily_sentiment(assign_sessions(sentiment_rows(spark), calendar=calendar)).collect()
    assert len(rows) == 1 and rows[0][SESSION] == date(2024, 1, 2)
    assert rows[0]["avg_pos"] == pytest.approx(0.35) and rows[0]["daily_article_count"] == 6


@pytest.mark.parametrize("width", [4, 768])
def test_daily_embedding(spark, width):
    noise = np.random.default_rng(1).random(width).astype("float32").tolist()
    data = [(date(2024, 1, 1), [0.0] * width), (date(2024, 1, 1), [2.0] * width), (date(2024, 1, 2), noise)]
    df = spark.createDataFrame(data + [(date(2024, 1, 2), None)], "day date, finbert_embedding array<float>")
    got = {r["day"].day: r["daily_embedding"] for r in daily.daily_embedding(df, "day").collect()}
    assert got == {1: [1.0] * width, 2: noise}


def test_merge_sessions_weights_by_count(spark):
    schema = f"{SESSION} date, avg_pos double, avg_neg double, avg_neu double, daily_article_count long"
    d = date(2024, 1, 2)
    parts = spark.createDataFrame([(d, 0.2, 0.3, 0.5, 3), (d, 0.6, 0.3, 0.1, 1)], schema)
    row = daily.merge_sessions(parts).first()
    assert (row["avg_pos"], row["avg_neu"], row["daily_article_count"]) == (pytest.approx(0.3), pytest.approx(0.4), 4)
    vectors = spark.createDataFrame(
        [(d, [1.0, 0.0], 3), (d, [5.0, 4.0], 1)], f"{SESSION} date, daily_embedding array<float>, daily_article_count long"
    )
    assert daily.merge_embeddings(vectors).first()["daily_embedding"] == [2.0, 1.0]


def test_pooling(spark):
    data = [(1, 0, [1.0, 2.0], 1), (1, 1, [3.0, 6.0], 1), (1, 2, [9.0, 9.0], 0), (2, 0, [5.0, 5.0], 0)]
    df = spark.createDataFrame(data, "id int, pos int, v array<float>, m int")
    got = {r["id"]: r["embedding"] for r in daily.pool_tokens(df, "id", "pos", "v", "m").collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 0.0]}
    first = {r["id"]: r["embedding"] for r in daily.pool_tokens(df, "id", "pos", "v", "m", "cls").collect()}
    assert first == {1: [1.0, 2.0], 2: [5.0, 5.0]}


def test_softmax_is_stable(spark):
    row = spark.range(1).select(numeric.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(0.0))).alias("p")).first()
    assert row["p"] == [0.5, 0.5, 0.0]


# Text


def test_clean_without_stemming(spark):
    data = [("The 25 Markets aren't UP, 3%!",), ("",), (None,), ("Zwölf ١٢ x y",)]
    df = spark.createDataFrame(data, "t string")
    plain = [r[0] for r in df.select(text.normalise("t")).collect()]
    assert plain == ["the num markets arent up num", "", None, "zwlf num x y"]
    assert [r[0] for r in df.select(text.clean("t")).collect()] == ["num markets arent num", "", "", "zwlf num x"]
    assert text.ENGLISH is ENGLISH and len(ENGLISH) == 179 == len(set(ENGLISH))


def test_tokens(spark):
    df = spark.createDataFrame([("The cat, a dog & über-cat it's x1",)], "t string")
    assert df.select(text.tokens("t")).first()[0] == ["cat", "dog", "über", "cat", "x1"]


def test_script_filter_drops_null(spark):
    df = spark.createDataFrame([("рынок",), ("market",), (None,), ("ё",)], "t string")
    assert {r[0] for r in text.without_script(df, "t").collect()} == {"market", "ё"}


# Well-known input and output of the algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "valenci": "valenc",
    "digitizer": "digit", "radicalli": "radic", "differentli": "differ", "vietnamization": "vietnam",
    "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr", "hopeful": "hope",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ",
    "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "markets": "market", "rising": "rise", "generalizations": "gener", "oscillators": "oscil",
}


def test_stems():
    assert {w: porter.stem(w) for w in STEMS} == STEMS
    both = {w: porter.stem(w, extended=False) for w in STEMS if w not in ("sky",)}
    assert both == {w: s for w, s in STEMS.items() if w != "sky"}


def test_extended_stems():
    # Where the refined variant differs from the original.
    pairs = {
        "dies": ("die", "di"), "died": ("die", "di"), "dying": ("die", "dy"), "news": ("news", "new"),
        "as": ("as", "a"), "enjoy": ("enjoy", "enjoi"), "spied": ("spi", "spi"), "spy": ("spi", "spy"),
    }
    for word, (new, old) in pairs.items():
        assert (porter.stem(word), porter.stem(word, extended=False)) == (new, old), word


def test_clean_and_stem_equals_the_vocabulary_way(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    whole = {r[0]: r[1] for r in df.select("doc_id", text.clean_and_stem("text")).collect()}
    listed = {r[0]: r[1] for r in df.select("doc_id", text.words(text.normalise("text"))).collect()}
    words = df.select(F.explode(text.words(text.normalise("text"))).alias("word"))
    stems = {r["word"]: r["stem"] for r in text.stem_vocabulary(words).collect()}
    assert whole == {i: " ".join(stems[w] for w in ws) for i, ws in listed.items()}


# TF-IDF


def counts_frame(spark, docs):
    rows = [(s, t, n) for s, doc in docs.items() for t, n in Counter(doc.split()).items()]
    return spark.createDataFrame(rows, f"{SESSION} string, term string, tf long")


def test_smooth_tfidf(spark):
    counts = counts_frame(spark, {"a1": "up up gain", "a2": "gain loss"})
    vocabulary = tfidf.fit_vocabulary(counts, 2)
    idf = {r["term"]: r["idf"] for r in vocabulary.collect()}
    assert idf == pytest.approx({"gain": 1.0, "up": 1.405465, "loss": 1.405465}, abs=1e-6)
    weights = {(r[0], r["term"]): r["weight"] for r in tfidf.weigh(counts, vocabulary).collect()}
    assert weights["a1", "gain"] == pytest.approx(0.335176, abs=1e-6)
    assert weights["a1", "up"] == pytest.approx(0.942156, abs=1e-6)


def brute_tfidf(docs, train, cap):
    cf, df = Counter(), Counter()
    for s in train:
        words = docs[s].split()
        cf.update(words)
        df.update(set(words))
    terms = sorted(cf, key=lambda t: (-cf[t], t))[:cap]
    idf = {t: math.log((1 + len(train)) / (1 + df[t])) + 1 for t in terms}
    out = {}
    for s, doc in docs.items():
        raw = {t: n * idf[t] for t, n in Counter(doc.split()).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(s, t): v / norm for t, v in raw.items()})
    return sorted(terms), out


def test_tfidf_model_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = {f"s{i:02d}": " ".join(rng.choices(words, weights=range(1, 31), k=rng.randrange(1, 60))) for i in range(20)}
    docs["s05"] = "onlyonce"
    docs["s19"] = "neverseen"
    train = sorted(docs)[:14]
    counts = counts_frame(spark, docs)
    sessions = spark.createDataFrame([(s,) for s in docs], f"{SESSION} string")
    early = F.col(SESSION) < "s14"
    model = tfidf.TfidfVectorizer(max_features=25).fit(counts.where(early), sessions.where(early))
    terms, expected = brute_tfidf(docs, train, 25)
    assert model.terms() == terms
    got = {(r[0], r["term"]): r["weight"] for r in model.transform(counts).collect()}
    assert got == pytest.approx(expected)
    lengths = [sum(w * w for (s, _), w in got.items() if s == one) for one in {s for s, _ in got}]
    assert all(abs(v - 1) < 1e-9 for v in lengths)
    vectors = {r[SESSION]: r["tfidf"].toArray() for r in model.to_vectors(counts, sessions).collect()}
    assert set(vectors) == set(docs) and not vectors["s19"].any()
    for (s, t), w in expected.items():
        assert vectors[s][terms.index(t)] == pytest.approx(w)
    wide = model.to_wide(counts, sessions)
    assert wide.columns == [SESSION, *terms]
    assert {r[SESSION]: list(r)[1:] for r in wide.collect()} == {s: pytest.approx(v.tolist()) for s, v in vectors.items()}


def test_daily_tokens_equal_joined_text(spark, sf_dir):
    from tidewire.plans import standins

    rows = standins.session_articles(spark, sf_dir)
    joined = daily.session_text(rows).select(SESSION, F.explode(text.tokens(text.clean("daily_text"))).alias("term"))
    expected = joined.groupBy(SESSION, "term").count()
    got = tfidf.daily_tokens(rows)
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
    stemmed = daily.session_text(rows).select(SESSION, F.explode(text.tokens(text.clean_and_stem("daily_text"))).alias("term"))
    expected = stemmed.groupBy(SESSION, "term").count()
    got = tfidf.daily_tokens(rows, stemmed=True)
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_large_vocabulary(spark):
    counts = counts_frame(spark, {"a": "x y", "b": "x"})
    vocabulary = tfidf.fit_vocabulary(counts, 2, 10_000_000)
    assert {r["term"] for r in vocabulary.collect()} == {"x", "y"}
    assert tfidf.weigh(counts, vocabulary).count() == 3


def test_second_stop_list(spark):
    assert len(VECTORISER) == 318 and len(FURTHER) == len(set(FURTHER)) < 200
    rows = spark.createDataFrame([("s", "Profits would also amaze us")], f"{SESSION} string, Article_title string")
    assert {r["term"] for r in tfidf.daily_tokens(rows).collect()} == {"profits", "amaze"}
    assert {r["term"] for r in tfidf.daily_tokens(rows, stemmed=True).collect()} == {"profit", "amaz"}


# Prices and master table


def price_frame(spark, closes, ticker="A", start=date(2024, 1, 1)):
    rows = [(start + timedelta(days=i), c, ticker) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "date date, close double, ticker string")


FIFTEEN = [100.0, 110.0, 121.0, 133.1, 146.41, 161.05, 177.15, 194.87, 214.36, 235.79, 259.37, 285.31, 313.84, 345.22, 379.74]


def test_fifteen_days(spark):
    line = prices.price_timeline(price_frame(spark, FIFTEEN))
    rows = line.orderBy("trading_date").collect()
    assert [r["trading_date"].day for r in rows] == list(range(7, 15))
    assert all(r["target_next_day"] == 1 and r["return_lag0"] == pytest.approx(0.1, abs=1e-4) for r in rows)
    sentiment = spark.createDataFrame(
        [(date(2024, 1, d), float(d), float(-d)) for d in range(1, 16)],
        "trading_session_date_utc date, sentiment_pos double, sentiment_neg double",
    )
    joined = master.join_features(line, sentiment)
    columns = master.feature_columns(
        "finbert_sent_hybrid", {"finbert_sent": master.feature_names(sentiment)}, joined.columns, master.NEURAL_MODES, True
    )
    assert columns == ["return_lag0", "sentiment_pos", "sentiment_neg"]
    windows = sequences.sequence_windows(joined, columns, 3).orderBy("trading_date").collect()
    assert len(windows) == 6
    assert [[round(v, 1) for v in step] for step in windows[0]["window"]] == [[0.1, d, -d] for d in (7.0, 8.0, 9.0)]


def test_label_edges(spark):
    rows = prices.with_label(prices.with_returns(price_frame(spark, [10.0, 10.0, 9.0, 12.0]).withColumnRenamed("date", "trading_date")))
    got = rows.orderBy("trading_date").collect()
    assert [r["return_lag0"] for r in got] == [None, 0.0, pytest.approx(-0.1), pytest.approx(1 / 3)]
    assert [r["target_next_day"] for r in got] == [0, 0, 1, None]


def test_missing_and_zero_close(spark):
    rows = prices.with_returns(price_frame(spark, [10.0, None, 20.0, 0.0, 5.0]).withColumnRenamed("date", "trading_date"))
    got = [r["return_lag0"] for r in rows.orderBy("trading_date").collect()]
    assert got == [None, 0.0, 1.0, -1.0, None]


def test_up_down_days(spark):
    rows = prices.up_down_days(price_frame(spark, [10.0, 11.0, 11.0, None, 12.0, 13.0]).withColumnRenamed("date", "trading_date"))
    assert [(r["trading_date"].day, r["up_down"]) for r in rows.orderBy("trading_date").collect()] == [(2, 1), (3, 0), (6, 1)]


def test_tickers_do_not_mix(spark):
    both = price_frame(spark, FIFTEEN).unionByName(price_frame(spark, FIFTEEN[::-1], "B"))
    line = prices.price_timeline(both)
    assert {r["ticker"]: r["target_next_day"] for r in line.collect()} == {"A": 1, "B": 0}
    windows = sequences.sequence_windows(line, ["return_lag0"], 5)
    assert {r[0]: r[1] for r in windows.groupBy("ticker").count().collect()} == {"A": 4, "B": 4}


def test_range_needs_both_ends(spark):
    rows = price_frame(spark, FIFTEEN)
    assert prices.price_timeline(rows, date(2024, 1, 3)).count() == 8
    assert prices.price_timeline(rows, date(2024, 1, 3), date(2024, 1, 12)).count() == 3


def test_one_per_day(spark):
    rows = price_frame(spark, [1.0, 2.0]).unionByName(price_frame(spark, [3.0])).withColumnRenamed("date", "trading_date")
    got = prices.one_per_day(rows).orderBy("trading_date").collect()
    assert [(r["trading_date"].day, r["close"]) for r in got] == [(1, 3.0), (2, 2.0)]


def test_text_dates_are_parsed(spark):
    df = spark.createDataFrame([("2024-01-05",)], "date string")
    assert prices.standardise_date(df, "date").first()["trading_date"] == date(2024, 1, 5)
    bad = spark.createDataFrame([("5 Jan",)], "date string")
    with pytest.raises(Exception):
        prices.standardise_date(bad, "date").collect()
    assert prices.date_column(df) == "date"


def test_mode_selection():
    groups = {"finbert": ["p", "n"], "tfidf": []}
    assert master.feature_columns("hybrid_finbert", groups) == [*prices.PRICE_FEATURES, "p", "n"]
    assert master.feature_columns("price", {}, modes=master.NEURAL_MODES, sequences=True) == ["return_lag0"]
    for mode in ("nothing", "tfidf"):
        with pytest.raises(ValueError):
            master.feature_columns(mode, groups)
    with pytest.raises(ValueError, match="missing"):
        master.feature_columns("finbert", groups, available=["p"])


def test_no_news_is_zero_and_order_is_canonical(spark):
    line = prices.price_timeline(price_frame(spark, FIFTEEN))
    news = spark.createDataFrame([(date(2024, 1, 8), 0.5)], "date date, pos double")
    joined = master.join_features(line, news)
    assert [r["pos"] for r in joined.orderBy("trading_date").collect()] == [0.0, 0.5] + [0.0] * 6
    ordered = master.reorder(joined, {"price": prices.PRICE_FEATURES, "finbert": ["pos", "pos", "gone"]})
    assert ordered.columns == ["trading_date", "target_next_day", "ticker", *prices.PRICE_FEATURES, "pos"]
    assert master.date_first(joined, "pos").columns[0] == "pos"


# Splits and scaling


def day_rows(spark, n, per_day=1):
    rows = [(date(2024, 1, 1) + timedelta(days=i // per_day), f"t{i % per_day}", float(i)) for i in range(n)]
    random.Random(n).shuffle(rows)
    return spark.createDataFrame(rows, "d date, k string, x double")


def sides(df):
    return [r["split"] for r in df.orderBy("d", "k").collect()]


def test_position_splits(spark):
    rows = day_rows(spark, 10)
    assert rows.select(splits.cutoff_date(rows, "d", 0.7)).first()[0] == date(2024, 1, 8)
    assert sides(splits.tail_split(rows, "d", "k")) == ["train"] * 7 + ["test"] * 3
    assert sides(splits.three_way_split(rows, "d", "k", 0.6, 0.15)) == ["train"] * 6 + ["val"] + ["test"] * 3
    assert sides(splits.three_way_split(rows, "d", "k", 0.6, 0.0)) == ["train"] * 6 + ["test"] * 4


@pytest.mark.parametrize("n,per_day", [(12, 1), (13, 5), (100, 7), (101, 50)])
def test_splits_equal_slicing(spark, n, per_day):
    rows = day_rows(spark, n, per_day)
    cut = n - math.ceil(0.3 * n)
    for eager in (False, True):
        assert sides(splits.tail_split(rows, "d", "k", eager=eager)) == ["train"] * cut + ["test"] * (n - cut)
    assert sides(splits.tail_split(rows, "d", "k", 0.0, eager=True)) == ["train"] * n
    a, b = int(n * 0.6), int(n * 0.15)
    assert sides(splits.three_way_split(rows, "d", "k", 0.6, 0.15)) == ["train"] * a + ["val"] * b + ["test"] * (n - a - b)
    size = n // 6
    got = Counter((r["fold"], r["role"]) for r in splits.expanding_folds(rows, "d", "k").collect())
    for f in range(1, 6):
        assert got[f, "test"] == size and got[f, "train"] == n - (6 - f) * size
    aligned = splits.tail_split(rows, "d", "k", align_dates=True)
    assert aligned.groupBy("d").agg(F.countDistinct("split").alias("s")).where("s > 1").count() == 0


def test_folds_of_twelve(spark):
    folds = splits.expanding_folds(day_rows(spark, 12), "d", "k")
    sizes = {r["fold"]: r["count"] for r in folds.where("role = 'train'").groupBy("fold").count().collect()}
    assert sizes == {1: 2, 2: 4, 3: 6, 4: 8, 5: 10}
    late = folds.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("d"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("d"))).alias("b"))
    assert late.where("a >= b").count() == 0
    last = splits.last_fold(day_rows(spark, 12), "d", "k")
    assert Counter(r["role"] for r in last.collect()) == {"train": 10, "test": 2}


def test_row_count_split_puts_ties_into_test(spark):
    rows = day_rows(spark, 10, 4).unionByName(spark.createDataFrame([(None, "z", 0.0)], "d date, k string, x double"))
    got = splits.row_count_split(rows, "d", 0.7)
    assert {(r["d"].day if r["d"] else None): r["split"] for r in got.collect()} == {None: None, 1: "train", 2: "test", 3: "test"}


def test_scalers(spark):
    rows = day_rows(spark, 10).withColumn("c", F.lit(3.0))
    train = rows.where("x < 5")
    values = np.arange(10.0)
    z = sorted(r["x"] for r in scaling.zscore(rows, train, ["x", "c"]).collect())
    assert z == pytest.approx(((values - 2.0) / (values[:5].std(ddof=1) + 1e-7)).tolist())
    s = scaling.standardise(rows, train, ["x", "c"]).orderBy("x").collect()
    expected = (values - 2.0) / values[:5].std()
    assert [r["x"] for r in s] == pytest.approx(expected.tolist()) and {r["c"] for r in s} == {0.0}
    vectors = rows.select(array_to_vector(F.array("x", "c")).alias("features"), "x")
    model = scaling.PopulationScaler().fit(vectors.where("x < 5"))
    out = model.transform(vectors).orderBy("x").select(vector_to_array("scaled").alias("v")).collect()
    assert [r["v"][0] for r in out] == pytest.approx(expected.tolist()) and {r["v"][1] for r in out} == {0.0}


def test_centred_components_match_svd(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) + 5.0
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], f"{SESSION} int, v array<double>")
    reduced = reduction.reduce_days(df, "v", 3, "p").orderBy(SESSION).toPandas()[["p_0", "p_1", "p_2"]].to_numpy()
    centred = data - data.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    loadings = vt[:3].T
    loadings = loadings * np.where(loadings[np.abs(loadings).argmax(axis=0), range(3)] < 0, -1.0, 1.0)
    assert np.allclose(reduced, centred @ loadings, atol=1e-9)
    assert reduction.reduce_days(df, "v", 99, "p").columns == [SESSION] + [f"p_{i}" for i in range(6)]


def test_components_fitted_on_train_ignore_later_days(spark):
    rng = np.random.default_rng(5)
    early, late = rng.normal(size=(30, 4)), rng.normal(size=(10, 4)) * 100

    def run(later):
        data = [(i, r.tolist()) for i, r in enumerate(np.vstack([early, later]))]
        df = spark.createDataFrame(data, f"{SESSION} int, v array<double>")
        out = reduction.reduce_days(df, "v", 2, "p", df.where(F.col(SESSION) < 30))
        return out.where(F.col(SESSION) < 30).orderBy(SESSION).toPandas()[["p_0", "p_1"]].to_numpy()

    assert np.allclose(run(late), run(-late))


def test_sequence_scaling_counts_rows_per_window(spark):
    line = prices.price_timeline(price_frame(spark, [10 + (i * 7) % 5 for i in map(float, range(20))]))
    windows = sequences.sequence_windows(line, ["return_lag0", "return_lag1"], 3)
    split = splits.three_way_split(windows, "trading_date", "ticker", 0.6, 0.15)
    rows = split.orderBy("trading_date").collect()
    cells = np.array([r["window"] for r in rows if r["split"] == "train"]).reshape(-1, 2)
    scaled = sequences.scale_windows(split, sequences.window_stats(split.where("split = 'train'")))
    got = np.array([r["window"] for r in scaled.orderBy("trading_date").collect()])
    expected = (np.array([r["window"] for r in rows]) - cells.mean(axis=0)) / (cells.std(axis=0, ddof=1) + 1e-7)
    assert np.allclose(got, expected)


# Quality


def test_title_overlap_and_difference(spark):
    schema = "Article_title string, date_est timestamp_ntz"
    t = datetime(2020, 2, 1, 16, 0, 5)
    a = spark.createDataFrame([("x", t), ("x", t), ("y", t), (None, t)], schema)
    b = spark.createDataFrame([("y", t), ("z", t), (None, t), ("late", datetime(2021, 1, 1))], schema)
    assert quality.title_overlap(a, b).first()[0] == 1
    diff = quality.title_difference(a, b, ("nasdaq", "external"), start=datetime(2020, 1, 1), end=datetime(2020, 7, 1))
    assert sorted((r["Article_title"], r["source"]) for r in diff.collect()) == [("x", "nasdaq"), ("x", "nasdaq"), ("z", "external")]
    assert {r[0] for r in quality.common_titles(a, b).collect()} == {"y"}


def test_date_summary_counts_null_as_a_day(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1, 5),), (datetime(2020, 1, 4),), (None,), (None,)], "date_est timestamp_ntz")
    row = quality.date_summary(df, "date_est").first()
    assert (row["distinct_days"], row["min_date"], row["max_date"], row["span_days"], row["rows"]) == (
        3, date(2020, 1, 1), date(2020, 1, 4), 3, 4)


def test_compare_copies_ignores_nulls(spark):
    a = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    b = spark.createDataFrame([(1, "a"), (2, "b"), (3, "d")], "id int, v string")
    row = quality.compare_copies(a, b, "id", ["v"]).first()
    assert (row["compared"], row["mismatches"], row["left_nulls"], row["right_nulls"]) == (3, 1, 1, 0)
    assert [r["id"] for r in quality.mismatches(a, b, "id", "v").collect()] == [3]


def test_daily_checks(spark):
    days = daily.daily_sentiment(daily.by_calendar_day(sentiment_rows(spark)), "date_utc")
    assert quality.probability_violations(days).count() == 0
    articles = daily.by_calendar_day(sentiment_rows(spark))
    checked = quality.count_check(days, articles, "date_utc")
    assert checked.where("daily_article_count <> recount").count() == 0 and checked.count() == 2
    row = quality.spot_check(days, articles, date(2024, 1, 1), "date_utc").first()
    assert row["gap_pos"] < 1e-12 and row["gap_count"] == 0
    axis = daily.count_axis_top(daily.article_counts(sentiment_rows(spark), "date_utc")).first()[0]
    assert axis == pytest.approx(5.5)
    assert daily.duplicate_sessions(days.unionByName(days), "date_utc").count() == 2


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stemmed_texts_go_to_workers_in_short_batches(spark):
    spark.conf.set(BATCH, "10000")
    df = spark.range(3000).selectExpr("id", "concat('running dogs ', id) text").coalesce(1)
    got = df.select("id", text.clean_and_stem("text").alias("stems")).collect()
    assert int(spark.conf.get(BATCH)) <= 1000
    assert len(got) == 3000 and {r["stems"] for r in got} == {"run dog num"}


def test_scorer_gets_short_batches(spark):
    spark.conf.set(BATCH, "10000")

    def scorer():
        return lambda texts: (np.full((len(texts), 1), len(texts)), np.zeros((len(texts), 3)))

    df = spark.range(3000).selectExpr("id", "cast(id as string) Article_title").coalesce(1)
    got = scoring.score_articles(df, scorer, batch_size=100_000).collect()
    assert len(got) == 3000 and max(r["finbert_embedding"][0] for r in got) <= 1000


def test_each_word_is_stemmed_once(spark, monkeypatch):
    plain, asked = text.stem_vocabulary, []

    def seen(df, word="word"):
        asked.append(plain(df, word).count())
        return plain(df, word)

    monkeypatch.setattr(tfidf, "stem_vocabulary", seen)
    rows = spark.createDataFrame([(d, "dogs dog running dogs") for d in (1, 2, 3)], f"{SESSION} int, Article_title string")
    got = {tuple(r) for r in tfidf.daily_tokens(rows, stemmed=True).collect()}
    assert asked == [3] and got == {(d, t, n) for d in (1, 2, 3) for t, n in (("dog", 3), ("run", 1))}


def test_vectors_know_their_length(spark):
    counts = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], f"{SESSION} int, term string, tf long")
    model = tfidf.TfidfVectorizer(10).fit(counts, counts)
    found = model.to_vectors(counts, counts)
    assert found.schema["tfidf"].metadata["ml_attr"]["num_attrs"] == 2 and found.count() == 2
