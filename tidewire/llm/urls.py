"""URL filter: rules first, else words of the host name and path under naive Bayes.

Host names run words together. Each part of a host is split into words by the unigram path of highest probability,
with word counts of the pages' own visible text. A multinomial naive Bayes model over the words of host and path then
decides; it learns from the pages themselves, where a url with a word of ``BAD_WORDS`` stands for a bad one.
Every count is a Spark aggregation over all rows, the vocabulary is joined and never broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.frames import arrow_map, small, written

#: Longest word a host part is split into, and longest part that is split at all (the limit of a DNS label).
LONGEST_WORD, LONGEST_PART = 20, 63

#: Weak labels: words of hosts and paths of gambling, medicine sales, adult, spam, advertising and malware sites.
BAD_WORDS = (
    "casino casinos poker gambling bet bets betting slots jackpot roulette lottery "
    "pill pills pharmacy viagra cialis porn porno xxx sex adult nude escort escorts "
    "spam ads adserver adserv tracker track clickbait malware phishing warez keygen crack"
).split()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: F.Column) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


_WORD = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", re.S | re.I)


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Counts of the ASCII words of all visible text: ``word``, ``n``. Added up per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(_WORD.findall(_TAG.sub(" ", text).lower()))
            kept = [(w, n) for w, n in counts.items() if w.isascii() and len(w) <= LONGEST_WORD]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    return pages.select(html).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def best_split(part: str, found: dict[str, int], total: int) -> list[str]:
    """The words of highest probability that make up ``part``.

    A string that is no known word costs ten times more with each letter. Of equal sums the split whose last word is
    longer stays.
    """
    if not part:
        return []
    log_total = math.log(max(total, 1))
    best, back = [0.0], [0]
    for end in range(1, len(part) + 1):
        top, origin = -math.inf, end - 1
        for begin in range(max(0, end - LONGEST_WORD), end):
            n = found.get(part[begin:end])
            score = best[begin] + (math.log(n) - log_total if n else math.log(10) * (1 - (end - begin)) - log_total - 1)
            if score > top:
                top, origin = score, begin
        best.append(top)
        back.append(origin)
    out, end = [], len(part)
    while end:
        out.append(part[back[end] : end])
        end = back[end]
    return out[::-1]


def segment(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """``part`` (distinct strings of a-z) with its ``words``.

    All substrings of a part are looked up by one join with the counts, so the vocabulary may have any size; a part
    gathers at most ``LONGEST_PART`` times ``LONGEST_WORD`` matches. Longer parts stay whole.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    short = parts.where(F.length("part").between(1, LONGEST_PART))
    pieces = short.select(
        "part",
        F.explode(
            F.expr(
                f"array_distinct(flatten(transform(sequence(1, length(part)), i -> "
                f"transform(sequence(1, least({LONGEST_WORD}, length(part) - i + 1)), n -> substring(part, i, n)))))"
            )
        ).alias("word"),
    )
    matched = pieces.join(counts, "word").groupBy("part").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    rows = parts.join(matched, "part", "left")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = {x["word"]: x["n"] for x in found or []}
                out.append(best_split(part, known, total) if len(part) <= LONGEST_PART else [part])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["part", "words"])

        return run

    return arrow_map(rows.select("part", "found"), make, "part string, words array<string>")


def rule_of(urls: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``urls`` (``host``, ``path``, ...) with ``rule`` and ``rule_verdict``, null where no rule fits.

    ``rules`` maps ``host/path`` to ``block`` or ``allow``. A rule fits its host and all subdomains if the path begins
    with the rule's; the longest rule wins, of equally long ones the longer host.
    """
    spark = urls.sparkSession
    rows = [(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for r, v in rules.items()]
    table = spark.createDataFrame(rows, "rule string, rule_host string, rule_path string, rule_verdict string")
    ends = F.expr("transform(sequence(1, size(split(host, '[.]', -1))), i -> concat_ws('.', slice(split(host, '[.]', -1), i, 64000)))")
    fitting = (
        urls.select("host", "path", F.explode(ends).alias("rule_host"))
        .join(F.broadcast(table), "rule_host")
        .where(F.expr("startswith(path, rule_path)"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("deep"), "rule", "rule_verdict")).alias("top"))
    )
    return urls.join(fitting, ["host", "path"], "left").select(*[urls[c] for c in urls.columns], F.col("top.rule").alias("rule"), F.col("top.rule_verdict").alias("rule_verdict"))


def labelled(urls: DataFrame, tokens: DataFrame) -> DataFrame:
    """``urls`` with ``bad``: whether a word of ``BAD_WORDS`` is among the words of the host or path, or is a whole
    string of letters of the host (where the split may have cut it)."""
    seeds = F.array(*[F.lit(w) for w in BAD_WORDS])
    named = tokens.where(F.regexp_replace("token", "^/", "").isin(BAD_WORDS)).select("host", "path").distinct().withColumn("seeded", F.lit(True))
    whole = F.arrays_overlap(F.split("host", "[^a-z]+"), seeds)
    return urls.join(small(written(named, "seeded-urls")), ["host", "path"], "left").withColumn("bad", F.coalesce("seeded", F.lit(False)) | whole).drop("seeded")


def url_tokens(urls: DataFrame, words: DataFrame) -> DataFrame:
    """``host``, ``path``, ``token``: the split words of the host, and the words of the path with any number as ``0``."""
    parts = urls.select("host", "path", F.explode(F.expr("split(host, '[^a-z]+')")).alias("part")).where("part <> ''")
    of_host = parts.join(words, "part").select("host", "path", F.explode("words").alias("token"))
    path_words = F.expr("split(regexp_replace(lower(path), '[0-9]+', '0'), '[^a-z0-9]+')")
    of_path = urls.select("host", "path", F.explode(path_words).alias("token")).where("token <> ''")
    return of_host.unionByName(of_path.withColumn("token", F.concat(F.lit("/"), "token")))


def judge(pages: DataFrame, rules: dict[str, str], url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` (without ``html``) with ``host``, ``path``, ``rule``, ``verdict`` and the method's ``log_odds`` of bad.

    Every row is kept. A null url, or one without ``://``, has empty host and path, no rule and no token, so the
    share of bad pages decides, as it does when no url has a bad word. Columns of ``pages`` with the names of results
    are replaced. The pages' text is read for word counts only; what is joined to the rows is one row per distinct
    host and path.
    """
    named = pages.drop("host", "path", "rule", "verdict", "log_odds").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    urls = written(named.groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    counts = word_counts(pages, html)
    parts = urls.select(F.explode(F.expr("split(host, '[^a-z]+')")).alias("part")).where("part <> ''").distinct()
    words = written(segment(parts, written(counts, "word-counts")), "host-words")
    tokens = written(url_tokens(urls, small(words)), "url-tokens")
    urls = written(labelled(urls, tokens).select("host", "path", "n", F.when(F.col("bad"), F.col("n")).otherwise(0).alias("n_bad")), "labelled-urls")
    with_n = tokens.join(urls, ["host", "path"])
    model = written(with_n.groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")), "token-counts")
    whole = model.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_bad"), F.lit(0)), F.count("*")).first()
    pages_in = urls.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_bad"), F.lit(0))).first()
    prior = math.log((pages_in[1] + 1) / (pages_in[0] - pages_in[1] + 1))
    # add-one smoothing over the tokens seen
    odds = F.log((F.col("n_bad") + 1) / (whole[1] + whole[2] + 1)) - F.log((F.col("n") - F.col("n_bad") + 1) / (whole[0] - whole[1] + whole[2] + 1))
    scored = (
        tokens.join(small(model.select("token", odds.alias("odds"))), "token")
        .groupBy("host", "path")
        .agg(F.sum("odds").alias("odds"))
    )
    # sums of doubles depend on their order in the last bits; rounding keeps verdicts and results steady
    log_odds = F.round(F.lit(prior) + F.coalesce("odds", F.lit(0.0)), 6)
    judged = rule_of(urls.select("host", "path").join(scored, ["host", "path"], "left"), rules)
    judged = written(
        judged.select("host", "path", "rule", F.coalesce("rule_verdict", F.when(log_odds > 0, "block").otherwise("allow")).alias("verdict"), log_odds.alias("log_odds")),
        "judged-urls",
    )
    return named.drop(html).join(small(judged), ["host", "path"])
