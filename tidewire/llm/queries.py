"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import align, bpe, chat, decontam, lines, quality, runs, setjoin, shards, sql, tokens, unigram, urls, warc

#: The blocking and allowing rules of the URL filter.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
END_ID, SHARDS = 1, 24


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file on this machine; the same path is used on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    return tokens.token_file_digests(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID)


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as legacy archives, converted to WARC and read back."""
    # a vectored read takes a whole column chunk outside the heap, besides the one on it
    pages = spark.read.option("parquet.hadoop.vectored.io.enabled", "false").parquet(f"{sf_dir}/pages.parquet")
    return warc.convert_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the two dictionaries."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op4_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and naive Bayes on every page's url."""
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "log_odds")


def op5_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text they decode to."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return setjoin.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = lines.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")


def op8_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return shards.assign(table(spark, sf_dir, "documents"), SHARDS)


def op9_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.count_tokens(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op10_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontam.judge(docs, table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def benchmark_longest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest passage of every benchmark item that stands in a document, and where."""
    return decontam.longest_per_item(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document."""
    return align.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten repeats some of its words to its end. A document without an id stays as it is."""
    mark = zlib.crc32(str(doc_id).encode())
    if doc_id is None or mark % 10 or not words:
        return words
    rest = mark // 10
    at = rest % len(words)
    left = len(words) - at
    period = 1 + left // (3 + rest % 8)
    return words[:at] + (words[at : at + period] * -(-left // period))[:left]


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, and the digest of what is left without the repeats."""
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as bigint) doc_id", "text")
    found = runs.repetitions(docs, change=planted_period)
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Texts of the conversation that is added to the table's.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's turns as JSON records of several layouts, and one more conversation full of control strings."""
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text").unionByName(more)
    text = F.coalesce("text", F.lit(""))
    known, odd = F.col("role").isin("system", "user", "assistant"), F.col("turn") % 3
    sender = F.expr("case role when 'user' then 'human' when 'assistant' then 'gpt' else role end")

    def made(column: Column) -> Column:
        return F.to_json(column, {"ignoreNullFields": "false"})

    record = (
        F.when((F.col("role") == "user") & (odd == 0), made(F.struct(text.alias("prompt"))))
        .when((F.col("role") == "assistant") & (odd == 1), made(F.struct(text.alias("response"))))
        .when(F.col("role") == "system", made(F.struct(text.alias("system"))))
        .when(known & (odd == 2), made(F.struct(F.array(F.struct(sender.alias("from"), text.alias("value"))).alias("conversations"))))
        .otherwise(made(F.struct(F.array(F.struct(F.col("role"), text.alias("content"))).alias("messages"))))
    )
    return turns.select("conv_id", "turn", record.alias("record"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what is read back from the formatted table."""
    return chat.conversation_digests(chat.formatted_table(conversation_records(spark, sf_dir)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py`` in turn."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_arc_to_warc,
        op3_compression_quality,
        op4_url_words,
        op5_backtracking_bpe,
        op6_jaccard_components,
        op7_line_rules,
        op8_label_propagation,
        op9_unigram_counts,
        op10_suffix_decontamination,
        benchmark_longest_matches,
        op11_token_alignment,
        op12_word_runs,
        op13_chat_format,
        pipeline,
    )
}

SQL = sql.SQL
