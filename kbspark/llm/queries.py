"""The corpus operators as queries over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import chunk_codec, decontam, licenses, line_dedup, near_dup, packing, periodic_runs, prefix_trie, quality, quality_rules, token_io, url_rules, warc
from kbspark.llm.shared import fresh_dir
from kbspark.sources.tables import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, packing.token_counts(vocabulary())(F.col("text")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate_lines(docs)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where an installed public tokenizer file lies; it is the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_dir(spark, "tokens")
    return token_io.read_documents(token_io.write_tokens(docs, folder, vocabulary()), folder)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).drop("text")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Page URLs with the label of the document that their path names (``/en/25.html``: document 25)."""
    number = F.regexp_extract(url_rules.url_path(F.col("url")), r"^/[a-z]+/([0-9]{1,18})", 1)
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    named = pages.select("url", F.when(number != "", number).cast("long").alias("doc_id"))
    return named.join(marks, "doc_id").select("url", "bad")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = labelled_urls(pages, table(spark, sf_dir, "labels"))
    return url_rules.filter_urls(pages, labelled).drop("url")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages").select("page_id", "url", "html"), fresh_dir(spark, "warc")
    return warc.read_archives(warc.write_archives(pages, folder), folder).drop("url")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefix_trie.gathered(prefix_trie.turn_keys(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie_nodes(prefix_trie.regrown(own))


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, words = table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return chunk_codec.encode_decode(docs, words).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, h = table(spark, sf_dir, "documents").select("doc_id", "text"), prefix_trie.crc(F.col("doc_id"))
    looped = F.when(h % 10 == 0, periodic_runs.looped(F.col("text"), F.floor(h / 10))).otherwise(F.col("text"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    found = periodic_runs.periodic_runs(docs.select("doc_id", looped.alias("text")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.before")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.shorter")).alias("period"), F.floor(1000 * F.col("top.length") / -F.col("top.shorter")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_output": op4_token_output,
    "op5_license_scan": op5_license_scan,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filter": op8_url_filter,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_bpe_codec": op12_bpe_codec,
    "op13_periodic_runs": op13_periodic_runs,
}
