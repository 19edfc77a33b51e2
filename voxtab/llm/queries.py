"""The operators of this folder as queries over whole tables, and the same in SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm import (
    conversation_repair,
    mixing,
    ngram_join,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secret_scan,
    suffix_dedup,
    topk,
    toxicity,
    url_filter,
    warc,
)
from voxtab.llm.common import cut, table
from voxtab.llm.labelled import fold
from voxtab.llm.oracles import SQL  # noqa: F401
from voxtab.session import run_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


@query
def op2_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs)
    strong = [k.name for k in secret_scan.STRONG]
    base = F.filter("secret_spans", lambda s: s.kind.isin(strong))
    counts = [
        F.expr(f"cast(size(filter(secret_spans, s -> s.kind = '{n}')) as bigint)").alias(f"n_{n}")
        for n in strong
    ]
    return found.select(
        "doc_id", *counts,
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("secret_spans")).alias("spans"),
    )


@query
def op3_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs).drop("text")


@query
def op5_suffix_dedup(spark, sf_dir):
    cut = suffix_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def scored(df: DataFrame, held_out, *more) -> DataFrame:
    return df.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), *more
    )


@query
def op6_toxicity(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    held_out = fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, labels, ~held_out)
    found = toxicity.score(docs.select("doc_id", "text", "lang"), model)
    # The verdict by the threshold of the language beside the one at 0.3 for all.
    threshold = toxicity.threshold_of(model, F.coalesce("lang", F.lit("")))
    toxic = (F.col("score") >= threshold).cast("int")
    return scored(found, held_out, threshold.alias("threshold"), toxic.alias("toxic"))


@query
def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_removed_words", "base_failed", "kept",
    )


@query
def op8_quality(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    held_out = fold(F.col("doc_id"), 5) == 0
    model = quality_classifier.fit(docs, labels, ~held_out)
    return scored(quality_classifier.score(docs.select("doc_id", "text"), model), held_out)


@query
def op9_packing(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.select("vec_id", topk.quantised(F.col("embedding")).alias("weights"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


@query
def op11_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = run_folder(spark, "warc")
    warc.write_archives(pages, folder)
    # Once behind a checkpoint, so that the archives are read and put together a single time.
    found = cut(warc.read_pages(spark, folder, payloads=False).drop("payload", "url"))
    return warc.resolved(found).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault"
    )


@query
def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_period(docs))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")
    )))
    found = found.withColumn("best", longest)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    damaged = conversation_repair.with_damage(conversations)
    return conversation_repair.repair_report(damaged, conversations)
