"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read again as
the documents of the next. All but the last return the columns of documents.
"""

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm import mixing, ngram_join, packing, secret_scan, toxicity
from voxtab.llm.common import table
from voxtab.session import run_folder

# SQL cannot train a network, rake weights or encode tokens.
ORACLE_SQL = None


def on_own_columns(stage):
    """The stage on doc_id, text, lang, source and n_chars, where they are there. All other columns
    travel as one, so that no name of theirs meets one that an operator uses or adds."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
        others = [F.col(f"`{c}`") for c in docs.columns if c not in own]
        made = stage(spark, docs.select(*own, F.struct(F.lit(True), *others).alias("others_of_row")), sf_dir)
        return made.select(
            *[F.col(c) if c in own else F.col("others_of_row").getField(c).alias(c) for c in docs.columns]
        )

    return run


@on_own_columns
def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language. Rows without a language use
    the common threshold."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, F.lit(True))
    scored = toxicity.score(docs, model)
    lang = F.coalesce("lang", F.lit(""))
    return scored.where(~toxicity.is_toxic(model, F.col("score"), lang))


@on_own_columns
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, rows without an id
    after all others, of equal ids that with the smallest hash of its text. Rows that repeat an
    id with another text are documents of their own; of rows alike in id and text one stays."""
    own = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())
    keyed = docs.withColumn("row_key", own)
    groups = ngram_join.near_duplicates(keyed.select(F.col("row_key").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    named = keyed.select("row_key", "doc_id").join(groups, "row_key")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")
    first = named.groupBy("component_id").agg(F.min(order)["row_key"].alias("row_key")).select("row_key")
    return keyed.join(first, "row_key", "left_semi").dropDuplicates(["row_key"])


@on_own_columns
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, n_chars as it is then."""
    found = secret_scan.redact(secret_scan.scan(docs))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return found


@on_own_columns
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have tempered shares of sources, languages and topics."""
    return mixing.mix(docs).where("sampled")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", clean_language),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each but the last returns is written below the
    shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = run_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
