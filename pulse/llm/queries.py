"""The registered queries of this subpackage: each applies its operator to whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm import fingerprints, idfile, language, mixing, neardup, packing, prefixes, quality, resampling, rules, sql, tokens, toxicity, transducer
from pulse.llm.learning import fold
from pulse.session import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """doc_id and label of all rows that have the label `name`."""
    rows = spark.read.parquet(f"{folder}/labels.parquet")
    return rows.select("doc_id", F.col(name).cast("int").alias("label")).filter("label is not null")


@query
def op1_hierarchical_packing(spark, folder):
    pieces = packing.pack(documents(spark, folder))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "tier", "step_id",
    )


@query
def op2_language_id(spark, folder):
    docs = documents(spark, folder)
    model = language.train(docs.filter(fold("doc_id", 4) != 2))
    held_out = (fold("doc_id", 4) == 2).alias("held_out")
    return language.identify(docs, model).select("doc_id", held_out, "lang_pred", "score")


@query
def op3_temperature_mixing(spark, folder):
    sizes = mixing.counted(documents(spark, folder), "tokens", keep=["doc_id", "source"])
    mixed = mixing.mix(sizes, "tokens", max_repeats=1.5, columns=("slot", "pass", "weight"))
    return mixed.select("doc_id", "source", "pass", "slot", "tokens", "weight")


@query
def op4_token_counts(spark, folder):
    return tokens.count_tokens(documents(spark, folder))


@query
def op5_line_rules(spark, folder):
    return rules.clean_documents(documents(spark, folder), with_text=False)


@query
def op6_counterfactual_toxicity(spark, folder):
    docs = documents(spark, folder)
    given = labels(spark, folder, "toxic").filter(fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.train(docs, given))
    held_out = (fold("doc_id", 5) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_bottom_k_fingerprints(spark, folder):
    return fingerprints.fingerprint_edits(documents(spark, folder))


@query
def op8_bit_plane_files(spark, folder):
    files = new_folder(spark, "ids")
    idfile.write_ids(documents(spark, folder), files)
    return idfile.read_ids(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_quality_gam(spark, folder):
    docs = documents(spark, folder)
    given = labels(spark, folder, "quality").filter(fold("doc_id", 4) != 2)
    scored = quality.score(docs, quality.train(docs, given))
    held_out = (fold("doc_id", 4) == 2).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_minhash_near_dedup(spark, folder):
    return neardup.near_duplicates(documents(spark, folder))


@query
def op11_importance_resampling(spark, folder):
    return resampling.resample(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


SQL["op11_importance_resampling"] = sql.RESAMPLING


@query
def op12_bpe_transducer(spark, folder):
    return transducer.round_trip(documents(spark, folder))


@query
def op13_prefix_trie(spark, folder):
    return prefixes.prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


SQL["op13_prefix_trie"] = sql.PREFIX_TRIE
