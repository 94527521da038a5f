"""Registered queries of the operators in this folder. Each applies one operator to its whole table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom.llm import bpe, decontaminate, licenses, line_runs, neighbours, packing, pages, resampling, secrets, simhash, suffixes, texts, toxicity, whitening

RANKS = "byte_bpe_multi_50k.tiktoken"
VOCABULARY = "byte_bpe_50k.json"


def rank_file() -> tuple[str, str]:
    """Path of the rank file and its pattern."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def vocabulary_file() -> tuple[str, str]:
    """Path of the vocabulary that documents are packed by, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(texts.table(spark, folder, "documents"))
    names = F.array_sort(F.transform("notices", lambda n: F.concat_ws(":", n["license"], n["first_line"], n["last_line"])))
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_join(names, ",").alias("notices"),
                        F.coalesce(F.array_max(F.transform("notices", lambda n: n["saved"])), F.lit(0.0)).alias("best_saved"),
                        F.aggregate("notices", F.lit(0).cast("long"), lambda a, n: a + F.size(n["differences"])).alias("n_differences"))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(texts.table(spark, folder, "documents"))

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")}
            for row in batch.column("secrets").to_pylist():
                spans = [(s["start"], s["end"], s["kind"]) for s in row]
                for kind in secrets.KINDS:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in spans))
                out["base_sha256"].append(secrets.sha_of(spans))
                out["spans"].append(secrets.listed(spans))
            kinds = {"base_sha256": pa.string(), "spans": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items())], ["doc_id", *out])

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(texts.table(spark, folder, "documents"))


def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(texts.table(spark, folder, "embeddings"))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(texts.table(spark, folder, "documents"), texts.table(spark, folder, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.repeats(texts.table(spark, folder, "documents"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(texts.table(spark, folder, "pages"))


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(texts.table(spark, folder, "documents"), *rank_file())


def op9_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = line_runs.deduplicated(texts.table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
                        F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(texts.table(spark, folder, "documents"), texts.table(spark, folder, "labels"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", toxicity.predicted(F.col("score")).alias("predicted"), spans.alias("toxic_spans"))


def op11_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(texts.table(spark, folder, "documents"), *vocabulary_file())


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    whitened = whitening.whiten(texts.table(spark, folder, "embeddings"))
    # Exact at any size; beyond a long there is no value for the contract's column.
    return whitened.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(texts.table(spark, folder, "documents"), texts.table(spark, folder, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_secret_scan, op3_simhash, op4_neighbours, op5_decontaminate, op6_suffix_dedup, op7_main_text, op8_byte_bpe, op9_line_runs, op10_toxicity,
    op11_best_fit_packing, op12_whitening, op13_resampling)}
#: None of these can be written in SQL at a bearable cost; tests/llm checks each against brute force.
SQL: dict[str, str] = {}
