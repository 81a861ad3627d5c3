"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from gaugeworks.llm import bpe, hamming_search, line_dedup, minhash_dedup, nn_descent, packing, quality, secret_scan, sharding, substring_dedup
from gaugeworks.tables import load

QUERIES = {
    "op1_sharding": lambda spark, sf_dir: sharding.report(spark, load(spark, sf_dir, "documents")),
    "op2_secret_scan": lambda spark, sf_dir: secret_scan.report(load(spark, sf_dir, "documents")),
    "op3_packing": lambda spark, sf_dir: packing.pack(spark, load(spark, sf_dir, "documents")),
    "op4_substring_dedup": lambda spark, sf_dir: substring_dedup.report(spark, load(spark, sf_dir, "documents")),
    "op5_quality": lambda spark, sf_dir: quality.report(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")),
    "op6_line_dedup": lambda spark, sf_dir: line_dedup.report(spark, load(spark, sf_dir, "documents")),
    "op7_hamming_search": lambda spark, sf_dir: hamming_search.report(spark, load(spark, sf_dir, "embeddings")),
    "op8_minhash_dedup": lambda spark, sf_dir: minhash_dedup.report(spark, load(spark, sf_dir, "documents"), shingle=2, percent=80),
    "op9_nn_descent": lambda spark, sf_dir: nn_descent.report(spark, load(spark, sf_dir, "embeddings")),
    "op10_bpe": lambda spark, sf_dir: bpe.report(load(spark, sf_dir, "documents")),
}

ORACLES = {
    "op1_sharding": sharding.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_hamming_search": hamming_search.ORACLE,
    "op8_minhash_dedup": minhash_dedup.oracle(2, 80),
}
