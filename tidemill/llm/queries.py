"""The contract queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import alignment, decontamination, fingerprints, lines, packing, quality, secrets, simhash, substrings, tokens, topk, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": tokens.op1_token_files,
    "op2_secrets": secrets.op2_secrets,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_simhash": simhash.op4_simhash,
    "op5_topk": topk.op5_topk,
    "op6_substrings": substrings.op6_substrings,
    "op7_urls": urls.op7_urls,
    "op8_packing": packing.op8_packing,
    "op9_quality": quality.op9_quality,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_fingerprints": fingerprints.op11_fingerprints,
    "op12_lines": lines.op12_lines,
    "op13_alignment": alignment.op13_alignment,
}
SQL: dict[str, str] = {
    "op2_secrets": secrets.OP2_SQL,
    "op3_decontamination": decontamination.OP3_SQL,
    "op5_topk": topk.OP5_SQL,
    "op6_substrings": substrings.OP6_SQL,
    "op7_urls": urls.OP7_SQL,
    "op12_lines": lines.OP12_SQL,
}
