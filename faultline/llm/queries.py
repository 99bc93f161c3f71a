"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import chat_pairs, exact_dedup, fill_in_middle, line_dedup, merkle, quality_rules
from faultline.llm.byte_bpe import op1_byte_bpe
from faultline.llm.chat_pairs import op7_chat_pairs
from faultline.llm.exact_dedup import op9_exact_dedup
from faultline.llm.fill_in_middle import op13_fill_in_middle
from faultline.llm.html_extract import op2_html_extract
from faultline.llm.line_dedup import op6_line_dedup
from faultline.llm.merkle import op12_merkle_manifest
from faultline.llm.packing import op5_packing
from faultline.llm.piece_bpe import op11_sentencepiece
from faultline.llm.quality_rules import op10_quality_rules
from faultline.llm.secrets import op3_secret_scans
from faultline.llm.shingle_join import op8_shingle_join
from faultline.llm.token_counts import op4_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn
    for fn in (
        op1_byte_bpe, op2_html_extract, op3_secret_scans, op4_token_counts, op5_packing, op6_line_dedup, op7_chat_pairs,
        op8_shingle_join, op9_exact_dedup, op10_quality_rules, op11_sentencepiece, op12_merkle_manifest,
        op13_fill_in_middle,
    )
}

SQL: dict[str, str] = {
    "op6_line_dedup": line_dedup.SQL,
    "op7_chat_pairs": chat_pairs.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
