"""The queries of this subpackage and the SQL that gives the same rows, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docaudit.llm import collocations, mixing, topk
from docaudit.llm.ann import op4_additive_quantisation
from docaudit.llm.bpe import op5_bpe_encode_decode
from docaudit.llm.collocations import op13_phrase_collocations
from docaudit.llm.licenses import op9_license_scan
from docaudit.llm.mixing import op10_mix_to_weights
from docaudit.llm.neardup import op6_minhash_near_dedup
from docaudit.llm.periodic import op12_periodic_runs
from docaudit.llm.pii import op7_private_data
from docaudit.llm.quality import op3_quality_classifier
from docaudit.llm.tokens import op2_token_counts
from docaudit.llm.topk import op8_exact_top_k
from docaudit.llm.toxicity import op11_toxicity
from docaudit.llm.warc import op1_warc_revisits

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    operators = (
        op1_warc_revisits, op2_token_counts, op3_quality_classifier, op4_additive_quantisation, op5_bpe_encode_decode,
        op6_minhash_near_dedup, op7_private_data, op8_exact_top_k, op9_license_scan, op10_mix_to_weights,
        op11_toxicity, op12_periodic_runs, op13_phrase_collocations,
    )
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_top_k": topk.ORACLE, "op10_mix_to_weights": mixing.ORACLE, "op13_phrase_collocations": collocations.ORACLE}
