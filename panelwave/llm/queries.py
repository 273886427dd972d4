"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwave.llm.centroids import OP12_SQL, op12_centroids
from panelwave.llm.decontaminate import OP4_SQL, op4_decontaminate
from panelwave.llm.lm import op3_deleted_interpolation
from panelwave.llm.minhash import OP1_SQL, op1_minhash
from panelwave.llm.orderhash import op6_order_minhash
from panelwave.llm.pieces import op5_sentencepiece
from panelwave.llm.quality import op7_weak_quality
from panelwave.llm.quoting import op8_quotation
from panelwave.llm.resample import OP13_SQL, op13_resample
from panelwave.llm.simhash import op11_simhash
from panelwave.llm.suffixdedup import OP2_SQL, op2_suffix_dedup
from panelwave.llm.toxicity import op9_toxicity
from panelwave.llm.warc import OP10_SQL, op10_warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_minhash": op1_minhash,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_deleted_interpolation": op3_deleted_interpolation,
        "op4_decontaminate": op4_decontaminate,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_order_minhash": op6_order_minhash,
        "op7_weak_quality": op7_weak_quality,
        "op8_quotation": op8_quotation,
        "op9_toxicity": op9_toxicity,
        "op10_warc": op10_warc,
        "op11_simhash": op11_simhash,
        "op12_centroids": op12_centroids,
        "op13_resample": op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": OP1_SQL,
        "op2_suffix_dedup": OP2_SQL,
        "op4_decontaminate": OP4_SQL,
        "op10_warc": OP10_SQL,
        "op12_centroids": OP12_SQL,
        "op13_resample": OP13_SQL,
    }
