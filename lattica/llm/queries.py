"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op8_nn_descent
from .jaccard import op4_jaccard_join
from .license_scan import op7_license_scan
from .packing import op2_best_fit_packing
from .pii import op9_personal_data
from .pieces import op6_sentencepiece
from .quality import op10_quality_rules
from .secret_scan import op5_secret_scan
from .token_store import op1_token_ids
from .warc import OP3_SQL, op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": op1_token_ids,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_warc": op3_warc,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_secret_scan": op5_secret_scan,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_license_scan": op7_license_scan,
    "op8_nn_descent": op8_nn_descent,
    "op9_personal_data": op9_personal_data,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": OP3_SQL,
}
