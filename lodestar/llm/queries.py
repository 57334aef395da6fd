"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, host_rules, language, licenses, packing, quality, simhash, token_counts, token_files, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_licenses": licenses.op2_licenses,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_token_files": token_files.op5_token_files,
    "op6_language": language.op6_language,
    "op7_simhash": simhash.op7_simhash,
    "op8_host_rules": host_rules.op8_host_rules,
    "op9_quality": quality.op9_quality,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_licenses": licenses.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op8_host_rules": host_rules.ORACLE,
}
