"""The queries of this subpackage for the driver, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["op1_decontaminate", "op2_ctw", "op3_pack", "op4_quality", "op5_hamming", "op6_near_dedup", "op7_language", "op8_secrets", "op9_suffix_dedup", "op10_warc"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: getattr(importlib.import_module(f"symloom.llm.{name}"), name) for name in MODULES}
    return found | {"warc_records": importlib.import_module("symloom.llm.op10_warc").warc_records}


def oracle_sql() -> dict[str, str]:
    sql = {name: importlib.import_module(f"symloom.llm.{name}").SQL for name in MODULES}
    return {name: text for name, text in sql.items() if text} | {"warc_records": importlib.import_module("symloom.llm.op10_warc").RECORDS_SQL}
