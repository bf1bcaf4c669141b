"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from strandsift.llm import chat, langid, licenses, mixing, neighbours, packing, quality, simhash, warc, weak_labels


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_language_id": langid.op2_language_id,
        "op3_weak_label_quality": weak_labels.op3_weak_label_quality,
        "op4_nearest_neighbours": neighbours.op4_nearest_neighbours,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_chat_format": chat.op7_chat_format,
        "op8_warc_bundles": warc.op8_warc_bundles,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_simhash": simhash.op10_simhash,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": licenses.OP5_SQL, "op7_chat_format": chat.OP7_SQL, "op8_warc_bundles": warc.OP8_SQL, "op9_quality_rules": quality.OP9_SQL}
