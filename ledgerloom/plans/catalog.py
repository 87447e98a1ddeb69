"""All queries of the library outside the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import aggregated, audited, dated, fed, indexed, joined, listed, mined, paged, ruled, sequenced, streamed, worded
from ledgerloom.plans.registry import Registry

PARTS = (joined, aggregated, sequenced, mined, dated, worded, ruled, fed, listed, streamed, paged, indexed, audited)


def registry() -> Registry:
    reg = Registry()
    for part in PARTS:
        part.register(reg)
    return reg


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry().queries["j1_inner_hash"](spark, sf_dir)
