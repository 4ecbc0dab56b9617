"""The three passes over extracted blocks in their order: boilerplate, corrections, entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import corrected
from .boilerplate import process
from .tables import entities


def correct(blocks: DataFrame) -> DataFrame:
    """Corrects texts; was_corrected tells where, also where an earlier pass did, and raw_text keeps what was there."""
    b = blocks.withColumn("fixed", corrected(F.coalesce("text", F.lit(""))))
    changed = F.col("fixed") != F.regexp_replace(F.coalesce("text", F.lit("")), r"\A\s+|\s+\z", "")
    b = b.withColumn("changed", changed)
    return b.withColumns({"raw_text": F.when(F.col("changed"), F.col("text")), "text": F.when(F.col("changed"), F.col("fixed")).otherwise(F.col("text")), "was_corrected": F.col("changed")}).drop("fixed", "changed")


def postprocess(blocks: DataFrame, height: float = 842.0) -> DataFrame:
    """blocks with boilerplate_type, is_boilerplate, was_corrected, raw_text and entities."""
    return correct(process(blocks, height)).withColumn("entities", entities(F.coalesce("text", F.lit(""))))
