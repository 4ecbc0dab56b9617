"""The protocol of an answer's events: progress, then one result or error, then done. Events of a user part into sessions at pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A letter for each type of event.
LETTERS = {"progress": "p", "result": "r", "error": "e", "done": "d"}
WHOLE = "^p*[re]d$"


def sessions(events: DataFrame, pause: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, events, sequence, outcome, whole) of each session of (user_id, at, no, type): whole: whether it keeps to the protocol.

    Alike for a batch and, with ``late``, for a stream, whose sessions come when the watermark has passed them. Events of other types are left out.
    """
    letter = F.coalesce(*[F.when(F.col("type") == t, c) for t, c in LETTERS.items()])
    e = events.where(F.col("type").isin(*LETTERS)).select("user_id", "at", "no", letter.alias("c"))
    e = e if late is None else e.withWatermark("at", late)
    s = e.groupBy("user_id", F.session_window("at", pause).alias("w")).agg(F.sort_array(F.collect_list(F.struct("at", "no", "c"))).alias("es"))
    said = F.array_join(F.transform("es", lambda x: x["c"]), "")
    s = s.select("user_id", F.col("w.start").alias("start"), F.size("es").cast("long").alias("events"), said.alias("sequence"))
    outcome = F.when(F.contains("sequence", F.lit("e")), "error").when(F.contains("sequence", F.lit("r")), "result").otherwise("none")
    return s.withColumns({"outcome": outcome, "whole": F.col("sequence").rlike(WHOLE)})
