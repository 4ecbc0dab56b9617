"""The stages of a file's ingest as keyed state of a stream: each outcome moves its file on, a failure stops it.

Events are (file_id, at, stage, ok, detail): how a stage of a file ended; detail is the path that it wrote, or the error. A file goes
through ``STAGES`` in order. An event that isn't the outcome of its next stage, or comes after a failure or the end, is
refused and changes nothing. State is a row for each file.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STAGES = ["save", "extract", "preprocess", "embed", "upsert"]
#: The statuses that a file passes when a stage has succeeded; the last one holds until the next outcome.
PASSED = {"save": ["registered", "extracting"], "extract": ["extracted", "preprocessing"], "preprocess": ["preprocessed", "embedding"], "embed": ["embedding"], "upsert": ["ingested"]}
FAILED = "failed"
BEFORE_RECORD = "Pre-registration failure: "
OUT = "file_id bigint, at bigint, stage string, accepted boolean, passed array<string>, status string, error_message string, extracted_json_path string, preprocessed_json_path string"
STATE = "done int, status string, error_message string, extracted_json_path string, preprocessed_json_path string"
NEW = (0, None, None, None, None)


def moved(state: tuple, stage: str, ok: bool, detail: str | None) -> tuple[tuple, list[str]] | None:
    """The state after an outcome and the statuses passed on the way; None if it is refused."""
    done, status, _, extracted, preprocessed = state
    if status in (FAILED, "ingested") or done >= len(STAGES) or stage != STAGES[done]:
        return None
    if not ok:
        error = (BEFORE_RECORD if stage == "save" else "") + (detail or "")
        return (done, FAILED, error, extracted, preprocessed), [FAILED]
    paths = {"extract": (detail, preprocessed), "preprocess": (extracted, detail)}.get(stage, (extracted, preprocessed))
    return (done + 1, PASSED[stage][-1], None, *paths), PASSED[stage]


class Stages(StatefulProcessor):
    """One file's state; the events of a batch are taken in the order of their times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("file", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  the interface's names
        state = tuple(self.state.get()) if self.state.exists() else NEW
        for e in sorted(rows, key=lambda r: r["at"]):
            step = moved(state, e["stage"], bool(e["ok"]), e["detail"])
            state, passed = step or (state, [])
            yield Row(file_id=key[0], at=e["at"], stage=e["stage"], accepted=step is not None, passed=passed, status=state[1], error_message=state[2], extracted_json_path=state[3], preprocessed_json_path=state[4])
        self.state.update(state)

    def close(self) -> None:
        pass


def statuses(events: DataFrame) -> DataFrame:
    """A row (``OUT``) for each event of a stream: whether it was accepted, and its file's state after it."""
    return events.groupBy("file_id").transformWithState(statefulProcessor=Stages(), outputStructType=OUT, outputMode="Append", timeMode="None")


def run(events: DataFrame, out: str, checkpoint: str) -> None:
    """Works off what is there into Parquet files; started again, it goes on from the state of each file."""
    conf, key = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = statuses(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        conf.set(key, before)
