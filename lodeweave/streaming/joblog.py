"""The job log as a stream: windows of events behind a watermark, the current status of each job, pending references by state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import vocab as V

EVENTS = "id bigint, job_id bigint, status string, message string, created_at timestamp"


def events(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Events of a folder that files arrive in; repeated events within the watermark count once."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.where("id is not null and created_at is not null").withWatermark("created_at", "7 days").dropDuplicatesWithinWatermark(["id"])


def windows(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """Events per window and status; a window is final once the watermark has passed it."""
    return stream.groupBy(F.window("created_at", width), V.job_status(F.col("status")).alias("status")).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "status", "events")


def current_status(stream: DataFrame) -> DataFrame:
    """Status of the newest event of each job (complete or update mode)."""
    return stream.where("job_id is not null").groupBy("job_id").agg(F.max_by(V.job_status(F.col("status")), "id").alias("status"), F.count("*").alias("events"))


def pending_references(changes: DataFrame) -> DataFrame:
    """Orphan changes of a stream (key, side, row_id, at): references that wait for their parent, and what settles them.

    side is ref, parent or deleted. A key's state is its parent's presence and its waiting
    references; output rows (key, row_id, event) say waiting, resolved or reopened.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alive, waiting, settled = state.get if state.exists else (False, [], [])
        waiting, settled, out = list(waiting), list(settled), []
        rows = pd.concat(list(batches)).sort_values(["at", "side"], kind="stable")
        for side, row_id in zip(rows["side"], rows["row_id"]):
            if side == "ref":
                if not alive:
                    waiting.append(int(row_id))
                    out.append((int(row_id), "waiting"))
            elif side == "parent":
                alive = True
                out += [(r, "resolved") for r in waiting]
                settled, waiting = settled + waiting, []
            else:
                alive = False
                out += [(r, "reopened") for r in settled]
                waiting, settled = waiting + settled, []
        state.update((alive, waiting, settled))
        yield pd.DataFrame({"key": [key[0]] * len(out), "row_id": [r for r, _ in out], "event": [e for _, e in out]}).astype({"row_id": "int64"})

    return changes.groupBy("key").applyInPandasWithState(step, "key string, row_id bigint, event string", "alive boolean, waiting array<bigint>, settled array<bigint>", "append", GroupStateTimeout.NoTimeout)
