"""Complete objects from arriving bronze rows: the live form of ``silver_triplets``."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake import schemas
from framelake.operators.frames import SUCCESS
from framelake.streaming.live import DRAIN, drains

COMPLETE, INCOMPLETE = "complete", "incomplete"


def triplet_schema(types: Sequence[str], metrics: Sequence[str]) -> T.StructType:
    """object_id, a column per type and metric as in silver, the types that are missing, and the state."""
    kinds = {f.name: f.dataType for f in schemas.BRONZE}
    columns = {f"{name}_{m}": kinds[m] for name in types for m in metrics}
    return schemas.struct(object_id=schemas.STRING, **columns, missing=schemas.STRING, state=schemas.STRING)


def live_triplets(
    rows: DataFrame, event_time: str, target: str, checkpoint: str, delay: str = "1 hour", keep_hours: float = 24.0,
    trigger: Mapping = DRAIN, types: Sequence[str] = tuple(schemas.IMAGE_TYPES),
    metrics: Sequence[str] = tuple(schemas.BRONZE_METRICS),
) -> DataFrame | StreamingQuery:
    """One row per object in ``target``, as soon as successful rows of all its types have come.

    ``rows`` is a stream of bronze rows with the time they came in ``event_time``. Spark keeps per object what
    has come; of several rows of a type the lowest path counts until the object is handed over, once. An
    object that does not get its types within ``keep_hours`` of its last row is handed over as incomplete, with
    the missing types named; one whose metrics are missing is incomplete at once. Rows that come ``delay``
    later than others count as late and are left out. A checkpoint goes on where a run stopped.
    """
    out = triplet_schema(types, metrics)
    held = T.StructType([T.StructField("done", T.BooleanType()), T.StructField("last", T.LongType())] + [
        f for i, _ in enumerate(types) for f in (
            T.StructField(f"had{i}", T.BooleanType()), T.StructField(f"path{i}", T.StringType()),
            *[T.StructField(f"m{i}_{j}", T.DoubleType()) for j, _ in enumerate(metrics)])])
    width, whole = 2 + len(metrics), [f.dataType == schemas.INT for f in out if f.name.startswith(f"{types[0]}_")]
    known = {name: i for i, name in enumerate(types)}
    keep = int(keep_hours * 3_600_000)

    def row(key: tuple, parts: list, late: bool) -> pd.DataFrame:
        values, missing = [], []
        for i, name in enumerate(types):
            had, _, *numbers = parts[i * width:(i + 1) * width]
            if not had or any(v is None or math.isnan(v) for v in numbers):
                missing.append(name)
            values += [None if v is None else int(v) if w and not math.isnan(v) else v for v, w in zip(numbers, whole)]
        state = INCOMPLETE if missing or late else COMPLETE
        frame = pd.DataFrame([[key[0], *values, ",".join(missing), state]], columns=out.fieldNames())
        return frame.astype({f.name: "Int32" if f.dataType == schemas.INT else "float32" for f in out[1:-2]})

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            done, _, *parts = state.get
            state.remove()
            if not done:
                yield row(key, parts, True)
            return
        done, last, *parts = state.get if state.exists else (False, 0, *([None] * (width * len(types))))
        for batch in batches:
            for name, path, when, *numbers in batch.itertuples(index=False, name=None):
                last = max(last, 0 if pd.isna(when) else int(when.timestamp() * 1000))
                at = known[name] * width
                path = None if pd.isna(path) else path
                if done or parts[at] and (path is None or parts[at + 1] is not None and parts[at + 1] <= path):
                    continue
                parts[at:at + width] = [True, path, *(None if v is None or pd.isna(v) else float(v) for v in numbers)]
        ready = not done and all(parts[i * width] for i in range(len(types)))
        state.update((done or ready, last, *parts))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep)
        if ready:
            yield row(key, parts, False)

    wanted = rows.filter((F.col("status") == SUCCESS) & F.col("image_type").isin(*types)).select(
        F.col("object_id"), "image_type", "file_path", F.col(event_time).alias("_when"), *metrics)
    found = wanted.withWatermark("_when", delay).groupBy("object_id").applyInPandasWithState(
        lambda key, batches, state: update(key, (b[["image_type", "file_path", "_when", *metrics]] for b in batches), state),
        out, held, "append", GroupStateTimeout.EventTimeTimeout)
    query = (
        found.writeStream.outputMode("append").format("parquet").partitionBy("state")
        .option("path", target).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
    if not drains(trigger):
        return query
    query.awaitTermination()
    return rows.sparkSession.read.schema(out).parquet(target)
