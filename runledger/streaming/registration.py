"""Registration of a growing source: a stream whose batches add up to versions.

Each micro-batch is written once, with what describes it in a form that adds up: row hashes, sketches,
the newest event time. A version is the sum of the batches so far; making one reads no row again.

* **Replays.** A batch is committed by one row under its number, written last. A batch that is run
  again finds its row and adds nothing; one that died before has left only files that its next
  attempt overwrites. So rows are registered exactly once, whatever dies. The stream's checkpoint
  lies in the workspace, so that numbers and commits live and go together.
* **Late rows.** The watermark of a batch is the newest event time of all batches before it less a
  delay. Rows that are older go to a table of their own, with the batch and its watermark, instead of
  being dropped without a trace, as an engine's own watermark would. It follows from committed batches
  only, so a replay judges every row alike. A row without an event time is never late.
* **Identity.** A version's digest is that of the same rows registered in one piece, late rows apart.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import digest_of, row_states
from ..operators.profile import KEPT_ROWS, kept_rows
from ..operators.sketches import SKETCH_FIELDS, column_sketches, merged_sketches
from ..session import scratch_path, small_frame
from ..sources.tables import materialize, read_rows
from ..sources.versions import Workspace, add_version, check_name, known_version, require_columns

COMMIT_FACTS = (
    "rows bigint, late bigint, first decimal(38,0), second decimal(38,0), newest timestamp, watermark timestamp, "
    f"schema_json string, sketches array<struct<{SKETCH_FIELDS}>>, sample array<string>, at timestamp"
)
LATE = "_late"


@dataclass(frozen=True)
class Arrivals:
    """A source that grows: the column of its event time, if any, and the delay that is allowed."""

    ws: Workspace
    source: str
    event_time: str | None = None
    delay_seconds: int = 0

    @property
    def rows(self) -> str:
        return self.ws.data(f"source={check_name(self.source)}", "arrivals=rows")

    @property
    def checkpoint(self) -> str:
        return self.ws.data(f"source={check_name(self.source)}", "arrivals=checkpoint")

    @property
    def part(self) -> str:
        return f"workspace_id={self.ws.workspace_id}/source={self.source}"


def register_stream(arrivals: Arrivals, stream: DataFrame, **trigger) -> StreamingQuery:
    """Start to register what a stream brings: all there is now, unless another trigger is given."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: add_batch(arrivals, batch, number) and None)
    return writer.option("checkpointLocation", arrivals.checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def commits(arrivals: Arrivals) -> DataFrame:
    """One row for each batch that counts."""
    schema = f"{COMMIT_FACTS}, workspace_id string, source string, batch_id bigint"
    return read_rows(arrivals.ws.spark, schema, arrivals.ws.table("batches"), arrivals.part)


def add_batch(arrivals: Arrivals, batch: DataFrame, number: int) -> bool:
    """Write a batch and commit it. False, and nothing is done, if it was committed before."""
    ws, spark = arrivals.ws, arrivals.ws.spark
    require_columns(batch)
    before = (
        commits(arrivals)
        .agg(
            F.count_if(F.col("batch_id") == number).alias("done"),
            F.max(F.when(F.col("batch_id") < number, F.col("newest"))).alias("newest"),
            F.max("schema_json").alias("schema_json"),
        )
        .select("*", (F.col("newest") - F.make_dt_interval(secs=F.lit(arrivals.delay_seconds))).alias("watermark"))
        .first()
    )
    if before["done"]:
        return False
    if before["schema_json"] not in (None, batch.schema.json()):
        raise ValueError("The batch has other columns than those before it")
    when = F.col(arrivals.event_time).cast("timestamp") if arrivals.event_time else F.lit(None).cast("timestamp")
    late = F.coalesce(when < F.lit(before["watermark"]), F.lit(False))
    path = f"{arrivals.rows}/batch={number}"
    batch.withColumn(LATE, late).write.mode("overwrite").partitionBy(LATE).parquet(path)
    written = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField(LATE, T.BooleanType())])).parquet(path)
    kept = written.where(~F.col(LATE)).drop(LATE)
    state = row_states(kept).first()
    seen = written.agg(F.count_if(LATE).alias("late"), F.max(when).alias("newest")).first()
    sketches = [r.asDict() for r in column_sketches(kept).collect()]  # one row a column
    facts = (state["rows"], seen["late"], state["first"], state["second"], seen["newest"], before["watermark"])
    row = (*facts, batch.schema.json(), sketches, kept_rows(kept), datetime.now(timezone.utc))
    # One file, written last: the batch counts from here on.
    commit = small_frame(spark, [row], COMMIT_FACTS).coalesce(1)
    commit.write.mode("overwrite").parquet(f"{ws.table('batches')}/{arrivals.part}/batch_id={number}")
    return True


def arrived_version(arrivals: Arrivals) -> Row:
    """The version of all batches so far, made of what was committed with them.

    Rows, nulls, least and greatest values are exact sums of the batches; exact distinct counts and
    means would take another pass and are null: the version's sketches answer for them.
    """
    ws, spark = arrivals.ws, arrivals.ws.spark
    done = commits(arrivals)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").alias(c) for c in ("first", "second")]
    whole = done.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *sums, F.max("schema_json").alias("schema_json"))
    found = whole.first()
    if found["schema_json"] is None:
        raise ValueError("No batch has arrived")
    schema = T.StructType.fromJson(json.loads(found["schema_json"]))
    digest = whole.select(digest_of(schema).alias("digest")).first()["digest"]
    known, seq = known_version(ws, arrivals.source, digest)
    if known:
        return known
    numbers = [str(r["batch_id"]) for r in done.where("rows > 0").select("batch_id").orderBy("batch_id").collect()]
    path = f"{arrivals.rows}/batch={{{','.join(numbers)}}}/{LATE}=false"
    if not numbers:
        path = f"{arrivals.rows}/none"
        small_frame(spark, [], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)).write.mode("overwrite").parquet(path)
    states = done.select(F.inline("sketches"))
    merged = materialize(merged_sketches(states), scratch_path(spark, "merged"))
    told = {r["column"]: r for r in merged.drop("distinct_state", "quantile_state").collect()}
    columns = []
    for i, field in enumerate(schema):
        own = told[field.name]
        number = isinstance(field.dataType, T.NumericType)
        whole_number = isinstance(field.dataType, T.IntegralType)
        shown = {b: own[b] if own[b] is None or not whole_number else int(own[b]) for b in ("least", "greatest")}
        bounds = {b: str(shown[v]) if number and shown[v] is not None else None for b, v in (("min", "least"), ("max", "greatest"))}
        columns.append(
            {"position": i, "column": field.name, "type": field.dataType.simpleString(), "nullable": field.nullable, "rows": own["rows"], "missing": own["missing"],
             "nans": None, "distinct": None, **bounds, "mean": None}
        )
    texts = done.select(F.explode("sample").alias("row")).orderBy(F.xxhash64("row"), "row").limit(KEPT_ROWS)
    sample = [r["row"] for r in texts.collect()]
    return add_version(ws, arrivals.source, digest, seq, "arrivals", path, found["schema_json"], columns, sample, merged)


def late_arrivals(arrivals: Arrivals) -> DataFrame:
    """Rows that came after the watermark, with ``batch_id`` and the ``watermark`` they missed."""
    spark = arrivals.ws.spark
    done = commits(arrivals)
    schema_json = done.agg(F.max("schema_json").alias("s")).first()["s"]
    if schema_json is None:
        raise ValueError("No batch has arrived")
    schema = T.StructType.fromJson(json.loads(schema_json))
    parts = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField(LATE, T.BooleanType())])
    rows = spark.read.schema(parts).option("basePath", arrivals.rows).parquet(f"{arrivals.rows}/batch=*")
    counted = done.select(F.col("batch_id").alias("batch"), "watermark")
    return rows.where(LATE).join(counted, "batch").select(*schema.names, F.col("batch").alias("batch_id"), "watermark")
