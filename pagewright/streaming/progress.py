"""Progress of staged jobs: estimates folded over events, in batch and as a stateful stream, and marker lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.names import PROGRESS_MARKER
from pagewright.operators.scans import ALPHA, rates

# The stages in order with their shares of the whole, and what is enough to go by.
WEIGHTS = {"split": 0.05, "ocr": 0.75, "structure": 0.05, "render": 0.05}
LEAST_ITEMS, LEAST_SECONDS = 2, 1.0
MARKER = PROGRESS_MARKER
KNOWN = ["job", "seq", "stage", "done", "total", "now", "rate", "begun"]


def told(rows: DataFrame) -> DataFrame:
    """Seconds left of the stage and of all stages, from what is done, the rate, and when the stage began.

    By the rate where there is one, else in proportion once there is enough to go by; what comes after takes its share.
    """
    names = list(WEIGHTS)
    later = {n: sum(WEIGHTS[k] for k in names[i + 1 :]) / WEIGHTS[n] for i, n in enumerate(names)}
    c = F.col
    left = c("total") - c("done")
    rows = rows.withColumn("spent", F.greatest(F.lit(0.0), c("now") - c("begun")))
    few = (c("done") < LEAST_ITEMS) | (c("spent") < LEAST_SECONDS)
    eta = F.when(c("total") <= 0, F.lit(None).cast("double")).when(left <= 0, 0.0).when(c("rate") > 0, left / c("rate")).when(~few, left * c("spent") / c("done"))
    rows = rows.withColumn("eta_sec", eta)
    share = F.coalesce(*[F.when(c("stage") == n, v) for n, v in later.items()])
    whole = F.when(c("stage").isin("done", "error"), 0.0).when(c("eta_sec").isNotNull(), c("eta_sec") + share * (c("spent") + c("eta_sec")))
    return rows.select("job", "seq", "stage", "done", "total", "eta_sec", whole.alias("eta_total_sec"), "rate")


def _events(events: DataFrame) -> DataFrame:
    whole = lambda n: F.coalesce(F.col(n).cast("long"), F.lit(0)).alias(n)
    return events.select("job", F.col("seq").cast("long").alias("seq"), F.coalesce("stage", F.lit("")).alias("stage"), whole("done"), whole("total"), F.col("now").cast("double").alias("now"))


def estimates(events: DataFrame) -> DataFrame:
    """An estimate after each event (job, seq, stage, done, total, now), in order of seq, however long a job is."""
    return told(rates(_events(events), "job", "stage", "done", "now", ["seq"]))


def streaming_estimates(events: DataFrame) -> DataFrame:
    """The same from a stream; a job's state is its last event, when the stage began, and the rate. A batch's events are
    taken in order of seq."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def follow(key, batches, state):
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values("seq", ignore_index=True)
        stage, done, now, begun, rate = state.get if state.exists else (None, 0, 0.0, 0.0, 0.0)
        before = pd.concat([pd.DataFrame({"stage": [stage], "done": [done], "now": [now]}), rows[["stage", "done", "now"]]], ignore_index=True).iloc[:-1]
        new = rows["stage"] != before["stage"]
        gone, made = rows["now"] - before["now"], rows["done"] - before["done"]
        speed = (made / gone).where((gone > 0) & (made > 0) & ~new)
        smooth = []
        for restart, s in zip(new, speed):
            rate = 0.0 if restart else rate
            rate = rate if pd.isna(s) else s if rate <= 0 else ALPHA * s + (1 - ALPHA) * rate
            smooth.append(rate)
        since = rows["now"].where(new).ffill().fillna(begun)
        last = rows.iloc[-1]
        state.update((last["stage"], int(last["done"]), float(last["now"]), float(since.iloc[-1]), float(rate)))
        yield rows.assign(job=key[0], rate=smooth, begun=since)[KNOWN]

    kinds = "job string, seq long, stage string, done long, total long, now double, rate double, begun double"
    followed = _events(events).groupBy("job").applyInPandasWithState(follow, kinds, "stage string, done long, now double, begun double, rate double", "append", GroupStateTimeout.NoTimeout)
    return told(followed)


def markers(lines: DataFrame, value: str = "value") -> DataFrame:
    """stage, done and total of the marker lines of a text stream."""
    c: Column = F.col(value)
    body = F.from_json(F.substring(c, F.lit(len(MARKER) + 1), F.length(c)), "stage string, done long, total long")
    return lines.where(F.startswith(c, F.lit(MARKER))).select(body.alias("m")).select("m.*")


def follow_pages(spark, folder: str, schema: str, sink, checkpoint: str, seconds: int | None = 2):
    """Follow a folder of per-page result files: each micro-batch's newest row of a page goes to ``sink(df, batch_id)``.

    A batch every so many seconds at most; with none, what is there is read and the stream ends.
    """

    def upsert(df, batch_id):
        newest = df.groupBy("book", "page").agg(F.max_by(F.struct("text", "version"), "version").alias("r"))
        sink(newest.select("book", "page", "r.text", "r.version"), batch_id)

    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**({"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True})).start()
