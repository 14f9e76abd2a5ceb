"""Classification metrics and run-level figures M1-M9.

Per-class counts come from one pass: each (truth, prediction) row becomes
two entries, (truth: t=1, tp) and (prediction: p=1), summed per class with
map-side partial aggregation, so a hot class never sits in one task. F1 is
``2tp / (t + p)`` with 0 for an undefined ratio, over the classes present in
the truth or the predictions.
"""

from __future__ import annotations

from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(truth: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """M5: pair truth and prediction by key (inner equi-join).

    Only for predictions stored apart from their truth. Scoring in this
    package carries the truth column with each row, which pairs them with
    no shuffle at all.
    """
    return truth.join(predictions, key, "inner")


def class_report(df: DataFrame, truth: str = "truth", pred: str = "pred",
                 by: list[str] | None = None, keep_null: bool = False, weight: str | None = None) -> DataFrame:
    """M4: per class (and group): support, predicted, true positives, F1.

    ``keep_null`` keeps the rows without a truth or prediction as a null class.
    ``weight`` is a column with the number of rows that a row stands for.
    """
    by = list(by or [])
    one = F.col(weight).cast("long") if weight else F.lit(1)
    none = F.lit(0).cast("long") if weight else F.lit(0)
    entries = F.explode(F.array(
        F.struct(F.col(truth).cast("string").alias("cls"), one.alias("t"), none.alias("p"),
                 F.when(F.col(truth) == F.col(pred), one).otherwise(none).alias("tp")),
        F.struct(F.col(pred).cast("string").alias("cls"), none.alias("t"), one.alias("p"),
                 none.alias("tp")),
    ))
    exploded = df.select(*by, entries.alias("e")).select(*by, "e.*")
    if not keep_null:
        exploded = exploded.where(F.col("cls").isNotNull())
    counts = exploded.groupBy(*by, "cls").agg(
        F.sum("t").cast("long").alias("support"),
        F.sum("p").cast("long").alias("predicted"),
        F.sum("tp").cast("long").alias("true_pos"),
    )
    f1 = F.coalesce(F.try_divide(2.0 * F.col("true_pos"), (F.col("support") + F.col("predicted")).cast("double")),
                    F.lit(0.0))
    return counts.withColumn("f1", f1)


def accuracy(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """M1: share of rows where prediction equals truth."""
    by = list(by or [])
    hit = F.coalesce((F.col(truth) == F.col(pred)).cast("double"), F.lit(0.0))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def f1_scores(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """M2 + M3: macro F1 (unweighted over classes) and support-weighted F1."""
    by = list(by or [])
    rep = class_report(df, truth, pred, by)
    return rep.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double")).alias("weighted_f1"),
        F.count(F.lit(1)).alias("n_classes"),
    )


def classification_metrics(df: DataFrame, truth: str = "truth", pred: str = "pred",
                           by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """accuracy, macro F1 and weighted F1 in one frame (per group); a row without a truth is a miss."""
    by = list(by or [])
    # One pass: accuracy is true positives over rows, and both follow from the per-class counts.
    rep = class_report(df, truth, pred, by, keep_null=True, weight=weight)
    known = F.col("cls").isNotNull()
    return rep.groupBy(*by).agg(
        F.sum("support").alias("n"),
        F.try_divide(F.sum("true_pos").cast("double"), F.sum("support").cast("double")).alias("accuracy"),
        F.avg(F.when(known, F.col("f1"))).alias("macro_f1"),
        F.try_divide(F.sum(F.when(known, F.col("f1") * F.col("support"))),
                     F.sum(F.when(known, F.col("support"))).cast("double")).alias("weighted_f1"),
        F.count(F.when(known, F.lit(1))).alias("n_classes"),
    )


def throughput(samples, elapsed) -> F.Column:
    """M6: samples / elapsed, null when elapsed is 0 or missing (guarded everywhere)."""
    s = F.col(samples) if isinstance(samples, str) else samples
    e = F.col(elapsed) if isinstance(elapsed, str) else elapsed
    return F.try_divide(s.cast("double"), e.cast("double"))


def total_time(mode: str = "mode", extraction: str = "embed_extraction_time_sec",
               train: str = "train_time_sec") -> F.Column:
    """M7: extraction + training when frozen, training only otherwise."""
    return F.when(F.col(mode) == "frozen", F.col(extraction) + F.col(train)).otherwise(F.col(train))


def current_rss() -> int:
    """Resident bytes of this process now (not the high-water mark of a reused worker)."""
    import os
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


class PeakWatch:
    """Largest growth of this process's resident memory since the watch began, read by a thread.

    Memory that is taken and given back inside a batch is seen, if it is held for a few
    ``interval``s. ``lap`` is the largest growth since the last lap; the end of a lap is always read.
    """

    def __init__(self, on: bool = True, interval: float = 0.005):
        self._on, self._interval, self._largest = on, interval, 0

    def _read(self) -> int:
        self._largest = max(self._largest, current_rss() - self._start)
        return self._largest

    def _watch(self) -> None:
        while not self._done.wait(self._interval):
            self._read()

    def __enter__(self) -> PeakWatch:
        import threading
        self._done = threading.Event()
        if self._on:
            self._start = current_rss()
            self._thread = threading.Thread(target=self._watch, daemon=True)
            self._thread.start()
        return self

    def __exit__(self, *failure) -> None:
        self._done.set()
        if self._on:
            self._thread.join()

    def lap(self) -> int:
        largest = self._read()
        self._largest = 0
        return largest


class _Largest(AccumulatorParam):
    """The largest value added: a retried task changes nothing."""

    def zero(self, value):
        return value

    def addInPlace(self, a, b):
        return max(a, b)


def peak_accumulator(spark):
    """Accumulator of the largest memory growth, in bytes, that any task reports."""
    return spark.sparkContext.accumulator(0, _Largest())


def batch_telemetry(telemetry: DataFrame, every: int = 10) -> DataFrame:
    """M8: progress lines (every ``every``-th batch and the last) per task.

    Running totals are windows partitioned by task, ordered by batch number;
    a task's batches are bounded by its partition size.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("task_id").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("batch_no").over(Window.partitionBy("task_id"))
    done = F.sum("rows").over(w)
    spent = F.sum("elapsed_ns").over(w)
    t = telemetry.select("task_id", "batch_no", done.alias("done"), spent.alias("elapsed_ns"),
                         last.alias("last_batch"))
    t = t.withColumn("samples_per_sec", F.try_divide(F.col("done") * F.lit(1e9), F.col("elapsed_ns").cast("double")))
    return t.where((F.col("batch_no") % every == 0) | (F.col("batch_no") == F.col("last_batch")))


def run_progress(telemetry: DataFrame, lines: int = 10) -> DataFrame:
    """M8 for the whole run: one line when each of ``lines`` equal shares of the rows is done.

    ``telemetry``: task_id, batch_no, rows, ended_at (microseconds) of every mini-batch. Batches of all tasks are
    merged by their clocks (ties by task and batch): a range sort, one sum per range
    partition, and running totals only inside the at most ``lines`` partitions in which a share is reached.
    Output: percent, done, total, batches' end, seconds since the first end and rows per second since then
    (null at the first instant). No rows: no lines.
    """
    from pyspark.sql import Window

    from vectorloom.operators.sampling import range_tagged
    tagged = range_tagged(telemetry.select("ended_at", "task_id", "batch_no", F.col("rows").cast("long").alias("rows")),
                          ["ended_at", "task_id", "batch_no"])
    # One row per range partition from here to the lookup.
    sums = tagged.groupBy("_vl_pid").agg(F.sum("rows").alias("n"), F.min("ended_at").alias("first"))
    upto = Window.orderBy("_vl_pid").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    sums = sums.select("_vl_pid", F.sum("n").over(upto).alias("after"), F.col("n"),
                       F.sum("n").over(everything).alias("total"), F.min("first").over(everything).alias("started"))
    share = lambda done: F.floor(done * lines / F.col("total"))
    reached = (sums.withColumn("before", F.col("after") - F.col("n")).drop("n")
               .where((F.col("total") > 0) & (share(F.col("after")) > share(F.col("before")))).drop("after"))
    inside = Window.partitionBy("_vl_pid").orderBy("_vl_mid").rowsBetween(Window.unboundedPreceding, 0)
    rows = tagged.join(F.broadcast(reached), "_vl_pid").withColumn("done", F.col("before") + F.sum("rows").over(inside))
    now, then = share(F.col("done")), share(F.col("done") - F.col("rows"))
    seconds = (F.col("ended_at") - F.col("started")) / 1e6
    return rows.where(now > then).select(
        F.explode(F.sequence(then + 1, now)).alias("k"), "done", "total", "ended_at", seconds.alias("elapsed_sec"),
        F.try_divide(F.col("done").cast("double"), seconds).alias("samples_per_sec"),
    ).select((F.col("k") * 100 / lines).alias("percent"), "done", "total", "ended_at", "elapsed_sec", "samples_per_sec")


def task_resources(telemetry: DataFrame) -> DataFrame:
    """M9: per task wall time, rows and RSS growth, then totals for the run."""
    per_task = telemetry.groupBy("task_id").agg(
        F.sum("rows").alias("rows"), F.sum("elapsed_ns").alias("elapsed_ns"),
        F.max("rss_growth").alias("rss_growth"))
    return per_task.agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum("rows").alias("rows"),
        (F.sum("elapsed_ns") / 1e9).alias("busy_sec"),
        (F.max("elapsed_ns") / 1e9).alias("slowest_task_sec"),
        (F.max("rss_growth") / 1e9).alias("peak_rss_growth_gb"),
    )
