"""The lambda views of :mod:`palimpsest.operators.lambda_view` kept as tables between runs.

``log/batch=K`` holds what arrived in micro-batch K, ``new/batch=K`` the changes no earlier batch had delivered and
``fast/batch=K`` their increments; ``views/run=N`` holds the periods that scheduled run N recomputed, with those it
froze, and ``runs/run=N``, written last, makes the run valid. A step that is repeated, whole or after a crash, overwrites
its own folders or finds itself done, so nothing is counted twice and no frozen period is lost.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.lambda_view import CUT_OFF, PUBLISH_AFTER, dated_changes, fast_increments, first_open_day, published, recomputed

_LOG = "id string, scope_key string, tenant_id string, memory_id string, idempotency_key string, occurred_at timestamp_ntz, created_at timestamp_ntz"
_NEW = "tenant_id string, day date, arrival timestamp_ntz, change binary"
_FAST = "tenant_id string, day date, arrival_hour timestamp_ntz, n bigint"
_VIEW = "tenant_id string, day date, n bigint, closed boolean"
_RUN = "as_of timestamp_ntz, through bigint"
HOUR = timedelta(hours=1)


class LambdaStore:
    """Lambda views of a log of deliveries under one folder.

    A delivery carries its change's ``occurred_at``. Batches are taken in order of arrival; one that arrives later than
    its ``created_at`` tells is provisional until the next run. ``publish_after`` and ``cut_off`` are whole hours.
    """

    def __init__(self, spark: SparkSession, path: str, cut_off: timedelta = CUT_OFF, publish_after: timedelta = PUBLISH_AFTER):
        if cut_off % HOUR or publish_after % HOUR:
            raise ValueError("cut_off and publish_after must be whole hours")
        self.spark, self.path, self.cut_off, self.publish_after = spark, path.rstrip("/"), cut_off, publish_after

    def _done(self, name: str) -> list[int]:
        """Numbers of the finished folders of a table, ascending; folder names only are listed."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        folders = [s.getPath() for s in fs.listStatus(p) if "=" in s.getPath().getName()]
        marked = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(f.getName().split("=")[1]) for f in folders if fs.exists(marked(f, "_SUCCESS")))

    def _read(self, name: str, schema: str, number: str) -> DataFrame:
        schema = f"{schema}, {number} bigint"
        if self._done(name):
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")

    # --- fast layer ---

    def ingest(self, rows: DataFrame, batch_id: int) -> None:
        """Appends one micro-batch to the log and adds the increments of the changes that no earlier batch delivered.

        Only the days of the batch that are still counted are looked up among the earlier changes, so the work follows
        the batch and the open days, not the log.
        """
        names = [c.split()[0] for c in _LOG.split(", ")]
        self._write(rows.select(*(F.col(c).cast("timestamp_ntz") if c.endswith("_at") else F.col(c) for c in names)), f"log/batch={batch_id}")
        mine = dated_changes(self.log().where(F.col("batch") == batch_id))
        first, last = self.log().where((F.col("batch") == batch_id) & F.col("created_at").isNotNull()).agg(F.min(F.to_date("occurred_at")), F.max(F.to_date("occurred_at"))).first()
        if first is not None and any(b < batch_id for b in self._done("new")):
            seen = self._read("new", _NEW, "batch").where((F.col("batch") < batch_id) & F.col("day").between(F.lit(first), F.lit(last)))
            mine = mine.join(seen.select("change"), "change", "left_anti")
        self._write(mine.select("tenant_id", "day", "arrival", "change"), f"new/batch={batch_id}")
        new = self._read("new", _NEW, "batch").where(F.col("batch") == batch_id)
        self._write(fast_increments(new, self.cut_off), f"fast/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.ingest).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def log(self) -> DataFrame:
        return self._read("log", _LOG, "batch")

    # --- batch layer ---

    def _last_run(self) -> tuple[int, datetime, int] | None:
        """(run, as_of, through) of the last valid run."""
        done = self._done("runs")
        if not done:
            return None
        row = self.spark.read.schema(_RUN).parquet(f"{self.path}/runs/run={done[-1]}").first()
        return done[-1], row["as_of"], row["through"]

    def run_batch(self, run: int, as_of: datetime) -> None:
        """Recomputes the periods still open at the last run from the full log as of an instant, and freezes those now past
        their cut-off.

        ``as_of`` is taken down to the full hour. A run that is already valid is left as it is; others must follow it in
        number and time. Days frozen earlier are neither read nor written.
        """
        as_of = as_of.replace(minute=0, second=0, microsecond=0)
        last = self._last_run()
        if last and run in self._done("runs"):
            return
        if last and (run < last[0] or as_of < last[1]):
            raise ValueError(f"run {run} as of {as_of} comes after run {last[0]} as of {last[1]}")
        through = max(self._done("fast"), default=-1)
        log = self.log().where((F.col("batch") <= through) & (F.col("created_at") < F.lit(as_of).cast("timestamp_ntz")))
        if last:
            log = log.where(F.col("occurred_at") >= F.lit(datetime.combine(first_open_day(last[1], self.cut_off), datetime.min.time())).cast("timestamp_ntz"))
        self._write(recomputed(dated_changes(log), as_of, self.cut_off), f"views/run={run}")
        self._write(self.spark.createDataFrame([(as_of, through)], _RUN).coalesce(1), f"runs/run={run}")

    # --- serving ---

    def serve(self) -> DataFrame:
        """(tenant_id, day, n, state): frozen periods; open ones as last recomputed plus what has arrived since.

        What the last run didn't see is what came in later batches or arrived at or after its instant.
        """
        view, fast, last = self._read("views", _VIEW, "run"), self._read("fast", _FAST, "batch"), self._last_run()
        frozen = open_ = view.limit(0)
        if last:
            run, as_of, through = last
            frozen = view.where((F.col("run") <= run) & F.col("closed"))
            open_ = view.where((F.col("run") == run) & ~F.col("closed"))
            unseen = (F.col("batch") > through) | (F.col("arrival_hour") >= F.lit(as_of).cast("timestamp_ntz"))
            fast = fast.where((F.col("day") >= F.lit(first_open_day(as_of, self.cut_off))) & unseen)
        both = open_.select("tenant_id", "day", "n").unionByName(fast.select("tenant_id", "day", "n"))
        provisional = both.groupBy("tenant_id", "day").agg(F.sum("n").alias("n")).withColumn("state", F.lit("open"))
        return frozen.select("tenant_id", "day", "n", F.lit("frozen").alias("state")).unionByName(provisional)

    def layers(self) -> DataFrame:
        """(tenant_id, event_day, n_first, n_final, frozen): each period as the fast layer published it and as served now.

        Null tenants form a tenant of their own.
        """
        first = published(self._read("fast", _FAST, "batch"), self.publish_after).select("tenant_id", "day", F.col("n").alias("n_first"), F.lit(0).alias("n_final"))
        final = self.serve().select("tenant_id", "day", F.lit(0).alias("n_first"), F.col("n").alias("n_final"))
        last = self._last_run()
        frozen = F.col("day") < F.lit(first_open_day(last[1], self.cut_off)) if last else F.lit(False)
        both = first.unionByName(final).groupBy("tenant_id", "day").agg(F.sum("n_first").alias("n_first"), F.sum("n_final").alias("n_final"))
        return both.select("tenant_id", F.col("day").cast("string").alias("event_day"), "n_first", "n_final", frozen.alias("frozen"))


def played(log: DataFrame, store: LambdaStore, batches: int = 3) -> DataFrame:
    """The layers of a whole log, played into an empty store: by arrival in ``batches`` micro-batches, each followed by a
    scheduled run, and a last run after every cut-off.

    An empty log gives no rows.
    """
    at = log.agg(F.min("created_at").cast("timestamp_ntz"), F.max("created_at").cast("timestamp_ntz"), F.max("occurred_at").cast("timestamp_ntz")).first()
    if at[0] is None:
        return store.layers()
    begin, end = (t.replace(minute=0, second=0, microsecond=0) for t in (at[0], at[1] + HOUR))
    cuts = sorted({(begin + (end - begin) * i / batches).replace(minute=0, second=0, microsecond=0) for i in range(batches)} | {end})
    for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
        store.ingest(log.where((F.col("created_at") >= F.lit(a).cast("timestamp_ntz")) & (F.col("created_at") < F.lit(z).cast("timestamp_ntz"))), i)
        store.run_batch(i, z)
    closed = max(end, (at[2] or end) + timedelta(days=1) + store.cut_off + HOUR)
    store.run_batch(len(cuts), closed)
    return store.layers()


def corrected_periods(log: DataFrame, store: LambdaStore, batches: int = 3) -> DataFrame:
    """The periods whose published count differs from the final one."""
    return played(log, store, batches).where(F.col("n_first") != F.col("n_final")).select("tenant_id", "event_day", "n_first", "n_final")
