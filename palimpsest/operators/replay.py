"""Rebuilding the state of a keyed table from a feed of inserts, updates and deletes (commit-ordered replay).

Parts are assembled into transactions, transactions are lined up by commit number, and only what lies at or below the
contiguous watermark is replayed: a number that is missing or incomplete holds everything after it. Keys don't conflict
and are replayed in parallel; a key with very many changes is cut into stretches that are replayed side by side.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.changes import first_deliveries
from palimpsest.session import bucket_count, shared_folder

#: Keys with more changes than this are replayed in stretches of about this many.
STRETCH = 200_000
#: States a stretch of changes may meet its memory in: unknown, remembered but removed, existing.
_STATES = ("none", "removed", "existing")
#: Columns by which a feed declares its transactions; every part carries its transaction's number and size.
DECLARED = ("tx_id", "part_no", "tx_size", "commit_seq")
#: Busy keys up to which they are broadcast.
FEW_KEYS = 10_000


# --- transactions ---------------------------------------------------------------------------------------------------


def complete_transactions(parts: DataFrame, tx: str = "tx_id", seq: str = "commit_seq", size: str = "tx_size") -> DataFrame:
    """(tx, seq, complete) of each transaction: complete when as many distinct parts (``part_no``) arrived as declared.

    Repeated parts count once. A transaction without a sequence number or size is never complete.
    """
    return parts.groupBy(tx).agg(
        F.max(seq).alias(seq),
        (F.count_distinct("part_no") >= F.max(size)).alias("complete"),
    ).withColumn("complete", F.coalesce(F.col("complete") & F.col(seq).isNotNull(), F.lit(False)))


def committed_watermark(transactions: DataFrame, seq: str = "commit_seq", first: int = 1, block: int = 1 << 20) -> DataFrame:
    """One row, ``watermark``: the last sequence number up to which every transaction is complete, ``first - 1`` if none.

    A gap holds everything after it, and so does a number one of whose transactions is incomplete. Blocks of ``block``
    numbers are counted in parallel; the first block that isn't full is then looked at number by number, so no task ever
    sorts the whole sequence.
    """
    numbers = transactions.where(F.col(seq) >= first).groupBy((F.col(seq) - first).alias("n")).agg(F.min("complete").alias("done"))
    done = numbers.where("done").select("n")
    full = done.groupBy(F.floor(F.col("n") / block).alias("b")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == block)
    # blocks are few (numbers / block): the first missing one comes from a window over them
    ranked = full.withColumn("r", F.row_number().over(Window.orderBy("b")) - 1).where(F.col("b") == F.col("r"))
    head = ranked.agg(F.coalesce(F.max("b") + 1, F.lit(0)).alias("head"))
    tail = done.join(F.broadcast(head), F.floor(F.col("n") / block) == F.col("head"))
    run = tail.withColumn("r", F.row_number().over(Window.orderBy("n")) - 1 + F.col("head") * block).where(F.col("n") == F.col("r"))
    return head.crossJoin(run.agg(F.max("n").alias("last"))).select(
        (F.coalesce(F.col("last"), F.col("head") * block - 1) + first).alias("watermark")
    )


def committed_parts(parts: DataFrame, tx: str = "tx_id", seq: str = "commit_seq", size: str = "tx_size", first: int = 1, block: int = 1 << 20) -> DataFrame:
    """The parts at or below the contiguous watermark of a feed whose parts carry their transaction's number.

    The watermark is one row; nothing else of the transactions is joined back, as all of them are complete below it.
    """
    mark = committed_watermark(complete_transactions(parts, tx, seq, size), seq, first, block)
    return parts.crossJoin(F.broadcast(mark)).where(F.col(seq).between(F.lit(first), F.col("watermark"))).drop("watermark")


def committed_changes(parts: DataFrame, tx: str = "tx_id", seq: str = "commit_seq", size: str = "tx_size", first: int = 1, block: int = 1 << 20) -> DataFrame:
    """:func:`committed_parts`, each part once."""
    return committed_parts(parts, tx, seq, size, first, block).dropDuplicates([tx, "part_no"])


def numbered(parts: DataFrame, order: list[str], seq: str = "commit_seq") -> DataFrame:
    """``parts`` with a dense number from 1 in the given order, which must be total.

    Rows are ranged over tasks by the whole order, so equal leading values are spread too, and written to the shared
    folder once; only the tasks' counts are added up in one place.
    """
    tasks = bucket_count(parts, 1.0)
    place = F.monotonically_increasing_id()
    laid = parts.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_task", F.spark_partition_id()).withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1)))
    stored = written(laid, "commits")
    before = F.coalesce(F.sum("c").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored.groupBy("_task").agg(F.count(F.lit(1)).alias("c")).select("_task", before.alias("_before"))  # a row a task
    return stored.join(F.broadcast(starts), "_task").withColumn(seq, F.col("_before") + F.col("_place") + 1).drop("_task", "_place", "_before")


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back."""
    folder = shared_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


# --- memory changes -------------------------------------------------------------------------------------------------


def _changes(log: DataFrame, *more: str) -> DataFrame:
    """Every change of the memory log: ``memory_id, kind, has_content, occurred_at, arrival, id, applies`` and ``more``.

    The payload is reduced to what replay needs before anything is shuffled.
    """
    parsed = F.try_parse_json("payload_json")
    slim = log.select(
        "id", "scope_key", "idempotency_key", "occurred_at", "created_at", *more,
        "memory_id",
        F.coalesce("memory_id", F.try_variant_get(parsed, "$.memory_id", "string")).alias("target"),
        F.lower(F.trim("event_type")).alias("kind"),
        (parsed.isNotNull()).alias("valid"),
        F.coalesce(F.try_variant_get(parsed, "$.content", "string").isNotNull(), F.lit(False)).alias("has_content"),
    )
    first = first_deliveries(slim, "occurred_at", "target", "kind", "valid", "has_content", *more)
    kinds = ("remembered", "reinforced", "superseded", "contradicted", "forgotten", "restored")
    applies = F.coalesce(F.col("valid") & F.col("target").isNotNull() & F.col("kind").isin(*kinds), F.lit(False))
    return first.select(F.col("target").alias("memory_id"), "kind", "has_content", "occurred_at", "arrival", "id", applies.alias("applies"), *more)


def memory_changes(log: DataFrame) -> DataFrame:
    """The replayable changes of the memory log: ``memory_id, kind, has_content, occurred_at, arrival, id``.

    A change is represented by the first of its deliveries to arrive. It is skipped when that row's payload isn't valid
    JSON or no memory is named (column, else ``memory_id`` of the payload); unknown or null types have no effect and are
    skipped too.
    """
    return _changes(log).where("applies").drop("applies")


def committed_memory_changes(log: DataFrame, first: int = 1) -> DataFrame:
    """The replayable changes of the log at or below its contiguous committed watermark.

    A log with the columns ``DECLARED`` tells its transactions, numbered from ``first``: what is incomplete, or lies after
    a missing number, is held back. Without them every change is a transaction of one part, and its number is its place
    in the order ``occurred_at``, ``arrival``, ``id`` of the whole log. A change that can't be replayed, such as one of
    broken JSON, still takes its number.
    """
    order = ["occurred_at", "arrival", "id"]
    if set(DECLARED) <= set(log.columns):
        parts = written(_changes(log, *DECLARED), "commits")
    else:
        parts = numbered(_changes(log), order).withColumns({"tx_id": F.col("commit_seq"), "part_no": F.lit(1), "tx_size": F.lit(1)})
    return committed_parts(parts, first=first).where("applies").drop("applies", *DECLARED)


def _outcomes(changes: DataFrame, keys: list[str], states: tuple[str, ...]) -> DataFrame:
    """What a run of a key's changes does to a memory that enters it in each of ``states``: one struct a state.

    Window frames that only grow are evaluated in one pass over the sorted run, without holding it in memory.
    """
    order = Window.partitionBy(*keys).orderBy("occurred_at", "arrival", "id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    remembered, kind = F.col("kind") == "remembered", F.col("kind")
    known = {s: F.coalesce(F.max(remembered).over(before), F.lit(False)) if s == "none" else F.lit(True) for s in states}
    step = changes.withColumns({f"known_{s}": k for s, k in known.items()})
    step = step.withColumns({f"life_{s}": remembered | ((kind == "restored") & F.col(f"known_{s}")) for s in states})
    step = step.withColumns({f"lived_{s}": F.when(F.col(f"life_{s}"), True).when(kind == "forgotten", False) for s in states})
    step = step.withColumns({f"alive_{s}": F.coalesce(F.last(f"lived_{s}", ignorenulls=True).over(before), F.lit(s == "existing")) for s in states})
    at = F.struct("occurred_at", "arrival", "id")

    def ends(s: str) -> list[Column]:
        life, lived = F.col(f"life_{s}"), F.col(f"lived_{s}")
        effective = life | (F.col(f"alive_{s}") & (kind != "restored"))
        kept = effective & (kind != "forgotten")
        setting = F.when(life, "active").when(kept & kind.isin("superseded", "contradicted"), kind)
        return [
            F.max_by(lived, F.when(lived.isNotNull(), at)).alias(f"end_{s}"),
            F.max(remembered).alias(f"remembered_{s}"),
            F.max_by(setting, F.when(setting.isNotNull(), at)).alias(f"status_{s}"),
            F.max(F.when(kept & F.col("has_content"), at)).getField("id").alias(f"content_{s}"),
            F.max(F.when(effective, at)).getField("id").alias(f"last_{s}"),
        ]

    grouped = step.groupBy(*keys).agg(*(c for s in states for c in ends(s)))
    named = {"lived": "end", "remembered": "remembered", "status": "status", "content_event_id": "content", "last_event_id": "last"}
    return grouped.select(*keys, *(F.struct(*(F.col(f"{short}_{s}").alias(long) for long, short in named.items())).alias(s) for s in states))


def replay(changes: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """State of every memory that exists at the end of the feed.

    Returns ``memory_id, status, content_event_id, last_event_id``. Changes of a memory apply by ``occurred_at``,
    ``arrival`` and ``id`` (nulls first); memories don't touch each other and are replayed in parallel. A key with more
    than ``stretch`` changes is cut in that order: its stretches are replayed side by side for each state they may be
    entered in, in one pass, and the outcomes are composed, which gives the same result as one pass over the key. An empty
    feed gives no rows.
    """
    changes = changes.where(F.col("memory_id").isNotNull())
    busy = changes.groupBy("memory_id").count().where(F.col("count") > stretch).persist(StorageLevel.MEMORY_AND_DISK)
    keys, rows = busy.agg(F.count(F.lit(1)), F.sum("count")).first()
    columns = ["memory_id", "status", "content_event_id", "last_event_id"]
    hot = busy.select("memory_id")
    hot = F.broadcast(hot) if keys <= FEW_KEYS else hot
    calm = changes.join(hot, "memory_id", "left_anti") if keys else changes
    result = _outcomes(calm, ["memory_id"], ("none",)).select("memory_id", "none.*").where("lived").select(*columns)
    if not keys:
        return result
    return result.unionByName(_replay_busy(changes.join(hot, "memory_id", "left_semi"), rows, stretch).select(*columns))


def _replay_busy(hot: DataFrame, rows: int, stretch: int) -> DataFrame:
    # ranges of the whole order of replay: changes of one instant are spread too
    tasks = max(int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * -(-rows // stretch))
    cut = hot.repartitionByRange(tasks, "memory_id", "occurred_at", "arrival", "id").withColumn("stretch", F.spark_partition_id())
    outcome = _outcomes(cut, ["memory_id", "stretch"], _STATES)
    steps = F.array_sort(F.collect_list(F.struct("stretch", *_STATES)))  # at most one a task
    blank = F.struct(
        F.lit(False).alias("alive"), F.lit(False).alias("known"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("content_event_id"), F.lit(None).cast("string").alias("last_event_id"),
    )

    def compose(state: Column, step: Column) -> Column:
        done = F.when(state["alive"], step["existing"]).when(state["known"], step["removed"]).otherwise(step["none"])
        return F.struct(
            F.coalesce(done["lived"], state["alive"]).alias("alive"),
            (state["known"] | done["remembered"]).alias("known"),
            F.coalesce(done["status"], state["status"]).alias("status"),
            F.coalesce(done["content_event_id"], state["content_event_id"]).alias("content_event_id"),
            F.coalesce(done["last_event_id"], state["last_event_id"]).alias("last_event_id"),
        )

    folded = outcome.groupBy("memory_id").agg(F.aggregate(steps, blank, compose).alias("end"))
    return folded.where("end.alive").select("memory_id", "end.status", "end.content_event_id", "end.last_event_id")


def rebuilt_memories(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(memory_id, status, content, kind, content_at, updated_at): the projection of memories, rebuilt from its log.

    Content and kind are those of the change that supplied the content, null where none did; ``updated_at`` is the time of
    the last change with effect. Only changes that matter to a memory that exists are looked up again, by joins.
    """
    now = current_memories(log, stretch)
    payload = F.try_parse_json("payload_json")
    wanted = now.select(F.col("content_event_id").alias("id")).union(now.select("last_event_id")).where("id is not null").distinct()
    rows = log.where(F.col("created_at").isNotNull()).select("id", "created_at", "occurred_at", F.try_variant_get(payload, "$.content", "string").alias("content"), F.try_variant_get(payload, "$.kind", "string").alias("kind"))
    rows = rows.join(wanted, "id", "left_semi").groupBy("id").agg(F.min(F.struct("created_at", "occurred_at", "content", "kind")).alias("r"))
    supplied = rows.select(F.col("id").alias("content_event_id"), "r.content", "r.kind", F.col("r.occurred_at").alias("content_at"))
    last = rows.select(F.col("id").alias("last_event_id"), F.col("r.occurred_at").alias("updated_at"))
    return now.join(supplied, "content_event_id", "left").join(last, "last_event_id", "left").select("memory_id", "status", "content", "kind", "content_at", "updated_at")


def current_memories(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The memories existing at the committed end of the log, from its deliveries: :func:`committed_memory_changes`, replayed."""
    return replay(committed_memory_changes(log), stretch)
