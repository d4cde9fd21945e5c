"""Physical erasure of memories with everything that depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.graph import connected_components


def supersession_links(log: DataFrame) -> DataFrame:
    """(scope_key, a, b): memories joined by a supersession, from the log's payloads."""
    named = F.coalesce("memory_id", F.try_variant_get(F.try_parse_json("payload_json"), "$.memory_id", "string"))
    other = F.try_variant_get(F.try_parse_json("payload_json"), "$.replacement_memory_id", "string")
    superseded = log.where(F.lower(F.trim("event_type")) == "superseded")
    return superseded.select("scope_key", named.alias("a"), other.alias("b")).where("a is not null and b is not null and a <> b").distinct()


class Erasure:
    """What is left of the tables when the requested memories (``scope_key``, ``id``) are erased.

    Only memories of their own scope can be asked for: unknown or foreign ids raise ``LookupError``. A request that
    would split a chain of supersessions raises ``ValueError``, unless ``cascade`` takes the whole chain. Erased memories
    take along their events, and the evidence that names either. Nothing requested erases nothing; the tables are compared
    by joins, so the request may be as large as they are.
    """

    def __init__(self, memories: DataFrame, log: DataFrame, evidence: DataFrame, requested: DataFrame, cascade: bool = False):
        asked = requested.select("scope_key", "id").distinct()
        owned = memories.select("scope_key", "id").join(asked, ["scope_key", "id"], "left_semi").distinct()
        unknown = asked.join(owned, ["scope_key", "id"], "left_anti")
        if not unknown.isEmpty():
            raise LookupError("memories that are not in their scope")
        links = supersession_links(log)
        known = memories.select("scope_key", F.col("id").alias("a")).distinct()
        inside = links.join(known, ["scope_key", "a"], "left_semi").join(known.withColumnRenamed("a", "b"), ["scope_key", "b"], "left_semi")
        # a memory has one scope, so components over ids stay within it
        part = connected_components(inside, "a", "b").toDF("id", "component")
        hit = part.join(owned.select("id"), "id", "left_semi").select("component").distinct()
        chain = part.join(hit, "component", "left_semi").select("id")
        beyond = chain.join(owned.select("id"), "id", "left_anti")
        if not cascade and not beyond.isEmpty():
            raise ValueError("erasure would split a chain of supersessions; cascade takes it whole")
        self.erased = owned.select("id").union(beyond.select("id")).distinct()
        named = F.coalesce("memory_id", F.try_variant_get(F.try_parse_json("payload_json"), "$.memory_id", "string"))
        gone = self.erased.withColumnRenamed("id", "_named")
        marked = log.withColumn("_named", named)
        self.events = marked.join(gone, "_named", "left_anti").select(*log.columns)
        self.erased_events = marked.join(gone, "_named", "left_semi").select("id").where("id is not null").distinct()
        self.memories = memories.join(self.erased, "id", "left_anti").select(*memories.columns)
        left = evidence
        for column, out in (("memory_id", self.erased), ("source_memory_id", self.erased), ("event_id", self.erased_events)):
            left = left.join(out.withColumnRenamed("id", column), column, "left_anti")
        self.evidence = left.select(*evidence.columns)
