"""Association networks over edge tables: paths, walks, reinforcement, upkeep, joins that propose links, and exports.

Edges are two-way rows (u, v, weight) unless said otherwise. Null ends and self-loops are dropped where they would matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import bucket_count, by_bucket, checkpoint

# --- paths ----------------------------------------------------------------------------------------------------------


def shortest_paths(edges: DataFrame, sources: DataFrame, max_hops: int = 1_000) -> DataFrame:
    """(source, target, hops, path): one shortest path from each source to every node it reaches, the least by node order.

    Breadth first, one join a hop; a pair is settled at its first hop and never again, so cycles end. ``sources`` has a
    column ``source``. Targets farther than ``max_hops`` raise an error. No edges or sources give no rows.
    """
    links = edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct()
    front = checkpoint(sources.select("source", F.col("source").alias("target"), F.array("source").alias("path")).where("source is not null").dropDuplicates(["source"]))
    reached = front.limit(0).select("source", "target", F.lit(0).alias("hops"), "path")
    settled = front.select("source", "target")
    for hop in range(1, max_hops + 2):
        onward = front.join(links, front["target"] == links["u"]).select("source", F.col("v").alias("target"), F.array_append("path", F.col("v")).alias("path"))
        front = checkpoint(onward.join(settled, ["source", "target"], "left_anti").groupBy("source", "target").agg(F.min("path").alias("path")))
        if front.isEmpty():
            return reached
        if hop > max_hops:
            raise ValueError(f"paths longer than {max_hops} hops")
        reached = reached.unionByName(front.select("source", "target", F.lit(hop).alias("hops"), "path"))
        settled = settled.unionByName(front.select("source", "target"))
    return reached


def simple_paths(edges: DataFrame, sources: DataFrame, max_hops: int = 3, least: float = 0.1) -> DataFrame:
    """(source, target, hops, path, strength): every path without a repeated node of at most ``max_hops`` edges of at least
    ``least``; its strength is the product of its edges' weights."""
    links = edges.where((F.col("weight") >= least) & (F.col("u") != F.col("v"))).groupBy("u", "v").agg(F.max("weight").alias("weight"))
    front = sources.where("source is not null").select("source", F.col("source").alias("target"), F.array("source").alias("path"), F.lit(1.0).alias("strength")).dropDuplicates(["source"])
    found = None
    for hop in range(1, max_hops + 1):
        onward = front.join(links, (front["target"] == links["u"]) & ~F.array_contains("path", F.col("v")))
        front = onward.select("source", F.col("v").alias("target"), F.array_append("path", F.col("v")).alias("path"), (F.col("strength") * F.col("weight")).alias("strength"))
        part = front.select("source", "target", F.lit(hop).alias("hops"), "path", "strength")
        found = part if found is None else found.unionByName(part)
    return found


def random_walks(edges: DataFrame, sources: DataFrame, steps: int, seed: str = "walk") -> DataFrame:
    """(source, path): a walk of up to ``steps`` from each source that goes on to a neighbour drawn by hash.

    Every neighbour is as likely; the same seed gives the same walks. A walk ends where no edge leads on.
    """
    links = edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct()
    walks = sources.where("source is not null").select("source", F.array("source").alias("path")).dropDuplicates(["source"])
    for step in range(1, steps + 1):
        drawn = F.md5(F.concat_ws("|", F.lit(seed), F.lit(str(step)), "source", "v").cast("binary"))
        here = walks.where(F.size("path") == step).join(links, F.element_at("path", -1) == links["u"])
        chosen = here.groupBy("source").agg(F.min_by("v", drawn).alias("v"))
        walks = walks.join(chosen, "source", "left").select("source", F.when(F.col("v").isNotNull(), F.array_append("path", F.col("v"))).otherwise(F.col("path")).alias("path"))
        walks = checkpoint(walks)
    return walks


# --- reinforcement and upkeep ---------------------------------------------------------------------------------------


def strengthen_amount(similarity: Column, seconds_apart: Column, mean_accesses: Column, base: float = 0.1, together: bool = True) -> Column:
    """How much one co-retrieval strengthens an association: more for alike, contemporary and often used ends, at most 1."""
    amount = F.lit(base * (1.15 if together else 1.0)) * F.when(similarity > 0.6, 1 + (similarity - 0.6)).otherwise(1.0)
    near = F.when(F.abs(seconds_apart) < 3600, 1.2).when(F.abs(seconds_apart) < 86400, 1.1).otherwise(1.0)
    return F.least(F.lit(1.0), amount * near * F.when(mean_accesses > 10, 1.1).otherwise(1.0))


def reinforced(pairs: DataFrame, amount: str = "amount", known: DataFrame | None = None, start: float = 0.01) -> DataFrame:
    """(a, b, strength, fired): associations after their firings, one row of ``pairs`` (a, b, amount) each.

    A firing takes the strength up by ``amount`` of what is missing to 1, so a pair's firings multiply what is missing and
    their order doesn't matter: the product is pre-aggregated and a pair that fires a million times costs one row a task.
    ``known`` (a, b, strength) are the strengths before; others begin at ``start``. Pairs are unordered; a node isn't
    associated with itself.
    """
    usable = pairs.where("a is not null and b is not null and a <> b")
    # an amount of 1 leaves nothing missing; its logarithm would be infinite
    missing = F.when(F.max((F.col(amount) >= 1).cast("int")) == 1, 0.0).otherwise(F.exp(F.sum(F.when(F.col(amount) < 1, F.log1p(-F.col(amount))).otherwise(0.0))))
    fired = usable.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(missing.alias("missing"), F.count(F.lit(1)).alias("fired"))
    if known is not None:
        fired = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "strength").join(fired, ["a", "b"], "full")
    before = F.lit(start) if known is None else F.coalesce("strength", F.lit(start))
    return fired.select("a", "b", (1 - (1 - before) * F.coalesce("missing", F.lit(1.0))).alias("strength"), F.coalesce("fired", F.lit(0)).alias("fired"))


def compacted(edges: DataFrame, strength: Column, least: float = 0.05) -> DataFrame:
    """Edges whose present ``strength`` is at least ``least``; the others are removed."""
    return edges.withColumn("strength", strength).where(F.col("strength") >= least)


def without_nodes(edges: DataFrame, nodes: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Edges neither end of which is among ``nodes`` (column ``node``)."""
    gone = nodes.select("node").where("node is not null").distinct()
    kept = edges.join(gone.withColumnRenamed("node", a), a, "left_anti")
    return kept.join(gone.withColumnRenamed("node", b), b, "left_anti").select(*edges.columns)


def health(age_days: Column, idle_hours: Column, accesses: Column) -> Column:
    """Health of a node in 0..1 by recency of use (half-life two days), frequency and age; age counts from three uses on."""
    recency = F.exp(-0.693 * F.greatest(idle_hours, F.lit(0.001)) / 48)
    frequency = F.least(F.lit(1.0), F.log1p(accesses.cast("double")) / 5)
    stability = F.when(accesses > 2, F.least(F.lit(1.0), F.log1p(F.greatest(age_days, F.lit(0.001))) / 4)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * recency + 0.35 * frequency + 0.25 * stability))


def over_capacity(nodes: DataFrame, key: str, score: str, most: int) -> DataFrame:
    """(key): the nodes to remove so that ``most`` are left, lowest score first, then by key.

    One count and one top-n; no node is ranked in a single task.
    """
    extra = max(0, nodes.count() - most)
    return nodes.select(key, score).orderBy(score, key).limit(extra).select(key)


# --- joins that propose links ---------------------------------------------------------------------------------------


def similar_word_sets(sets: DataFrame, key: str, words: str, threshold: float) -> DataFrame:
    """(a, b, jaccard), a < b: pairs of rows whose sets of words are similar enough, exactly.

    Two such sets share one of their rarest words: of n words, one of the first n - ceil(threshold n) + 1 in any order of all
    words. Sets are posted under those as 46 bytes (size, hash of the key, parities of the words), and the postings of a word
    are compared where they are: parities differ in no more places than the sets differ in words. Only pairs that pass leave
    the task, and their words are compared in full. Empty and null sets match nothing.
    """
    rows = sets.select(F.col(key).alias("k"), F.array_distinct(words).alias("w")).where("k is not null")
    if not rows.groupBy("k").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["k"])
    rows = rows.where("size(w) > 0").withColumn("h", F.xxhash64("k"))
    often = rows.select(F.explode("w").alias("x")).groupBy("x").count().where("x is not null and count > 1").orderBy(F.desc("count"), "x").limit(_RANKED).collect()
    rank = {r["x"]: -i for i, r in enumerate(often, 1)}
    buckets = bucket_count(rows, 2.0)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _word_postings(batches, rank, threshold, buckets)

    def compare(table: pa.Table) -> pa.Table:
        return _alike_in_bucket(table, threshold)

    posted = rows.select("h", "w").mapInArrow(post, "bucket int, blob binary")
    pairs = by_bucket(posted, buckets).applyInArrow(compare, "ha long, hb long").distinct().persist(StorageLevel.DISK_ONLY)
    ends = pairs.select(F.explode(F.array("ha", "hb")).alias("h")).distinct()
    count = ends.count()
    held = rows.join(F.broadcast(ends) if count <= _BROADCAST_HASHES else ends, "h", "left_semi").select("k", "w", "h")
    # a hash of two keys brings in both, so nothing depends on hashes being unique
    both = pairs.join(held.toDF("ka", "wa", "ha"), "ha").join(held.toDF("kb", "wb", "hb"), "hb").where(F.when(F.col("ha") == F.col("hb"), F.col("ka") < F.col("kb")).otherwise(F.col("ka") != F.col("kb")))
    common = F.size(F.array_intersect("wa", "wb"))
    return both.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), (common / (F.size("wa") + F.size("wb") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)


#: Words ordered by how many sets hold them; the others are rarer and ordered by hash. Hashes of keys that are broadcast (8 bytes each).
_RANKED, _BROADCAST_HASHES = 30_000, 1_000_000
#: Parities of a set's words, and pairs of postings compared at a time.
_PARITY_WORDS, _CELLS = 4, 1 << 17
_POSTING = np.dtype([("x", "<i8"), ("h", "<i8"), ("n", "<i4"), ("p", "<u8", (_PARITY_WORDS,))])


def _word_postings(batches: Iterator[pa.RecordBatch], rank: dict[str, int], threshold: float, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, blob): the postings of the rows (h, w), those of one word in one bucket."""
    for batch in batches:
        if not len(batch):
            continue
        lists = batch.column(1)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        known = [*coded.dictionary.to_pylist(), None]  # a null counts as a word of its own
        where = coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)
        digest = np.frombuffer(b"".join(bytes(16) if w is None else hashlib.blake2b(w.encode(), digest_size=16).digest() for w in known), np.int64).reshape(-1, 2)
        # the order of words: rare ones by hash, then the ranked ones, the most frequent last
        order = np.array([len(rank) + 1 + rank.get(w, -len(rank) - 1) for w in known], np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = digest[where, 1].view(np.uint64) % np.uint64(64 * _PARITY_WORDS)
        parity = np.zeros((len(sizes), _PARITY_WORDS), np.uint64)
        np.bitwise_xor.at(parity, (row, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
        by = np.lexsort((digest[where, 0], order[where], row))
        nth = np.arange(len(by)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = by[nth < np.repeat(sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1, sizes)]
        out = np.empty(len(first), _POSTING)
        out["x"], out["h"], out["n"], out["p"] = digest[where[first], 0], batch.column(0).to_numpy()[row[first]], sizes[row[first]], parity[row[first]]
        to = (digest[where[first], 0].view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(to, kind="stable")
        ends = np.flatnonzero(np.diff(to[by], append=-1)) + 1
        blobs = [out[x].tobytes() for x in np.split(by, ends[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(to[by][ends - 1], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _alike_in_bucket(table: pa.Table, threshold: float) -> pa.Table:
    """(ha, hb): pairs of postings of a word whose sizes and parities allow the similarity."""
    rows = np.concatenate([np.frombuffer(b, _POSTING) for b in table.column("blob").to_pylist()])
    rows = rows[np.lexsort((rows["n"], rows["x"]))]
    h, n, p = (np.ascontiguousarray(rows[c]) for c in ("h", "n", "p"))
    p = np.ascontiguousarray(p.T)
    ends = np.flatnonzero(np.diff(rows["x"])) + 1
    found = [np.zeros((0, 2), np.int64)]
    for start, end in zip(np.r_[0, ends], np.r_[ends, len(rows)]):
        i = start
        while i < end - 1:
            step = int(max(1, min(end - i, _CELLS // (end - i))))
            last = i + int(np.searchsorted(n[i:end], n[min(i + step, end) - 1] / threshold + 1e-9, "right"))  # sorted by size
            a, b = slice(i, min(i + step, end)), slice(i, last)
            apart = np.bitwise_count(p[0, a, None] ^ p[0, None, b]).astype(np.int16)
            for w in range(1, _PARITY_WORDS):
                apart += np.bitwise_count(p[w, a, None] ^ p[w, None, b])
            most = ((n[a, None] + n[None, b]) * ((1 - threshold) / (1 + threshold)) + 1e-9).astype(np.int32)
            r, c = np.nonzero(apart <= most)
            r, c = r[c > r] + i, c[c > r] + i
            fits = n[r] >= n[c] * threshold - 1e-9
            r, c = r[fits], c[fits]
            found.append(np.stack([np.minimum(h[r], h[c]), np.maximum(h[r], h[c])], 1))
            i += step
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(1)]] if len(pairs) else pairs
    return pa.table({"ha": pairs[:, 0], "hb": pairs[:, 1]})


def redundant_nodes(nodes: DataFrame, key: str, words: str, at: str, threshold: float = 0.92) -> DataFrame:
    """(keep_id, remove_id, jaccard): of two redundant nodes the younger is to be merged into the older, then by key."""
    pairs = similar_word_sets(nodes, key, words, threshold)
    age = nodes.select(F.col(key).alias("k"), F.col(at).alias("at")).dropDuplicates(["k"])
    both = pairs.join(age.toDF("a", "at_a"), "a").join(age.toDF("b", "at_b"), "b")
    first = F.coalesce(F.col("at_a") <= F.col("at_b"), F.lit(True))
    return both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep_id"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("remove_id"), "jaccard")


def cross_domain_pairs(rows: DataFrame, key: str, scope: str, domain: str, at: str, seconds: int) -> DataFrame:
    """(scope, a, b): rows of one scope and different domains, ``b`` at most ``seconds`` before ``a`` or at the same time.

    A range join by time cells: a row meets only its own cell of ``seconds`` and the one before, spread over scopes.
    """
    timed = rows.where(F.col(at).isNotNull()).select(scope, F.col(key).alias("k"), F.col(domain).alias("d"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"))
    timed = timed.withColumn("cell", F.floor(F.col("t") / (seconds * 1_000_000)))
    later = timed.select(scope, F.col("k").alias("a"), F.col("d").alias("da"), F.col("t").alias("ta"), F.explode(F.array("cell", F.col("cell") - 1)).alias("cell"))
    earlier = timed.toDF(scope, "b", "db", "tb", "cell")
    before = (F.col("tb") < F.col("ta")) | ((F.col("tb") == F.col("ta")) & (F.col("b") < F.col("a")))
    within = F.col("ta") - F.col("tb") <= seconds * 1_000_000
    return later.join(earlier, [scope, "cell"]).where((F.col("da") != F.col("db")) & before & within).select(scope, "a", "b")


# --- exports --------------------------------------------------------------------------------------------------------


def xml_text(text: Column) -> Column:
    """Text escaped for XML; characters XML doesn't know are dropped."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), "[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        clean = F.replace(clean, F.lit(plain), F.lit(safe))
    return clean


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): a GraphML document's node and edge elements, one a row; ``nodes`` (node, label), ``edges`` (u, v, weight).

    :func:`write_document` adds head and tail, so the graph is written by all tasks.
    """
    n = nodes.select(F.lit("node").alias("part"), F.concat(F.lit('<node id="'), xml_text(F.col("node")), F.lit('"><data key="label">'), xml_text(F.col("label")), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit("edge").alias("part"), F.concat(F.lit('<edge source="'), xml_text(F.col("u")), F.lit('" target="'), xml_text(F.col("v")), F.lit('"><data key="weight">'), F.format_string("%.6f", F.col("weight").cast("double")), F.lit("</data></edge>")).alias("line"))
    return n.unionByName(e)


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): the same for GEXF."""
    n = nodes.select(F.lit("node").alias("part"), F.concat(F.lit('<node id="'), xml_text(F.col("node")), F.lit('" label="'), xml_text(F.col("label")), F.lit('"/>')).alias("line"))
    e = edges.select(F.lit("edge").alias("part"), F.concat(F.lit('<edge id="'), xml_text(F.col("u")), F.lit("--"), xml_text(F.col("v")), F.lit('" source="'), xml_text(F.col("u")), F.lit('" target="'), xml_text(F.col("v")), F.lit('" weight="'), F.format_string("%.6f", F.col("weight").cast("double")), F.lit('"/>')).alias("line"))
    return n.unionByName(e)


_FRAMES = {
    "graphml": ('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">', "", "</graph></graphml>"),
    "gexf": ('<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>', "</nodes><edges>", "</edges></graph></gexf>"),
}


def write_document(lines: DataFrame, path: str, kind: str) -> None:
    """Writes the lines as text parts that, in order of their names, make one document."""
    head, middle, tail = _FRAMES[kind]
    spark = lines.sparkSession
    texts = ((0, [head]), (1, lines.where("part = 'node'").select("line")), (2, [middle] if middle else []), (3, lines.where("part = 'edge'").select("line")), (4, [tail]))
    for no, part in texts:
        rows = spark.createDataFrame([(x,) for x in part], "line string").coalesce(1) if isinstance(part, list) else part
        rows.write.mode("overwrite").text(f"{path.rstrip('/')}/{no}")
