"""Near-duplicate records with small edits (covering locality-sensitive hashing).

A record is the set of its runs of three words. Its sketch is a row of min-hash symbols, on which two records differ in
about a share of 1 - J of the places. The places are dealt to blocks; in each block structured bit masks choose the places
a table looks at: every place carries a nonzero vector of GF(2)^(r+1) and table v takes the places whose vector has an odd
product with v. Whatever r places of a block two records differ in, some v is orthogonal to them all, so its table sees
none of them and the pair collides: within the radius no pair is lost. A pair above the threshold is missed only if its
sketches differ in more than r places of every block. Candidates are verified on the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.exchange import bucket_of, mix64, pack, runs, unpack
from palimpsest.session import bucket_count, by_bucket

SHINGLE, MIN_WORDS, THRESHOLD = 3, 5, 0.5
RADIUS, PLACES, BLOCKS = 2, 6, 6
#: Records under one key up to which they are compared side by side, and in blocks; larger groups go to an exact join.
FEW, HOT = 64, 2048
#: Input bytes, as stored, whose keys make a bucket: some 4 million keys, or 300 MB of a task's memory.
BUCKET_BYTES = 32 << 20
#: Keys packed together before they are sent.
FLUSH = 1_000_000
#: Classes whose ids may be broadcast, 8 bytes each; beyond it they are joined by a shuffle.
MAX_BROADCAST = 1_000_000
WORDS = regex.compile(r"[\p{L}\p{N}]+")


def covering_masks(radius: int, places: int) -> np.ndarray:
    """Boolean (tables, places): for any ``radius`` places some table takes none of them.

    ``places`` may be up to 2^(radius + 1) - 1, the number of nonzero vectors.
    """
    size = 1 << (radius + 1)
    if not 0 < places < size:
        raise ValueError("too many places for the radius")
    vectors = np.arange(1, places + 1)
    masks = np.array([[bin(v & p).count("1") & 1 for p in vectors] for v in range(1, size)], bool)
    return masks[masks.any(1)]


class Sketch:
    """Min-hash symbols of shingle sets and the keys of all tables."""

    def __init__(self, radius: int = RADIUS, places: int = PLACES, blocks: int = BLOCKS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.masks, self.places, self.blocks = covering_masks(radius, places), places, blocks
        self.width = places * blocks
        self.flip = rng.integers(0, 1 << 63, self.width, dtype=np.uint64)
        self.times = rng.integers(0, 1 << 63, self.width, dtype=np.uint64) | np.uint64(1)
        self.weights = rng.integers(0, 1 << 63, (blocks, len(self.masks), places), dtype=np.uint64) | np.uint64(1)
        self.tables = blocks * len(self.masks)

    def symbols(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), self.width), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.width):
                out[:, i] = np.minimum.reduceat((shingles ^ self.flip[i]) * self.times[i], starts)
        return mix64(out)

    def keys(self, symbols: np.ndarray) -> np.ndarray:
        out = np.empty((len(symbols), self.tables), np.uint64)
        with np.errstate(over="ignore"):
            for b in range(self.blocks):
                part = symbols[:, b * self.places : (b + 1) * self.places]
                for t, mask in enumerate(self.masks):
                    table = b * len(self.masks) + t
                    out[:, table] = mix64((part[:, mask] * self.weights[b, t, mask]).sum(1, dtype=np.uint64) + np.uint64(table))
        return out

    def brief(self, symbols: np.ndarray) -> np.ndarray:
        """Four bits a symbol, two symbols a byte."""
        low = (symbols & np.uint64(15)).astype(np.uint8)
        return low[:, 0::2] | low[:, 1::2] << 4

    def least_agreement(self, threshold: float) -> int:
        """Symbols that brief sketches of a pair at the threshold agree in, less three standard deviations."""
        p = threshold + (1 - threshold) / 16
        return max(1, int(self.width * p - 3 * (self.width * p * (1 - p)) ** 0.5))


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return ((x & 15) == 0).sum(1) + ((x >> 4) == 0).sum(1)


class Words:
    """Words of a text as 64-bit numbers; the numbers of words seen before are kept, up to a bound."""

    KEPT = 1_000_000

    def __init__(self):
        self.known: dict[str, int] = {}

    def numbers(self, words: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > self.KEPT:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return [known[w] for w in words]


def shingle_batch(texts: list[str | None], words: Words, size: int = SHINGLE, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, class, shingles, starts) of the texts that have enough words; shingles may repeat within a text.

    The class is a hash of the whole sequence of words: texts that differ in case, space and punctuation only share it.
    """
    least = max(least, size)
    rows, flat, lengths, classes = [], [], [], []
    for i, text in enumerate(texts):
        if text is None:
            continue
        found = WORDS.findall(text.lower())
        if len(found) >= least:
            rows.append(i)
            lengths.append(len(found))
            flat += words.numbers(found)
            classes.append(xxhash.xxh3_64_intdigest(" ".join(found)))
    w = np.array(flat, np.uint64)
    lengths = np.array(lengths, np.int64)
    with np.errstate(over="ignore"):
        s = np.zeros(max(len(w) - size + 1, 0), np.uint64)
        for k in range(size):
            s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k]) if len(s) else s
    ends = np.cumsum(lengths)
    inside = np.ones(len(w), bool)
    for k in range(1, size):
        inside[ends - k] = False  # runs that would reach into the next text
    starts = np.cumsum(lengths - size + 1) - (lengths - size + 1)
    return np.array(rows, np.int64), np.array(classes, np.uint64).view(np.int64), s[inside[: len(s)]], starts


def _key_batches(batches: Iterator[pa.RecordBatch], sketch: Sketch, buckets: int) -> Iterator[pa.RecordBatch]:
    words = Words()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        classes, symbols = (np.concatenate(x) for x in zip(*held))
        classes, first = np.unique(classes, return_index=True)  # copies are one record from here on
        symbols = symbols[first]
        h = sketch.keys(symbols).ravel()
        owner = np.repeat(np.arange(len(classes)), sketch.tables)
        bucket = bucket_of(h, buckets)
        order = np.argsort(bucket, kind="stable")
        h, owner, bucket, brief = h[order], owner[order], bucket[order], sketch.brief(symbols)
        start, length = runs(bucket)
        nothing = np.zeros(int(length.max()), np.uint32)
        blobs = [pack(h[a : a + n], classes[owner[a : a + n]], nothing[:n], brief[owner[a : a + n]]) for a, n in zip(start, length)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[start], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a in range(0, len(texts), 2048):
            rows, classes, shingles, starts = shingle_batch(texts[a : a + 2048], words)
            if len(rows):
                held.append((classes, sketch.symbols(shingles, starts)))
                count += len(rows) * sketch.tables
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
    if held:
        yield flush()


def _group_pairs(h: np.ndarray, item: np.ndarray, brief: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(pairs, hot items) of equal ``h``: pairs, as rows of two items, whose brief sketches agree enough, and the members of
    groups of more than ``HOT``, which aren't compared here. ``h`` is sorted, items are distinct in it.
    """
    start, length = runs(h)
    found = [np.zeros((0, 2), np.int64)]
    small = length <= FEW
    end = np.repeat(np.where(small, start + length, 0), length)
    at = np.arange(len(h))
    i = 1
    while True:
        at = at[at + i < end[at]]
        if not len(at):
            break
        for b in range(0, len(at), 1 << 18):
            x, y = item[at[b : b + (1 << 18)]], item[at[b : b + (1 << 18)] + i]
            ok = agreement(brief[x], brief[y]) >= least
            found.append(np.stack([x[ok], y[ok]], 1))
        i += 1
    for s, n in zip(start[~small], length[~small]):
        if n <= HOT:
            found += _block_pairs(item[s : s + n], brief, least)
    return found, np.unique(item[np.repeat(length > HOT, length)])


def _block_pairs(items: np.ndarray, brief: np.ndarray, least: int) -> list[np.ndarray]:
    found = []
    for a in range(0, len(items), 128):
        rest = items[a:]
        x = brief[rest[:128], None, :] ^ brief[None, rest, :]
        agree = ((x & 15) == 0).sum(2, dtype=np.uint8) + ((x >> 4) == 0).sum(2, dtype=np.uint8)
        r, c = np.nonzero(agree >= least)
        later = c > r
        found.append(np.stack([rest[r[later]], rest[c[later]]], 1))
    return found


def _candidates_of_bucket(table: pa.Table, sketch: Sketch, least: int) -> pa.Table:
    parts = [unpack(b, sketch.width // 2) for b in table.column("blob").to_pylist()]
    sizes = [len(p[3][0]) for p in parts]
    classes = np.concatenate([p[3][0] for p in parts])
    brief = np.concatenate([p[3][1] for p in parts])
    base = np.cumsum([0, *sizes[:-1]])
    h = np.concatenate([p[0] for p in parts])
    owner = np.concatenate([p[1] + b for p, b in zip(parts, base)])
    kept, first, number = np.unique(classes, return_index=True, return_inverse=True)
    brief, item = brief[first], number[owner]
    order = np.lexsort((item, h))
    h, item = h[order], item[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (item[1:] == item[:-1])
    h, item = h[~same], item[~same]
    found, crowd = _group_pairs(h, item, brief, least)
    pairs = np.unique(np.sort(kept[np.concatenate(found)], 1), axis=0)
    a, b = (np.concatenate([pairs[:, i], kept[crowd]]).astype(np.int64) for i in (0, 1))
    return pa.table({"a": pa.array(a), "b": pa.array(b), "hot": pa.array(np.arange(len(a)) >= len(pairs))})


def candidates(texts: DataFrame, threshold: float = THRESHOLD, buckets: int | None = None) -> DataFrame:
    """(a, b, hot): pairs of classes that collide in some table and whose brief sketches don't rule the threshold out.

    A class that meets more than ``HOT`` others under one key comes as (class, class, true) instead of with its pairs. A
    key held by m classes takes 32 bytes of each in one task.
    """
    sketch = Sketch()
    buckets, least = buckets or bucket_count(texts, 1.0, BUCKET_BYTES), sketch.least_agreement(threshold)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _key_batches(batches, sketch, buckets)

    def collide(table: pa.Table) -> pa.Table:
        return _candidates_of_bucket(table, sketch, least)

    packed = texts.select("text").where(F.col("text").isNotNull()).mapInArrow(keys, "bucket int, blob binary")
    return by_bucket(packed, buckets).applyInArrow(collide, "a bigint, b bigint, hot boolean").distinct()


def similar_sets(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs whose sets (``class, shingles``) are similar enough."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    jaccard = common / (F.size("sa") + F.size("sb") - common)
    return both.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)


def exact_links(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard): all similar pairs of ``sets``, without sketches: two similar sets share one of their rarest members.

    Members are ordered by how many sets hold them. Of n members, any set that is similar enough shares one of the first
    n - ceil(threshold n) + 1, so what many records have in common, such as an opening, brings nobody together unless it
    makes up that much of a record.
    """
    held = sets.select("class", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    spread = held.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    length = (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int")
    # a member no other set holds comes first and brings nobody together, so it only shortens the rest
    rare = F.sort_array(F.collect_list(F.struct("f", "s")))
    listed = held.join(spread, "s").groupBy("class", "n").agg(rare.alias("rare"))
    rest = length - (F.col("n") - F.size("rare"))
    first = listed.where(rest > 0).select("class", "n", F.explode(F.slice("rare", F.lit(1), rest)).alias("m")).select("class", "n", F.col("m.s").alias("s"))
    x, y = first.toDF("a", "na", "s"), first.toDF("b", "nb", "s")
    near = (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)
    pairs = x.join(y, "s").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    return similar_sets(pairs, sets, threshold)


def _label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a in range(0, len(texts), 2048):
            rows, classes, shingles, starts = shingle_batch(texts[a : a + 2048], words)
            owner = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(shingles))))
            order = np.lexsort((shingles, owner))
            owner, shingles = owner[order], shingles[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(rows)))]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array((shingles[new] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows + a)), pa.array(classes), sets], ["id", "class", "shingles"])


class NearDuplicates:
    """Classes of a table of texts and the verified links between them.

    ``members`` (id, class): one row per text of at least ``MIN_WORDS`` words. ``links`` (a, b, jaccard): pairs of
    different classes, a < b, whose shingle sets have a Jaccard similarity of ``threshold`` or more. Null, empty and short
    texts and null ids belong to nothing; repeated rows fall into one class; an empty table has no members. Classes that
    meet too many others under one key are linked by :func:`exact_links`.

    Sets are compared by 32 bits a shingle: two different shingles of a pair are taken for one in about one of 500,000
    pairs, where the similarity is then off by a hundredth or so.
    """

    def __init__(self, texts: DataFrame, key: str, text: str, threshold: float = THRESHOLD):
        slim = texts.select(F.col(key).alias("id"), F.col(text).alias("text"))
        kind = slim.schema["id"].dataType.simpleString()
        pairs = candidates(slim, threshold, bucket_count(texts, 1.0, BUCKET_BYTES)).persist(StorageLevel.MEMORY_AND_DISK)
        crowd = pairs.where("hot").select(F.col("a").alias("class"))
        linked = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
        needed = F.broadcast(linked) if linked.count() <= MAX_BROADCAST else linked
        labels = slim.where(F.col("id").isNotNull() & F.col("text").isNotNull()).mapInArrow(_label_batches, f"id {kind}, class bigint, shingles array<int>")
        marked = labels.join(needed.withColumn("needed", F.lit(True)), "class", "left")
        kept = marked.select("id", "class", F.when(F.col("needed"), F.col("shingles")).alias("shingles")).persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()  # once, before several branches ask for it on several executors
        self.members = kept.select("id", "class").distinct()
        sets = kept.where(F.col("shingles").isNotNull()).dropDuplicates(["class"]).select("class", "shingles")
        self.links = similar_sets(pairs.where("not hot").select("a", "b"), sets, threshold)
        if not crowd.isEmpty():
            self.links = self.links.union(exact_links(sets.join(crowd, "class", "left_semi"), threshold)).distinct()


def similar_pairs(texts: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records at the threshold, copies included.

    Copies are expanded here only; the search itself sees one record of each.
    """
    found = NearDuplicates(texts, key, text, threshold)
    m = found.members
    links = found.links.select("a", "b")
    across = links.join(m.toDF("x", "a"), "a").join(m.toDF("y", "b"), "b").select("x", "y")
    several = m.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class")
    crowd = m.join(several, "class", "left_semi")
    within = crowd.toDF("class", "x").join(crowd.toDF("class", "y"), "class").where("x < y").select("x", "y")
    pairs = across.unionByName(within)
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(texts: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id, class, n_links, group_id): one row per record with its class, the number of classes linked to it, and its group.

    Groups are the connected components of the links; ``group_id`` is the smallest class of the component.
    """
    from palimpsest.operators.graph import connected_components

    found = NearDuplicates(texts, key, text, threshold)
    links = found.links.select("a", "b")
    ends = links.select(F.col("a").alias("class")).unionAll(links.select("b"))
    degree = ends.groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    component = connected_components(links, "a", "b").toDF("class", "group_id")
    out = found.members.join(degree, "class", "left").join(component, "class", "left")
    return out.select("id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class").alias("group_id"))
