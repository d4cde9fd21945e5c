"""Long exact spans shared between records (difference-cover anchors).

Positions of every text whose number modulo a period lies in a difference cover are anchors; the hash of the window at an
anchor is exchanged, and nothing else of the text. Whatever the two places of a match, at most ``period - 1`` characters
into it both texts have an anchor, so a match of ``min_chars = window + period - 1`` characters always shares an aligned
one. Windows that occur in two documents are then extended character by character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.exchange import bucket_of, mix64, pack, runs, unpack
from palimpsest.session import bucket_count, by_bucket

MIN_CHARS = 200
#: Characters hashed at a time; longer texts are cut into overlapping parts of this length.
BLOCK = 1 << 20
#: Anchors packed together before they are sent.
FLUSH = 400_000
#: Input bytes, as stored, whose anchors make half a bucket: some 1.5 million anchors, or 100 MB of a task's memory.
BUCKET_BYTES = 16 << 20
#: Occurrences of one window up to which they are compared with each other; beyond it, windows of the full length are counted.
FEW = 8
#: Occurrences of one window beyond which its counting is spread over the cluster.
MANY = 50_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def difference_cover(q: int) -> list[int]:
    """q + 1 numbers below q*q + q + 1 whose differences are all residues, each nonzero one once (Singer), for a prime q.

    They are the powers of a field element that lie in a plane through the origin of GF(q^3) over GF(q).
    """
    period = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, cover = (1, 0, 0), []
                for i in range(period):
                    if x[2] == 0:
                        cover.append(i)
                    x = ((c * x[2]) % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                if len(cover) == q + 1 and len({(s - t) % period for s in cover for t in cover}) == period:
                    return cover
    raise ValueError(f"no difference cover for {q}")


class Cover:
    """Anchor positions for spans of at least ``min_chars``: a period of about two thirds of it, the window is the rest."""

    def __init__(self, min_chars: int):
        if min_chars < 12:
            raise ValueError("min_chars must be at least 12")
        q = max(p for p in range(2, int(min_chars**0.5) + 1) if _is_prime(p) and 3 * (p * p + p + 1) <= 2 * min_chars)
        self.min_chars, self.period, self.residues = min_chars, q * q + q + 1, np.array(difference_cover(q))
        self.window = min_chars - self.period + 1
        self.step = BLOCK // self.period * self.period
        laps = np.arange(self.step // self.period + 2) * self.period
        self.grid = (laps[:, None] + self.residues).ravel()
        with np.errstate(over="ignore"):
            size = self.step + min_chars + 1
            self.powers = np.cumprod(np.full(size, _BASE, np.uint64))
            self.inverses = np.cumprod(np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))

    def anchors(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of the anchors of one part of a text, of at most ``step + window - 1`` characters."""
        if len(codes) < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = self.grid[: np.searchsorted(self.grid, len(codes) - self.window, "right")]
        return at, window_hashes(codes, at, self.window, self.powers, self.inverses)


def window_hashes(codes: np.ndarray, at: np.ndarray, width: int, powers: np.ndarray, inverses: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(0x51ED)) * powers[: len(codes)], out=sums[1:])
        return mix64((sums[at + width] - sums[at]) * inverses[at])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _anchor_batches(batches: Iterator[pa.RecordBatch], min_chars: int, buckets: int) -> Iterator[pa.RecordBatch]:
    cover = Cover(min_chars)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        h = np.concatenate([x[2] for x in held])
        place = np.concatenate([x[1] for x in held])
        owner = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) for x in held])
        bucket = bucket_of(h, buckets)
        order = np.argsort(bucket, kind="stable")
        h, place, owner, bucket = h[order], place[order], owner[order], bucket[order]
        start, length = runs(bucket)
        blobs = [pack(h[a : a + n], owner[a : a + n], place[a : a + n]) for a, n in zip(start, length)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[start], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            codes = code_points(text.as_py())
            for base in range(0, len(codes), cover.step):
                at, h = cover.anchors(codes[base : base + cover.step + cover.window - 1])
                if len(at):
                    keep = at < cover.step
                    held.append((doc, (at[keep] + base), h[keep]))
                    count += len(at)
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
    if held:
        yield flush()


def _shared_anchors(table: pa.Table) -> pa.Table:
    hs, docs, places = [], [], []
    for blob in table.column("blob").to_pylist():
        h, index, place, owners = unpack(blob)
        hs.append(h)
        docs.append(owners[index])
        places.append(place.astype(np.uint32))
    h, doc, place = map(np.concatenate, (hs, docs, places))
    order = np.argsort(h)
    h, doc, place = h[order], doc[order], place[order]
    start, length = runs(h)
    several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start) if len(start) else np.zeros(0, bool)
    keep = np.repeat(several, length)
    bucket = table.column("bucket")[0].as_py()
    group = (h[keep].astype(np.int64)) | np.int64((bucket & 0x7FFF) << 48)
    size = np.repeat(length, length)[keep]
    return pa.table({"anchor": pa.array(group), "doc_id": pa.array(doc[keep]), "place": pa.array(place[keep].astype(np.int64)), "size": pa.array(size.astype(np.int64))})


def shared_anchors(documents: DataFrame, min_chars: int = MIN_CHARS, buckets: int | None = None) -> DataFrame:
    """(anchor, doc_id, place, size): every anchor window that occurs in two documents at least."""
    usable = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select("doc_id", "text")
    buckets = buckets or bucket_count(documents, 2.0, BUCKET_BYTES)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _anchor_batches(batches, min_chars, buckets)

    packed = usable.mapInArrow(anchors, "bucket int, blob binary")
    return by_bucket(packed, buckets).applyInArrow(_shared_anchors, "anchor bigint, doc_id bigint, place bigint, size bigint")


def _context_batches(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """The text around each anchor: every window of ``min_chars`` that holds the anchor's window lies in it."""
    cover = Cover(min_chars)
    reach = cover.period - 1
    for batch in batches:
        anchor, doc, place, left, text, size = [], [], [], [], [], []
        for d, t, hits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            t = t.as_py()
            for hit in hits:
                a = hit["place"]
                begin = max(0, a - reach)
                anchor.append(hit["anchor"])
                doc.append(d)
                place.append(a)
                size.append(hit["size"])
                left.append(a - begin)
                text.append(t[begin : a + cover.window + reach])
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor, pa.int64()), pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(left, pa.int64()), pa.array(text, pa.string()), pa.array(size, pa.int64())],
            ["anchor", "doc_id", "place", "left", "context", "size"],
        )


def _matrix(contexts: list[str], left: np.ndarray, cover: Cover) -> np.ndarray:
    """Contexts as rows of code points with the anchor in one column; beyond a text, numbers that equal no other row's."""
    reach, width = cover.period - 1, cover.window + 2 * (cover.period - 1)
    n = len(contexts)
    m = np.repeat((np.arange(n, dtype=np.uint32) + np.uint32(0x110000))[:, None], width, 1)
    lengths = np.array([len(c) for c in contexts])
    flat = code_points("".join(contexts))
    row = np.repeat(np.arange(n), lengths)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(reach - left, lengths)
    m[row, col] = flat
    return m


def _extend(x: np.ndarray, y: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, valid) of each pair of rows: how far they agree beyond the window, which must itself agree."""
    reach, window = cover.period - 1, cover.window
    same = x == y
    pad = np.zeros((len(x), 1), bool)
    left = np.argmin(np.concatenate([same[:, :reach][:, ::-1], pad], 1), 1)
    right = np.argmin(np.concatenate([same[:, reach + window :], pad], 1), 1)
    valid = same[:, reach : reach + window].all(1) & (left + window + right >= cover.min_chars)
    return left, right, valid


def _spans_of_bucket(table: pa.Table, cover: Cover) -> pa.Table:
    anchor = table.column("anchor").to_numpy()
    order = np.argsort(anchor, kind="stable")
    anchor = anchor[order]
    doc, place, left = (table.column(c).to_numpy()[order] for c in ("doc_id", "place", "left"))
    context = table.column("context").take(pa.array(order))
    n, reach, window = len(anchor), cover.period - 1, cover.window
    most_left, most_right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)  # beyond the window, where spans were found
    start, length = runs(anchor)

    for i in range(1, FEW):  # occurrences i apart within groups of few
        at = np.concatenate([np.arange(s, s + k - i) for s, k in zip(start, length) if i < k <= FEW] or [np.zeros(0, np.int64)])
        at = at[doc[at] != doc[at + i]]
        for b in range(0, len(at), 8192):
            x = at[b : b + 8192]
            y = x + i
            rows, where = np.unique(np.concatenate([x, y]), return_inverse=True)
            m = _matrix(context.take(pa.array(rows)).to_pylist(), left[rows], cover)
            a, z, valid = _extend(m[where[: len(x)]], m[where[len(x) :]], cover)
            for side in (x[valid], y[valid]):
                np.maximum.at(most_left, side, a[valid])
                np.maximum.at(most_right, side, z[valid])

    for s, k in zip(start, length):
        if k > FEW:
            first, last = _count_windows(context.slice(s, k).to_pylist(), left[s : s + k], doc[s : s + k], cover)
            found = last >= 0
            most_left[s : s + k][found] = reach - first[found]
            most_right[s : s + k][found] = last[found] - reach + cover.min_chars - window
    found = most_left >= 0
    return pa.table({
        "doc_id": pa.array(doc[found]),
        "span_start": pa.array((place - most_left)[found]),
        "span_end": pa.array((place + window + most_right)[found]),
    })


def _row_hashes(contexts: list[str], left: np.ndarray, cover: Cover) -> np.ndarray:
    """Hash of every full-length window around an anchor, by row and offset; of windows that leave the text, a number a row."""
    m = _matrix(contexts, left, cover).astype(np.uint64)
    n, width, full = len(m), m.shape[1], cover.min_chars
    with np.errstate(over="ignore"):
        sums = np.zeros((n, width + 1), np.uint64)
        np.cumsum(mix64(m + np.uint64(0x51ED)) * cover.powers[:width], axis=1, out=sums[:, 1:])
        return mix64((sums[:, full:] - sums[:, : width + 1 - full]) * cover.inverses[: width + 1 - full])


def _count_windows(contexts: list[str], left: np.ndarray, doc: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray]:
    """First and last offset at which the window of each row also occurs in another document; -1 where none does.

    Every such window holds the anchor, so all between the first and the last belong to shared characters too.
    """
    n, offsets = len(contexts), cover.period
    hashes = np.empty((n, offsets), np.uint64)
    for b in range(0, n, 4096):
        hashes[b : b + 4096] = _row_hashes(contexts[b : b + 4096], left[b : b + 4096], cover)
        inside = np.arange(offsets) >= cover.period - 1 - left[b : b + 4096, None]
        ends = np.array([len(c) for c in contexts[b : b + 4096]])[:, None] + (cover.period - 1 - left[b : b + 4096, None])
        inside &= np.arange(offsets) + cover.min_chars <= ends
        hashes[b : b + 4096][~inside] = 0
    first, last = np.full(n, offsets, np.int64), np.full(n, -1, np.int64)
    for o in range(offsets):
        order = np.argsort(hashes[:, o], kind="stable")
        h = hashes[order, o]
        start, length = runs(h)
        shared = (np.minimum.reduceat(doc[order], start) != np.maximum.reduceat(doc[order], start)) & (h[start] != 0)
        rows = order[np.repeat(shared, length)]
        last[rows] = o
        first[rows] = np.minimum(first[rows], o)
    return first, last


def _window_rows(batches: Iterator[pa.RecordBatch], cover: Cover) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contexts, left = batch.column("context").to_pylist(), batch.column("left").to_numpy()
        for b in range(0, len(contexts), 1024):
            part, l = contexts[b : b + 1024], left[b : b + 1024]
            h = _row_hashes(part, l, cover)
            o = np.broadcast_to(np.arange(cover.period), h.shape)
            lengths = np.array([len(c) for c in part])[:, None] + (cover.period - 1 - l[:, None])
            inside = (o >= cover.period - 1 - l[:, None]) & (o + cover.min_chars <= lengths)
            row = np.nonzero(inside)[0]
            pick = lambda name: batch.column(name).slice(b, len(part)).take(pa.array(row))  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays(
                [pick("anchor"), pick("doc_id"), pick("place"), pa.array(o[inside].astype(np.int64)), pa.array(h[inside].view(np.int64))],
                ["anchor", "doc_id", "place", "offset", "hash"],
            )


def shared_spans(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, span_start, span_end): the maximal runs of characters that stand verbatim in another document.

    A character is shared if it lies in a stretch of at least ``min_chars`` consecutive code points that also occurs in
    the text of another ``doc_id``. Touching and overlapping stretches make one run. Null and short texts and rows without
    a ``doc_id`` share nothing; repeated rows of one ``doc_id`` aren't each other's sources; an empty table gives no rows.

    A window held by m documents takes 14 bytes of each in one task. Occurrences are never paired beyond ``FEW``: larger
    groups are settled by counting their full-length windows, those beyond ``MANY`` by a pre-aggregated count over the
    cluster.
    """
    buckets = bucket_count(documents, 2.0, BUCKET_BYTES)
    slim = documents.select("doc_id", "text")
    hits = shared_anchors(slim, min_chars, buckets).persist(StorageLevel.MEMORY_AND_DISK)
    # distinct, as repeated rows of a document have the same anchors
    hinted = hits.groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "place", "size")).alias("hits")).hint("shuffle_hash")
    schema = "anchor bigint, doc_id bigint, place bigint, left bigint, context string, size bigint"

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _context_batches(batches, min_chars)

    around = slim.where(F.length("text") >= min_chars).join(hinted, "doc_id").select("doc_id", "text", "hits").mapInArrow(contexts, schema)

    def settle(table: pa.Table) -> pa.Table:
        return _spans_of_bucket(table, Cover(min_chars))

    out = "doc_id bigint, span_start bigint, span_end bigint"
    usual = around.where(F.col("size") <= MANY).withColumn("bucket", F.pmod("anchor", F.lit(buckets)).cast("int"))
    spans = by_bucket(usual, buckets).applyInArrow(settle, out)
    if not hits.where(F.col("size") > MANY).isEmpty():
        spans = spans.unionByName(_spans_of_many(around.where(F.col("size") > MANY), min_chars))
    return merge_spans(spans)


def _spans_of_many(around: DataFrame, min_chars: int) -> DataFrame:
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _window_rows(batches, Cover(min_chars))

    rows = around.mapInArrow(windows, "anchor bigint, doc_id bigint, place bigint, offset bigint, hash bigint")
    keys = ["anchor", "offset", "hash"]
    shared = rows.groupBy(*keys).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select(*keys)
    start = F.col("place") + F.col("offset") - F.lit(Cover(min_chars).period - 1)
    return rows.join(shared, keys, "left_semi").select("doc_id", start.alias("span_start"), (start + min_chars).alias("span_end"))


def merge_spans(spans: DataFrame) -> DataFrame:
    """Touching and overlapping spans of a document as one."""
    order = Window.partitionBy("doc_id").orderBy("span_start", "span_end")
    reach = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("span_start") > F.col("reach"), F.lit(True)).cast("int")
    marked = spans.withColumn("reach", reach).withColumn("run", F.sum(begins).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "run").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("run")


def shared_share(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share) of every document; texts that are null or empty share 0."""
    spans = shared_spans(documents, min_chars).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sized = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    joined = sized.join(spans, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    share = F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0)
    return joined.select("doc_id", "n_chars", "shared_chars", share.alias("share"))
