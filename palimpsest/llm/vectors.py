"""Most similar vectors for every vector, over packed binary vectors (balanced posting lists).

A bounded sample is halved again and again into balanced groups; the groups' majority vectors are the centroids. They are
searched through an in-memory graph. A vector is put into its nearest lists as long as their distance stays within a
ratio of the nearest one's, so vectors at a boundary stand in several lists. Every list compares its members; a pair that
meets in several lists is taken from the lowest common one only.

The more lists there are, the likelier two close vectors fall into different ones. So beyond ``FLAT_LISTS`` the lists are
nested: few long ones are searched through the graph and exchanged, each a bucket, and divided again within their task,
where a vector stands in more lists, as that costs no exchange.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.exchange import runs
from palimpsest.session import bucket_count, by_bucket

BITS, BYTES, WORDS = 1024, 128, 16
K = 5
RADIUS = 256
#: Vectors a centroid stands for, and vectors of the sample a centroid.
LIST_SIZE, SAMPLE_PER_LIST = 500, 24
#: Bounds of what the driver holds: centroids (4 MB) and sampled vectors (50 MB).
MAX_CENTROIDS, MAX_SAMPLE = 32_768, 400_000
#: A vector stands in at most so many lists, none farther than this ratio of the nearest.
REPLICAS, RATIO = 5, 1.045
#: Beyond so many lists they are nested: outer lists of so many vectors, at least so many of them, from so large a sample a list.
FLAT_LISTS, OUTER_SIZE, OUTER_LEAST, OUTER_SAMPLE = 1_024, 100_000, 24, 800
#: No outer list of a vector is farther than this ratio of the nearest one; how many it may stand in follows their number.
OUTER_RATIO = 1.06
#: Neighbouring lists are dealt to buckets in blocks of 2 to this power.
BLOCK_BITS = 5
#: Lists beyond this are divided again before their members are compared.
MAX_LIST = 25_000
#: Outer lists beyond this are divided by so many centroids, or one for ``DIVIDED`` members if that is more; the lists of a member.
OUTER_LONGEST, INNER, INNER_REPLICAS = 5_000, 512, 8
#: Vectors a list of such a division stands for, and its ratio.
DIVIDED, DIVIDED_RATIO = 700, 1.08
#: Copies of one vector that stand in the index; a further copy's nearest are the first of them.
COPIES = K + 1


def signs(v: np.ndarray) -> np.ndarray:
    return np.unpackbits(v.view(np.uint8).reshape(len(v), -1), axis=1).astype(np.float32) * 2 - 1


def distances(a: np.ndarray, b_signs: np.ndarray) -> np.ndarray:
    """Hamming distances of packed vectors to a few, given as columns of signs."""
    out = np.empty((len(a), b_signs.shape[1]), np.float32)
    for i in range(0, len(a), 2048):
        out[i : i + 2048] = (BITS - signs(a[i : i + 2048]) @ b_signs) / 2
    return out


def halve(sample: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of balanced groups: the largest group is halved by two of its members until there are ``lists``.

    Centroids of neighbouring groups come out next to each other.
    """
    groups = {"": np.arange(len(sample))}
    heap = [(-len(sample), "")]
    while len(groups) < lists and -heap[0][0] > 1:
        _, path = heapq.heappop(heap)
        group = groups.pop(path)
        pair = rng.choice(group, 2, replace=False)
        d = distances(sample[group], signs(sample[pair]).T)
        order = np.argsort(d[:, 0] - d[:, 1], kind="stable")
        for side, half in (("0", order[: len(group) // 2]), ("1", order[len(group) // 2 :])):
            groups[path + side] = group[half]
            heapq.heappush(heap, (-len(half), path + side))
    ones = [np.unpackbits(sample[groups[p]].view(np.uint8), axis=1).mean(0) > 0.5 for p in sorted(groups)]
    return np.packbits(np.array(ones), axis=1).view(np.uint64)


class Graph:
    """Neighbour graph over the centroids, searched by a beam for a batch of vectors at once.

    A centroid is linked to its nearest ones and back from those it is near to, so every centroid can be reached. The beam
    starts from an entry layer compared by one matrix product: the centroids that aren't the nearest of another of that
    layer. Far from each other, centroids of binary vectors all look alike, so fewer entries find too little.
    """

    DEGREE, BACK, ROOM, BEAM, ROUNDS, WIDTH = 16, 4, 12, 32, 3, 8

    def __init__(self, centroids: np.ndarray, rng: np.random.Generator):
        self.centroids, n = centroids, len(centroids)
        degree = min(self.DEGREE, n - 1)
        near = np.empty((n, degree), np.int64)
        columns = signs(centroids).T
        for i in range(0, n, 1024) if degree else ():
            d = distances(centroids[i : i + 1024], columns)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = BITS + 1
            part = np.argpartition(d, degree - 1, 1)[:, :degree]
            near[i : i + 1024] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), 1), 1)
        self.links = np.concatenate([near, self._back(near)], 1)
        entry, covered = np.zeros(n, bool), np.zeros(n, bool)
        for i in rng.permutation(n):
            if not covered[i]:
                entry[i] = covered[i] = covered[near[i, :1]] = True
        self.entries = np.flatnonzero(entry)
        self.entry_signs = signs(centroids[self.entries]).T

    def _back(self, near: np.ndarray) -> np.ndarray:
        """Up to ``ROOM`` centroids that each centroid is one of the nearest of; itself where there are fewer."""
        n, back = near.shape[0], min(self.BACK, near.shape[1])
        to, rank, source = near[:, :back].ravel(), np.tile(np.arange(back), n), np.repeat(np.arange(n), back)
        order = np.lexsort((rank, to))
        to, source = to[order], source[order]
        seat = np.arange(len(to)) - np.searchsorted(to, to)
        out = np.repeat(np.arange(n)[:, None], self.ROOM, 1)
        out[to[seat < self.ROOM], seat[seat < self.ROOM]] = source[seat < self.ROOM]
        return out

    def search(self, q: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of about the nearest ``m`` centroids of each vector, nearest first."""
        ids, dist = [], []
        step = max(64, min(2048, (1 << 25) // len(self.centroids)))
        for i in range(0, len(q), step):
            a, b = self._search(q[i : i + step], m)
            ids.append(a)
            dist.append(b)
        return np.concatenate(ids), np.concatenate(dist)

    def _search(self, q: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(q), np.arange(len(q))[:, None]
        beam = min(max(self.BEAM, m), len(self.centroids))
        seen = np.zeros((n, len(self.centroids)), bool)
        d = distances(q, self.entry_signs).astype(np.int32)
        order = np.argpartition(d, beam - 1, 1)[:, :beam] if beam < d.shape[1] else np.argsort(d, 1)
        seen[:, self.entries] = True
        ids, dist = self.entries[order], np.take_along_axis(d, order, 1)
        open_ = np.ones(ids.shape, bool)
        for _ in range(self.ROUNDS if len(self.entries) < len(self.centroids) else 0):
            best = np.argsort(np.where(open_, dist, 1 << 20), 1)[:, : self.WIDTH]
            if not np.take_along_axis(open_, best, 1).any():
                break
            np.put_along_axis(open_, best, False, 1)
            new = np.sort(self.links[np.take_along_axis(ids, best, 1)].reshape(n, -1), 1)
            fresh = ~seen[rows, new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[rows, new] = True
            at, col = np.nonzero(fresh)
            dn = np.full(new.shape, 1 << 20, np.int32)
            dn[at, col] = np.bitwise_count(self.centroids[new[at, col]] ^ q[at]).sum(1, dtype=np.int32)
            ids, dist = np.concatenate([ids, new], 1), np.concatenate([dist, dn], 1)
            open_ = np.concatenate([open_, fresh], 1)
            if ids.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, 1)[:, :beam]
                ids, dist, open_ = (np.take_along_axis(x, keep, 1) for x in (ids, dist, open_))
        order = np.argsort(dist, 1, kind="stable")[:, :m]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def assign(self, v: np.ndarray, replicas: int = REPLICAS, ratio: float = RATIO) -> np.ndarray:
        """Lists of each vector, ascending; -1 where the ratio rules a list out."""
        ids, dist = self.search(v, replicas)
        return np.sort(np.where(dist <= ratio * np.maximum(dist[:, :1], 1), ids, -1), 1).astype(np.int32)


# --- decoding -------------------------------------------------------------------------------------------------------


def binary_vectors(vectors: DataFrame) -> DataFrame:
    """(key, code) of the usable records: 1,024 dimensions, 128 bytes, not all zero; records without a key are left out."""
    zero = F.lit(bytearray(BYTES))
    usable = F.col("key").isNotNull() & (F.col("dimension") == BITS) & (F.length("vector") == BYTES) & (F.col("vector") != zero)
    return vectors.where(usable).select("key", F.col("vector").alias("code"))


def _decode_batches(batches: Iterator[pa.RecordBatch], books: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        method, size, book = (np.array(batch.column(i).to_pylist(), object) for i in (1, 2, 4))
        data = batch.column(3).to_pylist()
        code = np.zeros((len(data), BYTES), np.uint8)
        done = np.zeros(len(data), bool)

        def put(rows: np.ndarray, made) -> None:
            if len(rows):
                code[rows] = made(np.frombuffer(b"".join(data[i] for i in rows), np.uint8).reshape(len(rows), -1))
                done[rows] = True

        put(np.flatnonzero((method == "none") & (size == BYTES)), lambda x: x)
        put(
            np.flatnonzero((method == "int8") & (size == BITS // 4)),
            lambda x: np.packbits(np.stack([x >> k & 1 for k in (0, 2, 4, 6)], 2).reshape(len(x), -1), axis=1),
        )
        for name, packed in books.items():
            rows = np.flatnonzero((method == "pq") & (size == len(packed)) & (book == name))
            put(rows, lambda x, p=packed: p[np.arange(len(p)), x].reshape(len(x), -1))
        keys = batch.column(0).filter(pa.array(done))
        yield pa.RecordBatch.from_arrays([keys, pa.array([bytes(c) for c in code[done]], pa.binary())], ["key", "code"])


def decoded_vectors(compressed: DataFrame, codebooks: DataFrame, max_codebooks: int = 1_000) -> DataFrame:
    """(key, code) of the usable compressed records, decoded to 1,024 packed bits.

    ``codebooks`` is a small parameter table: more than ``max_codebooks`` of them (32 KB each, packed) are refused.
    Records of unknown methods, of other lengths, without a known codebook or without a key are left out.
    """
    rows = codebooks.where((F.col("dimension") == BITS) & (F.col("n_bits") == 8)).select("codebook_id", "n_subvectors", "codebook_data").limit(max_codebooks + 1).collect()
    if len(rows) > max_codebooks:
        raise ValueError(f"more than {max_codebooks} codebooks")
    books = {}
    for name, parts, data in rows:
        if name is not None and data is not None and parts and BITS % (8 * parts) == 0 and len(data) == 256 * BITS:
            books[name] = np.packbits(np.frombuffer(data, np.uint8).reshape(parts, 256, BITS // parts) != 0, axis=2)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decode_batches(batches, books)

    slim = compressed.where(F.col("vector_id").isNotNull() & F.col("compressed_data").isNotNull())
    slim = slim.select(F.col("vector_id").alias("key"), F.lower(F.trim("method")).alias("method"), F.length("compressed_data").alias("size"), "compressed_data", "pq_codebook_id")
    return slim.mapInArrow(decode, "key string, code binary")


# --- index ----------------------------------------------------------------------------------------------------------


def nested(rows: int, list_size: int = LIST_SIZE) -> bool:
    return rows // list_size > FLAT_LISTS


def outer_replicas(lists: int) -> int:
    """Outer lists a vector may stand in, so that as few close pairs are parted by many lists as by few."""
    return max(4, math.ceil(0.75 * math.log2(max(2, lists))))


def fit(codes: DataFrame, rows: int, list_size: int = LIST_SIZE, seed: int = 7, outer: bool = False) -> Graph | None:
    """The graph of the centroids, of the ``outer`` lists' where lists are nested; from at most ``MAX_SAMPLE`` sampled vectors.

    None for an empty table.
    """
    lists = max(1, min(MAX_CENTROIDS, max(OUTER_LEAST, rows // OUTER_SIZE) if outer else rows // list_size))
    wanted = min(MAX_SAMPLE, max(2_000, lists * (OUTER_SAMPLE if outer else SAMPLE_PER_LIST)))
    share = min(1.0, wanted / max(rows, 1))
    picked = codes.select("code") if share >= 1 else codes.select("code").sample(share, seed)
    sample = picked.limit(2 * wanted).toArrow().column("code").to_pylist()
    if not sample and rows:
        sample = codes.select("code").limit(wanted).toArrow().column("code").to_pylist()
    if not sample:
        return None
    rng = np.random.default_rng(seed)
    v = np.unique(np.frombuffer(b"".join(sample), np.uint64).reshape(-1, WORDS), axis=0)
    centroids = halve(v, min(lists, len(v)), rng)
    return Graph(centroids, rng)


def _bucket_of_list(lists: np.ndarray, buckets: int, block_bits: int = BLOCK_BITS) -> np.ndarray:
    """Blocks of neighbouring lists share a bucket, so a vector goes to few buckets; crowded regions still spread."""
    return np.where(lists >= 0, (lists >> block_bits) % buckets, -1)


def _pack(code: np.ndarray, keys: list[bytes], lists: np.ndarray) -> bytes:
    sizes = np.array([len(k) for k in keys], np.uint32)
    side = zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + lists.tobytes() + b"".join(keys))
    return np.array([len(keys), lists.shape[1]], np.uint32).tobytes() + code.tobytes() + side


def _unpack(blob: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    n, m = map(int, np.frombuffer(blob, np.uint32, 2))
    code = np.frombuffer(blob, np.uint64, n * WORDS, 8).reshape(n, WORDS)
    side = zstandard.ZstdDecompressor().decompress(blob[8 + n * BYTES :])
    ends = 4 * n * (1 + m) + np.concatenate([[0], np.cumsum(np.frombuffer(side, np.uint32, n).astype(np.int64))])
    return code, [side[a:b] for a, b in zip(ends[:-1], ends[1:])], np.frombuffer(side, np.int32, n * m, 4 * n).reshape(n, m)


def _posting_batches(batches: Iterator[pa.RecordBatch], graph: Graph, buckets: int, block_bits: int, replicas: int, ratio: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        keys = [k.encode() for k in batch.column(0).to_pylist()]
        code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, WORDS)
        lists = graph.assign(code, replicas, ratio)
        bucket = _bucket_of_list(lists, buckets, block_bits)
        bucket.sort(1)
        first = np.concatenate([np.ones((len(bucket), 1), bool), bucket[:, 1:] != bucket[:, :-1]], 1) & (bucket >= 0)
        row, col = np.nonzero(first)
        to = bucket[row, col].astype(np.int64)
        order = np.argsort(to, kind="stable")
        row, to = row[order], to[order]
        start, length = runs(to)
        blobs = [_pack(code[r], [keys[i] for i in r], lists[r]) for r in (row[s : s + n] for s, n in zip(start, length))]
        yield pa.RecordBatch.from_arrays([pa.array(to[start], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _shuffled_bits(v: np.ndarray) -> np.ndarray:
    """The same vectors with their bits in another, fixed order, so any few words are a fair sample of the bits."""
    order = np.random.default_rng(1).permutation(BITS)
    out = np.empty_like(v)
    for i in range(0, len(v), 4096):
        bits = np.take(np.unpackbits(v[i : i + 4096].view(np.uint8), axis=1), order, axis=1)
        out[i : i + 4096] = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64)
    return out


class _Close:
    """Pairs within a radius, from vectors of shuffled bits.

    ``PART`` words are compared first, in bytes. A pair within the radius differs there in so many bits by chance that
    the limit, 3.5 standard deviations above the mean at the radius itself, loses less than one such pair in 4,000 and
    none that are clearly closer; what passes is counted in full.
    """

    PART, BLOCK = 5, 1 << 15

    def __init__(self, radius: int):
        share = self.PART / WORDS
        spread = radius * (1 - radius / BITS) * share * (1 - share)
        self.radius, self.limit = radius, int(min(254, radius * share + 3.5 * max(spread, 0) ** 0.5 + 1))
        self.whole = self.limit >= 200  # a byte can't hold enough bits for the limit to be safe
        self._room(2 * self.BLOCK)

    def _room(self, cells: int) -> None:
        self.x, self.c, self.sums = np.empty(cells, np.uint64), np.empty(cells, np.uint8), np.empty(cells, np.uint8)

    def pairs(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, distance), i < j."""
        n, columns = len(v), np.ascontiguousarray(v.T)
        found, i, whole = [np.zeros((0, 3), np.int64)], 0, self.whole
        while i < n and not whole:
            rest = n - i
            step = max(1, min(rest, self.BLOCK // rest))
            cells = step * rest
            if cells > len(self.x):
                self._room(cells)
            x, count, sums = (a[:cells].reshape(step, rest) for a in (self.x, self.c, self.sums))
            for w in range(self.PART):
                np.bitwise_xor(columns[w, i : i + step, None], columns[w, None, i:], out=x)
                np.bitwise_count(x, out=count if w else sums)
                if w:
                    np.add(sums, count, out=sums)
            r, c = np.divmod(np.flatnonzero(sums.ravel() <= self.limit), rest)
            whole = len(r) > 0.1 * cells and n > 256  # too alike for a part to tell: the rest is multiplied out
            later = c > r
            r, c = r[later] + i, c[later] + i
            d = np.bitwise_count(v[r] ^ v[c]).sum(1, dtype=np.int64)
            near = d <= self.radius
            found.append(np.stack([r[near], c[near], d[near]], 1))
            i += step
        s = signs(v[i:]) if i < n else None
        for a in range(0, n - i, 256):
            d = s[a : a + 256] @ s[a:].T
            r, c = np.nonzero(d >= BITS - 2 * self.radius)
            later = c > r
            r, c = r[later], c[later]
            found.append(np.stack([r + a + i, c + a + i, ((BITS - d[r, c]) / 2).astype(np.int64)], 1))
        return tuple(np.concatenate(found).T)


def _divided(v: np.ndarray, centres: np.ndarray, replicas: int, ratio: float) -> np.ndarray:
    """The nearest of a few centres for each vector, by one matrix product; -1 where the ratio rules one out."""
    out, columns, m = np.empty((len(v), min(replicas, len(centres))), np.int32), signs(centres).T, min(replicas, len(centres))
    for i in range(0, len(v), 2048):
        d = distances(v[i : i + 2048], columns)
        near = np.argpartition(d, m - 1, 1)[:, :m] if m < d.shape[1] else np.broadcast_to(np.arange(m), d.shape)
        d = np.take_along_axis(d, near, 1)
        out[i : i + 2048] = np.where(d <= ratio * np.maximum(d.min(1, keepdims=True), 1), near, -1)
    return out


def _list_pairs(v: np.ndarray, close: _Close, outer: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The close pairs of a list; an outer one, or one that outgrew its size, is divided first.

    A list that outgrew its size is a crowd around one centre, which any mean of its members comes near to and would draw
    them all. Single members divide it evenly. In outer lists such crowds are lists of the division, which are divided again.
    """
    if len(v) <= (OUTER_LONGEST if outer else MAX_LIST):
        return close.pairs(v)
    rng = np.random.default_rng(len(v))
    if outer:
        parts = max(len(v) // DIVIDED, min(INNER, len(v) // 100))
        sample = np.unique(v[rng.choice(len(v), min(len(v), parts * SAMPLE_PER_LIST), replace=False)], axis=0)
        lists = _divided(v, halve(sample, min(parts, len(sample)), rng), INNER_REPLICAS, DIVIDED_RATIO)
    else:
        members = v[rng.choice(len(v), len(v) // DIVIDED, replace=False)]
        lists = Graph(members, rng).assign(v, REPLICAS, DIVIDED_RATIO)
    flat = lists.ravel()
    order = np.argsort(flat, kind="stable")
    start, length = runs(flat[order])
    pairs, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int16)]
    for s, n in zip(start, length):
        if flat[order[s]] >= 0:
            members = np.sort(order[s : s + n] // lists.shape[1])
            i, j, d = _list_pairs(v[members], close) if outer else close.pairs(v[members])
            pairs.append(members[i] * len(v) + members[j])
            far.append(d.astype(np.int16))
    pairs, first = np.unique(np.concatenate(pairs), return_index=True)
    return pairs // len(v), pairs % len(v), np.concatenate(far)[first].astype(np.int64)


def _lowest_common(a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
    """The lowest list that both of a pair stand in; ``none`` where there is none."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), 1 << 16):
        x, y = a[i : i + (1 << 16), :, None], b[i : i + (1 << 16), None, :]
        out[i : i + (1 << 16)] = np.where((x == y) & (x >= 0), x, none).min((1, 2))
    return out


def _neighbours_of_bucket(table: pa.Table, buckets: int, n_lists: int, k: int, radius: int, block_bits: int = BLOCK_BITS, outer: bool = False) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    parts = [_unpack(b) for b in table.column("blob").to_pylist()]
    code = np.concatenate([p[0] for p in parts])
    keys = np.array([x for p in parts for x in p[1]], dtype=object)
    lists = np.concatenate([p[2] for p in parts])
    order = np.argsort(keys, kind="stable")  # ties of distance go to the smaller key, so positions are ordered by key
    code, keys, lists = code[order], keys[order], lists[order]
    # a repeated row stands beside its first copy
    again = np.zeros(len(keys), bool)
    for i in np.flatnonzero(keys[1:] == keys[:-1]) + 1:
        j = i - 1
        while j >= 0 and keys[j] == keys[i] and not again[i]:
            again[i] = (code[j] == code[i]).all()
            j -= 1
    code, keys, lists = code[~again], keys[~again], lists[~again]
    row, col = np.nonzero(_bucket_of_list(lists, buckets, block_bits) == bucket)
    which = lists[row, col]
    order = np.argsort(which, kind="stable")
    row, which = row[order], which[order]
    mixed, close = _shuffled_bits(code), _Close(radius)
    out_q, out_n, out_d = [], [], []
    for s, n in zip(*runs(which)):
        members = row[s : s + n]
        i, j, d = _list_pairs(mixed[members], close, outer)
        a, b = members[i], members[j]
        # the lowest list both stand in is theirs
        mine = (_lowest_common(lists[a], lists[b], n_lists) == which[s]) & (keys[a] != keys[b])
        a, b, d = a[mine], b[mine], d[mine]
        out_q += [a, b]
        out_n += [b, a]
        out_d += [d, d]
    q, x, d = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in (out_q, out_n, out_d))
    order = np.lexsort((x, d, q))
    q, x, d = q[order], x[order], d[order]
    start, length = runs(q)
    near = np.arange(len(q)) - np.repeat(start, length) < k
    q, x, d = q[near], x[near], d[near]
    text = pa.array([y.decode() for y in keys], pa.string())
    return pa.table({"key": text.take(pa.array(q)), "neighbour": text.take(pa.array(x)), "distance": pa.array(d.astype(np.int32))})


def squeezed(key: Column) -> Column:
    """A key in fewer bytes for a shuffle: a trailing 32-digit hexadecimal id, as of a UUID, takes 16 of them. Lossless."""
    tail = F.substring(key, -32, 32)
    short = F.concat(F.lit(bytearray([1])), F.unhex(tail), F.encode(F.substring(key, F.lit(1), F.length(key) - 32), "UTF-8"))
    return F.when(tail.rlike("^[0-9a-f]{32}$"), short).otherwise(F.concat(F.lit(bytearray([0])), F.encode(key, "UTF-8")))


def unsqueezed(data: Column) -> Column:
    head = F.substring(data, 1, 1) == F.lit(bytearray([1]))
    long = F.concat(F.decode(F.substring(data, F.lit(18), F.length(data)), "UTF-8"), F.lower(F.hex(F.substring(data, 2, 16))))
    return F.when(head, long).otherwise(F.decode(F.substring(data, F.lit(2), F.length(data)), "UTF-8"))


def nearest(codes: DataFrame, k: int = K, radius: int = RADIUS, list_size: int = LIST_SIZE) -> DataFrame:
    """(key, neighbour, distance, rank): up to ``k`` nearest other records of every record, within ``radius``.

    ``codes`` holds ``key`` and ``code`` (128 bytes). Repeated rows count once; at equal distance the smaller key is
    nearer. Every record is in the index; only the centroids are fitted on a sample. Of a vector with more than
    ``k + 1`` copies the first copies stand in the index, and the others get their neighbours, which are those, directly:
    a group of copies of any size costs no comparisons. An empty table gives no rows.
    """
    rows = codes.count()
    outer = nested(rows, list_size)
    graph = fit(codes, rows, list_size, outer=outer)
    schema = "key string, neighbour string, distance int"
    if graph is None:
        return codes.sparkSession.createDataFrame([], f"{schema}, rank int")
    main, copies = _copies_apart(codes, k)
    n_lists = len(graph.centroids)
    block_bits = 0 if outer else BLOCK_BITS
    replicas, ratio = (outer_replicas(n_lists), OUTER_RATIO) if outer else (REPLICAS, RATIO)
    buckets = n_lists if outer else min((n_lists >> BLOCK_BITS) + 1, bucket_count(codes, 4.0))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _posting_batches(batches, graph, buckets, block_bits, replicas, ratio)

    def neighbours(table: pa.Table) -> pa.Table:
        return _neighbours_of_bucket(table, buckets, n_lists, k, radius, block_bits, outer)

    found = by_bucket(main.mapInArrow(postings, "bucket int, blob binary"), buckets).applyInArrow(neighbours, schema)
    if copies is not None:
        found = found.unionByName(copies)
    # at most k rows a list of each key
    small = found.select(squeezed(F.col("key")).alias("key"), F.struct("distance", squeezed(F.col("neighbour")).alias("other")).alias("n"))
    all_near = F.transform(F.collect_set("n"), lambda n: F.struct(n["distance"].alias("distance"), unsqueezed(n["other"]).alias("neighbour")))
    grouped = small.groupBy("key").agg(F.slice(F.array_sort(all_near), 1, k).alias("near"))
    flat = grouped.select(unsqueezed(F.col("key")).alias("key"), F.posexplode("near").alias("rank", "n"))
    return flat.select("key", F.col("n.neighbour").alias("neighbour"), F.col("n.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))


def _copies_apart(codes: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """(records for the index, direct neighbours of the copies left out of it or None)."""
    marked = codes.withColumn("h", F.xxhash64("code"))
    crowded = marked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("h").persist(StorageLevel.MEMORY_AND_DISK)
    count = crowded.count()
    if not count:
        return codes, None
    small = F.broadcast(crowded) if count <= 100_000 else crowded  # 8 bytes each
    alone = marked.join(small, "h", "left_anti").select("key", "code")
    group = marked.join(small, "h", "left_semi").select("key", "code")
    # the limit on the rank is applied before the shuffle too, so a group of copies sends k + 1 rows a task
    rank = F.row_number().over(Window.partitionBy("code").orderBy("key"))
    tops = group.dropDuplicates(["key", "code"]).withColumn("r", rank).where(F.col("r") <= k + 1).drop("r")
    tops = tops.persist(StorageLevel.MEMORY_AND_DISK)
    full = tops.groupBy("code").agg(F.sort_array(F.collect_list("key")).alias("first")).where(F.size("first") > k)
    later = group.join(full, "code").where(F.col("key") > F.element_at("first", k + 1)).dropDuplicates(["key", "code"])
    direct = later.select("key", F.explode(F.slice("first", 1, k)).alias("neighbour"), F.lit(0).cast("int").alias("distance"))
    return alone.unionByName(tops), direct


def nearest_pairs(codes: DataFrame, **options) -> DataFrame:
    """(key_a, key_b), key_a < key_b: pairs of which one record is among the nearest of the other."""
    near = nearest(codes, **options)
    pairs = near.select(squeezed(F.least("key", "neighbour")).alias("a"), squeezed(F.greatest("key", "neighbour")).alias("b")).distinct()
    return pairs.select(unsqueezed(F.col("a")).alias("key_a"), unsqueezed(F.col("b")).alias("key_b"))
