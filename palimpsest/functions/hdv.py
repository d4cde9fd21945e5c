"""Binary hypervectors as ARRAY<BIGINT> of 64-bit limbs, most significant bit first."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType


def limbs_of(data: Column, dimension: int = 1024) -> Column:
    """Limbs of packed bytes."""
    parts = F.sequence(F.lit(0), F.lit(dimension // 64 - 1))
    return F.transform(parts, lambda i: F.conv(F.hex(F.substring(data, i * 8 + 1, F.lit(8))), 16, -10).cast("bigint"))


def bind(a: Column, b: Column) -> Column:
    """Exclusive or; its own inverse."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def invert(a: Column) -> Column:
    return F.transform(a, F.bitwise_not)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; null if either vector is or their lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return F.when(F.size(a) == F.size(b), total)


def similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / (F.size(a) * 64)


def ones(a: Column) -> Column:
    return F.aggregate(F.transform(a, F.bit_count), F.lit(0), lambda s, n: s + n)


def bit_entropy(a: Column) -> Column:
    """Shannon entropy of the share of ones: 1 for a balanced vector, 0 for a constant one."""
    p = ones(a) / (F.size(a) * 64)
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def permute(a: Column, shift: int, dimension: int = 1024) -> Column:
    """Rotation right by ``shift`` bits, of any sign and size."""
    n = dimension // 64
    whole, bits = divmod(shift % dimension, 64)
    at = lambda i: F.element_at(a, (i % n + 1).cast("int"))
    index = F.sequence(F.lit(0), F.lit(n - 1))
    if not bits:
        return F.transform(index, lambda i: at(i - whole + n))
    low = lambda i: F.shiftrightunsigned(at(i - whole + n), bits)
    return F.transform(index, lambda i: low(i).bitwiseOR(F.shiftleft(at(i - whole - 1 + 2 * n), 64 - bits)))


def majority(vectors: DataFrame, keys: list[str], vector: str = "v", dimension: int = 1024) -> DataFrame:
    """One bundled vector per group: a bit is set where more than half of the members have it; ties give 0.

    Bits are counted per limb and position by ordinary aggregates, so groups of any size are pre-aggregated before the
    shuffle and none is collected.
    """
    n = dimension // 64
    counts = [F.sum(F.shiftrightunsigned(F.element_at(vector, i // 64 + 1), 63 - i % 64).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(n * 64)]
    total = vectors.groupBy(*keys).agg(F.count(vector).alias("members"), F.array(*counts).alias("counts"))
    bit = lambda j, k: F.when(F.element_at("counts", (j * 64 + k + 1).cast("int")) * 2 > F.col("members"), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    limb = lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda s, k: F.shiftleft(s, 1).bitwiseOR(bit(j, k)))
    return total.select(*keys, "members", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), limb).alias(vector))


def token_vector(token: str, dimension: int) -> np.ndarray:
    """Bits of a token, expanded from its SHAKE-256 digest."""
    return np.unpackbits(np.frombuffer(hashlib.shake_256(token.encode()).digest(dimension // 8), np.uint8))


def encode_text(text: str | None, dimension: int = 1024) -> list[int]:
    """Majority of the words' vectors, each rotated by its position; zeros without words, the word's own vector for one."""
    words = re.findall(r"\b\w+\b", (text or "").lower())
    if not words:
        return [0] * (dimension // 64)
    bits = np.zeros(dimension, np.int32)
    for i, w in enumerate(words):
        bits += np.roll(token_vector(w, dimension), i)
    made = np.packbits(bits * 2 > len(words))
    return made.view(">i8").astype(np.int64).tolist()


def encoder(dimension: int = 1024):
    """A pandas UDF from texts to vectors."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: encode_text(t, dimension))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, ArrayType(LongType()))


# --- short codes of texts -------------------------------------------------------------------------------------------


def features(text: str) -> list[str]:
    """Words and the character trigrams of each padded word, with repeats."""
    out = []
    for word in re.findall(r"\w+", text.lower()):
        padded = f"^{word}$"
        out += [f"token:{word}", *(f"gram:{padded[i : i + 3]}" for i in range(max(1, len(padded) - 2)))]
    return out


def short_code(text: str) -> bytes:
    """256 bits by majority over the hashes of a text's features; ties, and a text without words, give ones."""
    votes = np.zeros(256, np.int64)
    for f in features(text):
        votes += 2 * _hash_bits(f).astype(np.int64) - 1
    return np.packbits(votes >= 0).tobytes()


@lru_cache(1 << 16)
def _hash_bits(feature: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(hashlib.sha256(feature.encode()).digest(), np.uint8))


def short_codes():
    """Column function: :func:`short_code` of texts, null for null."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else short_code(t))

    return run


def fingerprint_similarity():
    """Column function of two texts: share of equal bits of their extendable hashes of 2,048 bytes."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        digest = lambda t: np.frombuffer(hashlib.shake_256(t.encode("utf-8", "surrogatepass")).digest(2048), np.uint64)
        return pd.Series([None if x is None or y is None else 1 - int(np.bitwise_count(digest(x) ^ digest(y)).sum()) / 16384 for x, y in zip(a, b)], dtype="float64")

    return run


def attention(query: Column, context: Column, candidate: Column, alpha: float = 0.6) -> Column:
    """A candidate's similarity to a query, mixed with its novelty: its similarity to what the query has beyond the context."""
    return alpha * similarity(query, candidate) + (1 - alpha) * similarity(bind(query, context), candidate)
