"""Lexical retrieval over a corpus and fusion of ranked lists."""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import ASCII_WORD, chunks, tokens
from palimpsest.operators.replay import numbered


def occurrences(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def postings(corpus: DataFrame, key: str, text: str, pattern: str = ASCII_WORD) -> DataFrame:
    """(key, term, tf): one row per document and distinct word."""
    words = corpus.select(key, F.explode(tokens(F.col(text), pattern)).alias("term"))
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(corpus: DataFrame, key: str, text: str, pattern: str = ASCII_WORD) -> DataFrame:
    return corpus.select(key, F.size(tokens(F.col(text), pattern)).alias("dl"))


def bm25(corpus: DataFrame, query: str, key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, score): BM25 of every document; those without a query word score 0.

    Only the query's distinct words are counted, per document and without a shuffle of postings; document frequencies and
    the mean length are one row, joined to all by broadcast.
    """
    words = sorted(set(re.findall(ASCII_WORD, query.lower())))
    # exploding an array of one keeps the optimizer from splitting the text anew for every word
    doc = corpus.select(key, F.explode(F.array(tokens(F.col(text)))).alias("w")).withColumn("dl", F.size("w"))
    # a few numbers a document, kept so that texts are split once for the statistics and the scores
    counted = doc.select(key, "dl", *[occurrences("w", t).alias(f"tf{i}") for i, t in enumerate(words)]).persist(StorageLevel.MEMORY_AND_DISK)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    joined = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return joined.select(key, score.alias("score"))


def ranked(scores: DataFrame, key: str, score: str = "score", limit: int | None = None) -> DataFrame:
    """(key, score, rank) of the best ``limit`` by score, ties by key; without a limit, all, ranked over ranges by all tasks."""
    if limit is None:
        return numbered(scores.withColumn("_less", -F.col(score)), ["_less", key], "rank").drop("_less")
    top = scores.orderBy(F.desc(score), key).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, rrf): sum of 1 / (k + rank), ranks from 1 in each list."""
    parts = [part.select(key, (1 / (k + F.col("rank"))).alias("s")) for part in lists]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy(key).agg(F.sum("s").alias("rrf"))


def alpha_blend(dense: DataFrame, sparse: DataFrame, key: str, alpha: float = 0.7, weighted: bool = True) -> DataFrame:
    """(key, blend): min-max scaled scores mixed. Rows of one list only keep their part; dense-only rows unweighted if so asked."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        ends = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        span = F.col("hi") - F.col("lo")
        return df.crossJoin(F.broadcast(ends)).select(key, F.when(span > 0, (F.col("score") - F.col("lo")) / span).otherwise(1.0).alias(name))

    both = scaled(dense, "d").join(scaled(sparse, "s"), key, "full")
    mixed = alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))
    return both.select(key, (mixed if weighted else F.when(F.col("s").isNull(), F.col("d")).otherwise(mixed)).alias("blend"))


def chunk_scores(corpus: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, no, start, score): saturated term counts of 500-character chunks; repeated query words count again.

    Chunks without a query word score 0.
    """
    words = re.findall(ASCII_WORD, query.lower())
    wanted = F.array(*[F.lit(w) for w in sorted(set(words))]).cast("array<string>")

    def counted(c: Column) -> Column:
        w = tokens(c["text"])
        return F.struct(c["no"].alias("no"), c["start"].alias("start"), F.size(w).alias("n"), F.filter(w, lambda x: F.array_contains(wanted, x)).alias("hits"))

    # the words of a chunk are reduced to its hits before chunks become rows
    parts = corpus.select(key, F.explode(F.transform(chunks(F.col(text)), counted)).alias("c")).select(key, "c.no", "c.start", "c.n", "c.hits")
    score, n = F.lit(0.0), F.col("n")
    for t in words:
        tf = occurrences("hits", t)
        score = score + tf * 2.5 / (tf + 1.5 * (n / 100))
    return parts.select(key, "no", "start", F.when(n > 0, score).otherwise(0.0).alias("score"))
