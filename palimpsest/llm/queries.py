"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.llm import neardup, packing, spans, tokenizers, vectors
from palimpsest.llm.pii import detect
from palimpsest.session import table


def _packed(s, d):
    return packing.pack(table(s, d, "documents"), table(s, d, "context_windows"))


def _codes(s, d):
    return {
        "vectors": vectors.binary_vectors(table(s, d, "vectors")),
        "compressed_vectors": vectors.decoded_vectors(table(s, d, "compressed_vectors"), table(s, d, "pq_codebooks")),
    }


def _of_tables(s, d, operator):
    parts = [operator(codes).select(F.lit(name).alias("table_name"), "*") for name, codes in _codes(s, d).items()]
    return parts[0].unionByName(parts[1])


def _alike(s, d):
    return neardup.similar_pairs(table(s, d, "memories"), "id", "content").toDF("memory_id_a", "memory_id_b")


QUERIES = {
    "p1_found": lambda s, d: detect.found(table(s, d, "memories")).withColumnRenamed("id", "memory_id"),
    "p1_redacted": lambda s, d: detect.redacted(table(s, d, "memories")).withColumnRenamed("id", "memory_id"),
    "p3_found": _alike,
    "p3_groups": lambda s, d: neardup.groups(table(s, d, "memories"), "id", "content"),
    "p5_found": lambda s, d: _of_tables(s, d, vectors.nearest_pairs),
    "p5_nearest": lambda s, d: _of_tables(s, d, vectors.nearest),
    "p6_ids": lambda s, d: tokenizers.encode(table(s, d, "documents")),
    "p6_decoded": lambda s, d: tokenizers.decode(tokenizers.encode(table(s, d, "documents"))),
    "p6_offsets": lambda s, d: tokenizers.token_offsets(table(s, d, "documents")),
    "p7_packed": _packed,
    "p7_fill": lambda s, d: packing.fill(_packed(s, d), table(s, d, "context_windows")),
    "p8_found": lambda s, d: spans.shared_spans(table(s, d, "documents")),
    "p8_share": lambda s, d: spans.shared_share(table(s, d, "documents")),
}

SQL = {
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
