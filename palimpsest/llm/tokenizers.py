"""Public tokenizers: encoding, token counts, offsets and decoding, over Arrow batches.

The vocabulary files are found through the package ``public_tokenizers`` or the folder given as ``folder``; nothing of them
is kept in this library.
"""

from __future__ import annotations

import base64
import os
import sys
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k"
#: Texts are handed to a tokenizer in blocks of about so many characters, so a batch of long texts needs no more memory.
BLOCK_CHARS = 1 << 20


def vocabulary(name: str, folder: str = FOLDER) -> Path:
    found = [p for p in (Path(folder) / f"{name}{end}" for end in (".json", ".model", ".tiktoken")) if p.exists()]
    if not found:
        raise FileNotFoundError(f"no tokenizer {name!r} in {folder}")
    return found[0]


def _once(key: tuple, make):
    """One instance per Python worker, whatever the number of tasks it runs."""
    kept = sys.modules.setdefault("_palimpsest_worker", type(sys)("_palimpsest_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


# --- byte table -----------------------------------------------------------------------------------------------------


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary, by rule.

    Bytes that are visible in Latin-1 stand for themselves; the others take the code points from 256 on, in order.
    """
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    table, spare = [], 256
    for b in range(256):
        table.append(chr(b) if b in visible else chr(spare))
        spare += b not in visible
    return table


class ByteLevel:
    """Encoding by a byte-level vocabulary of the ``tokenizers`` library, and its inverse."""

    def __init__(self, name: str, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(str(vocabulary(name, folder)))
        self.tokenizer.encode_special_tokens = True  # strings that look like special tokens are ordinary text
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.pieces: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def token_bytes(self, ids) -> list[bytes]:
        return [self.pieces[i] for i in ids]

    def decode(self, ids) -> str:
        """The text: bytes are joined before they are read as characters, so characters split between tokens come back."""
        return b"".join(self.token_bytes(ids)).decode("utf-8", errors="replace")

    def offsets(self, ids) -> list[tuple[int, int]]:
        """(start, end) of every token in code points. A token that holds part of a character covers that character."""
        spans, pos, lengths = [], 0, self.token_bytes(ids)
        data = np.frombuffer(b"".join(lengths), np.uint8)
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before each byte
        for piece in lengths:
            a, pos = pos, pos + len(piece)
            inside = a < len(data) and (data[a] & 0xC0) == 0x80
            spans.append((int(begins[a]) - inside, int(begins[pos])))
        return spans


def byte_level(name: str = BYTE_BPE, folder: str = FOLDER) -> ByteLevel:
    return _once(("byte", name, folder), lambda: ByteLevel(name, folder))


def blocks(texts: list[str], chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about ``chars`` characters together; a longer text is a block of its own."""
    block: list[str] = []
    held = 0
    for t in texts:
        if block and held + len(t) > chars:
            yield block
            block, held = [], 0
        block.append(t)
        held += len(t)
    if block:
        yield block


def _encode_batches(batches: Iterator[pa.RecordBatch], name: str, folder: str) -> Iterator[pa.RecordBatch]:
    coder = byte_level(name, folder)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        parts, sizes = [], []
        for block in blocks(texts):
            for ids in coder.encode(block):
                parts.append(np.array(ids, np.int32))
                sizes.append(len(ids))
        values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        ends = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=ends[1:])
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])


def encode(texts: DataFrame, key: str = "doc_id", text: str = "text", name: str = BYTE_BPE, folder: str = FOLDER) -> DataFrame:
    """(key, ids) of every row, by a byte-level tokenizer without special tokens.

    Empty and null texts give an empty list; a null key is kept; repeated rows are each encoded. Only the two columns are
    read, and nothing is shuffled. ``name`` must have a vocabulary for the ``tokenizers`` library.
    """
    slim = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    run = partial(_encode_batches, name=name, folder=folder)
    return slim.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def _decode_batches(batches, name, folder):
    coder = byte_level(name, folder)
    for batch in batches:
        texts = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = BYTE_BPE, folder: str = FOLDER) -> DataFrame:
    """(key, text): the inverse of ``encode`` for whole texts; null ids give a null text."""
    slim = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(partial(_decode_batches, name=name, folder=folder), f"key {kind}, text string").select(F.col("key").alias(key), F.col("text"))


def _offset_batches(batches, name, folder):
    coder = byte_level(name, folder)
    pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        out = []
        for block in blocks([t or "" for t in batch.column(1).to_pylist()]):
            out += [[{"start": a, "end": b} for a, b in coder.offsets(ids)] for ids in coder.encode(block)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pair))], ["key", "spans"])


def token_offsets(texts: DataFrame, key: str = "doc_id", text: str = "text", name: str = BYTE_BPE, folder: str = FOLDER) -> DataFrame:
    """(key, spans): the code points each token covers, beside the ids of ``encode``."""
    slim = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    made = slim.mapInArrow(partial(_offset_batches, name=name, folder=folder), f"key {kind}, spans array<struct<start:int,end:int>>")
    return made.select(F.col("key").alias(key), "spans")


# --- counts ---------------------------------------------------------------------------------------------------------


class _Split:
    """Tokenizers that split a text into the same pieces, which never merge with each other.

    Most pieces recur, so the counts of each are kept, one field of an integer a tokenizer: a text is split once and the
    sum of its pieces' integers holds all its counts. The counts equal those of full encodings.
    """

    #: Pieces kept; beyond it the store is emptied, so a worker's memory stays bounded.
    KEPT = 500_000
    BITS = 40

    def __init__(self, prepare, split, coders: list):
        self.prepare, self.split, self.coders, self.known = prepare, split, coders, {}

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) > self.KEPT:
            self.known.clear()  # a block asks for all the pieces of its texts that missed one
        new = list(set(pieces).difference(self.known))
        fields = [coder(new) for coder in self.coders]
        self.known.update(zip(new, (sum(n << self.BITS * i for i, n in enumerate(row)) for row in zip(*fields))))

    def counts(self, texts: list[str]) -> list[int]:
        out: list = []
        for block in blocks(texts):
            split = [self.split(self.prepare(t)) for t in block]
            sums: list = [self._sum(pieces) for pieces in split]
            missed = [k for k, n in enumerate(sums) if n is None]
            if missed:
                self._learn([p for k in missed for p in split[k]])
                for k in missed:
                    sums[k] = self._sum(split[k])
            out += sums
        return out

    def _sum(self, pieces: list[str]) -> int | None:
        try:
            return sum(map(self.known.__getitem__, pieces))
        except KeyError:
            return None


def _piece_model(path: Path):
    import sentencepiece

    model, space = sentencepiece.SentencePieceProcessor(model_file=str(path)), "▁"
    if any(space in model.id_to_piece(i).lstrip(space) for i in range(model.get_piece_size())):
        raise ValueError(f"{path.name}: pieces reach over a space")

    # the model puts a space before a text; no piece has one after another character, so spaces begin the pieces
    def count(pieces: list[str]) -> list[int]:
        return [len(x) if p != space else 1 for p, x in zip(pieces, model.encode([p[1:] for p in pieces], num_threads=1))]

    return (lambda t: t and space + t.replace(" ", space)), f"{space}+[^{space}]*", count


def _byte_ranks(path: Path):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.open("rb"))}
    coder = tiktoken.Encoding(path.stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return str, PATTERN, lambda pieces: [len(coder.encode_ordinary(p)) for p in pieces]


def _word_model(path: Path):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(str(path))
    coder.encode_special_tokens = True
    normal = coder.normalizer.normalize_str

    # white space is dropped by the split, so plain ASCII needs no more than lower case
    def prepare(t: str) -> str:
        return t.lower() if t.isascii() else normal(t)

    return prepare, WORD_PATTERN, lambda pieces: [len(e) for e in coder.encode_batch_fast(pieces, add_special_tokens=False)]


class Counter:
    """Token counts of whole texts by several tokenizers at once."""

    def __init__(self, names: tuple[str, ...], folder: str):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made: dict[str, _Split] = {}
        self.fields = []
        for name in names:
            ranks = Path(folder) / f"{name}.tiktoken"
            path = ranks if ranks.exists() else vocabulary(name, folder)
            kind = {".tiktoken": _byte_ranks, ".model": _piece_model}.get(path.suffix, _word_model)
            prepare, pattern, coder = kind(path)
            key = pattern if kind is _byte_ranks else name
            split = made.setdefault(key, _Split(prepare, regex.compile(pattern).findall, []))
            split.coders.append(coder)
            self.fields.append((key, _Split.BITS * (len(split.coders) - 1)))
        self.splits = made

    def counts(self, texts: list[str]) -> list[list[int]]:
        """One list of counts a tokenizer."""
        sums = {key: split.counts(texts) for key, split in self.splits.items()}
        low = (1 << _Split.BITS) - 1
        return [[(n >> shift) & low for n in sums[key]] for key, shift in self.fields]


#: The split patterns of the vocabularies, which must equal theirs.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def counter(names: tuple[str, ...], folder: str = FOLDER) -> Counter:
    return _once(("counter", names, folder), lambda: Counter(names, folder))
