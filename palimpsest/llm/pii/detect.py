"""Finding personal items in free text and replacing them with typed placeholders, over Arrow batches.

Every character of a text is scored by the network, and every item that comes out, of any type, was labelled by it. Its ends
are then moved to whole words, and an item that lacks what its type can't be without is dropped. Only texts that lack that for
every type aren't scored, and equal texts are scored once in a block; neither changes what is found.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.pii.model import TYPES, Network, char_codes, decode

PLACEHOLDERS = tuple(f"[{t.upper()}]" for t in TYPES)
#: Texts decoded together, and the characters in them: one text more ends a block that has as many.
BLOCK, BLOCK_CHARS = 1 << 14, 1 << 21

#: Function words, which begin sentences and never a name.
_PLAIN = (
    "A|An|The|This|That|These|Those|It|Its|He|She|We|You|They|I|If|No|Not|What|Which|Who|When|Where|Why|How|Our|Your|My|His|Her|Their|After|Before|Between|In|On|At|By|For|From|To|Of|And|But|Or|So|While|Since|Under|Over|With|Without|As|Is|Are|Was|Were|Do|Does|Did|Can"
    "|Der|Die|Das|Dem|Den|Ein|Eine|Und|Oder|Mit|Von|Im|Am|La|Le|Les|Un|Une|Des|Du|Et|El|Los|Las|Una|Y|De|Det|En|Ett|Och|Il|Lo|Gli|Che"
)
#: Words of street lines.
_LANES = "street|road|lane|avenue|drive|court|close|crescent|terrace|way|place|square|boulevard|grove|hill|gardens|row|walk|parkway|st|rd|ave|ln|dr|blvd"
_WAYS = "rue|avenue|boulevard|chemin|impasse|place|calle|avenida|paseo|plaza|via|viale|piazza|corso|rua|largo|ul|aleja"
#: A digit, a mark of an email or the space between two words, one of which every item has (see ``exact``).
_POSSIBLE = regex.compile(r"[\p{N}\s\x1c-\x1f,@(\[]")
_LITERAL = regex.compile(r'"(?:[^"\\]|\\.)*+("|$)', regex.S)
_KEY_AFTER = regex.compile(r"\s*:")
_FLAT = regex.compile(r"^(?:flat|apt\.?|apartment|unit)\s+\w+\s*,\s*", regex.I)
_TITLE = regex.compile(r"^(?:mr|mrs|ms|miss|dr|prof|sir|herr|frau|señora?|m|mme|monsieur|madame|professor|(?:\p{L}+\s+)?regards|sincerely|cheers|thanks|dear|hello)\b[.,]?\s+(?=\S+\s|\S+,)", regex.I)
_FUNCTION = regex.compile(rf"^(?:{_PLAIN})\s+(?=\S+\s)")
_DOTTED = regex.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_SCHEME = regex.compile(r"^(?:mailto|e-?mail|to|from|cc)\s?[:=]\s?", regex.I)
_AT = regex.compile(r"@|%40|&#64;|[(\[]\s?at\s?[)\]]|\sat\s", regex.I)
_DOT = regex.compile(r"\p{L}\s?(?:\.|[(\[]\s?dot\s?[)\]]|\sdot\s)\s?\p{L}|\p{N}\.\p{L}", regex.I)
#: Small words inside street lines and names.
_STREET_SMALL = {*_LANES.split("|"), *_WAYS.split("|"), "de", "du", "des", "la", "le", "les", "del", "der", "am", "an", "zum", "zur", "da", "do", "dal", "of", "the", "und"}
_NAME_SMALL = {"van", "von", "de", "der", "den", "di", "du", "la", "le", "da", "al", "el", "bin", "ter", "ten"}
_DATE = regex.compile(r"\d{4}-\d\d-\d\d")
_KEEP = regex.compile(r"[^\p{L}\p{N}]+")


def normal(value: str) -> str:
    """The letters and digits of an item, in lower case."""
    return _KEEP.sub("", value.lower())


def regions(text: str) -> list[tuple[int, int]]:
    """The stretches to be scored: the whole text, unless no item of any type can stand in it."""
    return [(0, len(text))] if _POSSIBLE.search(text) else []


def _grown(text: str, a: int, z: int, joins: str) -> tuple[int, int]:
    """The span with its ends moved out to whole words; ``joins`` may stand within a word between letters or digits."""
    while a > 0 and (text[a - 1].isalnum() or (text[a - 1] in joins and a > 1 and text[a - 2].isalnum())) and (text[a].isalnum() or text[a] in joins):
        a -= 1
    while z < len(text) and (text[z].isalnum() or (text[z] in joins and z + 1 < len(text) and text[z + 1].isalnum())) and (text[z - 1].isalnum() or text[z - 1] in joins):
        z += 1
    while z > a and not (text[z - 1].isalnum() or text[z - 1] in ".)"):
        z -= 1
    while a < z and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    if z > a and text[z - 1] == ")" and "(" not in text[a:z]:
        z -= 1
    if a < z and text[a] == "(" and ")" not in text[a:z]:
        a += 1
    return a, z


def exact(text: str, a: int, z: int, kind: int) -> tuple[int, int] | None:
    """The item at whole words, without what doesn't belong to it; None if it can't be of its type."""
    name = TYPES[kind]
    if name == "email":
        return _email(text, a, z)
    if name == "phone":
        a, z = _grown(text, a, z, "")
        digits = sum(c.isdigit() for c in text[a:z])
        return (a, z) if 7 <= digits <= 15 and not any(c.isalpha() for c in text[a:z]) and not (_DOTTED.fullmatch(text[a:z]) or _DATE.fullmatch(text[a:z])) else None
    if name == "national_id":
        a, z = _grown(text, a, z, "")
        digits, letters = sum(c.isdigit() for c in text[a:z]), sum(c.isalpha() for c in text[a:z])
        return (a, z) if 6 <= digits <= 15 and letters <= 3 and digits + letters >= 9 and not _DATE.fullmatch(text[a:z]) else None
    if name == "address":
        a, z = _grown(text, a, z, "'’-")
        a += (m := _FLAT.match(text[a:z])) and m.end() or 0
        whole = text[a:z].split(",")
        heads = [",".join(whole[: k + 1]) for k in range(len(whole))]
        line = next((x for x in heads if any(c.isdigit() for c in x) and sum(c.isalpha() for c in x) >= 3), heads[0])
        z = a + len(line.rstrip())
        words = regex.findall(r"(?<!\d)\p{L}+", line)
        proper = _written(words, _STREET_SMALL) and (any(w[0].isupper() for w in words) or text.islower())
        return (a, z) if proper and any(c.isdigit() for c in line) and sum(c.isalpha() for c in line) >= 3 else None
    a, z = _grown(text, a, z, "'’-")
    while m := _TITLE.match(text[a:z]) or _FUNCTION.match(text[a:z]):
        a += m.end()
    if regex.fullmatch(_PLAIN, text[a:z].split()[0] if text[a:z].strip() else ""):
        return None
    z -= text[a:z].endswith(".")
    words = [w for w in regex.split(r"[\s,]+", text[a:z]) if w]
    proper = len(words) >= 2 and not any(c.isdigit() for c in text[a:z]) and sum(len(w.rstrip(".")) > 1 for w in words) >= 1
    return (a, z) if proper and _written(words, _NAME_SMALL) else None


def _written(words: list[str], small: set[str]) -> bool:
    """Every word begins with a capital or is a small one; or none does, in a text without capitals."""
    lower = [w for w in words if w[0].islower()]
    return all(w in small for w in lower) or len(lower) == len(words)


def _email(text: str, a: int, z: int) -> tuple[int, int] | None:
    """The address that was labelled, its ends moved out over what can only belong to it."""
    a += (m := _SCHEME.match(text[a:z])) and m.end() or 0
    while a > 0 and a < z and (text[a - 1].isalnum() or text[a - 1] in "._+-") and (text[a].isalnum() or text[a] in "._+-@"):
        a -= 1
    while z < len(text) and z > a and (text[z].isalnum() or (text[z] in ".-_" and z + 1 < len(text) and text[z + 1].isalnum())) and (text[z - 1].isalnum() or text[z - 1] in ".-_@"):
        z += 1
    while z > a and not text[z - 1].isalnum():
        z -= 1
    while a < z and not text[a].isalnum():
        a += 1
    at = _AT.search(text, a, z)
    return (a, z) if at and at.start() > a and _DOT.search(text, at.end(), z) else None


def strings(raw: str) -> list[tuple[int, int, str, str, Sequence[int]]]:
    """The string values of JSON text, whole or cut off: (start, end, key, decoded, places of its characters in the text).

    Keys are no values. A literal that is cut off counts as far as it goes.
    """
    out, key = [], ""
    for m in _LITERAL.finditer(raw):
        body_end = m.end() - len(m[1])
        if _KEY_AFTER.match(raw, m.end()):
            key = raw[m.start() + 1 : body_end]
            continue
        i = m.start() + 1
        if "\\" not in (body := raw[i:body_end]):
            out.append((i, body_end, key, body, range(i, body_end + 1)))
            key = ""
            continue
        text, places = [], []
        while i < body_end:
            size, ch = 1, raw[i]
            if ch == "\\":
                size = 6 if raw[i + 1 : i + 2] == "u" else 2
                piece = raw[i : min(i + size, body_end)]
                if size == 6 and piece[2:6].lower()[:1] == "d" and raw[i + 6 : i + 8] == "\\u" and i + 12 <= body_end:
                    try:
                        joined = json.loads(f'"{raw[i : i + 12]}"')
                        if len(joined) == 1:
                            piece, size = raw[i : i + 12], 12
                    except ValueError:
                        pass
                try:
                    ch = json.loads(f'"{piece}"')
                except ValueError:
                    ch = piece[0]
                    size = 1
            text.append(ch if len(ch) == 1 and not 0xD800 <= ord(ch) <= 0xDFFF else "�")
            places.append(i)
            i += size
        places.append(body_end)
        out.append((m.start() + 1, body_end, key, "".join(text), places))
        key = ""
    return out


class Detector:
    def __init__(self, network: Network):
        self.network = network

    def find(self, texts: list[str], heads: list[str] | None = None) -> list[list[tuple[int, int, int]]]:
        """Items (start, end, type) of each text. ``heads`` are words before a text that tell about it, such as a JSON key."""
        pieces, seen, where = [], {}, []
        for i, text in enumerate(texts):
            head = f"{heads[i]}: " if heads and heads[i] else ""
            for a, z in regions(text):
                lead = head if a == 0 else ""
                piece = lead + text[a:z]
                if piece not in seen:
                    seen[piece] = len(pieces)
                    pieces.append(char_codes(piece))
                where.append((i, a - len(lead), seen[piece]))
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        labelled = decode(self.network, pieces)
        for i, shift, piece in where:
            for a, z, kind in labelled[piece]:
                a, z = max(0, a + shift), z + shift
                if z <= a:
                    continue
                item = exact(texts[i], a, z, kind)
                if item and not (found[i] and item[0] < found[i][-1][1]):
                    found[i].append((*item, kind))
        return found


def _replaced(text: str, items: list[tuple[int, int, int]], places: Sequence[int] | None = None) -> str:
    out, at = [], 0
    for a, z, kind in items:
        p, q = (a, z) if places is None else (places[a], places[z])
        out += [text[at:p], PLACEHOLDERS[kind]]
        at = q
    return "".join(out) + text[at:]


_ITEM = pa.struct([("field_name", pa.string()), ("pii_type", pa.string()), ("pii_value", pa.string())])


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
    block = (np.cumsum(sizes) - sizes) // BLOCK_CHARS * len(batch) + np.arange(len(batch)) // BLOCK
    for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(block)) + 1) if len(batch) else ():
        yield batch.slice(int(rows[0]), len(rows))


def _batches(batches: Iterator[pa.RecordBatch], network: Network) -> Iterator[pa.RecordBatch]:
    detector = Detector(network)
    for batch in batches:
        for part in _blocks(batch):
            content, meta = part.column(1).to_pylist(), part.column(2).to_pylist()
            items: list[list[dict]] = [[] for _ in content]

            def note(i: int, field: str, text: str, spans: list, items=items) -> None:
                items[i] += [{"field_name": field, "pii_type": TYPES[k], "pii_value": normal(text[a:z])} for a, z, k in spans]

            clean = []
            for i, (text, spans) in enumerate(zip(content, detector.find([t or "" for t in content]))):
                note(i, "content", text or "", spans)
                clean.append(_replaced(text, spans) if spans else text)
            values = [(i, *s) for i, raw in enumerate(meta) if raw for s in strings(raw)]
            spans_of = detector.find([v[4] for v in values], [v[3] for v in values])
            by_row: dict[int, list] = {}
            for v, spans in zip(values, spans_of):
                if spans:
                    note(v[0], "metadata_json", v[4], spans)
                    by_row.setdefault(v[0], []).extend((v[5][a], v[5][z], k) for a, z, k in spans)
            kept = [_replaced(raw, sorted(by_row[i])) if i in by_row else raw for i, raw in enumerate(meta)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(clean, pa.string()), pa.array(kept, pa.string()), pa.array(items, pa.list_(_ITEM))],
                ["id", "content", "metadata_json", "items"],
            )


def detect(texts: DataFrame, key: str = "id", content: str = "content", metadata: str = "metadata_json", network: Network | None = None) -> DataFrame:
    """(id, content, metadata_json, items): both fields with placeholders for their personal items, and the items.

    The strings inside the JSON text are searched decoded and replaced in place, so everything else of it stays as it was,
    valid or not. Null fields stay null; a field without items is returned unchanged; repeated rows come out repeatedly.
    Nothing is shuffled: rows are independent, and the network (some 60 KB) travels with the task.
    """
    network = network or Network.load()
    slim = texts.select(F.col(key).alias("id"), F.col(content).alias("content"), F.col(metadata).alias("metadata_json"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(batches, network)

    return slim.mapInArrow(run, f"id {kind}, content string, metadata_json string, items array<struct<field_name:string,pii_type:string,pii_value:string>>")


def found(texts: DataFrame, key: str = "id") -> DataFrame:
    """(id, field_name, pii_type, pii_value), distinct."""
    rows = detect(texts, key).where(F.size("items") > 0).select("id", F.explode(F.array_distinct("items")).alias("i"))
    return rows.select("id", "i.field_name", "i.pii_type", "i.pii_value").distinct()


def redacted(texts: DataFrame, key: str = "id") -> DataFrame:
    """(id, content, metadata_json) with placeholders."""
    return detect(texts, key).select("id", "content", "metadata_json")
