"""Text functions as column expressions; tokens follow Unicode word characters unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)\w+"
ASCII_WORD = r"[a-z0-9_]+"


def tokens(text: Column, pattern: str = ASCII_WORD) -> Column:
    """Lower-case words in order, with repeats; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1)), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(query: Column, found: Column) -> Column:
    """Share of the distinct query tokens that occur; 0 for an empty query."""
    wanted = F.size(F.array_distinct(query))
    return F.when(wanted == 0, 0.0).otherwise(F.size(F.array_intersect(query, found)) / wanted)


def squeeze_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def token_estimate(text: Column) -> Column:
    """A token for four characters, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def chunks(text: Column, size: int = 500, step: int = 450) -> Column:
    """Overlapping windows of characters as structs (no, start, text); none for empty and null texts."""
    n = F.coalesce(F.length(text), F.lit(0))
    last = F.floor((F.greatest(n, F.lit(1)) - 1) / step).cast("int")
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("no"), (i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))
    return F.when(n > 0, made).otherwise(F.array().cast("array<struct<no:int,start:int,text:string>>"))


def glob_pattern(pattern: str) -> str:
    """The regular expression of a file-name pattern: ``*``, ``?`` and ``[...]``, ``[!...]``; all else stands for itself."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            no, inside = pattern[i + 1] in "!^", pattern[i + 1 : end]
            plain = "".join(x if x == "-" or x.isalnum() else "\\" + x for x in inside[no:])
            out, i = out + f"[{'^' * no}{plain}]", end
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def glob(text: Column, pattern: str) -> Column:
    return text.rlike(glob_pattern(pattern))


def checksum(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def query_id(text: Column) -> Column:
    """Stable id of a query: case and outer space don't matter."""
    return F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, 16)


def domain(text: Column, keywords: dict[str, list[str]], default: str) -> Column:
    """The domain with most keyword occurrences as substrings; ties go to the first named."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = [(name, sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))) for name, words in keywords.items()]
    best = F.greatest(*[c for _, c in counts]) if len(counts) > 1 else counts[0][1]
    out = F.when(best == 0, default)
    for name, c in counts:
        out = out.when(c == best, name)
    return out


# --- context windows ------------------------------------------------------------------------------------------------


def keyword_relevance(query: str, text: Column, base: float = 0.1) -> Column:
    """1 where the query stands in the text, else the share of its words that occur and 0.3, else ``base``; case doesn't matter.

    An empty query says nothing: 0.5 for every text.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    words = sorted(set(query.lower().split()))
    if not words:
        return F.lit(0.5)
    found = F.size(F.array_intersect(F.split(low, "[ \\t\\n\\r\\f]+"), F.array(*map(F.lit, words))))
    return F.when(F.contains(low, F.lit(query.lower())), 1.0).when(found > 0, F.least(F.lit(1.0), found / len(words) + 0.3)).otherwise(base)


def context_score(relevance: Column, hours: Column, importance: Column, tokens: Column, half_life_hours: float = 24.0) -> Column:
    """Rank of a text for a context window: relevance, recency, importance and brevity, weighted as powers."""
    recency = F.greatest(F.lit(0.1), F.pow(F.lit(2.0), -hours / half_life_hours))
    brief = 1 / (1 + tokens / 1000)
    return relevance * F.pow(recency, F.lit(0.5)) * F.pow(F.least(F.lit(1.0), importance), F.lit(0.7)) * F.pow(brief, F.lit(0.3))


def complexity(text: Column) -> Column:
    """How demanding a query looks, in 0..1: many words, words that ask for thought, words of doubt."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    many = F.size(F.filter(F.split(low, "[ \\t\\n\\r\\f]+"), lambda w: w != "")) > 20
    # fixed values: words that tell
    thought, doubt = ("analyze", "compare", "why", "how", "plan", "design", "evaluate"), ("maybe", "unsure", "unknown", "complex")
    return F.round(F.when(many, 0.3).otherwise(0.0) + F.when(has(thought), 0.4).otherwise(0.0) + F.when(has(doubt), 0.2).otherwise(0.0), 6)


def _size(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4).cast("int"))


def grouped_pieces(pieces: Column, joint: str, most: int, overlap: int = 0) -> Column:
    """Neighbouring pieces joined while their token estimate stays within ``most``; blank pieces are dropped.

    With ``overlap``, so many last characters of the open chunk aren't counted. A piece that is too large stands alone.
    """
    blank = F.lit("")
    start = F.struct(F.array().cast("array<string>").alias("done"), blank.alias("open"))

    def step(s: Column, piece: Column) -> Column:
        whole = F.when(s["open"] == "", piece).otherwise(F.concat(s["open"], F.lit(joint), piece))
        spare = F.when(s["open"] == "", 0).otherwise(_size(F.right(s["open"], F.lit(overlap)))) if overlap else F.lit(0)
        size = F.when(s["open"] == "", _size(piece)).otherwise(_size(s["open"]) + _size(piece) - spare) if overlap else _size(whole)
        fits = size <= most
        done = F.when(fits | (s["open"] == ""), s["done"]).otherwise(F.array_append(s["done"], s["open"]))
        return F.struct(done.alias("done"), F.when(fits, whole).otherwise(piece).alias("open"))

    kept = F.filter(F.coalesce(pieces, F.array().cast("array<string>")), lambda p: F.trim(p) != "")
    return F.aggregate(kept, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def paragraph_chunks(text: Column, most: int = 512, overlap: int = 64) -> Column:
    """Paragraphs, parted by blank lines, joined to chunks of about ``most`` tokens; none for null and blank texts."""
    return grouped_pieces(F.split(F.trim(text), r"\n\n+"), "\n\n", most, overlap)


def sentence_chunks(text: Column, most: int = 512) -> Column:
    """Sentences, parted after ``.``, ``!`` or ``?``, joined to chunks of at most ``most`` tokens where they aren't larger."""
    return grouped_pieces(F.split(F.trim(text), r"(?<=[.!?])\s+"), " ", most)


def token_chunks(text: Column, most: int = 512, overlap: int = 64) -> Column:
    """Windows of about ``most`` tokens of four characters that end at a space of their second half, if it has one.

    Neighbours share about ``overlap`` tokens. Null and blank texts have none.
    """
    wide, lap = most * 4, overlap * 4
    if lap * 2 > wide:
        raise ValueError("overlap must be at most half of a chunk")
    n = F.length(F.coalesce(text, F.lit("")))
    steps = F.sequence(F.lit(1), F.ceil(n / (wide / 2 - lap if wide / 2 > lap else 1)).cast("int") + 1)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).alias("at"), F.lit(False).alias("over"))

    def step(s: Column, _: Column) -> Column:
        cut = F.substring(text, s["at"] + 1, F.lit(wide))
        space = F.length(cut) - F.locate(" ", F.reverse(cut)) + 1  # characters up to and with the last space
        inside = (s["at"] + wide < n) & (F.locate(" ", F.reverse(cut)) > 0) & (space > wide / 2)
        size = F.when(inside, space).otherwise(F.lit(wide)).cast("int")
        piece = F.trim(F.substring(text, s["at"] + 1, size))
        done = F.when(s["over"] | (piece == ""), s["done"]).otherwise(F.array_append(s["done"], piece))
        return F.struct(done.alias("done"), (s["at"] + size - lap).alias("at"), (s["over"] | (s["at"] + size >= n)).alias("over"))

    made = F.aggregate(steps, start, step, lambda s: s["done"])
    return F.when(n > 0, made).otherwise(F.array().cast("array<string>"))
