"""Trains the detector: ``python -m palimpsest.llm.pii.train DATA_DIR [WINDOWS] [EPOCHS]``.

Reads a bounded sample: at most ``TEXTS`` texts of ``documents``, which hold no personal items and serve as background, the
documentation topics of the Python library for the same purpose, and the name lexicon. ``memories`` isn't read.
"""

from __future__ import annotations

import sys

import pandas as pd

from palimpsest.llm.pii.labelled import Maker, windows
from palimpsest.llm.pii.model import LABELS, TYPES, Network, char_codes, decode, train

TEXTS = 3_000


def background(folder: str) -> list[str]:
    from pydoc_data.topics import topics

    texts = pd.read_parquet(f"{folder}/documents.parquet", columns=["text"]).text.dropna().head(TEXTS)
    return [t for t in texts if len(t) > 80] + [" ".join(t.split()) for t in topics.values() if "@" not in t]


def names(folder: str) -> tuple[list[str], list[str]]:
    table = pd.read_parquet(f"{folder}/name_lexicon.parquet")
    return tuple(table[table.name_role == role].name.tolist() for role in ("given", "family"))


def scores(network: Network, maker: Maker, count: int) -> dict[str, tuple[float, float]]:
    """(precision, recall) of exact spans by type, over made texts."""
    right, found, want = ([0] * len(TYPES) for _ in range(3))
    made = [maker.text() for _ in range(count)]
    for (_, spans), got in zip(made, decode(network, [char_codes(t) for t, _ in made])):
        for k in range(len(TYPES)):
            mine, theirs = {s for s in got if s[2] == k}, {s for s in spans if s[2] == k}
            right[k], found[k], want[k] = right[k] + len(mine & theirs), found[k] + len(mine), want[k] + len(theirs)
    return {t: (right[k] / max(1, found[k]), right[k] / max(1, want[k])) for k, t in enumerate(TYPES)}


def main(folder: str, count: int = 80_000, epochs: int = 8) -> None:
    texts, (given, family) = background(folder), names(folder)
    codes, labels = windows(Maker(given, family, texts), count)
    net = train(codes, labels, epochs)
    net.save()
    for held in (False, True):
        print("held-out frames and formats" if held else "frames and formats trained on", scores(net, Maker([], [], texts, seed=99, held=held), 3000))
    print(f"{LABELS} labels, {sum(v.size for v in net.p.values())} weights")


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
