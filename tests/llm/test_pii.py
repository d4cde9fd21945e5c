from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import regex

from palimpsest.llm.pii import detect, model, train
from palimpsest.llm.pii.labelled import Maker


@pytest.fixture(scope="module")
def network():
    return model.Network.load()


UNSEEN = [line.rstrip("\n") for line in Path(__file__).with_name("pii_unseen.txt").open(encoding="utf-8")]
MARK = regex.compile(r"\[(email|phone|national_id|address|person_name):((?:[^\[\]]|\[\w+\])*)\]")


def test_sentences_written_by_hand(network):
    """Some 200 sentences in other frames than those trained on, with names partly listed; the gate shows the network every item.

    They were looked at while the training data were made, so they guard against loss rather than measure unseen text.
    """
    texts = [MARK.sub(r"\2", line) for line in UNSEEN]
    want = [{(m[1], detect.normal(m[2])) for m in MARK.finditer(line)} for line in UNSEEN]
    found = [{(model.TYPES[k], detect.normal(t[a:z])) for a, z, k in spans} for t, spans in zip(texts, detect.Detector(network).find(texts))]
    right = sum(len(a & b) for a, b in zip(want, found))
    assert right / sum(map(len, want)) > 0.83 and right / sum(map(len, found)) > 0.95
    seen = [detect.normal("".join(t[a:z] for a, z in detect.regions(t))) for t in texts]
    assert all(value in s for s, items in zip(seen, want) for _, value in items)


def test_every_character_is_scored(network, monkeypatch):
    """No place is passed over for lack of digits, capitals or cue words; equal texts are scored once."""
    shown = []
    real = detect.decode
    monkeypatch.setattr(detect, "decode", lambda net, pieces: shown.extend(len(p) for p in pieces) or real(net, pieces))
    texts = ["reach anna kranz or lena brook about it", "お問い合わせは 田中 太郎 まで", "x " * 300 + "Lives at 38 Trouve Avenue. " + "y " * 300, "infra", "", "reach anna kranz or lena brook about it"]
    found = detect.Detector(network).find(texts)
    assert shown == [len(t) for t in texts[:3]] and found[0] == found[5] and [k for *_, k in found[2]] == [3]


def test_held_out_frames_and_formats(network):
    """Frames, keys and formats that training never sees; formats of numbers that no one has seen are the hard part."""
    got = train.scores(network, Maker([], [], ["The narrow session log renamed 82 rows for three sprints. " * 4], seed=12, held=True), 1200)
    assert all(got[t][0] > 0.8 and got[t][1] > 0.8 for t in ("email", "address", "person_name"))
    known = train.scores(network, Maker([], [], ["The narrow session log renamed 82 rows for three sprints. " * 4], seed=12), 1200)
    assert all(p > 0.93 and r > 0.93 for p, r in known.values())


def test_long_stretches_are_decoded_in_parts(network, monkeypatch):
    text = "Tel.: +49 30 123456 and more, " * 30 + "mailbox: anna.kranz@plimvest.org; " * 30
    whole = model.decode(network, [model.char_codes(text)])[0]
    monkeypatch.setattr(model, "PART", 200)
    monkeypatch.setattr(model, "CELLS", 1000)
    assert model.decode(network, [model.char_codes(text)])[0] == whole and len(whole) == 60
    assert model.decode(network, [model.char_codes("")]) == [[]]


def test_blocks_end_at_many_characters(monkeypatch):
    monkeypatch.setattr(detect, "BLOCK_CHARS", 10)
    batch = pa.RecordBatch.from_pydict({"id": list(range(6)), "c": ["x" * 25, None, "y", "z" * 4, "", "w" * 30], "m": [None] * 6}, pa.schema([("id", pa.int64()), ("c", pa.string()), ("m", pa.string())]))
    got = [b.column(0).to_pylist() for b in detect._blocks(batch)]
    assert sum(got, []) == list(range(6)) and len(got) > 1 and list(detect._blocks(batch.slice(0, 0))) == []


def test_gradients(network):
    net = model.Network.fresh(hidden=4, embed=3, seed=1)
    rng = np.random.default_rng(2)
    net = model.Network({k: v.astype(np.float64) for k, v in net.p.items()})
    codes = rng.integers(0, model.VOCABULARY, (3, 6)).astype(np.uint8)
    labels = np.array([[0, 1, 2, 0, 3, 0]] * 3)
    _, g = net.gradients(codes, labels)
    for name in ("out", "trans", "u0", "w1"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        sides = []
        for step in (1e-2, -1e-2):
            p = {k: v.copy() for k, v in net.p.items()}
            p[name][at] += step
            sides.append(model.Network(p).gradients(codes, labels)[0])
        assert abs((sides[0] - sides[1]) / 2e-2 - g[name][at]) < 2e-2 * max(1, abs(g[name][at]))


def test_rows_of_any_length_are_scored_as_if_padded(network):
    """What is passed over is padding: the scores are those of the training pass over whole windows."""
    rng = np.random.default_rng(4)
    sizes = np.array([model.WINDOW, model.WINDOW, 90, 41, 41, 2, 1])
    codes = rng.integers(1, model.VOCABULARY, (len(sizes), model.WINDOW)).astype(np.uint8)
    padded = np.where(np.arange(model.WINDOW) < sizes[:, None], codes, 0).astype(np.uint8)
    want = np.concatenate([network._pass(padded, d) for d in (0, 1)], 2) @ network.p["out"] + network.p["bias"]
    for rows in (slice(0, None), slice(2, None)):
        t = sizes[rows][0]
        got = network.emissions(codes[rows, :t], sizes[rows])
        for e, w, size in zip(got, want.transpose(1, 0, 2)[rows], sizes[rows]):
            assert np.allclose(e[:size], w[:size], atol=1e-4)


def test_work_follows_the_characters(network, monkeypatch):
    """Every character is scored once, but for the laps of windows; no place of padding is."""
    scored = []
    real = model.Network.emissions
    monkeypatch.setattr(model.Network, "emissions", lambda net, codes, sizes: scored.append(int(sizes.sum())) or real(net, codes, sizes))
    codes = [model.char_codes("The narrow session log renamed 82 rows for three sprints. "[: 20 + k] * 9) for k in range(38)]
    model.decode(network, codes)
    assert sum(map(len, codes)) <= sum(scored) < 1.25 * sum(map(len, codes))
    scored.clear()
    model.decode(network, [c[: 5 + k] for k, c in enumerate(codes)])
    assert sum(scored) == sum(5 + k for k in range(38))


def test_paths_of_rows_of_any_length(network):
    """Each row's best labels, as a path by path search finds them, whatever rows are beside it."""
    rng, trans = np.random.default_rng(6), network.transitions()
    sizes = np.array([9, 9, 5, 3, 1])
    e, begin = rng.normal(0, 3, (40, model.LABELS)).astype(np.float32), np.array([0, 10, 20, 26, 30])
    labels = model.viterbi(e, begin, sizes, trans)
    for r, (a, size) in enumerate(zip(begin, sizes)):
        best = {k: (float(e[a, k]) - 1e4 * (k > 0 and k % 2 == 0), [k]) for k in range(model.LABELS)}
        for s in range(a + 1, a + size):
            best = {k: max(((v + float(trans[i, k]) + float(e[s, k]), [*path, k]) for i, (v, path) in best.items()), key=lambda x: x[0]) for k in best}
        assert labels[:size, r].tolist() == max(best.values(), key=lambda x: x[0])[1] and not labels[size:, r].any()


def test_windows_are_reconciled(network):
    item = "write to fygliowyn.meshski@skeltcrou.example for the draft. "
    text = "The narrow session log renamed rows for three sprints. " * 3 + item + "Nobody moved the stale memory shard on Monday. " * 3
    a = text.index("fygliowyn")
    for cut in range(0, 60, 7):  # the item falls at other places of the windows
        (spans,) = model.decode(network, [model.char_codes(text[cut:])])
        assert (a - cut, a - cut + len("fygliowyn.meshski@skeltcrou.example"), 0) in spans


ROWS = [
    ("1", "Spoke with Feshine Fleanley about the handover. call +1 (766) 555-0167 after five.", '{"requester":{"mail":"leka_banks37@example.org"},"tags":["infra"]}'),
    ("2", None, None),
    ("3", "", ""),
    ("4", "Part no. 555-895160-K is out of stock. Session id 9835474040022114 reused.", '{"at":"2024-06-10","note":"Build 20240828-2784 shipped."}'),
    ("5", "write to zcairwell (at) zabrio.invalid for the draft.", '{"note":"my name is Sibound\\u00e9 Nann\\u00e8re.","cut":"lives at 139 Kourglu Blvd, Kylo'),
    ("6", "SSN 924-38-4094 on file. " + "The narrow log renamed rows. " * 4000 + "Lives at Flat 7, 38 Trouve Avenue, Canuville.", "not json"),
    (None, "ring back at 608-555-0181, not by chat.", "{}"),
]


def test_found_and_redacted(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS + ROWS[:1]], "id string, content string, metadata_json string, items string")
    got = {tuple(r) for r in detect.found(df).collect()}
    assert got == {
        ("1", "content", "person_name", "feshinefleanley"), ("1", "content", "phone", "17665550167"), ("1", "metadata_json", "email", "lekabanks37exampleorg"),
        ("5", "content", "email", "zcairwellatzabrioinvalid"), ("5", "metadata_json", "person_name", "siboundénannère"), ("5", "metadata_json", "address", "139kourglublvd"),
        ("6", "content", "national_id", "924384094"), ("6", "content", "address", "38trouveavenue"), (None, "content", "phone", "6085550181"),
    }
    clean = {r.id: (r.content, r.metadata_json) for r in detect.redacted(df).collect()}
    assert clean["1"] == ("Spoke with [PERSON_NAME] about the handover. call [PHONE] after five.", '{"requester":{"mail":"[EMAIL]"},"tags":["infra"]}')
    assert clean["2"] == (None, None) and clean["3"] == ("", "") and clean["4"] == ROWS[3][1:]
    assert clean["5"][1].startswith('{"note":"my name is [PERSON_NAME].","cut":"lives at [ADDRESS], Kylo')
    assert clean["6"][0].endswith("Lives at Flat 7, [ADDRESS], Canuville.") and clean["6"][1] == "not json"
    assert detect.found(df.limit(0)).count() == 0


def test_json_strings_keep_their_places():
    raw = '{"a\\"b": "x\\u00e9\\ud83d\\ude00y\\n", "k":[1,"z"], "cut":"ab\\u00'
    got = detect.strings(raw)
    assert [(k, t) for _, _, k, t, _ in got][:2] == [('a\\"b', "xé😀y\n"), ("k", "z")]
    for start, end, _, text, places in got:
        assert len(places) == len(text) + 1 and places[-1] == end and places[0] == start
