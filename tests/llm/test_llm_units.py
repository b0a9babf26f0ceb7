"""Pieces of the training-data operators against brute force."""

import io
import random
import zipfile

import numpy as np
import pytest

from factloom.llm import decontaminate, packing, piecewise, simhash, warc_zip
from factloom.llm.suffix_array import SuffixArray
from factloom.llm.suffix_dedup import units
from factloom.llm.token_counts import allocate, line_bounds


def test_suffix_array_orders_and_finds_copies():
    rng = random.Random(1)
    for trial in range(150):
        depth = rng.choice([3, 8, 9, 16, 20])
        letters = b"ab" if trial % 2 else b"abcdefgh "
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 12))]
        texts += texts[:2] if trial % 3 == 0 else []
        array = SuffixArray(texts, depth)
        joined = b"".join(bytes(c + 1 for c in t) + b"\0" for t in texts)
        keys = [joined[i : joined.index(0, i) + 1][:depth] for i in array.order.tolist()]
        assert sorted(array.order.tolist()) == list(range(len(joined)))
        assert keys == sorted(keys)
        seen, want = set(), []
        for start, t in zip(array.starts.tolist(), texts, strict=True):
            for i in range(len(t) - depth + 1):
                if t[i : i + depth] in seen:
                    want.append(start + i)
                seen.add(t[i : i + depth])
        assert array.later_copies(np.arange(len(joined))).tolist() == want


def test_units_depend_on_the_window_alone():
    rng = random.Random(2)
    for _ in range(20):
        data = bytes(rng.choice(b"abc d") for _ in range(rng.randint(90, 700)))
        anchors, first, count, _ = units(data)
        assert count.sum() == max(len(data) - 99, 0)
        for s in range(0, len(data) - 99, 31):
            assert units(data[s : s + 100])[0][0] == anchors[np.searchsorted(first, s, side="right") - 1]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert piecewise.edit_distance(a, b) == levenshtein(a, b)


def test_fingerprints_follow_edits():
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    for n in (40, 300, 3000):
        x, y = text(n), text(n)
        q = len(x) // 4
        near = piecewise.likeness(piecewise.fingerprint(x), piecewise.fingerprint(x[: len(x) - q] + y[:q]))
        far = piecewise.likeness(piecewise.fingerprint(x), piecewise.fingerprint(y))
        assert near > 0.5 > 0.3 > far
    assert piecewise.likeness(piecewise.fingerprint(""), piecewise.fingerprint("")) == 1.0
    assert piecewise.likeness(piecewise.fingerprint(""), piecewise.fingerprint(x)) == 0.0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_reader_equals_the_standard_library(zip64):
    data = warc_zip.zip_package([("a", b"hello"), ("b/c", bytes(range(256)) * 9)], zip64, b"comment\n")
    reader = warc_zip.ZipReader(lambda start, length: data[start : start + length], len(data))
    plain = zipfile.ZipFile(io.BytesIO(data))
    assert plain.testzip() is None
    assert reader.members.keys() == set(plain.namelist())
    assert all(reader.whole(n) == plain.read(n) for n in plain.namelist())
    assert reader.range("b/c", 7, 3) == bytes([7, 8, 9])
    with pytest.raises(ValueError):
        reader.range("a", 3, 9)
    odd = warc_zip.zip_package([("a", b"hello")], zip64, b"PK\x05\x06 in a comment")
    assert warc_zip.ZipReader(lambda start, length: odd[start : start + length], len(odd)).whole("a") == b"hello"


def test_automaton_finds_every_window():
    rng = random.Random(5)
    for _ in range(150):
        words = [f"w{i}" for i in range(rng.choice([2, 4, 8]))]
        items = [(str(i), [rng.choice(words) for _ in range(rng.randint(1, 9))]) for i in range(rng.randint(1, 6))]
        window = rng.randint(2, 5)
        machine = decontaminate.SuffixAutomaton(items, window)
        doc = [rng.choice([*words, "x"]) for _ in range(60)]
        hit, met = set(), set()
        for item, ws in items:
            n = min(window, len(ws))
            for i in range(len(ws) - n + 1):
                for j in range(len(doc) - n + 1):
                    if doc[j : j + n] == ws[i : i + n]:
                        hit |= set(range(j, j + n))
                        met.add(item)
        spans, found = machine.scan(doc)
        assert {p for a, b in spans for p in range(a, b)} == hit
        assert found == met
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_cleaned_text_keeps_the_rest():
    machine = decontaminate.SuffixAutomaton([("1", "a b c d e f g h i j".split())])
    text = "Start, " + "A b-c D e f; g h i j" + " the end of it all and much more besides to keep it"
    assert decontaminate.cleaned(text, machine, 5, 0.5) == "Start,  the end of it all and much more besides to keep it"
    assert decontaminate.cleaned("a b c d e f g h i j end", machine, 5, 0.5) is None
    assert decontaminate.cleaned("nothing here", machine, 5, 0.5) == "nothing here"


def test_packing_cuts_every_token_once():
    rng = random.Random(6)
    for _ in range(60):
        lengths = [rng.choice([1, 7, 63, 64, 130, 700, 1024, 5000]) + rng.randint(0, 3) for _ in range(rng.randint(1, 80))]
        windows, left = packing.pack([(k, 0, n) for k, n in enumerate(lengths)])
        assert not left
        taken = sorted((k, s, n) for _, pieces in windows for k, s, n in pieces)
        at = {}
        for k, s, n in taken:
            assert n > 0 and s == at.get(k, 0)
            at[k] = s + n
        assert at == dict(enumerate(lengths))
        short = [size - sum(n for *_, n in pieces) for size, pieces in windows]
        assert sum(1 for x in short if x) <= 1 and min(short) >= 0
        windows, left = packing.pack([(k, 0, n) for k, n in enumerate(lengths)], last=False)
        assert all(size == sum(n for *_, n in pieces) for size, pieces in windows)
        assert sum(n for *_, n in left) < 1024


def test_tokens_are_allocated_to_the_larger_share():
    assert line_bounds(b"ab\ncd\n").tolist() == [3, 6]
    assert line_bounds(b"ab\ncd").tolist() == [3, 5]
    owner, crossing = allocate(np.array([2, 5, 6]), np.array([3, 6]))
    assert owner.tolist() == [0, 1, 1] and crossing.tolist() == [False, True, False]
    owner, _ = allocate(np.array([2, 4, 6]), np.array([3, 6]))
    assert owner.tolist() == [0, 0, 1]


def test_shingles_and_votes():
    assert simhash.shingles([], 4) == []
    assert simhash.shingles([b"a", b"b"], 4) == [b"a b"]
    assert simhash.shingles([b"a", b"b", b"c", b"d", b"e"], 4) == [b"a b c d", b"b c d e"]
    assert simhash.vote(np.array([1, 1, 2], dtype=np.uint64)) == 1
    assert simhash.vote(np.array([1, 2], dtype=np.uint64)) == 0
    assert simhash.words("AÉ\x0bb\tC d") == ["aÉ".encode(), b"b", "c d".encode()]


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(7)
    bits = rng.random((500, 64)) < rng.random(64)
    both = bits.T.astype(float) @ bits
    for distance in (2, 4, 7):
        for count in (2, 3, 4, 5):
            parts = simhash.group_bits(500, both, count)
            assert sorted(b for p in parts for b in p) == list(range(64))
            cost, ts = simhash.allot(500, both, parts, distance)
            assert sum(t + 1 for t in ts) == distance + 1 and cost > 0
