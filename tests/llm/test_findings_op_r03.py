"""The findings of round 3 on op5 and op8."""

import random

import numpy as np

from fieldspark.llm import components, fuzzy_lines, suffix_dedup


def _brute(segments, widths, length):
    seen = {}
    for s, w in zip(segments, widths):
        for k in range(w):
            seen[s[k : k + length]] = seen.get(s[k : k + length], 0) + 1
    return [[k for k in range(w) if seen[s[k : k + length]] > 1] for s, w in zip(segments, widths)], len(seen)


def test_equal_segments_are_sorted_once(monkeypatch):
    """Repeats are those of brute force, and the array holds each different segment once however often it occurs."""
    rng = np.random.default_rng(8)
    sorted_ = []
    sort = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text, ends: sorted_.append(len(text)) or sort(text, ends))
    for _ in range(40):
        length = int(rng.integers(3, 12))
        base = rng.integers(97, 99, 80, dtype=np.uint8).tobytes()
        segments = [base[a : a + length + int(rng.integers(0, 25))] for a in rng.integers(0, 40, 9).tolist()]
        segments += [rng.integers(97, 100, length + int(rng.integers(0, 9)), dtype=np.uint8).tobytes() for _ in range(4)]
        segments += [segments[k] for k in rng.integers(0, 13, 12).tolist()]
        widths = [len(s) - length + 1 for s in segments]
        want, classes = _brute(segments, widths, length)
        hits, firsts = suffix_dedup.repeated_windows(segments, widths, length)
        assert [h.tolist() for h in hits] == want
        windows = [segments[i][k : k + length] for i, f in enumerate(firsts) for k in f.tolist()]
        assert len(windows) == len(set(windows)) == classes
        assert sorted_.pop() == sum(map(len, set(segments)))
    assert suffix_dedup.repeated_windows([b"abcd"] * 3, [2] * 3, 3)[0][2].tolist() == [0, 1]


def test_a_round_of_components_is_written_once(spark, monkeypatch):
    """Components are those of a union-find, and the edges are the only thing that a round writes, once."""
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300, 300 + k) for k in range(40)] + [(400 + k, 401 + k) for k in range(30)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    written, rounds = [], []
    keep, digest = components.materialize, components._digest
    monkeypatch.setattr(components, "materialize", lambda df, tag: written.append(tag) or keep(df, tag))
    monkeypatch.setattr(components, "_digest", lambda df: rounds.append(1) or digest(df))
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert written == ["edges"] * len(rounds)


def test_sketches_in_one_shuffle(spark, capsys):
    """Sizes and bitmaps are those of the shingle hashes, from one grouping of the lines."""
    lines = ["short", "a line of some words and more", "abcdefghij" * 30, "日本語テキストの行です、長い行", "x"]
    units = spark.createDataFrame([((i, -i), x) for i, x in enumerate(lines)], "id struct<lk: long, lk2: long>, line string").select("id", fuzzy_lines._units("line").alias("u"), fuzzy_lines._hashes(fuzzy_lines._units("line")).alias("h"))
    got = fuzzy_lines._sketches(units.select("id", "u"))
    got.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    hashes = {r.id.lk: set(r.h) for r in units.collect()}
    for r in got.collect():
        want = [0] * fuzzy_lines.PARITY
        for h in hashes[r.id.lk]:
            want[(h >> 6) % fuzzy_lines.PARITY] ^= 1 << (h & 63)
        assert r.k == len(hashes[r.id.lk]) and [x & (1 << 64) - 1 for x in r.w] == want
    assert got.count() == len(lines)
