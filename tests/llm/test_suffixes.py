"""Removal of repeated strings against a dictionary of all of them."""

import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import suffixes

N = suffixes.LENGTH


def brute(rows):
    """Rows of (id, text): the first of equal rows comes first, of one id the smaller hash (given by the caller's order)."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data, gone = (text or "").encode(), None
        gone = np.zeros(len(data) + 1, bool)
        for x in range(len(data) - N + 1):
            s = data[x : x + N]
            if s in seen:
                gone[x : x + N] = True
            seen.add(s)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        out.append((i, len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, k int, tie string, ctx double").repartition(3)
    out = suffixes.remove_repeats(df, "doc_id", "text")
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def words(r, n, vocabulary):
    return " ".join(r.choice(vocabulary) for _ in range(n))


def corpus(seed):
    """Passages at many places, copies, near copies, periodic texts, texts of fewer bytes than a string, letters of several bytes."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "über", "日本", "and", "x", "stone", "lode", "rain"]
    passages = [words(r, r.randrange(15, 60), vocabulary) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [words(r, r.randrange(0, 40), vocabulary)]
        for _ in range(r.randrange(3)):
            parts += [r.choice(passages), words(r, r.randrange(0, 12), vocabulary)]
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(120 + i, rows[i][1][:70] + "!" + rows[i][1][70:]) for i in range(8)]
    rows += [(200, "a" * 700), (201, "a" * 150 + "b" + "a" * 150), (202, "ab" * 300), (203, "a" * 99), (204, "a" * 100), (205, ""), (206, None), (None, passages[0] * 2), (207, "é" * 120), (208, rows[3][1]), (208, rows[3][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpora(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows)


def test_crowded_seeds_are_divided(spark, monkeypatch):
    """With a bound of two contexts nearly every seed is divided, down to single windows."""
    monkeypatch.setattr(suffixes, "CROWD", 2)
    rows = [r for r in corpus(3) if r[0] is None or r[0] < 40 or r[0] >= 200]
    assert found(spark, rows) == brute(rows)


def test_line_among_unlike_surroundings(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", 20)
    r = random.Random(4)
    line = "All rights are reserved by the owner of this page, who may be reached at the address that is given below it in small print. "
    rows = [(i, words(r, 12, [f"w{j}" for j in range(500)]) + line + words(r, 12, [f"w{j}" for j in range(500)])) for i in range(150)]
    assert found(spark, rows) == brute(rows)


def test_very_long_text(spark):
    """Longer than a piece, with a repetition across pieces."""
    r = random.Random(6)
    long = words(r, 70_000, [f"w{j}" for j in range(3000)])
    assert len(long) > suffixes.PIECE + 1000
    rows = [(1, long + long[suffixes.PIECE - 400 : suffixes.PIECE + 400]), (2, long[suffixes.PIECE - 150 : suffixes.PIECE + 150])]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_texts_of_one_id(spark):
    """Two texts of one id: one of them is the earlier, whichever, and the other loses what they share."""
    r = random.Random(8)
    shared = "".join(r.choice("abcdefgh") for _ in range(300))
    out = found(spark, [(1, shared + " one"), (1, shared + " other"), (1, shared + " one")])
    # of the copies one is wholly gone; the space and the o that both go on with are shared too
    assert sorted(r[2] for r in out) == [0, 302, 304]


def test_equal_suffixes_sort():
    """Classes of the sort are those of a dictionary, for strings that agree in their first bytes only and in nearly all."""
    r = random.Random(9)
    base = [bytes(r.choice(b"ab") for _ in range(N)) for _ in range(6)]
    strings = [s for b in base for s in (b, b, b[:30] + b"x" + b[31:], b[:-1] + b"z", b[:-1] + b"y", b[:-1] + b"z")] * 2
    data = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
    at = np.arange(len(strings)) * N
    group = np.arange(len(strings)) % 2
    classes = {}
    for i, s in enumerate(strings):
        classes.setdefault((s, i % 2), []).append(i)
    got = []
    for who, number in suffixes.equal_suffixes(data, at, group):
        got += [sorted(who[number == n].tolist()) for n in np.unique(number)]
    assert sorted(got) == sorted(c for c in classes.values() if len(c) > 1)
