import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import packing


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeéÉßthsN's\"'!-<|> \n\t\x1c\x85\xa0ª½7²ÿ…Σ"), max_size=60))
def test_cached_ids_are_the_librarys(text):
    whole = Tokenizer.from_file(packing.vocabulary()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.word_bpe(packing.vocabulary())(text), "<u4").tolist() == whole


def test_words_asked_for_lately_stay_known(monkeypatch):
    """More words than the cache takes: those in use aren't tokenised again when it is full."""
    monkeypatch.setattr(packing._Chunks, "MOST", 8)
    known, asked = packing._Chunks(packing.vocabulary()), []
    model = known.model
    known.model = type("Counted", (), {"tokenize": lambda self, word: asked.append(word) or model.tokenize(word)})()
    whole = Tokenizer.from_file(packing.vocabulary())
    for i in range(60):
        for chunk in ("the", "\x01\x7f", f"w{chr(97 + i % 26)}{chr(97 + i // 26)},"):
            assert np.frombuffer(known[chunk], "<u4").tolist() == whole.encode(chunk, add_special_tokens=False).ids
    assert asked.count("the") == 1 and max(map(len, (known, known.old, known.words, known.old_words))) <= 8


def holds(rows, documents, window):
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(documents)
    for key, text in documents.items():
        ids, at = ids_of(tokenizer, text), 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(total, 1)


def test_pieces_cover_every_id_once(spark, sf_dir):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert holds(packing.op8_packing(spark, sf_dir).collect(), documents, packing.WINDOW) < 0.01


def test_odd_rows(spark):
    documents = {1: None, 2: "", 3: "the " * 9000, 4: "a <|endoftext|> b", None: "x", 5: "the " * 2047, 6: "日本 Σ"}
    df = spark.createDataFrame([(k, v, 0, "s") for k, v in documents.items()], "doc_id long, text string, start int, sequence_id string")
    rows = packing.pack(df, "doc_id", "text", packing.word_bpe(packing.vocabulary())).collect()
    assert holds(rows, documents, packing.WINDOW) == 0
    none = packing.pack(df.limit(0), "doc_id", "text", packing.word_bpe(packing.vocabulary()))
    assert none.count() == 0
    twice = packing.pack(df.where("doc_id = 2").unionAll(df.where("doc_id = 2")), "doc_id", "text", packing.word_bpe(packing.vocabulary()))
    assert twice.count() == 2


@pytest.mark.parametrize("seed", range(5))
def test_levels_are_chosen_by_least_sum_of_squares(seed):
    rng, window, closed = np.random.default_rng(seed), 40, []
    packer = packing.SumOfSquares(window, closed.append)
    for i in range(300):
        size = int(rng.integers(1, 30))
        before = packer.count.copy()
        options = {}
        for h in [0, *np.flatnonzero(before[1:]) + 1]:
            if h + size <= window:
                after = before.copy()
                after[h] -= h > 0
                after[h + size] += h + size < window
                options[int(h)] = int((after**2).sum())
        packer.add(i, bytes(4 * size))
        assert int((packer.count**2).sum()) == min(options.values())
    # what is left: every id once, in full windows but for powers of two at the end
    placed = 300 - sum(1 for w in closed for _ in w)
    before = len(closed)
    packer.finish(0)
    sizes = [sum(len(p[2]) // 4 for p in w) for w in closed[before:]]
    assert all(n == window or n & (n - 1) == 0 for n in sizes) and sum(n < window for n in sizes) <= 6 and placed >= 0
    seen = defaultdict(list)
    for w in closed:
        for document, start, ids in w:
            seen[document].append((start, len(ids) // 4))
    assert sorted(seen) == list(range(300))
    for parts in seen.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n


def test_leftovers_go_where_the_sum_of_squares_falls_most():
    closed = []
    packer = packing.SumOfSquares(40, closed.append)
    for i, size in enumerate([30, 30, 30, 25, 3]):
        packer.count[size] += 1
        packer.open.setdefault(size, []).append([(i, 0, bytes(4 * size))])
    packer.finish(0)
    # 3 (the emptiest) joins a 30, as two levels of one window are better than one of three; 25 is dissolved next
    assert [(p[0], len(p[2]) // 4) for p in closed[0]] == [(1, 30), (3, 10)] and sum(len(p[2]) for w in closed for p in w) == 4 * 118


def test_ids_of_every_latin_1_character():
    """Control characters have ids as well: alone, between letters, after white space and doubled."""
    encode, whole = packing.word_bpe(packing.vocabulary()), Tokenizer.from_file(packing.vocabulary())
    for c in map(chr, range(256)):
        for text in (c, f"a{c}b", f"x {c}[0m red", f"{c}{c} {c}1"):
            assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
