import zlib

import numpy as np
import pytest

from lodestone.llm import langid


def parse(text, training):
    """Phrases by brute force: the longest substrings of the training text, one after the other; an unknown character by itself."""
    n = i = 0
    while i < len(text):
        m = 1
        while i + m < len(text) and text[i : i + m + 1] in training and text[i] in training:
            m += 1
        n, i = n + 1, i + m
    return n


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("stretch, at_once", [(512, 1 << 20), (7, 1 << 20), (16, 100)])
def test_phrases_equal_brute_force(monkeypatch, seed, stretch, at_once):
    """Also where texts are cut into stretches, and long ones are parsed in turns."""
    monkeypatch.setattr(langid, "STRETCH", stretch)
    monkeypatch.setattr(langid, "AT_ONCE", at_once)
    rng = np.random.default_rng(seed)
    word = lambda k, n: "".join(rng.choice(list("abcde"[:k] + " "), n))
    samples = {"x": [word(2, 200)], "y": [word(3, 150), word(2, 50)]}
    texts = [word(4, int(n)) + "zq"[: n % 3] for n in rng.integers(0, 300, 12)] + ["", "a" * 500, "abab" * 200, "§" * 50 + "ab" * 60]
    parser = langid.CrossParser(samples)
    folded = [langid.letters(t) for t in texts]
    found = parser.phrases(folded)
    for i, name in enumerate(parser.languages):
        training = "".join("".join(map(chr, langid.letters(t))) + " " for t in samples[name])
        for j, t in enumerate(folded):
            t = "".join(map(chr, t))
            assert found[i, j] == (parse(t, training) if t else 0)


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = langid.op3_langid(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    rows = [(1, "the cat sat on the mat and the dog", "en"), (3, "der hund und die katze auf der matte", "de"), (4, None, "en"), (5, "", "de"), (6, "123 !!", None), (7, "the dog " * 20000, None), (None, "die matte", "de"), (7, "the dog " * 20000, None)]
    df = spark.createDataFrame([(i, t, lang, 9.0) for i, t, lang in rows], "doc_id long, text string, lang string, score double")
    learned = langid.learn(df)
    assert sorted(learned) == ["de", "en"]
    found = langid.identify(df, "text", learned).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and by[7].lang_pred == "en" and by[None].lang_pred == "de"
    assert langid.identify(df.limit(0), "text", learned).count() == 0
    assert {r.lang_pred for r in langid.identify(df, "text", {}).collect()} == {"und"}


def test_every_symbol_counts():
    """An alphabet of thousands: what was learned is parsed in few phrases, and a text of the same language isn't foreign."""
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 3000, 2))) for _ in range(3000)]
    text = lambda n: "".join(words[int(i)] for i in 3000 * rng.random(n) ** 4)
    texts = [text(250) for _ in range(40)]
    parser = langid.CrossParser({"zh": texts, "en": ["the quick brown fox jumps over the lazy dog"] * 3})
    names, _, rates, excess = parser.predict([texts[3], text(400), "一丁" + "the dog jumps over the fox", "жфшщ"])
    assert names[:2] == ["zh", "zh"] and rates[0] < 0.01 and max(excess[:2]) <= langid.FOREIGN < excess[3]


def test_whole_texts_are_sampled(spark):
    """Texts on both sides of the size that shorter ones are preferred to; never a part of a text."""
    rows = [(i, f"text{i} " * n, "en") for i, n in enumerate([10, 200, 5000, 30])] + [(9, "nur ein langer text " * 3000, "de")]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("doc_id <> 99"))
    whole = {r[1] for r in rows}
    assert set(learned) == {"de", "en"} and all(t in whole for v in learned.values() for t in v)
    assert len(learned["de"]) == 1 and sum(map(len, learned["en"])) <= langid.TRAIN_CHARS


def test_labels_of_long_texts_only(spark):
    """Two hundred labels whose texts all pass the sample's characters: one whole text of each is learned."""
    rows = [(f"l{i:03}", f"{'ab' * (langid.TRAIN_CHARS // 2)} {chr(97 + j) * 9}") for i in range(200) for j in range(2)]
    found = langid.sample(spark.createDataFrame(rows, "lang string, text string"), "text", "lang")
    assert len(found) == 200 and all(len(v) == 1 and len(v[0]) > langid.TRAIN_CHARS for v in found.values())
