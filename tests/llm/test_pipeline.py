from collections import Counter, defaultdict

import corpus_pipeline
from lodestone.llm import langid, mixing
from lodestone.llm.common import materialise
from tests.llm.test_jaccard import brute
from tests.llm.test_lines import distance


def first_lines(texts, k=2, near_from=5):
    """{id: text} with the first line of each class, by brute force; None if none is left."""
    place = {}
    for key in sorted(texts):
        for i, line in enumerate(texts[key].split("\n")):
            if line.strip(" "):
                place.setdefault(line, (key, i))
    parent = {x: x for x in place}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_length = defaultdict(list)
    for x in place:
        if len(x) >= near_from:
            by_length[len(x)].append(x)
    for n in by_length:
        for a in by_length[n]:
            for m in range(n, n + k + 1):
                for b in by_length.get(m, ()):
                    if a != b and sum(abs(a.count(c) - b.count(c)) for c in "etaonri") <= 2 * k and distance(a, b) <= k:
                        x, y = sorted((root(a), root(b)), key=place.get)
                        parent[y] = x
    out = {}
    for key, text in texts.items():
        rows = text.split("\n")
        kept = [r for i, r in enumerate(rows) if not r.strip(" ") or place[root(r)] == (key, i)]
        if any(r.strip(" ") for r in kept) or not any(r.strip(" ") for r in rows):
            out[key] = "\n".join(kept)
    return out


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    docs = materialise(docs.unionByName(spark.createDataFrame([(900001, None, "en", "src1", 0), (900002, "12 34", "en", "src1", 5)], docs.schema)), "test")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, sf_dir), "test")
        seen.append((docs, out))
        docs = out
    texts = [({r.doc_id: r.text for r in a.collect()}, b.collect()) for a, b in seen[:4]]
    assert all(b.columns == a.columns for a, b in seen[:4])
    before, after = texts[0]
    assert {r.doc_id: r.text for r in after} == {k: v for k, v in before.items() if k < 900001}
    before, after = texts[1]
    assert {r.doc_id: r.text for r in after} == first_lines(before) and all(r.n_chars == len(r.text) for r in after)
    before, after = texts[2]
    assert sorted(r.doc_id for r in after) == sorted({c for c, _ in brute(before).values()})
    before, after = texts[3]
    times = Counter(r.doc_id for r in after)
    found = mixing.mix(seen[3][0], "doc_id", "source", mixing.F.regexp_count("text", mixing.F.lit(mixing.WORD)), "text").collect()
    assert times == Counter({r.doc_id: r.copies for r in found if r.copies})  # each id once here
    pieces = docs.collect()
    per_doc = Counter()
    for r in pieces:
        per_doc[r.doc_id] += r.length
    totals = {r.doc_id: r.doc_tokens for r in pieces}
    assert all(per_doc[k] == times[k] * totals[k] for k in times)


def test_rejects_only_what_is_no_language():
    parser = langid.CrossParser({"en": ["the quick brown fox jumps over the lazy dog and runs"], "de": ["der schnelle braune fuchs springt"]})
    assert parser.predict(["the dog runs", "§§ 12", "жфшщ ыъэ цчю йцк"])[0][:2] == ["en", "und"]
    assert parser.predict(["жфшщ ыъэ цчю йцк"])[3][0] > langid.FOREIGN > parser.predict(["the dog runs over the fox"])[3][0]


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "test")
        assert docs.count() == 0


def test_near_duplicates_by_id_and_text(spark, sf_dir):
    """Repeated and null ids, repeated rows, long texts, and columns with clashing names."""
    words = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(3, words), (5, "quite another text of its own"), (5, words), (5, "quite another text of its own"), (None, words + " more"), (None, "a text without an id"), (None, "a text without an id"), (6, None), (6, None), (7, ""), (8, long), (9, long + " y")]
    docs = materialise(spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, root int"), "test")
    found = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert found.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:20]) for r in found.collect()) == sorted([(0, "a text without an id"), (3, words[:20]), (5, "quite another text o"), (6, ""), (6, ""), (7, ""), (8, long[:20])])
