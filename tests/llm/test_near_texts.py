"""The pipeline's near-dedup against all pairs' Jaccard similarity."""

import random

import pytest

P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from sheafline.llm import setjoin, shingle_join, simhash  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_components(texts):
    sets = {i: brute_set(t) for i, t in texts.items()}
    root, linked = {i: i for i in sets}, []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and likeness(sets[i], sets[j]) >= 0.8:
                linked.append((i, j))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}, linked


def edited_texts():
    """Copies with 0 to 8 changed words, short and empty texts, and a common passage in unlike texts."""
    random.seed(11)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(random.choices(words, k=30))
    out = [None, "", " \n", "a b", "A  b", "one two three four five six seven eight nine"]
    for n in (8, 20, 60, 150, 300):
        for _ in range(10):
            base = random.choices(words, k=n)
            for changes in (0, 1, 2, 3, 5, 8):
                t = list(base)
                for _ in range(changes):
                    t[random.randrange(n)] = random.choice(words)
                out.append(" ".join(t))
    out += [" ".join(random.choices(words, k=15)) + " " + passage for _ in range(30)]
    random.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("hot", [1, 256])
def test_all_near_texts_are_found(spark, monkeypatch, hot):
    monkeypatch.setattr(setjoin, "HOT", hot)
    texts = edited_texts()
    want, linked = brute_components(texts)
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in texts.items()], DOCS)
    got = {r.doc_id: r.component_id for r in shingle_join.near_texts(docs).collect()}
    assert sum(got[i] == got[j] for i, j in linked) == len(linked) > 100  # recall 1
    assert got == want
    fp = {i: simhash.fingerprint_of(t, 5) for i, t in texts.items()}
    assert sum((fp[i] ^ fp[j]).bit_count() > 3 for i, j in linked) > 20  # what radius 3 doesn't see


def test_stage_drops_near_copies(spark):
    random.seed(3)
    base = [f"x{random.randrange(5000)}" for _ in range(300)]
    near = list(base)
    for k in (40, 120, 200, 280):
        near[k] = "changed"
    a, b = " ".join(base), " ".join(near)
    assert 0.8 <= likeness(brute_set(a), brute_set(b)) < 0.95 and (simhash.fingerprint_of(a, 5) ^ simhash.fingerprint_of(b, 5)).bit_count() > 3
    rows = [(1, a), (2, b), (3, "else"), (None, a), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    left = pipeline.keep_one_of_each(spark, docs, "")
    assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect()), key=str) == [1, 3, 5, None]
    assert pipeline.keep_one_of_each(spark, docs.limit(0), "").count() == 0


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, _ = brute_components({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in shingle_join.near_texts(docs).collect()} == want
