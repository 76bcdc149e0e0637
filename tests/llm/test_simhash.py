"""Fingerprints and components against brute force over all pairs; chunks of keys change nothing; odd rows."""

import random
import re
from itertools import combinations

import pytest
import xxhash

from ferrule.llm import simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def plain_fingerprint(text, n):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(n), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def corpus():
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(3000)]
    texts = [None, "", " \n", "One", "one", "one two", "A b c"]
    for size in (8, 25, 60, 90, 200, 700):
        for _ in range(5):
            base = r.choices(words, k=size)
            texts += [" ".join(base)] * r.choice((1, 3))
            for _ in range(4):
                near = list(base)
                for _ in range(r.randint(1, max(1, size // 40))):
                    near[r.randrange(size)] = r.choice(words)
                texts.append(" ".join(near).upper() if r.random() < 0.2 else "  ".join(near))
    base = r.choices(words, k=400)  # one large group of near copies
    for i in range(60):
        near = list(base)
        near[i * 6] = "changed"
        texts.append(" ".join(near))
    r.shuffle(texts)
    return texts


TEXTS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4).cache()


def test_whole_against_brute_force(docs):
    want = [plain_fingerprint(t, 3) for t in TEXTS]
    comp = grouped(len(TEXTS), lambda a, b: (want[a] ^ want[b]).bit_count() <= 3)
    for chunk in (1024, 4):
        got = {r.doc_id: r for r in simhash.near_duplicates(docs, shingle=3, chunk=chunk).collect()}
        assert [got[i].fp & (2**64 - 1) for i in range(len(TEXTS))] == want
        assert [got[i].component_id for i in range(len(TEXTS))] == comp


def test_similarity_against_brute_force(docs):
    sets = [set(shingles(t, 5)) for t in TEXTS]
    same = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] or sets[b] else 1
    found = []
    for chunk in (1024, 8):
        rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, similarity=0.8, chunk=chunk).collect()}
        found.append([rows[i] for i in range(len(TEXTS))])
    assert found[0] == found[1]
    surely, hardly = grouped(len(TEXTS), lambda a, b: same(a, b) >= 0.87), grouped(len(TEXTS), lambda a, b: same(a, b) >= 0.62)
    got = found[0]
    for a, b in combinations(range(len(TEXTS)), 2):
        if surely[a] == surely[b]:
            assert got[a] == got[b]
        if got[a] == got[b]:
            assert hardly[a] == hardly[b]


def test_odd_tables(spark):
    schema = "fp string, node long, doc_id long, text string, k int"
    rows = [("x", 1, None, "one two three four five six", 1), ("x", 1, 7, "one two three four five six", 1), ("y", 2, 7, "one two three four five six", 1), ("z", 3, 9, None, 2), ("z", 3, 8, "", 2)]
    for similarity in (None, 0.8):
        got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, schema), similarity=similarity).collect())
        assert got == [(0, 7), (7, 7), (7, 7), (8, 8), (9, 8)]
        assert simhash.near_duplicates(spark.createDataFrame([], schema), similarity=similarity).collect() == []


def test_a_very_long_text():
    text = " ".join(map(str, range(150_000)))
    assert simhash.fingerprint(text, 3) == plain_fingerprint(text, 3)


def test_pairs_are_verified_by_their_shingles(spark):
    """Pairs just above and just below 0.8: those above are linked, none below is."""
    r = random.Random(8)
    rows, want = [], []
    for pair in range(300):
        base = ["".join(r.choices("abcdefghij", k=8)) for _ in range(204)]  # 200 shingles; each far change breaks five
        near, breaks = list(base), r.choice((2, 4, 5, 6))
        for i in range(breaks):
            near[10 + i * 30] = f"new{pair}x{i}"
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(near))]
        a, b = (set(shingles(t, 5)) for _, t in rows[-2:])
        want.append(len(a & b) / len(a | b) >= 0.8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df, shingle=5, similarity=0.8).collect()}
    linked = [got[2 * p] == got[2 * p + 1] for p in range(300)]
    assert not any(x and not w for x, w in zip(linked, want)), "linked below 0.8"
    assert sum(w and not x for x, w in zip(linked, want)) <= 1, "lost at 0.8 or above"
