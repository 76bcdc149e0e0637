"""Anchors with many contents are compared by counting windows, and both ways give what brute force gives."""

import random

import pytest

from ferrule.llm import suffix


def near_copies(n=60, seed=5):
    """Copies of one passage with an edit each, so that one anchor has many contents."""
    r = random.Random(seed)
    base = "".join(r.choices("abcdefghij klm", k=900))
    out = []
    for _ in range(n):
        at = r.randrange(900)
        out.append("".join(r.choices("nopqrst", k=r.randint(0, 40))) + base[:at] + r.choice("XYZ") + base[at + 1 :])
    return out


def brute(docs, span=suffix.SPAN):
    seen = {}
    for d in docs:
        for i in range(len(d) - span + 1):
            seen[d[i : i + span]] = seen.get(d[i : i + span], 0) + 1
    out = []
    for d in docs:
        gone = bytearray(len(d))
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        out.append(sum(gone))
    return out


@pytest.mark.parametrize("most", [1, 3, suffix.GROUP])
@pytest.mark.parametrize("block", [2, suffix.BLOCK_ROWS])
def test_both_ways_of_comparing(spark, monkeypatch, most, block):
    monkeypatch.setattr(suffix, "BLOCK_ROWS", block)
    docs = near_copies()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = suffix.spans(df, most=most)
    keys = {suffix.keys_of(d.encode()): i for i, d in enumerate(docs)}
    got = [0] * len(docs)
    for r in found.collect():
        got[keys[r.t1, r.t2]] = sum(b - a for a, b in suffix.kept(docs[keys[r.t1, r.t2]].encode(), r.spans)[0])
    assert got == brute(docs)
