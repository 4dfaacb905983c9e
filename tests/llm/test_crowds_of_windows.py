"""Windows of one minimum that neither the first of their context nor a neighbour is near to."""

import random

import numpy as np

from shotloom.llm import substring_dedup as sd


def prose(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def covered(found):
    out = {}
    for r in found.collect():
        assert r.source_id < r.doc_id
        out.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    return out


def documents(spark):
    """300 documents share a line too short to count and go on in their own way; 100 more repeat line and end of one of them, with an edit."""
    rng = random.Random(21)
    line, ends = prose(rng, 42), [prose(rng, 14) for _ in range(300)]
    texts = [[*prose(rng, 12), *line, *end, *prose(rng, 12)] for end in ends]
    for d in range(100):
        texts.append([*prose(rng, 12), *line[:20], f"zz{d}", *line[21:], *ends[(d * 7) % 300], *prose(rng, 12)])
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")


def test_near_passages_in_a_crowd_are_all_found(spark):
    docs = documents(spark)
    found = covered(sd.repeated_passages(docs.repartition(3)))
    assert not set(range(300)) & set(found)
    missed = [d for d in range(300, 400) if len(found.get(d, set()) & set(range(12, 68))) < 50]
    assert missed == [], len(missed)


def test_a_crowd_in_blocks_gives_the_same_words(spark):
    docs = documents(spark).where("doc_id % 3 > 0 or doc_id >= 300")
    own = docs.select("doc_id", "text")
    assert covered(sd._passages(own.repartition(5), 46, sd.SPLIT, block=60)) == covered(sd._passages(own, 46, sd.SPLIT))


def test_repeats_against_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(30):
        base, m, width = rng.integers(0, 10**6, 60), 40, 20
        rows = []
        for _ in range(m):
            row = base[rng.integers(0, 15) : rng.integers(40, 60)].copy() if rng.random() < 0.7 else rng.integers(0, 10**6, 45)
            cut = rng.integers(0, len(row))
            row[cut : cut + rng.integers(0, 9)] = rng.integers(0, 10**6)
            rows.append(row.astype(np.uint32))
        size, begin = np.array([len(r) for r in rows]), rng.integers(0, 50, m)
        got, want = {}, {}
        doc = np.sort(rng.integers(0, 30, m))
        for x, s, a, b in sd._repeats(doc, np.zeros(m, int), begin, size, np.concatenate(rows), [None] * m, width):
            assert s < x
            got.setdefault(x, set()).update(range(a, b + 1))
        line = [(begin[i] + np.arange(size[i]), rows[i]) for i in range(m)]
        for i in range(m):
            for j in range(i):
                if doc[j] < doc[i]:
                    for a, b in sd.repeated(line[i], line[j], width):
                        want.setdefault(int(doc[i]), set()).update(range(a, b + 1))
        assert got == want


def test_windows_of_a_crowd_meet_few_others_where_the_first_ones_have_all(monkeypatch):
    rng, m = np.random.default_rng(5), 300
    base, rows, reached = rng.integers(0, 10**6, 60), [], []
    for w in range(m):
        rows.append(base.astype(np.uint32))
        rows[-1][30] = 2 * 10**6 + w
    plain = sd._reached
    monkeypatch.setattr(sd, "_reached", lambda mark, *rest: (reached.append(len(mark)), plain(mark, *rest))[1])
    got = {x for x, *_ in sd._repeats(np.arange(m), np.zeros(m, int), np.zeros(m, int), np.full(m, 60), np.concatenate(rows), [None] * m, 46)}
    assert got == set(range(1, m))
    assert sum(reached) < 20 * m
