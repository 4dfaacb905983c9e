"""Near passages by brute force, and ids with several texts."""

import random

import numpy as np

from shotloom.llm import substring_dedup as sd


def prose(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def test_texts_of_one_id_are_texts_of_their_own(spark):
    rng = random.Random(1)
    a, b, new = (" ".join(prose(rng, n)) for n in (120, 120, 30))
    rows = [(1, b), (1, a), (2, a), (3, b), (4, f"{new} {a}"), (1, a), (None, a), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, covered = [tuple(r) for r in sd.repeated_passages(docs).collect()], {}
    for doc_id, _, at, n in got:
        covered.setdefault(doc_id, set()).update(range(at, at + n))
    assert covered == {2: set(range(120)), 3: set(range(120)), 4: set(range(30, 150))} and {r[1] for r in got} <= {1, 2}
    cut = sorted((r.doc_id or 0, (r.text or "").strip()) for r in sd.cut_repeats(docs).collect())
    assert cut == sorted([(1, b), (1, a), (1, a), (2, ""), (3, ""), (4, new), (0, a), (5, "")])
    # a passage that only one of an id's texts has is cut from that one
    more = spark.createDataFrame([(1, a), (2, b), (2, f"{new} {a}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text.strip()) for r in sd.cut_repeats(more).collect()) == sorted([(1, a), (2, b), (2, new)])


def jaccard(x, y):
    s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y))
    return len(s & t) / len(s | t)


def test_near_passages_of_sixty_to_a_hundred_and_twenty_words(spark):
    rng = random.Random(5)
    rows, want = [], []
    for length in (60, 80, 120):
        for edits in (1, 2, 4):
            for _ in range(40):
                passage = prose(rng, length)
                copy = list(passage)
                for at in rng.sample(range(length), edits):
                    copy[at] = f"zz{rng.randrange(10**6)}"
                at = len(rows)
                rows.append((at, " ".join([*prose(rng, 40), *passage, *prose(rng, 40)])))
                rows.append((at + 1, " ".join([*prose(rng, 25), *copy, *prose(rng, 30)])))
                if jaccard(passage, copy) >= 0.75:
                    want.append((at + 1, at, length))
    found = {}
    for r in sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        found.setdefault((r.doc_id, r.source_id), []).append(r.n_words)
    assert set(found) <= {(2 * k + 1, 2 * k) for k in range(len(rows) // 2)}
    hit = [max(found.get((x, s), [0])) for x, s, _ in want]
    share = np.mean([n >= 0.7 * length for n, (_, _, length) in zip(hit, want, strict=True)])
    assert len(want) > 200 and share >= 0.98, share


def test_stretches_against_all_stretches():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, width = int(rng.integers(5, 60)), 10
        mark = rng.random(n) < rng.choice([0.7, 0.9, 1.0])
        place = np.cumsum(np.where(rng.random(n) < 0.03, 5, 1))
        begin, end = sd._dense(mark, place, width, 0.75)
        want = {}
        for a in range(n):
            for b in range(a + width, min(n, a + 2 * width) + 1):
                if place[b - 1] - place[a] == b - 1 - a and 7 * mark[a:b].sum() >= 6 * (b - a):
                    want[a] = b
        assert dict(zip(begin.tolist(), end.tolist(), strict=True)) == want
