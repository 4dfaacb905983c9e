"""Source divergence against brute force in whole numbers, and on odd rows."""

import collections
import random
import re

import pytest

from shotloom.llm import source_divergence as sd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10, top=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    count, docs, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(lower))
        groups[lang].add(source)
        count.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        v = len(kept)

        def p(n, total, v=v):
            return 1 + 1_000_000_000 * (n + 2) // (total + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        n = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        total = {s: sum(n[s].values()) for s in sources}
        q = {t: p(sum(n[s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum(f(p(n[s][t], total[s]), p(n[o][t], total[o])) for t in kept), o) for o in sources if o != s]
            terms = [(f(p(n[s][t], total[s]), q[t]), t) for t in kept if n[s][t] > 0 and p(n[s][t], total[s]) > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked[:most])]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, *r, "x", 5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int").repartition(4)
    return sorted(tuple(r) for r in sd.source_divergence(df, **more).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    vocabulary = ["the", "The", "of", "été", "ÉTÉ", "naïve", "日本", "x", "Ünder", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]]
    some = lambda n: " ".join(rng.choice(vocabulary[: rng.randint(2, len(vocabulary))]) for _ in range(n))
    out = [(some(rng.randint(0, 60)), rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", "é", None])) for _ in range(240)]
    out += [(None, "en", "silent"), ("", "en", "empty"), ("1 2 3 [] ~ \x00 @", "de", "signs"), ("rare words", "xx", "only"), ("rare words", "yy", "s1"), ("words", "yy", "s2"), ("the " * 5000, "en", "long"), (None, None, None)]
    return out + out[:20]


def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, least=1, top=3) == brute(rows, 1, 3)


def test_counts_handed_on_in_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(sd, "HELD", 50)
    monkeypatch.setattr(sd, "SLICE", 100)
    monkeypatch.setattr(sd, "SHARD", 70)
    assert run(spark, rows) == brute(rows)


def test_no_rows_and_no_kept_terms(spark):
    assert run(spark, []) == []
    bare = [("a b", "en", "s"), ("c", "en", "t"), (None, "de", "s")]
    assert run(spark, bare) == brute(bare) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
