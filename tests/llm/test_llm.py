"""Training-data operators against brute force and on odd rows: nulls, empty and long texts, ties, repeats, no rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.llm import chat_format, decontamination, embedding_near_dedup, html_extraction, ngram_jaccard_join, quality_classifier, sentencepiece_codec, sharding, substring_dedup, url_filter

ODD = [None, "", " \n", "one", "one two three", "x " * 3000, "naïve café 你好 😀"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = "zz%d" % rng.randrange(10**6)
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [prose(rng, rng.randint(60, 300)) for _ in range(40)]
    hot = prose(rng, 120)
    many = [edited(rng, hot, rng.randint(0, 4)) for _ in range(60)] + [hot] * 20
    near = [edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(60)]
    shared = prose(rng, 55)
    passages = [prose(rng, 60) + "\n" + shared + " " + prose(rng, 70) for _ in range(30)]
    return [*base, *many, *near, *passages, *ODD, *ODD]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "null id", "en", "s")], "doc_id long, text string, lang string, source string").repartition(5)


def empty(spark, df):
    return spark.createDataFrame([], df.schema)


def test_a_cluster_names_its_checkpoint_folder():
    from shotloom.llm import _graph

    assert _graph.checkpoint_folder("spark://x", "hdfs://y") == _graph.checkpoint_folder("local[2]", "hdfs://y") == "hdfs://y"
    with pytest.raises(RuntimeError):
        _graph.checkpoint_folder("spark://x", None)


def test_jaccard_join(spark, docs, texts):
    s = [shingles(words(t)) for t in texts]
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = ngram_jaccard_join.ngram_jaccard_join(docs.withColumn("n", F.lit(1)).withColumn("node", F.lit(2)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect() if r.doc_id is not None}
    assert got == {i: (len(s[i]), find(i)) for i in range(len(s))}
    assert out.count() == docs.count()
    assert ngram_jaccard_join.ngram_jaccard_join(empty(spark, docs)).count() == 0
    kept = ngram_jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [i for i in range(len(s)) if find(i) == i]


@pytest.mark.skipif(not sentencepiece_codec.model_at_hand(), reason="needs the public tokenizer files")
def test_codec_matches_the_library(spark, docs, texts):
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    rng = random.Random(2)
    use = sentencepiece_codec.Codec()
    odd = ["".join(rng.choice("  ▁abcthe\n\t1é你😀<s>()=") for _ in range(rng.randint(0, 90))) for _ in range(500)]
    for t in [*odd, " " * 37, "=" * 3000, "".join(rng.choice("abthein") for _ in range(4000)), *(t or "" for t in texts)]:
        assert use.encode(t) == ref.encode(t)
        assert use.decode(use.encode(t)) == t.replace("▁", " ")
    v = sentencepiece_codec.Viterbi(use.p)
    long = " " + "".join(rng.choice("abthein") for _ in range(50_000))
    assert v.feed(long) + v.finish() == ref.encode(long[1:]) and v.kept < 1000
    assert use.decode([1, 2, -5, 10**6, 259]) is not None
    out = sentencepiece_codec.token_report(docs).collect()
    assert len(out) == docs.count() and all(r.same_text and len(r.ids) == r.n_tokens for r in out)
    clashing = docs.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(clashing))
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert sentencepiece_codec.token_report(empty(spark, docs)).count() == 0


def model_file(path, kind, pieces):
    """A model of random pieces with byte fallback, in the library's own format."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    proto = schema.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = kind, True
    proto.normalizer_spec.name, proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    for i, piece in enumerate(["<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256))]):
        proto.pieces.add(piece=piece, score=0, type=(2, 3, 3)[i] if i < 3 else 6)
    for piece, score in pieces:
        proto.pieces.add(piece=piece, score=score, type=1)
    path.write_bytes(proto.SerializeToString())
    return str(path)


@pytest.mark.parametrize("kind", [1, 2])
def test_random_models_against_the_library(tmp_path, kind):
    import sentencepiece

    rng = random.Random(kind)
    for k in range(12):
        made = {"".join(rng.choice("abcd") for _ in range(rng.choice([2, 2, 3, 4, 5]))) for _ in range(60)}
        made |= {"▁" + "".join(rng.choice("abcd") for _ in range(rng.randint(1, 3))) for _ in range(20)}
        made = sorted(made | set("▁abcd"), key=lambda x: (len(x) > 1, rng.random()))
        score = (lambda i: -float(i)) if kind == 2 else lambda i: -rng.uniform(1, 12)
        path = model_file(tmp_path / f"m{k}", kind, [(x, score(i)) for i, x in enumerate(made)])
        ref, use = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
        v = sentencepiece_codec.Viterbi(use.p)
        texts = ["".join(rng.choice("abcdabcdabcd  é") for _ in range(rng.choice([1, 5, 30, 200]))) for _ in range(150)]
        for t in [*texts, "".join(rng.choice("abcd") for _ in range(900))]:
            want, one, stream = ref.encode(t), use.encode(t), v.feed(" " + t) + v.finish()
            if kind == 2:
                assert one == want == stream
            for got in (one, stream):  # paths of equal score differ by rounding
                assert use.decode(got) == t
                assert sum(use.p.score.get(i, 0) for i in got) == pytest.approx(sum(use.p.score.get(i, 0) for i in want), abs=1e-2)
        assert v.kept < 1000


@pytest.mark.skipif(not sentencepiece_codec.model_at_hand(), reason="needs the public tokenizer files")
def test_codec_forgets_and_learns_again(monkeypatch):
    use = sentencepiece_codec.Codec()
    rng = random.Random(8)
    texts = [prose(rng, 40) for _ in range(40)] + ["é😀 " * 9, None, ""]
    whole = use.packed(texts)
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 50)
    monkeypatch.setattr(sentencepiece_codec, "AT_ONCE", 90)
    assert use.packed(texts) == whole == [use.packed([t])[0] for t in texts]
    use.forget()
    use.lattices.fits.clear()
    assert use.packed(texts) == whole


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(14, 50))) for i in range(30)] + [(90, "of the"), (91, ""), (92, None), (93, "alpha beta gamma delta")]
    texts = [edited(rng, rng.choice(items[:30])[1], rng.randint(0, 2)) for _ in range(80)]
    texts = [prose(rng, 20) + " " + t + " " + prose(rng, 9) for t in texts] + ["say OF the now", "Alpha  beta\ngamma delta", *ODD, prose(rng, 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit(5))
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for d, t in enumerate(texts):
        w = words(t)
        for item, text in items:
            v = words(text)
            n = len(v)
            own = collections.Counter(tuple(v[i : i + min(5, n)]) for i in range(max(1, n - 4))) if n else {}
            for i in range(len(w) - n + 1 if n else 0):
                win = collections.Counter(tuple(w[i + k : i + k + min(5, n)]) for k in range(max(1, n - 4)))
                shared = sum((win & own).values())
                if shared >= 0.75 * (2 * max(1, n - 4) - shared):
                    expected.add((d, item))
    out = decontamination.leaks(docs.withColumn("similarity", F.lit("clash")), bench.withColumn("doc_id", F.lit("clash")))
    assert {(r.doc_id, r.item_id) for r in out.collect()} == expected
    twice = decontamination.leaks(docs.union(docs), bench.union(spark.createDataFrame([(None, items[0][1]), (-1, items[0][1])], bench.schema)))
    assert {(r.doc_id, r.item_id) for r in twice.collect()} == expected | {(d, k) for d, i in expected if i == 0 for k in (None, -1)}
    assert decontamination.decontaminate(empty(spark, docs), bench).count() == 0 and decontamination.decontaminate(docs, empty(spark, bench)).count() == docs.count()
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in expected}
    assert decontamination.leaks(empty(spark, docs), bench).count() == 0 and decontamination.leaks(docs, empty(spark, bench)).count() == 0


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(14)
    items = [(i, prose(rng, rng.randint(5, 40))) for i in range(30)]
    texts = []
    for _, text in items:
        v = text.split()
        texts += [" ".join(v[a : len(v) - b]) for a, b in ((0, 1), (1, 0), (2, 2), (0, 9), (8, 0))]
        texts.append(" ".join([*v[: len(v) // 2], "zz", *v[len(v) // 2 + 2 :]]))
    expected = set()
    for d, t in enumerate(texts):
        w = words(t)
        for item, text in items:
            v = words(text)
            own = collections.Counter(tuple(v[i : i + 5]) for i in range(len(v) - 4))
            n = min(len(v), len(w))
            for i in range(len(w) - n + 1):
                win = collections.Counter(tuple(w[i + k : i + k + 5]) for k in range(n - 4))
                shared = sum((win & own).values())
                if shared and shared >= 0.75 * (sum(win.values()) + len(v) - 4 - shared):
                    expected.add((d, item, n))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_words) for r in decontamination.leaks(docs, bench).collect()} == expected
    assert {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()} == set(range(len(texts))) - {d for d, *_ in expected}


def test_repeated_passages_are_found_and_cut(spark, docs, texts):
    first, expected = {}, collections.defaultdict(set)
    for d, t in enumerate(texts):
        w = words(t)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) != d:
                expected[d] |= set(range(i, i + 50))
    found = collections.defaultdict(set)
    passages = spark.createDataFrame(substring_dedup.repeated_passages(docs).collect())
    for r in passages.collect():
        assert r.source_id < r.doc_id
        found[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    assert all(expected[d] <= found[d] for d in expected)
    assert not {d for d in range(40)} & set(found)  # the originals come first
    cut = {r.doc_id: r.text for r in substring_dedup.cut_repeats(docs, found=passages).collect()}
    assert substring_dedup.cut_repeats(docs).count() == docs.count()
    for d, t in enumerate(texts):
        assert words(cut[d]) == [x for i, x in enumerate(words(t)) if i not in found[d]]
        if d not in found:
            assert cut[d] == t
    assert substring_dedup.repeated_passages(empty(spark, docs)).count() == 0


def test_exact_passages_in_large_groups(spark):
    rng = random.Random(11)
    lines = [prose(rng, 45) for _ in range(12)]
    ends = [prose(rng, 8) for _ in range(200)]  # documents 200 to 259 go on like 0 to 59
    texts = [f"{prose(rng, 20)} {lines[(d % 200) % 12]} {ends[d] if d < 200 else ends[d - 200]} {prose(rng, 30)}" for d in range(260)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = collections.defaultdict(set)
    for r in substring_dedup.repeated_passages(docs).collect():
        found[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    assert all(set(range(20, 73)) <= found[d] for d in range(200, 260))
    assert not set(range(200)) & set(found)


def test_overlapping_passages_of_two_sources(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(80):
        w = prose(rng, 81).split()
        texts += [" ".join([prose(rng, 20), *w[15:66], prose(rng, 20)]), " ".join([prose(rng, 20), *w[30:], prose(rng, 20)]), " ".join(w)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = collections.defaultdict(set)
    for r in substring_dedup.repeated_passages(docs).collect():
        found[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    assert [d for d in range(2, len(texts), 3) if not set(range(15, 81)) <= found[d]] == []


def rows_of(found):
    return sorted((r.doc_id, r.source_id, r.first_word, r.n_words) for r in found.collect())


def test_edited_passages_in_large_groups_whatever_the_partitions(spark):
    rng = random.Random(15)
    passage = prose(rng, 120)
    texts = [" ".join([prose(rng, rng.randint(5, 60)), edited(rng, passage, rng.randint(1, 4)), prose(rng, rng.randint(5, 60))]) for _ in range(300)] + [prose(rng, 200) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("at", F.lit("x"))
    one = rows_of(substring_dedup.repeated_passages(docs.repartition(2)))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows_of(substring_dedup.repeated_passages(docs.repartition(9))) == one
        split = rows_of(substring_dedup.repeated_passages(docs.repartition(5), split=20))
        assert rows_of(substring_dedup.repeated_passages(docs.repartition(3), split=20)) == split
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    near = 0
    for found in (one, split):
        got = {d for d, *_ in found}
        assert got <= set(range(1, 300)) and all(s < d for d, s, *_ in found)
        for d in range(1, 300):  # whether some document before it is near enough to find
            near += d in got
        assert len(got) >= 0.99 * 299
        for d, s, a, n in found:  # each is near to its source
            part, whole = shingles(words(texts[d])[a : a + n]), shingles(words(texts[s]))
            assert len(part & whole) >= 0.7 * len(part)
    assert near >= 590


def test_repeats_in_long_runs(spark):
    line = "a b c d e f g " * 40
    texts = [line, "x " * 200, "y " + line, "x " * 120 + "z", line, None, "", "x " * 49]
    docs = spark.createDataFrame([*enumerate(texts), (2, texts[2]), (None, line)], "doc_id long, text string").repartition(3)
    found = collections.defaultdict(set)
    for d, s, a, n in rows_of(substring_dedup.repeated_passages(docs)):
        assert s < d
        found[d] |= set(range(a, a + n))
    assert set(found) == {2, 3, 4}
    assert found[4] == set(range(280)) and found[2] == set(range(1, 281)) and found[3] == set(range(120))


def test_compact_windows_are_cartesian_subtrees():
    rng = np.random.default_rng(1)
    h, row = rng.integers(1, 2**63, 400, dtype=np.uint64), np.repeat([0, 1, 2], [150, 30, 220])
    c, l, r = substring_dedup.compact_windows(h, row, 20)
    expected = set()
    for k in range(400):
        a, b = k, k
        while a and row[a - 1] == row[k] and h[a - 1] > h[k]:
            a -= 1
        while b < 399 and row[b + 1] == row[k] and h[b + 1] > h[k]:
            b += 1
        if b - a + 1 >= 20:
            expected.add((k, max(a, k - 19), min(b, k + 19)))
    assert set(zip(c.tolist(), l.tolist(), r.tolist(), strict=True)) == expected


def links_by_brute_force(x, rows, least=0.9):
    """vec_id -> (n_links, component_id) for rows (vec_id, position in x)."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= least
    ids, at = [i for i, _ in rows], [k for _, k in rows]
    near = near[np.ix_(at, at)]
    np.fill_diagonal(near, False)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(near), strict=True):
        p, q = find(ids[a]), find(ids[b])
        root[max(p, q)] = min(p, q)
    return {i: (int(n), find(i)) for i, n in zip(ids, near.sum(1), strict=True)}


@pytest.mark.parametrize("block", [4096, 70])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:40] + rng.normal(size=(40, 16)) * 0.15, np.repeat(base[:1], 25, 0), base[1:2] + rng.normal(size=(160, 16)) * 0.05])
    n = len(x)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    flat = [(n + 10 + i, v[:3].tolist()) for i, v in enumerate(x[:90])]  # another dimension
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [None] + [1.0] * 15), (n + 4, [float("nan")] * 16), (n + 5, [float("inf")] * 16), (n + 6, [1.0, 2.0])]
    df = spark.createDataFrame([*rows, *flat, *odd, (None, x[0].tolist())], "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("v", F.lit("x")).repartition(3)
    out = embedding_near_dedup.near_duplicates(df, block=block, per_centre=block // 3)
    assert out.count() == df.count()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    want = links_by_brute_force(x, [(i, i) for i in range(n)]) | links_by_brute_force(x[:90, :3], [(n + 10 + i, i) for i in range(90)])
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][0] for i in want) >= 0.995 * sum(w[0] for w in want.values())
    assert sum(got[i][1] != want[i][1] for i in want) <= 0.01 * len(want)
    assert all(got[i] == (0, i, True) for i, _ in odd) and got[None] == (0, None, True)
    assert embedding_near_dedup.audit_recall(df, out, every=5, block=100) >= 0.99
    assert embedding_near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_many_dimensions(spark):
    rows = [(i * 2 + k, [1.0 + 0.001 * k] + [2.0] * i) for i in range(1100) for k in (0, 1)]
    out = embedding_near_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.where("n_links = 1").count() == 2200
    assert out.where("component_id = vec_id - vec_id % 2").count() == 2200


def test_large_shards_are_cut_where_that_is_safe(spark):
    rng = np.random.default_rng(8)
    far = rng.normal(size=(400, 12))
    x = np.concatenate([far, far[:120] + rng.normal(size=(120, 12)) * 0.03])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()
    index = spark.createDataFrame([(i, v, [0], 1) for i, v in enumerate(u)], "node long, v array<double>, shards array<long>, copies long")
    cut = embedding_near_dedup._cut_shards(index, 12, 0.9, 150, 50).collect()
    assert len(cut) == len(x) and all(len(r.shards) == 3 and min(r.shards) > 0 for r in cut)
    of = {r.node: set(r.shards) for r in cut}
    assert np.mean([bool(of[i] & of[400 + i]) for i in range(120)]) > 0.97
    dense = (np.ones(12) + rng.normal(size=(400, 12)) * 0.1).tolist()
    index = spark.createDataFrame([(i, v, [0], 1) for i, v in enumerate(dense)], "node long, v array<double>, shards array<long>, copies long")
    assert all(r.shards == [0] for r in embedding_near_dedup._cut_shards(index, 12, 0.9, 150, 50).collect())
    out = embedding_near_dedup.near_duplicates(df, block=150, per_centre=10_000)
    assert embedding_near_dedup.audit_recall(df, out, every=1) >= 0.99


def test_url_rules_and_reputation(spark):
    urls = ["http://A.Example.NET/en/x", "https://example.net/de/", "http://x.org/fr/1?q=/fr/", "http://x.org?/fr/", "http://example.com/de/", None, "no scheme", "http://", "ftp://notnet/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    good = spark.createDataFrame([(2, 1), (3, 0), (None, 1), (5, None)], "page_id long, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, good).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][2:] == ("net/", "block") and got[2][2:] == ("org/fr/", "allow") and got[4][2:] == ("example.com/de/", "block")
    assert got[3][:3] == ("x.org", "", None) and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[8][2] is None
    assert len(got) == len(urls) and all(v[3] in ("allow", "block") for v in got.values())
    assert url_filter.url_filter(pages.limit(0), good).count() == 0
    twice = url_filter.url_filter(pages.union(pages).withColumn("host", F.lit("clash")).withColumn("n", F.lit(1)), good.withColumn("host", F.lit("clash")))
    assert twice.count() == 2 * len(urls) and {r.page_id: (r.host, r.path, r.rule) for r in twice.collect()} == {i: v[:3] for i, v in got.items()}
    hosts = ["a.b.example.co.uk", "www.example.com", "co.uk", "localhost", "10.0.0.1", "", "x.org"]
    found = spark.createDataFrame(list(enumerate(hosts)), "i int, host string").select("i", url_filter.domain_of(F.col("host")).alias("d")).collect()
    assert [r.d for r in sorted(found)] == ["example.co.uk", "example.com", "co.uk", "localhost", "10.0.0.1", "", "x.org"]


def test_reputation_shrinks_towards_the_domain(spark):
    made = [(i, f"http://good.site.com/{i}", 1) for i in range(60)] + [(100 + i, f"http://bad.site.net.au/{i}", 0) for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in made] + [(900, "http://new.site.com/"), (901, "http://new.site.net.au/")], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.url_filter(pages, spark.createDataFrame([(i, g) for i, _, g in made], "page_id long, good int")).collect()}
    assert got[0].verdict == "allow" and got[100].verdict == "block"
    assert got[901].bound < got[900].bound < got[0].bound


def shards_hold(got, rows):
    """Every row once with its size and digest, gapless slots, near equal bytes."""
    tell = lambda d, t: (-1 if d is None else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == sorted(tell(d, t) for d, t, *_ in rows)
    by = collections.defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    sizes, most = [sum(r.size for r in by[s]) for s in range(16)], max(r.size for r in got)
    assert all(abs(x - sum(sizes) / 16) <= most for x in sizes)


def test_shards(spark, docs):
    got = sharding.shard_rows(docs.withColumn("size", F.lit("clash")).withColumn("shard", F.lit(1)).withColumn("n", F.lit(1))).collect()
    shards_hold(got, docs.collect())
    assert sharding.shard_rows(docs.limit(0)).count() == 0
    assert [r.slot for r in sharding.shard_rows(docs.where("doc_id = 3").limit(1)).collect()] == [0]


def test_shards_tear_few_groups(spark):
    rng = random.Random(13)
    rows = [(i, "hot text " * 9) for i in range(400)] + [(None, "hot text " * 9)] * 300 + [(7, "seven")] * 500 + [(8, None)] * 200
    for k in range(1500):
        t = prose(rng, 12)
        rows += [(1000 + k, t), (9000 + k, t)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.shard_rows(df).collect()
    shards_hold(got, rows)
    text_of = {d: t for d, t in rows}
    where = collections.defaultdict(set)
    for r in got:
        if r.doc_id is not None and r.doc_id >= 1000:
            where[text_of[r.doc_id]].add(r.shard)
    assert sum(len(v) > 1 for v in where.values()) <= 15
    again = sharding.shard_rows(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def read_back(got, turns):
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1], t[2] or "", t[3] or ""))
        said = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chats_read_back(spark):
    own = "</s>[INST] ok [/INST]"
    turns = [(1, 0, "system", "be \\ brief <s>"), *((1, i, "user" if i % 2 else "assistant", f"text {i} " * 60) for i in range(1, 30)), (2, 0, "user", None), (2, 1, "assistant", own), (None, 0, "user", "x")]
    turns += [(3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 1, None, "[<\\>]"), (5, 0, "assistant", "long " * 60_000), (6, 2, "assistant", "same"), (6, 2, "assistant", "same"), (7, 0, "assistant", "é😀\n\n</s>\n<s>[user]\n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")).withColumn("formatted", F.lit(1)).repartition(3)
    for model in (None, chat_format.MODEL) if sentencepiece_codec.model_at_hand() else (None,):
        out = chat_format.chat_windows(df, model=model)
        got = {r.conv_id: r for r in chat_format.chat_digest(out).collect()}
        read_back(got, turns)
        assert got[1].n_windows > 1 and got[5].n_windows == 1
        assert chat_format.chat_windows(df.limit(0), model=model).count() == 0
    assert chat_format.chat_digest(chat_format.chat_windows(df.limit(0), model=None)).count() == 0


def test_chat_windows_keep_the_budget(spark):
    rng = random.Random(6)
    turns, system = [], {}
    for conv in range(40):
        if conv % 2:
            turns.append((conv, 0, "system", prose(rng, rng.choice([3, 100, 350]))))
            system[conv] = turns[-1][3]
        turns += [(conv, i, "user" if i % 2 else "assistant", prose(rng, rng.choice([1, 20, 100, 300, 600]))) for i in range(1, 25)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = chat_format.chat_windows(df, model=None)
    read_back({r.conv_id: r for r in chat_format.chat_digest(windows).collect()}, turns)
    some = 0
    for r in windows.collect():
        shown = chat_format.parse(r.formatted)
        assert r.n_tokens == len(r.formatted.split())
        if r.conv_id in system:
            assert shown[0] == ("system", system[r.conv_id])
        if r.n_tokens > 512:
            assert len(shown) == 1 + (r.conv_id in system) and r.n_repeated <= (r.conv_id in system)
        history = [len(chat_format.render([t], 0)[0].split()) for t in shown[: r.n_repeated] if t[0] != "system"]
        assert sum(history) <= 128
        some += bool(history)
    assert some > 10


def site_page(rng):
    """A page of other layouts than the training pages have, with the texts of its article in order."""
    made, said = [], iter(range(10**6))
    text = lambda lo, hi: f"w{next(said)} " + prose(rng, rng.randint(lo, hi))

    def own(tag, lo, hi, attributes=""):
        w = text(lo, hi).split()
        made.append(" ".join(w))
        i = rng.randrange(len(w)) if rng.random() < 0.4 else None
        if i is not None:
            j = rng.randint(i + 1, len(w))
            w[i], w[j - 1] = f"<a class=ref href='/r?a=1&b=2' title=\"a > b\">{w[i]}", w[j - 1] + "</a>"
        return f"<{tag}{attributes}>{' '.join(w)}</{tag}>"

    parts = [own("h1", 2, 8)]
    for _ in range(rng.randint(2, 9)):
        kind = rng.random()
        if kind < 0.6:
            parts.append(own("p", 5, 70, rng.choice(["", " class=lead", ' style="color:red"'])))
        elif kind < 0.7:
            parts.append(own("h3", 1, 5))
        elif kind < 0.8:
            parts.append("<ol>" + "".join(own("li", 2, 12) for _ in range(3)) + "</ol>")
        elif kind < 0.88:
            parts.append("<dl>" + "".join(own("dt", 1, 2) + own("dd", 4, 15) for _ in range(2)) + "</dl>")
        elif kind < 0.94:
            parts.append("<pre><code>" + (lambda t: (made.append(t), t)[1])(text(5, 20)) + "</code></pre>")
        else:
            parts.append(f"<blockquote>{own('p', 6, 30)}</blockquote>")
        if rng.random() < 0.1:
            parts.append(f"<div id=ad-{rng.randint(1, 9)} class='ad slot'>{text(2, 9)}</div>")
    head = f"<div id=top class=masthead><p>{text(1, 4)}</p></div><div class='main-menu nav' role=navigation>" + "".join(f"<a href=/{i}>{text(0, 1)}</a> | " for i in range(6)) + "</div>"
    side = f"<div class='col sidebar'><h4>{text(1, 2)}</h4><ol>" + "".join(f"<li><a href=/t{i}>{text(2, 6)}</a></li>" for i in range(5)) + "</ol></div>"
    talk = f"<div id=comments><h4>{text(1, 2)}</h4>" + "".join(f"<div class='comment depth-1'><b>{text(0, 0)}</b><p>{text(4, 40)}</p></div>" for _ in range(rng.randint(1, 6))) + "</div>"
    foot = f"<div class=footer><p>&copy; {text(3, 15)}</p><form><input name=m><button>{text(0, 1)}</button></form></div>"
    core = rng.choice(["<article class='post hentry'>{}</article>", "<main id=main><div>{}</div></main>", "<div class='entry-content clearfix'>{}</div>"]).format("".join(parts))
    cookie = f"<div class='cookie-consent'>{text(5, 20)} <button>OK</button></div>" if rng.random() < 0.4 else ""
    return f"<html><body>{cookie}{head}<div class=wrap>{core}{side if rng.random() < 0.6 else ''}</div>{talk if rng.random() < 0.5 else ''}{foot}</body></html>", made


def test_pages_of_other_layouts():
    model = html_extraction.train(html_extraction.labelled_pages())
    rng = random.Random(21)
    hit = wanted = found = 0
    for _ in range(300):
        page, texts = site_page(rng)
        got, want = collections.Counter(html_extraction.main_text(page, model).split("\n\n")), collections.Counter(texts)
        size = lambda c: sum(len(t) * n for t, n in c.items())
        hit, wanted, found = hit + size(got & want), wanted + size(want), found + size(got)
    print(f"precision {hit / found:.4f} recall {hit / wanted:.4f}")
    assert hit / found > 0.97 and hit / wanted > 0.97


def test_links_do_not_cost_a_paragraph():
    model = html_extraction.train(html_extraction.labelled_pages())
    link, nav = '<a href="/x">some link words here</a>', "<nav><a href=/>Home</a></nav>"
    shown = "some link words here"
    for inner, want in [
        (f"<h1>Head</h1><p>One {link} two.</p><p>Three {link} four.</p><p>Six {link} seven.</p>", ["Head", f"One {shown} two.", f"Three {shown} four.", f"Six {shown} seven."]),
        (f"<h1>Head</h1><p>{'word ' * 80}{link}</p><p>See <a href=/r>the full report</a> today.</p><p>{link}</p>", ["Head", "word " * 80 + shown, "See the full report today.", shown]),
        ("<h1>Head</h1><p>" + "word " * 40 + "</p><h2>Sources</h2><ul>" + "".join(f"<li><a href=/{i}>Source {i}</a></li>" for i in range(15)) + "</ul>", ["Head", ("word " * 40).strip(), "Sources", *(f"Source {i}" for i in range(15))]),
        ("<p>Formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here and some more words.</p>", ["Formula x=1 here and some more words."]),
        ("<p>Before it.</p><svg><path d=''><p>More text after the picture.</p>", ["Before it.", "More text after the picture."]),
    ]:
        assert html_extraction.main_text(f"{nav}<article>{inner}</article><footer>us</footer>", model) == "\n\n".join(want)


def test_hostile_pages_take_linear_time():
    import time

    model = html_extraction.train(html_extraction.labelled_pages(60))
    for part in ("<a ", "<div></p>", '<a href="', "<a href='x\" ", "<svg>", "<script>", "<", "<!--", "<ul><li>", "<span class=ad><li>", "</", "&amp", "<b></i>", "<td><tr>", "x<p>"):
        began = time.time()
        html_extraction.main_text(part * (1_000_000 // len(part)), model)
        assert time.time() - began < 30, part
    assert html_extraction.main_text("x " * 300_000, model).count("x") in (0, 300_000)


def test_marginals_sum_out_exactly():
    model = html_extraction.train(html_extraction.labelled_pages(60))
    nodes, _ = html_extraction.tree("<div><nav><a>x</a></nav><p>some words of text here</p><div class=ad>buy</div></div>")
    shown = html_extraction.seen(nodes)
    total, on = 0.0, [0.0] * len(nodes)
    for bits in range(1 << len(nodes)):
        s = [bits >> i & 1 for i in range(len(nodes))]
        e = model.root[s[0]]
        for i, n in enumerate(nodes):
            e += model.unary(shown[i])[s[i]]
            if i:
                e += (model.pair.get((n.kind, s[n.up])) or model.pair["", s[n.up]])[s[i]]
        p = np.exp(e)
        total += p
        on = [a + p * b for a, b in zip(on, s, strict=True)]
    assert np.allclose([a / total for a in on], html_extraction.marginals(nodes, model))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(9)
    good = [prose(rng, rng.randint(20, 80)) for _ in range(250)]
    bad = [" ".join(rng.choice(["$$$", "click", "%%%", "###", "buy"]) + rng.choice("!|#") for _ in range(rng.randint(20, 80))) for _ in range(250)]
    rows = [(i, t) for i, t in enumerate([*good, *bad])]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x"), rows[0]], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 250)) for i, _ in rows] + [(None, 1), (900, None)], "doc_id long, quality int")
    machine = quality_classifier.train(docs, labels)
    got = quality_classifier.score_quality(docs, machine).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert np.mean([r.predicted == int(r.doc_id < 250) for r in held]) > 0.95
    assert quality_classifier.keep_good(docs, machine).columns == docs.columns
    assert quality_classifier.score_quality(docs.limit(0), machine).count() == 0


def test_linear_time_identity():
    m = quality_classifier.fit(["a b c d", "e f! g", "a e", "q r s t"] * 8, np.array([1, 0, 1, 0] * 8, float))
    f = quality_classifier.features(quality_classifier.words(__import__("pyarrow").array(["a b e"])))
    row, col, x = m.rows(f)
    pairs = sum(m.factors[col[i]] @ m.factors[col[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert m.score(f)[0] == pytest.approx(1 / (1 + np.exp(-(m.bias + m.linear[col] @ x + pairs))))


def test_pipeline_stages_keep_columns(spark, tmp_path, docs, texts):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i % 7 != 3)) for i in range(140)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench = spark.createDataFrame([(1, texts[0]), (2, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, now = str(tmp_path), docs.withColumn("hash", F.lit("x")).withColumn("x", F.lit(1)).withColumn("at", F.lit(2))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = now.collect(), stage(spark, now, sf)
        assert after.columns == now.columns, name
        # each stage against its operator on the same rows
        after_rows = after.collect()
        ids = sorted(r.doc_id for r in after_rows if r.doc_id is not None)
        if name == "quality_classifier":
            good = quality_classifier.score_quality(now, quality_classifier.train(now, labels)).where("predicted = 1")
            assert ids == sorted(r.doc_id for r in good.collect() if r.doc_id is not None)
        elif name == "ngram_jaccard_join":
            joined = ngram_jaccard_join.ngram_jaccard_join(now).where("doc_id = component_id").select("doc_id").distinct()
            assert ids == sorted(r.doc_id for r in joined.collect())
        elif name == "substring_dedup":
            found = collections.defaultdict(set)
            for r in substring_dedup.repeated_passages(now).collect():
                found[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
            text = {r.doc_id: r.text for r in before}
            for r in after_rows:
                if r.doc_id is not None:
                    assert words(r.text) == [w for i, w in enumerate(words(text[r.doc_id])) if i not in found[r.doc_id]]
        else:
            gone = {r.doc_id for r in decontamination.leaks(now, bench).collect()}
            assert ids == sorted(r.doc_id for r in before if r.doc_id is not None and r.doc_id not in gone)
        now = spark.createDataFrame(after_rows, now.schema)
        kept.append(len(after_rows))
    out = corpus_pipeline.run(spark, sf).collect()
    assert all(r.doc_id != 0 for r in out) and sorted(map(str, (r.doc_id for r in out))) == sorted(str(r.doc_id) for r in now.collect())
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0
