"""N-gram Jaccard join by vertical partitioning.

The fingerprints of all shingles form the global order. It is cut into equal ranges, the
fragments; each document's set falls apart into one segment per fragment. A fragment counts the
sets that hold each of its n-grams and passes on only the segments of n-grams that two or more
different sets hold, so what moves afterwards follows the amount of repetition, not the corpus.

Two sets with 100 * |A & B| >= 75 * |A | B| share an n-gram in the prefixes of both, if n-grams
are ordered by (number of sets, fingerprint) and the prefix is a quarter of the set and one more.
Links come in two passes. The first deals sets out by small min-hashes of their shared n-grams and
compares each with a few sets of its run, the last ones and those that linked last: linear work that joins most copies. The second is exact: all
pairs in different components so far that share a prefix n-gram, with enough n-grams left from there on, are counted fragment by fragment,
the partial overlaps are summed per pair, and pairs at the threshold become edges too. Pairs inside
one component need no count, since the result is the component.

Equal sets are one node from the start, however many documents have them. For the components, a set's name is the smallest doc_id that has it, so
a component's root is its id. Sets are compared by
fingerprints of 40 bits beyond the fragment number (over 46 in all); equal sets are found by a 64-bit digest with the set's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import connected_components, durable, partitions
from ._text import distinct_per_row, mix, set_digest, shingles, slices, small_batches, words

LEADERS, ENOUGH, KEYS, BINS = 16, 2, 5, 24
FRAGMENT = 1 << 21  # shingles of a fragment, which one task loads
HELD = 1 << 19  # shingles that a task packs at once
_U = np.uint64
_LOW = _U((1 << 40) - 1)
_SETS = "node long, n int, toks binary, keys array<long>, prefix array<long>, bins array<int>"


def required(a, b, percent: int):
    """Smallest intersection with 100 * i >= percent * (a + b - i)."""
    return -((-percent * (a + b)) // (100 + percent))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to in slices(batch.column(1)):
            s = shingles(words(batch.column(1).slice(at, to - at)))
            h, _, first = distinct_per_row(s)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(set_digest(h, first).view(np.int64)), pa.array(np.diff(first).astype(np.int64))], names=["doc_id", "node", "n_shingles"])


def _pack(toks: np.ndarray) -> bytes:
    """The low 40 bits of each fingerprint, five bytes each."""
    return toks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(raw: bytes, high: int = 0) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8") | _U(high << 40)


def _cut(count: int):
    """Deals the distinct shingles of each set out to ``count`` ranges of the global order."""

    def pack(parts: list) -> pa.RecordBatch:
        frag, node, n, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(frag, kind="stable")  # within a fragment: by slice, set and fingerprint
        frag, node, n, h = frag[order], node[order], n[order], h[order]
        ends = np.searchsorted(frag, np.arange(count + 1))
        rows = []
        for f in range(count):
            a, b = ends[f], ends[f + 1]
            if a == b:
                continue
            runs = np.flatnonzero(np.concatenate(([True], node[a + 1 : b] != node[a : b - 1])))
            rows.append((f, node[a:b][runs].tobytes(), n[a:b][runs].astype(np.int32).tobytes(), np.diff(np.append(runs, b - a)).astype(np.int32).tobytes(), _pack(h[a:b])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _BLOCK, strict=True)], names=["part", "nodes", "sizes", "counts", "toks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for at, to in slices(batch.column(0)):
                h, _, first = distinct_per_row(shingles(words(batch.column(0).slice(at, to - at))))
                node, n = set_digest(h, first), np.diff(first)
                keep = np.zeros(len(node), bool)
                keep[np.unique(node, return_index=True)[1]] = True
                keep &= n > 0
                on = np.repeat(keep, n)
                who = np.repeat(np.arange(len(node)), n)[on]
                h = h[on]
                frag = (((h >> _U(40)) * _U(count)) >> _U(24)).astype(np.int32)
                parts.append((frag, node[who], n[who].astype(np.int32), h))
                held += len(h)
                if held >= HELD:
                    yield pack(parts)
                    parts, held = [], 0
        if parts:
            yield pack(parts)

    return run


_BLOCK = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _column(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def _shared(buckets: int):
    """One fragment: n-grams of two or more sets, with that number, dealt out again by set."""

    def run(key, table):
        frag = key[0].as_py()
        counts = _column(table, "counts", np.int32)
        node, n = np.repeat(_column(table, "nodes", np.uint64), counts), np.repeat(_column(table, "sizes", np.int32), counts)
        tok = _unpack(b"".join(table.column("toks").to_pylist()), frag)
        order = np.lexsort((node, tok))
        tok, node, n = tok[order], node[order], n[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])
        tok, node, n = tok[new], node[new], n[new]
        starts = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1]))) if len(tok) else np.zeros(0, np.int64)
        sets = np.diff(np.append(starts, len(tok)))
        df = np.repeat(sets, sets)
        on = df > 1
        tok, node, n, df = tok[on], node[on], n[on], df[on]
        part = (mix(node) % _U(buckets)).astype(np.int64)
        order = np.lexsort((tok, node, part))
        part, tok, node, n, df = part[order], tok[order], node[order], n[order], df[order]
        rows, ends = [], np.searchsorted(part, np.arange(buckets + 1))
        for p in range(buckets):
            a, b = ends[p], ends[p + 1]
            if a == b:
                continue
            runs = np.flatnonzero(np.concatenate(([True], node[a + 1 : b] != node[a : b - 1])))
            rows.append((p, frag, node[a:b][runs].tobytes(), n[a:b][runs].tobytes(), np.diff(np.append(runs, b - a)).astype(np.int32).tobytes(), _pack(tok[a:b]), df[a:b].astype(np.uint32).tobytes()))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=["part", "frag", "nodes", "sizes", "counts", "toks", "df"])

    return run


def _regroup(percent: int):
    """Whole sets again, of shared n-grams only: those that can still have a partner, with keys and prefix."""

    def run(key, table):
        counts = _column(table, "counts", np.int32)
        node, n = np.repeat(_column(table, "nodes", np.uint64), counts), np.repeat(_column(table, "sizes", np.int32), counts)
        df = _column(table, "df", np.uint32)
        tok = np.concatenate([_unpack(t, f) for t, f in zip(table.column("toks").to_pylist(), table.column("frag").to_pylist(), strict=True)])
        order = np.lexsort((tok, node))
        node, n, tok, df = node[order], n[order], tok[order], df[order]
        starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        salts = [mix(tok ^ _U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(KEYS)]
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(node)), strict=True):
            size, shared = int(n[a]), int(b - a)
            need = -(-percent * size // 100)
            if shared < need:
                continue
            t, rare = tok[a:b], np.argsort(df[a:b], kind="stable")
            left = size - need + 1 - (size - shared)
            out.append((np.int64(node[a : a + 1].view(np.int64)[0]), size, t.astype("<u8").tobytes(), [int(s[a:b].min().view(np.int64)) for s in salts], t[rare[:left]].astype(np.int64), np.bincount((t % _U(BINS)).astype(np.int64), minlength=BINS).astype(np.int32)))
        cols = zip(*out, strict=True) if out else [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True)], names=["node", "n", "toks", "keys", "prefix", "bins"])

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _leaders(percent: int):
    """Rows sorted by (key, n): links each set with leaders of its run, and makes it one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lead = None, []
        for batch in batches:
            a, b = [], []
            for key, n, node, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != at:
                    at, lead = key, []
                toks = np.frombuffer(raw, "<u8")
                met = []
                for x in reversed(lead):
                    if 100 * x[0] >= percent * n and x[1] != node and _common(toks, x[2]) >= required(n, x[0], percent):
                        met.append(x)
                        if len(met) == ENOUGH:
                            break
                for x in met:  # those that link move up and stay
                    lead = [y for y in lead if y is not x] + [x]
                a += [node] * len(met)
                b += [x[1] for x in met]
                if len(met) < ENOUGH:
                    lead = [*lead[1 - LEADERS :], (n, node, toks)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlaps of candidate pairs in one fragment."""
    for batch in batches:
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        got = [_common(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.int32())], names=["a", "b", "o"])


def _segments(parts: int, count: int):
    """Cuts sets of shared n-grams into ``parts`` segments, by fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = np.frombuffer(raw, "<u8")
                cut = np.searchsorted((t >> _U(40)).astype(np.int64) * parts // count, np.arange(parts + 1))
                rows += [(node, p, t[cut[p] : cut[p + 1]].tobytes()) for p in range(parts) if cut[p + 1] > cut[p]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["node", "part", "seg"])

    return run


def linked_sets(docs: DataFrame, nodes: DataFrame, percent: int = 75, segments: int = 2) -> DataFrame:
    """(node, root) for the shingle sets of ``docs.text`` that link with another set, by the names of ``nodes`` (node, least, n_shingles)."""
    spark = docs.sparkSession
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    count = min(1 << 22, max(partitions(spark, 64), total // FRAGMENT))
    name = nodes.select("node", "least")

    def named(edges: DataFrame) -> DataFrame:
        a, b = (name.select(F.col("node").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
        return edges.join(a, "a").join(b, "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))

    blocks = docs.select("text").mapInArrow(_cut(count), "part int, nodes binary, sizes binary, counts binary, toks binary")
    shared = blocks.groupBy("part").applyInArrow(_shared(count), "part int, frag int, nodes binary, sizes binary, counts binary, toks binary, df binary")
    sets = durable(shared.groupBy("part").applyInArrow(_regroup(percent), _SETS))
    runs = sets.select(F.explode("keys").alias("key"), "n", "node", "toks")
    edges = runs.repartitionByRange(partitions(spark), "key", "n", "node").sortWithinPartitions("key", "n", "node").mapInArrow(_leaders(percent), "a long, b long")
    first = connected_components(named(edges))
    roots = name.join(first.withColumnRenamed("node", "least"), "least").select("node", "root")
    grams = sets.join(name, "node").join(roots, "node", "left").select("node", "n", F.coalesce("root", "least").alias("comp"), F.expr("length(toks) div 8").alias("m"), F.posexplode("prefix").alias("at", "tok"))
    mixed = grams.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("tok")
    grams = grams.join(mixed, "tok", "left_semi").join(sets.select("node", "bins"), "node")
    x = grams.select("tok", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("bins").alias("ba"), (F.col("m") - F.col("at")).alias("ra"))
    y = grams.select("tok", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("bins").alias("bb"), (F.col("m") - F.col("at")).alias("rb"))
    # at its first common n-gram a pair has at most the n-grams from there on in common, and at most the lesser count in each bin
    common = " + ".join(f"least(ba[{i}], bb[{i}])" for i in range(BINS))
    pairs = x.join(y, "tok").where(f"ca < cb and {100 + percent} * least(ra, rb) >= {percent} * (na + nb) and {100 + percent} * ({common}) >= {percent} * (na + nb)").select("a", "na", "b", "nb").distinct()
    pairs = durable(pairs)
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    segs = sets.select("node", "toks").join(used, "node", "left_semi").mapInArrow(_segments(segments, count), "node long, part int, seg binary")
    overlap = (
        pairs.join(segs.select(F.col("node").alias("a"), "part", F.col("seg").alias("sa")), "a")
        .join(segs.select(F.col("node").alias("b"), "part", F.col("seg").alias("sb")), ["b", "part"])
        .select("a", "b", "sa", "sb")
        .mapInArrow(_partial, "a long, b long, o int")
        .groupBy("a", "b")
        .agg(F.sum("o").alias("o"))
    )
    more = overlap.join(pairs, ["a", "b"]).where(f"100 * o >= {percent} * (na + nb - o)").select("a", "b")
    return connected_components(named(more).union(first.select("node", "root")))


def ngram_jaccard_join(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Every document with the component of its word-5-gram set under Jaccard >= ``percent`` / 100.

    Returns doc_id, n_shingles (0 for a null text or one without words), component_id: the smallest doc_id reachable
    by links, the document's own if it has none. Further columns of ``docs`` are ignored. Rows that repeat come
    back as often; different texts of one doc_id are sets of their own, and share a component where it is the smallest id of both. Rows with a null doc_id link with nothing and have a null component_id. An empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = durable(own.mapInArrow(_members, "doc_id long, node long, n_shingles long"))
    nodes = durable(members.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles")), few=True)
    roots = linked_sets(own.where("doc_id is not null"), nodes, percent).select(F.col("node").alias("least"), "root")
    named = nodes.select("node", "least").join(roots, "least", "left").select("node", F.coalesce("root", "least").alias("component_id"))
    joined = members.join(named, "node", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, without those linked to a document of a smaller id.

    Of rows that share a doc_id the one with the least values, column by column, stays; rows with a null doc_id stay as they are, and so do
    empty and null texts, which link with nothing. An empty table stays empty.
    """
    away = ngram_jaccard_join(docs, percent).where("component_id < doc_id").select(F.col("doc_id").alias("__doc")).distinct()
    named = docs.where("doc_id is not null").join(away, docs["doc_id"].cast("long") == away["__doc"], "left_anti")
    repeated = named.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id")
    once = named.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    least = named.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return once.unionByName(least).unionByName(docs.where("doc_id is null"))
