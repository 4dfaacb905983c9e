"""Entities of a graph under one name: pairs that are alike, and a leader for each that came in.

In order of arrival an entity takes the leader with its name, else the most similar leader of a fitting type, else it becomes a leader. Whether one leads
depends only on earlier leaders among those of its name or alike, so all that have no undecided one before them are decided at once, round by round;
the result is that of going through them one by one. Entities come in stretches, each longer than the one before: those that the leaders so far take are not compared
with each other, so a dense crowd costs its leaders times its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import durable
from .vector_index import CELLS, _rows, _with, assigned, sampled_centres
from .vectors import _columns, _matrix

HOME, VISIT = 4096, 4096  # vectors of a cell, and of those that visit it, that one task compares
AT_ONCE = 1024  # rows that are compared with centres, or fill one batch of found pairs
FIRST, MORE = 8192, 4  # nodes of the first stretch, and how much longer each one is than the one before
ROUNDS = 200
LATER, BOTH, ANY = range(3)  # which pairs are given: a < b, a <> b, one of each b


def _items(items: DataFrame) -> DataFrame:
    kind = items.schema["vector"].dataType.simpleString()
    vector = F.col("vector").cast(kind if kind == "array<float>" else "array<double>")  # floats stay floats where rows are dealt out
    return items.where("vector is not null").select(F.col("scope").cast("string").alias("scope"), F.col("item_id").cast("long").alias("item_id"), F.col("type").cast("string").alias("type"), vector.alias("vector"))


def near_pairs(items: DataFrame, least: float, cells: int = 0) -> DataFrame:
    """(scope, a, b, score), a < b: items (scope, item_id, type, vector) of one scope at cosine ``least`` (above 0) or more, types equal or one of them null.

    Each vector has a home, the cell of its nearest centre, and visits every cell in which a vector may be that near to it: where the angle to the centre is no more than
    the cell's widest angle and that of ``least`` together. A pair meets in the home of its smaller id. There are no more cells than the largest scope has blocks of ``HOME``, so a
    vector that has to visit all is dealt out no more often than by comparing blocks with blocks. Vectors that are null or zero or of another dimension have no pairs.
    """
    return _near(_items(items), None, least, cells, LATER)


def _near(items: DataFrame, guests: DataFrame | None, least: float, cells: int, which: int) -> DataFrame:
    """(scope, a, b, score) as ``near_pairs``: a of ``items``, b of ``guests`` (None: the same); ids are those of one table."""
    schema = "scope string, a long, b long, score double"
    largest = 0 if cells else items.groupBy("scope").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    centres = sampled_centres(items, cells or min(CELLS, max(1, -(-largest // HOME))))
    if not len(centres):
        return items.sparkSession.createDataFrame([], schema)
    homes = durable(assigned(items, centres, "cell").where(F.col("cell") < len(centres)))
    wide = np.full(len(centres), -1.0)  # of a cell without vectors: nothing need visit it
    for r in homes.groupBy("cell").agg(F.min("near").alias("least")).collect():
        wide[r["cell"]] = np.arccos(np.clip(r["least"], -1, 1))
    reach = np.where(wide < 0, -1.0, wide + np.arccos(least) + 1e-6)
    dim = centres.shape[1]
    come = homes.drop("cell", "near") if guests is None else guests

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE)
                on, x = _rows(part, "vector", dim)
                i, j = np.nonzero(np.arccos(np.clip(x @ centres.T, -1, 1)) <= reach)
                for a in range(0, len(i), 8 * AT_ONCE):
                    out = part.take(pa.array(on[i[a : a + 8 * AT_ONCE]]))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(j[a : a + 8 * AT_ONCE].astype(np.int32))], names=[*out.schema.names, "cell"])

    visits = come.mapInArrow(visit, _with(come, "cell int"))
    at = ["scope", "cell"]
    m = homes.groupBy(*at).agg(F.ceil(F.count("*") / HOME).alias("m"))
    v = visits.groupBy(*at).agg(F.ceil(F.count("*") / VISIT).alias("v"))
    sizes = durable(m.join(v, at))
    slot = lambda n: F.pmod(F.xxhash64("item_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    left = homes.join(sizes, at).withColumn("i", slot("m")).withColumn("j", every("v")).select(*at, "i", "j", "item_id", "type", F.col("vector").alias("x"))
    right = visits.join(sizes, at).withColumn("j", slot("v")).withColumn("i", every("m")).select(*at, "i", "j", "item_id", "type", F.col("vector").alias("x"))

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["scope", "a", "b", "score"]
        found = [pa.RecordBatch.from_arrays([pa.nulls(0, t) for t in (pa.string(), pa.int64(), pa.int64(), pa.float64())], names=names)]
        if left.num_rows and right.num_rows:
            (a, x, _), (b, y, _) = _columns(left, "item_id", "x"), _columns(right, "item_id", "x")
            kinds, (s, t) = {None: -1}, ([], [])
            for out, side in ((s, left), (t, right)):
                out += [kinds.setdefault(k, len(kinds)) for k in side.column("type").to_pylist()]
            s, t = np.array(s), np.array(t)
            u = _matrix(x, np.arange(len(a)), dim)
            for k in range(0, len(b), AT_ONCE // 4):
                rows = np.arange(k, min(k + AT_ONCE // 4, len(b)))
                c = u @ _matrix(y, rows, dim).T
                fit = (s[:, None] == t[rows]) | (s[:, None] < 0) | (t[rows] < 0)
                fit &= a[:, None] != b[rows] if which == BOTH else a[:, None] < b[rows]
                fit &= np.round(c, 9) >= least
                if which == ANY:
                    j = np.flatnonzero(fit.any(0))
                    i = fit[:, j].argmax(0)
                else:
                    i, j = np.nonzero(fit)
                # a batch for each step: what a task holds is pairs of numbers, however many
                found.append(pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(i)), pa.array(a[i]), pa.array(b[rows][j]), pa.array(c[i, j])], names=names))
        return pa.Table.from_batches(found)

    keys = [*at, "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)


def _leaders(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(scope, norm, node) of those of ``nodes`` that lead, given the ``pairs`` among them; no other node comes before them."""
    open_nodes = nodes.select("scope", "norm", "node")
    # an edge from the later to the earlier of a pair
    edges = durable(pairs.select(F.col("b").alias("later"), F.col("a").alias("earlier")))
    leaders = None
    for _ in range(ROUNDS):
        first = F.min("node").over(Window.partitionBy("scope", "norm"))
        ready = open_nodes.withColumn("_first", first).where("node = _first").drop("_first").join(edges.select(F.col("later").alias("node")).distinct(), "node", "left_anti")
        ready = durable(ready.select("scope", "norm", "node"))
        leaders = ready if leaders is None else leaders.unionByName(ready)
        taken = edges.join(ready.select(F.col("node").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("node")).distinct()
        open_nodes = durable(open_nodes.join(ready.select("scope", "norm"), ["scope", "norm"], "left_anti").join(taken, "node", "left_anti"))
        if open_nodes.isEmpty():
            return durable(leaders)
        left = open_nodes.select(F.col("node"))
        edges = durable(edges.join(left.withColumnRenamed("node", "later"), "later", "left_semi").join(left.withColumnRenamed("node", "earlier"), "earlier", "left_semi"))
    raise RuntimeError("leaders did not settle")


def canonical(found: DataFrame, known: DataFrame | None = None, least: float = 0.85) -> DataFrame:
    """(scope, ord, leader, how) of each entity of ``found`` (scope, ord, norm, type, vector) with a name: ord of its leader and whether it is 'new', has its 'name' or is 'alike'.

    ``ord``, a long, is the order of arrival and tells entities apart. Those whose name is ``known`` (scope, norm) are 'known' and have no leader. Blank names go; a null scope is the blank one. Types fit if equal or
    one is null or blank; of leaders at the same similarity the first counts; a leader without a vector is met by name alone.
    """
    scope = F.coalesce(F.col("scope").cast("string"), F.lit("")).alias("scope")
    rows = found.where("norm is not null and norm <> ''").select(scope, "ord", "norm", F.when(F.col("type").cast("string") != "", F.col("type").cast("string")).alias("type"), "vector")
    met = None
    if known is not None:
        names = known.select(scope, "norm").distinct()
        met = rows.join(names, ["scope", "norm"], "left_semi").select("scope", "ord", F.lit(None).cast("long").alias("leader"), F.lit("known").alias("how"))
        rows = rows.join(names, ["scope", "norm"], "left_anti")
    # entities alike in all are one node: only the first can lead
    same = ["scope", "norm", "type", "vector"]
    rows = rows.withColumn("digest", F.sha2(F.to_json(F.struct(*same)), 256))
    nodes = durable(rows.groupBy("digest", *same).agg(F.min("ord").alias("node")))
    item = lambda rows: _items(rows.select("scope", F.col("node").alias("item_id"), "type", "vector"))
    # stretch by stretch: what came first is decided, and what its leaders take away never meets anything else
    open_nodes, leaders, size = nodes, None, FIRST
    while n := open_nodes.count():
        if n <= size * 5 // 4:
            now, rest = open_nodes, None
        else:
            last = open_nodes.agg(F.percentile_approx("node", size / n).alias("last")).first()["last"]
            now, rest = open_nodes.where(F.col("node") <= last), open_nodes.where(F.col("node") > last)
        new = _leaders(now, _near(item(now), None, least, 0, LATER))
        leaders = new if leaders is None else leaders.unionByName(new)
        if rest is None:
            break
        own = durable(nodes.join(new.select("node"), "node", "left_semi"))
        rest = rest.join(own.select("scope", "norm"), ["scope", "norm"], "left_anti")
        taken = _near(item(own), item(rest), least, 0, ANY).select(F.col("b").alias("node")).distinct()
        open_nodes, size = durable(rest.join(taken, "node", "left_anti")), size * MORE
    if leaders is None:
        leaders = nodes.select("scope", "norm", "node")
    each = rows.select("digest", "scope", "norm", "ord").join(nodes.select("digest", "node"), "digest")
    own = leaders.select("scope", "norm", F.col("node").alias("named"))
    # only entities before the leader of their name, if there is one, need one that is alike
    asking = nodes.join(own, ["scope", "norm"], "left").where("named is null or node < named").drop("named")
    near = _near(item(nodes.join(leaders.select("node"), "node", "left_semi")), item(asking), least, 0, BOTH).select(F.col("b").alias("node"), F.col("a").alias("leader"), "score")
    # the leaders alike to a node are no more alike to each other than ``least``, so they are few
    near = near.groupBy("node").agg(F.collect_list(F.struct(F.round(-F.col("score"), 9).alias("away"), "leader")).alias("near"))
    rows = each.join(own, ["scope", "norm"], "left").join(near, "node", "left")
    best = F.array_min(F.filter("near", lambda s: s["leader"] < F.col("ord")))["leader"]
    by_name = F.col("named") <= F.col("ord")
    rows = rows.select("scope", "ord", F.when(by_name, F.col("named")).otherwise(best).alias("leader"), F.when(F.col("named") == F.col("ord"), "new").when(by_name, "name").otherwise("alike").alias("how"))
    return rows if met is None else rows.unionByName(met)
