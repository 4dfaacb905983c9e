"""Alike pairs and canonical entities against going through them one by one."""

import random

import numpy as np
import pytest

from shotloom.operators import entities


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(a @ b / n), 9) if n else 0.0


def fits(s, t):
    return s is None or t is None or s == t


@pytest.fixture(scope="module")
def made():
    rng, np_rng = random.Random(3), np.random.default_rng(3)
    centres = np_rng.normal(size=(14, 6))
    rows = []
    for i in range(220):
        v = (centres[rng.randrange(14)] + rng.choice([0, 0.1, 0.4]) * np_rng.normal(size=6)).tolist()
        rows.append((rng.choice(["x", "x", "x", "y", None]), i * 3, f"n{rng.randrange(70)}", rng.choice(["a", "b", "", None]), v))
    again = [(s, 1000 + k, *rest) for k, (s, _, *rest) in enumerate(rng.sample(rows, 60))]
    hot = [("x", 2000 + k, "hot", "a", rows[0][4]) for k in range(40)]
    odd = [("x", 3000, "", "a", rows[0][4]), ("x", 3001, None, "a", rows[0][4]), ("x", 3002, "none", "a", None), ("x", 3003, "none", "b", None), ("x", 3004, "zero", "a", [0.0] * 6), ("x", 3005, "short", "a", [1.0]), ("x", 3006, "known", "a", rows[0][4])]
    return rows + again + hot + odd


SCHEMA = "scope string, ord long, norm string, type string, vector array<double>"


@pytest.mark.parametrize(("least", "cells"), [(0.85, 0), (0.85, 1), (0.97, 12), (0.3, 5)])
def test_pairs_against_all_pairs(spark, made, least, cells, monkeypatch):
    monkeypatch.setattr(entities, "HOME", 40)
    monkeypatch.setattr(entities, "VISIT", 70)
    rows = [(s or "", i, t or None, v) for s, i, _, t, v in made]
    df = spark.createDataFrame(rows, "scope string, item_id long, type string, vector array<double>").repartition(4)
    got = sorted((r.a, r.b, r.score) for r in entities.near_pairs(df, least, cells).collect())
    usable = [r for r in rows if r[3] is not None and len(r[3]) == 6 and any(r[3])]
    want = sorted((min(p[1], q[1]), max(p[1], q[1]), cosine(p[3], q[3])) for k, p in enumerate(usable) for q in usable[:k] if p[0] == q[0] and fits(p[2], q[2]) and cosine(p[3], q[3]) >= least)
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(want) > 100 and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-8)


def one_by_one(rows, known, least):
    out, leaders = [], {}
    for scope, i, norm, kind, v in sorted(rows, key=lambda r: r[1]):
        scope, kind = scope or "", kind or None
        if not norm:
            continue
        if (scope, norm) in known:
            out.append((scope, i, None, "known"))
            continue
        led = leaders.setdefault(scope, {})
        best, score = None, 0.0
        for name, (j, t, w) in led.items():
            if fits(kind, t) and v is not None and w is not None and len(v) == len(w) and cosine(v, w) > score:
                best, score = j, cosine(v, w)
        if norm in led:
            out.append((scope, i, led[norm][0], "name"))
        elif best is not None and score >= least:
            out.append((scope, i, best, "alike"))
        else:
            led[norm] = (i, kind, v)
            out.append((scope, i, i, "new"))
    return sorted(out)


@pytest.mark.parametrize("least", [0.85, 0.6, 0.99])
def test_leaders_are_those_of_going_one_by_one(spark, made, least):
    df = spark.createDataFrame(made, SCHEMA).repartition(5)
    known = spark.createDataFrame([("x", "known"), ("y", "n3"), (None, "n4"), ("x", "n5"), ("x", "n5")], "scope string, norm string")
    got = sorted((r.scope, r.ord, r.leader, r.how) for r in entities.canonical(df, known, least).collect())
    want = one_by_one(made, {("x", "known"), ("y", "n3"), ("", "n4"), ("x", "n5")}, least)
    assert got == want and {"new", "name", "alike", "known"} == {r[3] for r in want}


def test_chains_settle_and_none_is_none(spark):
    # each is alike to the next only: every other one leads
    turn = [(None, i, f"n{i}", None, [float(np.cos(i * 0.5)), float(np.sin(i * 0.5))]) for i in range(12)]
    got = sorted((r.ord, r.leader) for r in entities.canonical(spark.createDataFrame(turn, SCHEMA), least=0.85).collect())
    assert got == [(r[1], r[2]) for r in one_by_one(turn, set(), 0.85)] and len({x[1] for x in got}) == 6
    assert entities.canonical(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("first", [7, 40])
def test_stretches_change_nothing(spark, made, first, monkeypatch):
    monkeypatch.setattr(entities, "FIRST", first, raising=False)
    monkeypatch.setattr(entities, "MORE", 2, raising=False)
    df = spark.createDataFrame(made, SCHEMA).repartition(3)
    got = sorted((r.scope, r.ord, r.leader, r.how) for r in entities.canonical(df, None, 0.85).collect())
    assert got == one_by_one(made, set(), 0.85)


def test_vectors_that_visit_all_cells_are_dealt_out_once(spark, monkeypatch):
    cells, real = [], entities.sampled_centres
    monkeypatch.setattr(entities, "sampled_centres", lambda *a: cells.append(len(found := real(*a))) or found)
    x = np.random.default_rng(5).normal(size=(1500, 64))
    df = spark.createDataFrame([("x", i, None, v.tolist()) for i, v in enumerate(x)], "scope string, item_id long, type string, vector array<double>")
    c = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    # at 0.25 nearly each vector reaches each cell
    assert entities.near_pairs(df, 0.25).count() == int((np.triu(c, 1).round(9) >= 0.25).sum()) and cells == [1]


def test_a_crowd_has_no_pairs_beside_its_leaders(spark, monkeypatch):
    monkeypatch.setattr(entities, "FIRST", 50, raising=False)
    most, real = [0], entities.durable

    def durable(df):
        out = real(df)
        if {"a", "b"} <= set(out.columns) or {"later", "earlier"} <= set(out.columns):
            most.append(out.count())
        return out

    monkeypatch.setattr(entities, "durable", durable)
    x = np.random.default_rng(6)
    rows = [("x", i, f"n{i}", None, (np.eye(8)[i % 3] + 0.01 * x.normal(size=8)).tolist()) for i in range(600)]
    got = sorted((r.ord, r.leader) for r in entities.canonical(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(i, i % 3) for i in range(600)] and max(most) < 50 * 50
