"""Substring dedup by compact windows.

Tokens are 5-word shingles. For each of ``HASHES`` hash functions, the Cartesian tree over a text's token hashes
has one node per token; the node's subtree [l, r] is the set of all passages in which that token is the
minimum. Only subtrees of at least ``LEAST_WORDS`` words matter, and these are the runs of equal values
in the sliding minimum (as far as passages of the least length around the token reach), so a text of n words gives about 2n / ``LEAST_WORDS`` compact windows for each function.

Windows meet by minimum, in the order (minimum, context, digest, document): the digest is that of all tokens of a window, the context two tokens after
the minimum, or before it for every other function. Which windows meet depends on this order alone, not on how the rows are dealt.

- Windows of one digest are the same word for word: those of larger documents are repeated passages of the smallest one's, which alone goes on.
- Up to ``ALL`` windows of a minimum all meet. Two windows join if their intervals around the minimum have a passage of the least length in common.
  Pairs with a context in common come first; the others count only where what they can share reaches beyond each passage found so far.
- In larger groups (crowds) each window meets the first of its context. Then every window with tokens outside the passages found so far is
  compared with all earlier ones that have such a token: those with enough tokens in common for a stretch that reaches one are verified, until no
  earlier window has anything to add. No pair is left out, though none is verified that could only repeat what is known. A crowd is dealt out in
  blocks of about ``BLOCK`` windows, every two of which meet in a task of their own: what a task holds is bounded, and a crowd of m windows is moved m / ``BLOCK`` times.

Pairs of documents are verified: their tokens near the windows are compared, and stretches of at least
``LEAST_WORDS`` words that are made of stretches of that to twice that length with 6 of 7 tokens from the other document, and whose Jaccard
similarity with the passage opposite reaches 0.75, are repeated passages of the later document.

Rows of one id with different texts are different texts to all of this; where there are such, all texts get numbers in the order of their ids.

A minimum with more than ``SPLIT`` windows (by a sample of documents, or a thousandth of the documents if that is more) is dealt out by document first, so that
the windows of each digest become one for each part before they meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import durable, let_go, partitions
from ._text import SHINGLE, Words, _Powers, mix, release, shingles, slices, small_batches, words

LEAST_WORDS, HASHES, SIMILARITY, SEGMENT, SLACK, ALL = 50, 4, 0.75, 64, 4, 4
SPLIT, SAMPLED, BLOCK = 50_000, 16, 16_384
_U = np.uint64
_SALT = 0x9E3779B97F4A7C15
# windows move as few words: key is the context (24 bits) and the digest (40), spot the place (34), what lies before and after (14 each), first function (1)
_WINDOWS = "hash long, key long, doc long, spot long"
# x and s are documents (s the minimum where the kind is CROWD), places the minimum's in both (32 bits each), what the kind (2 bits) and what lies before and after
_MET = "x long, s long, places long, what long"
SAME, NEAR, LATER, CROWD = range(4)  # kinds: same word for word, pair, pair of no common context, window of a crowd
_FOUND = "doc_id long, source_id long, first_word long, n_words long"


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) for every i that leaves room, by doubling."""
    span = 1
    while 2 * span <= width:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def compact_windows(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r): h[c] is the (leftmost) minimum of h[l:r + 1], as far as it stays so in the row and within ``width`` of c."""
    none = np.zeros(0, np.int64)
    if len(h) < width:
        return none, none, none
    bits = _U(max(24, len(h).bit_length()))
    low = sliding_minimum(((h >> bits) << bits) | np.arange(len(h), dtype=_U), width)
    whole = np.flatnonzero(row[: len(h) - width + 1] == row[width - 1 :])
    if not len(whole):
        return none, none, none
    c = (low[whole] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    ends = np.append(starts[1:], len(c)) - 1
    return c[starts], whole[starts], whole[ends] + width - 1


def _digests(h: np.ndarray, begin: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Fingerprints of h[begin:past]."""
    up, down = _Powers.upto(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(h * up[:-1], dtype=_U)))
        return mix((total[past] - total[begin]) * down[begin] + (past - begin).astype(_U) * _U(_SALT))


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for a, b in slices(batch.column(1)):
                s = shingles(words(batch.column(1).slice(a, b - a)))
                parts = []
                for k in range(HASHES):
                    h = mix(s.hash ^ _U((k + 1) * _SALT % (1 << 64)))
                    c, l, r = compact_windows(h, s.row, width)
                    l, r = np.maximum(l, c - width + 1), np.minimum(r, c + width - 1)
                    # a token that recurs at once has one window, from the first to the last
                    _, new, which = np.unique(h[c] ^ mix((s.row[c] << 32 | s.word[c] // width).astype(_U)), return_index=True, return_inverse=True)
                    past = np.zeros(len(new), np.int64)
                    np.maximum.at(past, which, r + 1)
                    c, l = c[new], l[new]
                    near, far = (np.clip(c + (d if k % 2 else -d), l, past - 1) for d in (SHINGLE, 3 * SHINGLE))
                    context = ((s.hash[near] >> _U(52)) << _U(12)) | (s.hash[far] >> _U(52))
                    key = (context << _U(40)) | (_digests(s.hash, l, past) >> _U(24))
                    spot = (s.word[c] << 29) | ((c - l) << 15) | ((past - 1 - c) << 1) | (k == 0)
                    parts.append([h[c].view(np.int64), key.view(np.int64), ids[a:b][s.row[c]], spot.astype(np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=_ORDER)

    return run


def _met(kind: int, x, xat, s, sat, lo, hi) -> list[np.ndarray]:
    return [x, s, (xat << 32) | sat, kind | (lo << 2) | (hi << 16)]


def _spot(spot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, tokens before, tokens after, whether of the first function)."""
    return spot >> 29, (spot >> 15) & 0x3FFF, (spot >> 1) & 0x3FFF, (spot & 1).astype(bool)


def _unpacked(met: DataFrame) -> DataFrame:
    return met.selectExpr("x", "s", "cast(shiftright(places, 32) as int) as xat", "cast(places & 4294967295 as int) as sat", "cast(what & 3 as int) as kind", "cast(shiftright(what, 2) & 16383 as int) as lo", "cast(shiftright(what, 16) as int) as hi")


def _meet(width: int):
    """What the windows of sorted groups have to do with each other (``_MET``), batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(i)) for i in range(4)]
            held = 0
            if carry is not None:
                held = len(carry[0])
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            h, key, doc, spot = cols
            at, lo, hi, first = _spot(spot)
            change = lambda x: np.concatenate(([True], x[1:] != x[:-1]))
            top = change(h)
            context = top | change(key >> 40)
            leads = top | change(key)
            own = np.maximum.accumulate(np.where(leads, np.arange(len(h)), 0))
            out = []
            same = np.flatnonzero((own < np.arange(len(h))) & (np.arange(len(h)) >= held) & first & (doc[own] != doc))
            out.append(_met(SAME, doc[same], at[same], doc[own[same]], at[own[same]], lo[same], hi[same]))
            # from here on one window of each digest
            lead = np.flatnonzero(leads)
            n, fresh = len(lead), lead >= held
            places = np.arange(n)
            begin, mine = (np.maximum.accumulate(np.where(new[lead], places, 0)) for new in (top, context))
            rank = places - begin
            best = np.where(mine < places, mine, begin)
            met = [(places, best, NEAR)]
            for d in range(1, ALL):
                i = places[(rank >= d) & (rank < ALL)]
                met.append((i, i - d, LATER))
            for i, j, kind in met:
                on = fresh[i] & (doc[lead[i]] != doc[lead[j]])
                if kind == LATER:
                    on &= j != best[i]
                i, j = lead[i[on]], lead[j[on]]
                i, j = np.where(doc[i] > doc[j], i, j), np.where(doc[i] > doc[j], j, i)
                left, right = np.minimum(lo[i], lo[j]), np.minimum(hi[i], hi[j])
                on = left + right + 1 + SLACK >= width
                i, j = i[on], j[on]
                out.append(_met(kind, doc[i], at[i], doc[j], at[j], left[on], right[on]))
            over = places[(rank == ALL) & fresh]  # the group turns out to be large: its first windows too
            some = lead[np.concatenate([places[(rank >= ALL) & fresh], *(begin[over] + d for d in range(ALL))])]
            out.append(_met(CROWD, doc[some], at[some], h[some], at[some], lo[some], hi[some]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["x", "s", "places", "what"])
            keep = lead[np.unique([*range(begin[-1], min(begin[-1] + ALL, n)), mine[-1], n - 1])]
            carry = [c[keep] for c in cols]

    return run


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted windows, each with the first one of its digest in the part (``_LED``)."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(4)]
        held = 0
        if carry is not None:
            held, cols = 1, [np.concatenate(x) for x in zip(carry, cols, strict=True)]
        h, key, doc, spot = cols
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])))
        own = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        yield pa.RecordBatch.from_arrays([pa.array(c[held:]) for c in (*cols, doc[own], spot[own], own == np.arange(len(h)))], names=[*_ORDER, "s", "sspot", "leads"])
        carry = [c[own[-1] : own[-1] + 1] for c in cols]


_ORDER = ["hash", "key", "doc", "spot"]
_LED = _WINDOWS + ", s long, sspot long, leads boolean"


def _pairs(own: DataFrame, count: int, width: int, split: int) -> DataFrame:
    """``_MET`` rows of all windows, written to the checkpoint folder."""
    spark = own.sparkSession
    windows = own.mapInArrow(_windows(width), _WINDOWS)
    many = max(split, count // 1000)
    sample = own.where(F.expr(f"pmod(xxhash64(doc_id, 'part'), {SAMPLED}) = 0")) if split >= SAMPLED else own
    large = sample.mapInArrow(_windows(width), _WINDOWS).groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") * (SAMPLED if split >= SAMPLED else 1) > many)
    large = durable(large.select("hash", F.expr(f"cast(n * {SAMPLED} div {many} + 1 as int)").alias("parts")), few=True)  # at most the windows of a thousand documents
    rest, met = windows, None
    if large.count():
        led = windows.join(F.broadcast(large), "hash").withColumn("part", F.expr("pmod(xxhash64(doc, 'part of a minimum'), parts)"))
        led = led.repartition(partitions(spark), "hash", "part").sortWithinPartitions("hash", "part", *_ORDER[1:]).select(*_ORDER)
        led = durable(led.mapInArrow(_leaders, _LED))
        same = led.where("not leads and spot & 1 = 1 and doc <> s")
        met = same.selectExpr("doc as x", "s", "shiftleft(shiftright(spot, 29), 32) | shiftright(sspot, 29) as places", f"{SAME} | shiftleft(shiftright(spot, 15) & 16383, 2) | shiftleft(shiftright(spot, 1) & 16383, 16) as what")
        rest = windows.join(F.broadcast(large), "hash", "left_anti").select(*_ORDER).unionByName(led.where("leads").select(*_ORDER))
    dealt = rest.repartition(partitions(spark), "hash").sortWithinPartitions(*_ORDER).mapInArrow(_meet(width), _MET)
    return durable(dealt if met is None else dealt.unionByName(met), few=True)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each document in segments, three bytes each: enough to tell the tokens of one passage apart."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for a, b in slices(batch.column(1)):
            s = shingles(words(batch.column(1).slice(a, b - a)))
            raw, rows = s.hash.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3], []
            for k in range(b - a):
                rows += [(ids[a + k], g, raw[at : min(at + SEGMENT, s.first[k + 1])].tobytes()) for g, at in enumerate(range(s.first[k], s.first[k + 1], SEGMENT))]
            kinds = (pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)], names=["doc", "seg", "toks"])


def _tokens(raw: bytes) -> np.ndarray:
    three = np.frombuffer(raw, np.uint8)
    return three[::3] | three[1::3].astype(np.uint32) << 8 | three[2::3].astype(np.uint32) << 16


def _alike(xt, sp, st, begin: int, end: int, least: float) -> bool:
    """Whether tokens ``xt`` are near enough to those at places ``begin`` to ``end`` of the other line."""
    mine, theirs = set(xt.tolist()), set(st[sp.searchsorted(begin) : sp.searchsorted(end, "right")].tolist())
    both = len(mine & theirs)
    return both >= least * (len(mine) + len(theirs) - both)


def _middle(x: np.ndarray) -> int:
    """The median, cut to a whole number."""
    x, half = np.sort(x), len(x) // 2
    return int(x[half]) if len(x) % 2 else int((int(x[half - 1]) + int(x[half])) / 2)


def _dense(mark: np.ndarray, place: np.ndarray, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of stretches of ``width`` to twice as many places in a row of which enough are marked for the similarity ``least``: for each begin the longest."""
    n = len(mark)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # as many marks as 2 * least of (1 + least) places, or more: a sum that does not fall
    high = np.concatenate(([0], np.cumsum(np.where(mark, 100 - round(least * 100), -2 * round(least * 100)))))
    most = min(n, 2 * width)
    ends = np.concatenate((high[width:], np.full(most - width, -(1 << 40))))
    fine = np.ndarray((n - width + 1, most - width + 1), ends.dtype, ends, strides=2 * ends.strides) >= high[: n - width + 1, None]
    if place[-1] - place[0] == n - 1:
        begin = np.flatnonzero(fine.any(1))
        return begin, begin + most - np.argmax(fine[begin, ::-1], axis=1)
    row = place[np.minimum(np.arange(n - width + 1)[:, None] + np.arange(width, most + 1)[None, :], n) - 1] - place[: n - width + 1, None] == np.arange(width - 1, most)[None, :]
    fine &= row
    begin = np.flatnonzero(fine.any(1))
    return begin, begin + most - np.argmax(fine[begin, ::-1], axis=1)


def _plain(mark: np.ndarray, place: np.ndarray, width: int, least: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(begin, end) of stretches of just ``width`` places, if those with enough marks hold all marks there are: longer ones would add nothing."""
    n = len(mark)
    if n < width or place[-1] - place[0] != n - 1:
        return None
    total = np.concatenate(([0], np.cumsum(mark)))
    begin = np.flatnonzero((total[width:] - total[:-width]) * (100 + round(least * 100)) >= 2 * round(least * 100) * width)
    if len(begin) and total[begin[0]] == 0 and total[begin[-1] + width] == total[-1] and (begin[1:] - begin[:-1]).max(initial=0) <= width:
        return begin, begin + width
    return None


def repeated(x: tuple, s: tuple, width: int, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """[first, last] positions of passages of ``x`` that ``s`` repeats; both are (position, token), in order."""
    (xp, xt), (sp, st) = x, s
    order = st.argsort(kind="stable")
    ranked = st[order]
    at = np.minimum(ranked.searchsorted(xt), len(st) - 1)
    mark = ranked[at] == xt
    if np.count_nonzero(mark) < width * 6 // 7:
        return []
    good, until = _plain(mark, xp, width, least) or _dense(mark, xp, width, least)
    if not len(good):
        return []
    out, lines = [], sp[order[at]] - xp  # where the tokens are opposite
    past = np.maximum.accumulate(until)
    # stretches that touch are one
    breaks = np.flatnonzero((good[1:] > past[:-1]) | (xp[good[1:]] - xp[good[:-1]] != good[1:] - good[:-1]))
    for k, e in zip([0, *(breaks + 1)], [*breaks, len(good) - 1], strict=True):
        some = np.flatnonzero(mark[good[k] : past[e]]) + good[k]
        line = lines[some]
        # whole; in pieces, if put together from several places; only what is the same word for word
        for way in range(3):
            if way == 0:
                ends = [(0, len(some) - 1)] if some[-1] - some[0] + 1 >= width else []
            else:
                step = line[1:] - line[:-1]
                breaks = np.flatnonzero(np.abs(step) > SLACK if way == 1 else (step != 0) | (some[1:] - some[:-1] > 1))
                i, j = np.append(0, breaks + 1), np.append(breaks, len(some) - 1)
                wide = some[j] - some[i] + 1 >= width
                ends = zip(i[wide], j[wide], strict=True)
            fine = []
            for i, j in ends:
                a, b, shift = some[i], some[j], _middle(line[i : j + 1])
                if _alike(xt[a : b + 1], sp, st, xp[a] + shift, xp[b] + shift, least):
                    fine.append((int(xp[a]), int(xp[b])))
            out += fine
            if fine:
                break
    return out


def _verify(width: int):
    """Passages of each document that its sources repeat; its tokens come once, whatever the number of sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], batch.column(1)
            values = parts.flatten()
            row = np.repeat(np.arange(len(parts)), np.asarray(pc.list_value_length(parts)))
            doc, seg = (np.asarray(pc.struct_field(values, i)) for i in (0, 1))
            order = np.lexsort((seg, doc, row))
            new = np.concatenate(([True], (row[order[1:]] != row[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]]) | (seg[order[1:]] != seg[order[:-1]])))[: len(order)]
            order = order[new]  # rows that repeat are one
            row, doc, seg, toks = row[order], doc[order], seg[order], pc.struct_field(values, 2).take(pa.array(order)).to_pylist()
            n = np.array([len(t) // 3 for t in toks], np.int64)
            past = np.cumsum(n)
            tok, place = _tokens(b"".join(toks)), np.repeat(seg.astype(np.int64) * SEGMENT - past + n, n) + np.arange(n.sum())
            cuts = np.flatnonzero((row[1:] != row[:-1]) | (doc[1:] != doc[:-1])) + 1
            first = np.concatenate(([0], past))
            by: dict[int, list] = {}
            for a, b in zip([0, *cuts], [*cuts, len(row)], strict=True) if len(row) else ():
                by.setdefault(int(row[a]), []).append((int(doc[a]), slice(first[a], first[b])))
            for r, x in enumerate(batch.column(0).to_pylist()):
                lines = dict(by.get(r, ()))
                if x in lines:
                    mine = lines.pop(x)
                    for s, its in lines.items():
                        rows += [(x, s, a, b - a + SHINGLE) for a, b in repeated((place[mine], tok[mine]), (place[its], tok[its]), width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["doc_id", "source_id", "first_word", "n_words"])
        release()

    return run


def _reached(mark: np.ndarray, width: int, least: float) -> np.ndarray:
    """Marked places of each row inside stretches of ``width`` to twice as many places of which enough are marked for the similarity ``least``."""
    high = np.zeros((len(mark), mark.shape[1] + 1), np.int64)
    np.cumsum(np.where(mark, 100 - round(least * 100), -2 * round(least * 100)), axis=1, out=high[:, 1:])
    begins = mark.shape[1] - width + 1
    if begins < 1:
        return np.zeros(mark.shape, bool)
    ends = np.concatenate((high[:, width:], np.full((len(mark), width), -(1 << 40))), axis=1)
    fine = np.ndarray((len(mark), begins, width + 1), ends.dtype, ends, strides=(*ends.strides, ends.strides[1])) >= high[:, :begins, None]
    row, begin = np.nonzero(fine.any(2))
    past = begin + 2 * width - np.argmax(fine[row, begin, ::-1], axis=1)
    edge = np.zeros(high.shape, np.int64)
    np.add.at(edge, (row, begin), 1)
    np.add.at(edge, (row, past), -1)
    return (np.cumsum(edge[:, :-1], axis=1) > 0) & mark


def _repeats(doc: np.ndarray, half: np.ndarray, begin: np.ndarray, size: np.ndarray, tok: np.ndarray, known: list | pa.Array | pa.ChunkedArray, width: int, both: bool = False) -> list[tuple[int, int, int, int]]:
    """(x, s, first, last): what windows (in the order of their documents, ``size`` tokens from ``begin`` on) repeat of earlier ones beyond what is ``known`` of them.

    With ``both`` only windows of different halves meet.
    """
    m, out = len(doc), []
    first = np.concatenate(([0], np.cumsum(size)))
    win = np.repeat(np.arange(m), size)
    place = begin[win] + np.arange(len(tok)) - first[win]
    known = known if isinstance(known, pa.Array | pa.ChunkedArray) else pa.array(known, pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())])))
    of, spans = np.repeat(np.arange(m), np.asarray(pc.fill_null(pc.list_value_length(known), 0))), pc.list_flatten(known)
    lo, long = (np.asarray(pc.struct_field(spans, i)) for i in (0, 1))
    hi = np.minimum(lo + long - SHINGLE + 1 - begin[of], size[of])
    lo = np.minimum(np.maximum(lo - begin[of], 0), size[of])
    edge = np.zeros(len(tok) + 1, np.int64)
    np.add.at(edge, first[of] + lo, 1)
    np.add.at(edge, first[of] + np.maximum(lo, hi), -1)
    bare = np.cumsum(edge[:-1]) == 0
    _, one, which = np.unique(tok, return_index=True, return_inverse=True)
    shared = doc[win[one[which]]] < doc[win]  # an earlier document has it
    order = np.argsort(which, kind="stable")
    kept = order[np.concatenate(([True], (which[order[1:]] != which[order[:-1]]) | (win[order[1:]] != win[order[:-1]])))] if len(order) else order
    holder, starts = win[kept], np.searchsorted(which[kept], np.arange(len(one) + 1))
    earlier = np.searchsorted(doc, doc)
    # what all earlier windows together could reach
    able = np.flatnonzero((np.bincount(win[shared], minlength=m) >= width * 6 // 7) & (np.bincount(win[shared & bare], minlength=m) > 0))
    target = {}
    for k in range(0, len(able), 256):
        some = able[k : k + 256]
        at = first[some, None] + np.arange(size[some].max())
        inside = at < first[some + 1, None]
        at = np.where(inside, at, 0)
        reach = _reached(shared[at] & inside, width, SIMILARITY) & bare[at]
        target |= {int(w): np.flatnonzero(r) for w, r in zip(some, reach, strict=True) if r.any()}

    def holding(tokens: np.ndarray, until: int) -> np.ndarray:
        """How many of ``tokens`` each window before ``until`` has."""
        return np.bincount(np.concatenate([holder[starts[t] : starts[t + 1]] for t in tokens]), minlength=until)[:until]

    number = np.full(len(one), -1)
    for w, aim in target.items():
        free, mine = bare[first[w] : first[w + 1]].copy(), which[first[w] : first[w + 1]]
        gains = holding(mine[aim], earlier[w])
        fine = (gains > 0) & (holding(mine, earlier[w]) >= width * 6 // 7)
        if both:
            fine &= half[: earlier[w]] != half[w]
        others = np.flatnonzero(fine)
        others = others[np.argsort(-gains[others], kind="stable")]
        line = (place[first[w] : first[w + 1]], tok[first[w] : first[w + 1]])
        number[mine] = np.arange(len(mine))
        k, step = 0, 16  # what the first ones have is often all
        while k < len(others) and free[aim].any():
            some = others[k : k + step]
            k, step = k + step, min(4 * step, 256)
            row = np.repeat(np.arange(len(some)), size[some])
            its = number[which[first[some[row]] + np.arange(len(row)) - (np.cumsum(size[some]) - size[some])[row]]]
            mark = np.zeros((len(some), len(mine)), bool)
            mark[row[its >= 0], its[its >= 0]] = True
            mark = mark[:, number[mine]]
            on = (mark[:, aim] & free[aim]).any(1)
            some, mark = some[on], mark[on]
            if not len(some):
                continue
            reached = _reached(mark, width, SIMILARITY)
            gain = (reached & free).sum(1)
            while gain.any():
                i = int(np.argmax(gain))
                s = some[i]
                for a, b in repeated(line, (place[first[s] : first[s + 1]], tok[first[s] : first[s + 1]]), width):
                    if free[a - begin[w] : b + 1 - begin[w]].any():
                        out.append((int(doc[w]), int(doc[s]), a, b))
                        free[a - begin[w] : b + 1 - begin[w]] = False
                reached[i] = False
                gain = (reached & free).sum(1)
        number[mine] = -1
    return out


_PIECES = ["hash", "one", "two", "x", "at", "seg", "half", "begin", "toks", "known"]


def _crowds(width: int):
    """``_repeats`` of sorted pieces of windows (``_PIECES``), one pair of blocks of a crowd after another."""

    def found(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        x, at, seg, half, begin = (table.column(c).to_numpy() for c in ("x", "at", "seg", "half", "begin"))
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (at[1:] != at[:-1])))
        on = np.flatnonzero(np.concatenate(([True], new[1:] | (seg[1:] != seg[:-1]))))  # rows that repeat are one
        toks = table.column("toks").take(pa.array(on)).to_pylist()
        lead = np.flatnonzero(new)
        size = np.bincount(np.cumsum(new)[on] - 1, np.array([len(b) // 3 for b in toks]), minlength=len(lead)).astype(np.int64)
        tok = _tokens(b"".join(toks))
        rows = _repeats(x[lead], half[lead], begin[lead].astype(np.int64), size, tok, table.column("known").take(pa.array(lead)), width, bool((table.column("one").to_numpy()[:1] != table.column("two").to_numpy()[:1])[0]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["x", "s", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                if held and tuple(keys[a]) != cell:
                    yield found(held)
                    held = []
                cell = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield found(held)
        release()

    return run


def _spans(least: int):
    """Stretches [first, last] of tokens that overlap or follow each other, put together: passages in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, s, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ends = sorted((p["lo"], p["hi"]) for p in spans)
                lo, hi = ends[0]
                for a, b in ends[1:]:
                    if a > hi - least + 2:  # no passage of the least length lies across
                        rows.append((x, s, lo, hi - lo + SHINGLE))
                        lo, hi = a, b
                    hi = max(hi, b)
                rows.append((x, s, lo, hi - lo + SHINGLE))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["doc_id", "source_id", "first_word", "n_words"])

    return run


def _width(least_words: int) -> int:
    width = least_words - SHINGLE + 1
    if not 2 <= width < 4096:
        raise ValueError("least_words must be from 6 to 4099")
    return width


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, split: int = SPLIT) -> DataFrame:
    """(doc_id, source_id, first_word, n_words): passages of a document that one with a smaller id has too.

    A passage has at least ``least_words`` words and is near enough to the source's (Jaccard 0.75 over 5-word
    shingles). Passages repeated word for word are all found; edited ones where a minimum of the two agrees and their windows meet.
    Of many sources one or a few are named. Texts that are null, empty or shorter have none; rows without
    a doc_id are left out; rows of one doc_id do not repeat each other, and each text of an id counts as a source and has passages of its own (first_word counts in it). An empty table gives
    an empty result; other columns are ignored. The result does not depend on the partitions.
    """
    width = _width(least_words)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    numbers = _numbers(own)
    if numbers is None:
        return _passages(own, width, split)
    return _by_id(_passages(_numbered(own, numbers), width, split), numbers).select(*_COLUMNS).distinct()


_COLUMNS = ["doc_id", "source_id", "first_word", "n_words"]


def _numbers(own: DataFrame) -> DataFrame | None:
    """(doc_id, digest, number) of the different texts of each id, numbered in the order of the ids; None if no id has two."""
    several = durable(own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), few=True)
    digest = F.sha2("text", 256).alias("digest")
    if several.isEmpty() or own.join(several, "doc_id", "left_semi").select("doc_id", digest).distinct().groupBy("doc_id").count().where("count > 1").isEmpty():
        return None
    texts = own.select("doc_id", digest).distinct()
    texts = durable(texts.repartitionByRange(partitions(own.sparkSession), "doc_id").sortWithinPartitions("doc_id", "digest").withColumn("part", F.spark_partition_id()))
    sizes = texts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row per partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "digest"))
    return durable(texts.withColumn("i", inside).join(F.broadcast(before), "part").select("doc_id", "digest", (F.col("before") + F.col("i")).alias("number")))


def _numbered(own: DataFrame, numbers: DataFrame) -> DataFrame:
    rows = own.withColumn("digest", F.sha2("text", 256)).dropDuplicates(["doc_id", "digest"])
    return rows.join(numbers, ["doc_id", "digest"]).select(F.col("number").alias("doc_id"), "text")


def _by_id(found: DataFrame, numbers: DataFrame) -> DataFrame:
    """Passages between numbered texts as passages between ids, with the digest of the text; those inside one id go."""
    mine = numbers.select(F.col("number").alias("x"), F.col("doc_id").alias("own_id"), "digest")
    theirs = numbers.select(F.col("number").alias("s"), F.col("doc_id").alias("its_id"))
    rows = found.withColumnsRenamed({"doc_id": "x", "source_id": "s"}).join(mine, "x").join(theirs, "s").where("its_id < own_id")
    return rows.select(F.col("own_id").alias("doc_id"), F.col("its_id").alias("source_id"), "first_word", "n_words", "digest")


def _passages(own: DataFrame, width: int, split: int, block: int = BLOCK) -> DataFrame:
    """``repeated_passages`` of (doc_id, text) without nulls, one text to an id (a row that repeats changes nothing)."""
    spark = own.sparkSession
    small_batches(spark)
    met = _unpacked(_pairs(own, own.count(), width, split))
    let_go(spark)
    segs = own.mapInArrow(_segments, "doc long, seg int, toks binary")
    # segments that hold the windows of a document and its sources
    low, high = (lambda at: f"cast(greatest(0, {at} - lo - {SLACK}) div {SEGMENT} as int)"), (lambda at: f"cast(({at} + hi + {SLACK}) div {SEGMENT} as int)")
    pairs = met.where(F.col("kind").isin(NEAR, LATER)).selectExpr("x", "s", "kind", "xat - lo as first", f"xat + hi + {SHINGLE} as past", f"{low('xat')} as x0", f"{high('xat')} as x1", f"{low('sat')} as s0", f"{high('sat')} as s1")

    def verified(some: DataFrame) -> DataFrame:
        every = lambda doc, a, b: f"transform(sequence({a}, {b}), g -> struct({doc} as doc, g as seg))"
        needs = some.select("x", F.explode(F.expr(f"concat({every('x', 'x0', 'x1')}, {every('s', 's0', 's1')})")).alias("n")).select("x", "n.doc", "n.seg")
        needs = needs.repartition(partitions(spark), "doc", "seg").distinct()
        got = needs.join(segs, ["doc", "seg"]).groupBy("x").agg(F.collect_list(F.struct("doc", "seg", "toks")).alias("parts"))  # a document and the places of its sources
        return got.select("x", "parts").mapInArrow(_verify(width), _FOUND)

    spans = lambda rows: rows.groupBy("x", "s").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).mapInArrow(_spans(width), _FOUND)
    same = spans(met.where(F.col("kind") == SAME).selectExpr("x", "s", "xat - lo as lo", "xat + hi as hi"))
    first = durable(same.unionByName(verified(pairs.where(F.col("kind") == NEAR))).distinct())
    let_go(spark)
    known = first.groupBy(F.col("doc_id").alias("x")).agg(F.collect_set(F.struct("first_word", "n_words")).alias("known"))
    covered = F.expr("exists(coalesce(known, array()), k -> first >= k.first_word and past <= k.first_word + k.n_words)")
    open_ = pairs.where(F.col("kind") == LATER).join(known, "x", "left").where(~covered)
    # crowds in which a window has tokens outside what is known of it
    crowd = met.where(F.col("kind") == CROWD).selectExpr("x", "s as hash", "xat as at", f"greatest(0, xat - lo - {SLACK}) as begin", f"xat + hi + {SLACK} + 1 as past").join(known, "x", "left")
    crowd = crowd.withColumn("known", F.expr(f"filter(known, k -> k.first_word < past and k.first_word + k.n_words - {SHINGLE - 1} > begin)"))
    bare = F.expr(f"not exists(coalesce(known, array()), k -> begin >= k.first_word and past + {SHINGLE - 1} <= k.first_word + k.n_words)")
    crowd = durable(crowd.withColumn("bare", bare))
    sizes = crowd.groupBy("hash").agg(F.count("*").alias("n"), F.max("bare").alias("any")).where("any").selectExpr("hash", f"cast((n - 1) div {block} + 1 as int) as blocks")
    cells = crowd.join(sizes, "hash").withColumn("half", F.expr("cast(pmod(xxhash64(x, 'block of a crowd'), blocks) as int)")).withColumn("seg", F.explode(F.expr(f"sequence(cast(begin div {SEGMENT} as int), cast((past - 1) div {SEGMENT} as int))")))
    pieces = cells.withColumnRenamed("x", "doc").join(segs, ["doc", "seg"]).withColumn("from", F.expr(f"greatest(begin - seg * {SEGMENT}, 0)"))
    pieces = pieces.withColumn("toks", F.expr(f"substring(toks, cast(3 * from + 1 as int), cast(3 * (least(past - seg * {SEGMENT}, {SEGMENT}) - from) as int))")).where("length(toks) > 0")
    pieces = pieces.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).selectExpr("hash", "least(half, other) as one", "greatest(half, other) as two", "doc as x", *_PIECES[4:])
    more = pieces.repartition(partitions(spark), "hash", "one", "two").sortWithinPartitions(*_PIECES[:6]).mapInArrow(_crowds(width), "x long, s long, lo int, hi int")
    return first.unionByName(verified(open_)).unionByName(spans(more)).distinct()


def _cut(at: int, schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                texts = part.column(at).to_pylist()
                spans = part.column(part.num_columns - 1).to_pylist()
                on = [i for i, s in enumerate(spans) if s and texts[i]]
                if on:
                    w: Words = words(pa.array([texts[i] for i in on], pa.large_string()))
                    for k, i in enumerate(on):
                        lo, hi = w.first[k], w.first[k + 1]
                        raw, start = texts[i].encode(), w.start[lo:hi] - w.offset[k]
                        out, done = [], 0
                        for s in sorted(spans[i], key=lambda s: s["first_word"]):
                            one, two = s["first_word"], s["first_word"] + s["n_words"]
                            begin = int(start[one]) if one < len(start) else len(raw)
                            if begin > done:
                                out.append(raw[done:begin])
                            done = max(done, int(start[two]) if two < len(start) else len(raw))
                        texts[i] = b"".join([*out, raw[done:]]).decode()
                yield pa.RecordBatch.from_arrays([pa.array(texts, schema.fields[k].dataType.typeName() == "string" and pa.string()) if k == at else part.column(k) for k in range(part.num_columns - 1)], names=schema.names)

    return run


def cut_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, found: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, without the passages that a document with a smaller id has.

    The first document keeps the passage. A text that consists of such passages becomes empty; others keep every
    other word as it was, white space included. ``found`` are passages already known. Rows without a doc_id or text stay as they are;
    rows that repeat are cut alike; an empty table stays empty; empty texts stay empty.
    """
    span = F.collect_set(F.struct("first_word", "n_words")).alias("__spans")
    numbers = None
    if found is None:
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
        numbers = _numbers(own)
        found = repeated_passages(docs, least_words) if numbers is None else _by_id(_passages(_numbered(own, numbers), _width(least_words), SPLIT), numbers)
    doc = F.col("doc_id").alias("__doc")
    if numbers is None:
        rows = docs.join(found.groupBy(doc).agg(span), docs["doc_id"].cast("long") == F.col("__doc"), "left")
    else:  # a text is cut by its own passages
        found = found.groupBy(doc, F.col("digest").alias("__digest")).agg(span)
        rows = docs.join(found, (docs["doc_id"].cast("long") == F.col("__doc")) & (F.sha2(docs["text"].cast("string"), 256) == F.col("__digest")), "left")
    rows = rows.select(*(docs[c] for c in docs.columns), "__spans")
    return rows.mapInArrow(_cut(docs.columns.index("text"), docs.schema), docs.schema)
