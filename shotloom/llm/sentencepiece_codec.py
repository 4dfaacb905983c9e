"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice holds every piece that ends at each character; a position keeps one survivor, its best last
piece with a back pointer. For a unigram model the survivor has the best sum of scores. For a
merge (BPE) model the scores are merge ranks and their sum means nothing; there a step from piece a to piece b
is allowed only if merging the characters of a and b gives a and b again, which leaves exactly one
path per prefix, the library's own. Survivors reach back at most the longest piece, so only
that window is kept: once the back pointers of all of them meet at one boundary, the ids before it
are committed and forgotten.

No piece has the space mark after another character, so the paths of all survivors meet there, and the stretches
between are lattices of their own. ``Lattices`` advances those of a slice of rows together, one character at
a time, as arrays; stretches longer than ``SHORT`` go through ``Viterbi`` one by one. The ids of up to
``REMEMBERED`` short stretches are kept for the next slices of a task.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import release, slices, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED, SHORT, PAUSE, AT_ONCE, FITS = 200_000, 64, 256, 1 << 17, 1 << 20
SPACE = "▁"
_SHORT = (2, 1)


class Pieces:
    """A model file's pieces: ids, scores, byte pieces, kind of model, longest piece."""

    def __init__(self, model: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        self.merges = proto.trainer_spec.model_type == 2
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.id_of, self.score, self.byte, self.out = {}, {}, {}, []
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
            elif p.type in (1, 4):
                self.id_of[p.piece.replace(SPACE, " ")], self.score[i] = i, p.score
            self.out.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() if p.type in (1, 4) else b"")
        self.text = {i: p for p, i in self.id_of.items()}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0)
        self.longest = max(map(len, self.id_of), default=1)
        self.floor = min(self.score.values(), default=0.0) - 10
        lengths: dict[str, set[int]] = {}
        for p in self.id_of:
            lengths.setdefault(p[-3:], set()).add(len(p))
        # lengths of the pieces that end with three given characters, longest first
        self.lengths = {end: sorted(n | {1, *(k for k in (2,) if end[-2:] in self.id_of)}, reverse=True) for end, n in lengths.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.stories: dict[int, tuple | None] = {}

    def story(self, i: int) -> tuple | None:
        """How a piece comes about: scores of its merges in order, its left and right end before and after each; None if merging gives something else."""
        if i in self.stories:
            return self.stories[i]
        parts = list(self.text[i])
        scores, left, right = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            found = [(self.score[j], -k) for k in range(len(parts) - 1) if (j := self.id_of.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            best, k = max(found)
            parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]
            scores.append(best)
            left.append(parts[0])
            right.append(parts[-1])
        told = self.stories[i] = (scores, left, right) if len(parts) == 1 else None
        return told

    def may_follow(self, a: int, b: int) -> bool:
        """Whether piece b can come after piece a (-1: a start or an unknown character) in a merge model.

        The merges of both take turns, best score first and leftmost of equals, until one across the boundary comes before them.
        """
        if len(self.fits) > FITS:
            self.fits.clear()
        ok = self.fits[a, b] = self._apart(a, b)
        return ok

    def _apart(self, a: int, b: int) -> bool:
        mine = self.story(b)
        if mine is None or a < 0:
            return mine is not None
        (s, _, right), (t, left, _) = self.story(a), mine
        i = j = 0
        while True:
            k = self.id_of.get(right[i] + left[j])
            across = None if k is None else self.score[k]
            if across is not None and (i == len(s) or across > s[i]) and (j == len(t) or across >= t[j]):
                return False
            if i == len(s) and j == len(t):
                return True
            if j == len(t) or (i < len(s) and s[i] >= t[j]):
                i += 1
            else:
                j += 1

    def bytes_of(self, char: str) -> tuple[int, ...]:
        if not self.byte:
            return (self.unknown,)
        return tuple(self.byte[b] for b in char.encode("utf-8", "surrogatepass"))


class Viterbi:
    """Feeds characters, gives back ids as soon as no survivor can change them."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.tail = ""  # characters since the last committed boundary
        self.size, self.piece, self.best = [0], [-1], [0.0]  # per position of tail: last step, its piece (-1: unknown), score
        self.kept = 1  # most positions held at once
        self.step = self._merge_steps if pieces.merges else self._scored_steps

    def feed(self, chars: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(chars), PAUSE // 4):
            begun = len(self.tail)
            self.tail += chars[at : at + PAUSE // 4]
            self.step(begun)
            self.kept = max(self.kept, len(self.size))
            if len(self.tail) >= PAUSE:
                out += self._commit()
        return out

    def _merge_steps(self, begun: int) -> None:
        p, tail, sizes, pieces = self.p, self.tail, self.size, self.piece
        get, fits, lengths = p.id_of.get, p.fits, p.lengths.get
        for i in range(begun + 1, len(tail) + 1):
            for size in lengths(tail[i - 3 : i], _SHORT) if i > 2 else _SHORT:
                if size <= i and (j := get(tail[i - size : i])) is not None:
                    prior = pieces[i - size]
                    ok = fits.get((prior, j))
                    if p.may_follow(prior, j) if ok is None else ok:
                        sizes.append(size)
                        pieces.append(j)
                        break
            else:
                sizes.append(1)
                pieces.append(-1)

    def _scored_steps(self, begun: int) -> None:
        p, tail = self.p, self.tail
        for i in range(begun + 1, len(tail) + 1):
            found = (self.best[i - 1] + p.floor, 1, -1)
            for size in p.lengths.get(tail[i - 3 : i], _SHORT) if i > 2 else _SHORT:
                if size <= i and (j := p.id_of.get(tail[i - size : i])) is not None:
                    found = max(found, (self.best[i - size] + p.score[j], size, j))
            self.best.append(found[0])
            self.size.append(found[1])
            self.piece.append(found[2])

    def _commit(self) -> list[int]:
        """Gives out the ids before the boundary where the paths of all survivors meet."""
        n, common = len(self.tail), None
        for at in range(max(0, n - self.p.longest + 1), n + 1):
            path = {at}
            while at:
                at -= self.size[at]
                path.add(at)
            common = path if common is None else common & path
        return self._cut(max(common))

    def _cut(self, end: int) -> list[int]:
        steps, at = [], end
        while at:
            j, size = self.piece[at], self.size[at]
            steps.append((j,) if j >= 0 else self.p.bytes_of(self.tail[at - size : at]))
            at -= size
        self.tail, self.size, self.piece = self.tail[end:], self.size[end:], self.piece[end:]
        self.best = [x - self.best[end] for x in self.best[end:]]
        return [i for step in reversed(steps) for i in step]

    def finish(self) -> list[int]:
        out = self._cut(len(self.tail))
        self.size, self.piece, self.best = [0], [-1], [0.0]
        return out


class Fits:
    """What ``Pieces.may_follow`` says of pairs of pieces, looked up by arrays; starts anew when half full."""

    def __init__(self, pieces: Pieces):
        self.p, self.width = pieces, np.int64(len(pieces.out))
        self.clear()

    def clear(self) -> None:
        self.table, self.held = np.zeros(FITS, np.int64), 0  # 2 * (pair + 1) + may follow

    def _slots(self, pair: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & (FITS - 1)

    def _find(self, pair: np.ndarray) -> np.ndarray:
        """2 * (pair + 1) + may follow; 0 where the pair is not known."""
        slot = self._slots(pair)
        got = self.table[slot]
        todo = np.flatnonzero((got >> 1 != pair + 1) & (got != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (FITS - 1)
            got[todo] = self.table[slot[todo]]
            todo = todo[(got[todo] >> 1 != pair[todo] + 1) & (got[todo] != 0)]
        return got

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = (a + 1).astype(np.int64) * self.width + b
        got = self._find(pair)
        if not got.all():
            new = np.unique(pair[got == 0])
            if self.held + len(new) > FITS // 2:
                self.clear()
                new = np.unique(pair)
            apart = self.p._apart
            entry = 2 * (new + 1) + np.array([apart(x // int(self.width) - 1, x % int(self.width)) for x in new.tolist()])
            slot = self._slots(new)
            while len(entry):
                free = self.table[slot] == 0
                self.table[slot[free]] = entry[free]
                todo = self.table[slot] != entry
                entry, slot = entry[todo], (slot[todo] + 1) & (FITS - 1)
            self.held += len(new)
            got = self._find(pair)
        return (got & 1).astype(bool)


class Lattices:
    """The Viterbi search over many short stretches at once, one character of each at a time."""

    def __init__(self, pieces: Pieces):
        self.p, self.fits = pieces, Fits(pieces)
        self.scores = np.array([pieces.score.get(i, 0.0) for i in range(len(pieces.out))])
        marks = sorted({c for x in pieces.id_of for c in x})
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[[ord(c) for c in marks]] = np.arange(1, len(marks) + 1)
        # the pieces as a tree of characters, its edges in one array: the edge of a node for a class is at base + class
        edges: list[dict[int, int]] = [{}]
        piece = [-1]
        for x, i in pieces.id_of.items():
            at = 0
            for c in self.class_of[[ord(c) for c in x]].tolist():
                if c not in edges[at]:
                    edges[at][c] = len(edges)
                    edges.append({})
                    piece.append(-1)
                at = edges[at][c]
            piece[at] = i
        size = 1 << max(12, (4 * len(edges)).bit_length())
        self.base, self.owner, self.next = np.zeros(len(edges), np.int64), np.full(size + len(marks) + 1, -1, np.int32), np.zeros(size + len(marks) + 1, np.int32)
        rng = np.random.default_rng(3)
        for at in sorted((i for i in range(len(edges)) if edges[i]), key=lambda i: -len(edges[i])):
            classes = np.fromiter(edges[at], np.int64)
            base = 0
            while (self.owner[base + classes] >= 0).any():
                base = int(rng.integers(size))
            self.base[at], self.owner[base + classes], self.next[base + classes] = base, at, list(edges[at].values())
        self.piece = np.array(piece, np.int32)
        self.longest = min(pieces.longest, SHORT)
        self.top = np.array([0, *(i.bit_length() for i in range(1, 1 << 16))], np.int8)

    def _ends(self, chars: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece of each length that ends at a character, bits of the lengths there are)."""
        found, bits = np.full((len(chars), self.longest), -1, np.int32), np.zeros(len(chars), np.int64)
        classes = self.class_of[chars]
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int32)
        for size in range(1, self.longest + 1):
            on = room[at] >= size
            at, node = at[on], node[on]
            edge = self.base[node] + classes[at + size - 1]
            on = self.owner[edge] == node
            at, node = at[on], self.next[edge[on]]
            j = self.piece[node]
            end, j = at[j >= 0] + size - 1, j[j >= 0]
            found[end, size - 1] = j
            bits[end] |= 1 << (size - 1)
        return found, bits

    def _longest(self, bits: np.ndarray) -> np.ndarray:
        out = self.top[bits & 0xFFFF].astype(np.int64)
        for k in range(16, self.longest, 16):
            high = (bits >> k) & 0xFFFF
            out = np.where(high > 0, self.top[high] + k, out)
        return out

    def ids(self, stretches: list[str]) -> list[bytes]:
        """The ids of each stretch, as int32 bytes."""
        n = np.fromiter(map(len, stretches), np.int64, len(stretches))
        order = np.argsort(-n, kind="stable")
        out: list[bytes] = [b""] * len(stretches)
        held = np.cumsum(n[order]) // AT_ONCE
        for some in np.split(order, np.flatnonzero(np.diff(held)) + 1) if len(order) else ():
            some = some.tolist()
            for k, packed in zip(some, self._some([stretches[k] for k in some]), strict=True):
                out[k] = packed
        return out

    def _some(self, stretches: list[str]) -> list[bytes]:
        """The same for stretches that come longest first."""
        p = self.p
        chars = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = np.array([len(s) for s in stretches])
        past = np.cumsum(n)
        first = past - n
        found, bits = self._ends(chars, np.repeat(past, n) - np.arange(len(chars)))
        # survivors: the last piece of the best path to each character (-1: unknown), its length, its score
        last, size, best = np.full(len(chars), -1, np.int32), np.ones(len(chars), np.int32), np.zeros(len(chars))
        for i in range(1, int(n[0]) + 1 if len(n) else 0):
            begin = first[: np.searchsorted(-n, -i, "right")]  # stretches that long
            end = begin + i - 1
            open_ = np.arange(len(end))
            left = bits[end]
            if not p.merges:
                best[end] = (best[end - 1] if i > 1 else 0.0) + p.floor
            while True:
                on = left > 0
                open_, left = open_[on], left[on]
                if not len(open_):
                    break
                e, length = end[open_], self._longest(left)
                j, back = found[e, length - 1], e - length
                start = back < begin[open_]
                if p.merges:
                    on = self.fits(np.where(start, -1, last[back]), j)
                    e, j, length = e[on], j[on], length[on]
                    open_, left = open_[~on], left[~on] & ~(1 << (self._longest(left[~on]) - 1))
                else:
                    score = np.where(start, 0.0, best[back]) + self.scores[j]
                    left = left & ~(1 << (length - 1))
                    on = score > best[e]
                    e, j, length = e[on], j[on], length[on]
                    best[e] = score[on]
                last[e], size[e] = j, length
        # the paths back from the ends
        shown, at, begin = np.zeros(len(chars), bool), past - 1, first
        while len(at):
            shown[at] = True
            at = at - size[at]
            on = at >= begin
            at, begin = at[on], begin[on]
        steps = np.flatnonzero(shown)
        got, width = last[steps], np.ones(len(steps), np.int64)
        unknown = np.flatnonzero(got < 0)
        if len(unknown):
            marks, which = np.unique(chars[steps[unknown]], return_inverse=True)
            spelt = [p.bytes_of(chr(c)) for c in marks.tolist()]
            width[unknown] = np.array([len(x) for x in spelt])[which]
            flat = np.repeat(got, width)
            put = np.repeat(got < 0, width)
            flat[put] = np.fromiter((b for k in which.tolist() for b in spelt[k]), np.int32, int(put.sum()))
            got = flat
        total = np.concatenate(([0], np.cumsum(width)))
        ends = (4 * total[np.searchsorted(steps, past)]).tolist()
        raw = got.astype("<i4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Codec(dict):
    """Encodes and decodes texts; remembers short stretches (key: stretch, value: its ids as int32 bytes)."""

    def __init__(self, model: str = MODEL):
        super().__init__()
        self.p, self.older = Pieces(model), {}
        self.viterbi, self.lattices = Viterbi(self.p), Lattices(self.p)
        self.split = re.compile(" *[^ ]+| +").findall
        if any(" " in x.lstrip(" ") for x in self.p.id_of):  # a piece can cross: a text is one stretch
            self.split = lambda s: [s]
        bare = [x[1:] if self.p.prefix and x[:1] == b" " else x for x in self.p.out]
        self.said = pa.array([*self.p.out, *bare], pa.large_binary())  # the second half: as the first piece of a text

    def forget(self) -> None:
        """Frees what is remembered of a task's texts; a Python worker outlives its task."""
        self.clear()
        self.older.clear()

    def _learn(self, new: set[str]) -> None:
        older = self.older
        self.update({s: older[s] for s in new if s in older} if older else {})
        short = [s for s in new if len(s) <= SHORT and s not in self]
        self.update(zip(short, self.lattices.ids(short), strict=True))

    def packed(self, texts: list[str | None]) -> list[bytes]:
        parts, ends = [], [0]
        for text in texts:
            if text:
                text = text.replace(SPACE, " ")  # the mark stands for a space
                parts += self.split(" " + text if self.p.prefix else text)
            ends.append(len(parts))
        seen = set(parts)
        if len(self) + len(seen) > REMEMBERED:  # what is not used until the next time goes
            self.older = dict(self)
            self.clear()
        new = seen.difference(self)
        if new:
            self._learn(new)
        long = [s for s in new if len(s) > SHORT]
        for s in long:
            self[s] = array("i", self.viterbi.feed(s) + self.viterbi.finish()).tobytes()
        rows = [b"".join(map(self.__getitem__, parts[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for s in long:
            del self[s]
        return rows

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed([text])[0]).tolist()

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        rows = self.packed(texts.to_pylist())
        ends = np.cumsum([0, *map(len, rows)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """Texts of the ids; null ids give an empty text and bytes that are no UTF-8 are replaced."""
        n = np.asarray(pc.fill_null(pc.list_value_length(ids), 0)).astype(np.int64)
        flat = np.asarray(pc.fill_null(ids.flatten(), -1)).astype(np.int64)
        flat = np.where((flat >= 0) & (flat < len(self.p.out)), flat, self.p.unknown)
        ends = np.concatenate(([0], np.cumsum(n)))
        flat[ends[:-1][n > 0]] += len(self.p.out)
        parts = self.said.take(pa.array(flat))
        offsets = np.frombuffer(parts.buffers()[1], np.int64)[: len(flat) + 1][ends] if len(flat) else np.zeros(len(n) + 1, np.int64)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.ascontiguousarray(offsets)), parts.buffers()[2] if len(flat) else pa.py_buffer(b"")])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())

    def decode(self, ids) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


@cache
def codec(model: str = MODEL) -> Codec:
    """One codec for each Python worker."""
    return Codec(model)


def encode(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """``docs`` with columns ids (array of int) and n_tokens. A null or empty text has no ids.

    Whole texts are encoded where they lie, without a shuffle. Columns of these names are replaced;
    repeated rows come back as often; an empty table gives an empty one. The model file must be on every machine.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", "n_tokens")
    at = docs.columns.index(text)
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

    schema = StructType([*docs.schema.fields]).add("ids", ArrayType(IntegerType())).add("n_tokens", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model)
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                ids = use.encode_all(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pc.list_value_length(ids).cast(pa.int64())], names=schema.names)
        use.forget()
        release()

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """``rows`` with column decoded: the text of the ids. Null or empty ids give an empty text."""
    from pyspark.sql.types import StringType, StructType

    rows = rows.drop("decoded")
    at = rows.columns.index(ids)
    schema = StructType([*rows.schema.fields]).add("decoded", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                yield pa.RecordBatch.from_arrays([*part.columns, use.decode_all(part.column(at))], names=schema.names)

    return rows.mapInArrow(run, schema)


def token_report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens and same_text: whether decoding gives the text back (the space mark counts as a space)."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = batch.column(1).slice(a, b - a)
                ids = use.encode_all(texts)
                same = pc.equal(use.decode_all(ids), pc.replace_substring(texts, SPACE, " "))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, pc.list_value_length(ids).cast(pa.int64()), same], names=["doc_id", "ids", "n_tokens", "same_text"])
        use.forget()
        release()

    return own.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, same_text boolean")


def model_at_hand(model: str = MODEL) -> bool:
    return os.path.exists(model)
