"""Token ids of documents in files of independent zstandard frames.

A file holds, in this order:

* frames: each an own zstandard frame with the little-endian ids of whole documents, about ``FRAME`` bytes before compression (a longer
  document has a frame to itself);
* the document table: a skippable frame with a zstandard frame of JSON (part, width of an id, number of documents of each frame) and, a byte
  0 later, of the documents' ids (int64), their null marks (byte) and their numbers of tokens (int64);
* the seek table of the public seekable format: a skippable frame with, per frame, its size in the file, its size decompressed and the low 32 bits of the XXH64 of
  its content, then the number of frames, a descriptor byte (checksums are there) and the magic number.

Spark's text writer writes the files, so they appear in any store that Spark writes to and a lost task leaves no half file. What that writer sets
behind each row is ``GAP``, an empty skippable frame: zstandard readers step over it, and the sizes in the seek table include it.
A reader takes the two tables from a file's end and decompresses only the frames that hold the documents it wants.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._graph import durable, partitions, scratch
from ._text import release, slices, small_batches

FRAME = 1 << 20
LEVEL = 3
END = 1
INPUT, MOST_FILES = 256 << 20, 1_000_000
GAP = struct.pack("<II", 0x184D2A50, 0)
TABLE, SEEK, MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1  # fixed values of the public format, but for TABLE


class Words(dict):
    """Numbers of the words (what stands between spaces) seen so far, and the ids of each as the tokenizer gives them.

    White space always parts tokens in the model, so a text's ids are those of its words. A word met for the first time waits in ``new`` until ``learn``;
    all the new ones are encoded as one text, parted by a control character whose own id marks their ends.
    """

    MOST = 1 << 20  # words held; then all are forgotten
    _MARK = "\x01"
    _SIGNS = frozenset(".,;:!?")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        (self.mark,) = self.tokenizer.encode(self._MARK, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids, self.first = np.zeros(1 << 16, self.dtype), np.zeros(1 << 16, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def _stem(self, word: str) -> tuple[str, str]:
        """A word and the sign behind it that give the same ids: a letter A-Z before a letter is lower-cased, a sign after a letter or digit stands alone."""
        tail = ""
        if word[-1:] in self._SIGNS and word[-2:-1].isalnum():
            word, tail = word[:-1], word[-1]
        if "A" <= word[:1] <= "Z" and (len(word) == 1 or word[1].isalpha()):
            word = word[0].lower() + word[1:]
        return word, tail

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all ``words``, and where each word's begin and end in them."""
        marked = [i for i, w in enumerate(words) if self._MARK in w]
        plain = [w for w in words if self._MARK not in w] if marked else words
        ids = np.array(self.tokenizer.encode_batch_fast([f" {self._MARK} ".join(plain)], add_special_tokens=False)[0].ids, self.dtype)
        at = np.flatnonzero(ids == self.mark)
        begin, end = np.concatenate(([0], at + 1)), np.concatenate((at, [len(ids)]))
        if marked:  # each by itself
            own = [np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, self.dtype) for i in marked]
            ends = len(ids) + np.cumsum([len(x) for x in own])
            place = np.empty(len(words), np.int64)
            rest = np.ones(len(words), bool)
            rest[marked] = False
            place[rest], place[marked] = np.arange(len(plain)), len(begin) + np.arange(len(marked))
            begin, end = np.concatenate((begin, [len(ids)], ends[:-1]))[place], np.concatenate((end, ends))[place]
            ids = np.concatenate((ids, *own))
        return ids, begin, end

    def learn(self) -> None:
        if not self.new:
            return
        known: dict[str, int] = {}
        number = known.setdefault
        pairs = np.fromiter((number(part, len(known)) for word in self.new for part in self._stem(word)), np.int64, 2 * len(self.new))
        ids, begin, end = self._encoded(list(known))
        sizes = (end - begin)[pairs]
        ends = np.cumsum(sizes)
        body = ids[np.repeat(begin[pairs] - (ends - sizes), sizes) + np.arange(ends[-1])]
        at, to = len(self) - len(self.new), len(self)
        first = self.first[at] if at else 0
        self.first = _grown(self.first, to + 1)
        self.first[at + 1 : to + 1] = first + ends[1::2]
        self.ids = _grown(self.ids, first + len(body))
        self.ids[first : first + len(body)] = body
        self.new = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``END``, and where each text begins in them."""
        if len(self) > self.MOST:
            self.forget()
        numbers = []
        for text in texts:
            text = text or ""
            if text.isascii() and "<|" not in text:  # the model lower-cases all but its special tokens
                text = text.lower()
            numbers.append(np.fromiter(map(self.__getitem__, text.replace("\n", " ").split(" ")), np.int64))
        self.learn()
        word = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        sizes = self.first[word + 1] - self.first[word]
        closes = np.cumsum(np.fromiter(map(len, numbers), np.int64)) - 1  # each text has a word, if an empty one
        room = sizes.copy()
        room[closes] += 1
        ends = np.cumsum(room)
        out = np.full(int(ends[-1]) if len(ends) else 0, END, self.dtype)
        shift = np.repeat(ends - room, sizes)
        inside = np.arange(len(shift)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[shift + inside] = self.ids[np.repeat(self.first[word], sizes) + inside]
        return out, np.concatenate(([0], ends[closes]))


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate((x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)))


@lru_cache(1)
def _words(path: str) -> Words:  # one for each Python worker, kept from task to task
    return Words(path)


@dataclass
class FileWriter:
    """The rows of one file: ``add`` documents in order, then ``end``; each gives out the frames that are full by then."""

    part: int
    width: int
    frames: list[tuple[int, int, int]] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    ids: list[int | None] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    _held: list[bytes] = field(default_factory=list)
    _bytes: int = 0

    def _close(self) -> list[bytes]:
        import xxhash
        import zstandard

        if not self._held:
            return []
        raw = b"".join(self._held)
        packed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(raw)
        self.frames.append((len(packed) + len(GAP), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.counts.append(len(self._held))
        self._held, self._bytes = [], 0
        return [packed]

    def add(self, doc_id: int | None, ids: bytes) -> list[bytes]:
        out = self._close() if self._bytes + len(ids) > FRAME else []
        self._held.append(ids)
        self._bytes += len(ids)
        self.ids.append(doc_id)
        self.sizes.append(len(ids) // self.width)
        return out

    def end(self) -> list[bytes]:
        import zstandard

        out = self._close()
        if not self.ids:
            return out
        head = json.dumps({"part": self.part, "width": self.width, "documents": self.counts}).encode()
        body = np.array([x or 0 for x in self.ids], "<i8").tobytes() + bytes(x is None for x in self.ids) + np.array(self.sizes, "<i8").tobytes()
        table = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(head + b"\0" + body)
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, MAGIC)
        return [*out, struct.pack("<II", TABLE, len(table)) + table, struct.pack("<II", SEEK, len(seek)) + seek]


class FileReader:
    """Documents of one file, from anything that can seek; only frames that are asked for are read and decompressed (``frames_read`` counts them).

    Raises ValueError where the tables don't fit the file or a frame isn't what its checksum says.
    """

    def __init__(self, file):
        import zstandard

        self.file, self.frames_read = file, 0
        size = file.seek(0, 2)
        foot = len(GAP) + 9
        n, flags, magic = struct.unpack("<IBI", self._bytes(size - foot, 9))
        if magic != MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end")
        at = size - foot - 12 * n - 8
        entries = np.frombuffer(self._bytes(at + 8, 12 * n), "<u4").reshape(n, 3)
        self.size, self.raw, self.sums = (entries[:, i].astype(np.int64) for i in range(3))
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        kind, length = struct.unpack("<II", self._bytes(int(self.at[-1]), 8))
        if kind != TABLE or self.at[-1] + 8 + length + len(GAP) != at:
            raise ValueError("no document table")
        head, _, body = zstandard.ZstdDecompressor().decompress(self._bytes(int(self.at[-1]) + 8, length)).partition(b"\0")
        info = json.loads(head)
        self.part, self.dtype = info["part"], np.dtype(f"<u{info['width']}")
        n = len(body) // 17
        self.ids, null, self.sizes = np.frombuffer(body, "<i8", n), np.frombuffer(body, np.uint8, n, 8 * n), np.frombuffer(body, "<i8", n, 9 * n)
        self.null = null > 0
        self.first = np.concatenate(([0], np.cumsum(info["documents"])))  # first document of each frame
        self.start = np.concatenate(([0], np.cumsum(self.sizes)))

    def _bytes(self, at: int, n: int) -> bytes:
        if at < 0:
            raise ValueError("the file is too short")
        self.file.seek(at)
        out = self.file.read(n)
        if len(out) != n:
            raise ValueError("the file is too short")
        return out

    def frame(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        self.frames_read += 1
        try:
            raw = zstandard.ZstdDecompressor().decompress(self._bytes(int(self.at[k]), int(self.size[k])), max_output_size=int(self.raw[k]))
        except zstandard.ZstdError as error:
            raise ValueError(f"frame {k} is damaged: {error}") from error
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged: its checksum differs")
        return np.frombuffer(raw, self.dtype)

    def documents(self, places: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the file, ids) of the documents at ``places`` (null: all), frame by frame."""
        places = np.arange(len(self.ids)) if places is None else np.unique(np.fromiter(places, np.int64))
        frame = np.searchsorted(self.first, places, "right") - 1
        for k in np.unique(frame):
            ids, base = self.frame(int(k)), self.start[self.first[k]]
            for i in places[frame == k]:
                yield int(i), ids[self.start[i] - base : self.start[i + 1] - base]

    def find(self, doc_ids: Iterable[int]) -> np.ndarray:
        """Places of the documents with these ids, which lie in ascending order behind those without one."""
        wanted, known = np.unique(np.fromiter(doc_ids, np.int64)), self.ids[self.null.sum() :]
        a, b = np.searchsorted(known, wanted), np.searchsorted(known, wanted, "right")
        return np.flatnonzero(self.null).size + np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)] or [np.zeros(0, np.int64)])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, files: int = 0) -> None:
    """Writes the ids of every whole text to new files under ``path`` (which must not exist), documents ascending by doc_id through the files in the order of their ``part``.

    A null or empty text is just ``END``; rows without an id come first; rows of one id follow each other by a hash of the text, so that many of them fill
    several files; repeated rows come as often, in one file; other columns are ignored; an empty table makes no file with documents. ``files``: how many (0: as
    many as shuffle partitions, or more where the input is estimated at more than ``INPUT`` bytes for each).
    """
    spark = docs.sparkSession
    small_batches(spark)
    if not files:
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        files = max(partitions(spark), min(size // INPUT, MOST_FILES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _words(tokenizer)
        file, ready = FileWriter(TaskContext.get().partitionId(), words.dtype.itemsize), []
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts):
                ids, first = words.encode(texts.slice(a, b - a).to_pylist())
                for i, x, y in zip(doc_ids[a:b], first[:-1].tolist(), first[1:].tolist(), strict=True):
                    ready += file.add(i, ids[x:y].tobytes())
                if ready:
                    yield pa.RecordBatch.from_arrays([pa.array(ready, pa.binary())], names=["value"])
                    ready = []
        for row in file.end():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["value"])
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string")).write.option("lineSep", GAP.decode("ascii")).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")


def read_tokens(spark: SparkSession, path: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, ids) of the documents under ``path``; with ``doc_ids`` (one column) only of those, and only their frames are decompressed.

    A wanted id that isn't there gives no row, one that is there twice two rows; null ids are wanted by none.
    """
    schema = "doc_id long, ids array<int>"

    def rows(content: bytes, wanted: list[int] | None) -> Iterator[pa.RecordBatch]:
        import io

        file = FileReader(io.BytesIO(content))
        for i, ids in file.documents(None if wanted is None else file.find(wanted)):
            yield pa.RecordBatch.from_arrays([pa.array([None if file.null[i] else int(file.ids[i])], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from rows(batch.column("content")[k].as_py(), batch.column("wanted")[k].as_py() if "wanted" in batch.schema.names else None)

    if doc_ids is None:
        return _files(spark, path).select("content").mapInArrow(run, schema)
    spans = _files(spark, path).select("path", "content").mapInArrow(_spans, "path string, low long, high long")
    wanted = doc_ids.select(F.col(doc_ids.columns[0]).cast("long").alias("id")).where("id is not null").distinct()
    # one row per file, so this is no join of rows with rows: each wanted id meets the file whose span holds it
    per_file = wanted.join(F.broadcast(spans), F.expr("id between low and high")).groupBy("path").agg(F.collect_list("id").alias("wanted"))
    return _files(spark, path).select("path", "content").join(per_file, "path").select("content", "wanted").mapInArrow(run, schema)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import io

    for batch in batches:
        for k in range(batch.num_rows):
            file = FileReader(io.BytesIO(batch.column(1)[k].as_py()))
            known = file.ids[~file.null]
            if len(known):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array(known[:1]), pa.array(known[-1:])], names=["path", "low", "high"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files: ids of all documents before it, its own number, and the crc32 of its ids as unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for k in range(batch.num_rows):
                file = FileReader(io.BytesIO(batch.column(0)[k].as_py()))
                sums = np.fromiter((zlib.crc32(ids.astype("<u4")) for _, ids in file.documents()), np.int64, len(file.ids))
                columns = [pa.array(np.full(len(sums), file.part)), pa.array(file.ids, pa.int64(), mask=file.null), pa.array(file.start[:-1]), pa.array(file.sizes), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])
        release()

    rows = durable(_files(spark, path).select("content").mapInArrow(run, "part long, doc_id long, start long, n_tokens long, ids_crc32 long"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(totals), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_file_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``token_digest`` of files of ``docs`` in the checkpoint folder, which go when their digest is known."""
    with scratch(docs.sparkSession) as path:
        write_tokens(docs, f"{path}/tokens", tokenizer)
        return token_digest(docs.sparkSession, f"{path}/tokens")
