"""Token files: ids against the library on whole texts, exact round trips, damage, and odd rows."""

import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shotloom.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n \t", "one", "it's DON'T we'll...", "x " * 3000, "naïve CAFÉ 你好 😀 é J̌ ǰ İ ΟΔΟΣ. Σ", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b.", "\x01 a\x01b \x00", "A. B, C! 1. 2, ²; _. ... ,. (a). Ab.",
    "tab\tand nbsp line\x1cfile\x85next", "x" * 5000, "가 가. Á. À Ḃ.",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def whole(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def check(library, texts, words):
    ids, first = words.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [whole(library, t) for t in texts]


def test_ids_are_the_librarys_on_whole_texts(library):
    words = token_files.Words(PATH)
    for texts in (ODD, [], ODD[::-1], [" ".join(t for t in ODD if t)]):
        check(library, texts, words)
    words.MOST = 1  # everything is forgotten in between
    check(library, ODD, words)


WORDS, LIBRARY = token_files.Words(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAzZ09 .,;:!?'s_-\n\t\x01<|>éÉßΣİ́̌你ǰ") | st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_ids_of_any_texts(texts):
    WORDS.forget()
    check(LIBRARY, texts, WORDS)


def written(documents, frame=None, width=2):
    file, rows = token_files.FileWriter(3, width), []
    for doc_id, ids in documents:
        rows += file.add(doc_id, np.array(ids, f"<u{width}").tobytes())
    return b"".join(r + token_files.GAP for r in [*rows, *file.end()])


def test_a_reader_decompresses_only_the_frames_it_needs(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME", 400)
    rng = random.Random(1)
    documents = [(i // 2 * 2 if i else None, [rng.randrange(50_000) for _ in range(rng.choice([0, 1, 30, 500]))]) for i in range(200)]
    file = token_files.FileReader(io.BytesIO(written(documents)))
    assert file.part == 3 and [ids.tolist() for _, ids in file.documents()] == [ids for _, ids in documents] and len(file.raw) > 50
    for wanted in ([], [7], [100], [100, 102, 198], [0], range(-5, 500)):
        file.frames_read = 0
        places = [i for i, (doc_id, _) in enumerate(documents) if doc_id is not None and doc_id in wanted]
        assert [(i, ids.tolist()) for i, ids in file.documents(file.find(wanted))] == [(i, documents[i][1]) for i in places]
        frames = {int(np.searchsorted(file.first, i, "right")) - 1 for i in places}
        assert file.frames_read == len(frames)


def test_the_file_is_a_plain_zstandard_stream(monkeypatch):
    import zstandard

    monkeypatch.setattr(token_files, "FRAME", 64)
    documents = [(i, list(range(i))) for i in range(40)]
    data = written(documents)
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data) == b"".join(np.array(ids, "<u2").tobytes() for _, ids in documents)
    assert struct.unpack("<I", data[-12:-8])[0] == 0x8F92EAB1


def test_damage_is_found():
    documents = [(i, list(range(50 * i))) for i in range(30)]
    data = written(documents)
    for at in (10, len(data) // 4):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_files.FileReader(io.BytesIO(bytes(bad))).documents())
    for short in (b"", data[: len(data) // 2], data[:-1]):
        with pytest.raises(ValueError):
            list(token_files.FileReader(io.BytesIO(short)).documents())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "clash") for i, t in enumerate(ODD * 4)] + [(6, "twice", "x"), (6, "twice", "x"), (6, "another", "y"), (None, "no id", "z"), (None, None, "z")]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)


def expected(library, docs):
    rows = sorted(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    out, at = [], 0
    for doc_id, text, _ in rows:
        ids = whole(library, text)
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def key(row):
    return tuple((x is not None, x or 0) for x in row)


def test_report_against_brute_force(spark, library, docs):
    got = [tuple(r) for r in token_files.token_file_report(docs, PATH).collect()]
    assert sorted(got, key=key) == sorted(expected(library, docs), key=key)
    none = token_files.token_file_report(spark.createDataFrame([], docs.schema), PATH)
    assert none.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and none.collect() == []


def test_files_are_read_back_whole_and_by_id(spark, library, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, PATH, files=3)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in token_files.read_tokens(spark, path).collect())
    assert got == sorted((r["doc_id"] is not None, r["doc_id"] or 0, whole(library, r["text"])) for r in docs.collect())
    wanted = spark.createDataFrame([(6,), (9,), (9,), (10_000,), (None,)], "w long")
    picked = sorted((r["doc_id"], r["ids"]) for r in token_files.read_tokens(spark, path, wanted).collect())
    assert picked == sorted((r["doc_id"], whole(library, r["text"])) for r in docs.where(F.col("doc_id").isin(6, 9)).collect()) and len(picked) == 5
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        token_files.write_tokens(docs, path, PATH)
