"""Operators 4 and 5 against the tokenizers' own libraries."""

import zlib

import numpy as np
import pytest

from tests.llm.conftest import table
from tideline.llm.packing import pack, pack_documents, sum_of_squares
from tideline.llm.token_counts import count_tokens

P = pytest.importorskip("public_tokenizers")
ODD = [
    "x  y  z   q\r\n\n\n a<|endoftext|>  b <|endoftext|>",
    "  lead\t\ttab \x1c  k \x85 l don't I'll 12345 ÅÅ é ́x İ ẞ Σας",
    "<|startoftext|> hi<|endoftext|>yo  <|endo",
    " ",
    "日本語 テスト　全角 空白 🙂🙂 a b  c  d",
    "it's'tis 'twas a1b2 ×÷ naïve-café №5 x_y",
    "a" * 5000 + " " + "b c " * 4000,
]


def texts(corpus):
    return [*corpus, *((10_000 + i, t) for i, t in enumerate(ODD))]


def encoder(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_counts(spark, corpus):
    encode = encoder("byte_bpe_50k.json")
    got = {r[0]: tuple(r)[1:] for r in count_tokens(table(spark, texts(corpus)), P.path("byte_bpe_50k.json")).collect()}
    for d, t in texts(corpus):
        n = len(encode(t))
        assert got[d] == (len((t or "").encode()), n, n > 1024), t
    assert count_tokens(table(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_pieces_and_packing(spark, corpus):
    encode = encoder("word_bpe_49k.json")
    rows = pack_documents(table(spark, texts(corpus)), P.path("word_bpe_49k.json"), size=256, with_ids=True).collect()
    by_doc, by_sequence, total = {}, {}, 0
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, t in texts(corpus):
        ids = [*encode(t), 0]
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        total += len(ids)
        assert [x for r in own for x in r["ids"]] == ids, t
        for i, r in enumerate(own):
            assert (r["piece"], r["start"]) == (i, 256 * i) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) <= -(-total // 256) + 2


def test_packing_is_close_to_the_bound():
    lengths = np.clip(np.random.default_rng(1).lognormal(6.2, 0.9, 5000).astype(int), 1, 2048)
    sequence, offset = sum_of_squares(lengths, 2048)
    assert len(set(sequence)) <= 1.002 * -(-lengths.sum() // 2048) + 1
    used = np.zeros(sequence.max() + 1, int)
    np.add.at(used, sequence, lengths)
    assert used.max() <= 2048 and (offset + lengths <= 2048).all()


def test_packing_nothing_and_repeated_rows(spark):
    pieces = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (None, 0, 6)], "doc_id long, piece int, length long")
    rows = pack(pieces, 10).collect()
    assert len(rows) == 3 and len({r["sequence_id"] for r in rows}) == 2
    assert pack(pieces.limit(0), 10).count() == 0


def test_counts_of_repeated_rows_and_null_ids(spark):
    encode = encoder("byte_bpe_50k.json")
    rows = [(1, "some words"), (1, "some words"), (None, "more of them"), (None, None), (2, "")]
    got = sorted((str(r[0]), r[1], r[2]) for r in count_tokens(table(spark, rows), P.path("byte_bpe_50k.json")).collect())
    assert got == sorted((str(d), len((t or "").encode()), len(encode(t))) for d, t in rows)


def test_pieces_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "one two"), (1, "one two"), (None, "three"), (None, None)]
    got = pack_documents(table(spark, rows), P.path("word_bpe_49k.json"), size=8).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None", "None"] and sorted(r["length"] for r in got) == [1, 2, 3, 3]
