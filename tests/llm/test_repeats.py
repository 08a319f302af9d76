"""Operators 1 and 10 against brute force."""

import random
import re
from collections import Counter

import pytest

from tests.llm.conftest import table
from tideline.llm.substring_dedup import COVERS, cut_repeated_windows, remove_repeated_windows
from tideline.llm.suffix_dedup import common, prefix_intervals, remove_repeated_bytes, repeats_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def windows_by_hand(rows, size):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone[i : i + size] = [True] * size
            seen.add(key)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def bytes_by_hand(rows, size):
    texts = {d: (t or "").encode() for d, t in rows}
    count = Counter(b[i : i + size] for b in texts.values() for i in range(len(b) - size + 1))
    out = {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("size", [20, 5, 50])
def test_windows(spark, corpus, size):
    got = {r[0]: tuple(r)[1:] for r in remove_repeated_windows(table(spark, corpus).repartition(3), window=size).collect()}
    assert got == windows_by_hand(corpus, size)


@pytest.mark.parametrize("size,gram", [(400, 32), (60, 16)])
def test_bytes(spark, corpus, size, gram):
    got = {r[0]: (*tuple(r)[1:4], bytes(r[4])) for r in remove_repeated_bytes(table(spark, corpus).repartition(3), window=size, gram=gram).collect()}
    assert got == bytes_by_hand(corpus, size)


@pytest.mark.parametrize("hot,most", [(2, 1024), (48, 2), (2, 2)])
def test_hot_groups_are_decided_by_single_runs(spark, corpus, hot, most):
    got = {r[0]: tuple(r)[1:4] for r in remove_repeated_bytes(table(spark, corpus).repartition(3), window=60, gram=16, hot=hot, most_contexts=most).collect()}
    assert got == {k: v[:3] for k, v in bytes_by_hand(corpus, 60).items()}
    got = {r[0]: tuple(r)[1:] for r in remove_repeated_windows(table(spark, corpus).repartition(3), window=20, hot=hot).collect()}
    assert got == windows_by_hand(corpus, 20)


@pytest.mark.parametrize("seed", range(3))
def test_copies_of_hot_documents_in_another_partition(spark, seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared = [noise(150) for _ in range(6)]
    rows = [(i, "".join(noise(rng.randint(150, 350)) + s for s in shared)) for i in range(89)]
    parts = table(spark, rows).coalesce(1).union(table(spark, [(1000, rows[0][1])]).coalesce(1))
    got = {r[0]: tuple(r)[1:4] for r in remove_repeated_bytes(parts).collect()}
    want = {k: v[:3] for k, v in bytes_by_hand([*rows, (1000, rows[0][1])], 400).items()}
    assert got == want and want[0][1] == want[0][0]


def longest_by_hand(rows, least, most):
    """Whether a text has a string of `least` bytes that also starts elsewhere, and of `most`."""
    texts = {d: (t or "").encode() for d, t in rows}
    out = {d: 0 for d in texts}
    for size in (least, most):
        count = Counter(b[i : i + size] for b in texts.values() for i in range(len(b) - size + 1))
        for d, b in texts.items():
            if any(count[b[i : i + size]] > 1 for i in range(len(b) - size + 1)):
                out[d] = size
    return out


def test_shorter_repeats_are_seen_and_not_removed(spark, corpus):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("ABCDEFGHIJ ") for _ in range(n))
    middle, short = noise(50), noise(45)
    rows = [*corpus, (900, noise(70) + middle + noise(90)), (901, noise(10) + middle + noise(30)), (902, short), (903, noise(3) + short), (904, noise(39)), (905, noise(300))]
    got = {r["doc_id"]: r for r in remove_repeated_bytes(table(spark, rows).repartition(3), window=60, gram=16, least=40).collect()}
    assert {d: (*tuple(r)[1:4], bytes(r[4])) for d, r in got.items()} == bytes_by_hand(rows, 60)
    for d, size in longest_by_hand(rows, 40, 60).items():
        found = got[d]["longest_repeat"]
        assert found >= size and (size or not found), d
    assert (got[900]["longest_repeat"], got[901]["longest_repeat"], got[902]["longest_repeat"], got[904]["longest_repeat"]) == (50, 50, 45, 0)


def test_pipeline_form_keeps_columns_and_untouched_texts(spark, corpus):
    docs = table(spark, corpus)
    out = cut_repeated_windows(docs, window=50)
    assert out.columns == docs.columns and out.count() == docs.count()
    wanted = windows_by_hand(corpus, 50)
    for r in out.collect():
        text = dict(corpus)[r["doc_id"]]
        assert r["text"] == (wanted[r["doc_id"]][2] if wanted[r["doc_id"]][1] else text) and r["kept"] == "k"


def test_null_ids_repeated_rows_and_no_rows(spark):
    text = " ".join(map(str, range(30)))
    rows = [(1, text), (1, text), (None, text), (2, None)]
    got = sorted((str(r[0]), r[2]) for r in remove_repeated_windows(table(spark, rows)).collect())
    assert got == [("1", 0), ("1", 30), ("2", 0), ("None", 30)]
    assert sorted(r[2] for r in remove_repeated_bytes(table(spark, rows), window=40, gram=16).collect()) == [0, len(text)] + [len(text)] * 2
    assert remove_repeated_windows(table(spark, [])).count() == 0 and remove_repeated_bytes(table(spark, [])).count() == 0


@pytest.mark.parametrize("period", COVERS)
def test_covers_hold_every_difference(period):
    assert {(a - b) % period for a in COVERS[period] for b in COVERS[period]} == set(range(period))


def test_interval_tree():
    words = sorted([b"abab", b"ab", b"abc", b"b", b"abx", b"q"])
    prefix = [common(a, b) for a, b in zip(words, words[1:], strict=False)]
    found = {(n, i, j) for n, i, j in prefix_intervals(prefix) if n}
    assert found == {(2, 0, 3)}
    got = set(repeats_of([(b"xxANCHORyy", 2), (b"zxANCHORyq", 2), (b"qqANCHORzz", 2)], 8))
    assert got == {(0, 1, 7), (1, 1, 7)}
