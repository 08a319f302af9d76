"""Operators 6 and 9: the language model against a plain one, language identification by held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import table
from tideline.llm import language_id
from tideline.llm import language_model as LM


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def model_by_hand(rows):
    train = [tokens(t) for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pairs = Counter((u, w) for t in train for u, w in zip(["<begin>", *t], t, strict=False))
    context, after, before = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (u, w), k in pairs.items():
        context[u] += k
        after[u][min(k, 3) - 1] += 1
        before[w] += 1
    d2 = LM.discounts([Counter(pairs.values())[i] for i in (1, 2, 3, 4)])
    kinds = Counter(before.values())
    d1 = LM.discounts([kinds[i] for i in (1, 2, 3, 4)])
    types = len(pairs)
    spare = sum(x * y for x, y in zip(d1[1:], [kinds[1], kinds[2], sum(m for k, m in kinds.items() if k > 2)], strict=True)) / types

    def p(u, w):
        low = max(before[w] - d1[min(before[w], 3)], 0) / types + spare / (v + 1)
        if not context[u]:
            return low
        k = pairs[u, w]
        return (max(k - d2[min(k, 3)], 0) + sum(x * y for x, y in zip(d2[1:], after[u], strict=True)) * low) / context[u]

    assert sum(p(next(iter(c)), w) for w in c) + p(next(iter(c)), "never seen") == pytest.approx(1)
    return {d: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), sum(math.log10(p(u, w)) for u, w in zip(["<begin>", *tokens(t)], tokens(t), strict=False))) for d, t in rows}


def test_scores(spark, corpus):
    rows = [*corpus, (None, "One more"), (5000, "neverseen words")]
    got = {r[0]: tuple(r)[1:] for r in LM.held_out_scores(table(spark, rows)).collect()}
    for d, want in model_by_hand(rows).items():
        assert got[d][0] == (d is not None and zlib.crc32(str(d).encode()) % 7 == 2)
        assert got[d][1:4] == want[:3] and got[d][4:] == pytest.approx(want[3:])


def test_scores_without_rows_or_training(spark):
    assert LM.held_out_scores(table(spark, [])).count() == 0
    d = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = LM.held_out_scores(table(spark, [(d, "a b")])).collect()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 and r["base_score"] == 0


def languages(n=240):
    rng = random.Random(3)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["éa", "ou", "ñe"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(2, 4))) for _ in range(12)).title(), lang if i % 10 else None, lang))
    return rows


def test_languages(spark):
    rows = languages()
    docs = spark.createDataFrame([(d, t, lang, "x") for d, t, lang, _ in rows] + [(1000, None, "aa", "x"), (1001, "12 !!", None, "x"), (None, "schung eining", "bb", "x")], "doc_id long, text string, lang string, lang_pred string")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    held = [d for d, *_ in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sorted(held) == sorted(d for d, r in got.items() if r["held_out"] and d is not None and d < 1000)
    assert all(got[d]["lang_pred"] == true for d, _, _, true in rows if d in held)
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1000]["score"] == 0
    assert got[None]["lang_pred"] == "bb" and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_as_with_plain_sets_of_ngrams(spark):
    """The filter decides as the languages' sets themselves do, apart from near ties."""
    import numpy as np

    rows = languages(400)
    docs = spark.createDataFrame([(d, t, lang) for d, t, lang, _ in rows], "doc_id long, text string, lang string")

    def grams_of(text):
        b = " " + " ".join(re.findall(r"[a-z\x80-\xff]+", text.lower().encode().decode("latin-1").translate({i: i + 32 for i in range(65, 91)}))) + " "
        return [b[i : i + 4] for i in range(len(b) - 3)]

    train = [(t, lang) for d, t, lang, _ in rows if lang and zlib.crc32(str(d).encode()) % 4 != 2]
    docs_of, held = Counter(lang for _, lang in train), defaultdict(Counter)
    for t, lang in train:
        held[lang].update(set(grams_of(t)))
    sets = {lang: {g for g, n in c.items() if n >= 0.002 * docs_of[lang]} for lang, c in held.items()}
    model = language_id.fit(docs.where(~language_id.held_out("doc_id")))
    assert model.names == sorted(sets)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    close = 0
    for d, t, _, _ in rows:
        hits = {lang: sum(g in s for g in grams_of(t)) for lang, s in sets.items()}
        best, second = sorted(hits.values())[-1:-3:-1]
        if best - second <= 0.03 * len(grams_of(t)):
            close += 1
            continue
        assert hits[got[d]["lang_pred"]] == best
        assert got[d]["score"] == pytest.approx(best / sum(hits.values()), abs=0.03)
    assert close < 20
    # every language that holds an n-gram has its bit
    shared = sorted(set.intersection(*sets.values()))
    for g in shared[:50]:
        number = np.frombuffer(g.encode("latin-1"), "<u4")
        mask = ~np.uint8(0)
        for at in language_id.slots_of(number, len(model.table[0])):
            mask &= model.table[0][at][0]
        assert mask & 7 == 7


def test_languages_of_repeated_rows_and_very_long_texts(spark):
    rows = languages()
    long = " ".join(t for _, t, _, true in rows if true == "bb") * 60
    assert len(long) > 500_000
    more = [(2000, long, None), (2001, "", None), (2001, "", None), (2002, rows[0][1], None), (2002, rows[0][1], None)]
    docs = spark.createDataFrame([(d, t, lang) for d, t, lang, _ in rows] + more, "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(docs).where("doc_id >= 2000").collect()]
    assert len(got) == 5 and {x[1] for x in got if x[0] == 2000} == {"bb"} and {x[1:] for x in got if x[0] == 2001} == {("und", 0.0)}
    assert {x[1] for x in got if x[0] == 2002} == {rows[0][3]} and len({x for x in got if x[0] == 2002}) == 1


def test_scores_of_repeated_rows(spark, corpus):
    rows = [*corpus[:30], (7000, "a b a"), (7000, "a b a"), (None, "a b"), (None, "a b")]
    want = model_by_hand(rows)
    got = [tuple(r) for r in LM.held_out_scores(table(spark, rows)).collect()]
    assert len(got) == len(rows)
    for r in got:
        assert r[2:5] == want[r[0]][:3] and r[5:] == pytest.approx(want[r[0]][3:])


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify(docs).first()["lang_pred"] == "und"
    assert language_id.identify(docs.limit(0)).count() == 0


def test_more_languages_than_bits():
    import numpy as np

    g, first = language_id.grams(np.frombuffer(b"abcdef", np.uint8), np.array([0, 6]))
    m = language_id.build([str(i) for i in range(70)], np.array([69] * len(g)), g)
    assert m.predict(np.frombuffer(b"abcdef", np.uint8), np.array([0, 6]))[0][0] == 69
