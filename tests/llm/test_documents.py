"""Operators 2, 3, 7, 8 and the pipeline against brute force."""

import hashlib
import re
from collections import Counter

import pytest

from tests.llm.conftest import table
from tideline.llm import licenses
from tideline.llm.decontaminate import contained, drop_contaminated
from tideline.llm.near_dedup import near_duplicates
from tideline.llm.spot_signatures import COMMON_WORDS, fingerprint_report, similar_fingerprints


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components_by_hand(rows, n, percent=80):
    sets = {d: shingles(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, corpus, size):
    got = {r[0]: tuple(r)[1:] for r in near_duplicates(table(spark, corpus), shingle=size).collect()}
    assert got == components_by_hand(corpus, size)


def test_chains_are_followed_where_no_band_leader_is_linked(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(12):  # each differs from the next a little, from far ones a lot
        base[5 * k : 5 * k + 2] = [f"n{k}a", f"n{k}b"]
        rows.append((100 - k, " ".join(base)))
    rows += [(None, "a b c"), (7, None), (8, "x"), (8, "x")]
    got = sorted(((r[0], *tuple(r)[1:]) for r in near_duplicates(table(spark, rows), shingle=2).collect() if r[0] not in (None, 7, 8)))
    assert got == sorted((d, *v) for d, v in components_by_hand(rows[:12], 2).items())
    assert near_duplicates(table(spark, [])).count() == 0


def test_fingerprints(spark, corpus):
    rows = [(d, t or "") for d, t in sorted(corpus)]
    got = {r["doc_id"]: r for r in fingerprint_report(table(spark, corpus)).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        after, q = rows[(i + 1) % len(rows)], len(t) // 4
        edited = t[: len(t) - q] + after[1][:q]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, other, near = (set(re.findall("." * 16, x)) for x in (r["fingerprint"], got[after[0]]["fingerprint"], r["edited_fingerprint"]))
        likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert r["near_next"] == pytest.approx(likeness(own, other)) and r["near_edited"] == pytest.approx(likeness(own, near))
    same = [r["fingerprint"] for d, r in got.items() if dict(rows)[d] == dict(rows)[min(d for d, t in rows if t.startswith("One"))]]
    assert len(set(same)) == 1


def spots_by_hand(text):
    """Spot signatures: the next two content words after each common word, with the common words between them."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    common, found = set(COMMON_WORDS), set()
    spots = 0
    for i, w in enumerate(words):
        content = [k for k in range(i + 1, len(words)) if words[k] not in common][:2] if w in common else []
        if len(content) == 2:
            spots += 1
            found.add(" ".join(words[i + 1 : content[1] + 1]) + " ")
    return found | set(words) if 8 * spots < len(words) or len(words) < 3 else found


def test_fingerprints_are_the_spot_signatures(spark):
    texts = ["The cat sat on the warm mat and the dog slept in a big red box by the door of the house", "x y", "", None, "12 34 the 56", "el niño y la niña van al parque con su perro", "rows of a table 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20", "the the the end of it all comes in the end to a stop"]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint_report(table(spark, list(enumerate(texts)))).collect()}
    for d, t in enumerate(texts):
        spots = spark.createDataFrame([(x,) for x in spots_by_hand(t)] or [("",)], "s string").selectExpr("xxhash64(s) AS h")
        want = sorted(r["h"] for r in spots.collect()) if spots_by_hand(t) else []
        assert got[d] == "".join(f"{h % (1 << 64):016x}" for h in want), t
    assert len(got[0]) > 16 * 5


def test_neighbours_by_id_where_a_few_ids_lie_far_off(spark, monkeypatch):
    from tideline.llm import spot_signatures

    monkeypatch.setattr(spot_signatures, "BIN_ROWS", 4)
    ids = [*range(300), 2**62, -(2**62), 2**62 + 5, *range(10**6, 10**6 + 80)]
    rows = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    most = spot_signatures.binned(rows).groupBy("bin").count().agg({"count": "max"}).first()[0]
    assert most <= 64
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint_report(rows).collect()}
    order = sorted(ids)
    for i, d in enumerate(order):
        t, after = f"text {d}", f"text {order[(i + 1) % len(order)]}"
        q = len(t) // 4
        assert got[d] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()


def test_fingerprints_of_few_rows(spark):
    (r,) = fingerprint_report(table(spark, [(1, "The cat sat on the warm mat")])).collect()
    assert r["near_next"] == 1
    assert fingerprint_report(table(spark, [])).count() == 0
    rows = [(5, "b the c d e"), (5, "a the c d e"), (None, "of the x y z")]
    assert fingerprint_report(table(spark, rows)).count() == 3


def test_similar_fingerprints(spark, corpus):
    pairs, members = similar_fingerprints(table(spark, corpus), threshold=0.6)
    prints = {r["doc_id"]: frozenset(re.findall("." * 16, r["fingerprint"])) for r in fingerprint_report(table(spark, corpus)).collect()}
    reps = {r["doc_id"]: r["rep"] for r in members.collect()}
    assert set(reps) == {d for d, p in prints.items() if p} and all(prints[d] == prints[m] for d, m in reps.items())
    kinds = sorted(set(reps.values()))
    want = {(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :] if len(prints[a] & prints[b]) >= 0.6 * len(prints[a] | prints[b])}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want


def test_contained(spark, corpus):
    texts = dict(corpus)
    long = next(t for t in texts.values() if t and len(t) > 20_000)
    w = long.split()
    items = [(1, " ".join(w[100:140])), (2, " ".join(w[5000:5030]).upper()), (3, " ".join([*w[200:230], "other", "words"])), (4, " ".join(w[i] for i in range(0, 60, 2))), (5, None), (6, ""), (7, "One"), (8, " ".join(w[10:14]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in contained(table(spark, corpus), bench).collect()}
    want = set()
    for d, t in corpus:
        for i, x in items:
            s = shingles(x, 5)
            both = len(s & shingles(t, 5))
            if s and 100 * both >= 80 * len(s):
                want.add((d, i, both, len(s)))
    assert got == want and {1, 2, 3} <= {g[1] for g in got}
    clean = drop_contaminated(table(spark, corpus), bench)
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - {g[0] for g in got} and clean.columns == table(spark, []).columns
    assert contained(table(spark, []), bench).count() == 0 and contained(table(spark, corpus), bench.limit(0)).count() == 0


def dice(a, b):
    pairs = lambda t: {tuple(x) for x in zip(t, t[1:], strict=False)}
    x, y = (pairs(re.findall(r"[a-z0-9]+", v.lower())) for v in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0


def test_licenses(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    texts = [(1, "Some prose.\nReleased under the MIT License.\nMore prose."), (2, "/* " + mit.replace(", ", ",\n * ") + " */"), (3, "Licensed under CC BY-NC 4.0"), (4, "nothing here at all"), (5, None), (6, ""), (7, "x\n\n" + mit[:400].replace(" the ", "\nthe ") + "\n\ny z")]
    got = {(r["doc_id"], r["level"], r["line"]): (r["license"], r["dice"]) for r in licenses.scan(table(spark, texts)).collect()}
    want = {}
    for d, t in texts:
        lines = (t or "").split("\n")
        segments = [("line", i, x) for i, x in enumerate(lines)]
        blocks, at = [], 0
        for part in re.split(r"\n(?:[^A-Za-z0-9\n]*\n)+", t or ""):
            start = (t or "").find(part, at)
            at = start + len(part)
            rows = [x for x in part.split("\n") if re.search(r"[A-Za-z0-9]", x)]
            if rows:
                blocks.append((t[:start].count("\n"), part, len(rows)))
        segments += [("paragraph", i, x) for i, x, n in blocks if n > 1]
        segments += [("document", blocks[0][0], t)] if len(blocks) > 1 else []
        for level, i, x in segments:
            scores = [dice(x, y) for _, y in licenses.TEMPLATES]
            if max(scores) >= 0.8:
                want[d, level, i] = (licenses.TEMPLATES[scores.index(max(scores))][0], pytest.approx(max(scores)))
    assert got == want and {k[0] for k in got} >= {1, 2, 3}
    assert licenses.scan(table(spark, [])).count() == 0


def test_pipeline_stages(spark, corpus, tmp_path):
    import corpus_pipeline as C

    docs = table(spark, corpus).select("doc_id", "text", "lang", "source", "n_chars")
    item = next(t for t in dict(corpus).values() if t and len(t) > 20_000).split()[50:90]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    texts = dict(corpus)
    one = C.identify_language(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in one.collect()} == {d for d, t in corpus if re.search(r"[^\W\d_]", t or "")} and one.columns == docs.columns
    two = C.drop_near_duplicates(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in two.collect()} == {d for d, v in components_by_hand(corpus, 5).items() if v[2]} and two.columns == docs.columns
    three = C.cut_passages(spark, docs, str(tmp_path))
    assert three.columns == docs.columns and three.count() == len(texts)
    four = C.decontaminate(spark, docs, str(tmp_path))
    assert four.count() == len(texts) - 1 and four.columns == docs.columns
    out = C.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} <= set(texts) and out.count() > 20
    assert [name for name, _ in C.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]


def test_contained_of_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    item = " ".join(f"w{i}" for i in range(5, 25))
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, "x y z")], "item_id long, text string")
    docs = table(spark, [(5, text), (5, text), (None, text), (6, "w1"), (6, None)])
    got = Counter((r["doc_id"], r["item_id"]) for r in contained(docs, bench).collect())
    assert got == {(5, 1): 4, (5, None): 2, (None, 1): 2, (None, None): 1}
    assert sorted((r["doc_id"], r["text"]) for r in drop_contaminated(docs, bench).collect() if r["text"]) == [(6, "w1")]


def test_many_blocks_of_items_are_looked_up_in_several_passes(spark, monkeypatch):
    from tideline.llm import decontaminate

    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 2)
    words = [f"w{i}" for i in range(400)]
    bench = spark.createDataFrame([(i, " ".join(words[10 * i : 10 * i + 10])) for i in range(20)], "item_id long, text string")
    docs = table(spark, [(i, " ".join(words[20 * i : 20 * i + 20])) for i in range(20)])
    assert sorted(r["doc_id"] for r in drop_contaminated(docs, bench).collect()) == list(range(10, 20))
    assert contained(docs, bench).count() == 20


def test_licenses_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License."), (None, None)]
    got = [(r["doc_id"], r["license"]) for r in licenses.scan(table(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "MIT"), (1, "MIT"), (None, "MIT")]))


def test_near_duplicates_under_one_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(3, text), (3, other), (8, text + " x"), (9, other + " x"), (4, None), (4, None)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(table(spark, rows), shingle=2).collect())
    assert got == [(3, 3, True), (3, 3, True), (4, 4, True), (4, 4, True), (8, 3, False), (9, 3, False)]


def test_components_in_rounds_and_in_one_task(spark, monkeypatch):
    import random

    from tideline.llm import _graph

    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 420)] + [(500, i) for i in range(501, 560)]
    df = spark.createDataFrame(links, "a long, b long").where("a <> b").repartition(3)
    one = sorted(map(tuple, _graph.components(df).collect()))
    monkeypatch.setattr(_graph, "ONE_TASK", 3)
    assert sorted(map(tuple, _graph.components(df).collect())) == one
    monkeypatch.setattr(_graph, "HELD", 10)
    forest = df.mapInArrow(_graph.forest, "a long, b long")
    assert sorted(map(tuple, _graph.components(forest).collect())) == one and forest.count() <= df.count()


def test_large_groups_of_near_copies_are_compared_in_blocks(spark, monkeypatch):
    import random

    from tideline.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 16)):
            w[rng.randrange(80)] = f"e{d}_{rng.randrange(99)}"
        rows.append((d, " ".join(w)))
    rng.shuffle(rows)
    got = {r[0]: tuple(r)[1:] for r in near_duplicates(table(spark, rows).repartition(4), shingle=2).collect()}
    want = components_by_hand(rows, 2)
    assert got == want and 1 < len({v[1] for v in want.values()}) < 100


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_without_rows_labels_or_lengths(spark, tmp_path):
    import corpus_pipeline as C

    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.createDataFrame([], COLUMNS)
    for name, stage in C.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    rows = [(1, "some text here", None, "a", 14), (2, "12 34", None, None, 5), (None, "another text there", None, "b", 18), (None, None, None, None, None), (3, "", None, None, 0), (1, "some text here", None, "a", 14)]
    docs = spark.createDataFrame(rows, COLUMNS)
    assert C.identify_language(spark, docs, str(tmp_path)).count() == len(rows)  # no labels: nothing is rejected
    for name, stage in C.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect())) and out.columns == docs.columns, name
    bare = docs.drop("n_chars")
    assert C.cut_passages(spark, bare, str(tmp_path)).columns == bare.columns
    labelled = spark.createDataFrame([(d, t, "en" if t and d else None, s, n) for d, t, _, s, n in rows], COLUMNS)
    assert sorted(str(r["doc_id"]) for r in C.identify_language(spark, labelled, str(tmp_path)).collect()) == ["1", "1", "None"]


def test_pipeline_with_clashing_columns_and_repeated_rows(spark, corpus, tmp_path):
    import corpus_pipeline as C
    from tideline.llm._shared import stored

    rows = [(d, t, "en", "s", len(t) if t is not None else None, 1, "k", 2) for d, t in corpus] + [(9000, "a row that is there two times " * 3, "en", "s", 90, 1, "k", 2)] * 2
    docs = spark.createDataFrame(rows, COLUMNS + ", n_removed int, kept_text string, component_id long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in C.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.where("n_removed <> 1 OR kept_text <> 'k' OR component_id <> 2").count() == 0, name
    before = stored()
    out = C.run(spark, str(tmp_path))
    assert out.where("doc_id = 9000").count() == 2
    assert stored() - before == {out._tideline_path}
