import random

import pytest

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, n_removed int, kept string, block string"


def table(spark, rows):
    """Rows (doc_id, text) with further columns, some under the names of the operators' own."""
    return spark.createDataFrame([(d, t, "en", None, None, 7, "k", None) for d, t in rows], EXTRA)


@pytest.fixture(scope="session")
def corpus():
    """Texts with repeats of all kinds: copies, near copies, shared passages, periodic and very long texts, nulls, empties."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(80), prose(120)
    rows = [prose(rng.randint(1, 90)) for _ in range(40)]
    rows += [prose(20) + "\n" + passage + "\t" + prose(15) for _ in range(6)]
    rows += [base] * 4 + [base.replace(" ", "  ", 5)]
    for k in range(8):
        w = base.split()
        for _ in range(1 + k):
            w[rng.randrange(len(w))] = "edit" + str(k)
        rows.append(" ".join(w))
    rows += ["x " * 300, "ab" * 700, "", None, " \t\n ", "One", "One", "é à ü " * 40, prose(6000), None]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(3 * i - 20, rows[k]) for i, k in enumerate(order)]
