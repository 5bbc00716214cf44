"""Auto-correction against brute force."""

from __future__ import annotations

import random

from lodestone.operators import modules


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_autocorrect_finds_the_nearest_entry(spark):
    rng = random.Random(2)
    entries = ["PROMO BURNISHED BRASS", "", "a", "ab", *{"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(80)}]
    words = ["QROMO BURNISHED BRASX", "", "b", "xy", "xyz", *{"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 10))) for _ in range(150)}]
    got = modules.autocorrect(spark.createDataFrame([(w,) for w in set(words)], "word string"), "word", spark.createDataFrame([(e,) for e in set(entries)], "entry string"), "entry").collect()
    best = {w: min((edits(w, e), e) for e in entries) for w in words}
    assert {r.word: (r.edits, r.entry) for r in got} == {w: x for w, x in best.items() if x[0] <= 2}
    assert best[words[0]] == (2, entries[0])
