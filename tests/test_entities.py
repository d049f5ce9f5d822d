import random

import pandas as pd

from lictor.operators.entities import subsequence_lengths


def one_by_one(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_subsequences_of_many_pairs_at_a_time():
    rng = random.Random(2)
    draw = lambda most: "".join(rng.choice("ab c\U0001f600\0é") for _ in range(rng.randint(0, most)))
    texts = ["", "\0", "a\0", "x" * 64, "x" * 65, "ab" * 70, *(draw(12) for _ in range(40)), *(draw(90) for _ in range(20))]
    pairs = [(a, b) for a in texts for b in rng.sample(texts, 12)]
    found = subsequence_lengths(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert found.tolist() == [one_by_one(a, b) for a, b in pairs]
    assert subsequence_lengths(pd.Series([], dtype=object), pd.Series([], dtype=object)).tolist() == []
