"""G11 in batches against Spark's own function and a plain recurrence."""

import random

from pyspark.sql import functions as F

from pairlab.functions import chardist
from pairlab.functions import text as T


def plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        step = [i]
        for j, y in enumerate(b, 1):
            step.append(min(row[j] + 1, step[-1] + 1, row[j - 1] + (x != y)))
        row = step
    return row[-1]


def some_pairs() -> list[tuple[str, str]]:
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcé \U0001d4d0") for _ in range(n))
    sizes = (0, 1, 2, 30, 63, 64, 65, 127, 128, 129, 200)
    out = [(word(m), word(n)) for m in sizes for n in sizes]
    for _ in range(60):
        a = word(r.choice(sizes))
        b = list(a)
        for _ in range(r.randrange(6)):
            b[r.randrange(len(b) + 1):r.randrange(len(b) + 1)] = word(2)
        out.append((a, "".join(b)))
    return out


def test_batches_give_the_plain_distance(monkeypatch):
    pairs = some_pairs()
    want = [plain(a, b) for a, b in pairs]
    for words in (1, 1 << 8, 1 << 19):   # one pair a block, some, all
        monkeypatch.setattr(chardist, "BLOCK_WORDS", words)
        assert chardist.char_distances(*map(list, zip(*pairs))).tolist() == want


def test_column_is_batched_and_equals_sparks_function(spark):
    df = spark.createDataFrame([*some_pairs(), (None, "a"), ("a", None), (None, None)], "a string, b string")
    both = df.select("a", "b", T.char_edit_distance("a", "b").alias("d"), F.levenshtein("a", "b").alias("w"))
    assert both.where(~F.col("d").eqNullSafe(F.col("w"))).count() == 0
    assert "levenshtein" not in df.select(T.char_edit_distance("a", "b"))._jdf.queryExecution().optimizedPlan().toString()
