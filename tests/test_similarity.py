"""The ratio as column expressions, and the candidate search, against plain computations of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sirenflow.functions.fuzzy import indel
from sirenflow.operators import similarity


def _words(rng, n, lo, hi, letters="ABCé "):
    return ["".join(rng.choices(letters, k=rng.randint(lo, hi))) for _ in range(n)]


def test_ratio_is_that_of_the_plain_table(spark):
    rng = random.Random(1)
    rows = list(zip(_words(rng, 200, 0, 14), _words(rng, 200, 0, 14), strict=True)) + list(zip(_words(rng, 40, 55, 140), _words(rng, 40, 1, 140), strict=True))
    rows += [("a" * 62, "a" * 63), ("a" * 63, "a" * 62), ("ab" * 100, "ba" * 100), ("", ""), (None, "a"), ("a", None)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [(g.a, g.b) for g in got if g.r != (None if g.a is None or g.b is None else indel(g.a, g.b))] == []


@pytest.mark.parametrize("floor", [75, 85, 90])
def test_no_pair_of_near_names_is_lost(spark, floor):
    rng = random.Random(floor)
    known = _words(rng, 120, 1, 12, "ABCDE") + ["MAIN STREET NORTH " * 5]
    wanted = _words(rng, 60, 1, 12, "ABCDE") + ["MAIN STREET NORTH " * 5 + "X"]
    for k in known[:80]:  # misspelt copies
        at = rng.randrange(len(k))
        wanted.append(rng.choice([k[:at] + k[at + 1 :], k[:at] + "E" + k[at:], k[:at] + "A" + k[at + 1 :], k]))
    frame = lambda x, c: spark.createDataFrame([(v,) for v in [*x, None, ""]], f"{c} string")
    got = {tuple(r) for r in similarity.near_names(frame(wanted, "street"), frame(known, "known"), floor).collect()}
    assert got == {(w, k, indel(w, k)) for w in set(wanted) - {""} for k in set(known) if indel(w, k) >= floor}


def test_low_floors_are_refused(spark):
    with pytest.raises(ValueError):
        similarity.near_names(spark.createDataFrame([("a",)], "street string"), spark.createDataFrame([("a",)], "known string"), 60)
