import random

import pytest

from geoloom.operators.graph import connected_components


def truth(edges):
    p = {}

    def find(a):
        p.setdefault(a, a)
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return a

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in p}


R = random.Random(5)
SHAPES = {
    "path": [(i, i + 1) for i in range(200)],
    "star": [(500, i) for i in range(300)],
    "ring": [(i, (i + 1) % 50) for i in range(50)],
    "random": [(R.randrange(300), R.randrange(300)) for _ in range(250)],
    "pairs and loops": [(2 * i, 2 * i + 1) for i in range(40)] + [(999, 999), (5, 5)],
    "repeats and nulls": [(1, 2), (2, 1), (1, 2), (None, 3), (4, None), (7, 8)],
    "empty": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components(spark, shape):
    got = connected_components(spark.createDataFrame(SHAPES[shape], "u bigint, v bigint"))
    assert {tuple(r) for r in got.collect()} == truth(SHAPES[shape])


def test_string_vertices_and_other_names(spark):
    got = connected_components(spark.createDataFrame([("b", "a", 1), ("c", "b", 2)], "x string, y string, p int"), "x", "y")
    assert {tuple(r) for r in got.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
