"""Vector search by products of blocks against all pairs."""

import math
import random

import pytest
from inkwell.operators import vectors

STORE = "namespace string, id {}, embedding array<float>, metadata map<string,string>"
ASKED = "query_id long, namespace string, query_vector array<double>"


def cosine(a, b):
    if not a or not b or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in [*a, *b]):
        return None
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / size if size else None


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("most", [0, 1000])
def test_top_k_equals_all_pairs(spark, monkeypatch, kind, most):
    """A namespace with most rows, copies that tie, other dimensions and vectors without a direction."""
    monkeypatch.setattr(vectors, "SCORES_AT_ONCE", 64)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    r = random.Random(11)
    base = [[float(r.randrange(-3, 4)) for _ in range(4)] for _ in range(12)]
    name = lambda i: i if kind == "long" else f"v{i}"
    store = [(r.choice(["a", "a", "a", "b"]), name(i), r.choice(base), {"source": str(i % 2)}) for i in range(300)]
    store += [("a", name(900), None, {}), ("a", name(901), [0.0] * 4, {}), ("a", name(902), [1.0, None, 0.0, 0.0], {}), ("a", name(903), [float("nan")] * 4, {}), ("a", name(904), [1.0, 2.0], {}), (None, name(905), base[0], {}), ("c", name(906), base[1], {})]
    asked = [(q, r.choice(["a", "a", "b", "d"]), r.choice(base)) for q in range(25)] + [(90, "a", [1.0, 1.0]), (91, "a", None), (92, "a", [0.0] * 4), (93, None, base[0])]
    expected = {}
    for q, n, v in asked:
        scored = [(-round(c, 9), i) for m, i, e, _ in store if m == n and n is not None and (c := cosine(v, e)) is not None]
        expected |= {(q, k): x for k, x in enumerate(sorted(scored)[:5], 1)}
    frames = spark.createDataFrame(asked, ASKED), spark.createDataFrame(store, STORE.format(kind)).repartition(4)
    got = {(x.query_id, x["rank"]): (-round(x.score, 9), x.id) for x in vectors.vector_top_k(*frames, 5, max_broadcast_queries=most).collect()}
    assert got == expected and len(expected) > 80
    few = vectors.vector_top_k(*frames, 3, threshold=0.5, filters={"source": "1"}, max_broadcast_queries=most).collect()
    assert all(x.score >= 0.5 and int(str(x.id).lstrip("v")) % 2 == 1 for x in few)


def test_nothing_to_search(spark):
    empty = spark.createDataFrame([], ASKED), spark.createDataFrame([], STORE.format("long"))
    assert vectors.vector_top_k(*empty).count() == 0 and vectors.vector_top_k(*empty, max_broadcast_queries=-1).count() == 0
