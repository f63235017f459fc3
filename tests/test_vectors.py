import math
import random

from codeloom.operators import vectors as V
from codeloom.plans import registry


def test_every_fiftieth_vector_is_a_query(spark, monkeypatch):
    monkeypatch.setattr(V, "VECTORS", 64)
    rng = random.Random(3)
    some = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(150)]
    rows = [(i, some[i % 150] if i % 7 else some[0]) for i in range(400)] + [(400, None), (450, [0.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).createOrReplaceTempView("embeddings")
    exact = [(r.vec_id, list(map(float, r.embedding))) for r in spark.table("embeddings").collect() if r.embedding and any(r.embedding)]
    got = sorted(map(tuple, registry.vector_search_all(spark).collect()))
    want = []
    for q, y in exact:
        if q % 50 == 0:
            cosine = [(-min(1.0, sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))), v) for v, x in exact]
            want += [(q, v, round(-s, 4)) for s, v in sorted(cosine)[:20]]
    assert len(got) == 160 and got == sorted(want)
