import brute  # noqa: F401
import numpy as np

from lumidex.llm import ann


def test_recall_in_a_group_of_nearly_equal_vectors(spark):
    """A third of the rows differ by less than a grid cell and share their keys on most curves."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4500, 16))
    group = rng.permutation(4500)[:1500]
    x[group] = x[group[0]] + 1e-6 * rng.standard_normal((1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in (int(g) for g in group if g % 50 == 0):
        apart = ((u - u[i]) ** 2).sum(axis=1)
        apart[i] = 9
        want |= {(i, int(j)) for j in np.argsort(apart)[:5]}
    got = {(r.query_id, r.vec_id) for r in ann.neighbours(df, 50, 5).collect()}
    recall = len(want & got) / len(want)
    print("recall", recall)
    assert recall >= 0.9
