"""How many linked vectors a dense topic hides."""

import numpy as np

from fieldproof.llm import embedding_dedup
from test_operators import smallest_reachable


def test_dense_topic_of_embeddings(spark):
    """Pairs at 0.95 to 0.96 among thousands of neighbours at about 0.8 that are not linked."""
    rng = np.random.default_rng(3)
    dim, n = 32, 6000
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(np.sqrt(0.8) * unit(rng.standard_normal(dim)) + np.sqrt(0.2) * unit(rng.standard_normal((n, dim))))
    off = rng.standard_normal((200, dim))
    off = unit(off - (off * x[:200]).sum(axis=1, keepdims=True) * x[:200])
    near = 0.953 * x[:200] + np.sqrt(1 - 0.953**2) * off
    v = np.concatenate([x, near])
    s = v @ v.T >= 0.95
    np.fill_diagonal(s, False)
    want = smallest_reachable(range(len(v)), [(int(a), int(b)) for a, b in zip(*np.nonzero(s), strict=True)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(df, window=16).collect()}
    lost = sum(got[i] != want[i] for i in want)
    print("not in their component:", lost, "of", sum(want[i] != i for i in want), "that have a smaller one")
    assert lost <= 2
