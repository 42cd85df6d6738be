"""Labels whose vectors lie in a cone: links are found all the same."""

import numpy as np

from savora.llm import embedding_dedup
from tests.llm.test_operators import vector_wanted


def cone(n, pairs, mean, seed):
    """n vectors of 48 components at about the mean cosine, and for each of the first pairs one at about 0.981 from it."""
    rng = np.random.default_rng(seed)
    centre = np.zeros(48)
    centre[0] = np.sqrt(mean)
    own = rng.normal(size=(n, 48)) / np.sqrt(48) * np.sqrt(1 - mean) + centre
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    side = rng.normal(size=(pairs, 48))
    side -= (side * own[:pairs]).sum(axis=1, keepdims=True) * own[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return np.concatenate([own, 0.981 * own[:pairs] + np.sqrt(1 - 0.981**2) * side])


def test_links_in_a_cone(spark):
    rows = [(k, v.tolist(), 1) for k, v in enumerate(cone(900, 150, 0.9, 11))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_vectors(df, block=16).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == vector_wanted(rows)
