"""What the driver holds while the quality classifier is fitted: the sample without its zeros."""

import tracemalloc

import numpy as np

from tessera.llm import quality


def test_fitting_holds_no_sample_filled_up_with_zeros(spark):
    rng, n = np.random.default_rng(5), 2 * quality.SAMPLE
    words = [f"w{i}" for i in range(5000)]
    rows = [(i, " ".join(words[k] for k in rng.integers(0, len(words), 12)) + " ###" * (i % 2)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(n)], "doc_id long, label int")
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        model = quality.fit(docs, labels)
        most = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert len(model.labels) == quality.SAMPLE
    assert most < quality.SAMPLE * quality.WIDTH * 4 / 2  # filled up, the sample alone takes twice that


def test_rows_without_zeros_give_the_space_of_filled_ones():
    rng = np.random.default_rng(6)
    counts = rng.poisson(0.02, (quality.PART + 70, quality.WIDTH)).astype(np.float32)
    labels, df = rng.integers(0, 2, len(counts)), (counts > 0).sum(0)
    sparse = quality.Sparse(quality.nonzero(counts))
    assert (sparse[10:20] == counts[10:20]).all() and (sparse[quality.PART :] == counts[quality.PART :]).all()
    a, b = quality.Model(counts, labels, df, len(counts)), quality.Model(sparse, labels, df, len(counts))
    assert (a.space == b.space).all() and (a.vectors == b.vectors).all()
    # Right singular vectors of the whole matrix: the same subspace as a plain decomposition's, where values stand out.
    x = quality.weighed(counts, a.idf)
    assert np.allclose(a.space.T @ a.space, np.eye(quality.LATENT), atol=1e-4)
    assert np.allclose(quality.unit(x @ a.space), a.vectors, atol=1e-4)
