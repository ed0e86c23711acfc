"""Sets of sound-event vectors larger than a block, against a plain loop."""

import numpy as np

from vocalith.operators import similarity as S


def test_large_sets_meet_block_by_block(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=(150, 7)).round(3), r.normal(size=(70, 7)).round(3)
    a[3], b[5] = 0.0, 2.0  # no length, no spread
    rows = lambda x: spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "pair_id long, seq long, v array<double>")
    assert S._blocks(rows(a), ["pair_id"]).count() == 3
    got = S.sound_event_comparison(rows(a), rows(b), ["pair_id"]).first()
    cos = lambda x, y: x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) if np.linalg.norm(x) and np.linalg.norm(y) else 0.0
    centred = lambda x: x - x.mean()
    assert abs(got["mean_cosine"] - cos(a.mean(0), b.mean(0))) < 1e-9
    assert abs(got["max_cosine"] - max(cos(x, y) for x in a for y in b)) < 1e-9
    assert abs(got["mean_correlation"] - np.mean([cos(centred(x), centred(y)) for x in a for y in b])) < 1e-9
