import numpy as np
import pytest

from featlake.operators import probes as P


def frames(spark, x, y):
    acts = [(i, f, float(v)) for i, r in enumerate(x) for f, v in enumerate(r) if v > 0]
    return (
        spark.createDataFrame(acts, "row_id long, feature int, value float"),
        spark.createDataFrame([(i, "c") for i, v in enumerate(y) if v], "row_id long, category string"),
        spark.createDataFrame([(i,) for i in range(len(x))], "row_id long"),
    )


def test_ties_go_to_smaller_feature(spark):
    p = P.select(*frames(spark, [[1, 1], [1, 1], [0.5, 0.5], [0, 0]], [1, 0, 1, 0])).first()
    assert (p["feature"], p["threshold"]) == (0, 0.5)


def test_held_out(spark):
    acts, member, rows = frames(spark, [[0.5], [0.49], [0]], [1, 1, 0])
    probe = spark.createDataFrame([("c", 0, 0.5)], "category string, feature int, threshold float")
    r = P.evaluate(probe, acts, member, rows).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (1, 1, 0, 1) and r["f1"] == pytest.approx(2 / 3)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 4, (20, 6)), rng.integers(0, 2, 20)
    y[0] = 1
    best = None
    for f in range(6):
        for t in sorted(set(x[:, f]) - {0}, reverse=True):
            on = x[:, f] >= t
            tp, fp, fn = int((on & (y == 1)).sum()), int((on & (y == 0)).sum()), int((~on & (y == 1)).sum())
            if tp:
                k = (-2 * tp / (2 * tp + fp + fn), -tp, fp, f, -t)
                best = k if best is None or k < best else best
    p = P.select(*frames(spark, x, y)).first()
    assert (p["feature"], p["threshold"], p["tp"]) == (best[3], -best[4], -best[1])


def test_split_needs_both(spark):
    with pytest.raises(ValueError):
        P.check_split(spark.createDataFrame([(1, "train")], "row_id long, split string"))
