import numpy as np
import pytest

from pulsegrid.operators.smoothing import smooth_states, transition_scores


def best_path(p, states, stay):
    """All transitions written out, whole-number scores."""
    unit = 1 << (states - 1).bit_length()
    e = np.round(np.log(p + 1e-8) * 1_000_000).astype(np.int64) * unit - np.arange(states)
    keep, move = transition_scores(states, stay)
    step = np.full((states, states), move)
    np.fill_diagonal(step, keep)
    v, back = e[0], []
    for row in e[1:]:
        options = v[:, None] + step
        back.append(options.argmax(axis=0))
        v = options.max(axis=0) + row
    path = [int(v.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("frames,per_block,levels", [(4096, 256, 1), (16, 3, 1), (5, 2, 2), (9, 4, 0)])
def test_path_does_not_depend_on_the_cut(spark, frames, per_block, levels):
    rng = np.random.default_rng(11)
    states = 6
    probs = {k: rng.dirichlet(np.ones(states) * 0.4, n) for k, n in (("a", 200), ("b", 37), ("c", 1))}
    rows = [(k, t, p.tolist()) for k, ps in probs.items() for t, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "k string, t bigint, p array<double>").repartition(5)
    got = smooth_states(df, ["k"], "t", "p", states, 0.9, frames, per_block, levels).collect()
    for key, p in probs.items():
        assert [r.state for r in sorted(got, key=lambda r: r.t) if r.k == key] == best_path(p, states, 0.9)


def test_silence_keeps_one_state(spark):
    df = spark.createDataFrame([("s", t, [0.5] * 4) for t in range(40)], "k string, t bigint, p array<double>")
    got = smooth_states(df, ["k"], "t", "p", 4, 0.9, 8, 2).collect()
    assert {r.state for r in got} == {0}


def test_levels_follow_the_longest_key(spark):
    """With few matrices allowed at the top, several levels are taken; the path stays the same."""
    rng = np.random.default_rng(6)
    rows = [(1, t, [float(v) for v in rng.dirichlet(np.ones(3))]) for t in range(400)] + [(2, 0, [0.2, 0.5, 0.3])]
    df = spark.createDataFrame(rows, "k int, t long, p array<double>").repartition(3)
    one = sorted(map(tuple, smooth_states(df, ["k"], "t", "p", 3, 0.9, 8, 2, levels=1).collect()))
    assert sorted(map(tuple, smooth_states(df, ["k"], "t", "p", 3, 0.9, 8, 2, top=3).collect())) == one and len(one) == 401
