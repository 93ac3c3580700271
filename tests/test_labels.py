"""Majority label (table F6), seed signs (F7), class weights."""
import pytest

from graphssl.operators.labels import assign_labels, class_weights, seed_signs

N = None
MAJORITY = [
    ({0: [0, N, N]}, {0: 0}),
    ({0: [0, 0, N]}, {0: 0}),
    ({0: [0, 0, 0]}, {0: 0}),
    ({0: [0, 1, N]}, {0: 0}),          # tie -> smaller label
    ({0: [0, N, N, 1, N, 0]}, {0: 0}),
    ({0: [0, N, N], 1: [1, N, N]}, {0: 0, 1: 1}),
    ({0: [3, 2, 2, 3, N]}, {0: 2}),
]


def _rows(groups, finished=()):
    rows, i = [], 0
    for g, labels in groups.items():
        for lab in labels:
            rows.append((i, lab, g, (g, lab) in finished))
            i += 1
    return rows


@pytest.mark.parametrize("groups,expected", MAJORITY)
def test_majority(spark, groups, expected):
    df = spark.createDataFrame(_rows(groups), "id bigint, label bigint, grp bigint, finished boolean")
    out = assign_labels(df).collect()
    assert len(out) == df.count()
    assert all(r.prediction == expected[r.grp] for r in out)


SIGNS = [
    ({0: [0, 1, 2]}, set(), {(0, 0): 1.0, (0, 1): -1.0, (0, 2): 1.0}),
    ({0: [1, 0, 2]}, set(), {(0, 0): 1.0, (0, 1): -1.0, (0, 2): 1.0}),
    ({0: [0, 1, 2] * 6 + [0, 1]}, set(), {(0, 0): 1.0, (0, 1): -1.0, (0, 2): 1.0}),
    ({0: [0, 1, 1, 2, 3, 2]}, set(), {(0, 0): 1.0, (0, 1): -1.0, (0, 2): 1.0, (0, 3): -1.0}),
    ({0: [0, 1, 2, 3, 4]}, {(0, 1), (0, 4)}, {(0, 0): 1.0, (0, 2): -1.0, (0, 3): 1.0}),
    ({0: [0, 3, 4], 1: [1, 2, 5]}, set(),
     {(0, 0): 1.0, (0, 3): -1.0, (0, 4): 1.0, (1, 1): 1.0, (1, 2): -1.0, (1, 5): 1.0}),
    ({0: [0, 1, 3, 4], 1: [1, 2, 5]}, set(),
     {(0, 0): 1.0, (0, 1): -1.0, (0, 3): 1.0, (0, 4): -1.0, (1, 1): 1.0, (1, 2): -1.0, (1, 5): 1.0}),
]


@pytest.mark.parametrize("groups,finished,expected", SIGNS)
def test_seed_signs(spark, groups, finished, expected):
    df = spark.createDataFrame(_rows(groups, finished),
                               "id bigint, label bigint, grp bigint, finished boolean")
    got = {(r.grp, r.label): r.sign for r in seed_signs(df).collect()}
    assert got == expected


def test_class_weights(spark):
    df = spark.createDataFrame([(i, l) for i, l in enumerate([0, 0, 0, 1, None])], "id bigint, label bigint")
    got = {r.label: r.weight for r in class_weights(df).collect()}
    assert got == pytest.approx({0: 4 / 6, 1: 4 / 2})
