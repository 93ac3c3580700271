"""A named run of the classifier goes on where its driver was lost."""
import uuid

import pytest

from fixture_paths import IRIS
from graphssl.plans import classifier
from graphssl.plans.classifier import Params, classify
from graphssl.session import load_manifest, save_manifest
from graphssl.sources.loaders import load_iris

P = Params(gini_impurity=0.02, k=5, max_iter=2, block_rows=64, max_steps=20, weight_features=False)


def rows(out):
    return sorted((r["id"], r["label"], r["grp"], r["finished"], r["prediction"]) for r in out.select(
        "id", "label", "grp", "finished", "prediction").na.fill({"label": -1}).collect())


@pytest.mark.parametrize("graph", ["exact", "descent"])
def test_resume_after_a_lost_driver(spark, monkeypatch, graph):
    inp, _ = load_iris(spark, IRIS, 0, 8)
    whole, n = classify(inp, P, graph=graph)
    assert n >= 2
    divide, calls = classifier.divide_groups, []

    def lost(*a, **k):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return divide(*a, **k)

    name = f"resume-{graph}-{uuid.uuid4().hex}"       # a checkpoint folder may outlive the test
    monkeypatch.setattr(classifier, "divide_groups", lost)
    with pytest.raises(RuntimeError, match="lost"):
        classify(inp, P, resume=name, graph=graph)
    step, manifest = load_manifest(spark, name)
    assert step == 1 and (manifest["lists"] is None) == (graph == "exact")

    with pytest.raises(ValueError):
        classify(inp, P, resume=name, graph=graph, k=7)
    calls[:] = [0, 0]
    out, iterations = classify(inp, P, resume=name, graph=graph)
    assert iterations == n and len(calls) == 2 + n - 1        # the first iteration is not run again
    assert rows(out) == rows(whole)
    again, iterations = classify(inp, P, resume=name, graph=graph)             # a finished run is read
    assert iterations == n and len(calls) == 2 + n - 1 and rows(again) == rows(whole)


def test_manifests(spark):
    assert load_manifest(spark, "no-such-run") is None
    name = f"manifests-{uuid.uuid4().hex}"
    save_manifest(spark, name, 1, {"a": 1})
    save_manifest(spark, name, 2, {"a": 2})
    assert load_manifest(spark, name) == (2, {"a": 2})
    with pytest.raises(RuntimeError):
        save_manifest(spark, name, 2, {"a": 3})
    assert load_manifest(spark, name) == (2, {"a": 2})
    for bad in ("", "a/b", ".."):
        with pytest.raises(ValueError):
            load_manifest(spark, bad)
