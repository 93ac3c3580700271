"""End-to-end fit-and-predict (C1, C3, C4) as a driver loop over DataFrames.

Each outer iteration: ReliefF weights per unfinished group -> kNN graph inside
the groups -> bisection of every unfinished group -> stopping rule.  Lineage is
cut after each stage by writing the state (and the kNN table) as parquet into
the shared checkpoint folder, so a lost executor only recomputes the current
stage and the many scans of the state read only the columns they need.  A named run also
survives the loss of its driver: see ``resume``.  The loop body never collects rows; the driver
only reads scalars (is anything unfinished? the maximum group id).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame

from ..operators.bisect import DEFAULT_LOCAL_GROUP_ROWS, divide_groups
from ..operators.descent import LOCAL_ROWS, finish, neighbour_lists
from ..operators.knn import DEFAULT_BLOCK_ROWS, knn_exact
from ..operators.labels import assign_labels, class_weights
from ..operators.purity import compute_finished, init_state, is_finished
from ..operators.relief import weight_features
from ..operators.sizing import bounded
from ..session import (discard, load_manifest, read_reference, save_manifest, table_reference,
                       write_table)


@dataclass
class Params:
    """Parameters of :func:`classify` (defaults as in the reference)."""
    gini_impurity: float = 0.1
    k: int = 5                      # neighbours of the kNN graph; min group = 2k
    max_iter: int = 20              # outer iterations
    max_steps: int = 1000           # gradient steps per outer iteration
    max_stable: int = 10            # stable steps that freeze a group
    tol: float = 0.005              # sign-change ratio above which a step "changed"
    weight_features: bool = True
    relief_m: int | None = None     # probes per group (None = all labelled rows)
    relief_k: int = 3
    graph: str = "descent"          # "descent" (NN-Descent) or "exact"
    graph_max_iter: int = 5
    graph_early_termination: float = 0.001
    graph_sample_rate: float = 1.0
    graph_buckets: int = 2
    graph_pool: int | None = None   # NN-Descent working list (default 5k)
    seed: int = 0
    block_rows: int = DEFAULT_BLOCK_ROWS
    local_group_rows: int = DEFAULT_LOCAL_GROUP_ROWS
    validate: bool = False          # C3: assert the row count after every stage
    original_features: bool = False  # return the input's features, not the weighted ones


def build_knn(state: DataFrame, p: Params, iteration: int = 0, lists: DataFrame | None = None):
    """G1 on the unfinished rows: ``(id, nbr, grp, rank, dist, sim)``, and the neighbour lists behind it (None for
    the exact graph).

    ``lists`` of the iteration before seed NN-Descent: what of a row's list is still in its group is scored with the
    new features, and random rows of the group fill up the rest; buckets are only drawn for the first graph."""
    if p.graph == "exact":
        return knn_exact(state, p.k, p.block_rows), None
    if p.graph == "descent":
        pool = max(p.k, p.graph_pool or 5 * p.k)
        lists = neighbour_lists(
            state, pool, p.graph_max_iter, p.graph_early_termination, p.graph_sample_rate,
            p.graph_buckets if lists is None else 0, p.seed + iteration, p.block_rows, start=lists, stop_k=p.k,
            local_rows=LOCAL_ROWS if p.local_group_rows else 0)
        return finish(lists, p.k), lists
    raise ValueError(f"unknown graph method {p.graph!r}")


#: Parameters that may change between the parts of a resumed run.
FREE = ("max_iter", "validate", "original_features")


def _settings(p: Params) -> dict:
    return {k: v for k, v in asdict(p).items() if k not in FREE}


def classify(df: DataFrame, params: Params | None = None, resume: str | None = None, **overrides):
    """``(predictions, iterations)``.

    ``resume`` names a run.  After every iteration a manifest of the state and the neighbour lists is
    written beside the checkpoint folders (``<spark.checkpoint.dir>/runs/<name>``), and a call
    with the name of a run that was cut off goes on after its last whole iteration, in any application
    that sees that folder.  The input must be the same table; other parameters than ``FREE`` raise.

    With ``original_features`` the output carries the input's features instead of
    the weighted ones (a join on ``id``).

    ``df``: ``id bigint, features array<double>, label bigint`` (NULL label =
    unlabelled).  Output rows: ``id, features (weighted), label, grp, finished,
    prediction``.
    """
    p = replace(params or Params(), **overrides)
    weights = bounded(class_weights(df))
    if weights.isEmpty():
        raise ValueError("the input has no labelled row")
    spark = df.sparkSession
    last = load_manifest(spark, resume) if resume else None
    i, lists = 0, None
    if last is not None:
        i, manifest = last
        if manifest["settings"] != _settings(p):
            raise ValueError(f"run {resume!r} was begun with other parameters")
        state, lists = (read_reference(spark, manifest[k]) for k in ("state", "lists"))
    else:
        state = write_table(compute_finished(init_state(df), weights, p.gini_impurity, p.k), "state")
    n0 = df.count() if p.validate else None

    def check(frame, stage):
        if p.validate and frame.count() != n0:
            raise AssertionError(f"row count changed in {stage}")

    while i < p.max_iter and not is_finished(state):
        old = []                    # what the manifest before refers to goes after the next one is written
        if p.weight_features:
            weighted = write_table(weight_features(state, p.relief_m, p.relief_k, p.seed + i,
                                                   p.block_rows, p.local_group_rows), "weighted")
            old.append(state)
            state = weighted
            check(state, "feature weighting")
        knn, found = build_knn(state, p, i, lists)
        knn = write_table(knn, "knn")
        if lists is not None:
            old.append(lists)
        lists = found
        divided = divide_groups(state, knn, p.max_steps, p.max_stable, p.tol,
                                p.local_group_rows)
        old += [divided, knn]       # the tables that the division reads: the state and the new group of every row
        state = write_table(compute_finished(divided, weights, p.gini_impurity, p.k), "state")
        check(state, "graph division")
        i += 1
        if resume:
            save_manifest(spark, resume, i, {"settings": _settings(p), "state": table_reference(state),
                                             "lists": None if lists is None else table_reference(lists)})
        for table in old:
            discard(table)
    if p.validate and i < p.max_iter and not is_finished(state):   # C4
        raise AssertionError("loop ended with unfinished rows")
    out = assign_labels(state)
    if p.original_features:
        out = out.drop("features").join(df.select("id", "features"), "id").select(out.columns)
    return out, i
