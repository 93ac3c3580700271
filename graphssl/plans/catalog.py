"""Registered queries over the driver tables (one per operator of the survey).

Fixture: the whole ``embeddings`` table -- ``id = vec_id``, 64 float features
cast to double, ``correct_label = label``; the label is *kept* for rows with
``pmod(id, 100) < 20`` (S8, oracle-friendly variant) and masked otherwise;
``grp = pmod(id, 4)`` gives a multi-group state, ``pmod(id, 64)`` a state with
small groups that exercises every branch of the stopping rule.  Every row of
the table takes part in every query.

Outputs round doubles to 6 digits and add ``0.0`` (no ``-0.0``) so that value
hashes compare exactly with the SQL oracle in :mod:`graphssl.plans.oracle`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import graph as G
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import purity as P
from ..operators import relief as R
from ..operators.bisect import bisect_distributed, build_graph, divide_groups, score_groups
from ..operators.descent import knn_descent, knn_lsh
from ..operators.knn import knn_exact
from ..session import ensure_checkpoint_dir, write_table
from ..sources.loaders import load_embeddings, load_emnist, mask_labels, read_graph, write_predictions
from .classifier import Params, classify

# Fixed parameters of the registered queries.
K = 5              # kNN graph
RELIEF_K = 3       # ReliefF hits/misses per class
GINI = 0.1
FINE_GROUPS = 64
FINE_GINI = 0.5
FINE_K = 3
STEPS = 3          # bisect_3_steps checks single steps; the loop itself is bisect_converged
STABLE = 2         # stable steps that freeze a group, so groups freeze at different steps
SAMPLE_M, SAMPLE_SEED = 10, 7
PIVOT_ROWS = 64    # rows per cell
RECALL_BOUND = 0.95  # fixed value: the reference's bound on shared neighbours


def r6(col) -> "F.Column":
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6) + F.lit(0.0)


def base(spark: SparkSession, sf_dir: str, groups: int = 4) -> DataFrame:
    e = load_embeddings(spark, sf_dir)
    e = mask_labels(e, 0, 20, by="id")
    return e.withColumn("grp", F.pmod(F.col("id"), F.lit(groups)).cast("bigint")) \
        .withColumn("finished", F.lit(False))


def binary_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_embeddings(spark, sf_dir).withColumn(
        "correct_label", F.pmod(F.col("correct_label"), F.lit(2)).cast("bigint"))
    e = mask_labels(e, 0, 20, by="id")
    return e.withColumn("grp", F.pmod(F.col("id"), F.lit(4)).cast("bigint")) \
        .withColumn("finished", F.lit(False))


# --- sources / labels / purity ---------------------------------------------

def q_label_mask(spark, sf):
    return base(spark, sf).select("id", "correct_label", "label", "grp")


def q_label_histogram(spark, sf):
    return L.label_histogram(base(spark, sf))


def q_class_weights(spark, sf):
    return L.class_weights(base(spark, sf)).select("label", "n", r6("weight").alias("weight"))


def q_group_counts(spark, sf):
    return P.group_stats(base(spark, sf), L.class_weights(base(spark, sf))).select(
        "grp", "n_unlabelled", "n_labelled")


def q_group_mass(spark, sf):
    b = base(spark, sf)
    return P.group_label_mass(b, L.class_weights(b)).select("grp", "label", "n", r6("mass").alias("mass"))


def q_group_purity(spark, sf):
    b = base(spark, sf)
    return P.group_stats(b, L.class_weights(b)).select(
        "grp", r6("mass").alias("mass"), r6("purity").alias("purity"),
        r6("impurity").alias("impurity"))


def _finished_cols(df):
    return df.select("grp", "n_unlabelled", "n_labelled", r6("impurity").alias("impurity"),
                     "finished")


def q_group_finished(spark, sf):
    b = base(spark, sf)
    return _finished_cols(P.group_finished(b, L.class_weights(b), GINI, K))


def q_stop_rule_fine(spark, sf):
    b = base(spark, sf, FINE_GROUPS)
    return _finished_cols(P.group_finished(b, L.class_weights(b), FINE_GINI, FINE_K))


def _fine_state(spark, sf):
    b = base(spark, sf, FINE_GROUPS)
    return P.compute_finished(b, L.class_weights(b), FINE_GINI, FINE_K)


def q_all_finished(spark, sf):
    return P.all_finished_frame(_fine_state(spark, sf))


# --- ReliefF ------------------------------------------------------------------

def q_relief_ranges(spark, sf):
    r = R.feature_ranges(R.labelled_rows(base(spark, sf)))
    return r.select("grp", F.col("pos").cast("bigint").alias("pos"), r6("min").alias("min"),
                    r6("max").alias("max"), r6("range").alias("range"))


def q_relief_priors(spark, sf):
    return R.class_priors(R.labelled_rows(base(spark, sf))).select(
        "grp", "label", "n", r6("prior").alias("prior"))


def _relief_nbrs(spark, sf):
    lab = R.labelled_rows(base(spark, sf))
    rng = R.range_vectors(R.feature_ranges(lab))
    return R.relief_neighbours(lab, lab, rng, RELIEF_K)


def q_relief_hits(spark, sf):
    n = _relief_nbrs(spark, sf).where(F.col("clabel") == F.col("qlabel"))
    return n.select("grp", F.col("qid").alias("probe"), F.col("cid").alias("nbr"),
                    F.col("rank").cast("bigint").alias("rank"), r6("dist").alias("dist"))


def q_relief_misses(spark, sf):
    n = _relief_nbrs(spark, sf).where(F.col("clabel") != F.col("qlabel"))
    return n.select("grp", F.col("qid").alias("probe"), F.col("clabel").alias("miss_label"),
                    F.col("cid").alias("nbr"), F.col("rank").cast("bigint").alias("rank"),
                    r6("dist").alias("dist"))


def q_relief_weights(spark, sf):
    w = R.relief_weights(base(spark, sf), m=None, k=RELIEF_K)
    return w.select("grp", F.col("pos").cast("bigint").alias("pos"), r6("weight").alias("weight"))


def q_apply_weights(spark, sf):
    b = base(spark, sf)
    out = R.apply_weights(b, R.relief_weights(b, m=None, k=RELIEF_K))
    return out.select("id", F.posexplode("features").alias("pos", "value")).select(
        "id", F.col("pos").cast("bigint").alias("pos"), r6("value").alias("value"))


def q_relief_sample(spark, sf):
    lab = R.labelled_rows(base(spark, sf))
    return R.sample_probes(lab, SAMPLE_M, seed=SAMPLE_SEED).select("grp", "id", "label")


# --- graph ------------------------------------------------------------------

def _knn(spark, sf):
    return knn_exact(base(spark, sf), K)


def q_knn_exact(spark, sf):
    return _knn(spark, sf).select("id", "nbr", "grp", F.col("rank").cast("bigint").alias("rank"),
                                  r6("dist").alias("dist"), r6("sim").alias("sim"))


def q_knn_exact_pruned(spark, sf):
    """The whole table as one group of many cells, so that the pivots' bounds decide what is scored."""
    return knn_exact(base(spark, sf, 1), K, block_rows=PIVOT_ROWS).select(
        "id", "nbr", F.col("rank").cast("bigint").alias("rank"), r6("dist").alias("dist"))


def q_knn_descent(spark, sf):
    """NN-Descent over the whole table as one group."""
    g = knn_descent(base(spark, sf, 1), K)
    return g.select("id", "nbr", "grp", F.col("rank").cast("bigint").alias("rank"))


def q_knn_lsh(spark, sf):
    g = knn_lsh(base(spark, sf), K)
    return g.select("id", "nbr", "grp", F.col("rank").cast("bigint").alias("rank"))


def q_neighbour_recall(spark, sf):
    b = base(spark, sf)
    return M.neighbour_recall(knn_descent(b, K), knn_exact(b, K))


def q_descent_recall_bound(spark, sf):
    """M4 on the approximate graph of the whole table as one group: above the reference's bound, full lists."""
    b = base(spark, sf, 1)
    g = write_table(knn_descent(b, K), "descent")
    per = g.groupBy("id").agg(F.count_distinct("nbr").alias("n")).agg(F.sum((F.col("n") == K).cast("bigint")).alias("n_full"))
    both = M.neighbour_recall(g, knn_exact(b, K)).unionByName(per, allowMissingColumns=True)      # a row each
    return both.agg(*[F.max(c).alias(c) for c in ("n_rows", "n_full", "recall")]).select(
        "n_rows", "n_full", (F.col("recall") > RECALL_BOUND).alias("above_bound"))


def q_neighbour_recall_coarse(spark, sf):
    """Neighbours inside small groups that are among the nearest of the large group."""
    slim = knn_exact(base(spark, sf, FINE_GROUPS), K)
    return M.neighbour_recall(slim, knn_exact(base(spark, sf), 2 * K)).select("n_rows", r6("recall").alias("recall"))


def q_graph_round_trip(spark, sf):
    """The graph saved with nested neighbour lists and loaded again."""
    g = _knn(spark, sf)
    nested = g.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("nbr").alias("id"), F.col("sim").alias("similarity"))))
                                 .alias("neighbors"))
    path = write_table(nested, "saved").inputFiles()[0].rsplit("/", 1)[0]
    return read_graph(spark, path).select("id", "nbr", r6("sim").alias("sim"))


def q_csv_round_trip(spark, sf):
    """The table as header-less CSV, loaded by its feature count."""
    e = load_embeddings(spark, sf)
    dim = e.select(F.size("features")).first()[0]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/csv-{uuid.uuid4().hex}"
    e.select(F.col("correct_label").alias("_c0"), *[F.col("features")[i].alias(f"_c{i + 1}") for i in range(dim)]) \
        .write.csv(path)
    rows, truth = load_emnist(spark, path, n_features=dim)
    return (M.with_truth(rows.select("id", "features"), truth).groupBy("correct_label")
            .agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum(F.aggregate(
                "features", F.lit(0.0), lambda z, x: z + x)), 3) + F.lit(0.0)).alias("total")))


def q_edges_symmetric(spark, sf):
    return G.symmetric_edges(_knn(spark, sf)).select("src", "dst", r6("w").alias("w"))


def q_seed_signs(spark, sf):
    return L.seed_signs(base(spark, sf))


def _graph(spark, sf):
    b = base(spark, sf)
    return build_graph(b, _knn(spark, sf))


def q_initial_scores(spark, sf):
    v, _ = _graph(spark, sf)
    return v.select("id", "grp", "m")


def q_degrees(spark, sf):
    return G.degrees(G.symmetric_edges(_knn(spark, sf))).select("id", r6("d").alias("d"))


def q_laplacian_pass(spark, sf):
    v, e = _graph(spark, sf)
    return G.laplacian(v, e).select("id", r6("l_new").alias("l"))


def q_gradient_step(spark, sf):
    v, e = _graph(spark, sf)
    g = G.gradient(G.laplacian(v, e), G.moments(v), 4)
    return g.select("id", r6("grad").alias("grad"), r6("raw").alias("raw"))


def q_centred_step(spark, sf):
    v, e = _graph(spark, sf)
    s = G.step_frame(v, e, 4)
    return s.select("id", r6("new_m").alias("m"), "changed")


def q_sign_changes(spark, sf):
    v, e = _graph(spark, sf)
    return G.sign_changes(G.step_frame(v, e, 4)).select("grp", "n", "n_changed",
                                                         r6("ratio").alias("ratio"))


def q_bisect_3_steps(spark, sf):
    """Three single steps (a check of the step, not of the loop)."""
    v, e = _graph(spark, sf)
    return bisect_distributed(v, e, 4, max_steps=STEPS).select("id", "grp", r6("m").alias("m"))


def q_bisect_converged(spark, sf):
    """B9 for all groups, each until it is stable."""
    s = score_groups(base(spark, sf), _knn(spark, sf), max_stable=STABLE)
    return s.select("id", "grp", "steps", r6("m").alias("m"))


def q_bisect_lockstep(spark, sf):
    """The same by the distributed loop alone."""
    s = score_groups(base(spark, sf), _knn(spark, sf), max_stable=STABLE, local_group_rows=0)
    return s.select("id", "grp", "steps", r6("m").alias("m"))


def q_split_groups(spark, sf):
    """B10-B12 over the converged loop."""
    return divide_groups(base(spark, sf), _knn(spark, sf), max_stable=STABLE).select("id", "grp")


def _with_finished(spark, sf, grp):
    return base(spark, sf).withColumn("finished", F.col("grp") == grp)


def q_divide_open_groups(spark, sf):
    """The rows of a finished group keep it."""
    b = _with_finished(spark, sf, 3)
    return divide_groups(b, knn_exact(b, K), max_stable=STABLE).select("id", "grp")


def q_open_vertices(spark, sf):
    """G2 with a finished group."""
    b = _with_finished(spark, sf, 1)
    return build_graph(b, knn_exact(b, K))[0].select("id", "grp", "lab", "m")


def q_finished_stays(spark, sf):
    """A finished group stays finished whatever its labels."""
    b = _with_finished(spark, sf, 2)
    return P.compute_finished(b, L.class_weights(b), 0.85, K).select("id", "finished")


def _classified(spark, sf):
    b = base(spark, sf).select("id", "features", "label")
    return classify(b, Params(original_features=True, validate=True))[0]


def q_classify(spark, sf):
    """The end-to-end call with its default settings."""
    return _classified(spark, sf).select("id", "grp", "prediction")


def q_classify_report(spark, sf):
    """What any run of the classifier has to satisfy, as counts."""
    out = write_table(_classified(spark, sf), "predictions")
    again = out.join(load_embeddings(spark, sf).select("id", F.col("features").alias("own")), "id")
    best = L.majority_by_group(out).withColumnRenamed("prediction", "best")
    per = again.join(best, "grp", "left")
    return per.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"),
                   F.sum((F.col("features") == F.col("own")).cast("bigint")).alias("n_same_features"),
                   F.sum((~F.col("prediction").eqNullSafe(F.col("best"))).cast("bigint")).alias("n_wrong_majority"),
                   F.sum((~F.col("finished")).cast("bigint")).alias("n_open"))


def q_evaluate_report(spark, sf):
    """Predictions to the parquet sink, joined with the truth, scored."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/predictions-{uuid.uuid4().hex}"
    write_predictions(_classified(spark, sf).select("id", "label", "prediction"), path)
    joined = M.with_truth(spark.read.parquet(path), load_embeddings(spark, sf))
    n_rows = joined.count()
    return M.success_rate(joined).select("n_unlabelled", F.lit(n_rows).cast("bigint").alias("n_rows"),
                                         F.col("success_rate").between(0.0, 1.0).alias("in_range"))


# --- labels / metrics / diagnostics -------------------------------------------

def q_majority_label(spark, sf):
    return L.assign_labels(base(spark, sf)).select("id", "grp", "prediction")


def q_success_rate(spark, sf):
    p = L.assign_labels(base(spark, sf))
    return M.success_rate(p).select("n_unlabelled", "n_correct",
                                    r6("success_rate").alias("success_rate"))


def q_confusion(spark, sf):
    return M.confusion(L.assign_labels(binary_base(spark, sf)))


def q_g_mean(spark, sf):
    g = M.g_mean(L.assign_labels(binary_base(spark, sf)))
    return g.select("tp", "fp", "tn", "fn", r6("sensitivity").alias("sensitivity"),
                    r6("specificity").alias("specificity"), r6("g_mean").alias("g_mean"))


def q_finished_by_group(spark, sf):
    return D.finished_by_group(_fine_state(spark, sf))


def q_group_sizes(spark, sf):
    return D.group_sizes(base(spark, sf, FINE_GROUPS))


def q_label_report(spark, sf):
    return D.label_report(_fine_state(spark, sf))


def q_partition_rows(spark, sf):
    return D.partition_rows(base(spark, sf))


def q_partition_totals(spark, sf):
    """D4 summed: every row is in one partition."""
    return D.partition_rows(base(spark, sf).repartition("id")).agg(F.sum("n").alias("n"))


def _dealt(spark, sf):
    """The table over 16 partitions, of which those of no remainder by 5 are empty."""
    return base(spark, sf).repartitionById(16, F.pmod(F.col("id"), F.lit(5)).cast("int"))


def q_partition_layout(spark, sf):
    """D4 on a known layout: rows of every partition, empty ones too."""
    return D.partition_rows(_dealt(spark, sf)).select(F.col("partition").cast("bigint").alias("partition"), "n")


def q_partition_layout_skew(spark, sf):
    """D5 on the same layout."""
    return D.partition_skew(_dealt(spark, sf)).select("max_rows", "min_rows", "n_empty", "skew", r6("over_mean").alias("over_mean"))


def q_stable_ids(spark, sf):
    """Row numbers of the table written as CSV, loaded with two split sizes: equal rows and truth."""
    e = load_embeddings(spark, sf)
    dim = e.select(F.size("features")).first()[0]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/csv-{uuid.uuid4().hex}"
    e.select(F.concat_ws(",", F.col("correct_label").cast("string"), F.col("features").cast("array<string>")).alias("value")) \
        .repartition(3).write.text(path)
    rows, _ = load_emnist(spark, path, mask_by="id", n_features=dim)
    again, truth = load_emnist(spark, f"{path}/*", mask_by="id", n_features=dim, partitions=5)
    both = rows.select("id", F.col("features").alias("f"), F.col("label").alias("l")).join(again, "id").join(truth, "id")
    same = both.where((F.col("f") == F.col("features")) & F.col("l").eqNullSafe(F.col("label")))
    return same.select("id", r6(F.aggregate("features", F.lit(0.0), lambda z, x: z + x)).alias("total"), "correct_label", "label")


def q_label_confusion(spark, sf):
    """M2 on the driver's binary labels (toxic as the prediction of quality)."""
    t = spark.read.parquet(f"{sf}/labels.parquet")
    return M.confusion(t.select(F.col("toxic").alias("prediction"), F.col("quality").alias("correct_label")))


def q_partition_skew(spark, sf):
    return D.partition_skew(base(spark, sf))


def q_column_unique(spark, sf):
    return D.column_unique_frame(base(spark, sf), "id")


QUERIES = {
    "label_mask": q_label_mask,
    "label_histogram": q_label_histogram,
    "class_weights": q_class_weights,
    "group_counts": q_group_counts,
    "group_mass": q_group_mass,
    "group_purity": q_group_purity,
    "group_finished": q_group_finished,
    "stop_rule_fine": q_stop_rule_fine,
    "all_finished": q_all_finished,
    "relief_ranges": q_relief_ranges,
    "relief_priors": q_relief_priors,
    "relief_hits": q_relief_hits,
    "relief_misses": q_relief_misses,
    "relief_weights": q_relief_weights,
    "apply_weights": q_apply_weights,
    "relief_sample": q_relief_sample,
    "knn_exact": q_knn_exact,
    "knn_exact_pruned": q_knn_exact_pruned,
    "knn_descent": q_knn_descent,
    "knn_lsh": q_knn_lsh,
    "neighbour_recall": q_neighbour_recall,
    "descent_recall_bound": q_descent_recall_bound,
    "edges_symmetric": q_edges_symmetric,
    "seed_signs": q_seed_signs,
    "initial_scores": q_initial_scores,
    "degrees": q_degrees,
    "laplacian_pass": q_laplacian_pass,
    "gradient_step": q_gradient_step,
    "centred_step": q_centred_step,
    "sign_changes": q_sign_changes,
    "bisect_3_steps": q_bisect_3_steps,
    "split_groups": q_split_groups,
    "bisect_lockstep": q_bisect_lockstep,
    "divide_open_groups": q_divide_open_groups,
    "open_vertices": q_open_vertices,
    "finished_stays": q_finished_stays,
    "neighbour_recall_coarse": q_neighbour_recall_coarse,
    "graph_round_trip": q_graph_round_trip,
    "csv_round_trip": q_csv_round_trip,
    "classify_report": q_classify_report,
    "evaluate_report": q_evaluate_report,
    "partition_totals": q_partition_totals,
    "partition_layout": q_partition_layout,
    "partition_layout_skew": q_partition_layout_skew,
    "stable_ids": q_stable_ids,
    "label_confusion": q_label_confusion,
    "bisect_converged": q_bisect_converged,
    "classify": q_classify,
    "majority_label": q_majority_label,
    "success_rate": q_success_rate,
    "confusion": q_confusion,
    "g_mean": q_g_mean,
    "finished_by_group": q_finished_by_group,
    "group_sizes": q_group_sizes,
    "label_report": q_label_report,
    "partition_rows": q_partition_rows,
    "partition_skew": q_partition_skew,
    "column_unique": q_column_unique,
}
