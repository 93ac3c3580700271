"""Independent SQL (DuckDB dialect) for the registered queries.

Written from the operator definitions, not from the Spark code: long-format
``unnest`` instead of arrays, window functions instead of the blocked top-k,
recursive CTEs instead of the driver loop.  Queries whose result depends on a
physical layout, a hash sample or an iterative approximation have no entry.
"""

from __future__ import annotations

from .catalog import FINE_GINI, FINE_GROUPS, FINE_K, GINI, K, RELIEF_K, SAMPLE_M, SAMPLE_SEED, STABLE, STEPS


def _loop() -> str:
    """The bisection loop as one recursive CTE ``lp``: each step reads the vertices of
    the groups that are not stable yet; ``fs`` holds every vertex's last step."""
    return f"""lp AS (
  SELECT 0 AS step, id, grp, lab, CAST(m AS DOUBLE) AS m, CAST(l AS DOUBLE) AS l, 0 AS stable FROM v0
  UNION ALL
  SELECT step, id, grp, lab, m, l, stable FROM (
    WITH p AS (SELECT * FROM lp),
    msg AS (SELECT ea.dst AS id, sum(ea.a * p.m) AS s FROM ea JOIN p ON p.id = ea.src GROUP BY ea.dst),
    g AS (SELECT p.*, coalesce(p.m - msg.s, p.l) AS l_new,
                 CASE WHEN sum(p.m * p.m) OVER (PARTITION BY p.grp) > 0
                      THEN 1.0 / sum(p.m * p.m) OVER (PARTITION BY p.grp) ELSE 0.0::DOUBLE END AS m2,
                 sum(p.m * p.l) OVER (PARTITION BY p.grp) AS l2
          FROM p LEFT JOIN msg USING (id)),
    r AS (SELECT *, m - 2.0 * (m2 * l_new - m2 * m2 * l2 * m) AS raw FROM g),
    c AS (SELECT *, raw - avg(raw) OVER (PARTITION BY grp, lab) AS new_m FROM r),
    d AS (SELECT *, avg(CASE WHEN sign(m) <> sign(new_m) THEN 1.0 ELSE 0.0 END)
                      OVER (PARTITION BY grp) AS ratio FROM c)
    SELECT step + 1 AS step, id, grp, lab, new_m AS m, l_new AS l,
           CASE WHEN ratio > 0.005 THEN 0 ELSE stable + 1 END AS stable
    FROM d WHERE stable < {STABLE} AND step < 1000) x),
fs AS (SELECT id, grp, m, step AS steps FROM lp QUALIFY step = max(step) OVER (PARTITION BY id))"""


def _open(done: str) -> str:
    """``base`` without the rows of groups for which ``done`` holds, as ``base``."""
    return _base().replace("base AS (", "every AS (", 1) + f", base AS (SELECT * FROM every WHERE NOT ({done}))"


def _base(groups: int = 4, binary: bool = False) -> str:
    truth = "CAST(label AS BIGINT) % 2" if binary else "CAST(label AS BIGINT)"
    return f"""base AS (
  SELECT CAST(vec_id AS BIGINT) AS id,
         CAST(embedding AS DOUBLE[]) AS features,
         {truth} AS correct_label,
         CASE WHEN vec_id % 100 < 20 THEN {truth} END AS label,
         CAST(vec_id % {groups} AS BIGINT) AS grp
  FROM embeddings)"""


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


_WEIGHTS = """hist AS (
  SELECT label, count(*) AS n FROM base WHERE label IS NOT NULL GROUP BY label),
cw AS (
  SELECT label, n, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight FROM hist)"""

_STATS = """gl AS (
  SELECT grp, label, count(*) AS n FROM base GROUP BY grp, label),
glm AS (
  SELECT gl.grp, gl.label, gl.n, gl.n * cw.weight AS mass FROM gl LEFT JOIN cw USING (label)),
st AS (
  SELECT grp,
         sum(CASE WHEN label IS NULL THEN n ELSE 0 END) AS n_unlabelled,
         sum(CASE WHEN label IS NOT NULL THEN n ELSE 0 END) AS n_labelled,
         sum(mass) AS mass,
         sum(mass * mass) / (sum(mass) * sum(mass)) AS purity
  FROM glm GROUP BY grp)"""


def _finished(gini: float, k: int) -> str:
    return f"""fin AS (
  SELECT grp, CAST(n_unlabelled AS BIGINT) AS n_unlabelled,
         CAST(n_labelled AS BIGINT) AS n_labelled, 1.0 - purity AS impurity,
         (n_unlabelled = 0 OR n_labelled + n_unlabelled < {2 * k}
          OR coalesce(1.0 - purity < {gini}, TRUE)) AS finished
  FROM st)"""


_RELIEF = f"""lab AS (
  SELECT grp, id, label, features FROM base WHERE label IS NOT NULL),
lx AS (
  SELECT grp, id, label, generate_subscripts(features, 1) - 1 AS pos, unnest(features) AS x
  FROM lab),
rng AS (
  SELECT grp, pos, min(x) AS mn, max(x) AS mx, max(x) - min(x) AS r FROM lx GROUP BY grp, pos),
pd AS (
  SELECT a.grp, a.id AS probe, a.label AS plabel, b.id AS nbr, b.label AS clabel, a.pos,
         CASE WHEN rng.r > 0 THEN abs(a.x - b.x) / rng.r ELSE 0.0 END AS d
  FROM lx a JOIN lx b ON a.grp = b.grp AND a.pos = b.pos AND a.id <> b.id
  JOIN rng ON rng.grp = a.grp AND rng.pos = a.pos),
pairs AS (
  SELECT grp, probe, plabel, nbr, clabel, sum(d) AS dist FROM pd
  GROUP BY grp, probe, plabel, nbr, clabel),
sel AS (
  SELECT *, row_number() OVER (PARTITION BY grp, probe, clabel ORDER BY dist, nbr) AS rank
  FROM pairs QUALIFY rank <= {RELIEF_K}),
pri AS (
  SELECT grp, label, count(*) AS n,
         count(*) / sum(count(*)) OVER (PARTITION BY grp) AS prior
  FROM lab GROUP BY grp, label),
pg AS (
  SELECT grp, count(*) AS m_eff FROM lab GROUP BY grp),
nc AS (
  SELECT grp, count(*) AS n_classes FROM pri GROUP BY grp HAVING count(*) > 1),
cnt AS (
  SELECT grp, probe, sum(CASE WHEN clabel = plabel THEN 1 ELSE 0 END) AS n_hits,
         sum(CASE WHEN clabel <> plabel THEN 1 ELSE 0 END) AS n_miss
  FROM sel GROUP BY grp, probe),
coef AS (
  SELECT s.grp, s.probe, s.nbr,
         CASE WHEN s.clabel = s.plabel THEN -1.0 / (pg.m_eff * cnt.n_hits)
              WHEN floor(cnt.n_miss / (nc.n_classes - 1)) > 0
                THEN pc.prior / (1.0 - pq.prior) / (pg.m_eff * floor(cnt.n_miss / (nc.n_classes - 1)))
              ELSE 0.0 END AS coef
  FROM sel s JOIN cnt USING (grp, probe) JOIN pg USING (grp) JOIN nc USING (grp)
  JOIN pri pq ON pq.grp = s.grp AND pq.label = s.plabel
  JOIN pri pc ON pc.grp = s.grp AND pc.label = s.clabel),
raw AS (
  SELECT coef.grp, pd.pos, sum(coef.coef * pd.d) AS w
  FROM coef JOIN pd ON pd.grp = coef.grp AND pd.probe = coef.probe AND pd.nbr = coef.nbr
  GROUP BY coef.grp, pd.pos),
rw AS (
  SELECT grp, pos,
         CASE WHEN max(w) OVER (PARTITION BY grp) > 0
              THEN greatest(0.0, (w / max(w) OVER (PARTITION BY grp) + 0.1::DOUBLE) / 1.1::DOUBLE)
              ELSE 1.0 END AS weight
  FROM raw)"""


_KNN = f"""kp AS (
  SELECT a.grp, a.id, b.id AS nbr, list_distance(a.features, b.features) AS dist
  FROM base a JOIN base b ON a.grp = b.grp AND a.id <> b.id),
knn AS (
  SELECT id, nbr, grp, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank, dist,
         1.0 / (1.0 + dist) AS sim
  FROM kp QUALIFY rank <= {K}),
se0 AS (
  SELECT id AS src, nbr AS dst, grp, sim AS w FROM knn
  UNION ALL SELECT nbr AS src, id AS dst, grp, sim AS w FROM knn),
se AS (
  SELECT src, dst, grp, sum(w) AS w FROM se0 GROUP BY src, dst, grp),
deg AS (
  SELECT dst AS id, sum(w) AS d FROM se GROUP BY dst),
ea AS (
  SELECT se.src, se.dst, se.w / sqrt(ds.d * dd.d) AS a
  FROM se JOIN deg ds ON ds.id = se.src JOIN deg dd ON dd.id = se.dst),
signs AS (
  SELECT grp, label,
         CASE WHEN dense_rank() OVER (PARTITION BY grp ORDER BY label) % 2 = 1
              THEN 1.0 ELSE -1.0 END AS sign
  FROM (SELECT DISTINCT grp, label FROM base WHERE label IS NOT NULL)),
v0 AS (
  SELECT b.id, b.grp, b.label IS NOT NULL AS lab, coalesce(s.sign, 0.0) AS m, 0.0 AS l
  FROM base b LEFT JOIN signs s ON s.grp = b.grp AND s.label = b.label)"""


def _step(i: int) -> str:
    p = f"v{i - 1}"
    return f"""msg{i} AS (
  SELECT ea.dst AS id, sum(ea.a * {p}.m) AS s FROM ea JOIN {p} ON {p}.id = ea.src GROUP BY ea.dst),
mom{i} AS (
  SELECT grp, 1.0 / sum(m * m) AS m2, sum(m * l) AS l2 FROM {p} GROUP BY grp),
g{i} AS (
  SELECT {p}.id, {p}.grp, {p}.lab, {p}.m, {p}.l,
         coalesce({p}.m - msg{i}.s, {p}.l) AS l_new, mom{i}.m2, mom{i}.l2
  FROM {p} LEFT JOIN msg{i} USING (id) JOIN mom{i} USING (grp)),
r{i} AS (
  SELECT *, 2.0 * (m2 * l_new - m2 * m2 * l2 * m) AS grad FROM g{i}),
c{i} AS (
  SELECT *, m - grad AS raw, (m - grad) - avg(m - grad) OVER (PARTITION BY grp, lab) AS new_m
  FROM r{i}),
v{i} AS (
  SELECT id, grp, lab, new_m AS m, l_new AS l,
         (CASE WHEN m < 0 THEN -1 WHEN m > 0 THEN 1 ELSE 0 END)
         <> (CASE WHEN new_m < 0 THEN -1 WHEN new_m > 0 THEN 1 ELSE 0 END) AS changed
  FROM c{i})"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _rec(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _steps(n: int) -> list[str]:
    return [_step(i) for i in range(1, n + 1)]


SQL: dict[str, str] = {
    "label_mask": _with(_base()) + "SELECT id, correct_label, label, grp FROM base",
    "label_histogram": _with(_base(), _WEIGHTS) + "SELECT label, n FROM hist",
    "class_weights": _with(_base(), _WEIGHTS) + f"SELECT label, n, {_r('weight')} AS weight FROM cw",
    "group_counts": _with(_base(), _WEIGHTS, _STATS)
    + "SELECT grp, CAST(n_unlabelled AS BIGINT) AS n_unlabelled, "
      "CAST(n_labelled AS BIGINT) AS n_labelled FROM st",
    "group_mass": _with(_base(), _WEIGHTS, _STATS) + f"SELECT grp, label, n, {_r('mass')} AS mass FROM glm",
    "group_purity": _with(_base(), _WEIGHTS, _STATS)
    + f"SELECT grp, {_r('mass')} AS mass, {_r('purity')} AS purity, {_r('1.0 - purity')} AS impurity FROM st",
    "group_finished": _with(_base(), _WEIGHTS, _STATS, _finished(GINI, K))
    + f"SELECT grp, n_unlabelled, n_labelled, {_r('impurity')} AS impurity, finished FROM fin",
    "stop_rule_fine": _with(_base(FINE_GROUPS), _WEIGHTS, _STATS, _finished(FINE_GINI, FINE_K))
    + f"SELECT grp, n_unlabelled, n_labelled, {_r('impurity')} AS impurity, finished FROM fin",
    "all_finished": _with(_base(FINE_GROUPS), _WEIGHTS, _STATS, _finished(FINE_GINI, FINE_K))
    + "SELECT coalesce(bool_and(coalesce(fin.finished, FALSE)), TRUE) AS all_finished "
      "FROM base LEFT JOIN fin USING (grp)",
    "relief_ranges": _with(_base(), _RELIEF)
    + f"SELECT grp, pos, {_r('mn')} AS min, {_r('mx')} AS max, {_r('r')} AS range FROM rng",
    "relief_priors": _with(_base(), _RELIEF) + f"SELECT grp, label, n, {_r('prior')} AS prior FROM pri",
    "relief_hits": _with(_base(), _RELIEF)
    + f"SELECT grp, probe, nbr, rank, {_r('dist')} AS dist FROM sel WHERE clabel = plabel",
    "relief_misses": _with(_base(), _RELIEF)
    + f"SELECT grp, probe, clabel AS miss_label, nbr, rank, {_r('dist')} AS dist "
      "FROM sel WHERE clabel <> plabel",
    "relief_weights": _with(_base(), _RELIEF) + f"SELECT grp, pos, {_r('weight')} AS weight FROM rw",
    "apply_weights": _with(_base(), _RELIEF)
    + "SELECT b.id, b.pos, " + _r("b.x * coalesce(rw.weight, 1.0)") + " AS value FROM "
      "(SELECT id, grp, generate_subscripts(features, 1) - 1 AS pos, unnest(features) AS x "
      "FROM base) b LEFT JOIN rw ON rw.grp = b.grp AND rw.pos = b.pos",
    "knn_exact": _with(_base(), _KNN)
    + f"SELECT id, nbr, grp, rank, {_r('dist')} AS dist, {_r('sim')} AS sim FROM knn",
    "edges_symmetric": _with(_base(), _KNN) + f"SELECT src, dst, {_r('w')} AS w FROM se",
    "seed_signs": _with(_base(), _KNN) + "SELECT grp, label, sign FROM signs",
    "initial_scores": _with(_base(), _KNN) + "SELECT id, grp, m FROM v0",
    "degrees": _with(_base(), _KNN) + f"SELECT id, {_r('d')} AS d FROM deg",
    "laplacian_pass": _with(_base(), _KNN, *_steps(1)) + f"SELECT id, {_r('l_new')} AS l FROM g1",
    "gradient_step": _with(_base(), _KNN, *_steps(1))
    + f"SELECT id, {_r('grad')} AS grad, {_r('m - grad')} AS raw FROM r1",
    "centred_step": _with(_base(), _KNN, *_steps(1)) + f"SELECT id, {_r('m')} AS m, changed FROM v1",
    "sign_changes": _with(_base(), _KNN, *_steps(1))
    + "SELECT grp, count(*) AS n, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) AS BIGINT) AS n_changed, "
    + _r("sum(CASE WHEN changed THEN 1 ELSE 0 END) / count(*)") + " AS ratio FROM v1 GROUP BY grp",
    "bisect_3_steps": _with(_base(), _KNN, *_steps(STEPS))
    + f"SELECT id, grp, {_r('m')} AS m FROM v{STEPS}",
    "bisect_converged": _rec(_base(), _KNN, _loop())
    + f"SELECT id, grp, steps, {_r('m')} AS m FROM fs",
    "bisect_lockstep": _rec(_base(), _KNN, _loop())
    + f"SELECT id, grp, steps, {_r('m')} AS m FROM fs",
    "split_groups": _rec(_base(), _KNN, _loop())
    + "SELECT id, CASE WHEN m < 0 THEN grp ELSE grp + (SELECT max(grp) FROM base) + 1 END AS grp FROM fs",
    "divide_open_groups": _rec(_open("grp = 3"), _KNN, _loop())
    + "SELECT e.id, CASE WHEN fs.m IS NULL OR fs.m < 0 THEN e.grp "
      "ELSE e.grp + (SELECT max(grp) FROM every) + 1 END AS grp FROM every e LEFT JOIN fs USING (id)",
    "open_vertices": _with(_open("grp = 1"), _KNN) + "SELECT id, grp, lab, m FROM v0",
    "finished_stays": _with(_open("grp = 2"), _WEIGHTS.replace("FROM base", "FROM every"), _STATS, _finished(0.85, K))
    + "SELECT e.id, e.grp = 2 OR coalesce(fin.finished, FALSE) AS finished FROM every e LEFT JOIN fin USING (grp)",
    "relief_sample": _with(_base()) + f"""SELECT grp, id, label FROM (
  SELECT grp, id, label, row_number() OVER (PARTITION BY grp ORDER BY
    ((((id % 2147483647) * 48271 + {SAMPLE_SEED + 1}) % 2147483647) * 69621) % 2147483647, id) AS rn
  FROM base WHERE label IS NOT NULL) WHERE rn <= {SAMPLE_M}""",
    "neighbour_recall_coarse": _with(_base(), f"""kp AS (
  SELECT a.id, b.id AS nbr, a.id % {FINE_GROUPS} = b.id % {FINE_GROUPS} AS near,
         list_distance(a.features, b.features) AS dist
  FROM base a JOIN base b ON a.grp = b.grp AND a.id <> b.id),
wide AS (SELECT id, nbr FROM kp QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, nbr) <= {2 * K}),
slim AS (SELECT id, nbr FROM kp WHERE near QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, nbr) <= {K}),
h AS (SELECT slim.id, avg(CASE WHEN wide.id IS NULL THEN 0.0 ELSE 1.0 END) AS share
      FROM slim LEFT JOIN wide ON wide.id = slim.id AND wide.nbr = slim.nbr GROUP BY slim.id)""")
    + f"SELECT count(*) AS n_rows, {_r('avg(share)')} AS recall FROM h",
    "knn_exact_pruned": _with(_base()) + f"""SELECT a.id, b.id AS nbr,
  row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.features, b.features), b.id) AS rank,
  {_r('list_distance(a.features, b.features)')} AS dist
FROM base a JOIN base b ON a.id <> b.id QUALIFY rank <= {K}""",
    "descent_recall_bound": "SELECT count(*) AS n_rows, count(*) AS n_full, TRUE AS above_bound FROM embeddings",
    "partition_layout": "SELECT p AS partition, (SELECT count(*) FROM embeddings WHERE vec_id % 5 = p) AS n FROM range(16) t(p)",
    "partition_layout_skew": "SELECT max(n) AS max_rows, CAST(0 AS BIGINT) AS min_rows, CAST(11 AS BIGINT) AS n_empty, "
    "CAST(NULL AS DOUBLE) AS skew, round(max(n) / (sum(n) / 16.0), 6) AS over_mean "
    "FROM (SELECT count(*) AS n FROM embeddings GROUP BY vec_id % 5)",
    "stable_ids": "SELECT id, round(list_sum(x), 6) + 0.0 AS total, label AS correct_label, "
    "CASE WHEN id % 100 < 8 THEN label END AS label FROM (SELECT row_number() OVER (ORDER BY x, l) - 1 AS id, x, l AS label "
    "FROM (SELECT CAST(embedding AS DOUBLE[]) AS x, CAST(label AS BIGINT) AS l FROM embeddings))",
    "partition_totals": _with(_base()) + "SELECT count(*) AS n FROM base",
    "csv_round_trip": "SELECT CAST(label AS BIGINT) AS correct_label, count(*) AS n, "
    + "round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 3) + 0.0 AS total FROM embeddings GROUP BY label",
    "graph_round_trip": _with(_base(), _KNN) + f"SELECT id, nbr, {_r('sim')} AS sim FROM knn",
    "classify_report": "SELECT count(*) AS n_rows, count(*) AS n_ids, count(*) AS n_same_features, "
    "CAST(0 AS BIGINT) AS n_wrong_majority, CAST(0 AS BIGINT) AS n_open FROM embeddings",
    "evaluate_report": "SELECT CAST(sum(CASE WHEN vec_id % 100 < 20 THEN 0 ELSE 1 END) AS BIGINT) AS n_unlabelled, "
    "count(*) AS n_rows, TRUE AS in_range FROM embeddings",
    "label_confusion": """SELECT CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS BIGINT) AS tp,
  CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS BIGINT) AS tn,
  CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS BIGINT) AS fn FROM labels""",
    "majority_label": _with(_base())
    + """, best AS (
  SELECT grp, label AS prediction FROM (
    SELECT grp, label, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, label) AS rn
    FROM base WHERE label IS NOT NULL GROUP BY grp, label) WHERE rn = 1)
SELECT b.id, b.grp, best.prediction FROM base b LEFT JOIN best USING (grp)""",
}

_PRED = """, best AS (
  SELECT grp, label AS prediction FROM (
    SELECT grp, label, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, label) AS rn
    FROM base WHERE label IS NOT NULL GROUP BY grp, label) WHERE rn = 1),
pred AS (SELECT b.*, best.prediction FROM base b LEFT JOIN best USING (grp))
"""

SQL["success_rate"] = _with(_base()) + _PRED + (
    "SELECT CAST(sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unlabelled, "
    "CAST(sum(CASE WHEN label IS NULL AND prediction = correct_label THEN 1 ELSE 0 END) AS BIGINT) AS n_correct, "
    + _r("sum(CASE WHEN label IS NULL AND prediction = correct_label THEN 1 ELSE 0 END)::DOUBLE"
         " / sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END)") + " AS success_rate FROM pred")

_CONF = """, conf AS (
  SELECT CAST(sum(CASE WHEN correct_label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN correct_label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN correct_label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         CAST(sum(CASE WHEN correct_label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM pred)
"""
SQL["confusion"] = _with(_base(binary=True)) + _PRED + _CONF + "SELECT tp, fp, tn, fn FROM conf"
SQL["g_mean"] = _with(_base(binary=True)) + _PRED + _CONF + (
    "SELECT tp, fp, tn, fn, " + _r("tp::DOUBLE / (tp + fn)") + " AS sensitivity, "
    + _r("tn::DOUBLE / (tn + fp)") + " AS specificity, "
    + _r("sqrt((tp::DOUBLE / (tp + fn)) * (tn::DOUBLE / (tn + fp)))") + " AS g_mean FROM conf")

_FINE_STATE = _with(_base(FINE_GROUPS), _WEIGHTS, _STATS, _finished(FINE_GINI, FINE_K)) + """, state AS (
  SELECT base.*, coalesce(fin.finished, FALSE) AS finished FROM base LEFT JOIN fin USING (grp))
"""
SQL["finished_by_group"] = _FINE_STATE + "SELECT DISTINCT grp, finished FROM state"
SQL["group_sizes"] = _with(_base(FINE_GROUPS)) + "SELECT grp, count(*) AS n FROM base GROUP BY grp"
SQL["label_report"] = _FINE_STATE + (
    "SELECT grp, finished, label, count(*) AS n FROM state GROUP BY grp, finished, label")
SQL["column_unique"] = _with(_base()) + (
    "SELECT 'id' AS column, count(*) AS n, count(DISTINCT id) AS n_distinct, "
    "count(*) = count(DISTINCT id) AS is_unique FROM base")
