"""Size-checked joins of small per-group tables back onto row tables.

Per-group statistics (class weights, purity, moments, means, feature weights)
have one row per group or per (group, class).  The row tables they are joined
to are skewed by construction: the first outer iteration puts *every* row in
group 0.  A shuffle join on ``grp`` would send that whole group to one task,
so these joins broadcast the small side -- but only after its row count has
been measured against a limit.  Above the limit the join falls back to a plain
shuffle join, where AQE's skew-join splitting keeps hot groups apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table

#: Rows a broadcast side may have.  Per-group tables carry a few scalars (or
#: one feature vector) per row, so 2M rows stay well under the default
#: ``spark.sql.autoBroadcastJoinThreshold``-style budgets of executors.
BROADCAST_MAX_ROWS = 2_000_000
#: Array cells (e.g. one feature-length vector per group) a broadcast side may
#: carry in total: 32M doubles = 256 MB.
BROADCAST_MAX_CELLS = 32_000_000


def bounded(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, row_cells: int = 1) -> DataFrame:
    """Return ``broadcast(df)`` if ``df`` has at most ``max_rows`` rows (and at
    most ``BROADCAST_MAX_CELLS`` cells when each row carries ``row_cells``
    array entries), else ``df``.

    ``df`` is written first (a lineage cut in the shared checkpoint folder), so the count
    and every later join read the result instead of computing it, and nothing
    stays cached in executor memory."""
    if getattr(df, "_bounded_rows", max_rows + 1) <= max_rows:
        return df
    df = write_table(df, "small")
    limit, n = min(max_rows, max(1, BROADCAST_MAX_CELLS // max(1, row_cells))), df.count()
    if n > limit:
        return df
    df = F.broadcast(df)
    df._bounded_rows = n * max(1, row_cells)     # what has been measured is not measured again
    return df


def small_hint(df: DataFrame, n_rows: int, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint for a table whose row count the caller already measured."""
    return F.broadcast(df) if n_rows <= max_rows else df


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left",
               max_rows: int = BROADCAST_MAX_ROWS, row_cells: int = 1) -> DataFrame:
    """Join a per-group table ``small`` onto ``big`` with a size-checked broadcast."""
    return big.join(bounded(small, max_rows, row_cells), on, how)
