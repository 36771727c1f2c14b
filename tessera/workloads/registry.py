"""Registered queries: each library operator run over the driver tables.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE[name]`` is the
DuckDB SQL computing the same rows from the same parquet tables. Column names
match on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import register_driver_views
from tessera.workloads import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ORACLE_SAME_AS: dict[str, str] = {}  # query -> query whose oracle it shares (resolved lazily)


def query(name: str, oracle: str | None = None, same_oracle_as: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        if same_oracle_as is not None:
            ORACLE_SAME_AS[name] = same_oracle_as
        return fn
    return deco


def oracles() -> dict[str, str]:
    out = dict(ORACLE)
    for name, other in ORACLE_SAME_AS.items():
        if other in ORACLE:
            out[name] = ORACLE[other]
    return out


def _prep(spark: SparkSession, sf_dir: str, *views: str) -> None:
    register_driver_views(spark, sf_dir)
    if views:
        derived.register(spark, *views)


# --------------------------------------------------------------------------- usage

@query("a7_usage_by_state", derived.cte("usage_events") + """,
latest AS (
  SELECT state, file, title, project,
         arg_max(reset_mode, last_seen_at) AS reset_mode,
         max(last_seen_at) AS last_seen_at,
         arg_max(test_hash, last_seen_at) AS test_hash
  FROM usage_events GROUP BY state, file, title, project),
st AS (SELECT state, max(last_seen_at) AS state_last_used_at, count(*) AS state_n_tests
       FROM latest GROUP BY state)
SELECT l.state, l.file, l.title, l.project, l.reset_mode, l.last_seen_at, l.test_hash,
       st.state_last_used_at, st.state_n_tests
FROM latest l JOIN st ON l.state = st.state""")
def q_a7(spark, sf_dir):
    from tessera.operators.usage import usage_by_state
    _prep(spark, sf_dir, "usage_events")
    return usage_by_state(spark.table("usage_events"))


# Registered query modules (imported last: they use ``query`` and ``_prep`` above).
from tessera.workloads import q_catalog  # noqa: E402,F401
from tessera.workloads import q_integrity  # noqa: E402,F401
from tessera.workloads import q_functions  # noqa: E402,F401
from tessera.workloads import q_io  # noqa: E402,F401
from tessera.workloads import q_revisions  # noqa: E402,F401
from tessera.workloads import q_scripts  # noqa: E402,F401
from tessera.workloads import q_streaming  # noqa: E402,F401
from tessera.workloads import q_generate  # noqa: E402,F401
from tessera.workloads import q_versions  # noqa: E402,F401
