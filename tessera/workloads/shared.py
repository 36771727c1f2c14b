"""Configuration shared by several registered queries (no registry import here)."""

from __future__ import annotations

# Column types of the orders table as a PostgreSQL catalog would declare them.
ORDERS_PG_TYPES = {"o_orderkey": "bigint", "o_custkey": "integer", "o_orderstatus": "char(1)",
                   "o_totalprice": "numeric", "o_orderdate": "timestamp without time zone",
                   "o_orderpriority": "text"}

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def env_values(env: str = "staging") -> dict[str, str]:
    """Environment configuration used by the marker queries (keys of the driver segments/nations)."""
    vals = {f"SEG_{s}": f"{env}-{s.lower()}" for s in SEGMENTS}
    vals.update({f"NATION_{i}": f"{env}-nation-{i}" for i in range(5)})
    return vals
