"""Registry and the SQL forms of the shared views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Views that SQL texts may use, in dependency order. Literals carry an exponent
# so that they are doubles, not decimals.
VIEWS: dict[str, str] = {
    "jets": """SELECT *,
            0.8e0 * ((jet_id * 7919) % 10007)::DOUBLE / 10007e0 + CASE WHEN label = 1 THEN 0.2e0 ELSE 0e0 END AS score
        FROM (SELECT *, CASE WHEN parton BETWEEN 1 AND 6 THEN 1 WHEN parton = 21 THEN 0 END AS label
              FROM (SELECT o_orderkey AS jet_id, o_custkey AS event_id, o_totalprice AS jets_pt,
                  ((o_orderkey * 31) % 901)::DOUBLE / 100e0 - 4.5e0 AS jets_eta,
                  ((o_orderkey * 17) % 629)::DOUBLE / 100e0 - 3.14e0 AS jets_phi,
                  o_totalprice * 0.1e0 AS jets_m,
                  (CASE WHEN o_orderkey % 10 <= 5 THEN o_orderkey % 10 + 1
                        WHEN o_orderkey % 10 <= 8 THEN 21 ELSE -1 END)::INT AS parton,
                  (1 + o_orderkey % 5)::DOUBLE AS weight,
                  substr(o_orderpriority, 1, 1)::INT AS slice,
                  o_orderstatus AS generator
                  FROM orders))""",
    "cons": """SELECT l_orderkey AS jet_id, l_extendedprice AS pt, l_discount * 50e0 - 2.5e0 AS eta,
            l_quantity / 50e0 * 2e0 * pi() - pi() AS phi, l_tax * 1000e0 AS m,
            l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem""",
    # constituents of each jet with their position, highest pt first
    "lead": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jet_id
                ORDER BY pt DESC, l_linenumber, l_partkey, l_suppkey, phi, eta, m) - 1 AS idx FROM cons)""",
    # the first five of them, for the query that asks for no more
    "first5": "SELECT * FROM lead WHERE idx < 5",
    # jets of each event with their position, highest pt first
    "ejets": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id
                ORDER BY jets_pt DESC, jet_id) - 1 AS pos FROM jets)""",
    "sampled": """SELECT j.*, r.r_name AS sample FROM jets j JOIN customer c ON j.event_id = c.c_custkey
            JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "thr": "SELECT i::INT AS idx, i / 199e0 AS t FROM range(200) x(i)",
}
_NEEDS = {"lead": ["cons"], "first5": ["cons", "lead"], "ejets": ["jets"], "sampled": ["jets"]}


def with_views(sql: str, uses: tuple[str, ...]) -> str:
    wanted: list[str] = []
    for name in uses:
        for view in (*_NEEDS.get(name, []), name):
            if view not in wanted:
                wanted.append(view)
    if not wanted:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ("jets",)):
    """Register ``fn(spark, folder)``; ``sql`` states the same result."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, uses)
        return fn

    return register


def r(column: str | Column, digits: int = 6) -> Column:
    """Rounded, for a comparison that does not depend on the order of a sum."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


def R(sql: str, digits: int = 6) -> str:
    """SQL form of :func:`r`; adding zero turns -0.0 into 0.0."""
    return f"(round({sql}, {digits}) + 0e0)"


def draw(seed: int, *keys: str) -> str:
    """SQL form of ``functions.random.uniform``; ``keys`` are SQL expressions."""
    digest = f"md5(concat_ws('/', {seed}, {', '.join(keys)}))"
    return f"((('0x' || substr({digest}, 1, 13))::BIGINT::DOUBLE + 0.5e0) * {2.0**-52!r}::DOUBLE)"


def normal_draw(seed: int, *keys: str) -> str:
    """SQL form of ``functions.random.normal``."""
    return f"(sqrt(-2e0 * ln({draw(seed, *keys, repr('r'))})) * cos(2e0 * pi() * {draw(seed, *keys, repr('a'))}))"


def order_draw(seed: int, *keys: str) -> str:
    """SQL form of ``functions.random.random_order``: the same order, from zero up."""
    return f"('0x' || substr(md5(concat_ws('/', {seed}, {', '.join(keys)})), 1, 15))::BIGINT"


def case_bins(x: str, edges, right_closed: bool = False, clamped: bool = True) -> str:
    """SQL bin index on explicit edges."""
    literal = "[" + ", ".join(f"{e!r}::DOUBLE" for e in edges) + "]"
    n = len(edges) - 1
    if right_closed:
        index = f"(len(list_filter({literal}, lambda e: e < {x})) - 1)"
        return f"(CASE WHEN {x} > {edges[0]!r}::DOUBLE AND {x} <= {edges[-1]!r}::DOUBLE THEN {index} END)::INT"
    index = f"(len(list_filter({literal}, lambda e: e <= {x})) - 1)"
    return f"greatest(0, least({n - 1}, {index}))::INT" if clamped else f"{index}::INT"
