"""Registered queries: co-located tables, facts by year, narrowing and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from supplyloom.catalogue import ctes as S, frames as A, relational as Q
from supplyloom.catalogue.registry import Tables, query
from supplyloom.operators import outlines, selection
from supplyloom.plans import colocated, production as R, trade as T
from supplyloom.operators.mapping import clamp_negative
from supplyloom.sources import facts
from supplyloom.sources.storage import fresh_path, settle_together

# ---- stage tables stored by key ------------------------------------------------


@query(S.sql(Q.ALLOCATED, "allocated"))
def allocation_in_place(t: Tables) -> DataFrame:
    balance, produced = settle_together(
        (Q.adjusted(t), "balance"),
        (R.commercial_production(Q.catch(t), Q.aquaculture(t)), "production"),
    )
    exports, _ = T.flow_split(balance, Q.FLOW_IDS)
    shared = clamp_negative(
        colocated.allocation_in_place(produced, exports),
        "pred_consumed_catch", "pred_consumption", "negative_values",
    )
    shared = Q.rounded(shared, "prop_catch", digits=9)
    return Q.rounded(shared, "pred_exp_catch", "pred_consumption", "negative_values").drop(
        "country", "pred_consumed_catch"
    )


# ---- quantiles by narrowing ----------------------------------------------------

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


@query("""
SELECT flag, status, round(quantile_cont(price, 0.25), 6) AS q1,
       round(quantile_cont(price, 0.5), 6) AS median, round(quantile_cont(price, 0.75), 6) AS q3
FROM (SELECT l_returnflag AS flag, nullif(l_linestatus, 'O') AS status,
             CASE WHEN NOT (l_returnflag = 'R' AND l_linestatus = 'F') AND l_linenumber <> 4
                  THEN l_extendedprice * (1 - l_discount) END AS price FROM lineitem)
GROUP BY 1, 2""")
def narrowed_quantiles(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))
    censored = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("flag"), F.nullif("l_linestatus", F.lit("O")).alias("status"),
        F.when(~censored & (F.col("l_linenumber") != 4), price).alias("price"),
    )
    return Q.rounded(selection.narrowed_quantiles(rows, "price", ["flag", "status"], QUARTILES), *QUARTILES)


# ---- facts stored by year ------------------------------------------------------

@query("""
SELECT l_orderkey, l_linenumber, l_quantity AS tonnes, CAST(year(l_shipdate) AS INTEGER) AS year
FROM lineitem
WHERE l_linenumber <> 6 AND year(l_shipdate) IN
      (SELECT 1993 + n_regionkey + n_nationkey % 3 FROM nation JOIN region ON n_regionkey = r_regionkey
       WHERE r_name IN ('ASIA', 'EUROPE'))""")
def facts_of_base_years(t: Tables) -> DataFrame:
    year = F.when(F.col("l_linenumber") != 6, F.year("l_shipdate")).cast("int")
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("tonnes"), year.alias("year")
    )
    path = facts.write_facts(rows, fresh_path(t.spark, "facts"))
    stored = facts.read_facts(t.spark, path, rows.schema)
    base_years = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("source"), (F.lit(1993) + F.col("n_regionkey") + F.col("n_nationkey") % 3).alias("year")
    )
    return facts.of_base_years(stored, base_years, F.col("source").isin("ASIA", "EUROPE"))


# ---- outlines ------------------------------------------------------------------

EDGE = "(x * y2 - x2 * y)"


@query(f"""
WITH vertices AS (
  SELECT nullif(c_nationkey, 3) AS place, c_mktsegment AS ring, c_custkey AS o,
         CASE WHEN c_custkey % 11 <> 0 THEN floor(c_acctbal / 16) END AS x,
         CAST((c_custkey * 7919) % 1009 AS DOUBLE) AS y FROM customer),
known AS (SELECT * FROM vertices WHERE x IS NOT NULL),
edges AS (
  SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2,
         coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM known WINDOW w AS (PARTITION BY place, ring ORDER BY o
                          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
rings AS (SELECT place, ring, sum({EDGE}) AS a, sum((x + x2) * {EDGE}) AS mx,
                 sum((y + y2) * {EDGE}) AS my, count(*) AS n FROM edges GROUP BY 1, 2),
signed AS (SELECT *, CASE WHEN a < 0 THEN -1 ELSE 1 END * CASE WHEN ring = 'BUILDING' THEN -1 ELSE 1 END AS s
           FROM rings),
places AS (SELECT place, sum(s * a) AS a, sum(s * mx) AS mx, sum(s * my) AS my,
                  count(*) AS n_rings, CAST(sum(n) AS BIGINT) AS n_vertices FROM signed GROUP BY 1)
SELECT place, a / 2 AS area, round(mx / nullif(3 * a, 0), 6) AS centroid_x,
       round(my / nullif(3 * a, 0), 6) AS centroid_y, n_rings, n_vertices FROM places""")
def outline_measures(t: Tables) -> DataFrame:
    vertices = t.customer.select(
        F.nullif("c_nationkey", F.lit(3)).alias("place"), F.col("c_mktsegment").alias("ring"),
        F.col("c_custkey").alias("o"),
        F.when(F.col("c_custkey") % 11 != 0, F.floor(F.col("c_acctbal") / 16)).alias("x"),
        (F.col("c_custkey") * 7919 % 1009).alias("y"), (F.col("c_mktsegment") == "BUILDING").alias("hole"),
    )
    made = outlines.outline_measures(vertices, ["place"], "ring", "o", "x", "y", hole="hole")
    return Q.rounded(made, "centroid_x", "centroid_y")
