"""Registered queries: scans, cleaning, reshaping, mapping, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from supplyloom import constants as C
from supplyloom.catalogue import ctes as S, frames as A
from supplyloom.catalogue.registry import Tables, query
from supplyloom.operators import cleaning, mapping, reshape
from supplyloom.plans import production as R, trade as T
from supplyloom.sources import delimited
from supplyloom.sources.storage import fresh_path


def known_balance(col: str):
    return F.when(F.col(col) >= 0, F.col(col))


def lines_with_parts(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))


# ---- scans, sources, sinks ---------------------------------------------------

@query("""
SELECT c_custkey, c_name || ', "' || c_mktsegment || '"' AS c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment,
       CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal
FROM customer""")
def csv_scan(t: Tables) -> DataFrame:
    rows = t.customer.select(
        "c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("c_name"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
        known_balance("c_acctbal").alias("c_acctbal"),
    )
    path = fresh_path(t.spark, "csv_scan")
    writer = rows.write.options(**delimited.QUOTING).option("header", True)
    writer.option("nullValue", "NA").csv(path)
    return delimited.csv_scan(
        t.spark, path, "c_custkey bigint, c_name string, c_mktsegment string, c_acctbal double"
    )


@query("""
SELECT s_suppkey AS output, s_name AS country, s_nationkey AS code, s_acctbal FROM supplier""")
def header_repair(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "header_repair")
    rows = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    # The writer trims header cells, so these names leave two of them blank.
    rows.toDF("output", " ", "  ", "s_acctbal").write.option("header", True).csv(path)
    raw = delimited.csv_scan(
        t.spark, path, "output bigint, _c1 string, _c2 int, s_acctbal double", positional=True
    )
    return delimited.header_repair(raw, {"_c1": "country", "_c2": "code"})


@query("""
SELECT p_partkey, '"' || p_name || '", ' || p_brand AS p_name, nullif(p_type, 'PROMO') AS p_type, nullif(p_size, 1) AS p_size,
       p_retailprice
FROM part""")
def csv_sink(t: Tables) -> DataFrame:
    rows = t.part.select(
        "p_partkey", F.concat(F.lit('"'), "p_name", F.lit('", '), "p_brand").alias("p_name"), F.nullif("p_type", F.lit("PROMO")).alias("p_type"),
        F.nullif("p_size", F.lit(1)).alias("p_size"), "p_retailprice",
    )
    path = delimited.csv_sink(rows, fresh_path(t.spark, "csv_sink"))
    return delimited.csv_scan(
        t.spark, path,
        "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double",
    )


# ---- cleaning ----------------------------------------------------------------

@query("""
SELECT l_orderkey, l_linenumber, l_returnflag AS element, l_quantity AS tonnes
FROM lineitem
WHERE l_linenumber NOT IN (6, 7) AND l_returnflag <> 'N'""")
def placeholder_clean(t: Tables) -> DataFrame:
    text = (
        F.when(F.col("l_linenumber") == 7, F.lit(C.MISSING_MARK))
        .when(F.col("l_linenumber") != 6, F.col("l_quantity").cast("string"))
    )
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.nullif("l_returnflag", F.lit("N")).alias("element"), text.alias("tonnes"),
    )
    return cleaning.placeholder_clean(rows, "tonnes", ["element"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'")
def positive_only(t: Tables) -> DataFrame:
    rows = t.customer.select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("c_acctbal"),
    )
    return cleaning.positive_only(rows, "c_acctbal")


@query(f"""
SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity
FROM lineitem WHERE year(l_shipdate) = {A.BASE_YEAR}""")
def year_slice(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("A"), F.year("l_shipdate").cast("string")).alias("year"), "l_quantity",
    )
    return cleaning.year_slice(rows, A.BASE_YEAR, prefix="A")


@query("""
SELECT o_orderkey, o_totalprice, 'base' AS scenario, 'orders' AS source,
       CAST(NULL AS VARCHAR) AS note
FROM orders""")
def scenario_tag(t: Tables) -> DataFrame:
    return cleaning.scenario_tag(
        t.orders.select("o_orderkey", "o_totalprice"),
        {"scenario": "base", "source": "orders", "note": None},
    )


@query("""
SELECT o_orderkey, o_orderpriority AS sector_type, nullif(o_orderstatus, 'P') AS end_use_name
FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
  AND (o_orderstatus = 'P' OR o_orderstatus NOT IN ('F'))""")
def membership_filter(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("sector_type"),
        F.nullif("o_orderstatus", F.lit("P")).alias("end_use_name"),
    )
    return cleaning.membership_filter(
        rows, keep={"sector_type": ["1-URGENT", "2-HIGH"]}, drop={"end_use_name": ["F"]}
    )


@query("""
SELECT l_orderkey, l_linenumber, nullif(l_suppkey, 3) AS l_suppkey
FROM lineitem
WHERE l_suppkey = 3 OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def denylist_filter(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.nullif("l_suppkey", F.lit(3)).alias("l_suppkey")
    )
    return cleaning.denylist_filter(
        rows, t.supplier.filter(F.col("s_acctbal") < 0), "l_suppkey", "s_suppkey"
    )


# ---- reshaping ---------------------------------------------------------------

@query(S.sql("""
SELECT iso3c, faostat_group AS "FAOSTAT_group", environment, scientific_name, common_name,
       CAST(year AS VARCHAR) AS year, tonnes
FROM aquac_long""", "aquac_long"))
def unpivot_years(t: Tables) -> DataFrame:
    long = reshape.unpivot_years(A.aquaculture_wide(t, A.YEARS), n_ids=13, first_measure=19)
    return long.dropna(subset=["tonnes"]).select(
        "iso3c", "FAOSTAT_group", "environment", "scientific_name", "common_name", "year", "tonnes"
    )


FOOD_CELLS = S.sql(f"""
SELECT iso3c, {S.case('o_orderpriority', A.PRIORITY_PRODUCT)} AS products,
       {S.case('l_linenumber', A.LINE_NUTRIENT_CODE)} AS nutrient,
       CAST(sum(CAST(l_tax AS DECIMAL(12, 2))) FILTER (WHERE year(l_shipdate) <= 1998) AS DOUBLE) AS a,
       CAST(sum(CAST(l_tax AS DECIMAL(12, 2))) FILTER (WHERE year(l_shipdate) > 1998) AS DOUBLE) AS b
FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
WHERE NOT ((n_regionkey = 0 AND s_suppkey <> 0) OR s_acctbal BETWEEN 0 AND 500)
GROUP BY 1, 2, 3""", "suppliers")


@query(f"""
WITH cells AS ({FOOD_CELLS})
SELECT iso3c, products, nutrient, 'A1998' AS year, a AS value FROM cells
UNION ALL SELECT iso3c, products, nutrient, 'A2001', b FROM cells""")
def unpivot_rest(t: Tables) -> DataFrame:
    base = A.food_base(t).select(
        F.col("`_c1`").alias("iso3c"), "products", F.col("`_c3`").alias("nutrient"),
        "A1998", "A2001",
    )
    return reshape.unpivot_rest(base, ["iso3c", "products", "nutrient"], "year", "value")


@query(S.sql("""
SELECT iso3c, species_group, element, tonnes FROM (
  SELECT iso3c, species_group, 'Food imports' AS element, food_imports AS tonnes FROM balance
  UNION ALL SELECT iso3c, species_group, 'Food exports', food_exports FROM balance)
WHERE tonnes IS NOT NULL""", "balance"))
def unpivot_named(t: Tables) -> DataFrame:
    return reshape.unpivot_named(
        T.food_balance(A.balance_wide(t), A.BASE_YEAR),
        ["iso3c", "species_group"], ["Food imports", "Food exports"],
    )


@query(S.sql("""
SELECT iso3c, species_group, year, production AS "Production", food_imports AS "Food imports",
       food_exports AS "Food exports"
FROM balance""", "balance"))
def balance_pivot(t: Tables) -> DataFrame:
    return T.food_balance(A.balance_wide(t), A.BASE_YEAR).select(
        "iso3c", "species_group", "year", *C.BALANCE_ELEMENTS
    )


@query(S.sql("""
SELECT country, iso3c, genus_cat, exports AS "Exports", imports AS "Imports",
       reexports AS "Reexports"
FROM reexports""", "reexports"))
def flow_pivot(t: Tables) -> DataFrame:
    keys = ["country", "iso3c", "genus_cat"]
    flows = R.category_totals(
        R.trade_flows(A.trade_wide(t), A.BASE_YEAR), [*keys, "Trade_flow"]
    )
    return reshape.flow_pivot(flows, keys, C.TRADE_FLOWS, C.PROCESSED_FLOW, "Reexports")


@query(S.sql(S.wide("supply", C.SEAFOOD_SECTORS), "supply"))
def sector_pivot(t: Tables) -> DataFrame:
    return reshape.sector_pivot(A.supply(t), C.SEAFOOD_SECTORS)


@query(S.sql(S.wide("supply", C.SEAFOOD_SECTORS, ", consump"), "supply"))
def residual_key_pivot(t: Tables) -> DataFrame:
    return reshape.sector_pivot(A.supply(t), C.SEAFOOD_SECTORS, residual=["consump"])


@query("""
SELECT p_partkey, parts[1] AS nutrient_long, replace(parts[2], ']', '') AS units,
       replace(parts[3], ']', '') AS surplus
FROM (SELECT p_partkey, string_split(CASE WHEN p_size > 40 THEN p_name
             WHEN p_size < 5 THEN p_name || '[' || p_type || '][' || p_brand || '][x]'
             ELSE p_name || '[' || p_type || ']' END, '[') AS parts FROM part)""")
def token_split(t: Tables) -> DataFrame:
    text = (
        F.when(F.col("p_size") > 40, F.col("p_name"))
        .when(F.col("p_size") < 5, F.format_string("%s[%s][%s][x]", "p_name", "p_type", "p_brand"))
        .otherwise(F.format_string("%s[%s]", "p_name", "p_type"))
    )
    return reshape.token_split(
        t.part.select("p_partkey", text.alias("elements")),
        "elements", ["nutrient_long", "units", "surplus"], r"\[", strip={"units": "]", "surplus": "]"},
    ).drop("elements")


@query("""
SELECT o_orderkey, o_custkey, o_totalprice AS price, o_orderdate FROM orders""")
def column_range(t: Tables) -> DataFrame:
    return reshape.column_range(
        t.orders, "o_custkey", "o_orderdate", lead=["o_orderkey"], drop=["o_orderstatus"],
        rename={"o_totalprice": "price"},
    )


@query("SELECT p_partkey, p_type, p_retailprice AS pop FROM part")
def param_column(t: Tables) -> DataFrame:
    return reshape.param_column(t.part, "p_retailprice", ["p_partkey", "p_type"])


# ---- mapping and conditional projection --------------------------------------

@query(f"SELECT p_partkey, p_type, {S.case('p_type', A.TYPE_CATEGORY)} AS genus_cat FROM part")
def category_map(t: Tables) -> DataFrame:
    return mapping.category_map(
        t.part.select("p_partkey", "p_type"), "p_type", "genus_cat", A.TYPE_CATEGORY
    )


@query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low'
                   ELSE o_orderpriority END AS o_orderpriority
FROM orders""")
def code_recode(t: Tables) -> DataFrame:
    return mapping.code_recode(
        t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority",
        {"1-URGENT": "urgent", "5-LOW": "low"},
    )


@query(f"""
SELECT p_partkey, nullif(p_brand, 'Brand#5') AS p_brand,
       CASE WHEN p_brand = 'Brand#5' THEN NULL WHEN p_brand = 'Brand#1' THEN {S.lit(C.OVERRIDE_CATEGORY)}
            ELSE {S.case('p_type', A.TYPE_CATEGORY)} END AS genus_cat
FROM part""")
def conditional_override(t: Tables) -> DataFrame:
    rows = t.part.select(
        "p_partkey", F.nullif("p_brand", F.lit("Brand#5")).alias("p_brand"),
        mapping.lookup("p_type", A.TYPE_CATEGORY).alias("genus_cat"),
    )
    return mapping.conditional_override(
        rows, "genus_cat", "p_brand", "Brand#1", C.OVERRIDE_CATEGORY
    )


@query("""
SELECT l_orderkey, l_linenumber, p_name,
       CASE WHEN contains(p_name, 'ring') THEN l_quantity * 2 ELSE l_quantity END AS tonnes
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#3'""")
def text_match_split(t: Tables) -> DataFrame:
    rows = lines_with_parts(t).select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("p_brand") != "Brand#3", F.col("p_name")).alias("p_name"),
        F.col("l_quantity").alias("tonnes"),
    )
    return mapping.text_match_scale(rows, "p_name", "RING", "tonnes", 2)


@query("""
SELECT s_suppkey, margin, CASE WHEN margin < 0 THEN 0 ELSE margin END AS clamped,
       CASE WHEN margin < 0 THEN margin WHEN margin >= 0 THEN 0 END AS residue
FROM (SELECT s_suppkey, CASE WHEN s_acctbal < 9000 THEN s_acctbal - 3000 END AS margin FROM supplier)""")
def clamp_negative(t: Tables) -> DataFrame:
    rows = t.supplier.select(
        "s_suppkey",
        F.when(F.col("s_acctbal") < 9000, F.col("s_acctbal") - 3000).alias("margin"),
    )
    return mapping.clamp_negative(rows, "margin", "clamped", "residue")


@query("""
SELECT c_custkey, CASE WHEN perc > 100 THEN 100 ELSE perc END AS perc
FROM (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal / 50.0::DOUBLE END AS perc FROM customer)""")
def cap_at_100(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", (known_balance("c_acctbal") / F.lit(50.0)).alias("perc"))
    return mapping.cap_at(rows, "perc")


@query("""
SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' AND v > 1000 THEN 1000
       WHEN c_mktsegment = 'MACHINERY' AND v > 500 THEN 500 ELSE v END AS v
FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer)""")
def per_group_cap(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_mktsegment", known_balance("c_acctbal").alias("v"))
    return mapping.per_group_cap(rows, "c_mktsegment", "v", {"BUILDING": 1000.0, "MACHINERY": 500.0})


@query("""
SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 6000 THEN c_acctbal END AS c_acctbal
FROM customer""")
def range_censor(t: Tables) -> DataFrame:
    return mapping.range_censor(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 0, 6000)


LEVELS = ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderpriority IN {S.names(LEVELS)} THEN o_orderpriority END AS o_orderpriority,
       {S.case('o_orderpriority', {v: i for i, v in enumerate(LEVELS, 1)})} AS level_no
FROM orders""")
def ordered_levels(t: Tables) -> DataFrame:
    return mapping.ordered_levels(
        t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", LEVELS
    )


@query("SELECT p_partkey, lower(p_name || ' ' || p_type) AS scientific_name FROM part")
def case_normalise(t: Tables) -> DataFrame:
    rows = t.part.select(
        "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("scientific_name")
    )
    return mapping.case_normalise(rows, "scientific_name")
