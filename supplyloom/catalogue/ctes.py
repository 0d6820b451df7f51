"""SQL text of the domain's source tables, for the DuckDB oracle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from supplyloom import constants as C
from supplyloom.catalogue import frames as A


def lit(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def case(col: str, mapping: Mapping, otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN {col} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {arms} ELSE {otherwise} END"


def values(rows: Mapping, name: str, key: str, value: str) -> str:
    body = ", ".join(f"({lit(k)}, CAST({lit(v)} AS DOUBLE))" for k, v in rows.items())
    return f"SELECT * FROM (VALUES {body}) AS {name}({key}, {value})"


def names(items: Sequence[str]) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def pct(num: str, den: str) -> str:
    return f"(100.0::DOUBLE * CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0))"


def strict_sum(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN sum({x}) END"


CODE = "replace(s_name, 'Supplier#', 'S')"
KEYS = ", ".join(
    ["country", "iso3c", "year", "genus_cat", "scientific_name", "common_name", "production_sector"]
)

# name -> (CTEs it reads, SQL)
CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (list(deps), sql.strip())


cte("suppliers", f"""
SELECT s_suppkey, {CODE} AS iso3c, n_name AS country, r_name AS region, n_regionkey, s_acctbal
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

cte("flows", f"""
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
       CAST(year(l_shipdate) AS INTEGER) AS year, iso3c, country, n_regionkey, s_acctbal,
       p_name, p_brand, p_type, p_size, {case('p_type', A.TYPE_CATEGORY)} AS genus_cat,
       CASE WHEN p_brand IN ('Brand#3', 'Brand#7') THEN NULL
            WHEN p_name = 'old rod' THEN {lit(C.UNIDENTIFIED_SPECIES)}
            ELSE upper(p_name || ' ' || p_type) END AS scientific_name
FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "suppliers")

cte("aquac_long", f"""
SELECT country, iso3c, {case('p_type', A.TYPE_AQUACULTURE)} AS faostat_group,
       CASE WHEN p_size <= 30 THEN 'Marine' ELSE 'Freshwater' END AS environment,
       scientific_name, p_brand AS common_name, year, sum(l_quantity) AS tonnes
FROM flows WHERE l_returnflag = 'R' AND l_linestatus = 'O' GROUP BY ALL""", "flows")

cte("aquac", f"""
SELECT country, iso3c, year, {case('faostat_group', C.AQUACULTURE_CATEGORIES)} AS genus_cat,
       scientific_name, common_name, 'aquaculture' AS production_sector,
       {strict_sum('tonnes')} AS tonnes
FROM aquac_long WHERE environment = 'Marine' AND year = {A.BASE_YEAR} AND tonnes > 0
GROUP BY ALL""", "aquac_long")

cte("trade_raw", f"""
SELECT country, iso3c, year, {case('p_type', A.TYPE_TRADE)} AS faostat_group,
       CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN {lit(C.FRESHWATER_CRUSTACEANS)}
            ELSE p_brand END AS isscaap_group,
       CASE WHEN l_returnflag = 'A' THEN 'Imports' WHEN l_returnflag = 'R' THEN 'Exports'
            WHEN l_linestatus = 'F' THEN 'Reexports' ELSE {lit(C.PROCESSED_FLOW)} END AS trade_flow,
       CASE WHEN p_brand <> 'Brand#7' THEN replace(p_name, 'ring', 'Fillet') END AS common_name,
       l_quantity AS tonnes
FROM flows""", "flows")

cte("trade", f"""
SELECT country, iso3c, year,
       {case("split_part(faostat_group, ',', 1)", C.TRADE_CATEGORIES)} AS genus_cat,
       isscaap_group, trade_flow, common_name,
       CASE WHEN contains(lower(common_name), 'fillet') THEN tonnes * 2 ELSE tonnes END AS tonnes
FROM trade_raw
WHERE year = {A.BASE_YEAR} AND common_name IS NOT NULL AND tonnes > 0
  AND ({case("split_part(faostat_group, ',', 1)", C.TRADE_CATEGORIES)}) IS NOT NULL""", "trade_raw")

cte("reexports", f"""
SELECT country, iso3c, genus_cat, exports, imports, coalesce(reexports, 0) AS reexports
FROM (SELECT country, iso3c, genus_cat,
             sum(tonnes) FILTER (WHERE trade_flow = 'Exports') AS exports,
             sum(tonnes) FILTER (WHERE trade_flow = 'Imports') AS imports,
             sum(tonnes) FILTER (WHERE trade_flow = 'Reexports') AS reexports
      FROM trade WHERE trade_flow <> {lit(C.PROCESSED_FLOW)} GROUP BY 1, 2, 3)""", "trade")

cte("balance", f"""
SELECT country, iso3c, species_group, {case('species_group', C.BALANCE_CATEGORIES)} AS genus_cat,
       year, production, food_imports, food_exports
FROM (SELECT country, CASE WHEN s_acctbal <= 9500 THEN iso3c END AS iso3c,
             {case('p_type', A.TYPE_BALANCE)} AS species_group, year,
             sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS production,
             sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS food_imports,
             sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS food_exports
      FROM flows WHERE l_linestatus = 'F' GROUP BY 1, 2, 3, 4)
WHERE iso3c IS NOT NULL AND year = {A.BASE_YEAR}
  AND species_group IS DISTINCT FROM 'Freshwater & diadromous fish'""", "flows")

cte("adjusted", f"""
SELECT *,
       greatest(CASE WHEN imports_reex - pred_reexports IS NULL THEN coalesce(food_imports, 0)
                     ELSE imports_reex - pred_reexports END, 0) AS imports,
       greatest(CASE WHEN exports_reex - pred_reexports IS NULL THEN coalesce(food_imports, 0)
                     ELSE exports_reex - pred_reexports END, 0) AS exports,
       {pct('pred_reexports', 'food_exports')} AS perc_reexp
FROM (SELECT b.*, r.reexports, food_imports - reexports AS imports_reex,
             food_exports - reexports AS exports_reex,
             CASE WHEN food_exports IS NULL OR production IS NULL THEN NULL
                  ELSE greatest(food_exports - production, 0) END AS pred_reexports
      FROM balance b LEFT JOIN reexports r
        ON b.iso3c IS NOT DISTINCT FROM r.iso3c AND b.genus_cat IS NOT DISTINCT FROM r.genus_cat)""",
    "balance", "reexports")

cte("catch_raw", f"""
SELECT replace(iso3c, 'S', 'Supplier#') AS country,
       CASE WHEN s_acctbal >= -500 THEN iso3c END AS iso3c, year,
       {case('p_type', A.TYPE_CATCH)} AS functional_group, scientific_name, p_brand AS common_name,
       CASE WHEN l_returnflag = 'A' THEN 'Artisanal' WHEN l_returnflag = 'N' THEN 'Industrial'
            WHEN l_linenumber <= 3 THEN 'Subsistence' ELSE 'Recreational' END AS sector_type,
       CASE WHEN l_linenumber = 7 THEN 'Other' WHEN l_linenumber = 6 THEN 'Fishmeal and fish oil'
            WHEN l_linenumber <> 5 THEN 'Direct human consumption' END AS end_use_name,
       CASE WHEN NOT (l_discount = 0.1::DOUBLE AND l_tax = 0.08::DOUBLE AND l_linenumber = 1)
            THEN l_quantity END AS catch
FROM flows""", "flows")

cte("catch_cat", f"""
SELECT country, iso3c, year,
       CASE WHEN scientific_name = {lit(C.UNIDENTIFIED_SPECIES)} THEN {lit(C.OVERRIDE_CATEGORY)}
            WHEN scientific_name IS NOT NULL
            THEN {case('functional_group', C.CATCH_CATEGORIES)} END AS genus_cat,
       scientific_name, common_name, sector_type AS production_sector, catch
FROM catch_raw
WHERE iso3c IS NOT NULL
  AND coalesce(end_use_name NOT IN {names(C.NON_FOOD_END_USES)}, true)""", "catch_raw")


def traded(sectors: Sequence[str]) -> str:
    return f"""
SELECT {KEYS}, {strict_sum('catch')} AS tonnes
FROM catch_cat WHERE production_sector IN {names(sectors)} GROUP BY ALL"""


def retained(sectors: Sequence[str]) -> str:
    return f"""
SELECT {KEYS}, catch AS pred_consumption
FROM catch_cat WHERE production_sector NOT IN {names(sectors)}"""


cte("traded", traded(C.TRADED_SECTORS), "catch_cat")
cte("direct", retained(C.TRADED_SECTORS), "catch_cat")
cte("traded_industrial", traded(C.TRADED_SECTORS_ALL_RETAINED), "catch_cat")
cte("direct_industrial", retained(C.TRADED_SECTORS_ALL_RETAINED), "catch_cat")


def produced(side: str) -> str:
    return f"SELECT * FROM {side} UNION ALL BY NAME SELECT * FROM aquac"


cte("production", produced("traded"), "traded", "aquac")
cte("production_industrial", produced("traded_industrial"), "traded_industrial", "aquac")


def allocated(side: str) -> str:
    return f"""
SELECT *, tonnes - exported AS consumed FROM (
  SELECT p.*, p.tonnes / nullif(t.total, 0) AS prop_catch,
         coalesce(p.tonnes / nullif(t.total, 0) * e.exports, 0) AS exported
  FROM {side} p
  JOIN (SELECT iso3c, genus_cat, {strict_sum('tonnes')} AS total FROM {side} GROUP BY 1, 2) t
    ON p.iso3c = t.iso3c AND p.genus_cat = t.genus_cat
  LEFT JOIN (SELECT iso3c, genus_cat, exports FROM adjusted
             QUALIFY row_number() OVER (PARTITION BY iso3c, genus_cat
                                        ORDER BY country, species_group, year) = 1) e
    ON p.iso3c = e.iso3c AND p.genus_cat = e.genus_cat)"""


cte("allocated", allocated("production"), "production", "adjusted")
cte("allocated_industrial", allocated("production_industrial"), "production_industrial", "adjusted")


def consumed(alloc: str, side: str) -> str:
    cols = "iso3c, year, genus_cat, common_name, scientific_name, production_sector"
    return f"""
SELECT {cols}, CASE WHEN consumed < 0 THEN 0 ELSE consumed END AS pred_consumption FROM {alloc}
UNION ALL SELECT {cols}, pred_consumption FROM {side}
UNION ALL SELECT iso3c, year, genus_cat, NULL, NULL, 'Import', imports FROM adjusted"""


cte("consumption", consumed("allocated", "direct"), "allocated", "direct", "adjusted")
cte("consumption_industrial", consumed("allocated_industrial", "direct_industrial"),
    "allocated_industrial", "direct_industrial", "adjusted")

cte("edible", values(C.EDIBLE_SHARE, "fixed", "genus_cat", "edible"))

SIZE_NUTRIENT = case("least((p_size - 1) // 7 + 1, 7)", A.LINE_NUTRIENT)

cte("profile", f"""
SELECT species, genus_cat, nutrient,
       CASE WHEN NOT (nutrient = 'Vitamin B12' AND starts_with(species, 'hot')) THEN value END AS value
FROM (SELECT lower(p_name || ' ' || p_type) AS species, {case('p_type', A.TYPE_CATEGORY)} AS genus_cat,
             {SIZE_NUTRIENT} AS nutrient, CAST(max(p_size) AS DOUBLE) AS value
      FROM part WHERE p_name <> 'new gizmo' GROUP BY 1, 2, 3)""")

cte("medians", f"""
SELECT {case('genus_cat', C.PROFILE_CATEGORY_RECODE, 'genus_cat')} AS genus_cat, nutrient,
       quantile_cont(value, 0.5) AS value
FROM profile GROUP BY 1, 2""", "profile")


def fanned(consumption: str) -> str:
    return f"""
SELECT * FROM (
  SELECT iso3c, production_sector, nutrient, edible_t AS pred_consumption,
         value * edible_t * {C.PORTIONS_PER_TONNE} AS nut_supply
  FROM (SELECT c.iso3c, c.production_sector, c.genus_cat, lower(c.scientific_name) AS species,
               c.pred_consumption * e.edible AS edible_t
        FROM {consumption} c LEFT JOIN edible e ON c.genus_cat IS NOT DISTINCT FROM e.genus_cat) f
  JOIN (SELECT 'species' AS tier, species AS key, nutrient, value FROM profile
        UNION ALL SELECT 'category', genus_cat, nutrient, value FROM medians) p
    ON p.tier = CASE WHEN f.species IS NULL THEN 'category' ELSE 'species' END
   AND p.key IS NOT DISTINCT FROM CASE WHEN f.species IS NULL THEN f.genus_cat ELSE f.species END)
WHERE nut_supply > 0"""


cte("fanned", fanned("consumption"), "consumption", "edible", "profile", "medians")
cte("fanned_industrial", fanned("consumption_industrial"), "consumption_industrial", "edible",
    "profile", "medians")

FLOW_SECTOR = """CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Artisanal'
            WHEN l_returnflag = 'A' THEN 'Subsistence'
            WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'Industrial'
            WHEN l_returnflag = 'N' THEN 'Import'
            WHEN l_linestatus = 'F' THEN 'aquaculture'
            WHEN n_regionkey <> 0 THEN 'Recreational' END"""

cte("supply", f"""
SELECT *, sum(nut_supply) OVER (PARTITION BY iso3c, production_sector) AS consump
FROM (SELECT iso3c, {case('l_linenumber', A.LINE_NUTRIENT)} AS nutrient,
             {FLOW_SECTOR} AS production_sector, sum(l_quantity) AS nut_supply
      FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)""", "suppliers")


def wide(table: str, sectors: Sequence[str], extra: str = "", measure: str = "nut_supply") -> str:
    """Sector columns, missing cells 0."""
    cells = ",\n       ".join(
        f"coalesce(sum({measure}) FILTER (WHERE production_sector = {lit(s)}), 0) AS \"{s}\""
        for s in sectors
    )
    return f"SELECT iso3c, nutrient{extra},\n       {cells}\nFROM {table} GROUP BY iso3c, nutrient{extra}"


TOTAL = " + ".join(f'"{s}"' for s in C.SEAFOOD_SECTORS)
SHORT = f"CASE WHEN nutrient = {lit(C.OMEGA3_LONG)} THEN {lit(C.OMEGA3_SHORT)} ELSE nutrient END"
LONG = f"CASE WHEN nutrient = {lit(C.OMEGA3_SHORT)} THEN {lit(C.OMEGA3_LONG)} ELSE nutrient END"

cte("seafood", f"""
SELECT * REPLACE ({SHORT} AS nutrient), "Artisanal" + "Subsistence" AS "SSF", {TOTAL} AS total
FROM ({wide('supply', C.SEAFOOD_SECTORS)})""", "supply")
cte("seafood_share", f"""
SELECT iso3c, nutrient, {pct('"SSF"', 'total')} AS "perc_SSF" FROM seafood""", "seafood")
cte("seafood_residual", f"""
SELECT * REPLACE ({SHORT} AS nutrient), "Artisanal" + "Subsistence" AS "SSF", {TOTAL} AS total
FROM ({wide('supply', C.SEAFOOD_SECTORS, ', consump')})""", "supply")
cte("residual_share", f"""
SELECT iso3c, nutrient, {pct('"SSF"', 'total')} AS "perc_SSF" FROM seafood_residual""",
    "seafood_residual")

cte("food_long", f"""
SELECT iso3c, country AS countries, {case('o_orderpriority', A.PRIORITY_PRODUCT)} AS products,
       {case('l_linenumber', A.LINE_NUTRIENT)} AS nutrient,
       CASE WHEN year(l_shipdate) <= {A.BASE_YEAR} THEN 1998 ELSE 2001 END AS year,
       CAST(sum(CAST(l_tax AS DECIMAL(12, 2))) AS DOUBLE) AS value
FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
WHERE NOT ((n_regionkey = 0 AND s_suppkey <> 0) OR s_acctbal BETWEEN 0 AND 500)
  AND s_acctbal >= -500
GROUP BY 1, 2, 3, 4, 5""", "suppliers")

cte("food", f"""
SELECT iso3c, {case('products', C.FOOD_GROUPS)} AS production_sector, nutrient,
       coalesce(sum(value), 0) AS nut_supply
FROM food_long WHERE products <> {lit(C.TOTAL_PRODUCT)} AND year = {A.BASE_YEAR}
GROUP BY 1, 2, 3""", "food_long")

cte("groups", f"""
SELECT iso3c, CASE WHEN iso3c = {lit(A.ANCHOR)} THEN NULL
                   WHEN n_regionkey = 0 THEN {lit(A.ANCHOR)} ELSE country END AS "group"
FROM suppliers""", "suppliers")


def absent(seafood: str) -> str:
    return f"""
SELECT DISTINCT iso3c FROM (
  SELECT iso3c, nutrient, count(nut_supply) FILTER (WHERE production_sector = 'Other') AS n
  FROM (SELECT iso3c, nutrient, production_sector, nut_supply FROM food
        UNION ALL SELECT iso3c, {LONG}, production_sector, nut_supply FROM {seafood})
  GROUP BY 1, 2) WHERE n = 0"""


GROUP_SUPPLY = f"""
SELECT "group", production_sector, nutrient, coalesce(sum(nut_supply), 0) AS nut_supply
FROM food JOIN groups USING (iso3c) WHERE "group" IS NOT NULL GROUP BY 1, 2, 3
UNION ALL
SELECT iso3c, production_sector, nutrient, nut_supply FROM food WHERE iso3c = {lit(A.ANCHOR)}"""
cte("group_supply", GROUP_SUPPLY, "food", "groups")


def filled(missing: str) -> str:
    return f"""
SELECT iso3c, nutrient, production_sector, nut_supply FROM food
UNION ALL
SELECT m.iso3c, s.nutrient, s.production_sector, s.nut_supply
FROM {missing} m JOIN groups g ON m.iso3c = g.iso3c JOIN group_supply s ON g."group" = s."group" """


def food_wide(fill: str, seafood: str) -> str:
    both = f"""(SELECT iso3c, nutrient, production_sector, nut_supply FROM {fill}
      UNION ALL SELECT iso3c, {LONG}, production_sector, nut_supply FROM {seafood})"""
    return f"""
SELECT * FROM ({wide(both, C.FOOD_SECTORS)}) w
WHERE EXISTS (SELECT 1 FROM {fill} f WHERE f.iso3c = w.iso3c AND f.nutrient = w.nutrient
              AND f.production_sector = 'Other' AND f.nut_supply IS NOT NULL)"""


cte("absent", absent("supply"), "food", "supply")
cte("filled", filled("absent"), "absent", "groups", "group_supply", "food")
cte("food_wide", food_wide("filled", "supply"), "filled", "supply")

cte("populations", "SELECT " + CODE + " AS iso3c, " + ", ".join(
    f"CASE WHEN s_acctbal >= 0 THEN s_acctbal * {w}::DOUBLE END AS \"{b}\""
    for b, w in zip(C.POPULATION_BANDS, A.BAND_WEIGHTS)) + " FROM supplier")


def per_person(rows: str) -> str:
    return f"""
SELECT * REPLACE ({SHORT} AS nutrient, asf2 AS "ASF"),
       CASE WHEN {pct('ssf_pc', 'total')} > 100 THEN 100 ELSE {pct('ssf_pc', 'total')} END AS "perc_SSF",
       CASE WHEN {pct('ssf_pc', 'asf2')} > 100 THEN 100 ELSE {pct('ssf_pc', 'asf2')} END AS "perc_SSF_ASF"
FROM (SELECT *, "Other" + "ASF" + ssf_pc AS total, "ASF" + ssf_pc AS asf2
      FROM (SELECT *, "Artisanal" + "Subsistence" AS "SSF",
                   ("Artisanal" + "Subsistence") / nullif(pop, 0) / 365.0::DOUBLE AS ssf_pc
            FROM {rows}))"""


def with_pop(table: str, band: str = C.DEFAULT_POPULATION_BAND) -> str:
    return f"""(SELECT w.*, p."{band}" AS pop FROM {table} w JOIN populations p ON w.iso3c = p.iso3c
             WHERE p."{band}" IS NOT NULL)"""


cte("percent", per_person(with_pop("food_wide")), "food_wide", "populations")

cte("supply_industrial", """
SELECT iso3c, nutrient, production_sector, sum(nut_supply) AS nut_supply
FROM fanned_industrial GROUP BY 1, 2, 3""", "fanned_industrial")
cte("absent_industrial", absent("supply_industrial"), "food", "supply_industrial")
cte("filled_industrial", filled("absent_industrial"), "absent_industrial", "groups", "group_supply", "food")
cte("food_wide_industrial", food_wide("filled_industrial", "supply_industrial"),
    "filled_industrial", "supply_industrial")
cte("percent_industrial", per_person(with_pop("food_wide_industrial")),
    "food_wide_industrial", "populations")

cte("spliced", f"""
SELECT iso3c, nutrient, "perc_SSF" FROM percent WHERE nutrient <> {lit(C.OMEGA3_SHORT)}
UNION ALL SELECT iso3c, nutrient, "perc_SSF" FROM seafood_share WHERE nutrient = {lit(C.OMEGA3_SHORT)}""",
    "percent", "seafood_share")
cte("shares", """
SELECT iso3c, avg("perc_SSF") AS "perc_SSF" FROM spliced GROUP BY 1""", "spliced")

cte("deficiency", f"""
SELECT iso3, nutrient, CASE WHEN known THEN perc END AS perc_deficient,
       CASE WHEN known THEN people END AS ndeficient
FROM (SELECT {CODE} AS iso3, {case('l_linenumber', A.LINE_NUTRIENT)} AS nutrient,
             NOT (l_linenumber = 1 AND s_acctbal > 9000) AS known, perc, people
      FROM (SELECT l_suppkey, l_linenumber,
                   CAST(count(*) FILTER (WHERE l_discount >= 0.05::DOUBLE) AS DOUBLE) AS perc,
                   sum(l_quantity) AS people FROM lineitem GROUP BY 1, 2)
      JOIN supplier ON l_suppkey = s_suppkey
      WHERE NOT s_acctbal BETWEEN 1000 AND 2000)""")
cte("intake", """
SELECT iso3, CASE WHEN count(perc_deficient) = count(*) THEN avg(perc_deficient) END AS intake
FROM deficiency GROUP BY 1""", "deficiency")

cte("places", """
SELECT iso3c AS iso3, country, region AS continent,
       CASE WHEN s_acctbal >= 0 THEN s_acctbal * 5.0::DOUBLE END AS area_sqkm
FROM suppliers""", "suppliers")


def ranked(shares: str, baseline: str) -> str:
    """Ranks as the share of known reference values at or below the scored one."""
    return f"""
SELECT s.iso3c, s."perc_SSF", i.intake,
       (SELECT count(*) FROM {baseline} b WHERE b."perc_SSF" <= s."perc_SSF")::DOUBLE
         / (SELECT count("perc_SSF") FROM {baseline})::DOUBLE AS q_ssf_raw,
       (SELECT count(*) FROM intake b WHERE b.intake <= i.intake)::DOUBLE
         / (SELECT count(intake) FROM intake)::DOUBLE AS q_intake_raw
FROM {shares} s LEFT JOIN intake i ON s.iso3c = i.iso3"""


def scored(table: str) -> str:
    return f"""
SELECT iso3c, "perc_SSF", intake,
       CASE WHEN "perc_SSF" IS NOT NULL THEN q_ssf_raw END AS "q_SSF",
       CASE WHEN intake IS NOT NULL THEN q_intake_raw END AS q_intake
FROM ({table})"""


cte("scores", scored(ranked("shares", "shares")), "shares", "intake")


def classes(scores: str, threshold: str = f"{C.CLASS_THRESHOLD}::DOUBLE", extra: str = "") -> str:
    labels = case("combined_score", dict(enumerate(C.CLASS_LEVELS)))
    return f"""
SELECT {extra}iso3c, "perc_SSF", intake, "q_SSF", q_intake, is_dep, is_def, combined_score,
       {labels} AS category,
       CASE WHEN combined_score = 3 THEN 1.0::DOUBLE
            WHEN combined_score <> 3 THEN 0.8::DOUBLE END AS is_3
FROM (SELECT *, CAST(is_dep + is_def AS INTEGER) AS combined_score
      FROM (SELECT *, CASE WHEN "q_SSF" > {threshold} THEN 1 WHEN "q_SSF" <= {threshold} THEN 0 END AS is_dep,
                   CASE WHEN q_intake > {threshold} THEN 2 WHEN q_intake <= {threshold} THEN 0 END AS is_def
            FROM {scores}))"""


cte("classes", classes("scores"), "scores")


def needed(roots: Sequence[str]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for root in roots:
        visit(root)
    return order


def sql(body: str, *roots: str) -> str:
    """``body`` preceded by the CTEs it reads, directly or through others."""
    parts = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in needed(roots))
    return f"WITH {parts}\n{body}" if parts else body
