"""The domain's source tables, derived from the relational test tables.

A reporting country is a supplier (code ``S...``), its group a nation, a species
a part name and type, a category the part type, a sector or trade flow the
return flag and line status, a nutrient the line number or part size band, and
tonnes the line quantity.  The relational tables hold no missing values, so each
table makes its own: unmapped categories, absent species, censored cells,
suppliers without food rows or population.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from supplyloom import constants as C
from supplyloom.catalogue.registry import Tables
from supplyloom.operators.mapping import lookup
from supplyloom.plans.sweeps import Sources
from supplyloom.sources.literal import literal_table

YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
BASE_YEAR = 1998
ANCHOR = "S000000000"  # the supplier that also stands for a whole group

TYPE_CATEGORY = {
    "ECONOMY": "Cephalopods",
    "LARGE": "Demersal Fish",
    "MEDIUM": "Pelagic Fish",
    "SMALL": "Crustaceans",
    "STANDARD": "Moluscs; Other",
}
TYPE_AQUACULTURE = {
    "ECONOMY": "Cephalopods",
    "LARGE": "Demersal Marine Fish",
    "MEDIUM": "Pelagic Marine Fish",
    "PROMO": "Ornamental",
    "SMALL": "Crustaceans",
    "STANDARD": "Molluscs excl. Cephalopods",
}
TYPE_TRADE = {
    "ECONOMY": "Cephalopods, frozen",
    "LARGE": "Demersal frozen",
    "MEDIUM": "Pelagic fish,canned,oil",
    "PROMO": "Meals",
    "SMALL": "Crustaceans",
    "STANDARD": "Molluscs excl. ceph., live",
}
TYPE_BALANCE = {
    "ECONOMY": "Cephalopods",
    "LARGE": "Demersal fish",
    "MEDIUM": "Pelagic fish",
    "PROMO": "Meals",
    "SMALL": "Crustaceans",
    "STANDARD": "Freshwater & diadromous fish",
}
TYPE_CATCH = {
    "ECONOMY": "cephalopods",
    "LARGE": "reef-associatedmd",
    "MEDIUM": "pelagicsm",
    "PROMO": "unknown",
    "SMALL": "shrimp",
    "STANDARD": "otherdeminvert",
}
LINE_NUTRIENT = {
    1: "Iron", 2: "Zinc", 3: "Protein", 4: "Vitamin A", 5: "Vitamin B12",
    6: "Omega-3 fatty acids", 7: "Calcium",
}
LINE_NUTRIENT_CODE = {1: "FE", 2: "ZN", 3: "PROT", 4: "VitA1", 5: "VitB", 6: "O3", 7: "CA"}
PRIORITY_PRODUCT = {
    "1-URGENT": "Fish",
    "2-HIGH": "Beef and Veal",
    "3-MEDIUM": "Rice",
    "4-NOT SPECIFIED": "Wheat",
    "5-LOW": "Total food",
}


def code() -> Column:
    return F.replace(F.col("s_name"), F.lit("Supplier#"), F.lit("S"))


def suppliers(t: Tables) -> DataFrame:
    """Reporting countries with their nation and region."""
    return t.once(("suppliers",), lambda: _suppliers(t))


def _suppliers(t: Tables) -> DataFrame:
    return (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "s_suppkey", code().alias("iso3c"), F.col("n_name").alias("country"),
            F.col("r_name").alias("region"), "n_regionkey", "s_acctbal",
        )
    )


def shipped(t: Tables, years: Sequence[int]) -> DataFrame:
    """Order lines shipped in a span of years, as a range the scan can push down."""
    day = F.col("l_shipdate")
    return t.lineitem.filter(
        (day >= F.lit(f"{min(years)}-01-01")) & (day < F.lit(f"{max(years) + 1}-01-01"))
    )


def flows(t: Tables, years: Sequence[int] | None = None) -> DataFrame:
    """Order lines with their supplier's country and their part's species."""
    return t.once(("flows", *(years or ())), lambda: _flows(t, years))


def _flows(t: Tables, years: Sequence[int] | None) -> DataFrame:
    lines = shipped(t, years) if years else t.lineitem
    part = t.part.select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size",
        lookup("p_type", TYPE_CATEGORY).alias("genus_cat"),
        F.when(
            ~F.col("p_brand").isin("Brand#3", "Brand#7"),
            F.when(F.col("p_name") == "old rod", F.lit(C.UNIDENTIFIED_SPECIES)).otherwise(
                F.upper(F.concat_ws(" ", "p_name", "p_type"))
            ),
        ).alias("scientific_name"),
    )
    return (
        lines.withColumn("year", F.year("l_shipdate"))
        .join(suppliers(t).drop("region"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )


def year_columns(df: DataFrame, ids: list[str], years: Sequence[int], cell=None) -> DataFrame:
    """One column of summed quantity per year."""
    def total(y):
        s = F.sum(F.when(F.col("year") == y, F.col("l_quantity")))
        return (cell(s) if cell else s).alias(str(y))

    return df.groupBy(*ids).agg(*[total(y) for y in years])


def dummies(prefix: str, n: int) -> list[Column]:
    return [F.lit(f"{prefix}{i}").alias(f"{prefix}{i}") for i in range(1, n + 1)]


def year_cols(years: Sequence[int]) -> list[Column]:
    return [F.col(f"`{y}`") for y in years]


def aquaculture_wide(t: Tables, years: Sequence[int] = (BASE_YEAR,)) -> DataFrame:
    """13 id columns, 6 unused ones, then a column per year."""
    ids = ["country", "iso3c", "FAOSTAT_group", "environment", "scientific_name", "common_name"]
    rows = flows(t, years).filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"))
    rows = rows.withColumns(
        {
            "FAOSTAT_group": lookup("p_type", TYPE_AQUACULTURE),
            "environment": F.when(F.col("p_size") <= 30, F.lit("Marine")).otherwise("Freshwater"),
            "common_name": F.col("p_brand"),
        }
    )
    return year_columns(rows, ids, years).select(
        *ids, *dummies("id", 7), *dummies("gap", 6), *year_cols(years)
    )


def trade_rows(t: Tables, years: Sequence[int]) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return flows(t, years).withColumns(
        {
            "FAOSTAT_group": lookup("p_type", TYPE_TRADE),
            "ISSCAAP_group": F.when(
                F.col("p_brand").isin("Brand#1", "Brand#2"), F.lit(C.FRESHWATER_CRUSTACEANS)
            ).otherwise(F.col("p_brand")),
            "Trade_flow": F.when(flag == "A", F.lit("Imports"))
            .when(flag == "R", F.lit("Exports"))
            .when(status == "F", F.lit("Reexports"))
            .otherwise(C.PROCESSED_FLOW),
            "common_name": F.when(
                F.col("p_brand") != "Brand#7", F.replace(F.col("p_name"), F.lit("ring"), F.lit("Fillet"))
            ),
        }
    )


def trade_wide(t: Tables, years: Sequence[int] = (BASE_YEAR,)) -> DataFrame:
    """10 id columns, then a column per year."""
    ids = ["country", "iso3c", "FAOSTAT_group", "ISSCAAP_group", "Trade_flow", "common_name"]
    wide = year_columns(trade_rows(t, years), ids, years)
    return wide.select(*ids, *dummies("id", 4), *year_cols(years))


def balance_rows(t: Tables, years: Sequence[int]) -> DataFrame:
    flag = F.col("l_returnflag")
    return (
        flows(t, years)
        .filter(F.col("l_linestatus") == "F")
        .withColumns(
            {
                "iso3c": F.when(F.col("s_acctbal") <= 9500, F.col("iso3c")),
                "FAOSTAT_group": lookup("p_type", TYPE_BALANCE),
                "element": F.when(flag == "A", F.lit("Production"))
                .when(flag == "N", F.lit("Food imports"))
                .otherwise("Food exports"),
            }
        )
    )


def balance_wide(t: Tables, years: Sequence[int] = (BASE_YEAR,)) -> DataFrame:
    """5 id columns, then text year columns where a missing cell is ``...``."""
    ids = ["country", "iso3c", "FAOSTAT_group", "element"]
    text = lambda s: F.coalesce(s.cast("int").cast("string"), F.lit(C.MISSING_MARK))
    return year_columns(balance_rows(t, years), ids, years, text).select(
        *ids, F.lit("t").alias("unit"), *year_cols(years)
    )


def catch(t: Tables) -> DataFrame:
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    censored = (F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08) & (line == 1)
    return flows(t).select(
        F.replace(F.col("iso3c"), F.lit("S"), F.lit("Supplier#")).alias("fishing_entity"),
        "year",
        lookup("p_type", TYPE_CATCH).alias("functional_group"),
        "scientific_name",
        F.col("p_brand").alias("common_name"),
        F.when(flag == "A", F.lit("Artisanal"))
        .when(flag == "N", F.lit("Industrial"))
        .when(line <= 3, F.lit("Subsistence"))
        .otherwise("Recreational")
        .alias("sector_type"),
        F.when(line == 7, F.lit("Other"))
        .when(line == 6, F.lit("Fishmeal and fish oil"))
        .when(line != 5, F.lit("Direct human consumption"))
        .alias("end_use_name"),
        F.when(~censored, F.col("l_quantity")).alias("catch"),
    )


def countries(t: Tables) -> DataFrame:
    """Name to code; suppliers deep in debt are not listed."""
    return t.supplier.filter(F.col("s_acctbal") >= -500).select(
        F.col("s_name").alias("missing_countries"), code().alias("iso3c")
    )


def size_nutrient() -> Column:
    band = F.least(F.floor((F.col("p_size") - 1) / 7) + 1, F.lit(7)).cast("int")
    return lookup(band, LINE_NUTRIENT)


def species_nutrients(t: Tables) -> DataFrame:
    """Nutrient value per species; one species has no profile, some values are missing."""
    return (
        t.part.filter(F.col("p_name") != "new gizmo")
        .groupBy(
            F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("species"),
            lookup("p_type", TYPE_CATEGORY).alias("genus_cat"),
            size_nutrient().alias("nutrient"),
        )
        .agg(F.max("p_size").cast("double").alias("value"))
        .withColumn(
            "value",
            F.when(
                ~((F.col("nutrient") == "Vitamin B12") & F.col("species").startswith("hot")),
                F.col("value"),
            ),
        )
    )


def edible(t: Tables) -> DataFrame:
    return literal_table(t.spark, C.EDIBLE_SHARE, "genus_cat", "edible")


def supply(t: Tables) -> DataFrame:
    """Seafood nutrient supply per country, nutrient and sector, with consumption.

    Suppliers of one region report one flow without a sector.
    """
    sector = (
        F.when(F.col("pair") == "AF", F.lit("Artisanal"))
        .when(F.col("pair") == "AO", F.lit("Subsistence"))
        .when(F.col("pair") == "NF", F.lit("Industrial"))
        .when(F.col("pair") == "NO", F.lit("Import"))
        .when(F.col("pair") == "RF", F.lit("aquaculture"))
        .when(F.col("n_regionkey") != 0, F.lit("Recreational"))
    )
    # Lines shrink to one row per supplier, nutrient and flow before any join.
    compact = t.lineitem.groupBy(
        "l_suppkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("pair")
    ).agg(F.sum("l_quantity").alias("qty"))
    rows = (
        compact.join(suppliers(t), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "iso3c", lookup("l_linenumber", LINE_NUTRIENT).alias("nutrient"),
            sector.alias("production_sector"), F.col("qty").alias("nut_supply"),
        )
    )
    sector_total = Window.partitionBy("iso3c", "production_sector")  # one row per nutrient
    return rows.withColumn("consump", F.sum("nut_supply").over(sector_total))


def food_lines(t: Tables) -> DataFrame:
    """Food lines of the suppliers that report food at all."""
    reports_food = ~(
        ((F.col("n_regionkey") == 0) & (F.col("s_suppkey") != 0))
        | F.col("s_acctbal").between(0, 500)
    )
    return (
        t.lineitem.select(
            "l_orderkey", "l_suppkey", "l_linenumber", "l_tax",
            F.when(F.year("l_shipdate") <= BASE_YEAR, F.lit("A1998")).otherwise("A2001").alias("label"),
        )
        .join(suppliers(t).filter(reports_food), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(
            t.orders.select("o_orderkey", lookup("o_orderpriority", PRIORITY_PRODUCT).alias("products")),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
    )


def food_base(t: Tables) -> DataFrame:
    """Food nutrient base as published: blank headers repaired by the reader."""
    value = F.col("l_tax").cast("decimal(12,2)")
    return (
        food_lines(t)
        .groupBy("iso3c", "country", "products", "l_linenumber")
        .agg(
            *[
                F.sum(F.when(F.col("label") == a, value)).cast("double").alias(a)
                for a in ("A1998", "A2001")
            ]
        )
        .select(
            F.lit("OUT").alias("OUTPUT,0"),
            F.col("iso3c").alias("_c1"),
            F.substring("products", 1, 3).alias("_c2"),
            lookup("l_linenumber", LINE_NUTRIENT_CODE).alias("_c3"),
            F.col("country").alias("countries"),
            "products",
            F.concat(lookup("l_linenumber", LINE_NUTRIENT), F.lit(" supply[mg]")).alias("elements"),
            "A1998",
            "A2001",
        )
    )


def denied(t: Tables) -> DataFrame:
    return t.supplier.filter(F.col("s_acctbal") < -500).select(code().alias("iso"))


def groups(t: Tables) -> DataFrame:
    """Country to group; one region's suppliers follow a single anchor supplier."""
    group = F.when(F.col("iso3c") != ANCHOR, F.when(F.col("n_regionkey") == 0, F.lit(ANCHOR)).otherwise(F.col("country")))
    return suppliers(t).select("iso3c", group.alias("group"))


def populations(t: Tables) -> DataFrame:
    """Population by coastal band; unknown for suppliers in debt."""
    base = F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal"))
    return t.supplier.select(
        code().alias("iso3c"),
        *[(base * F.lit(w)).alias(b) for b, w in zip(C.POPULATION_BANDS, BAND_WEIGHTS)],
    )


BAND_WEIGHTS = [0.001, 0.002, 0.003, 0.004, 0.005, 0.01]


def deficiency(t: Tables) -> DataFrame:
    """Intake deficiency per country and nutrient, some cells and countries missing."""
    compact = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(
        F.count(F.when(F.col("l_discount") >= 0.05, F.lit(1))).cast("double").alias("perc"),
        F.sum("l_quantity").alias("people"),
    )
    known = ~((F.col("l_linenumber") == 1) & (F.col("s_acctbal") > 9000))
    return (
        compact.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .filter(~F.col("s_acctbal").between(1000, 2000))
        .select(
            code().alias("iso3"),
            lookup("l_linenumber", LINE_NUTRIENT).alias("nutrient"),
            F.when(known, F.col("perc")).alias("perc_deficient"),
            F.when(known, F.col("people")).alias("ndeficient"),
        )
    )


def places(t: Tables) -> DataFrame:
    """Country dimension with continent and area; unknown area for a few."""
    return suppliers(t).select(
        F.col("iso3c").alias("iso3"), "country", F.col("region").alias("continent"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") * F.lit(5.0)).alias("area_sqkm"),
    )


def sources(t: Tables) -> Sources:
    return Sources(
        aquaculture_wide=aquaculture_wide(t),
        trade_wide=trade_wide(t),
        balance_wide=balance_wide(t),
        catch=catch(t),
        countries=countries(t),
        species_nutrients=species_nutrients(t),
        edible=edible(t),
        food_base=food_base(t),
        denied=denied(t),
        groups=groups(t),
        populations=populations(t),
    )
