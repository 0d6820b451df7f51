"""Explicit schemas of the tables handed between stages (DDL strings)."""

CATCH = (
    "fishing_entity string, year int, functional_group string, scientific_name string, "
    "common_name string, sector_type string, end_use_name string, catch double"
)
COUNTRIES = "missing_countries string, iso3c string"
REEXPORTS = "iso3c string, genus_cat string, Reexports double"
SPECIES_NUTRIENTS = "species string, genus_cat string, nutrient string, value double"
EDIBLE = "genus_cat string, edible double"
COASTAL_POPULATION = (
    "iso3c string, km_10 double, km_20 double, km_30 double, km_40 double, km_50 double, "
    "Total_pop double"
)
COUNTRY_GROUPS = "iso3c string, group string"
DEFICIENCY = "iso3 string, nutrient string, perc_deficient double, ndeficient double"
COUNTRY_DIM = "iso3 string, country string, continent string, region string, area_sqkm double"

COMMERCIAL_PRODUCTION = (
    "country string, iso3c string, year int, genus_cat string, scientific_name string, "
    "common_name string, production_sector string, tonnes double"
)
CONSUMPTION = (
    "iso3c string, year int, genus_cat string, common_name string, scientific_name string, "
    "production_sector string, pred_consumption double"
)
NUTRIENT_SUPPLY = (
    "iso3c string, nutrient string, production_sector string, nut_supply double, consump double"
)
CLASSES = "country string, iso3c string, perc_SSF double, intake double, category string"
