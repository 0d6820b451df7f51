"""Labels, lookup tables and cut points the results depend on."""

# ---- target categories -------------------------------------------------------
# "Marine fish; Other" (override, lower-case f) and "Marine Fish; Other" (maps)
# are two different labels on purpose; only the profile recode unifies them.
OVERRIDE_CATEGORY = "Marine fish; Other"
UNIDENTIFIED_SPECIES = "Marine fishes not identified"
FRESHWATER_CATEGORY = "Freshwater Fish"
PROFILE_CATEGORY_RECODE = {"Marine Fish; Other": "Marine fish; Other"}

AQUACULTURE_CATEGORIES = {
    "Cephalopods": "Cephalopods",
    "Demersal Marine Fish": "Demersal Fish",
    "Pelagic Marine Fish": "Pelagic Fish",
    "Crustaceans": "Crustaceans",
    "Marine Fish NEI": "Marine Fish; Other",
    "Molluscs excl. Cephalopods": "Moluscs; Other",
    "Freshwater and Diadromous Fish": "Freshwater Fish",
    "Aquatic Plants": "Aquatic Plants",
    "Aquatic Animals NEI": "Aquatic Animals; Others",
}

TRADE_CATEGORIES = {
    "Cephalopods": "Cephalopods",
    "Demersal fish": "Demersal Fish",
    "Demersal": "Demersal Fish",
    "Demersal frozen": "Demersal Fish",
    "Pelagic fish": "Pelagic Fish",
    "Pelagic": "Pelagic Fish",
    "Crustaceans": "Crustaceans",
    "Marine fish nei": "Marine Fish; Other",
    "Molluscs excl. cephalopods": "Moluscs; Other",
    "Molluscs excl. ceph.": "Moluscs; Other",
    "Freshwater & diadromous fish": "Freshwater Fish",
    "Freshwater & diadromous": "Freshwater Fish",
    "Aquatic animals nei": "Aquatic Animals; Others",
}

CATCH_CATEGORIES = {
    "cephalopods": "Cephalopods",
    "demersalsm": "Demersal Fish",
    "demersalmd": "Demersal Fish",
    "demersallg": "Demersal Fish",
    "bathydemersalsm": "Demersal Fish",
    "bathydemersalmd": "Demersal Fish",
    "bathydemersallg": "Demersal Fish",
    "flatfishsm md": "Demersal Fish",
    "flatfishlg": "Demersal Fish",
    "reef-associatedsm": "Demersal Fish",
    "reef-associatedmd": "Demersal Fish",
    "reef-associatedlg": "Demersal Fish",
    "raysm md": "Demersal Fish",
    "raylg": "Demersal Fish",
    "sharksm-md": "Demersal Fish",
    "pelagicsm": "Pelagic Fish",
    "pelagicmd": "Pelagic Fish",
    "pelagiclg": "Pelagic Fish",
    "benthopelagicsm": "Pelagic Fish",
    "benthopelagicmd": "Pelagic Fish",
    "benthopelagiclg": "Pelagic Fish",
    "bathypelagicsm": "Pelagic Fish",
    "bathypelagicmd": "Pelagic Fish",
    "bathypelagiclg": "Pelagic Fish",
    "sharklg": "Pelagic Fish",
    "shrimp": "Crustaceans",
    "lobsters,crab": "Crustaceans",
    "krill": "Crustaceans",
    "otherdeminvert": "Moluscs; Other",
    "jellyfish": "Aquatic Animals; Others",
}

BALANCE_CATEGORIES = {
    "Cephalopods": "Cephalopods",
    "Demersal fish": "Demersal Fish",
    "Pelagic fish": "Pelagic Fish",
    "Crustaceans": "Crustaceans",
    "Marine fish nei": "Marine Fish; Other",
    "Molluscs excl. cephalopods": "Moluscs; Other",
    "Freshwater & diadromous fish": "Freshwater Fish",
    "Aquatic animals nei": "Aquatic Animals; Others",
}

EDIBLE_SHARE = {
    "Cephalopods": 0.99,
    "Crustaceans": 0.8,
    "Demersal Fish": 0.8,
    "Marine fish; Other": 0.8,
    "Pelagic Fish": 0.8,
    "Moluscs; Other": 0.7,
    "Aquatic Animals; Others": 0.8,
    "Aquatic Plants": 0.9,
    "Freshwater Fish": 0.8,
    "Marine Fish; Other": 0.8,
}

# ---- flows, sectors, end uses ------------------------------------------------
MISSING_MARK = "..."
PROCESSED_FLOW = "Processed production"
TRADE_FLOWS = ["Exports", "Imports", "Reexports"]
BALANCE_ELEMENTS = ["Production", "Food imports", "Food exports"]
FILLET_MARK = "fillet"
FILLET_LIVE_WEIGHT_FACTOR = 2
FRESHWATER_CRUSTACEANS = "Freshwater crustaceans"

TRADED_SECTORS = ["Industrial", "Artisanal"]
TRADED_SECTORS_ALL_RETAINED = ["Industrial"]
NON_FOOD_END_USES = ["Fishmeal and fish oil", "Other"]
SEAFOOD_SECTORS = [
    "Artisanal", "Industrial", "Recreational", "Subsistence", "aquaculture", "Import",
]
FOOD_SECTORS = ["ASF", "Other"] + SEAFOOD_SECTORS

# ---- food and nutrient labels ------------------------------------------------
FOOD_GROUPS = {
    "Fish": "ASF",
    "Beef and Veal": "ASF",
    "Eggs": "ASF",
    "Pork": "ASF",
    "Poultry": "ASF",
    "Sheep": "ASF",
    "Butter": "Other",
    "Fruits and vegetables": "Other",
    "Milk": "Other",
    "Other Coarse Grains": "Other",
    "Other Oilseeds": "Other",
    "#N/A": "Other",
    "Pulses": "Other",
    "Sugar": "Other",
    "Rice": "Other",
    "Vegetable oils": "Other",
    "Maize": "Other",
    "Wheat": "Other",
    "Roots tubers": "Other",
}
TOTAL_PRODUCT = "Total food"

NUTRIENT_CODES = {
    "CA": "Calcium",
    "FE": "Iron",
    "MFAT": "Monounsaturated fatty acids",
    "O3": "Omega-3 fatty acids",
    "PFAT": "Polyunsaturated fatty acids",
    "SFAT": "Saturated fatty acids",
    "TFAT": "Fat",
    "VitA1": "Vitamin A",
    "VitB": "Vitamin B12",
    "ZN": "Zinc",
    "PROT": "Protein",
    "DES": "Calories",
}
KEPT_NUTRIENTS = [
    "Iron", "Zinc", "Protein", "Vitamin A", "Vitamin B12", "Omega-3 fatty acids", "Calcium",
]
OMEGA3_LONG = "Omega-3 fatty acids"
OMEGA3_SHORT = "DHA+EPA"

FOOD_BASE_BLANK_HEADERS = {
    "OUTPUT,0": "output",
    "_c1": "iso3c",
    "_c2": "food_abrev",
    "_c3": "nutrient",
}
GROUP_AS_COUNTRY = ["EUN"]

# value is per 100 g and edible weight is in tonnes: 10,000 x 100 g per tonne
PORTIONS_PER_TONNE = 10000
DAYS_PER_YEAR = 365

# ---- presentation rules that change data -------------------------------------
SECTOR_SHARE_LABELS = {
    "perc_SSF": "Small-scale",
    "perc_artisanal": "Artisanal",
    "perc_subsistence": "Subsistence",
    "perc_industrial": "Industrial",
    "perc_import": "Imports",
    "perc_Recreational": "Recreational",
    "perc_aquaculture": "Mariculture",
}
SECTOR_LEVELS = ["Recreational", "Mariculture", "Industrial", "Subsistence", "Artisanal"]
SECTOR_LEVELS_WITH_IMPORTS = ["Imports"] + SECTOR_LEVELS
NUTRIENT_LEVELS = ["Zinc", "Iron", "Vitamin B12", "DHA+EPA", "Vitamin A", "Calcium"]
CAPS_ALL_FOOD = {"Calcium": 50.0, "Zinc": 20.0, "Iron": 20.0, "Vitamin A": 10.0}

CLASS_LEVELS = [
    "Less vulnerable and less reliant",
    "Less vulnerable but reliant",
    "Vulnerable but less reliant",
    "Vulnerable and reliant",
]
CLASS_THRESHOLD = 0.70
SWEEP_THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
EMPHASIS_FULL = 1.0
EMPHASIS_MUTED = 0.8

POPULATION_BANDS = ["km_10", "km_20", "km_30", "km_40", "km_50", "Total_pop"]
DEFAULT_POPULATION_BAND = "km_20"

SMALL_PLACE_AREA = 25000.0
TINY_PLACE_AREA = 10.0
EXCLUDED_CONTINENT = "Europe"

EARTH_RADIUS_KM = 6371.0088
