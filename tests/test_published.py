"""Published results from a few of their rows, typed by hand."""

import pytest
from pyspark.sql import functions as F

from supplyloom.operators import aggregates
from supplyloom.plans import reports

#: Country, mean share, intake, class.  Seven of ten lie below each cut, as the cut of 0.70 asks.
CLASSIFIED = [
    ("AUS", 0.446774469252, 17.2469319566, "Less vulnerable and less reliant"),
    ("DOM", 11.697436476, 32.9689132712, "Less vulnerable and less reliant"),
    ("EST", 1.65950868699, 30.64300673, "Less vulnerable and less reliant"),
    ("IDN", 9.64505503576, 36.895211232, "Less vulnerable and less reliant"),
    ("TUR", 3.77849418722, 25.249075978, "Less vulnerable and less reliant"),
    ("CHL", 24.3032663207, 32.7252317096, "Less vulnerable but reliant"),
    ("GUY", 21.9437680067, 17.4352708131, "Less vulnerable but reliant"),
    ("BOL", 0.0, 47.9192395243, "Vulnerable but less reliant"),
    ("DJI", 10.676962959, 49.7987796676, "Vulnerable but less reliant"),
    ("PRK", 40.237854664, 86.1606336095, "Vulnerable and reliant"),
]
#: A country with a known share and no known intake has no class.
UNKNOWN = ("AIA", 14.858497)


@pytest.fixture
def intake(table):
    return table("iso3 string, intake double", [(r[0], r[2]) for r in CLASSIFIED])


def shares(table, rows):
    return table("iso3c string, perc_SSF double", [r[:2] for r in rows])


def test_classes_at_the_strict_cut(table, intake):
    found = reports.vulnerability_class(shares(table, CLASSIFIED), intake).collect()
    assert {r["iso3c"]: r["category"] for r in found} == {r[0]: r[3] for r in CLASSIFIED}
    ranks = {r["iso3c"]: (r["q_SSF"], r["q_intake"]) for r in found}
    assert ranks["DOM"][0] == ranks["IDN"][1] == 0.7


def test_unknown_intake_has_no_class(table, intake):
    found = reports.vulnerability_class(shares(table, [*CLASSIFIED, UNKNOWN]), intake).collect()
    assert {r["iso3c"]: r["category"] for r in found} == {r[0]: r[3] for r in CLASSIFIED} | {"AIA": None}


def test_intake_is_ranked_among_countries_without_shares_too(table, intake):
    scored = [r for r in CLASSIFIED if r[0] not in ("AUS", "TUR", "EST")]
    found = reports.vulnerability_class(shares(table, scored), intake).collect()
    assert {r["iso3c"]: r["q_intake"] for r in found}["IDN"] == 0.7
    assert {r["iso3c"]: r["is_def"] for r in found} == {r[0]: 2 * r[3].startswith("Vuln") for r in scored}


def test_freshwater_share_of_crustacean_exports(table):
    published = {"Armenia": (84, 323, 26.0061919504644), "Italy": (781, 4289, 18.2093728141758),
                 "Finland": (1, 10, 10.0), "China": (19115, 313467, 6.0979305636638)}
    parts = [
        (country, group, float(tonnes))
        for country, (fresh, total, _) in published.items()
        for group, tonnes in (("Freshwater crustaceans", fresh), ("Shrimps, prawns", total - fresh))
    ]
    out = aggregates.subset_share(
        table("country string, grp string, tonnes double", parts), ["country"], "tonnes",
        F.col("grp") == "Freshwater crustaceans", "part", "whole", "share",
    ).collect()
    assert {r["country"]: r["share"] for r in out} == pytest.approx({c: p[2] for c, p in published.items()})
