"""Values that define the study. They are data, not logic."""

# Categories.
FOCAL_SPECIES = "Quercus sp."
EMPTY_MARKER = "0"
SHOOT_NOTES = ["stubbskott, räknas ej?", "stubbskott", "stubbskott på ovan rönn", "stubbskott av nian"]
LARGEST_DIAMETER_CM = 5
SMALL_DIAMETER_CLASS = "0.1-5"

# Campaigns.
CURRENT_YEAR = 2025
CURRENT_AREA_M2 = 5.0
TREE_PLOT_AREA_HA = 0.1
TREE_YEAR = 2003
EARLY_YEARS = [2003, 2005]
YEARS_LEFT_OUT = [2001, 2002]
SUBPLOT_LEFT_OUT = "extra"
SPECIES_LEFT_OUT = "Rubus idaeus"
VISITS_LEFT_OUT = [
    {"site": "Skölvene", "transect": "Ö35", "subplot": "3"},
    {"site": "Karla", "transect": "NV45", "subplot": ["2", "3", "4"]},
]

# Transects with a basal-area measurement.
MEASURED_TRANSECTS = {
    "Karla": ["NV45", "SO55"],
    "Rya åsar": ["NO80", "SV55"],
    "Sandviksås": ["V55", "Ö45"],
    "Skölvene": ["V55", "Ö55"],
    "Östadkulle": ["V75", "Ö75"],
}

# Site names by area code.
SITE_NAMES = {
    "KAR": "Karla",
    "RYA": "Rya åsar",
    "SAN": "Sandviksås",
    "SKÖ": "Skölvene",
    "ÖST": "Östadkulle",
}

# Species merged into one name.
MERGED_SPECIES = {"Betula sp.": ["Betula pendula", "Betula pubescens"], "Salix sp.": ["Salix caprea"]}

# Zone rules as (zone, area code, plot or None for any, section ranges or None for all).
STANDING_ZONES = [
    ("core", "KAR", "SO", [(351, 554)]),
    ("core", "KAR", "NV", [(251, 454)]),
    ("core", "RYA", "NO", [(851, 1054)]),
    ("core", "RYA", "SV", None),
    ("core", "SAN", "Ö", [(251, 454)]),
    ("core", "SAN", "V", None),
    ("core", "SKÖ", None, [(351, 554)]),
    ("core", "ÖST", None, [(751, 954)]),
    ("extended", "KAR", "SO", [(651, 954)]),
    ("extended", "RYA", "NO", [(751, 754)]),
    ("extended", "SAN", "Ö", [(651, 754)]),
    ("extended", "SKÖ", "Ö", [(251, 254), (651, 754)]),
    ("extended", "SKÖ", "V", [(251, 254)]),
    ("extended", "ÖST", "Ö", [(451, 654)]),
]
REMOVED_ZONES = [
    ("core", "KAR", None, [(350, 550)]),
    ("core", "RYA", None, [(850, 1050)]),
    ("core", "SAN", None, [(250, 450)]),
    ("core", "SKÖ", None, [(350, 550)]),
    ("core", "ÖST", None, [(750, 950)]),
    ("extended", "KAR", "SO", [(650, 950)]),
    ("extended", "RYA", "NO", [(750, 750)]),
    ("extended", "SAN", "Ö", [(650, 650), (750, 750)]),
    ("extended", "SKÖ", "Ö", [(250, 250), (650, 650), (750, 750)]),
    ("extended", "ÖST", "Ö", [(450, 650)]),
]

# Zone areas in hectares as (zone, area code, plot or None for any, area).
ZONE_AREAS_HA = [
    ("core", "KAR", None, 0.249),
    ("core", "RYA", None, 0.249),
    ("core", "ÖST", None, 0.249),
    ("core", "SAN", None, 0.3),
    ("core", "SKÖ", None, 0.3),
    ("extended", "KAR", "SO", 0.332),
    ("extended", "RYA", "NO", 0.083),
    ("extended", "SAN", "Ö", 0.2),
    ("extended", "SKÖ", "Ö", 0.3),
    ("extended", "SKÖ", "V", 0.1),
    ("extended", "ÖST", "Ö", 0.249),
]
