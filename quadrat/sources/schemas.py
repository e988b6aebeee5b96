"""Explicit schemas of the raw files (DOUBLE marks a number, whatever its decimal mark in the file)."""

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "b": T.BooleanType()}
    out = T.StructType()
    for item in text.split(";"):
        name, kind = item.rsplit(":", 1)
        out.add(name.strip(), kinds[kind])
    return out


# Column names of the input files.
SOIL = _schema(
    "site:s; plot:s; treatment:s; transect:s; subplot:s; tray_weight_g:d; wet_weight_tray_g:d; wet_weight_g:d;"
    "dry_weight_tray_22h_g:d; dry_weight_tray_46h_g:d; mass_change_22_46_g:d; dry_weight_tray_70h_g:d;"
    "mass_change_46_70_g:d; dry_weight_tray_96h_g:d; mass_change_70_96_g:d; dry_weight_tray_168h_g:d;"
    "mass_change_96_168_g:d; 10g_measurement:s; pH:d; Comments_or_dup:s; dup_pH:s"
)
OLD_CANOPY = _schema("site:s; plot:s; year:i; transect:s; subplot:s; canopy_openness:d")
SPECIES_CODES = _schema("Tradartkod:i; Trad_lati:s; Trad_sve:s; Kategori:s; Forval:i")
SEEDLINGS = _schema("site:s; plot:s; treatment:s; transect:s; subplot:s; position_m:d; species:s; notes:s")
CANOPY = _schema("Site:s; Plot:s; Treatment:s; Transect:s; Subplot:s; Canopy openness (%):d")
TREES = _schema("site:s; plot:s; treatment:s; species:s; diameter_cm:d")
OLD_DATA = _schema(
    "date:s; site:s; plot:s; treatment:s; transect:s; subplot:s; species:s; area_m2:d; canopy_openness:d; pH:d;"
    "shoot:b; in_exclosure:b; diameter_cm:s"
)
STANDING = _schema("Omrkod:s; Yta:s; BSektion:i; Tradartkod:i; Diameter:d; Antal:i")
REMOVED = STANDING
