import math

from pyspark.sql import functions as F

from conftest import rows_of
from quadrat.plans import bases, campaigns, zones
from quadrat.plans import study_values as v
from quadrat.plans.basal_area import net_of, widen
from quadrat.plans.zero_fill import zero_fill
from quadrat.sources import schemas
from quadrat.sources.delimited import load_tidy, read_delim, read_delim_eu, write_tidy

OAK = v.FOCAL_SPECIES


def test_zero_fill_gives_each_visit_a_focal_row(make):
    rows = [
        ("full", OAK, True), ("full", OAK, True), ("full", "Pinus", None), ("empty", "0", None), ("other", "Pinus", False),
        ("both", "0", None), ("both", OAK, False), ("unknown", None, None),
    ]
    out = zero_fill(make(rows, "visit string, species string, shoot boolean"), ["visit"], "species", OAK, "0")
    assert rows_of(out, "visit", "species", "shoot", "density") == sorted([
        ("full", OAK, True, 2), ("full", "Pinus", False, 1), ("empty", OAK, False, 0), ("other", "Pinus", False, 1),
        ("other", OAK, False, 0), ("both", OAK, False, 0), ("both", OAK, False, 1)], key=repr)


def test_zone_rules(make):
    rows = [("KAR", "SO", 351), ("KAR", "SO", 600), ("KAR", "SO", 700), ("RYA", "SV", 1), ("SKÖ", "Ö", 252), ("SKÖ", "Ö", None)]
    df = make(rows, "Omrkod string, Yta string, BSektion int")
    got = rows_of(zones.assign_zone(df, v.STANDING_ZONES))
    assert got == sorted([
        ("KAR", "SO", 351, "core"), ("KAR", "SO", 700, "extended"), ("RYA", "SV", 1, "core"), ("SKÖ", "Ö", 252, "extended")], key=repr)
    rules = make([("KAR", "SO", 351, 554, "core"), ("KAR", None, 650, 950, "extended"), ("SKÖ", "Ö", 251, 254, "extended")],
                 "code string, plot string, lo int, hi int, zone string")
    assert rows_of(zones.assign_zone_table(df, rules), "BSektion", "area_type") == [(252, "extended"), (351, "core"), (700, "extended")]


def test_net_of_drops_what_is_gone(make):
    schema = "k string, s string, basal_area double"
    standing = make([("p", "a", 3.0), ("p", "b", 2.0), ("p", "c", 1.0), ("p", "d", 4.0)], schema)
    removed = make([("p", "a", 1.0), ("p", "b", 2.0), ("p", "c", 5.0)], schema)
    assert rows_of(net_of(standing, removed, ["k", "s"])) == [("p", "a", 2.0), ("p", "d", 4.0)]


def test_widen(make):
    df = make([("p", "Betula sp.", 1.0), ("p", "Quercus sp.", 2.0), ("q", "Betula sp.", 4.0)], "plot string, species string, basal_area double")
    assert rows_of(widen(df, ["plot"]), "plot", "total_ba", "betula_sp_ba", "quercus_sp_ba") == [("p", 3.0, 1.0, 2.0), ("q", 4.0, 4.0, 0.0)]


def _study(make):
    seed = "site string, plot string, treatment string, transect string, subplot string, position_m double, species string, notes string"
    place = ("Karla", "SO", "thinned")
    seedlings = make([
        (*place, "SO55", "1", 1.0, OAK, None), (*place, "SO55", "1", 2.0, OAK, "stubbskott"), (*place, "SO55", "1", 2.0, "Pinus", None),
        (*place, "SO55", "2", None, "0", None), (*place, "SO35", "1", 1.0, "Pinus", None),
    ], seed)
    canopy = make([("Karla", "SO", "thinned", "SO55", "1", 10.0), ("Karla", "SO", "thinned", "SO55", "1", 14.0)],
                  "Site string, Plot string, Treatment string, Transect string, Subplot string, `Canopy openness (%)` double")
    soil = make([(*place, "SO55", "1", "x", None), (*place, "SO55", "1", "10,0", 4.5), (None,) * 7],
                "site string, plot string, treatment string, transect string, subplot string, `10g_measurement` string, pH double")
    trees = make([(*place, OAK, 20.0), (*place, OAK, 10.0), (*place, "Betula sp.", 40.0)],
                 "site string, plot string, treatment string, species string, diameter_cm double")
    old = "date string, site string, plot string, treatment string, transect string, subplot string, species string, area_m2 double, " \
        "canopy_openness double, pH double, shoot boolean, in_exclosure boolean, diameter_cm string"

    def o(date, sub, species, area=5.0, can=None, shoot=None, excl=False, d="", transect="SO55"):
        return (date, *place, transect, sub, species, area, can, 5.1, shoot, excl, d)

    historic = make([
        o("2003-07-01", "1", OAK, 3.0, 20.0), o("2003-07-01", "1", OAK, 2.0, 20.0, d="3.2"), o("2003-07-01", "1", OAK, 3.0, 20.0, d="7"),
        o("2003-07-01", "2", "0", can=None), o("2005-07-01", "1", OAK, shoot=True, d="0.1-5"), o("2001-07-01", "1", OAK),
        o("2003-07-01", "extra", OAK), o("2003-07-01", "3", "Rubus idaeus"), o("2003-07-01", "4", OAK, excl=True),
        o("2003-07-01", "3", OAK, transect="NV45"),
    ], old)
    old_canopy = make([("Karla", "SO", 2003, "SO55", "2", 33.0), ("Karla", "SO", 2003, "SO55", "1", 99.0)],
                      "site string, plot string, year int, transect string, subplot string, canopy_openness double")
    tree = "Omrkod string, Yta string, BSektion int, Tradartkod int, Diameter double, Antal int"
    standing = make([("KAR", "SO", 400, 9, 200.0, 2), ("KAR", "SO", 400, 31, 100.0, 1), ("KAR", "SO", 400, 30, 100.0, 1), ("KAR", "SO", 700, 9, 300.0, 1)], tree)
    removed = make([("KAR", "SO", 410, 9, 200.0, 1), ("KAR", "SO", 410, 31, 500.0, 1)], tree)
    codes = make([(9, OAK), (30, "Betula pubescens"), (31, "Betula pendula")], "Tradartkod int, Trad_lati string")
    return seedlings, canopy, soil, trees, historic, old_canopy, standing, removed, codes


def test_campaigns_and_bases(spark, make, tmp_path):
    seedlings, canopy, soil, trees, old, old_canopy, standing, removed, codes = _study(make)
    current = campaigns.prepare_current(seedlings, canopy, soil, trees)
    got = rows_of(current.withColumn("oak", F.round("quercus_sp_ba", 6)), "transect", "subplot", "species", "shoot", "density", "canopy_openness", "pH", "oak")
    oak = round(math.pi * (0.1**2 + 0.05**2) / 0.1, 6)
    assert got == sorted([
        ("SO55", "1", OAK, False, 1, 12.0, 4.5, oak), ("SO55", "1", OAK, True, 1, 12.0, 4.5, oak),
        ("SO55", "1", "Pinus", False, 1, 12.0, 4.5, oak), ("SO55", "2", OAK, False, 0, None, None, oak),
        ("SO35", "1", "Pinus", False, 1, None, None, None), ("SO35", "1", OAK, False, 0, None, None, None)], key=repr)

    historic = campaigns.prepare_historic(old, old_canopy, standing, removed, codes)
    core = math.pi * 0.1**2 / 0.249  # two oaks minus one; the birches lose more than they had
    ext = math.pi * 0.15**2 / 0.332
    got = rows_of(historic.withColumn("ba", F.round("total_ba", 9)), "year", "subplot", "area_m2", "canopy_openness", "shoot", "density", "area_type", "ba")
    assert got == sorted([
        (2003, "1", 5.0, 20.0, False, 2, "core", round(core, 9)), (2003, "1", 5.0, 20.0, False, 2, "extended", round(ext, 9)),
        (2003, "2", 5.0, 33.0, False, 0, "core", round(core, 9)), (2003, "2", 5.0, 33.0, False, 0, "extended", round(ext, 9)),
        (2005, "1", 5.0, None, True, 1, None, None)], key=repr)

    path = str(tmp_path / "tidy")
    write_tidy(campaigns.integrate(historic, current), path)
    tidy = load_tidy(spark, path)
    assert tidy.count() == 11
    keys = ("year", "transect", "subplot", "oak_count")
    assert rows_of(bases.analysis_base(tidy, "oaks_all"), *keys) == [
        (2003, "SO55", "1", 2), (2003, "SO55", "2", 0), (2005, "SO55", "1", 1), (2025, "SO35", "1", 0), (2025, "SO55", "1", 2), (2025, "SO55", "2", 0)]
    assert rows_of(bases.analysis_base(tidy, "oaks_noshoots"), *keys)[2] == (2005, "SO55", "1", 0)
    ext_base = bases.analysis_base(tidy, "oaks_all_ext").where("year = 2003 and subplot = '1'").first()
    mean = (core * 0.249 + ext * 0.332) / (0.249 + 0.332)
    assert abs(ext_base["total_ba"] - mean) < 1e-9 and ext_base["oak_count"] == 2
    period = bases.analysis_base(tidy, "oaks_period")
    assert rows_of(period, "period", "transect", "subplot", "oak_count")[0] == ("early", "SO55", "1", 1)
    assert bases.analysis_base(tidy, "oaks_2025").count() == 3
    assert bases.analysis_base(tidy, "oaks_sem").count() == 3
    assert rows_of(bases.analysis_base(tidy, "total_density"), "total_density")[-1] == (3,)
    assert set(bases.modelling_bases(tidy)) >= {"oaks_all", "oaks_sem"}


def test_european_csv(spark, tmp_path):
    path = tmp_path / "soil.csv"
    text = "﻿site;year;subplot;canopy_openness;note\nRya åsar;2001;1;11,14;ok\nÖst;2003;x;1.234,5;\n;;;;\nKarla;2005;2;;NA\n"
    path.write_text(text, encoding="utf-8")
    schema = schemas._schema("site:s;year:i;subplot:s;canopy_openness:d;note:s")
    got = rows_of(read_delim_eu(spark, str(path), schema))
    assert got == sorted([("Rya åsar", 2001, "1", 11.14, "ok"), ("Öst", 2003, "x", 1234.5, None), (None,) * 5, ("Karla", 2005, "2", None, None)], key=repr)


def test_point_csv_keeps_blank_text(spark, tmp_path):
    path = tmp_path / "old.csv"
    path.write_text("species;area_m2;shoot;diameter_cm\nOak;2.5;TRUE;\nNA;3;FALSE;0.1-5\n", encoding="utf-8")
    schema = schemas._schema("species:s;area_m2:d;shoot:b;diameter_cm:s")
    assert rows_of(read_delim(spark, str(path), schema)) == [("Oak", 2.5, True, ""), (None, 3.0, False, "0.1-5")]


def test_tidy_csv_round_trip(spark, make, tmp_path):
    df = make([("a", None, 1), ("b", 2.5, None)], "s string, x double, n int")
    path = str(tmp_path / "t")
    write_tidy(df, path, "csv", None)
    assert rows_of(load_tidy(spark, path, "csv", df.schema)) == rows_of(df)


def test_columns_are_bound_by_name(spark, tmp_path):
    """Shuffled and extra columns, all digits, and an error for a missing name."""
    import pytest
    from pyspark.sql import types as T

    path = tmp_path / "shuffled.csv"
    path.write_text("﻿year;extra;canopy;site\n2003;x;0,1234567890123456;A\n2001;;1.234,5;NA\n", encoding="utf-8")
    schema = T.StructType.fromDDL("site string, canopy double, year int")
    rows = sorted(map(tuple, read_delim_eu(spark, str(path), schema).collect()), key=repr)
    assert rows == [("A", 0.1234567890123456, 2003), (None, 1234.5, 2001)]
    with pytest.raises(ValueError, match="no column plot"):
        read_delim_eu(spark, str(path), T.StructType.fromDDL("plot string"))


def test_sorted_sink(spark, tmp_path):
    """Files in order hold the table in order and don't overlap, also where one key has most rows."""
    import glob

    import pyarrow.parquet as pq

    from quadrat.sources.delimited import load_tidy, write_tidy

    rows = [("a" if k % 3 else None if k % 5 else f"k{k % 7}", k % 11, float(k)) for k in range(5000)]
    path = str(tmp_path / "sorted")
    df = spark.createDataFrame(rows, "site string, year int, y double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would go to one file
    try:
        write_tidy(df, path, partition_by=None, sort_by=["site", "year"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [pq.read_table(f).to_pylist() for f in sorted(glob.glob(f"{path}/part-*"))]
    key = lambda r: (r["site"] is not None, r["site"] or "", r["year"])
    found = [key(r) for f in files for r in f]
    assert found == sorted(found) and len(found) == 5000 and len(files) > 1
    assert max(map(len, files)) < 3000  # the key with two thirds of the rows is in several files
    assert load_tidy(spark, path).where("site = 'k3' AND year = 2").count() == sum(r[:2] == ("k3", 2) for r in rows)


def test_modelling_bases_share_their_counts(make):
    place = ("S", "P", "thinned")
    rows = [
        (*place, 2003, "T1", "1", 5.0, OAK, False, 3, 10.0, 4.0, 2.0, 1.0, "core"), (*place, 2003, "T1", "1", 5.0, OAK, True, 2, 10.0, 4.0, 2.0, 1.0, "core"),
        (*place, 2003, "T1", "1", 5.0, OAK, False, 3, 10.0, 4.0, 6.0, 3.0, "extended"), (*place, 2025, "T1", "2", 5.0, OAK, False, 4, None, 5.0, 2.0, 1.0, "core"),
    ]
    tidy = make(rows, "site string, plot string, treatment string, year int, transect string, subplot string, area_m2 double, species string, "
                      "shoot boolean, density long, canopy_openness double, pH double, total_ba double, quercus_sp_ba double, area_type string")
    kept, area = [], F.lit(1.0)
    out = bases.modelling_bases(tidy, early=[2003], area=area, keep=lambda df: kept.append(df) or df)
    assert len(kept) == 3  # the core counts, the extended ones, the periods: the tidy table is read for the first two
    for name in ("oaks_all", "oaks_noshoots", "oaks_all_ext", "oaks_noshoots_ext"):
        assert rows_of(out[name].drop("period", "year_c")) == rows_of(bases.analysis_base(tidy, name, early=[2003], area=area))
    for name in ("oaks_period", "oaks_0305", "oaks_2025", "oaks_sem"):
        assert rows_of(out[name]) == rows_of(bases.analysis_base(tidy, name, early=[2003], area=area))
    assert rows_of(out["oaks_all"], "subplot", "oak_count") == [("1", 5), ("2", 4)]
    assert rows_of(out["oaks_noshoots_ext"], "subplot", "oak_count", "total_ba") == [("1", 3, 4.0), ("2", 4, 2.0)]
