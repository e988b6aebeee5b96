"""The same results as plain SQL over the benchmark tables, for the queries that have one."""

from __future__ import annotations

from quadrat import bindings as b
from quadrat import study_bindings as study
from quadrat.plans import study_values as v

V = "site, plot, treatment, year, transect, subplot, area_m2"
K = "site, plot, treatment, transect, subplot, area_m2"


def _zone_case() -> str:
    """Zone tags of a tree row as a list, from the shared rules."""
    def test(rule) -> str:
        _, site, plot, ranges = rule
        parts = [f"site = '{site}'"] + ([f"plot = '{plot}'"] if plot else [])
        if ranges:
            parts.append("(" + " OR ".join(f"section BETWEEN {lo} AND {hi}" for lo, hi in ranges) + ")")
        return "(" + " AND ".join(parts) + ")"

    zones = {z: " OR ".join(test(r) for r in b.ZONES if r[0] == z) for z in ("core", "extended")}
    return " UNION ALL ".join(f"SELECT tree.*, '{z}' AS area_type FROM tree WHERE {t}" for z, t in zones.items())


def _zone_area(prefix: str = "") -> str:
    cases = " ".join(
        f"WHEN {prefix}area_type = '{z}' AND {prefix}site = '{s}'" + (f" AND {prefix}plot = '{p}'" if p else "")
        + f" THEN CAST({a} AS DOUBLE)" for z, s, p, a in b.ZONE_AREAS
    )
    return f"CASE {cases} END"


CTE = {
    "place": """SELECT n_nationkey, r_name AS site, n_name AS plot,
        CASE WHEN n_nationkey % 2 = 0 THEN 'control' ELSE 'thinned' END AS treatment
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "spot": """SELECT c_custkey, site, plot, treatment, c_mktsegment AS transect, CAST(c_custkey AS VARCHAR) AS subplot,
        CAST(CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 5 END AS DOUBLE) AS area_m2, c_acctbal / 1000 AS "pH"
        FROM customer JOIN place ON c_nationkey = n_nationkey""",
    "visit": f"""SELECT o_orderkey, {V.replace('year', 'CAST(year(o_orderdate) AS INTEGER) AS year')}
        FROM orders JOIN spot ON o_custkey = c_custkey""",
    "item": """SELECT l_orderkey, p_type, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "seedling": f"""SELECT o_orderkey, {V}, COALESCE(p_type, '0') AS species, l_returnflag = 'R' AS shoot
        FROM visit LEFT JOIN item ON o_orderkey = l_orderkey""",
    "filled": f"""SELECT {V}, species, COALESCE(shoot, FALSE) AS shoot, density FROM (
        SELECT {V}, species, shoot, count(*) AS density FROM seedling WHERE species <> '0' GROUP BY ALL
        UNION ALL
        SELECT {V}, 'STANDARD', NULL, 0 FROM seedling GROUP BY {V}
        HAVING bool_or(species = '0') OR NOT bool_or(species = 'STANDARD'))""",
    "base": f"""SELECT {V}, CAST(sum(density) AS BIGINT) AS oak_count,
        CAST(COALESCE(sum(density) FILTER (WHERE NOT shoot), 0) AS BIGINT) AS oak_count_noshoots,
        CASE WHEN year IN (1995, 1996, 1997) THEN 'early' ELSE 'late' END AS period
        FROM filled WHERE species = 'STANDARD' GROUP BY {V}""",
    "reading": """SELECT CAST(user_id AS VARCHAR) AS subplot, avg(value) AS canopy_openness FROM events GROUP BY 1""",
    "tree": """SELECT site, plot, p_type AS species, p_size AS section, l_quantity AS diameter,
        l_returnflag = 'A' AS removed, pi() * pow(l_quantity / 100 / 2, 2) AS area
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN place ON s_nationkey = n_nationkey""",
    "zoned": _zone_case(),
    "zlong": f"""SELECT site, plot, area_type, species, sum(area) / {_zone_area()} AS basal_area
        FROM zoned GROUP BY site, plot, area_type, species""",
    "zwide": """SELECT site, plot, area_type, sum(basal_area) AS total_ba,
        COALESCE(sum(basal_area) FILTER (WHERE species = 'STANDARD'), 0) AS standard_ba
        FROM zlong GROUP BY site, plot, area_type""",
    "cov": """SELECT base.*, canopy_openness, spot."pH", total_ba, standard_ba FROM base
        LEFT JOIN reading USING (subplot) LEFT JOIN spot ON spot.subplot = base.subplot
        LEFT JOIN zwide ON zwide.site = base.site AND zwide.plot = base.plot AND zwide.area_type = 'core'""",
    "rates": """SELECT treatment, period, count(*) AS n, CAST(sum(oak_count) AS DOUBLE) AS total, sum(area_m2) AS exposure
        FROM base GROUP BY treatment, period""",
    "wide96": """SELECT site, plot, area_type, total_ba, standard_ba, 1996 AS year FROM zwide""",
    "fan": f"""SELECT {', '.join('base.' + c for c in V.split(', '))}, oak_count, area_type, total_ba, standard_ba
        FROM base LEFT JOIN wide96 ON wide96.site = base.site AND wide96.plot = base.plot AND wide96.year = base.year""",
    "fitted": """SELECT base.*, sum(oak_count) OVER (PARTITION BY treatment) / sum(area_m2) OVER (PARTITION BY treatment)
        * area_m2 AS mu FROM base""",
    "cc": """SELECT * FROM cov WHERE canopy_openness IS NOT NULL AND "pH" IS NOT NULL AND total_ba IS NOT NULL""",
}
NEEDS = {
    "spot": ["place"], "visit": ["spot"], "seedling": ["visit", "item"], "filled": ["seedling"], "base": ["filled"],
    "tree": ["place"], "zoned": ["tree"], "zlong": ["zoned"], "zwide": ["zlong"],
    "cov": ["base", "reading", "zwide"], "rates": ["base"], "wide96": ["zwide"], "fan": ["base", "wide96"],
    "fitted": ["base"], "cc": ["cov"],
}


def _with(*names: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n"


def _r(*cols: str, digits: int = 6) -> str:
    return ", ".join(f'round({c}, {digits}) AS "{c}"' for c in cols)


SPECIES_COLS = ", ".join(
    f"round(COALESCE(sum(ba) FILTER (WHERE species = '{s}'), 0), 6) AS {s.lower()}_ba" for s in b.SPECIES
)
MEASURED = " OR ".join(
    f"(site = '{site}' AND transect IN ({', '.join(repr(t) for t in ts)}))" for site, ts in b.MEASURED.items()
)
MASKED = ", ".join(
    f"CASE WHEN {MEASURED} THEN {c} END AS {c}" for c in ["total_ba", *[f"{s.lower()}_ba" for s in b.SPECIES]]
)
ITEM_COLS = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate"
ITEM_ORDER = "l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
REGR = """CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
    round(regr_r2(y, x), 6) AS r2, round(regr_avgx(y, x), 6) AS mean_x, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x,
    round(CASE WHEN count(*) > 2 THEN sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0)
      / nullif(count(*) - 2, 0)) END, 6) AS sigma,
    round(CASE WHEN count(*) > 2 THEN sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0)
      / nullif(count(*) - 2, 0)) END / nullif(sqrt(regr_sxx(y, x)), 0), 6) AS se_slope"""
SXX = """, round(regr_sxx(y, x), 6) AS sxx, round(regr_syy(y, x), 6) AS syy, round(regr_sxy(y, x), 6) AS sxy"""
Z = "1.959963984540054::DOUBLE"


def _t_p(t: str, df: str) -> str:
    """Two-sided Student t tail for whole degrees of freedom: the finite trigonometric sums, with sin and cos of atan(t / sqrt(df))."""
    sine, cos2 = f"(abs({t}) / sqrt({df} + {t} * {t}))", f"({df} / ({df} + {t} * {t}))"
    even = f"""{sine} * list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), lambda j:
        exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1) + j * ln({cos2}))))"""
    odd = f"""2 / pi() * (asin({sine}) + COALESCE({sine} * list_sum(list_transform(range(0, CAST(({df} - 1) // 2 AS BIGINT)), lambda j:
        exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5) + (j + 0.5) * ln({cos2})))), 0))"""
    return f"CASE WHEN {df} % 2 = 0 THEN 1 - ({even}) ELSE 1 - ({odd}) END"


def _chi2_p(x: str, df: str) -> str:
    """Upper chi-square tail for whole degrees of freedom: a finite sum of Poisson-like terms, with a normal tail if odd."""
    terms = f"""COALESCE(list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), lambda j:
        exp((j + ({df} % 2) / 2.0) * ln({x} / 2) - {x} / 2 - lgamma(j + 1 + ({df} % 2) / 2.0)))), 0)"""
    return f"{terms} + CASE WHEN {df} % 2 = 1 THEN {_normal_p(f'sqrt({x})')} ELSE 0 END"


def _t_quantile(z: float, df: str) -> str:
    """Upper quantile from the normal one by the expansion in 1 / df; the degrees of freedom here are in the thousands."""
    terms = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return "(" + " + ".join(f"{c!r} / pow({df}, {k})" for k, c in enumerate(terms)) + ")"


def _tested(inner: str, keys: str, digits: int = 6, with_p: bool = False) -> str:
    """t, df and Fisher interval of rows with n and r, and where asked for the p-value."""
    k = f"{keys}, " if keys else ""
    sure = "n > 2 AND abs(r) < 1 - 1e-12"
    tail = _t_p("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)")
    p = f", round(CASE WHEN {sure} THEN {tail} END, {digits}) AS p_value" if with_p else ""
    atanh = "0.5 * ln((1 + r) / (1 - r))"
    half = f"CASE WHEN n > 3 AND abs(r) < 1 - 1e-12 THEN {Z} / sqrt(n - 3) END"

    def tanh(x: str) -> str:
        return f"(exp(2 * ({x})) - 1) / (exp(2 * ({x})) + 1)"

    return f"""SELECT {k}n, round(r, {digits}) AS r, round(CASE WHEN {sure} THEN r * sqrt((n - 2) / (1 - r * r)) END, {digits}) AS t,
        CASE WHEN n > 2 THEN n - 2 END AS df,
        round({tanh(f'{atanh} - ({half})')}, {digits}) AS lower, round({tanh(f'{atanh} + ({half})')}, {digits}) AS upper{p}
        FROM ({inner})"""


def _pairs(cols: list[str], source: str, key: str, key_expr: str, group: str, with_p: bool = False) -> str:
    parts = []
    for i, x in enumerate(cols):
        for y in cols[i + 1:]:
            both = f'"{x}" IS NOT NULL AND "{y}" IS NOT NULL'
            parts.append(
                f"""SELECT {key_expr}'{x}' AS x, '{y}' AS y, count(*) FILTER (WHERE {both}) AS n,
                CASE WHEN stddev_pop("{x}") FILTER (WHERE {both}) * stddev_pop("{y}") FILTER (WHERE {both}) > 0
                THEN corr("{x}", "{y}") END AS r FROM {source} {group}"""
            )
    return _tested(" UNION ALL ".join(parts), f"{key}x, y", with_p=with_p)


def _box(by: str, source: str, y: str) -> str:
    return f"""SELECT {by}, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median,
        round(any_value(q3), 6) AS q3, round(min(y) FILTER (WHERE inside), 6) AS whisker_lo,
        round(max(y) FILTER (WHERE inside), 6) AS whisker_hi, count(*) FILTER (WHERE NOT inside) AS n_outliers
        FROM (SELECT *, y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM (
            SELECT {by}, CAST({y} AS DOUBLE) AS y FROM {source}) JOIN (
            SELECT {by}, count(*) AS n, quantile_cont(CAST({y} AS DOUBLE), 0.25) AS q1,
              quantile_cont(CAST({y} AS DOUBLE), 0.5) AS q2, quantile_cont(CAST({y} AS DOUBLE), 0.75) AS q3
            FROM {source} GROUP BY {by}) USING ({by})) GROUP BY {by}"""


def _one_factor(offset: bool) -> str:
    exposure = "sum(area_m2)" if offset else "CAST(count(*) AS DOUBLE)"
    return _with("base") + f""", cell AS (SELECT treatment, ln(sum(oak_count) / {exposure}) AS l, 1.0 / sum(oak_count) AS v
          FROM base GROUP BY treatment),
        c AS (SELECT * FROM cell WHERE treatment = 'control'), t AS (SELECT * FROM cell WHERE treatment = 'thinned')
        SELECT term, round(e, 6) AS estimate, round(s, 6) AS std_error, round(e / s, 6) AS statistic, round({_normal_p("e / s")}, 6) AS p_value FROM (
          SELECT '(Intercept)' AS term, c.l AS e, sqrt(c.v) AS s FROM c
          UNION ALL SELECT 'treatmentthinned', t.l - c.l, sqrt(t.v + c.v) FROM c, t)"""


def _normal_p(z: str) -> str:
    """Two-sided normal tail of an expression: a power series up to 3, a mean over a quarter turn beyond."""
    return f"""CASE WHEN abs({z}) <= 3 THEN 1 - 2 * exp(-pow({z}, 2) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 60),
        lambda n: pow(abs({z}), 2 * n + 1) * sqrt(pi()) / (pow(2, n + 1) * gamma(n + 1.5))))
        ELSE list_avg(list_transform(range(0, 64), lambda i: exp(-pow({z}, 2) / 2 / pow(sin((i + 0.5) * pi() / 128), 2)))) END"""


LGAMMA_FACTORIAL = "lgamma(oak_count + 1)"


def _poisson_aic(name: str, exposure: str, mu: str) -> str:
    return f"""SELECT '{name}' AS model, count(*) AS n, CAST(2 AS INTEGER) AS k,
        round(4 - 2 * sum(oak_count * ln(mu) - mu - {LGAMMA_FACTORIAL}), 3) AS aic
        FROM (SELECT oak_count, {mu} AS mu FROM base JOIN (SELECT treatment, sum(oak_count) / {exposure} AS rate
        FROM base GROUP BY treatment) USING (treatment))"""


ORACLE: dict[str, str] = {
    "focal_rate_change": _with("base") + f""", cell AS (SELECT treatment, period, sum(oak_count_noshoots) AS total,
          sum(area_m2) AS exposure FROM base GROUP BY treatment, period)
        SELECT a.treatment, a.period AS level_a, b.period AS level_b,
          round((a.total / a.exposure) / (b.total / b.exposure), 6) AS ratio,
          round(sqrt(1.0 / a.total + 1.0 / b.total), 6) AS se_log,
          round(ln((a.total / a.exposure) / (b.total / b.exposure)) / sqrt(1.0 / a.total + 1.0 / b.total), 6) AS z,
          round({_normal_p("ln((a.total / a.exposure) / (b.total / b.exposure)) / sqrt(1.0 / a.total + 1.0 / b.total)")}, 6) AS p_value,
          round(100 * (b.total / b.exposure) / (a.total / a.exposure) - 100, 6) AS percent_change
        FROM cell a JOIN cell b ON a.treatment = b.treatment AND a.period < b.period""",
    "count_per_visit": _with("seedling") + f"""SELECT {V}, species, shoot, count(*) AS density FROM seedling
        WHERE species <> '0' GROUP BY ALL""",
    "zero_fill_focal": _with("filled") + "SELECT * FROM filled",
    "conditional_sum_keep_zero": _with("base") + "SELECT * EXCLUDE (period) FROM base",
    "sum_counts_all": _with("filled") + f"SELECT {V}, CAST(sum(density) AS BIGINT) AS total_density FROM filled GROUP BY {V}",
    "sum_counts_others": _with("filled") + f"""SELECT {V}, CAST(sum(density) AS BIGINT) AS others_density FROM filled
        WHERE species <> 'STANDARD' GROUP BY {V}""",
    "distinct_visits": _with("visit") + f"SELECT DISTINCT {V} FROM visit",
    "groups_without_focal": _with("seedling") + f"""SELECT {V} FROM seedling GROUP BY {V}
        HAVING NOT bool_or(species = 'STANDARD')""",
    "canopy_left_join": _with("base", "reading") + """SELECT base.*, round(canopy_openness, 6) AS canopy_openness
        FROM base LEFT JOIN reading USING (subplot)""",
    "dedup_samples": f"""SELECT l_orderkey, l_linenumber, {ITEM_COLS} FROM (SELECT *, row_number() OVER (
        PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, {ITEM_ORDER}) AS rn FROM lineitem) WHERE rn = 1""",
    "unique_join": _with("visit") + f"""SELECT visit.*, l_linenumber, l_quantity, l_tax FROM visit LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, {ITEM_ORDER}) AS rn
        FROM lineitem) s ON o_orderkey = l_orderkey AND rn = 1""",
    "blank_row_drop": """SELECT nullif(l_linenumber, 1) AS line, nullif(l_returnflag, 'A') AS flag, count(*) AS n FROM lineitem
        WHERE nullif(l_linenumber, 1) IS NOT NULL OR nullif(l_returnflag, 'A') IS NOT NULL GROUP BY ALL""",
    "masked_columns": _with("base", "tree") + f""", long AS (SELECT site, plot, species, sum(area) / 0.1::DOUBLE AS ba
          FROM tree GROUP BY ALL),
        w AS (SELECT site, plot, round(sum(ba), 6) AS total_ba, {SPECIES_COLS} FROM long GROUP BY site, plot)
        SELECT {V}, oak_count, {MASKED} FROM base LEFT JOIN w USING (site, plot)""",
    "coalesce_join": _with("base", "reading", "spot") + """SELECT base.subplot, year, oak_count,
        round(COALESCE(canopy_openness, "pH"), 6) AS canopy_openness FROM base LEFT JOIN reading USING (subplot)
        LEFT JOIN (SELECT subplot, "pH" FROM spot WHERE transect = 'BUILDING') s ON s.subplot = base.subplot""",
    "decode_lookup": """SELECT p_name, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40)
        ON l_partkey = p_partkey GROUP BY 1""",
    "recode_merge": _with("seedling") + """SELECT CASE site WHEN 'MIDDLE EAST' THEN 'ORIENT' WHEN 'AMERICA' THEN 'NEW WORLD'
          ELSE site END AS site, CASE WHEN species IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'SIZED'
          WHEN species = 'ECONOMY' THEN 'CHEAP' ELSE species END AS species, count(*) AS n FROM seedling GROUP BY 1, 2""",
    "zone_fanout_join": _with("fan") + f"""SELECT {V}, oak_count, area_type, round(total_ba, 6) AS total_ba,
        area_type IS DISTINCT FROM 'extended' AS kept FROM fan""",
    "core_rows": _with("fan") + f"""SELECT {V}, oak_count, area_type, round(total_ba, 6) AS total_ba
        FROM fan WHERE area_type <> 'extended' OR area_type IS NULL""",
    "zone_assignment": _with("zoned") + """SELECT site, plot, area_type, section, count(*) AS stems FROM zoned GROUP BY ALL""",
    "zone_assignment_by_table": _with("tree") + """, rules AS (SELECT site AS code, species AS area_type, min(section) AS lo,
          floor(sum(section) / count(*)) AS hi FROM tree GROUP BY 1, 2)
        SELECT site, plot, section, count(*) AS stems, area_type FROM tree JOIN rules
        ON site = code AND section BETWEEN lo AND hi GROUP BY site, plot, section, area_type""",
    "species_basal_area": _with("tree") + """SELECT site, plot, species, round(ba, 6) AS basal_area,
        round(sum(ba) OVER (PARTITION BY site, plot), 6) AS total_ba
        FROM (SELECT site, plot, species, sum(area) AS ba FROM tree GROUP BY ALL)""",
    "strict_species_sum": """SELECT l_partkey, CASE WHEN count(*) = count(d) THEN round(sum(d), 6) END AS total,
        CASE WHEN count(*) = count(d) THEN round(avg(d), 6) END AS mean
        FROM (SELECT l_partkey, nullif(l_quantity, 50) AS d FROM lineitem) GROUP BY l_partkey""",
    "basal_area_wide": _with("tree") + f""", long AS (SELECT site, plot, species, sum(area) / 0.1::DOUBLE AS ba
          FROM tree GROUP BY ALL)
        SELECT site, plot, round(sum(ba), 6) AS total_ba, {SPECIES_COLS} FROM long GROUP BY site, plot""",
    "net_standing": _with("zoned") + """, s AS (SELECT site, plot, area_type, species, sum(area) AS a,
          COALESCE(sum(area) FILTER (WHERE removed), 0) AS r FROM zoned GROUP BY ALL)
        SELECT site, plot, area_type, species, round(a - r, 6) AS basal_area FROM s WHERE a - r > 0""",
    "zone_weighted_mean": _with("fan") + f""", g AS (SELECT *, {_zone_area()} AS a FROM fan),
        z AS (SELECT subplot, year, bool_or(area_type = 'extended') AS ext, bool_or(area_type = 'core') AS core,
          max(a) FILTER (WHERE area_type = 'core') AS ac, max(a) FILTER (WHERE area_type = 'extended') AS ae,
          max(total_ba) FILTER (WHERE area_type = 'core') AS tc, max(total_ba) FILTER (WHERE area_type = 'extended') AS te,
          max(standard_ba) FILTER (WHERE area_type = 'core') AS sc,
          max(standard_ba) FILTER (WHERE area_type = 'extended') AS se,
          max(total_ba) AS t, max(standard_ba) AS s FROM g GROUP BY subplot, year)
        SELECT {V}, oak_count, area_type,
          round(CASE WHEN ext THEN (tc * ac + te * ae) / (ac + ae) WHEN core THEN tc ELSE t END, 6) AS total_ba,
          round(CASE WHEN ext THEN (sc * ac + se * ae) / (ac + ae) WHEN core THEN sc ELSE s END, 6) AS standard_ba
        FROM g JOIN z USING (subplot, year) WHERE area_type IS DISTINCT FROM 'extended'""",
    "distinct_area_sum": _with("visit") + """, p AS (SELECT o_orderkey, subplot, year,
          CAST(CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 2 END AS DOUBLE) AS a FROM visit)
        SELECT o_orderkey, subplot, year, total AS area_m2 FROM p JOIN (SELECT subplot, year, sum(DISTINCT a) AS total
          FROM p GROUP BY subplot, year) USING (subplot, year)""",
    "centered_year": _with("base") + """SELECT subplot, year, oak_count,
        round(year - (SELECT avg(year) FROM base), 6) AS year_c FROM base""",
    "tolerant_threshold": """SELECT d AS diameter, l_returnflag, count(*) AS n FROM (SELECT l_returnflag,
          CASE WHEN l_linenumber = 1 THEN NULL WHEN l_quantity > 40 THEN '0.1-5' WHEN l_tax = 0 THEN 'abc'
          ELSE CAST(l_quantity AS VARCHAR) END AS d FROM lineitem)
        WHERE d IS NULL OR try_cast(d AS DOUBLE) <= 5 OR d = '0.1-5' GROUP BY ALL""",
    "exclusion_list": _with("visit") + """SELECT site, plot, transect, year, count(*) AS n FROM visit
        WHERE year NOT IN (1995, 1996) AND transect <> 'FURNITURE'
        AND NOT (site = 'ASIA' AND transect = 'BUILDING' AND plot = 'NATION_2')
        AND NOT (site = 'AFRICA' AND transect = 'MACHINERY' AND plot IN ('NATION_0', 'NATION_5', 'NATION_10'))
        GROUP BY ALL""",
    "exclude_by_table": _with("visit") + """SELECT visit.* FROM visit WHERE NOT EXISTS (
        SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
    "visit_year": """SELECT o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
        count(*) AS n FROM orders GROUP BY ALL""",
    "blank_text": """SELECT flag, COALESCE(flag, 'none') AS shown, count(*) AS n FROM (
        SELECT CASE WHEN l_linestatus <> 'F' THEN l_returnflag END AS flag FROM lineitem) GROUP BY ALL""",
    "complete_cases": _with("cc") + """SELECT * EXCLUDE (canopy_openness, "pH", total_ba, standard_ba),
        """ + _r("canopy_openness", "total_ba", "standard_ba") + """, round("pH", 6) AS "pH" FROM cc""",
    "nan_to_null": """SELECT l_partkey, count(q) AS n, round(avg(q), 6) AS mean_ratio FROM (
        SELECT l_partkey, l_discount / nullif(l_tax, 0) AS q FROM lineitem) GROUP BY l_partkey""",
    "integrate_campaigns": _with("filled", "wide96", "reading", "spot") + f"""SELECT {', '.join('f.' + c for c in V.split(', '))},
          species, shoot, density, area_type, round(total_ba, 6) AS total_ba,
          round(CASE WHEN f.year > 1997 THEN canopy_openness END, 6) AS canopy_openness,
          round(CASE WHEN f.year > 1997 THEN "pH" END, 6) AS "pH"
        FROM filled f LEFT JOIN wide96 w ON w.site = f.site AND w.plot = f.plot AND w.year = f.year
        LEFT JOIN reading r ON r.subplot = f.subplot LEFT JOIN spot ON spot.subplot = f.subplot""",
    "period_collapse": _with("cov") + f"""SELECT {K}, period, CAST(floor(avg(oak_count) + 0.5) AS BIGINT) AS oak_count,
        {_r('canopy_openness', 'total_ba').replace('round(', 'round(avg(').replace(', 6)', '), 6)')},
        round(avg("pH"), 6) AS "pH" FROM cov GROUP BY {K}, period""",
    "rate_per_visit": _with("base") + """SELECT subplot, year, round(oak_count / area_m2, 6) AS rate,
        round(ln(area_m2), 6) AS log_area, round(oak_count / (area_m2 / 10000), 6) AS per_ha,
        CAST(floor(oak_count / area_m2 + 0.5) AS BIGINT) AS whole_rate FROM base""",
    "scan_decimal_comma": _with("cov") + """SELECT site, subplot, year, oak_count, round(round(canopy_openness, 6), 5)
        AS canopy_openness, round("pH", 5) AS "pH" FROM cov""",
    "scan_decimal_point": """SELECT CASE WHEN l_linestatus = 'F' THEN '' ELSE l_returnflag END AS note,
        l_returnflag = 'R' AS shoot, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2""",
    "tidy_parquet": _with("base") + "SELECT * EXCLUDE (period) FROM base",
    "tidy_sorted": _with("base") + """SELECT * EXCLUDE (period) FROM base
        WHERE site = 'EUROPE' AND plot >= 'NATION_13' AND year >= 1996""",
    "tidy_csv": _with("base", "reading") + """SELECT subplot, oak_count, round(canopy_openness, 6) AS canopy_openness, year
        FROM base LEFT JOIN reading USING (subplot)""",
    "box_stats": _with("base") + _box("year, treatment", "base", "oak_count"),
    "box_stats_price": _box("l_returnflag", "lineitem", "l_extendedprice"),
    "box_outliers": _with("base") + """SELECT treatment, y AS value, count(*) AS n FROM (
          SELECT treatment, CAST(oak_count AS DOUBLE) AS y FROM base) JOIN (
          SELECT treatment, quantile_cont(CAST(oak_count AS DOUBLE), 0.25) AS q1,
          quantile_cont(CAST(oak_count AS DOUBLE), 0.75) AS q3 FROM base GROUP BY 1) USING (treatment)
        WHERE NOT y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1, 2""",
    "linear_trend": _with("cov") + f"""SELECT CASE WHEN grouping(yr) = 1 THEN 'all' ELSE yr END AS year,
          CASE WHEN grouping(treatment) = 1 THEN 'all' ELSE treatment END AS treatment, {REGR}{SXX}
        FROM (SELECT CAST(year AS VARCHAR) AS yr, treatment, canopy_openness AS x, CAST(oak_count AS DOUBLE) AS y FROM cov
          WHERE canopy_openness IS NOT NULL) GROUP BY GROUPING SETS ((), (yr), (treatment), (yr, treatment))""",
    "trend_band": _with("cov") + """, g AS (SELECT CASE WHEN grouping(treatment) = 1 THEN 'all' ELSE treatment END AS treatment,
          count(*) AS n, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, avg(x) AS mx, regr_sxx(y, x) AS sxx,
          min(x) AS lo, max(x) AS hi, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)) AS s
          FROM (SELECT treatment, "pH" AS x, CAST(oak_count AS DOUBLE) AS y FROM cov)
          GROUP BY GROUPING SETS ((), (treatment)))
        SELECT treatment, CAST(step AS INTEGER) AS step, round(x, 6) AS x, round(b0 + b1 * x, 6) AS fit,
          round(s * sqrt(1.0::DOUBLE / n + (x - mx) * (x - mx) / sxx), 6) AS se,
          round(b0 + b1 * x - """ + _t_quantile(1.959963984540054, "(n - 2)") + """ * s * sqrt(1.0::DOUBLE / n + (x - mx) * (x - mx) / sxx), 6) AS lower,
          round(b0 + b1 * x + """ + _t_quantile(1.959963984540054, "(n - 2)") + """ * s * sqrt(1.0::DOUBLE / n + (x - mx) * (x - mx) / sxx), 6) AS upper
        FROM (SELECT *, lo + step * (hi - lo) / 19 AS x FROM g, generate_series(0, 19) AS t(step))""",
    "others_trend": _with("cov") + f""", every AS (SELECT {V}, CAST(sum(density) AS DOUBLE) AS y FROM filled GROUP BY {V})
        SELECT {REGR} FROM (SELECT total_ba - standard_ba AS x, y FROM cov JOIN every USING ({V}) WHERE total_ba IS NOT NULL)""",
    "point_layer": _with("base") + """SELECT treatment, period AS x, round(oak_count / area_m2, 6) AS y, count(*) AS n
        FROM base GROUP BY treatment, period, oak_count / area_m2""",
    "cor_test": _with("cov") + _tested("""SELECT period, count(*) AS n, corr(canopy_openness, "pH") AS r FROM cov
        WHERE canopy_openness IS NOT NULL GROUP BY period""", "period", with_p=True),
    "cor_matrix": _with("cc") + _pairs(["total_ba", "canopy_openness", "pH"], "cc", "", "", "", True),
    "pairs_table": _with("cov") + _pairs(
        ["oak_count", "canopy_openness", "pH", "total_ba", "standard_ba"], "cov", "treatment, ",
        "CASE WHEN grouping(treatment) = 1 THEN 'all' ELSE treatment END AS treatment, ", "GROUP BY ROLLUP (treatment)"),
    "pairs_histogram": _with("cov") + """, long AS (UNPIVOT (SELECT treatment, CAST(oak_count AS DOUBLE) AS oak_count,
          canopy_openness, "pH" FROM cov) ON oak_count, canopy_openness, "pH" INTO NAME variable VALUE value),
        e AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM long GROUP BY variable)
        SELECT treatment, variable, CAST(least(floor((value - lo) / (hi - lo) * 8), 7) + 1 AS INTEGER) AS bin, count(*) AS n
        FROM long JOIN e USING (variable) GROUP BY 1, 2, 3""",
    "adjusted_rates": _with("rates") + f"""SELECT treatment, period, n, round(total, 6) AS total, round(exposure, 6) AS exposure,
        round(total / exposure, 6) AS rate, round(1 / sqrt(total), 6) AS se_log,
        round(total / exposure * exp(-{Z} / sqrt(total)), 6) AS lower,
        round(total / exposure * exp({Z} / sqrt(total)), 6) AS upper FROM rates""",
    "rate_ratios": _with("rates") + f""", pair AS (SELECT a.period, a.treatment AS level_a, b.treatment AS level_b,
          CASE WHEN b.total > 0 THEN (a.total / a.exposure) / (b.total / b.exposure) END AS ratio,
          CASE WHEN a.total > 0 AND b.total > 0 THEN sqrt(1 / a.total + 1 / b.total) END AS se
          FROM rates a JOIN rates b ON a.period = b.period AND a.treatment < b.treatment),
        tested AS (SELECT *, CASE WHEN se IS NOT NULL THEN ln(ratio) / se END AS raw FROM pair)
        SELECT period, level_a, level_b, round(ratio, 6) AS ratio, round(se, 6) AS se_log, round(raw, 6) AS z,
          round({_normal_p("raw")}, 6) AS p_value FROM tested""",
    "poisson_glm": _one_factor(True),
    "poisson_glm_no_offset": _one_factor(False),
    "poisson_glm_saturated": _with("rates") + """, c AS (SELECT treatment, period, ln(total / exposure) AS l, 1 / total AS v FROM rates),
        k AS (SELECT max(l) FILTER (WHERE treatment = 'control' AND period = 'early') AS ce,
          max(l) FILTER (WHERE treatment = 'control' AND period = 'late') AS cl,
          max(l) FILTER (WHERE treatment = 'thinned' AND period = 'early') AS te,
          max(l) FILTER (WHERE treatment = 'thinned' AND period = 'late') AS tl,
          max(v) FILTER (WHERE treatment = 'control' AND period = 'early') AS vce,
          max(v) FILTER (WHERE treatment = 'control' AND period = 'late') AS vcl,
          max(v) FILTER (WHERE treatment = 'thinned' AND period = 'early') AS vte,
          max(v) FILTER (WHERE treatment = 'thinned' AND period = 'late') AS vtl FROM c)
        SELECT term, round(e, 5) AS estimate, round(s, 5) AS std_error, round(e / s, 5) AS statistic, round(""" + _normal_p("e / s") + """, 5) AS p_value FROM (
          SELECT '(Intercept)' AS term, ce AS e, sqrt(vce) AS s FROM k
          UNION ALL SELECT 'treatmentthinned', te - ce, sqrt(vte + vce) FROM k
          UNION ALL SELECT 'periodlate', cl - ce, sqrt(vcl + vce) FROM k
          UNION ALL SELECT 'treatmentthinned:periodlate', tl - te - cl + ce, sqrt(vtl + vte + vcl + vce) FROM k)""",
    "poisson_glm_year_factor": _with("base") + """, c AS (SELECT year, ln(sum(oak_count) / sum(area_m2)) AS l,
          1.0 / sum(oak_count) AS v FROM base GROUP BY year), z AS (SELECT * FROM c WHERE year = (SELECT min(year) FROM c))
        SELECT term, round(e, 5) AS estimate, round(s, 5) AS std_error, round(e / s, 5) AS statistic, round(""" + _normal_p("e / s") + """, 5) AS p_value FROM (
          SELECT CASE WHEN c.year = z.year THEN '(Intercept)' ELSE 'year' || c.year END AS term,
            CASE WHEN c.year = z.year THEN c.l ELSE c.l - z.l END AS e, sqrt(CASE WHEN c.year = z.year THEN c.v ELSE c.v + z.v END) AS s FROM c, z)""",
    "model_aic": _with("base") + _poisson_aic("offset", "sum(area_m2)", "rate * area_m2") + " UNION ALL "
        + _poisson_aic("no_offset", "count(*)", "rate"),
    "overdispersion": _with("fitted") + """, one AS (SELECT count(*) AS n, sum((oak_count - mu) * (oak_count - mu) / mu) AS x,
          count(*) - 2 AS df FROM fitted)
        SELECT n, round(x, 5) AS chi2, df AS df_resid, round(x / df, 5) AS ratio, round(""" + _chi2_p("x", "df") + """, 5) AS p_value FROM one""",
    "zero_inflation": _with("fitted") + """SELECT count(*) FILTER (WHERE oak_count = 0) AS observed,
        round(sum(exp(-mu)), 5) AS expected, round(sum(exp(-mu)) / count(*) FILTER (WHERE oak_count = 0), 5) AS ratio
        FROM fitted""",
    "residual_table": _with("base") + """, f AS (SELECT oak_count, round(sum(oak_count) OVER w / sum(area_m2) OVER w * area_m2, 12)
          AS mu FROM base WINDOW w AS (PARTITION BY treatment, period)),
        q AS (SELECT quantile_cont(mu, 0.25) AS a, quantile_cont(mu, 0.5) AS b, quantile_cont(mu, 0.75) AS c FROM f)
        SELECT CAST(1 + (mu > a)::INT + (mu > b)::INT + (mu > c)::INT AS INTEGER) AS bin, count(*) AS n,
          round(avg(mu), 5) AS mean_fitted, round(avg(oak_count - mu), 5) AS mean_resid,
          round(sqrt(avg((oak_count - mu) * (oak_count - mu) / mu)), 5) AS rms_pearson FROM f, q GROUP BY 1""",
    "count_frequencies": _with("fitted") + """, low AS (SELECT CAST(k AS INTEGER) AS count, COALESCE(o, 0) AS observed, e
          FROM (SELECT k, sum(exp(k * ln(mu) - mu - lgamma(k + 1))) AS e FROM fitted, generate_series(0, 12) AS t(k) GROUP BY k)
          LEFT JOIN (SELECT oak_count, count(*) AS o FROM base GROUP BY 1) ON oak_count = k)
        SELECT count, FALSE AS above, observed, round(e, 5) AS expected FROM low
        UNION ALL SELECT 13, TRUE, (SELECT count(*) FROM base WHERE oak_count > 12),
          round((SELECT count(*) FROM base) - sum(e), 5) FROM low""",
    "count_frequencies_all": _with("base") + """, f AS (SELECT round(ln(sum(oak_count) OVER w / sum(area_m2) OVER w * area_m2), 12) AS eta
          FROM base WINDOW w AS (PARTITION BY treatment, period)), g AS (SELECT eta, count(*) AS n FROM f GROUP BY eta),
        top AS (SELECT CAST(max(oak_count) AS INTEGER) AS m FROM base),
        low AS (SELECT CAST(k AS INTEGER) AS count, COALESCE(o, 0) AS observed, e FROM (SELECT k, sum(n * exp(k * eta - exp(eta) - lgamma(k + 1))) AS e
            FROM g, (SELECT unnest(generate_series(0, m)) AS k FROM top) GROUP BY k)
          LEFT JOIN (SELECT oak_count, count(*) AS o FROM base GROUP BY 1) ON oak_count = k)
        SELECT count, FALSE AS above, observed, round(e, 5) AS expected FROM low
        UNION ALL SELECT (SELECT m + 1 FROM top), TRUE, 0, round((SELECT count(*) FROM base) - sum(e), 5) FROM low""",
    "model_compare": _with("rates").replace("WITH ", "WITH RECURSIVE ", 1) + """, c AS (
          SELECT max(exposure) FILTER (WHERE treatment = 'control' AND period = 'early') AS ece, max(exposure) FILTER (WHERE treatment = 'control' AND period = 'late') AS ecl,
            max(exposure) FILTER (WHERE treatment = 'thinned' AND period = 'early') AS ete, max(exposure) FILTER (WHERE treatment = 'thinned' AND period = 'late') AS etl,
            sum(total) FILTER (WHERE treatment = 'control') AS nc, sum(total) FILTER (WHERE treatment = 'thinned') AS nt,
            sum(total) FILTER (WHERE period = 'early') AS ne, sum(total) FILTER (WHERE period = 'late') AS nl FROM rates),
        fit AS (SELECT 0 AS i, 1.0::DOUBLE AS c, 1.0::DOUBLE AS t, 1.0::DOUBLE AS e, 1.0::DOUBLE AS l
          UNION ALL SELECT i + 1, c1, t1, ne / (c1 * ece + t1 * ete), nl / (c1 * ecl + t1 * etl) FROM (
            SELECT i, nc / (e * ece + l * ecl) AS c1, nt / (e * ete + l * etl) AS t1, k.* FROM fit, c AS k WHERE i < 300)),
        cell AS (SELECT treatment, period, sum(total) OVER t / sum(exposure) OVER t AS "treatment_", sum(total) OVER p / sum(exposure) OVER p AS "period_", total / exposure AS crossed_,
            CASE treatment WHEN 'control' THEN f.c ELSE f.t END * CASE period WHEN 'early' THEN f.e ELSE f.l END AS both_
          FROM rates, (SELECT * FROM fit WHERE i = 300) AS f WINDOW t AS (PARTITION BY treatment), p AS (PARTITION BY period)),
        long AS (SELECT treatment, period, unnest(['treatment', 'period', 'both', 'crossed']) AS model, unnest([2, 2, 3, 4]) AS k,
            unnest([treatment_, period_, both_, crossed_]) AS rate FROM cell),
        s AS (SELECT model, any_value(k) AS k, count(*) AS n, sum(oak_count * ln(rate * area_m2) - rate * area_m2 - """ + LGAMMA_FACTORIAL + """) AS ll,
            var_pop(ln(rate)) AS v, ln(1 + 1 / avg(oak_count)) AS o, sqrt(avg(pow(oak_count - rate * area_m2, 2))) AS rmse
          FROM base JOIN long USING (treatment, period) GROUP BY model),
        r AS (SELECT *, 2 * k - 2 * ll AS aic, 2 * k - 2 * ll + 2.0 * k * (k + 1) / (n - k - 1) AS aicc, k * ln(n) - 2 * ll AS bic, v / (v + o) AS r2 FROM s),
        w AS (SELECT *, exp((min(aic) OVER () - aic) / 2) AS a1, exp((min(aicc) OVER () - aicc) / 2) AS a2, exp((min(bic) OVER () - bic) / 2) AS a3 FROM r),
        x AS (SELECT *, a1 / sum(a1) OVER () AS w1, a2 / sum(a2) OVER () AS w2, a3 / sum(a3) OVER () AS w3 FROM w)
        SELECT model, CAST(k AS INTEGER) AS k, round(aic, 4) AS aic, round(aicc, 4) AS aicc, round(bic, 4) AS bic, round(w1, 4) AS aic_wt, round(w2, 4) AS aicc_wt, round(w3, 4) AS bic_wt,
          round(r2, 4) AS r2_marginal, round(r2, 4) AS r2_conditional, round(rmse, 4) AS rmse,
          round((""" + " + ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())" for c in ("w1", "w2", "w3", "(-rmse)", "r2", "r2")) + """) / 6, 4) AS score FROM x""",
    "r2_methods": _with("rates") + """, v AS (SELECT sum(n * l * l) / sum(n) - pow(sum(n * l) / sum(n), 2) AS f, sum(total) / sum(exposure) AS x
          FROM (SELECT *, ln(total / exposure) AS l FROM rates)),
        d AS (SELECT 'delta' AS method, f, 1 / x AS o FROM v UNION ALL SELECT 'lognormal', f, ln(1 + 1 / x) FROM v
          UNION ALL SELECT 'trigamma', f, (SELECT sum(1 / pow(x + i, 2)) FROM generate_series(0, 19) AS t(i))
            + 1 / (x + 20) + 0.5 / pow(x + 20, 2) + 1 / pow(x + 20, 3) / 6 - 1 / pow(x + 20, 5) / 30 + 1 / pow(x + 20, 7) / 42 FROM v)
        SELECT method, round(f / (f + o), 6) AS r2_marginal, round(f / (f + o), 6) AS r2_conditional FROM d""",
    "vif": _with("cov") + """SELECT unnest(['canopy_openness', 'pH']) AS term,
        round(1 / (1 - pow(corr(canopy_openness, "pH"), 2)), 6) AS vif FROM cov WHERE canopy_openness IS NOT NULL""",
    "path_coefs": _with("cov") + """, p AS (SELECT 'canopy_openness' AS response, 'total_ba' AS predictor, canopy_openness AS y,
          total_ba AS x FROM cov UNION ALL SELECT 'total_ba', 'pH', total_ba, "pH" FROM cov)
        SELECT response, predictor, round(e, 5) AS estimate, round(s, 5) AS std_error, round(""" + _normal_p("e / s") + """, 5) AS p_value, round(d, 5) AS std_estimate, round(r2, 5) AS r2 FROM (
          SELECT response, predictor, regr_slope(y, x) AS e, regr_r2(y, x) AS r2,
            sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*) / regr_sxx(y, x)) AS s,
            regr_slope(y, x) * stddev_samp(x) / stddev_samp(y) AS d FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2)""",
    "path_summary_linear": _with("cc") + """, claim AS (SELECT 1 AS c, canopy_openness AS y, "pH" AS a, total_ba AS g FROM cc
          UNION ALL SELECT 2, standard_ba, "pH", total_ba FROM cc UNION ALL SELECT 3, standard_ba, canopy_openness, total_ba FROM cc),
        s AS (SELECT c, count(*) AS n, covar_pop(a, a) AS aa, covar_pop(g, g) AS gg, covar_pop(a, g) AS ag, covar_pop(y, a) AS ya,
          covar_pop(y, g) AS yg, covar_pop(y, y) AS yy FROM claim GROUP BY c),
        f AS (SELECT *, (ya * gg - yg * ag) / (aa * gg - ag * ag) AS ba, (yg * aa - ya * ag) / (aa * gg - ag * ag) AS bg FROM s),
        w AS (SELECT ba / sqrt((yy - ba * ya - bg * yg) / n * gg / (aa * gg - ag * ag)) AS z FROM f),
        t AS (SELECT -2 * sum(ln(""" + _normal_p("z") + """)) AS x, 6 AS df FROM w)
        SELECT CAST(3 AS INTEGER) AS claims, round(x, 4) AS fisher_c, CAST(df AS INTEGER) AS df, round(""" + _chi2_p("x", "df") + """, 4) AS p_value,
          CAST(9 AS INTEGER) AS k, round(x + 18, 4) AS aic FROM t""",
    "indirect_effects": _with("cov") + """SELECT 'pH' AS source, 'total_ba' AS through, 'canopy_openness' AS target,
        round(regr_slope(canopy_openness, total_ba) * regr_slope(total_ba, "pH"), 5) AS indirect FROM cov""",
}


def _zoom(levels: int) -> str:
    """Profile likelihood over a grid of log variance ratios, then over finer grids about the best of each."""
    def grid(k: int) -> str:
        ends = "-14.0 AS low, 6.0 AS high" if k == 0 else f"r - {20.0 / 200 * (2 / 200) ** (k - 1)} AS low, r + {20.0 / 200 * (2 / 200) ** (k - 1)} AS high FROM best{k - 1}"
        return f"""at{k} AS (SELECT low + (high - low) * i / 200 AS r FROM (SELECT {ends}), generate_series(0, 200) AS t(i)),
        sums{k} AS (SELECT r, any_value(t.n) AS n, sum(ln(1 + leaf.n * exp(r))) AS logdet,
            any_value(t.n) - sum(leaf.n * leaf.n * w) AS a, any_value(t.x) - sum(leaf.n * leaf.x * w) AS b, any_value(t.xx) - sum(leaf.x * leaf.x * w) AS c,
            any_value(t.y) - sum(leaf.n * leaf.y * w) AS d, any_value(t.xy) - sum(leaf.x * leaf.y * w) AS e, any_value(t.yy) - sum(leaf.y * leaf.y * w) AS f
          FROM (SELECT r, leaf.*, exp(r) / (1 + leaf.n * exp(r)) AS w FROM at{k}, leaf) AS leaf, tot AS t GROUP BY r),
        fits{k} AS (SELECT *, (d * c - b * e) / (a * c - b * b) AS b0, (a * e - b * d) / (a * c - b * b) AS b1 FROM sums{k}),
        lik{k} AS (SELECT *, (f - b0 * d - b1 * e) / n AS s2 FROM fits{k}),
        best{k} AS (SELECT * FROM (SELECT *, -0.5 * n * (ln(2 * pi() * s2) + 1) - 0.5 * logdet AS ll FROM lik{k}) ORDER BY ll DESC LIMIT 1)"""

    return ",\n        ".join(grid(k) for k in range(levels))


ORACLE["modelling_bases"] = _with("filled", "reading", "spot", "zwide") + f""", tidy AS (SELECT {', '.join('filled.' + c for c in V.split(', '))}, species, shoot,
          density, canopy_openness, "pH", area_type, total_ba, standard_ba FROM filled LEFT JOIN reading ON reading.subplot = filled.subplot
          LEFT JOIN spot ON spot.subplot = filled.subplot LEFT JOIN zwide ON zwide.site = filled.site AND zwide.plot = filled.plot),
        z AS (SELECT subplot, year, bool_or(area_type = 'extended') AS ext, bool_or(area_type = 'core') AS core,
          max({_zone_area()}) FILTER (WHERE area_type = 'core') AS ac, max({_zone_area()}) FILTER (WHERE area_type = 'extended') AS ae,
          max(total_ba) FILTER (WHERE area_type = 'core') AS tc, max(total_ba) FILTER (WHERE area_type = 'extended') AS te,
          max(standard_ba) FILTER (WHERE area_type = 'core') AS sc, max(standard_ba) FILTER (WHERE area_type = 'extended') AS se,
          max(total_ba) AS t, max(standard_ba) AS s FROM tidy GROUP BY subplot, year),
        kept AS (SELECT * FROM tidy WHERE species = 'STANDARD' AND area_type IS DISTINCT FROM 'extended'),
        core AS (SELECT {V}, sum(density) AS every, COALESCE(sum(density) FILTER (WHERE NOT shoot), 0) AS others, max(canopy_openness) AS canopy_openness,
          max("pH") AS "pH", max(total_ba) AS total_ba, max(standard_ba) AS quercus_sp_ba FROM kept GROUP BY {V}),
        wide AS (SELECT core.* EXCLUDE (total_ba, quercus_sp_ba), CASE WHEN ext THEN (tc * ac + te * ae) / (ac + ae) WHEN z.core THEN tc ELSE t END AS total_ba,
          CASE WHEN ext THEN (sc * ac + se * ae) / (ac + ae) WHEN z.core THEN sc ELSE s END AS quercus_sp_ba FROM core JOIN z USING (subplot, year)),
        visits AS (SELECT 'oaks_all' AS base, every AS oak_count, * FROM core UNION ALL SELECT 'oaks_noshoots', others, * FROM core
          UNION ALL SELECT 'oaks_all_ext', every, * EXCLUDE (total_ba, quercus_sp_ba), total_ba, quercus_sp_ba FROM wide
          UNION ALL SELECT 'oaks_noshoots_ext', others, * EXCLUDE (total_ba, quercus_sp_ba), total_ba, quercus_sp_ba FROM wide),
        spans AS (SELECT {K}, CASE WHEN year IN (1995, 1996, 1997) THEN 'early' ELSE 'late' END AS period, floor(avg(others) + 0.5) AS oak_count,
          avg(canopy_openness) AS canopy_openness, avg("pH") AS "pH", avg(total_ba) AS total_ba, avg(quercus_sp_ba) AS quercus_sp_ba
          FROM core GROUP BY ALL),
        found AS (SELECT base, {V}, oak_count, canopy_openness, "pH", total_ba, quercus_sp_ba,
            CASE WHEN year IN (1995, 1996, 1997) THEN 'early' ELSE 'late' END AS period, year - avg(year) OVER (PARTITION BY base) AS year_c FROM visits
          UNION ALL SELECT 'oaks_2025', {V}, others, canopy_openness, "pH", total_ba, quercus_sp_ba, NULL, NULL FROM core
            WHERE total_ba IS NOT NULL AND canopy_openness IS NOT NULL AND "pH" IS NOT NULL
          UNION ALL SELECT b.base, {V.replace('year', 'NULL')}, oak_count, canopy_openness, "pH", total_ba, quercus_sp_ba, period, NULL FROM spans,
            (VALUES ('oaks_period'), ('oaks_0305'), ('oaks_sem')) AS b(base) WHERE base = 'oaks_period' OR (base = 'oaks_0305' AND period = 'early')
              OR (base = 'oaks_sem' AND total_ba IS NOT NULL AND canopy_openness IS NOT NULL))
        SELECT base, {V}, CAST(oak_count AS BIGINT) AS oak_count, {_r('canopy_openness', 'pH', 'total_ba', 'quercus_sp_ba', 'year_c')}, period FROM found"""

ORACLE["glmm_gaussian_site"] = _with("cov") + f""", good AS (SELECT plot, canopy_openness - 50 AS y, "pH" AS x FROM cov WHERE canopy_openness IS NOT NULL AND "pH" IS NOT NULL),
        leaf AS (SELECT plot, CAST(count(*) AS DOUBLE) AS n, sum(x) AS x, sum(y) AS y FROM good GROUP BY plot),
        tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM good),
        {_zoom(5)}
        SELECT CAST(n AS BIGINT) AS n, CAST(4 AS INTEGER) AS k, round(ll, 4) AS loglik, round(sqrt(s2), 4) AS sigma, TRUE AS converged,
          round(sqrt(s2 * exp(r)), 4) AS sd_plot, round(b0 + 50, 4) AS intercept, round(b1, 4) AS slope, round(8 - 2 * ll, 4) AS aic FROM best4"""


def _case(col: str, values: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in values.items()) + " END"


def _study_zones(rules: list[tuple], source: str) -> str:
    def test(rule) -> str:
        _, code, plot, ranges = rule
        parts = [f"code = '{code}'"] + ([f"plot = '{plot}'"] if plot else [])
        if ranges:
            parts.append("(" + " OR ".join(f"section BETWEEN {lo} AND {hi}" for lo, hi in ranges) + ")")
        return "(" + " AND ".join(parts) + ")"

    return " UNION ALL ".join(
        f"SELECT *, '{z}' AS area_type FROM {source} WHERE " + " OR ".join(test(r) for r in rules if r[0] == z) for z in ("core", "extended")
    )


_KIND = {k: name for k, (_, name) in study.SPECIES.items()}
_MERGED = {k: next((m for m, old in v.MERGED_SPECIES.items() if name in old), name) for k, name in _KIND.items()}
_SITE = {r: s[0] for r, s in study.SITES.items()}
_HECTARES = "CASE " + " ".join(
    f"WHEN area_type = '{z}' AND code = '{c}'" + (f" AND plot = '{p}'" if p else "") + f" THEN {a}::DOUBLE" for z, c, p, a in v.ZONE_AREAS_HA
) + " END"
_HOME = f"""home AS (SELECT n_nationkey, {_case('r_name', _SITE)} AS site, {_case('r_name', {r: s[1] for r, s in study.SITES.items()})} AS code,
      CASE WHEN n_nationkey % 2 = 0 THEN {_case('r_name', {r: s[2] for r, s in study.SITES.items()})}
        ELSE {_case('r_name', {r: s[3] for r, s in study.SITES.items()})} END AS plot,
      CASE WHEN n_nationkey % 2 = 0 THEN 'control' ELSE 'thinned' END AS treatment FROM nation JOIN region ON n_regionkey = r_regionkey),
    place AS (SELECT c_custkey, site, plot, treatment, {_case('c_mktsegment', study.TRANSECTS)} AS transect,
      CASE WHEN c_custkey % 6 = 0 THEN '{v.SUBPLOT_LEFT_OUT}' ELSE CAST(c_custkey % 6 AS VARCHAR) END AS subplot
      FROM customer JOIN home ON c_nationkey = n_nationkey)"""
_SOIL = """sample AS (SELECT site, plot, treatment, transect, subplot, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 1e5 END AS ph, o_orderpriority AS w
      FROM orders JOIN place ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'),
    soil AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY site, plot, treatment, transect, subplot
      ORDER BY ph NULLS LAST, w) AS rn FROM sample) WHERE rn = 1)"""

ORACLE["study_soil"] = f"""WITH {_HOME}, {_SOIL}
    SELECT site, plot, treatment, transect, subplot, round(ph, 6) AS "pH", w AS "10g_measurement" FROM soil"""

ORACLE["study_net_basal_area"] = f"""WITH {_HOME},
    stem AS (SELECT site, code, plot, p_size * 25 AS section, {_case('p_type', _MERGED)} AS name, l_returnflag AS flag,
      pi() * pow(l_quantity / 200, 2) * (l_linenumber % 3 + 1) AS a
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN home ON s_nationkey = n_nationkey),
    gone AS (SELECT * FROM stem WHERE flag = 'A'),
    s AS (SELECT site, code, plot, area_type, name, sum(a) AS a FROM ({_study_zones(v.STANDING_ZONES, 'stem')}) GROUP BY ALL),
    r AS (SELECT code, plot, area_type, name, sum(a) AS a FROM ({_study_zones(v.REMOVED_ZONES, 'gone')}) GROUP BY ALL),
    n AS (SELECT s.*, (s.a - COALESCE(r.a, 0)) / {_HECTARES.replace('area_type', 's.area_type').replace('code', 's.code').replace('plot', 's.plot')} AS ba
      FROM s LEFT JOIN r ON s.code = r.code AND s.plot = r.plot AND s.area_type = r.area_type AND s.name = r.name WHERE s.a - COALESCE(r.a, 0) > 0)
    SELECT site, plot, area_type, round(CASE WHEN count(*) = count(ba) THEN sum(ba) END, 6) AS total_ba, """ + ", ".join(
    f"round(CASE WHEN count(*) FILTER (WHERE name = '{name}') = 0 THEN 0 ELSE max(ba) FILTER (WHERE name = '{name}') END, 6) AS {col}_ba"
    for name, col in zip(study.STANDING_SPECIES, ["betula_sp", "pinus_sylvestris", "quercus_sp", "rubus_idaeus", "salix_sp"])
) + " FROM n GROUP BY site, plot, area_type"

_TRANSECT_OK = " OR ".join(f"(c.site = '{s}' AND c.transect IN ({', '.join(repr(t) for t in ts)}))" for s, ts in v.MEASURED_TRANSECTS.items())
_AREAS = ["total_ba", *[x + "_ba" for x in ("betula_pendula", "betula_pubescens", "pinus_sylvestris", "quercus_sp", "rubus_idaeus", "salix_caprea")]]
ORACLE["study_current"] = f"""WITH {_HOME}, {_SOIL},
    plant AS (SELECT site, plot, treatment, transect, subplot, COALESCE({_case('p_type', _KIND)}, '0') AS species, COALESCE(l_returnflag = 'R', FALSE) AS shoot
      FROM orders JOIN place ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey) ON o_orderkey = l_orderkey
      WHERE year(o_orderdate) >= {study.FIRST_CURRENT}),
    c AS (SELECT site, plot, treatment, transect, subplot, species, shoot, count(*) AS density FROM plant WHERE species <> '0' GROUP BY ALL
      UNION ALL SELECT site, plot, treatment, transect, subplot, '{v.FOCAL_SPECIES}', FALSE, 0 FROM plant GROUP BY site, plot, treatment, transect, subplot
      HAVING bool_or(species = '0') OR NOT bool_or(species = '{v.FOCAL_SPECIES}')),
    reading AS (SELECT site, plot, treatment, transect, subplot, avg(value) AS o FROM events JOIN place ON user_id = c_custkey GROUP BY ALL),
    stem AS (SELECT site, plot, treatment, {_case('p_type', _KIND)} AS name, sum(pi() * pow(l_quantity / 200, 2)) / {v.TREE_PLOT_AREA_HA} AS ba
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN home ON s_nationkey = n_nationkey GROUP BY ALL),
    wide AS (SELECT site, plot, treatment, sum(ba) AS total_ba, """ + ", ".join(
    f"COALESCE(max(ba) FILTER (WHERE name = '{name}'), 0) AS {col}" for name, col in zip(study.CURRENT_SPECIES, _AREAS[1:])
) + f""" FROM stem GROUP BY site, plot, treatment)
    SELECT c.site, c.plot, c.treatment, CAST({v.CURRENT_YEAR} AS INTEGER) AS year, c.transect, c.subplot, {v.CURRENT_AREA_M2}::DOUBLE AS area_m2, species, shoot, density,
      round(o, 6) AS canopy_openness, round(ph, 6) AS "pH", """ + ", ".join(f"round(CASE WHEN {_TRANSECT_OK} THEN {a} END, 6) AS {a}" for a in _AREAS) + """
    FROM c LEFT JOIN reading USING (site, plot, treatment, transect, subplot) LEFT JOIN soil USING (site, plot, treatment, transect, subplot)
      LEFT JOIN wide USING (site, plot, treatment)"""
