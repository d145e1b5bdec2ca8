"""The driver queries as plain SQL for DuckDB, written independently of the operators."""

from __future__ import annotations

from cropline.plans.views import VIEWS, with_clause

KEY = "State, District, Crop"


def r(x: str, n: int = 6) -> str:
    """Scale, round half to even, unscale."""
    return f"round_even(({x}) * 1e{n}, 0) / 1e{n}"


def mean(x: str) -> str:
    return f"cast(sum(cast({x} AS decimal(28,8))) AS double) / nullif(count({x}), 0)"


def ratio_mean(x: str) -> str:
    """Mean of quotients, which have more than eight decimals."""
    return f"fsum({x}) / nullif(count({x}), 0)"


def _wide(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in columns)


MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
TOTALS = ["JF", "MAM", "JJAS", "OND", "ANNUAL"]
RAIN = [*MONTHS, "ANNUAL", "JF", "MAM", "JJAS", "OND"]
P3 = ["Min_Price", "Max_Price", "Modal_Price"]

_VOCAB = {
    "production": ("agri", {"state": "State", "crop": "Crop", "season": "Season"}),
    "price": (
        "price_facts",
        {c.lower(): c for c in ("State", "District", "Market", "Commodity", "Variety", "Grade")},
    ),
}


def _vocab() -> str:
    parts = [
        f"SELECT DISTINCT '{model}' AS model, '{f}' AS feature, {c} AS value FROM {table}"
        for model, (table, columns) in _VOCAB.items()
        for f, c in columns.items()
    ]
    rows = " UNION ALL ".join(parts)
    return (
        "SELECT model, feature, cast(row_number() OVER (PARTITION BY model, feature ORDER BY value) - 1 AS int)"
        f" AS ordinal, value FROM ({rows})"
    )


def _entry(model: str, feature: str, test: str, column: str = "value") -> str:
    """First entry that passes a test, else the first entry."""
    pick = "value, ordinal" if column == "value" else "ordinal, ordinal"
    source = f"FROM vocab v WHERE v.model = '{model}' AND v.feature = '{feature}'"
    return f"coalesce((SELECT arg_min({pick}) {source} AND {test}), (SELECT arg_min({pick}) {source}))"


def _same(field: str) -> str:
    return f"lower(trim(v.value)) = lower(trim({field}))"


MARKET = _entry("price", "market", "contains(lower(v.value), lower(q.district))")
VARIETY = _entry("price", "variety", "(contains(lower(v.value), lower(q.crop)) OR contains(lower(v.value), 'local'))")
GRADE = (
    "(SELECT CASE WHEN count(*) FILTER (WHERE value = 'FAQ') > 0 THEN 'FAQ' ELSE arg_min(value, ordinal) END"
    " FROM vocab WHERE model = 'price' AND feature = 'grade')"
)

_ASIA = """
SELECT 'ASIA' AS State, upper(trim(District_Name)) AS District, Crop_Year AS Year, trim(Season) AS Season,
       trim(Crop) AS Crop, Area, Production, l_orderkey, l_linenumber
FROM production WHERE upper(trim(State_Name)) = 'ASIA'
"""

_ASIA_PRICES = """
SELECT upper(trim(District)) AS District, Year, lower(trim(Commodity)) AS Commodity, Min_Price, Max_Price, Modal_Price
FROM prices WHERE upper(trim(State)) = 'ASIA'
"""


def _means(table: str) -> str:
    values = ", ".join(f"{mean(c)} AS {c}" for c in P3)
    grains = [
        ("1", "District, Year, Commodity", "District, Year"),
        ("2", "NULL, Year, Commodity", "Year"),
        ("3", "NULL, NULL, Commodity", ""),
    ]
    parts = []
    for level, shown, keys in grains:
        named = [f"{v.strip()} AS {n}" for v, n in zip(shown.split(","), ("District", "Year", "Commodity"))]
        group = f"{keys}, Commodity" if keys else "Commodity"
        parts.append(f"SELECT {level} AS level, {', '.join(named)}, {values} FROM {table} GROUP BY {group}")
    return " UNION ALL ".join(parts)


_LADDER = """
SELECT District, Year, Crop, level, Min_Price, Max_Price, Modal_Price FROM (
  SELECT *, row_number() OVER (PARTITION BY District, Year, Crop ORDER BY level, priority, Commodity) AS pick FROM (
    SELECT w.District, w.Year, w.Crop, m.level, w.priority, m.Commodity, m.Min_Price, m.Max_Price, m.Modal_Price
    FROM wanted w JOIN asia_means m ON contains(m.Commodity, w.alias)
      AND (m.level = 3 OR m.Year = w.Year) AND (m.level <> 1 OR m.District = w.District)
    UNION ALL
    SELECT DISTINCT District, Year, Crop, 4, 0, '', 1800.0::double, 2200.0::double, 2000.0::double FROM wanted))
WHERE pick = 1
"""

_WANTED = """
SELECT District, Year, Crop, unnest(names) AS alias, generate_subscripts(names, 1) - 1 AS priority FROM (
  SELECT DISTINCT District, Year, Crop,
    CASE lower(Crop) WHEN 'ring' THEN ['band', 'ring'] WHEN 'rod' THEN ['rod', 'ring']
         WHEN 'bolt' THEN ['iron bolt', 'bolt'] ELSE [lower(Crop)] END AS names FROM asia)
"""

_SEASON_RAIN = """
SELECT a.l_orderkey, a.l_linenumber, a.Year, a.Season, a.rain_column, coalesce(y.mm, m.mm) AS rain_mm FROM (
  SELECT *, CASE Season WHEN 'Kharif' THEN 'JJAS' WHEN 'Rabi' THEN 'OND' WHEN 'Whole Year' THEN 'ANNUAL'
    WHEN 'Autumn' THEN 'OND' WHEN 'Summer' THEN 'MAM' WHEN 'Winter' THEN 'JF' ELSE 'ANNUAL' END AS rain_column
  FROM asia) a
LEFT JOIN asia_rain y ON y.YEAR = a.Year AND y.rain_column = a.rain_column
LEFT JOIN (SELECT rain_column, cast(sum(cast(mm AS decimal(28,8))) AS double) / count(mm) AS mm
           FROM asia_rain GROUP BY rain_column) m ON m.rain_column = a.rain_column
"""

_ASIA_RAIN = " UNION ALL ".join(
    f"SELECT YEAR, '{c}' AS rain_column, {c} AS mm FROM rainfall WHERE upper(trim(SUBDIVISION)) = 'ASIA'"
    for c in TOTALS
)

_JOINED = (
    f"SELECT a.State, a.District, a.Crop, a.Year, a.Season, upper(trim(a.SUBDIVISION)) AS sub_clean, a.Production,"
    f" a.Rainfall, {', '.join(RAIN)} FROM agri a JOIN rainfall w"
    " ON upper(trim(a.SUBDIVISION)) = upper(trim(w.SUBDIVISION)) AND a.Year = w.YEAR"
)

_DISTRICT_MEANS = (
    f"SELECT upper(trim(State)) AS State, upper(trim(District)) AS District, Year, {mean('Min_Price')} AS Min_Price,"
    f" {mean('Max_Price')} AS Max_Price FROM prices GROUP BY ALL"
)

_PRICED = """
SELECT a.State, a.District, a.Crop, a.Year, a.Season, a.Min_Price AS Min_Price_x, a.Max_Price AS Max_Price_x,
       m.Min_Price AS Min_Price_y, m.Max_Price AS Max_Price_y
FROM agri a JOIN district_means m ON a.State = m.State AND a.District = m.District AND a.Year = m.Year
"""

_DEFAULTS = (
    f"SELECT {KEY}, {r('avg(Rainfall)', 4)} AS rainfall, {r('avg(Min_Price)', 4)} AS min_price,"
    f" {r('avg(Max_Price)', 4)} AS max_price FROM agri GROUP BY {KEY}"
)

_TRENDS = (
    f"SELECT {KEY}, Year AS year, {r(r(ratio_mean('y'), 9), 4)} AS yield, {r(mean('Modal_Price'), 2)} AS price"
    f" FROM (SELECT *, CASE WHEN Area > 0 THEN Production / Area ELSE 0.0 END AS y FROM agri) GROUP BY {KEY}, Year"
)

_CHECKED = f"""
SELECT req_id, upper(state) AS state, upper(district) AS district, crop, season, coalesce(commodity, crop) AS commodity,
       market, variety, grade, has_rainfall, rainfall, min_price, max_price, given_price,
       try_cast(area AS double) AS area,
       CASE WHEN try_cast(area AS double) IS NULL THEN 'Area must be a valid number'
            WHEN has_rainfall AND rainfall IS NULL THEN 'Rainfall must be a valid number' END AS reason
FROM full_requests
"""

_RESOLVED = """
SELECT * EXCLUDE (lo, hi, slo, shi),
       CASE WHEN lo > hi THEN hi ELSE lo END AS min_price_raw, CASE WHEN lo > hi THEN lo ELSE hi END AS max_price_raw,
       CASE WHEN lo > hi THEN shi ELSE slo END AS min_price_scaled,
       CASE WHEN lo > hi THEN slo ELSE shi END AS max_price_scaled
FROM (
  SELECT c.*, d.State IS NOT NULL AS has_history,
    CASE WHEN c.has_rainfall THEN c.rainfall
         ELSE (CASE WHEN d.State IS NULL THEN 0.0 ELSE d.rainfall END) * 925.3081 + 782.7453 END AS rainfall_raw,
    CASE WHEN c.has_rainfall THEN (c.rainfall - 782.7453) / 925.3081
         WHEN d.State IS NULL THEN 0.0 ELSE d.rainfall END AS rainfall_scaled,
    greatest(0.0, coalesce(c.min_price, (CASE WHEN d.State IS NULL THEN -1.0 ELSE d.min_price END) * 1029.2886 + 1563.7877)) AS lo,
    greatest(0.0, coalesce(c.max_price, (CASE WHEN d.State IS NULL THEN 1.0 ELSE d.max_price END) * 1194.8210 + 1865.0167)) AS hi,
    CASE WHEN c.min_price IS NOT NULL THEN (greatest(0.0, c.min_price) - 1563.7877) / 1029.2886
         WHEN d.State IS NULL THEN -1.0 ELSE d.min_price END AS slo,
    CASE WHEN c.max_price IS NOT NULL THEN (greatest(0.0, c.max_price) - 1865.0167) / 1194.8210
         WHEN d.State IS NULL THEN 1.0 ELSE d.max_price END AS shi
  FROM checked c LEFT JOIN defaults d ON c.state = d.State AND c.district = d.District AND c.crop = d.Crop)
"""

_PRED = f"""
SELECT *, predicted_yield * predicted_price * 10 AS total_value FROM (
  SELECT q.*,
    CASE WHEN nullif(q.market, '') IS NULL THEN {MARKET} ELSE q.market END AS used_market,
    CASE WHEN nullif(q.variety, '') IS NULL THEN {VARIETY} ELSE q.variety END AS used_variety,
    CASE WHEN nullif(q.grade, '') IS NULL THEN {GRADE} ELSE q.grade END AS used_grade,
    coalesce(k.y, s.y, c.y, 0.5) AS avg_yield_ha,
    CASE WHEN k.y IS NOT NULL THEN 1 WHEN s.y IS NOT NULL THEN 2 WHEN c.y IS NOT NULL THEN 3 ELSE 4 END AS yield_level,
    CASE WHEN reason IS NULL THEN greatest(0.0, coalesce(k.y, s.y, c.y, 0.5) * q.area) END AS predicted_yield,
    CASE WHEN reason IS NULL THEN greatest(0.0, q.given_price) END AS predicted_price
  FROM resolved q
  LEFT JOIN (SELECT State, District, Crop, {mean('yield')} AS y FROM trends GROUP BY ALL) k
    ON k.State = upper(trim(q.state)) AND k.District = upper(trim(q.district)) AND k.Crop = q.crop
  LEFT JOIN (SELECT State, Crop, {mean('yield')} AS y FROM trends GROUP BY ALL) s
    ON s.State = upper(trim(q.state)) AND s.Crop = q.crop
  LEFT JOIN (SELECT Crop, {mean('yield')} AS y FROM trends GROUP BY ALL) c ON c.Crop = q.crop)
"""

_OUT = f"""
SELECT req_id, 'success' AS status, crop, state, district, season, area,
       {r('predicted_yield', 2)} AS predicted_yield_tonnes, {r('predicted_price', 2)} AS predicted_price_inr_quintal,
       {r('total_value', 2)} AS total_estimated_value_inr,
       CASE WHEN has_history THEN 'HIGH' ELSE 'MODERATE' END AS confidence_rating,
       used_market AS market, used_variety AS variety, used_grade AS grade,
       {r('min_price_raw', 2)} AS min_price, {r('max_price_raw', 2)} AS max_price, {r('rainfall_raw', 1)} AS rainfall
FROM pred WHERE reason IS NULL
"""

_SHOWN = f"""
SELECT *, CASE WHEN z < -0.3 THEN 'Below Average Rainfall' WHEN z > 0.3 THEN 'Above Average Rainfall' ELSE 'Normal Rainfall' END AS rain_class,
  CASE WHEN aw + rw >= 94 THEN 58 ELSE aw END AS area_weight, CASE WHEN aw + rw >= 94 THEN 28 ELSE rw END AS rain_weight,
  CASE WHEN aw + rw >= 94 THEN 14 ELSE 100 - aw - rw END AS base_weight,
  regexp_replace(cast(cast(ha AS decimal(28,10)) AS varchar), '\\.?0+$', '') AS ha_text,
  greatest(0.0, predicted_price_inr_quintal * 0.88) AS price_low, greatest(0.0, predicted_price_inr_quintal * 1.12) AS price_high,
  total_estimated_value_inr * 0.88 AS revenue_low, total_estimated_value_inr * 1.12 AS revenue_high,
  CASE WHEN predicted_price_inr_quintal - (min_price + max_price) / 2 > 50 THEN 'Increasing Trend'
       WHEN predicted_price_inr_quintal - (min_price + max_price) / 2 < -50 THEN 'Decreasing Trend' ELSE 'Stable Trend' END AS market_trend
FROM (
  SELECT *, cast(floor(48 + least(20.0, ha * 1.2) + 0.5) AS int) AS aw,
         cast(floor(18 + least(22.0, abs(z) * 12) + 0.5) AS int) AS rw
  FROM (SELECT *, (rainfall - 782.7453) / 925.3081 AS z, CASE WHEN area = 0 THEN 10.0 ELSE area END AS ha FROM published))
"""

_LABELS = (
    "CASE WHEN area_weight > 65 THEN 'Very High Influence' WHEN area_weight < 45 THEN 'Moderate Influence'"
    " ELSE 'High Influence' END AS area_influence,"
    " CASE WHEN rain_weight > 30 THEN 'High Influence' WHEN rain_weight < 15 THEN 'Low Influence'"
    " ELSE 'Medium Influence' END AS rain_influence, 'Baseline Influence' AS base_influence"
)

# name: (views it reads, text), on top of the shared views
DERIVED = {
    **VIEWS,
    "vocab": (("agri", "price_facts"), _vocab()),
    "asia": (("production",), _ASIA),
    "asia_prices": (("prices",), _ASIA_PRICES),
    "asia_means": (("asia_prices",), _means("asia_prices")),
    "wanted": (("asia",), _WANTED),
    "ladder": (("wanted", "asia_means"), _LADDER),
    "asia_rain": (("rainfall",), _ASIA_RAIN),
    "season_rain": (("asia", "asia_rain"), _SEASON_RAIN),
    "joined": (("agri", "rainfall"), _JOINED),
    "district_means": (("prices",), _DISTRICT_MEANS),
    "priced": (("agri", "district_means"), _PRICED),
    "defaults": (("agri",), _DEFAULTS),
    "trends": (("agri",), _TRENDS),
    "checked": (("full_requests",), _CHECKED),
    "resolved": (("checked", "defaults"), _RESOLVED),
    "pred": (("resolved", "trends", "vocab"), _PRED),
    "published": (("pred",), _OUT),
    "shown": (("published",), _SHOWN),
}

ORACLES: dict[str, str] = {}


def oracle(name: str, views: list[str], body: str) -> None:
    ORACLES[name] = f"{with_clause(views, DERIVED)}\n{body.strip()}"


# Cleaning

oracle(
    "insert_if_absent",
    ["users", "auth_events"],
    """SELECT id, username FROM users UNION ALL
    SELECT min(id), username FROM auth_events WHERE action = 'REGISTER' AND username NOT IN (SELECT username FROM users)
    GROUP BY username""",
)
oracle(
    "normalise_keys",
    ["production"],
    """SELECT l_orderkey, l_linenumber, upper(trim(State_Name)) AS State_Name, upper(trim(District_Name)) AS District_Name,
    trim(Season) AS Season, trim(Crop) AS Crop FROM production""",
)
oracle(
    "to_numeric",
    ["agri_raw"],
    f"SELECT {KEY}, "
    + ", ".join(f"try_cast({c} AS double) AS {c}" for c in ("Rainfall", "Area", "Production", "Modal_Price", "Year"))
    + " FROM agri_raw",
)
_PRICE_ROW = "State, District, Commodity, Market, Year, Month"
oracle(
    "drop_nulls",
    ["prices"],
    f"SELECT {_PRICE_ROW}, {_wide(P3)} FROM prices WHERE Min_Price IS NOT NULL AND Max_Price IS NOT NULL",
)
oracle(
    "only_state",
    ["production"],
    "SELECT l_orderkey, l_linenumber, State_Name, Crop FROM production WHERE upper(trim(State_Name)) = 'ASIA'",
)
oracle(
    "filter_contains",
    ["prices"],
    f"SELECT {_PRICE_ROW}, {_wide(P3)} FROM prices WHERE upper(State) LIKE '%ASI%' AND upper(Commodity) LIKE '%RING%'",
)
oracle(
    "safe_yield",
    ["agri"],
    f"SELECT {KEY}, Year, Season, Area, Production, {r('CASE WHEN Area > 0 THEN Production / Area ELSE 0.0 END')} AS yield FROM agri",
)
oracle(
    "tolerant_parse",
    ["agri_raw"],
    f"""SELECT {KEY}, {r('cast(Rainfall AS double)')} AS Rainfall, {r('try_cast(Area AS double)')} AS Area,
    {r('try_cast(Production AS double)')} AS Production, {r('try_cast(Modal_Price AS double)')} AS Modal_Price,
    try_cast(Year AS int) AS Year, try_cast(Area AS double) IS NOT NULL AND try_cast(Production AS double) IS NOT NULL
    AND try_cast(Modal_Price AS double) IS NOT NULL AND try_cast(Year AS int) IS NOT NULL AS trend_ok FROM agri_raw""",
)
oracle(
    "zscore_roundtrip",
    ["prices"],
    f"""SELECT District, Year, {_wide(["Min_Price", "Max_Price"])},
    {r('(Min_Price - 1563.7877) / 1029.2886')} AS z_min, {r('(Max_Price - 1865.0167) / 1194.8210')} AS z_max,
    {r('Min_Price')} AS back_min, {r('Max_Price')} AS back_max FROM prices""",
)
oracle(
    "order_bounds",
    ["requests"],
    """SELECT req_id, least(greatest(coalesce(min_price, 0.0), 0.0), greatest(coalesce(max_price, 0.0), 0.0)) AS low,
    greatest(coalesce(min_price, 0.0), coalesce(max_price, 0.0), 0.0) AS high FROM requests""",
)
oracle(
    "normalise_requests",
    ["full_requests"],
    """SELECT req_id, upper(state) AS state, upper(district) AS district, crop, season, coalesce(commodity, crop) AS commodity,
    area, 2024 AS year, 6 AS month, has_rainfall FROM full_requests""",
)
oracle("validate_requests", ["checked"], f"SELECT req_id, reason, {r('area')} AS area FROM checked")
oracle(
    "resolve_inputs",
    ["resolved"],
    "SELECT req_id, has_history, "
    + _wide([f"{c}_{k}" for c in ("rainfall", "min_price", "max_price") for k in ("raw", "scaled")])
    + " FROM resolved WHERE reason IS NULL",
)
oracle(
    "standardise",
    ["agri"],
    f"""SELECT {KEY}, Year, Season, {r('Modal_Price')} AS Modal_Price, {r('(Modal_Price - m) / s')} AS z
    FROM (SELECT *, avg(Modal_Price) OVER () AS m, stddev_samp(Modal_Price) OVER () AS s FROM agri)""",
)

# Joins

oracle(
    "join_rainfall", ["joined"], f"SELECT {KEY}, Year, Season, sub_clean, {_wide(['Rainfall', *RAIN])} FROM joined"
)
oracle(
    "join_prices",
    ["priced"],
    f"SELECT {KEY}, Year, Season, {_wide(['Min_Price_x', 'Max_Price_x', 'Min_Price_y', 'Max_Price_y'])} FROM priced",
)
# Without given prices the constants may stand in the wrong order only for known keys.
oracle(
    "lookup_defaults",
    ["requests", "defaults"],
    """SELECT req_id, has_history, rainfall AS rainfall_scaled, CASE WHEN lo > hi THEN x ELSE n END AS min_price_scaled,
    CASE WHEN lo > hi THEN n ELSE x END AS max_price_scaled FROM (
      SELECT *, greatest(0.0, n * 1029.2886 + 1563.7877) AS lo, greatest(0.0, x * 1194.8210 + 1865.0167) AS hi FROM (
        SELECT req_id, d.State IS NOT NULL AS has_history, CASE WHEN d.State IS NULL THEN 0.0 ELSE d.rainfall END AS rainfall,
          CASE WHEN d.State IS NULL THEN -1.0 ELSE d.min_price END AS n, CASE WHEN d.State IS NULL THEN 1.0 ELSE d.max_price END AS x
        FROM requests q LEFT JOIN defaults d ON upper(q.state) = d.State AND upper(q.district) = d.District AND q.crop = d.Crop))""",
)
oracle(
    "match_category",
    ["requests", "vocab"],
    "SELECT req_id, "
    + ", ".join(f"{_entry('production', c, _same(f'q.{c}'))} AS {c}_value" for c in ("state", "crop", "season"))
    + " FROM requests q",
)
_EITHER = f"({_same('q.commodity')} OR {_same('q.crop')})"
oracle(
    "match_either",
    ["checked", "vocab"],
    f"""SELECT req_id, {_entry('price', 'commodity', _EITHER)} AS matched_value,
    {_entry('price', 'commodity', _EITHER, 'ordinal')} AS matched_code FROM checked q""",
)
oracle("market_for_district", ["requests", "vocab"], f"SELECT req_id, district, {MARKET} AS market FROM requests q")
oracle("variety_for_crop", ["requests", "vocab"], f"SELECT req_id, crop, {VARIETY} AS variety FROM requests q")
oracle("preferred_grade", ["requests", "vocab"], f"SELECT req_id, {GRADE} AS grade FROM requests")
oracle(
    "expand_aliases",
    ["production"],
    """SELECT l_orderkey, l_linenumber, Crop, cast(generate_subscripts(names, 1) - 1 AS int) AS priority, unnest(names) AS alias FROM (
      SELECT l_orderkey, l_linenumber, trim(Crop) AS Crop, CASE lower(trim(Crop)) WHEN 'ring' THEN ['band', 'ring']
        WHEN 'rod' THEN ['rod', 'ring'] WHEN 'bolt' THEN ['iron bolt', 'bolt'] ELSE [lower(trim(Crop))] END AS names
      FROM production)""",
)
oracle("price_fallback", ["ladder"], f"SELECT District, Year, Crop, cast(level AS int) AS level, {_wide(P3)} FROM ladder")
oracle(
    "rainfall_for_season",
    ["season_rain"],
    f"SELECT l_orderkey, l_linenumber, Year, Season, rain_column, {r('rain_mm')} AS rain_mm FROM season_rain",
)
oracle(
    "rain_means", ["asia_rain"], f"SELECT rain_column, {r(mean('mm'))} AS mean_mm FROM asia_rain GROUP BY rain_column"
)
oracle(
    "region_lookup",
    ["agri"],
    """SELECT DISTINCT 'states' AS selector, State AS value FROM agri
    UNION ALL SELECT DISTINCT 'districts', District FROM agri WHERE State = 'ASIA'
    UNION ALL SELECT DISTINCT 'crops', Crop FROM agri WHERE State = 'AFRICA' AND District = 'NATION_5'
    UNION ALL SELECT DISTINCT 'seasons', trim(Season) FROM agri""",
)

# Aggregates

oracle(
    "state_districts",
    ["agri"],
    """SELECT State, cast(row_number() OVER (PARTITION BY State ORDER BY District) - 1 AS int) AS ordinal, District
    FROM (SELECT DISTINCT State, District FROM agri)""",
)
oracle(
    "district_crops",
    ["agri"],
    f"""SELECT State, District, cast(row_number() OVER (PARTITION BY State, District ORDER BY Crop) - 1 AS int) AS ordinal, Crop
    FROM (SELECT DISTINCT {KEY} FROM agri)""",
)
oracle("vocabulary", ["vocab"], "SELECT model, feature, ordinal, value FROM vocab")
oracle(
    "metadata",
    ["agri", "vocab"],
    f"""SELECT 'regions' AS kind, State AS key, cast(row_number() OVER (PARTITION BY State ORDER BY District) - 1 AS int) AS ordinal,
      District AS value FROM (SELECT DISTINCT State, District FROM agri)
    UNION ALL SELECT 'region_crops', concat(State, '|', District),
      cast(row_number() OVER (PARTITION BY State, District ORDER BY Crop) - 1 AS int), Crop FROM (SELECT DISTINCT {KEY} FROM agri)
    UNION ALL SELECT model, feature, ordinal, value FROM vocab""",
)
oracle("crop_defaults", ["defaults"], "SELECT * FROM defaults")
oracle("crop_trends", ["trends"], "SELECT * FROM trends")
oracle("artefact_defaults", ["defaults"], "SELECT * FROM defaults")
oracle("artefact_trends", ["trends"], "SELECT * FROM trends")
oracle(
    "crop_trends_tolerant",
    ["agri_raw"],
    f"""SELECT {KEY}, Year AS year, {r(r(ratio_mean('y'), 9), 4)} AS yield, {r(mean('price'), 2)} AS price FROM (
      SELECT {KEY}, try_cast(Year AS int) AS Year, try_cast(Modal_Price AS double) AS price,
        CASE WHEN try_cast(Area AS double) > 0 THEN try_cast(Production AS double) / try_cast(Area AS double) ELSE 0.0 END AS y
      FROM agri_raw WHERE try_cast(Area AS double) IS NOT NULL AND try_cast(Production AS double) IS NOT NULL
        AND try_cast(Year AS int) IS NOT NULL)
    GROUP BY {KEY}, Year""",
)
oracle(
    "nested_trends",
    ["trends"],
    f"""SELECT {KEY}, cast(row_number() OVER (PARTITION BY {KEY} ORDER BY year) - 1 AS int) AS ordinal, year, yield, price
    FROM trends""",
)
_NEAR = "SELECT {} FROM defaults d WHERE d.State = q.state OR d.Crop = q.crop"


def _filled(c: str, constant: str) -> str:
    near = _NEAR.format(r(mean(f"d.{c}"), 4))
    return f"CASE WHEN e.State IS NOT NULL THEN e.{c} ELSE coalesce(({near}), {constant}) END AS {c}"


_FILLED = ", ".join(
    _filled(c, k) for c, k in (("rainfall", "0.0"), ("min_price", "-1.0"), ("max_price", "1.0"))
)
_FILLED_KEYS = f"""
SELECT k.req_id, k.state, k.district, k.crop, f.rainfall, f.min_price, f.max_price
FROM (SELECT req_id, upper(state) AS state, upper(district) AS district, crop FROM requests) k
JOIN (SELECT q.*, {_FILLED} FROM (SELECT DISTINCT upper(state) AS state, upper(district) AS district, crop FROM requests) q
      LEFT JOIN defaults e ON e.State = q.state AND e.District = q.district AND e.Crop = q.crop) f
  ON f.state = k.state AND f.district = k.district AND f.crop = k.crop
"""
oracle("defaults_fallback", ["requests", "defaults"], _FILLED_KEYS)
oracle(
    "region_defaults",
    ["requests", "defaults", "vocab"],
    f"""SELECT q.req_id, q.state, q.district, q.crop, {r('rainfall * 925.3081 + 782.7453', 1)} AS rainfall,
    {r('least(lo, hi)', 2)} AS min_price, {r('greatest(lo, hi)', 2)} AS max_price,
    {MARKET} AS default_market, {VARIETY} AS default_variety, {GRADE} AS default_grade
    FROM (SELECT *, greatest(0.0, min_price * 1029.2886 + 1563.7877) AS lo,
                 greatest(0.0, max_price * 1194.8210 + 1865.0167) AS hi FROM ({_FILLED_KEYS})) q""",
)
_CLEAN_PRICES = "(SELECT * REPLACE (upper(trim(District)) AS District, lower(trim(Commodity)) AS Commodity) FROM prices)"
oracle(
    "price_means",
    ["prices"],
    f"""SELECT cast(level AS int) AS level, District, Year, Commodity, {_wide(P3)} FROM ({_means(_CLEAN_PRICES)})""",
)
oracle(
    "price_by_district_year",
    ["district_means"],
    f"SELECT State, District, Year, {_wide(['Min_Price', 'Max_Price'])} FROM district_means",
)
_REGION = "FROM prices WHERE upper(State) LIKE '%AMERICA%' AND upper(District) LIKE '%NATION\\_1%' ESCAPE '\\'"
_MEAN3 = ", ".join(f"{r(mean(c))} AS {c}" for c in P3)
oracle("commodity_averages", ["prices"], f"SELECT Commodity, {_MEAN3} {_REGION} GROUP BY Commodity")
oracle("region_averages", ["prices"], f"SELECT Year, {_MEAN3} {_REGION} GROUP BY Year")
oracle(
    "global_moments",
    ["prices"],
    f"""SELECT count(*) AS rows, {r('avg(Min_Price)')} AS mean_min, {r('avg(Max_Price)')} AS mean_max,
    {r('stddev_samp(Min_Price)')} AS std_min, {r('stddev_samp(Max_Price)')} AS std_max
    FROM prices WHERE Min_Price IS NOT NULL AND Max_Price IS NOT NULL""",
)
oracle(
    "column_stats",
    ["agri"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std,
        {r(f'min({c})')} AS min, {r(f'max({c})')} AS max FROM agri"""
        for c in ("Rainfall", "Min_Price", "Max_Price", "Modal_Price")
    ),
)
_D = """(SELECT Min_Price - (Modal_Price - (SELECT avg(Modal_Price) FROM agri))
        / (SELECT stddev_samp(Modal_Price) FROM agri) AS d FROM agri)"""
oracle(
    "describe_difference",
    ["agri"],
    " UNION ALL ".join(
        f"SELECT '{name}' AS statistic, {r(f'cast({expr} AS double)')} AS value FROM {_D}"
        for name, expr in (
            ("count", "count(d)"), ("mean", "avg(d)"), ("std", "stddev_samp(d)"), ("min", "min(d)"), ("max", "max(d)"),
            ("25%", "quantile_cont(d, 0.25)"), ("50%", "quantile_cont(d, 0.5)"), ("75%", "quantile_cont(d, 0.75)"),
        )
    ),
)
oracle(
    "price_correlations",
    ["agri"],
    " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, {r(f'corr({x}, {y})')} AS correlation FROM agri"
        for x, y in (("Modal_Price", "Min_Price"), ("Modal_Price", "Max_Price"), ("Min_Price", "Max_Price"))
    ),
)
_CORRS = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", corr(Rainfall, {c}) AS correlation FROM joined"
    for i, c in enumerate(RAIN)
)
oracle(
    "rank_correlations",
    ["joined"],
    f"""SELECT cast(row_number() OVER (ORDER BY abs(correlation) DESC, position) AS int) AS rank, "column",
    {r('correlation')} AS correlation FROM ({_CORRS})""",
)
_SEASONAL = " UNION ALL ".join(
    f"""SELECT trim(Season) AS Season, {i} AS position, '{c}' AS "column", corr(Rainfall, {c}) AS correlation, regr_count({c}, Rainfall) AS n,
    regr_slope({c}, Rainfall) AS slope, regr_intercept({c}, Rainfall) AS intercept, regr_r2({c}, Rainfall) AS r2
    FROM joined GROUP BY trim(Season)"""
    for i, c in enumerate(TOTALS)
)
_BEST = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Season ORDER BY abs(correlation) DESC, position) AS pick
  FROM ({_SEASONAL})) WHERE pick = 1)"""
oracle("best_rain_column", ["joined"], f"""SELECT Season, "column", {r('correlation')} AS correlation FROM {_BEST}""")
oracle(
    "fit_rain_scale",
    ["joined"],
    f"""SELECT Season, "column", n, {_wide(['correlation', 'slope', 'intercept', 'r2'])} FROM {_BEST} WHERE n > 5""",
)
oracle(
    "fit_scale",
    ["priced"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS price, count({c}_y) AS n, {r(f'regr_slope({c}_y, {c}_x)')} AS slope,
        {r(f'regr_intercept({c}_y, {c}_x)')} AS intercept, {r(f'regr_r2({c}_y, {c}_x)')} AS r2 FROM priced"""
        for c in ("Min_Price", "Max_Price")
    ),
)
oracle(
    "fallback_yield",
    ["pred"],
    f"""SELECT req_id, CASE WHEN state = 'ASIA' THEN {r('avg_yield_ha')} END AS avg_yield_ha,
    CASE WHEN state = 'ASIA' THEN yield_level END AS yield_level,
    CASE WHEN state = 'ASIA' THEN {r('predicted_yield')} END AS predicted_yield FROM pred WHERE reason IS NULL""",
)
oracle(
    "shape_counts",
    ["agri"],
    "SELECT State, trim(Season) AS Season, count(*) AS rows FROM agri GROUP BY State, trim(Season)",
)

# Windows, top-k and sets

oracle(
    "sample_pairs",
    ["joined"],
    f"""SELECT Season, cast(sample AS int) AS sample, Year, sub_clean, District, Crop, {_wide(['Production', 'Rainfall', 'JJAS', 'ANNUAL'])}
    FROM (SELECT *, row_number() OVER (PARTITION BY Season ORDER BY Year, sub_clean, District, Crop, Production, Rainfall) AS sample
      FROM (SELECT * REPLACE (trim(Season) AS Season), row_number() OVER (PARTITION BY trim(Season), Year, sub_clean
        ORDER BY Year, sub_clean, District, Crop, Production, Rainfall) AS one FROM joined) WHERE one = 1) WHERE sample <= 5""",
)


def _norm(c: str) -> str:
    low, high = f"min({c}) OVER (PARTITION BY {KEY})", f"max({c}) OVER (PARTITION BY {KEY})"
    return f"{r(f'({c} - {low}) / coalesce(nullif({high} - {low}, 0), 1)')} AS {c}_norm"


oracle(
    "normalise_series",
    ["trends"],
    f"SELECT {KEY}, year, {r('yield')} AS yield, {r('price')} AS price, {_norm('yield')}, {_norm('price')} FROM trends",
)
oracle(
    "trend_endpoints",
    ["trends"],
    f"""SELECT {KEY}, min(year) AS first_year, arg_min(yield, year) AS first_yield, arg_min(price, year) AS first_price,
    max(year) AS last_year, arg_max(yield, year) AS last_yield, arg_max(price, year) AS last_price FROM trends GROUP BY {KEY}""",
)
_LOGGED = ["latency_ms", "predicted_yield", "predicted_price", "total_value"]
oracle(
    "recent_predictions",
    ["prediction_logs"],
    f"SELECT id, username, timestamp, {_wide(_LOGGED)}, status FROM prediction_logs ORDER BY id DESC LIMIT 10",
)
oracle("recent_auth", ["auth_events"], "SELECT * FROM auth_events ORDER BY id DESC LIMIT 10")
oracle(
    "latency_history",
    ["prediction_logs"],
    """SELECT id, timestamp, latency_ms AS latency FROM prediction_logs WHERE status = 'SUCCESS' ORDER BY id DESC LIMIT 20""",
)
oracle("distinct_head", ["agri"], "SELECT DISTINCT SUBDIVISION FROM agri ORDER BY SUBDIVISION LIMIT 5")
oracle(
    "head",
    ["prices"],
    f"""SELECT {_PRICE_ROW}, {_wide(P3)} FROM (SELECT * {_REGION}
    ORDER BY Commodity, Market, Year, Month, Modal_Price, Min_Price NULLS FIRST, Max_Price NULLS FIRST LIMIT 10)""",
)
_REST = ["Rainfall", "Modal_Price", "Min_Price", "Max_Price"]
oracle(
    "replace_state",
    ["agri", "asia"],
    f"""SELECT CASE WHEN Season <> 'Autumn     ' THEN State END AS State, District, Year, Season, Crop, {r('Area')} AS Area,
      {r('Production')} AS Production, SUBDIVISION, {_wide(_REST)} FROM agri WHERE State <> 'ASIA' OR Season = 'Autumn     '
    UNION ALL SELECT State, District, Year, Season, Crop, {r('Area')}, {r('Production')}, NULL, NULL, NULL, NULL, NULL FROM asia""",
)

# Scoring

oracle(
    "ordinal_encode",
    ["checked", "vocab"],
    "SELECT req_id, "
    + ", ".join(
        f"{_entry('price', c, _same(f'''coalesce(q.{c}, '')'''), 'ordinal')} AS {c}_code"
        for c in ("state", "district", "market", "variety", "grade")
    )
    + f", {_entry('price', 'commodity', _EITHER, 'ordinal')} AS commodity_code FROM checked q",
)
_FIT = "(SELECT Production AS y, Area * 1500.0 + Modal_Price AS f FROM agri)"
oracle(
    "fit_r2",
    ["agri"],
    f"SELECT count(*) AS n, {r('1 - sum(pow(y - f, 2)) / (var_pop(y) * count(*))')} AS r2 FROM {_FIT}",
)
oracle("valuation", ["pred"], f"SELECT req_id, {_wide(['predicted_yield', 'predicted_price', 'total_value'], 4)} FROM pred")
oracle(
    "confidence",
    ["requests", "defaults"],
    """SELECT req_id, CASE WHEN EXISTS (SELECT 1 FROM defaults d WHERE d.State = upper(q.state) AND d.District = upper(q.district)
    AND d.Crop = q.crop) THEN 'HIGH' ELSE 'MODERATE' END AS confidence_rating FROM requests q""",
)
_BASE_YIELD = "CASE WHEN area > 0 THEN predicted_yield / area ELSE 0.2 END"
oracle(
    "synthetic_history",
    ["pred", "trends"],
    f"""SELECT req_id, cast(row_number() OVER (PARTITION BY req_id ORDER BY year) - 1 AS int) AS ordinal, year, yield, price FROM (
      SELECT req_id, t.year, t.yield, t.price FROM pred p
        JOIN trends t ON t.State = p.state AND t.District = p.district AND t.Crop = p.crop WHERE reason IS NULL
      UNION ALL
      SELECT req_id, f.year, {r(f'({_BASE_YIELD}) * f.y', 4)}, {r('predicted_price * f.p', 2)}
      FROM pred p, (VALUES (2020, 0.88::double, 0.90::double), (2021, 0.94, 0.93), (2022, 0.90, 0.96), (2023, 1.05, 1.03), (2024, 1.0, 1.0)) f(year, y, p)
      WHERE reason IS NULL AND NOT EXISTS (SELECT 1 FROM trends t WHERE t.State = p.state AND t.District = p.district AND t.Crop = p.crop))""",
)
oracle("predict_fallback", ["published"], "SELECT * FROM published")
oracle(
    "prediction_log",
    ["pred"],
    f"""SELECT req_id, crop, state, district, season, {r('area', 4)} AS area, {r('rainfall_raw', 4)} AS rainfall,
    'SUCCESS' AS status, {_wide(['predicted_yield', 'predicted_price', 'total_value'], 4)}
    FROM pred WHERE reason IS NULL""",
)
oracle("rejected_requests", ["checked"], "SELECT req_id, reason FROM checked WHERE reason IS NOT NULL")

# Insights

oracle(
    "confidence_bounds",
    ["shown"],
    f"SELECT req_id, {_wide(['price_low', 'price_high', 'revenue_low', 'revenue_high'], 4)} FROM shown",
)
oracle(
    "rainfall_class",
    ["agri"],
    f"""SELECT {KEY}, Year, Season, CASE WHEN Rainfall < -0.3 THEN 'Below Average Rainfall' WHEN Rainfall > 0.3 THEN 'Above Average Rainfall'
    ELSE 'Normal Rainfall' END AS rainfall_class FROM agri""",
)


def _text(template: str, *values: str) -> str:
    """A sentence template with SQL expressions for its ``%s``."""
    parts = template.replace("%%", "%").split("%s") if "%s" in template else [template]
    pieces = [f"'{parts[0]}'"]
    for value, part in zip(values, parts[1:]):
        pieces += [value, f"'{part}'"]
    return f"concat({', '.join(pieces)})"


_MM = "printf('%.1f', rainfall)"
# The sentences, written out here a second time on purpose.
_SENTENCES = {
    "Below Average Rainfall": "Expected seasonal rainfall of %s mm is below the regional average of 782.7 mm. "
    "This deficit of moisture reduces the expected crop growth and lowers yield potential.",
    "Normal Rainfall": "Expected seasonal rainfall of %s mm matches regional baseline averages (782.7 mm). "
    "Normal weather conditions support steady crop development.",
    "Above Average Rainfall": "Expected seasonal rainfall of %s mm is above the regional average of 782.7 mm. "
    "The abundant moisture supports strong vegetation growth, which optimizes crop yield.",
}
_SENTENCE = (
    "CASE rain_class "
    + " ".join(f"WHEN '{k}' THEN {_text(t, _MM)}" for k, t in _SENTENCES.items())
    + " END AS rainfall_narrative"
)
_PLAIN = _text(
    "Our model determines this estimate based on three core features. "
    "First, your **Farm Size of %s Hectares** scales the total output volume. "
    "Second, the **expected rainfall of %s mm** (%s) determines crop growth conditions. "
    "Finally, the historical performance baseline of **%s** in **%s, %s** sets the regional average.",
    "ha_text", _MM, "lower(rain_class)", "crop", "district", "state",
)
_TECHNICAL = _text(
    "Our tree-boosted model splits feature attributions mathematically: "
    "First, the **Farm Size of %s Hectares** scales the production volume, "
    "contributing **%s%%** of the yield output. "
    "Second, **Rainfall conditions (Z-score index: %s)** accounts for **%s%%** of the estimate. "
    "Finally, the historical performance of **%s** in **%s, %s** "
    "establishes a **%s%%** soil and climate baseline.",
    "ha_text", "cast(area_weight AS varchar)", "printf('%.4f', z)", "cast(rain_weight AS varchar)",
    "crop", "district", "state", "cast(base_weight AS varchar)",
)
oracle(
    "rainfall_narrative",
    ["shown"],
    f"""SELECT req_id, 'plain' AS mode, {_SENTENCE}, {_PLAIN} AS explanation FROM shown
    UNION ALL SELECT req_id, 'technical', {_SENTENCE}, {_TECHNICAL} FROM shown""",
)
oracle("market_trend", ["shown"], "SELECT req_id, market_trend FROM shown")
oracle("influence_weights", ["shown"], "SELECT req_id, area_weight, rain_weight, base_weight FROM shown")
oracle("influence_labels", ["shown"], f"SELECT req_id, {_LABELS} FROM shown")
oracle(
    "log_classes",
    ["prediction_logs", "auth_events"],
    """SELECT 'prediction' AS log, id, split_part(status, ':', 1) AS label,
      CASE WHEN status = 'SUCCESS' THEN 'success' ELSE 'error' END AS row_class, NULL AS address FROM prediction_logs
    UNION ALL SELECT 'auth', id, action, CASE WHEN action LIKE '%FAILURE%' THEN 'error' ELSE 'success' END,
      coalesce(ip_address, 'local') FROM auth_events""",
)


def _report(rows: list[tuple[str, str]]) -> str:
    parts = [
        f"SELECT req_id, {i} AS position, '{a}' AS attribute, {v} AS value FROM rows" for i, (a, v) in enumerate(rows)
    ]
    return " UNION ALL ".join(parts)


def _money(c: str) -> str:
    return f"concat('₹', printf('%.2f', {c}))"


def _grouped(c: str) -> str:
    return f"concat('₹', format('{{:,.2f}}', {c}))"


def _shortest(c: str) -> str:
    """At most two decimals."""
    return f"rtrim(rtrim({_grouped(c)}, '0'), '.')"


_HEAD = [
    ("Predicted Crop Yield", "concat(printf('%.2f', predicted_yield_tonnes), ' Tonnes')"),
    ("Market Price (Modal)", f"concat({_money('predicted_price_inr_quintal')}, ' / Quintal')"),
    ("Expected Yearly Revenue", _grouped("total_estimated_value_inr")),
    ("Revenue Bounds", f"concat({_shortest('revenue_low')}, ' to ', {_shortest('revenue_high')})"),
]
_PLACE = [
    ("Cultivated State", "state"),
    ("Cultivated District", "district"),
    ("Crop Commodity", "crop"),
    ("Cultivation Season Cycle", "season"),
    ("Land Area Profile", "concat(ha_text, ' Hectares')"),
]
_ASSUMED = [("Assumed Product Grade", "grade"), ("Assumed Market Center", "market"), ("Crop Variety Profile", "variety")]
_LABELLED = f"SELECT *, {_LABELS} FROM shown"
oracle(
    "valuation_report",
    ["shown"],
    f"SELECT * FROM (WITH rows AS ({_LABELLED}) "
    + _report(
        [
            *_HEAD,
            ("Farm Scale Influence", "area_influence"),
            ("Rainfall & Weather Impact", "rain_class"),
            ("Soil & Local Suitability Baseline", "base_influence"),
            ("Market Trend", "market_trend"),
            *_PLACE,
            ("Expected Rainfall", f"concat({_MM}, ' mm (', rain_class, ')')"),
            *_ASSUMED,
            ("Expected Price Range", f"concat({_money('price_low')}, ' – ', {_money('price_high')}, ' per Quintal')"),
        ]
    )
    + ")",
)
_Z_MIN = "printf('%.4f', (min_price - 1563.7877) / 1029.2886)"
_Z_MAX = "printf('%.4f', (max_price - 1865.0167) / 1194.8210)"
oracle(
    "valuation_report_technical",
    ["shown"],
    f"SELECT * FROM (WITH rows AS ({_LABELLED}) "
    + _report(
        [
            *_HEAD,
            ("Farm Scale Influence", "concat(cast(area_weight AS varchar), '%')"),
            ("Rainfall & Weather Impact", "concat(cast(rain_weight AS varchar), '%')"),
            ("Soil & Local Suitability Baseline", "concat(cast(base_weight AS varchar), '%')"),
            ("Market Trend", "market_trend"),
            *_PLACE,
            ("Rainfall Standard Index", f"concat(printf('%.4f', z), ' (Raw: ', {_MM}, ' mm)')"),
            *_ASSUMED,
            ("Price Model Min Spec (Scaled)", f"concat({_Z_MIN}, ' (Raw Min: ', {_money('min_price')}, ')')"),
            ("Price Model Max Spec (Scaled)", f"concat({_Z_MAX}, ' (Raw Max: ', {_money('max_price')}, ')')"),
        ]
    )
    + ")",
)

# Pipelines

oracle(
    "build_artefacts",
    ["agri", "defaults", "trends", "vocab"],
    """SELECT 'state_districts' AS artefact, count(DISTINCT State) AS rows FROM agri
    UNION ALL SELECT 'district_crops', count(*) FROM (SELECT DISTINCT State, District FROM agri)
    UNION ALL SELECT 'defaults', count(*) FROM defaults UNION ALL SELECT 'trends', count(*) FROM trends
    UNION ALL SELECT 'vocab', count(*) FROM vocab""",
)
oracle(
    "align_state",
    ["asia", "ladder", "season_rain"],
    f"""SELECT a.State, a.District, a.Year, a.Season, a.Crop, {r('a.Area')} AS Area, {r('a.Production')} AS Production,
    'ASIA' AS SUBDIVISION, {r('(w.rain_mm - 782.7453) / 925.3081')} AS Rainfall, {r('l.Modal_Price')} AS Modal_Price,
    {r('(l.Min_Price - 1563.7877) / 1029.2886')} AS Min_Price, {r('(l.Max_Price - 1865.0167) / 1194.8210')} AS Max_Price
    FROM asia a JOIN ladder l ON l.District = a.District AND l.Year = a.Year AND l.Crop = a.Crop
    JOIN (SELECT DISTINCT Year, Season, rain_mm FROM season_rain) w ON w.Year = a.Year AND w.Season = a.Season""",
)


def _summary(error: str) -> str:
    return f"""SELECT count(*) AS total_predictions,
    {r("coalesce(avg(latency_ms) FILTER (WHERE status = 'SUCCESS'), 0.0)", 2)} AS avg_latency_ms,
    {r(f"coalesce(count(*) FILTER (WHERE {error}) / nullif(count(*), 0) * 100, 0.0)", 2)} AS error_rate_pct
    FROM prediction_logs"""


oracle("monitor_summary", ["prediction_logs"], _summary("status = 'ERROR'"))
oracle("monitor_summary_prefix", ["prediction_logs"], _summary("status LIKE 'ERROR%'"))


def _fields(source: str, section: str, fields: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, cast(row_id AS bigint) AS row_id, '{f}' AS field, cast({v} AS varchar) AS value FROM ({source})"
        for f, v in fields.items()
    )


_MONEY = "cast({} AS decimal(18,2))"
_LOG_SECTIONS = [
    _fields(
        f"SELECT 0 AS row_id, * FROM ({_summary("status = 'ERROR'")})",
        "summary",
        {
            "total_predictions": "total_predictions",
            "avg_latency_ms": _MONEY.format("avg_latency_ms"),
            "error_rate_pct": _MONEY.format("error_rate_pct"),
        },
    ),
    _fields(
        "SELECT id AS row_id, * FROM prediction_logs WHERE status = 'SUCCESS' ORDER BY id DESC LIMIT 20",
        "latency_history",
        {"latency": _MONEY.format("latency_ms")},
    ),
    _fields(
        "SELECT id AS row_id, * FROM prediction_logs ORDER BY id DESC LIMIT 10",
        "recent_predictions",
        {"username": "username", "status": "status", "total_value": _MONEY.format("total_value")},
    ),
]
_AUTH_SECTION = _fields(
    "SELECT id AS row_id, * FROM auth_events ORDER BY id DESC LIMIT 10",
    "recent_auth_events",
    {"username": "username", "action": "action", "ip_address": "ip_address"},
)
oracle("monitoring", ["prediction_logs", "auth_events"], " UNION ALL ".join([*_LOG_SECTIONS, _AUTH_SECTION]))
oracle("stream_report", ["prediction_logs"], " UNION ALL ".join(_LOG_SECTIONS))
_WINDOWS = f"""SELECT time_bucket(INTERVAL 1 DAY, timestamp) AS window_start,
  time_bucket(INTERVAL 1 DAY, timestamp) + INTERVAL 1 DAY AS window_end, count(*) AS predictions,
  {r(mean("CASE WHEN status = 'SUCCESS' THEN latency_ms END"), 4)} AS avg_latency_ms,
  count(*) FILTER (WHERE status = 'ERROR') AS errors FROM prediction_logs GROUP BY ALL"""
oracle("monitor_windows", ["prediction_logs"], _WINDOWS)
oracle(
    "monitor_stream",
    ["prediction_logs"],
    f"""SELECT * FROM ({_WINDOWS}) WHERE window_end <= (SELECT max(timestamp) FROM prediction_logs) - INTERVAL 1 HOUR""",
)

# Every fact row, without the fixture's filters


def _defaults_of(table: str) -> str:
    return _DEFAULTS.replace("FROM agri", f"FROM {table}")


oracle("crop_defaults_all", ["agri_all"], _defaults_of("agri_all"))
oracle("crop_trends_all", ["agri_all"], _TRENDS.replace("FROM agri", "FROM agri_all"))

# Sources and sinks: what was written is read back

_AGRI_COLUMNS = (
    "State, District, Year, Season, Crop, "
    + _wide(["Area", "Production"])
    + ", SUBDIVISION, "
    + _wide(["Rainfall", "Modal_Price", "Min_Price", "Max_Price"])
)
for _name in ("read_agri", "publish_agri"):
    oracle(_name, ["agri"], f"SELECT {_AGRI_COLUMNS} FROM agri")
oracle("publish_states", ["agri"], f"SELECT {_AGRI_COLUMNS}, upper(State) AS state_key FROM agri")
oracle(
    "state_versions",
    ["agri"],
    f"""SELECT 1 AS version, {_AGRI_COLUMNS} FROM agri UNION ALL SELECT 2 AS version, {_AGRI_COLUMNS} FROM agri
    WHERE State <> 'AFRICA' OR Year % 2 = 0""",
)
_FILE_PRICES = (
    "State, District, {market} AS Market, Commodity, cast(NULL AS varchar) AS Variety, cast(NULL AS varchar) AS Grade, Month, "
    + _wide(P3)
    + ", Year"
)
oracle("read_prices", ["prices"], f"SELECT {_FILE_PRICES.format(market='Market')} FROM prices")
oracle("publish_prices", ["prices"], f"SELECT {_FILE_PRICES.format(market='Market')} FROM prices")
oracle("read_prices_pruned", ["prices"], f"SELECT State, Year, {r('Modal_Price')} AS Modal_Price FROM prices")
oracle(
    "union_years",
    ["prices"],
    f"SELECT {_FILE_PRICES.format(market='CASE WHEN Year % 3 <> 1 THEN Market END')} FROM prices",
)
oracle("read_rainfall", ["rainfall"], f"SELECT SUBDIVISION, YEAR, {_wide([*MONTHS, *TOTALS])} FROM rainfall")
oracle(
    "read_production",
    ["production"],
    f"SELECT State_Name, District_Name, Crop_Year, Season, Crop, {_wide(['Area', 'Production'])} FROM production",
)
oracle(
    "discover_columns",
    ["prices"],
    """SELECT role, "column", n FROM (VALUES ('state', 'State'), ('district', 'District'), ('commodity', 'Commodity'),
      ('min', 'Min_Price'), ('max', 'Max_Price'), ('modal', 'Modal_Price')) t(role, "column")
    JOIN (SELECT unnest(['State', 'District', 'Commodity', 'Min_Price', 'Max_Price', 'Modal_Price']) AS "column",
      unnest([count(State), count(District), count(Commodity), count(Min_Price), count(Max_Price), count(Modal_Price)]) AS n
      FROM prices) c USING ("column")""",
)
oracle(
    "append_predictions",
    ["pred"],
    f"""SELECT req_id AS id, 'ada' AS username, crop, state, district, season, {_wide(['area', 'predicted_yield', 'predicted_price'], 4)},
    'SUCCESS' AS status, DATE '2024-06-15' AS date FROM pred WHERE reason IS NULL""",
)
oracle(
    "append_auth_events",
    ["auth_events"],
    "SELECT id, username, action, ip_address, timestamp, cast(timestamp AS date) AS date FROM auth_events",
)
_ALIGNED = ORACLES["align_state"].rsplit("\nSELECT", 1)[1]
oracle(
    "refresh_state",
    ["agri", "asia", "ladder", "season_rain"],
    f"SELECT {_AGRI_COLUMNS} FROM agri WHERE State <> 'ASIA' UNION ALL BY NAME SELECT{_ALIGNED}",
)

oracle(
    "refresh_shape",
    ["agri", "asia", "ladder", "season_rain"],
    f"""SELECT 1 AS version, count(*) AS rows, 12 AS columns FROM agri UNION ALL SELECT 2, count(*), 12
    FROM (SELECT State FROM agri WHERE State <> 'ASIA' UNION ALL BY NAME SELECT State FROM (SELECT{_ALIGNED}))""",
)
# Lookup tables after one state was replaced
_CHANGED = f"""(SELECT * FROM agri WHERE State <> 'ASIA' UNION ALL BY NAME SELECT a.State, a.District, a.Year, a.Season, a.Crop,
    a.Area, a.Production, 'ASIA' AS SUBDIVISION, (w.rain_mm - 782.7453) / 925.3081 AS Rainfall, l.Modal_Price,
    (l.Min_Price - 1563.7877) / 1029.2886 AS Min_Price, (l.Max_Price - 1865.0167) / 1194.8210 AS Max_Price
    {_ALIGNED[_ALIGNED.index("FROM asia a"):]})"""
oracle(
    "refresh_artefacts",
    ["agri", "asia", "ladder", "season_rain"],
    f"""SELECT 'defaults' AS artefact, {KEY}, CAST(NULL AS INTEGER) AS year, rainfall AS a, min_price AS b, max_price AS c
    FROM ({_defaults_of(_CHANGED)}) UNION ALL
    SELECT 'trends', {KEY}, year, yield, price, NULL FROM ({_TRENDS.replace("FROM agri", f"FROM {_CHANGED}")})""",
)

# Scoring with fixed trees, and what holds for every fitted model


def _code(model: str, feature: str, column: str) -> str:
    return f"(SELECT ordinal FROM vocab WHERE model = '{model}' AND feature = '{feature}' AND value = {column})"


oracle(
    "score_yield_fixed",
    ["agri", "vocab"],
    f"""SELECT State AS state, District, Crop AS crop, Season AS season, Year, Area AS area, Production,
    {r("greatest(0.0, CASE WHEN c < 8 THEN CASE WHEN Area < 20 THEN 100.0 + s ELSE 250.0 + 10 * n END WHEN Rainfall < 0 THEN -5.0 ELSE 40.5 * Area END)")}
    AS predicted_yield FROM (SELECT *, {_code('production', 'state', 'State')} AS s, {_code('production', 'crop', 'Crop')} AS c,
      {_code('production', 'season', 'Season')} AS n FROM agri)""",
)
for _name, _low, _high in (
    ("score_price_fixed", "(Min_Price - 1563.7877) / 1029.2886", "(Max_Price - 1865.0167) / 1194.8210"),
    ("score_direct_fixed", "Min_Price", "Max_Price"),
):
    _tree = f"""CASE WHEN g > 0 THEN 1000.0 + 7 * d + Month ELSE CASE WHEN {_low} < 0 THEN 100 * ({_high}) ELSE 900.5 + v + Year END END"""
    oracle(
        _name,
        ["price_facts", "vocab"],
        f"""SELECT State AS state, Market AS market, Commodity AS commodity, Year, Month, {r('Modal_Price')} AS Modal_Price,
        {r(f"greatest(0.0, {_tree})")} AS predicted_price
        FROM (SELECT *, {_code('price', 'grade', 'Grade')} AS g, {_code('price', 'district', 'District')} AS d,
          {_code('price', 'variety', 'Variety')} AS v FROM price_facts)""",
    )
oracle(
    "fit_models_facts",
    ["agri", "price_facts"],
    """SELECT 'yield' AS model, count(*) AS n, 'state_code,crop_code,season_code,area,rainfall_scaled' AS features, TRUE AS explains FROM agri
    UNION ALL SELECT 'price', count(*), 'state_code,district_code,market_code,commodity_code,variety_code,grade_code,year,month,min_price_scaled,max_price_scaled',
    TRUE FROM price_facts""",
)
oracle(
    "predict_contract",
    ["pred", "trends"],
    f"""SELECT p.req_id, p.crop, p.state, p.district, p.season, p.used_market AS market, p.used_variety AS variety, p.used_grade AS grade,
    CASE WHEN p.has_history THEN 'HIGH' ELSE 'MODERATE' END AS confidence_rating,
    cast(coalesce(t.n, 5) AS int) AS trend_points, CASE WHEN p.state = 'ASIA' THEN {r('p.predicted_yield', 2)} END AS cold_yield,
    TRUE AS not_negative, TRUE AS value_fits
    FROM pred p LEFT JOIN (SELECT State, District, Crop, count(*) AS n FROM trends GROUP BY ALL) t
      ON t.State = p.state AND t.District = p.district AND t.Crop = p.crop WHERE p.reason IS NULL""",
)

ORACLES["score_yield_saved"] = ORACLES["score_yield_fixed"]
oracle(
    "saved_models",
    ["agri", "price_facts"],
    """SELECT 'yield' AS model, count(*) AS n, count(*) AS same FROM agri
    UNION ALL SELECT 'price', count(*), count(*) FROM price_facts""",
)
