"""Views over the benchmark tables that stand in for the real inputs.

The text runs unchanged in Spark SQL and DuckDB. The views are deterministic and
contain zeros, nulls, dirty text and keys without a match, which the benchmark
tables do not have.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from cropline.session import materialise

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

COLD_STATE = "ASIA"
ALIASES = {"ring": ["band", "ring"], "rod": ["rod", "ring"], "bolt": ["iron bolt", "bolt"]}

_BASE = """
SELECT r_name AS State, n_name AS District, n_nationkey AS nk, p_brand, p_type, p_name,
       split_part(p_name, ' ', 2) AS noun, s_name, o_orderpriority,
       cast(year(o_orderdate) AS int) AS Year, cast(month(o_orderdate) AS int) AS Month,
       l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax,
       p_retailprice AS modal, p_retailprice * (1 - l_discount) AS mn, p_retailprice * (1 + l_tax) AS mx
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""

_AGRI = """
SELECT State, District, Year,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Kharif     ' WHEN '2-HIGH' THEN 'Rabi       '
            WHEN '3-MEDIUM' THEN 'Whole Year ' WHEN '4-NOT SPECIFIED' THEN 'Autumn     ' ELSE 'Summer     ' END AS Season,
       p_brand AS Crop,
       CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_quantity END AS Area,
       l_extendedprice AS Production, State AS SUBDIVISION,
       (l_tax * 20000 - 782.7453) / 925.3081 AS Rainfall, modal AS Modal_Price,
       (mn - 1563.7877) / 1029.2886 AS Min_Price, (mx - 1865.0167) / 1194.8210 AS Max_Price
FROM base
WHERE (nk + cast(replace(p_brand, 'Brand#', '') AS int)) % 3 <> 0
  AND NOT (State = 'ASIA' AND p_brand = 'Brand#5') AND p_brand <> 'Brand#25'
"""

# The same for every line item.
_AGRI_ALL = _AGRI[: _AGRI.index("WHERE (nk")]

_AGRI_RAW = """
SELECT State, District, Crop, cast(Rainfall AS string) AS Rainfall,
       CASE WHEN Area = 11 THEN 'n/a' ELSE cast(Area AS string) END AS Area,
       CASE WHEN Area = 12 THEN '' ELSE cast(Production AS string) END AS Production,
       cast(Modal_Price AS string) AS Modal_Price,
       CASE WHEN Area = 13 THEN 'FY98' ELSE cast(Year AS string) END AS Year
FROM agri
"""

_PRICES = """
SELECT State, District, concat(' ', upper(p_name), ' ') AS Commodity, concat(District, ' ', s_name) AS Market,
       Year, Month, CASE WHEN l_linenumber = 6 THEN NULL ELSE mn END AS Min_Price,
       CASE WHEN l_linenumber = 5 THEN NULL ELSE mx END AS Max_Price, modal AS Modal_Price
FROM base
WHERE State <> 'ASIA' OR ((nk + Year) % 4 <> 0 AND Year <> 1998 AND noun <> 'anvil')
"""

_PRODUCTION = """
SELECT concat(' ', lower(State)) AS State_Name, concat(lower(District), ' ') AS District_Name, Year AS Crop_Year,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Kharif ' WHEN '2-HIGH' THEN 'Rabi' WHEN '3-MEDIUM' THEN 'Whole Year'
            WHEN '4-NOT SPECIFIED' THEN 'Monsoon' ELSE 'Summer' END AS Season,
       concat(noun, ' ') AS Crop, l_quantity AS Area, l_extendedprice AS Production, l_orderkey, l_linenumber
FROM base
"""

_RAIN_MONTHS = """
SELECT r_name AS SUBDIVISION, cast(year(o_orderdate) AS int) AS YEAR, month(o_orderdate) AS m,
       cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) / 100000 AS mm
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE NOT (r_name = 'ASIA' AND year(o_orderdate) = 1997)
GROUP BY r_name, year(o_orderdate), month(o_orderdate)
"""

_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def _month(k: int) -> str:
    return f"max(CASE WHEN m = {k} THEN mm END)"


_RAINFALL = (
    "SELECT SUBDIVISION, YEAR, "
    + ", ".join(f"{_month(k)} AS {name}" for k, name in enumerate(_MONTHS, 1))
    + f", {_month(1)} + {_month(2)} AS JF"
    + f", {_month(3)} + {_month(4)} + {_month(5)} AS MAM"
    + f", {_month(6)} + {_month(7)} + {_month(8)} + {_month(9)} AS JJAS"
    + f", {_month(10)} + {_month(11)} + {_month(12)} AS OND"
    + ", cast(sum(cast(mm AS decimal(18,7))) AS double) AS ANNUAL"
    + " FROM rain_months GROUP BY SUBDIVISION, YEAR"
)

_REQUESTS = """
SELECT c_custkey AS req_id, lower(r_name) AS state, lower(n_name) AS district,
       concat('Brand#', cast(1 + c_custkey % 26 AS string)) AS crop,
       CASE c_custkey % 4 WHEN 0 THEN 'kharif' WHEN 1 THEN 'Rabi ' WHEN 2 THEN 'autumn' ELSE 'nonesuch' END AS season,
       CASE WHEN c_custkey % 50 = 7 THEN 'ten' ELSE cast(c_acctbal / 100 AS string) END AS area,
       c_custkey % 3 <> 0 AS has_rainfall,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE cast(100.0 * (c_custkey % 17) AS double) END AS rainfall,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE cast(3000.0 - 250.0 * (c_custkey % 20) AS double) END AS min_price,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE cast(2000.0 AS double) END AS max_price
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

# Requests that also name a commodity, market, variety and grade, and a price to
# take where no model predicts one.
_FULL_REQUESTS = """
SELECT requests.*,
       CASE WHEN req_id % 5 = 0 THEN NULL ELSE concat(' ', upper(p_name)) END AS commodity,
       CASE WHEN req_id % 3 = 0 THEN concat(upper(district), ' supplier#00000000', cast(req_id % 10 AS string), ' ')
            WHEN req_id % 3 = 1 THEN '' ELSE NULL END AS market,
       CASE WHEN req_id % 4 = 1 THEN lower(concat(' ', p_brand, ' ', p_type)) ELSE NULL END AS variety,
       CASE req_id % 4 WHEN 0 THEN 'large ' WHEN 1 THEN 'unknown' ELSE NULL END AS grade,
       cast((req_id % 300) * 10 AS double) AS given_price
FROM requests LEFT JOIN part ON req_id = p_partkey
"""

_PRICE_FACTS = """
SELECT State, District, concat(District, ' ', s_name) AS Market,
       CASE WHEN l_linenumber <= 3 THEN p_name ELSE p_brand END AS Commodity,
       CASE WHEN p_brand = 'Brand#9' AND p_type = 'STANDARD' THEN 'Brand#9 Local' ELSE concat(p_brand, ' ', p_type) END AS Variety,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'FAQ' WHEN '2-HIGH' THEN 'Large' ELSE 'Medium' END AS Grade,
       Year, Month, mn AS Min_Price, mx AS Max_Price, modal AS Modal_Price
FROM base
"""

_PREDICTION_LOGS = """
SELECT event_id AS id, concat('user_', cast(user_id AS string)) AS username, ts AS timestamp,
       value AS latency_ms, value / 10 AS predicted_yield, value * 20 AS predicted_price, value * value * 20 AS total_value,
       CASE WHEN event_type <> 'error' THEN 'SUCCESS' WHEN event_id % 2 = 0 THEN 'ERROR' ELSE concat('ERROR: ', props) END AS status
FROM events
"""

_AUTH_EVENTS = """
SELECT event_id AS id, concat('user_', cast(user_id AS string)) AS username,
       CASE event_type WHEN 'signup' THEN 'REGISTER' WHEN 'click' THEN 'LOGIN_SUCCESS' WHEN 'error' THEN 'LOGIN_FAILURE' ELSE 'LOGOUT' END AS action,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('10.0.0.', cast(user_id % 256 AS string)) END AS ip_address, ts AS timestamp
FROM events WHERE event_type <> 'purchase'
"""

# Accounts that exist before the access log is read: a part of the customers, so
# that some names of the log are known and others are new.
_USERS = """
SELECT c_custkey AS id, concat('user_', cast(c_custkey AS string)) AS username
FROM customer WHERE c_mktsegment = 'BUILDING'
"""

# name: (views it reads, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "base": ((), _BASE),
    "agri": (("base",), _AGRI),
    "agri_all": (("base",), _AGRI_ALL),
    "agri_raw": (("agri",), _AGRI_RAW),
    "prices": (("base",), _PRICES),
    "production": (("base",), _PRODUCTION),
    "rain_months": ((), _RAIN_MONTHS),
    "rainfall": (("rain_months",), _RAINFALL),
    "requests": ((), _REQUESTS),
    "full_requests": (("requests",), _FULL_REQUESTS),
    "price_facts": (("base",), _PRICE_FACTS),
    "prediction_logs": ((), _PREDICTION_LOGS),
    "auth_events": ((), _AUTH_EVENTS),
    "users": ((), _USERS),
}


def needed(names: list[str], views: dict[str, tuple[tuple[str, ...], str]] = VIEWS) -> list[str]:
    """The named views and all they read, each before its first reader."""
    out: list[str] = []
    for name in names:
        for one in [*needed(list(views[name][0]), views), name]:
            if one not in out:
                out.append(one)
    return out


def with_clause(names: list[str], views: dict[str, tuple[tuple[str, ...], str]] = VIEWS) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({views[n][1].strip()})" for n in needed(names, views))


# The same views over stored rows of ``base``.
STORED_VIEWS = {**VIEWS, "base": ((), "SELECT * FROM stored_base")}


def tables_of(name: str, views: dict[str, tuple[tuple[str, ...], str]] = VIEWS) -> list[str]:
    """Benchmark tables a view reads, directly or through other views."""
    text = " ".join(views[n][1] for n in needed([name], views))
    return [t for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", text)]


def version(spark: SparkSession, path: str) -> tuple[int, int]:
    """Time of the last change and length of a file or folder, for caches by content."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    return status.getModificationTime(), status.getLen()


@lru_cache(maxsize=256)
def _table(spark: SparkSession, path: str, changed: tuple[int, int]) -> DataFrame:
    return spark.read.parquet(path)


def _versions(spark: SparkSession, sf_dir: str, tables: list[str]) -> tuple[tuple[int, int], ...]:
    return tuple(version(spark, f"{sf_dir}/{table}.parquet") for table in tables)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of a folder."""
    for table in tables_of(name):
        path = f"{sf_dir}/{table}.parquet"
        _table(spark, path, version(spark, path)).createOrReplaceTempView(table)
    return spark.sql(f"{with_clause([name])} SELECT * FROM {name}")


def _merged_view(spark: SparkSession, sf_dir: str, name: str, views: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """A view that joins ``part``, which grows with the rows, without sending it through the driver."""
    for table in tables_of(name, views):
        path = f"{sf_dir}/{table}.parquet"
        rows = _table(spark, path, version(spark, path))
        (rows.hint("merge") if table == "part" else rows).createOrReplaceTempView(table)
    return spark.sql(f"{with_clause([name], views)} SELECT * FROM {name}")


@lru_cache(maxsize=4)
def _stored_base(spark: SparkSession, sf_dir: str, changed: tuple[tuple[int, int], ...]) -> DataFrame:
    return materialise(_merged_view(spark, sf_dir, "base", VIEWS))


def stored_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same rows as :func:`view`, for queries that read ``base`` more than once: its tables
    are joined once per session and state of them, and the rows stored."""
    if "base" in needed([name]):
        changed = _versions(spark, sf_dir, tables_of("base"))
        _stored_base(spark, sf_dir, changed).createOrReplaceTempView("stored_base")
    return _merged_view(spark, sf_dir, name, STORED_VIEWS)
