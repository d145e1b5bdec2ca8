"""One query per operator over the benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import lru_cache, reduce

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession, functions as F

from cropline import schemas
from cropline.functions.constants import RAIN_COLUMNS
from cropline.functions.scalars import order_bounds as ordered, round_even, strip
from cropline.operators import (
    aggregates as A,
    align as L,
    clean as C,
    insights as I,
    matching as J,
    monitor as R,
    scoring as M,
    stats as S,
)
from cropline.operators.keyed import insert_if_absent as insert_new
from cropline.plans.alignment import refresh_partition
from cropline.plans.artefacts import (
    PRICE_VOCABULARY,
    TABLES as ARTEFACT_TABLES,
    Artefacts,
    build_artefacts as store_artefacts,
    derive_artefacts,
    fit_vocabulary,
)
from cropline.plans.incremental import refresh_artefacts as refreshed
from cropline.plans.models import Models, load_models, save_models
from cropline.plans.prediction import encode_price_inputs, predict as score_requests, published
from cropline.plans.views import ALIASES, COLD_STATE, VIEWS, stored_view, tables_of, version, view
from cropline.session import materialise, shared_folder
from cropline.sources import files as IO
from cropline.sources.versions import version_rows, versions
from cropline.streaming import monitor as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = date(2024, 6, 15)
KEY = ["State", "District", "Crop"]
TREES = {"maxIter": 4, "maxDepth": 4}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of places, for comparison with another engine."""
    return df.withColumns({c: round_even(c, digits) for c, kind in df.dtypes if kind == "double"})


# Inputs


def _agri(spark, sf):
    return view(spark, sf, "agri")


def _artefacts(spark, sf) -> Artefacts:
    """Lookup tables, built once per session and state of the tables they come from."""
    tables = {*tables_of("agri"), *tables_of("price_facts")}
    return _built(spark, sf, tuple(version(spark, f"{sf}/{t}.parquet") for t in sorted(tables)))


@lru_cache(maxsize=4)
def _built(spark, sf, changed) -> Artefacts:
    agri = stored_view(spark, sf, "agri")
    return derive_artefacts(agri, fit_vocabulary(agri, stored_view(spark, sf, "price_facts")))


def _keys(spark, sf):
    """Requested keys, upper-cased as the stored ones are."""
    requests = view(spark, sf, "requests")
    return requests.select("req_id", F.upper("state").alias("state"), F.upper("district").alias("district"), "crop")


def _valid(spark, sf):
    checked = C.validate_requests(C.normalise_requests(view(spark, sf, "full_requests"), AS_OF))
    return checked.filter("reason IS NULL")


def _predictions(spark, sf):
    """Predictions from history and given prices."""
    return score_requests(stored_view(spark, sf, "full_requests"), _artefacts(spark, sf), AS_OF)


def _published(spark, sf):
    return I.flatten(published(_predictions(spark, sf)))


def _log(spark, sf):
    return view(spark, sf, "prediction_logs")


def _asia_production(spark, sf):
    production = C.only_state(view(spark, sf, "production"), COLD_STATE, "State_Name")
    clean = C.normalise(production, upper=["District_Name"], plain=["Season", "Crop"])
    return clean.withColumnsRenamed({"District_Name": "District", "Crop_Year": "Year"})


def _asia_rain(spark, sf):
    return view(spark, sf, "rainfall").filter(F.col("SUBDIVISION") == COLD_STATE)


def _asia_prices(spark, sf):
    return C.normalise(
        C.only_state(view(spark, sf, "prices"), COLD_STATE), upper=["District"], lower=["Commodity"]
    )


# Cleaning


@query
def insert_if_absent(spark, sf):
    registered = view(spark, sf, "auth_events").filter("action = 'REGISTER'").select("id", "username")
    return insert_new(view(spark, sf, "users"), registered, "username", ["id"])


@query
def normalise_keys(spark, sf):
    df = C.normalise(
        view(spark, sf, "production"), upper=["State_Name", "District_Name"], plain=["Season", "Crop"]
    )
    return df.select("l_orderkey", "l_linenumber", "State_Name", "District_Name", "Season", "Crop")


@query
def to_numeric(spark, sf):
    return C.to_numeric(view(spark, sf, "agri_raw"), ["Rainfall", "Area", "Production", "Modal_Price", "Year"])


@query
def drop_nulls(spark, sf):
    return rounded(C.drop_nulls(view(spark, sf, "prices"), ["Min_Price", "Max_Price"]))


@query
def only_state(spark, sf):
    df = C.only_state(view(spark, sf, "production"), COLD_STATE, "State_Name")
    return df.select("l_orderkey", "l_linenumber", "State_Name", "Crop")


@query
def filter_contains(spark, sf):
    return rounded(C.filter_contains(view(spark, sf, "prices"), {"State": "asi", "Commodity": "ring"}))


@query
def safe_yield(spark, sf):
    df = _agri(spark, sf).withColumn("yield", C.yield_per_area("Production", "Area"))
    return df.select(*KEY, "Year", "Season", "Area", "Production", round_even("yield", 6).alias("yield"))


@query
def tolerant_parse(spark, sf):
    return rounded(C.parse_agri(view(spark, sf, "agri_raw")))


@query
def zscore_roundtrip(spark, sf):
    prices = view(spark, sf, "prices").select("District", "Year", "Min_Price", "Max_Price")
    features = {"z_min": "min_price", "z_max": "max_price"}
    scaled = C.scale_columns(
        prices.withColumns({"z_min": F.col("Min_Price"), "z_max": F.col("Max_Price")}), features
    )
    back = scaled.withColumns({"back_min": F.col("z_min"), "back_max": F.col("z_max")})
    return rounded(C.unscale_columns(back, {"back_min": "min_price", "back_max": "max_price"}))


@query
def order_bounds(spark, sf):
    low, high = ordered(*[F.coalesce(c, F.lit(0.0)) for c in ("min_price", "max_price")])
    return view(spark, sf, "requests").select("req_id", low.alias("low"), high.alias("high"))


@query
def normalise_requests(spark, sf):
    df = C.normalise_requests(view(spark, sf, "full_requests"), AS_OF)
    return df.select(
        "req_id", "state", "district", "crop", "season", "commodity", "area", "year", "month", "has_rainfall"
    )


@query
def validate_requests(spark, sf):
    df = C.validate_requests(C.normalise_requests(view(spark, sf, "requests"), AS_OF))
    return df.select("req_id", "reason", round_even("area", 6).alias("area"))


@query
def resolve_inputs(spark, sf):
    df = C.resolve_inputs(_valid(spark, sf), _artefacts(spark, sf).defaults)
    values = [f"{c}_{kind}" for c in ("rainfall", "min_price", "max_price") for kind in ("raw", "scaled")]
    return rounded(df.select("req_id", "has_history", *values))


@query
def standardise(spark, sf):
    df = C.standardise(_agri(spark, sf), "Modal_Price", "z")
    return rounded(df.select(*KEY, "Year", "Season", "Modal_Price", "z"))


# Joins


@query
def join_rainfall(spark, sf):
    df = S.join_rainfall(_agri(spark, sf), view(spark, sf, "rainfall"))
    return rounded(df.select(*KEY, "Year", "Season", "sub_clean", "Rainfall", *RAIN_COLUMNS))


@query
def join_prices(spark, sf):
    means = A.price_means_by_district(view(spark, sf, "prices"))
    df = S.join_prices(_agri(spark, sf), means)
    return rounded(
        df.select(*KEY, "Year", "Season", "Min_Price_x", "Max_Price_x", "Min_Price_y", "Max_Price_y")
    )


@query
def lookup_defaults(spark, sf):
    df = C.resolve_inputs(
        C.normalise_requests(view(spark, sf, "requests").drop("rainfall", "has_rainfall", "min_price", "max_price"), AS_OF),
        _artefacts(spark, sf).defaults,
    )
    return df.select("req_id", "has_history", "rainfall_scaled", *[f"{c}_price_scaled" for c in ("min", "max")])


@query
def match_category(spark, sf):
    df, vocab = view(spark, sf, "requests"), _artefacts(spark, sf).production_vocab
    for c in ("state", "crop", "season"):
        df = J.match_category(df, vocab, c)
    return df.select("req_id", "state_value", "crop_value", "season_value")


@query
def match_either(spark, sf):
    df = C.normalise_requests(view(spark, sf, "full_requests"), AS_OF)
    df = J.match_either(df, _artefacts(spark, sf).price_vocab, "commodity", "crop", "commodity", "matched")
    return df.select("req_id", "matched_value", "matched_code")


@query
def market_for_district(spark, sf):
    df = J.match_contains(view(spark, sf, "requests"), _artefacts(spark, sf).price_vocab, "district", "market", "market")
    return df.select("req_id", "district", "market")


@query
def variety_for_crop(spark, sf):
    vocab = _artefacts(spark, sf).price_vocab
    df = J.match_contains(view(spark, sf, "requests"), vocab, "crop", "variety", "variety", "local")
    return df.select("req_id", "crop", "variety")


@query
def preferred_grade(spark, sf):
    vocab = _artefacts(spark, sf).price_vocab
    df = view(spark, sf, "requests").select("req_id")
    return df.withColumn("grade", J.preferred(vocab, "grade", "FAQ"))


@query
def expand_aliases(spark, sf):
    production = C.normalise(view(spark, sf, "production"), plain=["Crop"])
    return L.expand_aliases(production, ALIASES).select("l_orderkey", "l_linenumber", "Crop", "priority", "alias")


@query
def price_fallback(spark, sf):
    means = materialise(A.price_means(_asia_prices(spark, sf)))
    return rounded(L.price_fallback(_asia_production(spark, sf), means, ALIASES))


@query
def rainfall_for_season(spark, sf):
    df = L.rainfall_for(_asia_production(spark, sf), _asia_rain(spark, sf))
    return rounded(df.select("l_orderkey", "l_linenumber", "Year", "Season", "rain_column", "rain_mm"))


@query
def rain_means(spark, sf):
    return rounded(L.rain_means(_asia_rain(spark, sf)))


@query
def region_lookup(spark, sf):
    meta = materialise(A.metadata(stored_view(spark, sf, "agri"), _artefacts(spark, sf).production_vocab))
    states = J.regions(meta).select(F.lit("states").alias("selector"), "value")
    districts = J.regions(meta, COLD_STATE).select(F.lit("districts").alias("selector"), "value")
    crops = J.regions(meta, "AFRICA", "NATION_5").select(F.lit("crops").alias("selector"), "value")
    seasons = J.selector_values(meta).select(F.lit("seasons").alias("selector"), "value")
    return states.unionByName(districts).unionByName(crops).unionByName(seasons)


# Aggregates


@query
def state_districts(spark, sf):
    return A.explode_list(A.state_districts(_agri(spark, sf)), "districts", "District")


@query
def district_crops(spark, sf):
    return A.explode_list(A.district_crops(_agri(spark, sf)), "crops", "Crop")


@query
def vocabulary(spark, sf):
    return fit_vocabulary(_agri(spark, sf), view(spark, sf, "price_facts"))


@query
def metadata(spark, sf):
    agri = _agri(spark, sf)
    return A.metadata(agri, fit_vocabulary(agri, view(spark, sf, "price_facts")))


@query
def crop_defaults(spark, sf):
    return A.crop_defaults(_agri(spark, sf))


@query
def crop_defaults_all(spark, sf):
    return A.crop_defaults(view(spark, sf, "agri_all"))


@query
def crop_trends_all(spark, sf):
    return A.crop_trends(view(spark, sf, "agri_all"))


@query
def crop_trends(spark, sf):
    return A.crop_trends(_agri(spark, sf))


@query
def crop_trends_tolerant(spark, sf):
    return A.crop_trends(C.parse_agri(view(spark, sf, "agri_raw")))


@query
def nested_trends(spark, sf):
    nested = A.nest_trends(A.crop_trends(_agri(spark, sf)))
    return nested.select(*KEY, F.posexplode("historical_trend").alias("ordinal", "point")).select(
        *KEY, "ordinal", "point.*"
    )


@query
def artefact_defaults(spark, sf):
    return A.rollup_defaults(A.yearly_rollup(_agri(spark, sf)))


@query
def artefact_trends(spark, sf):
    return A.rollup_trends(A.yearly_rollup(_agri(spark, sf)))


@query
def defaults_fallback(spark, sf):
    return A.defaults_with_fallback(_keys(spark, sf), _artefacts(spark, sf).defaults)


@query
def region_defaults(spark, sf):
    return A.region_defaults(_keys(spark, sf), _artefacts(spark, sf).defaults, _artefacts(spark, sf).price_vocab)


@query
def price_means(spark, sf):
    prices = C.normalise(view(spark, sf, "prices"), upper=["District"], lower=["Commodity"])
    return rounded(A.price_means(prices))


@query
def price_by_district_year(spark, sf):
    return rounded(A.price_means_by_district(view(spark, sf, "prices")))


@query
def commodity_averages(spark, sf):
    filters = {"State": "america", "District": "nation_1"}
    return rounded(A.commodity_averages(view(spark, sf, "prices"), filters))


@query
def region_averages(spark, sf):
    return rounded(A.region_averages(view(spark, sf, "prices"), {"State": "america", "District": "nation_1"}))


@query
def global_moments(spark, sf):
    return rounded(S.global_moments(view(spark, sf, "prices")))


@query
def column_stats(spark, sf):
    return rounded(S.column_stats(_agri(spark, sf), ["Rainfall", "Min_Price", "Max_Price", "Modal_Price", "Humidity"]))


@query
def describe_difference(spark, sf):
    return rounded(S.describe_difference(_agri(spark, sf), "Min_Price", "Modal_Price"))


@query
def price_correlations(spark, sf):
    pairs = [("Modal_Price", "Min_Price"), ("Modal_Price", "Max_Price"), ("Min_Price", "Max_Price")]
    return rounded(S.correlations(_agri(spark, sf), pairs))


@query
def rank_correlations(spark, sf):
    return rounded(S.rank_rainfall(_agri(spark, sf), view(spark, sf, "rainfall")))


@query
def best_rain_column(spark, sf):
    best = S.best_rainfall(_agri(spark, sf), view(spark, sf, "rainfall"))
    return rounded(best.select("Season", "column", "correlation"))


@query
def fit_scale(spark, sf):
    means = A.price_means_by_district(view(spark, sf, "prices"))
    return rounded(S.fit_price_scale(_agri(spark, sf), means))


@query
def fit_rain_scale(spark, sf):
    return rounded(S.best_rainfall(_agri(spark, sf), view(spark, sf, "rainfall")).filter("n > 5"))


@query
def fallback_yield(spark, sf):
    df = A.fallback_yield(_valid(spark, sf), _artefacts(spark, sf).trends, (COLD_STATE,))
    return rounded(df.select("req_id", "avg_yield_ha", "yield_level", "predicted_yield"))


@query
def shape_counts(spark, sf):
    return A.group_counts(A.season_of(_agri(spark, sf)), ["State", "Season"])


# Windows, top-k and sets


@query
def sample_pairs(spark, sf):
    joined = S.join_rainfall(_agri(spark, sf), view(spark, sf, "rainfall")).withColumn("Season", strip("Season"))
    order = ["Year", "sub_clean", "District", "Crop", "Production", "Rainfall"]
    rows = joined.select("Season", *order, "JJAS", "ANNUAL")
    return rounded(S.sample_pairs(rows, order))


@query
def normalise_series(spark, sf):
    return rounded(I.normalise_series(A.crop_trends(_agri(spark, sf))))


@query
def trend_endpoints(spark, sf):
    return I.trend_endpoints(A.crop_trends(_agri(spark, sf)))


@query
def recent_predictions(spark, sf):
    return rounded(R.recent(_log(spark, sf), 10))


@query
def recent_auth(spark, sf):
    return R.recent(view(spark, sf, "auth_events"), 10)


@query
def latency_history(spark, sf):
    return R.latency_history(_log(spark, sf), 20)


@query
def distinct_head(spark, sf):
    return S.distinct_head(_agri(spark, sf), "SUBDIVISION", 5)


@query
def head(spark, sf):
    prices = C.filter_contains(view(spark, sf, "prices"), {"State": "america", "District": "nation_1"})
    order = ["Commodity", "Market", "Year", "Month", "Modal_Price", "Min_Price", "Max_Price"]
    return rounded(S.head(prices, 10, order))


@query
def replace_state(spark, sf):
    base = _agri(spark, sf)
    base = base.withColumn("State", F.when(F.col("Season") != "Autumn     ", F.col("State")))
    new = _asia_production(spark, sf).select(
        F.lit(COLD_STATE).alias("State"), "District", "Year", "Season", "Crop", "Area", "Production"
    )
    return rounded(L.replace_state(base, new, COLD_STATE))


# Scoring


@query
def ordinal_encode(spark, sf):
    df = C.normalise_requests(view(spark, sf, "full_requests"), AS_OF)
    vocab = _artefacts(spark, sf).price_vocab
    df = df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("market", "variety", "grade")})
    coded = encode_price_inputs(df, vocab)
    return coded.select("req_id", *[f"{c}_code" for c in PRICE_VOCABULARY])


def _models(spark, sf, artefacts):
    yields = M.fit_yield(stored_view(spark, sf, "agri"), artefacts.production_vocab, **TREES)
    prices = M.fit_price(stored_view(spark, sf, "price_facts"), artefacts.price_vocab, **TREES)
    return yields, prices


def _coded(rows: DataFrame, features: list[str], *others: str) -> DataFrame:
    """Training rows with the named columns, stored: they are encoded once for fitting and scoring."""
    return materialise(rows.select(*{c.lower(): c for c in (*features, *others)}.values()))


def _yield_rows(spark, sf, *others: str) -> DataFrame:
    rows = M.yield_training_rows(stored_view(spark, sf, "agri"), _artefacts(spark, sf).production_vocab)
    return _coded(rows, M.YIELD_FEATURES, "Production", *others)


def _price_rows(spark, sf, *others: str) -> DataFrame:
    rows = M.price_training_rows(stored_view(spark, sf, "price_facts"), _artefacts(spark, sf).price_vocab)
    return _coded(rows, M.PRICE_FEATURES, "Modal_Price", *others)


@query
def score_yield(spark, sf):
    rows = _yield_rows(spark, sf, "state", "District", "crop", "season", "Year")
    scored = M.score_yield(rows, M.fit_yield(rows, None, **TREES))
    return scored.select("state", "District", "crop", "season", "Year", "area", "Production", "predicted_yield")


@query
def score_price(spark, sf):
    rows = _price_rows(spark, sf, "state", "market", "commodity", "Year", "Month")
    scored = M.score_price(rows, M.fit_price(rows, None, **TREES))
    return scored.select("state", "market", "commodity", "Year", "Month", "Modal_Price", "predicted_price")


@query
def score_direct(spark, sf):
    rows = _price_rows(spark, sf, "state", "market", "commodity", "Year", "Month", "Min_Price", "Max_Price")
    model = M.fit_price(rows, None, **TREES)
    chosen = rows.withColumnsRenamed({"Min_Price": "min_price", "Max_Price": "max_price"})
    scored = M.score_price(chosen, model, scaled=False)
    return scored.select("state", "market", "commodity", "Year", "Month", "predicted_price")


@query
def fit_models(spark, sf):
    """How the fitted models explain their training rows, by as many trees as the trainer grows of its own."""
    agri, facts = _yield_rows(spark, sf), _price_rows(spark, sf)
    agri = M.score_yield(agri, M.fit_yield(agri, None))
    facts = M.score_price(facts, M.fit_price(facts, None))
    found = S.r2(agri, "Production", "predicted_yield").withColumn("model", F.lit("yield"))
    return found.unionByName(S.r2(facts, "Modal_Price", "predicted_price").withColumn("model", F.lit("price")))


@query
def fit_r2(spark, sf):
    fitted = _agri(spark, sf).withColumn("fitted", F.col("Area") * 1500.0 + F.col("Modal_Price"))
    return rounded(S.r2(fitted, "Production", "fitted"))


@query
def valuation(spark, sf):
    df = _predictions(spark, sf).select("req_id", "predicted_yield", "predicted_price")
    return rounded(M.valuation(df), 4)


@query
def confidence(spark, sf):
    return M.confidence(_keys(spark, sf), _artefacts(spark, sf).defaults).select("req_id", "confidence_rating")


@query
def synthetic_history(spark, sf):
    df = _predictions(spark, sf).filter("reason IS NULL")
    points = df.select("req_id", F.posexplode("historical_trend").alias("ordinal", "point"))
    return points.select("req_id", "ordinal", "point.*")


@query
def predict_fallback(spark, sf):
    df = published(_predictions(spark, sf)).drop("historical_trend", "latency_ms")
    return df.select("*", "inputs_used.*").drop("inputs_used")


@query
def predict(spark, sf):
    artefacts = _artefacts(spark, sf)
    yields, prices = _models(spark, sf, artefacts)
    requests = stored_view(spark, sf, "full_requests")
    scored = published(score_requests(requests, artefacts, AS_OF, yields, prices, (COLD_STATE,)))
    return scored.select("*", "inputs_used.*", F.size("historical_trend").alias("trend_points")).drop(
        "inputs_used", "historical_trend"
    )


@query
def prediction_log(spark, sf):
    df = M.prediction_log_rows(_predictions(spark, sf))
    fields = ["crop", "state", "district", "season", "area", "rainfall", "status"]
    return rounded(df.select("req_id", *fields, "predicted_yield", "predicted_price", "total_value"), 4)


@query
def rejected_requests(spark, sf):
    return M.rejected_requests(_predictions(spark, sf))


def _fixed_tree(text: str) -> SQLTransformer:
    """A model with known arithmetic, in place of a fitted one."""
    return SQLTransformer(statement=f"SELECT *, cast({text} AS double) AS prediction FROM __THIS__")


YIELD_TREE = """CASE WHEN crop_code < 8 THEN CASE WHEN area < 20 THEN 100.0 + state_code ELSE 250.0 + 10 * season_code END
WHEN rainfall_scaled < 0 THEN -5.0 ELSE 40.5 * area END"""
PRICE_TREE = """CASE WHEN grade_code > 0 THEN 1000.0 + 7 * district_code + month
WHEN min_price_scaled < 0 THEN 100 * max_price_scaled ELSE 900.5 + variety_code + year END"""


@query
def score_yield_fixed(spark, sf):
    rows = M.yield_training_rows(stored_view(spark, sf, "agri"), _artefacts(spark, sf).production_vocab)
    scored = M.score_yield(rows, _fixed_tree(YIELD_TREE))
    return rounded(scored.select("state", "District", "crop", "season", "Year", "area", "Production", "predicted_yield"))


_PRICED = ["state", "market", "commodity", "Year", "Month", "Modal_Price", "predicted_price"]


@query
def score_price_fixed(spark, sf):
    rows = M.price_training_rows(stored_view(spark, sf, "price_facts"), _artefacts(spark, sf).price_vocab)
    return rounded(M.score_price(rows, _fixed_tree(PRICE_TREE)).select(*_PRICED))


@query
def score_direct_fixed(spark, sf):
    rows = M.price_training_rows(stored_view(spark, sf, "price_facts"), _artefacts(spark, sf).price_vocab)
    chosen = rows.withColumnsRenamed({"Min_Price": "min_price", "Max_Price": "max_price"})
    return rounded(M.score_price(chosen, _fixed_tree(PRICE_TREE), scaled=False).select(*_PRICED))


def _stored(spark, models: Models, vocab) -> Models:
    """The models, written and loaded again."""
    root = _trip(spark)
    save_models(models, vocab, root, "1")
    return load_models(spark, vocab, root, "1")


@query
def score_yield_saved(spark, sf):
    """As ``score_yield_fixed``, by a stored model."""
    vocab = _artefacts(spark, sf).vocab
    model = _stored(spark, Models(_fixed_tree(YIELD_TREE), _fixed_tree(PRICE_TREE)), vocab).yields
    scored = M.score_yield(M.yield_training_rows(stored_view(spark, sf, "agri"), vocab.filter("model = 'production'")), model)
    return rounded(scored.select("state", "District", "crop", "season", "Year", "area", "Production", "predicted_yield"))


@query
def saved_models(spark, sf):
    """Rows that stored models score as the fitted ones in memory do."""
    artefacts = _artefacts(spark, sf)
    agri, facts = _yield_rows(spark, sf), _price_rows(spark, sf)
    fitted = Models(M.fit_yield(agri, None, **TREES), M.fit_price(facts, None, **TREES))
    loaded = _stored(spark, fitted, artefacts.vocab)
    parts = []
    for name, score, rows, first, second in (
        ("yield", M.score_yield, agri, fitted.yields, loaded.yields),
        ("price", M.score_price, facts, fitted.prices, loaded.prices),
    ):
        out = f"predicted_{name}"
        both = score(score(rows, first).withColumnRenamed(out, "in_memory"), second)
        same = F.count_if(F.col(out).eqNullSafe(F.col("in_memory")))
        parts.append(both.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), same.alias("same")))
    return parts[0].unionByName(parts[1])


@query
def fit_models_facts(spark, sf):
    """What holds for the fitted models whatever the trees are."""
    order = {"yield": M.YIELD_FEATURES, "price": M.PRICE_FEATURES}
    names = F.create_map(*[x for m, f in order.items() for x in (F.lit(m), F.lit(",".join(f)))])
    found = QUERIES["fit_models"](spark, sf)
    return found.select("model", "n", names[F.col("model")].alias("features"), (F.col("r2") > 0).alias("explains"))


@query
def predict_contract(spark, sf):
    """What holds for predictions whatever the trees are."""
    artefacts = _artefacts(spark, sf)
    scored = score_requests(
        stored_view(spark, sf, "full_requests"), artefacts, AS_OF, *_models(spark, sf, artefacts), (COLD_STATE,)
    ).filter("reason IS NULL")
    value = F.col("predicted_yield") * F.col("predicted_price") * 10
    return scored.select(
        "req_id", "crop", "state", "district", "season", "market", "variety", "grade",
        M.confidence_rating(F.col("has_history")).alias("confidence_rating"),
        F.size("historical_trend").alias("trend_points"),
        F.when(F.col("state") == COLD_STATE, round_even("predicted_yield", 2)).alias("cold_yield"),
        ((F.col("predicted_yield") >= 0) & (F.col("predicted_price") >= 0)).alias("not_negative"),
        (F.abs(F.col("total_value") - value) <= 1e-9 * F.abs(value)).alias("value_fits"),
    )


# Sources and sinks


def _trip(spark) -> str:
    return f"{shared_folder(spark)}/trip-{uuid.uuid4().hex}"


def _write_csv(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> str:
    writer = df.write.option("header", True).option("emptyValue", "").partitionBy(*by)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _write_years(prices: DataFrame, changes: list[Callable[[DataFrame], DataFrame]] | None = None, parts: int = 64) -> str:
    """Headed files named after their year, as the price files come, several of a large year.

    Each of ``changes`` gets the years that leave its number when divided by theirs.
    """
    spark, folder = prices.sparkSession, _trip(prices.sparkSession)
    stored = materialise(prices) if changes else prices
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(f"{folder}/years"))
    for n, change in enumerate(changes or [lambda rows: rows]):
        rows = stored.filter(F.coalesce(F.col("Year") % len(changes), F.lit(0)) == n) if changes else stored
        part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
        written = _write_csv(change(rows.repartition("Year", part)), f"{folder}/parts/{n}", ("Year",))
        for i, file in enumerate(system.globStatus(path(f"{written}/Year=*/part-*"))):
            year = file.getPath().getParent().getName().removeprefix("Year=").replace("__HIVE_DEFAULT_PARTITION__", "none")
            system.rename(file.getPath(), path(f"{folder}/years/{year}.{i}.csv"))
    return f"{folder}/years/*.csv"


@query
def read_agri(spark, sf):
    return rounded(IO.read_agri(spark, _write_csv(_agri(spark, sf), _trip(spark))))


@query
def publish_agri(spark, sf):
    return rounded(IO.read_agri(spark, IO.publish_agri(_agri(spark, sf), _trip(spark), "1")))


@query
def publish_states(spark, sf):
    """The facts by state, with one state written again, read back whole."""
    agri, path = stored_view(spark, sf, "agri"), _trip(spark)
    IO.publish_states(agri, path)
    IO.publish_states(agri.filter(F.col("State") == "AFRICA"), path)
    return rounded(IO.read_states(spark, path))


@query
def state_versions(spark, sf):
    """Both versions of the facts, the second with half of one state, read after it was committed."""
    agri, path = stored_view(spark, sf, "agri"), _trip(spark)
    IO.publish_states(agri, path)
    half = IO.read_states(spark, path).filter((F.col("State") == "AFRICA") & (F.col("Year") % 2 == 0))
    IO.publish_states(half, path)
    both = [IO.read_states(spark, path, n).drop(IO.STATE_KEY).withColumn("version", F.lit(n)) for n in (1, 2)]
    return rounded(both[0].unionByName(both[1]))


@query
def publish_prices(spark, sf):
    return rounded(IO.read_published_prices(spark, IO.publish_prices(stored_view(spark, sf, "prices"), _trip(spark))))


@query
def read_prices(spark, sf):
    return rounded(IO.read_prices(spark, _write_years(view(spark, sf, "prices"))))


@query
def read_prices_pruned(spark, sf):
    path = _write_years(view(spark, sf, "prices"))
    return rounded(IO.read_prices(spark, path, ["State", "Year", "Modal_Price"]))


@query
def union_years(spark, sf):
    """Yearly files with their columns in another order, one more and one less."""

    changes = [
        lambda rows: rows.select(*reversed(rows.columns)),
        lambda rows: rows.drop("Market"),
        lambda rows: rows.withColumn("Arrivals", F.lit("7")),
    ]
    return rounded(IO.read_prices(spark, _write_years(view(spark, sf, "prices"), changes)))


@query
def read_rainfall(spark, sf):
    return rounded(IO.read_rainfall(spark, _write_csv(view(spark, sf, "rainfall"), _trip(spark))))


@query
def read_production(spark, sf):
    return rounded(IO.read_production(spark, _write_csv(view(spark, sf, "production"), _trip(spark))))


@query
def discover_columns(spark, sf):
    """Key columns of the price table, with their number of values."""
    prices = view(spark, sf, "prices")
    found = [
        F.struct(F.lit(role).alias("role"), F.lit(names[0]).alias("column"), F.count(names[0]).alias("n"))
        for role, names in IO.discover_columns(prices).items()
    ]
    return prices.agg(F.array(*found).alias("found")).select(F.inline("found"))


@query
def append_predictions(spark, sf):
    """Two batches appended to one log."""
    rows = M.prediction_log_rows(_predictions(spark, sf)).withColumns(
        {"id": F.col("req_id"), "username": F.lit("ada"), "timestamp": F.lit("2024-06-15 10:00:00").cast("timestamp")}
    )
    path = _trip(spark)
    for half in (0, 1):
        IO.append_predictions(rows.filter(F.col("id") % 2 == half), path)
    shown = ["id", "username", "crop", "state", "district", "season", "area", "predicted_yield", "predicted_price", "status"]
    return rounded(IO.read_log(spark, path).select(*shown, "date"), 4)


@query
def append_auth_events(spark, sf):
    path = _trip(spark)
    IO.append_auth_events(view(spark, sf, "auth_events"), path)
    log = IO.read_log(spark, path, schemas.AUTH_EVENTS)
    return log.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query
def refresh_state(spark, sf):
    """One state of the published facts replaced, the others left."""
    path = IO.publish_states(stored_view(spark, sf, "agri"), _trip(spark))
    refresh_partition(
        path, stored_view(spark, sf, "production"), stored_view(spark, sf, "prices"), view(spark, sf, "rainfall"),
        COLD_STATE, COLD_STATE, ALIASES,
    )
    return rounded(IO.read_states(spark, path).drop(IO.STATE_KEY))


@query
def refresh_shape(spark, sf):
    """Rows and columns before and after one state was replaced, as the writes counted them."""
    path = IO.publish_states(stored_view(spark, sf, "agri"), _trip(spark))
    refresh_partition(
        path, stored_view(spark, sf, "production"), stored_view(spark, sf, "prices"), view(spark, sf, "rainfall"),
        COLD_STATE, COLD_STATE, ALIASES,
    )
    shapes = [(n, version_rows(spark, path, n), len(schemas.AGRI)) for n in versions(spark, path)]
    return spark.createDataFrame(shapes, "version int, rows long, columns int")


@query
def refresh_artefacts(spark, sf):
    """Defaults and trends after one state of the facts was replaced, from that state's rows alone."""
    path, root = IO.publish_states(stored_view(spark, sf, "agri"), _trip(spark)), _trip(spark)
    refreshed(spark, path, root)
    refresh_partition(
        path, stored_view(spark, sf, "production"), stored_view(spark, sf, "prices"), view(spark, sf, "rainfall"),
        COLD_STATE, COLD_STATE, ALIASES,
    )
    found = refreshed(spark, path, root)
    none = F.lit(None)
    defaults = found.defaults.select(
        F.lit("defaults").alias("artefact"), *KEY, none.cast("int").alias("year"),
        F.col("rainfall").alias("a"), F.col("min_price").alias("b"), F.col("max_price").alias("c"),
    )
    trends = found.trends.select(
        F.lit("trends").alias("artefact"), *KEY, "year", F.col("yield").alias("a"), F.col("price").alias("b"),
        none.cast("double").alias("c"),
    )
    return defaults.unionByName(trends)


# Insights


@query
def confidence_bounds(spark, sf):
    df = I.confidence_bounds(_published(spark, sf))
    return rounded(df.select("req_id", "price_low", "price_high", "revenue_low", "revenue_high"), 4)


@query
def rainfall_class(spark, sf):
    return _agri(spark, sf).select(*KEY, "Year", "Season", I.rainfall_class("Rainfall").alias("rainfall_class"))


@query
def rainfall_narrative(spark, sf):
    df = materialise(_published(spark, sf))
    both = [I.narratives(df, m).withColumn("mode", F.lit(m)) for m in ("plain", "technical")]
    return both[0].unionByName(both[1]).select("req_id", "mode", "rainfall_narrative", "explanation")


@query
def market_trend(spark, sf):
    return I.market_trend(_published(spark, sf)).select("req_id", "market_trend")


@query
def influence_weights(spark, sf):
    df = I.influence_weights(_published(spark, sf))
    return df.select("req_id", "area_weight", "rain_weight", "base_weight")


@query
def influence_labels(spark, sf):
    df = I.influence_labels(I.influence_weights(_published(spark, sf)))
    return df.select("req_id", "area_influence", "rain_influence", "base_influence")


@query
def log_classes(spark, sf):
    log = R.log_classes(_log(spark, sf)).select(
        F.lit("prediction").alias("log"), "id", F.col("status_label").alias("label"), "row_class",
        F.lit(None).cast("string").alias("address"),
    )
    auth = R.log_classes(view(spark, sf, "auth_events")).select(
        F.lit("auth").alias("log"), "id", F.col("action").alias("label"), "row_class", "address"
    )
    return log.unionByName(auth)


@query
def valuation_report(spark, sf):
    return I.valuation_report(_published(spark, sf).drop("latency_ms"), "plain")


@query
def valuation_report_technical(spark, sf):
    return I.valuation_report(_published(spark, sf).drop("latency_ms"), "technical")


# Pipelines


@query
def build_artefacts(spark, sf):
    """Builds and stores all lookup tables, without the tables of the session."""
    agri, root = stored_view(spark, sf, "agri"), f"{shared_folder(spark)}/artefacts-{uuid.uuid4().hex}"
    built = store_artefacts(agri, root, "1", fit_vocabulary(agri, stored_view(spark, sf, "price_facts")))
    sizes = [
        getattr(built, name).agg(F.lit(name).alias("artefact"), F.count(F.lit(1)).alias("rows"))
        for name in ARTEFACT_TABLES
    ]
    return reduce(DataFrame.unionByName, sizes)


@query
def align_state(spark, sf):
    df = L.align_state(
        stored_view(spark, sf, "production"), stored_view(spark, sf, "prices"), view(spark, sf, "rainfall"),
        COLD_STATE, COLD_STATE, ALIASES,
    )
    return rounded(df)


@query
def monitor_summary(spark, sf):
    return R.monitor_summary(_log(spark, sf))


@query
def monitor_summary_prefix(spark, sf):
    return R.monitor_summary(_log(spark, sf), prefix=True)


@query
def monitoring(spark, sf):
    return R.monitoring(_log(spark, sf), view(spark, sf, "auth_events"))


def _without_zone(windows: DataFrame) -> DataFrame:
    return windows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query
def monitor_windows(spark, sf):
    return _without_zone(T.monitor_windows(_log(spark, sf)))


@query
def monitor_stream(spark, sf):
    """The events file as a stream; returns the windows the stream has closed."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    events.createOrReplaceTempView("event_stream")
    log = spark.sql(VIEWS["prediction_logs"][1].replace("FROM events", "FROM event_stream"))
    run = f"{shared_folder(spark)}/monitor-{uuid.uuid4().hex}"
    T.write_windows(T.monitor_stream(log), f"{run}/windows", f"{run}/checkpoint").awaitTermination()
    return _without_zone(spark.read.parquet(f"{run}/windows"))


@query
def stream_report(spark, sf):
    """The report kept of a log that arrives in several micro-batches, by day."""
    run = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    log = view(spark, sf, "prediction_logs")
    names = [f.name for f in schemas.PREDICTION_LOG if f.name in log.columns]
    rows = log.select(*names).withColumn("day", F.to_date("timestamp"))
    rows.write.partitionBy("day").parquet(f"{run}/log")
    layout = rows.drop("day").schema
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 8).parquet(f"{run}/log/day=*").select(*names)
    T.keep_report(stream, f"{run}/state", f"{run}/checkpoint").awaitTermination()
    return T.kept_report(spark, f"{run}/state")
