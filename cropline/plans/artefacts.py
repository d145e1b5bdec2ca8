"""The tables a prediction looks things up in, built once per dataset version."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from cropline.operators.aggregates import (
    category_values,
    district_crops,
    rollup_defaults,
    rollup_trends,
    state_districts,
    vocabulary,
    yearly_rollup,
)
from cropline.session import materialise

YIELD_VOCABULARY = {"state": "State", "crop": "Crop", "season": "Season"}
PRICE_VOCABULARY = {
    "state": "State",
    "district": "District",
    "market": "Market",
    "commodity": "Commodity",
    "variety": "Variety",
    "grade": "Grade",
}
TABLES = ("state_districts", "district_crops", "defaults", "trends", "vocab")


@dataclass(frozen=True)
class Artefacts:
    """Lookup tables; all of them are stored or materialised."""

    state_districts: DataFrame
    district_crops: DataFrame
    defaults: DataFrame
    trends: DataFrame
    vocab: DataFrame | None = None

    @cached_property
    def production_vocab(self) -> DataFrame:
        return self.vocab.filter(F.col("model") == "production")

    @cached_property
    def price_vocab(self) -> DataFrame:
        return self.vocab.filter(F.col("model") == "price")


def fit_vocabulary(agri: DataFrame, prices: DataFrame) -> DataFrame:
    """Categories of both models in one table."""
    production = category_values(agri, YIELD_VOCABULARY, "production")
    return vocabulary(production.unionByName(category_values(prices, PRICE_VOCABULARY, "price")))


def derive_artefacts(agri: DataFrame, vocab: DataFrame | None = None) -> Artefacts:
    """Lookup tables from the facts, which are shuffled once: everything derives
    from their yearly sums."""
    return artefacts_of(materialise(yearly_rollup(agri)), vocab)


def artefacts_of(yearly: DataFrame, vocab: DataFrame | None = None) -> Artefacts:
    """Lookup tables from stored yearly sums."""
    return Artefacts(
        state_districts=state_districts(yearly),
        district_crops=district_crops(yearly),
        defaults=materialise(rollup_defaults(yearly)),
        trends=materialise(rollup_trends(yearly)),
        vocab=None if vocab is None else materialise(vocab),
    )


def build_artefacts(agri: DataFrame, root: str, version: str, vocab: DataFrame | None = None) -> Artefacts:
    """Derive the lookup tables, store them as Parquet and read them back."""
    store_artefacts(derive_artefacts(agri, vocab), root, version)
    return load_artefacts(agri.sparkSession, root, version, with_vocab=vocab is not None)


def store_artefacts(artefacts: Artefacts, root: str, version: str) -> None:
    for name in TABLES:
        table = getattr(artefacts, name)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{root}/version={version}/{name}")


def load_artefacts(spark: SparkSession, root: str, version: str, with_vocab: bool = True) -> Artefacts:
    tables = {
        name: spark.read.parquet(f"{root}/version={version}/{name}")
        for name in TABLES
        if with_vocab or name != "vocab"
    }
    return Artefacts(**tables)
