"""Inputs of the registered queries, read lazily from one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import cleaning, sentiment
from lodestar.session import read_table, spread


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles and floats rounded, without negative zero, NaN as null."""
    out = []
    for n, k in df.dtypes:
        c = F.col(f"`{n}`")
        if k in ("double", "float"):
            c = F.round(F.when(~F.isnan(c), c.cast("double")), digits) + F.lit(0.0)
        out.append(c.alias(n))
    return df.select(*out)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.dir, name)

    def meta(self) -> DataFrame:
        return cleaning.clean_meta(self.raw("meta_clean"))

    def valid(self) -> DataFrame:
        return cleaning.valid_reviews(self.raw("reviews"))

    def reviews(self) -> DataFrame:
        return cleaning.clean_reviews(self.raw("reviews"))

    def scored(self) -> DataFrame:
        return sentiment.score_by_bag(spread(self.reviews()))

    def products(self) -> DataFrame:
        """products_nlp with floats widened, NaN as null."""
        p = self.raw("products_nlp")
        return p.select(*[F.when(~F.isnan(F.col(n)), F.col(n).cast("double")).alias(n) if k in ("float", "double") else F.col(n) for n, k in p.dtypes])
