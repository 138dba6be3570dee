"""Functions Spark SQL does not have: two Arrow-batched UDFs and a small table function."""

from __future__ import annotations

import math
from itertools import product

import pandas as pd
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from terrane.constants import AMBIGUITY


@F.pandas_udf(DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    return x.map(math.lgamma, na_action="ignore").astype("float64")


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda z: 0.5 * (1.0 + math.erf(z / math.sqrt(2.0))), na_action="ignore").astype("float64")


class ExpandAmbiguous:
    """Rows of the concrete sequences a pattern stands for."""

    def eval(self, pattern: str, kind: str):
        for letters in product(*[AMBIGUITY[kind][c] for c in pattern]):
            yield ("".join(letters),)


def register_sql(spark: SparkSession) -> None:
    """Make ``expand_ambiguous(pattern, kind)``, ``lgamma`` and ``normal_cdf`` known to SQL."""
    spark.udtf.register("expand_ambiguous", F.udtf(ExpandAmbiguous, returnType=StructType([StructField("seq", StringType())])))
    spark.udf.register("lgamma", lgamma)
    spark.udf.register("normal_cdf", normal_cdf)
