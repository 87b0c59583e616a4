"""Extension points: vectorised functions and table functions that can be registered for SQL."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def register(spark: SparkSession) -> list[str]:
    """Register the functions of this module; returns their names in SQL."""
    @F.pandas_udf("string")
    def full_case_fold(x: pd.Series) -> pd.Series:
        """Unicode case fold where upper and lower don't reach."""
        return x.map(lambda v: v.casefold() if v is not None else None)

    @udtf(returnType="position int, word string")
    class split_words:  # noqa: N801  (its name in SQL)
        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            for k, w in enumerate((text or "").split()):
                yield k, w

    spark.udf.register("full_case_fold", full_case_fold)
    spark.udtf.register("split_words", split_words)
    return ["full_case_fold", "split_words"]
