"""The seam for models: batches of rows go through a callable, the rest stays in the plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def infer(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply model to batches of df; it gets and returns a pandas frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield model(b)

    return df.mapInPandas(run, schema)


def mock(batch: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in: humorous if the text's length is odd."""
    n = batch["text"].fillna("").str.len()
    return pd.DataFrame({"id": batch["id"], "humorous": n % 2 == 1, "probability": 0.5 + (n % 2 - 0.5) * 0.6})
