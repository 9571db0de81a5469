"""A language model as a function that is handed in: prompts to answers, a batch at a time."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def echo(prompt: str) -> str:
    """A stand-in that needs no model: the same summary for the same prompt."""
    return json.dumps({"short": " ".join(prompt.split())[:60], "full": prompt}, ensure_ascii=False)


def answers(prompt: Column, model: Callable[[str], str] = echo) -> Column:
    """What the model says to each prompt; an exception counts as an answer that begins with ``Error:``, null stays null."""

    def ask(text: str) -> str:
        try:
            return model(text)
        except Exception as e:  # whatever a model raises is its answer
            return f"Error: {type(e).__name__}"

    @F.pandas_udf(StringType())
    def call(prompts: pd.Series) -> pd.Series:
        return prompts.map(ask, na_action="ignore")

    return call(prompt)
