"""Hooks for models the caller brings: the only operators that run Python in tasks."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollwatch.operators.lists import splittable
from tollwatch.sources.tables import read_or_none

ANSWERS = "digest string, model string, answer string"


def score_batch(prompts, scorer, name="answer", prompt="user_prompt"):
    """Add the answer of ``scorer``, a function from a pandas Series to a Series.

    It gets one Arrow batch at a time; load a model on its first call, so that
    it is loaded once per Python worker.
    """
    return model_compare(prompts, {name: scorer}, prompt)


def model_compare(prompts, scorers, prompt="user_prompt"):
    """Answers of several models side by side, one column per model.

    All models see a batch while it is in memory: no copy of the table per
    model and no pivot. Only the prompt goes to Python.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in scorers])

    @F.pandas_udf(schema)
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for asked in batches:
            yield pd.DataFrame({name: scorer(asked) for name, scorer in scorers.items()})

    scored = prompts.withColumn("_answers", answers(prompt))
    return scored.select(*prompts.columns, "_answers.*")


def score_new(prompts, scorer, store, model, name="answer", prompt="user_prompt"):
    """Add answers of a model, asking it only for prompts it has not answered before.

    ``store`` is a folder of answers by digest of model and prompt, for any
    number of models. Equal prompts are asked once, and what is asked is
    appended, so a later run over the same or more rows asks only for the rest.
    ``model`` names model and version: another name asks anew. Two runs at one
    time may both ask for a prompt, and then the lesser answer counts. A null
    prompt is not asked and has no answer. The call runs the model.
    """
    digest = F.sha2(F.concat(F.lit(model), F.lit("\0"), F.col(prompt)), 256)
    keyed = prompts.withColumn("_digest", digest)
    held = read_or_none(prompts.sparkSession, store, ANSWERS)
    new = keyed.where(F.col(prompt).isNotNull()).groupBy("_digest").agg(F.min(prompt).alias(prompt))
    if held is not None:
        new = new.join(held.select("digest"), splittable("_digest", "digest"), "left_anti")
    asked = score_batch(new, scorer, "answer", prompt).select(
        F.col("_digest").alias("digest"), F.lit(model).alias("model"), "answer")
    asked.write.mode("append").parquet(store)
    answers = read_or_none(prompts.sparkSession, store, ANSWERS).groupBy("digest").agg(
        F.min("answer").alias(name))
    # one prompt may be that of many rows; the side of the answers has it once
    return keyed.join(answers, splittable("_digest", "digest"), "left").select(*prompts.columns, name)
