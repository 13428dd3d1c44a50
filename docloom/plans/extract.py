"""Batch extraction with a pluggable callable, hit scoring, studies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_advisory

Answer = Callable[[list[str]], list[str]]


def prompt(instruction: str, item: Column, schema_text: str) -> Column:
    """The question put to the callable for one row."""
    return F.concat(
        F.lit(f"{instruction}\n\nItem:\n"), item,
        F.lit(f"\n\nRespond ONLY with a JSON object matching this schema:\n{schema_text}\n"),
    )


def ask(text: Column, fn: Answer, batch: int = 10) -> Column:
    """Reply and error per row; a failed batch is asked again row by row."""
    @F.pandas_udf("reply string, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            replies: list = []
            errors: list = []
            texts = s.tolist()
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    got = list(fn(part))
                    if len(got) != len(part):
                        raise ValueError("wrong number of replies")
                    replies += got
                    errors += [None] * len(part)
                except Exception:
                    for one in part:
                        try:
                            replies.append(fn([one])[0])
                            errors.append(None)
                        except Exception as e:
                            replies.append(None)
                            errors.append(str(e))
            yield pd.DataFrame({"reply": replies, "error": errors})

    return run(text)


def extract_many(df: DataFrame, instruction: str, schema: str, fn: Answer, item: list[str] | None = None) -> DataFrame:
    """Structured extraction per row: matches, data, confidence, error."""
    payload = F.to_json(F.struct(*(item or df.columns)))
    asked = df.withColumn("_a", ask(prompt(instruction, payload, schema), fn))
    valid = F.try_parse_json(F.trim(F.col("_a.reply"))).isNotNull()
    parsed = F.from_json(F.trim(F.col("_a.reply")), schema)
    ok = F.col("_a.error").isNull() & valid
    return asked.select(
        *df.columns, F.coalesce(ok, F.lit(False)).alias("matches"), F.when(ok, parsed).alias("data"),
        F.when(ok, F.lit(1.0)).alias("confidence"),
        F.when(~ok, F.coalesce("_a.error", F.lit("reply is not valid JSON"))).alias("error"),
    )


def hit_score(url: Column, confidence: Column, version_bound: Column) -> Column:
    """Half for an official page, plus confidence and version evidence."""
    return (
        F.when(is_advisory(url), F.lit(0.5)).otherwise(0.0)
        + F.when(F.coalesce(confidence, F.lit(0.0)) >= 0.75, F.lit(0.3)).otherwise(0.0)
        + F.when(F.coalesce(version_bound, F.lit(False)), F.lit(0.2)).otherwise(0.0)
    )
