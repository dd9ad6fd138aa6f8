"""Extension points: parsers for captures and batch scoring by an injected model function."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ParserRegistry:
    """Named parse functions `(url, body) -> dict | None` that run over captures in Arrow batches."""

    def __init__(self) -> None:
        self.parsers: dict[str, Callable[[str, str], dict | None]] = {}

    def register(self, name: str, fn: Callable[[str, str], dict | None]) -> None:
        self.parsers[name] = fn

    def apply(self, name: str, captures: DataFrame) -> DataFrame:
        """Adds `parsed` (JSON text or null) and `parse_error` (text of a raised exception or null)."""
        fn = self.parsers[name]

        def parse(urls: pd.Series, bodies: pd.Series) -> pd.DataFrame:
            parsed, errors = [], []
            for url, body in zip(urls, bodies):
                try:
                    result = fn(url, body)
                    parsed.append(None if result is None else json.dumps(result))
                    errors.append(None)
                except Exception as exc:  # one bad body must not end the job
                    parsed.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            return pd.DataFrame({"parsed": pd.Series(parsed, dtype=object), "parse_error": pd.Series(errors, dtype=object)})

        shape = T.StructType().add("parsed", T.StringType()).add("parse_error", T.StringType())
        return captures.withColumn("_p", F.pandas_udf(parse, shape)("url", "body")).select("*", "_p.*").drop("_p")


def score_batch(prompts: DataFrame, model: Callable[[list[str]], list[str]], batch_size: int = 32, tasks: int | None = None) -> DataFrame:
    """`item_id, prompt` to `item_id, reply` by a model function over lists of prompts.

    The prompts keep the partitions they come in, or are dealt into `tasks` even ones, so that a lost task repeats little.
    How many call the model at once is the cluster's to bound, by executor cores or task resources. Write the replies
    of a dear model before going on.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), batch_size):
                part = rows.iloc[start : start + batch_size]
                yield pd.DataFrame({"item_id": part["item_id"], "reply": model(list(part["prompt"]))})

    asked = prompts.select("item_id", "prompt")
    asked = asked.repartition(tasks) if tasks else asked
    return asked.mapInPandas(score, "item_id BIGINT, reply STRING")


def score_resumed(prompts: DataFrame, model: Callable[[list[str]], list[str]], path: str, parts: int = 16, callers: int = 8, batch_size: int = 32) -> DataFrame:
    """The replies to all prompts (`item_id, prompt`, ids unique and not null), kept as a table at `path`, which every run completes.

    The prompts are dealt into `parts` by their id; a part's replies are written before the next part is asked, so a run that ends
    early loses one part at most and the next one asks the model only for what has no reply yet. At most `callers` tasks call the
    model at once, each with lists of `batch_size`.
    """
    spark = prompts.sparkSession
    schema = "item_id BIGINT, reply STRING, part INT"
    numbered = prompts.select("item_id", "prompt", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int").alias("part"))
    spark.createDataFrame([], schema).write.mode("append").parquet(path)  # a table without rows, if there is none yet
    done = spark.read.schema(schema).parquet(path)
    for part in range(parts):
        mine = numbered.where(F.col("part") == part)
        todo = mine.join(done.where(F.col("part") == part).select("item_id"), "item_id", "left_anti")
        replies = score_batch(todo, model, batch_size, callers)
        replies.withColumn("part", F.lit(part)).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).select("item_id", "reply")
