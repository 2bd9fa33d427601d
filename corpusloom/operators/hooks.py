"""User-supplied inference inside Spark: batches in, one result or one error per row out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.routing import Channel, with_channel, with_channels
from ..functions.strings import is_blank
from ..functions.text import is_speech, strip_speech_tags
from ..functions.verdicts import error_class

# Builds the model once per Python worker task and returns the batch function.
Loader = Callable[[], Callable[[Sequence[str]], Sequence[str]]]


def map_texts(
    df: DataFrame, column: str, loader: Loader, batch_size: int = 2, result: str = "result"
) -> DataFrame:
    """Run a batch function over one text column; adds `result` and `error_message`.

    The function must return one result per input. A wrong count or an exception fails only
    the rows of that batch, never the job.
    """
    schema = StructType(
        [*df.schema.fields, StructField(result, StringType()), StructField("error_message", StringType())]
    )
    columns = df.columns

    def run(batches):
        model, setup_error = None, ""
        try:
            model = loader()
        except Exception as exc:
            setup_error = f"{type(exc).__name__}: {exc}"
        for frame in batches:
            results, errors = [], []
            values = list(frame[column])
            for at in range(0, len(values), max(1, batch_size)):
                batch = values[at : at + max(1, batch_size)]
                try:
                    if model is None:
                        raise RuntimeError(setup_error)
                    out = list(model(batch))
                    if len(out) != len(batch):
                        raise RuntimeError(f"{len(batch)} inputs gave {len(out)} results")
                    results += [None if o is None else str(o) for o in out]
                    errors += [""] * len(batch)
                except Exception as exc:
                    results += [None] * len(batch)
                    errors += [f"{type(exc).__name__}: {exc}"] * len(batch)
            yield pd.DataFrame({**{c: frame[c] for c in columns}, result: results, "error_message": errors})

    return df.mapInPandas(run, schema)


def infer_segments(chunks: DataFrame, column: str, loader: Loader, batch_size: int = 2) -> tuple[DataFrame, DataFrame]:
    """(segments, failures): speech texts cleaned of tags; silent chunks are dropped."""
    out = map_texts(chunks, column, loader, batch_size, "text")
    clean = out.withColumn("text", strip_speech_tags(F.col("text")))
    good = clean.where(F.col("error_message") == "")
    segments = good.where(is_speech(F.col("text")) & ~is_blank(F.col("text"))).drop("error_message")
    failed = out.where(F.col("error_message") != "").withColumn(
        "error_code", error_class(F.col("error_message"))["code"]
    )
    return segments, failed


def route_with(df: DataFrame, reference: str, extra: Sequence[Channel]) -> DataFrame:
    """Classify with the caller's own channels; their rank decides, not their registration order."""
    return with_channel(df, reference, channels=with_channels(extra))
