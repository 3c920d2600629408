"""Applying a caller-supplied model and scorer in batches.

Models stay outside: the caller passes ``make_fn`` (loads the model once per
Python worker and returns a function over numpy batches), and Spark streams
Arrow batches of ``batch_size`` rows through it with ``predict_batch_udf``.
Outputs are aligned to input rows by construction, so no positional zip.
Model output is landed (written and read back) before anything else reads
it, so a scorer failure loses no generations and the model never runs twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.constants import ZERO_SHOT_PREFIX
from tandem.functions.text import tokens
from tandem.sinks.writers import land  # noqa: F401  (re-exported: K3)


def apply_generator(
    df: DataFrame, make_fn: Callable, prompt_col: str, out_col: str = "hypothesis", batch_size: int = 8
) -> DataFrame:
    """Add ``out_col`` = model output for ``prompt_col``."""
    from pyspark.ml.functions import predict_batch_udf

    gen = predict_batch_udf(make_fn, return_type=T.StringType(), batch_size=batch_size)
    return df.withColumn(out_col, gen(F.col(prompt_col)))


def apply_scorer(
    df: DataFrame, make_fn: Callable, cols: tuple[str, str, str] = ("src", "mt", "ref"),
    out_col: str = "score", batch_size: int = 8,
) -> DataFrame:
    """Add ``out_col`` = scorer output over the ``(src, mt, ref)`` triple."""
    from pyspark.ml.functions import predict_batch_udf

    score = predict_batch_udf(make_fn, return_type=T.DoubleType(), batch_size=batch_size)
    return df.withColumn(out_col, score(*[F.col(c) for c in cols]))


def apply_caught(
    df: DataFrame, make_fn: Callable | Mapping[str, Callable], cols: tuple[str, ...], out_col: str,
    error_col: str = "error", return_type: T.DataType | None = None, batch_size: int = 8, run_col: str | None = None,
) -> DataFrame:
    """Add ``out_col`` and ``error_col``: the model's output, or what it raised (M1, M2, R2).

    ``make_fn`` is what ``predict_batch_udf`` takes (called once per Python
    worker, returns a function over numpy batches); with ``run_col`` it may
    be a mapping from run to such a function, and a batch never mixes runs,
    so an error concerns the run whose rows it came from and no other. A
    batch that raises, or whose output has another length, gives null values
    and the ``repr`` of the error for its rows; a model that cannot be loaded
    does so for every row of its run. The job itself goes on.
    """
    kind = return_type or T.StringType()
    result = T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType())])
    loaded: dict = {}

    def predict(run, columns: list[pd.Series]) -> tuple[list, str | None]:
        if run not in loaded:
            make = make_fn[run] if isinstance(make_fn, Mapping) else make_fn
            try:
                loaded[run] = make()
            except Exception as e:  # noqa: BLE001  (any error of the caller's model becomes data)
                loaded[run] = e
        n = len(columns[0])
        try:
            if isinstance(loaded[run], Exception):
                raise loaded[run]
            out = list(loaded[run](*[c.to_numpy() for c in columns]))
            if len(out) != n:
                raise ValueError(f"{len(out)} outputs for {n} rows")
            return out, None
        except Exception as e:  # noqa: BLE001
            return [None] * n, repr(e)

    @F.pandas_udf(result)
    def caught(runs: pd.Series, rows: pd.DataFrame) -> pd.DataFrame:
        value = pd.Series([None] * len(runs), dtype=object)
        error = pd.Series([None] * len(runs), dtype=object)
        columns = [rows[c] for c in rows.columns]
        for run, places in runs.groupby(runs, dropna=False).indices.items():
            key = None if pd.isna(run) else run
            for at in range(0, len(places), batch_size):
                batch = places[at : at + batch_size]
                out, what = predict(key, [c.iloc[batch] for c in columns])
                for place, v in zip(batch, out):
                    value.iat[place], error.iat[place] = v, what
        return pd.DataFrame({"value": value, "error": error})

    run = F.col(run_col).cast("string") if run_col else F.lit(None).cast("string")
    rows = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    made = df.withColumn("_caught", caught(run, rows))
    return made.withColumns({out_col: F.col("_caught.value"), error_col: F.col("_caught.error")}).drop("_caught")


def align(pairs: DataFrame, hyps: DataFrame, id_col: str = "text_id", src_col: str = "src_text",
          tgt_col: str = "tgt_text", hyp_col: str = "hypothesis") -> DataFrame:
    """``id, src, mt, ref`` by an equi-join on the row id."""
    j = pairs.select(id_col, src_col, tgt_col).join(hyps.select(id_col, hyp_col), id_col)
    return j.select(id_col, F.col(src_col).alias("src"), F.col(hyp_col).alias("mt"), F.col(tgt_col).alias("ref"))


def unmatched(pairs: DataFrame, hyps: DataFrame, id_col: str = "text_id") -> DataFrame:
    """Ids present on one side only, ``(id, side)`` -- reported, never silently cut."""
    a = pairs.select(id_col).join(hyps.select(id_col), id_col, "left_anti").withColumn("side", F.lit("no_hypothesis"))
    b = hyps.select(id_col).join(pairs.select(id_col), id_col, "left_anti").withColumn("side", F.lit("no_reference"))
    return a.unionByName(b)


def token_f1(mt, ref) -> Column:
    """Stand-in scorer in Spark expressions: F1 of the distinct lower-cased
    whitespace tokens, ``2 |A n B| / (|A| + |B|)``; 0 when either side is empty.
    Not COMET; it exists so the scoring plan can be tested end to end."""
    a = F.array_distinct(tokens(F.lower(F.col(mt) if isinstance(mt, str) else mt)))
    b = F.array_distinct(tokens(F.lower(F.col(ref) if isinstance(ref, str) else ref)))
    common = F.size(F.array_intersect(a, b))
    denom = F.size(a) + F.size(b)
    return F.when(denom == 0, F.lit(0.0)).otherwise(2.0 * common / denom)


# --- stand-in model ---------------------------------------------------------


def make_echo_model(prefix: str = ZERO_SHOT_PREFIX):
    """Stand-in generator for tests and the bench: replies with a space and all
    whitespace tokens of the source after the prompt prefix, in reverse order
    (generated text keeps a leading space, like the recorded hypotheses)."""

    def make():
        def predict(prompts: np.ndarray) -> np.ndarray:
            out = []
            for p in prompts:
                src = p[len(prefix):] if p.startswith(prefix) else p
                out.append(" " + " ".join(src.split()[::-1]))
            return np.array(out, dtype=object)

        return predict

    return make


def make_f1_scorer():
    """Python twin of :func:`token_f1` as a batch scorer (for ``apply_scorer``)."""

    def make():
        def predict(src: np.ndarray, mt: np.ndarray, ref: np.ndarray) -> np.ndarray:
            out = np.empty(len(mt), dtype=np.float64)
            for i, (h, r) in enumerate(zip(mt, ref)):
                a, b = set(h.lower().split()), set(r.lower().split())
                d = len(a) + len(b)
                out[i] = 0.0 if d == 0 else 2.0 * len(a & b) / d
            return out

        return predict

    return make
