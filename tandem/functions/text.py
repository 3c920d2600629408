"""Column-level text functions with Python string semantics.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.constants import MISSING_SCORE_CELL, NON_WS_CLASS, WS_CLASS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sql_name(name: str) -> str:
    """A column name quoted for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def py_strip_sql(x: str) -> str:
    """SQL text of :func:`py_strip` over the SQL expression ``x`` (keep ``x`` a
    column or lambda-variable reference: it appears four times)."""
    return (
        f"CASE WHEN left({x}, 1) RLIKE r'{WS_CLASS}' OR right({x}, 1) RLIKE r'{WS_CLASS}' "
        f"THEN regexp_replace(regexp_replace({x}, r'^{WS_CLASS}+', ''), r'{WS_CLASS}+$', '') ELSE {x} END"
    )


def py_strip(col) -> Column:
    """Python ``str.strip()``: removes every Unicode whitespace character at both ends.

    Spark's ``trim`` removes U+0020 only, so it is not used. Most texts have no
    edge whitespace: the two edge characters are tested first, so the
    scanning regexes run only on texts that need them.
    """
    if isinstance(col, str):
        return F.expr(py_strip_sql(sql_name(col)))  # one JVM call to build
    c = col
    edge = F.left(c, F.lit(1)).rlike(WS_CLASS) | F.right(c, F.lit(1)).rlike(WS_CLASS)
    stripped = F.regexp_replace(F.regexp_replace(c, "^" + WS_CLASS + "+", ""), WS_CLASS + "+$", "")
    return F.when(edge, stripped).otherwise(c)


def norm_key(col) -> Column:
    """Dedup key: ``value.lower().strip()``. Null stays null."""
    return py_strip(F.lower(_c(col)))


def first_line(col) -> Column:
    """Text up to the first newline."""
    return F.substring_index(_c(col), "\n", 1)


# Fence removal (X4): a leading ```lang line start and a trailing ```; {x} is an SQL expression.
UNFENCE_SQL = r"regexp_replace(regexp_replace({x}, r'^```[a-z]*\n?', ''), r'\n?```$', '')"


def strip_fences_sql(x: str) -> str:
    """SQL text of: strip, drop the fences, strip again (X4). ``x`` appears several
    times; on DataFrames the reply parser stages these steps as projections."""
    return py_strip_sql("(" + UNFENCE_SQL.format(x=py_strip_sql(x)) + ")")


def strip_fences(col: str) -> Column:
    """Strip, drop a leading ```lang fence and a trailing ``` fence, strip again."""
    return F.expr(strip_fences_sql(sql_name(col)))


def format_id(fmt: str, n) -> Column:
    """Zero-padded id such as ``gem5_s%06d`` (X1); longer numbers are kept whole."""
    return F.format_string(fmt, _c(n).cast("long"))


def tokens(col) -> Column:
    """Whitespace tokens with ``str.split()`` semantics; empty array for blank text."""
    return F.regexp_extract_all(_c(col), F.lit(NON_WS_CLASS + "+"), 0)


def n_tokens(col) -> Column:
    return F.size(tokens(col)).cast("long")


def truncate_tokens(col, max_tokens: int) -> Column:
    """Keep the text up to the end of its ``max_tokens``-th token.

    Original spacing and newlines between kept tokens are preserved, so a
    prompt template that follows the source still matches afterwards. A text of
    no more than ``max_tokens`` tokens is returned as it is.
    """
    pieces = F.regexp_extract_all(_c(col), F.lit(WS_CLASS + "*" + NON_WS_CLASS + "+"), 0)
    return F.when(F.size(pieces) <= max_tokens, _c(col)).otherwise(F.array_join(F.slice(pieces, 1, max_tokens), ""))


def first_tokens_joined(col, n: int) -> Column:
    """First ``n`` whitespace tokens joined by one space (``' '.join(s.split()[:n])``)."""
    return F.array_join(F.slice(tokens(col), 1, n), " ")


def _fixed_decimals_udf(decimals: int):
    fmt = f"{{:.{decimals}f}}"

    @F.pandas_udf("string")
    def fixed(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else fmt.format(v))

    return fixed


def score_cell(col, decimals: int = 4) -> Column:
    """``f"{x:.4f}"`` or the fixed missing-score cell for null.

    Python rounds the exact binary value; Spark's ``format_string`` and
    ``format_number`` round the shortest decimal text (0.00005 -> 0.0000,
    Python 0.0001). Score cells exist once per condition in a report, so a
    vectorized pandas UDF with Python's own ``format`` is exact and cheap here.
    """
    c = _c(col)
    return F.when(c.isNotNull(), _fixed_decimals_udf(decimals)(c.cast("double"))).otherwise(F.lit(MISSING_SCORE_CELL))


def cap_text(col, n: int) -> Column:
    """First ``n`` characters."""
    return F.left(_c(col), F.lit(n))


def subword_truncate(col, make_encoder, max_tokens: int):
    """Token count and truncated text with a caller's subword tokenizer.

    ``make_encoder()`` is called once per Python worker and returns
    ``encode(text) -> list[(start, end)]`` character offsets of the tokens
    (what fast tokenizers return as ``offsets``). Returns a struct column
    ``(n_tokens long, text string)``: the text cut after the ``max_tokens``-th
    token. Arrow-batched pandas UDF; whitespace tokens (:func:`truncate_tokens`)
    need no Python at all.
    """
    state = {}

    @F.pandas_udf("n_tokens long, text string")
    def cut(texts: pd.Series) -> pd.DataFrame:
        if "enc" not in state:
            state["enc"] = make_encoder()
        enc = state["enc"]
        n, out = [], []
        for t in texts:
            if t is None:
                n.append(None)
                out.append(None)
                continue
            offs = enc(t)
            n.append(len(offs))
            out.append(t if len(offs) <= max_tokens else t[: offs[max_tokens - 1][1]])
        return pd.DataFrame({"n_tokens": n, "text": out})

    return cut(_c(col))
