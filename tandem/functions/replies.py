"""Strict parsing of model replies.

Replies must be a JSON array (``json.loads`` semantics). Spark's JSON and
variant parsers accept trailing text, so the reply is wrapped with a sentinel
element: ``[<reply>,"<sentinel>"]`` is a valid 2-element array whose second
element is the sentinel exactly when the reply is one complete JSON value; the
first element must then be an array. The sentinel holds the reply's own md5. Duplicate object keys keep the last value
(``spark.sql.variant.allowDuplicateKeys=true``, set by ``tandem.session``).

Every intermediate is computed once: the cleaning and the parse are separate
projections (Catalyst keeps an expensive column that is referenced several
times), and per-element work runs as successive ``transform`` passes over
small structs. The expressions are written as SQL text, so building one costs
a single JVM call instead of hundreds of Column calls.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.text import UNFENCE_SQL, py_strip, py_strip_sql, sql_name, strip_fences_sql

# The sentinel is derived from the reply itself, so no reply can contain it.
SENTINEL_SQL = "concat('§', md5({x}))"


def py_float_sql(f: str) -> str:
    """SQL text of Python's ``repr`` of a float, from Spark's text ``f`` of the same
    double: exponents only below 1e-4 and from 1e16 on, with two digits at least."""
    mant, exp = f"substring_index({f}, 'E', 1)", f"CAST(substring_index({f}, 'E', -1) AS INT)"
    sign = f"CASE WHEN startswith({f}, '-') THEN '-' ELSE '' END"
    digits = f"regexp_replace(replace(replace({mant}, '-', ''), '.', ''), '(?<=.)0+$', '')"
    return (
        f"CASE WHEN NOT contains({f}, 'E') THEN {f} "
        f"WHEN {exp} BETWEEN 0 AND 15 THEN concat({sign}, rpad(left({digits}, {exp} + 1), {exp} + 1, '0'), '.', "
        f"CASE WHEN length({digits}) > {exp} + 1 THEN substr({digits}, {exp} + 2) ELSE '0' END) "
        f"WHEN {exp} BETWEEN -4 AND -1 THEN concat({sign}, '0.', repeat('0', -{exp} - 1), {digits}) "
        f"ELSE concat(regexp_replace({mant}, '[.]0$', ''), 'e', CASE WHEN {exp} < 0 THEN '-' ELSE '+' END, "
        f"lpad(CAST(abs({exp}) AS STRING), greatest(2, length(CAST(abs({exp}) AS STRING))), '0')) END"
    )


def py_str_sql(v: str, t: str) -> str:
    """SQL text of ``str(value)`` for a parsed JSON value ``v`` of variant type name ``t``.

    Strings as they are; integers as their digits; JSON null as ``None``;
    booleans as ``True``/``False``; numbers written with a point or an exponent
    as Python prints the float (a decimal of scale 0 and at most 18 digits is
    one: integers of that size have an integer type). Objects, arrays and
    integers of more than 38 digits have no such text here:
    :func:`with_reply_pairs` hands replies that hold them to Python.
    """
    f = f"CAST(try_variant_get({v}, '$', 'double') AS STRING)"
    return (
        f"CASE WHEN {t} = 'STRING' THEN try_variant_get({v}, '$', 'string') "
        f"WHEN {t} = 'VOID' THEN 'None' "
        f"WHEN {t} = 'BOOLEAN' THEN CASE WHEN try_variant_get({v}, '$', 'boolean') THEN 'True' ELSE 'False' END "
        f"WHEN {t} IN ('DOUBLE', 'FLOAT') OR ({t} LIKE 'DECIMAL%' AND ({t} NOT LIKE '%,0)' OR length({t}) < 13 OR {t} < 'DECIMAL(19')) "
        f"THEN {py_float_sql(f)} "
        f"WHEN startswith({t}, 'OBJECT') OR startswith({t}, 'ARRAY') THEN to_json({v}) "
        f"ELSE try_variant_get({v}, '$', 'string') END"
    )


def typed_pairs_sql(arr: str, src_key: str = "luganda", tgt_key: str = "english") -> str:
    """SQL text: valid elements of a parsed reply array with the variants and types of both values.

    Pass 1 looks each field up once, pass 2 keeps objects holding both keys
    (a JSON null value counts as present), pass 3 types the values.
    """
    looked_up = (
        f"transform({arr}, (e, i) -> named_struct('pos', i, 'obj', startswith(schema_of_variant(e), 'OBJECT'), "
        f"'s', try_variant_get(e, '$.{src_key}', 'variant'), 't', try_variant_get(e, '$.{tgt_key}', 'variant')))"
    )
    valid = f"filter({looked_up}, x -> coalesce(x.obj AND x.s IS NOT NULL AND x.t IS NOT NULL, false))"
    return (
        f"transform({valid}, x -> named_struct('pos', x.pos, 's', x.s, 'st', schema_of_variant(x.s), "
        f"'t', x.t, 'tt', schema_of_variant(x.t)))"
    )


def pairs_from_typed_sql(typed: str) -> str:
    """SQL text: ``struct<pos, src, tgt>`` of typed elements (J4, X2): ``str()``, then strip."""
    texts = (
        f"transform({typed}, x -> named_struct('pos', x.pos, 's', {py_str_sql('x.s', 'x.st')}, "
        f"'t', {py_str_sql('x.t', 'x.tt')}))"
    )
    return (
        f"transform({texts}, x -> named_struct('pos', x.pos, 'src', {py_strip_sql('x.s')}, "
        f"'tgt', {py_strip_sql('x.t')}))"
    )


# Values whose Python text a variant cannot give: it sorts object keys and holds 38 digits.
# Bare NaN and Infinity are JSON to Python only.
_NESTED_SQL = "exists({typed}, x -> x.st RLIKE '^(OBJECT|ARRAY)' OR x.tt RLIKE '^(OBJECT|ARRAY)')"
_PYTHON_ONLY = r"[0-9]{39}|NaN|Infinity"


def _python_pairs(src_key: str, tgt_key: str):
    """Arrow-batched twin of the SQL path with Python's own parser, for the replies that need it (null for others)."""

    @F.pandas_udf("array<struct<pos: int, src: string, tgt: string>>")
    def parse(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = None
            if text is not None:
                try:
                    value = json.loads(text)
                except (ValueError, RecursionError):
                    value = None
                if isinstance(value, list):
                    found = [
                        {"pos": i, "src": str(e[src_key]).strip(), "tgt": str(e[tgt_key]).strip()}
                        for i, e in enumerate(value) if isinstance(e, dict) and src_key in e and tgt_key in e
                    ]
            out.append(found)
        return pd.Series(out, dtype=object)

    return parse


def with_reply_pairs(df: DataFrame, text_col: str = "response_text", out_col: str = "pairs",
                     src_key: str = "luganda", tgt_key: str = "english") -> DataFrame:
    """Add ``out_col`` = ``array<struct<pos int, src string, tgt string>>`` of the
    reply's valid elements, or null when the reply is not exactly one JSON
    array. Positions are array positions, so invalid elements leave gaps.

    Steps, one projection each: strip -> unfence -> strip -> wrapped parse ->
    array check -> typed elements -> pairs. Replies with a nested value, a whole
    number of more than 38 digits or a bare NaN / Infinity go through Python's
    parser, which alone keeps their keys' order and digits (J4); the
    others pass it as nulls.
    """
    d = df.withColumn("_r1", py_strip(text_col))
    d = d.withColumn("_r2", F.expr(UNFENCE_SQL.format(x="_r1")))
    d = d.withColumn("_r3", py_strip("_r2"))
    d = d.withColumn("_wrapped", F.expr(
        f"""try_variant_get(try_parse_json(concat('[', _r3, ',"', {SENTINEL_SQL.format(x='_r3')}, '"]')), '$', 'array<variant>')"""))
    d = d.withColumn("_arr", F.expr(
        f"CASE WHEN size(_wrapped) = 2 AND try_variant_get(get(_wrapped, 1), '$', 'string') = {SENTINEL_SQL.format(x='_r3')} "
        "AND startswith(schema_of_variant(get(_wrapped, 0)), 'ARRAY') "
        "THEN try_variant_get(get(_wrapped, 0), '$', 'array<variant>') END"))
    d = d.withColumn("_typed", F.expr(typed_pairs_sql("_arr", src_key, tgt_key)))
    hard = F.expr(f"coalesce({_NESTED_SQL.format(typed='_typed')}, false)") | F.coalesce(F.col("_r3").rlike(_PYTHON_ONLY), F.lit(False))
    d = d.withColumn("_hard", F.when(hard, F.col("_r3")))
    d = d.withColumn("_python", _python_pairs(src_key, tgt_key)(F.col("_hard")))
    d = d.withColumn(out_col, F.when(F.col("_hard").isNotNull(), F.col("_python")).otherwise(F.expr(pairs_from_typed_sql("_typed"))))
    return d.drop("_r1", "_r2", "_r3", "_wrapped", "_arr", "_typed", "_hard", "_python")


def reply_pairs(text_col: str) -> Column:
    """The same pairs as one Column expression over the column ``text_col`` (for
    ``select``); the cleaning steps are inlined, so prefer :func:`with_reply_pairs`.
    No Python: nested values come out as compact JSON, and whole numbers of more
    than 38 digits as floats."""
    cleaned = strip_fences_sql(sql_name(text_col))
    sentinel = SENTINEL_SQL.format(x=cleaned)
    wrapped = f"""try_variant_get(try_parse_json(concat('[', {cleaned}, ',"', {sentinel}, '"]')), '$', 'array<variant>')"""
    arr = (
        f"CASE WHEN size({wrapped}) = 2 AND try_variant_get(get({wrapped}, 1), '$', 'string') = {sentinel} "
        f"AND startswith(schema_of_variant(get({wrapped}, 0)), 'ARRAY') "
        f"THEN try_variant_get(get({wrapped}, 0), '$', 'array<variant>') END"
    )
    return F.expr(pairs_from_typed_sql(typed_pairs_sql(f"({arr})")))
