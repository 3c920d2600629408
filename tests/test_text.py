"""Python string semantics in Spark expressions."""

import re

from pyspark.sql import functions as F

from tandem.functions import text as X

SAMPLES = [
    "plain",
    "  spaced  ",
    "\ttabbed\t",
    " nbsp ",
    "　ideographic　",
    "\x1cfile-sep\x1f",
    "\x85next-line ",
    "​zero-width-is-not-space​",
    "",
    "   ",
    "İstanbul ΣΑΣ",
    "line one\nline two\r\n",
    "a b",
]


def test_py_strip_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    got = {r[0]: r[1] for r in df.select("s", X.py_strip("s")).collect()}
    for s in SAMPLES:
        assert got[s] == s.strip(), repr(s)


def test_norm_key_matches_python_lower_strip(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES] + [(None,)], "s string")
    got = dict(df.select("s", X.norm_key("s")).collect())
    for s in SAMPLES:
        assert got[s] == s.lower().strip(), repr(s)
    assert got[None] is None


def test_tokens_and_truncate_match_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    out = df.select("s", X.tokens("s").alias("t"), X.truncate_tokens("s", 1).alias("one"),
                    X.first_tokens_joined("s", 2).alias("two")).collect()
    for s, t, one, two in out:
        assert list(t) == s.split(), repr(s)
        assert two == " ".join(s.split()[:2])
        if len(s.split()) > 1:
            # leading whitespace kept, text cut right after the first token
            assert one.strip() == s.split()[0] and s.startswith(one)
        else:
            assert one == s  # nothing to cut


def test_format_id_does_not_truncate(spark):
    df = spark.range(1).select(
        X.format_id("gem5_s%06d", F.lit(7)).alias("a"),
        X.format_id("gem1_s%05d", F.lit(1234567)).alias("b"),
    )
    assert df.first() == ("gem5_s000007", "gem1_s1234567")


def test_strip_fences(spark):
    cases = ["```json\n[1]\n```", "```\n[1]```", "  ```json\n[1]\n```  ", "[1]", "```JSON\n[1]\n```"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r[0] for r in df.select(X.strip_fences("s")).collect()]

    def python(t):
        t = re.sub(r"\n?```$", "", re.sub(r"^```[a-z]*\n?", "", t.strip()))
        return t.strip()

    assert got == [python(c) for c in cases]


def test_score_cell_and_cap(spark):
    df = spark.createDataFrame([(0.48002,), (None,)], "x double")
    assert [r[0] for r in df.select(X.score_cell("x")).collect()] == ["0.4800", "  -   "]
    df = spark.createDataFrame([("x" * 300,)], "s string")
    assert len(df.select(X.cap_text("s", 250)).first()[0]) == 250


def test_score_cell_rounds_like_python(spark):
    vals = [0.12345, 0.48005, 0.00005, 0.99995, 0.4741, 0.03125, 1234.56789, -0.00004, 0.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(X.score_cell("x")).collect()]
    assert got == [f"{v:.4f}" for v in vals]


def test_subword_truncate_hook_matches_whitespace_truncation(spark):
    def _ws_encoder():  # nested: shipped to the workers by value
        import re as _re

        pat = _re.compile(r"\S+")
        return lambda t: [(m.start(), m.end()) for m in pat.finditer(t)]

    df = spark.createDataFrame([("a bb  ccc\nd",), ("x",), (None,)], "s string")
    out = df.select(X.subword_truncate("s", _ws_encoder, 2).alias("r"), X.truncate_tokens("s", 2).alias("w")).collect()
    assert out[0].r.n_tokens == 4 and out[0].r.text == out[0].w == "a bb"
    assert out[1].r.text == "x" and out[2].r.text is None


def test_python_text_semantics_property(spark):
    """Random Unicode strings (weighted towards whitespace): strip, lower+strip and
    split agree with Python, checked in one Spark job per drawn batch."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    ws = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ",
          " ", " ", " ", " ", "　", "​", "﻿"]
    alphabet = st.one_of(st.sampled_from(ws), st.characters(blacklist_categories=("Cs",)))

    @settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(st.lists(st.text(alphabet=alphabet, max_size=12), min_size=1, max_size=40))
    def check(strings):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
        out = df.select("i", X.py_strip("s").alias("a"), X.py_strip(F.col("s")).alias("b"),
                        X.tokens("s").alias("t")).collect()
        for r in out:
            s = strings[r.i]
            assert r.a == s.strip() and r.b == s.strip(), repr(s)
            assert list(r.t) == s.split(), repr(s)

    check()
