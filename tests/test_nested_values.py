"""``str()`` of nested values, very long numbers and bare infinities in replies."""

import json

import pytest

from tandem.functions.replies import with_reply_pairs
from tandem.session import ensure_conf

CASES = [
    '[{"luganda": {"z": 1, "a": [true, null, 1.50, "x\'y", {"q": "\\"\'"}]}, "english": "e"}]',
    '[{"luganda": [], "english": {}}, {"luganda": "plain", "english": [[["deep"]]]}]',
    '[{"luganda": {"k": 1, "j": 2, "k": {"last": "wins"}}, "english": 7}]',
    '[{"luganda": 123456789012345678901234567890123456789012345, "english": -12345678901234567890123456789012345678901}]',
    '[{"luganda": NaN, "english": -Infinity}, {"luganda": Infinity, "english": "NaN"}]',
    '[1, {"luganda": ["\\u00e9\\n\\t\\u2028 \\ud83d\\ude00"], "english": " pad "}]',
    '[{"luganda": "no digits 1234567890123456789012345678901234567890123", "english": "kept"}]',
    '[{"luganda": [1], "english": "e"}] tail',
    '{"luganda": [1], "english": "e"}',
    '[{"luganda": [1]}, {"english": {"a": 1}}]',
    '```json\n[{"luganda": [1, 2], "english": {"a": 1e400}}]\n```',
    "[" * 500 + "]" * 500,
    '[{"luganda": 1e400, "english": "NaN"}]',
]


def python_pairs(text):
    import re

    t = re.sub(r"\n?```$", "", re.sub(r"^```[a-z]*\n?", "", text.strip())).strip()
    try:
        value = json.loads(t)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, list):
        return None
    return [(i, str(e["luganda"]).strip(), str(e["english"]).strip()) for i, e in enumerate(value) if isinstance(e, dict) and "luganda" in e and "english" in e]


@pytest.fixture(scope="module")
def parsed(spark):
    ensure_conf(spark)
    df = spark.createDataFrame([*enumerate(CASES), (len(CASES), None)], "i int, response_text string").repartition(3)
    return {r.i: r.pairs for r in with_reply_pairs(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_as_python_reads_it(parsed, i):
    got = parsed[i]
    assert (None if got is None else [(p.pos, p.src, p.tgt) for p in got]) == python_pairs(CASES[i])


def test_no_reply(parsed):
    assert parsed[len(CASES)] is None
