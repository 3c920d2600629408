"""Strict reply parsing and attempt handling."""

import json

from tandem.functions.replies import with_reply_pairs
from tandem.operators import replies
from tandem.schema import RESPONSE


# Replies and the pairs (position, source, target) that must come out; None: rejected.
EDGE_CASES = [
    ("", None),
    ("[]", []),
    ('```json\n[{"english": "a", "luganda": "b"}]\n```', [(0, "b", "a")]),
    ('[{"english": "a", "luganda": "b"}] trailing', None),
    ('[{"english": "a", "luganda": "b"}]]', None),
    ('[{"english": "a", "luganda": "b"}][{"english": "c", "luganda": "d"}]', None),
    ('{"english": "a", "luganda": "b"}', None),
    ('[{"english": "a", "luganda": "b"}, {"english": "c"', None),
    ('[1, {"english": "a", "luganda": "b"}]', [(1, "b", "a")]),
    ('[{"english": "a"}, {"english": "c", "luganda": "d"}]', [(1, "d", "c")]),
    ('[{"english": null, "luganda": "x"}]', [(0, "x", "None")]),
    ('[{"english": true, "luganda": false}]', [(0, "False", "True")]),
    ('[{"english": "first", "english": "second", "luganda": "y"}]', [(0, "y", "second")]),
    ('[{"english": "", "luganda": ""}]', [(0, "", "")]),
    ('[{"english": 12, "luganda": 1.5}]', [(0, "1.5", "12")]),
    ('[{"english": "  padded\\u00a0", "luganda": "\\ttab"}]', [(0, "tab", "padded")]),
    ('[{"english": "a", "luganda": "b"}], "§"', None),
    ('[{"english": "a", "luganda": "b"}],"§"] trailing', None),
    ('"just a string"', None),
    ("null", None),
    ('[{"english": "é ü 日本", "luganda": "ok"}]', [(0, "ok", "é ü 日本")]),
    ('[{"english": 1.0, "luganda": 1e16}]', [(0, "1e+16", "1.0")]),
    ('[{"english": 0.0001, "luganda": 1E5}]', [(0, "100000.0", "0.0001")]),
    ('[{"english": 1e-7, "luganda": -12500000000.0}]', [(0, "-12500000000.0", "1e-07")]),
    ('[{"english": 123456789.125, "luganda": 12345678901234567890}]', [(0, "12345678901234567890", "123456789.125")]),
    ('[{"english": -2.5e-300, "luganda": 0.00025}]', [(0, "0.00025", "-2.5e-300")]),
]
EDGE_REPLIES = [reply for reply, _ in EDGE_CASES]


def _spark_pairs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = with_reply_pairs(df, "t", "p").orderBy("i").collect()
    res = []
    for r in out:
        res.append(None if r["p"] is None else [(x["pos"], x["src"], x["tgt"]) for x in r["p"]])
    return res


def test_edge_replies(spark):
    got = _spark_pairs(spark, EDGE_REPLIES)
    for (text, want), g in zip(EDGE_CASES, got):
        assert g == want, text


def test_attempt_delivered_twice_counts_once(spark):
    a = replies.classify_attempts(_attempts(spark, [(0, 1, GOOD, None), (0, 1, GOOD, None)]))
    assert a.count() == 1 and replies.accepted_pairs(a).count() == 1
    plan = spark.createDataFrame([(0, 30), (1, 30)], "batch_id long, requested long")
    assert dict(replies.batch_status(a, plan=plan).collect()) == {0: "ok", 1: "pending"}


def _attempts(spark, rows):
    return spark.createDataFrame(rows, RESPONSE)


GOOD = '[{"english": "e", "luganda": "l"}]'


def test_attempt_status_and_first_success(spark):
    rows = [
        (0, 1, GOOD, None),  # ok at once
        (1, 1, "oops", None), (1, 2, GOOD, None), (1, 3, GOOD, None),  # attempt 3 ignored
        (2, 1, None, "503"), (2, 2, "[]", None), (2, 3, "[1]", None), (2, 4, "{}", None), (2, 5, "x", None),
        (2, 6, GOOD, None),  # success on attempt 6 must be ignored
        (3, 1, "bad", None),  # one failure so far: pending
    ]
    a = replies.classify_attempts(_attempts(spark, rows))
    st = {(r.batch_id, r.attempt): (r.status, r.used) for r in a.collect()}
    assert st[(0, 1)] == ("ok", True)
    assert st[(1, 1)] == ("parse_error", False)
    assert st[(1, 2)] == ("ok", True) and st[(1, 3)] == ("ok", False)
    assert st[(2, 1)] == ("api_error", False)
    assert all(not st[(2, k)][1] for k in range(1, 7))
    b = dict(replies.batch_status(a).collect())
    assert b == {0: "ok", 1: "ok", 2: "exhausted", 3: "pending"}
    pairs = replies.accepted_pairs(a).collect()
    assert sorted((p.batch_id, p.pos, p.src, p.tgt) for p in pairs) == [(0, 0, "l", "e"), (1, 0, "l", "e")]


def test_numbering_stop_at_target_over_delivery(spark):
    many = json.dumps([{"english": f"e{i}", "luganda": f"l{i}"} for i in range(5)])
    rows = [(0, 1, many, None), (1, 1, many, None), (2, 1, many, None)]
    a = replies.classify_attempts(_attempts(spark, rows))
    n = replies.number_pairs(replies.accepted_pairs(a), base=3)
    kept = replies.stop_at_target(n, 10)
    got = sorted((r.batch_id, r.pos, r.n) for r in kept.collect())
    # numbering continues after 3 landed rows; target 10 stops inside batch 1
    assert got == [(0, i, 4 + i) for i in range(5)] + [(1, i, 9 + i) for i in range(2)]


def test_single_expression_form_agrees(spark):
    from tandem.functions.replies import reply_pairs

    df = spark.createDataFrame(list(enumerate(EDGE_REPLIES)), "i int, t string")
    a = {r.i: r.p for r in with_reply_pairs(df, "t", "p").collect()}
    b = {r.i: r.p for r in df.select("i", reply_pairs("t").alias("p")).collect()}
    assert a == b


def test_reply_parse_property(spark):
    """Replies are drawn together with what must come out of them."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    pads = st.sampled_from(["", " ", "\u00a0", "\u3000", "\t"])
    word = st.text(st.characters(exclude_categories=["Cs", "Cc", "Zs", "Zl", "Zp"]), max_size=8)
    padded = st.builds(lambda l, w, r: (l + w + r, w), pads, word, pads)  # (value in the reply, text that stays)
    scalar = st.one_of(padded, st.integers(-(10**12), 10**12).map(lambda n: (n, format(n, "d"))),
                       st.sampled_from([(True, "True"), (False, "False"), (None, "None")]))
    pair = st.tuples(scalar, scalar).map(lambda p: ({"luganda": p[0][0], "english": p[1][0]}, (p[0][1], p[1][1])))
    other = st.one_of(st.just({"english": "x"}), st.just({}), st.integers(0, 9), st.just([1]), st.none(), st.just("s")).map(lambda v: (v, None))
    element = st.one_of(pair, other)

    def render(elements, indent, fence, junk):
        text = json.dumps([e for e, _ in elements], indent=indent, ensure_ascii=False)
        if fence:
            text = "```json\n" + text + "\n```"
        want = [(i, *w) for i, (_, w) in enumerate(elements) if w is not None]
        return text + junk, want if junk.strip() == "" else None

    reply = st.builds(render, st.lists(element, max_size=5), st.sampled_from([None, 2]), st.booleans(), st.sampled_from(["", " ", " x", "]"]))

    @settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(st.lists(reply, min_size=1, max_size=40))
    def check(cases):
        got = _spark_pairs(spark, [t for t, _ in cases])
        for (text, want), g in zip(cases, got):
            assert g == want, text

    check()
