"""The subword limit in training sets and prompts, against the tokenizer itself."""

import numpy as np
import pytest

from tandem.operators import prompts
from tandem.plans import evaluation
from tandem.plans.queries import all_queries
from tandem.plans.queries_synthetic import EOS, subword_encoder
from tandem.sources import bindings
from tests.conftest import SF_SMOKE

PREFIX = "Translate the following from Luganda to English: "


def cut(text, limit, encode):
    offsets = encode(text)
    return (text, len(offsets)) if len(offsets) <= limit else (text[: offsets[limit - 1][1]], limit)


@pytest.mark.parametrize("limit", [1, 7, 64, 10_000])
def test_training_rows_are_cut_after_the_limit(spark, limit):
    encode = subword_encoder()
    rows = [(i, f"t{i}", s, t) for i, (s, t) in enumerate([("omusajja ñandu", "the man 😀"), ("", ""), ("x " * 300, "中文字 " * 50), ("a\nEnglish: b", "c")])]
    df = spark.createDataFrame(rows, "ord long, text_id string, src_text string, tgt_text string")
    got = {r.text_id: r for r in prompts.sft_dataset(df, EOS, limit, make_encoder=subword_encoder).collect()}
    for _, key, src, tgt in rows:
        whole = f"{PREFIX}{src}\nEnglish: {tgt}{EOS}"
        text, n = cut(whole, limit, encode)
        at = text.rfind("\nEnglish:")
        want = (text, n, text[: at + 9] if at >= 0 else None, text[at + 9 :] if at >= 0 else None)
        assert (got[key].text, got[key].n_tokens, got[key].prompt, got[key].completion) == want


def test_query_over_all_pairs(spark):
    encode = subword_encoder()
    pairs = bindings.chat_pairs(spark, SF_SMOKE).collect()
    got = {r.text_id: (r.text, r.n_tokens) for r in all_queries()["sft_subword"](spark, SF_SMOKE).collect()}
    assert got == {p.text_id: cut(f"{PREFIX}{p.src_text}\nEnglish: {p.tgt_text}{EOS}", 64, encode) for p in pairs}


def test_prompts_of_an_evaluation_are_cut(spark):
    def remember():
        return lambda texts: np.array([f"{len(t)}" for t in texts], dtype=object)

    encode = subword_encoder()
    src = "omusajja omulungi nnyo " * 20
    df = spark.createDataFrame([(0, "t0", src, "x", "o")], "ord long, text_id string, src_text string, tgt_text string, origin string")
    res = evaluation.evaluate(df, remember, max_input_tokens=30, make_encoder=subword_encoder)
    assert [int(r.hypothesis) for r in res.hypotheses.collect()] == [len(cut(PREFIX + src, 30, encode)[0])]
