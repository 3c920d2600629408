"""Small frames with the hard cases: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import public_tokenizers
import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, class string, ids string, score string, bucket string"
LONG = " ".join(f"word{i % 977} the" for i in range(30_000))


def doc_rows():
    texts = {
        1: "the cat sat on the mat, it's 1999!\n\n  And <|endoftext|> more",
        2: "",
        3: None,
        4: " \t\n ",
        5: "one",
        6: "ünïcode 中文 😀 don't  'll're x",
        7: LONG,
        8: "aaaa" * 200,
        9: "<|endoftext|><|endoftext|>",
        10: "the quick brown fox jumps over the lazy dog and runs into the forest of the night",
        11: "the quick brown fox jumps over the lazy dog and runs into the forest of the night",
        12: "The Quick brown fox jumps over the lazy dog and runs into the forest of the day",
    }
    rows = [(i, t) for i, t in texts.items()] + [(10, texts[10]), (None, "a row without id, of some words"), (None, None), (-5, "negative id")]
    sources = ["b", "a", None, "B", "é"]
    return [(i, t, "en", sources[k % 5], len(t or ""), 7, "x", "y", "z", "w") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(doc_rows(), DDL).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def bpe_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def library(bpe_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_path)
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
