import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

from quernstone.llm.bpe import VOCABULARY, PairIndexEncoder, count_tokens, encode, load

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def coder():
    return PairIndexEncoder(load(VOCABULARY))


def ids(coder, texts):
    values, counts = coder.encode(texts)
    return [x.tolist() for x in np.split(values, np.cumsum(counts)[:-1])]


def test_documents_equal_the_library(coder, library):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    assert ids(coder, texts) == [library(t) if t else [] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aab  \n'st<|>endofx019é日🙂"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=4))
def test_any_text_equals_the_library(coder, library, texts):
    assert ids(coder, texts) == [library(t) for t in texts]


def test_runs_of_one_symbol_and_long_texts(coder, library):
    texts = ["a" * n for n in range(1, 40)] + ["aaab" * 50, "word " * 20000, "<|endoftext|>"]
    assert ids(coder, texts) == [library(t) for t in texts]


def test_forgetting_changes_nothing(coder):
    before = ids(coder, ["some words", None, "some other words"])
    coder.forget()
    assert ids(coder, ["some words", None, "some other words"]) == before


def test_in_spark(spark, library):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world")], "doc_id long, text string")
    got = [(r["doc_id"], r["ids"]) for r in encode(df, "text").select("doc_id", "ids").orderBy("doc_id").collect()]
    assert got == [(1, []), (2, []), (3, library("Hello  world")), (3, library("Hello  world"))]
    assert [r["n_tokens"] for r in count_tokens(df, "text").orderBy("doc_id").collect()] == [0, 0, len(got[2][1]), len(got[2][1])]
    assert encode(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        encode(df, "text", out="doc_id")
