import base64
import random

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from inkstone.llm import tokens

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
with open(tokens.VOCABULARY, "rb") as f:
    FILE = f.read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, FILE.splitlines())}
REAL = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
MERGES = tokens.Merges(FILE)


def ours(texts):
    import numpy as np

    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    a, b, splits = tokens.starts(np.frombuffer(data, np.uint8), offsets)
    n = [MERGES.tokens(data[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    return [sum(n[i:j]) for i, j in zip(splits[:-1], splits[1:], strict=True)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("a re l lvst'' \n\t é1٣.!日😀E"), max_size=40), max_size=4))
def test_counts_equal_the_tokenizer(texts):
    assert ours(texts) == [len(REAL.encode_ordinary(t)) for t in texts]


def test_chunks_of_a_long_text():
    draw = random.Random(1)
    text = "".join(draw.choices(["we're", " the", "  ", "\n", "'ll", "'s", " 12", "word", "...", " '", "'"], k=20_000))
    assert ours([text, "", text]) == [len(REAL.encode_ordinary(text)), 0, len(REAL.encode_ordinary(text))]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count(docs).collect()}
    assert got == {r["doc_id"]: len(REAL.encode_ordinary(r["text"])) for r in docs.collect()}
    edge = spark.createDataFrame([(None, None, 1), ("x", "", 2), ("x", "a" * 50_000, 3)], "doc_id string, text string, n_tokens int")
    assert [r["n_tokens"] for r in tokens.count(edge).collect()] == [0, 0, len(REAL.encode_ordinary("a" * 50_000))]
    assert tokens.count(edge.limit(0)).count() == 0
