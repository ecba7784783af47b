import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glossa.llm import tokens
from tests.llm.conftest import DOCS, make_docs

PATH = public_tokenizers.path(tokens.VOCABULARY)
PARTS = ["'s", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "a", "st", "re", "E", "12", "½", "é", "日", "😀", "!", "#!", "<|endoftext|>", "\0", "　", "\xa0", "े", "x" * 90]


@pytest.fixture(scope="module")
def both():
    return tokens.compile_vocabulary(PATH), Tokenizer.from_file(PATH)


def expected(lib, texts):
    return [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=8))
def test_counts_are_the_librarys(both, texts):
    counter, lib = both
    n_bytes, n = counter.count(texts)
    assert n.tolist() == expected(lib, texts) and n_bytes.tolist() == [len(t.encode()) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_any_text(both, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    counter, lib = both
    assert counter.count(texts)[1].tolist() == expected(lib, texts)


def test_chunk_scan_is_the_plain_walk(both):
    rng = np.random.default_rng(1)
    for n in (1, 255, 256, 257, 5000):
        classes = rng.integers(0, 11, n).astype(np.uint8)
        state, walked = tokens.BEGIN, []
        for c in classes:
            walked.append(state)
            state = tokens.TO[state, c]
        assert tokens.chunk_states(classes).tolist() == walked


def test_cache_may_overflow(both, monkeypatch):
    counter, lib = both
    monkeypatch.setattr(tokens, "KEPT", 3)
    texts = ["one two three four five six seven", "one two", "z" * 300]
    assert counter.count(texts)[1].tolist() == counter.count(texts)[1].tolist() == expected(lib, texts)


def test_query(spark, corpus, both):
    got = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(make_docs(spark, corpus)).collect()}
    for i, t, _ in corpus:
        n = expected(both[1], [t or ""])[0]
        assert got[i, len((t or "").encode())] == (n, n > 1024)
    assert tokens.count_tokens(spark.createDataFrame([], DOCS)).count() == 0
