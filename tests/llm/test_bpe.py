import hashlib
import random

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from netloom.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_tiktoken_and_back(ranks, reference):
    rng = random.Random(3)
    letters = [*"abst mdrevl'  \n\t\r\x1c\x1f  _-!?0123²½Ⅷ٣éßñ中日\U0001F600́​", "'s", "'re", "'ve", "'ll", "  ", " '"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(1500)] + ["", "a" * 3000, " " * 700, "<|endoftext|>"]
    c = bpe.Codec(ranks)
    ids, ends = c.encode(texts)
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == reference.encode_ordinary(t), t
    assert c.decode(ids, ends) == [t.encode() for t in texts]


def test_long_merge_equals_recursion(ranks):
    c = bpe.Codec(ranks)
    for w in (b"abab" * 40, b"zzzzzzzzzzzzzz", b"therethenthat"):
        assert c.long_merge(w).tobytes() == c.merge([w])[0] or w in ranks


def test_hash_collisions_are_resolved(ranks):
    data = np.array([1, 2, 1, 2, 3, 1, 2], np.uint32)
    p = bpe.Pieces(data, np.array([0, 2, 5]), np.zeros(8, np.uint64), np.zeros(8, np.uint64))  # every hash is 0
    assert p.of.tolist() == [0, 1, 0]


def test_query_rows(docs, rows, empty, ranks, reference):
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(docs, ranks).collect())
    want = []
    for d, t, *_ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((d is None, d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_decode(empty, ranks).collect() == []


def test_pattern_is_asserted():
    bpe.check_pattern(P.PATTERN)
    with pytest.raises(ValueError):
        bpe.check_pattern(r"\w+|\W+")
