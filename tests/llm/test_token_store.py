import os
import random

import numpy as np
import pytest

from lexigrid.llm import token_store as ts

from .helpers import awkward, documents, words

pytestmark = pytest.mark.skipif(not os.path.exists(ts.TOKENIZER), reason="no tokenizer files here")


def plain(path):
    """Encoding without remembered pieces."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb").read().splitlines() if x)}
    return tiktoken.Encoding("p", pat_str=ts.SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_remembered_pieces_change_nothing():
    texts = ["a b", "It's  two", " x", "x ", "a\n b", "a\nb c.\nd", "tab\tx y", "", "é ü 12,5 (x) don't", " a b", "a  b", "x\x1fy z", "end\n", words(random.Random(0), 500)]
    encode, size = ts.tokenizer(ts.TOKENIZER)
    one = plain(ts.TOKENIZER)
    assert [np.frombuffer(b, f"<u{size}").tolist() for b in encode(texts)] == [one(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 20_000])
def test_index(n):
    rng = np.random.default_rng(n)
    keys = rng.choice(2**62, n, replace=False) - 2**61 if n else np.zeros(0, np.int64)
    lengths = rng.integers(0, 50, n)
    offsets = np.cumsum(lengths) - lengths
    index = ts.ShardIndex(ts.build_index(keys, offsets, lengths))
    some = keys[:300].tolist()
    slots = [index.slot(k) for k in (keys.tolist() if n <= 1000 else some)]
    assert len(set(slots)) == len(slots) and all(0 <= s < n for s in slots)
    if n <= 1000:
        assert sorted(slots) == list(range(n))
    for k, s in zip(some, slots):
        i = int(np.flatnonzero(keys == k)[0])
        assert (index.offsets[s], index.lengths[s]) == (offsets[i], lengths[i])
    assert sum(index.slot(int(k)) >= 0 for k in rng.integers(2**62, 2**63 - 1, 500)) == 0


def test_round_trip(spark, tmp_path):
    rows = awkward(random.Random(2))
    docs = documents(spark, rows, clash=True)
    shards = ts.token_shards(docs, shards=3)
    ts.write_store(shards, str(tmp_path / "store"), 3, 2)
    store, one = ts.TokenStore(str(tmp_path / "store")), plain(ts.TOKENIZER)
    want: dict[int, list] = {}
    for i, t, *_ in rows:
        if i is not None:
            want[i] = max(want.get(i, ""), t or "", key=lambda x: len(x.encode()))
    for i, t in want.items():
        assert store[i].tolist() == one(t)
    with pytest.raises(KeyError):
        store[999_999]
    out = shards.select("n_docs", "n_tokens").collect()
    assert sum(r["n_docs"] for r in out) == len(want) and sum(r["n_tokens"] for r in out) == sum(len(one(t)) for t in want.values())
    assert ts.token_shards(docs.limit(0)).count() == 0


def test_shards_by_bytes_and_repeated_ids(spark, tmp_path):
    """Few long texts make as many shards as many short ones; an id that a third of all rows have is stored once."""
    rng = random.Random(3)
    docs = documents(spark, [(i, words(rng, 20_000), "en", "s") for i in range(12)] + [(i % 5 + 50, f"text {i % 2}", "en", "s") for i in range(300)] + [(77, "hot row", "en", "s")] * 300)
    shards = ts.token_shards(docs, shard_bytes=200_000)
    out = shards.select("shard", "n_docs").collect()
    assert 5 <= len(out) <= 9 and sum(r["n_docs"] for r in out) == 18
    number = -(-docs.selectExpr("sum(octet_length(text))").first()[0] // 200_000)
    ts.write_store(shards, f"file://{tmp_path}/store", number, ts.id_bytes(ts.TOKENIZER))
    store, one = ts.TokenStore(f"file://{tmp_path}/store"), plain(ts.TOKENIZER)
    assert store[77].tolist() == one("hot row") and store[50].tolist() in (one("text 0"), one("text 1"))


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_tokenizers(spark, name):
    path = os.path.join(os.path.dirname(ts.TOKENIZER), name)
    row = ts.token_shards(documents(spark, [(1, "hello world", "en", "s")]), path).first()
    encode, size = ts.tokenizer(path)
    assert row["payload"] == encode(["hello world"])[0] and len(row["payload"]) == size * row["n_tokens"] > 0
