import zlib

import hypothesis.strategies as st
import numpy as np
import pytest
from hypothesis import given, settings

from gridtrace.llm import packing as P


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def slow():
    return tokenizer()


def whole_ids(text, held=[]):  # noqa: B006
    """A whole document's ids by the tokenizers file."""
    held or held.append(tokenizer())
    return held[0].encode(text or "", add_special_tokens=False).ids


ENCODE = P.encoder()


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "don't", "é", "12", "the", "\t\t", "日本", "  "]), max_size=20).map("".join)))
def test_ids_as_by_tokenizers(slow, text):
    assert ENCODE(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=200))
def test_assign_fills_and_covers(lengths):
    pieces = P.assign(lengths, 64)
    took = [0] * len(lengths)
    rooms: dict[int, int] = {}
    for i, at, n, s in pieces:
        assert n > 0 and at == took[i]
        took[i] += n
        rooms[s] = rooms.get(s, 0) + n
    assert took == lengths
    assert all(n <= 64 and (n == 64 or n & (n - 1) == 0) for n in rooms.values())


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 512, 4000).tolist()
    cost: dict[int, float] = {}
    for _, _, n, s in P.assign(lengths, 2048):
        cost[s] = cost.get(s, 0) + n + n * n / 1024
    full = np.array(list(cost.values()))
    assert full.std() / full.mean() < 0.1


def test_table_with_odd_rows(spark):
    long = "the quick brown fox " * 30_000
    rows = [(1, None, 0), (2, "", 0), (None, "hello", 0), (3, long, 0), (4, "hello", 0), (4, "hello", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = P.pack(df, keep_ids=True).collect()
    assert {r.doc_id for r in got} == {1, 2, None, 3, 4}
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)
    whole = [i for r in sorted((r for r in got if r.doc_id == 3), key=lambda r: r.start) for i in r.ids]
    assert whole == [*ENCODE(long), 1]
    assert P.pack(df.limit(0)).collect() == []


def test_query_is_whole(spark):
    from conftest import SF_SMALL

    from gridtrace.llm.queries import op10_packing

    texts = dict(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = op10_packing(spark, SF_SMALL).collect()
    by, seqs = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert by.keys() == texts.keys()
    for d, rows in by.items():
        ids = np.append(whole_ids(texts[d]), 1).astype("<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
