from collections import defaultdict

import pytest

from tillsight.llm.common import id_bits, text_of
from tillsight.llm.sharding import extendible_shards, sharded_documents
from pyspark.sql import functions as F


def brute(rows, limit):
    """Split oversized buckets bit by bit. rows: (id, bits, bytes) -> id -> (shard, bytes, rows)."""
    out = {}

    def place(part, depth, prefix):
        total = sum(r[2] for r in part)
        if total <= limit or len(part) == 1 or depth == 60:
            out.update({r[0]: (prefix, total, len(part)) for r in part})
            return
        for bit in "01":
            half = [r for r in part if f"{r[1]:060b}"[depth] == bit]
            if half:
                place(half, depth + 1, prefix + bit)
    place(rows, 0, "")
    return out


@pytest.mark.parametrize("limit", [100, 3000, 10**9])
def test_matches_bit_by_bit_splitting(make_docs, limit):
    docs = make_docs([(i, "ab" * (5000 if i == 7 else i % 40)) for i in range(400)])
    rows = [tuple(r) for r in docs.select("doc_id", id_bits(), F.octet_length(text_of())).collect()]
    want = brute(rows, limit)
    got = {r.doc_id: (r.shard, r.shard_bytes, r.shard_rows) for r in sharded_documents(docs, limit).collect()}
    assert got == want


def test_a_few_bits_a_round_give_the_same_directory(make_docs):
    docs = make_docs([(i, "abc" * (i % 30)) for i in range(300)])
    rows = docs.select(F.struct("doc_id").alias("row"), id_bits().alias("bits"), F.octet_length(text_of()).cast("long").alias("n_bytes"))
    one = {(r.row.doc_id, r.shard) for r in extendible_shards(rows, 50, step=1).collect()}
    assert one == {(r.row.doc_id, r.shard) for r in extendible_shards(rows, 50, step=20).collect()}


def test_rows_that_no_bit_parts_go_to_overflow_pages(make_docs):
    docs = make_docs([(1, "x" * 30)] * 20 + [(2, "y")])
    got = sharded_documents(docs, 100).collect()
    pages = defaultdict(int)
    for r in got:
        pages[r.shard, r.page] += r.n_bytes
        assert r.shard_bytes <= 100
    assert len(got) == 21 and max(pages.values()) <= 100


def test_awkward_rows(awkward, clashing):
    assert sharded_documents(clashing(awkward)).count() == awkward.count()
    assert sharded_documents(awkward.where("false")).collect() == []
