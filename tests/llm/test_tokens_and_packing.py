import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.bpe import ChunkEncoder, encode_texts, token_counts, vocabulary_path
from lodestone.llm.packing import best_fit, pack, pack_texts

ODD = ["", " ", "   ", "\n\n \t x", "a  b   c", " lead", "trail ", "it's we'll 'S 'll", "日本語 テスト、でした。", "é ​ ﻿", "<|endoftext|> hi", "aaaa aaaaa aaaaaaa", "x" * 3000, "a\x1c b\x85 c　d", "👍👍👍 ok", "1234567 12,5", "word." * 50, "\r\n\r\n a \r\n b"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def split(ids, offsets):
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_odd_texts_equal_the_public_tokenizer(reference):
    assert split(*ChunkEncoder(vocabulary_path()).encode(ODD)) == reference(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab '.\n\t", max_size=60)), max_size=6))
def test_any_text_equals_the_public_tokenizer(texts):
    encoder = ChunkEncoder(vocabulary_path())
    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    assert split(*encoder.encode(texts)) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert split(*encoder.encode(texts)) == split(*ChunkEncoder(vocabulary_path()).encode(texts))  # what is cached is the same


def test_corpus_with_nulls_repeats_and_clashing_columns(spark, reference):
    rows = [(i, t, "x", 1) for i, t in enumerate([*ODD, None, None, "same", "same"])] + [(0, "", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, k int")
    got = [(r.doc_id, list(r.ids)) for r in encode_texts(df).collect()]
    expected = [(i, reference([t])[0] if t else []) for i, t, _, _ in rows]
    assert sorted(got) == sorted(expected)
    assert encode_texts(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts(df).collect()) == sorted((i, len(x)) for i, x in expected)
    assert encode_texts(df.limit(0)).count() == 0


def test_whole_table_equals_the_public_tokenizer(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    expected = dict(zip(texts, reference(list(texts.values()))))
    assert {r.doc_id: list(r.ids) for r in encode_texts(docs).collect()} == expected


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rnd = random.Random(1)
    sizes = np.array(sorted((rnd.randrange(0, 65) for _ in range(600)), reverse=True))
    where = best_fit(sizes, 64, 5, 3000.0, rule)
    for b in range(where.max() + 1):
        own = sizes[where == b]
        assert 0 < len(own) <= 5 and own.sum() <= 64 and ((own.astype(float) ** 2).sum() <= 3000 or len(own) == 1)


def test_packing_covers_each_item_once_and_cuts_only_long_ones(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 1, 5, 63, 64, 65, 128, 129, 1000, rnd.randrange(64)])) for i in range(500)] + [(900, None), (901, -3), (7, 20)]
    df = spark.createDataFrame(rows, "id bigint, n bigint").withColumn("size", F.lit("clash")).withColumn("shard", F.lit(1))
    got = pack(df, "id", "n", capacity=64, max_items=8, shard_rows=100).collect()
    fill = {}
    for r in got:
        fill.setdefault(r.container_id, []).append(r.size)
    assert all(sum(x) <= 64 and len(x) <= 8 for x in fill.values())
    by_id = {}
    for r in got:
        by_id.setdefault(r.id, []).append((r.piece_no, r.start, r.size))
    for i in {i for i, _ in rows}:
        wanted = sorted(max(n or 0, 0) for j, n in rows if j == i)
        pieces = sorted(by_id[i])
        if len(wanted) == 1:
            assert sum(p[2] for p in pieces) == wanted[0] and (len(pieces) == 1 or wanted[0] > 64)
            assert all(start == no * 64 for no, start, _ in pieces)
        else:
            assert sum(p[2] for p in pieces) == sum(wanted)
    again = pack(df.repartition(7), "id", "n", capacity=64, max_items=8, shard_rows=100).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert pack(df.limit(0), "id", "n").count() == 0


def test_texts_leave_little_room(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pack_texts(docs)
    r = got.agg(F.sum("size").alias("s"), F.countDistinct("container_id").alias("c"), F.countDistinct("doc_id").alias("d")).first()
    assert r.d == docs.count() and r.s / (r.c * 1024) > 0.97
