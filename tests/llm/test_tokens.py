import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelot.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.BYTE_BPE_50K), reason="the vocabulary is not here")

TEXTS = [None, "", " ", "a", "naïve café", "日本語 テキスト", "👩‍👩‍👧 ​﻿", "<|endoftext|> is text", "x" * 200_000, "a\r\n\tb\n\n", "tail "]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumns({"ids": F.lit("clash"), "_text": F.lit(0)})


def test_round_trip_and_defined_ids(spark):
    ids = tokens.encode(frame(spark), "text", ["doc_id", "text", "ids"])
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert got[0] == [] and got[1] == [] and all(max(i, default=0) < 50256 for i in got.values())
    back = tokens.decode(ids, "ids", ["doc_id"]).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert all(not r["lead"] and not r["tail"] for r in back)
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(frame(spark), "text", ["doc_id"]).collect()}
    assert n == {i: len(x) for i, x in got.items()}


def test_agrees_with_another_library(spark):
    import base64

    import tiktoken

    folder = os.path.dirname(tokens.BYTE_BPE_50K)
    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(frame(spark), "text", ["doc_id"]).collect()}
    assert got == {i: other.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_offsets_map_bytes_to_characters(text):
    table = tokens.token_bytes(tokens.BYTE_BPE_50K)
    ids = tokens.load(tokens.BYTE_BPE_50K).encode(text, add_special_tokens=False).ids
    b0, b1, c0, c1 = tokens.offsets(ids, text, table)
    raw = text.encode()
    assert b"".join(table[i] for i in ids) == raw
    for i, a, z, s, e in zip(ids, b0, b1, c0, c1, strict=True):
        assert raw[a:z] == table[i]
        assert table[i] in text[s:e].encode() and len(text[s:e].encode()) - len(table[i]) < 8


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20), st.data())
def test_slices_inside_characters_join_exactly(text, data):
    raw = text.encode()
    cut = data.draw(st.integers(0, len(raw)))
    (t1, l1, r1), (t2, l2, r2) = tokens.split_characters(raw[:cut]), tokens.split_characters(raw[cut:])
    assert not l1 and not r2 and "�" not in (t1 + t2).replace("�" * text.count("�"), "")
    assert t1 + (r1 + l2).decode() + t2 == text


def test_offsets_column(spark):
    r = tokens.encode_with_offsets(frame(spark), "text", ["doc_id"]).filter("doc_id = 5").first()
    assert r["byte_end"][-1] == len(TEXTS[5].encode()) and r["char_end"][-1] == len(TEXTS[5])


def test_empty_table(spark):
    assert tokens.encode(frame(spark).limit(0), "text", ["doc_id"]).count() == 0


def test_encoder_gives_the_library_s_ids_and_is_much_faster():
    import time

    t, fast = tokens.load(tokens.BYTE_BPE_50K), tokens.encoder(tokens.BYTE_BPE_50K)
    by_library = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    odd = [x or "" for x in TEXTS] + [" " * 300_000 + "x", "\n" * 20_000, "it's we'll I'D \x1c\x85\u2028 ½ ²x", " \n \n  a  \n"]
    odd += ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in range(i, i + 256)) for i in range(0, 0x20000, 256) if not 0xD800 <= i < 0xE000]
    assert fast(odd) == by_library(odd)
    texts = [" ".join(f"word{i * k % 9973} parking lots, (closed)" for i in range(500)) for k in range(100)]
    began = time.process_time()
    want = by_library(texts)
    mid = time.process_time()
    assert fast(texts) == want
    assert time.process_time() - mid < 0.7 * (mid - began)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r'sdmtlvre\u00a0\u3000a1!"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encoder_agrees_with_the_library(text):
    ids = tokens.load(tokens.BYTE_BPE_50K).encode(text, add_special_tokens=False).ids
    assert tokens.encoder(tokens.BYTE_BPE_50K)([text]) == [ids]


def test_files_of_another_kind_go_to_the_library(tmp_path):
    import json

    with open(tokens.BYTE_BPE_50K, encoding="utf-8") as f:
        spec = json.load(f)
    assert tokens._in_merge_order(spec)
    assert not tokens._in_merge_order(spec | {"normalizer": {"type": "Lowercase"}})
    assert not tokens._in_merge_order(spec | {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}})
    other = spec | {"normalizer": {"type": "Lowercase"}}
    (tmp_path / "t.json").write_text(json.dumps(other))
    assert tokens.encoder(str(tmp_path / "t.json"))(["PARKING"]) == tokens.encoder(tokens.BYTE_BPE_50K)(["parking"])
