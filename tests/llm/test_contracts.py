"""Packing and its encoder against the vocabulary's own library; tables without rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import chat, decontaminate, langid, linededup, neardup, packing, token_counts, tokens

ODD = ["", " ", "\n\n \t x", "it's WE'LL don't", "<|endoftext|>", "a<|endoftext|>b <| c", "naïve café ÿ ɏ", "привет мир 123", "漢字 kana かな 한글", "😀 x 👩‍👩‍👧 y", "a\x00b\x1fc\x7f", "   wide　", "é ‍ ﻿ \U000e0041", "12345678 1,234.5", "\r\n\r\n", "x" * 5000, "ab " * 40_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder(library):
    encode = tokens.encoder()
    for text in ODD:
        assert encode(text) == plain(library, text), text[:40]
    assert encode(None) == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  \t\n\r'.,<|>aAbsStTlL019"), st.characters(max_codepoint=0x24F), st.characters(min_codepoint=0x400, max_codepoint=0x4FF), st.characters(min_codepoint=0x2010, max_codepoint=0x2027), st.characters(min_codepoint=0x4E00, max_codepoint=0x9FFF), st.characters(exclude_categories=["Cs"]))))
def test_encoder_on_any_text(text):
    made = tokens._held(("exact", tokens.VOCABULARY, False), lambda: Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert tokens.encoder()(text) == plain(made, text)


def test_packing_is_whole(spark, library):
    """Every id in one piece, checksums, gapless offsets, and little padding."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("aeioklmnrst") for _ in range(rng.randrange(2, 9)))
    texts = [*ODD, None, *(" ".join(word() for _ in range(int(rng.lognormvariate(5, 1.2)) + 1)) for _ in range(300))]
    docs = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in enumerate(texts)], "doc_id long, text string, size long, start long, offset long").repartition(5)
    rows = [r.asDict() for r in packing.pack(docs, with_ids=True).collect()]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(range(len(texts)))
    for k, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        want = plain(library, texts[k]) + [1]
        assert [i for r in pieces for i in r["ids"]] == want
        assert [r["start"] for r in pieces] == [sum(x["length"] for x in pieces[:j]) for j in range(len(pieces))]
        assert all(r["doc_tokens"] == len(want) and r["length"] == len(r["ids"]) > 0 for r in pieces)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in pieces)
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:j]) for j in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1.03 * total / 2048 + 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_tables_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, n long, key long")
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert neardup.link_documents(docs).count() == neardup.drop_near_duplicates(docs).count() == 0
    assert linededup.drop_repeated_lines(docs).count() == linededup.drop_repeated_passages(docs).count() == 0
    assert decontaminate.leaks(docs, bench).count() == decontaminate.drop_contaminated(docs, bench).count() == 0
    assert langid.identify(docs, langid.fit(docs)).count() == token_counts.count_documents(docs).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.repair(turns).count() == 0
