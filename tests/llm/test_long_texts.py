"""Texts with runs of a million characters and more."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from bazaarline.llm import bpe_chunks, storage, token_files
from bazaarline.llm.bpe_kernel import Encoder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
N = 1_050_000
PROSE = "the cat sat on the mat, "
TEXTS = [" " * N, "a" * N, " \n" * (N // 2), PROSE * 40 + " " * N + "end of it", PROSE * 40 + "x" + "\t" * N + PROSE]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def test_kernel_agrees_with_the_library(library):
    kernel = Encoder(BYTE_BPE)
    for text in TEXTS:
        assert kernel.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_queries_and_stage_take_long_runs(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    want = {k: library.encode(t, add_special_tokens=False).ids for k, t in enumerate(TEXTS)}
    for r in corpus_pipeline.tokens(spark, docs, "").collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(TEXTS[r.doc_id].encode()).hexdigest()
    got = {r.doc_id: r for r in token_files.read_documents(token_files.write_token_files(docs, storage.work_path(spark, "test-files"), BYTE_BPE)).collect()}
    for k, ids in want.items():
        assert got[k].n_tokens == len(ids) + 1 and got[k].ids_crc32 == zlib.crc32(np.array([*ids, 0], "<u4").tobytes())


def test_chunks_of_long_runs():
    for text in TEXTS:
        cut = bpe_chunks.chunks(text.encode())
        assert cut[0][0] == 0 and cut[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))


@pytest.mark.parametrize("space", [" ", "\n", " "])
def test_many_runs_below_the_limit(library, space):
    """The search for long runs takes linear time, and what it finds changes no id."""
    import time

    from bazaarline.llm.bpe_kernel import LONG, _needs_library

    text = ("x" + space * (LONG - 1)) * 50 + "end"
    began = time.time()
    assert not _needs_library(text) and _needs_library(text + space * LONG)
    assert time.time() - began < 5  # by squares it took fifteen minutes
    few = PROSE + ("x" + space * (LONG - 1)) * 2 + PROSE
    assert Encoder(BYTE_BPE).encode(few).tolist() == library.encode(few, add_special_tokens=False).ids
