import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from biaslens.llm import bpe, tokens
from biaslens.llm import bytelevel as bl

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# U+0558 and U+088F: unassigned for the tokenizer libraries; U+0085, U+3000: spaces
TRICKY = ["a", "B", " ", "  ", "\n", "\t", "'s", "'ll", "é", "՘", "࢏", "日本", "😀", "!!", "12", " ",
          "　", "<|endoftext|>", "<|", "\x1c", "the", "aaaa", "\u0085", "́", "|>"]


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    ranks = bpe.read_ranks(RANKS)
    return bpe.Encoder(bpe.library_model(ranks).to_str(), bl.odd_characters(), ranks)


@pytest.fixture(scope="module")
def counter():
    with open(VOCABULARY, encoding="utf-8") as f:
        spec = f.read()
    odd = bl.odd_characters()
    return tokens.Counter(spec, tokens.whole_tokens(Tokenizer.from_str(spec), bl.Pieces(odd)), odd)


def fuzz(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(TRICKY, k=rng.randint(0, 30))) for _ in range(n)]


def test_counts_equal_the_library(counter):
    texts = fuzz(4000)
    library = Tokenizer.from_file(VOCABULARY)
    assert counter(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_small_tables_give_the_same_counts(counter, monkeypatch):
    texts = fuzz(500, 3)
    before = counter(texts)
    monkeypatch.setattr(tokens, "UNIT_ENTRIES", 3)
    monkeypatch.setattr(tokens, "MERGED_ENTRIES", 3)
    assert counter(texts) == before


def test_ids_equal_the_rank_library(encoder, reference):
    texts = fuzz(4000, 11)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert list(ids) == reference.encode_ordinary(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(encoder, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    (ids,) = encoder.encode([text])
    assert list(ids) == reference.encode_ordinary(text)
    decoder = bpe.Decoder(bpe.read_ranks(RANKS)) if not hasattr(encoder, "decoder") else encoder.decoder
    encoder.decoder = decoder
    assert decoder.bytes(ids.tolist()) == text.encode()
    assert decoder.text(ids.tolist()) == text
    assert "".join(decoder.stream(ids.tolist())) == text


def test_offsets_span_the_characters(encoder):
    for text in ["", "héllo wörld 😀 日本語 x", "😀" * 5, "  a\n\n b"]:
        ids, spans = encoder.encode_with_offsets(text)
        (plain,) = encoder.encode([text])
        assert list(ids) == list(plain) and len(spans) == len(ids)
        covered = {i for a, b in spans for i in range(a, b)}
        assert covered == set(range(len(text)))
        for i, (a, b) in zip(ids, spans):  # a token's bytes lie in its characters
            raw = next(t for t, r in encoder.whole.items() if int.from_bytes(r, "little") == i)
            assert raw in text[a:b].encode()


def test_split_character_is_held_back(encoder):
    decoder = bpe.Decoder(bpe.read_ranks(RANKS))
    one_byte = [decoder.table.index(bytes([b])) for b in "😀".encode()]
    assert list(decoder.stream(one_byte)) == ["😀"]
    assert decoder.text(one_byte[:2]) == "�"


ROWS = [(1, "Hello world", "x"), (2, None, None), (3, "", "y"), (1, "Hello world", "x"), (None, "a <|endoftext|> b", "z"),
        (4, "word " * 30_000, "q"), (5, "՘ odd", None)]


def test_token_count_rows(frame, counter):
    df = frame("doc_id long, text string, N_Tokens string", ROWS)
    out = tokens.with_token_counts(df, VOCABULARY)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    got = sorted(map(tuple, out.collect()), key=repr)
    want = sorted(((i, t, len((t or "").encode()), counter([t or ""])[0], counter([t or ""])[0] > 512)
                   for i, t, _ in ROWS), key=repr)
    assert got == want


def test_encoded_rows(frame, reference):
    df = frame("doc_id long, text string, ids string", ROWS)
    out = bpe.encoded(df, RANKS)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_one_python_evaluation_gives_ids_bytes_and_offsets(frame, reference):
    df = frame("doc_id long, text string, Starts string", ROWS)
    out = bpe.encoded(df, RANKS, offsets=("starts", "ends"))
    assert out.columns == ["doc_id", "text", "ids", "decoded", "starts", "ends"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    for r in out.collect():
        raw = [reference.decode_single_token_bytes(i) for i in r.ids]
        assert b"".join(raw) == bytes(r.decoded) == (r.text or "").encode()
        assert all(t in r.text[a:b].encode() for t, a, b in zip(raw, r.starts, r.ends))


def test_a_forgetful_encoder_gives_the_same(encoder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 500)
    for text, ids in zip(fuzz(300, 5), encoder.encode(fuzz(300, 5))):
        assert list(ids) == reference.encode_ordinary(text)
    assert encoder.held < 20_000


def test_registered_queries_equal_the_libraries(spark, reference):
    from biaslens.llm import queries
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    library = Tokenizer.from_file(VOCABULARY)
    for r in queries.op1_token_counts(spark, "/root/testdata/sf0.001").collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    for r in queries.op7_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_offsets_column_and_null_ids(spark, frame):
    codec = bpe.Codec(spark, RANKS)
    (row,) = frame("text string", [("héé",)]).select(codec.encode_with_offsets("text").alias("e")).collect()
    assert row.e.ends[-1] == 3 and row.e.starts[0] == 0
    (row,) = frame("ids array<int>", [(None,)]).select(codec.decode("ids").alias("d")).collect()
    assert bytes(row.d) == b""


def test_empty_table(empty_docs):
    assert tokens.with_token_counts(empty_docs, VOCABULARY).count() == 0
    assert bpe.encoded(empty_docs, RANKS).select(F.size("ids")).count() == 0
