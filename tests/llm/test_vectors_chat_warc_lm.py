import base64
import glob
import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import plain
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biaslens.llm import chat, lm, vectors, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# --- vectors ---------------------------------------------------------------

def clustered(seed, n=1500, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for c in range(40):  # groups of near copies of several sizes and widths
        at = rng.integers(n)
        for _ in range(rng.integers(1, 12)):
            x[rng.integers(n)] = x[at] * rng.uniform(0.5, 2) + rng.standard_normal(dim) * rng.uniform(0, 0.25)
    x[100:400] = x[7] + rng.standard_normal((300, dim)) * 0.05
    return x


def test_links_against_brute_force(frame):
    x = clustered(1)
    rows = vectors.near_duplicates(frame("vec_id long, embedding array<double>, label int",
                                         [(i, v.tolist(), i % 3) for i, v in enumerate(x)]), window=32).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T) >= 0.95
    degree = near.sum(axis=1) - 1
    found = {r.vec_id: r for r in rows}
    assert sum(r.n_links for r in rows) >= 0.97 * degree.sum()
    assert all(found[i].n_links <= degree[i] for i in range(len(x)))  # none below the bound
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    parts = plain.Union(range(len(x)))
    for a, b in zip(*np.nonzero(near)):
        parts.join(int(a), int(b))
    assert sum(found[i].component_id == parts.root(i) for i in range(len(x))) >= 0.97 * len(x)


def test_vectors_that_cannot_link(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [2.0, 4.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (None, None), (10, [-1.0, -2.0]), (11, [-0.0, 3.0]), (12, [0.0, 3.0])]
    got = sorted((tuple(r) for r in vectors.near_duplicates(frame("vec_id long, embedding array<float>, n_links int",
                                                                  [(*r, 1) for r in rows])).collect()), key=repr)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False), (None, 0, None, True), (11, 1, 11, True),
            (12, 1, 11, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted(want, key=repr)


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_passes_grow_with_the_logarithm():
    assert vectors.passes_for(100, 256, 0.95, 0.999) == 1
    few, many = (vectors.passes_for(n, 256, 0.95, 0.999) for n in (10 ** 5, 10 ** 9))
    assert 5 < few < many < 120


def dense_rows(n=1500, dense=700, dim=24, seed=5):
    """A group of distinct near copies (pairwise cosine above 0.95) among others."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[:dense] = rng.standard_normal(dim) + rng.standard_normal((dense, dim)) * 0.13
    return x


def test_partition_borders_change_nothing(spark):
    x = dense_rows()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    degree = ((u @ u.T) >= 0.95).sum(axis=1) - 1
    assert degree[:700].mean() > 600
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    results = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            results.append({r.vec_id: tuple(r) for r in vectors.near_duplicates(df.repartition(int(parts)), window=16).collect()})
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert results[0] == results[1]
    assert sum(r[1] for r in results[0].values()) >= 0.999 * degree.sum()


def test_crowded_cone_gets_more_passes(frame):
    """A third of the rows at pairwise cosine 0.87, in it 100 pairs at 0.952: too
    few links for a search that widens only where blocks link."""
    rng = np.random.default_rng(8)
    n, cone, pairs, dim = 30000, 10000, 100, 64

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    e = rng.standard_normal((cone, dim))
    e[:, 0] = 0
    e = unit(e)
    old, new = e[:2 * pairs:2], e[1:2 * pairs:2]
    new = unit(new - (new * old).sum(axis=1, keepdims=True) * old)
    e[1:2 * pairs:2] = 0.631 * old + math.sqrt(1 - 0.631 ** 2) * new
    x = rng.standard_normal((n, dim))
    x[:cone] = math.sqrt(0.13) * e
    x[:cone, 0] = math.sqrt(0.87)
    rows = vectors.near_duplicates(frame("vec_id long, embedding array<double>", [(i, v.tolist()) for i, v in enumerate(x)])).collect()
    lowest = {r.vec_id: r.component_id for r in rows}
    assert sum(lowest[i] == lowest[i + 1] for i in range(0, 2 * pairs, 2)) >= 0.997 * pairs


def test_missing_a_partner_is_estimated_rightly():
    rng = np.random.default_rng(2)
    u = rng.standard_normal((20000, 24))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal(u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    v = 0.95 * u + math.sqrt(1 - 0.95 ** 2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    planes = vectors.hyperplanes(24, 0, 11)
    same = ((u @ planes >= 0) == (v @ planes >= 0))[:, :7].all(axis=1).mean()
    assert abs(1 - np.exp(vectors._missed(u, planes, np.full(len(u), 7), 0.95)).mean() - same) < 0.03


# --- chat ------------------------------------------------------------------

@given(st.text(alphabet="<|\\>imend_startsep\n é", max_size=40))
def test_escape_is_reversible_and_hides_marks(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)


CONVERSATIONS = [
    (1, 0, "user", "Hello"), (1, 1, "assistant", "Hi!\n\nyou <|im_end|> \\<\\| there"), (1, 2, "assistant", "again 😀 é"),
    (2, None, "system", None), (2, 0, None, "no role"), (2, 0, None, "no role"), (2, 1, "assistant", ""), (2, 2, "assistant", None),
    (None, 3, "assistant", "of nobody"), (None, 1, "user", " lead and trail "), (3, 5, "assistant", "<"), (3, 6, "assistant", "|x"),
    (4, 0, "<|im_start|>assistant", "<|endoftext|><|im_sep|>"), (5, 1, "assistant", "\n"), (5, 0, "user", "\n")]


def test_conversations_read_back(frame):
    rows = CONVERSATIONS + [(9, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 7)) for i in range(200)]
    df = frame("conv_id long, turn long, role string, text string, part string", [(*r, "x") for r in rows])
    parts = chat.formatted(df, VOCABULARY, turns_per_part=16)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(parts, VOCABULARY).collect()}
    assert got == plain.conversations(rows)
    assert parts.where("conv_id = 9").count() == 13
    for r in parts.collect():
        assert len(r.ids) == len(r.mask)


def test_parts_give_the_tokens_of_the_whole():
    with open(VOCABULARY, encoding="utf-8") as f:
        c = chat.Chat(f.read())
    turns = [(r or "", t or "") for _, _, r, t in CONVERSATIONS]
    (whole, _), = c.encode([chat.render(turns)[0]])
    pieces = [i for k in range(0, len(turns), 3) for ids, _ in c.encode([chat.render(turns[k:k + 3])[0]]) for i in ids]
    assert pieces == whole and c.turns(whole) == turns


def test_mask_is_the_overlap():
    offsets = np.array([[0, 2], [2, 5], [5, 6], [5, 6], [6, 9], [9, 9], [9, 12]])
    assert chat.mask([(2, 6), (9, 12)], offsets).tolist() == [False, True, True, True, False, False, True]
    assert chat.mask([], offsets).sum() == 0


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(empty, VOCABULARY), VOCABULARY).count() == 0


# --- WARC ------------------------------------------------------------------

PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/\r\nX: y", "<p>one</p>"), (3, None, None), (4, "http://d/%41 é", ""),
         (5, "http://e/", "WARC/1.1\r\n\r\n" * 50), (None, "http://f/", "<p>one</p>"), (1, "http://a/", "<p>one</p>"), (None, None, "lonely"),
         (7, "u", "x" * 300_000)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_round_trip(spark, frame, tmp_path, compression):
    warc.register(spark)
    df = frame("page_id long, url string, html string, record_type string", [(*p, "z") for p in PAGES])
    path = str(tmp_path / "w")
    warc.records(df).write.format("warc").option("compression", compression).mode("append").save(path)
    back = spark.read.format("warc").load(path)
    rows = back.collect()
    assert len(rows) == len(PAGES) and not glob.glob(f"{path}/_job*")
    ends = ".warc.gz" if compression == "gzip" else ".warc"
    assert all(f.endswith(ends) for f in glob.glob(f"{path}/part*"))
    text = {p[0]: (p[2] or "").encode() for p in PAGES if p[0]}
    firsts = Counter((r.record_type, r.record_id, r.refers_to) for r in rows)
    assert firsts == Counter({("response", "1", None): 2, ("revisit", "2", "1"): 1, ("revisit", "", "1"): 1, ("response", "3", None): 1,
                              ("revisit", "4", "3"): 1, ("response", "5", None): 1, ("response", "", None): 1, ("response", "7", None): 1})
    for r in rows:
        if r.record_type == "response":
            assert r.payload_length == len(r.payload)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
            if r.record_id:
                assert r.payload == text[int(r.record_id)]
        else:
            assert r.payload is None
    assert {r.target_uri for r in rows} == {p[1] for p in PAGES}


def test_pushdown_passes_payloads_over(spark, frame, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "w")
    warc.records(frame("page_id long, url string, html string", PAGES)).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path)
    only = read.where((F.col("record_type") == "revisit") & (F.col("record_id") == "4"))
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert [(r.record_id, r.refers_to) for r in only.collect()] == [("4", "3")]
    assert read.where(F.col("target_uri").startswith("http://b")).count() == 1
    assert read.where(F.col("refers_to").isNull()).count() == 6
    assert read.where(F.col("record_id").isin("5", "7")).count() == 2
    assert read.where("payload_length > 1000").count() == 1  # not pushed, Spark filters
    bare = spark.read.format("warc").option("payload", "false").load(path)
    assert bare.where(F.col("payload").isNotNull()).count() == 0 and bare.count() == len(PAGES)


def test_partitions_and_foreign_files(spark, tmp_path):
    raw = warc.record_bytes({"record_type": "response", "record_id": "1", "payload": b"a\r\n\r\nb"})
    other = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:7>\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    for i in range(5):
        (tmp_path / f"{i}.warc").write_bytes(raw * 3 + other)
        (tmp_path / f"{i}.warc.gz").write_bytes(gzip.compress(raw) + gzip.compress(other))
    warc.register(spark)
    df = spark.read.format("warc").option("partitionBytes", "1000").load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 2
    assert Counter(r.record_type for r in df.collect()) == {"response": 20, "resource": 10}
    assert {bytes(r.payload) for r in df.collect()} == {b"a\r\n\r\nb", b"xyz"}
    (tmp_path / "cut.warc").write_bytes(raw[:40])
    with pytest.raises(Exception, match="inside a record"):
        spark.read.format("warc").load(str(tmp_path)).collect()


def test_base32_and_least_bytes(frame):
    df = frame("page_id long, url string, html string", PAGES)
    rows = warc.records(df, least_bytes=5).collect()
    for r in rows:
        if r.payload is not None:
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
    assert all(r.record_type == "response" for r in rows if r.payload_length < 5)


def test_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- language model --------------------------------------------------------

SMALL = lm.Settings(classes=60, head=90, dim=8, noise=16, batch=256, rate=0.2)


def lm_docs(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        state, w = 0, []
        for _ in range(rng.randint(0, 60)):  # each word depends on the one before
            state = (state * 3 + rng.choice([1, 1, 1, 2])) % 40
            w.append(f"S{state}" if rng.random() < 0.9 else f"rare{rng.randrange(300)}")
        out.append((i, " ".join(w)))
    return out


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_counts_and_base_scores(frame):
    docs = lm_docs() + [(None, "s1 s2"), (500, None), (501, ""), (0, "S1 again and unseen123"), (0, "S1 again and unseen123")]
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    df = frame("doc_id long, text string, score string", [(*d, "x") for d in docs])
    rows = lm.scored_documents(df, train, settings=SMALL).collect()
    count = Counter(w for i, t in docs if i is None or not held_out(i) for w in [*plain.lowered(t), None])
    n, v = sum(count.values()), len(count)
    want = sorted(((i, i is not None and held_out(i), len(plain.lowered(t)) + 1, sum(count[w] > 0 for w in [*plain.lowered(t), None]), n,
                    round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*plain.lowered(t), None]), 6)) for i, t in docs), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr)
    assert got == want


def test_model_learns_the_order_of_words(frame):
    docs = lm_docs(1500)
    df = frame("doc_id long, text string", docs)
    rows = lm.scored_documents(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, settings=SMALL).collect()
    held = [r for r in rows if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.1


def test_probabilities_add_up_to_one():
    frequency = np.random.default_rng(1).random(30)
    model = lm.Model.start(frequency / frequency.sum(), lm.Settings(dim=6))
    model = model.with_flat(model.flat() * 3)
    s1, s2, log_z = model.tables()
    p = np.exp(s1[:, None, :] + s2[None, :, :] - log_z[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)


def test_contexts_stop_at_documents():
    one, two = lm.contexts(np.array([5, 6, 7, 1, 1, 8, 1]), np.array([4, 5, 7]))
    assert one.tolist() == [2, 5, 6, 7, 2, 2, 8] and two.tolist() == [2, 2, 5, 6, 2, 2, 2]


def test_no_documents_or_no_training(spark, frame):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scored_documents(empty, F.lit(True), settings=SMALL).count() == 0
    rows = lm.scored_documents(frame("doc_id long, text string", [(1, "a b"), (2, None)]), F.lit(False), settings=SMALL).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and r.held_out for r in rows)
