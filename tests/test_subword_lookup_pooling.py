"""Subword encoding, bundled look-up, masked pooling, bucketed artefacts,
reruns of one fold, scoring in planned batches."""

import os
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biaslens.operators import auc, encode, features, lookup, order, subword
from biaslens.operators import vectors as vec
from biaslens.plans import score
from biaslens.sources import io

VOCABULARY = {t: i for i, t in enumerate(
    ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "un", "##aff", "##able", "a", "##a", "##b", "##ab", "b", "ab", "the", "##s", "!",
     "日", "##日", ",", "cafe", "#", "##,"])}


def plain_words(text):
    """The rule, character by character."""
    out = []
    for ch in text:
        kind = unicodedata.category(ch)
        if ch in "\t\n\r" or kind == "Zs":
            out.append(" ")
        elif ch in "\x00�" or kind[0] == "C":
            continue
        elif any(a <= ord(ch) <= b for a, b in subword.IDEOGRAPHS):
            out.append(f" {ch} ")
        else:
            out.append(ch)
    found = []
    for token in "".join(out).split():
        if token in subword.NEVER_CUT:
            found.append(token)
            continue
        bare = [c for c in unicodedata.normalize("NFD", token.lower()) if unicodedata.category(c) != "Mn"]
        word = ""
        for c in bare:
            if unicodedata.category(c)[0] == "P" or re.match(r"[!-/:-@\[-`{-~]", c):
                found += [word, c]
                word = ""
            elif c.isspace():
                found, word = [*found, word], ""
            else:
                word += c
        found.append(word)
    return [w for w in found if w]


def plain_pieces(word, vocabulary):
    if word in subword.NEVER_CUT and word in vocabulary:
        return [vocabulary[word]]
    if len(word) > 100:
        return [1]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(vocabulary[piece])
                at = end
                break
        else:
            return [1]
    return out


ATOMS = ["un", "aff", "able", "a", "b", "ab", "the", "s", "!", ",", " ", "\n", "日", "É", "é", "café", "[MASK]", " [SEP] ", "#", "##",
         "​", " ", " ", "Σ", "ﬁ", "\x1c", "x" * 101]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ATOMS), max_size=14).map("".join) | st.text(max_size=30))
def test_pieces_equal_the_rule(text):
    assert subword.words(text) == plain_words(text)
    want = [i for w in plain_words(text) for i in plain_pieces(w, VOCABULARY)]
    assert subword.Subwords(VOCABULARY).text(text) == want


def vocabulary_table(spark, entries=VOCABULARY):
    return spark.createDataFrame(list(entries.items()), "token string, token_id int")


def test_layouts(spark):
    rows = [(1, "unaffable cafés the the ab"), (2, None), (3, ""), (4, "zzz"), (5, "a b " * 4000)]
    df = spark.createDataFrame(rows, "id long, comment_text string").repartition(3)
    v = vocabulary_table(spark)
    flat = {i: [p for w in plain_words("nan" if t is None else t) for p in plain_pieces(w, VOCABULARY)] for i, t in rows}
    for r in subword.encode_wordpiece(df, v, max_len=8).collect():
        kept = flat[r.id][:6]
        assert r.token_ids == [2, *kept, 3] + [0] * (6 - len(kept))
    for r in subword.encode_wordpiece(df, v, max_len=8, mode="plain").collect():
        assert r.token_ids == (flat[r.id][:6] + [0] * 6)[:6]
    for r in subword.encode_wordpiece(df, v, max_len=8, mode="head_tail").collect():
        ids = flat[r.id]
        kept = ids if len(ids) <= 6 else ids[:2] + ids[-4:]
        assert r.token_ids == [2, *kept, 3] + [0] * (6 - len(kept)) and r.pad_mask == [0] * len(kept) + [1] * (6 - len(kept))
    lying = spark.createDataFrame(rows, "id long, comment_text string")
    assert "Exchange" not in subword.encode_wordpiece(lying, v)._jdf.queryExecution().executedPlan().toString()


def test_vocabularies_are_checked(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a")], "id long, comment_text string")
    with pytest.raises(ValueError, match=r"no \[CLS\]"):
        subword.encode_wordpiece(df, vocabulary_table(spark, {k: v for k, v in VOCABULARY.items() if k != "[CLS]"}))
    monkeypatch.setattr(subword, "MAX_ENTRIES", 3)
    with pytest.raises(ValueError, match="too large"):
        subword.encode_wordpiece(df, vocabulary_table(spark))


# --- look-up -------------------------------------------------------------

@pytest.mark.parametrize("frequent, bundle", [(0, 3), (6, 2), (65_536, 200_000)])
def test_lookup_equals_a_dictionary(spark, monkeypatch, frequent, bundle):
    monkeypatch.setattr(lookup, "FREQUENT", frequent)
    monkeypatch.setattr(lookup, "BUNDLE_TOKENS", bundle)
    rng = random.Random(2)
    entries = {f"t{i}": 4 + i for i in range(20)}
    rows = [(i, [f"t{rng.randint(0, 30)}" for _ in range(rng.randint(0, 9))]) for i in range(200)]
    rows += [(900, None), (901, []), (902, ["t1"] * 500), (903, [None, "t2", "ab" * 60]), (None, ["t3", "none"])]
    df = spark.createDataFrame(rows, "id long, toks array<string>").repartition(5)
    v = vocabulary_table(spark, entries)
    got = {r.id: r.ids for r in lookup.lookup_ids(df, "id", "toks", v).collect()}
    assert got == {i: [entries.get(t, 1) for t in toks or []] for i, toks in rows}
    strings = df.select(F.col("id").cast("string").alias("name"), "toks")
    assert lookup.lookup_ids(strings, "name", "toks", v, "out").columns == ["name", "out"]
    assert lookup.lookup_ids(df.where("id < 0"), "id", "toks", v).count() == 0


# --- pooling -------------------------------------------------------------

def test_pooling_of_positions(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(30):
        n = int(rng.integers(1, 7))
        rows.append((i, rng.normal(size=(n, 3)).tolist(), rng.integers(0, 2, n).tolist()))
    rows += [(100, [], []), (101, [[1.0, 2.0, 3.0], None, [3.0, 4.0, 5.0]], [1, 1, None]), (102, None, None),
             (103, [[1.0, 1.0, 1.0]], [0])]
    df = spark.createDataFrame(rows, "id int, h array<array<double>>, m array<int>")
    out = df.select("id", vec.pool_positions("h").alias("mean"), vec.pool_positions("h", "m").alias("masked"),
                    vec.pool_positions("h", "m", "max").alias("top"), vec.pool_positions("h", last=2).alias("last"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan

    def close(got, rows_):
        return (got is None) if not len(rows_) else np.allclose(got, rows_)

    for (i, h, m), r in zip(rows, out.collect()):
        there = [x for x in h or [] if x is not None]
        kept = [x for x, k in zip(h or [], m or []) if x is not None and k == 1]
        assert close(r["mean"], np.mean(there, axis=0) if there else [])
        assert close(r["masked"], np.mean(kept, axis=0) if kept else [])
        assert close(r["top"], np.max(kept, axis=0) if kept else [])
        assert close(r["last"], np.mean(there[-2:], axis=0) if there else [])
    with pytest.raises(ValueError):
        vec.pool_positions("h", how="min")


# --- artefacts -----------------------------------------------------------

def test_bucketed_artefacts_meet_without_an_exchange(spark, tmp_path):
    a = spark.range(300).select("id", (F.col("id") * 2).alias("x"))
    b = spark.range(300).select("id", (F.col("id") + 1).alias("y"))
    left = io.read_bucketed(spark, io.write_bucketed(a, str(tmp_path / "a"), buckets=4))
    right = io.read_bucketed(spark, io.write_bucketed(b, str(tmp_path / "b"), buckets=4))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        j = features.aligned(left, right, "id", null_keys=False)
        assert "Exchange" not in j._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, j.collect())) == [(i, 2 * i, i + 1) for i in range(300)]
        with pytest.raises(Exception, match="partner"):
            features.aligned(left, right.where("id <> 7"), "id", null_keys=False).collect()
        p = spark.range(200).select("id", (F.col("id") % 7 / 7).alias("prediction"))
        t = spark.range(200).select("id", (F.col("id") % 3 / 3).alias("target"), F.lit(1.0).alias("male"))
        cfg = __import__("biaslens.config", fromlist=["x"]).BiasConfig(identity_columns=("male",))
        p, t = (io.read_bucketed(spark, io.write_bucketed(x, str(tmp_path / n), buckets=4)) for x, n in ((p, "p"), (t, "t")))
        met = features.aligned(t, p.select("id", F.col("prediction").alias("_score")), "id", False)
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
        one = auc.scoring_valid(p, t, cfg, null_keys=False)[1].first()
        assert one == auc.scoring_valid(p, t, cfg)[1].first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    files = [f for f in os.listdir(tmp_path / "a") if f.endswith(".parquet")]
    assert len(files) == 4
    with pytest.raises(Exception, match="null"):
        io.write_bucketed(a.select(F.when(F.col("id") > 3, F.col("id")).alias("id")), str(tmp_path / "n"))


def test_rerun_of_one_fold_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "oof")
    io.write_artefact(spark.range(90).select("id", (F.col("id") % 3).alias("fold")), path, "fold")

    def files(fold):
        d = f"{path}/fold={fold}"
        return {f: open(f"{d}/{f}", "rb").read() for f in os.listdir(d) if f.endswith(".parquet")}

    before = {k: files(k) for k in range(3)}
    io.write_artefact(spark.range(5).select("id", F.lit(2).cast("long").alias("fold")), path, "fold")
    assert files(0) == before[0] and files(1) == before[1] and files(2) != before[2]
    assert spark.read.parquet(path).count() == 65


# --- planned batches -----------------------------------------------------

def test_scores_follow_the_planned_batches(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(1, 9) for _ in range(k)] + [0] * (12 - k)) for i, k in
            ((i, rng.randint(3, 12)) for i in range(101))]
    df = spark.createDataFrame(rows, "id long, token_ids array<int>").repartition(6)
    plan = order.fixed_batches(df.select("id"), "id", 8, seed=3)
    trimmed = order.trim_batches(df.join(plan, "id"), "token_ids")
    seen = {r.id: (r.batch, r.prediction) for r in score.score_batches(trimmed, score.batch_share_model, ["token_ids"]).collect()}
    ids = dict(rows)
    batches = {}
    for r in plan.collect():
        batches.setdefault(r.batch, []).append((r.position, r.id))
    assert len(batches) == 13
    for b, members in batches.items():
        width = max(sum(x != 0 for x in ids[i]) for _, i in members)
        for _, i in members:
            assert seen[i] == (b, pytest.approx(sum(ids[i]) / (width * len(members))))

    def in_order():
        return lambda x, y: y + 1000 * np.arange(len(x))  # by the place in the batch
    marked = trimmed.withColumn("y", F.col("position").cast("double"))
    for r in score.score_batches(marked, in_order, ["token_ids", "y"]).collect():
        place = sorted(batches[r.batch]).index(next(m for m in batches[r.batch] if m[1] == r.id))
        assert r.prediction == sorted(batches[r.batch])[place][0] + 1000 * place
    with pytest.raises(Exception, match="different lengths"):
        ragged = trimmed.withColumn("token_ids", F.slice("token_ids", 1, (F.col("id") % 3 + 1).cast("int")))
        score.score_batches(ragged, score.batch_share_model, ["token_ids"]).collect()


def test_lookup_works_off_short_slices():
    batch = pa.record_batch([pa.array(range(2 * lookup.SLICE_ROWS + 7))], names=["i"])
    parts = list(lookup._slices(iter([batch, batch.slice(0, 0), batch.slice(3, 5)])))
    assert [p.num_rows for p in parts] == [lookup.SLICE_ROWS, lookup.SLICE_ROWS, 7, 5]
    assert [i for p in parts for i in p.column("i").to_pylist()] == [*range(batch.num_rows), 3, 4, 5, 6, 7]


def test_remembered_words_are_bounded_in_length(monkeypatch):
    monkeypatch.setattr(subword, "REMEMBERED", 10)
    subwords = subword.Subwords(VOCABULARY)
    for i in range(30):
        assert subwords.text("a" * (subword.LONGEST_WORD + 1 + i) + " ab" + "b" * i)[0] == VOCABULARY["[UNK]"]
        assert len(subwords.known) <= 10 and max(map(len, subwords.known)) <= subword.LONGEST_WORD


def test_first_tokens_take_the_beginning_apart(spark):
    texts = [None, "", "a", "ΑΣ.Β", "word " * 1000, "x" * 5000 + " y z", " " * 4000 + "a b c", "😀a " * 700, "ΑΣ" + "." * 90 + "Β c"]
    texts += ["ab ΑΣ"[:i % 6] + "." * i + "Β " + "q'Σ' " * i for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, comment_text string")
    for m in (1, 2, 3, 8, 218):
        whole = df.select("id", F.slice(encode.tokenize("comment_text"), 1, m).alias("t"))
        assert sorted(encode._first_tokens(df, "id", "comment_text", m).collect()) == sorted(whole.collect())
