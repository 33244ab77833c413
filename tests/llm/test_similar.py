import numpy as np
import random
import tracemalloc
from collections import Counter

import plain
import pyarrow as pa
import pytest
from tables import DOCS

from biaslens.llm import jaccard, substrings
from biaslens.llm.common import BATCH_BYTES, bounded_batches
from biaslens.llm.graph import connected_components


def corpus(seed, n=70):
    """Random texts with groups of copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 160))) for _ in range(n)]
    passage = rng.choices(vocabulary, k=60)
    for _ in range(n):
        w = plain.words(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        texts.append(" ".join(x.upper() if rng.random() < 0.02 else x for x in w))
    hot = rng.choices(vocabulary, k=110)
    for _ in range(60):  # a hot group of near copies, few alike to the first
        w = list(hot)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return dict(zip(order, texts))


@pytest.mark.parametrize("k,percent,seed", [(4, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_components_equal_all_pairs(frame, k, percent, seed):
    docs = corpus(seed)
    rows = jaccard.similar_documents(frame("doc_id long, text string", list(docs.items())), k=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain.jaccard_components(docs, k, percent)


@pytest.mark.parametrize("block,members,slice_", [(4, 1 << 20, 8), (512, 300, 1), (1, 1 << 20, 1 << 13)])
def test_families_in_blocks_and_slices(frame, monkeypatch, block, members, slice_):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(jaccard, "SLICE", slice_)
    docs = corpus(5, 40)
    rows = jaccard.similar_documents(frame("doc_id long, text string", list(docs.items())), k=3, percent=70).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain.jaccard_components(docs, 3, 70)


def test_divide_skip_finds_what_counting_finds():
    rng = random.Random(4)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randint(0, 40))) for _ in range(rng.randint(1, 12))]
        need = rng.randint(1, len(lists))
        count = {v: sum(v in x for x in lists) for v in range(60)}
        assert dict(jaccard.divide_skip(lists, need)) == {v: c for v, c in count.items() if c >= need}


def test_odd_rows(frame):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(5, text), (None, text + " "), (3, text.upper()), (None, "alone in the world here"), (7, None), (8, "   "), (9, "a b"),
            (10, "A  B"), (5, text), (11, "b a"), (5, "another text that shares the id of others")]
    got = sorted((tuple(r) for r in jaccard.similar_documents(frame("doc_id long, text string", rows)).collect()), key=repr)
    assert got == sorted([(5, 36, 3), (None, 36, 3), (3, 36, 3), (None, 1, None), (7, 0, 7), (8, 0, 8), (9, 1, 9), (10, 1, 9),
                          (5, 36, 3), (11, 1, 11), (5, 4, 5)], key=repr)


def test_representatives(frame):
    text = " ".join(f"t{i}" for i in range(40))
    near = text + " end"
    rows = [(5, text, "a", "s", 1), (5, text, "a", "s", 1), (9, near, "b", "s", 2), (None, near, None, None, None), (None, None, None, None, 4),
            (6, "", "x", "y", 0), (6, "", "x", "y", 0), (7, "all different words are in here", None, None, 3)]
    df = frame(DOCS + ", _id int, component int", [(*r, 1, 2) for r in rows])
    out = jaccard.representatives(df)
    assert out.columns == df.columns
    got = sorted((tuple(r)[:5] for r in out.collect()), key=repr)
    assert got == sorted([rows[0], rows[4], rows[5], rows[6], rows[7]], key=repr)


def test_components_of_odd_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    edges += [(3000, 3000 + i) for i in range(100)] + [(None, 1), (5000, 5000)]
    parts = plain.Union({x for e in edges for x in e if x is not None})
    for a, b in edges:
        if a is not None:
            parts.join(a, b)
    linked = {x for e in edges for x in e if None not in e and e[0] != e[1]}
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {x: parts.root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("window,minimiser,hot,seed", [
    (35, 8, 50_000, 1), (8, 3, 50_000, 2), (8, 3, 1, 3), (8, 3, 6, 5), (3, 1, 50_000, 4)])
def test_repeats_equal_plain(frame, monkeypatch, window, minimiser, hot, seed):
    if hot == 6:
        monkeypatch.setattr(substrings, "SPARSE_BITS", 0)  # some marks are wrong
    rng = random.Random(seed)
    texts = list(corpus(seed, 30).values())
    texts += ["x y z " * 40, "same " * 100, "", None, texts[3], "\t".join(plain.words(texts[4])), "a\n b " * 30,
              " ".join(rng.choices("ab", k=300))]
    df = frame("doc_id long, text string, n_words string", [(i, t, "p") for i, t in enumerate(texts)])
    out = substrings.without_repeats(df, window=window, minimiser=minimiser, hot_least=hot)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed", "kept_text"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out.collect()}
    assert got == dict(enumerate(plain.without_repeats(texts, window)))


def test_repeated_rows_and_null_ids(frame):
    long = " ".join(f"v{i}" for i in range(50))
    rows = [(1, long), (1, long), (None, "x " + long), (2, " ".join(f"u{i}" for i in range(50))), (None, None)]
    got = sorted((r.n_words, r.n_removed) for r in substrings.without_repeats(frame("doc_id long, text string", rows)).collect())
    assert got == sorted([(50, 50), (50, 50), (51, 50), (50, 0), (0, 0)])


def test_deduplicated_columns(frame):
    long = " ".join(f"v{i}" for i in range(40))
    rows = [(1, "a  b\n" + long, "l", "s", 9), (2, long + " c", None, None, None), (3, "left  as it\nis", "l", "s", 14)]
    df = frame(DOCS + ", kept_text int, spans int", [(*r, 1, 2) for r in rows])
    out = substrings.deduplicated(df)
    assert out.columns == df.columns
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, "a b", "l", "s", 3, 1, 2), (2, "c", None, None, 1, 1, 2), (3, "left  as it\nis", "l", "s", 14, 1, 2)]


def test_empty(empty_docs):
    assert jaccard.similar_documents(empty_docs).count() == 0
    assert jaccard.representatives(empty_docs).columns == empty_docs.columns
    assert substrings.without_repeats(empty_docs).count() == 0
    assert substrings.deduplicated(empty_docs).count() == 0


def test_parities_never_part_sets_that_link():
    rng = np.random.default_rng(3)
    left_out = linked = 0
    for _ in range(2000):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 2 ** 63, n).astype(np.uint64)
        b = np.concatenate([a[rng.random(n) > rng.choice([0.01, 0.06, 0.12, 0.3])],
                            rng.integers(0, 2 ** 63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)])
        if not len(b):
            continue
        common = len(np.intersect1d(a, b))
        links = 100 * common >= 85 * (len(a) + len(b) - common)
        (may,) = jaccard.may_link(len(a), tuple(jaccard.parities(a)), np.array([len(b)]), jaccard.parities(b)[None, :], 85)
        assert may or not links
        linked += links
        left_out += not may
    assert linked > 300 and left_out > 600


@pytest.mark.parametrize("edits", [(0, 2), (4, 7)])  # mostly links; mostly just too few in common
def test_rows_of_a_group_grow_with_its_size(frame, monkeypatch, edits):
    """Within a block, classes dealt and links written grow about as a group of
    documents on shared lines does, and components equal all pairs. (A group of
    several blocks is dealt once more per block.)"""
    monkeypatch.setattr(jaccard, "BLOCK", 1024)
    plain_written, seen = jaccard.written, {}

    def count(df, what="table"):
        out = plain_written(df, what)
        if what in ("dealt", "links"):
            seen[what] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", count)
    rng = random.Random(9)
    lines = [f"l{i}w{j}" for i in range(16) for j in range(8)]
    per_size = []
    for n in (200, 400, 800):
        docs = {}
        for i in range(n):
            w = list(lines)
            for k in range(rng.randint(*edits)):
                w[rng.randrange(len(w))] = f"own{i}x{k}"
            docs[i] = " ".join(w)
        rows = jaccard.similar_documents(frame("doc_id long, text string", list(docs.items())), k=4, percent=85).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain.jaccard_components(docs, 4, 85)
        per_size.append(dict(seen))
    assert all(p["links"] < p["dealt"] for p in per_size)  # a forest per block
    for small, large in zip(per_size, per_size[1:]):
        assert all(large[k] <= 2.4 * small[k] + 10 for k in small), per_size


def test_shuffled_lines(frame):
    rng = random.Random(9)
    lines = [" ".join(f"l{i}w{j}" for j in range(8)) for i in range(16)]
    docs = {i: "\n".join([*rng.sample(lines, 14), f"own{i} words{i}"] if i % 2 else
                         [*lines[:15], " ".join(f"o{i}x{j}" for j in range(rng.randint(1, 30)))]) for i in range(300)}
    rows = jaccard.similar_documents(frame("doc_id long, text string", list(docs.items())), k=4, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain.jaccard_components(docs, 4, 85)


def test_rows_without_repeats_stay_at_home(spark):
    keyed = spark.range(2000).selectExpr("id", "unhex(md5(cast(id as string))) as _key")
    some = keyed.where("id % 10 = 0")
    marked = {r.id for r in keyed.where(substrings._marked(some, "_key")).collect()}
    assert {r.id for r in some.collect()} <= marked and len(marked) < 400
    assert keyed.where(substrings._marked(some.where("id < 0"), "_key")).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 8, 35])
def test_repeated_windows_equal_counting(window):
    rng = random.Random(window)
    for words in (2, 50):
        strings = [bytes(" ".join(rng.choices([f"w{i}" for i in range(words)], k=rng.randint(window, window + 9))), "ascii")
                   for _ in range(60)]
        times = [rng.choice([1, 1, 1, 2]) for _ in strings]
        cut = [[tuple(w[i:i + window]) for i in range(len(w) - window + 1)] for w in (s.split() for s in strings)]
        seen = Counter(w for x, n in zip(cut, times) for w in x for _ in range(n))
        found = set()
        for s, lo, hi in zip(*map(np.ndarray.tolist, substrings.repeated_windows(strings, times, window))):
            run = {(s, i) for i in range(lo, hi + 1)}
            assert not run & found and (s, lo - 1) not in found  # runs are whole
            found |= run
        assert found == {(s, i) for s, x in enumerate(cut) for i, w in enumerate(x) if seen[w] > 1}


def test_memory_of_a_large_bucket_is_near_its_strings():
    """40,000 strings of one bucket: once each of their windows was a row of its own."""
    rng = random.Random(5)
    strings = [" ".join(rng.choices("abcdefghijkl", k=27) + ["at"] * 8 + rng.choices("abcdefghijkl", k=27)).encode()
               for _ in range(40_000)]
    tracemalloc.start()
    string, _, _ = substrings.repeated_windows(strings, [1] * len(strings), 35)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not len(string) and peak < 250 << 20  # the windows alone: 40,000 * 28 * (35 + 33 + 72) bytes and more


def test_strings_and_batches_leave_in_bounded_parts(frame, monkeypatch):
    """However many strings a batch gives, they leave the task in small Arrow batches."""
    monkeypatch.setattr(substrings, "BATCH_BYTES", 2000)
    monkeypatch.setattr(substrings, "WORDS", 100)
    texts = [" ".join(f"v{i % 61}" for i in range(n)) for n in range(30, 160, 3)]
    rows = substrings.without_repeats(frame("doc_id long, text string", list(enumerate(texts))), window=8, minimiser=3,
                                      hot_least=5).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == dict(enumerate(plain.without_repeats(texts, 8)))


def test_arrow_batches_are_bounded_by_bytes(frame):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = frame("doc_id long, text string", [(i, "word " * 2000) for i in range(6000)])
    for prepare in (lambda: substrings.repeated_passages(df.limit(2)), lambda: jaccard.similar_documents(df.limit(2))):
        df.sparkSession.conf.unset(key)
        prepare()
        assert 0 < int(df.sparkSession.conf.get(key)) <= BATCH_BYTES
    sizes = df.coalesce(1).select("text").mapInArrow(
        lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    assert max(r.n for r in sizes) < 2 * BATCH_BYTES
    df.sparkSession.conf.set(key, "1000000")
    bounded_batches(df.sparkSession)
    assert df.sparkSession.conf.get(key) == "1000000"


def test_only_marked_documents_travel(frame, spark):
    """Of documents without a copy, no text is shuffled to find the copies."""
    docs = {i: " ".join(f"d{i}x{j}" for j in range(30)) for i in range(3000)}
    docs |= {5000 + i: docs[i] + " end" for i in range(10)}
    out = jaccard.representatives(frame(DOCS, [(i, t, None, None, 1) for i, t in docs.items()]))
    assert {r.doc_id for r in out.collect()} == set(range(3000))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("found(") >= 2  # the bitmap decides on both sides of the union
