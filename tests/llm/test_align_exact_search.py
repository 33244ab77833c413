import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tables import DOCS
from tokenizers import Tokenizer

from biaslens.llm import align, exact, queries, search

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
SF001 = "/root/testdata/sf0.001"

# --- exact duplicates ----------------------------------------------------


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_duplicates(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(folded(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[folded(t)]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(ids), hashlib.sha256(folded(t).encode()).hexdigest()))
    return sorted(out, key=repr)


LONG = "long text é " * 300
EXACT = [(1, "Hello World"), (2, "hello world"), (3, "hello world "), (4, None), (5, ""), (6, "ÀB"), (7, "àb"), (8, "Àb"),
         (9, LONG), (10, LONG.upper().replace("É", "é")), (11, LONG + "x"), (12, LONG[:-1]), (None, "hello world"),
         (13, "x" * 64), (14, "x" * 128), (15, "x" * 96), (16, "x" * 64), (None, "alone")]


@pytest.mark.parametrize("block", [3, 16, 64, exact.BLOCK])
def test_exact_duplicates(frame, block):
    got = exact.exact_duplicates(frame("doc_id long, text string, name string, Row string", [(i, t, "n", "r") for i, t in EXACT]),
                                 block=block).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == plain_duplicates(EXACT)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({r.text_sha256: 1 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_duplicates_of_random_texts(frame):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("aAb", k=rng.randint(0, 9)))) for i in range(600)]
    got = exact.exact_duplicates(frame("doc_id long, text string", rows), block=2).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == plain_duplicates(rows)


def test_repeated_rows_and_empty_table(frame, empty_docs):
    rows = [(1, "a", "en", "s", 1)] * 3 + [(2, "b", "en", "s", 1), (2, "B", "fr", "s", 1), (None, "c", "x", "y", 0)]
    got = exact.exact_duplicates(frame(DOCS, rows)).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in got if r.doc_id) == [
        (1, 3, False), (1, 3, False), (1, 3, True), (2, 2, False), (2, 2, True)]
    left = exact.deduplicated(frame(DOCS, rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id or 0, folded(r.text)) for r in left.collect()) == [(0, "c"), (1, "a"), (2, "b")]
    assert exact.exact_duplicates(empty_docs).count() == 0 and exact.deduplicated(empty_docs).count() == 0


# --- ranked search -------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranks(docs, items, k):
    counted = [(i, Counter(TERM.findall(folded(t)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(TERM.findall(folded(text))) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def ranks(rows):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in rows], key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["é", "日本", "A1", "x_y", "É"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("k, segment", [(3, 7), (50, 1 << 14), (5, 40)])
def test_ranks_equal_brute_force(frame, monkeypatch, k, segment):
    monkeypatch.setattr(search, "SEGMENT_DOCS", segment)
    docs = corpus(1) + [(1000, None), (1001, ""), (1002, "w1 " * 5000), (None, "w7 w9"), (1003, "w1 " * 5000), (7, "w3")]
    items = [(1, "w1 w2 w40 W40"), (2, None), (3, ""), (4, "nowhere"), (5, "é 日本, a1! x_y"), (6, " ".join(f"w{i}" for i in range(60)))]
    got = search.ranked(frame("doc_id long, text string, score string, term string", [(*d, "s", "t") for d in docs]),
                        frame("item_id long, text string, rank string", [(*i, "r") for i in items]), k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranks(got.collect()) == plain_ranks(docs, items, k)


def test_blocks_of_items_give_the_same(frame, monkeypatch):
    docs, items = corpus(2, 200), [(i, t) for i, t in corpus(3, 12)]
    monkeypatch.setattr(search, "BLOCK_ITEMS", 5)
    got = search.ranked(frame("doc_id long, text string", docs), frame("item_id long, text string", items), k=4)
    assert ranks(got.collect()) == plain_ranks(docs, items, 4)


def test_items_with_equal_ids_are_ranked_apart(frame):
    docs, items = corpus(5, 50), [(1, "w1 w5"), (1, "w2")]
    got = search.ranked(frame("doc_id long, text string", docs), frame("item_id long, text string", items), k=2)
    assert ranks(got.collect()) == plain_ranks(docs, items, 2)


def test_accumulators_are_limited_and_survivors_exact():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, k = 300, 5
        terms = []
        for size, top in ((3, 1000), (20, 300), (150, 40), (280, 10)):
            docs = np.sort(rng.choice(n, size, replace=False))
            shares = rng.integers(1, top, size)
            terms.append((docs, shares, int(shares.max())))
        true = np.zeros(n, np.int64)
        for docs, shares, _ in terms:
            true[docs] += shares
        scores, created = search.accumulate(terms, n, k, 1)
        best = np.sort(true)[-k]
        assert (scores[true >= best] == true[true >= best]).all() and (scores <= true).all()
        assert created < 300
        _, none = search.accumulate(terms, n, k, int(sum(t[2] for t in terms)) + 1)
        assert none == 0


def test_search_of_nothing(frame, empty_docs):
    items = frame("item_id long, text string", [(1, "a")])
    assert search.ranked(empty_docs, items).count() == 0
    assert search.ranked(frame("doc_id long, text string", [(1, "a")]), items.where("false")).count() == 0
    assert search.ranked(frame("doc_id long, text string", [(1, None)]), items).columns == ["item_id", "rank", "doc_id", "score"]


# --- alignment -----------------------------------------------------------


@pytest.fixture(scope="module")
def vocabularies():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_alignment(docs, vocabularies):
    a, b = vocabularies
    back = align.bl.character_bytes()
    held, counts = [], Counter()
    for i, text in docs:
        text = text or ""
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text, num_threads=1) if text else []
        xb = [bytes(back[c] for c in a.id_to_token(t)) for t in x]
        yb = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in y]
        if not text or b"".join(xb) != (" " + text).encode() or b"".join(yb) != (" " + text).encode():
            held.append((i, [], [], [], []))
            continue
        spans = []
        for sizes in (xb, yb):
            ends = np.cumsum([len(s) for s in sizes]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, ja, jb = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while ja < len(x) and spans[0][ja][1] <= c:
                ga.append(x[ja])
                ja += 1
            while jb < len(y) and spans[1][jb][1] <= c:
                gb.append(y[jb])
                jb += 1
            groups.append((ga, gb))
        links = [(s, t) for s, (p, q) in zip(x, spans[0]) for t, (u, v) in zip(y, spans[1]) if p < v and u < q]
        counts.update(set(links))
        held.append((i, x, y, groups, links))
    most = {}
    for (s, _), n in counts.items():
        most[s] = max(most.get(s, 0), n)
    out = []
    for i, x, y, groups, links in held:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, len(x), len(y), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return sorted(out, key=repr)


TRICKY = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "日本", "😀", "!!", "12", " ", "<|endoftext|>", "<s>", "</s>", "<0x41>", "the ",
          " tokenization", "aaaa", "\u0085", "\x00", "　", "ing", "\x1c"]


def test_alignment_equals_brute_force(frame, vocabularies):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choices(TRICKY, k=rng.randint(0, 12)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "a▁b"), (903, " "), (904, "word " * 400), (None, "null id"), (904, "word word"),
             (905, "\n\nx  y \n z"), (906, "▁"), (907, "x" * 700)]
    got = align.aligned(frame("doc_id long, text string, bundle string, N string", [(*d, "b", "n") for d in docs]), A, B).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain_alignment(docs, vocabularies)


def test_small_bundles_and_memories_give_the_same(frame, vocabularies):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices(["the", "tokenization", "héllo", "naïve,", "x1y2"], k=6))) for i in range(80)]
    spec, proto = open(A, encoding="utf-8").read(), open(B, "rb").read()
    aligner = align.Aligner(spec, proto)
    texts = [t for _, t in docs]
    once = [(f[:3], f[3].tolist(), f[4].tolist(), f[5]) for f in aligner(texts)]
    again = []
    for t in texts:
        aligner.forget()
        again += [(f[:3], f[3].tolist(), f[4].tolist(), f[5]) for f in aligner([t])]
    assert once == again
    whole = align.Aligner(spec, proto)
    whole.b.cut_at_spaces = False
    assert once == [(f[:3], f[3].tolist(), f[4].tolist(), f[5]) for f in whole(texts)]


def test_bundles(frame, vocabularies, monkeypatch):
    docs = [(i, f"the {i % 7} tokenization of word{i}") for i in range(60)]
    monkeypatch.setattr(align, "BUNDLE", 150)
    got = align.aligned(frame("doc_id long, text string", docs), A, B).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain_alignment(docs, vocabularies)


def test_alignment_of_an_empty_table(empty_docs):
    assert align.aligned(empty_docs, A, B).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                                       "groups_sha256"]
    assert align.aligned(empty_docs, A, B).count() == 0


# --- the registered queries against the plain versions -------------------


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]


def test_op11(spark, vocabularies):
    got = queries.op11_token_alignment(spark, SF001).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain_alignment(documents(spark), vocabularies)


def test_op12(spark):
    got = queries.op12_exact_dedup(spark, SF001).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == plain_duplicates(documents(spark))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_op13(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    assert ranks(queries.op13_ranked_search(spark, SF001).collect()) == plain_ranks(documents(spark), items, 50)
