"""The language model's score and its head, word by word."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from biaslens.llm import lm

SMALL = lm.Settings(classes=12, head=20, dim=6, noise=8, batch=64, rate=0.2)


def documents(n=80, seed=4):
    rng = random.Random(seed)
    return [(i, " ".join(f"W{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 30)))) for i in range(n)] + [
        (n, None), (n + 1, ""), (n + 2, "never seen before"), (n + 3, "w1")]


@pytest.mark.parametrize("most", [0, 1, 5, 6, 7, 100])
def test_head_ends_between_counts(frame, most):
    sizes = [9_000_000_000, 70_000, 70_000, 3, 3, 3, 1, 1]
    counts = frame("word binary, n long", [(str(i).encode(), n) for i, n in enumerate(sizes)])
    least = lm._cut_off(counts, most)
    inside = [n for n in sizes if n >= least]
    assert len(inside) <= most
    more = [n for n in sizes if n >= max([m for m in sizes if m < least], default=least)]
    assert more == inside or len(more) > most
    assert lm._cut_off(counts.where("n > 9e18"), most) == 1


def test_scores_by_hand(frame, monkeypatch):
    """Every token's probability by a softmax over all classes, and a rare word's
    add-one share of its class, for given parameters."""
    monkeypatch.setattr(lm, "_trained", lambda docs, index, start, s: start.with_flat(start.flat() * 1.5))
    docs = documents()
    df = frame("doc_id long, text string", docs)
    got = {r.doc_id: r.score for r in lm.scored_documents(df, F.col("doc_id") % 3 != 0, settings=SMALL).collect()}

    train = [(t or "").lower().split() for i, t in docs if i % 3]
    count = Counter(w for t in train for w in t)
    ranked = sorted(count, key=lambda w: (-count[w], w.encode()))
    head = [w for w in ranked if sum(n >= count[w] for n in count.values()) <= SMALL.head]
    own = head[:SMALL.classes]
    rare = sum(count.values()) - sum(count[w] for w in own)
    frequency = np.array([rare, len(train), 0, *(count[w] for w in own)], dtype=float) + 1
    m = lm.Model.start(frequency / frequency.sum(), SMALL)
    m = m.with_flat(m.flat() * 1.5)
    for i, t in docs:
        words, before, want = (t or "").lower().split(), [lm.START, lm.START], 0.0
        for w in [*words, None]:
            k = lm.END if w is None else lm.FIRST + own.index(w) if w in own else lm.RARE
            s = (m.c[0] * m.r[before[-2]] + m.c[1] * m.r[before[-1]]) @ m.q.T + m.b
            want += math.log10(math.exp(s[k]) / np.exp(s.astype(float)).sum())
            if k == lm.RARE:
                want += math.log10((count[w] + 1) / (rare + len(count) - len(own) + 1))
            before.append(k)
        assert got[i] == pytest.approx(want, abs=1e-4)
