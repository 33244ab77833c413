import random
from collections import Counter, defaultdict

import plain
import pytest
from tables import DOCS
from pyspark.sql import functions as F

from biaslens.llm import mixing, quality

GOOD = "This is a clean sentence about many different things, and it ends as it should. "
PROSE = "\n".join(" ".join(f"word{i * 10 + j}" for j in range(10)).capitalize() + "." for i in range(12))


def base(text):
    text = text or ""
    w = plain.words(text)
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {p for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if plain.words(line)]
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed)


TEXTS = [None, "", "  \n\t ", "one", "a b c", "a b c a b c", "x x x x", GOOD * 10, PROSE, PROSE + "\nAll rights reserved.",
         "w1\x0bw2\x0cw3 \r\n w1 w2 w3", "#*$%&|<>" * 20, "é😀 " * 40, "a b c d\n" * 30, PROSE + "\n" + PROSE,
         "\n".join(f"Home{i} | About{i} | Contact{i} | News{i} |" for i in range(15)),
         "\n".join(f"Lots{i}### of{i}%%% marks{i}$$$ in&&& line*** {i}###" for i in range(20)),
         "\n".join(f"SHOUT{i}!! ALL{i}!! THE!! TIME{i}!! NOW!! {i}!!" for i in range(20)), " ".join(f"w{i % 977}" for i in range(60_000))]


def test_counts_and_verdicts(frame):
    df = frame("doc_id long, text string, kept string", [(i, t, "x") for i, t in enumerate(TEXTS)])
    rows = {r.doc_id: r for r in quality.quality(df).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
    kept = {i for i, r in rows.items() if r.kept}
    assert kept == {8, 9}  # prose, and prose with one furniture line
    assert rows[9].n_lost == 3 and rows[9].clean_text == PROSE
    for i in (15, 16, 17):
        assert not rows[i].kept and not rows[i].base_failed


CLEAN = ["They praised a new design in the city.", "He looked up the catalog in the library.", "The news had spread more quickly than that.",
         "She read more books.", "Many readers subscribe to this view of history.", "The old mill was powered by water.",
         "Every guest has to sign in at the desk.", "The terms of users differ from year to year.", "He wanted to share this thought with friends."]
FURNITURE = ["All rights reserved.", "Sign in or sign up!", "Click here to read more.", "Read our Privacy Policy and the terms of use.",
             "Copyright ©2020 by the owners of this page.", "(C) Copyright by the owners of this page.", "Powered by WordPress."]


def test_phrases_in_clean_sentences(frame):
    texts = ["\n".join([*CLEAN, PROSE]), "\n".join(CLEAN), "\n".join([PROSE, *FURNITURE])]
    rows = {r.doc_id: r for r in quality.quality(frame("doc_id long, text string", list(enumerate(texts)))).collect()}
    for i in (0, 1):
        assert rows[i].n_lost == 0 and rows[i].kept and rows[i].clean_text == texts[i]
    assert rows[2].clean_text == PROSE


def test_sql_states_the_same_rule(frame):
    import duckdb

    from biaslens.llm.oracles import SQL
    lines = [*CLEAN, *FURNITURE, "read more read more", "Read more, sign in; log in!", "re-read more of it (c) copyright x", "xread more",
             "ALL RIGHTS RESERVED_ no", "copyright © y and so on and on.", "log in\tlog in now.", "spread more sign in there today."]
    texts = ["\n".join([PROSE, *([line] * 30)]) for line in lines] + [None, "", PROSE]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(SQL["op2_quality_rules"])
    names = [c[0] for c in want.description]
    got = quality.quality(frame("doc_id long, text string", list(enumerate(texts)))).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert len({r.kept for r in got}) == 2


def test_random_repeats(frame):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    rows = quality.quality(frame("doc_id long, text string", list(enumerate(texts)))).collect()
    assert all(r.n_repeat_words == base(texts[r.doc_id])[4] for r in rows)


def test_kept_documents_keep_columns(frame):
    df = frame(DOCS + ", kept int, _t int", [(1, PROSE, "en", "s", 5, 7, 8), (2, PROSE + "\nRead more", None, None, 9, 7, 8),
                                             (3, "short", "en", "s", 5, 7, 8), (1, PROSE, "en", "s", 5, 7, 8),
                                             (4, None, None, None, None, None, None)])
    out = quality.kept_documents(df)
    assert out.columns == df.columns
    rows = sorted((tuple(r) for r in out.collect()), key=repr)
    assert rows == sorted([(1, PROSE, "en", "s", 5, 7, 8)] * 2 + [(2, PROSE, None, None, len(PROSE), 7, 8)], key=repr)


def test_empty(empty_docs):
    assert quality.quality(empty_docs).count() == 0
    assert quality.kept_documents(empty_docs).columns == empty_docs.columns
    assert mixing.mixed(empty_docs).count() == 0
    assert mixing.mixture(empty_docs).count() == 0


def documents(n=600, seed=1):
    rng = random.Random(seed)
    sources = ["a", "b", "é", None, "z"]
    return [(i, " ".join(["word"] * rng.randint(0, 60)), "en", "hot" if i % 3 == 0 else rng.choice(sources), 1) for i in range(n)]


def test_targets_and_taken(frame):
    docs = documents()
    rows = mixing.mixed(frame(DOCS, docs)).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in docs:
        sizes[s] += len(plain.words(t))
    want = plain.targets(dict(sizes))
    taken = defaultdict(int)
    source = {d[0]: d[3] for d in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.size * r.copies
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 30  # half the largest document
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_agree_and_seeds_differ(frame):
    docs = documents(300)

    def run(seed, parts):
        df = frame(DOCS, docs).repartition(parts)
        return {r.doc_id: r.taken for r in mixing.mixed(df, seed=seed).collect()}
    assert run("x", 2) == run("x", 7)
    assert run("x", 2) != run("y", 2)


def test_weights_prefer_clean_texts(frame):
    docs = [(i, " ".join(["word"] * 20) if i % 2 else " ".join(["&&#%$"] * 20), "en", f"s{i % 4 // 2}", 1) for i in range(400)]
    rows = mixing.mixed(frame(DOCS, docs), share=0.5, most=1.0).collect()
    clean = sum(r.copies for r in rows if r.doc_id % 2)
    assert clean > 0.7 * sum(r.copies for r in rows)


def test_odd_rows(frame):
    rows = [(None, "a b", None, None, None), (None, "a b", None, None, None), (1, None, None, "s", None),
            (2, "", "x", "s", 0), (2, "c d e", "x", "s", 5), (2, "c d e", "x", "s", 5)]
    df = frame(DOCS + ", size string, target string", [(*r, "p", "q") for r in rows])
    out = mixing.mixed(df, keep=("doc_id", "size", "lang")).collect()
    assert len(out) == len(rows) and out[0].__fields__ == ["doc_id", "lang", "size", "source_size", "target", "taken", "copies"]
    assert all(r.taken == 0 for r in out if r.size == 0)
    mixed = mixing.mixture(df)
    assert mixed.columns == df.columns
    copies = sum(r.copies for r in out)
    assert mixed.count() == copies and mixed.where(F.col("text").isNull()).count() == 0
