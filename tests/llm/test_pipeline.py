"""The pipeline and the registered queries against plain versions and SQL."""

import duckdb
import plain
import public_tokenizers
import pytest
import tiktoken
from tables import DOCS

import corpus_pipeline
from biaslens.llm import bpe, mixing, quality
from biaslens.llm.oracles import SQL
from biaslens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        out[name] = (before.collect(), docs.collect())
        if name != "byte_bpe":
            assert docs.columns == columns

    before, after = out["quality_rules"]
    verdict = {r.doc_id: r for r in quality.quality(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    assert {r.doc_id: r.text for r in after} == {i: r.clean_text for i, r in verdict.items() if r.kept}

    before, after = out["near_duplicates"]
    groups = plain.jaccard_components({r.doc_id: r.text for r in before}, 5, 80)
    assert {r.doc_id for r in after} == {i for i, (_, c) in groups.items() if i == c}

    before, after = out["substring_dedup"]
    kept = {r.doc_id: x for r, x in zip(before, plain.without_repeats([r.text for r in before], 35))}
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id: r.text for r in after} == {i: kept[i][2] if kept[i][1] else texts[i] for i in texts}
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = out["source_mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mixed(spark.createDataFrame(before, DOCS)).collect()}
    assert sorted(r.doc_id for r in after) == sorted(i for i, n in copies.items() for _ in range(n))

    before, after = out["byte_bpe"]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == plain.sha256(texts[r.doc_id])

    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in whole) == sorted((r.doc_id, r.decoded_sha256) for r in after)


ODD = [(None, None, None, None, None), (1, "", "x", "y", 0), (1, "", "x", "y", 0), (2, None, None, None, 3), (3, "word", None, "s", 4)]


@pytest.mark.parametrize("rows", [[], ODD])
def test_stages_take_odd_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", ids int, kept int")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "byte_bpe":
            assert out.count() == len(rows)
        else:
            assert out.columns == docs.columns and out.count() <= len(rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rel = con.sql(SQL[name])
    frame = QUERIES[name](spark, SMALL)
    assert sorted(frame.columns) == sorted(rel.columns)
    got = sorted((tuple(r[c] for c in rel.columns) for r in frame.collect()), key=repr)
    assert got == sorted(rel.fetchall(), key=repr)


def test_similar_and_repeated_documents_of_the_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_ngram_jaccard"](spark, SMALL).collect()}
    assert got == plain.jaccard_components(docs, 4, 85)
