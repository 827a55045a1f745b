"""The pipeline's contract, and its stages against plain Python."""

from functools import reduce

import corpus_pipeline
from tickloom.llm import minhash

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_and_registration():
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "line dedup", "MinHash near-dedup", "best-fit packing"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_run_keeps_clean_documents_once(spark, tmp_path):
    clean = [" ".join(f"w{i}x{j}" for j in range(70)) for i in range(8)]
    rows = [(i, t, "en", "a") for i, t in enumerate(clean)] + [(20, "too short", "en", "a"), (21, None, "en", "a"), (22, "1 2 3 " * 30, "en", "a"), (23, clean[3] + " changed", "en", "b"), (24, "same same same " * 40, "en", "a")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted({r.doc_id for r in out})
    assert ids == list(range(8))
    used = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 1024


def test_rows_that_share_an_id_or_have_none(spark):
    text = " ".join(f"w{j}" for j in range(60))
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (1, text, "en", "a", 1), (1, text + " b", "en", "a", 1), (None, text, "en", "a", 1), (2, text, "en", "a", 1)], COLUMNS)
    kept = corpus_pipeline.minhash_near_dedup(spark, docs, "").collect()
    assert [r.doc_id for r in kept] == [1]  # a copy without an id is a copy
    stages = corpus_pipeline.STAGES[1:3]
    out = reduce(lambda d, s: s[1](spark, d, ""), stages, docs)
    assert out.columns == docs.columns and out.count() == 5
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, None: 1}


def test_emptied_documents_go_and_tables_may_be_empty(spark):
    lines = [" ".join(f"w{k}x{j}" for j in range(12)) + "." for k in range(6)]
    rows = [(1, "\n".join(lines), "en", "a", 1), (2, "\n".join(lines), "en", "a", 1), (3, "\n".join(lines[:3] + ["an own line of this text"]), "en", "a", 1), (4, None, "en", "a", 1), (5, "", "en", "a", 1)]
    out = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    assert sorted(out) == [1, 3, 4, 5] and out[1].text == "\n".join(lines) and out[3].text == "an own line of this text" and out[3].n_chars == 24
    docs = spark.createDataFrame([], COLUMNS + ", quality int, n_removed int, digest string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0 and docs.columns[-3:] == ["quality", "n_removed", "digest"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
