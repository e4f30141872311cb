"""The pipeline's stages on the small fixture, each against what its operator says of its input."""

import pyarrow as pa
import pytest

import corpus_pipeline
from foldguard.llm import base, exact_dedup, ngram_join, packing, quality_rules

from .test_dedup import rows, want_components, want_exact
from .test_text import check_sequences

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        seen[name] = docs, out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = spark.createDataFrame(out.collect(), out.schema)
    given, kept = seen["exact_dedup"]
    texts = [(r.doc_id, r.text) for r in given.collect()]
    assert rows(kept, "doc_id") == sorted(((x[0],) for x in want_exact(texts) if x[3]), key=repr)
    given, kept = seen["ngram_join"]
    texts = [(r.doc_id, r.text) for r in given.collect()]
    assert rows(kept, "doc_id") == sorted(((x[0],) for x in want_components(texts, words=5, percent=80) if x[0] == x[2]), key=repr)
    given, packed = seen["best_fit_packing"]
    packed = packed.collect()
    check_sequences(packed)
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(r.doc_id for r in given.collect())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert ngram_join.NgramRule() == ngram_join.NgramRule(words=5, percent=80)


def test_stages_on_edge_cases(spark, edges, no_rows):
    """Null, blank and very long texts, ties, repeated rows, NULL ids, columns named as stages name their own, and no rows."""
    docs = edges.selectExpr("*", *[f"doc_id AS {n}" for n in ("rate", "row", "kept_id", "gone_id", "piece", "copies")])
    columns = docs.columns
    words = lambda t: len((t or "").split())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "best_fit_packing":
            packed = out.collect()
            check_sequences(packed)
            assert len([r for r in packed if r.piece == 0]) == docs.count()
            break
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        if name == "quality_rules":
            assert all(words(r.text) >= 20 for r in docs.collect())
            docs = docs.unionByName(edges.selectExpr("*", *[f"doc_id AS {n}" for n in columns[len(edges.columns) :]]))  # the next stages see the edges, too
        if name in ("exact_dedup", "ngram_join"):
            assert docs.count() > 0
    empty = no_rows
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0
        if name != "best_fit_packing":
            empty = spark.createDataFrame([], out.schema)


def test_workers_keep_little_between_tasks(spark):
    """A worker that packed many different words lives on for other stages with the first of them only."""
    texts = [" ".join(f"{letter}{i}x" for i in range(packing.KEPT_IDS // 2)) for letter in "abc"]
    packed = packing.pack_documents(spark.createDataFrame([(1, " ".join(texts))], "doc_id bigint, text string").coalesce(1))
    assert packed.filter("piece = 0").count() == 1

    def known(batches):
        list(batches)
        yield pa.RecordBatch.from_pydict({"n": [max(map(len, packing._ENCODERS.values()), default=0)]})

    kept = [r.n for r in spark.range(0, 16, 1, 16).mapInArrow(known, "n bigint").collect()]
    assert max(kept) <= packing.KEPT_IDS


def test_a_cache_of_pieces_keeps_the_first():
    known = packing.Remembered(lambda new: [p.encode() for p in new])
    known.results(["a", "b"])
    known.results(["c", "a"])
    known.keep_first(5)
    assert list(known) == ["a", "b", "c"]
    known.keep_first(2)
    assert dict(known) == {"a": b"a", "b": b"b"}
    assert known.results(["c", "b"]) == [b"c", b"b"]


def test_memory_is_given_back_when_a_task_ends_however_it_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(base, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["a b", None]})
    done = base.lent(lambda batches: (b for b in batches))(iter([batch, batch]))
    assert next(done) is batch and not calls
    assert list(done) == [batch] and len(calls) == 1
    broken = base.lent(lambda batches: (1 // 0 for _ in batches))(iter([batch]))
    with pytest.raises(ZeroDivisionError):
        next(broken)
    assert len(calls) == 2
    cut_short = base.lent(lambda batches: (b for b in batches))(iter([batch, batch]))
    next(cut_short)
    cut_short.close()
    assert len(calls) == 3


def test_exact_dedup_takes_a_batch_in_runs():
    n, long = 30, "x y" * (base.RUN_CHARS // 30)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "text": [long] * n})
    out = list(exact_dedup._normalise(iter([batch.slice(0, 0), batch])))
    assert len(out) > 1 and all(sum(b.column("n_cp").to_pylist()) <= base.RUN_CHARS for b in out)
    whole = pa.Table.from_batches(out).to_pydict()
    assert whole["doc_id"] == list(range(n)) and whole["n_cp"] == [len(long)] * n
    assert set(whole["body"]) == {long.replace(" ", "").encode()}


def test_quality_rules_give_the_rows_back_as_they_were(edges):
    """Texts are read inside the rows; the verdicts are those without them."""
    docs = edges.selectExpr("lang", "doc_id AS row", "text", "doc_id")
    references = quality_rules.learn_references(docs)
    judged = quality_rules.quality_rules(docs, references, with_input=True)
    apart = quality_rules.quality_rules(docs, references)
    assert rows(judged.select("row.*"), *docs.columns) == rows(docs, *docs.columns)
    verdict = [c for c in apart.columns if c != "doc_id"]
    assert rows(judged.select("row.doc_id", *verdict), "doc_id", *verdict) == rows(apart, "doc_id", *verdict)
