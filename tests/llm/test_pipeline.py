"""The pipeline's stages, each held against what its operator is to do."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_ops import LONG, PASSAGE, brute_links, words
from tidewell.tables import materialize, table


def test_stages(spark, duck):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA))
        kept.append(docs)
        if name != "best_fit_packing":
            assert docs.columns == columns
    good, single, clean, private, packed = kept
    label = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    lost = {i for i, in duck.sql("SELECT doc_id FROM documents").fetchall()} - set(rows)
    assert sum(label.get(i) == 1 for i in lost) <= 0.02 * len(label)
    _, sets, links = brute_links(rows)
    group = {s: min(v) for s, v in sets.items()}
    for _ in range(10):
        for s in sets:
            for o in links[s]:
                group[s] = group[o] = min(group[s], group[o])
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    assert sorted(left) == sorted(set(group.values()))
    spans = {tuple(w[k : k + 10]) for t, in duck.sql("SELECT text FROM benchmark").fetchall() for w in [words(t)] for k in range(len(w) - 9)}
    want = {i for i, t in left.items() for w in [words(t)] if not any(tuple(w[k : k + 10]) in spans for k in range(len(w) - 9))}
    assert {r["doc_id"] for r in clean.collect()} == want == {r["doc_id"] for r in private.collect()}
    assert Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == Counter(want)


ODD = [
    (1, "The quick brown fox. Mail a.b@example.com or +1 (347) 555-9637 now", "en", "web", 66),
    (2, None, "en", "web", None),
    (3, "", None, None, 0),
    (4, PASSAGE + " and more", "en", "web", 5),
    (5, PASSAGE + " and more", "en", "web", 5),
    (5, PASSAGE + " and more", "en", "web", 5),
    (6, "start " + PASSAGE + " and more", None, "web", 5),
    (None, "no id here but a.b@example.com again", "fr", "web", 36),
    (7, LONG, "de", "web", len(LONG)),
    (9, "... !!! 123", "es", "web", 11),
    (10, "one two three four five six seven eight nine ten eleven", "en", "web", 55),
]
@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    columns = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(ODD, columns).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (1, 4, 10)] + [(9, 0, 0), (9, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("x", "Two three FOUR five six seven eight nine ten eleven"), ("y", None), (None, "")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_a_stage_on_odd_rows(spark, folder, name):
    """Nulls, empty and long texts, repeats, ties, clashing columns, an empty table, and one without n_chars."""
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = table(spark, folder, "documents")
    docs = plain.selectExpr("*", "0.5D AS _score", "'f' AS _found", "1 AS __done", "2 AS __k1", "3 AS __r1", "4L AS __doc", "5L AS __r", "6L AS n", "'p' AS piece", "'s' AS sequence_id", "7 AS `odd name`")
    done = stage(spark, materialize(docs), folder)
    rows = [r.asDict() for r in done.collect()]
    ids = Counter(r["doc_id"] for r in rows)
    everything = Counter(r[0] for r in ODD)
    if name == "best_fit_packing":
        assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == everything
        return
    assert done.columns == docs.columns
    for r in rows:
        assert (r["_score"], r["_found"], r["__done"], r["__k1"], r["__r1"], r["__doc"], r["__r"], r["n"], r["odd name"]) == (0.5, "f", 1, 2, 3, 4, 5, 6, 7)
    texts = {(r[0], r[1]) for r in ODD}
    if name == "pii_surrogates":
        assert ids == everything
        new = {r["doc_id"]: r for r in rows}
        assert "a.b@" not in new[1]["text"] and "a.b@" not in new[None]["text"] and new[2]["text"] is None and new[2]["n_chars"] is None
        assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
        assert stage(spark, plain.select("doc_id", "text"), folder).columns == ["doc_id", "text"]
    else:
        assert {(r["doc_id"], r["text"]) for r in rows} <= texts
    if name == "ngram_jaccard_join":
        # 2 and 3 have no words; 4, 5 and 6 are alike.
        assert ids == Counter([None, 1, 2, 4, 7, 9, 10])
    if name == "benchmark_decontamination":
        assert ids == everything - Counter([10])
    none = stage(spark, materialize(docs.limit(0)), folder)
    assert none.count() == 0


def test_the_whole_pipeline_on_odd_rows(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) and 10 not in {r["doc_id"] for r in rows}
