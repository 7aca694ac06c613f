"""Each stage of the pipeline against brute force on its own input, and all of them on hard little tables."""

import corpus_pipeline
import pytest
from brute import contaminated, near, removed
from oracle import DATA
from test_contracts import frame, texts

from relplan.sources import shared

SF = f"{DATA}/sf0.001"


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    results = []
    for _, stage in corpus_pipeline.STAGES:
        results.append(docs := shared.keep(stage(spark, docs, SF), "stage"))
    good, single, cut, clean, mixed = ({r.doc_id: r.text for r in x.collect()} for x in results)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum((i in good) == bool(q) for i, q in labels.items()) > 0.9 * len(labels)
    assert set(single) == {i for i, (_, c) in near(list(good.items()), 80).items() if c == i}
    want = removed(list(single.items()), True)
    assert set(cut) == set(single) and all(cut[i] == (single[i] if not want[i][1] else want[i][3].decode()) for i in cut)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == {i for i, (_, _, met) in contaminated(list(cut.items()), items).items() if not met}
    assert set(mixed) <= set(clean)
    assert results[0].columns == results[3].columns
    again = corpus_pipeline.run(spark, SF).select("doc_id", "copy", "words").collect()
    assert again == results[4].select("doc_id", "copy", "words").collect()


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages_on_odd_rows(spark, tmp_path, which):
    rows = [*texts(n=30), (None, "no id at all"), (None, None), (4, "again"), (4, "again"), (5, "again")]
    docs = frame(spark, rows)
    # nearly all good, so that the classifier, which has nothing to learn here, leaves the odd rows to the later stages
    spark.createDataFrame([(i, int(i != 8), 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "w1 w2"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs.where("false") if which == "empty" else docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        docs = shared.keep(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns[: len(before)] == before and (i == 4 or len(docs.columns) == len(before))
        assert (docs.count() == 0) == (which == "empty")


def test_leaks_are_told_by_row_and_items_of_every_length_count(spark, tmp_path):
    spark.createDataFrame([(1, "three word item"), (2, "another"), (3, "five words in this item"), (4, "one two three four five six seven eight nine"), (None, "no id")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "a clean text of its own"), (None, "well one two three four five six seven eight well"), (1, "here is a three word item only"), (2, "a three word item and another"), (3, "the five words in this item"), (3, "clean again"), (4, None), (None, None)]
    kept = corpus_pipeline.benchmark_leaks(spark, frame(spark, rows), str(tmp_path))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[0], rows[2], rows[5], rows[6], rows[7]], key=str)


def test_near_copies_from_eighty_percent_on(spark):
    """Pairs of 0.80 to 0.85: 100 shingles, of which one changed word takes five or a tail takes others."""
    base = [f"b{i}" for i in range(104)]
    docs = []
    for i, changed in enumerate(([], [50], [50, 60], [50, 60, 70], [99, 100, 101, 102, 103], list(range(92, 104)))):
        docs.append((i, " ".join(f"n{i}_{j}" if j in changed else w for j, w in enumerate(base))))
    left = corpus_pipeline.near_duplicates(spark, frame(spark, docs), "")
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in near(docs, 80).items() if c == i} != {i for i, (_, c) in near(docs, 85).items() if c == i}


def test_rows_of_one_id_and_different_texts_stay(spark):
    rows = [(1, "one text of five words or more"), (1, "quite another text under the same id"), (1, "one text of five words or more"), (2, "x")]
    assert sorted(r.text for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()) == sorted({t for _, t in rows})
