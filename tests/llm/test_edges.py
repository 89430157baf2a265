"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from nearvote.llm import decontaminate, exact_dedup, line_dedup, order_minhash, packing, pii, quality, sharding, substring_dedup, toxicity
from nearvote.llm.queries import tokenizer_path

LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (1, "a b c d e f g", "x"),
    (1, "a b c d e f g", "x"),
    (2, None, None),
    (3, "", "x"),
    (None, "a b c d e f g", "x"),
    (None, None, None),
    (4, LONG, "x"),
    (5, "  \n\n \t", "x"),
    (6, "fünf Wörter über größere Öfen", "x"),
]
#: Names that operators use inside.
CLASH = ["__th", "digest", "row", "run", "__kept", "n", "bucket", "col0", "__spans", "node"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "b c d"), (None, "über größere"), (3, None), (4, "")], "item_id bigint, text string")


@pytest.fixture(scope="module")
def models(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    return quality.fit(docs, labels, F.lit(True)), toxicity.fit(docs, labels, F.lit(True))


def reports(docs, bench, models):
    yield pii.find(docs)
    yield toxicity.scored(docs, models[1], 0.7, F.lit(False))
    yield sharding.assign(docs, 4, 64)
    yield decontaminate.report(docs, bench)
    yield exact_dedup.groups(docs, "largest")
    yield quality.scored(docs, models[0], 0.3, F.lit(False))
    yield order_minhash.classes(docs)
    yield line_dedup.line_report(docs, 2)
    yield substring_dedup.report(docs, 5)


def keepers(docs, bench, models):
    yield pii.mask(docs)
    yield toxicity.remove_toxic(docs, models[1], 0.7)
    yield decontaminate.remove_contaminated(docs, bench)
    yield exact_dedup.deduplicate(docs, "largest")
    yield order_minhash.deduplicate(docs)
    yield line_dedup.deduplicate_lines(docs, 2)
    yield substring_dedup.remove(docs, 5)


def test_every_row_is_reported(docs, bench, models):
    want = sorted(str(r[0]) for r in ROWS)
    for out in reports(docs, bench, models):
        assert sorted(str(r["doc_id"]) for r in out.collect()) == want, out.columns


def test_columns_are_kept(docs, bench, models):
    for out in keepers(docs, bench, models):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows
        for r in rows:
            assert [r[c] for c in CLASH] == [f"own {c}" for c in CLASH]


def test_empty_tables(docs, bench, models):
    none = docs.where("false")
    for out in [*reports(none, bench, models), *keepers(none, bench, models), packing.pack(none, tokenizer_path())]:
        assert out.count() == 0
    assert decontaminate.report(docs, bench.where("false")).where("contaminated").count() == 0


def test_packing_edges(docs):
    rows = packing.pack(docs, tokenizer_path()).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS)
    assert all(r["length"] == 1 for r in rows if r["doc_id"] in (2, 3, 5))


def test_repeated_rows_and_nulls_in_exact_dedup(docs):
    rows = exact_dedup.groups(docs, "largest").collect()
    assert sum(r["kept"] for r in rows) == 5
    same = [r for r in rows if r["group_size"] == 3]
    assert {r["doc_id"] for r in same} >= {1} and sum(r["kept"] for r in same if r["doc_id"] == 1) <= 1
    assert sorted(str(r["doc_id"]) for r in exact_dedup.deduplicate(docs, "largest").collect()) == ["1", "3", "4", "5", "6"]


def test_wordless_texts_are_alone(docs):
    rows = order_minhash.classes(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] in (2, 3, 5)} == {2: 2, 3: 3, 5: 5}
