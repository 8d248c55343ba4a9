import corpus_pipeline
from docloom.llm import queries
from tests.llm.test_dedup import cut_words, groups
from tests.llm.test_tokens import contamination

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = docs.collect()
        if name == "packing":
            assert {r.doc_id for r in after} == before.keys()
            continue
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r.doc_id: r for r in after}
        assert len(kept) == len(after)
        rows = [(i, r.text) for i, r in before.items()]
        if name == "language":
            assert kept.keys() == {i for i, t in rows if t and any(map(str.isalpha, t))}
        elif name == "near_dedup":
            assert kept.keys() == {i for i, (_, c) in groups(rows).items() if c == i}
        elif name == "substring_dedup":
            assert kept.keys() == before.keys()
            for i, (_, lost, text) in cut_words(rows).items():
                assert kept[i].text == (text if lost else before[i].text) and kept[i].n_chars == len(kept[i].text)
        else:
            assert kept.keys() == {i for i, x in contamination(rows, items).items() if not x[4]}


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
