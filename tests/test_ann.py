"""The cluster index against exact search for every stated query."""

import pytest

from strataloom.operators import ann
from strataloom.plans import registry


@pytest.mark.parametrize("size", ["sf0.01"])
def test_recall_over_all_queries(spark, small, size):
    root = small.replace("sf0.001", size)
    e = spark.read.parquet(f"{root}/embeddings.parquet")
    rows = registry.queries()["ann_topk"](spark, root).collect()
    exact = [r for r in rows if r["exact"]]
    assert {r["qid"] for r in exact} == {r[0] for r in e.where("vec_id % 50 = 0").select("vec_id").collect()}
    recall = sum(r["rank"] is not None for r in exact) / len(exact)
    assert recall >= 0.9, recall


def test_batch_equals_single_search(spark, small):
    e = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/embeddings.parquet")
    centers, indexed = ann.build(e, "embedding", 16)
    q = e.where("vec_id in (0, 50, 100)").selectExpr("vec_id as qid", "embedding as qvec")
    got = {(r["qid"], r["vec_id"]) for r in ann.search_batch(centers, indexed, "embedding", q, 5, 3, "vec_id", 1).collect()}
    assert got == {(r["qid"], x["vec_id"]) for r in q.collect() for x in ann.search(centers, indexed, "embedding", list(r["qvec"]), 5, 3, "vec_id").collect()}
