import os
from collections import defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import canonical
from stockline.llm import packing
from stockline.llm.queries import QUERIES, fold, table
from stockline.llm.sql import ORACLE
from stockline.llm.store import keep
from stockline.llm import toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert sorted(k.split("_")[0] for k in QUERIES) == sorted([*(f"op{n}" for n in range(1, 14)), "pipeline"])


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, key):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    df, result = QUERIES[key](spark, SF), con.execute(ORACLE[key])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), names)


def test_every_stage_keeps_what_brute_force_keeps(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, table(spark, SF, "labels"), fold(4) != 2).collect()}

    def benign(d):
        return {i for i in d if scores[i] < toxicity.THRESHOLD}

    def single(d):
        return {i for i, v in brute.exact(d).items() if v[2]}

    def apart(d):
        return {i for i, v in brute.near_groups(d).items() if v[1] == i}

    def clean(d):
        return {i for i, v in brute.contaminated(d, items).items() if not v[4]}

    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], (benign, single, apart, clean)):
        want = plain(texts)
        out, _ = keep(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) == len(want) and {r["doc_id"]: r["text"] for r in rows} == {i: texts[i] for i in want}, name
        docs, texts = out, {i: texts[i] for i in want}

    lengths = defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        lengths[r["doc_id"]] += r["length"]
    encode = packing.encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert lengths == {i: len(encode(t or "")) + 1 for i, t in texts.items()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == set(texts)
