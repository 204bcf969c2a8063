"""The registered corpus queries and the pipeline against SQL and against what each stage must do."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from folioworks.llm import exact, registry
from folioworks.llm.scratch import table
from tests.test_oracle import canonical, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con: duckdb.DuckDBPyConnection = duck(SF)
    assert canonical(registry.queries()[name](spark, SF).toPandas()) == canonical(con.execute(registry.oracle_sql()[name]).df())


def test_every_query_covers_its_table(spark):
    n = table(spark, SF, "documents").count()
    for name in ("op2_tokeniser_fertility", "op4_boosted_quality", "op6_toxic_spans", "op9_licence_scan", "op10_simhash_groups"):
        assert registry.queries()[name](spark, SF).count() == n


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name == "exact_dedup":
            assert exact.exact_groups(docs).filter("group_size > 1").count() == 0
    assert counts[0] >= counts[1] >= counts[2] > 0
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage after the model against plain Python over the rows that it was given."""
    from folioworks.llm import packing, toxicity
    from tests.llm.test_mixing import plain_targets
    from tests.llm.test_packing import plain_pieces
    from tests.llm.test_simhash import plain_components, plain_fingerprint

    given, tables = table(spark, SF, "documents"), {}
    labels = table(spark, SF, "labels")
    rejected = {r["doc_id"] for r in toxicity.verdicts(given, labels).filter("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given, SF).write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
        tables[name] = given.collect()
    whole = table(spark, SF, "documents").collect()
    clean = {r["doc_id"]: r["text"] for r in whole if r["doc_id"] not in rejected}
    assert {r["doc_id"]: r["text"] for r in tables["toxicity"]} == clean
    last = {}
    for doc, text in sorted(clean.items()):
        last[(text or "").encode().lower()] = doc
    assert sorted(r["doc_id"] for r in tables["exact_dedup"]) == sorted(last.values())
    by_fp = {}
    for doc in last.values():
        by_fp.setdefault(plain_fingerprint(clean[doc]), []).append(doc)
    stay = set(plain_components(by_fp).values())
    near = tables["simhash_near_dedup"]
    assert {r["doc_id"] for r in near} == stay and len(near) == len(stay)
    sizes, taken = {}, {}
    for r in near:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").encode().split())
    for r in tables["source_mix"]:
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").encode().split())
    longest = max(len((r["text"] or "").split()) for r in near)
    assert all(abs(taken.get(s, 0) - t) <= longest + 0.05 * t for s, t in plain_targets(sizes).items())
    pieces = sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in tables["best_fit_packing"])
    assert pieces == plain_pieces([(r["doc_id"], r["text"]) for r in tables["source_mix"]], packing.Capacity().tokens)


def test_stages_on_odd_rows(spark, docs_of, odd_rows, tmp_path):
    """Nulls, ties, repeated rows, a very long text and clashing columns through all stages, and an empty table."""
    given = docs_of(odd_rows, extra=True)
    columns = given.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, SF)
        if name != "best_fit_packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
        assert given.count() > 0
        if name == "exact_dedup":  # six different texts, and one row each
            assert sorted(r["doc_id"] or -1 for r in given.select("doc_id").collect()) == [2, 3, 5, 6, 7, 8]
    given = docs_of([], extra=True)
    for _, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, SF)
        assert given.count() == 0


def test_intermediate_tables_go(spark):
    """What operators store is in folders of their own in the shared folder, and all of it goes."""
    import os

    from folioworks.llm import scratch

    root = scratch._root(spark).removeprefix("file:").replace("//", "/")
    registry.queries()["op7_systematic_mix"](spark, SF).count()  # a session fills in its own settings at its first query
    before = spark.sparkContext.getConf().getAll()
    settings = {k: spark.conf.get(k, None) for k in scratch.WHILE_WRITING}
    scratch.discard()
    others = set(os.listdir(root))  # the folder is shared: an application that was killed may have left its own
    for name in ("op1_quotation_links", "op3_repeated_phrases", "op5_best_fit_packing", "op7_systematic_mix", "op8_exact_groups", "op10_simhash_groups"):
        registry.queries()[name](spark, SF).count()
        left = [x for x in os.listdir(root) if x.startswith("folioworks-") and x not in others]
        assert len(left) == 1, name
        scratch.discard()
        assert not [x for x in os.listdir(root) if x.startswith("folioworks-") and x not in others], name
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("folioworks_")]
    assert settings == {k: spark.conf.get(k, None) for k in settings} and before == spark.sparkContext.getConf().getAll()
