"""The pipeline's stages on the smallest driver tables, and their registration."""

import corpus_pipeline as cp
from nestegg.llm.common import read_table
from nestegg.llm.decontaminate import contamination
from nestegg.llm.simhash import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_on_what_is_kept(spark):
    docs = read_table(spark, SF, "documents")
    before, now = docs.count(), docs
    for name, step in cp.STAGES[:-1]:
        now = step(spark, now, SF).cache()
        assert now.columns == docs.columns, name
    kept = {r.doc_id for r in now.select("doc_id").collect()}
    assert 0 < len(kept) < before and now.count() == len(kept)
    assert contamination(now, read_table(spark, SF, "benchmark")).filter("n_hit > 0").isEmpty()
    assert now.filter("n_chars != length(text)").isEmpty()
    first = cp.STAGES[0][1](spark, docs, SF).cache()
    second = cp.STAGES[1][1](spark, first, SF)
    groups = near_duplicates(first).select("component_id").distinct().count()
    assert second.count() == groups
    mixed = cp.STAGES[-1][1](spark, now, SF)
    assert mixed.count() == len(kept) and mixed.filter("taken > 2 * size").isEmpty()


def test_everything_is_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
