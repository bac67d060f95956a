"""The network of the secret scans learns from all documents, in parts."""

import numpy as np

from nestegg.llm import secret_scan as ss


def test_secrets_of_every_document_are_learned_from(spark):
    """More than a sample of documents and windows: each finding is in, and comes once."""
    rows = [(i if i % 5 else None, f"row password=abc{i:09d}xyz{i % 7}") for i in range(4000)] + [(1, "row password=abc000000001xyz1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ss.corpus_findings(docs, "text").count() == 4000
    network = ss.learn_network(docs)
    again = ss.learn_network(docs.repartition(5))
    assert all((a == b).all() for a, b in zip(network[:4], again[:4])) and network[4:] == again[4:]
    found = {(len(r.spans), r.spans[0].kind) for r in ss.with_secrets(docs, network).select("spans").collect()}
    assert found == {(1, "assign")}
    windows, labels = ss.made_findings(np.random.default_rng(11), 600)
    taken = network.probability(windows) >= network.threshold
    assert taken[labels == 1].mean() > 0.9 and taken[labels == 0].mean() < 0.1
