import os

import numpy as np
import pytest

from readloom.llm import queries
from readloom.llm.toxicity import THRESHOLD

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_rates_are_the_scores_by_source(spark):
    scores = {r.doc_id: r.score for r in queries.p8_scores(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()
    want = {}
    for r in docs:
        n, bad = want.get(r.source, (0, 0))
        want[r.source] = (n + 1, bad + (scores[r.doc_id] >= THRESHOLD))
    got = {r.source: (r.n_docs, r.n_flagged, r.rate) for r in queries.p8_rates(spark, SF).collect()}
    assert got == {s: (n, bad, bad / n) for s, (n, bad) in want.items()}
    assert {r.doc_id for r in queries.p8_found(spark, SF).collect()} == {i for i, x in scores.items() if x >= THRESHOLD}


def test_mix_holds_its_shares(spark):
    mix = queries.p7_mix(spark, SF).collect()
    shares = {r.source: r for r in queries.p7_shares(spark, SF).collect()}
    total = sum(r.n_tokens * r.repeats for r in mix)
    for s, r in shares.items():
        own = [x for x in mix if x.source == s]
        assert r.taken_tokens == sum(x.n_tokens * x.repeats for x in own) and all(x.repeats <= r.max_repeats for x in own)
        assert abs(r.reached_share - r.taken_tokens / total) < 1e-9
    there = {s for s, r in shares.items() if r.available_tokens}
    weight = sum(shares[s].target_share for s in there)
    longest = max(r.n_tokens for r in mix)
    assert all(abs(shares[s].taken_tokens - shares[s].target_share / weight * total) <= longest * len(there) / 2 for s in there)  # each source is within half a document of its want
    assert np.isclose(sum(r.reached_share for r in shares.values()), 1)
