"""Every stage of the pipeline on the smallest documents against plain versions."""

import os

import numpy as np
import pytest

import corpus_pipeline
from codeloom.llm import quality, tokens
from codeloom.llm.common import stored

from . import brute

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = stored(stages[name](spark, docs, SF), "stage")
        assert out.columns == docs.columns
        return out, {r.doc_id: r for r in out.collect()}, {r.doc_id: r for r in docs.collect()}

    docs, kept, before = step("quality rules", docs)
    for d, r in before.items():
        n, _, _, _, again = brute.quality_counts(r.text)
        assert not (d in kept and (n < 10 or 100 * again > 20 * n))
    verdict = {r.doc_id for r in quality.quality(quality.features(spark.read.parquet(f"{SF}/documents.parquet"))).where("kept").collect()}
    assert set(kept) == verdict

    docs, kept, before = step("MinHash near-dedup", docs)
    ids = sorted(before)
    classes, _ = brute.near_classes([before[d].text for d in ids])
    assert set(kept) == {ids[c] for c in classes}

    docs, kept, before = step("benchmark decontamination", docs)
    known = brute.windows((r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    assert set(kept) == {d for d, r in before.items() if not brute.hits(r.text, known)[1]} and kept != before

    docs, kept, before = step("PII", docs)
    assert set(kept) == set(before)
    for d, r in before.items():
        for kind, a, b in brute.base_spans(r.text):
            assert kind not in ("email", "phone") or r.text[a:b] not in kept[d].text
        if "<" not in kept[d].text:
            assert kept[d].text == r.text
        assert kept[d].n_chars == len(kept[d].text)

    pieces = stages["best-fit packing"](spark, docs, SF).collect()
    tok = tokens.load(tokens.public_path("word_bpe_49k.json"))
    want = {d: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in kept.items()}
    total = {d: 0 for d in want}
    for p in pieces:
        total[p.doc_id] += p.length
    assert total == want and len({p.sequence_id for p in pieces}) <= int(np.ceil(sum(want.values()) / 2048)) + 1
