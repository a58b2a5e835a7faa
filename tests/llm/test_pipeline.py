"""The stages one after another, each held against the operator's own brute-force rules."""

from __future__ import annotations

import re

import corpus_pipeline
from tests.llm.test_text_operators import LOW, brute_classes, docs, texts, words  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = frame.columns, [frame.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == columns
        rows = frame.collect()
        seen.append(rows)
        frame = spark.createDataFrame(rows, frame.schema)
    raw, good, single, clean, mixed = seen
    assert {r.doc_id for r in good} < {r.doc_id for r in raw} and all(len(words(r.text)) >= 10 for r in good)
    ordered = sorted(good, key=lambda r: r.doc_id)
    classes = brute_classes([r.text for r in ordered])
    assert sorted(r.doc_id for r in single) == [ordered[i].doc_id for i, (n, c) in classes.items() if c == i or not n]
    phrases = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOW))
        phrases |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} - {()}

    def contaminated(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        hit = {i + k for i in range(len(w)) for p in [tuple(w[i : i + 13])] if p in phrases for k in range(len(p))}
        return bool(hit)

    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single if not contaminated(r.text))
    size = lambda rows: {s: sum(len(words(r.text)) for r in rows if r.source == s) for s in {r.source for r in clean}}
    longest = max(len(words(r.text)) for r in clean)
    assert abs(sum(size(mixed).values()) - sum(size(clean).values())) <= longest * len(size(clean))


def test_run_gives_one_row_per_document_taken(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
