from __future__ import annotations

import json
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidegrid.llm import decontaminate, jaccard_join, packing, quality
from tidegrid.llm.common import table
from tidegrid.llm.queries import vocabulary

from .conftest import words
from .test_joins_and_packing import slow_components, slow_contaminated, slow_lines


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns, before, kept = docs.columns, docs.count(), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
    labels = table(spark, sf, "labels")
    good = labels.filter("quality = 1").join(table(spark, sf, "documents"), "doc_id").count()
    assert kept["quality"].join(labels.filter("quality = 1"), "doc_id").count() >= 0.97 * good
    assert kept["quality"].join(labels.filter("quality = 0"), "doc_id").count() <= 1
    last = kept["decontamination"]
    assert decontaminate.contaminated(last, table(spark, sf, "benchmark")).count() == 0
    assert jaccard_join.jaccard_components(kept["near_duplicates"]).filter("component_id <> doc_id").count() == 0
    assert {r.doc_id for r in kept["packing"].select("doc_id").distinct().collect()} == {r.doc_id for r in last.select("doc_id").collect()}
    assert kept["packing"].groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0
    assert quality.width(1) > 0 and packing.cut_points(1, 2048) == [(0, 1)]


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_stages_with_any_other_columns(spark, sf):
    docs = table(spark, sf, "documents")
    for c in ("quality_score", "score_", "gone_", "__gone", "__doc", "__text", "doc_", "places", "places_", "left_", "a.b", "t`x", "o", "lid", "token", "label", "Component_ID"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.filter("`a.b` <> 'own a.b' OR `__gone` <> 'own __gone' OR quality_score <> 'own quality_score' OR `t``x` <> 'own t`x'").count() == 0 and out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def slow_quality(model, rows):
    """Scores by the sum over all pairs of features."""
    out = {}
    for doc, text in rows:
        _, columns, x = quality.featurize([text], [[None if text is None else float(len(text))]])
        moved = model.factors[columns] * x[:, None]
        each = moved @ moved.T
        margin = model.bias + model.weights[columns] @ x + (each.sum() - np.trace(each)) / 2
        out[doc] = 1 / (1 + np.exp(-margin))
    return out


def slow_packing(lengths):
    """How many sequences best fit decreasing fills, one piece after the other."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 2048) - n)
    return len(gaps)


def test_run_against_slow_versions(spark, sf, tmp_path):
    """run() on short documents, with copies, near copies, repeated lines and benchmark passages planted, against plain loops."""
    rng = random.Random(5)
    whole = table(spark, sf, "documents")
    documents = {r.doc_id: r.text for r in whole.collect() if len(r.text or "") < 1500}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    good = [r.doc_id for r in table(spark, sf, "labels").filter("quality = 1").collect() if r.doc_id in documents]
    for k in range(30):
        at, text = 10**6 + k, documents[good[k % len(good)]]
        w = text.split(" ")
        place = rng.randrange(len(w))
        changed = " ".join(w[:place] + ["other"] + w[place + 1 :])
        documents[at] = (text, changed, text + "\n" + items[k][1], text + "\n" + changed, changed + "\n" + documents[good[-1 - k % 3]])[k % 5]
    documents |= {2 * 10**6: None, 2 * 10**6 + 1: "", 2 * 10**6 + 2: " \n "}
    made = spark.createDataFrame([(i, t, "en", "made", len(t or "")) for i, t in documents.items()], "doc_id long, text string, lang string, source string, n_chars long")
    made.select(*(F.col(c).cast(whole.schema[c].dataType).alias(c) for c in whole.columns)).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, sf, name).write.parquet(f"{tmp_path}/{name}.parquet")

    model = quality.train(table(spark, str(tmp_path), "documents"), table(spark, sf, "labels"), metadata=("n_chars",))
    scores = slow_quality(model, documents.items())
    assert all(abs(s - 0.7) > 1e-6 for s in scores.values())
    rows = sorted((i, t) for i, t in documents.items() if scores[i] >= 0.7)
    lost = slow_lines(rows, 5, 80, 100)
    left = []
    for i, text in rows:
        kept = [x for k, x in enumerate((text or "").split("\n")) if (i, k) not in lost]
        if any(d == i for d, _ in lost):
            text = "\n".join(kept)
            if not words(text):
                continue
        left.append((i, text))
    first = {i for i, _, least in slow_components(left, 5, 80, 100) if i == least}
    once = [(i, t) for i, t in left if i in first]
    held = {doc for doc, _ in slow_contaminated([(i, t.lower() if t else t) for i, t in once], [(k, t.lower()) for k, t in items])}
    last = {i: t for i, t in once if i not in held}
    assert len(documents) > len(rows) > len(left) > len(last) > 20 and lost and held

    from tokenizers import Tokenizer

    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = Tokenizer.from_str(json.dumps(json.load(f)))
    expected = set()
    for i, text in last.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        expected |= {(i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut_points(len(ids), 2048))}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == expected and len(got) == len(expected)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = [0]
        for offset, n in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 2048
    assert len(sequences) == slow_packing([r.length for r in got])
