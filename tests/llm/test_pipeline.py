"""Stages of the corpus pipeline, each on its own input, and the registry."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from foliant.llm import line_dedup, mixing, near_dedup, registry


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_registry():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in registry.QUERIES} and "pipeline" in names
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(corpus_pipeline.STAGES) == 5


def test_language_stage_keeps_clean_documents(spark, docs, sf, monkeypatch):
    extra = spark.createDataFrame([(10**6, "123 !!", None, "s", 6), (10**6 + 1, None, None, "s", None)], docs.schema)
    got = corpus_pipeline.identify_language(spark, docs.union(extra), sf)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in docs.collect()}


def test_language_stage_drops_noise(spark, docs, sf):
    import base64
    import random

    rng = random.Random(3)
    noise = [base64.b64encode(rng.randbytes(n)).decode() for n in (30, 100, 900)] + ["".join(rng.choice("asdfghjkl qwertyuiop") for _ in range(n)) for n in (60, 300, 900)]
    noise += ["Сегодня хорошая погода, и мы идём гулять в парк.", "今日は天気がいいので公園へ散歩に行きます。", rng.randbytes(80).hex()]
    extra = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(noise)], docs.schema)
    got = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.union(extra), sf).collect()}
    assert got == {r["doc_id"] for r in docs.collect()}


def test_line_stage(spark, docs, sf):
    got = {r["doc_id"]: r for r in corpus_pipeline.drop_frequent_lines(spark, docs, sf).collect()}
    want = {r["doc_id"]: r["kept"] for r in line_dedup.dedup_lines(docs).collect()}
    assert {k: r["text"] for k, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_near_stage_keeps_one_of_each_group(spark, docs, sf):
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()]
    assert sorted(kept) == sorted(set(found.values()))


def test_mixing_stage_takes_what_the_mix_says(spark, docs, sf):
    at, _, cuts = mixing.mix(docs)
    want = {r["doc_id"]: r["taken"] for r in mixing.taken(at, cuts).collect()}
    got = Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, sf).collect():
        got[r["doc_id"]] += len(r["text"].split())
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 4096 for r in full)


def test_run_against_brute_force(spark, docs, sf):
    """Lines, near duplicates and token ids by plain Python; the mix, which is pseudorandom,
    by its operator on what these leave. The language stage rejects none of these."""
    import zlib

    import numpy as np
    from test_corpus import _brute_components, _brute_lines
    from tokenizers import Tokenizer

    from foliant.llm import packing

    rows = {r["doc_id"]: r for r in docs.collect()}
    lines = {d: text for d, text, _, _ in _brute_lines([(d, r["text"]) for d, r in rows.items()], 10)}
    kept = [d for d, (_, c) in _brute_components(sorted(lines.items()), 5).items() if c == d]
    left = spark.createDataFrame([(d, lines[d], rows[d]["lang"], rows[d]["source"], len(lines[d])) for d in kept], docs.schema)
    tokenizer, want = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for r in mixing.mixed_documents(left).collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want[r["doc_id"], k // 4096, k, len(own), zlib.crc32(own.tobytes())] += 1
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want


def test_stages_on_hard_rows(spark, hard, none, sf):
    for name, stage in corpus_pipeline.STAGES:
        for rows in (hard.drop("kept", "batch", "n"), none):
            out = stage(spark, rows, sf)
            assert name == "best_fit_packing" or out.columns == rows.columns
            out.count()
