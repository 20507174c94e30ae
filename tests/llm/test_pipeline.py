"""The pipeline against a plain version of each stage, on small tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_simhash import brute_components
from test_pii import base

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = ["the", "of", "and", "thing", "ation", "er", "ing", "that", "with", "stone", "river", "light"]
    word = lambda: rnd.choice(words) + rnd.choice(words)
    rows, labels = [], []
    for i in range(160):
        t = " ".join(word() for _ in range(rnd.randrange(30, 120))) + "."
        if i % 4 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
            labels.append((i, 0, 0))
        else:
            labels.append((i, 1, 0))
            if i % 9 == 1:
                t += f" mail me.{i}@mail.example.com or +1 (832) 555-8455"
        rows.append((i, t, "en", rnd.choice(["a", "a", "b", "c"]), len(t)))
    rows += [(500 + k, rows[k][1], "en", "a", rows[k][4]) for k in (1, 1, 2, 3)]
    rows += [(900, None, None, None, 0), (901, "", "en", "a", 0), (None, "no id here at all, only text", None, "b", 28)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test-stage")
        after[name] = docs
        if name != "packing":
            assert docs.columns == columns
    kept = {r["doc_id"]: r for r in after["quality"].collect()}
    assert not any(i in kept for i in range(0, 160, 4)) and all(i in kept for i in range(160) if i % 4)
    want = brute_components([(r["doc_id"], r["text"]) for r in after["quality"].collect()])
    names = {str(c) for _, _, c in want}
    assert sorted(str(r["doc_id"]) for r in after["near duplicates"].collect()) == sorted(names)
    for r in after["personal data"].collect():
        assert not base(r["text"]) and r["n_chars"] == len(r["text"] or "")
    before = {r["doc_id"]: tuple(r) for r in after["personal data"].collect()}
    mixed = [tuple(r) for r in after["mixing"].collect()]
    size = lambda rows: sum(len((r[1] or "").split()) for r in rows)
    assert all(before[r[0]] == r for r in mixed) and abs(size(mixed) - size(before.values())) < 300
    assert max(sum(m[0] == r[0] for m in mixed) for r in mixed) <= 3
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: [*lib.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in mixed}
    pieces = after["packing"].collect()
    assert sum(p["length"] for p in pieces) == sum(len(ids[r[0]]) for r in mixed)
    assert all(zlib.crc32(np.array(ids[p["doc_id"]][p["start"]:p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for p in pieces)
    run = corpus_pipeline.run(spark, sf_dir)
    key = lambda rows: sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(run.collect()) == key(pieces)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_pass_every_stage(spark, sf_dir):
    """Columns named like those that the stages use themselves come through with their values."""
    from pyspark.sql import functions as F
    names = ["key", "_key", "key_1", "row", "counts", "base", "_base", "loose", "_loose", "apart", "_apart", "changed", "whole_text", "size", "number",
             "copies", "rate", "target", "end", "before", "level_1", "source_size", "component", "fp", "bin", "quality", "score"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumns({n: F.concat_ws("/", F.lit(n), "doc_id") for n in names})
    docs = corpus_pipeline.materialize(docs, "test-names")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            assert out.count() > 0
            break
        docs = corpus_pipeline.materialize(out, "test-stage")
        assert docs.columns[-len(names):] == names and docs.count() > 0
        for r in docs.collect():
            assert all(r[n] == (f"{n}/{r['doc_id']}" if r["doc_id"] is not None else n) for n in names)


def test_a_run_leaves_only_its_result(spark, sf_dir):
    from hitfeed.session import scratch_root
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stages = lambda: {s.getPath().getName() for s in fs.listStatus(root) if "hitfeed-stage-" in s.getPath().getName()}
    before = stages()
    n = corpus_pipeline.run(spark, sf_dir).count()
    assert n > 0 and len(stages() - before) == 1 and all("packing" in s for s in stages() - before)
