"""The registered queries and the pipeline on the smallest tables."""

import itertools
import json
import re

import __spark_entry__ as entry
import corpus_pipeline
from pyarrow.fs import FileSelector
from pyspark.sql import functions as F

from pitspark.llm import simhash
from pitspark.llm.common import filesystem, shared_dir

SF = "/root/testdata/sf0.001"


def test_queries_are_registered_with_whole_tables(spark):
    q = entry.queries()
    names = [k for k in q if re.match(r"op\d+_", k)]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 11)) and "pipeline" in q
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for k in names:
        if k.split("_")[0] in ("op1", "op2", "op5", "op6", "op7", "op9", "op10"):
            assert q[k](spark, SF).count() == n, k


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/{name.replace(' ', '-')}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() >= docs.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and json.dumps(corpus_pipeline.ORACLE_SQL) == "null"


def test_run_leaves_only_its_result(spark):
    fs, root = filesystem(f"{shared_dir(spark)}/pitspark")
    before = {x.path for x in fs.get_file_info(FileSelector(root, allow_not_found=True))}
    out = corpus_pipeline.run(spark, SF)
    left = [x.path.rpartition("/")[2] for x in fs.get_file_info(FileSelector(root)) if x.path not in before]
    assert len(left) == 1 and left[0].startswith("tokens-") and out.count() > 0


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, a column of a clashing name; and a table without rows."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    good = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").limit(20)
    extra = good.withColumn("row", F.lit("r")).withColumn("k1", F.lit(1)).withColumn("a.b", F.lit(2))
    odd = extra.limit(3).unionByName(extra.limit(3)).unionByName(extra.withColumn("text", F.lit(None).cast("string")).limit(2)).unionByName(extra.withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast(extra.schema["doc_id"].dataType)).limit(2)).unionByName(extra)
    odd.write.parquet(f"{tmp_path}/odd")
    extra.where("false").write.parquet(f"{tmp_path}/none")
    for kind in ("odd", "none"):
        docs = spark.read.parquet(f"{tmp_path}/{kind}")
        columns = docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert out.columns == columns, name
                out.write.parquet(f"{tmp_path}/{kind}-{k}")
                docs = spark.read.parquet(f"{tmp_path}/{kind}-{k}")
        assert (out.count() > 0) == (kind == "odd")


def test_near_dedup_stage_against_all_pairs(spark):
    """Recall and precision of the stage on a whole table: every pair of texts whose five-word shingle sets are 0.8 alike, by brute force."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {}
    for d, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if min(len(sets[a]), len(sets[b])) < 0.8 * max(len(sets[a]), len(sets[b])):
            continue
        n = len(sets[a] & sets[b])
        if not sets[a] | sets[b] or n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one_per_group(docs).collect()}
    want = {d for d in sets if find(d) == d}
    assert len(want) < len(sets) and len(kept & want) >= 0.99 * len(want) and len(kept - want) <= 0.02 * (len(sets) - len(want))
