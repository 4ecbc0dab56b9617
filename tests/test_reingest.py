"""Re-ingest against a full rebuild: nothing is written twice, broken buckets are made anew, documents that lose their chunks or go."""

import os
import shutil

from loomdoc.operators import reingest as R
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string"


def words(docs):
    """A chunk a word; empty texts have none."""
    return docs.select("doc_id", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("n", "word"))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for part in ("chunks", "catalogue") for d, _, names in os.walk(f"{path}/{part}") for f in names}


def rows_of(df):
    return sorted((r["doc_id"], r["n"], r["word"]) for r in df.collect())


def test_runs(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    out = f"file://{tmp_path}/s"
    first = [(i, f"a{i} b{i % 3} c") for i in range(40)] + [(50, ""), (51, None), (None, "no id")]
    second = [(i, t + " new" if (i or 1) % 7 == 0 or i == 0 else t) for i, t in first if i != 3 and i != 50] + [(60, "sixty"), (51, "now text"), (4, "twice")]
    r = R.reingest(df(first), out, words, buckets=8)
    assert {k: r[k] for k in ("new", "changed", "gone", "kept")} == {"new": 42, "changed": 0, "gone": 0, "kept": 0}
    assert rows_of(R.stored(spark, out)) == rows_of(words(df(first)).where("doc_id IS NOT NULL"))
    r = R.reingest(df(second), out, words, buckets=8)
    changed = len([i for i, _ in first if i is not None and i < 40 and i % 7 == 0]) + 2  # 51 and 4 too
    assert {k: r[k] for k in ("new", "changed", "gone")} == {"new": 1, "changed": changed, "gone": 2}
    want = rows_of(words(df(second)).where("doc_id IS NOT NULL"))
    assert rows_of(R.stored(spark, out)) == want
    before = files(f"{tmp_path}/s")
    assert R.reingest(df(second).repartition(5), out, words, buckets=8)["buckets"] == 0 and files(f"{tmp_path}/s") == before
    # a bucket that was lost
    lost = next(d for d in sorted(os.listdir(f"{tmp_path}/s/chunks")) if d.startswith("bucket="))
    shutil.rmtree(f"{tmp_path}/s/chunks/{lost}")
    assert R.reingest(df(second), out, words, buckets=8)["buckets"] == 1
    assert rows_of(R.stored(spark, out)) == want
    # all go
    assert R.reingest(df([]), out, words, buckets=8)["kept"] == 0
    assert rows_of(R.stored(spark, out)) == [] and R.reingest(df([]), out, words, buckets=8)["buckets"] == 0
