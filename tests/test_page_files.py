"""Pages as files: equal to their lines, and none of a failed job."""

import os
import pickle

import pytest
from pyspark.sql import functions as F

from tessera.sources import pages as P
from tessera.sources.files import contents, listed, opened


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(root) for f in fs}


def test_lines_become_files_in_order(spark, tmp_path):
    rows = [("k", "a/b", s, k, f"line {s}{k} é") for s in (1, 0) for k in ("y", "x")] + [("k", "index", 0, "", None), ("l", "a/b", 0, "", "other"), ("l", None, 0, "", "lost")]
    rows += [("k", f"p{i}", 0, "", "x") for i in range(40)]
    df = spark.createDataFrame(rows, "kb_id string, page string, section int, key string, line string").repartition(5)
    P.write_lines(df, str(tmp_path))
    got = files(tmp_path)
    assert got["k/a/b.md"] == "line 0x é\nline 0y é\nline 1x é\nline 1y é" and got["k/index.md"] == "" and got["l/a/b.md"] == "other" and len(got) == 43
    P.write_lines(df.where("kb_id = 'l'").withColumn("line", F.lit("new")), str(tmp_path))  # again: pages are replaced
    assert files(tmp_path)["l/a/b.md"] == "new" and len(files(tmp_path)) == 43


def test_a_failed_job_leaves_no_page(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i}", "x") for i in range(20)] + [("../out", "x")], "path string, line string").repartition(3)
    spark.dataSource.register(P.PageFiles)
    with pytest.raises(Exception, match="outside the folder"):
        df.write.format("page_files").mode("append").save(str(tmp_path))
    assert not [f for f in files(tmp_path) if not f.startswith("_staging-")] and not os.path.exists(tmp_path.parent / "out")


def test_the_driver_gets_no_list_of_files(spark, tmp_path):
    """What a task tells the driver has one size, and its files can be moved in parts and again."""
    root, writer = str(tmp_path), P.PageWriter(str(tmp_path))
    sizes = [len(pickle.dumps(writer.write(iter([{"path": f"a/{n}-{i}\n.md", "line": f"é{i}"} for i in range(n)])))) for n in (1, 2000)]
    assert max(sizes) - min(sizes) < 16 and not os.path.exists(f"{root}/a")
    messages = [P.Written(f"{writer.staging}/{own}") for own in os.listdir(f"{root}/{writer.staging}")]
    P.publish(*opened(root), messages[0].own)
    writer.commit([None, *messages])
    got = files(tmp_path)
    assert len(got) == 2001 and got["a/2000-7\n.md"] == "é7" and not os.path.exists(f"{root}/{writer.staging}")


def test_files_are_listed_by_tasks(spark, tmp_path):
    for rel in ("a/b/c/x.md", "a/y.txt", "z.md", "_hidden/x.md", "a/.x.md", "é ü%20/ß.md"):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if rel == "z.md" else rel.encode())
    rels = listed(spark, str(tmp_path))
    assert sorted(r["rel"] for r in rels.collect()) == sorted(["a/b/c/x.md", "a/y.txt", "z.md", "é ü%20/ß.md"])
    assert {r["rel"]: bytes(r["content"]).decode() for r in contents(rels, str(tmp_path)).collect()} == {"a/b/c/x.md": "a/b/c/x.md", "a/y.txt": "a/y.txt", "z.md": "", "é ü%20/ß.md": "é ü%20/ß.md"}
