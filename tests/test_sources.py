"""The news file of read_news_jsonl is written by many tasks, and its lines keep their ids apart."""

import os

from roadlens.plans.catalog import QUERIES
from roadlens.sources import readers as RD
from roadlens.sources import sinks as SK


def test_news_lines_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    text = "Headline {0}\nbody {0}"
    docs = [(i, text.format(i), "en", "src", 20) for i in range(100)] + [(None, "no id", "en", "src", 5), (25, text.format(25), "en", "src", 20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "http://a/0", ""), (1, "http://a/1", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    used = []
    monkeypatch.setattr(SK, "scratch_dir", lambda *a, f=SK.scratch_dir: used.append(f(*a)) or used[-1])
    got = sorted((r.doc_id, r.title, r.ord) for r in QUERIES["read_news_jsonl"](spark, str(tmp_path)).collect())
    copies = {i: 1 + (i % 25 == 0) for i in range(100)} | {25: 4}
    assert got == [(i, f"Headline {i}", k + 1) for i in range(100) for k in range(copies[i])]
    path = used[0].removeprefix("file:")
    assert sum(f.startswith("part-") and f.endswith(".txt") and os.path.getsize(f"{path}/{f}") > 1 for f in os.listdir(path)) > 1


def test_equal_lines_of_one_file_keep_ids_apart(spark, tmp_path):
    line = '{"doc_id": 1, "title": "t"}'
    (tmp_path / "a.txt").write_text(f"{line}\n{line}\n\n{line} \n")
    (tmp_path / "b.txt").write_text(f"{line}\n")
    got = RD.read_news_jsonl(spark, str(tmp_path)).collect()
    assert len(got) == 4 and len({r.record_id for r in got}) == 4 and {r.title for r in got} == {"t"}
