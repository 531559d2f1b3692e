"""The opN queries and the pipeline on the smallest tables."""

import json
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from support import ROOT, canonical, oracle_rows

from runlens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    rows = found.collect()
    columns, expected = oracle_rows(sf_dir, queries.ORACLE_SQL[name])
    assert canonical(found.columns, rows) == canonical(columns, expected)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_returns_a_row_for_each_input(spark, sf_dir, name):
    source = "pages" if name.startswith("op7_") else "documents"
    key = "page_id" if source == "pages" else "doc_id"
    ids = Counter(r[0] for r in spark.read.parquet(f"{sf_dir}/{source}.parquet").select(key).collect())
    found = Counter(r[0] for r in queries.QUERIES[name](spark, sf_dir).select(key).collect())
    assert set(found) == set(ids) and (name.startswith("op8_") or found == ids)


def test_languages_of_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op12_language_id"](spark, sf_dir).join(docs, "doc_id").where("held_out AND lang_pred <> 'und'")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count() > 0


def test_pipeline_stages(spark, sf_dir):
    """Each stage on its predecessor's rows, against plain versions of its decision."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontaminate", "packing"]
    before, columns = docs.collect(), docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(before, docs.schema), sf_dir)
        assert out.columns == columns
        after = out.collect()
        held = {r["doc_id"]: r for r in before}
        if name == "line_dedup":
            assert {r["doc_id"] for r in after} == set(held)
            first = {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                for line in r["text"].split("\n"):
                    first.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r")), r["doc_id"])
            for r in after:
                kept = [x for x in held[r["doc_id"]]["text"].split("\n") if len(k := "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))) < 10 or first[k] == r["doc_id"]]
                assert r["text"] == "\n".join(kept) and r["n_chars"] == len(r["text"])
        else:
            assert all(held[r["doc_id"]] == r for r in after) and len(after) <= len(before)
        if name == "jaccard_join":
            from test_llm_operators import brute_components

            want = {i for i, _, c in brute_components([(r["doc_id"], r["text"]) for r in before]) if i == c}
            assert {r["doc_id"] for r in after} == want
        before = after
    pieces = pipeline.STAGES[-1][1](spark, spark.createDataFrame(before, docs.schema), sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in before}
    whole = pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, pieces))


def test_quality_stage_removes_frequent_lines(spark, sf_dir):
    """Short lines and lines that differ in digits or inner white space, which line dedup leaves alone."""
    import corpus_pipeline as pipeline

    body = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    text = lambda k: f"Home\n{body(k)}\n\nPage {k + 10} of 80\nall  rights" + " " * (k % 3) + f" kept\nmine {'ab' * (k + 1)}"
    rows = [(k, text(k), "s", len(text(k))) for k in range(25)] + [(k, text(k), "few", len(text(k))) for k in range(100, 110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    found = pipeline.quality(spark, docs, sf_dir)
    assert found.schema["n_chars"].dataType == docs.schema["n_chars"].dataType and found.columns == docs.columns
    want = {i: t if i == 0 or s == "few" else f"{body(i)}\n\nmine {'ab' * (i + 1)}" for i, t, s, _ in rows}
    after = found.collect()
    assert {r["doc_id"]: r["text"] for r in after} == want and len(after) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


NAMES = "_key string, _gone string, _nth string, row string, text_key string, kept string, rows string, host string, removed_lines string, cut_text string, n_dropped string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated ids and rows, ties, empty and long texts, and clashing names."""
    say = lambda k, n=60: " ".join(f"w{k}x{j}" for j in range(n))
    body = say(1)
    item = " ".join(f"b{j}" for j in range(12))
    texts = [(1, body), (3, body + " x"), (3, say(2)), (3, say(2)), (4, None), (4, ""), (5, " \n\t"), (None, body), (None, None), (6, say(3) + " " + item), (None, say(4) + " " + item), (7, say(5, 40_000)), (8, say(5, 40_000) + " end"), (9, "a line of some length\n" + say(6)), (10, "a line of some length\n" + say(7)), (10, "A Line of some length \n" + say(8)), (11, "a line of some length")]
    rows = [(i, t, None if k == 2 else "s", None if t is None else len(t), *(["x"] * 10), None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + NAMES).repartition(4), item


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_on_odd_rows(spark, tmp_path, odd):
    import corpus_pipeline as pipeline
    from test_llm_operators import shingles

    docs, item = odd
    spark.createDataFrame([(1, item), (None, "w1x0"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = docs.collect()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        assert all(r["_key"] == "x" and r["rows"] == "x" and (r["n_chars"] is None if r["text"] is None else r["n_chars"] == len(r["text"])) for r in out.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    both = [(r["doc_id"], r["text"]) for r in rows]
    # quality: 50 words at least, no text of repeated windows here
    assert pairs(pipeline.quality(spark, docs, str(tmp_path))) == sorted(((i, t) for i, t in both if len((t or "").split()) >= 50), key=repr)
    # decontamination: the item of twelve words is in two documents
    assert pairs(pipeline.benchmark(spark, docs, str(tmp_path))) == sorted(((i, t) for i, t in both if item not in (t or "")), key=repr)
    # near copies: by id and text, one of each group and of equal rows
    kept = []
    for i, t in sorted(both, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        own = shingles(t)
        linked = any(j is not None and own and 100 * len(own & (x := shingles(u))) >= 85 * len(own | x) for j, u in kept)
        if i is None or not (linked or (i, t or "") in ((j, u or "") for j, u in kept)):
            kept.append((i, t))
    found = pairs(pipeline.near_copies(spark, docs, str(tmp_path)))
    assert sorted(((i, t or "") for i, t in found), key=repr) == sorted(((i, t or "") for i, t in kept), key=repr)
    # lines: the first of its id and key stays
    after = dict(pairs(pipeline.lines(spark, docs.where("doc_id in (9, 11)"), str(tmp_path))))
    assert after == {9: next(t for i, t in both if i == 9), 11: ""}
    pieces = pipeline.sequences(spark, docs.where("doc_id = 4 or doc_id is null"), str(tmp_path)).collect()
    assert len(pieces) >= 5


def test_library_works_without_this_subpackage(tmp_path):
    """As after deletion of the folders: the entry module imports and registers the rest."""
    for item in ROOT.iterdir():
        if item.name not in ("corpus_pipeline.py", ".git"):
            (tmp_path / item.name).symlink_to(item)
    (tmp_path / "runlens").unlink()
    (tmp_path / "runlens").mkdir()
    for item in (ROOT / "runlens").iterdir():
        if item.name != "llm":
            (tmp_path / "runlens" / item.name).symlink_to(item)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    env = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    names, sql = json.loads(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout)
    assert "pivot_order_line" in names and not any(n.startswith("op") or n == "pipeline" for n in [*names, *sql])
    assert Path(tmp_path / "runlens" / "llm").exists() is False
