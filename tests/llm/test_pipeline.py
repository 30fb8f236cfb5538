"""The pipeline against plain versions of its stages, and the queries against their SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline  # noqa: E402
from oracle import compare, connect  # noqa: E402
from semdrift.llm import queries  # noqa: E402
from test_contents import check_bins, plain_hits  # noqa: E402
from test_dedup import plain_classes, plain_lines, plain_print  # noqa: E402


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, key):
    problem, rows = compare(spark, connect(sf_dir), sf_dir, queries.QUERIES[key], queries.ORACLES[key])
    assert problem is None and rows


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], sf_dir).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    assert all(t.columns == columns for t in tables[:-1])
    rows = [t.collect() for t in tables]
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    left = {r.doc_id for r in rows[1]}
    assert len(good & left) >= 0.95 * len(good & {r.doc_id for r in rows[0]})
    from semdrift.llm.lines import MIN_PAGES, RATIO

    want = plain_lines([(r.doc_id, r.source, r.text) for r in rows[1]], RATIO, MIN_PAGES)
    assert sorted(((r.doc_id, r.text) for r in rows[2]), key=repr) == want
    assert all(r.n_chars == len(r.text) for r in rows[2])
    prints = {r.doc_id: plain_print(r.text) for r in rows[2]}
    root, first = plain_classes(prints.values()), {}
    for d, p in sorted(prints.items()):
        first.setdefault(root[p], d)
    assert {r.doc_id for r in rows[3]} == set(first.values())
    clean = [h[0] for h in plain_hits([(r.doc_id, r.text) for r in rows[3]], bench) if not h[5]]
    assert sorted(r.doc_id for r in rows[4]) == sorted(clean)
    from semdrift.llm.packing import LENGTHS

    check_bins(rows[5], [(r.doc_id, len(r.text.encode().split()) + 1) for r in rows[4]], LENGTHS)


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "bin_length"]


def test_stages_take_odd_rows(spark, odd, sf_dir):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == odd.columns
    assert {r.doc_id for r in docs.collect()} >= {4, None}


def test_rows_that_share_an_id_or_have_none(spark, sf_dir):
    """Two unlike texts under one id stay; near copies under one id or none go; only rows that quote the benchmark go."""
    quote = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    text = [" ".join(words[i:] + words[:i]) * 3 for i in range(6)]
    rows = [(1, text[0]), (1, "quite another text of its own and nothing like the first one at all"), (1, text[0]), (None, text[0]), (None, "alone without an id in this small table of rows"),
            (2, "a clean text beside a quote under one id, which has to stay where it is"), (2, f"so it says {quote} here"), (None, quote)]
    docs = spark.createDataFrame([(*r, {"k": "v"}, 7) for r in rows], "doc_id long, text string, row map<string, string>, group int").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    left = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert left == sorted((i or 0, t) for i, t in [rows[0], rows[1], rows[4], rows[5], rows[6], rows[7]])
    clean = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.decontamination(spark, kept, sf_dir).collect())
    assert clean == sorted((i or 0, t) for i, t in [rows[0], rows[1], rows[4], rows[5]])
