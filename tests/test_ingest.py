import json

import pytest
from pyspark.sql import functions as F

from semdrift.functions import html as H
from semdrift.functions import names as N
from semdrift.operators import ingest, meta
from semdrift.operators.skew import latest_per_key, lookup_join, number_rows, number_within
from semdrift.sources import landed, sinks

RECORD = {"executive_order_number": "12345", "title": "Test Order", "publication_date": "2024-01-01",
          "president": "Test President", "html_url": "http://test.com", "pdf_url": ""}


def test_safe_names(spark):
    titles = ["Test File Name", "Test/File:Name*", "  Spaces  ", "Crème — brûlée", "a--b  c", "___"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select(N.safe_name(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == ["Test_File_Name", "Test_File_Name", "Spaces", "Crème___brûlée", "a_b_c", ""]


def test_listing_pages(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"results": [RECORD, {"title": None, "pdf_url": "http://x/p.pdf"}]}, indent=1))
    (tmp_path / "p2.json").write_text(json.dumps({"results": []}))
    records = ingest.normalise_records(landed.read_listing(spark, str(tmp_path)))
    texts = spark.createDataFrame([("http://test.com", "Test content")], "url string, text string")
    rows = {r["eo_number"]: r for r in ingest.resolve_content(records, texts).collect()}
    assert rows["12345"]["president"] == "Test President" and rows["12345"]["text"] == "Test content"
    assert rows["12345"]["filename"] == "EO_12345_2024-01-01_Test_Order.txt"
    assert rows["NA"]["title"] == "Untitled" and rows["NA"]["text"] == ingest.PDF_ONLY
    assert rows["NA"]["filename"] == "EO_NA__Untitled.txt"


def test_document_files_and_metadata(spark, tmp_path):
    (tmp_path / "EO_1_2001-02-03_A.txt").write_text("line one\nline two")
    (tmp_path / "metadata.csv").write_text('filename\nx\n')
    docs = landed.read_documents(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in docs] == [("EO_1_2001-02-03_A.txt", "line one\nline two")]
    df = spark.createDataFrame([("a.txt", "one\ntwo")], "filename string, text string")
    sinks.write_keyed_documents(df, str(tmp_path / "keyed"))
    assert [tuple(r) for r in landed.read_keyed_documents(spark, str(tmp_path / "keyed")).collect()] == [("a.txt", "one\ntwo")]


def test_one_file_per_document(spark, tmp_path):
    """Every text has a file of its own in one folder, written by tasks without a job's commit; older files are replaced."""
    path = str(tmp_path / "documents")
    texts = [f"text {i}\nof ö lines" for i in range(50)] + ["", None]
    for some in (["old"], texts):
        df = spark.createDataFrame([(t,) for t in some], "text string").repartition(3)
        sinks.write_document_files(df, path)
    names = [f.name for f in (tmp_path / "documents").iterdir()]
    assert len([n for n in names if n.endswith(".txt")]) == len(names) - 1 == 52  # and _SUCCESS: no checksum files, no work folder
    rows = landed.read_documents(spark, path)
    assert {r["filename"] for r in rows.collect()} == {n for n in names if n.endswith(".txt")}
    assert sorted(r["text"] for r in rows.collect()) == sorted((t or "") + "\n" for t in texts)


def test_the_driver_lists_no_document_files(spark, tmp_path):
    """Rows are those of Spark's own reader of whole files, without its list of files on the driver."""
    for name, text in (("a b.txt", b"one\n"), ("empty.txt", b""), ("50% [a]#1 'x'+{y}.txt", "zw\u00f6lf".encode()), ("odd.txt", b"\xff\x00x"), ("_hidden.txt", b"h"), (".dot.txt", b"d"), ("a.csv", b"c")):
        (tmp_path / name).write_bytes(text)
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner" / "deep.txt").write_bytes(b"deep")
    rows = landed.read_documents(spark, str(tmp_path))
    assert not rows.inputFiles()
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(str(tmp_path))
    plain = plain.selectExpr("_metadata.file_name AS filename", "CAST(content AS STRING) AS text")
    bare = [sorted((r[0], bytes(r[1])) for r in t.selectExpr("filename", "CAST(text AS BINARY)").collect()) for t in (rows, plain)]
    assert bare[0] == bare[1] and len(bare[0]) == 3
    some = landed.read_documents(spark, f"{tmp_path}/*.txt")  # a pattern is left to Spark
    assert sorted(r["filename"] for r in some.collect()) == [n for n, _ in bare[1]]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        landed.read_documents(spark, str(tmp_path / "absent"))


def test_csv_round_trip_keeps_quotes_and_breaks(spark, tmp_path):
    row = ("1", "P", "2020", 'He said "x", ok\nnew', "f", "u", "")
    df = spark.createDataFrame([row], landed.RAW_METADATA)
    assert sinks.write_csv(df, str(tmp_path / "m"))
    assert tuple(landed.read_raw_metadata(spark, str(tmp_path / "m")).head()) == row
    assert not sinks.write_csv(df.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_missing_store_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        landed.read_embeddings(spark, str(tmp_path / "absent"))


PAGES = [
    ("<html><body><nav>x</nav><article>A &amp; b<!-- no --><p>c<b>d</b></p></article><footer>f</footer></body></html>", "A & b c d"),
    ("<body><main>m<nav>n<nav>nn</nav></nav></main><article>a</article></body>", "m"),
    ("<body><div class='box content'>in<div>deep</div></div>out</body>", "in deep"),
    ("<body>plain &eacute;&#65; <script>var x = '<p>';</script></body>", "plain éA"),
    ("no container at all", None),
    ("<body><article>unclosed <p>text", "unclosed text"),
]


def test_page_walk(spark):
    rows = spark.createDataFrame([(str(i), h) for i, (h, _) in enumerate(PAGES)] + [("null", None)], "url string, html string")
    got = {r["url"]: r["text"] for r in ingest.page_texts(rows).collect()}
    assert [got[str(i)] for i in range(len(PAGES))] == [t for _, t in PAGES] and got["null"] is None


def test_page_columns_agree_on_flat_pages(spark):
    rows = spark.createDataFrame([(PAGES[0][0],)], "html string")
    assert rows.select(H.page_text_by_columns(F.col("html"))).head()[0] == PAGES[0][1]


def test_last_write_wins(spark):
    rows = spark.createDataFrame([("f", 1, "old"), ("f", 3, "new"), ("g", 2, "only"), ("f", 2, "mid")], "k string, at int, text string")
    assert sorted(map(tuple, latest_per_key(rows, "k", ["at"]).collect())) == [("f", 3, "new"), ("g", 2, "only")]


def test_hot_keys_are_split_and_rows_kept(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") < 1000, "hot").when(F.col("id") < 1100, None).otherwise(F.col("id").cast("string")).alias("k"))
    right = left.select("k").distinct().filter("k is not null").withColumn("v", F.length("k"))
    plain = sorted(map(tuple, left.join(right, "k", "left").select("id", "v").collect()))
    salted = lookup_join(left, right, "k", "id", hot_rows=100, salts=8)
    assert sorted(map(tuple, salted.select("id", "v").collect())) == plain
    inner = lookup_join(left, right, "k", "id", "inner", hot_rows=100, salts=8)
    assert inner.count() == left.join(right, "k").count()


def test_numbering_is_exact(spark):
    df = spark.range(2000).select("id", (F.col("id") % 7).alias("g"), F.hash("id").alias("h"))
    got = number_rows(df.repartition(6), [F.col("h"), F.col("id")]).orderBy("row_no").collect()
    want = sorted(df.collect(), key=lambda r: (r["h"], r["id"]))
    assert [r["id"] for r in got] == [r["id"] for r in want] and [r["row_no"] for r in got] == list(range(1, 2001))
    within = number_within(df, "g", [F.col("h"), F.col("id")]).collect()
    for g in range(7):
        rows = sorted((r for r in within if r["g"] == g), key=lambda r: r["row_no"])
        assert [r["row_no"] for r in rows] == list(range(1, len(rows) + 1))
        assert [(r["h"], r["id"]) for r in rows] == sorted((r["h"], r["id"]) for r in rows)


ERA_CASES = {"1992": "Unknown", "1993": "Clinton", "2001": "Clinton", "2002": "Bush", "2009": "Bush", "2017": "Obama",
             "2021": "Trump", "2025": "Biden", "2026": "Unknown", "Unknown": "Unknown", "20x4": "Unknown", "-201": "Unknown"}


def test_eras(spark):
    df = spark.createDataFrame([(y,) for y in ERA_CASES], "year string")
    by_rule = {r["year"]: r["president"] for r in meta.era_lookup(df, meta.era_table(spark)).collect()}
    by_case = {r["year"]: r["p"] for r in df.select("year", N.era_of(F.col("year")).alias("p")).collect()}
    assert by_rule == by_case == ERA_CASES


def test_keys_without_parts(spark):
    df = spark.createDataFrame([("EO_1.txt",), ("EO_2_19.txt",), ("notes.txt",)], "filename string")
    rows = {r["filename"]: tuple(r)[1:] for r in meta.metadata_frame(df).collect()}
    assert rows == {"EO_1.txt": ("1", "", "Unknown", "Unknown"), "EO_2_19.txt": ("2", "19", "Unknown", "Unknown"),
                    "notes.txt": ("notes", "", "Unknown", "Unknown")}
