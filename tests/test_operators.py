import io
import json
import zipfile
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmill.operators import extraction, indexing, joins, quality, risk, search, stats
from lexmill.operators.pdf_lines import reassemble_pdf_lines
from lexmill.sources import readers, writers
from lexmill.streaming.ingest import current_index, stream_ingest
from lexmill.streaming.rate_limit import limiter_key, rate_limit_violations


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "contract_id int, text string")


# --- risk ---------------------------------------------------------------------------


def test_default_rules(spark):
    df = texts(
        spark,
        "không có gì",
        "mức PHẠT 8%",
        "phạt và đơn phương chấm dứt",
        "Đặt cọc, thanh toán, phạt, ĐƠN PHƯƠNG CHẤM DỨT",
        None,
    )
    rows = {r.contract_id: r for r in risk.risk_report(df).collect()}
    assert [rows[i].risk_score for i in range(5)] == [82, 70, 58, 46, 82]
    assert [r.severity for r in rows[0].risks] == ["Low"] and rows[0].n_risks == 0
    assert [r.severity for r in rows[3].risks] == ["Medium", "High", "Medium"]
    assert risk.match_risk_rules(df).count() == 6


def test_score_floor(spark):
    rules = [risk.RiskRule(i, ("a",), "c", "i", "Low") for i in range(5)]
    assert risk.risk_report(texts(spark, "a"), rules).first().risk_score == 45


def test_items_and_split(spark):
    schema = "id int, risk_score int, risks array<struct<clause:string,issue:string,severity:string>>"
    df = spark.createDataFrame([(1, 79, [("c", "i", None), ("d", "j", "High")]), (2, None, None)], schema)
    assert {(r.id, r.n_risks) for r in risk.risk_counts(df).collect()} == {(1, 2), (2, 0)}
    items = risk.risk_items(df, ["id"]).collect()
    assert {(r.id, r.item, r.clause) for r in items} == {(1, 1, "c"), (1, 2, "d"), (2, None, None)}
    assert {(r.id, r.name, r.value) for r in risk.risk_split(df, ["id"]).collect()} == {
        (1, "An toàn", 79), (1, "Rủi ro", 21), (2, "An toàn", 0), (2, "Rủi ro", 100)
    }


def test_model_answers_and_failures(spark):
    def model(batch):
        return ['x {"summary":"s","risk_score":9,"risks":[],"recommendation":"r"} y' if "ok" in t else "no" for t in batch]

    def broken(batch):
        raise RuntimeError("down")

    df = texts(spark, "ok then", "phạt nặng lắm").withColumn("image", F.lit(True))
    scores = {r.contract_id: r.risk_score for r in extraction.analyze_contracts(df, model).collect()}
    assert scores == {0: 9, 1: 70}
    scores = {r.contract_id: r.risk_score for r in extraction.analyze_contracts(df, broken, is_image="image").collect()}
    assert scores == {0: 50, 1: 70}


def test_one_bad_text_does_not_spoil_its_neighbours(spark):
    def model(batch):
        if any("bad" in t for t in batch):
            raise RuntimeError("refused")
        return ['{"summary":"s","risk_score":9,"risks":[],"recommendation":"r"}' for _ in batch]

    df = texts(spark, "fine one", "bad one", "fine two").coalesce(1)
    scores = {r.contract_id: r.risk_score for r in extraction.analyze_contracts(df, model).collect()}
    assert scores[0] == scores[2] == 9 and scores[1] == 82


def test_a_text_is_embedded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(batch):
        calls.add(len(batch))
        return [[1.0, 2.0] if "ok" in t else [1.0] for t in batch]

    df = spark.createDataFrame([(i, "ok" if i % 2 else "no") for i in range(20)], "id int, text string")
    out = extraction.embed_chunks(df, embed, dim=2)
    assert sorted(r.id for r in out.where(F.size("values") == 2).collect()) == list(range(1, 20, 2))
    assert calls.value == 20


# --- search -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "Luật 100% mới", "Luật", date(2020, 1, 1), None),
        (2, "bộ LUẬT", "Bộ luật", date(2021, 1, 1), "về luật"),
        (3, "Nghị_định", "Khác", None, "LUẬT"),
        (4, None, "Luật", date(2021, 1, 1), None),
    ]
    return spark.createDataFrame(rows, "Id int, Title string, DocumentType string, IssueDate date, Description string")


def found(df):
    return [r.Id for r in df.collect()]


def test_search(docs):
    assert found(search.search_documents(docs, "  ")) == [4, 2, 1, 3]
    assert found(search.search_documents(docs, " Luật ")) == [4, 1]
    assert found(search.search_documents(docs, "luật", ignore_case=True)) == [4, 2, 1]
    assert found(search.search_documents(docs, "0%")) == [1]
    assert found(search.search_documents(docs, "N%_đ[i-ị]nh", mode="like")) == [3]
    assert found(search.search_documents(docs, "(", mode="like")) == []
    assert sorted(found(search.search_documents_any(docs, "LUẬT"))) == [1, 2, 3, 4]
    assert sorted(found(search.search_documents_any(docs, ""))) == [1, 2, 3, 4]


def test_literal_search_is_pushed_down(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    plan = search.search_documents(stored, "Luật")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(Title,Luật)" in plan


def test_filters(spark, docs):
    assert found(search.filter_documents(docs, "Luật", date(2020, 1, 1), date(2020, 1, 1))) == [1]
    assert sorted(found(search.filter_documents(docs))) == [1, 2, 3, 4]
    assert found(search.document_detail(docs, 3)) == [3]
    assert found(search.document_detail(docs, spark.createDataFrame([(2,), (8,)], "Id int"))) == [2]
    assert found(search.filter_by_name(docs, "LUẬT", "DocumentType").orderBy("Id")) == [1, 2, 4]
    assert stats.result_count(docs).first().n == 4


def test_request_question(spark):
    schema = "query string, message string, question string, messages array<struct<role:string,content:string>>"
    rows = [("", "m", "q", None), (None, None, "q", None), (None, "", None, [("u", "a"), ("u", "b")]), ("", "", "", [])]
    df = spark.createDataFrame(rows, schema)
    col = search.request_question([F.col(c) for c in ("query", "message", "question")], F.col("messages"))
    assert [r.v for r in df.select(col.alias("v")).collect()] == ["m", "q", "b", None]


# --- checks -------------------------------------------------------------------------


def test_validate_upload(spark):
    rows = [(1, "a.PDF", "application/pdf")] + [(2, "p.png", "image/png")] * 31
    rows += [(3, "p.png", "image/png"), (3, "a.pdf", "application/pdf"), (4, "noext", None), (5, "a.gif", "image/gif")]
    errors = {r.upload_id: r.error for r in quality.validate_upload(spark.createDataFrame(rows, "upload_id int, name string, mime string")).collect()}
    uploads = spark.createDataFrame([(1, "a", "application/pdf"), (2, "a.gif", "image/gif"), (3, "a.rtf", None)], "upload_id int, name string, mime string")
    served = {r.upload_id: r.error for r in quality.validate_upload(uploads, side="server").collect()}
    assert served == {1: None, 2: None, 3: quality.EXTENSION}
    assert errors == {1: None, 2: quality.TOO_MANY, 3: quality.MIXED, 4: quality.EXTENSION, 5: quality.EXTENSION}


def test_register(spark):
    existing = spark.createDataFrame([("old@x.vn",)], "email string")
    rows = [
        (1, "a", "new@x.vn", "123456"), (2, "b", "new@x.vn", "123456"), (3, "c", "old@x.vn", "123456"),
        (4, "", "n@x.vn", "123456"), (5, "d", "bad", "123456"), (6, "e", "e@x.vn", "12345"), (7, "f", None, None),
    ]
    asked = spark.createDataFrame(rows, "id int, name string, email string, password string")
    accepted, rejected = quality.validate_register(existing, asked, ["id"])
    assert [r.id for r in accepted.collect()] == [1] and "password" not in accepted.columns
    assert {(r.id, r.error) for r in rejected.collect()} == {
        (2, "taken"), (3, "taken"), (4, "name"), (5, "email"), (6, "password"), (7, "email")
    }


def test_short_texts_and_analysis(spark):
    df = texts(spark, " 123456789 ", "1234567890", None)
    usable, short = extraction.readable_contracts(df)
    assert [r.contract_id for r in usable.collect()] == [1] and sorted(r.contract_id for r in short.collect()) == [0, 2]
    nested = df.select(F.struct("contract_id", F.col("text").alias("contract_text")).alias("analysis"))
    assert quality.drop_analysis_text(nested).schema["analysis"].dataType.names == ["contract_id"]


def test_joins(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    patch = spark.createDataFrame([(2, "z", None), (3, "y", 1)], "k int, v string, n int")
    updated, unmatched = joins.update_by_key(base, patch, "k")
    assert sorted(map(tuple, updated.collect())) == [(1, "a", 1), (2, "z", 2)]
    assert [r.k for r in unmatched.collect()] == [3]
    users = spark.createDataFrame([(2, "e", "p"), (1, "e", "q"), (3, "f", "r")], "Id int, Email string, Password string")
    asked = spark.createDataFrame([("e",), ("e",), ("g",)], "Email string")
    row = joins.users_by_email(users, asked).collect()
    assert [(r.Id, r.Email) for r in row] == [(1, "e")] and "Password" not in row[0].asDict()


def test_numbering(spark):
    # One value holds a third of the rows; the second key splits it.
    rows = [(0 if i % 3 == 0 else i, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    numbered = indexing.with_row_index(df, ["a", "b"]).collect()
    expected = {row: place for place, row in enumerate(sorted(rows))}
    assert all(expected[(r.a, r.b)] == r.row_index for r in numbered) and len(numbered) == 1000
    assert {r.batch for r in indexing.assign_batches(df, ["a", "b"], 300).collect()} == {0, 1, 2, 3}
    assert sorted(r.Id for r in indexing.assign_ids(df, 5, ["b"]).collect()) == list(range(5, 1005))


def test_titles(spark):
    df = spark.createDataFrame([("b", 1), ("", 2), ("a", 3), ("b", 4), (None, 5)], "title string, position int")
    assert sorted(map(tuple, stats.distinct_titles(df).collect())) == [(1, "b"), (2, "a")]
    assert tuple(stats.corpus_stats(df).first()) == (5, 2)


# --- files --------------------------------------------------------------------------


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("word/document.xml", xml)
    return held.getvalue()


def docx_of(body):
    spaces = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {spaces}><w:body>{body}</w:body></w:document>")
    return held.getvalue()


def test_docx_reads_runs_only_and_once():
    run = "<w:r><w:t>{}</w:t></w:r>".format
    stops = '<w:pPr><w:tabs><w:tab w:val="left"/><w:tab w:val="right"/></w:tabs></w:pPr>'
    assert extraction.docx_text(docx_of(f"<w:p>{stops}{run('A')}<w:r><w:tab/></w:r>{run('B')}</w:p>")) == "A\tB\n\n"
    box = f"<w:txbxContent><w:p>{run('BOX')}</w:p></w:txbxContent>"
    choice = f"<mc:AlternateContent><mc:Choice>{box}</mc:Choice><mc:Fallback>{box}</mc:Fallback></mc:AlternateContent>"
    assert extraction.docx_text(docx_of(f"<w:p>{run('1')}<w:r>{choice}</w:r>{run('2')}</w:p><w:p>{run('3')}</w:p>")) == "12\n\nBOX\n\n3\n\n"


def test_blank_pages_and_rows_without_a_key_stay(spark):
    items = spark.createDataFrame([(1, 0, " ", 0.0, 0.0, 1.0, 0), (1, 1, "a", 0.0, 0.0, 1.0, 0)], "doc_id int, page int, str string, x double, y double, w double, item int")
    assert {r.page: r.text for r in reassemble_pdf_lines(items).collect()} == {0: "\n", 1: "a\n"}
    old = spark.createDataFrame([(1, "a")], "Id int, Email string")
    new = spark.createDataFrame([(2, None), (3, "b"), (4, "a")], "Id int, Email string")
    inserted, conflicts = joins.insert_unique(old, new, "Email", ["Id"])
    assert {r.Id for r in inserted.collect()} == {3} and {r.Id for r in conflicts.collect()} == {2, 4}


def test_positions_go_on_over_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.json").write_text('{"legaldocuments":[{"content":"x"},{"content":"y"}]}')
    assert sorted(r.position for r in readers.read_legal_corpus(spark, str(tmp_path / "*.json")).collect()) == [0, 1, 2, 3]


def test_contract_files(spark, tmp_path):
    files = {
        "a.docx": docx("Điều 1", "Điều 2"),
        "fake.docx": rb"{\rtf1 text}",
        "empty.docx": b"PK broken",
        "b.TXT": "dòng\r\nhai\x00 ".encode(),
        "c.pdf": b"%PDF",
        "d": b"?",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    read = readers.read_contract_files(spark, str(tmp_path))
    assert {r.name: r.ext for r in read.select("name", "ext").collect()}["b.TXT"] == ".txt"
    rows = {r.name: r for r in extraction.extract_contract_text(read, "name").collect()}
    assert rows["a.docx"].text == "Điều 1\n\nĐiều 2" and rows["a.docx"].error is None
    assert rows["fake.docx"].text is None and rows["fake.docx"].error == "not a DOCX file"
    assert rows["empty.docx"].error.startswith("unreadable")
    assert rows["b.TXT"].text == "dòng\nhai"
    assert rows["c.pdf"].error == "no reader for pdf" and rows["d"].error == "no reader for None"


def test_corpus_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"legaldocuments": [{"id": "x", "title": "t"}, {"content": "c"}]}))
    (tmp_path / "b.json").write_text("{}")
    rows = readers.read_legal_corpus(spark, str(tmp_path / "*.json")).collect()
    assert sorted((r.position, r.id, r.content) for r in rows) == [(0, "x", None), (1, None, "c")]
    (tmp_path / "c.json").write_text("{broken")
    told = {r.path[-6:]: (r.is_valid, r.n_documents) for r in readers.corpus_validity(spark, str(tmp_path)).collect()}
    assert told == {"a.json": (True, 2), "b.json": (True, None), "c.json": (False, None)}


def test_vector_index(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"vectors": {"3": [1.5, 2], "1": [0, 1]}}')
    (tmp_path / "none.json").write_text("{}")
    index = readers.read_vector_index(spark, str(tmp_path / "i.json"))
    assert sorted((r.vec_id, r.embedding) for r in index.collect()) == [(1, [0.0, 1.0]), (3, [1.5, 2.0])]
    assert readers.read_vector_index(spark, str(tmp_path / "none.json"), index).count() == 2
    writers.write_vector_index(index, str(tmp_path / "p"))
    assert readers.read_vector_index(spark, str(tmp_path / "p")).count() == 2


def test_manifest_and_sample(spark):
    schema = "user_id int, title string, path string, name string"
    df = spark.createDataFrame([(1, "t", "p/1", "a.DOC"), (2, "", "p/2", "b.pdf"), (3, "u", "p/3", "c.json")], schema)
    contracts = readers.upload_manifest(df, "contract").collect()
    assert {(r.user_id, r.status) for r in contracts} == {(1, "pending"), (2, "pending")}
    assert [(r.title, r.type) for r in readers.upload_manifest(df, "law").collect()] == [("u", "json")]
    sample = readers.with_static_fallback(spark, None)
    assert sample.count() == 2 and sample.schema["IssueDate"].dataType.typeName() == "date"
    assert readers.with_static_fallback(spark, df) is df


def test_table_columns(spark):
    spark.range(1).selectExpr("id", "'x' as name").createOrReplaceTempView("cols_of")
    rows = joins.table_columns(spark, "cols_of").collect()
    assert [(r.name, r.data_type) for r in rows] == [("id", "bigint"), ("name", "string")]


def test_writers(spark, tmp_path):
    history = spark.createDataFrame([(1, "{}", "n", "text", None, datetime(2024, 1, 2))],
                                    "Id bigint, AnalysisJson string, FileName string, ContractText string, AnalysisText string, CreatedAt timestamp")
    writers.write_contract_text(history, str(tmp_path / "t"))
    assert "text" in spark.read.parquet(str(tmp_path / "t")).first().lines
    out = tmp_path / "sent"
    out.mkdir()
    folder = str(out)

    def send(rows):
        with open(f"{folder}/{rows[0].id}", "w") as file:
            file.write(str(len(rows)))

    writers.send_batches(spark.range(0, 107, numPartitions=2), send, 50)
    assert sorted(int(p.read_text()) for p in out.iterdir()) == [3, 4, 50, 50]


# --- PDF lines, embedding and streams --------------------------------------------------


def test_pdf_lines(spark):
    rows = [
        (1, 1, "third", 0.0, 97.0, 5.0), (1, 1, "one", 0.0, 100.0, 5.0), (1, 1, "two", 20.0, 98.5, 5.0),
        (1, 1, "a", 0.0, 50.0, 10.0), (1, 1, "b", 11.5, 50.0, 10.0), (1, 1, "c", 23.1, 48.0, 10.0),
        (1, 1, "  ", 60.0, 50.0, 1.0), (1, 1, "x\t\u00A0y \u00A0", 0.0, 20.0, 1.0), (1, 2, "alone", 0.0, 1.0, 1.0),
        (1, 3, "  ", 0.0, 1.0, 1.0),
    ]
    items = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id int, page int, str string, x double, y double, w double, item int")
    pages = {r.page: r.text for r in reassemble_pdf_lines(items.repartition(3)).collect()}
    assert pages == {1: "one two\nthird\nab c\nx  y\n", 2: "alone\n", 3: "\n"}


def test_pieces_of_a_page_move_as_lists_and_unsorted(spark):
    """Runs of a page's pieces are one row each; nothing is grouped, and so sorted, before the shuffle."""
    rows = [(None, 0, "a", 0.0, 9.0, 5.0), (None, 0, "b", 5.5, 9.0, 5.0), (1, None, "c", 0.0, 9.0, None), (1, None, None, 1.0, 9.0, 1.0)]
    rows += [(None, 0, "d", None, 9.0, 1.0), (2, 0, "e", 0.0, None, 1.0), (2, 1, "f", 0.0, 1.0, 1.0), (2, 0, "g", 0.0, 8.0, 1.0)]
    items = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id int, page int, str string, x double, y double, w double, item int")
    got = reassemble_pdf_lines(items.coalesce(1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]
    assert {(r.doc_id, r.page): r.text for r in got.collect()} == {
        (None, 0): "ab\n", (1, None): "c\n", (2, 0): "eg\n", (2, 1): "f\n"
    }


def test_embed(spark):
    df = texts(spark, "abc", "de")
    rows = extraction.embed_chunks(df, lambda batch: [[float(len(t))] * (2 if t == "abc" else 3) for t in batch], dim=2)
    assert [(r.contract_id, r["values"]) for r in rows.collect()] == [(0, [3.0, 3.0])]
    assert all(len(r["values"]) == 8 for r in extraction.embed_chunks(df, dim=8).collect())


def test_rate_limit(spark):
    start = datetime(2024, 1, 1, 10)
    rows = [(start + timedelta(seconds=i / 2), 5, "ip") for i in range(61)]
    rows += [(start + timedelta(seconds=i / 2), 6, "ip") for i in range(60)]
    rows += [(start + timedelta(seconds=i / 2), 0, "ip9") for i in range(70)]
    df = spark.createDataFrame(rows, "ts timestamp, user_id int, ip string")
    assert {(r.key, r.n) for r in rate_limit_violations(df).collect()} == {("5", 61), ("ip9", 70)}
    keys = spark.createDataFrame([("", "a"), (None, "b"), ("u", "c")], "u string, ip string")
    assert [r.k for r in keys.select(limiter_key(F.col("u"), F.col("ip")).alias("k")).collect()] == ["a", "b", "u"]


def test_ingest_again_replaces(spark, tmp_path):
    schema = "id string, position int, title string, document_type string, source_url string, content string"
    source = str(tmp_path / "in")
    for n in range(2):
        spark.createDataFrame([("d", 0, f"t{n}", "", "", "<p>" + "x" * 60)], schema).coalesce(1).write.mode("append").json(source)
        docs = spark.readStream.schema(schema).json(source)
        stream_ingest(docs, str(tmp_path / "out"), str(tmp_path / "cp"), dim=8).awaitTermination()
    rows = current_index(spark, str(tmp_path / "out")).collect()
    assert [(r.id, r.metadata.title, len(r["values"])) for r in rows] == [("doc_d_chunk_0", "t1", 8)]
