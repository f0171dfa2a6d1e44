import tracemalloc
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.corpus import chunk_documents, chunk_id, chunk_records, upsert_vectors


def chunks_of(text, limit):
    """Plain restatement of the packing rule."""
    done, cur = [], ""
    for line in text.split("\n"):
        line = line.strip(" ")
        if not line:
            continue
        if len(cur) + len(line) > limit:
            done.append(cur)
            cur = line
        else:
            cur = f"{cur} {line}" if cur else line
    return done + [cur] if cur else done


def test_trim_takes_unicode_space(one):
    assert one(T.js_trim(F.lit("\uFEFF\u00A0 a \u3000b\u2028\n"))) == "a \u3000b"


def test_length_counts_utf16_units(one):
    assert one(T.utf16_length(F.lit("a\U0001f600"))) == 3


def test_strip_html(one):
    assert one(T.strip_html(F.lit("a<BR />b</p>c</DIV>d<i>e</i>"))) == "a\nb\nc\nde"
    assert one(T.strip_html(F.lit("keep<b lost\nrest"))) == "keep"
    assert one(T.strip_html(F.lit("a\n \u00A0\n\nb &amp; c"))) == "a\nb &amp; c"
    assert one(T.strip_html(F.lit(None).cast("string"))) == ""


def test_normalize_forms(one):
    rough = unicodedata.normalize("NFD", "Việt") + " \t\r\n\r\r\r x\x00\u00A0"
    assert one(T.normalize_contract_text(F.lit(rough))) == "Việt\n\nx"
    assert one(T.normalize_pdf_text(F.lit(rough))) == "Việt \t\n\n x"
    assert one(T.normalize_docx_text(F.lit(rough))) == "Việt \t\n\n\n\n x"
    assert one(T.normalize_contract_text(F.lit(None).cast("string"))) == ""


def test_chunk_limits(one):
    line = "x" * 400
    assert one(T.chunk_text(F.lit(f"{line}\n{line}"))) == [f"{line} {line}"]
    assert one(T.chunk_text(F.lit(f"{line}\n{line}y"))) == [line, f"{line}y"]
    assert one(T.chunk_text(F.lit("x" * 801))) == ["", "x" * 801]
    assert one(T.chunk_text(F.lit(" \n\n"))) == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=20, max_size=20))
def test_chunks_match_restatement(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.chunk_text(F.col("t"), 10).alias("c"))
    for row in df.collect():
        assert row.c == chunks_of(row.t, 10)
        assert " ".join(c for c in row.c if c).split() == row.t.split()


def test_ordinals_have_gaps(spark):
    text = "\n".join(["a" * 49, "b" * 800, "c" * 50 + "z" * 750])
    rows = chunk_documents(spark.createDataFrame([(1, text)], "id int, content string"), ["id"]).collect()
    assert [row.ordinal for row in rows] == [1, 2]
    exact = spark.createDataFrame([(1, "d" * 50), (2, "d" * 49)], "id int, content string")
    assert [row.id for row in chunk_documents(exact, ["id"]).collect()] == [1]


def test_record_defaults(spark, one):
    doc = ("", 7, None, "", "u", "<p>" + "x" * 60)
    schema = "id string, position int, title string, document_type string, source_url string, content string"
    row = chunk_records(spark.createDataFrame([doc], schema)).first()
    assert row.id == "doc_7_chunk_0"
    assert row.metadata.title == "Không có tiêu đề"
    assert row.metadata.document_type == "Văn bản"
    assert row.metadata.source_url == "u"
    assert row.metadata.text == "x" * 60
    assert one(chunk_id(F.lit("a"), F.lit(1), F.lit(2))) == "doc_a_chunk_2"


def test_upsert_last_wins(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    batch = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, load int")
    rows = upsert_vectors(base, batch, order=["load"]).collect()
    assert sorted(map(tuple, rows)) == [("a", 1), ("b", 4), ("c", 5)]


def test_dates(one):
    assert one(T.format_date_vi(F.lit("2025-03-04"))) == "4/3/2025"
    assert one(T.format_date_vi(F.lit("soon"))) == "soon"
    assert one(T.format_date_vi(F.lit(None).cast("string"))) == ""


def test_a_batch_is_composed_in_small_parts():
    text = "e\u0301" * 20_000
    texts = pa.array([text, None, "", "plain"] * 100)
    tracemalloc.start()
    out = T.nfc.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == ["\u00e9" * 20_000, None, "", "plain"] * 100
    assert peak < 8 << 20
    assert T.nfc.func(pa.array([], pa.string())).to_pylist() == []
