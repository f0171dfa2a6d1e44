import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import data_urls as D
from lexmill.functions import json_meta as J
from lexmill.functions import labels as L


def merged(one, text, patch):
    return json.loads(one(J.merge_json_meta(F.lit(text), J.patch_from_json(F.lit(patch)))))


def test_merge(one):
    assert merged(one, '{"a":1,"meta":{"x":1,"y":2}}', '{"y":null,"z":{"q":[1]}}') == {
        "a": 1,
        "meta": {"x": 1, "y": None, "z": {"q": [1]}},
    }
    assert merged(one, "broken", '{"t":"x"}') == {"meta": {"t": "x"}}
    assert merged(one, '{"meta":"text"}', "{}") == {"meta": {}}
    assert merged(one, "", None) == {"meta": {}}


def test_merge_loses_nothing(one, spark):
    assert merged(one, '{"summary":"keep","a":1,"a":2}', '{"title":"t"}') == {"summary": "keep", "a": 2, "meta": {"title": "t"}}
    size = 25_000_000
    stored = F.concat(F.lit('{"summary":"keep","meta":{"originalFileDataUrl":"'), F.repeat(F.lit("x"), F.lit(size)), F.lit('"}}'))
    text = one(J.merge_json_meta(stored, J.patch_from_json(F.lit('{"title":"t"}'))))
    kept = json.loads(text)
    assert kept["summary"] == "keep" and kept["meta"]["title"] == "t" and len(kept["meta"]["originalFileDataUrl"]) == size


def test_merge_under_any_key_policy(spark, one):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    assert merged(one, '{"meta":{"a":1}}', '{"a":2}') == {"meta": {"a": 2}}


def test_parse(one):
    valid = ('{"a":1}', "[1]", " 1 ", "null", '"s"', '{"a":1,"a":2}')
    invalid = ("", " ", None, "{", "1,2", "1 x", '{"a":1}]', '{"a":1}] x', "{'a':1}", '{"a":NaN}', '1,"\\u0001end\\u0001"')
    for text, ok in [*((t, True) for t in valid), *((t, False) for t in invalid)]:
        assert one(J.is_valid_json(F.lit(text).cast("string"))) is ok


def test_model_answer(one):
    assert one(J.clean_model_json(F.lit('Yes ```json\n{"a":{"b":1}}\n``` so'))) == '{"a":{"b":1}}'
    failed = json.loads(one(J.clean_model_json(F.lit("no braces"))))
    assert failed["risk_score"] == 0 and failed["risks"][0]["severity"] == "High"


def test_meta_view(one):
    view = one(J.meta_view(F.lit('{"meta":{"title":"","category":"c"}}'), F.lit("f")))
    assert tuple(view) == ("", "c", "")
    assert tuple(one(J.meta_view(F.lit("bad"), F.lit("f")))) == ("f", "", "")


@pytest.mark.parametrize(
    "url, mime",
    [
        ("data:image/png;base64,aGk=", "image/png"),
        ("data:IMAGE/PNG;base64,aGk", "image/png"),
        ("data:image/jpg;base64,aG k=", "image/jpg"),
        ("data:image/jpeg;base64,aGk=\n", None),
        ("data:application/pdf;base64,aGk=", None),
        ("data:image/png;base64,", None),
        ("hello", None),
        (None, None),
    ],
)
def test_image_url(one, url, mime):
    parsed = one(D.parse_image_data_url(F.lit(url).cast("string")))
    assert (parsed and parsed.mime) == mime
    if parsed:
        assert bytes(parsed.bytes) == b"hi"


def test_other_urls(one):
    pdf = one(D.parse_base64_data_url(F.lit("data:Application/PDF;base64,-_8")))
    assert (pdf.mime, bytes(pdf.bytes)) == ("application/pdf", b"\xfb\xff")
    assert one(D.parse_png_data_url(F.lit("data:image/jpeg;base64,aGk="))) is None
    assert one(D.signature_mime(F.lit("data:image/JPG;base64,aGk="))) == "image/jpeg"


def placement(page=0, x=0.5, w=0.501):
    box = {"x": 0, "y": 0, "w": 1, "h": 1}
    return {"pageIndex": page, "a": {"x": x, "y": 0, "w": w, "h": 1}, "b": box}


@pytest.mark.parametrize(
    "value, ok",
    [
        (placement(), True),
        (placement(w=0.502), False),
        (placement(w=0), False),
        (placement(page=-1), False),
        (placement(page="0"), False),
        (placement(x="0.5"), False),
        ({"pageIndex": 0, "a": {"x": 0, "y": 0, "w": 1, "h": 1}}, False),
        (None, False),
        (5, False),
    ],
)
def test_placement(one, value, ok):
    assert one(D.valid_placement_json(F.parse_json(F.lit(json.dumps(value))))) is ok


def test_placement_not_a_number(one):
    nan = F.lit(float("nan"))
    box = F.struct(*[F.lit(0.5).alias(n) for n in "xywh"])
    bad = F.struct(nan.alias("x"), *[F.lit(0.5).alias(n) for n in "ywh"])
    assert one(D.valid_placement(F.struct(F.lit(0.0).alias("pageIndex"), box.alias("a"), box.alias("b")))) is True
    assert one(D.valid_placement(F.struct(F.lit(0.0).alias("pageIndex"), bad.alias("a"), box.alias("b")))) is False


@pytest.mark.parametrize(
    "value, images, names",
    [
        (["data:image/png;base64,AA"], True, True),
        ([], False, True),
        (["a"] * 31, False, False),
        (["a" * 261], False, False),
        (["a", 1], False, False),
        (["a", None], False, False),
        ("a", False, False),
    ],
)
def test_pages(one, value, images, names):
    variant = F.parse_json(F.lit(json.dumps(value)))
    assert one(D.valid_page_images(variant)) is images
    assert one(D.valid_page_names(variant)) is names


def test_labels(one):
    none = F.lit(None).cast("string")
    assert [one(L.severity_badge(F.lit(s).cast("string"))) for s in (None, "HIGH", "Low")] == [
        "CẢNH BÁO",
        "NGHIÊM TRỌNG",
        "LƯU Ý",
    ]
    assert one(L.severity_style(none)) == "other" and one(L.severity_label(none)) == "Lưu ý"
    assert [one(L.safety_badge(F.lit(n).cast("int"))) for n in (79, 80, None)] == ["RỦI RO", "AN TOÀN", "RỦI RO"]
    assert one(L.effective_risk_score(F.lit(None).cast("int"), F.lit(3))) == 3
    assert one(L.display_name(F.lit(True), F.lit(2), F.lit("x"))) == "Ảnh hợp đồng (2 trang)"


def test_file_names(one):
    assert [one(L.path_extension(F.lit(n))) for n in ("a.PDF", ".doc", "a", "x.y/z", "a.")] == [".pdf", "", "", "", "."]
    assert [one(L.file_extension(F.lit(n))) for n in ("a.PDF", "A", "a.b.c")] == ["pdf", "a", "c"]


def test_file_kind(one):
    flags = L.detect_file_kind(F.lit("application/pdf"), F.lit(None).cast("string"), F.lit("X.DOCX"))
    assert one(L.file_kind(flags, L.EXTRACTION_ORDER)) == "docx"
    assert one(L.file_kind(flags, L.EXPORT_ORDER)) == "pdf"
    assert one(L.upload_kind(F.lit("image/png"), F.lit("a.txt"))) == "image"
    assert one(L.upload_kind(F.lit("x/y"), F.lit("a.TXT"))) == "txt"
    assert one(L.upload_kind(F.lit(""), F.lit("a.rtf"))) is None
