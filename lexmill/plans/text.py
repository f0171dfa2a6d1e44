"""Clean-up, chunking and the scalar functions on text, JSON and files."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import fixed_values as V
from lexmill.functions import data_urls as urls
from lexmill.functions import json_meta as meta
from lexmill.functions import labels
from lexmill.functions import text as fn
from lexmill.operators import corpus as op
from lexmill.operators.extraction import DOCX_BODY, W, extract_contract_text
from lexmill.operators.pdf_lines import reassemble_pdf_lines
from lexmill.operators.search import last_question as last_question_of
from lexmill.operators.stats import json_validity
from lexmill.plans.common import TRIM_SQL, documents, spread, sql_chunks, sql_text, sql_trim, table

SPACES = V.SPACE_CLASS


def sql_strip_html(expr: str) -> str:
    lines = f"regexp_replace({expr}, '(?i)<br{SPACES}*/?>|</p>|</div>', chr(10), 'g')"
    bare = f"regexp_replace({lines}, '<[^>]*>?', '', 'g')"
    return sql_trim(f"regexp_replace({bare}, '\\n{SPACES}*\\n', chr(10), 'g')")


def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", fn.strip_html(F.col("html")).alias("text"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = op.chunk_documents(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"], content="text", html=False)
    return chunks.withColumn("id", op.chunk_id(F.col("doc_id"), F.col("doc_id"), F.col("ordinal")))


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as corpus documents: no title, the address as link."""
    return spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        F.col("page_id").cast("string").alias("id"),
        F.col("page_id").alias("position"),
        F.lit("").alias("title"),
        F.lit(None).cast("string").alias("document_type"),
        F.col("url").alias("source_url"),
        F.col("html").alias("content"),
    )


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.chunk_records(page_documents(spark, sf_dir)).select(
        "id", "metadata.title", "metadata.document_type", "metadata.source_url", "metadata.text"
    )


_PAGES = f"(SELECT page_id, url, {sql_strip_html('html')} AS body FROM pages)"
CHUNK_PAGES_SQL = f"""
    SELECT 'doc_' || page_id || '_chunk_' || ordinal AS id, {sql_text(V.CHUNK_DEFAULTS['title'])} AS title,
      {sql_text(V.CHUNK_DEFAULTS['document_type'])} AS document_type, url AS source_url, text
    FROM ({sql_chunks(_PAGES, 'page_id, url', 'body')})"""


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three clean-ups, on documents whose line ends were roughened."""
    rough = F.concat(F.lit("\u00A0\n"), F.replace("text", F.lit("\n"), F.lit(" \t\r\n  \r\n\r\r")), F.lit("\n"))
    docs = documents(spark, sf_dir, "doc_id", "text").select("doc_id", rough.alias("text"))
    return docs.select(
        "doc_id",
        fn.normalize_contract_text(F.col("text")).alias("contract"),
        fn.normalize_pdf_text(F.col("text")).alias("pdf"),
        fn.normalize_docx_text(F.col("text")).alias("docx"),
    )


_ROUGH = (
    "(chr(160) || chr(10) || replace(text, chr(10), ' ' || chr(9) || chr(13) || chr(10) || '  ' || chr(13) || chr(10)"
    " || chr(13) || chr(13)) || chr(10))"
)
NORMALIZE_SQL = f"""
    WITH unix AS (
      SELECT doc_id, replace(replace(nfc_normalize({_ROUGH}), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t
      FROM documents)
    SELECT doc_id,
      {sql_trim(r"regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS contract,
      {sql_trim(r"regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')")} AS pdf,
      {sql_trim('t')} AS docx
    FROM unix"""


def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded text files, a fourth of them named as DOCX."""
    name = F.concat(F.lit("doc_"), "doc_id", F.when(F.col("lang") == "fr", ".DOCX").otherwise(".txt"))
    files = documents(spark, sf_dir, "doc_id", "lang", "text").select(
        name.alias("path"),
        labels.upload_kind(F.lit(""), name).alias("kind"),
        F.encode("text", "utf-8").alias("content"),
    )
    return extract_contract_text(files)


EXTRACT_SQL = f"""
    SELECT 'doc_' || doc_id || CASE WHEN lang = 'fr' THEN '.DOCX' ELSE '.txt' END AS path,
      CASE WHEN lang = 'fr' THEN 'docx' ELSE 'txt' END AS kind,
      CASE WHEN lang <> 'fr' THEN {sql_trim("nfc_normalize(text)")} END AS text,
      CASE WHEN lang = 'fr' THEN 'not a DOCX file' END AS error
    FROM documents"""


def _docx_of(text: str) -> bytes:
    """A DOCX file with a paragraph per line, each with a tab stop and two runs."""
    stop = '<w:pPr><w:tabs><w:tab w:val="left" w:pos="720"/></w:tabs></w:pPr>'
    run = "<w:r><w:t>{}</w:t></w:r>".format
    body = "".join(f"<w:p>{stop}{run(escape(line[:5]))}{run(escape(line[5:]))}</w:p>" for line in text.split("\n"))
    space = W[1:-1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr(DOCX_BODY, f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return held.getvalue()


def docx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as DOCX files and read back."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                content = _docx_of(row.column("text")[0].as_py() or "")
                yield pa.record_batch([row.column("doc_id"), pa.array(["docx"]), pa.array([content])], names=["doc_id", "kind", "content"])

    docs = documents(spark, sf_dir, "doc_id", "text")
    files = docs.mapInArrow(write, "doc_id bigint, kind string, content binary")
    return extract_contract_text(files, "doc_id").select("doc_id", "text", "error")


DOCX_SQL = f"""
    SELECT doc_id, {sql_trim("nfc_normalize(replace(text, chr(10), chr(10) || chr(10)))")} AS text, CAST(NULL AS VARCHAR) AS error
    FROM documents"""


def line_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set out as pages of 40 lines, a piece per word, and read back."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    words = lines.select("doc_id", "n", F.posexplode(F.split("line", " ")).alias("item", "str"))
    items = words.select(
        "doc_id",
        F.floor(F.col("n") / 40).alias("page"),
        "item",
        "str",
        (F.col("item") * 100.0).alias("x"),
        (800.0 - (F.col("n") % 40) * 12.0).alias("y"),
        F.lit(90.0).alias("w"),
    )
    return reassemble_pdf_lines(items)


LINES_SQL = f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
    w AS (SELECT doc_id, n, unnest(string_split(line, ' ')) AS word, unnest(range(len(string_split(line, ' ')))) AS i FROM l),
    tidy AS (
      SELECT doc_id, n,
        coalesce(rtrim(replace(regexp_replace(string_agg(word, ' ' ORDER BY i) FILTER ({sql_trim('word')} <> ''),
          '[ \\t]+', ' ', 'g'), chr(160), ' '), {TRIM_SQL}), '') AS line
      FROM w GROUP BY doc_id, n)
    SELECT doc_id, n // 40 AS page,
      coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE line <> ''), '') || chr(10) AS text
    FROM tidy GROUP BY 1, 2"""


def json_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole, cut, empty and list-bearing copies of each JSON text, one that repeats its keys, and one that goes on."""
    half = F.expr("substring(props, 1, length(props) - 1)")
    listed = F.concat(F.lit('{"legaldocuments":['), "props", F.lit(","), "props", F.lit("]}"))
    twice = F.concat(half, F.lit(","), F.expr("substring(props, 2)"))
    longer = F.concat("props", F.lit("]"))
    copies = F.array("props", half, F.lit(""), listed, twice, longer)
    texts = table(spark, sf_dir, "events").select("event_id", F.posexplode(copies).alias("copy", "text"))
    told = json_validity(texts, "text")
    return told.select(
        "event_id", "copy", F.col("is_valid").cast("int").alias("valid"), F.coalesce("n_documents", F.lit(-1)).alias("n")
    )


JSON_VALID_SQL = """
    SELECT event_id, copy::INTEGER AS copy, (text <> '' AND json_valid(text))::INTEGER AS valid,
      CASE WHEN copy = 3 THEN 2 ELSE -1 END AS n
    FROM (SELECT event_id, unnest(range(6)) AS copy, unnest([props, substr(props, 1, length(props) - 1), '',
      '{"legaldocuments":[' || props || ',' || props || ']}',
      substr(props, 1, length(props) - 1) || ',' || substr(props, 2), props || ']']) AS text FROM events)"""


def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers in a code fence; answers to views are cut short."""
    body = F.when(F.col("event_type") == "view", F.expr("substring(props, 1, length(props) - 2)")).otherwise(F.col("props"))
    answer = F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone."))
    return table(spark, sf_dir, "events").select("event_id", meta.clean_model_json(answer).alias("answer"))


_FAILURE = json.dumps(
    {
        "summary": V.MODEL_FAILURE["summary"],
        "risk_score": V.MODEL_FAILURE["risk_score"],
        "risks": [dict(zip(("clause", "issue", "severity"), V.MODEL_FAILURE["risk"]))],
        "recommendation": V.MODEL_FAILURE["recommendation"],
    },
    ensure_ascii=False,
    separators=(",", ":"),
)
CLEAN_SQL = f"""
    SELECT event_id, CASE WHEN event_type = 'view' THEN {sql_text(_FAILURE)} ELSE props END AS answer FROM events"""


def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names as data URLs of several types."""
    kind = F.element_at(
        F.array(*[F.lit(m) for m in ("image/PNG", "image/jpg", "image/jpeg", "application/pdf")]),
        (F.col("c_nationkey") % 4 + 1).cast("int"),
    )
    url = F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(F.encode("c_name", "utf-8")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", url.alias("url"))
    parsed = urls.parse_base64_data_url(F.col("url"))
    return rows.select(
        "c_custkey",
        parsed["mime"].alias("mime"),
        F.decode(parsed["bytes"], "utf-8").alias("payload"),
        F.coalesce(urls.signature_mime(F.col("url")), F.lit("none")).alias("signature"),
        urls.is_image_data_url(F.col("url"), V.MAX_PAGE_IMAGE_CHARS).cast("int").alias("is_image"),
        urls.parse_png_data_url(F.col("url")).isNotNull().cast("int").alias("is_png"),
        urls.parse_image_data_url(F.col("url")).isNotNull().cast("int").alias("is_picture"),
    )


DATA_URLS_SQL = """
    SELECT c_custkey, lower(kind) AS mime, c_name AS payload,
      CASE c_nationkey % 4 WHEN 0 THEN 'image/png' WHEN 3 THEN 'none' ELSE 'image/jpeg' END AS signature,
      (kind LIKE 'image%')::INTEGER AS is_image, (kind = 'image/PNG')::INTEGER AS is_png,
      (kind LIKE 'image%')::INTEGER AS is_picture
    FROM (SELECT *, (['image/PNG', 'image/jpg', 'image/jpeg', 'application/pdf'])[c_nationkey % 4 + 1] AS kind FROM customer)"""


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes taken from line items, some of which leave the page."""

    def box(x: str, y: str) -> F.Column:
        return F.struct(
            (F.col(x) * 5).alias("x"), F.col(y).alias("y"), (F.col("l_quantity") / 50).alias("w"), F.lit(0.5).alias("h")
        )

    page = (F.col("l_linenumber") - 2).cast("double")
    placed = F.struct(page.alias("pageIndex"), box("l_discount", "l_tax").alias("a"), box("l_tax", "l_discount").alias("b"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", urls.valid_placement(placed).cast("int").alias("valid")
    )


PLACEMENTS_SQL = """
    SELECT l_orderkey, l_linenumber, l_partkey, (l_linenumber >= 2
      AND l_discount * 5 >= 0 AND l_discount * 5 <= 1 AND l_tax * 5 >= 0 AND l_tax * 5 <= 1
      AND l_quantity / 50 > 0 AND l_quantity / 50 <= 1
      AND l_discount * 5 + l_quantity / 50 <= 1.001::DOUBLE AND l_tax + 0.5::DOUBLE <= 1.001::DOUBLE
      AND l_tax * 5 + l_quantity / 50 <= 1.001::DOUBLE AND l_discount + 0.5::DOUBLE <= 1.001::DOUBLE)::INTEGER AS valid
    FROM lineitem"""


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as file names, brands' numbers as declared types."""
    ext = F.element_at(F.array(*[F.lit(e) for e in (".PDF", ".doc", ".docx", ".png", ".TXT", "")]), F.col("p_size") % 6 + 1)
    mime = F.element_at(
        F.array(*[F.lit(m) for m in (V.MIME_PDF, V.MIME_DOC, V.MIME_DOCX, "image/png", V.MIME_TXT, "")]),
        (F.col("p_partkey") % 6 + 1).cast("int"),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", ext).alias("name"), mime.alias("mime"))
    flags = labels.detect_file_kind(F.lit(""), F.col("mime"), F.col("name"))
    none = F.lit("none")
    return rows.select(
        "p_partkey",
        F.coalesce(labels.file_kind(flags, labels.EXTRACTION_ORDER), none).alias("extracted_as"),
        F.coalesce(labels.file_kind(flags, labels.EXPORT_ORDER), none).alias("exported_as"),
        F.coalesce(labels.upload_kind(F.col("mime"), F.col("name")), none).alias("uploaded_as"),
        labels.file_extension(F.col("name")).alias("last_part"),
        labels.path_extension(F.col("name")).alias("extension"),
    )


FILE_KINDS_SQL = f"""
    WITH f AS (SELECT p_partkey, p_name, s, m, (s = 0 OR m = 0) AS pdf, (s = 1 OR m = 1) AS doc, (s = 2 OR m = 2) AS docx
      FROM (SELECT *, p_size % 6 AS s, p_partkey % 6 AS m FROM part))
    SELECT p_partkey,
      CASE WHEN docx THEN 'docx' WHEN doc THEN 'doc' WHEN pdf THEN 'pdf' ELSE 'none' END AS extracted_as,
      CASE WHEN pdf THEN 'pdf' WHEN doc THEN 'doc' WHEN docx THEN 'docx' ELSE 'none' END AS exported_as,
      CASE WHEN pdf THEN 'pdf' WHEN doc THEN 'doc' WHEN docx THEN 'docx' WHEN m = 3 THEN 'image'
        WHEN m = 4 OR s = 4 THEN 'txt' ELSE 'none' END AS uploaded_as,
      CASE WHEN s = 5 THEN lower(p_name) ELSE (['pdf', 'doc', 'docx', 'png', 'txt'])[s + 1] END AS last_part,
      CASE WHEN s = 5 THEN '' ELSE (['.pdf', '.doc', '.docx', '.png', '.txt'])[s + 1] END AS extension
    FROM f"""


def last_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_question_of(table(spark, sf_dir, "conversations"))


QUERIES = {
    "strip_html": (strip_html, f"SELECT page_id, {sql_strip_html('html')} AS text FROM pages"),
    "chunk_documents": (
        chunk_documents,
        f"SELECT doc_id, ordinal, text, 'doc_' || doc_id || '_chunk_' || ordinal AS id"
        f" FROM ({sql_chunks('documents', 'doc_id', 'text')})",
    ),
    "chunk_pages": (chunk_pages, CHUNK_PAGES_SQL),
    "normalize_text": (normalize_text, NORMALIZE_SQL),
    "extract_text": (extract_text, EXTRACT_SQL),
    "docx_text": (docx_text, DOCX_SQL),
    "line_reassembly": (line_reassembly, LINES_SQL),
    "json_valid": (json_valid, JSON_VALID_SQL),
    "clean_answers": (clean_answers, CLEAN_SQL),
    "data_urls": (data_urls, DATA_URLS_SQL),
    "placements": (placements, PLACEMENTS_SQL),
    "file_kinds": (file_kinds, FILE_KINDS_SQL),
    "last_question": (
        last_question,
        "SELECT conv_id, arg_max(text, turn) AS question FROM conversations GROUP BY conv_id",
    ),
}
