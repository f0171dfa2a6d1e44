"""Labels shown next to scores, severities and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill import fixed_values as V
from lexmill.functions.falsy import blank_to_null, or_default


def severity_badge(severity: Column) -> Column:
    """Badge of the analysis page, where a missing severity counts as medium."""
    level = F.lower(or_default(severity, "medium"))
    return (
        F.when(level == "high", V.BADGE_HIGH)
        .when(level == "medium", V.BADGE_MEDIUM)
        .otherwise(V.BADGE_OTHER)
    )


def severity_label(severity: Column) -> Column:
    """Label of the detail page: the raw value, or a note when it is missing."""
    return or_default(severity, V.DETAIL_OTHER)


def severity_style(severity: Column) -> Column:
    """Style class of the detail page: high, medium or other."""
    level = F.lower(severity)
    return F.when(level == "high", "high").when(level == "medium", "medium").otherwise("other")


def safety_badge(score: Column) -> Column:
    safe = F.coalesce(score, F.lit(0)) >= V.SAFE_SCORE
    return F.when(safe, V.BADGE_SAFE).otherwise(V.BADGE_RISKY)


def effective_risk_score(snake: Column, camel: Column) -> Column:
    return F.coalesce(snake, camel, F.lit(0))


def display_name(is_image_batch: Column, n_files: Column, first_name: Column) -> Column:
    return F.when(is_image_batch, F.format_string(V.IMAGE_BATCH_NAME, n_files)).otherwise(first_name)


def file_extension(name: Column) -> Column:
    """Part after the last dot, lower-cased; the whole name when there is no dot."""
    return F.lower(F.substring_index(F.coalesce(name, F.lit("")), ".", -1))


def path_extension(name: Column) -> Column:
    """Extension with its dot, lower-cased; "" without one or for ``.name``."""
    base = F.substring_index(F.coalesce(name, F.lit("")), "/", -1)
    return F.lower(F.regexp_extract(base, r"(?s)^.+(\.[^.]*)\z", 1))


def detect_file_kind(data_mime: Column, hint_mime: Column, hint_name: Column) -> Column:
    """``struct(is_pdf, is_doc, is_docx)``; each flag is the OR of three signals."""

    def lowered(col: Column) -> Column:
        return F.lower(F.coalesce(col, F.lit("")))

    mime, hint, name = lowered(data_mime), lowered(hint_mime), lowered(hint_name)

    def flag(value: str, suffix: str) -> Column:
        return (mime == value) | (hint == value) | name.endswith(suffix)

    return F.struct(
        flag(V.MIME_PDF, ".pdf").alias("is_pdf"),
        flag(V.MIME_DOC, ".doc").alias("is_doc"),
        flag(V.MIME_DOCX, ".docx").alias("is_docx"),
    )


# Order in which overlapping flags are tried, by purpose.
EXTRACTION_ORDER = ("docx", "doc", "pdf")
EXPORT_ORDER = ("pdf", "doc", "docx")


def file_kind(flags: Column, order: tuple[str, ...] = EXTRACTION_ORDER) -> Column:
    """First kind in ``order`` whose flag is set, else null."""
    return F.coalesce(*[F.when(flags[f"is_{kind}"], F.lit(kind)) for kind in order])


def upload_kind(mime: Column, name: Column) -> Column:
    """Kind of one uploaded contract: pdf, doc, docx, image or txt, else null."""
    ext = path_extension(name)
    kind = F.when((mime == V.MIME_PDF) | (ext == ".pdf"), "pdf")
    kind = kind.when((mime == V.MIME_DOC) | (ext == ".doc"), "doc")
    kind = kind.when((mime == V.MIME_DOCX) | (ext == ".docx"), "docx")
    kind = kind.when(blank_to_null(mime).startswith("image/"), "image")
    return kind.when((mime == V.MIME_TXT) | (ext == ".txt"), "txt")
