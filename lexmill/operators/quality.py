"""Checks on requests, uploads, texts and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill import fixed_values as V
from lexmill.functions.falsy import blank_to_null
from lexmill.functions.labels import file_extension, upload_kind
from lexmill.functions.text import js_trim, utf16_length
from lexmill.operators.joins import insert_unique

# --- fixed values: names of the failing upload rule and the e-mail pattern ------
TOO_MANY = "too many files"
MIXED = "several files must all be images"
EXTENSION = "extension not allowed"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PASSWORD_MIN = 6


def min_length(df: DataFrame, col: str, n: int, trimmed: bool = False) -> DataFrame:
    text = js_trim(F.col(col)) if trimmed else F.col(col)
    return df.where(utf16_length(text) >= n)


def valid_dimension(df: DataFrame, col: str = "values", dim: int = V.VECTOR_DIMENSION) -> DataFrame:
    return df.where(F.size(col) == dim)


def drop_analysis_text(df: DataFrame, col: str = "analysis") -> DataFrame:
    """The analysis struct without the contract's own text."""
    return df.withColumn(col, F.col(col).dropFields("contract_text"))


def _given(df: DataFrame, name: str) -> Column:
    """Neither null, "" nor 0."""
    kind = df.schema[name].dataType.typeName()
    if kind == "string":
        return blank_to_null(F.col(name)).isNotNull()
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return F.coalesce(F.col(name) != 0, F.lit(False))
    return F.col(name).isNotNull()


def require_fields(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)`` by whether every column is filled."""
    ok = F.lit(True)
    for name in cols:
        ok = ok & _given(df, name)
    return df.where(ok), df.where(~ok)


def validate_upload(
    files: DataFrame, upload_id: str = "upload_id", name: str = "name", mime: str = "mime", side: str = "client"
) -> DataFrame:
    """``(upload_id, n_files, error)``: first failing rule per upload, null if none.

    The client goes by the file's extension, the server by type or extension.
    """
    is_image = F.coalesce(F.col(mime).startswith("image/"), F.lit(False))
    if side == "client":
        allowed = file_extension(F.col(name)).isin(*V.UPLOAD_EXTENSIONS)
    elif side == "server":
        allowed = upload_kind(F.col(mime), F.col(name)).isNotNull()
    else:
        raise ValueError(f"unknown side {side!r}")
    per_upload = files.groupBy(upload_id).agg(
        F.count("*").alias("n_files"),
        F.every(is_image).alias("_images"),
        F.every(allowed).alias("_allowed"),
    )
    error = (
        F.when(F.col("n_files") > V.MAX_FILES, TOO_MANY)
        .when((F.col("n_files") > 1) & ~F.col("_images"), MIXED)
        .when(~F.col("_allowed"), EXTENSION)
    )
    return per_upload.select(upload_id, "n_files", error.alias("error"))


def validate_register(
    existing: DataFrame,
    requests: DataFrame,
    order: list[str],
    name: str = "name",
    email: str = "email",
    password: str = "password",
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; the password goes no further than its length check.

    Rejected rows carry ``error``: name, email, password or taken.
    """
    bad = (
        F.when(blank_to_null(js_trim(F.col(name))).isNull(), "name")
        .when(~F.coalesce(F.col(email).rlike(EMAIL), F.lit(False)), "email")
        .when(~F.coalesce(utf16_length(F.col(password)) >= PASSWORD_MIN, F.lit(False)), "password")
    )
    checked = requests.withColumn("error", bad).drop(password)
    sound = checked.where(F.col("error").isNull()).drop("error")
    accepted, taken = insert_unique(existing, sound, email, order)
    rejected = checked.where(F.col("error").isNotNull())
    return accepted, rejected.unionByName(taken.withColumn("error", F.lit("taken")))
