"""The contract-history table: reading, changing and folding it.

Every change is ``DataFrame -> DataFrame`` with an explicit clock. Changes are
keyed by ``Id``, which is unique, so the joins carry no hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, TimestampType

from lexmill import fixed_values as V
from lexmill.functions import data_urls as urls
from lexmill.functions import json_meta as meta
from lexmill.functions.binding import expand, let
from lexmill.functions.falsy import blank_to_null, or_default
from lexmill.functions.labels import detect_file_kind, file_kind
from lexmill.functions.text import js_trim, normalize_contract_text, normalize_text
from lexmill.operators.indexing import assign_ids
from lexmill.operators.quality import require_fields

# --- fixed values: columns of the table and keys of a patch ----------------------
HISTORY_COLUMNS = {
    "Id": LongType(),
    "UserId": LongType(),
    "FileName": StringType(),
    "OriginalFileName": StringType(),
    "UploadedAt": TimestampType(),
    "AnalysisAt": TimestampType(),
    "RiskScore": IntegerType(),
    "AnalysisJson": StringType(),
    "AnalysisText": StringType(),
    "ContractText": StringType(),
    "IsFinal": IntegerType(),
    "CreatedAt": TimestampType(),
    "UpdatedAt": TimestampType(),
    "DeletedAt": TimestampType(),
}
UNREADABLE = "invalid JSON"
META_KEYS = ("title", "category", "description", "signaturePlacement", "pagesImages", "pagesOriginalNames")
SIGNATURE_KEYS = ("signatureADataUrl", "signatureBDataUrl")
PATCH_KEYS = META_KEYS + SIGNATURE_KEYS


def ensure_columns(df: DataFrame, spec: dict | None = None) -> DataFrame:
    """Missing columns of ``spec`` added as typed nulls."""
    missing = {name: F.lit(None).cast(kind) for name, kind in (spec or HISTORY_COLUMNS).items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def _clock(df: DataFrame, as_of, like: str) -> Column:
    value = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return value.cast(df.schema[like].dataType)


# --- reading -----------------------------------------------------------------------


def _listed(df: DataFrame, user: int | None, by: str) -> DataFrame:
    if user is not None:
        return df.where(F.col("UserId") == user).orderBy(F.desc(by), F.desc("Id"))
    return df.orderBy("UserId", F.desc(by), F.desc("Id"))


def list_history(df: DataFrame, user: int | None = None) -> DataFrame:
    """Records not in the trash, newest first; of one user, or of all by user."""
    df = ensure_columns(df, {"DeletedAt": TimestampType()})
    return _listed(df.where(F.col("DeletedAt").isNull()), user, "CreatedAt")


def list_trash(df: DataFrame, user: int | None = None) -> DataFrame:
    df = ensure_columns(df, {"DeletedAt": TimestampType()})
    return _listed(df.where(F.col("DeletedAt").isNotNull()), user, "DeletedAt")


def history_detail(df: DataFrame, ids: DataFrame | int) -> DataFrame:
    """Records by id, those in the trash included."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select("Id").distinct(), "Id", "left_semi")
    return df.where(F.col("Id") == ids)


def record_view(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("Id").alias("id"),
        F.col("FileName").alias("name"),
        F.date_format("CreatedAt", "d/M/yyyy").alias("date"),
        F.col("RiskScore").alias("risk_score"),
        F.col("DeletedAt").alias("deleted_at"),
    )


def _stored_text() -> Column:
    return or_default(F.col("ContractText"), F.col("AnalysisText"))


def original_files(df: DataFrame) -> DataFrame:
    """``(Id, kind, content)`` of records whose original file is kept as a data URL."""
    told = let(
        meta.safe_json_parse(F.col("AnalysisJson")),
        lambda parsed: F.struct(
            meta.meta_text(parsed, "originalFileDataUrl").alias("url"),
            meta.meta_text(parsed, "originalFileMimeType").alias("hint_mime"),
            meta.meta_text(parsed, "originalFileName").alias("hint_name"),
        ),
    )
    named = expand(df, ["Id"], told).where(blank_to_null(F.col("url")).isNotNull())
    opened = expand(named, ["Id", "hint_mime", "hint_name"], urls.parse_base64_data_url(F.col("url")))
    flags = detect_file_kind(F.col("mime"), F.col("hint_mime"), F.col("hint_name"))
    return opened.where(F.length("bytes") > 0).select("Id", file_kind(flags).alias("kind"), F.col("bytes").alias("content"))


def backfill_contract_text(df: DataFrame, texts: DataFrame, as_of) -> DataFrame:
    """Blank texts filled from ``texts(Id, text)``, read from the original files.

    The texts can be as many as the records and are longer than the columns their
    size is estimated from, so they are moved by key and never broadcast.
    """
    derived = texts.select("Id", F.col("text").alias("_derived")).hint("merge")
    has_file = blank_to_null(meta.meta_text(meta.safe_json_parse(F.col("AnalysisJson")), "originalFileDataUrl")).isNotNull()
    is_blank = js_trim(F.coalesce(_stored_text(), F.lit(""))) == ""
    fill = is_blank & has_file & blank_to_null(F.col("_derived")).isNotNull()
    return (
        df.join(derived, "Id", "left")
        .withColumn("_fill", fill)
        .withColumn("ContractText", F.when(F.col("_fill"), F.col("_derived")).otherwise(F.col("ContractText")))
        .withColumn("UpdatedAt", F.when(F.col("_fill"), _clock(df, as_of, "UpdatedAt")).otherwise(F.col("UpdatedAt")))
        .select(*df.columns)
    )


def export_contract_text(df: DataFrame) -> DataFrame:
    """``(Id, lines)``: the text form of a record's report."""
    stored = let(
        meta.safe_json_parse(F.col("AnalysisJson")),
        lambda parsed: F.struct(
            *[blank_to_null(meta.meta_text(parsed, key)).alias(f"_{key}") for key in ("title", "category", "description")]
        ),
    )
    told = expand(df, ["Id", "FileName", "ContractText", "AnalysisText", "CreatedAt"], stored)
    title = F.coalesce("_title", blank_to_null(F.col("FileName")), F.format_string(V.EXPORT_TITLE, F.col("Id")))
    created = F.concat(F.lit(V.EXPORT_CREATED), F.coalesce(F.date_format("CreatedAt", "HH:mm:ss d/M/yyyy"), F.lit("")))

    def optional(label: str, key: str) -> Column:
        return F.concat(F.lit(label), F.col(f"_{key}"))

    body = or_default(_stored_text(), V.EXPORT_EMPTY)
    text = normalize_text(body, collapse_newlines=False, trim=False)
    lines = F.array(
        title,
        created,
        optional(V.EXPORT_CATEGORY, "category"),
        optional(V.EXPORT_DESCRIPTION, "description"),
        F.lit(V.EXPORT_HEADING),
        text,
    )
    return told.select("Id", F.array_join(lines, "\n").alias("lines"))


# --- adding and changing -------------------------------------------------------------


def save_analysis(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejected)``: save requests as history rows that have no Id yet.

    Requests hold ``UserId, FileName, OriginalFileName, RiskScore, content,
    contractText, meta, RequestedAt`` and, where the original file was read,
    ``derivedText``. ``content`` and ``meta`` are JSON text.
    """
    requests = ensure_columns(
        requests, {"OriginalFileName": StringType(), "contractText": StringType(), "derivedText": StringType()}
    )
    valid, rejected = require_fields(requests, ["UserId", "FileName"])
    given = F.col("contractText")
    is_blank = js_trim(F.coalesce(given, F.lit(""))) == ""
    text = F.when(is_blank, or_default(F.col("derivedText"), given)).otherwise(given)
    now = F.col("RequestedAt")
    empty_time = F.lit(None).cast(requests.schema["RequestedAt"].dataType)
    rows = valid.select(
        F.col("UserId").cast("long").alias("UserId"),
        "FileName",
        "OriginalFileName",
        now.alias("UploadedAt"),
        now.alias("AnalysisAt"),
        F.col("RiskScore").cast("int").alias("RiskScore"),
        meta.merge_json_meta(F.col("content"), meta.patch_from_json(F.col("meta"))).alias("AnalysisJson"),
        F.lit(None).cast("string").alias("AnalysisText"),
        F.when(blank_to_null(text).isNotNull(), normalize_contract_text(text)).alias("ContractText"),
        F.lit(1).alias("IsFinal"),
        now.alias("CreatedAt"),
        empty_time.alias("UpdatedAt"),
        empty_time.alias("DeletedAt"),
    )
    return rows, rejected


def append_history(history: DataFrame, rows: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """``(history, inserted)``: rows numbered after the highest Id and appended."""
    highest = history.agg(F.max("Id")).first()[0] or 0
    numbered = assign_ids(rows, highest + 1, order)
    inserted = numbered.select("Id", "UserId", "FileName", "RiskScore", "AnalysisAt")
    return history.unionByName(numbered, allowMissingColumns=True), inserted


def _mark(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("Id").distinct().withColumn("_asked", F.lit(True)), "Id", "left")


def _set(marked: DataFrame, when: Column, columns: list[str], **values: Column) -> DataFrame:
    changed = marked.withColumn("_when", F.coalesce(when, F.lit(False)))
    for name, value in values.items():
        changed = changed.withColumn(name, F.when(F.col("_when"), value).otherwise(F.col(name)))
    return changed.select(*columns)


def soft_delete(df: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Into the trash; records already there keep their dates."""
    when = F.col("_asked") & F.col("DeletedAt").isNull()
    return _set(
        _mark(df, ids), when, df.columns, DeletedAt=_clock(df, as_of, "DeletedAt"), UpdatedAt=_clock(df, as_of, "UpdatedAt")
    )


def restore(df: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Out of the trash, whether or not the record is in it."""
    nothing = F.lit(None).cast(df.schema["DeletedAt"].dataType)
    return _set(_mark(df, ids), F.col("_asked"), df.columns, DeletedAt=nothing, UpdatedAt=_clock(df, as_of, "UpdatedAt"))


def purge(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Removed for good, in the trash or not."""
    return df.join(ids.select("Id").distinct(), "Id", "left_anti")


def missing_ids(df: DataFrame, ids: DataFrame, active_only: bool = False) -> DataFrame:
    """Asked ids that a change does not find (for a delete: not found among active records)."""
    known = df.where(F.col("DeletedAt").isNull()) if active_only else df
    return ids.select("Id").distinct().join(known.select("Id"), "Id", "left_anti")


def purge_expired(df: DataFrame, as_of, days: int = V.RETENTION_DAYS) -> DataFrame:
    """Without records that went to the trash more than ``days`` days before ``as_of``."""
    cutoff = _clock(df, as_of, "DeletedAt") - F.make_dt_interval(F.lit(days))
    return df.where(F.col("DeletedAt").isNull() | (F.col("DeletedAt") >= cutoff))


def _given(body: Column, key: str, valid: Column) -> Column:
    """False only when the key is present with an invalid value."""
    return ~F.map_contains_key(body, key) | valid


def meta_patch_error(body: Column) -> Column:
    """Name of the first invalid key of a meta patch, null when all are valid."""
    checks = {
        "signaturePlacement": urls.valid_placement_json,
        "pagesImages": urls.valid_page_images,
        "pagesOriginalNames": urls.valid_page_names,
    }
    return F.coalesce(*[F.when(~_given(body, key, check(body[key])), F.lit(key)) for key, check in checks.items()])


def signature_patch_error(body: Column) -> Column:
    def valid(key: str) -> Column:
        value = body[key]
        is_text = F.schema_of_variant(value) == "STRING"
        ok = is_text & urls.is_image_data_url(F.try_variant_get(value, "$", "string"))
        return F.is_variant_null(value) | F.coalesce(ok, F.lit(False))

    return F.coalesce(*[F.when(~_given(body, key, valid(key)), F.lit(key)) for key in SIGNATURE_KEYS])


def patch_error(body: Column) -> Column:
    """As ``meta_patch_error`` for a patch of a log, which may also hold signatures."""
    return F.coalesce(meta_patch_error(body), signature_patch_error(body))


def judged_patches(patches: DataFrame, text: str, keys: tuple[str, ...], error_of) -> DataFrame:
    """Adds ``_body``, the patch reduced to ``keys``, and ``error``: the invalid key, or that it cannot be read."""

    def judge(parsed: Column) -> Column:
        unreadable = F.when(meta.is_unreadable(F.col(text), parsed), F.lit(UNREADABLE))
        return let(
            meta.parsed_patch(parsed, keys),
            lambda body: F.struct(body.alias("_body"), F.coalesce(unreadable, error_of(body)).alias("error")),
        )

    return expand(patches, patches.columns, let(meta.safe_json_parse(F.col(text)), judge))


def _patch(df: DataFrame, patches: DataFrame, as_of, keys, error_of, order: str) -> tuple[DataFrame, DataFrame]:
    judged = judged_patches(patches, "patch", keys, error_of)
    sound = judged.where(F.col("error").isNull())
    bodies = merge_patches(sound.select("Id", order, "_body"), "Id", [order], "_body", keys)
    fresh = bodies.withColumn("_asked", F.lit(True))
    updated = _set(
        df.join(fresh, "Id", "left"),
        F.col("_asked"),
        df.columns,
        AnalysisJson=meta.merge_json_meta(F.col("AnalysisJson"), F.col("_body")),
        UpdatedAt=_clock(df, as_of, "UpdatedAt"),
    )
    # One pass: a branch each for the refused and the unknown would judge every patch twice.
    known = df.select("Id").distinct().withColumn("_known", F.lit(True)).hint("merge")
    unknown = F.when(F.col("_known").isNull(), F.lit("not found"))
    placed = judged.join(known, "Id", "left").withColumn("error", F.coalesce("error", unknown))
    return updated, placed.where(F.col("error").isNotNull()).select(*patches.columns, "error")


def merge_patches(patches: DataFrame, key: str, order: list[str], body: str, names: tuple[str, ...]) -> DataFrame:
    """Several patches of a record as one: the last value of each name wins.

    One combining aggregate per name, so a record with very many patches costs
    one row per task. An explicit null is a value; an absent name is not.
    """
    place = F.struct(*order)
    last = [
        F.max_by(F.col(body)[name], F.when(F.map_contains_key(F.col(body), name), place)).alias(f"_{name}")
        for name in names
    ]
    values = F.map_from_arrays(F.lit(list(names)), F.array(*[f"_{name}" for name in names]))
    given = F.map_filter(values, lambda _, value: value.isNotNull())
    return patches.groupBy(key).agg(*last).select(key, given.alias(body))


def update_meta(df: DataFrame, patches: DataFrame, as_of, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """``(updated, rejected)``: JSON patches ``(Id, patch, seq)`` laid over ``meta``.

    An absent key is unchanged and an explicit null is stored. Records in the
    trash are patched too. Rejected rows carry the invalid key, "invalid JSON" or
    "not found".
    """
    return _patch(df, patches, as_of, META_KEYS, meta_patch_error, order)


def update_signatures(df: DataFrame, patches: DataFrame, as_of, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """As ``update_meta`` for the two signature images; null clears one."""
    return _patch(df, patches, as_of, SIGNATURE_KEYS, signature_patch_error, order)


