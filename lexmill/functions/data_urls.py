"""Base64 data URLs and the signature boxes stored beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill import fixed_values as V
from lexmill.functions.binding import let
from lexmill.functions.text import utf16_length

# --- fixed values: accepted data URL forms ----------------------------------
PAYLOAD = r"([^\n\r\x{2028}\x{2029}]+)\z"
PNG_URL = r"(?i)^data:image/(png);base64," + PAYLOAD
IMAGE_URL = r"(?i)^data:image/(png|jpe?g);base64," + PAYLOAD
ANY_URL = r"(?i)^data:([^;]+);base64," + PAYLOAD

BOX_TYPE = "struct<x:double,y:double,w:double,h:double>"
PLACEMENT_TYPE = f"struct<pageIndex:double,a:{BOX_TYPE},b:{BOX_TYPE}>"
PLACEMENT_PARTS = PLACEMENT_TYPE.replace("double", "variant")


def _decode(payload: Column) -> Column:
    """Lenient base64: both alphabets, stray characters skipped, padding optional."""
    body = F.substring_index(F.translate(payload, "-_", "+/"), "=", 1)
    body = F.regexp_replace(body, "[^A-Za-z0-9+/]", "")
    whole = F.substring(body, F.lit(1), F.length(body) - _odd(body))
    padding = F.repeat(F.lit("="), (4 - F.length(whole) % 4) % 4)
    return F.unbase64(F.concat(whole, padding))


def _odd(body: Column) -> Column:
    """A single left-over character carries no byte."""
    return F.when(F.length(body) % 4 == 1, 1).otherwise(0)


def _parse(url: Column, pattern: str, mime_prefix: str) -> Column:
    mime = F.lower(F.concat(F.lit(mime_prefix), F.regexp_extract(url, pattern, 1)))
    payload = F.regexp_extract(url, pattern, 2)
    return F.when(
        url.rlike(pattern),
        F.struct(mime.alias("mime"), _decode(payload).alias("bytes")),
    )


def parse_png_data_url(url: Column) -> Column:
    return _parse(url, PNG_URL, "image/")


def parse_image_data_url(url: Column) -> Column:
    return _parse(url, IMAGE_URL, "image/")


def parse_base64_data_url(url: Column) -> Column:
    return _parse(url, ANY_URL, "")


def signature_mime(url: Column) -> Column:
    """PNG or JPEG type of a signature, with image/jpg written as image/jpeg."""
    mime = parse_base64_data_url(url)["mime"]
    return F.when(mime == "image/jpg", "image/jpeg").when(mime.isin("image/png", "image/jpeg"), mime)


def is_image_data_url(url: Column, max_chars: int | None = None) -> Column:
    ok = F.coalesce(url.rlike(IMAGE_URL), F.lit(False))
    if max_chars is not None:
        ok = ok & (utf16_length(url) <= max_chars)
    return ok


def valid_box(box: Column) -> Column:
    """Four finite fractions of a page that stay on the page."""
    x, y, w, h = (box[name] for name in "xywh")
    finite = F.lit(True)
    for side in (x, y, w, h):
        finite = finite & side.isNotNull() & ~F.isnan(side) & (F.abs(side) != float("inf"))
    inside = (x >= 0) & (y >= 0) & (w > 0) & (h > 0)
    inside = inside & (x <= 1) & (y <= 1) & (w <= 1) & (h <= 1)
    inside = inside & (x + w <= V.BOX_LIMIT) & (y + h <= V.BOX_LIMIT)
    return F.coalesce(finite & inside, F.lit(False))


def valid_placement(placement: Column) -> Column:
    """``struct(pageIndex, a, b)`` with a page number and two valid boxes."""
    page = placement["pageIndex"]
    page_ok = page.isNotNull() & ~F.isnan(page) & (page < float("inf")) & (page >= 0)
    return F.coalesce(page_ok, F.lit(False)) & valid_box(placement["a"]) & valid_box(placement["b"])


def placement_struct(value: Column) -> Column:
    """A variant read into ``struct(pageIndex, a, b)``; text in place of a number is null.

    An object is written as JSON text by its known parts: a variant's own keys are dear to write.
    """
    parts = F.try_variant_get(value, "$", PLACEMENT_PARTS)
    text = let(parts, lambda known: F.when(known.isNotNull(), F.to_json(known)).otherwise(F.to_json(value)))
    return F.from_json(text, PLACEMENT_TYPE)


def valid_placement_json(value: Column) -> Column:
    return let(placement_struct(value), valid_placement)


def _json_strings(value: Column) -> Column:
    """A JSON array of strings; null when it is no array or holds another type."""
    is_strings = F.schema_of_variant(value).isin("ARRAY<STRING>", "ARRAY<VOID>")
    return F.when(is_strings, F.try_variant_get(value, "$", "array<string>"))


def valid_page_images(value: Column) -> Column:

    def valid(pages: Column) -> Column:
        size_ok = (F.size(pages) >= 1) & (F.size(pages) <= V.MAX_FILES)
        return size_ok & F.forall(pages, lambda page: is_image_data_url(page, V.MAX_PAGE_IMAGE_CHARS))

    return F.coalesce(let(_json_strings(value), valid), F.lit(False))


def valid_page_names(value: Column) -> Column:

    def valid(names: Column) -> Column:
        short = F.forall(names, lambda name: utf16_length(name) <= V.MAX_PAGE_NAME_CHARS)
        return (F.size(names) <= V.MAX_FILES) & short

    return F.coalesce(let(_json_strings(value), valid), F.lit(False))
