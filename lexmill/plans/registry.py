"""All registered queries by name."""

from __future__ import annotations

from lexmill.plans import files, flows, history, quality, retrieval, risk, search, streams, text

ALL = {
    **retrieval.QUERIES,
    **text.QUERIES,
    **risk.QUERIES,
    **search.QUERIES,
    **history.QUERIES,
    **quality.QUERIES,
    **streams.QUERIES,
    **flows.QUERIES,
    **files.QUERIES,
}
