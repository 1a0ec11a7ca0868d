"""Labels, redaction and payloads."""

from __future__ import annotations

from turnstile.plans.dialect import Dialect
from turnstile.plans.registry import sql
from turnstile.sources.bindings import labels_given, payloads, sightings, sources


@sql
def redact_url(d: Dialect) -> str:
    """Credentials in URLs are scrubbed; a source label keeps scheme, host and path."""
    scrubbed = d.replace("u", "://[^/@]+@", "://***@")
    label = d.replace(d.replace("u", "://[^/@]+@", "://"), "[?#].*$", "")
    return f"SELECT page_id, {scrubbed} AS redacted, {label} AS label FROM {sources(d)} AS p"


@sql
def slug(d: Dialect) -> str:
    """Runs of other characters become one dash; nothing left becomes 'eval'."""
    dashed = d.replace("lower(p_name)", "[^a-z0-9]+", "-")
    return f"SELECT p_partkey, coalesce(nullif({d.replace(dashed, '^-|-$', '')}, ''), 'eval') AS slug FROM {labels_given(d)} AS p"


@sql
def id_valid(d: Dialect) -> str:
    return f"SELECT p_partkey, {d.matches('p_name', '^[A-Za-z0-9._-]{1,64}$')} AS by_name, {d.matches(d.replace('p_name', '[^A-Za-z0-9]', '.'), '^[A-Za-z0-9._-]{1,64}$')} AS by_label FROM {labels_given(d)} AS p"


@sql
def payload_fields(d: Dialect) -> str:
    """Fields of JSON payloads; what isn't there is null."""
    return f"SELECT event_id, CAST({d.json('props', 'k')} AS BIGINT) AS k, {d.json('props', 'missing')} AS missing FROM {sightings(d)} AS s"


@sql
def payload_budget(d: Dialect) -> str:
    """What payloads over the byte budget shed: rows first, details where they are over half of it."""
    size = "octet_length(CAST(text AS BINARY))" if d.spark else "octet_length(encode(text))"
    return f"SELECT conv_id, turn, {size} AS bytes, CASE WHEN {size} > {d.k.payload_bytes} THEN 'rows' WHEN {size} * 2 > {d.k.payload_bytes} THEN 'detail' END AS shed FROM {payloads(d)} AS p"
