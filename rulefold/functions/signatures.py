"""Stable 16-digit signatures of rule bodies, spec entries and finding sets.

Canonical text is JSON with alphabetical keys, no blanks and explicit nulls. On tables it is produced by
``to_json`` over a struct whose fields are already in alphabetical order, which libraries, memory and lineage share; for
a body of an own rule kind on the driver by ``json.dumps``.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 16


def digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, DIGITS)


def canonical_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def signature(**fields: Column) -> Column:
    """Signature of a record given as named columns."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return digest(canonical_json(ordered))


def sorted_map(m: Column) -> Column:
    """Map with its entries in key order, so equal maps have one text form."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def signature_of(body: dict[str, Any]) -> str:
    """Signature of one body held on the driver."""
    text = json.dumps(body, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:DIGITS]
