"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import NAMESPACE, UUID_NAMESPACE

UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def as_uuid(c: Column) -> Column:
    """The text in lower case if it is a canonical UUID, else null."""
    return F.when(c.rlike(UUID), F.lower(c))


def uuid5(name: Column) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(UUID_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def local_name(kind: Column, source: Column, key: Column, schemes: Column, slug: Column) -> Column:
    """Scheme: its slug. Taxonomy value: UUIDv5 of least scheme and key. Others: the source's UUID, else UUIDv5 of source and key."""
    return (
        F.when(kind == "scheme", slug)
        .when(kind == "taxonomy-value", uuid5(F.concat(F.array_min(schemes), F.lit("|"), key)))
        .otherwise(F.coalesce(as_uuid(key), uuid5(F.concat(source, F.lit(":"), key))))
    )


def namespace(kind: Column, base: str) -> Column:
    out = F.lit(None).cast("string")
    for k, v in NAMESPACE.items():
        out = F.when(kind == k, F.lit(base + v)).otherwise(out)
    return out


def rebase(iri: Column, old: str, new: str) -> Column:
    return F.when(F.startswith(iri, F.lit(old)), F.concat(F.lit(new), F.substring(iri, len(old) + 1, 1 << 30))).otherwise(iri)
