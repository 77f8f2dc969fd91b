"""Identifiers and hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the DNS name space of RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def point_id(name: Column) -> Column:
    """The version-5 uuid of a name in the DNS name space."""
    digest = F.sha1(F.unhex(F.concat(F.lit(DNS_NAMESPACE), F.hex(F.encode(name, "utf-8")))))
    variant = F.element_at(
        F.array(F.lit("8"), F.lit("9"), F.lit("a"), F.lit("b")),
        (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1),
    )
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def chunk_point_id(paper_id: Column, chunk_idx: Column) -> Column:
    return point_id(F.concat_ws("_", paper_id, chunk_idx.cast("string")))


def hash_id(value: Column, length: int = 20) -> Column:
    return F.substring(F.sha2(F.regexp_replace(value, r"^\s+|\s+$", ""), 256), 1, length)


def query_hash(text: Column) -> Column:
    return F.sha2(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), 256)


def task_id(user_id: Column, notebook_id: Column) -> Column:
    return F.concat_ws("/", user_id, notebook_id)


def group_endpoint(path: Column) -> Column:
    return F.regexp_replace(path, "/notebook/[^/]+", "/notebook/:id")


def sub_query_id(index: Column, query_id: Column) -> Column:
    return F.concat_ws("_", index.cast("string"), query_id)
