"""Identity functions: hashes and ids that must be the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_hash(path: Column) -> Column:
    """First 16 hexadecimal digits of the path's SHA-1."""
    return F.substring(F.sha1(path), 1, 16)


def collection_name(path: Column) -> Column:
    """Name of a project's vector collection."""
    return F.concat(F.lit("project_"), F.md5(path))


def chunk_doc_id(path: Column, start: Column, end: Column, index: Column) -> Column:
    """Id of a chunk's vector: 12 digits of the path's MD5, the line range and the position in the file."""
    return F.concat(F.substring(F.md5(path), 1, 12), F.lit(":"), start, F.lit("-"), end, F.lit(":"), index)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def safe_model_name(model: Column) -> Column:
    """A model's name as a directory name."""
    return F.lower(F.translate(model, "/-", "__"))
