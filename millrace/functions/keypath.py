"""Key paths such as ``$.a["b.c"].d``: where in a message its partition key sits."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed syntax: ids are letters, digits, '_' and '-'; an unquoted id may not start with '-';
# a quoted id may also hold '.'.
_STEP = re.compile(r'\.([A-Za-z0-9_][A-Za-z0-9_-]*)|\["([A-Za-z0-9_.-]+)"\]')


class KeyPathError(ValueError):
    """The text is not a key path."""


def steps(path: str | None) -> list[str] | None:
    """Field names below the root; ``None`` for a blank path, ``[]`` for ``$``."""
    text = (path or "").strip()
    if not text:
        return None
    if not text.startswith("$"):
        raise KeyPathError(f"expected '$' at position 0 of {text!r}")
    names, at = [], 1
    while at < len(text):
        step = _STEP.match(text, at)
        if step is None:
            raise KeyPathError(f"unexpected text at position {at} of {text!r}")
        names.append(step.group(1) or step.group(2))
        at = step.end()
    return names


def key_node(message: Column, path: str | None) -> Column:
    """The key node of a VARIANT message: SQL NULL when missing, a variant null when null."""
    names = steps(path)
    if names is None:
        return F.lit(None).cast("variant")
    # A step through an array or a scalar finds nothing, as a missing field would.
    return F.try_variant_get(message, "$" + "".join(f"['{n}']" for n in names), "variant")


def key_steps(path: Column) -> Column:
    """Step names of key paths held in a column, as an array; NULL for blank or invalid paths."""
    text = F.trim(path)
    valid = text.rlike(r'^\$(\.[A-Za-z0-9_][A-Za-z0-9_-]*|\["[A-Za-z0-9_.-]+"\])*$')
    found = F.regexp_extract_all(
        text, F.lit(r'(\.[A-Za-z0-9_][A-Za-z0-9_-]*|\["[A-Za-z0-9_.-]+"\])'), F.lit(1)
    )
    names = F.transform(found, lambda s: F.regexp_replace(s, r'^\.|^\["|"\]$', ""))
    return F.when(valid, names)


def _md5_number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def key_hash(node: Column, spread: Column) -> Column:
    """Hash of a key node. An explicit null hashes to a constant; a missing key is placed by ``spread``, a text that
    names the message: rows without a key balance over all partitions, and a row that is computed again stays on its own.
    """
    return F.when(node.isNull(), F.xxhash64(spread)).otherwise(F.xxhash64(F.to_json(node)))


def md5_hash(node: Column, spread: Column) -> Column:
    """A key hash other engines can reproduce: the first 32 bits of the MD5 of the key's JSON, or of ``spread``."""
    return F.when(node.isNull(), _md5_number(spread)).otherwise(_md5_number(F.to_json(node)))


def partition_number(hash_value: Column, partitions: int) -> Column:
    """Partition 0..partitions-1; ``pmod`` keeps it non-negative for every hash."""
    return F.pmod(hash_value, F.lit(partitions)).cast("int")
