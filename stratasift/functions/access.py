"""Access by bit masks: a document's role and department masks against a user's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_MASK = 0xFFFFFFFF

#: Role masks that see everything: the super administrator and the role "admin".
ADMIN_MASKS = (0xFFFFFFFF, 0x80000000)


def mask_valid(c: Column) -> Column:
    return c.isNotNull() & c.between(0, MAX_MASK)


def axis_open(doc_mask: Column, user_mask: Column) -> Column:
    """Zero is public; otherwise one bit must be shared."""
    return (doc_mask == 0) | (doc_mask.bitwiseAND(user_mask) != 0)


def is_admin(user_role: Column, admin_masks=ADMIN_MASKS) -> Column:
    return user_role.isin(*admin_masks)


def is_allowed(doc_role: Column, user_role: Column, doc_dept: Column, user_dept: Column) -> Column:
    return is_admin(user_role) | (axis_open(doc_role, user_role) & axis_open(doc_dept, user_dept))


def is_authorized(doc_role: Column, user_role: Column, doc_dept: Column, user_dept: Column) -> Column:
    """:func:`is_allowed`, but a missing or impossible mask denies, whoever asks."""
    valid = mask_valid(doc_role) & mask_valid(doc_dept)
    return F.coalesce(valid & is_allowed(doc_role, user_role, doc_dept, user_dept), F.lit(False))


def in_epoch(epoch: Column, wanted: str) -> Column:
    """Rows of an epoch; the epoch ``default`` also owns rows without one."""
    return F.coalesce(epoch == wanted, F.lit(wanted == "default"))


def mask_of(bits: Column) -> Column:
    """Aggregate: names' bits folded by or; names without a bit add nothing."""
    return F.coalesce(F.bit_or(bits), F.lit(0).cast("long"))


def glob_pattern(glob: str) -> str:
    """Regular expression of a shell pattern whose ``*`` also crosses slashes."""
    out = []
    for ch in glob:
        out.append({"*": ".*", "?": "."}.get(ch) or re.escape(ch))
    return "^" + "".join(out) + "$"


def first_glob(path: Column, rules: list[tuple[str, object]], default) -> Column:
    """Value of the first pattern that fits; a default is required."""
    if default is None:
        raise ValueError("a default is required")
    result = None
    for glob, value in rules:
        fits = path.rlike(glob_pattern(glob))
        result = F.when(fits, F.lit(value)) if result is None else result.when(fits, F.lit(value))
    return F.lit(default) if result is None else result.otherwise(F.lit(default))


def valid_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_-]+$"), F.lit(False))


def inside_root(path: Column) -> Column:
    """Relative and without a step upwards."""
    return F.coalesce(~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))
