"""Names that any destination takes: normalisation, collisions, child tables."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NAME = 63
#: System columns: load, row, parent, position, root.
PREFIX = "_sys_"
LOAD_ID, ROW_ID, PARENT_ID, POS, ROOT_ID = (PREFIX + n for n in ("load_id", "id", "parent_id", "pos", "root_id"))
SYSTEM = (LOAD_ID, ROW_ID, PARENT_ID, POS, ROOT_ID)

_ODD = re.compile(r"[^a-z0-9_]")
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_HASH = 8

#: Control and invisible code points that identifiers must not hold.
CONTROL_CLASS = r"[\x{00}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}]"


def ident_hash(source: str, length: int = _HASH) -> str:
    return hashlib.sha256(source.encode()).hexdigest()[:length]


def _fit(name: str, source: str, bound: int, force: bool) -> str:
    """``name`` with a hash of ``source`` at its end, if forced or too long; within the bound."""
    bound = max(1, bound)
    if not force and len(name) <= bound:
        return name
    digits = max(0, min(_HASH, bound - 1))
    return name[: bound - digits - 1] + "_" + ident_hash(source)[:digits]


def normalize_ident(source: str, bound: int = MAX_NAME) -> str:
    """Lower-case ASCII letters, digits and underscores; no digit first; over-long names end in a hash."""
    name = _ODD.sub("_", source.translate(_UPPER)) or "_"
    if name[0].isdigit():
        name = "_" + name
    return _fit(name, source, bound, False)


def normalize_ident_column(source: Column, bound: int = MAX_NAME) -> Column:
    """``normalize_ident`` as a column."""
    lowered = F.translate(source, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    name = F.regexp_replace(lowered, r"[^a-z0-9_]", "_")
    name = F.when(name == "", "_").when(name.rlike("^[0-9]"), F.concat(F.lit("_"), name)).otherwise(name)
    digits = max(0, min(_HASH, bound - 1))
    short = F.concat(F.substring(name, 1, bound - digits - 1), F.lit("_"), F.substring(F.sha2(source, 256), 1, digits))
    return F.when(F.length(name) <= bound, name).otherwise(short)


def child_table_name(parent: str, field: str, bound: int = MAX_NAME) -> str:
    return normalize_ident(f"{parent}__{field}", bound)


class UniqueNamer:
    """Names for source fields: the first owner of a name keeps it plain, later ones get a hash."""

    def __init__(self, bound: int = MAX_NAME, reserved: tuple[str, ...] = SYSTEM):
        self.bound = bound
        self._owner: dict[str, str | None] = {normalize_ident(r, bound): None for r in reserved}

    def name_for(self, source: str, owner: str | None = None) -> str:
        """The name of a source field; ``owner`` tells apart fields that are spelled alike."""
        owner = source if owner is None else owner
        plain = normalize_ident(source, self.bound)
        name, attempt = plain, 0
        while name in self._owner and self._owner[name] != owner:
            salted = owner if attempt == 0 else f"{owner}\x01{attempt}"
            name, attempt = _fit(plain, salted, self.bound, True), attempt + 1
            if attempt > len(self._owner) + 2:
                raise ValueError(f"no free name for {source!r} within {self.bound} characters")
        self._owner[name] = owner
        return name


def has_control(text: Column) -> Column:
    """Whether a text holds control or invisible code points."""
    return text.rlike(CONTROL_CLASS)
