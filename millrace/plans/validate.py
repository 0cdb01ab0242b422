"""Checks of a pipeline before anything runs."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from millrace.functions import naming as N
from millrace.operators.lower import Capabilities
from millrace.sources.base import StreamSpec

MIN_NAME, MAX_BOUND, MAX_STREAM_NAME, MAX_STREAMS, MAX_READERS = 8, 4096, 1024, 10_000, 1024


class ConfigError(ValueError):
    """A pipeline that can't run as declared."""


def validate(streams: Sequence[StreamSpec], modes: dict[str, tuple[str, tuple[str, ...]]], capabilities: Capabilities, workdir: str | None = None, readers: int = 16) -> dict[str, str]:
    """Names of the root tables by stream; raises on the first rule that is broken.

    ``modes``: of each stream its mode and merge key.
    """
    if not MIN_NAME <= capabilities.max_name <= MAX_BOUND:
        raise ConfigError(f"names may have {MIN_NAME} to {MAX_BOUND} characters, not {capabilities.max_name}")
    if len(streams) > MAX_STREAMS or not 1 <= readers <= MAX_READERS:
        raise ConfigError("too many streams or readers")
    if capabilities.requires_durable_identity and not workdir:
        raise ConfigError("this destination needs a working directory, so that a load keeps its identity")
    roots: dict[str, str] = {}
    for s in streams:
        if not s.name or len(s.name.encode()) > MAX_STREAM_NAME:
            raise ConfigError("streams have names of at most 1024 bytes")
        table = N.normalize_ident(s.name, capabilities.max_name)
        if table in roots:
            raise ConfigError(f"streams {roots[table]!r} and {s.name!r} share the table {table}")
        roots[table] = s.name
        mode, key = modes.get(s.name, ("append", ()))
        if mode not in ("append", "replace", "merge"):
            raise ConfigError(f"unknown mode {mode!r} of {s.name!r}")
        if mode == "merge":
            if not capabilities.merge:
                raise ConfigError(f"the destination can't merge {s.name!r}")
            if not key:
                raise ConfigError(f"merging {s.name!r} needs a key")
            if set(key) != set(s.primary_key):
                raise ConfigError(f"the merge key of {s.name!r} is {sorted(key)}, its primary key {sorted(s.primary_key)}: they must be the same columns")
        for column, t in s.type_hints.items():
            if t.name == "decimal" and not (1 <= t.precision <= 38 and 0 <= t.scale <= t.precision):
                raise ConfigError(f"the hint of {s.name}.{column} is no decimal")
    for a in roots:
        for b in roots:
            if a != b and b.startswith(f"{a}__"):
                raise ConfigError(f"table {b} looks like a child of {a}")
    kinds = {s.cursor_field is None for s in streams}
    if len(kinds) > 1:
        warnings.warn("some streams resume by cursor and others are read whole each time", stacklevel=2)
    return {name: table for table, name in roots.items()}
