"""Names and object paths as SQL expression text."""

from __future__ import annotations

# Characters and folder names an object path must not contain,
# and the suffixes a copied document gets.
_PART = r'[^\\\\.:*?"<>|\r\n/]+'
_HIDDEN = ("__externalactors__", "__externalobjects__")
_COPY = " — (?:copy|копия)"


def visible_folder(path: str) -> str:
    """``/Game`` or a folder below it without forbidden characters or system folders."""
    hidden = ", ".join(f"'{h}'" for h in _HIDDEN)
    return (f"(({path}) RLIKE '^/Game(/{_PART})*$' AND NOT exists(split(lower({path}), '/'), p -> p IN ({hidden})))")


def valid_object_path(path: str) -> str:
    """``/Game/.../Name.Name`` below a visible folder."""
    package = f"regexp_replace({path}, '[.][^.]*$', '')"
    return (f"(({path}) RLIKE '^.+/[^/.]+[.][^/.]+$' AND regexp_extract({path}, '([^/.]+)[.][^/.]+$', 1) = "
            f"regexp_extract({path}, '[.]([^/.]+)$', 1) AND {visible_folder(package)})")


def display_name(name: str, ext: str) -> str:
    """Drop the extension once, even in front of repeated copy suffixes."""
    tail = f"regexp_extract({name}, '((?:{_COPY})*)$', 1)"
    stem = f"left({name}, length({name}) - length({tail}))"
    return (f"(CASE WHEN length({ext}) > 0 AND length({stem}) > length({ext}) AND lower(right({stem}, length({ext}))) = lower({ext}) "
            f"THEN concat(left({stem}, length({stem}) - length({ext})), {tail}) ELSE {name} END)")


def safe_asset_name(name: str, asset_id: str, kind: str) -> str:
    """Asset name of letters, digits and underscores, at most 20 characters of stem."""
    stem = f"regexp_replace(regexp_extract({name}, '([^/\\\\\\\\]*)$', 1), '[.][^.]*$', '')"
    clean = f"trim(BOTH '_' FROM regexp_replace({stem}, '[^A-Za-z0-9_]+', '_'))"
    lead = f"(CASE WHEN {clean} RLIKE '^[A-Za-z]' THEN {clean} ELSE concat('Image_', {clean}) END)"
    short = f"(CASE WHEN length({lead}) > 20 THEN trim(TRAILING '_' FROM left({lead}, 20)) ELSE {lead} END)"
    return f"concat('T_', {short}, '_', {asset_id}, CASE WHEN {kind} = 'color' THEN '' ELSE concat('_', {kind}) END)"
