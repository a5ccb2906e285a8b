"""Column expressions over names and paths. All are built-in functions, so they stay within generated code."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLASH = "\\"


def ascii_lower(x: Column) -> Column:
    """Case folding of A to Z alone."""
    return F.translate(x, UPPER, LOWER)


def file_stem(name: Column) -> Column:
    """What stands before the last dot; names without one, or with only a leading one, are whole."""
    stem = F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)
    return F.when(stem == "", name).otherwise(stem)


def extension(name: Column, is_directory: Column) -> Column:
    ext = F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)
    return F.when(~is_directory & (ext != ""), ext)


def parent_path(path: Column) -> Column:
    """The path up to its last separator; a drive root keeps its own. None above a root."""
    up = F.regexp_extract(path, r"(?s)^(.*)[\\/][^\\/]+[\\/]?$", 1)
    return F.when(up.rlike("^[A-Za-z]:$"), F.concat(up, F.lit(SLASH))).when(up != "", up)


def ancestor_paths(path: Column) -> Column:
    """All proper ancestors below the root, from the top down."""
    parts = F.split(path, r"[\\/]")
    n = F.size(parts)
    return F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), SLASH))).otherwise(F.array().cast("array<string>"))


def drive_letter(path: Column) -> Column:
    letter = F.upper(F.regexp_extract(path, "^([A-Za-z]):", 1))
    return F.when(letter != "", letter)


def _unextended(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\\\\\"), r"^\\\\\?\\", "")


def normalize_extended(path: Column) -> Column:
    return F.lower(_unextended(path))


def volume_prefix(path: Column) -> Column:
    """Lower-case server and share, or drive with colon; none for other paths."""
    p = F.regexp_replace(path, r"^\\\\\?\\", "")
    share = F.regexp_extract(p, r"^(\\\\[^\\]+\\[^\\]+)", 1)
    drive = F.regexp_extract(p, r"^([A-Za-z]:)", 1)
    return F.when(share != "", F.lower(share)).when(p.startswith("\\\\"), None).when(drive != "", F.lower(drive))


def volume_key(path: Column) -> Column:
    """Server and share as they are, upper-case drive, mounted volume, root, or UNKNOWN."""
    share = F.regexp_extract(path, r"^(\\\\[^\\]+\\[^\\]+)", 1)
    mounted = F.regexp_extract(path, "^(/Volumes/[^/]+)", 1)
    return (F.when(share != "", share).when(path.startswith("\\\\"), path).when(path.rlike("^[A-Za-z]:"), F.upper(F.substring(path, 1, 2))).when(mounted != "", mounted).when(path.startswith("/"), "/").otherwise("UNKNOWN"))


def classify_path(path: Column, mapped: Column | None = None) -> Column:
    """`mapped`: whether the path's drive is a network one."""
    return F.when(path.startswith("\\\\"), "unc").when(F.lit(False) if mapped is None else mapped, "mapped_network").when(path.rlike(r"^[A-Za-z]:[\\/]?$"), "drive_root").otherwise("local")


def format_size(size: Column) -> Column:
    """Binary units with two decimals, ties to even."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(size >= 1024**power, F.format_string(f"%.2f {unit}", F.bround(size / float(1024**power), 2))).otherwise(out)
    return out


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def volume_type_norm(kind: Column) -> Column:
    k = F.lower(kind)
    return F.when(k.isin("ntfs", "network", "removable"), k).otherwise("local")


def volume_type_label(kind: Column) -> Column:
    k = volume_type_norm(kind)
    return F.when(k == "ntfs", "NTFS").when(k == "network", "Network").when(k == "removable", "Removable").otherwise("Local")


def mount_label(mount: Column, label: Column) -> Column:
    return F.concat_ws(" ", mount, F.when(label != "", label))


def file_uri(path: Column) -> Column:
    """file: URI with every byte outside the unreserved ones and / : @ ! $ & ~ percent-encoded."""
    p = F.translate(path, SLASH, "/")
    out = F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for code, char in (("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%21", "!"), ("%24", "$"), ("%26", "&"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.when(p.startswith("//"), F.concat(F.lit("file:"), out)).when(p.startswith("/"), F.concat(F.lit("file://"), out)).otherwise(F.concat(F.lit("file:///"), out))


def highlight_name(name: Column, patterns: list[str], before: str = "[", after: str = "]") -> Column:
    """Marks all places of the patterns, each letter in any case; places that touch or overlap are one.

    One expression finds runs of covered letters: a letter of a pattern is covered where the pattern's rest is before and after
    it. Runs are taken without going back, so a long one is no deep recursion."""
    covered = dict.fromkeys(cell for p in patterns for cell in _covered([_any_case(c) for c in p]))
    if not covered:
        return name
    left, right = (re.sub(r"([\\$])", r"\\\1", mark) for mark in (before, after))
    return F.regexp_replace(name, f"(?:{'|'.join(covered)})++", f"{left}$0{right}")


def _covered(letters: list[str]) -> list[str]:
    """Of a pattern's letters as classes, each between what comes before and after it."""
    behind, ahead = (lambda s: f"(?<={s})" if s else ""), (lambda s: f"(?={s})" if s else "")
    return [f"{behind(''.join(letters[:i]))}{letters[i]}{ahead(''.join(letters[i + 1 :]))}" for i in range(len(letters))]


def _any_case(letter: str) -> str:
    """A class of the letters that have the same lower case."""
    low = letter.lower()
    alike = _uppers().get(low, "") + low if len(low) == 1 else letter
    return f"[{''.join(f'\\x{{{ord(c):x}}}' for c in dict.fromkeys(alike))}]"


@cache
def _uppers() -> dict[str, str]:
    """Letters by what they become in lower case, where that is another one."""
    found = {}
    for c in map(chr, range(0x20000)):
        if c.lower() != c:
            found[c.lower()] = found.get(c.lower(), "") + c
    return found


#: Change flags (fixed values of the journal's format).
CREATE, DELETE, RENAME_OLD, RENAME_NEW, MODIFY, CLOSE = 0x100, 0x200, 0x1000, 0x2000, 0x7, 0x80000000


def has_flag(reason: Column, flag: int) -> Column:
    return reason.bitwiseAND(F.lit(flag).cast("long")) != 0


def event_kind(reason: Column) -> Column:
    return F.when(has_flag(reason, CREATE), "created").when(has_flag(reason, DELETE), "deleted").when(has_flag(reason, RENAME_NEW), "created").when(has_flag(reason, MODIFY), "modified")


def clamp_size(size: Column) -> Column:
    return F.greatest(size, F.lit(0))


def known_time(seconds: Column) -> Column:
    return F.when(seconds >= 0, F.timestamp_seconds(seconds))
