"""Column functions on texts and paths; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sha256_hex(c: Column) -> Column:
    """Lower-case SHA-256 of bytes, or of a text's UTF-8."""
    return F.sha2(c, 256)


def short_id(c: Column) -> Column:
    """The first seven characters of a revision's id."""
    return F.substring(c, 1, 7)


def utf16_length(c: Column) -> Column:
    """Code units, of which a character beyond the basic plane has two."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def token_estimate(c: Column) -> Column:
    """A quarter of the code units, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(utf16_length(c) / 4))


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def glob_regex(glob: str) -> str:
    """A path pattern as a regular expression: ``*`` stays inside a segment, ``**`` spans any number of them. Case doesn't matter."""
    parts = [p for p in glob.replace("\\", "/").split("/") if p not in ("", ".")]
    if glob.endswith("/"):
        parts.append("**")
    out = []
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            out.append(".+" if last else "(?:[^/]+/)*")
        else:
            out.append("".join("[^/]*" if x == "*" else re.escape(x) for x in re.split(r"(\*)", part) if x) + ("" if last else "/"))
    return "(?i)^" + "".join(out) + "$"


def combined_glob(source_path: str, include: str) -> str:
    return source_path.rstrip("/\\") + "/" + include.lstrip("/\\")


def whole_word(term: Column, case_sensitive: Column) -> Column:
    """Pattern of a term with word boundaries around it."""
    return F.concat(F.when(case_sensitive, r"(?U)\b\Q").otherwise(r"(?iuU)\b\Q"), term, F.lit(r"\E\b"))


def word_start(term: Column, case_sensitive: Column) -> Column:
    """Pattern of a term with a boundary before it only, as endings may be glued on."""
    return F.concat(F.when(case_sensitive, r"(?U)\b\Q").otherwise(r"(?iuU)\b\Q"), term, F.lit(r"\E"))


def annotation(c: Column) -> Column:
    """A message safe in a workflow log line: percent, carriage return and line feed escaped, in this order."""
    escaped = F.replace(c, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(escaped, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
