"""Identifiers, symbols, paths and commits: canonical forms and extraction, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier fields, patterns and words that are no commit.
FIELDS = ("serial_number", "mac_address", "protocol_number", "commit_sha", "file_path", "folder_path", "file_name", "ticket_number", "issue_id")
MAC = r"\b([0-9a-fA-F]{2}[:\-][0-9a-fA-F]{2}[:\-][0-9a-fA-F]{2}[:\-][0-9a-fA-F]{2}[:\-][0-9a-fA-F]{2}[:\-][0-9a-fA-F]{2})\b"
MAC_LOOSE = r"\b([0-9a-fA-F]{12})\b"
COMMIT = r"\b([0-9a-fA-F]{8,40})\b"
SERIAL = r"(?i)\b(serial|sn|serie)\s*[:\-]?\s*([A-Za-z0-9\-]{3,})\b"
PROTOCOL = r"(?i)\b(protocolo|protocol|patente)\s*[:\-]?\s*([0-9A-Za-z\-./]{3,})"
TICKET = r"(?i)\b(?:ticket|chamado|issue)\s*[:\-]?\s*#?(\d+)\b"
PATH = r"([A-Za-z]:[\\/][^ \t]+|/[A-Za-z][^ \t]+|\b[\w\-./]+\.[a-z]{1,6}\b)"
NO_COMMIT = ("ffffff", "0000000", "aaaaaaa", "abcd123", "1234567", "deadbeef")
TICKET_WORDS = ("ticket", "chamado", "issue", "protocolo")


def hex_only(v: Column) -> Column:
    return F.lower(F.regexp_replace(v, "[^0-9a-fA-F]", ""))


def alnum_upper(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, "[^0-9A-Za-z]", ""))


def path(v: Column) -> Column:
    """``D:\\a\\b/`` -> ``/d/a/b``; slashes collapsed, one in front, none behind."""
    v = F.regexp_replace(F.trim(v), r"[\\/]+", "/")
    drive = F.regexp_extract(v, "^([A-Za-z]):/", 1)
    rooted = F.when(drive != "", F.concat(F.lit("/"), F.lower(drive), F.lit("/"), F.substr(v, F.lit(4)))).when(F.startswith(v, F.lit("/")), v).otherwise(F.concat(F.lit("/"), v))
    return F.when(rooted == "/", rooted).otherwise(F.regexp_replace(rooted, "/$", ""))


def file_name(v: Column) -> Column:
    return F.lower(F.element_at(F.split(F.replace(v, F.lit("\\"), F.lit("/")), "/"), -1))


def ticket(v: Column) -> Column:
    run = F.regexp_extract(F.trim(v), r"(\d+)$", 1)
    return F.when(run != "", run).otherwise(F.regexp_replace(v, "[^0-9A-Za-z]", ""))


def identifier(field: Column, v: Column) -> Column:
    """The canonical form of a value of a field; other fields are trimmed, spaces collapsed, lower-cased."""
    return (
        F.when(field.isin("mac_address", "commit_sha"), hex_only(v)).when(field.isin("serial_number", "protocol_number"), alnum_upper(v))
        .when(field.isin("file_path", "folder_path"), path(v)).when(field == "file_name", file_name(v)).when(field.isin("ticket_number", "issue_id"), ticket(v))
        .otherwise(F.lower(F.regexp_replace(F.trim(v), r"\s+", " ")))
    )


def hints(text: Column) -> Column:
    """Array of (field, raw) found in a text, each distinct."""

    def found(field: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda r: F.struct(F.lit(field).alias("field"), r.alias("raw")))

    commits = F.filter(found("commit_sha", COMMIT, 1), lambda h: ~F.lower(h["raw"]).isin(*NO_COMMIT))
    hinted = F.lit(False)
    for w in TICKET_WORDS:
        hinted = hinted | F.contains(F.lower(text), F.lit(w))
    none = F.array().cast("array<struct<field:string,raw:string>>")
    tickets = F.when(hinted, found("ticket_number", TICKET, 1)).otherwise(none)
    parts = [found("mac_address", MAC, 1), commits, found("serial_number", SERIAL, 2), found("protocol_number", PROTOCOL, 2), found("mac_address", MAC_LOOSE, 1), tickets, found("file_path", "(?U)" + PATH, 1)]
    return F.array_distinct(F.concat(*[F.coalesce(p, none) for p in parts]))


def symbol_forms(v: Column) -> Column:
    """All forms under which a software symbol is matched."""
    split = F.regexp_replace(F.regexp_replace(v, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.lower(F.trim(F.regexp_replace(split, r"[._\-/\\]+", " ")))
    low, slashed = F.lower(v), F.replace(v, F.lit("\\"), F.lit("/"))
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    dotted, has_slash = F.contains(v, F.lit(".")), F.contains(slashed, F.lit("/"))
    forms = [v, low, *[F.when(words != "", f) for f in (words, swap(words, " ", "_"), swap(words, " ", "-"), swap(words, " ", ""))]]
    forms += [F.when(dotted, swap(low, ".", x)) for x in ("_", " ", "/")] + [F.when(has_slash, f) for f in (slashed, F.lower(slashed), swap(F.lower(slashed), "/", "."))]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*forms))))


def cli_option(v: Column) -> Column:
    return F.lower(F.replace(F.regexp_replace(F.trim(v), "^-+", ""), F.lit("-"), F.lit("_")))


def symbols_match(a: Column, b: Column) -> Column:
    """Whether two symbols have a form in common."""
    return F.arrays_overlap(symbol_forms(a), symbol_forms(b))


def cli_options_match(a: Column, b: Column) -> Column:
    return cli_option(a) == cli_option(b)


def paths_match(q: Column, s: Column) -> Column:
    """Equal paths, equal file names, or one the end of the other."""
    a, b = F.lower(path(q)), F.lower(path(s))
    return (a == b) | ((file_name(q) != "") & (file_name(q) == file_name(s))) | F.endswith(a, b) | F.endswith(b, a)


def commit_prefix(text: Column) -> Column:
    """7 to 40 hex digits after ``commit`` or ``sha``, else the first standalone ones that aren't digits alone; null without any."""
    named = F.lower(F.regexp_extract(text, r"(?i)\b(?:commit|sha)\s+([0-9a-f]{7,40})\b", 1))
    first = F.lower(F.regexp_extract(text, r"\b([0-9a-fA-F]{7,40})\b", 1))
    return F.when(named != "", named).when((first != "") & ~F.rlike(first, F.lit("^[0-9]+$")), first)


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
