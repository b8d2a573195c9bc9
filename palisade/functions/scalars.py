"""Scalar functions over strings, arrays and hashes; all of them Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEPARATOR = "\x1f"
#: Token formats that are always secret: fixed values of public formats.
TOKEN_FORMATS = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"sk-[A-Za-z0-9_-]{16,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
    r"glpat-[A-Za-z0-9_-]{16,}",
    r"npm_[A-Za-z0-9]{30,}",
)
#: Quoted right sides of secret names, in either case and with either quote.
NAMED_SECRET = r"(?i)(?:secret|token|passw(?:or)?d|api_?key|credential)\w*\s*[:=]\s*[\"']([^\"']{8,})[\"']"
MASK = "****"


def digest(length: int, *parts: Column | str) -> Column:
    """The first hex digits of SHA-256 over the parts, joined by the unit separator; nulls are empty."""
    columns = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *columns), 256), 1, length)


def shape(text: Column) -> Column:
    """A line without what doesn't matter: white space runs are one space, ends are cut."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def limit(text: Column, size: int) -> Column:
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.left(text, F.lit(size - 1)), F.lit("…")))


def mask_secrets(text: Column) -> Column:
    """Quoted bodies, values of assignments, and runs of twenty token characters or more become the mask."""
    out = F.regexp_replace(text, r"\"[^\"]*\"", f'"{MASK}"')
    out = F.regexp_replace(out, r"'[^']*'", f"'{MASK}'")
    out = F.regexp_replace(out, r"([A-Za-z_][A-Za-z0-9_]*\s*=\s*)[^\s\"'*]+", rf"$1{MASK}")
    return F.regexp_replace(out, r"[A-Za-z0-9_+/-]{20,}", MASK)


def secret_values(line: Column, named: str = NAMED_SECRET, formats: tuple = TOKEN_FORMATS) -> Column:
    """Candidate secret values of a line: the first group of `named`, and what has one of the token formats."""
    found = F.regexp_extract_all(line, F.lit(named), F.lit(1))
    if formats:
        found = F.concat(found, F.regexp_extract_all(line, F.lit("(" + "|".join(formats) + ")"), F.lit(1)))
    return F.array_distinct(found)


def redact(text: Column, secrets: Column) -> Column:
    """Known secrets first, the longest before the others, then token formats, URL credentials and authorisation headers."""
    longest = F.reverse(F.array_sort(F.transform(secrets, lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))))
    out = F.aggregate(longest, text, lambda acc, s: F.replace(acc, s["s"], F.lit(MASK)))
    for pattern in TOKEN_FORMATS:
        out = F.regexp_replace(out, pattern, MASK)
    out = F.regexp_replace(out, r"(?<=://)[^/\s:@]+:[^/\s@]+(?=@)", MASK)
    return F.regexp_replace(out, r"(?i)(authorization\s*[:=]\s*(?:bearer|basic)\s+)\S+", rf"$1{MASK}")


def one_edit_apart(a: Column, b: Column) -> Column:
    """Optimal string alignment distance of exactly one: a substitution, insertion, deletion or adjacent swap."""
    same = F.length(a) == F.length(b)
    places = F.sequence(F.lit(1), F.length(a) - 1)

    def swapped(i: Column) -> Column:
        return F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b

    return (F.levenshtein(a, b) == 1) | (same & (F.length(a) > 1) & (F.levenshtein(a, b) == 2) & F.exists(places, swapped))


def name_tokens(name: Column) -> Column:
    """A camel or snake case name in lower-case parts."""
    parts = F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+")
    return F.filter(parts, lambda p: p != "")


def version(text: Column) -> Column:
    """The numbers of a version; arrays order as versions do."""
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))


def hidden_characters(text: Column) -> Column:
    """Classes of code points that a reader can't see: tag, bidi, zero_width. Sorted, without repeats."""
    found = F.array(
        F.when(text.rlike(r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"), "bidi"),
        F.when(text.rlike(r"[\x{E0000}-\x{E007F}]") & ~text.rlike(r"^[^\x{E0000}-\x{E007F}]*\x{1F3F4}[\x{E0000}-\x{E007F}]+[^\x{E0000}-\x{E007F}]*$"), "tag"),
        F.when(text.rlike(r"[\x{200B}\x{2060}\x{FEFF}]"), "zero_width"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def encoded_text(text: Column, least: int = 200) -> Column:
    """What a run of base64 of `least` characters or more decodes to, if nine tenths of it are printable; else null."""
    run = F.regexp_extract(text, rf"[A-Za-z0-9+/]{{{least},}}={{0,2}}", 0)
    plain = F.try_validate_utf8(F.try_to_binary(F.rpad(run, F.ceil(F.length(run) / 4).cast("int") * 4, F.lit("=")), F.lit("base64")).cast("string"))
    return F.when((run != "") & (F.regexp_count(plain, F.lit(r"[\x20-\x7E\n\t]")) >= 0.9 * F.length(plain)), plain)


def ratio(part: Column, whole: Column) -> Column:
    """Null, not zero, when there is nothing to take a part of."""
    return F.when(whole > 0, part / whole)
