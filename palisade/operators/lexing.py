"""Code apart from comments and strings, in a file's own row and by built-in functions.

One pattern for each family of languages matches whole tokens (strings of all kinds, comments, escapes) from the left, as a lexer
reads: what opens first decides, so a quote in a comment or a comment's mark in a string is no such thing. Tokens
are marked, the text is cut at the marks, and the views blank some of the pieces, character by character: lines and columns
stay what they were. Repetitions are possessive, so the time is in proportion to the text; what isn't closed goes to the end
of the line or, where it may span lines, of the text.

Not told apart: JavaScript's regular expressions from divisions, and the rest of the line on which a here-document is
opened from its body. The characters U+0001 and U+0002 come out as U+0003.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_BLOCK = r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)"
_LINE = r"//[^\n]*+"
_HASH = r"#[^\n]*+"


def _quoted(q: str, lines: bool = False) -> str:
    """A string with escapes, over one line or several."""
    return rf"{q}(?:[^{q}\\]|\\[\s\S]?)*+(?:{q}|\z)" if lines else rf"{q}(?:[^{q}\\\n]|\\[\s\S]?)*+{q}?"


def _triple(q: str) -> str:
    return rf"{q}{q}{q}(?:[^{q}\\]|\\[\s\S]?|{q}(?!{q}{q}))*+(?:{q}{q}{q}|\z)"


_HEREDOC = r"(?<!<)<<(?!<)-?[ \t]*+(?<q>[\"']?)(?<tag>[A-Za-z_]\w*+)\k<q>[^\n]*+(?:\n(?![ \t]*+\k<tag>[ \t]*+(?:\n|\z))[^\n]*+)*+(?:\n[ \t]*+\k<tag>[ \t]*+(?=\n|\z))?"

#: Strings and comments of a family of languages.
FAMILIES = {
    "python": ("|".join((_triple("'"), _triple('"'), _quoted("'"), _quoted('"'))), _HASH),
    "script": ("|".join((_quoted("`", True), _quoted("'"), _quoted('"'))), f"{_LINE}|{_BLOCK}"),
    "jvm": ("|".join((_triple('"'), _quoted("'"), _quoted('"'))), f"{_LINE}|{_BLOCK}"),
    "c": ("|".join((_quoted("'"), _quoted('"'))), f"{_LINE}|{_BLOCK}"),
    "rust": (_quoted('"', True) + r"|'(?:[^'\\\n]|\\[^\n][^'\n]{0,9})'", f"{_LINE}|{_BLOCK}"),
    "php": ("|".join((_quoted("'", True), _quoted('"', True))), f"{_LINE}|{_HASH}|{_BLOCK}"),
    "ruby": ("|".join((_quoted("'", True), _quoted('"', True))), _HASH),
    "shell": (rf"{_HEREDOC}|'[^']*+(?:'|\z)|{_quoted(chr(34), True)}", rf"(?<![^\s;&|()]){_HASH}"),
    "sql": (r"'(?:[^']|'')*+(?:'|\z)|\"[^\"]*+(?:\"|\z)", rf"--[^\n]*+|{_BLOCK}"),
    "hash": (rf"(?<!\w)'[^'\n]*+'?|(?<!\w){_quoted(chr(34))}", rf"(?<!\S){_HASH}"),
    "markup": (r"(?!)", r"<!--(?:[^-]|-(?!->))*+(?:-->|\z)"),
}
#: Families without escapes in code.
UNESCAPED = ("sql", "hash", "markup")
#: Families by extension: fixed values.
EXTENSIONS = {
    "python": "py", "script": "js jsx mjs cjs ts tsx go", "jvm": "java kt cs", "c": "c h cpp cc hpp", "rust": "rs", "php": "php", "ruby": "rb", "shell": "sh bash zsh", "sql": "sql",
    "hash": "yml yaml toml env properties cfg conf dockerfile", "markup": "html htm xml",
}


def family(path: Column) -> Column:
    """The family of a path by its extension, or null; a Dockerfile or .env counts by its name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    table = F.create_map(*(F.lit(x) for f, all_ in EXTENSIONS.items() for e in all_.split() for x in (e, f)))
    return F.when(name.rlike(r"^(?:dockerfile|\.env)"), "hash").otherwise(F.try_element_at(table, F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)))


def pieces(text: Column, name: str) -> Column:
    """array<struct<code, string, comment, escape>>: the stretches of code and the tokens, in order; in each one field isn't empty."""
    strings, comments = FAMILIES[name]
    clean = F.translate(text, "\x01\x02", "\x03\x03")
    escapes = r"(?!)" if name in UNESCAPED else r"\\[\s\S]"
    marked = F.regexp_replace(clean, rf"(?<s>{strings})|(?<c>{comments})|(?<e>{escapes})", "\x01${s}\x02${c}\x02${e}\x01")
    none = F.lit("")

    def one(p: Column, i: Column) -> Column:
        token = F.split(p, "\x02")
        at = lambda k: F.when(i % 2 == 1, F.element_at(token, k)).otherwise(none)
        return F.struct(F.when(i % 2 == 0, p).otherwise(none).alias("code"), at(1).alias("string"), at(2).alias("comment"), at(3).alias("escape"))

    return F.transform(F.split(marked, "\x01"), one)


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\r\n]", " ")


def _view(text: Column, name: str, shown: tuple[str, ...]) -> Column:
    keep = lambda p, f: p[f] if f in shown else _blank(p[f])
    return F.array_join(F.transform(pieces(text, name), lambda p: F.concat(*(keep(p, f) for f in ("code", "string", "comment", "escape")))), "")


def _by_family(text: Column, which: Column, shown: tuple[str, ...], other: Column) -> Column:
    out = F.when(which.isNull(), other)
    for name in FAMILIES:
        out = out.when(which == name, _view(text, name, shown))
    return out.otherwise(other)


def code(text: Column, which: Column) -> Column:
    """text without comments, positions kept; as it is where the family is null."""
    return _by_family(text, which, ("code", "string", "escape"), text)


def code_without_strings(text: Column, which: Column) -> Column:
    return _by_family(text, which, ("code", "escape"), text)


def comments(text: Column, which: Column) -> Column:
    """Comments alone, positions kept; the whole text where the family is null."""
    return _by_family(text, which, ("comment",), text)


def with_views(files: DataFrame) -> DataFrame:
    """files (path, text) with code_text and comment_text, which rules and suppressions look at."""
    which = family(F.col("path"))
    return files.withColumns({"code_text": code(F.col("text"), which), "comment_text": comments(F.col("text"), which)})
