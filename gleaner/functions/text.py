"""Column functions over text: lines, tokens, identifiers, byte ranges, content types.

Offsets are bytes and lines are counted from 1 throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS: dict[str, tuple[str, ...]] = {
    "Code": tuple("bash c cpp cs go h hpp java js jsx kt lua php pl py r rb rs scala sh swift ts tsx zig zsh".split()),
    "Prose": tuple("adoc md org rst tex txt".split()),
    "Config": tuple("cfg conf env ini json properties toml yaml yml".split()),
    "Log": ("log",),
}
#: In order: of content types with equal counts the later one dominates.
CONTENT_TYPES = ("Code", "Prose", "Config", "Log", "Mixed", "Unknown")


def content_type(path: Column) -> Column:
    """By the extension of the last path segment, whatever its case; never Mixed."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit("Unknown")
    for name, exts in reversed(EXTENSIONS.items()):
        out = F.when(ext.isin(*exts), F.lit(name)).otherwise(out)
    return out


def lines(content: Column) -> Column:
    """All lines; a final line break is followed by an empty one."""
    return F.split(content, "\n", -1)


def line_start(content: Column, index: Column) -> Column:
    """Byte at which the line with this index, from 0, starts."""
    return F.when(index == 0, F.lit(0)).otherwise(F.octet_length(F.call_function("substring_index", content, F.lit("\n"), index)) + 1).cast("long")


def matching_lines(content: Column, matches: "callable") -> Column:
    """``array<struct<line_index, line, byte_start>>`` of the lines for which ``matches`` holds.
    Offsets are counted for these lines only, and no line is exploded before it has matched."""
    numbered = F.transform(lines(content), lambda line, k: F.struct(k.alias("line_index"), line.alias("line")))
    hits = F.filter(numbered, lambda x: matches(x["line"]))
    return F.transform(hits, lambda x: F.struct(x["line_index"].alias("line_index"), F.regexp_replace(x["line"], "\r$", "").alias("line"), F.octet_length(x["line"]).cast("long").alias("bytes")))


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    return F.substring(F.encode(content, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def body_tokens(text: Column) -> Column:
    """Lowercased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def ident_tokens(text: Column) -> Column:
    """Lowercased runs of the letters of identifiers and paths."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\w:./\\-]+"), F.lit(0)), lambda t: F.lower(t))


def subtokens(token: Column) -> Column:
    """Parts between separators and where a small letter meets a capital one, lowercased."""
    cut = F.regexp_replace(token, r"([a-z])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(cut), r"[_\-.:/\\]"), lambda t: t != "")


def subtoken_text(text: Column) -> Column:
    """Of each word: itself lowercased, then its subtokens."""
    words = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9_:.]+|[^A-Za-z0-9_:.]+$", ""))
    return F.flatten(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.array(F.lower(w)), subtokens(w))))


def use_dense(query: Column) -> Column:
    """Whether a query is worth a dense search: two words or more, one of them longer than four
    bytes; or a separator, two words and one of three bytes or more."""
    words = F.filter(F.split(F.regexp_replace(query, r"[^\p{L}\p{N}]", " "), r"\s+"), lambda w: w != "")
    two = F.size(words) >= 2
    long = F.exists(words, lambda w: F.octet_length(w) > 4)
    mid = F.exists(words, lambda w: F.octet_length(w) >= 3)
    return (two & long) | (query.rlike(r"[:._/\-]") & two & mid)


def snippet_of_range(content: Column, line_start: Column, line_end: Column, fallback: Column) -> Column:
    """The lines of a range; of more than three the first that isn't blank; the fallback if blank."""
    part = F.slice(lines(content), F.greatest(line_start, F.lit(1)), F.greatest(line_end - line_start + 1, F.lit(0)))
    first = F.get(F.filter(part, lambda x: F.trim(x) != ""), F.lit(0))
    text = F.when(F.size(part) > 3, F.coalesce(first, F.lit(""))).otherwise(F.array_join(part, "\n"))
    return F.when(F.trim(text) == "", fallback).otherwise(text)


def context_lines(content: Column, line_start: Column, line_end: Column, around: int) -> Column:
    """The lines of a range with so many before and after, as far as there are."""
    first = F.greatest(line_start - around, F.lit(1))
    return F.array_join(F.slice(lines(content), first, line_end + around - first + 1), "\n")
