"""Scalar text functions (Column -> Column), all inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \s is ASCII only; (?U) makes it Unicode, so no-break spaces count too.
OUTER_SPACE = r"(?U)^\s+|\s+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space (any Unicode white space) at both ends; null stays null."""
    return F.regexp_replace(col(c), OUTER_SPACE, "")


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only values; never null."""
    return F.coalesce(strip(c) == "", F.lit(True))


def blank_to_null(c: Column | str) -> Column:
    return F.when(~is_blank(c), col(c))


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone)."""
    return F.unix_micros(col(c).cast("timestamp"))


def strip_chars(c: Column | str, chars: str) -> Column:
    """Without any of these characters at both ends."""
    return F.btrim(col(c), F.lit(chars))


def rstrip_chars(c: Column | str, chars: str) -> Column:
    return F.rtrim(col(c), F.lit(chars))


def lstrip_chars(c: Column | str, chars: str) -> Column:
    """Without any of these characters at the start (a set, not a prefix)."""
    return F.ltrim(col(c), F.lit(chars))


def drop_literals(c: Column | str, *parts: str) -> Column:
    """Every occurrence of the parts removed, then stripped."""
    x = col(c)
    for p in parts:
        x = F.replace(x, F.lit(p), F.lit(""))
    return strip(x)


def slug(c: Column | str) -> Column:
    """Lower case, with everything but a-z, 0-9 and _ - . : as underscores."""
    return F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9_\-.:]", "_")


def drop_prefix(c: Column | str, prefix: str) -> Column:
    x = col(c)
    return F.when(F.startswith(x, F.lit(prefix)), F.substring(x, F.lit(len(prefix) + 1), F.length(x))).otherwise(x)


def ensure_prefix(c: Column | str, prefix: str, empty_for_null: bool = False) -> Column:
    """The prefix put in front where it is missing; blank stays blank."""
    x = strip(c)
    out = F.when((x == "") | F.startswith(x, F.lit(prefix)), x).otherwise(F.concat(F.lit(prefix), x))
    return F.coalesce(out, F.lit("")) if empty_for_null else out


def local_name(c: Column | str) -> Column:
    """What follows the last #, else the last /, else the whole IRI."""
    x = col(c)
    return F.when(x.contains("#"), F.element_at(F.split(x, "#"), -1)).when(x.contains("/"), F.element_at(F.split(x, "/"), -1)).otherwise(x)


def local_fragment(c: Column | str) -> Column:
    """What follows the last #; an IRI without # stays whole."""
    return F.element_at(F.split(col(c), "#"), -1)


def one_line(c: Column | str) -> Column:
    """Line breaks, and tabs, as single blanks."""
    return strip(F.regexp_replace(col(c), r"[\r\n\t]+", " "))


def stitch_to_compound(c: Column | str) -> Column:
    """Flat chemical ids CID1nnnnnnnn as compound numbers, "" for anything else."""
    x = F.upper(strip(c))
    n = F.substring(x, F.lit(5), F.length(x)).try_cast("bigint").cast("string")
    return F.when(F.startswith(x, F.lit("CID1")), F.coalesce(n, F.lit(""))).otherwise(F.lit(""))


def definition_before_last_bracket(c: Column | str) -> Column:
    """The text of `"text" [sources]`: stripped, without the opening quote, cut at the
    last ` [`, without quotes at the end."""
    x = F.regexp_replace(strip(c), r'^"', "")
    return one_line(F.regexp_replace(F.regexp_replace(x, r"(?s) \[(?!.* \[).*$", ""), r'"+$', ""))


def definition_before_first_bracket(c: Column | str) -> Column:
    """As above, cut at the first ` [`; one quote is taken off the end."""
    x = F.substring_index(F.regexp_replace(col(c), r'^"', ""), " [", 1)
    return one_line(F.regexp_replace(x, r'"$', ""))


def first_quoted(c: Column | str) -> Column:
    """The text between the first two double quotes at the start, else ""."""
    return F.coalesce(F.regexp_extract(strip(c), r'(?s)^"(.*?)"', 1), F.lit(""))


def first_token(c: Column | str) -> Column:
    return F.regexp_extract(strip(c), r"^(\S+)", 1)


def before(c: Column | str, mark: str) -> Column:
    return strip(F.substring_index(col(c), mark, 1))


def tag_block(c: Column | str, tag: str, most: int = 2000) -> Column:
    """Text inside the first <tag>...</tag>, stripped and cut to ``most`` characters; null without."""
    inner = F.regexp_extract(col(c), rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(col(c).rlike(rf"(?s)<{tag}>.*?</{tag}>"), F.left(strip(inner), F.lit(most)))


def without_ansi(c: Column | str) -> Column:
    """Without the escape sequences that set colours and styles."""
    return F.regexp_replace(col(c), r"\x1B\[[0-9;]*m", "")


def normalize_na(c: Column | str, tokens: tuple[str, ...] = ("", "NA", "N/A", "NULL", "null", "None", "nan", "NaN")) -> Column:
    """Null for the stand-ins that a reader of delimited text takes as missing."""
    x = col(c)
    return F.when(x.isin(list(tokens)), None).otherwise(x)


def starts_with_any(c: Column | str, prefixes: list[str]) -> Column:
    x, out = col(c), F.lit(False)
    for p in prefixes:
        out = out | F.startswith(x, F.lit(p))
    return F.coalesce(out, F.lit(False))


def contains_ci(c: Column | str, part: str) -> Column:
    """Substring test without case; null is false."""
    return F.coalesce(F.lower(col(c)).contains(part.lower()), F.lit(False))


#: The shapes of identifiers.
IDENTIFIER_PATTERNS = {
    "xrefNcbiGene": r"\d+", "xrefHGNC": r"HGNC:\d+", "xrefEnsembl": r"ENSG\d+", "xrefUmlsCUI": r"C\d{7}", "xrefDiseaseOntology": r"DOID:\d+",
    "xrefDrugbank": r"DB\d{5}", "xrefMeSH": r"(D|C)\d+", "xrefDTXSID": r"DTXSID\d+", "xrefOMIM": r"\d+(\.\d+)?", "xrefUberon": r"UBERON:\d+",
}
NUMERIC = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def matches_identifier(c: Column | str, kind: str) -> Column:
    return F.coalesce(col(c).rlike(f"^(?:{IDENTIFIER_PATTERNS[kind]})$"), F.lit(False))
