"""Arrays, maps and packed texts (Column -> Column)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import col, strip


def split_list(c: Column | str, delimiter: str = "|") -> Column:
    """Stripped, non-empty parts; null gives an empty array."""
    parts = F.split(F.coalesce(col(c), F.lit("")), re.escape(delimiter))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def split_entries(c: Column | str, outer: str = "|", inner: str = "^", least: int = 1) -> Column:
    """array<array<string>>: entries, blank ones left out, of at least ``least`` stripped parts."""
    entries = F.filter(F.split(F.coalesce(col(c), F.lit("")), re.escape(outer)), lambda x: strip(x) != "")
    return F.filter(F.transform(entries, lambda e: F.transform(F.split(e, re.escape(inner)), strip)), lambda p: F.size(p) >= least)


def key_values(c: Column | str, outer: str = "|", inner: str = ":") -> Column:
    """map<string, string> of key:value entries cut at the first ``inner``; the last entry of
    a key wins; entries without ``inner`` or without key, and "-" for missing, are left out."""
    x = strip(c)
    return entry_map(split_list(F.when(x != "-", x), outer), inner)


def entry_map(entries: Column, inner: str = ":") -> Column:
    """key_values of entries that are parted already."""
    entries = F.filter(entries, lambda e: F.instr(e, inner) > 1)
    pairs = F.transform(entries, lambda e: F.struct(strip(F.substring_index(e, inner, 1)).alias("key"), strip(F.substring(e, F.instr(e, inner) + len(inner), F.length(e))).alias("value")))
    pairs = F.filter(pairs, lambda p: p["key"] != "")
    return last_wins(pairs)


def last_wins(pairs: Column) -> Column:
    """map of array<struct<key, value>> in which later entries replace earlier ones,
    whatever spark.sql.mapKeyDedupPolicy is."""
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(kept)


def first_wins(pairs: Column) -> Column:
    kept = F.filter(pairs, lambda p, i: (i == 0) | ~F.exists(F.slice(pairs, F.lit(1), F.greatest(i, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(kept)


def with_prefix(xs: Column | str, prefix: str, keep_prefix: bool = False, ignore_case: bool = False) -> Column:
    """Elements that start with the prefix, without it unless kept."""
    test = (lambda x: F.startswith(F.upper(x), F.lit(prefix.upper()))) if ignore_case else (lambda x: F.startswith(x, F.lit(prefix)))
    out = F.filter(col(xs), test)
    return out if keep_prefix else F.transform(out, lambda x: F.substring(x, F.lit(len(prefix) + 1), F.length(x)))


def either(a: Column, b: Column) -> Column:
    """a, or b where a is empty or null."""
    return F.when(F.coalesce(F.size(a), F.lit(0)) > 0, a).otherwise(b)


def first_or_empty(xs: Column) -> Column:
    return F.coalesce(F.try_element_at(xs, F.lit(1)), F.lit(""))


def joined_or_null(xs: Column | str, sep: str = "; ") -> Column:
    return F.nullif(F.array_join(col(xs), sep), F.lit(""))


def parents(entries: Column | str, prefix: str, relation: str = "") -> Column:
    """Ids of parent entries (`ID ! name`, or `relation ID ! name`) with this prefix, joined by |."""
    xs = with_prefix(entries, relation + " ") if relation else col(entries)
    ids = F.transform(xs, lambda x: F.regexp_extract(strip(x), r"^(\S+)", 1))
    return F.array_join(F.filter(ids, lambda x: F.startswith(x, F.lit(prefix))), "|")


def synonym_texts(entries: Column | str) -> Column:
    """The quoted texts of OBO synonym entries, joined by |; entries that are not of
    the form `"text" TYPE` give what precedes their next quote."""
    def one(x: Column) -> Column:
        quoted = F.regexp_extract(x, r'(?s)^"(.*?)"\s+\w', 1)
        return F.when(quoted != "", quoted).otherwise(F.substring_index(F.btrim(x, F.lit('"')), '"', 1))

    return F.array_join(F.filter(F.transform(F.coalesce(col(entries), F.array().cast("array<string>")), one), lambda x: x != ""), "|")


def overlaps(xs: Column | str, values: list[str]) -> Column:
    """Whether an array shares an element with the list; false for null arrays."""
    return F.coalesce(F.arrays_overlap(col(xs), F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")), F.lit(False))


def tagged(xs: Column | str, include: str, exclude: list[str]) -> Column:
    """Whether an array holds the one tag and none of the others; false for null arrays."""
    return F.coalesce(F.array_contains(col(xs), include), F.lit(False)) & ~overlaps(xs, exclude)


def ordered_union(*arrays: Column | str) -> Column:
    """The elements of all arrays in order, each once; null arrays add nothing."""
    return F.array_distinct(F.concat(*[F.coalesce(col(a), F.array().cast("array<string>")) for a in arrays]))
