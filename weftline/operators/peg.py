"""Values packed in one field, split by a parsing expression grammar.

A grammar is built from the expressions below: characters, sequences, ordered
choices, repetitions and look-ahead. Choices are ordered and repetitions take
all they can, and neither is tried again once it has succeeded: that is what
sets a parsing expression apart from a regular one. Java patterns can say
exactly that with atomic groups and possessive quantifiers, so a grammar
without recursion compiles to one pattern and parsing stays inside the JVM.

``split_values`` reads a text from left to right with the ordered alternatives
quoted / bracketed / bare, or with a form of its own (an identifier): a quote or
bracket that is not closed makes its alternative fail, and the reading goes back
to the opening mark, which then only separates and is flagged.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import OUTER_SPACE


@dataclass(frozen=True)
class Expr:
    """A parsing expression, held as the Java pattern that matches the same."""

    pattern: str

    def __add__(self, other: Expr) -> Expr:
        return Expr(self.pattern + other.pattern)

    def __or__(self, other: Expr) -> Expr:
        return Expr(f"(?>{self.pattern}|{other.pattern})")

    def many(self) -> Expr:
        return Expr(f"(?>{self.pattern})*+")

    def some(self) -> Expr:
        return Expr(f"(?>{self.pattern})++")

    def times(self, n: int) -> Expr:
        return Expr(f"(?>{self.pattern}){{{n}}}")

    def maybe(self) -> Expr:
        return Expr(f"(?>{self.pattern})?+")


def text(s: str) -> Expr:
    return Expr(re.escape(s))


def any_case(s: str) -> Expr:
    return Expr(f"(?i:{re.escape(s)})")


def chars(inside: str) -> Expr:
    """One character of a class, e.g. chars(r"\\p{L}0-9")."""
    return Expr(f"[{inside}]")


def run(inside: str) -> Expr:
    """One or more characters of a class, as one possessive step."""
    return Expr(f"[{inside}]++")


def not_ahead(e: Expr) -> Expr:
    return Expr(f"(?!{e.pattern})")


def quoted(mark: str = '"') -> Expr:
    """A mark, anything in which the mark is doubled, and the closing mark."""
    m = re.escape(mark)
    return text(mark) + (run(f"^{m}") | text(mark + mark)).many() + text(mark)


def bracketed(left: str = "[", right: str = "]") -> Expr:
    a, b = re.escape(left), re.escape(right)
    return text(left) + Expr(f"[^{a}{b}]*+") + text(right)


@dataclass(frozen=True)
class FieldGrammar:
    """How a field packs its values.

    bare: class of the characters of a value outside marks; all else separates.
    needs: class of which a value must hold a character to count.
    mark: quotation mark, or None where quotes only separate.
    brackets: pair around a bracketed value, or None.
    form: what a bare value must be as a whole, in the place of ``bare``.
    tidy: how a value is written in the end.
    """

    bare: str
    needs: str
    mark: str | None = '"'
    brackets: tuple[str, str] | None = None
    form: Expr | None = None
    tidy: Callable[[Column], Column] | None = None

    def value(self) -> Expr:
        e = self.form or run(self.bare)
        if self.brackets:
            e = bracketed(*self.brackets) | e
        if self.mark:
            e = quoted(self.mark) | e
        return e

    def token(self) -> Expr:
        """A value, or else one opening mark or bracket that was never closed."""
        e = self.value()
        for m in (self.mark, self.brackets and self.brackets[0]):
            if m:
                e = e | text(m)
        return e


def split_values(c: Column | str, g: FieldGrammar) -> Column:
    """array<struct<value, quoted>>: the values that count, in written order.

    Null, empty and blank texts give an empty array; a value is trimmed, quoted
    values lose their outer marks and have doubled marks halved.
    """
    c = F.col(c) if isinstance(c, str) else c
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({g.value().pattern})"), F.lit(1))

    def one(x: Column) -> Column:
        v, q = x, F.lit(False)
        if g.mark:
            q = F.startswith(x, F.lit(g.mark))
            v = F.when(q, F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit(g.mark * 2), F.lit(g.mark))).otherwise(v)
        if g.brackets:
            b = F.startswith(x, F.lit(g.brackets[0]))
            v = F.when(b, F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(v)
        v = F.regexp_replace(v, OUTER_SPACE, "")
        return F.struct((g.tidy(v) if g.tidy else v).alias("value"), q.alias("quoted"))

    return F.filter(F.transform(raw, one), lambda t: t["value"].rlike(f"[{g.needs}]"))


def parse_flags(c: Column | str, g: FieldGrammar) -> Column:
    """Null for a text read without trouble, else what was wrong: unclosed_quote or
    unclosed_bracket (an opening mark without its end, so it was read as a
    separator), or no_value (text there, but nothing in it counts)."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.when((F.size(split_values(c, g)) == 0) & F.coalesce(F.regexp_replace(c, OUTER_SPACE, "") != "", F.lit(False)), F.lit("no_value"))
    if not g.mark and not g.brackets:
        return out
    tokens = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({g.token().pattern})"), F.lit(1))
    found = lambda m: F.array_contains(tokens, F.lit(m)) if m else F.lit(False)
    return F.when(found(g.mark), F.lit("unclosed_quote")).when(found(g.brackets and g.brackets[0]), F.lit("unclosed_bracket")).otherwise(out)


def value_rows(df: DataFrame, column: str, g: FieldGrammar) -> DataFrame:
    """The other columns of ``df`` with (pos, value, quoted, flag), one row per value, positions
    from 1. A text that is flagged and holds no value gives one row without; null,
    empty and blank texts give none. Columns of ``df`` with one of these names give way."""
    rest = [f"`{c}`" for c in df.columns if c not in (column, "pos", "value", "quoted", "flag")]
    x = df.select(*rest, split_values(f"`{column}`", g).alias("__v"), parse_flags(f"`{column}`", g).alias("flag"))
    x = x.where("size(__v) > 0 or flag is not null").select(*rest, "flag", F.posexplode_outer("__v").alias("__p", "__x"))
    return x.select(*rest, (F.col("__p") + 1).cast("int").alias("pos"), F.col("__x.value").alias("value"), F.col("__x.quoted").alias("quoted"), "flag")


LETTERS = r"\p{L}\p{M}\p{N}"
#: synonyms: quoted parts, or letters, digits, blanks and , ' ( ) . -
SYNONYMS = FieldGrammar(bare=rf"{LETTERS} ,'().\-", needs=LETTERS)
#: cross references: runs of id characters that contain a colon; quotes only separate
XREFS = FieldGrammar(bare=rf"{LETTERS}:./_\-", needs=":", mark=None)
#: article numbers: runs of digits
NUMBERS = FieldGrammar(bare="0-9", needs="0-9", mark=None)


def term_ids(prefix: str) -> FieldGrammar:
    """Ids of a prefix and seven digits, a colon or underscore between, in any letter case."""
    digits = chars("0-9").times(7) + not_ahead(chars("0-9"))
    return FieldGrammar(bare="", needs="0-9", mark=None, form=any_case(prefix) + chars(":_") + digits, tidy=lambda v: F.replace(F.upper(v), F.lit("_"), F.lit(":")))


#: general lists with quoted, bracketed and bare values
LISTS = FieldGrammar(bare=r"^|;,\t\r\n\"\[\]", needs=LETTERS, brackets=("[", "]"))
