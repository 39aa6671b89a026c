"""Text rules as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may follow a sentence's end, besides closing and final-quote punctuation.
CLOSING = "\"'”’»)]}"
BOUNDARY = ".!?。！？"
#: No space before, none after.
NO_SPACE_BEFORE, NO_SPACE_AFTER = ",.;:!?…%)]}”»", "([{¿¡“«"


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores, in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def _class(chars: str) -> str:
    return "".join(re.escape(c) if c.isascii() else c for c in chars)


def sentence_end(text: Column, boundary: str = BOUNDARY) -> Column:
    """Whether the text ends a sentence, closing quotes and brackets apart."""
    if not boundary:
        return F.lit(False)
    return F.coalesce(text.rlike(rf"(?U)[{_class(boundary)}](?:[{_class(CLOSING)}\p{{Pe}}\p{{Pf}}\s])*$"), F.lit(False))


def collapsed(text: Column) -> Column:
    """One space between words, none around punctuation that takes none."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    out = F.regexp_replace(out, rf" ([{_class(NO_SPACE_BEFORE)}])", "$1")
    return F.regexp_replace(out, rf"([{_class(NO_SPACE_AFTER)}]) ", "$1")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clock(seconds: Column) -> Column:
    """H:MM:SS, with six decimals unless whole and with days in front from the first on."""
    micros = F.round(seconds * 1_000_000).cast("long")
    day, rest = F.expr("0"), micros
    day = F.floor(micros / 86_400_000_000)
    rest = micros - day * 86_400_000_000
    secs = F.floor(rest / 1_000_000)
    text = F.format_string("%d:%02d:%02d", F.floor(secs / 3600), F.floor(secs / 60) % 60, secs % 60)
    text = F.when(rest % 1_000_000 == 0, text).otherwise(F.concat(text, F.format_string(".%06d", rest % 1_000_000)))
    return F.when(day == 0, text).otherwise(F.concat(day.cast("string"), F.when(day == 1, F.lit(" day, ")).otherwise(F.lit(" days, ")), text))


def language(code: Column, aliases: dict[str, str], supported: set[str]) -> Column:
    """A code of two or three letters in lower case; a three-letter one by its alias if that is supported and it is not."""
    low = F.lower(code)
    alias = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv]), low) if aliases else F.lit(None).cast("string")
    out = F.when(low.isin(*sorted(supported)), low).when(alias.isin(*sorted(supported)), alias).otherwise(low)
    return F.when(code.rlike("^[a-zA-Z]{2,3}$"), out)


def plain_path(path: Column) -> Column:
    """Without `.`, empty and, with what they undo, `..` steps; an absolute path does not climb above its root."""
    steps = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = lambda kept, x: (x == "..") & (F.size(kept) > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("..")) != "..")
    out = F.aggregate(steps, F.array().cast("array<string>"), lambda kept, x: F.when(up(kept, x), F.slice(kept, 1, F.size(kept) - 1)).when((x == "..") & path.startswith("/"), kept).otherwise(F.array_append(kept, x)))
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(""), F.array_join(out, "/"))


def decimal_comma(number: Column, places: int = 2) -> Column:
    """A number with so many places after a comma."""
    return F.regexp_replace(F.format_string(f"%.{places}f", number), r"\.", ",")


def closes(text: Column) -> Column:
    """Whether the text ends with one of the three plain marks, a line's end apart."""
    return F.coalesce(text.rlike(r"[.!?]\n?\z"), F.lit(False))


def relative(path: Column, root: str) -> Column:
    """Relative to the root where inside it once `..` is resolved; else the path, so resolved."""
    path = plain_path(path)
    at = root.rstrip("/") + "/"
    return F.when(path.startswith(at), F.substr(path, F.lit(len(at) + 1))).otherwise(path)


def resolved(path: Column, root: str) -> Column:
    """Under the root unless absolute or empty."""
    return F.when(path.startswith("/") | (path == ""), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def backoff(attempt: Column, base: float = 1.0, cap: float = 10.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))


def topic_limit(seconds: Column, least: float = 3, scale: float = 0.5, exponent: float = 2) -> Column:
    """How many topics a video of this length may have at most."""
    return F.ceil(F.lit(float(least)) + F.lit(float(scale)) * (F.pow(F.ceil(seconds / 60).cast("double"), F.lit(float(exponent))) - 1)).cast("long")


def label_of(ident: Column, labels: dict[str, str]) -> Column:
    """The label of an id; null for an unknown one."""
    if not labels:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(labels.items()) for x in kv]), ident)
