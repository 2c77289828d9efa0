"""Text expressions, all on built-in functions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SNIPPET

#: Characters of the Unicode property White_Space.  Spelt out, they match several times faster.
SPACE = r"[ \t\n\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = f"{SPACE}+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACES}|{SPACES}\z", "")


def trim_end(c: Column) -> Column:
    """Without spaces, tabs and line ends at the end."""
    return F.regexp_replace(c, r"[ \t\r\n]+\z", "")


def _accents() -> tuple[str, str]:
    """Letters that decompose into another letter and marks, and those letters."""
    pairs = []
    for i in range(0xC0, min(sys.maxunicode, 0xFFFF)):
        if 0xD800 <= i < 0xE000 or 0xAC00 <= i < 0xD7A4:
            continue
        d = unicodedata.normalize("NFD", chr(i))
        base = "".join(c for c in d if not unicodedata.combining(c))
        if len(d) > 1 and len(base) == 1 and base != chr(i):
            pairs.append((chr(i), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(c), _FROM, _TO), r"\p{Mn}+", "")


def terms(c: Column) -> Column:
    """Folded runs of letters and digits; null has none."""
    return F.coalesce(F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0)), F.array().cast("array<string>"))


def query_tokens(c: Column) -> Column:
    """What a user's query is cut into: runs of letters, digits, _ and -, of two bytes at least."""
    found = F.regexp_extract_all(c, F.lit(r"[\p{IsAlphabetic}\p{N}_-]+"), F.lit(0))
    return F.filter(found, lambda t: F.octet_length(t) > 1)


def match_query(c: Column) -> Column:
    """The same as a full-text query: quoted tokens, all of which have to match."""
    return F.array_join(F.transform(query_tokens(c), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " ")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def title(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*\z", "")


def snippet(content: Column, most: int = SNIPPET) -> Column:
    """The beginning of a chunk's body in one line: a leading heading line is dropped, white space becomes one space,
    and what is longer than `most` characters ends in "..."."""
    newline = F.instr(content, "\n")
    body = F.when(~F.startswith(content, F.lit("#")), content).when(newline > 0, F.substring(content, newline + 1, F.length(content))).otherwise(F.substring(content, F.lit(2), F.length(content)))
    flat = F.ltrim(F.regexp_replace(body, SPACES, " "))
    n = F.length(flat)
    # The limit may be reached by a space of which more follows: that counts as more text.
    cut = (n > most) | ((n == most) & F.endswith(flat, F.lit(" ")) & body.rlike(rf"{SPACE}{SPACE}\z"))
    head = F.trim(F.substring(flat, 1, most))
    return F.when(cut, F.concat(F.substring(head, 1, most - 3), F.lit("..."))).otherwise(F.trim(flat))


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, max(0, most - 3)), F.lit("...")))


def media_snippet(media_type: Column, start: Column, end: Column) -> Column:
    """What stands for the snippet of an image or of PDF pages; null for others."""
    pages = F.when(end == start + 1, F.concat(F.lit("PDF page "), start + 1)).when(end > start + 1, F.concat(F.lit("PDF pages "), start + 1, F.lit("–"), end)).otherwise(F.lit("PDF"))
    return F.when(media_type == "image", F.lit("Image")).when(media_type == "pdf", pages)


def page_tag(start: Column, end: Column) -> Column:
    usable = (start >= 0) & (end > start)
    one = F.concat(F.lit(" p"), start + 1)
    return F.when(usable, F.when(end == start + 1, one).otherwise(F.concat(one, F.lit("-"), end))).otherwise(F.lit(""))


def media_tag(media_type: Column, start: Column, end: Column, truncated: Column) -> Column:
    """A bracketed tag for hits that are no text; null for text."""
    more = F.when(truncated, F.lit(" truncated")).otherwise(F.lit(""))
    name = F.when(media_type == "image", F.lit("image")).when(media_type == "pdf", F.concat(F.lit("pdf"), page_tag(start, end))).otherwise(truncate(media_type, 24))
    return F.when(~media_type.isin("text", ""), F.concat(F.lit("["), name, more, F.lit("]")))


def format_hit(rank: Column, score: Column, path: Column, heading_path: Column, snip: Column, tag: Column, width: int = 80) -> Column:
    """A hit as lines of text."""
    heading = F.when(heading_path == "", F.lit("")).otherwise(F.concat(F.lit(" › "), heading_path))
    lines = F.concat_ws("\n        ", F.concat(rank.cast("string"), F.lit(". "), F.format_string("%.2f", score), F.lit("  "), path, heading), tag, truncate(snip, max(20, width - 8)))
    return lines


def page_ranges(pages: Column, per_chunk: Column) -> Column:
    """[0, pages) in steps, as structs (start, end)."""
    starts = F.when(pages > 0, F.sequence(F.lit(0).cast("long"), pages.cast("long") - 1, per_chunk.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + per_chunk, pages).cast("long").alias("end")))
