"""Heading-aware chunking of markdown, row by row: a document's lines, sections and windows stay arrays until the last
step, so there is no shuffle and no per-document task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_OVERLAP, CHUNK_WORDS
from ..functions.text import let, trim, trim_end, words

FENCE = r"^[ \t]*(```|~~~)"
HEADING = r"(?s)^[ \t]*(#{1,6})(?:[ \t].*)?\z"
#: What a fence or heading line at least begins with.
MARKED = r"^[ \t]*(#|```|~~~)"
_STARTS = "array<struct<at:int,level:int,text:string>>"
_SECTIONS = "array<struct<at:int,heading:string,path:string>>"
_CHUNKS = "array<struct<heading:string,heading_path:string,content:string,tokens:int>>"


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows of `size` words that overlap, the last of which reaches the end."""
    step = max(size - overlap, 1)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), (count - 1) * step, F.lit(step))).otherwise(F.array().cast("array<int>"))


def windows(w: Column, size: int, overlap: int) -> Column:
    """Windows of words, as text and number of words."""
    one = lambda w, s: F.struct(F.array_join(F.slice(w, s + 1, F.lit(size)), " ").alias("text"), F.least(F.lit(size), F.size(w) - s).alias("n"))
    return let(w, lambda w: F.transform(window_starts(F.size(w), size, overlap), lambda s: one(w, s)))


def heading_text(line: Column) -> Column:
    rest = F.regexp_extract(line, r"(?s)^[ \t]*#{1,6}(.*)\z", 1)
    return trim(F.regexp_replace(trim(rest), r"[# \t]+\z", ""))


def _starts(lines: Column) -> Column:
    """Lines with a heading of level 1 to 3 outside of fences."""

    def step(a: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"\r\z", "")
        fence = bare.rlike(FENCE)
        level = F.length(F.regexp_extract(bare, HEADING, 1))
        heading = ~a.fenced & ~fence & (level >= 1) & (level <= 3)
        found = F.when(heading, F.concat(a.found, F.array(F.struct(a.i.alias("at"), level.alias("level"), heading_text(bare).alias("text"))))).otherwise(a.found)
        marked = F.struct((a.i + 1).alias("i"), (a.fenced != fence).alias("fenced"), found.alias("found"))
        return F.when(line.rlike(MARKED), marked).otherwise(F.struct((a.i + 1).alias("i"), a.fenced.alias("fenced"), a.found.alias("found")))

    zero = F.struct(F.lit(0).alias("i"), F.lit(False).alias("fenced"), F.array().cast(_STARTS).alias("found"))
    return F.aggregate(lines, zero, step, lambda a: a.found)


def _sections(starts: Column) -> Column:
    """Where sections begin, with heading and path; a preamble begins at line 0."""

    def step(a: Column, s: Column) -> Column:
        h1 = F.when(s.level == 1, s.text).otherwise(a.h1)
        h2 = F.when(s.level == 2, s.text).when(s.level < 2, F.lit("")).otherwise(a.h2)
        h3 = F.when(s.level == 3, s.text).otherwise(F.lit(""))
        path = F.array_join(F.filter(F.array(h1, h2, h3), lambda x: x != ""), " > ")
        out = F.concat(a.out, F.array(F.struct(s["at"].alias("at"), s.text.alias("heading"), path.alias("path"))))
        return F.struct(h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), out.alias("out"))

    none = F.lit("")
    preamble = F.array(F.struct(F.lit(0).alias("at"), none.alias("heading"), none.alias("path"))).cast(_SECTIONS)
    first = F.when((F.size(starts) == 0) | (F.element_at(starts, 1)["at"] > 0), preamble).otherwise(F.array().cast(_SECTIONS))
    zero = F.struct(none.alias("h1"), none.alias("h2"), none.alias("h3"), first.alias("out"))
    return F.when(F.size(starts) == 0, preamble).otherwise(F.aggregate(starts, zero, step, lambda a: a.out))


def _chunks(section: Column, size: int, overlap: int) -> Column:
    """A section's chunks: itself, or windows of its body under its heading line."""
    chunk = lambda text, n: F.struct(section.heading.alias("heading"), section.path.alias("heading_path"), text.alias("content"), n.cast("int").alias("tokens"))

    def cut(content: Column) -> Column:
        newline = F.instr(content, "\n")
        peel = (section.heading != "") & (newline > 0)
        head = F.when(peel, F.substring(content, F.lit(1), newline)).otherwise(F.lit(""))
        body = F.when(peel, F.substring(content, newline + 1, F.length(content))).otherwise(content)
        counted = F.struct(head.alias("text"), F.size(words(head)).alias("n"))
        return let(counted, lambda head: F.transform(windows(words(body), size, overlap), lambda w: chunk(F.concat(head.text, w.text), head.n + w.n)))

    def whole_or_cut(content: Column) -> Column:
        return let(F.size(words(content)), lambda n: F.when(n == 0, F.array().cast(_CHUNKS)).when(n <= size, F.array(chunk(content, n))).otherwise(cut(content)))

    return let(trim_end(section.text), whole_or_cut)


def chunked(docs: DataFrame, text: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Explodes each document into chunks: adds chunk_idx, heading, heading_path, content, content_hash and tokens in
    place of the text.  A null text has no chunk."""
    size = size or CHUNK_WORDS
    overlap = CHUNK_OVERLAP if overlap >= size else overlap
    others = [c for c in docs.columns if c != text]
    # A text that ends in a line end has no line after it.
    lines = F.split(F.regexp_replace(F.col(text), r"\n\z", ""), "\n", -1)

    def with_text(lines: Column, sections: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            end = F.coalesce(F.get(sections, i + 1)["at"], F.size(lines))
            text_of = F.concat(F.array_join(F.slice(lines, s["at"] + 1, end - s["at"]), "\n"), F.lit("\n"))
            return F.struct(s.heading.alias("heading"), s.path.alias("path"), text_of.alias("text"))

        return F.transform(sections, one)

    sections = let(lines, lambda l: let(let(_starts(l), _sections), lambda s: with_text(l, s)))
    # A text without a line that a heading or fence could begin is one section, and needs no lines.
    whole = F.struct(F.lit("").alias("heading"), F.lit("").alias("path"), F.col(text).alias("text"))
    every = F.when(F.col(text).rlike(f"(?m){MARKED}"), F.flatten(F.transform(sections, lambda s: _chunks(s, size, overlap)))).otherwise(let(whole, lambda s: _chunks(s, size, overlap)))
    d = docs.filter(F.col(text) != "").select(*others, F.posexplode(every).alias("chunk_idx", "__c"))
    return d.select(
        *others, F.col("chunk_idx").cast("long").alias("chunk_idx"), "__c.heading", "__c.heading_path", "__c.content",
        F.sha2("__c.content", 256).alias("content_hash"), F.col("__c.tokens").cast("long").alias("tokens"),
    )
