"""Secret scans on built-in functions only: fixed patterns, and a battery of randomness tests on long unbroken tokens.

Base kinds are `assign`, `access` and `hex`, each leftmost and non-overlapping.  The battery adds spans of kind
`random`.  A token's encoding is inferred from its signs (hexadecimal, base 32, one-case base 36, base 64; decimal is
none).  Then
- the chi-squared statistic of its alphabet's uniformity, in the form of the number of equal pairs, is held against
  what structured text of that length would show, which gives a p-value that is small for uniform tokens only;
- a runs test and a lag-1 serial correlation test, together, must not reject random order (else the p-value is 1);
- per document, the false discovery rate is controlled by Benjamini-Hochberg steps on p-values weighted by length, since
  longer tokens give these tests more power.
Tokens that overlap a base span are not reported again.

Positions count code points, ends are exclusive.  Defined cases: a null text is empty and has no span; equal tokens are
each reported; repeated rows are each scanned; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_text

#: The base patterns.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of at least 24 signs: the same matches as all runs, less the shorter ones.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
FALSE_DISCOVERIES = 0.05
ORDER_LEVEL = 0.001
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Name, signs as a pattern, alphabet, and sum of squares and of cubes of sign frequencies in structured text.
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef", 0.14, 0.025),
    ("base32", "^[A-Z2-7]+$", _LOWER + "234567", 0.075, 0.0075),
    ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", _DIGITS + _LOWER, 0.07, 0.0068),
    ("base64", "", _LOWER.upper() + _LOWER + _DIGITS + "+/-_", 0.065, 0.0057),
)
_SPANS = "array<struct<s:int,e:int,m:string>>"


def _located(text: Column, pattern: str) -> Column:
    """All matches with their places.  Cutting the text at the matches gives what lies between them, so places are sums
    of lengths."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(_SPANS)

    def step(a: Column, x: Column) -> Column:
        s = a.at + F.length(x.gap)
        e = s + F.length(x.hit)
        return F.when(x.hit.isNull(), a).otherwise(F.struct(e.alias("at"), F.concat(a.found, F.array(F.struct(s.alias("s"), e.alias("e"), x.hit.alias("m")))).alias("found")))

    pairs = F.zip_with(F.split(text, pattern, -1), matches, lambda b, m: F.struct(b.alias("gap"), m.alias("hit")))
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda a: a.found)
    return F.when(text.rlike(pattern), found).otherwise(none)


def _normal(z: Column) -> Column:
    """The standard normal distribution function, within 0.0002."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070566 * z * z * z)))


def _tested(token: Column, alphabet: str, pairs: float, triples: float) -> Column:
    """The p-value of one token under structure, 1 if its signs are not in random order."""
    size = len(alphabet)
    fold = token if alphabet[0] == "A" else F.lower(token)
    n = F.length(token).cast("double")
    # As doubles: the square of a count of 46,342 is beyond an int.
    counts = [(F.length(token) - F.length(F.replace(fold, F.lit(c), F.lit("")))).cast("double") for c in alphabet]
    equal = F.aggregate(F.array(*counts), F.lit(0.0), lambda a, c: a + c * (c - 1))
    spread = 2 * n * (n - 1) * (pairs - pairs**2) + 4 * n * (n - 1) * (n - 2) * (triples - pairs**2)
    p = _normal((equal - n * (n - 1) * pairs) / F.sqrt(spread))
    middle, variance = (size + 1) / 2, (size * size - 1) / 12

    def order(v: Column) -> Column:
        last = F.size(v) - 1
        nexts = F.zip_with(F.slice(v, F.lit(1), last), F.slice(v, F.lit(2), last), lambda a, b: F.struct(((a > middle) != (b > middle)).cast("int").alias("turn"), ((a - middle) * (b - middle)).alias("product")))
        both = F.aggregate(nexts, F.struct(F.lit(0).alias("turns"), F.lit(0.0).alias("products")), lambda s, x: F.struct((s.turns + x.turn).alias("turns"), (s.products + x.product).alias("products")))
        runs = (both.turns - last / 2) / F.sqrt(last / 4)
        serial = both.products / variance / F.sqrt(last)
        return F.exp(-(runs * runs + serial * serial) / 2)  # chi-squared of two degrees

    signs = F.transform(F.filter(F.split(fold, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))
    # One-element transform: the signs are computed once.
    ordered = F.transform(F.array(signs), order)[0]
    return F.when(p > FALSE_DISCOVERIES, p).when(ordered < ORDER_LEVEL, F.lit(1.0)).otherwise(p)


def p_value(token: Column) -> Column:
    out = F.when(token.rlike("^[0-9]+$"), F.lit(1.0))
    for _, signs, alphabet, pairs, triples in ENCODINGS:
        p = _tested(token, alphabet, pairs, triples)
        out = out.when(token.rlike(signs), p) if signs else out.otherwise(p)
    return out


def _discovered(tested: Column) -> Column:
    """Of structs (s, e, p), those that length-weighted Benjamini-Hochberg steps accept."""
    mean = F.aggregate(tested, F.lit(0.0), lambda a, x: a + (x.e - x.s)) / F.size(tested)
    ranked = F.array_sort(F.transform(tested, lambda x: x.p * mean / (x.e - x.s)))
    passed = F.filter(F.transform(ranked, lambda q, i: F.when(q <= FALSE_DISCOVERIES * (i + 1) / F.size(tested), q)), lambda q: q.isNotNull())
    return F.filter(tested, lambda x: x.p * mean / (x.e - x.s) <= F.coalesce(F.array_max(passed), F.lit(-1.0)))


def _kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x.s.alias("s"), F.lit(kind).alias("k"), x.e.alias("e")))


def with_spans(docs: DataFrame, text: str, base: str, spans: str) -> DataFrame:
    """Adds arrays of structs (s, k, e): base spans, and all spans; k is the place in KINDS.  `text` must not be null."""
    t = F.col(text)
    c = dict(zip((*KINDS, "tested"), fresh(docs, *(f"__{k}" for k in (*KINDS, "tested"))), strict=True))
    out = docs.withColumns({c["assign"]: _located(t, ASSIGN), c["access"]: _located(t, ACCESS), c["hex"]: _located(t, HEX), c["random"]: _located(t, TOKEN)})
    out = out.withColumn(
        base,
        F.array_sort(F.concat(
            _kind(F.filter(c["assign"], lambda x: F.length(F.regexp_extract(x.m, ASSIGN, 2)) >= ASSIGN_LEAST), 0),
            _kind(F.filter(c["access"], lambda x: F.length(x.m) >= ACCESS_LEAST), 1),
            _kind(F.col(c["hex"]), 2),
        )),
    )
    tested = F.transform(c["random"], lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), p_value(x.m).alias("p")))
    out = out.withColumn(c["tested"], F.when(F.size(c["random"]) > 0, tested).otherwise(F.array().cast("array<struct<s:int,e:int,p:double>>")))
    found = F.when(F.size(c["tested"]) > 0, _discovered(F.col(c["tested"]))).otherwise(F.col(c["tested"]))
    out = out.withColumn(c["tested"], found)
    new = F.filter(c["tested"], lambda x: ~F.exists(base, lambda b: (b.s < x.e) & (x.s < b.e)))
    return out.withColumn(spans, F.array_sort(F.concat(base, _kind(new, 3)))).drop(*c.values())


def named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x.k + 1), x.s, x.e)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    d = with_spans(id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))), "text", "base", "all")
    count = lambda k: F.size(F.filter("base", lambda x: x.k == k)).cast("long")
    return d.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("all")).alias("spans"))


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by the mask."""
    def step(a: Column, x: Column) -> Column:
        apart = F.concat(a.out, F.substring(text, a.at + 1, F.greatest(F.lit(0), x.s - a.at)), F.lit(mask))
        return F.when(x.e <= a.at, a).when(x.s < a.at, F.struct(x.e.alias("at"), a.out.alias("out"))).otherwise(F.struct(x.e.alias("at"), apart.alias("out")))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a.out, F.substring(text, a.at + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """`docs`, same columns, with secrets masked in the text (null stays null); length_col is brought up to date."""
    text, base, every = fresh(docs, "__text", "__base", "__all")
    work = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    work = with_spans(work, text, base, every)
    new = F.when(F.size(every) > 0, redacted(F.col(text), F.col(every), mask)).otherwise(F.col(text_col))
    work = work.withColumn(text_col, new)
    if length_col:
        work = work.withColumn(length_col, F.when(F.size(every) > 0, F.length(text_col).cast("long")).otherwise(F.col(length_col)))
    return work.select(*(F.col(f"`{c}`") for c in docs.columns))
