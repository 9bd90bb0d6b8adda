"""Secret scan with a randomness test battery, in DataFrame functions only.

Base spans, leftmost and non-overlapping for each kind: ``assign`` (a credential's
name, a sign, a value of 8 or more characters), ``access`` (an access key id of 16
or more), ``hex`` (32 or more hexadecimal digits).

Added spans, kind ``random``: runs of 20 or more base64 characters outside base spans
(a run that base spans cut is tested piece by piece) that look drawn at random from the
smallest alphabet that has their characters (decimal, hex, base32, Crockford's base32 and
base36 of either case, letters and digits, base64 or URL base64). The battery has three
tests of that: chi-squared of the characters' counts against a uniform alphabet, the
number of runs above and below the alphabet's middle, and the correlation of neighbours.
The least of the three p-values, corrected for their number, is the battery's.

Two false-discovery rules of Benjamini and Hochberg decide, each within bands of length
and over all candidates of the corpus (from histograms of log p-values, whose size is
fixed). The first runs on the battery's p-value: of the runs it finds not to be random, a
share of at most ``ALPHA`` is. The second, over what ordinary writing is like, runs on the
likelihood ratio of a uniform alphabet to letter frequencies, an e-value that shrinks with
every character text would rarely have: short runs of writing pass the battery easily, and
of the runs reported at most ``RATE`` are such. A span passes both.

Positions are code points, end exclusive. Each text is scanned where it lies, with
no shuffle; only histograms are aggregated. Work and memory of a text grow with its
length and hardly faster than in proportion with its number of spans (running sums go by
slices of ``SLICE``).

Rows: a null text is empty text, with no spans. Every row gives one row. Extra
columns are kept by ``redacted`` and ignored by ``scan``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binding import let
from .common import staged

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Of one class of characters, so that a bound inside the pattern drops just the short matches.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RANDOM = r"[A-Za-z0-9+/_-]{20,}"
BASE = ("assign", "access", "hex")
MIN_VALUE = 8
ALPHA = 0.001
RATE = 0.01
#: Lengths at which a band begins.
BANDS = (20, 32, 48, 96)
#: Histogram steps for a factor of ten, and the last step.
STEPS, LAST = 4, 400
SLICE = 1024
_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_CROCKFORD = "abcdefghjkmnpqrstvwxyz"
#: Letters of English prose, a to z, in parts of 1000.
_FREQUENCY = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: Parts of 1000 of other characters in ordinary writing: a capital is so much rarer than its small letter; a digit; a sign.
_CAPITAL, _DIGIT, _SIGN = 0.05, 5, 5
#: By size: the first that has all of a token's characters is the smallest.
ALPHABETS = {
    "decimal": (r"^[0-9]+$", _DIGITS),
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef"),
    "base32": (r"^[A-Z2-7]+$", _LETTERS.upper() + "234567"),
    "base32lower": (r"^[a-z2-7]+$", _LETTERS + "234567"),
    "crockford": (r"^[0-9A-HJKMNP-TV-Z]+$", _DIGITS + _CROCKFORD.upper()),
    "crockfordlower": (r"^[0-9a-hjkmnp-tv-z]+$", _DIGITS + _CROCKFORD),
    "base36": (r"^[0-9A-Z]+$", _DIGITS + _LETTERS.upper()),
    "base36lower": (r"^[0-9a-z]+$", _DIGITS + _LETTERS),
    "alnum": (r"^[A-Za-z0-9]+$", _LETTERS.upper() + _LETTERS + _DIGITS),
    "base64": (r"^[A-Za-z0-9+/]+$", _LETTERS.upper() + _LETTERS + _DIGITS + "+/"),
    "base64url": (r"^[A-Za-z0-9_-]+$", _LETTERS.upper() + _LETTERS + _DIGITS + "-_"),
    "mixed": (r"", _LETTERS.upper() + _LETTERS + _DIGITS + "+/-_"),
}
_SPAN = "array<struct<start:int,end:int,m:string>>"


def running(xs: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of the integers ``xs`` the fold, from 0, of those before it: inside slices
    first, then over the slices, since an array that grows by one item is copied each time."""

    def fold(items: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, begin, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def joined(slices: Column) -> Column:
        return F.flatten(F.zip_with(slices, fold(F.transform(slices, lambda s: s["at"]))["out"], lambda s, base: F.transform(s["out"], lambda v: op(base, v))))

    n = lambda v: F.greatest(F.floor((F.size(v) - 1) / SLICE).cast("int"), F.lit(0))
    return let(xs, lambda v: let(F.transform(F.sequence(F.lit(0), n(v)), lambda i: fold(F.slice(v, i * SLICE + 1, SLICE))), joined))


def located(text: Column, matches: Column, pattern: str) -> Column:
    """Start, end and text of each match: between matches lie the pieces of a split."""

    def placed(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda p: p["gap"] + F.length(p["m"])), lambda a, x: a + x)
        return F.zip_with(pairs, before, lambda p, b: F.struct((b + p["gap"]).alias("start"), (b + p["gap"] + F.length(p["m"])).alias("end"), p["m"].alias("m")))

    pairs = F.zip_with(matches, F.slice(F.split(text, pattern, -1), 1, F.size(matches)), lambda m, gap: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    return F.when(F.size(matches) > 0, let(pairs, placed)).otherwise(F.array().cast(_SPAN))


def rewritten(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """``text`` with its ``spans`` (start, end; by start) replaced by ``put(span, end of those
    before)``. In UTF-32 a piece is found without counting characters from the start."""

    def piece(raw: Column, a: Column, b: Column) -> Column:
        return F.when(b > a, F.decode(F.substring(raw, 4 * a + 1, 4 * (b - a)), "UTF-32")).otherwise("")

    def joined(raw: Column, own: Column) -> Column:
        before = running(F.transform(own, lambda s: s["end"]), F.greatest)
        parts = F.zip_with(own, before, lambda s, b: F.concat(piece(raw, b, s["start"]), put(s, b)))
        return F.concat(F.array_join(parts, ""), piece(raw, F.array_max(F.transform(own, lambda s: s["end"])), F.length(raw).cast("int") / 4))

    return F.when(F.size(spans) > 0, let(F.encode(text, "UTF-32"), lambda raw: let(spans, lambda own: joined(raw, own)))).otherwise(text)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding(token: Column) -> Column:
    """The first of ``ALPHABETS`` that has all the token's characters."""
    out = F.lit("mixed")
    for name, (pattern, _) in reversed([x for x in ALPHABETS.items() if x[0] != "mixed"]):
        out = F.when(token.rlike(pattern), name).otherwise(out)
    return out


def _per_encoding(enc: Column, values: dict[str, object]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), enc)


def measured(span: Column) -> Column:
    """The span with n, encoding, each character's number in its alphabet (xs) and the sum
    of squared counts (sq). What doesn't depend on a character is made once for the span."""

    def numbered(enc: Column, alphabet: Column, folded: Column) -> Column:
        chars = F.split(folded, "")
        xs = F.transform(chars, lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double"))
        sq = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow((F.length(folded) - F.length(F.replace(folded, c, F.lit("")))).cast("double"), F.lit(2.0)))
        size = _per_encoding(enc, {k: float(len(a)) for k, (_, a) in ALPHABETS.items()})
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), span["m"].alias("m"), enc.alias("enc"), F.length(span["m"]).cast("double").alias("n"), size.alias("size"), xs.alias("xs"), sq.alias("sq"))

    letters = {k: a for k, (_, a) in ALPHABETS.items()}
    fold = lambda enc: F.when(enc == "hex", F.lower(span["m"])).otherwise(span["m"])
    return let(encoding(span["m"]), lambda enc: let(_per_encoding(enc, letters), lambda alphabet: let(fold(enc), lambda folded: numbered(enc, alphabet, folded))))


def summed(s: Column) -> Column:
    """Sums over a measured span's numbers: of deviations' squares (var) and neighbours'
    products (lag), runs about the middle, and how many are above it."""
    begin = F.struct(*[F.lit(0.0).alias(k) for k in ("var", "lag", "runs", "high")], F.lit(None).cast("double").alias("last"))

    def step(a: Column, x: Column, mean: Column, middle: Column) -> Column:
        high, before = x >= middle, a["last"] >= middle
        return F.struct(
            (a["var"] + (x - mean) * (x - mean)).alias("var"),
            (a["lag"] + F.coalesce((x - mean) * (a["last"] - mean), F.lit(0.0))).alias("lag"),
            (a["runs"] + F.when(a["last"].isNull() | (high != before), 1.0).otherwise(0.0)).alias("runs"),
            (a["high"] + F.when(high, 1.0).otherwise(0.0)).alias("high"),
            x.alias("last"),
        )

    mean = F.aggregate(s["xs"], F.lit(0.0), lambda a, x: a + x) / s["n"]
    return let(F.struct(mean.alias("mean"), (s["size"] / 2).alias("middle")), lambda c: F.aggregate(s["xs"], begin, lambda a, x: step(a, x, c["mean"], c["middle"])))


def battery(s: Column, t: Column) -> Column:
    """p-value that the span is uniform and independent: least of three tests, corrected."""
    n, df = s["n"], s["size"] - 1
    chi = s["size"] / n * s["sq"] - n
    p_chi = upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    # Expected runs 1 + 2ab / n; their variance (mu - 1)(mu - 2) / (n - 1).
    mu = 1 + 2 * t["high"] * (n - t["high"]) / n
    spread = (mu - 1) * (mu - 2) / (n - 1)
    p_runs = F.when(spread > 0, 2 * upper_tail(F.abs(t["runs"] - mu) / F.sqrt(spread))).otherwise(0.0)
    p_lag = F.when(t["var"] > 0, 2 * upper_tail(F.abs(t["lag"] / t["var"] + 1 / n) * F.sqrt(n))).otherwise(0.0)
    return 1 - F.pow(1 - F.least(p_chi, p_runs, p_lag, F.lit(1.0)), F.lit(3.0))


def character_weights() -> dict[str, float]:
    """log10 of each character's share of ordinary writing; shares add up to 1."""
    parts = {c: float(f) for c, f in zip(_LETTERS, _FREQUENCY, strict=True)}
    parts |= {c.upper(): f * _CAPITAL for c, f in zip(_LETTERS, _FREQUENCY, strict=True)}
    parts |= dict.fromkeys(_DIGITS, float(_DIGIT)) | dict.fromkeys("+/-_", float(_SIGN))
    total = sum(parts.values())
    return {c: math.log10(f / total) for c, f in parts.items()}


def rarity(s: Column) -> Column:
    """-log10 of the p-value that ordinary writing gives the span. Capitals alone count as small letters."""
    weights = character_weights()
    order = "".join(weights)
    table = F.array(*[F.lit(w) for w in weights.values()])
    text = F.when(s["m"].rlike("[a-z]"), s["m"]).otherwise(F.lower(s["m"]))
    share = F.aggregate(F.split(text, ""), F.lit(0.0), lambda a, c: a + F.element_at(table, F.call_function("instr", F.lit(order), c)))
    return F.greatest(F.lit(0.0), -s["n"] * F.log10(s["size"]) - share)


def band(n: Column) -> Column:
    out = F.lit(0)
    for i, first in enumerate(BANDS):
        out = F.when(n >= first, i).otherwise(out)
    return out


def _long_enough(span: Column) -> Column:
    return F.length(F.regexp_extract(span["m"], ASSIGN, 2)) >= MIN_VALUE


def _ordered(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end")))


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def matched(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` columns with ``_base`` (array of order, start, end) and ``_random``
    (array of start, end, band, step, odd: the candidates) of every text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    patterns = dict(zip(BASE, (ASSIGN, ACCESS, HEX), strict=True))
    # One projection after the other: each array is made once and used by name.
    a = docs.select(*keep, text.alias("_t"), *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_{k}") for k, p in patterns.items()])
    names = [c for c in a.columns if c not in {"_t", *(f"_{k}" for k in patterns)}]
    a = a.select(*names, "_t", *[located(F.col("_t"), F.col(f"_{k}"), p).alias(f"_{k}") for k, p in patterns.items()])
    ordered = [_ordered(F.filter(f"_{k}", _long_enough) if k == "assign" else F.col(f"_{k}"), i) for i, k in enumerate(BASE)]
    a = a.select(*names, "_t", F.array_sort(F.concat(*ordered)).alias("_base"))
    # Base spans as blanks, which no run has: what is left of a run are its pieces.
    blank = lambda s, b: F.repeat(F.lit(" "), s["end"] - F.greatest(s["start"], b))
    a = a.select(*names, "_base", rewritten(F.col("_t"), F.col("_base"), blank).alias("_t"))
    a = a.select(*names, "_base", "_t", F.regexp_extract_all("_t", F.lit(RANDOM), F.lit(0)).alias("_random"))
    a = a.select(*names, "_base", located(F.col("_t"), F.col("_random"), RANDOM).alias("_random"))
    a = a.withColumn("_random", F.transform("_random", measured))
    a = a.withColumn("_random", F.transform("_random", lambda s: F.struct(s.alias("s"), summed(s).alias("t"), rarity(s).alias("rare"))))
    judged = F.transform("_random", lambda r: F.struct(r["s"]["start"].alias("start"), r["s"]["end"].alias("end"), band(r["s"]["n"]).alias("band"), _step(r["rare"]).alias("step"), _step(-F.log10(F.greatest(battery(r["s"], r["t"]), F.lit(1e-300)))).alias("odd")))
    return a.select(*names, "_base", judged.alias("_random"))


def _step(minus_log: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(minus_log * STEPS), F.lit(LAST))).cast("int")


def cuts(found: DataFrame, step: str, rate: float) -> Column:
    """For each band of length the least step whose p-value bound passes the false-discovery
    rule: p <= rate * (candidates at that step or beyond) / (all candidates of the band)."""
    histogram = found.select(F.explode("_random").alias("r")).groupBy("r.band", f"r.{step}").agg(F.count("*").alias("n"))
    beyond = Window.partitionBy("band").orderBy(F.desc(step)).rowsBetween(Window.unboundedPreceding, 0)
    passing = histogram.withColumns({"k": F.sum("n").over(beyond), "all": F.sum("n").over(Window.partitionBy("band"))}).filter(F.pow(F.lit(10.0), -F.col(step) / STEPS) <= rate * F.col("k") / F.col("all"))
    least = {r["band"]: r["least"] for r in passing.groupBy("band").agg(F.min(step).alias("least")).collect()}  # one row for each band
    return F.array(*[F.lit(least.get(i, LAST + 1)) for i in range(len(BANDS))])


def accepted(found: DataFrame) -> DataFrame:
    """``found`` with ``spans`` (array of kind, start, end by start, then kind) and ``base``.
    ``found`` is read three times."""
    rare, odd = cuts(found, "step", RATE), cuts(found, "odd", ALPHA)
    added = F.filter("_random", lambda r: (r["odd"] < F.element_at(odd, r["band"] + 1)) & (r["step"] >= F.element_at(rare, r["band"] + 1)))
    kinds = F.array(*map(F.lit, (*BASE, "random")))
    every = F.array_sort(F.concat("_base", F.transform(added, lambda r: F.struct(r["start"].alias("start"), F.lit(len(BASE)).alias("order"), r["end"].alias("end")))))
    named = lambda spans: F.transform(spans, lambda s: F.struct(F.element_at(kinds, s["order"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.withColumn("_every", every).select(*[c for c in found.columns if c not in ("_base", "_random")], named(F.col("_base")).alias("base"), named(F.col("_every")).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of every row of ``docs`` (doc_id, text)."""
    return accepted(staged(matched(docs, F.col("doc_id")), "candidates"))


def digest(spans: str) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``, overlapping spans by one.
    Texts without spans, null ones included, stay as they are."""
    marked = accepted(staged(matched(docs, F.struct(*docs.columns).alias("_row")), "candidates"))
    clean = rewritten(F.col("_row.text"), F.col("spans"), lambda s, b: F.when(s["start"] >= b, mask).otherwise(""))
    return marked.select(*[clean.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
