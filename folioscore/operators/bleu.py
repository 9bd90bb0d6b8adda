"""BLEU from n-gram counts, by sums: grams are counted inside a page, which gives ten
numbers, and a corpus adds those up. No gram is ever a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

ORDER = 4
#: Most rows whose grams are numbered together, and their tokens unless one row alone has more.
_ROWS, _TOKENS = 256, 1 << 16
STATS = [f"{k}{n}" for n in range(1, ORDER + 1) for k in ("c", "t")]


def clipped_counts(ref: pa.ListArray, hyp: pa.ListArray) -> np.ndarray:
    """(rows, 8): c1, t1 .. c4, t4 of each row's tokens. Grams get numbers by numbering
    pairs of (gram of one less, next token), for a whole batch at once."""
    rows = len(ref)
    words = pa.concat_arrays([x.flatten().cast(pa.string()) for x in (ref, hyp)]).dictionary_encode()
    code = words.indices.fill_null(len(words.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.concatenate([np.asarray(pc.fill_null(pc.list_value_length(x), 0), np.int64) for x in (ref, hyp)])
    row = np.repeat(np.arange(2 * rows), sizes)  # those of hyp behind those of ref
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # tokens from here to the row's end
    gram, out, kinds = code, np.zeros((rows, 2 * ORDER), np.int64), len(words.dictionary) + 1
    for n in range(1, ORDER + 1):
        if n > 1:
            gram = gram[:-1] * kinds + code[n - 1 :] if len(gram) > 1 else gram[:0]
            gram = np.unique(gram, return_inverse=True)[1]
        here = left[: len(gram)] >= n
        own, of = gram[here], row[: len(gram)][here]
        span = int(own.max()) + 1 if len(own) else 1
        keys, counts = np.unique((of % max(rows, 1)) * span + own + (of >= rows) * (rows * span), return_counts=True)
        cut = np.searchsorted(keys, rows * span)
        at = np.searchsorted(keys[:cut], keys[cut:] - rows * span)
        found = np.minimum(at, max(cut - 1, 0))
        same = keys[found] == keys[cut:] - rows * span if cut else np.zeros(len(keys) - cut, bool)
        least = np.where(same, np.minimum(counts[found], counts[cut:]), 0) if cut else np.zeros(len(keys) - cut, np.int64)
        whose = (keys[cut:] - rows * span) // span
        out[:, 2 * n - 2] = np.bincount(whose, weights=least, minlength=rows).astype(np.int64)
        out[:, 2 * n - 1] = np.bincount(whose, weights=counts[cut:], minlength=rows).astype(np.int64)
    return out


@F.arrow_udf(ArrayType(LongType()))
def _counts(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    sizes = sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ref, hyp))
    ends, parts, lo = np.cumsum(sizes), [], 0
    while lo < len(ref):
        most = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _TOKENS, side="right"))
        hi = min(max(lo + 1, most), lo + _ROWS)
        parts.append(clipped_counts(ref.slice(lo, hi - lo), hyp.slice(lo, hi - lo)))
        lo = hi
    flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * ORDER, dtype=np.int32)), pa.array(flat))


def page_stats(df: DataFrame, key: list[str], ref: str, hyp: str) -> DataFrame:
    """K-06, K-07: one row for each row of ``df`` with clipped matches c1..c4, totals t1..t4,
    hyp_len and ref_len. Null tokens are none. No shuffle."""
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    counted = df.select(*key, size(hyp).alias("hyp_len"), size(ref).alias("ref_len"), _counts(F.col(ref), F.col(hyp)).alias("_c"))
    return counted.select(*key, "hyp_len", "ref_len", *[F.col("_c")[i].alias(c) for i, c in enumerate(STATS)])


def bp(hyp_len: Column, ref_len: Column) -> Column:
    """Brevity penalty: 1 if the hypothesis isn't shorter, 0 if it is empty."""
    return F.when(hyp_len >= ref_len, 1.0).when(hyp_len == 0, 0.0).otherwise(F.exp(1 - ref_len / hyp_len))


def precisions(smooth: str = "exp") -> list[Column]:
    """Percent precisions p1..p4. ``exp``: the k-th zero counts as 1 / (2^k t); ``add1``: one
    more match and one more n-gram from bigrams on; ``none``."""
    out, zeros = [], F.lit(0)
    for n in range(1, ORDER + 1):
        c, t = F.col(f"c{n}"), F.col(f"t{n}")
        if smooth == "add1" and n > 1:
            out.append(F.when(t > 0, 100.0 * (c + 1) / (t + 1)).otherwise(0.0))
            continue
        zeros = zeros + F.when((c == 0) & (t > 0), 1).otherwise(0)
        low = 100.0 / (F.pow(F.lit(2.0), zeros) * t) if smooth == "exp" else F.lit(0.0)
        out.append(F.when(t == 0, 0.0).when(c == 0, low).otherwise(100.0 * c / t))
    return out


def score(smooth: str = "exp") -> dict[str, Column]:
    """score, p1..p4 and bp from a row's counts, with effective order; no match at all is 0."""
    p = precisions(smooth)
    order = sum((F.when(F.col(f"t{n}") > 0, 1).otherwise(0) for n in range(1, ORDER + 1)), F.lit(0))
    logs = sum((F.when((F.col(f"t{n}") > 0) & (x > 0), F.log(x)).otherwise(0.0) for n, x in enumerate(p, 1)), F.lit(0.0))
    nothing = sum((F.col(f"c{n}") for n in range(1, ORDER + 1)), F.lit(0)) == 0
    zero = nothing if smooth != "none" else nothing | F.greatest(*[(F.col(f"t{n}") > 0) & (F.col(f"c{n}") == 0) for n in range(1, ORDER + 1)])
    penalty = bp(F.col("hyp_len"), F.col("ref_len"))
    return {"score": F.when(zero, 0.0).otherwise(penalty * F.exp(logs / order))} | {f"p{n}": x for n, x in enumerate(p, 1)} | {"bp": penalty}


def sentence_bleu(df: DataFrame, key: list[str], ref: str, hyp: str, smooth: str = "exp") -> DataFrame:
    """K-06, K-08: key, score, p1..p4, bp of each row."""
    return page_stats(df, key, ref, hyp).select(*key, *[c.alias(n) for n, c in score(smooth).items()])


def corpus_bleu(df: DataFrame, key: list[str], ref: str, hyp: str, by: list[str]) -> DataFrame:
    """K-07: BLEU of all rows of each group; ``by`` is part of ``key``."""
    total = page_stats(df, key, ref, hyp).groupBy(*by).agg(*[F.sum(c).alias(c) for c in (*STATS, "hyp_len", "ref_len")])
    return total.select(*by, *[c.alias(n) for n, c in score().items()])


def mean_sentence_bleu(df: DataFrame, key: list[str], ref: str, hyp: str) -> DataFrame:
    """K-19: mean of add-one smoothed sentence scores, one decimal."""
    return sentence_bleu(df, key, ref, hyp, "add1").agg(F.round(F.avg("score"), 1).alias("bleu"))
