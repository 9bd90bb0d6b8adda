"""Hooks for external models and services (U-01 to U-10, SRC-14, SRC-18).

An engine is a callable that is made once for each Python worker and then takes one
payload; Spark brings the rows and takes the outcome. A row that fails has an error
and doesn't stop the others. Nothing here knows a model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions.binding import bound
from ..sources import sinks
from . import relational as R
from . import sections as S
from . import tokens as K

#: Fixed values of the document stage's token budget.
BASE_TOKENS, PAGE_TOKENS, MOST_TOKENS = 4000, 2000, 12_000
#: Rows whose payloads are Python objects at once.
_ROWS = 1024
_REGISTRY: dict[str, Callable[[], Callable]] = {}


def register(name: str):
    """U-01: name a factory of engines."""

    def add(factory: Callable[[], Callable]):
        _REGISTRY[name] = factory
        return factory

    return add


def engine(name: str) -> Callable[[], Callable]:
    if name not in _REGISTRY:
        raise KeyError(f"no engine {name!r}; there are: {', '.join(sorted(_REGISTRY)) or 'none'}")
    return _REGISTRY[name]


def run(df: DataFrame, key: str, payload: list[str], factory: Callable[[], Callable[..., str]], threads: int = 1, keep: list[str] | None = None) -> DataFrame:
    """U-02 to U-10: key, status, data, error: ``factory()`` makes the engine, which takes
    the payload columns by name (arrays as lists) and returns a text (JSON, say). Calls to a service
    overlap on ``threads`` threads of a worker, so at most threads times the task slots are open.
    Columns of ``keep`` go along, so that an answer needs no join to what was asked."""
    kept = keep or []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = factory()

        def one(values: tuple) -> tuple:
            try:
                return "ok", call(**dict(zip(payload, values, strict=True))), None
            except Exception as e:  # noqa: BLE001  one row's fault is its own
                return "error", None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                columns = [batch.column(c) for c in payload]
                for lo in range(0, batch.num_rows, _ROWS):
                    asked = zip(*[c.slice(lo, _ROWS).to_pylist() for c in columns], strict=True)
                    outcome = list(zip(*(pool.map(one, asked) if threads > 1 else map(one, asked)), strict=True))
                    own = [batch.column(c).slice(lo, _ROWS) for c in (key, *kept)]
                    yield pa.RecordBatch.from_arrays([own[0], *[pa.array(x, pa.string()) for x in outcome], *own[1:]], ["id", "status", "data", "error", *kept])

    kind = dict(df.dtypes)
    more = "".join(f", `{c}` {kind[c]}" for c in kept)
    return df.select(key, *[c for c in dict.fromkeys([*payload, *kept]) if c != key]).mapInArrow(work, f"id {kind[key]}, status string, data string, error string{more}")


def document_payload(pages: DataFrame, image: str = "image", name: str = "filename") -> DataFrame:
    """U-09: doc_id, names and images of its pages by number, and the token budget."""
    grouped = R.pages_of(R.with_doc_and_page(pages, name), [name, image])
    return grouped.select("doc_id", F.transform("pages", lambda p: p[name]).alias("names"), F.transform("pages", lambda p: p[image]).alias("images"), token_budget(F.size("pages")).alias("num_predict"))


def token_budget(pages: Column) -> Column:
    return F.least(F.lit(MOST_TOKENS), BASE_TOKENS + PAGE_TOKENS * pages)


def paired_inputs(words: Column, boxes: Column) -> Column:
    """U-04, U-05: (word, box) up to the shorter list, without blank words or boxes that
    aren't four numbers."""
    n = F.least(F.size(words), F.size(boxes))
    zipped = F.zip_with(F.slice(words, 1, n), F.slice(boxes, 1, n), lambda w, b: F.struct(w.alias("word"), b.alias("box")))
    return F.filter(zipped, lambda p: (F.trim(F.coalesce(p["word"], F.lit(""))) != "") & F.coalesce(F.size(p["box"]) == 4, F.lit(False)))


def reading_inputs(images: DataFrame, boxes: list[DataFrame], key: str, on_missing: str = "skip") -> DataFrame:
    """U-07: images with the boxes of the first frame that has their name. Without any:
    skipped, or an ``error`` in their row."""
    if on_missing not in ("skip", "error"):
        raise ValueError(f"on_missing is skip or error, not {on_missing!r}")
    found = images.join(R.first_match(boxes, [key]), key, "left")
    if on_missing == "skip":
        return found.filter(F.col("boxes").isNotNull())
    return found.withColumn("error", F.when(F.col("boxes").isNull(), F.concat(F.lit("no boxes for "), key)))


def polled(submit: Callable, poll: Callable, interval: float = 2.0, limit: float = 600.0) -> Callable[[], Callable]:
    """SRC-14: an engine of a service that takes jobs: ``submit(**payload)`` gives a job's id,
    ``poll(id)`` its result once there is one (None before), asked every ``interval`` seconds. A
    job without a result after ``limit`` seconds is its row's error."""

    def factory() -> Callable:
        def call(**payload):
            job, until = submit(**payload), time.monotonic() + limit
            while (result := poll(job)) is None:
                if time.monotonic() >= until:
                    raise TimeoutError(f"job {job} has no result after {limit} s")
                time.sleep(interval)
            return result

        return call

    return factory


def structured(raw: DataFrame) -> DataFrame:
    """U-08, U-09: ``run``'s outcome with the answer's JSON found and checked against the
    prediction schema (T-24, G-23), in the status envelope (SNK-07): id, status, data, error."""
    found = raw.withColumn("value", F.when(F.col("status") == "ok", X.json_from_text(F.col("data"))))
    checked = S.validated(found.withColumnRenamed("error", "_failed").drop("data"))
    why = F.coalesce("_failed", "error")
    return sinks.envelope(checked.withColumn("_why", why), "id", "data", "_why")


def page_stage(images: DataFrame, prompt: str, factory: Callable[[], Callable[..., str]], key: str = "page_id", threads: int = 1) -> DataFrame:
    """U-08: each page's image with the prompt through a vision model, as ``structured``."""
    return structured(run(images.withColumn("prompt", F.lit(prompt)), key, ["image", "prompt"], factory, threads))


def document_stage(images: DataFrame, prompt: str, factory: Callable[[], Callable[..., str]], name: str = "filename", threads: int = 1) -> DataFrame:
    """U-09: each document's pages, in order and with their token budget, as ``structured``."""
    docs = document_payload(images, name=name).withColumn("prompt", F.lit(prompt))
    return structured(run(docs, "doc_id", ["images", "prompt", "num_predict"], factory, threads))


def token_labels(pages: DataFrame, factory: Callable[[], Callable[..., str]], labels: dict[int, str], key: str = "page_id", threads: int = 1) -> DataFrame:
    """U-04, U-05: key, word_no, word, label. Pages (key, words, boxes) are paired and go
    through a token classifier, whose answer is JSON: ``word_ids`` (the pair's number of each
    sub-token, null for special ones) and ``logits``. Sub-tokens are pooled by word (K-15) in their
    page's row: no token is a row, and nothing is joined."""
    paired = pages.select(key, paired_inputs(F.col("words"), F.col("boxes")).alias("p"))
    inputs = paired.select(key, F.transform("p", lambda x: x["word"]).alias("words"), F.transform("p", lambda x: x["box"]).alias("boxes"))
    answer = run(inputs, key, ["words", "boxes"], factory, threads, keep=["words"]).filter("status = 'ok'")
    out = bound(answer.select("id", "words", "data"), _o=F.from_json("data", "word_ids array<int>, logits array<array<double>>"))
    pooled = out.select(F.col("id").alias(key), "words", K.pooled_labels(F.col("_o.word_ids"), F.col("_o.logits"), F.size("words")).alias("_l"))
    rows = pooled.select(key, F.posexplode(F.arrays_zip("words", "_l")).alias("word_no", "_w"))
    return rows.select(key, "word_no", F.col("_w.words").alias("word"), K.named_label(F.col("_w._l"), labels).alias("label"))


def reading_order(images: DataFrame, boxes: list[DataFrame], factory: Callable[[], Callable[..., str]], key: str = "page_id", on_missing: str = "skip", threads: int = 1) -> DataFrame:
    """U-07: key, status, places, clipped and the words in reading order. Images (key, width,
    height) take the first frame that has their boxes and texts; boxes are scaled (G-09) and
    padded (K-18) for the model, whose answer is JSON, a list of logits for each box; places are
    decoded (K-16) and the texts put in their order (T-26)."""
    found = reading_inputs(images, boxes, key, on_missing)
    if "error" not in found.columns:
        found = found.withColumn("error", F.lit(None).cast("string"))
    ready = found.withColumn("model", K.model_inputs(G.norm_boxes_1000(F.col("boxes"), F.col("width"), F.col("height"))))
    asked = ready.filter("error is null").select(key, "model.input_ids", "model.bbox", "model.attention_mask")
    answer = run(asked, key, ["input_ids", "bbox", "attention_mask"], factory, threads).withColumnsRenamed({"id": key, "error": "_failed"})
    joined = ready.join(answer, key, "left")
    places = K.decode_order(F.from_json("data", "array<array<double>>"))
    # A box's place is where it comes: the order is the boxes by place.
    placed = joined.withColumn("places", places).withColumn("order", F.transform(F.array_sort(F.transform("places", lambda p, i: F.struct(p.alias("p"), i.alias("i")))), lambda x: x["i"]))
    status = F.when(F.coalesce("error", "_failed").isNull(), "ok").otherwise("error")
    return placed.select(key, status.alias("status"), "places", F.col("model.clipped").alias("clipped"), X.reordered_words(F.col("texts"), F.col("order")).alias("words"), F.coalesce("error", "_failed").alias("error"))
