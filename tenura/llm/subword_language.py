"""Language identification: averaged hashed subword embeddings under a linear softmax.

A subword is a run of 2 to 4 bytes of the lower-cased text inside one word, word ends included. A text is
the average of its subwords' embeddings. Both layers are trained by stochastic gradient descent in
numpy on a bounded sample; scores are calibrated by a temperature, and rejection by a threshold, on
rows of the sample that training left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.common import table

ORDERS = (2, 3, 4)
BUCKETS, WIDTH = 1 << 16, 16
#: Bounds of the training sample: documents of all languages together, and bytes of one of them.
SAMPLE, SAMPLE_BYTES = 6_000, 40_000
#: Subwords drawn from a text at each visit, visits of each text, texts a step, learning rate.
DRAWN, VISITS, STEP, RATE = 200, 12, 128, 8.0
#: Precision on left-out rows that the rejection threshold aims at.
PRECISION = 0.99
SLICE = 4_000_000
UNKNOWN = "und"

_KEPT = np.zeros(256, np.uint8)
_KEPT[list(range(97, 123)) + list(range(128, 256))] = list(range(97, 123)) + list(range(128, 256))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits that a bucket adds, BUCKETS x languages
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of each text, -1 where a run would cross a word's end, in one row of
    len(ORDERS) a byte, and the bounds of the texts in bytes. Texts get a space before and after."""
    padded = pc.binary_join_element_wise(pa.scalar(""), pc.utf8_lower(texts), pa.scalar(""), " ")
    offsets = np.frombuffer(padded.buffers()[1], np.int32 if pa.types.is_string(padded.type) else np.int64)
    offsets = offsets[padded.offset : padded.offset + len(padded) + 1].astype(np.int64)
    data = _KEPT[np.frombuffer(padded.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    bounds = offsets - offsets[0]
    n = len(data)
    wide = np.concatenate([data, np.zeros(max(ORDERS), np.uint8)]).astype(np.uint32)
    inner = wide != 0
    out = np.full((n, len(ORDERS)), -1, np.int32)
    starts = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # bytes left in the text
    for k, order in enumerate(ORDERS):
        code = np.zeros(n, np.uint32)
        whole = starts >= order
        for j in range(order):
            code = code * np.uint32(0x01000193) ^ wide[j : n + j]
            if 0 < j < order - 1:
                whole &= inner[j : n + j]
        if order == 2:
            whole &= inner[:n] & inner[1 : n + 1]
        else:
            whole &= inner[:n] | inner[order - 1 : n + order - 1]
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        code = (code ^ (code >> np.uint32(13))) + np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)
        out[whole, k] = ((code * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.int32)[whole]
    return out, bounds


def logits(texts: pa.Array, model: Model) -> np.ndarray:
    """One row of logits a text, averaged over all its subwords."""
    out = np.zeros((len(texts), len(model.languages)))
    lengths = pc.binary_length(texts).to_numpy()
    group = (np.cumsum(lengths) - lengths) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    padded = np.concatenate([model.table, np.zeros((1, len(model.languages)), np.float32)])  # bucket -1
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        buckets, bounds = subwords(texts.slice(a, b - a))
        counts = np.add.reduceat((buckets >= 0).sum(axis=1), bounds[:-1])
        for c in range(len(model.languages)):
            column = padded[:, c].astype(np.float64)
            added = np.add.reduceat(column[buckets].sum(axis=1), bounds[:-1])
            out[a:b, c] = added / np.maximum(counts, 1)
    return out + model.bias


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 5) -> Model:
    """Train on the texts given; every tenth, in a seeded order, calibrates."""
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in langs], np.int64)
    order = rng.permutation(len(texts))
    held, trained = order[: len(order) // 10], order[len(order) // 10 :]
    bags = []
    for start in range(0, len(texts), 500):
        buckets, bounds = subwords(pa.array(texts[start : start + 500], pa.string()))
        bags += [b[b >= 0] for b in np.split(buckets.reshape(-1), bounds[1:-1] * len(ORDERS))]
    trained = np.array([i for i in trained.tolist() if len(bags[i])], np.int64)
    embedding = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights = np.zeros((WIDTH, len(languages)), np.float32)
    weights[: min(WIDTH, len(languages))] += np.eye(WIDTH, len(languages), dtype=np.float32)[: min(WIDTH, len(languages))]
    bias = np.zeros(len(languages), np.float32)
    steps = VISITS * -(-len(trained) // STEP)
    done = 0
    for _ in range(VISITS):
        rng.shuffle(trained)
        for start in range(0, len(trained), STEP):
            rows = trained[start : start + STEP]
            drawn = np.stack([bags[i][rng.integers(0, len(bags[i]), DRAWN)] for i in rows.tolist()])
            hidden = embedding[drawn].mean(axis=1)
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(rows)), target[rows]] -= 1
            rate = RATE * (1 - done / steps)
            back = (error @ weights.T).astype(np.float32) / DRAWN
            weights -= (rate / 10) * (hidden.T @ error) / len(rows)
            bias -= (rate / 10) * error.mean(axis=0)
            np.add.at(embedding, drawn.reshape(-1), np.repeat(-rate * back, DRAWN, axis=0))
            done += 1
    model = Model(languages, embedding @ weights, bias, 1.0, 0.0)
    held = np.array([i for i in held.tolist() if len(bags[i])], np.int64)
    if len(held):
        raw = logits(pa.array([texts[i] for i in held.tolist()], pa.string()), model)
        loss = {t: -np.log(softmax(raw / t)[np.arange(len(held)), target[held]] + 1e-12).mean()
                for t in np.geomspace(0.05, 20, 60)}
        model.temperature = float(min(loss, key=loss.get))
        shares = softmax(raw / model.temperature)
        top, right = shares.max(axis=1), shares.argmax(axis=1) == target[held]
        down = np.argsort(-top)
        reach = np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= PRECISION
        model.threshold = float(top[down][np.flatnonzero(reach)[-1]]) if reach.any() else 1.0
    return model


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def train(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model from at most about `sample` rows, as evenly from the languages as these allow; None without
    any labelled row. Rows with crc32(doc_id) mod 5 = 0, or longer than `sample_bytes`, are never used."""
    usable = docs.filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & (F.octet_length("text") <= sample_bytes)
    )
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample / len(counts) / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000
    rows = usable.filter(draw).select("text", "lang").limit(2 * sample).collect()
    rows.sort(key=lambda r: (r["lang"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None, reject: bool = True) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every whole text.

    Texts that are missing or have no letter are `und` with score 0. `rejected` marks scores under the
    calibrated threshold; with `reject` these are `und` too. Rows are independent: ties, repeats and
    rows without doc_id (counted as held out) are predicted like any other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            text = batch.column("text").fill_null("")
            known = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            if model is None:
                known = np.zeros(len(text), bool)
                shares, names = np.zeros((len(text), 1)), np.array([UNKNOWN], object)
            else:
                shares = softmax(logits(text, model) / model.temperature)
                names = np.array(model.languages, object)
            score = np.where(known, shares.max(axis=1), 0.0)
            lang = np.where(known, names[shares.argmax(axis=1)], UNKNOWN)
            rejected = score < (model.threshold if model else 1.0)
            if reject:
                lang = np.where(rejected, UNKNOWN, lang)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang.tolist(), pa.string()),
                 pa.array(score), pa.array(rejected)],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(of, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op5_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs), reject=False)
