"""Toxicity by weak supervision.

Voters are word lists, written patterns, and words and word beginnings mined from labelled training rows.
The sample is dealt into PARTS by a hash. The true classes of one part are hidden: two other parts mine its
voters, a third is the labelled calibration share that names the classes, and a generative label model
estimates each voter's rates in both classes and the correlations of voters within them by EM, weighing
correlated voters down. So no row's own label has a say in its posterior. A linear classifier is then trained
on the posterior labels of all parts and scores every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.lineage import staged
from tenura.llm.common import table, texts

#: Bounds of the labelled sample by class.
TOXIC_ROWS, CLEAN_ROWS = 4_000, 16_000
#: Mined voters: at most so many, each in so many toxic rows, with such a smoothed precision.
MINED, SUPPORT, PRECISION = 250, 3, 0.75
#: Parts of the sample; each is hidden once, with the next one for calibration and the others for mining.
PARTS = 4
BEGINNINGS = (3, 4, 5, 6, 7)
SLICE = 4_000_000
THRESHOLD = 0.7

# Written voters: each list is one voter, which fires on any of its words.
LISTS = {
    "insults_en": "idiot moron imbecile fool dumb stupid loser clown jerk dunce halfwit",
    "contempt_en": "pathetic worthless disgusting trash scum garbage vermin filth useless vile",
    "threats_en": "kill die hurt destroy hate",
    "insults_fr": "imbécile crétin débile abruti connard salaud ordure",
    "insults_de": "idiot dummkopf trottel arschloch abschaum widerlich",
    "insults_es": "idiota estúpido imbécil basura asqueroso inútil payaso",
}
# Written patterns, each one voter on the text's form.
PATTERNS = {"shouting": r"(?:\b\p{Lu}{3,}\b[^\p{L}]+){5}", "exclaiming": r"!{2,}"}


@dataclass
class Model:
    words: dict[str, int]  # word -> voter
    beginnings: dict[str, int]  # word beginning -> voter
    names: list[str]
    weights: np.ndarray
    bias: float
    turned: int  # labels of the sample that lie on the other side of their posterior
    sampled: int


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lower-case runs of letters: each text's bounds, the code of each word, the distinct words."""
    plain = pc.replace_substring_regex(pc.utf8_lower(column), r"[^\p{L}]+", " ")
    split = pc.split_pattern(plain, " ")
    bounds = np.asarray(split.offsets) - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    return bounds, coded.indices.to_numpy(), coded.dictionary.to_pylist()


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    lengths = pc.binary_length(column).to_numpy()
    group = (np.cumsum(lengths) - lengths) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    return (column.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b)


def votes(column: pa.Array, words: dict[str, int], beginnings: dict[str, int], n_names: int) -> np.ndarray:
    """One row a text: how often each voter fires."""
    parts = [np.zeros((0, n_names), np.int32)]
    for part in _slices(column):
        bounds, codes, distinct = words_of(part)
        uses: list[tuple[int, int]] = []
        for code, word in enumerate(distinct):
            if word in words:
                uses.append((code, words[word]))
            for n in BEGINNINGS:
                if word[:n] in beginnings and len(word) >= n:
                    uses.append((code, beginnings[word[:n]]))
        fired = np.zeros((len(part), n_names), np.int32)
        by_code: dict[int, list[int]] = {}
        for code, voter in uses:
            by_code.setdefault(code, []).append(voter)
        marked = np.zeros(len(distinct), bool)
        marked[list(by_code)] = True
        at = np.flatnonzero(marked[codes]) if len(codes) else np.zeros(0, np.int64)
        text = np.searchsorted(bounds, at, side="right") - 1
        for t, code in zip(text.tolist(), codes[at].tolist(), strict=True):
            for voter in by_code[code]:
                fired[t, voter] += 1
        for k, pattern in enumerate(PATTERNS.values()):
            fired[:, k] += pc.match_substring_regex(part, pattern).to_numpy(zero_copy_only=False)
        parts.append(fired)
    return np.concatenate(parts)


def held_out():
    """Rows from which no label is learned."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> DataFrame:
    """(text, toxic, part) of about so many different (doc_id, text) rows of each class, drawn and dealt into
    parts by hashes of both. The keys of the drawn rows are broadcast: some thirty bytes for each."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marks = marks.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out())
    named = texts(docs).withColumn("name", F.xxhash64("text"))
    rows = staged(named.select("doc_id", "name").distinct().join(marks, "doc_id"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, toxic_rows / n.get(1, 1))).otherwise(min(1.0, clean_rows / n.get(0, 1)))
    keys = rows.filter(F.pmod(F.xxhash64("doc_id", "name"), F.lit(1_000_000)) < share * 1_000_000)
    drawn = named.join(F.broadcast(keys), ["doc_id", "name"]).dropDuplicates(["doc_id", "name"])
    return drawn.select("text", "toxic", F.pmod(F.xxhash64("name", "doc_id"), F.lit(PARTS)).cast("int").alias("part"))


def mine(sample: DataFrame, choices: list[list[int]], most: int = MINED) -> list[list[str]]:
    """For each choice of parts: words, and word beginnings ending in *, that mark their toxic rows, at most `most`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, part_of = batch.column("toxic").to_pylist(), batch.column("part").to_pylist()
            seen: dict[tuple[int, int], Counter[str]] = {(p, y): Counter() for p in range(PARTS) for y in (0, 1)}
            first = 0
            for part in _slices(batch.column("text")):
                bounds, codes, distinct = words_of(part)
                marks = [
                    [w, *[w[:n] + "*" for n in BEGINNINGS if len(w) >= n]] if len(w) > 1 else [] for w in distinct
                ]
                for r in range(len(part)):
                    own = {m for c in set(codes[bounds[r] : bounds[r + 1]].tolist()) for m in marks[c]}
                    seen[part_of[first + r], toxic[first + r]].update(own)
                first += len(part)
            names = list(set().union(*seen.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string())] + [pa.array([c[m] for m in names], pa.int64()) for c in seen.values()],
                ["mark", *[f"{'toxic' if y else 'clean'}_{p}" for p, y in seen]],
            )

    columns = [f"{kind}_{p}" for p in range(PARTS) for kind in ("clean", "toxic")]
    counted = sample.mapInArrow(count, "mark string, " + ", ".join(f"{c} long" for c in columns))
    counted = staged(counted.groupBy("mark").agg(*[F.sum(c).alias(c) for c in columns]))
    return [_selected(counted, choice, most) for choice in choices]


def _selected(counted: DataFrame, parts: list[int], most: int) -> list[str]:
    toxic, clean = (sum((F.col(f"{kind}_{p}") for p in parts), F.lit(0)) for kind in ("toxic", "clean"))
    found = counted.select("mark", toxic.alias("toxic"), clean.alias("clean"))
    good = found.filter(
        (F.col("toxic") >= SUPPORT) & ((F.col("toxic") + 1) / (F.col("toxic") + F.col("clean") + 2) >= PRECISION)
    )
    rows = good.orderBy(F.desc("toxic"), F.length("mark"), "mark").limit(8 * most).collect()
    kept: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (len(r["mark"].rstrip("*")), r["mark"])):
        word = r["mark"].rstrip("*")
        # a longer beginning of a kept one adds a voter without news
        if not any(word[:n] + "*" in kept for n in BEGINNINGS if n <= len(word)):
            kept[r["mark"]] = r["toxic"]
    return sorted(kept, key=lambda m: (-kept[m], m))[:most]


#: Rows' worth of the voter's overall rate that is added to its rate in each class.
SMOOTHING = 4.0


def label_model(
    hidden: np.ndarray, known: np.ndarray, marks: np.ndarray, rounds: int = 60
) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of class 1 for each row of `hidden` (rows x voters, 0 or 1), and the estimates.

    The classes of `hidden` are unknown. `known` rows with their `marks` start EM, name the classes and stay in
    its counts beside the expected ones. Each voter has a rate of firing in either class; the evidence of a
    voter, fired or not, is divided by one plus its positive correlations with the others within a class.
    """
    marks = marks.astype(np.float64)
    n_voters = hidden.shape[1]
    posterior, counted = np.zeros(len(hidden)), 0.0  # the first round knows only the calibration share
    for turn in range(rounds):
        n = len(marks) + counted * len(hidden)
        prior = (marks.sum() + counted * posterior.sum() + 0.5) / (n + 1)
        overall = (known.sum(axis=0) + counted * hidden.sum(axis=0) + 0.5) / (n + 1)
        rates, inner = [], np.zeros((n_voters, n_voters))
        for own, guessed in ((marks, posterior), (1 - marks, 1 - posterior)):
            total = own.sum() + counted * guessed.sum()
            fired = own @ known + counted * (guessed @ hidden)
            both = (known * own[:, None]).T @ known + counted * (hidden * guessed[:, None]).T @ hidden
            rate = (fired + 0.5) / (total + 1)
            scale = np.sqrt(np.clip(rate * (1 - rate), 1e-6, None))
            inner += total / n * np.clip((both / (total + 1) - np.outer(rate, rate)) / np.outer(scale, scale), 0, 1)
            rates.append((fired + SMOOTHING * overall) / (total + SMOOTHING))
        np.fill_diagonal(inner, 0)
        inner[inner < 0.1] = 0
        trust = 1 / (1 + inner.sum(axis=1))
        yes, no = trust * np.log(rates[0] / rates[1]), trust * np.log((1 - rates[0]) / (1 - rates[1]))
        odds = np.log(prior / (1 - prior)) + hidden @ yes + (1 - hidden) @ no
        before, posterior = posterior, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        counted = 1.0
        if turn and np.abs(posterior - before).max(initial=0.0) < 1e-6:
            break
    return posterior, {"toxic": rates[0], "clean": rates[1], "trust": trust, "correlations": inner, "prior": prior}


def features(counts: np.ndarray) -> np.ndarray:
    """Which voters fire, and how many mined ones do, on a scale that flattens."""
    fired = counts > 0
    return np.column_stack([fired, np.log1p(fired[:, len(PATTERNS) + len(LISTS) :].sum(axis=1))]).astype(np.float64)


def linear_fit(x: np.ndarray, target: np.ndarray, penalty: float, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (target - p) - ridge * w
        bend = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


#: Ridge penalties of the classifier, of which the training rows choose one.
PENALTIES = (0.5, 2.0, 8.0)


def _calibrated(
    shown: np.ndarray, posterior: np.ndarray, marks: np.ndarray, part: np.ndarray, penalty: float
) -> tuple[float, float, float, float]:
    """(loss, penalty, slope, shift): each part scored by a classifier of the others, the line from these scores
    to the labels, and its mean logarithmic loss."""
    logits = np.zeros(len(marks))
    for p in range(PARTS):
        weights, bias = linear_fit(shown[part != p], posterior[part != p], penalty)
        logits[part == p] = shown[part == p] @ weights + bias
    slope, shift = linear_fit(logits[:, None], marks.astype(np.float64), penalty=1e-3)
    line = logits * slope[0] + shift
    loss = float(np.mean(np.logaddexp(0, np.where(marks == 1, -line, line))))
    return loss, penalty, float(slope[0]), shift


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model | None:
    """A model from the bounded sample of training labels; None if these name fewer than two classes. The
    driver gathers votes, one byte a voter and sampled text, never texts."""
    sample = staged(labelled_sample(docs, labels, toxic_rows, clean_rows))
    every = list(range(PARTS))
    miners = [[p for p in every if p not in (hidden, (hidden + 1) % PARTS)] for hidden in every]
    final, *mined = mine(sample, [every, *miners])
    names = [*PATTERNS, *LISTS]
    written = len(names)
    words = {w: names.index(k) for k, listed in LISTS.items() for w in listed.split()}
    beginnings: dict[str, int] = {}
    for mark in dict.fromkeys([*final, *(m for chosen in mined for m in chosen)]):
        place = beginnings if mark.endswith("*") else words
        if mark.rstrip("*") not in place:
            place[mark.rstrip("*")] = len(names)
            names.append(mark)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = votes(batch.column("text"), words, beginnings, len(names))
            rows = [r.astype(np.uint8).tobytes() for r in np.minimum(counts, 255)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.binary()), batch.column("toxic"), batch.column("part")], ["counts", "toxic", "part"]
            )

    got = sample.mapInArrow(vote, "counts binary, toxic int, part int").collect()
    marks, part = (np.array([r[c] for r in got], np.int64) for c in ("toxic", "part"))
    if len(set(marks.tolist())) < 2:
        return None
    counts = np.stack([np.frombuffer(r["counts"], np.uint8) for r in got])
    at = {name: k for k, name in enumerate(names)}
    posterior = np.zeros(len(marks))
    for hidden, chosen in enumerate(mined):
        columns = [*range(written), *[at[m] for m in chosen if m in at]]
        own, known = part == hidden, part == (hidden + 1) % PARTS
        fired = [(counts[rows][:, columns] > 0).astype(np.float64) for rows in (own, known)]
        posterior[own], _ = label_model(*fired, marks[known])
    # the classifier and its scores use the voters of the whole sample only
    kept = [*range(written), *[at[m] for m in final if m in at]]
    place = {old: new for new, old in enumerate(kept)}
    shown = features(counts[:, kept])
    best = min((_calibrated(shown, posterior, marks, part, penalty) for penalty in PENALTIES), key=lambda found: found[0])
    _, penalty, slope, shift = best
    weights, bias = linear_fit(shown, posterior, penalty)
    turned = int(((posterior > 0.5) != (marks == 1)).sum())
    return Model(
        {w: place[k] for w, k in words.items() if k in place},
        {w: place[k] for w, k in beginnings.items() if k in place},
        [names[k] for k in kept], weights * slope, bias * slope + shift, turned, len(marks),
    )


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; a missing text is empty. Without a model
    every score is 0. Repeated rows score alike, rows without doc_id are scored like any other."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text")
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MINED voters and the written lists

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            value = np.zeros(batch.num_rows)
            if model is not None:
                counts = votes(batch.column("text"), model.words, model.beginnings, len(model.names))
                value = 1 / (1 + np.exp(-np.clip(features(counts) @ model.weights + model.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(of, "doc_id long, held_out boolean, score double, predicted int")


def op3_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
