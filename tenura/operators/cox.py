"""Ridge-penalised Cox regression with Efron ties, many models per pass over the placed rows.

Per iteration there are two passes over the rows:

1. each chunk returns its totals of r = exp(eta) and r*x; suffix sums over chunks give every slab
   the risk-set sums of all later slabs;
2. each chunk turns those offsets into its share of the likelihood, gradient and Hessian. The
   hazard accumulated in earlier slabs enters linearly, so a chunk also returns its weighted Gram
   matrix and the prefix is applied when the chunks are added up: within a task those of its run of
   chunks, the rest of the prefix later.

The driver only sees vectors of the size of the feature set, never rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.functions.tails import Z_95, log_chi2_tail, normal_two_sided
from tenura.operators.layout import Chunk, Placed, chunks_of, place

PENALIZER = 0.1
MAX_ITERATIONS = 50
TOLERANCE = 1e-9
# Results of a pass up to this size are added up on the driver; larger ones on the executors first.
DRIVER_BYTES = 64 * 1024 * 1024
# Offsets of one group of models sent to the executors.
OFFSET_BYTES = 256 * 1024 * 1024

# Covariates computed from the survival time itself.
FORBIDDEN = frozenset({"log_duration", "playtime_2wk_ratio", "duration_ratio", "duration"})

PASS_SCHEMA = "spec int, chunk int, payload binary"


@dataclass(frozen=True)
class Spec:
    """One model: its features and, for cross-validation, the fold that is left out."""

    name: str
    features: tuple[str, ...]
    fold_column: str | None = None
    left_out: int | None = None


@dataclass
class CoxModel:
    spec: Spec
    penalizer: float
    n: int
    n_events: int
    means: np.ndarray
    stds: np.ndarray
    beta: np.ndarray  # on the standardised scale
    loglik: float
    loglik_penalized: float
    gradient: np.ndarray  # penalised, standardised scale
    hessian: np.ndarray  # penalised, standardised scale
    iterations: int

    @property
    def features(self) -> tuple[str, ...]:
        return self.spec.features

    @property
    def coef(self) -> np.ndarray:
        return self.beta / self.stds

    @property
    def covariance(self) -> np.ndarray:
        return np.linalg.inv(-self.hessian) / np.outer(self.stds, self.stds)

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.features, self.coef.tolist()))

    def centres(self) -> dict[str, float]:
        return dict(zip(self.features, self.means.tolist()))


def check_features(features: Sequence[str], columns: Sequence[str]) -> None:
    leaky = sorted(FORBIDDEN & set(features))
    if leaky:
        raise ValueError(f"covariates derived from the survival time are not allowed: {leaky}")
    missing = sorted(set(features) - set(columns))
    if missing:
        raise ValueError(f"missing covariates: {missing}")
    if not features:
        raise ValueError("a Cox model needs at least one covariate")


def fit(
    df: DataFrame,
    features: Sequence[str],
    penalizer: float = PENALIZER,
    keys: Sequence[str] = ("user_id", "item_id"),
    name: str = "model",
) -> CoxModel:
    """Fit one model on every complete row of `df`."""
    check_features(features, df.columns)
    placed = place(df, features, keys=keys)
    try:
        return fit_many(placed, [Spec(name, tuple(features))], penalizer)[name]
    finally:
        placed.release()


def fit_many(
    placed: Placed, specs: Sequence[Spec], penalizer: float = PENALIZER, skip_failed: bool = False
) -> dict[str, CoxModel]:
    """Fit many models in shared passes. Models that cannot be fitted raise, or with `skip_failed`
    are left out of the result."""
    for spec in specs:
        check_features(spec.features, placed.features)
    models: dict[str, CoxModel] = {}
    for group in _groups(placed, specs):
        models.update(_Newton(placed, group, penalizer, skip_failed).run())
    return models


def _groups(placed: Placed, specs: Sequence[Spec]) -> Iterator[list[Spec]]:
    """Models whose chunk offsets together stay inside OFFSET_BYTES."""
    group: list[Spec] = []
    used = 0
    for spec in specs:
        size = placed.chunks * (4 * len(spec.features) + 8) * 8
        if group and used + size > OFFSET_BYTES:
            yield group
            group, used = [], 0
        group.append(spec)
        used += size
    if group:
        yield group


# ---------------------------------------------------------------- passes over the placed rows


def _run_pass(
    placed: Placed,
    work: Callable[[Chunk], Iterator[tuple[int, np.ndarray]]],
    merge: Callable[[Iterator[tuple[int, int, np.ndarray]]], Iterator[tuple[int, int, np.ndarray]]] = iter,
) -> DataFrame:
    """Results of every chunk, or with `merge` what it makes of the (spec, chunk, values) of a task."""
    n_features, n_folds = len(placed.features), len(placed.folds)

    def task(batches):
        chunks = chunks_of(batches, n_features, n_folds)
        for spec, number, values in merge((spec, c.number, values) for c in chunks for spec, values in work(c)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([spec], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([np.ascontiguousarray(values).tobytes()], pa.binary()),
                ],
                names=["spec", "chunk", "payload"],
            )

    return placed.packed.mapInArrow(task, PASS_SCHEMA)


def _gather(result: DataFrame) -> Iterator[tuple[int, int, np.ndarray]]:
    table = result.toArrow()
    for spec, chunk, payload in zip(*(table.column(i).to_pylist() for i in range(3))):
        yield spec, chunk, np.frombuffer(payload)


class _View:
    """What a task needs to know about the models: columns, scaling, held-out folds."""

    def __init__(self, placed: Placed, specs: Sequence[Spec]):
        self.columns = [np.array([placed.features.index(f) for f in s.features]) for s in specs]
        self.fold = [
            None if s.fold_column is None else (placed.folds.index(s.fold_column), s.left_out) for s in specs
        ]
        self.complete = [not placed.nulls[c].any() for c in self.columns]
        self.means = [placed.means[c] for c in self.columns]
        self.stds = [np.where(placed.stds[c] > 0, placed.stds[c], 1.0) for c in self.columns]

    def rows(self, i: int, chunk: Chunk):
        """Time, event and standardised features of the rows that model i uses."""
        if self.complete[i]:
            # models without missing values that leave out the same fold use the same rows
            if self.fold[i] not in chunk.kept:
                chunk.kept[self.fold[i]] = self._chosen(i, chunk)
            keep, t, e = chunk.kept[self.fold[i]]
        else:
            keep, t, e = self._chosen(i, chunk)
        z = np.empty((len(e), len(self.columns[i])))
        for k, (column, mean, std) in enumerate(zip(self.columns[i], self.means[i], self.stds[i])):
            x = chunk.x[:, column]
            z[:, k] = ((x if keep is None else x[keep]) - mean) / std
        return t, e, z

    def _chosen(self, i: int, chunk: Chunk):
        keep = None
        if self.fold[i] is not None:
            column, left_out = self.fold[i]
            keep = chunk.folds[column] != left_out
        if not self.complete[i]:
            usable = np.isfinite(chunk.x[:, self.columns[i]]).all(axis=1)
            keep = usable if keep is None else keep & usable
        return (None, chunk.t, chunk.e) if keep is None else (keep, chunk.t[keep], chunk.e[keep])


def _moments(view: _View, active: list[int]):
    def work(chunk: Chunk):
        for i in active:
            _, e, z = view.rows(i, chunk)
            yield i, np.concatenate([[len(e), e.sum()], z.sum(axis=0), (z * z).sum(axis=0)])

    return work


def _totals(view: _View, betas: dict[int, np.ndarray]):
    """Pass 1: log scale, counts, and sums of r and r*x over all rows and over deaths."""

    def work(chunk: Chunk):
        for i, beta in betas.items():
            _, e, z = view.rows(i, chunk)
            p = len(beta)
            if len(e) == 0:
                yield i, np.concatenate([[-np.inf, 0.0, 0.0], np.zeros(2 * p + 2)])
                continue
            eta = z @ beta
            top = eta.max()
            r = np.exp(eta - top)
            dead = r * e
            yield i, np.concatenate([[top, len(e), e.sum(), r.sum(), dead.sum()], z.T @ r, z.T @ dead])

    return work


@dataclass
class _Offsets:
    """Per chunk, for one model: what the chunk must know about the other chunks."""

    shift: float
    later: np.ndarray  # (chunks, 1+p): r and r*x of all later slabs
    before: np.ndarray  # (chunks,): rows of all earlier slabs
    first_death: np.ndarray  # (chunks,): deaths in earlier chunks of the same slab
    slab: np.ndarray  # (slabs, 2+2+2p): rows, deaths, r, dead r, r*x, dead r*x


def _offsets(placed: Placed, p: int, totals: np.ndarray) -> _Offsets:
    tops = totals[:, 0]
    shift = float(tops.max())
    scale = np.where(np.isfinite(tops), np.exp(tops - shift), 0.0)
    values = totals[:, 1:].copy()
    values[:, 2:] *= scale[:, None]
    slabs = placed.slab_of_chunk[-1] + 1
    per_slab = np.zeros((slabs, values.shape[1]))
    np.add.at(per_slab, placed.slab_of_chunk, values)
    wanted = [2, *range(4, 4 + p)]
    suffix = np.cumsum(per_slab[::-1][:, wanted], axis=0)[::-1]
    later = np.vstack([suffix[1:], np.zeros((1, 1 + p))])
    before = np.concatenate([[0.0], np.cumsum(per_slab[:-1, 0])])
    deaths = np.concatenate([[0.0], np.cumsum(values[:-1, 1])])
    start = np.searchsorted(placed.slab_of_chunk, placed.slab_of_chunk)
    return _Offsets(
        shift,
        later[placed.slab_of_chunk],
        before[placed.slab_of_chunk],
        deaths - deaths[start],
        per_slab,
    )


@dataclass
class _Ties:
    """Efron terms of the event times in one chunk, one entry per event time."""

    at: np.ndarray  # row -> position of its time
    events: np.ndarray  # positions of the times with deaths
    rows: np.ndarray  # rows per time
    s1: np.ndarray
    d1: np.ndarray
    log_phi: float
    inv: np.ndarray  # sum over l of 1/phi
    frac_inv: np.ndarray  # sum over l of (l/d)/phi
    inv2: np.ndarray
    frac_inv2: np.ndarray
    frac2_inv2: np.ndarray


def _ties(t, e, z, r, offsets: _Offsets, chunk: int, hot_slab: int | None) -> _Ties:
    p = z.shape[1]
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    rows = np.diff(np.concatenate([starts, [len(t)]]))
    at = np.repeat(np.arange(len(starts)), rows)
    if hot_slab is None:
        rz, dead = r[:, None] * z, r * e
        r0 = np.add.reduceat(r, starts)
        r1 = np.add.reduceat(rz, starts, axis=0)
        d = np.add.reduceat(e, starts).astype(np.int64)
        events = np.flatnonzero(d)
        s0 = (offsets.later[chunk, 0] + np.cumsum(r0[::-1])[::-1])[events]
        s1 = (offsets.later[chunk, 1:] + np.cumsum(r1[::-1], axis=0)[::-1])[events]
        d0 = np.add.reduceat(dead, starts)[events]
        d1 = np.add.reduceat(dead[:, None] * z, starts, axis=0)[events]
        d, first, total = d[events], np.zeros(len(events), np.int64), d[events]
    else:
        # one time over several chunks: the sums come from the slab, this chunk takes its deaths' share
        slab = offsets.slab[hot_slab]
        mine = int(e.sum())
        events = np.array([0] if mine else [], dtype=np.int64)
        k = len(events)
        s0 = np.full(k, offsets.later[chunk, 0] + slab[2])
        s1 = np.tile(offsets.later[chunk, 1:] + slab[4 : 4 + p], (k, 1))
        d0 = np.full(k, slab[3])
        d1 = np.tile(slab[4 + p :], (k, 1))
        d = np.full(k, mine)
        first = np.full(k, int(offsets.first_death[chunk]))
        total = np.full(k, int(slab[1]))
        rows = np.array([int(slab[0])])
    which = np.repeat(np.arange(len(d)), d)
    step = np.arange(len(which)) - np.repeat(np.cumsum(d) - d, d) + first[which]
    frac = step / total[which]
    inv = 1.0 / (s0[which] - frac * d0[which])
    per_time = lambda v: np.bincount(which, v, minlength=len(d))
    return _Ties(
        at, events, rows, s1, d1, -float(np.log(inv).sum()),
        per_time(inv), per_time(frac * inv), per_time(inv * inv),
        per_time(frac * inv * inv), per_time(frac * frac * inv * inv),
    )


def _derivatives(view: _View, betas: dict[int, np.ndarray], offsets, slab_of_chunk, hot_slabs):
    """Pass 2. Payload: ll, a, b, gradient, sum r*x, sum dead r*x, Hessian, Gram, dead Gram."""

    def work(chunk: Chunk):
        slab = int(slab_of_chunk[chunk.number])
        hot = slab if slab in hot_slabs else None
        for i, beta in betas.items():
            t, e, z = view.rows(i, chunk)
            p = len(beta)
            if len(e) == 0:
                yield i, np.zeros(3 + 3 * p + 3 * p * p)
                continue
            off = offsets.value[i]
            eta = z @ beta - off.shift
            r = np.exp(eta)
            ties = _ties(t, e, z, r, off, chunk.number, hot)
            gram = z.T @ (z * r[:, None])
            zz = ties.s1.T @ (ties.s1 * ties.inv2[:, None])
            cross = ties.s1.T @ (ties.d1 * ties.frac_inv2[:, None])
            zz += ties.d1.T @ (ties.d1 * ties.frac2_inv2[:, None]) - cross - cross.T
            dead = r * e
            if hot is None:
                a_step, b = np.zeros(len(ties.rows)), np.zeros(len(ties.rows))
                a_step[ties.events], b[ties.events] = ties.inv, ties.frac_inv
                w = r * np.cumsum(a_step)[ties.at] - dead * b[ties.at]
                dead_sum, dead_gram = np.zeros(p), np.zeros((p, p))
            else:
                w = np.zeros(len(e))
                dead_sum, dead_gram = z.T @ dead, z.T @ (z * dead[:, None])
            gradient = z.T @ (e - w)
            hessian = zz - z.T @ (z * w[:, None])
            head = [float((eta * e).sum()) - ties.log_phi, ties.inv.sum(), ties.frac_inv.sum()]
            yield i, np.concatenate(
                [head, gradient, z.T @ r, dead_sum, hessian.ravel(), gram.ravel(), dead_gram.ravel()]
            )

    return work


def _merged_moments(found: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Moments are plain sums."""
    sums: dict[int, np.ndarray] = {}
    for i, _, payload in found:
        sums[i] = sums[i] + payload if i in sums else payload
    for i, payload in sums.items():
        yield i, 0, payload


def _merged_runs(sizes: dict[int, int], slab_of_chunk: np.ndarray, hot_slabs):
    """Pass 2 results of a task's consecutive chunks as one, under the number of the first: the hazard of
    earlier chunks of the run is applied here, that of earlier runs is still to come. A slab of several
    chunks may go on in another task, so its chunks stay as they are and end the run."""

    def merge(found: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, np.ndarray]]:
        runs: dict[int, tuple[int, np.ndarray]] = {}
        for i, chunk, payload in found:
            if int(slab_of_chunk[chunk]) in hot_slabs:
                if i in runs:
                    yield i, *runs.pop(i)
                yield i, chunk, payload
            elif i not in runs:
                runs[i] = chunk, payload
            else:
                first, run = runs[i]
                p, alpha = sizes[i], run[1]
                own = payload.copy()
                own[3 : 3 + p] -= alpha * payload[3 + p : 3 + 2 * p]
                hessian = 3 + 3 * p
                own[hessian : hessian + p * p] -= alpha * payload[hessian + p * p : hessian + 2 * p * p]
                runs[i] = first, run + own
        for i, (first, run) in runs.items():
            yield i, first, run

    return merge


def _combine(payload: np.ndarray, p: int, alpha: float, gamma: float) -> np.ndarray:
    """ll, gradient and Hessian of one chunk once the hazard before it (alpha) is known."""
    at = 3
    gradient, sums, dead_sums = (payload[at + k * p : at + (k + 1) * p] for k in range(3))
    at += 3 * p
    hessian, gram, dead_gram = (payload[at + k * p * p : at + (k + 1) * p * p] for k in range(3))
    return np.concatenate(
        [
            payload[:1],
            gradient - alpha * sums + gamma * dead_sums,
            hessian - alpha * gram + gamma * dead_gram,
        ]
    )


def _hazard_weights(placed: Placed, heads: np.ndarray):
    """alpha and gamma of each chunk from the (a, b) totals of all chunks of one model."""
    slabs = placed.slab_of_chunk[-1] + 1
    a, b = np.zeros(slabs), np.zeros(slabs)
    np.add.at(a, placed.slab_of_chunk, heads[:, 0])
    np.add.at(b, placed.slab_of_chunk, heads[:, 1])
    before = np.concatenate([[0.0], np.cumsum(a[:-1])])
    hot = np.isin(np.arange(slabs), list(placed.hot_slabs))
    alpha = np.where(hot, before + a, before)
    return alpha[placed.slab_of_chunk], np.where(hot, b, 0.0)[placed.slab_of_chunk]


def _add_up(placed: Placed, result: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Sum the chunk results of pass 2 per model."""
    volume = placed.results * sum(8 * (3 + 3 * p + 3 * p * p) for p in sizes.values())
    sums = {i: np.zeros(1 + p + p * p) for i, p in sizes.items()}
    heads = {i: np.zeros((placed.chunks, 2)) for i in sizes}
    if volume <= DRIVER_BYTES:
        payloads = list(_gather(result))
        for i, chunk, payload in payloads:
            heads[i][chunk] = payload[1:3]
        weights = {i: _hazard_weights(placed, h) for i, h in heads.items()}
        for i, chunk, payload in payloads:
            sums[i] += _combine(payload, sizes[i], weights[i][0][chunk], weights[i][1][chunk])
        return sums

    result = result.persist()
    try:
        only_head = result.select("spec", "chunk", F.substring("payload", 1, 24).alias("payload"))
        for i, chunk, payload in _gather(only_head):
            heads[i][chunk] = payload[1:3]
        weights = placed.df.sparkSession.sparkContext.broadcast(
            {i: _hazard_weights(placed, h) for i, h in heads.items()}
        )

        def add(key, table):
            spec, block = (k.as_py() for k in key)
            alpha, gamma = weights.value[spec]
            total = sum(
                _combine(np.frombuffer(payload), sizes[spec], alpha[chunk], gamma[chunk])
                for chunk, payload in zip(table.column("chunk").to_pylist(), table.column("payload").to_pylist())
            )
            return pa.table(
                {
                    "spec": pa.array([spec], pa.int32()),
                    "chunk": pa.array([block], pa.int32()),
                    "payload": pa.array([total.tobytes()], pa.binary()),
                }
            )

        # at most 64 chunk results per group
        block = F.floor(F.col("chunk") / 64).cast("int").alias("block")
        reduced = result.groupBy("spec", block).applyInArrow(add, PASS_SCHEMA)
        for i, _, payload in _gather(reduced):
            sums[i] += payload
        return sums
    finally:
        result.unpersist()


# ---------------------------------------------------------------- Newton iterations


@dataclass
class _State:
    beta: np.ndarray
    n: int = 0
    deaths: int = 0
    done: bool = False
    failed: str | None = None
    iterations: int = 0
    value: float = -np.inf  # penalised log-likelihood of the last accepted beta
    loglik: float = -np.inf
    accepted: np.ndarray | None = None
    step: np.ndarray | None = None
    gradient: np.ndarray | None = None
    hessian: np.ndarray | None = None
    halvings: int = 0


class _Newton:
    def __init__(self, placed: Placed, specs: Sequence[Spec], penalizer: float, skip_failed: bool):
        self.placed, self.specs, self.penalizer, self.skip = placed, list(specs), penalizer, skip_failed
        self.view = _View(placed, specs)
        self.states = {i: _State(np.zeros(len(s.features))) for i, s in enumerate(specs)}

    def run(self) -> dict[str, CoxModel]:
        self._standardise()
        while self._open():
            betas = {i: self.states[i].beta for i in self._open()}
            offsets = self._pass_one(betas)
            sums = self._pass_two(betas, offsets)
            for i, total in sums.items():
                self._advance(i, total)
        models = {}
        for i, spec in enumerate(self.specs):
            state = self.states[i]
            if state.failed:
                if self.skip:
                    continue
                raise ValueError(f"{spec.name}: {state.failed}")
            models[spec.name] = CoxModel(
                spec, self.penalizer, state.n, state.deaths, self.view.means[i], self.view.stds[i],
                state.accepted, state.loglik, state.value, state.gradient, state.hessian, state.iterations,
            )
        return models

    def _open(self) -> list[int]:
        return [i for i, s in self.states.items() if not s.done]

    def _standardise(self) -> None:
        """Mean and sample deviation of each model's own rows."""
        active = list(self.states)
        sums: dict[int, np.ndarray] = {}
        for i, _, payload in _gather(_run_pass(self.placed, _moments(self.view, active), _merged_moments)):
            sums[i] = sums.get(i, 0.0) + payload
        for i in active:
            state, p = self.states[i], len(self.specs[i].features)
            total = sums.get(i, np.zeros(2 + 2 * p))
            n = int(total[0])
            state.n, state.deaths = n, int(total[1])
            if n < 2 or state.deaths == 0:
                state.done, state.failed = True, "no usable rows or no events"
                continue
            mean = total[2 : 2 + p] / n
            variance = (total[2 + p :] - n * mean * mean) / (n - 1)
            if (variance <= 1e-12).any():
                names = [f for f, v in zip(self.specs[i].features, variance) if v <= 1e-12]
                state.done, state.failed = True, f"constant covariates: {names}"
                continue
            self.view.means[i] = self.view.means[i] + mean * self.view.stds[i]
            self.view.stds[i] = self.view.stds[i] * np.sqrt(variance)

    def _pass_one(self, betas) -> dict[int, _Offsets]:
        totals = {i: np.full((self.placed.chunks, 5 + 2 * len(b)), 0.0) for i, b in betas.items()}
        for table in totals.values():
            table[:, 0] = -np.inf
        for i, chunk, payload in _gather(_run_pass(self.placed, _totals(self.view, betas))):
            totals[i][chunk] = payload
        return {i: _offsets(self.placed, len(betas[i]), t) for i, t in totals.items()}

    def _pass_two(self, betas, offsets) -> dict[int, np.ndarray]:
        sent = self.placed.df.sparkSession.sparkContext.broadcast(offsets)
        work = _derivatives(self.view, betas, sent, self.placed.slab_of_chunk, self.placed.hot_slabs)
        sizes = {i: len(b) for i, b in betas.items()}
        merge = _merged_runs(sizes, self.placed.slab_of_chunk, self.placed.hot_slabs)
        try:
            return _add_up(self.placed, _run_pass(self.placed, work, merge), sizes)
        finally:
            sent.unpersist()

    def _advance(self, i: int, total: np.ndarray) -> None:
        state, p = self.states[i], len(self.states[i].beta)
        ridge = state.n * self.penalizer
        loglik = float(total[0])
        value = loglik - 0.5 * ridge * float(state.beta @ state.beta)
        state.iterations += 1
        slack = 1e-10 * max(1.0, abs(state.value)) if np.isfinite(state.value) else 0.0
        if not np.isfinite(value) or value < state.value - slack:
            state.halvings += 1
            if state.step is None or state.halvings > 30:
                state.done, state.failed = True, "the likelihood is not finite or does not increase"
                return
            state.step = state.step / 2
            state.beta = state.accepted + state.step
            return
        gain = value - state.value
        state.halvings = 0
        state.accepted, state.value, state.loglik = state.beta, value, loglik
        state.gradient = total[1 : 1 + p] - ridge * state.beta
        state.hessian = total[1 + p :].reshape(p, p) - ridge * np.eye(p)
        flat = np.linalg.norm(state.gradient) / state.n < TOLERANCE
        # a gain below rounding of the likelihood means that no further step can be judged
        settled = np.isfinite(gain) and abs(gain) < 1e-13 * max(1.0, abs(value))
        if flat or settled:
            state.done = True
            return
        if state.iterations >= MAX_ITERATIONS:
            state.done, state.failed = True, f"no convergence in {MAX_ITERATIONS} iterations"
            return
        try:
            state.step = np.linalg.solve(-state.hessian, state.gradient)
        except np.linalg.LinAlgError:
            state.done, state.failed = True, "singular Hessian"
            return
        state.beta = state.accepted + state.step


# ---------------------------------------------------------------- tables and tests of fitted models


def hazard_ratios(spark: SparkSession, model: CoxModel) -> DataFrame:
    """Hazard ratio, 95% interval and p value per covariate, strongest effect first."""
    se = np.sqrt(np.diag(model.covariance))
    rows = []
    for feature, coef, error in zip(model.features, model.coef.tolist(), se.tolist()):
        p = normal_two_sided(coef / error)
        low, high = coef - Z_95 * error, coef + Z_95 * error
        rows.append((feature, coef, error, *np.exp([coef, low, high]).tolist(), p, p < 0.05))
    schema = (
        "feature string, coef double, se double, HR double, HR_lower double, HR_upper double, "
        "p_value double, significant boolean"
    )
    return spark.createDataFrame(rows, schema).orderBy(F.abs(F.log("HR")).desc(), "feature")


def likelihood_ratio_test(full: CoxModel, restricted: CoxModel, penalized: bool = False) -> dict:
    """Does the full model fit better than the nested one? Under a ridge penalty the chi-square
    law is approximate; the unpenalised likelihoods are compared unless asked otherwise."""
    if not set(restricted.features) < set(full.features):
        raise ValueError("the restricted model must use a proper subset of the full model's covariates")
    if (full.n, full.n_events) != (restricted.n, restricted.n_events):
        raise ValueError("the two models were fitted on different rows")
    field_name = "loglik_penalized" if penalized else "loglik"
    statistic = 2.0 * (getattr(full, field_name) - getattr(restricted, field_name))
    df = len(full.features) - len(restricted.features)
    log_p = log_chi2_tail(statistic, df)
    return {
        "lr_statistic": statistic,
        "df": df,
        "p_value": float(np.exp(log_p)),
        "log_p_value": log_p,
        "significant": bool(log_p < np.log(0.05)),
    }


def save_model(spark: SparkSession, model: CoxModel, path: str, baseline: DataFrame | None = None) -> None:
    """Coefficients and covariance as Parquet tables, one folder per table; with the baseline hazard
    (`risk_sets.baseline_hazard`) the saved model can predict survival without its training rows."""
    if baseline is not None:
        baseline.select("time", "hazard", "cumulative_hazard").write.mode("overwrite").parquet(f"{path}/baseline")
    rows = [
        (i, f, float(c), float(m), float(s))
        for i, (f, c, m, s) in enumerate(zip(model.features, model.coef, model.means, model.stds))
    ]
    schema = "position int, feature string, coef double, mean double, std double"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/coefficients")
    cells = [(i, j, float(v)) for (i, j), v in np.ndenumerate(model.hessian)]
    spark.createDataFrame(cells, "row int, col int, value double").write.mode("overwrite").parquet(f"{path}/hessian")
    facts = {
        "name": model.spec.name, "penalizer": model.penalizer, "n": model.n, "n_events": model.n_events,
        "loglik": model.loglik, "loglik_penalized": model.loglik_penalized, "iterations": model.iterations,
        "gradient": model.gradient.tolist(),
    }
    spark.createDataFrame([(json.dumps(facts),)], "facts string").write.mode("overwrite").parquet(f"{path}/facts")


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The baseline hazard of a saved model, one row per distinct time."""
    return spark.read.schema("time double, hazard double, cumulative_hazard double").parquet(f"{path}/baseline")


def load_model(spark: SparkSession, path: str) -> CoxModel:
    facts = json.loads(spark.read.parquet(f"{path}/facts").first()[0])
    rows = spark.read.parquet(f"{path}/coefficients").orderBy("position").collect()
    p = len(rows)
    hessian = np.zeros((p, p))
    for cell in spark.read.parquet(f"{path}/hessian").collect():
        hessian[cell["row"], cell["col"]] = cell["value"]
    stds = np.array([r["std"] for r in rows])
    return CoxModel(
        Spec(facts["name"], tuple(r["feature"] for r in rows)), facts["penalizer"], facts["n"],
        facts["n_events"], np.array([r["mean"] for r in rows]), stds,
        np.array([r["coef"] for r in rows]) * stds, facts["loglik"], facts["loglik_penalized"],
        np.array(facts["gradient"]), hessian, facts["iterations"],
    )
