"""Fitting and scoring many Cox variants together: cross-validation, hold-out and apparent C."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.lineage import staged
from tenura.operators.concordance import concordance
from tenura.operators.cox import PENALIZER, CoxModel, Spec, check_features, fit_many
from tenura.operators.layout import Placed, place, single_rows
from tenura.operators.sampling import FOLD_SEED, FOLDS, with_folds

# Risks are compared after rounding, so equal covariates always give equal risks.
RISK_DIGITS = 10


def score_rows(
    rows: DataFrame | Placed,
    features: Sequence[str],
    jobs: Sequence[tuple[str, CoxModel, bool]],
    folds: Sequence[str] = (),
) -> DataFrame:
    """Long rows (label, duration, event, risk), one per model and row it can score.

    `rows` has _t, _e, one column per feature in order (x0, x1, ...) and one per name in `folds`
    (k0, k1, ...), or is placed. A job flagged as held out scores only the fold its model left out.
    """
    plan = []
    for label, model, held_out in jobs:
        columns = [features.index(f) for f in model.features]
        fold = f"k{folds.index(model.spec.fold_column)}" if held_out else None
        plan.append((label, columns, model.coef, model.means, fold, model.spec.left_out))
    needed = sorted({c for _, columns, *_ in plan for c in columns})
    names = ["_t", "_e", *[f"x{c}" for c in needed], *sorted({p[4] for p in plan if p[4]})]
    if isinstance(rows, Placed):
        kinds = {n: rows.kinds[n] for n in names}
        kept = rows.packed.select("_chunk", "_rows", *names)
    else:
        kinds, kept = {}, rows.select(*names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in single_rows(batches, kinds) if kinds else batches:
            x = {c: batch.column(f"x{c}").to_numpy(zero_copy_only=False) for c in needed}
            for label, columns, coef, means, fold, left_out in plan:
                matrix = np.column_stack([x[c] for c in columns])
                keep = np.isfinite(matrix).all(axis=1)
                if fold is not None:
                    keep &= batch.column(fold).to_numpy(zero_copy_only=False) == left_out
                if not keep.any():
                    continue
                risk = np.round((matrix[keep] - means) @ coef, RISK_DIGITS) + 0.0
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([label] * len(risk)),
                        batch.column("_t").filter(mask),
                        batch.column("_e").filter(mask),
                        pa.array(risk),
                    ],
                    names=["label", "duration", "event", "risk"],
                )

    return kept.mapInArrow(task, "label string, duration double, event int, risk double")


def plain_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.dropna(subset=["duration", "event"]).select(
        F.col("duration").cast("double").alias("_t"),
        F.col("event").cast("int").alias("_e"),
        *[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f"x{i}") for i, f in enumerate(features)],
    )


@dataclass
class Results:
    """Models fitted on all training rows, and every concordance that was asked for."""

    variants: dict[str, tuple[str, ...]]
    models: dict[str, CoxModel]
    folds: dict[str, list[float | None]]
    apparent: dict[str, float | None]
    holdout: dict[str, float | None]
    extra: dict = field(default_factory=dict)

    def mean(self, variant: str) -> float | None:
        scores = [s for s in self.folds.get(variant, []) if s is not None]
        return float(np.mean(scores)) if scores else None

    def std(self, variant: str) -> float | None:
        """Population deviation over the folds."""
        scores = [s for s in self.folds.get(variant, []) if s is not None]
        return float(np.std(scores)) if scores else None

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (v, len(f), list(f), self.mean(v), self.std(v), self.folds.get(v), self.holdout.get(v), self.apparent.get(v))
            for v, f in self.variants.items()
        ]
        schema = (
            "variant string, n_features int, features array<string>, cv_mean double, cv_std double, "
            "cv_folds array<double>, holdout_cindex double, apparent_cindex double"
        )
        return spark.createDataFrame(rows, schema)


def evaluate(
    train: DataFrame,
    variants: dict[str, Sequence[str]],
    keys: Sequence[str],
    test: DataFrame | None = None,
    folds: int = FOLDS,
    seed: int = FOLD_SEED,
    penalizer: float = PENALIZER,
    apparent: bool = True,
    full: bool = True,
    skip_failed: bool = False,
) -> Results:
    """Fit every variant on all training rows and on the rows outside each fold, then score.

    All fits share the same passes over the placed rows, and one concordance run scores all of
    them. A variant that is missing values gets its own folds over its complete rows. With
    `folds` = 0 there is no cross-validation.
    """
    variants = {name: tuple(f) for name, f in variants.items()}
    features = list(dict.fromkeys(f for fs in variants.values() for f in fs))
    check_features(features, train.columns)
    keys = list(keys)
    train = staged(train.select(*dict.fromkeys([*keys, "duration", "event", *features])))
    fold_column: dict[str, str] = {}
    if folds > 0:
        train, fold_column = _assign_folds(train, variants, features, keys, folds, seed)
    fold_columns = sorted(set(fold_column.values()))
    placed = place(train, features, fold_columns, keys)
    try:
        specs = [Spec(f"{v}#{k}", f, fold_column[v], k) for v, f in variants.items() for k in range(folds)]
        if full:
            specs += [Spec(v, f) for v, f in variants.items()]
        fitted = fit_many(placed, specs, penalizer, skip_failed)
        jobs = [(name, m, True) for name, m in fitted.items() if m.spec.fold_column is not None]
        whole = [(name, m, False) for name, m in fitted.items() if m.spec.fold_column is None]
        scored = score_rows(placed, placed.features, jobs, placed.folds) if jobs else None
        if apparent and whole:
            own = score_rows(placed, placed.features, [(f"{n}#apparent", m, f) for n, m, f in whole])
            scored = own if scored is None else scored.unionByName(own)
        if test is not None and whole:
            held = score_rows(plain_rows(test, features), features, [(f"{n}#holdout", m, f) for n, m, f in whole])
            scored = held if scored is None else scored.unionByName(held)
        found = {r["label"]: r["cindex"] for r in concordance(scored, "label").collect()} if scored is not None else {}
    finally:
        placed.release()
    return Results(
        variants,
        {name: m for name, m, _ in whole},
        {v: [found.get(f"{v}#{k}") for k in range(folds)] for v in variants},
        {v: found.get(f"{v}#apparent") for v in variants},
        {v: found.get(f"{v}#holdout") for v in variants},
    )


def _assign_folds(train, variants, features, keys, folds, seed):
    """Fold columns: one for variants without missing values, one per other set of nullable features."""
    nulls = train.agg(
        *[
            F.count(F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")), 1)).alias(f"n{i}")
            for i, f in enumerate(features)
        ]
    ).first()
    nullable = {f for i, f in enumerate(features) if nulls[i] > 0}
    groups: dict[frozenset, str] = {}
    column_of = {}
    for variant, fs in variants.items():
        missing = frozenset(nullable & set(fs))
        column_of[variant] = groups.setdefault(missing, f"fold_{len(groups)}")
    complete = train.dropna(subset=["duration", "event"])
    for missing, name in groups.items():
        usable = complete
        for f in missing:
            usable = usable.filter(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")))
        # cutoffs come from the usable rows, the fold expression is then applied to all rows
        train = with_folds(train, keys, folds, seed, name, basis=usable)
    return train, column_of


def cv_cindex(df: DataFrame, features: Sequence[str], keys: Sequence[str], **options) -> dict:
    """Cross-validated concordance of one covariate set: mean, population std, folds."""
    found = evaluate(df, {"model": features}, keys, apparent=False, full=False, **options)
    return {"mean": found.mean("model"), "std": found.std("model"), "folds": found.folds["model"]}


def cindex_on(df: DataFrame, model: CoxModel) -> float | None:
    """Concordance of a fitted model on any rows."""
    rows = plain_rows(df, model.features)
    return concordance(score_rows(rows, model.features, [("c", model, False)]), "label").first()["cindex"]


def univariate_cindex(df: DataFrame, features: Sequence[str], keys: Sequence[str], **options) -> DataFrame:
    """Cross-validated concordance of each covariate on its own, best first. A fold whose fit fails
    is left out of the mean."""
    found = evaluate(df, {f: (f,) for f in features}, keys, apparent=False, full=False, skip_failed=True, **options)
    rows = [(f, found.mean(f)) for f in features]
    frame = df.sparkSession.createDataFrame(rows, "feature string, univariate_c double")
    return frame.orderBy(F.col("univariate_c").desc(), "feature")
