"""TF-IDF: vocabulary and weights from training texts, applied to any texts row by row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import literal_array, unigrams_and_bigrams, unit_length, words

# Vocabulary rules.
MIN_DOCUMENTS = 3
MAX_DOCUMENT_SHARE = 0.95
MAX_TERMS = 10_000


@dataclass
class TfidfModel:
    terms: list[str]
    idf: np.ndarray
    documents: int

    @property
    def size(self) -> int:
        return len(self.terms)

    def transform(self, df: DataFrame, text: str = "review_text", name: str = "tfidf") -> DataFrame:
        """Add the sparse unit-length weights as struct<indices, values>. Narrow: the terms of a
        text are counted inside its row, so nothing is shuffled."""
        counter = CountVectorizerModel.from_vocabulary(self.terms, "_terms", "_counts")
        counted = counter.transform(df.withColumn("_terms", unigrams_and_bigrams(words(text))))
        raw = F.unwrap_udt("_counts")
        idf = literal_array(self.idf.tolist(), "double")
        weights = F.zip_with(
            raw["values"],
            F.transform(raw["indices"], lambda i: F.element_at(idf, i + 1)),
            lambda tf, scale: (1 + F.log(tf)) * scale,
        )
        return counted.withColumn(
            name,
            F.struct(raw["indices"].alias("indices"), unit_length(weights).alias("values")),
        ).drop("_terms", "_counts")


def term_statistics(df: DataFrame, text: str = "review_text") -> DataFrame:
    """Total count and document count per term. Both are summed from one pass over the texts, and
    the shuffle carries one partial sum per term, not (document, term) pairs."""
    terms = df.select(unigrams_and_bigrams(words(text)).alias("terms"))
    # all terms of a text, and once more the distinct ones
    both = F.array(
        F.struct(F.lit(1).alias("tf"), F.lit(0).alias("df"), F.col("terms").alias("terms")),
        F.struct(F.lit(0).alias("tf"), F.lit(1).alias("df"), F.array_distinct("terms").alias("terms")),
    )
    return (
        terms.select(F.explode(both).alias("b"))
        .select("b.tf", "b.df", F.explode("b.terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    )


def vocabulary(
    df: DataFrame,
    documents: int,
    text: str = "review_text",
    min_documents: int = MIN_DOCUMENTS,
    max_share: float = MAX_DOCUMENT_SHARE,
    max_terms: int = MAX_TERMS,
) -> DataFrame:
    """Terms kept: neither rare nor in nearly every document, the most frequent first up to the
    vocabulary size, ties by term; with smooth inverse document frequency."""
    kept = term_statistics(df, text).filter(
        (F.col("df") >= min_documents) & (F.col("df") <= F.lit(max_share * documents))
    )
    idf = F.log(F.lit(1.0 + documents) / (1 + F.col("df"))) + 1
    return kept.orderBy(F.col("tf").desc(), "term").limit(max_terms).withColumn("idf", idf)


def fit_tfidf(train: DataFrame, text: str = "review_text", **rules) -> TfidfModel:
    documents = train.count()
    # at most max_terms rows
    rows = sorted(vocabulary(train, documents, text, **rules).select("term", "idf").collect())
    if not rows:
        raise ValueError("no term is frequent enough")
    return TfidfModel([r["term"] for r in rows], np.array([r["idf"] for r in rows]), documents)


def weight_rows(df: DataFrame, model: TfidfModel, key: str, tfidf: str = "tfidf") -> DataFrame:
    """Long form of the weights: (key, term, weight)."""
    names = F.split(F.lit("\n".join(model.terms)), "\n")
    pairs = F.explode(F.arrays_zip(f"{tfidf}.indices", f"{tfidf}.values")).alias("p")
    return df.select(key, pairs).select(
        key, F.element_at(names, F.col("p.indices") + 1).alias("term"), F.col("p.values").alias("weight")
    )
