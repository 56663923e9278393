"""Vector codes by per-dimension value dictionaries.

Vectors of integers are kept in blocks: each dimension of a block has a dictionary of its distinct values and
one small code a vector. To compare a block with a codebook, the squared differences of every distinct value to
every entry are tabulated once a dimension; the distance of a part to all entries is then a gather of table
rows by the codes and an add a dimension. Codebooks are fitted on all vectors, in rounds of one scan each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.lineage import staged
from tenura.llm.common import table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in a block: codes fit 16 bits, tables and distances of a block stay in a few megabytes.
BLOCK = 4096
#: Integers beyond this saturate, so that sums of squared differences are exact in 64 bits.
LARGEST = 1 << 26

BLOCKS = "rows array<struct<vec_id: long, label: string>>, values array<binary>, codes binary"


def integers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, ints) of the rows whose vector is present and finite throughout: floor(scale * x)."""
    x = F.col("x")
    # a double, so that the product is exact; nan and infinities lie outside every range
    whole = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.expr("embedding is not null and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    label = F.col("label").cast("string") if "label" in embeddings.columns else F.lit(None).cast("string")
    return (
        embeddings.filter(sound)
        .select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole.alias("x"))
        .select(
            "vec_id",
            "label",
            # a product beyond the doubles is infinite, so it is bounded before it becomes an integer
            F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(LARGEST)), F.lit(-LARGEST)))).alias("ints"),
        )
    )


def block_of(ints: np.ndarray) -> tuple[list[bytes], bytes]:
    """The dictionaries of a block's dimensions and its codes, a column a dimension."""
    values, codes = [], np.empty(ints.shape[::-1], "<u2")
    for d in range(ints.shape[1]):
        distinct, code = np.unique(ints[:, d], return_inverse=True)
        values.append(distinct.astype("<i4").tobytes())
        codes[d] = code
    return values, codes.tobytes()


def blocks(vectors: DataFrame, dims: int, padded: int, block: int = BLOCK) -> DataFrame:
    """`vectors` (vec_id, label, ints) as dictionary-coded blocks; a task's last block is shorter. Vectors of
    `dims` dimensions are padded with zeros to `padded`."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(
            [("rows", pa.list_(pa.struct([("vec_id", pa.int64()), ("label", pa.string())]))),
             ("values", pa.list_(pa.binary())), ("codes", pa.binary())]
        )
        held, n = [], 0

        def close(tables: pa.Table) -> pa.RecordBatch:
            ints = tables.column("ints").combine_chunks()
            if isinstance(ints, pa.ChunkedArray):
                ints = ints.chunk(0)
            flat = np.zeros((tables.num_rows, padded), np.int64)
            flat[:, :dims] = ints.flatten().to_numpy().reshape(tables.num_rows, dims)
            values, codes = block_of(flat)
            rows = tables.select(["vec_id", "label"]).to_pylist()
            return pa.RecordBatch.from_pylist([{"rows": rows, "values": values, "codes": codes}], kind)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= block:
                whole = pa.Table.from_batches(held)
                yield close(whole.slice(0, block))
                held, n = whole.slice(block).to_batches(), n - block
        if n:
            yield close(pa.Table.from_batches(held))

    return staged(vectors.mapInArrow(pack, BLOCKS))


def opened(values: list[bytes], codes: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    dictionaries = [np.frombuffer(v, "<i4").astype(np.int64) for v in values]
    return dictionaries, np.frombuffer(codes, "<u2").reshape(len(values), -1)


def nearest(dictionaries: list[np.ndarray], codes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one part of a block, each vector's nearest entry of `book` (entries x dimensions; ties to the
    lower index) and its squared distance."""
    span = max(int(np.abs(book).max(initial=0)), max(int(np.abs(v).max(initial=0)) for v in dictionaries))
    kind = np.int32 if (2 * span) ** 2 * len(dictionaries) < 2**31 else np.int64  # exact either way
    total = np.zeros((codes.shape[1], len(book)), kind)
    for d, distinct in enumerate(dictionaries):
        table = ((distinct[:, None] - book[None, :, d]) ** 2).astype(kind)
        total += table[codes[d]]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best].astype(np.int64)


def _parts(books: np.ndarray, row: dict):
    """Each part position of a block with its codebook."""
    dictionaries, codes = opened(row["values"], row["codes"])
    width = books.shape[2]
    for p, book in enumerate(books):
        own = slice(p * width, (p + 1) * width)
        yield p, dictionaries[own], codes[own], book


def sums_of(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums): how many parts each entry is nearest to, and their sum; one row a task and
    used entry is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in batch.select(["values", "codes"]).to_pylist():
                for p, dictionaries, codes, book in _parts(books, row):
                    best, _ = nearest(dictionaries, codes, book)
                    n[p] += np.bincount(best, minlength=len(book))
                    for d, distinct in enumerate(dictionaries):
                        # exact: a block's sums stay far below 2^53
                        total[p, :, d] += np.bincount(best, distinct[codes[d]], len(book)).astype(np.int64)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]),
             pa.array(list(total[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    rows = coded.mapInArrow(add, "part int, entry int, n long, sums array<long>")
    each = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(books.shape[2])]
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).select(
        "part", "entry", "n", F.array(*[f"s{d}" for d in range(books.shape[2])]).alias("sums")
    )


def books_sha256(books: np.ndarray) -> str:
    """Digest of all entries' integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fit(coded: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after `rounds` rounds over all blocks: every entry becomes the floor of the mean of its
    parts, an unused entry stays. The driver sees one row an entry."""
    for _ in range(rounds):
        books = books.copy()
        for r in sums_of(coded, books).collect():
            books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books


def encode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector in the blocks."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [nearest(ds, cs, book) for _, ds, cs, book in _parts(books, row)]
                codes = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["vec_id"] for r in row["rows"]], pa.int64()),
                     pa.array([r["label"] for r in row["rows"]], pa.string()),
                     pa.array([bytes(c).hex() for c in codes]), pa.array(sum(e for _, e in found))],
                    ["vec_id", "label", "code", "error"],
                )

    return coded.mapInArrow(code, "vec_id long, label string, code string, error long")


def first_vectors(vectors: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """The vectors of the smallest vec_ids, ascending (missing ids last, ties by the vector): a bounded top-k."""
    first = vectors.select("vec_id", "ints").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    return [r["ints"] for r in first]


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """Code each sound vector of `embeddings` (vec_id, embedding, label): (vec_id, code, error, label_error,
    codebooks_sha256).

    Rows whose vector is missing or holds a missing or non-finite component are left out. Vectors whose length
    differs from that of the smallest vec_id's vector cannot be compared with the codebooks: they stay, with no
    code and no error. A length that does not divide by `parts` is filled up with zeros, and components beyond
    +-65536 count as such. Fewer than `entries` vectors give a smaller codebook; an empty table gives no rows.
    Equal rows are coded each; a missing label is a label of its own.

    Plan: one scan writes the blocks, each round and the coding scan them again. Shuffled are sums of entries,
    and one row a vector for the join with its label's sum; that side holds one row a label, so AQE may split
    a hot label's rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    vectors = integers(embeddings)
    first = first_vectors(vectors, entries)
    dims = len(first[0]) if first else 0
    padded = max(-(-dims // parts), 1) * parts
    start = np.zeros((sum(len(v) == dims for v in first), padded), np.int64)
    start[:, :dims] = np.array([v for v in first if len(v) == dims], np.int64).reshape(len(start), dims)
    books = np.ascontiguousarray(start.reshape(len(start), parts, padded // parts).transpose(1, 0, 2))
    coded = blocks(vectors.filter(F.size("ints") == dims), dims, padded, block)
    books = fit(coded, books, rounds)
    no_code = F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")
    rows = staged(encode(coded, books).unionByName(vectors.filter(F.size("ints") != dims).select("vec_id", "label", *no_code)))
    totals = rows.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all `embeddings`; see `compress` for missing, odd and repeated rows."""
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """DuckDB: each round written out; distances by dot products of integers, exact in doubles."""
    steps = [
        """WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (SELECT r, p, x[16 * p + 1 : 16 * p + 16] AS x FROM kept, range(4) AS t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 256)"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (
  SELECT r, p, first(x) AS x, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c),
         'e': e}}) AS best FROM parts JOIN book{k} USING (p) GROUP BY r, p)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""mean{k} AS (
  SELECT p, e, list(m ORDER BY i) AS m FROM (
    SELECT p, best.e AS e, i, floor(sum(x[i]) / count(*)) AS m FROM near{k}, range(1, 17) AS t(i) GROUP BY ALL)
  GROUP BY p, e),
book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e))"""
            )
    steps.append(
        f"""coded AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY r),
books AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda v: v::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256
  FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books"""
    )
    return ",\n".join(steps)


ORACLE = _oracle()
