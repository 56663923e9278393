"""Reading nested records: one Python dict literal per line, usually gzipped."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tenura.functions.columns import field_or, hours, stripped
from tenura.operators.dataset import with_enough_text


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


REVIEW = _record(item_id=T.StringType(), recommend=T.BooleanType(), review=T.StringType(), posted=T.StringType())
ITEM = _record(item_id=T.StringType(), playtime_forever=T.DoubleType(), playtime_2weeks=T.DoubleType())
REVIEWS = _record(user_id=T.StringType(), reviews=T.ArrayType(REVIEW))
ITEMS = _record(user_id=T.StringType(), items_count=T.IntegerType(), items=T.ArrayType(ITEM))
ORDER = ("file", "line", "position")


def _typed(kind: T.DataType) -> Callable:
    """A function that brings a literal's value to the declared type; fields that a record lacks stay None."""
    if isinstance(kind, T.StructType):
        fields = [(f.name, _typed(f.dataType)) for f in kind]

        def record(value):
            if not isinstance(value, dict):
                raise ValueError("not a record")
            return {name: cast(value[name]) if name in value else None for name, cast in fields}

        return record
    if isinstance(kind, T.ArrayType):
        element = _typed(kind.elementType)
        return lambda value: [element(v) for v in value]
    if isinstance(kind, T.BooleanType):
        return bool
    if isinstance(kind, T.StringType):
        return str
    return int if isinstance(kind, T.IntegerType) else float


#: What may stand between the strings of a literal that is JSON but for its quotes and constants.
_BARE = re.compile(r"[\s\d{}\[\]:,.eE+-]*(?:(?:True|False|None)[\s\d{}\[\]:,.eE+-]*)*")
_JSON = json.JSONDecoder()


def _literal(line: str):
    """The value of a literal. Lines whose strings are all in single quotes, without escapes, are read by the
    JSON scanner; whatever that refuses, and every other line, by the literal parser, whose word is final."""
    if "\\" not in line and '"' not in line:
        parts = line.split("'")
        outside = parts[::2]
        if "u'" in line:
            outside = [*(part.removesuffix("u") for part in outside[: len(parts) // 2]), *outside[len(parts) // 2 :]]
        bare = " ".join(outside)
        if len(parts) % 2 and _BARE.fullmatch(bare):
            if "T" in bare or "F" in bare or "N" in bare:
                outside = [p.replace("True", "true").replace("False", "false").replace("None", "null") for p in outside]
            parts[::2] = outside
            try:
                return _JSON.decode('"'.join(parts))
            except ValueError:
                pass
    return ast.literal_eval(line)


def read_dict_lines(spark: SparkSession, path: str, schema: T.StructType, tasks: int | None = None) -> DataFrame:
    """Parse each line as a literal under an explicit schema.

    Blank lines are dropped. A line that cannot be parsed keeps its text in `_corrupt`, and all
    other fields NULL. `file` and `line` give the original order. A gzip file is read by one task,
    so lines are spread before they are parsed.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.input_file_name().alias("file"),
            # rises in file order inside the one task that reads a compressed file
            F.monotonically_increasing_id().alias("line"),
            "value",
        )
        .filter(stripped("value") != "")
    )
    # without a number, AQE sizes the tasks by the volume of the lines
    lines = lines.repartition(tasks) if tasks else lines.hint("rebalance")
    out = T.StructType([*_order_fields(), *schema.fields, T.StructField("_corrupt", T.StringType())])

    arrow = to_arrow_schema(out)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty, typed = dict.fromkeys(schema.names), _typed(schema)
        fields = pa.struct([arrow.field(name) for name in (*schema.names, "_corrupt")])
        for batch in _pieces(batches):
            rows = []
            for text in batch.column("value").to_pylist():
                try:
                    row = typed(_literal(text.strip()))
                    row["_corrupt"] = None
                except Exception:  # any malformed line is counted, never fatal
                    row = {**empty, "_corrupt": text}
                rows.append(row)
            try:
                found = pa.array(rows, fields)
            except (pa.ArrowException, ValueError, OverflowError):  # a value beyond its type, in some line
                found = pa.array([_fitting(r, t, empty, fields) for r, t in zip(rows, batch.column("value").to_pylist())], fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("line").cast(pa.int64()), *found.flatten()], schema=arrow
            )

    return lines.mapInArrow(parse, out)


#: Lines of so many bytes are Python objects at a time, however many an Arrow batch holds.
PIECE_BYTES = 1 << 20


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _fitting(row: dict, text: str, empty: dict, fields: pa.DataType) -> dict:
    try:
        pa.array([row], fields)
    except (pa.ArrowException, ValueError, OverflowError):
        return {**empty, "_corrupt": text}
    return row


def _order_fields() -> list[T.StructField]:
    return [T.StructField("file", T.StringType()), T.StructField("line", T.LongType())]


def counted(records: DataFrame, name: str = "bad_lines") -> tuple[DataFrame, Observation]:
    """Drop unparsable lines and count them on the way; read the count after an action with
    `observation.get["bad_lines"]`. The count belongs to an action that reads the lines once, such
    as a write; a global sort samples its input and counts twice (`bad_lines` never does)."""
    observation = Observation()
    marked = records.observe(observation, F.count_if(F.col("_corrupt").isNotNull()).alias(name))
    return marked.filter(F.col("_corrupt").isNull()).drop("_corrupt"), observation


def bad_lines(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("_corrupt").isNotNull()).alias("n_bad")
    )


def flatten_reviews(records: DataFrame) -> DataFrame:
    """One row per review with enough text; absent fields take their defaults."""
    exploded = records.select(
        "file", "line", field_or("user_id", "").alias("user_id"), F.posexplode("reviews").alias("position", "r")
    )
    flat = exploded.select(
        *ORDER,
        "user_id",
        field_or("r.item_id", "").alias("item_id"),
        field_or("r.recommend", False).alias("recommend"),
        stripped(field_or("r.review", "")).alias("review_text"),
        field_or("r.posted", "").alias("posted"),
    )
    return with_enough_text(flat)


def flatten_items(records: DataFrame) -> DataFrame:
    """One row per owned item, play time in hours, the owner's item count carried down."""
    exploded = records.select(
        "file", "line", field_or("user_id", "").alias("user_id"), field_or("items_count", 0).alias("items_count"),
        F.posexplode("items").alias("position", "i"),
    )
    return exploded.select(
        *ORDER,
        "user_id",
        field_or("i.item_id", "").alias("item_id"),
        hours("i.playtime_forever").alias("playtime_forever"),
        hours("i.playtime_2weeks").alias("playtime_2weeks"),
        "items_count",
    )


def load_reviews(spark: SparkSession, path: str, tasks: int | None = None) -> tuple[DataFrame, Observation]:
    records, observation = counted(read_dict_lines(spark, path, REVIEWS, tasks))
    return flatten_reviews(records), observation


def load_items(spark: SparkSession, path: str, tasks: int | None = None) -> tuple[DataFrame, Observation]:
    records, observation = counted(read_dict_lines(spark, path, ITEMS, tasks))
    return flatten_items(records), observation
