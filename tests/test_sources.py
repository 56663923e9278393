import ast
import gzip
import json
import math
import random
import warnings

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenura.operators import dataset, sampling
from tenura.plans import queries
from tenura.sources import nested, tables
from tenura.streaming.scoring import score_stream, write_scores

LONG = "a long enough review text"
REVIEWS = [
    {"user_id": "u1", "reviews": [
        {"item_id": "10", "recommend": False, "review": "\n\t " + LONG + " \n", "posted": "Posted May 1."},
        {"item_id": "11", "recommend": True, "review": "too short"},
        {"item_id": "10", "recommend": True, "review": LONG + " again"}]},
    {"user_id": "u2", "reviews": [{"item_id": 12, "review": LONG + " ünïcode"}]},
    {"reviews": [{"review": LONG, "recommend": True}]},
    {"user_id": "u3"},
]
ITEMS = [
    {"user_id": "u1", "items_count": 3, "items": [
        {"item_id": "10", "playtime_forever": 12, "playtime_2weeks": 0},
        {"item_id": "10", "playtime_forever": 600, "playtime_2weeks": 60},
        {"item_id": "10", "playtime_forever": 1200, "playtime_2weeks": 0}]},
    {"user_id": "u2", "items": [{"item_id": "12", "playtime_forever": 30}]},
    {"items": [{"playtime_forever": 120}]},
]


def write(path, records, extra=()):
    with gzip.open(path, "wt", encoding="utf-8") as f:
        for i, r in enumerate(records):
            f.write(repr(r) + "\n")
            if i == 0:
                f.writelines(line + "\n" for line in extra)
    return str(path)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base = tmp_path_factory.mktemp("raw")
    bad = ["", "   ", "{'user_id': 'broken", "{u'user_id': u'u9', u'reviews': None}", "[1, 2]"]
    return write(base / "reviews.gz", REVIEWS, bad), write(base / "items.gz", ITEMS)


def test_load_reviews(spark, files):
    flat, seen = nested.load_reviews(spark, files[0], tasks=3)
    rows = sorted(flat.collect(), key=lambda r: (r.line, r.position))
    assert seen.get["bad_lines"] == 3
    assert [(r.user_id, r.item_id, r.recommend, r.review_text) for r in rows] == [
        ("u1", "10", False, LONG), ("u1", "10", True, LONG + " again"),
        ("u2", "12", False, LONG + " ünïcode"), ("", "", True, LONG)]
    assert rows[0].posted == "Posted May 1." and rows[1].posted == ""
    counts = nested.bad_lines(nested.read_dict_lines(spark, files[0], nested.REVIEWS)).first()
    assert (counts.n_lines, counts.n_bad) == (7, 3)


def test_literals_equal_the_literal_parser():
    """Both ways of reading a line agree on every line, on its value or on refusing it."""
    rng = random.Random(7)
    pieces = ["{", "}", "[", "]", ":", ",", " ", "'a'", "u'b'", "'menu'", "'it u'", '"c"', "'d\\n'", "True", "False", "None", "true",
              "null", "NaN", "Infinity", "1", "-2", "3.5", "1e3", "01", "1.", "(", ")", "u", "'", "\xa0", "b'x'", "''", "'True'", "#"]
    lines = [repr(r) for r in REVIEWS + ITEMS] + ["{'a': true}", "{'a': 1}, {'b': 2}", "{'a': 1} \\", "{'a': 'x' 'y'}", "{'a': u'é', 'a': None}"]
    lines += ["{'k': [" + "".join(rng.choices(pieces, k=rng.randint(1, 5))) + "], 'u': False}" for _ in range(20000)]

    def read(parse, line):
        try:
            return repr(parse(line))
        except Exception:
            return None

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = [(read(nested._literal, line), read(ast.literal_eval, line)) for line in lines]
    assert all(mine == other for mine, other in found) and sum(mine is not None for mine, _ in found) > 500


def test_a_value_beyond_its_type_is_a_bad_line(spark, tmp_path):
    path = write(tmp_path / "items.gz", [ITEMS[0], {"user_id": "u9", "items_count": 2**40, "items": []}, ITEMS[1]])
    counts = nested.bad_lines(nested.read_dict_lines(spark, path, nested.ITEMS)).first()
    assert (counts.n_lines, counts.n_bad) == (3, 1)


def test_survival_table_from_raw_files(spark, files):
    reviews, _ = nested.load_reviews(spark, files[0], tasks=2)
    items, _ = nested.load_items(spark, files[1], tasks=2)
    assert items.filter("user_id = 'u1'").agg(F.max("items_count")).first()[0] == 3
    built = dataset.build_survival_table(reviews, items, nested.ORDER)
    assert tuple(built.columns) == dataset.SURVIVAL_COLUMNS
    rows = {(r.user_id, r.item_id): r for r in built.collect()}
    assert set(rows) == {("u1", "10"), ("u2", "12"), ("", "")}
    first = rows[("u1", "10")]
    # the first item row is out of range, so the second one is the first in range
    assert (first.duration, first.event, first.review_text) == (10.0, 1, LONG)
    assert first.log_playtime_2weeks == pytest.approx(math.log(2)) and first.log_items_count == pytest.approx(math.log(4))
    assert rows[("u2", "12")].event == 1 and rows[("u2", "12")].duration == 0.5
    assert rows[("", "")].event == 0
    stages = {r.stage: r.n_rows for r in dataset.stage_counts(reviews, items).collect()}
    assert stages == {"reviews": 4, "items": 5, "joined": 8, "filtered": 3}


def test_reducing_before_the_join_equals_joining_first(spark):
    reviews = spark.createDataFrame(
        [(f"u{i % 3}", "x", i % 2 == 0, LONG + str(i), i) for i in range(40)],
        "user_id string, item_id string, recommend boolean, review_text string, line int")
    items = spark.createDataFrame(
        [(f"u{i % 4}", "x", float(i % 7) / 5, 0.1, 2, i) for i in range(30)],
        "user_id string, item_id string, playtime_forever double, playtime_2weeks double, items_count int, line int")
    mine = dataset.build_survival_table(reviews, items, ["line"]).toPandas().set_index("user_id")
    naive = reviews.toPandas().merge(items.toPandas(), on=["user_id", "item_id"], suffixes=("", "_i"))
    naive = naive[naive.playtime_forever.between(0.5, 5000)].sort_values(["line", "line_i"])
    naive = naive.drop_duplicates(["user_id", "item_id"]).set_index("user_id")
    assert mine.review_text.to_dict() == naive.review_text.to_dict()
    assert mine.duration.to_dict() == naive.playtime_forever.to_dict()


def test_materialize_and_cache(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    built = []

    def build():
        built.append(1)
        return df

    path = str(tmp_path / "t")
    for _ in range(2):
        assert tables.materialize(spark, path, build, df).count() == 5
    tables.materialize(spark, path, build, df.withColumn("v", F.col("v") + 1))
    assert len(built) == 2
    tables.materialize(spark, path, build, df.withColumn("v", F.col("v") + 1), refresh=True)
    assert len(built) == 3

    asked = []

    def encode(rows):
        asked.append(sorted(r.id for r in rows.collect()))
        return rows.select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))

    cache = str(tmp_path / "vectors")
    tables.cached_vectors(spark, cache, spark.range(3), "id", encode)
    found = tables.cached_vectors(spark, cache, spark.range(2, 5), "id", encode)
    assert sorted(r.id for r in found.collect()) == [2, 3, 4] and asked == [[0, 1, 2], [3, 4]]


def test_cache_heeds_texts_and_survives_repeats(spark, tmp_path):
    asked = []

    def encode(rows):
        asked.append(sorted(r.id for r in rows.collect()))
        return rows.select("id", F.array(F.length("t").cast("double")).alias("embedding"))

    cache = str(tmp_path / "texts")
    frame = lambda rows: spark.createDataFrame(rows, "id long, t string")
    old, new = [(1, "a"), (2, "bb"), (3, None)], [(1, "a"), (2, "bbbb"), (3, None)]
    ask = lambda rows: {(r.id, r.version, r.embedding[0]) for r in tables.cached_vectors(spark, cache, frame(rows), "id", encode, "t").collect()}
    assert ask(old) == {(1, 0, 1.0), (2, 0, 2.0), (3, 0, None)}
    assert ask(new) == {(1, 0, 1.0), (2, 1, 4.0), (3, 0, None)}
    assert ask(old) == {(1, 0, 1.0), (2, 0, 2.0), (3, 0, None)}  # the old text still has its vector
    assert asked == [[1, 2, 3], [2]]
    # a version that is written but not listed is not read, and the next call writes it again
    frame([(9, "x")]).selectExpr("id", "'x' AS text_hash", "2 AS version", "array(1.0D) AS embedding").write.parquet(f"{cache}/version-2")
    assert tables.read_vectors(spark, cache, "id").filter("id = 9").count() == 0
    assert ask([(4, "dddd")]) == {(4, 2, 4.0)}
    assert tables.read_vectors(spark, cache, "id").count() == 5


def test_results_document(spark, tmp_path):
    parts = {"a": spark.createDataFrame([(1, [0.5, 0.6])], "x int, folds array<double>"),
             "b": spark.createDataFrame([("m", 2.0), ("n", None)], "name string, v double")}
    tables.write_results(parts, str(tmp_path))
    assert tables.read_table(spark, f"{tmp_path}/b").count() == 2
    saved = tables.read_document_dict(spark, str(tmp_path))
    assert saved["a"] == [{"x": 1, "folds": [0.5, 0.6]}] and saved["b"][0] == {"name": "m", "v": 2.0}
    assert tables.read_document(spark, str(tmp_path)).select(F.explode("b.name")).count() == 2


def test_split_is_exact_repeatable_and_saved(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("event"))
    one = sampling.holdout_split(df, ["id"], seed=42)
    two = sampling.holdout_split(df.repartition(7), ["id"], seed=42)
    tables.write_split(one, str(tmp_path / "s"), 42, 0.2)
    saved = tables.read_table(spark, str(tmp_path / "s"))
    side = lambda d, s: {r.id for r in d.filter(F.col("split") == s).collect()}
    assert side(one, "test") == side(two, "test") == side(saved, "test")
    assert not side(one, "test") & side(one, "train") and len(side(one, "test")) == 20
    assert one.filter("split = 'test'").groupBy("event").count().select("count").distinct().collect()[0][0] == 10
    assert tables.select_by_split(df, saved, ["id"], "test").count() == 20


@pytest.mark.parametrize("n, few", [(1000, 4096), (5000, 10)])
def test_rank_cutoffs_narrow_to_any_depth(spark, monkeypatch, n, few):
    monkeypatch.setattr(sampling, "FEW_ROWS", few)
    monkeypatch.setattr(sampling, "PREFIX_STEP", 1)
    df = spark.range(n).withColumn("h", F.md5(F.col("id").cast("string")))
    hashes = sorted(r.h for r in df.collect())
    ranks = [1, 7, n // 2, n]
    found = sampling.rank_cutoffs(df, "h", None, {0: ranks})
    assert [found[(0, r)] for r in ranks] == [hashes[r - 1] for r in ranks]
    with pytest.raises(ValueError, match="identify"):
        sampling.rank_cutoffs(df.withColumn("h", F.md5(F.lit("same"))), "h", None, {0: [3]})


def test_cap_keeps_the_event_rate(spark):
    df = spark.range(5000).select("id", (F.col("id") % 5 == 0).cast("int").alias("event"))
    kept = sampling.stratified_cap(df, 333, ["id"])
    assert {r.event: r["count"] for r in kept.groupBy("event").count().collect()} == {1: 66, 0: 267}
    assert sampling.stratified_cap(df, 5000, ["id"]).count() == 5000


def test_folds(spark):
    df = spark.range(103)
    sizes = {r.fold: r["count"] for r in sampling.with_folds(df, ["id"]).groupBy("fold").count().collect()}
    assert sizes == {0: 21, 1: 21, 2: 21, 3: 20, 4: 20}


def test_backfill(spark):
    df = spark.createDataFrame([(2.0, 0.5, 3.0)], "duration double, playtime_2wk_ratio double, playtime_2weeks double")
    value = lambda d: dataset.backfill_behaviour(d).first().log_playtime_2weeks
    assert value(df) == pytest.approx(math.log1p(0.5 * (2.0 + 1e-6)))
    assert value(df.drop("playtime_2wk_ratio")) == pytest.approx(math.log1p(3.0))
    assert value(df.select("duration")) == 0.0
    assert value(df.withColumn("log_playtime_2weeks", F.lit(9.0))) == 9.0


def test_stream_scores_each_review_once(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(i, "crash and lag, what garbage " + str(i)) for i in range(10)], "id int, review_text string")
    rows.write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(rows.schema).parquet(source)
        write_scores(score_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 10 and out.filter("technical_issue = 1").count() == 10


def test_few_lines_are_objects_at_a_time():
    batch = pa.RecordBatch.from_pydict({"value": ["x" * 100_000] * 300})
    pieces = list(nested._pieces(iter([batch, batch.slice(0, 0), batch.slice(5, 1)])))
    assert max(p.num_rows for p in pieces) <= 10 and sum(p.num_rows for p in pieces) == 301
    small = pa.RecordBatch.from_pydict({"value": ["x"] * 300})
    assert [p.num_rows for p in nested._pieces(iter([small]))] == [300]


def test_stream_reads_a_table_of_one_file_and_of_many(spark, tmp_path):
    rows = spark.createDataFrame([(i, "crash and lag, what garbage " + str(i)) for i in range(10)], "doc_id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (file,) = (tmp_path / "one").glob("part-*.parquet")
    file.rename(tmp_path / "one" / "documents.parquet")
    for folder in ("many", "one"):
        found = queries.signals_stream(spark, str(tmp_path / folder))
        assert found.count() == 10 and found.filter("technical_issue = 1").count() == 10


def test_leaves_of_documents_of_any_depth(spark):
    document = {"t": [{"a": 1, "b": {"c": [2.5, {"d": "x"}], "e": []}}, {"a": None}], "u": [{"on": True}]}
    found = tables.document_leaves(spark.createDataFrame([(json.dumps(document),)], "value string")).collect()
    assert {(r.table, r.row, r.path, r.leaf) for r in found} == {
        ("t", 0, "a", "1"), ("t", 0, "b.c.0", "2.5"), ("t", 0, "b.c.1.d", "x"), ("t", 1, "a", None), ("u", 0, "on", "true")}
    assert tables.document_leaves(spark.createDataFrame([], "value string")).count() == 0
