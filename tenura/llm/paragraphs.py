"""Substring dedup: paragraphs that repeat, alike or nearly, in several documents.

Paragraphs (lines) of SHINGLE words or more get MinHash values of their word shingles; bands tuned
for high recall bring candidates together, exact Jaccard similarity decides, and clusters are connected
components. Passages set into the middle of other paragraphs repeat in their windows of WINDOW words, which
heed no line or sentence end, and in inner sentences too short for a window, which are compared for equality. A
document loses a run of repeated paragraphs, sentences and windows of RUN words or more if each also
stands in a document of smaller doc_id.

Windows are compared in two steps. The least hash of the SEED-word sequences inside a window names it by
its content alone; only windows whose name several documents have are compared as a whole. Equal stretches of
WINDOW words or more are thus found from their first to their last word, wherever they stand.

Lines, sentences, names, windows and bands are very many, so none of them is a row. A slice of the texts holds its own
as arrays, asks for each distinct one once, and gets back those that others have (`answers`).

Texts are split into words twice: once for lines, sentences and names, and once more, where something in them
may repeat, for the shingles of candidate lines and the windows of shared names.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.lineage import dropped, staged
from tenura.llm.common import components, table, texts
from tenura.llm.pivot_simhash import local_stars

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.98
#: Words of the shortest run that is removed: common headings and mottoes stay.
RUN = 25
#: Words of a window and of the sequences that name it: powers of two, hashed by doubling.
WINDOW, SEED = 16, 8
#: Rows of whole bands compared at a time, group size up to which all pairs are listed, and that from which a
#: band is dealt again by rare shingles.
CHUNK, SMALL, LARGE = 20_000, 32, 128
#: Bytes of text split into words at a time, and keys that one task compares, on average.
SLICE, PART = 4_000_000, 600_000
#: Values hashed at a time, so that they stay in the processor's cache.
BLOCK = 1 << 15

WORD = re.compile(r"\S+")
STOPS = np.frombuffer(b".!?", np.uint8)
#: What a row of `marks_of` is about.
LINE, SENTENCE, NAME = 0, 1, 2


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, most_values: int = 64) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest chance collisions, with which pairs at
    `similarity` meet with probability `recall`, from at most `most_values` MinHash values."""
    best = (1, 1)
    for rows in range(1, most_values + 1):
        for bands in range(1, most_values // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                best = (bands, rows)
                break
    return best


BANDS, ROWS = tune_bands(most_values=20)
_RANDOM = np.random.default_rng(8)
MULTIPLY = _RANDOM.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
#: A number for each byte at each of the first places of a word.
BYTES = np.random.default_rng(12).integers(0, 2**64, (64, 256), dtype=np.uint64)
PLACES = _RANDOM.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    rest = x >> np.uint64(31)
    x = x ^ rest
    x *= np.uint64(0x9E3779B97F4A7C15)
    rest = np.right_shift(x, np.uint64(29), out=rest)
    x ^= rest
    x *= np.uint64(0xBF58476D1CE4E5B9)
    rest = np.right_shift(x, np.uint64(32), out=rest)
    x ^= rest
    return x


def _words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, whether they end a sentence, and the bounds of each line's. Words are lower-cased runs
    without white space."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(lines))
    flat = words.flatten()
    kept = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(kept)])[np.asarray(words.offsets) - words.offsets[0].as_py()]
    coded = flat.filter(pa.array(kept)).dictionary_encode()
    if not len(coded.dictionary):
        return np.zeros(0, np.uint64), np.zeros(0, bool), bounds
    codes = coded.indices.to_numpy()
    hashes, stops = _hashed(coded.dictionary)
    return hashes[codes], stops[codes], bounds


def _hashed(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, none of them empty, and whether it ends a sentence: random numbers for a byte at its
    place, added up and mixed. The places after the table's last begin again at other multiples."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    place = np.arange(len(bytes_)) - np.repeat(ends[:-1], np.diff(ends))
    numbers = BYTES[place % len(BYTES), bytes_]
    late = np.flatnonzero(place >= len(BYTES))
    if len(late):
        numbers[late] = _mix(numbers[late] + (place[late] // len(BYTES)).astype(np.uint64))
    return _mix(np.add.reduceat(numbers, ends[:-1])), np.isin(bytes_[ends[1:] - 1], STOPS)


def shingled(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of word hashes, run k being hashes[bounds[k]:bounds[k + 1]]: the key of each, and the hashes of its
    shingles with their bounds. A run short of a shingle has one of all its words."""
    n_words = np.diff(bounds)
    sizes = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - (ends - sizes)[row]
    at = bounds[:-1][row] + place
    shingles = np.zeros(len(row), np.uint64)
    for k in range(SHINGLE):
        inside = at + k < bounds[1:][row]
        shingles[inside] += _mix(hashes[(at + k)[inside]] + np.uint64(k)) * PLACES[k]
    shingles = _mix(shingles)
    # the key depends on all shingles in their order
    keys = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        keys[full] = np.add.reduceat(_mix(shingles + place.astype(np.uint64)), (ends - sizes)[full])
    return _mix(keys), shingles, np.concatenate([[0], ends])


def _picked(bounds: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items of chosen runs, end to end, and the new bounds."""
    sizes = np.diff(bounds)[chosen]
    ends = np.cumsum(sizes)
    return np.repeat(bounds[:-1][chosen] - (ends - sizes), sizes) + np.arange(sizes.sum()), np.concatenate([[0], ends])


def band_keys(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit key a line and band; all lines have shingles."""
    out = np.zeros((len(bounds) - 1, BANDS), np.uint64)
    cuts = np.append(_begins(bounds[:-1] // BLOCK), len(bounds) - 1).tolist()
    for a, b in itertools.pairwise(cuts):
        some, at = shingles[bounds[a] : bounds[b]], bounds[a:b] - bounds[a]
        for k in range(BANDS * ROWS):
            least = np.minimum.reduceat(_mix(some * MULTIPLY[k] + ADD[k]), at)
            out[a:b, k // ROWS] = _mix(out[a:b, k // ROWS] + least)
    return _mix(out + np.arange(BANDS, dtype=np.uint64))


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))


def _flat(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """The values of a list column, end to end."""
    column = rows.column(name)
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)


def _numbers() -> Iterator[int]:
    """Numbers that no other task of the stage gives."""
    return itertools.count(TaskContext.get().partitionId() << 32)


def answers(
    slices: DataFrame, read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], n: int, later: bool = False
) -> DataFrame:
    """(slice, keys, least) for staged `slices`, a row each, of which `read` gives (keys, owners): the keys that
    several owners have, with the least owner; if `later`, only if the slice has a greater one. `n` is the number of all keys.
    A slice asks once for a key with its least and greatest owner, so that a very common key is met by as many rows as there are
    slices."""
    parts = max(1, -(-n // PART))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, owners = read(batch.slice(k, 1))
                if not len(keys):
                    continue
                order = np.argsort(keys)
                keys, owners = keys[order], owners[order]
                first = _begins(keys)
                keys, lo, hi = keys[first], np.minimum.reduceat(owners, first), np.maximum.reduceat(owners, first)
                part = (((keys & np.uint64(0xFFFFFFFF)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
                order = np.argsort(part, kind="stable")
                first = _begins(part[order])
                bounds = np.append(first, len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[order][first].astype(np.int32)), batch.column("slice").take(pa.array(np.full(len(first), k))),
                     _lists(keys[order], bounds), _lists(lo[order], bounds), _lists((hi - lo)[order], bounds)],
                    ["part", "slice", "keys", "lo", "more"],
                )

    def meet(rows: pa.Table) -> pa.Table:
        keys, lo = _flat(rows, "keys"), _flat(rows, "lo")
        hi = lo + _flat(rows, "more")
        order = np.argsort(keys)
        first = _begins(keys[order])
        sizes = np.diff(np.append(first, len(keys)))
        least = np.empty_like(lo)
        least[order] = np.repeat(np.minimum.reduceat(lo[order], first), sizes)
        if not later:
            hi[order] = np.repeat(np.maximum.reduceat(hi[order], first), sizes)
        kept = least < hi
        ends = np.cumsum(pc.list_value_length(rows.column("keys")).to_numpy())
        bounds = np.concatenate([[0], np.cumsum(kept)[ends - 1]])
        return pa.table([rows.column("slice"), _lists(keys[kept], bounds), _lists(least[kept], bounds)], ["slice", "keys", "least"])

    dealt = slices.mapInArrow(deal, "part int, slice long, keys array<long>, lo array<long>, more array<long>")
    return dealt.groupBy("part").applyInArrow(meet, "slice long, keys array<long>, least array<long>")


class Slice:
    """Some texts of a column, split into words: line k has the words from bounds[k] to bounds[k + 1] and belongs
    to text row[k] (of the slice), text r has the words from ends[r] to ends[r + 1]."""

    def __init__(self, column: pa.Array):
        split = pc.split_pattern(column, "\n")
        many = np.diff(np.asarray(split.offsets))
        self.hashes, self.stops, self.bounds = _words(split.flatten())
        self.row = np.repeat(np.arange(len(column)), many)
        self.ends = self.bounds[np.concatenate([[0], np.cumsum(many)])]

    def place(self, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The number of a word in its text."""
        return (word - self.ends[row]).astype(np.int32)

    def sentences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, begin, end) in words of the sentences of SHINGLE words or more, but fewer than a window has, that
        share their line with others."""
        begins = np.zeros(len(self.hashes) + 1, bool)
        begins[self.bounds[:-1]] = True
        begins[1:] |= self.stops
        begin = np.flatnonzero(begins[:-1])
        end = np.append(begin[1:], len(self.hashes)) if len(begin) else begin
        line = np.searchsorted(self.bounds, begin, side="right") - 1
        alone = np.bincount(line, minlength=len(self.row)) < 2
        kept = (end - begin >= SHINGLE) & (end - begin < WINDOW) & ~alone[line]
        return line[kept], begin[kept], end[kept]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each window of WINDOW words: its text, its first word, its name (the least hash of its SEED-word
        sequences) and its key (the hash of all its words)."""
        hashes, sizes = self.hashes, np.maximum(np.diff(self.ends) - WINDOW + 1, 0)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = self.ends[:-1][row] + np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
        if not len(at):
            return row, at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        key, width = _mix(hashes), 1
        while width < WINDOW:
            if width == SEED:
                least, span = key, 1  # the least of `span` sequences from each word on
                while span * 2 <= WINDOW - SEED + 1:
                    least = np.minimum(least[:-span], least[span:])
                    span *= 2
                rest = WINDOW - SEED + 1 - span
                least = np.minimum(least[: len(least) - rest], least[rest:])
            key = _mix(key[:-width] * MULTIPLY[0] + _mix(key[width:] + ADD[0]))
            width *= 2
        return row, at, least[at], key[at]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts of bounded text."""
    lengths = pc.binary_length(column).to_numpy()
    group = (np.cumsum(lengths) - lengths) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    return ((a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): `row` tells rows of one doc_id apart by their text, so that a doc_id with very many
    rows is no single key."""
    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text")


def marks_of(docs: DataFrame) -> DataFrame:
    """(kind, slice, n, doc_ids, rows, at, n_words, keys, hashes): for each slice of texts a row with its lines of
    SHINGLE words or more, `hashes` being their bands end to end, a row with its short inner sentences, both `n` in number, and one
    with the `n` names of its windows, `hashes`, of which a text has as many as `n_words` says. `at` has the numbers
    of the first words."""
    kinds = pa.schema(
        [("kind", pa.int32()), ("slice", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())),
         ("at", pa.list_(pa.int32())), ("n_words", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64()))]
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(kind: int, n: int, batch: pa.RecordBatch, row, n_words, at=None, keys=None, hashes=None) -> pa.RecordBatch:
            whose = pa.array(row)
            lists = [*(batch.column(c).take(whose).to_numpy() for c in ("doc_id", "row")), at, n_words, keys, hashes]
            return pa.RecordBatch.from_arrays(
                [pa.array([kind], pa.int32()), pa.array([next(number)]), pa.array([n]),
                 *(pa.nulls(1, f.type) if x is None else _lists(x, np.array([0, len(x)])) for x, f in zip(lists, list(kinds)[3:], strict=True))],
                schema=kinds,
            )

        number = _numbers()
        for batch in batches:
            for first, count in _slices(batch.column("text")):
                part = batch.slice(first, count)
                s = Slice(part.column("text"))
                keys, shingles, bounds = shingled(s.hashes, s.bounds)
                long = np.flatnonzero(np.diff(s.bounds) >= SHINGLE)
                own, ends = _picked(bounds, long)
                bands = band_keys(shingles[own], ends) if len(long) else np.zeros((0, BANDS), np.uint64)
                row = s.row[long]
                n_words = np.diff(s.bounds)[long].astype(np.int32)
                yield one(LINE, len(long), part, row, n_words, s.place(s.bounds[long], row), keys[long], bands.reshape(-1))
                line, begin, end = s.sentences()
                sizes = end - begin
                ends = np.concatenate([[0], np.cumsum(sizes)])
                own = np.repeat(begin - ends[:-1], sizes) + np.arange(sizes.sum())
                row = s.row[line]
                yield one(SENTENCE, len(line), part, row, sizes.astype(np.int32), s.place(begin, row), shingled(s.hashes[own], ends)[0])
                row, _, least, _ = s.windows()
                new = _begins(row, least)
                named, sizes = np.unique(row[new], return_counts=True)
                yield one(NAME, len(new), part, named, sizes.astype(np.int32), hashes=least[new])

    return _keyed(docs).mapInArrow(
        of,
        "kind int, slice long, n long, doc_ids array<long>, rows array<long>, at array<int>, n_words array<int>, "
        "keys array<long>, hashes array<long>",
    )


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, at, n_words, key, bands) of each line of SHINGLE words or more."""
    each = F.posexplode(F.arrays_zip("doc_ids", "rows", "at", "n_words", "keys"))
    return (
        marks_of(docs)
        .filter(F.col("kind") == LINE)
        .select("hashes", each)
        .select("col.doc_ids", "col.rows", "col.at", "col.n_words", "col.keys", F.slice("hashes", F.col("pos") * BANDS + 1, BANDS))
        .toDF("doc_id", "row", "at", "n_words", "key", "bands")
    )


def _sliced(lines: DataFrame) -> DataFrame:
    """What `lines_of` gives, in slices as `marks_of` gives them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers()
        for batch in batches:
            lists = [_lists(batch.column(c).to_numpy(), np.array([0, batch.num_rows])) for c in ("doc_id", "row", "at", "n_words", "key")]
            bands = batch.column("bands").flatten().to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(number)]), pa.array([batch.num_rows]), *lists, _lists(bands, np.array([0, len(bands)]))],
                ["slice", "n", "doc_ids", "rows", "at", "n_words", "keys", "hashes"],
            )

    return lines.select("doc_id", "row", "at", "n_words", "key", "bands").mapInArrow(
        of, "slice long, n long, doc_ids array<long>, rows array<long>, at array<int>, n_words array<int>, keys array<long>, hashes array<long>"
    )


def _total(slices: DataFrame) -> int:
    return slices.agg(F.sum("n")).first()[0] or 0


def _looked_up(keys: np.ndarray, answer: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys have an answer, and the least owners of these."""
    known, least = _flat(answer, "keys"), _flat(answer, "least")
    order = np.argsort(known)
    known, least = known[order], least[order]
    place = np.searchsorted(known, keys)
    met = np.flatnonzero(place < len(known))
    met = met[known[place[met]] == keys[met]]
    return met, least[place[met]]


def _alike(marks: DataFrame) -> DataFrame:
    """(kind, doc_id, row, at, n_words, key, keeper) of lines and short sentences that stand in an earlier document
    word by word."""

    def keys(one: pa.RecordBatch | pa.Table) -> np.ndarray:
        return _mix(_flat(one, "keys").view(np.uint64) + np.uint64(one.column("kind")[0].as_py()))

    def of(mine: pa.Table, earlier: pa.Table) -> pa.Table:
        doc_ids = _flat(mine, "doc_ids")
        met, keeper = _looked_up(keys(mine).view(np.int64), earlier)
        later = keeper < doc_ids[met]
        met, keeper = met[later], keeper[later]
        kind = pa.array(np.full(len(met), mine.column("kind")[0].as_py(), np.int32))
        lists = [pa.array(x[met]) for x in (doc_ids, *(_flat(mine, c) for c in ("rows", "at", "n_words", "keys")))]
        return pa.table([kind, *lists, pa.array(keeper)], ["kind", "doc_id", "row", "at", "n_words", "key", "keeper"])

    slices = marks.filter(F.col("kind") != NAME).select("kind", "slice", "n", "doc_ids", "rows", "at", "n_words", "keys")
    asked = answers(slices, lambda one: (keys(one), _flat(one, "doc_ids")), _total(slices), later=True).groupBy("slice")
    return slices.groupBy("slice").cogroup(asked).applyInArrow(of, "kind int, doc_id long, row long, at int, n_words int, key long, keeper long")


def _shared_names(marks: DataFrame) -> DataFrame:
    """(doc_id, row, names) of the texts with names that several documents have."""
    slices = marks.filter(F.col("kind") == NAME).select("slice", "n", "doc_ids", "rows", "n_words", "hashes")

    def read(one: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return _flat(one, "hashes").view(np.uint64), np.repeat(_flat(one, "doc_ids"), _flat(one, "n_words"))

    def of(mine: pa.Table, shared: pa.Table) -> pa.Table:
        names, sizes = _flat(mine, "hashes"), _flat(mine, "n_words")
        met = np.flatnonzero(np.isin(names, _flat(shared, "keys")))
        text = np.repeat(np.arange(len(sizes)), sizes)[met]
        first = _begins(text)
        return pa.table(
            [pa.array(_flat(mine, "doc_ids")[text[first]]), pa.array(_flat(mine, "rows")[text[first]]), _lists(names[met], np.append(first, len(met)))],
            ["doc_id", "row", "names"],
        )

    asked = answers(slices, read, _total(slices)).groupBy("slice")
    return slices.groupBy("slice").cogroup(asked).applyInArrow(of, "doc_id long, row long, names array<long>")


def details_of(docs: DataFrame, lines: DataFrame, names: DataFrame) -> DataFrame:
    """What a second look at the texts gives. For `lines` (doc_id, row, key): rows with `key` and the line's set
    of `shingles`. For `names` (doc_id, row, names): a row for each slice of texts with all their windows of those
    names, `n` in number: `windows` are their keys end to end, in runs of neighbours of which `begins` has the
    first word and `lengths` the windows; a text of `doc_ids` and `rows` has as many runs as `sizes` says."""
    none = F.lit(None).cast("array<long>")
    asked = (
        lines.groupBy("doc_id", "row")
        .agg(F.collect_set("key").alias("lines"))  # at most a text's lines
        .withColumn("names", none)
        .unionAll(names.select("doc_id", "row", none, "names"))
        .groupBy("doc_id", "row")
        .agg(F.first("lines", True).alias("lines"), F.first("names", True).alias("names"))  # equal texts share equal names
    )
    kinds = pa.schema(
        [("key", pa.int64()), ("shingles", pa.list_(pa.int64())), ("slice", pa.int64()), ("n", pa.int64()),
         ("doc_ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
         ("begins", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("windows", pa.list_(pa.int64()))]
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers()
        for batch in batches:
            for first, count in _slices(batch.column("text")):
                part = batch.slice(first, count)
                s = Slice(part.column("text"))
                asked = [part.column(n).flatten().to_numpy().view(np.uint64) for n in ("lines", "names")]
                if len(asked[0]):
                    keys, shingles, bounds = shingled(s.hashes, s.bounds)
                    _, chosen = np.unique(keys, return_index=True)
                    chosen = chosen[np.isin(keys[chosen], asked[0])]
                    sets = [np.unique(shingles[bounds[k] : bounds[k + 1]]).view(np.int64) for k in chosen.tolist()]
                    n, ends = len(chosen), np.cumsum([0, *map(len, sets)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[chosen].view(np.int64)), lists, *(pa.nulls(n, f.type) for f in list(kinds)[2:])], schema=kinds
                    )
                if len(asked[1]):
                    row, at, least, key = s.windows()
                    # a name that one document shares is shared in all documents that have it
                    met = np.flatnonzero(np.isin(least, asked[1]))
                    if not len(met):
                        continue
                    row, at, key = row[met], at[met], key[met]
                    run = _begins(row, met - np.arange(len(met)))
                    text = _begins(row[run])
                    whose, one = pa.array(row[run][text]), np.array([0, len(text)])
                    runs = np.array([0, len(run)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(1, pa.int64()), pa.nulls(1, kinds.field("shingles").type), pa.array([next(number)]), pa.array([len(met)]),
                         *(_lists(part.column(c).take(whose).to_numpy(), one) for c in ("doc_id", "row")),
                         _lists(np.diff(np.append(text, len(run))).astype(np.int32), one), _lists(s.place(at[run], row[run]), runs),
                         _lists(np.diff(np.append(run, len(met))).astype(np.int32), runs), _lists(key, np.array([0, len(met)]))],
                        schema=kinds,
                    )

    return _keyed(docs).join(asked, ["doc_id", "row"]).select("text", "doc_id", "row", "lines", "names").mapInArrow(
        of,
        "key long, shingles array<long>, slice long, n long, doc_ids array<long>, rows array<long>, sizes array<int>, "
        "begins array<int>, lengths array<int>, windows array<long>",
    )


class Sets:
    """Shingle sets, flat: set k is flat[bounds[k]:bounds[k + 1]], without repeats."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray):
        distinct, codes = np.unique(flat, return_inverse=True)
        self.codes, self.n_codes, self.bounds, self.sizes = codes, max(1, len(distinct)), bounds, np.diff(bounds)

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of sets: whether their Jaccard similarity is SIMILARITY or more."""
        out = np.zeros(len(a), bool)
        sizes = self.sizes[a], self.sizes[b]
        asked = np.flatnonzero(np.minimum(*sizes) >= SIMILARITY * np.maximum(*sizes) - 1e-9)  # else the sizes say no
        ends = np.cumsum(sizes[0][asked] + sizes[1][asked])
        for some in np.split(asked, np.searchsorted(ends, np.arange(16 * BLOCK, ends[-1] if len(ends) else 0, 16 * BLOCK))):
            code = []
            for side in (a[some], b[some]):
                n = self.sizes[side]
                at = np.repeat(self.bounds[side] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                code.append(self.codes[at] + np.repeat(np.arange(len(side)) * self.n_codes, n))
            both = np.sort(np.concatenate(code))
            common = np.bincount(both[1:][both[1:] == both[:-1]] // self.n_codes, minlength=len(some))
            out[some] = common >= SIMILARITY * (sizes[0][some] + sizes[1][some] - common) - 1e-9
        return out


def _group_links(sets: Sets, first: int, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of one large group that connect all that similar pairs connect. Every set outside the
    largest component so far is compared with all others: a similar pair that is never compared has both
    its ends inside that component."""
    rows = np.arange(first, first + n)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    asked = np.zeros(n, bool)
    root = np.arange(n)
    while True:
        big = np.bincount(root, minlength=n).argmax()
        open_ = np.flatnonzero(~asked & ((root != big) | (len(left) == 0)))
        if not len(open_):
            return left, right
        x = int(open_[0])
        asked[x] = True
        hit = rows[sets.alike(np.full(n, first + x), rows) & (rows != first + x)]
        left.append(np.full(len(hit), first + x))
        right.append(hit)
        if len(hit):
            low = min(int(root[x]), int(root[hit - first].min()))
            root[np.isin(root, np.append(root[hit - first], root[x]))] = low


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, key, shingles) sorted by band to links (a, b) of similar keys."""

    def stars(part: pa.Table) -> pa.RecordBatch:
        band, key = part.column("band").to_numpy(), part.column("key").to_numpy()
        lists = part.column("shingles").combine_chunks()
        bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        sets = Sets(lists.flatten().to_numpy().view(np.uint64), bounds)
        begin = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        sizes = np.diff(np.append(begin, len(band)))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        group = np.repeat(np.arange(len(begin)), sizes)
        near = np.flatnonzero((sizes <= SMALL)[group])
        for lag in range(1, SMALL):
            near = near[near + lag < len(band)]
            near = near[group[near] == group[near + lag]]
            if not len(near):
                break
            hit = near[sets.alike(near, near + lag)]
            left.append(hit)
            right.append(hit + lag)
        for g in np.flatnonzero(sizes > SMALL).tolist():
            a, b = _group_links(sets, int(begin[g]), int(sizes[g]))
            left += a
            right += b
        rows, firsts = local_stars(np.concatenate(left), np.concatenate(right), len(band))
        return pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(key[firsts])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > CHUNK:
            whole = pa.Table.from_batches(held)
            band = whole.column("band").to_numpy()
            to = int(np.searchsorted(band, band[-1]))  # the last band may go on
            if to:
                yield stars(whole.slice(0, to).combine_chunks())
                held, rows = whole.slice(to).to_batches(), whole.num_rows - to
    if rows:
        yield stars(pa.Table.from_batches(held).combine_chunks())


def _candidates(slices: DataFrame) -> DataFrame:
    """(doc_id, row, at, n_words, key, bands) of the lines that share a band with a line of different content:
    `bands` are those they share."""

    def read(one: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return _flat(one, "hashes").view(np.uint64), np.repeat(_flat(one, "keys"), BANDS)

    def of(mine: pa.Table, shared: pa.Table) -> pa.Table:
        bands = _flat(mine, "hashes")
        met = np.flatnonzero(np.isin(bands, _flat(shared, "keys")))
        line = met // BANDS
        first = _begins(line)
        lists = [pa.array(_flat(mine, c)[line[first]]) for c in ("doc_ids", "rows", "at", "n_words", "keys")]
        return pa.table([*lists, _lists(bands[met], np.append(first, len(met)))], ["doc_id", "row", "at", "n_words", "key", "bands"])

    slices = slices.select("slice", "n", "doc_ids", "rows", "at", "n_words", "keys", "hashes")
    asked = answers(slices.select("slice", "keys", "hashes"), read, _total(slices) * BANDS).groupBy("slice")
    return staged(slices.groupBy("slice").cogroup(asked).applyInArrow(of, "doc_id long, row long, at int, n_words int, key long, bands array<long>"))


def _met(candidates: DataFrame) -> DataFrame:
    """(band, key, doc_id, row, last) of lines of different content that share a band, with one place of each in its first
    document, and its last document."""
    found = candidates.groupBy("key").agg(
        F.min_by("row", "doc_id").alias("row"), F.max("doc_id").alias("last"), F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id")
    )
    return staged(found.select(F.explode("bands").alias("band"), "key", "doc_id", "row", "last"))


def _by_rare_shingles(sets: DataFrame) -> DataFrame:
    """Rows (band, key, shingles) for the `sets` (key, shingles) of large bands, dealt again: two sets of
    similarity SIMILARITY share one of their n - ceil(SIMILARITY * n) + 1 rarest shingles, whatever the order of
    the shingles, as long as it is one order for all. Lines of one template share their common shingles, which are
    not asked, and part. A line is taken apart once, however many large bands it is in."""
    each = sets.select("key", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    n = F.size("ordered")
    rarest = (
        each.join(often, "shingle", "left")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("ordered"))  # a line's shingles
        .select("key", F.explode(F.slice("ordered", 1, n - F.ceil(SIMILARITY * n - 1e-9).cast("int") + 1)).alias("s"))
        .filter("s.often is not null")  # a shingle of one line brings nothing together
        .select("key", F.col("s.shingle").alias("band"))
    )
    several = rarest.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    return rarest.join(several, "band").join(sets, "key").select("band", "key", "shingles")


def _clusters(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, cluster) of lines that are similar to another, from `sets` (key, shingles)."""
    often = met.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    rows = staged(met.select("band", "key").join(often, "band").join(sets.groupBy("key").agg(F.first("shingles").alias("shingles")), "key"))
    dealt = rows.filter(F.col("n") <= LARGE).select("band", "key", "shingles")
    large = rows.filter(F.col("n") > LARGE).select("key", "shingles").dropDuplicates(["key"])
    if not large.isEmpty():
        dealt = dealt.unionAll(_by_rare_shingles(large))
    dealt = dealt.repartition("band").sortWithinPartitions("band", "key")
    links = staged(dealt.select("band", "key", "shingles").mapInArrow(_compare, "a long, b long"))
    dropped(rows)
    found = components(links).select(F.col("node").alias("key"), F.col("component").alias("cluster"))
    dropped(links)
    return found


def clusters(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, cluster) of all lines that are similar to another: `lines` as `lines_of` gives them."""
    met = _met(_candidates(staged(_sliced(lines))))
    wanted = met.select("doc_id", "row", "key").distinct()
    nothing = wanted.limit(0).select("doc_id", "row", F.array("key").alias("names"))
    return _clusters(met, details_of(docs, wanted, nothing).filter("shingles is not null"))


def _repeated_windows(slices: DataFrame) -> DataFrame:
    """(doc_id, row, begins, ends, keepers): runs of neighbouring windows that stand in an earlier document, from
    rows of `details_of`; `keepers` has the smallest doc_id, one for all windows of a run."""

    def runs(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run of windows: its text, its first word and its length."""
        sizes = _flat(rows, "sizes")
        return np.repeat(np.arange(len(sizes)), sizes), _flat(rows, "begins"), _flat(rows, "lengths")

    def read(one: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        text, _, lengths = runs(one)
        return _flat(one, "windows").view(np.uint64), np.repeat(_flat(one, "doc_ids")[text], lengths)

    def of(mine: pa.Table, earlier: pa.Table) -> pa.Table:
        doc_ids = _flat(mine, "doc_ids")
        text, begins, lengths = runs(mine)
        met, keeper = _looked_up(_flat(mine, "windows"), earlier)
        run = np.repeat(np.arange(len(lengths)), lengths)
        later = keeper < doc_ids[text[run[met]]]
        met, keeper = met[later], keeper[later]
        run = run[met]
        text, at = text[run], begins[run] + (met - (np.cumsum(lengths) - lengths)[run])
        first = _begins(text, at - np.arange(len(at)), keeper)
        last = np.append(first[1:], len(at)) - 1 if len(first) else first
        own = _begins(text[first])
        bounds, whose = np.append(own, len(first)), text[first][own]
        return pa.table(
            [pa.array(doc_ids[whose]), pa.array(_flat(mine, "rows")[whose]), _lists(at[first].astype(np.int32), bounds),
             _lists((at[last] + WINDOW).astype(np.int32), bounds), _lists(keeper[first], bounds)],
            ["doc_id", "row", "begins", "ends", "keepers"],
        )

    asked = answers(slices, read, _total(slices), later=True).groupBy("slice")
    return staged(
        slices.groupBy("slice").cogroup(asked).applyInArrow(of, "doc_id long, row long, begins array<int>, ends array<int>, keepers array<long>")
    )


def _repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is alike in a document of smaller doc_id: rows (kind, doc_id, row, at, n_words, keeper) of lines and
    short sentences, and rows of `_repeated_windows`."""
    docs = texts(docs).filter("doc_id is not null and text <> ''")
    marks = staged(marks_of(docs))
    # each written by itself, so that the shuffle files of one are gone before the next begins
    candidates = _candidates(marks.filter(F.col("kind") == LINE))
    met = _met(candidates)
    shared = staged(_shared_names(marks))
    alike = staged(_alike(marks))
    dropped(marks)
    details = staged(details_of(docs, met.select("doc_id", "row", "key").distinct(), shared))
    dropped(shared)
    found = staged(_clusters(met, details.filter("shingles is not null")))
    named = found.join(met.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("last").alias("last")), "key")
    whole = named.groupBy("cluster").agg(F.min("first").alias("keeper"), F.max("last").alias("latest"))
    spread = named.join(whole.filter("keeper < latest"), "cluster").select("key", "keeper")
    # a line that is similar to others repeats with them, all others and sentences repeat word by word
    own = found.select("key", F.lit(LINE).alias("kind"))
    rest = ["kind", "doc_id", "row", "at", "n_words", "keeper"]
    both = alike.join(own, ["kind", "key"], "left_anti").select(rest)
    both = staged(both.unionAll(candidates.join(spread, "key").filter("doc_id > keeper").select(F.lit(LINE).alias("kind"), *rest[1:])))
    dropped(alike, candidates, met, found)
    windows = _repeated_windows(
        details.filter("windows is not null").select("slice", "n", "doc_ids", "rows", "sizes", "begins", "lengths", "windows")
    )
    dropped(details)
    return both, windows


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, row, kind, begin, end, n_words, keeper): every line, short inner sentence and window that is alike
    or nearly alike in a document of smaller doc_id, `keeper`; `begin` and `end` are the numbers of the first word
    and of the one after the last. Rows without doc_id, and texts without words, hold nothing and remove
    nothing; rows that share a doc_id never remove from each other."""
    both, windows = _repeats(docs)
    names = F.when(F.col("kind") == LINE, "line").otherwise("sentence").alias("kind")
    each = windows.select("doc_id", "row", F.explode(F.arrays_zip("begins", "ends", "keepers")).alias("w")).select(
        "doc_id", "row", F.explode(F.sequence("w.begins", F.col("w.ends") - WINDOW)).alias("at"), "w.keepers"
    )
    return both.select("doc_id", "row", names, F.col("at").alias("begin"), (F.col("at") + F.col("n_words")).alias("end"), "n_words", "keeper").unionAll(
        each.select("doc_id", "row", F.lit("window"), "at", F.col("at") + WINDOW, F.lit(WINDOW), "keepers")
    )


def _spans(text: str, begins: list[int], ends: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, words) in characters of runs of words."""
    places = [m.span() for m in itertools.islice(WORD.finditer(text), ends[-1])]
    return [(places[a][0], places[b - 1][1], b - a) for a, b in zip(begins, ends, strict=True)]


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, row, ranges, windows): what repeats in each text that may lose a run."""
    both, windows = _repeats(docs)
    ranges = both.select(
        "doc_id", "row", F.struct("at", (F.col("at") + F.col("n_words")).alias("end")).alias("range"),
        F.lit(None).cast("struct<begins: array<int>, ends: array<int>>").alias("runs"), F.col("n_words").cast("long").alias("n"),
    )
    found = windows.select(
        "doc_id", "row", F.lit(None).cast("struct<at: int, end: int>"), F.struct("begins", "ends"), F.lit(WINDOW).cast("long")
    )
    return (
        ranges.unionAll(found)
        .groupBy("doc_id", "row")
        .agg(F.collect_set("range").alias("ranges"), F.collect_set("runs").alias("windows"), F.sum("n").alias("n"))
        .filter(F.col("n") >= RUN // 2)
        .select("doc_id", "row", "ranges", F.struct(F.flatten("windows.begins").alias("begins"), F.flatten("windows.ends").alias("ends")).alias("windows"))
    )


def _runs(ranges: pa.ListArray, windows: pa.StructArray) -> Iterator[tuple[int, list[int], list[int]]]:
    """(text, begins, ends) of the texts that lose something: runs of at least RUN words, of repeated ranges of
    words (first, after the last) with less than a shingle of words between them."""
    found = [ranges, pc.struct_field(ranges.flatten(), "at"), pc.struct_field(ranges.flatten(), "end")]
    runs = [pc.struct_field(windows, n) for n in ("begins", "ends")]
    # words of all texts are numbered through, far apart
    owner = np.concatenate([pc.list_parent_indices(c).to_numpy() for c in (ranges, runs[0])])
    begin = np.concatenate([found[1].to_numpy(), runs[0].flatten().to_numpy()]) + (owner << 32)
    end = np.concatenate([found[2].to_numpy(), runs[1].flatten().to_numpy()]) + (owner << 32)
    order = np.argsort(begin)
    begin, upto = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] - upto[:-1] >= SHINGLE
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1 if len(first) else first
    begin, end = begin[first], upto[last]
    kept = end - begin >= RUN
    begin, end = begin[kept], end[kept]
    text = begin >> 32
    own = _begins(text)
    for a, b in itertools.pairwise([*own.tolist(), len(text)]):
        base = text[a] << 32
        yield int(text[a]), (begin[a:b] - base).tolist(), (end[a:b] - base).tolist()


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, text, kept_text, n_runs, n_words_removed) of the documents that lose something. Rows that share
    a doc_id never remove from each other; each loses what repeats in its own text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, begins, ends in _runs(batch.column("ranges"), batch.column("windows")):
                text = batch.column("text")[r].as_py()
                runs = _spans(text, begins, ends)
                rows.append((batch.column("doc_id")[r].as_py(), text, without(text, runs), len(runs), sum(n for *_, n in runs)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)],
                ["doc_id", "text", "kept_text", "n_runs", "n_words_removed"],
            )

    rows = _keyed(texts(docs).filter("doc_id is not null and text <> ''")).join(_named(docs), ["doc_id", "row"])
    return rows.select("doc_id", "text", "ranges", "windows").mapInArrow(
        apply, "doc_id long, text string, kept_text string, n_runs int, n_words_removed long"
    )


def without(text: str, runs: list[tuple[int, int, int]]) -> str:
    rest, at = [], 0
    for a, b, _ in runs:
        rest.append(text[at:a])
        at = b
    return "".join([*rest, text[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with its repeated runs cut from the texts, all columns kept; `n_chars`, if there, counts the new
    text. A document that had words and lost all of them goes. Rows without doc_id or text stay as they are."""
    found = _named(docs).select(F.col("doc_id").alias("id"), F.col("row").alias("of_text"), "ranges", "windows")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("of_text"),
        F.struct(*docs.columns).alias("row"),
    ).join(found, ["id", "of_text"], "left")
    fields = docs.schema
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.column("row").flatten())
            text, keep = columns[text_at].to_pylist(), np.ones(batch.num_rows, bool)
            chars = columns[chars_at].to_pylist() if chars_at is not None else None
            for r, begins, ends in _runs(batch.column("ranges"), batch.column("windows")):
                if text[r] is None:
                    continue
                text[r] = without(text[r], _spans(text[r], begins, ends))
                keep[r] = bool(text[r].strip())
                if chars is not None:
                    chars[r] = len(text[r])
            columns[text_at] = pa.array(text, pa.string())
            if chars is not None:
                columns[chars_at] = pa.array(chars, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, fields.names).filter(pa.array(keep))

    return rows.select("row", "ranges", "windows").mapInArrow(apply, fields)


def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with repeated passages: how many runs and words go, and the hash of what stays."""
    return removals(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_runs", "n_words_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )
