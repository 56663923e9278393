"""Fill-in-middle over seekable compressed text: independent zstandard frames with cumulative unit counts.

A text is kept as frames of at most FRAME bytes, cut between code points and each compressed by itself; a
frame's row of the index says how many lines end, and how many code points stand, before it. A cut after so
many lines is found in the index and only the frame that holds it is decompressed. The transformed text is a
list of frames again: whole frames are taken over as they are, only cut frames and markers are compressed
anew. Digests stream the frames in order, so no step holds more than a compressed text and one frame.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tenura.lineage import staged
from tenura.llm.common import table, texts

#: Bytes of text in a frame.
FRAME = 1 << 16
LEVEL = 3
#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Order of the parts in each form.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}

STORE = "doc_id long, n long, marked boolean, n_chars long, lines array<long>, chars array<long>, frames array<binary>"
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"


def _chars(data: bytes | memoryview) -> int:
    """Code points of whole UTF-8 sequences."""
    return len(str(data, "utf-8"))


def cut_text(data: bytes, size: int = FRAME) -> Iterator[bytes]:
    """Consecutive pieces of at most `size` bytes (at least one code point) that end between code points."""
    at, view = 0, memoryview(data)
    while at < len(data):
        to = min(at + max(size, 4), len(data))
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to -= 1
        yield bytes(view[at:to])
        at = to


def compress(data: bytes, size: int = FRAME) -> tuple[list[int], list[int], list[bytes]]:
    """The index (lines ended and code points before each frame, and in all) and the frames."""
    press = zstandard.ZstdCompressor(level=LEVEL).compress
    lines, chars, frames = [0], [0], []
    for piece in cut_text(data, size):
        lines.append(lines[-1] + piece.count(b"\n"))
        chars.append(chars[-1] + _chars(piece))
        frames.append(press(piece))
    return lines, chars, frames


def stream(frames: list[bytes]) -> Iterator[bytes]:
    """The text, frame by frame."""
    unpack = zstandard.ZstdDecompressor().decompress
    return map(unpack, frames)


def cut_after(units: int, n: int, lines: list[int], frames: list[bytes]) -> tuple[int, bytes, bytes]:
    """Where the first `units` of `n` lines end: the frame that holds the end, its text up to there and its
    text from there on. Only that frame is decompressed; ends of the text need none."""
    if units <= 0:
        return 0, b"", b""
    if units >= n:
        return len(frames), b"", b""
    f = bisect_left(lines, units) - 1  # the frame in which the line's end stands
    piece = zstandard.ZstdDecompressor().decompress(frames[f])
    at = -1
    for _ in range(units - lines[f]):
        at = piece.index(b"\n", at + 1)
    return f, piece[: at + 1], piece[at + 1 :]


def parts_of(a: int, b: int, n: int, lines: list[int], chars: list[int], frames: list[bytes]):
    """Prefix, middle and suffix as lists of frames, and the code points of the first two; `a` <= `b` lines
    stand before the two cuts."""
    press = zstandard.ZstdCompressor(level=LEVEL).compress
    small = lambda piece: [press(piece)] if piece else []
    f, head, rest = cut_after(a, n, lines, frames)
    g, upto, tail = cut_after(b, n, lines, frames)
    prefix = frames[:f] + small(head)
    if f == g:
        middle = small(upto[len(head) :])
    else:
        # a cut at the very end of the text lies beyond the last frame, a cut inside leaves the rest of its frame
        middle = small(rest) + frames[f + bool(head) : g] + small(upto)
    suffix = small(tail) + frames[g + bool(upto) :]
    before = lambda k, piece: chars[k] + _chars(piece)
    return (prefix, middle, suffix), before(f, head), before(g, upto) - before(f, head)


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The original text from a transformed one, piece by piece and in order: the markers are looked up in the
    output itself, then each part is streamed from the frame in which it begins."""
    if form == "plain":
        yield from stream(frames)
        return
    names = [name for name, _ in ORDERS[form]]
    spots, ends, seen, tail = [], [], 0, b""
    for piece in stream(frames):
        window, at = tail + piece, 0  # a marker may cross frames
        while len(spots) < 3 and (at := window.find(names[len(spots)], at)) >= 0:
            spots.append(seen - len(tail) + at)
            at += 3
        seen += len(piece)
        ends.append(seen)
        tail = window[max(at, len(window) - 2) :] if at > 0 else window[-2:]
    if len(spots) < 3:
        raise ValueError("a marker is missing")
    stops = [*spots[1:], seen]
    found = {part: (spot + 3, stop) for (_, part), spot, stop in zip(ORDERS[form], spots, stops, strict=True)}
    for part in (0, 1, 2):
        at, stop = found[part]
        for k in range(bisect_left(ends, at + 1), len(frames)):
            if at >= stop:
                break
            begin = ends[k - 1] if k else 0
            yield next(stream(frames[k : k + 1]))[at - begin : stop - begin]
            at = min(ends[k], stop)


def store(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """Each row's text as frames with their index: (doc_id, n, marked, n_chars, lines, chars, frames). `n` is
    the number of lines, `marked` says that the text holds one of the markers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(
            [("doc_id", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_()), ("n_chars", pa.int64()),
             ("lines", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64())), ("frames", pa.list_(pa.binary()))]
        )
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                data = text.as_buffer().to_pybytes() if len(text.as_buffer()) else b""
                lines, chars, frames = compress(data, frame)
                rows.append(
                    {"doc_id": doc_id.as_py(), "n": lines[-1] + (bool(data) and data[-1:] != b"\n"),
                     "marked": any(m in data for m in (PREFIX, SUFFIX, MIDDLE)), "n_chars": chars[-1],
                     "lines": lines, "chars": chars, "frames": frames}
                )
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, kind)

    return texts(docs).mapInArrow(pack, STORE)


def choice(doc_id: int | None, n: int, empty: bool, marked: bool, seed: int, rate: int, spm: int):
    """The form of a document and the lines before its two cuts, from a hash of its id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if empty or marked or h3 % 100 >= rate:
        return "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < spm else "psm"), a, b


def transform(stored: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """The fill-in-middle form of each stored text: (doc_id, n, form, prefix_chars, middle_chars, frames), the
    output being the frames one after the other. `rate` of 100 documents are transformed, `spm` of 100 of these
    with the suffix first."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(
            [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
             ("middle_chars", pa.int64()), ("frames", pa.list_(pa.binary()))]
        )
        mark = {m: zstandard.ZstdCompressor(level=LEVEL).compress(m) for m in (PREFIX, SUFFIX, MIDDLE)}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                n, frames = row["n"], row["frames"]
                form, a, b = choice(row["doc_id"], n, not frames, row["marked"], seed, rate, spm)
                out = {"doc_id": row["doc_id"], "n": n, "form": form, "prefix_chars": None, "middle_chars": None}
                if form != "plain":
                    parts, out["prefix_chars"], out["middle_chars"] = parts_of(a, b, n, row["lines"], row["chars"], frames)
                    frames = [f for m, part in ORDERS[form] for f in (mark[m], *parts[part])]
                rows.append(out | {"frames": frames})
            yield pa.RecordBatch.from_pylist(rows, kind)

    return stored.mapInArrow(turn, OUTPUT)


def texts_of(outputs: DataFrame, original: bool = False) -> DataFrame:
    """(doc_id, text) of transformed rows: the output, or with `original` the text rebuilt from it."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pieces = restored(row["frames"], row["form"] if original else "plain")
                out = {"doc_id": row["doc_id"], "text": b"".join(pieces).decode()}
                yield pa.RecordBatch.from_pylist([out], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    return outputs.mapInArrow(unpack, "doc_id long, text string")


def digests(outputs: DataFrame) -> DataFrame:
    """The transformed rows with sha256 of the output and of the text rebuilt from it, in place of the frames."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list[str]] = {"output_sha256": [], "restored_sha256": []}
            for form, frames in zip(batch.column("form").to_pylist(), batch.column("frames").to_pylist(), strict=True):
                for name, pieces in zip(sums, (stream(frames), restored(frames, form)), strict=True):
                    total = hashlib.sha256()
                    for piece in pieces:
                        total.update(piece)
                    sums[name].append(total.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(s, pa.string()) for s in sums.values())],
                [*batch.schema.names[:-1], *sums],
            )

    return outputs.mapInArrow(
        hashed,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string",
    )


def op11_seekable_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of `documents`. The frames are stored once in the shared folder; selection and digests
    read them from there, without any shuffle. A missing text is empty; empty texts and texts that hold a marker
    stay plain; a missing doc_id hashes as no digits; rows of one doc_id are cut alike; an empty table gives no
    rows. The longest text in a row is bounded by Spark's row, not by a worker: it is held compressed."""
    return digests(transform(staged(store(table(spark, sf_dir, "documents")))))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                  sha256('7:' || doc_id) AS h FROM documents),
k AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100
                  THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y,
             array_to_string(u[b + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
                        ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""
