"""Ids of whole texts by the tokenizers library, with the work per distinct word instead of per word."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker remembers, first come first kept: a bound on memory, never on results.
REMEMBERED = 600_000
#: Bytes of text whose words are looked up at once.
BATCH_CHARS = 8_000_000

# Texts of these letters, digits and marks are cut into pieces by simple classes; every library pattern
# treats them alike. Anything else in a word sends that word through the whole library pipeline.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:;=-@\[-`{-~"  # without the apostrophe of contractions and the < of special tokens
WHITE = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_LOADED: dict[str, WordTokenizer] = {}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    return [table[b] if b in table else chr(256 + sum(1 for h in range(b) if h not in shown)) for b in range(256)]


class WordTokenizer:
    """`encode` gives the ids of each text exactly as `Tokenizer.encode(add_special_tokens=False)` does.

    Texts are cut before single spaces, where no token of the two supported kinds (byte-level pieces with
    a leading space; pieces that drop white space) ever crosses; Arrow finds the distinct words of a
    batch, and only those are tokenized. A text in which a space follows other white space goes
    through the library as a whole where white space matters.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        sample = self.library.encode("a b", add_special_tokens=False).tokens
        self.spaced = sample[1].startswith("Ġ")
        if not self.spaced and sample != ["a</w>", "b</w>"]:
            raise ValueError("a byte-level vocabulary with leading spaces or one with word ends is needed")
        digits = "[0-9]+" if self.spaced else "[0-9]"
        lead = " ?" if self.spaced else ""
        if not all("<" in t.content for t in self.library.get_added_tokens_decoder().values()):
            raise ValueError("special tokens without < are not foreseen")
        letters = LETTERS if self.spaced else "a-zß-öø-ÿ"  # those that lower-casing leaves alone
        some = f"[{letters}0-9{MARKS}]+"
        self.simple = re.compile(f"{lead}{some}(?:\n{some})*")
        self.one = re.compile(f"{lead}[{letters}]+")
        # vocabularies that drop white space have no piece for a line end
        line_end = "|\n" if self.spaced else ""
        self.pieces = re.compile(f"{lead}[{letters}]+|{lead}{digits}|{lead}[{MARKS}]+{line_end}")
        self.alphabet = str.maketrans(dict(enumerate(byte_alphabet())))
        self.model = self.library.model
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece of the library's pattern."""
        got = self.known.get(piece)
        if got is None:
            shown = piece.encode().decode("latin-1").translate(self.alphabet)
            got = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(self.known) < REMEMBERED:
                self.known[piece] = got
        return got

    def _word(self, word: str) -> bytes:
        """The ids of a word that is not known."""
        if self.one.fullmatch(word):
            return self._piece(word)
        if self.simple.fullmatch(word):
            return b"".join(map(self._piece, self.pieces.findall(word)))
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's ids begin and end (one more bound than texts)."""
        whole = pc.match_substring_regex(texts, WHITE + " ").to_numpy(zero_copy_only=False)
        if not self.spaced:  # white space and the case of letters are lost in any event
            whole = np.zeros(len(texts), bool)
            lower = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, lower)  # special tokens heed case
        split = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        bounds = np.asarray(split.offsets) - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        index, distinct = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        if self.spaced:
            # the first word of a text has no space before it: these are looked up apart
            first = np.zeros(len(index), bool)
            first[bounds[:-1][np.diff(bounds) > 0]] = True
            codes = index * 2 + first
            used, index = np.unique(codes, return_inverse=True)
            keys = [distinct[c >> 1] if c & 1 else " " + distinct[c >> 1] for c in used.tolist()]
        else:
            keys = distinct
        known = self.known.get
        found = [known(k) or self._word(k) for k in keys]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        ids, ends = expand(flat, sizes, index)
        bounds = np.concatenate([[0], ends])[bounds]
        if not whole.any():
            return ids, bounds
        parts = np.split(ids, bounds[1:-1])
        for i in np.flatnonzero(whole):
            parts[i] = np.array(self.library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, "<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def expand(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs named by `index`, end to end, and the end of each; run k of `flat` has sizes[k] items."""
    starts = np.cumsum(sizes) - sizes
    taken = sizes[index]
    ends = np.cumsum(taken)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[index] - (ends - taken), taken) + np.arange(total)], ends


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process and file; what it remembers lasts for the worker's tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with a text column, in slices of bounded text, with their ids and bounds; `end` closes
    every text."""
    words = tokenizer(path)
    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        group = (np.cumsum(lengths) - lengths) // BATCH_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            ids, bounds = words.encode(part.column("text"))
            yield part, np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))
