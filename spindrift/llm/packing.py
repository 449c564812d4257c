"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities.

Documents are tokenized once.  Whole windows of ``width`` tokens are cut off a long document and
fill a sequence each; what remains is packed by first-fit decreasing, independently in randomised
groups of bounded size.  A tournament tree holds in each inner node the largest free capacity
below it, so the first bin that fits is found in O(log n).  Bins that stay far from full are cut
at powers of two, whose sequences need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_parallelism, require, words_text

WIDTH = 4096
END_ID = 2
SEED = 17
#: Remainders packed together: the bound on what a group holds in memory.
GROUP_DOCS = 4_096
#: A bin under this share of the width is cut at powers of two.
FULL_ENOUGH = 0.97
_CACHE_WORDS = 400_000
_DOUBLE_MARK = re.compile(r"[.,](?<=[\W_].) ")
#: Texts encoded at once, so that new words are learnt together.
_TEXTS = 64
_PLAIN_MARKS = ".,;:!?%*#$&|()"
_PAST_LATIN = "\u0250"


@lru_cache(maxsize=4)
def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to the ids of each, as little-endian uint16 bytes.

    The tokenizer splits at white space before it merges, so the ids of a text are those of its
    runs between ASCII white space, one after another.  Runs are remembered up to a bound.  A new
    run of Latin letters with plain punctuation behind is looked up as those two parts, in lower
    case, since the tokenizer lower-cases and splits there too; new parts are encoded together and
    told apart by their word-end marks.  Other runs are encoded as they are.  A text of Latin-1
    letters is lower-cased and parted from its stops and commas at once.  One encoder serves all
    tasks of a worker process.
    """
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = False
    ends = np.zeros(coder.get_vocab_size(), bool)
    ends[[i for token, i in coder.get_vocab().items() if token.endswith("</w>")]] = True
    # for words of a-z the steps before the merges change nothing: the same merges without them
    bare = Tokenizer.from_str(json.dumps(json.loads(coder.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
    seen: dict[str, bytes] = {"": b""}
    parts: dict[str, bytes] = {"": b""}

    def separately(items: list[str]) -> list[bytes]:
        return [np.array(got.ids, dtype="<u2").tobytes() for got in coder.encode_batch_fast(items, add_special_tokens=False)]

    def together(items: list[str], by: Tokenizer) -> list[bytes]:
        if not items:
            return []
        ids = np.array(by.encode_batch_fast([" ".join(items)], add_special_tokens=False)[0].ids, dtype="<u2")
        cuts = (2 * np.flatnonzero(ends[ids]) + 2).tolist()
        if len(cuts) != len(items):
            return separately(items)
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *cuts], cuts)]

    def learn(runs: set[str]) -> None:
        for known in (seen, parts):
            if len(known) > _CACHE_WORDS:
                known.clear()
                known[""] = b""
        fresh = runs.difference(seen)
        words = [r for r in fresh if r.isascii() and r.isalpha() and r.islower()]
        seen.update(zip(words, together(words, bare)))
        composed, odd, missing = [], [], set()
        for run in fresh.difference(words):
            low = run.lower()
            body = low.rstrip(_PLAIN_MARKS)
            if not body or (body.isalpha() and max(body) < _PAST_LATIN):
                tail = low[len(body) :]
                composed.append((run, body, tail))
                missing.update((body, tail))
            else:
                odd.append(run)
        new = list(missing.difference(parts))
        parts.update(zip(new, together(new, coder)))
        for run, body, tail in composed:
            seen[run] = parts[body] + parts[tail]
        if odd:
            seen.update(zip(odd, separately(odd)))

    def split(text: str) -> list[str]:
        for space in "\t\n\v\f\r":
            if space in text:
                text = text.replace(space, " ")
        if "<|" not in text and _is_latin1(text):
            text = text.lower()
            if not _DOUBLE_MARK.search(text):
                text = text.replace(". ", " . ").replace(", ", " , ")
        return text.split(" ")

    def encode(texts: list[str]) -> list[bytes]:
        runs = [split(text) for text in texts]
        learn(set().union(*runs))
        known = seen.__getitem__
        return [b"".join(map(known, r)) for r in runs]

    return encode


def _is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def crc(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


class FirstFit:
    """First-fit bins over a tournament tree of free capacities; grows by doubling."""

    def __init__(self, capacity: int, leaves: int = 1024):
        self.capacity, self.leaves, self.used = capacity, leaves, 0
        self.tree = [capacity] * (2 * leaves)

    def place(self, size: int) -> int:
        """The first bin with room for ``size``; its room is taken."""
        if self.tree[1] < size:
            old, n = self.tree, self.leaves
            self.leaves = 2 * n
            self.tree = [self.capacity] * (4 * n)
            self.tree[2 * n : 3 * n] = old[n:]
            for i in range(2 * n - 1, 0, -1):
                self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])
        at = 1
        while at < self.leaves:
            at *= 2
            if self.tree[at] < size:
                at += 1
        found = at - self.leaves
        self.used = max(self.used, found + 1)
        self.tree[at] -= size
        while at > 1:
            at //= 2
            top = max(self.tree[2 * at], self.tree[2 * at + 1])
            if self.tree[at] == top:
                break
            self.tree[at] = top
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers.  Larger items go first; ties keep their order."""
    tree = FirstFit(capacity)
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = tree.place(sizes[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def cut_points(total: int) -> list[int]:
    """Ends of the power-of-two runs that make up ``total``, largest first."""
    ends, at = [], 0
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def _pack_group(rows: list[tuple], width: int, full_enough: float) -> Iterator[tuple]:
    """(row number, start within row, length, sequence, offset) for rows (.., length) of a group."""
    sequence = 0
    rest = []
    for i, row in enumerate(rows):
        if row[2] == width:
            yield i, 0, width, sequence, 0
            sequence += 1
        else:
            rest.append(i)
    for packed in first_fit_decreasing([rows[i][2] for i in rest], width):
        items = [(rest[k], rows[rest[k]][2]) for k in packed]
        total = sum(n for _, n in items)
        ends = [total] if total >= full_enough * width else cut_points(total)
        at = done = 0
        for i, n in items:
            start = 0
            while start < n:
                take = min(n - start, ends[0] - at)
                yield i, start, take, sequence, at - done
                start += take
                at += take
                if at == ends[0]:
                    done = ends.pop(0)
                    sequence += 1


_PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, width: int = WIDTH, end_id: int = END_ID, with_ids: bool = False, group_docs: int = GROUP_DOCS, full_enough: float = FULL_ENOUGH) -> DataFrame:
    """Pieces of documents dealt into sequences of at most ``width`` tokens.

    A document's ids are those of its text, then ``end_id``; a null or empty text has ``end_id``
    alone.  Each id lies in exactly one piece and pieces fill a sequence from offset 0 without
    gaps.  Rows with repeated or null doc_id are packed as documents of their own.  ``with_ids``
    adds the piece's ids as little-endian uint16 bytes.  Extra columns are ignored; an empty table
    gives no rows.  Rows are dealt to groups evenly whatever their values, and each task sorts its
    rows by a seeded hash before it forms groups, so a rerun of a lost task forms the same ones.
    """
    require(docs, "doc_id", "text")
    spark = docs.sparkSession

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path)
        last = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            coded = (ids for at in range(0, batch.num_rows, _TEXTS) for ids in encode(batch.column(1).slice(at, _TEXTS).to_pylist()))
            for doc, ids in zip(batch.column(0).to_pylist(), coded):
                ids += last
                n = len(ids) // 2
                for at in range(0, n, width):
                    for column, value in zip(out, (doc, at, min(width, n - at), n, ids[2 * at : 2 * (at + width)])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.int64()) for c in out[1:4]), pa.array(out[4], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = TaskContext.get().partitionId() << 40

        def emit() -> pa.RecordBatch:
            nonlocal held, number
            out: list[list] = [[] for _ in range(8)]
            most = -1
            for i, at, n, sequence, offset in _pack_group(held, width, full_enough):
                doc, start, _, total, ids = held[i]
                part = np.frombuffer(ids, "<u2")[at : at + n]
                for column, value in zip(out, (doc, start + at, n, crc(part), total, number + sequence, offset, part.tobytes() if with_ids else b"")):
                    column.append(value)
                most = sequence
            number += most + 1
            held = []
            arrays = [pa.array(c, pa.int64()) for c in out[:7]] + ([pa.array(out[7], pa.binary())] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                held.append(row)
                if len(held) == group_docs:
                    yield emit()
        if held:
            yield emit()

    pieces = docs.select(F.col("doc_id").cast("long"), words_text(F.col("text")).alias("text")).mapInArrow(tokenize, _PIECES)
    dealt = pieces.repartition(default_parallelism(spark)).sortWithinPartitions(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "start", "length", "ids")
    return dealt.mapInArrow(group, PACKED + (", ids binary" if with_ids else ""))
