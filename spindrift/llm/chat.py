"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered as one text: ``<|role|>``, the escaped text, ``<|end|>`` for each turn.
Control strings inside texts are broken by a backslash, reversibly, so markers occur only between
turns.  The tokenizer holds the markers as atomic tokens and so splits at them; the whole
conversation is encoded once with offsets, and the sorted spans of the turns under the loss are cut
with the sorted token spans by binary search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_parallelism, require, words_text

LOSS_ROLES = ("assistant",)
END = "<|end|>"
_CONTROL = re.compile(r"\\|<(?=\|)|<(?=/?s>)|\[(?=/?INST\])|<(?=</?SYS>)")
#: Characters rendered before a long conversation's turns are encoded and let go.
FLUSH_CHARS = 4_000_000


def escape(text: str) -> str:
    r"""``\`` doubled, and a ``\`` behind the first character of each control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    """The inverse of escape."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def role_marker(role: str) -> str:
    """The marker of a role; characters that a marker can't hold are written as escapes."""
    return f"<|{re.sub(r'[^A-Za-z0-9_-]', lambda m: f'%{ord(m[0]):x};', role)}|>"


def marker_role(marker: str) -> str:
    return re.sub(r"%([0-9a-f]+);", lambda m: chr(int(m[1], 16)), marker[2:-2])


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of whole turns (role, text) and the span of each escaped text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = role_marker(role), escape(text)
        parts += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


_MARKER = re.compile(r"<\|([A-Za-z0-9_%;-]*)\|>")


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered conversation, texts unescaped."""
    turns, role, start = [], None, 0
    for m in _MARKER.finditer(text):
        if role is None:
            role, start = marker_role(m[0]), m.end()
        else:
            turns.append((role, unescape(text[start : m.start()])))
            role = None
    return turns


@lru_cache(maxsize=2)
def chat_tokenizer(path: str):
    """The tokenizer of a file with the usual markers as atomic tokens."""
    from tokenizers import AddedToken, Tokenizer

    coder = Tokenizer.from_file(path)
    coder.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (END, *map(role_marker, ("system", "user", "assistant", "tool")))])
    return coder


def encode(text: str, path: str):
    """The encoding of a whole text."""
    return chat_tokenizer(path).encode(text, add_special_tokens=False)


def token_spans(text: str, path: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Ids of the text, encoded once, and the start and end offset of each."""
    got = encode(text, path)
    return got.ids, *offsets(got)


def offsets(got) -> tuple[np.ndarray, np.ndarray]:
    """The start and the end of each token of an encoding."""
    spans = np.fromiter(chain.from_iterable(got.offsets), np.int64, 2 * len(got))
    return spans[::2].copy(), spans[1::2].copy()


def masked_text(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of text that the masked tokens cover, in order, as the offsets say.

    Tokens that share a character, as bytes of one do, cover it once.
    """
    s, e = starts[mask], ends[mask]
    if not len(s):
        return []
    reach = np.maximum.accumulate(e)
    breaks = np.flatnonzero(s[1:] > reach[:-1]) + 1
    firsts, lasts = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(s)]]) - 1
    return [text[a:b] for a, b in zip(s[firsts].tolist(), reach[lasts].tolist())]


@lru_cache(maxsize=2)
def splits_at_end(path: str) -> bool:
    """Whether the tokenizer gives the same ids for turns apart as for turns together, tried on samples."""
    coder = chat_tokenizer(path)
    ids = lambda text: coder.encode(text, add_special_tokens=False).ids
    turns = [render([(role, text)])[0] for role in ("assistant", "user", "", "other role", "o|d") for text in ("", " x", "x ", "\n\n", "é日😀", "</s>", "12", "'s")]
    return all(ids(a + b) == ids(a) + ids(b) for a in turns for b in turns)


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """A mask over tokens, and for each span its first token and the one behind its last.

    Tokens and spans are sorted by offset; a span's tokens lie between the first that ends behind
    its start and the last that starts before its end.
    """
    cuts = np.array(spans, np.int64).reshape(-1, 2)
    places = np.stack([np.searchsorted(ends, cuts[:, 0], "right"), np.searchsorted(starts, cuts[:, 1], "left")], axis=1)
    mask = np.zeros(len(starts), bool)
    for lo, hi in places.tolist():
        mask[lo:hi] = True
    return mask, places


def loss_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """The loss mask over tokens, and for each span the pieces of text that its tokens cover."""
    mask, places = loss_mask(starts, ends, spans)
    covered = []
    for (a, b), (lo, hi) in zip(spans, places.tolist()):
        runs: list[tuple[int, int]] = []
        if hi > lo:
            s, e = np.maximum(starts[lo:hi], a), np.minimum(ends[lo:hi], b)
            breaks = np.flatnonzero(s[1:] > np.maximum.accumulate(e)[:-1]) + 1
            firsts = np.concatenate([[0], breaks])
            lasts = np.concatenate([breaks, [len(s)]])
            runs = [(int(s[i]), int(e[i:j].max())) for i, j in zip(firsts, lasts)]
        covered.append(runs)
    return mask, covered


class _Digest:
    """What a conversation's output says, read back as it is written."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.pending: list[tuple[str, str]] = []
        self.size = 0

    def add(self, role: str, text: str, path: str) -> None:
        self.pending.append((role, text))
        self.size += len(text)
        if self.size >= FLUSH_CHARS and splits_at_end(path):
            self.flush(path)

    def flush(self, path: str) -> None:
        if not self.pending:
            return
        text, spans = render(self.pending)
        starts, ends = offsets(encode(text, path))
        mask, _ = loss_mask(starts, ends, [s for (role, _), s in zip(self.pending, spans) if role in LOSS_ROLES])
        # what the mask covers, marker and all if it covered one
        for piece in masked_text(text, starts, ends, mask):
            said = unescape(piece)
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))
        for role, said in parse(text):
            self.turns += 1
            self.all.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        self.chars += len(text)
        self.pending, self.size = [], 0

    def row(self, path: str) -> tuple:
        self.flush(path)
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def format_conversations(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, text, ids and loss_mask (one boolean an id) of each whole conversation.

    Rows are (conv_id, turn, role, text), in order of turn, ties by role and text; null roles and
    texts count as empty; rows without conv_id form one conversation with a null id.  For
    conversations that fit in memory; digest_conversations streams those of any length.
    """
    require(rows, "conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = [(t["role"], t["text"]) for t in turns]
                text, spans = render(pairs)
                ids, starts, ends = token_spans(text, tokenizer_path)
                mask, _ = loss_mask(starts, ends, [s for (role, _), s in zip(pairs, spans) if role in LOSS_ROLES])
                for column, value in zip(out, (conv, text, ids, mask.tolist())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.bool_()))], names=["conv_id", "text", "ids", "loss_mask"])

    turn = F.struct(F.col("turn"), words_text(F.col("role")).alias("role"), words_text(F.col("text")).alias("text"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(run, "conv_id long, text string, ids array<int>, loss_mask array<boolean>")


def digest_conversations(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row of digests for each conversation, read back from the formatted output.

    Turns stream in order through each task, so a conversation of any length takes bounded memory:
    beyond FLUSH_CHARS it is encoded in runs of whole turns.  A run ends behind an end marker, where
    the tokenizer splits first of all, whatever role follows, so ids and mask are those of one
    encoding; a tokenizer that does not split so (splits_at_end) is given the whole conversation.
    Order and nulls are as in format_conversations; empty texts have no loss, repeated rows are
    turns of their own, an empty table gives no rows, extra columns are ignored.
    """
    require(rows, "conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def block() -> pa.RecordBatch:
            nonlocal done
            columns, done = list(zip(*done)), []
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)

        for batch in batches:
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row(tokenizer_path))
                    now = _Digest(conv)
                now.add(role, text, tokenizer_path)
            if done:
                yield block()
        if now is not None:
            done.append(now.row(tokenizer_path))
            yield block()

    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", words_text(F.col("role")).alias("role"), words_text(F.col("text")).alias("text"))
    dealt = clean.repartition(default_parallelism(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, DIGEST)
