"""Packing of tokenised documents into training windows: best-fit decreasing.

Every document becomes its token ids plus an end id. Overlong documents are
first cut into full windows; the rests are packed best-fit decreasing: longest
first, each into the open window with the tightest remaining capacity, found
in a segment tree indexed by remaining capacity. What best fit leaves loose
(windows with more than ``slack`` free places) is dissolved: its pieces are
laid end to end and cut freely at window ends, and the last rest of a buffer is
cut at powers of two, which need no padding.

One pass, no shuffle: each task packs its own partition in buffers of
``buffer_tokens`` ids, so memory does not follow the partition, nothing passes
through the driver, and no key can be hot. Window ids are the partition number
times 2**32 plus a counter, so a task that runs again gives the same rows.

Defined cases: a null or empty text is the end id alone; a null id is kept;
repeated rows and ids are documents of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.llm import textscan as ts

WINDOW = 2048
END_ID = 1
BUFFER_TOKENS = 1 << 22
SLACK = 32

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")
# Outside these characters the whole text goes to the tokenizer in one call.
_PLAIN = re.compile(r"[^\n\t\x20-\x7e\xa1-ɏ]")
_GAP = re.compile(r"\s ")


# The byte-level pre-tokenizer's pattern (fixed value); on plain texts it means
# the same to every regular expression engine.
_PRE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_ranks(path: str) -> dict[bytes, int] | None:
    """Tokens of a byte-level BPE file as bytes with their ids, if merging by id
    is merging by rank (every merge makes the token with the next id) and the
    file asks for the pattern above; else None."""
    import json
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if (model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel"
            or pre.get("add_prefix_space") or not pre.get("use_regex", True)):
        return None
    # Byte-level alphabet: printable bytes stand for themselves, others follow from 256.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = model["vocab"]
    for i, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if vocab.get(left + right) != 256 + i:
            return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(model["merges"])}


class TokenIds:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    Texts of plain characters are encoded by rank over the file's own vocabulary, in one
    call and without caches, so a worker's memory does not follow its texts. Texts
    with white space before a space, with control or special strings or other
    scripts, and all texts where the file allows no ranks, go to the tokenizer.
    """

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.by_rank = None
        ranks = _byte_ranks(path)
        if ranks:
            import tiktoken
            self.by_rank = tiktoken.Encoding("file", pat_str=_PRE, mergeable_ranks=ranks,
                                             special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if (self.by_rank is None or _PLAIN.search(text) or _GAP.search(text)
                or any(s in text for s in self.special)):
            ids = self.tok.encode(text, add_special_tokens=False).ids
        else:
            ids = self.by_rank(text)
        return np.array(ids, "<u4").tobytes()


class OpenWindows:
    """Segment tree over remaining capacities 0..size; leaves are stacks of windows."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return ``(capacity, window)`` of the tightest window with
        ``need`` free places or more."""
        count, at = self.count, need + self.leaves
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, self.stacks[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece (lengths 1..size)."""
    window = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    opened, tree = 0, OpenWindows(size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found, opened = (size, opened), opened + 1
        window[i], offset[i] = found[1], size - found[0]
        if found[0] > need:
            tree.put(found[0] - need, found[1])
    return window, offset


def _pack(pieces: list[tuple], size: int, slack: int) -> tuple[list[tuple], int]:
    """``pieces`` of ``(doc, start, ids, doc_tokens)``, at most ``size`` ids each, as
    ``(doc, start, ids, doc_tokens, window, offset)``; and the number of windows."""
    lengths = np.array([len(p[2]) >> 2 for p in pieces], np.int64)
    window, offset = best_fit_decreasing(lengths, size)
    n = int(window.max()) + 1 if len(window) else 0
    loose = np.bincount(window, lengths, n) < size - slack
    number = np.cumsum(~loose) - 1
    out, rest = [], []
    for p, w, o in zip(pieces, window.tolist(), offset.tolist()):
        if loose[w]:
            rest.append((w, o, p))
        else:
            out.append((*p, int(number[w]), o))
    rest.sort(key=lambda x: (x[0], x[1]))
    at, left = int((~loose).sum()), sum(len(x[2][2]) >> 2 for x in rest)

    def target() -> int:       # a full window, or the largest power of two left
        return size if left >= size else 1 << (left.bit_length() - 1) if left else 0
    goal, used = target(), 0
    for _, _, (doc, start, ids, total) in rest:
        done, n_ids = 0, len(ids) >> 2
        while done < n_ids:
            k = min(n_ids - done, goal - used)
            out.append((doc, start + done, ids[4 * done:4 * (done + k)], total, at, used))
            done, used, left = done + k, used + k, left - k
            if used == goal:
                at, used, goal = at + 1, 0, target()
    return out, at


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID,
                   buffer_tokens: int = BUFFER_TOKENS, slack: int = SLACK) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into windows of at most ``window`` ids.

    ``tokenizer`` is the path of a tokenizer file that every executor can
    read. One row per piece: ``doc_id, start`` (ids of its document before
    it), ``length, ids`` (unsigned 32-bit little-endian), ``doc_tokens``
    (with the end id), ``sequence_id, offset``. A sequence is full to within
    ``slack`` places or its length is a power of two.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TokenIds(tokenizer)
        base, used = TaskContext.get().partitionId() << 32, 0
        pieces: list[tuple] = []
        held = 0

        def flush():
            nonlocal pieces, held, used
            rows, n = _pack(pieces, window, slack)
            cols = list(zip(*rows))
            first, used, pieces, held = base + used, used + n, [], 0
            step = 4096
            for i in range(0, len(rows), step):
                doc, start, ids, total, win, off = (c[i:i + step] for c in cols)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(start, pa.int64()),
                     pa.array([len(x) >> 2 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(total, pa.int64()), pa.array([first + w for w in win], pa.int64()),
                     pa.array(off, pa.int64())],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                total = len(ids) >> 2
                for start in range(0, total, window):
                    part = ids[4 * start:4 * (start + window)]
                    pieces.append((doc, start, part, total))
                    held += len(part) >> 2
                    if held >= buffer_tokens:
                        yield from flush()
        if pieces:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(ts.returning(run), SCHEMA)


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
