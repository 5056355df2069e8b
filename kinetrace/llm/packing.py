"""Vector bin packing of training examples by the dot-product heuristic.

An open sequence has three remaining capacities: tokens, segments and loss-bearing tokens. The next piece
is the one, of those that fit, with the largest dot product of its needs and the remaining capacities,
each as a share of its limit. Pieces of equal needs are one class, so that a choice compares classes and
not pieces. Where no piece fits, the piece with the largest dot product is cut to fill the tokens exactly.
A sequence that the segment or loss limit (or the end of the input) closes early is padded if it lacks no more than a
hundredth; else it is cut to a power of two of tokens, which needs no padding, and the rest goes back.

Each input partition is packed by itself, in pools of bounded size, with no shuffle: a task's loss repeats
from its input split alone. Texts are cut into pieces of `capacity` tokens first.

Documents are texts, of which all tokens bear loss, or arrays of segments (text, loss), which are encoded one by one
and of which the tokens of segments with loss bear it; the end id is as the last segment. `prompted` makes segments of plain
texts: the first line, with its line end, is the prompt and bears no loss, the lines after it bear loss, and so does a text
of one line. A piece comes with its token
ids (unsigned 32-bit, little-endian) and its loss mask (one byte a token, 0 or 1).

Defined cases: null text is empty and gets its end id alone; repeated rows are packed as often as they occur;
null doc_ids stay null; very long texts are cut into as many pieces as they need; pieces of equal needs are taken last in,
first out; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.tokens import encoder
from kinetrace.session import prepare

POOL_TOKENS = 1 << 21
TRIES = 16
#: A sequence that lacks at most one PAD-th of the capacity is padded, not cut.
PAD = 100
#: Limits for instruction data: at most 16 pieces and 4,064 loss-bearing tokens in a sequence of 4,096.
INSTRUCTION = {"capacity": 4096, "max_segments": 16, "max_loss": 4064}


class Item:
    """A piece of an example: ids[lo:hi] of document `doc`, with a mask of loss-bearing tokens or None for all."""

    __slots__ = ("doc", "hi", "ids", "lo", "mask", "needs")

    def __init__(self, doc, ids, lo, hi, mask=None):
        self.doc, self.ids, self.lo, self.hi, self.mask = doc, ids, lo, hi, mask
        #: (tokens, loss-bearing tokens)
        self.needs: tuple[int, int] = hi - lo, hi - lo if mask is None else int(np.count_nonzero(mask[lo:hi]))

    def cut(self, n: int) -> tuple[Item, Item]:
        return Item(self.doc, self.ids, self.lo, self.lo + n, self.mask), Item(self.doc, self.ids, self.lo + n, self.hi, self.mask)


class Pool:
    """Pieces by (tokens, loss tokens), with arrays of the classes for the dot products."""

    def __init__(self):
        self.items: dict[tuple[int, int], list[Item]] = {}
        self.stale = True
        self.tokens = 0

    def add(self, item: Item) -> None:
        held = self.items.setdefault(item.needs, [])
        self.stale |= not held
        held.append(item)
        self.tokens += item.hi - item.lo

    def take(self, key: tuple[int, int]) -> Item:
        item = self.items[key].pop()
        if not self.items[key]:
            del self.items[key]
            self.live[self.place[key]] = False
        self.tokens -= item.hi - item.lo
        return item

    def classes(self) -> np.ndarray:
        if self.stale or (len(self.live) > 64 and self.live.sum() * 2 < len(self.live)):
            self.keys = list(self.items)
            self.place = {k: i for i, k in enumerate(self.keys)}
            self.needs = np.array(self.keys, np.int64).reshape(-1, 2)
            self.live = np.ones(len(self.keys), bool)
            self.stale = False
        return self.needs

    def best(self, tokens: int, segments: int, loss: int, limits: tuple[int, int, int]) -> tuple[tuple[int, int] | None, list[tuple[int, int]]]:
        """The class with the largest dot product that fits, or else those of the largest that could be cut."""
        needs = self.classes()
        if not self.items:
            return None, []
        t, s, m = limits
        score = needs[:, 0] * (tokens / (t * t)) + needs[:, 1] * (loss / (m * m)) + segments / (s * s)
        fits = self.live & (needs[:, 0] <= tokens) & (needs[:, 1] <= loss)
        fit = np.where(fits, score, -1.0)
        i = int(fit.argmax())
        if fits[i]:
            return self.keys[i], []
        long = np.flatnonzero(self.live & (needs[:, 0] > min(tokens, loss)))
        top = long[np.argpartition(-score[long], TRIES - 1)[:TRIES]] if len(long) > TRIES else long
        return None, [self.keys[k] for k in top[np.argsort(-score[top], kind="stable")]]

    def head(self, keys: list[tuple[int, int]], room: int, spare: int, slack: int) -> Item | None:
        """The first `room` tokens of a piece of one of these classes, whose rest stays, if they keep the loss limit.

        Where none does, the first `spare` tokens, if what stays free is no more than `slack`.
        """
        for n in (room, spare) if 0 < spare < room <= spare + slack else (room,):
            for key in keys:
                if key[0] > n:
                    part, rest = self.items[key][-1].cut(n)
                    if part.needs[1] <= spare:
                        self.take(key)
                        self.add(rest)
                        return part
        return None


def pack_pool(pool: Pool, limits: tuple[int, int, int], last: bool) -> Iterator[list[Item]]:
    """Sequences from a pool; unless it is the last one, an unfinished sequence's pieces go back."""
    capacity, segments, loss = limits
    slack = capacity // PAD
    while pool.items:
        bin_, room, spare = [], capacity, loss
        while room and len(bin_) < segments:
            fit, longer = pool.best(room, segments - len(bin_), spare, limits)
            item = pool.take(fit) if fit is not None else pool.head(longer, room, spare, slack)
            if item is None:
                break
            bin_.append(item)
            room -= item.hi - item.lo
            spare -= item.needs[1]
        fill = capacity - room
        if room and not pool.items and not last:
            for item in bin_:
                pool.add(item)
            return
        if not bin_:  # one piece alone breaks the loss limit: half of it at a time
            item = pool.take(next(iter(pool.items)))
            for part in item.cut((item.hi - item.lo) // 2):
                pool.add(part)
            continue
        if room > slack and fill & (fill - 1):
            goal, kept, size = 1 << (fill.bit_length() - 1), [], 0
            for item in bin_:
                n = item.hi - item.lo
                if size + n <= goal:
                    kept.append(item)
                elif size < goal:
                    head, rest = item.cut(goal - size)
                    kept.append(head)
                    pool.add(rest)
                else:
                    pool.add(item)
                size = min(goal, size + n)
            bin_ = kept
        yield bin_


def pack_stream(examples: Iterator[tuple[object, np.ndarray, np.ndarray | None]], limits: tuple[int, int, int], pool_tokens: int = POOL_TOKENS) -> Iterator[list[Item]]:
    """Pack (document, ids, loss mask or None) examples, holding about `pool_tokens` tokens at a time."""
    pool, capacity = Pool(), limits[0]
    for doc, ids, mask in examples:
        for lo in range(0, len(ids), capacity):
            item = Item(doc, ids, lo, min(len(ids), lo + capacity), mask)
            if item.hi - item.lo == capacity and item.needs[1] <= limits[2]:
                yield [item]
            else:
                pool.add(item)
        if pool.tokens >= pool_tokens:
            yield from pack_pool(pool, limits, False)
    yield from pack_pool(pool, limits, True)


FLUSH_TOKENS = 1 << 20


def _packer(limits: tuple[int, int, int], make: Callable):
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "ids": pa.binary(), "loss_mask": pa.binary(), "doc_tokens": pa.int64(), "loss_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = make()
        number = TaskContext.get().partitionId() << 33

        def examples():
            for batch in batches:
                for doc, content in zip(batch.column("doc_id"), batch.column("content"), strict=True):
                    yield doc.as_py(), *to_ids(content.as_py())

        rows, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

        for sequence in pack_stream(examples(), limits):
            at = 0
            for x in sequence:
                n = x.hi - x.lo
                mask = bytes([1]) * n if x.mask is None else x.mask[x.lo : x.hi].astype(np.uint8).tobytes()
                rows.append((x.doc, x.lo, np.ascontiguousarray(x.ids[x.lo : x.hi], "<u4").tobytes(), mask, len(x.ids), x.needs[1], number, at))
                at += n
            number += 1
            held += at
            if len(rows) >= 4096 or held >= FLUSH_TOKENS:
                yield flush()
                rows.clear()
                held = 0
        if rows:
            yield flush()

    return run


def encode_segments(encode: Callable, segments: list[dict] | None, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of segments (text, loss) with the end id, and the mask of those that bear loss."""
    parts = [(encode(x["text"]), bool(x["loss"])) for x in segments or [] if x is not None]
    parts.append((np.array([end_id], np.uint32), parts[-1][1] if parts else True))
    return np.concatenate([ids for ids, _ in parts]), np.repeat([loss for _, loss in parts], [len(ids) for ids, _ in parts])


def prompted(docs: DataFrame) -> DataFrame:
    """doc_id and segments of plain texts: the first of several lines is a prompt without loss."""
    first = "substring_index(text, '\n', 1)"
    parts = f"array(named_struct('text', concat({first}, '\n'), 'loss', false), named_struct('text', substring(text, length({first}) + 2), 'loss', true))"
    one = "array(named_struct('text', coalesce(text, ''), 'loss', true))"
    return docs.select("doc_id", F.expr(f"if(instr(text, '\n') > 0, {parts}, {one})").alias("segments"))


def pack_documents(
    docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 2, capacity: int = 4096, max_segments: int = 512, max_loss: int | None = None, segments: str | None = None
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset, ids, loss_mask.

    `segments` names a column array<struct<text string, loss boolean>> to be packed in place of text.
    """
    prepare(docs.sparkSession)

    def make():
        encode = encoder(tokenizer, kind).encode
        if segments is not None:
            return lambda x: encode_segments(encode, x, end_id)
        return lambda text: (np.append(encode(text), np.uint32(end_id)), None)

    limits = (capacity, max_segments, capacity if max_loss is None else max_loss)
    schema = "doc_id long, start long, ids binary, loss_mask binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"
    content = F.col("text") if segments is None else F.transform(segments, lambda x: F.struct(x["text"].alias("text"), x["loss"].alias("loss")))
    pieces = docs.select(F.col("doc_id").cast("long"), content.alias("content")).mapInArrow(_packer(limits, make), schema)
    length = F.expr("cast(octet_length(ids) div 4 as bigint)").alias("length")
    return pieces.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "loss_tokens", "sequence_id", "offset", "ids", "loss_mask")
