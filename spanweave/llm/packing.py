"""Packing of token sequences into windows of one length, online and in bounded space.

Each partition keeps a fixed number of open windows. A remainder goes into the open window that it fills best;
where it fits none, the fullest window is closed. What is left open at the end of the partitions is merged.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField

from spanweave.llm.bpe import library_encoder, read_spec
from spanweave.llm.common import column_of, importable, map_batches, scripts_of, texts_of
from spanweave.session import stage

#: Partitions whose leftovers are merged by one task. At most this many times the open windows meet there.
MERGED = 32
#: Window numbers: the partition in the upper bits, merged windows above all partitions.
_PART, _MERGED_FROM = 33, 1 << 29

_PIECE = [StructField("piece_start", LongType()), StructField("length", LongType()), StructField("token_ids", ArrayType(IntegerType())),
          StructField("media_tokens", LongType()), StructField("window_id", LongType()), StructField("window_offset", LongType())]
_NAMES = ["media_id", *[f.name for f in _PIECE]]


class OpenWindows:
    """At most ``limit`` windows with room, in order of their room."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.next = size, limit, 0
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list] = {}

    def take(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, piece: tuple, length: int) -> list:
        """Put a piece away; the pieces of windows that this closes."""
        closed = []
        at = bisect.bisect_left(self.rooms, (length, -1))
        if at == len(self.rooms):  # none has the room
            if len(self.rooms) >= self.limit:
                closed += self.held.pop(self.rooms.pop(0)[1])
            window, room = self.take(), self.size
            self.held[window] = []
        else:
            room, window = self.rooms.pop(at)
        self.held[window].append((*piece, window, self.size - room))
        if room == length:
            closed += self.held.pop(window)
        else:
            bisect.insort(self.rooms, (room - length, window))
        return closed


def _batch(rows: list, key: pa.DataType, closed: bool | None) -> pa.RecordBatch:
    media, start, ids, total, window, offset = zip(*rows) if rows else ([],) * 6
    lengths = np.array([len(x) for x in ids], np.int64)
    values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)
    arrays = [pa.array(media, key), pa.array(start, pa.int64()), pa.array(lengths), lists, pa.array(total, pa.int64()),
              pa.array(window, pa.int64()), pa.array(offset, pa.int64())]
    names = list(_NAMES)
    if closed is not None:
        arrays.append(pa.array([closed] * len(rows), pa.bool_()))
        names.append("closed")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def pack_scripts(scripts: DataFrame, tokenizer: str, window: int = 1024, open_windows: int = 64,
                 end_id: int | None = 0) -> DataFrame:
    """Cut the tokens of each media's text into pieces and lay them into windows of at most ``window`` tokens.

    ``scripts``: ``media_id``, ``text``; other columns are left out. Null text counts as empty. ``end_id`` closes
    each text (none if null). Result, one row per piece: ``media_id``, ``piece_start`` (ids of the text before it),
    ``length``, ``token_ids``, ``media_tokens`` (ids of the text), ``window_id``, ``window_offset``. Each id lies in
    one piece and the pieces of a window follow without gaps. Texts without any id make no piece. Repeated rows
    are packed each for itself.

    Full windows are cut off the front of a text and need no company. Only what stays open at the end of a
    partition, at most ``open_windows`` windows, is shuffled, and ``MERGED`` partitions of it meet in a task; there
    pieces are cut so that all windows but the last come out full. The pieces are staged once in the shared
    folder, since both parts are read from them.
    """
    spec = read_spec(scripts, tokenizer)
    df = scripts_of(scripts)

    def place(batches):
        encoder = library_encoder(spec.value)
        windows = OpenWindows(window, open_windows)
        base = TaskContext.get().partitionId() << _PART
        key, rows, held = pa.int64(), [], 0
        for batch in batches:
            media = column_of(batch, "media_id")
            key = media.type
            for media_id, packed in zip(media.to_pylist(), encoder(texts_of(batch))):
                ids = np.frombuffer(packed, "<i4")
                if end_id is not None:
                    ids = np.append(ids, np.int32(end_id))
                total = len(ids)
                full = total - total % window
                for start in range(0, full, window):
                    rows.append((media_id, start, ids[start:start + window], total, windows.take(), 0))
                if total > full:
                    rows += windows.place((media_id, full, ids[full:].copy(), total), total - full)
                held += total
                if held >= 1 << 20:
                    yield _batch([(*r[:4], base + r[4], r[5]) for r in rows], key, True)
                    rows, held = [], 0
        yield _batch([(*r[:4], base + r[4], r[5]) for r in rows], key, True)
        for pieces in windows.held.values():
            yield _batch([(*r[:4], base + r[4], r[5]) for r in pieces], key, False)

    placed = stage(map_batches(df, place, *_PIECE, StructField("closed", BooleanType())))
    left = placed.where("NOT closed").withColumn("__group", F.expr(f"shiftright(window_id, {_PART}) div {MERGED}"))

    def merge(pieces: pa.Table) -> pa.Table:
        # Fullest windows first, their pieces in order: the shortest, most flexible pieces come last.
        key = pieces.schema.field("media_id").type
        rows = sorted(pieces.to_pylist(), key=lambda r: (-r["length"], r["window_id"], r["window_offset"]))
        base = (_MERGED_FROM + rows[0]["__group"]) << _PART
        out, serial, used = [], 0, 0
        for r in rows:
            ids, done = np.array(r["token_ids"], np.int32), 0
            while done < len(ids):
                n = min(window - used, len(ids) - done)
                out.append((r["media_id"], r["piece_start"] + done, ids[done:done + n], r["media_tokens"], base + serial, used))
                done, used = done + n, used + n
                if used == window:
                    serial, used = serial + 1, 0
        return pa.Table.from_batches([_batch(out, key, None)])

    merged = importable(left).select(*_NAMES, "__group").groupBy("__group").applyInArrow(
        merge, placed.select(*_NAMES).schema)
    return placed.where("closed").select(*_NAMES).unionByName(merged)
