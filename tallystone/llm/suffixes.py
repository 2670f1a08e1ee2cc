"""Suffix-array dedup: remove bytes of long strings that documents of smaller ids hold.

A byte goes if a string of LENGTH bytes that covers it also starts in a document
with a smaller id. Suffixes are sorted sparsely, one for all windows that share
an anchor, and none that could lie in such a string is left out:

1. Anchors. In every window of LENGTH bytes the leftmost seed (SEED bytes) of
   the smallest hash is its anchor, a choice that depends on the window's bytes
   alone, so equal windows in two documents have equal anchors. Anchors whose
   seed's hash occurs once in the corpus are dropped: counts of hashes are
   exchanged, no text. A collision of hashes only keeps an anchor too many.
2. Suffixes. Every task sends each distinct context of its remaining anchors once,
   with the smallest id that it has there: the suffix at the anchor, then the bytes
   before it from right to left. Suffixes go to ranges of leading bytes. Splitters
   are whole keys from a sample, so the suffixes of one frequent seed, whatever
   surrounds it, spread over as many ranges as they need; only equal suffixes,
   one a task, always share a range.
3. Sorting. Each range sorts its suffixes by multikey quicksort, and likewise the
   bytes before the anchors. Common prefixes of neighbours give classes of
   equal right and left bytes; a window's class is a pair of them, and the class's
   smallest id decides. All comparisons are of bytes.
4. Boundaries. A window whose right bytes agree with one of its range's splitters
   may have equals in the next range. The least of each such class goes, as a suffix
   of its own, through a second exchange by its LENGTH bytes, which sorts and
   compares in the same way.
5. Removal. Tasks read the verdicts on their own contexts and cut the bytes.

Documents are saved with the number of the task that wrote them; candidates and
verdicts come back to the tasks through ``replies``. A task finds its own contexts
among its verdicts by 128 bits of hash. The text is never shuffled. Up to
MAX_RANGES ranges of RANGE_BYTES of text each; beyond, ranges grow with the corpus.

Defined cases: null and empty texts lose nothing; rows of equal ids do not
remove each other's bytes, nor do strings that a document itself repeats; a null
id counts as larger than any; texts shorter than LENGTH stay whole; an empty
table gives no rows; columns named as results are replaced, others are kept
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.common import fresh, saved, slices, without
from tallystone.llm.replies import Replies, packed

LENGTH, SEED = 50, 24
REACH = LENGTH - SEED  # bytes a window may hold before or after its anchor's seed
CONTEXT = LENGTH + REACH
FLUSH = 200_000
SLICE = 2 << 20  # text bytes handled at once
SPLITTER_SAMPLE = 60_000
#: Text bytes for each range, most ranges, and most partitions of an exchange.
RANGE_BYTES, MAX_RANGES, MAX_PARTITIONS = 16 << 20, 1 << 16, 1 << 13
NO_ID = np.iinfo(np.int64).max
SAMPLE = -1  # in place of a task's number
OTHERS = np.uint32(1 << 31)  # in a mask: the task has the context under larger ids too
U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes from each position, by doubling a polynomial."""
    base = 0x9E3779B97F4A7C15
    h, power, width = data.astype(U) + U(1), base, 1
    rest, tail, p = SEED - (1 << SEED.bit_length() - 1), None, 0
    while width * 2 <= SEED:
        h = h[:-width] * U(power) + h[width:]
        power, width = power * power & (2**64 - 1), width * 2
        if width == rest:
            tail, p = h, power
    n = len(data) - SEED + 1
    return _mix(h[:n] * U(p) + tail[width : width + n])


def anchors(data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, their seeds' hashes, rows, and 32-bit masks of their windows.

    ``data`` holds the rows' bytes one after another; ``stops`` is where each
    row begins, and the end. Bit o of a mask: a window of the row starts o
    bytes before the anchor and has it as anchor.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(U), none, none.astype(np.uint32)
    h = seed_hashes(data)
    best = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    width, span = 1, REACH + 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    windows = len(data) - LENGTH + 1
    best = np.minimum(best[:windows], best[span - width : span - width + windows])
    inside = np.zeros(windows, bool)
    for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
        if b - a >= LENGTH:
            inside[a : b - LENGTH + 1] = True
    start = np.flatnonzero(inside)
    if not len(start):
        return none, none.astype(U), none, none.astype(np.uint32)
    at = (best[start] & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    mask = np.add.reduceat(np.uint32(1) << (at - start).astype(np.uint32), first, dtype=np.uint32)
    at = at[first]
    return at, h[at], np.searchsorted(stops, at, "right") - 1, mask


def contexts(data: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Sort keys: the LENGTH bytes from each anchor, then the REACH bytes before it backwards; zero where no window of the mask reaches."""
    padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[at]
    left = np.frexp(mask.astype(np.float64))[1] - 1  # the highest and the lowest bit
    right = LENGTH + 1 - np.frexp((mask & (~mask + np.uint32(1))).astype(np.float64))[1]
    out = np.empty_like(around)
    out[:, :LENGTH], out[:, LENGTH:] = around[:, REACH:], around[:, REACH - 1 :: -1]
    column = np.arange(LENGTH, dtype=np.int8)
    out[:, :LENGTH][column >= right[:, None].astype(np.int8)] = 0
    out[:, LENGTH:][column[:REACH] >= left[:, None].astype(np.int8)] = 0
    return out


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words, filled up with zeros."""
    wide = np.zeros((len(rows), rows.shape[1] + (-rows.shape[1] % 8)), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(U)


def context_keys(context: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Two hashes of each context and its mask."""
    out = np.zeros(len(context), KEY)
    h = _mix(mask.astype(U) + U(0x51ED270B))
    g = mask.astype(U)
    for word in words_of(context).T:
        h = (h ^ _mix(word + U(0x2545F491))) * U(0x9FB21C651E98DF25)
        h ^= h >> U(31)
        g = g * U(0xD1342543DE82EF95) + word
    out["h"], out["g"] = h, _mix(g)
    return out


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows of words.

    Three-way partitions by one word around a pivot: the smaller and the larger
    rows are partitioned again by that word, the equal ones by the next. All
    segments of a round are partitioned together.
    """
    n, width = words.shape
    order = np.arange(n)
    if n < 2:
        return order
    value = words[:, 0].copy()
    start, size, depth = np.array([0]), np.array([n]), np.array([0])
    while len(start):
        first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(start)), size)
        base = (start - first)[of]
        place = base + np.arange(len(of))
        row, v = order[place], value[place]
        a, b, c = v[first], v[first + size // 2], v[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[of]
        less, more = v < pivot, v > pivot
        n_less, n_more = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(more, first, dtype=np.int64)
        n_same = size - n_less - n_more
        up_less, up_more = np.cumsum(less), np.cumsum(more)  # places below, in their segment, by kind
        up_less -= (up_less[first] - less[first])[of]
        up_more -= (up_more[first] - more[first])[of]
        inside = np.arange(len(of)) - first[of]
        to = np.where(less, up_less - 1, np.where(more, (n_less + n_same)[of] + up_more - 1, n_less[of] + inside - up_less - up_more))
        to += start[of]
        order[to], value[to] = row, v
        begin, deeper = start + n_less, depth + 1
        again = (n_same > 1) & (deeper < width)
        if again.any():
            at = np.repeat(begin[again], n_same[again]) + _ramp(n_same[again])
            value[at] = words[order[at], np.repeat(deeper[again], n_same[again])]
        some, rest = n_less > 1, n_more > 1
        start = np.concatenate([start[some], begin[again], (begin + n_same)[rest]])
        size = np.concatenate([n_less[some], n_same[again], n_more[rest]])
        depth = np.concatenate([depth[some], deeper[again], depth[rest]])
    return order


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def in_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of equally long rows, and the common prefix of each with the row before."""
    n, width = rows.shape
    order, common = multikey_quicksort(words_of(rows)), np.zeros(n, np.int64)
    for a in range(1, n, 1 << 17):
        b = min(n, a + (1 << 17))
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        common[a:b] = np.where(differ.any(1), differ.argmax(1), width)
    return order, common


def common_prefix(rows: np.ndarray, one: bytes | None) -> np.ndarray:
    """Leading bytes that each row shares with one other; -1 without it."""
    if one is None:
        return np.full(len(rows), -1)
    differ = rows != np.frombuffer(one, np.uint8)[: rows.shape[1]]
    return np.where(differ.any(1), differ.argmax(1), rows.shape[1])


def smaller_elsewhere(context: np.ndarray, mask: np.ndarray, least: np.ndarray, low: bytes | None = None, high: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the windows that a suffix with a smaller id holds too, and of those least here that may have equals beyond the splitters."""
    n = len(context)
    out, open_ = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    if not n:
        return out, open_
    right, right_common = in_order(context[:, :LENGTH])
    left, left_common = in_order(context[:, LENGTH:])
    edge = np.maximum(common_prefix(context[:, :LENGTH], low), common_prefix(context[:, :LENGTH], high))
    beside = np.maximum(right_common, np.append(right_common[1:], 0))  # the longest prefix shared with a neighbour
    shared = np.empty(n, np.int64)
    shared[right] = beside
    cls, pre = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(REACH + 1):
        bit, need = np.uint32(1 << o), LENGTH - o
        has = (mask & bit) > 0
        rows = np.flatnonzero(has & ((shared >= need) | (edge >= need)))
        if not len(rows):
            continue
        cls[right] = np.cumsum(right_common < need)
        pre[left] = np.cumsum(left_common < o) if o else 0
        key = (cls * (n + 1) + pre)[rows]
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        smallest = np.repeat(np.minimum.reduceat(least[rows], first), np.diff(np.append(first, len(rows))))
        out[rows[smallest < least[rows]]] |= bit
        open_[rows[(smallest == least[rows]) & (edge[rows] >= need)]] |= bit
    return out, open_


def window_of(context: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The LENGTH bytes of the windows that start ``offset`` bytes before the anchors."""
    around = np.concatenate([context[:, : LENGTH - 1 : -1], context[:, :LENGTH]], axis=1)  # as in the text
    return np.take_along_axis(around, (REACH - offset)[:, None] + np.arange(LENGTH), 1)


class _Candidates:
    """Hashes of seeds that occur twice or more."""

    def __init__(self, blobs: list[bytes]):
        self.hashes = np.unique(np.frombuffer(b"".join(blobs), U))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of candidates among the hashes."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        short = h >> U(8)
        place = np.minimum(np.searchsorted(self.hashes, short), len(self.hashes) - 1)
        return np.flatnonzero(self.hashes[place] == short)


def _by_task(batches, columns: list[str]) -> Iterator[tuple[int, list, list[str], pa.RecordBatch | None, tuple[int, int]]]:
    """(task number, ids, texts, batch, span) in slices of one task's rows; a slice never spans batches."""
    for batch in batches:
        numbers = batch.column("__t").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            for at, texts in slices(part.column(columns[1]), SLICE):
                ids = part.column(columns[0]).slice(at, len(texts))
                ids = np.array([NO_ID if x is None else x for x in ids.to_pylist()], np.int64)
                yield int(numbers[a]), ids, texts, part.slice(at, len(texts)), (at, len(texts))


def _laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    stops = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=stops[1:])
    return np.frombuffer(b"".join(raw), np.uint8), stops


def _first_rows(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct key: a row with its smallest id, and whether other ids have it."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort((ids, key["g"], key["h"]))
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    last = np.append(first[1:], len(order)) - 1
    return order[first], ids[order[first]] != ids[order[last]]


#: What a task calls a context.
KEY = np.dtype([("h", "<u8"), ("g", "<u8")])
#: A context, its windows, the task's smallest id.
SENT = np.dtype([("c", np.uint8, CONTEXT), ("m", "<u4"), ("i", "<i8")])
#: A window of such a context that may have equals in another range: its bytes, id, and what the task calls it.
OPEN = np.dtype([("w", np.uint8, LENGTH), ("m", "<u4"), ("i", "<i8"), ("k", KEY), ("t", "<i4")])
#: The verdict on a context under an id: windows that go.
JUDGED = np.dtype([("k", KEY), ("i", "<i8"), ("m", "<u4")])


def _rows_for(t: int, where: np.ndarray, rec: np.ndarray, name: str) -> pa.RecordBatch:
    """Records packed as one row for each place that gets some."""
    order = np.argsort(where, kind="stable")
    where, rec = where[order], rec[order]
    edge = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(where) else np.zeros(1, np.int64)
    rows = [(int(where[a]), rec[a:b].tobytes()) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([t] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["__t", name, "blob"])


def _replies(t: np.ndarray, reply: np.ndarray) -> pa.RecordBatch:
    """Answers packed as one row for each task."""
    order = np.argsort(t, kind="stable")
    t, reply = t[order], reply[order]
    edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]])) if len(t) else np.zeros(1, np.int64)
    rows = [(int(t[a]), reply[a:b].tobytes()) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["__t", "blob"])


def _gathered(batches, record: np.dtype, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, its records, their tasks' numbers) of a partition that is ordered by place."""
    now, ts, blobs = None, [], []
    for batch in batches:
        for t, at, b in zip(*[batch.column(c).to_pylist() for c in ("__t", name, "blob")], strict=True):
            if blobs and at != now:
                yield now, np.concatenate(blobs), np.concatenate(ts)
                ts, blobs = [], []
            now = at
            blobs.append(np.frombuffer(b, record))
            ts.append(np.full(len(blobs[-1]), t, np.int32))
    if blobs:
        yield now, np.concatenate(blobs), np.concatenate(ts)


def _dealt(rows: DataFrame, name: str, places: int) -> DataFrame:
    """Rows by place, several next to each other in a partition where there are many, in order."""
    parts = min(places, MAX_PARTITIONS)
    return rows.repartitionById(parts, F.floor(F.col(name).cast("long") * parts / places).cast("int")).sortWithinPartitions(name)


def candidates(documents: DataFrame, doc_id: str, text: str, buckets: int, tasks: int, keep: int) -> tuple[str, list[bytes]]:
    """Path of the candidate seeds by task, and sampled keys in order.

    One anchor in ``keep`` is in the sample, whatever its seed; equal keys of a
    task are in it once.
    """
    spark = documents.sparkSession

    def counted(batches):
        def out(t: int, parts: list[np.ndarray], sample: list[np.ndarray]):
            h, n = np.unique(np.concatenate(parts) >> U(8), return_counts=True)
            packed_ = h << U(8) | np.minimum(n, 255).astype(U)
            rows = _rows_for(t, (h % U(buckets)).astype(np.int64), packed_, "bucket")
            yield rows
            found = b"".join(sorted({r.tobytes() for s in sample for r in s}))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([SAMPLE], pa.int32()), pa.array([buckets], pa.int32()), pa.array([found], pa.binary())], rows.schema.names)

        now, parts, sample, held = None, [], [], 0
        for t, _, texts, _, _ in _by_task(batches, [doc_id, text]):
            if parts and (t != now or held > 3_000_000):
                yield from out(now, parts, sample)
                parts, sample, held = [], [], 0
            now = t
            data, stops = _laid(texts)
            at, h, row, mask = anchors(data, stops)
            parts.append(h)
            some = np.flatnonzero(_mix(h + _mix((at - stops[row]).astype(U))) % U(keep) == 0)
            sample.append(contexts(data, at[some], mask[some]))
            held += len(h)
        if parts:
            yield from out(now, parts, sample)

    def repeated(batches):
        for place, packed_, t in _gathered(batches, np.dtype(np.uint8), "bucket"):
            if place == buckets:
                rows = np.unique(packed_.view(f"V{CONTEXT}"))
                yield _replies(np.full(len(rows), SAMPLE, np.int32), rows)
                continue
            packed_, t = packed_.view(U), t[::8]
            order = np.argsort(packed_, kind="stable")
            packed_, t = packed_[order], t[order]
            h = packed_ >> U(8)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            total = np.add.reduceat((packed_ & U(255)).astype(np.int64), first)
            kept = np.repeat(total > 1, np.diff(np.append(first, len(h))))
            yield _replies(t[kept], h[kept])

    counts = documents.select("__t", doc_id, text).mapInArrow(counted, "__t int, bucket int, blob binary")
    path = packed(_dealt(counts, "bucket", buckets + 1).mapInArrow(repeated, "__t int, blob binary"), tasks, "seed-candidates")
    sample = b"".join(r[0] for r in spark.read.schema("blob binary, __t int").parquet(path).where(F.col("__t") == SAMPLE).select("blob").collect())
    return path, sorted({sample[a : a + CONTEXT] for a in range(0, len(sample), CONTEXT)})


def _anchor_slices(batches, doc_id: str, text: str, folders: list[Replies], read):
    """(task, what ``read`` made of its blobs, data, stops, part, contexts) for runs of at most 50,000 anchors.

    Contexts are bytes, masks, ids, anchor numbers and keys of the candidates.
    """
    now, of = None, None

    def found(data, at, h, row, mask, ids):
        hit = of[0].find(h)
        context = contexts(data, at[hit], mask[hit])
        return context, mask[hit], ids[row[hit]], hit, context_keys(context, mask[hit])

    for t, ids, texts, part, _ in _by_task(batches, [doc_id, text]):
        if t != now:
            now, of = t, read(*[f.blobs(t) for f in folders])
        data, stops = _laid(texts)
        at, h, row, mask = anchors(data, stops)
        pieces = [slice(a, a + 50_000) for a in range(0, max(1, len(at)), 50_000)]
        yield t, of, data, stops, part, ((at[p], found(data, at[p], h[p], row[p], mask[p], ids)) for p in pieces)


def verdicts(documents: DataFrame, doc_id: str, text: str, seeds: str, splitters: list[bytes], tasks: int) -> tuple[str, str]:
    """Paths of the verdicts by task: those of the ranges, and those across their boundaries."""
    ranges, cuts = len(splitters) + 1, np.array(splitters, f"S{CONTEXT}")

    def sent(batches):
        now, parts, held = None, [], 0

        def out(t: int):
            context, mask, ids, key = (np.concatenate(p) for p in zip(*parts, strict=True))
            pick, others = _first_rows(key, ids)
            rec = np.zeros(len(pick), SENT)
            rec["c"], rec["m"], rec["i"] = context[pick], mask[pick] | np.where(others, OTHERS, np.uint32(0)), ids[pick]
            whole = np.ascontiguousarray(rec["c"]).view(f"S{CONTEXT}").ravel()
            return _rows_for(t, np.searchsorted(cuts, whole, "right"), rec, "range")

        for t, _, _, _, _, pieces in _anchor_slices(batches, doc_id, text, [Replies(seeds)], lambda a: (_Candidates(a),)):
            if parts and t != now:
                yield out(now)
                parts, held = [], 0
            now = t
            for _, (context, masks, ids, _, key) in pieces:
                parts.append((context, masks, ids, key))
                held += len(key)
                if held > FLUSH:
                    yield out(now)
                    parts, held = [], 0
        if parts:
            yield out(now)

    def judged(batches):
        """Rows of tasks, and with a place of the second exchange those of open windows."""
        for r, rec, t in _gathered(batches, SENT, "range"):
            mask = rec["m"] & ~OTHERS
            low, high = (splitters[r - 1] if r else None), (splitters[r] if r < len(splitters) else None)
            hit, open_ = smaller_elsewhere(rec["c"], mask, rec["i"], low, high)
            told = np.flatnonzero((hit > 0) | (rec["m"] & OTHERS > 0))
            reply = np.zeros(len(told), JUDGED)
            reply["k"], reply["i"], reply["m"] = context_keys(rec["c"][told], mask[told]), rec["i"][told], hit[told]
            answers = _replies(t[told], reply)
            yield pa.RecordBatch.from_arrays([answers.column(0), pa.nulls(len(answers), pa.int32()), answers.column(1)], ["__t", "place", "blob"])
            for a in range(0, len(rec), FLUSH):
                row, offset = np.nonzero((open_[a : a + FLUSH, None] >> np.arange(REACH + 1, dtype=np.uint32)) & 1)
                row += a
                if len(row):
                    more = np.zeros(len(row), OPEN)
                    more["w"], more["m"], more["i"], more["t"] = window_of(rec["c"][row], offset), np.uint32(1) << offset.astype(np.uint32), rec["i"][row], t[row]
                    more["k"] = context_keys(rec["c"][row], mask[row])
                    where = context_keys(more["w"], np.zeros(len(row), np.uint32))["h"] % U(ranges)
                    yield _rows_for(r, where.astype(np.int64), more, "place")

    def across(batches):
        for _, rec, _ in _gathered(batches, OPEN, "place"):
            order, common = in_order(rec["w"])
            first = np.flatnonzero(common < LENGTH)
            least = np.repeat(np.minimum.reduceat(rec["i"][order], first), np.diff(np.append(first, len(order))))
            told = order[least < rec["i"][order]]
            reply = np.zeros(len(told), JUDGED)
            reply["k"], reply["i"], reply["m"] = rec["k"][told], rec["i"][told], rec["m"][told]
            yield _replies(rec["t"][told], reply)

    suffixes = documents.select("__t", doc_id, text).mapInArrow(sent, "__t int, range int, blob binary")
    found = saved(_dealt(suffixes, "range", ranges).mapInArrow(judged, "__t int, place int, blob binary"), "suffix-verdicts")
    inside = packed(found.where("place is null").select("__t", "blob"), tasks, "range-verdicts")
    beyond = _dealt(found.where("place is not null"), "place", ranges).mapInArrow(across, "__t int, blob binary")
    return inside, packed(beyond, tasks, "boundary-verdicts")


class _Verdicts:
    """Which windows of a task's contexts go."""

    def __init__(self, blobs: list[bytes]):
        rows = np.frombuffer(b"".join(blobs), JUDGED)
        rows = rows[np.lexsort((rows["i"], rows["k"]["g"], rows["k"]["h"]))]
        first = np.flatnonzero(np.concatenate([[True], rows["k"][1:] != rows["k"][:-1]])) if len(rows) else np.zeros(0, np.int64)
        self.rows = rows[first].copy()  # each context once, with the smallest id told of it
        if len(first):
            own = rows["i"] == np.repeat(self.rows["i"], np.diff(np.append(first, len(rows))))
            self.rows["m"] = np.bitwise_or.reduceat(np.where(own, rows["m"], np.uint32(0)), first)
        self.h = np.ascontiguousarray(self.rows["k"]["h"])

    def removed(self, key: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """All windows for ids above the context's smallest, for that one those judged."""
        out = np.zeros(len(key), np.uint32)
        if not len(self.rows):
            return out
        place = np.minimum(np.searchsorted(self.h, key["h"]), len(self.h) - 1)
        row = self.rows[place]
        same = row["k"] == key
        above, own = same & (ids > row["i"]), same & (ids == row["i"])
        out[above] = mask[above]
        out[own] = row["m"][own] & mask[own]
        return out


def with_cuts(documents: DataFrame, fields: list[tuple[str, T.DataType, pa.DataType]], make, doc_id: str = "doc_id", text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Append what ``make(raw, keep)`` returns of each text's bytes and the flags of the kept ones.

    Columns named as the fields or in ``drop`` are replaced or left out.
    """
    names = [n for n, _, _ in fields]
    kept = [c for c in without(documents, names).columns if c not in drop]
    # A column that is called as the tasks' numbers are waits under another name.
    safe = {c: fresh(documents, c) if c == "__t" else c for c in documents.columns}
    base = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in safe.items()]).withColumn("__t", F.spark_partition_id())
    base = saved(base, "dedup-documents")
    size, tasks = base.agg(F.sum(F.octet_length(text)), F.max("__t")).first()
    size, tasks = size or 0, (tasks or 0) + 1
    ranges = min(max(-(-size // RANGE_BYTES), base.sparkSession.sparkContext.defaultParallelism, 1), MAX_RANGES)
    # About one anchor for every fourteen bytes.
    seeds, sample = candidates(base, doc_id, text, ranges, tasks, max(1, size // 14 // max(SPLITTER_SAMPLE, 8 * ranges)))
    cuts = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    inside, beyond = verdicts(base, doc_id, text, seeds, cuts, tasks)
    schema = T.StructType([*[T.StructField(c, documents.schema[c].dataType) for c in kept], *[T.StructField(n, k) for n, k, _ in fields]])

    def cut(batches):
        folders = [Replies(seeds), Replies(inside), Replies(beyond)]
        for _, (_, judged), data, stops, part, pieces in _anchor_slices(batches, doc_id, text, folders, lambda a, b, c: (_Candidates(a), _Verdicts(b + c))):
            change = np.zeros(len(data) + 1, np.int32)
            for at, (_, masks, ids, number, key) in pieces:
                gone = judged.removed(key, ids, masks)
                some = np.flatnonzero(gone)
                which, offset = np.nonzero((gone[some, None] >> np.arange(REACH + 1, dtype=np.uint32)) & 1)
                start = at[number[some[which]]] - offset
                np.add.at(change, start, 1)
                np.add.at(change, start + LENGTH, -1)
            keep = np.cumsum(change[:-1]) == 0
            rows = [make(data[a:b], keep[a:b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
            new = [pa.array([r[i] for r in rows], k) for i, (_, _, k) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*[part.column(safe[c]) for c in kept], *new], [*kept, *names])

    return base.mapInArrow(cut, schema)


def digest(raw: np.ndarray, keep: np.ndarray) -> tuple[int, int, int, str]:
    gone = ~keep
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return len(raw), int(gone.sum()), spans, hashlib.sha256(raw[keep].tobytes()).hexdigest()


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    fields = [("n_bytes", T.LongType(), pa.int64()), ("n_removed", T.LongType(), pa.int64()), ("n_spans", T.LongType(), pa.int64()), ("kept_sha256", T.StringType(), pa.string())]
    return with_cuts(documents.select("doc_id", "text"), fields, digest, drop=("text",))


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with repeated bytes cut from their texts; columns and rows stay.

    A character that lost some of its bytes goes whole. ``n_chars``, if there
    is such a column, counts the new text.
    """

    def text_of(raw: np.ndarray, keep: np.ndarray) -> tuple[str]:
        return (raw[keep].tobytes().decode("utf-8", "ignore"),)

    kept = fresh(documents, "__kept")
    out = with_cuts(documents, [(kept, T.StringType(), pa.string())], text_of)
    new = {"text": F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(F.col(kept))}
    out = out.withColumns(new | ({"n_chars": F.length(kept).cast(documents.schema["n_chars"].dataType)} if "n_chars" in out.columns else {}))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])
