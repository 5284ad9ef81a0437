"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of the pieces.

The vocabulary is read once on the driver from a model file (path given by the caller; nothing is
trained) and travels to the tasks as arrays whose size is that of the vocabulary. A model that keeps
merge ranks instead of log-probabilities gets the log-probability ``log(1 / (rank + 1))`` less the
logarithm of the harmonic sum (Zipf's law), rank 0 being its best piece.

Blanks become the marker U+2581 and a text gets one marker in front. No piece has a marker after
another character, so the best path passes every place where a marker follows one, and a text is
the sequence of its chunks (markers, then other characters). A batch is encoded once per distinct
chunk: the trie is walked from all character starts of all chunks at once, then the Viterbi table
is filled position by position over all chunks. Where no piece is exactly the next character, that
character may also be passed at the worst score less 10 and becomes its bytes' pieces. Equal
scores keep the path found first, the one whose last piece is longest.

Defined results: null stays null, an empty text has no ids; a literal U+2581 is a blank, so such a
text decodes with a blank in its place; every other text decodes to itself. In decoding, ids
outside the vocabulary and the unknown piece read `` U+2047 ``, control pieces read nothing and
bytes that are not UTF-8 become U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.textops import _BASE, _BYTE, _INVERSE, powers, ranges, row_sums, slices

MARK = "▁"
BLANK = 0x20
UNKNOWN_PENALTY = 10.0
ROWS = 250
ENCODE_BYTES = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[bytes, ...]  # what each id decodes to, markers as blanks
    scores: np.ndarray  # log-probabilities
    normal: np.ndarray  # ids that texts are cut into
    byte_ids: np.ndarray  # id of each byte's piece
    unknown: int
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @property
    def cuts_at_blanks(self) -> bool:
        return not any(b" " in self.pieces[i].lstrip(b" ") for i in self.normal)


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trie as (base, check, value): byte c leads from node s to base[s] + c if check there is s."""
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for key, value in zip(keys, values, strict=True):
        node = 0
        for byte in key:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
            node = children[node][byte]
        ends[node] = value
    size = 2 * len(children) + 1024
    base, check, value = (np.full(size, fill, np.int32) for fill in (0, -1, -1))
    free = bytearray(b"\x01") * size
    free[0] = 0
    place, low = {0: 0}, 1
    queue = [0]
    for node in queue:
        at = place[node]
        value[at] = ends.get(node, -1)
        edges = sorted(children[node])
        if not edges:
            continue
        low = free.index(1, low)
        slot = max(low, edges[0] + 1)
        while True:
            slot = free.find(1, slot)
            if slot < 0 or slot + 256 >= size:
                grow = size
                base, check, value = (
                    np.append(a, np.full(grow, f, np.int32)) for a, f in ((base, 0), (check, -1), (value, -1))
                )
                free += bytearray(b"\x01") * grow
                size += grow
                slot = max(slot, low)
                continue
            first = slot - edges[0]
            if first > 0 and all(free[first + e] for e in edges):
                break
            slot += 1
        base[at] = first
        for e in edges:
            child = children[node][e]
            free[first + e] = 0
            check[first + e] = at
            place[child] = first + e
            queue.append(child)
    return base, check, value


def load(path: str) -> Vocabulary:
    """Read a SentencePiece model file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(count)]
    stored = np.array([model.get_score(i) for i in range(count)])
    byte_ids = np.full(256, -1, np.int64)
    pieces, normal = [], []
    for i, name in enumerate(names):
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            pieces.append(bytes([int(name[3:5], 16)]))
        elif model.is_unknown(i):
            pieces.append(" ⁇ ".encode())
        elif model.is_control(i) or model.is_unused(i):
            pieces.append(b"")
        else:
            normal.append(i)
            pieces.append(name.replace(MARK, " ").encode())
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    ids = np.array(normal)
    scores = stored.copy()
    if (stored[ids] == np.round(stored[ids])).all():  # ranks, not log-probabilities
        order = ids[np.argsort(-stored[ids], kind="stable")]
        scores[order] = -np.log(np.arange(1, len(order) + 1)) - np.log((1 / np.arange(1, len(order) + 1)).sum())
    trie = double_array([pieces[i] for i in normal], normal)
    return Vocabulary(tuple(pieces), scores, ids, byte_ids, model.unk_id(), *trie)


class Codec:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.unknown_score = vocabulary.scores[vocabulary.normal].min() - UNKNOWN_PENALTY
        self.lengths = np.array([len(p) for p in vocabulary.pieces], np.int64)
        self.table = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.split = vocabulary.cuts_at_blanks

    def _edges(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of every piece found; id -1 passes a character that is no piece."""
        v = self.v
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        widths = np.diff(np.append(begins, len(data)))
        whole = np.zeros(len(begins), bool)
        at, node, number = begins, np.zeros(len(begins), np.int32), np.arange(len(begins))
        found, depth = [], 0
        while len(at):
            inside = at + depth < ends[at]
            at, node, number = at[inside], node[inside], number[inside]
            target = v.base[node] + data[at + depth]
            known = v.check[target] == node
            at, node, number = at[known], target[known], number[known]
            depth += 1
            ids = v.value[node]
            hit = ids >= 0
            found.append((at[hit], np.full(int(hit.sum()), depth, np.int64), ids[hit].astype(np.int64)))
            whole[number[hit & (widths[number] == depth)]] = True
        lone = ~whole
        found.append((begins[lone], widths[lone], np.full(int(lone.sum()), -1, np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _viterbi(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, number of ids of each chunk)."""
        chunks = len(starts)
        owner = np.repeat(np.arange(chunks), sizes)
        edge, length, piece = self._edges(data, np.repeat(starts + sizes, sizes))
        node = edge + owner[edge]  # a chunk of n bytes has n + 1 nodes
        score = np.where(piece >= 0, self.v.scores[piece], self.unknown_score)
        depth = edge - starts[owner[edge]]
        order = np.argsort(depth, kind="stable")
        node, length, piece, score = node[order], length[order], piece[order], score[order]
        borders = np.append(0, np.cumsum(np.bincount(depth)))
        best = np.full(len(data) + chunks, -np.inf)
        back = np.zeros(len(best), np.int64)
        taken = np.zeros(len(best), np.int64)
        first = starts + np.arange(chunks)
        best[first] = 0
        for low, high in zip(borders[:-1], borders[1:], strict=True):
            if low == high:
                continue
            total = best[node[low:high]] + score[low:high]
            target = node[low:high] + length[low:high]
            better = total > best[target]
            target = target[better]
            best[target] = total[better]
            back[target] = length[low:high][better]
            taken[target] = piece[low:high][better]
        steps, live, at = [], np.arange(chunks), first + sizes
        counts = np.zeros(chunks, np.int64)
        while len(live):
            step, ids = back[at], taken[at]
            steps.append((live, ids, step, at - live))  # the last is the end byte of the piece
            counts[live] += np.where(ids >= 0, 1, step)
            at = at - step
            more = at > first[live]
            live, at = live[more], at[more]
        out = np.zeros(int(counts.sum()), np.int64)
        fill = np.cumsum(counts)
        for live, ids, step, end in steps:
            one = ids >= 0
            fill[live[one]] -= 1
            out[fill[live[one]]] = ids[one]
            for back_by in range(1, 5):
                some = ~one & (step >= back_by)
                fill[live[some]] -= 1
                out[fill[live[some]]] = self.v.byte_ids[data[end[some] - back_by]]
        return out, counts

    def encode(self, column: pa.Array) -> pa.Array:
        """List column of ids."""
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")
        parts, sizes = [], []
        for _, _, data, offsets in slices(column, ENCODE_BYTES):
            filled = np.flatnonzero(np.diff(offsets) > 0)
            data = np.insert(data, offsets[filled], BLANK)
            offsets = offsets + np.append(0, np.cumsum(np.diff(offsets) > 0))
            if not len(filled):
                sizes.append(np.zeros(len(offsets) - 1, np.int64))
                continue
            begins = np.zeros(len(data), bool)
            if self.split:
                blank = data == BLANK
                begins[1:] = blank[1:] & ~blank[:-1]
            begins[offsets[:-1][filled]] = True
            starts = np.flatnonzero(begins)
            lengths = np.diff(np.append(starts, len(data)))
            hashes = np.add.reduceat(_BYTE[data] * powers(_BASE, len(data)), starts) * powers(_INVERSE, len(data))[starts]
            _, place, which = np.unique(hashes + lengths.astype(np.uint64), return_index=True, return_inverse=True)
            own = lengths[place]
            ids, counts = self._viterbi(data[ranges(starts[place], own)], np.cumsum(own) - own, own)
            used = counts[which]
            parts.append(ids[ranges((np.cumsum(counts) - counts)[which], used)])
            sizes.append(row_sums(used, np.searchsorted(starts, offsets)))
        first = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        edges = pa.array(first, pa.int32(), mask=np.append(np.asarray(column.is_null()), False))
        return pa.ListArray.from_arrays(edges, pa.array(flat, pa.int32()))

    def decode(self, column: pa.Array) -> pa.Array:
        """Text column of a list column of ids."""
        ids = np.asarray(column.flatten().fill_null(-1)).astype(np.int64)
        sizes = np.asarray(pc.list_value_length(column).fill_null(0)).astype(np.int64)
        ids = np.where((ids < 0) | (ids >= len(self.lengths)), self.v.unknown, ids)
        data = self.table[ranges(self.offsets[ids], self.lengths[ids])]
        rows = np.append(0, np.cumsum(sizes))
        ends = np.append(0, np.cumsum(self.lengths[ids]))
        first, last = ends[rows[:-1]], ends[rows[1:]]
        marked = np.zeros(len(sizes), bool)
        filled = np.flatnonzero(last > first)
        marked[filled] = (data[first[filled]] == BLANK) & (ids[rows[:-1][filled]] != self.v.unknown)
        keep = np.ones(len(data), bool)
        keep[first[marked]] = False
        edges = np.append(0, np.cumsum(last - first - marked)).astype(np.int64)
        data = data[keep]
        binary = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(sizes), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data.tobytes())]
        )
        try:
            texts = binary.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([b.decode("utf-8", "replace") for b in binary.to_pylist()], pa.string())
        return pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))


def _apply(
    df: DataFrame, keep: dict[str, Column], source: str, vocabulary: Vocabulary, ids: bool, text: bool
) -> DataFrame:
    kept = df.select(*[c.alias(n) for n, c in keep.items()], F.col(source).alias("__in"))
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    names, more = list(keep), [n for n, wanted in (("ids", ids), ("text", text)) if wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                out = [part.column(len(names))]
                if ids:
                    out.append(codec.encode(out[-1]))
                if text:
                    out.append(codec.decode(out[-1]))
                yield pa.record_batch([*part.columns[: len(names)], *out[1:]], [*names, *more])

    kinds = {"ids": "array<int>", "text": "string"}
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    return kept.mapInArrow(run, ", ".join([*schema, *[f"{n} {kinds[n]}" for n in more]]))


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` columns plus ids, the best segmentation of the whole text."""
    return _apply(docs, keep, text, vocabulary, True, False)


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep: dict[str, Column], ids: str = "ids") -> DataFrame:
    """``keep`` columns plus text."""
    return _apply(encoded, keep, ids, vocabulary, False, True)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` columns plus ids and text, the ids decoded again, in one pass."""
    return _apply(docs, keep, text, vocabulary, True, True)
