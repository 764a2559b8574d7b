"""SentencePiece encoding and decoding with weighted transducers (operator 5).

The model file is compiled into three machines over the tropical semiring:

* a normaliser, which puts a space mark before each text and maps blanks to it;
* a lexicon: a trie whose paths spell pieces, and for characters that no piece
  spells an arc into their byte pieces, or, in models without byte fallback, to the
  unknown piece, of which a run is one;
* for unigram models, arc weights are negated scores. BPE models are not additive,
  so there a grammar over neighbouring pieces has weight 0 where merging the two
  pieces' text in score order gives back exactly these two pieces, and infinity
  elsewhere. Exactly one path of finite weight is left, and it is the BPE result.

Composition with an input and its shortest path run for all distinct units of a slice at
once, position by position. Units begin at space marks, since no piece holds a mark after
another character; long ones are divided further wherever no piece holds the two
neighbouring characters, so no path can cross. Units count as equal if their characters
are. Only identity normalisers are compiled; models with a character map, with
user-defined or with unused pieces are refused.

Cases: null and empty texts give no ids; U+2581 in a text reads as a blank, as the
format has it; texts of any length are whole; extra columns pass through. The struct that
is added is the last column, ``_e`` or, where that name is taken, ``_e`` with underscores
appended.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import textkernel as tk
from parley.llm.common import free_name, row_slices, text_bytes

MARK, NONE, FAR = 0x2581, 0xFFFF, 1 << 30
UNITS, LONG_UNIT = 1 << 15, 96


def bpe_split(text: str, rank: dict[str, int]) -> list[tuple[str, str]]:
    """The merges (left, right), in order, that encode ``text``; greedy by rank, leftmost first."""
    parts, merges = list(text), []
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], FAR + 1), i))
        if parts[best] + parts[best + 1] not in rank:
            break
        merges.append((parts[best], parts[best + 1]))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return merges if len(parts) == 1 else []


class Lexicon:
    """The compiled model; plain arrays and dicts of bounded size, fit to broadcast."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only identity normalisers with a dummy prefix are compiled")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not compiled")
        self.bpe = proto.trainer_spec.model_type == 2
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.fallback = proto.trainer_spec.byte_fallback
        self.text: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int32)
        pieces: dict[str, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.text.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.text.append(p.piece.replace("▁", " ").encode() if p.type == 1 else proto.trainer_spec.unk_surface.encode() if p.type == 2 else b"")
            if p.type == 1:
                pieces[p.piece] = i
        if len(proto.pieces) >= NONE:
            raise ValueError("too many pieces")
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces with an inner space mark are not compiled")
        score = {p: proto.pieces[i].score for p, i in pieces.items()}
        self.weight = np.zeros(len(proto.pieces))
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        if self.bpe:
            # merge order: by falling score; equal scores share a rank
            order = {s: k for k, s in enumerate(sorted({score[p] for p in pieces if len(p) > 1}, reverse=True))}
            rank = {p: order[score[p]] for p in pieces if len(p) > 1}
            for p in list(rank):
                merges = bpe_split(p, rank)
                if merges:
                    self.left[pieces[p]], self.right[pieces[p]] = (pieces.get(x, -1) for x in merges[-1])
                else:
                    del pieces[p]  # its own text never encodes to it
            self.rank = {pieces[p]: r for p, r in rank.items() if p in pieces}
            # neighbours (left, right) that merge, with the rank of the result
            self.merges = {(pieces[p[:k]], pieces[p[k:]]): self.rank[i] for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces}
        else:
            for p, i in pieces.items():
                self.weight[i] = -score[p]
            self.unknown = -(min(score.values()) - 10.0)
        self._trie(pieces)
        #: Neighbouring characters that some piece holds.
        self.inner = np.unique(np.array([ord(a) << 21 | ord(b) for p in pieces for a, b in zip(p, p[1:])] or [0], np.int64))
        self.finite: dict[int, bool] = {}
        self.depth = max(map(len, pieces), default=1)
        self.cut = np.cumsum([0, *map(len, self.text)])
        self.bytes = np.frombuffer(b"".join(self.text), np.uint8)
        #: Pieces that a text's dummy prefix can have become a part of.
        self.blank_first = np.array([p.type == 1 and t.startswith(b" ") for p, t in zip(proto.pieces, self.text)])

    def _trie(self, pieces: dict[str, int]) -> None:
        """Arcs (node, character) in one open-addressed table, four probes at most wide steps."""
        nodes, arcs, ids = 1, {}, {0: NONE}
        for p, i in pieces.items():
            at = 0
            for c in p:
                key = at << 21 | ord(c)
                if key not in arcs:
                    arcs[key] = nodes
                    ids[nodes] = NONE
                    nodes += 1
                at = arcs[key]
            ids[at] = i
        keys = np.array(sorted(arcs), np.int64)
        self.arc_keys, self.arc_to = keys, np.array([arcs[k] for k in keys.tolist()], np.int32)
        self.piece_at = np.array([ids[n] for n in range(nodes)], np.uint16)
        bits = max(10, int(np.ceil(np.log2(4 * len(keys)))))
        self.slot_key, self.slot_to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.mask, left = (1 << bits) - 1, np.arange(len(keys))
        probe = self._slot(keys)
        while len(left):
            free = self.slot_key[probe[left]] < 0
            self.slot_key[probe[left[free]]] = keys[left[free]]
            done = self.slot_key[probe[left]] == keys[left]
            self.slot_to[probe[left[done]]] = self.arc_to[left[done]]
            left = left[~done]
            probe[left] = (probe[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (tk.mix(keys.astype(tk.U)) & tk.U(self.mask)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Follow one character from each node; -1 where there is no arc."""
        key = node.astype(np.int64) << 21 | char
        at, to = self._slot(key), np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        while len(left):
            got = self.slot_key[at[left]]
            hit = got == key[left]
            to[left[hit]] = self.slot_to[at[left[hit]]]
            left = left[~hit & (got >= 0)]
            at[left] = (at[left] + 1) & self.mask
        return to

    def stable(self, a: int, b: int) -> bool:
        """Whether the merged text of two pieces encodes to just these: no symbols that
        stand on both sides of the border while the pieces grow may merge first."""
        if a == NONE or b == NONE:
            return True
        x, x_until = a, FAR
        spine_b = []
        y, until = b, FAR
        while y >= 0:
            spine_b.append((y, self.rank.get(y, -1), until))
            until = self.rank.get(y, -1)
            y = self.left.get(y, -1)
        while x >= 0:
            x_from = self.rank.get(x, -1)
            for y, y_from, y_until in spine_b:
                r = self.merges.get((x, y))
                # equal ranks: the merge further left is first
                if r is not None and r < x_until and r <= y_until and max(x_from, y_from) <= min(x_until, y_until):
                    return False
            x_until, x = x_from, self.right.get(x, -1)
        return True


def _finite(lex: Lexicon, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Grammar weights of neighbouring pieces; answers are kept with the model they are for."""
    keys, inverse = np.unique(a.astype(np.int64) << 16 | b, return_inverse=True)
    out = np.empty(len(keys), bool)
    for i, k in enumerate(keys.tolist()):
        got = lex.finite.get(k)
        if got is None:
            got = lex.finite[k] = lex.stable(k >> 16, k & 0xFFFF)
        out[i] = got
    if len(lex.finite) > 400_000:
        lex.finite.clear()
    return out[inverse]


def shortest_paths(lex: Lexicon, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces (NONE for a character without one) and first characters on the best path
    of each unit; units are given one after the other in ``chars``."""
    n = len(chars)
    local = np.arange(n) - np.repeat(start, size)
    unit_end = np.repeat(start + size, size)
    arcs = np.full((lex.depth, n), NONE, np.uint16)
    at, node = np.arange(n), np.zeros(n, np.int32)
    for d in range(lex.depth):
        node = lex.step(node, chars[at + d])
        ok = node >= 0
        at, node = at[ok], node[ok]
        arcs[d, at] = lex.piece_at[node]
        ok = at + d + 1 < unit_end[at]
        at, node = at[ok], node[ok]
    bare = arcs[0] == NONE
    last = np.full(n, NONE, np.uint16)  # the piece that ends with each character
    length = np.zeros(n, np.int32)
    cost = np.full(n, np.inf)
    by_local = np.argsort(local, kind="stable")
    cuts = np.searchsorted(local[by_local], np.arange(int(size.max()) + 1))
    for j in range(int(size.max())):
        ends = by_local[cuts[j] : cuts[j + 1]]
        for d in range(min(lex.depth, j + 1) - 1, -1, -1):
            e = ends if not lex.bpe else ends[length[ends] == 0]
            s = e - d
            tok = arcs[d, s]
            ok = (tok != NONE) | (bare[s] if d == 0 else False)
            e, s, tok = e[ok], s[ok], tok[ok]
            if not len(e):
                continue
            first = s == e - j
            if lex.bpe:
                ok = first.copy()
                ok[~first] = _finite(lex, last[s[~first] - 1], tok[~first]) & (length[s[~first] - 1] > 0)
                last[e[ok]], length[e[ok]] = tok[ok], d + 1
            else:
                w = np.where(first, 0.0, cost[np.maximum(s - 1, 0)]) + np.where(tok == NONE, lex.unknown, lex.weight[np.where(tok == NONE, 0, tok)])
                ok = w < cost[e]
                cost[e[ok]], last[e[ok]], length[e[ok]] = w[ok], tok[ok], d + 1
    # walk back from the ends of all units together
    keep = np.zeros(n, bool)
    at, head = start + size - 1, start
    while len(at):
        keep[at] = True
        at = at - length[at]
        ok = at >= head
        at, head = at[ok], head[ok]
    e = np.flatnonzero(keep)
    return last[e], e - length[e] + 1


def _units(lex: Lexicon, marked: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First characters and lengths of the units of texts that start at ``begin``."""
    is_mark = marked == MARK
    head = is_mark.copy()
    head[1:] &= ~is_mark[:-1]
    head[begin] = True
    unit = np.flatnonzero(head)
    width = np.diff(np.append(unit, len(marked)))
    long = np.flatnonzero(width > LONG_UNIT)
    if not len(long):
        return unit, width
    at = np.repeat(unit[long] + 1 - (np.cumsum(width[long] - 1) - (width[long] - 1)), width[long] - 1) + np.arange(int((width[long] - 1).sum()))
    key = marked[at - 1] << 21 | marked[at]
    near = np.minimum(np.searchsorted(lex.inner, key), len(lex.inner) - 1)
    head[at[lex.inner[near] != key]] = True
    unit = np.flatnonzero(head)
    return unit, np.diff(np.append(unit, len(marked)))


def _distinct_units(marked: np.ndarray, unit: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One unit of each kind, and each unit's kind. Hashes nominate, characters decide."""
    raw = marked.astype("<u4").view(np.uint8)
    keys = tk.span_hash(raw, unit * 4, (unit + width) * 4)
    _, rep, inverse = np.unique(keys, return_index=True, return_inverse=True)
    first = rep[inverse]
    place = np.arange(len(marked)) - np.repeat(unit, width)
    other = np.repeat(unit[first], width) + place
    differs = marked[np.minimum(other, len(marked) - 1)] != marked
    bad = (width != width[first]) | (np.logical_or.reduceat(differs, unit) if len(unit) else np.zeros(0, bool))
    if bad.any():  # units that only share a hash become kinds of their own
        alone = np.flatnonzero(bad)
        inverse = inverse.copy()
        inverse[alone] = len(rep) + np.arange(len(alone))
        rep = np.concatenate([rep, alone])
    return rep, inverse


def encode_batch(lex: Lexicon, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the rows of one slice, and offsets by row."""
    n = len(offs) - 1
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    chars = np.where(chars == 0x20, MARK, chars)
    full = np.flatnonzero(np.diff(lead) > 0)
    size = np.diff(lead)[full] + 1  # with the dummy prefix
    begin = np.cumsum(size) - size
    marked = np.full(int(size.sum()), MARK, np.int64)
    is_text = np.ones(len(marked), bool)
    is_text[begin] = False
    marked[is_text] = chars
    unit, width = _units(lex, marked, begin)
    rep, inverse = _distinct_units(marked, unit, width)
    order = np.argsort(width[rep], kind="stable")  # long units run apart from short ones
    ids_parts, count = [], np.zeros(len(rep), np.int64)
    for a in range(0, len(order), UNITS):
        pick = order[a : a + UNITS]
        w, u = width[rep[pick]], unit[rep[pick]]
        s = np.cumsum(w) - w
        flat = np.repeat(u - s, w) + np.arange(w.sum())
        piece, at = shortest_paths(lex, marked[flat], s, w)
        owner = np.searchsorted(s, at, "right") - 1
        if (piece == NONE).any():
            piece, owner = _bytes_for(lex, piece, marked[flat][at], owner)
        count[pick] = np.bincount(owner, minlength=len(pick))
        ids_parts.append(piece.astype(np.int32))
    ids = np.concatenate(ids_parts) if ids_parts else np.zeros(0, np.int32)
    at = np.zeros(len(rep), np.int64)
    at[order] = np.cumsum(count[order]) - count[order]
    each = count[inverse]
    out = ids[np.repeat(at[inverse] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
    per_row = np.zeros(n, np.int64)
    per_row[full] = np.add.reduceat(each, np.searchsorted(unit, begin)) if len(full) else 0
    cut = np.concatenate([[0], np.cumsum(per_row)])
    if not lex.fallback and len(out):  # a run of unknown characters is one unknown piece, across units too
        again = np.zeros(len(out), bool)
        again[1:] = (out[1:] == lex.unk) & (out[:-1] == lex.unk)
        again[cut[:-1][per_row > 0]] = False
        out, cut = out[~again], cut - np.concatenate([[0], np.cumsum(again)])[cut]
    return out, cut


def _bytes_for(lex: Lexicon, piece: np.ndarray, char: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters without a piece by their byte pieces, or by the unknown piece."""
    bare = piece == NONE
    if not lex.fallback:
        return np.where(bare, lex.unk, piece.astype(np.int32)), owner
    raw = [chr(c).encode() for c in char[bare].tolist()]
    n = np.ones(len(piece), np.int64)
    n[bare] = [len(r) for r in raw]
    out = np.repeat(piece.astype(np.int32), n)
    out[np.repeat(bare, n)] = lex.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return out, np.repeat(owner, n)


def decode_batch(lex: Lexicon, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of rows of ids, without the dummy prefix; the unknown piece reads as the model says."""
    size = (lex.cut[1:] - lex.cut[:-1])[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    out = lex.bytes[np.repeat(lex.cut[ids] - total[:-1], size) + np.arange(total[-1])]
    cuts = total[offs]
    keep = np.ones(len(out), bool)
    some = np.flatnonzero(offs[1:] > offs[:-1])
    first = ids[offs[:-1][some]]
    led = some[lex.blank_first[first]]
    keep[cuts[:-1][led]] = False  # the prefix is one blank
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[cuts]


def load(path: str) -> bytes:
    """The model file, read on the driver (the compiled form is broadcast, about 10 MB)."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def compiled(model: bytes) -> Lexicon:
    """The machines of a model file; compiling takes seconds, so a few stay."""
    return Lexicon(model)


def encode(docs: DataFrame, model: bytes, decode: bool = False) -> DataFrame:
    """``docs`` plus a last struct with ``ids`` and, if asked for, ``decoded`` (the text that the ids spell)."""
    lex = docs.sparkSession.sparkContext.broadcast(compiled(model))
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decode else [])])

    def run(text: pa.Array) -> pa.Array:
        data, offs = text_bytes(text)
        id_parts, off_parts, text_parts, at = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [], 0
        for a, b in row_slices(offs):
            ids, cut = encode_batch(lex.value, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            id_parts.append(ids)
            off_parts.append(cut[1:] + at)
            at += int(cut[-1])
            if decode:
                raw, cuts = decode_batch(lex.value, ids, cut)
                text_parts.append(pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.string()))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(off_parts).astype(np.int32)), pa.array(np.concatenate(id_parts)))
        if not decode:
            return pa.StructArray.from_arrays([lists], names=["ids"])
        return pa.StructArray.from_arrays([lists, pa.concat_arrays(text_parts) if text_parts else pa.array([], pa.string())], names=["ids", "decoded"])

    return docs.withColumn(free_name(docs.columns, "_e"), F.arrow_udf(run, kind)(F.col("text")))
