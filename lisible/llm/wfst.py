"""Piece encoding and decoding as shortest paths through a weighted transducer.

``compile_model`` reads a piece model file and compiles three transducers:
the normaliser (white space to its mark, a mark in front), the pieces (one
path of characters to a piece id, read off a prefix tree) and the byte fallback
(a character that no piece covers to its UTF-8 bytes). ``Machine.encode``
composes them with the input on the fly and takes the shortest path in the
tropical semiring: weights add along a path, the smallest sum wins.

Weights follow the model's type. In a unigram model a piece weighs its negated
score. A merge (BPE) model has no additive scores; its encoding is the one
sequence in which every piece, and every pair of neighbours, is what merging
gives for the piece's, and the pair's, own characters. So a state of the
transducer remembers the last piece, an arc weighs zero where the pair
survives merging and infinity (the semiring's zero, no arc) where it does not;
exactly one path through the lattice has finite weight.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field
from itertools import chain

#: Mark that stands for a blank.
MARK = "▁"
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    def varint(i):
        value = shift = 0
        while True:
            c = data[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value, i
    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i:i + size], i + size
        else:
            size = 8 if kind == 1 else 4
            value, i = data[i:i + size], i + size
        yield key >> 3, value


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], int, dict]:
    """Pieces (text, score, kind), model type and normaliser settings of a piece model file."""
    import struct
    pieces, model_type, normaliser = [], UNIGRAM, {}
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif number == 2:
            model_type = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            normaliser = dict(_fields(value))
    return pieces, model_type, normaliser


@dataclass
class Machine:
    """The compiled transducers; see the module's text."""

    pieces: list[tuple[str, float, int]]
    model_type: int
    add_mark: bool = True
    #: Bytes of compositions kept between inputs (segments, in two generations) and piece pairs kept, so memory is bounded.
    cache_bytes: int = 32 << 20
    cache_pairs: int = 150_000
    ids: dict[str, int] = field(init=False)
    surface: list[bytes] = field(init=False)

    def __post_init__(self):
        usable = {NORMAL, USER}
        self.ids = {text: i for i, (text, _, kind) in enumerate(self.pieces) if kind in usable}
        self.scores = [score for _, score, _ in self.pieces]
        self.byte_ids = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), None)
        byte_of = {i: b for b, i in self.byte_ids.items()}
        self.surface = [bytes([byte_of[i]]) if i in byte_of else b"" if kind in (CONTROL, UNKNOWN, UNUSED)
                        else text.replace(MARK, " ").encode() for i, (text, _, kind) in enumerate(self.pieces)]
        prefixes = {text[:k] for text in self.ids for k in range(1, len(text) + 1)}
        self._segment = self._cuts()
        if self.model_type == MERGES:  # pieces that merging never gives have no arc
            self.arc_pieces = {text for text in self.ids if self.merged(text) == [text]}
        else:
            self.arc_pieces = set(self.ids)
        #: the prefix tree with its arcs: whether a prefix is a piece itself
        self.tree = {prefix: prefix in self.arc_pieces for prefix in prefixes}
        self.penalty = min(self.scores, default=0.0) - 10.0
        self._segments: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[str, dict[str, bool]] = {}
        self._n_pairs = self._held = 0

    def _cuts(self) -> re.Pattern | None:
        """Pattern of the segments: places between characters that no piece holds side by side, read off the pieces.

        Cuts are made before a mark that follows another character, and before
        ASCII punctuation that follows a character which no piece has in front
        of it. Every path through the lattice has a state there.
        """
        before: dict[str, set[str]] = {}
        for text in self.ids:
            for a, b in zip(text, text[1:]):
                before.setdefault(b, set()).add(a)
        if before.get(MARK, set()) - {MARK}:
            return None
        marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
        joined = {a for p in marks for a in before.get(p, ()) if a not in marks and a != MARK}
        inner = "".join(map(re.escape, marks))
        held = f"(?:(?<=[{''.join(map(re.escape, sorted(joined)))}])[{inner}]+[^{MARK}{inner}]*)*" if joined else ""
        return re.compile(f"{MARK}*(?:[{inner}]+[^{MARK}{inner}]*|[^{MARK}{inner}]+){held}|{MARK}+")

    # normaliser

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return (MARK if self.add_mark else "") + text.replace(" ", MARK)

    def segments(self, normal: str) -> list[str]:
        """The input cut where every path through the lattice must pass."""
        if self._segment is None:
            return [normal] if normal else []
        return self._segment.findall(normal)

    # byte fallback

    def fallback(self, char: str) -> tuple[int, ...]:
        try:
            return tuple(self.byte_ids[b] for b in char.encode())
        except KeyError:
            return (self.unknown,)

    # pieces

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the highest-scored piece first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best[0]):
                    best = (self.scores[piece], i)
            if best is None:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def allowed(self, left: str, right: str) -> bool:
        """Whether the arc over ``right`` from a state that remembers ``left`` has finite weight.

        A character outside the pieces never merges, so it stands between any neighbours.
        """
        known = self._pairs.get(left)
        if known is None:
            known = self._pairs[left] = {}
        fits = known.get(right)
        if fits is None:
            fits = left not in self.ids or right not in self.ids or self.merged(left + right) == [left, right]
            self._n_pairs += 1
            if self._n_pairs > self.cache_pairs:
                self._pairs, self._n_pairs = {}, 0
            known[right] = fits
        return fits

    def arcs(self, text: str, at: int) -> list[str]:
        """Pieces that begin at a place of the text, longest first; a character without any piece stands for itself."""
        found, holds = [], self.tree.get
        for stop in range(at + 1, len(text) + 1):
            piece = text[at:stop]
            is_arc = holds(piece)
            if is_arc is None:
                break
            if is_arc:
                found.append(piece)
        if text[at] not in self.ids:
            found.append(text[at])
        found.reverse()
        return found

    def shortest_path(self, text: str) -> tuple[int, ...]:
        """Output of the shortest path of one segment composed with the pieces and the byte fallback."""
        path = self._merge_path(text) if self.model_type == MERGES else self._unigram_path(text)
        out: list[int] = []
        for piece in path:
            i = self.ids.get(piece)
            out.extend(self.fallback(piece) if i is None else (i,))
        return tuple(out)

    def _merge_path(self, text: str) -> list[str]:
        """Every finite arc weighs zero, so the first complete path of a depth-first search is a shortest one.

        A state is (place, last piece); states from which the end cannot be
        reached are remembered, so each is left at most once.
        """
        n, dead = len(text), set()
        path, stack = [], [iter(self.arcs(text, 0))]
        at = 0
        while at < n:
            last = path[-1] if path else ""
            for piece in stack[-1]:
                state = (at + len(piece), piece)
                if state in dead or last and not self.allowed(last, piece):
                    continue
                path.append(piece)
                at += len(piece)
                stack.append(iter(self.arcs(text, at)) if at < n else iter(()))
                break
            else:
                if not path:
                    raise ValueError(f"no path for {text!r}")
                dead.add((at, path[-1]))
                at -= len(path.pop())
                stack.pop()
        return path

    def _unigram_path(self, text: str) -> list[str]:
        """Dijkstra's search over places, weights shifted by the best score so that none is negative."""
        n = len(text)
        top = max(self.scores, default=0.0)
        weight = lambda p: (len(p) * (top + 1.0)) - (self.scores[self.ids[p]] if p in self.ids else self.penalty)
        best, back = {0: 0.0}, {}
        heap, done = [(0.0, 0)], set()
        while heap:
            cost, at = heapq.heappop(heap)
            if at in done:
                continue
            done.add(at)
            if at == n:
                break
            for piece in self.arcs(text, at):
                to, total = at + len(piece), cost + weight(piece)
                if total < best.get(to, float("inf")):
                    best[to], back[to] = total, piece
                    heapq.heappush(heap, (total, to))
        path, at = [], n
        while at:
            path.append(back[at])
            at -= len(back[at])
        return path[::-1]

    # whole texts

    def encode(self, text: str | None) -> list[int]:
        segments = self.segments(self.normalise(text or ""))
        found = list(map(self._segments.get, segments))
        if None in found:
            found = [self._composed(s) if ids is None else ids for s, ids in zip(segments, found)]
        return list(chain.from_iterable(found))

    def _composed(self, segment: str) -> tuple[int, ...]:
        """The segment's output, from the older generation of the cache or a new composition."""
        ids = self._segments.get(segment) or self._older.get(segment) or self.shortest_path(segment)
        if len(segment) <= 64 and segment not in self._segments:
            # a dictionary entry, a string and a tuple take about so much besides their contents
            self._held += 200 + 2 * len(segment) + 8 * len(ids)
            if 2 * self._held > self.cache_bytes:
                self._segments, self._older, self._held = {}, self._segments, 0
            self._segments[segment] = ids
        return ids

    def decode(self, ids) -> str:
        """The text of a sequence of ids: the pieces' output, bytes joined, without the mark in front."""
        data = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return data[1:] if self.add_mark and data.startswith(" ") else data


def compile_model(data: bytes) -> Machine:
    """Compile a piece model file. Character maps in the normaliser are refused; the identity map is supported."""
    pieces, model_type, normaliser = read_model(data)
    if normaliser.get(2):
        raise ValueError("the model's normaliser has a character map; only the identity map is supported")
    if model_type not in (UNIGRAM, MERGES):
        raise ValueError(f"model type {model_type} is neither unigram nor merges")
    if normaliser.get(4, 1):
        raise ValueError("models that drop extra white space are not supported")
    return Machine(pieces, model_type, add_mark=bool(normaliser.get(3, 1)))
