"""Aho-Corasick matching of many terms in one pass over Arrow strings.

The automaton is a table of next states by state and byte class, built once a
process, level by level. All texts of a batch are scanned together: they are cut
into pieces, each begins as many bytes early as the longest term needs, and one
step moves every piece on by a byte. So a long text takes no longer than many
short ones with as many bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a piece of text.
PIECE = 512


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Automaton:
    """Finds all occurrences of terms, overlapping ones too. Terms are distinct and
    not empty."""

    def __init__(self, terms: list[str]) -> None:
        coded = [t.encode() for t in terms]
        if len(set(coded)) < len(coded) or not all(coded):
            raise ValueError("terms must be distinct and not empty")
        self.sizes = np.array([len(c) for c in coded], np.int64)
        self.longest = int(self.sizes.max(initial=1))
        used = sorted(set().union(*coded)) if coded else []
        self.classes = np.zeros(256, np.int32)  # class 0: bytes of no term
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        levels: list[list[tuple[int, int, int]]] = []  # by depth: parent, class, node
        ends = {}
        for nth, term in enumerate(coded):
            node = 0
            for depth, byte in enumerate(term):
                c = int(self.classes[byte])
                below = children[node].get(c)
                if below is None:
                    below = children[node][c] = len(children)
                    children.append({})
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((node, c, below))
                node = below
            ends[node] = nth
        n = len(children)
        self.term = np.full(n, -1, np.int32)  # term that ends in a state
        self.term[list(ends)] = list(ends.values())
        self.shorter = np.zeros(n, np.int32)  # next state with a shorter term that ends there, 0: none
        self.next = np.zeros((n, width), np.int32)
        fall = np.zeros(n, np.int32)  # the longest shorter state that ends alike
        for depth, level in enumerate([[(0, 0, 0)], *levels]):
            _, _, node = np.array(level, np.int64).T
            if depth:
                self.next[node] = self.next[fall[node]]
                self.shorter[node] = np.where(self.term[fall[node]] >= 0, fall[node], self.shorter[fall[node]])
            if depth < len(levels):
                parent, c, below = np.array(levels[depth], np.int64).T
                fall[below] = self.next[fall[parent], c] if depth else 0
                self.next[parent, c] = below
        self.found = (self.term >= 0) | (self.shorter > 0)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and first byte (in data) of each occurrence."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        own = offsets[text] + nth * PIECE  # first byte whose matches the piece reports
        start = np.maximum(own - (self.longest - 1), offsets[text])
        end = np.minimum(own + PIECE, offsets[text + 1])
        order = np.argsort(start - end, kind="stable")  # longest first
        text, own, start, end = text[order], own[order], start[order], end[order]
        coded = self.classes[data]
        left = len(start)
        state = np.zeros(left, np.int32)
        hits = []
        for step in range(int((end - start).max(initial=0))):
            left = np.searchsorted(start[:left] - end[:left], -step, side="left")  # pieces with a byte more
            at = start[:left] + step
            state[:left] = self.next[state[:left], coded[at]]
            hit = np.flatnonzero(self.found[state[:left]] & (at >= own[:left]))
            if len(hit):
                hits.append(np.stack([text[hit], at[hit], state[hit]]))
        where, last, state = np.concatenate([np.zeros((3, 0), np.int64), *hits], axis=1)
        found = []
        while len(state):
            term = self.term[state]
            real = term >= 0
            found.append(np.stack([where[real], term[real], last[real] + 1 - self.sizes[term[real]]]))
            state = self.shorter[state]
            where, last, state = where[state > 0], last[state > 0], state[state > 0]
        out = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
        return out[0], out[1], out[2]
