"""Re-Pair grammar compression of a shard of token ids, in numpy.

A round counts the adjacent pairs of the sequence (never across the end of a document), gives the
most frequent ones a nonterminal each, and replaces their occurrences from left to right; rounds
repeat on the shortened sequence until no pair is frequent, or a round shortens it by less than one
part in GAIN. So repeats of any length fold up, by halves, and text without them takes few rounds.
Pairs of one round are replaced together, so a shard takes a few passes of sorting instead of one for
each rule. Every rule stores the length
of its expansion, so the token at any place of a document is found by a running sum over the
document's part of the sequence and a descent into one rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Nonterminals are numbered from here, or from the number of ids where there are more.
FIRST_RULE = 1 << 16
GAIN = 4096
RULES_A_ROUND = 4096
LEAST_COUNT = 8


@dataclass
class Grammar:
    """symbols: the compressed sequence; ends: where each document ends in it; rule k is first_rule + k."""

    symbols: np.ndarray
    ends: np.ndarray
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    first_rule: int = FIRST_RULE

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a stretch of the sequence; each pass unfolds all nonterminals that are left."""
        out = symbols
        while len(at := np.flatnonzero(out >= self.first_rule)):
            width = np.ones(len(out), np.int64)
            width[at] = 2
            start = np.cumsum(width) - width
            made = np.empty(int(start[-1] + width[-1]), out.dtype)
            made[start] = out
            rule = out[at] - self.first_rule
            made[start[at]] = self.left[rule]
            made[start[at] + 1] = self.right[rule]
            out = made
        return out

    def widths(self, symbols: np.ndarray) -> np.ndarray:
        w = np.ones(len(symbols), np.int64)
        at = np.flatnonzero(symbols >= self.first_rule)
        w[at] = self.lengths[symbols[at] - self.first_rule]
        return w

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]])

    def token(self, k: int, i: int) -> int:
        """The i-th id of document k, without unfolding the rest."""
        part = self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]]
        upto = np.cumsum(self.widths(part))
        at = int(np.searchsorted(upto, i, side="right"))
        i -= int(upto[at - 1]) if at else 0
        symbol = int(part[at])
        while symbol >= self.first_rule:
            first = int(self.left[symbol - self.first_rule])
            size = int(self.lengths[first - self.first_rule]) if first >= self.first_rule else 1
            symbol, i = (first, i) if i < size else (int(self.right[symbol - self.first_rule]), i - size)
        return symbol


SLOT_BITS = 20


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOT_BITS)


def _bar(counts: np.ndarray, least: int, wanted: int) -> int:
    """The least count that leaves no more than about `wanted` slots, and not below `least`."""
    many = counts[counts >= least]
    return least if len(many) <= wanted else max(least, int(np.partition(many, len(many) - wanted)[len(many) - wanted]))


def compress(ids: np.ndarray, ends: np.ndarray, rules_a_round: int = RULES_A_ROUND, least: int = LEAST_COUNT, first_rule: int = FIRST_RULE, gain: int = GAIN) -> Grammar:
    """ids below first_rule; ends: the running sum of the documents' lengths, none of which is 0."""
    if len(ids) and int(ids.max()) >= first_rule:
        raise ValueError(f"id {int(ids.max())} is not below the first rule, {first_rule}")
    seq = ids.astype(np.uint32)
    ends = ends.astype(np.int64)
    lefts, rights, lengths = [], [], np.empty(0, np.int64)
    while len(seq) > 1:
        slot = _slots(seq[:-1], seq[1:])
        slot[ends[:-1] - 1] = 1 << SLOT_BITS  # pairs across documents share a slot that is not counted
        counts = np.bincount(slot, minlength=(1 << SLOT_BITS) + 1)
        counts[-1] = 0
        # pairs of a slot are counted together first, those of the fullest slots apart
        at = np.flatnonzero((counts >= _bar(counts, least, rules_a_round))[slot])
        pairs = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        values, many = np.unique(pairs, return_counts=True)
        enough = np.flatnonzero(many >= least)
        if not len(enough):
            break
        if len(enough) > rules_a_round:
            enough = np.sort(enough[np.lexsort((values[enough], -many[enough]))[:rules_a_round]])
        chosen = values[enough]
        left, right = (chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32)
        # a slot holds one chosen pair; others of the slot wait for a later round
        holder = np.full((1 << SLOT_BITS) + 1, -1, np.int32)
        holder[_slots(left, right)] = np.arange(len(chosen), dtype=np.int32)
        rule = holder[slot[at]]
        same = (rule >= 0) & (chosen[rule] == pairs)
        hit, rule = at[same], rule[same]
        # of hits that overlap, take every second one from the left
        fresh = np.diff(hit, prepend=-2) > 1
        order = np.arange(len(hit))
        alone = (order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0
        hit, rule = hit[alone], rule[alone]
        used = np.flatnonzero(np.bincount(rule, minlength=len(chosen)))
        number = np.empty(len(chosen), np.uint32)
        number[used] = np.arange(len(used), dtype=np.uint32) + np.uint32(first_rule + len(lengths))
        left, right = left[used], right[used]
        size = np.concatenate([np.ones(first_rule, np.int64), lengths])
        lefts.append(left)
        rights.append(right)
        lengths = np.concatenate([lengths, size[left] + size[right]])
        seq[hit] = number[rule]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        before, seq = len(seq), seq[keep]
        ends = ends - np.searchsorted(hit, ends - 1)
        if len(hit) * gain < before:
            break
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.uint32)
    return Grammar(seq, ends, join(lefts), join(rights), lengths, first_rule)
