"""Rule regexes compiled into one deterministic automaton over bytes.

Subset construction makes the automaton, partition refinement minimises it,
and transition arrays run it. Patterns use ASCII literals, classes, groups,
alternatives and counted repeats; ``(?i:...)`` takes either case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser as P

import numpy as np


@dataclass(frozen=True)
class Rule:
    """One kind of span.

    ``full`` is the pattern whose leftmost, longest, non-overlapping matches
    count. ``probe`` is a pattern whose matches start where those of ``full``
    do and end within them: the combined pass looks for it, so that a rule such
    as a long run of digits says something once per match and not per byte.
    No start of ``probe`` may lie before another one and end after it.
    ``accept`` judges a match; one that fails is dropped but still consumes.
    """

    kind: str
    full: str
    probe: str = ""
    accept: Callable[[str], bool] | None = None


class _Nfa:
    """Thompson's construction; with reverse=True, of the mirrored language."""

    def __init__(self, reverse: bool = False) -> None:
        self.free: list[list[int]] = []
        self.on: list[list[tuple[frozenset[int], int]]] = []
        self.reverse = reverse

    def state(self) -> int:
        self.free.append([])
        self.on.append([])
        return len(self.free) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        start = self.state()
        return start, self._sequence(P.parse(pattern), start, 0)

    def _sequence(self, items, at: int, flags: int) -> int:
        for op, arg in reversed(list(items)) if self.reverse else items:
            at = self._item(op, arg, at, flags)
        return at

    def _item(self, op, arg, at: int, flags: int) -> int:
        if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
            to = self.state()
            self.on[at].append((_bytes(op, arg, flags), to))
            return to
        if op is C.SUBPATTERN:
            _, add, drop, inner = arg
            return self._sequence(inner, at, (flags | add) & ~drop)
        if op is C.BRANCH:
            to = self.state()
            for choice in arg[1]:
                start = self.state()
                self.free[at].append(start)
                self.free[self._sequence(choice, start, flags)].append(to)
            return to
        if op is C.MAX_REPEAT:
            least, most, inner = arg
            for _ in range(least):
                at = self._sequence(inner, at, flags)
            if most is C.MAXREPEAT:
                loop, to = self.state(), self.state()
                self.free[at] += [loop, to]
                self.free[self._sequence(inner, loop, flags)] += [loop, to]
                return to
            to = self.state()
            for _ in range(most - least):
                self.free[at].append(to)
                start = self.state()
                self.free[at].append(start)
                at = self._sequence(inner, start, flags)
            self.free[at].append(to)
            return to
        raise ValueError(f"a rule can't use {op}")

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _bytes(op, arg, flags: int) -> frozenset[int]:
    if op is C.ANY:
        return frozenset(range(256)) - {10}
    if op in (C.LITERAL, C.NOT_LITERAL):
        found = {arg}
    else:
        found = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                found.add(x)
            elif kind is C.RANGE:
                found.update(range(x[0], x[1] + 1))
            elif kind is not C.NEGATE:
                raise ValueError(f"a rule's class can't use {kind}")
    if flags & re.IGNORECASE:
        found |= {ord(y) for x in found for y in (chr(x).lower(), chr(x).upper())}
    if max(found) > 127:
        raise ValueError("rules are ASCII")
    if op is C.NOT_LITERAL or op is C.IN and arg[0][0] is C.NEGATE:
        return frozenset(range(256)) - found
    return frozenset(found)


class Dfa:
    """Minimal automaton of some patterns, as arrays.

    ``classes`` maps a byte to its class, ``step[state + class]`` gives the
    next state; states are multiples of ``width``. ``said[state]`` lists the
    patterns that end there; states from ``ends`` on say something. State
    ``dead``, if there is one, is never left. With search=True a match may
    start anywhere.
    """

    def __init__(self, patterns: Sequence[str], search: bool = False, reverse: bool = False) -> None:
        nfa = _Nfa(reverse)
        parts = [nfa.add(p) for p in patterns]
        finals = {end: k for k, (_, end) in enumerate(parts)}
        start = nfa.closure([s for s, _ in parts])
        alike: dict[tuple[bool, ...], list[int]] = {}
        sets = sorted({b for on in nfa.on for b, _ in on}, key=sorted)
        for b in range(256):
            alike.setdefault(tuple(b in s for s in sets), []).append(b)
        self.width = len(alike)
        kind = bytearray(256)
        for k, group in enumerate(alike.values()):
            for b in group:
                kind[b] = k
        self.classes = bytes(kind)
        number, order, rows = {start: 0}, [start], []
        for now in order:
            row = []
            for group in alike.values():
                to = nfa.closure([t for s in now for b, t in nfa.on[s] if group[0] in b])
                to = to | start if search else to
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
        says = [tuple(sorted(finals[s] for s in now if s in finals)) for now in order]
        self._arrays(np.array(rows), says)

    def _arrays(self, rows: np.ndarray, says: list[tuple[int, ...]]) -> None:
        kinds = {s: k for k, s in enumerate(sorted(set(says)))}
        block = np.array([kinds[s] for s in says])
        while True:  # states stay together while their steps lead to the same blocks
            _, after = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
            after = after.ravel()
            if after.max() == block.max():
                break
            block = after
        first = [int(np.flatnonzero(block == k)[0]) for k in range(block.max() + 1)]
        order = sorted(range(len(first)), key=lambda k: (bool(says[first[k]]), first[k]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        table = place[block[rows[[first[k] for k in order]]]]
        self.states = len(order)
        self.step: list[int] = (table * self.width).ravel().tolist()
        self.start = int(place[block[0]]) * self.width
        self.said = {i * self.width: says[first[k]] for i, k in enumerate(order) if says[first[k]]}
        self.ends = min(self.said, default=self.states * self.width)
        stuck = [i for i in range(len(order)) if (table[i] == i).all() and i * self.width not in self.said]
        self.dead = stuck[0] * self.width if stuck else -1


class Scanner:
    """All rules in one pass over the bytes."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.all = Dfa([r.probe or r.full for r in rules], search=True)
        self.back = [Dfa([r.probe or r.full], reverse=True) for r in rules]
        self.fore = [Dfa([r.full]) for r in rules]

    @staticmethod
    def _furthest(dfa: Dfa, data: bytes, at: int, end: int, by: int) -> int:
        """The last position, going by so many bytes from at to end, where the automaton says yes; -1 if none."""
        state, found, classes, step = dfa.start, -1, dfa.classes, dfa.step
        while at != end:
            state = step[state + classes[data[at if by > 0 else at - 1]]]
            at += by
            if state == dfa.dead:
                break
            if state >= dfa.ends:
                found = at
        return found

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then by rule."""
        data = text.encode()
        step, ends, said = self.all.step, self.all.ends, self.all.said
        over = [0] * len(self.rules)
        found: list[tuple[int, int, int]] = []
        state = self.all.start
        for at, kind in enumerate(data.translate(self.all.classes), 1):
            state = step[state + kind]
            if state >= ends:
                for k in said[state]:
                    if at <= over[k] or (start := self._furthest(self.back[k], data, at, over[k], -1)) < 0:
                        continue
                    end = over[k] = self._furthest(self.fore[k], data, start, len(data), 1)
                    accept = self.rules[k].accept
                    if accept is None or accept(data[start:end].decode()):
                        found.append((start, k, end))
        if not found:
            return []
        place = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # code points up to and with each byte
        place = np.r_[0, place].tolist()
        return [(self.rules[k].kind, place[a], place[b]) for a, k, b in sorted(found)]


@lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)
