"""Regular expressions compiled to one minimised automaton over bytes.

Each rule becomes a nondeterministic automaton, then by subset construction a machine that
searches: it keeps the leftmost attempt that is still alive, and after a match it begins
anew at the byte behind it.  The machines of all rules run side by side as one product
automaton, which is minimised; its transitions are one array.  A single pass over the bytes
finds where matches of all rules end; a reversed automaton of the rule then finds where a
match began.

The rule language is that of bytes patterns in ``re``: literals, classes, groups,
alternatives, and greedy repeats.  A match takes the longest form.  A rule whose match could
end, go on without being one, and fail is refused, because its end would not be known in one
pass; so is a rule whose later attempt could succeed while an earlier one is open.
"""

import re
from collections import deque
from re import _constants as kinds, _parser as patterns

import numpy as np


def _nfa(pattern: str, flags=0):
    """(edges, empty, start, accept): edges[state] = [(set of bytes, next)], empty[state] = [next]."""
    edges, empty = [], []

    def state():
        edges.append([])
        empty.append([])
        return len(edges) - 1

    def either_case(codes):
        if tree.state.flags & re.IGNORECASE:
            return {ord(f(chr(c))) for c in codes for f in (str.lower, str.upper) if c < 128} | {c for c in codes if c > 127}
        return set(codes)

    def klass(items):
        codes, negate = set(), False
        for kind, value in items:
            if kind is kinds.NEGATE:
                negate = True
            elif kind is kinds.LITERAL:
                codes.add(value)
            elif kind is kinds.RANGE:
                codes.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"class item {kind} is not supported")
        codes = either_case(codes)
        return set(range(256)) - codes if negate else codes

    def build(items, begin):
        for kind, value in items:
            if kind in (kinds.LITERAL, kinds.NOT_LITERAL, kinds.IN, kinds.ANY):
                codes = (either_case({value}) if kind is kinds.LITERAL else set(range(256)) - either_case({value})
                         if kind is kinds.NOT_LITERAL else klass(value) if kind is kinds.IN else set(range(256)) - {10})
                end = state()
                edges[begin].append((frozenset(codes), end))
            elif kind is kinds.SUBPATTERN:
                end = build(value[3], begin)
            elif kind is kinds.BRANCH:
                end = state()
                for part in value[1]:
                    empty[build(part, begin)].append(end)
            elif kind is kinds.MAX_REPEAT:
                least, most, part = value
                end = begin
                for _ in range(least):
                    end = build(part, end)
                if most == kinds.MAXREPEAT:
                    loop = state()
                    empty[end].append(loop)
                    empty[build(part, loop)].append(loop)
                    end = loop
                else:
                    out = state()
                    for _ in range(most - least):
                        empty[end].append(out)
                        end = build(part, end)
                    empty[end].append(out)
                    end = out
            else:
                raise ValueError(f"{kind} is not supported")
            begin = end
        return begin

    tree = patterns.parse(pattern.encode(), flags)
    first = state()
    return edges, empty, first, build(tree, first)


def _closure(states, empty):
    found, todo = set(states), list(states)
    while todo:
        for x in empty[todo.pop()]:
            if x not in found:
                found.add(x)
                todo.append(x)
    return frozenset(found)


def _step(states, code, edges, empty):
    return _closure({to for s in states for codes, to in edges[s] if code in codes}, empty)


def byte_classes(nfas):
    """Class of each byte: bytes that no rule tells apart share one; and one byte of each class."""
    sets = {codes for edges, *_ in nfas for out in edges for codes, _ in out}
    seen, classes, members = {}, np.zeros(256, np.uint8), []
    for code in range(256):
        key = tuple(code in s for s in sets)
        if key not in seen:
            seen[key] = len(members)
            members.append(code)
        classes[code] = seen[key]
    return classes, members


def _search_machine(nfa, members):
    """Subset construction of the searching machine: (next[state][class], open[state]).

    A state is (attempts, matched): the live attempts, earliest first, each a set of states
    of the rule; once the first is a match, only that one is kept.  ``ended`` marks states
    whose last byte ended a match before it.
    """
    edges, empty, start, accept = nfa
    begin = _closure({start}, empty)

    def advance(attempts, code):
        seen, moved = set(), []
        for states in attempts:
            to = _step(states, code, edges, empty) - seen
            if to:
                seen |= to
                moved.append(frozenset(to))
        return moved

    def follow(node, code):
        attempts, matched, _ = node
        ended = False
        if matched:
            moved = advance(attempts, code)
            if moved:
                if accept not in moved[0]:
                    raise ValueError("a match of this rule may go on without being one")
                return (tuple(moved), True, False)
            attempts, ended = (), True
        moved = advance([*attempts, begin], code)
        hits = [i for i, states in enumerate(moved) if accept in states]
        if hits and hits[0] > 0:
            raise ValueError("a later attempt of this rule may succeed while an earlier one is open")
        return (tuple(moved[:1]), True, ended) if hits else (tuple(moved), False, ended)

    return _explore(((), False, False), follow, members)


def _explore(first, follow, members):
    number, table, todo = {first: 0}, [], deque([first])
    while todo:
        node, row = todo.popleft(), []
        for code in members:
            to = follow(node, code)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
    return np.array(table, np.int64), list(number)


def minimised(table, output):
    """Merge states of equal output whose transitions lead to merged states (partition refinement)."""
    _, block = np.unique(output, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer
    _, chosen = np.unique(block, return_index=True)
    order = np.argsort(chosen)  # state 0 stays first
    renumber = np.empty(len(order), np.int64)
    renumber[order] = np.arange(len(order))
    return renumber[block[table[chosen[order]]]], output[chosen[order]], renumber[block[0]]


def _reversed_machine(nfa, members):
    """The rule read backwards: (next[state][class], is match); state 0 is dead, 1 begins."""
    edges, empty, start, accept = nfa
    back_edges, back_empty = [[] for _ in edges], [[] for _ in edges]
    for s, out in enumerate(edges):
        for codes, to in out:
            back_edges[to].append((codes, s))
        for to in empty[s]:
            back_empty[to].append(s)
    dead = frozenset()
    table, nodes = _explore(_closure({accept}, back_empty), lambda node, code: _step(node, code, back_edges, back_empty), members)
    hit = np.array([start in node for node in nodes])
    least, out, first = minimised(table, hit.astype(np.int64) + 2 * np.array([node == dead for node in nodes]))
    return least, out, first


class Scanner:
    """Finds the leftmost, longest, non-overlapping matches of each rule in one pass."""

    def __init__(self, rules: dict[str, tuple[str, int]]):
        """``rules``: name -> (pattern, flags)."""
        self.names = list(rules)
        nfas = [_nfa(*rules[name]) for name in self.names]
        self.classes, members = byte_classes(nfas)
        machines = []
        for name, nfa in zip(self.names, nfas):
            try:
                table, nodes = _search_machine(nfa, members)
            except ValueError as error:
                raise ValueError(f"rule {name}: {error}") from None
            output = np.array([matched + 2 * ended for _, matched, ended in nodes])
            machines.append(minimised(table, output))
        first = tuple(int(m[2]) for m in machines)
        table, nodes = _explore(first, lambda node, k: tuple(int(m[0][s, k]) for m, s in zip(machines, node)), range(len(members)))
        output = np.array([sum(int(m[1][s]) << (2 * i) for i, (m, s) in enumerate(zip(machines, node))) for node in nodes])
        table, output, first = minimised(table, output)
        ended = np.array([any(o >> (2 * i) & 2 for i in range(len(machines))) for o in map(int, output)])
        order = np.argsort(ended, kind="stable")  # states that end a match come last
        renumber = np.empty(len(order), np.int64)
        renumber[order] = np.arange(len(order))
        width = 1 << max(1, (len(members) - 1).bit_length())
        rows = np.zeros((len(order), width), np.int64)
        rows[:, :len(members)] = renumber[table[order]] * width
        #: rows of ``width`` entries; an entry is the place at which the next state's row begins.
        self.transitions = rows.ravel().tolist()
        self.first = int(renumber[first]) * width
        self.marked = int((~ended).sum()) * width
        self.width, self.output = width, [int(output[i]) for i in order]
        self.reversed = [_reversed_machine(nfa, members) for nfa in nfas]
        self.reversed = [(t.tolist(), o.tolist(), int(s)) for t, o, s in self.reversed]
        self._translate = bytes(self.classes.tolist())
        self.n_states = len(self.output)

    def _begin(self, rule, coded, end, least):
        """The leftmost place from which a match reaches ``end``, not before ``least``."""
        table, output, state = self.reversed[rule]
        found, at = None, end
        while at > least:
            at -= 1
            state = table[state][coded[at]]
            if output[state] & 2:
                break
            if output[state] & 1:
                found = at
        return found

    def scan(self, data: bytes):
        """[(rule name, start, end)] in bytes, by end."""
        coded = data.translate(self._translate)
        transitions, marked, state = self.transitions, self.marked, self.first
        ends, at = [], 0
        for code in coded:
            state = transitions[state + code]
            if state >= marked:
                ends.append((at, state))
            at += 1
        found, last = [], [0] * len(self.names)
        ends = [(end, i) for end, s in ends for i in range(len(last)) if self.output[s // self.width] >> (2 * i) & 2]
        ends += [(len(data), i) for i in range(len(last)) if self.output[state // self.width] >> (2 * i) & 1]
        for end, i in ends:
            start = self._begin(i, coded, end, last[i])
            found.append((self.names[i], start, end))
            last[i] = end
        return found
