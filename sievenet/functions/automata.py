"""Patterns whose loops are ambiguous, rewritten without ambiguity.

A backtracking engine repeats a group by recursion unless the loop is possessive, and a possessive loop is
right only where the text decides what to do next.  So the pattern becomes a deterministic automaton: its states are the
ordered threads of the pattern, and a thread that has matched ends all threads that come after it.  The match from a start is
then the longest text the automaton accepts.  Read back as a pattern, each loop is "from this state to its next visit", which
the text alone decides; loops over accepting states run as long as one more accepting state can be reached.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import pairwise

Ranges = list[tuple[int, int]]

MAX_THREADS = 4_000
MAX_STATES = 400
MAX_TEXT = 60_000
MAX_SYMBOLS = 40
_MATCH = -1
_END = -1  # the symbol for the end of the text
_WORDS = [(48, 57), (65, 90), (95, 95), (97, 122)]


class TooLarge(ValueError):
    """The automaton, or the pattern read back from it, is larger than is of use."""


def _holds(ranges: Ranges, code: int) -> bool:
    return any(a <= code <= b for a, b in ranges)


class _Threads:
    """The pattern as instructions: ("set", ranges, next), ("split", first, second), ("match",).

    Trees are ("set", ranges), ("cat", trees), ("alt", trees), ("rep", tree, least, most, greedy).
    """

    def __init__(self, tree: tuple):
        self.code: list[tuple] = [("match",)]
        self.start = self.add(tree, 0)

    def put(self, *instruction) -> int:
        self.code.append(instruction)
        if len(self.code) > MAX_THREADS:
            raise TooLarge("too many instructions")
        return len(self.code) - 1

    def split(self, greedy: bool, body: int, out: int) -> int:
        return self.put("split", body, out) if greedy else self.put("split", out, body)

    def add(self, tree: tuple, out: int) -> int:
        """Instructions for the tree, going on at out; where they start."""
        kind = tree[0]
        if kind == "set":
            return self.put("set", tree[1], out)
        if kind == "cat":
            for part in reversed(tree[1]):
                out = self.add(part, out)
            return out
        if kind == "alt":
            starts = [self.add(part, out) for part in tree[1]]
            at = starts[-1]
            for start in reversed(starts[:-1]):
                at = self.put("split", start, at)
            return at
        _, body, least, most, greedy = tree
        if most is None:
            if least:
                at = self.plus(body, out, greedy)
                for _ in range(least - 1):
                    at = self.add(body, at)
                return at
            if nullable(body):  # a loop that may go round without reading: once or more, or not at all
                return self.split(greedy, self.plus(body, out, greedy), out)
            loop = self.put("split", 0, 0)
            start = self.add(body, loop)
            self.code[loop] = ("split", start, out) if greedy else ("split", out, start)
            return loop
        at = out
        for _ in range(most - least):
            at = self.split(greedy, self.add(body, at), out)
        for _ in range(least):
            at = self.add(body, at)
        return at

    def plus(self, body: tuple, out: int, greedy: bool) -> int:
        loop = self.put("split", 0, 0)
        start = self.add(body, loop)
        self.code[loop] = ("split", start, out) if greedy else ("split", out, start)
        return start

    def closure(self, threads: Iterable[int]) -> tuple[int, ...]:
        """Threads that read or match, in order of priority."""
        seen, out = set(), []
        for thread in threads:
            stack = [thread]
            while stack:
                at = stack.pop()
                if at in seen:
                    continue
                seen.add(at)
                op = self.code[at]
                if op[0] == "split":
                    stack += [op[2], op[1]]
                else:
                    out.append(_MATCH if op[0] == "match" else at)
        return tuple(out)


def nullable(tree: tuple) -> bool:
    kind = tree[0]
    if kind == "set":
        return False
    if kind == "cat":
        return all(map(nullable, tree[1]))
    if kind == "alt":
        return any(map(nullable, tree[1]))
    return tree[2] == 0 or nullable(tree[1])


class Automaton:
    """edges[state][symbol]: the states entered; accepting states; ahead[state]: the symbols that may follow, None for any.

    A pattern that ends in an assertion matches only if a certain symbol follows, so
    a state that may match is two: one for symbols that make it match, one for the others.
    end: "" or one of "z", "b", "B".
    """

    def __init__(self, tree: tuple, end: str):
        self.threads = _Threads(tree)
        sets = [op[1] for op in self.threads.code if op[0] == "set"]
        edges = sorted({0, 0x110000} | {x for s in [*sets, _WORDS] for a, b in s for x in (a, b + 1)})
        groups: dict[tuple, Ranges] = {}
        for a, b in pairwise(edges):
            groups.setdefault((tuple(_holds(s, a) for s in sets), _holds(_WORDS, a) if end in ("b", "B") else None), []).append((a, b - 1))
        self.symbols = list(groups.values())
        self.is_word = [_holds(_WORDS, s[0][0]) for s in self.symbols]
        self.end = end
        self.accepting: list[bool] = []
        self.ahead: list[frozenset[int] | None] = []
        self.known: dict[tuple, int] = {}
        self.entries: dict[tuple, list[int]] = {}
        begin = self.threads.closure([self.threads.start])
        self.starts = self.enter(begin, False)
        # where an empty match is tested against a word's end, the character before counts
        self.starts_in_word = self.enter(begin, True)
        self.build()

    def enter(self, threads: tuple[int, ...], word: bool | None) -> list[int]:
        """The states for these threads after a character that is a word character or not."""
        word = word if self.end in ("b", "B") else None
        if (threads, word) in self.entries:
            return self.entries[threads, word]
        if _MATCH not in threads:
            made = [self.state(threads, False, None)] if threads else []
        else:
            at = threads.index(_MATCH)
            before, rest = threads[:at], tuple(t for t in threads if t != _MATCH)
            every = [*range(len(self.symbols)), _END]
            if not self.end:
                made = [self.state(before, True, None)]
            else:
                if self.end == "z":
                    follows = {_END}
                else:
                    follows = {s for s in every if ((s != _END and self.is_word[s]) != bool(word)) == (self.end == "b")}
                made = [self.state(before, True, frozenset(follows))]
                if rest:
                    made.append(self.state(rest, False, frozenset(every) - follows))
        self.entries[threads, word] = made
        return made

    def state(self, threads: tuple[int, ...], accepting: bool, ahead: frozenset[int] | None) -> int:
        key = (threads, accepting, ahead)
        if key not in self.known:
            if len(self.known) >= MAX_STATES:
                raise TooLarge("too many states")
            self.known[key] = len(self.known)
            self.accepting.append(accepting)
            self.ahead.append(ahead)
        return self.known[key]

    def build(self) -> None:
        """From each state, for each symbol, the states entered; several differ in what must follow."""
        self.edges: list[dict[int, list[int]]] = []
        while len(self.edges) < len(self.known):
            state = len(self.edges)
            threads, _, ahead = list(self.known)[state]
            found = {}
            for symbol in range(len(self.symbols)):
                if ahead is not None and symbol not in ahead:
                    continue
                code = self.symbols[symbol][0][0]
                after = [op[2] for op in (self.threads.code[t] for t in threads) if _holds(op[1], code)]
                if after:
                    entered = self.enter(self.threads.closure(after), self.is_word[symbol])
                    if entered:
                        found[symbol] = entered
            self.edges.append(found)
        self.trim()

    def trim(self) -> None:
        """Equal states become one; moves to states that never accept go."""
        n = len(self.edges)
        live = set(s for s in range(n) if self.accepting[s])
        while True:
            more = {s for s in range(n) if s not in live and any(t in live for ts in self.edges[s].values() for t in ts)}
            if not more:
                break
            live |= more
        self.edges = [{c: [t for t in ts if t in live] for c, ts in e.items() if any(t in live for t in ts)} for e in self.edges]
        block = {s: (self.accepting[s], self.ahead[s]) for s in live}
        count = 0
        while len(set(block.values())) != count:
            count = len(set(block.values()))
            marks = {s: (block[s], tuple(sorted((c, tuple(sorted(hash(block[t]) for t in ts))) for c, ts in self.edges[s].items()))) for s in live}
            order = {m: i for i, m in enumerate(dict.fromkeys(marks[s] for s in sorted(live)))}
            block = {s: order[marks[s]] for s in live}
        first = {}
        for s in sorted(live):
            first.setdefault(block[s], s)
        same = {s: first[block[s]] for s in live}
        self.starts = list(dict.fromkeys(same[s] for s in self.starts if s in live))
        self.starts_in_word = list(dict.fromkeys(same[s] for s in self.starts_in_word if s in live))
        self.states = sorted(set(same.values()))
        self.edges = [{c: list(dict.fromkeys(same[t] for t in ts)) for c, ts in e.items()} for e in self.edges]

    def leading_class(self) -> Ranges:
        """Characters after which no match needs to begin: one that begins there could begin at that character as well."""
        if len(self.starts) != 1 or self.end or self.accepting[self.starts[0]]:
            return []
        start = self.starts[0]
        out: Ranges = []
        for symbol, (after, *_) in self.edges[start].items():
            if self.covers(after, start):
                out += self.symbols[symbol]
        return out

    def covers(self, one: int, two: int) -> bool:
        """Whether, on every text, one accepts by the time two does."""
        seen, todo = {(one, two)}, [(one, two)]
        while todo:
            a, b = todo.pop()
            if a is not None and self.accepting[a]:
                continue
            if self.accepting[b]:
                return False
            for symbol, (to, *_) in self.edges[b].items():
                pair = ((self.edges[a].get(symbol) or [None])[0] if a is not None else None, to)
                if pair not in seen:
                    seen.add(pair)
                    todo.append(pair)
        return True


def _alternatives(parts: list[str]) -> str:
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


class _Reader:
    """The automaton as a pattern."""

    def __init__(self, automaton: Automaton, klass: Callable[[Ranges], str]):
        self.a, self.klass = automaton, klass
        self.paths: dict[int, dict[int, str]] = {}
        for s in automaton.states:
            to: dict[int, Ranges] = {}
            for symbol, targets in automaton.edges[s].items():
                for t in targets:
                    to.setdefault(t, []).extend(automaton.symbols[symbol])
            self.paths[s] = {t: klass(sorted(r)) + self.check(t) for t, r in to.items()}

    def check(self, state: int) -> str:
        ahead = self.a.ahead[state]
        if ahead is None:
            return ""
        codes = sorted(r for s in ahead if s != _END for r in self.a.symbols[s])
        parts = ([self.klass(codes)] if codes else []) + (["\\z"] if _END in ahead else [])
        return "(?=" + "|".join(parts) + ")"

    @staticmethod
    def loop(body: str | None) -> str:
        if body is None:
            return ""
        single = body.startswith("[") and body.count("[") == 1 and body.endswith("]")
        return (body if single else f"(?:{body})") + "*+"

    def without(self, paths: dict[int, dict[int, str]], gone: Iterable[int]) -> dict[int, dict[int, str]]:
        """Paths among the other states, with what leads through the states that go."""
        paths = {s: dict(to) for s, to in paths.items()}
        left = set(gone)
        while left:
            into = lambda r: sum(1 for s, to in paths.items() if s != r and r in to)
            r = min(left, key=lambda r: (into(r) * len(paths[r]), r))
            left.discard(r)
            own = paths.pop(r)
            again = self.loop(own.pop(r, None))
            for to in paths.values():
                lead = to.pop(r, None)
                if lead is not None:
                    for target, rest in own.items():
                        through = lead + again + rest
                        to[target] = _alternatives([to[target], through]) if target in to else through
                        if len(to[target]) > MAX_TEXT:
                            raise TooLarge("the pattern grows too long")
        return paths

    def walk(self, paths: dict[int, dict[int, str]], state: int) -> str:
        """On from state, as far as states of paths can be reached."""
        others = [s for s in paths if s != state]
        again = self.loop(self.without(paths, others)[state].get(state))
        rest = {s: {t: p for t, p in to.items() if t != state} for s, to in paths.items() if s != state}
        onward = [p + self.walk(rest, t) for t, p in paths[state].items() if t != state]
        text = again + (f"(?:{_alternatives(onward)})?+" if onward else "")
        if len(text) > MAX_TEXT:
            raise TooLarge("the pattern grows too long")
        return text

    def pattern(self) -> str:
        accepting = [s for s in self.a.states if self.a.accepting[s]]
        begin = -2
        outside, inside = set(self.a.starts), set(self.a.starts_in_word)
        before = {s: "" if s in outside and s in inside else f"(?<!{self.klass(_WORDS)})" if s in outside else f"(?<={self.klass(_WORDS)})" for s in [*self.a.starts, *self.a.starts_in_word]}
        paths = {**self.paths, begin: {s: look + self.check(s) for s, look in before.items()}}
        paths = self.without(paths, [s for s in self.a.states if not self.a.accepting[s]])
        first = paths.pop(begin)
        parts = [lead + self.walk({s: paths[s] for s in accepting}, s) for s, lead in first.items()]
        return _alternatives(parts) if parts else "(?!)"


def swallowed(tree: tuple) -> tuple[Ranges, list[tuple[Ranges, Ranges]]]:
    """Characters, and pairs of them, that may stand before every match: with them it is a match as well.

    Lengths don't matter here, so it holds whatever assertion ends the pattern.
    """
    threads = _Threads(tree)
    sets = [op[1] for op in threads.code if op[0] == "set"]
    cuts = sorted({0, 0x110000} | {x for s in sets for a, b in s for x in (a, b + 1)})
    symbols: dict[tuple, Ranges] = {}
    for a, b in pairwise(cuts):
        symbols.setdefault(tuple(_holds(s, a) for s in sets), []).append((a, b - 1))
    codes = {held: ranges[0][0] for held, ranges in symbols.items() if any(held)}

    def step(state: frozenset, code: int) -> frozenset:
        ops = (threads.code[at] for at in state if at != _MATCH)
        return frozenset(threads.closure(op[2] for op in ops if _holds(op[1], code)))

    def includes(large: frozenset, small: frozenset) -> bool:
        seen, todo = {(large, small)}, [(large, small)]
        while todo:
            a, b = todo.pop()
            if not a or (_MATCH in b and _MATCH not in a) or len(seen) > MAX_STATES:
                return False
            for code in codes.values():
                if (to := step(b, code)) and (pair := (step(a, code), to)) not in seen:
                    seen.add(pair)
                    todo.append(pair)
        return True

    start = frozenset(threads.closure([threads.start]))
    if _MATCH in start or len(codes) > MAX_SYMBOLS:
        return [], []
    ones = {held for held, code in codes.items() if includes(step(start, code), start)}
    pairs = []
    for held, last in codes.items():
        firsts = [] if held in ones else [h for h, code in codes.items() if includes(step(step(start, code), last), start)]
        if firsts:
            pairs.append((sorted(r for h in firsts for r in symbols[h]), symbols[held]))
    return sorted(r for held in ones for r in symbols[held]), pairs


def unambiguous(tree: tuple, end: str, klass: Callable[[Ranges], str]) -> tuple[str, str]:
    """A pattern for Java with the same matches as the tree, and the class after which none begins (or "").

    end: the assertion that ends the pattern: "", "z", "b" or "B".
    """
    automaton = Automaton(tree, end)
    lead = automaton.leading_class()
    return f"(?>{_Reader(automaton, klass).pattern()})", klass(lead) if lead else ""
