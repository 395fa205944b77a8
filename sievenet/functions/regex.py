"""RE2-syntax patterns for Spark's Java regex functions.

Scan patterns are written in RE2 syntax.  Spark evaluates Java syntax, which
reads several constructs differently (``\\s``, ``$``, ``.``, ``\\b``, ``(?i)``,
POSIX classes, ``[`` inside a class) and accepts others RE2 refuses.  Patterns
are few and live on the driver, so each is rewritten once, before the plan is
built, into a flag-free Java pattern in which every class is spelled out.

The same pass finds the literals every match must contain, which scans use as
byte-level ``contains`` guards in front of the regex.  It also guards a leading
``[class]+`` against being retried at each character of a long run: RE2 is
linear there, a backtracking engine is quadratic.

Java repeats a group by recursion, which overflows the stack on long lines.  So
alternatives of one character become a class, and an unbounded loop over a
larger group becomes possessive, which is no recursion.  That keeps all
matches if one repeat's text never begins another's and what follows can't begin
a repeat, or if nothing follows.  Patterns with other such loops, and with loops over
what may be empty, are rewritten by :mod:`sievenet.functions.automata`.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

from sievenet.functions.automata import TooLarge, swallowed, unambiguous

MAX_REPEAT = 1000
_MAX_CODE = sys.maxunicode

# The Perl and POSIX classes of RE2 (all ASCII).
_PERL = {
    "d": "09",
    "s": "\t\n\f\r  ",
    "w": "09AZ__az",
}
_POSIX = {
    "alnum": "09AZaz",
    "alpha": "AZaz",
    "ascii": "\x00\x7f",
    "blank": "\t\t  ",
    "cntrl": "\x00\x1f\x7f\x7f",
    "digit": "09",
    "graph": "!~",
    "lower": "az",
    "print": " ~",
    "punct": "!/:@[`{~",
    "space": "\t\r  ",
    "upper": "AZ",
    "word": "09AZ__az",
    "xdigit": "09AFaf",
}
_CONTROL = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
_WORD = "[0-9A-Z_a-z]"
_TOO_COMMON = set(" .,/-_=:\"'") | {chr(c) for c in range(128) if chr(c).isalnum()}


class RegexSyntaxError(ValueError):
    """The pattern is not valid RE2 syntax."""


class RegexLoopError(RegexSyntaxError):
    """The pattern is valid, but no unambiguous form of one of its loops is known or small enough."""


@dataclass(frozen=True)
class SparkRegex:
    """A pattern as written, its Java form, and literals each match must hold."""

    source: str
    java: str
    needs: tuple[frozenset[str], ...] = ()


def _pairs(text: str) -> list[tuple[int, int]]:
    return [(ord(a), ord(b)) for a, b in zip(text[::2], text[1::2])]


def _merge(ranges):
    merged: list[list[int]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return [(a, b) for a, b in merged]


def _invert(ranges):
    gaps, nxt = [], 0
    for low, high in _merge(ranges):
        if low > nxt:
            gaps.append((nxt, low - 1))
        nxt = high + 1
    if nxt <= _MAX_CODE:
        gaps.append((nxt, _MAX_CODE))
    return gaps


@lru_cache(maxsize=1)
def _fold_orbits() -> dict[int, tuple[int, ...]]:
    """Characters equal under simple case folding, derived from Unicode data."""
    groups = defaultdict(list)
    for code in range(_MAX_CODE + 1):
        char = chr(code)
        folded, lower = char.casefold(), char.lower()
        key = folded if len(folded) == 1 else lower if len(lower) == 1 else char
        if key != char or char.upper() != char or lower != char:
            groups[key].append(code)
    return {c: tuple(codes) for codes in groups.values() if len(codes) > 1 for c in codes}


def _fold(ranges):
    orbits = _fold_orbits()
    extra = []
    for code, orbit in orbits.items():
        if any(low <= code <= high for low, high in ranges):
            extra.extend((c, c) for c in orbit)
    return _merge(list(ranges) + extra)


def _code_text(code: int) -> str:
    char = chr(code)
    if char.isascii() and char.isalnum():
        return char
    if char.isascii() and char.isprintable() and char != " ":
        return "\\" + char
    return f"\\x{{{code:x}}}"


def quote(text: str) -> str:
    """Java pattern matching ``text`` literally."""
    return "".join(c if not c.isascii() else _code_text(ord(c)) for c in text)


def wildcard(text: str) -> str:
    """Anchored Java pattern in which ``*`` stands for any characters."""
    return "\\A" + "[^\\n]*".join(quote(part) for part in text.split("*")) + "\\z"


def _class_text(ranges, named=(), negated=False) -> str:
    body = "".join(
        _code_text(a) if a == b else f"{_code_text(a)}-{_code_text(b)}" for a, b in _merge(ranges)
    ) + "".join(named)
    if not body:
        return "[\\x{0}-\\x{10ffff}]" if negated else "(?!)"
    return f"[{'^' if negated else ''}{body}]"


@dataclass
class _Node:
    java: str
    literal: str | None = None
    clauses: list[frozenset[str]] = field(default_factory=list)
    nullable: bool = False
    ranges: list[tuple[int, int]] | None = None  # of a single-character node
    run: _Node | None = None  # the repeated node, when this is an unbounded greedy or lazy run
    parts: list[_Node] | None = None  # of a group with one branch
    first: list[tuple[int, int]] | None = None  # what a match can begin with, if known
    delimited: bool = False  # no match is the beginning of another
    tail: list[tuple[int, int]] | None = None  # or only by more of this class, which ends it
    size: int | None = None  # characters, where all matches have as many
    fixed: bool = False  # one character after another, no choices
    loops: tuple[_Loop, ...] = ()  # loops at the end, whose follower isn't known yet
    tree: tuple | None = None  # for automata, where all classes are known

    def __post_init__(self):
        if self.ranges is not None and self.tree is None:
            self.tree = ("set", self.ranges)
        if self.ranges is not None and self.first is None:
            self.first, self.delimited, self.fixed, self.size = self.ranges, True, True, 1


@dataclass(frozen=True)
class _Loop:
    first: tuple[tuple[int, int], ...] | None
    delimited: bool
    tail: tuple[tuple[int, int], ...] | None = None


def _disjoint(one, two) -> bool:
    return one is not None and two is not None and all(b < c or d < a for a, b in one for c, d in two)


def _is_plain(tree: tuple | None) -> bool:
    """Whether a tree is known and free of assertions."""
    if tree is None or tree[0] == "assert":
        return False
    return tree[0] == "set" or (_is_plain(tree[1]) if tree[0] == "rep" else all(map(_is_plain, tree[1])))


def _best(clauses):
    return max(clauses, key=lambda c: (min(map(len, c)), -len(c)), default=None)


class _Translator:
    def __init__(self, source: str):
        self.source, self.pos = source, 0
        self.flags = {"i": False, "m": False, "s": False, "U": False}
        self.uncertain = False  # a loop was met that can't be made possessive as it stands

    def fail(self, why: str):
        raise RegexSyntaxError(f"invalid regex {self.source!r}: {why}")

    def peek(self, size: int = 1) -> str:
        return self.source[self.pos : self.pos + size]

    def take(self) -> str:
        if self.pos >= len(self.source):
            self.fail("unexpected end")
        char = self.source[self.pos]
        self.pos += 1
        return char

    # -- structure ---------------------------------------------------------

    def translate(self) -> SparkRegex:
        node = self.alternation(top=True)
        if self.pos < len(self.source):
            self.fail("unexpected )")
        java = self.without_ambiguity(node) if self.uncertain else node.java
        if node.nullable:
            # Drop an empty match that touches the previous match.
            return SparkRegex(self.source, f"(?>{java})(?:(?!\\G)|\\A)")
        useful = [c for c in node.clauses if all(len(s) > 1 or s not in _TOO_COMMON for s in c)]
        useful.sort(key=lambda c: -min(map(len, c)))
        return SparkRegex(self.source, java, tuple(useful[:3]))

    def without_ambiguity(self, node: _Node) -> str:
        """The pattern by way of an automaton; assertions can lead and end it."""
        parts = list(node.tree[1]) if node.tree and node.tree[0] == "cat" else [node.tree]
        before, end = [], ""
        while parts and parts[0] and parts[0][0] == "assert":
            before.append(parts.pop(0)[2])
        if parts and parts[-1] and parts[-1][0] == "assert" and parts[-1][1] in ("z", "b", "B"):
            end = parts.pop()[1]
        if not all(map(_is_plain, parts)):
            raise RegexLoopError(f"cannot run {self.source!r} on long lines: it repeats a group whose ends are not certain, beside an assertion or a Unicode class")
        try:
            java, lead = unambiguous(("cat", parts), end, _class_text)
        except TooLarge as error:
            raise RegexLoopError(f"cannot run {self.source!r} on long lines: it repeats a group whose ends are not certain, and {error}") from error
        guard = f"(?:(?<!{lead})|\\G)" if lead and not before else ""
        if end and not before:
            guard = self.guard_swallowed(("cat", parts))
        return "".join(before) + guard + java

    @staticmethod
    def guard_swallowed(tree: tuple) -> str:
        """No match begins behind what could begin it, unless the match before took part of that."""
        ones, pairs = swallowed(tree)
        behind = ([_class_text(ones)] if ones else []) + [_class_text(a) + _class_text(b) for a, b in pairs]
        if not behind:
            return ""
        taken = "|\\G" + (f"|(?<=\\G{_class_text([(0, 0x10FFFF)])})" if pairs else "")
        return "(?:" + "".join(f"(?<!{text})" for text in behind) + taken + ")"

    def alternation(self, top: bool = False) -> _Node:
        saved = dict(self.flags)
        branches = [self.sequence()]
        while self.peek() == "|":
            self.pos += 1
            branches.append(self.sequence())
        self.flags = saved
        if len(branches) == 1:
            parts = branches[0]
            if top and parts and not all(p.nullable for p in parts):
                self.guard_leading_run(parts)
            return self.join(parts)
        if not top and all(len(parts) == 1 and parts[0].ranges is not None for parts in branches):
            ranges = _merge([r for parts in branches for r in parts[0].ranges])
            return _Node(_class_text(ranges), ranges=ranges)
        nodes = [self.join(parts) for parts in branches]
        trees = [n.tree for n in nodes]
        clauses = [c for c in nodes[0].clauses if all(c in n.clauses for n in nodes)]
        if not clauses:
            picks = [_best(n.clauses) for n in nodes]
            union = frozenset().union(*picks) if all(picks) else frozenset()
            clauses = [union] if 0 < len(union) <= 8 else []
        return _Node(
            "|".join(n.java for n in nodes),
            clauses=clauses,
            nullable=any(n.nullable for n in nodes),
            first=_merge([r for n in nodes for r in n.first]) if all(n.first is not None for n in nodes) else None,
            delimited=all(n.delimited for n in nodes) and all(_disjoint(a.first, b.first) or a.size == b.size is not None for i, a in enumerate(nodes) for b in nodes[:i]),
            size=nodes[0].size if len({n.size for n in nodes}) == 1 else None,
            loops=tuple(loop for n in nodes for loop in n.loops),
            tree=("alt", trees) if all(trees) else None,
        )

    @staticmethod
    def guard_leading_run(parts) -> None:
        """A match led by an unbounded class run cannot start inside such a run."""
        lead = parts[0]
        if lead.run:
            lead.java = f"(?:(?<!{lead.run.java})|\\G){lead.java}"

    def settle(self, loops, following) -> tuple[_Loop, ...]:
        """The loops that may still end the match; those that what follows could enter are uncertain."""
        for loop in loops:
            if not loop.delimited or not _disjoint(loop.first, following.first) or not (loop.tail is None or _disjoint(loop.tail, following.first)):
                self.uncertain = True
        return tuple(loops) if following.nullable else ()

    @staticmethod
    def starts(parts):
        """What a sequence can begin with, or None."""
        found = []
        for part in parts:
            if part.first is None:
                return None
            found += part.first
            if not part.nullable:
                return _merge(found)
        return _merge(found)

    @staticmethod
    def is_delimited(parts) -> bool:
        """Every part ends for certain: by itself, or a run of a class by what comes next."""
        for part, after in zip(parts, [*parts[1:], None]):
            if part.run is not None:
                if after is None or after.nullable or not _disjoint(part.run.ranges, after.first):
                    return False
            elif not part.delimited or part.nullable:
                return False
        return bool(parts)

    def join(self, parts) -> _Node:
        loops: tuple[_Loop, ...] = ()
        for part in parts:
            loops = (self.settle(loops, part) if loops else ()) + part.loops
        clauses, run = [], ""
        for part in parts + [_Node("", clauses=[])]:
            if part.literal is not None:
                run += part.literal
                continue
            if run:
                clauses.append(frozenset([run]))
                run = ""
            clauses.extend(part.clauses)
        return _Node(
            "".join(p.java for p in parts),
            clauses=clauses,
            nullable=all(p.nullable for p in parts),
            parts=list(parts),
            first=self.starts(parts),
            delimited=self.is_delimited(parts),
            tail=parts[-1].run.ranges if parts and parts[-1].run and (len(parts) == 1 or self.is_delimited(parts[:-1])) else None,
            size=sum(p.size for p in parts) if all(p.size is not None for p in parts) else None,
            fixed=all(p.fixed for p in parts),
            loops=loops,
            tree=("cat", [p.tree for p in parts]) if all(p.tree for p in parts) else None,
        )

    def sequence(self) -> list[_Node]:
        parts: list[_Node] = []
        while self.pos < len(self.source) and self.peek() not in ("|", ")"):
            if self.source.startswith("\\Q", self.pos):
                parts.extend(self.quoted())
                if parts:
                    parts.append(self.repeated(parts.pop()))
                continue
            node = self.atom()
            if node is not None:
                parts.append(self.repeated(node))
        return parts

    def quoted(self) -> list[_Node]:
        end = self.source.find("\\E", self.pos + 2)
        text = self.source[self.pos + 2 : end if end >= 0 else len(self.source)]
        self.pos = end + 2 if end >= 0 else len(self.source)
        return [self.char(ord(c)) for c in text]

    # -- repetition --------------------------------------------------------

    def bounds(self):
        """Repetition at the cursor as (text, min, max), or None."""
        char = self.peek()
        if char in ("*", "+", "?"):
            self.pos += 1
            return char, 1 if char == "+" else 0, 1 if char == "?" else None
        if char != "{":
            return None
        end = self.source.find("}", self.pos)
        low, comma, high = self.source[self.pos + 1 : end].partition(",") if end > 0 else ("", "", "")
        if not (low.isascii() and low.isdigit()) or (high and not (high.isascii() and high.isdigit())):
            return None
        least, most = int(low), int(high) if high else (None if comma else int(low))
        if least > MAX_REPEAT or (most or 0) > MAX_REPEAT or (most is not None and most < least):
            self.fail("invalid repeat count")
        self.pos = end + 1
        return "{" + low + comma + high + "}", least, most

    def repeated(self, node: _Node) -> _Node:
        found = self.bounds()
        if found is None:
            return node
        text, least, most = found
        lazy = self.peek() == "?"
        if lazy:
            self.pos += 1
        if self.bounds() is not None:
            self.fail("invalid nested repetition operator")
        suffix = "?" if lazy != self.flags["U"] else ""
        greedy = not suffix
        if node.nullable and most is None:
            self.uncertain = True
        if not suffix and most is None and least < 2 and self.absorbs_repeats(node):
            text = "" if least else "?"
        loops = node.loops
        if text and most is None and node.ranges is None and not node.fixed and not self.is_class(node):
            if suffix or (least > 1 and not node.delimited):
                self.settle((_Loop(None, False),), node)
            suffix, again = "+", self.loop_over(node)
            loops = self.settle(node.loops, node) + (again,)
        elif text and loops and most != 1:
            loops = self.settle(loops, node) + loops
        clauses = []
        if least > 0:
            clauses = [frozenset([node.literal])] if node.literal is not None else node.clauses
        return _Node(
            node.java + text + suffix,
            clauses=clauses,
            nullable=least == 0 or node.nullable,
            run=node if node.ranges is not None and most is None else None,
            first=node.first,
            delimited=node.delimited and least == most,
            size=node.size * least if node.size is not None and least == most else None,
            fixed=node.fixed and least == most,
            loops=loops,
            tree=("rep", node.tree, least, most, greedy) if node.tree else None,
        )

    @staticmethod
    def loop_over(node: _Node) -> _Loop:
        fixed = lambda x: None if x is None else tuple(x)
        ends = not node.delimited and not node.nullable and node.tail is not None and _disjoint(node.tail, node.first)
        return _Loop(fixed(node.first), node.delimited or ends, fixed(node.tail) if ends else None)

    @staticmethod
    def is_class(node: _Node) -> bool:
        """A named class, which has no known ranges but is one character."""
        return node.java.startswith("[") and node.parts is None or node.java.startswith("(?:[") and node.parts is not None and len(node.parts) == 1 and node.parts[0].java.startswith("[") and node.parts[0].java + ")" == node.java[3:]

    @staticmethod
    def absorbs_repeats(node: _Node) -> bool:
        """True for ``(AB+)`` with A inside B: repeating it matches nothing new.

        Left as it is, ``(AB+)+`` gives a backtracking engine very many ways to
        split one run.
        """
        if not node.parts or len(node.parts) != 2:
            return False
        head, tail = node.parts
        if head.ranges is None or tail.run is None or not tail.java.endswith("+"):
            return False
        inner = _merge(tail.run.ranges)
        return all(any(a <= low and high <= b for a, b in inner) for low, high in head.ranges)

    # -- atoms -------------------------------------------------------------

    @staticmethod
    def assertion(kind: str, java: str) -> _Node:
        return _Node(java, nullable=True, tree=("assert", kind, java))

    def char(self, code: int) -> _Node:
        if self.flags["i"] and code in _fold_orbits():
            return self.klass([(code, code)])
        text = chr(code) if code > 127 else _code_text(code)
        return _Node(text, literal=chr(code), ranges=[(code, code)])

    def klass(self, ranges, named=(), negated=False) -> _Node:
        if self.flags["i"]:
            ranges = _fold(ranges)
        known = None if named else _invert(ranges) if negated else _merge(ranges)
        return _Node(_class_text(ranges, named, negated), ranges=known)

    def atom(self) -> _Node | None:
        char = self.take()
        if char == "(":
            return self.group()
        if char == "[":
            return self.bracket()
        if char == "\\":
            return self.escape()
        if char == ".":
            return self.klass([] if self.flags["s"] else [(10, 10)], negated=True)
        if char == "^":
            return self.assertion("m" if self.flags["m"] else "A", "(?:\\A|(?<=\\n))" if self.flags["m"] else "\\A")
        if char == "$":
            return self.assertion("m" if self.flags["m"] else "z", "(?=\\n|\\z)" if self.flags["m"] else "\\z")
        if char in "*+?":
            self.fail("missing argument to repetition operator")
        if char == "{":
            self.pos -= 1
            if self.bounds() is not None:
                self.fail("missing argument to repetition operator")
            self.pos += 1
        return self.char(ord(char))

    def group(self) -> _Node | None:
        opening = "("
        saved = dict(self.flags)
        if self.peek() == "?":
            self.pos += 1
            name_at = 2 if self.peek(2) == "P<" else 1 if self.peek() == "<" else 0
            if name_at and self.peek(2) not in ("<=", "<!"):
                end = self.source.find(">", self.pos)
                name = self.source[self.pos + name_at : end]
                if end < 0 or not name or not all(c == "_" or (c.isascii() and c.isalnum()) for c in name):
                    self.fail("invalid named capture")
                self.pos = end + 1
            else:
                opening = "(?:"
                if self.inline_flags() == ")":
                    return None
        inner = self.alternation()
        if self.peek() != ")":
            self.fail("missing closing )")
        self.pos += 1
        self.flags = saved
        return _Node(
            opening + inner.java + ")",
            clauses=inner.clauses,
            nullable=inner.nullable,
            parts=inner.parts,
            first=inner.first,
            delimited=inner.delimited or inner.ranges is not None,
            tail=inner.tail,
            size=inner.size,
            fixed=inner.fixed or inner.ranges is not None,
            loops=inner.loops,
            tree=inner.tree,
        )

    def inline_flags(self) -> str:
        value = True
        while True:
            char = self.take()
            if char in (":", ")"):
                return char
            if char == "-" and value:
                value = False
            elif char in self.flags:
                self.flags[char] = value
            else:
                self.fail("invalid or unsupported group syntax")

    def escape(self) -> _Node:
        char = self.take()
        if char in "dsw":
            return self.klass(_pairs(_PERL[char]))
        if char in "DSW":
            ranges = _pairs(_PERL[char.lower()])
            return self.klass(ranges, negated=True)
        if char in "pP":
            return self.klass([], [self.unicode_class(char == "P")])
        if char == "A":
            return self.assertion("A", "\\A")
        if char == "z":
            return self.assertion("z", "\\z")
        if char in "bB":
            sides = (f"(?<={_WORD})(?!{_WORD})", f"(?<!{_WORD})(?={_WORD})")
            if char == "B":
                sides = (f"(?<={_WORD})(?={_WORD})", f"(?<!{_WORD})(?!{_WORD})")
            return self.assertion(char, f"(?:{sides[0]}|{sides[1]})")
        self.pos -= 1
        return self.char(self.escaped_code())

    def escaped_code(self) -> int:
        """Code point of the escape whose letter is at the cursor."""
        char = self.take()
        if char in _CONTROL:
            return _CONTROL[char]
        if char == "x":
            if self.peek() == "{":
                end = self.source.find("}", self.pos)
                digits, self.pos = self.source[self.pos + 1 : end], end + 1
            else:
                digits, self.pos = self.peek(2), self.pos + 2
                if len(digits) < 2:
                    self.fail("invalid escape sequence")
            try:
                code = int(digits, 16)
            except ValueError:
                self.fail("invalid escape sequence")
            if code > _MAX_CODE:
                self.fail("invalid escape sequence")
            return code
        if char in "01234567" and (char == "0" or self.peek() in tuple("01234567")):
            digits = char
            while len(digits) < 3 and self.peek() in tuple("01234567"):
                digits += self.take()
            return int(digits, 8)
        if char.isascii() and not char.isalnum():
            return ord(char)
        self.fail(f"invalid escape sequence \\{char}")

    def unicode_class(self, negated: bool) -> str:
        if self.peek() == "{":
            end = self.source.find("}", self.pos)
            name, self.pos = self.source[self.pos + 1 : end], end + 1
        else:
            name = self.take()
        if name.startswith("^"):
            name, negated = name[1:], not negated
        if not name.replace("_", "").isalpha():
            self.fail("invalid character class")
        if self.flags["i"] and name in ("Lu", "Ll", "Lt"):
            name = "LC"
        prefix = "" if len(name) <= 2 else "Is"
        return f"\\{'P' if negated else 'p'}{{{prefix}{name}}}"

    def bracket(self) -> _Node:
        negated = self.peek() == "^"
        if negated:
            self.pos += 1
        ranges, named, first = [], [], True
        while True:
            if self.pos >= len(self.source):
                self.fail("missing closing ]")
            if self.peek() == "]" and not first:
                self.pos += 1
                break
            first = False
            if self.peek(2) == "[:" and ":]" in self.source[self.pos + 2 :]:
                end = self.source.index(":]", self.pos + 2)
                name, self.pos = self.source[self.pos + 2 : end], end + 2
                found = _POSIX.get(name.removeprefix("^"))
                if found is None:
                    self.fail("invalid character class range")
                ranges += _invert(_pairs(found)) if name.startswith("^") else _pairs(found)
                continue
            if self.peek() == "\\" and self.peek(2)[1:] in tuple("dswDSWpP"):
                kind = self.peek(2)[1]
                self.pos += 2
                if kind in "pP":
                    named.append(self.unicode_class(kind == "P"))
                else:
                    pairs = _pairs(_PERL[kind.lower()])
                    ranges += pairs if kind.islower() else _invert(pairs)
                continue
            low = high = self.class_char()
            if self.peek() == "-" and self.peek(2)[1:] not in ("]", ""):
                self.pos += 1
                high = self.class_char()
                if high < low:
                    self.fail("invalid character class range")
            ranges.append((low, high))
        return self.klass(ranges, named, negated)

    def class_char(self) -> int:
        char = self.take()
        return self.escaped_code() if char == "\\" else ord(char)


@lru_cache(maxsize=4096)
def to_spark_regex(source: str) -> SparkRegex:
    """Rewrite an RE2-syntax pattern; raises :class:`RegexSyntaxError`."""
    return _Translator(source).translate()
