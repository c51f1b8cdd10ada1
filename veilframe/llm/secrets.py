"""Secret scanning: three fixed patterns, and an assignment-aware lexer.

The lexer looks for targets (a name and an assignment sign: =, :, :=, =>) and reads the expression after each as source
or configuration syntax: quoted literals with or without a prefix, triple-quoted ones, bare words, brackets
over several lines, literals joined by + . & or by standing side by side, lines continued by a backslash, block scalars,
element texts, and a name and a value given as two attributes or keys of their own. Names stand for the literals they
were given before (constants), within the function or class that gave them. A literal scores by the sensitive words in the target's name and
by its own look; spans that score ``LEAST_SCORE`` or more are added, unless a fixed pattern covers them. All
scanning is in linear time, whatever the length of lines and blanks, and constants have any number of parts; only a sum of constants
that share parts is counted part by part.

Defined results: null text is empty; spans are in code points, end exclusive; a literal over several lines has a span a
line; rows that repeat an id are rows like any other. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

KINDS = ("assign", "access", "hex", "lexed")
# The three base patterns.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs are maximal, so a failing run holds no other match
HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_SECRET = 6

# Name parts that make a target sensitive, with their weights.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "private": 1.5, "auth": 1.5, "key": 1.0, "access": 1.0, "bearer": 2.0, "signature": 1.0, "salt": 1.0, "cookie": 1.0, "session": 0.5, "api": 1.0}
PLACEHOLDERS = {"changeme", "example", "placeholder", "none", "null", "true", "false", "undefined", "redacted"}
LEAST_SCORE, LEAST_LITERAL = 3.5, 8
_LONGEST_PLACEHOLDER = max(map(len, PLACEHOLDERS))
_SPACE, _CLASSES = re.compile(r"\s"), [re.compile(p) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]")]

# A target from here on, and one anywhere later. No quantifier that is unbounded can give back what it took, and a search
# only begins where a run of name characters does, so lines of any length are read in linear time.
_HERE = r"""["'`]?[\d.\-\[\]]*+([A-Za-z_][\w.\-\[\]]*+)["'`]?[^\S\n]*+(?::[^\S\n]*+[A-Za-z_][\w\[\]. ]{0,40}?[^\S\n]*+(?==)|:[^\S\n]{0,4}[A-Za-z_][\w\[\]. ]{0,40}?)?(:=|=>|=|:)(?![=])"""
_TARGET, _LATER = re.compile(f"(?a){_HERE}"), re.compile(rf"(?a)(?<![\w.\-\[\]]){_HERE}")
_SIGN = re.compile("[=:]")
_BLANKS = re.compile(r"(?:[^\S\n]++|\\\r?\n)*+")
_OPEN_BLANKS = re.compile(r"(?:\s++|\\\r?\n|(?:\#|//)[^\n]*+)*+")  # within brackets line ends and comments count for nothing
_TRIPLE = re.compile(r"""[A-Za-z]{0,2}("{3}|'{3})""")
_PART = re.compile(r"""(?a)[A-Za-z]{0,2}"([^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|[A-Za-z]{0,2}'([^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'|`([^`\n]*+)`|([A-Za-z0-9+/_.=\-$]++)""")
_BARE = 4
_JOINED = re.compile(r"[+.&]")
_NAME = re.compile(r"(?a)[A-Za-z_][\w.]*\Z")
_BLOCK = re.compile(r"[|>][+-]?\d?[^\S\n]*\r?\n")
_ELEMENT = re.compile(r"(?a)<([A-Za-z_][\w.\-]*+)>([^<>\n]++)</")
_SCOPE = re.compile(r"(?:(?:export|default|public|private|protected|static|async|pub)[^\S\n]+)*(?:def|class|function|func|fn|sub)\b")
_NAMING = {"key", "name", "id"}
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and non-overlapping within a kind."""
    spans = []
    lowered = text.encode("utf-8", "surrogatepass").lower()
    if any(word in lowered for word in _ASSIGN_WORDS):
        spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_SECRET]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return spans


def _sensitivity(name: str) -> float:
    pieces = [p.lower() for p in _PIECE.findall(name)]
    pairs = [a + b for a, b in zip(pieces, pieces[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in pieces + pairs), default=0.0) + 0.5 * max(0, sum(p in SENSITIVE for p in pieces) - 1)


def _look(value: Literal) -> float:
    """How much a literal looks like a secret: its entropy a character, and mixed character classes."""
    if value._look is None:
        value._look = _counted_look(value, value.counts())
    return value._look


def _counted_look(value: Literal, counts: Counter[str]) -> float:
    size = sum(counts.values())
    if size < LEAST_LITERAL or size <= _LONGEST_PLACEHOLDER and value.text().lower() in PLACEHOLDERS or any(map(_SPACE.match, counts)):
        return -math.inf
    entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
    classes = sum(any(map(p.match, counts)) for p in _CLASSES)
    return min(entropy, 4.0) / 2 + 0.5 * (classes - 1)


Part = tuple[int, int, str]  # start, end, text


class Literal:
    """Parts in their order, each once. Constants within it are shared, not copied, so sums of sums take no more room than their source.

    ``low`` and ``high`` bound the places of its parts. Parts that stand in an expression itself are in no constant before it.
    """

    __slots__ = ("items", "low", "high", "_counts", "_look")

    def __init__(self, items: Iterable[Part | Literal]):
        self.items = tuple(dict.fromkeys(items))
        self.low = min(x.low if isinstance(x, Literal) else x[0] for x in self.items)
        self.high = max(x.high if isinstance(x, Literal) else x[1] for x in self.items)
        self._counts: Counter[str] | None = None
        self._look: float | None = None

    def __iter__(self) -> Iterator[Part]:
        return self.parts(set())

    def parts(self, seen: set) -> Iterator[Part]:
        """Its parts, but for those of literals, by identity, and parts already seen."""
        stack = [iter((self,))]
        while stack:
            for x in stack[-1]:
                key = id(x) if isinstance(x, Literal) else x
                if key in seen:
                    continue
                seen.add(key)
                if isinstance(x, Literal):
                    stack.append(iter(x.items))
                    break
                yield x
            else:
                stack.pop()

    def text(self) -> str:
        return "".join(text for _, _, text in self)

    def _apart(self) -> bool:
        """No two of its constants share a part, as far as their bounds tell."""
        bounds = sorted((x.low, x.high) for x in self.items if isinstance(x, Literal))
        return all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))

    def counts(self) -> Counter[str]:
        """Its characters, in the order of their first coming: summed up from its constants, or, where these may overlap, from its parts."""
        todo = [self]
        while todo:
            last = todo[-1]
            if last._counts is None:
                apart = last._apart()
                if apart and (waiting := [x for x in last.items if isinstance(x, Literal) and x._counts is None]):
                    todo += waiting
                    continue
                last._counts = Counter()
                for x in last.items if apart else last:
                    if isinstance(x, Literal):
                        for c, n in x._counts.items():
                            last._counts[c] += n
                    else:
                        last._counts.update(x[2])
            todo.pop()
        return self._counts


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


class _Constants:
    """Names and their literals. A name given within a function or class is forgotten at its end, where an outer one is back."""

    def __init__(self, text: str):
        self.bounds: list[tuple[int, int]] = []  # (from, to) of each function or class, by start
        self.known: dict[str, list[tuple[int, Literal]]] = {}
        if not _SCOPE.search(text):
            return
        open_, at, spans = [], 0, []
        for line in text.split("\n"):
            if line.strip():
                indent = _indent(line)
                while open_ and open_[-1][0] >= indent:
                    spans.append((open_.pop()[1], at))
                if _SCOPE.match(line, indent):
                    open_.append((indent, at))
            at += len(line) + 1
        self.bounds = sorted(spans + [(start, at) for _, start in open_])
        self.next, self.inner = 0, []

    def _end(self, at: int) -> int:
        """Where the innermost function or class around a place ends. Places come in order."""
        if not self.bounds:
            return 1 << 62
        while self.next < len(self.bounds) and self.bounds[self.next][0] <= at:
            self.inner.append(self.bounds[self.next][1])
            self.next += 1
        while self.inner and self.inner[-1] <= at:
            self.inner.pop()
        return self.inner[-1] if self.inner else 1 << 62

    def give(self, name: str, literal: Literal, at: int) -> None:
        end, given = self._end(at), self.known.setdefault(name, [])
        while given and given[-1][0] <= end:
            given.pop()
        given.append((end, literal))

    def get(self, name: str, at: int) -> Literal | None:
        given = self.known.get(name)
        while given and given[-1][0] <= at:
            given.pop()
        return given[-1][1] if given else None


def _line_parts(text: str, start: int, end: int) -> list[Part]:
    """The lines of a literal over several lines, without blanks around and without armour lines."""
    parts = []
    for line in text[start:end].split("\n"):
        inner = line.strip()
        if inner and not inner.startswith("-----"):
            at = start + line.index(inner)
            parts.append((at, at + len(inner), inner))
        start += len(line) + 1
    return parts


def _block(text: str, at: int, indent: int) -> tuple[list[Part], int]:
    """The lines from here on that are indented deeper, as one literal."""
    end = at
    while end < len(text):
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        line = text[end:stop]
        if line.strip() and _indent(line) <= indent:
            break
        end = stop + 1
    return _line_parts(text, at, min(end, len(text))), min(end, len(text))


def _whole(literals: list[list[Part | Literal]]) -> list[Literal]:
    """Literals that have a part. One that is a constant and nothing else is that constant."""
    return [x[0] if len(x) == 1 and isinstance(x[0], Literal) else Literal(x) for x in literals if x]


def _value(text: str, at: int, indent: int, known: _Constants) -> tuple[list[Literal], int]:
    """The literals that an expression holds, and where it ends. In brackets, a comma parts literals."""
    at = _BLANKS.match(text, at).end()
    if block := _BLOCK.match(text, at):
        literal, at = _block(text, block.end(), indent)
        return _whole([literal]), at
    found: list[list[Part | Literal]] = [[]]
    depth, quoted = 0, False
    while True:
        at = (_OPEN_BLANKS if depth else _BLANKS).match(text, at).end()
        if text[at : at + 1] in ("(", "["):
            depth, at = depth + 1, at + 1
            continue
        if triple := _TRIPLE.match(text, at):
            close = text.find(triple[1], triple.end())
            if close < 0:
                break
            found[-1] += _line_parts(text, triple.end(), close)
            at, quoted = close + 3, True
        elif m := _PART.match(text, at):
            bare = m.lastindex == _BARE
            if bare and quoted:  # words do not join by standing beside a literal
                break
            if bare and text[m.end() : m.end() + 1] == "(":  # a call gives no literal of its own
                return _whole(found), m.end()
            constant = known.get(m[_BARE], at) if bare and _NAME.match(m[_BARE]) else None
            if constant is not None:
                found[-1].append(constant)
            elif m[m.lastindex]:
                found[-1].append((m.start(m.lastindex), m.end(m.lastindex), m[m.lastindex]))
            at, quoted = m.end(), not bare
        else:
            break
        after = at
        while True:  # what follows a part: a bracket's end, a comma within brackets, a joining sign, or another literal
            after = (_OPEN_BLANKS if depth else _BLANKS).match(text, after).end()
            sign = text[after : after + 1]
            if depth and sign in (")", "]"):
                depth, after = depth - 1, after + 1
                at = after
                if not depth:
                    break
                continue
            break
        if depth and sign == ",":
            found.append([])
            at, quoted = after + 1, False
        elif _JOINED.match(text, after) and sign:
            at, quoted = after + 1, False
        elif not (quoted and sign in ('"', "'")):
            break
        else:
            at = after
    return _whole(found), at


def pairs(text: str) -> list[tuple[str, Literal]]:
    """(name, literal) of every assignment, constants propagated in the order of the text."""
    known = _Constants(text)
    found: list[tuple[str, Literal]] = []
    naming: Literal | None = None  # the value of the last pair, if that gives a name
    named, spelled = None, ""
    at = 0
    while sign := _SIGN.search(text, at):
        start = text.rfind("\n", 0, sign.start()) + 1
        end = text.find("\n", sign.start())
        end, at = len(text) if end < 0 else end, max(at, start)
        indent = _indent(text[start:end])
        while at < end and (m := _TARGET.match(text, at, end) or _LATER.search(text, at, end)):
            literals, at = _value(text, m.end(), indent, known)
            at = max(at, m.end())
            if not literals:
                continue
            name = m[1]
            known.give(name, literals[0] if len(literals) == 1 else Literal(literals), m.start())
            found += [(name, literal) for literal in literals]
            if naming and name.lower() == "value":
                if named is not naming:
                    named, spelled = naming, naming.text()
                found += [(spelled, literal) for literal in literals]
            naming = literals[0] if name.lower() in _NAMING else None
        else:
            at = max(at, end)
    found += [(m[1], Literal([(m.start(2), m.end(2), m[2])])) for m in _ELEMENT.finditer(text)]
    return found


def lexed_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Literals that score as secrets and overlap no span already taken."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    spans, seen, weights = set(), set(), {}
    found = pairs(text)  # holds the literals, whose identities are what is seen
    for name, value in found:
        weight = weights[name] if name in weights else weights.setdefault(name, _sensitivity(name))
        if weight and weight + _look(value) >= LEAST_SCORE:
            spans |= {("lexed", a, b) for a, b, _ in value.parts(seen) if not any(s < b and a < e for _, s, e in taken)}
    return list(spans)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans, by start and then by kind."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + lexed_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every secret replaced; of an assignment, the name stays."""
    if not text or not (spans := scan(text)):
        return text
    cuts = []
    for kind, a, b in spans:
        if kind == "assign":
            m = ASSIGN.match(text, a)
            a, b = m.span(2)
        cuts.append((a, b))
    out, at = [], 0
    for a, b in sorted(cuts):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]
