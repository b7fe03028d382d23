"""Symbols and raw facts of source files: one pass over each file, on the executors.

Both parsers give rows of one table: symbols (kind, name, lines) and facts (imports,
inherits, calls, names read, uses).  Who owns a fact, what kind of edge it makes and
which symbol it means is decided afterwards by joins (symbols.py).

A large file is read in pieces of whole top-level statements, so that a worker holds the
tree of one piece and not that of the file.  The rows and their order are those of the whole.
"""

from __future__ import annotations

import ast
import marshal
import re
import tempfile
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame

PARSED = "path string, language string, row_type string, kind string, name string, qualified_name string, parent string, start_line int, end_line int, ord int"


@dataclass
class Row:
    row_type: str  # symbol or fact
    kind: str
    name: str
    start_line: int
    end_line: int
    qualified_name: str | None = None
    parent: str | None = None


# ---------------------------------------------------------------- Python


def _dotted(node: ast.expr) -> str | None:
    """a.b.c of names and attributes; what stands before an attribute of a call or an index is dropped."""
    tail: list[str] = []
    while isinstance(node, ast.Attribute):
        tail.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        tail.append(node.id)
    return ".".join(reversed(tail)) or None


class _PythonSymbols(ast.NodeVisitor):
    """Classes and functions with their qualified names, and plain names assigned outside of them."""

    def __init__(self):
        self.scope: list[str] = []
        self.rows: list[Row] = []

    def visit(self, node):
        if not isinstance(node, ast.expr):  # no statement stands in an expression
            super().visit(node)

    def _nested(self, node, kind: str) -> None:
        parent = ".".join(self.scope) or None
        self.scope.append(node.name)
        self.rows.append(Row("symbol", kind, node.name, node.lineno, node.end_lineno, ".".join(self.scope), parent))
        self.generic_visit(node)
        self.scope.pop()

    def visit_ClassDef(self, node):
        self._nested(node, "class")

    def visit_FunctionDef(self, node):
        self._nested(node, "function")

    def visit_AsyncFunctionDef(self, node):
        self._nested(node, "async_function")

    def _assigned(self, node, targets: list[ast.expr]) -> None:
        if self.scope:
            self.generic_visit(node)
            return
        self.rows += [Row("symbol", "variable", t.id, node.lineno, node.end_lineno, t.id) for t in targets if isinstance(t, ast.Name)]

    def visit_Assign(self, node):
        self._assigned(node, node.targets)

    def visit_AnnAssign(self, node):
        self._assigned(node, [node.target])


#: Characters of Python, and tokens of Java, after which a piece of a file may end.
PY_CHARS, JAVA_TOKENS = 1 << 17, 1 << 15
#: A line that may begin a top-level statement, and words that carry one on.
_TOP = re.compile(r"(?<=\n)(?!(?:else|elif|except|finally)\b)[A-Za-z_@]")


def _pieces(content: str, path: str, size: int) -> Iterator[tuple[ast.Module, int]]:
    """Trees of whole top-level statements, and the number of lines before each.

    A cut within a string, a bracket, a continued line or after a decorator leaves a piece that doesn't parse; it is
    carried on to a later cut, and in the end to the end of the file, which decides whether the file is wrong.
    """
    at = lines = 0
    while at < len(content):
        grown = size
        while True:
            m = _TOP.search(content, at + grown)
            end = m.start() if m else len(content)
            piece = content[at:end]
            try:
                tree = ast.parse(piece, filename=path)
                break
            except (SyntaxError, ValueError, RecursionError) as e:
                if end == len(content):
                    if isinstance(e, SyntaxError) and e.lineno is not None:
                        e.lineno += lines
                    raise
                grown *= 2
        yield tree, lines
        lines += piece.count("\n") + piece.count("\r") - piece.count("\r\n")
        at = end


def _children(node: ast.AST) -> Iterator[ast.AST]:
    for name in node._fields:
        v = getattr(node, name, None)
        if isinstance(v, list):
            yield from (x for x in v if isinstance(x, ast.AST))
        elif isinstance(v, ast.AST) and not isinstance(v, ast.expr_context):
            yield v


def _names(node: ast.AST) -> tuple[str, list[str | None]]:
    """The kind of facts that a node makes, and their names."""
    if isinstance(node, ast.Name):
        return "reads", [node.id] if isinstance(node.ctx, ast.Load) else []
    if isinstance(node, ast.Call):
        return "call", [_dotted(node.func)]
    if isinstance(node, ast.Import):
        return "imports", [a.name for a in node.names]
    if isinstance(node, ast.ImportFrom):
        return "imports", [".".join(filter(None, (node.module, a.name))) for a in node.names]
    if isinstance(node, ast.ClassDef):
        return "inherits", [_dotted(base) for base in node.bases]
    return "", []


def _levels(tree: ast.Module) -> Iterator[list[Row]]:
    """Facts of a tree, level by level: together they stand in breadth-first order."""
    level: list[ast.AST] = [tree]
    while level:
        yield [Row("fact", kind, name, node.lineno, node.end_lineno) for node in level for kind, names in (_names(node),) for name in names if name]
        level = [c for node in level for c in _children(node)]


def _symbols(tree: ast.Module) -> list[Row]:
    visitor = _PythonSymbols()
    visitor.visit(tree)
    return visitor.rows


def python_numbered(content: str, path: str, size: int = PY_CHARS) -> Iterator[tuple[int, Row]]:
    """Symbols, then facts in breadth-first order, with their places in that order; a file that doesn't parse raises
    SyntaxError before the first row.

    Rows of a file of several pieces wait in a temporary file until it is known how many stand at each level.
    """
    if len(content) <= size:
        tree = ast.parse(content, filename=path)
        yield from enumerate(chain(_symbols(tree), *_levels(tree)))
        return
    with tempfile.TemporaryFile() as kept:
        counts: list[int] = []  # of symbols, then of facts at each level
        for tree, before in _pieces(content, path, size):
            for k, rows in enumerate(chain([_symbols(tree)], _levels(tree))):
                if k == len(counts):
                    counts.append(0)
                counts[k] += len(rows)
                marshal.dump((k, [(r.row_type, r.kind, r.name, r.start_line + before, r.end_line + before, r.qualified_name, r.parent) for r in rows]), kept)
        ends, nos = kept.tell(), [sum(counts[:k]) for k in range(len(counts))]
        kept.seek(0)
        while kept.tell() < ends:
            k, rows = marshal.load(kept)
            for r in rows:
                yield nos[k], Row(*r)
                nos[k] += 1


def python_rows(content: str, path: str) -> list[Row]:
    """Symbols, then facts in breadth-first order.  A file that doesn't parse raises SyntaxError."""
    return [r for _, r in sorted(python_numbered(content, path), key=lambda x: x[0])]


# ---------------------------------------------------------------- Java

_JAVA = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
      |(?P<text>\"\"\".*?(?:\"\"\"|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)
      |(?P<number>\.?[0-9](?:[eEpP][+-]|[\w.])*)
      |(?P<word>[^\W\d][\w$]*|\$[\w$]*)
      |(?P<sign>->|::|\.\.\.|@interface\b|[^\s\w])""",
    re.S | re.X,
)
_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non".split())
_KEYWORDS = _MODIFIERS | frozenset(
    "assert boolean break byte case catch char class const continue do double else enum extends finally float for goto if implements import instanceof int interface long new package return short super switch this throw throws try void while true false null var yield".split()
)
_TYPES = frozenset(("class", "interface", "enum", "record"))
_PRIMITIVE = frozenset("boolean byte char double float int long short void var".split())


@dataclass
class Token:
    kind: str
    text: str
    line: int


def java_tokens(content: str) -> Iterator[Token]:
    """Words, signs, numbers and literals with their lines; comments and white space are dropped."""
    line, at = 1, 0
    while at < len(content):
        m = _JAVA.match(content, at)
        if m is None:
            at += 1
            continue
        if m.lastgroup != "skip":
            yield Token(m.lastgroup, m.group(), line)
        line += m.group().count("\n")
        at = m.end()


class _More(Exception):
    """What is read leads out of the piece."""


class _Java:
    """A scanner of declarations: bodies of types are read member by member, bodies of methods for facts only.

    Local and anonymous classes make no symbols; annotation types and compact constructors of records make none either.
    It holds the tokens of a piece of the file; whatever looks beyond them, unless they are the last, raises _More.
    """

    def __init__(self, tokens: list[Token], package: str | None = None, last: bool = True):
        self.t, self.last = tokens, last
        self.rows: list[Row] = []
        self.package = package

    def over(self, k: int) -> None:
        if k >= len(self.t) and not self.last:
            raise _More

    def word(self, k: int) -> str:
        self.over(k)
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def close(self, k: int) -> int:
        """The place of the sign that closes the one at k, or the end."""
        pairs, depth = {"(": ")", "{": "}", "[": "]"}, 0
        opening, closing = self.word(k), pairs[self.word(k)]
        while k < len(self.t):
            if self.t[k].kind == "sign":
                depth += (self.t[k].text == opening) - (self.t[k].text == closing)
                if not depth:
                    return k
            k += 1
        self.over(k)
        return len(self.t) - 1

    def angle(self, k: int) -> int:
        """The place after type arguments that begin at k."""
        depth = 0
        while k < len(self.t):
            depth += (self.word(k) == "<") - (self.word(k) == ">")
            k += 1
            if not depth:
                return k
        self.over(k)
        return k

    def dotted(self, k: int) -> tuple[str, int]:
        name, k = self.word(k), k + 1
        while self.word(k) == "." and (self.t[k + 1].kind == "word" or self.word(k + 1) == "*" if k + 1 < len(self.t) else False):
            if self.word(k + 1) == "*":
                return name, k + 2
            name, k = f"{name}.{self.word(k + 1)}", k + 2
        return name, k

    def annotation(self, k: int) -> int:
        """The place after an annotation at k; its arguments are read for facts."""
        _, k = self.dotted(k + 1)
        if self.word(k) == "(":
            end = self.close(k)
            self.facts(k + 1, end)
            k = end + 1
        return k

    def fact(self, kind: str, name: str, a: int, z: int | None = None) -> None:
        self.rows.append(Row("fact", kind, name, self.t[a].line, self.t[z if z is not None and z < len(self.t) else a].line))

    def file(self) -> list[Row]:
        if self.members(0, len(self.t), self.package, top=True) != len(self.t):
            self.over(len(self.t))
        return self.rows

    def members(self, k: int, end: int, parent: str | None, top: bool = False) -> int:
        """Members of a type's body, or the declarations of a file; gives the place after them."""
        while k < end:
            if top and self.word(k) == "package":
                self.package, k = self.dotted(k + 1)
                parent = self.package
            elif top and self.word(k) == "import":
                begin, k = k, k + 1 + (self.word(k + 1) == "static")
                name, k = self.dotted(k)
                self.fact("imports", name, begin, k)
            elif self.word(k) in (";", ","):
                pass
            elif self.word(k) == "{":
                stop = self.close(k)
                self.facts(k + 1, stop)
                k = stop
            elif self.word(k) == "@interface":
                while k < end and self.word(k) != "{":
                    k += 1
                k = self.close(k)
            else:
                k = self.member(k, end, parent) - 1
            k += 1
        return k

    def member(self, k: int, end: int, parent: str | None) -> int:
        """One declaration from its modifiers on; gives the place after it."""
        begin = k
        while k < end and (self.word(k) in _MODIFIERS or self.word(k) == "@" or (self.word(k) == "-" and self.word(k - 1) == "non")):
            k = self.annotation(k) if self.word(k) == "@" else k + 1
        if self.word(k) == "@interface":
            return k
        if self.word(k) in _TYPES and k + 1 < end and self.t[k + 1].kind == "word" and not (self.word(k) == "record" and self.word(k + 2) not in ("(", "<")):
            return self.type(begin, k, end, parent)
        if self.word(k) == "<":
            k = self.angle(k)
        # a type and a name, or a constructor's name alone
        if k < end and self.t[k].kind == "word":
            head, after = self.dotted(k)
            own = parent.rpartition(".")[2] if parent else None
            if self.word(after) == "(" and head == own:
                return self.callable(begin, "constructor", head, after, end, parent)
            if self.word(after) == "{" and head == own:
                stop = self.close(after)
                self.facts(after + 1, stop)
                return stop + 1
            k = after
            while k < end and self.word(k) in ("<", "[", "]", "...", "@", "."):
                k = self.angle(k) if self.word(k) == "<" else self.annotation(k) if self.word(k) == "@" else k + 1 + (self.word(k) == "." and self.word(k + 1) != "<")
            self.over(k)
            if k < end and self.t[k].kind == "word":
                if self.word(k + 1) == "(":
                    return self.callable(begin, "method", self.word(k), k + 1, end, parent)
                return self.fields(begin, k, end, parent)
        return k + 1

    def qualified(self, parent: str | None, name: str) -> str:
        return f"{parent}.{name}" if parent else name

    def type(self, begin: int, k: int, end: int, parent: str | None) -> int:
        keyword, name, q = self.word(k), self.word(k + 1), None
        q = self.qualified(parent, name)
        head = k + 2
        while head < end and self.word(head) not in ("{", ";"):
            head = self.close(head) + 1 if self.word(head) == "(" else head + 1
        stop = self.close(head) if self.word(head) == "{" else min(head, end - 1)
        self.rows.append(Row("symbol", "class", name, self.t[begin].line, self.t[stop].line, q, parent))
        # parents: after implements, and after extends unless it is an interface that extends
        j, taking = k + 2, False
        while j < head:
            w = self.word(j)
            if w == "(":
                j = self.close(j)
            elif w in ("extends", "implements", "permits"):
                taking = w == "implements" or (w == "extends" and keyword != "interface")
            elif w == "<" and not taking:
                j = self.angle(j) - 1
            elif taking and self.t[j].kind == "word" and w not in _KEYWORDS:
                name_, after = self.dotted(j)
                if self.word(after) == "<":
                    self.fact("inherits", "".join(x.text + " " * (x.text == ",") for x in self.t[j : self.angle(after)]).rstrip(), begin, stop)
                    for i in range(after, self.angle(after)):
                        if self.t[i].kind == "word" and self.word(i) not in _KEYWORDS and self.word(i - 1) != ".":
                            self.fact("inherits", self.dotted(i)[0], begin, stop)
                    self.fact("inherits", name_, begin, stop)
                    j = self.angle(after) - 1
                else:
                    self.fact("inherits", name_, begin, stop)
                    j = after - 1
            j += 1
        if self.word(head) == "{":
            first = head + 1
            if keyword == "enum":  # constants first, up to the semicolon
                while first < stop and self.word(first) != ";":
                    if self.word(first) in ("(", "{"):
                        inner = self.close(first)
                        self.facts(first + 1, inner)
                        first = inner
                    elif self.word(first) == "@":
                        first = self.annotation(first) - 1
                    elif self.t[first].kind == "word":
                        self.fact("uses", self.word(first), first)
                    first += 1
            self.members(first, stop, q)
        return stop + 1

    def callable(self, begin: int, kind: str, name: str, k: int, end: int, parent: str | None) -> int:
        """A method or constructor whose parameters open at k."""
        after = self.close(k) + 1
        while after < end and self.word(after) not in ("{", ";"):
            if self.word(after) == "default":  # an annotation's element
                self.facts(after + 1, after + 2)
            after += 1
        stop = self.close(after) if self.word(after) == "{" else min(after, end - 1)
        self.rows.append(Row("symbol", kind, name, self.t[begin].line, self.t[stop].line, self.qualified(parent, name), parent))
        if self.word(after) == "{":
            self.facts(after + 1, stop)
        return stop + 1

    def fields(self, begin: int, k: int, end: int, parent: str | None) -> int:
        """Declarators from the first name at k up to the semicolon; each has the lines of the whole declaration."""
        names, values, j, depth = [self.word(k)], [], k + 1, 0
        start = None
        while j < end and not (self.word(j) == ";" and not depth):
            w = self.word(j)
            if w in ("(", "{", "["):
                j = self.close(j)
            elif w == "=" and start is None:
                start = j + 1
            elif w == "<" and start is not None and self.generic(j):
                j = self.angle(j) - 1
            elif w == "," and j + 1 < end and self.t[j + 1].kind == "word" and self.word(j + 2) in ("=", ",", ";", "["):
                if start is not None:
                    values.append((start, j))
                names.append(self.word(j + 1))
                start = None
            j += 1
        if start is not None:
            values.append((start, j))
        self.over(j)
        stop = min(j, end - 1)
        for n in names:
            self.rows.append(Row("symbol", "field", n, self.t[begin].line, self.t[stop].line, self.qualified(parent, n), parent))
        for a, z in values:
            self.facts(a, z, (begin, stop, parent))
        return stop + 1

    def generic(self, k: int) -> bool:
        """Whether < at k opens type arguments."""
        if k == 0 or self.t[k - 1].kind != "word" or not self.word(k - 1)[:1].isupper():
            return False
        j, depth = k, 0
        while j < len(self.t) and j < k + 60:
            w = self.word(j)
            depth += (w == "<") - (w == ">")
            if not depth:
                return True
            if not (self.t[j].kind == "word" or w in "<>,.?[]&@"):
                return False
            j += 1
        return False

    def facts(self, k: int, end: int, field: tuple | None = None) -> None:
        """Calls and uses of a stretch of code; local variables in a field's value become fields, as declarators do."""
        while k < end:
            t = self.t[k]
            before, after = self.word(k - 1), self.word(k + 1)
            if t.kind == "sign" and t.text == "@" and k + 1 < end and self.t[k + 1].kind == "word":
                k = self.annotation(k)
                continue
            if t.kind == "sign" and t.text == "<" and self.generic(k):
                k = self.angle(k)
                continue
            if t.kind == "word" and t.text not in _KEYWORDS:
                if before == "new" or (before == "." and self.word(k - 2) and self._created(k)):
                    _, k = self.dotted(k)
                    continue
                if after == "(":
                    self.fact("calls", t.text, k, self.close(k + 1))
                elif self._declares(k):
                    # a type position: the type makes no use, and neither does the name that it declares
                    j = self.dotted(k)[1]
                    j = self.angle(j) if self.word(j) == "<" else j
                    while self.word(j) in ("[", "]", "..."):
                        j += 1
                    if field and self.word(j + 1) in ("=", ";", ","):
                        begin, stop, parent = field
                        self.rows.append(Row("symbol", "field", self.word(j), self.t[begin].line, self.t[stop].line, self.qualified(parent, self.word(j)), parent))
                    k = j + 1
                    continue
                elif before in ("instanceof", "throws") or (before == "(" and self._cast(k)):
                    _, k = self.dotted(k)
                    continue
                elif after != "->" or not t.text[:1].islower():
                    self.fact("uses", t.text, k)
            elif t.kind == "word" and t.text in _PRIMITIVE and k + 1 < end and field:
                j = k + 1
                while self.word(j) in ("[", "]"):
                    j += 1
                if self.t[j].kind == "word" and self.word(j + 1) in ("=", ";", ","):
                    begin, stop, parent = field
                    self.rows.append(Row("symbol", "field", self.word(j), self.t[begin].line, self.t[stop].line, self.qualified(parent, self.word(j)), parent))
                    k = j
            elif t.kind == "word" and t.text in ("class", "interface", "enum", "record"):
                k += 1
            k += 1

    def _created(self, k: int) -> bool:
        while k > 1 and self.word(k - 1) == ".":
            k -= 2
        return self.word(k - 1) == "new"

    def _declares(self, k: int) -> bool:
        """Whether a type at k is followed by a name, as in a local declaration, a loop, a catch or a parameter."""
        if self.word(k - 1) in (".", "::"):
            return False
        j = self.dotted(k)[1]
        if self.word(j) == "<" and self.generic(j):
            j = self.angle(j)
        while self.word(j) in ("[", "]", "...") and (self.word(j) != "[" or self.word(j + 1) == "]"):
            j += 1
        return j < len(self.t) and self.t[j].kind == "word" and self.word(j) not in _KEYWORDS and self.word(j + 1) in ("=", ";", ",", ":", ")")

    def _cast(self, k: int) -> bool:
        j = self.dotted(k)[1]
        if self.word(j) == "<" and self.generic(j):
            j = self.angle(j)
        if self.word(j) != ")" or j + 1 >= len(self.t) or self.word(k - 2) in ("if", "while", "switch", "for") or (k > 1 and self.t[k - 2].kind == "word" and self.word(k - 2) not in _KEYWORDS):
            return False
        n = self.t[j + 1]
        return self.word(k)[:1].isupper() and (n.kind in ("text", "number") or (n.kind == "word" and n.text != "instanceof") or n.text in ("(", "!"))


def _units(tokens: Iterator[Token]) -> Iterator[list[Token]]:
    """Tokens up to a semicolon or a closing brace outside of all brackets."""
    unit, depth, pair = [], {"(": 0, "{": 0, "[": 0}, {")": "(", "}": "{", "]": "["}
    for t in tokens:
        unit.append(t)
        if t.kind == "sign":
            if t.text in depth:
                depth[t.text] += 1
            elif t.text in pair:
                depth[pair[t.text]] -= 1
            if t.text in (";", "}") and not any(depth.values()):
                yield unit
                unit = []
    if unit:
        yield unit


def java_numbered(content: str, path: str, size: int = JAVA_TOKENS) -> Iterator[tuple[int, Row]]:
    """Symbols and facts in the order of the file, with their places; declarations are read in pieces of bounded size."""
    units, piece, package, no, least = _units(java_tokens(content)), [], None, 0, size
    ahead = next(units, None)
    while ahead is not None:
        piece, ahead = piece + ahead if piece else ahead, next(units, None)
        while ahead is not None and len(piece) < least:
            piece += ahead
            ahead = next(units, None)
        j = _Java(piece, package, last=ahead is None)
        try:
            rows = j.file()
        except _More:
            least = 2 * len(piece)
            continue
        yield from enumerate(rows, no)
        no, package, piece, least = no + len(rows), j.package, [], size


def java_rows(content: str, path: str) -> list[Row]:
    """Symbols and facts in the order of the file."""
    return [r for _, r in java_numbered(content, path)]


PARSERS: dict[str, Callable[[str, str], list[Row]]] = {"python": python_rows, "java": java_rows}
#: Parsers that give rows with their places one by one, in any order; an error comes before the first row.
NUMBERED: dict[Callable, Callable[[str, str], Iterator[tuple[int, Row]]]] = {python_rows: python_numbered, java_rows: java_numbered}


def parser_for(language: str) -> Callable[[str, str], list[Row]]:
    """The parser of a language; a language that has none is an error."""
    if language not in PARSERS:
        raise ValueError(f"no parser for language: {language}")
    return PARSERS[language]


#: Rows that go back to the JVM at once, and characters of a file that may give rows before all of it is read.
ROWS, LARGE = 10_000, 1 << 15


def parse(files: DataFrame, on_error: str = "fail", parsers: dict[str, Callable[[str, str], list[Row]]] | None = None) -> DataFrame:
    """Rows of PARSED for files (path, language, content); languages without a parser have none.

    on_error: fail stops the run at the first file that doesn't parse, skip leaves such files out.
    """
    known = parsers or PARSERS
    if on_error not in ("fail", "skip"):
        raise ValueError(f"unknown on_error: {on_error}")
    schema = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (c.split() for c in PARSED.split(", "))])

    def numbered(path: str, language: str, content: str) -> Iterator[tuple[int, Row]]:
        f = known[language]
        try:
            if f not in NUMBERED:
                return iter(list(enumerate(f(content, path))))
            if on_error == "skip" and len(content) > LARGE:  # a file that is left out is left out whole
                deque(NUMBERED[f](content, path), 0)
            rows = NUMBERED[f](content, path)
            head = list(islice(rows, ROWS))
        except (SyntaxError, ValueError, RecursionError):
            if on_error == "fail":
                raise
            return iter(())
        return chain(head, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                path, language, content = (b.column(c)[k].as_py() for c in range(3))
                rows = numbered(path, language, content)
                while part := list(islice(rows, ROWS)):
                    cols = list(zip(*[(r.row_type, r.kind, r.name, r.qualified_name, r.parent, r.start_line, r.end_line, n) for n, r in part], strict=True))
                    cols = [[path] * len(part), [language] * len(part), *cols]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return files.where(files.language.isin(*known)).select("path", "language", "content").mapInArrow(run, PARSED)
