"""Statement trees of COBOL procedure divisions: a recursive-descent parser that withholds what it does not know.

`parse` gives a Tree per program: paragraphs of nested statements, and boundaries. A fragment with an unknown character,
an open literal or too many tokens has no statements at all. In a paragraph, the first statement that the grammar does not
cover ends it: complete statements before it stay, the rest is one boundary. Nothing is guessed: a condition must parse
as an expression, blocks need their END, and effects of a store that may fail (ON SIZE ERROR) are unknown, so its writes are
withheld.

Grammar: IF, EVALUATE (WHEN groups; OTHER last and alone), PERFORM of a paragraph [THRU], inline and looping (TIMES, UNTIL,
VARYING without AFTER, TEST BEFORE or AFTER), MOVE, COMPUTE, ADD, SUBTRACT, MULTIPLY, DIVIDE, DISPLAY, CALL, READ, WRITE,
REWRITE, DELETE, START, OPEN, CLOSE with their handlers, EXEC SQL, CONTINUE, GOBACK, STOP RUN, EXIT [PROGRAM, PARAGRAPH,
SECTION, PERFORM [CYCLE]].
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from factloom.functions import cobol
from factloom.functions.cobol import Token

MAX_TOKENS, MAX_DEPTH = 50_000, 64
# Words of the language.
IO = frozenset("READ WRITE REWRITE DELETE START OPEN CLOSE".split())
ARITHMETIC = frozenset("MOVE COMPUTE ADD SUBTRACT MULTIPLY DIVIDE".split())
RELATIONS = {"=": "=", "<>": "<>", "<": "<", ">": ">", "<=": "<=", ">=": ">="}
FIGURATIVE = frozenset("ZERO ZEROS ZEROES SPACE SPACES HIGH-VALUE HIGH-VALUES LOW-VALUE LOW-VALUES QUOTE QUOTES NULL NULLS TRUE FALSE".split())
CLASSES = frozenset("NUMERIC ALPHABETIC POSITIVE NEGATIVE ALPHABETIC-LOWER ALPHABETIC-UPPER".split())
HANDLERS = (("ON", "SIZE", "ERROR"), ("SIZE", "ERROR"), ("AT", "END"), ("INVALID", "KEY"), ("INVALID",), ("ON", "EXCEPTION"), ("ON", "OVERFLOW"))


class Unsupported(Exception):
    """The grammar does not cover this; line is where it was met."""

    def __init__(self, reason: str, line: int) -> None:
        super().__init__(reason)
        self.reason, self.line = reason, line


@dataclass(frozen=True)
class Guard:
    """A branch that must be taken: kind (if, evaluate, handler, loop), its condition, and which of its outcomes."""

    kind: str
    condition: str
    outcome: str
    branch: int = 0
    alternatives: tuple[str, ...] = ()
    prior: tuple[str, ...] = ()


@dataclass
class Statement:
    """blocks: (guard, statements) of nested parts. sure: the writes happen whenever the statement is reached."""

    verb: str
    start: int
    end: int = 0
    text: str = ""
    reads: list[str] = field(default_factory=list)
    writes: list[str] = field(default_factory=list)
    detail: dict[str, str] = field(default_factory=dict)
    blocks: list[tuple[Guard, list[Statement]]] = field(default_factory=list)
    using: list[tuple[str, str]] = field(default_factory=list)
    unknown: bool = False


@dataclass
class Tree:
    program: str = ""
    using: list[str] = field(default_factory=list)
    paragraphs: dict[str, list[Statement]] = field(default_factory=dict)
    sections: dict[str, list[str]] = field(default_factory=dict)
    lines: dict[str, tuple[int, int]] = field(default_factory=dict)
    boundaries: list[tuple[str, int, int, str]] = field(default_factory=list)  # paragraph, first and last line, reason


class _Cursor:
    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead].up if self.at + ahead < len(self.tokens) else ""

    def token(self) -> Token:
        return self.tokens[min(self.at, len(self.tokens) - 1)]

    def take(self, *words: str) -> Token:
        if self.at >= len(self.tokens) or (words and self.peek() not in words):
            raise Unsupported(f"expected {' or '.join(words) or 'more'}", self.token().line if self.tokens else 0)
        self.at += 1
        return self.tokens[self.at - 1]

    def skip(self, *words: str) -> bool:
        if self.peek() in words:
            self.at += 1
            return True
        return False


# expressions


def condition(tokens: list[Token]) -> list[str] | None:
    """Data names that a condition reads, in order; None if it is not in the grammar."""
    cursor, reads = _Cursor(tokens), []
    try:
        _either(cursor, reads, 0)
    except Unsupported:
        return None
    return list(dict.fromkeys(reads)) if tokens and cursor.at == len(tokens) else None


def _either(c: _Cursor, reads: list[str], depth: int) -> None:
    _both(c, reads, depth)
    while c.skip("OR"):
        _both(c, reads, depth)


def _both(c: _Cursor, reads: list[str], depth: int) -> None:
    _test(c, reads, depth)
    while c.skip("AND"):
        _test(c, reads, depth)


def _test(c: _Cursor, reads: list[str], depth: int) -> None:
    if depth > MAX_DEPTH:
        raise Unsupported("nesting", c.token().line)
    if c.skip("NOT"):
        return _test(c, reads, depth + 1)
    if c.peek() == "(":
        mark, known = c.at, len(reads)
        try:  # a group of conditions, or of arithmetic that a relation follows
            c.take("(")
            _either(c, reads, depth + 1)
            c.take(")")
            if c.peek() not in RELATIONS and c.peek() not in ("+", "-", "*", "/", "**", "IS", "EQUAL", "GREATER", "LESS"):
                return None
        except Unsupported:
            pass
        c.at = mark
        del reads[known:]
    _sum(c, reads, depth)
    c.skip("IS")
    c.skip("NOT")
    if c.peek() in RELATIONS:
        c.take()
    elif c.skip("EQUAL"):
        c.skip("TO")
    elif c.skip("GREATER", "LESS"):
        c.skip("THAN")
        if c.skip("OR"):
            c.take("EQUAL")
            c.skip("TO")
    else:
        c.skip(*CLASSES)  # a class test, or a condition name on its own
        return None
    return _sum(c, reads, depth)


def _sum(c: _Cursor, reads: list[str], depth: int) -> None:
    if depth > MAX_DEPTH:
        raise Unsupported("nesting", c.token().line)
    while True:
        c.skip("+", "-")
        _term(c, reads, depth)
        if c.peek() in ("+", "-", "*", "/", "**"):
            c.take()
        elif c.at < len(c.tokens) and c.tokens[c.at].kind == "number" and c.tokens[c.at].value[0] in "+-":
            continue  # a signed number right after a term is an addition
        else:
            return


def _term(c: _Cursor, reads: list[str], depth: int) -> None:
    if c.skip("("):
        _sum(c, reads, depth + 1)
        c.take(")")
        return
    t = c.take()
    if t.kind in ("number", "literal") or t.up in FIGURATIVE:
        return
    if t.kind != "word" or t.up in cobol.NOT_DATA or t.up in cobol.VERBS or t.up in cobol.ENDS:
        raise Unsupported("expected a value", t.line)
    c.at -= 1
    reads.extend(_reference(c))


def _reference(c: _Cursor) -> list[str]:
    """A data reference: name, qualifiers, subscripts and reference modifier; the names it reads, its own first."""
    t = c.take()
    if t.kind != "word" or t.up in cobol.NOT_DATA or t.up in cobol.VERBS or t.up in cobol.ENDS or t.value.isdigit():
        raise Unsupported("expected a data name", t.line)
    name, inner = t.up, []
    while c.peek() in ("OF", "IN"):
        c.take()
        name += " OF " + c.take().up
    while c.peek() == "(":
        depth, first = 0, c.at
        while True:
            x = c.take()
            depth += (x.value == "(") - (x.value == ")")
            if depth == 0:
                break
        inner += [x.up for x in c.tokens[first : c.at] if x.kind == "word" and x.up not in cobol.NOT_DATA and not x.value.isdigit()]
    return [name, *inner]


def reference(text: str) -> list[str] | None:
    """The names that a written data reference reads; None if it is none."""
    c = _Cursor(cobol.lex(text, False))
    try:
        found = _reference(c)
    except Unsupported:
        return None
    return found if c.at == len(c.tokens) else None


# statements


def _targets(c: _Cursor, statement: Statement) -> None:
    """Receivers: they are written, their subscripts read."""
    while c.at < len(c.tokens) and c.tokens[c.at].kind == "word" and c.peek() not in ("ON", "SIZE", "NOT", "REMAINDER", "GIVING") and not _starts(c):
        if c.skip("ROUNDED"):
            statement.detail["rounded"] = "true"
            continue
        name, *inner = _reference(c)
        statement.writes.append(name)
        statement.reads += inner
        c.skip(",")


def _starts(c: _Cursor) -> bool:
    return c.peek() in cobol.VERBS or c.peek() in cobol.ENDS or c.peek() in ("", ".")


def _value(c: _Cursor, statement: Statement) -> None:
    t = c.token()
    if t.kind in ("number", "literal") or t.up in FIGURATIVE:
        c.take()
    elif c.skip("ALL"):
        c.take()
    else:
        statement.reads += _reference(c)


def _arithmetic(c: _Cursor, s: Statement) -> None:
    if s.verb == "COMPUTE":
        _targets(c, s)
        c.take("=", "EQUAL")
        _sum(c, s.reads, 0)
    elif s.verb == "MOVE":
        if c.peek() in ("CORRESPONDING", "CORR"):
            raise Unsupported("MOVE CORRESPONDING", s.start)
        _value(c, s)
        c.take("TO")
        _targets(c, s)
    else:
        link = {"ADD": ("TO", "GIVING"), "SUBTRACT": ("FROM",), "MULTIPLY": ("BY",), "DIVIDE": ("INTO", "BY")}[s.verb]
        while c.peek() not in link:
            _value(c, s)
            c.skip(",")
        word = c.take(*link).up
        first = len(s.writes)
        if word != "GIVING":
            mark = c.at
            try:
                _targets(c, s)
            except Unsupported:
                c.at = mark
            if c.peek() != "GIVING" and len(s.writes) > first:
                s.reads += s.writes[first:]  # the old value takes part
            elif c.at == mark or c.peek() == "GIVING":
                c.at, s.writes = mark, s.writes[:first]
                _value(c, s)
                while c.peek() != "GIVING":
                    _value(c, s)
                c.take("GIVING")
                _targets(c, s)
        else:
            _targets(c, s)
        if c.skip("REMAINDER"):
            _targets(c, s)
    if not s.writes:
        raise Unsupported("no receiver", s.start)


def _handlers(c: _Cursor, s: Statement, depth: int) -> None:
    """Conditional phrases with their statements; END-verb must close them."""
    met = False
    while True:
        negated = c.peek() == "NOT"
        phrase = next((p for p in HANDLERS if all(c.peek(negated + k) == w for k, w in enumerate(p))), None)
        if phrase is None:
            break
        met = True
        c.at += negated + len(phrase)
        name = " ".join(w for w in phrase if w != "ON")
        body = _block(c, depth + 1, {f"END-{s.verb}", "NOT", "AT", "INVALID", "ON", "SIZE"})
        s.blocks.append((Guard("handler", f"{name} of {s.verb} at line {s.start}", "false" if negated else "true"), body))
    if c.skip(f"END-{s.verb}"):
        pass
    elif met and c.peek() not in ("", "."):
        raise Unsupported(f"END-{s.verb} is missing", s.start)
    if met and s.verb in ARITHMETIC and any("SIZE" in g.condition for g, _ in s.blocks):
        s.unknown, s.detail["may_write"], s.writes = True, " ".join(s.writes), []


def _until(c: _Cursor, stop: set[str]) -> list[Token]:
    first = c.at
    while c.at < len(c.tokens) and c.peek() not in stop and c.peek() not in cobol.VERBS and c.peek() != ".":
        c.at += 1
    return c.tokens[first : c.at]


def _text(tokens: list[Token]) -> str:
    return " ".join(t.value for t in tokens)


def _tested(tokens: list[Token], s: Statement) -> str:
    reads = condition(tokens)
    if reads is None:
        raise Unsupported("condition", s.start)
    s.reads += reads
    return _text(tokens)


def _perform(c: _Cursor, s: Statement, depth: int) -> None:
    loop = ("UNTIL", "VARYING", "WITH", "TEST")
    inline = c.peek() in loop or c.peek(1) == "TIMES" or _starts(c)
    if not inline:
        s.detail["target"] = c.take().up
        if c.skip("THRU", "THROUGH"):
            s.detail["thru"] = c.take().up
    if c.peek() not in loop and c.peek(1) == "TIMES":
        _value(c, s)
        c.take("TIMES")
        s.detail["loop"] = "TIMES"
    c.skip("WITH")
    if c.skip("TEST"):
        s.detail["test"] = c.take("BEFORE", "AFTER").up
    if c.skip("VARYING"):
        name, *inner = _reference(c)
        s.detail |= {"loop": "VARYING", "varying": name}
        s.reads += inner
        c.take("FROM")
        _value(c, s)
        c.take("BY")
        _value(c, s)
    if c.skip("UNTIL"):
        s.detail["until"] = _tested(_until(c, {"AFTER", *cobol.ENDS}), s)
        s.detail.setdefault("loop", "UNTIL")
    if c.peek() == "AFTER" or s.detail.get("loop") == "VARYING" and "until" not in s.detail:
        raise Unsupported("PERFORM VARYING form", s.start)
    if inline:
        guard = Guard("loop", s.detail.get("until", s.detail.get("loop", "once")), "true")
        s.blocks.append((guard, _block(c, depth + 1, {"END-PERFORM"})))
        c.take("END-PERFORM")


def _evaluate(c: _Cursor, s: Statement, depth: int) -> None:
    subject = _until(c, {"WHEN"})
    if any(t.up == "ALSO" for t in subject) or not subject:
        raise Unsupported("EVALUATE subject", s.start)
    if _text(subject).upper() not in ("TRUE", "FALSE"):
        probe = _Cursor(subject)
        _sum(probe, s.reads, 0)
        if probe.at != len(subject):
            raise Unsupported("EVALUATE subject", s.start)
    s.detail["subject"] = _text(subject)
    prior: tuple[str, ...] = ()
    branch = 0
    while c.peek() == "WHEN":
        group: list[str] = []
        other = False
        while c.skip("WHEN"):
            tokens = _until(c, {"WHEN", *cobol.ENDS})
            if not tokens:
                raise Unsupported("empty WHEN", s.start)
            other |= tokens[0].up == "OTHER"
            group.append(_text(tokens))
            if tokens[0].up != "OTHER" and (reads := condition(tokens)) is not None:
                s.reads += reads
            elif tokens[0].up != "OTHER" and not any(t.up in ("THRU", "THROUGH") for t in tokens):
                raise Unsupported("WHEN", s.start)
        if other and (len(group) > 1 or c.peek() == "WHEN"):
            raise Unsupported("WHEN OTHER must be last and alone", s.start)
        body = _block(c, depth + 1, {"WHEN", "END-EVALUATE"})
        if other and c.peek() == "WHEN":
            raise Unsupported("WHEN OTHER must be last and alone", s.start)
        s.blocks.append((Guard("evaluate", s.detail["subject"], "other" if other else "true", branch, tuple(group), prior), body))
        prior, branch = prior + tuple(group), branch + 1
    c.take("END-EVALUATE")


def _call(c: _Cursor, s: Statement, depth: int) -> None:
    t = c.take()
    s.detail |= {"target": t.value.strip("\"'").upper(), "dynamic": str(t.kind != "literal").lower()}
    if t.kind != "literal":
        s.reads.append(t.up)
    if c.skip("USING"):
        mode = "reference"
        while c.at < len(c.tokens) and not _starts(c) and c.peek() not in ("ON", "NOT", "RETURNING"):
            if c.skip("BY"):
                mode = c.take("REFERENCE", "CONTENT", "VALUE").up.lower()
            elif c.peek() in ("REFERENCE", "CONTENT", "VALUE"):
                mode = c.take().up.lower()
            elif c.token().kind in ("literal", "number") or c.skip("OMITTED"):
                c.at += c.token().kind in ("literal", "number")
                s.using.append((mode, ""))
            else:
                name, *inner = _reference(c)
                s.using.append((mode, name))
                s.reads += [name, *inner]
            c.skip(",")
    if c.skip("RETURNING"):
        s.writes += _reference(c)[:1]
    _handlers(c, s, depth)


def _sql(c: _Cursor, s: Statement) -> None:
    c.take("SQL")
    first = c.at
    while c.peek() != "END-EXEC":
        c.take()
    code = _text(c.tokens[first : c.at]).replace(": ", ":")
    c.take("END-EXEC")
    s.reads, s.writes, supported = cobol.host_variables(code)
    s.detail["supported"], s.unknown = str(supported).lower(), not supported


def _io(c: _Cursor, s: Statement, depth: int) -> None:
    modes = ("INPUT", "OUTPUT", "I-O", "EXTEND")
    names: list[str] = []
    while c.at < len(c.tokens) and not _starts(c) and not any(all(c.peek((c.peek() == "NOT") + k) == w for k, w in enumerate(p)) for p in HANDLERS):
        if c.peek() in modes:
            s.detail["mode"] = c.take().up
        elif c.skip("INTO"):
            s.writes += _reference(c)[:1]
        elif c.skip("FROM"):
            s.reads += _reference(c)
        elif c.peek() == "KEY":
            c.take()
            c.skip("IS")
            c.skip("NOT")
            for w in ("EQUAL", "GREATER", "LESS", "THAN", "OR", "TO", *RELATIONS):
                c.skip(w)
            s.reads += _reference(c)
        elif c.skip("NEXT", "RECORD", "WITH", "NO", "LOCK", ","):
            pass
        else:
            names.append(c.take().up)
    if not names:
        raise Unsupported(s.verb, s.start)
    s.detail["file"] = " ".join(names)
    _handlers(c, s, depth)


def _statement(c: _Cursor, depth: int) -> Statement:
    if depth > MAX_DEPTH:
        raise Unsupported("nesting", c.token().line)
    first = c.at
    t = c.take()
    s = Statement(t.up, t.line)
    if t.kind != "word" or t.up not in cobol.VERBS:
        raise Unsupported(f"unknown statement {t.up}", t.line)
    if t.up == "IF":
        test = _tested([x for x in _until(c, {"THEN", "ELSE", *cobol.ENDS})], s)
        c.skip("THEN")
        s.detail["condition"] = test
        s.blocks.append((Guard("if", test, "true", 0), _block(c, depth + 1, {"ELSE", "END-IF"})))
        if c.skip("ELSE"):
            s.blocks.append((Guard("if", test, "false", 1), _block(c, depth + 1, {"END-IF"})))
        c.take("END-IF") if c.peek() != "." else None
    elif t.up == "EVALUATE":
        _evaluate(c, s, depth)
    elif t.up == "PERFORM":
        _perform(c, s, depth)
    elif t.up in ARITHMETIC:
        _arithmetic(c, s)
        if t.up != "MOVE":
            _handlers(c, s, depth)
    elif t.up == "CALL":
        _call(c, s, depth)
    elif t.up in IO:
        _io(c, s, depth)
    elif t.up == "DISPLAY":
        while c.at < len(c.tokens) and not _starts(c):
            _value(c, s)
            c.skip(",")
    elif t.up == "EXEC":
        _sql(c, s)
    elif t.up == "STOP":
        c.take("RUN")
    elif t.up == "EXIT":
        s.detail["leaves"] = c.take().up if c.peek() in ("PROGRAM", "PARAGRAPH", "SECTION", "PERFORM") else ""
        if s.detail["leaves"] == "PERFORM" and c.skip("CYCLE"):
            s.detail["leaves"] = "CYCLE"
    elif t.up not in ("CONTINUE", "GOBACK"):
        raise Unsupported(t.up, t.line)
    s.reads, s.writes = list(dict.fromkeys(s.reads)), list(dict.fromkeys(s.writes))
    s.end, s.text = c.tokens[c.at - 1].line, _text(c.tokens[first : c.at])
    return s


def _block(c: _Cursor, depth: int, ends: set[str]) -> list[Statement]:
    out: list[Statement] = []
    while c.peek() not in ends and c.peek() not in ("", "."):
        out.append(_statement(c, depth))
    return out


def parse(text: str, fixed: bool | None = None) -> Tree:
    """The statement tree of one program (its procedure division, or all of a fragment without divisions)."""
    tree = Tree()
    tokens = cobol.lex(text, fixed)
    bad = next((t for t in tokens if t.kind == "bad"), None)
    last = tokens[-1].line if tokens else 0
    if bad or len(tokens) > MAX_TOKENS:
        tree.boundaries.append(("", bad.line if bad else 1, last, "unknown character or open literal" if bad else "too many tokens"))
        return tree
    for i, t in enumerate(tokens):
        if t.up == "PROGRAM-ID" and not tree.program:
            k = i + 1 + (i + 1 < len(tokens) and tokens[i + 1].value == ".")
            tree.program = tokens[k].value.strip("\"'").upper() if k < len(tokens) else ""
    begin = next((i for i, t in enumerate(tokens) if t.up == "PROCEDURE" and i + 1 < len(tokens) and tokens[i + 1].up == "DIVISION"), None)
    if begin is None and any(t.up == "DIVISION" for t in tokens):
        return tree
    if begin is not None:
        end = next((i for i in range(begin, len(tokens)) if tokens[i].value == "."), len(tokens) - 1)
        using = cobol._after(tokens[begin:end], "USING")
        tree.using = cobol._data(tokens[begin + using + 1 : end]) if using > 0 else []
        tokens = tokens[end + 1 :]
    _paragraphs(tokens, tree)
    return tree


def _paragraphs(tokens: list[Token], tree: Tree) -> None:
    c, name, section, broken = _Cursor(tokens), "", "", False

    def opens(k: int) -> bool:
        t = tokens[k]
        after = tokens[k + 1].up if k + 1 < len(tokens) else ""
        return (k == 0 or tokens[k - 1].value == ".") and t.kind == "word" and t.up not in cobol.VERBS and t.up not in cobol.ENDS and after in (".", "SECTION")

    while c.at < len(tokens):
        if opens(c.at):
            t = c.take()
            if c.skip("SECTION"):
                section = t.up
                tree.sections[section] = []
            name, broken = t.up, False
            c.take(".")
            tree.paragraphs.setdefault(name, [])
            tree.lines[name] = (t.line, t.line)
            if section and name != section:
                tree.sections[section].append(name)
            continue
        if c.skip("."):
            continue
        first = c.at
        body = tree.paragraphs.setdefault(name, [])
        try:
            if broken:
                raise Unsupported("", c.token().line)
            body.append(_statement(c, 0))
            tree.lines[name] = (tree.lines.get(name, (body[-1].start, 0))[0], body[-1].end)
        except Unsupported as stop:
            c.at = first
            while c.at < len(tokens) and not (c.at > first and opens(c.at)):
                c.at += 1
            if not broken:
                tree.boundaries.append((name, tokens[first].line, tokens[c.at - 1].line, stop.reason))
            broken = True


def walk(tree: Tree) -> Iterator[tuple[str, Statement, tuple[Guard, ...], int | None]]:
    """(paragraph, statement, guards, number of the enclosing statement) in order; a statement's number is its place."""
    number = 0

    def down(paragraph: str, body: list[Statement], guards: tuple[Guard, ...], parent: int | None):
        nonlocal number
        for s in body:
            own, number = number, number + 1
            yield paragraph, s, guards, parent
            for guard, inner in s.blocks:
                yield from down(paragraph, inner, (*guards, guard), own)

    for paragraph, body in tree.paragraphs.items():
        yield from down(paragraph, body, (), None)


def sentence_terminated(text: str) -> bool:
    """Does the fragment end with a period outside literals and comments?"""
    tokens = cobol.lex(text, False)
    return bool(tokens) and tokens[-1].value == "." and not any(t.kind == "bad" for t in tokens)
