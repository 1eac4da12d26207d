"""Lexing and fact extraction for COBOL and CL text, one file at a time and without Spark.

A file is normalised (fixed columns 8 to 72 or free form, comments, continuations) into statements' tokens with physical
lines. Every fact carries its line range. What the grammar does not cover is left out, never guessed: a sentence with an
unknown character or an open literal yields no fact but a `boundary`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import ROUND_DOWN, ROUND_HALF_UP, Decimal

TOKENS = re.compile(r"""(?P<literal>"(?:[^"]|"")*"|'(?:[^']|'')*')|(?P<number>[+-]?\d+(?:[.,]\d+)?(?![\w-]))|(?P<word>[A-Za-z0-9#@$](?:[\w#@$-]*[\w#@$])?)|(?P<symbol>\*\*|<=|>=|<>|[=<>+*/(),:.-])|(?P<bad>["'].*|[^\s;])""")
# Words of the language that are verbs, and those that end or structure statements.
VERBS = frozenset("ACCEPT ADD CALL CANCEL CLOSE COMPUTE CONTINUE COPY DELETE DISPLAY DIVIDE EVALUATE EXEC EXIT GO GOBACK IF INITIALIZE INSPECT MERGE MOVE MULTIPLY OPEN PERFORM READ RELEASE RETURN REWRITE SEARCH SET SORT START STOP STRING SUBTRACT UNSTRING WRITE".split())
ENDS = frozenset("ELSE WHEN END-IF END-EVALUATE END-PERFORM END-READ END-CALL END-COMPUTE END-ADD END-SUBTRACT END-MULTIPLY END-DIVIDE END-WRITE END-REWRITE END-DELETE END-START END-SEARCH END-STRING END-UNSTRING END-EXEC".split())
NOT_DATA = frozenset("TO FROM BY INTO GIVING ROUNDED REMAINDER ON SIZE ERROR NOT OF IN AND OR IS EQUAL GREATER LESS THAN ZERO ZEROS ZEROES SPACE SPACES HIGH-VALUE HIGH-VALUES LOW-VALUE LOW-VALUES ALL QUOTE QUOTES NULL NULLS CORRESPONDING CORR FUNCTION LENGTH TRUE FALSE OTHER ALSO THEN NUMERIC ALPHABETIC POSITIVE NEGATIVE USING REFERENCE CONTENT VALUE RETURNING OMITTED UNTIL VARYING TIMES THRU THROUGH WITH TEST BEFORE AFTER AT END INVALID KEY NEXT RECORD SENTENCE".split())


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    line: int

    @property
    def up(self) -> str:
        return self.value.upper()


@dataclass
class Fact:
    """kind: program, section, paragraph, item, copy, call, perform, assign, condition, sql, file, signature, boundary."""

    kind: str
    name: str
    start: int
    end: int
    scope: str = ""
    detail: dict[str, str] = field(default_factory=dict)
    reads: list[str] = field(default_factory=list)
    writes: list[str] = field(default_factory=list)
    guards: list[str] = field(default_factory=list)


def is_fixed(text: str) -> bool:
    """Fixed form if most lines have a sequence area (six digits or blanks) and a usual indicator in column seven."""
    votes = total = 0
    for raw in text.splitlines():
        if raw.strip():
            total += 1
            line = raw.expandtabs(8)
            votes += bool(re.match(r"^(\d{6}|\s{6})[ *\-/dD]", line)) and not line[:7].strip(" 0123456789*/-dD")
    return total > 0 and votes * 2 > total


def code_lines(text: str, fixed: bool | None = None) -> Iterator[tuple[int, str, bool]]:
    """(physical line, code, continues the line before) without comments."""
    fixed = is_fixed(text) if fixed is None else fixed
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.expandtabs(8)
        if fixed:
            mark, code = line[6:7], line[7:72]
            if mark in ("*", "/", "d", "D"):
                continue
            yield number, strip_comment(code), mark == "-"
        elif not line.lstrip().startswith("*"):
            yield number, strip_comment(line), False


def strip_comment(code: str) -> str:
    """Code before *> outside literals."""
    quote = ""
    for i, c in enumerate(code):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif code.startswith("*>", i):
            return code[:i]
    return code


def lex(text: str, fixed: bool | None = None) -> list[Token]:
    """All tokens in order; a literal that is continued on the next line is joined."""
    out: list[Token] = []
    pending, first = "", 0
    for number, code, continues in code_lines(text, fixed):
        if continues and pending:
            code = pending + code.lstrip().lstrip(pending[0])
        elif pending:
            out += _tokens(pending, first)
        pending = ""
        cut = _open_literal(code)
        if cut is not None:
            pending, first, code = code[cut:], number, code[:cut]
        out += _tokens(code, number)
    if pending:
        out += _tokens(pending, first)
    return out


def _open_literal(code: str) -> int | None:
    quote, at = "", 0
    for i, c in enumerate(code):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote, at = c, i
    return at if quote else None


def _tokens(code: str, line: int) -> list[Token]:
    return [Token(m.lastgroup or "", m.group(), line) for m in TOKENS.finditer(code)]


def _data(tokens: list[Token]) -> list[str]:
    """Data names of a fragment, each once, in order; qualifiers (OF, IN) and subscripts are not names of their own."""
    out: list[str] = []
    skip = False
    for i, t in enumerate(tokens):
        if skip:
            skip = False
        elif t.kind == "word" and t.up in ("OF", "IN"):
            skip = True
        elif t.kind == "word" and t.up not in NOT_DATA and not t.value.isdigit() and (i == 0 or tokens[i - 1].up != "FUNCTION"):
            if t.up not in out:
                out.append(t.up)
    return out


def _after(tokens: list[Token], *words: str) -> int:
    return next((i for i, t in enumerate(tokens) if t.up in words and t.kind == "word"), -1)


def assignment(tokens: list[Token]) -> tuple[list[str], list[str], bool] | None:
    """(reads, writes, rounded) of an arithmetic or MOVE statement; None if its form is not covered."""
    verb, rest = tokens[0].up, tokens[1:]
    stop = _after(rest, "ON", "SIZE", "NOT", *(e for e in ENDS if e.startswith("END-")))
    rest = rest[:stop] if stop >= 0 and verb != "MOVE" else rest
    rounded = any(t.up == "ROUNDED" for t in rest)
    giving = _after(rest, "GIVING")
    if verb == "MOVE" and (at := _after(rest, "TO")) > 0:
        return _data(rest[:at]), _data(rest[at + 1 :]), False
    if verb == "COMPUTE" and (at := next((i for i, t in enumerate(rest) if t.value == "=" or t.up == "EQUAL"), -1)) > 0:
        return _data(rest[at + 1 :]), _data(rest[:at]), rounded
    word = {"ADD": "TO", "SUBTRACT": "FROM", "MULTIPLY": "BY", "DIVIDE": "INTO"}.get(verb)
    if not word:
        return None
    if giving >= 0:
        remainder = _after(rest, "REMAINDER")
        return _data(rest[:giving]), _data(rest[giving + 1 :] if remainder < 0 else rest[giving + 1 : remainder] + rest[remainder + 1 :]), rounded
    at = _after(rest, word)
    if at <= 0:
        return None
    targets = _data(rest[at + 1 :])
    return list(dict.fromkeys(_data(rest[:at]) + targets)), targets, rounded


def host_variables(code: str) -> tuple[list[str], list[str], bool]:
    """(reads, writes, supported) of the host variables of one embedded SQL statement."""
    masked = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/", " ", code, flags=re.S)
    kind = (re.match(r"\s*(\w+)", masked) or [None, ""])[1].upper()
    if kind not in ("SELECT", "INSERT", "UPDATE", "DELETE", "FETCH", "OPEN", "CLOSE", "DECLARE", "COMMIT", "ROLLBACK"):
        return [], [], False
    names = lambda s: list(dict.fromkeys(x.upper() for x in re.findall(r":\s*([A-Za-z][\w-]*)", s)))
    into = re.search(r"\bINTO\b(.*?)(?=\bFROM\b|\bWHERE\b|$)", masked, re.S | re.I) if kind in ("SELECT", "FETCH") else None
    if into:
        return names(masked[: into.start()] + " " + masked[into.end() :]), names(into[1]), True
    return names(masked), [], True


def facts(text: str, fixed: bool | None = None) -> list[Fact]:
    """All facts of one program or copybook, in order of their lines."""
    tokens, out = lex(text, fixed), []
    program = paragraph = division = ""
    guards: list[str] = []
    scoped: list[str] = []  # IF, EVALUATE and handlers that are open, innermost last
    statement = ""  # the latest one, whose handlers may follow
    when_at = -1  # where a WHEN ended, so that one right after it belongs to the same group
    i, n = 0, len(tokens)

    def line_start(k: int) -> bool:
        return k == 0 or tokens[k - 1].value == "." or tokens[k - 1].line != tokens[k].line

    def until(k: int) -> int:
        """Where the statement that begins at k ends."""
        e = k + 1
        while e < n and not (tokens[e].value == "." or (tokens[e].kind == "word" and (tokens[e].up in ENDS or (tokens[k].up not in ("IF", "EVALUATE", "SEARCH", "PERFORM") and _phrase(tokens, e)) or (tokens[e].up in VERBS and not (tokens[k].up == "EXEC"))))):
            e += 1
        return e

    while i < n:
        t = tokens[i]
        nxt = tokens[i + 1] if i + 1 < n else None
        if division == "PROCEDURE" and (i == 0 or tokens[i - 1].value == ".") and (bad := _bad_sentence(tokens, i)):
            out.append(Fact("boundary", "unknown character or open literal", t.line, tokens[bad - 1].line, paragraph))
            i = bad
        elif t.value == ".":
            guards, scoped = [], []
            i += 1
        elif nxt and nxt.up == "DIVISION":
            division = t.up
            e = i
            while e < n and tokens[e].value != ".":
                e += 1
            if division == "PROCEDURE" and (u := _after(tokens[i:e], "USING")) > 0:
                out.append(Fact("signature", program, t.line, tokens[e - 1].line, program, {"using": " ".join(_data(tokens[i + u + 1 : e]))}))
            i = e + 1
        elif t.up == "PROGRAM-ID":
            k = i + 1 + (nxt is not None and nxt.value == ".")
            if k < n:
                program, paragraph = tokens[k].value.strip("\"'").upper(), ""
                out.append(Fact("program", program, t.line, tokens[k].line, program))
            i = k + 1
        elif t.up == "COPY" and nxt:
            e = i
            while e < n and tokens[e].value != ".":
                e += 1
            out.append(Fact("copy", nxt.value.strip("\"'").upper(), t.line, tokens[e - 1].line, program, {"replacing": str(any(x.up == "REPLACING" for x in tokens[i:e])).lower()}))
            i = e + 1
        elif division in ("DATA", "") and t.kind == "number" and t.value.isdigit() and line_start(i) and nxt and nxt.kind == "word" and (1 <= int(t.value) <= 49 or int(t.value) in (66, 77, 78, 88)):
            e = i
            while e < n and not (tokens[e].value == "." and (e + 1 == n or tokens[e + 1].line != tokens[e].line)):
                e += 1
            body = tokens[i + 2 : e]
            detail = {"level": str(int(t.value))}
            if (p := _after(body, "PIC", "PICTURE")) >= 0:
                q = p + 1 + (p + 1 < len(body) and body[p + 1].up == "IS")
                stop = next((j for j in range(q, len(body)) if body[j].kind == "word" and body[j].up in ("VALUE", "COMP", "COMP-3", "BINARY", "PACKED-DECIMAL", "USAGE", "OCCURS", "REDEFINES", "DISPLAY", "COMP-5", "SIGN")), len(body))
                detail["pic"] = "".join(x.value for x in body[q:stop])
            for x in body:
                if x.up in ("COMP", "COMP-3", "COMP-5", "BINARY", "PACKED-DECIMAL"):
                    detail["usage"] = x.up
            if (r := _after(body, "REDEFINES")) >= 0 and r + 1 < len(body):
                detail["redefines"] = body[r + 1].up
            out.append(Fact("item", nxt.up, t.line, tokens[min(e, n - 1)].line, program, detail))
            i = e + 1
        elif division == "PROCEDURE" and t.kind == "word" and line_start(i) and nxt and (nxt.value == "." or nxt.up == "SECTION") and t.up not in VERBS and t.up not in ENDS:
            kind = "section" if nxt.up == "SECTION" else "paragraph"
            paragraph = t.up
            out.append(Fact(kind, t.up, t.line, t.line, program))
            i += 2
        elif t.kind == "word" and t.up in ENDS and t.up.startswith("END-"):
            if guards and scoped and scoped[-1].split(" ")[0] == t.up[4:]:
                guards, scoped = guards[:-1], scoped[:-1]
            i += 1
        elif division == "PROCEDURE" and (words := _phrase(tokens, i)) and statement:
            owner = statement
            if t.up == "NOT" and scoped and re.fullmatch(r"[A-Z-]+ \d+", scoped[-1]):  # the other outcome of the open one
                owner = scoped[-1]
                guards, scoped = guards[:-1], scoped[:-1]
            phrase = " ".join(x.up for x in tokens[i : i + words] if x.up not in ("NOT", "ON")) + " of " + owner.replace(" ", " at line ")
            guards, scoped = [*guards, ("not " if t.up == "NOT" else "") + phrase], [*scoped, owner]
            i += words
        elif t.up == "ELSE" and guards:
            while scoped and scoped[-1] != "IF":  # a handler without its END ends with the branch
                guards, scoped = guards[:-1], scoped[:-1]
            guards = [*guards[:-1], "not " + guards[-1]] if guards else guards
            i += 1
        elif t.up == "WHEN" and any(x.startswith("EVALUATE") for x in scoped):
            while not scoped[-1].startswith("EVALUATE"):
                guards, scoped = guards[:-1], scoped[:-1]
            e = until(i)
            value = " ".join(x.value for x in tokens[i + 1 : e])
            guards = [*guards[:-1], guards[-1] + " or " + value if when_at == i else scoped[-1] + " = " + value]
            i = when_at = e
        elif t.kind == "word" and t.up in VERBS and division == "PROCEDURE":
            if t.up == "EXEC":
                e = i
                while e < n and tokens[e].up != "END-EXEC":
                    e += 1
                source = "\n".join(text.splitlines()[t.line - 1 : tokens[min(e, n - 1)].line])
                source = re.sub(r"(?is)^.*?\bEXEC\s+SQL\b|\bEND-EXEC\b.*$", " ", source)
                reads, writes, supported = host_variables(source)
                out.append(Fact("sql", (nxt.up if nxt else ""), t.line, tokens[min(e, n - 1)].line, paragraph, {"supported": str(supported).lower()}, reads, writes, list(guards)))
                i = e + 1
                continue
            e = until(i)
            body = tokens[i:e]
            if t.up not in ("IF", "EVALUATE"):
                statement = f"{t.up} {t.line}"
            own = lambda kind, name, **more: out.append(Fact(kind, name, body[0].line, body[-1].line, paragraph, guards=list(guards), **more))  # noqa: B023, E731
            if t.up == "IF":
                own("condition", "IF", reads=_data(body[1:]))
                guards, scoped = [*guards, " ".join(x.value for x in body[1:] if x.up != "THEN")], [*scoped, "IF"]
            elif t.up == "EVALUATE":
                own("condition", "EVALUATE", reads=_data(body[1:]))
                subject = "EVALUATE " + " ".join(x.value for x in body[1:])
                guards, scoped = [*guards, subject], [*scoped, subject]
            elif t.up == "CALL" and len(body) > 1:
                u = _after(body, "USING")
                dynamic = body[1].kind != "literal"
                own("call", body[1].value.strip("\"'").upper(), detail={"dynamic": str(dynamic).lower(), "using": _parameters(body[u + 1 :]) if u > 0 else ""}, reads=_data(body[u + 1 :]) if u > 0 else [])
            elif t.up == "PERFORM" and len(body) > 1 and body[1].kind == "word" and body[1].up not in ("UNTIL", "VARYING", "WITH"):
                thru = _after(body, "THRU", "THROUGH")
                own("perform", body[1].up, detail={"thru": body[thru + 1].up} if 0 < thru < len(body) - 1 else {})
            elif t.up in ("READ", "WRITE", "REWRITE", "DELETE", "START", "OPEN", "CLOSE") and len(body) > 1:
                names = _data([x for x in body[1:] if x.up not in ("INPUT", "OUTPUT", "I-O", "EXTEND")])
                own("file", names[0] if names else "", detail={"verb": t.up})
            elif found := assignment(body):
                outer = e < n and tokens[e].up == "NOT" and bool(scoped) and re.fullmatch(r"[A-Z-]+ \d+", scoped[-1])  # the other outcome of a handler around it
                may_fail = t.up != "MOVE" and not outer and _phrase(tokens, e) and "SIZE" in (tokens[e].up, tokens[min(e + 1, n - 1)].up, tokens[min(e + 2, n - 1)].up)
                detail = {"rounded": str(found[2]).lower()} | ({"effects": "unknown", "may_write": " ".join(found[1])} if may_fail else {})
                if t.up == "MOVE" and body[1].kind == "literal":
                    detail["literal"] = body[1].value[1:-1]
                own("assign", t.up, detail=detail, reads=found[0], writes=[] if may_fail else found[1])
            i = e
        else:
            i += 1
    own = [f for f in out if f.kind == "item"]
    for place, held in layouts(own).items():
        own[place].detail["layout"] = " ".join(f"{depth}:{pic}:{usage}" for depth, pic, usage in held)
    return out


def _phrase(tokens: list[Token], i: int) -> int:
    """How many words of a conditional phrase (AT END, INVALID KEY, ON SIZE ERROR, ...) stand at i; 0 for none."""
    words = [t.up for t in tokens[i : i + 4]]
    lead = words[:1] == ["NOT"]
    for phrase in (("ON", "SIZE", "ERROR"), ("SIZE", "ERROR"), ("AT", "END"), ("INVALID", "KEY"), ("ON", "EXCEPTION"), ("ON", "OVERFLOW")):
        if tuple(words[lead : lead + len(phrase)]) == phrase:
            return lead + len(phrase)
    return 0


def _bad_sentence(tokens: list[Token], i: int) -> int:
    """Where the sentence at i ends, if it holds what the lexer does not know; 0 otherwise."""
    e = i
    while e < len(tokens) and tokens[e].value != ".":
        e += 1
    return min(e + 1, len(tokens)) if any(t.kind == "bad" for t in tokens[i:e]) else 0


def _parameters(tokens: list[Token]) -> str:
    """USING parameters in order as mode:name; the mode holds until the next one."""
    mode, out = "reference", []
    for t in tokens:
        if t.up in ("REFERENCE", "CONTENT", "VALUE"):
            mode = t.up.lower()
        elif t.kind == "literal":
            out.append(f"{mode}:literal")
        elif t.kind == "word" and t.up not in NOT_DATA:
            out.append(f"{mode}:{t.up}")
    return " ".join(out)


@dataclass(frozen=True)
class Picture:
    digits: int
    scale: int
    signed: bool


def picture(pic: str) -> Picture | None:
    """Digits, scale and sign of a numeric picture of 9, S and V; None for any other."""
    expanded = re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), pic.upper())
    if not re.fullmatch(r"S?9*(V9+)?|S?9+V?", expanded) or "9" not in expanded:
        return None
    whole, _, places = expanded.lstrip("S").partition("V")
    return Picture(len(whole) + len(places), len(places), expanded.startswith("S")) if len(whole) + len(places) <= 31 else None


def store(value: Decimal, into: Picture | None, rounded: bool = False, on_size_error: bool = False, old: Decimal | None = None) -> tuple[str, Decimal | None]:
    """(status, content) of a receiver after a store: stored, truncated, size_error or unsupported."""
    if into is None:
        return "unsupported", None
    kept = value.quantize(Decimal(1).scaleb(-into.scale), ROUND_HALF_UP if rounded else ROUND_DOWN)
    limit = Decimal(10) ** (into.digits - into.scale)
    status = "stored"
    if abs(kept) >= limit:
        if on_size_error:
            return "size_error", old
        status, kept = "truncated", kept % limit
    return status, kept if into.signed else abs(kept)


def compatible(left: list[str], right: list[str]) -> bool:
    """Can both lists of guards hold at once, as far as their text tells?"""
    for a, b in zip(left, right):
        if a == b:
            continue
        if a == "not " + b or b == "not " + a:
            return False
        (subject, _, one), (other, _, two) = a.partition(" = "), b.partition(" = ")
        same = a.startswith("EVALUATE ") and subject == other
        return not same or bool(set(one.split(" or ")) & set(two.split(" or ")))
    return True


def commands(text: str) -> list[Fact]:
    """CL commands: CALL, SBMJOB, OVRDBF, DLTOVR, CHGLIBL and others, with their parameters; + and - continue a line."""
    plain = re.sub(r"/\*.*?\*/", lambda m: "\n" * m.group().count("\n"), text, flags=re.S)
    out, held, first = [], "", 0
    for number, line in enumerate(plain.splitlines(), 1):
        first = first if held else number
        held += line.strip()
        if held.endswith(("+", "-")):
            held = held[:-1].rstrip() + " "
            continue
        m = re.match(r"(?:\w+:\s*)?([A-Z][A-Z0-9]*)\b\s*(.*)", held.strip(), re.I | re.S)
        if m:
            verb, rest = m[1].upper(), m[2]
            named = {k.upper(): v.strip() for k, v in re.findall(r"([A-Za-z]+)\(((?:[^()']|'(?:[^']|'')*'|\((?:[^()]|\([^()]*\))*\))*)\)", rest)}
            target = named.get("PGM") or named.get("FILE") or ""
            if verb == "SBMJOB" and (inner := re.search(r"CALL\s+(?:PGM\()?([\w/*]+)", named.get("CMD", ""), re.I)):
                target = inner[1]
            out.append(Fact("command", target.split("/")[-1].upper(), first, number, "", {"verb": verb, **{k.lower(): v for k, v in named.items()}}))
        held = ""
    return out


def replace(text: str, pairs: list[tuple[str, str]], fixed: bool | None = None) -> str:
    """COPY ... REPLACING: code in which each run of tokens equal to a pair's first text has become its second.

    Pairs are given without their == marks; the first that matches at a place is taken, and what it put there is not
    looked at again. Lines keep their numbers.
    """
    wanted = [([t.up for t in _tokens(old, 0)], new) for old, new in pairs]
    out = []
    last = 0
    for number, code, _ in code_lines(text, fixed):
        out += [""] * (number - last - 1)
        last = number
        found = [(m.start(), m.end(), m.group().upper()) for m in TOKENS.finditer(code)]
        built, at, i = "", 0, 0
        while i < len(found):
            hit = next(((old, new) for old, new in wanted if old and [f[2] for f in found[i : i + len(old)]] == old), None)
            if hit:
                built += code[at : found[i][0]] + hit[1]
                at = found[i + len(hit[0]) - 1][1]
                i += len(hit[0])
            else:
                i += 1
        out.append(built + code[at:])
    return "\n".join(out)


def replacing_pairs(tokens_text: str) -> list[tuple[str, str]]:
    """The pairs of a COPY statement's REPLACING phrase: ==a== BY ==b==, or single words and literals."""
    phrase = re.split(r"\bREPLACING\b", tokens_text, maxsplit=1, flags=re.I)
    if len(phrase) < 2:
        return []
    part = r"==(.*?)==|(\"[^\"]*\"|'[^']*'|[\w-]+)"
    return [(a or b, c or d) for a, b, c, d in re.findall(rf"(?:{part})\s+BY\s+(?:{part})", phrase[1], re.I | re.S)]


def expand_copies(path: str, sources: dict[str, str], max_depth: int = 8, max_lines: int = 200_000) -> tuple[list[tuple[str, int, str, str]], list[tuple[str, str]]]:
    """A program's lines with its copybooks in place: (file, line, code, chain of files), and boundaries (book, reason).

    sources: text by book name in upper case, and by path. Reasons: missing, cycle, depth, lines.
    """
    out: list[tuple[str, int, str, str]] = []
    boundaries: list[tuple[str, str]] = []

    def walk(name: str, text: str, chain: list[str], pairs: list[tuple[str, str]]) -> None:
        fixed = is_fixed(text)
        lines = replace(text, pairs, fixed).split("\n") if pairs else None
        pending, first = "", 0
        for number, code, _ in code_lines(text, fixed):
            code = lines[number - 1] if lines and number <= len(lines) else code
            if not pending and not re.match(r"\s*COPY\s+\S", code, re.I):
                if len(out) >= max_lines:
                    boundaries.append((name, "lines"))
                    return
                out.append((name, number, code, "/".join(chain)))
                continue
            first = first or number
            pending += " " + code
            if "." not in re.sub(r"==.*?==|'[^']*'|\"[^\"]*\"", "", pending):
                continue
            book = re.match(r"\s*COPY\s+[\"']?([\w#@$-]+)", pending, re.I)[1].upper()
            if book in chain:
                boundaries.append((book, "cycle"))
            elif len(chain) > max_depth:
                boundaries.append((book, "depth"))
            elif book not in sources:
                boundaries.append((book, "missing"))
            else:
                walk(book, sources[book], [*chain, book], replacing_pairs(pending))
            pending, first = "", 0

    walk(path, sources[path], [path], [])
    return out, boundaries


def condition_value(expression: str, context: dict[str, bool | str]) -> bool | None:
    """Three-valued value of a conditional-compilation expression of DEFINED, names, = and NOT, AND, OR; None if unknown."""
    form = r"'[^']*'|\"[^\"]*\"|[\w-]+|[()=]"
    words = re.findall(form, expression.upper())
    if re.sub(form, "", expression).strip():
        return None  # something that this grammar does not know
    known = {k.upper(): v for k, v in context.items()}
    at = 0

    def peek() -> str:
        return words[at] if at < len(words) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return words[at - 1]

    def either() -> bool | None:
        value = both()
        while peek() == "OR":
            take()
            other = both()
            value = True if value or other else (None if value is None or other is None else False)
        return value

    def both() -> bool | None:
        value = one()
        while peek() == "AND":
            take()
            other = one()
            value = False if value is False or other is False else (None if value is None or other is None else True)
        return value

    def one() -> bool | None:
        if not peek():
            return None
        word = take()
        if word == "NOT":
            value = one()
            return None if value is None else not value
        if word == "(":
            value = either()
            if peek() == ")":
                take()
            return value
        if peek() == "IS":
            take()
        negated = peek() == "NOT"
        if negated:
            take()
        if peek() == "DEFINED":
            take()
            return (word in known) != negated
        if peek() == "=":
            take()
            right = take().strip("'\"") if peek() else ""
            left = known.get(word)
            return None if left is None else (str(left).upper() == right) != negated
        value = known.get(word)
        return value if isinstance(value, bool) else None

    value = either()
    return value if at == len(words) else None


def regions(items: list[Fact]) -> list[tuple[str, str, str]]:
    """(item, relation, other) of storage: contains by level numbers, aliases by REDEFINES. 66, 77 and 88 stand apart."""
    out, stack = [], []
    for item in items:
        level = int(item.detail.get("level", "0"))
        if level in (66, 77, 78, 88):
            if level == 88 and stack:
                out.append((stack[-1][1], "condition", item.name))
            continue
        while stack and stack[-1][0] >= level:
            stack.pop()
        if stack:
            out.append((stack[-1][1], "contains", item.name))
        if "redefines" in item.detail:
            out.append((item.name, "aliases", item.detail["redefines"]))
        stack.append((level, item.name))
    return out


def layouts(items: list[Fact]) -> dict[int, list[tuple[int, str, str]]]:
    """place of each item -> its storage as (depth below it, picture, usage) of itself and all it holds, in order.

    Levels are compared as depths, so two groups are laid out alike whatever their level numbers. 66, 77 and 88 hold nothing.
    """
    out: dict[int, list[tuple[int, str, str]]] = {}
    stack: list[tuple[int, int]] = []
    for place, item in enumerate(items):
        level = int(item.detail.get("level", "0"))
        if level in (66, 78, 88):
            continue
        level = 1 if level == 77 else level
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, place))
        for depth, (_, at) in enumerate(reversed(stack)):
            out.setdefault(at, []).append((depth, item.detail.get("pic", "").upper(), item.detail.get("usage", "DISPLAY")))
    return out


def overlapping(items: list[Fact], name: str) -> set[str]:
    """Names that may share storage with one: what it holds, what holds it, and the same through REDEFINES.

    Level 66, or a REDEFINES of a name that is not there, has no known place: then every name may overlap."""
    if any(int(i.detail.get("level", "0")) == 66 for i in items) or unbounded(items):
        return {i.name for i in items} - {name}
    up: dict[str, set[str]] = {}
    down: dict[str, set[str]] = {}
    same: dict[str, set[str]] = {}
    for a, relation, b in regions(items):
        if relation == "contains":
            up.setdefault(b, set()).add(a)
            down.setdefault(a, set()).add(b)
        elif relation == "aliases":
            same.setdefault(a, set()).add(b)
            same.setdefault(b, set()).add(a)

    def closed(start: set[str], near: dict[str, set[str]]) -> set[str]:
        found, todo = set(start), list(start)
        while todo:
            for x in near.get(todo.pop(), ()):
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return found

    above = closed({name}, up)
    beside = set().union(*(closed({x}, same) for x in above))  # an alias of a holder covers the name's place
    return (above | closed(beside - above, down) | closed({name}, down) | beside) - {name}


def unbounded(items: list[Fact]) -> set[str]:
    """Items whose place is not known: they redefine a name that is not there or stands twice, or lie below such a one."""
    count: dict[str, int] = {}
    for i in items:
        count[i.name] = count.get(i.name, 0) + 1
    found = {i.name for i in items if "redefines" in i.detail and count.get(i.detail["redefines"], 0) != 1}
    while more := {b for a, relation, b in regions(items) if relation == "contains" and a in found} - found:
        found |= more
    return found


def conditional(text: str, context: dict[str, bool | str], fixed: bool | None = None) -> list[tuple[int, bool | None]]:
    """(line, active) of each code line under >>IF, >>ELSE and >>END-IF: None where a condition is not known. Lines of the
    directives themselves are not active."""
    out: list[tuple[int, bool | None]] = []
    stack: list[tuple[bool | None, bool | None]] = []  # value of the open branch, and of all branches before it
    for number, code, _ in code_lines(text, fixed):
        m = re.match(r"\s*>>\s*(IF|ELSE|END-IF)\b(.*)", code, re.I)
        if not m:
            values = [v for v, _ in stack]
            out.append((number, False if False in values else None if None in values else True))
            continue
        out.append((number, False))
        word = m[1].upper()
        if word == "IF":
            value = condition_value(m[2].strip().rstrip("."), context)
            stack.append((value, value))
        elif stack and word == "ELSE":
            value = stack[-1][1]
            stack[-1] = (None if value is None else not value, True)
        elif stack:
            stack.pop()
    return out


def files_of(text: str, fixed: bool | None = None) -> list[tuple[str, str, str]]:
    """(file, relation, name): assigned to an external name by SELECT, holding a record by FD, a record holding a field."""
    tokens, out = lex(text, fixed), []
    file = record = ""
    inside = False
    for i, t in enumerate(tokens):
        first = i == 0 or tokens[i - 1].value == "." or tokens[i - 1].line != t.line
        word = lambda k: tokens[i + k].value.strip("\"'").upper() if i + k < len(tokens) else ""  # noqa: B023, E731
        if t.up == "SELECT" and first:
            k = 2 if word(1) == "OPTIONAL" else 1
            name, rest = word(k), [x.up for x in tokens[i + k + 1 : i + k + 5]]
            if "ASSIGN" in rest:
                at = rest.index("ASSIGN") + (2 if "TO" in rest else 1)
                out.append((name, "assigned", word(k + 1 + at)))
        elif t.up in ("FD", "SD") and first:
            file, record, inside = word(1), "", True
        elif t.up in ("WORKING-STORAGE", "LINKAGE", "LOCAL-STORAGE", "PROCEDURE") and first:
            inside = False
        elif inside and first and t.kind == "number" and t.value.isdigit() and (1 <= int(t.value) <= 49):
            if int(t.value) == 1:
                record = word(1)
                out.append((file, "record", record))
            else:
                out.append((record, "field", word(1)))
    return out


def dds(text: str) -> list[tuple[str, str, str]]:
    """(record format, relation, name) of a data description: its fields, and the files that PFILE names."""
    out, record = [], ""
    for raw in text.splitlines():
        line = raw.ljust(80)
        if line[5].upper() != "A" or line[6] == "*":
            continue
        if line[16].upper() == "R":
            record = line[18:28].strip().upper()
            out.append(("", "format", record))
        elif line[18:28].strip() and record:
            out.append((record, "field", line[18:28].strip().upper()))
        for name in re.findall(r"PFILE\(([^)]*)\)", line[44:80], re.I):
            out += [(record, "based_on", x.split("/")[-1].upper()) for x in name.split()]
    return out


def bind(reference: str, items: list[Fact]) -> tuple[str, list[int]]:
    """A name with OF / IN qualifiers against an item tree: (bound, ambiguous or unresolved, places of the items).

    Qualifiers must be names of groups that hold the item, in order outwards, not all of them.
    """
    name, *qualifiers = [w for w in re.split(r"\s+(?:OF|IN)\s+", reference.strip().upper())]
    stack: list[tuple[int, str]] = []
    found = []
    for place, item in enumerate(items):
        level = int(item.detail.get("level", "0"))
        while stack and level not in (66, 88) and stack[-1][0] >= (1 if level == 77 else level):
            stack.pop()
        if item.name == name:
            groups = iter(g for _, g in reversed(stack))
            if all(q in groups for q in qualifiers):
                found.append(place)
        if level not in (66, 77, 88):
            stack.append((level, item.name))
    return ("unresolved" if not found else "bound" if len(found) == 1 else "ambiguous"), found


def mask_sql(code: str) -> tuple[str, bool]:
    """The text with literals and comments blanked, at the same offsets, and whether all of them were closed."""
    out, i, closed = list(code), 0, True
    while i < len(code):
        if code[i] in "'\"":
            end = i + 1
            while end < len(code) and not (code[end] == code[i] and code[end : end + 2] != code[i] * 2):
                end += 2 if code[end : end + 2] == code[i] * 2 else 1
            closed &= end < len(code)
            end = min(end + 1, len(code))
        elif code.startswith("--", i):
            end = code.find("\n", i)
            end = len(code) if end < 0 else end
        elif code.startswith("/*", i):
            end = code.find("*/", i + 2)
            closed &= end >= 0
            end = len(code) if end < 0 else end + 2
        else:
            i += 1
            continue
        out[i:end] = [c if c == "\n" else " " for c in code[i:end]]
        i = end
    return "".join(out), closed
