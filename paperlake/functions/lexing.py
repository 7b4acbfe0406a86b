"""Helpers on one LaTeX string: escapes, balanced blocks, arguments, comments and white space. All run in linear time."""

from __future__ import annotations

import re

_COMMENT = re.compile(r"((?<!\\)(?:\\\\)*)%.*")
_HASH = re.compile(r"(\\?)(#+)([1-9])")
_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def escaped(text: str, at: int) -> bool:
    """Whether an odd number of backslashes stands before a place."""
    n = 0
    while n < at and text[at - 1 - n] == "\\":
        n += 1
    return n % 2 == 1


def strip_comments(text: str) -> str:
    """Without comments and trailing blanks; the line structure stays, the last line break goes."""
    return "\n".join(_COMMENT.sub(r"\1", line, count=1).rstrip() for line in text.splitlines())


def skip_space(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def balanced(text: str, at: int = 0, opening: str = "{", closing: str = "}") -> tuple[int, int] | None:
    """Start and end (exclusive) of the delimited block that begins at a place, after white space; escaped delimiters don't count."""
    at = skip_space(text, at)
    if not text.startswith(opening, at):
        return None
    depth = 0
    for m in re.compile(rf"\\.|{re.escape(opening)}|{re.escape(closing)}", re.S).finditer(text, at):
        if m[0] == opening and (opening != closing or not depth):
            depth += 1
        elif m[0] == closing:
            depth -= 1
            if not depth:
                return at, m.end()
    return None


def bracketed(text: str, at: int = 0) -> tuple[int, int] | None:
    """An optional argument: like balanced with [ ], but brackets inside braces don't count."""
    at = skip_space(text, at)
    if not text.startswith("[", at):
        return None
    depth = braces = 0
    for m in re.compile(r"\\.|[\[\]{}]", re.S).finditer(text, at):
        c = m[0]
        if c == "{":
            braces += 1
        elif c == "}":
            braces -= 1
            if braces < 0:
                return None
        elif c == "[" and not braces:
            depth += 1
        elif c == "]" and not braces:
            depth -= 1
            if not depth:
                return at, m.end()
    return None


def block(text: str, at: int = 0, opening: str = "{", closing: str = "}") -> tuple[str | None, int]:
    """Content of the delimited block at a place and the place after it, or (None, at)."""
    found = bracketed(text, at) if opening == "[" else balanced(text, at, opening, closing)
    return (text[found[0] + 1 : found[1] - 1], found[1]) if found else (None, at)


def blocks(text: str, at: int = 0, opening: str = "{", closing: str = "}", most: int | None = None) -> tuple[list[str], int]:
    """Contents of the delimited blocks that follow one another, and the place after them."""
    out: list[str] = []
    while most is None or len(out) < most:
        content, end = block(text, at, opening, closing)
        if content is None:
            break
        out.append(content)
        at = end
    return out, at


def arguments(text: str, spec: str, at: int = 0) -> tuple[list[str | None], int]:
    """Arguments by a spec of '{' (required) and '[' (optional; missing is None). Stops at a missing required one."""
    out: list[str | None] = []
    for kind in spec:
        content, end = block(text, at, kind, "]" if kind == "[" else "}")
        if content is None and kind == "{":
            break
        out.append(content)
        at = end if content is not None else at
    return out, at


def environment(text: str, name: str, at: int = 0) -> tuple[int, int, str] | None:
    """Start, end and stripped content of the next begin/end block of a name, nesting of the same name included."""
    n = re.escape(name)
    depth, start, inner = 0, 0, 0
    for m in re.compile(rf"\\(begin|end)\s*\{{{n}\}}").finditer(text, at):
        if escaped(text, m.start()):
            continue
        if m[1] == "begin":
            if not depth:
                start, inner = m.start(), m.end()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                return start, m.end(), text[inner : m.start()].strip()
    return None


_PAIR = re.compile(r"\\(end)?([a-zA-Z]+)(\*?)(?![a-zA-Z])")


def pairs_as_environments(text: str) -> str:
    r"""Environments written as \name … \endname, nested ones too, written as \begin{name} … \end{name}. One pass: an opening counts only if its end follows."""
    if "\\end" not in text:
        return text
    found = [m for m in _PAIR.finditer(text) if not escaped(text, m.start())]
    ends = {m[2] for m in found if m[1]} - {"csname"}
    open_: dict[str, list[re.Match]] = {}
    put: dict[int, tuple[int, str]] = {}
    for m in found:
        if m[1] and open_.get(m[2]):
            begin = open_[m[2]].pop()
            put[begin.start()], put[m.start()] = (begin.end(), f"\\begin{{{m[2]}}}"), (m.end(), f"\\end{{{m[2]}}}")
        elif not m[1] and m[2] in ends:
            open_.setdefault(m[2], []).append(m)
    out, at = [], 0
    for start in sorted(put):
        out += [text[at:start], put[start][1]]
        at = put[start][0]
    return "".join(out) + text[at:]


def nested(text: str, opening: str, closing: str, at: int = 0) -> tuple[int, int, str] | None:
    """Start, end and content of the next block between two patterns, nested ones of the same patterns inside it."""
    depth, start, inner = 0, 0, 0
    for m in re.compile(f"(?P<open__>{opening})|(?P<close__>{closing})", re.S).finditer(text, at):
        if m["open__"] is not None:
            if not depth:
                start, inner = m.start(), m.end()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                return start, m.end(), text[inner : m.start()]
    return None


def substitute_patterns(text: str, table: list[tuple[str, object]]) -> str:
    """Each pattern's matches replaced, by a text or a function of the match; where several match at one place, the first of the table does."""
    if not table:
        return text
    patterns = [re.compile(p, re.S) for p, _ in table]
    out, at = [], 0
    while (best := min(((m.start(), k, m) for k, p in enumerate(patterns) if (m := p.search(text, at)) and m.end() > m.start()), key=lambda x: x[:2], default=None)) is not None:
        start, k, m = best
        out += [text[at:start], table[k][1](m) if callable(table[k][1]) else m.expand(table[k][1])]
        at = m.end()
    return "".join(out) + text[at:]


def is_balanced(text: str, opening: str = "{", closing: str = "}") -> bool:
    depth = 0
    for m in re.finditer(rf"\\.|{re.escape(opening)}|{re.escape(closing)}", text, re.S):
        depth += (m[0] == opening) - (m[0] == closing)
        if depth < 0:
            return False
    return depth == 0


def normalize_space(text: str) -> str:
    """Blank lines become one line break, single line breaks and runs of blanks one blank; trimmed."""
    text = re.sub(r"[^\S\n]+", " ", text)
    text = re.sub(r" ?\n ?", "\n", text)
    text = re.sub(r"\n{2,}", "\0", text)
    return text.replace("\n", " ").replace("\0", "\n").strip()


def one_line(text: str) -> str:
    """Line breaks of either kind and runs of blanks become one blank."""
    return re.sub(r"\s+", " ", re.sub(r"\\\\(?:\[[^\]]*\])?|\\newline(?![a-zA-Z])", " ", text)).strip()


def has_parameters(text: str) -> bool:
    return bool(re.search(r"(?<!\\)#\d", text))


def substitute(definition: str, args: list[str | None], math: bool = False) -> str:
    r"""Put arguments for #n. Of nested definitions only the outermost level (fewest #) is filled, others lose one level's worth; \# is literal.

    In math an argument is braced where a letter stands beside it: without its parameter's mark between them, the two would be read as one word.
    """
    levels = [len(m[2]) for m in _HASH.finditer(definition) if not (m[1] and len(m[2]) == 1)]
    if not levels:
        return definition
    least = min(n - bool(m[1]) for m in _HASH.finditer(definition) if (n := len(m[2])) > bool(m[1]))

    def put(m: re.Match) -> str:
        escape, marks, k = m[1], m[2], int(m[3])
        own = len(marks) - bool(escape)
        if own != least or k > len(args):
            return m[0]
        value = args[k - 1] or ""
        if math and value and (definition[m.start() - 1 : m.start()].isalpha() or definition[m.end() : m.end() + 1].isalpha()):
            value = "{" + value + "}"
        return ("\\#" if escape else "") + value

    return _HASH.sub(put, definition)


def roman(n: int) -> str:
    out = ""
    for value, letters in _ROMAN:
        while n >= value:
            out += letters
            n -= value
    return out


_KEPT = re.compile(r"\\(?:use[a-zA-Z]+|RequirePackage|(?:re)?newcommand|providecommand|DeclareMathOperator|DeclareRobustCommand|[egx]?def|let|newtheorem|(?:re)?newenvironment|newif|definecolor|DeclarePairedDelimiter)(?![a-zA-Z])")


def preamble(text: str) -> str:
    """Of what stands between the class and the document: packages, blocks between \\makeatletter and \\makeatother, and definitions, a line each."""
    text = strip_comments(text)
    m = re.search(r"\\documentclass\s*(?:\[[^\]]*\]\s*)?\{[^{}]*\}", text)
    text = text[m.end() :] if m else text
    text = text.split("\\begin{document}")[0]
    out, at = [], 0
    whole = re.compile(r"\\makeatletter.*?\\makeatother|" + _KEPT.pattern, re.S)
    while m := whole.search(text, at):
        at = m.end()
        if not m[0].startswith("\\makeatletter"):
            line_end = text.find("\n", at)
            at = len(text) if line_end < 0 else line_end
            while not is_balanced(text[m.start() : at]) and at < len(text):
                nxt = text.find("\n", at + 1)
                at = len(text) if nxt < 0 else nxt
        out.append(text[m.start() : at].strip())
    return "\n".join(out)


def comment_on_line(text: str, at: int) -> bool:
    """Whether an unescaped comment sign stands before a place on its line."""
    start = text.rfind("\n", 0, at) + 1
    return any(text[k] == "%" and not escaped(text, k) for k in range(start, at))
