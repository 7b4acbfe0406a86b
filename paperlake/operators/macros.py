"""User macros: definitions read from a document, kept in one table, and expanded by pushing text back onto the input."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from paperlake.functions import lexing

#: Expansions in a row without any of the source being read; a document may have any number of uses.
MOST_EXPANSIONS = 20_000
_NAME = re.compile(r"\\(?:[a-zA-Z@]+|.)", re.S)


class Input:
    """Text under a read head, with a stack of texts below it. Expansions are pushed; a block that reaches beyond its text joins the one below.

    mark: the least that was left to read when a step began. Less than that means that source was read, as expansions lie before it.
    own: whether the text is a part of the document, not made by expansions.
    """

    def __init__(self, text: str, own: bool = False):
        self.text, self.at, self.below = text, 0, []
        self.stored, self.own, self.mark = 0, own, len(text) + 1

    def unread(self) -> int:
        return len(self.text) - self.at + self.stored

    def advanced(self) -> bool:
        """At the begin of a step: whether some of the document's own text was read since the least mark."""
        left = self.unread()
        if left >= self.mark:
            return False
        self.mark = left
        return self.own

    def holds(self, text: str) -> bool:
        """Whether a text taken in this step is no longer than the document's own text that was read for it."""
        return self.own and len(text) <= self.mark - self.unread()

    def push(self, text: str) -> None:
        if self.at < len(self.text):
            self.below.append(self.text[self.at :])
            self.stored += len(self.text) - self.at
        self.text, self.at = text, 0

    def join(self) -> bool:
        if not self.below:
            return False
        top = self.below.pop()
        self.stored -= len(top)
        self.text, self.at = self.text[self.at :] + top, 0
        return True

    def done(self) -> bool:
        while self.at >= len(self.text):
            if not self.below:
                return True
            self.text, self.at = self.below.pop(), 0
            self.stored -= len(self.text)
        return False

    def skip_space(self) -> bool:
        """Whether there was white space."""
        before = self.at
        self.at = lexing.skip_space(self.text, self.at)
        moved = self.at > before
        if self.at >= len(self.text) and self.join():
            return self.skip_space() or moved
        return moved

    def match(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.text, self.at)
        if (m is None or m.end() == len(self.text)) and self.below:
            self.join()
            return self.match(pattern)
        if m:
            self.at = m.end()
        return m

    def block(self, opening: str = "{") -> str | None:
        """Content of the block that follows, if one does."""
        self_at = self.at
        while True:
            here = lexing.skip_space(self.text, self.at)
            if here >= len(self.text):
                if not self.join():
                    return None
                continue
            if self.text[here] != opening:
                return None
            content, end = lexing.block(self.text, self.at, opening, {"{": "}", "[": "]", "(": ")"}[opening])
            if content is not None:
                self.at = end
                return content
            if not self.join():
                self.at = min(self_at, self.at)
                return None

    def arguments(self, spec: str) -> list[str | None]:
        out: list[str | None] = []
        for kind in spec:
            content = self.block(kind)
            if content is None and kind == "{":
                break
            out.append(content)
        return out

    def argument(self) -> str:
        """A block, or a command, or one character."""
        content = self.block()
        if content is not None:
            return content
        self.skip_space()
        m = self.match(_NAME) or self.match(re.compile(r"[^{}]"))
        return m[0] if m else ""


@dataclass
class Macro:
    name: str
    body: str
    n_args: int = 0
    defaults: list[str] = field(default_factory=list)
    params: list[str] | None = None
    math_only: bool = False
    kind: str = "newcommand"
    from_style: bool = False

    def expand(self, source: Input, math: bool = False) -> str:
        """Read the arguments from the input and give the text to read in place of the macro."""
        if self.params is not None:
            args = self.delimited(source)
        else:
            args = []
            for default in self.defaults:
                given = source.block("[")
                args.append(default if given is None else given)
            while len(args) < self.n_args:
                content = source.block()
                args.append(content or "")
        if "\\@ifstar" in self.body:
            starred = lexing.skip_space(self.body, 0)
            at = self.body.index("\\@ifstar", starred) + len("\\@ifstar")
            choices, end = lexing.blocks(self.body, at, most=2)
            if len(choices) == 2:
                star = source.match(re.compile(r"\s*\*")) is not None
                return self.body[: at - len("\\@ifstar")] + choices[0 if star else 1] + self.body[end:]
        return lexing.substitute(self.body, args, math) if args else self.body.replace("##", "#") if "##" in self.body and not self.n_args and self.kind == "def" else self.body

    def delimited(self, source: Input) -> list[str]:
        """Arguments by the parameter text of a \\def: what stands before the next delimiter, or a block or one character."""
        args = []
        for k, part in enumerate(self.params or []):
            if k == 0:
                if part and source.text.startswith(part.strip(), lexing.skip_space(source.text, source.at)):
                    source.at = lexing.skip_space(source.text, source.at) + len(part.strip())
                continue
            if not part.strip():
                args.append(source.argument())
                continue
            end, depth, at = -1, 0, source.at
            while True:
                for m in re.compile(r"\\.|[{}]|" + re.escape(part.strip()), re.S).finditer(source.text, at):
                    if m[0] == part.strip() and not depth:
                        end = m.start()
                        break
                    depth += (m[0] == "{") - (m[0] == "}")
                if end >= 0 or not source.join():
                    break
                depth, at = 0, source.at
            if end < 0:
                args.append("")
                continue
            value = source.text[source.at : end]
            source.at = end + len(part.strip())
            whole = lexing.block(value)
            args.append(whole[0] if whole[0] is not None and not value[whole[1] :].strip() else value)
        return args


def parameters(text: str) -> list[str]:
    """Literal text before #1, between parameters, and after the last."""
    return re.split(r"#\d", text)


#: One atom of math: a braced group, a command without arguments, or a character.
_ATOM = re.compile(r"\{(?:[^{}\\]|\\.|\{(?:[^{}\\]|\\.|\{[^{}]*\})*\})*\}|\\[a-zA-Z@]+|\\.|[^\\{}]", re.S)
#: What takes only the next atom: a script sign, or a command, which may have arguments.
_BINDS = re.compile(r"(?:[_^]|\\[a-zA-Z@]+)\s*\Z")


def wrap_math(expanded: str, before: str, after: str) -> str:
    """An expansion as it can stand between its neighbours in math. TeX reads tokens, so there a macro's result never joins the text around it; in a text that is
    read again it would, and gets braces: where it is more than one atom and what stands before takes only one, and where a letter or digit on either side would
    grow together with its own.
    """
    text = expanded.strip()
    if not text:
        return text
    one = _ATOM.fullmatch(text) is not None
    grows = text[0].isalnum() and before[-1:].isalnum() or text[-1].isalnum() and after[:1].isalnum() and not (one and text[0] == "\\")
    return "{" + text + "}" if grows or not one and _BINDS.search(before) else text
