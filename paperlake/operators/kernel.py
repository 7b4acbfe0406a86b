"""The per-document kernel: LaTeX text to a tree of tokens in one left-to-right pass.

Macros are state that depends on order within a document, so a document is the unit of work; everything that depends only on the order of tokens
(numbers, hierarchy, merging) is left to DataFrame operations on the rows that ``tokens`` makes of the tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from paperlake.functions import lexing, symbols

from . import bibliography, tables
from .catalogue import (
    BOXES, CITES, CONDITIONS, DEFINING, DIAGRAMS, DIMENSIONED, DROP, ENVIRONMENT_ARGS, ENVIRONMENTS, EQUATIONS, FONT_SWITCHES, INTEGERS, NUMBERED_THEOREMS, PROTECTED, REFS, SIZE_SWITCHES, SKIPPED, SPACES, STYLES, TABLES, THEOREMS, TOKEN_TYPES, VERBATIM,
)
from .macros import MOST_EXPANSIONS, Input, Macro, parameters, wrap_math

Token = dict
#: Words with single blanks between them: a sentence is one step.
_PLAIN = re.compile(r"[^\\${}%~\s]++(?: [^\\${}%~\s]++)*+")
_SPACE = re.compile(r"\s+")
_BLANKS = (" ", "\t", "\n", "\r")  # white space by code point (\u00a0) is text: a blank after it stays
_COMMAND = re.compile(r"\\(?:([a-zA-Z]+|@[a-zA-Z@]+)|(.))", re.S)
_CODE_POINT = re.compile(r"\\u(?=[a-fA-F]{0,3}\d)(0?[0-9a-fA-F]{4}(?![0-9a-fA-F])|10[0-9a-fA-F]{4}|[0-9a-fA-F]{4})")
_LETTERED = re.compile(r"\\([a-zA-Z@]+)")
_DIMENSION = re.compile(r"\s*=?\s*(?:by\s*)?-?\s*(?:[\d.,]*\\[a-zA-Z@]+|[\d.,]*\s*(?:true)?\s*(?:pt|em|ex|cm|mm|in|bp|pc|dd|cc|sp|mu|fil+)?(?![a-zA-Z]))(?:\s*(?:plus|minus)\s*-?[\d.]+\s*(?:pt|em|ex|cm|mm|in|fil+)?)*[ \t]?")
_INTEGER = re.compile(r"\s*=?\s*(?:(?:[-+]\s*)*(?:\d+|\\[a-zA-Z@]+))?[ \t]*")
_ASSIGNED = re.compile(r"\s*=\s*-?(?:[\d.]+\s*(?:pt|em|ex|cm|mm|in)?(?![a-zA-Z])|\\[a-zA-Z@]+)")
_FACTOR = re.compile(r"-?\d*\.?\d+\Z")
_COND = re.compile(r"\\(if[a-zA-Z@]*|elseif|elsif|else|or|fi)(?![a-zA-Z@])")
_BEGIN = re.compile(r"\\(begin|end)\s*\{([^{}]*)\}|\\item(?![a-zA-Z])")
_LABEL = re.compile(r"\\label\s*\{([^{}]*)\}\s*")
_MATH_COMMAND = re.compile(r"\\(?:([a-zA-Z@]+)|.)", re.S)
_AND = re.compile(r"\\and(?![a-zA-Z])", re.I)
_KEY = re.compile(r"\s*([^=,]+?)\s*(?:=\s*(\{(?:[^{}]|\{[^{}]*\})*\}|[^,]*))?\s*(?:,|$)")


#: What preprocessing leaves as it stands.
_VERBATIM_BLOCK = re.compile(r"\\begin\s*\{(verbatim|Verbatim|lstlisting|algorithm|algorithmic|picture|tikzpicture|pgfpicture)\}.*?\\end\s*\{\1\}|\\verb\*?([^a-zA-Z\s*]).*?\2", re.S)
_QUOTED = re.compile(r"``(.*?)''|`(.*?)'", re.S)
_FORMULA = re.compile(r"\$\$(?:[^$\\]|\\.)*\$\$|\$(?:[^$\\]|\\.)*\$", re.S)
_FORMULA_ENVIRONMENT = re.compile(r"\\\[.*?\\\]|\\\(.*?\\\)|\\begin\s*\{((?:%s)\*?)\}.*?\\end\s*\{\1\}" % "|".join(sorted(EQUATIONS)), re.S)
_NEXT_MARK = re.compile(r"[\\`$]")
#: Layout that means something to the parser after it.
KEPT_LAYOUT = frozenset("maketitle documentclass usepackage RequirePackage par protect newblock endcsname expandafter noexpand appendix nonumber notag hline toprule midrule bottomrule cline value arabic roman Roman alph Alph fnsymbol limits nolimits string the".split())


class Problem(ValueError):
    pass


class Parser:
    """State of one document. files: texts by path, for styles and bibliographies."""

    def __init__(self, files: dict[str, str] | None = None, expand_styles: bool = False):
        self.files, self.expand_styles = files or {}, expand_styles
        self.macros: dict[str, Macro] = {}
        self.environments: dict[str, Macro] = {}
        self.titles: dict[str, str] = {}
        self.reference_names: dict[str, tuple[str, str]] = {}
        self.ifs: set[str] = set()
        self.colors: dict[str, dict[str, str]] = {}
        self.aliases: dict[str, str] = {}
        self.boxes: dict[str, str] = {}
        self.keys: dict[tuple[str, str], str] = {}
        self.current: Token | None = None
        self.errors: list[tuple[str, str]] = []
        self.read_styles: set[str] = set()
        self.expansions = 0
        self.reading: Input | None = None
        self.first_read: set[str] = set()
        self.problem: Exception | None = None
        self.tokens: list[Token] = []
        self.depth = 0
        self.preprocessed = False

    # -- entry points -------------------------------------------------------------------------------------------

    def document(self, text: str, preprocess: bool = False) -> list[Token]:
        text = lexing.strip_comments(text)
        self.preprocessed = preprocess
        if preprocess:
            text = self.preprocess(text)
        return self.parse(text)

    def preprocess(self, text: str) -> str:
        """What is done to files only: everything before the class is cut, local styles are read, TeX quotes become plain."""
        m = re.search(r"\\documentclass\s*(?:\[[^\]]*\]\s*)?\{([^{}]*)\}", text)
        if m:
            self.style(m[1].strip() + ".cls")
            text = text[m.end() :]
        for m in re.finditer(r"\\(?:usepackage|RequirePackage)\s*(?:\[[^\]]*\]\s*)?\{([^{}]*)\}", text):
            for name in m[1].split(","):
                self.style(name.strip() + ".sty")
        return self.expand_text(text)

    def expand_text(self, text: str) -> str:
        """Definitions without parameters are taken out and their uses replaced, quotes become plain, conditionals their chosen branch, layout goes, white space takes its normal form;
        formulas, definitions with parameters, verbatim text, algorithms and pictures stay as they are. Conditions on classes and packages (with @) leave nothing."""
        source, out, held = Input(text), [], []

        def keep(piece: str) -> None:
            out.append(f"\0{len(held)}\0")
            held.append(piece)

        while not source.done():
            if m := _VERBATIM_BLOCK.match(source.text, source.at):
                source.at = m.end()
                keep(m[0])
                continue
            if m := source.match(_QUOTED) if source.text[source.at] == "`" else None:
                mark = '"' if m[1] is not None else "'"
                source.push(f"{mark}{m[1] if m[1] is not None else m[2]}{mark}")
                continue
            if source.text[source.at] != "\\" and (m := _FORMULA.match(source.text, source.at)) or (m := _FORMULA_ENVIRONMENT.match(source.text, source.at)):
                source.at = m.end()
                keep(m[0])
                continue
            m = re.compile(r"\\([a-zA-Z@]+)").match(source.text, source.at)
            if not m:
                end = _NEXT_MARK.search(source.text, source.at + 1 + (source.text[source.at] == "\\"))
                stop = end.start() if end else len(source.text)
                out.append(source.text[source.at : stop])
                source.at = stop
                continue
            name, start, below = m[1], source.at, len(source.below)
            source.at = m.end()
            if name == "addto":
                source.match(re.compile(r"\s*\{?\s*\\[a-zA-Z@]+\s*\}?"))
            elif name in DEFINITIONS:
                before, environments = dict(self.macros), dict(self.environments)
                DEFINITIONS[name](self, source, name)
                made = [x for k, x in self.macros.items() if before.get(k) is not x] + [x for k, x in self.environments.items() if environments.get(k) is not x]
                if name == "define@key" or any(x.n_args or x.params or x.kind == "environment" or lexing.has_parameters(x.body) for x in made):
                    for x in made:  # to be expanded when its arguments are known
                        self.macros.pop(x.name, None) if x.kind != "environment" else self.environments.pop(x.name, None)
                    keep(source.text[start : source.at] if len(source.below) == below else m[0])
            elif (macro := self.macros.get(name)) is not None and not macro.math_only:
                self.count()
                source.push(macro.expand(source))
            elif (name in CONDITIONS or name in self.ifs) and self.conditional(source, name):
                continue
            elif name in ("@ifclassloaded", "@ifpackageloaded", "@ifundefined"):
                source.arguments("{{{")
            elif name in DROP and name not in KEPT_LAYOUT:
                star(source)
                source.arguments(DROP[name])
            else:
                out.append(m[0])
        text = re.sub(r"[^\S\n]+", " ", "".join(out))
        return re.sub(r"\0(\d+)\0", lambda m: held[int(m[1])], text)

    def style(self, path: str) -> None:
        """Definitions of a local style or class file; their bodies are erased unless expand_styles."""
        if path in self.read_styles or path not in self.files:
            return
        self.read_styles.add(path)
        text = lexing.strip_comments(self.files[path])
        for m in re.finditer(r"\\(?:usepackage|RequirePackage|LoadClass|input)\s*(?:\[[^\]]*\]\s*)?\{([^{}]*)\}", text):
            for name in m[1].split(","):
                for end in (".sty", ".cls", ".tex", ""):
                    self.style(name.strip() + end)
        known = set(self.macros)
        source = Input(text)
        while (m := re.compile(r"\\([a-zA-Z@]+)").search(source.text, source.at)) is not None or source.join():
            if m is None:
                continue
            source.at = m.end()
            if m[1].lower() == "atbegindocument":
                source.push(source.block() or "")
            elif m[1] in DEFINITIONS:
                DEFINITIONS[m[1]](self, source, m[1])
            elif m[1] == "IfFileExists":
                parts = [*source.arguments("{{{"), "", "", ""]
                source.push((parts[1] if (parts[0] or "").strip() in self.files else parts[2]) or "")
            elif m[1] in ("@ifclassloaded", "@ifpackageloaded", "@ifundefined"):
                source.arguments("{{{")
            elif m[1] in CONDITIONS or m[1] in self.ifs:
                self.conditional(source, m[1])
        for name in set(self.macros) - known:
            self.macros[name].from_style = True
            if not self.expand_styles:
                self.macros[name].body = ""

    # -- main loop ----------------------------------------------------------------------------------------------

    def parse(self, text: str, line_break: str = "\n") -> list[Token]:
        """Tokens of a text. At a problem all open levels end, so that the tokens read before it are in ``tokens``; then the outermost raises it."""
        if self.depth > 150:
            raise Problem("nesting is too deep")
        self.depth += 1
        out: list[Token] = []
        source, frame, outer = self.input(text), Frame(line_break), self.reading
        try:
            while not self.problem and not source.done():
                c = source.text[source.at]
                if c in "\\{$":
                    self.step(source)
                if c.isspace():
                    m = source.match(_SPACE)
                    frame.space = frame.space or ("\n" if m[0].count("\n") > 1 else " ")
                elif c == "\\":
                    self.command(source, out, frame)
                elif c == "{":
                    content = source.block()
                    if content is None:
                        source.at += 1
                        self.put_text(out, "{", frame)
                    else:
                        inner = self.parse(content, line_break)
                        for t in inner:
                            self.put(out, t, frame)
                elif c == "$":
                    self.dollar(source, out, frame)
                elif c == "}":
                    source.at += 1
                elif c == "%":
                    end = source.text.find("\n", source.at)
                    source.at = len(source.text) if end < 0 else end
                elif c == "~":
                    source.at += 1
                    frame.space = frame.space or " "
                else:
                    m = _PLAIN.match(source.text, source.at)
                    source.at = m.end()
                    self.put_text(out, m[0], frame)
        except (ValueError, RecursionError) as e:
            self.problem = self.problem or e
        finally:
            self.depth -= 1
            self.reading = outer
        for t in reversed(out):
            if t["type"] == "text" and isinstance(t["content"], str):
                t["content"] = t["content"].rstrip(" ") if line_break == "\n" else t["content"].rstrip()
            break
        out = [t for t in out if not (t["type"] == "text" and t["content"] == "")]
        if self.problem and not self.depth:
            self.tokens, problem, self.problem = out, self.problem, None
            raise problem
        return out

    def put_text(self, out: list[Token], text: str, frame: Frame) -> None:
        space, frame.space = frame.space, ""
        last = out[-1] if out else None
        if space and (last is None or not inline(last) or (last["type"] == "text" and last["content"].endswith(_BLANKS))):
            space = ""
        styles = frame.styles()
        if last is not None and last["type"] == "text" and last.get("styles") == styles and (styles is None or not last.get("closed")):
            last["content"] += space + text
            return
        t: Token = {"type": "text", "content": space + text}
        if styles is not None:
            t["styles"] = styles
        out.append(t)

    def put(self, out: list[Token], token: Token | None, frame: Frame) -> None:
        """Append a token with the styles in force; empty groups, environments and lists are left out."""
        if token is None or (token["type"] in ("group", "environment", "list") and not token["content"]):
            return
        if token["type"] == "text":
            own = token.get("styles")
            if own is None and frame.styles() is None:
                self.put_text(out, token["content"], frame)
                return
            merged = frame.styles() or []
            token["styles"] = [*merged, *[s for s in own or [] if s not in merged]]
            if frame.space and out and out[-1]["type"] != "text":
                token["content"] = frame.space + token["content"]
            elif frame.space and out and out[-1]["type"] == "text" and not out[-1]["content"][-1:].isspace():
                out[-1]["content"] += frame.space
        elif frame.space and out and out[-1]["type"] == "text" and not out[-1]["content"][-1:].isspace() and inline(token):
            out[-1]["content"] += frame.space
        if out and out[-1]["type"] == "text" and not inline(token):
            out[-1]["content"] = out[-1]["content"].rstrip()
        frame.space = ""
        out.append(token)

    # -- math ---------------------------------------------------------------------------------------------------

    def dollar(self, source: Input, out: list[Token], frame: Frame) -> None:
        text, at = source.text, source.at
        double = text.startswith("$$", at)
        mark = "$$" if double else "$"
        depth, k, end = 0, at + len(mark), -1
        while True:
            for m in re.compile(r"\\.|[{}]|" + re.escape(mark), re.S).finditer(source.text, k):
                if m[0] == mark and depth <= 0:
                    end = m.start()
                    break
                depth += (m[0] == "{") - (m[0] == "}")
            if end >= 0 or not source.join():
                break
            depth, at, k = 0, source.at, source.at + len(mark)
        if end < 0:
            source.at += len(mark)
            self.put_text(out, mark, frame)
            return
        content = source.text[source.at + len(mark) : end]
        source.at = end + len(mark)
        self.put(out, self.equation(content, display=double), frame)

    def equation(self, content: str, display: bool, numbered: bool = False, align: bool = False) -> Token | None:
        found = [k.strip() for k in _LABEL.findall(content)]
        content, placeholders = self.math(_LABEL.sub("", lexing.pairs_as_environments(content)))
        if not content.strip():
            return None
        t: Token = {"type": "equation", "content": content.strip()}
        if display:
            t["display"] = "block"
        if numbered:
            t["numbered"] = True
        if align:
            t["align"] = True
        if found:
            t["labels"] = found
        if placeholders:
            t["placeholders"] = placeholders
        return t

    def math(self, text: str) -> tuple[str, dict[str, list[Token]]]:
        """Macros expanded, formatting dropped, content commands replaced by placeholders."""
        if "\\" not in text:
            return text, {}
        source, out, held, outer = self.input(text), [], {}, self.reading
        while not source.done():
            self.step(source)
            m = _MATH_COMMAND.search(source.text, source.at)
            if not m:
                out.append(source.text[source.at :])
                source.at = len(source.text)
                continue
            out.append(source.text[source.at : m.start()])
            source.at = m.end()
            name = m[1]
            if name is None:
                out.append(m[0])
                continue
            macro = self.macros.get(name) or self.macros.get(name.rstrip("@"))
            if macro:
                self.count()
                before = next((x for x in reversed(out) if x), "")
                expanded = macro.expand(source, True)
                source.push(wrap_math(expanded, before, source.text[source.at : source.at + 1]) if not macro.params else expanded)
            elif name in CITES or name in REFS or name in ("includegraphics", "cref", "Cref", "footnote", "url", "href", "hyperref", "caption"):
                tokens: list[Token] = []
                source.at = m.start()
                self.command(source, tokens, Frame())
                key = f"___PLACEHOLDER_{len(held)}___"
                held[key] = tokens
                out.append(key)
            elif name == "csname" and (named := _csname_of(self, source)) is not None:
                source.push("\\" + named + (" " if source.text[source.at : source.at + 1].isalpha() else ""))
            elif name in BOXES:
                source.arguments(BOXES[name])
                source.push(source.block() or "")
            elif name in DROP and name not in ("limits", "nolimits", "arabic", "string", "fill", "linewidth", "textwidth"):
                source.arguments(DROP[name])
            elif name == "ensuremath":
                source.push(source.argument())
            else:
                out.append(m[0])
        self.reading = outer
        return "".join(out), held

    def input(self, text: str) -> Input:
        return Input(text, self.reading is None or self.reading.holds(text))

    def step(self, source: Input) -> None:
        """Before each command, block or formula: expansions are counted from the last reading of source on."""
        self.reading = source
        if source.advanced():
            self.expansions = 0

    def once(self, source: Input, key: str, size: int) -> None:
        """Text pushed for the first time under a key counts as source: a paper's files and what its environments add."""
        if key not in self.first_read:
            self.first_read.add(key)
            source.mark += size

    def count(self) -> None:
        self.expansions += 1
        if self.expansions > MOST_EXPANSIONS:
            raise Problem("macro expansion does not end")

    # -- commands -----------------------------------------------------------------------------------------------

    def command(self, source: Input, out: list[Token], frame: Frame) -> None:
        if source.text.startswith("\\u", source.at) and (m := source.match(_CODE_POINT)):
            self.put_text(out, chr(int(m[1], 16)), frame)
            return
        m = source.match(_COMMAND)
        if not m:
            source.at += 1
            return
        name, sign = m[1], m[2]
        if name is None:
            self.sign(sign, source, out, frame)
            return
        if (longer := _LETTERED.match(m[0] + source.text[source.at : source.at + 40])) and longer[1] != name and (longer[1] in self.macros or longer[1] in DEFINITIONS or longer[1] in HANDLERS or longer[1] in DROP or longer[1] in self.ifs):
            source.at += len(longer[1]) - len(name)
            name = longer[1]
        elif longer and longer[1].startswith("Hy@"):
            source.at += len(longer[1]) - len(name)
            source.arguments("{")
            return
        self.named(name, source, out, frame)

    def named(self, name: str, source: Input, out: list[Token], frame: Frame) -> None:
        """What a command means, by its name; its arguments follow in the source."""
        macro = self.macros.get(name)
        if macro and not macro.math_only:
            self.count()
            source.push(macro.expand(source))
            return
        if name in DEFINITIONS:
            DEFINITIONS[name](self, source, name)
            return
        if name in CONDITIONS or name in self.ifs:
            if self.conditional(source, name):
                return
            self.put(out, {"type": "command", "command": "\\" + name}, frame)
            return
        if name in FONT_SWITCHES:
            style = FONT_SWITCHES[name]
            frame.font = None if frame.font == style and name in ("em", "it", "bf", "tt") else style
            return
        if name in SIZE_SWITCHES:
            frame.size = SIZE_SWITCHES[name]
            return
        handler = HANDLERS.get(name) or INSENSITIVE.get(name.lower())
        if handler:
            handler(self, source, name, out, frame)
            return
        if name in STYLES:
            self.styled(source, [STYLES[name]] if STYLES[name] else [], out, frame)
        elif name in BOXES:
            self.box(source, name, out, frame)
        elif name in DROP:
            if source.text.startswith("*", source.at):
                source.at += 1
            if name == "protect":
                if m := source.match(re.compile(r"\s*\\[a-zA-Z]+")):
                    while source.block("[") is not None or source.block() is not None:
                        pass
            else:
                source.arguments(DROP[name])
        elif name in DIMENSIONED:
            source.match(_DIMENSION)
        elif name in INTEGERS:
            source.match(_INTEGER)
        elif name in SPACES:
            self.put_space(out, SPACES[name], frame, source, name)
        elif name in symbols.ACCENTS:
            arg = source.argument()
            self.put_text(out, symbols.accent(name, {"\\i": "i", "\\j": "j"}.get(arg.strip(), symbols.to_unicode(arg))), frame)
        elif name in symbols.ALPHABETS:
            self.put_text(out, symbols.styled(name, symbols.to_unicode(source.argument())), frame)
        elif name in symbols.symbols():
            source.match(re.compile(r"\{\}"))
            self.put_text(out, symbols.symbols()[name], frame)
        elif name.startswith("end") and len(name) > 3:
            return
        elif (pair := re.compile(rf"\\end{name}(?![a-zA-Z])").search(source.text, source.at)) and f"end{name}" not in HANDLERS:
            body = source.text[source.at : pair.start()]
            source.at = pair.end()
            self.environment(name, body, out, frame)
        else:
            self.put(out, {"type": "command", "command": "\\" + name}, frame)

    def sign(self, sign: str, source: Input, out: list[Token], frame: Frame) -> None:
        if sign == "\\":
            source.match(re.compile(r"\*?(?:\s*\[[^\[\]]*\])?"))
            if frame.line_break == "\n":
                frame.space = ""
                if out and out[-1]["type"] == "text":
                    out[-1]["content"] = out[-1]["content"].rstrip(" ")
                self.put_text(out, "\n", frame)
                frame.skip = True
                source.skip_space()
            else:
                self.put_text(out, frame.line_break, frame)
        elif sign in "([":
            close = {"(": r"\\\)", "[": r"\\\]"}[sign]
            m = re.compile(close).search(source.text, source.at)
            while not m and source.join():
                m = re.compile(close).search(source.text, source.at)
            if not m or (sign == "(" and "\n\n" in source.text[source.at : m.start()]):
                self.put_text(out, "\\" + sign, frame)
                return
            content = source.text[source.at : m.start()]
            source.at = m.end()
            self.put(out, self.equation(content, display=sign == "["), frame)
        elif sign in symbols.ACCENTS:
            arg = source.argument()
            self.put_text(out, symbols.accent(sign, {"\\i": "i", "\\j": "j"}.get(arg.strip(), symbols.to_unicode(arg))), frame)
        elif sign in SPACES:
            self.put_space(out, SPACES[sign], frame, source, sign)
        elif sign in symbols.ESCAPED:
            self.put_text(out, sign, frame)
        elif sign.isspace():
            frame.space = frame.space or " "
        elif sign in "-@":
            return
        else:
            self.put_text(out, sign, frame)

    def put_space(self, out: list[Token], text: str, frame: Frame, source: Input, name: str) -> None:
        if name in ("pagebreak", "linebreak", "nopagebreak", "nolinebreak"):
            source.block("[")
        if text == " ":
            frame.space = frame.space or " "
        elif text:
            frame.space = ""
            self.put_text(out, text, frame)

    def styled(self, source: Input, styles: list[str], out: list[Token], frame: Frame, content: str | None = None) -> None:
        content = source.argument() if content is None else content
        inner = self.parse(content, frame.line_break)
        for t in inner:
            if t["type"] in ("text", "citation", "ref", "url", "equation", "command", "code", "footnote"):
                own = t.get("styles", [])
                t["styles"] = [*styles, *[s for s in own if s not in styles]]
            if t["type"] == "text" and content[:1].isspace() and t is inner[0] and out and not frame.space:
                frame.space = " "
            self.put(out, t, frame)
        if content[-1:].isspace() and inner:
            frame.space = frame.space or " "

    def box(self, source: Input, name: str, out: list[Token], frame: Frame) -> None:
        source.match(re.compile(r"\s*\*"))
        if name in ("hbox", "vbox"):
            source.match(re.compile(r"\s*(?:to|spread)\s*-?[\d.]*\s*(?:\\?[a-zA-Z]+)?"))
        source.arguments(BOXES[name])
        content = source.block()
        if content is not None:
            for t in self.parse(lexing.one_line(content) if name == "mbox" else content, frame.line_break):
                self.put(out, t, frame)

    def conditional(self, source: Input, name: str) -> bool:
        """Splice in the chosen branch: the first, or for a false condition the else branch. False if it has no end."""
        start = source.at
        while True:
            depth, cuts, end = 1, [], None
            for m in _COND.finditer(source.text, source.at):
                word = m[1]
                if word.startswith("if"):
                    depth += word in CONDITIONS or word in self.ifs
                elif word == "fi":
                    depth -= 1
                    if not depth:
                        end = m
                        break
                elif depth == 1:
                    cuts.append(m)
            if end or not source.join():
                break
        if not end:
            source.at = start if start <= len(source.text) else source.at
            return False
        body_end = cuts[0].start() if cuts else end.start()
        head = source.text[source.at : body_end]
        first = head[self.condition(name, head) :]
        last = next((source.text[c.end() : end.start()] for c in reversed(cuts) if c[1] == "else"), "")
        source.at = end.end()
        source.push(last if name == "iffalse" else first)
        return True

    def condition(self, name: str, text: str) -> int:
        """Where the condition that follows a head ends."""
        token = re.compile(r"\s*(?:\\[a-zA-Z@]+|\{[^{}]*\}|.)", re.S)
        if name in self.ifs or name in ("iftrue", "iffalse", "ifmmode", "ifvmode", "ifhmode", "ifpdf"):
            return 0
        if name in ("ifnum", "ifdim"):
            number = r"\d+" if name == "ifnum" else r"[\d.]+\s*(?:pt|em|ex|cm|mm|in)?"  # a unit belongs to a dimension only: "1<2 in all" goes on with "in all"
            m = re.match(rf"\s*[^<>=]*[<>=]\s*-?(?:{number}|\\[a-zA-Z@]+)\s?", text)
            return m.end() if m else 0
        if name in ("if", "ifcat") and (found := lexing.balanced(text)):
            return found[1]
        at = 0
        for _ in range({"ifx": 2, "if": 2, "ifcat": 2, "ifcase": 1, "ifdefined": 1, "ifundefined": 1, "ifodd": 1, "ifeof": 1, "ifvoid": 1}.get(name, 0)):
            m = token.match(text, at)
            at = m.end() if m else at
        return at

    # -- environments -------------------------------------------------------------------------------------------

    def begin(self, source: Input, name: str, out: list[Token], frame: Frame) -> None:
        name = (source.block() or "").strip()
        while True:
            depth, end = 1, None
            for m in re.compile(rf"\\(begin|end)\s*\{{\s*{re.escape(name)}\s*\}}").finditer(source.text, source.at):
                depth += 1 if m[1] == "begin" else -1
                if not depth:
                    end = m
                    break
            if end:
                break
            if source.join():
                continue
            ends = [m.name for m in self.macros.values() if f"\\end{{{name}}}" in m.body and not m.n_args]
            if not ends or not (m := re.compile(rf"\\({'|'.join(map(re.escape, ends))})(?![a-zA-Z])").search(source.text, source.at)):
                break
            source.text = source.text[: m.start()] + self.macros[m[1]].body + source.text[m.end() :]
        if not end:
            self.errors.append(("environment", f"no end of {name}"))
            return
        body = source.text[source.at : end.start()]
        source.at = end.end()
        if name in self.environments:
            self.user_environment(self.environments[name], body, source)
            return
        self.environment(name, body, out, frame)

    def user_environment(self, e: Macro, body: str, source: Input) -> None:
        inner = Input(body)
        args = []
        for default in e.defaults:
            given = inner.block("[")
            args.append(default if given is None else given)
        while len(args) < e.n_args:
            args.append(inner.block() or "")
        self.count()
        begin, end = (lexing.substitute(x, args) if args else x for x in (e.body, e.params[0] if e.params else ""))
        self.once(source, f"environment {e.name}", len(begin) + len(end) + 2)
        source.push(begin + "\n" + inner.text[inner.at :] + "".join(reversed(inner.below)) + "\n" + end)

    def environment(self, name: str, body: str, out: list[Token], frame: Frame) -> None:
        plain = name.rstrip("*")
        star = name != plain
        if plain == "comment":
            return
        if plain in VERBATIM:
            source = Input(body)
            title = source.block("[") if plain != "verbatim" else None
            t: Token = {"type": "code", "content": source.text[source.at :].strip("\n").rstrip(), "display": "block"}
            if title:
                t["title"] = title
            self.put(out, t, frame)
            return
        if plain in EQUATIONS:
            if plain == "alignat":
                _, end = lexing.block(body)
                body = body[end:]
            block = plain != "math"
            t = self.equation(body, block, numbered=block and not star and plain != "displaymath", align="align" in plain or plain in ("eqnarray", "flalign"))
            self.put(out, t, frame)
            return
        if plain in TABLES:
            self.put(out, tables.tabular(self, name, body), frame)
            return
        if plain in DIAGRAMS:
            self.put(out, {"type": "diagram", "name": plain, "content": f"\\begin{{{name}}}{body}\\end{{{name}}}"}, frame)
            return
        if plain == "overpic":
            source = Input(body)
            source.arguments("[")
            self.put(out, {"type": "includegraphics", "content": (source.block() or "").strip()}, frame)
            return
        display = self.titles.get(plain, plain)
        kind = ENVIRONMENTS.get(plain)
        if kind is None:
            kind = "math_env" if display.lower() in THEOREMS else "environment"
        if plain == "@float":
            inner = (lexing.block(body)[0] or "figure").strip()
            kind, plain, body = ENVIRONMENTS.get(inner, "environment"), inner, body[lexing.block(body)[1] :]
        source = Input(body)
        t = {"type": kind, "name": display if kind in ("environment", "math_env", "list", "algorithm") else plain}
        if kind == "math_env":
            t["name"] = display.lower() if display.lower() in THEOREMS else display
        spec = ENVIRONMENT_ARGS.get(plain)
        title = None
        if kind == "math_env":
            title = source.block("[")
        elif spec:
            source.arguments(spec)
        elif kind in ("environment", "list"):
            source.block("[")
        if kind == "math_env" and not star and t["name"].lower() in NUMBERED_THEOREMS:
            t["numbered"] = True
        if kind in ("table", "figure", "algorithm") and not plain.startswith("sub"):
            t["numbered"] = True
        body = source.text[source.at :]
        outer, self.current = self.current, t
        if title is not None:
            t["title"] = self.parse(title)
        if kind == "bibliography":
            t["content"] = [self.bib_token(e) for e in bibliography.parse(body)]
        elif kind == "list":
            t["content"] = self.items(body)
        elif kind == "algorithmic":
            t["content"] = body.strip()
        else:
            t["content"] = self.parse(body, frame.line_break)
        self.current = outer
        self.put(out, t, frame)

    def items(self, body: str) -> list[Token]:
        """A list's items; what stands before the first is reported and left out."""
        depth, cuts = 0, []
        for m in _BEGIN.finditer(body):
            if m[1]:
                depth += 1 if m[1] == "begin" else -1
            elif not depth and not lexing.escaped(body, m.start()):
                cuts.append(m)
        if body[: cuts[0].start() if cuts else None].strip():
            self.errors.append(("list", "text before the first item"))
        out = []
        for k, m in enumerate(cuts):
            out.append(self.item(body[m.end() : cuts[k + 1].start() if k + 1 < len(cuts) else len(body)]))
        return out

    def item(self, text: str) -> Token:
        source = Input(text)
        title = source.block("[")
        t: Token = {"type": "item"}
        outer, self.current = self.current, t
        if title is not None:
            t["title"] = self.parse(title)
        t["content"] = self.parse(source.text[source.at :])
        self.current = outer
        return t

    def bib_token(self, e: dict) -> Token:
        t: Token = {"type": "bibitem", "format": e["format"], "cite_key": e["cite_key"], "content": self.parse(e["content"]) if e["format"] == "bibitem" else e["content"]}
        if e.get("label"):
            t["label"] = e["label"]
        if e.get("fields"):
            t["fields"] = e["fields"]
        return t

    def verbatim_until(self, source: Input, name: str, out: list[Token], frame: Frame) -> None:
        m = source.match(re.compile(r"\*?([^a-zA-Z\s*])(.*?)\1", re.S))
        if m:
            self.put(out, {"type": "code", "content": m[2], "display": "inline"}, frame)


class Frame:
    """What holds within one run of tokens: pending space and the old switches' styles."""

    def __init__(self, line_break: str = "\n"):
        self.space, self.line_break = "", line_break
        self.font: str | None = None
        self.size: str | None = None
        self.color: str | None = None
        self.skip = False

    def styles(self) -> list[str] | None:
        found = [s for s in (self.font, self.size, self.color) if s]
        return found or None


INLINE = frozenset("text citation ref url footnote command".split())


def inline(token: Token) -> bool:
    return token["type"] in INLINE or (token["type"] == "equation" and token.get("display") != "block") or token.get("display") == "inline"


Handler = Callable[[Parser, Input, str, list, "Frame"], None]
HANDLERS: dict[str, Handler] = {}
INSENSITIVE: dict[str, Handler] = {}
DEFINITIONS: dict[str, Callable[[Parser, Input, str], None]] = {}


def handles(names: str, any_case: bool = False):
    def keep(f):
        (INSENSITIVE if any_case else HANDLERS).update(dict.fromkeys(names.split(), f))
        return f

    return keep


def defines(names: str):
    def keep(f):
        DEFINITIONS.update(dict.fromkeys(names.split(), f))
        return f

    return keep


def register(names: str, handler: Handler, token_types: tuple[str, ...] = ()) -> None:
    """Add commands (blank-separated names) to the language, and token types that they make. A handler gets the parser, the input after the command's name,
    that name, the tokens so far, and the frame; it appends with parser.put. On a cluster the module that registers must be imported by the workers."""
    HANDLERS.update(dict.fromkeys(names.split(), handler))
    TOKEN_TYPES.update(token_types)


HANDLERS["begin"] = Parser.begin
HANDLERS["verb"] = Parser.verbatim_until


def star(source: Input) -> bool:
    return source.match(re.compile(r"\s*\*")) is not None


@handles("section subsection subsubsection subsubsubsection part chapter paragraph subparagraph subsubparagraph", any_case=True)
def _section(p, source, name, out, frame):
    name, numbered = name.lower(), not star(source)
    source.block("[")
    kind = "paragraph" if name.endswith("paragraph") else "section"
    level = {"part": 0, "chapter": 1}.get(name, 1 + name.count("sub"))
    t = {"type": kind, "level": level, "numbered": numbered}
    p.current = t
    t["title"] = p.parse(source.block() or "")
    p.put(out, t, frame)


@handles("abstract title keywords", any_case=True)
def _titled(p, source, name, out, frame):
    source.block("[")
    content = source.block()
    if content is not None:
        p.put(out, {"type": name.lower(), "content": p.parse(content)}, frame)


@handles("footnote footnotetext", any_case=True)
def _footnote(p, source, name, out, frame):
    source.block("[")
    t = {"type": "footnote"}
    p.current = t
    t["content"] = p.parse(source.block() or "")
    p.put(out, t, frame)


@handles("footnotemark", any_case=True)
def _footnotemark(p, source, name, out, frame):
    p.put(out, {"type": "footnote", "content": [{"type": "text", "content": source.block("[") or "*"}]}, frame)


@handles("caption subcaption captionof", any_case=True)
def _caption(p, source, name, out, frame):
    star(source)
    t = {"type": "caption"}
    if name.lower() == "captionof":
        t["title"] = (source.block() or "").strip()
    source.block("[")
    p.current = t
    t["content"] = p.parse(source.block() or "")
    p.put(out, t, frame)


def _keys(text: str | None) -> list[str]:
    return [k.strip() for k in (text or "").split(",") if k.strip()]


@handles("ref autoref eqref pageref cref", any_case=True)
def _ref(p, source, name, out, frame):
    star(source)
    content = source.block()
    if content is not None:
        p.put(out, {"type": "ref", "content": _keys(content) if name.lower() == "cref" else [content.strip()]}, frame)


@handles("hyperref", any_case=True)
def _hyperref(p, source, name, out, frame):
    key = source.block("[")
    title = source.block()
    if key is not None:
        p.put(out, {"type": "ref", "title": p.parse(title or ""), "content": [key.strip()]}, frame)


@handles("href url path doi", any_case=True)
def _url(p, source, name, out, frame):
    name, link = name.lower(), (source.block() or "").strip()
    t = {"type": "url", "content": "https://doi.org/" + link if name == "doi" else link.replace("\\", "")}
    if name == "href":
        t["title"] = p.parse(source.block() or "")
    p.put(out, t, frame)


@handles(" ".join(CITES), any_case=True)
def _cite(p, source, name, out, frame):
    star(source)
    notes = [source.block("["), source.block("[")]
    content = source.block()
    if content is None:
        p.put(out, {"type": "command", "command": "\\" + name}, frame)
        return
    t = {"type": "citation", "content": _keys(content)}
    note = ", ".join(n.strip() for n in notes if n and n.strip())
    if note:
        t["title"] = p.parse(note)
    p.put(out, t, frame)


@handles("defcitealias", any_case=True)
def _alias(p, source, name, out, frame):
    key, text = (*source.arguments("{{"), "", "")[:2]
    p.aliases[(key or "").strip()] = text or ""


@handles("citetalias citepalias", any_case=True)
def _cite_alias(p, source, name, out, frame):
    for key in _keys(source.block()):
        t = {"type": "citation", "content": [key]}
        if key in p.aliases:
            t["title"] = p.parse(p.aliases[key])
        p.put(out, t, frame)


@handles("includegraphics includepdf", any_case=True)
def _graphics(p, source, name, out, frame):
    star(source)
    options = source.block("[") or ""
    source.block("[")
    t = {"type": name.lower(), "content": (source.block() or "").strip()}
    for m in _KEY.finditer(options):
        value = (m[2] or "").strip().strip("{}")
        if m[1] == "page" and name.lower() == "includegraphics" and value.isdigit():
            t["page"] = int(value)
        if m[1] == "pages" and name.lower() == "includepdf":
            t["pages"] = value
    p.put(out, t, frame)


@handles("appendix appendices", any_case=True)
def _appendix(p, source, name, out, frame):
    p.put(out, {"type": "appendix", "content": []}, frame)


@handles("bibliography addbibresource", any_case=True)
def _bibliography(p, source, name, out, frame):
    source.block("[")
    entries, seen = [], set()
    for e in bibliography.from_files(p.files, _keys(source.block())):
        if e["cite_key"] not in seen:
            seen.add(e["cite_key"])
            entries.append(p.bib_token(e))
    if entries:
        p.put(out, {"type": "bibliography", "content": entries}, frame)


@handles("input include", any_case=True)
def _input(p, source, name, out, frame):
    path = (source.block() or "").strip()
    text = p.files.get(path) or p.files.get(path + ".tex")
    if text is None:
        p.errors.append(("include", f"no file {path}"))
        return
    p.count()
    text = lexing.strip_comments(text)
    if p.preprocessed and path.rpartition(".")[2] not in DEFINING:
        text = p.preprocess(text)
    p.once(source, f"file {path}", len(text) + 1)
    source.push(text + "\n")


@handles("label")
def _label(p, source, name, out, frame):
    key = (source.block() or "").strip()
    owner = p.current if p.current is not None else (out[-1] if out else None)
    if owner is None:
        p.put(out, {"type": "label", "content": key}, frame)
    else:
        owner.setdefault("labels", []).append(key)


@handles("item")
def _item(p, source, name, out, frame):
    rest = source.text[source.at :] + "".join(reversed(source.below))
    depth, end = 0, len(rest)
    for m in _BEGIN.finditer(rest):
        if m[1]:
            depth += 1 if m[1] == "begin" else -1
        elif not depth:
            end = m.start()
            break
    source.text, source.at, source.below, source.stored = rest, end, [], 0
    p.put(out, p.item(rest[:end]), frame)


@handles("author", any_case=True)
def _author(p, source, name, out, frame):
    source.block("[")
    content = source.block() or ""
    p.put(out, {"type": "author", "content": [p.parse(a) for a in _AND.split(content) if a.strip()]}, frame)


@handles("email affil affiliation address", any_case=True)
def _affiliation(p, source, name, out, frame):
    source.block("[")
    kind = {"affil": "affiliation"}.get(name.lower(), name.lower())
    p.put(out, {"type": kind, "content": p.parse(source.block() or "")}, frame)


@handles("thanks", any_case=True)
def _thanks(p, source, name, out, frame):
    p.put(out, {"type": "footnote", "content": p.parse(source.block() or "")}, frame)


@handles("ensuremath")
def _ensuremath(p, source, name, out, frame):
    p.put(out, p.equation(source.argument(), display=False), frame)


@handles("textcolor color")
def _color(p, source, name, out, frame):
    model, color = source.block("["), (source.block() or "").strip()
    style = f"color={{{model}:{color}}}" if model else f"color={color}"
    if name == "color":
        frame.color = style
    else:
        p.styled(source, [style], out, frame)


@handles("frac nicefrac textfrac")
def _frac(p, source, name, out, frame):
    for k in range(2):
        for t in p.parse(source.argument(), frame.line_break):
            p.put(out, t, frame)
        if not k:
            p.put_text(out, " / ", frame)


@handles("texorpdfstring")
def _texorpdf(p, source, name, out, frame):
    source.block()
    source.push(source.block() or "")


@handles("citetext onecolumn twocolumn")
def _unwrap(p, source, name, out, frame):
    source.push((source.block() if name == "citetext" else source.block("[")) or "")


@handles("subfloat")
def _subfloat(p, source, name, out, frame):
    caption, body = source.block("["), source.block()
    content = [{"type": "caption", "content": p.parse(caption)}] * bool(caption) + p.parse(body or "")
    p.put(out, {"type": "group", "content": content}, frame)


@handles("romannumeral")
def _roman(p, source, name, out, frame):
    m = source.match(re.compile(r"\s*(\d+)\s?"))
    if m:
        p.put_text(out, lexing.roman(int(m[1])), frame)


@handles("num")
def _num(p, source, name, out, frame):
    from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

    options, value = source.block("[") or "", (source.block() or "").strip()
    m = re.search(r"round-precision\s*=\s*(\d+)", options)
    if m:
        try:
            value = str(Decimal(value).quantize(Decimal(1).scaleb(-int(m[1])), rounding=ROUND_HALF_UP))
        except InvalidOperation:
            p.errors.append(("num", f"not a number: {value}"))
    p.put_text(out, value, frame)


@handles("csname")
def _csname(p, source, name, out, frame):
    named = _csname_of(p, source)
    if named is not None:
        p.named(named, source, out, frame)


def _csname_of(p, source) -> str | None:
    """The name that stands up to \\endcsname, with the macros in it replaced."""
    m = source.match(re.compile(r"((?:(?!\\endcsname).)*)\\endcsname(?![a-zA-Z@])", re.S))
    return re.sub(r"\s|\\(?:expandafter|string)(?![a-zA-Z@])", "", expanded(p, m[1])) if m else None


@handles("wd ht dp")
def _box_size(p, source, name, out, frame):
    source.match(re.compile(r"\s*(?:\d+|\\[a-zA-Z@]+(?:\s*\{[^{}]*\})?)"))
    source.match(_ASSIGNED)


@handles("textfont scriptfont scriptscriptfont")
def _math_font(p, source, name, out, frame):
    source.match(re.compile(r"\s*(?:\d+|\\[a-zA-Z@]+)\s*=\s*\\[a-zA-Z@]+"))


@handles("cmidrule")
def _cmidrule(p, source, name, out, frame):
    source.match(re.compile(r"\s*\([^()]*\)"))
    source.arguments("[{")


@handles("advance divide multiply")
def _arithmetic(p, source, name, out, frame):
    m = source.match(re.compile(r"\s*\\?([a-zA-Z@]+)\d*"))
    if name != "advance" or m and (m[1] == "count" or m[1] in INTEGERS or isinstance(p.macros.get(m[1]), _Count)):
        source.match(re.compile(r"\s*(?:by)?"))
        source.match(_INTEGER)
    else:
        source.match(_DIMENSION)


@handles("baselineskip lineskip")
def _line_skip(p, source, name, out, frame):
    """The length after it goes; so does a factor before it, which was read as text: 1.5\\baselineskip."""
    if out and out[-1]["type"] == "text" and isinstance(out[-1]["content"], str) and not frame.space:
        out[-1]["content"] = _FACTOR.sub("", out[-1]["content"])
    source.match(_DIMENSION)


@handles("backslash textbackslash arraybackslash")
def _backslash(p, source, name, out, frame):
    source.match(re.compile(r"\{\}"))
    p.put_text(out, "\\", frame)


@handles("hspace vspace hphantom vphantom phantom")
def _phantom(p, source, name, out, frame):
    star(source)
    content = source.block() or ""
    if name == "hphantom":
        p.put_text(out, " " * len(content), frame)
    elif name == "hspace":
        frame.space = frame.space or " "
    else:
        frame.space = "\n"


@handles("bgroup begingroup")
def _group(p, source, name, out, frame):
    close = {"bgroup": "egroup", "begingroup": "endgroup"}[name]
    depth = 1
    for m in re.compile(rf"\\({name}|{close})(?![a-zA-Z])").finditer(source.text, source.at):
        depth += 1 if m[1] == name else -1
        if not depth:
            body, source.at = source.text[source.at : m.start()], m.end()
            p.put(out, {"type": "group", "content": p.parse(body, frame.line_break)}, frame)
            return


@handles("egroup endgroup fi else")
def _stray(p, source, name, out, frame):
    return


@handles("foreach")
def _foreach(p, source, name, out, frame):
    m = re.compile(r"[^{]*").match(source.text, source.at)
    source.at = m.end()
    source.block()
    source.match(re.compile(r"\s*in\s*"))
    source.block()


@handles("list tabular")
def _pair(p, source, name, out, frame):
    m = re.compile(rf"\\end{name}(?![a-zA-Z])").search(source.text, source.at)
    if m:
        body, source.at = source.text[source.at : m.start()], m.end()
        p.environment(name, body, out, frame)


@handles("sbox savebox setbox")
def _savebox(p, source, name, out, frame):
    if name == "setbox":
        m = source.match(re.compile(r"\s*(\\?[a-zA-Z0-9@]+)\s*=?\s*\\[hv]box"))
        if m:
            p.boxes[m[1].lstrip("\\")] = source.block() or ""
        return
    key = source.argument().strip().lstrip("\\")
    source.arguments("[[" if name == "savebox" else "")
    p.boxes[key] = source.block() or ""


@handles("usebox box copy")
def _usebox(p, source, name, out, frame):
    source.push(p.boxes.get(source.argument().strip().lstrip("\\"), ""))


@handles("ifthenelse IfFileExists @ifclassloaded @ifpackageloaded @ifundefined ifbool notbool")
def _three(p, source, name, out, frame):
    parts = source.arguments("{{{")
    if name == "ifthenelse" and len(parts) < 3:
        raise Problem("ifthenelse needs three blocks")
    source.push((parts[1] if len(parts) > 1 else "") or "")


@handles("@ifstar")
def _ifstar(p, source, name, out, frame):
    parts = source.arguments("{{")
    chosen = star(source)
    source.push((parts[0] if chosen else parts[-1]) or "" if parts else "")


@handles("setkeys")
def _setkeys(p, source, name, out, frame):
    family, pairs = (*source.arguments("{{"), "", "")[:2]
    done = []
    for m in _KEY.finditer(pairs or ""):
        code = p.keys.get(((family or "").strip(), m[1].strip()))
        if code is not None:
            value = (m[2] or "true").strip()
            done.append(lexing.substitute(code, [value[1:-1] if value[:1] == "{" else value]))
    source.push("".join(done))


# -- definitions ------------------------------------------------------------------------------------------------


def _target(source: Input) -> str:
    name = source.block()
    if name is None:
        source.skip_space()
        m = source.match(re.compile(r"\\csname(.*?)\\endcsname", re.S)) or source.match(re.compile(r"\\([a-zA-Z@]+|.)", re.S))
        return m[1].strip() if m else ""
    return re.sub(r"\\csname(.*?)\\endcsname", r"\1", name.replace("\\expandafter", ""), flags=re.S).strip().lstrip("\\")


def _register(p: Parser, macro: Macro) -> None:
    if not macro.name or macro.name in PROTECTED:
        return
    if macro.kind == "newcommand" and re.search(rf"\\{re.escape(macro.name)}(?![a-zA-Z@])", macro.body):
        p.errors.append(("macro", f"{macro.name} calls itself"))
        return
    p.macros[macro.name] = macro


@defines("newcommand renewcommand providecommand DeclareRobustCommand DeclareMathOperator")
def _newcommand(p, source, kind):
    star(source)
    name = _target(source)
    n, defaults = source.block("["), []
    while n is not None and (d := source.block("[")) is not None:
        defaults.append(d)
    body = source.block()
    if body is None:
        body = source.argument()
    count = int(n) if n and n.strip().isdigit() else 0
    _register(p, Macro(name, body, count, defaults, math_only=kind == "DeclareMathOperator"))


@defines("def edef gdef xdef long outer")
def _def(p, source, kind):
    if kind in ("long", "outer"):
        source.match(re.compile(r"\s*\\[egx]?def(?![a-zA-Z])"))
    source.skip_space()
    m = source.match(re.compile(r"(?:\\expandafter\s*)?\\csname(.*?)\\endcsname", re.S)) or source.match(re.compile(r"\\([a-zA-Z@]+|.)", re.S))
    if not m:
        return
    head = re.compile(r"[^{]*").match(source.text, source.at)
    source.at = head.end()
    body = source.block()
    if body is None:
        return
    literal = parameters(head[0].rstrip() if "#" not in head[0] else head[0])
    n = len(literal) - 1
    simple = not any(x.strip() for x in literal)
    if kind in ("edef", "xdef"):
        body = expanded(p, body)
    _register(p, Macro(m[1].strip(), body, n, kind="def", params=None if simple and not n else literal))


def expanded(p: Parser, text: str) -> str:
    """All known macros of a text replaced, to the fixpoint."""
    source, out, outer = p.input(text), [], p.reading
    while not source.done():
        p.step(source)
        m = _LETTERED.search(source.text, source.at)
        if not m:
            out.append(source.text[source.at :])
            source.at = len(source.text)
            continue
        out.append(source.text[source.at : m.start()])
        source.at = m.end()
        if m[1] in p.macros:
            p.count()
            source.push(p.macros[m[1]].expand(source))
        else:
            out.append(m[0])
    p.reading = outer
    return "".join(out)


@defines("let futurelet")
def _let(p, source, kind):
    m = source.match(re.compile(r"\s*\\([a-zA-Z@]+|.)\s*=?\s*(\\(?:[a-zA-Z@]+|.)|[^\s\\])", re.S))
    if m:
        body = expanded(p, m[2]) if m[2][0] == "\\" and m[2][1:] in p.macros and not p.macros[m[2][1:]].n_args else m[2]
        if m[2][1:] in p.macros and p.macros[m[2][1:]].n_args:
            old = p.macros[m[2][1:]]
            p.macros[m[1]] = Macro(m[1], old.body, old.n_args, old.defaults, old.params, kind="let")
        else:
            _register(p, Macro(m[1], body, kind="let"))


@defines("@namedef")
def _namedef(p, source, kind):
    name = (source.block() or "").strip()
    body = source.block()
    if name and body is not None:
        p.macros[name] = Macro(name, body, kind="def")


@defines("DeclarePairedDelimiter")
def _paired(p, source, kind):
    name = _target(source)
    left, right = (*source.arguments("{{"), "", "")[:2]
    p.macros[name] = _Paired(name, f"{left}#1{right}", 1, kind="paired")


class _Paired(Macro):
    def expand(self, source: Input, math: bool = False) -> str:
        star(source)
        source.block("[")
        return self.body.replace("#1", source.block() or "")


@defines("DeclareMathAlphabet DeclareSymbolFontAlphabet")
def _alphabet(p, source, kind):
    name = _target(source)
    source.arguments("{{{{" if kind == "DeclareMathAlphabet" else "{")
    p.macros[name] = Macro(name, "#1", 1, math_only=True)


@defines("newtheorem")
def _newtheorem(p, source, kind):
    star(source)
    name = (source.block() or "").strip()
    source.block("[")
    p.titles[name] = (source.block() or "").strip()
    source.block("[")


@defines("crefname Crefname")
def _crefname(p, source, kind):
    """How references to a type are to be called, one and several: recorded only."""
    parts = source.arguments("{{{")
    if len(parts) == 3:
        p.reference_names[parts[0].strip()] = (parts[1].strip(), parts[2].strip())


@defines("floatname")
def _floatname(p, source, kind):
    name, title = (*source.arguments("{{"), "", "")[:2]
    p.titles[(name or "").strip()] = (title or "").strip()


@defines("newif")
def _newif(p, source, kind):
    m = source.match(re.compile(r"\s*\\if([a-zA-Z@]+)"))
    if m:
        p.ifs.add("if" + m[1])
        for value in ("true", "false"):
            p.macros[m[1] + value] = Macro(m[1] + value, "", kind="newif")


@defines("definecolor")
def _definecolor(p, source, kind):
    parts = source.arguments("{{{")
    if len(parts) == 3:
        p.colors[parts[0].strip()] = {"format": parts[1].strip(), "value": parts[2].strip()}


@defines("newenvironment renewenvironment provideenvironment")
def _newenvironment(p, source, kind):
    star(source)
    name = (source.block() or "").strip()
    n, defaults = source.block("["), []
    while n is not None and (d := source.block("[")) is not None:
        defaults.append(d)
    begin, end = (*source.arguments("{{"), "", "")[:2]
    if name and name != "document":
        p.environments[name] = Macro(name, begin or "", int(n) if n and n.strip().isdigit() else 0, defaults, [end or ""], kind="environment")


@defines("define@key")
def _define_key(p, source, kind):
    family, key = (*source.arguments("{{"), "", "")[:2]
    source.block("[")
    p.keys[(family or "").strip(), (key or "").strip()] = source.block() or ""


@defines(" ".join(k for k in SKIPPED if k not in ("crefname", "Crefname")))
def _skipped(p, source, kind):
    """Registers and counters: declared names are erased wherever they are used."""
    spec = SKIPPED[kind]
    name = None
    if kind in ("newtoks", "newcount", "newdimen", "newskip", "newmuskip", "newfam", "newbox", "newlength", "newsavebox"):
        name = _target(source)
    elif kind in ("setlength", "addtolength", "settoheight", "settodepth", "settowidth"):
        name = _target(source)
        source.arguments("{")
    elif kind in ("newcounter", "stepcounter", "setcounter"):
        name = "the" + (source.block() or "").strip()
        source.arguments({"newcounter": "[", "setcounter": "{"}.get(kind, ""))
    else:
        source.arguments(spec)
    if name and name not in ("baselineskip", "parskip", "parindent") and kind.startswith("new"):
        p.macros[name] = (_Count if kind == "newcount" else _Register)(name, "", kind="register")


class _Register(Macro):
    def expand(self, source: Input, math: bool = False) -> str:
        if source.block() is None:
            source.match(re.compile(r"\s*=?\s*-?[\d.]+\s*(?:pt|em|ex|cm|mm|in)?(?![a-zA-Z])"))
        return ""


class _Count(_Register):
    """A whole number is assigned, without a unit."""

    def expand(self, source: Input, math: bool = False) -> str:
        if source.block() is None:
            source.match(re.compile(r"\s*=?\s*(?:[-+]\s*)*\d+[ \t]*"))
        return ""


@defines("font")
def _font(p, source, kind):
    m = source.match(re.compile(r"\s*\\([a-zA-Z@]+)\s*=\s*\S+(?:\s+(?:at|scaled)\s+[\d.]+\s*(?:pt|em)?)?"))
    if m:
        p.macros[m[1]] = Macro(m[1], "", kind="font")


def is_command(name: str) -> bool:
    """Whether a name has a meaning of its own, beside the characters that symbols stand for."""
    return any(name in x for x in (HANDLERS, DEFINITIONS, STYLES, BOXES, DROP, DIMENSIONED, INTEGERS, SPACES, FONT_SWITCHES, SIZE_SWITCHES, CONDITIONS, symbols.ACCENTS, symbols.ALPHABETS)) or name.lower() in INSENSITIVE
