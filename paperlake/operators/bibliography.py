"""Bibliographies in four formats: BibTeX, \\bibitem lists, compiled biber files and amsrefs lists."""

from __future__ import annotations

import re

from paperlake.functions import lexing

_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s{}]+)\s*,")
_FIELD = re.compile(r"\s*,?\s*([\w-]+)\s*=\s*")
_ITEM = re.compile(r"\\bibitem(?![a-zA-Z])\s*")
_COMPILED = re.compile(r"\\entry\{([^{}]*)\}\{([^{}]*)\}\{[^{}]*\}(.*?)\\endentry", re.S)
_BIB = re.compile(r"\\bib\s*\{([^{}]*)\}\s*\{([^{}]*)\}\s*(?=\{)")
_SKIP = ("string", "comment", "preamble")


def kind(text: str) -> str | None:
    """Which format a text is in, in order of precedence."""
    if "\\begin{bibdiv}" in text or _BIB.search(text):
        return "bibdiv"
    if _COMPILED.search(text):
        return "compiled"
    if _ENTRY.search(text):
        return "bibtex"
    return "bibitem" if "\\bibitem" in text else None


def parse(text: str, bare_values: bool = False) -> list[dict]:
    """Entries: format, cite_key, content, and label, entry_type, fields where they have them."""
    text = lexing.normalize_space(lexing.strip_comments(text))
    found = kind(text)
    if found == "bibitem":
        return bibitems(text)
    entries = {"bibtex": lambda t: bibtex(t, bare_values), "compiled": compiled, "bibdiv": bibdiv, None: lambda t: []}[found](text)
    return [{"format": "bibtex", "cite_key": k, "entry_type": t, "fields": f, "content": canonical(t, k, f)} for t, k, f in entries]


def canonical(entry_type: str, key: str, fields: dict[str, str]) -> str:
    return "@%s{%s,\n%s\n}" % (entry_type, key, ",\n".join(f"\t{k}={{{v}}}" for k, v in fields.items()))


def bibtex(text: str, bare_values: bool = False):
    for m in _ENTRY.finditer(text):
        if m[1].lower() in _SKIP:
            continue
        body = lexing.balanced(text, text.index("{", m.start()))
        if not body:
            continue
        fields, at, stop = {}, m.end(), body[1] - 1
        while f := _FIELD.match(text, at, stop):
            at = f.end()
            if text[at : at + 1] == "{":
                value, at = lexing.block(text, at)
            elif text[at : at + 1] == '"':
                q = re.compile(r'"((?:\\.|\{(?:[^{}]|\{[^{}]*\})*\}|[^"\\{])*)"', re.S).match(text, at)
                value, at = (q[1], q.end()) if q else (None, at + 1)
            else:
                bare = re.compile(r"[^,}\s]*").match(text, at)
                value, at = (bare[0] if bare_values else None), bare.end()
            if value is not None:
                fields[f[1].lower()] = value.strip()
        yield m[1].lower(), m[2], fields


def compiled(text: str):
    """Entries of a compiled file: names as 'Family, G.', journaltitle as journal, eprint from its verbatim block."""
    for m in _COMPILED.finditer(text):
        key, entry_type, body = m[1], m[2], m[3]
        fields = {}
        names = re.search(r"\\name\{author\}\{\d+\}\{[^{}]*\}\{(.*)", body, re.S)
        if names:
            people = zip(re.findall(r"\bfamily=\{([^{}]*)\}", names[1]), re.findall(r"\bgiveni=\{([^{}]*)\}", names[1]), strict=False)
            fields["author"] = " and ".join(f"{a}, {b}".replace("\\bibinitperiod", ".").replace("\\bibinitdelim", "").strip(" ,") for a, b in people)
        for f in re.finditer(r"\\field\{([^{}]*)\}(?=\{)", body):
            value, _ = lexing.block(body, f.end())
            fields[{"journaltitle": "journal"}.get(f[1], f[1])] = (value or "").strip()
        e = re.search(r"\\verb\{eprint\}\s*\\verb\s+(\S+)\s*\\endverb", body)
        if e:
            fields["eprint"] = e[1]
        yield entry_type, key, fields


def bibdiv(text: str):
    for m in _BIB.finditer(text):
        content, _ = lexing.block(text, m.end())
        fields: dict[str, str] = {}
        at, content = 0, content or ""
        while f := _FIELD.match(content, at):
            value, at = lexing.block(content, f.end())
            if value is None:
                break
            value = re.sub(r"[{}]", "", value).strip()
            name = f[1].lower()
            fields[name] = f"{fields[name]} and {value}" if name in fields else value
        yield m[2].strip().lower(), m[1].strip(), fields


def bibitems(text: str) -> list[dict]:
    cuts = list(_ITEM.finditer(text))
    out: list[dict] = []
    for k, m in enumerate(cuts):
        body = text[m.end() : cuts[k + 1].start() if k + 1 < len(cuts) else len(text)]
        body = body.split("\\end{thebibliography}")[0]
        label, at = lexing.block(body, 0, "[")
        key, at = lexing.block(body, at)
        if key is None:
            continue
        content = re.sub(r"\\newblock(?![a-zA-Z])\s*", "", body[at:]).strip()
        if "\\bysame" in content and out:
            content = re.sub(r"\\bysame(?![a-zA-Z])", lambda _: out[-1]["content"].split(",")[0], content)
        entry = {"format": "bibitem", "cite_key": key.strip(), "content": content}
        out.append(entry | ({"label": label} if label else {}))
    return out


def from_files(files: dict[str, str], names: list[str]) -> list[dict]:
    """Entries of the named files: as given, else .bbl, else .bib; if none is there, main.bbl or the first .bbl."""
    out = []
    for name in names:
        path = next((p for p in (name if name.endswith((".bib", ".bbl")) else "", name + ".bbl", name + ".bib") if p in files), None)
        path = path or next((p for p in ("main.bbl", *sorted(f for f in files if f.endswith(".bbl"))) if p in files), None)
        if path:
            out += parse(files[path])
    return out
