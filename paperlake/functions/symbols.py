r"""LaTeX commands for characters. Greek and Cyrillic letters, dingbats, alphabets and accents follow from Unicode character names and code points; mathematical
symbols from the public entity names of HTML, which hold TeX's and AMS's names; the rest is a short core table."""

from __future__ import annotations

import re
import unicodedata
from html.entities import html5, name2codepoint
from functools import lru_cache

#: Command name to character, beyond what character names give.
CORE = {
    "ldots": "…", "dots": "…", "textellipsis": "…", "cdots": "⋯", "vdots": "⋮", "ddots": "⋱", "textendash": "–", "textemdash": "—", "S": "§", "P": "¶", "copyright": "©", "textcopyright": "©",
    "textregistered": "®", "texttrademark": "™", "textdegree": "°", "degree": "°", "pounds": "£", "textsterling": "£", "euro": "€", "texteuro": "€", "textyen": "¥", "textbullet": "•", "bullet": "•", "textquoteleft": "‘",
    "textquoteright": "’", "textquotedblleft": "“", "textquotedblright": "”", "dag": "†", "ddag": "‡", "textdagger": "†", "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø",
    "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ", "dh": "ð", "th": "þ", "DH": "Ð", "TH": "Þ", "textless": "<", "textgreater": ">", "textbar": "|", "textasciitilde": "~", "textasciicircum": "^",
    "textunderscore": "_", "textexclamdown": "¡", "textquestiondown": "¿", "infty": "∞", "pm": "±", "mp": "∓", "times": "×", "div": "÷", "cdot": "⋅", "ast": "∗", "star": "⋆", "circ": "∘", "le": "≤", "leq": "≤",
    "ge": "≥", "geq": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "equiv": "≡", "sim": "∼", "simeq": "≃", "cong": "≅", "propto": "∝", "ll": "≪", "gg": "≫", "to": "→", "rightarrow": "→",
    "leftarrow": "←", "leftrightarrow": "↔", "Rightarrow": "⇒", "Leftarrow": "⇐", "Leftrightarrow": "⇔", "mapsto": "↦", "uparrow": "↑", "downarrow": "↓", "forall": "∀", "exists": "∃", "nexists": "∄", "in": "∈", "notin": "∉", "ni": "∋",
    "subset": "⊂", "subseteq": "⊆", "supset": "⊃", "supseteq": "⊇", "cup": "∪", "cap": "∩", "setminus": "∖", "emptyset": "∅", "varnothing": "∅", "partial": "∂", "nabla": "∇", "sum": "∑", "prod": "∏", "int": "∫",
    "oint": "∮", "sqrt": "√", "angle": "∠", "perp": "⊥", "parallel": "∥", "wedge": "∧", "vee": "∨", "neg": "¬", "lnot": "¬", "oplus": "⊕", "oslash": "⊘", "otimes": "⊗", "top": "⊤", "bot": "⊥", "vdash": "⊢",
    "models": "⊨", "ell": "ℓ", "hbar": "ℏ", "Re": "ℜ", "Im": "ℑ", "aleph": "ℵ", "wp": "℘", "prime": "′", "dagger": "†", "ddagger": "‡", "langle": "⟨", "rangle": "⟩", "lfloor": "⌊", "rfloor": "⌋", "lceil": "⌈",
    "rceil": "⌉", "checkmark": "✓", "square": "□", "blacksquare": "■", "triangle": "△", "diamond": "⋄", "clubsuit": "♣", "heartsuit": "♡", "spadesuit": "♠", "flat": "♭", "natural": "♮", "sharp": "♯", "textmu": "µ", "LaTeX": "LaTeX", "TeX": "TeX",
}
#: Alphabet command to the words of its characters' names.
ALPHABETS = {
    "mathbb": "DOUBLE-STRUCK", "mathcal": "SCRIPT", "mathscr": "SCRIPT", "mathfrak": "FRAKTUR", "mathtt": "MONOSPACE", "mathsf": "SANS-SERIF", "mathbf": "BOLD", "mathit": "ITALIC", "mathmit": "ITALIC", "mathbit": "BOLD ITALIC",
    "mathbcal": "BOLD SCRIPT", "mathbfrak": "BOLD FRAKTUR", "mathsfbf": "SANS-SERIF BOLD", "mathsfsl": "SANS-SERIF ITALIC", "mathsfbfsl": "SANS-SERIF BOLD ITALIC",
}
#: TeX's names of the letters of the Cyrillic alphabet, in its order.
CYRILLIC = "A B V G D E ZH Z I ISHRT K L M N O P R S T U F H C CH SH SHCH HRDSN ERY SFTSN EREV YU YA".split()
#: TeX names of fewer than six letters that are entity names too. Longer entity names are all taken; shorter ones are abbreviations of HTML's own.
SHORT_NAMES = frozenset(
    "prec succ asymp doteq frown smile Vdash vDash bumpe nmid nsim ncong nleq ngeq lneq gneq lneqq gneqq nless ngtr npar napid nprec nsucc Subset Supset Cap Cup uplus sqcup sqcap odot amalg unlhd unrhd ltimes rtimes barvee vert Vert"
    " circeq beth gimel daleth eth hslash lll ggg leqq geqq lhd rhd mho Uparrow Bbbk imath jmath lbrace rbrace wr ominus coprod iint iiint male female phone cent yen sung lnsim gnsim lnap gnap iff bigcap bigcup bigvee".split()
)
#: Text commands named for what they show, by their character's Unicode name.
NAMED = {
    "textsection": "SECTION SIGN", "textparagraph": "PILCROW SIGN", "textcent": "CENT SIGN", "textcurrency": "CURRENCY SIGN", "textbrokenbar": "BROKEN BAR", "textasciidieresis": "DIAERESIS", "textasciimacron": "MACRON", "textasciiacute": "ACUTE ACCENT",
    "textordfeminine": "FEMININE ORDINAL INDICATOR", "textordmasculine": "MASCULINE ORDINAL INDICATOR", "guillemotleft": "LEFT-POINTING DOUBLE ANGLE QUOTATION MARK", "guillemotright": "RIGHT-POINTING DOUBLE ANGLE QUOTATION MARK",
    "guilsinglleft": "SINGLE LEFT-POINTING ANGLE QUOTATION MARK", "guilsinglright": "SINGLE RIGHT-POINTING ANGLE QUOTATION MARK", "quotedblbase": "DOUBLE LOW-9 QUOTATION MARK", "quotesinglbase": "SINGLE LOW-9 QUOTATION MARK", "textlnot": "NOT SIGN", "textpm": "PLUS-MINUS SIGN",
    "textonesuperior": "SUPERSCRIPT ONE", "texttwosuperior": "SUPERSCRIPT TWO", "textthreesuperior": "SUPERSCRIPT THREE", "textperiodcentered": "MIDDLE DOT", "textonequarter": "VULGAR FRACTION ONE QUARTER", "textonehalf": "VULGAR FRACTION ONE HALF",
    "textthreequarters": "VULGAR FRACTION THREE QUARTERS", "texttimes": "MULTIPLICATION SIGN", "textdiv": "DIVISION SIGN", "textbackslash": "REVERSE SOLIDUS", "textdaggerdbl": "DOUBLE DAGGER", "textperthousand": "PER MILLE SIGN", "textflorin": "LATIN SMALL LETTER F WITH HOOK",
    "textbardbl": "DOUBLE VERTICAL LINE", "textnumero": "NUMERO SIGN", "textohm": "OHM SIGN", "textestimated": "ESTIMATED SYMBOL", "textleftarrow": "LEFTWARDS ARROW", "textuparrow": "UPWARDS ARROW", "textrightarrow": "RIGHTWARDS ARROW", "textdownarrow": "DOWNWARDS ARROW",
    "textsurd": "SQUARE ROOT", "textmusicalnote": "EIGHTH NOTE", "texteuro": "EURO SIGN", "textbaht": "THAI CURRENCY SYMBOL BAHT", "textwon": "WON SIGN", "textnaira": "NAIRA SIGN", "textpeso": "PESO SIGN", "textlira": "LIRA SIGN", "textcolonmonetary": "COLON SIGN", "textinterrobang": "INTERROBANG",
    "textvisiblespace": "OPEN BOX", "ng": "LATIN SMALL LETTER ENG", "NG": "LATIN CAPITAL LETTER ENG", "dj": "LATIN SMALL LETTER D WITH STROKE", "DJ": "LATIN CAPITAL LETTER D WITH STROKE",
    "mercury": "MERCURY", "venus": "FEMALE SIGN", "earth": "EARTH", "mars": "MALE SIGN", "jupiter": "JUPITER", "saturn": "SATURN", "uranus": "URANUS", "neptune": "NEPTUNE", "pluto": "PLUTO", "aries": "ARIES", "taurus": "TAURUS", "gemini": "GEMINI", "cancer": "CANCER", "leo": "LEO",
    "virgo": "VIRGO", "libra": "LIBRA", "scorpio": "SCORPIUS", "sagittarius": "SAGITTARIUS", "capricornus": "CAPRICORN", "aquarius": "AQUARIUS", "pisces": "PISCES", "qedsymbol": "WHITE SQUARE", "qedhere": "WHITE SQUARE", "quarternote": "QUARTER NOTE", "eighthnote": "EIGHTH NOTE", "notbackslash": "COMBINING REVERSE SOLIDUS OVERLAY",
}
#: Accent command to the combining character.
ACCENTS = {
    "'": "\u0301", "`": "\u0300", '"': "\u0308", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "H": "\u030b", "k": "\u0328", "b": "\u0331", "d": "\u0323", "r": "\u030a", "u": "\u0306", "v": "\u030c",
    "vec": "\u20d7", "dot": "\u0307", "hat": "\u0302", "check": "\u030c", "breve": "\u0306", "acute": "\u0301", "grave": "\u0300", "tilde": "\u0303", "bar": "\u0304", "ddot": "\u0308", "not": "\u0338",
}
_SIGN_ACCENT = "'`\"^~=."
ESCAPED = "%&#$_{}"


@lru_cache(maxsize=1)
def symbols() -> dict[str, str]:
    """Command name (without backslash) to character."""
    out = {}
    for base in (0x391, 0x3B1):
        for code in range(base, base + 25):
            name = unicodedata.name(chr(code), "")
            word = name.rpartition(" ")[2].lower()
            if name.startswith("GREEK") and " WITH " not in name and "FINAL" not in name:
                word = {"lamda": "lambda"}.get(word, word)
                out[word if "SMALL" in name else word.capitalize()] = chr(code)
    for word in ("epsilon", "theta", "phi", "rho", "kappa"):
        out[f"var{word}"] = unicodedata.lookup(f"GREEK {'LUNATE EPSILON' if word == 'epsilon' else word.upper()} SYMBOL")
    for k, name in enumerate(CYRILLIC):
        out["CYR" + name], out["cyr" + name.lower()] = chr(0x410 + k), chr(0x430 + k)
    out |= {"CYRYO": "Ё", "cyryo": "ё"} | {name: unicodedata.lookup(x) for name, x in NAMED.items()}
    return entities() | out | {"varsigma": "ς", "varpi": "ϖ"} | CORE


def entities() -> dict[str, str]:
    """Entity names that are TeX's (of six letters or more, and the short ones listed), but for the names of HTML 4, which are HTML's own."""
    names = ((k[:-1], v) for k, v in html5.items() if k.endswith(";") and k[:-1].isalpha())
    return {k: v for k, v in names if k in SHORT_NAMES or (len(k) > 5 and k not in name2codepoint)}


def ding(code: int) -> str | None:
    """The character of a code of the dingbats font: in Unicode's order but for the card suits, circled digits and three arrows, which Unicode has elsewhere."""
    if 33 <= code <= 126:
        return chr(0x26E0 + code) if code not in (37, 42, 43, 72, 110, 115, 116, 117) else {37: "☎", 42: "☛", 43: "☞", 72: "★", 110: "■", 115: "▲", 116: "▼", 117: "◆"}[code]
    if 168 <= code <= 181:
        return "♣♦♥♠"[code - 168] if code < 172 else chr(0x2460 + code - 172)
    if 213 <= code <= 215:
        return "→↔↕"[code - 213]
    return chr(0x26C0 + code) if 161 <= code <= 254 and code != 240 else None


@lru_cache(maxsize=4096)
def styled(alphabet: str, text: str) -> str:
    """Letters and digits in a mathematical alphabet; characters that it lacks stay."""
    words, out = ALPHABETS[alphabet], []
    for c in text:
        kind = unicodedata.name(c).removeprefix("GREEK ").replace("LETTER ", "") if "\u0391" <= c <= "\u03c9" else "DIGIT " + unicodedata.name(c).rpartition(" ")[2] if c.isdigit() and c.isascii() else ("CAPITAL " if c.isupper() else "SMALL ") + c.upper() if c.isalpha() and c.isascii() else ""
        for name in (f"MATHEMATICAL {words} {kind}", f"{words} {kind}", f"BLACK-LETTER {kind}" if words == "FRAKTUR" else ""):
            try:
                out.append(unicodedata.lookup(name))
                break
            except KeyError:
                continue
        else:
            out.append(c)
    return "".join(out)


def accent(name: str, text: str) -> str:
    """The accent on the first character, composed where Unicode has the pair."""
    if not text:
        return ""
    first = {"ı": "i", "ȷ": "j"}.get(text[0], text[0])
    return unicodedata.normalize("NFC", first + ACCENTS[name]) + text[1:]


_CODE = re.compile(r"\\u([0-9a-fA-F]{4,6})")
_WORD = re.compile(r"\\([a-zA-Z]+)(\{\})?")
_ALPHABET = re.compile(r"\\(%s)(?![a-zA-Z])\s*(?:\{((?:[^{}\\]|\\[a-zA-Z]+)*)\}|([A-Za-z0-9]))" % "|".join(sorted(ALPHABETS, key=len, reverse=True)))
_DING = re.compile(r"\\ding\s*\{(\d+)\}")
_ENSURE = re.compile(r"\\ensuremath\s*\{([^{}]*)\}")
_ACCENT_SIGN = re.compile(r"\\([%s])\s*(?:\{\s*(\\[ij](?![a-zA-Z])|[^{}\\]*)\s*\}|(\\[ij](?![a-zA-Z])|[^\s\\{}]))" % re.escape(_SIGN_ACCENT))
_ACCENT_WORD = re.compile(r"\\(%s)(?![a-zA-Z])(?:\s*\{\s*(\\[ij](?![a-zA-Z])|[^{}\\]*)\s*\}|\s+([A-Za-z=])|([^\sA-Za-z\\{}]))" % "|".join(k for k in ACCENTS if k.isalpha()))


def convert_accents(text: str) -> str:
    if "\\" not in text:
        return text
    put = lambda m: accent(m[1], {"\\i": "i", "\\j": "j"}.get(x := next((g for g in m.groups()[1:] if g is not None), ""), x))
    return _ACCENT_WORD.sub(put, _ACCENT_SIGN.sub(put, text))


def to_unicode(text: str) -> str:
    """Escapes, \\ensuremath, alphabets and symbol commands as characters; unknown commands stay."""
    if "\\" not in text:
        return text
    text = _CODE.sub(lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else m[0], text)
    text = _ENSURE.sub(lambda m: m[1], text)
    known = symbols()
    plain = lambda x: _WORD.sub(lambda m: known.get(m[1], m[0]), x)
    text = _ALPHABET.sub(lambda m: styled(m[1], plain(m[2]) if m[2] is not None else m[3]), text)
    return plain(_DING.sub(lambda m: ding(int(m[1])) or m[0], text))
