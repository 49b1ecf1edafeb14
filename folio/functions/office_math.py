"""LaTeX formulas as expression trees, and trees as MathML, as Office math and back as LaTeX.

A tree is a nested tuple whose first member names its kind:

    ("row", node, ...)  ("num", text)  ("id", text)  ("op", text)  ("text", text)  ("name", text)  ("space",)
    ("frac", above, below)  ("root", of, degree or None)  ("script", base, below or None, above or None)
    ("fence", opening, closing, of)  ("accent", mark, of)  ("line", "top" or "bot", of)  ("big", sign, below, above, of)
    ("table", fence opening, fence closing, ("row", cell, ...), ...)

What isn't understood is no tree: formula() gives None, and a writer keeps the text as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from .notation import GREEK, SYMBOLS

Node = tuple
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/math"
MATHML = "http://www.w3.org/1998/Math/MathML"
ET.register_namespace("m", OFFICE)

COMMAND = re.compile(r"\\[A-Za-z]+$")
TOKEN = re.compile(r"\s+|\\[A-Za-z]+\*?|\\.|[0-9]+(?:[.,][0-9]+)*|[^\W\d_]|.", re.S)
#: How deep braces, fences and the like may nest.
DEEP = 60

# Commands of LaTeX and the characters they stand for.
NAMED = {name: c for c, name in [*GREEK.items(), *SYMBOLS.items()] if re.fullmatch(r"[A-Za-z]+", name)} | {
    "circ": "∘", "quad": " ", "qquad": "  ", "ldots": "…", "cdots": "⋯", "dots": "…", "prime": "′", "degree": "°", "infty": "∞", "to": "→", "rightarrow": "→", "Rightarrow": "⇒",
    "leftrightarrow": "↔", "Leftrightarrow": "⇔", "cdot": "⋅", "times": "×", "div": "÷", "pm": "±", "mp": "∓", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠",
    "approx": "≈", "equiv": "≡", "sim": "∼", "perp": "⊥", "parallel": "∥", "in": "∈", "notin": "∉", "subset": "⊂", "cup": "∪", "cap": "∩", "forall": "∀", "exists": "∃", "partial": "∂",
    "nabla": "∇", "angle": "∠", "Delta": "Δ", "ell": "ℓ", "hbar": "ℏ", "varnothing": "∅", "emptyset": "∅", "mid": "∣", "propto": "∝",
}
BIG = {"sum": "∑", "prod": "∏", "int": "∫", "oint": "∮", "iint": "∬", "bigcup": "⋃", "bigcap": "⋂"}
FUNCTIONS = ["sin", "cos", "tan", "cot", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "log", "ln", "lg", "exp", "lim", "max", "min", "det", "dim", "gcd"]
ACCENTS = {"vec": "⃗", "overrightarrow": "⃗", "hat": "̂", "widehat": "̂", "tilde": "̃", "dot": "̇", "ddot": "̈", "acute": "́", "check": "̌"}
LINES = {"overline": "top", "bar": "top", "underline": "bot"}
TEXTS = ["text", "mathrm", "textbf", "textit", "textrm", "operatorname", "mathbf", "mathit", "mathsf", "boldsymbol"]
SPACES = ["\\,", "\\;", "\\:", "\\!", "\\ ", "~"]
FENCES = {"(": "(", ")": ")", "[": "[", "]": "]", "|": "|", "\\{": "{", "\\}": "}", "\\|": "‖", "\\langle": "⟨", "\\rangle": "⟩", ".": "", "\\lfloor": "⌊", "\\rfloor": "⌋", "\\lceil": "⌈", "\\rceil": "⌉"}
TABLES = {"matrix": ("", ""), "pmatrix": ("(", ")"), "bmatrix": ("[", "]"), "vmatrix": ("|", "|"), "cases": ("{", ""), "aligned": ("", ""), "array": ("", ""), "align*": ("", ""), "split": ("", "")}


class Unknown(ValueError):
    """A formula that the grammar below doesn't have."""


class Reader:
    """Recursive descent over the tokens of one formula."""

    def __init__(self, latex: str) -> None:
        self.tokens, self.at, self.depth = TOKEN.findall(latex), 0, 0

    def look(self) -> str | None:
        """The next token that isn't blank, or None."""
        while self.at < len(self.tokens) and self.tokens[self.at].isspace():
            self.at += 1
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        got = self.look()
        if got is None or (want is not None and got != want):
            raise Unknown(f"{want or 'more'} is missing")
        self.at += 1
        return got

    def row(self, *ends: str) -> Node:
        """Nodes up to one of `ends`, which is left."""
        self.depth += 1
        if self.depth > DEEP:
            raise Unknown("nested too deeply")
        out: list[Node] = []
        while (t := self.look()) is not None and t not in ends:
            if t in ("}", "&", "\\\\", "\\right", "\\end"):
                raise Unknown(f"{t} opens nothing")
            out.append(self.scripted())
        if ends and t is None:
            raise Unknown(f"{ends[0]} is missing")
        self.depth -= 1
        return out[0] if len(out) == 1 else ("row", *out)

    def scripted(self) -> Node:
        t = self.look()
        if t[1:] in BIG and t[0] == "\\":
            self.take()
            below, above = self.scripts()
            rest = self.look()
            of = ("row",) if rest is None or rest in ("}", "&", "\\\\", "\\right", "\\end", ")", "]", "=", "+", "-") else self.scripted()
            return ("big", BIG[t[1:]], below, above, of)
        base = ("row",) if t in ("^", "_") else self.atom()
        below, above = self.scripts()
        return base if below is None and above is None else ("script", base, below, above)

    def scripts(self) -> tuple[Node | None, Node | None]:
        got: dict[str, Node] = {}
        while (t := self.look()) in ("^", "_", "'"):
            self.take()
            if t == "'":
                n = 1
                while self.look() == "'":
                    self.take()
                    n += 1
                t, node = "^", ("op", "′" * n)
            else:
                node = self.argument()
            if t in got:
                raise Unknown(f"two {t}")
            got[t] = node
        return got.get("_"), got.get("^")

    def argument(self) -> Node:
        if self.look() == "{":
            self.take()
            out = self.row("}")
            self.take("}")
            return out
        t = self.look()
        if t is not None and len(t) > 1 and t.isdigit():
            self.tokens[self.at : self.at + 1] = list(t)
        return self.atom()

    def words(self) -> str:
        """The text in braces, as it stands."""
        self.take("{")
        start, level = self.at, 1
        while self.at < len(self.tokens):
            level += {"{": 1, "}": -1}.get(self.tokens[self.at], 0)
            self.at += 1
            if not level:
                return "".join(self.tokens[start : self.at - 1])
        raise Unknown("} is missing")

    def atom(self) -> Node:
        t = self.take()
        if t == "{":
            out = self.row("}")
            self.take("}")
            return out
        if t[0].isdigit():
            return ("num", t)
        if t in SPACES:
            return ("space",)
        if t[0] != "\\":
            if t in "}_^&#%$\\":
                raise Unknown(t)
            return ("id", t) if t.isalpha() else ("op", t)
        name = t[1:]
        if name in ("frac", "dfrac", "tfrac"):
            return ("frac", self.argument(), self.argument())
        if name == "sqrt":
            degree = None
            if self.look() == "[":
                self.take()
                degree = self.row("]")
                self.take("]")
            return ("root", self.argument(), degree)
        if name in TEXTS:
            return ("text", self.words())
        if name in FUNCTIONS:
            return ("name", name)
        if name in ACCENTS:
            return ("accent", ACCENTS[name], self.argument())
        if name in LINES:
            return ("line", LINES[name], self.argument())
        if name == "left":
            opening = self.fence()
            of = self.row("\\right")
            self.take("\\right")
            return ("fence", opening, self.fence(), of)
        if name == "begin":
            return self.table()
        if name in NAMED:
            c = NAMED[name]
            return ("space",) if c.isspace() else ("id", c) if c.isalpha() else ("op", c)
        if t in FENCES and len(FENCES[t]):
            return ("op", FENCES[t])
        if name in "{}%$#&_":
            return ("op", name)
        raise Unknown(t)

    def fence(self) -> str:
        t = self.take()
        if t not in FENCES:
            raise Unknown(t)
        return FENCES[t]

    def table(self) -> Node:
        kind = self.words()
        if kind not in TABLES:
            raise Unknown(kind)
        if kind == "array" and self.look() == "{":
            self.words()
        rows, cells = [], []
        while True:
            cells.append(self.row("&", "\\\\", "\\end"))
            t = self.take()
            if t == "&":
                continue
            rows.append(("row", *cells))
            cells = []
            if t == "\\end":
                break
        if self.words() != kind:
            raise Unknown("another end")
        if len(rows) > 1 and rows[-1] == ("row", ("row",)):
            rows.pop()
        return ("table", *TABLES[kind], *rows)


def formula(latex: str | None) -> Node | None:
    """The tree of a formula; None if it is empty or not understood."""
    if not latex or not latex.strip():
        return None
    reader = Reader(latex.strip())
    try:
        return reader.row()
    except Unknown:
        return None


# --- MathML --------------------------------------------------------------------------------------------------------


def _m(tag: str, *inner: ET.Element, text: str | None = None, **attributes: str) -> ET.Element:
    e = ET.Element(tag, attributes)
    e.text = text
    e.extend(inner)
    return e


def mathml_element(n: Node | None) -> ET.Element:
    if n is None:
        return _m("mrow")
    kind, *rest = n
    of = mathml_element
    if kind in ("num", "id", "op", "text", "name"):
        return _m({"num": "mn", "id": "mi", "op": "mo", "text": "mtext", "name": "mi"}[kind], text=rest[0])
    if kind == "space":
        return _m("mspace", width="0.2em")
    if kind == "row":
        return _m("mrow", *map(of, rest))
    if kind == "frac":
        return _m("mfrac", *map(of, rest))
    if kind == "root":
        return _m("msqrt", of(rest[0])) if rest[1] is None else _m("mroot", of(rest[0]), of(rest[1]))
    if kind == "script":
        base, below, above = rest
        tag = "msubsup" if below and above else "msub" if below else "msup"
        return _m(tag, of(base), *[of(x) for x in (below, above) if x])
    if kind == "fence":
        opening, closing, inner = rest
        return _m("mrow", _m("mo", text=opening, fence="true"), of(inner), _m("mo", text=closing, fence="true"))
    if kind == "accent":
        return _m("mover", of(rest[1]), _m("mo", text=rest[0]), accent="true")
    if kind == "line":
        return _m("mover" if rest[0] == "top" else "munder", of(rest[1]), _m("mo", text="¯" if rest[0] == "top" else "_"))
    if kind == "big":
        sign, below, above, inner = rest
        tag = "munderover" if below and above else "munder" if below else "mover" if above else "mrow"
        return _m("mrow", _m(tag, _m("mo", text=sign), *[of(x) for x in (below, above) if x]), of(inner))
    opening, closing, *rows = rest
    table = _m("mtable", *[_m("mtr", *[_m("mtd", of(c)) for c in r[1:]]) for r in rows])
    return _m("mrow", _m("mo", text=opening, fence="true"), table, _m("mo", text=closing, fence="true")) if opening or closing else table


def mathml(n: Node) -> str:
    return ET.tostring(_m("math", mathml_element(n), xmlns=MATHML), encoding="unicode")


# --- Office math -----------------------------------------------------------------------------------------------------


def _o(tag: str, *inner: ET.Element | None, **values: str) -> ET.Element:
    e = ET.Element(f"{{{OFFICE}}}{tag}", {f"{{{OFFICE}}}{k}": v for k, v in values.items()})
    e.extend(x for x in inner if x is not None)
    return e


def _run(text: str, *style: ET.Element) -> ET.Element:
    t = _o("t")
    t.text = text
    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    return _o("r", _o("rPr", *style) if style else None, t)


def office_elements(n: Node | None) -> Iterator[ET.Element]:
    """The elements of a tree, in order; a row has several."""
    if n is None:
        return
    kind, *rest = n
    of = lambda tag, x: _o(tag, *office_elements(x))
    if kind in ("num", "id", "op"):
        yield _run(rest[0])
    elif kind == "text":
        yield _run(rest[0], _o("nor"))
    elif kind == "name":
        yield _run(rest[0], _o("sty", val="p"))
    elif kind == "space":
        yield _run(" ")
    elif kind == "row":
        for x in rest:
            yield from office_elements(x)
    elif kind == "frac":
        yield _o("f", of("num", rest[0]), of("den", rest[1]))
    elif kind == "root":
        yield _o("rad", _o("radPr", _o("degHide", val="1")) if rest[1] is None else None, of("deg", rest[1]), of("e", rest[0]))
    elif kind == "script":
        base, below, above = rest
        tag = "sSubSup" if below and above else "sSub" if below else "sSup"
        yield _o(tag, of("e", base), of("sub", below) if below else None, of("sup", above) if above else None)
    elif kind == "fence":
        yield _o("d", _o("dPr", _o("begChr", val=rest[0]), _o("endChr", val=rest[1])), of("e", rest[2]))
    elif kind == "accent":
        yield _o("acc", _o("accPr", _o("chr", val=rest[0])), of("e", rest[1]))
    elif kind == "line":
        yield _o("bar", _o("barPr", _o("pos", val=rest[0])), of("e", rest[1]))
    elif kind == "big":
        sign, below, above, inner = rest
        hidden = [_o(f"{k}Hide", val="1") for k, x in (("sub", below), ("sup", above)) if x is None]
        yield _o("nary", _o("naryPr", _o("chr", val=sign), *hidden), of("sub", below), of("sup", above), of("e", inner))
    else:
        opening, closing, *rows = rest
        table = _o("m", *[_o("mr", *[of("e", c) for c in r[1:]]) for r in rows])
        yield _o("d", _o("dPr", _o("begChr", val=opening), _o("endChr", val=closing)), _o("e", table)) if opening or closing else table


def office_math(n: Node) -> ET.Element:
    """The tree as an oMath element."""
    return _o("oMath", *office_elements(n))


# --- and back --------------------------------------------------------------------------------------------------------

COMMANDS = {c: f"\\{name}" for name, c in reversed(NAMED.items()) if not c.isspace()}
SIGNS = {c: f"\\{name}" for name, c in reversed(BIG.items())}
MARKS = {c: f"\\{name}" for name, c in reversed(ACCENTS.items())}
OPEN = {c: t for t, c in FENCES.items()}
ESCAPED = {c: f"\\{c}" for c in "{}%$#&_"}


def _joined(parts: list[str]) -> str:
    """A command is parted from a letter behind it."""
    out = ""
    for p in parts:
        out += (" " if p[:1].isalpha() and COMMAND.search(out) else "") + p
    return out


def latex_of(e: ET.Element) -> str:
    """The formula that an Office math element shows."""
    tag = e.tag.rpartition("}")[2]
    child = lambda name: e.find(f"{{{OFFICE}}}{name}")
    inner = lambda name: _joined([latex_of(x) for x in child(name)]) if child(name) is not None else ""
    value = lambda path: x.get(f"{{{OFFICE}}}val") if (x := e.find("/".join(f"{{{OFFICE}}}{p}" for p in path.split("/")))) is not None else None
    if tag == "r":
        text = "".join(t.text or "" for t in e.iter(f"{{{OFFICE}}}t"))
        if e.find(f"{{{OFFICE}}}rPr/{{{OFFICE}}}nor") is not None:
            return f"\\text{{{text}}}"
        if text in FUNCTIONS:
            return f"\\{text}"
        if text and not text.strip("′"):
            return "'" * len(text)
        return _joined([{" ": "\\,"}.get(c) or ESCAPED.get(c) or COMMANDS.get(c, c) for c in text])
    if tag == "f":
        return f"\\frac{{{inner('num')}}}{{{inner('den')}}}"
    if tag == "rad":
        return f"\\sqrt{{{inner('e')}}}" if value("radPr/degHide") == "1" else f"\\sqrt[{inner('deg')}]{{{inner('e')}}}"
    if tag in ("sSub", "sSup", "sSubSup"):
        base = inner("e")
        base = base if len(child("e")) == 1 and child("e")[0].tag.endswith("}r") else f"{{{base}}}"
        above = inner("sup")
        up = "" if child("sup") is None else above if above and not above.strip("'") else f"^{{{above}}}"
        return base + (f"_{{{inner('sub')}}}" if child("sub") is not None else "") + up
    if tag == "d":
        opening, closing = value("dPr/begChr"), value("dPr/endChr")
        only = child("e")[0] if child("e") is not None and len(child("e")) == 1 else None
        if only is not None and only.tag.endswith("}m"):
            kind = next((k for k, v in TABLES.items() if v == (opening, closing)), "matrix")
            return _table(only, kind)
        of = inner("e")
        right = OPEN.get(closing, closing)
        return f"\\left{OPEN.get(opening, opening)}{' ' if OPEN.get(opening, '').startswith(chr(92)) and of[:1].isalpha() else ''}{of}\\right{right}"
    if tag == "acc":
        return f"{MARKS.get(value('accPr/chr'), chr(92) + 'hat')}{{{inner('e')}}}"
    if tag == "bar":
        return f"\\{'overline' if value('barPr/pos') == 'top' else 'underline'}{{{inner('e')}}}"
    if tag == "nary":
        below, above = value("naryPr/subHide") != "1", value("naryPr/supHide") != "1"
        return SIGNS.get(value("naryPr/chr"), "\\sum") + (f"_{{{inner('sub')}}}" if below else "") + (f"^{{{inner('sup')}}}" if above else "") + f"{{{inner('e')}}}"
    if tag == "m":
        return _table(e, "matrix")
    return _joined([latex_of(x) for x in e])


def _table(e: ET.Element, kind: str) -> str:
    rows = [" & ".join(_joined([latex_of(x) for x in c]) for c in r) for r in e]
    return f"\\begin{{{kind}}}" + " \\\\ ".join(rows) + f"\\end{{{kind}}}"
