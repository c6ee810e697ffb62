"""A left-to-right lexer of string literals and comments, by the rules of a syntax.

It knows where a string or comment begins only from where the one before it ended, so a
quote inside a comment opens nothing and a comment mark inside a string neither. A quote
that is never closed is an ordinary character. Linear: an opener that failed once says
the same of all like it in the stretch it looked at.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple


class Syntax(NamedTuple):
    """How a language writes comments and strings."""

    lines: tuple[str, ...] = ()  # marks of comments up to the end of the line
    blocks: tuple[tuple[str, str], ...] = ()
    quotes: tuple[str, ...] = ('"', "'")  # openers of strings
    spaced: bool = True  # a line mark counts only at the start of a line or after a blank
    characters: bool = False  # a single quote encloses one character, not a string


class Token(NamedTuple):
    """A string (kind 's') or comment ('c'), and what is between its marks."""

    kind: str
    start: int
    end: int
    inner: int
    inner_end: int


_SLASHES = {"lines": ("//",), "blocks": (("/*", "*/"),), "spaced": False}
_HASH = Syntax(lines=("#",))
SYNTAXES = {
    "python": Syntax(lines=("#",), quotes=('"""', "'''", '"', "'"), spaced=False),
    "script": Syntax(quotes=('"', "'", "`"), **_SLASHES),
    "java": Syntax(quotes=('"""', '"', "'"), characters=True, **_SLASHES),
    "csharp": Syntax(quotes=('"""', '@"', '"', "'"), characters=True, **_SLASHES),
    "c": Syntax(characters=True, **_SLASHES),
    "go": Syntax(quotes=('"', "'", "`"), characters=True, **_SLASHES),
    "php": Syntax(lines=("//", "#"), blocks=(("/*", "*/"),)),
    "hash": _HASH,
    "toml": Syntax(lines=("#",), quotes=('"""', "'''", '"', "'")),
    "ini": Syntax(lines=("#", ";")),
    "json": Syntax(lines=("//", "#"), blocks=(("/*", "*/"),), quotes=('"',)),
    "markup": Syntax(blocks=(("<!--", "-->"),)),
    "sql": Syntax(lines=("--", "#"), blocks=(("/*", "*/"),), quotes=('"', "'", "`")),
    # Where the language is unknown: every common mark, after blanks only.
    "any": Syntax(lines=("#", "//", "; ", "-- "), blocks=(("/*", "*/"), ("<!--", "-->")), quotes=('"""', "'''", '"', "'", "'", "`")),
    # Quoted words inside comments and texts.
    "quoted": Syntax(quotes=('"', "'", "`")),
}
_MANY_LINES = {"script", "go"}  # where a back quote may enclose several lines
_BODY = {
    '"': re.compile(r'(?:[^"\\\n]|\\.)*+', re.S),
    "'": re.compile(r"(?:[^'\\\n]|\\.)*+", re.S),
    "`": re.compile(r"(?:[^`\\\n]|\\.)*+", re.S),
    "``": re.compile(r"(?:[^`\\]|\\.)*+", re.S),
    '@"': re.compile(r'(?:[^"]|"")*+'),
}
_CHARACTER = re.compile(r"'(?:\\[^\n']{1,9}|\\'|[^'\\\n])'")


@lru_cache(maxsize=None)
def _openers(name: str) -> re.Pattern:
    syntax = SYNTAXES[name]
    before = r"(?<!\S)" if syntax.spaced else ""
    parts = [re.escape(a) for a, _ in syntax.blocks]
    parts += [before + re.escape(mark.rstrip()) + (r"(?=\s)" if mark.endswith(" ") else "") for mark in syntax.lines]
    parts += [re.escape(q) for q in dict.fromkeys(syntax.quotes)]
    return re.compile("|".join(parts))


def tokens(text: str, name: str = "any", start: int = 0, stop: int | None = None) -> list[Token]:
    """The strings and comments of ``text[start:stop]``, in order."""
    syntax, opener = SYNTAXES[name], _openers(name)
    stop = len(text) if stop is None else stop
    closers = dict(syntax.blocks)
    lines = {mark.rstrip() for mark in syntax.lines}
    dead: dict[str, int] = {}  # opener -> up to where it is known not to be closed
    out: list[Token] = []
    at = start
    while (m := opener.search(text, at, stop)) is not None:
        mark, here = m.group(), m.start()
        if mark in lines:
            end = text.find("\n", here, stop)
            end = stop if end < 0 else end
            out.append(Token("c", here, end, m.end(), end))
            at = end
            continue
        if mark in closers:
            close = text.find(closers[mark], m.end(), stop)
            end = stop if close < 0 else close + len(closers[mark])
            out.append(Token("c", here, end, m.end(), stop if close < 0 else close))
            at = end
            continue
        if len(mark) == 3:
            close = -1 if here < dead.get(mark, 0) else text.find(mark, m.end(), stop)
            if close >= 0:
                out.append(Token("s", here, close + 3, m.end(), close))
                at = close + 3
                continue
            dead[mark] = stop
            mark = mark[0]
        if mark == "'" and syntax.characters:
            found = _CHARACTER.match(text, here, stop)
            at = found.end() if found else here + 1
            continue
        if here < dead.get(mark, 0):
            at = here + len(mark)
            continue
        body = _BODY["``" if mark == "`" and name in _MANY_LINES else mark].match(text, here + len(mark), stop)
        if body.end() < stop and text[body.end()] == mark[-1]:
            out.append(Token("s", here, body.end() + 1, here + len(mark), body.end()))
            at = body.end() + 1
        else:
            dead[mark] = body.end()
            at = here + len(mark)
    return out


# Endings of file names and labels of languages by the syntax they have.
ENDINGS = {
    "python": "py pyi pyw", "script": "js ts jsx tsx mjs cjs", "java": "java kt kts scala groovy", "csharp": "cs", "c": "c h cpp hpp cc rs swift", "go": "go", "php": "php",
    "hash": "rb sh bash zsh yml yaml env properties conf cfg dockerfile tf", "toml": "toml", "ini": "ini", "json": "json jsonc", "markup": "xml html htm config", "sql": "sql",
}
LABELS = {
    "python": "python", "script": "javascript typescript", "java": "java kotlin scala", "csharp": "csharp c#", "c": "c c++ cpp rust", "go": "go", "php": "php",
    "hash": "ruby shell bash yaml env dockerfile", "toml": "toml", "ini": "ini", "json": "json", "markup": "xml html", "sql": "sql",
}
_BY_ENDING = {ending: name for name, endings in ENDINGS.items() for ending in endings.split()}
_BY_LABEL = {label: name for name, labels in LABELS.items() for label in labels.split()}
#: Syntaxes whose unquoted right sides are expressions.
CODE = {"python", "script", "java", "csharp", "c", "go", "php"}


def syntax_of(path: str | None, language: str | None) -> str:
    """The syntax by the file name's ending; by the label, which may be wrong, where it has none."""
    if path:
        name = path.lower().replace("\\", "/").rsplit("/", 1)[-1]
        if "." in name:
            return _BY_ENDING.get(name.rsplit(".", 1)[-1], "any")
        if name in _BY_ENDING:
            return _BY_ENDING[name]
    return _BY_LABEL.get((language or "").strip().lower(), "any")


def is_code(syntax: str, path: str | None, language: str | None) -> bool:
    """Whether unquoted right sides are expressions (code) and not values (configuration)."""
    return syntax in CODE or bool(path and path.lower().endswith(".rb")) or (language or "").strip().lower() == "ruby"
