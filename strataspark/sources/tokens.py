"""Source text as tokens: what is left of a text without blanks and comments.

A token is a name, a quoted string (its content), a number or a single sign, with its line and the depth of the brackets
around it; an opening bracket and its closing one have the depth outside. The lexer knows the strings and comments of each
language, so that nothing within them is taken for code. It never fails: a quote without an end counts as a sign, and
``broken`` tells that a comment or a long string doesn't end or that brackets don't pair up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

NAME, STRING, TEMPLATE, NUMBER, SIGN = "name", "string", "template", "number", "sign"
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


@dataclass(frozen=True)
class Lexicon:
    """Patterns of one family of languages; ``long`` strings may span lines, those of ``short`` may not."""

    comment: str
    long: str
    short: str
    templates: bool = False
    nested_comments: bool = False
    #: whether letters may belong to the string behind them
    prefixes: bool = False


_QUOTED = r'"(?:\\.|[^"\\\n])*"' + r"|'(?:\\.|[^'\\\n])*'"
SCRIPT = Lexicon(r"//[^\n]*|/\*.*?\*/", r"(?!)", _QUOTED, templates=True)
GO = Lexicon(r"//[^\n]*|/\*.*?\*/", r"`[^`]*`", _QUOTED)
RUST = Lexicon(r"//[^\n]*", r'b?r(?P<rust>#*)".*?"(?P=rust)|"(?:\\.|[^"\\])*"', r"'(?:\\(?:u\{\w*\}|x\w\w|.)|[^'\\\n])'", nested_comments=True, prefixes=True)
JAVA = Lexicon(r"//[^\n]*|/\*.*?\*/", r'""".*?"""', _QUOTED)
PYTHON = Lexicon(r"\#[^\n]*", r'(?:[rRbBuUfF]{0,2})(?:"""(?:\\.|[^\\])*?"""|' + r"'''(?:\\.|[^\\])*?''')", r"(?:[rRbBuUfF]{0,2})(?:" + _QUOTED + ")", prefixes=True)

#: Names and signs that begin no string or comment come first, as most tokens are such; blanks behind a token go with it.
#: Names of plain letters come before the others, as classes without categories are quick.
_PLAIN = r"(?P<word>[%s_$][A-Za-z0-9_$]*+(?![^\x00-\x7f]))|(?P<mark>[,;.:=*&<>|+@!?~^%%-])|(?P<bracket>[()\[\]{}])"
#: Places of the first groups.
_WORD, _MARK, _BRACKET, _LINE = 1, 2, 3, 4
_BLANKS = r"[ \t]*"
_REST = r"(?P<name>[^\W\d][\w$]*|[$][\w$]*)|(?P<number>\d[\w.]*)"
_LAST = r"(?P<blank>[^\S\n]+|\\\n)|(?P<sign>.)"
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
#: Names after which a slash begins a pattern, not a division.
_BEFORE_PATTERN = {"await", "case", "delete", "do", "else", "in", "instanceof", "new", "of", "return", "throw", "typeof", "void", "yield"}
_compiled: dict[Lexicon, re.Pattern[str]] = {}


def _pattern(lexicon: Lexicon) -> re.Pattern[str]:
    if lexicon not in _compiled:
        _compiled[lexicon] = re.compile(f"(?:{_PLAIN % ('ac-eg-qstv-zAC-EG-QSTV-Z' if lexicon.prefixes else 'A-Za-z')}){_BLANKS}|(?P<line>\\n{_BLANKS})|(?P<comment>{lexicon.comment})|(?:(?P<long>{lexicon.long})|(?P<short>{lexicon.short})|{_REST}){_BLANKS}|{_LAST}", re.S)
    return _compiled[lexicon]


@dataclass
class Tokens:
    kind: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    line: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    #: whether only blanks stand before a token on its line, and how many
    indent: list[int] = field(default_factory=list)
    #: the text of names and signs, empty for the others
    code: list[str] = field(default_factory=list)
    broken: bool = False

    def __len__(self) -> int:
        return len(self.text)

    def at(self, i: int) -> str:
        """The name or sign at a place; empty for strings, numbers and places outside."""
        return self.code[i] if 0 <= i < len(self.code) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == NAME

    def is_string(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == STRING

    def closing(self, i: int) -> int:
        """Place of the bracket that closes the one at ``i``; the end of the tokens where none does."""
        d, close, j = self.depth[i], OPEN[self.text[i]], i
        while (j := self.find(close, j + 1)) < len(self.code) and self.depth[j] != d:
            pass
        return j

    def find(self, code: str, i: int, end: int | None = None) -> int:
        """Place of the first such name or sign from ``i`` on; the end where there is none before it."""
        end = len(self.code) if end is None else end
        try:
            return self.code.index(code, i, end)
        except ValueError:
            return end


def _template_end(text: str, i: int) -> int:
    """Where the template that begins at ``i`` ends, expressions in it included; -1 where it doesn't."""
    stack, i = ["`"], i + 1
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif stack[-1] == "`":
            if c == "`":
                stack.pop()
                if not stack:
                    return i + 1
            elif text.startswith("${", i):
                stack.append("{")
                i += 1
        elif c in "{`":
            stack.append(c)
        elif c == "}":
            stack.pop()
        elif c in "\"'":
            end = text.find(c, i + 1)
            i = end if 0 < end and "\n" not in text[i:end] else i
        i += 1
    return -1


def _comment_end(text: str, i: int) -> int:
    """Where a block comment that may hold others ends; -1 where it doesn't."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, i):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return -1


def tokens(text: str, lexicon: Lexicon) -> Tokens:
    stack, line, i, depth, indent, broken = [], 1, 0, 0, 0, False
    rows: list[tuple[str, str, int, int, int, str]] = []
    add, finditer, size = rows.append, _pattern(lexicon).finditer, len(text)

    while i < size:
        for m in finditer(text, i):
            group = m.lastindex
            found = m[group]
            if group == _WORD:
                add((NAME, found, line, depth, indent, found))
                indent = -1
                continue
            if group == _MARK:
                add((SIGN, found, line, depth, indent, found))
                indent = -1
                continue
            if group == _LINE:
                line += 1
                indent = len(found) - 1
                continue
            if group == _BRACKET:
                if found in OPEN:
                    add((SIGN, found, line, depth, indent, found))
                    stack.append(found)
                    depth += 1
                else:
                    add((SIGN, found, line, depth - (bool(stack) and stack[-1] == CLOSE[found]), indent, found))
                    if stack and stack[-1] == CLOSE[found]:
                        stack.pop()
                        depth -= 1
                    else:
                        broken = True
                indent = -1
                continue
            kind, jump, lines = m.lastgroup, -1, 0
            if kind == "name":
                kind = NAME
                code = found
            elif kind == "number":
                code = ""
            elif kind == "blank":
                indent = indent + len(found) if indent >= 0 and found != "\\\n" else indent
                line += found.count("\n")
                continue
            elif kind == "comment":
                line += found.count("\n")
                continue
            elif kind != "sign":
                lines = found.count("\n")
                quoted = found.lstrip("rRbBuUfF#")
                edge = 3 if quoted[:3] in ('"""', "'''") and len(quoted) >= 6 else 1
                kind, code, found = STRING, "", quoted.rstrip("#")[edge:-edge]
            else:
                kind, code, start = SIGN, found, m.start()
                if found == "/":
                    if text.startswith("/*", start):
                        end = _comment_end(text, start) if lexicon.nested_comments else -1
                        if end < 0 and (lexicon.nested_comments or lexicon.comment.startswith("//")):
                            broken, i = True, size
                            break
                        if end > 0:
                            line += text.count("\n", start, end)
                            i = end
                            break
                    elif lexicon.templates:
                        before = rows[-1] if rows else None
                        value = before and (before[0] != SIGN and before[1] not in _BEFORE_PATTERN or before[1] in (")", "]", "}"))
                        pattern = None if value else _REGEX.match(text, start)
                        if pattern:
                            kind, code, jump = NUMBER, "", pattern.end()
                elif found == "`" and lexicon.templates:
                    end = _template_end(text, start)
                    if end > 0:
                        kind, code, found, jump = TEMPLATE, "", text[start + 1 : end - 1], end
                        lines = text.count("\n", start, end)
                    else:
                        broken = True
            add((kind, found, line, depth, indent, code))
            indent = -1
            line += lines
            if jump >= 0:
                i = jump
                break
        else:
            i = size
    return Tokens(*map(list, zip(*rows)), broken=broken or bool(stack)) if rows else Tokens(broken=broken or bool(stack))
