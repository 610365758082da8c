"""Source text to class symbols, one character a token, for the syntax check.

A language has a lexer (patterns in order), keyword classes and bracket groups. ``shapes`` reduces a
text innermost group first: a bracket group becomes one symbol of its surroundings, so every group, and
the file itself, is a short string of classes. Identifiers, numbers and strings lose their spelling, so a corpus has
few distinct shapes however many files it has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

OPEN, CLOSE = "([{", ")]}"
GROUP = {"(": "P", "[": "B", "{": "C"}
ERROR = "\x00"


@dataclass
class Lexer:
    patterns: list[tuple[str, str]]
    words: dict[str, str]
    #: classes after which a line end separates statements, and classes which may begin one (None: all)
    ends: str = ""
    starts: str | None = ""
    newline: bool = False
    #: whose type argument lists in <> are read over: "ts", "java", "rust" or none
    angles: str = ""
    regexes: bool = False
    markup: bool = False
    #: classes a token has after another one: {(class before, class): class}
    after: dict[tuple[str, str], str] = field(default_factory=dict)
    rule: re.Pattern = field(init=False)

    def __post_init__(self) -> None:
        self.rule = re.compile("|".join(f"(?P<g{i}>{p})" for i, (p, _) in enumerate(self.patterns)))

    def tokens(self, text: str) -> list[tuple[str, int, bool]]:
        """(class, offset, a line end stands before it); the class of what can't be read is ERROR."""
        out: list[tuple[str, int, bool]] = []
        at, broke, n = 0, False, len(text)
        match, patterns, words, angles = self.rule.match, self.patterns, self.words, self.angles
        open_: list[tuple[str, int]] = []  # brackets, and the '<' that may be lists, with their place in out
        marked = self.markup and ("</" in text or "/>" in text)
        while at < n:
            c = text[at]
            if c == "\n":
                broke = True
                at += 1
                continue
            if c in " \t\f\v ﻿":
                at += 1
                continue
            before = out[-1][0] if out else ""
            if self.regexes and c == "/" and text[at + 1 : at + 2] not in ("/", "*") and (not before or before not in "insE)]}xjqmky"):
                m = REGEX.match(text, at)
                if m:
                    out.append(("n", at, broke))
                    at, broke = m.end(), False
                    continue
            if self.regexes and (c == "`" or (c == "<" and marked and (not before or before not in "insE)]xjqmky" or broke) and MARKUP.match(text, at))):
                end = opaque_end(text, at, self.markup)
                if end > 0:
                    out.append(("E" if c == "`" else "n", at, broke))
                    at, broke = end, False
                    continue
                marked = marked and end == 0
                if c == "`":
                    out.append((ERROR, at, broke))
                    return out
            if angles and c == "<" and text[at + 1 : at + 2] not in ("=", "<") and opens_list(angles, before, broke):
                open_.append(("<", len(out)))
                out.append(("o", at, broke))
                at, broke = at + 1, False
                continue
            if angles and c == ">" and open_ and open_[-1][0] == "<" and text[at + 1 : at + 2] != "=":
                start = open_[-1][1]
                left = out[start - 1][0] if start else ""
                if closes_list(angles, text, at, left):
                    open_.pop()
                    broke = out[start][2]
                    place = out[start][1]
                    del out[start:]
                    if angles == "rust":
                        if left in (".", "f"):  # a::<T>, for<'a>
                            out.pop()
                        elif left not in ("i", "J", "F"):  # <T as U>::f
                            out.append(("i", place, broke))
                            broke = False
                    at += 1
                    continue
            m = match(text, at)
            if not m or m.end() == at:
                out.append((ERROR, at, broke))
                at, broke = at + 1, False
                continue
            kind = patterns[int(m.lastgroup[1:])][1]
            value = m[0]
            if kind == "word":
                kind = words.get(value, "i")
                kind = "W" if before == "." and value == "new" and angles == "java" else "i" if before == "." else kind
            if kind == "comment":
                broke = broke or "\n" in value
            elif kind:
                kind = value if kind in ("bracket", "self") else self.after.get((before, kind), kind)
                if angles and open_:
                    if kind in CLOSE:
                        while open_ and open_[-1][0] == "<":
                            open_.pop()
                        if open_:
                            open_.pop()
                    elif open_[-1][0] == "<" and breaks_list(angles, kind, value, before, len(out) - 1 == open_[-1][1]):
                        while open_ and open_[-1][0] == "<":
                            open_.pop()
                if angles and kind in OPEN:
                    open_.append((kind, len(out)))
                out.append((kind, at, broke))
                broke = False
            at = m.end()
        return out


REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
LIST_BEFORE = {"ts": "nsE)]x", "java": "nsx)]", "rust": "ns)]}?"}
#: classes that may stand in a type argument list
LIST_CLASSES = {"ts": "ijqmkynsEuVcGo.,:?aeWMDK([{", "java": "ir.,?o@nG[", "rust": "i'.,:poedJFfnsmc[({a?Dk!"}
LIST_SIGNS = {"ts": ("|", "&", "in", "="), "java": ("&",), "rust": ("+", "=", "-", "&", "*")}
AFTER_LIST = re.compile(r"[ \t]*(?:$|[\r\n()\[\]{}.,;:=|&?>!`]|//|/\*|(?:extends|implements|is|as|satisfies|in)\b)")
AFTER_RUST_LIST = re.compile(r"\s*(?:(?:where|for|as|in)\b|[^\w\"'\s]|$)")


def opens_list(angles: str, before: str, broke: bool) -> bool:
    return not before or before not in LIST_BEFORE[angles] and (before != "}" or broke or angles == "java")


def closes_list(angles: str, text: str, at: int, left: str) -> bool:
    """Whether what follows a '>' fits the end of a list; left is the class before its '<'."""
    if angles == "ts":
        return not left or left not in "ijqmky" or bool(AFTER_LIST.match(text, at + 1))
    if angles == "rust":
        return left != "i" or bool(AFTER_RUST_LIST.match(text, at + 1))
    return True


def breaks_list(angles: str, kind: str, value: str, before: str, first: bool) -> bool:
    """Whether a token shows that the '<' before it is a comparison."""
    if kind not in LIST_CLASSES[angles] or (kind in "oep" and value not in LIST_SIGNS[angles]):
        return True
    if kind in "insE" and before in "insE" and not first and not (angles == "java" and before == "n"):
        return True
    if angles == "java":
        return kind == "?" and before not in ("o", ",", "i")
    if kind == "{":
        return not first and before not in (",", "e") if angles == "rust" else not first and before not in tuple(",:oeGa?")
    return False


MARKUP = re.compile(r"<(?:>|[A-Za-z_$][\w$.:\-]*(?:<[^<>(){}]*>)?(?=[\s/>{]))")
MARKUP_END = re.compile(r"</\s*[\w$.:\-]*\s*>")
MARKUP_PARTS = re.compile(r"(?:\s+|/\*[\s\S]*?\*/|[\w$.:\-]+|=\s*(?:\"[^\"]*\"|'[^']*')|=(?=\s*[{<]))*+")
MARKUP_TEXT = re.compile(r"[^<{]*+")
TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")
CODE_PART = re.compile(r"\s+|//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'|[\w$]+|[^\s\"'`{}</\w$]")


def opaque_end(text: str, at: int, markup: bool) -> int:
    """End of the template literal or markup element that begins at ``at``, with all the code, templates and
    elements inside; 0 if it isn't one, -1 if the text ends first."""
    stack: list[list] = [["`" if text[at] == "`" else "<", 0]]  # template, element with its depth, code with its last sign
    i, n = at + (text[at] == "`"), len(text)
    while i < n:
        mode = stack[-1]
        c = text[i]
        if mode[0] == "`":
            i = TEMPLATE_TEXT.match(text, i).end()
            if i >= n:
                break
            if text[i] == "`":
                i += 1
                stack.pop()
            else:
                i += 2
                stack.append(["{", "{"])
        elif mode[0] == "{":
            if c == "}":
                i += 1
                stack.pop()
            elif c == "{":
                i += 1
                stack.append(["{", "{"])
                mode[1] = ")"
                continue
            elif c == "`":
                mode[1] = ")"
                stack.append(["`", 0])
                i += 1
                continue
            elif c == "<" and markup and mode[1] in "({[,;:?=&|>r" and MARKUP.match(text, i):
                mode[1] = ")"
                stack.append(["<", 0])
                continue
            elif c == "/" and mode[1] in "({[,;:?=&|>r!" and text[i + 1 : i + 2] not in ("/", "*") and (m := REGEX.match(text, i)):
                i, mode[1] = m.end(), ")"
                continue
            else:
                m = CODE_PART.match(text, i)
                if m is None:
                    if c in "\"'":
                        return 0
                    i, mode[1] = i + 1, c
                    continue
                part = m[0]
                i = m.end()
                if not part.isspace() and not part.startswith(("//", "/*")):
                    mode[1] = "r" if part in ("return", "default", "case") else ")" if part[0] in "\"'" or part[0].isalnum() else part
                continue
        elif mode[0] == "=":  # the attributes of a tag
            i = MARKUP_PARTS.match(text, i).end()
            if i >= n:
                break
            if text[i] == "{":
                i += 1
                stack.append(["{", "{"])
            elif text[i] == "<" and MARKUP.match(text, i):
                stack.append(["<", 0])
            elif text.startswith("/>", i):
                i += 2
                stack.pop()
                if not stack[-1][1]:
                    stack.pop()
            elif text[i] == ">":
                i += 1
                stack.pop()
                stack[-1][1] += 1
            else:
                return 0
        elif text.startswith("</", i):
            m = MARKUP_END.match(text, i)
            if not m or mode[1] < 1:
                return 0
            i = m.end()
            mode[1] -= 1
            if not mode[1]:
                stack.pop()
        elif c == "<":
            m = MARKUP.match(text, i)
            if not m:
                return 0
            i = m.end()
            if m[0] == "<>":
                mode[1] += 1
            else:
                stack.append(["=", mode])
        elif c == "{":
            i += 1
            stack.append(["{", "{"])
        else:
            i = MARKUP_TEXT.match(text, i).end()
        if not stack:
            return i
    return i if not stack else -1


def joined(tokens: list[tuple[str, int, bool]], lexer: Lexer) -> list[tuple[str, int]]:
    """Classes with line ends as ';' where they separate statements."""
    out: list[tuple[str, int]] = []
    for kind, at, broke in tokens:
        if lexer.newline and broke and out:
            last = out[-1][0]
            if last in lexer.ends and (lexer.starts is None or kind in lexer.starts):
                out.append((";", at))
        out.append((kind, at))
    return out


def pairs(classes: list[tuple[str, int]]) -> set[tuple[str, str]]:
    kinds = ["^", *[k for k, _ in classes], "$"]
    return set(zip(kinds, kinds[1:], strict=False))


def brackets(classes: list[tuple[str, int]]) -> list[tuple[int, str]]:
    return [(at, k) for k, at in classes if k in OPEN or k in CLOSE]


def shapes(classes: list[tuple[str, int]], context) -> set[tuple[str, str]]:  # noqa: ANN001
    """(context, shape) of every group and of the file. ``context(outer, before, bracket)`` names a group by
    the name of its surroundings and what stands before it there. A closing bracket without its opening one stays a symbol of its own."""
    out: set[tuple[str, str]] = set()
    stack: list[tuple[str, list[str]]] = [("file", [])]
    for kind, _ in classes:
        if kind in OPEN:
            stack.append((context(stack[-1][0], "".join(stack[-1][1]), kind), []))
        elif kind in CLOSE:
            if len(stack) == 1:
                stack[-1][1].append(kind)
                continue
            name, inner = stack.pop()
            out.add((name, "".join(inner)))
            stack[-1][1].append(GROUP[OPEN[CLOSE.index(kind)]])
        else:
            stack[-1][1].append(kind)
    while stack:
        name, inner = stack.pop()
        out.add((name, "".join(inner)))
    return out
