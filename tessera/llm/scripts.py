"""Shell and YAML, whose words depend on where they stand: readers of their own for the syntax check."""

from __future__ import annotations

import re

from tessera.llm.lexing import ERROR

# The shell's reserved words and the classes they get.
RESERVED = {"if": "{I", "then": "T", "elif": "l", "else": "L", "fi": "}I", "for": "F", "select": "F", "while": "W", "until": "W", "do": "{D", "done": "}D", "case": "{S", "esac": "}S", "{": "{C", "}": "}C", "!": "!", "function": "f", "time": "!", "coproc": "!"}
HERE = re.compile(r"<<(-?)[ \t]*(['\"]?)([\w.\-]+)\2")
#: redirections, and those that are whole in themselves
REDIRECT = re.compile(r"(?:\d+|\{\w+\})?(?:&>>?|>>|>\||>&|<&|<<<|<>|>(?!\()|<(?!\())")
REDIRECT_WHOLE = re.compile(r"(?:\d+|\{\w+\})?(?:>&|<&)(?:\d+-?|-)(?![\w])")
PLAIN = re.compile(r"[^\s\"'`\\$;&|<>()]+")
CODE = re.compile(r"[^\"'`\\$()<\n#\w]+|\w+")
QUOTE = re.compile(r"\$'(?:\\[\s\S]|[^'\\])*'|'[^']*'")
ASSIGNMENT = re.compile(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=")


def skip_heredocs(text: str, at: int, waiting: list[tuple[str, str]]) -> int:
    """Where the bodies of the waiting here-documents end that begin at ``at``."""
    for dash, word in waiting:
        while at < len(text):
            end = text.find("\n", at)
            line = text[at : len(text) if end < 0 else end]
            at = len(text) if end < 0 else end + 1
            if (line.lstrip("\t") if dash else line) == word:
                break
    waiting.clear()
    return at


def nested_end(text: str, at: int) -> int:
    """End of the quotation, expansion or bracket that opens at ``at`` (at one of ``" ` ( ${ $(``), with all inside;
    -1 if the text ends first."""
    stack: list[list] = []  # mode, open case words, here-documents waiting
    i, n = at, len(text)

    def opens(i: int) -> int:
        for mark, mode in (("$(", "("), ("${", "{"), ('"', '"'), ("`", "`"), ("(", "(")):
            if text.startswith(mark, i):
                stack.append([mode, 0, []])
                return i + len(mark)
        return i

    i = opens(i)
    while stack and i < n:
        mode = stack[-1]
        c = text[i]
        if c == "\\":
            i += 2
        elif mode[0] == "`":
            if c == "`":
                stack.pop()
            i += 1
        elif mode[0] == '"':
            if c == '"':
                stack.pop()
                i += 1
            elif c == "`" or text.startswith(("$(", "${"), i):
                i = opens(i)
            else:
                i += 1
        elif c in '"`' or text.startswith(("$(", "${"), i):
            i = opens(i)
        elif c == "'" or text.startswith("$'", i):
            m = QUOTE.match(text, i)
            if not m:
                return -1
            i = m.end()
        elif mode[0] == "{":
            if c == "}":
                stack.pop()
            i += 1
        elif c == "(":
            i = opens(i)
        elif c == ")":
            if not mode[1]:
                stack.pop()
            i += 1
        elif c == "#" and text[i - 1] in " \t\n;(":
            end = text.find("\n", i)
            i = n if end < 0 else end
        elif c == "<" and (m := HERE.match(text, i)) and not text.startswith("<<<", i):
            mode[2].append((m[1], m[3]))
            i = m.end()
        elif c == "\n":
            i = skip_heredocs(text, i + 1, mode[2])
        else:
            m = CODE.match(text, i)
            if m is None:
                i += 1
                continue
            mode[1] += (m[0] == "case") - (m[0] == "esac" and mode[1] > 0)
            i = m.end()
    return -1 if stack else i


def word_end(text: str, at: int) -> int:
    """End of the shell word at ``at``; -1 if the text ends inside it."""
    i, n = at, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "'" or text.startswith("$'", i):
            m = QUOTE.match(text, i)
            if not m:
                return -1
            i = m.end()
        elif c in '"`' or text.startswith(("$(", "${"), i) or text.startswith(('$"',), i):
            i = nested_end(text, i + (text.startswith('$"', i)))
        elif c == "$":
            i += 1 + (i + 1 < n and text[i + 1] in "?#@*!$-")
        elif c == "(" and i > at and (text[i - 1] in "?*+@!" or ASSIGNMENT.fullmatch(text, at, i)):
            i = nested_end(text, i)
        else:
            m = PLAIN.match(text, i)
            if not m:
                break
            i = m.end()
        if i < 0:
            return -1
    return min(i, n)


def test_end(text: str, at: int) -> int:
    """End of the [[ ]] that opens at ``at``; -1 if it doesn't end or ends on an operator."""
    i, n, last = at + 2, len(text), "["
    while i < n:
        if text[i] in " \t\n":
            i += 1
        elif text.startswith("]]", i) and (i + 2 >= n or text[i + 2] in " \t\n;&|)"):
            return i + 2 if last == "w" else -1
        elif text.startswith(("&&", "||"), i):
            i, last = i + 2, "&"
        elif text[i] in "()<>" or (text[i] == "!" and text[i + 1 : i + 2] in (" ", "(")):
            last = "w" if text[i] == ")" else "&"
            i += 1
        elif text.startswith("=~", i):
            i += 2
            while i < n and text[i] in " \t":
                i += 1
            depth = 0
            while i < n and (depth or text[i] not in " \t\n"):
                if text[i] in "\"'`$" and not text.startswith(("$ ", "$)", "$|"), i):
                    end = word_end(text, i)
                    if end <= i:
                        return -1
                    i = end
                    continue
                depth += (text[i] == "(") - (text[i] == ")")
                i += 2 if text[i] == "\\" else 1
            last = "w"
        else:
            end = word_end(text, i)
            if end <= i:
                return -1
            i, last = end, "w"
    return -1


def shell_tokens(text: str) -> list[tuple[str, int]]:
    """Classes of a shell script: w word, v name of a loop, K its ``in``, N line end, ; A E operators (one command ends, chained,
    a case clause ends), > redirection, q end of a case pattern, reserved words where a command may begin.
    Groups open with '{' + letter and close with '}' + letter."""
    out: list[tuple[str, int]] = []
    at, n, command = 0, len(text), True
    waiting: list[tuple[str, str]] = []
    groups: list[list[str]] = []  # letter, and for case where it is: word, in, pattern, body
    expect = ""
    while at < n:
        c = text[at]
        place = groups[-1][1] if groups and groups[-1][0] == "S" else ""
        if c in " \t\r" or text.startswith("\\\n", at):
            at += 2 if c == "\\" else 1
            continue
        if c == "#" and (at == 0 or text[at - 1] in " \t\n;(&|"):
            end = text.find("\n", at)
            at = n if end < 0 else end
            continue
        if c == "\n":
            at = skip_heredocs(text, at + 1, waiting)
            out.append(("N", at))
            command = True
            continue
        m = HERE.match(text, at)
        if m and not text.startswith("<<<", at):
            waiting.append((m[1], m[3]))
            at = m.end()
            continue
        if c == "(" and place == "pattern":
            at += 1
            continue
        if text.startswith("((", at) and (command or expect == "name"):
            end = nested_end(text, at)
            if end < 0:
                out.append((ERROR, at))
                return out
            if text[end - 2] == ")" or expect:
                out.append(("v" if expect else "w", at))
                at, command, expect = end, bool(expect), ""
                continue
        m = REDIRECT_WHOLE.match(text, at)
        if m and (at == 0 or text[at - 1] in " \t\n;&|()" or not c.isdigit()):
            at = m.end()
            continue
        m = REDIRECT.match(text, at)
        if m and (not c.isdigit() or text[at - 1] in " \t\n;&|()"):
            out.append((">", at))
            at = m.end()
            continue
        if text.startswith(("<(", ">("), at):
            end = nested_end(text, at + 1)
            if end < 0:
                out.append((ERROR, at))
                return out
            out.append(("w", at))
            at, command = end, False
            continue
        if c in ";&|":
            mark = next(x for x in (";;&", ";;", ";&", "&&", "||", "|&", c) if text.startswith(x, at))
            kind = "E" if mark[:2] in (";;", ";&") else "A" if mark in ("&&", "||", "|&", "|") else ";"
            out.append((kind, at))
            at += len(mark)
            command = True
            if kind == "E" and place == "body":
                groups[-1][1] = "pattern"
            continue
        if c == "(":
            empty = re.match(r"\(\s*\)", text[at : at + 8])
            if empty and out and out[-1][0] == "w":
                out.append(("Q", at))
                at, command = at + empty.end(), True
                continue
            out.append(("{P", at))
            groups.append(["P", ""])
            at, command = at + 1, True
            continue
        if c == ")":
            if place == "pattern":
                groups[-1][1] = "body"
                out.append(("q", at))
                command = True
            elif groups and groups[-1][0] == "P":
                groups.pop()
                out.append(("}P", at))
                command = False
            else:
                out.append((")", at))
                command = True
            at += 1
            continue
        start = at
        if command and text.startswith("[[", at) and text[at + 2 : at + 3] in (" ", "\t", "\n") and place not in ("word", "in", "pattern"):
            at = test_end(text, at)
            if at < 0:
                out.append((ERROR, start))
                return out
            out.append(("w", start))
            command = False
            continue
        at = word_end(text, at)
        if at <= start:
            out.append((ERROR, start))
            return out
        word = text[start:at]
        if expect == "name":
            out.append(("v" if re.fullmatch(r"[A-Za-z_]\w*", word) else ERROR, start))
            expect = "in"
            command = True
        elif expect == "in" and word == "in":
            out.append(("K", start))
            expect, command = "", False
        elif expect == "function":
            out.append(("w", start))
            expect, command = "", True
        elif place == "word":
            out.append(("w", start))
            groups[-1][1] = "in"
        elif place == "in":
            out.append(("K" if word == "in" else ERROR, start))
            groups[-1][1] = "pattern"
        elif (command or place == "pattern") and word in RESERVED and (place != "pattern" or word == "esac"):
            kind = RESERVED[word]
            expect = "name" if kind == "F" else "function" if kind == "f" else ""
            out.append((kind, start))
            if kind[0] == "{":
                groups.append([kind[1], "word" if kind == "{S" else ""])
            elif kind[0] == "}" and groups and groups[-1][0] == kind[1]:
                groups.pop()
            command = kind not in ("F", "{S", "f")
        else:
            expect = ""
            out.append(("w", start))
            command = command and bool(ASSIGNMENT.match(word))
    return out


SIMPLE = r"(?:(?:w|>w)+|[ICpS](?:>w)*)"
FIRST = rf"(?:!*(?:(?:w|>w)+|fwQ?N*[CpIS](?:>w)*|wQN*[CpIS](?:>w)*|[ICpS](?:>w)*|Fv(?:N*Kw*)?[;N]*D(?:>w)*|W(?:N*!*{SIMPLE}(?:AN*!*{SIMPLE})*(?:;N*|N+))+D(?:>w)*))"
SHELL_ENDS = {x.lower() if x == "P" else x: ("{" + x, "}" + x) for x in "IDSCP"}


def shell_productions() -> dict[str, str]:
    pipe = rf"(?:{FIRST}(?:AN*{FIRST})*)"
    stop = r"(?:;N*+|N++)"
    lines = rf"(?:N*(?>{pipe}(?:{stop}|$))*+)"
    some = rf"(?:N*(?>{pipe}{stop})++)"
    some_p = rf"(?:N*(?>{pipe}(?:{stop}|$))++)"
    case = rf"wN*KN*(?:w(?:Aw)*qN*(?:{pipe}(?:;|N)*)*(?:E|$)N*)*"
    return {"file": lines, "I": rf"{some}T{some}(?:l{some}T{some})*(?:L{some})?", "D": some, "C": some, "P": some_p, "S": case}


def shell_shapes(tokens: list[tuple[str, int]]) -> set[tuple[str, str]]:
    out: set[tuple[str, str]] = set()
    stack: list[tuple[str, list[str]]] = [("file", [])]
    for kind, _ in tokens:
        if kind[0] == "{" and len(kind) == 2:
            stack.append((kind[1], []))
        elif kind[0] == "}" and len(kind) == 2:
            if stack[-1][0] != kind[1]:
                out.add(("file", ERROR + kind))
                return out
            name, inner = stack.pop()
            out.add((name, "".join(inner)))
            stack[-1][1].append("p" if name == "P" else name)
        else:
            stack[-1][1].append(kind)
    if len(stack) > 1:
        out.add(("file", ERROR + "open" + stack[-1][0]))
    while stack:
        name, inner = stack.pop()
        if name != "file":
            continue
        out.add((name, "".join(inner)))
    return out


# YAML: lines against a strict layout; what doesn't fit is flagged and read exactly where a reader is at hand
YAML_QUOTED = r"(?:\"(?:\\[\s\S]|[^\"\\])*\"|'(?:''|[^'])*')"
YAML_STRING = re.compile(YAML_QUOTED)
YAML_MARKS = re.compile(r"(?:[&!][^\s,\[\]{}]*[ \t]+)*")
YAML_ONLY_MARKS = re.compile(r"(?:[&!][^\s,\[\]{}]*[ \t]*)+(?:#.*)?$")
YAML_KEY = re.compile(rf"(?:{YAML_QUOTED}|\*[^\s:]+[ \t]|(?:[^\s\-?:,\[\]{{}}#&*!|>'\"%@`]|[\-?:](?=\S))(?:[^:#\n]|:(?=\S)|(?<=\S)#)*?)[ \t]*:(?=[ \t]|$)")
YAML_SCALAR = re.compile(r"(?:(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=\S))(?:[^:#\n]|:(?=\S)|(?<=\S)#)*|\*[^\s,\[\]{}]+)[ \t]*(?:#.*)?$")
YAML_BLOCK = re.compile(r"[|>][+\-\d]*[ \t]*(?:#.*)?$")
YAML_REST = re.compile(r"[ \t]*(?:(?<=[ \t])#.*|#.*)?$")
YAML_FLOW_PLAIN = re.compile(r"(?:[^\s\[\]{},:#\"'`@%|>]|:(?=[^\s,\[\]{}]))(?:[^\[\]{},:#\n]|:(?=[^\s,\[\]{}])|(?<=\S)#)*")


def flow_end(text: str, at: int) -> int:
    """End of the flow collection that opens at ``at``; -1 where it doesn't close or its entries aren't separated."""
    stack: list[list] = []  # bracket, last thing, whether the entry has had its colon
    i, n, broke = at, len(text), False
    while i < n:
        c = text[i]
        top = stack[-1] if stack else ["", "", False]
        if c.isspace():
            broke = broke or c == "\n"
            i += 1
            continue
        if c == "#" and text[i - 1] in " \t\n":
            end = text.find("\n", i)
            i = n if end < 0 else end
            continue
        if c in "[{":
            if top[1] == "v":
                return -1
            stack.append([c, "", False])
        elif c in "]}":
            if not stack or (top[0] == "[") != (c == "]"):
                return -1
            stack.pop()
            if not stack:
                return i + 1
            stack[-1][1] = "v"
        elif c == ",":
            if not top[1] and not top[2]:
                return -1
            top[1], top[2] = "", False
        elif c == ":" and (i + 1 >= n or text[i + 1] in " \t\n,[]{}" or top[1] == "v"):
            if top[2]:
                return -1
            top[1], top[2] = "", True
        elif c in "\"'":
            m = YAML_STRING.match(text, i)
            if not m or top[1] == "v":
                return -1
            i, top[1], broke = m.end(), "v", False
            continue
        else:
            m = YAML_FLOW_PLAIN.match(text, i)
            if m is None or (top[1] == "v" and not broke):
                return -1
            i, top[1], broke = m.end(), "v", False
            continue
        i += 1
        broke = False
    return -1


def yaml_tokens(text: str) -> list[tuple[str, int]]:
    """Classes of a YAML text: Y document mark, - item, k key, s scalar, f flow, b block scalar, t text without a key;
    > and < where the indentation grows and shrinks; a line that may have children ends in ':', any other in ';', text in '.'."""
    out: list[tuple[str, int]] = []
    levels: list[tuple[int, str]] = [(-1, "")]
    at, n, block = 0, len(text), -1
    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        line = text[at:end]
        bare = line.strip()
        indent = len(line) - len(line.lstrip(" "))
        if block >= 0 and (not bare or indent > block):
            at = end + 1
            continue
        block = -1
        if not bare or bare.startswith("#"):
            at = end + 1
            continue
        if re.match(r"(?:---|\.\.\.)(?:\s|$)|%[A-Z]", line):
            out.append(("Y", at))
            levels = [(-1, "")]
            if not line.startswith("---") or not line[3:].strip() or line[3:].strip().startswith("#"):
                at = end + 1
                continue
            line = "   " + line[3:]
            indent = len(line) - len(line.lstrip(" "))
        i = at + indent
        rest = line[indent:]
        if rest.startswith("\t"):
            out.append((ERROR, at))
            return out
        first = True
        while rest == "-" or rest.startswith("- ") or re.match(r"[?:](?: |$)", rest):
            kind = "-" if rest[0] == "-" else "k"
            place(levels, i - at, kind, out, at, first)
            out.append((kind, i))
            first = False
            after = rest[1:].lstrip(" ")
            i += len(rest) - len(after)
            rest = after
        marks = YAML_MARKS.match(rest)[0]
        i += len(marks)
        rest = rest[len(marks) :]
        m = YAML_KEY.match(rest)
        keyed = bool(m)
        if m:
            place(levels, i - len(marks) - at, "k", out, at, first)
            out.append(("k", i))
            first = False
            i += m.end()
            rest = rest[m.end() :]
            gap = len(rest) - len(rest.lstrip(" \t"))
            i += gap
            rest = rest[gap:]
            marks = YAML_MARKS.match(rest)[0]
            i += len(marks)
            rest = rest[len(marks) :]
        if not rest or rest.startswith("#") or YAML_ONLY_MARKS.match(rest):
            if not first:
                out.append((":", i))
            at = end + 1
            continue
        alone = first and not keyed
        if YAML_BLOCK.match(rest):
            block = indent if not alone else levels[-1][0]
            out += [("b", i), (";", i)]
        elif rest[0] in "[{" or rest[0] in "\"'":
            found = YAML_STRING.match(text, i) if rest[0] in "\"'" else None
            stop = flow_end(text, i) if rest[0] in "[{" else found.end() if found else -1
            if stop < 0:
                out.append((ERROR, i))
                return out
            end = text.find("\n", stop)
            end = n if end < 0 else end
            if not YAML_REST.match(text[stop:end]):
                out.append((ERROR, stop))
                return out
            if alone and indent <= levels[-1][0] or (alone and levels[-1][0] < 0 and out and out[-1][0] not in ("Y", ERROR)):
                out.append((ERROR, i))
            if alone and levels[-1][0] < 0:
                out += [("t", i), (".", i)]
            else:
                out += [("f" if rest[0] in "[{" else "s", i), (";", i)]
        elif YAML_SCALAR.match(rest):
            if alone:
                last = out[-1][0] if out else "Y"
                if levels[-1][0] < 0 and last in "Y.":
                    if last != ".":
                        out += [("t", i), (".", i)]
                elif indent <= levels[-1][0] or last not in (";", ":"):
                    out.append((ERROR, i))
                    return out
                elif last == ":":
                    out += [("s", i), (";", i)]
                # a deeper line after a scalar carries it on
            else:
                out += [("s", i), (";", i)]
        else:
            out.append((ERROR, i))
            return out
        at = end + 1
    return out


def place(levels: list[tuple[int, str]], column: int, kind: str, out: list[tuple[str, int]], at: int, first: bool) -> None:
    """Indentations must return to one that is open, with a node of the same kind."""
    popped = False
    while levels[-1][0] > column:
        levels.pop()
        popped = True
    if levels[-1][0] == column:
        if levels[-1][1] == "-" and kind == "k" and (column, "k") in levels:
            levels.pop()  # items at the column of their key end
        if levels[-1][1] == kind:
            if popped and first:
                out.append(("<", at))
        elif levels[-1][1] == "k" and kind == "-":
            if first and out and out[-1][0] != ":":
                out.append((ERROR, at))
            levels.append((column, kind))
        else:
            out.append((ERROR, at))
    elif popped:
        out.append((ERROR, at))
    else:
        if first and levels[-1][0] >= 0:
            out.append((">", at))
        levels.append((column, kind))


def yaml_shapes(tokens: list[tuple[str, int]]) -> set[tuple[str, str]]:
    """One shape a line, without its end."""
    return {("line", part) for part in re.split(r"[;:.<>Y]", "".join(k for k, _ in tokens)) if part}


YAML_LINE = r"(?:-*(?:k:[<>]?|k+[sfb];<?|[sfb];<?|-:[<>]?))"
YAML_PRODUCTIONS = {"line": r"[-k]*(?:[sfb]|t)?", "file": rf"(?:Y|t\.(?=Y|$)|{YAML_LINE}*(?:Y|$))*"}
