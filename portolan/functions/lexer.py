"""What a file defines, told from its code alone: strings and comments do not count, blocks nest."""

from __future__ import annotations

import re
from collections import deque

C_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
TEXT, LETTER, TEMPLATE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])'", r"`(?:\\.|[^`\\])*`?"
QUOTED = r"'(?:\\.|[^'\\\n])*'?"
TRIPLE = r'"""(?:\\.|.)*?(?:"""|\Z)|\'\'\'(?:\\.|.)*?(?:\'\'\'|\Z)'

#: What is no code, by language; languages with braces end their blocks by them, others by indent.
BRACES = {
    **dict.fromkeys("java c cpp c_sharp kotlin scala swift rust".split(), "|".join((C_COMMENTS, TRIPLE, TEXT, LETTER))),
    **dict.fromkeys("javascript typescript go".split(), "|".join((C_COMMENTS, TEXT, QUOTED, TEMPLATE))),
    "php": "|".join((C_COMMENTS, r"#[^\n]*", TEXT, QUOTED)),
}
HIDDEN = {
    **{k: re.compile(v, re.S) for k, v in BRACES.items()},
    "python": re.compile("|".join((r"#[^\n]*", TRIPLE, TEXT, QUOTED)), re.S),
    "ruby": re.compile("|".join((r"#[^\n]*", TEXT, QUOTED)), re.S),
}
OTHER = re.compile("|".join((C_COMMENTS, TEXT)), re.S)

# per kind of definition the start of a line that makes one; the name is the last group
DEFINITIONS = [
    ("class_definition", re.compile(r"\s*(?:(?:public|private|protected|abstract|final|static|export|default|sealed|data)\s+)*(?:class|interface|trait|struct|enum)\s+(\w+)")),
    ("function_definition", re.compile(r"\s*(?:(?:public|private|protected|static|final|async|export|pub|override)\s+)*(?:def|function|func|fn)\s+(\w+)")),
    ("function_definition", re.compile(r"\s*(?:(?:public|private|protected|static|final|synchronized)\s+)+[\w<>\[\].]+\s+(\w+)\s*\(")),
    ("import", re.compile(r"\s*(?:import|from|use|require|#include|using)\b")),
    ("variable", re.compile(r"(?:(?:const|let|var|final|static)\s+)*(\w+)\s*(?::\s*\w+\s*)?=[^=]")),
]
IMPORTED = re.compile(r"\s*(?:import|from|use|require|#include|using)\s+[\"'<]?([\w.:/*\-]+)")


def masked(text: str, language: str | None) -> str:
    """The text with every character of a string or comment as a blank; lines and places stay."""
    return HIDDEN.get(language, OTHER).sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def defined(text: str, language: str | None) -> list[tuple[str, str, int, int, str | None]]:
    """``(kind, name, first line, last line, scope)`` of classes, functions, imports and module variables, in order.

    ``scope`` is the name of the innermost definition around it. A block ends at the brace that closes it, in languages without braces
    before the next line that is indented no deeper. A definition without a block ends with its statement.
    """
    code = masked(text, language)
    lines, raw = code.split("\n"), text.split("\n")
    found: list[list] = []
    for no, line in enumerate(lines):
        for kind, pattern in DEFINITIONS:
            hit = pattern.match(line)
            if hit and kind == "import":
                named = IMPORTED.match(raw[no])
                if named:
                    found.append([kind, named[1], no, no, None])
                    break
            elif hit:
                found.append([kind, hit[1], no, no, None])
                break
    blocks = [d for d in found if d[0] in ("class_definition", "function_definition")]
    (_by_braces if language in BRACES else _by_indent)(code, lines, blocks)
    open_: list[list] = []
    for d in found:
        while open_ and open_[-1][3] < d[2]:
            open_.pop()
        d[4] = open_[-1][1] if open_ else None
        if d[0].endswith("definition") and d[3] > d[2]:
            open_.append(d)
    return [tuple(d) for d in found]


def _by_braces(code: str, lines: list[str], blocks: list[list]) -> None:
    """Last lines by a stack of open braces, each with the definition it opens; a statement's end closes one that opens none."""
    queue, stack = deque(blocks), []
    waiting, parens, no = None, 0, 0
    for m in re.finditer(r"[{}();\n]", code):
        if queue and queue[0][2] <= no:
            waiting, parens = queue.popleft(), 0
        c = m.group()
        if c == "\n":
            no += 1
        elif c in "()":
            parens += 1 if c == "(" else -1
        elif c == "{":
            stack.append(waiting)
            waiting = None
        elif c == "}":
            owner = stack.pop() if stack else None
            if owner is not None:
                owner[3] = no
        elif parens <= 0 and waiting is not None:
            waiting[3], waiting = no, None
    for owner in stack:
        if owner is not None:
            owner[3] = len(lines) - 1


def _by_indent(code: str, lines: list[str], blocks: list[list]) -> None:
    """Last lines by indent: the line before the next one that is no deeper and closes nothing."""
    deep = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]
    open_: list[tuple[int, list]] = []
    starts = {d[2]: d for d in blocks}
    for no, depth in enumerate(deep):
        if depth is None:
            continue
        if lines[no].lstrip()[0] not in "})]":
            while open_ and open_[-1][0] >= depth:
                open_.pop()[1][3] = no - 1
        if no in starts:
            open_.append((depth, starts[no]))
    for _, d in open_:
        d[3] = len(lines) - 1
