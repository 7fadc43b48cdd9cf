"""A lexical scanner for languages with braces: what is code, which brace closes which, and what is defined where.

One pass over the text keeps a stack of states: code, strings, templates (a string in
which ``${`` opens code again, up to its brace), comments and regular expressions.
Everything but code is blanked, character for character, so patterns over the blanked
text see neither braces nor key words of strings, and offsets stay true.  Each opening
brace gets its partner.  The pass takes time in proportion to the text, whatever its
nesting.

Definitions are patterns over the blanked text, with the range to the closing brace of
their body; a body that is never closed holds the rest of the text and gets the
nominal range of UNCLOSED lines.  Ranges nest, so a walk over them in order of their start, with a stack of
the open ones, gives each definition the one around it.
"""

from __future__ import annotations

import re
from bisect import bisect_right

TRIPLE = ("'''", '"""')
CODE = {
    "dart": re.compile(r"""//[^\n]*|/\*|r?'''|r?\"\"\"|r?'|r?"|[{}]"""),
    "": re.compile(r"""//[^\n]*|/\*|'|"|`|/|[{}]"""),
}
ENDS = re.compile(r"/\*|\*/")  # of comments, which nest in Dart
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/[a-z]*")
OPERAND = re.compile(r"(?:[\w$)\]}'\"`.]|\+\+|--)\s*\Z")  # what a division follows
WORDS = re.compile(r"(?:^|[^\w$.])(?:return|typeof|case|in|of|do|else|void|delete|throw|new|instanceof|yield|await)\s*\Z")
LINE_STRING = {q: re.compile(rf"(?:\\.|[^\\\n{q}])*+") for q in "'\""}
_inside: dict[str, re.Pattern] = {}


def _stops(quote: str) -> re.Pattern:
    """What ends or interrupts a string with code inside: an escape, a ``${`` or its end."""
    if quote not in _inside:
        _inside[quote] = re.compile(rf"\\.|\$\{{|{quote}" + ("" if len(quote) == 3 or quote == "`" else r"|\n"), re.S)
    return _inside[quote]


def scan(source: str, language: str = "") -> tuple[str, dict[int, int]]:
    """The source with all that is no code blanked, and the partner of each opening brace."""
    dart = language == "dart"
    code = CODE["dart" if dart else ""]
    keep: list[str] = []
    partner: dict[int, int] = {}
    opened: list[tuple[int, str]] = []  # place of a brace, and the quote of the string that it stands in
    at, n, quote = 0, len(source), ""

    def blank(end: int) -> None:
        nonlocal at
        keep.append(re.sub(r"[^\n]", " ", source[at:end]))
        at = end

    while at < n:
        if quote:  # inside a string that may hold code
            m = _stops(quote).search(source, at)
            blank(m.end() if m else n)
            if m and m[0] == "${":
                opened.append((at - 1, quote))
                quote = ""
            elif m and m[0] in (quote, "\n"):
                quote = ""
            continue
        m = code.search(source, at)
        if not m:
            keep.append(source[at:])
            break
        keep.append(source[at : m.start()])
        at, token = m.start(), m[0]
        if token == "{":
            opened.append((at, ""))
            keep.append(token)
            at += 1
        elif token == "}":
            if opened:
                place, quote = opened.pop()
                if quote:
                    blank(at + 1)
                else:
                    partner[place] = at
                    keep.append(token)
                    at += 1
            else:
                keep.append(token)
                at += 1
        elif token.startswith("//"):
            blank(m.end())
        elif token == "/*":
            depth, end = 1, m.end()
            while depth:
                e = ENDS.search(source, end)
                if not e:
                    end = n
                    break
                end = e.end()
                depth += -1 if e[0] == "*/" else 1 if dart else 0
            blank(end)
        elif token == "/":
            before = source[max(0, at - 64) : at]
            r = None if OPERAND.search(before) and not WORDS.search(before) else REGEX.match(source, at)
            if r:
                blank(r.end())
            else:
                keep.append(token)
                at += 1
        elif dart and token[0] == "r":
            end = source.find(token[1:], m.end())
            blank(n if end < 0 else end + len(token) - 1)
        elif dart or token == "`":
            blank(m.end())
            quote = token
        else:
            end = LINE_STRING[token].match(source, m.end()).end()
            blank(min(n, end + 1))
    return "".join(keep), partner


W = r"[^\W\d]\w*|\$[\w$]*"
SCRIPT_FORMS = [
    ("class", re.compile(rf"\bclass\s+(?P<name>{W})[^{{}};()]*(?P<open>\{{)")),
    ("interface", re.compile(rf"\b(?:interface|enum|namespace)\s+(?P<name>{W})[^{{}};()]*(?P<open>\{{)")),
    ("function", re.compile(rf"\bfunction\b\s*\*?\s*(?P<name>{W})\s*(?:<[^>]*>)?\s*\((?P<params>[^)]*)\)[^{{}};]*(?P<open>\{{)")),
    ("function", re.compile(rf"\b(?:const|let|var)\s+(?P<name>{W})[^=\n]*=\s*(?:async\s*)?\((?P<params>[^)]*)\)[^=\n]*=>[^\S\n]*(?P<open>\{{?)")),
    ("method", re.compile(rf"(?m)(?:^|(?<=[;{{}}]))[^\S\n]*(?:(?:public|private|protected|static|async|override|get|set)\s+)*(?:\*\s*)?#?(?P<name>{W})\s*(?:<[^>]*>)?\((?P<params>[^)]*)\)\s*(?::[^{{}};=]+)?(?P<open>\{{)")),
]
DART_FORMS = [
    ("class", re.compile(r"\b(?:class|mixin|enum|extension)\s+(?P<name>\w+)[^{};()]*(?P<open>\{)")),
    ("function", re.compile(r"(?<![\w.])(?:[\w?]+(?:<[^;{}()]*>)?\??)\s+(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<params>[^)]*)\)\s*(?:async\*?\s*|sync\*\s*)?(?P<open>\{|=>)")),
]
# Fixed value: lines after the first of a body whose brace is never closed.
UNCLOSED = 50
# Words before a bracket that name no function.
NOT_FUNCTIONS = frozenset(["if", "for", "while", "switch", "catch", "function", "return", "new", "else", "do", "await", "super"])


def definitions(source: str, language: str) -> list[dict]:
    """Definitions in order: name, kind, params, parent, line_start, line_end and whether they have a body in braces."""
    code, partner = scan(source, language)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda at: bisect_right(starts, at)
    found: dict[int, tuple] = {}
    for kind, pattern in DART_FORMS if language == "dart" else SCRIPT_FORMS:
        for m in pattern.finditer(code):
            before = code[max(0, m.start("name") - 12) : m.start("name")].split()
            if m["name"] in NOT_FUNCTIONS or kind == "function" and language == "dart" and before and before[-1] in ("return", "new", "await", "else", "throw"):
                continue
            place = m.start("open") if m["open"] == "{" else None
            end = partner.get(place, len(code) - 1) if place is not None else code.find(";", m.end()) if m["open"] == "=>" else m.end() - 1
            end = len(code) - 1 if end < 0 else end
            params = source[m.start("params") : m.end("params")].strip() if "params" in pattern.groupindex else None
            first = line(m.start() + len(m[0]) - len(m[0].lstrip()))
            last = first + UNCLOSED if place is not None and place not in partner else line(end)
            found.setdefault(m.start("name"), (kind, m["name"], params, first, end, last, place is not None))
    out, around = [], []
    for at in sorted(found):
        kind, name, params, first, end, last, braces = found[at]
        while around and around[-1][0] < at:
            around.pop()
        parent = around[-1] if around else None
        if kind == "method" and (parent is None or parent[2] not in ("class", "interface")):
            continue  # a call with a block after it, or a method of an object literal
        if kind == "function" and language == "dart" and parent is not None and parent[2] == "class":
            kind = "method"
        out.append({"name": name, "kind": kind, "params": params, "parent": parent[1] if parent else None, "line_start": first, "line_end": last, "braces": braces})
        around.append((end, name, kind))
    return out
