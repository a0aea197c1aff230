"""Structure of source code off a token stream: symbols and edges of eight languages.

One pass over a file makes tokens (strings, template strings, regex literals, comments and lifetimes are told apart by a
stack of modes) and links each bracket with its other end. A second pass reads declarations, inheritance, imports and calls
off the tokens; parameter lists, types and bodies are stepped over by the links. Both are linear in the file.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import numpy as np

Symbol = tuple[str, str, str, str | None, int, int, int, int]  # kind, name, qualified name, parent's, start, end, first and last line
Edge = tuple[str, str, str, float, int]  # src, dst, kind, confidence, line

#: Other names of languages (fixed values).
ALIASES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "c++": "cpp", "c": "cpp", "cs": "csharp", "golang": "go"}
SCRIPTS = ("typescript", "javascript")
TYPED = ("java", "cpp", "csharp")
#: Words that are no callees and begin no method.
WORDS = set("if for while switch catch async return function fn func typeof new await super else do try match sizeof def elif with lambda not and or in is yield throw case delete using foreach lock print assert except".split())
#: Words at which no heritage, type or signature goes on.
HALT = set("class interface struct enum trait function fn func def const let var import export return if for while switch package namespace impl use".split())
#: Of these, words that stand in types.
TYPE_WORDS = {"rust": ("impl", "for", "fn", "const"), "go": ("func", "interface", "struct"), "cpp": ("const", "struct", "enum", "class"), "typescript": ("import",)}
#: What may stand before a bracket after the parameters of a signature; any token in other languages.
CALLED_TYPES = {"java": (), "csharp": ("new", "base", "this"), "cpp": ("noexcept", "throw")}
AFTER_PARAMETERS = ("const", "noexcept", "override", "final", "volatile", "mutable", "try", "&", "&&", "async")
KINDS = {"class": "class", "struct": "class", "trait": "class", "enum": "class", "record": "class", "interface": "interface"}
#: After these a slash divides; after others it begins a regex literal.
OPERAND = re.compile(r"[\w$)\]\"'`}]\Z")
NOT_OPERAND = set("return typeof case in of delete void throw new instanceof else do await yield".split())

#: Space and line comments in a row are one match.
_COMMON = r"(?P<space>(?:\s+|//[^\n]*)+)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<block>/\*)"
_QUOTES = r"|(?P<string>\"(?:[^\"\\\n]++|\\[\s\S])*+(?P<q2>\")?|'(?:[^'\\\n]++|\\[\s\S])*+(?P<q1>')?)"
_SIGNS = r"|(?P<sign>=>|->|::|\?\.|&&|\|\||[\s\S])"
_MASTER = {
    "script": _COMMON + _QUOTES + r"|(?P<template>`)" + _SIGNS,
    "go": _COMMON + _QUOTES + r"|(?P<raw>(?P<close>`))" + _SIGNS,
    "rust": r"(?P<raw>\bb?r(?P<close>#*)\")|" + _COMMON + r"|(?P<char>'(?:\\(?:u\{\w*\}|x\w\w|[^\n])|[^'\\\n])')|(?P<string>\"(?:[^\"\\]++|\\[\s\S])*+(?P<q2>\")?)|(?P<lifetime>'\w+)" + _SIGNS,
    "cpp": r"(?P<include>^[ \t]*#[ \t]*include[ \t]*(?:<[^>\n]*>|\"[^\"\n]*\"))|(?P<raw>\bR\"(?P<close>[^()\s\\]{0,16})\()|" + _COMMON + _QUOTES + _SIGNS,
    "csharp": r"(?P<char>@\"(?:[^\"]++|\"\")*\")|" + _COMMON + _QUOTES + _SIGNS,
    "java": r"(?P<raw>(?P<close>\"\"\"))|" + _COMMON + _QUOTES + _SIGNS,
    "python": r"(?P<raw>(?:\b[rRbBuUfF]{1,2})?(?P<close>\"\"\"|'''))|(?P<space>(?:\s+|#[^\n]*)+|\\\n)|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)" + _QUOTES + r"|(?P<sign>->|[\s\S])",
}
#: How a raw string ends, by what its begin holds.
_RAW_END = {"rust": '"{}', "cpp": '){}"'}
_REGEX = re.compile(r"/(?:[^/\\\n\[]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*\]?)*+(?:/\w*)?")
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+(?P<end>`|\$\{)?")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: Words that a declaration, a name space or an import begins with, and what stands after a name that is declared or called.
_HEADS = {"import", "use", "using", "require", "from", "namespace", "extern", *KINDS, "type", "function", "fn", "func", "const", "let", "var"}
_AFTER_NAMES = {"(", "<", "!", "::"}
_PYTHON_HEADS = {"def", "class", "import", "from"}


#: What begins a raw string on a letter, and signs that _MASTER has to look at.
_RAW = {"rust": r"(?!\bb?r#*\")", "cpp": r"(?!\bR\")", "python": r"(?!\b[rRbBuUfF]{1,2}(?:\"\"\"|'''))"}
_LOOK_AT = {"python": r"\"'\\", "cpp": r"\"'/#", "csharp": r"\"'/@"}


@cache
def _plain(lang: str) -> re.Pattern:
    """The next token, space and line comments before it included: a word or number (1), a sign (2) or a bracket (3); empty (4) where _MASTER has to look."""
    python = lang == "python"
    space = r"(?:\s+|#[^\n]*)*+" if python else r"(?:\s+|//[^\n]*)*+"
    word = _RAW.get(lang, "") + (r"[^\W\d]\w*" if python else r"(?:[^\W\d]|\$)[\w$]*") + r"|\d[\w.]*"
    sign = ("->" if python else r"=>|->|::|\?\.|&&|\|\|") + r"|[^\w\s()\[\]{}" + ("" if python else "$") + _LOOK_AT.get(lang, r"\"'`/") + "]"
    return re.compile(rf"{space}(?:({word})|({sign})|([()\[\]{{}}])|())")


@cache
def _master(lang: str) -> re.Pattern:
    return re.compile(_MASTER["script" if lang in SCRIPTS else lang], re.M)


class Tokens(NamedTuple):
    """Per token its text ('' for a string), start, end, lines where it starts and ends, and whether it is the first of its line.

    ``link``: of a bracket its other end, or the number of tokens where it has none. ``within``: the bracket around the token, -1 at the top.
    """

    text: list[str]
    start: list[int]
    end: list[int]
    line: list[int]
    last: list[int]
    first: list[bool]
    link: list[int]
    within: list[int]


def normal(lang: str) -> str:
    """The language that is read; unknown ones are read as TypeScript."""
    lang = ALIASES.get(lang.lower(), lang.lower())
    return lang if lang in _MASTER or lang in SCRIPTS else "typescript"


def tokens(code: str, lang: str) -> Tokens:
    """Tokens of a file without space and comments. A quote or comment that is never closed is a sign like others."""
    t = Tokens([], [], [], [], [], [], [], [])
    match, plain, script = _master(lang).match, _plain(lang).finditer, lang in SCRIPTS
    texts, starts, ends, link, within = t.text, t.start, t.end, t.link, t.within
    open_at: list[int] = []
    around = -1  # the last of them
    in_template: set[int] = set()  # braces that open an expression in a template string
    last_block, last_tick = code.rfind("*/"), code.rfind("`")
    at, size = 0, len(code)
    joined: set[int] = set()  # tokens on a line that a backslash joins to the one before
    dead: dict[str, int] = {}  # a quote that is not closed before this place is a sign up to there

    def add(text: str, a: int, b: int) -> None:
        texts.append(text)
        starts.append(a)
        ends.append(b)
        link.append(-1)
        within.append(around)

    def template(a: int) -> int:
        """Step over text of a template string up to its end or an expression in it."""
        nonlocal around
        m = _TEMPLATE.match(code, a)
        if m["end"] == "${":
            add("{", m.end() - 2, m.end())
            around = len(texts) - 1
            open_at.append(around)
            in_template.add(around)
        return m.end()

    def close(text: str, a: int, b: int) -> int:
        """Link a closing bracket with the nearest open one of its kind, of the last four; those between were never closed."""
        nonlocal around
        wanted = _CLOSE[text]
        opener = around if around >= 0 and texts[around] == wanted else next((o for o in open_at[:-5:-1] if texts[o] == wanted), None)
        if opener is None:
            add(text, a, b)
            return b
        while open_at[-1] != opener:
            link[open_at.pop()] = len(texts) - 1
        open_at.pop()
        around = open_at[-1] if open_at else -1
        link[opener] = len(texts)
        add(text, a, b)
        link[-1] = opener
        return template(b) if opener in in_template else b

    def raw_end(m: re.Match) -> int:
        """The end of a raw string, or 0 where it is not closed."""
        close = _RAW_END.get(lang, "{}").format(m["close"])
        place = -1 if close in dead else code.find(close, m.end())
        while lang == "python" and place > 0 and escaped(place):
            place = code.find(close, place + 1)
        if place < 0:
            dead[close] = size
        return place + len(close) if place >= 0 else 0

    def escaped(place: int) -> bool:
        first = place
        while code[first - 1] == "\\":
            first -= 1
        return (place - first) % 2 == 1

    while at < size:
        for m in plain(code, at) if at else ():
            what, at = m.lastindex, m.end()
            if what == 4:
                break
            text = m[what]
            if what == 3 and text in _CLOSE:
                if (after := close(text, at - 1, at)) != at:
                    at = after
                    break
                continue
            texts.append(text)
            starts.append(at - len(text))
            ends.append(at)
            link.append(-1)
            within.append(around)
            if what == 3:
                around = len(texts) - 1
                open_at.append(around)
        if at >= size:
            break
        if dead and code[at] in dead and at < dead[code[at]]:
            add(code[at], at, at + 1)
            at += 1
            continue
        m = match(code, at)
        kind, text, b = m.lastgroup, m.group(), m.end()
        if kind == "string" and not (m["q2"] if text[0] == '"' else m["q1"]):
            dead[text[0]], kind, text, b = b, "sign", text[0], at + 1
        elif kind == "raw" and (end := raw_end(m)):
            kind, b = "char", end
        elif kind == "raw":
            kind, text, b = "sign", text[0], at + 1
        if kind == "space":
            if text[0] == "\\":
                joined.add(len(texts))
        elif kind == "block":
            b = code.index("*/", b) + 2 if last_block >= b else b
            if lang == "rust" and b > m.end():
                b = _nested_comment(code, at)
        elif kind == "template" and last_tick > at:
            add("", at, b)
            b = template(b)
        elif kind == "include":
            add(text.strip(), at, b)
        elif kind in ("string", "char"):
            add("", at, b)
        elif kind == "lifetime":
            pass
        elif text == "/" and script and not _divides(t):
            b = _REGEX.match(code, at).end()
            add("", at, b)
        elif text in _CLOSE:
            b = close(text, at, b)
        else:
            add(text, at, b)
            if text in _OPEN:
                around = len(texts) - 1
                open_at.append(around)
        at = b
    for o in open_at:
        link[o] = len(texts)
    breaks = np.flatnonzero(np.frombuffer(code.encode("utf-32-le", "surrogatepass"), np.uint32) == ord("\n"))
    line, last = np.searchsorted(breaks, starts) + 1, np.searchsorted(breaks, ends) + 1
    first = np.ones(len(texts), bool)
    first[1:] = line[1:] > last[:-1]
    first[sorted(joined - {len(texts)})] = False
    return t._replace(line=line.tolist(), last=last.tolist(), first=first.tolist())


def _nested_comment(code: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(code, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return len(code)


def _divides(t: Tokens) -> bool:
    """Whether a slash after these tokens divides: not after an operator, a keyword, a block, or the condition of an ``if`` or loop."""
    if not t.text:
        return False
    last = t.text[-1]
    if last == ")":
        opener = t.link[-1]
        return not (opener > 0 and t.text[opener - 1] in ("if", "while", "for", "with"))
    return last == "" or (bool(OPERAND.search(last)) and last != "}" and last not in NOT_OPERAND)


class Scope(NamedTuple):
    kind: str
    name: str
    qualified: str
    end: int  # the token after it
    body: int  # the brace of its body
    run: Scope | None  # the innermost function around what stands in it, itself included


class _Reader:
    """Reads symbols and edges off the tokens of one file of a brace language."""

    def __init__(self, code: str, lang: str, stem: str):
        self.code, self.lang, self.stem = code, lang, stem
        self.t = tokens(code, lang)
        self.n = len(self.t.text)
        self.symbols: list[Symbol] = []
        self.edges: list[Edge] = []
        self.scopes: list[Scope] = []
        self.angle = self._angles()
        self.named: set[int] = set()  # names of declarations: no calls
        self.spaces: set[int] = {-1}  # braces of name spaces
        self.held = 0  # tokens before it belong to a declaration's head that is read

    def _angles(self) -> dict[int, int]:
        """Where the type arguments that open at a ``<`` end; only such that hold nothing but types."""
        out, stack = {}, []
        t = self.t.text
        for i, x in enumerate(t):
            if x == "<":
                stack.append(i)
            elif not stack:
                continue
            elif x == ">":
                out[stack.pop()] = i
            elif not (x in ",.?[]|&:*='" or x in ("::", "->", "=>") or x[:1].isalpha() or x[:1] == "_" or x[:1].isdigit() or x in "(){}"):
                stack.clear()
            elif x in HALT or x == ";":
                stack.clear()
        return out

    def text(self, i: int) -> str:
        return self.t.text[i] if 0 <= i < self.n else ";"

    def is_word(self, i: int) -> bool:
        x = self.text(i)
        return x[:1].isalpha() or x[:1] in ("_", "$")

    def over(self, i: int) -> int:
        """The token after the bracket or type arguments that open at ``i``."""
        if self.text(i) == "<" and i in self.angle:
            return self.angle[i] + 1
        return min(self.t.link[i] + 1, self.n) if self.text(i) in _OPEN else i + 1

    def body_after(self, i: int) -> int:
        """The open brace, or ``=>``, of the body of a signature whose parameters end before ``i``; -1 without a body."""
        text, types = self.text, False
        while i < self.n:
            x = text(i)
            if x == "{":
                before = text(i - 1)
                if before in (":", "|", "&", "=>", "<", ",") or (self.lang == "go" and before in ("interface", "struct")) or (self.lang == "cpp" and types and self.is_word(i - 1)):
                    i = self.over(i)
                    continue
                return i
            if x == "=>" and self.lang == "csharp":
                return i
            if x in (";", "}", ")", "]", "=", "") or (x in HALT and text(i - 1) not in (":", ",") and not (x in TYPE_WORDS.get(self.lang, ()) and (x not in ("fn", "func") or text(i + 1) == "("))):
                return -1
            if x in ("(", "["):
                if text(i - 1) not in CALLED_TYPES.get(self.lang, (text(i - 1),)) and not (self.lang == "cpp" and types):
                    return -1
                i = self.over(i)
                if self.lang in SCRIPTS and text(i) == ":":
                    return -1
                continue
            if x in (":", "->") and self.lang not in ("rust", "go"):
                if types and self.lang in ("cpp", "java"):
                    return -1
                types = True
            elif x in ("throws", "where"):
                types = True
            elif self.lang not in ("rust", "go") and not types and x not in AFTER_PARAMETERS:
                return -1
            i = self.over(i) if x == "<" else i + 1
        return -1

    def statement_end(self, i: int) -> int:
        """The token after the expression or type that begins at ``i``."""
        first = i
        while i < self.n:
            x = self.text(i)
            if x in (";", ",", "}", ")", "]") or (i > first and (x in HALT or (x == "type" and self.is_word(i + 1)))):
                return i
            if i > first and self.t.first[i] and x not in (".", "?.", "?", ":", "&&", "||", "|", "&", "+", "-", "*", "/", "=>", "=", "<", ">") and (self.text(i - 1) == "" or self.text(i - 1)[-1] not in "=|&+-*/,(?:<.>"):
                return i
            i = self.over(i) if x in _OPEN else i + 1
        return self.n

    def declare(self, kind: str, name: int, first: int, end: int, body: int) -> None:
        """A symbol from token ``first`` to before ``end``; what stands inside becomes its child."""
        parent = self.scopes[-1].qualified if self.scopes else None
        text = self.text(name)
        qualified = f"{parent or self.stem}.{text}"
        end = max(end, name + 1)
        last = min(end, self.n) - 1
        self.symbols.append((kind, text, qualified, parent, self.t.start[first], self.t.end[last], self.t.line[first], self.t.last[last]))
        self.named.add(name)
        scope = Scope(kind, text, qualified, end, body, self.scopes[-1].run if self.scopes else None)
        self.scopes.append(scope if kind in ("class", "interface", "type") else scope._replace(run=scope))

    def block(self, kind: str, name: int, first: int, body: int) -> None:
        """As ``declare``, with a body at ``body``: a brace, an expression after ``=>``, or none (-1)."""
        if body < 0:
            end = name + 1
            while end < self.n and self.text(end) in ("(", "<"):
                end = self.over(end)
            self.declare(kind, name, first, end + (self.text(end) == ";"), -1)
        elif self.text(body) == "{":
            self.declare(kind, name, first, self.over(body), body)
        else:
            self.declare(kind, name, first, self.statement_end(body + 1), body)

    def parameters(self, i: int) -> int:
        """The token after type parameters and a parameter list at ``i``; -1 without one."""
        i = self.over(i) if self.text(i) == "<" else i
        return self.over(i) if self.text(i) == "(" else -1

    def read(self) -> tuple[list[Symbol], list[Edge]]:
        texts, first, scopes, named = self.t.text, self.t.first, self.scopes, self.named
        go, after = self.lang == "go", [*self.t.text[1:], ";"]
        for i, x in enumerate(texts):
            while scopes and scopes[-1].end <= i:
                scopes.pop()
            c = x[:1]
            if c.isalpha() or c == "_" or c == "$":
                if after[i] not in _AFTER_NAMES and x not in _HEADS and not (go and first[i]):
                    continue
                if i not in named and ((texts[i - 1] if i else ";") not in (".", "?.", "->") or (first[i] and x in HALT)):
                    self._word(i, x)
                else:
                    self._call(i, x)
            elif c == "#" and "include" in x:
                self.edges.append((self.stem, re.sub(r"^[^<\"]*[<\"]|[>\"]$", "", x), "imports", 1.0, self.t.line[i]))
            elif go and x == "(" and self.text(i - 1) == "type":
                self.spaces.add(i)
        return self.symbols, self.edges

    def _word(self, i: int, x: str) -> None:
        lang, text = self.lang, self.text
        if x in ("import", "use", "using", "require", "from") and self._import(i, x):
            return
        if x == "namespace" or (x == "extern" and text(i + 1) == ""):
            j = i + 1
            while self.is_word(j) or text(j) in (".", "::", ""):
                j += 1
            if text(j) == "{":
                self.spaces.add(j)
        elif x in KINDS and self.is_word(i + 1) and text(i + 1) not in KINDS and not (x == "record" and lang not in ("java", "csharp")):
            self._class(i, x)
        elif x == "type" and self.is_word(i + 1) and lang in ("typescript", "go", "rust"):
            self._type(i, i + 1)
        elif lang == "go" and self.t.first[i] and self.t.within[i] in self.spaces - {-1}:
            self._type(i, i)
        elif x == "function" and lang in SCRIPTS:
            name = i + 1 + (text(i + 1) == "*")
            if self.is_word(name) and (after := self.parameters(name + 1)) > 0:
                self.block("function", name, i, self.body_after(after))
        elif (x == "fn" and lang == "rust") or (x == "func" and lang == "go"):
            name = self.over(i + 1) if x == "func" and text(i + 1) == "(" else i + 1
            if self.is_word(name) and (after := self.parameters(name + 1)) > 0:
                inside = bool(self.scopes) and self.scopes[-1].kind in ("class", "interface") and self.t.within[i] == self.scopes[-1].body
                self.block("method" if inside else "function", name, i, self.body_after(after))
        elif x in ("const", "let", "var") and lang in SCRIPTS and self.is_word(i + 1):
            self._arrow(i)
        elif not self._method(i, x):
            self._call(i, x)

    def _import(self, i: int, x: str) -> bool:
        lang, line = self.lang, self.t.line[i]
        add = lambda dst: self.edges.append((self.stem, dst, "imports", 1.0, line))
        if x == "require":
            if lang in SCRIPTS and self.text(i + 1) == "(" and self.text(i + 2) == "" and self.text(i + 3) == ")":
                add(self._string(i + 2))
                return True
            return False
        if lang in SCRIPTS:
            if x != "import" or self.text(i + 1) in ("(", "."):
                return False
            j = i + 1
            while j < self.n and self.text(j) != "" and (self.text(j) in ("{", ",", "*", "=") or (self.is_word(j) and self.text(j) not in HALT)):
                j = self.over(j)
            if self.text(j) == "(" and self.text(j - 1) == "require":
                j += 1
            if j < self.n and self.text(j) == "":
                add(self._string(j))
            return True
        if lang == "go" and x == "import":
            end = self.over(i + 1) if self.text(i + 1) == "(" else i + 3
            for j in range(i + 1, min(end, self.n)):
                if self.text(j) == "":
                    self.edges.append((self.stem, self._string(j), "imports", 1.0, self.t.line[j]))
                    if self.text(i + 1) != "(":
                        break
            return True
        if {"java": "import", "rust": "use", "csharp": "using"}.get(lang) == x:
            j = i + 1 + (self.text(i + 1) == "static")
            k = j
            while k < self.n and (self.text(k) in (".", "::", "*", "{", "}", ",") or (self.is_word(k) and not self.t.first[k])):
                k = self.over(k) if self.text(k) == "{" else k + 1
            if j < k < self.n and self.text(k) == ";":
                add(re.sub(r"\s+", "", self.code[self.t.start[j] : self.t.end[k - 1]]))
                return True
        return False

    def _string(self, i: int) -> str:
        return self.code[self.t.start[i] + 1 : self.t.end[i] - 1]

    def _class(self, i: int, x: str) -> None:
        """A class and what it extends and implements."""
        name, j = i + 1, i + 2
        bases: list[tuple[str, list[int]]] = []  # the word, and where its parts begin and end
        word = None
        while j < self.n:
            y = self.text(j)
            if y in ("extends", "implements") or (y == ":" and self.lang in ("cpp", "csharp") and word is None):
                word = y
                bases.append((y, [j + 1]))
            elif y == "," and bases:
                bases[-1][1].append(j + 1)
            elif y == "(" and word is None and self.lang in ("rust", "java", "csharp"):
                j = self.over(j)
                continue
            elif y in ("{", ";", "}", ")", "(", "") or (y in HALT and y != "const"):
                break
            j = self.over(j) if y == "<" else j + 1
        body = j if self.text(j) == "{" else -1
        if body < 0 and not (self.lang == "rust" and self.text(j) == ";"):
            return
        self.declare(KINDS[x], name, i, self.over(body) if body >= 0 else j + 1, body)
        owner, line = self.scopes[-1].qualified, self.t.line[i]
        for word, starts in bases:
            for a in starts:
                b = a
                while b < j and self.text(b) not in (",", "extends", "implements", "{", "<"):
                    b += 1
                while a < b and self.text(a) in ("public", "private", "protected", "virtual"):
                    a += 1
                if a < b:
                    self.edges.append((owner, re.sub(r"\s+", "", self.code[self.t.start[a] : self.t.end[b - 1]]), "extends" if word == ":" else word, 1.0, line))

    def _type(self, i: int, name: int) -> None:
        j = name + 1
        j = self.over(j) if self.text(j) in ("<", "[") and self.lang != "go" else j
        if self.lang == "go" and self.text(j) in ("struct", "interface") and self.text(j + 1) == "{":
            self.declare("class" if self.text(j) == "struct" else "interface", name, i, self.over(j + 1), j + 1)
        elif self.text(j) == "=" or self.lang == "go":
            self.declare("type", name, i, self.statement_end(j + (self.text(j) == "=")), -1)
            if self.scopes[-1].end < self.n and self.text(self.scopes[-1].end) == ";":
                self.symbols[-1] = (*self.symbols[-1][:5], self.t.end[self.scopes[-1].end], *self.symbols[-1][6:])

    def _arrow(self, i: int) -> None:
        """A function that a variable is given at its declaration."""
        name, j = i + 1, i + 2
        if self.text(j) == ":":
            while j < self.n and self.text(j) not in ("=", ";", "") and self.text(j) not in HALT:
                j = self.over(j) if self.text(j) in "([{<" else j + 1
        if self.text(j) != "=":
            return
        j += 1 + (self.text(j + 1) == "async")
        if self.text(j) == "function":
            j += 1 + (self.text(j + 1) == "*")
            j += self.is_word(j)
            after = self.parameters(j)
            if after > 0 and (body := self.body_after(after)) >= 0:
                self.named.add(j - 1)
                self.block("arrow_function", name, i, body)
            return
        if self.is_word(j) and self.text(j + 1) == "=>":
            body = j + 1
        else:
            body = self.parameters(j)
            if body > 0 and self.text(body) == ":":
                while body < self.n and self.text(body) not in ("=>", ";", "=", "") and self.text(body) not in HALT:
                    body = self.over(body) if self.text(body) in "([{<" else body + 1
        if body > 0 and self.text(body) == "=>":
            body += self.text(body + 1) == "{"
            self.block("arrow_function", name, i, body)

    def _method(self, i: int, x: str) -> bool:
        """A method right in the body of a class; in Java, C++ and C# also a function outside of any."""
        if self.text(i + 1) not in ("(", "<") or x in WORDS or self.lang in ("rust", "go"):
            return False
        around = self.t.within[i]
        owner = self.scopes[-1] if self.scopes and self.scopes[-1].body == around and self.scopes[-1].kind in ("class", "interface") else None
        free = owner is None and self.lang in TYPED and around in self.spaces
        before = self.text(i - 1)
        begins = self.t.first[i] or before in ("{", "}", ";", "]", ">", "*", "&", "#", "~", "::") or (before == ":" and self.text(i - 2) in ("public", "private", "protected")) or (self.is_word(i - 1) and before not in ("new", "return", "throw", "await"))
        if not (owner or free) or not begins or (free and not self.is_word(i - 1) and before not in (">", "*", "&", "::", "]")):
            return False
        after = self.parameters(i + 1)
        body = self.body_after(after) if after > 0 else -1
        if body < 0:
            return False
        first = i
        while first > 0 and not self.t.first[first] and (self.is_word(first - 1) or self.text(first - 1) in (">", "<", "*", "&", "[", "]", ".", "::", ",", "#", "?", "~")) and self.t.within[first - 1] == around:
            first -= 1
        kind = "function" if free else "constructor" if x in ("constructor", owner.name) and before != "~" else "method"
        self.block(kind, i, first, body)
        return True

    def _call(self, i: int, x: str) -> None:
        j = i + 1 + (self.lang == "rust" and self.text(i + 1) == "!")
        if self.lang == "rust" and self.text(j) == "::" and self.text(j + 1) == "<":
            j += 1
        j = self.over(j) if self.text(j) == "<" and j in self.angle else j
        if self.text(j) not in (("(", "[", "{") if j > i + 1 and self.text(i + 1) == "!" else ("(",)) or x in WORDS or x == "constructor" or i in self.named:
            return
        run = self.scopes[-1].run if self.scopes else None
        if run and 0 <= run.body < i:  # a default or a type is no call from the body
            self.edges.append((run.qualified, x.lower(), "calls", 0.8, self.t.line[i]))


def _read_python(code: str, stem: str) -> tuple[list[Symbol], list[Edge]]:
    """By indentation: a block ends before the first line that is not further in than its first word. Broken lines cost only what they hold."""
    t = tokens(code, "python")
    n, text = len(t.text), t.text
    symbols: list[list] = []
    edges: list[Edge] = []
    open_blocks: list[tuple[int, int, bool, str, str]] = []  # column, symbol, is a class, qualified, the function around
    indent, named = 0, set()
    word = lambda i: i < n and (text[i][:1].isalpha() or text[i][:1] == "_")

    def finish(symbol: int, token: int) -> None:
        symbols[symbol][5], symbols[symbol][7] = t.end[token], t.last[token]

    for i, x in enumerate(text):
        begins = t.first[i] and t.within[i] < 0
        if begins:
            indent = t.start[i] - 1 - code.rfind("\n", t.start[i - 1] if i else 0, t.start[i])
            while open_blocks and open_blocks[-1][0] >= indent:
                finish(open_blocks.pop()[1], i - 1)
        head = x in _PYTHON_HEADS and (begins or (i > 0 and text[i - 1] in ("async", ";")))
        if head and x in ("def", "class") and word(i + 1):
            parent = open_blocks[-1][3] if open_blocks else None
            in_class, run = (open_blocks[-1][2], open_blocks[-1][4]) if open_blocks else (False, "")
            name = text[i + 1]
            qualified = f"{parent or stem}.{name}"
            kind = "class" if x == "class" else ("constructor" if name == "__init__" else "method") if in_class else "function"
            start = t.start[i - 1] if i and text[i - 1] == "async" else t.start[i]
            symbols.append([kind, name, qualified, parent, start, 0, t.line[i], 0])
            open_blocks.append((indent, len(symbols) - 1, x == "class", qualified, run if x == "class" else qualified))
            named.add(i + 1)
            if x == "class" and i + 2 < n and text[i + 2] == "(":
                a, end = i + 3, min(t.link[i + 2], n)
                j = a
                while j <= end:
                    if j == end or (text[j] == "," and t.within[j] == i + 2):
                        if a < j and not (a + 1 < j and text[a + 1] == "=") and text[a] != "*":
                            edges.append((qualified, re.sub(r"\s+", " ", code[t.start[a] : t.end[j - 1]]), "extends", 1.0, t.line[i]))
                        a = j + 1
                    j += 1
        elif head and x in ("import", "from"):
            j, module = i + 1, ""
            while j < n and t.line[j] == t.line[i] and (word(j) or text[j] in (".", ",")) and text[j] != "import":
                if text[j] == "," and x == "import":
                    edges.append((stem, module, "imports", 1.0, t.line[i]))
                    module = ""
                elif text[j] == "as":
                    j += 1
                else:
                    module += text[j]
                j += 1
            if module:
                edges.append((stem, module, "imports", 1.0, t.line[i]))
        elif i + 1 < n and text[i + 1] == "(" and word(i) and i not in named and x not in WORDS and open_blocks and open_blocks[-1][4]:
            edges.append((open_blocks[-1][4], x.lower(), "calls", 0.8, t.line[i]))
    for _, s, *_ in open_blocks:
        finish(s, n - 1)
    return [tuple(s) for s in symbols], edges


def scan_code(code: str, lang: str, stem: str) -> tuple[list[Symbol], list[Edge]]:
    """Symbols (kind, name, qualified name, parent, start, end in bytes, first and last line) and edges of a file.

    Edges: imports, extends, implements (confidence 1) and calls (0.8, last member name in lower case) from the function around.
    """
    lang = normal(lang)
    symbols, edges = _read_python(code, stem) if lang == "python" else _Reader(code, lang, stem).read()
    if code.isascii():
        return symbols, edges
    byte_of, at, held = {0: 0}, 0, 0
    for i in sorted({p for s in symbols for p in s[4:6]}):
        held += len(code[at:i].encode())
        byte_of[i], at = held, i
    return [(*s[:4], byte_of[s[4]], byte_of[s[5]], *s[6:]) for s in symbols], edges

