"""TypeScript text to statements: where each begins and ends, and what it is in. The only part of symbol reading that is not columns.

One pass over a file's tokens with a stack of brackets. Strings, templates with their expressions, regular expressions and
comments are tokens, so nothing in them opens or closes anything. Bodies of classes, interfaces, enums and namespaces are
entered, all other bodies are passed over. Time and memory are in proportion to the file, whatever it holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"""(?P<line>\n)|(?P<space>[^\S\n]+)|(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<word>[\w$#]+)|(?P<mark>=>|\.\.\.|\?\.|\+\+|--|[!=]==?|<=|&&|\|\||\?\?|.)""", re.S)
_QUOTED = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\.)*{q}", re.S) for q in "'\""}
_PATTERN = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)?", re.S)
#: Type arguments of a call, at their opening bracket.
_GENERIC = re.compile(r"<[\w$\s,.\[\]|&'\"<>]*>\s*\(")
_LEAD = re.compile(r"(?:(?:export|declare|default)\s+)*(?:const|let|var)\s+")
_CLOSES = {")": "(", "]": "[", "}": "{"}

# Words of the language, by what they do to the statement that they are in.
CONTAINERS = frozenset(["class", "interface", "enum", "namespace", "module", "global"])
MODIFIERS = frozenset(["export", "default", "declare", "abstract", "public", "private", "protected", "static", "readonly", "async", "override", "accessor"])
_VALUE_FOLLOWS = frozenset(["return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "yield", "await", "else", "do"])
_NO_END_AFTER = MODIFIERS | CONTAINERS | frozenset(["extends", "implements", "new", "typeof", "keyof", "in", "of", "as", "is", "instanceof", "import", "from", "function", "type", "const", "let", "var", "get", "set", "else", "satisfies", "infer", "unique"]) - {"global"}
_GOES_ON_WITH = frozenset(["extends", "implements", "instanceof", "in", "of", "as", "is", "satisfies", "from"])
_NO_BODY_AFTER = frozenset(["const", "let", "var", "import", "export", "default", "return", "typeof", "keyof", "in", "of", "new", "is", "as", "extends", "implements", "from"])
_OPERATORS = frozenset("= : | & + - * / % ^ ! ~ ? , . => < ( [ ... ?. && || ?? == === != !== <= {".split())
_GOES_ON = frozenset("= : | & + - / % ^ ? , . => ) ] ?. && || ?? == === != !== <= >".split())


def tokens(text: str):
    """(kind, start, end) of what is neither space nor, within templates, text; kind: line, note, word, text, mark, open, close.

    A template's chunks are one text, or open and close what lies between.
    """
    at, size, last, braces, dead = 0, len(text), "", [], {"'": 0, '"': 0, "/": 0}
    while at < size:
        c = text[at]
        if c in _QUOTED and at >= dead[c]:
            found = _QUOTED[c].match(text, at)
            if found:
                yield "text", at, found.end()
                at, last = found.end(), "text"
                continue
            end = text.find("\n", at)
            dead[c] = end if end >= 0 else size
        elif c == "`" or c == "}" and braces and braces[-1]:
            inner = c == "}"
            if inner:
                braces.pop()
            found = _CHUNK.match(text, at + 1)
            opens = found[1] == "${"
            if opens:
                braces.append(True)
            yield "text" if inner == opens else "open" if opens else "close", at, found.end()
            at, last = found.end(), "(" if opens else "text"
            continue
        elif c == "/" and at >= dead["/"] and last not in ("word", "text", ")", "]", "}") and text[at + 1 : at + 2] not in ("/", "*"):
            found = _PATTERN.match(text, at)
            if found:
                yield "text", at, found.end()
                at, last = found.end(), "text"
                continue
            end = text.find("\n", at)
            dead["/"] = end if end >= 0 else size
        found = _TOKEN.match(text, at)
        kind, start, at = found.lastgroup, at, found.end()
        if kind == "space":
            continue
        yield kind, start, at
        if kind == "word":
            last = "value" if found[0] in _VALUE_FOLLOWS else "word"
        elif kind == "mark":
            last = found[0]
            if last == "{":
                braces.append(False)
            elif last == "}" and braces:
                braces.pop()


@dataclass
class _Statement:
    start: int
    line: int
    doc: str | None
    decorated: bool
    head: int | None = None  # where it begins behind its decorators
    words: list = field(default_factory=list)  # its first tokens
    end: int = 0
    end_line: int = 0
    before: str = ""
    newline: bool = False
    equals: int | None = None
    colon: bool = False
    body: int | None = None
    notes: list = field(default_factory=list)
    cuts: list = field(default_factory=list)  # commas between declared variables
    params: list | None = None  # where parameters begin, and where the list ends

    def keyword(self) -> tuple[str, str]:
        """The word that says what is declared, and the name after it."""
        w = [x for x in self.words if x not in MODIFIERS]
        if len(w) > 1 and w[0] == "const" and w[1] == "enum":
            w = w[1:]
        if not w:
            return "", ""
        if w[0] == "class":
            return "class", w[1] if len(w) > 1 and re.fullmatch(r"[\w$]+", w[1]) and w[1] not in ("extends", "implements") else "anonymous"
        if w[0] == "global":
            return "global", "global"
        if w[0] in CONTAINERS and len(w) > 1 and re.match(r"[\w$'\"]", w[1]):
            name, k = w[1].strip("'\""), 2
            while k + 1 < len(w) and w[k] == ".":
                name, k = f"{name}.{w[k + 1]}", k + 2
            return w[0], name
        return (w[0], "") if w[0] in ("const", "let", "var", "type", "function") else ("", "")


def statements(text: str | None) -> list[tuple]:
    """(line, end_line, head, left, inside, scope, doc, params, after) of each statement of a file and of its bodies, in order.

    head: the statement up to its body, in one line, without comments and decorators; left: head up to an equals sign;
    inside and scope: the word and the dotted names of what it is in; doc: the comment before it, if it is a doc comment;
    params: the entries of a declaration's first round brackets; after: what stands between those and its body or end.
    Variables that are declared together are rows of their own. Dynamic imports are rows with inside "import".
    """
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    out: list[list] = []
    frames: list[tuple] = [("", "", None)]  # word, dotted names, row
    now: _Statement | None = None
    opened: list[str] = []
    line, doc, past = 1, None, ["", ""]

    def clean(start: int, end: int, notes: list) -> str:
        parts, at = [], start
        for a, b in notes:
            if start <= a < end:
                parts += [text[at:a], " "]
                at = b
        return re.sub(r"\s+", " ", "".join([*parts, text[at:end]])).strip()

    def put(end: int, end_line: int) -> int | None:
        """Write the current statement; the row's number."""
        nonlocal now
        s, now = now, None
        opened.clear()
        if s.head is None:
            return None
        end = s.body if s.body is not None else end
        word, scope, _ = frames[-1]
        params = after = None
        if s.params and s.params[-1] < 0:
            ends = [*s.params[1:-1], -s.params[-1]]
            params = [x for a, b in zip(s.params, ends, strict=False) if (x := clean(a, b, s.notes).strip(" ,"))]
            after = clean(1 - s.params[-1], end, s.notes)
        spans = [(s.head, end, s.equals)]
        if s.cuts:
            spans = [(a, b, None) for a, b in zip([s.head, *(c + 1 for c, _ in s.cuts)], [*(c for c, _ in s.cuts), end], strict=True)]
            spans = [(a, b, e if e is not None and a <= e < b else None) for (a, b, _), e in zip(spans, [s.cuts[0][1], *(x for _, x in s.cuts[1:]), s.equals], strict=True)]
        first = clean(*spans[0][:2], s.notes)
        lead = _LEAD.match(first)[0] if s.cuts else ""
        at, counted = s.line, s.start
        for k, (a, b, equals) in enumerate(spans):
            head, left = clean(a, b, s.notes), clean(a, b if equals is None else equals, s.notes)
            if head:
                more = lead if k else ""
                begins = a + len(text[a:b]) - len(text[a:b].lstrip()) if k else counted
                at, counted = at + text.count("\n", counted, begins), begins
                out.append([at, end_line, more + head, more + left, word or None, scope or None, s.doc, params, after])
        return len(out) - 1

    def ends_before(word: str, kind: str) -> bool:
        """Whether a statement that a line end has come after ends there, given what comes next."""
        inside = frames[-1][0]
        if inside == "enum" or now.head is None or now.before in _OPERATORS or now.before in _NO_END_AFTER or word in _GOES_ON_WITH or word in _GOES_ON:
            return False
        if word == "{":
            return now.equals is not None
        if word in ("(", "[", "<", "*") or kind == "open" or word.startswith("`"):
            return inside == "interface" or inside == "class" and now.equals is None and (now.colon or word == "*")
        return True

    for kind, start, end in tokens(text):
        if kind == "line":
            line += 1
            if now:
                now.newline = True
            continue
        at_line = line
        line += text.count("\n", start, end) if kind in ("note", "text", "open", "close") else 0
        if kind == "note":
            doc = text[start:end] if text.startswith("/**", start) and end - start > 4 else None
            if now:
                now.notes.append((start, end))
            continue
        token = text[start:end]
        if past[1] == "(" and past[0] == "import" and kind == "text" and token[0] in "'\"":
            out.append([at_line, at_line, token[1:-1], "", "import", None, None, None, None])
        past = [past[1], token]
        if now and not opened and now.newline and ends_before(token, kind):
            put(now.end, now.end_line)
        if now is None:
            if token == "}" and len(frames) > 1:
                row = frames.pop()[2]
                if row is not None:
                    out[row][1] = at_line
            if token in (";", ",", "}", ")", "]"):
                doc = None
                continue
            now = _Statement(start, at_line, doc, token == "@")
        doc = None
        if now.head is None and not opened and (not now.decorated or kind == "word" and now.before not in ("@", ".")):
            now.head = start
        if not opened:
            if token == "}":
                put(now.end, now.end_line)
                if len(frames) > 1:
                    row = frames.pop()[2]
                    if row is not None:
                        out[row][1] = at_line
                doc = None
                continue
            inside = frames[-1][0]
            if token == ";" or token == "," and inside in ("enum", "interface"):
                put(now.end or start, now.end_line or at_line)
                continue
            word, name = now.keyword() if token in ("{", "<", ",") else ("", "")
            if token == "{" and now.head is not None and now.equals is None and inside not in ("enum", "interface") and now.before not in _OPERATORS and not (now.before in _NO_BODY_AFTER or now.before == "type" and now.words[0] in ("import", "export")):
                if word in CONTAINERS and name:
                    scope, now.body = ".".join(x for x in (frames[-1][1], name) if x), start
                    frames.append(("namespace" if word in ("module", "global") else word, scope, put(start, at_line)))
                    continue
                now.body = start
                opened.append("{")
            elif kind == "mark" and token in "{([":
                opened.append(token)
                if token == "(" and now.params is None and now.equals is None and now.head is not None:
                    now.params = [end]
            elif kind == "open":
                opened.append("`")
            elif token == "<" and (now.before or inside) and (_GENERIC.match(text, start, start + 2000) if now.equals is not None and word != "type" else inside in ("class", "interface") or word):
                opened.append("<")
            elif token == "=" and now.equals is None:
                now.equals = start
            elif token == ":":
                now.colon = True
            elif token == "," and word in ("const", "let", "var"):
                now.cuts.append((start, now.equals))
                now.equals = None
            if now.head is not None and len(now.words) < 24:
                now.words.append(token)
        elif kind == "open" or kind == "mark" and token in "{([":
            opened.append("`" if kind == "open" else token)
        elif token == "<" and (opened[-1] == "<" or opened == ["("] and now.body is None and now.before[-1:].isalnum()):
            opened.append("<")
        elif token == ">" and opened[-1] == "<":
            opened.pop()
        elif token == "," and opened == ["("] and now.params and now.params[-1] > 0:
            now.params.append(end)
        elif kind == "close" or token in _CLOSES:
            want = "`" if kind == "close" else _CLOSES[token]
            if want in opened:
                while opened.pop() != want:
                    pass
            if not opened:
                if token == ")" and now.params and now.params[-1] > 0:
                    now.params.append(-start)
                if now.body is not None:
                    put(end, line)
                    continue
        elif token == ";" and set(opened) == {"<"}:
            put(now.end, now.end_line)
            continue
        now.before, now.end, now.end_line, now.newline = token, end, line, False
    if now:
        put(now.end, now.end_line)
    return [tuple(x) for x in out]
