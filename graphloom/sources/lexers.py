"""Per-file helpers of sources.code: cut one source text into tokens, and find what its brackets and statements enclose.

A token is (text, line, doc): doc is the doc comment right before it. Spaces and comments make no tokens. What can't be
read raises SourceError with its line.
"""

from __future__ import annotations

import re

Token = tuple[str, int, str | None]


class SourceError(Exception):
    """What is wrong with a source text, and in which line."""

    def __init__(self, line: int, message: str):
        super().__init__(message)
        self.line, self.message = line, message


PHP_OPEN = re.compile(r"<\?(?:php\b|=)", re.I)
PHP_TOKEN = re.compile(
    r"(?P<out>\?>.*?(?:<\?(?:php\b|=)|\Z))|(?P<space>\s+)|(?P<comment>/\*.*?(?:\*/|\Z)|(?://|#(?!\[))(?:(?!\?>)[^\n])*)"
    r"|<<<[ \t]*(?P<quote>[\"']?)(?P<mark>\w+)(?P=quote)\r?\n(?:.*?\n)??[ \t]*(?P=mark)\b|'[^'\\]*+(?:\\.[^'\\]*+)*+'|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|`[^`\\]*+(?:\\.[^`\\]*+)*+`"
    r"|\$\w+|\\?[A-Za-z_\x80-\U0010ffff][\w\\\x80-\U0010ffff]*+|\d[\w.]*+|\?->|->|::|=>|.",
    re.S,
)
PAIRS = {")": "(", "]": "[", "}": "{"}
WORD = re.compile(r"^\\?[A-Za-z_$\x80-\U0010ffff]")
OPERAND = re.compile(r"^[$'\"`\d]|^<<<")


def php_tokens(text: str) -> list[Token]:
    """Tokens of a PHP file; what stands outside of PHP counts as a semicolon."""
    first = PHP_OPEN.search(text)
    if first is None:
        return []
    out: list[Token] = [(";", 1, None)]
    line, doc = 1 + text.count("\n", 0, first.end()), None
    for m in PHP_TOKEN.finditer(text, first.end()):
        tok, kind = m[0], m.lastgroup
        if kind == "comment":
            doc = tok if tok.startswith("/**") else None
            if tok.startswith("/*") and not (tok.endswith("*/") and len(tok) > 3):
                raise SourceError(line, "a comment is not closed")
        elif kind == "out":
            out.append((";", line, doc))
            doc = None
        elif kind != "space":
            if tok in "'\"`" or tok.startswith("<<<") and len(tok) == 3:
                raise SourceError(line, "a string is not closed")
            if tok == "__halt_compiler":
                break
            out.append((tok, line, doc))
            doc = None
        line += tok.count("\n")
    return out


#: A regular expression or markup, not an operator, may follow these words and signs.
VALUE_AFTER = set("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => && || ?? ... return typeof case do else in of void delete throw new yield await default instanceof".split())
JS_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\""
    r"|[A-Za-z_$\x80-\U0010ffff][\w$\x80-\U0010ffff]*+|\d[\w.]*+|=>|\?\.(?!\d)|\.\.\.|&&|\|\||\?\?|[!=]==?|.",
    re.S,
)
JS_REGEX = re.compile(r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+")
TYPE_ARGUMENTS = re.compile(r"<[\w$\s,.|&\[\]{}:;'\"<>?]*?>(?=\()")
MARKUP = re.compile(r"<(?P<name>[A-Za-z_$][\w$.:-]*)?(?=[\s/>])")
ATTRIBUTE = re.compile(r"\s+|[^\s={}<>/\"']+|=\s*(?:\"[^\"]*\"|'[^']*')|=|/(?!>)|/\*.*?\*/", re.S)


def js_tokens(text: str) -> list[Token]:
    """Tokens of a JavaScript or TypeScript file, by a stack of modes: code, template, tag and the text between tags.

    A template without a placeholder is one token; of others the pieces of text stand for themselves, and the code of
    each placeholder is in brackets. Of markup there are a < at its start, the code of its braces in brackets, and a >."""
    out: list[Token] = []
    at, line, modes, depth = 0, 1, ["code"], [0]

    def put(tok: str) -> None:
        out.append((tok, line, None))

    def enter() -> None:
        put("(")
        modes.append("code")
        depth.append(0)

    n = len(text)
    while at < n:
        mode, start = modes[-1], at
        if mode == "template":
            end = at
            while end < n and text[end] != "`" and not text.startswith("${", end):
                end += 2 if text[end] == "\\" else 1
            put("`" + text[at:end] + "${")
            if end >= n:
                raise SourceError(line, "a template is not closed")
            line += text.count("\n", start, end)
            at = end + 1
            if text[end] == "`":
                modes.pop()
            else:
                at = end + 2
                enter()
            continue
        if mode == "tag":
            if text.startswith("/>", at) or text[at] == ">":
                at += 2 if text[at] == "/" else 1
                modes.pop()
                if text[at - 2 : at] != "/>":
                    modes.append("children")
                elif modes[-1] != "children":
                    put(">")
            elif text[at] == "{":
                enter()
                at += 1
            elif text[at] == "<":
                modes.append("tag")
                at = (MARKUP.match(text, at) or re.compile("<").match(text, at)).end()
            else:
                m = ATTRIBUTE.match(text, at)
                at = m.end() if m else at + 1
            line += text.count("\n", start, at)
            continue
        if mode == "children":
            if text.startswith("</", at):
                end = text.find(">", at)
                if end < 0:
                    raise SourceError(line, "a tag is not closed")
                at = end + 1
                modes.pop()
                if modes[-1] != "children":
                    put(">")
            elif text[at] == "<":
                m = MARKUP.match(text, at)
                at = m.end() if m else at + 1
                modes.append("tag")
            elif text[at] == "{":
                enter()
                at += 1
            else:
                ends = [x for x in (text.find("<", at), text.find("{", at)) if x >= 0]
                at = min(ends, default=n)
            line += text.count("\n", start, at)
            continue
        before = out[-1][0] if out else ";"
        value = before in VALUE_AFTER
        if text[at] == "`":
            end = at + 1
            while end < n and text[end] != "`" and not text.startswith("${", end):
                end += 2 if text[end] == "\\" else 1
            if end < n and text[end] == "`":
                put(text[at : end + 1])
                at = end + 1
            else:
                modes.append("template")
                at += 1
                continue
            line += text.count("\n", start, at)
            continue
        if text[at] == "/" and value and (m := JS_REGEX.match(text, at)):
            put(m[0])
            at = m.end()
            continue
        if text[at] == "<":
            m = MARKUP.match(text, at)
            if value and m and (m["name"] is None or _closes(text, m["name"], m.end())):
                put("<")
                modes.append("tag")
                at = m.end()
                continue
            if not value and WORD.match(before) and (m := TYPE_ARGUMENTS.match(text, at)) and m[0].count("<") == m[0].count(">") - m[0].count("=>"):
                at = m.end()
                line += text.count("\n", start, at)
                continue
        m = JS_TOKEN.match(text, at)
        tok, at = m[0], m.end()
        if m.lastgroup is None:
            if tok in "'\"":
                raise SourceError(line, "a string is not closed")
            if tok == "{":
                depth[-1] += 1
            elif tok == "}":
                depth[-1] -= 1
            if tok == "}" and depth[-1] < 0 and len(modes) > 1:
                put(")")
                modes.pop()
                depth.pop()
            else:
                put(tok)
        line += tok.count("\n")
    if len(modes) > 1:
        raise SourceError(line, "a template or markup is not closed")
    return untyped(out)


def _closes(text: str, name: str, at: int) -> bool:
    """Whether <name is a tag and not a type parameter: it closes itself or is closed further on."""
    rest = text[at : at + 200]
    if re.match(r"\s*(,|extends\b)", rest):
        return False
    return bool(re.match(r"[^<>]*/>", rest)) or text.find(f"</{name}", at) >= 0 or text.find("/>", at) >= 0 and not rest.startswith(">(")


def untyped(tokens: list[Token]) -> list[Token]:
    """`tokens` without the types of variables and of what arrow functions return."""
    out: list[Token] = []
    opened: list[int] = []
    i, n = 0, len(tokens)
    while i < n:
        tok = tokens[i][0]
        if tok == "(":
            opened.append(len(out))
        elif tok == ")" and opened:
            begin = opened.pop()
            asked = begin > 0 and out[begin - 1][0] == "?"
            if not asked and i + 1 < n and tokens[i + 1][0] == ":":
                end = _type_end(tokens, i + 2, "=>")
                if end is not None and end - i > 2:
                    out.append(tokens[i])
                    i = end
                    continue
        out.append(tokens[i])
        if tok in ("const", "let", "var") and i + 2 < n and WORD.match(tokens[i + 1][0]) and tokens[i + 2][0] == ":":
            end = _type_end(tokens, i + 3, "=")
            if end is not None:
                out.append(tokens[i + 1])
                i = end
                continue
        i += 1
    return out


def _type_end(tokens: list[Token], at: int, upto: str) -> int | None:
    """Where `upto` ends the type that begins at `at`; None if a statement ends first."""
    level = 0
    for i in range(at, len(tokens)):
        tok = tokens[i][0]
        if tok == upto and level == 0:
            return i
        if tok in "([{<" and len(tok) == 1:
            level += 1
        elif tok in ")]}>" and len(tok) == 1:
            level -= 1
        if level < 0 or level == 0 and (tok in (";", ",", "?", "}", "return", "const", "let", "var") or tok == "=>" and upto == "=" and tokens[i - 1][0] != ")"):
            return None
    return None


def brackets(tokens: list[Token]) -> tuple[list[int], list[int]]:
    """For every token the place of the bracket around it (-1: none), and for an opening one where it closes (else -1)."""
    around, close, stack = [], [-1] * len(tokens), []
    for i, (tok, line, _) in enumerate(tokens):
        if tok in PAIRS:
            if not stack or tokens[stack[-1]][0] != PAIRS[tok]:
                raise SourceError(line, f"unexpected {tok}")
            close[stack.pop()] = i
        around.append(stack[-1] if stack else -1)
        if tok in ("(", "[", "{"):
            stack.append(i)
    if stack:
        raise SourceError(tokens[stack[-1]][1], f"{tokens[stack[-1]][0]} is not closed")
    return around, close


def stop_of(tokens: list[Token], close: list[int], i: int, at_block: bool = True) -> int:
    """Where the statement or the head that goes on behind token `i` ends: at the next semicolon of its level, or block if
    `at_block`, or at the end of the bracket around it."""
    j, n = i + 1, len(tokens)
    while j < n:
        tok = tokens[j][0]
        if tok == ";" or tok in PAIRS or at_block and tok == "{":
            return j
        j = close[j] + 1 if close[j] >= 0 else j + 1
    return n


def import_end(tokens: list[Token], i: int) -> int:
    """Where the import at token `i` ends: behind the next string."""
    for j in range(i + 1, len(tokens)):
        if tokens[j][0][0] in "'\"":
            return j + 1
        if tokens[j][0] in (";", "(", "import"):
            return j
    return len(tokens)


#: Operators and others that may follow an operand, and words that no operand may follow at once.
LINKING = set("and or xor instanceof as insteadof".split())


def check_php(tokens: list[Token], around: list[int], close: list[int]) -> None:
    """Raise SourceError where no PHP statement can go on: an operand behind an operand, a block or file that ends amid a
    statement, a declaration without a name."""
    n = len(tokens)
    owner = {close[i]: i for i in range(n) if close[i] >= 0}
    for i, (tok, line, _) in enumerate(tokens):
        before = tokens[i - 1][0] if i else ";"
        if OPERAND.match(before) and before != "$" and (OPERAND.match(tok) and tok != "$" or WORD.match(tok) and tok.lower() not in LINKING):
            raise SourceError(line, f"unexpected {tok[:40]}")
        low, after = tok.lower(), tokens[i + 1][0] if i + 1 < n else ""
        if before not in ("->", "?->", "::", "function", "const", "fn") and not (before == "&" and i > 1 and tokens[i - 2][0].lower() == "function"):
            if low == "function" and not (after in ("&", "(") or WORD.match(after)) and before.lower() != "use":
                raise SourceError(line, "a function has neither a name nor parameters")
            if low in ("class", "interface", "trait") and before.lower() not in ("new", "readonly", "]") and after not in ("(", "=>", ",", ":", "=", ";", ")", "|", "&") and not WORD.match(after):
                raise SourceError(line, f"a {low} has no name")
        if tok == "}":
            begin = owner[i]
            ahead = tokens[begin - 1][0] if begin else ";"
            matched = ahead == ")" and owner[begin - 1] > 0 and tokens[owner[begin - 1] - 1][0].lower() == "match"
            loose = ahead in ("->", "?->", "::", "$") or ahead.endswith("\\") or matched
            if not loose and before not in (";", "{", "}", ":") and tokens[i - 1][0] != "}":
                raise SourceError(line, "unexpected }")
    if n and tokens[-1][0] not in (";", "}", ":"):
        raise SourceError(tokens[-1][1], "the file ends amid a statement")


def php_contexts(tokens: list[Token], around: list[int], close: list[int]) -> list[dict]:
    """For every token the namespace, class and function that are open (ns, class_name, func_name, is_member), and for a
    declaration its kind, name and whether it is a member of a class-like body.

    Leaving any function leaves all; interfaces, traits and enums are no class, but their functions are members."""
    n, out, bodies = len(tokens), [], set()
    named = lambda j: j < n and bool(WORD.match(tokens[j][0])) and tokens[j][0][0] != "$"
    ends: dict[int, list[str]] = {}
    ns, owner, inner, is_member = "", "", "", False
    for i, (tok, _, _) in enumerate(tokens):
        for what in ends.pop(i, ()):
            if what == "ns":
                ns = ""
            elif what == "class":
                owner = ""
            else:
                inner, is_member = "", False
        own, word, before = {}, tok.lower(), tokens[i - 1][0] if i else ""
        if word in ("class", "interface", "trait", "enum", "function", "namespace"):
            stop = stop_of(tokens, close, i)
            at_block = stop < n and tokens[stop][0] == "{"
            until = close[stop] if at_block else stop
            if word == "namespace" and (named(i + 1) or stop == i + 1 and at_block):
                ns = tokens[i + 1][0] if named(i + 1) else ""
                if at_block:
                    ends.setdefault(until, []).append("ns")
            elif word == "function":
                at = i + 2 if i + 1 < n and tokens[i + 1][0] == "&" else i + 1
                if named(at) and before != "use":
                    own = {"kind": "function", "name": tokens[at][0], "member": around[i] in bodies}
                    inner, is_member = tokens[at][0], own["member"]
                    ends.setdefault(until, []).append("function")
            elif word != "namespace" and named(i + 1) and at_block and before not in ("::", "->", "?->", "new", "const", "function"):
                own = {"kind": word, "name": tokens[i + 1][0], "member": around[i] in bodies}
                bodies.add(stop)
                if word == "class":
                    owner = tokens[i + 1][0]
                    ends.setdefault(until, []).append("class")
        out.append(own | {"ns": ns, "class_name": owner, "func_name": inner, "is_member": is_member})
    return out
