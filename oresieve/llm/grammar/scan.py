"""Token scanner shared by the ECMAScript/TypeScript and Java recognisers.

A scan yields parallel lists (kind, text, line break before, start) and the partner of every bracket, so the parsers can look
past a bracketed group in one step. Unbalanced brackets end the scan at once.
"""

from __future__ import annotations

import re


class Bad(Exception):
    """The text is no sentence of the grammar."""


class Tokens:
    __slots__ = ("k", "v", "n", "p", "m", "sub", "end")

    def __init__(self):
        self.k, self.v, self.n, self.p = [], [], [], []
        self.m, self.sub, self.end = {}, {}, 0


JS_KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in "
    "instanceof new return super switch this throw try typeof var void while with null true false enum".split()
)
_VALUE_WORDS = frozenset("this super null true false".split())
_BLOCK_BEFORE = frozenset([")", ";", "{", "}", "=>", "else", "try", "finally", "do"])
_HEAD_WORDS = frozenset("if while for with".split())

_SPACE = r"[ \t\v\f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000\ufeff]"
# atomic: what is skipped is never given back to look for a token inside it
_SKIP = rf"(?>(?:{_SPACE}+|[\n\r\u2028\u2029]+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)*)"
_ID = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_NUM = (
    r"(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[bB][01]+(?:_[01]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?"
    r"|(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?n?)(?![\w$])"
)
_STR = r"\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"
_PUNCT = (
    r"\?\?=|\?\?|\?\.(?!\d)|\.\.\.|\.(?!\d)|=>|===|!==|==|!=|<<=|<<|<=|>=|\*\*=|\*\*|&&=|\|\|=|&&|\|\||\+\+|--|[-+*%&|^]=|[{}()\[\];,<>+\-*%&|^!~?:=@]"
)
_JS = re.compile(rf"{_SKIP}(?:({_ID})|({_PUNCT})|({_STR})|({_NUM})|(\#{_ID})|(/)|(`))")
_TAIL = re.compile(rf"{_SKIP}\Z")
_BREAK = re.compile(r"[\n\r\u2028\u2029]")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+/[\w$]*")
_TPL_RUN = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JSX_NAME = re.compile(rf"{_SKIP}([^\W\d][\w$.:-]*)")
_JSX_ATTR = re.compile(rf"{_SKIP}(?:([^\W\d][\w$:-]*)(?:{_SKIP}=)?|(\{{)|(/?>))")
_JSX_TEXT = re.compile(r"[^<{>}]*")
_SPACES = re.compile(_SKIP)
_GENERIC_ARROW = re.compile(r"<\s*(?:const\s+)?[^\W\d][\w$]*\s*(?:,|extends\b)")
_CLOSE = {")": "(", "]": "[", "}": "{"}


def _operand_next(t: Tokens, opened: list) -> bool:
    """Whether an operand (and so a regular expression or JSX) may start after the last token."""
    if not t.k:
        return True
    last = t.k[-1]
    if last in ("id", "num", "str", "tpl", "re", "jsx", "priv", "]", "++", "--") or last in _VALUE_WORDS:
        return False
    if last == ")":
        return t.m[len(t.k) - 1] > 0 and t.k[t.m[len(t.k) - 1] - 1] in _HEAD_WORDS
    if last == "}":
        at = t.m[len(t.k) - 1]
        return at == 0 or t.k[at - 1] in _BLOCK_BEFORE
    return True


def scan_js(text: str, pos: int = 0, inner: bool = False, jsx: bool = False, ts: bool = False) -> Tokens:
    """Tokens from pos; an inner scan (of a template or JSX hole) ends at the bracket that closes the hole."""
    t, opened = Tokens(), []
    k, v, n, p, m = t.k, t.v, t.n, t.p, t.m
    match, broke = _JS.match, _BREAK.search
    while True:
        g = match(text, pos)
        if g is None:
            if inner or not _TAIL.match(text, pos):
                raise Bad(pos)
            k.append("eof"), v.append(""), n.append(True), p.append(len(text))
            break
        which = g.lastindex
        start, end = g.span(which)
        word = g.group(which)
        line = start > pos and broke(text, pos, start) is not None
        if which == 1:
            kind = word if word in JS_KEYWORDS else "id"
        elif which == 2:
            kind = word
            if word in "([{":
                opened.append(len(k))
            elif word in ")]}":
                if not opened:
                    if inner and word == "}":
                        k.append("eof"), v.append(""), n.append(True), p.append(start)
                        t.end = end
                        return t
                    raise Bad(start)
                at = opened.pop()
                if k[at] != _CLOSE[word]:
                    raise Bad(start)
                m[at], m[len(k)] = len(k), at
            elif word == "<" and jsx and _operand_next(t, opened) and not (ts and _GENERIC_ARROW.match(text, start)):
                kind, end, t.sub[len(k)] = "jsx", *_jsx(text, start, ts)
        elif which == 3:
            kind = "str"
        elif which == 4:
            kind = "num"
        elif which == 5:
            kind = "priv"
        elif which == 6:
            if _operand_next(t, opened):
                r = _REGEX.match(text, start)
                if r is None:
                    raise Bad(start)
                kind, end = "re", r.end()
            else:
                kind = "/"
                if text.startswith("=", end):
                    kind, end = "/=", end + 1
        else:
            kind, end, t.sub[len(k)] = "tpl", *_template(text, end, jsx, ts)
        k.append(kind), v.append(word), n.append(line), p.append(start)
        pos = end
    if opened:
        raise Bad("open")
    return t


def _template(text, pos, jsx, ts):
    holes = []
    while True:
        pos = _TPL_RUN.match(text, pos).end()
        if text.startswith("`", pos):
            return pos + 1, holes
        if not text.startswith("${", pos):
            raise Bad(pos)
        holes.append(scan_js(text, pos + 2, True, jsx, ts))
        pos = holes[-1].end


def _jsx(text, pos, ts):
    """End and holes of the element that starts at pos."""
    holes, pos = [], _SPACES.match(text, pos + 1).end()
    name = None
    if not text.startswith(">", pos):
        g = _JSX_NAME.match(text, pos)
        if g is None:
            raise Bad(pos)
        name, pos = g.group(1), g.end()
        while True:
            g = _JSX_ATTR.match(text, pos)
            if g is None:
                raise Bad(pos)
            pos = g.end()
            if g.group(3) == "/>":
                return pos, holes
            if g.group(3):
                break
            if g.group(2):
                holes.append(scan_js(text, pos, True, True, ts))
                pos = holes[-1].end
            elif g.group(0).endswith("="):
                pos = _SPACES.match(text, pos).end()
                if text.startswith("{", pos):
                    holes.append(scan_js(text, pos + 1, True, True, ts))
                    pos = holes[-1].end
                elif text[pos : pos + 1] in ("'", '"'):
                    pos = text.find(text[pos], pos + 1) + 1
                    if not pos:
                        raise Bad("attribute")
                else:
                    raise Bad(pos)
    else:
        pos += 1
    while True:
        pos = _JSX_TEXT.match(text, pos).end()
        if text.startswith("{", pos):
            holes.append(scan_js(text, pos + 1, True, True, ts))
            pos = holes[-1].end
        elif text.startswith("</", pos):
            pos = _SPACES.match(text, pos + 2).end()
            if name:
                if not text.startswith(name, pos):
                    raise Bad(pos)
                pos = _SPACES.match(text, pos + len(name)).end()
            if not text.startswith(">", pos):
                raise Bad(pos)
            return pos + 1, holes
        elif text.startswith("<", pos):
            pos, more = _jsx(text, pos, ts)
            holes += more
        else:
            raise Bad(pos)


JAVA_KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float "
    "for goto if implements import instanceof int interface long native new package private protected public return short static "
    "strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
_JSKIP = r"(?>(?:[ \t\f]+|[\n\r]+|//[^\n\r]*|/\*[\s\S]*?\*/)*)"
_JNUM = (
    r"(?:0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+[fFdD]?)?[lL]?|0[bB][01](?:[01_]*[01])?[lL]?"
    r"|(?:\d(?:[\d_]*\d)?(?:\.(?:\d(?:[\d_]*\d)?)?)?|\.\d(?:[\d_]*\d)?)(?:[eE][+-]?\d+)?[lLfFdD]?)(?![\w$])"
)
_JESC = r"\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}|\r?\n)"
_JSTR = rf"\"\"\"[ \t\f]*\r?\n(?:[^\\\"]|{_JESC}|\"(?!\"\"))*\"\"\"|\"(?!\"\")(?:[^\"\\\n\r]|{_JESC})*\"|\"\"(?!\")"
_JCHR = rf"'(?:[^'\\\n\r]|{_JESC})'"
_JPUNCT = r"->|::|\.\.\.|\+\+|--|&&|\|\||==|!=|<=|>=|<<=|<<|[-+*/%&|^]=|[{}()\[\];,.@=<>!~?:+\-*/&|^%]"
_JAVA = re.compile(rf"{_JSKIP}(?:((?:[^\W\d]|\$)[\w$]*)|({_JSTR}|{_JCHR})|({_JNUM})|({_JPUNCT}))")
_JTAIL = re.compile(rf"{_JSKIP}\x1a?\Z")


def scan_java(text: str) -> Tokens:
    t, opened, pos = Tokens(), [], 0
    k, v, p, m = t.k, t.v, t.p, t.m
    match = _JAVA.match
    while True:
        g = match(text, pos)
        if g is None:
            if not _JTAIL.match(text, pos):
                raise Bad(pos)
            break
        which = g.lastindex
        word = g.group(which)
        if which == 1:
            kind = word if word in JAVA_KEYWORDS else "id"
        elif which == 4:
            kind = word
            if word in "([{":
                opened.append(len(k))
            elif word in ")]}":
                if not opened or k[opened[-1]] != _CLOSE[word]:
                    raise Bad(g.start(which))
                at = opened.pop()
                m[at], m[len(k)] = len(k), at
        else:
            kind = "lit"
        k.append(kind), v.append(word), p.append(g.start(which))
        pos = g.end()
    if opened:
        raise Bad("open")
    for _ in range(4):
        k.append("eof"), v.append(""), p.append(len(text))
    return t
