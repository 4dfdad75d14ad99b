"""Recogniser of ECMAScript 2022 (script or module), JSX, and TypeScript 5, by recursive descent over scanned tokens.

Static rules beyond the grammar (duplicate declarations, unresolved names) are not judged.
"""

from __future__ import annotations

from oresieve.llm.grammar.scan import JS_KEYWORDS, Bad, Tokens, scan_js

_ASSIGN = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
_BINARY = frozenset("+ - * / % ** << < > <= >= == != === !== & | ^ && || ?? instanceof in".split())
_PREFIX = frozenset("delete void typeof + - ~ !".split())
_CLASS_MODS = frozenset("static async get set".split())
_TS_MODS = frozenset("public private protected readonly abstract override declare accessor".split())
_AFTER_NAME = frozenset("( = ; } : ? ! < ,".split())
_TARGETS = frozenset(["id", "member"])
_OPERAND_START = frozenset(["id", "num", "str", "tpl", "re", "jsx", "(", "[", "{", "function", "class", "new", "this", "super", "null", "true", "false", "+", "-", "~", "!", "++", "--", "typeof", "void", "delete", "import", "priv", "@"])
_KEY = frozenset(["id", "str", "num"]) | JS_KEYWORDS
_NAME = frozenset(["id"]) | JS_KEYWORDS


class Script:
    def __init__(self, t: Tokens, ts: bool):
        self.ts, self.i, self.funcs, self.is_async, self.is_gen, self.ambient = ts, 0, 0, True, False, False
        self.use(t)

    def use(self, t: Tokens) -> None:
        self.t, self.k, self.v, self.n, self.m, self.p = t, t.k, t.v, t.n, t.m, t.p

    # -- helpers
    def want(self, kind: str) -> None:
        if self.k[self.i] != kind:
            raise Bad(self.i)
        self.i += 1

    def word(self, text: str) -> bool:
        return self.k[self.i] == "id" and self.v[self.i] == text

    def semi(self) -> None:
        kind = self.k[self.i]
        if kind == ";":
            self.i += 1
        elif kind != "}" and kind != "eof" and not self.n[self.i]:
            raise Bad(self.i)

    def attempt(self, rule) -> bool:
        at, funcs, a, g = self.i, self.funcs, self.is_async, self.is_gen
        try:
            if rule() is not False:
                return True
        except Bad:
            pass
        self.i, self.funcs, self.is_async, self.is_gen = at, funcs, a, g
        return False

    def holes(self) -> None:
        """The expressions inside the template or JSX element at the current token."""
        outer, at = self.t, self.i
        element = self.k[at] == "jsx"
        for t in outer.sub[at]:
            self.use(t)
            self.i = 0
            if self.k[0] == "eof":
                if not element:
                    raise Bad(at)
                continue
            if element and self.k[0] == "...":
                self.i = 1
            self.expression()
            if self.k[self.i] != "eof":
                raise Bad(at)
        self.use(outer)
        self.i = at + 1

    # -- statements
    def program(self) -> None:
        while self.k[self.i] != "eof":
            self.statement()

    def block(self) -> None:
        self.want("{")
        while self.k[self.i] != "}":
            self.statement()
        self.i += 1

    def statement(self) -> None:
        rule = _STATEMENTS.get(self.k[self.i])
        if rule is None:
            self.expression()
            self.semi()
        else:
            rule(self)

    def s_empty(self) -> None:
        self.i += 1

    def s_var(self) -> None:
        if self.ts and self.k[self.i] == "const" and self.k[self.i + 1] == "enum":
            self.i += 1
            return self.s_enum()
        self.declarations(False)
        self.semi()

    def declarations(self, head: bool) -> bool:
        """Declarators after var, let or const; in a for head, whether the one declarator has no initialiser."""
        const = self.k[self.i] == "const"
        self.i += 1
        bare = 0
        while True:
            pattern = self.k[self.i] in "[{"
            self.binding()
            if self.ts:
                if self.k[self.i] == "!":
                    self.i += 1
                if self.k[self.i] == ":":
                    self.i += 1
                    self.type()
            if self.k[self.i] == "=":
                self.i += 1
                self.assign(head)
            elif head and not bare and (self.k[self.i] == "in" or self.word("of")):
                return True
            elif (const or pattern) and not self.ambient:
                raise Bad(self.i)
            bare += 1
            if self.k[self.i] != ",":
                return False
            self.i += 1

    def binding(self) -> None:
        kind = self.k[self.i]
        if kind == "id":
            self.i += 1
        elif kind == "[":
            end = self.m[self.i]
            self.i += 1
            while self.i < end:
                if self.k[self.i] == ",":
                    self.i += 1
                    continue
                rest = self.k[self.i] == "..."
                self.i += rest
                self.binding()
                if self.k[self.i] == "=" and not rest:
                    self.i += 1
                    self.assign(False)
                if self.i < end:
                    self.want(",")
            self.want("]")
        elif kind == "{":
            end = self.m[self.i]
            self.i += 1
            while self.i < end:
                if self.k[self.i] == "...":
                    self.i += 1
                    self.want("id")
                else:
                    plain = self.k[self.i] == "id"
                    self.key()
                    if self.k[self.i] == ":":
                        self.i += 1
                        self.binding()
                    elif not plain:
                        raise Bad(self.i)
                    if self.k[self.i] == "=":
                        self.i += 1
                        self.assign(False)
                if self.i < end:
                    self.want(",")
            self.want("}")
        else:
            raise Bad(self.i)

    def s_if(self) -> None:
        while True:  # a chain of else if is one level, however long
            self.i += 1
            self.paren()
            self.statement()
            if self.k[self.i] != "else":
                break
            self.i += 1
            if self.k[self.i] != "if":
                self.statement()
                break

    def paren(self) -> None:
        self.want("(")
        self.expression()
        self.want(")")

    def s_while(self) -> None:
        self.i += 1
        self.paren()
        self.statement()

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.want("while")
        self.paren()
        if self.k[self.i] == ";":
            self.i += 1

    def s_for(self) -> None:
        self.i += 1
        if self.word("await"):
            self.i += 1
        self.want("(")
        kind = self.k[self.i]
        if kind == ";":
            pass
        elif kind in ("var", "const") or (kind == "id" and self.v[self.i] == "let" and self.k[self.i + 1] in ("id", "[", "{")):
            if self.declarations(True):
                return self.for_each()
        else:
            what = self.lhs() if not (self.k[self.i + 1] in ("=", ",", ";")) else None
            if what and (self.k[self.i] == "in" or self.word("of")):
                if what not in ("id", "member", "arr", "obj"):
                    raise Bad(self.i)
                return self.for_each()
            if what:
                # an ordinary expression that starts with what was just read
                self.i = self._for_start
            self.expression(True)
        self.want(";")
        if self.k[self.i] != ";":
            self.expression()
        self.want(";")
        if self.k[self.i] != ")":
            self.expression()
        self.want(")")
        self.statement()

    def for_each(self) -> None:
        of = self.k[self.i] != "in"
        self.i += 1
        self.assign(False) if of else self.expression()
        self.want(")")
        self.statement()

    def s_jump(self) -> None:
        self.i += 1
        if self.k[self.i] == "id" and not self.n[self.i]:
            self.i += 1
        self.semi()

    def s_return(self) -> None:
        if not self.funcs:
            raise Bad(self.i)
        self.i += 1
        if self.k[self.i] not in (";", "}", "eof") and not self.n[self.i]:
            self.expression()
        self.semi()

    def s_throw(self) -> None:
        self.i += 1
        if self.n[self.i]:
            raise Bad(self.i)
        self.expression()
        self.semi()

    def s_switch(self) -> None:
        self.i += 1
        self.paren()
        self.want("{")
        default = False
        while self.k[self.i] != "}":
            if self.k[self.i] == "case":
                self.i += 1
                self.expression()
            elif self.k[self.i] == "default" and not default:
                default = True
                self.i += 1
            else:
                raise Bad(self.i)
            self.want(":")
            while self.k[self.i] not in ("case", "default", "}"):
                self.statement()
        self.i += 1

    def s_try(self) -> None:
        self.i += 1
        self.block()
        done = False
        if self.k[self.i] == "catch":
            self.i += 1
            if self.k[self.i] == "(":
                self.i += 1
                self.binding()
                if self.ts and self.k[self.i] == ":":
                    self.i += 1
                    self.type()
                self.want(")")
            self.block()
            done = True
        if self.k[self.i] == "finally":
            self.i += 1
            self.block()
            done = True
        if not done:
            raise Bad(self.i)

    def s_debugger(self) -> None:
        self.i += 1
        self.semi()

    def s_function(self) -> None:
        self.function(False, True)

    def s_class(self) -> None:
        self.klass(True)

    def s_decorated(self) -> None:
        self.decorators()
        if self.k[self.i] == "export":
            return self.s_export()
        if self.ts and self.word("abstract"):
            self.i += 1
        self.klass(True)

    def s_enum(self) -> None:
        if not self.ts:
            raise Bad(self.i)
        self.i += 1
        self.want("id")
        self.want("{")
        while self.k[self.i] != "}":
            self.key()
            if self.k[self.i] == "=":
                self.i += 1
                self.assign(False)
            if self.k[self.i] != "}":
                self.want(",")
        self.i += 1

    def s_import(self) -> None:
        after = self.k[self.i + 1]
        if after in ("(", "."):
            self.expression()
            return self.semi()
        self.i += 1
        if after == "str":
            self.i += 1
            return self.attributes()
        if self.ts and self.word("type") and (self.k[self.i + 1] in ("{", "*") or (self.k[self.i + 1] == "id" and not (self.v[self.i + 1] == "from" and self.k[self.i + 2] == "str"))):
            self.i += 1
        if self.k[self.i] == "id":
            self.i += 1
            if self.ts and self.k[self.i] == "=":
                self.i += 1
                self.lhs()
                return self.semi()
            if self.k[self.i] == ",":
                self.i += 1
            else:
                return self.source()
        if self.k[self.i] == "*":
            self.i += 1
            if not self.word("as"):
                raise Bad(self.i)
            self.i += 1
            self.want("id")
        else:
            self.specifiers(True)
        self.source()

    def source(self) -> None:
        if not self.word("from"):
            raise Bad(self.i)
        self.i += 1
        self.want("str")
        self.attributes()

    def attributes(self) -> None:
        if self.k[self.i] == "with" or (self.word("assert") and not self.n[self.i]):
            self.i += 1
            if self.k[self.i] != "{":
                raise Bad(self.i)
            self.object()
        self.semi()

    def specifiers(self, local: bool) -> None:
        self.want("{")
        while self.k[self.i] != "}":
            if self.ts and self.word("type") and self.k[self.i + 1] in _KEY and not (self.v[self.i + 1] == "as" and self.k[self.i + 2] not in (",", "}")):
                self.i += 1
            last = self.k[self.i]
            if last not in _NAME and last != "str":
                raise Bad(self.i)
            self.i += 1
            if self.word("as"):
                self.i += 1
                last = self.k[self.i]
                if last not in _NAME and last != "str":
                    raise Bad(self.i)
                self.i += 1
            if local and last != "id":
                raise Bad(self.i)
            if self.k[self.i] != "}":
                self.want(",")
        self.i += 1

    def s_export(self) -> None:
        self.i += 1
        kind = self.k[self.i]
        if kind == "*":
            self.i += 1
            if self.word("as"):
                self.i += 1
                if self.k[self.i] not in _NAME and self.k[self.i] != "str":
                    raise Bad(self.i)
                self.i += 1
            return self.source()
        if self.ts and self.word("type") and self.k[self.i + 1] in ("{", "*"):
            self.i += 1
            kind = self.k[self.i]
            if kind == "*":
                self.i += 1
                if self.word("as"):
                    self.i += 2
                return self.source()
        if kind == "{":
            self.specifiers(False)
            return self.source() if self.word("from") else self.semi()
        if kind == "default":
            self.i += 1
            kind = self.k[self.i]
            if kind == "function" or (self.word("async") and self.k[self.i + 1] == "function" and not self.n[self.i + 1]):
                self.i += kind != "function"
                return self.function(kind != "function", False)
            if kind == "@":
                self.decorators()
                kind = self.k[self.i]
            if self.ts and self.word("abstract") and self.k[self.i + 1] == "class":
                self.i += 1
                kind = "class"
            if kind == "class":
                return self.klass(False)
            if self.ts and self.word("interface") and self.k[self.i + 1] == "id":
                return self.s_word()
            self.assign(False)
            return self.semi()
        if self.ts and kind == "=":
            self.i += 1
            self.expression()
            return self.semi()
        if self.ts and self.word("as"):
            self.i += 2
            self.want("id")
            return self.semi()
        if self.ts and kind == "import":
            return self.s_import()
        if kind in ("var", "const", "function", "class", "enum", "@"):
            return _STATEMENTS[kind](self)
        if kind == "id" and (self.v[self.i] in ("let", "async") or (self.ts and self.v[self.i] in ("interface", "type", "namespace", "module", "declare", "abstract"))):
            at = self.i
            self.s_word()
            if self.v[at] == "async" and self.k[at + 1] != "function":
                raise Bad(at)
            return None
        raise Bad(self.i)

    def s_word(self) -> None:
        """A statement that starts with an identifier."""
        i, v = self.i, self.v[self.i]
        after = self.k[i + 1]
        if after == ":":
            self.i += 2
            return self.statement()
        if v == "let" and after in ("id", "[", "{"):
            self.declarations(False)
            return self.semi()
        if v == "async" and after == "function" and not self.n[i + 1]:
            self.i += 1
            return self.function(True, True)
        if self.ts and not self.n[i + 1]:
            if v == "interface" and after == "id":
                self.i += 2
                self.type_params()
                if self.k[self.i] == "extends":
                    self.i += 1
                    self.type_list()
                return self.object_type()
            if v == "type" and after == "id":
                self.i += 2
                self.type_params()
                self.want("=")
                self.type()
                return self.semi()
            if v in ("namespace", "module", "global") and after in ("id", "str", "{") and (v == "global" or after != "{"):
                self.i += 1
                if self.k[self.i] == "str":
                    self.i += 1
                else:
                    while self.k[self.i] == "id":
                        self.i += 1
                        if self.k[self.i] == ".":
                            self.i += 1
                return self.block() if self.k[self.i] == "{" else self.semi()
            if v == "declare" and after in ("id", "var", "const", "function", "class", "enum"):
                self.i += 1
                was, self.ambient = self.ambient, True
                self.statement()
                self.ambient = was
                return None
            if v == "abstract" and after == "class":
                self.i += 1
                return self.klass(True)
        self.expression()
        self.semi()

    # -- functions and classes
    def function(self, is_async: bool, named: bool) -> None:
        self.want("function")
        gen = self.k[self.i] == "*"
        self.i += gen
        if self.k[self.i] == "id":
            self.i += 1
        elif named:
            raise Bad(self.i)
        self.rest_of_function(is_async, gen)

    def rest_of_function(self, is_async: bool, gen: bool, bodiless: bool = True) -> None:
        if self.ts:
            self.type_params()
        was = self.is_async, self.is_gen
        self.is_async, self.is_gen = is_async, gen
        self.funcs += 1
        self.params()
        if self.ts and self.k[self.i] == ":":
            self.i += 1
            self.return_type()
        if self.k[self.i] == "{":
            ambient, self.ambient = self.ambient, False
            self.block()
            self.ambient = ambient
        elif self.ts and bodiless:
            self.semi()
        else:
            raise Bad(self.i)
        self.funcs -= 1
        self.is_async, self.is_gen = was

    def params(self) -> None:
        self.want("(")
        while self.k[self.i] != ")":
            if self.k[self.i] == "@":
                self.decorators()
            if self.ts:
                while self.k[self.i] == "id" and self.v[self.i] in ("public", "private", "protected", "readonly", "override") and self.k[self.i + 1] in ("id", "{", "["):
                    self.i += 1
            rest = self.k[self.i] == "..."
            self.i += rest
            if self.ts and self.k[self.i] == "this":
                self.i += 1
            else:
                self.binding()
            if self.ts:
                if self.k[self.i] == "?":
                    self.i += 1
                if self.k[self.i] == ":":
                    self.i += 1
                    self.type()
            if self.k[self.i] == "=" and not rest:
                self.i += 1
                self.assign(False)
            if self.k[self.i] != ")":
                self.want(",")
                if rest:
                    raise Bad(self.i)
        self.i += 1

    def decorators(self) -> None:
        while self.k[self.i] == "@":
            self.i += 1
            self.lhs()

    def klass(self, named: bool) -> None:
        self.want("class")
        if self.k[self.i] == "id" and not (self.v[self.i] == "implements" and self.ts):
            self.i += 1
        elif named:
            raise Bad(self.i)
        if self.ts:
            self.type_params()
        if self.k[self.i] == "extends":
            self.i += 1
            self.lhs()
            if self.ts and self.k[self.i] == "<":
                self.type_args()
        if self.ts and self.word("implements"):
            self.i += 1
            self.type_list()
        self.want("{")
        while self.k[self.i] != "}":
            self.member()
        self.i += 1

    def member(self) -> None:
        k, v = self.k, self.v
        if k[self.i] == ";":
            self.i += 1
            return
        if k[self.i] == "@":
            self.decorators()
        is_async, accessor, bodiless = False, False, False
        while k[self.i] == "id" and (v[self.i] in _CLASS_MODS or (self.ts and v[self.i] in _TS_MODS)) and k[self.i + 1] not in _AFTER_NAME:
            word = v[self.i]
            if word != "static" and word not in _TS_MODS and self.n[self.i + 1]:
                break
            if word == "static" and k[self.i + 1] == "{":
                break
            is_async |= word == "async"
            accessor |= word in ("get", "set")
            bodiless |= word in ("abstract", "declare")
            self.i += 1
        if k[self.i] == "id" and v[self.i] == "static" and k[self.i + 1] == "{":
            self.i += 1
            self.funcs += 1
            self.block()
            self.funcs -= 1
            return
        gen = k[self.i] == "*"
        self.i += gen
        if self.ts and k[self.i] == "[" and k[self.i + 1] == "id" and k[self.i + 2] == ":":
            self.i += 3
            self.type()
            self.want("]")
            self.want(":")
            self.type()
            return self.semi()
        if k[self.i] == "priv":
            self.i += 1
        else:
            self.key()
        if self.ts and k[self.i] in ("?", "!"):
            self.i += 1
        if k[self.i] == "(" or (self.ts and k[self.i] == "<"):
            return self.rest_of_function(is_async, gen)
        if gen or is_async or accessor:
            raise Bad(self.i)
        if self.ts and k[self.i] == ":":
            self.i += 1
            self.type()
        if k[self.i] == "=":
            self.i += 1
            self.funcs += 1
            self.assign(False)
            self.funcs -= 1
        self.semi()

    def key(self) -> None:
        kind = self.k[self.i]
        if kind in _KEY:
            self.i += 1
        elif kind == "[":
            self.i += 1
            self.assign(False)
            self.want("]")
        else:
            raise Bad(self.i)

    # -- expressions
    def expression(self, head: bool = False) -> str:
        what = self.assign(head)
        while self.k[self.i] == ",":
            self.i += 1
            self.assign(head)
            what = "expr"
        return what

    def assign(self, head: bool = False) -> str:
        what = self._assign(head)
        return what

    def _assign(self, head: bool) -> str:
        i, k = self.i, self.k
        kind = k[i]
        if kind == "id":
            after = k[i + 1]
            if after == "=>":
                if self.n[i + 1]:
                    raise Bad(i)
                self.i += 1
                return self.arrow(False, head)
            word = self.v[i]
            if word == "async" and not self.n[i + 1]:
                if after == "id" and k[i + 2] == "=>":
                    self.i += 2
                    return self.arrow(True, head)
                if after == "(" and self.maybe_arrow(i + 1, True, head):
                    return "expr"
                if after == "<" and self.ts and self.attempt(lambda: self.generic_arrow(i + 1, True, head)):
                    return "expr"
            elif word == "yield" and self.is_gen:
                self.i += 1
                if not self.n[self.i]:
                    if k[self.i] == "*":
                        self.i += 1
                        self.assign(head)
                    elif k[self.i] in _OPERAND_START or k[self.i] == "/":
                        self.assign(head)
                return "expr"
        elif kind == "(":
            if self.maybe_arrow(i, False, head):
                return "expr"
        elif kind == "<" and self.ts:
            if self.attempt(lambda: self.generic_arrow(i, False, head)):
                return "expr"
        what = self.binary(head)
        kind = self.k[self.i]
        if kind == "?":
            self.i += 1
            mark = self.i
            if self.ts and not self.attempt(lambda: (self.assign(False), self.k[self.i] == ":")[1]):
                self.i, self._plain_paren = mark, True
                try:
                    self.assign(False)
                finally:
                    self._plain_paren = False
            elif not self.ts:
                self.assign(False)
            self.want(":")
            self.assign(head)
            return "expr"
        if kind == ">" and self.shifted_assign():
            kind = "+="
        if kind in _ASSIGN:
            if what not in _TARGETS and not (kind == "=" and what in ("arr", "obj")):
                raise Bad(self.i)
            self.i += 1
            self.assign(head)
            return "expr"
        return what

    _plain_paren = False
    _for_start = 0

    def shifted_assign(self) -> bool:
        """>>= and >>>= come as single > followed by >=."""
        j = self.i
        while self.k[j] == ">" and self.p[j + 1] == self.p[j] + 1:
            j += 1
            if self.k[j] == ">=":
                self.i = j
                return True
        return False

    def maybe_arrow(self, at: int, is_async: bool, head: bool) -> bool:
        end = self.m[at]
        after = self.k[end + 1]
        if after == "=>":
            if self.n[end + 1]:
                raise Bad(at)
        elif not (self.ts and after == ":" and not self._plain_paren):
            return False
        start = self.i

        def rule():
            self.i = at
            self.funcs += 1
            self.params()
            if self.k[self.i] == ":":
                self.i += 1
                self.return_type()
            if self.k[self.i] != "=>":
                return False
            self.arrow(is_async, head)
            self.funcs -= 1

        if after == "=>":
            self.i = at
            was = self.is_async
            self.is_async = is_async or (was and self.funcs == 0)
            self.params()
            self.is_async = was
            self.arrow(is_async, head)
            return True
        if self.attempt(rule):
            return True
        self.i = start
        return False

    def generic_arrow(self, at: int, is_async: bool, head: bool):
        self.i = at
        self.type_params()
        self.params()
        if self.k[self.i] == ":":
            self.i += 1
            self.return_type()
        if self.k[self.i] != "=>":
            return False
        self.arrow(is_async, head)

    def arrow(self, is_async: bool, head: bool) -> str:
        self.want("=>")
        was = self.is_async, self.is_gen, self._plain_paren
        self.is_async, self.is_gen, self._plain_paren = is_async, False, False
        self.funcs += 1
        if self.k[self.i] == "{":
            self.block()
        else:
            self._plain_paren = was[2]
            self.assign(head)
        self.funcs -= 1
        self.is_async, self.is_gen, self._plain_paren = was
        return "expr"

    def binary(self, head: bool) -> str:
        if self.k[self.i] == "priv":
            self.i += 1
            if self.k[self.i] != "in":
                raise Bad(self.i)
            what = "expr"
        else:
            what = self.unary()
        k = self.k
        while True:
            kind = k[self.i]
            if kind in _BINARY:
                if kind == "in" and head:
                    return what
                if kind == ">":
                    j = self.i
                    while k[j] == ">" and self.p[j + 1] == self.p[j] + 1 and k[j + 1] in (">", ">="):
                        j += 1
                    if k[j] == ">=" and j > self.i:
                        return what
                    self.i = j
                self.i += 1
                self.unary()
                what = "expr"
            elif kind == "id" and self.ts and not self.n[self.i] and self.v[self.i] in ("as", "satisfies"):
                self.i += 1
                if k[self.i] == "const":
                    self.i += 1
                else:
                    self.type()
                what = "member" if what in _TARGETS else "expr"
            else:
                return what

    def unary(self) -> str:
        k = self.k
        kind = k[self.i]
        if kind in _PREFIX:
            while k[self.i] in _PREFIX:
                self.i += 1
            self.unary()
            return "expr"
        if kind in ("++", "--"):
            self.i += 1
            if self.unary() not in _TARGETS:
                raise Bad(self.i)
            return "expr"
        if kind == "id" and self.v[self.i] == "await" and (self.is_async or not self.funcs) and k[self.i + 1] in _OPERAND_START:
            self.i += 1
            self.unary()
            return "expr"
        if kind == "<" and self.ts:
            self.type_args()
            self.unary()
            return "expr"
        what = self.lhs()
        if k[self.i] in ("++", "--") and not self.n[self.i]:
            if what not in _TARGETS:
                raise Bad(self.i)
            self.i += 1
            return "expr"
        return what

    def lhs(self, calls: bool = True) -> str:
        self._for_start = start = self.i
        what = self._lhs(calls)
        self._for_start = start
        return what

    def _lhs(self, calls: bool) -> str:
        k = self.k
        kind = k[self.i]
        if kind == "new":
            self.i += 1
            if k[self.i] == ".":
                self.i += 2
            else:
                self.lhs(False)
                if self.ts and k[self.i] == "<":
                    self.attempt(self.type_args)
                if k[self.i] == "(":
                    self.arguments()
            what = "expr"
        elif kind == "super":
            self.i += 1
            if k[self.i] not in ("(", ".", "["):
                raise Bad(self.i)
            what = "expr"
        elif kind == "import":
            self.i += 1
            if k[self.i] == ".":
                self.i += 2
            elif k[self.i] != "(":
                raise Bad(self.i)
            what = "expr"
        else:
            what = self.primary()
        optional = False
        while True:
            kind = k[self.i]
            if kind == ".":
                self.i += 1
                if k[self.i] not in _NAME and k[self.i] != "priv":
                    raise Bad(self.i)
                self.i += 1
                what = "expr" if optional else "member"
            elif kind == "(":
                if not calls:
                    return what
                self.arguments()
                what = "call"
            elif kind == "[":
                self.i += 1
                self.expression()
                self.want("]")
                what = "expr" if optional else "member"
            elif kind == "?.":
                if not calls:
                    raise Bad(self.i)
                optional = True
                self.i += 1
                kind = k[self.i]
                if kind == "(":
                    self.arguments()
                elif kind == "[":
                    self.i += 1
                    self.expression()
                    self.want("]")
                elif kind in _NAME or kind == "priv":
                    self.i += 1
                else:
                    raise Bad(self.i)
                what = "expr"
            elif kind == "tpl":
                self.holes()
                what = "expr"
            elif kind == "!" and self.ts and not self.n[self.i]:
                self.i += 1
            elif kind == "<" and self.ts and what != "expr" and self.attempt(lambda: self.call_type_args(calls)):
                if not calls:
                    return what
            else:
                return what

    def call_type_args(self, calls: bool):
        self.type_args()
        return self.k[self.i] in ("(", "tpl") or (self.k[self.i] not in _OPERAND_START)

    def arguments(self) -> None:
        self.i += 1
        while self.k[self.i] != ")":
            if self.k[self.i] == "...":
                self.i += 1
            self.assign(False)
            if self.k[self.i] != ")":
                self.want(",")
        self.i += 1

    def primary(self) -> str:
        i = self.i
        kind = self.k[i]
        if kind == "id":
            if self.v[i] == "async" and self.k[i + 1] == "function" and not self.n[i + 1]:
                self.i += 1
                self.function(True, False)
                return "expr"
            self.i += 1
            return "id"
        if kind in ("num", "str", "re", "this", "null", "true", "false"):
            self.i += 1
            return "expr"
        if kind == "(":
            was, self._plain_paren = self._plain_paren, False
            self.i += 1
            what = self.expression()
            self.want(")")
            self._plain_paren = was
            return what if what in _TARGETS else "expr"
        if kind == "[":
            self.i += 1
            while self.k[self.i] != "]":
                if self.k[self.i] == ",":
                    self.i += 1
                    continue
                if self.k[self.i] == "...":
                    self.i += 1
                self.assign(False)
                if self.k[self.i] != "]":
                    self.want(",")
            self.i += 1
            return "arr"
        if kind == "{":
            self.object()
            return "obj"
        if kind in ("tpl", "jsx"):
            self.holes()
            return "expr"
        if kind == "function":
            self.function(False, False)
            return "expr"
        if kind == "class":
            self.klass(False)
            return "expr"
        if kind == "@":
            self.decorators()
            self.klass(False)
            return "expr"
        raise Bad(i)

    def object(self) -> None:
        k = self.k
        was, self._plain_paren = self._plain_paren, False
        self.i += 1
        while k[self.i] != "}":
            if k[self.i] == "...":
                self.i += 1
                self.assign(False)
            else:
                is_async = accessor = False
                if k[self.i] == "id" and self.v[self.i] in ("get", "set", "async") and k[self.i + 1] not in (",", ":", "(", "}", "=", "<"):
                    is_async, accessor = self.v[self.i] == "async", self.v[self.i] != "async"
                    self.i += 1
                gen = k[self.i] == "*"
                self.i += gen
                plain = k[self.i] == "id"
                self.key()
                if k[self.i] == "(" or (self.ts and k[self.i] == "<"):
                    self.rest_of_function(is_async, gen, False)
                elif is_async or accessor or gen:
                    raise Bad(self.i)
                elif k[self.i] == ":":
                    self.i += 1
                    self.assign(False)
                elif not plain:
                    raise Bad(self.i)
                elif k[self.i] == "=":
                    self.i += 1
                    self.assign(False)
            if k[self.i] != "}":
                self.want(",")
        self.i += 1
        self._plain_paren = was

    # -- types
    def type_params(self) -> None:
        if self.k[self.i] != "<":
            return
        self.i += 1
        while True:
            while self.k[self.i] in ("const", "in") or (self.word("out") and self.k[self.i + 1] == "id"):
                self.i += 1
            self.want("id")
            if self.k[self.i] == "extends":
                self.i += 1
                self.type()
            if self.k[self.i] == "=":
                self.i += 1
                self.type()
            if self.k[self.i] == ",":
                self.i += 1
                if self.k[self.i] != ">":
                    continue
            self.want(">")
            return

    def type_args(self) -> None:
        self.want("<")
        while True:
            self.type()
            if self.k[self.i] == ",":
                self.i += 1
                continue
            self.want(">")
            return

    def type_list(self) -> None:
        while True:
            self.type()
            if self.k[self.i] != ",":
                return
            self.i += 1

    def return_type(self) -> None:
        if self.word("asserts") and self.k[self.i + 1] in ("id", "this") and not self.n[self.i + 1]:
            self.i += 2
            if self.word("is"):
                self.i += 1
                self.type()
            return
        if self.k[self.i] in ("id", "this") and self.k[self.i + 1] == "id" and self.v[self.i + 1] == "is" and not self.n[self.i + 1]:
            self.i += 2
        self.type()

    def type(self) -> None:
        kind = self.k[self.i]
        if kind == "<" or kind == "new" or (self.word("abstract") and self.k[self.i + 1] == "new") or (kind == "(" and self.k[self.m[self.i] + 1] == "=>"):
            self.i += kind == "id"
            self.i += self.k[self.i] == "new"
            self.type_params()
            self.params()
            self.want("=>")
            self.return_type()
        else:
            self.union()
            if self.k[self.i] == "extends" and not self.n[self.i]:
                self.i += 1
                self.union()
                if self.k[self.i] == "?":
                    self.i += 1
                    self.type()
                    self.want(":")
                    self.type()

    def union(self) -> None:
        if self.k[self.i] in ("|", "&"):
            self.i += 1
        while True:
            if self.k[self.i] == "(" and self.k[self.m[self.i] + 1] == "=>" or self.k[self.i] == "new":
                self.type()
            else:
                self.type_operand()
            if self.k[self.i] not in ("|", "&"):
                return
            self.i += 1

    def type_operand(self) -> None:
        k = self.k
        while (k[self.i] == "id" and self.v[self.i] in ("keyof", "unique", "readonly", "infer") and k[self.i + 1] in ("id", "(", "[", "{", "typeof", "this", "str", "void")):
            self.i += 1
        kind = k[self.i]
        if kind == "id":
            self.i += 1
            while k[self.i] == ".":
                self.i += 1
                if k[self.i] not in _NAME:
                    raise Bad(self.i)
                self.i += 1
            if k[self.i] == "<" and not self.n[self.i]:
                self.type_args()
        elif kind in ("void", "null", "this", "true", "false", "str", "num"):
            self.i += 1
        elif kind == "-":
            self.i += 1
            self.want("num")
        elif kind == "tpl":
            outer, at = self.t, self.i
            for t in outer.sub[at]:
                self.use(t)
                self.i = 0
                self.type()
                if self.k[self.i] != "eof":
                    raise Bad(at)
            self.use(outer)
            self.i = at + 1
        elif kind == "typeof":
            self.i += 1
            if k[self.i] == "import":
                return self.type_operand()
            while True:
                if k[self.i] not in _NAME and k[self.i] != "priv":
                    raise Bad(self.i)
                self.i += 1
                if k[self.i] != ".":
                    break
                self.i += 1
            if k[self.i] == "<" and not self.n[self.i]:
                self.type_args()
        elif kind == "import":
            self.i += 1
            self.want("(")
            self.type()
            self.want(")")
            while k[self.i] == ".":
                self.i += 2
            if k[self.i] == "<":
                self.type_args()
        elif kind == "(":
            self.i += 1
            self.type()
            self.want(")")
        elif kind == "[":
            self.i += 1
            while k[self.i] != "]":
                if k[self.i] == "...":
                    self.i += 1
                if k[self.i] == "id" and (k[self.i + 1] == ":" or (k[self.i + 1] == "?" and k[self.i + 2] == ":")):
                    self.i += 2 if k[self.i + 1] == ":" else 3
                self.type()
                if k[self.i] == "?":
                    self.i += 1
                if k[self.i] != "]":
                    self.want(",")
            self.i += 1
        elif kind == "{":
            self.object_type()
        else:
            raise Bad(self.i)
        while k[self.i] == "[" and not self.n[self.i]:
            self.i += 1
            if k[self.i] != "]":
                self.type()
            self.want("]")

    def object_type(self) -> None:
        k = self.k
        self.want("{")
        while k[self.i] != "}":
            if k[self.i] in ("+", "-"):
                self.i += 1
            while k[self.i] == "id" and self.v[self.i] in ("readonly", "get", "set") and (k[self.i + 1] in _KEY or k[self.i + 1] == "["):
                self.i += 1
            if k[self.i] == "new" and k[self.i + 1] in ("(", "<"):
                self.i += 1
            if k[self.i] in ("(", "<"):
                self.type_params()
                self.params()
            elif k[self.i] == "[":
                at = self.i
                self.i += 1
                if k[self.i] == "id" and k[self.i + 1] == ":":
                    self.i += 2
                    self.type()
                elif k[self.i] == "id" and k[self.i + 1] == "in":
                    self.i += 2
                    self.type()
                    if self.word("as"):
                        self.i += 1
                        self.type()
                else:
                    self.assign(False)
                self.want("]")
                if self.i - 1 != self.m[at]:
                    raise Bad(at)
            else:
                self.key()
            if k[self.i] in ("+", "-"):
                self.i += 1
            if k[self.i] == "?":
                self.i += 1
            if k[self.i] in ("(", "<"):
                self.type_params()
                self.params()
            if k[self.i] == ":":
                self.i += 1
                self.return_type()
            if k[self.i] in (";", ","):
                self.i += 1
            elif k[self.i] != "}" and not self.n[self.i]:
                raise Bad(self.i)
        self.i += 1


_STATEMENTS = {
    "{": Script.block, ";": Script.s_empty, "var": Script.s_var, "const": Script.s_var, "if": Script.s_if, "while": Script.s_while,
    "do": Script.s_do, "for": Script.s_for, "continue": Script.s_jump, "break": Script.s_jump, "return": Script.s_return,
    "throw": Script.s_throw, "switch": Script.s_switch, "try": Script.s_try, "debugger": Script.s_debugger, "with": Script.s_while,
    "function": Script.s_function, "class": Script.s_class, "@": Script.s_decorated, "enum": Script.s_enum, "import": Script.s_import,
    "export": Script.s_export, "id": Script.s_word,
}


def parse_script(text: str, ts: bool = False, jsx: bool = False) -> None:
    """Raises Bad unless text is a program."""
    start = 0
    if text.startswith("#!"):
        start = min((x for x in (text.find("\n"), text.find("\r")) if x >= 0), default=len(text))
    Script(scan_js(text, start, False, jsx, ts), ts).program()
