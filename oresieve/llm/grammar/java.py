"""Recogniser of Java 17 compilation units, by recursive descent over scanned tokens."""

from __future__ import annotations

from oresieve.llm.grammar.scan import Bad, Tokens, scan_java

_PRIMITIVE = frozenset("boolean byte char double float int long short".split())
_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<=".split())
_BINARY = frozenset("|| && | ^ & == != < > <= >= << + - * / %".split())
_UNARY_NOT_PLUS = frozenset(["id", "lit", "this", "super", "new", "(", "!", "~", "switch", "true", "false", "null", "void"]) | _PRIMITIVE
_CAN_STAND = frozenset(["assign", "call", "new", "step"])


class Java:
    def __init__(self, t: Tokens):
        self.k, self.v, self.m, self.p, self.i = t.k, t.v, t.m, t.p, 0

    def want(self, kind: str) -> None:
        if self.k[self.i] != kind:
            raise Bad(self.i)
        self.i += 1

    def word(self, text: str) -> bool:
        return self.k[self.i] == "id" and self.v[self.i] == text

    def attempt(self, rule) -> bool:
        at = self.i
        try:
            if rule() is not False:
                return True
        except Bad:
            pass
        self.i = at
        return False

    # -- declarations
    def unit(self) -> None:
        k = self.k
        at = self.i
        if k[self.i] == "@":
            self.modifiers()
        if k[self.i] == "package":
            self.i += 1
            self.name()
            self.want(";")
        else:
            self.i = at
        while k[self.i] in ("import", ";"):
            if k[self.i] == "import":
                self.i += 1
                if k[self.i] == "static":
                    self.i += 1
                self.name(True)
                self.want(";")
            else:
                self.i += 1
        if self.word("module") or self.word("open"):
            return self.module()
        while k[self.i] != "eof":
            if k[self.i] == ";":
                self.i += 1
                continue
            self.modifiers()
            if not self.type_declaration():
                raise Bad(self.i)

    def module(self) -> None:
        self.i += self.word("open")
        self.i += 1
        self.name()
        self.want("{")
        while self.k[self.i] != "}":
            while self.k[self.i] in ("id", ".", ",", "static"):
                self.i += 1
            self.want(";")
        self.i += 1
        self.want("eof")

    def name(self, star: bool = False) -> None:
        self.want("id")
        while self.k[self.i] == ".":
            self.i += 1
            if star and self.k[self.i] == "*":
                self.i += 1
                return
            self.want("id")

    def modifiers(self) -> None:
        k = self.k
        while True:
            kind = k[self.i]
            if kind == "@" and k[self.i + 1] != "interface":
                self.annotation()
            elif kind in _MODIFIERS:
                if kind == "default" and k[self.i + 1] in (":", "->"):
                    return
                if kind == "synchronized" and k[self.i + 1] == "(":
                    return
                self.i += 1
            elif kind == "id" and self.v[self.i] == "sealed" and k[self.i + 1] in ("class", "interface", "abstract", "public", "static", "id"):
                self.i += 1
            elif kind == "id" and self.v[self.i] == "non" and k[self.i + 1] == "-" and self.v[self.i + 2] == "sealed":
                self.i += 3
            else:
                return

    def annotation(self) -> None:
        self.want("@")
        self.name()
        if self.k[self.i] == "(":
            self.i += 1
            if self.k[self.i] == "id" and self.k[self.i + 1] == "=":
                while True:
                    self.want("id")
                    self.want("=")
                    self.element_value()
                    if self.k[self.i] != ",":
                        break
                    self.i += 1
            elif self.k[self.i] != ")":
                self.element_value()
            self.want(")")

    def element_value(self) -> None:
        if self.k[self.i] == "@":
            self.annotation()
        elif self.k[self.i] == "{":
            self.i += 1
            while self.k[self.i] != "}":
                self.element_value()
                if self.k[self.i] != "}":
                    self.want(",")
            self.i += 1
        else:
            self.ternary()

    def type_declaration(self) -> bool:
        k = self.k
        kind = k[self.i]
        if kind == "class":
            self.i += 1
            self.want("id")
            self.type_params()
            if k[self.i] == "extends":
                self.i += 1
                self.type()
            self.implements()
            self.class_body()
        elif kind == "interface":
            self.i += 1
            self.want("id")
            self.type_params()
            if k[self.i] == "extends":
                self.i += 1
                self.types()
            self.implements()
            self.class_body()
        elif kind == "enum":
            self.i += 1
            self.want("id")
            self.implements()
            self.want("{")
            while k[self.i] in ("id", "@"):
                while k[self.i] == "@":
                    self.annotation()
                self.want("id")
                if k[self.i] == "(":
                    self.arguments()
                if k[self.i] == "{":
                    self.class_body()
                if k[self.i] != ",":
                    break
                self.i += 1
            if k[self.i] == ",":
                self.i += 1
            if k[self.i] == ";":
                self.i += 1
                while k[self.i] != "}":
                    self.member()
            self.want("}")
        elif kind == "@" and k[self.i + 1] == "interface":
            self.i += 2
            self.want("id")
            self.class_body()
        elif kind == "id" and self.v[self.i] == "record" and k[self.i + 1] == "id" and k[self.i + 2] in ("(", "<"):
            self.i += 2
            self.type_params()
            self.params()
            self.implements()
            self.class_body()
        else:
            return False
        return True

    def implements(self) -> None:
        if self.k[self.i] == "implements":
            self.i += 1
            self.types()
        if self.word("permits"):
            self.i += 1
            self.types()

    def types(self) -> None:
        self.type()
        while self.k[self.i] == ",":
            self.i += 1
            self.type()

    def class_body(self) -> None:
        self.want("{")
        while self.k[self.i] != "}":
            self.member()
        self.i += 1

    def member(self) -> None:
        k = self.k
        if k[self.i] == ";":
            self.i += 1
            return
        if k[self.i] == "{" or (k[self.i] == "static" and k[self.i + 1] == "{"):
            self.i += k[self.i] == "static"
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return
        self.type_params()
        if k[self.i] == "id" and k[self.i + 1] in ("(", "{"):
            self.i += 1
            if k[self.i] == "(":
                self.params()
                self.throws()
            return self.block()
        if k[self.i] == "void":
            self.i += 1
        else:
            self.type()
        self.want("id")
        if k[self.i] == "(":
            self.params()
            self.dims()
            self.throws()
            if k[self.i] == "default":
                self.i += 1
                self.element_value()
            if k[self.i] == "{":
                return self.block()
            return self.want(";")
        self.declarators()
        self.want(";")

    def throws(self) -> None:
        if self.k[self.i] == "throws":
            self.i += 1
            self.types()

    def dims(self) -> None:
        while self.k[self.i] == "@":
            self.annotation()
        while self.k[self.i] == "[" and self.k[self.i + 1] == "]":
            self.i += 2

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.k[self.i] == "=":
                self.i += 1
                self.initialiser()
            if self.k[self.i] != ",":
                return
            self.i += 1
            self.want("id")

    def initialiser(self) -> None:
        if self.k[self.i] == "{":
            self.i += 1
            while self.k[self.i] != "}":
                if self.k[self.i] == "," and self.k[self.i + 1] == "}":
                    self.i += 1
                    break
                self.initialiser()
                if self.k[self.i] != "}":
                    self.want(",")
            self.want("}")
        else:
            self.expression()

    def params(self) -> None:
        self.want("(")
        while self.k[self.i] != ")":
            self.modifiers()
            self.type()
            while self.k[self.i] == "@":
                self.annotation()
            rest = self.k[self.i] == "..."
            self.i += rest
            if self.k[self.i] == "id" and self.k[self.i + 1] == "." and self.k[self.i + 2] == "this":
                self.i += 2
            if self.k[self.i] == "this":
                self.i += 1
            else:
                self.want("id")
            self.dims()
            if self.k[self.i] != ")":
                self.want(",")
                if rest or self.k[self.i] == ")":
                    raise Bad(self.i)
        self.i += 1

    def type_params(self) -> None:
        if self.k[self.i] != "<":
            return
        self.i += 1
        while True:
            while self.k[self.i] == "@":
                self.annotation()
            self.want("id")
            if self.k[self.i] == "extends":
                self.i += 1
                self.type()
                while self.k[self.i] == "&":
                    self.i += 1
                    self.type()
            if self.k[self.i] != ",":
                break
            self.i += 1
        self.want(">")

    # -- types
    def type(self, dims: bool = True) -> None:
        k = self.k
        while k[self.i] == "@":
            self.annotation()
        if k[self.i] in _PRIMITIVE:
            self.i += 1
        else:
            while True:
                self.want("id")
                if k[self.i] == "<":
                    self.type_args()
                if k[self.i] != "." or k[self.i + 1] not in ("id", "@"):
                    break
                self.i += 1
                while k[self.i] == "@":
                    self.annotation()
        if dims:
            self.dims()

    def type_args(self) -> None:
        k = self.k
        self.want("<")
        if k[self.i] == ">":
            self.i += 1
            return
        while True:
            while k[self.i] == "@":
                self.annotation()
            if k[self.i] == "?":
                self.i += 1
                if k[self.i] in ("extends", "super"):
                    self.i += 1
                    self.type()
            else:
                at = self.i
                self.type()
                if self.i == at + 1 and k[at] in _PRIMITIVE:
                    raise Bad(at)
            if k[self.i] != ",":
                break
            self.i += 1
        self.want(">")

    # -- statements
    def block(self) -> None:
        self.want("{")
        while self.k[self.i] != "}":
            self.block_statement()
        self.i += 1

    def local(self) -> bool:
        """type name, then = ; , [ or : : a local variable declaration begins."""
        self.type()
        return self.k[self.i] == "id" and self.k[self.i + 1] in ("=", ";", ",", "[", ":", ")")

    def block_statement(self) -> None:
        k = self.k
        kind = k[self.i]
        if kind in ("final", "abstract", "static", "@", "class", "interface", "enum", "strictfp"):
            self.modifiers()
            if self.type_declaration():
                return
            self.type()
            self.want("id")
            self.declarators()
            return self.want(";")
        if kind == "id":
            if self.v[self.i] == "record" and k[self.i + 1] == "id" and k[self.i + 2] in ("(", "<"):
                self.type_declaration()
                return
            if self.v[self.i] in ("sealed", "non"):
                self.modifiers()
                if self.type_declaration():
                    return
            after = k[self.i + 1]
            if after == "id" and not (self.v[self.i] == "yield" and k[self.i + 2] not in ("=", ",")) or after in (".", "<", "[", "@"):
                if self.attempt(self.local):
                    self.want("id")
                    self.declarators()
                    return self.want(";")
        elif kind in _PRIMITIVE and k[self.i + 1] not in (".", "::"):
            if self.attempt(self.local):
                self.want("id")
                self.declarators()
                return self.want(";")
        self.statement()

    def statement(self) -> None:
        k = self.k
        kind = k[self.i]
        if kind == "{":
            self.block()
        elif kind == ";":
            self.i += 1
        elif kind == "if":
            while True:  # a chain of else if is one level, however long
                self.i += 1
                self.paren()
                self.statement()
                if k[self.i] != "else":
                    break
                self.i += 1
                if k[self.i] != "if":
                    self.statement()
                    break
        elif kind == "while":
            self.i += 1
            self.paren()
            self.statement()
        elif kind == "do":
            self.i += 1
            self.statement()
            self.want("while")
            self.paren()
            self.want(";")
        elif kind == "for":
            self.for_statement()
        elif kind == "return":
            self.i += 1
            if k[self.i] != ";":
                self.expression()
            self.want(";")
        elif kind == "throw":
            self.i += 1
            self.expression()
            self.want(";")
        elif kind in ("break", "continue"):
            self.i += 1
            self.i += k[self.i] == "id"
            self.want(";")
        elif kind == "try":
            self.try_statement()
        elif kind == "switch":
            self.switch()
            if k[self.i] in (".", "::"):
                raise Bad(self.i)
        elif kind == "synchronized":
            self.i += 1
            self.paren()
            self.block()
        elif kind == "assert":
            self.i += 1
            self.expression()
            if k[self.i] == ":":
                self.i += 1
                self.expression()
            self.want(";")
        elif kind == "id" and k[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif kind == "id" and self.v[self.i] == "yield" and k[self.i + 1] not in ("=", ".", "[", "++", "--"):
            self.i += 1
            self.expression()
            self.want(";")
        else:
            if self.expression() not in _CAN_STAND:
                raise Bad(self.i)
            self.want(";")

    def paren(self) -> None:
        self.want("(")
        self.expression()
        self.want(")")

    def for_statement(self) -> None:
        k = self.k
        self.i += 1
        self.want("(")
        if k[self.i] != ";":
            at = self.i
            if k[at] in ("final", "@") or self.attempt(self.local):
                self.i = at
                self.modifiers()
                self.type()
                self.want("id")
                if k[self.i] == ":":
                    self.i += 1
                    self.expression()
                    self.want(")")
                    return self.statement()
                self.declarators()
            else:
                self.statement_expressions()
        self.want(";")
        if k[self.i] != ";":
            self.expression()
        self.want(";")
        if k[self.i] != ")":
            self.statement_expressions()
        self.want(")")
        self.statement()

    def statement_expressions(self) -> None:
        while True:
            if self.expression() not in _CAN_STAND:
                raise Bad(self.i)
            if self.k[self.i] != ",":
                return
            self.i += 1

    def try_statement(self) -> None:
        k = self.k
        self.i += 1
        done = False
        if k[self.i] == "(":
            done = True
            self.i += 1
            while k[self.i] != ")":
                at = self.i
                if k[at] in ("final", "@") or self.attempt(self.local):
                    self.i = at
                    self.modifiers()
                    self.type()
                    self.want("id")
                    self.want("=")
                self.expression()
                if k[self.i] != ")":
                    self.want(";")
            self.i += 1
        self.block()
        while k[self.i] == "catch":
            done = True
            self.i += 1
            self.want("(")
            self.modifiers()
            self.type()
            while k[self.i] == "|":
                self.i += 1
                self.type()
            self.want("id")
            self.want(")")
            self.block()
        if k[self.i] == "finally":
            done = True
            self.i += 1
            self.block()
        if not done:
            raise Bad(self.i)

    def switch(self) -> None:
        k = self.k
        self.want("switch")
        self.paren()
        self.want("{")
        while k[self.i] != "}":
            if k[self.i] == "default":
                self.i += 1
            else:
                self.want("case")
                while True:
                    if k[self.i] == "default":
                        self.i += 1
                    else:
                        self.ternary()
                    if k[self.i] != ",":
                        break
                    self.i += 1
            if k[self.i] == "->":
                self.i += 1
                if k[self.i] == "{":
                    self.block()
                elif k[self.i] == "throw":
                    self.statement()
                else:
                    self.expression()
                    self.want(";")
            else:
                self.want(":")
                while k[self.i] not in ("case", "default", "}"):
                    self.block_statement()
        self.i += 1

    # -- expressions
    def expression(self) -> str:
        what = self._expression()
        return what

    def _expression(self) -> str:
        k = self.k
        if k[self.i] == "id" and k[self.i + 1] == "->":
            self.i += 2
            return self.lambda_body()
        if k[self.i] == "(" and k[self.m[self.i] + 1] == "->":
            self.lambda_params()
            self.want("->")
            return self.lambda_body()
        what = self.ternary()
        kind = k[self.i]
        if kind == ">":
            j = self.i
            while k[j] == ">" and self.p[j + 1] == self.p[j] + 1:
                j += 1
            if k[j] == ">=":
                self.i, kind = j, "="
        if kind in _ASSIGN:
            if what != "name":
                raise Bad(self.i)
            self.i += 1
            self.expression()
            return "assign"
        return what

    def lambda_params(self) -> None:
        k = self.k
        end = self.m[self.i]
        if k[self.i + 1] == "id" and k[self.i + 2] in (",", ")"):
            self.i += 1
            while True:
                self.want("id")
                if k[self.i] != ",":
                    break
                self.i += 1
            self.want(")")
        else:
            self.params()
        if self.i != end + 1:
            raise Bad(self.i)

    def lambda_body(self) -> str:
        if self.k[self.i] == "{":
            self.block()
        else:
            self.expression()
        return "lambda"

    def ternary(self) -> str:
        what = self.binary()
        if self.k[self.i] == "?":
            self.i += 1
            self.expression()
            self.want(":")
            if (self.k[self.i] == "id" and self.k[self.i + 1] == "->") or (self.k[self.i] == "(" and self.k[self.m[self.i] + 1] == "->"):
                self.expression()
            else:
                self.ternary()
            return "value"
        return what

    def binary(self) -> str:
        k = self.k
        what = self.unary()
        while True:
            kind = k[self.i]
            if kind in _BINARY:
                if kind == ">":
                    j = self.i
                    while k[j] == ">" and self.p[j + 1] == self.p[j] + 1 and k[j + 1] in (">", ">="):
                        j += 1
                    if k[j] == ">=" and j > self.i:
                        return what
                    self.i = j
                self.i += 1
                self.unary()
                what = "value"
            elif kind == "instanceof":
                self.i += 1
                self.modifiers()
                self.type()
                self.i += k[self.i] == "id"
                what = "value"
            else:
                return what

    def unary(self) -> str:
        k = self.k
        kind = k[self.i]
        if kind in ("++", "--"):
            self.i += 1
            if self.unary() != "name":
                raise Bad(self.i)
            return "step"
        if kind in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return "value"
        if kind == "(" and self.attempt(self.cast):
            return "value"
        what = self.primary()
        if k[self.i] in ("++", "--"):
            if what != "name":
                raise Bad(self.i)
            self.i += 1
            return "step"
        return what

    def cast(self):
        k = self.k
        end = self.m[self.i]
        after = k[end + 1]
        self.i += 1
        primitive = k[self.i] in _PRIMITIVE and end == self.i + 1
        if not primitive and after not in _UNARY_NOT_PLUS:
            return False
        self.type()
        while k[self.i] == "&":
            self.i += 1
            self.type()
        if self.i != end:
            return False
        self.i += 1
        if (k[self.i] == "id" and k[self.i + 1] == "->") or (k[self.i] == "(" and k[self.m[self.i] + 1] == "->"):
            self.expression()
        else:
            self.unary()

    def arguments(self) -> None:
        self.want("(")
        while self.k[self.i] != ")":
            self.expression()
            if self.k[self.i] != ")":
                self.want(",")
                if self.k[self.i] == ")":
                    raise Bad(self.i)
        self.i += 1

    def generic_reference(self):
        """Foo<Bar>::name, Foo[]::new or int[].class."""
        at = self.i
        self.type()
        if self.k[self.i] == "::" and self.i > at + 1 and self.k[self.i - 1] in (">", "]"):
            return
        if self.k[self.i] == "." and self.k[self.i + 1] == "class" and self.k[self.i - 1] == "]":
            return
        return False

    def primary(self) -> str:
        k = self.k
        kind = k[self.i]
        if kind == "id":
            if k[self.i + 1] in ("<", "[") and self.attempt(self.generic_reference):
                what = "value"
            else:
                self.i += 1
                what = "name"
                if k[self.i] == "(":
                    self.arguments()
                    what = "call"
        elif kind in ("lit", "true", "false", "null"):
            self.i += 1
            what = "value"
        elif kind == "this":
            self.i += 1
            what = "value"
            if k[self.i] == "(":
                self.arguments()
                what = "call"
        elif kind == "super":
            self.i += 1
            what = "value"
            if k[self.i] == "(":
                self.arguments()
                what = "call"
            elif k[self.i] not in (".", "::"):
                raise Bad(self.i)
        elif kind == "(":
            self.i += 1
            what = self.expression()
            self.want(")")
            what = "name" if what == "name" else "value"
        elif kind == "new":
            what = self.creation()
        elif kind == "switch":
            self.switch()
            what = "value"
        elif kind in _PRIMITIVE or kind == "void":
            self.i += 1
            self.dims()
            if k[self.i] not in (".", "::"):
                raise Bad(self.i)
            what = "value"
        else:
            raise Bad(self.i)
        while True:
            kind = k[self.i]
            if kind == ".":
                self.i += 1
                if k[self.i] == "<":
                    self.type_args()
                kind = k[self.i]
                if kind == "new":
                    what = self.creation()
                    continue
                if kind in ("this", "super", "class"):
                    self.i += 1
                    what = "value"
                    if kind == "super" and k[self.i] == "(":
                        self.arguments()
                        what = "call"
                    continue
                if kind == "id" and k[self.i + 1] in ("<", "[") and self.attempt(self.generic_reference):
                    what = "value"
                    continue
                self.want("id")
                what = "name"
                if k[self.i] == "(":
                    self.arguments()
                    what = "call"
            elif kind == "[":
                self.i += 1
                self.expression()
                self.want("]")
                what = "name"
            elif kind == "::":
                self.i += 1
                if k[self.i] == "<":
                    self.type_args()
                if k[self.i] == "new":
                    self.i += 1
                else:
                    self.want("id")
                what = "value"
            else:
                return what

    def creation(self) -> str:
        k = self.k
        self.want("new")
        if k[self.i] == "<":
            self.type_args()
        self.type(False)
        if k[self.i] in ("[", "@"):
            sized = False
            while k[self.i] in ("[", "@"):
                while k[self.i] == "@":
                    self.annotation()
                self.i += 1
                if k[self.i] != "]":
                    self.expression()
                    sized = True
                self.want("]")
            if k[self.i] == "{" and not sized:
                self.initialiser()
            elif not sized:
                raise Bad(self.i)
            return "value"
        self.arguments()
        if k[self.i] == "{":
            self.class_body()
        return "new"


def parse_java(text: str) -> None:
    """Raises Bad unless text is a compilation unit."""
    Java(scan_java(text)).unit()
