"""A recursive-descent parser for JavaScript and TypeScript modules, with and without JSX.

It builds no tree. It answers whether a text is a valid module and lists the
declarations that the chunker cuts at. Tokens are read on demand, because only
the parser knows whether ``/`` begins a regular expression or ``<`` an element.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tallgrass.functions.deep import deeply

_SPACE = re.compile(r"(?:[\s﻿]++|//[^\n\r]*+|/\*[\s\S]*?\*/)*+")
_NAME = r"(?:[A-Za-z_$]|[^\x00-\x7f]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|[^\x00-\x7f]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*+"
_TOKEN = re.compile(
    rf"(?P<name>{_NAME})"
    r"|(?P<num>0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?"
    r"|(?:\d(?:_?\d)*)n(?![\w$])|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)"
    r'|(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*+"|' r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+')"
    rf"|(?P<private>\#{_NAME})"
    r"|(?P<op>\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*"
    r"|[{}()\[\];,<>+\-*/%&|^!~?:=.@`])"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++/[A-Za-z]*")
_CLOSE_ANGLES = re.compile(r">>>=|>>>|>>=|>>|>=|>")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")
_JSX_TEXT = re.compile(r"[^{}<>]*+")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$\-]*+(?:(?::[A-Za-z_$][\w$\-]*+)|(?:\.[A-Za-z_$][\w$\-]*+)*+)")
_JSX_STRING = re.compile(r"\"[^\"]*+\"|'[^']*+'")

# Words of the two languages.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in "
    "instanceof new null return super switch this throw true try typeof var void while with let static yield await implements interface "
    "package private protected public".split()
)
#: Words that only strict mode or position reserves but that this parser lets stand as plain names in TypeScript types and parameters.
CONTEXT_NAMES = frozenset("await".split())
MODIFIERS = frozenset("public private protected static abstract override readonly declare accessor async get set in out const".split())
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
PRECEDENCE = {
    "??": 2, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8,
    "instanceof": 8, "in": 8, "as": 8, "satisfies": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
PREFIX = frozenset("+ - ! ~ typeof void delete".split())
PRIMARY_WORDS = frozenset("this super null true false".split())


class ScriptError(Exception):
    """The text is no valid module; ``args`` hold what was wrong and where (character offset)."""


@dataclass
class Declaration:
    """One declaration: its grammar kind, character span, name, and whether it lies in a block or class."""

    kind: str
    start: int
    end: int
    name: str | None
    arrow: bool = False
    nested: bool = False
    export: Declaration | None = None
    inner: Declaration | None = None


class _Parser:
    def __init__(self, text: str, types: bool, jsx: bool) -> None:
        self.text, self.types, self.jsx = text, types, jsx
        self.declarations: list[Declaration] = []
        self.depth = self.functions = self.loops = self.switches = 0
        self.generator = self.asynchronous = self.ambient = False
        self.labels: list[str] = []
        self.no_in = self.no_conditional_type = self.in_conditional = False
        self.not_arrow: set[int] = set()
        self.kind = self.value = ""
        self.start = self.end = self.last_end = 0
        self.newline = False
        if text.startswith("#!"):
            at = text.find("\n")
            self.end = len(text) if at < 0 else at
        self.next()

    # -- tokens ---------------------------------------------------------------
    def next(self) -> None:
        text, at = self.text, self.end
        self.last_end = at
        begin = _SPACE.match(text, at).end()
        self.newline = begin > at and ("\n" in (gap := text[at:begin]) or "\r" in gap)
        if begin >= len(text):
            self.kind, self.value, self.start, self.end = "end", "", begin, begin
            return
        m = _TOKEN.match(text, begin)
        if m is None:
            self.kind, self.value, self.start, self.end = "bad", text[begin], begin, begin + 1
            return
        self.kind, self.value, self.start, self.end = m.lastgroup, m.group(), begin, m.end()
        if self.kind == "name" and not self.value.isascii() and "\\" not in self.value and not self.value.replace("$", "_").isidentifier():
            self.fail("a character that no name has")
        if self.kind == "num" and _TOKEN.match(text, self.end) and (text[self.end].isalnum() or text[self.end] in "_$"):
            self.fail("letters after a number")

    def save(self) -> tuple:
        return (self.kind, self.value, self.start, self.end, self.last_end, self.newline, len(self.declarations), self.depth, self.functions,
                self.loops, self.switches, self.generator, self.asynchronous, self.no_in, len(self.labels), self.in_conditional)

    def restore(self, s: tuple) -> None:
        (self.kind, self.value, self.start, self.end, self.last_end, self.newline, n, self.depth, self.functions,
         self.loops, self.switches, self.generator, self.asynchronous, self.no_in, labels, self.in_conditional) = s
        del self.declarations[n:], self.labels[labels:]

    def fail(self, why: str) -> None:
        raise ScriptError(why, self.start)

    def at(self, value: str) -> bool:
        return self.value == value and self.kind != "str"

    def eat(self, value: str) -> bool:
        if self.value == value and self.kind != "str":
            self.next()
            return True
        return False

    def need(self, value: str) -> None:
        if self.value != value or self.kind == "str":
            self.fail(f"expected {value}")
        self.next()

    def semicolon(self) -> None:
        if self.eat(";") or self.newline or self.kind == "end" or self.at("}"):
            return
        self.fail("expected ;")

    def peek(self) -> tuple[str, str, bool]:
        """Kind, text and newline flag of the token after the current one."""
        s = self.save()
        try:
            self.next()
            return self.kind, self.value, self.newline
        except ScriptError:
            return "bad", "", False
        finally:
            self.restore(s)

    def attempt(self, rule) -> bool:
        s = self.save()
        try:
            if rule() is not False:
                return True
        except ScriptError:
            pass
        self.restore(s)
        return False

    def name(self, any_word: bool = False) -> str:
        if self.kind != "name" or (not any_word and self.value in RESERVED and self.value not in CONTEXT_NAMES):
            self.fail("expected a name")
        value = self.value
        self.next()
        return value

    # -- statements -----------------------------------------------------------
    def module(self) -> None:
        while self.kind != "end":
            self.statement(top=True)

    def block(self) -> None:
        self.need("{")
        self.depth += 1
        while not self.at("}"):
            if self.kind == "end":
                self.fail("unclosed block")
            self.statement()
        self.depth -= 1
        self.next()

    def body(self, generator: bool = False, asynchronous: bool = False) -> None:
        keep = self.loops, self.switches, self.generator, self.asynchronous, self.labels, self.no_in, self.ambient, self.in_conditional
        self.loops = self.switches = 0
        self.generator, self.asynchronous, self.labels, self.no_in, self.ambient, self.in_conditional = generator, asynchronous, [], False, False, False
        self.functions += 1
        try:
            self.block()
        finally:
            self.functions -= 1
            self.loops, self.switches, self.generator, self.asynchronous, self.labels, self.no_in, self.ambient, self.in_conditional = keep

    def nested_statement(self, loop: bool = False) -> None:
        if self.kind == "name" and self.value in ("class", "const", "import", "export") or (self.at("let") and self.peek()[1] == "["):
            self.fail("a declaration can't stand here")
        self.loops += loop
        self.depth += 1
        self.statement()
        self.depth -= 1
        self.loops -= loop

    def statement(self, top: bool = False) -> None:
        value = self.value
        if self.kind == "op":
            if value == "{":
                return self.block()
            if value == ";":
                return self.next()
            if value == "@":
                begin = self.start
                self.decorators()
                if self.at("export"):
                    return self.export(top, begin)
                abstract = self.types and self.eat("abstract")
                if not self.at("class"):
                    self.fail("expected a class")
                self.class_(True, abstract=abstract, begin=begin)
                return
        elif self.kind == "name":
            rule = getattr(self, "s_" + value, None) if value.islower() else None
            if rule is not None:
                if rule(top) is not False:
                    return
            elif value not in RESERVED and self.labelled():
                return
        self.expression()
        self.semicolon()

    def labelled(self) -> bool:
        if self.text[self.end : self.end + 1] not in ": \t" or self.peek()[1] != ":":
            return False
        self.labels.append(self.value)
        self.next()
        self.next()
        self.nested_statement()
        self.labels.pop()
        return True

    def s_var(self, top: bool) -> None:
        self.variables("var")

    def s_const(self, top: bool) -> None:
        if self.types and self.peek()[1] == "enum":
            self.next()
            return self.s_enum(top)
        self.variables("const")

    def s_let(self, top: bool):
        kind, value, _ = self.peek()
        if kind != "name" and value not in ("[", "{") or value in ("in", "instanceof", "of"):
            return False
        self.variables("let")

    def variables(self, word: str, loop: bool = False) -> Declaration | None:
        begin, before = self.start, len(self.declarations)
        self.next()
        first, arrow, nested = None, False, self.depth > 0
        slot = Declaration("lexical_declaration", begin, begin, None, nested=nested)
        if word != "var" and not loop:
            self.declarations.append(slot)
        while True:
            at, pattern = self.start, not self.kind == "name"
            self.binding()
            if first is None:
                first = self.text[at : self.last_end]
            if self.types:
                if self.at("!"):
                    self.next()
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                is_arrow = self.arrow_ahead()
                self.assignment()
                arrow = arrow or (is_arrow and slot.name is None)
            elif loop and (self.at("of") or self.at("in")):
                return None
            elif (word == "const" or pattern) and not self.ambient:
                self.fail("missing value")
            if slot.name is None:
                slot.name = first
            if not self.eat(","):
                break
        if not loop:
            self.semicolon()
        slot.end, slot.arrow = self.last_end, arrow
        return slot if word != "var" and len(self.declarations) > before else None

    def arrow_ahead(self) -> bool:
        """True if the value that begins here is an arrow function."""
        s = self.save()
        try:
            return self.arrow(dry=True)
        except ScriptError:
            return False
        finally:
            self.restore(s)

    def s_function(self, top: bool) -> Declaration | None:
        return self.function(True)

    def s_async(self, top: bool):
        kind, value, newline = self.peek()
        if value != "function" or newline:
            return False if not self.labelled() else None
        begin = self.start
        self.next()
        return self.function(True, True, begin)

    def function(self, statement: bool, asynchronous: bool = False, begin: int | None = None, anonymous: bool = False) -> Declaration | None:
        begin = self.start if begin is None else begin
        self.next()
        star = self.eat("*")
        name = None
        if statement and not (anonymous and (self.at("(") or self.at("<"))) or self.kind == "name":
            name = self.name(any_word=self.value in ("yield", "await"))
        slot = Declaration("function_declaration", begin, begin, name, nested=self.depth > 0)
        keep = statement and not star and name is not None
        if keep:
            self.declarations.append(slot)
        self.signature(star, asynchronous)
        if self.types and statement and not self.at("{"):
            self.semicolon()  # an overload or an ambient function
            if keep:
                self.declarations.remove(slot)
            return None
        self.body(star, asynchronous)
        slot.end = self.last_end
        return slot if keep else None

    def signature(self, generator: bool = False, asynchronous: bool = False) -> None:
        if self.types and self.at("<"):
            self.type_parameters()
        self.parameters()
        if self.types and self.eat(":"):
            self.return_type()

    def parameters(self) -> None:
        self.need("(")
        keep, self.in_conditional, self.no_in = (self.in_conditional, self.no_in), False, False
        while not self.eat(")"):
            while self.at("@"):
                self.decorators()
            if self.types:
                while self.kind == "name" and self.value in ("public", "private", "protected", "readonly", "override") and self.peek()[0] in ("name",) or (
                    self.kind == "name" and self.value in ("public", "private", "protected", "readonly") and self.peek()[1] in ("{", "[")
                ):
                    self.next()
            rest = self.eat("...")
            if self.types and self.at("this"):
                self.next()
            else:
                self.binding()
            if self.types:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                if rest:
                    self.fail("a rest parameter has no default")
                self.assignment()
            if not self.at(")"):
                if rest:
                    self.fail("a rest parameter must be last")
                self.need(",")
        self.in_conditional, self.no_in = keep

    def binding(self) -> None:
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assignment()
                if not self.at("]"):
                    self.need(",")
        elif self.eat("{"):
            while not self.eat("}"):
                if self.eat("..."):
                    self.binding()
                else:
                    word = self.value if self.kind == "name" else None
                    self.property_name()
                    if self.eat(":"):
                        self.binding()
                    elif word is None or word in RESERVED and word not in CONTEXT_NAMES:
                        self.fail("expected a name")
                    if self.eat("="):
                        self.assignment()
                if not self.at("}"):
                    self.need(",")
        else:
            self.name()

    def s_class(self, top: bool) -> Declaration | None:
        return self.class_(True)

    def decorators(self) -> None:
        while self.eat("@"):
            if self.eat("("):
                self.expression()
                self.need(")")
                continue
            self.name()
            while self.eat("."):
                self.kind == "private" and self.next() or self.name(True)
            if self.types and self.at("<"):
                self.type_arguments()
            if self.at("(") :
                self.arguments()

    def class_(self, statement: bool, abstract: bool = False, begin: int | None = None, anonymous: bool = False) -> Declaration | None:
        begin = self.start if begin is None else begin
        self.need("class")
        name = None
        if self.kind == "name" and self.value not in ("extends",) and not (self.types and self.value == "implements" and self.peek()[1] != "{"):
            name = self.name()
        elif statement and not anonymous:
            self.fail("expected a name")
        slot = Declaration("class_declaration", begin, begin, name, nested=self.depth > 0)
        keep = statement and not abstract and name is not None
        if keep:
            self.declarations.append(slot)
        if self.types and self.at("<"):
            self.type_parameters()
        if self.eat("extends"):
            self.subscripts()
            if self.types and self.at("<"):
                self.type_arguments()
        if self.types and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        self.depth += 1
        constructors = 0
        keep_state = self.labels, self.loops, self.switches, self.no_in, self.in_conditional
        self.labels, self.loops, self.switches, self.no_in, self.in_conditional = [], 0, 0, False, False
        while not self.at("}"):
            if self.kind == "end":
                self.fail("unclosed class")
            if not self.eat(";"):
                constructors += self.member()
                if constructors > 1:
                    self.fail("two constructors")
        self.labels, self.loops, self.switches, self.no_in, self.in_conditional = keep_state
        self.depth -= 1
        self.next()
        slot.end = self.last_end
        return slot if keep else None

    def member(self) -> int:
        """One class member; 1 if it is a constructor with a body."""
        self.decorators()
        begin, flags = self.start, set()
        while self.kind == "name" and self.value in MODIFIERS:
            word = self.value
            if word not in ("static", "async", "get", "set", "accessor") and not self.types:
                break
            kind, value, newline = self.peek()
            if word == "static" and value == "{":
                self.next()
                self.body()
                return 0
            if kind not in ("name", "str", "num", "private") and value not in ("[", "*") or (word in ("async", "get", "set") and kind == "op" and value == "*" and word != "async"):
                break
            if newline and word in ("async", "accessor", "declare", "abstract"):
                break
            flags.add(word)
            self.next()
        if self.types and self.at("["):
            if self.attempt(self.index_signature):
                return 0
        star = self.eat("*")
        at = self.start
        constructor = self.value in ("constructor", '"constructor"', "'constructor'") and "static" not in flags
        private = self.kind == "private"
        self.property_name(private=True)
        name = self.text[at : self.last_end]
        if private and name == "#constructor":
            self.fail("a private constructor name")
        if self.types:
            self.eat("?") or self.eat("!")
        if self.at("(") or self.types and self.at("<"):
            slot = Declaration("method_definition", begin, begin, name, nested=True)
            self.declarations.append(slot)
            self.signature()
            if self.types and not self.at("{"):
                self.declarations.remove(slot)
                self.semicolon()
                return 0
            self.body(star, "async" in flags)
            slot.end = self.last_end
            return int(constructor)
        if star or flags & {"get", "set", "async"}:
            self.fail("expected parameters")
        if self.types and self.eat(":"):
            self.type()
        if self.eat("="):
            keep = self.functions, self.generator, self.asynchronous
            self.functions += 1
            self.assignment()
            self.functions, self.generator, self.asynchronous = keep
        self.semicolon()
        return 0

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type()
        self.need("]")
        self.need(":")
        self.type()
        self.eat(",") or self.semicolon()

    def property_name(self, private: bool = False) -> None:
        if self.kind in ("name", "str", "num") or private and self.kind == "private":
            self.next()
        elif self.eat("["):
            keep, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = keep
            self.need("]")
        else:
            self.fail("expected a property name")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_if(self, top: bool) -> None:
        self.next()
        self.condition()
        self.nested_statement()
        if self.eat("else"):
            self.nested_statement()

    def s_while(self, top: bool) -> None:
        self.next()
        self.condition()
        self.nested_statement(True)

    def s_do(self, top: bool) -> None:
        self.next()
        self.nested_statement(True)
        self.need("while")
        self.condition()
        self.eat(";")

    def s_for(self, top: bool) -> None:
        self.next()
        if self.at("await"):
            self.next()
        self.need("(")
        keep, self.no_in = self.no_in, True
        declared = False
        if self.at("var") or self.at("const") or self.at("let") and self.peek()[0:2] not in (("name", "in"), ("name", "of")):
            self.variables(self.value, loop=True)
            declared = True
        elif not self.at(";"):
            self.expression()
        self.no_in = keep
        if self.eat("of"):
            self.assignment()
        elif self.eat("in"):
            self.expression()
        else:
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
        self.need(")")
        self.nested_statement(True)
        return None if declared else None

    def jump(self, allowed: bool) -> None:
        self.next()
        if self.kind == "name" and not self.newline and self.value not in RESERVED:
            if self.value not in self.labels:
                self.fail("unknown label")
            self.next()
        elif not allowed:
            self.fail("nothing to jump out of")
        self.semicolon()

    def s_break(self, top: bool) -> None:
        self.jump(self.loops + self.switches > 0)

    def s_continue(self, top: bool) -> None:
        self.jump(self.loops > 0)

    def s_return(self, top: bool) -> None:
        if not self.functions:
            self.fail("return outside of a function")
        self.next()
        if not (self.newline or self.kind == "end" or self.at(";") or self.at("}")):
            self.expression()
        self.semicolon()

    def s_throw(self, top: bool) -> None:
        self.next()
        if self.newline:
            self.fail("a line break after throw")
        self.expression()
        self.semicolon()

    def s_try(self, top: bool) -> None:
        self.next()
        self.block()
        handled = False
        if self.eat("catch"):
            handled = True
            if self.eat("("):
                self.binding()
                if self.types and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.eat("finally"):
            handled = True
            self.block()
        if not handled:
            self.fail("try without catch")

    def s_switch(self, top: bool) -> None:
        self.next()
        self.condition()
        self.need("{")
        self.depth += 1
        self.switches += 1
        defaults = 0
        while not self.eat("}"):
            if self.eat("default"):
                defaults += 1
                if defaults > 1:
                    self.fail("two defaults")
            else:
                self.need("case")
                self.expression()
            self.need(":")
            while not (self.at("case") or self.at("default") or self.at("}")):
                if self.kind == "end":
                    self.fail("unclosed switch")
                self.statement()
        self.switches -= 1
        self.depth -= 1

    def s_debugger(self, top: bool) -> None:
        self.next()
        self.semicolon()

    def s_with(self, top: bool) -> None:
        self.fail("with in a module")

    def s_import(self, top: bool):
        if self.peek()[1] in ("(", "."):
            return False
        if not top:
            self.fail("import inside a block")
        self.next()
        if self.kind == "str":
            self.next()
            return self.import_attributes()
        if self.types and self.at("type") and (self.peek()[0] == "name" and self.peek()[1] != "from" or self.peek()[1] in ("{", "*")):
            self.next()
        if self.kind == "name" and not self.at("from") or self.at("from") and self.peek()[1] in ("from", ",", "="):
            self.name()
            if self.types and self.eat("="):
                self.subscripts()
                return self.semicolon()
            if not self.eat(","):
                return self.from_()
        if self.eat("*"):
            self.need("as")
            self.name()
        else:
            self.specifiers(imported=True)
        self.from_()

    def from_(self) -> None:
        self.need("from")
        if self.kind != "str":
            self.fail("expected a module name")
        self.next()
        self.import_attributes()

    def import_attributes(self) -> None:
        if self.at("with") or self.at("assert") and not self.newline:
            self.next()
            self.object_()
        self.semicolon()

    def specifiers(self, imported: bool) -> bool:
        """Import or export specifiers; True if all of them could be local names."""
        self.need("{")
        local = True
        while not self.eat("}"):
            if self.types and self.at("type") and (self.peek()[0] in ("name", "str") and self.peek()[1] != "as"):
                self.next()
            word, kind = self.value, self.kind
            if kind not in ("name", "str"):
                self.fail("expected a name")
            self.next()
            if self.eat("as"):
                if imported:
                    self.name()
                elif self.kind in ("name", "str"):
                    self.next()
                else:
                    self.fail("expected a name")
            elif imported and (kind == "str" or word in RESERVED):
                self.fail("expected a name")
            local = local and kind == "name" and word not in RESERVED
            if not self.at("}"):
                self.need(",")
        return local

    def s_export(self, top: bool) -> None:
        self.export(top, self.start)

    def export(self, top: bool, begin: int) -> None:
        if not top:
            self.fail("export inside a block")
        self.next()
        slot = Declaration("export_statement", begin, begin, None)
        self.declarations.append(slot)
        at = len(self.declarations)
        inner = None
        if self.at("*"):
            self.next()
            if self.eat("as"):
                self.kind in ("name", "str") and self.next() is None or self.fail("expected a name")
            self.from_()
        elif self.at("{"):
            local = self.specifiers(imported=False)
            if self.at("from"):
                self.from_()
            elif not local:
                self.fail("no local name")
            else:
                self.semicolon()
        elif self.at("default"):
            self.next()
            self.decorators()
            if self.at("function"):
                inner = self.function(True, anonymous=True)
            elif self.at("async") and self.peek()[1] == "function" and not self.peek()[2]:
                start = self.start
                self.next()
                inner = self.function(True, True, start, anonymous=True)
            elif self.at("class"):
                inner = self.class_(True, anonymous=True)
            elif self.types and self.at("abstract") and self.peek()[1] == "class":
                start = self.start
                self.next()
                inner = self.class_(True, abstract=True, begin=start, anonymous=True)
            elif self.types and self.at("interface") and self.peek()[0] == "name":
                inner = self.s_interface(top)
            else:
                self.assignment()
                self.semicolon()
        elif self.types and self.at("="):
            self.next()
            self.expression()
            self.semicolon()
        elif self.types and self.at("as") and self.peek()[1] == "namespace":
            self.next()
            self.next()
            self.name()
            self.semicolon()
        elif self.types and self.at("import"):
            self.s_import(True)
        elif self.types and self.at("type") and self.peek()[1] in ("{", "*"):
            self.next()
            if self.eat("*"):
                self.eat("as") and self.name(True)
                self.from_()
            else:
                self.specifiers(imported=False)
                self.from_() if self.at("from") else self.semicolon()
        else:
            self.decorators()
            words = {"var", "let", "const", "function", "async", "class"} | ({"interface", "type", "enum", "namespace", "module", "declare", "abstract"} if self.types else set())
            if self.kind != "name" or self.value not in words:
                self.fail("nothing to export")
            if getattr(self, "s_" + self.value)(top) is False:
                self.fail("nothing to export")
            inner = self.declarations[at] if len(self.declarations) > at else None
        slot.end = self.last_end
        slot.inner = inner
        if inner is not None:
            inner.export = slot

    # -- statements of TypeScript ---------------------------------------------
    def word_then_name(self) -> bool:
        if not self.types:
            return False
        kind, value, newline = self.peek()
        return kind == "name" and not newline and value not in ("in", "of", "instanceof", "as", "satisfies")

    def s_interface(self, top: bool):
        if not self.word_then_name():
            return False
        begin, nested = self.start, self.depth > 0
        self.next()
        slot = Declaration("interface_declaration", begin, begin, self.name(), nested=nested)
        self.declarations.append(slot)
        if self.at("<"):
            self.type_parameters()
        if self.eat("extends"):
            self.type()
            while self.eat(","):
                self.type()
        self.object_type()
        slot.end = self.last_end
        return slot

    def s_type(self, top: bool):
        if not self.word_then_name():
            return False
        begin, nested = self.start, self.depth > 0
        self.next()
        slot = Declaration("type_alias_declaration", begin, begin, self.name(), nested=nested)
        self.declarations.append(slot)
        if self.at("<"):
            self.type_parameters()
        self.need("=")
        self.type()
        self.semicolon()
        slot.end = self.last_end
        return slot

    def s_enum(self, top: bool):
        if not self.types:
            self.fail("reserved word")
        self.next()
        self.name()
        self.need("{")
        while not self.eat("}"):
            self.property_name()
            if self.eat("="):
                self.assignment()
            if not self.at("}"):
                self.need(",")

    def s_namespace(self, top: bool):
        kind, value, newline = self.peek()
        if not self.types or newline or kind not in ("name", "str") or value in ("in", "of", "instanceof", "as"):
            return False if not self.labelled() else None
        self.next()
        if self.kind == "str":
            self.next()
            if not self.at("{"):
                return self.semicolon()
        else:
            self.name()
            while self.eat("."):
                self.name()
        self.inner_module()

    s_module = s_namespace

    def inner_module(self) -> None:
        self.need("{")
        self.depth += 1
        while not self.eat("}"):
            if self.kind == "end":
                self.fail("unclosed namespace")
            self.statement(top=True)
        self.depth -= 1

    def s_global(self, top: bool):
        if not (self.types and self.ambient and self.peek()[1] == "{"):
            return False if not self.labelled() else None
        self.next()
        self.inner_module()

    def s_declare(self, top: bool):
        if not self.word_then_name():
            return False if not self.labelled() else None
        self.next()
        keep, self.ambient = self.ambient, True
        self.statement(top)
        self.ambient = keep

    def s_abstract(self, top: bool):
        if not self.types or self.peek()[1] != "class":
            return False if not self.labelled() else None
        begin = self.start
        self.next()
        self.class_(True, abstract=True, begin=begin)

    # -- expressions ----------------------------------------------------------
    def expression(self) -> None:
        self.assignment()
        while self.at(",") :
            self.next()
            self.assignment()

    def assignment(self) -> None:
        if self.kind == "name" or self.value in ("(", "<"):
            if self.at("yield") and self.generator:
                self.next()
                if not self.newline:
                    if self.eat("*"):
                        return self.assignment()
                    if self.kind in ("name", "num", "str", "private") and not self.at("in") or self.value in ("(", "[", "{", "+", "-", "!", "~", "`", "/", "<", "++", "--", "@"):
                        self.assignment()
                return
            if self.kind != "str" and self.may_be_arrow() and self.start not in self.not_arrow:
                at = self.start
                if self.attempt(self.arrow):
                    return
                if not self.in_conditional:
                    self.not_arrow.add(at)
        begin = self.start
        simple = self.conditional()
        value = self.value
        if self.kind == "op" and value[-1] in "=>":
            if value == ">":
                m = _CLOSE_ANGLES.match(self.text, self.start)
                value = m.group()
            if value in ASSIGN:
                if not (simple or value == "=" and self.text[begin] in "[{"):
                    self.fail("not assignable")
                self.end = self.start + len(value)
                self.next()
                self.assignment()

    def may_be_arrow(self) -> bool:
        if self.kind == "name":
            if self.value == "async":
                return True
            return self.value not in RESERVED and self.text.startswith("=>", _SPACE.match(self.text, self.end).end())
        return self.at("(") or self.types and self.at("<")

    def arrow(self, dry: bool = False) -> bool:
        asynchronous = False
        if self.at("async"):
            kind, value, newline = self.peek()
            if newline or kind != "name" and value not in ("(", "<"):
                if value != "=>":
                    return False
            elif kind == "name" and value in ("function", "in", "of", "instanceof", "as", "satisfies"):
                return False
            else:
                self.next()
                asynchronous = True
        if self.kind == "name":
            self.name()
        else:
            if self.types and self.at("<"):
                comma = self.type_parameters()
                if self.jsx and not comma:
                    return False
            if not self.at("("):
                return False
            self.parameters()
            if self.types and self.at(":"):
                self.next()
                self.return_type()
        if self.newline or not self.at("=>"):
            return False
        if dry:
            return True
        self.next()
        if self.at("{"):
            self.body(False, asynchronous)
        else:
            keep = self.functions, self.generator, self.asynchronous
            self.functions += 1
            self.generator, self.asynchronous = False, asynchronous
            self.assignment()
            self.functions, self.generator, self.asynchronous = keep
        if self.in_conditional and self.types and not self.at(":") and self.text[self.start : self.start + 1] not in (",", ")", "]", "}", ";", ":"):
            return True
        return True

    def conditional(self) -> bool:
        simple = self.binary(0)
        if self.at("?"):
            self.next()
            keep, self.no_in, inside = self.no_in, False, self.in_conditional
            self.in_conditional = True
            self.branch_of_conditional()
            self.in_conditional = inside
            self.no_in = keep
            self.need(":")
            self.assignment()
            return False
        return simple

    def branch_of_conditional(self) -> None:
        """The middle of ``a ? b : c``. In TypeScript ``(x) : y => z`` may read as an arrow
        function with a return type; where that leaves no colon, it is read without arrows."""
        s = self.save()
        try:
            self.assignment()
            if self.at(":"):
                return
        except ScriptError:
            pass
        if not self.types:
            self.restore(s)
            self.assignment()
            return
        self.restore(s)
        added = self.start not in self.not_arrow
        self.not_arrow.add(self.start)
        self.assignment()
        if added:
            self.not_arrow.discard(s[2])

    def binary(self, least: int) -> bool:
        simple = self.unary()
        mixed = ""
        while True:
            value, kind = self.value, self.kind
            if kind == "op":
                if value == ">":
                    value = _CLOSE_ANGLES.match(self.text, self.start).group()
                power = PRECEDENCE.get(value)
            elif kind == "name":
                if value == "in" and self.no_in:
                    return simple
                if value in ("as", "satisfies") and (not self.types or self.newline):
                    return simple
                power = PRECEDENCE.get(value)
            else:
                return simple
            if power is None or power <= least and not (value == "**" and power == least):
                return simple
            if value in ("??", "||"):
                if mixed not in ("", value):
                    self.fail("?? mixed with ||")
                mixed = value
            self.end = self.start + len(value)
            self.next()
            if value in ("as", "satisfies"):
                self.eat("const") or self.type()
                continue
            self.binary(power - (value == "**"))
            simple = False

    def unary(self) -> bool:
        if self.kind == "op" and self.value in PREFIX or self.kind == "name" and self.value in PREFIX:
            self.next()
            self.unary()
            if self.at("**"):
                self.fail("a sign before **")
            return False
        if self.kind == "name" and self.value == "await":
            kind, value, _ = self.peek()
            if self.asynchronous or kind in ("name", "str", "num") and value not in ("in", "instanceof", "of", "as") or value in ("(", "[", "{", "`", "!", "+", "-", "/", "<"):
                if not self.asynchronous and self.functions:
                    self.fail("await outside of an async function")
                self.next()
                self.unary()
                return False
        if self.at("++") or self.at("--"):
            self.next()
            if not self.unary():
                self.fail("not assignable")
            return False
        if self.types and not self.jsx and self.at("<"):
            self.next()
            self.eat("const") or self.type()
            self.need(">")
            self.unary()
            return False
        simple = self.subscripts()
        if (self.at("++") or self.at("--")) and not self.newline:
            if not simple:
                self.fail("not assignable")
            self.next()
            return False
        return simple

    def arguments(self) -> None:
        self.need("(")
        keep, self.no_in, self.in_conditional, inside = self.no_in, False, False, self.in_conditional
        while not self.eat(")"):
            self.eat("...")
            self.assignment()
            if not self.at(")"):
                self.need(",")
        self.no_in, self.in_conditional = keep, inside

    def subscripts(self, calls: bool = True) -> bool:
        simple = self.primary()
        optional = False
        while True:
            if self.kind == "op":
                value = self.value
                if value == ".":
                    self.next()
                    if self.kind not in ("name", "private"):
                        self.fail("expected a name")
                    self.next()
                    simple = not optional
                    continue
                if value == "?.":
                    optional = True
                    self.next()
                    if self.at("("):
                        self.arguments()
                    elif self.at("["):
                        self.element()
                    elif self.types and self.at("<") and self.attempt(self.generic_call):
                        pass
                    elif self.kind in ("name", "private"):
                        self.next()
                    else:
                        self.fail("expected a name")
                    simple = False
                    continue
                if value == "[":
                    self.element()
                    simple = not optional
                    continue
                if value == "(" and calls:
                    self.arguments()
                    simple = False
                    continue
                if value == "`":
                    self.template()
                    simple = False
                    continue
                if self.types and value == "!" and not self.newline and not self.text.startswith("!=", self.start):
                    self.next()
                    continue
                if self.types and value in ("<", "<<") and calls and self.attempt(self.generic_call):
                    simple = False
                    continue
            return simple

    def element(self) -> None:
        self.need("[")
        keep, self.no_in, inside, self.in_conditional = self.no_in, False, self.in_conditional, False
        self.expression()
        self.no_in, self.in_conditional = keep, inside
        self.need("]")

    def generic_call(self):
        self.type_arguments()
        if self.at("("):
            return self.arguments()
        if self.at("`"):
            return self.template()
        return self.kind == "end" or self.newline or self.value in (")", "]", ",", ";", ":", "}", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??")

    def template(self) -> None:
        at = self.end
        while True:
            at = _TEMPLATE.match(self.text, at).end()
            if at >= len(self.text):
                self.fail("unclosed template")
            if self.text[at] == "`":
                self.end = at + 1
                return self.next()
            self.end = at + 2
            self.next()
            keep, self.no_in, inside, self.in_conditional = self.no_in, False, self.in_conditional, False
            self.expression()
            self.no_in, self.in_conditional = keep, inside
            if not self.at("}"):
                self.fail("unclosed place in a template")
            at = self.end

    def primary(self) -> bool:
        kind, value = self.kind, self.value
        if kind == "name":
            if value == "function":
                self.function(False)
                return False
            if value == "async" and self.peek()[1] == "function" and not self.peek()[2]:
                self.next()
                self.function(False, True)
                return False
            if value == "class":
                self.class_(False)
                return False
            if value == "new":
                return self.new()
            if value == "import":
                self.next()
                if self.eat("."):
                    self.name(True)
                else:
                    self.arguments()
                return False
            if value in PRIMARY_WORDS:
                self.next()
                if value == "super" and self.value not in ("(", ".", "["):
                    self.fail("super alone")
                return False
            if value in RESERVED and value not in CONTEXT_NAMES:
                self.fail("reserved word")
            self.next()
            return True
        if kind in ("num", "str"):
            self.next()
            return False
        if kind == "private":
            self.next()
            if not self.at("in"):
                self.fail("a private name alone")
            return False
        if kind == "op":
            if value == "(":
                self.next()
                keep, self.no_in, inside, self.in_conditional = self.no_in, False, self.in_conditional, False
                simple = self.parenthesized()
                self.no_in, self.in_conditional = keep, inside
                self.need(")")
                return simple
            if value == "[":
                self.next()
                keep, self.no_in, inside, self.in_conditional = self.no_in, False, self.in_conditional, False
                while not self.eat("]"):
                    if self.eat(","):
                        continue
                    self.eat("...")
                    self.assignment()
                    if not self.at("]"):
                        self.need(",")
                self.no_in, self.in_conditional = keep, inside
                return False
            if value == "{":
                self.object_()
                return False
            if value == "`":
                self.template()
                return False
            if value in ("/", "/="):
                m = _REGEX.match(self.text, self.start)
                if not m:
                    self.fail("unclosed regular expression")
                self.end = m.end()
                self.next()
                return False
            if value == "<" and self.jsx:
                self.jsx_element()
                return False
            if value == "@":
                self.decorators()
                self.class_(False)
                return False
        self.fail("expected an expression")
        return False

    def parenthesized(self) -> bool:
        begin = self.start
        self.expression()
        return self.text[begin : self.last_end].replace(".", "").replace("_", "").replace("$", "").isalnum() and not self.text[begin].isdigit() or self.last_end > begin and self.text[self.last_end - 1] == "]" or "." in self.text[begin : self.last_end]

    def new(self) -> bool:
        self.next()
        if self.eat("."):
            self.need("target")
            return False
        if self.at("new"):
            self.new()
        else:
            if self.at("import"):
                self.fail("new import")
            self.subscripts(calls=False)
        if self.types and self.value in ("<", "<<") and self.kind == "op":
            self.attempt(self.type_arguments)
        if self.at("("):
            self.arguments()
        return False

    def object_(self) -> None:
        self.need("{")
        keep, self.no_in, inside, self.in_conditional = self.no_in, False, self.in_conditional, False
        while not self.eat("}"):
            if self.eat("..."):
                self.assignment()
            else:
                self.object_member()
            if not self.at("}"):
                self.need(",")
        self.no_in, self.in_conditional = keep, inside

    def object_member(self) -> None:
        begin, flags = self.start, set()
        while self.kind == "name" and self.value in ("async", "get", "set"):
            kind, value, newline = self.peek()
            if kind not in ("name", "str", "num") and value not in ("[", "*") or newline and self.value == "async":
                break
            flags.add(self.value)
            self.next()
        star = self.eat("*")
        at, word = self.start, self.value if self.kind == "name" else None
        self.property_name()
        if self.at("(") or self.types and self.at("<"):
            slot = Declaration("method_definition", begin, begin, self.text[at : self.last_end], nested=True)
            self.declarations.append(slot)
            self.signature()
            self.body(star, "async" in flags)
            slot.end = self.last_end
            return
        if star or flags:
            self.fail("expected parameters")
        if self.eat(":"):
            return self.assignment()
        if word is None or word in RESERVED and word not in CONTEXT_NAMES:
            self.fail("expected :")
        if self.eat("="):  # a default; only valid in a pattern, which the assignment that follows decides
            self.assignment()

    # -- JSX ------------------------------------------------------------------
    def jsx_element(self) -> None:
        self.end = self.jsx_at(self.start)
        self.next()

    def jsx_space(self, at: int) -> int:
        return _SPACE.match(self.text, at).end()

    def jsx_fail(self, at: int) -> None:
        raise ScriptError("malformed element", at)

    def jsx_container(self, at: int, empty: bool = True) -> int:
        """An expression in braces that begins at ``at``; returns where it ends."""
        self.end = at + 1
        self.next()
        keep, self.no_in, inside, self.in_conditional = self.no_in, False, self.in_conditional, False
        if self.at("}") and empty:
            pass
        else:
            self.eat("...")
            self.expression()
        self.no_in, self.in_conditional = keep, inside
        if not self.at("}"):
            self.fail("unclosed expression")
        return self.end

    def jsx_at(self, at: int) -> int:
        text = self.text
        at = self.jsx_space(at + 1)
        name = ""
        if not text.startswith(">", at):
            m = _JSX_NAME.match(text, at)
            if not m:
                self.jsx_fail(at)
            name, at = m.group(), m.end()
            if self.types and text.startswith("<", at):
                self.end = at
                self.next()
                self.type_arguments()
                at = self.last_end
            while True:
                at = self.jsx_space(at)
                if text.startswith("/>", at):
                    return at + 2
                if text.startswith(">", at):
                    break
                if text.startswith("{", at):
                    at = self.jsx_container(at, empty=False)
                    continue
                m = _JSX_NAME.match(text, at)
                if not m:
                    self.jsx_fail(at)
                at = self.jsx_space(m.end())
                if text.startswith("=", at):
                    at = self.jsx_space(at + 1)
                    if text.startswith("{", at):
                        at = self.jsx_container(at, empty=False)
                    elif text.startswith("<", at):
                        at = self.jsx_at(at)
                    else:
                        m = _JSX_STRING.match(text, at)
                        if not m:
                            self.jsx_fail(at)
                        at = m.end()
        at += 1
        while True:
            at = _JSX_TEXT.match(text, at).end()
            if at >= len(text) or text[at] in "}>":
                self.jsx_fail(at)
            if text[at] == "{":
                at = self.jsx_container(at)
                continue
            after = self.jsx_space(at + 1)
            if text.startswith("/", after):
                after = self.jsx_space(after + 1)
                m = _JSX_NAME.match(text, after)
                closing = m.group() if m else ""
                after = self.jsx_space(m.end() if m else after)
                if closing != name or not text.startswith(">", after):
                    self.jsx_fail(at)
                return after + 1
            at = self.jsx_at(at)

    # -- types ----------------------------------------------------------------
    def type_parameters(self) -> bool:
        """``<T extends U = V, ...>``; True if it can't be mistaken for an element."""
        self.need("<")
        sure = False
        while not self.at(">"):
            while self.kind == "name" and self.value in ("const", "in", "out") and self.peek()[0] == "name" and self.peek()[1] not in ("extends",):
                self.next()
            self.name()
            if self.eat("extends"):
                sure = True
                self.type()
            if self.eat("="):
                self.type()
            if not self.at(">"):
                self.need(",")
                sure = True
        self.close_angle()
        return sure

    def type_arguments(self) -> None:
        if self.at("<<"):
            self.end = self.start + 1
            self.value = "<"
        self.need("<")
        if self.at(">"):
            self.fail("empty type arguments")
        while not self.at(">"):
            self.type()
            if not self.at(">"):
                self.need(",")
        self.close_angle()

    def close_angle(self) -> None:
        self.need(">")

    def return_type(self) -> None:
        if self.at("asserts") and self.peek()[0] == "name" and not self.peek()[2] and self.peek()[1] != "is":
            self.next()
            self.next()
            if self.eat("is"):
                self.type()
            return
        if self.kind == "name" and self.peek()[1] == "is" and not self.peek()[2]:
            self.next()
            self.next()
        self.type()

    def type(self) -> None:
        if self.at("<") or self.at("new") or self.at("abstract") and self.peek()[1] == "new" or self.at("(") and self.function_type_ahead():
            return self.function_type()
        self.union()
        if not self.no_conditional_type and self.at("extends") and not self.newline:
            self.next()
            self.no_conditional_type = True
            try:
                self.union() if not (self.at("(") and self.function_type_ahead() or self.at("new")) else self.function_type()
            finally:
                self.no_conditional_type = False
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def function_type_ahead(self) -> bool:
        """After ``(`` comes what only a parameter list can begin with."""
        s = self.save()
        try:
            self.next()
            if self.at(")") or self.at("..."):
                return True
            if self.at("this") or self.kind == "name" or self.at("{") or self.at("["):
                if self.kind == "name":
                    self.next()
                else:
                    self.binding()
                if self.at(":") or self.at(",") or self.at("=") or self.at("?") and self.peek()[1] in (":", ",", ")"):
                    return True
                if self.eat(")"):
                    return self.at("=>")
            return False
        except ScriptError:
            return False
        finally:
            self.restore(s)

    def function_type(self) -> None:
        self.eat("abstract")
        self.eat("new")
        if self.at("<"):
            self.type_parameters()
        self.parameters()
        self.need("=>")
        keep, self.no_conditional_type = self.no_conditional_type, self.no_conditional_type
        self.return_type()
        self.no_conditional_type = keep

    def union(self) -> None:
        self.eat("|") or self.eat("&")
        while True:
            self.intersection()
            if not self.eat("|"):
                return

    def intersection(self) -> None:
        self.eat("&")
        while True:
            if self.at("(") and self.function_type_ahead() or self.at("new"):
                self.function_type()
            else:
                self.type_operator()
            if not self.eat("&"):
                return

    def type_operator(self) -> None:
        while self.kind == "name" and self.value in ("keyof", "unique", "readonly") and (self.peek()[0] in ("name", "str") and self.peek()[1] not in ("extends", "is") or self.peek()[1] in ("(", "[", "{")):
            self.next()
        if self.at("infer") and self.peek()[0] == "name":
            self.next()
            self.name()
            s = self.save()
            if self.eat("extends"):
                self.union()
                if self.at("?") and not self.no_conditional_type:
                    self.restore(s)
            return
        self.type_atom()
        while not self.newline:
            if self.at("["):
                self.next()
                if not self.eat("]"):
                    keep, self.no_conditional_type = self.no_conditional_type, False
                    self.type()
                    self.no_conditional_type = keep
                    self.need("]")
            elif self.at("!"):
                self.next()
            else:
                return

    def type_atom(self) -> None:
        kind, value = self.kind, self.value
        keep, self.no_conditional_type = self.no_conditional_type, False
        try:
            if kind == "name":
                if value == "typeof":
                    self.next()
                    if self.at("import"):
                        return self.import_type()
                    self.name(any_word=True)
                    while self.eat("."):
                        self.kind == "private" and self.next() is None or self.name(True)
                    if self.at("<") and not self.newline:
                        self.type_arguments()
                    return
                if value == "import":
                    return self.import_type()
                if value in RESERVED and value not in ("void", "null", "true", "false", "this") and value not in CONTEXT_NAMES:
                    self.fail("expected a type")
                self.next()
                while self.eat("."):
                    self.name(True)
                if self.at("<") and not self.newline or self.at("<<"):
                    self.type_arguments()
            elif kind in ("str", "num"):
                self.next()
            elif value == "-":
                self.next()
                if self.kind != "num":
                    self.fail("expected a number")
                self.next()
            elif value == "{":
                self.object_type()
            elif value == "[":
                self.next()
                while not self.eat("]"):
                    self.eat("...")
                    if self.kind == "name" and (self.peek()[1] == ":" or self.peek()[1] == "?" and self.named_optional()):
                        self.next()
                        self.eat("?")
                        self.need(":")
                    self.type()
                    self.eat("?")
                    if not self.at("]"):
                        self.need(",")
            elif value == "(":
                self.next()
                self.type()
                self.need(")")
            elif value == "`":
                self.template_type()
            else:
                self.fail("expected a type")
        finally:
            self.no_conditional_type = keep

    def named_optional(self) -> bool:
        s = self.save()
        self.next()
        self.next()
        found = self.at(":")
        self.restore(s)
        return found

    def template_type(self) -> None:
        at = self.end
        while True:
            at = _TEMPLATE.match(self.text, at).end()
            if at >= len(self.text):
                self.fail("unclosed template")
            if self.text[at] == "`":
                self.end = at + 1
                return self.next()
            self.end = at + 2
            self.next()
            self.type()
            if not self.at("}"):
                self.fail("unclosed place in a template")
            at = self.end

    def import_type(self) -> None:
        self.need("import")
        self.need("(")
        self.type()
        if self.eat(","):
            self.object_()
        self.need(")")
        while self.eat("."):
            self.name(True)
        if self.at("<"):
            self.type_arguments()

    def object_type(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.kind == "end":
                self.fail("unclosed type")
            self.type_member()
            if not (self.eat(";") or self.eat(",") or self.at("}") or self.newline):
                self.fail("expected ;")

    def type_member(self) -> None:
        if self.at("(") or self.at("<"):
            return self.signature()
        if self.at("new") and self.peek()[1] in ("(", "<"):
            self.next()
            return self.signature()
        if self.at("+") or self.at("-"):
            self.next()
            if not self.at("readonly"):
                self.fail("expected readonly")
        while self.kind == "name" and self.value in ("readonly", "get", "set") and (self.peek()[0] in ("name", "str", "num") or self.peek()[1] == "["):
            self.next()
        if self.at("[") and self.attempt(self.mapped_or_index):
            return
        self.property_name()
        self.eat("?")
        if self.at("(") or self.at("<"):
            return self.signature()
        if self.eat(":"):
            self.type()

    def mapped_or_index(self) -> None:
        self.need("[")
        self.name()
        if self.eat(":"):
            self.type()
            self.need("]")
            self.need(":")
            return self.type()
        self.need("in")
        self.type()
        if self.eat("as"):
            self.type()
        self.need("]")
        if self.at("+") or self.at("-"):
            self.next()
        self.eat("?")
        if self.eat(":"):
            self.type()


def parse(text: str, types: bool = False, jsx: bool = True) -> list[Declaration]:
    """Declarations of a module in order of their start; raises ``ScriptError`` if it is invalid.

    An empty text is a valid module without declarations. Nesting is limited by memory only.
    """

    def run() -> list[Declaration]:
        parser = _Parser(text, types, jsx)
        parser.module()
        return parser.declarations

    return deeply(run, len(text))


def partial(text: str, types: bool = False, jsx: bool = True) -> list[Declaration]:
    """Like ``parse``, but an invalid module gives the declarations that were complete before the error."""
    last: list[_Parser] = []

    def run() -> None:
        last[:] = [_Parser(text, types, jsx)]
        last[0].module()

    try:
        deeply(run, len(text))
    except ScriptError:
        pass
    return [d for d in last[0].declarations if d.end > d.start] if last else []


def error_of(text: str, types: bool, jsx: bool) -> str | None:
    """What makes the text invalid, or null."""
    try:
        parse(text, types, jsx)
        return None
    except ScriptError as e:
        return f"{e.args[0]} at {e.args[1]}"
