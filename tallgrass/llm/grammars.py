"""Validity of texts in the languages of source and configuration files.

Every function returns null for a valid text and else what is wrong with it. A byte
order mark and carriage returns before line feeds are no errors.
"""

from __future__ import annotations

import json
import re

from tallgrass.functions import script_parser
from tallgrass.functions.deep import deeply


def clean(text: str) -> str:
    return text.removeprefix("﻿").replace("\r\n", "\n")


# -- JSON, TOML, XML ----------------------------------------------------------------
def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def json_error(text: str) -> str | None:
    text = clean(text)
    try:
        try:
            json.loads(text, parse_constant=_no_constant)
        except RecursionError:
            # The decoder in Python has no stack of its own to run out of.
            decoder = json.JSONDecoder(parse_constant=_no_constant)
            decoder.parse_object, decoder.parse_array, decoder.memo = json.decoder.JSONObject, json.decoder.JSONArray, {}
            decoder.scan_once = json.scanner.py_make_scanner(decoder)
            deeply(lambda: decoder.decode(text), len(text))
    except ValueError as e:
        return str(e)[:120]
    return None


def toml_error(text: str) -> str | None:
    import tomllib

    try:
        deeply(lambda: tomllib.loads(clean(text)), len(text))
    except ValueError as e:
        return str(e)[:120]
    return None


def xml_error(text: str, root: str | None = None) -> str | None:
    """Well-formedness; with ``root`` also the name of the outermost element."""
    from xml.parsers import expat

    parser = expat.ParserCreate("utf-8", namespace_separator=" ")
    names: list[str] = []

    def start(name, _):
        if not names:
            names.append(name.rsplit(" ", 1)[-1])

    parser.StartElementHandler = start
    try:
        parser.Parse(clean(text).encode("utf-8", "surrogatepass"), True)
    except (expat.ExpatError, UnicodeError, ValueError) as e:
        return str(e)[:120]
    if root and names and names[0] != root:
        return f"the outermost element is {names[0]}"
    return None


# -- style sheets -------------------------------------------------------------------
_STYLE_SKIP = re.compile(r"(?:\s+|/\*[\s\S]*?\*/|<!--|-->)+")
_SCSS_SKIP = re.compile(r"(?:\s+|/\*[\s\S]*?\*/|//[^\n]*)+")
_STYLE_PART = re.compile(r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|#\{[^{}]*\}|(?i:url)\((?:[^()\"'\\\s]|\\.)*\)|/\*[\s\S]*?\*/|[^\"'{};()\[\]/#\\]+|\\[\s\S]|[()\[\]/#]")
_SELECTOR_PART = re.compile(
    r"\s*(?:[>+~,|]|\|\|)\s*|\s+|/\*[\s\S]*?\*/|\*|&(?:[\w\-]+)?|%?-?[A-Za-z_\u0080-\uffff][\w\-\u0080-\uffff]*|[.#](?:-?[A-Za-z_\u0080-\uffff\\][\w\-\\\u0080-\uffff]*|#\{[^{}]*\}[\w\-]*|\\.[\w\-]*)"
    r"|\[\s*[\w\-|*]+\s*(?:[~|^$*]?=\s*(?:\"[^\"\n]*\"|'[^'\n]*'|[\w\-#{}$.]+)\s*[iIsS]?\s*)?\]|::?-?[A-Za-z][\w\-]*|\((?:[^()\"']|\"[^\"]*\"|'[^']*'|\((?:[^()]|\([^()]*\))*\))*\)|#\{[^{}]*\}[\w\-]*|\d+(?:\.\d+)?%|\\."
)
_PROPERTY = re.compile(r"\s*(?:[*_]?-{0,2}[A-Za-z_\u0080-\uffff][\w\-\u0080-\uffff]*|--[\w\-\u0080-\uffff]*|(?:[\w\-]*#\{[^{}]*\}[\w\-]*)+)\s*:(?!:)")
_VARIABLE = re.compile(r"\s*(?:[\w\-]+\.)?\$[\w\-]+\s*:")
_AT = re.compile(r"@-?[A-Za-z][\w\-]*")


class _Style:
    def __init__(self, text: str, nested: bool) -> None:
        self.text, self.at, self.nested = text, 0, nested
        self.skip_pattern = _SCSS_SKIP if nested else _STYLE_SKIP

    def skip(self) -> None:
        m = self.skip_pattern.match(self.text, self.at)
        if m:
            self.at = m.end()

    def fail(self, why: str) -> None:
        raise ValueError(f"{why} at {self.at}")

    def prelude(self) -> tuple[str, str]:
        """What stands before the next ``{``, ``;`` or ``}``, and that character ('' at the end of the text)."""
        begin, depth = self.at, 0
        while self.at < len(self.text):
            c = self.text[self.at]
            if c in "{;}" and depth <= 0:
                return self.text[begin : self.at], c
            if self.nested and c == "/" and self.text.startswith("//", self.at) and self.text[self.at - 1 : self.at] != ":":
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
                continue
            m = _STYLE_PART.match(self.text, self.at)
            if m is None:
                if depth > 0 and c in ";{}":
                    if c == ";":
                        self.at += 1
                        continue
                    self.fail("unclosed parenthesis")
                self.fail("unclosed string or comment" if c in "\"'/" else "unexpected character")
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
                if depth < 0:
                    self.fail("unexpected )")
            self.at = m.end()
        if depth > 0:
            self.fail("unclosed parenthesis")
        return self.text[begin : self.at], ""

    def items(self, inside: bool) -> None:
        while True:
            self.skip()
            if self.at >= len(self.text):
                if inside:
                    self.fail("unclosed block")
                return
            c = self.text[self.at]
            if c == "}":
                if not inside:
                    self.fail("nothing to close")
                self.at += 1
                return
            if c == ";":
                if not inside and not self.nested:
                    self.fail("stray ;")
                self.at += 1
                continue
            if self.text.startswith("/*", self.at):
                self.fail("unclosed comment")
            self.item(inside)

    def item(self, inside: bool) -> None:
        begin = self.at
        head, end = self.prelude()
        head = re.sub(r"/\*[\s\S]*?\*/", " ", head)
        if self.nested:
            head = re.sub(r"(?<!:)//[^\n]*", " ", head)
        if _AT.match(head):
            if end == "{":
                self.at += 1
                return self.items(True)
            if end == ";":
                self.at += 1
            elif end == "" and not inside:
                self.fail("unclosed rule")
            return
        if end == "{":
            if inside and re.fullmatch(r"\s*--[\w\-]+\s*:\s*", head):
                self.at += 1
                return self.items(True)
            if self.nested and (_PROPERTY.fullmatch(head.rstrip()) or re.match(r"\s*\$[\w\-]+\s*:", head)) and inside:
                self.at += 1
                return self.items(True)
            self.selector(head, begin)
            self.at += 1
            return self.items(True)
        # a declaration
        if _VARIABLE.match(head):
            if not self.nested:
                self.fail("a variable")
        elif not inside or not _PROPERTY.match(head):
            self.at = begin
            self.fail("no rule")
        value = head.split(":", 1)[1]
        if not value.strip() and not head.lstrip().startswith("--"):
            self.fail("no value")
        if re.search(r"\n\s*[\w\-]+\s*:\s", value) and not head.lstrip().startswith(("--", "$")) and "(" not in value:
            self.at = begin
            self.fail("a declaration without end")
        if re.search(r"(?:^|\n)\s*(?:<{7}|>{7}|={7})", value) or re.search(r"[<>]{3}|\u201c|\u201d|=>", value):
            self.at = begin
            self.fail("no value")
        if end == ";":
            self.at += 1
        elif end == "":
            self.fail("unclosed block" if inside else "unclosed rule")

    def selector(self, head: str, begin: int) -> None:
        at, text = 0, head.strip()
        if not text:
            self.at = begin
            self.fail("no selector")
        while at < len(text):
            m = _SELECTOR_PART.match(text, at)
            if m is None or m.end() == at:
                self.at = begin
                self.fail("no selector")
            part = m.group()
            if part[0] == "(" and not re.search(r":[\w\-]+\s*\Z", text[:at]):
                self.at = begin
                self.fail("no selector")
            at = m.end()
        if re.search(r",\s*\Z", text) and not self.nested:
            self.at = begin
            self.fail("no selector")


def style_error(text: str, nested: bool) -> str | None:
    try:
        deeply(lambda: _Style(clean(text), nested).items(False), len(text))
    except ValueError as e:
        return str(e)[:120]
    return None


# -- YAML ---------------------------------------------------------------------------
_QUOTED = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*'")
_ESCAPES = re.compile(r"\\(?![0abt\tnvfre \"/\\N_LP\n]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})")
_PROPERTIES = re.compile(r"(?:(?:&[^\s,\[\]{}]+|!(?:<[^>\s]*>|[^\s,\[\]{}]*))(?:\s+|\Z))+")
_BLOCK_HEADER = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])\s*(?:\s#.*)?\Z")
_PLAIN_KEY = re.compile(r"(?![\-?:](?:\s|\Z))(?![,\[\]{}#&*!|>'\"%@`])(?:[^:#\n]|:(?=\S)|(?<=\S)#)+?\s*:(?=\s|\Z)")
_COMMENT = re.compile(r"\s*(?:#.*)?\Z")


class _Yaml:
    """A parser for block and flow structure; it keeps no values."""

    def __init__(self, text: str) -> None:
        self.rows = text.split("\n")
        self.row = 0
        self.scalar_root = False

    def fail(self, why: str) -> None:
        raise ValueError(f"{why} in line {self.row + 1}")

    # A position is a row and the text of it from some column on; ``pending`` replaces the current row's text.
    def peek(self) -> tuple[int, str] | None:
        """Indentation and text of the next row that isn't blank or a comment."""
        while self.row < len(self.rows):
            line = self.rows[self.row]
            body = line.lstrip(" ")
            if body.strip() and not body.startswith("#"):
                if body[0] == "\t":
                    if body.strip().startswith("#"):
                        self.row += 1
                        continue
                    self.fail("a tab in the indentation")
                return len(line) - len(body), body.rstrip()
            self.row += 1
        return None

    def marker(self, indent: int, body: str) -> bool:
        return indent == 0 and (body in ("---", "...") or body.startswith(("--- ", "... ")))

    def stream(self) -> None:
        while True:
            p = self.peek()
            if p is None:
                return
            indent, body = p
            if indent == 0 and body.startswith("%"):
                self.row += 1
                continue
            if self.marker(indent, body):
                rest = body[3:].strip()
                if body.startswith("...") or not rest or rest.startswith("#"):
                    self.row += 1
                else:
                    self.rows[self.row] = "    " + rest
                if body.startswith("..."):
                    continue
            p = self.peek()
            if p is None:
                return
            if self.marker(*p):
                continue
            self.node(-1, *p)
            p = self.peek()
            if p is not None and not self.marker(*p):
                self.fail("unexpected content")

    def key_end(self, body: str) -> int:
        """Where the value of a mapping entry begins in ``body``, 0 if it is no entry."""
        m = _PROPERTIES.match(body)
        at = m.end() if m else 0
        if at < len(body) and body[at] in "\"'":
            q = _QUOTED.match(body, at)
            if q and "\n" not in q.group():
                c = re.compile(r"\s*:(?=\s|\Z)").match(body, q.end())
                return c.end() if c else 0
            return 0
        if body.startswith(("? ", "?\t")) or body == "?":
            return 1
        if at < len(body) and body[at] == "*":
            c = re.compile(r"\*[^\s,\[\]{}]+\s+:(?=\s|\Z)").match(body, at)
            return c.end() if c else 0
        if at < len(body) and body[at] in "[{":
            return 0
        k = _PLAIN_KEY.match(body, at)
        return k.end() if k and not re.search(r"\s#", body[at : k.end()]) else 0

    def node(self, parent: int, indent: int, body: str) -> None:
        """A node whose first row is at ``indent`` > ``parent``."""
        if body.startswith("- ") or body == "-":
            self.sequence(indent)
        elif self.key_end(body):
            self.mapping(indent)
        else:
            row = self.row
            self.scalar(parent, indent, body)
            if parent < 0 and row == 0 | row:
                self.scalar_root = body[0] not in "[{\"'|>&!*"

    def sequence(self, indent: int) -> None:
        while True:
            p = self.peek()
            if p is None or p[0] < indent or self.marker(*p):
                return
            if p[0] > indent:
                self.fail("wrong indentation")
            body = p[1]
            if not (body.startswith("- ") or body == "-"):
                return
            rest = body[1:].lstrip(" ")
            if rest.startswith("\t"):
                rest = rest.lstrip()
            if not rest or rest.startswith("#"):
                self.row += 1
                n = self.peek()
                if n is not None and n[0] > indent and not self.marker(*n):
                    self.node(indent, *n)
            else:
                column = indent + len(body) - len(rest)
                self.rows[self.row] = " " * column + rest
                self.node(indent, column, rest)

    def mapping(self, indent: int) -> None:
        while True:
            p = self.peek()
            if p is None or p[0] < indent or self.marker(*p):
                return
            if p[0] > indent:
                self.fail("wrong indentation")
            body = p[1]
            if body.startswith("- ") or body == "-":
                if indent >= 0:
                    return
            if body.startswith(": ") or body == ":":  # the value of an entry that began with ?
                self.value(indent, body[1:].strip())
                continue
            end = self.key_end(body)
            if not end:
                self.fail("no key")
            key = body[:end]
            if key.startswith('"') and _ESCAPES.search(key):
                self.fail("unknown escape")
            self.value(indent, body[end:].strip())

    def value(self, indent: int, rest: str) -> None:
        m = _PROPERTIES.match(rest)
        if m:
            rest = rest[m.end() :]
        if not rest or rest.startswith("#"):
            self.row += 1
            n = self.peek()
            if n is None or self.marker(*n):
                return
            if n[0] > indent:
                self.node(indent, *n)
            elif n[0] == indent and (n[1].startswith("- ") or n[1] == "-"):
                self.sequence(indent)
            return
        self.scalar(indent, indent + 1, rest)

    def scalar(self, parent: int, indent: int, body: str) -> None:
        """A scalar or flow collection that begins with ``body`` in the current row."""
        m = _PROPERTIES.match(body)
        if m and m.end():
            body = body[m.end() :]
            if not body:
                self.row += 1
                n = self.peek()
                if n is not None and n[0] > parent and not self.marker(*n):
                    self.node(parent, *n)
                return
        c = body[0]
        if c in "|>":
            if not _BLOCK_HEADER.match(body):
                self.fail("wrong block header")
            self.row += 1
            first = None
            while self.row < len(self.rows):
                line = self.rows[self.row]
                if line.strip():
                    width = len(line) - len(line.lstrip(" "))
                    if first is None:
                        first = width
                    if width <= parent or width < first and width <= max(parent, 0) or width < first:
                        if width > parent:
                            self.fail("wrong indentation in a block")
                        return
                self.row += 1
            return
        if c in "\"'":
            text = body
            while True:
                q = _QUOTED.match(text)
                if q:
                    if c == '"' and _ESCAPES.search(q.group()):
                        self.fail("unknown escape")
                    if not _COMMENT.match(text[q.end() :]) or text[q.end() : q.end() + 1] == "#":
                        self.fail("text after a quote")
                    self.row += 1
                    return
                text = self.more(text, parent, "unclosed quote")
        if c in "[{":
            text = body
            while True:
                end = self.flow(text)
                if end >= 0:
                    if not _COMMENT.match(text[end:]) or text[end : end + 1] == "#":
                        self.fail("text after a collection")
                    self.row += 1
                    return
                text = self.more(text, parent, "unclosed collection")
        if c == "*":
            if not re.match(r"\*[^\s,\[\]{}]+\s*(?:#.*)?\Z", body):
                self.fail("wrong alias")
            self.row += 1
            return
        if c in "@`%,]}" or c in "?-:" and (len(body) == 1 or body[1] in " \t"):
            self.fail("a reserved character")
        self.plain(parent, body)

    def more(self, text: str, parent: int, why: str) -> str:
        self.row += 1
        if self.row >= len(self.rows):
            self.row -= 1
            self.fail(why)
        line = self.rows[self.row]
        if line.strip():
            width = len(line) - len(line.lstrip(" "))
            if width <= parent and not line.strip()[0] in "]}" or self.marker(width, line.strip()):
                self.fail(why)
        return text + "\n" + line.strip()

    def plain(self, parent: int, body: str) -> None:
        while True:
            comment = re.search(r"\s#", body)
            text = body[: comment.start()] if comment else body
            if re.search(r":(?:\s|\Z)", text.rstrip()):
                self.fail("a mapping inside a scalar")
            if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text):
                self.fail("a control character")
            self.row += 1
            p = self.peek()
            if p is None or p[0] <= parent or self.marker(*p):
                return
            if comment:
                self.fail("text after a comment")
            body = p[1]

    def flow(self, text: str) -> int:
        """End of the flow collection at the beginning of ``text``, -1 if it isn't closed yet."""
        stack: list[str] = []
        at, expect = 0, True  # expect: a value may come
        while at < len(text):
            c = text[at]
            if c in " \t\n":
                at += 1
            elif c == "#" and (at == 0 or text[at - 1] in " \t\n"):
                at = text.find("\n", at)
                if at < 0:
                    return -1
            elif c in "[{":
                if not expect:
                    self.fail("a comma is missing")
                stack.append(c)
                at += 1
                expect = True
            elif c in "]}":
                if not stack or stack.pop() != {"]": "[", "}": "{"}[c]:
                    self.fail("mismatched brackets")
                at += 1
                expect = False
                if not stack:
                    return at
            elif c == ",":
                if expect and re.search(r"[\[{,]\s*\Z", text[:at]):
                    self.fail("an empty entry")
                at += 1
                expect = True
            elif c == ":" and (at + 1 == len(text) or text[at + 1] in " \t\n,[]{}" or text[at - 1] in "\"'"):
                at += 1
                expect = True
            elif c in "\"'":
                q = _QUOTED.match(text, at)
                if not q:
                    return -1
                if not expect:
                    self.fail("a comma is missing")
                if c == '"' and _ESCAPES.search(q.group()):
                    self.fail("unknown escape")
                at, expect = q.end(), False
            elif c in "&!*":
                m = re.compile(r"[&!*][^\s,\[\]{}]*").match(text, at)
                at = m.end()
                if c == "*":
                    expect = False
            elif c in "@`%|>":
                self.fail("a reserved character")
            else:
                m = re.compile(r"(?:[^,\[\]{}:#\n]|:(?![\s,\[\]{}]|\Z)|(?<=\S)#)+").match(text, at)
                if not m:
                    self.fail("an unexpected character")
                if not expect:
                    self.fail("a comma is missing")
                at, expect = m.end(), False
        return -1


def yaml_error(text: str) -> str | None:
    """Structure of YAML. A document that is nothing but several words of text is taken for no YAML."""

    def run() -> bool:
        parser = _Yaml(clean(text))
        parser.stream()
        return parser.scalar_root

    try:
        scalar = deeply(run, len(text))
    except ValueError as e:
        return str(e)[:120]
    return "nothing but text" if scalar and len(text.split()) > 1 else None


def script_error(text: str, types: bool, jsx: bool) -> str | None:
    return script_parser.error_of(clean(text), types, jsx)


def python_error(text: str) -> str | None:
    """By the interpreter's own parser, with its own limits of nesting (200 brackets, 100 blocks)."""
    import ast
    import warnings

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(clean(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return str(e)[:120]
    return None


#: Grammars by name. Each is what the extensions of that name claim.
GRAMMARS = {
    "ts": lambda t: script_error(t, True, False),
    "tsx": lambda t: script_error(t, True, True),
    "js": lambda t: script_error(t, False, True),
    "jsx": lambda t: script_error(t, False, True),
    "json": json_error,
    "css": lambda t: style_error(t, False),
    "scss": lambda t: style_error(t, True),
    "yaml": yaml_error,
    "yml": yaml_error,
    "toml": toml_error,
    "xml": xml_error,
    "svg": lambda t: xml_error(t, "svg"),
}
