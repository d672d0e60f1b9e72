"""A Java reader: tokens, and a tree of declarations, statements and expressions.

It reads Java 17 source well enough for rules: declarations with their modifiers, statements with their lines, full expression trees.
Types are kept as text. What it can't read raises SyntaxError, and the file then has no tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# A space before a token is read along with it. What most tokens are comes first: no other kind begins like a name, or like an operator without . and /.
_TOKEN = re.compile(
    r" ?(?:[^\W\d][\w$]*|\$[\w$]*|>>>=|<<=|>>=|->|::|\+\+|--|&&|\|\||[=!<>+\-*&|^%]=|[-+*%&|^!~<>=?:;,(){}\[\]@]|\s+"
    r"|//[^\n]*|/\*.*?\*/|\"\"\".*?(?<!\\)\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.[^']*|[^'\\])'"
    r"|(?:0[xX](?:[0-9a-fA-F_]+\.?[0-9a-fA-F_]*|\.[0-9a-fA-F_]+)[pP][+-]?\d[\d_]*|0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?"
    r"|\.\.\.|/=|[/.])",
    re.S,
)
#: The kind of a token by its first character, where that tells it.
_FIRST = {**dict.fromkeys("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$", "name"), **dict.fromkeys("=!<>+-*&|^%~?:;,(){}[]@", "op"), **dict.fromkeys("0123456789", "number"), "'": "char"}
PRIMITIVES = frozenset({"byte", "short", "int", "long", "float", "double", "boolean", "char", "void"})
MODIFIERS = frozenset({"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"})
# Fixed values of the language: binary operators from the loosest.
PRECEDENCE = {op: k for k, ops in enumerate([["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">=", "instanceof"], ["<<", ">>", ">>>"], ["+", "-"], ["*", "/", "%"]]) for op in ops}
PREFIX = frozenset({"+", "-", "!", "~", "++", "--"})
ASSIGN = frozenset({"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="})


class Token:
    """word: the text of an operator or a name, None for other kinds."""

    __slots__ = ("kind", "text", "line", "start", "end", "word")

    def __init__(self, kind: str, text: str, line: int, start: int, end: int, word: str | None = None):
        self.kind, self.text, self.line, self.start, self.end, self.word = kind, text, line, start, end, word


def _kind(text: str) -> str:
    """The kind of a token whose first character alone doesn't tell it."""
    c = text[0]
    if c == "/":
        return "comment" if text[1:2] in ("/", "*") and len(text) > 1 else "op"
    if c == ".":
        return "number" if text[1:2].isdecimal() else "op"
    if c == '"':
        return "text" if text.startswith('"""') else "string"
    return "space" if c.isspace() else "number" if c.isdecimal() else "name"


def tokenize(source: str) -> tuple[list[Token], list[Token]]:
    """Tokens and comments."""
    out, comments, at, line = [], [], 0, 1
    pieces, first, add = _TOKEN.findall(source), _FIRST.get, out.append
    if sum(map(len, pieces)) != len(source):
        for m in _TOKEN.finditer(source):
            if m.start() != at:
                break
            at = m.end()
        raise SyntaxError(f"line {1 + source.count(chr(10), 0, at)}: {source[at]!r}")
    for text in pieces:
        start, at = at, at + len(text)
        if text[0] == " " and len(text) > 1:
            start, text = start + 1, text[1:]
        kind = first(text[0]) or _kind(text)
        if kind == "name" or kind == "op":
            add(Token(kind, text, line, start, at, text))
            continue
        if kind != "space":
            (comments if kind == "comment" else out).append(Token(kind, text, line, start, at))
        line += text.count("\n")
    out.append(Token("end", "", line, at, at))
    return out, comments


class Around:
    """What encloses a node: the nearest node of each of these kinds, the names of the types, and whether a try with resources does."""

    __slots__ = ("method", "type_", "names", "if_", "switch_", "cond_", "loop", "block", "managed")
    #: Kinds that enclose what is under them, by the name that it has there.
    KINDS = {"Method": "method", "Type": "type_", "If": "if_", "Switch": "switch_", "Cond": "cond_", "For": "loop", "ForEach": "loop", "Block": "block", "Try": "managed"}

    def __init__(self, outer: Around | None = None):
        if outer is None:
            self.method = self.type_ = self.if_ = self.switch_ = self.cond_ = self.loop = self.block = None
            self.names, self.managed = (), False
        else:
            self.method, self.type_, self.names, self.if_, self.switch_ = outer.method, outer.type_, outer.names, outer.if_, outer.switch_
            self.cond_, self.loop, self.block, self.managed = outer.cond_, outer.loop, outer.block, outer.managed

    def inside(self, n: Node) -> Around:
        """What encloses the children of n: what encloses n, or n itself."""
        name = self.KINDS[n.kind]
        if name == "type_" and not n.name or name == "managed" and not n.resources:
            return self
        out = Around(self)
        setattr(out, name, True if name == "managed" else n)
        if name == "type_":
            out.names = (*self.names, n.name)
        return out


NOWHERE = Around()


class Node:
    """kind, lines, children in source order, and whatever the kind has besides."""

    parent: Node | None = None
    start = end = 0
    around = NOWHERE

    def __init__(self, kind: str, line: int, **fields):
        self.kind, self.line, self.line_end = kind, line, line
        self.kids: list[Node] = []
        if fields:
            self.__dict__.update(fields)

    def add(self, *nodes):
        for n in nodes:
            kind = type(n)
            if kind is Node:
                n.parent = self
                self.kids.append(n)
            elif kind is list:
                self.add(*n)
        return self

    method = property(lambda n: n.around.method)
    type_ = property(lambda n: n.around.type_)
    names = property(lambda n: n.around.names)
    if_ = property(lambda n: n.around.if_)
    switch_ = property(lambda n: n.around.switch_)
    cond_ = property(lambda n: n.around.cond_)
    loop = property(lambda n: n.around.loop)
    block = property(lambda n: n.around.block)
    managed = property(lambda n: n.around.managed)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))

    def find(self, *kinds: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.kind in kinds)

    def up(self, *kinds: str) -> Node | None:
        n = self.parent
        while n is not None and n.kind not in kinds:
            n = n.parent
        return n


class Parser:
    def __init__(self, source: str):
        self.source = source
        self.tokens, self.comments = tokenize(source)
        self.at = 0
        self.closes: dict[int, int] = {}  # where each parenthesis closes
        opened = []
        for k, t in enumerate(self.tokens):
            if t.word == "(":
                opened.append(k)
            elif t.word == ")" and opened:
                self.closes[opened.pop()] = k
        self.in_label = False  # where an arrow ends a case label and makes no lambda

    # ------------------------------------------------------------ tokens

    @property
    def tok(self) -> Token:
        return self.tokens[self.at]

    def peek(self, k: int = 1) -> Token:
        k += self.at
        return self.tokens[k] if k < len(self.tokens) else self.tokens[-1]

    def is_(self, *texts: str) -> bool:
        return self.tokens[self.at].word in texts

    def take(self) -> Token:
        t = self.tokens[self.at]
        if t.kind == "end":
            raise SyntaxError("unexpected end")
        self.at += 1
        return t

    def accept(self, text: str) -> bool:
        if self.tokens[self.at].word == text:
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> Token:
        t = self.tokens[self.at]
        if t.word != text:
            raise SyntaxError(f"line {t.line}: {text} expected, {t.text!r} found")
        self.at += 1
        return t

    def name(self) -> str:
        t = self.tokens[self.at]
        if t.kind != "name":
            raise SyntaxError(f"line {t.line}: name expected, {t.text!r} found")
        self.at += 1
        return t.text

    def done(self, node: Node, first: Token) -> Node:
        last = self.tokens[self.at - 1]
        node.line, node.start, node.end = first.line, first.start, last.end
        node.line_end = last.line if last.word else last.line + last.text.count("\n")
        return node

    def text(self, node: Node) -> str:
        return self.source[node.start : node.end]

    def attempt(self, f):
        """f(), or None with nothing read if it can't be read."""
        at = self.at
        try:
            return f()
        except SyntaxError:
            self.at = at
            return None

    # ------------------------------------------------------------ types and modifiers

    def type_args(self) -> None:
        self.expect("<")
        depth = 1
        while depth:
            t = self.take()
            if t.text == "<":
                depth += 1
            elif t.text == ">":
                depth -= 1
            elif t.text == "(" or not (t.kind == "name" or t.text in ("?", ",", ".", "[", "]", "&", "@")):
                raise SyntaxError(f"line {t.line}: type arguments")

    def type_(self) -> str:
        first = self.tokens[self.at]
        while self.is_("@"):
            self.annotation()
        if self.tokens[self.at].text in PRIMITIVES:
            self.take()
        else:
            while True:
                self.name()
                word = self.tokens[self.at].word
                if word == "<":
                    self.type_args()
                    word = self.tokens[self.at].word
                if not (word == "." and self.peek().kind == "name"):
                    break
                self.at += 1
        while self.tokens[self.at].word == "[" and self.peek().text == "]":
            self.at += 2
        self.accept("...")
        return self.source[first.start : self.tokens[self.at - 1].end]

    def annotation(self) -> str:
        self.expect("@")
        name = self.name()
        while self.accept("."):
            name = self.name()
        if self.is_("("):
            self.skip_parens()
        return name

    def skip_parens(self) -> None:
        depth = 0
        while True:
            t = self.take()
            if t.kind == "op":
                depth += (t.text == "(") - (t.text == ")")
                if not depth:
                    return

    def modifiers(self) -> tuple[set[str], list[str]]:
        mods, annotations = set(), []
        while True:
            word = self.tokens[self.at].word
            if word != "@" and word != "non" and word not in MODIFIERS:
                return mods, annotations
            if self.is_("@") and self.peek().text != "interface":
                annotations.append(self.annotation())
            elif self.tok.text in MODIFIERS and not (self.tok.text == "default" and self.peek().text in (":", "->")) or self.is_("non") and self.peek().text == "-":
                if self.take().text == "non":
                    self.at += 2
                else:
                    mods.add(self.tokens[self.at - 1].text)
            else:
                return mods, annotations

    # ------------------------------------------------------------ declarations

    def unit(self) -> Node:
        first = self.tok
        root = Node("Unit", 1, package="", imports=[])
        at = self.at
        self.modifiers()
        if self.accept("package"):
            root.package = self.dotted()
            self.expect(";")
        else:
            self.at = at
        while self.is_("import"):
            line = self.take().line
            static = self.accept("static")
            name = self.dotted()
            star = self.accept("*") if self.tokens[self.at - 1].text == "." else False
            self.expect(";")
            root.imports.append((line, name.rstrip("."), star, static))
        while self.tok.kind != "end":
            if not self.accept(";"):
                root.add(self.type_declaration())
        return self.done(root, first)

    def dotted(self) -> str:
        out = self.name()
        while self.accept("."):
            out += "."
            if self.is_("*"):
                break
            out += self.name()
        return out

    def type_declaration(self) -> Node:
        first = self.tok
        mods, annotations = self.modifiers()
        return self.type_body(first, mods, annotations)

    def type_body(self, first: Token, mods: set[str], annotations: list[str]) -> Node:
        kind = "annotation" if self.accept("@") and self.is_("interface") else self.tok.text
        if kind not in ("class", "interface", "enum", "record", "annotation"):
            raise SyntaxError(f"line {self.tok.line}: type expected, {self.tok.text!r} found")
        self.take()
        node = Node("Type", first.line, type_kind=kind, name=self.name(), modifiers=mods, annotations=annotations, supers=[])
        if self.is_("<"):
            self.type_args_bounded()
        if kind == "record" and self.is_("("):
            node.add(self.parameters())
        while self.is_("extends", "implements", "permits"):
            self.take()
            node.supers.append(self.type_())
            while self.accept(","):
                node.supers.append(self.type_())
        self.expect("{")
        if kind == "enum":
            while self.tok.kind == "name" or self.is_("@"):
                self.modifiers()
                self.name()
                if self.is_("("):
                    node.add(self.arguments())
                if self.is_("{"):
                    self.members(node)
                if not self.accept(","):
                    break
            self.accept(";")
            while not self.is_("}"):
                self.member(node)
            self.expect("}")
        else:
            self.at -= 1
            self.members(node)
        return self.done(node, first)

    type_args_bounded = type_args

    def members(self, node: Node) -> None:
        self.expect("{")
        while not self.accept("}"):
            self.member(node)

    def member(self, owner: Node) -> None:
        first = self.tok
        if self.accept(";"):
            return
        if self.is_("{") or self.is_("static") and self.peek().text == "{":
            self.accept("static")
            owner.add(self.done(Node("Init", first.line).add(self.block()), first))
            return
        mods, annotations = self.modifiers()
        if self.is_("class", "interface", "enum", "@") or self.is_("record") and self.peek().kind == "name" and self.peek(2).text in ("(", "<"):
            owner.add(self.type_body(first, mods, annotations))
            return
        if self.is_("<"):
            self.type_args_bounded()
        method = Node("Method", first.line, modifiers=mods, annotations=annotations, is_ctor=False, body=None, type="", params=[])
        if self.tok.kind == "name" and self.peek().text in ("(", "{") and self.tok.text == getattr(owner, "name", None):
            method.name, method.is_ctor, method.name_line = self.tok.text, True, self.tok.line
            self.take()
        else:
            method.type = self.type_()
            method.name_line = self.tok.line
            method.name = self.name()
        if not method.is_ctor and not self.is_("("):
            owner.add(self.fields(first, mods, annotations, method.type, method.name))
            return
        if self.is_("("):
            method.params = self.parameters()
        method.add(method.params)
        while self.is_("[") and self.peek().text == "]":
            self.at += 2
        if self.accept("throws"):
            self.type_()
            while self.accept(","):
                self.type_()
        if self.accept("default"):
            method.add(self.initializer())
        if self.is_("{"):
            method.body = self.block()
            method.add(method.body)
        else:
            self.expect(";")
        owner.add(self.done(method, first))

    def parameters(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.accept(")"):
            first = self.tok
            mods, annotations = self.modifiers()
            kind = self.type_()
            if self.accept("this"):
                self.accept(",")
                continue
            out.append(self.done(Node("Param", first.line, name=self.name(), type=kind, modifiers=mods, annotations=annotations), first))
            while self.is_("[") and self.peek().text == "]":
                self.at += 2
            self.accept(",")
        return out

    def fields(self, first: Token, mods: set[str], annotations: list[str], kind: str, name: str) -> Node:
        node = Node("Field", first.line, type=kind, modifiers=mods, annotations=annotations)
        node.add(self.variables(kind, name, self.tokens[self.at - 1]))
        self.expect(";")
        return self.done(node, first)

    def variables(self, kind: str, name: str, first: Token) -> list[Node]:
        out = []
        while True:
            while self.is_("[") and self.peek().text == "]":
                self.at += 2
            var = Node("Var", first.line, name=name, type=kind, init=None)
            if self.accept("="):
                var.init = self.initializer()
                var.add(var.init)
            out.append(self.done(var, first))
            if not self.accept(","):
                return out
            first = self.tok
            name = self.name()

    def initializer(self) -> Node:
        first = self.tok
        if self.accept("{"):
            node = Node("ArrayInit", first.line)
            while not self.accept("}"):
                node.add(self.initializer())
                self.accept(",")
            return self.done(node, first)
        if self.is_("@"):
            self.annotation()
            return self.done(Node("Name", first.line, name="@"), first)
        return self.expression()

    # ------------------------------------------------------------ statements

    def block(self) -> Node:
        first = self.expect("{")
        node = Node("Block", first.line)
        while not self.accept("}"):
            node.add(self.statement())
        return self.done(node, first)

    def condition(self) -> Node:
        self.expect("(")
        e = self.expression()
        self.expect(")")
        return e

    def statement(self) -> Node:
        first = self.tok
        return self.done(self._statement(first), first)

    def _statement(self, first: Token) -> Node:
        line, t = first.line, first.text if first.kind in ("op", "name") else ""
        if t == "{":
            return self.block()
        if t == ";":
            self.take()
            return Node("Empty", line)
        if t == "if":
            self.take()
            node = Node("If", line, cond=self.condition(), other=None)
            node.then = self.statement()
            node.add(node.cond, node.then)
            if self.accept("else"):
                node.other = self.statement()
                node.add(node.other)
            return node
        if t == "while":
            self.take()
            return Node("While", line).add(self.condition(), self.statement())
        if t == "do":
            self.take()
            node = Node("Do", line).add(self.statement())
            self.expect("while")
            node.add(self.condition())
            self.expect(";")
            return node
        if t == "for":
            return self._for(line)
        if t == "switch":
            node = self.switch()
            if self.is_("."):
                raise SyntaxError(f"line {line}: call on a switch statement")
            return node
        if t == "try":
            return self._try(line)
        if t == "synchronized" and self.peek().text == "(":
            self.take()
            node = Node("Sync", line)
            return node.add(self.condition(), self.block())
        if t in ("return", "throw", "yield") and not (t == "yield" and self.peek().text in ("=", ".", "(", "++", "--")):
            self.take()
            node = Node(t.capitalize(), line)
            if not self.is_(";"):
                node.add(self.expression())
            self.expect(";")
            return node
        if t in ("break", "continue"):
            self.take()
            if self.tok.kind == "name":
                self.take()
            self.expect(";")
            return Node("Jump", line)
        if t == "assert":
            self.take()
            node = Node("Assert", line).add(self.expression())
            if self.accept(":"):
                node.add(self.expression())
            self.expect(";")
            return node
        if first.kind == "name" and self.peek().text == ":" and self.peek().kind == "op":
            self.at += 2
            return Node("Labeled", line).add(self.statement())
        at = self.at
        mods, annotations = self.modifiers()
        if self.is_("class", "interface", "enum") or self.is_("record") and self.peek().kind == "name" and self.peek(2).text in ("(", "<"):
            return self.type_body(first, mods, annotations)
        local = self.attempt(lambda: self._local(line, mods, annotations)) if self._may_declare() else None
        if local is not None:
            return local
        self.at = at
        node = Node("Expr", line).add(self.expression())
        self.expect(";")
        return node

    def _may_declare(self) -> bool:
        """Whether what stands here can be a type before a name: what can't needn't be tried."""
        t, after = self.tokens[self.at], self.peek()
        return t.word == "@" or t.kind == "name" and (after.kind == "name" or after.word in ("<", ".", "[", "..."))

    def _local_head(self) -> tuple[str, str, Token]:
        kind = self.type_()
        first = self.tok
        name = self.name()
        if not self.is_("=", ";", ",", ":", "["):
            raise SyntaxError("not a declaration")
        return kind, name, first

    def _local(self, line: int, mods: set[str], annotations: list[str]) -> Node:
        kind, name, first = self._local_head()
        node = Node("Local", line, type=kind, modifiers=mods, annotations=annotations)
        node.add(self.variables(kind, name, first))
        self.expect(";")
        return node

    def _for(self, line: int) -> Node:
        self.expect("for")
        self.expect("(")
        at = self.at
        first = self.tok
        mods, annotations = self.modifiers()
        head = self.attempt(self._local_head)
        if head and self.accept(":"):
            kind, name, at_name = head
            var = self.done(Node("Var", at_name.line, name=name, type=kind, init=None), at_name)
            local = Node("Local", line, type=kind, modifiers=mods, annotations=annotations).add(var)
            node = Node("ForEach", line).add(local, self.expression())
            self.expect(")")
            return node.add(self.statement())
        self.at = at
        node = Node("For", line)
        if not self.accept(";"):
            mods, annotations = self.modifiers()
            local = self.attempt(lambda: self._local(line, mods, annotations))
            if local is None:
                node.add(self.expression())
                while self.accept(","):
                    node.add(self.expression())
                self.expect(";")
            else:
                node.add(self.done(local, first))
        if not self.is_(";"):
            node.add(self.expression())
        self.expect(";")
        while not self.accept(")"):
            node.add(self.expression())
            self.accept(",")
        return node.add(self.statement())

    def _try(self, line: int) -> Node:
        self.expect("try")
        node = Node("Try", line, resources=[], catches=[], finally_=None)
        if self.accept("("):
            while not self.accept(")"):
                first = self.tok
                mods, annotations = self.modifiers()
                head = self.attempt(self._local_head)
                if head:
                    kind, name, at = head
                    local = Node("Local", first.line, type=kind, modifiers=mods, annotations=annotations)
                    node.resources.append(self.done(local.add(self.variables(kind, name, at)), first))
                else:
                    node.resources.append(self.expression())
                self.accept(";")
        node.add(node.resources)
        node.body = self.block()
        node.add(node.body)
        while self.is_("catch"):
            first = self.take()
            self.expect("(")
            self.modifiers()
            self.type_()
            while self.accept("|"):
                self.type_()
            catch = Node("Catch", first.line, name=self.name())
            self.expect(")")
            catch.body = self.block()
            node.catches.append(self.done(catch.add(catch.body), first))
        node.add(node.catches)
        if self.accept("finally"):
            node.finally_ = self.block()
            node.add(node.finally_)
        return node

    def switch(self) -> Node:
        first = self.expect("switch")
        node = Node("Switch", first.line).add(self.condition())
        self.expect("{")
        while not self.accept("}"):
            if self.accept("default"):
                pass
            else:
                self.expect("case")
                while True:
                    pattern = self.attempt(lambda: (self.type_(), self.name())[1] if self.peek().text not in ("->", ":", ",") else None)
                    if pattern is None:
                        self.in_label = True
                        node.add(self.ternary())
                        self.in_label = False
                    if not self.accept(","):
                        break
            if self.accept("->"):
                if self.is_("{", "throw"):
                    node.add(self.statement())
                else:
                    node.add(self.expression())
                    self.expect(";")
            else:
                self.expect(":")
                while not self.is_("case", "default", "}"):
                    node.add(self.statement())
        return self.done(node, first)

    # ------------------------------------------------------------ expressions

    def expression(self) -> Node:
        first = self.tokens[self.at]
        left = self.ternary()
        if self.tokens[self.at].word in ASSIGN:
            op = self.take().text
            while op in (">", ">>") and self.tok.text in (">", ">=", ">>="):
                op += self.take().text
            right = self.expression()
            return self.done(Node("Assign", first.line, op=op, left=left, right=right).add(left, right), first)
        return left

    def ternary(self) -> Node:
        first = self.tokens[self.at]
        cond = self.binary(0)
        if self.tokens[self.at].word == "?":
            self.at += 1
            a = self.ternary()
            self.expect(":")
            b = self.ternary()
            return self.done(Node("Cond", first.line).add(cond, a, b), first)
        return cond

    def operator(self) -> str | None:
        t = self.tokens[self.at]
        if t.word not in PRECEDENCE:
            return None
        if t.text == ">" and self.peek().text in (">", ">=") and self.peek().start == t.end:
            if self.peek().text == ">=":
                return None
            third = self.peek(2)
            return ">>>" if third.text == ">" and third.start == self.peek().end else ">>"
        if t.text == "<" and self.peek().text == "<" and self.peek().start == t.end:
            return "<<"
        return t.text

    def binary(self, least: int) -> Node:
        first = self.tokens[self.at]
        left = self.unary()
        while (op := self.operator()) and PRECEDENCE[op] >= least:
            self.at += len(op) if op in ("<<", ">>", ">>>") and self.tok.text in ("<", ">") else 1
            if op == "instanceof":
                self.accept("final")
                kind = self.type_()
                name = self.name() if self.tok.kind == "name" and not self.is_("instanceof") else None
                left = self.done(Node("InstanceOf", first.line, type=kind, name=name).add(left), first)
                continue
            right = self.binary(PRECEDENCE[op] + 1)
            left = self.done(Node("Binary", first.line, op=op, left=left, right=right).add(left, right), first)
        return left

    def unary(self) -> Node:
        first = self.tokens[self.at]
        word = first.word
        if word in PREFIX:
            self.take()
            return self.done(Node("Unary", first.line, op=first.text).add(self.unary()), first)
        if word == "(" and not self._is_lambda():
            cast = self.attempt(self._cast)
            if cast is not None:
                return self.done(cast, first)
        node = self.postfix(self.primary(), first)
        while self.tokens[self.at].word in ("++", "--"):
            op = self.take().text
            node = self.done(Node("Unary", first.line, op=op).add(node), first)
        return node

    def _cast(self) -> Node:
        first = self.expect("(")
        kind = self.type_()
        while self.accept("&"):
            self.type_()
        self.expect(")")
        t = self.tok
        if kind.split("[")[0] not in PRIMITIVES and t.kind == "op" and t.text not in ("(", "!", "~"):
            raise SyntaxError("not a cast")
        if t.kind == "end" or t.kind == "op" and t.text not in ("(", "!", "~", "+", "-", "++", "--") or t.text == "instanceof":
            raise SyntaxError("not a cast")
        return Node("Cast", first.line, type=kind).add(self.unary())

    def _is_lambda(self) -> bool:
        """Whether the parentheses here close before an arrow."""
        k = self.closes.get(self.at)
        return k is not None and k + 1 < len(self.tokens) and self.tokens[k + 1].text == "->"

    def _lambda(self) -> Node:
        first = self.tok
        node = Node("Lambda", first.line, params=[])
        if self.is_("("):
            at = self.at
            typed = self.attempt(self.parameters)
            if typed is None:
                self.at = at + 1
                while not self.accept(")"):
                    node.params.append(self.name())
                    self.accept(",")
            else:
                node.params = [p.name for p in typed]
        else:
            node.params = [self.name()]
        self.expect("->")
        return self.done(node.add(self.block() if self.is_("{") else self.expression()), first)

    def arguments(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.accept(")"):
            out.append(self.expression())
            if not self.is_(")"):
                self.expect(",")
        return out

    def primary(self) -> Node:
        first = self.tokens[self.at]
        line = first.line
        if first.kind in ("number", "string", "char", "text"):
            self.at += 1
            return self.done(Node("Literal", line, literal=first.kind, value=first.text), first)
        if self.is_("("):
            if self._is_lambda():
                return self._lambda()
            self.take()
            node = Node("Paren", line).add(self.expression())
            self.expect(")")
            return self.done(node, first)
        if first.kind != "name":
            raise SyntaxError(f"line {line}: expression expected, {first.text!r} found")
        after = self.peek().word
        if after == "->" and not self.in_label:
            return self._lambda()
        if first.text == "new":
            return self._new()
        if first.text == "switch":
            return self.switch()
        if first.text in ("true", "false", "null"):
            self.take()
            return self.done(Node("Literal", line, literal=first.text if first.text == "null" else "boolean", value=first.text), first)
        if after == "<" or after == "[" or first.text in PRIMITIVES:
            ref = self.attempt(self._type_reference)
            if ref is not None:
                return self.done(ref, first)
        self.at += 1
        name = first.text
        if after == "(":
            args = self.arguments()
            return self.done(Node("Call", line, scope=None, name=name, args=args, name_line=line).add(args), first)
        return self.done(Node("Name", line, name=name), first)

    def _type_reference(self) -> Node:
        """int[].class, List<String>::new."""
        line = self.tok.line
        kind = self.type_()
        if self.is_("::"):
            return Node("Name", line, name=kind)
        self.expect(".")
        self.expect("class")
        return Node("ClassLiteral", line, type=kind)

    def _new(self) -> Node:
        first = self.expect("new")
        while self.is_("@"):
            self.annotation()
        begin = self.tok
        if self.tok.text in PRIMITIVES:
            self.take()
        else:
            self.name()
            while True:
                if self.is_("<"):
                    self.type_args()
                elif self.is_("."):
                    self.take()
                    self.name()
                else:
                    break
        kind = self.source[begin.start : self.tokens[self.at - 1].end]
        if self.is_("["):
            node = Node("NewArray", first.line, type=kind)
            while self.is_("["):
                self.take()
                if not self.is_("]"):
                    node.add(self.expression())
                self.expect("]")
            if self.is_("{"):
                node.add(self.initializer())
            return self.done(node, first)
        args = self.arguments()
        node = Node("New", first.line, type=kind, args=args).add(args)
        if self.is_("{"):
            body = Node("Type", self.tok.line, type_kind="anonymous", name="", modifiers=set(), annotations=[], supers=[kind])
            begin = self.tok
            self.members(body)
            node.add(self.done(body, begin))
        return self.done(node, first)

    def postfix(self, node: Node, first: Token) -> Node:
        while True:
            word = self.tokens[self.at].word
            if word != "." and word != "[" and word != "::":
                return node
            if word == "[":
                self.take()
                node = Node("Index", first.line).add(node, self.expression())
                self.expect("]")
            elif word == "::":
                self.take()
                node = Node("MethodRef", first.line, scope=node, name=self.name()).add(node)
            else:
                self.take()
                if self.is_("<"):
                    self.type_args()
                if self.is_("new"):
                    node = self._new().add(node)
                elif self.tok.text in ("class", "this", "super"):
                    node = Node("Access", first.line, scope=node, name=self.take().text).add(node)
                else:
                    line = self.tok.line
                    name = self.name()
                    if self.is_("("):
                        args = self.arguments()
                        node = Node("Call", first.line, scope=node, name=name, args=args, name_line=line).add(node, args)
                    else:
                        node = Node("Access", first.line, scope=node, name=name).add(node)
            self.done(node, first)


def parse(source: str) -> tuple[Parser, Node]:
    p = Parser(source)
    try:
        return p, p.unit()
    except RecursionError as e:
        raise SyntaxError("nested too deeply") from e
