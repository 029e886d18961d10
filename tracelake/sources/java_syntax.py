"""A tolerant parser of Java source: what it can't read is counted and skipped, and what stands beside it is kept.

Trees are of Tree nodes: a kind, the token at which they start (with line and character offset) and their parts by name. Types are strings
without type arguments. Errors skip a statement, else a member; an unbalanced brace ends at the end of the file.
"""

from __future__ import annotations

import re

LEXEME = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"{3}.*?(?:\"{3}|\Z)|"(?:\\.|[^"\\\n])*"?)|(?P<char>'(?:\\.|[^'\\\n])*'?)
    |(?P<number>0[xXbB][0-9a-fA-F_]+[lL]?|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?[fFdDlL]?)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)
    |(?P<op><<=|<<|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<>+\-*/&|^%]=|.)""",
    re.S | re.X,
)
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int "
    "interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while "
    "true false null".split()
)
PRIMITIVES = frozenset("boolean byte char short int long float double void".split())
MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
LEVELS = [("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">=", "instanceof"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%")]
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())


class Token(str):
    __slots__ = ("kind", "line", "at", "end")


class Tree:
    def __init__(self, kind: str, token: Token, **parts):
        self.kind, self.line, self.at, self.end = kind, token.line, token.at, token.end
        self.__dict__.update(parts)

    def __repr__(self) -> str:
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items() if k not in ('kind', 'line', 'at', 'end'))})"


class Unreadable(Exception):
    pass


def lex(text: str) -> list[Token]:
    out, line = [], 1
    for m in LEXEME.finditer(text):
        if m.lastgroup != "skip":
            t = Token(m[0])
            t.kind, t.line, t.at, t.end = m.lastgroup, line, m.start(), m.end()
            out.append(t)
        line += m[0].count("\n")
    end = Token("")
    end.kind, end.line, end.at, end.end = "end", line, len(text), len(text)
    return [*out, end]


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i, self.errors = text, lex(text), 0, 0

    @property
    def t(self) -> Token:
        return self.tokens[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def take(self, *wanted: str) -> Token | None:
        if self.t.kind in ("op", "name") and self.t in wanted:
            self.i += 1
            return self.tokens[self.i - 1]
        return None

    def need(self, wanted: str) -> Token:
        t = self.take(wanted)
        if t is None:
            raise Unreadable(f"{wanted} at line {self.t.line}")
        return t

    def name(self) -> Token:
        if self.t.kind != "name" or self.t in KEYWORDS:
            raise Unreadable(f"a name at line {self.t.line}")
        self.i += 1
        return self.tokens[self.i - 1]

    def source(self, x: Tree) -> str:
        """The text of an expression, with white space as one space."""
        return " ".join(self.text[x.at : x.end].split())

    def closed(self, x: Tree) -> Tree:
        x.end = self.tokens[self.i - 1].end
        return x

    def skip_to(self, depth_end: bool) -> None:
        """After an error: past the next ; of this depth, or (depth_end) to the brace that ends the block, or past a block."""
        self.errors += 1
        depth = 0
        while self.t.kind != "end":
            if self.t == "{":
                depth += 1
            elif self.t == "}":
                if depth == 0:
                    return
                depth -= 1
                if depth == 0:
                    self.i += 1
                    return
            elif self.t == ";" and depth == 0:
                self.i += 1
                return
            self.i += 1

    # Types and names

    def qualified(self) -> str:
        parts = [self.name()]
        while self.t == "." and self.peek().kind == "name" and self.peek() not in KEYWORDS:
            self.i += 1
            parts.append(self.name())
        return ".".join(parts)

    def arguments_of_type(self) -> None:
        if not self.take("<"):
            return
        depth = 1
        while depth:
            if self.t.kind == "end" or self.t in (";", "{", "}", "(", ")", "&&", "||"):
                raise Unreadable("type arguments")
            depth += (self.t == "<") - (self.t == ">")
            self.i += 1

    def type(self) -> str:
        while self.t == "@":
            self.annotation()
        if self.t in PRIMITIVES:
            out = str(self.t)
            self.i += 1
        elif self.take("?"):
            out = "?"
        else:
            parts = [self.name()]
            self.arguments_of_type()
            while self.t == "." and self.peek().kind == "name" and self.peek() not in KEYWORDS:
                self.i += 1
                parts.append(self.name())
                self.arguments_of_type()
            out = ".".join(parts)
        while self.t == "[" and self.peek() == "]":
            self.i += 2
            out += "[]"
        return out

    def attempt(self, rule):
        """What a rule gives, or None and back where it began."""
        i = self.i
        try:
            return rule()
        except Unreadable:
            self.i = i
            return None

    def annotation(self) -> Tree:
        start = self.need("@")
        x = Tree("annotation", start, name=self.qualified(), values={})
        if self.take("("):
            while not self.take(")"):
                key = "value"
                if self.t.kind == "name" and self.peek() == "=":
                    key = str(self.name())
                    self.i += 1
                x.values[key] = self.annotation_value()
                if not self.take(",") and self.t != ")":
                    raise Unreadable("annotation")
        return self.closed(x)

    def annotation_value(self) -> Tree:
        if self.t == "@":
            return self.annotation()
        if self.t == "{":
            x, items = Tree("array", self.t), []
            self.i += 1
            while not self.take("}"):
                items.append(self.annotation_value())
                if not self.take(",") and self.t != "}":
                    raise Unreadable("annotation")
            x.items = items
            return self.closed(x)
        return self.binary(0)

    def modifiers(self) -> tuple[list[str], list[Tree]]:
        words, notes = [], []
        while True:
            if self.t == "@" and self.peek() != "interface":
                notes.append(self.annotation())
            elif self.t in MODIFIERS and self.t.kind == "name" and not (self.t in ("default", "sealed") and self.peek() in (":", "->", "=", ".")):
                words.append(str(self.t))
                self.i += 1
            elif self.t == "non" and self.peek() == "-":
                self.i += 3
            else:
                return words, notes

    # Declarations

    def unit(self) -> Tree:
        x = Tree("unit", self.t, package="", imports=[], types=[])
        at = self.i
        self.attempt(self.modifiers)
        if self.take("package"):
            x.package = self.qualified()
            self.take(";")
        else:
            self.i = at
        while self.t.kind != "end":
            try:
                if self.take("import"):
                    static = bool(self.take("static"))
                    name = self.qualified()
                    if self.take("."):
                        self.need("*")
                        name += ".*"
                    x.imports.append((name, static))
                    self.need(";")
                elif self.take(";"):
                    pass
                else:
                    x.types.append(self.declaration())
            except Unreadable:
                self.skip_to(False)
                self.take("}")
        return x

    def declaration(self) -> Tree:
        first = self.t
        words, notes = self.modifiers()
        start = self.t
        if self.t == "@" and self.peek() == "interface":
            self.i += 1
        kind = self.take("class", "interface", "enum", "record")
        if not kind:
            raise Unreadable("a type")
        x = Tree(str(kind), start, name=str(self.name()), modifiers=words, annotations=notes, extends="", implements=[], fields=[], methods=[], types=[], first=first.line)
        self.arguments_of_type()
        if kind == "record" and self.t == "(":
            for p in self.parameters():
                x.fields.append(Tree("fielddecl", start, name=p.name, type=p.type, modifiers=["private", "final"], annotations=p.annotations, value=None, first=p.line))
        while not self.take("{"):
            if self.take("extends"):
                types = [self.type()]
                while self.take(","):
                    types.append(self.type())
                if kind == "interface":
                    x.implements += types
                else:
                    x.extends = types[0]
            elif self.take("implements", "permits"):
                keep = self.tokens[self.i - 1] == "implements"
                types = [self.type()]
                while self.take(","):
                    types.append(self.type())
                x.implements += types if keep else []
            else:
                raise Unreadable("a type body")
        if kind == "enum":
            self.constants(x)
        self.members(x)
        return self.closed(x)

    def constants(self, x: Tree) -> None:
        while self.t not in (";", "}") and self.t.kind != "end":
            _, notes = self.modifiers()
            t = self.name()
            x.fields.append(Tree("fielddecl", t, name=str(t), type=x.name, modifiers=["static", "final"], annotations=notes, value=None, first=t.line))
            if self.t == "(":
                self.arguments()
            if self.take("{"):
                self.members(Tree("class", t, name="", fields=[], methods=[], types=[]))
            self.take(",")
        self.take(";")

    def members(self, x: Tree) -> None:
        while not self.take("}"):
            if self.t.kind == "end":
                self.errors += 1
                return
            at = self.i
            try:
                self.member(x)
            except Unreadable:
                self.i = max(self.i, at)
                self.skip_to(True)

    def member(self, x: Tree) -> None:
        if self.take(";"):
            return
        at, first = self.i, self.t
        words, notes = self.modifiers()
        if self.t == "{":
            x.methods.append(Tree("initializer", first, name="", modifiers=words, annotations=[], params=[], body=self.block(), returns="void", first=first.line))
            return
        if self.t in ("class", "interface", "enum") or self.t == "@" or self.t == "record" and self.peek().kind == "name" and self.peek(2) in ("(", "<"):
            self.i = at
            x.types.append(self.declaration())
            return
        self.arguments_of_type()
        start = self.t
        if self.t.kind == "name" and self.t == x.name and self.peek() == "(":
            self.i += 1
            self.method(x, start, "<init>", "void", words, notes, first)
            return
        if self.t == x.name and self.peek() == "{":  # a record's short constructor
            self.i += 1
            x.methods.append(Tree("initializer", start, name="", modifiers=words, annotations=[], params=[], body=self.block(), returns="void", first=first.line))
            return
        kind = self.type()
        name = self.name()
        if self.t == "(":
            self.method(x, name, str(name), kind, words, notes, first)
            return
        while True:
            dims = ""
            while self.t == "[" and self.peek() == "]":
                self.i += 2
                dims += "[]"
            value = self.initial() if self.take("=") else None
            x.fields.append(Tree("fielddecl", name, name=str(name), type=kind + dims, modifiers=words, annotations=notes, value=value, first=first.line))
            if not self.take(","):
                break
            name = self.name()
        self.need(";")

    def method(self, x: Tree, at: Token, name: str, returns: str, words, notes, first: Token) -> None:
        m = Tree("method", at, name=name, modifiers=words, annotations=notes, params=self.parameters(), returns=returns, body=None, broken=False, first=first.line)
        while self.t not in ("{", ";", "default") and self.t.kind != "end":
            self.i += 1
        if self.take("default"):
            self.annotation_value()
        if self.t == "{":
            before = self.errors
            m.body = self.block()
            m.broken = self.errors > before
        else:
            self.need(";")
        x.methods.append(self.closed(m))

    def parameters(self) -> list[Tree]:
        out = []
        self.need("(")
        while not self.take(")"):
            words, notes = self.modifiers()
            kind = self.type()
            if self.take("..."):
                kind += "[]"
            if self.take("this"):
                self.take(",")
                continue
            name = self.name()
            while self.t == "[" and self.peek() == "]":
                self.i += 2
                kind += "[]"
            out.append(Tree("param", name, name=str(name), type=kind, annotations=notes, modifiers=words, first=name.line))
            if not self.take(",") and self.t != ")":
                raise Unreadable("parameters")
        return out

    # Statements

    def block(self) -> Tree:
        x = Tree("block", self.need("{"), items=[])
        while not self.take("}"):
            if self.t.kind == "end":
                self.errors += 1
                break
            try:
                x.items.append(self.statement())
            except Unreadable:
                self.skip_to(True)
        return self.closed(x)

    def local(self) -> Tree:
        """Type and name, before = ; , : or [."""
        start = self.t
        words, _ = self.modifiers()
        kind = self.type()
        name = self.name()
        if self.t not in ("=", ";", ",", ":", "[", ")", "->", "when"):
            raise Unreadable("no declaration")
        return Tree("local", start, type=kind, items=[], first=name, modifiers=words)

    def declared(self, x: Tree) -> Tree:
        """The rest of a declaration: (name, value) of each variable."""
        name = x.first
        while True:
            while self.t == "[" and self.peek() == "]":
                self.i += 2
            x.items.append((str(name), self.initial() if self.take("=") else None, name.line))
            if not self.take(","):
                return self.closed(x)
            name = self.name()

    def statement(self) -> Tree:
        t = self.t
        if t == "{":
            return self.block()
        if t.kind == "name":
            if t in ("if", "while", "do", "for", "switch", "try", "synchronized", "return", "break", "continue", "throw", "assert", "yield") and not (t == "yield" and self.peek() in ("=", ".", "(", "++", "--")):
                return getattr(self, f"_{t}")()
            if self.peek() == ":" and t not in KEYWORDS:
                self.i += 2
                return Tree("labeled", t, label=str(t), body=self.statement())
            if t in ("class", "interface", "enum") or t in ("abstract", "static", "final") and self.peek() in ("class", "interface", "enum"):
                return Tree("type", t, of=self.declaration())
        if self.take(";"):
            return Tree("empty", t)
        x = self.attempt(self.local)
        if x:
            self.declared(x)
            self.need(";")
            return x
        x = Tree("do_expr", t, value=self.expression())
        self.need(";")
        return x

    def condition(self) -> Tree:
        self.need("(")
        x = self.expression()
        self.need(")")
        return x

    def _if(self) -> Tree:
        x = Tree("if", self.need("if"), test=self.condition(), then=self.statement())
        x.other = self.statement() if self.take("else") else None
        return x

    def _while(self) -> Tree:
        return Tree("while", self.need("while"), test=self.condition(), body=self.statement())

    def _do(self) -> Tree:
        x = Tree("do", self.need("do"), body=self.statement())
        self.need("while")
        x.test = self.condition()
        self.take(";")
        return x

    def _for(self) -> Tree:
        start = self.need("for")
        self.need("(")
        first = None
        if self.t != ";":
            first = self.attempt(self.local)
            if first and self.take(":"):
                over = self.expression()
                self.need(")")
                return Tree("foreach", start, name=str(first.first), type=first.type, over=over, body=self.statement())
            if first:
                self.declared(first)
            else:
                first = Tree("block", self.t, items=[Tree("do_expr", e_start, value=e) for e_start, e in self.expressions(";")])
        self.need(";")
        test = None if self.t == ";" else self.expression()
        self.need(";")
        step = self.expressions(")")
        self.need(")")
        return Tree("for", start, first=first, test=test, step=[Tree("do_expr", s, value=e) for s, e in step], body=self.statement())

    def expressions(self, end: str) -> list[tuple[Token, Tree]]:
        out = []
        while self.t != end:
            out.append((self.t, self.expression()))
            if not self.take(","):
                break
        return out

    def _switch(self) -> Tree:
        x = Tree("switch", self.need("switch"), on=self.condition(), groups=[])
        x.end = self.tokens[self.i - 1].end
        head_end = x.end
        self.need("{")
        while not self.take("}"):
            if self.t.kind == "end":
                raise Unreadable("switch")
            labels, default, start = [], False, self.t
            while self.t in ("case", "default"):
                if self.take("default"):
                    default = True
                else:
                    self.i += 1
                    while True:
                        if self.take("default"):
                            default = True
                        else:
                            at = self.t.at
                            self.attempt(self.local) or self.attempt(self.pattern) or self.binary(0)
                            labels.append(" ".join(self.text[at : self.tokens[self.i - 1].end].split()))
                        if not self.take(","):
                            break
                    if self.t == "when":
                        self.i += 1
                        self.binary(0)
                arrow = bool(self.take("->"))
                if not arrow:
                    self.need(":")
                if arrow or self.t not in ("case", "default"):
                    break
            else:
                raise Unreadable("switch")
            body = Tree("block", start, items=[])
            if arrow:
                if self.t in ("{", "throw"):
                    body.items.append(self.statement())
                else:
                    e = Tree("yield", self.t, value=self.expression())
                    self.need(";")
                    body.items.append(e)
            else:
                while self.t not in ("case", "default", "}") and self.t.kind != "end":
                    try:
                        body.items.append(self.statement())
                    except Unreadable:
                        self.skip_to(True)
            x.groups.append((labels, default, arrow, body))
        x.end = head_end
        return x

    def pattern(self) -> bool:
        """A record pattern, or a type alone."""
        self.type()
        if self.t == "(":
            self.arguments_skipped()
        if self.t not in ("->", ":", ",", "when"):
            raise Unreadable("no pattern")
        return True

    def _try(self) -> Tree:
        x = Tree("try", self.need("try"), resources=[], catches=[], last=None)
        if self.take("("):
            while not self.take(")"):
                r = self.attempt(self.local)
                x.resources.append(self.declared(r) if r else Tree("do_expr", self.t, value=self.expression()))
                self.take(";")
        x.body = self.block()
        while self.take("catch"):
            self.need("(")
            self.modifiers()
            kind = self.type()
            while self.take("|"):
                self.type()
            name = self.name()
            self.need(")")
            x.catches.append((kind, str(name), self.block()))
        if self.take("finally"):
            x.last = self.block()
        return x

    def _synchronized(self) -> Tree:
        start = self.need("synchronized")
        return Tree("sync", start, on=self.condition(), body=self.block())

    def _return(self) -> Tree:
        x = Tree("return", self.need("return"), value=None if self.t == ";" else self.expression())
        self.need(";")
        return x

    def _jump(self) -> Tree:
        x = Tree(str(self.t), self.t, label="")
        self.i += 1
        if self.t != ";":
            x.label = str(self.name())
        self.need(";")
        return x

    _break = _continue = _jump

    def _value(self) -> Tree:
        x = Tree(str(self.t), self.t)
        self.i += 1
        x.value = self.expression()
        if x.kind == "assert" and self.take(":"):
            self.expression()
        self.need(";")
        return x

    _throw = _yield = _assert = _value

    # Expressions

    def initial(self) -> Tree:
        return self.array() if self.t == "{" else self.expression()

    def array(self) -> Tree:
        x = Tree("array", self.need("{"), items=[])
        while not self.take("}"):
            x.items.append(self.initial())
            if not self.take(",") and self.t != "}":
                raise Unreadable("array")
        return self.closed(x)

    def expression(self) -> Tree:
        start = self.t
        if self.t.kind == "name" and self.peek() == "->" or self.t == "(" and self.lambda_ahead():
            return self.closed(self.lambda_())
        left = self.binary(0)
        if self.take("?"):
            then = self.expression()
            self.need(":")
            return self.closed(Tree("cond", start, test=left, then=then, other=self.expression()))
        op = self.operator(ASSIGN)
        if op:
            return self.closed(Tree("assign", start, op=op, target=left, value=self.initial()))
        return left

    def operator(self, wanted) -> str | None:
        """An operator; > is lexed alone, so that >> and the like are put together here."""
        t = self.t
        if t == ">" and t.kind == "op":
            op, n = ">", 1
            while n < 4 and op[-1] == ">" and self.peek(n) in (">", ">=") and self.peek(n).at == t.at + len(op):
                op += self.peek(n)
                n += 1
            if op in wanted:
                self.i += n
                return op
            return None
        if t.kind in ("op", "name") and t in wanted:
            self.i += 1
            return str(t)
        return None

    def binary(self, level: int) -> Tree:
        if level == len(LEVELS):
            return self.unary()
        start, left = self.t, self.binary(level + 1)
        while True:
            at = self.i
            op = self.operator(LEVELS[level])
            if not op:
                return left
            if op == "instanceof":
                self.take("final")
                kind, bound = self.type(), ""
                if self.t == "(":
                    self.arguments_skipped()
                if self.t.kind == "name" and self.t not in KEYWORDS:
                    bound = str(self.name())
                left = self.closed(Tree("instanceof", start, value=left, type=kind, bound=bound))
                continue
            if self.t in (")", ";", ",", "]", "}"):
                self.i = at
                raise Unreadable("an operand")
            left = self.closed(Tree("binary", start, op=op, left=left, right=self.binary(level + 1)))

    def arguments_skipped(self) -> None:
        depth = 0
        while self.t.kind != "end":
            depth += (self.t == "(") - (self.t == ")")
            self.i += 1
            if depth == 0:
                return

    def unary(self) -> Tree:
        start = self.t
        if start.kind == "op" and start in ("+", "-", "!", "~", "++", "--"):
            self.i += 1
            return self.closed(Tree("unary", start, op=str(start), value=self.unary()))
        if start == "(":
            x = self.attempt(self.cast)
            if x:
                return x
        x = self.postfix(self.primary())
        while self.t in ("++", "--"):
            op = str(self.t)
            self.i += 1
            x = self.closed(Tree("unary", start, op="post" + op, value=x))
        return x

    def cast(self) -> Tree:
        start = self.need("(")
        kind = self.type()
        while self.take("&"):
            self.type()
        self.need(")")
        t = self.t
        if kind in PRIMITIVES or t.kind in ("string", "char", "number") or t in ("(", "!", "~") or t.kind == "name" and (t not in KEYWORDS or t in ("this", "super", "new", "true", "false", "null", "switch")):
            lambda_ = t.kind == "name" and self.peek() == "->" or t == "(" and self.lambda_ahead()
            return self.closed(Tree("cast", start, type=kind, value=self.lambda_() if lambda_ else self.unary()))
        raise Unreadable("no cast")

    def lambda_ahead(self) -> bool:
        depth, n = 0, 0
        while True:
            t = self.peek(n)
            if t.kind == "end":
                return False
            depth += (t == "(") - (t == ")")
            if depth == 0:
                return self.peek(n + 1) == "->"
            if t in ("{", "}", ";"):
                return False
            n += 1

    def lambda_(self) -> Tree:
        start, names = self.t, []
        if self.take("("):
            while not self.take(")"):
                self.modifiers()
                if self.peek() in (",", ")"):
                    names.append(str(self.name()))
                else:
                    self.type()
                    names.append(str(self.name()))
                self.take(",")
        else:
            names.append(str(self.name()))
        self.need("->")
        return Tree("lambda", start, params=names, body=self.block() if self.t == "{" else self.expression())

    def arguments(self) -> list[Tree]:
        out = []
        self.need("(")
        while not self.take(")"):
            out.append(self.expression())
            if not self.take(",") and self.t != ")":
                raise Unreadable(f"arguments at line {self.t.line}")
        return out

    def primary(self) -> Tree:
        t = self.t
        if t.kind in ("string", "char", "number"):
            self.i += 1
            return Tree("literal", t, text=str(t), of=t.kind)
        if t == "(":
            self.i += 1
            x = self.expression()
            self.need(")")
            return x
        if t == "switch":
            return self.closed(Tree("choice", t, of=self._switch()))
        if t in ("true", "false", "null"):
            self.i += 1
            return Tree("literal", t, text=str(t), of="word")
        if t == "this":
            self.i += 1
            if self.t == "(":
                return self.closed(Tree("call", t, on=None, name="this", args=self.arguments()))
            return Tree("this", t)
        if t == "super":
            self.i += 1
            if self.t == "(":
                return self.closed(Tree("call", t, on=None, name="super", args=self.arguments()))
            return Tree("super", t)
        if t == "new":
            return self.new()
        if t in PRIMITIVES:
            kind = self.type()
            if self.take("::"):
                self.i += 1
                return self.closed(Tree("reference", t, on=None, name="new"))
            self.need(".")
            self.need("class")
            return self.closed(Tree("literal", t, text=kind, of="class"))
        name = self.name()
        if self.t == "(":
            return self.closed(Tree("call", name, on=None, name=str(name), args=self.arguments()))
        if self.t == "[" and self.peek() == "]":
            while self.t == "[" and self.peek() == "]":
                self.i += 2
            if self.take("::"):
                self.i += 1
                return self.closed(Tree("reference", name, on=None, name="new"))
            self.need(".")
            self.need("class")
            return self.closed(Tree("literal", name, text=str(name), of="class"))
        return Tree("name", name, name=str(name))

    def new(self) -> Tree:
        start = self.need("new")
        if self.t in PRIMITIVES:
            kind = str(self.t)
            self.i += 1
        else:
            kind = self.qualified()
            self.arguments_of_type()
        if self.t == "[":
            items = []
            while self.take("["):
                if self.t != "]":
                    items.append(self.expression())
                self.need("]")
            return self.closed(Tree("newarray", start, type=kind, items=self.array().items if self.t == "{" else items))
        x = Tree("new", start, type=kind, args=self.arguments(), body=None)
        if self.take("{"):
            x.body = Tree("class", start, name="", fields=[], methods=[], types=[])
            self.members(x.body)
        return self.closed(x)

    def postfix(self, x: Tree) -> Tree:
        start = self.tokens[self.i - 1]
        start_tree = x
        while True:
            if self.take("."):
                if self.t == "<":
                    self.arguments_of_type()
                if self.t == "new":
                    x = self.new()
                    continue
                if self.take("class"):
                    x = self.closed(Tree("literal", start, text="class", of="class"))
                    continue
                if self.take("this"):
                    x = Tree("this", start)
                    continue
                name = Token(self.t) if self.t == "super" else None
                if name is not None:
                    self.i += 1
                    x = Tree("super", start)
                    continue
                name = self.name()
                y = Tree("call", name, on=x, name=str(name), args=self.arguments()) if self.t == "(" else Tree("field", name, on=x, name=str(name))
                y.at = start_tree.at
                x = self.closed(y)
            elif self.t == "[":
                self.i += 1
                y = Tree("index", start, on=x, index=self.expression())
                self.need("]")
                y.at = start_tree.at
                x = self.closed(y)
            elif self.take("::"):
                name = self.t
                self.i += 1
                y = Tree("reference", name, on=x, name=str(name))
                y.at = start_tree.at
                x = self.closed(y)
            else:
                return x


def parse(text: str) -> tuple[Tree, Parser]:
    p = Parser(text)
    try:
        return p.unit(), p
    except RecursionError:
        p.errors += 1
        return Tree("unit", p.tokens[0], package="", imports=[], types=[]), p
