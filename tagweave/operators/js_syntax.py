"""JavaScript syntax trees by operator precedence, with scopes.

Nodes are generic: a kind and named fields. What may follow an expression is a table of precedences, statements
are methods found by their first token. The first error ends the reading.
"""

from __future__ import annotations

import re
import sys

from ..functions.positions import error
from .js import IDENTIFIERS, NAMES, NUMBERS, Lexer, REST_OF_LINE
from .js_scope import ARGUMENT, CATCH, EXPRESSION, FUNCTION, LEXICAL, PRIVATE, VARIABLE, Name, Scope, Variable

(EXPR, ASSIGN, COALESCE, OR, AND, BITOR, BITXOR, BITAND, EQUALS, COMPARE, SHIFT, ADD, MUL, EXP, UNARY, UPDATE, LHS, OPT, CALL, NEW, MEMBER, PRIMARY) = range(22)
LIMIT = 1000

#: Operator -> (its level, least level of the left side, level of the right side).
BINARY = {
    **dict.fromkeys("= *= /= %= **= += -= <<= >>= >>>= &= ^= |= &&= ||= ??=".split(), (ASSIGN, LHS, ASSIGN)),
    **dict.fromkeys("< <= > >= in instanceof".split(), (COMPARE, COMPARE, SHIFT)),
    **dict.fromkeys("== != === !==".split(), (EQUALS, EQUALS, COMPARE)),
    "&&": (AND, AND, BITOR), "||": (OR, OR, AND), "??": (COALESCE, BITOR, BITOR), "|": (BITOR, BITOR, BITXOR), "^": (BITXOR, BITXOR, BITAND), "&": (BITAND, BITAND, EQUALS),
    **dict.fromkeys("<< >> >>>".split(), (SHIFT, SHIFT, ADD)), "+": (ADD, ADD, MUL), "-": (ADD, ADD, MUL), **dict.fromkeys("* / %".split(), (MUL, MUL, EXP)), "**": (EXP, UPDATE, EXP),
}
PREFIX = {**dict.fromkeys("! ~ typeof void delete + -".split(), UNARY), "++": UPDATE, "--": UPDATE}
LITERALS = frozenset("String this null true false RegExp".split())
DECIMAL_KEY = re.compile(rb"0|[1-9][0-9]*(?:\.[0-9]*)?|\.[0-9]+")
NAME_KEY = re.compile(rb"[A-Za-z$_][A-Za-z0-9$_]*")


class Failed(Exception):
    pass


class Node:
    __slots__ = ("kind", "f")

    def __init__(self, kind: str, **fields):
        self.kind, self.f = kind, fields

    def __getattr__(self, name: str):
        try:
            return self.f[name]
        except KeyError:
            raise AttributeError(name) from None


class Reader:
    def __init__(self, data: bytes, inline: bool = False, while_to_for: bool = False):
        self.lexer, self.data, self.inline, self.while_to_for = Lexer(data), data, inline, while_to_for
        self.kind, self.text, self.new_line = "Whitespace", b"", False
        self.allow_in, self.await_, self.yield_, self.default, self.returns = True, True, False, False, False
        self.maybe_arrow, self.prologue = False, False
        self.comments: list[Node] = []
        self.depth_stmt = self.depth_expr = 0
        self.scope: Scope | None = None
        self.scopes: list[Scope] = []
        self.ended: list[Scope] = []  # innermost first

    # Tokens and errors

    def next(self) -> None:
        self.new_line = False
        while True:
            self.kind, self.text = self.lexer.next()
            if self.kind in ("Comment", "CommentLineTerminator"):
                if self.text[2:3] == b"!" and len(self.text) > 2:
                    self.comments.append(Node("Comment", value=self.text))
                self.new_line |= self.kind != "Comment"
            elif self.kind == "LineTerminator":
                self.new_line = True
            elif self.kind != "Whitespace":
                return

    def stop(self, message: str) -> None:
        raise Failed(message)

    def fail(self, where: str, *expected: str) -> None:
        if self.kind == "Error" and self.lexer.wrong:
            message = self.lexer.wrong[0]
        else:
            found = "EOF" if self.kind == "Error" else self.text.decode("utf-8", "replace")
            if expected:
                *most, last = expected
                options = f"{', '.join(most)}{',' if len(most) > 1 else ''} or {last}" if most else last
                message = f"expected {options} instead of {found}"
            else:
                message = f"unexpected {found}"
        raise Failed(message + (f" in {where}" if where else ""))

    def consume(self, where: str, kind: str) -> None:
        if self.kind != kind:
            self.fail(where, kind)
        self.next()

    def take(self) -> bytes:
        text = self.text
        self.next()
        return text

    def accept(self, kind: str) -> bool:
        if self.kind == kind:
            self.next()
            return True
        return False

    def is_reference(self, kind: str) -> bool:
        return kind in IDENTIFIERS or not self.yield_ and kind == "yield" or not self.await_ and kind == "await"

    # Scopes

    def enter(self, function: bool, what: str) -> Scope:
        self.scope = Scope(self.scope, function, what)
        self.scopes.append(self.scope)
        return self.scope

    def leave(self) -> None:
        self.scope.end()
        self.ended.append(self.scope)
        self.scope = self.scope.parent

    def declare(self, decl: int, name: bytes) -> Name:
        found = self.scope.declare(decl, name)
        if found is None:
            self.stop(f"identifier {name.decode('utf-8', 'replace')} has already been declared")
        return found

    def settle(self) -> None:
        """What every name refers to; called once, when all of the program is read."""
        for scope in self.ended:
            scope.settle()
        self.scopes = [s for s in self.scopes if not s.given_up]

    # Programs and statements

    def program(self) -> Node:
        shebang = None
        if not self.inline and self.data.startswith(b"#!"):
            end = REST_OF_LINE.match(self.data, 2).end()
            shebang, self.lexer.at = self.data[:end], end
        self.next()
        self.prologue = True
        self.returns = self.inline
        scope = self.enter(True, "program")
        body: list[Node] = []
        while self.kind != "Error":
            if not self.inline and self.kind == "import":
                body.append(self.import_item())
            elif not self.inline and self.kind == "export":
                body.append(self.export())
            else:
                body.append(self.statement(True))
        if not self.inline:
            body = self.comments + body
        if shebang is not None:
            body.insert(0, Node("Comment", value=shebang))
        self.leave()
        self.settle()
        return Node("Block", list=body, scope=scope)

    def statement(self, declarations: bool) -> Node:
        self.depth_stmt += 1
        if self.depth_stmt > LIMIT:
            self.stop("too many nested statements")
        prologue, self.prologue = self.prologue, False
        kind = self.kind
        special = STATEMENTS.get(kind)
        if kind == "return" and self.returns:
            special = Reader.return_statement
        node = special(self, declarations) if special else self.expression_statement(prologue)
        if kind == "Error":
            return node
        if not self.new_line:
            self.accept(";")
        self.depth_stmt -= 1
        return node

    def check_end(self, where: str) -> None:
        if not self.new_line and self.kind not in (";", "}", "Error"):
            self.fail(where)

    def expression_statement(self, prologue: bool) -> Node:
        if self.is_reference(self.kind):
            label = self.take()
            if self.accept(":"):
                default = self.default
                if self.kind == "function":
                    self.default = False
                node = Node("Labelled", label=label, value=self.statement(True))
                self.default = default
                return node
            value = self.suffix(self.scope.use(label), EXPR, PRIMARY)
        else:
            value = self.expression(EXPR)
        self.check_end("expression")
        if prologue and value.kind == "Literal" and value.type == "String" and value.data[1:-1] == b"use strict":
            self.prologue = True
            return Node("Directive", value=value.data)
        return Node("ExprStmt", value=value)

    def block_statement(self, _) -> Node:
        return self.block("block statement")

    def block(self, where: str) -> Node:
        scope = self.enter(False, "block")
        body = self.braced(where)
        self.leave()
        return Node("Block", list=body, scope=scope)

    def braced(self, where: str) -> list[Node]:
        before, body = len(self.comments), []
        self.consume(where, "{")
        while not self.accept("}"):
            if self.kind == "Error":
                self.fail("")
            body.append(self.statement(True))
        found = self.comments[before:]
        del self.comments[before:]
        return found + body

    def variables(self, declarations: bool) -> Node:
        kind = self.kind
        if kind == "const" and not declarations:
            self.fail("statement")
        self.next()
        node = self.var_decl(kind)
        self.check_end("const declaration" if kind == "const" else "var statement")
        return node

    def let(self, declarations: bool) -> Node:
        word = self.take()
        if declarations and (self.kind in IDENTIFIERS or self.kind in ("yield", "await", "[", "{")):
            node = self.var_decl("let")
            self.check_end("let declaration")
            return node
        if self.kind == "[":
            self.stop("unexpected let [ in single-statement context")
        node = Node("ExprStmt", value=self.suffix(self.scope.use(word), EXPR, PRIMARY))
        self.check_end("expression")
        return node

    def var_decl(self, kind: str) -> Node:
        found = []
        while True:
            binding, value = self.binding(VARIABLE if kind == "var" else LEXICAL), None
            if self.accept("="):
                value = self.expression(ASSIGN)
            elif not isinstance(binding, Name) and (self.allow_in or found):
                self.fail("var statement", "=")
            elif kind == "const" and (self.allow_in or self.kind not in ("of", "in")):
                self.fail("const statement", "=")
            found.append(Node("BindingElement", binding=binding, default=value))
            if not self.accept(","):
                return Node("VarDecl", type=kind, list=found)

    def condition(self, where: str) -> Node:
        self.consume(where, "(")
        value = self.expression(EXPR)
        self.consume(where, ")")
        return value

    def if_statement(self, _) -> Node:
        self.next()
        cond = self.condition("if statement")
        body = self.statement(False)
        return Node("If", cond=cond, body=body, otherwise=self.statement(False) if self.accept("else") else None)

    def branch(self, _) -> Node:
        kind, label = self.kind, None
        self.next()
        if not self.new_line and self.is_reference(self.kind):
            label = self.take()
        return Node("Branch", type=kind, label=label)

    def with_statement(self, _) -> Node:
        self.next()
        cond = self.condition("with statement")
        self.scope.around(function=True).has_with = True
        return Node("With", cond=cond, body=self.statement(False))

    def do_while(self, _) -> Node:
        self.next()
        body = self.statement(False)
        self.consume("do-while statement", "while")
        return Node("DoWhile", cond=self.condition("do-while statement"), body=body)

    def while_statement(self, _) -> Node:
        self.next()
        cond = self.condition("while statement")
        body = self.statement(False)
        if not self.while_to_for:
            return Node("While", cond=cond, body=body)
        if body.kind != "Block":
            body = Node("Block", list=[body], scope=None)
        return Node("For", init=Node("VarDecl", type="var", list=[]), cond=cond, post=None, body=body)

    def for_statement(self, _) -> Node:
        where = "for statement"
        self.next()
        awaits = self.await_ and self.accept("await")
        self.consume(where, "(")
        scope = self.enter(False, "for")
        self.allow_in, init = False, None
        if self.kind in ("var", "let", "const"):
            kind = self.kind
            self.next()
            init = self.var_decl(kind)
            first = init.list[0]
            if self.kind != ";" and (len(init.list) > 1 or first.default is not None):
                self.fail(where)
            if self.kind == ";" and first.default is None and not isinstance(first.binding, Name):
                self.fail(where)
        elif awaits:
            init = self.expression(LHS)
        elif self.kind != ";":
            init = self.expression(EXPR)
        self.allow_in = True
        assignable = init is None or init.kind not in VALUES
        if assignable and self.kind in ("in", "of"):
            kind = self.kind
            if kind == "in" and awaits:
                self.fail(where, "of")
            self.next()
            value = self.expression(EXPR if kind == "in" else ASSIGN)
            self.consume(where, ")")
            body = self.for_body(scope)
            node = Node("ForIn", init=init, value=value, body=body) if kind == "in" else Node("ForOf", awaits=bool(awaits), init=init, value=value, body=body)
        elif self.kind == ";":
            if awaits:
                self.fail(where, "of")
            self.next()
            cond = self.expression(EXPR) if self.kind != ";" else None
            self.consume(where, ";")
            post = self.expression(EXPR) if self.kind != ")" else None
            self.consume(where, ")")
            body = self.for_body(scope)
            node = Node("For", init=init or Node("VarDecl", type="var", list=[]), cond=cond, post=post, body=body)
        else:
            self.fail(where, *(("in", "of") if assignable else ()), ";")
        self.leave()
        return node

    def for_body(self, scope: Scope) -> Node:
        self.scope.head_over("for_decls")
        if self.kind == "{":
            body = self.braced("")
        elif self.accept(";"):
            body = []
        else:
            body = [self.statement(False)]
        return Node("Block", list=body, scope=scope)

    def switch(self, _) -> Node:
        where = "switch statement"
        self.next()
        init = self.condition(where)
        self.consume(where, "{")
        scope, clauses = self.enter(False, "switch"), []
        while not self.accept("}"):
            if self.kind == "Error":
                self.fail(where)
            kind, cond = self.kind, None
            if kind not in ("case", "default"):
                self.fail(where, "case", "default")
            self.next()
            if kind == "case":
                cond = self.expression(EXPR)
            self.consume(where, ":")
            body = []
            while self.kind not in ("case", "default", "}", "Error"):
                body.append(self.statement(True))
            clauses.append(Node("Clause", type=kind, cond=cond, list=body))
        self.leave()
        return Node("Switch", init=init, list=clauses, scope=scope)

    def function_statement(self, declarations: bool) -> Node:
        if not declarations:
            self.fail("statement")
        return self.function(False, False)

    def async_statement(self, declarations: bool) -> Node:
        word = self.take()
        if self.kind == "function" and not self.new_line:
            if not declarations:
                self.fail("statement")
            return self.function(True, False)
        node = Node("ExprStmt", value=self.async_expression(EXPR, word))
        self.check_end("expression")
        return node

    def class_statement(self, declarations: bool) -> Node:
        if not declarations:
            self.fail("statement")
        return self.class_(False)

    def return_statement(self, _) -> Node:
        self.next()
        value = None if self.new_line or self.kind in (";", "}", "Error") else self.expression(EXPR)
        return Node("Return", value=value)

    def throw(self, _) -> Node:
        self.next()
        if self.new_line:
            self.stop("unexpected newline in throw statement")
        return Node("Throw", value=self.expression(EXPR))

    def try_statement(self, _) -> Node:
        self.next()
        body, binding, catch, last = self.block("try statement"), None, None, None
        if self.accept("catch"):
            scope = self.enter(False, "catch")
            if self.accept("("):
                binding = self.binding(CATCH)
                self.consume("try-catch statement", ")")
            catch = Node("Block", list=self.braced("try-catch statement"), scope=scope)
            self.leave()
        elif self.kind != "finally":
            self.fail("try statement", "catch", "finally")
        if self.accept("finally"):
            last = self.block("try-finally statement")
        return Node("Try", body=body, binding=binding, catch=catch, last=last)

    def debugger(self, _) -> Node:
        self.next()
        return Node("Debugger")

    def empty(self, _) -> Node:
        if self.kind == ";":
            self.next()
        return Node("Empty")

    # Modules

    def import_item(self) -> Node:
        """``import`` at the start of an item: a declaration, or an expression that begins with it."""
        self.next()
        if self.kind in ("(", "."):
            return self.import_statement()
        default = names = None
        if self.kind != "String":
            default, names = self.import_clause()
            self.consume("import statement", "from")
        module = self.module_name("import statement")
        self.accept(";")
        return Node("Import", default=default, names=names, module=module)

    def import_statement(self) -> Node:
        left, level = Node("Literal", type="import", data=b"import"), CALL
        if self.accept("."):
            self.consume("import.meta expression", "meta")
            left, level = Node("ImportMeta"), MEMBER
        self.depth_expr += 1
        node = Node("ExprStmt", value=self.suffix(left, EXPR, level))
        self.depth_expr -= 1
        if not self.new_line:
            self.accept(";")
        return node

    def module_name(self, where: str) -> bytes:
        if self.kind != "String":
            self.fail(where, "String")
        return self.take()

    def is_local(self) -> bool:
        """Whether a module can bind the name that comes next."""
        return self.kind in IDENTIFIERS or self.kind == "yield"

    def import_clause(self) -> tuple[bytes | None, list | None]:
        where, default = "import statement", None
        if self.is_local():
            default = self.take()
            if not self.accept(","):
                return default, None
        if self.accept("{"):
            return default, self.named(where, self.import_name)
        if self.kind != "*":
            self.fail(where, *(() if default is not None else ("String", "Identifier")), "*", "{")
        star = self.take()
        self.consume(where, "as")
        if not self.is_local():
            self.fail(where, "Identifier")
        return default, [(star, self.take())]

    def named(self, where: str, one) -> list[tuple[bytes | None, bytes | None]]:
        """What stands in braces after the opening one; a last comma leaves an empty entry."""
        found: list[tuple] = []
        while self.kind in NAMES or self.kind == "String":
            found.append(one(where))
            if self.accept(",") and self.kind == "}":
                found.append((None, None))
        self.consume(where, "}")
        return found

    def import_name(self, where: str) -> tuple[bytes | None, bytes]:
        local, name = self.is_local(), self.take()
        if not self.accept("as"):
            if not local:
                self.fail(where, "Identifier", "String")
            return None, name
        if not self.is_local():
            self.fail(where, "Identifier")
        return name, self.take()

    def export_name(self, where: str) -> tuple[bytes | None, bytes]:
        name = self.take()
        if not self.accept("as"):
            return None, name
        return name, self.any_name(where)

    def any_name(self, where: str) -> bytes:
        if self.kind not in NAMES and self.kind != "String":
            self.fail(where, "Identifier", "String")
        return self.take()

    def export(self) -> Node:
        where, names, module, decl = "export statement", None, None, None
        self.next()
        held = self.yield_, self.await_, self.default
        self.yield_, self.await_, self.default = False, True, True
        default = self.accept("default")
        if default:
            decl = self.default_export()
        elif self.accept("{"):
            names = self.named(where, self.export_name)
        elif self.kind == "*":
            star = self.take()
            names = [(star, self.any_name(where)) if self.accept("as") else (None, star)]
            if self.kind != "from":
                self.fail(where, "from")
        else:
            decl = self.exported(where)
        if names is not None and self.accept("from"):
            module = self.module_name(where)
        self.accept(";")
        self.yield_, self.await_, self.default = held
        return Node("Export", names=names, module=module, decl=decl, default=default)

    def exported(self, where: str) -> Node:
        """The declaration of an export."""
        kind = self.kind
        if kind in ("function", "class"):
            return self.class_(False) if kind == "class" else self.function(False, False)
        if kind not in ("var", "let", "const", "async"):
            self.fail(where, "*", "{", "var", "let", "const", "function", "async", "class", "default")
        self.next()
        if kind != "async":
            return self.var_decl(kind)
        if self.kind != "function" or self.new_line:
            self.fail(where, "function")
        return self.function(True, False)

    def default_export(self) -> Node | Name:
        if self.kind in ("function", "class"):
            return self.class_(False) if self.kind == "class" else self.function(False, False)
        if self.kind != "async":
            return self.expression(ASSIGN)
        word = self.take()
        if self.kind == "function" and not self.new_line:
            return self.function(True, False)
        return self.async_expression(ASSIGN, word)

    # Functions and classes

    def params(self, where: str) -> Node:
        self.consume(where, "(")
        found, rest = [], None
        while self.kind not in (")", "Error"):
            if self.accept("..."):
                rest = self.binding(ARGUMENT)
                self.consume(where, ")")
                return Node("Params", list=found, rest=rest)
            found.append(self.binding_element(ARGUMENT))
            if not self.accept(","):
                break
        if self.kind != ")":
            self.fail(where)
        self.next()
        self.scope.head_over("func_args")
        return Node("Params", list=found, rest=rest)

    def function_body(self, is_async: bool, generator: bool, where_params: str, where_body: str, prologue: bool = True, before=None) -> tuple[Node, Node]:
        scope = self.enter(True, "function")
        held = self.await_, self.yield_, self.returns
        self.await_, self.yield_, self.returns = is_async, generator, True
        if before:
            before()
        params = self.params(where_params)
        outer = self.prologue
        if prologue:
            self.prologue = True
        body = Node("Block", list=self.braced(where_body), scope=scope)
        self.prologue = outer if prologue else self.prologue
        self.await_, self.yield_, self.returns = held
        self.leave()
        return params, body

    def function(self, is_async: bool, expression: bool) -> Node:
        where = "function declaration"
        self.next()
        generator, name, v = self.accept("*"), None, None
        if expression and (self.kind in IDENTIFIERS or self.kind in ("yield", "await")) or not expression and self.is_reference(self.kind):
            name = self.text
            if not expression:
                v = self.declare(FUNCTION, name)
            self.next()
        elif not expression and not self.default:
            self.fail(where, "Identifier")
        elif self.kind != "(":
            self.fail(where, "Identifier", "(")
        own: list[Name] = []
        before = (lambda: own.append(self.scope.declare(EXPRESSION, name))) if expression and name is not None else None
        params, body = self.function_body(is_async, generator, where, where, before=before)
        return Node("Function", is_async=is_async, generator=generator, name=own[0] if own else v, params=params, body=body)

    def class_(self, expression: bool) -> Node:
        where = "class declaration"
        self.next()
        name = extends = None
        if self.kind in IDENTIFIERS or self.kind in ("yield", "await"):
            name = Name(self.text, Variable(self.text, EXPRESSION, 1)) if expression else self.declare(LEXICAL, self.text)
            self.next()
        elif not expression and not self.default:
            self.fail(where, "Identifier")
        if self.accept("extends"):
            extends = self.expression(LHS)
        self.consume(where, "{")
        scope, elements = self.enter(False, "class"), []
        while not self.accept("}"):
            if self.kind == "Error":
                self.fail(where)
            if not self.accept(";"):
                elements.append(self.class_element())
        self.leave()
        return Node("Class", name=name, extends=extends, list=elements, scope=scope)

    def modifiers(self, words: tuple[str, ...], ends: frozenset) -> tuple[dict[str, bool], Node | None]:
        """The modifiers before the name of a member, and the name if a word that could be one turns out to be it:
        because what comes next (one of ``ends``) can't begin a name, or a line ends after ``async``."""
        marks = dict.fromkeys(("static", "is_async", "generator", "get", "set"), False)
        while self.kind in words:
            mark, words = MODIFIERS[self.kind]
            word = self.take()
            if self.kind in ends or mark == "is_async" and self.new_line:
                return marks, Node("Literal", type="Identifier", data=word)
            marks[mark] = True
        if not marks["get"] and not marks["set"]:
            marks["generator"] = self.accept("*")
        return marks, None

    def class_element(self) -> Node:
        marks, name = self.modifiers(("static", "async", "get", "set"), MEMBER_ENDS)
        if marks["static"] and name is None and self.kind == "{":
            return self.static_block()
        plain = not (marks["is_async"] or marks["generator"] or marks["get"] or marks["set"])
        if name is None and self.kind == "PrivateIdentifier":
            name = self.declare(PRIVATE, self.text)
            self.next()
        elif name is None:
            name = self.property_name("method or field definition")
        if plain and self.kind != "(":
            return Node("Field", static=marks["static"], name=name, init=self.expression(ASSIGN) if self.accept("=") else None)
        params, body = self.function_body(marks["is_async"], marks["generator"], "method definition", "method function")
        return Node("Method", name=name, params=params, body=body, **marks)

    def static_block(self) -> Node:
        held = self.yield_, self.await_, self.returns
        self.yield_, self.await_, self.returns = False, True, False
        block = self.block("class static block")
        self.yield_, self.await_, self.returns = held
        return Node("Static", block=block)

    def property_name(self, where: str) -> Node:
        if self.kind in NAMES:
            return Node("Literal", type="Identifier", data=self.take())
        if self.kind == "String":
            text = self.take()
            inner = text[1:-1]
            if NAME_KEY.fullmatch(inner):
                return Node("Literal", type="Identifier", data=inner)
            if DECIMAL_KEY.fullmatch(inner):
                return Node("Literal", type="Decimal", data=inner)
            return Node("Literal", type="String", data=text)
        if self.kind in NUMBERS:
            kind = self.kind
            return Node("Literal", type=kind, data=self.take())
        if self.accept("["):
            value = self.expression(ASSIGN)
            self.consume(where, "]")
            return Node("Computed", x=value)
        self.fail(where, "Identifier", "String", "Numeric", "[")

    # Bindings

    def binding(self, decl: int) -> Node | Name:
        """BindingIdentifier or BindingPattern."""
        if self.is_reference(self.kind):
            found = self.declare(decl, self.text)
            self.next()
            return found
        pattern = {"[": self.array_binding, "{": self.object_binding}.get(self.kind)
        if pattern is None:
            self.fail("binding")
        self.next()
        return pattern(decl)

    def with_default(self, binding: Node | Name) -> Node:
        return Node("BindingElement", binding=binding, default=self.expression(ASSIGN) if self.accept("=") else None)

    def binding_element(self, decl: int) -> Node:
        return self.with_default(self.binding(decl))

    def array_binding(self, decl: int) -> Node:
        """Elements and a rest between commas; a comma where an element could stand is a hole, and holes that no
        element follows don't count."""
        where = "array binding pattern"
        found, rest, holes = [], None, 0
        while self.kind != "]":
            if self.accept(","):
                holes += 1
                continue
            found += [Node("BindingElement", binding=None, default=None) for _ in range(holes)]
            holes = 0
            if self.accept("..."):
                rest = self.binding(decl)
                if self.kind != "]":
                    self.fail(where, "]")
            else:
                found.append(self.binding_element(decl))
                if self.kind != "]" and not self.accept(","):
                    self.fail(where, ",", "]")
        self.next()
        return Node("BindingArray", list=found, rest=rest)

    def object_binding(self, decl: int) -> Node:
        where = "object binding pattern"
        found, rest = [], None
        while self.kind != "}":
            if rest is not None:
                self.fail(where, "}")
            if self.accept("..."):
                if not self.is_reference(self.kind):
                    self.fail(where, "Identifier")
                rest = self.binding(decl)
                continue
            found.append(self.binding_property(decl, where))
            if self.kind != "}" and not self.accept(","):
                self.fail(where, ",", "}")
        self.next()
        return Node("BindingObject", list=found, rest=rest)

    def binding_property(self, decl: int, where: str) -> Node:
        """``key: element``, or a name that is both key and binding."""
        short = self.text if self.is_reference(self.kind) else None
        key = self.property_name(where)
        if short is not None and self.kind != ":":
            value = self.with_default(self.declare(decl, short))
        else:
            self.consume(where, ":")
            value = self.binding_element(decl)
        return Node("BindingItem", key=key, value=value)

    # Expressions

    def with_in(self, rule, *arguments):
        held, self.allow_in = self.allow_in, True
        found = rule(*arguments)
        self.allow_in = held
        return found

    def expression(self, level: int) -> Node | Name:
        self.depth_expr += 1
        if self.depth_expr > LIMIT:
            self.stop("too many nested expressions")
        if self.kind in ("/", "/="):
            self.kind, self.text = self.lexer.regexp()
            if self.kind == "Error":
                self.fail("regular expression")
        kind = self.kind
        left_level = PRIMARY
        if kind in IDENTIFIERS and kind != "async":
            left = self.scope.use(self.take())
        elif kind in NUMBERS or kind in LITERALS:
            left = Node("Literal", type=kind, data=self.take())
        elif kind == "(" and level <= ASSIGN:
            found = self.parenthesized(level, None)
            self.depth_expr -= 1
            return found
        elif kind in PREFIX:
            if PREFIX[kind] < level:
                self.fail("expression")
            self.next()
            left, left_level = Node("Unary", op=kind, x=self.expression(UNARY), postfix=False), UNARY
        elif start := EXPRESSIONS.get(kind):
            left, left_level = start(self, level)
        else:
            self.fail("expression")
        found = self.suffix(left, level, left_level)
        self.depth_expr -= 1
        return found

    def array(self, _) -> tuple[Node, int]:
        return self.with_in(self.array_literal), PRIMARY

    def object(self, _) -> tuple[Node, int]:
        return self.with_in(self.object_literal), PRIMARY

    def group(self, _) -> tuple[Node, int]:
        self.next()
        inner = self.with_in(self.expression, EXPR)
        self.consume("expression", ")")
        return Node("Group", x=inner), PRIMARY

    def await_expression(self, level: int) -> tuple[Node | Name, int]:
        if not self.await_:
            return self.scope.use(self.take()), PRIMARY
        if level > UNARY:
            self.fail("expression")
        self.next()
        return Node("Unary", op="await", x=self.expression(UNARY), postfix=False), UNARY

    def new(self, _) -> tuple[Node, int]:
        self.next()
        if self.accept("."):
            self.consume("new.target expression", "target")
            return Node("NewTarget"), MEMBER
        x = self.expression(NEW)
        if self.kind == "(":
            args = self.arguments()
            return Node("New", x=x, args=args or None), MEMBER
        return Node("New", x=x, args=None), NEW

    def import_expression(self, level: int) -> tuple[Node, int]:
        literal = Node("Literal", type="import", data=self.take())
        if self.accept("."):
            self.consume("import.meta expression", "meta")
            return Node("ImportMeta"), MEMBER
        if self.kind != "(":
            self.fail("import expression", "(")
        if level > CALL:
            self.fail("expression")
        return literal, CALL

    def super_expression(self, level: int) -> tuple[Node, int]:
        literal = Node("Literal", type="super", data=self.take())
        if level > CALL and self.kind not in (".", "["):
            self.fail("super expression", "[", ".")
        if self.kind not in (".", "[", "("):
            self.fail("super expression", "[", "(", ".")
        return literal, MEMBER if level > CALL else CALL

    def yield_expression(self, level: int) -> tuple[Node | Name, int]:
        if not self.yield_:
            return self.scope.use(self.take()), PRIMARY
        if level > ASSIGN:
            self.fail("expression")
        self.next()
        generator, x = False, None
        if not self.new_line:
            generator = self.accept("*")
            if generator or self.kind not in ("}", "]", ")", ":", ",", ";"):
                x = self.expression(ASSIGN)
        return Node("Yield", generator=generator, x=x), ASSIGN

    def async_start(self, level: int) -> tuple[Node | Name, int]:
        return self.with_in(self.async_expression, level, self.take()), PRIMARY

    def class_start(self, _) -> tuple[Node, int]:
        return self.with_in(self.class_, True), PRIMARY

    def function_start(self, _) -> tuple[Node, int]:
        return self.with_in(self.function, False, True), PRIMARY

    def template_start(self, _) -> tuple[Node, int]:
        return self.with_in(self.template, None, False), PRIMARY

    def private_in(self, level: int) -> tuple[Name, int]:
        if level > COMPARE or not self.allow_in:
            self.fail("expression")
        v = self.scope.use(self.take())
        if self.kind != "in":
            self.fail("relational expression", "in")
        return v, PRIMARY

    def template(self, tag, optional: bool) -> Node:
        parts = []
        while self.kind in ("TemplateStart", "TemplateMiddle"):
            text = self.take()
            parts.append((text, self.expression(EXPR)))
        if self.kind not in ("Template", "TemplateEnd"):
            self.fail("template literal", "Template")
        return Node("TemplateLiteral", tag=tag, list=parts, tail=self.take(), optional=optional)

    def arguments(self) -> list[tuple[bool, Node]]:
        self.next()
        found = []
        while self.kind not in (")", "Error"):
            spread = self.accept("...")
            found.append((spread, self.expression(ASSIGN)))
            if self.kind != ")" and not self.accept(","):
                self.fail("arguments", ",", ")")
        self.consume("arguments", ")")
        return found

    def suffix(self, left, level: int, left_level: int):
        """Everything that follows a left side of ``left_level`` and binds at least as ``level``."""
        n = 0
        while True:
            if self.depth_expr + n > LIMIT:
                self.stop("too many nested expressions")
            n += 1
            kind = self.kind
            if rule := BINARY.get(kind):
                own, least, right = rule
                if own < level or kind == "in" and not self.allow_in:
                    return left
                if left_level < least and not (kind == "??" and left_level == COALESCE):
                    self.fail("expression")
                self.next()
                left, left_level = Node("Binary", op=kind, x=left, y=self.expression(right)), own
            elif kind in (".", "[", "(", "Template", "TemplateStart", "?."):
                own = {"(": CALL, "?.": OPT}.get(kind, MEMBER)
                if own != MEMBER and own < level:
                    return left
                if left_level < LHS:
                    self.fail("expression")
                if kind == "?.":
                    left, left_level = self.optional(left), OPT
                    continue
                left_level = min(left_level, own)
                left = self.access(left)
            elif kind in ("++", "--"):
                if self.new_line or UPDATE < level:
                    return left
                if left_level < LHS:
                    self.fail("expression")
                self.next()
                left, left_level = Node("Unary", op=kind, x=left, postfix=True), UPDATE
            elif kind == "?":
                if ASSIGN < level:
                    return left
                if left_level < COALESCE:
                    self.fail("expression")
                self.next()
                yes = self.with_in(self.expression, ASSIGN)
                self.consume("conditional expression", ":")
                left, left_level = Node("Cond", cond=left, x=yes, y=self.expression(ASSIGN)), ASSIGN
            elif kind == ",":
                if EXPR < level:
                    return left
                self.next()
                if not isinstance(left, Name) and left.kind == "Comma":
                    left.list.append(self.expression(ASSIGN))
                    n -= 1
                else:
                    left = Node("Comma", list=[left, self.expression(ASSIGN)])
                left_level = EXPR
            elif kind == "=>":
                if ASSIGN < level:
                    return left
                if left_level < PRIMARY or self.new_line or not isinstance(left, Name):
                    self.fail("expression")
                left, left_level = self.identifier_arrow(left), ASSIGN
            else:
                return left

    def access(self, x) -> Node:
        kind = self.kind
        if kind == "(":
            return Node("CallExpr", x=x, args=self.with_in(self.arguments), optional=False)
        if kind in ("Template", "TemplateStart"):
            return self.with_in(self.template, x, False)
        self.next()
        if kind == "[":
            y = self.with_in(self.expression, EXPR)
            self.consume("index expression", "]")
            return Node("Index", x=x, y=y, optional=False)
        if self.kind not in NAMES and self.kind != "PrivateIdentifier":
            self.fail("dot expression", "Identifier")
        return Node("Dot", x=x, y=self.member_name(), optional=False)

    def member_name(self):
        if self.kind == "PrivateIdentifier":
            return self.scope.use(self.take())
        return Node("Literal", type="Identifier", data=self.take())

    def optional(self, x) -> Node:
        where = "optional chaining expression"
        self.next()
        if self.kind == "(":
            return Node("CallExpr", x=x, args=self.arguments(), optional=True)
        if self.accept("["):
            y = self.expression(EXPR)
            self.consume(where, "]")
            return Node("Index", x=x, y=y, optional=True)
        if self.kind in ("Template", "TemplateStart"):
            return self.template(x, True)
        if self.kind not in NAMES and self.kind != "PrivateIdentifier":
            self.fail(where, "Identifier", "(", "[", "Template")
        return Node("Dot", x=x, y=self.member_name(), optional=True)

    # Array and object literals, which may turn out to be parameters of an arrow function

    def element(self):
        """An assignment expression; while parameters are possible, a plain name is declared as one."""
        if self.maybe_arrow and self.is_reference(self.kind):
            kind, name = self.kind, self.take()
            if self.kind in ("=", ",", ")", "}", "]"):
                v = self.scope.declare(ARGUMENT, name)
                if v:
                    self.maybe_arrow = False
                    found = self.suffix(v, ASSIGN, PRIMARY)
                    self.maybe_arrow = True
                    return found
            self.maybe_arrow = False
            if kind == "async":
                return self.async_expression(ASSIGN, name)
            return self.suffix(self.scope.use(name), ASSIGN, PRIMARY)
        if self.kind not in ("[", "{"):
            self.maybe_arrow = False
        return self.expression(ASSIGN)

    def array_literal(self) -> Node:
        self.next()
        found, comma = [], True
        while not self.accept("]"):
            if self.kind == "Error":
                self.fail("expression")
            if self.accept(","):
                if comma:
                    found.append((False, None))
                comma = True
                continue
            spread = self.accept("...")
            found.append((spread, self.element()))
            comma = False
            if spread and self.kind != "]":
                self.maybe_arrow = False
        return Node("Array", list=found)

    def object_literal(self) -> Node:
        where = "object literal"
        self.next()
        found = []
        while not self.accept("}"):
            if self.kind == "Error":
                self.fail(where, "}")
            found.append(self.property(where))
            if not self.accept(",") and self.kind != "}":
                self.fail(where)
        return Node("Object", list=found)

    def property(self, where: str) -> Node:
        if self.accept("..."):
            value = self.element()
            if not isinstance(value, Name) or self.kind != "}":
                self.maybe_arrow = False
            return Node("Property", name=None, spread=True, value=value, init=None)
        marks, name = self.modifiers(("async", "get", "set"), PROPERTY_ENDS)
        if name is None:
            name = self.property_name(where)
        if self.kind == "(":
            self.maybe_arrow = False
            params, body = self.function_body(marks["is_async"], marks["generator"], "method definition", "method definition", prologue=False)
            return Node("Property", name=None, spread=False, value=Node("Method", name=name, params=params, body=body, **marks), init=None)
        if self.accept(":"):
            return Node("Property", name=name, spread=False, value=self.element(), init=None)
        if name.kind == "Computed" or not self.is_reference(name.type):
            self.fail(where, ":", "(")
        if self.maybe_arrow:
            value = self.scope.declare(ARGUMENT, name.data)
            if value is None:
                value = self.scope.use(name.data)
                self.maybe_arrow = False
        else:
            value = self.scope.use(name.data)
        init = None
        if self.accept("="):
            held, self.maybe_arrow = self.maybe_arrow, False
            init = self.expression(ASSIGN)
            self.maybe_arrow = held
        return Node("Property", name=name, spread=False, value=value, init=init)

    # Arrow functions

    def async_expression(self, level: int, word: bytes):
        left_level = PRIMARY
        if not self.new_line and self.kind == "function":
            left = self.function(True, True)
        elif not self.new_line and level <= ASSIGN and (self.kind in IDENTIFIERS or self.kind in ("(", "yield", "await")):
            if self.kind == "await" or self.yield_ and self.kind == "yield":
                self.fail("arrow function")
            if self.kind == "(":
                return self.parenthesized(level, word)
            left, left_level = self.async_arrow(), ASSIGN
        else:
            left = self.scope.use(word)
        return self.suffix(left, level, left_level)

    def async_arrow(self) -> Node:
        scope = self.enter(True, "arrow")
        held = self.await_, self.yield_
        yielding = self.yield_
        self.await_, self.yield_ = True, False
        if self.kind in IDENTIFIERS or not yielding and self.kind == "yield":
            v = self.scope.declare(ARGUMENT, self.take())
            params = Node("Params", list=[Node("BindingElement", binding=v, default=None)], rest=None)
        else:
            params = self.params("arrow function")
        body = self.arrow_body(scope)
        self.await_, self.yield_ = held
        self.leave()
        return Node("Arrow", is_async=True, params=params, body=body)

    def identifier_arrow(self, used: Name) -> Node:
        self.scope.withdraw(used)
        scope = self.enter(True, "arrow")
        parameter = Node("BindingElement", binding=self.scope.declare(ARGUMENT, used.name), default=None)
        held, self.await_, self.yield_ = (self.await_, self.yield_), False, False
        body = self.arrow_body(scope)
        self.await_, self.yield_ = held
        self.leave()
        return Node("Arrow", is_async=False, params=Node("Params", list=[parameter], rest=None), body=body)

    def arrow_body(self, scope: Scope) -> Node:
        if self.kind != "=>":
            self.fail("arrow function", "=>")
        if self.new_line:
            self.fail("expression")
        self.next()
        self.scope.head_over("func_args")
        if self.kind == "{":
            held, outer = (self.allow_in, self.returns), self.prologue
            self.allow_in = self.returns = self.prologue = True
            body = self.braced("arrow function")
            (self.allow_in, self.returns), self.prologue = held, outer
        else:
            body = [Node("Return", value=self.expression(ASSIGN))]
        return Node("Block", list=body, scope=scope)

    def parenthesized(self, level: int, word: bytes | None):
        """A group, the arguments of a call to ``async``, or the parameters of an arrow function."""
        self.next()
        scope, is_async = self.enter(True, "arrow"), word is not None
        held = self.maybe_arrow, self.allow_in
        self.maybe_arrow = self.allow_in = True
        args: list[tuple[bool, Node]] = []
        while self.kind not in (")", "Error"):
            if args and args[-1][0]:
                self.maybe_arrow = False
                if not is_async:
                    self.fail("arrow function", ")")
            spread = self.accept("...")
            args.append((spread, self.element()))
            if not self.accept(","):
                break
        if self.kind != ")":
            self.fail("expression")
        self.next()
        arrow = not self.new_line and self.kind == "=>" and self.maybe_arrow
        spreads = any(s for s, _ in args)
        last_rest = spreads and self.maybe_arrow
        self.maybe_arrow, self.allow_in = held
        if arrow:
            outer = self.await_, self.yield_
            self.await_, self.yield_ = is_async, False
            plain = [self.as_element(x) for s, x in args if not s]
            rest = next((self.as_binding(x) for s, x in args if s), None)
            body = self.arrow_body(scope)
            self.await_, self.yield_ = outer
            self.leave()
            left, left_level = Node("Arrow", is_async=is_async, params=Node("Params", list=plain, rest=rest), body=body), ASSIGN
        elif not is_async and (not args or last_rest):
            self.fail("arrow function", "=>")
        elif is_async and CALL < level or not is_async and spreads:
            self.fail("expression")
        else:
            scope.given_up = True
            self.leave()
            if is_async:
                left, left_level = Node("CallExpr", x=self.scope.use(word), args=args, optional=False), CALL
            else:
                inner = Node("Comma", list=[x for _, x in args]) if len(args) > 1 else args[0][1]
                left, left_level = Node("Group", x=inner), PRIMARY
        return self.suffix(left, level, left_level)

    def as_element(self, x) -> Node:
        if not isinstance(x, Name) and x is not None and x.kind == "Binary" and x.op == "=":
            return Node("BindingElement", binding=self.as_binding(x.x), default=x.y)
        return Node("BindingElement", binding=self.as_binding(x), default=None)

    def as_binding(self, x):
        if x is None or isinstance(x, Name):
            return x
        if x.kind == "Array":
            rest = next((self.as_binding(v) for s, v in x.list if s), None)
            plain = []
            for spread, v in x.list:
                if spread:
                    break
                plain.append(self.as_element(v))
            return Node("BindingArray", list=plain, rest=rest)
        if x.kind == "Object":
            items, rest = [], None
            for p in x.list:
                if p.spread:
                    rest = p.value
                    break
                value = self.as_element(p.value)
                if p.name is None or isinstance(p.value, Name) and p.name.kind == "Literal" and p.name.data == p.value.name:
                    value.f["default"] = p.init
                items.append(Node("BindingItem", key=p.name, value=value))
            return Node("BindingObject", list=items, rest=rest)
        self.stop("invalid parameters in arrow function")


#: Modifier word -> (its mark, the words that may follow it).
MODIFIERS = {"static": ("static", ("async", "get", "set")), "async": ("is_async", ()), "get": ("get", ()), "set": ("set", ())}
MEMBER_ENDS, PROPERTY_ENDS = frozenset("( = ; }".split()), frozenset("= , } : (".split())

#: Kinds that can't stand left of in and of.
VALUES = frozenset(("Comma", "Cond", "Yield", "Arrow", "Binary", "Unary"))
P = Reader
STATEMENTS = {
    "{": P.block_statement, "var": P.variables, "const": P.variables, "let": P.let, "if": P.if_statement, "continue": P.branch, "break": P.branch, "with": P.with_statement,
    "do": P.do_while, "while": P.while_statement, "for": P.for_statement, "switch": P.switch, "function": P.function_statement, "async": P.async_statement, "class": P.class_statement,
    "throw": P.throw, "try": P.try_statement, "debugger": P.debugger, ";": P.empty, "Error": P.empty,
}
EXPRESSIONS = {
    "[": P.array, "{": P.object, "(": P.group, "await": P.await_expression, "new": P.new, "import": P.import_expression, "super": P.super_expression, "yield": P.yield_expression,
    "async": P.async_start, "class": P.class_start, "function": P.function_start, "Template": P.template_start, "TemplateStart": P.template_start, "PrivateIdentifier": P.private_in,
}


def read(data: bytes, inline: bool = False, while_to_for: bool = False) -> tuple[Reader, Node | None, tuple | None]:
    """(reader with its scopes, tree or None, error or None)."""
    reader = Reader(data, inline, while_to_for)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 60_000))
    try:
        tree = reader.program()
    except Failed as e:
        return reader, None, error(data, reader.lexer.at - len(reader.text), str(e))
    finally:
        sys.setrecursionlimit(limit)
    return (reader, None, reader.lexer.wrong) if reader.lexer.wrong else (reader, tree, None)
