"""Syntax trees as symbolic expressions and as rows of nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from .js import NAMES
from .js_syntax import Node
from .js_scope import KINDS, Name


def text(b: bytes) -> str:
    return b.decode("utf-8", "replace")


def sexpr(n) -> str:
    """Statements as Stmt(...), declarations as Decl(...), bindings as Binding(...), operations in parentheses."""
    if isinstance(n, Name):
        return text(n.name)
    return WRITERS[n.kind](n)


def spaced(parts) -> str:
    return "".join(" " + sexpr(x) for x in parts)


def expr_stmt(n: Node) -> str:
    inner = sexpr(n.value)
    return f"Stmt{inner}" if inner.startswith("(") and inner.endswith(")") else f"Stmt({inner})"


def for_(n: Node) -> str:
    init = "" if n.init.kind == "VarDecl" and not n.init.list else " " + sexpr(n.init)
    cond = " " + sexpr(n.cond) if n.cond is not None else ""
    post = " " + sexpr(n.post) if n.post is not None else ""
    return f"Stmt(for{init} ;{cond} ;{post} {sexpr(n.body)})"


def try_(n: Node) -> str:
    out = f"Stmt(try {sexpr(n.body)}"
    if n.catch is not None:
        out += " catch" + (f" Binding({sexpr(n.binding)})" if n.binding is not None else "") + " " + sexpr(n.catch)
    return out + (f" finally {sexpr(n.last)}" if n.last is not None else "") + ")"


def alias(pair: tuple) -> str:
    name, bound = pair
    return "" if bound is None else " " + (text(name) + " as " if name is not None else "") + text(bound)


def names(pairs: list, star: bool) -> str:
    return alias(pairs[0]) if star else " {" + " ,".join(map(alias, pairs)) + " }"


def import_(n: Node) -> str:
    out = "Stmt(import" + (" " + text(n.default) if n.default is not None else "")
    if n.names is not None:
        out += (" ," if n.default is not None else "") + names(n.names, len(n.names) == 1 and n.names[0][0] == b"*")
    return out + (" from" if n.default is not None or n.names is not None else "") + f" {text(n.module)})"


def export(n: Node) -> str:
    if n.decl is not None:
        return f"Stmt(export{' default' if n.default else ''} {sexpr(n.decl)})"
    out = "Stmt(export"
    if n.names:
        out += names(n.names, len(n.names) == 1 and (n.names[0][0] == b"*" or n.names[0] == (None, b"*")))
    return out + (f" from {text(n.module)}" if n.module is not None else "") + ")"


def rest_of(n: Node) -> str:
    return f"...Binding({sexpr(n.rest)})"


def params(n: Node) -> str:
    return "Params(" + ", ".join([sexpr(x) for x in n.list] + ([rest_of(n)] if n.rest is not None else [])) + ")"


def binding_element(n: Node) -> str:
    if n.binding is None:
        return "Binding()"
    return f"Binding({sexpr(n.binding)}{' = ' + sexpr(n.default) if n.default is not None else ''})"


def binding_array(n: Node) -> str:
    parts = [" " + sexpr(x) for x in n.list]
    if n.rest is not None:
        parts.append(" " + rest_of(n))
        tail = ""
    else:
        tail = "," if n.list and n.list[-1].binding is None else ""
    return "[" + ",".join(parts) + tail + " ]"


def same_name(key, value) -> bool:
    return isinstance(value, Name) and key.kind == "Literal" and key.type == "Identifier" and key.data == value.name


def binding_item(n: Node) -> str:
    key = "" if n.key is None or same_name(n.key, n.value.binding) else f" {sexpr(n.key)}:"
    return f"{key} {sexpr(n.value)}"


def binding_object(n: Node) -> str:
    return "{" + ",".join([sexpr(x) for x in n.list] + ([" " + rest_of(n)] if n.rest is not None else [])) + " }"


def function(n: Node) -> str:
    name = " " + text(n.name.name) if n.name is not None else ""
    return f"Decl({'async ' if n.is_async else ''}function{'*' if n.generator else ''}{name} {sexpr(n.params)} {sexpr(n.body)})"


def method(n: Node) -> str:
    marks = "".join(word + " " for word, on in (("static", n.static), ("async", n.is_async), ("*", n.generator), ("get", n.get), ("set", n.set)) if on)
    return f"Method({marks}{sexpr(n.name)} {sexpr(n.params)} {sexpr(n.body)})"


def class_(n: Node) -> str:
    name = " " + text(n.name.name) if n.name is not None else ""
    return f"Decl(class{name}{' extends ' + sexpr(n.extends) if n.extends is not None else ''}{spaced(n.list)})"


def computed(n: Node) -> str:
    inner = sexpr(n.x)
    return f"[{inner[1:-1]}]" if inner.startswith("(") else f"[{inner}]"


def spread(pair: tuple) -> str:
    return "" if pair[1] is None else ("..." if pair[0] else "") + sexpr(pair[1])


def array(n: Node) -> str:
    return "[" + ", ".join(map(spread, n.list)) + ("," if n.list and n.list[-1][1] is None else "") + "]"


def property_(n: Node) -> str:
    key = "..." if n.spread else "" if n.name is None or same_name(n.name, n.value) else sexpr(n.name) + ": "
    return key + sexpr(n.value) + (" = " + sexpr(n.init) if n.init is not None else "")


def template(n: Node) -> str:
    tag = "" if n.tag is None else sexpr(n.tag) + ("?." if n.optional else "")
    return tag + "".join(text(t) + sexpr(x) for t, x in n.list) + text(n.tail)


def arguments(pairs: list) -> str:
    return "(" + ", ".join(map(spread, pairs)) + ")"


def unary(n: Node) -> str:
    if n.postfix:
        return f"({sexpr(n.x)}{n.op})"
    return f"({n.op}{' ' if n.op in NAMES else ''}{sexpr(n.x)})"


def binary(n: Node) -> str:
    gap = " " if n.op in NAMES else ""
    return f"({sexpr(n.x)}{gap}{n.op}{gap}{sexpr(n.y)})"


WRITERS: dict[str, Callable[[Node], str]] = {
    "Comment": lambda n: f"Stmt({text(n.value)})", "Block": lambda n: "Stmt({" + spaced(n.list) + " })", "Empty": lambda n: "Stmt()", "ExprStmt": expr_stmt,
    "If": lambda n: f"Stmt(if {sexpr(n.cond)} {sexpr(n.body)}{' else ' + sexpr(n.otherwise) if n.otherwise is not None else ''})",
    "DoWhile": lambda n: f"Stmt(do {sexpr(n.body)} while {sexpr(n.cond)})", "While": lambda n: f"Stmt(while {sexpr(n.cond)} {sexpr(n.body)})", "For": for_,
    "ForIn": lambda n: f"Stmt(for {sexpr(n.init)} in {sexpr(n.value)} {sexpr(n.body)})", "ForOf": lambda n: f"Stmt(for{' await' if n.awaits else ''} {sexpr(n.init)} of {sexpr(n.value)} {sexpr(n.body)})",
    "Clause": lambda n: f"Clause({n.type}{' ' + sexpr(n.cond) if n.cond is not None else ''}{spaced(n.list)})", "Switch": lambda n: f"Stmt(switch {sexpr(n.init)}{spaced(n.list)})",
    "Branch": lambda n: f"Stmt({n.type}{' ' + text(n.label) if n.label is not None else ''})", "Return": lambda n: f"Stmt(return{' ' + sexpr(n.value) if n.value is not None else ''})",
    "With": lambda n: f"Stmt(with {sexpr(n.cond)} {sexpr(n.body)})", "Labelled": lambda n: f"Stmt({text(n.label)} : {sexpr(n.value)})", "Throw": lambda n: f"Stmt(throw {sexpr(n.value)})",
    "Try": try_, "Debugger": lambda n: "Stmt(debugger)", "Import": import_, "Export": export, "Directive": lambda n: f"Stmt({text(n.value)})",
    "VarDecl": lambda n: f"Decl({n.type}{spaced(n.list)})", "BindingElement": binding_element, "BindingArray": binding_array, "BindingItem": binding_item, "BindingObject": binding_object,
    "Params": params, "Function": function, "Method": method, "Field": lambda n: f"Field({'static ' if n.static else ''}{sexpr(n.name)}{' = ' + sexpr(n.init) if n.init is not None else ''})",
    "Static": lambda n: f"Static({sexpr(n.block)})", "Class": class_, "Computed": computed, "Literal": lambda n: text(n.data), "Array": array, "Property": property_,
    "Object": lambda n: "{" + ", ".join(map(sexpr, n.list)) + "}", "TemplateLiteral": template, "Group": lambda n: f"({sexpr(n.x)})",
    "Index": lambda n: f"({sexpr(n.x)}{'?.' if n.optional else ''}[{sexpr(n.y)}])", "Dot": lambda n: f"({sexpr(n.x)}{'?.' if n.optional else '.'}{sexpr(n.y)})",
    "NewTarget": lambda n: "(new.target)", "ImportMeta": lambda n: "(import.meta)", "New": lambda n: f"(new {sexpr(n.x)}{arguments(n.args) if n.args else ''})",
    "CallExpr": lambda n: f"({sexpr(n.x)}{'?.' if n.optional else ''}{arguments(n.args)})", "Unary": unary, "Binary": binary,
    "Cond": lambda n: f"({sexpr(n.cond)} ? {sexpr(n.x)} : {sexpr(n.y)})", "Yield": lambda n: "(yield)" if n.x is None else f"(yield{'*' if n.generator else ''} {sexpr(n.x)})",
    "Arrow": lambda n: f"({'async ' if n.is_async else ''}{sexpr(n.params)} => {sexpr(n.body)})", "Comma": lambda n: "(" + ",".join(map(sexpr, n.list)) + ")",
}


def program(tree: Node) -> str:
    return " ".join(map(sexpr, tree.list))


FLAGS = {"is_async": "async", "generator": "generator", "static": "static", "get": "get", "set": "set", "optional": "optional", "postfix": "postfix", "spread": "spread", "awaits": "await"}


def nodes(tree: Node, reader=None) -> Iterator[tuple]:
    """(node_id, parent_id, field, ordinal, kind, op, data, flags, depth, exit_id, scope_id) in order of entering;
    exit_id is the largest id inside, so descendants are a range of ids."""
    rows: list[list] = []
    number = {id(s): k for k, s in enumerate(reader.scopes)} if reader else {}

    def visit(n, parent: int | None, field: str, ordinal: int, depth: int, scope: int | None) -> None:
        at = len(rows)
        if isinstance(n, Name):
            rows.append([at, parent, field, ordinal, "Var", KINDS[n.decl], text(n.name), [], depth, at, scope])
            return
        data = next((text(n.f[k]) for k in ("data", "value", "label", "module", "tail", "default") if isinstance(n.f.get(k), bytes)), None)
        flags = [shown for name, shown in FLAGS.items() if n.f.get(name) is True]
        flags += ["computed"] * (n.kind == "Computed") + ["default"] * (n.kind == "Export" and n.default)
        inner = n.f.get("scope")
        if inner is None and isinstance(body := n.f.get("body"), Node) and n.kind in ("Function", "Method", "Arrow", "For", "ForIn", "ForOf"):
            inner = body.f.get("scope")  # parameters and heads stand in the scope of the body
        within = number.get(id(inner), scope)
        rows.append([at, parent, field, ordinal, n.kind, n.f.get("op") or n.f.get("type"), data, flags, depth, at, scope])
        for k, (was, bound) in enumerate(n.f.get("names") or ()):
            if bound is not None:
                rows.append([len(rows), at, "names", k, "Alias", None if was is None else text(was), text(bound), [], depth + 1, len(rows), within])
        for name, value in n.f.items():
            many = value if isinstance(value, list) else [value]
            for k, x in enumerate(many):
                if isinstance(x, tuple):
                    x = next((y for y in x if isinstance(y, (Node, Name))), None)
                if isinstance(x, (Node, Name)):
                    visit(x, at, name, k, depth + 1, within)
        rows[at][9] = len(rows) - 1

    visit(tree, None, "program", 0, 0, None)
    yield from map(tuple, rows)


def scopes(reader) -> tuple[list[tuple], list[tuple]]:
    """Rows of scopes (scope_id, parent_id, func_id, what, has_with, n_for_decls, n_func_args, n_arg_uses) and of
    variables (scope_id, ordinal, bound, var_id, name, decl, uses, links)."""
    number = {id(s): k for k, s in enumerate(reader.scopes)}
    scope_rows, var_rows = [], []
    var_ids: dict[int, int] = {}
    for k, s in enumerate(reader.scopes):
        scope_rows.append((k, number.get(id(s.around())), number.get(id(s.around(function=True))), s.what, s.has_with, *(s.counts[c] for c in ("for_decls", "func_args", "arg_uses"))))
        for bound, held in ((True, s.bound), (False, s.free)):
            for i, v in enumerate(held):
                seen, (end, links) = v.itself(), v.chain()
                var_rows.append((k, i, bound, var_ids.setdefault(id(end), len(var_ids)), text(v.name), KINDS[seen.decl], seen.uses, links))
    return scope_rows, var_rows
