"""Syntax trees back as JavaScript text, and expression trees as JSON.

Structural line breaks are a private sign until the end, so that only they are indented and not those inside
strings, templates and comments.
"""

from __future__ import annotations

from collections.abc import Callable

from .js import NAMES
from .js_syntax import Node
from .js_scope import Name
from .js_text import same_name, text

BREAK = "\ue000"
INDENT = "    "


def js(n) -> str:
    return text(n.name) if isinstance(n, Name) else PRINTERS[n.kind](n)


def program(tree: Node) -> str:
    return BREAK.join(map(statement, tree.list)).replace(BREAK, "\n")


def statement(n) -> str:
    return js(n) + (";" if not isinstance(n, Name) and n.kind == "VarDecl" else "")


def inset(parts: list[str]) -> str:
    return "".join((BREAK + p).replace(BREAK, BREAK + INDENT) for p in parts)


def block(n: Node) -> str:
    return "{" + inset([statement(x) for x in n.list]) + BREAK + "}" if n.list else "{}"


def after(n: Node) -> str:
    """A body after a closing parenthesis or keyword."""
    return ("" if n.kind == "Empty" else " ") + statement(n)


def expr_stmt(n: Node) -> str:
    out = js(n.value)
    return f"({out});" if out.startswith("let ") else out + ";"


def do_while(n: Node) -> str:
    gap = " " if n.body.kind != "Comment" else ""
    return f"do{after(n.body)}{gap}while ({js(n.cond)});"


def for_(n: Node) -> str:
    init = " " if n.init.kind == "VarDecl" and not n.init.list else js(n.init)
    return f"for ({init}; {js(n.cond) if n.cond is not None else ''}; {js(n.post) if n.post is not None else ''}) {js(n.body)}"


def clause(n: Node) -> str:
    head = f"case {js(n.cond)}:" if n.cond is not None else "default:"
    return head + inset([statement(x) for x in n.list])


def switch(n: Node) -> str:
    head = f"switch ({js(n.init)}) {{"
    return head + "".join(BREAK + clause(c) for c in n.list) + BREAK + "}" if n.list else head + "}"


def try_(n: Node) -> str:
    out = "try " + js(n.body)
    if n.catch is not None:
        out += " catch" + (f"({js(n.binding)})" if n.binding is not None else "") + " " + js(n.catch)
    return out + (" finally " + js(n.last) if n.last is not None else "")


def alias(pair: tuple) -> str:
    name, bound = pair
    return "" if bound is None else " " + (text(name) + " as " if name is not None else "") + text(bound)


def names(pairs: list, star: bool) -> str:
    if star:
        return alias(pairs[0])
    return " {" + ",".join(map(alias, pairs)) + " }" if pairs else " {}"


def import_(n: Node) -> str:
    out = "import" + (" " + text(n.default) if n.default is not None else "")
    if n.names is not None:
        out += ("," if n.default is not None else "") + names(n.names, len(n.names) == 1 and n.names[0][0] == b"*")
    return out + (" from" if n.default is not None or n.names is not None else "") + f" {text(n.module)};"


def export(n: Node) -> str:
    if n.decl is not None:
        return f"export{' default' if n.default else ''} {js(n.decl)};"
    star = len(n.names) == 1 and (n.names[0][0] == b"*" or n.names[0] == (None, b"*"))
    return "export" + names(n.names, star) + (f" from {text(n.module)}" if n.module is not None else "") + ";"


def binding_array(n: Node) -> str:
    out = ""
    for k, item in enumerate(n.list):
        out += "," if k else ""
        if item.binding is not None:
            out += (" " if k else "") + js(item)
    if n.rest is not None:
        out += (", " if n.list else "") + "..." + js(n.rest)
    elif n.list and n.list[-1].binding is None:
        out += ","
    return f"[{out}]"


def binding_object(n: Node) -> str:
    return "{" + ", ".join([js(x) for x in n.list] + (["..." + js(n.rest)] if n.rest is not None else [])) + "}"


def binding_item(n: Node) -> str:
    key = "" if n.key is None or same_name(n.key, n.value.binding) else js(n.key) + ": "
    return key + js(n.value)


def binding_element(n: Node) -> str:
    return "" if n.binding is None else js(n.binding) + (" = " + js(n.default) if n.default is not None else "")


def params(n: Node) -> str:
    return "(" + ", ".join([js(x) for x in n.list] + (["..." + js(n.rest)] if n.rest is not None else [])) + ")"


def function(n: Node) -> str:
    name = " " + text(n.name.name) if n.name is not None else ""
    return f"{'async ' if n.is_async else ''}function{'*' if n.generator else ''}{name}{js(n.params)} {js(n.body)}"


def method(n: Node) -> str:
    marks = "".join(word + " " for word, on in (("static", n.static), ("async", n.is_async), ("*", n.generator), ("get", n.get), ("set", n.set)) if on)
    return f"{marks}{js(n.name)} {js(n.params)} {js(n.body)}"


def element(n: Node) -> str:
    return js(n) + (";" if n.kind == "Field" else "")


def class_(n: Node) -> str:
    head = "class" + (" " + text(n.name.name) if n.name is not None else "") + (" extends " + js(n.extends) if n.extends is not None else "") + " {"
    return head + inset([element(x) for x in n.list]) + BREAK + "}" if n.list else head + "}"


def spread(pair: tuple) -> str:
    return "" if pair[1] is None else ("..." if pair[0] else "") + js(pair[1])


def array(n: Node) -> str:
    return "[" + ", ".join(map(spread, n.list)) + ("," if n.list and n.list[-1][1] is None else "") + "]"


def property_(n: Node) -> str:
    key = "..." if n.spread else "" if n.name is None or same_name(n.name, n.value) else js(n.name) + ": "
    return key + js(n.value) + (" = " + js(n.init) if n.init is not None else "")


def template(n: Node) -> str:
    tag = "" if n.tag is None else js(n.tag) + ("?." if n.optional else "")
    return tag + "".join(text(t) + js(x) for t, x in n.list) + text(n.tail)


def dot(n: Node) -> str:
    x = js(n.x)
    if not n.optional and not isinstance(n.x, Name) and n.x.kind == "Literal" and n.x.type in ("Decimal", "Integer"):
        x = f"({x})"
    return f"{x}{'?.' if n.optional else '.'}{js(n.y)}"


def arguments(pairs: list) -> str:
    return "(" + ", ".join(map(spread, pairs)) + ")"


def unary(n: Node) -> str:
    x = js(n.x)
    if n.postfix:
        return x + n.op
    inner = n.x.op if not isinstance(n.x, Name) and n.x.kind == "Unary" and not n.x.postfix else ""
    apart = n.op in NAMES or n.op in "+-" and inner in (n.op, n.op * 2)
    return n.op + (" " if apart else "") + x


def for_in(n: Node, word: str) -> str:
    awaits = " await" if n.kind == "ForOf" and n.awaits else ""
    return f"for{awaits} ({js(n.init)} {word} {js(n.value)}) {js(n.body)}"


PRINTERS: dict[str, Callable[[Node], str]] = {
    "Comment": lambda n: text(n.value), "Block": block, "Empty": lambda n: ";", "ExprStmt": expr_stmt,
    "If": lambda n: f"if ({js(n.cond)}){after(n.body)}" + (f" else{after(n.otherwise)}" if n.otherwise is not None else ""), "DoWhile": do_while,
    "While": lambda n: f"while ({js(n.cond)}){after(n.body)}", "For": for_, "ForIn": lambda n: for_in(n, "in"), "ForOf": lambda n: for_in(n, "of"),
    "Clause": clause, "Switch": switch, "Branch": lambda n: n.type + (" " + text(n.label) if n.label is not None else "") + ";",
    "Return": lambda n: "return" + (" " + js(n.value) if n.value is not None else "") + ";", "With": lambda n: f"with ({js(n.cond)}){after(n.body)}",
    "Labelled": lambda n: f"{text(n.label)}:{after(n.value)}", "Throw": lambda n: f"throw {js(n.value)};", "Try": try_, "Debugger": lambda n: "debugger;",
    "Import": import_, "Export": export, "Directive": lambda n: text(n.value) + ";", "VarDecl": lambda n: n.type + ",".join(" " + js(x) for x in n.list),
    "BindingElement": binding_element, "BindingArray": binding_array, "BindingItem": binding_item, "BindingObject": binding_object, "Params": params,
    "Function": function, "Method": method, "Field": lambda n: ("static " if n.static else "") + js(n.name) + (" = " + js(n.init) if n.init is not None else ""),
    "Static": lambda n: "static " + js(n.block), "Class": class_, "Computed": lambda n: f"[{js(n.x)}]", "Literal": lambda n: text(n.data), "Array": array,
    "Property": property_, "Object": lambda n: "{" + ", ".join(map(js, n.list)) + "}", "TemplateLiteral": template, "Group": lambda n: f"({js(n.x)})",
    "Index": lambda n: f"{js(n.x)}{'?.' if n.optional else ''}[{js(n.y)}]", "Dot": dot, "NewTarget": lambda n: "new.target", "ImportMeta": lambda n: "import.meta",
    "New": lambda n: f"new {js(n.x)}{arguments(n.args or [])}", "CallExpr": lambda n: f"{js(n.x)}{'?.' if n.optional else ''}{arguments(n.args)}", "Unary": unary,
    "Binary": lambda n: f"{js(n.x)} {n.op} {js(n.y)}", "Cond": lambda n: f"{js(n.cond)} ? {js(n.x)} : {js(n.y)}",
    "Yield": lambda n: "yield" + ("*" if n.generator else "") + (" " + js(n.x) if n.x is not None else ""),
    "Arrow": lambda n: f"{'async ' if n.is_async else ''}{js(n.params)} => {js(n.body)}", "Comma": lambda n: ",".join(map(js, n.list)),
}


class NotJson(Exception):
    pass


def json(tree: Node) -> str:
    """The only expression of a program as JSON; NotJson with the reason otherwise. An empty program is empty."""
    if not tree.list:
        return ""
    if len(tree.list) > 1:
        raise NotJson("JS must be a single statement")
    if tree.list[0].kind != "ExprStmt":
        raise NotJson("JS must be an expression statement")
    value = tree.list[0].value
    if not isinstance(value, Name) and value.kind == "Group":
        value = value.x
    return json_value(value)


def invalid(what: str, n) -> NotJson:
    return NotJson(f"{what} is not valid JSON: {js(n).replace(BREAK, chr(10))}")


def json_value(n) -> str:
    kind = "Var" if isinstance(n, Name) else n.kind
    if kind == "Literal":
        if n.type in ("true", "false", "null", "Decimal", "Integer"):
            return text(n.data)
        if n.type == "String":
            return json_string(text(n.data))
        raise invalid("literal expression", n)
    if kind == "Array":
        if any(s or x is None for s, x in n.list):
            raise invalid("array literal", n)
        return "[" + ", ".join(json_value(x) for _, x in n.list) + "]"
    if kind == "Object":
        return "{" + ", ".join(map(json_property, n.list)) + "}"
    if kind == "TemplateLiteral" and n.tag is None and not n.list:
        inner = text(n.tail)[1:-1].replace("\n", "\\n").replace("\r", "\\r").replace("\\`", "`").replace("\\$", "$").replace('"', '\\"')
        return f'"{inner}"'
    if kind == "Unary":
        number = not isinstance(n.x, Name) and n.x.kind == "Literal" and n.x.type in ("Decimal", "Integer")
        if number and n.op == "-" and not n.postfix:
            return "-" + text(n.x.data)
        if number and n.op == "!" and n.x.type == "Integer" and n.x.data[:1] in (b"0", b"1"):
            return "true" if n.x.data[:1] == b"0" else "false"
        raise invalid("unary expression", n)
    raise invalid("value", n)


def json_string(s: str) -> str:
    if s.startswith("'"):
        inner = s[1:-1].replace("\\'", "'").replace('"', '\\"')
        return f'"{inner}"'
    return s


def json_property(n: Node) -> str:
    if n.name is None or n.spread or n.init is not None or n.name.kind != "Literal" or n.name.type not in ("String", "Identifier", "Integer", "Decimal"):
        raise invalid("property", n)
    key = json_string(text(n.name.data)) if n.name.type == "String" else f'"{text(n.name.data)}"'
    return f"{key}: {json_value(n.value)}"


def kinds_below(tree: Node, enter: Callable, leave: Callable | None = None) -> None:
    """A visitor: ``enter`` is called for each node and says whether to go into it, ``leave`` after its inside."""
    if not enter(tree):
        return
    if not isinstance(tree, Name):
        for value in tree.f.values():
            for x in value if isinstance(value, list) else [value]:
                for y in x if isinstance(x, tuple) else (x,):
                    if isinstance(y, (Node, Name)):
                        kinds_below(y, enter, leave)
    if leave:
        leave(tree)
