"""Checks and keys of source code and worked answers that need a parser; all run as Arrow batches."""

from __future__ import annotations

import ast
import builtins
import dis
import hashlib
import re
import sys
import types
import warnings
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F

#: Modules beyond the standard library's safe part, calls that read or run things, and unfinished code.
UNSAFE_MODULES = {"os", "sys", "subprocess", "socket", "http", "urllib", "shutil", "pathlib"}
UNSAFE_CALLS = {"eval", "exec", "open", "input", "__import__"}
UNFINISHED = ("your code here", "todo", "solution goes here")
DOCUMENTED = (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def parsed(code: str | None) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def parses(code: str | None) -> bool:
    return code is not None and parsed(code) is not None


def _is_text(node: ast.stmt) -> bool:
    return isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)


class _Bare(ast.NodeTransformer):
    """Drops text statements, and with `names` spells bound names by their order of appearance."""

    def __init__(self, kept: set[str] | None = None):
        self.kept, self.names = kept, {}

    def visit(self, node):
        if isinstance(node, DOCUMENTED):
            node.body = [n for n in node.body if not _is_text(n)]
        if self.kept is not None:
            for slot in ("name", "id", "arg"):
                old = getattr(node, slot, None)
                if isinstance(old, str) and isinstance(node, (ast.FunctionDef, ast.Name, ast.arg)) and old not in self.kept:
                    setattr(node, slot, self.names.setdefault(old, f"name{len(self.names)}"))
        return self.generic_visit(node)


def _digest(tree: ast.AST) -> str:
    return hashlib.sha256(ast.dump(tree).encode()).hexdigest()


def syntax_key(code: str | None) -> str | None:
    """Equal for code that differs in layout, comments and documentation only; null if it doesn't parse."""
    tree = parsed(code)
    return None if tree is None else _digest(_Bare().visit(tree))


def clone_key(code: str | None) -> str | None:
    """Equal too for code that differs in the names it binds."""
    tree = parsed(code)
    if tree is None:
        return None
    imported = {(a.asname or a.name).split(".")[0] for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}
    return _digest(_Bare(set(dir(builtins)) | imported).visit(tree))


def only_raises(code: str | None) -> bool:
    """Whether some function does nothing but raise NotImplementedError."""
    for node in ast.walk(parsed(code) or ast.Module([], [])):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            body = [n for n in node.body if not _is_text(n)]
            if len(body) == 1 and isinstance(body[0], ast.Raise):
                what = body[0].exc.func if isinstance(body[0].exc, ast.Call) else body[0].exc
                if isinstance(what, ast.Name) and what.id == "NotImplementedError":
                    return True
    return False


def documented_module(code: str | None, longest: int = 1200) -> str | None:
    """Why a Python module is not taken: size, lines, syntax, definitions (1 to 40) or documentation (100 characters)."""
    code = code or ""
    if not 200 <= len(code) <= 30_000:
        return "size"
    if max(map(len, code.splitlines())) > longest:
        return "long_line"
    tree = parsed(code)
    if tree is None:
        return "syntax"
    defs = [n for n in ast.walk(tree) if isinstance(n, DOCUMENTED[1:])]
    if not 1 <= len(defs) <= 40:
        return "definitions"
    words = sum(len(ast.get_docstring(n) or "") for n in [tree, *defs]) + sum(len(x) for x in code.splitlines() if x.lstrip()[:1] == "#")
    return None if words >= 100 else "documentation"


#: The reasons, in the order in which the first one counts.
SHORT_REASONS = (
    "syntax",
    "not_short_functions",
    "redefined_function",
    "long_code",
    "placeholder_or_global_state",
    "top_level_execution",
    "non_foundational_dependency",
    "relative_or_star_import",
    "dynamic_or_io_code",
    "unresolved_global",
)
#: How many functions, characters and lines short code has at most.
MOST_FUNCTIONS, MOST_CHARS, MOST_LINES = 4, 6000, 100


class _Faults(ast.NodeVisitor):
    """Walks a module once and notes the reason of each node that short code may not have."""

    def __init__(self):
        self.found: set[str] = set()
        self.names: list[str] = []

    def visit_Module(self, node):
        for child in node.body:
            match child:
                case ast.FunctionDef(name=name):
                    self.names.append(name)
                case ast.Import() | ast.ImportFrom() | ast.Expr(value=ast.Constant(value=str())):
                    pass
                case ast.Assign(value=value) | ast.AnnAssign(value=ast.expr() as value) if _is_literal(value):
                    pass
                case _:
                    self.found.add("top_level_execution")
        self.generic_visit(node)

    def visit(self, node):
        match node:
            case ast.ClassDef() | ast.AsyncFunctionDef():
                self.found.add("not_short_functions")
            case ast.Pass() | ast.Global() | ast.Nonlocal():
                self.found.add("placeholder_or_global_state")
            case ast.Constant(value=value) if value is Ellipsis:
                self.found.add("placeholder_or_global_state")
            case ast.Import(names=names):
                self._imports(a.name for a in names)
            case ast.ImportFrom(module=module, level=level, names=names):
                self._imports([module] if module else [])
                if level or names[0].name == "*":
                    self.found.add("relative_or_star_import")
            case ast.Call(func=ast.Name(id=name)) if name in UNSAFE_CALLS:
                self.found.add("dynamic_or_io_code")
        return super().visit(node)

    def _imports(self, modules):
        roots = {m.partition(".")[0] for m in modules}
        if not roots <= sys.stdlib_module_names - UNSAFE_MODULES:
            self.found.add("non_foundational_dependency")


def _is_literal(node: ast.expr) -> bool:
    try:
        ast.literal_eval(node)
    except (ValueError, TypeError, SyntaxError, RecursionError):
        return False
    return True


def _names_used(code: types.CodeType) -> set[str]:
    """The names that compiled code, and the code inside it, looks up outside its functions."""
    used = {i.argval for i in dis.get_instructions(code) if i.opname in ("LOAD_GLOBAL", "LOAD_NAME")}
    return used.union(*(_names_used(c) for c in code.co_consts if isinstance(c, types.CodeType)))


def short_functions(code: str | None) -> str | None:
    """The first reason why code is not one to four short, plain, self-contained functions."""
    code = code or ""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree, module = ast.parse(code), compile(code, "code", "exec")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return SHORT_REASONS[0]
    faults = _Faults()
    faults.visit(tree)
    found, names = faults.found, faults.names
    if not 1 <= len(names) <= MOST_FUNCTIONS:
        found.add("not_short_functions")
    if len(names) != len(set(names)):
        found.add("redefined_function")
    if len(code) > MOST_CHARS or len(code.splitlines()) > MOST_LINES:
        found.add("long_code")
    bound = {i.argval for i in dis.get_instructions(module) if i.opname == "STORE_NAME"}
    if _names_used(module) - bound - {*dir(builtins), "__annotations__"}:
        found.add("unresolved_global")
    return next((reason for reason in SHORT_REASONS if reason in found), None)


def final_code(text: str | None, language: str) -> str | None:
    """The one fenced block of a text, if it is finished code of the language."""
    found = re.findall(r"```([\w+]*)[ \t]*\n(.*?)```", text or "", re.S)
    tags = {"python": {"", "py", "python"}, "cpp": {"", "cpp", "c++", "cc"}}[language]
    if len(found) != 1 or found[0][0].lower() not in tags:
        return None
    code = found[0][1].strip()
    if not 40 <= len(code) <= 10_000 or "..." in code or any(u in code.lower() for u in UNFINISHED):
        return None
    if language == "python":
        return code if parsed(code) is not None else None
    return code if re.search(r"\b(?:int|signed)\s+main\s*\(", code) and code.count("{") == code.count("}") else None


def boxed(text: str | None) -> str | None:
    r"""What the last balanced \boxed{...} holds: the one that begins last of those that end."""
    opened, best = [], (-1, None)
    for m in re.finditer(r"(\\boxed)?\{|\}", text or ""):
        if m[0] != "}":
            opened.append(m.end() if m[1] else -1)
        elif opened and (begin := opened.pop()) > best[0]:
            best = (begin, text[begin : m.start()])
    return best[1]


def math_answer(text: str | None) -> str:
    """An answer without blanks, sizing commands, outer delimiters and final dots, for exact comparison."""
    out = re.sub(r"\s+|\\left|\\right", "", text or "")
    out = re.sub(r"\\[dt]frac", r"\\frac", out)
    pairs = (("\\(", "\\)"), ("\\[", "\\]"), ("$", "$"), ("{", "}"))
    while out:
        inner = next((out[len(a) : -len(b)] for a, b in pairs if out.startswith(a) and out.endswith(b) and len(out) >= len(a) + len(b)), None)
        if inner is None:
            break
        out = inner
    return out.rstrip(".,")


def exact_value(expression: str | None) -> Fraction | None:
    """The exact value of an arithmetic expression, or null for anything else."""
    table = {ast.Add: Fraction.__add__, ast.Sub: Fraction.__sub__, ast.Mult: Fraction.__mul__, ast.Div: Fraction.__truediv__, ast.Mod: Fraction.__mod__, ast.FloorDiv: lambda a, b: Fraction(a // b)}

    def value(n: ast.AST) -> Fraction:
        match n:
            case ast.Expression():
                return value(n.body)
            case ast.Constant(value=bool()):
                raise ValueError
            case ast.Constant(value=int() | float() as v):
                return Fraction(str(v))
            case ast.UnaryOp(op=ast.USub()):
                return -value(n.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return value(n.operand)
            case ast.BinOp(op=ast.Pow()):
                power = value(n.right)
                if power.denominator != 1 or abs(power) > 6:
                    raise ValueError
                return value(n.left) ** int(power)
            case ast.BinOp() if type(n.op) in table:
                return table[type(n.op)](value(n.left), value(n.right))
        raise ValueError

    try:
        return value(ast.parse((expression or "").strip(), mode="eval"))
    except (ValueError, SyntaxError, ZeroDivisionError, RecursionError, OverflowError):
        return None


def wrong_equations(text: str | None) -> int:
    """How many simple equations (expression = number) of a text don't hold."""
    found = re.findall(r"([-+*/(). \d]*\d[-+*/(). \d]*)=\s*(-?\d+(?:\.\d+)?)", text or "")
    pairs = [(exact_value(a), exact_value(b)) for a, b in found]
    return sum(a is not None and b is not None and a != b for a, b in pairs)


def over(column, function, kind: str, *args):
    """A function of one text over a column, in Arrow batches."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([function(t, *args) for t in texts], dtype=object)

    return run(column)
