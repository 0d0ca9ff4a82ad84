"""Symbols, imports and calls of Python sources, by their syntax trees, one file a row.

The parser is Python's own, so this part runs in Arrow batches, each text of a batch parsed once whatever the number of
its copies; a file that does not parse gives a row with an error, never an exception.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.keys import with_repo
from lodestar.sources.tree import tasks

PARAMETER = "struct<name:string,kind:string,annotation:string,default:string>"
SYMBOL = f"struct<name:string,qualname:string,kind:string,parent:string,line_start:int,line_end:int,docstring:string,decorators:array<string>,base_classes:array<string>,parameters:array<{PARAMETER}>,returns:string,is_async:boolean,complexity:int,ord:int>"
IMPORT = "struct<module:string,name:string,alias:string,line:int,level:int,is_from:boolean,ord:int>"
CALL = "struct<callee:string,line:int,caller:string,arg_count:int,ord:int>"
PARSED = f"repo string, path string, module string, docstring string, error string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, calls array<{CALL}>"

DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
DECISIONS = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert, ast.match_case)


def text_of(node: ast.AST | None) -> str | None:
    try:
        return None if node is None else ast.unparse(node)
    except Exception:  # noqa: BLE001 - the text only informs
        return None


def callee_name(node: ast.AST) -> str | None:
    """a.b.c of what is called; the last name alone where what stands before has none; null for the unnameable."""
    names: list[str] = []
    while True:
        match node:
            case ast.Name(id=name):
                return ".".join([name, *reversed(names)])
            case ast.Attribute(value=value, attr=attr):
                names.append(attr)
                node = value
            case ast.Call(func=func):
                node = func
            case _:
                return ".".join(reversed(names)) or None


def complexity(definition: ast.AST) -> int:
    """Independent paths through a body; nested definitions count for themselves."""
    total, todo = 1, list(definition.body)
    while todo:
        node = todo.pop()
        if isinstance(node, ast.comprehension):
            total += 1 + len(node.ifs)
        elif isinstance(node, ast.BoolOp):
            total += len(node.values) - 1
        else:
            total += isinstance(node, DECISIONS)
        if not isinstance(node, DEFINITIONS):
            todo.extend(ast.iter_child_nodes(node))
    return total


def parameters(a: ast.arguments) -> list[dict]:
    plain = [(x, "positional_only") for x in a.posonlyargs] + [(x, "positional_or_keyword") for x in a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    rows = [(x, kind, d) for (x, kind), d in zip(plain, defaults, strict=True)]
    rows += [(a.vararg, "var_positional", None)] if a.vararg else []
    rows += [(x, "keyword_only", d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    rows += [(a.kwarg, "var_keyword", None)] if a.kwarg else []
    return [{"name": x.arg, "kind": kind, "annotation": text_of(x.annotation), "default": text_of(d)} for x, kind, d in rows]


@dataclass
class Found:
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)

    def call(self, node: ast.Call, caller: str | None) -> None:
        if name := callee_name(node.func):
            self.calls.append({"callee": name, "line": node.lineno, "caller": caller, "arg_count": len(node.args) + len(node.keywords), "ord": len(self.calls)})

    def calls_in(self, expressions: list[ast.AST], caller: str | None) -> None:
        for e in expressions:
            for node in ast.walk(e):
                if isinstance(node, ast.Call):
                    self.call(node, caller)

    def visit(self, node: ast.AST, scope: tuple[str, ...], caller: str | None, in_class: bool) -> None:
        """scope: the names around; caller: the nearest function around; in_class: whether a class is right around."""
        if isinstance(node, DEFINITIONS):
            self.define(node, scope, caller, in_class)
        elif isinstance(node, ast.Import):
            for a in node.names:
                self.imports.append({"module": a.name, "name": None, "alias": a.asname, "line": node.lineno, "level": 0, "is_from": False, "ord": len(self.imports)})
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                self.imports.append({"module": node.module, "name": a.name, "alias": a.asname, "line": node.lineno, "level": node.level or 0, "is_from": True, "ord": len(self.imports)})
        else:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.Call):
                    self.call(child, caller)
                self.visit(child, scope, caller, in_class)

    def define(self, node: ast.AST, scope: tuple[str, ...], caller: str | None, in_class: bool) -> None:
        is_class = isinstance(node, ast.ClassDef)
        qualname = ".".join((*scope, node.name))
        self.symbols.append({
            "name": node.name, "qualname": qualname, "kind": "class" if is_class else "method" if in_class else "function", "parent": ".".join(scope) or None,
            "line_start": node.lineno, "line_end": node.end_lineno or node.lineno, "docstring": ast.get_docstring(node),
            "decorators": [t for d in node.decorator_list if (t := text_of(d))], "base_classes": [t for b in node.bases if (t := text_of(b))] if is_class else [],
            "parameters": [] if is_class else parameters(node.args), "returns": None if is_class else text_of(node.returns), "is_async": isinstance(node, ast.AsyncFunctionDef),
            "complexity": complexity(node), "ord": len(self.symbols),
        })
        # What the header evaluates belongs to the scope around: decorators, bases, keyword values, positional defaults.
        around = [*node.bases, *(k.value for k in node.keywords)] if is_class else node.args.defaults
        self.calls_in([*node.decorator_list, *around], caller)
        for child in node.body:
            self.visit(child, (*scope, node.name), caller if is_class else qualname, is_class)


def parse(source: bytes | str | None, path: str = "<unknown>") -> dict:
    """docstring, error, symbols, imports, calls of one source."""
    found = Found()
    out = {"docstring": None, "error": None}
    if source is None:
        out["error"] = "OSError: unreadable"
    else:
        try:
            tree = ast.parse(source, filename=path)
            out["docstring"] = ast.get_docstring(tree)
            for node in tree.body:
                found.visit(node, (), None, False)
        except SyntaxError as e:
            found, out["error"] = Found(), f"SyntaxError: {e.msg}" + (f" (line {e.lineno})" if e.lineno else "")
        except (ValueError, RecursionError) as e:
            found, out["error"] = Found(), f"{type(e).__name__}: {e}"
    return out | {"symbols": found.symbols, "imports": found.imports, "calls": found.calls}


def extract(files: DataFrame) -> DataFrame:
    """One row a file: repo, path, module, docstring, error, and symbols, imports and calls as arrays. files: (repo, path, module, content)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    slim = with_repo(files)[0].select("repo", "path", "module", "content")
    spark_schema = slim.sparkSession.createDataFrame([], PARSED).schema
    schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nth: dict[bytes | None, int] = {}
            at = [nth.setdefault(c, len(nth)) for c in batch.column(3).to_pylist()]
            made = pa.RecordBatch.from_pylist([parse(c) for c in nth], schema=pa.schema(list(schema)[3:])).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made.columns], schema=schema)

    return slim.repartition(tasks(slim.sparkSession), "repo", "path").mapInArrow(run, spark_schema)


def symbols_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo", "path", "module", F.explode("symbols").alias("s")).select("repo", "path", "module", "s.*")


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo", "path", F.explode("imports").alias("i")).select("repo", "path", "i.*")


def calls_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo", "path", F.explode("calls").alias("c")).select("repo", "path", "c.*")


def counts(parsed: DataFrame) -> DataFrame:
    """One row: files, symbols, imports, calls, failed files."""
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c)
    return parsed.agg(F.count("*").alias("files"), size("symbols"), size("imports"), size("calls"), F.count_if(F.col("error").isNotNull()).alias("failed"))
