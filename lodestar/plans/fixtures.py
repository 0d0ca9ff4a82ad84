"""Source trees and commit logs made from the driver's tables, with the answers of the source-code operators as SQL.

Every document is a package of a repository named by its source, every customer a repository with a log. The package shows each
way a call, an import or a base class can resolve; its answers were worked out by hand and hold for each document, so the SQL
is a join of the table with them. `§` stands for the package in paths, code and answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import scoring, text
from lodestar.operators import cochange, impact, resolve
from lodestar.plans import lifecycle
from lodestar.plans.written import Written
from lodestar.sources import extract, history, tree

FILES = {
    "§/__init__.py": "from .pricing import total\n",
    "§/base.py": 'class Model:\n    """A row."""\n\n    def save(self):\n        return self.check()\n\n    def check(self):\n        return True\n',
    "§/pricing.py": "import math\nfrom . import base\n\n\ndef total(items, *, rate=0.2, **more):\n    kept = [i for i in items if i and i.price]\n    return math.ceil(sum(kept)) if kept else helper()\n\n\ndef helper():\n    pass\n",
    "§/cart.py": (
        "from .base import Model as Row\nfrom § import total\nimport §.pricing\n\n\n@register('cart')\nclass Cart(Row, Generic[T]):\n    async def add(self, item: str, /, n: int = 1) -> None:\n        def inner():\n            self.save()\n        inner()\n"
        "        self.client.get()\n        total([item])\n        §.pricing.helper()\n        self.missing()\n\n\nCart().add('x')\n"
    ),
    "§/broken.py": "def oops(:\n",
    "§/tools/run_§.py": "def main():\n    return handlers[0]() or f()()\n\n\ndef f():\n    return main",
    "§/README.md": "# §\n",
    "§/node_modules/x/index.py": "x = 1\n",
    "§/empty.py": "",
}

LOG = (
    "\x00c4\x1f2024-01-04\x1fann\x1frename\nR100\told§.py\tnew§.py\nM\tb.py\n"
    "\x00c3\x1f2024-01-03\x1fann\x1fedit\nM\told§.py\nM\tb.py\n"
    "\x00c2\x1f2024-01-02\x1fbob\x1fedit\nM\told§.py\nA\tc.py\n"
    "\x00c1\x1f2024-01-01\x1fbob\x1fstart\nA\told§.py\n"
)


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content, size_bytes): FILES for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    each = docs.select(F.coalesce("source", F.lit("")).alias("repo"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("p")).repartition(tree.tasks(spark), "repo", "p").distinct()
    of = F.explode(F.array(*[F.struct(F.lit(path).alias("path"), F.lit(code).alias("code")) for path, code in FILES.items()])).alias("f")
    filled = lambda c: F.replace(F.col(c), F.lit("§"), F.col("p"))
    code = each.select("repo", "p", of).select("repo", filled("f.path").alias("path"), F.encode(filled("f.code"), "UTF-8").alias("content"))
    return code.withColumn("size_bytes", F.octet_length("content").cast("long"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, log): a log for each customer."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey is not null")
    key = F.col("c_custkey").cast("string")
    return customers.select(F.concat(F.lit("c"), key).alias("repo"), F.replace(F.lit(LOG), F.lit("§"), key).alias("log")).distinct()


def _parse(spark, sf_dir) -> lifecycle.Parsed:
    return lifecycle.parse_many(source_tree(spark, sf_dir))


def walker_inventory(spark, sf_dir):
    return tree.walk(source_tree(spark, sf_dir))[0].select("repo", "path", "language", "line_count", "module")


def walker_skipped(spark, sf_dir):
    return tree.walk(source_tree(spark, sf_dir))[1]


def _extracted(spark, sf_dir):
    return extract.extract(tree.inventory(source_tree(spark, sf_dir))[0])


def extract_symbols(spark, sf_dir):
    s = extract.symbols_of(_extracted(spark, sf_dir))
    return s.select("repo", "path", "qualname", "kind", "parent", "line_start", "line_end", "complexity", F.array_join(F.transform("parameters", lambda x: F.concat_ws(":", x["name"], x["kind"])), ",").alias("parameters"), "is_async")


def signatures(spark, sf_dir):
    """Symbols as explanations describe them: signature, and the first line of the docstring."""
    s = extract.symbols_of(_extracted(spark, sf_dir))
    return s.select("repo", "path", "qualname", impact.signature().alias("signature"), F.substring_index(F.trim("docstring"), "\n", 1).alias("doc"))


def extract_imports(spark, sf_dir):
    return extract.imports_of(_extracted(spark, sf_dir)).select("repo", "path", "module", "name", "alias", "line", "level", "is_from", resolve.bound_name().alias("bound"))


def extract_calls(spark, sf_dir):
    return extract.calls_of(_extracted(spark, sf_dir)).select("repo", "path", "callee", "line", "caller", "arg_count")


def extract_errors(spark, sf_dir):
    return _extracted(spark, sf_dir).where("error is not null").select("repo", "path", F.substring_index("error", ":", 1).alias("error"))


def _resolved_imports(spark, sf_dir, keep: Written) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parsed, files in order, resolved imports) of the tree."""
    files, _, parsed = lifecycle.extract_tree(source_tree(spark, sf_dir), keep)
    index = lifecycle.ordered_files(files)
    return parsed, index, resolve.resolve_imports(extract.imports_of(parsed), index)


def resolve_imports(spark, sf_dir):
    return _resolved_imports(spark, sf_dir, Written(spark, sorted_joins=True))[2].select("repo", "source_path", "target_path", "target_module", "resolution", "bound_name", "line")


def resolve_bases(spark, sf_dir):
    keep = Written(spark, sorted_joins=True)
    parsed, index, resolved = _resolved_imports(spark, sf_dir, keep)
    return resolve.resolve_bases(extract.symbols_of(parsed), index, keep(resolved))


def resolve_calls(spark, sf_dir):
    keep = Written(spark, sorted_joins=True)
    parsed, index, resolved = _resolved_imports(spark, sf_dir, keep)
    symbols, resolved = extract.symbols_of(parsed), keep(resolved)
    bases = keep(resolve.resolve_bases(symbols, index, resolved))
    return resolve.resolve_calls(extract.calls_of(parsed), symbols, index, resolved, bases).select("repo", "path", "callee", "line", "dst_path", "dst_qualname", "resolution", "confidence", "reason")


def many_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository for each source of documents and a module for each document, which imports the next one's function."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").select(F.coalesce("source", F.lit("")).alias("repo"), "doc_id")
    code = "from .d%d import work as next_work\n\n\nclass Step:\n    def run(self):\n        return self.stop()\n\n    def stop(self):\n        return work()\n\n\ndef work():\n    return next_work()\n"
    modules = d.select("repo", F.format_string("pkg/d%d.py", "doc_id").alias("path"), F.format_string(code, F.col("doc_id") + 1).alias("text"))
    packages = d.select("repo", F.lit("pkg/__init__.py").alias("path"), F.lit("").alias("text")).distinct()
    return modules.union(packages).select("repo", "path", F.encode("text", "UTF-8").alias("content"), F.length("text").cast("long").alias("size_bytes"))


def many_repositories(spark, sf_dir):
    """Calls of thousands of files in several repositories at once: none resolves into another repository."""
    keep = Written(spark, sorted_joins=True)
    files, _, parsed = lifecycle.extract_tree(many_trees(spark, sf_dir), keep)
    index, symbols = lifecycle.ordered_files(files), extract.symbols_of(parsed)
    resolved = keep(resolve.resolve_imports(extract.imports_of(parsed), index))
    bases = keep(resolve.resolve_bases(symbols, index, resolved))
    return resolve.resolve_calls(extract.calls_of(parsed), symbols, index, resolved, bases).select("repo", "path", "callee", "dst_path", "dst_qualname", "resolution", "reason")


def graph_build(spark, sf_dir):
    """Nodes and edges of each kind that the tree gives."""
    made = _parse(spark, sf_dir)
    out = made.nodes.groupBy("repo", F.col("label").alias("what")).agg(F.count("*").alias("n"))
    for kind, edges in made.edges.items():
        out = out.union(edges.groupBy("repo", F.lit(kind).alias("what")).agg(F.count("*").alias("n")))
    return out


def chunk_tree(spark, sf_dir):
    return _parse(spark, sf_dir).chunks.select("repo", "path", "qualname", "kind", "line_start", "line_end", "part_count")


def history_commits(spark, sf_dir):
    return history.commits(logs(spark, sf_dir)).select("repo", "ord", "sha", "authored_at", F.array_join("paths", ",").alias("paths"))


def history_pairs(spark, sf_dir):
    return cochange.co_change(history.commits(logs(spark, sf_dir)))


def extract_counts(spark, sf_dir):
    return extract.counts(_extracted(spark, sf_dir))


def inventory_totals(spark, sf_dir):
    return tree.inventory_totals(*tree.walk(source_tree(spark, sf_dir)))[0].select("file_count", "total_lines")


def skipped_by_reason(spark, sf_dir):
    return tree.inventory_totals(*tree.walk(source_tree(spark, sf_dir)))[1]


SOURCES = ("https://h.org/a/b§.git", "git@h.org:a/c§.git", "/data/My Repo §.ZIP", "/srv/code§/", "plain§", "/")
NAMES = ("shop§", "  ", None, "a/b§", "x" * 256 + "§", " padded§ ")
PATHS = ("tests/test_§.py", "src/a§.py", "pkg/§_test.py", "src/contest§.py", "§/tests/x.py", "latest/§.py")


def _per_page(spark, sf_dir, texts, name: str) -> DataFrame:
    """(page_id, n, name): each text for each page, whose id stands for `§`."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").where("page_id is not null").distinct()
    filled = F.replace(F.col("t"), F.lit("§"), F.col("page_id").cast("string"))
    return pages.select("page_id", F.posexplode(F.array(*[F.lit(t) for t in texts])).alias("n", "t")).select("page_id", "n", filled.alias(name))


def source_kinds(spark, sf_dir):
    """Sources by kind, and the names they get."""
    kind = text.classify_source(F.col("source"))
    return _per_page(spark, sf_dir, SOURCES, "source").select("page_id", "source", kind.alias("kind"), text.derive_name(F.col("source"), kind).alias("name"))


def name_validation(spark, sf_dir):
    return _per_page(spark, sf_dir, NAMES, "name").select("page_id", "n", text.name_problem(F.col("name")).alias("problem"))


def known_test_paths(spark, sf_dir):
    return _per_page(spark, sf_dir, PATHS, "path").select("page_id", "path", scoring.is_test_path(F.col("path")).alias("is_test"))

QUERIES = {f.__name__: f for f in (extract_counts, inventory_totals, skipped_by_reason, source_kinds, name_validation, known_test_paths, walker_inventory, walker_skipped, extract_symbols, signatures, extract_imports, extract_calls, extract_errors, resolve_imports, resolve_bases, resolve_calls, many_repositories, graph_build, chunk_tree, history_commits, history_pairs)}


_OF_DOCUMENTS = "select distinct coalesce(source, '') as repo, 'p' || doc_id as mark from documents where doc_id is not null"
_OF_CUSTOMERS = "select distinct 'c' || c_custkey as repo, c_custkey::varchar as mark from customer where c_custkey is not null"
_OF_PAGES = "select distinct page_id, page_id::varchar as mark from pages where page_id is not null"


def _each(columns: str, texts: str, *rows: str, of: str = _OF_DOCUMENTS) -> str:
    """The rows for each row of `of`, with its `mark` for every § in the text columns."""
    shown = ", ".join(f"replace(t.{c}, '§', e.mark) as {c}" if c in texts.split(", ") else f"t.{c}" for c in columns.split(", "))
    return f"select e.* exclude (mark), {shown} from ({of}) e, (values {', '.join(f'({r})' for r in rows)}) as t({columns})"


def _counts(of: str, *rows: str) -> str:
    """(repo, what, n): counts for each document, or once a repository where n_repo says so."""
    return f"select repo, what, (sum(n_doc) + any_value(n_repo))::bigint as n from ({of}) e, (values {', '.join(f'({r})' for r in rows)}) as t(what, n_doc, n_repo) group by repo, what"


ORACLE_SQL = {
    "many_repositories": """with d as (select coalesce(source, '') as repo, doc_id from documents where doc_id is not null), m as (select repo, doc_id, 'pkg/d' || doc_id || '.py' as path from d)
select repo, path, 'self.stop' as callee, path as dst_path, 'Step.stop' as dst_qualname, 'attribute_self' as resolution, cast(null as varchar) as reason from m
union all select repo, path, 'work', path, 'work', 'local', null from m
union all select a.repo, a.path, 'next_work', b.path, case when b.path is not null then 'work' end, case when b.path is not null then 'imported' end, case when b.path is null then 'unresolved' end
  from m a left join m b on a.repo = b.repo and b.doc_id = a.doc_id + 1""",
    "walker_inventory": _each(
        "path, language, line_count, module",
        "path, module",
        "'§/empty.py', 'python', 0, '§.empty'",
        "'§/__init__.py', 'python', 1, '§'",
        "'§/base.py', 'python', 8, '§.base'",
        "'§/broken.py', 'python', 1, '§.broken'",
        "'§/cart.py', 'python', 18, '§.cart'",
        "'§/pricing.py', 'python', 11, '§.pricing'",
        "'§/tools/run_§.py', 'python', 6, 'run_§'",
    ),
    "walker_skipped": _each(
        "path, reason",
        "path",
        "'§/README.md', 'unsupported_extension'",
        "'§/node_modules', 'ignored_dir'",
    ),
    "extract_symbols": _each(
        "path, qualname, kind, parent, line_start, line_end, complexity, parameters, is_async",
        "path, qualname, parent",
        "'§/base.py', 'Model', 'class', null, 1, 8, 1, '', false",
        "'§/base.py', 'Model.check', 'method', 'Model', 7, 8, 1, 'self:positional_or_keyword', false",
        "'§/base.py', 'Model.save', 'method', 'Model', 4, 5, 1, 'self:positional_or_keyword', false",
        "'§/cart.py', 'Cart', 'class', null, 7, 15, 1, '', false",
        "'§/cart.py', 'Cart.add', 'method', 'Cart', 8, 15, 1, 'self:positional_only,item:positional_only,n:positional_or_keyword', true",
        "'§/cart.py', 'Cart.add.inner', 'function', 'Cart.add', 9, 10, 1, '', false",
        "'§/pricing.py', 'helper', 'function', null, 10, 11, 1, '', false",
        "'§/pricing.py', 'total', 'function', null, 5, 7, 5, 'items:positional_or_keyword,rate:keyword_only,more:var_keyword', false",
        "'§/tools/run_§.py', 'f', 'function', null, 5, 6, 1, '', false",
        "'§/tools/run_§.py', 'main', 'function', null, 1, 2, 2, '', false",
    ),
    "signatures": _each(
        "path, qualname, signature, doc",
        "path",
        "'§/base.py', 'Model', 'class Model', 'A row.'",
        "'§/base.py', 'Model.check', 'def Model.check(self)', null",
        "'§/base.py', 'Model.save', 'def Model.save(self)', null",
        "'§/cart.py', 'Cart', 'class Cart(Row, Generic[T])', null",
        "'§/cart.py', 'Cart.add', 'async def Cart.add(self, item: str, n: int) -> None', null",
        "'§/cart.py', 'Cart.add.inner', 'def Cart.add.inner()', null",
        "'§/pricing.py', 'helper', 'def helper()', null",
        "'§/pricing.py', 'total', 'def total(items, rate, more)', null",
        "'§/tools/run_§.py', 'f', 'def f()', null",
        "'§/tools/run_§.py', 'main', 'def main()', null",
    ),
    "extract_imports": _each(
        "path, module, name, alias, line, level, is_from, bound",
        "path, module, name, bound",
        "'§/__init__.py', 'pricing', 'total', null, 1, 1, true, 'total'",
        "'§/cart.py', 'base', 'Model', 'Row', 1, 1, true, 'Row'",
        "'§/cart.py', '§', 'total', null, 2, 0, true, 'total'",
        "'§/cart.py', '§.pricing', null, null, 3, 0, false, '§'",
        "'§/pricing.py', 'math', null, null, 1, 0, false, 'math'",
        "'§/pricing.py', null, 'base', null, 2, 1, true, 'base'",
    ),
    "extract_calls": _each(
        "path, callee, line, caller, arg_count",
        "path, callee",
        "'§/base.py', 'self.check', 5, 'Model.save', 0",
        "'§/cart.py', 'Cart', 18, null, 0",
        "'§/cart.py', 'Cart.add', 18, null, 1",
        "'§/cart.py', 'inner', 11, 'Cart.add', 0",
        "'§/cart.py', 'register', 6, null, 1",
        "'§/cart.py', 'self.client.get', 12, 'Cart.add', 0",
        "'§/cart.py', 'self.missing', 15, 'Cart.add', 0",
        "'§/cart.py', 'self.save', 10, 'Cart.add.inner', 0",
        "'§/cart.py', '§.pricing.helper', 14, 'Cart.add', 0",
        "'§/cart.py', 'total', 13, 'Cart.add', 1",
        "'§/pricing.py', 'helper', 7, 'total', 0",
        "'§/pricing.py', 'math.ceil', 7, 'total', 1",
        "'§/pricing.py', 'sum', 7, 'total', 1",
        "'§/tools/run_§.py', 'f', 2, 'main', 0",
        "'§/tools/run_§.py', 'f', 2, 'main', 0",
    ),
    "extract_counts": "select 7 * n as files, 10 * n as symbols, 6 * n as imports, 15 * n as calls, n as failed from (select count(*)::bigint as n from (" + _OF_DOCUMENTS + "))",
    "inventory_totals": "select 7 * n as file_count, 45 * n as total_lines from (select count(*)::bigint as n from (" + _OF_DOCUMENTS + "))",
    "skipped_by_reason": "select reason, n from (select count(*)::bigint as n from (" + _OF_DOCUMENTS + ")), (values ('ignored_dir'), ('unsupported_extension')) as t(reason) where n > 0",
    "source_kinds": _each("source, kind, name", "source, name", "'https://h.org/a/b§.git', 'git', 'b§'", "'git@h.org:a/c§.git', 'git', 'c§'", "'/data/My Repo §.ZIP', 'zip', 'My-Repo-§'", "'/srv/code§/', 'local', 'code§'", "'plain§', 'local', 'plain§'", "'/', 'local', null", of=_OF_PAGES),
    "name_validation": _each("n, problem", "", "0, null", "1, 'empty'", "2, 'empty'", "3, 'forbidden_characters'", "4, 'too_long'", "5, null", of=_OF_PAGES),
    "known_test_paths": _each("path, is_test", "path", "'tests/test_§.py', true", "'src/a§.py', false", "'pkg/§_test.py', true", "'src/contest§.py', false", "'§/tests/x.py', true", "'latest/§.py', false", of=_OF_PAGES),
    "extract_errors": _each(
        "path, error",
        "path",
        "'§/broken.py', 'SyntaxError'",
    ),
    "resolve_imports": _each(
        "source_path, target_path, target_module, resolution, bound_name, line",
        "source_path, target_path, target_module, bound_name",
        "'§/__init__.py', '§/pricing.py', null, 'relative', 'total', 1",
        "'§/cart.py', '§/__init__.py', null, 'internal_symbol', 'total', 2",
        "'§/cart.py', '§/base.py', null, 'relative', 'Row', 1",
        "'§/cart.py', '§/pricing.py', null, 'internal_module', '§', 3",
        "'§/pricing.py', '§/base.py', null, 'relative', 'base', 2",
        "'§/pricing.py', null, 'math', 'external', 'math', 1",
    ),
    "resolve_bases": _each(
        "path, qualname, position, base, base_path, base_qualname",
        "path, qualname, base_path",
        "'§/cart.py', 'Cart', 0, 'Row', '§/base.py', 'Model'",
        "'§/cart.py', 'Cart', 1, 'Generic', null, null",
    ),
    "resolve_calls": _each(
        "path, callee, line, dst_path, dst_qualname, resolution, confidence, reason",
        "path, callee, dst_path",
        "'§/base.py', 'self.check', 5, '§/base.py', 'Model.check', 'attribute_self', 0.85::double, null",
        "'§/cart.py', 'Cart', 18, null, null, null, null, 'module_level'",
        "'§/cart.py', 'Cart.add', 18, null, null, null, null, 'module_level'",
        "'§/cart.py', 'inner', 11, '§/cart.py', 'Cart.add.inner', 'local', 1.0::double, null",
        "'§/cart.py', 'register', 6, null, null, null, null, 'module_level'",
        "'§/cart.py', 'self.client.get', 12, null, null, null, null, 'unresolved'",
        "'§/cart.py', 'self.missing', 15, null, null, null, null, 'unresolved'",
        "'§/cart.py', 'self.save', 10, '§/base.py', 'Model.save', 'attribute_self', 0.85::double, null",
        "'§/cart.py', '§.pricing.helper', 14, '§/pricing.py', 'helper', 'attribute_module', 0.9::double, null",
        "'§/cart.py', 'total', 13, '§/pricing.py', 'total', 'imported', 0.95::double, null",
        "'§/pricing.py', 'helper', 7, '§/pricing.py', 'helper', 'local', 1.0::double, null",
        "'§/pricing.py', 'math.ceil', 7, null, null, null, null, 'unresolved'",
        "'§/pricing.py', 'sum', 7, null, null, null, null, 'unresolved'",
        "'§/tools/run_§.py', 'f', 2, '§/tools/run_§.py', 'f', 'local', 1.0::double, null",
        "'§/tools/run_§.py', 'f', 2, '§/tools/run_§.py', 'f', 'local', 1.0::double, null",
    ),
    "graph_build": _counts(_OF_DOCUMENTS, "'CALLS', 7, 0", "'CONTAINS', 17, 0", "'Class', 2, 1", "'File', 7, 0", "'Function', 8, 0", "'IMPORTS', 6, 0", "'INHERITS', 2, 0", "'Module', 0, 1", "'Repo', 0, 1"),
    "chunk_tree": _each(
        "path, qualname, kind, line_start, line_end, part_count",
        "path, qualname",
        "'§/__init__.py', null, 'module', 1, 1, 1",
        "'§/base.py', 'Model', 'class', 1, 3, 1",
        "'§/base.py', 'Model.check', 'method', 7, 8, 1",
        "'§/base.py', 'Model.save', 'method', 4, 5, 1",
        "'§/broken.py', null, 'module', 1, 1, 1",
        "'§/cart.py', 'Cart', 'class', 7, 7, 1",
        "'§/cart.py', 'Cart.add', 'method', 8, 15, 1",
        "'§/cart.py', 'Cart.add.inner', 'function', 9, 10, 1",
        "'§/cart.py', null, 'module', 1, 18, 1",
        "'§/pricing.py', 'helper', 'function', 10, 11, 1",
        "'§/pricing.py', 'total', 'function', 5, 7, 1",
        "'§/pricing.py', null, 'module', 1, 2, 1",
        "'§/tools/run_§.py', 'f', 'function', 5, 6, 1",
        "'§/tools/run_§.py', 'main', 'function', 1, 2, 1",
    ),
    "history_commits": _each(
        "ord, sha, authored_at, paths",
        "paths",
        "0, 'c4', '2024-01-04', 'b.py,new§.py'",
        "1, 'c3', '2024-01-03', 'b.py,new§.py'",
        "2, 'c2', '2024-01-02', 'c.py,new§.py'",
        "3, 'c1', '2024-01-01', 'new§.py'",
        of=_OF_CUSTOMERS,
    ),
    "history_pairs": _each(
        "left_path, right_path, shared, left_commits, right_commits, jaccard, last_together",
        "left_path, right_path",
        "'b.py', 'new§.py', 2, 2, 4, 0.5::double, '2024-01-04'",
        of=_OF_CUSTOMERS,
    ),
}
