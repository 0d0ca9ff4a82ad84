"""Secrets: by pattern, and by a battery of randomness tests on long tokens.

Tokens of 20 or more characters of [A-Za-z0-9+/_-] that hold letters and digits are candidates, outside what
the patterns found. The encoding is the smallest of hex, base32, base36, base62 and base64 whose alphabet holds
the token. Three statistics tell random draws of that alphabet from names made of words:

- chi-squared of uniformity over cells of the alphabet (vowels, common and other consonants, capitals, digits,
  symbols), as the root of its share per character: small for random tokens, large for words;
- runs of letters, capitals and digits: random tokens change kind often (a capital before a small letter is one kind);
- serial correlation of vowels at lag one: about none in random tokens, negative in words.

The null hypothesis is a name, so a discovery is a secret. Each statistic is standardised by its mean and spread
among names of that encoding and length (`NAMES`, calibrated on the long names of published Python packages), their sum
is taken at correlation RHO, and its tail is the p-value. Within each stratum of encoding and length, Benjamini-Hochberg
at rate `FDR` over the whole corpus bounds the share of names among the 'random' spans; short tokens, whose tests have
little power, never dilute long ones. The procedure needs only a histogram of -log10 p by stratum, whose size is bounded.

Everything runs as DataFrame operations. Defined results: null and empty texts hold nothing; repeated rows and null ids
count each for itself; an empty table gives an empty result; very long texts are scanned whole in time proportional to
their length and matches. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Written, table
from lodestar.llm.spans import blanked, cut, located, written_out

FDR = 0.01
RHO = 0.5
BINS_PER_DECADE = 50
MAX_BIN = 1000

KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (
        r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]+",
        "lower(__text) rlike 'passw(or)?d|secret|token|api_?key'",
    ),
    "access": (r"AKIA[A-Z0-9]{14,}", "contains(__text, 'AKIA')"),
    "hex": (r"[0-9a-f]{16,}", "__text rlike '[0-9a-f]{16}'"),
    "random": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", "__text rlike '[A-Za-z0-9+/_-]{20}'"),
}
HOLDS = {
    "assign": r"length(regexp_extract(s.hit, r'^[A-Za-z_]+[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?(.*)$', 1)) >= 12",
    "access": "true",
    "hex": "true",
    "random": "s.hit rlike '[0-9]' and s.hit rlike '[A-Za-z]'",
}
# The characters of each cell; the cells of each encoding with their numbers of characters.
CELL = {"V": "aeiou", "C": "tnsrldhcm", "O": "bfgjkpqvwxyz", "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "D": "0123456789", "S": "+/_-"}
HEX_CELL = {"E": "ae", "F": "bcdf", "L": "01234", "H": "56789"}
SHARES = {
    "hex": {"E": 2, "F": 4, "L": 5, "H": 5},
    "base32": {"V": 5, "C": 9, "O": 12, "D": 6},
    "base36": {"V": 5, "C": 9, "O": 12, "D": 10},
    "base62": {"U": 26, "V": 5, "C": 9, "O": 12, "D": 10},
    "base64": {"U": 26, "V": 5, "C": 9, "O": 12, "D": 10, "S": 2},
}


@dataclass(frozen=True)
class Names:
    """How the statistics of names spread: chi by chi_sd; runs like draws at rate runs; serial by serial_sd / sqrt(length)."""

    chi: float
    runs: float
    serial: float | None  # None: letters of this alphabet make no words
    chi_sd: float = 0.2
    serial_sd: float = 0.8


NAMES = {
    "hex": Names(0.95, 0.10, None, chi_sd=0.3),
    "base32": Names(0.78, 0.05, -0.33),
    "base36": Names(1.04, 0.05, -0.33),
    "base62": Names(1.25, 0.13, -0.39),
    "base64": Names(1.47, 0.25, -0.33),
}


def patterned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, __spans (start, rank, kind, end), __tokens: the candidates (start, end, hit) outside them."""
    slim = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    found = cut(slim, "__text", {k: PATTERNS[k] for k in KINDS})
    parts = [
        f"transform(filter({located(f'__g_{k}', f'__m_{k}')}, s -> {HOLDS[k]}), s -> struct(s.start, {n} as rank, '{k}' as kind, s.end))" for n, k in enumerate(KINDS)
    ]
    found = found.select(id_col, "__text", F.expr(f"array_sort(concat({', '.join(parts)}))").alias("__spans"))
    found = found.withColumn("__text", F.expr(blanked("__text", "transform(__spans, s -> struct(s.start, s.end))")))
    found = cut(found, "__text", {"random": PATTERNS["random"]})
    return found.select(id_col, "__spans", F.expr(f"filter({located('__g_random', '__m_random')}, s -> {HOLDS['random']})").alias("__tokens"))


def upper_tail(z: str) -> str:
    """SQL: the upper tail of the normal distribution, from above within 8 % where it is under a half."""
    side = lambda x: f"(exp(-({x}) * ({x}) / 2) * 2 / sqrt(2 * pi()) / (({x}) + sqrt(({x}) * ({x}) + 8 / pi())))"
    return f"(case when ({z}) >= 0 then {side(f'least(37D, {z})')} else 1 - {side(f'least(37D, -({z}))')} end)"


def _by_encoding(value) -> str:
    return "(case encoding " + " ".join(f"when '{e}' then {value(e)}" for e in SHARES) + " end)"


def _cells(cells: dict[str, str]) -> str:
    return f"translate(__t, '{''.join(cells.values())}', '{''.join(c * len(v) for c, v in cells.items())}')"


def tested(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Adds encoding, n, chi, runs, serial (null without both vowels and others), z and p of the column `token` (trailing = dropped)."""
    df = tokens.withColumn("__t", F.expr(f"rtrim('=', {token})")).withColumn("n", F.length("__t"))
    df = df.withColumn("encoding", F.expr("""case when __t rlike '^([0-9a-f]+|[0-9A-F]+)$' then 'hex' when __t rlike '^[A-Z2-7]+$' then 'base32'
        when __t rlike '^([a-z0-9]+|[A-Z0-9]+)$' then 'base36' when __t rlike '^[A-Za-z0-9]+$' then 'base62' else 'base64' end"""))
    df = df.withColumn("__v", F.expr("translate(lower(__t), 'aeioubcdfghjklmnpqrstvwxyz0123456789+/_-', concat(repeat('1', 5), repeat('0', 35)))"))
    df = df.withColumn("__t", F.expr("case when encoding in ('hex', 'base32', 'base36') then lower(__t) else __t end"))
    df = df.withColumn("__c", F.expr(f"case when encoding = 'hex' then {_cells(HEX_CELL)} else {_cells(CELL)} end"))
    part = lambda c, m, of: f"pow(double(length(__c) - length(replace(__c, '{c}', ''))) / n - {m / of}D, 2) / {m / of}D"
    df = df.withColumn("chi", F.expr("sqrt(" + _by_encoding(lambda e: " + ".join(part(c, m, sum(SHARES[e].values())) for c, m in SHARES[e].items())) + ")"))
    df = df.withColumn("__k", F.expr("translate(__c, 'VCOEFLH', 'lllllDD')"))
    df = df.withColumn("runs", F.expr(r"double(length(regexp_replace(__k, r'(.)\1*+', 'x')) - 1 - (length(__k) - length(replace(__k, 'Ul', ''))) / 2) / (n - 1)"))
    df = df.withColumn("__n1", F.expr("double(length(replace(__v, '0', '')))")).withColumn("__m", F.expr("__n1 / n"))
    df = df.withColumn("__both", F.expr("__n1 - length(replace(regexp_replace(__v, '1++', '1'), '0', ''))"))
    ends = "int(substring(__v, 1, 1)) - int(substring(__v, -1, 1))"
    df = df.withColumn("serial", F.expr(f"case when __n1 > 0 and __n1 < n then (__both - __m * (2 * __n1 - {ends}) + (n - 1) * __m * __m) / (__n1 * (1 - __m)) end"))
    z = [f"({_by_encoding(lambda e: f'{NAMES[e].chi}D')} - chi) / {_by_encoding(lambda e: f'{NAMES[e].chi_sd}D')}",
         f"(runs - {_by_encoding(lambda e: f'{NAMES[e].runs}D')}) / sqrt({_by_encoding(lambda e: f'{NAMES[e].runs * (1 - NAMES[e].runs)}D')} / (n - 1))",
         f"coalesce((serial - {_by_encoding(lambda e: 'null' if NAMES[e].serial is None else f'{NAMES[e].serial}D')}) * sqrt(n) / {_by_encoding(lambda e: f'{NAMES[e].serial_sd}D')}, 0D)"]
    df = df.withColumn("z", F.expr(f"(({z[0]}) + ({z[1]}) + ({z[2]})) / sqrt({3 + 6 * RHO}D)")).withColumn("p", F.expr(upper_tail("z")))
    return df.drop(*[c for c in df.columns if c.startswith("__") and c not in tokens.columns])


def rejected_from(rated: DataFrame) -> DataFrame:
    """(stratum, cut): by Benjamini-Hochberg, tokens in bins of -log10 p at or above `cut` are no names; no row where none is."""
    counts = rated.groupBy("stratum", "bin").agg(F.count("*").alias("m"))  # strata times MAX_BIN rows at most
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    all_ = Window.partitionBy("stratum")
    ranked = counts.select("stratum", "bin", F.sum("m").over(down).alias("upto"), F.sum("m").over(all_).alias("total"))
    # All p of a bin are at most 10 ** (-bin / BINS_PER_DECADE).
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= FDR * F.col("upto") / F.col("total"))
    return passed.groupBy("stratum").agg(F.min("bin").alias("cut"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    keep = Written(docs.sparkSession)
    found = keep(patterned(docs, id_col, text_col).withColumn("__row", F.monotonically_increasing_id()))
    tokens = found.where("size(__tokens) > 0").select("__row", F.explode("__tokens").alias("t")).select("__row", "t.start", "t.end", F.col("t.hit").alias("token"))
    rated = tested(tokens).withColumn("stratum", F.expr("concat(encoding, ':', least(8, int(log2(n / 20) * 2)))"))
    rated = keep(rated.select("__row", "start", "end", "stratum", F.expr(f"int(least({MAX_BIN}, floor(-log10(greatest(p, 1e-300)) * {BINS_PER_DECADE})))").alias("bin")))
    held = rated.join(F.broadcast(rejected_from(rated)), "stratum").where("bin >= cut")  # a row a stratum at most
    random = held.groupBy("__row").agg(F.expr(f"collect_list(struct(start, {len(KINDS)} as rank, 'random' as kind, end))").alias("__random"))
    rows = found.join(random, "__row", "left").withColumn("__all", F.expr("array_sort(concat(__spans, coalesce(__random, array())))"))
    counts = [F.expr(f"bigint(size(filter(__all, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in (*KINDS, "random")]
    return rows.select(id_col, *counts, F.expr(f"sha2({written_out('__spans')}, 256)").alias("base_sha256"), F.expr(written_out("__all")).alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
