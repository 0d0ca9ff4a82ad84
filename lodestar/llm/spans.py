"""Native location and replacement of regular-expression matches, in code points, without Python on the executors.

Arrays have no running sum in SQL, and an aggregate that appends to an array copies it at every step. `scan` appends
to arrays of STEP elements at most: groups of STEP * STEP first carry their totals, then groups of STEP inside them,
then elements, so time grows with the number of matches, not with its square. Texts are cut into pieces of CUT code
points before parts are taken from them, for a substring is found by counting from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,hit:string>>"
STEP = 24
CUT = 1000


def sql_text(pattern: str) -> str:
    """A raw SQL literal; patterns here hold no apostrophe but as \\x27."""
    return f"r'{pattern}'"


def bound(value: str, name: str, body: str) -> str:
    """SQL: body with `name` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scan(items: str, start: str, step: str, made: str, kind: str) -> str:
    """SQL: `made` of every item x and the state a before it, as an array of type `kind`.

    step and made are expressions over a and x; the state is an int that begins as `start`.
    """
    fold = lambda of, first: f"aggregate({of}, int({first}), (a, x) -> int({step}))"

    def level(of: str, first: str, widths: list[int]) -> str:
        if not widths:
            return f"""aggregate({of}, struct(int({first}) as a, cast(array() as {kind}) as out),
                (s, x) -> {bound('s.a', 'a', f'struct(int({step}) as a, concat(s.out, array({made})) as out)')}, s -> s.out)"""
        n = widths[0]
        groups = f"transform(sequence(0, (size({of}) - 1) div {n}), i -> slice({of}, i * {n} + 1, {n}))"
        name = f"g{n}"
        firsts = f"""aggregate({name}, struct(int({first}) as a, cast(array() as array<int>) as out),
            (s, y) -> struct({fold('y', 's.a')} as a, concat(s.out, array(s.a)) as out), s -> s.out)"""
        inner = level(f"y{n}", f"b{n}", widths[1:])
        return bound(groups, name, f"flatten(zip_with({name}, {firsts}, (y{n}, b{n}) -> {inner}))")

    few, many = level("items", start, []), level("items", start, [STEP * STEP, STEP])
    return bound(items, "items", f"case when size(items) <= {STEP} then {few} else {many} end")


def cut(df: DataFrame, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds, for each kind, the pieces between its matches (__g_kind) and the matches (__m_kind).

    patterns: kind -> (pattern, condition under which the text can hold a match at all). split and
    regexp_extract_all find the same leftmost non-overlapping matches, so lengths give places.
    """
    for kind, (pattern, may) in patterns.items():
        p = sql_text(pattern)
        df = df.withColumn(f"__m_{kind}", F.expr(f"case when {may} then regexp_extract_all({text}, {p}, 0) else cast(array() as array<string>) end"))
        df = df.withColumn(f"__g_{kind}", F.expr(f"case when size(__m_{kind}) > 0 then split({text}, {p}, -1) else cast(array() as array<string>) end"))
    return df


def located(gaps: str, hits: str, offset: str = "0") -> str:
    """SQL: the places of `hits` between `gaps`, as SPAN."""
    items = f"zip_with(slice({gaps}, 1, size({hits})), {hits}, (g, h) -> struct(length(g) as gap, length(h) as n, h as hit))"
    return scan(items, offset, "a + x.gap + x.n", "struct(int(a + x.gap) as start, int(a + x.gap + x.n) as end, x.hit as hit)", SPAN)


def written_out(spans: str) -> str:
    """SQL: kind:start:end of each span, comma-joined."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def _with_cuts(text: str, body: str) -> str:
    return bound(f"regexp_extract_all({text}, r'(?s).{{1,{CUT}}}', 0)", "cuts", body)


def _piece(low: str, high: str) -> str:
    """SQL: the code points from low up to high of the text that is cut into `cuts`."""
    at = lambda k: f"coalesce(get(cuts, {k} div {CUT}), '')"
    part = f"""case when i >= j then '' when i div {CUT} = j div {CUT} then substring({at('i')}, i % {CUT} + 1, j - i)
        else concat(substring({at('i')}, i % {CUT} + 1), array_join(slice(cuts, i div {CUT} + 2, j div {CUT} - i div {CUT} - 1), ''), substring({at('j')}, 1, j % {CUT})) end"""
    return bound(low, "i", bound(high, "j", part))


def around(text: str, spans: str, width: int) -> str:
    """SQL: for each span (of) what stands in `width` code points before and after it."""
    sides = f"struct(s as of, {_piece(f'greatest(s.start - {width}, 0)', 's.start')} as before, {_piece('s.end', f'least(s.end + {width}, total)')} as after)"
    return bound(text, "whole", bound("length(whole)", "total", _with_cuts("whole", f"transform({spans}, s -> {sides})")))


def _rebuilt(text: str, spans: str, fields: str, filler: str) -> str:
    """SQL: the text with `filler` for each span s, sorted by start. fresh: where the text that no span before s covers begins."""
    passed = scan("spans", "0", "greatest(a, x.end)", "struct(a as fresh, x as s)", f"array<struct<fresh:int,s:struct<start:int,end:int{fields}>>>")
    one = f"concat({_piece('fresh', 's.start')}, {filler})"
    shown = f"array_join(transform({passed}, p -> {bound('p.s', 's', bound('p.fresh', 'fresh', one))}), '')"
    rest = _piece("aggregate(spans, 0, (a, x) -> int(greatest(a, x.end)))", "length(whole)")
    made = f"case when size(spans) = 0 then whole else {_with_cuts('whole', f'concat({shown}, {rest})')} end"
    return bound(text, "whole", bound(spans, "spans", made))


def replaced(text: str, spans: str) -> str:
    """SQL: the text with each (start, end, to) of `spans`, sorted by start, replaced; one that starts inside an earlier one goes with it."""
    return _rebuilt(text, spans, ",to:string", "case when s.start >= fresh then s.to else '' end")


def blanked(text: str, spans: str) -> str:
    """SQL: the text with blanks for each (start, end) of `spans`, sorted by start, so that places stay."""
    return _rebuilt(text, spans, "", "repeat(' ', greatest(0, s.end - greatest(fresh, s.start)))")
