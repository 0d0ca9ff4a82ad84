"""DuckDB SQL for what SQL can express of the operators: all of op6 and op7, and the base columns of op3, op4, op5 and op10."""

from __future__ import annotations

from lodestar.llm.licenses import BASE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROWS = r"d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents)"
_WORDS = _ROWS + r", w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d)"

OP6 = """with recursive good as (select vec_id, label, embedding::double[] as v from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
  links as (select a.vec_id as u, b.vec_id as v from good a join good b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.93),
  reach as (select vec_id as node, vec_id as root from embeddings union select l.v, r.root from reach r join links l on l.u = r.node),
  n as (select u, count(*) as n from links group by u), least_ as (select node, min(root) as root from reach group by node)
select vec_id, coalesce(n, 0) as n_links, root as component_id, vec_id = root as kept from embeddings join least_ on node = vec_id left join n on u = vec_id"""

OP7 = f"""with {_WORDS},
  places as (select rid, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35),
  windows as (select rid, i, array_to_string(ws[i:i + 34], ' ') as x from places),
  twice as (select x from windows group by x having count(*) > 1),
  gone as (select distinct rid, unnest(range(i, i + 35)) as p from windows join twice using (x)),
  each as (select rid, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
  stays as (select rid, string_agg(word, ' ' order by p) as kept from each anti join gone using (rid, p) group by rid),
  n as (select rid, count(*) as n from gone group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join n using (rid) left join stays using (rid)"""

OP4_BASE = f"""with {_WORDS},
  places as (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3),
  windows as (select rid, i, array_to_string(ws[i:i + 2], ' ') as x from places),
  twice as (select rid, x from windows group by rid, x having count(*) > 1),
  covered as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 3)) as p from windows join twice using (rid, x)) group by rid),
  lines as (select rid, count(*) - count(distinct line) as n from (select rid, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by rid),
  counted as (select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    coalesce(l.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words from w left join lines l using (rid) left join covered c using (rid))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted"""

OP3_BASE = (
    "with " + _ROWS + rf", w as (select rid, doc_id, regexp_extract_all(translate(t, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from d), places as ("
    + " union all ".join(
        f"select rid, i - 1 as i, '{label}' as label from (select rid, ws, unnest(range(1, len(ws) - {len(phrase.split()) - 2})) as i from w) where array_to_string(ws[i:i + {len(phrase.split()) - 1}], ' ') = '{phrase}'" for phrase, label in BASE
    ) + """), found as (select rid, count(*) as n, min(i) as low, max(i) as high, array_to_string(list_sort(list(distinct label)), ',') as labels from places group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0) as n_base, low as first_word, high as last_word, coalesce(labels, '') as base_labels from w left join found using (rid)"""
)


def _spans(kinds: list[tuple[str, str, str]], order: str) -> str:
    """(rid, kind, start, end) of each match that holds: matches and the gaps between them give the places."""
    parts = []
    for n, (kind, pattern, holds) in enumerate(kinds):
        p = pattern.replace("'", "''")
        parts.append(f"""select rid, {n} as rank, '{kind}' as kind, (gaps + hits - length(h))::bigint as a, (gaps + hits)::bigint as b, h from (
          select rid, h, i, sum(length(h)) over (partition by rid order by i) as hits, sum(length(g)) over (partition by rid order by i) as gaps from (
            select rid, unnest(hs) as h, unnest(gs[:len(hs)]) as g, generate_subscripts(hs, 1) as i from (select rid, regexp_extract_all(t, '{p}') as hs, string_split_regex(t, '{p}') as gs from d)))
          where {holds}""")
    counts = ", ".join(f"count_if(kind = '{k}') as n_{k}" for k, *_ in kinds)
    return f"""with {_ROWS}, spans as ({' union all '.join(parts)}),
      found as (select rid, {counts}, string_agg(kind || ':' || a || ':' || b, ',' order by {order}) as s from spans group by rid)
    select doc_id, {', '.join(f'coalesce(n_{k}, 0) as n_{k}' for k, *_ in kinds)}, sha256(coalesce(s, '')) as base_sha256 from d left join found using (rid)"""


_D = "regexp_replace(h, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_D}) + 1), lambda i: case when i % 2 = 1 then {_D}[-i]::int when {_D}[-i]::int < 5 then 2 * {_D}[-i]::int else 2 * {_D}[-i]::int - 9 end)) % 10 = 0"
OP5_BASE = _spans(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(h, '.'), lambda x: length(ltrim(x, '0')) > 3 or right('000' || x, 3)::int > 255)) = 0"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_D}) between 13 and 19 and {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_D}) between 9 and 15"),
    ],
    "rank, a",
)
OP10_BASE = _spans(
    [
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""length(regexp_extract(h, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 12"""),
        ("access", r"AKIA[A-Z0-9]+", "length(h) >= 18"),
        ("hex", r"[0-9a-f]+", "length(h) >= 16"),
    ],
    "a, rank",
)
