"""SQL that DuckDB runs for the rows of op11_fim, op12_pii and op13_divergence."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from loomfactor.llm.pii import ACCOUNT_CUES, BASE, IBAN_LENGTH, KINDS, SECRET_CUES

_LOW = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"

FIM = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens from documents
), n as (
  select *, len(tokens) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from n
), p as (
  select *, array_to_string(tokens[1:a], '') as prefix, array_to_string(tokens[a + 1:b], '') as middle, array_to_string(tokens[b + 1:n], '') as suffix from c
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from p
"""

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, 1 + length({_DIGITS})), lambda i: list_extract([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9], 1 + {_DIGITS}[-i]::int + 10 * ((i + 1) % 2)))) % 10 = 0"
_ALPHABET = "0123456789" + ascii_lowercase
_PLAIN = "replace(v, ' ', '')"
_MOD97 = f"list_reduce(list_transform(range(1, 1 + length({_PLAIN})), lambda i: instr('{_ALPHABET}', ({_PLAIN}[5:] || {_PLAIN}[1:4])[i]) - 1), lambda x, y: (x * if(y > 9, 100, 10) + y) % 97) = 1"
#: Kind -> (pattern with what stands before the span as its first group, or none; what a span must fulfil).
_PATTERNS = {
    "email": (r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "coalesce(list_max(list_transform(string_split(v, '.'), lambda x: coalesce(try_cast(x as hugeint), 999))) <= 255, false)"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) between 16 and 19 and {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 8 and 15"),
    "account": (rf"(\b(?:{'|'.join(ACCOUNT_CUES)})(?: number| no)?\.? ?[:=#]? ?)[a-z]{{0,4}}[0-9](?:[ -]?[0-9])*", f"length({_DIGITS}) between 6 and 30"),
    "iban": (rf"(\biban[:=]? ?)(?:{'|'.join(f'{c}[0-9]{{2}}(?: ?[a-z0-9]){{{n - 4}}}' for c, n in IBAN_LENGTH.items())})", _MOD97),
    "login": (r'[a-z][a-z0-9+.-]*://[^\x00-\x20/?#@"<>]+@[a-z0-9.-]+', "true"),
    "secret": (rf'(\b(?:{"|".join(SECRET_CUES)}) ?[=:] ?["\x27]?)[a-z0-9_./+=~-]{{6,}}', "true"),
}


def _found(number: int, kind: str) -> str:
    pattern, holds = _PATTERNS[kind]
    before = f"regexp_extract_all(low, '{pattern}', 1)" if pattern.startswith("(") else "[]::varchar[]"
    return f"""
  select r, {number} as k, '{kind}' as kind, a, z from (
    select r, m[i][1 + coalesce(length(b[i]), 0):] as v, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as o,
      o + coalesce(length(b[i]), 0) as a, o + length(m[i]) as z
    from (select *, unnest(range(1, 1 + len(m))) as i from (
      select r, regexp_extract_all(low, '{pattern}') as m, {before} as b, string_split_regex(low, '{pattern}') as s from d))
  ) where {holds}"""


PII = f"""
with d as (select row_number() over () as r, doc_id, {_LOW} as low from documents
), f as ({" union all ".join(_found(i, kind) for i, kind in enumerate(KINDS))}
), g as (select r, {", ".join(f"count(*) filter (kind = '{kind}') as n_{kind}" for kind in BASE)},
    string_agg(kind || ':' || a || ':' || z, ',' order by k, a) filter (k < {len(BASE)}) as base, string_agg(kind || ':' || a || ':' || z, ',' order by k, a) as spans from f group by r)
select doc_id, {", ".join(f"coalesce(n_{kind}, 0) as n_{kind}" for kind in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (r)
"""

DIVERGENCE = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {_LOW} as low from documents
), w as (select r, lang, source, unnest(regexp_extract_all(low, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), k as (select lang, term from w group by all having count(distinct r) >= 3
), g as (select distinct lang, source from d
), c as (select lang, source, term, count(*) as n from w group by all
), n as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join k using (lang) left join c using (lang, source, term)
), p as (
  select *, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over (partition by lang, source) + count(*) over (partition by lang, source)) as p from n
), l as (
  select lang, term, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over (partition by lang) + count(*) over (partition by lang)) as q from (select lang, term, sum(n) as n from n group by all)
), e as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(v, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source as s, b.source as o, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as v from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) x
    on x.lang = a.lang and x.s = a.source and x.o = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q)) // q from p join l using (lang, term) where n > 0 and p > q
)
select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from e qualify part = 'pair' or rank <= 200
"""
