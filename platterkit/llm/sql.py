"""The subpackage's queries in DuckDB's SQL, where SQL can state them."""

from __future__ import annotations

_ITEMS = """
valid as (select id, arg_max(struct_pack(g := genres, s := styles), last_synced_at) v from releases where id is not null group by 1),
items as (select distinct id, i from (
  select id, 'g:' || lower(trim(x)) i from (select id, unnest(v.g) x from valid) where trim(x) <> ''
  union all select id, 's:' || lower(trim(x)) from (select id, unnest(v.s) x from valid) where trim(x) <> '')),
c as (select i, count(*) c from items group by 1),
n as (select count(*) n from valid),
pairs as (select a.i item_a, b.i item_b, count(*) c_ab from items a join items b on a.id = b.id and a.i < b.i group by 1, 2),
counted as (select item_a, item_b, c_ab, x.c c_a, y.c c_b, n from pairs join c x on x.i = item_a join c y on y.i = item_b, n)
"""


# Problem 3 said in SQL alone: characters that can't be seen go, wide forms become narrow ones, composed accents and hand-listed look-alikes follow.
_LOOKS = ("АВЕКМНОРСТХУІЈЅаеорсухіјѕһԁԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲɑɡı", "ABEKMHOPCTXYIJSaeopcyxijshdqwlABEZHIKMNOPTYXocagi")
_WIDE = """array_to_string(list_transform(string_split(regexp_replace({t}, '[\\x{{AD}}\\x{{34F}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g'), ''),
  lambda c: case when ord(c) between 65281 and 65374 then chr(ord(c) - 65248) when ord(c) in (160, 8239, 12288) or ord(c) between 8192 and 8202 then ' ' when c = 'ﬁ' then 'fi' when c = 'ﬂ' then 'fl' when c = 'ﬀ' then 'ff' when c = 'ﬃ' then 'ffi' when c = 'ﬄ' then 'ffl' else c end), '')"""


def _plain(column: str) -> str:
    wide = _WIDE.format(t=column)
    return f"trim(regexp_replace(nfc_normalize(translate({wide}, '{_LOOKS[0]}', '{_LOOKS[1]}')), '\\s+', ' ', 'g'))"


def _pairs(src: str, column: str, within: str) -> str:
    return f"""
select distinct '{src}' src, a.id id_a, b.id id_b
from (select distinct id, {within} w, {column} t, {_plain(column)} k from {src} where {column} is not null) a
join (select distinct id, {within} w, {column} t, {_plain(column)} k from {src} where {column} is not null) b
  on a.w = b.w and a.k = b.k and a.id < b.id and a.t <> b.t and a.k <> ''
"""


# Problem 9 in characters: the level at which the budget is used up lies before the first end of a source by which the sources have given it.
_MIXED = """
with g as (select source, max(target_share) share, greatest(max(max_repeats), 1) reps from mix_targets where target_share > 0 and source is not null group by 1),
d as (select min(doc_id) doc_id, arg_min(source, doc_id) source, any_value(length("text"))::bigint n from documents semi join g using (source) where doc_id is not null and "text" <> '' group by "text"),
p as (select g.*, own, share / sum(share) over () w, reps * own cap, sum(own) over () * 1.0::double budget from g join (select source, sum(n)::bigint own from d group by 1) using (source)),
e as (select a.source, a.cap / a.w r, sum(case when b.cap / b.w < a.cap / a.w then b.cap else 0 end) given, sum(case when b.cap / b.w < a.cap / a.w then 0 else b.w end) going, any_value(a.budget) budget from p a, p b group by a.source, a.cap, a.w),
l as (select coalesce(arg_min((budget - given) / going, r) filter (where given + r * going >= budget), max(r)) level from e),
o as (select d.*, p.*, sum(n) over (partition by d.source order by md5('7:' || doc_id), doc_id) place from d join p on p.source = d.source),
q as (select o.source, doc_id, (i + 1)::int use_no, n n_tokens, (place + i * own) / w finish from o, l, (select unnest(range(1000)) i) where i < reps and (place + i * own) / w <= level * (1 + 1e-12::double))
"""


ORACLES: dict[str, str] = {
    "p9_mixture_chars": _MIXED + "select source, doc_id, use_no, n_tokens, round(finish, 2) finish from q",
    "p9_shares_chars": _MIXED + "select p.source, own source_tokens, coalesce(u, 0)::bigint used_tokens, round(coalesce(u / sum(u) over (), 0), 8) actual_share, round(budget, 2) budget from p left join (select source, sum(n_tokens) u from q group by 1) using (source)",
    "p3_found": " union all ".join(_pairs(*x) for x in (("artists", "name", "0"), ("tracks", "title", "release_id"), ("release_videos", "title", "release_id"))),
    "p6_found": f"with {_ITEMS} select item_a, item_b from counted where c_ab >= 5 and 1000 * c_ab >= n and c_ab * n >= 3 * c_a * c_b",
    "p6_pairs": f"""with {_ITEMS} select item_a, item_b, c_ab, c_a, c_b, n,
 round((c_ab + 0.5::double) * (n - c_a - c_b + c_ab + 0.5::double) / ((c_a - c_ab + 0.5::double) * (c_b - c_ab + 0.5::double)), 6) odds_ratio from counted""",
}
