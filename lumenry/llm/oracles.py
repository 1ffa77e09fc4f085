"""SQL that says the same as operators that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = f"""
with recursive d as (select doc_id, {WORDS.format(LOWERED)} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as id, doc_id as c from d union select e.y, r.c from r join e on e.x = r.id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id from d left join n using (doc_id) join (select id, min(c) as c from r group by 1) m on m.id = d.doc_id"""


def covered(n: int) -> str:
    """Places of words inside windows of n words that a text holds twice or more."""
    return f"""
g{n} as (select doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {n - 2})) as i from d)),
c{n} as (select distinct doc_id, unnest(range(i, i + {n})) as i from (select doc_id, i, count(*) over (partition by doc_id, g) as k from g{n}) where k > 1),
s{n} as (select doc_id, count(*) as n, sum(length(w[i])) as chars from c{n} join d using (doc_id) group by 1)"""


def quality(rules) -> str:
    sizes = [rules.repeat_window, *rules.ngram_share]
    joins = "".join(f" left join s{n} using (doc_id)" for n in sizes)
    share = lambda n: f"coalesce(s{n}.chars, 0)::double / greatest(word_chars, 1)"
    limits = "".join(f" and {share(n)} <= {most}" for n, most in rules.ngram_share.items())
    return rf"""
with d as (select doc_id, coalesce(text, '') as text, {WORDS.format("coalesce(text, '')")} as w from documents),{",".join(covered(n) for n in sizes)},
lines as (select doc_id, row_number() over () as place, unnest(string_split(text, chr(10))) as line from d),
told as (select doc_id, line, row_number() over (partition by doc_id, line order by place) as k, list_sum(list_transform({WORDS.format('line')}, lambda x: length(x))) as chars from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
dups as (select doc_id, count(*) as n, sum(chars) as chars from told where k > 1 group by 1),
b as (select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols from d),
f as (select b.*, coalesce(dups.n, 0) as n_dup_lines, coalesce(s{rules.repeat_window}.n, 0) as n_repeat_words, coalesce(dups.chars, 0)::double / greatest(word_chars, 1) as dup_line_share,
  [{", ".join(share(n) for n in rules.ngram_share)}] as ngram_shares, n_symbols <= {rules.symbols_per_word} * n_words and coalesce(dups.chars, 0)::double / greatest(word_chars, 1) <= {rules.dup_line_share}{limits} as fine from b left join dups using (doc_id){joins})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fine and not base_failed as kept, dup_line_share, ngram_shares
from (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.repeat_percent} * n_words as base_failed from f)"""

FILL_IN_MIDDLE = """
with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
l as (select *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') as lines, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select *, len(lines) as n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as z from l),
p as (select doc_id, text, n, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
  array_to_string(lines[1:a], '') as prefix, array_to_string(lines[a + 1:z], '') as middle, array_to_string(lines[z + 1:], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(prefix || middle || suffix) as restored_sha256 from p"""



def _climb(nodes: str, name: str, index: str, levels: int) -> tuple[str, str, list[str], list[str]]:
    """Runs and nodes of each level over nodes(key, i, n, h), as common table expressions; the joins of a row's runs, its
    siblings on each level, and what each level makes of {0}, a digest on the row's way up."""
    tables, joins, siblings, steps = [f"{name}0 as ({nodes})"], [], [], []
    for k in range(levels):
        n, hs, run, at = f"{name}n{k}", f"{name}hs{k}", f"{name}r{k}", f"({index} // {8**k} % 8)"
        left, right = f"array_to_string({hs}[1:{at}], '')", f"array_to_string({hs}[{at} + 2:], '')"
        tables.append(f"{run} as (select key as {run}key, i // 8 as {run}at, any_value(n) as {n}, list(h order by i) as {hs} from {name}{k} group by 1, 2)")
        tables.append(f"{name}{k + 1} as (select {run}key as key, {run}at as i, ({n} + 7) // 8 as n, case when {n} = 1 then {hs}[1] else sha256(array_to_string({hs}, '')) end as h from {run})")
        joins.append(f"join {run} on {run}key = {name}key and {run}at = {index} // {8 ** (k + 1)}")
        siblings.append(f"case when {n} = 1 then '' else {left} || {right} end")
        steps.append(f"case when {n} = 1 then {{0}} else sha256({left} || {{0}} || {right}) end")
    return ",\n".join(tables), " ".join(joins), siblings, steps


def merkle(levels: int = 6, over: int = 2) -> str:
    """Whole for up to 8 ** levels rows a group and 8 ** over groups."""
    value = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(value(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    byte = "list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: unicode(c)::bigint)), lambda a, c: {byte}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    below, joins, siblings, steps = _climb("select akey as key, ai as i, n, h from leaves", "a", "ai", levels)
    above, over_joins, over_siblings, over_steps = _climb("select '' as key, row_number() over (order by key) - 1 as i, count(*) over () as n, h, key as of from t", "b", "bi", over)
    every = [*steps, *over_steps]
    folds = ",\n".join(f"f{k + 1} as (select * exclude (fold), {step.format('fold')} as fold from f{k})" for k, step in enumerate(every))
    return f"""
with leaves as (select doc_id, coalesce('=' || lang, '') as akey, row_number() over (partition by lang order by doc_id nulls first) - 1 as ai, count(*) over (partition by lang) as n, {leaf("text")} as h, case when {crc} % 3 = 0 then {leaf(lower)} end as other from documents),
{below},
t as (select key, h from a{levels}),
{above},
tops as (select of, h as subroot, i as bi, key as bkey from b0),
f0 as (select doc_id, leaves.h as leaf, subroot, b{over}.h as root, * exclude (doc_id, h, subroot, key, i, n), sha256({" || ".join([*siblings, *over_siblings])}) as proof_sha256, coalesce(other, leaves.h) as fold
  from leaves join tops on of = akey {joins} {over_joins} cross join b{over}),
{folds}
select doc_id, leaf, subroot, root, proof_sha256, fold as folded_root, fold = root as verified from f{len(every)}"""
