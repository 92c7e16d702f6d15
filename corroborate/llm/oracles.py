"""DuckDB SQL with the rows of those corpus queries that SQL can express.

Each states what the query returns by comparing everything with everything, so it is for small tables.
"""

from __future__ import annotations

from corroborate.llm import chat_format, licenses

UPPER, LOWER = licenses.UPPER, licenses.LOWER
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
BREAK = licenses.BREAK

NEAR = rf"""with recursive d as materialized (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACE}'), lambda x: x <> '') as w from documents),
 g as materialized (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
 e as materialized (select doc_id, len(s) as n, unnest(s) as x from g),
 p as materialized (select a.doc_id as a, b.doc_id as b, any_value(a.n) + any_value(b.n) as two, count(*) as same from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
 l as materialized (select a, b from p where 100 * same >= 85 * (two - same)),
 r as (select doc_id as node, doc_id as root from d union select l.b, r.root from r join l on l.a = r.node where r.root < l.b)
 select g.doc_id, cast(len(s) as bigint) as n_shingles, m.root as component_id, g.doc_id = m.root as kept from g join (select node, min(root) as root from r group by 1) m on m.node = g.doc_id"""

# Runs are the shortest ones with 20 words that start, or end, at a line with a word.
LINES = rf"""with t as materialized (select doc_id, text, string_split(text, chr(10)) as ls from documents),
 e as (select doc_id, ls, unnest(range(1, len(ls) + 1)) as k from t),
 w as materialized (select doc_id, k, list_filter(regexp_split_to_array(translate(ls[k], '{UPPER}', '{LOWER}'), '{SPACE}'), lambda x: x <> '') as ws from e),
 o as materialized (select doc_id, k, row_number() over (partition by doc_id order by k) as i, len(ws) as n, array_to_string(ws, ' ') as line, sum(len(ws)) over (partition by doc_id order by k) as upto from w where len(ws) > 0),
 f as (select a.doc_id, a.i as first, min(b.i) as last from o a join o b on b.doc_id = a.doc_id and b.i >= a.i and b.upto - a.upto + a.n >= 20 group by 1, 2),
 q as (select b.doc_id, max(a.i) as first, b.i as last from o a join o b on b.doc_id = a.doc_id and b.i >= a.i and b.upto - a.upto + a.n >= 20 group by b.doc_id, b.i),
 s as materialized (select doc_id, first, last from f union select doc_id, first, last from q),
 h as materialized (select s.doc_id, first, last, string_agg(line, chr(10) order by i) as run from s join o on o.doc_id = s.doc_id and o.i between first and last group by 1, 2, 3),
 m as (select run, min(doc_id) as holder from h group by 1),
 x as materialized (select h.doc_id, first, last, holder from h join m using (run) where holder < h.doc_id),
 gone as materialized (select distinct o.doc_id, o.k from x join o on o.doc_id = x.doc_id and o.i between first and last),
 src as (select doc_id, list_sort(list(distinct holder)) as source_ids from x group by 1),
 left_ as (select e.doc_id, string_agg(ls[e.k], chr(10) order by e.k) as text from e left join gone g on g.doc_id = e.doc_id and g.k = e.k where g.k is null group by 1),
 n as (select doc_id, count(*) as n_removed from gone group by 1)
 select t.doc_id, case when n_removed is null then t.text else coalesce(left_.text, '') end as text, coalesce(n_removed, 0) as n_removed, coalesce(array_to_string(source_ids, ','), '') as source_ids
 from t left join n using (doc_id) left join src using (doc_id) left join left_ using (doc_id)"""

# Of all windows the best starts with a shingle of the item; similarity by counts of shingles.
LEAKS = rf"""with d as materialized (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{BREAK}'), lambda x: x <> '') as w from documents),
 i as materialized (select item_id, len(w) as n, least(5, len(w)) as size, w from (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{BREAK}'), lambda x: x <> '') as w from benchmark) where len(w) > 0),
 ig as materialized (select item_id, n, size, n - size + 1 as m, array_to_string(w[k : k + size - 1], ' ') as g, count(*) as c from (select *, unnest(range(1, n - size + 2)) as k from i) group by all),
 z as (select distinct size from i),
 dg as materialized (select doc_id, size, k, len(w) - size + 1 as total, array_to_string(w[k : k + size - 1], ' ') as g from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from d cross join z)),
 st as materialized (select distinct doc_id, item_id, n, dg.size, m, dg.k as pos, total from dg join ig on ig.size = dg.size and ig.g = dg.g),
 wc as (select st.doc_id, st.item_id, pos, any_value(m) as m, least(any_value(m), any_value(st.total) - pos + 1) as mw, dg.g, count(*) as c from st join dg on dg.doc_id = st.doc_id and dg.size = st.size and dg.k between pos and pos + m - 1 group by st.doc_id, st.item_id, pos, dg.g),
 sc as (select doc_id, item_id, pos, sum(least(wc.c, ig.c)) as same, any_value(wc.m) + any_value(mw) as two from wc join ig using (item_id, g) group by 1, 2, 3),
 best as (select doc_id, item_id, max(same / (two - same)) as similarity from sc where same / (two - same) >= 0.8 group by 1, 2),
 f as (select doc_id, list_sort(list(item_id)) as item_ids, max(similarity) as similarity from best group by 1)
 select d.doc_id, f.doc_id is not null as contaminated, coalesce(array_to_string(item_ids, ','), '') as item_ids, coalesce(similarity, 0.0) as similarity from d left join f using (doc_id)"""


def _phrase(words: list[str], at: str = "i") -> str:
    return " and ".join(f"w[{at} + {k}] = '{x}'" for k, x in enumerate(words))


def licenses_sql(templates=licenses.TEMPLATES) -> str:
    """Places of every key phrase, the share of the whole notice around each, and the base phrases."""
    base = " union all ".join(f"select doc_id, '{label}' as label, i - 1 as pos from e where {_phrase(p.split())}" for p, label in licenses.BASE)
    parts = []
    for label, notice, key in templates:
        words, must = notice.split(), key.split()
        at = next(k for k in range(len(words)) if words[k : k + len(must)] == must)
        share = " + ".join(f"cast(coalesce(i + {k - at} >= 1 and w[i + {k - at}] = '{x}', false) as int)" for k, x in enumerate(words))
        parts.append(f"select doc_id, '{label}' as label, ({share}) / {len(words)} as share from e where {_phrase(must)}")
    return rf"""with d as materialized (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAK}'), lambda x: x <> '') as w from documents),
 e as materialized (select doc_id, w, i from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
 b as ({base}), t as ({" union all ".join(parts)}),
 bs as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list_distinct(list(label)) as base from b group by 1),
 ts as (select doc_id, count(*) as n_places, max(share) as share, list_distinct(list(label)) as more from t group by 1)
 select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') as base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') as labels, greatest(coalesce(share, 0.0), case when n_base > 0 then 0.5 else 0.0 end) as score, coalesce(n_places, 0) as n_places
 from d left join bs using (doc_id) left join ts using (doc_id)"""


QUALITY = rf"""with d as materialized (select doc_id, coalesce(source, chr(1)) as host, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') as w,
   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as ls from documents),
 g as materialized (select doc_id, i, array_to_string(w[i : i + 4], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)),
 again as (select doc_id, i from g join (select doc_id, gram from g group by 1, 2 having count(*) > 1) using (doc_id, gram)),
 rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from again) group by 1),
 li as materialized (select doc_id, host, t, trim(regexp_replace(lower(l), '{SPACE}', ' ', 'g'), ' ') as line, len(list_filter(regexp_split_to_array(l, '{SPACE}'), lambda x: x <> '')) as n from (select doc_id, host, t, unnest(ls) as l from d)),
 hosts as (select host, count(distinct t) as docs from d group by 1),
 common as (select host, line from (select host, line, count(distinct t) as n from li group by 1, 2) join hosts using (host) where n > 10 and n > docs * 0.01),
 cut as (select doc_id, cast(sum(n) as bigint) as n_removed_words from li join common using (host, line) group by 1),
 f as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '{SPACE}', '', 'g')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
   cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(n_removed_words, 0) as n_removed_words from d left join rep using (doc_id) left join cut using (doc_id))
 select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
 not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or n_words - n_removed_words < 10 or n_words - n_removed_words < n_words * 0.3) as kept from f"""

# Every document against every order: the first failed filter removes it.
AUDIT = rf"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') as w from documents),
 l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
 f as materialized (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
   regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)] as fails from d left join l on l.doc_id = d.doc_id),
 x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
 o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 s as (select filter_order, step, substr(filter_order, step, 1) as letter from o, (select unnest(range(1, 6)) as step)),
 r as (select part, good, toxic, fails, filter_order, step, letter, fails[ascii(letter) - 64] as here, list_bool_or(list_transform(range(1, step), lambda k: fails[ascii(substr(filter_order, k, 1)) - 64])) as before from f, s),
 g as (select part, filter_order, cast(step as int) as step, letter, count(*) filter (not here and not coalesce(before, false)) as kept, count(*) filter (here and not coalesce(before, false)) as removed, count(*) filter (here and before) as redundant,
   count(*) filter (here and len(list_filter(fails, lambda y: y)) = 1) as unique_fails, count(*) filter (here and not coalesce(before, false) and good) as good_lost, count(*) filter (here and not coalesce(before, false) and toxic) as toxic_lost from r group by all)
 select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley from g"""

# Lengths only: each control string in a text takes one more character.
CONTROL = r"<\\*(?:/?s>|</?SYS>>|\|[A-Za-z0-9_]+\|>)|\[\\*/?INST\]"
_MARKS = {k: len(getattr(chat_format, k)) for k in ("START", "SEP", "NEXT", "END")}
CHATS = rf"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 e as (select *, length(text) + len(regexp_extract_all(text, '{CONTROL}')) as n, length(role) + len(regexp_extract_all(role, '{CONTROL}')) as r, lag(role) over (partition by conv_id order by turn, role, text) as before from c)
 select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256, cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(n + case when before = role then {_MARKS["NEXT"]} else {_MARKS["START"] + _MARKS["SEP"] + _MARKS["END"]} + r end) as bigint) as formatted_chars from e group by 1"""

TERM_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = lambda t: rf"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), '{UPPER}', '{LOWER}'), '{TERM_BREAK}'), lambda x: x <> '')"
SEARCH = rf"""with d as materialized (select doc_id, len(w) as n, w from (select doc_id, {_TERMS("text")} as w from documents) where len(w) > 0),
 z as materialized (select count(*) as docs, cast(sum(n) as bigint) as terms from d),
 p as materialized (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(w) as term from d) group by all),
 i as (select item_id, unnest(list_distinct({_TERMS("text")})) as term from benchmark),
 v as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as weight from (select term, count(*) as df from p group by 1), z),
 s as (select item_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) as bigint) as score from i join v using (term) join p using (term), z group by 1, 2)
 select item_id, cast(rank as int) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 50"""

ORACLES = {"op3_minhash": NEAR, "op4_line_dedup": LINES, "op5_decontaminate": LEAKS, "op6_licenses": licenses_sql(), "op8_quality": QUALITY, "op11_filter_audit": AUDIT, "op12_chat_format": CHATS, "op13_lexical_search": SEARCH}
