"""Comparison SQL (DuckDB) for the queries of this subpackage that SQL can express.

The others are held against brute force in ``tests/llm``: token ids (op1), sketches (op3), hashed
sentence cuts (op5), code-point offsets of regular expressions (op7), seeded draws (op9),
compressed sizes (op10) and a trained model (op11) have no SQL form.
"""

from __future__ import annotations

WARC = """
with p as (
  select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages
), f as (
  select hex, min(page_id) as first from p group by hex
)
select p.page_id,
       cast(octet_length(encode(p.body)) as bigint) as payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((cast(concat('0x', substr(p.hex, cast(5 * (i // 4) + 1 as bigint), 5)) as integer) >> cast(15 - 5 * (i % 4) as integer)) & 31), 1)),
         'string_agg', '') as payload_digest,
       case when p.page_id = f.first then 'response' else 'revisit' end as record_type,
       case when p.page_id <> f.first then f.first end as refers_to
from p join f using (hex)
"""

# White space which may stand in a line, by code point, and scripts written without spaces.
_SPACES = " || ".join(f"chr({c})" for c in (9, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"

LINES = f"""
with l as (
  select doc_id, text, {_SPACES} as white, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as no
  from documents
), f as (
  select doc_id, no, trim(line, white) as line, row_number() over (partition by doc_id order by no) as place
  from l where trim(line, white) <> ''
), w as (
  select doc_id, place, line, lead(line) over (partition by doc_id order by place) as after from f
), g as (
  select doc_id, place from (
    select doc_id, place, row_number() over (partition by line, after order by doc_id, place) as nth from w where after is not null
  ) where nth > 1
), s as (
  select doc_id, place from (
    select doc_id, place, line, row_number() over (partition by line order by doc_id, place) as nth from f
  ) where nth > 1 and len(regexp_extract_all(line, '[{_UNSPACED}]|[^' || {_SPACES} || '{_UNSPACED}]+')) >= 12
), gone as (
  select doc_id, place from g union select doc_id, place + 1 from g union select doc_id, place from s
), marked as (
  select l.doc_id, l.no, l.line, l.white, f.place, gone.place is not null as hit
  from l left join f using (doc_id, no) left join gone on gone.doc_id = f.doc_id and gone.place = f.place
), around as (
  select *, trim(line, white) = '' as blank,
         last_value(case when place is not null then hit end ignore nulls) over (partition by doc_id order by no rows between unbounded preceding and current row) as before,
         first_value(case when place is not null then hit end ignore nulls) over (partition by doc_id order by no rows between current row and unbounded following) as behind
  from marked
), decided as (
  select doc_id, no, line, coalesce(case when blank then before and behind else hit end, false) as removed from around
), islands as (
  select doc_id, min(no) as a, max(no) as b from (
    select doc_id, no, no - row_number() over (partition by doc_id order by no) as island from decided where removed
  ) group by doc_id, island
)
select d.doc_id,
       coalesce((select string_agg(line, chr(10) order by no) from decided x where x.doc_id = d.doc_id and not removed), '') as text,
       (select count(*) from decided x where x.doc_id = d.doc_id) as n_lines,
       (select count(*) from decided x where x.doc_id = d.doc_id and removed) as n_removed,
       coalesce((select string_agg(concat(a, ':', b), ',' order by a) from islands x where x.doc_id = d.doc_id), '') as removed
from documents d
"""

THREADS = """
with t as (
  select conv_id, turn, coalesce(text, '') as text, lag(turn) over w as p1, lag(turn, 2) over w as p2
  from conversations window w as (partition by conv_id order by turn)
), m as (
  select conv_id, turn, trim(text, chr(10)) as text, p1 = turn - 1 as has1, coalesce(p1 = turn - 1 and p2 = turn - 2, false) as has2 from t
), r as (
  select *, max(case when has1 then null else turn end) over (partition by conv_id order by turn) as root from m
)
select conv_id, turn,
       case when has1 then conv_id end as reply_to_conv,
       case when has1 then turn - 1 end as reply_to_turn,
       conv_id as thread_conv, root as thread_turn, cast(turn - root as bigint) as depth,
       cast(coalesce(has1, false) as bigint) + cast(has2 as bigint) as n_quotes,
       cast(coalesce(has1, false) as bigint) + cast(has2 as bigint) as n_linked,
       text
from r
"""

JACCARD = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select distinct doc_id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: list_aggregate(w[i + 1:i + 5], 'string_agg', ' '))) as run
  from w where len(w) > 0
), n as (
  select doc_id, count(*) as n from s group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.run = b.run and a.doc_id <> b.doc_id group by all
), link as (
  select common.a, common.b from common join n x on x.doc_id = common.a join n y on y.doc_id = common.b
  where c >= 0.8 * (x.n + y.n - c) - 1e-9
), reach(a, b) as (
  select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a
), copies as (
  select doc_id, count(*) over (partition by key) as copies
  from (select doc_id, md5(string_agg(run, chr(31) order by run)) as key from s group by doc_id)
)
select d.doc_id,
       least(d.doc_id, coalesce((select min(b) from reach where reach.a = d.doc_id), d.doc_id)) as class_id,
       (select count(*) from link where link.a = d.doc_id) as n_links,
       coalesce((select copies from copies where copies.doc_id = d.doc_id), 1) as n_copies
from documents d
"""

DIVERGENCE = r"""
with d as (
  select row_number() over () as doc, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents
), w as (
  select doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from d
), k as (
  select lang, term, count(*) as total from w group by lang, term having count(distinct doc) >= 30
), g as (
  select distinct lang, source from d
), c as (
  select lang, source, term, count(*) as n from w join k using (lang, term) group by lang, source, term
), f as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.total from g join k using (lang) left join c using (lang, source, term)
), m as (
  select *, sum(n) over (partition by lang, source) as source_n, count(*) over (partition by lang, source) as kinds from f
), l as (
  select lang, sum(total) as lang_n from k group by lang
), p as (
  select lang, source, term, n, 1 + cast(1000000000 as hugeint) * (n + 5) // (source_n + 5 * kinds) as p,
         1 + cast(1000000000 as hugeint) * (total + 5) // (lang_n + 5 * kinds) as q
  from m join l using (lang)
), pair as (
  select a.lang, a.source, b.source as item, coalesce((
    select sum(abs(x.p - y.p)) from p x join p y using (lang, term) where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
), own as (
  select lang, source, term as item, p - q as value from p where n > 0 and p > q
), ranked as (
  select *, 'pair' as part, row_number() over (partition by lang, source order by value desc, item) as rank from pair
  union all by name
  select *, 'term' as part, row_number() over (partition by lang, source order by value desc, item) as rank from own
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from ranked where part = 'pair' or rank <= 50
"""

NEGATIVES = """
with v as (
  select row_number() over () as uid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as hugeint)) as vec
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.uid, a.vec_id as anchor_id, a.label = b.label as same, b.vec_id,
         cast(coalesce(list_sum(list_transform(range(1, 1 + least(len(a.vec), len(b.vec))), lambda i: a.vec[i] * b.vec[i])), 0) as bigint) as score
  from v a join v b on a.uid <> b.uid where a.vec_id % 100 = 0
), p as (
  select *, row_number() over (partition by uid order by score desc, vec_id nulls last) as place from s where same
), n as (
  select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.uid, p.place order by s.score desc, s.vec_id nulls last) as rank
  from p join s using (uid)
  where p.place <= 5 and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""

ORACLES: dict[str, str] = {
    "op2_warc_round_trip": WARC,
    "op4_winnowed_lines": LINES,
    "op6_quotation_threads": THREADS,
    "op8_lsh_forest_join": JACCARD,
    "op12_term_tree_audit": DIVERGENCE,
    "op13_window_negatives": NEGATIVES,
}
