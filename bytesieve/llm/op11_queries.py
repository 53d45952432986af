"""Collocations of the documents table, per language."""

from __future__ import annotations

from bytesieve.llm.collocations import collocations
from bytesieve.llm.tables import read


def op11_collocations(spark, sf_dir):
    return collocations(read(spark, sf_dir, "documents")).drop("words")


QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": r"""
with p as (select row_number() over () as p, lang, s from (
        select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) as s from documents)),
w as (select lang, regexp_extract_all(s, '[^\x20\x09]+') as w from p),
c as (select lang, sum(len(w))::hugeint as n from w group by lang),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
      from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, range(1, 6) as t(k))),
f as (select lang, k, phrase, count(*)::hugeint as f from g group by all having count(*) >= 100),
cuts as (select f.lang, f.phrase, f.k, f.f as a, j, l.f as l, r.f as r, c.n, (1000 * f.f * c.n) // (l.f * r.f) as score
         from (select *, string_split(phrase, ' ') as w, unnest(range(1, k)) as j from f where k > 1) f
         join f l on l.lang = f.lang and l.phrase = array_to_string(f.w[1:j], ' ')
         join f r on r.lang = f.lang and r.phrase = array_to_string(f.w[j + 1:], ' ')
         join c on c.lang = f.lang),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
kept as (select * from best b where not exists (
            select 1 from f where f.lang = b.lang and f.k > b.k and f.f >= b.a
            and contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase,
       a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from kept qualify rank <= 2000"""}
