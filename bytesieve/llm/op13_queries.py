"""The documents table mixed by source weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytesieve.llm import mixing
from bytesieve.llm.tables import read


def op13_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {"op13_mixing": op13_mixing}
# lambda is where the line of full sources, sorted by what they can hold for their weight, meets the shared size
ORACLES = {"op13_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                  ('0x' || substr(md5('13:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key from documents),
s as (select source, sum(size)::bigint as s from d group by source),
w as (select source, s, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as w from s),
o as (select *, sum(s) over () as s_all, sum(w) over () as w_all,
             coalesce(sum(s) over below, 0) as s_full, coalesce(sum(w) over below, 0) as w_full
      from w window below as (order by 2.0 * s / w, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select min(150 * s_all - 200 * s_full) as num, min(100 * (w_all - w_full)) as den from (
        select * from o where 200 * s * (w_all - w_full) >= w * (150 * s_all - 200 * s_full)
        order by 2.0 * s / w, source nulls last limit 1)),
t as (select source, s, case when 200 * s * (den // 100) < w * num then (2 * s)::double
                             else (w * num)::double / den::double end as target from w, l),
b as (select *, least(floor(target + 0.5)::bigint, 2 * s) as budget from t),
e as (select *, case when s > 0 then budget // s else 0 end as epochs from b),
p as (select d.doc_id, d.size, e.s, e.target, e.epochs, e.budget - e.epochs * e.s as rest,
             sum(d.size) over (partition by d.source order by d.key, d.doc_id nulls first, d.size
                               rows between unbounded preceding and current row) - d.size as before
      from d join e on d.source is not distinct from e.source)
select doc_id, size, s::bigint as source_size, target,
       (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from p"""}
