"""The prefix trie of the conversations table."""

from __future__ import annotations

from bytesieve.llm.prefix_trie import conversation_trie
from bytesieve.llm.tables import read


def op12_prefix_trie(spark, sf_dir):
    return conversation_trie(read(spark, sf_dir, "conversations"))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
# crc32 bit by bit; every prefix of every path as a list
ORACLES = {"op12_prefix_trie": r"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                  row_number() over (partition by conv_id order by turn nulls first, role, text) as pos
           from conversations where conv_id is not null),
c as (select conv_id, count(*) as n, conv_id - conv_id % 100 as base,
             xor(4294967295, list_reduce(
                 list_concat([4294967295], list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
                 lambda c, b: list_reduce(list_concat([xor(c, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                                          lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 6 as h
      from t group by conv_id),
s as (select c.*, least(c.h, coalesce(b.n, 0)) as lent from c left join c b on b.conv_id = c.base),
r as (select s.conv_id, t.pos, role, text from s join t on t.conv_id = s.base and t.pos <= s.lent
      union all select s.conv_id, t.pos - s.h + s.lent, role, text from s join t on t.conv_id = s.conv_id and t.pos > s.h),
p as (select s.conv_id, coalesce(list({'r': role, 't': text} order by pos) filter (pos is not null), []) as path
      from s left join r on r.conv_id = s.conv_id group by s.conv_id),
m as (select conv_id, path, unnest(range(0, len(path) + 1)) as d from p),
n as (select path[1:d] as k, d, min(conv_id) as conv_id, count(*) as n,
             string_agg(conv_id::varchar, ',' order by conv_id) filter (len(path) = d) as ends from m group by 1, 2),
kids as (select k[1:d - 1] as k, d - 1 as d, count(*) as n from n where d > 0 group by 1, 2),
v as (select n.*, coalesce(kids.n, 0) as kids,
             case when n.d > 0 then (n.n - 1) * length(n.k[n.d].t) else 0 end as saved
      from n left join kids on kids.d = n.d and kids.k = n.k),
below as (select k[1:e] as k, e as d, sum((kids = 0)::int) as leaves, sum(saved) as saved
          from (select *, unnest(range(0, d + 1)) as e from v) group by 1, 2)
select v.conv_id, v.d as depth, up.conv_id as parent_conv_id, v.n::bigint as n_convs, v.kids::bigint as n_children,
       below.leaves::bigint as n_leaves, below.saved::bigint as saved_tokens, sha256(coalesce(v.ends, '')) as ends_sha256
from v join below on below.d = v.d and below.k = v.k left join n up on up.d = v.d - 1 and up.k = v.k[1:v.d - 1]"""}
