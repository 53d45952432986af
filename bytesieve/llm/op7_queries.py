"""The pages table written as WARC archives and read back."""

from __future__ import annotations

from bytesieve.llm import warc
from bytesieve.llm.tables import read


def op7_warc(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages"))


QUERIES = {"op7_warc": op7_warc}
ORACLES = {"op7_warc": """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes,
                  sha256(coalesce(html, '')) as payload_digest from pages),
     q as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from q"""}
