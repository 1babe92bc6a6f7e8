from __future__ import annotations

from pyspark.sql import functions as F

from popweave.llm import warc
from popweave.llm.registry import query, table

_BASE32 = ("array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
           "(((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '')")


@query("op3_salvage", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages), d AS (SELECT page_id, octet_length(encode(b)) AS n, sha1(encode(b)) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d JOIN f USING (h)""")
def op3_salvage(spark, sf_dir):
    """Every page written as a WARC record and read back from the archives."""
    folder = warc.write_archives(table(spark, sf_dir, "pages"))
    got = warc.read_archives(spark, folder, with_payload=False).where("error is null")
    return got.select(F.nullif("record_id", F.lit("null")).cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))
