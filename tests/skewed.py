"""Copies of the message tables and documents in which one user, order, product, region, batch, delivery, text and source hold a third of all rows."""

from pathlib import Path

import duckdb

TABLES = {
    "activity_log": "select * replace (case when id % 3 = 0 then ' HOT ' else user_id end as user_id) from {t}",
    "order_messages": """select * replace (case when msg_offset % 3 = 0 then 'Hot-Order' else order_id end as order_id, case when msg_offset % 3 = 1 then 'hot' else user_id end as user_id,
        case when msg_offset % 6 < 2 then 'hotp' else product_id end as product_id, case when msg_offset % 3 = 1 then 9.99 else amount end as amount,
        case when msg_offset % 3 = 1 then 'hotr' else region end as region, case when msg_offset % 3 = 1 then (select max(batch_id) from {t}) else batch_id end as batch_id) from {t}""",
    "delivery_messages": "select * replace (case when msg_offset % 3 = 0 then 'hotd' else delivery_id end as delivery_id, case when msg_offset % 3 = 1 then 'hot-missing' else order_id end as order_id) from {t}",
    "documents": """select * replace (case when doc_id % 3 = 0 then (select text from {t} where length(text) > 2000 order by length(text), doc_id limit 1) else text end as text,
        case when doc_id % 3 = 1 then (select source from {t} group by 1 order by count(*) desc, source limit 1) else source end as source) from {t}""",
    "product_feed": "from {t}",
    "mix_targets": "from {t}",
}


def write(source: str, folder: Path) -> str:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name, sql in TABLES.items():
        con.sql(f"copy ({sql.format(t=repr(f'{source}/{name}.parquet'))}) to '{folder}/{name}.parquet' (format parquet)")
    return str(folder)
