"""The analog corpus: printed annotations derived from the order tables by arithmetic on keys.

A document is an order, its template the customer number modulo 50. The same expressions stand in the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscore.session import table

# label -> (Spark SQL, DuckDB SQL): what the document prints; null where the label isn't printed

def _fixed(x: str, spark: bool) -> str:
    return f"cast(cast({x} as decimal(18,2)) as string)" if spark else f"cast(cast({x} as decimal(18,2)) as varchar)"


def _labels(spark: bool) -> dict[str, str]:
    total, month = _fixed("o_totalprice", spark), "date_format(o_orderdate, 'dd-MMM-yyyy')" if spark else "strftime(o_orderdate, '%d-%b-%Y')"
    text = "cast(o_orderkey as string)" if spark else "cast(o_orderkey as varchar)"
    return {
        "NUMBER": f"concat('No  ', {text})",
        "DATE": f"case when o_orderkey % 17 = 0 then 'soon' when o_orderkey % 13 <> 0 then {month} end",
        "TOTAL": f"concat('TOTAL : ', {total}, case when o_orderkey % 3 = 0 then ' EUR' when o_orderkey % 3 = 1 then ' $' else ' USD' end)",
        "AMOUNT_DUE": f"case when o_orderkey % 7 = 0 then concat({_fixed('o_totalprice + 1', spark)}, ' EUR') when o_orderkey % 7 = 1 then concat({total}, ' $') end",
        "TAX": f"case when o_orderkey % 5 <> 0 then concat('VAT (', {_fixed('o_orderkey % 20 + 0.5', spark)}, '%): ', {_fixed('o_orderkey % 5000 + 0.75', spark)}, ' EUR') end",
        "DISCOUNT": f"case when o_orderkey % 4 = 0 then concat('(1.85%): (-) ', {_fixed('o_orderkey % 1000 + 0.25', spark)}) end",
    }


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, template, label, raw): one row a printed label."""
    held = ", ".join(f"named_struct('label', '{k}', 'raw', {v})" for k, v in _labels(True).items())
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 50).alias("template"), F.expr(f"inline(array({held}))"))
    return o.filter("raw is not null")


def annotations_sql() -> str:
    held = " UNION ALL ".join(f"SELECT o_orderkey AS doc_id, o_custkey % 50 AS template, '{k}' AS label, {v} AS raw FROM orders" for k, v in _labels(False).items())
    return f"ann AS MATERIALIZED (SELECT * FROM ({held}) WHERE raw IS NOT NULL)"
