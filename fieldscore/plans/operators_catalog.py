"""Queries of the single operators: parsers, alignment, ground truth, sampling, runs, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscore.functions import dates, numbers, text
from fieldscore.functions.parsers import parse
from fieldscore.operators import adapters, align, coverage, diagnostics, groundtruth, rows, runs, sampling, stages
from fieldscore.operators.verdicts import current_records, predictions
from fieldscore.plans import sql_parts as S
from fieldscore.plans import training_core as T
from fieldscore.plans.analog import annotations, annotations_sql
from fieldscore.session import cut, scratch, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ANN = "WITH " + annotations_sql()
# the leaves of each arm of current ok results: (run_id, doc_id, arm, p, leaf)
_LEAVES = f"""WITH RECURSIVE {T._side_sql("r", "doc_results", "written_at", "ok")},
  l AS MATERIALIZED (SELECT run_id, doc_id, regexp_extract(path, '^[^.\\[]+') AS arm, substr(path, length(regexp_extract(path, '^[^.\\[]+')) + 2) AS p, leaf FROM r_leaves)"""
_ARM_PAIR = """{b} AS (SELECT run_id, doc_id, p, leaf FROM l WHERE arm = '{x}'), {a} AS (SELECT run_id, doc_id, p, leaf FROM l WHERE arm = '{y}')"""
_SAYS = "NOT regexp_full_match({c}, 'lnull|s\\s*')"


def _money_texts(spark: SparkSession, d: str) -> DataFrame:
    """Printed amounts of line items in several forms."""
    price = "cast(cast(l_extendedprice as decimal(18,2)) as string)"
    form = f"case l_linenumber % 5 when 0 then concat('(', {price}, ')') when 1 then concat({price}, ' EUR') when 2 then concat('BALANCE_DUE : ', {price}, ' $') when 3 then concat('(1.85%): (-) ', {price}) else concat('no number', '') end"
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(form).alias("printed"))


MONEY_SQL = """WITH m AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN '(' || p || ')' WHEN 1 THEN p || ' EUR' WHEN 2 THEN 'BALANCE_DUE : ' || p || ' $' WHEN 3 THEN '(1.85%): (-) ' || p ELSE 'no number' END AS printed
  FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM lineitem))"""


@query(f"{MONEY_SQL} SELECT l_linenumber, count(*) AS n, count(v) AS n_read, sum(v) AS total FROM (SELECT l_linenumber, {S.money('printed')} AS v FROM m) GROUP BY l_linenumber")
def normalise_money(spark, d):  # noqa: ANN001, ANN201
    v = numbers.money(F.col("printed"))
    return _money_texts(spark, d).withColumn("v", v).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("v").alias("n_read"), F.sum("v").cast("decimal(38,2)").alias("total"))


@query(f"{MONEY_SQL} SELECT l_linenumber, min(regexp_replace(printed, '^\\s*[A-Z][A-Z0-9_]*\\s*:\\s*', '')) AS low, max(regexp_replace(printed, '^\\s*[A-Z][A-Z0-9_]*\\s*:\\s*', '')) AS high FROM m GROUP BY l_linenumber")
def money_label_prefix(spark, d):  # noqa: ANN001, ANN201
    s = numbers.without_caption(F.col("printed"))
    return _money_texts(spark, d).groupBy("l_linenumber").agg(F.min(s).alias("low"), F.max(s).alias("high"))


@query(f"{ANN} SELECT p, count(*) AS n FROM (SELECT round(CAST(regexp_extract(raw, '(\\d+(?:\\.\\d+)?)\\s*%', 1) AS DECIMAL(18,6)), 2) AS p FROM ann WHERE label IN ('TAX', 'DISCOUNT')) GROUP BY p")
def normalise_percent(spark, d):  # noqa: ANN001, ANN201
    return annotations(spark, d).filter("label in ('TAX', 'DISCOUNT')").groupBy(numbers.percent(F.col("raw")).alias("p")).agg(F.count("*").alias("n"))


@query(f"{ANN} SELECT label, CASE WHEN regexp_matches(upper(raw), '\\bEUR\\b') THEN 'EUR' WHEN regexp_matches(upper(raw), '\\bUSD\\b') THEN 'USD' WHEN contains(raw, '$') THEN '__AMBIGUOUS__' END AS currency, count(*) AS n FROM ann GROUP BY ALL")
def normalise_currency(spark, d):  # noqa: ANN001, ANN201
    return annotations(spark, d).groupBy("label", numbers.currency(F.col("raw")).alias("currency")).agg(F.count("*").alias("n"))


@query(f"{ANN} SELECT iso, count(*) AS n FROM (SELECT strftime(try_strptime(raw, '%d-%b-%Y'), '%Y-%m-%d') AS iso FROM ann WHERE label = 'DATE') GROUP BY iso")
def normalise_date_iso(spark, d):  # noqa: ANN001, ANN201
    return annotations(spark, d).filter("label = 'DATE'").groupBy(dates.iso_date(F.col("raw")).alias("iso")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN digits <> '' THEN (CASE WHEN starts_with(ltrim(p), '+') THEN '+' ELSE '' END) || digits END AS phone, nullif(regexp_replace(p, '\\s+', '', 'g'), '') AS printed FROM (SELECT DISTINCT doc_id, p, regexp_replace(p, '\\D', '', 'g') AS digits FROM (SELECT doc_id, gt['parties.seller.phone'] AS p FROM gt_records) WHERE p IS NOT NULL)")
def normalise_phone(spark, d):  # noqa: ANN001, ANN201
    p = table(spark, d, "gt_records").select("doc_id", F.try_element_at("gt", F.lit("parties.seller.phone")).alias("p")).filter("p is not null").distinct()
    return p.select("doc_id", text.phone_digits(F.col("p")).alias("phone"), text.phone_printed(F.col("p")).alias("printed"))


@query(f"SELECT DISTINCT doc_id, {S.address_line('a')} AS line, {S.address_compared(S.address_line('a'))} AS compared FROM (SELECT doc_id, gt['parties.seller.addressStructured'] AS a FROM gt_records) WHERE a IS NOT NULL")
def normalise_address(spark, d):  # noqa: ANN001, ANN201
    a = table(spark, d, "gt_records").select("doc_id", F.try_element_at("gt", F.lit("parties.seller.addressStructured")).alias("a")).filter("a is not null")
    line = text.address_line(F.col("a"))
    return a.select("doc_id", line.alias("line"), text.address_compared(line).alias("compared")).distinct()


@query(f"WITH {S.PREDS} SELECT arm, count(*) AS n, count_if(m IS NOT DISTINCT FROM k) AS n_same_order, max(m) AS high FROM (SELECT arm, {S.address_merged('v')} AS m, {S.address_merged('v', True)} AS k FROM (SELECT arm, json_extract(p, '$.parties.seller.addressStructured') AS v FROM preds) WHERE json_type(v) = 'OBJECT') GROUP BY arm")
def normalise_address_merge(spark, d):  # noqa: ANN001, ANN201
    v = F.try_variant_get("payload", "$.parties.seller.addressStructured", "variant")
    parts = {k: F.try_variant_get("payload", f"$.parties.seller.addressStructured.{k}", "string") for k in text.ADDRESS_PARTS}
    p = predictions(table(spark, d, "doc_results")).filter(F.try_variant_get(v, "$", "struct<>").isNotNull())
    p = p.select("arm", text.address_merged(parts).alias("m"), text.address_merged(parts, alt=True).alias("k"))
    return p.groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("m").eqNullSafe(F.col("k"))).alias("n_same_order"), F.max("m").alias("high"))


_PAIR = "SELECT p_partkey, lower(p_name) AS a, lower(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'a', 'o') WHEN 2 THEN p_name || ' x' ELSE substr(p_name, 3) END) AS b FROM part"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = "case p_partkey % 4 when 0 then p_name when 1 then replace(p_name, 'a', 'o') when 2 then concat(p_name, ' x') else substr(p_name, 3) end"
    return table(spark, d, "part").select("p_partkey", F.expr("lower(p_name)").alias("a"), F.expr(f"lower({e})").alias("b"))


def _word_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("p_partkey", text.normal(F.col("a"), drop_punct=True).alias("x"), text.normal(F.col("b"), drop_punct=True).alias("y"))


@query(f"SELECT p_partkey, round({S.anls(S.norm('a'), S.norm('b'))}, 6) AS anls FROM ({_PAIR})")
def anls_similarity(spark, d):  # noqa: ANN001, ANN201
    return _pairs(spark, d).select("p_partkey", F.round(text.anls(F.col("a"), F.col("b")), 6).alias("anls"))


@query(f"""SELECT p_partkey, round(CASE WHEN n = 0 THEN 0.0 ELSE 2.0 * n / (la + lb) END, 6) AS token_f1 FROM (
  SELECT p_partkey, len(x) AS la, len(y) AS lb, list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))) AS n
  FROM (SELECT p_partkey, string_split({S.norm_words('a')}, ' ') AS x, string_split({S.norm_words('b')}, ' ') AS y FROM ({_PAIR})))""")
def token_f1(spark, d):  # noqa: ANN001, ANN201
    return _word_pairs(spark, d).select("p_partkey", F.round(text.token_f1_normal(F.col("x"), F.col("y")), 6).alias("token_f1"))


@query(f"""SELECT p_partkey, round(len(list_filter(y, lambda w: list_contains(x, w)))::DOUBLE / len(y), 6) AS recall FROM (SELECT p_partkey, string_split({S.norm_words('a')}, ' ') AS x, string_split({S.norm_words('b')}, ' ') AS y FROM ({_PAIR}))""")
def text_contained_recall(spark, d):  # noqa: ANN001, ANN201
    return _word_pairs(spark, d).select("p_partkey", F.round(text.token_recall_normal(F.col("x"), F.col("y")), 6).alias("recall"))


_CHARGE = "CASE l_linenumber % 4 WHEN 0 THEN concat('TAX:VAT (', {r}, '%)') WHEN 1 THEN concat('GST(', {r}, '%) :') WHEN 2 THEN 'Shipping' ELSE concat('Service - ', {r}, '%') END"


@query(f"""SELECT name, rate, count(*) AS n FROM (SELECT {S.norm("trim(trim(trim(regexp_replace(regexp_replace(trim(c), '^(.*?)' || chr(92) || '(\\s*[-+]?\\d+(?:\\.\\d+)?\\s*%\\s*\\)', '\\1'), '(?i)^\\s*tax\\s*[:\\-]\\s*', '')), ':-'))")} AS name,
  round(try_cast(nullif(regexp_extract(c, '\\(\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*%\\s*\\)', 1), '') AS DOUBLE), 2) AS rate FROM (SELECT {_CHARGE.format(r="CAST(CAST(l_tax * 100 AS DECIMAL(18,2)) AS VARCHAR)")} AS c FROM lineitem)) GROUP BY ALL""")
def charge_label_parts(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "lineitem").select(F.expr(_CHARGE.format(r="cast(cast(l_tax * 100 as decimal(18,2)) as string)")).alias("c"))
    return c.groupBy(text.charge_name(F.col("c")).alias("name"), text.charge_rate(F.col("c")).alias("rate")).agg(F.count("*").alias("n"))


@query("""SELECT p, t, CASE WHEN t = '$' THEN upper(trim(p)) = 'USD' WHEN t = '€' THEN upper(trim(p)) = 'EUR' WHEN t = '£' THEN upper(trim(p)) = 'GBP' ELSE false END AS convention, count(*) AS n
  FROM (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR ' ELSE 'GBP' END AS p, CASE n_nationkey % 4 WHEN 0 THEN '$' WHEN 1 THEN '€' WHEN 2 THEN '£' ELSE 'USD' END AS t FROM nation, region) GROUP BY ALL""")
def convention_currency(spark, d):  # noqa: ANN001, ANN201
    n = table(spark, d, "nation").select(F.expr("case n_nationkey % 3 when 0 then 'usd' when 1 then 'EUR ' else 'GBP' end").alias("p"), F.expr("case n_nationkey % 4 when 0 then '$' when 1 then '€' when 2 then '£' else 'USD' end").alias("t"), F.explode(F.array_repeat(F.lit(1), 5)))
    return n.groupBy("p", "t", text.currency_convention(F.col("p"), F.col("t")).alias("convention")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 < 3 THEN true ELSE false END AS convention FROM customer""")
def convention_address(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "customer").select("c_custkey", F.expr("concat('12 ', lower(c_name), case c_custkey % 3 when 0 then ' us' when 1 then ' us x' else ' fr' end)").alias("t"), F.expr("concat(case when c_custkey % 4 = 3 then '13 ' else '12 ' end, lower(c_name), case c_custkey % 3 when 0 then ' usa' when 1 then ' usa y' else ' france' end)").alias("p"))
    return c.select("c_custkey", text.address_convention(F.col("p"), F.col("t")).alias("convention"))


_NV, _OV = "json_extract(v, '$.normalizedValue')", "json_extract(v, '$.originalValue')"


@query(f"""WITH {S.PREDS}, x AS MATERIALIZED (SELECT run_id, doc_id, arm, json_extract(p, '$.totals.totalIncludingTax') AS v FROM preds),
  y AS (SELECT run_id, doc_id, arm, v, json_type({_NV}) IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') AS num, round(try_cast(({_NV}->>'$') AS DECIMAL(28,10)), 2) AS nv, {S.money(f"({_OV}->>'$')")} AS ov FROM x WHERE json_type(v) = 'OBJECT')
  SELECT run_id, doc_id, arm, CASE WHEN json_type({_NV}) = 'NULL' THEN NULL WHEN num THEN nv WHEN json_type({_OV}) = 'NULL' THEN NULL ELSE ov END AS amount,
    CASE WHEN json_type({_NV}) = 'NULL' OR num THEN 'normalizedValue' WHEN json_type({_OV}) = 'NULL' OR ov IS NOT NULL THEN 'originalValue' END AS source, coalesce(num AND ov <> nv, false) AS disagree FROM y""")
def numeric_from_field(spark, d):  # noqa: ANN001, ANN201
    v = F.try_variant_get("payload", "$.totals.totalIncludingTax", "variant")
    p = predictions(table(spark, d, "doc_results")).withColumn("v", v).filter(F.try_variant_get("v", "$", "struct<>").isNotNull())
    return p.select("run_id", "doc_id", "arm", numbers.numeric_fact(F.col("v")).alias("f"), numbers.parse_disagreement(F.col("v")).alias("disagree")).select("run_id", "doc_id", "arm", F.col("f.value").alias("amount"), F.col("f.source").alias("source"), "disagree")


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN k || '.' || f WHEN 1 THEN k || ',' || f WHEN 2 THEN k || '.000' WHEN 3 THEN '1.' || lpad(k, 3, '0') || ',' || f WHEN 4 THEN k || ',0000' ELSE k END AS c,
    CASE p_partkey % 6 WHEN 2 THEN k || '000.00' WHEN 3 THEN '1' || lpad(k, 3, '0') || '.' || f WHEN 4 THEN NULL WHEN 5 THEN k || '.00' ELSE k || '.' || f END AS e
    FROM (SELECT p_partkey, CAST(p_partkey % 900 + 1 AS VARCHAR) AS k, lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS f FROM part)) SELECT p_partkey, c, CAST(e AS DECIMAL(18,2)) AS amount FROM s""")
def cord_decimal_separators(spark, d):  # noqa: ANN001, ANN201
    k, f = "cast(p_partkey % 900 + 1 as string)", "lpad(cast(p_partkey % 100 as string), 2, '0')"
    c = f"case p_partkey % 6 when 0 then concat({k}, '.', {f}) when 1 then concat({k}, ',', {f}) when 2 then concat({k}, '.000') when 3 then concat('1.', lpad({k}, 3, '0'), ',', {f}) when 4 then concat({k}, ',0000') else {k} end"
    return table(spark, d, "part").select("p_partkey", F.expr(c).alias("c")).withColumn("amount", numbers.receipt_money(F.col("c")))


@query()
def parser_table(spark, d):  # noqa: ANN001, ANN201
    """Every registered parser over the analog annotations: how many values it reads."""
    from fieldscore.functions.parsers import PARSERS

    a = annotations(spark, d)
    return a.groupBy("label").agg(*[F.count(parse(n, F.col("raw"), F.col("label"))).alias(n) for n in sorted(PARSERS)])


# alignment ----------------------------------------------------------------------------------------------------------


_NUMBERED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


def _line_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Line items as printed rows, and a prediction that drops the third, changes some prices and invents some rows."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr(_NUMBERED).alias("pos"), "l_partkey", (F.col("l_partkey") % 7).alias("k"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    gt = li.drop("l_partkey")
    pred = li.filter("pos <> 3").select("doc_id", "pos", "k", F.expr("cast(case when l_partkey % 9 = 0 then price + 1 else price end as decimal(18,2))").alias("price"))
    extra = li.filter("doc_id % 5 = 0 and pos = 1").select("doc_id", F.lit(99).alias("pos"), F.lit(6).cast("long").alias("k"), F.lit(1).cast("decimal(18,2)").alias("price"))
    return gt, pred.unionByName(extra)


LINES = f"""li AS MATERIALIZED (SELECT l_orderkey AS doc_id, {_NUMBERED} AS pos, l_partkey, l_partkey % 7 AS k, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem), gt AS (SELECT doc_id, pos, k, price FROM li),
pr AS (SELECT doc_id, pos, k, CAST(CASE WHEN l_partkey % 9 = 0 THEN price + 1 ELSE price END AS DECIMAL(18,2)) AS price FROM li WHERE pos <> 3 UNION ALL SELECT doc_id, 99, 6, 1 FROM li WHERE doc_id % 5 = 0 AND pos = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS nth FROM gt), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS nth FROM pr),
m AS (SELECT g.doc_id, g.k, g.pos AS gt_row, p.pos AS pred_row, g.price AS gp, p.price AS pp FROM g JOIN p USING (doc_id, k, nth))"""


@query(f"WITH {LINES} SELECT doc_id, k, gt_row, pred_row FROM m")
def exact_key_alignment(spark, d):  # noqa: ANN001, ANN201
    gt, pred = _line_rows(spark, d)
    return align.exact_key_pairs(gt, pred, ["doc_id"], "k", "pos")


@query(f"""WITH {LINES}, s AS (SELECT a.doc_id, a.n_gt, coalesce(b.n_pred, 0) AS n_pred, coalesce(c.n_matched, 0) AS n_matched FROM (SELECT doc_id, count(*) AS n_gt FROM gt GROUP BY doc_id) a
  LEFT JOIN (SELECT doc_id, count(*) AS n_pred FROM pr GROUP BY doc_id) b USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_matched FROM m GROUP BY doc_id) c USING (doc_id))
  SELECT doc_id % 10 AS grp, count(*) AS n_docs, sum(n_gt) AS n_gt, sum(n_pred) AS n_pred, sum(n_matched) AS n_matched, {S.rate('sum(n_matched)', 'sum(n_pred)')} AS precision, {S.rate('sum(n_matched)', 'sum(n_gt)')} AS recall,
  {S.rate('2 * sum(n_matched)', 'sum(n_gt) + sum(n_pred)')} AS f1, {S.rate('count_if(n_gt = n_matched AND n_pred = n_matched)', 'count(*)')} AS table_complete_rate FROM s GROUP BY doc_id % 10""")
def row_summary_prf(spark, d):  # noqa: ANN001, ANN201
    gt, pred = _line_rows(spark, d)
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    m = align.exact_key_pairs(gt, pred, ["doc_id"], "k", "pos")
    s = n(gt, "n_gt").join(n(pred, "n_pred"), "doc_id", "left").join(n(m, "n_matched"), "doc_id", "left").na.fill(0, ["n_pred", "n_matched"])
    return align.section_summary(s.withColumn("grp", F.col("doc_id") % 10), ["grp"])


@query(f"WITH {LINES} SELECT doc_id % 10 AS grp, count(*) AS n_cells, count_if(gp = pp) AS n_correct, {S.rate('count_if(gp = pp)', 'count(*)')} AS cell_accuracy FROM m GROUP BY doc_id % 10")
def cell_accuracy(spark, d):  # noqa: ANN001, ANN201
    gt, pred = _line_rows(spark, d)
    m = align.exact_key_pairs(gt, pred, ["doc_id"], "k", "pos")
    cells = m.join(gt.select("doc_id", F.col("pos").alias("gt_row"), F.col("price").alias("gp")), ["doc_id", "gt_row"]).join(pred.select("doc_id", F.col("pos").alias("pred_row"), F.col("price").alias("pp")), ["doc_id", "pred_row"])
    ok = F.count_if(F.col("gp") == F.col("pp"))
    return cells.groupBy((F.col("doc_id") % 10).alias("grp")).agg(F.count("*").alias("n_cells"), ok.alias("n_correct"), F.round(F.try_divide(ok.cast("double"), F.count("*")), 6).alias("cell_accuracy"))


def _receipt_rows(spark: SparkSession, d: str) -> DataFrame:
    truth = current_records(table(spark, d, "gt_records")).select("doc_id", "cluster_id", F.try_element_at("gt", F.lit("lineItems")).alias("gt_rows")).filter("gt_rows is not null")
    p = predictions(table(spark, d, "doc_results")).select("run_id", "doc_id", "arm", F.to_json(F.try_variant_get("payload", "$.lineItems", "variant")).alias("pred_rows"))
    return p.join(truth, "doc_id")


@query()
def hungarian_alignment(spark, d):  # noqa: ANN001, ANN201
    """Optimal alignment of receipt line items of every arm with the truth."""
    a = _receipt_rows(spark, d).withColumn("pairs", align.align_rows(F.col("gt_rows"), F.col("pred_rows")))
    size = lambda c: F.coalesce(F.size(F.from_json(c, "array<string>")), F.lit(0))
    return a.select("run_id", "doc_id", "arm", size("gt_rows").alias("n_gt"), F.when(F.col("pred_rows").startswith("["), size("pred_rows")).otherwise(F.lit(0)).alias("n_pred"), F.size("pairs").alias("n_matched"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """The line items of every arm beside the printed ones."""
    return rows.aligned(_receipt_rows(spark, d).select("run_id", "doc_id", "arm", F.lit("lineItems").alias("section"), "gt_rows", "pred_rows"))


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = cut(_sections(spark, d))
    return a, rows.row_cells(a, {"lineItems": rows.LINE_ITEM_TARGETS})


@query()
def row_cells(spark, d):  # noqa: ANN001, ANN201
    """Every printed cell of every aligned line item with the leaf that answers it best."""
    return _cells(spark, d)[1]


@query()
def sections_by_path(spark, d):  # noqa: ANN001, ANN201
    """Rows, whole rows, whole tables and cells of each repeated section by arm."""
    a, cells = _cells(spark, d)
    return rows.sections_by_path(rows.section_documents(a, cells))


@query()
def per_cell_accuracy(spark, d):  # noqa: ANN001, ANN201
    return rows.per_cell(_cells(spark, d)[1])


@query()
def line_item_review(spark, d):  # noqa: ANN001, ANN201
    """Every printed cell with each arm's verdict, rows that no arm has included."""
    return rows.line_item_review(*_cells(spark, d))


@query()
def charge_lines(spark, d):  # noqa: ANN001, ANN201
    """The printed tax of each record against the charge lines of each arm."""
    gt = current_records(table(spark, d, "gt_records")).select("doc_id", F.try_element_at("gt", F.lit("totals.taxName")).alias("name"), F.try_element_at("gt", F.lit("totals.taxAmount")).alias("amount")).filter("amount is not null and amount <> '__ABSENT__'")
    line = F.struct(text.charge_rate(F.col("name")).cast("decimal(38,2)").alias("rate"), numbers.money(F.col("amount")).cast("decimal(38,2)").alias("value"), F.lit(False).alias("scalar"))
    both = predictions(table(spark, d, "doc_results")).join(gt.select("doc_id", F.array(line).alias("truth_lines")), "doc_id").withColumn("pred_lines", rows.charge_lines(F.col("payload"), ("totals.taxes",)))
    return rows.charge_line_totals(rows.charge_line_scores(both))


@query()
def line_item_summary(spark, d):  # noqa: ANN001, ANN201
    return align.section_summary(hungarian_alignment(spark, d), ["arm"])


@query()
def charge_line_states(spark, d):  # noqa: ANN001, ANN201
    """Printed charge lines against predicted ones, matched in order and each used once."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_tax") * 100, 2).cast("decimal(38,2)").alias("rate"), F.col("l_extendedprice").cast("decimal(38,2)").alias("value"))
    pair = lambda v: F.struct(F.col("rate"), v.cast("decimal(38,2)").alias("value"))
    changed = F.when(F.col("l_linenumber") % 3 == 0, F.col("value") + 1).when(F.col("l_linenumber") % 5 == 0, None).otherwise(F.col("value"))
    lines = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c.alias("line")))), lambda x: x["line"])
    by = li.groupBy("l_orderkey").agg(lines(pair(F.col("value"))).alias("truth"), lines(pair(changed)).alias("pred"))
    states = by.select("l_orderkey", F.explode(align.charge_line_states(F.col("truth"), F.col("pred"))).alias("state"))
    return states.groupBy("state").agg(F.count("*").alias("n"))


# ground truth -------------------------------------------------------------------------------------------------------


@query(f"""WITH {S.RECORDS} SELECT source_dataset, path, n_docs, n_clusters, distinct_values, absent_docs, bar_reason, bar_reason IS NULL AS headline_eligible FROM (
  SELECT *, CASE WHEN n_docs < 30 THEN 'too few documents' WHEN distinct_values <= 1 THEN 'constant' WHEN distinct_values < 20 THEN 'too few values' END AS bar_reason FROM (
    SELECT source_dataset, u.path, count(*) AS n_docs, count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT CASE WHEN r.gt[u.path] <> '__ABSENT__' THEN r.gt[u.path] END) AS distinct_values, count_if(coalesce(r.gt[u.path] = '__ABSENT__', false)) AS absent_docs
    FROM rec r, unnest(r.annotated_fields) u(path) GROUP BY ALL))""")
def coverage_eligibility(spark, d):  # noqa: ANN001, ANN201
    return coverage.coverage(table(spark, d, "gt_records"))


@query(f"WITH {S.RECORDS} SELECT source_dataset, e.key AS path, substr(e.value, 1, 80) AS reason, count(*) AS n FROM (SELECT source_dataset, unnest(map_entries(excluded_fields)) AS e FROM rec) GROUP BY ALL")
def exclusion_histogram(spark, d):  # noqa: ANN001, ANN201
    return coverage.exclusion_histogram(table(spark, d, "gt_records"))


@query(f"WITH {S.RECORDS} SELECT source_dataset, label, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT source_dataset, doc_id, unnest(CAST(json_extract(meta, '$.labels') AS VARCHAR[])) AS label FROM rec) GROUP BY ALL")
def label_inventory(spark, d):  # noqa: ANN001, ANN201
    return coverage.label_inventory(table(spark, d, "gt_records"))


@query(f"WITH {S.RECORDS} SELECT doc_id, substr(sha1(array_to_string(list_sort(list_distinct(CAST(json_extract(meta, '$.labels') AS VARCHAR[]))), '|')), 1, 10) AS keyset FROM rec")
def keyset_ids(spark, d):  # noqa: ANN001, ANN201
    return coverage.keyset_ids(table(spark, d, "gt_records"))


@query("""WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY received_at DESC NULLS LAST) AS rn FROM gt_records) WHERE rn = 1)
  SELECT doc_id, 'truth not annotated' AS fault FROM c WHERE len(list_filter(map_keys(gt), lambda k: NOT list_contains(annotated_fields, k))) > 0
  UNION ALL SELECT doc_id, 'annotated and excluded' FROM c WHERE len(list_intersect(annotated_fields, map_keys(excluded_fields))) > 0
  UNION ALL SELECT doc_id, 'no cluster' FROM c WHERE coalesce(trim(cluster_id), '') = '' UNION ALL SELECT doc_id, 'absolute image path' FROM c WHERE starts_with(image_path, '/')""")
def record_faults(spark, d):  # noqa: ANN001, ANN201
    return coverage.record_faults(table(spark, d, "gt_records"))


@query(f"{ANN} SELECT DISTINCT template, label FROM ann")
def template_vocabulary(spark, d):  # noqa: ANN001, ANN201
    return groundtruth.template_vocabulary(annotations(spark, d))


@query(f"""{ANN}, rules AS (SELECT * FROM (VALUES {', '.join(f"('{r.label}', '{r.path}')" for r in groundtruth.INVOICE_RULES if r.path in ('totals.totalIncludingTax', 'totals.taxPercentage', 'invoiceInfo.issueDateISO', 'invoiceInfo.documentNumber', 'totals.discountTotal'))}) t(label, path)),
  w AS (SELECT a.doc_id, r.path, a.raw, CASE r.path WHEN 'totals.totalIncludingTax' THEN CAST(CAST({S.money('a.raw')} AS DECIMAL(18,2)) AS VARCHAR) WHEN 'totals.taxPercentage' THEN CAST(CAST(regexp_extract(a.raw, '(\\d+(?:\\.\\d+)?)\\s*%', 1) AS DECIMAL(18,2)) AS VARCHAR)
      WHEN 'invoiceInfo.issueDateISO' THEN strftime(try_strptime(a.raw, '%d-%b-%Y'), '%Y-%m-%d') WHEN 'totals.discountTotal' THEN CAST(CAST(abs({S.money('a.raw')}) AS DECIMAL(18,2)) AS VARCHAR) ELSE trim(regexp_replace(a.raw, '\\s+', ' ', 'g')) END AS v FROM ann a JOIN rules r USING (label)),
  f AS (SELECT doc_id, path, count(DISTINCT v) AS k, max(v) AS v, bool_or(v IS NULL AND trim(raw) <> '') AS bad FROM w GROUP BY doc_id, path),
  x AS (SELECT DISTINCT d.doc_id, r.path FROM (SELECT DISTINCT doc_id, template FROM ann) d JOIN (SELECT DISTINCT template, label FROM ann) t USING (template) JOIN rules r USING (label))
  SELECT x.doc_id, x.path, CASE WHEN k = 1 THEN f.v WHEN coalesce(k, 0) = 0 AND NOT coalesce(bad, false) THEN '__ABSENT__' END AS value, CASE WHEN k = 1 THEN 'present' WHEN k > 1 OR bad THEN 'excluded' ELSE 'absent' END AS state FROM x LEFT JOIN f USING (doc_id, path)""")
def gt_resolve_conflicts(spark, d):  # noqa: ANN001, ANN201
    paths = ("totals.totalIncludingTax", "totals.taxPercentage", "invoiceInfo.issueDateISO", "invoiceInfo.documentNumber", "totals.discountTotal")
    return groundtruth.resolve(annotations(spark, d), tuple(r for r in groundtruth.INVOICE_RULES if r.path in paths)).select("doc_id", "path", "value", "state")


@query()
def gt_resolve_currency(spark, d):  # noqa: ANN001, ANN201
    r = groundtruth.resolve(annotations(spark, d), tuple(x for x in groundtruth.INVOICE_RULES if x.path == "currency"))
    return r.groupBy("state", "value", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {S.RECORDS}, l AS (SELECT doc_id, CAST(json_extract(meta, '$.labels') AS VARCHAR[]) AS x FROM rec) SELECT doc_id, CASE WHEN list_contains(x, 'SELLER') THEN 'SELLER' END AS seller, CASE WHEN list_contains(x, 'SEND_TO') THEN 'SEND_TO' END AS ship_to,
  CASE WHEN list_contains(x, 'BUYER') AND list_contains(x, 'BILL_TO') THEN NULL WHEN list_contains(x, 'BUYER') THEN 'BUYER' WHEN list_contains(x, 'BILL_TO') THEN 'BILL_TO' END AS customer, list_contains(x, 'BUYER') AND list_contains(x, 'BILL_TO') AS collision FROM l WHERE x IS NOT NULL""")
def party_roles(spark, d):  # noqa: ANN001, ANN201
    labels = F.from_json(F.get_json_object("meta", "$.labels"), "array<string>")
    r = current_records(table(spark, d, "gt_records")).select("doc_id", labels.alias("labels")).filter("labels is not null").select("doc_id", groundtruth.party_roles(F.col("labels")).alias("r"))
    return r.select("doc_id", F.col("r.seller").alias("seller"), F.col("r.shipTo").alias("ship_to"), F.col("r.customer").alias("customer"), F.col("r.collision").alias("collision"))


_CAPTION = "CASE l_linenumber % 3 WHEN 0 THEN 'PB1 10%' WHEN 1 THEN 'Tax: ' ELSE 'Service 5,5 %' END"


@query(f"""WITH o AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, {_CAPTION} AS caption, CAST(l_quantity AS BIGINT) % 5 AS value FROM lineitem), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY pos) AS rn FROM o) WHERE rn = 1)
  SELECT doc_id, pos, value, CASE WHEN caption = 'PB1 10%' THEN 'PB1' WHEN caption = 'Tax: ' THEN 'Tax:' ELSE 'Service' END AS key, CASE WHEN caption = 'PB1 10%' THEN '10%' WHEN caption <> 'Tax: ' THEN '5,5 %' END AS percentage FROM f""")
def dedupe_keyed_rows(spark, d):  # noqa: ANN001, ANN201
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.expr(_CAPTION).alias("caption"), (F.col("l_quantity").cast("long") % 5).alias("value"))
    return groundtruth.keyed_rows(o, ["doc_id"]).select("doc_id", "pos", "value", "key", "percentage")


@query("""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_partkey % 3 AS name, l_suppkey % 2 AS price, CAST(l_discount * 100 AS DECIMAL(9,2)) AS disc FROM lineitem)
  SELECT doc_id, pos, CASE WHEN n > 1 AND lo <> hi THEN NULL ELSE disc END AS disc, n > 1 AND lo <> hi AS dropped FROM (SELECT *, count(*) OVER w AS n, min(disc) OVER w AS lo, max(disc) OVER w AS hi FROM r WINDOW w AS (PARTITION BY doc_id, name, price))""")
def unattributable_cells(spark, d):  # noqa: ANN001, ANN201
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 3).alias("name"), (F.col("l_suppkey") % 2).alias("price"), (F.col("l_discount") * 100).cast("decimal(9,2)").alias("disc"))
    out = groundtruth.without_unattributable(r, ["doc_id"], ["name", "price"], ["disc"])
    return out.select("doc_id", "pos", "disc", (F.size("dropped") > 0).alias("dropped"))


# sampling -----------------------------------------------------------------------------------------------------------

_RANK = "row_number() OVER (PARTITION BY {by} ORDER BY {order})"


@query(f"""WITH {S.RECORDS} SELECT doc_id, cluster_id FROM (SELECT doc_id, cluster_id, {_RANK.format(by='cluster_id', order='doc_id')} AS rn, count(*) OVER (PARTITION BY cluster_id) AS n FROM rec) WHERE rn = least(2, n)""")
def smoke_plan(spark, d):  # noqa: ANN001, ANN201
    return sampling.smoke_plan(current_records(table(spark, d, "gt_records")))


@query(f"""WITH {S.RECORDS} SELECT doc_id, keyset_id FROM (SELECT doc_id, keyset_id, {_RANK.format(by='keyset_id', order='doc_id')} AS rn, count(*) OVER (PARTITION BY keyset_id) AS n FROM rec) WHERE rn - 1 = floor(n / 2)""")
def pilot_plan(spark, d):  # noqa: ANN001, ANN201
    return sampling.pilot_plan(current_records(table(spark, d, "gt_records")))


_MAIN = f"""WITH {S.RECORDS}, p AS (SELECT doc_id, cluster_id, {_RANK.format(by='cluster_id', order="sha256('seed-7:' || doc_id)")} - 1 AS position FROM rec)"""


@query(f"{_MAIN} SELECT doc_id, cluster_id, position FROM p WHERE position < 20")
def main_plan_hash(spark, d):  # noqa: ANN001, ANN201
    return sampling.main_plan(current_records(table(spark, d, "gt_records")), 20, "seed-7")


@query(f"{_MAIN} SELECT doc_id, cluster_id, position, CAST(floor(position / 5) AS BIGINT) AS slice FROM p WHERE position < 20")
def plan_slices(spark, d):  # noqa: ANN001, ANN201
    return sampling.plan_slices(main_plan_hash(spark, d), 5)


_BAND = "CASE WHEN n IS NULL OR n = 0 THEN 'none' WHEN n = 1 THEN 'single' WHEN n <= 3 THEN 'small' WHEN n <= 9 THEN 'medium' ELSE 'large' END"


def _banded(spark: SparkSession, d: str) -> DataFrame:
    n = F.get_json_object("meta", "$.n_gt_rows").cast("int")
    return current_records(table(spark, d, "gt_records")).select("doc_id", n.alias("n"), sampling.stratum(n).alias("band"))


_BANDED = f"{S.RECORDS}, b AS (SELECT doc_id, n, {_BAND} AS band FROM (SELECT doc_id, CAST(json_extract_string(meta, '$.n_gt_rows') AS INT) AS n FROM rec))"


@query(f"""WITH {_BANDED} SELECT doc_id, band FROM (SELECT doc_id, band, {_RANK.format(by='band', order="sha256('42:' || doc_id)")} AS rn FROM b) ORDER BY rn, band, doc_id LIMIT 50""")
def stratified_round_robin(spark, d):  # noqa: ANN001, ANN201
    return sampling.stratified_round_robin(_banded(spark, d), "band", 50, "42")


@query(f"""WITH {_BANDED} SELECT doc_id, band, n FROM (SELECT doc_id, band, n, {_RANK.format(by='band', order='n DESC NULLS LAST, doc_id')} AS rn FROM b) WHERE rn <= CASE band WHEN 'large' THEN 4 WHEN 'medium' THEN 8 WHEN 'small' THEN 8 WHEN 'single' THEN 10 ELSE 10 END""")
def quota_topk(spark, d):  # noqa: ANN001, ANN201
    return sampling.quota_sample(_banded(spark, d), "band", {"large": 4, "medium": 8, "small": 8, "single": 10, "none": 10}, "n")


@query("WITH m AS (SELECT DISTINCT plan_name, unnest(doc_ids) AS doc_id FROM plans) SELECT a.plan_name AS plan_a, b.plan_name AS plan_b, count(*) AS n_shared FROM m a JOIN m b USING (doc_id) WHERE a.plan_name < b.plan_name GROUP BY ALL")
def plan_overlap(spark, d):  # noqa: ANN001, ANN201
    return sampling.plan_overlap(table(spark, d, "plans"))


# runs ---------------------------------------------------------------------------------------------------------------


@query("WITH o AS (SELECT DISTINCT run_id, doc_id FROM doc_results WHERE ok), k AS (SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id) SELECT run_id, count(*) AS n_docs, count_if(n > 1) AS n_shared FROM o JOIN k USING (doc_id) GROUP BY run_id")
def run_overlap(spark, d):  # noqa: ANN001, ANN201
    return runs.run_overlap(table(spark, d, "doc_results"))


_CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, doc_id ORDER BY written_at DESC NULLS LAST, {ties}) AS rn FROM doc_results) WHERE rn = 1)"


@query(f"""SELECT run_id, count(*) AS n_docs, count_if(ok) AS n_ok, coalesce(sum(tokens['input']), 0) AS input_tokens, coalesce(sum(tokens['output']), 0) AS output_tokens, coalesce(sum(tokens['thinking']), 0) AS thinking_tokens,
  coalesce(sum(CAST(round(cost_usd, 6) AS DECIMAL(18,6))), 0) AS cost_usd, sum(attempts) AS attempts FROM {_CURRENT.format(ties="cost_usd, attempts, tokens['total']")} GROUP BY run_id""")
def cost_rollup(spark, d):  # noqa: ANN001, ANN201
    return runs.cost_rollup(table(spark, d, "doc_results"))


@query(f"""SELECT run_id, round((coalesce(sum(tokens['input']), 0) * 1.25 + (coalesce(sum(tokens['output']), 0) + coalesce(sum(tokens['thinking']), 0)) * 10.0) / 1e6, 6) AS cost FROM {_CURRENT.format(ties="cost_usd, attempts, tokens['total']")} GROUP BY run_id""")
def cost_projection(spark, d):  # noqa: ANN001, ANN201
    return runs.priced(table(spark, d, "doc_results"), 1.25, 10.0)


@query(f"SELECT stage, status, count(*) AS n, count(DISTINCT run_id) AS n_runs FROM (SELECT run_id, e.key AS stage, e.value AS status FROM (SELECT run_id, unnest(map_entries(stage_status)) AS e FROM {_CURRENT.format(ties='ok')})) GROUP BY ALL")
def stage_failures(spark, d):  # noqa: ANN001, ANN201
    return runs.stage_failures(table(spark, d, "doc_results"))


@query("""WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, doc_id, stage, arm ORDER BY received_at DESC NULLS LAST) AS rn FROM stage_outputs) WHERE rn = 1)
  SELECT stage, count(*) AS n, count_if(cached) AS n_cached, count_if(stage_ms IS NULL) AS n_untimed, count_if(coalesce(len(warnings), 0) > 0) AS n_warned FROM s GROUP BY stage""")
def stage_summary(spark, d):  # noqa: ANN001, ANN201
    s = runs.current_stages(table(spark, d, "stage_outputs"))
    return s.groupBy("stage").agg(F.count("*").alias("n"), F.count_if("cached").alias("n_cached"), F.count_if(F.col("stage_ms").isNull()).alias("n_untimed"), F.count_if(F.size("warnings") > 0).alias("n_warned"))


@query("SELECT DISTINCT r.doc_id FROM gt_records r WHERE NOT EXISTS (SELECT 1 FROM stage_outputs s WHERE s.stage = 'extract' AND s.data IS NOT NULL AND s.doc_id = r.doc_id)")
def cache_misses(spark, d):  # noqa: ANN001, ANN201
    return runs.cache_misses(table(spark, d, "stage_outputs"), "extract", table(spark, d, "gt_records"))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(28,2)) AS total, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS line_sum FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice)
  SELECT audit, count(*) AS n FROM (SELECT CASE WHEN line_sum IS NULL OR total IS NULL THEN 'unknown' WHEN abs(line_sum - total) <= greatest(1, CAST(abs(total) * 0.01 AS DECIMAL(28,2))) THEN 'agrees'
    WHEN abs(line_sum * 1000 - total) <= greatest(1, CAST(abs(total) * 0.01 AS DECIMAL(28,2))) OR abs(line_sum - total * 1000) <= greatest(1, CAST(abs(total * 1000) * 0.01 AS DECIMAL(28,2))) THEN 'thousandfold' ELSE 'differs' END AS audit FROM s) GROUP BY audit""")
def arithmetic_audit(spark, d):  # noqa: ANN001, ANN201
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("line_sum"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(28,2)").alias("total"))
    return runs.line_sum_audit(o.join(sums, "o_orderkey", "left")).groupBy("audit").agg(F.count("*").alias("n"))


def _arm_json(spark: SparkSession, d: str, arm: str) -> DataFrame:
    return predictions(table(spark, d, "doc_results")).filter(F.col("arm") == arm).select("run_id", "doc_id", F.to_json("payload").alias("payload_json"))


@query(f"""{_LEAVES}, {_ARM_PAIR.format(b="b", a="a", x="RAW", y="RAW_POSTPROCESSED")}, n AS (SELECT DISTINCT run_id, doc_id FROM r_arms WHERE path = 'RAW_POSTPROCESSED' AND json_type(v) IN ('OBJECT', 'ARRAY'))
  SELECT regexp_replace(b.p, '\\[\\d+\\]', '[]', 'g') AS field, count(*) AS n, count(DISTINCT (b.run_id, b.doc_id)) AS n_docs FROM b SEMI JOIN n USING (run_id, doc_id)
  LEFT JOIN a ON a.run_id = b.run_id AND a.doc_id = b.doc_id AND a.p = b.p AND {_SAYS.format(c="a.leaf")} WHERE {_SAYS.format(c="b.leaf")} AND a.p IS NULL GROUP BY 1""")
def introduced_nulls(spark, d):  # noqa: ANN001, ANN201
    arms = predictions(table(spark, d, "doc_results")).filter(F.col("arm").isin("RAW", "RAW_POSTPROCESSED"))
    of = lambda arm: F.when(F.col("arm") == arm, F.to_json("payload"))
    return runs.nulled_fields(arms.select("run_id", "doc_id", of("RAW").alias("before"), of("RAW_POSTPROCESSED").alias("after")), ["run_id", "doc_id"])


@query(f"""{_LEAVES}, {_ARM_PAIR.format(b="b", a="a", x="RAW_POSTPROCESSED", y="FINAL")}
  SELECT regexp_replace(p, '\\[\\d+\\]', '[]', 'g') AS field, CASE WHEN b.leaf IS NULL THEN 'added' WHEN a.leaf IS NULL THEN 'dropped' ELSE 'changed' END AS change, count(*) AS n
  FROM b FULL JOIN a USING (run_id, doc_id, p) WHERE b.leaf IS DISTINCT FROM a.leaf GROUP BY ALL""")
def leaf_changes(spark, d):  # noqa: ANN001, ANN201
    c = runs.leaf_changes(_arm_json(spark, d, "RAW_POSTPROCESSED"), _arm_json(spark, d, "FINAL"), ["run_id", "doc_id"])
    return c.groupBy(F.regexp_replace("leaf_path", r"\[\d+\]", "[]").alias("field"), "change").agg(F.count("*").alias("n"))


@query()
def difference_causes(spark, d):  # noqa: ANN001, ANN201
    """Fields of the final arm on which the application and the run differ, by the stage whose value tells why."""
    c = runs.attributed_differences(table(spark, d, "doc_results"), table(spark, d, "app_results"), table(spark, d, "stage_outputs"))
    return c.groupBy("cause", "diff_kind").agg(F.count("*").alias("n"))


@query(f"""{T._NODES}, ok AS (SELECT run_id, doc_id FROM (SELECT run_id, doc_id, ok, row_number() OVER (PARTITION BY run_id, doc_id ORDER BY written_at DESC NULLS LAST, arms, judge) AS rn FROM doc_results) WHERE rn = 1 AND ok)
  SELECT e->>'issue_type' AS issue_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM nodes SEMI JOIN ok USING (run_id, doc_id) WHERE tab = 'issues' GROUP BY ALL""")
def judge_issue_counts(spark, d):  # noqa: ANN001, ANN201
    from fieldscore.operators.metrics import judge_flags

    return judge_flags(table(spark, d, "doc_results")).groupBy("issue_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("""SELECT doc_id, source_dataset, doc_type, image_path, cluster_id, keyset_id, meta, list_aggregate(list_sort(annotated_fields), 'string_agg', '|') AS annotated,
  list_aggregate(list_sort(list_transform(map_entries(gt), lambda e: e.key || '=' || e.value)), 'string_agg', '|') AS truth,
  list_aggregate(list_sort(list_transform(map_entries(excluded_fields), lambda e: e.key || '=' || e.value)), 'string_agg', '|') AS excluded, count(*) AS n_rows FROM gt_records GROUP BY ALL""")
def ground_truth_roundtrip(spark, d):  # noqa: ANN001, ANN201
    """Records written as JSON lines and read again, all columns and rows."""
    from fieldscore.sources.records import read_records, write_records

    path = scratch(spark, "records")
    write_records(table(spark, d, "gt_records"), path)
    r = read_records(spark, path)
    line = lambda xs: F.when(F.size(xs) > 0, F.array_join(F.array_sort(xs), "|"))
    pairs = lambda c: line(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    keys = ["doc_id", "source_dataset", "doc_type", "image_path", "cluster_id", "keyset_id", "meta"]
    wide = r.select(*keys, line(F.col("annotated_fields")).alias("annotated"), pairs("gt").alias("truth"), pairs("excluded_fields").alias("excluded"))
    return wide.groupBy(*wide.columns).agg(F.count("*").alias("n_rows"))


@query(S.over_verdicts("SELECT arm, path, rule, state, count(*) AS n FROM verdicts GROUP BY ALL"))
def streaming_verdicts(spark, d):  # noqa: ANN001, ANN201
    """The verdict states of results that arrive as files, by micro-batches; the same as over the whole table."""
    from fieldscore.streaming.verdict_stream import run_to_table

    return run_to_table(spark, f"{d}/doc_results.parquet", table(spark, d, "gt_records")).groupBy("arm", "path", "rule", "state").agg(F.count("*").alias("n"))


@query()
def gt_invoice_truth(spark, d):  # noqa: ANN001, ANN201
    """Ground truth of annotations by the full rule table, parties and several tax rates included, counted by field and state."""
    ann = annotations(spark, d).groupBy("doc_id", "template").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("label", "raw")))).alias("annotation"))  # a document's labels
    named = ann.select(F.concat_ws("_", F.col("template").cast("string"), F.col("doc_id").cast("string")).alias("doc_id"), "annotation")
    return adapters.invoice_truth(named)[0].groupBy("path", "state").agg(F.count("*").alias("n"))


@query()
def stage_replay(spark, d):  # noqa: ANN001, ANN201
    """The pipeline run again over all documents with recorded outputs only: how each stage of each document ends."""
    outputs = table(spark, d, "stage_outputs")
    plan = outputs.select("doc_id").distinct()
    done = stages.run_plan(plan, {}, "replay", ["RAW"], cache=stages.recorded(outputs.withColumn("stage", F.when(F.col("stage") == "extract", "extraction_postprocessing").otherwise(F.col("stage"))).unionByName(outputs.filter("stage = 'extract'"))))
    return stages.stage_dumps(done).groupBy("stage", "status").agg(F.count("*").alias("n"))


@query()
def derived_arm_sizes(spark, d):  # noqa: ANN001, ANN201
    """Documents of every arm, those derived from stage dumps included."""
    arms = runs.derive_arms(table(spark, d, "doc_results"), table(spark, d, "stage_outputs"), {"EXTRACT": "extract", "REFINED": "refine"})
    return arms.groupBy("arm").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query()
def numeric_census(spark, d):  # noqa: ANN001, ANN201
    """Numeric values of every arm, and how many of them are normalised."""
    p = predictions(table(spark, d, "doc_results")).select("run_id", "doc_id", "arm", F.to_json("payload").alias("payload_json"))
    return diagnostics.numeric_census(p, ["run_id", "doc_id", "arm"])


@query()
def wire_defects(spark, d):  # noqa: ANN001, ANN201
    """Lists leaked into values, two taxes in one amount, and numbers that disagree with themselves, by arm."""
    p = predictions(table(spark, d, "doc_results")).select("run_id", "doc_id", "arm", F.to_json("payload").alias("payload_json"))
    return diagnostics.wire_defects(p, ["run_id", "doc_id", "arm"])


@query("SELECT 'all' AS run_id, CAST(sum(CAST(round(total_cost_usd, 6) AS DECIMAL(18,6))) AS DOUBLE) AS total_cost_usd, count(*) AS n_runs, count(DISTINCT run_id) AS n_sources FROM runs")
def merged_manifest(spark, d):  # noqa: ANN001, ANN201
    """All runs as one: their cost, and from how many."""
    m = table(spark, d, "runs")
    ids = [r[0] for r in m.select("run_id").distinct().limit(10_000).collect()]  # the manifests of a project
    return runs.merged_manifest(m, ids, "all").select("run_id", F.col("total_cost_usd").cast("double").alias("total_cost_usd"), "n_runs", F.size("sources").alias("n_sources"))


@query()
def score_summary(spark, d):  # noqa: ANN001, ANN201
    """The summary of all runs scored as one, by arm."""
    from fieldscore.operators.score import score_run

    return score_run(table(spark, d, "gt_records"), table(spark, d, "doc_results"), allow_arm_mismatch=True).tables["summary"]
