"""Run algebra: merging runs, deriving arms, differences and their cause, costs, stages, caches and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscore.operators.current import current_rows
from fieldscore.operators.diff import PayloadForm, bare_leaves, json_differences, json_leaves, lost_leaves, same_print

LADDER = ("SERVE-LAYER", "FORMAT", "UNATTRIBUTED", "JUDGE+REFINE", "EXTRACTION", "TAIL")


def merge_runs(results: DataFrame, manifests: DataFrame, run_ids: list[str], to: str, same: tuple[str, ...] = ("doc_type", "field_map_version", "tail_version", "image_prep")) -> DataFrame:
    """Union of the ok documents of several runs under one name; refused where runs differ in their system or a
    document comes twice."""
    m = manifests.filter(F.col("run_id").isin(*run_ids))
    differ = m.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in same]).first().asDict()
    if bad := [k for k, n in differ.items() if n > 1]:
        raise ValueError(f"runs differ in {bad}")
    merged = current_rows(results.filter(F.col("run_id").isin(*run_ids)), ["run_id", "doc_id"], "written_at").filter("ok")
    if twice := merged.groupBy("doc_id").count().filter("count > 1").limit(3).collect():
        raise ValueError(f"documents in several runs: {[r[0] for r in twice]}")
    return merged.withColumnRenamed("run_id", "source_run").withColumn("run_id", F.lit(to))


def merged_manifest(manifests: DataFrame, run_ids: list[str], to: str) -> DataFrame:
    """One manifest of several runs: costs and tokens summed, the sources named, and what they don't agree on."""
    m = manifests.filter(F.col("run_id").isin(*run_ids))
    tokens = m.select(F.explode("tokens").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("tokens"))  # a handful of kinds
    differ = F.array_compact(F.array(*[F.when(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))) > 1, F.lit(c)) for c in ("doc_type", "dataset", "field_map_version", "tail_version", "image_prep")]))
    cost = F.sum(F.round("total_cost_usd", 6).cast("decimal(18,6)")).alias("total_cost_usd")
    return m.agg(F.lit(to).alias("run_id"), cost, F.array_sort(F.collect_set("run_id")).alias("sources"), differ.alias("mismatch"), F.count("*").alias("n_runs")).join(tokens, how="left")


def derive_arms(results: DataFrame, stage_outputs: DataFrame, arms: dict[str, str]) -> DataFrame:
    """(run_id, doc_id, arm, data) of ok results: their own arms, and one for each stage named in ``arms`` (arm -> stage) from
    its current dump. A dump without data gives none; a name that a result has itself is an error downstream, not here."""
    keys = ["run_id", "doc_id"]
    cur = current_rows(results.select(*keys, "ok", "arms", "written_at"), keys, "written_at", [F.xxhash64("arms")]).filter("ok")
    own = cur.select(*keys, F.explode(F.try_variant_get(F.try_parse_json("arms"), "$", "map<string,variant>")).alias("arm", "v")).filter(~F.col("arm").startswith("_")).select(*keys, "arm", F.to_json("v").alias("data"))
    of = F.create_map(*[F.lit(x) for arm, stage in arms.items() for x in (stage, arm)])
    dumps = stage_outputs.filter(F.col("stage").isin(*arms.values())).select(*keys, "stage", "data", "received_at")
    last = current_rows(dumps, [*keys, "stage"], "received_at", [F.xxhash64("data")]).filter("data is not null")
    return own.unionByName(last.join(cur.select(*keys), keys, "left_semi").select(*keys, F.try_element_at(of, F.col("stage")).alias("arm"), "data"))


def backfill_arm(arms: DataFrame, source: str, to: str, computed: DataFrame) -> DataFrame:
    """``arms`` (run_id, doc_id, arm, data) with the arm ``to`` from ``computed`` (run_id, doc_id, data): all or nothing, so a run whose
    ``source`` has a document that wasn't computed is refused, and so is an arm that is there already."""
    keys = ["run_id", "doc_id"]
    if not arms.filter(F.col("arm") == to).isEmpty():
        raise ValueError(f"there is an arm {to} already")
    missing = arms.filter(F.col("arm") == source).join(computed.filter("data is not null").select(*keys), keys, "left_anti").limit(3).collect()
    if missing:
        raise ValueError(f"not computed for {[tuple(r[k] for k in keys) for r in missing]}")
    there = computed.join(arms.filter(F.col("arm") == source).select(*keys), keys, "left_semi")
    return arms.unionByName(there.select(*keys, F.lit(to).alias("arm"), "data"))


def rebuilt(arms: DataFrame, again: DataFrame, arm: str = "FINAL") -> tuple[DataFrame, DataFrame]:
    """``arms`` with ``arm`` from ``again`` (run_id, doc_id, data), documents that weren't made again dropped from it, and how many
    leaves of what kind changed by field."""
    keys = ["run_id", "doc_id"]
    old = arms.filter(F.col("arm") == arm).select(*keys, F.col("data").alias("payload_json"))
    new = again.filter("data is not null").select(*keys, F.col("data").alias("payload_json"))
    changes = leaf_changes(old.join(new.select(*keys), keys, "left_semi"), new, keys)
    field = F.regexp_replace("leaf_path", r"\[\d+\]", "[]")
    histogram = changes.groupBy(field.alias("field"), "change").agg(F.count("*").alias("n"), F.count_distinct(*keys).alias("n_docs"))
    return arms.filter(F.col("arm") != arm).unionByName(new.select(*keys, F.lit(arm).alias("arm"), F.col("payload_json").alias("data"))), histogram


def provenance_trace(doc_id: str, gt_records: DataFrame, results: DataFrame, stage_outputs: DataFrame) -> DataFrame:
    """(layer, run_id, name, at, value): one document through every layer: its deliveries of truth, its stages, its results."""
    none = F.lit(None).cast("string")
    d = F.col("doc_id") == doc_id
    truth = gt_records.filter(d).select(F.lit("truth").alias("layer"), none.alias("run_id"), F.lit("gt").alias("name"), F.col("received_at").cast("string").alias("at"), F.to_json("gt").alias("value"))
    staged = stage_outputs.filter(d).select(F.lit("stage"), "run_id", F.concat_ws("/", "stage", "arm"), F.col("received_at").cast("string"), "data")
    made = results.filter(d).select(F.lit("result"), "run_id", F.when(F.col("ok"), "ok").otherwise(F.concat_ws(": ", F.lit("failed"), "error_stage")), F.col("written_at").cast("string"), "arms")
    return truth.union(staged).union(made)


def run_overlap(results: DataFrame) -> DataFrame:
    """By run: ok documents, and those that another run has too."""
    docs = results.filter("ok").select("run_id", "doc_id").distinct()
    runs_of = docs.groupBy("doc_id").agg(F.count("*").alias("n_runs"))
    return docs.join(runs_of, "doc_id").groupBy("run_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("n_runs") > 1).alias("n_shared"))


def leaf_changes(before: DataFrame, after: DataFrame, keys: list[str], column: str = "payload_json") -> DataFrame:
    """(keys, leaf_path, change): leaves added, dropped or changed between two states of one payload."""
    form = PayloadForm(hidden="\0")
    leaves = lambda df, sign: df.select(*keys, F.inline(json_leaves(F.concat(F.lit('{"p":'), F.col(column), F.lit("}")), form))).withColumn("n", F.lit(sign))
    cells = leaves(before, 1).unionByName(leaves(after, -1)).groupBy(*keys, "leaf_path", "leaf").agg(F.sum("n").alias("n")).filter("n <> 0")
    g = cells.groupBy(*keys, "leaf_path").agg(F.max(F.col("n") > 0).alias("b"), F.max(F.col("n") < 0).alias("a"))
    return g.select(*keys, F.substring("leaf_path", 3, 1 << 20).alias("leaf_path"), F.when(F.col("a") & F.col("b"), "changed").when(F.col("b"), "dropped").otherwise("added").alias("change"))


def introduced_nulls(before: DataFrame, after: DataFrame, keys: list[str], column: str = "payload_json") -> DataFrame:
    """(field, n, n_docs): leaves that said something before and are null or gone after; list positions become []."""
    none = F.lit(None).cast("string")
    sides = before.select(*keys, F.col(column).alias("before"), none.alias("after")).union(after.select(*keys, none, F.coalesce(column, F.lit("null"))))
    return nulled_fields(sides, keys)


def nulled_fields(states: DataFrame, keys: list[str]) -> DataFrame:
    """`introduced_nulls` of (keys, before, after): each row holds one state of a document, or both, as JSON text.

    The states of a document meet in one group and only what was lost leaves it. A join of their leaves would be broadcast
    at any size: Spark takes a variant for 2 KB, and so what is read out of one for some forty times smaller than it is.
    """
    text = lambda c: F.collect_list(F.concat(F.lit('{"p":'), F.col(c), F.lit("}"))).alias(c)
    keyed = states.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    docs = keyed.groupBy(*keys).agg(text("before"), text("after"))  # a document's own states only
    # documents without the later state don't count as nulled
    docs = docs.filter((F.size("before") > 0) & (F.size("after") > 0))
    lost = docs.select(*keys, F.explode(lost_leaves(F.col("before"), F.col("after"), PayloadForm(hidden="\0"))).alias("leaf_path"))
    field = F.regexp_replace(F.substring("leaf_path", 3, 1 << 20), r"\[\d+\]", "[]")
    return lost.withColumn("field", field).groupBy("field").agg(F.count("*").alias("n"), F.count_distinct(*keys).alias("n_docs"))


def difference_cause(serve_only: Column, same_text: Column, has_refined: Column, refine_differs: Column, run_as_extracted: Column) -> Column:
    """The first rung of the ladder that explains a difference between an application's value and a run's."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(serve_only), "SERVE-LAYER")
        .when(yes(same_text), "FORMAT")
        .when(~yes(has_refined), "UNATTRIBUTED")
        .when(yes(refine_differs), "JUDGE+REFINE")
        .when(yes(run_as_extracted), "EXTRACTION")
        .otherwise("TAIL")
    )


def attributed_differences(results: DataFrame, app: DataFrame, stage_outputs: DataFrame, arm: str = "FINAL", extract: str = "extract", refine: str = "refine", serve_keys: tuple[str, ...] = ("documentType",)) -> DataFrame:
    """(run_id, doc_id, leaf_path, diff_kind, cause): the leaves of one arm on which the application and the run differ.

    Each leaf is looked up in the current dumps of extraction and refinement; a leaf that both dumps lack is the same in
    both. Only documents that differ have their dumps read, one row a document. Documents on one side only differ in no leaf.
    """
    keys = ["run_id", "doc_id"]
    d = json_differences(results, app, keys, "arms", "written_at", "stored_at", left_filter=F.col("ok"), left_columns=("ok",), leaves=True)
    d = d.filter((F.col("leaf_path") == arm) | F.col("leaf_path").startswith(f"{arm}.") | F.col("leaf_path").startswith(f"{arm}["))
    d = d.groupBy(*keys).agg(F.collect_list(F.struct("leaf_path", "diff_kind", "run_leaf", "app_leaf")).alias("d"))  # at most the leaves of a document
    dumps = stage_outputs.filter(F.col("stage").isin(extract, refine)).select(*keys, "stage", "utc", "cached", "stage_ms", "data", "received_at")
    cur = current_rows(dumps, [*keys, "stage"], "received_at", [F.xxhash64("utc", "cached", "stage_ms", "data")])
    cur = cur.groupBy(*keys).agg(*[F.max(F.when(F.col("stage") == s, F.col("data"))).alias(n) for s, n in ((extract, "e"), (refine, "r"))])
    j = d.join(cur, keys, "left").withColumns({n: bare_leaves(F.col(n), arm) for n in "er"})
    j = j.select(*keys, "e", "r", F.explode("d").alias("d")).select(*keys, "e", "r", "d.*")
    at = lambda n: F.get(F.filter(F.col(n), lambda z: z["leaf_path"] == F.col("leaf_path")), F.lit(0))["leaf"]
    j = j.select(*keys, "leaf_path", "diff_kind", "run_leaf", "app_leaf", F.col("r").isNotNull().alias("refined"), at("e").alias("at_extract"), at("r").alias("at_refine"))
    j = j.withColumn("alike", same_print(F.col("run_leaf"), F.col("app_leaf")))
    serve = F.substring_index("leaf_path", ".", -1).isin(*serve_keys) & F.col("run_leaf").isNull()
    cause = difference_cause(serve, F.col("alike"), F.col("refined"), ~F.col("at_extract").eqNullSafe(F.col("at_refine")), F.col("at_extract").eqNullSafe(F.col("run_leaf")))
    return j.select(*keys, "leaf_path", "diff_kind", cause.alias("cause"))


def cost_rollup(results: DataFrame) -> DataFrame:
    """Tokens, cost and attempts by run over current rows; sums of money as decimals, so their order doesn't matter."""
    cur = current_rows(results.select("run_id", "doc_id", "ok", "tokens", "cost_usd", "attempts", "written_at"), ["run_id", "doc_id"], "written_at", [F.col("cost_usd"), F.col("attempts"), F.try_element_at("tokens", F.lit("total"))])
    tok = lambda k: F.coalesce(F.sum(F.try_element_at("tokens", F.lit(k))), F.lit(0)).alias(f"{k}_tokens")
    cost = F.coalesce(F.sum(F.round(F.col("cost_usd"), 6).cast("decimal(18,6)")), F.lit(0).cast("decimal(28,6)"))
    return cur.groupBy("run_id").agg(F.count("*").alias("n_docs"), F.count_if("ok").alias("n_ok"), tok("input"), tok("output"), tok("thinking"), cost.cast("decimal(28,6)").alias("cost_usd"), F.sum("attempts").alias("attempts"))


def priced(results: DataFrame, per_million_in: float, per_million_out: float) -> DataFrame:
    """The cost of each run at given prices: thinking is billed as output."""
    r = cost_rollup(results)
    return r.select("run_id", F.round((F.col("input_tokens") * per_million_in + (F.col("output_tokens") + F.col("thinking_tokens")) * per_million_out) / 1e6, 6).alias("cost"))


def stage_failures(results: DataFrame) -> DataFrame:
    """How often each stage ended how, over current rows."""
    cur = current_rows(results.select("run_id", "doc_id", "stage_status", "written_at"), ["run_id", "doc_id"], "written_at", [F.to_json("stage_status")])
    return cur.select("run_id", F.explode("stage_status").alias("stage", "status")).groupBy("stage", "status").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("n_runs"))


def utc_time(c: Column) -> Column:
    """A stage dump's time in any of its printed forms; null where none fits."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "dd/MM/yyyy HH:mm:ss")])


def current_stages(stage_outputs: DataFrame) -> DataFrame:
    """The last dump of each (run, document, stage, arm)."""
    return current_rows(stage_outputs, ["run_id", "doc_id", "stage", "arm"], "received_at", [F.xxhash64("utc", "cached", "stage_ms", "data")])


def cache_misses(stage_outputs: DataFrame, stage: str, wanted: DataFrame) -> DataFrame:
    """(doc_id) of ``wanted`` for which no run has a dump of the stage with data: what a resumed run has to do."""
    there = stage_outputs.filter((F.col("stage") == stage) & F.col("data").isNotNull()).select("doc_id")
    return wanted.select("doc_id").distinct().join(there, "doc_id", "left_anti")


def line_sum_audit(rows: DataFrame) -> DataFrame:
    """Adds a verdict to (line_sum, total): equal within one or a per cent, off by a thousand, or different."""
    a, b = F.col("line_sum"), F.col("total")
    near = lambda x, y: F.abs(x - y) <= F.greatest(F.lit(1).cast("decimal(28,2)"), (F.abs(y) * F.lit("0.01").cast("decimal(4,2)")).cast("decimal(28,2)"))
    return rows.withColumn("audit", F.when(a.isNull() | b.isNull(), "unknown").when(near(a, b), "agrees").when(near(a * 1000, b) | near(a, b * 1000), "thousandfold").otherwise("differs"))
