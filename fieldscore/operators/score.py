"""A run scored as a whole: guards, every result table, and their place on disk."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscore.operators import metrics as M
from fieldscore.operators import rows
from fieldscore.operators.coverage import coverage
from fieldscore.operators.current import current_rows
from fieldscore.operators.runs import introduced_nulls
from fieldscore.operators.verdicts import current_records, predictions, verdicts
from fieldscore.options import ScoringOptions
from fieldscore.session import cut


@dataclass
class ScoreResult:
    """The tables of a scored run; ``tables`` has them by name, each with the run's key columns."""

    options: ScoringOptions
    n_documents_scored: int
    arm_denominators_equal: bool
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def write(self, folder: str, dataset: str) -> None:
        """Each table under ``<folder>/<table>/dataset=/policy=``: results of another truth or policy never overwrite these, and
        an existing one is refused."""
        for name, df in self.tables.items():
            df.write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{name}/dataset={dataset}/policy={self.options.match_policy}")

    def report(self) -> str:
        """Markdown of the summary by arm; arms in the order of the options, others behind."""
        order = {a: i for i, a in enumerate(self.options.arm_order)}
        lines = sorted(self.tables["summary"].collect(), key=lambda r: (order.get(r["arm"], len(order)), r["arm"]))  # one row an arm
        head = ["arm", "n_instances", "n_docs", "micro_accuracy", "macro_accuracy", "headline_accuracy", "correct_null_rate", "hallucinations"]
        out = ["| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
        return "\n".join(out + ["| " + " | ".join("" if r[h] is None else str(r[h]) for h in head) + " |" for r in lines])


def score_run(gt_records: DataFrame, doc_results: DataFrame, options: ScoringOptions = ScoringOptions(), allow_arm_mismatch: bool = False, least_docs: int = 30, least_values: int = 20, sections: dict[str, tuple[rows.Target, ...]] | None = None) -> ScoreResult:
    """Every table that scoring a run gives: verdicts, denominators, per_field (with intervals and coverage), summary, no_tax,
    lift, judge, leaves_nulled, sections, per_cell.

    Arms of one run that hold different numbers of documents are an error unless ``allow_arm_mismatch``. Documents count as
    scored before the truth is asked for. The verdicts are written once in the shared folder and read by all tables.
    """
    v = cut(verdicts(gt_records, doc_results, options).select("run_id", "doc_id", "arm", "path", "rule", "cluster_id", "no_tax", "state", "ok", "exact", "ok_convention", "score", "value_source"))
    denominators = M.arm_denominators(v)
    uneven = denominators.groupBy("run_id").agg(F.count_distinct("n_docs").alias("k")).filter("k > 1").limit(5).collect()
    if uneven and not allow_arm_mismatch:
        raise ValueError(f"arms of different size in runs {[r[0] for r in uneven]}")
    eligible = coverage(gt_records, least_docs, least_values)
    headline = eligible.filter("headline_eligible").select("path").distinct()
    told = eligible.groupBy("path").agg(F.sum("n_docs").alias("gt_docs"), F.max("headline_eligible").alias("headline_eligible"))
    preds = cut(predictions(doc_results))
    cells_of = sections or {"lineItems": rows.LINE_ITEM_TARGETS}
    truth = current_records(gt_records).select("doc_id", "gt")
    long = preds.join(truth, "doc_id").select("run_id", "doc_id", "arm", F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.try_element_at("gt", F.lit(s)).alias("gt_rows"), F.to_json(F.try_variant_get("payload", f"$.{s}", "variant")).alias("pred_rows")) for s in cells_of])))
    aligned = cut(rows.aligned(long.filter("gt_rows is not null and gt_rows <> '__ABSENT__'"), options=options))
    cells = cut(rows.row_cells(aligned, cells_of, options))
    arms = [a for a in options.arm_order]
    pairs = [(a, b) for i, a in enumerate(arms) for b in arms[i + 1 :]]
    lift = None
    for a, b in pairs:
        one = M.stage_lift(v, a, b)
        lift = one if lift is None else lift.unionByName(one)
    payload = lambda arm: preds.filter(F.col("arm") == arm).select("run_id", "doc_id", F.to_json("payload").alias("payload_json"))
    tables = {
        "verdicts": v, "arm_denominators": denominators, "per_field": M.per_field(v).join(M.bootstrap_intervals(v, options=options).select("arm", "path", "low", "high"), ["arm", "path"], "left").join(told, "path", "left"),
        "summary": M.summary(v, headline), "no_tax_slice": M.no_tax_slice(v), "judge": M.detector_matrix(M.with_flag(v, M.judge_flags(doc_results)), arms[0], arms[-1]),
        "leaves_nulled": introduced_nulls(payload(arms[0]), payload(arms[1]), ["run_id", "doc_id"]) if len(arms) > 1 else None,
        "sections": rows.sections_by_path(rows.section_documents(aligned, cells)), "per_cell": rows.per_cell(cells), "lift": lift,
    }
    scored = current_rows(doc_results.select("run_id", "doc_id", "ok", "written_at"), ["run_id", "doc_id"], "written_at").filter("ok").count()
    return ScoreResult(options, scored, not uneven, {k: t for k, t in tables.items() if t is not None})
