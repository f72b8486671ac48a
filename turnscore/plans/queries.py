"""Registered queries over the driver tables (Spark builder + DuckDB oracle)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscore import schemas as S
from turnscore.functions import text as TX
from turnscore.operators import absolute as AB
from turnscore.operators import metrics as M
from turnscore.operators import compare as CP
from turnscore.operators import confusion as CF
from turnscore.operators import curve as CU
from turnscore.operators import dialogue as DG
from turnscore.operators import models as ML
from turnscore.operators import report as RP
from turnscore.operators import sampling as SA
from turnscore.operators import scores as SC
from turnscore.operators import similarity as SI
from turnscore.operators import turns as TU
from turnscore.plans import fixtures as X
from turnscore.plans.registry import REGISTRY as _R, register, round_doubles, round_sql
from turnscore.session import shared_path
from turnscore.sources import readers as RD
from turnscore.sources import writers as WR
from turnscore.streaming import ingest as IN

# Strict ordinal prediction and hit tests in DuckDB (round half-even, clip 0..6).
STRICT_SQL = "CAST(least(6e0, greatest(0e0, round_even(pred, 0))) AS INTEGER)"
METRICS_SQL = f"""count(*) AS n, avg(pow(pred - label, 2)) AS mse, avg(abs(pred - label)) AS mae,
    avg(CASE WHEN {STRICT_SQL} = label THEN 1e0 ELSE 0e0 END) AS strict_acc,
    avg(CASE WHEN abs({STRICT_SQL} - label) <= 1 THEN 1e0 ELSE 0e0 END) AS tolerant_acc"""
METRIC_COLS = ["mse", "mae", "strict_acc", "tolerant_acc"]


# ---------------------------------------------------------------- evaluation
def _eval_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(M.evaluate(X.predictions(spark, sf), ["model", "topic"]))


register("eval_by_topic", "AG9 PR17 UD3", round_sql(
    X.with_views("predictions") + f"SELECT model, topic, {METRICS_SQL} FROM predictions GROUP BY model, topic",
    METRIC_COLS))(_eval_by_topic)


def _eval_overall(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(M.evaluate(X.predictions(spark, sf), ["model"]))


register("eval_overall", "AG9", round_sql(
    X.with_views("predictions") + f"SELECT model, {METRICS_SQL} FROM predictions GROUP BY model",
    METRIC_COLS))(_eval_overall)


def _mean_baseline_topic(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(M.mean_baseline_topic(X.predictions_wide(spark, sf)))


register("mean_baseline_topic", "AG7", round_sql(
    X.with_views("predictions_wide") + """, m AS (SELECT topic, avg(label) AS mu FROM predictions_wide GROUP BY topic)
    SELECT p.topic, m.mu AS mean_prediction, count(*) AS n,
           avg(pow(m.mu - p.label, 2)) AS mse, avg(abs(m.mu - p.label)) AS mae
    FROM predictions_wide p JOIN m USING (topic) GROUP BY p.topic, m.mu""",
    ["mean_prediction", "mse", "mae"]))(_mean_baseline_topic)


def _mean_baseline_overall(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(M.mean_baseline_overall(X.predictions_wide(spark, sf)))


register("mean_baseline_overall", "AG8", round_sql(
    X.with_views("predictions_wide") + """, m AS (SELECT topic, avg(label) AS mu FROM predictions_wide GROUP BY topic)
    SELECT count(*) AS n, avg(pow(m.mu - p.label, 2)) AS mse, avg(abs(m.mu - p.label)) AS mae,
           stddev_pop(m.mu - p.label) AS std_of_errors
    FROM predictions_wide p JOIN m USING (topic)""",
    ["mse", "mae", "std_of_errors"]))(_mean_baseline_overall)


# ------------------------------------------------------- ranks, folds, subsets


def _folded_wide(spark: SparkSession, sf: str, reused: bool = True, columns: tuple[str, ...] = ()) -> DataFrame:
    """Fold assignment. When several branches of a plan read it (``reused``), it is
    computed once and written to the shared checkpoint folder; a single reader
    keeps it in the plan."""
    folded = SA.kfold(X.predictions_wide(spark, sf), ["example_id"])
    if columns:
        folded = SA.kfold(X.predictions_wide(spark, sf).select(*columns), ["example_id"])
    if not reused:
        return folded
    from turnscore.session import materialize
    return materialize(folded, "folds")


KEYED = ("example_id", "topic", "label")


def _fold_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Two models' predictions tagged with the example's fold (folds assigned
    before the model explode, so no join)."""
    w = _folded_wide(spark, sf, reused=False)
    both = F.explode(F.array(
        F.struct(F.lit("base").alias("model"), F.col("pred_base").alias("pred")),
        F.struct(F.lit("tuned").alias("model"), F.col("pred_tuned").alias("pred"))))
    return w.select("example_id", "fold", "topic", "label", both.alias("m")) \
        .select("example_id", F.col("m.model").alias("model"), "fold", "topic", "label",
                F.col("m.pred").alias("pred"))


FOLDED_SQL = X.with_views("predictions_wide") + f""", ranked AS (
    SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', CAST(example_id AS VARCHAR), '{S.SEED}')),
                                 example_id) AS rnk,
           count(*) OVER () AS n_total FROM predictions_wide),
folded AS (SELECT *, CAST(CASE WHEN rnk - 1 < (n_total % {S.N_FOLDS}) * (n_total // {S.N_FOLDS} + 1)
        THEN (rnk - 1) // (n_total // {S.N_FOLDS} + 1)
        ELSE n_total % {S.N_FOLDS} + (rnk - 1 - (n_total % {S.N_FOLDS}) * (n_total // {S.N_FOLDS} + 1))
             // (n_total // {S.N_FOLDS}) END AS INTEGER) AS fold FROM ranked),
fold_predictions AS (
    SELECT example_id, 'base' AS model, fold, topic, label, pred_base AS pred FROM folded
    UNION ALL SELECT example_id, 'tuned' AS model, fold, topic, label, pred_tuned AS pred FROM folded)
"""


@register("exact_rank", "WI5 SO5", FOLDED_SQL + "SELECT example_id, rnk AS rank FROM ranked")
def _exact_rank(spark: SparkSession, sf: str) -> DataFrame:
    return SA.exact_rank(X.predictions_wide(spark, sf), ["example_id"]).select("example_id", "rank")


@register("kfold_assign", "WI3 FI10", FOLDED_SQL + "SELECT example_id, fold FROM folded")
def _kfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _folded_wide(spark, sf, reused=False).select("example_id", "fold")


EVAL_FOLDS_SQL = FOLDED_SQL + f"""SELECT model, fold, CASE WHEN GROUPING(topic) = 1 THEN 'ALL' ELSE topic END AS topic,
    {METRICS_SQL} FROM fold_predictions GROUP BY GROUPING SETS ((model, fold), (model, fold, topic))"""


@register("eval_by_fold_topic", "AG9 AG10 AG20 SE1 FI8 ML6", round_sql(EVAL_FOLDS_SQL, METRIC_COLS))
def _eval_by_fold_topic(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(M.evaluate_folds(_fold_predictions(spark, sf), ["model"]))


@register("cross_fold_summary", "AG11 SE2", round_sql(
    FOLDED_SQL + f""", fm AS (SELECT model, fold, CASE WHEN GROUPING(topic) = 1 THEN 'ALL' ELSE topic END AS topic,
    {METRICS_SQL} FROM fold_predictions GROUP BY GROUPING SETS ((model, fold), (model, fold, topic))),
    lng AS (UNPIVOT fm ON mse, mae, strict_acc, tolerant_acc INTO NAME metric VALUE value)
    SELECT model, topic, metric, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n_folds
    FROM lng GROUP BY model, topic, metric""", ["mean", "std"]))
def _cross_fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    fm = M.evaluate_folds(_fold_predictions(spark, sf), ["model"])
    return round_doubles(M.cross_fold(fm, ["model", "topic"]))


def _frac_case(rank: str, n: str) -> str:
    whens = " ".join(f"WHEN {rank} <= floor(CAST({n} AS DOUBLE) * CAST({f!r} AS DOUBLE)) THEN {i}"
                     for i, f in enumerate(S.FRACTIONS))
    return f"CASE {whens} END"


POOL_SQL = FOLDED_SQL + f""", pool AS (
    SELECT f.*, o.outer_fold,
           row_number() OVER (PARTITION BY o.outer_fold ORDER BY md5(concat_ws(':', CAST(f.example_id AS VARCHAR),
               '{S.SEED}:pool')), f.example_id) AS pool_rank
    FROM folded f JOIN (SELECT CAST(range AS INTEGER) AS outer_fold FROM range({S.N_FOLDS})) o
      ON f.fold <> o.outer_fold),
pool_idx AS (SELECT *, {_frac_case('pool_rank', 'n_total')} AS frac_idx FROM pool)
"""


@register("nested_prefix", "WI4 R8", POOL_SQL + "SELECT example_id, outer_fold, pool_rank, frac_idx FROM pool_idx")
def _nested_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return SA.nested_prefix(_folded_wide(spark, sf), ["example_id"]) \
        .select("example_id", "outer_fold", "pool_rank", "frac_idx")


@register("topic_mean_cv", "ML1 ML8", round_sql(FOLDED_SQL + f""", folds AS (SELECT DISTINCT fold FROM folded),
    tm AS (SELECT v.fold, t.topic, avg(t.label) AS mu FROM folds v JOIN folded t ON t.fold <> v.fold
           GROUP BY v.fold, t.topic),
    gm AS (SELECT v.fold, avg(t.label) AS mu FROM folds v JOIN folded t ON t.fold <> v.fold GROUP BY v.fold),
    pr AS (SELECT f.fold, f.topic, f.label, coalesce(tm.mu, gm.mu) AS pred FROM folded f
           LEFT JOIN tm ON tm.fold = f.fold AND tm.topic = f.topic JOIN gm ON gm.fold = f.fold)
    SELECT fold, topic, max(pred) AS train_mean, {METRICS_SQL} FROM pr GROUP BY fold, topic
    UNION ALL SELECT fold, 'ALL' AS topic, CAST(NULL AS DOUBLE) AS train_mean, {METRICS_SQL} FROM pr GROUP BY fold""",
    ["train_mean", *METRIC_COLS]))
def _topic_mean_cv(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(ML.topic_mean_cv(_folded_wide(spark, sf, False, KEYED)))


_FRAC_VALUES = ", ".join(f"({i}, CAST({f!r} AS DOUBLE))" for i, f in enumerate(S.FRACTIONS))
CURVE_SQL = POOL_SQL + f""", fr AS (SELECT * FROM (VALUES {_FRAC_VALUES}) t(frac_idx, fraction)),
    tr AS (SELECT p.outer_fold, fr.frac_idx, p.topic, p.label FROM pool_idx p JOIN fr ON p.frac_idx <= fr.frac_idx),
    tm AS (SELECT outer_fold, frac_idx, topic, avg(label) AS mu FROM tr GROUP BY ALL),
    gm AS (SELECT outer_fold, frac_idx, avg(label) AS mu FROM tr GROUP BY ALL),
    va AS (SELECT f.fold AS outer_fold, fr.frac_idx, fr.fraction, f.topic, f.label FROM folded f, fr),
    sc AS (SELECT va.*, CAST(least(6e0, greatest(0e0, round_even(coalesce(tm.mu, gm.mu), 0))) AS INTEGER) AS s
           FROM va LEFT JOIN tm USING (outer_fold, frac_idx, topic) LEFT JOIN gm USING (outer_fold, frac_idx)),
    curve AS (SELECT CAST(outer_fold + 1 AS INTEGER) AS outer_fold, fraction, topic,
           avg(CASE WHEN s = label THEN 1e0 ELSE 0e0 END) AS strict_acc,
           avg(CASE WHEN abs(s - label) <= 1 THEN 1e0 ELSE 0e0 END) AS flexible_acc
           FROM sc GROUP BY outer_fold, fraction, topic)
"""


@register("learning_curve_mean", "ML7 AG14 PR19", round_sql(CURVE_SQL + "SELECT *, CAST(CAST(trunc(fraction * 1e2) AS INTEGER) AS VARCHAR) || '%' AS fraction_label FROM curve",
                                                           ["fraction", "strict_acc", "flexible_acc"]))
def _learning_curve_mean(spark: SparkSession, sf: str) -> DataFrame:
    curve = ML.learning_curve_mean(_folded_wide(spark, sf, False, KEYED), ["example_id"])
    return round_doubles(curve.withColumn("fraction_label", TX.fraction_label(F.col("fraction"))))


@register("learning_curve_agg", "AG18 ST3 UD2", round_sql(CURVE_SQL + """SELECT fraction, topic,
    avg(strict_acc) AS strict_acc, avg(flexible_acc) AS flexible_acc,
    stddev_pop(strict_acc) / sqrt(count(strict_acc)) AS strict_sem,
    stddev_pop(flexible_acc) / sqrt(count(flexible_acc)) AS flexible_sem FROM curve GROUP BY fraction, topic""",
    ["fraction", "strict_acc", "flexible_acc", "strict_sem", "flexible_sem"]))
def _learning_curve_agg(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(ML.learning_curve_agg(ML.learning_curve_mean(_folded_wide(spark, sf, False, KEYED), ["example_id"])))


# ------------------------------------------------------- turns and dialogues

NL = "chr(10)"
WS_CLASS = "'[ \\t\\n\\r\\f\\x0B]+'"
CLEAN_SQL = "replace(replace(coalesce(text, ''), 'Vielen Dank', 'mhm'), 'Amen', 'mhm')"


def _merge_sql(view: str, global_order: bool) -> str:
    if global_order:
        w = "OVER (ORDER BY seq)"
        cont = f"coalesce(lag(subject) {w} = subject AND lag(speaker) {w} = speaker, false)"
        run = "sum(brk) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)"
        grp = "run_id"
    else:
        w = "OVER (PARTITION BY subject ORDER BY seq)"
        cont = f"coalesce(lag(speaker) {w} = speaker, false)"
        run = "sum(brk) OVER (PARTITION BY subject ORDER BY seq ROWS UNBOUNDED PRECEDING)"
        grp = "subject, run_id"
    return X.with_views(view) + f""", c AS (SELECT subject, speaker, {CLEAN_SQL} AS text, seq FROM {view}),
    l AS (SELECT *, CASE WHEN {cont} THEN 0 ELSE 1 END AS brk FROM c),
    r AS (SELECT *, {run} AS run_id FROM l),
    f AS (SELECT *, min(seq) OVER (PARTITION BY {grp}) AS fs FROM r)
    SELECT arg_min(subject, seq) AS subject, arg_min(speaker, seq) AS speaker,
           arg_min(text, seq) || coalesce(' ' || string_agg(CASE WHEN seq <> fs AND text <> '' THEN text END, ' '
                                                            ORDER BY seq), '') AS text,
           CAST(run_id AS BIGINT) AS run_id, min(seq) AS first_seq, count(*) AS n_turns
    FROM f GROUP BY {grp}"""


@register("merge_turns", "AG1 WI1 WI2 PR6 PR7 SC1 R1 R2", _merge_sql("turns", True))
def _merge_turns(spark: SparkSession, sf: str) -> DataFrame:
    return TU.merge_turns(X.turns(spark, sf), order="global")


@register("merge_turns_by_subject", "AG1 WI1 WI2", _merge_sql("conversation_turns", False))
def _merge_turns_by_subject(spark: SparkSession, sf: str) -> DataFrame:
    return TU.merge_turns(X.conversation_turns(spark, sf), order="subject")


def _strip_sql(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^' || {WS_CLASS}, ''), {WS_CLASS} || '$', '')"


DIALOGUE_SQL = X.with_views("scored_turns") + f""", d AS (
    SELECT subject, topic,
           string_agg(CASE WHEN speaker = 'SPEAKER_00' THEN 'Interviewer' ELSE 'Patient' END || ': '
                      || coalesce(text, ''), {NL} ORDER BY seq) AS body,
           arg_min(score, seq) FILTER (WHERE speaker = 'SPEAKER_01' AND score IS NOT NULL AND NOT isnan(score)) AS ps
    FROM scored_turns WHERE subject IS NOT NULL AND topic IS NOT NULL GROUP BY subject, topic),
ex AS (SELECT subject, topic,
       'Topic: ' || topic || ' ' || {NL} || {_strip_sql(f"'Dialogue:' || {NL} || body")} || {NL} || {NL} AS input,
       'Score: ' || CAST(ps AS VARCHAR) AS output FROM d WHERE ps IS NOT NULL)
"""


@register("dialogue_examples", "AG2 AG4 PR8 PR9 PR10 PR11 FI6 FI7", DIALOGUE_SQL + "SELECT * FROM ex")
def _dialogue_examples(spark: SparkSession, sf: str) -> DataFrame:
    return DG.build_examples(X.scored_turns(spark, sf))


@register("parse_examples", "PR12 PR13 UD1", DIALOGUE_SQL + f"""SELECT subject, topic,
    CAST(trunc(CAST({_strip_sql("split_part(output, ':', 2)")} AS DOUBLE)) AS INTEGER) AS label,
    CASE WHEN contains(input, 'Topic:') THEN {_strip_sql(f"replace(split_part(input, {NL}, 1), 'Topic:', '')")}
         ELSE 'Unknown' END AS parsed_topic FROM ex""")
def _parse_examples(spark: SparkSession, sf: str) -> DataFrame:
    return DG.parse_examples(DG.build_examples(X.scored_turns(spark, sf))) \
        .select("subject", "topic", "label", "parsed_topic")


@register("first_score_any", "AG3 PR14 FI6", X.with_views("scored_turns") + """SELECT topic, subject,
    CAST(trunc(arg_min(score, seq)) AS INTEGER) AS score FROM scored_turns
    WHERE score IS NOT NULL AND NOT isnan(score) AND subject IS NOT NULL AND topic IS NOT NULL GROUP BY topic, subject""")
def _first_score_any(spark: SparkSession, sf: str) -> DataFrame:
    return DG.first_score(X.scored_turns(spark, sf))


@register("first_score_patient", "AG4 FI6", X.with_views("scored_turns") + """SELECT subject, topic,
    CAST(trunc(arg_min(score, seq)) AS INTEGER) AS score FROM scored_turns
    WHERE score IS NOT NULL AND NOT isnan(score) AND speaker = 'SPEAKER_01'
      AND subject IS NOT NULL AND topic IS NOT NULL GROUP BY subject, topic""")
def _first_score_patient(spark: SparkSession, sf: str) -> DataFrame:
    return DG.first_score(X.scored_turns(spark, sf), ["subject", "topic"], speaker=S.PATIENT_SPEAKER)


TOPIC_DIM_SQL = "(VALUES " + ", ".join(
    f"({i}, '{t}', '{label}')" for i, (t, label) in enumerate(S.TOPICS, start=1)) + ") AS td(rank, topic, label_en)"


@register("histogram_real_synthetic", "AG5 PR15 PR16 JO2 JO7 FI5 SE4 SO2", X.with_views("scored_turns") + f""",
    fs AS (SELECT topic, subject, CAST(trunc(arg_min(score, seq)) AS INTEGER) AS score FROM scored_turns
           WHERE score IS NOT NULL AND NOT isnan(score) AND subject IS NOT NULL AND topic IS NOT NULL GROUP BY topic, subject),
    sp AS (SELECT td.*, CAST(s.range AS INTEGER) AS score FROM {TOPIC_DIM_SQL} CROSS JOIN range(0, 7) s),
    ct AS (SELECT topic, score, CAST(sum(CASE WHEN subject LIKE '%\\_Syn' ESCAPE '\\' THEN 0 ELSE 1 END) AS BIGINT) AS real,
                  CAST(sum(CASE WHEN subject LIKE '%\\_Syn' ESCAPE '\\' THEN 1 ELSE 0 END) AS BIGINT) AS synthetic
           FROM fs GROUP BY topic, score)
    SELECT CAST(sp.rank AS INTEGER) AS rank, sp.topic, sp.label_en, sp.score,
           coalesce(ct.real, 0) AS real, coalesce(ct.synthetic, 0) AS synthetic,
           coalesce(ct.real, 0) + coalesce(ct.synthetic, 0) AS total
    FROM sp LEFT JOIN ct USING (topic, score)""")
def _histogram_real_synthetic(spark: SparkSession, sf: str) -> DataFrame:
    return SC.histogram_real_synthetic(DG.first_score(X.scored_turns(spark, sf)), S.topic_dim(spark))


@register("histogram_topic", "AG6 JO7", X.with_views("scored_turns") + """,
    fs AS (SELECT subject, topic, CAST(trunc(arg_min(score, seq)) AS INTEGER) AS score FROM scored_turns
           WHERE score IS NOT NULL AND NOT isnan(score) AND speaker = 'SPEAKER_01'
             AND subject IS NOT NULL AND topic IS NOT NULL GROUP BY subject, topic),
    ct AS (SELECT topic, score, count(*) AS cnt FROM fs GROUP BY topic, score),
    sp AS (SELECT t.topic, CAST(s.range AS INTEGER) AS score FROM (SELECT DISTINCT topic FROM ct) t CROSS JOIN range(0, 7) s)
    SELECT sp.topic, sp.score, coalesce(ct.cnt, 0) AS count FROM sp LEFT JOIN ct USING (topic, score)""")
def _histogram_topic(spark: SparkSession, sf: str) -> DataFrame:
    fs = DG.first_score(X.scored_turns(spark, sf), ["subject", "topic"], speaker=S.PATIENT_SPEAKER)
    return SC.histogram_topic(fs)


# ------------------------------------------------- confusion and comparisons

TOPIC_LIST_SQL = "(" + ", ".join(f"'{t}'" for t, _ in S.TOPICS) + ")"
CONFUSION_SQL = X.with_views("predictions") + f""", r AS (
    SELECT model, topic, label, CAST(least(6e0, greatest(0e0, round_even(pred, 0))) AS INTEGER) AS s
    FROM predictions WHERE topic IN {TOPIC_LIST_SQL}),
x AS (SELECT model, topic, 'strict' AS rule, label AS true_score, s AS pred_score FROM r
      UNION ALL SELECT model, topic, 'flexible' AS rule, label AS true_score,
                       CASE WHEN abs(s - label) <= 1 THEN label ELSE s END AS pred_score FROM r),
ct AS (SELECT model, topic, rule, true_score, pred_score, count(*) AS n FROM x
       WHERE true_score BETWEEN 0 AND 6 AND pred_score BETWEEN 0 AND 6 GROUP BY ALL),
sp AS (SELECT m.model, m.topic, ru.rule, CAST(a.range AS INTEGER) AS true_score, CAST(b.range AS INTEGER) AS pred_score
       FROM (SELECT DISTINCT model, topic FROM ct) m CROSS JOIN (VALUES ('strict'), ('flexible')) ru(rule)
       CROSS JOIN range(7) a CROSS JOIN range(7) b),
dense AS (SELECT sp.*, coalesce(ct.n, 0) AS n FROM sp LEFT JOIN ct USING (model, topic, rule, true_score, pred_score)),
tr AS (SELECT model, topic, rule, CAST(sum(CASE WHEN true_score = pred_score THEN n ELSE 0 END) AS BIGINT) AS correct,
              CAST(sum(n) AS BIGINT) AS total FROM dense GROUP BY model, topic, rule)
"""


def _dense_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return CF.confusion(X.predictions(spark, sf), S.topic_dim(spark))


@register("confusion_matrices", "AG12 AG13 PR18 JO7 FI5 SE3", CONFUSION_SQL + "SELECT * FROM dense")
def _confusion_matrices(spark: SparkSession, sf: str) -> DataFrame:
    return _dense_confusion(spark, sf)


@register("confusion_trace", "AG15", CONFUSION_SQL + "SELECT *, total - correct AS errors FROM tr")
def _confusion_trace(spark: SparkSession, sf: str) -> DataFrame:
    return CF.trace(_dense_confusion(spark, sf))


@register("tolerant_predictions", "PR17 PR18", X.with_views("predictions") + """, r AS (
    SELECT example_id, model, label, CAST(least(6e0, greatest(0e0, round_even(pred, 0))) AS INTEGER) AS strict
    FROM predictions)
    SELECT example_id, model, label, strict, CASE WHEN abs(strict - label) <= 1 THEN label ELSE strict END AS flexible
    FROM r""")
def _tolerant_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return CF.with_rules(X.predictions(spark, sf)).select("example_id", "model", "label", "strict", "flexible")


def _spec_sql(spec) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{n}', '{ma}', '{ra}', '{mb}', '{rb}')" for i, (n, ma, ra, mb, rb) in enumerate(
        spec, start=1)) + ") AS spec(cmp_rank, comparison, model_a, rule_a, model_b, rule_b)"


def _mcnemar_sql(b: str, c: str) -> str:
    n, k = f"({b} + {c})", f"least({b}, {c})"
    return (f"CASE WHEN {b} IS NULL OR {c} IS NULL THEN NULL WHEN abs({b} - {c}) <= 1 THEN 1e0 ELSE "
            f"(SELECT least(1e0, 2e0 * sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2e0))))"
            f" FROM generate_series(greatest(0, {k} - CAST(40 * sqrt({n}) AS BIGINT) - 100), {k}) t(i)) END")


def _marginal_sql(confusion: str, spec) -> str:
    return confusion + f""", cells AS (
    SELECT spec.cmp_rank, spec.comparison, a.topic, spec.model_a, spec.rule_a, spec.model_b, spec.rule_b, a.correct AS ca,
           b.correct AS cb, a.total AS total, b.correct IS NULL AS missing_in_b,
           CASE WHEN b.correct IS NOT NULL THEN least(a.correct, b.correct) END AS n11,
           CASE WHEN b.correct IS NOT NULL THEN a.correct - least(a.correct, b.correct) END AS n10,
           CASE WHEN b.correct IS NOT NULL THEN b.correct - least(a.correct, b.correct) END AS n01,
           CASE WHEN b.correct IS NOT NULL THEN a.total - a.correct - b.correct + least(a.correct, b.correct) END AS n00
    FROM {_spec_sql(spec)} JOIN tr a ON a.model = spec.model_a AND a.rule = spec.rule_a
    LEFT JOIN tr b ON b.model = spec.model_b AND b.rule = spec.rule_b AND b.topic = a.topic),
    td AS (SELECT * FROM {TOPIC_DIM_SQL})
"""


def _test_cols_sql(src: str) -> str:
    return f"""tests AS (SELECT c.*, CAST(td.rank AS INTEGER) AS rank, td.label_en, {_mcnemar_sql('c.n10', 'c.n01')} AS p_value
                FROM {src} c JOIN td USING (topic)),
    adj AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1e0, p_value * count(p_value) OVER (PARTITION BY comparison))
                END AS p_adj FROM tests)"""


_P_DISPLAY_SQL = "CASE WHEN p_adj < 1e-4 THEN 'P < 0.0001' WHEN p_adj IS NOT NULL THEN printf('P = %.4f', p_adj) END"


def _comparisons_sql(confusion: str, spec) -> str:
    return round_sql(_marginal_sql(confusion, spec) + "," + _test_cols_sql("cells") + f"""
    SELECT *, {_P_DISPLAY_SQL} AS p_display,
           CAST(sum(CASE WHEN NOT missing_in_b THEN total - ca END) OVER (PARTITION BY comparison ORDER BY rank
                ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_errors_a,
           CAST(sum(total - cb) OVER (PARTITION BY comparison ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT)
             AS cum_errors_b
    FROM adj""", ["p_value", "p_adj"])


def _reduction_sql(confusion: str, spec) -> str:
    return round_sql(_marginal_sql(confusion, spec) + """, e AS (SELECT cmp_rank, comparison,
    CAST(coalesce(sum(total - ca) FILTER (WHERE NOT missing_in_b), 0) AS BIGINT) AS errors_a,
    CAST(coalesce(sum(total - cb), 0) AS BIGINT) AS errors_b,
    CAST(coalesce(sum(total) FILTER (WHERE NOT missing_in_b), 0) AS BIGINT) AS total_samples,
    count(*) FILTER (WHERE missing_in_b) AS missing_topics
    FROM cells JOIN td USING (topic) GROUP BY cmp_rank, comparison)
    SELECT *, CASE WHEN errors_a > 0 THEN CAST(errors_a - errors_b AS DOUBLE) / errors_a * 1e2 ELSE 0e0 END
      AS error_reduction_pct FROM e""", ["error_reduction_pct"])


#: Topics that model "tuned" (and one that "base") has no predictions for in the queries on missing topics.
MISSING = {"tuned": ["Schlaf", "Suizid"], "base": ["Appetit"]}
_MISSING_SQL = CONFUSION_SQL.replace("tr AS (SELECT model", "tr_all AS (SELECT model") + ", tr AS (SELECT * FROM tr_all WHERE NOT (" + \
    " OR ".join(f"model = '{m}' AND topic IN (" + ", ".join(f"'{t}'" for t in ts) + ")" for m, ts in MISSING.items()) + "))"
#: Counts times 400, far beyond what the terms of a binomial can be summed for one by one.
_SCALED_SQL = CONFUSION_SQL.replace("tr AS (SELECT model", "tr_one AS (SELECT model") + \
    ", tr AS (SELECT model, topic, rule, correct * 400 AS correct, total * 400 AS total FROM tr_one)"


def _trace(spark: SparkSession, sf: str) -> DataFrame:
    return CF.trace(_dense_confusion(spark, sf))


def _trace_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    p = X.predictions(spark, sf)
    for m, ts in MISSING.items():
        p = p.where(~((F.col("model") == m) & F.col("topic").isin(ts)))
    return CF.trace(CF.confusion(p, S.topic_dim(spark)))


@register("model_comparisons", "ST1 ST2 ST4 AG16 JO3 WI6 PR21", _comparisons_sql(CONFUSION_SQL, S.COMPARISONS))
def _model_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(CP.marginal_comparisons(_trace(spark, sf), S.topic_dim(spark)))


@register("model_comparisons_corrected", "ST4", _comparisons_sql(CONFUSION_SQL, S.COMPARISONS_CORRECTED))
def _model_comparisons_corrected(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(CP.marginal_comparisons(_trace(spark, sf), S.topic_dim(spark), S.COMPARISONS_CORRECTED))


@register("model_comparisons_missing_topics", "JO3 AG16 ST2", _comparisons_sql(_MISSING_SQL, S.COMPARISONS))
def _model_comparisons_missing_topics(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(CP.marginal_comparisons(_trace_with_gaps(spark, sf), S.topic_dim(spark)))


@register("model_comparisons_large_counts", "ST1", _comparisons_sql(_SCALED_SQL, S.COMPARISONS))
def _model_comparisons_large_counts(spark: SparkSession, sf: str) -> DataFrame:
    tr = _trace(spark, sf).withColumn("correct", F.col("correct") * 400).withColumn("total", F.col("total") * 400)
    return round_doubles(CP.marginal_comparisons(tr, S.topic_dim(spark)))


@register("error_reduction", "AG17", _reduction_sql(CONFUSION_SQL, S.COMPARISONS))
def _error_reduction(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(CP.error_reduction(_trace(spark, sf), S.topic_dim(spark)))


@register("error_reduction_missing_topics", "AG17 JO3", _reduction_sql(_MISSING_SQL, S.COMPARISONS))
def _error_reduction_missing_topics(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(CP.error_reduction(_trace_with_gaps(spark, sf), S.topic_dim(spark)))


#: Every 11th example has no prediction of "tuned", every 13th none of "base".
@register("paired_comparisons", "ST5 JO4 ST1 ST2", round_sql(X.with_views("predictions") + f""",
    r AS (SELECT example_id, model, topic, label, CAST(least(6e0, greatest(0e0, round_even(pred, 0))) AS INTEGER) AS s
          FROM predictions WHERE topic IN {TOPIC_LIST_SQL} AND NOT (model = 'tuned' AND example_id % 11 = 0)
           AND NOT (model = 'base' AND example_id % 13 = 0)),
    o AS (SELECT spec.*, e.topic,
                 CASE WHEN spec.rule_a = 'strict' THEN a.s = a.label ELSE abs(a.s - a.label) <= 1 END AS oka,
                 CASE WHEN spec.rule_b = 'strict' THEN b.s = b.label ELSE abs(b.s - b.label) <= 1 END AS okb
          FROM (SELECT DISTINCT example_id, topic FROM r) e CROSS JOIN {_spec_sql(S.COMPARISONS_CORRECTED)}
          LEFT JOIN r a ON a.example_id = e.example_id AND a.model = spec.model_a
          LEFT JOIN r b ON b.example_id = e.example_id AND b.model = spec.model_b),
    cells AS (SELECT cmp_rank, comparison, topic, model_a, rule_a, model_b, rule_b,
                 count(*) FILTER (WHERE oka AND okb) AS n11, count(*) FILTER (WHERE oka AND NOT okb) AS n10,
                 count(*) FILTER (WHERE NOT oka AND okb) AS n01, count(*) FILTER (WHERE NOT oka AND NOT okb) AS n00,
                 count(*) FILTER (WHERE oka IS NULL OR okb IS NULL) AS n_unpaired
          FROM o WHERE oka IS NOT NULL OR okb IS NOT NULL GROUP BY ALL),
    td AS (SELECT * FROM {TOPIC_DIM_SQL}),
    {_test_cols_sql("cells")}
    SELECT *, {_P_DISPLAY_SQL} AS p_display FROM adj""", ["p_value", "p_adj"]))
def _paired_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    p = X.predictions(spark, sf)
    p = p.where(~((F.col("model") == "tuned") & (F.col("example_id") % 11 == 0)) & ~((F.col("model") == "base") & (F.col("example_id") % 13 == 0)))
    return round_doubles(CP.paired_comparisons(p, S.COMPARISONS_CORRECTED, S.topic_dim(spark)))


# ------------------------------------------------------------------ similarity

COS_SQL = X.with_views("text_pairs") + """, u AS (SELECT id, score, synthetic, CAST(emb AS DOUBLE[]) AS e FROM text_pairs),
p AS (SELECT r.id AS rid, s.id AS sid, r.score AS rscore, s.score AS sscore,
             CASE WHEN list_dot_product(r.e, r.e) > 0 AND list_dot_product(s.e, s.e) > 0
                  THEN list_dot_product(r.e, s.e) / (sqrt(list_dot_product(r.e, r.e)) * sqrt(list_dot_product(s.e, s.e)))
                  ELSE 0e0 END AS cos
      FROM u r JOIN u s ON NOT r.synthetic AND s.synthetic)
"""


@register("cosine_mean", "SI1 JO5", round_sql(COS_SQL + """SELECT count(DISTINCT rid) AS n_real,
    count(DISTINCT sid) AS n_synthetic, avg(cos) AS mean_cosine FROM p""", ["mean_cosine"]))
def _cosine_mean(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(SI.cosine_mean(X.text_pairs(spark, sf)))


@register("cosine_by_score", "SI2 JO6 FI9 SO3 AG19", round_sql(COS_SQL + """SELECT rscore AS score,
    count(DISTINCT rid) AS n_real, count(DISTINCT sid) AS n_synthetic, avg(cos) AS mean_cosine
    FROM p WHERE rscore = sscore GROUP BY rscore""", ["mean_cosine"]))
def _cosine_by_score(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(SI.cosine_mean(X.text_pairs(spark, sf), by=["score"]))


@register("cosine_extremes", "SI3 SO4", round_sql(COS_SQL + """SELECT max(cos) AS max_cosine,
    arg_max(rid, cos) AS max_real_id, arg_max(sid, cos) AS max_synthetic_id,
    min(cos) AS min_cosine, arg_min(rid, cos) AS min_real_id, arg_min(sid, cos) AS min_synthetic_id,
    count(*) AS n_pairs FROM p""", ["max_cosine", "min_cosine"]))
def _cosine_extremes(spark: SparkSession, sf: str) -> DataFrame:
    e = SI.cosine_extremes(X.text_pairs(spark, sf))
    return round_doubles(e.select(
        "max_cosine", F.col("max_pair.real_id").alias("max_real_id"),
        F.col("max_pair.synthetic_id").alias("max_synthetic_id"), "min_cosine",
        F.col("min_pair.real_id").alias("min_real_id"), F.col("min_pair.synthetic_id").alias("min_synthetic_id"),
        "n_pairs"))


@register("near_pairs", "SI4", round_sql(COS_SQL + """SELECT rid AS real_id, sid AS synthetic_id, cos AS cosine
    FROM p WHERE cos >= 0.4e0""", ["cosine"]))
def _near_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(SI.near_pairs(X.text_pairs(spark, sf), threshold=0.4))


@register("cosine_extremes_work", "SI3 SO4")
def _cosine_extremes_work(spark: SparkSession, sf: str) -> DataFrame:
    """The work of the tree search: vector pairs multiplied, of all, on vectors in clusters."""
    e = SI.cosine_extremes(X.clustered_vectors(spark, sf), block_rows=64)
    return round_doubles(e.select("max_cosine", "min_cosine", "pairs_examined", "n_pairs", (F.col("pairs_examined") / F.col("n_pairs")).alias("share")))


@register("near_pairs_hashed", "SI4", """WITH e AS (SELECT vec_id AS id, embedding AS v FROM embeddings),
    u AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
    b AS (SELECT id, i, CAST(x AS DOUBLE) AS x, 0.85e0 * x + 0.35e0 * v[(i % len(v)) + 1] AS y FROM u JOIN e USING (id)),
    n AS (SELECT id, sqrt(sum(x * x)) AS nx, sqrt(sum(y * y)) AS ny FROM b GROUP BY id),
    p AS (SELECT r.id AS rid, s.id AS sid, sum(r.x * s.y) AS d FROM b AS r JOIN b AS s USING (i) GROUP BY r.id, s.id),
    c AS (SELECT count(*) AS n FROM p JOIN n AS a ON a.id = rid JOIN n AS z ON z.id = sid WHERE d / (a.nx * z.ny) >= 0.9e0)
    SELECT n AS n_near, CAST(0 AS BIGINT) AS n_wrong, true AS recall_reached FROM c""")
def _near_pairs_hashed(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs found by hashing against the exact ones: nine tenths at least, and none besides."""
    d = X.near_copies(spark, sf)
    exact = SI.near_pairs(d, threshold=0.9).select("real_id", "synthetic_id", F.lit(1).alias("e"))
    found = SI.near_pairs_hashed(d, threshold=0.9).select("real_id", "synthetic_id", F.lit(1).alias("f"))
    both = exact.join(found, ["real_id", "synthetic_id"], "full")
    n = lambda c: F.count(F.when(c, F.lit(1)))
    return both.agg(n(F.col("e").isNotNull()).alias("n_near"), n(F.col("e").isNull()).alias("n_wrong"),
                    (n(F.col("e").isNotNull() & F.col("f").isNotNull()) >= 0.9 * n(F.col("e").isNotNull())).alias("recall_reached"))


@register("text_cosine_by_score", "SI5 SI2", round_sql(X.with_views("regression_docs") + """,
    d AS (SELECT example_id AS id, label AS score, example_id % 2 = 1 AS synthetic, text FROM regression_docs),
    t AS (SELECT id, score, synthetic, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM d),
    tf AS (SELECT id, score, synthetic, term, count(*) AS c FROM t WHERE term <> '' GROUP BY ALL),
    w AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM tf),
    pt AS (SELECT score, term, sum(CASE WHEN NOT synthetic THEN w END) AS sr, sum(CASE WHEN synthetic THEN w END) AS ss
           FROM w GROUP BY score, term),
    dt AS (SELECT score, sum(coalesce(sr, 0) * coalesce(ss, 0)) AS dot FROM pt GROUP BY score),
    ct AS (SELECT score, count(*) FILTER (WHERE NOT synthetic) AS n_real, count(*) FILTER (WHERE synthetic) AS n_synthetic
           FROM d GROUP BY score)
    SELECT ct.score, n_real, n_synthetic, coalesce(dot, 0) / (n_real * n_synthetic) AS mean_cosine
    FROM ct LEFT JOIN dt USING (score) WHERE n_real > 0 AND n_synthetic > 0""", ["mean_cosine"]))
def _text_cosine_by_score(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.regression_docs(spark, sf).select(
        "example_id", "text", F.col("label").alias("score"), (F.col("example_id") % 2 == 1).alias("synthetic"))
    w = SI.term_weights(docs, "example_id", "text", keep=["score", "synthetic"])
    return round_doubles(SI.cosine_mean_terms(docs, w, by=["score"]))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_LETTER_SQL = X.with_views("regression_docs") + """, e AS (SELECT example_id AS id, label AS score, example_id % 2 = 1 AS synthetic, [""" + \
    ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in _LETTERS) + """] AS v FROM (
        SELECT example_id, label, lower(coalesce(text, '')) AS text FROM regression_docs) AS d),
    u AS (SELECT *, sqrt(list_sum([x * x FOR x IN v])) AS n FROM e),
    p AS (SELECT r.score AS rscore, s.score AS sscore, r.id AS rid, s.id AS sid,
                 CASE WHEN r.n > 0 AND s.n > 0 THEN list_dot_product(r.v, s.v) / (r.n * s.n) ELSE 0e0 END AS cos
          FROM u r JOIN u s ON NOT r.synthetic AND s.synthetic),
    g AS (SELECT rscore AS score, avg(cos) AS mean_cosine, count(*) AS n_pairs FROM p WHERE rscore = sscore GROUP BY rscore
          UNION ALL SELECT NULL, avg(cos), count(*) FROM p)
    SELECT *, (SELECT max(cos) FROM p) AS max_cosine, (SELECT min(cos) FROM p) AS min_cosine FROM g"""


@register("encoded_similarity", "SI5 SI2 SI3 ML5", round_sql(_LETTER_SQL, ["mean_cosine", "max_cosine", "min_cosine"]))
def _encoded_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Means and extremes over the vectors of a user's encoder (letter counts), written once."""
    from turnscore.session import materialize
    letters = _LETTERS

    def load():
        import numpy as np
        return np.frombuffer(letters.encode(), np.uint8)

    def encode(alphabet, texts):
        import numpy as np
        return np.array([np.bincount(np.frombuffer(t.lower().encode(), np.uint8), minlength=256)[alphabet] for t in texts])
    docs = X.regression_docs(spark, sf).select("example_id", "text", F.col("label").alias("score"), (F.col("example_id") % 2 == 1).alias("synthetic"))
    v = materialize(SI.encode_texts(docs.withColumnRenamed("example_id", "id"), "text", load, encode, ["id", "score", "synthetic"]), "vectors")
    ext = SI.cosine_extremes(v).first()  # one row
    means = SI.cosine_mean(v, by=["score"]).unionByName(SI.cosine_mean(v).withColumn("score", F.lit(None).cast("int")))
    return round_doubles(means.select("score", "mean_cosine", (F.col("n_real") * F.col("n_synthetic")).alias("n_pairs"),
                                      F.lit(ext.max_cosine).alias("max_cosine"), F.lit(ext.min_cosine).alias("min_cosine")))


# ------------------------------------------- manifest, ledger, keys, segments


def _manifest_keyed(spark: SparkSession, sf: str) -> DataFrame:
    m = X.manifest(spark, sf)
    return m.withColumn("file_name", TX.base_name(F.col("path"))) \
        .withColumn("subject", TX.subject_key(F.col("file_name")))


@register("ledger_pending", "JO1 FI2 FI1 SC8", X.with_views("manifest", "ledger") + """SELECT path,
    split_part(regexp_extract(path, '[^/]+$'), '_', 1) || '_' || split_part(regexp_extract(path, '[^/]+$'), '_', 2)
      AS subject FROM manifest
    WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.subject = split_part(regexp_extract(path, '[^/]+$'), '_', 1)
                      || '_' || split_part(regexp_extract(path, '[^/]+$'), '_', 2))
      AND starts_with(split_part(path, '/', 2), 'MC_1') AND ends_with(path, '_MADRS.mp4')""")
def _ledger_pending(spark: SparkSession, sf: str) -> DataFrame:
    m = _manifest_keyed(spark, sf)
    parent = F.element_at(F.split(F.col("path"), "/"), -2)
    m = m.where(parent.startswith("MC_1") & F.col("path").endswith("_MADRS.mp4"))
    return IN.pending(m, X.ledger(spark, sf)).select("path", "subject")


@register("subject_keys", "PR1 PR2 PR3", X.with_views("manifest") + """, n AS (
    SELECT path, regexp_extract(path, '[^/]+$') AS file_name FROM manifest)
    SELECT path, split_part(file_name, '_', 1) || '_' || split_part(file_name, '_', 2) AS subject,
           split_part(file_name, '_', 1) || '_' || split_part(file_name, '_', 2) || '_MADRS.wav' AS audio_name,
           'f_' || replace(file_name, '.mp4', '.wav') AS filtered_name,
           array_to_string(string_split('f_' || replace(file_name, '.mp4', '.wav'), '_')[2:4], '_') AS subject_variant
    FROM n""")
def _subject_keys(spark: SparkSession, sf: str) -> DataFrame:
    m = _manifest_keyed(spark, sf)
    filtered = TX.filtered_audio_name(F.col("file_name"))
    return m.select("path", "subject", TX.audio_name(F.col("subject")).alias("audio_name"),
                    filtered.alias("filtered_name"), TX.subject_key_parts(filtered).alias("subject_variant"))


@register("segment_keys", "PR4 PR5", X.with_views("segments") + """, m AS (
    SELECT id, subject, speaker, CAST(trunc(start_s * 1000e0) AS BIGINT) AS start_ms,
           CAST(trunc(end_s * 1000e0) AS BIGINT) AS end_ms FROM segments)
    SELECT id, start_ms, end_ms, subject || '_' || speaker || '_' || CAST(start_ms AS VARCHAR) || '_'
           || CAST(end_ms AS VARCHAR) || '.wav' AS segment_key FROM m""")
def _segment_keys(spark: SparkSession, sf: str) -> DataFrame:
    return TU.segments_ms(X.segments(spark, sf)).select("id", "start_ms", "end_ms", "segment_key")


@register("segment_align", "JO8", X.with_views("segments") + """, s AS (
    SELECT id, subject, CAST(trunc(start_s * 1000e0) AS BIGINT) AS a, CAST(trunc(end_s * 1000e0) AS BIGINT) AS b
    FROM segments),
    t AS (SELECT id, subject, CAST(trunc((start_s + 0.5e0) * 1000e0) AS BIGINT) AS a,
                 CAST(trunc((end_s + 0.5e0) * 1000e0) AS BIGINT) AS b FROM segments)
    SELECT t.id AS turn_id, s.id AS segment_id, least(t.b, s.b) - greatest(t.a, s.a) AS overlap_ms
    FROM t JOIN s ON t.subject = s.subject AND greatest(t.a, s.a) < least(t.b, s.b)""")
def _segment_align(spark: SparkSession, sf: str) -> DataFrame:
    seg = X.segments(spark, sf)
    s = TU.segments_ms(seg).select("id", "subject", "start_ms", "end_ms")
    t = seg.select("id", "subject", TX.seconds_to_ms(F.col("start_s") + F.lit(0.5)).alias("start_ms"),
                   TX.seconds_to_ms(F.col("end_s") + F.lit(0.5)).alias("end_ms"))
    j = TU.align_segments(t, s)
    return j.select(F.col("t_id").alias("turn_id"), F.col("s_id").alias("segment_id"), "overlap_ms")


def _two_batches(spark: SparkSession, first: DataFrame, second: DataFrame, start) -> None:
    """Two runs of one query on a growing folder: the first files, then the second ones."""
    path = shared_path(spark, "arrivals")
    for part in (first, second):
        part.write.mode("append").parquet(path)
        start(spark.readStream.schema(part.schema).parquet(path)).awaitTermination()


@register("ingest_ledger", "SS1 SK8 SC8 FI2", X.with_views("manifest", "ledger") + """, m AS (SELECT doc_id, path,
    split_part(regexp_extract(path, '[^/]+$'), '_', 1) || '_' || split_part(regexp_extract(path, '[^/]+$'), '_', 2)
    AS subject FROM manifest)
    SELECT path, subject, CAST(doc_id % 2 AS INTEGER) AS batch_id FROM m
    WHERE subject NOT IN (SELECT subject FROM ledger)""")
def _ingest_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings of even documents arrive first, then those of all documents; the ledger already
    has the fixture's subjects from a batch registration. Returns what the sink got, and when."""
    base = shared_path(spark, "ingest")
    WR.append_rows(X.ledger(spark, sf).withColumn("processed_at", F.current_timestamp()), f"{base}/ledger")
    rows = X.manifest(spark, sf).withColumn("subject", TX.subject_key(F.col("path")))
    _two_batches(spark, rows.where("doc_id % 2 = 0").select("path", "subject"), rows.select("path", "subject"),
                 lambda s: IN.ingest_stream(s, f"{base}/ledger", f"{base}/data", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/data").select("path", "subject", F.col("batch_id").cast("int").alias("batch_id"))


@register("merged_turns_stream", "SS2 SK7 AG1")
def _merged_turns_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations arrive in two batches; after each the touched subjects are merged anew."""
    base = shared_path(spark, "turn-store")
    turns = X.conversation_turns(spark, sf)
    _two_batches(spark, turns.where("seq < 3"), turns.where("seq >= 3"),
                 lambda s: IN.merge_stream(s, f"{base}/turns", f"{base}/merged", f"{base}/checkpoint", bucket_count=16))
    return spark.read.parquet(f"{base}/merged").drop("sbucket")


# ------------------------------------------------------ models and reports


def _folded_docs(spark: SparkSession, sf: str) -> DataFrame:
    return SA.kfold(X.regression_docs(spark, sf), ["example_id"])


@register("text_regression_cv", "ML2 ML8")
def _text_regression_cv(spark: SparkSession, sf: str) -> DataFrame:
    preds = ML.text_regression_cv(_folded_docs(spark, sf))
    return round_doubles(M.evaluate_folds(preds, ["model"]))


@register("learning_curve_text", "ML7 AG14")
def _learning_curve_text(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(CU.learning_curve_text(_folded_docs(spark, sf), ["example_id"]))


@register("absolute_regression_topics", "ML4 ML3 ML8", round_sql(FOLDED_SQL + """, folds AS (SELECT DISTINCT fold FROM folded),
    md AS (SELECT v.fold, t.topic, quantile_cont(t.label, 0.5) AS mid FROM folds v JOIN folded t ON t.fold <> v.fold GROUP BY v.fold, t.topic)
    SELECT f.fold, f.topic, max(mid) AS train_median, count(*) AS n, avg(abs(mid - f.label)) AS mae
    FROM folded f JOIN md ON md.fold = f.fold AND md.topic = f.topic GROUP BY f.fold, f.topic""", ["train_median", "mae"]))
def _absolute_regression_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The absolute-error regression on topic indicators finds every topic's median over the other folds."""
    topics = [S.GENERAL_TOPIC, *[t for t, _ in S.TOPICS]]
    feats = AB.indicator_features(_folded_wide(spark, sf, False, KEYED), "example_id", "label", "topic", topics)
    table = AB.fit_epochs(feats, S.N_FOLDS, len(topics), shared_path(spark, "epochs"), reg=1e-9, epochs=40, settled=True)
    p = AB.predictions(feats, AB.chosen_epochs(table, best=False), "absolute", "example_id").withColumn("pred", F.round("pred", 3))
    return round_doubles(p.groupBy("fold", "topic").agg(F.max("pred").alias("train_median"), F.count("*").alias("n"),
                                                        F.avg(F.abs(F.col("pred") - F.col("label"))).alias("mae")))


@register("text_absolute_cv", "ML4 ML3 SK9")
def _text_absolute_cv(spark: SparkSession, sf: str) -> DataFrame:
    preds = AB.text_absolute_cv(_folded_docs(spark, sf), num_features=64, epochs=20)
    return round_doubles(M.evaluate_folds(preds, ["model"]))


@register("gbt_regression_cv", "ML3 ML4")
def _gbt_regression_cv(spark: SparkSession, sf: str) -> DataFrame:
    preds = ML.gbt_regression_cv(_folded_docs(spark, sf))
    return round_doubles(M.evaluate_folds(preds, ["model"]))


@register("batch_map_tokens", "ML5 UD1", """SELECT doc_id,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+')) AS BIGINT) AS n_tokens,
    CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM documents""")
def _batch_map_tokens(spark: SparkSession, sf: str) -> DataFrame:
    # load / predict are defined here so they are shipped by value: the Python
    # workers need no import of this package
    def load():
        import pyarrow.compute as pc
        return lambda texts: (pc.count_substring_regex(texts, r"[\p{L}\p{N}]+"), pc.utf8_length(texts))

    def predict(model, batch):
        import pandas as pd
        import pyarrow as pa
        tokens, chars = model(pa.array(batch["text"].fillna(""), pa.string()))
        return pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": tokens.to_numpy().astype("int64"),
                             "n_chars": chars.to_numpy().astype("int64")})
    docs = X.table(spark, sf, "documents").select("doc_id", "text")
    return ML.batch_map(docs, load, predict, "doc_id LONG, n_tokens LONG, n_chars LONG")


def _report_sql() -> str:
    """The comparison reports' lines; p-values are rounded to 6 decimals before they are printed."""
    w = {k: str(v).replace("'", "''") for k, v in S.REPORT.items()}
    cells = ["n11", "n10", "n01", "n00"]
    wide = "CAST(greatest(" + ", ".join(f"length(CAST({c} AS VARCHAR))" for c in cells) + ") AS INTEGER)"
    pad = [f"lpad(CAST({c} AS VARCHAR), {wide}, ' ')" for c in cells]
    body = [f"'{w['topic']}' || label_en", f"'{w['table']}'", f"'[[' || {pad[0]} || ' ' || {pad[1]} || ']'", f"' [' || {pad[2]} || ' ' || {pad[3]} || ']]'",
            f"printf('{w['p']}', p_value)", f"printf('{w['p_adj']}', p_adj)", "''"]
    tail = [f"'{w['errors']}' || comparison || ':'", f"'{w['errors_a']}' || errors_a", f"'{w['errors_b']}' || errors_b",
            f"printf('{w['reduction']}', error_reduction_pct)", f"'{w['samples']}' || total_samples", "''"]
    head = [f"'{w['head']}' || comparison", f"repeat('=', length(comparison) + {w['rule_extra']})", "''"]
    out = [f"SELECT comparison, CAST({i} AS BIGINT) AS line_no, {x} AS line FROM red" for i, x in enumerate(head)]
    out += [f"SELECT comparison, CAST(100 + rank * 100 + {i} AS BIGINT), {x} FROM rounded" for i, x in enumerate(body)]
    out += [f"SELECT comparison, CAST({1_000_000 + i} AS BIGINT), {x} FROM red" for i, x in enumerate(tail)]
    return _marginal_sql(CONFUSION_SQL, S.COMPARISONS) + "," + _test_cols_sql("cells") + f""",
    rounded AS (SELECT * REPLACE (round(p_value, 6) AS p_value, round(p_adj, 6) AS p_adj) FROM adj),
    red AS ({_reduction_sql("", S.COMPARISONS).replace(_marginal_sql("", S.COMPARISONS) + ", e AS", "WITH e AS")})
    SELECT *, lower(replace(replace(comparison, ' ', '_'), '.', '')) || '_results.txt' AS file_slug,
           trim(split_part(comparison, 'vs.', 1)) AS side_a, trim(split_part(comparison, 'vs.', 2)) AS side_b
    FROM ({' UNION ALL '.join(out)}) AS q"""


@register("report_lines", "SK5 PR20 PR21 PR22", _report_sql())
def _report_lines(spark: SparkSession, sf: str) -> DataFrame:
    from turnscore.session import materialize
    tr = materialize(CF.trace(_dense_confusion(spark, sf)), "trace")  # tiny, read twice
    td = S.topic_dim(spark)
    tests = round_doubles(CP.marginal_comparisons(tr, td))
    errors = round_doubles(CP.error_reduction(tr, td))
    lines = RP.comparison_report(tests, errors)
    return lines.withColumn("side_a", TX.side_name(F.col("comparison"), 1)) \
        .withColumn("side_b", TX.side_name(F.col("comparison"), 2))


# --------------------------------------- sources and sinks through the gate


@register("examples_jsonl_roundtrip", "SK2 SC4 PR12 PR13")
def _examples_jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "examples-jsonl")
    ex = DG.build_examples(X.scored_turns(spark, sf))
    WR.write_examples(ex.select("input", "output"), path)
    back = DG.parse_examples(RD.read_examples(spark, path))
    return back.select(F.col("parsed_topic").alias("topic"), "label", "output")


@register("confusion_doc_roundtrip", "SK4 SC5")
def _confusion_doc_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "confusion-docs")
    WR.write_confusion_docs(CF.confusion_document(_dense_confusion(spark, sf)), path)
    parts = []
    for model in ("base", "tuned"):
        parts.append(RD.read_confusion_doc(spark, f"{path}/model={model}").withColumn("model", F.lit(model)))
    out = parts[0].unionByName(parts[1])
    return out.select("model", "topic", "rule", F.col("true_score").cast("int").alias("true_score"),
                      F.col("pred_score").cast("int").alias("pred_score"), "n")


@register("predictions_roundtrip", "SK3 SE1")
def _predictions_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "predictions")
    WR.write_predictions(X.predictions(spark, sf), path)
    return round_doubles(M.evaluate(spark.read.parquet(path), ["model", "topic"]))


@register("learning_curve_csv_roundtrip", "SK6 SC6")
def _learning_curve_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "curve-csv")
    WR.write_table(ML.learning_curve_mean(_folded_wide(spark, sf, False, KEYED), ["example_id"]), path, fmt="csv")
    return round_doubles(ML.learning_curve_agg(RD.read_learning_curve(spark, path)))


@register("turns_csv_roundtrip", "SC1 SK1 R1")
def _turns_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Turns written as CSV without seq (range-partitioned files in seq order), read
    back with the source-order seq derived at ingest, then merged."""
    path = shared_path(spark, "turns-csv")
    t = X.turns(spark, sf)
    n_files = max(1, spark.sparkContext.defaultParallelism)
    WR.write_table(t.repartitionByRange(n_files, "seq").sortWithinPartitions("seq")
                   .select("subject", "speaker", "text"), path, fmt="csv")
    return TU.merge_turns(RD.read_turns(spark, path, fmt="csv", seq=None), order="global")


# Oracles of the round trips: the same rows as the direct queries.

_R["examples_jsonl_roundtrip"].sql = DIALOGUE_SQL + f"""SELECT
    CASE WHEN contains(input, 'Topic:') THEN {_strip_sql(f"replace(split_part(input, {NL}, 1), 'Topic:', '')")}
         ELSE 'Unknown' END AS topic,
    CAST(trunc(CAST({_strip_sql("split_part(output, ':', 2)")} AS DOUBLE)) AS INTEGER) AS label, output FROM ex"""
_R["confusion_doc_roundtrip"].sql = _R["confusion_matrices"].sql
_R["predictions_roundtrip"].sql = _R["eval_by_topic"].sql
_R["learning_curve_csv_roundtrip"].sql = _R["learning_curve_agg"].sql
_R["merged_turns_stream"].sql = _R["merge_turns_by_subject"].sql
_R["turns_csv_roundtrip"].sql = _merge_sql("dense_turns", True)


@register("media_manifest", "SC7 FI1 PR1", "SELECT DISTINCT 'source=' || source AS folder FROM documents WHERE source LIKE 'src1%'")
def _media_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written to a folder per source; the manifest lists the files below folders of one
    prefix, never reading them."""
    path = shared_path(spark, "media")
    X.table(spark, sf, "documents").select("doc_id", "source").write.partitionBy("source").parquet(path)
    files = RD.media_manifest(spark, path, folder_prefix="source=src1", suffix=".parquet")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()


@register("output_pending", "FI3", X.with_views("manifest") + """SELECT path FROM manifest WHERE doc_id % 4 <> 0""")
def _output_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings whose audio file is not among the outputs (every fourth document has one)."""
    m = _manifest_keyed(spark, sf)
    audio = TX.audio_name(F.col("subject"))
    outputs = m.where("doc_id % 4 = 0").select(audio.alias("path"))
    return IN.without_output(m.select("path", "subject"), outputs, audio).select("path")


@register("scored_turns_roundtrip", "SC2 AG3")
def _scored_turns_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Scores written with NaN for missing ones, read back as null."""
    path = shared_path(spark, "scored")
    X.scored_turns(spark, sf).withColumn("score", F.coalesce("score", F.lit(float("nan")))).write.parquet(path)
    return DG.first_score(RD.read_scored_turns(spark, path))


_R["scored_turns_roundtrip"].sql = _R["first_score_any"].sql


@register("text_pairs_read", "SC3 FI4", X.with_views("regression_docs") + """SELECT example_id % 2 = 1 AS synthetic,
    CAST(label AS DOUBLE) AS score, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM regression_docs
    WHERE example_id % 7 <> 0 AND example_id % 5 <> 0 GROUP BY ALL""")
def _text_pairs_read(spark: SparkSession, sf: str) -> DataFrame:
    """Two written collections, some texts null and some scores NaN, stacked without those."""
    path = shared_path(spark, "pairs")
    d = X.regression_docs(spark, sf).select(
        "example_id", F.when(F.col("example_id") % 7 != 0, F.col("text")).alias("text"),
        F.when(F.col("example_id") % 5 != 0, F.col("label").cast("double")).otherwise(F.lit(float("nan"))).alias("score"))
    d.where("example_id % 2 = 0").select("text", "score").write.parquet(f"{path}/real")
    d.where("example_id % 2 = 1").select("text", "score").write.parquet(f"{path}/synthetic")
    return RD.read_text_pairs(spark, f"{path}/real", f"{path}/synthetic").groupBy("synthetic", "score").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@register("rubric_scores", "PR23", X.with_views("scored_turns") + f"""SELECT f.topic, f.subject, f.score,
    CASE WHEN td.topic IS NOT NULL AND f.score <= 4 THEN td.label_en || ', ' || f.score END AS criterion
    FROM (SELECT topic, subject, CAST(trunc(arg_min(score, seq)) AS INTEGER) AS score FROM scored_turns
          WHERE score IS NOT NULL AND NOT isnan(score) AND subject IS NOT NULL AND topic IS NOT NULL GROUP BY topic, subject) AS f
    LEFT JOIN {TOPIC_DIM_SQL} ON td.topic = f.topic""")
def _rubric_scores(spark: SparkSession, sf: str) -> DataFrame:
    """First scores with the text of a rubric that ends at score 4."""
    rubric = SC.score_spine(S.topic_dim(spark)).where("score <= 4").select(
        "topic", "score", F.lit("").alias("description"), F.concat_ws(", ", "label_en", "score").alias("criterion"))
    return SC.rubric_lookup(DG.first_score(X.scored_turns(spark, sf)), rubric).select("topic", "subject", "score", "criterion")


@register("topic_mean_predictions", "ML8 ML1", round_sql(FOLDED_SQL + """, tm AS (SELECT v.fold, t.topic, avg(t.label) AS mu
    FROM (SELECT DISTINCT fold FROM folded) v JOIN folded t ON t.fold <> v.fold GROUP BY v.fold, t.topic),
    gm AS (SELECT v.fold, avg(t.label) AS mu FROM (SELECT DISTINCT fold FROM folded) v JOIN folded t ON t.fold <> v.fold GROUP BY v.fold)
    SELECT f.example_id, 'topic_mean' AS model, f.fold, f.topic, f.label, coalesce(tm.mu, gm.mu) AS pred
    FROM folded f LEFT JOIN tm ON tm.fold = f.fold AND tm.topic = f.topic JOIN gm ON gm.fold = f.fold""", ["pred"]))
def _topic_mean_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(ML.topic_mean_cv_predictions(_folded_wide(spark, sf, False, KEYED)))


@register("baseline_report", "SK5 AG7 AG8", X.with_views("predictions_wide") + """, m AS (SELECT topic, avg(label) AS mu FROM predictions_wide
      GROUP BY topic),
    t AS (SELECT p.topic, m.mu, avg(pow(m.mu - p.label, 2)) AS mse, avg(abs(m.mu - p.label)) AS mae
          FROM predictions_wide p JOIN m USING (topic) GROUP BY p.topic, m.mu),
    o AS (SELECT avg(pow(m.mu - p.label, 2)) AS mse, avg(abs(m.mu - p.label)) AS mae, stddev_pop(m.mu - p.label) AS sd
          FROM predictions_wide p JOIN m USING (topic))
    SELECT CAST(0 AS BIGINT) AS line_no, '{baseline_head}' AS line UNION ALL SELECT 1, ''
    UNION ALL SELECT 1 + row_number() OVER (ORDER BY encode(topic)), printf('{baseline_topic}', topic, mu, mse, mae) FROM t
    UNION ALL SELECT 1000000, '' UNION ALL SELECT 1000001, '{baseline_all}'
    UNION ALL SELECT 1000002, printf('{mse}', mse) FROM o UNION ALL SELECT 1000003, printf('{mae}', mae) FROM o
    UNION ALL SELECT 1000004, printf('{std}', sd) FROM o""".format(**S.REPORT))
def _baseline_report(spark: SparkSession, sf: str) -> DataFrame:
    p = X.predictions_wide(spark, sf)
    return RP.baseline_lines(M.mean_baseline_topic(p), M.mean_baseline_overall(p))
