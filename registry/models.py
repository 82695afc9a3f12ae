"""Splits, folds, nearest neighbours and evaluation tables."""

from pyspark.sql import functions as F

from kinetable.operators import evaluate as ev
from kinetable.operators import knn
from kinetable.plans import tables
from registry.common import IMU, query, rounded

CLASSES = tuple(range(10))


def rows(spark, folder):
    table = tables.table(spark, folder, "embeddings")
    return table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")


SPLIT = """
split as (select vec_id as id, embedding, label, case when r <= floor(n * 0.25 + 0.5) then 'test' else 'train' end as side
  from (select *, row_number() over (partition by label order by md5('0:' || cast(vec_id as varchar)), vec_id) as r,
    count(*) over (partition by label) as n from embeddings) t)
"""


def split(spark, folder):
    return ev.stratified_split(rows(spark, folder), "id")


@query("stratified_split", f"with {SPLIT} select id, cast(label as bigint) as label, side from split")
def stratified_split(spark, folder):
    return rounded(split(spark, folder).select("id", "label", "side"))


@query(
    "ordered_split",
    f"""with {IMU}, n as (select *, row_number() over (partition by session_id order by seq) - 1 as r,
      count(*) over (partition by session_id) as n from clean)
    select session_id, seq, case when r < n - ceil(n * 0.25) then 'train' else 'test' end as side from n""",
)
def ordered_split(spark, folder):
    return ev.ordered_split(tables.clean_imu(spark, folder)).select("session_id", "seq", "side")


def sql_folds(k, table, key):
    dealt = ", ".join(
        f"count(*) filter (place % {k} <= {f}) over (partition by label) as e{f}" for f in range(k)
    )
    fold = " + ".join(f"case when e{f} <= j then 1 else 0 end" for f in range(k))
    return f"""firsts as (select label, min({key}) as f from {table} group by label),
    sorted as (select {key}, t.label, row_number() over (order by f, {key}) - 1 as place,
      row_number() over (partition by t.label order by {key}) - 1 as j from {table} t join firsts using (label)),
    dealt as (select *, {dealt} from sorted),
    folds as (select {key}, label, {fold} as fold from dealt)"""


@query(
    "fold_assignment",
    f"with {sql_folds(4, 'embeddings', 'vec_id')} select vec_id as id, cast(label as bigint) as label, cast(fold as bigint) as fold from folds",
)
def fold_assignment(spark, folder):
    return rounded(ev.stratified_folds(rows(spark, folder), "id", k=4).select("id", "label", "fold"))


@query(
    "fold_sizes",
    f"""with {sql_folds(20, 'embeddings', 'vec_id')} select cast(fold as bigint) as fold, cast(label as bigint) as label, count(*) as n
    from folds group by fold, label""",
)
def fold_sizes(spark, folder):
    folds = ev.stratified_folds(rows(spark, folder), "id", k=20)
    return rounded(folds.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")))


K = 8
NEAREST = f"""{SPLIT},
pairs as (select q.id as query, q.label as actual, t.id as neighbour, t.label,
  sqrt(list_sum(list_transform(list_zip(q.embedding, t.embedding),
    lambda z: (cast(z[1] as double) - cast(z[2] as double)) * (cast(z[1] as double) - cast(z[2] as double))))) as distance
  from split q join split t on q.side = 'test' and t.side = 'train'),
nearest as (select *, rank from (select *, row_number() over (partition by query order by distance, neighbour) as rank
  from pairs) r where rank <= {K}),
uniform as (select query, actual, label, count(*) as w from nearest group by query, actual, label),
weighted as (select query, actual, label, sum(1e0 / distance) as w from nearest group by query, actual, label),
voted as (select query, actual, label as prediction from (
  select *, row_number() over (partition by query order by w desc, label) as r from uniform) t where r = 1),
voted_by_distance as (select query, actual, label as prediction from (
  select *, row_number() over (partition by query order by w desc, label) as r from weighted) t where r = 1),
scores as (select q.id as query, c.label as class, coalesce(u.w, 0) / cast({K} as double) as score,
    case when q.label = c.label then 1 else 0 end as hit
  from (select * from split where side = 'test') q
    join (select distinct label from embeddings) c on true
    left join uniform u on u.query = q.id and u.label = c.label)
"""


def neighbours(spark, folder, **options):
    parts = split(spark, folder)
    train, test = parts.where("side = 'train'"), parts.where("side = 'test'")
    return knn.k_nearest(train, test, K, **options), test


def predicted(spark, folder, weights="uniform"):
    found, test = neighbours(spark, folder)
    votes = knn.predict(found, CLASSES, weights=weights)
    return votes.join(test.select(F.col("id").alias("query"), "label"), "query")


@query(
    "knn_neighbours",
    f"with {NEAREST} select query, neighbour, cast(label as bigint) as label, round(distance, 9) as distance, rank from nearest",
)
def knn_neighbours(spark, folder):
    return rounded(neighbours(spark, folder, pivots=12, block_rows=20, query_rows=50)[0], 9)


@query("knn_uniform", f"with {NEAREST} select query, cast(actual as bigint) as label, cast(prediction as bigint) as prediction from voted")
def knn_uniform(spark, folder):
    return rounded(predicted(spark, folder).select("query", "label", "prediction"))


@query(
    "knn_distance",
    f"with {NEAREST} select query, cast(actual as bigint) as label, cast(prediction as bigint) as prediction from voted_by_distance",
)
def knn_distance(spark, folder):
    return rounded(predicted(spark, folder, "distance").select("query", "label", "prediction"))


@query(
    "accuracy",
    f"with {NEAREST} select round(avg(case when actual = prediction then 1e0 else 0e0 end), 9) as accuracy, count(*) as n from voted",
)
def accuracy(spark, folder):
    return rounded(ev.accuracy(predicted(spark, folder)), 9)


@query(
    "confusion_matrix",
    f"""with {NEAREST}, c as (select distinct label from embeddings)
    select cast(a.label as bigint) as actual, cast(p.label as bigint) as predicted, count(v.query) as n
    from c a join c p on true left join voted v on v.actual = a.label and v.prediction = p.label group by all""",
)
def confusion_matrix(spark, folder):
    return rounded(ev.confusion_matrix(predicted(spark, folder), CLASSES))


@query(
    "confusion_table",
    f"""with {NEAREST}, c as (select distinct label from embeddings)
    select cast(a.label as bigint) as actual, {', '.join(f'count(v.query) filter (v.prediction = {c}) as predicted_{c}' for c in CLASSES)}
    from c a left join voted v on v.actual = a.label group by a.label""",
)
def confusion_table(spark, folder):
    return rounded(ev.confusion_table(predicted(spark, folder), CLASSES))


ROC = f"""{NEAREST},
grouped as (select score as threshold, sum(hit) as pos, sum(1 - hit) as neg from scores group by score),
curve as (select *, sum(pos) over (order by threshold desc) as tp, sum(neg) over (order by threshold desc) as fp,
  sum(pos) over () as p, sum(neg) over () as n from grouped)
"""


@query(
    "roc_points",
    f"""with {ROC} select round(threshold, 9) as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp,
      round(tp / cast(p as double), 9) as tpr, round(fp / cast(n as double), 9) as fpr from curve""",
)
def roc_points(spark, folder):
    scores = ev.flattened_scores(predicted(spark, folder), CLASSES)
    return rounded(ev.roc_points(scores).select("threshold", "tp", "fp", "tpr", "fpr"), 9)


AREA = """area as (select sum((fp - b_fp) * (tp + b_tp) / 2e0) / max(cast(p as double) * cast(n as double)) as auc from (
  select *, lag(tp, 1, 0) over (order by threshold desc) as b_tp, lag(fp, 1, 0) over (order by threshold desc) as b_fp
  from curve) t)"""


@query("auc_micro", f"with {ROC}, {AREA} select round(auc, 9) as auc from area")
def auc_micro(spark, folder):
    return rounded(ev.micro_auc(predicted(spark, folder), CLASSES), 9)


@query(
    "evaluate_model",
    f"""with {ROC}, {AREA}, c as (select distinct label from embeddings)
    select 'knn' as model, 'auc' as metric, round(auc, 9) as value from area union all
    select 'knn', 'accuracy', round(avg(case when actual = prediction then 1e0 else 0e0 end), 9) from voted union all
    select 'knn', 'confusion_' || a.label || '_' || p.label, cast(count(v.query) as double)
      from c a join c p on true left join voted v on v.actual = a.label and v.prediction = p.label group by a.label, p.label""",
)
def evaluate_model(spark, folder):
    return rounded(ev.evaluate_model(predicted(spark, folder), CLASSES, "knn"), 9)


@query(
    "batch_scores",
    f"""with {IMU}, b as (select session_id, seq // 20 as batch, label from clean),
    modes as (select session_id, batch, label, row_number() over (partition by session_id, batch
      order by count(*) desc, label) as r from b group by session_id, batch, label)
    select session_id, batch, round(avg(b.label), 9) as score, cast(min(m.label) as bigint) as majority
    from b join modes m using (session_id, batch) where r = 1 group by session_id, batch""",
)
def batch_scores(spark, folder):
    rows_ = tables.clean_imu(spark, folder).withColumn("batch", F.floor(F.col("seq") / 20))
    return rounded(ev.batch_scores(rows_, ("session_id", "batch"), "label"), 9)


# A continuous score: many distinct thresholds, so the curve spans all ranges.
@query(
    "roc_by_price",
    """with s as (select l_extendedprice as score, case when l_returnflag = 'R' then 1 else 0 end as hit from lineitem),
    g as (select score as threshold, sum(hit) as pos, sum(1 - hit) as neg from s group by score)
    select threshold, cast(sum(pos) over (order by threshold desc) as bigint) as tp,
      cast(sum(neg) over (order by threshold desc) as bigint) as fp from g""",
)
def roc_by_price(spark, folder):
    line = tables.table(spark, folder, "lineitem")
    hit = F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("long")
    scores = line.select(F.col("l_extendedprice").alias("score"), hit.alias("hit"))
    return ev.roc_points(scores).select("threshold", "tp", "fp")
