"""Queries over logged evaluation rows: grading, agreement, sampling and energy.

Plans are SQL that Catalyst optimises. The text is shared with DuckDB where the dialects agree;
``<<`` marks hide the two function spellings that differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import ranks
from tarn.sources import files
from tarn.session import table, texts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: The logged grid: one row for each answered question.
GRID_SQL = """(select event_id as qid, event_type as model, case when user_id % 2 = 0 then 'gpu' else 'npu' end as device,
    case user_id % 3 when 0 then 'closed_book' when 1 then 'rag' else 'oracle' end as cond, event_id % 6 + 1 as kind, event_id % 5 as rep,
    case when user_id % 3 = 0 then 'none' when user_id % 3 = 1 then 'retrieved_top_k' when event_id % 6 = 4 then 'retrieved_chunk' when event_id % 6 = 3 then 'gold_passage_pair' else 'gold_passage' end as source,
    user_id, value as joules, cast(K as bigint) as work, (event_id * 7 + cast(K as bigint)) % 3 as score, ts from {events})"""
GRID_SPARK = GRID_SQL.replace("K as bigint", "get_json_object(props, '$.k') as bigint")
GRID_DUCK = GRID_SQL.replace("K as bigint", "json_extract_string(props, '$.k') as bigint")


def _dialect(sql: str, sha: str, hex8: str) -> str:
    sql = re.sub(r"sha<<(.*?)>>", lambda m: sha.format(m[1]), sql)
    return re.sub(r"hex8<<(.*?)>>", lambda m: hex8.format(m[1]), sql)


def portable(name: str, sql: str) -> None:
    """Registers one SQL text for both engines; {grid} and table names in braces are filled in."""
    spark_sql = _dialect(sql.replace("{grid}", GRID_SPARK), "sha2({}, 256)", "cast(conv(substr(sha2({}, 256), 1, 8), 16, 10) as bigint)")
    used = [t for t in TABLES if "{" + t + "}" in spark_sql]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return spark.sql(spark_sql, **{t: table(spark, sf, t) for t in used})

    run.__name__ = name
    QUERIES[name] = run
    duck = _dialect(sql.replace("{grid}", GRID_DUCK), "sha256({})", "cast('0x' || substr(sha256({}), 1, 8) as bigint)")
    for t in TABLES:
        duck = duck.replace("{" + t + "}", t)
    ORACLES[name] = duck


CELL = "model, device, cond"

portable("json_props", "select qid, model, work, joules from {grid} g")
portable("cell_medians", f"""select {CELL}, count(*) as n, round(median(joules), 6) as joules, round(median(work), 6) as work,
    round(median(case when source in ('retrieved_top_k', 'retrieved_chunk') then 773e-4 else 0e0 end + joules), 6) as total from {{grid}} g group by {CELL}""")
# Retrieval is charged by where the context comes from, not by the condition.
portable("retrieval_energy", "select cond, source, count(*) as n, count_if(source in ('retrieved_top_k', 'retrieved_chunk')) as charged, round(sum(case when source in ('retrieved_top_k', 'retrieved_chunk') then 773e-4 else 0e0 end), 4) as joules from {grid} g group by cond, source")
portable("accuracy_matrix", "select model, cond, " + ", ".join(f"round(avg(case when kind = {k} then score end) / 2, 6) as kind_{k}" for k in range(1, 7)) + ", count(*) as n from {grid} g group by model, cond")
portable("joules_per_correct", f"""select {CELL}, n, round(acc, 6) as accuracy, round(strict, 6) as strict, round(j, 6) as joules, empty,
    case when acc > 0.005 then round(j / acc, 4) end as per_correct, case when strict > 0.005 then round(j / strict, 4) end as per_strict, acc <= 0.005 as is_infinite
    from (select {CELL}, count(*) as n, avg(score) / 2 as acc, avg(case when score = 2 then 1e0 else 0e0 end) as strict, avg(joules) as j, count_if(work = 0) as empty from {{grid}} g group by {CELL}) x""")
portable("grade_energy_join", """select g.model, count(*) as n, round(sum(e.joules), 4) as joules, sum(g.score) as score from
    (select model, user_id, score, row_number() over (partition by model, user_id order by qid desc) as k from {grid} a) g
    join (select model, user_id, joules, row_number() over (partition by model, user_id order by qid desc) as k from {grid} b) e
    on g.model = e.model and g.user_id = e.user_id where g.k = 1 and e.k = 1 group by g.model""")
portable("dedupe_last", "select user_id, model, qid, joules from (select *, row_number() over (partition by user_id, model order by qid desc) as k from {grid} g) x where k = 1")
portable("contamination_majority", """select user_id, n, twos, ones, case when 2 * twos > n then 'contaminated' when 2 * (twos + ones) > n then 'review' when n = 0 then 'skipped' else 'clean' end as verdict
    from (select user_id, count(score) as n, count_if(score = 2) as twos, count_if(score = 1) as ones from {grid} g where kind <> 5 group by user_id) x""")
portable("contamination_rate", """select kind, count(*) as n, round(avg(case when 2 * twos > n then 1e0 else 0e0 end), 6) as rate from
    (select kind, user_id, count(*) as n, count_if(score = 2) as twos from {grid} g group by kind, user_id) x group by kind""")
portable("bucketed_medians", """select device, case when work < 25 then '0-24' when work < 50 then '25-49' when work < 75 then '50-74' else '75+' end as bucket,
    count(*) as n, round(median(joules), 6) as middle from {grid} g group by 1, 2""")
portable("paired_arms", """select a.model, count(*) as n, count_if(a.score = b.score) as same, round(avg(a.joules - b.joules), 6) as difference
    from {grid} a join {grid} b on a.model = b.model and a.user_id = b.user_id and a.kind = b.kind and a.rep = 0 and b.rep = 1 group by a.model""")
portable("device_agreement", """select model, cond, count(*) as n, count_if(lo = hi) as exact, count_if(lo > 0) as all_right, count_if(lo = 0 and hi > 0) as split_ from
    (select model, cond, kind, min(score) as lo, max(score) as hi, count(distinct device) as d from {grid} g group by model, cond, kind, rep) x group by model, cond""")
portable("upper_middle_median", f"""select {CELL}, joules from (select {CELL}, joules, row_number() over (partition by {CELL} order by joules, qid) as k, count(*) over (partition by {CELL}) as n from {{grid}} g) x
    where k = cast(floor(n / 2) as bigint) + 1""")
portable("stratified_sample", "select kind, qid, pick from (select kind, qid, row_number() over (partition by kind order by sha<<concat('7:', cast(qid as string))>>, qid) as pick from {grid} g) x where pick <= 12")
portable("two_level_sample", """select kind, model, qid from (select kind, model, qid, row_number() over (partition by kind, model order by sha<<concat('s', cast(qid as string))>>, qid) as k from {grid} g) x
    where k <= case when kind in (1, 2) then 4 else 2 end""")
portable("shuffled_batches", "select kind, qid, cast(floor((k - 1) / 12) as bigint) as batch, (k - 1) % 12 as place from (select kind, qid, row_number() over (partition by kind order by sha<<concat('b', cast(qid as string))>>, qid) as k from {grid} g) x")
portable("salted_ids", "select qid, concat('K', upper(substr(sha<<concat('0:', cast(qid as string))>>, 1, 10))) as salted from {grid} g")
portable("first_n_per_group", "select model, kind, qid from (select model, kind, qid, row_number() over (partition by model, kind order by qid) as k from {grid} g) x where k <= 3")
portable("batch_check", """select cast(floor(k / 6) as bigint) as band, count(*) as n, round(avg(case when score = other then 1e0 else 0e0 end), 6) as same, round(avg(score - other), 6) as difference
    from (select qid % 24 as k, score, (qid + work) % 3 as other from {grid} g) x group by 1""")
portable("energy_delta", """select qid, user_id, round(joules - lag(joules) over (partition by user_id order by ts, qid), 6) as delta from {grid} g""")
portable("idle_rate", """select device, round((max(joules) - min(joules)) / count(*), 6) as rate, round((max(joules) - min(joules)) / nullif(min(joules), 0), 4) as spread from {grid} g group by device""")
portable("marginal_energy", "select qid, round(joules - 5e-1 * work, 6) as marginal, round((joules - 5e-1 * work) / nullif(work, 0) + 1e-9, 6) as per_call, round(10 / nullif(joules, 0), 4) as tick_error from {grid} g")
portable("tokens_per_time", "select qid, round(round(joules, 3) / nullif(work, 0) + 1e-9, 3) as tpot from {grid} g")
portable("early_stop", """select model, count(*) as calls, round(sum(joules), 6) as joules from (select model, joules, coalesce(sum(joules) over (partition by model order by qid rows between unbounded preceding and 1 preceding), 0) as before
    from {grid} g) x where before < 500 group by model""")
CHARGED = "case when source in ('retrieved_top_k', 'retrieved_chunk') then 773e-4 else 0e0 end"


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(f"select * from {GRID_SPARK} g", events=table(spark, sf, "events"))


def cell_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Medians of each cell and of the totals of its rows, which need not be the sum of the medians."""
    by, rows = CELL.split(", "), grid(spark, sf).withColumn("total", F.col("joules") + F.expr(CHARGED))
    found = ranks.medians(rows, by, "joules", "work", "total").join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    return found.select(*by, "n", *[F.round(c, 6).alias(c) for c in ("joules", "work", "total")])


def upper_middle_median(spark: SparkSession, sf: str) -> DataFrame:
    by = CELL.split(", ")
    return ranks.middles(grid(spark, sf), by, "joules").select(*by, F.col("upper").alias("joules"))


def shuffled_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of twelve of each kind in an order that carries no signal."""
    rows = grid(spark, sf).select("kind", "qid", F.sha2(F.concat(F.lit("b"), F.col("qid").cast("string")), 256).alias("h"))
    found = ranks.running(rows, ["kind"], ["h", "qid"])
    return found.select("kind", "qid", F.expr("position div 12").alias("batch"), F.expr("position % 12").alias("place"))


def early_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of each model until they have taken 500 joules."""
    found = ranks.running(grid(spark, sf).select("model", "qid", "joules"), ["model"], ["qid"], "joules")
    return found.where("before < 500").groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("joules"), 6).alias("joules"))


# Their SQL above stays as the other side of the comparison.
QUERIES |= {f.__name__: f for f in (cell_medians, upper_middle_median, shuffled_batches, early_stop)}
portable("energy_linear_fit", "select model, device, count(*) as n, round(regr_slope(joules, work), 6) as slope, round(regr_intercept(joules, work), 6) as intercept from {grid} g group by model, device")

SPARK_BLOCKS = "(select explode(array(1, 2, 4, 8, 16, 24, 32, 48, 64, 80, 96)) as b)"
DUCK_BLOCKS = "(select unnest([1, 2, 4, 8, 16, 24, 32, 48, 64, 80, 96]) as b)"
SPARK_POWERS = "(select explode(transform(sequence(4, 40), i -> i / 20D)) as p)"
DUCK_POWERS = "(select unnest(range(4, 41)) / 20.0::double as p)"
FORMS = {"linear": ("cast(work as double)", "(select 0e0 as q)"), "block": ("cast(ceil(work / q) as double)", "(select cast(b as double) as q from BLOCKS x)"), "power": ("power(cast(work as double), q)", "(select p as q from POWERS x)")}


def fits(rows: str, form: str) -> str:
    """The least-squares form of each cell of ``rows`` with the smallest squared error: q, slope, intercept.

    Rows of one work size are summed before they meet the candidates, so that these multiply sums and not rows.
    """
    x, candidates = FORMS[form]
    return f"""(select model, device, q, slope, intercept, sse from (select *, row_number() over (partition by model, device order by sse, q) as k from
      (select model, device, q, slope, (sy - slope * sx) / n as intercept, round(syy - sy * sy / n - slope * (sxy - sx * sy / n), 4) as sse from
       (select *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) as slope from
        (select model, device, q, sum(n) as n, sum(n * x) as sx, sum(n * x * x) as sxx, sum(y) as sy, sum(x * y) as sxy, sum(yy) as syy from
         (select model, device, q, n, y, yy, {x} as x from (select model, device, work, cast(count(*) as double) as n, sum(joules) as y, sum(joules * joules) as yy from {rows} r group by model, device, work) w cross join {candidates} c) p
        group by model, device, q) o) t) y where sse is not null) z where k = 1)"""


def two_dialects(name: str, sql: str) -> None:
    portable(name, sql)
    run_sql = _dialect(sql.replace("{grid}", GRID_SPARK), "sha2({}, 256)", "")
    run_sql = run_sql.replace("BLOCKS x", SPARK_BLOCKS + " x").replace("POWERS x", SPARK_POWERS + " x")
    QUERIES[name] = lambda spark, sf: spark.sql(run_sql, events=table(spark, sf, "events"))
    ORACLES[name] = ORACLES[name].replace("BLOCKS x", DUCK_BLOCKS + " x").replace("POWERS x", DUCK_POWERS + " x")


two_dialects("energy_block_fit", f"select model, device, cast(q as bigint) as block, round(slope, 5) as slope, round(intercept, 4) as intercept from {fits('{grid}', 'block')} f")
two_dialects("energy_power_fit", f"select model, device, q as p, round(slope, 4) as slope, round(intercept, 4) as intercept from {fits('{grid}', 'power')} f")

_TRAIN = "(select * from {grid} t where rep < 4)"
_SCORED = " union all ".join(
    f"""select h.model, h.device, '{form}' as form, h.mae, h.mape, f.q, f.slope, f.intercept, f.least from
      (select g.model, g.device, avg(abs(joules - (slope * {x} + intercept))) as mae, avg(abs(joules - (slope * {x} + intercept)) / greatest(joules, 1e-9)) * 100 as mape
       from (select * from {{grid}} h where rep = 4) g join {fits(_TRAIN, form)} f on g.model = f.model and g.device = f.device group by g.model, g.device) h
      join (select f.model, f.device, q, slope, intercept, min(slope * {x} + intercept) as least from (select distinct model, device, work from {{grid}} a) w join {fits('{grid}', form)} f on w.model = f.model and w.device = f.device
       group by f.model, f.device, q, slope, intercept) f on h.model = f.model and h.device = f.device""" for form, (x, _) in FORMS.items())
#: The form of each cell with the least held-out error among those that predict no negative energy, fitted on all rows.
_CHOSEN = f"(select * from (select *, row_number() over (partition by model, device order by case when least < 0 then 1 else 0 end, round(mae, 5), form) as k from ({_SCORED}) u) v where k = 1)"
two_dialects("energy_form_choice", f"select model, device, form, round(mae, 5) as mae, round(mape, 3) as mape, least >= 0 as valid, q, round(slope, 4) as slope, round(intercept, 3) as intercept from {_CHOSEN} c")
_AT = "case form " + " ".join(f"when '{form}' then {x}" for form, (x, _) in FORMS.items()).replace("work / q", "work / nullif(q, 0)") + " end"
two_dialects("energy_predict", f"""select qid, round(prefill, 4) as e_prefill, round(decode, 4) as e_decode, retrieval as e_retrieval, round(prefill + decode + retrieval, 4) as e_total from
    (select qid, greatest(0e0, c.slope * {_AT} + c.intercept) as prefill, greatest(0e0, d.slope * kind) as decode, case when source in ('retrieved_top_k', 'retrieved_chunk') then 773e-4 else 0e0 end as retrieval
     from {{grid}} g join {_CHOSEN} c on g.model = c.model and g.device = c.device
     join (select model as m, device as e, regr_slope(joules, kind) as slope from {{grid}} s group by model, device) d on g.model = d.m and g.device = d.e) x""")

RATERS = "(select doc_id, quality as a, 1 - toxic as b, doc_id % 4 as kind from {labels})"
KAPPA = """case when pe = 1 then 1e0 else (po - pe) / (1 - pe) end"""


def kappa(rows: str, by: str) -> str:
    return f"""(select {by}, n, po, pe, {KAPPA} as kappa from (select {by}, count(*) as n, avg(case when a = b then 1e0 else 0e0 end) as po,
        avg(cast(a as double)) * avg(cast(b as double)) + (1 - avg(cast(a as double))) * (1 - avg(cast(b as double))) as pe from {rows} r group by {by}) y)"""


portable("kappa_binary", f"select n, round(po, 6) as po, round(pe, 6) as pe, round(kappa, 6) as kappa, case when kappa >= 0.61 then 'substantial' when kappa >= 0.41 then 'moderate' else 'weak' end as verdict from {kappa(f'(select *, 1 as one from {RATERS} q)', 'one')} k")
portable("kappa_by_kind", f"select kind, n, round(kappa, 6) as kappa from {kappa(RATERS, 'kind')} k where n >= 10")
portable("confusion", f"select a, count_if(b = 0) as b0, count_if(b = 1) as b1 from {RATERS} r group by a")
portable("disagreement_direction", f"select count_if(a > b) as harsher, count_if(a < b) as milder, case when avg(case when a > b then 1e0 when a < b then 0e0 end) > 0.65 then 'harsher' when avg(case when a > b then 1e0 when a < b then 0e0 end) < 0.35 then 'milder' else 'even' end as skew from {RATERS} r")

# A resample draws n row numbers by hash, eight to a digest; rows in the order of their grades need only the counts of the four grade pairs.
_HASHED = "(select s.b as draw, kind, n, sha<<concat(cast(s.b as string), ':', cast(kind as string), ':', cast(e.j as string))>> as h, e.j as j from (select kind, n, EIGHTS from {cells} t) e cross join DRAWS s)"
_PICKS = "(select draw, kind, n, (HEX) % n as pick from (select draw, kind, n, h, j, PLACES from {hashed} d) e where j * 8 + i < n)"


def bootstrap(by: str, draws: int, low: int, high: int) -> dict[str, str]:
    """Spark and DuckDB texts of the interval of kappa over ``draws`` resamples, from the values of rank ``low`` and ``high`` from 0."""
    pairs = [(a, b) for a in (0, 1) for b in (0, 1)]
    counts = ", ".join(f"count_if(a = {a} and b = {b}) as c{a}{b}" for a, b in pairs)
    cells = f"(select {by} as kind, count(*) as n, {counts} from {RATERS} q group by {by} having count(*) >= 10)"
    hashed = _HASHED.replace("{cells}", cells)
    rows = _PICKS.replace("{hashed}", hashed)
    dealt = f"""(select draw, p.kind, case when pick < c00 + c01 then 0 else 1 end as a, case when pick < c00 then 0 when pick < c00 + c01 then 1 when pick < c00 + c01 + c10 then 0 else 1 end as b
        from {rows} p join {cells} t on p.kind = t.kind)"""
    sql = f"""select kind, max(case when k = {low + 1} then kappa end) as low, max(case when k = {high + 1} then kappa end) as high, count(*) as draws from
      (select kind, round(kappa, 6) as kappa, row_number() over (partition by kind order by kappa) as k from {kappa(dealt, 'draw, kind')} b) c group by kind"""
    # In Spark the counts travel with their rows, which are dealt out before they meet the draws: no join of all picks on one kind, nor one task of them.
    carried = sql.replace(f" from {rows} p join {cells} t on p.kind = t.kind", f" from {rows} p").replace("draw, p.kind", "draw, kind").replace("select kind, n, EIGHTS", "select /*+ REPARTITION(TASKS) */ kind, n, c00, c01, c10, EIGHTS")
    carried = carried.replace("select s.b as draw, kind, n,", "select /*+ BROADCAST(s) */ s.b as draw, kind, n, c00, c01, c10,").replace("(select draw, kind, n, (HEX)", "(select draw, kind, c00, c01, c10, n, (HEX)").replace("(select draw, kind, n, h, j,", "(select draw, kind, c00, c01, c10, n, h, j,")
    spark_sql = _dialect(carried, "sha2({}, 256)", "").replace("EIGHTS", "explode(sequence(0L, (n - 1) div 8)) as j").replace("PLACES", "explode(sequence(0, 7)) as i").replace("HEX", "cast(conv(substr(h, i * 8 + 1, 8), 16, 10) as bigint)")
    duck_sql = _dialect(sql, "sha256({})", "").replace("EIGHTS", "unnest(range(0, (n - 1) // 8 + 1)) as j").replace("PLACES", "unnest(range(0, 8)) as i").replace("HEX", "cast('0x' || substr(h, i * 8 + 1, 8) as bigint)")
    return {"spark": spark_sql.replace("DRAWS s", f"(select explode(sequence(0, {draws - 1})) as b) s"), "duck": duck_sql.replace("DRAWS s", f"(select unnest(range(0, {draws})) as b) s").replace("{labels}", "labels")}


def _register_bootstrap(name: str, texts: dict[str, str]) -> None:
    QUERIES[name] = lambda spark, sf: spark.sql(texts["spark"].replace("TASKS", str(4 * spark.sparkContext.defaultParallelism)), labels=table(spark, sf, "labels"))
    ORACLES[name] = texts["duck"]


_register_bootstrap("kappa_bootstrap", bootstrap("kind * 0", 2000, 50, 1950))
_register_bootstrap("kappa_bootstrap_by_kind", bootstrap("kind", 1000, 25, 975))

portable("resume_anti_join", "select o_orderkey, o_totalprice from {orders} o where not exists (select 1 from {lineitem} l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R')")
portable("star_join", """select n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey
    join {region} r on n.n_regionkey = r.r_regionkey where o_orderstatus <> 'P' group by n_name""")
portable("grid_cross", "select m.model, c.cond, d.device from (select distinct model from {grid} a) m cross join (select distinct cond from {grid} b) c cross join (select distinct device from {grid} e) d")
portable("freeze_hash", "select source, count(*) as n, sum(hex8<<concat(cast(doc_id as string), ':', text)>>) as digest from {documents} d group by source")
_OLD, _NEW = "select doc_id, text from {documents} a", "select doc_id, replace(text, ' the ', ' The ') as text from {documents} b"
_DIFF = f"""select count(case when side = 'old' then 1 end) as gone, count(case when side = 'new' then 1 end) as added, case when count(*) = 0 then 'IDENTICAL' else 'DRIFTED' end as verdict from
    (select 'old' as side, doc_id from ({_OLD} except {_NEW}) x union all select 'new', doc_id from ({_NEW} except {_OLD}) y) z"""
portable("freeze_diff", _DIFF)
portable("set_operations", """select (select count(*) from (select doc_id from {documents} a union select doc_id from {labels} b) u) as united,
    (select count(*) from (select doc_id from {documents} a intersect select doc_id from {labels} b) i) as common,
    (select count(*) from (select doc_id from {documents} a except select doc_id from {labels} b) e) as only_left,
    (select count(*) from {labels} a where not exists (select 1 from {documents} b where b.doc_id = a.doc_id)) as outside,
    (select count(*) from (select lang from {documents} d group by lang having count_if(not exists_) = 0) s) as subset_langs""".replace("from {documents} d group by lang having count_if(not exists_) = 0", "from (select d.lang, case when l.doc_id is null then 1 else 0 end as without from {documents} d left join {labels} l on d.doc_id = l.doc_id) j group by lang having sum(without) = 0"))
portable("uniqueness_check", "select count(*) as n, count(distinct doc_id) as ids, count(distinct text) as texts, count_if(text is null) as missing, count_if(n_chars <> length(text)) as wrong from {documents} d")
portable("corpus_verdict", """select verdict, count(*) as n, sum(n_chars) as chars from (select n_chars, case when source = 'src1' then 'keep' when source = 'src2' then 'reject'
    when n_chars < 200 then 'scan' else 'keep' end as verdict from {documents} d) x group by verdict""")
portable("prompt_hash", "select item_id, sha<<concat('[1] ', text, chr(10), chr(10), '[2] ', lower(text), chr(10), 'Question ', cast(item_id as string))>> as prompt from {benchmark} b")
portable("doc_id_of_source", "select distinct source, lower(regexp_replace(concat(source, '.v2.PDF'), '[.][^.]*$', '')) as doc from {documents} d")
portable("percent_format", "select cond, case when count(*) = 0 then '-' else cast(cast(round(100.0 * count_if(score = 2) / count(*), 1) as decimal(5,1)) as string) end as share from {grid} g group by cond")

_SIMPLE = "(select conv_id, max(case when role = 'user' then text end) as a, max(case when role = 'assistant' then text end) as b from {conversations} group by conv_id)"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9 ]+', ''{1}))"


def _agreement(g: str) -> str:
    a, b = _NORM.format("a", g), _NORM.format("b", g)
    return f"""select count(*) as n, count_if(a = b) as exact, count_if({a} = {b}) as normalised, count_if(position({b} in {a}) > 0 or position({a} in {b}) > 0) as contained,
        count_if(length(a) > length(b)) as longer from {_SIMPLE} x where a is not null and b is not null"""


portable("agreement_measures", _agreement(""))
ORACLES["agreement_measures"] = _agreement(", 'g'").replace("{conversations}", "conversations")

portable("vector_invariants", "")
QUERIES["vector_invariants"] = lambda spark, sf: table(spark, sf, "embeddings").agg(
    F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim"),
    F.count_if(F.abs(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) - 1) > 1e-5).alias("off_norm"))
ORACLES["vector_invariants"] = "select count(*) as n, min(len(embedding))::int as least_dim, max(len(embedding))::int as most_dim, count_if(abs(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) - 1) > 1e-5) as off_norm from embeddings"

#: An invented question set: shuffled fields, a repeated field, prose, holes in the numbering.
QUESTIONS = """intro
- **type:** 9
## Q1
- **type:** 1
prose between fields
- **question:** What is the fee?
- **answer:** 40 euro
- **source:** Rules.PDF
- **page:** 2-3
## Q4
- **answer:** no
- **type:** 4
- **question:** Compare both.
- **question:** Compare the two rules.
- **source:** Rules.pdf
- **source2:** Guide.v2.pdf
- **page:** 9
## Q7
- **type:** 5
- **source:** null
- **question:** Who won?
- **answer:** not stated"""


def parsed(spark: SparkSession) -> DataFrame:
    """One row for each question of the Markdown text: the last value of each field counts."""
    from pyspark.sql import Window

    rows = spark.createDataFrame([("set", QUESTIONS)], "md string, body string").select("md", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    number = F.when(F.col("line").rlike("^## Q[0-9]+ *$"), F.regexp_extract("line", "^## Q([0-9]+)", 1).cast("int"))
    rows = rows.withColumn("q_num", F.last(number, ignorenulls=True).over(Window.partitionBy("md").orderBy("line_no")))
    rows = rows.select("md", "q_num", "line_no", F.regexp_extract("line", "^- \\*\\*([a-z0-9_]+):\\*\\* (.*)$", 1).alias("field"), F.regexp_extract("line", "^- \\*\\*([a-z0-9_]+):\\*\\* (.*)$", 2).alias("value"))
    rows = rows.where("q_num is not null and field <> ''")
    value = lambda f: F.nullif(F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("line_no"))), F.lit("null"))
    return rows.groupBy("md", "q_num").agg(
        value("type").cast("int").alias("kind"), value("question").alias("question"), value("answer").alias("answer"),
        T.doc_id_of(value("source")).alias("source_doc"), T.doc_id_of(value("source2")).alias("second_doc"), value("page").alias("page"))


_LINES = "(select generate_subscripts(b, 1) as line_no, unnest(b) as line from (select string_split('" + QUESTIONS + "', chr(10)) b))"
_FIELD = "'^- \\*\\*([a-z0-9_]+):\\*\\* (.*)$'"
PARSED = f"""(select 'set' as md, q_num, {', '.join(f"nullif(max_by(value, line_no) filter (field = '{f}'), 'null') as {f}_" for f in ('type', 'question', 'answer', 'source', 'source2', 'page'))} from
  (select line_no, last_value(case when regexp_matches(line, '^## Q[0-9]+ *$') then regexp_extract(line, '^## Q([0-9]+)', 1)::int end ignore nulls) over (order by line_no) as q_num,
     regexp_extract(line, {_FIELD}, 1) as field, regexp_extract(line, {_FIELD}, 2) as value from {_LINES}) where q_num is not null and field <> '' group by q_num)"""
QUERIES["evalset_parse"] = lambda spark, sf: parsed(spark).withColumn("qid", F.concat("md", F.lit("::Q"), "q_num")).drop("md")
ORACLES["evalset_parse"] = f"""select md || '::Q' || q_num as qid, q_num, type_::int as kind, question_ as question, answer_ as answer, lower(regexp_replace(source_, '\\.[^.]*$', '')) as source_doc,
    lower(regexp_replace(source2_, '\\.[^.]*$', '')) as second_doc, page_ as page from {PARSED}"""
QUERIES["evalset_checks"] = lambda spark, sf: parsed(spark).agg(
    F.count(F.lit(1)).alias("n"), F.countDistinct("q_num").alias("ids"), F.count_if(F.col("question").isNull() | F.col("answer").isNull()).alias("missing"),
    F.count_if((F.col("kind") == 4) != F.col("second_doc").isNotNull()).alias("wrong_pairs"),
    F.count_if((F.col("kind") == 5) != F.col("source_doc").isNull()).alias("wrong_sources"),
    F.count_if(~F.forall(T.page_list(F.col("page")), lambda p: p.between(1, 5))).alias("out_of_bounds"))
ORACLES["evalset_checks"] = f"""select count(*) as n, count(distinct q_num) as ids, count_if(question_ is null or answer_ is null) as missing, count_if((type_ = '4') <> (source2_ is not null)) as wrong_pairs,
    count_if((type_ = '5') <> (source_ is null)) as wrong_sources, count_if(coalesce(string_split(page_, '-')[-1]::int, 1) > 5) as out_of_bounds from {PARSED}"""


def line_patch(spark: SparkSession, sf: str) -> DataFrame:
    """Lines 2 and 9 of each document replaced where they hold the word 'the'; other edits are skipped."""
    edits = F.when((F.col("line_no").isin(1, 8)) & F.col("line").contains("the"), F.lit("PATCHED")).otherwise(F.col("line"))
    rows = texts(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", edits.alias("line")))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: r["line"]), "\n")
    return rows.select("doc_id", F.sha2(text, 256).alias("digest"))


QUERIES["line_patch"] = line_patch
ORACLES["line_patch"] = """select doc_id, sha256(string_agg(case when k in (2, 9) and contains(line, 'the') then 'PATCHED' else line end, chr(10) order by k)) as digest
    from (select doc_id, generate_subscripts(p, 1) as k, unnest(p) as line from (select doc_id, string_split(text, chr(10)) p from documents)) group by doc_id"""


# Question files made of the benchmark: a Markdown file for every ninth of the items, one record for each item; of every fourth the answer is missing,
# documents are named by number, and pages are given in each way of writing them.
_RECORD = """concat('## Q', cast(item_id as string), chr(10), '- **type:** 9', chr(10), '- **type:** ', cast(item_id % 6 + 1 as string), chr(10), 'prose', chr(10),
    '- **question:** ', replace(text, chr(10), ' '), chr(10), case when item_id % 4 = 3 then '' else concat('- **answer:** ', cast(item_id as string), ' euro', chr(10)) end,
    '- **source:** ', case when item_id % 6 = 4 then 'null' else concat('Doc', cast(item_id as string), '.v1.PDF') end, chr(10), '- **passage:** ', case when item_id % 6 = 4 then 'null' else 'p' end, chr(10),
    '- **page:** ', case item_id % 3 when 0 then '10-12' when 1 then '1, 20,' else 'null' end, chr(10), '- **source2:** Doc0.pdf', chr(10), '- **passage2:** q', chr(10), '- **page2:** ', cast(item_id as string))"""
_AS_RECORDS = """(select concat('Set', item_id % 9, '::Q', item_id) as qid, concat('Set', item_id % 9) as md, item_id::int as q_num, (item_id % 6 + 1)::int as kind, trim(replace(text, chr(10), ' ')) as question,
    case when item_id % 4 <> 3 then item_id || ' euro' end as answer, case when item_id % 6 <> 4 then 'p' end as passage, case when item_id % 6 <> 4 then 'doc' || item_id || '.v1' end as doc_id,
    case item_id % 3 when 0 then [10, 11, 12] when 1 then [1, 20] else [] end as page_list, case when item_id % 6 = 3 then 'q' end as passage2, case when item_id % 6 = 3 then 'doc0' end as doc_id2,
    case when item_id % 6 = 3 then [item_id::int] end as page_list2 from benchmark)"""


def question_set(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("Set"), (F.col("item_id") % 9).cast("string")).alias("md"), F.expr(_RECORD).alias("r"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "r"))), lambda x: x["r"]), "\n")
    return files.questions(files.records(items.groupBy("md").agg(F.concat(F.lit("- **type:** 0\n"), lines).alias("value"))))


QUERIES["evalset_records"] = question_set
ORACLES["evalset_records"] = f"select * from {_AS_RECORDS} r"
QUERIES["evalset_faults"] = lambda spark, sf: files.question_faults(question_set(spark, sf), texts(spark, sf).select(
    F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") > 0, ".v1").otherwise("")).alias("doc_id"), F.size(F.split("text", "\n")).alias("n_pages")))
ORACLES["evalset_faults"] = f"""with r as (select * from {_AS_RECORDS} x), p as (select 'doc' || doc_id || case when doc_id > 0 then '.v1' else '' end as doc_id, len(string_split(text, chr(10))) as n_pages from documents),
    named as (select qid, doc_id, page_list as l from r where doc_id is not null union all select qid, doc_id2, page_list2 from r where doc_id2 is not null)
    select qid, 'no answer' as fault from r where answer is null union select qid, case when n_pages is null then 'unknown document' else 'page out of bounds' end from named left join p using (doc_id)
    where n_pages is null or len(list_filter(l, lambda k: k < 1 or k > n_pages)) > 0"""
