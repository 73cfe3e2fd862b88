"""The engine's operators as queries over the test tables, each with its SQL where SQL can say it.

`events` plays the fact table: an event is a pitch, its user the pitcher, its type the pitch type and its value the speed; a user's day is a
plate appearance. `lineitem` and the other tables serve joins and aggregates. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, ShortType

from .functions import expressions as E
from .grain import Grain, Relation
from .operators import relational as R
from .operators import sampling
from .operators import sequence as S
from .operators import usage as U
from .plans import modes, spec, workflow
from .sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EVENT = Grain(("event_id",), "event")

#: Fixed text: the fact table's names over events.
PITCHES = (
    "WITH pitches AS (SELECT event_id AS pitch_uid, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS BIGINT) AS game_pk, user_id AS at_bat_number, ts AS pitch_number, strftime(ts, '%Y-%m-%d') AS game_date, "
    "user_id AS pitcher, event_type AS pitch_type, value AS release_speed FROM events) "
)


def tidy(df: DataFrame) -> DataFrame:
    """Doubles at six places, whole numbers as longs."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (IntegerType, ShortType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def table(spark: SparkSession, sf: str, name: str, keys: tuple[str, ...] = (), label: str | None = None) -> Relation:
    return R.scan(spark, f"{sf}/{name}.parquet", Grain(keys, label or name))


def events(spark: SparkSession, sf: str) -> Relation:
    return R.scan(spark, f"{sf}/events.parquet", EVENT)


def pitches(spark: SparkSession, sf: str) -> Relation:
    e = events(spark, sf).df
    out = e.select(
        F.col("event_id").alias("pitch_uid"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("game_pk"), F.col("user_id").alias("at_bat_number"), F.col("ts").alias("pitch_number"),
        F.date_format("ts", "yyyy-MM-dd").alias("game_date"), F.col("user_id").alias("pitcher"), F.col("event_type").alias("pitch_type"), F.col("value").alias("release_speed"),
    )
    return Relation(out, Grain(("pitch_uid",), "pitch"))


def query(name: str, sql: str | None = None) -> Callable[[Callable[[SparkSession, str], Relation | DataFrame]], Query]:
    def add(f: Callable[[SparkSession, str], Relation | DataFrame]) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            found = f(spark, sf)
            return tidy(found.df if isinstance(found, Relation) else found)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def simple(name: str, sql: str, f: Callable[[Relation], Relation], base: Callable[[SparkSession, str], Relation] = events) -> None:
    query(name, sql)(lambda s, d: f(base(s, d)))


def lineitem(spark: SparkSession, sf: str) -> Relation:
    return table(spark, sf, "lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))


C, L = F.col, F.lit


# Scans, projections, predicates

simple("scan_project", "SELECT event_id, user_id, event_type FROM events", lambda r: R.project(r, ["event_id", "user_id", "event_type"]))
simple("filter_eq", "SELECT event_id, value + 0.0 AS value FROM (SELECT event_id, round(value, 6) AS value FROM events WHERE event_type = 'click')", lambda r: R.project(R.filtered(r, [{"field": "event_type", "op": "eq", "value": "click"}]), ["event_id", "value"]))
simple("filter_ne", "SELECT event_id, event_type FROM events WHERE event_type <> 'click'", lambda r: R.project(R.filtered(r, [{"field": "event_type", "op": "ne", "value": "click"}]), ["event_id", "event_type"]))
simple("filter_range", "SELECT event_id FROM events WHERE value >= 10 AND value < 50 AND user_id > 3 AND user_id <= 100", lambda r: R.project(R.filtered(r, [{"field": "value", "op": "ge", "value": "10"}, {"field": "value", "op": "lt", "value": 50}, {"field": "user_id", "op": "gt", "value": "3"}, {"field": "user_id", "op": "le", "value": 100}]), ["event_id"]))
simple("filter_in", "SELECT event_id, user_id FROM events WHERE user_id IN (1, 2, 3)", lambda r: R.project(R.filtered(r, [{"field": "user_id", "op": "in", "value": "1, 2, 3"}]), ["event_id", "user_id"]))
simple("filter_not_in", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')", lambda r: R.project(R.filtered(r, [{"field": "event_type", "op": "not_in", "value": ["click", "view"]}]), ["event_id", "event_type"]))
simple("filter_in_empty", "SELECT event_id FROM events WHERE false", lambda r: R.project(R.filtered(r, [{"field": "event_type", "op": "in", "value": []}]), ["event_id"]))
simple("filter_not_in_empty", "SELECT count(*) AS n FROM events", lambda r: R.aggregated(R.filtered(r, [{"field": "event_type", "op": "not_in", "value": []}]), [], [R.Metric("n")]))
simple(
    "filter_null", "SELECT event_id FROM events WHERE nullif(event_type, 'view') IS NULL",
    lambda r: R.project(R.filtered(r.with_df(r.df.withColumn("kind", F.nullif("event_type", L("view")))), [{"field": "kind", "op": "is_null"}]), ["event_id"]),
)
simple("filter_bool_not", "SELECT event_id FROM events WHERE NOT (event_type = 'click' OR value > 50) AND user_id <> 7", lambda r: R.project(R.where(r, E.all_of([~E.any_of([C("event_type") == "click", C("value") > 50]), C("user_id") != 7])), ["event_id"]))
simple("case_when", "SELECT event_id, CASE WHEN value >= 50 THEN 'high' WHEN value >= 10 THEN 'mid' END AS band FROM events", lambda r: R.project(r, {"event_id": C("event_id"), "band": E.case([(C("value") >= 50, L("high")), (C("value") >= 10, L("mid"))])}))
simple("arith", "SELECT event_id, round(value * 2 + user_id - 1, 6) + 0.0 AS x FROM events", lambda r: R.project(r, {"event_id": C("event_id"), "x": C("value") * 2 + C("user_id") - 1}))
simple("safe_divide", "SELECT event_id, round(CAST(value AS DOUBLE) / nullif(user_id % 3, 0), 6) + 0.0 AS x FROM events", lambda r: R.project(r, {"event_id": C("event_id"), "x": E.ARITHMETIC["/"](C("value"), C("user_id") % 3)}))
simple("safe_mod", "SELECT event_id, event_id % nullif(user_id % 4, 0) AS x FROM events", lambda r: R.project(r, {"event_id": C("event_id"), "x": E.ARITHMETIC["%"](C("event_id"), C("user_id") % 4)}))
simple("column_vs_column", "SELECT event_id FROM events WHERE value > user_id", lambda r: R.project(R.filtered(r, [{"field": "value", "op": "gt", "value_field": "user_id"}]), ["event_id"]))


@query("semantic_filter", PITCHES + "SELECT pitch_uid, pitch_type FROM pitches WHERE pitch_type IN ('click', 'view') AND release_speed > 20")
def semantic_filter(spark, sf):
    from .presets import Registry

    known = Registry()
    known.register("engaged", lambda: F.col("pitch_type").isin("click", "view"))
    known.register("fast", lambda: F.col("release_speed") > 20)
    return R.project(R.where(pitches(spark, sf), known["engaged"] & known["fast"]), ["pitch_uid", "pitch_type"])


#: Fixed text: pitch types, descriptions, zones and hands dealt out over lineitem, nulls among them, and what each built-in name says of them.
_NAMED = (
    "WITH dealt AS (SELECT l_orderkey, l_linenumber, ['FF', 'ST', 'CH', 'SL', 'CU', 'KC', 'SV', 'SI', 'FC', 'XX', NULL][1 + l_orderkey % 11] AS pitch_type, "
    "CASE WHEN l_partkey % 15 = 0 THEN NULL ELSE l_partkey % 15 END AS zone, "
    "['called_strike', 'swinging_strike', 'swinging_strike_blocked', 'missed_bunt', 'foul', 'foul_bunt', 'foul_tip', 'hit_into_play', 'ball', NULL][1 + l_suppkey % 10] AS description, "
    "CASE l_linenumber % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'L' END AS p_throws, CASE l_linenumber % 2 WHEN 0 THEN 'R' ELSE 'L' END AS stand FROM lineitem) "
    "SELECT count(CASE WHEN pitch_type = 'FF' THEN 1 END) AS four_seam_fastball, count(CASE WHEN pitch_type = 'ST' THEN 1 END) AS sweeper, count(CASE WHEN pitch_type = 'CH' THEN 1 END) AS changeup, "
    "count(CASE WHEN pitch_type IN ('SL', 'ST', 'CU', 'KC', 'SV') THEN 1 END) AS breaking_ball, count(CASE WHEN pitch_type IN ('FF', 'SI', 'FC') THEN 1 END) AS fastball_family, "
    "count(CASE WHEN zone BETWEEN 1 AND 9 THEN 1 END) AS in_strike_zone, count(CASE WHEN description = 'called_strike' THEN 1 END) AS called_strike, "
    "count(CASE WHEN description IN ('swinging_strike', 'swinging_strike_blocked', 'missed_bunt') THEN 1 END) AS whiff, "
    "count(CASE WHEN description IN ('swinging_strike', 'swinging_strike_blocked', 'missed_bunt', 'foul', 'foul_bunt', 'foul_tip', 'hit_into_play') THEN 1 END) AS swing, "
    "count(CASE WHEN p_throws = 'R' AND stand = 'R' THEN 1 END) AS right_on_right, count(CASE WHEN NOT (pitch_type = 'FF') THEN 1 END) AS not_four_seam FROM dealt"
)


@query("semantic_names", _NAMED)
def semantic_names(spark, sf):
    from .presets import Registry

    pick = lambda values, n: F.element_at(F.array(*map(L, values)), (n + 1).cast("int"))
    r = lineitem(spark, sf)
    dealt = r.df.select(
        pick(["FF", "ST", "CH", "SL", "CU", "KC", "SV", "SI", "FC", "XX", None], C("l_orderkey") % 11).alias("pitch_type"), F.nullif(C("l_partkey") % 15, L(0)).alias("zone"),
        pick(["called_strike", "swinging_strike", "swinging_strike_blocked", "missed_bunt", "foul", "foul_bunt", "foul_tip", "hit_into_play", "ball", None], C("l_suppkey") % 10).alias("description"),
        F.when(C("l_linenumber") % 3 == 0, "R").when(C("l_linenumber") % 3 == 1, "L").alias("p_throws"), F.when(C("l_linenumber") % 2 == 0, "R").otherwise("L").alias("stand"),
    )
    known = Registry()
    metrics = [R.Metric(n, "count", None, False, known[n]) for n in known.names()]
    return R.aggregated(r.with_df(dealt, Grain(())), [], [*metrics, R.Metric("not_four_seam", "count", None, False, ~known["four_seam_fastball"])])


simple(
    "circular_encode", "SELECT event_id, round(sin(radians(((value * 7 - 180) % 360 + 360) % 360)), 6) + 0.0 AS angle_sin, round(cos(radians(((value * 7 - 180) % 360 + 360) % 360)), 6) + 0.0 AS angle_cos FROM events",
    lambda r: R.project(r.with_df(r.df.withColumn("angle", C("value") * 7 - 180)), {"event_id": C("event_id"), **E.circular("angle")}),
)
simple("sort_topk", "SELECT event_id, round(value, 6) + 0.0 AS value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 25", lambda r: R.project(R.limit(R.sort(r, [("value", True), ("event_id", False)]), 25), ["event_id", "value"]))
simple("limit_total_order", "SELECT event_id FROM events ORDER BY event_id LIMIT 10", lambda r: R.limit(R.sort(R.project(r, ["event_id"]), ["event_id"]), 10))

# Set operations


def _kinds(r: Relation, *kinds: str) -> Relation:
    return R.project(R.where(r, C("event_type").isin(*kinds)), ["user_id"], Grain(("user_id",), "user"))


for _op, _all, _name, _sql in (("union", False, "union_distinct", "UNION"), ("union", True, "union_all", "UNION ALL"), ("intersect", False, "intersect_distinct", "INTERSECT"), ("except", False, "except_distinct", "EXCEPT")):
    simple(
        _name, f"SELECT user_id FROM events WHERE event_type IN ('click', 'view') {_sql} SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60",
        lambda r, op=_op, all=_all: R.set_operation(op, _kinds(r, "click", "view"), _kinds(R.where(r, C("value") > 60), "purchase"), all),
    )

# Joins


@query("join_inner", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner(spark, sf):
    a, b = table(spark, sf, "customer", ("c_custkey",)), table(spark, sf, "nation", ("n_nationkey",))
    return R.join(a, b, C("left.c_nationkey") == C("right.n_nationkey"), {"c_custkey": C("left.c_custkey"), "n_name": C("right.n_name")})


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey")
def join_left(spark, sf):
    a, b = table(spark, sf, "customer", ("c_custkey",)), R.where(table(spark, sf, "orders", ("o_orderkey",)), C("o_totalprice") > 200000)
    return R.join(a, b, C("left.c_custkey") == C("right.o_custkey"), {"c_custkey": C("left.c_custkey"), "o_orderkey": C("right.o_orderkey")}, "left")


@query("join_theta", "SELECT a.n_nationkey, b.r_regionkey FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey")
def join_theta(spark, sf):
    a, b = table(spark, sf, "nation", ("n_nationkey",)), table(spark, sf, "region", ("r_regionkey",))
    return R.join(a, b, C("left.n_regionkey") < C("right.r_regionkey"), {"n_nationkey": C("left.n_nationkey"), "r_regionkey": C("right.r_regionkey")})


@query("join_null_keys", "SELECT a.n_nationkey, b.r_name FROM (SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation) a JOIN (SELECT r_name, nullif(r_regionkey, 2) AS k FROM region) b ON a.k = b.k")
def join_null_keys(spark, sf):
    a = table(spark, sf, "nation", ("n_nationkey",))
    b = table(spark, sf, "region", ("r_regionkey",))
    a, b = a.with_df(a.df.withColumn("k", F.nullif("n_regionkey", L(2)))), b.with_df(b.df.withColumn("k", F.nullif("r_regionkey", L(2))))
    return R.join(a, b, C("left.k") == C("right.k"), {"n_nationkey": C("left.n_nationkey"), "r_name": C("right.r_name")})


@query("entity_semi_restriction", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 60)")
def entity_semi_restriction(spark, sf):
    r = events(spark, sf)
    many = R.where(R.aggregated(r, ["user_id"], [R.Metric("n")]), C("n") > 60)
    return r.with_df(r.df.join(many.df, "user_id", "left_semi").select("event_id"))


# Aggregates

_ALL = ("count", "sum", "avg", "min", "max", "median", "stddev_pop", "stddev_samp")


def _sql_of(f: str, x: str, distinct: str = "") -> str:
    return f"{f}({distinct}{x}) AS {f}_x" if f == "count" else f"round({f}({distinct}{x}), 6) + 0.0 AS {f}_x"


simple("agg_basic_all8", "SELECT event_type, " + ", ".join(_sql_of(f, "nullif(value, 0)") for f in _ALL) + ", count(*) AS row_count FROM events GROUP BY event_type", lambda r: R.aggregated(r, ["event_type"], [*(R.Metric(f"{f}_x", f, F.nullif(C("value"), L(0.0))) for f in _ALL), R.Metric("row_count")]))
simple("agg_distinct_all", "SELECT event_type, " + ", ".join(_sql_of(f, "floor(value)", "DISTINCT ") for f in _ALL) + " FROM events GROUP BY event_type", lambda r: R.aggregated(r, ["event_type"], [R.Metric(f"{f}_x", f, F.floor("value").cast("double"), True) for f in _ALL]))
simple(
    "agg_conditional", "SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) + 0.0 AS view_avg FROM events GROUP BY user_id",
    lambda r: R.aggregated(r, ["user_id"], [R.Metric("clicks", "count", None, False, C("event_type") == "click"), R.Metric("view_avg", "avg", C("value"), False, C("event_type") == "view")]),
)
simple("agg_scalar_empty", "SELECT count(*) AS n, sum(value) AS s, min(event_type) AS m FROM events WHERE value < -1e9", lambda r: R.aggregated(R.where(r, C("value") < -1e9), [], [R.Metric("n"), R.Metric("s", "sum", C("value")), R.Metric("m", "min", C("event_type"))]))
simple("agg_distinct_groups", "SELECT DISTINCT user_id, event_type FROM events", lambda r: R.aggregated(r, ["user_id", "event_type"], []))
simple("collect_set_signature", "SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds FROM events WHERE value > 30 GROUP BY user_id", lambda r: R.collect_set(R.where(r, C("value") > 30), ["user_id"], "event_type", "kinds"))

# Windows

for _m in ("row_number", "rank", "dense_rank"):
    _extra = ", event_id" if _m == "row_number" else ""
    simple(
        {"row_number": "rank_row_number", "rank": "rank_rank", "dense_rank": "rank_dense"}[_m], f"SELECT event_id, {_m}() OVER (PARTITION BY user_id ORDER BY floor(value) DESC NULLS LAST{_extra}) AS r FROM events",
        lambda r, m=_m: R.project(R.ranked(r.with_df(r.df.withColumn("v", F.floor("value"))), "r", [("v", True), *([("event_id", False)] if m == "row_number" else [])], ["user_id"], m), ["event_id", "r"]),
    )


def window(name: str, sql: str, function: str, args: tuple = (), order: tuple = ("ts",), frame: tuple | None = None, partition: tuple = ("user_id",)) -> None:
    w = f"PARTITION BY {', '.join(partition)}" + (f" ORDER BY {', '.join(order)}" if order else "")
    simple(name, f"SELECT event_id, {sql.format(w=w)} AS x FROM events", lambda r: R.project(R.windows(r, [R.WindowField("x", function, tuple(C(a) if isinstance(a, str) else a for a in args), partition, order, frame)]), ["event_id", "x"]))


window("win_percent_rank", "round(percent_rank() OVER ({w}), 6) + 0.0", "percent_rank", order=("value",))
window("win_cume_dist", "round(cume_dist() OVER ({w}), 6) + 0.0", "cume_dist", order=("value",))
window("win_lag_default", "round(lag(value, 2, -1) OVER ({w}), 6) + 0.0", "lag", ("value", 2, -1.0))
window("win_lead", "round(lead(value) OVER ({w}), 6) + 0.0", "lead", ("value",))
window("win_sum_partition", "round(sum(value) OVER ({w}), 6) + 0.0", "sum", ("value",), ())
window("win_count_star", "count(*) OVER ({w})", "count", (), ())
window("win_running_range_default", "round(sum(value) OVER ({w}), 6) + 0.0", "sum", ("value",))
window("frame_preceding", "round(avg(value) OVER ({w} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) + 0.0", "avg", ("value",), frame=(-3, -1))
window("frame_following", "round(max(value) OVER ({w} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 6) + 0.0", "max", ("value",), frame=(1, 4))
window("frame_centered", "round(min(value) OVER ({w} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0", "min", ("value",), frame=(-2, 2))
window("frame_unbounded", "count(value) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "count", ("value",), frame=(None, None))

# Sequences

_DAY = ["user_id"]
_EVENTS_CTE = (
    "WITH seqs AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS seq, count(*) OVER (PARTITION BY user_id) AS total FROM events), "
    "hits AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS ordinal FROM seqs WHERE event_type = 'purchase'), "
    "stats AS (SELECT user_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM hits GROUP BY user_id), "
    "pairs AS (SELECT DISTINCT a.user_id FROM hits a JOIN hits b ON a.user_id = b.user_id AND b.seq = a.seq + 1) "
)
_PICK = "SELECT h.event_id FROM hits h JOIN stats s ON h.user_id = s.user_id WHERE h.ordinal = {k}{more}"
_LOOSE = " AND h.user_id NOT IN (SELECT user_id FROM pairs)"


def pattern(name: str, sql: str, **kw) -> None:
    simple(name, _EVENTS_CTE + sql, lambda r: r.with_df(S.event_pattern(r, _DAY, ["ts"], C("event_type") == "purchase", **kw).df.select("event_id")))


pattern("event_pattern_any", _PICK.format(k=2, more=""), occurrence=2)
pattern("event_pattern_exact", _PICK.format(k=3, more=" AND s.n = 12"), occurrence=3, exact_count=12)
pattern("event_pattern_last", _PICK.format(k=1, more=" AND s.last_seq = h.total"), require_last_event=True)
simple(
    "event_pattern_consecutive", _EVENTS_CTE.replace("user_id", "d").replace("FROM events)", "FROM (SELECT *, user_id * 1000 + dayofyear(ts) AS d FROM events))")
    + "SELECT h.event_id FROM hits h JOIN stats s ON h.d = s.d WHERE h.ordinal = 2 AND s.last_seq - s.first_seq + 1 = s.n",
    lambda r: r.with_df(S.event_pattern(r.with_df(r.df.withColumn("d", C("user_id") * 1000 + F.dayofyear("ts"))), ["d"], ["ts"], C("event_type") == "purchase", 2, arrangement="consecutive").df.select("event_id")),
)
pattern("event_pattern_none_adjacent", _PICK.format(k=1, more=_LOOSE), arrangement="none_adjacent")
simple(
    "event_pattern_cohorts",
    _EVENTS_CTE + "SELECT h.event_id, 'packed' AS cohort FROM hits h JOIN stats s ON h.user_id = s.user_id WHERE h.ordinal = 1 AND s.last_seq - s.first_seq + 1 = s.n UNION ALL SELECT h.event_id, 'any' FROM hits h WHERE h.ordinal = 1 UNION ALL SELECT h.event_id, 'none_adjacent' FROM hits h WHERE h.ordinal = 1" + _LOOSE,
    lambda r: r.with_df(S.event_pattern_cohorts(r, _DAY, ["ts"], C("event_type") == "purchase", ["consecutive", "any", "none_adjacent"], {"consecutive": "packed"}, "cohort").df.select("event_id", "cohort")),
)
_FOLLOW = (
    "WITH seqs AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS seq FROM events), "
    "near AS (SELECT a.user_id, a.seq AS from_seq, min(t.seq) AS to_seq FROM seqs a JOIN seqs t ON a.user_id = t.user_id AND t.seq > a.seq AND t.seq <= a.seq + 4 AND t.event_type = 'purchase' WHERE a.event_type = 'click' GROUP BY a.user_id, a.seq) "
    "SELECT t.event_id{more} FROM near n JOIN seqs t ON t.user_id = n.user_id AND t.seq = n.to_seq"
)
simple("follow_event", _FOLLOW.format(more=""), lambda r: r.with_df(S.follow_event(R.project(r, ["event_id", "user_id", "ts", "event_type"]), _DAY, ["ts"], C("event_type") == "click", C("event_type") == "purchase", 4).df.select("event_id")))
_BETWEEN = ", CAST(EXISTS (SELECT 1 FROM seqs b WHERE b.user_id = n.user_id AND b.seq > n.from_seq AND b.seq < n.to_seq AND {p}) AS BIGINT) AS {a}"
simple(
    "follow_event_between", _FOLLOW.format(more=_BETWEEN.format(p="b.event_type = 'view'", a="viewed") + _BETWEEN.format(p="b.value > 40", a="big")),
    lambda r: r.with_df(S.follow_event(r.with_df(r.df.drop("props")), _DAY, ["ts"], C("event_type") == "click", C("event_type") == "purchase", 4, {"viewed": C("event_type") == "view", "big": C("value") > 40}).df.select("event_id", "viewed", "big")),
)

# Usage, signatures, roles, percentiles

_USAGE = "usage AS (SELECT user_id, event_type, count(*) AS pitch_count, CAST(sum(count(*)) OVER (PARTITION BY user_id) AS BIGINT) AS total_pitch_count, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY user_id) AS usage_rate FROM events GROUP BY user_id, event_type)"
_SIGN = "signs AS (SELECT user_id, string_agg(event_type, '|' ORDER BY event_type) AS arsenal FROM usage WHERE usage_rate > {m} GROUP BY user_id)"
simple("usage_rate", f"WITH {_USAGE} SELECT user_id, event_type, pitch_count, total_pitch_count, round(CAST(usage_rate AS DOUBLE), 6) + 0.0 AS usage_rate FROM usage", lambda r: U.usage(r, ["user_id"], "event_type"))
simple("signature", f"WITH {_USAGE}, {_SIGN.format(m=0.2)} SELECT user_id, arsenal FROM signs", lambda r: U.signatures(r, ["user_id"], "event_type", 0.2))
for _m in ("dense_rank", "rank", "row_number"):
    _extra = ", event_type" if _m == "row_number" else ""
    simple(
        f"role_rank_{_m}", f"WITH {_USAGE} SELECT user_id, event_type, pitch_count, {_m}() OVER (PARTITION BY user_id ORDER BY pitch_count DESC{_extra}) AS role_rank FROM usage",
        lambda r, m=_m: (lambda t: t.with_df(t.df.drop("total_pitch_count", "usage_rate")))(U.roles(U.usage(r, ["user_id"], "event_type"), ["user_id"], "pitch_count", "event_type", True, m)),
    )
_RANKED = "ranked AS (SELECT *, {m}() OVER (PARTITION BY user_id ORDER BY pitch_count DESC{extra}) AS role_rank FROM usage WHERE usage_rate >= {u} AND event_type NOT IN ({x}))"
simple(
    "role_select", f"WITH {_USAGE}, {_RANKED.format(m='row_number', extra=', event_type', u=0, x="''")} SELECT e.event_id, r.role_rank FROM events e JOIN ranked r ON e.user_id = r.user_id AND e.event_type = r.event_type WHERE r.role_rank = 2",
    lambda r: R.project(U.role_select(r, U.Ranking(["user_id"], "event_type"), 2), ["event_id", "role_rank"]),
)
simple(
    "role_select_min_usage", f"WITH {_USAGE}, {_RANKED.format(m='dense_rank', extra='', u=0.2, x="'click'")} SELECT e.event_id, r.role_rank FROM events e JOIN ranked r ON e.user_id = r.user_id AND e.event_type = r.event_type WHERE r.role_rank = 1",
    lambda r: R.project(U.role_select(r, U.Ranking(["user_id"], "event_type", min_usage=0.2, exclude=["click"], method="dense_rank"), 1), ["event_id", "role_rank"]),
)
simple(
    "role_annotate", f"WITH {_USAGE}, {_RANKED.format(m='rank', extra='', u=0, x="''")} SELECT e.event_id, r.event_type AS role FROM events e JOIN ranked r ON e.user_id = r.user_id WHERE r.role_rank = 1",
    lambda r: R.project(U.role_annotate(r, U.Ranking(["user_id"], "event_type", method="rank"), 1, "role"), ["event_id", "role"]),
)
simple("arsenal_signature_stage", f"WITH {_USAGE}, {_SIGN.format(m=0.25)} SELECT e.event_id, s.arsenal FROM events e JOIN signs s ON e.user_id = s.user_id", lambda r: R.project(U.add_signature(r, ["user_id"], "event_type", 0.25), ["event_id", "arsenal"]))
simple("percentile_cume", "SELECT event_id, round(cume_dist() OVER (PARTITION BY user_id ORDER BY value NULLS LAST), 6) + 0.0 AS percentile FROM events", lambda r: R.project(U.cumulative_percentile(r, "value", ["user_id"]), ["event_id", "percentile"]))
simple(
    "percentile_mid", "SELECT event_id, round((rank() OVER w - 1 + cume_dist() OVER w * count(*) OVER (PARTITION BY user_id)) / (2.0 * count(*) OVER (PARTITION BY user_id)), 6) + 0.0 AS percentile FROM (SELECT event_id, user_id, floor(value) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY v NULLS LAST)",
    lambda r: R.project(U.mid_percentile(r.with_df(r.df.withColumn("v", F.floor("value"))), "v", ["user_id"]), ["event_id", "percentile"]),
)


@query("percentile_high_filter", PITCHES + "SELECT pitch_uid FROM (SELECT pitch_uid, cume_dist() OVER (PARTITION BY pitcher ORDER BY release_speed NULLS LAST) AS p FROM pitches) WHERE p >= 0.8")
def percentile_high_filter(spark, sf):
    return mode(spark, sf, {"mode": "percentile", "value_field": "release_speed"}).select("pitch_uid")


# Workflows

_BASE = PITCHES + ", games AS (SELECT pitcher, game_pk, count(*) AS row_count, avg(release_speed) AS avg_release_speed FROM pitches GROUP BY pitcher, game_pk) "
_GAMES = {"kind": "aggregate", "group_by": ["pitcher", "game_pk"], "metrics": [{"function": "count"}, {"function": "avg", "field": "release_speed"}]}
_OVER = "OVER (PARTITION BY pitcher ORDER BY game_pk{more})"
_W = {"partition_by": ["pitcher"], "order_by": ["game_pk"]}


def flow(name: str, sql: str, *stages: dict, keep: tuple[str, ...] = ()) -> None:
    def run(spark, sf):
        out = workflow.run(pitches(spark, sf), [_GAMES, *stages])
        return R.project(out, list(dict.fromkeys(["pitcher", "game_pk", *keep])))

    query(name, _BASE + sql)(run)


flow("wf_rolling", f"SELECT pitcher, game_pk, round(avg(avg_release_speed) {_OVER.format(more=' ROWS BETWEEN 2 PRECEDING AND CURRENT ROW')}, 6) + 0.0 AS r FROM games", {"kind": "rolling", "field": "avg_release_speed", "alias": "r", **_W}, keep=("r",))
flow("wf_lag", f"SELECT pitcher, game_pk, round(lag(avg_release_speed, 1) {_OVER.format(more='')}, 6) + 0.0 AS lag_avg_release_speed FROM games", {"kind": "offset", "field": "avg_release_speed", **_W}, keep=("lag_avg_release_speed",))
flow("wf_lead", f"SELECT pitcher, game_pk, lead(row_count, 2) {_OVER.format(more='')} AS later FROM games", {"kind": "lead", "field": "row_count", "offset": 2, "alias": "later", **_W}, keep=("later",))
_UP = "CAST(coalesce({x} {o} lag({x}, 1) {w} AND lag({x}, 1) {w} {o} lag({x}, 2) {w}, false) AS BIGINT)"
flow("wf_trend_up", f"SELECT pitcher, game_pk, {_UP.format(x='avg_release_speed', o='>', w=_OVER.format(more=''))} AS rising FROM games", {"kind": "trend", "field": "avg_release_speed", "alias": "rising", **_W}, keep=("rising",))
flow("wf_trend_down_nonstrict", f"SELECT pitcher, game_pk, {_UP.format(x='row_count', o='<=', w=_OVER.format(more=''))} AS falling FROM games", {"kind": "trend", "field": "row_count", "direction": "down", "strict": False, "alias": "falling", **_W}, keep=("falling",))
for _kind, _down, _n in (("first", "", 1), ("last", " DESC", 1), ("nth", "", 3)):
    flow(f"wf_{_kind}", f"SELECT pitcher, game_pk FROM (SELECT *, row_number() OVER (PARTITION BY pitcher ORDER BY game_pk{_down}) AS n FROM games) WHERE n = {_n}", {"kind": _kind, "n": _n, **_W})
flow("wf_nth_from_end", "SELECT pitcher, game_pk FROM (SELECT *, row_number() OVER (PARTITION BY pitcher ORDER BY game_pk DESC) AS n FROM games) WHERE n = 2", {"kind": "nth", "n": 2, "from_end": True, **_W})
flow("wf_rank_keep", "SELECT pitcher, game_pk, r FROM (SELECT *, rank() OVER (PARTITION BY pitcher ORDER BY row_count DESC) AS r FROM games) WHERE r = 1", {"kind": "rank", "method": "rank", "keep_rank": 1, "alias": "r", "partition_by": ["pitcher"], "order_by": [{"field": "row_count", "descending": True}]}, keep=("r",))
flow("wf_derive", "SELECT pitcher, game_pk, round(avg_release_speed / nullif(row_count - 1, 0), 6) + 0.0 AS d FROM games", {"kind": "derive", "alias": "less", "left": "row_count", "operator": "-", "right_value": 1}, {"kind": "derive", "alias": "d", "left": "avg_release_speed", "right_field": "less"}, keep=("d",))
flow("wf_filter_fields", "SELECT pitcher, game_pk FROM games WHERE row_count > 1 AND avg_release_speed > row_count", {"kind": "filter", "field": "row_count", "op": "gt", "value": "1"}, {"kind": "filter", "field": "avg_release_speed", "op": "gt", "value_field": "row_count"})
flow(
    "wf_full_pipeline",
    f"SELECT pitcher, game_pk, round(nxt, 6) + 0.0 AS nxt FROM (SELECT *, lead(avg_release_speed) {_OVER.format(more='')} AS nxt, {_UP.format(x='row_count', o='>=', w=_OVER.format(more=''))} AS up FROM games) WHERE up = 1 AND nxt > avg_release_speed",
    {"kind": "lead", "field": "avg_release_speed", "alias": "nxt", **_W}, {"kind": "trend", "field": "row_count", "strict": False, "alias": "up", **_W}, {"kind": "filter", "field": "up", "op": "eq", "value": 1}, {"kind": "filter", "field": "nxt", "op": "gt", "value_field": "avg_release_speed"}, keep=("nxt",),
)

# Modes


def mode(spark: SparkSession, sf: str, payload: dict, section: int = 0) -> DataFrame:
    return modes.analyse(pitches(spark, sf), payload)[section].relation.df


def in_mode(name: str, sql: str | None, payload: dict, section: int = 0) -> None:
    query(name, None if sql is None else PITCHES + sql)(lambda s, d: mode(s, d, payload, section))


_MU = _USAGE.replace("user_id", "pitcher").replace("event_type", "pitch_type").replace("FROM events", "FROM pitches")


@query("mode_basic", "SELECT l_returnflag, count(*) AS row_count, round(avg(l_extendedprice), 6) + 0.0 AS avg_l_extendedprice FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_shipdate < '1998-01-01' GROUP BY l_returnflag")
def mode_basic(spark, sf):
    payload = {"filters": [{"field": "l_shipdate", "op": "ge", "value": "1997-01-01"}, {"field": "l_shipdate", "op": "lt", "value": "1998-01-01"}], "group_by": ["l_returnflag"], "metrics": [{"function": "count"}, {"function": "avg", "field": "l_extendedprice"}], "result_sort": [{"field": "avg_l_extendedprice", "descending": True}]}
    return modes.analyse(lineitem(spark, sf), payload)[0].relation


in_mode("mode_sequence_pattern", "SELECT pitch_uid, game_date, game_pk, at_bat_number, pitch_number, pitcher, pitch_type, round(release_speed, 6) + 0.0 AS release_speed FROM (SELECT *, row_number() OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number) AS k FROM pitches WHERE pitch_type = 'click') WHERE k = 2", {"mode": "sequence_pattern", "event": {"field": "pitch_type", "value": "click"}, "occurrence": 2})
query("mode_follow_event", _FOLLOW.format(more=_BETWEEN.format(p="b.value > 40", a="between_1")).replace("a.seq + 4", "a.seq + 3").replace("PARTITION BY user_id ORDER BY ts", "PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts").replace("a.user_id = t.user_id", "a.user_id = t.user_id AND CAST(a.ts AS DATE) = CAST(t.ts AS DATE)").replace("SELECT a.user_id,", "SELECT a.user_id, CAST(a.ts AS DATE) AS d,").replace("GROUP BY a.user_id", "GROUP BY a.user_id, CAST(a.ts AS DATE)").replace("b.user_id = n.user_id", "b.user_id = n.user_id AND CAST(b.ts AS DATE) = n.d").replace("t.user_id = n.user_id", "t.user_id = n.user_id AND CAST(t.ts AS DATE) = n.d"))(
    lambda s, d: mode(s, d, {"mode": "follow_event", "anchor": {"field": "pitch_type", "value": "click"}, "target": {"field": "pitch_type", "value": "purchase"}, "between": [{"field": "release_speed", "op": "gt", "value": 40}]}).select(C("pitch_uid").alias("event_id"), "between_1")
)
in_mode("mode_arsenal", f", {_MU}, {_SIGN.format(m=0.2).replace('user_id', 'pitcher').replace('event_type', 'pitch_type')} SELECT u.pitcher, u.pitch_type, pitch_count, total_pitch_count, round(CAST(usage_rate AS DOUBLE), 6) + 0.0 AS usage_rate, dense_rank() OVER (PARTITION BY u.pitcher ORDER BY usage_rate DESC) AS role_rank, arsenal FROM usage u JOIN signs s ON u.pitcher = s.pitcher", {"mode": "arsenal", "min_usage": 0.2})
in_mode("mode_pitch_role", ", m AS (SELECT pitcher, pitch_type, avg(release_speed) AS v FROM pitches GROUP BY pitcher, pitch_type) SELECT pitcher, pitch_type, round(v, 6) + 0.0 AS metric_value, r AS role_rank FROM (SELECT *, dense_rank() OVER (PARTITION BY pitcher ORDER BY v DESC NULLS LAST) AS r FROM m WHERE pitch_type NOT IN ('view')) WHERE r = 1", {"mode": "pitch_role", "metric_kind": "field_metric", "exclude_pitch_types": ["view"]})
in_mode("mode_temporal", ", g AS (SELECT pitcher, game_pk, avg(release_speed) AS v FROM pitches GROUP BY pitcher, game_pk) SELECT pitcher, game_pk, round(v, 6) + 0.0 AS current_value, round(lag(v) OVER w, 6) + 0.0 AS reference_value, round(v - lag(v) OVER w, 6) + 0.0 AS difference FROM g WINDOW w AS (PARTITION BY pitcher ORDER BY game_pk)", {"mode": "temporal", "value_field": "release_speed"})
in_mode("mode_percentile_low", "SELECT pitch_uid, game_date, game_pk, at_bat_number, pitch_number, pitcher, pitch_type, round(release_speed, 6) + 0.0 AS release_speed, round(p, 6) + 0.0 AS percentile FROM (SELECT *, cume_dist() OVER (PARTITION BY pitcher ORDER BY release_speed NULLS LAST) AS p FROM pitches) WHERE p <= 0.1", {"mode": "percentile", "value_field": "release_speed", "side": "low", "threshold": 0.1})
in_mode("mode_cross_level", ", u AS (SELECT pitcher, game_pk, median(release_speed) AS v FROM pitches GROUP BY pitcher, game_pk), b AS (SELECT pitcher, median(release_speed) AS v FROM pitches GROUP BY pitcher) SELECT u.pitcher, game_pk, round(u.v, 6) + 0.0 AS unit_value, round(b.v, 6) + 0.0 AS baseline_value, round(u.v - b.v, 6) + 0.0 AS difference FROM u JOIN b ON u.pitcher = b.pitcher", {"mode": "cross_level", "value_field": "release_speed", "function": "median"})
_CHANGE = (
    ", a AS (SELECT * FROM pitches WHERE game_date <= '2024-01-15'), b AS (SELECT * FROM pitches WHERE game_date > '2024-01-15'), both_in AS (SELECT pitcher FROM a INTERSECT SELECT pitcher FROM b), "
    "ua AS (SELECT pitcher, pitch_type FROM (SELECT pitcher, pitch_type, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY pitcher) AS r FROM a GROUP BY pitcher, pitch_type) WHERE r > 0.2 AND pitcher IN (SELECT pitcher FROM both_in)), "
    "ub AS (SELECT pitcher, pitch_type FROM (SELECT pitcher, pitch_type, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY pitcher) AS r FROM b GROUP BY pitcher, pitch_type) WHERE r > 0.2 AND pitcher IN (SELECT pitcher FROM both_in)) "
)
_PERIODS = {"mode": "arsenal_change", "min_usage": 0.2, "period_a": {"start": "2000-01-01", "end": "2024-01-15"}, "period_b": {"start": "2024-01-16", "end": "2100-01-01"}}
in_mode("mode_arsenal_change_added", _CHANGE + "SELECT * FROM ub EXCEPT SELECT * FROM ua", _PERIODS, 0)
in_mode("mode_arsenal_change_removed", _CHANGE + "SELECT * FROM ua EXCEPT SELECT * FROM ub", _PERIODS, 1)
in_mode("mode_workflow", ", g AS (SELECT pitcher, count(*) AS row_count FROM pitches GROUP BY pitcher) SELECT pitcher, row_count FROM g ORDER BY row_count DESC, pitcher LIMIT 20", {"mode": "workflow", "limit": 20, "stages": [{"kind": "aggregate", "group_by": ["pitcher"], "metrics": [{"function": "count"}]}], "result_sort": [{"field": "row_count", "descending": True}, {"field": "pitcher"}]})


@query("plan_from_json", "SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) WHERE n >= 10")
def plan_from_json(spark, sf):
    col = lambda n: {"kind": "column", "name": n}
    at_least = lambda n, v: {"kind": "binary", "left": col(n), "op": ">=", "right": {"kind": "literal", "value": v}}
    clicks = {"node": "filter", "input": {"node": "source", "table": "events"}, "predicate": {"kind": "binary", "left": col("event_type"), "op": "=", "right": {"kind": "literal", "value": "click"}}}
    counts = {"node": "aggregate", "input": clicks, "group_by": [{"alias": "user_id", "expr": col("user_id")}], "metrics": [{"alias": "n", "function": "count"}]}
    return spec.build(spec.loads(spec.dumps({"node": "filter", "input": counts, "predicate": at_least("n", 10)})), {"events": events(spark, sf)})


# Numerical


@query("standardize_features", "SELECT event_id, round((value - avg(value) OVER w) / (CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1 END), 6) + 0.0 AS value_z FROM events WINDOW w AS (PARTITION BY user_id)")
def standardize_features(spark, sf):
    from .operators.numeric import features

    return R.project(features.standardised(events(spark, sf), ["value"], ["user_id"]), ["event_id", "value_z"])


@query("partition_complete_counts", "SELECT user_id, count(CASE WHEN nullif(floor(value), 3) IS NOT NULL THEN 1 END) AS complete_rows FROM events GROUP BY user_id")
def partition_complete_counts(spark, sf):
    from .operators.numeric import features

    r = events(spark, sf)
    return features.complete_counts(r.with_df(r.df.withColumn("v", F.nullif(F.floor("value"), L(3)))), ["user_id"], ["v", "value"])


@query("autok_bounds", "SELECT user_id, least(count(*), greatest(5, least(30, CAST(ceil(count(*) * 0.03) AS BIGINT)))) AS least_rows, greatest(1, least(8, count(*) // least(count(*), greatest(5, least(30, CAST(ceil(count(*) * 0.03) AS BIGINT)))))) AS most_k FROM events GROUP BY user_id")
def autok_bounds(spark, sf):
    from .operators.numeric import clustering

    counts = events(spark, sf).df.groupBy("user_id").count()

    def bounds(parts):
        for t in parts:
            found = [clustering.bounds(n) for n in t["count"]]
            yield t.assign(least_rows=[a for a, _ in found], most_k=[b for _, b in found])[["user_id", "least_rows", "most_k"]]

    return counts.mapInPandas(bounds, "user_id long, least_rows long, most_k long")


@query("linreg_simple", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) + 0.0 AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) + 0.0 AS r2 FROM lineitem")
def linreg_simple(spark, sf):
    from .operators.numeric import regression

    out = regression.linear(lineitem(spark, sf), "l_extendedprice", ["l_quantity"])
    beta = out["coefficients"].agg(F.max(F.when(C("term") != "intercept", C("estimate"))).alias("slope"), F.max(F.when(C("term") == "intercept", C("estimate"))).alias("intercept"))
    return beta.crossJoin(out["model summary"].select(C("r_squared").alias("r2"))).select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "r2")


#: Fixed text: least squares of three predictors by Cramer's rule over centred sums; errors from the inverse of their matrix.
_LINREG = (
    "WITH m AS (SELECT avg(l_extendedprice) AS y, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c FROM lineitem), "
    "d AS (SELECT l_extendedprice - m.y AS y, l_quantity - m.a AS a, l_discount - m.b AS b, l_tax - m.c AS c FROM lineitem, m), "
    "s AS (SELECT count(*) AS n, sum(y * y) AS yy, sum(a * y) AS ay, sum(b * y) AS by_, sum(c * y) AS cy, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc FROM d), "
    "i AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s), "
    "k AS (SELECT *, (bb * cc - bc * bc) / det AS iaa, (ac * bc - ab * cc) / det AS iab, (ab * bc - ac * bb) / det AS iac, (aa * cc - ac * ac) / det AS ibb, (ab * ac - aa * bc) / det AS ibc, (aa * bb - ab * ab) / det AS icc FROM i), "
    "w AS (SELECT *, iaa * ay + iab * by_ + iac * cy AS wa, iab * ay + ibb * by_ + ibc * cy AS wb, iac * ay + ibc * by_ + icc * cy AS wc FROM k), "
    "e AS (SELECT w.*, (yy - wa * ay - wb * by_ - wc * cy) / (n - 4) AS v FROM w), "
    "t AS (SELECT 'intercept' AS term, m.y - wa * m.a - wb * m.b - wc * m.c AS estimate, sqrt(v * (1.0 / n + m.a * m.a * iaa + m.b * m.b * ibb + m.c * m.c * icc + 2 * (m.a * m.b * iab + m.a * m.c * iac + m.b * m.c * ibc))) AS std_error FROM e, m "
    "UNION ALL SELECT 'l_quantity', wa, sqrt(v * iaa) FROM e UNION ALL SELECT 'l_discount', wb, sqrt(v * ibb) FROM e UNION ALL SELECT 'l_tax', wc, sqrt(v * icc) FROM e) "
    "SELECT term, round(estimate, 3) + 0.0 AS estimate, round(std_error, 3) + 0.0 AS std_error, round(estimate / std_error, 3) + 0.0 AS statistic FROM t"
)


@query("linreg_multi", _LINREG)
def linreg_multi(spark, sf):
    from .operators.numeric import regression

    out = regression.linear(lineitem(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])["coefficients"]
    return out.select("term", *[F.round(c, 3).alias(c) for c in ("estimate", "std_error", "statistic")])


_RETURNS = ("l_quantity", "l_discount")


@query("logreg", "SELECT unnest(['intercept', 'l_quantity', 'l_discount']) AS term, 0.0::DOUBLE AS score_residual, (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS n_positive")
def logreg(spark, sf):
    """The fitted terms, held against what makes them the fit: the derivatives of the penalised likelihood are zero there, to five places a row."""
    from .operators.numeric import regression

    r = lineitem(spark, sf)
    r = r.with_df(r.df.withColumn("returned", (C("l_returnflag") == "R").cast("int")))
    beta = regression.logistic(r, "returned", list(_RETURNS))["coefficients"]
    wide = beta.agg(*[F.max(F.when(C("term") == t, C("estimate"))).alias(f"b_{t}") for t in ("intercept", *_RETURNS)])
    z = sum((C(f"b_{t}") * C(t) for t in _RETURNS), C("b_intercept"))
    off = C("returned") - 1 / (1 + F.exp(-z))
    rows = r.df.select("returned", *_RETURNS).crossJoin(F.broadcast(wide))  # one row
    found = rows.agg(
        F.avg(off).alias("s_intercept"), *[(F.avg(off * C(t)) - F.first(f"b_{t}") / F.count(L(1))).alias(f"s_{t}") for t in _RETURNS], F.count(L(1)).alias("n_rows"), F.sum("returned").alias("n_positive"),
    )
    out = F.explode(F.array(*[F.struct(L(t).alias("term"), (F.round(f"s_{t}", 5) + 0.0).alias("score_residual")) for t in ("intercept", *_RETURNS)]))
    return found.select(out.alias("x"), "n_rows", "n_positive").select("x.term", "x.score_residual", "n_rows", C("n_positive").cast("long").alias("n_positive"))


# Clusters are what numpy finds: SQL can say what holds of them, whichever they are.

_CLUSTERED = "SELECT event_type, count(*) AS n_rows, CAST(3 AS BIGINT) AS n_clusters, round(sum(value), 4) + 0.0 AS total, 0.0::DOUBLE AS off_center, true AS ordered, true AS apart FROM events GROUP BY event_type"
for _method in ("kmeans", "gmm"):
    @query(f"{_method}_partitioned", _CLUSTERED if _method == "kmeans" else _CLUSTERED.replace(", 0.0::DOUBLE AS off_center", "").replace(", true AS apart", ", true AS sure"))
    def clustered(spark, sf, m=_method):
        """Clusters of each type: together they hold all rows, a k-means center is its rows' mean, they are numbered by their centers, and k-means clusters
        lie apart; a mixture's rows are at least as sure of their cluster as chance."""
        from .operators.numeric import modes as numeric

        found = numeric.clustered(events(spark, sf), {"features": ["value"], "partition_fields": ["event_type"], "method": m, "clusters": 3})  # all assignments, not a section's first
        clusters = found["cluster summary"].df
        own = F.row_number().over(Window.partitionBy("event_type").orderBy("center_value")) - 1
        by = clusters.withColumn("place", own).groupBy("event_type").agg(
            F.sum("sample_size").alias("n_rows"), F.count(L(1)).alias("n_clusters"), F.round(F.sum(C("sample_size") * C("mean_value")), 4).alias("total"), F.round(F.max(F.abs(C("center_value") - C("mean_value"))), 4).alias("off_center"),
            F.min(C("place") == C("cluster")).alias("ordered"),
        )
        rows = found["cluster assignments"].df
        if m == "gmm":
            return by.drop("off_center").join(rows.groupBy("event_type").agg((F.min("cluster_probability") > 0.33).alias("sure")), "event_type")
        edges = rows.groupBy("event_type", "cluster").agg(F.min("value").alias("low"), F.max("value").alias("high"))
        before = F.lag("high").over(Window.partitionBy("event_type").orderBy("cluster"))
        apart = edges.withColumn("before", before).groupBy("event_type").agg(F.min(F.coalesce(C("before") < C("low"), L(True))).alias("apart"))
        return by.join(apart, "event_type")


@query(
    "autok_diagnostics",
    "WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, least(8, n // least(n, greatest(5, least(30, CAST(ceil(n * 0.03) AS BIGINT))))) AS tried, CAST(1 AS BIGINT) AS selected, true AS least_valid_bic, true AS valid_by_size FROM n",
)
def autok_diagnostics(spark, sf):
    """The numbers of clusters that were tried for each type: one is selected, the valid one with the least BIC; one is valid that has no tiny cluster."""
    found = modes.analyse(events(spark, sf), {"mode": "clustering", "features": ["value"], "partition_fields": ["event_type"], "clusters": 0})
    n = events(spark, sf).df.groupBy("event_type").agg(F.count(L(1)).alias("n"))
    least = F.least(C("n"), F.greatest(L(5), F.least(L(30), F.ceil(C("n") * 0.03))))
    d = found[1].relation.df.join(n, "event_type").withColumn("best", F.min(F.when(C("valid"), C("bic"))).over(Window.partitionBy("event_type")))
    return d.groupBy("event_type").agg(
        F.count(L(1)).alias("tried"), F.count(F.when(C("selected"), 1)).alias("selected"), F.max(C("selected") & C("valid") & (C("bic") == C("best"))).alias("least_valid_bic"),
        F.min(C("valid") == ((C("k") == 1) | (C("smallest_cluster") >= least))).alias("valid_by_size"),
    )


@query("bootstrap_ci", "SELECT round(avg(value), 6) + 0.0 AS estimate, count(*) AS usable_rows, count(DISTINCT user_id) AS units, true AS brackets, true AS near_theory FROM events")
def bootstrap_ci(spark, sf):
    """The estimate and its interval; the interval's width is that of the mean of so many units, to a quarter, as the units' own scatter gives it."""
    r = events(spark, sf)
    out = modes.analyse(r, {"mode": "bootstrap", "value_field": "value", "resample_unit_fields": ["user_id"], "iterations": 500})[0].relation.df
    units = r.df.groupBy("user_id").agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    whole = units.agg((F.sum("s") / F.sum("c")).alias("mean"))
    off = units.crossJoin(F.broadcast(whole)).agg((F.sqrt(F.sum(F.pow(C("s") - C("mean") * C("c"), 2))) / F.sum("c")).alias("error"))  # one row each
    row = out.crossJoin(F.broadcast(off))
    return row.select("estimate", "usable_rows", C("resample_units").alias("units"), ((C("ci_lower") < C("estimate")) & (C("estimate") < C("ci_upper"))).alias("brackets"), F.abs((C("ci_upper") - C("ci_lower")) / (2 * 1.96 * C("error")) - 1).between(0, 0.25).alias("near_theory"))


@query(
    "cluster_compare",
    "WITH u AS (SELECT user_id AS pitcher, event_type AS pitch_type, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY user_id) AS usage FROM events GROUP BY user_id, event_type), "
    "signs AS (SELECT pitcher, string_agg(pitch_type, '|' ORDER BY pitch_type) AS arsenal FROM u WHERE usage > 0.15 GROUP BY pitcher), "
    "m AS (SELECT s.arsenal, u.pitch_type, avg(e.value) AS metric FROM u JOIN signs s ON u.pitcher = s.pitcher JOIN events e ON e.user_id = u.pitcher AND e.event_type = u.pitch_type WHERE u.usage > 0.15 AND u.pitch_type <> 'click' GROUP BY s.arsenal, u.pitch_type), "
    "best AS (SELECT arsenal, pitch_type FROM (SELECT *, row_number() OVER (PARTITION BY arsenal ORDER BY metric, pitch_type) AS n FROM m) WHERE n = 1), "
    "mine AS (SELECT s.pitcher, s.arsenal, b.pitch_type, (SELECT count(*) FROM events e WHERE e.user_id = s.pitcher AND e.event_type = b.pitch_type) AS n FROM signs s JOIN best b ON s.arsenal = b.arsenal), "
    "ref AS (SELECT user_id AS pitcher, count(*) AS reference_sample_size, round(avg(value), 6) + 0.0 AS reference_value FROM events WHERE event_type = 'click' GROUP BY user_id) "
    "SELECT mine.pitcher, arsenal, pitch_type AS candidate_pitch_type, reference_sample_size, reference_value, true AS some_rows, true AS best_is_low, true AS differs FROM mine LEFT JOIN ref ON mine.pitcher = ref.pitcher WHERE n >= 2",
)
def cluster_compare(spark, sf):
    """Which category each entity is compared by and against what is SQL's; of the best cluster it holds that it has some of the category's rows and that
    its mean isn't above theirs."""
    out = mode(spark, sf, {"mode": "cluster_compare", "reference_pitch_type": "click", "features": ["release_speed"], "clusters": 2, "min_usage": 0.15})
    whole = pitches(spark, sf).df.groupBy("pitcher", C("pitch_type").alias("candidate_pitch_type")).agg(F.count(L(1)).alias("n"), F.avg("release_speed").alias("mean"))
    out = out.join(whole, ["pitcher", "candidate_pitch_type"])
    return out.select(
        "pitcher", "arsenal", "candidate_pitch_type", "reference_sample_size", "reference_value", C("candidate_sample_size").between(1, C("n")).alias("some_rows"), (C("candidate_value") <= C("mean") + 1e-9).alias("best_is_low"),
        F.coalesce(F.abs(C("difference") - (C("candidate_value") - C("reference_value"))) < 1e-9, C("reference_value").isNull()).alias("differs"),
    )


@query("bootstrap_point_estimate", "SELECT round(sum(CASE WHEN event_type = 'click' THEN value END) / count(CASE WHEN event_type = 'click' THEN 1 END) - sum(CASE WHEN event_type = 'view' THEN value END) / count(CASE WHEN event_type = 'view' THEN 1 END), 6) + 0.0 AS estimate, count(*) AS usable_rows FROM events WHERE event_type IN ('click', 'view')")
def bootstrap_point_estimate(spark, sf):
    from .operators.numeric import bootstrap

    return bootstrap.point(events(spark, sf), bootstrap.Bootstrap("value", ["user_id"], "mean", "event_type", "click", "view"))


# Ingestion

_RAW = "(SELECT CAST(l_orderkey AS VARCHAR) AS game_pk, CASE WHEN l_linenumber = 3 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS at_bat_number, CAST(l_partkey AS VARCHAR) AS pitch_number, CAST(l_suppkey AS VARCHAR) || '.7' AS pitcher, CASE WHEN l_quantity > 40 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5' END AS release_speed FROM lineitem)"


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    r = lineitem(spark, sf).df
    text = lambda c: C(c).cast("string")
    return r.select(text("l_orderkey").alias("game_pk"), F.when(C("l_linenumber") == 3, "").otherwise(text("l_linenumber")).alias("at_bat_number"), text("l_partkey").alias("pitch_number"), F.concat(text("l_suppkey"), L(".7")).alias("pitcher"), F.when(C("l_quantity") > 40, "n/a").otherwise(F.concat(C("l_quantity").cast("long").cast("string"), L(".5"))).alias("release_speed"))


@query("ingest_typed_parse", f"SELECT CAST(game_pk AS BIGINT) AS game_pk, TRY_CAST(nullif(at_bat_number, '') AS BIGINT) AS at_bat_number, CAST(trunc(CAST(pitcher AS DOUBLE)) AS BIGINT) AS pitcher, TRY_CAST(release_speed AS DOUBLE) AS release_speed FROM {_RAW}")
def ingest_typed_parse(spark, sf):
    return ingest.typed(raw_lines(spark, sf), "s1").select("game_pk", "at_bat_number", "pitcher", "release_speed")


@query("ingest_fallback_uid", f"SELECT CASE WHEN at_bat_number <> '' THEN game_pk || ':' || at_bat_number || ':' || pitch_number ELSE 'fallback:' || sha256('|' || game_pk || '|||' || pitcher || '||' || at_bat_number || '|' || pitch_number || '|') END AS pitch_uid FROM {_RAW}")
def ingest_fallback_uid(spark, sf):
    return ingest.typed(raw_lines(spark, sf), "s1").select("pitch_uid")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders", ("o_orderkey",)).df.select(C("o_orderkey").cast("string").alias("pitch_uid"), "o_orderkey", C("o_orderstatus").alias("_row_hash"), C("o_totalprice").alias("price"), C("o_orderpriority").alias("zone"))


@query("ingest_merge_upsert", "SELECT CAST(o_orderkey AS VARCHAR) AS pitch_uid, CASE WHEN o_orderkey % 3 = 0 THEN 'inserted' WHEN o_orderkey % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS fate FROM orders WHERE o_orderkey % 2 = 0")
def ingest_merge_upsert(spark, sf):
    o = _orders(spark, sf).select("pitch_uid", "o_orderkey", "_row_hash")
    stored = o.filter("o_orderkey % 3 <> 0").drop("o_orderkey")
    coming = o.filter("o_orderkey % 2 = 0").withColumn("_row_hash", F.when(C("o_orderkey") % 5 == 0, "changed").otherwise(C("_row_hash"))).drop("o_orderkey")
    return ingest.merge(stored, coming).filter("_fate is not null").select("pitch_uid", C("_fate").alias("fate"))


@query(
    "ingest_merge_table",
    "SELECT CAST(o_orderkey AS VARCHAR) AS pitch_uid, CASE WHEN o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) THEN CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice + 2, 2) + 0.0 END ELSE round(o_totalprice, 2) + 0.0 END AS price, "
    "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS zone, CASE WHEN o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) THEN CAST(2 AS BIGINT) ELSE 0 END AS turn FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0",
)
def ingest_merge_table(spark, sf):
    """The table after a delivery of which each identity comes twice and the last counts; it brings a price (null for some) and a new column, and no zone."""
    o = _orders(spark, sf)
    stored = o.filter("o_orderkey % 3 <> 0").drop("o_orderkey")
    coming = o.filter("o_orderkey % 2 = 0").withColumn("turn", F.explode(F.array(L(2), L(1))))
    coming = coming.select("pitch_uid", F.when((C("o_orderkey") % 5 == 0) | (C("turn") == 1), "changed").otherwise(C("_row_hash")).alias("_row_hash"), F.when(C("o_orderkey") % 4 != 0, F.round(C("price") + C("turn"), 2)).alias("price"), "turn", C("turn").alias("_position"))
    return ingest.merge(stored, coming).select("pitch_uid", F.round("price", 2).alias("price"), "zone", F.coalesce("turn", L(0)).alias("turn"))


@query("mirror_refresh", "SELECT CAST(o_orderkey AS VARCHAR) AS pitch_uid, round(CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 2) + 0.0 AS price FROM orders")
def mirror_refresh(spark, sf):
    o = _orders(spark, sf)
    copy = o.filter("o_orderkey % 8 <> 0").select("pitch_uid", "price")
    return ingest.refresh(copy, o.filter("o_orderkey % 4 = 0").select("pitch_uid", (C("price") + 1).alias("price"))).select("pitch_uid", F.round("price", 2).alias("price"))


@query("verify_report", f"WITH r AS {_RAW}, u AS (SELECT *, CASE WHEN at_bat_number <> '' THEN game_pk || ':' || at_bat_number || ':' || pitch_number ELSE 'fallback:' || game_pk || pitcher || pitch_number END AS uid FROM r) SELECT count(*) AS pitch_rows, count(DISTINCT game_pk) AS games, count(CASE WHEN at_bat_number = '' THEN 1 END) AS missing_natural_key, count(CASE WHEN at_bat_number = '' THEN 1 END) AS missing_at_bat_number, (SELECT count(*) FROM (SELECT uid FROM u GROUP BY uid HAVING count(*) > 1)) AS duplicate_pitch_uid FROM u")
def verify_report(spark, sf):
    return ingest.verify(ingest.typed(raw_lines(spark, sf), "s1")).select("pitch_rows", "games", "missing_natural_key", "missing_at_bat_number", "duplicate_pitch_uid")


@query("supplemental_verify", "SELECT o_orderstatus AS dataset, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities, (SELECT count(*) FROM (SELECT 1 FROM orders x WHERE x.o_orderstatus = o.o_orderstatus GROUP BY o_orderkey % 1000 HAVING count(*) > 1)) AS duplicate_keys FROM orders o GROUP BY o_orderstatus")
def supplemental_verify(spark, sf):
    from .sources import supplemental

    rows = table(spark, sf, "orders", ("o_orderkey",)).df.select(C("o_orderstatus").alias("dataset"), C("o_custkey").cast("string").alias("entity"), (C("o_orderkey") % 1000).cast("string").alias("row_key"))
    return supplemental.verify(rows)


@query("supplemental_failed", "SELECT event_type AS dataset, CAST(user_id AS VARCHAR) AS entity, 'failed' AS status FROM events GROUP BY event_type, user_id HAVING max_by(value > 50, event_id)")
def supplemental_failed(spark, sf):
    from .sources import supplemental

    units = events(spark, sf).df.select(C("event_id").alias("unit_id"), C("event_type").alias("dataset"), C("user_id").cast("string").alias("entity"), F.when(C("value") > 50, "failed").otherwise("done").alias("status"))
    return supplemental.failed_units(units)


query("chunk_ranges", "SELECT CAST(i AS BIGINT) AS chunk, DATE '2024-01-01' + CAST(i * 5 AS INTEGER) AS start_date, least(DATE '2024-01-01' + CAST(i * 5 + 4 AS INTEGER), DATE '2024-01-31') AS end_date FROM range(7) t(i)")(lambda s, d: ingest.chunks(s, "2024-01-01", "2024-01-31", 5))
simple("sample_every_nth", "WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS c FROM events) SELECT event_id FROM n WHERE p IN (SELECT (i * c) // 700 FROM range(700) t(i), (SELECT count(*) AS c FROM events))", lambda r: R.project(sampling.sample(R.project(r, ["event_id"]), ["event_id"], "manual", 700), ["event_id"]))
