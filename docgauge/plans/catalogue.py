"""The engine's queries over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgauge.functions import geometry as G
from docgauge.functions import parsers as P
from docgauge.functions import text as T
from docgauge.operators import evaluation, matching, ordering, prep, scoring
from docgauge.plans.fixtures import SQL as FIX
from docgauge.plans.fixtures import TYPES, blocks, greedy_sql, iou_sql, pages, spread, squared, table
from docgauge.sources import readers

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(x):
    return F.round(x, 6)


_SQL_NORM = r"trim(regexp_replace(text, '[\s\x1c-\x1f]+', ' ', 'g'))"


def _sql_cer(source: str) -> str:
    """`source` with columns g and p, and their error rate cer. DuckDB's distance is one of bytes, so each row's own characters (127 at most) become single bytes first."""
    return f"""SELECT *, CASE WHEN length(g) = 0 THEN 0.0 ELSE levenshtein(translate(p, known, marks), translate(g, known, marks))::DOUBLE / length(g) END AS cer FROM (
  SELECT *, list_aggregate(list_distinct(list_transform(range(1, length(g || p) + 1), lambda i : substr(g || p, i, 1))), 'string_agg', '') AS known FROM ({source})),
  (SELECT string_agg(chr(CAST(i AS INTEGER)), '' ORDER BY i) AS marks FROM range(1, 128) r(i))"""


@query(f"""SELECT role, round(avg(cer), 6) AS mean_cer, count(*) AS n FROM ({_sql_cer(f"SELECT role, translate(t, 'el', 'c1') AS p, t AS g FROM (SELECT role, {_SQL_NORM} AS t FROM conversations)")}) GROUP BY role""")
def cer_normalized(spark, d):
    c = spread(table(spark, d, "conversations"), squared("text"))
    return c.select("role", T.cer_normalized(F.translate("text", "el", "c1"), "text").alias("cer")).groupBy("role").agg(r6(F.avg("cer")).alias("mean_cer"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT conv_id, turn, round(cer, 6) AS cer FROM ({_sql_cer("SELECT conv_id, turn, text AS g, translate(text, 'el', 'c1') AS p FROM conversations")})""")
def cer_by_turn(spark, d):
    return spread(table(spark, d, "conversations"), squared("text")).select("conv_id", "turn", r6(T.cer(F.translate("text", "el", "c1"), "text")).alias("cer"))


@query("""SELECT pred, gt, CASE WHEN gt = '' THEN CASE WHEN pred <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE levenshtein(pred, gt)::DOUBLE / length(gt) END AS cer
FROM (SELECT r.r_name AS gt, '' AS pred FROM region r UNION ALL SELECT '', r_name FROM region UNION ALL SELECT '', '' UNION ALL SELECT 'abc', 'abc' UNION ALL SELECT 'b', 'aaaa') x""")
def cer_empty_rules(spark, d):
    r = table(spark, d, "region")
    rows = r.select(F.col("r_name").alias("gt"), F.lit("").alias("pred")).unionByName(r.select(F.lit("").alias("gt"), F.col("r_name").alias("pred")))
    rows = rows.unionByName(spark.createDataFrame([("", ""), ("abc", "abc"), ("b", "aaaa")], "gt string, pred string"))
    return rows.select("pred", "gt", T.cer("pred", "gt").alias("cer"))


_SQL_WORDS = r"list_filter(regexp_split_to_array({}, '[\s\x1c-\x1f]+'), lambda w : w <> '')"


#: The distance of two word lists, a row of the table at a step: with t the least over a cell's upper neighbours, a cell is j + min(t - j) over the cells up to it.
@query(rf"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS k, conv_id, turn, {_SQL_WORDS.format('text')} AS g, {_SQL_WORDS.format("translate(text, 'el', 'c1')")} AS p FROM conversations),
gw AS (SELECT k, CAST(generate_subscripts(g, 1) AS INTEGER) AS i, unnest(g) AS x FROM w),
pw AS (SELECT k, 0 AS j, CAST(NULL AS VARCHAR) AS y FROM w UNION ALL SELECT k, CAST(generate_subscripts(p, 1) AS INTEGER), unnest(p) FROM w),
st AS (SELECT k, 0 AS i, j, j AS d FROM pw
  UNION ALL
  SELECT k, i, j, CAST(j + min(t - j) OVER (PARTITION BY k ORDER BY j ROWS UNBOUNDED PRECEDING) AS INTEGER) FROM (
    SELECT s.k, s.i + 1 AS i, s.j, CASE WHEN s.j = 0 THEN s.i + 1 ELSE least(s.d + 1, lag(s.d) OVER (PARTITION BY s.k ORDER BY s.j) + CASE WHEN pw.y = gw.x THEN 0 ELSE 1 END) END AS t
    FROM st s JOIN gw ON gw.k = s.k AND gw.i = s.i + 1 JOIN pw ON pw.k = s.k AND pw.j = s.j)),
e AS (SELECT st.k, d FROM st JOIN w ON w.k = st.k AND st.i = len(w.g) AND st.j = len(w.p))
SELECT conv_id, turn, round(CASE WHEN len(g) = 0 THEN 0.0 ELSE d::DOUBLE / len(g) END, 6) AS wer FROM w JOIN e ON e.k = w.k""")
def wer_normalized(spark, d):
    c = spread(table(spark, d, "conversations"), squared("text") / 4)  # a word and a space take two characters at least
    return c.select("conv_id", "turn", r6(T.wer_normalized(F.translate("text", "el", "c1"), "text")).alias("wer"))


@query(rf"SELECT doc_id, {_SQL_NORM} AS t, len(list_filter(regexp_split_to_array(text, '[\s\x1c-\x1f]+'), lambda w : w <> '')) AS n_words FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_text("text").alias("t"), T.word_count("text").cast("long").alias("n_words"))


@query("""WITH t AS (SELECT DISTINCT ON (k) k, v FROM (SELECT CASE WHEN page_id % 3 = 0 THEN regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') ELSE regexp_extract(url, '[^/]*$') END AS k, page_id AS v FROM pages) ORDER BY k, v DESC),
s AS (SELECT regexp_replace(k, '(.)\\.[^.]*$', '\\1') AS st, max(v) AS v FROM t GROUP BY 1),
p AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS name, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem FROM pages)
SELECT p.page_id, coalesce(a.v, s.v) AS v FROM p LEFT JOIN t a ON p.name = a.k LEFT JOIN s ON p.stem = s.st WHERE coalesce(a.v, s.v) IS NOT NULL""")
def eval_join_name_or_stem(spark, d):
    p = table(spark, d, "pages").select(F.col("url").alias("image"), "page_id")
    truth = p.select(F.when(F.col("page_id") % 3 == 0, T.stem("image")).otherwise(T.file_name("image")).alias("image"), F.col("page_id").alias("v"), F.col("page_id").alias("seq"))
    return scoring.with_truth(p, truth, seq="seq").select("page_id", "v")


@query("""SELECT d.doc_id, coalesce(l.quality, -1) AS quality, round(CASE WHEN l.doc_id IS NULL OR d.lang IS NULL THEN 1.0 ELSE levenshtein(coalesce(d.source, ''), d.lang)::DOUBLE / length(d.lang) END, 6) AS cer
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def eval_missing_gt_empty(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("image"), F.coalesce("source", F.lit("")).alias("text"), "lang")
    truth = docs.join(table(spark, d, "labels"), "doc_id").select("image", F.col("lang").alias("text"), "quality")
    scored = scoring.with_truth(docs.select("doc_id", "image", "text"), truth, "empty")
    return scored.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), r6(T.cer("text", F.coalesce("gt_text", F.lit("")))).alias("cer"))


@query("""SELECT count(*) AS n, round(avg(quality), 6) AS mean_quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text <> ''""")
def eval_missing_gt_skip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("image"), "text")
    truth = docs.join(table(spark, d, "labels"), "doc_id").select("image", "text", "quality")
    return scoring.with_truth(docs.select("image"), truth, "text").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("quality")).alias("mean_quality"))


@query("""SELECT event_type, round(avg(value), 6) AS latency_avg, round(coalesce(stddev_samp(value), 0.0), 6) AS latency_std, round(coalesce(max(value), 0.0), 6) AS latency_max,
round(CASE WHEN avg(value) > 0 THEN 60 / avg(value) ELSE 0.0 END, 6) AS throughput_ppm, count(*) AS n FROM events GROUP BY event_type""")
def latency_summary(spark, d):
    s = scoring.latency_summary(table(spark, d, "events"), ["event_type"], "value")
    return s.select("event_type", *[r6(c).alias(c) for c in ("latency_avg", "latency_std", "latency_max", "throughput_ppm")], "n")


@query("""SELECT event_type, round(avg(v), 6) AS stage_avg FROM (SELECT event_type, user_id, arg_max(value, event_id) AS v FROM events GROUP BY event_type, user_id) GROUP BY event_type""")
def stage_latency_last_image(spark, d):
    return scoring.stage_latency(table(spark, d, "events"), ["event_type"], "user_id", "event_id", "value", last_only=True).select("event_type", r6("stage_avg").alias("stage_avg"))


@query("SELECT r_name, CAST(k AS INTEGER) AS run FROM region CROSS JOIN range(5) t(k)")
def runs_x_images(spark, d):
    from docgauge.operators.connectors import repeated

    return repeated(table(spark, d, "region").select("r_name"), 5)


@query(f"WITH {FIX} SELECT page, i, c1, c2, c3, c4 FROM pr")
def bbox_normalize(spark, d):
    p = pages(spark, d).select("page", F.posexplode(G.corners("pred")).alias("i", "c"))
    return p.select("page", "i", *[F.col("c")[k].alias(f"c{k + 1}") for k in range(4)])


@query(f"""WITH {FIX} SELECT page, g, CAST(trunc(g1 / 999.0::DOUBLE * 1000) AS DOUBLE) AS b1, CAST(trunc(g2 / 999.0::DOUBLE * 700) AS DOUBLE) AS b2, CAST(trunc(g3 / 999.0::DOUBLE * 1000) AS DOUBLE) AS b3, CAST(trunc(g4 / 999.0::DOUBLE * 700) AS DOUBLE) AS b4,
CAST(CAST(trunc((-g1 / 512) * 333) AS BIGINT) AS DOUBLE) AS l1, CAST(trunc((g3 / 512) * 333) AS DOUBLE) AS l3 FROM gt""")
def bbox_scale_trunc(spark, d):
    g = F.col("gt")
    b = G.bins(g[0], g[1], g[2], g[3], F.lit(1000), F.lit(700))
    s = G.scaled_ltrb(-g[0] / 512, g[1] / 512, g[2] / 512, g[3] / 512, F.lit(333), F.lit(333))
    return blocks(spark, d).select("page", F.col("b").alias("g"), *[b[k].alias(f"b{k + 1}") for k in range(4)], s[0].alias("l1"), s[2].alias("l3"))


@query(f"""WITH {FIX} SELECT page, g, list_min([g3, g1 + 0.5, g1, g3]) AS q1, list_min([g2, g2, g4, g4 + 0.25]) AS q2, list_max([g3, g1 + 0.5, g1, g3]) AS q3, trunc(list_max([g2, g2, g4, g4 + 0.25])) AS q4 FROM gt""")
def quad_to_bbox(spark, d):
    g = F.col("gt")
    q = G.flat_quad(F.array(g[2], g[1], g[0] + 0.5, g[1], g[0], g[3], g[2], g[3] + 0.25))
    n = G.nested_quad(F.array(F.array(g[2], g[1]), F.array(g[0] + 0.5, g[1]), F.array(g[0], g[3]), F.array(g[2], g[3] + 0.25)))
    both = F.when(q == n, q)
    return blocks(spark, d).select("page", F.col("b").alias("g"), *[both[k].alias(f"q{k + 1}") for k in range(4)])


@query(f"""WITH {FIX} SELECT page, g, CASE WHEN l_partkey % 5 = 0 THEN 0.0 ELSE g1 END::DOUBLE AS x1, CASE WHEN l_partkey % 5 = 0 THEN 0.0 ELSE g4 END::DOUBLE AS y2 FROM gt""")
def bbox_parse_string(spark, d):
    g = F.transform("gt", lambda x: (x + 0.5).cast("string"))
    text = F.concat(F.lit("["), F.array_join(g, ", "), F.when(F.col("l_partkey") % 5 == 0, ", x").otherwise(""), F.lit("]"))
    b = G.parse_box(text)
    return blocks(spark, d).select("page", F.col("b").alias("g"), b[0].alias("x1"), b[3].alias("y2"))


@query(f"WITH {FIX} SELECT page, i, g, round(iou, 9) AS iou FROM (SELECT pr.page, pr.i, gt.g, {iou_sql('pr', 'gt')} AS iou FROM pr JOIN gt ON pr.page = gt.page) WHERE iou > 0")
def pairwise_iou(spark, d):
    p = pages(spark, d).select("page", F.explode(matching.overlapping(G.corners("pred"), "gt")).alias("m"))
    return p.select("page", F.col("m.p").alias("i"), "m.g", F.round("m.iou", 9).alias("iou"))


@query(f"WITH RECURSIVE {FIX}, {greedy_sql('pr', 'gt', 'iou >= 0.1')} SELECT page, i AS p, g, round(iou, 6) AS iou FROM m")
def block_match_greedy(spark, d):
    p = pages(spark, d).select("page", G.corners("pred").alias("pred"), "gt")
    return matching.matched(p, "pred", "gt").select("page", "p", "g", r6("iou").alias("iou"))


_PAGE_SQL = f"""WITH RECURSIVE {FIX}, {greedy_sql('pr', 'gt', 'iou >= 0.1')},
s AS (SELECT page, count(*) AS matched, avg(iou) AS mean_iou FROM m GROUP BY page), tg AS (SELECT page, count(*) AS n FROM gt GROUP BY page), tp AS (SELECT page, count(*) AS n FROM pr GROUP BY page),
a AS (SELECT tg.page, coalesce(s.mean_iou, 0.0) AS mean_iou, coalesce(s.matched, 0) AS matched, tg.n AS total_gt, coalesce(tp.n, 0) AS total_pred, coalesce(s.matched, 0)::DOUBLE / tg.n AS recall, CASE WHEN coalesce(tp.n, 0) > 0 THEN coalesce(s.matched, 0)::DOUBLE / tp.n ELSE 0.0 END AS prec
  FROM tg LEFT JOIN s ON s.page = tg.page LEFT JOIN tp ON tp.page = tg.page)"""


@query(_PAGE_SQL + ' SELECT page, round(mean_iou, 6) AS mean_iou, CAST(matched AS INTEGER) AS matched, CAST(total_gt AS INTEGER) AS total_gt, CAST(total_pred AS INTEGER) AS total_pred, round(recall, 6) AS recall, round(prec, 6) AS "precision" FROM a')
def block_iou_page_metrics(spark, d):
    p, g = F.col("p"), F.col("gt")
    m = pages(spark, d).select("page", G.corners("pred").alias("p"), "gt").select("page", scoring.block_metrics(matching.greedy(p, g), F.size(g), F.size(p)).alias("b")).select("page", "b.*")
    return m.select("page", r6("mean_iou").alias("mean_iou"), "matched", "total_gt", "total_pred", r6("recall").alias("recall"), r6("precision").alias("precision"))


_ERR = "['capitalization', 'spelling', 'grammar', 'punctuation', 'structural', 'unknown'][CAST({} % 6 + 1 AS INTEGER)]"


def _errors(p):
    kind = lambda k: F.element_at(F.array(*[F.lit(t) for t in TYPES]), (k % 6 + 1).cast("int"))
    gt = F.transform("rows", lambda r: F.struct(kind(r["l_suppkey"]).alias("type"), r["gt"].alias("bbox")))
    pred = F.transform(F.filter("rows", lambda r: r["pred"].isNotNull()), lambda r: F.struct(kind(r["l_suppkey"]).alias("type"), r["pred"].alias("bbox")))
    return p.select("page", pred.alias("pred"), gt.alias("gt"))


@query(f"""WITH RECURSIVE {FIX},
ep AS (SELECT page * 10 + l_suppkey % 6 AS page, CAST(row_number() OVER (PARTITION BY page, l_suppkey % 6 ORDER BY b) - 1 AS INTEGER) AS i, r1 AS c1, r2 AS c2, r3 AS c3, r4 AS c4 FROM raw WHERE l_suppkey % 6 < 5),
eg AS (SELECT page * 10 + l_suppkey % 6 AS page, CAST(row_number() OVER (PARTITION BY page, l_suppkey % 6 ORDER BY g) - 1 AS INTEGER) AS g, g1, g2, g3, g4 FROM gt WHERE l_suppkey % 6 < 5),
{greedy_sql('ep', 'eg', 'iou >= 0.5', 'g')},
k AS (SELECT page, sum(p) AS np, sum(g) AS ng FROM (SELECT page, 1 AS p, 0 AS g FROM ep UNION ALL SELECT page, 0, 1 FROM eg) GROUP BY page),
f AS (SELECT k.page // 10 AS page, 2.0 * coalesce(t.n, 0) / (np + ng) AS f1 FROM k LEFT JOIN (SELECT page, count(*) AS n FROM m GROUP BY page) t ON t.page = k.page)
SELECT a.page, round(coalesce(avg(f1), 0.0), 6) AS f1 FROM (SELECT DISTINCT page FROM blk) a LEFT JOIN f ON f.page = a.page GROUP BY a.page""")
def error_f1_macro(spark, d):
    return _errors(pages(spark, d)).select("page", r6(scoring.error_f1("pred", "gt")).alias("f1"))


@query(f"""WITH RECURSIVE {FIX}, rp AS (SELECT page, i, r1 AS c1, r2 AS c2, r3 AS c3, r4 AS c4 FROM raw), {greedy_sql('rp', 'gt', 'iou >= 0.1')},
s AS (SELECT page, count(*) AS matched, avg(iou) AS mean_iou FROM m GROUP BY page)
SELECT a.page, coalesce(matched, 0) AS matched, round(coalesce(mean_iou, 0.0), 6) AS mean_iou FROM (SELECT DISTINCT page FROM blk) a LEFT JOIN s ON s.page = a.page""")
def error_iou(spark, d):
    p, g = F.col("p"), F.col("g")
    boxes = _errors(pages(spark, d)).select("page", F.transform("pred", lambda e: e["bbox"]).alias("p"), F.transform("gt", lambda e: e["bbox"]).alias("g"))
    m = boxes.select("page", scoring.error_metrics(matching.greedy(p, g), F.size(g), F.size(p)).alias("m"))
    return m.select("page", F.col("m.matched").cast("long").alias("matched"), r6("m.mean_iou").alias("mean_iou"))


@query(f"WITH {FIX} SELECT page, i, CAST(row_number() OVER (PARTITION BY page ORDER BY c2, c1, i) - 1 AS INTEGER) AS rank FROM pr")
def reading_order_rank(spark, d):
    return pages(spark, d).select("page", F.posexplode(ordering.ranks(ordering.reading_order("pred"))).alias("i", "rank"))


_TAU = """WITH b AS (SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INTEGER) AS g, l_partkey % 5 AS p FROM lineitem),
s AS (SELECT x.page, count(*) AS n, sum(CASE WHEN sign(x.p - y.p) * sign(x.g - y.g) > 0 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN sign(x.p - y.p) * sign(x.g - y.g) < 0 THEN 1 ELSE 0 END) AS d, sum(CASE WHEN x.p = y.p THEN 1 ELSE 0 END) AS tp FROM b x JOIN b y ON x.page = y.page AND x.g < y.g GROUP BY x.page)
SELECT a.page, """


@query(_TAU + "round(CASE WHEN n IS NULL OR n - tp = 0 THEN 0.0 ELSE (c - d)::DOUBLE / sqrt((n - tp)::DOUBLE * n) END, 6) AS tau FROM (SELECT DISTINCT page FROM b) a LEFT JOIN s ON s.page = a.page")
def kendall_tau_b(spark, d):
    a, b = F.transform("rows", lambda r: (r["l_partkey"] % 5).cast("int")), F.transform("rows", lambda r: r["b"])
    return pages(spark, d).select("page", r6(ordering.kendall_tau_b(a, b)).alias("tau"))


@query(_TAU + "round(CASE WHEN n IS NULL THEN 1.0 WHEN c + d = 0 THEN 0.0 ELSE (c - d)::DOUBLE / (c + d) END, 6) AS gamma FROM (SELECT DISTINCT page FROM b) a LEFT JOIN s ON s.page = a.page")
def kendall_gamma(spark, d):
    a, b = F.transform("rows", lambda r: (r["l_partkey"] % 5).cast("int")), F.transform("rows", lambda r: r["b"])
    return pages(spark, d).select("page", r6(ordering.kendall_gamma(a, b)).alias("gamma"))


_ORDER_SQL = f"""WITH RECURSIVE {FIX}, op AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY c2, c1, i) - 1 AS INTEGER) AS i, c1, c2, c3, c4 FROM pr), {greedy_sql('op', 'gt', 'iou > 0.05')},
v AS (SELECT page, g, row_number() OVER (PARTITION BY page ORDER BY i) AS r FROM m),
t AS (SELECT x.page, sum(sign(x.r - y.r) * sign(x.g - y.g)) AS s, count(*) AS n FROM v x JOIN v y ON x.page = y.page AND x.g < y.g GROUP BY x.page),
k AS (SELECT page, count(*) AS n FROM v GROUP BY page), tg AS (SELECT page, count(*) AS n FROM gt GROUP BY page),
o AS (SELECT tg.page, coalesce(t.s::DOUBLE / t.n, 0.0) AS tau, coalesce(k.n, 0) AS matched_blocks, tg.n AS total_gt_blocks FROM tg LEFT JOIN k ON k.page = tg.page LEFT JOIN t ON t.page = tg.page)"""


@query(_ORDER_SQL + " SELECT page, round(tau, 6) AS kendall_tau, CAST(matched_blocks AS INTEGER) AS matched_blocks, CAST(total_gt_blocks AS INTEGER) AS total_gt_blocks FROM o")
def reading_order_from_blocks(spark, d):
    o = pages(spark, d).select("page", scoring.order_metrics("pred", "gt", F.transform("rows", lambda r: r["b"])).alias("o")).select("page", "o.*")
    return o.select("page", r6("kendall_tau").alias("kendall_tau"), "matched_blocks", "total_gt_blocks")


@query(_PAGE_SQL + """ SELECT page % 4 AS candidate, round(coalesce(avg(CASE WHEN matched > 0 THEN mean_iou END), 0.0), 6) AS mean_iou, round(avg(recall), 6) AS mean_recall, round(avg(prec), 6) AS mean_precision, count(*) FILTER (matched > 0) AS iou_pages, count(*) AS pages FROM a GROUP BY 1""")
def layout_report(spark, d):
    p = pages(spark, d).select("page", (F.col("page") % 4).alias("candidate"), "pred", "gt")
    s = scoring.layout_summary(scoring.layout_pages(p), ["candidate"])
    return s.select("candidate", *[r6(c).alias(c) for c in ("mean_iou", "mean_recall", "mean_precision")], "iou_pages", "pages")


@query(_ORDER_SQL + " SELECT page % 4 AS candidate, round(coalesce(avg(CASE WHEN matched_blocks >= 2 THEN tau END), 0.0), 6) AS mean_tau, round(avg(tau), 6) AS mean_tau_all, count(*) FILTER (matched_blocks >= 2) AS tau_pages FROM o GROUP BY 1")
def layout_order_report(spark, d):
    p = pages(spark, d).select("page", (F.col("page") % 4).alias("candidate"), "pred", "gt", F.transform("rows", lambda r: r["b"]).alias("o"))
    s = p.select("candidate", scoring.order_metrics("pred", "gt", "o").alias("m"))
    return s.groupBy("candidate").agg(r6(scoring.mean_or_zero(F.when(F.col("m.matched_blocks") >= 2, F.col("m.kendall_tau")))).alias("mean_tau"), r6(F.avg("m.kendall_tau")).alias("mean_tau_all"), F.count_if(F.col("m.matched_blocks") >= 2).alias("tau_pages"))


_BOX_SQL = f"""WITH {FIX}, u AS (SELECT page, min(g1) AS x1, min(g2) AS y1, max(g3) AS x2, max(g4) AS y2 FROM gt GROUP BY page)"""


def _union(spark, d):
    return pages(spark, d).select("page", "gt", G.union_box("gt").alias("u"))


@query(_BOX_SQL + " SELECT * FROM u")
def page_union_bbox(spark, d):
    return _union(spark, d).select("page", *[F.col("u")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@query(_BOX_SQL + " SELECT page, greatest(0.0, x1 - 20) AS x1, greatest(0.0, y1 - 20) AS y1, least(310.0, x2 + 20) AS x2, least(150.0, y2 + 20) AS y2 FROM u")
def crop_box(spark, d):
    c = G.padded_crop("u", F.lit(310), F.lit(150))
    return _union(spark, d).select("page", *[c[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@query(_BOX_SQL + " SELECT gt.page, g, g1 - greatest(0.0, x1 - 20) AS x1, g2 - greatest(0.0, y1 - 20) AS y1, g3 - greatest(0.0, x1 - 20) AS x2, g4 - greatest(0.0, y1 - 20) AS y2 FROM gt JOIN u ON u.page = gt.page")
def crop_offset(spark, d):
    c = _union(spark, d).select("page", F.posexplode(F.transform("gt", lambda b: G.crop_offset(b, F.col("u")))).alias("g", "c"))
    return c.select("page", "g", *[F.col("c")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@query(r"""WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Name: ' || text ELSE text END AS t, turn * 900 AS y1, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, turn FROM l WHERE NOT ((turn = last AND contains(t, 'Name:')) OR (len(list_filter(regexp_split_to_array(t, '[\s\x1c-\x1f]+'), lambda w : w <> '')) <= 2 AND y1 > 0.85 * 3542))""")
def signature_filter(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Name: "), "text")).otherwise(F.col("text")).alias("t"), (F.col("turn") * 900).alias("y1"), F.lit(None).cast("int").alias("h"))
    return prep.drop_signatures(c, "conv_id", "turn", "t", "y1", "h").select("conv_id", "turn")


@query(r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS i, t AS line FROM (SELECT doc_id, k, regexp_replace(regexp_replace(line, '^[\s\x1c-\x1f]+', ''), '[\s\x1c-\x1f]+$', '') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)) WHERE t <> ''""")
def lines_to_blocks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(P.line_blocks("text")).alias("i", "b")).select("doc_id", "i", F.col("b.text").alias("line"))


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END, ''), nullif(CASE WHEN doc_id % 3 = 1 THEN source END, ''), lang || source) AS t FROM documents""")
def parsed_fallback_text(spark, d):
    j = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("[1, 2, 3, 4]").alias("block_bbox"), F.col("lang").alias("block_content"))).alias("parsing_res_list")).alias("res"))))
    return table(spark, d, "documents").select("doc_id", P.document_text(j, F.when(F.col("doc_id") % 3 == 1, F.col("source")), F.concat("lang", "source")).alias("t"))


@query("""SELECT event_id, event_type AS type, CASE WHEN event_id % 7 BETWEEN 1 AND 3 THEN (event_id % 7 - 1) * 10 ELSE 0 END::DOUBLE AS x1 FROM events WHERE event_id % 5 <> 4""")
def llm_json_errors(spark, d):
    e = table(spark, d, "events")
    body = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("type"), (F.col("event_id") % 7 - 1).cast("int").alias("block_index"), F.lit("x").alias("description"))).alias("errors")))
    said = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n``` done"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(F.col("event_id") % 5 == 4, F.lit("no {json")).otherwise(body)
    at = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(F.array(k * 10.0, F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("bbox")))
    return e.select("event_id", F.explode(P.placed_errors(P.listed_errors(said), at)).alias("e")).select("event_id", "e.type", F.col("e.bbox")[0].alias("x1"))


@query("SELECT doc_id, substr(text, 1, 5) || substr(text, 8, 4) || substr(text, n_chars - 2) AS t FROM documents")
def text_anchor_slice(spark, d):
    s = lambda a, b: F.struct(F.lit(a).cast("int").alias("start_index") if not hasattr(a, "cast") else a.cast("int").alias("start_index"), F.lit(b).cast("int").alias("end_index"))
    return table(spark, d, "documents").select("doc_id", T.text_anchor("text", F.array(s(None, 5), s(7, 11), s(F.col("n_chars") - 3, None))).alias("t"))


_TRIM = r"regexp_replace(regexp_replace({}, '^[\s\x1c-\x1f]+', ''), '[\s\x1c-\x1f]+$', '')"
_BOX = r"(\d+)>(\d+)>(\d+)>(\d+)>"


def _sql_blocks(source: str, pattern: str, kind: str) -> str:
    parts = ", ".join(f"unnest(regexp_extract_all({source}, '{pattern}', {k})) AS g{k}" for k in range(1, 6))
    return f"SELECT item_id, '{kind}' AS type, {parts} FROM t"


#: One pattern a tag, as the texts nest none; bare lines are those of the text without its tagged blocks. Some texts end in a mark of the private-use area and a bare line.
@query(rf"""WITH t AS (SELECT *, regexp_replace(s, '(?s)<(text|table)>.*?</(text|table)>', '<>', 'g') AS bare FROM (
  SELECT item_id, '5>90>20>99>Head line' || chr(10) || '<text>1>' || (item_id % 50 + 10) || '>400>60>' || text || '</text>' || chr(10) || '<table>7>5>9>8>cell</table>' || CASE WHEN item_id % 3 = 0 THEN ' ' || chr(57344) || chr(10) || '8>300>9>10>Tail ' || chr(57345) || chr(10) ELSE '' END AS s FROM benchmark)),
b AS ({" UNION ALL ".join([*(_sql_blocks("s", f"(?s)<{x}>[[:space:]]*{_BOX}(.*?)</{x}>", x) for x in P.TAGS), _sql_blocks("bare", f"(?m)^{_BOX}(.+)$", "header")])}),
c AS (SELECT item_id, type, trunc(g1::DOUBLE / 999.0::DOUBLE * 1000) AS x1, trunc(g2::DOUBLE / 999.0::DOUBLE * 800) AS y1, {_TRIM.format('g5')} AS text FROM b)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY y1, x1) - 1 AS INTEGER) AS i, type, x1, y1, text FROM c WHERE text <> ''""")
def doctags_parse(spark, d):
    b = table(spark, d, "benchmark")
    tail = F.when(F.col("item_id") % 3 == 0, F.lit(" \ue000\n8>300>9>10>Tail \ue001\n")).otherwise("")
    text = F.concat(F.lit("5>90>20>99>Head line\n<text>1>"), (F.col("item_id") % 50 + 10).cast("string"), F.lit(">400>60>"), F.col("text"), F.lit("</text>\n<table>7>5>9>8>cell</table>"), tail)
    blocks_ = P.doctag_blocks(text, F.lit(1000), F.lit(800))
    return b.select("item_id", F.posexplode(blocks_).alias("i", "b")).select("item_id", "i", "b.type", F.col("b.bbox")[0].alias("x1"), F.col("b.bbox")[1].alias("y1"), "b.text")


@query(r"SELECT item_id, regexp_replace(regexp_replace(text, '^[\s\x1c-\x1f]+', ''), '[\s\x1c-\x1f]+$', '') AS t FROM benchmark")
def got_cleanup(spark, d):
    heads = F.element_at(F.array(*[F.lit(x) for x in ("user\nOCR with format: assistant\n", "OCR:\n", "assistant\n", "x\ny\nOCR\nSentence Database \nA04-039b \n")]), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", P.chat_cleanup(F.concat(heads, "text", F.lit("\n Assistant \n"))).alias("t"))


_CUTS = """t AS (SELECT n_chars, length(source) AS n_source, doc_id, source FROM documents),
q AS (SELECT list_sort(list(n_chars))[count(*) // 3 + 1] AS n_low, list_sort(list(n_chars))[2 * count(*) // 3 + 1] AS n_high, list_sort(list(n_source))[count(*) // 3 + 1] AS s_low, list_sort(list(n_source))[2 * count(*) // 3 + 1] AS s_high FROM t),
k AS (SELECT doc_id, 'd' || CASE WHEN n_chars >= n_high THEN 'H' WHEN n_chars <= n_low THEN 'L' ELSE 'M' END || '_l' || CASE WHEN n_source >= s_high THEN 'H' WHEN n_source <= s_low THEN 'L' ELSE 'M' END AS bucket FROM t, q)"""


def _features(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars", F.length("source").alias("n_source"))


@query(f"WITH {_CUTS} SELECT bucket, count(*) AS n, min(doc_id) AS first FROM k GROUP BY bucket")
def diversity_tertiles(spark, d):
    return prep.bucket(_features(spark, d), {"n_chars": "d", "n_source": "l"}).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query(f"""WITH {_CUTS}, f AS (SELECT bucket, min(doc_id) AS doc_id FROM k GROUP BY bucket), r AS (SELECT doc_id FROM k WHERE doc_id NOT IN (SELECT doc_id FROM f))
SELECT doc_id FROM (SELECT doc_id, 0 AS o, bucket AS b FROM f UNION ALL SELECT doc_id, 1, '' FROM r) ORDER BY o, b, doc_id LIMIT 50""")
def diversity_sample(spark, d):
    return prep.diverse_sample(_features(spark, d), {"n_chars": "d", "n_source": "l"}, 50, F.col("doc_id")).select("doc_id")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, source FROM documents)
SELECT source, doc_id, pick FROM r, (VALUES ('best'), ('worst'), ('median'), ('lower'), ('upper')) p(pick)
WHERE (pick = 'best' AND i = 0) OR (pick = 'worst' AND n > 1 AND i = n - 1) OR (pick = 'median' AND n > 2 AND i = n // 2) OR (pick = 'lower' AND n > 5 AND i = n // 4) OR (pick = 'upper' AND n > 5 AND i = 3 * n // 4)""")
def representative_picks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("cer"))
    return prep.representative(docs, "cer", "doc_id", ["source"]).select("source", "doc_id", "pick")


@query("""WITH p AS (SELECT event_type, event_id % 500 AS y, count(*) FILTER (value < 50) * 2 > count(*) AS dark FROM events GROUP BY 1, 2),
g AS (SELECT event_type, y, y - row_number() OVER (PARTITION BY event_type ORDER BY y) AS k FROM p WHERE dark)
SELECT event_type, min(y) AS y1, max(y) + 1 AS y2 FROM g GROUP BY event_type, k HAVING max(y) + 1 - min(y) >= 3""")
def text_line_runs(spark, d):
    p = table(spark, d, "events").groupBy("event_type", (F.col("event_id") % 500).alias("y")).agg((F.count_if(F.col("value") < 50) * 2 > F.count(F.lit(1))).alias("dark"))
    return prep.runs(p, ["event_type"], "y", "dark", 3)


@query("SELECT doc_id, left(sha256(text), 16) AS sha FROM documents")
def sha_prefix(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sha_prefix("text").alias("sha"))


@query("""SELECT page_id, CASE lower(regexp_extract(u, '\\.([^./]+)$', 1)) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'bmp' THEN 'image/bmp' WHEN 'tiff' THEN 'image/tiff' ELSE 'image/png' END AS mime
FROM (SELECT page_id, url || ['.JPG', '.jpeg', '.Tiff', '.bmp', ''][CAST(page_id % 5 + 1 AS INTEGER)] AS u FROM pages)""")
def mime_type(spark, d):
    ends = F.element_at(F.array(*[F.lit(x) for x in (".JPG", ".jpeg", ".Tiff", ".bmp", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", T.mime_type(F.concat("url", ends)).alias("mime"))


@query("SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS errors, count(*) FILTER (quality = 0 AND toxic = 0) AS warnings, coalesce(bool_and(NOT (quality = 0 AND toxic = 1)), true) AS passed FROM labels")
def check_summary(spark, d):
    return evaluation.checked(table(spark, d, "labels"), F.col("quality") == 0, F.col("toxic") == 1)


@query("SELECT conv_id, turn, left(text, 80) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 3")
def top3_samples(spark, d):
    return evaluation.samples(table(spark, d, "conversations"), 3, ("turn",), "conv_id").select("conv_id", "turn", F.left("text", F.lit(80)).alias("text"))


@query("SELECT r_name AS candidate_name, CAST(r_regionkey AS DOUBLE) AS cer, CAST(NULL AS VARCHAR) AS model_version FROM region UNION ALL SELECT n_name, CAST(NULL AS DOUBLE), 'm' FROM nation")
def schema_superset_union(spark, d):
    a = table(spark, d, "region").select(F.col("r_name").alias("candidate_name"), F.col("r_regionkey").cast("double").alias("character_error_rate"))
    b = table(spark, d, "nation").select(F.col("n_name").alias("candidate_name"), F.lit("m").alias("model"))
    return readers.superset(a, b).select("candidate_name", F.col("character_error_rate").alias("cer"), "model_version")


def _runs(spark, d):
    """Events as pages of candidates: image, run, text, order of three blocks, one error, memory; the truth has 120 of the 200 images."""
    kind = lambda k: F.element_at(F.array(*[F.lit(t) for t in TYPES]), (k % 6 + 1).cast("int"))
    box = lambda x: F.array(F.lit(0.0), F.lit(0.0), F.lit(10.0), x.cast("double"))
    e = F.col("event_id")
    preds = table(spark, d, "events").select(
        F.col("event_type").alias("candidate"), F.floor(e / 200).cast("int").alias("run"), F.concat((e % 200).cast("string"), F.lit(".png")).alias("image"), F.concat("event_type", F.lit("  "), (F.col("user_id") % 3).cast("string")).alias("text"), F.col("value").alias("latency"),
        F.array(*[((e + k) % 3).cast("int") for k in range(3)]).alias("reading_order"), F.array(F.struct(kind(e).alias("type"), box(10 + e % 10).alias("bbox"))).alias("errors"), F.when(e % 4 != 0, F.col("value") / 2).alias("stage1_latency"), (F.col("user_id") % 1000).alias("vram_mb"),
    )
    k = F.col("id")
    truth = spark.range(120).select(k.cast("string").alias("image"), F.concat(F.lit("click "), (k % 3).cast("string")).alias("text"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("reading_order"), F.array(F.struct(kind(k).alias("type"), box(F.lit(10)).alias("bbox"))).alias("errors"))
    return preds, truth


@query("""WITH p AS (SELECT event_type AS candidate, event_id % 200 AS k, event_type || ' ' || user_id % 3 AS text, value AS latency, event_id AS e, user_id % 1000 AS vram FROM events),
s AS (SELECT *, 'click ' || k % 3 AS gt, e % 6 AS kp, k % 6 AS kg FROM p WHERE k < 120),
m AS (SELECT candidate, avg(levenshtein(text, gt)::DOUBLE / length(gt)) AS cer, avg((CASE WHEN candidate <> 'click' THEN 1 ELSE 0 END + CASE WHEN right(text, 1) <> right(gt, 1) THEN 1 ELSE 0 END) / 2.0::DOUBLE) AS wer, avg(CASE WHEN e % 3 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE / 3 END) AS tau,
  avg(CASE WHEN kp = kg AND kp < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS f1, avg(10.0::DOUBLE / (10 + e % 10)) AS iou, count(*) AS n_scored FROM s GROUP BY candidate)
SELECT p.candidate, round(avg(latency), 6) AS latency_avg, count(*) AS n, round(coalesce(any_value(cer), 0), 6) AS cer, round(coalesce(any_value(wer), 0), 6) AS wer, round(coalesce(any_value(tau), 0), 6) AS reading_order_tau, round(coalesce(any_value(f1), 0), 6) AS error_detection_f1,
  round(coalesce(any_value(iou), 0), 6) AS bounding_box_iou, round(coalesce(avg(latency / 2) FILTER (e % 4 <> 0), 0), 6) AS stage1_latency_avg, max(vram) AS vram_peak_mb, coalesce(any_value(n_scored), 0) AS n_scored
FROM p LEFT JOIN m ON m.candidate = p.candidate GROUP BY p.candidate""")
def evaluate_candidates(spark, d):
    out = evaluation.run_candidates(*_runs(spark, d))
    return out.select("candidate", r6("latency_avg").alias("latency_avg"), "n", *[r6(c).alias(c) for c in ("cer", "wer", "reading_order_tau", "error_detection_f1", "bounding_box_iou", "stage1_latency_avg")], F.col("vram_peak_mb").cast("long").alias("vram_peak_mb"), "n_scored")


def _layout(spark, d):
    """Pages of line items with a latency; every fifth page has no truth."""
    at = pages(spark, d)
    as_blocks = lambda boxes: F.transform(boxes, lambda b, i: F.struct(b.alias("bbox"), F.concat(F.lit("t"), i.cast("string")).alias("text")))
    image = F.concat(F.col("page").cast("string"), F.lit(".png")).alias("image")
    preds = at.select(image, as_blocks(F.col("pred")).alias("blocks"), ((F.col("page") % 97).cast("double") / 8).alias("stage1_latency"))
    truth = at.where("page % 5 <> 0").select(image, as_blocks(F.col("gt")).alias("blocks"), F.transform("rows", lambda r: r["b"]).alias("reading_order"))
    return evaluation.layout_eval(preds, truth, "lines")


_LAYOUT_SQL = f"""WITH x AS (SELECT b.page, b.mean_iou, b.matched, b.total_gt, b.total_pred, b.recall, b.prec, o.tau, o.matched_blocks FROM ({_PAGE_SQL} SELECT * FROM a) b JOIN ({_ORDER_SQL} SELECT * FROM o) o ON o.page = b.page WHERE b.page % 5 <> 0),
n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem)"""


@query(_LAYOUT_SQL + """ SELECT 'lines_bbox' AS candidate, round(coalesce(avg(mean_iou) FILTER (matched > 0), 0), 4) AS mean_bbox_iou, round(coalesce(avg(tau) FILTER (matched_blocks >= 2), 0), 4) AS mean_kendall_tau,
round(sum((page % 97)::DOUBLE / 8) / any_value(n.n), 2) AS mean_latency_s, count(*) FILTER (matched > 0) AS images_with_bbox_matches, count(*) FILTER (matched_blocks >= 2) AS images_with_tau, any_value(n.n) AS total_images FROM x, n""")
def layout_eval_summary(spark, d):
    return _layout(spark, d)[0]


@query(_LAYOUT_SQL + """ SELECT page || '.png' AS image, CAST(total_pred AS INTEGER) AS num_pred_blocks, CAST(total_gt AS INTEGER) AS num_gt_blocks, round(mean_iou, 4) AS bbox_mean_iou, round(recall, 4) AS bbox_recall, round(prec, 4) AS bbox_precision, round(tau, 4) AS reading_order_tau,
CAST(matched_blocks AS INTEGER) AS reading_order_matched, round((page % 97)::DOUBLE / 8, 2) AS latency_s, CAST(least(3, total_pred) AS INTEGER) AS n_samples FROM x""")
def layout_eval_images(spark, d):
    return _layout(spark, d)[1].withColumn("n_samples", F.size("sample_blocks")).drop("candidate", "sample_blocks")


def _forms(spark, d):
    """Conversations as forms: a line a turn, with up to two components; every fifth has no handwritten part, every fourth image no form."""
    k, t = F.col("conv_id"), F.col("turn")
    part = lambda x, y: F.struct(x.cast("int").alias("_x"), y.cast("int").alias("_y"), F.when(t % 3 != 2, 40 + t % 5).cast("int").alias("_width"), F.lit(20).alias("_height"))
    word = F.struct(F.lit("w").alias("_id"), F.lit("w").alias("_text"), F.when(t % 4 == 1, F.array(part(k % 50 + 7 * t, 900 - 40 * t), part(k % 30, 905 - 40 * t))).otherwise(F.array(part(k % 50, 900 - 40 * t))).alias("cmp"))
    line = F.struct(t.alias("turn"), F.when(t % 6 != 5, F.col("text")).otherwise("").alias("_text"), F.array(word).alias("word"))
    lines = table(spark, d, "conversations").where("conv_id % 4 <> 3").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["_text"].alias("_text"), x["word"].alias("word"))).alias("l"))
    forms = lines.select(F.concat(F.lit("c"), k.cast("string")).alias("image"), F.lit(1000).alias("_height"), F.when(k % 5 != 0, F.struct(F.col("l").alias("line"))).alias("handwritten-part"), F.when(k % 5 == 0, F.col("l")).alias("line"))
    return table(spark, d, "conversations").select(F.concat(F.lit("c"), k.cast("string"), F.lit(".png")).alias("image")).distinct(), forms


_FORMS_SQL = """WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS idx, CASE WHEN turn % 6 <> 5 THEN text ELSE '' END AS text FROM conversations WHERE conv_id % 4 <> 3),
l AS (SELECT conv_id, idx, text, CASE WHEN turn % 3 = 2 THEN 0 WHEN turn % 4 = 1 THEN least(conv_id % 50 + 7 * turn, conv_id % 30) ELSE conv_id % 50 END AS x1, CASE WHEN turn % 3 = 2 THEN 0 ELSE 900 - 40 * turn END AS y1,
  CASE WHEN turn % 3 = 2 THEN 0 WHEN turn % 4 = 1 THEN greatest(conv_id % 50 + 7 * turn, conv_id % 30) + 40 + turn % 5 ELSE conv_id % 50 + 40 + turn % 5 END AS x2, CASE WHEN turn % 3 = 2 THEN 0 WHEN turn % 4 = 1 THEN 925 - 40 * turn ELSE 920 - 40 * turn END AS y2, turn % 3 <> 2 AS boxed FROM c WHERE text <> '')"""


@query(_FORMS_SQL + """, i AS (SELECT DISTINCT conv_id FROM conversations),
p AS (SELECT conv_id, count(*) AS n, string_agg(text, chr(10) ORDER BY y1, x1, idx) AS text, min(x1) AS x1, max(y2) AS y2 FROM l GROUP BY conv_id)
SELECT 'c' || i.conv_id || '.png' AS image, coalesce(p.text, '') AS text, coalesce(p.n, 0) AS n_blocks, coalesce(p.x1, -1)::DOUBLE AS x1, coalesce(p.y2, -1)::DOUBLE AS y2, i.conv_id % 4 = 3 AS skeleton FROM i LEFT JOIN p ON p.conv_id = i.conv_id""")
def truth_from_forms(spark, d):
    images, forms = _forms(spark, d)
    side = lambda k, f: F.coalesce(f(F.transform("blocks", lambda b: b["bbox"][k])), F.lit(-1.0))
    return prep.truth_entries(images, forms).select("image", "text", F.size("blocks").cast("long").alias("n_blocks"), side(0, F.array_min).alias("x1"), side(3, F.array_max).alias("y2"), F.col("_note").isNotNull().alias("skeleton"))


@query(_FORMS_SQL + """, b AS (SELECT conv_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM l WHERE boxed AND conv_id % 5 <> 0 GROUP BY conv_id)
SELECT 'c' || conv_id || '.png' AS image, x1 AS x1, y2 AS y2, CAST(least(200, x2 + 20) - greatest(0, x1 - 20) AS BIGINT) AS cropped_width, CAST(least(1000, y2 + 20) - greatest(0, y1 - 20) AS BIGINT) AS cropped_height, n AS num_lines FROM b""")
def crop_manifest(spark, d):
    images, forms = _forms(spark, d)
    rows = prep.crop_rows(images.select("image", F.lit(200).alias("width"), F.lit(1000).alias("height")), forms, signatures=True)
    at = lambda c, k: F.col(c)[k].cast("long")
    return rows.select("image", at("crop_bbox", 0).alias("x1"), at("crop_bbox", 3).alias("y2"), at("cropped_size", 0).alias("cropped_width"), at("cropped_size", 1).alias("cropped_height"), F.col("num_lines").cast("long").alias("num_lines"))


@query("SELECT 'd' || doc_id AS image, source AS path, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars / 1000.0::DOUBLE END::DOUBLE AS text_density, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars END::BIGINT AS estimated_lines, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id END::BIGINT AS contrast FROM documents")
def curated_manifest(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(F.concat(F.lit("d"), k.cast("string")).alias("image"), F.col("source").alias("path"), F.when(k % 3 != 0, F.col("n_chars") / 1000.0).alias("text_density"), F.when(k % 4 != 0, F.col("n_chars").cast("long")).alias("estimated_lines"), F.when(k % 5 != 0, k.cast("long")).alias("contrast"), k)
    return prep.curated(rows)


#: 16 columns and 25 rows of samples (shares of 400 have four places at most) for each page, by whole-number arithmetic.
_PIXEL_SQL = "(page_id * 7 + x * 13 + y * y * 29) % 256"


@query(f"""WITH p AS (SELECT page_id, y, {_PIXEL_SQL} AS v FROM pages, range(16) a(x), range(25) b(y)),
r AS (SELECT page_id, y, avg(CASE WHEN v < 128 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS dark FROM p GROUP BY page_id, y),
t AS (SELECT page_id, avg(dark) + 0.5 * stddev_pop(dark) AS top FROM r GROUP BY page_id),
k AS (SELECT r.page_id, greatest(1, CAST(trunc(count(*) FILTER (dark > top) / (25 * 0.02::DOUBLE)) AS INTEGER)) AS estimated_lines FROM r JOIN t ON t.page_id = r.page_id GROUP BY r.page_id)
SELECT p.page_id || '.png' AS image, 16 AS width, 25 AS height, 0.64::DOUBLE AS aspect_ratio, round(avg(CASE WHEN v < 128 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS text_density, round(stddev_pop(v), 2) AS contrast, any_value(k.estimated_lines) AS estimated_lines FROM p JOIN k ON k.page_id = p.page_id GROUP BY p.page_id""")
def image_manifest(spark, d):
    """Features of image files that are made from the pages' numbers."""
    import numpy as np
    import pyarrow as pa

    from docgauge.sources import images

    def files(batches):
        x, y = np.arange(16), np.arange(25)[:, None]
        for b in batches:
            ids = b.column(0).to_pylist()
            content = [images.to_png(((k * 7 + x * 13 + y * y * 29) % 256).astype(np.uint8)) for k in ids]
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}.png" for k in ids], pa.string()), pa.array([f"pages/{k}.png" for k in ids], pa.string()), pa.array(content, pa.binary())], ["image", "path", "content"])

    made = table(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id")).mapInArrow(files, "image string, path string, content binary")
    return images.manifest(made).select("image", "width", "height", "aspect_ratio", "text_density", "contrast", "estimated_lines")


@query("SELECT doc_id, 'data:image/png;base64,' || to_base64(encode(text)) AS uri FROM documents WHERE text IS NOT NULL")
def data_uri(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.data_uri(F.encode("text", "UTF-8")).alias("uri"))


@query(f"""WITH {FIX}, x AS (SELECT raw.page, raw.b AS i, g, greatest(0.0::DOUBLE, least(r3, g3) - greatest(r1, g1)) * greatest(0.0::DOUBLE, least(r4, g4) - greatest(r2, g2)) AS common, greatest(0.0::DOUBLE, (r3 - r1) * (r4 - r2)) AS a, greatest(0.0::DOUBLE, (g3 - g1) * (g4 - g2)) AS c FROM raw JOIN gt ON gt.page = raw.page)
SELECT page, i, g, round(CASE WHEN a + c - common > 0 THEN common / (a + c - common) ELSE 0 END, 9) AS iou FROM x""")
def iou_clamped(spark, d):
    """Boxes as predicted, xywh ones among them unturned, so that some are inverted."""
    p = pages(spark, d).select("page", "gt", F.posexplode("rows").alias("i", "r")).where("r.pred IS NOT NULL").select("page", "i", F.col("r.pred").alias("p"), F.posexplode("gt").alias("g", "t"))
    return p.select("page", "i", "g", F.round(G.iou("p", "t", clamp=True), 9).alias("iou"))


@query(f"""WITH {FIX} SELECT page, '[' || string_agg('{{"index":' || g || ',"bbox":[' || g1 || ',' || g2 || ',' || g3 || ',' || g4 || '],"text":"t' || g || '"}}', ',' ORDER BY g) || ']' AS prompt FROM gt GROUP BY page""")
def prompt_blocks(spark, d):
    blocks_ = F.transform("gt", lambda b, i: F.struct(b.alias("bbox"), F.concat(F.lit("t"), i.cast("string")).alias("text")))
    return pages(spark, d).select("page", P.prompt_blocks(blocks_).alias("prompt"))


@query(f"""WITH {FIX} SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY g) - 1 AS INTEGER) AS i, 'w' || g AS text, g1 AS x1, g2 AS y1, g1 + l_partkey % 9 AS x2, g2 + 7 AS y2, (l_suppkey % 101)::DOUBLE / 100 AS confidence FROM gt WHERE l_partkey % 4 <> 0""")
def word_rows(spark, d):
    """Parallel lists of words, some of them blank."""
    of = lambda f: F.transform("rows", f)
    text = of(lambda r: F.when(r["l_partkey"] % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" w"), r["b"].cast("string"))))
    lists = F.struct(text.alias("text"), of(lambda r: r["gt"][0]).alias("left"), of(lambda r: r["gt"][1]).alias("top"), of(lambda r: (r["l_partkey"] % 9).cast("double")).alias("width"), of(lambda r: F.lit(7.0)).alias("height"), of(lambda r: (r["l_suppkey"] % 101).cast("double")).alias("conf"))
    w = pages(spark, d).select("page", lists.alias("w")).select("page", F.posexplode(P.word_blocks("w")).alias("i", "b"))
    return w.select("page", "i", "b.text", *[F.col("b.bbox")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], "b.confidence")


@query(f"""WITH {FIX}, n AS (SELECT page, count(*) FILTER (l_partkey % 11 <> 0) AS n FROM blk GROUP BY page), k AS (SELECT page, g, g1, row_number() OVER (PARTITION BY page ORDER BY g) AS r FROM gt)
SELECT k.page, CAST(k.r - 1 AS INTEGER) AS i, k.g1 AS x1, 'p' || (k.r - 1) AS label FROM k JOIN n ON n.page = k.page WHERE k.r <= n.n""")
def positional_zip(spark, d):
    """True boxes beside one label for each prediction: the shorter list ends both."""
    labels = F.transform("pred", lambda _, i: F.concat(F.lit("p"), i.cast("string")))
    z = pages(spark, d).select("page", F.col("gt").alias("box"), labels.alias("label")).select("page", F.posexplode(P.zipped("box", "label")).alias("i", "z"))
    return z.select("page", "i", F.col("z.box")[0].alias("x1"), F.col("z.label").alias("label"))


@query(f"""WITH {FIX}, t AS (SELECT page, max(g) AS last FROM gt GROUP BY page)
SELECT gt.page, gt.g AS i, 't' || g AS text, trunc((l_suppkey % 50) / 100.0::DOUBLE * 200) AS x1, trunc((l_partkey % 7) / 10.0::DOUBLE * 90) AS y1, trunc((l_suppkey % 50 + 5) / 100.0::DOUBLE * 200) AS x2, (l_partkey % 100) / 100.0::DOUBLE AS confidence FROM gt""")
def cloud_document(spark, d):
    """A service's document for each page of line items: text by anchors (a length and an end marked by 0), boxes by vertices in 0..1."""
    name = F.transform("rows", lambda r: F.concat(F.lit("t"), r["b"].cast("string"), F.lit(" ")))
    upto = lambda i: F.length(F.array_join(F.slice(F.col("names"), F.lit(1), i), "")).cast("int")
    p = pages(spark, d).select("page", "rows", name.alias("names"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    n = F.size("rows")

    def block(r, i):
        anchor = F.struct(F.array(F.struct(F.when(i > 0, upto(i)).alias("start_index"), F.when(i < n - 1, upto(i + 1)).otherwise(0).alias("end_index"))).alias("text_segments"))
        x, y = r["l_suppkey"] % 50, (r["l_partkey"] % 7) / F.lit(10.0)
        corners_ = F.array(point(x / F.lit(100.0), y), point((x + 5) / F.lit(100.0), y))
        return F.struct(F.struct(((r["l_partkey"] % 100) / F.lit(100.0)).alias("confidence"), anchor.alias("text_anchor"), F.struct(corners_.alias("normalized_vertices")).alias("bounding_poly")).alias("layout"))

    page = F.struct(F.struct(F.lit(200.0).alias("width"), F.lit(90.0).alias("height")).alias("dimension"), F.transform("rows", block).alias("blocks"))
    said = F.to_json(F.struct(F.array_join("names", "").alias("text"), F.array(page).alias("pages")))
    b = p.select("page", said.alias("j")).select("page", F.posexplode(P.cloud_blocks("j")).alias("i", "b"))
    return b.select("page", "i", "b.text", F.col("b.bbox")[0].alias("x1"), F.col("b.bbox")[1].alias("y1"), F.col("b.bbox")[2].alias("x2"), "b.confidence")


@query(_ORDER_SQL + " SELECT page, round(tau, 6) AS kendall_tau, CAST(matched_blocks AS INTEGER) AS matched_blocks FROM o")
def reading_order_fallback(spark, d):
    """A true order of another length than the blocks counts as none: their own order stands for it."""
    longer = F.array_append(F.transform("rows", lambda r: r["b"]), F.lit(99))
    o = pages(spark, d).select("page", scoring.order_metrics("pred", "gt", longer).alias("o"))
    return o.select("page", r6("o.kendall_tau").alias("kendall_tau"), "o.matched_blocks")


@query("SELECT r_name, m AS mode, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey ELSE -1 END::BIGINT AS a, 'left' AS b FROM region, (VALUES ('handwriting'), ('fullform')) v(m)")
def modes_and_merges(spark, d):
    """Both modes of each row; of two records the right one's fields count where it has them."""
    k = F.col("r_regionkey").cast("long")
    left, right = F.struct(F.lit(-1).cast("long").alias("a"), F.lit("left").alias("b")), F.struct(F.when(k % 2 == 0, k).alias("a"), F.lit(None).cast("string").alias("b"))
    both = prep.both_modes(table(spark, d, "region"), "both").select("r_name", "mode", prep.merged(left, right, ["a", "b"]).alias("m"))
    return both.select("r_name", "mode", "m.a", "m.b")


@query(f"""SELECT page_id || '.png' AS image, CAST(least(16, page_id % 9 + 6) - greatest(0, page_id % 9 - 1) AS INTEGER) AS width, CAST(least(25, page_id % 20 + 5) - greatest(0, page_id % 20 - 1) AS INTEGER) AS height, CAST(sum(v) AS BIGINT) AS total
FROM (SELECT page_id, x, y, {_PIXEL_SQL} AS v FROM pages, range(16) a(x), range(25) b(y)) WHERE x >= page_id % 9 - 1 AND x < page_id % 9 + 6 AND y >= page_id % 20 - 1 AND y < page_id % 20 + 5 GROUP BY page_id""")
def image_crops(spark, d):
    """The pages' images cropped to a box with a border of one, and read again."""
    import numpy as np
    import pyarrow as pa

    from docgauge.sources import images

    def files(batches):
        x, y = np.arange(16), np.arange(25)[:, None]
        for b in images.few(batches):
            ids = b.column(0).to_pylist()
            content = [images.to_png(((k * 7 + x * 13 + y * y * 29) % 256).astype(np.uint8)) for k in ids]
            boxes_ = [[k % 9, k % 20, k % 9 + 5, k % 20 + 4] for k in ids]
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}.png" for k in ids], pa.string()), pa.array(content, pa.binary()), pa.array(boxes_, pa.list_(pa.int32()))], ["image", "content", "crop_bbox"])

    def sums(batches):
        for b in batches:
            total = [int(images.pixels(raw.as_py()).sum(dtype=np.int64)) for raw in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(total, pa.int64())], ["image", "width", "height", "total"])

    ids = table(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id"))
    return images.in_turn(ids, "image string, width int, height int, total long", files, images.crops(pad=1), sums)


def placed_sums(batches):
    """Batches with image and content -> image, channels, the sum of its samples, and that of samples weighted by their place; one image's samples at a time."""
    import numpy as np
    import pyarrow as pa

    from docgauge.sources import images

    for b in batches:
        rows = []
        for image, raw in zip(b.column("image").to_pylist(), b.column("content")):
            p = images.pixels(raw.as_py()).astype(np.int64)
            places = np.arange(p.shape[1])[:, None] + 16 * np.arange(len(p))[:, None, None] + 400 * np.arange(p.shape[2])
            rows.append((image, p.shape[2], int(p.sum()), int((p * places).sum())))
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["image", "channels", "total", "placed"])


#: Kinds of image files: bits, channels, filters of the rows in turn, interlaced, palette.
FILE_KINDS = ((8, 1, (0, 1, 2, 3, 4), False, False), (8, 1, (4, 3), True, False), (4, 1, (4,), False, False), (2, 1, (3, 0), True, False), (1, 1, (4, 2), False, False), (16, 1, (1, 4), False, False), (8, 3, (4, 3, 2, 1, 0), False, False), (8, 4, (3, 4), True, False), (4, 1, (2, 4), False, True), (16, 2, (3,), True, False))
_FILE_BITS = "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN {f[0]}" for k, f in enumerate(FILE_KINDS)) + " END"
_FILE_CHANNELS = "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN {3 if f[4] else f[1]}" for k, f in enumerate(FILE_KINDS)) + " END"


@query(f"""WITH k AS (SELECT page_id, {_FILE_BITS} AS bits, {_FILE_CHANNELS} AS channels FROM pages),
v AS (SELECT page_id, bits, channels, x, y, c, ({_PIXEL_SQL} + CASE WHEN page_id % 10 = 8 THEN 0 ELSE 85 * c END) % 256 AS s FROM k, range(16) a(x), range(25) b(y), range(4) d(c) WHERE c < channels),
d AS (SELECT *, CASE WHEN page_id % 10 = 8 THEN (s // 16 * 31 + c * 7) % 256 WHEN bits < 8 THEN CASE bits WHEN 4 THEN s // 16 * 17 WHEN 2 THEN s // 64 * 85 ELSE s // 128 * 255 END ELSE s END AS o FROM v)
SELECT page_id || '.png' AS image, CAST(any_value(channels) AS INTEGER) AS channels, CAST(sum(o) AS BIGINT) AS total, CAST(sum(o * (x + 16 * y + 400 * c)) AS BIGINT) AS placed FROM d GROUP BY page_id""")
def image_kinds(spark, d):
    """The pages' images in files of ten kinds (depths, colours, all filters, interlaced, palettes), read again: sums of samples, and weighted by their place."""
    import numpy as np
    import pyarrow as pa

    from docgauge.sources import images, png

    kinds = FILE_KINDS

    def files(batches):
        x, y, c = np.arange(16)[:, None], np.arange(25)[:, None, None], np.arange(4)
        for b in images.few(batches):
            content = []
            for k in b.column(0).to_pylist():
                bits, channels, filters, interlaced, palette = kinds[k % 10]
                s = (k * 7 + x * 13 + y * y * 29 + 85 * c[:channels]) % 256
                s = s >> 8 - bits if bits < 8 else s * 256 + x if bits == 16 else s
                colours = (np.arange(16)[:, None] * 31 + np.arange(3) * 7) % 256 if palette else None
                content.append(png.encode(s, bits, np.array(filters), interlaced, colours))
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}.png" for k in b.column(0).to_pylist()], pa.string()), pa.array(content, pa.binary())], ["image", "content"])

    ids = spread(table(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id")))
    return images.in_turn(ids, "image string, channels int, total long, placed long", files, placed_sums)


@query("SELECT page_id || '.html' AS member, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS sha FROM pages")
def archive_members(spark, d):
    """The pages in zip archives, read again as rows."""
    import uuid

    from docgauge.operators.tables import shared_folder
    from docgauge.sources import archives

    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    rows = table(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("member"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    archives.save_archives(rows, folder).collect()  # a name and a count for each archive
    return archives.members(spark, folder, 1 << 20).select("member", "size", F.sha2("content", 256).alias("sha"))


#: Boxes of a page's image: true ones of three samples' width, predicted ones of two, inwards from the corners.
def _on_outline(box: tuple[str, str, str, str], width: int) -> str:
    a, b, c, e = box
    return f"(x BETWEEN {a} AND {c} AND y BETWEEN {b} AND {e} AND NOT (x BETWEEN {a} + {width} AND {c} - {width} AND y BETWEEN {b} + {width} AND {e} - {width}))"


_TRUE_BOX, _PREDICTED_BOX = ("page_id % 5 - 2", "page_id % 7", "page_id % 5 + 9", "page_id % 7 + 12"), ("page_id % 6", "page_id % 11 + 3", "page_id % 6 + 8", "page_id % 11 + 9")


@query(f"""WITH v AS (SELECT page_id, c, CASE WHEN {_on_outline(_PREDICTED_BOX, 2)} THEN CASE c WHEN 0 THEN 255 ELSE 40 END WHEN {_on_outline(_TRUE_BOX, 3)} THEN CASE c WHEN 1 THEN 200 ELSE 0 END ELSE {_PIXEL_SQL} END AS o, x + 16 * y + 400 * c AS spot
FROM pages, range(16) a(x), range(25) b(y), range(3) k(c))
SELECT page_id || '.png' AS image, CAST(sum(o) AS BIGINT) AS total, CAST(sum(o * spot) AS BIGINT) AS placed FROM v GROUP BY page_id""")
def image_overlays(spark, d):
    """True and predicted boxes drawn on the pages' images, read again: sums of samples, and weighted by their place."""
    import numpy as np
    import pyarrow as pa

    from docgauge.sources import images, overlays

    def files(batches):
        x, y = np.arange(16), np.arange(25)[:, None]
        for b in images.few(batches):
            ids = b.column(0).to_pylist()
            content = [images.to_png(((k * 7 + x * 13 + y * y * 29) % 256).astype(np.uint8)) for k in ids]
            boxes_ = lambda make: pa.array([[[float(v) for v in make(k)]] for k in ids], pa.list_(pa.list_(pa.float64())))
            true, predicted = boxes_(lambda k: (k % 5 - 2, k % 7, k % 5 + 9, k % 7 + 12)), boxes_(lambda k: (k % 6, k % 11 + 3, k % 6 + 8, k % 11 + 9))
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}.png" for k in ids], pa.string()), pa.array(content, pa.binary()), true, predicted], ["image", "content", "gt", "pred"])

    ids = table(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id"))
    return images.in_turn(ids, "image string, channels int, total long, placed long", files, overlays.drawn(labels=False), placed_sums).drop("channels")


# the queries whose way leads through files register themselves
from docgauge.plans import files  # noqa: E402, F401
