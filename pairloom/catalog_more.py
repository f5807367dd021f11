"""More queries of the registry: matching with its scores, sampling, reports and models."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom.catalog import _ALN, _BOTH, _HAM, _LINE, LEFT, WIDTH, _halves, alignment, query, r6, stored, table
from pairloom.functions import symbols as S
from pairloom.models import evaluate, rbm, train
from pairloom.operators import dense, geometry, groups, rank, sampling, stats
from pairloom.plans import pairing, sweep
from pairloom.sources import logs
from pairloom.storage import materialize


def _learn(train_rows: str, weighted: bool) -> str:
    """CTEs from tr(row_id, seq) to pm(i, j, a, b, pmi) of residues and al of all states."""
    w = f"w AS (SELECT x.seq, 1.0e0 / sum(y.c) AS w FROM ts x, ts y WHERE {_HAM} <= 1 GROUP BY 1)" if weighted else "w AS (SELECT seq, 1.0e0 AS w FROM ts)"
    return f"""tr AS ({train_rows}), ts AS (SELECT seq, count(*) AS c FROM tr GROUP BY 1), {w},
tl AS (SELECT row_id, w, p::INT AS pos, strpos('{S.GAP_FIRST}', substr(seq, p::INT, 1))::INT AS code FROM tr JOIN w USING (seq), range(1, {WIDTH + 1}) r(p)),
tn AS (SELECT sum(w) AS n FROM tr JOIN w USING (seq)),
t1 AS (SELECT pos, code, sum(w) / (SELECT n FROM tn) AS f FROM tl GROUP BY ALL),
t2 AS (SELECT x.pos AS i, y.pos AS j, x.code AS a, y.code AS b, sum(x.w) / (SELECT n FROM tn) AS f FROM tl x JOIN tl y USING (row_id) WHERE x.pos <= {LEFT} AND y.pos > {LEFT} GROUP BY ALL),
tg AS (SELECT i::INT AS i, j::INT AS j, a::INT AS a, b::INT AS b FROM range(1, {LEFT + 1}) g1(i), range({LEFT + 1}, {WIDTH + 1}) g2(j), range(1, 22) g3(a), range(1, 22) g4(b)),
tc AS (SELECT g.i, g.j, g.a, g.b, coalesce(t2.f, 0) AS fab, coalesce(x.f, 0) AS fa, coalesce(y.f, 0) AS fb FROM tg g LEFT JOIN t2 ON g.i = t2.i AND g.j = t2.j AND g.a = t2.a AND g.b = t2.b LEFT JOIN t1 x ON x.pos = g.i AND x.code = g.a LEFT JOIN t1 y ON y.pos = g.j AND y.code = g.b),
pm AS (SELECT i, j, a, b, ln((0.85 * fab + 0.15 / 441.0e0) / ((0.85 * fa + 0.15 / 21.0e0) * (0.85 * fb + 0.15 / 21.0e0))) AS pmi FROM tc WHERE a > 1 AND b > 1),
al AS (SELECT i, j, a, b, ln((fab + 0.01e0 / 441) / 1.01e0 / (((fa * n + 0.01e0) / (n + 0.21e0)) * ((fb * n + 0.01e0) / (n + 0.21e0))) + 1e-12) AS pmi FROM tc, tn)"""


#: Groups of three rows, which SQL can enumerate.
_THREE = f"""{_ALN}, h AS (SELECT row_id // 3 AS g, row_id, row_id % 3 + 1 AS p, seq, substr(seq, 1, {LEFT}) AS l, substr(seq, {LEFT + 1}) AS r FROM aln WHERE row_id // 3 IN (SELECT row_id // 3 FROM aln GROUP BY 1 HAVING count(*) = 3))"""


def _scored(pm: str) -> str:
    return f"""cp AS (SELECT l, r, i::INT AS i, j::INT AS j, strpos('{S.GAP_FIRST}', substr(l, i::INT, 1)) AS a, strpos('{S.GAP_FIRST}', substr(r, j::INT - {LEFT}, 1)) AS b FROM (SELECT DISTINCT x.l, y.r FROM h x JOIN h y USING (g)) d, range(1, {LEFT + 1}) t(i), range({LEFT + 1}, {WIDTH + 1}) u(j)),
sc AS (SELECT l, r, sum(coalesce(pmi, 0)) AS score FROM cp LEFT JOIN {pm} USING (i, j, a, b) GROUP BY 1, 2),
s3 AS (SELECT x.g, x.p AS x, y.p AS y, score FROM h x JOIN h y USING (g) JOIN sc ON sc.l = x.l AND sc.r = y.r)"""


_PERMS = ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(itertools.permutations((1, 2, 3))))
_MATCH = f"""pe AS (SELECT * FROM (VALUES {_PERMS}) v(id, y1, y2, y3)),
pl AS (SELECT id, 1 AS x, y1 AS y FROM pe UNION ALL SELECT id, 2, y2 FROM pe UNION ALL SELECT id, 3, y3 FROM pe),
tt AS (SELECT g, id, sum(score) AS total FROM s3 JOIN pl USING (x, y) GROUP BY ALL),
bt AS (SELECT g, max(total) AS best FROM tt GROUP BY 1), bi AS (SELECT g, best, min(id) AS id FROM tt JOIN bt USING (g) WHERE total >= best - 1e-9 GROUP BY ALL),
bp AS (SELECT g, best, x, y FROM bi JOIN pl USING (id)),
gp AS (SELECT bp.g, bp.x, bp.y, any_value(best) AS best, any_value(best) - max(total) AS gap FROM bp JOIN pl ON pl.x = bp.x AND pl.y <> bp.y JOIN tt ON tt.g = bp.g AND tt.id = pl.id GROUP BY ALL)"""
_OUT = "SELECT h.g AS species, h.row_id AS hk, round(best, 4) + 0.0e0 AS total, round(gap, 4) + 0.0e0 AS gap FROM gp JOIN h ON h.g = gp.g AND h.p = gp.x"


def _threes(aligned):
    a = aligned.withColumn("species", F.floor(F.col("row_id") / 3))
    return a.join(groups.species_groups(a, 3, 3).select("species"), "species", "left_semi")


def _totals(found):
    total = F.sum("score").over(Window.partitionBy("species"))  # a join would match all groups twice
    return found.select("species", "hk", (F.round(total, 4) + 0.0).alias("total"), (F.round("gap", 4) + 0.0).alias("gap"))


@query(f"WITH {_THREE}, {_learn('SELECT row_id, seq FROM aln', False)}, {_scored('pm')}, {_MATCH} {_OUT}")
def assign_k3(spark, d):
    """Three rows of a group: all six matchings are compared."""
    a = stored(spark, d)
    t = dense.pmi_table(a.select("seq", F.lit(1.0).alias("w")), WIDTH, LEFT)
    return _totals(dense.match_groups(_threes(a), dense.TableScores(t), LEFT))


@query(f"WITH {_THREE}, {_learn('SELECT row_id, seq FROM aln WHERE row_id % 2 = 0', True)}, {_scored('pm')}, {_MATCH} {_OUT}")
def predict_k3(spark, d):
    """Learnt on half of the rows, weighted by how few are like them, for all groups of three."""
    a = stored(spark, d)
    known = a.filter("row_id % 2 = 0").select("row_id", "seq")
    return _totals(pairing.predict(_threes(a), known, WIDTH, LEFT, 1))


@query(f"WITH {_THREE}, {_learn('SELECT row_id, seq FROM aln', False)}, {_scored('al')}, {_MATCH} {_OUT}")
def one_shot_pairing(spark, d):
    a = stored(spark, d)
    return _totals(pairing.one_shot(_threes(a), a, WIDTH, LEFT))


@query(f"""WITH {_THREE}, {_learn('SELECT row_id, seq FROM h WHERE row_id % 4 < 2', True)}, {_scored('pm')}, {_MATCH}, q AS (SELECT h.g, (x = y)::INT AS hit, h.row_id % 4 < 2 AS known FROM gp JOIN h ON h.g = gp.g AND h.p = gp.x WHERE gap > 1e-6)
SELECT CASE k WHEN 0 THEN 'all' WHEN 1 THEN 'known' ELSE 'heldout' END AS population, round(coalesce(avg(hit), 0), 6)::DOUBLE AS tp, count(*) AS n, round(count(DISTINCT g) / count(*)::DOUBLE, 6) AS chance FROM q, (VALUES (0), (1), (2)) v(k) WHERE k = 0 OR (k = 1) = known GROUP BY 1""")
def matched_comparison(spark, d):
    """One round learnt on known rows: of pairs that no other best matching lacks, the share that is right."""
    rows = materialize(_threes(stored(spark, d)), "rows")
    known = rows.filter("row_id % 4 < 2").select("row_id")
    found, _ = pairing.matched_comparison(rows, known, WIDTH, LEFT, 1)
    sure = found.filter("gap > 1e-6").withColumn("side", F.when(F.col("hk") % 4 < 2, "known").otherwise("heldout"))
    both = sure.select("species", (F.col("hk") == F.col("rr")).cast("double").alias("hit"), F.explode(F.array("side", F.lit("all"))).alias("population"))
    return both.groupBy("population").agg(F.round(F.coalesce(F.avg("hit"), F.lit(0.0)), 6).alias("tp"), F.count("*").alias("n"), F.round(F.count_distinct("species") / F.count("*"), 6).alias("chance"))


def fixed_rbm(sites: int = WIDTH, first: int = 0, units: int = 2) -> rbm.RBM:
    """A machine whose parameters are small whole numbers over ten, which SQL can state; sites count on from `first`."""
    i, a, m = np.arange(1, sites + 1) + first, np.arange(1, S.STATES + 1), np.arange(1, units + 1)
    w = ((i[:, None, None] * 7 + a[None, :, None] * 3 + m[None, None] * 5) % 11 - 5) / 10
    return rbm.RBM(((3 * i[:, None] + 5 * a[None]) % 7) / 10, m / 10, w, LEFT)


_G, _W = "((3 * pos + 5 * code) % 7) / 10.0e0", "((pos * 7 + code * 3 + m * 5) % 11 - 5) / 10.0e0"


def _energy(cells: str, key: str) -> str:
    """CTE fe(key, f) of cells(key, pos, code)."""
    return f"""fg AS (SELECT {key}, sum({_G}) AS g FROM {cells} GROUP BY ALL), fw AS (SELECT {key}, m, m / 10.0e0 + sum({_W}) AS x FROM {cells}, (VALUES (1), (2)) mm(m) GROUP BY {key}, m),
fe AS (SELECT {key}, -any_value(g) - sum(ln(1 + exp(x))) AS f FROM fg JOIN fw USING ({key}) GROUP BY {key})"""


@query(f"WITH {_ALN}, {_energy('lf', 'row_id')} SELECT row_id, round(f, 6) + 0.0e0 AS free_energy FROM fe")
def rbm_free_energy(spark, d):
    a = alignment(spark, d).select("row_id", S.codes(F.col("seq")).alias("codes"))
    return rbm.score(a, fixed_rbm()).select("row_id", (F.round("free_energy", 6) + 0.0).alias("free_energy"))


@query(f"WITH {_ALN}, fw AS (SELECT row_id, m, m / 10.0e0 + sum({_W}) AS x FROM lf, (VALUES (1), (2)) mm(m) GROUP BY row_id, m) SELECT m AS unit, round(avg(1 / (1 + exp(-x))), 6) AS mean, round(avg((1 / (1 + exp(-x)) > 0.5)::INT), 6) AS rate FROM fw GROUP BY 1")
def rbm_hidden(spark, d):
    """Means of the hidden units, and how often each is on."""
    a = alignment(spark, d).select("row_id", S.codes(F.col("seq")).alias("codes"))
    h = rbm.hidden(a, fixed_rbm())
    return h.groupBy("unit").agg(F.round(F.avg("h"), 6).alias("mean")).join(stats.firing_rate(h, 0.5).withColumn("rate", F.round("rate", 6)), "unit").select(F.col("unit").cast("int").alias("unit"), "mean", "rate")


@query(f"""WITH {_ALN}, fw AS (SELECT row_id, m, m / 10.0e0 + sum({_W}) AS x FROM lf, (VALUES (1), (2)) mm(m) GROUP BY row_id, m),
fs AS (SELECT row_id, pos, m, lf.code AS own, s.code, x - ((pos * 7 + own * 3 + m * 5) % 11 - 5) / 10.0e0 + ((pos * 7 + s.code * 3 + m * 5) % 11 - 5) / 10.0e0 AS x FROM lf JOIN fw USING (row_id), (SELECT c::INT AS code FROM range(1, 22) t(c)) s),
ff AS (SELECT row_id, pos, own, code, any_value({_G}) + sum(ln(1 + exp(x))) AS f FROM fs GROUP BY row_id, pos, own, code),
fp AS (SELECT row_id, pos, sum(f) FILTER (code = own) - ln(sum(exp(f))) AS p FROM ff GROUP BY row_id, pos) SELECT row_id, round(avg(p), 6) AS lpl FROM fp GROUP BY 1""")
def rbm_pseudolikelihood(spark, d):
    a = alignment(spark, d).select("row_id", S.codes(F.col("seq")).alias("codes"))
    return rbm.score(a, fixed_rbm()).select("row_id", F.round("pseudolikelihood", 6).alias("lpl"))


@query(f"""WITH {_THREE}, hp AS (SELECT x.g AS g, x.p AS x, y.p AS y, x.l || y.r AS seq FROM h x JOIN h y USING (g)),
pc AS (SELECT DISTINCT seq, p::INT AS pos, strpos('{S.GAP_FIRST}', substr(seq, p::INT, 1))::INT AS code FROM hp, range(1, {WIDTH + 1}) r(p)), {_energy('pc', 'seq')},
s3 AS (SELECT g, x, y, -f AS score FROM hp JOIN fe USING (seq)), {_MATCH} {_OUT}""")
def free_energy_pairing(spark, d):
    return _totals(pairing.by_free_energy(_threes(stored(spark, d)), fixed_rbm()))


@query(f"""WITH {_THREE}, ha AS (SELECT row_id, z::INT AS pos, strpos('{S.GAP_FIRST}', substr(seq, z::INT, 1))::INT AS code FROM h, range(1, {WIDTH + 1}) r(z)),
fw AS (SELECT row_id, pos <= {LEFT} AS side, m, m / 10.0e0 + sum({_W}) AS x, sum({_G}) AS g FROM ha, (VALUES (1), (2)) mm(m) GROUP BY row_id, pos <= {LEFT}, m),
fs AS (SELECT row_id, side, -any_value(g) - sum(ln(1 + exp(x))) AS f FROM fw GROUP BY row_id, side)
SELECT g AS species, round(-sum(f), 4) + 0.0e0 AS total, 0.0e0 AS gap FROM h JOIN fs USING (row_id) GROUP BY 1""")
def null_pairing(spark, d):
    """Any matching of a sum of two halves is as good as any other."""
    found = pairing.null_pairs(_threes(stored(spark, d)), fixed_rbm(LEFT), fixed_rbm(WIDTH - LEFT, LEFT))
    return found.groupBy("species").agg((F.round(F.sum("score"), 4) + 0.0).alias("total"), (F.round(F.max("gap"), 4) + 0.0).alias("gap"))


@query()
def pairing_from_start(spark, d):
    """Rounds that keep a drawn set of true pairs and add their most confident predictions."""
    a = stored(spark, d)
    n = a.count()
    return pairing.iterate(a, WIDTH, LEFT, max(1, n // 10), 3, seed=2, start=pairing.draw_start(a, n // 5, 2))[1]


_SWEEP = f"""WITH {_THREE}, cf AS (SELECT n::INT AS known, k::INT AS again, n * 100003 + k AS seed FROM (VALUES (40), (90)) a(n), range(1, 3) b(k)),
dr AS (SELECT known, again, row_id, seq, row_number() OVER (PARTITION BY known, again ORDER BY md5(seed || ':' || row_id), row_id) AS place FROM cf, h),
tr AS (SELECT * FROM dr WHERE place <= known), nb AS (SELECT x.known, x.again, x.row_id, 1.0e0 / count(*) AS w FROM tr x JOIN tr y ON x.known = y.known AND x.again = y.again AND hamming(x.seq, y.seq) <= 1 GROUP BY ALL)
SELECT known AS n_start, again AS replicate, count(*) AS n_train, round(sum(w), 6) AS meff FROM nb GROUP BY ALL"""


@query(_SWEEP)
def sweep_training(spark, d):
    """What the first round of each run of a sweep learns from: its drawn pairs and their effective number."""
    out = sweep.run(_threes(stored(spark, d)), WIDTH, LEFT, [40, 90], 2, 6, 1, 1)
    return out.select("n_start", "replicate", "n_train", F.round("meff", 6).alias("meff"))


#: The published sweep: numbers of known pairs, replicates of each, and rounds of a run.
STARTS, REPLICATES, ROUNDS = [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000], 10, 5


@query()
def replicate_sweep(spark, d):
    """Mean and deviation of the share of right pairs, by number of known pairs and round."""
    a = alignment(spark, d)
    out = pairing.sweep(a, WIDTH, LEFT, STARTS, REPLICATES, 6, ROUNDS, 1)
    return out.groupBy("n_start", "iter").agg(F.avg("tp").alias("tp_mean"), F.stddev_samp("tp").alias("tp_std"))


@query("WITH l AS (SELECT doc_id, 'h' || (doc_id + CASE WHEN doc_id % 5 = 0 THEN 100000000 ELSE 0 END) AS header FROM labels), r AS (SELECT doc_id AS row_id, 'h' || doc_id AS header FROM documents) SELECT l.doc_id, r.row_id AS found_row, r.row_id IS NOT NULL AS found FROM l LEFT JOIN r USING (header)")
def header_lookup(spark, d):
    left = table(spark, d, "labels").select("doc_id", F.concat(F.lit("h"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 100000000).otherwise(F.col("doc_id")).cast("string")).alias("header"))
    right = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.concat(F.lit("h"), F.col("doc_id").cast("string")).alias("header"))
    return groups.lookup(left, right, "header").select("doc_id", "found_row", "found")


@query("SELECT d.doc_id AS row_id, CASE WHEN l.quality = 1 THEN 'train' WHEN l.quality = 0 THEN 'val' ELSE 'unused' END AS membership FROM documents d LEFT JOIN labels l USING (doc_id)")
def membership(spark, d):
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.when(F.col("quality") == 1, "train").otherwise("val").alias("m"))
    return alignment(spark, d).select("row_id").join(lab, "row_id", "left").select("row_id", F.coalesce("m", F.lit("unused")).alias("membership"))


@query(f"WITH {_ALN} SELECT row_id, substr(seq, 1, {LEFT}) AS l, substr(seq, {LEFT + 1}) AS r FROM aln")
def halves(spark, d):
    return alignment(spark, d).select("row_id", F.substring("seq", 1, LEFT).alias("l"), F.expr(f"substring(seq, {LEFT + 1})").alias("r"))


@query(f"WITH {_ALN}, s AS (SELECT row_id AS hk, coalesce(lag(row_id) OVER (PARTITION BY species ORDER BY row_id), max(row_id) OVER (PARTITION BY species)) AS rr FROM aln) SELECT hk AS row_id, substr(x.seq, 1, {LEFT}) || substr(y.seq, {LEFT + 1}) AS seq FROM s JOIN aln x ON x.row_id = hk JOIN aln y ON y.row_id = rr")
def concat_pairs(spark, d):
    a = alignment(spark, d)
    return pairing.concat_pairs(a, groups.shift_partner(a).select(F.col("row_id").alias("hk"), F.col("partner").alias("rr")), LEFT)


@query("SELECT n_nationkey AS row_id, r::INT AS replica FROM nation, range(1, 4) t(r)")
def tile_rows(spark, d):
    return evaluate.tiled(table(spark, d, "nation").select(F.col("n_nationkey").alias("row_id")), 3)


@query("SELECT DISTINCT x.label AS a, y.label AS b FROM embeddings x, embeddings y WHERE x.label < y.label")
def class_pairs(spark, d):
    return evaluate.class_pairs(table(spark, d, "embeddings"))


@query("SELECT vec_id AS row_id, label, list_sum(list_transform(embedding, lambda x: CASE WHEN x >= 0.5 THEN 2 ELSE 1 END))::BIGINT AS total FROM embeddings WHERE label IN (1, 3)")
def class_pair_rows(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").alias("pixels"))
    return evaluate.class_pair_rows(e, 1, 3).select("row_id", "label", F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT p_partkey, substr(md5('brand=' || p_brand || '_size=' || p_size), 1, 16) AS tag FROM part")
def config_tags(spark, d):
    return table(spark, d, "part").select("p_partkey", S.config_tag_of({"size": F.col("p_size"), "brand": F.col("p_brand")}).alias("tag"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'out/rbm_A_K=' || s_suppkey || '_L=2.hdf5' END AS path FROM supplier")
def sibling_paths(spark, d):
    k = F.col("s_suppkey").cast("string")
    p = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("out/rbm_paired_K="), k, F.lit("_H_ADD=7_L=2_NITERSB="), k, F.lit("_PAIRED_ITERS=40.hdf5"))).otherwise(F.concat(F.lit("out/other_"), k, F.lit(".hdf5")))
    return table(spark, d, "supplier").select("s_suppkey", S.single_model_path(p, "A").alias("path"))


@query("""WITH h AS (SELECT CASE doc_id % 5 WHEN 0 THEN '9BACL' WHEN 1 THEN NULL WHEN 2 THEN 'XUNKY' WHEN 3 THEN 'S' || doc_id ELSE upper(source) END AS species FROM documents), n AS (SELECT species, count(*) AS n FROM h GROUP BY 1)
SELECT CASE WHEN species IS NULL THEN 'no species' WHEN regexp_matches(species, '^[0-9]|UNC|UNK') THEN 'placeholder' WHEN n < 2 THEN 'small group' ELSE 'kept' END AS why, sum(n)::BIGINT AS rows FROM n GROUP BY 1""")
def dropped_rows(spark, d):
    i = F.col("doc_id") % 5
    s = F.when(i == 0, "9BACL").when(i == 1, F.lit(None)).when(i == 2, "XUNKY").when(i == 3, F.concat(F.lit("S"), F.col("doc_id").cast("string"))).otherwise(F.upper("source"))
    return groups.species_groups_counted(table(spark, d, "documents").select(s.alias("species")), S.is_placeholder(F.col("species")))


@query("SELECT doc_id AS row_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, min(doc_id) LIMIT 3)")
def union_of_groups(spark, d):
    a = alignment(spark, d)
    return groups.union_of_groups(a, groups.species_groups(a, 1).orderBy(F.desc("n"), "first").limit(3))


@query("WITH g AS (SELECT source AS species, count(*) AS n FROM documents GROUP BY 1) SELECT species, n, row_number() OVER (ORDER BY n DESC, md5('4:' || species), species)::INT AS k FROM g")
def size_order(spark, d):
    return groups.order_by_size(alignment(spark, d), 4)


_ALL = f"""{_ALN}, o AS (SELECT pos, code, count(*) AS k FROM lf GROUP BY ALL), t AS (SELECT x.pos AS i, y.pos AS j, x.code AS a, y.code AS b, count(*) AS k FROM lf x JOIN lf y USING (row_id) GROUP BY ALL),
g AS (SELECT i::INT AS i, j::INT AS j, a::INT AS a, b::INT AS b FROM range(1, {WIDTH + 1}) t1(i), range(1, {WIDTH + 1}) t2(j), range(1, 22) t3(a), range(1, 22) t4(b)),
cc AS (SELECT g.i, g.j, g.a, g.b, coalesce(t.k, 0) / n::DOUBLE - coalesce(x.k, 0) / n::DOUBLE * (coalesce(y.k, 0) / n::DOUBLE) AS c FROM g CROSS JOIN n LEFT JOIN t ON t.i = g.i AND t.j = g.j AND t.a = g.a AND t.b = g.b LEFT JOIN o x ON x.pos = g.i AND x.code = g.a LEFT JOIN o y ON y.pos = g.j AND y.code = g.b)"""


@query(f"WITH {_ALL} SELECT i, j, a, b, round(c, 6) + 0.0e0 AS c FROM cc WHERE i <> j")
def offdiagonal_corr(spark, d):
    c = stats.off_diagonal(stats.site_pairs_corr(stats.long_form(alignment(spark, d)), WIDTH))
    return c.select("i", "j", "a", "b", r6("c"))


@query(f"WITH {_ALL}, s AS (SELECT i, j, CASE WHEN i = j THEN 0 ELSE sqrt(sum(c * c)) END AS s FROM cc GROUP BY i, j) SELECT round(avg(s), 6) AS mean_all, round(avg(s) FILTER (i <> j), 6) AS mean_off FROM s")
def diagonal_means(spark, d):
    s = stats.zero_diagonal(stats.coupling_strength(stats.site_pairs_corr(stats.long_form(alignment(spark, d)), WIDTH)), "strength")
    return s.agg(F.round(F.avg("strength"), 6).alias("mean_all"), F.round(F.avg(F.when(F.col("i") != F.col("j"), F.col("strength"))), 6).alias("mean_off"))


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_COV = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(covar_samp({a}, {b}), 4) + 0.0e0 AS cov, round(corr({a}, {b}), 6) AS r FROM lineitem" for k, a in enumerate(_NUM) for b in _NUM[k + 1 :])


@query(_COV)
def covariances(spark, d):
    return stats.covariances(table(spark, d, "lineitem"), list(_NUM)).select("x", "y", (F.round("cov", 4) + 0.0).alias("cov"), F.round("r", 6).alias("r"))


@query("WITH f AS (SELECT doc_id AS hk, quality = 1 AS hit, doc_id % 2 = 0 AS side FROM labels) SELECT k AS subset, coalesce(round(avg(hit::INT), 6), 0)::DOUBLE AS tp, count(hk) AS n FROM (VALUES (0), (1), (2)) v(k) LEFT JOIN f ON k = 0 OR (k = 1 AND side) GROUP BY 1")
def tp_on_subsets(spark, d):
    """All rows, the even ones, and none."""
    lab = table(spark, d, "labels")
    found = lab.select(F.col("doc_id").alias("hk"), F.when(F.col("quality") == 1, F.col("doc_id")).otherwise(-1).alias("rr"))
    even = lab.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("row_id"))
    parts = [pairing.tp_fraction(found), pairing.tp_fraction(found, even), pairing.tp_fraction(found, even.limit(0))]
    out = [p.select(F.lit(k).alias("subset"), F.round("tp", 6).alias("tp"), "n") for k, p in enumerate(parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


_SW = f"WITH {_ALN}, s AS (SELECT seq, count(*) AS c FROM aln GROUP BY 1), w AS (SELECT x.seq, 1.0e0 / sum(y.c) AS w FROM s x, s y WHERE {_HAM} <= 1 GROUP BY 1), sw AS (SELECT species, count(*) AS k, sum(w) AS weight FROM aln JOIN w USING (seq) GROUP BY 1)"


@query(f"{_SW} SELECT species, k, round(weight, 6) AS weight, round(weight / k, 6) AS per_row FROM sw")
def species_weights(spark, d):
    a = alignment(spark, d)
    return stats.species_weight(a, stats.sequence_weights(a, WIDTH, 1)).select("species", "k", r6("weight"), r6("per_row"))


@query(f"{_SW}, o AS (SELECT species, round(weight / k, 6) AS p FROM sw) (SELECT species, 'head' AS \"end\" FROM o ORDER BY p, species LIMIT 4) UNION ALL (SELECT species, 'tail' FROM o ORDER BY p DESC, species DESC LIMIT 4)")
def redundancy_ends(spark, d):
    """The most and the least redundant species."""
    return rank.ends(species_weights(spark, d), ["per_row", "species"], 4).select("species", "end")


@query(f"WITH {_ALN}, v AS (SELECT row_id, pos, 1 + (code + (row_id * r) % 3) % 21 AS code FROM lf, range(1, 6) t(r)), c AS (SELECT row_id, pos, code, count(*) AS k FROM v GROUP BY ALL) SELECT row_id, pos, code::INT AS code FROM c QUALIFY row_number() OVER (PARTITION BY row_id, pos ORDER BY k DESC, code) = 1")
def majority_vote(spark, d):
    long = evaluate.tiled(stats.long_form(alignment(spark, d)), 5)
    v = long.withColumn("code", (1 + (F.col("code") + (F.col("row_id") * F.col("replica")) % 3) % 21).cast("int"))
    return evaluate.majority(v, ["row_id", "pos"])


@query(f"WITH {_ALN}, s AS (SELECT row_id, coalesce(lag(row_id) OVER (PARTITION BY species ORDER BY row_id), max(row_id) OVER (PARTITION BY species)) AS partner FROM aln) SELECT row_id, round(avg((x.code = y.code)::INT), 6) AS rate FROM s JOIN lf x USING (row_id) JOIN lf y ON y.row_id = s.partner AND y.pos = x.pos GROUP BY 1")
def row_match_rates(spark, d):
    a = alignment(spark, d)
    x = stats.long_form(a)
    y = x.select(F.col("row_id").alias("partner"), "pos", F.col("code").alias("other"))
    return groups.shift_partner(a).join(x, "row_id").join(y, ["partner", "pos"]).groupBy("row_id").agg(F.round(F.avg((F.col("code") == F.col("other")).cast("double")), 6).alias("rate"))


@query("SELECT l_linenumber AS unit, round(avg((l_discount - 0.05e0 > 1e-9)::INT), 6) AS rate FROM lineitem GROUP BY 1")
def firing_rates(spark, d):
    return stats.firing_rate(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("unit"), (F.col("l_discount") - 0.05).alias("h")), 1e-9).select("unit", F.round("rate", 6).alias("rate"))


_T = "SELECT event_type AS source, avg(value) / max(value) AS r, count(*) FILTER (value IS NULL OR value < 0.05 * (SELECT max(value) FROM events)) AS low FROM events GROUP BY 1"


@query(f"WITH t AS ({_T}) SELECT source, CASE WHEN r > 0.8 THEN 'generalizes' WHEN r > 0.4 THEN 'partial' ELSE 'not yet' END AS verdict, CASE WHEN r > 0.05 THEN 'live' ELSE 'died out' END AS gradient, CASE WHEN r - 0.35e0 > 0.1 THEN 'overfits' ELSE 'agrees' END AS gap, low FROM t")
def verdicts(spark, d):
    e = table(spark, d, "events")
    top = e.agg(F.max("value")).first()[0]
    rate = F.when((F.col("value") < 0.05 * top) | F.col("value").isNull(), 0.0).otherwise(0.5)
    t = e.groupBy(F.col("event_type").alias("source")).agg((F.avg("value") / F.max("value")).alias("r"), logs.dead_count(rate).alias("low"))
    r = F.col("r")
    return t.select("source", logs.correlation_verdict(r).alias("verdict"), logs.gradient_verdict(r).alias("gradient"), logs.gap_verdict(r, F.lit(0.35)).alias("gap"), "low")


@query("SELECT user_id % 7 AS sweep, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1")
def energy_trace(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("sweep"), F.col("value").alias("free_energy"))
    return evaluate.free_energy_trace(e).select("sweep", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {_BOTH} SELECT 7 AS k, i, j FROM x WHERE x.k = 7")
def kth_cell(spark, d):
    """The cell that the seventh largest strength belongs to."""
    _, x, _ = _halves(spark, d)
    return rank.kth_largest(x, 7).join(x, F.col("strength") == F.col("threshold")).orderBy("j", "i").limit(1).select(F.col("k").cast("int").alias("k"), "i", "j")


@query("WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT 'intersect' AS op, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'setdiff', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'vcat', count(*) FROM (SELECT k FROM a UNION ALL SELECT k FROM b) UNION ALL SELECT 'unique', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)")
def set_operations(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    a, b = (o.filter(F.col("o_orderstatus") == s).select("k") for s in "FO")
    made = {"intersect": a.intersect(b), "setdiff": a.distinct().join(b, "k", "left_anti"), "vcat": a.unionByName(b), "unique": a.unionByName(b).distinct()}
    out = [x.agg(F.lit(k).alias("op"), F.count("*").alias("n")) for k, x in made.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT event_type, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, round(arg_max(value, (ts, event_id)) / nullif(arg_min(value, (ts, event_id)), 0), 6) AS ratio FROM events WHERE value IS NOT NULL GROUP BY 1")
def growth_ratio(spark, d):
    return logs.growth(table(spark, d, "events").filter("value IS NOT NULL"), ["event_type"], ["ts", "event_id"], "value").withColumn("ratio", F.round("ratio", 6))


_MD5 = lambda seed, n="doc_id": f"ORDER BY md5('{seed}:' || {n}), {n}"


@query(f"SELECT doc_id AS row_id, CASE WHEN row_number() OVER ({_MD5(3)}) <= (SELECT count(*) * 4 // 5 FROM documents) THEN 'train' ELSE 'val' END AS split FROM documents")
def exact_split(spark, d):
    return sampling.exact_split(alignment(spark, d), 3, 4, 5)


@query(f"SELECT doc_id AS row_id FROM documents QUALIFY row_number() OVER ({_MD5(8)}) <= (SELECT count(*) * 3 // 10 FROM documents)")
def paired_subsample(spark, d):
    return sampling.paired_subsample(alignment(spark, d).select("row_id"), 8, num=3, den=10)


@query(f"SELECT doc_id AS row_id FROM documents QUALIFY row_number() OVER ({_MD5(12)}) <= 77")
def row_sample(spark, d):
    """A sample of a fixed size is what this operator is for."""
    return sampling.first_n(alignment(spark, d).select("row_id"), 77, 12)


@query(f"SELECT doc_id AS row_id, ((row_number() OVER ({_MD5('1:4')}) - 1) // 32)::INT AS batch, ((row_number() OVER ({_MD5('1:4')}) - 1) % 32)::INT AS slot FROM documents QUALIFY batch < (SELECT count(*) // 32 FROM documents)")
def minibatches(spark, d):
    return sampling.minibatches(alignment(spark, d), 1, 4, 32)


@query(f"WITH {_ALN} SELECT row_id, 1.0e0 AS w FROM aln")
def unweighted(spark, d):
    return sampling.maybe_weights(alignment(spark, d), None)


@query(f"WITH {_ALN}, s AS (SELECT seq, row_id % 2 = 1 AS t FROM aln GROUP BY ALL), b AS (SELECT x.seq, max(({WIDTH} - ({_HAM})) / {WIDTH}.0e0) AS m FROM s x, s y WHERE NOT x.t AND y.t GROUP BY 1) SELECT round(avg((m >= 0.95)::INT), 6) AS near_copies, round(avg(m), 6) AS mean_identity FROM aln JOIN b USING (seq) WHERE row_id % 2 = 0")
def novelty(spark, d):
    a = alignment(spark, d)
    out = geometry.novelty(a.filter("row_id % 2 = 0"), a.filter("row_id % 2 = 1"), S.GAP_FIRST)
    return out.select(F.round("near_copies", 6).alias("near_copies"), F.round("mean_identity", 6).alias("mean_identity"))


_SP = "WITH e AS (SELECT c::INT AS component, embedding[c]::DOUBLE AS value, label >= 5 AS made FROM embeddings, range(1, 5) t(c))"


@query(f"{_SP} SELECT component, round(stddev_samp(value) FILTER (NOT made), 6) AS real_std, round(stddev_samp(value) FILTER (made), 6) AS made_std, round(stddev_samp(value) FILTER (made) / stddev_samp(value) FILTER (NOT made), 6) AS ratio, round(min(value) FILTER (NOT made), 6) AS real_low, round(max(value) FILTER (NOT made), 6) AS real_high, round(min(value) FILTER (made), 6) AS made_low, round(max(value) FILTER (made), 6) AS made_high FROM e GROUP BY 1")
def spread(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") >= 5).alias("made"), F.posexplode(F.slice("embedding", 1, 4)).alias("component", "value"))
    out = geometry.spread(e.select((F.col("component") + 1).alias("component"), F.col("value").cast("double").alias("value"), "made"))
    return out.select("component", *[F.round(c, 6).alias(c) for c in ("real_std", "made_std", "ratio", "real_low", "real_high", "made_low", "made_high")])


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS j, len(embedding) AS n FROM embeddings), m AS (SELECT j, avg(x) AS m FROM x GROUP BY 1)
SELECT vec_id, c::INT AS component, round(sum((x - m) * CASE bit_count((c - 1) & (j - 1)) % 2 WHEN 0 THEN 1 ELSE -1 END / sqrt(n::DOUBLE)), 5) + 0.0e0 AS value FROM x JOIN m USING (j), range(1, 65) t(c) GROUP BY vec_id, c""")
def projection(spark, d):
    """Centred projection on a full basis: as many axes of signs as the vectors are wide."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    width = e.select(F.size("embedding")).first()[0]
    mean = e.select(F.posexplode("embedding").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda z: z["m"]).alias("mean"))
    sign = lambda j: F.when(F.bit_count((F.col("id") - 1).bitwiseAND(j - 1)) % 2 == 0, 1.0).otherwise(-1.0) / F.sqrt(F.lit(float(width)))
    axes = spark.range(1, width + 1).select(F.col("id").cast("int").alias("component"), F.transform(F.sequence(F.lit(1).cast("long"), F.lit(width).cast("long")), sign).alias("loadings"))
    return geometry.project(e, axes.crossJoin(mean)).select("vec_id", "component", (F.round("value", 5) + 0.0).alias("value"))


@query(f"""WITH {_ALN}, fw AS (SELECT row_id, m, 1 / (1 + exp(-(m / 10.0e0 + sum({_W})))) AS h FROM lf, (VALUES (1), (2)) mm(m) GROUP BY row_id, m),
sd AS (SELECT row_id, CASE row_id % 2 WHEN 0 THEN 1 ELSE -1 END / sum(1.0e0) OVER (PARTITION BY row_id % 2) AS s FROM aln),
gd AS (SELECT pos AS i, code AS a, 0 AS k, sum(s) AS v FROM lf JOIN sd USING (row_id) GROUP BY ALL UNION ALL SELECT 0, 0, m, sum(s * h) FROM fw JOIN sd USING (row_id) GROUP BY ALL UNION ALL SELECT pos, code, m, sum(s * h) FROM lf JOIN fw USING (row_id) JOIN sd USING (row_id) GROUP BY ALL),
cl AS (SELECT pos::INT AS pos, code::INT AS code, m::INT AS m FROM range(0, {WIDTH + 1}) t(pos), range(0, 22) u(code), range(0, 3) w(m) WHERE (pos > 0) = (code > 0) AND (pos > 0 OR m > 0))
SELECT pos AS site, code AS state, m AS unit, round(coalesce(v, 0) - CASE WHEN pos > 0 AND m > 0 THEN 0.001e0 * ({_W}) ELSE 0 END, 7) + 0.0e0 AS gradient FROM cl LEFT JOIN gd ON gd.i = pos AND gd.a = code AND gd.k = m""")
def gradient_step(spark, d):
    """One gradient of a machine: its expectations over a fixed batch, less those over fixed chains and the penalty. Site 0: a unit's own; unit 0: a state's own."""
    a = alignment(spark, d).select("row_id", S.codes(F.col("seq")).alias("codes"))
    m = fixed_rbm()
    (gv, gh, gw), (cv, ch, cw) = (rbm.moments(a.filter(F.col("row_id") % 2 == r), m) for r in (0, 1))
    w = gw - cw - 1e-3 * m.w
    rows = [(i + 1, s + 1, 0, float(x)) for (i, s), x in np.ndenumerate(gv - cv)] + [(0, 0, u + 1, float(x)) for u, x in enumerate(gh - ch)]
    rows += [(i + 1, s + 1, u + 1, float(x)) for (i, s, u), x in np.ndenumerate(w)]
    return spark.createDataFrame(rows, "site int, state int, unit int, gradient double").withColumn("gradient", F.round("gradient", 7) + 0.0)


@query(f"WITH {_BOTH.replace('SELECT i, j, row_number()', 'SELECT i, j, strength, row_number()')} SELECT * FROM (SELECT 'data' AS source, 1.0e0 AS r, 1.0e0 AS overlap, 5 AS hits, 0 AS missed, 0 AS false_alarms UNION ALL SELECT 'model', round(corr(x.strength, y.strength), 6), count(*) FILTER (x.k <= 5 AND y.k <= 5) / 5.0e0, count(*) FILTER (x.k <= 5 AND y.k <= 5), count(*) FILTER (x.k <= 5 AND y.k > 5), count(*) FILTER (x.k > 5 AND y.k <= 5) FROM x JOIN y USING (i, j))")
def strengths_report(spark, d):
    """One half of the rows against the other, as data against a model's samples."""
    a, _, _ = _halves(spark, d)
    out = evaluate.strengths_report({"data": a.filter("even"), "model": a.filter("NOT even")}, WIDTH, LEFT, 0.3)
    return out.select("source", F.round("r", 6).alias("r"), "overlap", "hits", "missed", "false_alarms")


@query("SELECT event_id AS iter, ((event_id % 97) + 0.5e0) / 100 AS mean_diff, (event_id % 7)::DOUBLE AS h1, 1e-3::DOUBLE + 0 * event_id AS low, greatest(event_id % 3, 0.001)::DOUBLE AS top FROM events")
def log_checkpoints(spark, d):
    """Typed rows of checkpoint lines."""
    t = table(spark, d, "events").select(F.expr(_LINE).alias("line"))
    x = F.col("line")
    m = S.kv_map(x, "drift")
    return logs._checkpoints(t, mean_diff=F.round(S.kv_scalar(x, "mean_diff"), 6), h1=S.kv_array(x, "h")[0], low=m["v"], top=F.array_max(F.map_values(m)))


def _chains(spark, d):
    a = materialize(alignment(spark, d).select("row_id", "species", "seq", S.codes(F.col("seq")).alias("codes")), "alignment")
    return a, rbm.train(a, rbm.RBM.start(WIDTH, S.STATES, 4), 2)


@query()
def chain_trace(spark, d):
    """Chains from random states: how their means come to agree with the rows'."""
    a, m = _chains(spark, d)
    c = rbm.chains(rbm.fresh_chains(spark, m, 200), m, 3, 5)
    return spark.createDataFrame([tuple(map(float, r)) for r in evaluate.convergence(c, a, m)], "sweep double, r_h double, r_v double, r_hv double")


#: The published training: steps, and rows of each. A table that these do not go through twice gets as many steps as that takes.
STEPS, BATCH = 10_000, 256


@query()
def clamped_generation(spark, d):
    """The right half generated from the left one, against its own and a wrong partner."""
    a = materialize(alignment(spark, d).select("row_id", "species", "seq", S.codes(F.col("seq")).alias("codes")), "alignment")
    steps = max(STEPS, -(-2 * a.count() // BATCH))
    m = rbm.train(a, rbm.RBM.start(WIDTH, S.STATES, 4), steps, batch=BATCH)
    keep = list(range(1, LEFT + 1))
    return evaluate.clamped_mode_report(evaluate.clamped_modes(a, m, keep, 3, 5), a, keep)


@query()
def joint_training(spark, d):
    """A joint model over two frozen halves: what is watched, on data and on chains, while its own units learn."""
    a = alignment(spark, d).select("row_id", S.codes(F.col("seq")).alias("codes"))
    left, right = fixed_rbm(LEFT), fixed_rbm(WIDTH - LEFT, LEFT)
    rows = []
    # a batch of the data, and one held out from it, that the chains are compared with: 500 rows each at most
    data, heldout = (np.array([r.codes for r in sampling.first_n(a.filter(F.col("row_id") % 2 == side), 500, 1).orderBy("row_id").collect()]) - 1 for side in (0, 1))

    def watch(k, m, x, grad):
        rows.extend((k, *z) for z in train.diagnostics(m, data, x, LEFT, 4, heldout, grad))

    train.train(a, train.joint(left, right, 3), 3, batch=500, clip=1.0, frozen=(left, right), callback=watch)
    return spark.createDataFrame(rows, "iter int, check string, name string, value double")
