"""Candidate pools, hybrid scores and discovery arms of all profiles."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.functions.scalars import mixed_modulo
from lumenframe.operators import discovery as D
from lumenframe.operators import profiles as P
from lumenframe.operators import recommend as C
from lumenframe.operators import vectors as V
from lumenframe.operators.relational import top_per_key
from lumenframe.plans.base import Registry
from lumenframe.plans.scalar_queries import _MIX as MIX_SQL
from lumenframe.storage import materialize
from lumenframe.tables import table

_r = Registry()
query = _r.query
#: Votes from which a title is known, and the bounds of deep cuts and canon; the catalogue of these tables has few votes.
KNOWN, DEEP, CANON = 20, (20, 60), 100

_BASE = r"""WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), n AS (SELECT count(*) AS n FROM e),
t AS (SELECT item_id AS item, max(title) AS title, max(year) AS year, max(rating) AS rating, max(votes) AS votes, max(runtime_minutes) AS minutes, max(genres) AS genres, max(imdb_id) AS imdb_id FROM media_items GROUP BY 1),
tv AS (SELECT item, v, label AS mode FROM t, n JOIN e ON vec_id = item % n),
cx AS (SELECT label, pos, sum(x) AS x FROM (SELECT label, unnest(range(1, len(v) + 1)) AS pos, unnest(v) / sqrt(list_dot_product(v, v)) AS x FROM e) GROUP BY 1, 2), c AS (SELECT label AS mode, list(x ORDER BY pos) AS c FROM cx GROUP BY 1),
close AS (SELECT c.mode, item, round(list_cosine_similarity(c, v), 6) AS cos FROM c, tv),
d AS (SELECT DISTINCT rec_id, profile_id AS profile, item_id AS item, loved_with FROM recommendations WHERE profile_id IS NOT NULL),
x AS (SELECT profile, item, l.x.item_id AS loved, l.x.score AS s FROM d, unnest(loved_with) AS l(x) WHERE l.x.score IS NOT NULL AND l.x.item_id IS NOT NULL),
loved AS (SELECT profile, loved AS item, round(sum(s), 6) AS w FROM x GROUP BY 1, 2), led AS (SELECT profile, item, round(sum(s), 6) AS s FROM x WHERE item IS NOT NULL GROUP BY 1, 2),
mo AS (SELECT profile, mode, round(sum(w), 6) AS w, CAST(row_number() OVER (PARTITION BY profile ORDER BY round(sum(w), 6) DESC, mode) AS INT) AS rank FROM loved JOIN tv USING (item) GROUP BY 1, 2 QUALIFY rank <= 8),
bound AS (SELECT mode, min(cos) AS bound FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY cos DESC, item) AS place FROM close) WHERE place <= 1000 GROUP BY 1), inside AS (SELECT close.* FROM close JOIN bound USING (mode) WHERE cos >= bound),
mk AS (SELECT item, array_to_string(regexp_split_to_array(trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(title), '(?::| - ).*$', ''), ' '), '^the ', ''), ' (?:\d+|ii|iii|iv|v)$', ''), ' '), '\s+')[1:2], ' ') AS maker FROM t WHERE title IS NOT NULL)
"""


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per title: item, title, year, rating, votes, minutes, genres, imdb_id."""
    rows = table(spark, folder, "media_items")
    return rows.groupBy(F.col("item_id").alias("item")).agg(*[F.max(c).alias(a) for c, a in (("title", "title"), ("year", "year"), ("rating", "rating"), ("votes", "votes"), ("runtime_minutes", "minutes"), ("genres", "genres"), ("imdb_id", "imdb_id"))])


class _Gathered:
    """What all arms read: titles with their modes, closeness, and each profile's loves, modes and leads; written once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.titles = materialize(_facts(spark, folder), "titles")
        own = table(spark, folder, "embeddings").dropDuplicates(["vec_id"]).select("vec_id", F.col("embedding").alias("v"), F.col("label").alias("mode"))
        n = max(own.count(), 1)
        self.mode_of = self.titles.select("item", F.pmod("item", F.lit(n)).alias("vec_id")).join(own.select("vec_id", "mode"), "vec_id").select("item", "mode")
        centres = V.mean_vectors(own, "mode", "v", F.lit(1.0)).withColumnRenamed("mean", "c")
        self.vectors, self.n = own, n
        #: Titles of one vector are as close to a mode as it is.
        self.vector_close = materialize(D.closeness(own.select(F.col("vec_id").alias("item"), "v"), centres, V.cosine(F.col("c"), F.col("v"))).withColumnRenamed("item", "vec_id"), "closeness")
        shown = table(spark, folder, "recommendations").filter("profile_id is not null").select("rec_id", F.col("profile_id").alias("profile"), F.col("item_id").alias("item"), "loved_with").distinct()
        x = shown.select("profile", "item", F.explode("loved_with").alias("x")).select("profile", "item", F.col("x.item_id").alias("loved"), F.col("x.score").alias("s")).dropna(subset=["loved", "s"])
        x = materialize(x, "leads")
        self.loved = materialize(x.groupBy("profile", F.col("loved").alias("item")).agg(F.round(F.sum("s"), 6).alias("w")), "loved")
        self.led = x.filter("item is not null").groupBy("profile", "item").agg(F.round(F.sum("s"), 6).alias("s"))
        self.modes = materialize(D.profile_modes(self.loved, self.mode_of), "modes")
        self.makers = self.titles.filter("title is not null").select("item", T.franchise_key(F.col("title")).alias("maker"))
        self.texts = table(spark, folder, "documents").select("imdb_id")

    @cached_property
    def close(self) -> DataFrame:
        """(mode, item, cos), made from the vectors' closeness as it is read."""
        each = self.vector_close.groupBy("vec_id").agg(F.collect_list(F.struct("mode", "cos")).alias("near"))
        return self.titles.select("item", F.pmod("item", F.lit(self.n)).alias("vec_id")).join(each, "vec_id").select("item", F.inline("near")).select("mode", "item", "cos")

    @cached_property
    def inside(self) -> DataFrame:
        return materialize(D.close_enough(self.close), "inside")

    def by_profile(self, modes: DataFrame | None = None) -> tuple[DataFrame, str]:
        """The profiles' rows, and where the titles are that their tasks read."""
        path = P.pack(self.titles, self.makers, self.regions(), self.texts, self.vectors, self.vector_close, KNOWN)
        return P.profile_rows(self.loved, self.led, self.modes if modes is None else modes), path

    def regions(self) -> DataFrame:
        decade = self.titles.filter("year is not null").select("item", F.lit("decade").alias("axis"), F.expr("cast(year div 10 * 10 as string)").alias("region"))
        genre = self.titles.select("item", F.lit("genre").alias("axis"), F.explode(F.split("genres", ",")).alias("region")).withColumn("region", F.trim("region"))
        return decade.unionByName(genre).filter("region <> ''").distinct()


_POOL = _BASE + """, nr AS (SELECT mode, item, row_number() OVER (PARTITION BY mode ORDER BY cos DESC, item) AS place FROM close QUALIFY place <= 200),
a AS (SELECT profile, item, 0 AS list, row_number() OVER (PARTITION BY profile ORDER BY place, turn, item) AS pos FROM (SELECT profile, item, place, rank AS turn FROM mo JOIN nr USING (mode) QUALIFY row_number() OVER (PARTITION BY profile, item ORDER BY place, rank) = 1) QUALIFY pos <= 500),
b AS (SELECT profile, item, 1 AS list, row_number() OVER (PARTITION BY profile ORDER BY s DESC, item) AS pos FROM led QUALIFY pos <= 400),
wk AS (SELECT maker, item, votes FROM mk JOIN t USING (item) QUALIFY row_number() OVER (PARTITION BY maker ORDER BY votes DESC NULLS LAST, item) <= 150), pm AS (SELECT profile, maker, count(DISTINCT item) AS n FROM loved JOIN mk USING (item) GROUP BY 1, 2),
m AS (SELECT profile, item, 2 AS list, row_number() OVER (PARTITION BY profile ORDER BY n DESC, votes DESC NULLS LAST, item) AS pos FROM (SELECT profile, item, votes, max(n) AS n FROM pm JOIN wk USING (maker) GROUP BY 1, 2, 3) QUALIFY pos <= 150),
pp AS (SELECT item, row_number() OVER (ORDER BY votes DESC NULLS LAST, item) AS pos FROM t QUALIFY pos <= 100), p AS (SELECT profile, item, 3 AS list, pos FROM (SELECT DISTINCT profile FROM mo), pp),
pool AS (SELECT profile, item, CAST(list AS INT) AS list, CAST(pos AS INT) AS pos FROM (FROM a UNION ALL FROM b UNION ALL FROM m UNION ALL FROM p) ANTI JOIN loved USING (profile, item) QUALIFY row_number() OVER (PARTITION BY profile, item ORDER BY list, pos) = 1)
"""


@query("op_r05_candidate_pool", _POOL + "SELECT profile, item, list, pos FROM pool")
def candidate_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Every profile's candidates: near its modes, loved-with, by makers (titles of one franchise), popular; less what it loved."""
    return P.pools(*_Gathered(spark, folder).by_profile())


_SCORED = _POOL + """, nrm AS (SELECT profile, item, max(cos) AS cos FROM pool JOIN mo USING (profile) JOIN close USING (mode, item) GROUP BY 1, 2), ml AS (SELECT profile, max(s) AS most FROM led GROUP BY 1), mp AS (SELECT profile, max(n) AS most FROM pm GROUP BY 1),
mv AS (SELECT ln(1 + max(votes)) AS most FROM t), tx AS (SELECT item, axis, region FROM (SELECT item, 'decade' AS axis, CAST(year // 10 * 10 AS VARCHAR) AS region FROM t UNION ALL SELECT item, 'genre', trim(g.g, ' ') FROM t, unnest(string_split(genres, ',')) AS g(g)) WHERE region <> '' GROUP BY ALL),
sh AS (SELECT profile, axis, region, w / sum(w) OVER (PARTITION BY profile, axis) AS share FROM (SELECT profile, axis, region, sum(w) AS w FROM loved JOIN tx USING (item) GROUP BY 1, 2, 3)),
ax AS (SELECT profile, item, least(1, sum(share)) AS axes FROM (SELECT profile, item, axis, max(share) AS share FROM pool JOIN tx USING (item) JOIN sh USING (profile, axis, region) GROUP BY 1, 2, 3) GROUP BY 1, 2),
terms AS (SELECT profile, item, round(coalesce((cos + 1) / 2, 0) + 1e-12, 9)::DOUBLE AS near, round(0.5 * coalesce(s / ml.most, 0) + 1e-12, 9)::DOUBLE AS loved, round(0.1 * coalesce(pm.n::DOUBLE / mp.most, 0) + 1e-12, 9)::DOUBLE AS people, round(0.2 * coalesce(axes, 0) + 1e-12, 9)::DOUBLE AS axes, CASE WHEN dc.imdb_id IS NOT NULL THEN 0.1 ELSE 0 END::DOUBLE AS playable
  FROM pool LEFT JOIN nrm USING (profile, item) LEFT JOIN led USING (profile, item) LEFT JOIN ml USING (profile) LEFT JOIN mk USING (item) LEFT JOIN pm USING (profile, maker) LEFT JOIN mp USING (profile) LEFT JOIN ax USING (profile, item) LEFT JOIN t USING (item) LEFT JOIN (SELECT DISTINCT imdb_id FROM documents) dc USING (imdb_id)),
mid AS (SELECT profile, quantile_disc(near, 0.5) AS near, quantile_disc(loved, 0.5) AS loved, quantile_disc(people, 0.5) AS people, quantile_disc(axes, 0.5) AS axes, quantile_disc(playable, 0.5) AS playable FROM terms GROUP BY 1),
lift AS (SELECT x.profile, item, round(x.near + x.loved + x.people + x.axes + x.playable, 9) AS score, round(x.near - y.near, 9) AS l1, round(x.loved - y.loved, 9) AS l2, round(x.people - y.people, 9) AS l3, round(x.axes - y.axes, 9) AS l4, round(x.playable - y.playable, 9) AS l5 FROM terms x JOIN mid y USING (profile))
"""


@query("op_r07_hybrid_score", _SCORED + """SELECT profile, item, score, CASE WHEN greatest(l1, l2, l3, l4, l5) <= 0 THEN NULL WHEN l1 = greatest(l1, l2, l3, l4, l5) THEN 'near' WHEN l2 = greatest(l1, l2, l3, l4, l5) THEN 'loved'
  WHEN l3 = greatest(l1, l2, l3, l4, l5) THEN 'people' WHEN l4 = greatest(l1, l2, l3, l4, l5) THEN 'axes' ELSE 'playable' END AS reason FROM lift""")
def hybrid_score(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate's score and why it stands out (R07; R16's relevance is its first terms)."""
    return P.scored(*_Gathered(spark, folder).by_profile())


@query("op_r08_rails")
def rails(spark: SparkSession, folder: str) -> DataFrame:
    """Diversified rails of ten for every profile from its sixty best candidates: two per franchise, five per year, and of each
    mode no more than its quota."""
    g = _Gathered(spark, folder)
    places = C.quotas(g.modes, ["profile"], "mode", "w", P.RAIL)
    return P.rails(*g.by_profile(places))


@query("op_r18_gather", _BASE + "SELECT mode, count(*) AS titles, round(min(cos), 6) AS bound FROM inside GROUP BY 1")
def gather(spark: SparkSession, folder: str) -> DataFrame:
    """How many titles are close to each mode, and how close the last is."""
    return _Gathered(spark, folder).inside.groupBy("mode").agg(F.count(F.lit(1)).alias("titles"), F.round(F.min("cos"), 6).alias("bound"))


_REGIONS = """, tx AS (SELECT item, axis, region FROM (SELECT item, 'decade' AS axis, CAST(year // 10 * 10 AS VARCHAR) AS region FROM t UNION ALL SELECT item, 'genre', trim(g.g, ' ') FROM t, unnest(string_split(genres, ',')) AS g(g)) WHERE region <> '' GROUP BY ALL)
"""
_STRETCH = _BASE + _REGIONS + """, ta AS (SELECT DISTINCT profile, mode, axis, region FROM loved JOIN tv USING (item) JOIN mo USING (profile, mode) JOIN tx USING (item)),
pi AS (SELECT profile, mode, item, cos FROM mo JOIN inside USING (mode) JOIN t USING (item) WHERE votes >= 20 AND NOT EXISTS (SELECT 1 FROM loved l WHERE l.profile = mo.profile AND l.item = t.item)),
nw AS (SELECT pi.profile, pi.mode, pi.item, tx.axis, tx.region FROM pi JOIN tx USING (item) SEMI JOIN (SELECT DISTINCT profile, mode, axis FROM ta) k USING (profile, mode, axis)),
ou AS (SELECT profile, mode, item, min(region) AS region FROM nw ANTI JOIN ta USING (profile, mode, axis, region) GROUP BY 1, 2, 3 HAVING count(DISTINCT axis) = 1),
st AS (SELECT profile, mode, item, region, CAST(row_number() OVER (PARTITION BY profile, mode ORDER BY cos DESC, item) AS INT) AS pos FROM ou JOIN pi USING (profile, mode, item) QUALIFY pos <= 10)
"""


@query("op_r11_stretch", _STRETCH + "SELECT profile, mode, item, region, pos FROM st")
def stretch(spark: SparkSession, folder: str) -> DataFrame:
    """Known titles close to a mode of a profile that leave it by decade or by genre alone."""
    return P.stretched(*_Gathered(spark, folder).by_profile())


@query("op_r10_labels", _STRETCH + "SELECT count(*) AS labels, 0::BIGINT AS untrue FROM st")
def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch label judged again from its definition: how many there are, and how many don't hold."""
    return P.judged(*_Gathered(spark, folder).by_profile())


@query("op_r12_bridge", _BASE + """, pr AS (SELECT a.mode AS one, b.mode AS two, count(*) AS bridges FROM inside a JOIN inside b ON a.item = b.item AND a.mode < b.mode GROUP BY 1, 2)
  SELECT * FROM (SELECT x.profile, one, two, bridges, CAST(row_number() OVER (PARTITION BY x.profile ORDER BY bridges DESC, one, two) AS INT) AS rank FROM mo x JOIN mo y ON x.profile = y.profile AND x.mode < y.mode JOIN pr ON one = x.mode AND two = y.mode) WHERE rank <= 3""")
def bridge(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a profile's modes by how many titles lie in both; pairs of modes are counted once for all profiles."""
    g = _Gathered(spark, folder)
    few = g.inside.groupBy("item").agg(F.array_sort(F.collect_set("mode")).alias("ms"))  # a title's modes are few
    pairs = few.select(F.posexplode("ms").alias("at", "one"), "ms").select("one", F.explode(F.slice("ms", F.col("at") + 2, F.size("ms"))).alias("two")).groupBy("one", "two").agg(F.count(F.lit(1)).alias("bridges"))
    own = g.modes.select("profile", F.col("mode").alias("one")).join(g.modes.select("profile", F.col("mode").alias("two")), "profile").filter("one < two")
    return top_per_key(own.join(pairs, ["one", "two"]), ["profile"], [F.col("bridges").desc(), F.col("one"), F.col("two")], 3).select("profile", "one", "two", "bridges", "rank")


@query("op_r13_blind_spot", _BASE + _REGIONS + """, busy AS (SELECT profile FROM loved GROUP BY 1 HAVING count(*) >= 10), met AS (SELECT DISTINCT profile, region FROM loved JOIN tx USING (item)),
  good AS (SELECT region, item, round(rating / 100.0::DOUBLE + 0.1 * ln(1 + votes) / (SELECT ln(1 + max(votes)) FROM t), 6) AS rel FROM t JOIN tx USING (item) WHERE rating >= 75 AND votes >= 20),
  best AS (SELECT region, round(avg(rel), 6) AS mean, any_value(n) >= 5 AS enough FROM (SELECT *, count(*) OVER (PARTITION BY region) AS n, row_number() OVER (PARTITION BY region ORDER BY rel DESC, item) AS place FROM good) WHERE place <= 5 GROUP BY 1)
  SELECT profile, region, enough FROM (SELECT profile, region, enough, mean FROM busy, best) ANTI JOIN met USING (profile, region) QUALIFY row_number() OVER (PARTITION BY profile ORDER BY enough DESC, mean DESC, region) = 1""")
def blind_spot(spark: SparkSession, folder: str) -> DataFrame:
    """The best region that a profile of ten loves or more has never met: one with five good titles first, then by their mean.
    Regions are decades and genres, so their table is one row of a bounded list."""
    g = _Gathered(spark, folder)
    regions = materialize(g.regions(), "regions")
    most = g.titles.agg(F.log(1 + F.max("votes")).alias("most"))  # one row
    rel = F.round(F.col("rating") / 100 + 0.1 * F.log(1 + F.col("votes")) / F.col("most"), 6)
    good = g.titles.filter((F.col("rating") >= 75) & (F.col("votes") >= KNOWN)).join(F.broadcast(most)).select("item", rel.alias("rel")).join(regions, "item")
    own = Window.partitionBy("region")
    placed = good.withColumns({"n": F.count(F.lit(1)).over(own), "place": F.row_number().over(own.orderBy(F.col("rel").desc(), "item"))}).filter("place <= 5")
    best = placed.groupBy("region").agg(F.round(F.avg("rel"), 6).alias("mean"), (F.max("n") >= 5).alias("enough"))
    every = best.agg(F.collect_list(F.struct("region", "enough", "mean")).alias("all"))
    busy = g.loved.groupBy("profile").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10").select("profile")
    met = g.loved.join(regions, "item").select("profile", "region").distinct()
    left = busy.join(F.broadcast(every)).select("profile", F.explode("all").alias("x")).select("profile", "x.*").join(met, ["profile", "region"], "left_anti")
    return top_per_key(left, ["profile"], [F.col("enough").desc(), F.col("mean").desc(), F.col("region")], 1).select("profile", "region", "enough")


_NEAREST_MODE = """, ps AS (SELECT profile, item, max(cos) AS cos FROM mo JOIN inside USING (mode) JOIN t USING (item) WHERE {where} GROUP BY 1, 2)
"""


def _near(g: _Gathered, where: str) -> DataFrame:
    """(profile, item, cos): titles of a kind that are close to a mode of a profile."""
    kind = g.titles.filter(where).select("item")
    return g.modes.select("profile", "mode").join(g.inside.join(kind, "item"), "mode").groupBy("profile", "item").agg(F.max("cos").alias("cos"))


@query("op_r14_canon", _BASE + _NEAREST_MODE.format(where="rating >= 78 AND votes >= 100") + """SELECT profile, item, CAST(row_number() OVER (PARTITION BY profile ORDER BY cos DESC, item) AS INT) AS rank FROM ps ANTI JOIN loved USING (profile, item) QUALIFY rank <= 20""")
def canon(spark: SparkSession, folder: str) -> DataFrame:
    """The acclaimed and much voted titles close to what a profile loves, less what it knows."""
    g = _Gathered(spark, folder)
    fresh = _near(g, f"rating >= 78 and votes >= {CANON}").join(g.loved.select("profile", "item"), ["profile", "item"], "left_anti")
    return top_per_key(fresh, ["profile"], [F.col("cos").desc(), F.col("item")], 20).select("profile", "item", "rank")


@query("op_r15_deep_cut", _BASE + _NEAREST_MODE.format(where="rating >= 75 AND votes BETWEEN 20 AND 60") + """, lv AS (SELECT profile, item, s / max(s) OVER (PARTITION BY profile) AS share FROM led), dl AS (SELECT lv.* FROM lv JOIN t USING (item) WHERE rating >= 75 AND votes BETWEEN 20 AND 60),
  u AS (SELECT coalesce(ps.profile, dl.profile) AS profile, coalesce(ps.item, dl.item) AS item, CASE WHEN dl.item IS NOT NULL THEN 'loved' ELSE 'near' END AS label, coalesce((cos + 1) / 2, 0) + 0.5 * coalesce(share, 0) AS rel FROM ps FULL JOIN dl ON ps.profile = dl.profile AND ps.item = dl.item)
  SELECT profile, item, label, CAST(row_number() OVER (PARTITION BY profile ORDER BY round(rel + 0.1 * ln(1 + votes) / (SELECT ln(1 + max(votes)) FROM t), 6) DESC, item) AS INT) AS rank FROM u JOIN t USING (item) ANTI JOIN loved USING (profile, item) QUALIFY rank <= 20""")
def deep_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Good titles that few know, loved-with or close to a mode, by relevance."""
    g = _Gathered(spark, folder)
    where = f"rating >= 75 and votes between {DEEP[0]} and {DEEP[1]}"
    share = g.led.withColumn("share", F.col("s") / F.max("s").over(Window.partitionBy("profile"))).drop("s").join(g.titles.filter(where).select("item"), "item")
    both = _near(g, where).join(share, ["profile", "item"], "full").join(g.loved.select("profile", "item"), ["profile", "item"], "left_anti")
    most = g.titles.agg(F.log(1 + F.max("votes")).alias("most"))  # one row
    rel = F.coalesce((F.col("cos") + 1) / 2, F.lit(0.0)) + 0.5 * F.coalesce("share", F.lit(0.0)) + 0.1 * F.log(1 + F.col("votes")) / F.col("most")
    scored = both.join(g.titles.select("item", "votes"), "item").join(F.broadcast(most)).select("profile", "item", F.when(F.col("share").isNotNull(), "loved").otherwise("near").alias("label"), F.round(rel, 6).alias("rel"))
    return top_per_key(scored, ["profile"], [F.col("rel").desc(), F.col("item")], 20).select("profile", "item", "label", "rank")


@query("op_r27_onboarding", _BASE + """, nr AS (SELECT mode, item, row_number() OVER (PARTITION BY mode ORDER BY cos DESC, item) AS place FROM close QUALIFY place <= 60),
  ne AS (SELECT profile, item, row_number() OVER (PARTITION BY profile ORDER BY place, turn, item) AS pos FROM (SELECT profile, item, place, rank AS turn FROM mo JOIN nr USING (mode) ANTI JOIN loved USING (profile, item) QUALIFY row_number() OVER (PARTITION BY profile, item ORDER BY place, rank) = 1) QUALIFY pos <= 6),
  dc AS (SELECT item, row_number() OVER (PARTITION BY year // 10 ORDER BY votes DESC NULLS LAST, item) AS n, year // 10 AS d FROM t WHERE year BETWEEN 1920 AND 2029 QUALIFY n <= 12), sp AS (SELECT item, row_number() OVER (ORDER BY n, d DESC) AS spot FROM dc),
  rest AS (SELECT profile, item, row_number() OVER (PARTITION BY profile ORDER BY spot) AS pos FROM (SELECT p.profile, sp.item, spot FROM (SELECT DISTINCT profile FROM mo) p, sp) ANTI JOIN ne USING (profile, item) ANTI JOIN loved USING (profile, item)), cc AS (SELECT profile, count(*) AS n FROM ne GROUP BY 1)
  SELECT profile, item, CAST(pos AS INT) AS place FROM ne UNION ALL SELECT profile, item, CAST(pos + coalesce(n, 0) AS INT) FROM rest LEFT JOIN cc USING (profile) WHERE pos + coalesce(n, 0) <= 12""")
def onboarding(spark: SparkSession, folder: str) -> DataFrame:
    """A round of twelve titles to choose from for every profile: half near its modes, the rest the most voted of the decades in
    turn, nothing it loved. The decades' list has 132 titles at most."""
    g = _Gathered(spark, folder)
    loved = g.loved.select("profile", "item")
    near = top_per_key(g.close, ["mode"], [F.col("cos").desc(), F.col("item")], 60, "place").select("mode", "item", "place")
    by_mode = g.modes.select("profile", "mode", F.col("rank").alias("turn")).join(near, "mode").join(loved, ["profile", "item"], "left_anti").groupBy("profile", "item").agg(F.min(F.struct("place", "turn")).alias("at"))
    first = materialize(top_per_key(by_mode, ["profile"], [F.col("at"), F.col("item")], 6, "pos").select("profile", "item", "pos"), "near")
    decade = g.titles.filter("year between 1920 and 2029").withColumn("d", F.expr("year div 10"))
    spread = top_per_key(decade, ["d"], [F.col("votes").desc_nulls_last(), F.col("item")], 12, "n")
    spread = spread.select("item", F.row_number().over(Window.orderBy("n", F.col("d").desc())).alias("at"))  # 132 rows at most
    every = g.modes.select("profile").distinct().crossJoin(F.broadcast(spread))
    rest = every.join(first, ["profile", "item"], "left_anti").join(loved, ["profile", "item"], "left_anti").withColumn("pos", F.row_number().over(Window.partitionBy("profile").orderBy("at")))
    taken = first.groupBy("profile").agg(F.count(F.lit(1)).alias("n"))
    place = (F.col("pos") + F.coalesce("n", F.lit(0))).cast("int")
    more = rest.join(taken, "profile", "left").select("profile", "item", place.alias("place")).filter("place <= 12")
    return first.withColumnRenamed("pos", "place").unionByName(more)


@query("op_r28_surprise", _BASE + _NEAREST_MODE.format(where="rating >= 78 AND votes >= 100") + """, cn AS (SELECT profile, item, row_number() OVER (PARTITION BY profile ORDER BY cos DESC, item) AS rank FROM ps ANTI JOIN loved USING (profile, item) QUALIFY rank <= 20),
  ow AS (SELECT cn.*, dc.imdb_id IS NOT NULL AS here FROM cn JOIN t USING (item) LEFT JOIN (SELECT DISTINCT imdb_id FROM documents) dc USING (imdb_id)), bs AS (SELECT *, max(here::INT) OVER (PARTITION BY profile) AS any_here FROM ow),
  fv AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY rank) AS n FROM bs WHERE here OR any_here = 0 QUALIFY n <= 5), given AS (SELECT *, count(*) OVER (PARTITION BY profile) AS cnt, CAST(profile AS UBIGINT) AS x FROM fv), """ + MIX_SQL + """
  SELECT profile, item, here FROM mixed WHERE n - 1 = m % CAST(cnt AS UBIGINT)""")
def surprise(spark: SparkSession, folder: str) -> DataFrame:
    """One title for every profile: of the five best it doesn't know, those at hand first, which one by a hash of the profile."""
    g = _Gathered(spark, folder)
    texts = table(spark, folder, "documents").select("imdb_id").dropna().distinct().withColumn("here", F.lit(True))
    own = canon(spark, folder).join(g.titles.select("item", "imdb_id"), "item").join(texts, "imdb_id", "left").withColumn("here", F.coalesce("here", F.lit(False)))
    each = Window.partitionBy("profile")
    best = own.withColumn("any", F.max("here").over(each)).filter("here or not any").withColumn("n", F.row_number().over(each.orderBy("rank"))).filter("n <= 5")
    first = best.withColumn("c", F.count(F.lit(1)).over(each))
    at = F.when(F.col("c") == 1, 0)
    for c in range(2, 6):
        at = at.when(F.col("c") == c, mixed_modulo(F.col("profile"), c))
    return first.filter(F.col("n") - 1 == at).select("profile", "item", "here")


@query("op_v10_edited_modes", _BASE + """, fx AS (SELECT profile, mode, w * CASE (profile + mode) % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE 1.0 END AS w FROM mo), f AS (SELECT * FROM fx WHERE w > 0), g AS (SELECT profile, mode, w / sum(w) OVER (PARTITION BY profile) AS w FROM f)
  SELECT profile, mode, round(w * CASE WHEN profile % 3 = 0 THEN 0.8 ELSE 1 END, 6)::DOUBLE AS weight FROM g UNION ALL SELECT profile, NULL, CASE WHEN bool_or(w > 0) THEN 0.2 ELSE 1.0 END::DOUBLE FROM fx WHERE profile % 3 = 0 GROUP BY 1""")
def edited_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Mode weights after corrections, with a fifth for stated words where a profile has any."""
    modes = _Gathered(spark, folder).modes.select("profile", "mode", F.col("w").alias("weight"))
    at = (F.col("profile") + F.col("mode")) % 4
    words = modes.select("profile", "mode", F.when(at == 0, "more").when(at == 1, "less").when(at == 2, "not_me").alias("word")).dropna()
    return V.edited_modes(modes, words, modes.filter("profile % 3 = 0")).withColumn("weight", F.round("weight", 6))


@query("op_w09_weighted_interleave")
def weighted_interleave(spark: SparkSession, folder: str) -> DataFrame:
    """Every profile's modes merged by weight: twenty titles, from each mode's forty nearest."""
    g = _Gathered(spark, folder)
    near = top_per_key(g.close, ["mode"], [F.col("cos").desc(), F.col("item")], 40).groupBy("mode").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("l"))
    lists = g.modes.select(F.col("profile").alias("key"), "mode", F.col("rank").alias("list"), F.col("w").alias("weight")).join(near.select("mode", F.col("l.item").alias("items")), "mode")
    return D.interleave_by_weight(lists.drop("mode"), 20).withColumnRenamed("key", "profile")


QUERIES, ORACLES = _r.queries, _r.oracles
