"""Joins with the gazetteer: a few dozen rows as a rule, which travel as one array; larger ones are met by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text

#: What is sent to every task at most: gazetteer rows, or the cells of a larger gazetteer.
MOST_ROWS = 10_000
#: Rows that a name is compared with one by one; more are met by equality.
FEW_ROWS = 300


def nearest(points: DataFrame, gazetteer: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """points with near: the closest gazetteer row (distance, ord, name, county); ties go to the row listed first.

    Up to MOST_ROWS rows the gazetteer becomes one array, so that the smallest distance is taken row by row without a
    shuffle of the points. A larger one is met by grid cell.
    """
    if gazetteer.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        return _nearest_by_cell(points, gazetteer, lat, lng)
    rows = F.broadcast(gazetteer.agg(F.sort_array(F.collect_list(F.struct("ord", "name", "county", "lat", "lng"))).alias("_gaz")))
    best = F.array_min(F.transform("_gaz", lambda g: _near(F.col(lat), F.col(lng), g["lat"], g["lng"], g["ord"], g["name"], g["county"])))
    return points.crossJoin(rows).withColumn("near", best).drop("_gaz")


def _near(lat, lng, g_lat, g_lng, ord_, name, county) -> Column:
    return F.struct(geo.haversine(lat, lng, g_lat, g_lng).alias("distance"), ord_.alias("ord"), name.alias("name"), county.alias("county"))


def _nearest_by_cell(points: DataFrame, gazetteer: DataFrame, lat: str, lng: str) -> DataFrame:
    """Exact: a cell has a centre row and the distance of its farthest row from that, so by the triangle inequality a point
    needs only cells that may hold a row closer than the closest centre. Those it meets by equality on the cell."""
    for size in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0):  # the last has at most 276 cells
        rows = gazetteer.select("ord", "name", "county", F.col("lat").alias("g_lat"), F.col("lng").alias("g_lng"), F.struct(F.floor(F.col("lat") / size).alias("y"), F.floor(F.col("lng") / size).alias("x")).alias("cell"))
        if rows.select("cell").distinct().limit(MOST_ROWS + 1).count() <= MOST_ROWS:
            break
    centre = rows.groupBy("cell").agg(F.min_by(F.struct("g_lat", "g_lng"), "ord").alias("c"))
    reach = rows.join(centre, "cell").groupBy("cell", "c").agg(F.max(geo.haversine("g_lat", "g_lng", F.col("c.g_lat"), F.col("c.g_lng"))).alias("reach"))
    cells = F.broadcast(reach.agg(F.collect_list(F.struct("cell", "c", "reach")).alias("_cells")))
    asked = points.select(F.monotonically_increasing_id().alias("_pid"), F.struct(*points.columns).alias("_row"), F.col(lat).alias("_lat"), F.col(lng).alias("_lng")).crossJoin(cells)
    far = F.transform("_cells", lambda c: F.struct(geo.haversine(F.col("_lat"), F.col("_lng"), c["c"]["g_lat"], c["c"]["g_lng"]).alias("d"), c["cell"].alias("cell"), c["reach"].alias("reach")))
    asked = asked.withColumn("_far", far).withColumn("_top", F.array_min(F.transform("_far", lambda c: c["d"])))
    asked = asked.withColumn("_go", F.filter("_far", lambda c: c["d"] - c["reach"] <= F.col("_top") * (1 + 1e-9) + 1e-3))
    asked = asked.select("_pid", "_row", "_lat", "_lng", F.explode_outer("_go.cell").alias("cell"))  # a point without a place meets none
    met = asked.join(rows, "cell", "left").withColumn("near", _near(F.col("_lat"), F.col("_lng"), F.col("g_lat"), F.col("g_lng"), F.col("ord"), F.col("name"), F.col("county")))
    met = met.withColumn("near", F.when(F.col("ord").isNotNull(), F.col("near")))
    return met.groupBy("_pid").agg(F.first("_row").alias("_row"), F.min("near").alias("near")).select("_row.*", "near")


def budget(name: Column) -> Column:
    """Edits allowed for a normalized name, by its bytes; null: none allowed."""
    n = F.octet_length(name)
    return F.when(n >= 8, 2).when(n >= 5, 1)


def _without(s: Column) -> Column:
    """A string with each one of its characters left out."""
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))


def deletions(s: Column, most: Column) -> Column:
    """Hashes of a string with up to ``most`` (2 at most) characters left out. Strings within as many edits share one."""
    one = F.when((most >= 1) & (F.length(s) > 0), _without(s)).otherwise(F.array().cast("array<string>"))
    two = F.when((most >= 2) & (F.length(s) > 1), F.flatten(F.transform(one, _without))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(F.array(s), one, two), lambda x: F.xxhash64(x)))


def candidates(names: DataFrame, gazetteer: DataFrame, name: str = "name") -> DataFrame:
    """Every gazetteer row that could answer a name, with its rank: exact name or alias, else prefix
    either way, else within the edit budget.

    Up to FEW_ROWS rows travel as one array. Beyond that names and rows meet by equality: on the name, on leading parts, and
    on what is left after leaving out as many characters as edits are allowed; no name is compared with the whole gazetteer.
    """
    g = gazetteer.select("ord", F.col("name").alias("city"), "county", "lat", "lng", "default_radius_m", text.normalize("name").alias("_n"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), text.normalize).alias("_a"))
    q = names.withColumn("_q", text.normalize(name)).where("_q <> ''")
    if gazetteer.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        rows = F.broadcast(g.agg(F.collect_list(F.struct(*g.columns)).alias("_gaz")))
        return _judged(q.crossJoin(rows).select(*q.columns, F.explode("_gaz").alias("_g")).select(*q.columns, "_g.*"))
    said, forms = q.select("_q").distinct(), g.select("ord", F.explode(F.array_distinct(F.concat(F.array("_n"), "_a"))).alias("form"))
    lead = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.left(F.col(c), i)))
    long = g.where(F.octet_length("_n") >= 4).select("ord", "_n")
    longest = long.agg(F.coalesce(F.max(F.length("_n")), F.lit(0))).first()[0]
    met = [
        said.join(forms, F.col("_q") == F.col("form")),
        said.join(long.select("ord", lead("_n").alias("part")), F.col("_q") == F.col("part")),
        said.where(F.length("_q") >= 1).withColumn("cut", F.left("_q", F.lit(longest))).select("_q", lead("cut").alias("part")).join(long, F.col("part") == F.col("_n")) if longest else None,
        said.select("_q", F.explode(deletions(F.col("_q"), budget(F.col("_q")))).alias("left")).where(budget(F.col("_q")).isNotNull()).join(forms.select("ord", F.explode(deletions(F.col("form"), F.lit(2))).alias("left")), "left"),
    ]
    pairs = None
    for part in met:
        if part is not None:
            pairs = part.select("_q", "ord") if pairs is None else pairs.union(part.select("_q", "ord"))
    return _judged(q.join(pairs.distinct(), "_q").join(g, "ord"))


def _judged(both: DataFrame) -> DataFrame:
    """Names beside gazetteer rows, with the rank of those that answer."""
    exact = (F.col("_q") == F.col("_n")) | F.array_contains("_a", F.col("_q"))
    prefix = (F.octet_length("_n") >= 4) & (F.startswith("_n", F.col("_q")) | F.startswith("_q", F.col("_n")))
    edits = F.array_min(F.transform(F.concat(F.array("_n"), F.col("_a")), lambda a: F.levenshtein(F.col("_q"), a)))
    fuzzy = edits <= budget(F.col("_q"))
    o = F.col("ord").cast("long")
    rank = (
        F.when(exact, F.struct(F.lit(0).alias("stage"), F.lit(0).cast("long").alias("a"), o.alias("b")))
        .when(prefix, F.struct(F.lit(1).alias("stage"), (-F.octet_length("_n")).cast("long").alias("a"), (-o).alias("b")))
        .when(fuzzy, F.struct(F.lit(2).alias("stage"), edits.cast("long").alias("a"), o.alias("b")))
    )
    return both.withColumn("rank", rank).where("rank is not null").drop("_q", "_n", "_a")


def resolve(names: DataFrame, gazetteer: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """(key, city, county, lat, lng, default_radius_m, stage) for names that resolve."""
    row = F.struct("city", "county", "lat", "lng", "default_radius_m", F.col("rank.stage").alias("stage"))
    return candidates(names, gazetteer, name).groupBy(key).agg(F.min_by(row, "rank").alias("r")).select(key, "r.*")


def suggest(gazetteer: DataFrame, name: str, n: int = 5) -> DataFrame:
    """The n names closest in edits to a name that did not resolve."""
    d = F.levenshtein(text.normalize("name"), text.normalize(F.lit(name)))
    return gazetteer.select("name", d.alias("edits")).orderBy("edits", "name").limit(n)


def counties(gazetteer: DataFrame) -> DataFrame:
    return gazetteer.where("county is not null").select("county").distinct().orderBy("county")


def in_county(gazetteer: DataFrame, county: str) -> DataFrame:
    want = text.normalize_county(F.lit(county))
    return gazetteer.where((want != "") & (text.normalize_county("county") == want))


def locales(gazetteer: DataFrame) -> DataFrame:
    """Gazetteer rows by county, those without one last."""
    return gazetteer.orderBy(F.asc_nulls_last("county"), "name")
