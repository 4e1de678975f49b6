"""Image references, the image catalog, and matching references to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.urls import resolve_url
from bindery.operators.render import drop_subtrees, drop_tags, is_element, is_text, next_pos
from bindery.operators.scan import SAFE_BROADCAST_ROWS, lookup
from bindery.session import materialize, materialize_counted
from bindery.sources.html import KEY

# File extension and type by image format.
FORMATS = {"jpeg": ("jpg", "image/jpeg"), "png": ("png", "image/png"), "webp": ("webp", "image/webp")}


def image_refs(parsed: DataFrame) -> DataFrame:
    """One row per image of a page, from the ``images`` array."""
    return parsed.select(*KEY, "url", F.posexplode("images").alias("pos", "i")).select(*KEY, "url", "pos", "i.*")


def image_id(url: Column) -> Column:
    return F.concat(F.lit("img-"), F.substring(F.md5(url), 1, 12))


def image_catalog(refs: DataFrame, base: str = "url", format: str = "jpeg") -> DataFrame:
    """Distinct absolute image URLs per site with id, file name and type.

    ``refs`` has ``original_url`` and the base URL column; references which do not
    resolve are left out.
    """
    ext, mime = FORMATS[format]
    absolute = refs.select("site", resolve_url(F.col("original_url"), F.col(base)).alias("url")).filter("url <> ''")
    return absolute.distinct().select(
        "site",
        image_id(F.col("url")).alias("image_id"),
        "url",
        F.lit(mime).alias("mime_type"),
        F.concat(image_id(F.col("url")), F.lit(f".{ext}")).alias("filename"),
    )


def extract_image_urls(nodes: DataFrame, base: str = "url") -> DataFrame:
    """Distinct absolute image URLs of each page."""
    src = F.col("attrs")["src"]
    images = nodes.filter((F.col("tag") == "img") & (src != "") & ~src.startswith("data:"))
    return images.select(*KEY, resolve_url(src, F.col(base)).alias("image_url")).filter("image_url <> ''").distinct()


def remove_images(nodes: DataFrame) -> DataFrame:
    """Drop images and pictures, then figures which are left without any child."""
    out = drop_tags(nodes, ["img", "picture"])
    child = is_element() | (is_text() & (F.col("text") != ""))
    out = out.withColumn("_next", next_pos(child))
    bare = (F.col("tag") == "figure") & (F.col("_next").isNull() | (F.col("_next") > F.col("end_pos")))
    return drop_subtrees(out, bare).drop("_next")


def update_image_refs(nodes: DataFrame, catalog: DataFrame, base: str = "url") -> DataFrame:
    """Point images found in the catalog at their packaged file and drop their ``srcset``.

    A catalog of few rows is looked up in one pass over the nodes. Otherwise only image
    rows take part in a join; one image may be on every page, so it spreads hot URLs.
    """
    src = F.col("attrs")["src"]
    wanted = (F.col("tag") == "img") & (src != "") & ~src.startswith("data:")
    flagged = nodes.withColumn("_img", F.coalesce(wanted, F.lit(False)))
    flagged = flagged.withColumn("_abs", F.when(F.col("_img"), resolve_url(src, F.col(base))))
    files = catalog.select("site", F.col("url").alias("_abs"), "filename").dropDuplicates(["site", "_abs"])
    files, known = materialize_counted(files, "image-files")
    few = known <= SAFE_BROADCAST_ROWS
    images = flagged if few else flagged.filter("_img")
    found = lookup(images, files, ["site", "_abs"], right_rows=known)
    # the source keeps its place among the attributes
    fixed = F.expr(
        "map_from_entries(transform(filter(map_entries(attrs), e -> e.key <> 'srcset'), "
        "e -> struct(e.key, if(e.key = 'src', concat('images/', filename), e.value))))"
    )
    done = found.withColumn("attrs", F.when(F.col("filename").isNotNull(), fixed).otherwise(F.col("attrs")))
    done = done.select(*nodes.columns)
    return done if few else flagged.filter("not _img").select(*nodes.columns).unionByName(done)


def match_images(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog image for each reference ``url``: same URL, else same file name, else a suffix either way.

    Inside a tier the first image in catalog order (``order``, else URL order) wins.
    Suffixes are found by equality: only ends as long as some unmatched string of
    the site are cut off and looked up, so no pairs are compared.
    """
    images = catalog if "order" in catalog.columns else catalog.withColumn("order", F.lit(0))
    key = F.struct(F.col("order"), F.col("image_url")).alias("rank")
    images = images.select("site", F.col("url").alias("image_url"), "image_id", "filename", "order").select("*", key)
    images = materialize(images, "images")
    asked = materialize(refs.select("site", F.col("url").alias("ref")).distinct(), "refs")
    exact = lookup(
        asked, images.groupBy("site", F.col("image_url").alias("ref")).agg(F.min_by("image_id", "rank").alias("m1")), ["site", "ref"]
    )
    name = F.regexp_extract("ref", r"([^/]*)\z", 1)
    by_name = images.groupBy("site", F.col("filename").alias("name")).agg(F.min_by("image_id", "rank").alias("m2"))
    named = materialize(lookup(exact.withColumn("name", name), by_name, ["site", "name"]).drop("name"), "named")

    left = named.filter("m1 is null and m2 is null").select("site", "ref")
    def ends(df: DataFrame, text: str, of: DataFrame, other: str) -> DataFrame:
        """Rows of ``df`` with each end of ``text`` as long as some ``other`` string of the site."""
        sizes = of.groupBy("site").agg(F.collect_set(F.length(other)).alias("sizes"))
        sized = lookup(df, sizes, ["site"], "inner").withColumn("n", F.explode("sizes")).drop("sizes")
        return sized.filter(F.col("n") <= F.length(text)).withColumn("end", F.expr(f"right({text}, n)")).drop("n")

    # many images may share an end: the best one per end is found before the join
    best_end = ends(images, "image_url", left, "ref").groupBy("site", F.col("end").alias("ref"))
    best_end = best_end.agg(F.min_by("image_id", "rank").alias("image_id"), F.min("rank").alias("rank"))
    one = left.join(best_end, ["site", "ref"]).select("site", "ref", "rank", "image_id")
    tails = ends(left, "ref", images.join(left.select("site").distinct(), "site", "left_semi"), "image_url")
    by_url = images.groupBy("site", F.col("image_url").alias("end")).agg(
        F.min_by("image_id", "rank").alias("image_id"), F.min("rank").alias("rank")
    )
    two = lookup(tails, by_url, ["site", "end"], "inner").select("site", "ref", "rank", "image_id")
    by_end = one.unionByName(two).groupBy("site", "ref").agg(F.min_by("image_id", "rank").alias("m3"))
    best = named.join(by_end, ["site", "ref"], "left")
    tier = F.when(F.col("m1").isNotNull(), 1).when(F.col("m2").isNotNull(), 2).when(F.col("m3").isNotNull(), 3)
    return best.select("site", F.col("ref").alias("url"), F.coalesce("m1", "m2", "m3").alias("image_id"), tier.alias("tier"))
