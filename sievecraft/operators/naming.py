"""Output names: numbered sequences, stems and collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.text import basename, casefold, stem
from sievecraft.plans.storage import written
from sievecraft.sources.files import IMAGE_SUFFIXES, VIDEO_SUFFIXES

_ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'


def safe_output_name(name: Column) -> Column:
    """Illegal characters replaced by one _ a run, blanks and dots at the end dropped; null if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), f"{_ILLEGAL}+", "_"), r"[ .]+\z", "")
    return F.when(clean != "", clean)


def sidecar_stem(filename: Column) -> Column:
    """A caption file's stem for a media file, legal on any system; null if nothing is left."""
    name = basename(filename)
    media = F.lower(F.regexp_extract(name, r"(?s).(\.[^.]+)\z", 1)).isin(*IMAGE_SUFFIXES, *VIDEO_SUFFIXES)
    name = F.regexp_replace(F.regexp_replace(F.when(media, stem(name)).otherwise(name), _ILLEGAL, "_"), r"[ .]+\z", "")
    reserved = name.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.|$)")
    return F.when(name != "", F.when(reserved, F.concat(F.lit("_"), name)).otherwise(name))


def numbered_names(sequences: DataFrame, name: str) -> DataFrame:
    """item_id, naming_sequence, output_stem: name_0001 and on, as wide as the largest number, four digits at least."""
    top = sequences.agg(F.coalesce(F.max("naming_sequence"), F.lit(0))).first()[0]
    width = max(4, len(str(top)))
    return sequences.select("item_id", "naming_sequence", F.concat(F.lit(f"{name}_"), F.lpad(F.col("naming_sequence").cast("string"), width, "0")).alias("output_stem"))


def output_stems(source: DataFrame, max_rounds: int = 50) -> DataFrame:
    """item_id, output_stem: the first item of a stem in order of path keeps it, later ones add -- and eight characters of their id.

    Should such a name meet another item's, the later of the two adds -x, as often as it takes; every round settles all but the items that still
    collide. Names compare without regard to case. First items come from a partial aggregate over the stem, so a stem that many items
    share does not gather in one task.
    """
    own = stem(basename(F.col("source_relative_path")))
    rows = source.select("item_id", own.alias("stem"), casefold(own).alias("key"), F.struct(casefold(F.col("source_relative_path")).alias("p"), F.col("item_id")).alias("at"))
    first = rows.groupBy(F.col("key").alias("f_key")).agg(F.min("at").alias("first"))
    rows = rows.join(first, F.col("key") == F.col("f_key"))
    named = rows.select("item_id", "at", F.when(F.col("at") == F.col("first"), F.col("stem")).otherwise(F.concat("stem", F.lit("--"), F.substring("item_id", 1, 8))).alias("output_stem"), (F.col("at") == F.col("first")).alias("keeps"))
    named = written(named, "stems")
    for _ in range(max_rounds):
        clash = named.groupBy(casefold(F.col("output_stem")).alias("c_key")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((~F.col("keeps")).alias("late"), F.col("at"))).alias("best")).where("n > 1")
        if clash.limit(1).count() == 0:
            return named.select("item_id", "output_stem")
        marked = named.join(clash, casefold(F.col("output_stem")) == F.col("c_key"), "left")
        lost = F.col("best").isNotNull() & (F.col("at") != F.col("best.at"))
        named = written(marked.select("item_id", "at", F.when(lost, F.concat("output_stem", F.lit("-x"))).otherwise(F.col("output_stem")).alias("output_stem"), "keeps"), "stems")
    raise RuntimeError("names still collide")


def rename_moves(items: DataFrame, wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """item_id, src, dst of the renames of items none of whose targets is taken by an existing file."""
    w = wanted.select(F.col("item_id").alias("w_id"), F.col("output_image_path").alias("w_image"), F.col("caption_path").alias("w_caption"))
    pairs = items.join(w, items["item_id"] == w["w_id"]).select("item_id", F.explode(F.array(F.struct(F.col("output_image_path").alias("src"), F.col("w_image").alias("dst")), F.struct(F.col("caption_path").alias("src"), F.col("w_caption").alias("dst")))).alias("p")).select("item_id", "p.*").where("src <> dst")
    pairs = pairs.join(listing.select(F.col("path").alias("src")).distinct(), "src", "left_semi")
    taken = pairs.join(listing.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi").select("item_id").distinct()
    return pairs.join(taken, "item_id", "left_anti").select("item_id", "src", "dst")
