"""Pages with their layers and folders: what publishing would change, and publishing them with the folders above."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collonade.operators import hierarchy, trees
from collonade.operators.publishing import state
from collonade.sources.folders import cut

#: What makes a page's metadata.
METADATA = ("name", "slug", "settings", "is_index", "is_dynamic", "error_page")
#: Attributes of layers that only an editor needs.
EDITOR_ONLY = ("open",)


def with_layers(pages: DataFrame, layers: DataFrame, published: bool) -> DataFrame:
    """Pages of a state, not deleted, with the layers and styles that they have in that state; pages without layers are left out."""
    own = state(layers, published).select(F.col("page_id").alias("id"), "layers", "styles")
    return state(pages, published).join(own, "id")


def content_hashes(rows: DataFrame, key: str, tree: str, plain: Sequence[str], ignore: Sequence[str] = EDITOR_ONLY, kept: Sequence[str | Column] = ()) -> DataFrame:
    """(kept columns, key, hash): of a nested document and plain columns beside it, for whatever is published by comparing content."""
    told = trees.hashed(rows, tree, ignore, out="_told")
    beside = F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}) if plain else F.lit("")
    # A document that can't be read is told apart by its text.
    raw = F.sha2(F.coalesce(tree, F.lit("")), 256)
    return told.select(*kept, key, F.sha2(F.concat(F.coalesce("_told", raw), beside), 256).alias("hash"))


def unpublished(pages: DataFrame, layers: DataFrame, metadata: Sequence[str] = METADATA) -> DataFrame:
    """(id, status, metadata_changed, layers_changed, moved) of every draft page with layers: new, changed or same against its published twin.

    pages have id, folder_id and is_published, layers page_id, layers (JSON) and styles; both are of both states, and hashes are made anew from
    the content, so they can't be stale.
    """
    of = lambda published: content_hashes(with_layers(pages, layers, published), "id", "layers", ["styles"], kept=["folder_id", F.struct(*metadata).alias("m")])
    draft, twin = of(False), of(True).select("id", F.col("folder_id").alias("_folder"), F.col("m").alias("_m"), F.col("hash").alias("_hash"), F.lit(True).alias("_there"))
    joined = draft.join(twin, "id", "left")
    there = F.col("_there").isNotNull()
    differs = lambda a, b: there & ~F.col(a).eqNullSafe(F.col(b))
    told = joined.select("id", there.alias("_t"), differs("m", "_m").alias("metadata_changed"), differs("hash", "_hash").alias("layers_changed"), differs("folder_id", "_folder").alias("moved"))
    status = F.when(~F.col("_t"), "new").when(F.col("metadata_changed") | F.col("layers_changed") | F.col("moved"), "changed").otherwise("same")
    return told.select("id", status.alias("status"), "metadata_changed", "layers_changed", "moved")


def _grounded(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """Of wanted folders those that can be published: at the top, below a published one, or below one of these."""
    first = wanted.where("folder_id IS NULL").select("id").union(wanted.join(there.select(F.col("id").alias("folder_id")), "folder_id", "left_semi").select("id"))
    return hierarchy.subtree(wanted, "id", "folder_id", first)


def publish(pages: DataFrame, folders: DataFrame, ids: DataFrame, metadata: Sequence[str] = METADATA) -> tuple[DataFrame, DataFrame]:
    """(pages, folders) after publishing draft pages of given ids (a column id) with all folders above them, as one step.

    A folder can be published if the one above it is published or becomes so now; pages below one that can't stay as they are,
    and so do pages whose published twin is the same.  Both tables hold both states, with id and folder_id
    (of folders: their parent).  Only the chains above the pages are walked.
    """
    chosen = cut(state(pages, False).join(ids.select("id").distinct(), "id", "left_semi"))
    draft = state(folders, False)
    start = chosen.where("folder_id IS NOT NULL").select(F.col("folder_id").alias("id")).distinct()
    wanted = cut(hierarchy.above(draft, "id", "folder_id", start))
    there = state(folders, True).select("id")
    going = _grounded(wanted, there)
    new_folders = folders.join(going.select("id", F.lit(True).alias("is_published")), ["id", "is_published"], "left_anti").unionByName(going.withColumn("is_published", F.lit(True)).select(*folders.columns))
    homes = there.union(going.select("id")).distinct().select(F.col("id").alias("folder_id"))
    placed = chosen.where("folder_id IS NULL").unionByName(chosen.join(homes, "folder_id", "left_semi").select(*chosen.columns))
    twin = state(pages, True).select("id", F.struct("folder_id", *metadata).alias("_twin"))
    changed = placed.join(twin, "id", "left").where(~F.struct("folder_id", *metadata).eqNullSafe(F.col("_twin")))
    now = cut(changed.withColumn("is_published", F.lit(True)).select(*pages.columns))
    return pages.join(now.select("id", "is_published"), ["id", "is_published"], "left_anti").unionByName(now), new_folders


def publish_folders(folders: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Folders after publishing those of ids (all without them): what is deleted among the drafts is deleted in its twin, the rest as publish() does."""
    picked = lambda df: df if ids is None else df.join(ids.select("id").distinct(), "id", "left_semi")
    gone = cut(picked(folders.where("not is_published AND deleted_at IS NOT NULL")).select("id", F.col("deleted_at").alias("_gone")))
    marked = folders.join(gone.withColumn("is_published", F.lit(True)), ["id", "is_published"], "left")
    marked = cut(marked.withColumn("deleted_at", F.coalesce("deleted_at", "_gone")).select(*folders.columns))
    wanted = cut(picked(state(marked, False)))
    going = _grounded(wanted, state(marked, True).select("id"))
    return marked.join(going.select("id", F.lit(True).alias("is_published")), ["id", "is_published"], "left_anti").unionByName(going.withColumn("is_published", F.lit(True)).select(*folders.columns))
