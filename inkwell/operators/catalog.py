"""Catalogue and versioning: filters, paging, set differences, upserts, versions and mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import any_of, slugify, strip


def page(df: DataFrame, order: list[Column | str], skip: int, limit: int, search: str | None = None, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the rows of one page, and a row with the total before paging); the search text may stand anywhere, in any case."""
    if search:
        df = df.where(any_of([F.contains(F.lower(c), F.lit(search.lower())) for c in columns or []]))
    return df.orderBy(*order).offset(skip).limit(limit), df.agg(F.count("*").alias("total"))


def prefix_filter(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.startswith(F.col(column), F.lit(prefix))).orderBy(column)


def active_rows(df: DataFrame, deleted: Column, newest: list[Column], skip: int = 0, limit: int | None = None, **equal) -> DataFrame:
    """Rows not deleted, newest first, paged."""
    out = optional_filters(df.where(~deleted), **equal).orderBy(*newest).offset(skip)
    return out if limit is None else out.limit(limit)


def optional_filters(df: DataFrame, **equal) -> DataFrame:
    """Rows that meet all of the equalities whose value isn't None."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def rows_of_type(df: DataFrame, kind: str) -> DataFrame:
    """Undeleted rows of a type in any case, by id; a single error row if there is none."""
    found = df.where((F.lower("type") == kind.lower()) & ~F.col("is_deleted")).select("id", "type", F.lit(None).cast("string").alias("error"))
    error = df.sparkSession.range(1).select(F.lit(None).cast("long").alias("id"), F.lit(kind).alias("type"), F.lit("no rows of this type").alias("error"))
    return found.union(error.join(found.limit(1).select(F.lit(1).alias("one")), F.lit(True), "left_anti")).orderBy("id")


def feature_status(features: DataFrame, mapping: DataFrame, template_id, group=None) -> DataFrame:
    """feature_id, status: the stored one or 0 if the template has any mapping, 1 for all if it has none."""
    wanted = optional_filters(features, group_code=group)
    mine = mapping.where(F.col("template_id") == template_id).select("feature_id", "status")
    any_ = mine.agg((F.count("*") > 0).alias("mapped"))  # one row
    return wanted.join(mine, "feature_id", "left").join(F.broadcast(any_)).select("feature_id", F.when(~F.col("mapped"), 1).otherwise(F.coalesce("status", F.lit(0))).alias("status"))


def mapping_diff(existing: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """key, change: added, kept or removed."""
    e, w = existing.select(*key).distinct().withColumn("e", F.lit(True)), wanted.select(*key).distinct().withColumn("w", F.lit(True))
    return e.join(w, key, "full_outer").select(*key, F.when(F.col("e").isNull(), "added").when(F.col("w").isNull(), "removed").otherwise("kept").alias("change"))


def child_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """parent key, n_children, deletable."""
    counted = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return parents.select(parent_key).join(counted, parent_key, "left").select(parent_key, n.alias("n_children"), (n == 0).alias("deletable"))


def latest_version(df: DataFrame, key: list[str], newest: list[Column], keep: Column | None = None) -> DataFrame:
    """The newest row of each key among those kept."""
    rows = df if keep is None else df.where(keep)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).where("_n = 1").drop("_n")


def append_versions(existing: DataFrame, new: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """All versions (key, version, sheet_type, status): new rows get numbers above all undeleted ones of their key.

    Of a key's current rows of one type only the newest stays current; the others are superseded.
    """
    top = existing.where("not is_deleted").groupBy(key).agg(F.max("version").alias("top"))
    numbered = new.join(top, key, "left").select(key, (F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy(key).orderBy(order))).cast("int").alias("version"), "sheet_type", F.lit("current").alias("status"))
    both = existing.where("not is_deleted").select(key, F.col("version").cast("int").alias("version"), "sheet_type", "status").unionByName(numbered)
    newer = F.lead("version").over(Window.partitionBy(key, "sheet_type", "status").orderBy("version"))
    return both.withColumn("status", F.when((F.col("status") == "current") & newer.isNotNull(), "superseded").otherwise(F.col("status")))


def activate_version(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """versions (name, version, status) with each target active and the formerly active one archived; others as before."""
    valid = targets.join(versions.select("name", "version"), ["name", "version"], "left_semi").select("name", F.col("version").alias("target"))
    status = F.when(F.col("target").isNull(), F.col("status")).when(F.col("version") == F.col("target"), "active").when(F.col("status") == "active", "archived").otherwise(F.col("status"))
    return versions.join(valid, "name", "left").select("name", "version", status.alias("status"))


def next_group_code(groups: DataFrame, n: int = 1) -> DataFrame:
    """n new codes: 0 for the first ever, else multiples of 1000 above the largest."""
    top = groups.agg(F.max("group_code").alias("top"))  # one row
    first = F.when(F.col("top").isNull(), 0).otherwise((F.floor(F.col("top") / 1000) + 1) * 1000)
    return top.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: first + i * 1000)).alias("group_code"))


def history(df: DataFrame, newest: list[Column], skip: int = 0, limit: int = 50, **equal) -> DataFrame:
    return optional_filters(df, **equal).orderBy(*newest).offset(skip).limit(limit)


def resolve_checks(checks: DataFrame, org, project, mode: str = "reference") -> DataFrame:
    """Active checks of an organisation (all if None): its project's rows and those without a project, by agent and check.

    ``project_wins`` keeps the project's row where both exist.
    """
    rows = optional_filters(checks.where("is_active"), org_id=org).where((F.col("project_id") == project) | F.col("project_id").isNull())
    if mode == "project_wins":
        rows = latest_version(rows, ["org_id", "agent", "check_code"], [F.col("project_id").isNull()])
    return rows.orderBy("agent", "check_code", "project_id")


def resolve_template(names: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, template: base_<slug of category> if there is one, else base."""
    special = F.concat(F.col("base"), F.lit("_"), slugify("category"))
    return requests.withColumn("special", special).join(names.select(F.col("name").alias("special"), F.lit(True).alias("known")).distinct(), "special", "left").select("request_id", F.when(F.col("known"), F.col("special")).otherwise(F.col("base")).alias("template"))


def upsert(target: DataFrame, source: DataFrame, key: str, values: list[str]) -> DataFrame:
    """target with source rows inserted or updated, and what was done: inserted, updated, unchanged or kept."""
    s = source.select(key, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_s"))
    t = target.select(key, *values, F.lit(True).alias("_t"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    action = F.when(F.col("_t").isNull(), "inserted").when(F.col("_s").isNull(), "kept").when(same, "unchanged").otherwise("updated")
    return t.join(s, key, "full_outer").select(key, *[F.when(F.col("_s"), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values], action.alias("action"))


def clone_checks(master: DataFrame, scoped: DataFrame, org, project) -> DataFrame:
    """scoped (org_id, project_id, check_code, is_active) with the active master checks that this scope lacks."""
    p = F.lit(project).cast(dict(scoped.dtypes)["project_id"])
    have = scoped.where((F.col("org_id") == org) & F.col("project_id").eqNullSafe(p)).select("check_code")
    fresh = master.where("is_active").join(have, "check_code", "left_anti").select(F.lit(org).cast(dict(scoped.dtypes)["org_id"]).alias("org_id"), p.alias("project_id"), "check_code", F.lit(True).alias("is_active"))
    return scoped.select("org_id", "project_id", "check_code", "is_active").unionByName(fresh)


def merge_generated(batches: DataFrame, items: DataFrame) -> DataFrame:
    """Approved chapters (batch_id, pos, title) with generated prose (batch_id, pos, content, source_ids) by position."""
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("source_ids", strip), lambda x: x != "")))
    return batches.join(items.select("batch_id", "pos", "content", "source_ids"), ["batch_id", "pos"], "left").select("batch_id", "pos", "title", F.coalesce(strip("content"), F.lit("")).alias("content"), F.coalesce(ids, F.array().cast("array<string>")).alias("source_ids"))


def collect_findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
