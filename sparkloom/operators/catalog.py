"""Catalog look-ups, permissions and quotas as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    """Objects whose name or path starts with the prefix."""
    return objects.filter(F.col("name").startswith(prefix) | F.col("path").startswith(prefix))


def permitted(requests: DataFrame, grants: DataFrame, implied: DataFrame) -> DataFrame:
    """Requests (principal, permission, path) with ``allowed``.

    A grant (principal, permission, scope) allows what it names, and what ``implied`` (permission, implies)
    adds to it, at the scope's path and below.
    """
    wide = grants.join(implied, "permission", "left").select("principal", "scope", F.explode(F.array_compact(F.array("permission", "implies"))).alias("permission")).distinct()
    below = (F.col("path") == F.col("scope")) | F.col("path").startswith(F.concat(F.col("scope"), F.lit("/"))) | (F.col("scope") == "/")
    hits = requests.join(wide, ["principal", "permission"]).filter(below).select("principal", "permission", "path").distinct().withColumn("_hit", F.lit(True))
    return requests.join(hits, ["principal", "permission", "path"], "left").select("principal", "permission", "path", F.coalesce("_hit", F.lit(False)).alias("allowed"))


def quota_usage(usage: DataFrame, limits: DataFrame, tenant: str, amount: str, warn_at: float = 0.8) -> DataFrame:
    """Sum per tenant against its limit, with an alert; tenants with usage or a limit alone have rows too."""
    used = usage.groupBy(tenant).agg(F.round(F.sum(amount), 2).alias("used"))
    out = used.join(limits, tenant, "full").withColumn("used", F.coalesce("used", F.lit(0.0)))
    share = F.col("used") / F.col("quota")
    alert = F.when(F.col("quota").isNull(), "no limit").when(share > 1, "exceeded").when(share >= warn_at, "near").otherwise("ok")
    return out.select(tenant, "used", "quota", F.coalesce(F.col("used") > F.col("quota"), F.lit(False)).alias("exceeded"), alert.alias("alert"))


def distinct_or_raise(rows: DataFrame, key: str, message: str) -> DataFrame:
    """``rows``; reading them raises if two have one key."""
    rest = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in rest))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{message}: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return one.select(checked.cast(rows.schema[key].dataType).alias(key), *rest).select(*rows.columns)


# Objects of a catalogue: (path, kind, body, version).  The namespace of an object is its path without the last name.


def get_object(objects: DataFrame, path: str) -> DataFrame:
    return objects.filter(F.col("path") == path)


def objects_of(objects: DataFrame, namespace: str, kind: str | None = None) -> DataFrame:
    """The objects right below a namespace."""
    inside = F.regexp_extract("path", r"^(.*)/[^/]*$", 1) == namespace.rstrip("/")
    return objects.filter(inside if kind is None else inside & (F.col("kind") == kind))


def create_objects(objects: DataFrame, new: DataFrame) -> DataFrame:
    """With new objects (path, kind, body), at version 1; reading the result raises where a path is taken."""
    return distinct_or_raise(objects.unionByName(new.withColumn("version", F.lit(1))), "path", "object exists")


def update_objects(objects: DataFrame, changes: DataFrame) -> DataFrame:
    """With the bodies of ``changes`` (path, body), one version up; paths that don't exist are ignored."""
    out = objects.join(changes.select("path", F.col("body").alias("_body")), "path", "left")
    changed = F.col("_body").isNotNull()
    return out.select("path", "kind", F.coalesce("_body", "body").alias("body"), (F.col("version") + changed.cast("int")).alias("version"))


def delete_objects(objects: DataFrame, path: str) -> DataFrame:
    """Without the object, and what lies below it."""
    return objects.filter(~((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/")))


def call_function(objects: DataFrame, path: str, rows: DataFrame, out: str) -> DataFrame:
    """``rows`` with a column that the body of a function object, an SQL expression, gives."""
    found = objects.filter((F.col("path") == path) & (F.col("kind") == "function")).select("body").first()
    if found is None:
        raise LookupError(f"no function at {path}")
    return rows.withColumn(out, F.expr(found[0]))
