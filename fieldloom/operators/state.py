"""State over observations: latest rows, merges by precedence, upserts, identities, ancestry and pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.errors import IdentityAmbiguous, IdentityNotFound
from fieldloom.functions.text import identity_text
from fieldloom.names import col


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the largest order values, by one aggregation with partial maxima."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order, *rest)).alias("_r"))
    return top.select("_r.*")


def merge_observations(df: DataFrame, keys: Sequence[str], fields: Sequence[str], *, authority: str, observed_at: str, source: str) -> DataFrame:
    """For each key and field the value of the highest (authority, time, source) among those observed.

    A field is struct(state, value): 'unobserved' never counts, while an observed null can win. A key none of whose
    observations has a field keeps a null for it. The first sight is the earliest observation with any authority, or
    the earliest of all where none has.
    """
    order = F.struct(authority, observed_at, source)
    first = F.coalesce(F.min(F.when(F.col(authority) > 0, F.col(observed_at))), F.min(observed_at))
    picks = [F.max_by(F.col(f"{f}.value"), F.when(F.col(f"{f}.state") != "unobserved", order)).alias(f) for f in fields]
    return df.groupBy(*keys).agg(*picks, first.alias("first_seen_at"), F.max(observed_at).alias("last_seen_at"))


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], *, keep: Sequence[str] = ("first_seen_at",)) -> DataFrame:
    """Rows of both, the new values first; columns in `keep` stay as stored."""
    s, n = stored.alias("s"), new.withColumn("_new", F.lit(True)).alias("n")
    j = s.join(n, [F.col(f"s.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")

    def pick(c: str):
        old, now = F.col(f"s.{c}"), F.col(f"n.{c}")
        if c in keys or c in keep:
            return F.coalesce(old, now)
        return F.when(F.col("_new"), now).otherwise(old)

    return j.select(*[pick(c).alias(c) for c in stored.columns])


def name_index(entities: DataFrame, *, entity_id: str, name: str, aliases: str | None = None) -> DataFrame:
    """(norm, ids): the sorted ids of each normalised name or alias; blank names are left out."""
    names = F.array(F.col(name)) if aliases is None else F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    each = entities.select(F.col(entity_id).alias("id"), F.explode(names).alias("n")).select("id", identity_text(F.col("n")).alias("norm")).where("norm != ''")
    return each.groupBy("norm").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def resolve_names(df: DataFrame, index: DataFrame, *, name: str) -> DataFrame:
    """Add entity_id, resolution ('resolved', 'ambiguous', 'unresolved') and candidate_ids; never raises."""
    j = df.withColumn("_norm", identity_text(F.col(name))).join(index, F.col("_norm") == F.col("norm"), "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    n = F.when(F.col("ids").isNull(), 0).otherwise(n)
    return j.select(
        *df.columns,
        F.when(n == 1, F.element_at("ids", 1)).alias("entity_id"),
        F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("resolution"),
        F.coalesce("ids", F.array().cast(dict(index.dtypes)["ids"])).alias("candidate_ids"),
    )


def resolve_one(index: DataFrame, name: str):
    """The one id with the name; raises if there is none or are several (ten of them are named)."""
    row = index.where(F.col("norm") == identity_text(F.lit(name))).take(1)
    if not row:
        raise IdentityNotFound(name)
    if len(row[0].ids) > 1:
        raise IdentityAmbiguous(f"{name}: {row[0].ids[:10]}")
    return row[0].ids[0]


def prunable(objects: DataFrame, keys: Sequence[str], *uses: DataFrame) -> DataFrame:
    """Objects that none of the given frames refers to: one anti-join for each."""
    for u in uses:
        objects = objects.join(u.select(*keys), list(keys), "left_anti")
    return objects


def with_ordinal(df: DataFrame, by: Sequence, *, partition: Sequence[str] = (), name: str = "ordinal") -> DataFrame:
    """A gapless ordinal from 0 in the given order, within partitions where given."""
    w = Window.partitionBy(*partition).orderBy(*by)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def ancestry(df: DataFrame, *, node: str, parent: str, start, limit: int = 1000) -> DataFrame:
    """(node, depth) from a start node up to its root, `limit` steps at most, by a recursive query that leaves no view behind."""
    edges = df.select(col(node).alias("node"), col(parent).alias("parent"))
    return df.sparkSession.sql(
        f"""WITH RECURSIVE up(node, parent, depth) MAX RECURSION LEVEL {int(limit) + 2} AS (
          SELECT node, parent, 0 FROM {{edges}} WHERE node = :start
          UNION ALL SELECT e.node, e.parent, up.depth + 1 FROM up JOIN {{edges}} e ON e.node = up.parent WHERE up.depth < {int(limit)}
        ) SELECT node, depth FROM up""",
        args={"start": start},
        edges=edges,
    )
