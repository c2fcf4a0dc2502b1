"""Joins and counts over the account tables: users, organisations, sessions, invitations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import slug


def members(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """(org_id, user_id, role, email, name) of every membership."""
    u = users.select(F.col("id").alias("user_id"), "email", "name")
    return memberships.select("org_id", "user_id", "role").join(u, "user_id").select("org_id", "user_id", "role", "email", "name")


def organisations_of(memberships: DataFrame, orgs: DataFrame) -> DataFrame:
    """(user_id, org_id, role, name, plan, nth): a user's organisations, the oldest membership first."""
    o = orgs.select(F.col("id").alias("org_id"), "name", "plan")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "org_id"))
    return memberships.join(o, "org_id").withColumn("nth", nth).select("user_id", "org_id", "role", "name", "plan", "nth")


def open_invitations(invitations: DataFrame, users: DataFrame, orgs: DataFrame) -> DataFrame:
    """Invitations neither taken nor withdrawn, with the organisation's name and who sent them, if still known."""
    live = invitations.where("accepted_at is null and revoked_at is null")
    rows = live.join(orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org_name")), "org_id")
    return rows.join(users.select(F.col("id").alias("invited_by"), F.col("email").alias("invited_by_email")), "invited_by", "left")


def valid_invitation(invitations: DataFrame, orgs: DataFrame, token_hash: str, now: Column) -> DataFrame:
    """The invitation of a token, if it is open and not expired."""
    o = orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org_name"))
    live = invitations.where((F.col("token_hash") == token_hash) & F.col("accepted_at").isNull() & F.col("revoked_at").isNull() & (F.col("expires_at") >= now))
    return live.join(o, "org_id")


def active_sessions(sessions: DataFrame, users: DataFrame, memberships: DataFrame, orgs: DataFrame, now: Column) -> DataFrame:
    """(id, user_id, email, org_id, role, plan): live sessions of known users and the organisation they act for.

    That is the session's own one if the user still belongs to it, else the
    first that the user joined, else none.
    """
    live = sessions.where(F.col("expires_at") >= now).select("id", "user_id", F.col("org_id").alias("wanted"))
    live = live.join(users.select(F.col("id").alias("user_id"), "email"), "user_id")
    own = organisations_of(memberships, orgs)
    held = live.join(own, "user_id", "left")
    best = held.groupBy("id", "user_id", "email").agg(
        F.min_by(F.struct("org_id", "role", "plan"), F.struct((~F.coalesce(F.col("org_id") == F.col("wanted"), F.lit(False))).alias("other"), "nth")).alias("o")
    )
    return best.select("id", "user_id", "email", "o.org_id", "o.role", "o.plan")


def seats_used(orgs: DataFrame, memberships: DataFrame, invitations: DataFrame) -> DataFrame:
    """(org_id, seats): members and open invitations of each organisation."""
    m = memberships.groupBy("org_id").agg(F.count("*").alias("m"))
    i = invitations.where("accepted_at is null and revoked_at is null").groupBy("org_id").agg(F.count("*").alias("i"))
    rows = orgs.select(F.col("id").alias("org_id")).join(m, "org_id", "left").join(i, "org_id", "left")
    return rows.select("org_id", (F.coalesce("m", F.lit(0)) + F.coalesce("i", F.lit(0))).alias("seats"))


def unique_slugs(names: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, slug) for names(id, name): the plain slug if it is free, else the first free one of -2, -3 and so on.

    Names of one slug are numbered by one window, and the n-th takes the n-th
    number that ``taken(slug)`` leaves free, told by a running count of taken ones.
    """
    base = F.when(slug(F.col("name")) == "", "team").otherwise(slug(F.col("name")))
    rows = names.withColumn("base", base)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("base").orderBy("id")))
    numbered = taken.where(F.col("slug").rlike(r"-[1-9][0-9]{0,8}$")).select(
        F.regexp_replace("slug", r"-[0-9]+$", "").alias("base"), F.regexp_extract("slug", r"-([0-9]+)$", 1).cast("int").alias("n")
    )
    used = taken.select(F.col("slug").alias("base"), F.lit(1).alias("n")).unionByName(numbered.where("n > 1"))
    # a number is skipped by those whose turn comes after the free ones below it
    before = F.row_number().over(Window.partitionBy("base").orderBy("n")) - 1
    used = used.distinct().select("base", F.lit(None).cast(rows.schema["id"].dataType).alias("id"), (F.col("n") - before).alias("nth"), F.lit(1).alias("skip"))
    rows = rows.select("base", "id", "nth", F.lit(0).alias("skip")).unionByName(used)
    so_far = Window.partitionBy("base").orderBy("nth", F.desc("skip")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("n", F.col("nth") + F.sum("skip").over(so_far)).where("skip = 0")
    n = F.col("n")
    return rows.select("id", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string"))).alias("slug"))
