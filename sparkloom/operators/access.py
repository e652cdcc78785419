"""Keys, sessions and their owners as relations: look-ups, visibility, expiry, and keeping them current.

Tables: keys (key_id, key_hash, owner_id, created_at, revoked_at), sessions (session_id, user_id, created_at, expires_at,
last_seen_at), users (user_id, role, disabled_at). Times are timestamps; ``now`` is a column or a literal, so that results
do not depend on when they are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days by which a session's expiry slides when it is used.
SESSION_DAYS = 14


def key_status(keys: DataFrame, users: DataFrame) -> DataFrame:
    """The keys with their status: invalid (revoked, or of an unknown owner), disabled (its owner is), or valid."""
    u = users.select(F.col("user_id").alias("_u"), F.col("disabled_at").alias("_d"))
    status = F.when(F.col("revoked_at").isNotNull() | F.col("_u").isNull(), "invalid").when(F.col("_d").isNotNull(), "disabled").otherwise("valid")
    return keys.join(u, F.col("owner_id") == F.col("_u"), "left").withColumn("status", status).drop("_u", "_d")


def live(now: Column) -> Column:
    """Whether a session has not expired; one without an expiry has."""
    return F.coalesce(F.col("expires_at") > now, F.lit(False))


def session_status(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """The sessions with their status: unknown (no such user), expired, disabled or valid."""
    u = users.select(F.col("user_id").alias("_u"), F.col("disabled_at").alias("_d"))
    status = F.when(F.col("_u").isNull(), "unknown").when(~live(now), "expired").when(F.col("_d").isNotNull(), "disabled").otherwise("valid")
    return sessions.join(u, F.col("user_id") == F.col("_u"), "left").withColumn("status", status).drop("_u", "_d")


def expired(sessions: DataFrame, now: Column) -> DataFrame:
    """The sessions that a clean-up deletes."""
    return sessions.where(~live(now))


def unexpired(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(live(now))


def others(sessions: DataFrame, user_id, keep) -> DataFrame:
    """A user's sessions but for the one to keep."""
    return sessions.where((F.col("user_id") == user_id) & (F.col("session_id") != keep))


def touched(sessions: DataFrame, uses: DataFrame, days: int = SESSION_DAYS) -> DataFrame:
    """The sessions after uses (session_id, at): the latest use becomes last_seen_at and the expiry slides to ``days`` after
    it. Uses after a session's expiry, and of unknown sessions, change nothing; a session never expires earlier."""
    j = sessions.join(uses.select(F.col("session_id").alias("_s"), F.col("at").alias("_at")), (F.col("session_id") == F.col("_s")) & (F.col("_at") < F.col("expires_at")), "left")
    last = j.groupBy("session_id").agg(F.max("_at").alias("_last"))
    s = sessions.join(last, "session_id", "left")
    seen = F.greatest("last_seen_at", "_last")
    until = F.greatest(F.col("expires_at"), F.col("_last") + F.expr(f"interval {days} days"))
    return s.withColumns({"last_seen_at": seen, "expires_at": F.coalesce(until, F.col("expires_at"))}).drop("_last").select(sessions.columns)


def visible_keys(keys: DataFrame, viewers: DataFrame) -> DataFrame:
    """(viewer_id, key_id) of the keys that each viewer (user_id, role, want_all) sees: all where an admin asks for all,
    else the viewer's own. All keys of all-seeing viewers are one row per viewer, with a null key_id, not a product."""
    v = viewers.select(F.col("user_id").alias("viewer_id"), (F.col("want_all") & (F.col("role") == "admin")).alias("_all"))
    own = v.where("not _all").join(keys.select("owner_id", "key_id"), F.col("viewer_id") == F.col("owner_id")).select("viewer_id", "key_id")
    return own.unionByName(v.where("_all").select("viewer_id", F.lit(None).cast(keys.schema["key_id"].dataType).alias("key_id")))


def may_change(role: Column) -> Column:
    """Whether a role passes the gate before projects, users and the runtime are changed."""
    return F.coalesce(role == "admin", F.lit(False))


def removable(users: DataFrame) -> DataFrame:
    """The users with ``removable``: false for an enabled admin while there is no other one."""
    admin = (F.col("role") == "admin") & F.col("disabled_at").isNull()
    n = users.agg(F.count_if(admin).alias("_n"))
    return users.crossJoin(F.broadcast(n)).withColumn("removable", ~(admin & (F.col("_n") <= 1))).drop("_n")  # one row is broadcast


def user_counts(users: DataFrame, sessions: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """The users with last_login, live_sessions and active_keys; children are aggregated before the joins, users without
    any are kept with 0."""
    s = sessions.groupBy("user_id").agg(F.max("created_at").alias("last_login"), F.count_if(live(now)).alias("live_sessions"))
    k = keys.groupBy(F.col("owner_id").alias("user_id")).agg(F.count_if(F.col("revoked_at").isNull()).alias("active_keys"))
    return users.join(s, "user_id", "left").join(k, "user_id", "left").fillna(0, ["live_sessions", "active_keys"])
