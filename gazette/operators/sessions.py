"""Refresh sessions: lookup by token, state, and rotation or revocation events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.notify import session_expiry, sha256_token
from gazette.operators.ranking import first_per_group
from gazette.operators.skew import skew_join
from gazette.schemas import SESSIONS
from gazette.session import cut_lineage

SESSION_COLS = SESSIONS.fieldNames()


def user_sessions(sessions: DataFrame, auth_id: str) -> DataFrame:
    """All sessions of one user."""
    return sessions.filter(F.col("user_auth_id") == auth_id)


def token_lookup(tokens: DataFrame, sessions: DataFrame) -> DataFrame:
    """Presented tokens (token, ...) with the session their hash belongs to, null columns for an unknown one."""
    hashed = tokens.withColumn("token_hash", sha256_token(F.col("token")))
    return skew_join(hashed, sessions, "token_hash", "left")


def session_state(tokens: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    """Presented tokens with ``state``: unknown, revoked, expired or valid, the first that holds."""
    state = (
        F.when(F.col("id").isNull(), F.lit("unknown"))
        .when(F.col("revoked_at").isNotNull(), F.lit("revoked"))
        .when(F.col("expires_at") <= as_of, F.lit("expired"))
        .otherwise(F.lit("valid"))
    )
    return token_lookup(tokens, sessions).withColumn("state", state)


def session_chain(sessions: DataFrame) -> DataFrame:
    """Sessions with the one that replaced them."""
    follower = sessions.select(
        F.col("id").alias("replaced_by_session_id"),
        F.lit(True).alias("_found"),
        F.col("created_at").alias("replacement_created_at"),
        F.col("revoked_at").alias("replacement_revoked_at"),
    )
    # Most sessions were never replaced: their nulls must not meet in one partition.
    replaced = sessions.filter(F.col("replaced_by_session_id").isNotNull())
    plain = sessions.filter(F.col("replaced_by_session_id").isNull())
    linked = replaced.join(follower, "replaced_by_session_id", "left")
    columns = [*sessions.columns, "replacement_created_at", "replacement_revoked_at"]
    return linked.select(*columns).unionByName(plain, allowMissingColumns=True).select(*columns)


def session_apply_events(sessions: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions after the events, outcome per event).

    Events are (seq, event_at, kind, token_hash, user_auth_id, new_id, new_token_hash), applied by ``seq``; times do not
    run backwards. ``create`` opens a session for ``user_auth_id``; ``rotate`` closes the session of ``token_hash``
    and opens one for the same user; ``revoke`` closes it. The outcome is valid, or unknown, revoked or expired for
    an event that changes nothing.

    An event may use a token that an earlier event of the same set issued. Whether it succeeds then depends on that
    one, and so on. These chains are followed by doubling the step, so a chain of n events takes log2(n) rounds.
    """
    opens = events.filter(F.col("kind").isin("create", "rotate")).select(
        F.col("new_token_hash").alias("token_hash"),
        F.col("seq").alias("issued_seq"),
        F.col("kind").alias("issued_kind"),
        session_expiry(F.col("event_at")).alias("issued_expiry"),
        F.col("user_auth_id").alias("issued_user"),
    )
    stored = sessions.select(
        "token_hash", F.lit(-1).cast("long").alias("issued_seq"), F.lit("stored").alias("issued_kind"),
        F.col("expires_at").alias("issued_expiry"), F.col("user_auth_id").alias("issued_user"),
        F.col("revoked_at").isNotNull().alias("was_revoked"),
    )
    tokens = stored.unionByName(opens.withColumn("was_revoked", F.lit(False)))

    uses = events.filter(F.col("kind").isin("rotate", "revoke")).select("seq", "event_at", "kind", "token_hash")
    # Columns of an event with the issue of its token; a use before the issue does not know the token.
    used = cut_lineage(
        skew_join(uses, tokens, "token_hash", "left", spread=F.col("seq")).withColumn(
            "known", F.coalesce(F.col("issued_seq") < F.col("seq"), F.lit(False))
        )
    )
    candidates = used.filter(F.col("known") & ~F.col("was_revoked") & (F.col("event_at") < F.col("issued_expiry")))
    first_use = first_per_group(candidates, ["token_hash"], [F.col("seq")])

    # A first use succeeds when its token was really issued: follow the issuing rotations to a stored or created one.
    chain = first_use.select(
        "seq", "token_hash", "event_at",
        F.when(F.col("issued_kind") == "rotate", F.col("issued_seq")).alias("up"),
        F.when(F.col("issued_kind") != "rotate", F.col("issued_user")).alias("owner"),
    )
    chain = cut_lineage(chain)
    while not chain.filter(F.col("up").isNotNull()).isEmpty():
        above = chain.select(F.col("seq").alias("up"), F.col("up").alias("up2"), F.col("owner").alias("owner2"))
        waiting = chain.filter(F.col("up").isNotNull()).join(above, "up", "left")
        stepped = waiting.select(
            "seq", "token_hash", "event_at", F.col("up2").alias("up"), F.coalesce("owner", "owner2").alias("owner")
        )
        chain = cut_lineage(chain.filter(F.col("up").isNull()).unionByName(stepped))
    won = chain.filter(F.col("owner").isNotNull()).select("seq", "token_hash", "event_at", "owner")

    winners = won.select("token_hash", F.col("seq").alias("won_seq"), F.col("event_at").alias("won_event_at"))
    issued_by = won.select(F.col("seq").alias("issued_seq"), F.lit(True).alias("_issued"))
    judged = skew_join(used, winners, "token_hash", "left", spread=F.col("seq"))
    judged = skew_join(judged, issued_by, "issued_seq", "left", spread=F.col("seq"))
    exists = F.col("known") & ((F.col("issued_kind") != "rotate") | F.coalesce("_issued", F.lit(False)))
    outcome = (
        F.when(~exists, F.lit("unknown"))
        .when(F.col("was_revoked") | (F.col("won_seq") < F.col("seq")), F.lit("revoked"))
        .when(F.col("event_at") >= F.col("issued_expiry"), F.lit("expired"))
        .otherwise(F.lit("valid"))
    )
    outcomes = judged.select("seq", "kind", outcome.alias("outcome")).unionByName(
        events.filter(F.col("kind") == "create").select("seq", "kind", F.lit("valid").alias("outcome"))
    )

    by_event = events.select("seq", "event_at", "kind", "user_auth_id", "new_id", "new_token_hash")
    rotated = by_event.filter(F.col("kind") == "rotate").join(won.select("seq", "owner"), "seq")
    opened = by_event.filter(F.col("kind") == "create").withColumn("owner", F.col("user_auth_id")).unionByName(rotated)
    added = opened.select(
        F.col("new_id").alias("id"),
        F.col("owner").alias("user_auth_id"),
        F.col("new_token_hash").alias("token_hash"),
        session_expiry(F.col("event_at")).alias("expires_at"),
        F.col("event_at").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("revoked_at"),
        F.lit(None).cast(sessions.schema["id"].dataType).alias("replaced_by_session_id"),
    )
    replacement = rotated.select("seq", F.col("new_id").alias("_by"))
    closed = won.join(replacement, "seq", "left").select(
        "token_hash", F.col("event_at").alias("_closed_at"), "_by"
    )
    after = sessions.select(*SESSION_COLS).unionByName(added).join(closed, "token_hash", "left").select(
        "id", "user_auth_id", "token_hash", "expires_at", "created_at",
        F.coalesce("_closed_at", "revoked_at").alias("revoked_at"),
        F.coalesce("_by", "replaced_by_session_id").alias("replaced_by_session_id"),
    )
    return after, outcomes
