"""Access and write policies as boolean columns over identities and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of agents, actions, the scope that writes ask for by default, scopes that only people get.
AGENT_KINDS = ["agent", "service", "client"]
ACTIONS = ["list", "read", "query", "rewrite"]
VISIBILITIES = ["public", "restricted"]
WRITE_SCOPE = "sources.write"
PEOPLE_ONLY = ["admin.write"]
ACTIVE = ["curated", "published"]


def effective_visibility() -> Column:
    """The access record's own visibility if it is a valid one, else the column's."""
    return F.when(F.col("access_visibility").isin(VISIBILITIES), F.col("access_visibility")).otherwise(F.col("visibility"))


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def can_access(pairs: DataFrame, action: str = "query") -> DataFrame:
    """Add ``can_access``. ``pairs``: ``kind``, ``groups``, ``status``, ``visibility``, ``access_visibility``, ``allowed_groups``."""
    gate = ~F.col("kind").isin(AGENT_KINDS) | F.col("status").isin(ACTIVE)
    admin = (F.col("kind") == "user") & F.array_contains("groups", "admin")
    v = effective_visibility()
    open_ = (v == "public") & F.lit(action in ACTIONS)
    closed = (v == "restricted") & (_no(admin) | _no(F.arrays_overlap("groups", "allowed_groups")))
    return pairs.withColumn("can_access", _no(gate & (open_ | closed)))


def can_write(pairs: DataFrame, mode: str) -> DataFrame:
    """Add ``can_write``. ``pairs``: ``groups``, ``scopes``, ``status``, ``w_allowed``, ``w_scope``, ``w_modes``, ``w_groups``."""
    scope = F.coalesce(F.nullif("w_scope", F.lit("")), F.lit(WRITE_SCOPE))
    groups = F.coalesce(F.size("w_groups") == 0, F.lit(True)) | _no(F.arrays_overlap("groups", "w_groups"))
    allowed = F.col("status").isin(ACTIVE) & _no(F.col("w_allowed")) & _no(F.array_contains("scopes", scope)) & _no(F.array_contains("w_modes", mode)) & groups
    return pairs.withColumn("can_write", _no(allowed))


def ui_visible(pairs: DataFrame) -> DataFrame:
    """Published sources for all, others for admins and the owning team."""
    return pairs.withColumn("visible", _no((F.col("status") == "published") | F.array_contains("groups", "admin") | F.array_contains("groups", F.col("owner_team"))))


def resolve_scopes(requests: DataFrame) -> DataFrame:
    """``granted`` scopes and ``error``: none asked for gives all allowed ones; ``requested``, ``allowed``, ``known``, ``kind``."""
    people = F.array(*[F.lit(x) for x in PEOPLE_ONLY])
    may = F.when(F.col("kind").isin("agent", "service"), F.array_except("allowed", people)).otherwise(F.col("allowed"))
    asked = F.coalesce("requested", F.array().cast("array<string>"))
    error = (
        F.when(F.size(asked) == 0, F.lit(None))
        .when(F.size(F.array_except(asked, "known")) > 0, "unknown scope")
        .when(F.size(F.array_except(asked, may)) > 0, "scope not allowed")
    )
    granted = F.when(error.isNotNull(), F.array().cast("array<string>")).when(F.size(asked) == 0, may).otherwise(F.array_distinct(asked))
    return requests.withColumn("granted", F.array_sort(granted)).withColumn("error", error)


# Claims of a token, and kinds of identity.
CLAIMS = (
    "iss string, aud string, exp bigint, nbf bigint, iat bigint, jti string, sub string, scope string, "
    "rh_identity_kind string, rh_identity_groups string, rh_tenant string, rh_request_id string, rh_caller_app string"
)
KINDS = ["user", "agent", "service", "client"]


def token_claims(tokens: DataFrame, issuer: str, audience: str, now: int, keys: list[str], skew: int = 30) -> DataFrame:
    """The identity that each ``token`` carries and the first reason why it doesn't pass, in the order of the checks.

    Signatures are checked elsewhere; ``keys`` are the ids of known keys. The columns of an
    identity are null where there is an error.
    """
    text = lambda k: F.translate(F.get(F.split("token", r"\."), F.lit(k)), "-_", "+/")
    padded = lambda k: F.rpad(text(k), (F.ceil(F.length(text(k)) / 4) * 4).cast("int"), "=")
    part = lambda k: F.try_to_binary(padded(k), F.lit("base64")).cast("string")
    t = tokens.withColumn("_head", part(0)).withColumn("_body", part(1))
    t = t.withColumn("_key", F.from_json("_head", "kid string")["kid"]).withColumn("_c", F.from_json("_body", CLAIMS))
    c = lambda name: F.col(f"_c.{name}")
    listed = lambda name: F.startswith(F.trim(c(name)), F.lit("["))
    several = F.from_json(c("aud"), "array<string>")
    heard = F.when(listed("aud"), F.array_contains(several, audience)).otherwise(c("aud") == audience)
    error = (
        F.when((F.size(F.split("token", r"\.")) != 3) | F.col("_key").isNull() | F.get_json_object("_body", "$").isNull(), "malformed")
        .when(~F.col("_key").isin(keys), "unknown key")
        .when(F.coalesce(c("iss"), F.lit("")) != issuer, "issuer")
        .when(~F.coalesce(heard, F.lit(False)), "audience")
        .when(c("exp").isNull(), "no expiry")
        .when(F.lit(now) > c("exp") + skew, "expired")
        .when(c("nbf") > now + skew, "not yet valid")
        .when(~F.coalesce(c("rh_identity_kind").isin(KINDS), F.lit(False)), "kind")
        .when(c("rh_identity_groups").isNotNull() & ~F.coalesce(listed("rh_identity_groups"), F.lit(False)), "groups")
        .when(F.rlike(F.coalesce(c("scope"), F.lit("")), F.lit(r"^[\[{]")), "scope")
    )
    groups = F.coalesce(F.from_json(c("rh_identity_groups"), "array<string>"), F.array().cast("array<string>"))
    scopes = F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(c("scope"), F.lit("")), r"\s+"), lambda x: x != "")))
    shown = {
        "subject": F.coalesce(c("sub"), F.lit("")), "kind": c("rh_identity_kind"), "groups": F.array_join(groups, ","), "scopes": F.array_join(scopes, ","),
        "tenant": F.coalesce(c("rh_tenant"), F.lit("default")), "request_id": c("rh_request_id"), "caller_app": c("rh_caller_app"),
        "jti": F.coalesce(c("jti"), F.lit("")), "issued_at": F.coalesce(c("iat"), F.lit(0)), "expires_at": c("exp"),
    }
    return t.withColumn("error", error).select("token_id", "error", *[F.when(F.col("error").isNull(), x).alias(name) for name, x in shown.items()])
