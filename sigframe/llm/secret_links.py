"""Secret scan with multipart credential linking, DataFrame functions only.

Strong spans (assignments of a secret, access identifiers, long hex runs) are
always reported. Weak candidates (user names, endpoints, unnamed random-looking
strings) are reported only when complementary parts of a credential lie in the
same scope: an interval join of the spans of a document, each widened by
``SCOPE`` characters, evaluated as a range window over span starts so that no pairs
are built. Every secret is linked to its nearest identifier and endpoint in scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.llm.common import every_copy, one_each

# Characters between the starts of two spans that can be parts of one credential.
SCOPE = 240

# The strong kinds in order, each with its expression, the capture
# group whose length counts, the least length, and its role.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_KINDS = (
    ("assign", ASSIGN, 2, 6, "secret"),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, "identifier"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, "secret"),
)
# Weak kinds in order.
WEAK_KINDS = (
    ("user", r"""(?i:(user(?:_?name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", 2, 3, "identifier"),
    ("endpoint", r"""(?:https?|ftp|postgres|mysql|redis|mongodb|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+""", 0, 10, "endpoint"),
    ("host", r"""(?i:(host(?:name)?|server|endpoint|bucket|region))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._:/-]+)""", 2, 3, "endpoint"),
    ("blob", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9a-z+/_-]*+[A-Z])(?=[0-9A-Z+/_-]*+[a-z])[A-Za-z0-9+/_-]{28,}+={0,2}+(?![A-Za-z0-9+/_=-])", 0, 28, "secret"),
)
KINDS = tuple((name, number < len(BASE_KINDS), number, role) for number, (name, _, _, _, role) in enumerate(BASE_KINDS + WEAK_KINDS))

# A cheap test of each kind on the text and its lower-cased form.
GATES = {
    "assign": lambda text, low: F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api")),
    "access": lambda text, low: F.contains(text, F.lit("AKIA")),
    "hex": lambda text, low: F.rlike(text, F.lit(r"[0-9a-f]{24}")),
    "user": lambda text, low: F.contains(low, F.lit("user")) | F.contains(low, F.lit("login")) | F.contains(low, F.lit("account")) | F.contains(low, F.lit("client")) | F.contains(low, F.lit("access")),
    "endpoint": lambda text, low: F.contains(text, F.lit("://")),
    "host": lambda text, low: F.contains(low, F.lit("host")) | F.contains(low, F.lit("server")) | F.contains(low, F.lit("endpoint")) | F.contains(low, F.lit("bucket")) | F.contains(low, F.lit("region")),
    "blob": lambda text, low: F.rlike(text, F.lit(r"[A-Za-z0-9+/_-]{28}")),
}
NO_PIECES = "cast(array() as array<struct<kind:int,nth:int,gap:bigint,width:bigint,counted:bigint>>)"


def _pieces(number: int, kind: tuple, text: Column, low: Column) -> Column:
    """For every match of a kind, in order: the characters between it and the one before,
    its own and those of the group whose length counts."""
    name, pattern, group, _, _ = kind
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    cut = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("g"), whole.alias("w"), part.alias("p")), lambda x, i: F.struct(
        F.lit(number).alias("kind"), i.alias("nth"), F.length(x["g"]).cast("long").alias("gap"),
        F.length(x["w"]).cast("long").alias("width"), F.length(x["p"]).cast("long").alias("counted")))
    return F.when(GATES[name](text, low), F.when(F.rlike(text, F.lit(pattern)), cut)).otherwise(F.expr(NO_PIECES))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id and spans, an array of (start, kind number, end,
    kind, base, identifier, endpoint) sorted by start and kind. Places are code points,
    end exclusive; identifier and endpoint are the starts of the parts linked to a
    secret, null where there is none in scope. Matches of one kind do not overlap
    (leftmost first); a match too short for its kind is dropped after matching. A null
    text counts as empty. Repeated rows each give a row; ids may be null."""
    kinds = BASE_KINDS + WEAK_KINDS
    found = F.element_at(F.transform(F.array(F.struct(F.col("text").alias("t"), F.lower("text").alias("l"))), lambda x: F.concat(
        *[F.coalesce(_pieces(i, k, x["t"], x["l"]), F.expr(NO_PIECES)) for i, k in enumerate(kinds)])), 1)
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .select("doc_id", F.md5("text").alias("th"), found.alias("found")))
    # grouped by (doc_id, th), so that the windows and the last grouping need no other exchange
    rows = one_each(rows, "found").select("doc_id", "th", "copies", F.explode_outer("found").alias("x")).select("doc_id", "th", "copies", "x.*")
    # The place of a match is what precedes it in its kind, gaps and matches.
    before = Window.partitionBy("doc_id", "th", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.array(*[F.lit(k[3]) for k in kinds]), F.col("kind") + 1)
    role = F.element_at(F.array(*[F.lit(k[4]) for k in kinds]), F.col("kind") + 1)
    name = F.element_at(F.array(*[F.lit(k[0]) for k in kinds]), F.col("kind") + 1)
    placed = (rows.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(before))
              .select("doc_id", "th", "copies", "kind", (F.col("end") - F.col("width")).alias("start"), "end",
                      F.when(F.col("counted") >= least, role).alias("role"), name.alias("name")))
    part = lambda r: F.when(F.col("role") == r, F.col("start"))
    around = Window.partitionBy("doc_id", "th").orderBy("start").rangeBetween(-scope, scope)
    left = Window.partitionBy("doc_id", "th").orderBy("start").rangeBetween(-scope, 0)
    right = Window.partitionBy("doc_id", "th").orderBy("start").rangeBetween(0, scope)
    linked = placed.select(
        "*",
        *[F.count(part(r)).over(around).alias(f"n_{r}") for r in ("identifier", "secret", "endpoint")],
        *[F.last(part(r), True).over(left).alias(f"before_{r}") for r in ("identifier", "endpoint")],
        *[F.first(part(r), True).over(right).alias(f"after_{r}") for r in ("identifier", "endpoint")])
    weak = F.col("kind") >= len(BASE_KINDS)
    together = F.when(F.col("role") == "secret", F.col("n_identifier") + F.col("n_endpoint") > 0).otherwise(F.col("n_secret") > 0)

    def near(r: str) -> Column:
        b, a = F.col(f"before_{r}"), F.col(f"after_{r}")
        nearest = F.when(a.isNull() | (F.col("start") - b <= a - F.col("start")), b).otherwise(a)
        return F.when(F.col("role") == "secret", nearest)

    span = F.when(F.col("role").isNotNull() & (~weak | together), F.struct(
        "start", "kind", "end", F.col("name"), (~weak).alias("base"), near("identifier").alias("identifier"), near("endpoint").alias("endpoint")))
    return every_copy(linked.groupBy("doc_id", "th").agg(F.first("copies").alias("copies"), F.sort_array(F.collect_list(span)).alias("spans"))).drop("th")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from those of ``scan``."""
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda n: F.size(F.filter("spans", lambda x: x["kind"] == n)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(said(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        F.transform(F.filter("spans", lambda x: x["identifier"].isNotNull() | x["endpoint"].isNotNull()),
                    lambda x: F.struct(x["start"].alias("secret"), x["identifier"].alias("identifier"), x["endpoint"].alias("endpoint"))).alias("links"))
