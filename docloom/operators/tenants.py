"""Tenant scope: who may read and append what.

A scope is made for an actor and a tenant, and every table is read through it:
its policies come first in the plan, so the scan gets them as filters. Appends
are checked by the same policies, and public ones against the documents they
belong to; what they refuse comes back as rows with a reason.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.rejects import Rule, split

SCOPES = ("public", "firm", "tenant_private")
STATUSES = ("pending", "active", "inactive", "archived", "deleted")


class AccessError(PermissionError):
    """The actor may not act for this tenant."""


@dataclass(frozen=True)
class Actor:
    """Who asks: a customer acts for one tenant, an administrator for those assigned too."""

    user: str
    tenant: str
    role: str
    allowed: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        object.__setattr__(self, "allowed", frozenset(self.allowed))
        if not self.user.strip() or not self.tenant.strip() or any(not t.strip() for t in self.allowed):
            raise ValueError("users and tenants have names")

    def acting_for(self, tenant: str | None = None) -> str:
        """The tenant asked for, if the actor may act for it; else their own."""
        if tenant is not None and not tenant.strip():
            raise ValueError("a tenant has a name")
        wanted = self.tenant if tenant is None else tenant
        if self.role not in ("customer", "admin"):
            raise AccessError("unknown role")
        if wanted != self.tenant and (self.role == "customer" or wanted not in self.allowed):
            raise AccessError(f"no access to tenant {wanted}")
        return wanted


class TenantScope:
    """Reads and appends for one tenant."""

    def __init__(self, actor: Actor, tenant: str | None = None, public_writes: bool = False):
        self.actor, self.tenant, self.public_writes = actor, actor.acting_for(tenant), public_writes
        if public_writes and actor.role != "admin":
            raise AccessError("public knowledge is written by administrators")

    def own(self) -> Column:
        return F.coalesce(F.col("tenant_id") == self.tenant, F.lit(False))

    def knowledge(self, rows: DataFrame) -> DataFrame:
        """Rows (scope, tenant_id) that are public, or the tenant's of a scope of its own."""
        return rows.where((F.col("scope") == "public") | ((F.col("tenant_id") == self.tenant) & F.col("scope").isin(*SCOPES[1:])))

    def private(self, rows: DataFrame) -> DataFrame:
        """Rows (tenant_id) of the tenant."""
        return rows.where(F.col("tenant_id") == self.tenant)

    def listed(self, documents: DataFrame, scope: str | None = None, status: str | None = None) -> DataFrame:
        """Documents the tenant may see, of a scope and a status; without one, all that are not deleted."""
        if scope is not None and scope not in SCOPES:
            raise ValueError(f"unknown scope {scope}")
        if status is not None and status not in STATUSES:
            raise ValueError(f"unknown status {status}")
        rows = self.knowledge(documents)
        rows = rows if scope is None else rows.where(F.col("scope") == scope)
        return rows.where(F.col("status") != "deleted") if status is None else rows.where(F.col("status") == status)

    def with_status(self, documents: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """documents (doc, scope, tenant_id, status and more) after requests (doc,
        status), and an answer to each (doc, changed). A request changes documents
        of the tenant that are not public, whatever their status was, and is no
        error where it changes none; of several for one document the status that
        comes last in STATUSES counts."""
        place = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
        wanted = requests.withColumn("__p", place).where("__p > 0").groupBy("doc").agg(F.max_by("status", "__p").alias("__wanted"))
        met = documents.join(wanted, "doc", "left")
        mine = F.col("__wanted").isNotNull() & F.coalesce(F.col("scope") != "public", F.lit(False)) & self.own()
        after = met.withColumn("status", F.when(mine, F.col("__wanted")).otherwise(F.col("status"))).select(*documents.columns)
        touched = met.where(mine).select("doc").distinct().withColumn("changed", F.lit(True))
        return after, requests.select("doc").distinct().join(touched, "doc", "left").na.fill(False, ["changed"])

    def appendable(self, rows: DataFrame, more: Iterable[Rule] = ()) -> tuple[DataFrame, DataFrame]:
        """Private rows are the tenant's, public ones an administrator's with no tenant."""
        public = F.col("scope") == "public"
        rules = [
            Rule("unknown scope", ~F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False))),
            Rule("public rows need an administrator", public & F.lit(not self.public_writes)),
            Rule("public rows have no tenant", public & F.col("tenant_id").isNotNull()),
            Rule("another tenant's row", ~public & ~self.own()),
            *more,
        ]
        return split(rows, rules)

    def appendable_documents(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Documents (scope, tenant_id, source_type): public ones are law."""
        return self.appendable(rows, [Rule("public documents are law", (F.col("scope") == "public") & ~F.coalesce(F.col("source_type") == "law", F.lit(False)))])

    def appendable_chunks(self, rows: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Chunks (doc, scope, tenant_id) of documents (doc, scope, tenant_id,
        source_type): public ones belong to public law, private ones to a document
        of their scope and tenant."""
        known = documents.groupBy("doc").agg(F.first("scope").alias("__s"), F.first("tenant_id").alias("__t"), F.first("source_type").alias("__y"), F.lit(True).alias("__k"))
        met = rows.join(known, "doc", "left")
        public = F.col("scope") == "public"
        apart = ~F.col("scope").eqNullSafe(F.col("__s")) | ~F.col("tenant_id").eqNullSafe(F.col("__t"))
        fine, bad = self.appendable(met, [Rule("unknown document", F.col("__k").isNull()), Rule("public chunks belong to public law", public & F.col("__k") & ~F.coalesce((F.col("__s") == "public") & (F.col("__y") == "law"), F.lit(False))), Rule("scope or tenant unlike the document's", F.col("__k") & apart)])
        return fine.select(*rows.columns), bad.select(*rows.columns, "problems")
