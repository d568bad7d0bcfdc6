"""Tenants: lists, counts and isolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_tenants(tenants: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """Tenants of a status in order of creation, at most ``limit``."""
    chosen = tenants if status is None else tenants.where(F.col("status") == status)
    return chosen.orderBy("created_at", "tenant_id").limit(limit)


def tenant_counts(tenants: DataFrame) -> DataFrame:
    """Tenants per status and in total."""
    return (
        tenants.rollup("status")
        .agg(F.count(F.lit(1)).alias("tenants"))
        .withColumn("status", F.coalesce("status", F.lit("(all)")))
    )


def visible_rows(rows: DataFrame, tenants: DataFrame, tenant_id: str = "tenant_id") -> DataFrame:
    """Rows of active tenants only."""
    active = tenants.where(F.col("status") == "active").select(F.col("tenant_id").alias(tenant_id))
    return rows.join(active, tenant_id, "left_semi")


def scope_to(rows: DataFrame, context_tenant: Column, tenant_id: str = "tenant_id") -> DataFrame:
    """Row-level predicate of one tenant's context."""
    return rows.where(F.col(tenant_id) == context_tenant)


def violations(accesses: DataFrame, isolated: Column | None = None) -> DataFrame:
    """Accesses of an isolated context to another tenant's data."""
    enforced = F.lit(True) if isolated is None else isolated
    return accesses.where(enforced & ~F.col("context_tenant").eqNullSafe(F.col("target_tenant")))
