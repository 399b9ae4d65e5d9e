"""Access decisions for a table of requests against roles and policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.text import glob_regex
from waybill.operators.skew import skew_join


@dataclass(frozen=True)
class Permission:
    resource: str
    actions: tuple[str, ...]


@dataclass(frozen=True)
class Condition:
    key: str
    operator: str
    value: str


@dataclass(frozen=True)
class PolicyRule:
    effect: str  # allow or deny
    resource: str
    actions: tuple[str, ...]
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Role:
    permissions: tuple[Permission, ...] = ()
    policies: tuple[str, ...] = ()


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _matches(resource: str, actions: Sequence[str]) -> Column:
    test = F.lit(True) if resource == "*" else F.col("resource").rlike(glob_regex(resource.replace("?", "\\?")))
    return test if "*" in actions else test & F.col("action").isin(*actions)


def _holds(c: Condition) -> Column:
    """A missing context value never satisfies a condition."""
    v = F.col(c.key)
    tests = {
        "equals": v == c.value,
        "not_equals": v != c.value,
        "contains": v.contains(c.value),
        "starts_with": v.startswith(c.value),
        "ends_with": v.endswith(c.value),
    }
    return F.coalesce(tests.get(c.operator, F.lit(False)), F.lit(False))


def _effect(rules: Sequence[PolicyRule]) -> Column:
    """Effect of the first rule that matches; NULL when none does."""
    out = F.when(F.lit(False), "")
    for r in rules:
        out = out.when(reduce(lambda a, b: a & b, [_holds(c) for c in r.conditions], _matches(r.resource, r.actions)), r.effect)
    return out


def access_decisions(requests: DataFrame, users: DataFrame, roles: Mapping[str, Role], policies: Mapping[str, Sequence[PolicyRule]]) -> DataFrame:
    """Decision and reason per request (``user_name``, ``resource``, ``action`` and context columns).

    ``users`` has one row per user: name, ``active``, array ``roles``. Roles and policies are
    configuration, so they become one expression; only users are joined. An allow from any
    role beats a deny.
    """
    joined = skew_join(requests, users.select("user_name", "active", "roles"), "user_name", "left")
    has = lambda name: F.coalesce(F.array_contains("roles", name), F.lit(False))
    permitted = _any([has(n) & _any([_matches(p.resource, p.actions) for p in r.permissions]) for n, r in roles.items()])
    effects = {name: _effect(rules) for name, rules in policies.items()}
    by_policy = {
        effect: _any([has(n) & F.coalesce(effects[p] == effect, F.lit(False)) for n, r in roles.items() for p in r.policies])
        for effect in ("allow", "deny")
    }
    reason = (
        F.when(F.col("active").isNull(), "unknown user")
        .when(~F.col("active"), "user inactive")
        .when(permitted, "role permission")
        .when(by_policy["allow"], "allowed by policy")
        .when(by_policy["deny"], "denied by policy")
        .otherwise("no matching rule")
    )
    decided = joined.withColumn("reason", reason)
    return decided.withColumn("allowed", F.col("reason").isin("role permission", "allowed by policy")).drop("active", "roles")
