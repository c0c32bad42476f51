"""Domain schemas: allowed classes, their attributes, closed value lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Domain:
    """required and optional attribute keys by class; values: closed lists by class and key, None for free text;
    ignored: keys that matching doesn't score."""

    classes: tuple[str, ...]
    keys: dict[str, tuple[str, ...]]
    values: dict[str, dict[str, tuple[str, ...] | None]]
    optional: dict[str, tuple[str, ...]]
    ignored: tuple[str, ...] = ()

    def _by_class(self, cls: Column, table: dict, empty: Column) -> Column:
        out = empty
        for name, value in table.items():
            out = F.when(cls == name, value).otherwise(out)
        return out

    def required(self, cls: Column) -> Column:
        return self._by_class(cls, {c: F.array(*map(F.lit, k)).cast("array<string>") for c, k in self.keys.items() if k}, F.array().cast("array<string>"))

    def columns(self, cls: Column) -> tuple[Column, Column, Column]:
        """Is the class allowed; its attribute keys; a map of its closed value lists. Constants of the plan: the schema
        is configuration, not data."""
        none = F.array().cast("array<string>")
        keys = {c: F.array(*map(F.lit, (*self.keys.get(c, ()), *self.optional.get(c, ())))).cast("array<string>") for c in self.classes if self.keys.get(c) or self.optional.get(c)}
        lists = {c: F.create_map(*[x for k, v in of.items() if v is not None for x in (F.lit(k), F.array(*map(F.lit, v)))]) for c, of in self.values.items() if any(v is not None for v in of.values())}
        return F.coalesce(cls.isin(*self.classes), F.lit(False)), self._by_class(cls, keys, none), self._by_class(cls, lists, F.create_map().cast("map<string,array<string>>"))


#: The default domain. Fixed values of the evaluation contract.
DEFAULT = Domain(
    classes=("summary", "motivation", "goal", "non_goal", "design_decision", "user_story", "definition", "future_work", "risk", "mitigation", "test_case", "graduation_criterion", "drawback", "alternative", "implementation_history"),
    keys={
        "design_decision": ("category",),
        "definition": ("definition_type",),
        "future_work": ("horizon",),
        "test_case": ("test_type",),
        "graduation_criterion": ("stage",),
        "implementation_history": ("marker", "marker_type"),
    },
    values={
        "design_decision": {"category": ("proposal_definition", "workflow", "api_change", "component_change", "compatibility", "rollout", "upgrade_strategy", "version_skew_strategy", "dependency", "monitoring", "scalability", "troubleshooting", "implementation_detail", "other")},
        "definition": {"definition_type": ("term", "role", "artifact", "other")},
        "future_work": {"horizon": ("post_ga", "future_extension", "backlog", "other")},
        "test_case": {"test_type": ("prerequisite_update", "unit_test", "integration_test", "e2e_test", "conformance_test", "manual_validation", "benchmark_or_scale", "other")},
        "graduation_criterion": {"stage": ("alpha", "beta", "ga", "stable", "other")},
        "implementation_history": {"marker": None, "marker_type": ("release", "date", "stage", "other")},
    },
    optional={},
)
