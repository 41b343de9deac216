"""Full evidence analysis of all answers at once: every part as a lazily built frame."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..operators import evidence as E, lens as L
from ..operators.ordered import one_chunk
from ..runtime import stage


class Analysis:
    """Parts share what they are built from; the shared ones are written once through ``keep``."""

    def __init__(self, scoped: DataFrame, answers: DataFrame, scope: DataFrame, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None):
        self.scoped, self.answers, self.scope = scoped, answers, scope
        self._keep = keep or (lambda name, build: stage(build()))

    @cached_property
    def refs(self) -> DataFrame:
        return self._keep("refs", lambda: E.source_refs(self.scoped))

    @cached_property
    def whole(self) -> bool:
        """Whether no answer reaches over a border of the ordered scans. A bound of the stored frames, read once."""
        return one_chunk(self.scoped)

    @cached_property
    def captures(self) -> DataFrame:
        return self._keep("captures", lambda: E.source_captures(self.refs))

    @cached_property
    def sources(self) -> DataFrame:
        return self._keep("sources", lambda: E.flag_spoof(E.source_ledger(self.captures)))

    @cached_property
    def canonical(self) -> DataFrame:
        return E.canonical_sources(self.captures, self.sources)

    @cached_property
    def evidence(self) -> DataFrame:
        return self._keep("evidence", lambda: E.adjudicate(self.scoped, self.captures, self.sources, self.whole))

    @cached_property
    def claims(self) -> DataFrame:
        return self._keep("claims", lambda: E.extract_claims(self.scoped))

    @cached_property
    def condition_rows(self) -> DataFrame:
        return self._keep("condition_rows", lambda: E.condition_rows(self.scoped))

    @cached_property
    def missing(self) -> DataFrame:
        return E.missing_conditions(self.condition_rows, self.evidence)

    @cached_property
    def matches(self) -> DataFrame:
        return E.condition_match(self.scoped, self.condition_rows)

    @cached_property
    def checks(self) -> DataFrame:
        return self._keep("checks", lambda: E.verifications(self.scoped, self.claims, self.evidence))

    @cached_property
    def conflicts(self) -> DataFrame:
        return self._keep("conflicts", lambda: E.conflicts(self.scoped, self.matches, E.proofs(self.scoped, self.evidence)))

    @cached_property
    def under(self) -> DataFrame:
        return self._keep("under", lambda: E.conflict_claims(self.scoped, self.claims))

    @cached_property
    def support_rows(self) -> DataFrame:
        return self._keep("support_rows", lambda: E.claim_support(self.scoped, self.evidence, self.canonical))

    @cached_property
    def verdicts(self) -> DataFrame:
        return self._keep("verdicts", lambda: E.claim_verdict(E.importance(self.claims, self.scoped), self.support_rows, self.evidence, self.conflicts, self.under))

    @cached_property
    def answer_support(self) -> DataFrame:
        rows = self.answers.select(F.col("receipt_id").alias("aid"), "completeness")
        return self._keep("answer_support", lambda: E.answer_support(rows, self.verdicts, self.conflicts, self.under, self.missing))

    @cached_property
    def references(self) -> DataFrame:
        return self._keep("references", lambda: E.reference_diagnostics(self.scoped))

    @cached_property
    def branched(self) -> DataFrame:
        return self._keep("branched", lambda: L.with_branch(self.scoped, self.whole))

    @cached_property
    def filed(self) -> DataFrame:
        return L.event_sources(self.refs, self.sources)

    @cached_property
    def checkpoints(self) -> DataFrame:
        return self._keep("checkpoints", lambda: L.select_checkpoints(self.scoped, self.evidence, whole=self.whole))
