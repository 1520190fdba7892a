"""Errors with stable codes."""

from __future__ import annotations


class EngineError(Exception):
    code = "POC_ERROR"

    def __str__(self) -> str:
        return f"{self.code}: {super().__str__()}"


def _kind(name: str, code: str) -> type[EngineError]:
    return type(name, (EngineError,), {"code": code})


SessionNotFound = _kind("SessionNotFound", "SESSION_NOT_FOUND")
DecisionInvalid = _kind("DecisionInvalid", "DECISION_VALIDATION_ERROR")
EvidenceNotFound = _kind("EvidenceNotFound", "DECISION_EVIDENCE_NOT_FOUND")
ProjectionInput = _kind("ProjectionInput", "PROJECTION_INPUT_ERROR")
SectionBundle = _kind("SectionBundle", "SECTION_BUNDLE_ERROR")
CandidateFailure = _kind("CandidateFailure", "INTEGRATION_CANDIDATE_ERROR")
AdjudicationFailure = _kind("AdjudicationFailure", "INTEGRATION_ADJUDICATION_ERROR")
LifecycleFailure = _kind("LifecycleFailure", "LIFECYCLE_ADJUDICATION_ERROR")
SignalFailure = _kind("SignalFailure", "SIGNAL_ANNOTATION_ERROR")
KnowledgeFailure = _kind("KnowledgeFailure", "KNOWLEDGE_EXPERIMENT_ERROR")


def raise_first(violations, kind: type[EngineError]) -> None:
    """Raises kind with the first violation (columns ord, message), if there is one."""
    first = violations.orderBy("ord", "message").select("message").head(1)
    if first:
        raise kind(first[0]["message"])
