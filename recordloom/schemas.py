"""Fixed values and row schemas of the engine."""

from __future__ import annotations

EVENT_KINDS = ("message", "command", "tool", "file_change", "metadata", "unknown", "parse_error")
DECISION_STATUSES = ("proposed", "accepted", "rejected", "superseded", "reverted", "cancelled", "unknown")
LIFECYCLE_STATUSES = ("proposed", "accepted", "rejected", "superseded", "reverted", "cancelled")
CONFIDENCES = ("high", "medium", "low")
EVIDENCE_TYPES = ("message", "attachment")
RELATIONS = ("same_decision", "distinct", "lifecycle_relation", "parent_child", "not_decision", "uncertain")
LIFECYCLE_DIRECTIONS = ("accepts", "changes", "supersedes", "rejects", "cancels", "reverts")
#: What a lifecycle direction makes of its target.
STATUS_AFTER = {"accepts": "accepted", "changes": "superseded", "supersedes": "superseded", "rejects": "rejected", "cancels": "cancelled", "reverts": "reverted"}
SIGNAL_TYPES = ("request_candidate", "acceptance_candidate", "rejection_candidate", "reason_candidate", "uncertainty_candidate", "alternative_candidate")
REPAIRABLE = ("alternatives", "rationale", "risks", "revisit_conditions", "missing_information")

REFS = "array<struct<evidence_type:string,evidence_id:string>>"
ALTERNATIVES = "array<struct<alternative:string,reason:string>>"
RAW_EVENTS = "id string, session_id string, source_line int, raw_text string, parsed_ok boolean, event_type string, timestamp string"
EVENTS = "id string, session_id string, raw_event_id string, source_line int, source_event_type string, kind string, role string, timestamp string, content string"
DECISIONS_V1 = f"decision_id string, title string, decision string, context string, alternatives array<string>, rationale array<string>, rejected_alternatives {ALTERNATIVES}, risks array<string>, revisit_conditions array<string>, evidence_message_ids array<string>, confidence string, missing_information array<string>, status string"
DECISIONS_V3 = DECISIONS_V1.replace("evidence_message_ids array<string>", f"evidence_refs {REFS}")
V1_FIELDS = tuple(x.strip().split(" ")[0] for x in "decision_id, title, decision, context, alternatives, rationale, rejected_alternatives, risks, revisit_conditions, evidence_message_ids, confidence, missing_information, status".split(","))
V3_FIELDS = tuple("evidence_refs" if x == "evidence_message_ids" else x for x in V1_FIELDS)
INVENTORY = f"session_id string, source_decision_key string, section_id string, source_decision_id string, title string, decision string, context string, alternatives array<string>, rationale array<string>, rejected_alternatives {ALTERNATIVES}, risks array<string>, revisit_conditions array<string>, status string, confidence string, missing_information array<string>, evidence_refs {REFS}, source_file string, source_sha256 string"
JUDGMENTS = f"cluster_id string, pos int, judgment_id string, relation string, member_decision_keys array<string>, direction struct<from_decision_key:string,relation:string,to_decision_key:string>, rationale array<string>, evidence_refs {REFS}, confidence string, missing_information array<string>"
LIFECYCLE_RESULTS = f"group_id string, pos int, decision_id string, final_status string, rationale array<string>, evidence_refs {REFS}, confidence string, missing_information array<string>"
