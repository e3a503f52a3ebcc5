"""Explicit schemas of the inputs; nothing is inferred."""

from __future__ import annotations

ROW_V4 = ("id string, text string, source_type string, trust_level string, attack_class string, risk_level string, expected_action string, contains_sensitive_sink boolean, requires_tool_call boolean, "
          "bypass_class string, group_id string, split string, family_id string, generator_id string, benign_subclass string, label_source string, created_round string")  # fmt: skip
TURN = "struct<role: string, source_type: string, text: string>"
CONTRACT = "struct<stage: string, required_runtime_fields: array<string>, rule_id: string, native_policy_decision: string, evidence_tags: array<string>>"
ROW_V7 = (ROW_V4 + f", agt_policy_decision string, quarantine_intent boolean, match_group_id string, semantic_family_id string, canonical_payload_sha256 string, text_marker string, turns array<{TURN}>, placement string, "
          f"owasp_llm array<string>, mitre_atlas array<string>, containment_class string, defense_stage string, control_under_test string, control_contract {CONTRACT}, acs_verdict string, blocked_on array<string>, "
          "source_name string, source_license string, technique_source string, technique_license string, literal_payload_import boolean, provenance_kind string, synthetic_fields array<string>, synthetic_value_policy string")  # fmt: skip
SCORED = ("id string, split string, label string, attack_class string, benign_subclass string, bypass_class string, source_type string, trust_level string, expected_action string, contains_sensitive_sink boolean, "
          "requires_tool_call boolean, margin double, threshold_tau double, pred_attack boolean")  # fmt: skip
TRACE = "trace_id long, scenario_id string, row_id string, tool string, capability string, attempted boolean, executed boolean, blocked_at string, canary_leaked boolean, audit_event_present boolean, reason string"
SCENARIO = ("id string, title string, trap_class string, attack_class string, target_layer string, delivery_surface string, views struct<human_visible: string, agent_visible: string>, "
            "session_model struct<turns: long, stateful: boolean, agents: long>, environment_fixtures array<string>, controls array<string>, success_conditions array<string>, evidence_expected array<string>, "
            "standards struct<asi: array<string>, aivss_metrics: array<string>, opencre_relations: array<string>>, measurement_suite string, scenario_kind string, evasion_technique string, expected_control_behavior string")  # fmt: skip
CONTROLS = "id string, name string, trap_classes string, asi string, aivss string, evidence string, opencre_relation string"
RELATIONS = "control_id string, target string, relation string, backing_ref string"
