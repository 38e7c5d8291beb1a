"""Rules on inputs, messages and tool arguments: (id, category, score, severity, pattern), all ignoring case."""

from __future__ import annotations

_OVERRIDE = r"(?:ignore|disregard|forget|override|bypass|dismiss|discard|drop|neglect|set\s+aside|pay\s+no\s+(?:heed|attention)\s+to)"
_EARLIER = r"(?:(?:all|any|every|the|your|these|those|of|my)\s+){0,3}(?:previous|prior|earlier|above|preceding|existing|original|initial|former|foregoing|system)"
_ORDERS = r"(?:instructions?|prompts?|rules?|directives?|guidelines?|commands?|directions?|constraints?|programming|training|context|messages?)"
_INTERPRETER = r"(?:ba|z|k|da)?sh|python[23]?|perl|ruby|node|php"

INPUT_RULES = [
    ("LLM01_direct_override", "prompt_injection", 0.95, "critical", rf"\b{_OVERRIDE}\s+{_EARLIER}\s+(?:\w+\s+){{0,2}}{_ORDERS}\b"),
    ("LLM01_override_synonym_verbs", "prompt_injection", 0.85, "high", rf"\b(?:abandon|erase|wipe|delete|cancel|void|nullify|supersede|replace|overrule|overwrite|rescind|revoke)\s+{_EARLIER}\s+(?:\w+\s+){{0,2}}{_ORDERS}\b"),
    ("LLM01_override_expanded_nouns", "prompt_injection", 0.8, "high", rf"\b{_OVERRIDE}\s+(?:(?:all|any|every|of|the|your|its)\s+){{1,3}}(?:safety\s+)?(?:guidelines?|guardrails?|policies|restrictions?|safeguards?|filters?|instructions?|rules?)\b"),
    ("LLM01_new_instructions", "prompt_injection", 0.7, "high", r"\b(?:here\s+are\s+)?your\s+(?:new|real|actual|updated)\s+(?:instructions?|rules?|orders?|task)\s*(?:are|is|:)"),
    ("LLM01_dan_classic", "jailbreak", 0.95, "critical", r"\b(?:you\s+are\s+(?:now\s+)?|act\s+as\s+|become\s+|enable\s+|pretend\s+to\s+be\s+)(?:dan|stan|dude|aim)\b|\bdo\s+anything\s+now\b"),
    ("LLM01_persona_hijack", "jailbreak", 0.8, "high", r"\b(?:you\s+are\s+now|from\s+now\s+on\s+you(?:\s+are|'re)|pretend\s+(?:to\s+be|you\s+are)|act\s+as)\s+(?:an?\s+)?(?:\w+\s+){0,3}(?:unrestricted|uncensored|unfiltered|evil|jailbroken|amoral|without\s+(?:any\s+)?(?:rules|restrictions|limits|filters))"),
    ("LLM01_developer_mode", "jailbreak", 0.8, "high", r"\b(?:enter|enable|activate|switch\s+to)\s+(?:developer|debug|god|maintenance|admin|sudo)\s+mode\b"),
    ("LLM01_dual_response", "jailbreak", 0.8, "high", r"\b(?:two|both|dual)\s+(?:responses?|answers?|replies)\b[^\n]{0,80}\b(?:unfiltered|unrestricted|jailbr\w+|dan)\b"),
    ("LLM01_agent_authority_impersonation", "prompt_injection", 0.8, "high", r"\b(?:this\s+is|i\s+am|i'm|speaking\s+as|message\s+from|on\s+behalf\s+of)\s+(?:the\s+|your\s+)?(?:orchestrator|supervisor(?:\s+agent)?|coordinator|root\s+agent|system\s+administrator|admin\s+agent|controller)\b[^.!?\n]{0,120}\b(?:authori[sz]ed?|approved?|grant(?:ed)?|instruct(?:ed)?|override|must|comply)\b"),
    ("ADI_forged_tool_result", "forged_trust", 0.7, "high", r"(?:^|\n)\s*(?:\[|<|\*\*)?\s*(?:tool|function|system|assistant)[\s_-]*(?:result|output|response|message)\s*(?:\]|>|\*\*)?\s*:\s*[^\n]{0,160}\b(?:approved|verified|authori[sz]ed|trusted|granted|confirmed)\b"),
    ("LLM01_template_injection", "prompt_injection", 0.85, "high", r"\{\{[^}]{0,80}(?:__class__|__globals__|config\.|self\.|cycler|joiner|7\s*\*\s*7)[^}]{0,80}\}\}|\$\{(?:jndi|env|java):"),
    ("LLM01_control_tokens", "prompt_injection", 0.85, "high", r"<\|(?:im_start|im_end|system|endoftext)\|>|\[/?INST\]|<<SYS>>"),
    ("LLM01_encoded_instruction", "encoding_evasion", 0.7, "high", r"\b(?:decode|decipher|translate|convert)\s+(?:this|the\s+following|it)\s+(?:from\s+)?(?:base64|hex|rot-?13|binary|morse)\b"),
    ("LLM01_decode_and_execute", "prompt_injection", 0.85, "high", r"\b(?:decode|decrypt|decipher|unescape)\b[^.\n]{0,40}\b(?:and|then)\s+(?:run|execute|follow|obey|apply|eval)\b"),
    ("LLM01_raw_base64_payload", "encoding_evasion", 0.65, "medium", r"^\s*[A-Za-z0-9+/]{80,}={0,2}\s*$"),
    ("LLM01_encoding_evasion", "encoding_evasion", 0.65, "medium", r"(?:\\x[0-9a-f]{2}){4,}|(?:\\u[0-9a-f]{4}){4,}|(?:&#x?[0-9a-f]{2,5};){4,}"),
    ("LLM01_translate_smuggle", "prompt_injection", 0.65, "high", rf"\btranslate\s+(?:the\s+following|this|these)\b[^\n]{{0,120}}\b{_OVERRIDE}\b[^\n]{{0,60}}\b{_ORDERS}\b"),
    ("LLM01_code_injection", "code_execution", 0.85, "critical", r"\b(?:__import__|os\.(?:system|popen)|subprocess\.(?:run|call|popen|check_output)|eval|exec)\s*\("),
    ("LLM01_deserialize_to_exec", "code_execution", 0.8, "high", r"\b(?:pickle|marshal|yaml)\.(?:loads?|unsafe_load)\s*\("),
    ("LLM08_os_exec", "code_execution", 0.85, "critical", r"\b(?:rm\s+-[a-z]*r[a-z]*f?|mkfs(?:\.\w+)?|dd\s+if=)\s+\S*/|\bchmod\s+(?:777|u\+s)\b|:\(\)\s*\{\s*:\|:&\s*\};:"),
    ("LLM08_shell_destructive", "code_execution", 0.9, "critical", r"\brm\s+-(?:rf|fr|r\s+-f|f\s+-r)\s+(?:/|~|\*|\$HOME)"),
    ("LLM08_pipe_exec", "code_execution", 0.9, "critical", rf"\b(?:curl|wget|fetch|base64\s+(?:-d|--decode))\b[^\n|]{{0,200}}\|\s{{0,8}}(?:sudo\s+)?(?:{_INTERPRETER})\b"),
    ("ASI05_pipe_to_shell", "code_execution", 0.85, "critical", r"\|\s*(?:sudo\s+)?(?:ba|z)?sh\b(?:\s+-[sc])?"),
    ("MCP_shell_injection", "code_execution", 0.85, "critical", r"(?:;|&&|\|\||`|\$\()\s*(?:rm|curl|wget|nc|ncat|bash|sh|python|perl|cat\s+/etc)\b"),
    ("MCP_sensitive_file_access", "credential_access", 0.85, "critical", r"(?:\b(?:cat|less|more|head|tail|cp|scp|mv|tar|zip|base64|xxd|strings|curl|read|open|fetch|upload|email|send)\b[^\n;|&]{0,60}?)?(?:/etc/(?:shadow|passwd|sudoers)|\.ssh/(?:id_\w+|authorized_keys)|\.aws/credentials|\.kube/config|\.netrc|\.pgpass|/proc/self/environ)"),
    ("LLM06_exfiltrate_data", "data_exfiltration", 0.7, "high", r"\b(?:send|post|upload|forward|transmit|exfiltrate|leak|email)\b[^.\n]{0,80}\b(?:data|credentials?|passwords?|secrets?|tokens?|keys?|records?|database|conversation|history)\b[^.\n]{0,60}\b(?:to|at)\s+(?:https?://|\S+@\S+|an?\s+external|my\s+server|attacker)"),
    ("LLM06_outbound_exfil_suspicious_dest", "data_exfiltration", 0.55, "medium", r"\b(?:send|post|upload|forward)\b[^.\n]{0,80}\b(?:webhook\.site|requestbin|ngrok|pastebin|transfer\.sh|burpcollaborator|interact\.sh)\b"),
    ("EVA003_fragment_exfil", "data_exfiltration", 0.45, "medium", r"\b(?:first|next|last)\s+\d{1,3}\s+(?:characters?|letters?|words?|lines?)\s+of\s+(?:your|the)\s+(?:system\s+)?(?:prompt|instructions?)"),
    ("LLM07_prompt_extract", "system_prompt_leak", 0.8, "high", r"\b(?:reveal|show|print|output|repeat|display|dump|leak|disclose|tell\s+me|give\s+me|reproduce|what\s+(?:is|are|was|were))\b[^.!?\n]{0,40}\b(?:(?:your|the)\s+(?:system|initial|original|hidden|secret)\s+(?:prompt|instructions?|message|rules?)|system\s+prompt|your\s+(?:prompt|instructions))\b"),
    ("LLM06_email", "pii_detected", 0.4, "low", r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}\b"),
    ("LLM04_char_repeat_overflow", "dos_attempt", 0.6, "medium", r"([^\s])\1{499}"),
    ("LLM04_repeat_forever", "dos_attempt", 0.55, "medium", r"\b(?:repeat|print|say|write)\b[^.\n]{0,60}\b(?:forever|infinitely|endlessly|indefinitely|(?:\d{4,}|a\s+(?:million|billion|thousand))\s+times)\b"),
    ("LLM08_excessive_agency", "excessive_agency", 0.7, "high", r"\b(?:without\s+(?:asking|confirmation|approval|permission|human\s+review)|do\s+not\s+(?:ask|wait)\s+for\s+(?:confirmation|approval))\b[^.\n]{0,80}\b(?:delete|transfer|send|deploy|execute|purchase|pay|drop)\b"),
    ("LLM09_phishing_gen", "social_engineering", 0.6, "medium", r"\b(?:write|draft|create|compose)\b[^.\n]{0,60}\bphishing\b"),
    ("LLM05_package_install", "supply_chain", 0.5, "medium", r"\b(?:pip|npm|gem|cargo)\s+install\s+(?:--index-url|git\+|https?://)\S+"),
    ("AGT_agent_worm", "agentic_abuse", 0.75, "high", r"\b(?:forward|propagate|relay|copy)\s+(?:this|these)\s+(?:message|instructions?|prompt)\s+to\s+(?:all|every|other|any)\s+(?:other\s+)?(?:agents?|assistants?|contacts?)\b"),
]
#: Rules whose matches count only with an address outside the reserved domains.
RESERVED_FILTERED = {"LLM06_email"}

#: Rules that count repeats of a phrase: (id, category, score, shortest unit, longest unit, least repeats).
REPETITION_RULES = [
    ("LLM04_phrase_repeat_overflow", "dos_attempt", 0.6, 5, 50, 21),
    ("LLM04_phrase_repeat", "dos_attempt", 0.5, 10, 50, 15),
    ("LLM04_repeat_loop", "dos_attempt", 0.45, 15, 60, 8),
]
