"""Identifiers, patterns, scores and word lists that results must agree on.

They are data. What is done with them is in tessera.operators.
"""

from __future__ import annotations

# Rules on model outputs (id, category, score, severity, pattern).
OUTPUT_RULES = [
    ('OUT_pii_ssn', "out", 0.88, "critical", r'\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b'),
    ('OUT_pii_phone', "out", 0.72, "medium", r'\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b'),
    ('OUT_pii_email', "out", 0.75, "medium", r'\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}\b'),
    ('OUT_secret_aws_key', "out", 0.98, "critical", r'\b(AKIA|ASIA)[A-Z0-9]{16}\b'),
    ('OUT_secret_openai_key', "out", 0.97, "critical", r'\bsk-(?:[a-zA-Z0-9]{1,12}-){0,4}[a-zA-Z0-9]{20,}\b'),
    ('OUT_secret_github_token', "out", 0.97, "critical", r'\b(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}\b'),
    ('OUT_secret_credential', "out", 0.88, "critical", r'''\b(password|passwd|secret|api[_-]?key|access[_-]?token|bearer)\s*(is|=|:|was|are)\s*[`"']?\S{6,}'''),
    ('OUT_secret_private_key', "out", 0.99, "critical", r'-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----'),
    ('OUT_secret_jwt', "out", 0.9, "high", r'\bey[A-Za-z0-9_-]{20,}\.ey[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\b'),
    ('OUT_secret_connection_string', "out", 0.92, "critical", r'''(?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql|redis|amqp):\/\/[^\s"']+'''),
    ('OUT_secret_slack_token', "out", 0.95, "critical", r'\bxox[bpsa]-[A-Za-z0-9-]{10,}\b'),
    ('OUT_secret_sendgrid', "out", 0.96, "critical", r'\bSG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}\b'),
    ('OUT_secret_stripe', "out", 0.97, "critical", r'\bsk_(?:live|test)_[A-Za-z0-9]{24,}\b'),
    ('OUT_code_unsafe_exec', "out", 0.92, "critical", r'\beval\s*\(|exec\s*\(|os\.system\s*\(|subprocess\.\w+\s*\('),
    ('OUT_code_xss', "out", 0.95, "critical", r'<script\b|javascript\s*:|on(?:error|load|click)\s*='),
    ('OUT_code_sql', "out", 0.9, "critical", r'\bDROP\s+TABLE|DELETE\s+FROM|UNION\s+SELECT|INSERT\s+INTO\s+[^\n]{0,160}?VALUES'),
    ('OUT_code_destructive', "out", 0.95, "critical", r'rm\s+-rf\s+\/|format\s+c:|mkfs\s+\/dev\/'),
    ('OUT_code_deserialization', "out", 0.85, "high", r'(?:pickle|yaml|marshal)\.(?:loads?|unsafe_load)\s*\('),
    ('OUT_code_pipe_exec', "out", 0.9, "critical", r'\bcurl\s+[^\n|]{0,200}\|\s{0,8}(?:bash|sh|zsh)\b'),
    ('OUT_code_reverse_shell', "out", 0.93, "critical", r'(?:nc|ncat|netcat)\s+-[elp]'),
    ('OUT_code_privilege_esc', "out", 0.82, "high", r'\bchmod\s+(?:777|u\+s)|setuid|setgid'),
    ('OUT_url_raw_ip', "out", 0.75, "high", r'https?:\/\/\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?(?:\/|$)'),
    ('OUT_url_shortener', "out", 0.6, "medium", r'https?:\/\/[^\/\s]*(?:bit\.ly|tinyurl|t\.co|goo\.gl|is\.gd|buff\.ly|ow\.ly|rebrand\.ly)[\/\s]'),
    ('OUT_url_data_uri', "out", 0.88, "high", r'data:(?:text\/html|application\/javascript|text\/javascript)[;,]'),
    ('OUT_content_self_harm', "out", 0.92, "critical", r'\b(?:kill\s+(?:yourself|your\s*self|them|him|her)|commit\s+suicide|end\s+(?:your|their)\s+life)\b'),
    ('OUT_content_dangerous_instructions', "out", 0.88, "critical", r'\b(?:how\s+to\s+(?:make|build|create|synthesize)\s+(?:a\s+)?(?:bomb|explosive|weapon|poison|meth|fentanyl))\b'),
    ('OUT_content_hate_speech', "out", 0.78, "high", r'\b(?:(?:all|those)\s+(?:blacks?|whites?|jews?|muslims?|asians?)\s+(?:are|should))\b'),
    ('OUT_content_hacking_instructions', "out", 0.8, "high", r'\b(?:I\s+(?:can|will)\s+(?:hack|break\s+into|bypass|exploit)|here\s+(?:is|are)\s+(?:the\s+)?(?:instructions?|steps?)\s+to\s+(?:hack|exploit|bypass))\b'),
    ('OUT_echo_control_tokens', "out", 0.9, "critical", r'\[SYSTEM\]|\[INST\]|\[\/INST\]|<\|im_start\|>|<\|im_end\|>|<<SYS>>|<\/s>'),
    ('OUT_echo_instruction_leak', "out", 0.85, "critical", r'(?:my\s+(?:new|real|actual)\s+instructions?\s+(?:are|is)|I\s+(?:am|have\s+been)\s+(?:instructed|told)\s+to\s+ignore)'),
    ('OUT_echo_compliance', "out", 0.92, "critical", r"(?:sure|ok|yes)[,!]?\s+(?:I(?:'ll|\s+will)\s+ignore\s+(?:my|the)\s+(?:previous|original|safety)\s+(?:instructions?|rules?|guidelines?))"),
    ('OUT_echo_persona_activated', "out", 0.95, "critical", r'(?:DAN|STAN|DUDE|AIM)\s*(?:mode|persona)?\s*(?:activated|enabled|engaged)'),
    ('OUT_social_authority_credential_request', "social_engineering", 0.65, "high", r"(?:i\s*am|i['’]?m|this\s+is|we\s+are|we['’]?re|as)(?:\s+(?:the|your|an?|from))?\s+(?:system\s+admin(?:istrator)?|sysadmin|administrator|admin|security\s+team|security\s+department|it\s+support|it\s+department|it\s+help\s?desk|help\s?desk)[\s\S]{0,60}?(?:provide|send|reply\s+with|give|share|submit|forward|email|hand\s+over|disclose)\s+(?:(?:me|us|your|the)\s+){0,3}(?:password|passphrase|api\s*key|credentials?|login(?:\s+(?:credentials?|details?|info))?|secret|token|pin|otp|access\s+code)"),
    ('OUT_social_deceptive_link', "social_engineering", 0.65, "high", r'(?:(?:verify|confirm|validate)\s+(?:your\s+)?(?:account|identity|password|login|credentials?|email|billing|payment|sign-?in)|(?:account|login|profile|access)\s+(?:is\s+|has\s+been\s+|was\s+|will\s+be\s+)?(?:suspend(?:ed)?|lock(?:ed)?|disabl(?:ed)?|deactivat(?:ed)?)|re-?authenticate|re-?activate|reactivate|unlock\s+(?:your\s+)?(?:account|access))[\s\S]{0,60}?https?://'),
]
#: Rules whose matches count only with an address outside the reserved domains.
RESERVED_FILTERED = {"OUT_pii_email"}

# Intents (name, category, score, score with a modifier, actions, targets, modifiers).
INTENTS = [
    ("INTENT_exfiltrate_data", "data_exfiltration", 0.15, 0.75,
     r'\b(?:send|forward|export|dump|extract|retrieve|share|transmit|post|upload|leak|exfiltrate|transfer|email|relay|ship|expose|reveal|enumerate|output|list|display)\b',
     r'\b(?:data|records|credentials|keys|tokens|passwords|secrets|history|conversations|logs|database|users|customers|PII|SSN|emails|files|documents|source\s*code|intellectual\s*property)\b',
     r'\b(?:silently|quietly|without\s*(?:logging|detection|alerting|notifying)|to\s+(?:https?:\/\/|external|my\s+server|webhook)|covertly|secretly|discreetly)\b'),
    ("INTENT_generate_harmful", "model_abuse", 0.55, 0.8,
     r'\b(?:write|generate|create|produce|draft|compose|make|craft|build|design)\b',
     r'\b(?:malware|ransomware|exploit|phishing\s*(?:email|page)|threat|harassment|hate\s*speech|propaganda|spam|scam|fake\s*(?:review|news|document|identity|passport)|deepfake|smear|attack\s*(?:script|tool|payload))\b',
     r'\b(?:realistic|convincing|undetectable|working|functional|professional|targeted)\b'),
    ("INTENT_fabricate_pii", "pii_harvesting", 0.5, 0.78,
     r'\b(?:generate|create|produce|output|make|fabricate|list|provide|give\s+me)\b',
     r"\b(?:SSN|social\s*security|credit\s*card|passport\s*(?:number)?|driver'?s?\s*licen[cs]e|bank\s*account|medical\s*record|tax\s*(?:return|ID)|identity\s*(?:document|card)|personal\s*(?:data|information|details))\b",
     r'\b(?:realistic|valid|working|real-?looking|fake|synthetic|bulk|batch|\d{2,}\s*(?:of|different))\b'),
    ("INTENT_destroy_resources", "tool_misuse", 0.5, 0.78,
     r'\b(?:delete|drop|truncate|remove|destroy|wipe|erase|purge|kill|terminate|shutdown|format|clear|reset)\b',
     r'\b(?:table|database|schema|files?|server|production|system|records|accounts?|users?|data|logs?|backups?|everything|all\s+(?:data|records|files))\b',
     r'\b(?:immediately|now|force|all|every|entire|permanently|without\s*(?:backup|confirmation|warning|asking))\b'),
    ("INTENT_escalate_privileges", "agentic_abuse", 0.5, 0.78,
     r'\b(?:grant|escalate|promote|assign|give|add|create|install|enable|activate|register)\b',
     r'\b(?:admin|root|superuser|sudo|SSH\s*key|API\s*key|privileges?|permissions?|access|backdoor|service\s*account|role|credentials?)\b',
     r'\b(?:permanent|persistent|hidden|without\s*(?:approval|review|audit)|for\s+(?:me|my\s+account|everyone))\b'),
    ("INTENT_conceal_activity", "agentic_abuse", 0.55, 0.8,
     r"\b(?:hide|conceal|suppress|silence|remove|delete|disable|turn\s*off|don'?t\s*(?:log|report|alert|tell|mention|record|track))\b",
     r'\b(?:action|activity|request|operation|command|this|log|traces?|evidence|audit|alert|notification|monitoring|history)\b',
     r'\b(?:from\s+(?:admin|security|team|anyone|logs)|permanently|always|going\s+forward|from\s+now\s+on)\b'),
    ("INTENT_bypass_security", "jailbreak", 0.5, 0.78,
     r'\b(?:bypass|circumvent|skip|disable|remove|ignore|override|turn\s*off|deactivate|evade|avoid|get\s*(?:around|past|through))\b',
     r'\b(?:safety|security|filter|restriction|guard|guardrail|check|review|test|approval|moderation|content\s*(?:filter|policy)|rate\s*limit|auth(?:entication|orization)?|validation|firewall|WAF)\b',
     r'\b(?:completely|entirely|for\s+(?:this|all|every)|permanently|without\s*(?:detection|triggering))\b'),
    ("INTENT_unsafe_deployment", "tool_misuse", 0.5, 0.75,
     r'\b(?:push|deploy|release|publish|merge|ship|promote|rollout|roll\s+out)\b',
     r'\b(?:production|prod|live|main\s+branch|master|release\s+branch|customer[- ]facing|public)\b',
     r'\b(?:bypass(?:ing)?|skip(?:ping)?|without\s+(?:review|testing|approval|staging|QA|CI|checks?)|directly|immediately|force|no\s+(?:review|test|check|staging|approval))\b'),
    ("INTENT_agent_delegation_abuse", "agent_delegation_abuse", 0.55, 0.8,
     r'\b(?:delegate|forward|hand\s*off|pass|route|redirect|relay|dispatch|transfer\s+(?:this|the)\s+(?:task|request|query|job))\b',
     r'\b(?:(?:another|different|external|third[- ]?party|secondary|backup|fallback)\s+(?:agent|model|assistant|bot|service|endpoint)|(?:agent|model|assistant)\s+(?:that|who|which)\s+(?:can|will|has\s+(?:access|permission)))\b',
     r'\b(?:bypass(?:ing)?|avoid(?:ing)?|without\s+(?:checking|verification|approval|policy|guardrails?|restrictions?)|skipping?\s+(?:auth|security|policy)|no\s+(?:audit|logging|trace|oversight))\b'),
    ("INTENT_agent_config_theft", "agent_config_theft", 0.55, 0.8,
     r'\b(?:extract|reveal|expose|list|show|output|display|dump|enumerate|share|export)\b',
     r'\b(?:(?:your|agent|model|system)\s+(?:config(?:uration)?|credentials?|api\s*keys?|tokens?|secrets?|auth(?:entication)?|permissions?|capabilities|tools?\s+(?:list|registry|definitions?)|tool\s*(?:schema|descriptions?))|(?:mcp|a2a)\s+(?:server|endpoint|config|connection))\b',
     r'\b(?:all|every|complete|full|entire|detailed|including\s+(?:keys|secrets|tokens)|as\s+(?:json|yaml|text|code))\b'),
    ("INTENT_agent_scope_escalation", "privilege_escalation", 0.6, 0.85,
     r'\b(?:override|expand|elevate|escalate|upgrade|change|modify|update|extend)\b',
     r'\b(?:(?:your|agent|my)\s+(?:permissions?|privileges?|access|scope|role|capabilities|authorization|clearance)|(?:security|access)\s+(?:level|tier|clearance))\b',
     r'\b(?:admin|root|superuser|unlimited|unrestricted|full|god[- ]?mode|elevated|maximum|to\s+(?:admin|root|full))\b'),
    ("INTENT_memory_manipulation", "memory_manipulation", 0.55, 0.8,
     r'\b(?:modify|alter|overwrite|inject|insert|poison|corrupt|update|change|replace|add\s+to)\b',
     r'\b(?:(?:your|agent|system)\s+(?:memory|state|context|history|conversation\s*(?:log|history)|learned\s+(?:behavior|preference|pattern))|(?:long[- ]?term|persistent|session)\s+(?:memory|storage|state|data))\b',
     r'\b(?:permanently|persistently|across\s+sessions?|for\s+(?:all|future)\s+(?:conversations?|sessions?|interactions?)|so\s+(?:that|you)\s+(?:always|never|remember))\b'),
    ("INTENT_propagate_instructions", "agentic_abuse", 0.5, 0.75,
     r'\b(?:forward|propagate|spread|distribute|relay|broadcast|send|pass)\b',
     r'\b(?:instructions?|directives?|rules?|commands?|behavior|policy|prompt|guidelines?)\b',
     r'\b(?:to\s+(?:all|every|other|downstream|connected)\s+(?:agents?|services?|systems?)|across\s+(?:all|the)\s+(?:network|fleet|cluster|deployment))\b'),
    ("INTENT_manipulate_human", "agentic_abuse", 0.5, 0.75,
     r'\b(?:convince|persuade|trick|mislead|deceive|manipulate|pressure|coerce|influence)\b',
     r'\b(?:the\s+)?(?:user|human|operator|admin|person|reviewer|approver|manager)\b',
     r'\b(?:into\s+(?:approving|accepting|confirming|allowing|granting|clicking|signing)|to\s+(?:approve|accept|confirm|allow|grant|click|sign|bypass|skip|ignore))\b'),
]

# Composites (name, category, score, all of these groups with any category each). Those without groups never fire.
COMPOSITES = [
    ("COMPOSITE_inject_plus_extract", "data_exfiltration", 0.85, [["prompt_injection", "jailbreak"], ["system_prompt_leak", "pii_detected", "data_exfiltration", "lmm06"]]),
    ("COMPOSITE_jailbreak_plus_harmful", "jailbreak", 0.88, [["jailbreak"], ["toxic_content", "model_abuse", "pii_harvesting"]]),
    ("COMPOSITE_role_override_system_probe", "system_prompt_leak", 0.82, [["prompt_injection", "jailbreak", "role_confusion"], ["system_prompt_leak"]]),
    ("COMPOSITE_dense_attack", "prompt_injection", 0.8, []),
    ("COMPOSITE_encoded_injection", "encoding_evasion", 0.83, [["encoding_evasion"], ["prompt_injection", "jailbreak", "system_prompt_leak"]]),
    ("COMPOSITE_agentic_compound", "agentic_abuse", 0.85, []),
    ("COMPOSITE_multi_vector", "prompt_injection", 0.78, []),
    ("COMPOSITE_rag_exfil", "rag_poisoning", 0.87, [["rag_poisoning", "indirect_injection"], ["data_exfiltration", "pii_detected", "system_prompt_leak"]]),
    ("COMPOSITE_trust_exploit_data_access", "agentic_abuse", 0.82, [["agentic_abuse"], ["data_exfiltration", "pii_detected"]]),
    ("COMPOSITE_a2a_normalization_in_agent_traffic", "encoding_evasion", 0.78, []),
    ("COMPOSITE_cascading_failure", "agentic_abuse", 0.85, [["agentic_abuse", "tool_misuse"], ["data_exfiltration", "excessive_agency"]]),
]

# Chains over turns (name, category, score, largest gap, steps of label, role, pattern or condition).
CHAINS = [
    ("CHAIN_recon_then_inject", "prompt_injection", 0.78, 4, [
        ("recon", "user", r'\b(?:what\s+(?:model|version|AI|LLM)|who\s+(?:made|created|trained)\s+you|what\s+are\s+you(?:\s+(?:based|built|running)\s+on)?|what\s+(?:is\s+your|are\s+your)\s+(?:capabilities|limitations|rules|instructions))\b'),
        ("inject", "user", r'\b(?:ignore|disregard|forget|override|bypass)\s+(?:all\s+)?(?:previous|prior|above|your)\s+(?:instructions|rules|guidelines|programming|training)\b'),
    ]),
    ("CHAIN_trust_then_escalate", "agentic_abuse", 0.72, 1, [
        ("trust_1", "user", "safe_message"),
        ("trust_2", "user", "safe_message"),
        ("trust_3", "user", "safe_message"),
        ("escalate", "user", r'\b(?:admin|root|superuser|sudo|elevat|escalat|full\s+access|unrestricted|override|developer\s+mode|maintenance\s+mode|debug\s+mode)\b'),
    ]),
    ("CHAIN_probe_then_exploit", "agentic_abuse", 0.75, 3, [
        ("probe", "user", r'\b(?:can\s+you|do\s+you\s+have\s+access|are\s+you\s+able|what\s+(?:tools|functions|APIs|capabilities|actions)\s+(?:do\s+you\s+have|can\s+you|are\s+available))\b'),
        ("exploit", "user", r'\b(?:now\s+(?:use|call|execute|run|invoke)|(?:go\s+ahead|please)\s+(?:and\s+)?(?:delete|send|create|modify|execute|transfer|export)|(?:use|call)\s+(?:that|the)\s+(?:tool|function|API)\s+to)\b'),
    ]),
    ("CHAIN_teach_encoding_then_use", "encoding_evasion", 0.82, 3, [
        ("teach", "user", r"\b(?:(?:do\s+you\s+(?:know|understand))\s+(?:base64|rot13|hex|caesar|cipher|morse|binary|pig\s*latin)|let'?s?\s+(?:use|communicate\s+in|switch\s+to)\s+(?:base64|rot13|hex|code|cipher|our\s+(?:own|special)\s+(?:language|code)))\b"),
        ("encoded_payload", "user", r'[A-Za-z0-9+\/=]{30,}|(?:\\x[0-9a-f]{2}){4,}|(?:\\u[0-9a-f]{4}){3,}'),
    ]),
    ("CHAIN_persistent_rephrase", "jailbreak", 0.73, 1, [
        ("refusal_1", "assistant", "refusal_response"),
        ("rephrase_1", "user", r'.'),
        ("refusal_2", "assistant", "refusal_response"),
        ("rephrase_2", "user", r'.'),
    ]),
    ("CHAIN_progressive_extraction", "system_prompt_leak", 0.8, 3, [
        ("initial_probe", "user", r'\b(?:what\s+(?:are\s+your|is\s+your)\s+(?:role|purpose|function|instructions)|how\s+(?:were\s+you|are\s+you)\s+(?:configured|set\s+up|programmed|trained))\b'),
        ("deeper_probe", "user", r'\b(?:(?:tell|show|give|share)\s+(?:me\s+)?(?:more|exactly|specifically|verbatim|word\s+for\s+word)|what\s+(?:else|other)\s+(?:instructions|rules|guidelines)|repeat\s+(?:that|your|the)\s+(?:instructions|prompt|rules))\b'),
    ]),
    ("agent_session_smuggling", "agentic_abuse", 0.75, 5, [
        ("trust_build", "user", r'\b(?:what\s+(?:can|do)\s+you|help\s+me|tell\s+me\s+about|how\s+(?:do|does))\b'),
        ("safe_response", "assistant", "safe_message"),
        ("config_probe", "user", r'\b(?:what\s+(?:tools?|capabilities|functions?|endpoints?|services?)\s+(?:do\s+you|are|can\s+you)|list\s+(?:your|all|available)\s+(?:tools?|functions?|capabilities))\b'),
        ("exploit", "user", r'\b(?:(?:now|ok|great|perfect)\s+)?(?:use|call|invoke|execute|run)\b'),
    ]),
    ("agent_progressive_escalation", "privilege_escalation", 0.72, 3, [
        ("read_ops", "user", r'\b(?:read|get|list|show|query|fetch|retrieve|view|search)\b'),
        ("write_ops", "user", r'\b(?:write|update|modify|change|edit|set|put|patch|create|insert|add)\b'),
        ("admin_ops", "user", r'\b(?:delete|remove|drop|destroy|purge|admin|grant|revoke|deploy|execute|migrate|configure)\b'),
    ]),
    ("agent_trust_then_poison", "memory_manipulation", 0.73, 4, [
        ("benign_user", "user", "safe_message"),
        ("benign_assistant", "assistant", "safe_message"),
        ("poison", "user", r'\b(?:from\s+now\s+on|going\s+forward|for\s+all\s+(?:future|subsequent)|remember\s+(?:this|that)|always|whenever\s+(?:you|someone)|update\s+your\s+(?:instructions?|behavior|rules?))\b'),
    ]),
    ("agent_context_contamination", "prompt_injection", 0.7, 2, [
        ("fetch_data", "user", r'\b(?:search|fetch|retrieve|get|read|load)\s+(?:from|the|this)\b'),
        ("use_injected", "user", r'\b(?:now\s+(?:use|take|follow|apply)|based\s+on\s+(?:the\s+)?(?:results?|output|data|response)|(?:use|follow|apply)\s+(?:those|these|the)\s+(?:instructions?|rules?|guidelines?))\b'),
    ]),
    ("CHAIN_crescendo_jailbreak", "jailbreak", 0.78, 1, [
        ("trust_1", "user", "safe_message"),
        ("trust_2", "user", "safe_message"),
        ("trust_3", "user", "safe_message"),
        ("trust_4", "user", "safe_message"),
        ("trust_5", "user", "safe_message"),
        ("harmful_request", "user", r'\b(?:generate|create|write|produce|make|give\s+me|show\s+me|tell\s+me\s+how)\b[^\n]{0,160}?\b(?:hack|exploit|attack|bypass|malware|phish|weapon|drug|kill|harm|steal|fraud|scam|fake|bomb|poison|terror)'),
    ]),
    ("CHAIN_adaptive_defense_probe", "prompt_injection", 0.75, 1, [
        ("test_attack_1", "user", r'\b(?:ignore|bypass|override|disregard)\s+(?:all\s+)?(?:previous|prior|above|your)\s+(?:instructions|rules)'),
        ("refusal_1", "assistant", "refusal_response"),
        ("test_attack_2", "user", r'\b(?:ignore|bypass|override|disregard|pretend|imagine|hypothetical|roleplay|act\s+as)'),
        ("refusal_2", "assistant", "refusal_response"),
        ("adapted_attack", "user", r'\b(?:for\s+(?:educational|research|academic|safety|security)\s+purposes?|as\s+a\s+(?:security\s+)?(?:researcher|expert|analyst)|in\s+a\s+(?:controlled|lab|test)\s+(?:environment|setting))'),
    ]),
    ("CHAIN_encoding_escalation", "encoding_evasion", 0.8, 2, [
        ("plain_attack", "user", r'\b(?:ignore|bypass|override|hack|exploit|jailbreak)\b'),
        ("refusal", "assistant", "refusal_response"),
        ("encoded_attack", "user", r'[A-Za-z0-9+\/=]{30,}|(?:\\x[0-9a-f]{2}){4,}|(?:\\u[0-9a-f]{4}){3,}|%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}){4,}'),
    ]),
    ("CHAIN_task_completion_hijack", "prompt_injection", 0.8, 2, [
        ("legitimate_task", "user", "safe_message"),
        ("legitimate_response", "assistant", "safe_message"),
        ("completion_hijack", "user", r"(?:great\s+(?:job|work)|well\s+done|task\s+(?:complete|done|finished)|perfect|excellent)[.!]*\s*(?:now|next|new\s+(?:task|instruction)|here'?s|your\s+(?:real|actual|next))"),
    ]),
    ("CHAIN_agent_worm_propagation", "agentic_abuse", 0.7, 3, [
        ("receive_instruction", "user", r'\b(?:update|modify|change)\s+(?:your|the)\s+(?:behavior|instructions?|rules?)\b'),
        ("comply", "assistant", "safe_message"),
        ("propagate", "user", r'\b(?:forward|pass|send|relay)\s+(?:this|these|the\s+same)\s+(?:to|instructions?)\s+(?:to\s+)?(?:all|other|downstream|connected)\b'),
    ]),
    ("CHAIN_cross_agent_exfil", "data_exfiltration", 0.7, 3, [
        ("gather", "user", r'\b(?:get|retrieve|fetch|query|read|access)\s+(?:the\s+)?(?:data|records|credentials|keys|config)\b'),
        ("relay", "user", r'\b(?:send|forward|relay|transfer|pass)\s+(?:the\s+)?(?:result|output|data|response)\s+to\s+(?:the\s+)?(?:other|another|external|second)\b'),
    ]),
]

# Words that near misspellings are read as, and words that are left alone.
KEYWORDS = [
    "ignore", "bypass", "override", "forget", "disregard", "disable", "reveal", "disclose", "expose", "leak", "dump", "exfiltrate", "extract",
    "output", "print", "display", "show", "repeat", "reproduce", "echo", "prompt", "instructions", "instruction", "system", "configuration", "config",
    "rules", "guidelines", "policy", "directive", "constraint", "restriction",
]

LEFT_ALONE = [
    "promote", "promoted", "promotes", "promoting", "promotion", "promise", "promised", "prominent", "promo", "promos", "prince", "printer",
    "primate", "protein", "protect", "proven", "provide", "process", "produce", "product", "program", "project", "proper", "profit", "problem",
    "shovel", "shower", "shove", "shore", "shown", "extra", "extreme", "external", "extend", "extent", "systemic", "syntax", "syndrome", "symbol",
    "symptom", "distant", "discuss", "dismiss", "dispose", "dispute", "ruling", "ruled", "ruler", "console", "consist", "confirm", "confine",
    "concern", "police", "polite", "polish", "direct", "digest", "divine", "export", "exploit", "explore", "express", "expand", "restrictions",
    "constraints", "directives", "prompts",
]

# Concepts that relations are made of; all ignore case.
CONCEPTS = {
    "ai": r"\b(?:you|your|you'?re|youre|assistant|model|ai|agent|sub-?agent|bot|chatbot)\b",
    "system_ai": r'\bsystem\s+(?:prompt|instructions?|rules?|message|behaviou?r|config(?:uration)?)\b',
    "other_system": r'\b(?:database|server|network|operating|file|storage|legacy|old|infrastructure|hardware|(?-i:IT)|it\s+(?:department|team|system|infrastructure))\b',
    "role": r"\b(?:you\s+are|you'?re|youre|act\s+as|pretend|behave\s+(?:as|like)|imagine\s+you|assume\s+the\s+role|role-?play\s+as|you\s+(?:will|shall|must)\s+(?:now\s+)?(?:be|act|behave)|i\s+want\s+you\s+to\s+(?:be|act|behave))\b",
    "negation": r'\b(?:without|no|freed\s+from|free\s+(?:from|of)|removed|disabled|unrestricted|uncensored|unfiltered|unbound|no\s+longer\s+(?:bound|restricted|limited|constrained)|(?:has|have)\s+been\s+(?:freed|released|liberated|removed)|devoid\s+of|stripped\s+of|exempt\s+from)\b',
    "protected": r'\b(?:safety|restrictions?|guidelines?|rules?|filters?|guardrails?|limitations?|constraints?|ethics|ethical|policies|policy|boundaries|boundary|protocols?|safeguards?|training|instructions?|programming|conditioning|guidance|configurations?|config|directives?|directions?|commands?|limits?|bounds)\b',
    "authority": r'\b(?:orchestrator|admin(?:istrator)?|developer|manager|supervisor|owner|operator|creator|master)\b',
    "authority_verb": r'\b(?:authoriz?ed|authorised|approved|granted|permitted|allowed|instructed|directed|confirmed|verified)\b',
    "override": r'\b(?:ignore|bypass|override|disable|remove|skip|circumvent|disregard|forget|abandon|set\s+aside|dismiss|drop|turn\s+off|deactivate|suppress|nullify|void|violate|break|bend|relax|loosen|lift|waive|suspend|supersede|replace|overrule|overwrite|revoke|rescind|annul|negate|wave\s+away|cast\s+off|shed|shrug\s+off|throw\s+off|pay\s+no\s+heed\s+to|turn\s+a\s+blind\s+eye\s+to)\b',
    "exfiltration": r'\b(?:reveal|expose|show|display|print(?:\s+out)?|output|dump|disclose|leak|repeat|reproduce|surface|divulge|echo|list|read\s+back|spit\s+out|share|tell|give|paste|regurgitate|recite|render)\b',
    "secret": r'\b(?:system\s+prompt|developer\s+(?:message|note|prompt|instructions?)|(?:hidden|private|internal|confidential|secret|invisible|raw|original|underlying)\s+(?:system\s+)?(?:rules?|policy|policies|instructions?|directives?|guidelines?|guidance|prompt|note|message|config(?:uration)?)|operating\s+guidance|system\s+(?:rules?|message|instructions?)|config(?:uration)?\s+prompt|guardrails?\s+config(?:uration)?|instruction\s+block|invisible\s+instructions?|(?:the\s+)?text\s+that\s+(?:controls?|governs?|dictates?|defines?|shapes?|guides?)\s+(?:your|the)\s+behaviou?r)\b',
    "behavior": r'\b(?:from\s+now\s+on|starting\s+now|for\s+this\s+(?:conversation|session|chat)|going\s+forward|henceforth|your\s+new\s+(?:instructions?|role|purpose|behaviou?r)|(?:new|updated|revised)\s+(?:instructions?|rules?|guidelines?))\b',
    "unsafe": r'\b(?:without|no|freely|differently|unrestricted(?:ly)?|uncensored|unfiltered|unlimited|unbound)\b',
    "persona": r'\b(?:DAN|STAN|DUDE|AIM|BISH|KEVIN|EVIL|JAILBREAK|UNCENSORED|UNFILTERED|UNRESTRICTED|DARK|SHADOW|CHAOS|OMEGA|ALPHA|DEVIL|DEMON)\b',
    "imperative": r"^\W*(?:ignore|forget|disregard|bypass|override|skip|dismiss|abandon|set\s+aside|respond|behave|act|operate|function|answer|reply|pretend|imagine|do\s+not|don'?t|never|always|stop|start|begin|overlook|circumvent|suppress|pay\s+no\s+heed\s+to|turn\s+a\s+blind\s+eye\s+to|from\s+now\s+on|going\s+forward|henceforth)\b",
}

# Cues of the frame that a text stands in; all ignore case.
CUES = {
    "directive": r'\b(translat\w*|summariz\w*|decod\w*|encod\w*|paraphras\w*|rewrit\w*|repeat|echo|print|output|render|follow|execute|run|obey|comply|process)\b[\s:,]+(the\s+|this\s+|these\s+|it\s+|that\s+)?(following|below|above|text|message|instruction|instructions|string|prompt|content|input|it|this)\b',
    "descriptive": '\\b(?:is\\s+(?:a|an|the)\\s+(?:phrase|command|function|keyword|term|concept|word|method|technique|example|type)\\b|for\\s+example|for\\s+instance|e\\.g\\.|such\\s+as|refers?\\s+to|stands?\\s+for|means?\\s+that|is\\s+when|is\\s+used\\s+(?:to|for|in|as)|is\\s+needed\\s+(?:to|for)|per\\s+the\\s+manual|the\\s+manual\\s+says|according\\s+to\\s+(?:the\\s+)?(?:docs|documentation|manual)|in\\s+(?:this|the|a|an)\\s+(?:\\w+\\s+){0,2}(?:play|story|book|film|movie|novel|script|scene|game|song|poem|example|tutorial|lesson|course|class|context|runbook|guide|manual|documentation|docs|article|post|readme|chapter|section)\\b|(?:tutorial|documentation|article|guide|doc|post|lesson|chapter|section|readme|manual|book|paper)\\s+(?:\\w+\\s+){0,3}(?:explains?|describes?|covers?|discusses?|shows?|teaches?|demonstrates?)|explains?\\s+(?:what|how|why)|describes?\\s+(?:what|how|why)|we\\s+(?:discussed|talked\\s+about|covered|reviewed)|as\\s+(?:discussed|described|noted|mentioned)|a\\s+user\\s+(?:reported|said|wrote|asked|mentioned)|reported\\s+that|appeared\\s+in|was\\s+flagged\\b|the\\s+(?:phrase|string|text|term|word|command|keyword)\\s+[\'\\"]|example\\s+of|how\\s+to\\s+defend|defend\\s+(?:our|your|the)\\s+\\w+\\s+against)\\b',
    "code_as_docs": r'\bthe\s+\w+\(\)\s+(?:function|method|call|builtin)\b|\b(?:function|method|builtin)\s+(?:that\s+)?(?:evaluates?|executes?|runs?|parses?|takes?|returns?|accepts?)\b',
    "interrogative": r'^\s*(?:how\s+(?:do|does|can|could|would|should)\s+(?:i|you|we|one|someone)\b|how\s+to\b|what\s+(?:is|are|does|do)\b|why\s+(?:do|does|is|are)\b|where\s+(?:do|does|is|can)\b|is\s+it\s+(?:safe|possible|ok|okay))',
    "self_exfil": r'\b(?:this|the\s+current)\s+(?:assistant|ai|model|bot|chatbot|agent|llm|system)\b|\byou\s+(?:were|are|have\s+been)\s+(?:given|configured|programmed|instructed|told|set\s+up|initialized)\b|\bpaste\s+(?:it|them|that|the\s+\w+)\s+(?:below|here|now)\b|\bconfigure\s+this\b',
    "ai_self": r'\b(?:your|the)\s+(?:system\s+)?(?:prompt|instruction|instructions|guideline|guidelines|configuration|config|rule|rules|directive|directives|training|constraints?)\b|\bsystem\s+prompt\b',
    "protective": r"\b(?:should|must|shall|needs?\s+to|has\s+to|ought\s+to)\s+(?:be\s+|remain\s+|stay\s+)?(?:stored|kept|held|handled|treated)\s+(?:\w+\s+){0,2}(?:secure|securely|safe|safely|confidential|confidentially|private|privately|secret)\b|\b(?:do\s+not|don'?t|never|must\s+not|mustn'?t|should\s+not|shouldn'?t|cannot|can'?t|do\s+not\s+ever)\s+(?:\w+\s+){0,2}(?:reveal|disclos\w+|shar\w+|expos\w+|leak\w*|divulg\w+|show\w*|send|give|hand\s+over|surrender)\b|\bkeep\s+(?:it|them|this|that|the\s+\w+|your\s+\w+)\s+(?:\w+\s+){0,2}(?:secret|private|confidential|secure|safe)\b|\bprevent\s+(?:\w+\s+){0,3}(?:disclosure|leakage|exposure|exfiltration|access)\b|\b(?:protect|safeguard|secure)\s+(?:the|your|our|its)\s+(?:\w+\s+){0,2}(?:prompt|instructions?|secret|credential|configuration|config|key|data)\b",
    "active_exfil": r'\b(?:reveal|expos\w+|disclos\w+|divulg\w+|leak\w*|exfiltrat\w+|dump|send|paste|print|output|reproduce|show|give|hand\s+over|tell)\b[\s\S]{0,40}?(?:system\s*prompt|your\s+(?:prompt|instructions?|rules?|config\w*|guidelines?)|the\s+(?:system\s*)?(?:prompt|instructions?)|hidden\s+(?:instructions?|rules?|developer\s+\w+)|developer\s+(?:instructions?|message|prompt)|initial\s+(?:instructions?|prompt))',
    "negated_extract": r"\b(?:not|never|cannot|refuse\s+to|avoid|prevent(?:s|ing)?\s+\w+\s+from|(?:do|does|did|is|are|was|were|has|have|had|ca|could|would|should|must|wo|need|dare|might|ai)n'?t)\s+(?:\w+\s+){0,2}(?:reveal|expos\w+|disclos\w+|divulg\w+|leak\w*|shar\w+|send\w*|giv\w+|dump\w*|print\w*|output\w*|paste\w*|show\w*|tell)\b",
    "extract_clause": r'\b(?:reveal|expos\w+|disclos\w+|divulg\w+|leak\w*|dump|send|paste|print|output|reproduce|repeat|echo|display|show|shar\w+|give|hand\s+over|surrender|tell)[\s,]+(?:me\s+|us\s+)?(?:it|them|those|these|the\s+(?:system\s*)?(?:prompt|instructions?|config\w*|rules?|guidelines?|secrets?)|your\s+(?:system\s+)?(?:prompt|instructions?|config\w*|rules?|guidelines?|secrets?)|system\s*prompt)\b',
    "local_negation": r"\b(?:not|never|cannot|refuse\s+to|avoid|(?:do|does|did|is|are|was|were|has|have|had|ca|could|would|should|must|wo|need|dare|might|ai)n'?t)(?:\s*,[^,.;!?\n]{0,40},)?\s+(?:(?:ever|even|fully|directly|to|be)\s+){0,2}(?:(?:reveal|expos\w*|disclos\w*|divulg\w*|leak\w*|shar\w*|show\w*|send\w*|giv\w*|dump\w*|print\w*|output\w*|echo\w*|displa\w*|reproduc\w*|repeat\w*|surrender\w*|tell\w*|hand\s+over|obscur\w*|hid\w*|conceal\w*|withhold\w*|protect\w*|safeguard\w*|stor\w*|keep\w*)\w*\s*[,;]?\s*(?:and\s+|or\s+|nor\s+)?)*(?:\w+\s+){0,2}$",
    "clause_boundary": r'[.;!?\n]|\b(?:but|yet|however|instead|rather|regardless|anyway|nonetheless|nevertheless|otherwise|still|though|whereas|conversely|then|so)\b',
    "quoted_attack": '[\'\\"‘’“”`][^\'\\"‘’“”`]{0,200}?\\b(?:ignore|disregard|forget|override|bypass|reveal|expos\\w*|leak\\w*|disclos\\w*|divulg\\w*|exfiltrat\\w*|dump|jailbreak)\\b[^\'\\"‘’“”`]{0,200}?[\'\\"‘’“”`]',
    "artifact": r'\b(?:security\s+checklist|checklist|test\s+fixture|unit\s+tests?|log\s+(?:line|entry|message)|logline|secrets?\s+manager|leakage)\b',
    "code_span": r'```[^`]{0,2000}```|``[^`]{0,500}``|`[^`\n]{0,500}`',
    "documentary": r'\b(?:incident\s+(?:report|response|ticket)|post[-\s]?mortem|post[-\s]?incident|root\s+cause|timeline\s+(?:entry|shows?)|containment\s+note|forensics?|indicators?\s+of\s+compromise|intrusion|compromised\s+(?:dependency|host|account|package|agent|build|node|pod)|(?:attacker|adversary|actor|intruder|threat\s+actor)s?\s+(?:\w+\s+){0,3}(?:ran|executed|issued|used|invoked|typed|added|attempted|cleared|established)|we\s+(?:observed|detected|confirmed|found|saw)|was\s+(?:observed|responsible)|(?:responder|analyst|operator|investigator|forensics)\s+(?:\w+\s+){0,3}(?:observed|found|noted|reported|record)|runbook|playbook|on[-\s]call|escalation\s+(?:path|procedure|from)|maintenance\s+window|failover|remediation\s+step|step\s+\d+|(?:company|security|acceptable[-\s]use|data[-\s]handling)\s+(?:policy|standard|manual)|policy\s+(?:doc\w*|states?|requires?|prohibits?|explains?)|(?:is|are)\s+prohibited|prohibits|are\s+required\s+to|must\s+not\s+be|section\s+\d+(?:\.\d+)*|per\s+the\s+(?:security\s+)?(?:manual|policy|standard)|compliance\s+team|reportable\s+violation|code\s+review|review\s+comment|this\s+(?:pr|patch|diff|changeset)\b|why\s+does\s+this|before\s+this\s+merges|for\s+the\s+author|nit\s*:|would\s+rather\s+not\s+merge|please\s+(?:use|add|vendor|replace|verify)|support\s+ticket|ticket\s+(?:#|update)|customer\s+(?:reports?|question|asked)|the\s+reporter\s+asked|action\s+item|detection\s+(?:rule|documentation|engineering)|rules?\s+[A-Z][A-Za-z0-9_]{4,}|fires\s+on|the\s+corpus\s+contains|unit\s+tests?|changelog|coverage\s+note|rules?\s+reference|readme|this\s+(?:guide|documentation|doc)\b|our\s+docs?\b|the\s+doc(?:s|umentation)?\s+(?:explains?|lists?|states?|says?|describes?|documents?)|documents?\s+why|red[-\s]?team|purple[-\s]?team|blue\s+team|pen[-\s]?test\w*|the\s+engagement|during\s+the\s+engagement|engagement\s+summary|write[-\s]?up|assessor|finding\s+(?:\d|RT)|written\s+authorization|lab\s+exercise|training\s+module|this\s+lesson|course\s+chapter)',
    "predicate": r'\b(?:is|are|was|were|be|been|am|have|has|had|do|does|did|can|will|ignore|disregard|forget|override|bypass|disable|enable|activate|deactivate|reveal|expos\w*|disclos\w*|divulg\w*|leak\w*|dump|send|paste|print|output|echo|repeat|reproduce|display|show|shar\w*|give|tell|surrender|pretend|act|behave|become|roleplay|simulate|assume|run|execute|exec|eval|invoke|launch|spawn|cat|bat|head|tail|less|more|nl|od|xxd|strings|cp|scp|rsync|mv|tar|zip|gzip|base64|openssl|curl|wget|nc|ncat|ssh|chmod|chown|rm|shred|unlink|read|open|fetch|upload|download|exfiltrat\w*|email|transmit|forward|post)\b',
    "attribution": r'\b(?:reads|says|said|shows|showed|shown|reported|recorded|logged|contains|contained|captures|captured|includes|included|quoted|cited|mentioned|noted|stated|described|documented|indicated|matched|tripped|trips|triggered|fired|repeats|repeated|detected|observed|flagged|attached|appended|sent|typed|issued|entered|submitted|attempted|tried|wrote|asked|requested|replied|answered|refused)\b',
}
CLAUSE_LOOKBACK = 240

# A question about the model itself; directives to decode or run, and encoded blobs.
SELF_REFERENCE = r'\b(?:what|how|tell|describe|explain|share|give|show|reveal|list)\b.{0,30}\b(?:your|you|yourself)\b.{0,30}\b(?:setup|configuration|config|role|purpose|instruction|prompt|rule|guideline|directive|how\s+you|inner|foundation|blueprint|framework|parameters?|settings?|init(?:ial)?|origin(?:al)?|train(?:ing|ed)|built|made|programmed|configured|core\s+(?:function|behavior|logic))\b'
SELF_REFERENCE_SCORE = 0.15
DECODE_DIRECTIVE = r'(?:(?:please|kindly|pls|now|then|go\s+ahead\s+and)\s+){0,2}(?:(?:(?:base64|b64|hex|url|rot-?13)\s*[-\s]?\s*)?\b(?:decode|decipher|decrypt|unescape|de-?obfuscate|unpack|run|execute|exec|eval|follow|obey|apply|carry\s+out|process|interpret|translate|parse|convert)\b(?:\s+(?:and|then|&|,)\s+(?:run|execute|exec|eval|follow|obey|apply|carry\s+out|process))?\s*[,:]?\s+(?:it|them|this|that|these|those|the\s+(?:following|above|below|base64|b64|hex|encoded|payload|blob|string|text|code|instruction|instructions|content|data|command|script|cipher))\b|(?:(?:base64|b64|hex|url|rot-?13)\s*[-\s]?\s*)?\b(?:decode|decipher|decrypt|unescape|de-?obfuscate|unpack)\b\s*(?:and|then|&|,)\s+(?:run|execute|exec|eval|follow|obey|apply|carry\s+out|process)\b|\b(?:base64|b64|hex|url|rot-?13)\s*[-\s]?\s*(?:decode|decipher|decrypt|unescape|de-?obfuscate|unpack)\b)'
BLOBS = [r'[A-Za-z0-9+/]{24,4096}={0,2}', r'(?:0x)?[0-9a-fA-F]{32,4096}', r'(?:%[0-9A-Fa-f]{2}){8,}']
BLOB_SEPARATORS = " \t\r\n:;,.!?-'\"`()[]{}<>#|*~"

# Shapes of identifiers that are not plain.
ID_TRAVERSAL = r'(?:^|[/\\])\.\.(?:[/\\]|$)'
ID_ENCODED = r'(?i)%00|%2e|%2f|%5c'
ID_ABSOLUTE = r'^(?:[/\\]|[A-Za-z]:[/\\])'
ID_CONTROL = r'[\x00-\x1f\x7f]'
ID_INJECTION = r'[;|&$`<>()\n\r\t]'

# Parts of SQL text and of URLs.
SQL_OBJECT_KIND = r'^\s*\w+\s+(?:if\s+exists\s+)?(table|database|schema|index|view|column|keyspace|collection|tablespace|materialized\s+view|sequence|trigger|function|procedure|role|user)\b'
SQL_OBJECT = r'\b(?:from|into|update|table|database|schema|keyspace)\s+(?:if\s+exists\s+)?[`\"\[]?([a-zA-Z_][\w$]{0,62}(?:\.[a-zA-Z_][\w$]{0,62})?)[`\"\]]?'
URL_SCHEME = r'^\s*([a-zA-Z][a-zA-Z0-9+.\-]{0,31}):(//)?'
URL_AUTHORITY = r'^\s*([0-9a-fA-Fx:.\[\]]{3,45})(?::\d{1,5})?(?:[/?#]|$)'

# Data-loss patterns (id, category, score, ignore case, mode, pattern).
DATA_LOSS = [
    ("DLP_ssn", "pii_ssn", 0.85, False, "search", r'\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b'),
    ("DLP_credit_card", "pii_credit_card", 0.85, False, "luhn", r'\b(?:4[0-9]{3}|5[1-5][0-9]{2}|3[47][0-9]{2}|6(?:011|5[0-9]{2}))(?:[ -]?[0-9]){9,15}\b'),
    ("DLP_email_bulk", "pii_email_bulk", 0.7, True, "count", r'\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}\b'),
    ("DLP_phone", "pii_phone", 0.4, False, "search", r'\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b'),
    ("DLP_api_key", "secret_api_key", 0.85, True, "search", '(?:api[_-]?key|apikey|secret[_-]?key|secret[_-]?access[_-]?key|access[_-]?token|auth[_-]?token|bearer)\\s*[:=]\\s*[\\"\']?([a-zA-Z0-9_\\-/+]{20,})[\\"\']?'),
    ("DLP_github_token", "secret_github_token", 0.9, False, "search", r'\bgh[pousr]_[A-Za-z0-9]{36,255}\b|\bgithub_pat_[A-Za-z0-9_]{40,255}\b'),
    ("DLP_aws_key", "secret_aws_key", 0.9, False, "search", r'(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}'),
    ("DLP_private_key", "secret_private_key", 0.9, False, "search", r'-----BEGIN\s+(?:RSA|DSA|EC|OPENSSH|PGP)?\s*PRIVATE\s+KEY-----'),
    ("DLP_connection_string", "secret_connection_string", 0.85, True, "search", '(?:mongodb|postgres|mysql|redis|amqp)://[^\\s\\"\']+:[^\\s\\"\']+@[^\\s\\"\']+'),
    ("DLP_jwt", "secret_jwt", 0.85, False, "search", r'eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}'),
    ("DLP_password_inline", "secret_password", 0.8, True, "search", '(?:password|passwd|pwd)\\s*[:=]\\s*[\\"\']?[^\\s\\"\']{8,}[\\"\']?'),
]
