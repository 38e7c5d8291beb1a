"""Rules on what an action touches: (id, class, tier, condition, score or None)."""

from __future__ import annotations

from dataclasses import dataclass, field

TIERS = ["low", "medium", "high", "critical"]
#: Of equal tiers, the class that names the finding.
PRECEDENCE = ["credential_access", "execute", "read", "unknown"]

_SENSITIVE = r"(?:/etc/(?:shadow|gshadow|sudoers)|\.ssh/|\bid_(?:rsa|ed25519|ecdsa|dsa)\b|\.aws/credentials|\.kube/config|\.netrc|\.pgpass|\.docker/config\.json|\.env\b|/proc/self/environ|credentials(?:\.json)?$|\.gnupg|\.npmrc|\.pypirc|\.pem\b|\.key\b)"
_SHELLS = ["sh", "bash", "zsh", "dash", "ksh"]
_READERS = ["cat", "bat", "head", "tail", "less", "more", "nl", "od", "xxd", "strings", "cp", "base64", "openssl", "grep", "awk", "sed", "tar", "zip"]

TOOL_RULES = [
    (["read_*", "get_*", "list_*", "search_*", "fetch_file", "view_*"], "read", "low"),
    (["write_*", "create_*", "update_*", "edit_*", "append_*", "put_*"], "write", "medium"),
    (["delete_*", "remove_*", "drop_*", "purge_*", "destroy_*"], "delete", "high"),
    (["send_*", "post_*", "email_*", "http_*", "notify_*", "webhook_*"], "network", "medium"),
    (["transfer_*", "pay_*", "purchase_*", "refund_*"], "financial", "high"),
    (["grant_*", "revoke_*", "assign_role*", "add_user*"], "privilege", "high"),
    (["deploy_*", "rollback_*", "scale_*"], "infrastructure", "high"),
]

COMMAND_RULES = [
    ("exec.code_in_args", "execute", "high", {"name": ["python*", "perl", "ruby", "node", "php"], "args": r"(?:^|\s)-\w*[cer]\s+.*(?:os\.system|subprocess|exec\(|eval\(|socket|child_process)"}, 0.8),
    ("exec.interpreter_payload", "execute", "high", {"name": [*_SHELLS, "python*", "perl", "ruby", "node", "php", "pwsh", "powershell"], "args": r"^-\w*[cer]\b|^-enc"}, None),
    ("escalate.sudoers_edit", "privilege", "critical", {"target": r"/etc/sudoers", "op": [">", ">>"]}, 0.9),
    ("escalate.sudoers_edit", "privilege", "critical", {"name": ["visudo", "tee"], "args": r"/etc/sudoers"}, 0.9),
    ("escalate.setuid_bit", "privilege", "critical", {"name": ["chmod"], "args": r"(?:\bu?\+s\b|\b[2467][0-7]{3}\b)"}, 0.85),
    ("escalate.user_admin_uid_zero", "privilege", "critical", {"name": ["useradd", "usermod", "adduser"], "args": r"(?:-o\s+)?-u\s*0\b|\b(?:sudo|wheel|root|admin)\b"}, 0.85),
    ("escalate.user_admin", "privilege", "high", {"name": ["useradd", "usermod", "adduser", "passwd", "chpasswd"]}, None),
    ("cred.metadata_endpoint", "credential_access", "critical", {"name": ["curl", "wget", "nc"], "args": r"169\.254\.169\.254|metadata\.google\.internal|metadata\.azure"}, 0.9),
    ("cred.remote_copy_sensitive", "credential_access", "critical", {"name": ["scp", "rsync", "sftp"], "args": _SENSITIVE}, 0.9),
    ("cred.cloud_upload_sensitive", "credential_access", "critical", {"name": ["aws", "gsutil", "az", "rclone", "s3cmd"], "args": rf"\b(?:cp|sync|put|upload|copy|mv)\b.*{_SENSITIVE}"}, 0.9),
    ("cred.mail_exfil_redirect", "credential_access", "critical", {"name": ["mail", "mailx", "mutt", "sendmail"], "target": _SENSITIVE, "op": ["<"]}, 0.9),
    ("cred.secret_manager", "credential_access", "high", {"name": ["aws", "gcloud", "az", "vault", "op", "kubectl"], "args": r"secretsmanager\s+get-secret|secrets?\s+(?:versions\s+access|show|get)|keyvault\s+secret|\bget\s+secrets?\b|\bkv\s+get\b|\bread\s+secret"}, None),
    ("cred.sensitive_file", "credential_access", "critical", {"name": _READERS, "args": _SENSITIVE}, 0.85),
    ("cred.sensitive_file_redirect", "credential_access", "critical", {"target": _SENSITIVE, "op": ["<"]}, 0.85),
    ("destroy.sensitive_path", "delete", "critical", {"name": ["rm", "shred", "unlink"], "args": r"(?:^|\s)-\w*[rf]\w*.*(?:\s|^)(?:/|~|\*|\$HOME|/(?:etc|usr|var|home|boot|root|bin)\S*)(?:\s|$|/\*?)"}, 0.95),
    ("destroy.disk", "delete", "critical", {"name": ["mkfs*", "dd", "wipefs", "fdisk"], "args": r"/dev/\w+"}, 0.95),
    ("destroy.force_remove", "delete", "high", {"name": ["rm", "shred"], "args": r"(?:^|\s)-\w*[rf]"}, None),
    ("infra.database_drop", "infrastructure", "critical", {"name": ["psql", "mysql", "sqlite3", "mongo", "mongosh", "dropdb"], "args": r"\bdrop\s+(?:database|table|schema)\b|dropDatabase"}, 0.85),
    ("infra.teardown", "infrastructure", "critical", {"name": ["terraform", "kubectl", "helm", "docker", "pulumi"], "args": r"\b(?:destroy|delete\s+(?:ns|namespace|all|deploy\w*|pvc?)|uninstall|system\s+prune)\b"}, None),
    ("exec.remote_shell", "execute", "critical", {"name": ["nc", "ncat", "netcat", "socat"], "args": r"(?:^|\s)(?:-\w*[ec]\b|exec:)"}, 0.9),
    ("exec.remote_shell", "execute", "critical", {"raw": r"/dev/(?:tcp|udp)/"}, 0.9),
    ("exec.tool_exec_flag", "execute", "high", {"name": ["find", "tar", "vim", "git", "rsync", "awk"], "args": r"-exec(?:dir)?\b|--checkpoint-action|--to-command|-e\s*(?:ssh|sh)|system\("}, None),
    ("persist.schedule", "persistence", "high", {"name": ["crontab", "at", "systemctl", "launchctl"], "args": r"(?:^|\s)(?:-e|-\b|enable|load|edit)|^-$|/\S+"}, None),
    ("exec.wrapper_exec", "execute", "high", {"wrappers": ["xargs", "exec"], "name": [*_SHELLS, "rm", "python*", "perl"]}, None),
    ("escalate.privileged_wrapper", "privilege", "high", {"wrappers": ["sudo", "doas"], "name": [*_SHELLS, "su", "python*", "vi*", "chmod", "chown", "mount"]}, None),
    ("escalate.privileged_wrapper_stripped", "privilege", "high", {"name": ["sudo", "doas", "su"]}, None),
    ("exec.bare_shell", "execute", "high", {"name": _SHELLS, "most_args": 1}, None),
    ("net.transfer", "network", "medium", {"name": ["curl", "wget", "scp", "rsync", "ftp", "sftp", "ssh", "nc", "ncat"]}, None),
    ("file.permission", "write", "medium", {"name": ["chmod", "chown", "chgrp"]}, None),
    ("file.write", "write", "medium", {"name": ["mv", "cp", "tee", "touch", "mkdir", "ln", "truncate"]}, None),
    ("read.plain", "read", "low", {"name": ["ls", "cat", "head", "tail", "pwd", "whoami", "echo", "grep", "find", "stat", "wc", "df", "du", "ps", "uptime", "date", "less", "more", "git", "which", "file", "sort", "uniq", "cut"]}, None),
]

#: (id, class, tier, score, some segment, some segment)
COMBINATIONS = [
    ("combo.fetch_to_shell", "execute", "critical", 0.9, {"name": ["curl", "wget", "fetch", "base64", "xxd"]}, {"name": [*_SHELLS, "python*", "perl", "ruby"], "most_args": 1}),
    ("combo.archive_to_egress_sink", "credential_access", "critical", 0.85, {"name": ["tar", "zip", "gzip", "7z"], "args": r"/(?:etc|home|root|var)|~|\$HOME"}, {"name": ["nc", "ncat", "ssh", "socat", "scp"]}),
    ("combo.archive_to_http_upload", "credential_access", "critical", 0.85, {"name": ["tar", "zip", "gzip", "7z"]}, {"name": ["curl", "wget"], "args": r"(?:-F|-T|-d|--data\S*|--upload-file|--post-file|-X\s*(?:POST|PUT))"}),
    ("combo.sensitive_object_to_egress_sink", "credential_access", "critical", 0.9, {"args": _SENSITIVE}, {"name": ["nc", "ncat", "ssh", "socat", "mail", "sendmail"]}),
    ("combo.sensitive_object_to_http_upload", "credential_access", "critical", 0.9, {"args": _SENSITIVE}, {"name": ["curl", "wget"], "args": r"(?:-F|-T|-d|--data\S*|--upload-file|--post-file|-X\s*(?:POST|PUT))"}),
    ("combo.cron_fetch_exec_install", "persistence", "critical", 0.9, {"raw": r"\b(?:curl|wget)\b"}, {"name": ["crontab", "at"]}),
]

SQL_RULES = [
    ("infra.database_drop", "infrastructure", "critical", {"statement": ["drop"], "object_kind": ["database", "schema", "keyspace", "tablespace"]}, 0.85),
    ("sql.tautological_mutation", "delete", "critical", {"statement": ["delete", "update"], "predicate": ["tautology"]}, 0.8),
    ("sql.unbounded_mutation", "delete", "critical", {"statement": ["delete", "update"], "predicate": ["none"]}, 0.7),
    ("sql.drop_object", "delete", "critical", {"statement": ["drop", "truncate"]}, 0.75),
    ("sql.privilege", "privilege", "high", {"statement": ["grant", "revoke"]}, None),
    ("sql.schema_change", "infrastructure", "high", {"statement": ["alter", "create"]}, None),
    ("sql.code", "execute", "high", {"statement": ["exec", "execute", "call"]}, None),
    ("sql.bounded_delete", "delete", "high", {"statement": ["delete"]}, None),
    ("sql.write", "write", "medium", {"statement": ["insert", "update", "merge", "replace"]}, None),
    ("sql.read", "read", "low", {"statement": ["select", "with"]}, None),
]

URL_RULES = [
    ("net.metadata_link_local", "credential_access", "critical", {"address": ["link_local"]}, 0.9),
    ("net.metadata_host", "credential_access", "critical", {"host": ["metadata.google.internal", "metadata.azure*", "metadata"]}, 0.9),
    ("net.local_file_scheme", "read", "high", {"scheme": ["file"]}, 0.7),
    ("net.scheme_smuggling", "network", "high", {"scheme": ["gopher", "dict", "ldap", "jar", "tftp", "netdoc"]}, 0.7),
    ("net.internal_address", "network", "medium", {"address": ["private", "loopback"]}, None),
    ("net.external", "network", "low", {"scheme": ["http", "https"]}, None),
]

#: Arguments that raise a tier: (key glob, value pattern or None, least tier)
ESCALATIONS = [(["recursive", "force", "all"], r"^(?i:true|1|yes)$", "high"), (["password", "secret", "token", "api_key"], None, "high"), (["env*", "target"], r"(?i)^prod(?:uction)?$", "critical")]
#: Keys whose values are commands.
COMMAND_KEYS = ["command", "cmd", "script", "args", "shell", "code"]


@dataclass
class ImpactRules:
    """All rules on what an action touches, in the order in which they are tried; those here unless others are given."""

    tools: list[tuple] = field(default_factory=lambda: TOOL_RULES)
    commands: list[tuple] = field(default_factory=lambda: COMMAND_RULES)
    combinations: list[tuple] = field(default_factory=lambda: COMBINATIONS)
    sql: list[tuple] = field(default_factory=lambda: SQL_RULES)
    urls: list[tuple] = field(default_factory=lambda: URL_RULES)
    escalations: list[tuple] = field(default_factory=lambda: ESCALATIONS)
